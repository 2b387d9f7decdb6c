"""Queries of joins, windows, set operations, samples, segments, retrieval and event time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions import tags
from tagloom.operators import metrics, relations, retrieval, sampling, segments
from tagloom.plans.views import NORM, TAGGED, query, table, tagged
from tagloom.streaming import events as streams

# joins


@query("jon02_matched", """SELECT 'matched' AS side, count(*) AS n, sum(l.toxic) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'missed', count(*), NULL FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def jon02(spark, sf):
    hit, miss = relations.matched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    count = lambda df, name, toxic: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), toxic.alias("toxic"))
    return count(hit, "matched", F.sum("toxic")).unionByName(count(miss, "missed", F.lit(None).cast("long")))


@query("jon05_last_duplicate_wins", """SELECT c.c_custkey, o.o_orderkey, o.o_orderpriority FROM customer c JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) o
  ON c.c_custkey = o.o_custkey AND o.r = 1""")
def jon05(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return relations.matched(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", last=F.col("o_orderkey"))[0]


@query("jon06_enriched", """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.lang) AS text FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def jon06(spark, sf):
    index = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("text"))
    return relations.enriched_or_passed(table(spark, sf, "documents").select("doc_id", "lang"), index, "doc_id", "text", "lang").select("doc_id", "text")


@query("jon07_labels_default", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def jon07(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("jon08_point_lookup", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def jon08(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return relations.point_lookup(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), wanted, ["l_orderkey", "l_linenumber"])


@query("jon10_semi_anti", """SELECT count(*) FILTER (WHERE hit) AS present, count(*) FILTER (WHERE NOT hit) AS absent FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS hit FROM customer)""")
def jon10(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    present = customers.join(orders, "c_custkey", "left_semi").agg(F.count("*").alias("present"))
    return present.crossJoin(customers.join(orders, "c_custkey", "left_anti").agg(F.count("*").alias("absent")))


@query("jon12_paired_by_hash")
def jon12(spark, sf):
    """A fixed pseudo-random benchmark item for every document."""
    items = relations.numbered(table(spark, sf, "benchmark").select("item_id"), ["item_id"], "number")
    return relations.paired_by_hash(table(spark, sf, "documents").select("doc_id"), items, "doc_id", 42, items.count())


@query("jon19_grid", """SELECT o_orderkey, snr, round(o_totalprice * snr, 2) AS scaled FROM orders, (VALUES (0), (10), (20)) t(snr)""")
def jon19(spark, sf):
    levels = spark.createDataFrame([(0,), (10,), (20,)], "snr int")
    return relations.grid(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), levels).select("o_orderkey", "snr", F.round(F.col("o_totalprice") * F.col("snr"), 2).alias("scaled"))


# windows


@query("win01_first_per_key", """SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def win01(spark, sf):
    return relations.distinct_on(table(spark, sf, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@query("win02_first_unless_exempt", """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR source = 'src1'""")
def win02(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return relations.first_unless_exempt(docs, "source", "doc_id", F.coalesce(F.col("source") == "src1", F.lit(False)))


@query("win03_span_ordinals", rf"""WITH {TAGGED}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'ENTITY_CITY (?:new )?src\d+ END')) AS s FROM tagged)
  SELECT doc_id, 'ENTITY_CITY' AS label, regexp_replace(s, '^ENTITY_CITY (.*) END$', '\1') AS phrase, 1 AS ordinal FROM m""")
def win03(spark, sf):
    return tagged(spark, sf).select("doc_id", F.explode(tags.spans(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query("win04_next_turns", """SELECT conv_id, turn, role, next_role, next_turn FROM (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next_turn IS NOT NULL""")
def win04(spark, sf):
    return segments.next_turns(table(spark, sf, "conversations"), "conv_id", "turn", ["role", "turn"]).select("conv_id", "turn", "role", "next_role", "next_turn")


@query("win05_role_segments", """WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS n FROM conversations),
  i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
  SELECT conv_id, island, any_value(role) AS role, min(turn) AS first, max(turn) AS last, count(*) AS turns, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM i GROUP BY conv_id, island""")
def win05(spark, sf):
    made = segments.role_segments(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return made.withColumn("digest", F.md5("text")).drop("text")


@query("win06_speaker_changes", """SELECT conv_id, turn, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS changed FROM conversations""")
def win06(spark, sf):
    return segments.speaker_changes(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "changed")


@query("win07_ends", """SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "end" FROM orders""")
def win07(spark, sf):
    return segments.ends_from_starts(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("win09_repeats", r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM documents)
  SELECT doc_id, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS repeats FROM w""")
def win09(spark, sf):
    from tagloom.functions.metadata import disfluency

    return table(spark, sf, "documents").select("doc_id", disfluency(F.col("text"), ["um"], F.lit(0.0))["repeats"].alias("repeats"))


@query("win10_collapsed_frames", """WITH f AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
  SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS path FROM f WHERE event_type <> 'view' AND event_type IS DISTINCT FROM before GROUP BY user_id""")
def win10(spark, sf):
    frames = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("f"))
    return frames.select("user_id", F.array_join(metrics.collapse_repeats(F.col("f"), "view"), ",").alias("path")).filter("path <> ''")


@query("win11_top_per_group", """SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def win11(spark, sf):
    order = W.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


@query("win15_word_groups", """WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('▁', role) ELSE role END AS piece FROM conversations),
  g AS (SELECT *, sum(CASE WHEN starts_with(piece, '▁') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS word FROM p)
  SELECT conv_id, word, string_agg(piece, '' ORDER BY turn) AS text FROM g GROUP BY conv_id, word""")
def win15(spark, sf):
    pieces = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("▁"), "role")).otherwise(F.col("role")).alias("piece"))
    grouped = segments.islands(pieces, ["conv_id"], "turn", F.startswith("piece", F.lit("▁")), "word")
    return grouped.groupBy("conv_id", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "").alias("text"))


# sets


@query("set01_stacked", """SELECT 'customer' AS kind, c_custkey AS key, NULL AS size FROM customer UNION ALL SELECT 'part', p_partkey, 1 FROM part""")
def set01(spark, sf):
    customers = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"))
    return relations.stacked(customers, table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.lit(1).alias("size")))


@query("set02_repeated", """SELECT s_suppkey, copy FROM supplier, range(1, 4) r(copy) WHERE copy <= s_suppkey % 4""")
def set02(spark, sf):
    return relations.repeated(table(spark, sf, "supplier").select("s_suppkey"), (F.col("s_suppkey") % 4).cast("int")).select("s_suppkey", "copy")


@query("set04_tag_sets", rf"""WITH {NORM} SELECT doc_id, len(list_intersect(list_distinct(tags), ['END', 'ENTITY_CITY', 'EMOTION_HAPPY'])) AS common, len(list_filter(list_distinct(tags), lambda t: NOT list_contains(['END', 'ENTITY_CITY', 'EMOTION_HAPPY'], t))) AS more FROM norm""")
def set04(spark, sf):
    known = F.array(*map(F.lit, ["END", "ENTITY_CITY", "EMOTION_HAPPY"]))
    found = tagged(spark, sf).select("doc_id", tags.tags(tags.normalize(F.col("text"))).alias("t"))
    return found.select("doc_id", F.size(F.array_intersect("t", known)).alias("common"), F.size(F.array_except("t", known)).alias("more"))


@query("set07_except_intersect", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set07(spark, sf):
    one, two = table(spark, sf, "customer").select("c_nationkey"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(one.intersect(two), "both").unionByName(count(one.select("c_nationkey").distinct().subtract(two), "only"))


@query("set09_vocabulary_extended", rf"""WITH {NORM}, v AS (SELECT row_number() OVER (ORDER BY n_name) - 1 AS id, n_name AS token FROM nation), t AS (SELECT DISTINCT unnest(tags) AS token FROM norm)
  SELECT id, token FROM v UNION ALL SELECT row_number() OVER (ORDER BY token) + (SELECT max(id) FROM v), token FROM t WHERE token NOT IN (SELECT token FROM v)""")
def set09(spark, sf):
    vocabulary = relations.numbered(table(spark, sf, "nation").select(F.col("n_name").alias("token")), ["token"])
    tokens = tagged(spark, sf).select(F.explode(tags.tags(tags.normalize(F.col("text")))).alias("token"))
    return relations.vocabulary_extended(vocabulary, tokens)


# samples


@query("smp01_split", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.05)) THEN 'valid' ELSE 'train' END AS split FROM r""")
def smp01(spark, sf):
    return sampling.split(table(spark, sf, "documents").select("doc_id"), "doc_id", [("valid", 0.05)], "train", least_first=1)


@query("smp02_three_way", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('7|', o_orderkey)), o_orderkey) AS r, count(*) OVER () AS n FROM orders)
  SELECT split, count(*) AS n, sum(o_orderkey) AS keys FROM (SELECT o_orderkey, CASE WHEN r <= floor(n * 0.9) THEN 'train' WHEN r <= floor(n * 0.9) + floor(n * 0.05) THEN 'valid' ELSE 'test' END AS split FROM r) GROUP BY split""")
def smp02(spark, sf):
    parts = sampling.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", [("train", 0.9), ("valid", 0.05)], "test", seed=7)
    return parts.groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("smp04_stratified", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42|', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r""")
def smp04(spark, sf):
    return sampling.split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", [("train", 0.8), ("valid", 0.1)], "test", by=["lang"])


@query("smp05_positional", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r < n * 90 // 100 THEN 'train' WHEN r < n * 90 // 100 + n * 5 // 100 THEN 'valid' ELSE 'test' END AS split FROM r""")
def smp05(spark, sf):
    return sampling.positional_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("smp06_topped_up", """WITH t AS (SELECT doc_id FROM documents WHERE doc_id % 50 <> 0), v AS (SELECT doc_id FROM documents WHERE doc_id % 50 = 0), s AS (SELECT (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM v) AS v),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) AS r FROM t)
  SELECT doc_id, CASE WHEN r <= (SELECT CASE WHEN v >= 500 THEN 0 ELSE greatest(500 - v, floor(t * 0.05)) END FROM s) THEN 'valid' ELSE 'train' END AS split FROM r UNION ALL SELECT doc_id, 'valid' FROM v""")
def smp06(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return sampling.topped_up(docs.filter("doc_id % 50 <> 0"), docs.filter("doc_id % 50 = 0"), "doc_id")


@query("smp07_balanced")
def smp07(spark, sf):
    """Languages sampled to a total of 500 by temperature; quotas are checked in the tests."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("family"), (1.0 + F.col("doc_id") % 3).alias("weight"))
    return sampling.balanced(docs, "doc_id", "family", "weight", 500, temperature=0.5)


@query("smp09_split_at_changes", r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, length(text) / 10.0 AS d FROM conversations),
  b AS (SELECT conv_id, turn, w, d, list_concat([0], list_filter([2, 5], lambda c: c < len(w)), [len(w)]) AS b FROM w),
  p AS (SELECT conv_id, turn, w, d, b, unnest(range(1, len(b))) AS i FROM b), s AS (SELECT conv_id, turn, i - 1 AS piece, array_to_string(w[b[i] + 1:b[i + 1]], ' ') AS piece_text, (b[i + 1] / greatest(len(w), 1) - b[i] / greatest(len(w), 1)) * d AS e, w FROM p)
  SELECT conv_id, turn, piece, piece_text FROM s WHERE e >= 0.3 AND len(w) > 2 UNION ALL SELECT conv_id, turn, 0, text FROM conversations JOIN w USING (conv_id, turn) WHERE len(w) <= 2 AND d >= 0.3""")
def smp09(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", (F.length("text") / 10.0).cast("double").alias("d")).withColumn("changes", F.array(F.lit(5.0), F.lit(2.2), F.lit(2.9), F.lit(-1.0)))
    pieces = segments.split_at_changes(turns, "text", "changes", "d")
    return pieces.filter(F.col("piece_duration") >= 0.3).select("conv_id", "turn", "piece", "piece_text")


@query("smp10_trimmed", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, n_chars / 15.0 AS d FROM documents)
  SELECT doc_id, md5(array_to_string(w[1:greatest(CAST(floor(len(w) * least(20.0 / d, 1.0)) AS INTEGER), 1)], ' ')) AS digest, round(least(d, 20.0), 4) AS duration FROM w WHERE d > 0""")
def smp10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") / 15.0).cast("double").alias("d")).filter("d > 0")
    return docs.select("doc_id", segments.trimmed(F.col("text"), F.col("d"), 20.0).alias("t")).select("doc_id", F.md5("t.text").alias("digest"), F.round("t.duration", 4).alias("duration"))


@query("smp11_time_chunks", """SELECT doc_id, chunk, chunk * 20.0 AS chunk_start, least((chunk + 1) * 20.0, n_chars / 15.0) AS chunk_end FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(ceil(n_chars / 15.0 / 20.0) AS BIGINT))) AS chunk FROM documents) WHERE least((chunk + 1) * 20.0, n_chars / 15.0) - chunk * 20.0 >= 1.0""")
def smp11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 15.0).cast("double").alias("d"))
    return segments.time_chunks(docs, "d", 20.0).select("doc_id", "chunk", "chunk_start", "chunk_end")


@query("smp15_text_chunks", """SELECT doc_id, chunk, md5(text[chunk * 800 + 1:chunk * 800 + 1000]) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 200) / 800.0), CASE WHEN length(text) > 0 THEN 1 ELSE 0 END) AS BIGINT))) AS chunk FROM documents) WHERE trim(text[chunk * 800 + 1:chunk * 800 + 1000], ' ') <> ''""")
def smp15(spark, sf):
    return segments.text_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 1000, 200).select("doc_id", "chunk", F.md5("chunk_text").alias("digest"))


@query("smp13_voiced_segments")
def smp13(spark, sf):
    """Runs of active events of a user, by the ring buffer that finds speech in frames."""
    frames = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") != "view").alias("voiced"))
    return segments.voiced_segments(frames, "user_id", "event_id", "voiced", ring=3, share=0.6)


# retrieval

_QUERY = [0.1 * ((i % 7) - 3) for i in range(64)]
_SQL_QUERY = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _QUERY) + "]"


@query("rag02_cosine", f"""SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_SQL_QUERY}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_SQL_QUERY}) DESC, vec_id LIMIT 10""")
def rag02(spark, sf):
    return retrieval.nearest(table(spark, sf, "embeddings"), _QUERY, 10, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("rag04_l2", f"""SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: x::DOUBLE), {_SQL_QUERY}), 6) AS score FROM embeddings ORDER BY list_distance(list_transform(embedding, lambda x: x::DOUBLE), {_SQL_QUERY}), vec_id LIMIT 3""")
def rag04(spark, sf):
    return retrieval.nearest(table(spark, sf, "embeddings"), _QUERY, 3, "vec_id", "embedding", "l2").select("vec_id", F.round("score", 6).alias("score"))


_CENTROID = "u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT list(m ORDER BY d) AS c FROM (SELECT d, avg(x) AS m FROM u GROUP BY d))"


@query("rag03_nearest_to_centroid", f"""WITH {_CENTROID} SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: x::DOUBLE), c), 6) AS score FROM embeddings, c ORDER BY list_distance(list_transform(embedding, lambda x: x::DOUBLE), c), vec_id LIMIT 5""")
def rag03(spark, sf):
    return retrieval.nearest_to_centroid(table(spark, sf, "embeddings"), 5, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("agg37_centroids", """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT label, d - 1 AS dim, round(avg(x), 6) AS mean FROM u GROUP BY label, d""")
def agg37(spark, sf):
    return retrieval.centroid(table(spark, sf, "embeddings"), "embedding", ["label"]).select("label", F.posexplode("centroid").alias("dim", "mean")).select("label", "dim", F.round("mean", 6).alias("mean"))


# event time


@query("str_tumbling", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling(spark, sf):
    made = streams.windowed(table(spark, sf, "events"), "1 hour")
    return made.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("str_sliding", """SELECT s AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL""")
def sliding(spark, sf):
    return streams.windowed(table(spark, sf, "events"), "1 hour", "30 minutes").select("window_start", "event_type", "n")


@query("str_sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT * FROM l))
  SELECT user_id, min(ts) AS session_start, count(*) AS n FROM i GROUP BY user_id, s""")
def sessions(spark, sf):
    return streams.sessions(table(spark, sf, "events"), "30 minutes").select("user_id", "session_start", "n")


@query("str01_sliding_context", """SELECT conv_id, turn, string_agg(role, ',' ORDER BY t2) AS context FROM (SELECT a.conv_id, a.turn, b.turn AS t2, b.role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) b ON a.conv_id = b.conv_id AND b.r BETWEEN a.r - 1 AND a.r + 1) GROUP BY conv_id, turn""")
def context(spark, sf):
    chunks = table(spark, sf, "conversations").select("conv_id", "turn", F.array("role").alias("samples"))
    return streams.sliding_context(chunks, "conv_id", "turn", "samples").select("conv_id", "turn", F.array_join("context", ",").alias("context"))


@query("str05_token_times", """SELECT conv_id, turn, round(turn * 0.08, 6) AS time FROM conversations""")
def times(spark, sf):
    return streams.token_times(table(spark, sf, "conversations").select("conv_id", "turn"), "turn", 0.08)


# relational coverage beyond the tagged data


@query("ext_rollup_cube", """SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube(spark, sf):
    made = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus")
    return made.agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_asof", """SELECT e.event_id, b.event_id AS before FROM events e ASOF LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.event_id > b.event_id""")
def asof(spark, sf):
    """The last purchase of the user before each event: one window over both sides, no range join."""
    before = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    return table(spark, sf, "events").select("event_id", before.alias("before"))


@query("ext_star_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def star(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    # lines are summed to orders before they meet the other tables
    orders = lines.groupBy("l_orderkey").agg(F.sum("r").alias("r")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    placed = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))
