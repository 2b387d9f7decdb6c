"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import ann, bpe, fingerprint, jaccard, langid, line_dedup, packing, sharding, substring_dedup, toxicity
from tagloom.llm.common import materialize, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes the ids; the result holds digests of both."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(documents, ranks, pattern), ranks, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.packed_ids_column(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


SEQUENCE_TOKENS = 2048


def packed_documents(documents: DataFrame) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in as few sequences as can be had."""
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = documents.select("doc_id", packing.token_bytes_column(F.col("text"), path, end_id=0).alias("ids"))
    pieces = packing.cut(ids, "ids", SEQUENCE_TOKENS).select("doc_id", "piece", "start", "length", F.crc32("piece_ids").alias("ids_crc32"))
    return packing.pack(materialize(pieces, "pieces"), ["doc_id", "piece", "ids_crc32"], SEQUENCE_TOKENS)  # a table of numbers


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document, whole, into sequences of 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A run of lines counts as repeated if it has two lines, or one of forty characters.
MIN_LINES, MIN_CHARS = 2, 40


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs from every document; the kept text as a digest."""
    cleaned = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=MIN_LINES, min_chars=MIN_CHARS)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a floor: later copies of single lines of any length go too."""
    cleaned = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=1)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM split WHERE length(trim(line, ' ')) > 0),
pairs AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS line2 FROM full_lines),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n1,
         row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) AS n2 FROM pairs),
flagged AS (
  SELECT *, (n1 > 1 AND length(line) >= 40) OR (line2 IS NOT NULL AND n2 > 1)
         OR coalesce(lag(line2 IS NOT NULL AND n2 > 1) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone
  FROM ranked),
every AS (
  SELECT s.doc_id, s.pos, s.line, f.gone, f.seq,
         last_value(f.gone IGNORE NULLS) OVER (PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
         first_value(f.gone IGNORE NULLS) OVER (PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM split s LEFT JOIN flagged f ON f.doc_id = s.doc_id AND f.pos = s.pos),
texts AS (
  SELECT doc_id, count(seq) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, before AND after, false)), '') AS kept
  FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes words covered by windows of 13 words that a document of smaller id has too; the kept words as a digest."""
    cleaned = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    words = F.expr(r"trim(BOTH ' ' FROM regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' '))")
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM lists WHERE len(words) >= 13)),
firsts AS (SELECT w, min(doc_id) AS lo FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, p + o.range AS p
  FROM windows JOIN firsts USING (w), range(13) o WHERE doc_id > lo),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS text
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM lists) e
  ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT l.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM lists l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprint.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _lot(n: int):
    """crc32 of the document id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def language_model(documents: DataFrame) -> langid.LanguageModel:
    return langid.fit(documents, _lot(3) != 1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; documents of remainder 1 are held out from training."""
    documents = table(spark, sf_dir, "documents")
    model = language_model(documents)
    told = langid.identify(documents.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(_lot(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document and its number of links, at five words and 0.8."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, threshold=0.8)


OP7_SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM lists WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, list_sort(list(s)) AS whole FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, x.whole AS wa, y.whole AS wb FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE c / (x.n + y.n - c) >= 0.8),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen),
classes AS (SELECT doc_id, min(seen) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT wb) FILTER (WHERE wb <> wa) AS n_linked_texts FROM links GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links, coalesce(n.n_linked_texts, 0) AS n_linked_texts
FROM classes c LEFT JOIN counts n ON n.doc_id = c.doc_id
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; documents of remainder 0 are held out from training."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), _lot(5) != 0)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", F.coalesce(_lot(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found to every row whose id is divisible by 100."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(embeddings, embeddings.filter(F.col("vec_id") % 100 == 0), k=10)


#: How many arrivals the documents come in, and the size of a finished shard.
ARRIVALS, SHARD_BYTES = 4, 64 << 20


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents in four arrivals, compacts, and reads the rows back through the last manifest."""
    store = sharding.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    documents = table(spark, sf_dir, "documents")
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for i in range(ARRIVALS):
        store.append(documents.filter(arrival == i))
    store.compact(target=SHARD_BYTES)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP9_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op3_every_line_dedup": op3_every_line_dedup,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op9_sharding": OP9_SQL,
}
