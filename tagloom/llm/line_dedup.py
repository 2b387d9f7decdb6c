"""Deletion of repeated line runs, by a suffix array over line-id sequences; DataFrame functions only.

The lines of a document that are not blank form its sequence, and every line starts a suffix. Suffixes are ordered by
prefix doubling: the round of h tells suffixes of equal first h lines apart by the rank of the suffixes h lines further
on. A rank is a list of numbers in lexicographic order, one number longer with each round that a suffix takes part in;
it takes part as long as another suffix has the same rank and its lines go on. Ranks are dealt in the order of sorted
pairs, so that no task orders a whole class.

The suffix array holds the suffixes whose first line is repeated; all others share no line with a neighbour. The longest
common prefix of two neighbours is found by descent through the rounds' ranks, for the pairs whose lines before differ;
where those are equal, it is one line less than that of the suffixes one line earlier. Neighbours of ``min_lines`` lines
in common or more are one interval: its first suffix stays, the ``min_lines`` lines that the others start with are later
copies. Suffixes of a maximal repeated run follow one another, and their lines add up to the run.

A repeated run counts if it has ``min_lines`` lines, or is one line of ``min_chars`` characters or more. Copies are
ordered by (document id, hash of the text, position); the first stays, the lines of later ones are deleted, also within
one document. Documents of equal text are one sequence, that of the least id; in the others every run is a later copy.

Nulls: a null text stays null and has no lines; a null document id sorts first. Blank lines are never compared; those
between two deleted lines go with them. Rows that agree in id and text are one document and lose the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.common import discard, materialize, packed, unpacked

_SALT = "\u0001"
_TEXT = ["_t", "_u"]


def _lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a line that is not blank of each different text.

    ``_t`` and ``_u`` name the text, ``_d`` is its least id and ``_copied`` whether there are others; ``seq`` counts lines
    from 1 to ``n``; ``a`` and ``b`` name the line, ``pa`` the line before.
    """
    texts = documents.select(F.col(f"`{id_col}`").alias("_d"), F.xxhash64(text_col).alias("_t"), F.xxhash64(F.lit(_SALT), text_col).alias("_u"), F.col(f"`{text_col}`").alias("text"))
    exploded = texts.select("_d", *_TEXT, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.length(F.trim("line")) > 0)
    hashed = exploded.select("_d", *_TEXT, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(_SALT), "line").alias("b"), F.length("line").alias("chars"))
    ids = F.min(F.struct("_d")).alias("_lo"), F.max(F.struct("_d")).alias("_hi")
    once = hashed.groupBy(*_TEXT, "pos").agg(*ids, F.first("a").alias("a"), F.first("b").alias("b"), F.first("chars").alias("chars"))
    whole = W.partitionBy(*_TEXT)
    order = whole.orderBy("pos")
    placed = once.withColumns({"seq": F.row_number().over(order), "pa": F.lag("a").over(order), "n": F.count("*").over(whole).cast("int")})
    return placed.select(*_TEXT, F.col("_lo._d").alias("_d"), (F.col("_lo") != F.col("_hi")).alias("_copied"), "seq", "n", "a", "b", "pa", "chars")


def _place() -> Column:
    return F.struct("_d", *_TEXT, "seq")


_ROW = [*_TEXT, "_d", "seq", "n", "pa", "chars", "key", "h1", "h2", "live"]


def _round(rows: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Tells suffixes of equal first ``step`` lines apart by the ranks ``step`` lines on.

    Gives all rows of texts with suffixes still in question, and those suffixes with their new ranks.
    """
    whole = W.partitionBy(*_TEXT)
    further = F.coalesce(F.lead("key", step).over(whole.orderBy("seq")), F.array().cast("array<bigint>"))
    seen = rows.withColumn("second", F.when(F.col("live"), further)).withColumn("_any", F.max("live").over(whole))
    seen = materialize(seen.filter("_any").drop("_any"), "suffixes")
    pairs = seen.filter("live")
    classes = pairs.groupBy("h1", "h2", "second").agg(F.count("*").alias("_c")).sort("h1", "h2", "second").withColumn("rank", F.monotonically_increasing_id())
    classes = materialize(classes, "ranks")
    ranked = pairs.join(classes.hint("merge"), ["h1", "h2", "second"]).select(
        *_ROW[:-4],
        F.concat("key", F.array("rank")).alias("key"),
        F.col("rank").alias("h1"),
        F.lit(0).cast("long").alias("h2"),
        # (a suffix that ends here equals all others of its rank)
        ((F.col("_c") > 1) & (F.col("seq") + 2 * step - 1 <= F.col("n"))).alias("live"),
    )
    ranked = materialize(ranked, "ranked")
    discard(classes)
    return seen, ranked


def _ordered(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The suffixes whose first line is repeated, with ranks that no two suffixes share but equal ones; and, of each round,
    the suffixes that shared 1, 2, 4, ... lines with another, by (h1, h2)."""
    repeated = lines.groupBy("a", "b").agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c").withColumn("live", F.lit(True))
    marked = lines.join(repeated.hint("merge"), ["a", "b"], "left")
    rows = marked.select(*_ROW[:-4], F.array("a", "b").alias("key"), F.col("a").alias("h1"), F.col("b").alias("h2"), F.coalesce("live", F.lit(False)).alias("live"))
    step, final, levels, used = 1, None, [], []
    while True:
        seen, ranked = _round(rows, step)
        if not levels:
            levels.append(seen.filter("live").select(*_TEXT, "seq", "h1", "h2"))
        levels.append(ranked.filter("live").select(*_TEXT, "seq", "h1", "h2"))
        done = ranked.filter("not live").select(*_ROW[:-3])
        final = done if final is None else final.unionByName(done)
        if len(used) > 1:  # the first round's rows are a level
            discard(used.pop())
        used.append(seen)
        if levels[-1].isEmpty():
            return final, levels[:-1]
        rows = seen.filter("not live").select(*_ROW).unionByName(ranked)
        step *= 2


def _carried(rows: DataFrame, what: dict[str, Column], order: str = "at") -> DataFrame:
    """Per partition ``part`` of the array, what the partitions before it end with: a row a partition."""
    ends = rows.groupBy("part").agg(*[c.alias(name) for name, c in what.items()])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return ends.select("part", *[F.last(name, ignorenulls=True).over(before).alias(name) for name in what])


def _suffix_array(lines: DataFrame) -> DataFrame:
    final, levels = _ordered(lines)
    inorder = final.sort("key", "_d", *_TEXT, "seq").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    inorder = materialize(inorder, "suffix-array")

    # each beside the suffix before it
    own = F.struct(*_TEXT, "seq", "key", "pa")
    within = F.lag(own).over(W.partitionBy("part").orderBy("at"))
    ends = _carried(inorder, {"_end": F.max_by(own, "at")})
    beside = inorder.withColumn("_before", within).join(F.broadcast(ends), "part", "left").withColumn("_before", F.coalesce("_before", "_end"))
    beside = beside.withColumns({"pt": F.col("_before._t"), "pu": F.col("_before._u"), "pseq": F.col("_before.seq"), "pkey": F.col("_before.key")})
    differ = F.expr("array_position(transform(sequence(1, least(size(key), size(pkey))), i -> key[i - 1] = pkey[i - 1]), false)")
    alike = F.when(F.col("pkey").isNull(), 0).when(differ == 0, F.least(F.size("key"), F.size("pkey"))).otherwise(differ - 1)
    level = alike - 2  # the first two numbers name the line
    known = F.when(level < 0, 0).when(F.col("key") == F.col("pkey"), F.col("n") - F.col("seq") + 1).when(level == 0, 1)
    follows = (F.col("seq") > 1) & (F.col("pseq") > 1) & (F.col("pa") == F.col("_before.pa"))
    rows = beside.select(*_TEXT, "_d", "seq", "chars", "at", "part", "pt", "pu", "pseq", level.cast("int").alias("level"), known.alias("known"), F.coalesce(follows, F.lit(False)).alias("follows"))
    rows = materialize(rows, "neighbours")
    discard(inorder)

    # descent: lines in common by the largest powers of two first
    open_pairs = rows.filter("known is null and not follows").select(*_TEXT, "seq", "pt", "pu", "pseq", "level", F.expr("shiftleft(1, level)").alias("lcp"))
    for k in range(len(levels) - 2, -1, -1):
        mine = levels[k].select(F.col("_t").alias("_xt"), F.col("_u").alias("_xu"), F.col("seq").alias("_xs"), F.col("h1").alias("x1"), F.col("h2").alias("x2"))
        theirs = levels[k].select(F.col("_t").alias("_yt"), F.col("_u").alias("_yu"), F.col("seq").alias("_ys"), F.col("h1").alias("y1"), F.col("h2").alias("y2"))
        further = F.col("level") > k
        one = open_pairs.join(mine.hint("merge"), further & (F.col("_t") == F.col("_xt")) & (F.col("_u") == F.col("_xu")) & (F.col("seq") + F.col("lcp") == F.col("_xs")), "left")
        two = one.join(theirs.hint("merge"), F.col("x1").isNotNull() & (F.col("pt") == F.col("_yt")) & (F.col("pu") == F.col("_yu")) & (F.col("pseq") + F.col("lcp") == F.col("_ys")), "left")
        more = F.when((F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")), 1 << k).otherwise(0)
        last, open_pairs = open_pairs, materialize(two.select(*_TEXT, "seq", "pt", "pu", "pseq", "level", (F.col("lcp") + more).alias("lcp")), "descent")
        if k < len(levels) - 2:
            discard(last)
    found = open_pairs.select(*_TEXT, "seq", "lcp")
    told = rows.join(found.hint("merge"), [*_TEXT, "seq"], "left").withColumn("lcp", F.coalesce("known", "lcp"))
    # one line less than the suffix a line earlier
    anchor = F.last(F.when(F.col("lcp").isNotNull(), F.col("seq") + F.col("lcp")), ignorenulls=True).over(W.partitionBy(*_TEXT).orderBy("seq"))
    array = materialize(told.select(*_TEXT, "_d", "seq", "chars", "at", "part", (anchor - F.col("seq")).alias("lcp")), "suffix-array")
    for table in (rows, *levels):
        discard(table)
    return array


def suffix_array(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The suffixes whose first line is repeated, over all different texts: ``at`` goes up in the order of the array, and
    ``lcp`` is the number of lines that a suffix shares with the one before it.

    ``_t`` is a hash of the text, ``_d`` its least id, ``seq`` the line that the suffix starts with, from 1. Lines are in
    the order of their hashes, equal suffixes in that of their places.
    """
    lines = materialize(_lines(documents, id_col, text_col), "lines")
    array = _suffix_array(lines)
    discard(lines)
    return array


def _later(array: DataFrame, least: int) -> DataFrame:
    """The suffixes that share ``least`` lines or more with one of an earlier place: all of an interval but the first."""
    opens = F.when(F.col("lcp") < least, F.col("at"))
    since = F.last(opens, ignorenulls=True).over(W.partitionBy("part").orderBy("at"))
    ends = _carried(array, {"_open": F.max(opens)})
    intervals = array.withColumn("_own", since).join(F.broadcast(ends), "part", "left").withColumn("interval", F.coalesce("_own", "_open"))
    intervals = materialize(intervals.select(*_TEXT, "_d", "seq", "chars", "interval"), "intervals")
    firsts = intervals.groupBy("interval").agg(F.count("*").alias("_c"), F.min(_place()).alias("first")).filter("_c > 1").drop("_c")
    return intervals.join(firsts.hint("merge"), "interval").filter(F.col("first") != _place()).select(*_TEXT, "seq", "chars")


def deleted_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """(_d, _t, n_lines, gone, n_removed) of documents with a line that is not blank: the runs (from_seq, to_seq) to delete.

    ``_t`` is a hash of the text; ``gone`` and ``n_removed`` are null where no run goes.
    """
    if min_lines < 1:
        raise ValueError("min_lines is at least 1")
    lines = materialize(_lines(documents, id_col, text_col), "lines")
    array = _suffix_array(lines)
    long = F.lit(min_lines == 1) | (F.col("chars") >= min_chars)
    starts = _later(array, 1).filter(long).select(*_TEXT, F.lit(False).alias("copy"), "seq", F.col("seq").alias("end"))
    if min_lines > 1:
        starts = starts.unionByName(_later(array, min_lines).select(*_TEXT, F.lit(False).alias("copy"), "seq", (F.col("seq") + min_lines - 1).alias("end")))
    # in a copy, whole: all lines, or the long ones of a text too short for a run
    of_copies = lines.filter("_copied").filter(F.when(F.col("n") >= min_lines, F.col("seq") == 1).otherwise(long))
    starts = starts.unionByName(of_copies.select(*_TEXT, F.lit(True).alias("copy"), "seq", F.when(F.col("n") >= min_lines, F.col("n")).otherwise(F.col("seq")).alias("end")))
    # runs of places that touch or overlap become one
    doc = W.partitionBy(*_TEXT, "copy").orderBy("seq")
    reach = F.max("end").over(doc.rowsBetween(W.unboundedPreceding, -1))
    numbered = starts.withColumn("run", F.sum(F.when(F.col("seq") <= reach + 1, 0).otherwise(1)).over(doc.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.groupBy(*_TEXT, "copy", "run").agg(F.min("seq").alias("from_seq"), F.max("end").alias("to_seq"))
    listed = F.array_sort(F.collect_list(F.struct("from_seq", "to_seq"))).alias("gone"), F.sum(F.col("to_seq") - F.col("from_seq") + 1).alias("n_removed")
    gone = runs.groupBy(*_TEXT, "copy").agg(*listed)
    of_text = lambda copy: F.max(F.when(F.col("copy") == copy, F.struct("gone", "n_removed")))
    both = gone.groupBy(*_TEXT).agg(of_text(False).alias("of_first"), of_text(True).alias("of_copy"))
    counts = lines.filter("seq = 1").select(*_TEXT, F.struct(F.col("_d").alias("id")).alias("least"), F.col("n").cast("long").alias("n_lines"))
    info = materialize(counts.join(both.hint("merge"), _TEXT, "left"), "line-runs")
    names = documents.select(F.col(f"`{id_col}`").alias("_d"), F.xxhash64(text_col).alias("_t"), F.xxhash64(F.lit(_SALT), text_col).alias("_u")).distinct()
    told = names.join(info.hint("merge"), _TEXT).withColumn("_of", F.when(F.struct(F.col("_d").alias("id")) == F.col("least"), F.col("of_first")).otherwise(F.col("of_copy")))
    out = materialize(told.select("_d", "_t", "n_lines", F.col("_of.gone").alias("gone"), F.col("_of.n_removed").alias("n_removed")), "deleted-lines")
    for table in (lines, array, info):
        discard(table)
    return out


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """``documents`` with the later copies of repeated line runs deleted from ``text_col``.

    Two columns are added: ``n_lines`` (lines that are not blank) and ``n_removed``, in the place of any so named. Order
    of rows is not kept.
    """
    info = deleted_lines(documents, id_col, text_col, min_lines, min_chars)
    keyed = packed(documents, _d=F.col(f"`{id_col}`"), _t=F.xxhash64(text_col), _text=F.col(f"`{text_col}`"))
    shown = _join_equal_left(keyed, info).withColumn("_lines", F.when(F.col("gone").isNotNull(), F.split("_text", "\n", -1)))
    # positions (from 0) of lines that are not blank, by which places in the sequence become positions
    full = F.expr("filter(transform(_lines, (x, i) -> if(length(trim(x)) > 0, i, -1)), i -> i >= 0)")
    spans = F.expr("transform(gone, r -> struct(_full[r.from_seq - 1] as s, _full[r.to_seq - 1] as e))")
    kept = F.expr(
        "flatten(transform(sequence(0, size(_spans)), k -> slice(_lines,"
        " if(k = 0, 1, _spans[k - 1].e + 2),"
        " if(k = size(_spans), size(_lines), _spans[k].s) - if(k = 0, 0, _spans[k - 1].e + 1))))"
    )
    out = shown.withColumn("_full", full).withColumn("_spans", spans)
    text = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    # (counts come from the joined table: a filter on them costs nothing where the text would be put together again)
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_lines", "n_removed")}
    return unpacked(out, documents.columns, {text_col: text}, counts)


def _join_equal_left(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.withColumnsRenamed({"_d": "_gd", "_t": "_gt"})
    return keyed.join(g.hint("merge"), keyed["_d"].eqNullSafe(g["_gd"]) & (keyed["_t"] == g["_gt"]), "left").drop("_gd", "_gt")
