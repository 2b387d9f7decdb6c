"""Scores of predicted against reference manifests. Pairs are matched by key, never by position.

``zero`` says what a rate over nothing is: "null", "inf", "zero" or "one" (the denominator counts as one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tags
from tagloom.functions.edit import word_errors
from tagloom.functions.text import words


def rate(top: Column, bottom: Column, zero: str = "null") -> Column:
    if zero == "one":
        return top / F.greatest(bottom, F.lit(1))
    empty = {"null": F.lit(None).cast("double"), "inf": F.lit(float("inf")), "zero": F.lit(0.0)}[zero]
    return F.when(bottom == 0, empty).otherwise(top / F.when(bottom == 0, 1).otherwise(bottom))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / F.when(precision + recall > 0, precision + recall).otherwise(1)).otherwise(0.0)


def edit_table(df: DataFrame, hypothesis: Column, reference: Column, characters: bool = False) -> DataFrame:
    """The rows with errors, words, insertions, deletions, substitutions."""
    return df.withColumn("_e", word_errors(hypothesis, reference, characters)).select(*df.columns, "_e.*")


def error_rate(df: DataFrame, hypothesis: Column, reference: Column, by: list[str] = (), characters: bool = False, zero: str = "inf") -> DataFrame:
    """Summed errors over summed words, with the rates of their kinds."""
    table = edit_table(df, hypothesis, reference, characters)
    sums = table.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("errors", "words", "insertions", "deletions", "substitutions")])
    return sums.select(*by, "errors", "words", rate(F.col("errors"), F.col("words"), zero).alias("wer"), *[rate(F.col(c), F.col("words"), zero).alias(f"{c[:3]}_rate") for c in ("insertions", "deletions", "substitutions")])


def mean_error_rate(df: DataFrame, hypothesis: Column, reference: Column) -> DataFrame:
    """The mean of the rates of the rows; two empty texts have none, one empty reference as many as the hypothesis has words."""
    table = edit_table(df, hypothesis, reference)
    each = F.when(F.col("words") > 0, F.col("errors") / F.when(F.col("words") > 0, F.col("words")).otherwise(1)).otherwise(F.col("errors").cast("double"))
    return table.agg(F.count("*").alias("n"), F.avg(each).alias("mean_wer"))


def family_error_rate(df: DataFrame, hypothesis: Column, reference: Column, family: str) -> DataFrame:
    """A row a family, and one for all (family null, ``everything`` 1)."""
    table = edit_table(df, hypothesis, reference)
    return table.rollup(family).agg(F.grouping(family).cast("int").alias("everything"), F.sum("errors").alias("errors"), F.sum("words").alias("words")).withColumn("wer", rate(F.col("errors"), F.col("words"), "inf"))


def labelled_error_rate(df: DataFrame, hypothesis: Column, reference: Column) -> DataFrame:
    """Rates with and without <N0> labels, and how often the label of a labelled reference is right. Sums only: mergeable."""
    h, r = tags.noise_label(hypothesis), tags.noise_label(reference)
    both = df.select(word_errors(hypothesis, reference).alias("l"), word_errors(h["clean"], r["clean"]).alias("u"), h["label"].alias("hl"), r["label"].alias("rl"))
    sums = both.agg(
        F.sum("l.errors").alias("le"), F.sum("l.words").alias("lw"), F.sum("u.errors").alias("ue"), F.sum("u.words").alias("uw"),
        F.count_if(F.col("rl").isNotNull() & (F.col("hl") == F.col("rl"))).alias("hit"), F.count("rl").alias("labels"),
    )
    return sums.select(rate(F.col("le"), F.col("lw"), "one").alias("labelled_wer"), rate(F.col("ue"), F.col("uw"), "one").alias("unlabelled_wer"), rate(F.col("hit"), F.col("labels"), "zero").alias("label_accuracy"))


def tag_set_scores(df: DataFrame, hypothesis: Column, reference: Column) -> DataFrame:
    """WER without tags (each row counts a word at least), and micro precision, recall and F1 of tag sets."""
    is_tag = tags.is_tag_prefix
    plain = lambda c: F.array_join(F.filter(words(c), lambda w: ~is_tag(w)), " ")
    labels = lambda c: F.array_distinct(F.filter(words(c), is_tag))
    rows = df.select(word_errors(plain(hypothesis), plain(reference)).alias("e"), labels(hypothesis).alias("h"), labels(reference).alias("r"))
    sums = rows.agg(
        F.sum("e.errors").alias("errors"), F.sum(F.greatest("e.words", F.lit(1))).alias("words"), F.sum(F.size(F.array_intersect("h", "r"))).alias("tp"),
        F.sum(F.size(F.array_except("h", "r"))).alias("fp"), F.sum(F.size(F.array_except("r", "h"))).alias("fn"),
    )
    scored = sums.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp"), "one"), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn"), "one")})
    return scored.select((F.col("errors") / F.col("words")).alias("wer"), "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def span_scores(df: DataFrame, key: str, hypothesis: Column, reference: Column, phrases: bool = True, policy: str = "strict") -> DataFrame:
    """(label, tp, gt, pred, precision, recall, fscore) of entity spans, and rows overall_micro and overall_macro.

    Spans agree in utterance, label, phrase (with ``phrases``) and ordinal. Utterances without spans count as such.
    """

    def exploded(text: Column, side: str) -> DataFrame:
        rows = df.select(key, F.explode(tags.spans(text, policy)).alias("s")).select(key, "s.label", (F.col("s.phrase") if phrases else F.lit("phrase")).alias("phrase"), "s.ordinal")
        if not phrases:
            rows = rows.groupBy(key, "label", "phrase").agg(F.count("*").cast("int").alias("_n")).select(key, "label", "phrase", F.explode(F.sequence(F.lit(1), "_n")).alias("ordinal"))
        return rows.distinct().withColumn(side, F.lit(1))

    # one grouping of both sides: a span that both have counts for both
    both = exploded(reference, "g").unionByName(exploded(hypothesis, "p"), allowMissingColumns=True)
    matched = both.groupBy(key, "label", "phrase", "ordinal").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    each = matched.groupBy("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("g").alias("gt"), F.count("p").alias("pred"))

    def scored(rows: DataFrame) -> DataFrame:
        with_rates = rows.withColumns({"precision": rate(F.col("tp"), F.col("pred"), "zero"), "recall": rate(F.col("tp"), F.col("gt"), "zero")})
        return with_rates.withColumn("fscore", f1(F.col("precision"), F.col("recall")))

    labels = scored(each)
    micro = scored(each.agg(F.lit("overall_micro").alias("label"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "gt", "pred")]))
    macro = labels.agg(F.lit("overall_macro").alias("label"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "gt", "pred")], *[F.avg(c).alias(c) for c in ("precision", "recall", "fscore")])
    return labels.unionByName(micro).unionByName(macro)


def confusion(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """(reference, predicted, n) over the square of all labels; pairs with a null side are passed over."""
    pairs = df.filter(F.col(reference).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(reference).alias("reference"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    labels = pairs.select(F.explode(F.array("reference", "predicted")).alias("label")).distinct()
    # the labels of a task: a small set by nature, gathered in one row and unfolded
    square = labels.agg(F.array_sort(F.collect_set("label")).alias("all")).select(F.explode("all").alias("reference"), "all").select("reference", F.explode("all").alias("predicted"))
    return square.join(pairs, ["reference", "predicted"], "left").select("reference", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each class, and rows accuracy, macro, weighted (in f1), with the coverage."""
    whole = df.agg(F.count("*").alias("_all"))
    pairs = df.filter(F.col(reference).isNotNull() & F.col(predicted).isNotNull()).select(F.col(reference).alias("r"), F.col(predicted).alias("p"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("r").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("q"), (F.col("r") == F.col("p")).cast("int").alias("t")), F.struct(F.col("p").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("q"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(F.sum("g").alias("support"), F.sum("q").alias("_q"), F.sum("t").alias("_t"))
    rates = sums.withColumns({"precision": rate(F.col("_t"), F.col("_q"), "zero"), "recall": rate(F.col("_t"), F.col("support"), "zero")})
    each = rates.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    n = F.sum("support")
    summary = each.agg(n.alias("support"), rate(F.sum("_t"), n, "null").alias("accuracy"), F.avg("f1").alias("macro"), rate(F.sum(F.col("f1") * F.col("support")), n, "null").alias("weighted"))
    rows = summary.select("support", F.explode(F.map_from_arrays(F.array(*map(F.lit, ["accuracy", "macro", "weighted"])), F.array("accuracy", "macro", "weighted"))).alias("label", "f1"))
    rows = rows.crossJoin(F.broadcast(whole)).select("label", "support", F.lit(None).cast("double").alias("precision"), rate(F.col("support"), F.col("_all"), "null").alias("recall"), "f1")
    return each.select("label", "support", "precision", "recall", "f1").unionByName(rows.withColumn("recall", F.when(F.col("label") == "accuracy", F.col("recall"))))


def agreement(df: DataFrame, columns: list[str]) -> DataFrame:
    """(one, two, n, agree, share) of every two of the columns, over rows that have both."""
    structs = [F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("known"), F.col(a).eqNullSafe(F.col(b)).alias("same")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.select(F.explode(F.array(*structs)).alias("x")).select("x.*").filter("known")
    return rows.groupBy("one", "two").agg(F.count("*").alias("n"), F.count_if("same").alias("agree")).withColumn("share", F.col("agree") / F.col("n"))


def collapse_repeats(ids: Column, blank: int) -> Column:
    """Greedy decoding of frame labels: repeats in a row once, blanks away."""
    kept = F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.try_element_at(ids, F.when(i > 0, i).otherwise(1)))))
    return kept


def quick_check(df: DataFrame, hypothesis: Column, reference: Column, duration: str, low: float, high: float, n: int, order: str) -> DataFrame:
    """(clean_wer, tagged_wer, rows) of the first ``n`` rows in a band of durations: without tags, and with them as words."""
    rows = df.filter((F.col(duration) >= low) & (F.col(duration) <= high)).orderBy(order).limit(n)
    both = rows.select(word_errors(tags.strip_tags(hypothesis), tags.strip_tags(reference)).alias("c"), word_errors(hypothesis, reference).alias("t"))
    sums = both.agg(F.count("*").alias("rows"), *[F.sum(f"{s}.{f}").alias(f"{s}_{f}") for s in "ct" for f in ("errors", "words")])
    return sums.select(rate(F.col("c_errors"), F.col("c_words"), "inf").alias("clean_wer"), rate(F.col("t_errors"), F.col("t_words"), "inf").alias("tagged_wer"), "rows")
