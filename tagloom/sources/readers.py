"""Readers. Line numbers come from splits of text files and places in them, or from the rows of a Parquet file.

JSON lines are parsed from text, so that malformed lines can be told from missing keys and nothing is lost unseen.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions.metadata import file_name, file_stem
from tagloom.functions.text import SPACE
from tagloom.operators.filters import first_reason, missing_keys, split_by_reason

MANIFEST = (
    "audio_filepath string, text string, duration string, offset double, lang string, lang_family string, source string, split string, predicted_text string, "
    "entities array<struct<type:string,text:string>>, speaker_changes array<double>"
)
#: Folders and file endings that hold no manifests.
SKIPPED = ("/audio/", ".bak", ".progress", ".pre_annotate", "dataset_info.json")


def lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(source_file, line_no, value) of every line, numbered from 1. Files are read in splits of any size.

    A split's rows have consecutive row ids; a line's number is its place in the split and the lines of the splits
    before it in the file: one row a split is counted and joined back, the lines themselves are not shuffled.
    """
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    splits = rows.groupBy("source_file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("source_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    based = splits.select("source_file", "_at", (before - F.col("_first") + 1).alias("_base"))
    # (broadcast only if it is small: Spark knows its size by then)
    return rows.join(based, ["source_file", "_at"]).select("source_file", (F.col("_id") + F.col("_base")).cast("long").alias("line_no"), "value")


def manifest(spark: SparkSession, paths: str | list[str], schema: str = MANIFEST, required: tuple[str, ...] = ("audio_filepath",), **options) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): tolerant reading. Quarantined: malformed lines and lines without a required key, with the reason.

    Rows keep other keys as JSON in ``extra``.
    """
    read = lines(spark, paths, **options).filter(F.btrim("value") != "").withColumn("reason", missing_keys(F.col("value"), list(required)))
    good, bad = split_by_reason(read)
    parsed = good.withColumn("_j", F.from_json("value", schema))
    return parsed.select("source_file", "line_no", "_j.*", F.col("value").alias("extra")), bad.select("source_file", "line_no", "reason", F.col("value").alias("raw"))


def strict_manifest(spark: SparkSession, paths: str | list[str], lang_field: str = "lang", schema: str = MANIFEST, **options) -> DataFrame:
    """As ``manifest``, but any quarantined line, or a row without a language, fails the job; languages upper-cased."""
    read = lines(spark, paths, **options).filter(F.btrim("value") != "").withColumn("reason", missing_keys(F.col("value"), ["audio_filepath"]))
    at = F.concat(F.col("source_file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "))
    checked = read.withColumn("value", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(at, F.col("reason")))).otherwise(F.col("value")))
    parsed = checked.withColumn("_j", F.from_json("value", schema))
    found = F.coalesce(F.nullif(F.get_json_object("value", f"$.{lang_field}"), F.lit("")), F.nullif(F.get_json_object("value", "$.lang"), F.lit("")))
    lang = F.when(found.isNull(), F.raise_error(F.concat(at, F.lit("missing language")))).otherwise(F.upper(found))
    return parsed.select("source_file", "line_no", "_j.*", lang.alias("_lang"), F.col("value").alias("extra")).drop("lang").withColumnRenamed("_lang", "lang")


def lenient_manifest(spark: SparkSession, paths: str | list[str], schema: str = MANIFEST, **options) -> DataFrame:
    """Blank and malformed lines are passed over."""
    return manifest(spark, paths, schema, (), **options)[0]


def discovered(spark: SparkSession, root: str, names: tuple[str, ...] = (), ending: str = ".json") -> list[str]:
    """Manifest files below a folder, sorted; with ``names`` only files of these names. A listing on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        file = found.next().getPath()
        text, name = file.toString(), file.getName()
        if any(s in text if s.startswith("/") else name.endswith(s) for s in SKIPPED):
            continue
        if name in names if names else name.endswith(ending) or name.endswith(ending + "l"):
            out.append(text)
    return sorted(out)


def dataset_of(path, root: str):
    """The first folder of a path below a root."""
    return F.substring_index(F.ltrim(F.substring(F.substring_index(path, root.rstrip("/"), -1), 1, 1 << 20), F.lit("/")), "/", 1)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that is there."""
    for c in candidates:
        path = spark._jvm.org.apache.hadoop.fs.Path(c)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return c
    return None


def split_file(spark: SparkSession, folder: str, split: str, ending: str = ".json") -> str | None:
    """The file of a split under any of its names."""
    names = {"valid": ["valid", "validation", "val"]}.get(split, [split])
    return first_existing(spark, [f"{folder.rstrip('/')}/{n}{ending}" for n in names])


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One file with an array of records."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A root of records by key, or a list of them: (key, record columns)."""
    whole = spark.read.text(path, wholetext=True)
    as_map, as_list = F.from_json("value", f"map<string,struct<{record}>>"), F.from_json("value", f"array<struct<{record}>>")
    of_list = F.transform(as_list, lambda r, i: F.struct(i.cast("string").alias("key"), r.alias("record")))
    of_map = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("record")))
    rows = whole.select(F.explode(F.when(F.col("value").rlike("^\\s*\\["), of_list).otherwise(of_map)).alias("x"))
    return rows.select("x.key", "x.record.*")


def by_extension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """json (array), jsonl or csv with a header."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    if path.endswith(".json"):
        return json_array(spark, path, schema)
    if path.endswith(".csv"):
        return spark.read.option("header", True).schema(schema).csv(path)
    raise ValueError(f"no reader for {path}")


def tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tab-separated; quotes mean nothing."""
    return spark.read.option("sep", "\t").option("quote", "").option("header", header).schema(schema).csv(path)


def piped(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Pipe-separated strings without a header; an embedded one (its first field is the first name) goes. Empty stays empty."""
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.option("sep", "|").option("quote", "").option("emptyValue", "").option("nullValue", "\u0000").schema(schema).csv(path)
    return rows.na.fill("").filter(F.col(names[0]) != names[0])


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """(ytid, start, end, labels): comments and the first three lines passed over, fields apart by ", ", labels quoted."""
    rows = lines(spark, path).filter((F.col("line_no") > 3) & ~F.startswith("value", F.lit("#")) & (F.btrim("value") != ""))
    fields = rows.withColumn("_f", F.split("value", ", ", 4)).filter(F.size("_f") == 4)
    labels = F.split(F.btrim(F.get("_f", F.lit(3)), F.lit('" ')), ",")
    return fields.select(F.get("_f", F.lit(0)).alias("ytid"), F.get("_f", F.lit(1)).try_cast("double").alias("start"), F.get("_f", F.lit(2)).try_cast("double").alias("end"), F.transform(labels, F.btrim).alias("labels"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a JSON array of classes."""
    return json_array(spark, path, "id string, name string")


def transcripts(spark: SparkSession, path: str, **options) -> DataFrame:
    """(utterance, text) of "utterance text ..." lines; white space of the text squeezed."""
    rows = lines(spark, path, **options).filter(F.btrim("value") != "")
    cut = F.split(F.btrim("value"), f"{SPACE}+", 2)
    return rows.select("source_file", "line_no", F.get(cut, F.lit(0)).alias("utterance"), F.coalesce(F.regexp_replace(F.get(cut, F.lit(1)), f"{SPACE}+", " "), F.lit("")).alias("text"))


def word_timings(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, channel, start, duration, token) of white-space-separated timing lines."""
    cut = F.split(F.btrim("value"), "\\s+")
    rows = lines(spark, path, **options).filter(F.size(cut) >= 5)
    return rows.select("source_file", "line_no", F.get(cut, F.lit(0)).alias("file"), F.get(cut, F.lit(1)).alias("channel"), F.get(cut, F.lit(2)).try_cast("double").alias("start"), F.get(cut, F.lit(3)).try_cast("double").alias("duration"), F.get(cut, F.lit(4)).alias("token"))


def three_fields(spark: SparkSession, path: str, names: tuple[str, str, str] = ("utterance", "label", "text")) -> DataFrame:
    """Three fields a line, by tabs, else by white space; fewer fail the job."""
    by_tab, by_space = F.split("value", "\\t", 3), F.split(F.btrim("value"), "\\s+", 3)
    cut = F.when(F.size(by_tab) == 3, by_tab).when(F.size(by_space) == 3, by_space).otherwise(F.raise_error(F.concat(F.lit("fewer than three fields in line "), F.col("line_no").cast("string"))).cast("array<string>"))
    return lines(spark, path).filter(F.btrim("value") != "").withColumn("_f", cut).select(*[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def audio_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of speech rows with (source_file, row_index); nested bytes only as far as they are selected."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("row_index"))


def resolved(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidate columns that a frame has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"none of {candidates} among {df.columns}")


def decoded_text(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text): UTF-8, else ISO-8859-1, which every byte is valid in."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("source_file"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def audio_files(spark: SparkSession, root: str, endings: tuple[str, ...] = ("wav", "flac", "mp3", "m4a", "ogg")) -> DataFrame:
    """(path, name, stem, length) of audio files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(root)
    return found.select("path", file_name(F.col("path")).alias("name"), file_stem(F.col("path")).alias("stem"), "length")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, text) of text, source and HTML files below a folder; mark-up and scripts are taken out of HTML."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,py,html,htm}").text(root, wholetext=True)
    kind = F.lower(F.substring_index("path", ".", -1))
    return raw.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("kind", kind).select("path", "kind", F.when(F.col("kind").isin("html", "htm"), html_text(F.col("value"))).otherwise(F.col("value")).alias("text"))


def html_text(html):
    """Visible text: scripts, styles, comments and tags out, the commonest entities resolved, blanks squeezed."""
    out = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.btrim(F.regexp_replace(out, "\\s+", " "))


def chunked_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A row a chunk of documents with ``verbatim`` chunks and attributes of the whole."""
    schema = "state string, gender string, age_group string, task_name string, verbatim array<struct<start:double,end:double,text:string>>"
    whole = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("source_file", F.col("_metadata.file_path"))
    return whole.select("source_file", "state", "gender", "age_group", "task_name", F.posexplode("verbatim").alias("chunk", "_v")).select("*", "_v.start", "_v.end", "_v.text").drop("_v")


def predictions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Prediction rows in file order; the first ``limit`` if given."""
    rows = lenient_manifest(spark, path)
    return rows.orderBy("source_file", "line_no").limit(limit) if limit is not None else rows


def load_families(spark: SparkSession, path: str) -> dict:
    """The metadata that ``write_families`` wrote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
