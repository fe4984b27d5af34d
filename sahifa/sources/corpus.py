"""Corpora of JSON lines and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from sahifa.functions import text as X

# Schemas of the dataset rows.
SCHEMAS = {
    "tashkeel": "text string, split string",
    "tashkeel_pos": "text string, tags array<string>, split string",
    "pos": "tokens array<string>, tags array<string>, split string",
    "indexing": "text string, sanad_end int, kind string, split string",
    "text": "text string",
}


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = "text string", limit: int | None = None) -> DataFrame:
    """One row per line with an explicit schema and no inference; ``limit`` (0 and None mean all) takes the first lines in file order.

    Malformed lines fail the read.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not limit:
        return df
    ordered = df.select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_o"))
    return ordered.orderBy("_f", "_o").limit(limit).drop("_f", "_o")


def iter_texts(spark: SparkSession, path: str, record: str = "line") -> DataFrame:
    """``(ord, text)`` of a file or a folder: all ``*.txt`` by name, then all ``*.jsonl`` by name.

    ``record`` says what a text file holds: one record a ``line``, in paragraphs (``blank-line``)
    or the whole ``file``. Blank records are left out; lines and paragraphs are stripped, files
    and JSON texts are not. ``ord`` orders the records and is dense only within a file.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    parts = []
    if folder or not path.endswith(".jsonl"):
        reader = spark.read
        if folder:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
        parts.append(_text_records(_or_empty(spark, reader, path, True), record))
    if folder or path.endswith(".jsonl"):
        reader = spark.read
        if folder:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
        parts.append(_json_records(_or_empty(spark, reader, path, False)))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.select("ord", "text")


def _or_empty(spark: SparkSession, reader, path: str, whole: bool) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException:  # a folder without such files
        return spark.createDataFrame([], "value string, file string")


def _text_records(files: DataFrame, record: str) -> DataFrame:
    raw = files.select("file", F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    if record == "file":
        rows = raw.select("file", F.lit(0).alias("at"), F.col("value").alias("text"))
    elif record == "blank-line":
        rows = raw.select("file", F.posexplode(F.split("value", r"\n\s*\n", -1)).alias("at", "text")).withColumn("text", X.strip(F.col("text")))
    elif record == "line":
        breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
        rows = raw.select("file", F.posexplode(F.split("value", breaks, -1)).alias("at", "text")).withColumn("text", X.strip(F.col("text")))
    else:
        raise ValueError(f"unknown record kind '{record}'")
    return rows.where(~X.is_blank(F.col("text"))).select(F.struct(F.lit(0).alias("kind"), "file", F.col("at").cast("long").alias("at")).alias("ord"), "text")


def _json_records(lines: DataFrame) -> DataFrame:
    at = F.monotonically_increasing_id()  # order within a file; files are read in order of their splits
    rows = lines.select("file", at.alias("at"), F.get_json_object("value", "$.text").alias("text"))
    return rows.where(~X.is_blank(F.col("text"))).select(F.struct(F.lit(1).alias("kind"), "file", "at").alias("ord"), "text")


def acceptable_pastes(df: DataFrame, text: str, max_chars: int = 200_000) -> DataFrame:
    """``df`` without the texts an interactive request refuses: those of more than ``max_chars`` characters."""
    return df.where(F.length(F.coalesce(F.col(text), F.lit(""))) <= max_chars)


def pasted_units(df: DataFrame, key: str, text: str, max_units: int | None = 2000, max_chars: int | None = 4000) -> DataFrame:
    """``(key, n, source, truncated)``: one unit per line of a pasted text, blank lines kept, ``n`` from 1.

    The work caps of an interactive request are parameters; None lifts them.
    """
    lines = df.select(key, F.posexplode(X.lines_of(F.col(text))).alias("i", "line"), F.size(X.lines_of(F.col(text))).alias("all"))
    cut = F.lit(False) if max_chars is None else F.length("line") > max_chars
    over = F.lit(False) if max_units is None else F.col("all") > max_units
    rows = lines.select(key, (F.col("i") + 1).alias("n"), (F.col("line") if max_chars is None else F.substring("line", 1, max_chars)).alias("source"), (cut | over).alias("truncated"))
    return rows if max_units is None else rows.where(F.col("n") <= max_units)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by an explicit order (a preview or a target, so the limit is the feature)."""
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, text: str, n: int, seed: int = 13) -> DataFrame:
    """``n`` rows in a seeded order that depends on the text alone; ties are equal texts."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(text)))).limit(n)


def ordinal_rows(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
