"""Exports: text, CSV shapes, Markdown, spans, datasets, and parameter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sahifa.functions import labels as L, text as X


def as_text(units: DataFrame, by: list[str], n: str, output: str) -> DataFrame:
    """``(by, body)``: outputs joined by line feeds in the order of ``n`` (one document at a time)."""
    parts = F.array_sort(F.collect_list(F.struct(n, F.coalesce(F.col(output), F.lit("")).alias("o"))))
    return units.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["o"]), "\n").alias("body"))


def table_export(table: DataFrame, columns: list[str], outputs: DataFrame, task: str) -> DataFrame:
    """The user's own columns and one more with the result, every cell safe; rows meet by their ordinal ``n``."""
    joined = table.join(outputs.select("n", F.col("output").alias("_out")), "n")
    cells = [X.csv_safe(F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(name) for i, name in enumerate(columns)]
    return joined.orderBy("n").select(*cells, X.csv_safe(F.coalesce("_out", F.lit(""))).alias(task))


def pos_export(units: DataFrame, lang: str = L.DEFAULT_LANGUAGE, by: tuple[str, ...] = ()) -> DataFrame:
    """``(line, i, word, tag, tag_code)``: one row per word of ``(n, pairs: array<struct<word, code>>)``."""
    rows = units.select(*by, F.col("n").alias("line"), F.posexplode("pairs").alias("i", "p"))
    return rows.select(*by, "line", "i", X.csv_safe(F.col("p.word")).alias("word"), X.csv_safe(L.name("pos", F.col("p.code"), lang)).alias("tag"), X.csv_safe(F.col("p.code")).alias("tag_code"))


def structure_export(units: DataFrame, lang: str = L.DEFAULT_LANGUAGE, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per narrator, its segment repeated; segments without narrators have one row with empty narrator cells.

    ``units`` has ``(n, pairs: array<struct<code, text>>, narrators: array<struct<seg, n, verb, name>>)``.
    """
    rows = units.select(*by, F.col("n").alias("line"), "narrators", F.posexplode("pairs").alias("seg", "p"))
    chain = F.filter("narrators", lambda h: h["seg"] == F.col("seg"))
    rows = rows.select(*by, "line", "seg", "p", F.explode_outer(chain).alias("h"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        *by, "line", "seg", X.csv_safe(F.col("p.text")).alias("segment"), X.csv_safe(L.name("structure", F.col("p.code"), lang)).alias("label"), X.csv_safe(F.col("p.code")).alias("tag_code"),
        blank(F.col("h.n").cast("string")).alias("narrator_n"), blank(X.csv_safe(F.col("h.verb"))).alias("narrator_verb"), blank(X.csv_safe(F.col("h.name"))).alias("narrator_name"),
    )


def plain_export(units: DataFrame, n: str, source: str, output: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(line, input, output)`` without blank units."""
    kept = units.where(~X.is_blank(F.col(source)))
    return kept.select(*by, F.col(n).alias("line"), X.csv_safe(F.col(source)).alias("input"), X.csv_safe(F.coalesce(F.col(output), F.lit(""))).alias("output"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with CRLF line ends; every part starts with a byte-order mark through its first header cell."""
    marked = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    marked.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown_row(cells: list[Column]) -> Column:
    inner = [F.concat(X.markdown_cell(c), F.lit(" |")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" ", *inner))


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(markdown_row([F.col(c) for c in columns]).alias("row"))


def markdown_document(units: DataFrame, by: list[str], n: str, output: str, title: str, meta: dict[str, str]) -> DataFrame:
    """``(by, body)``: a title, a list of facts and one paragraph per unit (an empty one for blank units)."""
    head = "\n".join([f"# {title}", "", *(f"- **{k}:** {v}" for k, v in meta.items()), "", "---", "", ""])
    shown = F.when(X.is_blank(F.col(output)), "").otherwise(F.col(output))
    parts = F.array_sort(F.collect_list(F.struct(n, shown.alias("o"))))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["o"], F.lit("\n"))), "\n")
    return units.groupBy(*by).agg(F.concat(F.lit(head), text).alias("body"))


def spans_json(df: DataFrame, file: str, spans: str, usable: Column) -> DataFrame:
    """``payload``: ``{"file", "usable", "spans": [[start, end, label], ...]}`` of each row."""
    items = F.transform(spans, lambda s: F.concat(F.lit("["), s["start"].cast("string"), F.lit(","), s["end"].cast("string"), F.lit(',"'), s["label"], F.lit('"]')))
    head = F.to_json(F.struct(F.col(file).alias("file"), usable.alias("usable")))
    return df.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"spans":['), F.array_join(items, ","), F.lit("]}")).alias("payload"))


def write_dataset(df: DataFrame, path: str) -> DataFrame:
    """JSON lines partitioned by nothing, so that rows of all splits stay together; returns the counts per split."""
    df.write.json(path)
    return df.groupBy("split").agg(F.count("*").alias("n"))


def save_parameters(tables: dict[str, DataFrame], path: str, **metadata: str) -> None:
    """Model parameters as Parquet tables beside a row of metadata; never pickled."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(k, str(v)) for k, v in metadata.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_parameters(spark, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in (*names, "metadata")}


def parameters_info(spark, path: str, *names: str) -> DataFrame:
    """``(item, value)``: the metadata of saved parameters and the number of rows of each table."""
    tables = load_parameters(spark, path, *names)
    out = tables["metadata"].select(F.col("key").alias("item"), "value")
    for name in names:
        out = out.unionByName(tables[name].agg(F.count("*").cast("string").alias("value")).select(F.lit(f"{name} rows").alias("item"), "value"))
    return out.orderBy("item")


def file_name(stem: str, task: str, kind: str) -> str:
    """Name of an export: its source, its task and its format."""
    if kind not in ("txt", "csv", "md"):
        raise ValueError(f"unknown format '{kind}'")
    return f"{stem}-{task}.{kind}"
