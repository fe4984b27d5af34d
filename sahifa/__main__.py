"""Command line: ``spark-submit sahifa/__main__.py`` or ``python -m sahifa``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from sahifa.plans import pipelines, queries
from sahifa.session import ship_package
from sahifa.sources import corpus, exporters


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    texts = corpus.iter_texts(spark, args.input, args.record)
    rows = texts.select(F.xxhash64("ord").alias("id"), "ord", "text")
    if args.task == "tashkeel":
        windows = pipelines.vocalized_windows(rows, "ord", "text")
        built = (windows.orderBy("ord", "at").limit(args.target) if args.target else windows).select("text", "split")
    else:
        titles = corpus.iter_texts(spark, args.headings, "line").select("text") if args.headings else None
        built = pipelines.build_indexing(rows, "id", "text", titles, args.target)
    exporters.write_dataset(built, args.output).show()


def _query(spark: SparkSession, args: argparse.Namespace) -> None:
    queries.queries()[args.name](spark, args.data).write.mode("overwrite").parquet(args.output)


def _spans(spark: SparkSession, args: argparse.Namespace) -> None:
    from sahifa.functions import tokens as K
    from sahifa.operators import chain, runs

    files = spark.read.text(args.input, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    toks = chain.parse_chains(files, "text").withColumn("t", K.tokens(F.col("text")))
    spans = toks.select("file", runs.spans(F.col("t"), pipelines.rule_labels(F.col("t"), F.col("sanad_end_raw"))).alias("spans"))
    exporters.spans_json(spans, "file", "spans", runs.usable(F.col("spans"))).write.mode("overwrite").text(args.output)


def _infer(spark: SparkSession, args: argparse.Namespace) -> None:
    files = spark.read.text(args.input, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    lexicon = exporters.load_parameters(spark, args.parameters, "lexicon")["lexicon"] if args.parameters else None
    pipelines.infer_lines(files, "file", "text", args.task, args.lang, lexicon).write.mode("overwrite").json(args.output)


def _annotate(spark: SparkSession, args: argparse.Namespace) -> None:
    lexicon = exporters.load_parameters(spark, args.parameters, "lexicon")["lexicon"]
    pipelines.annotate_files(spark, args.input, lexicon, args.full).write.mode("overwrite").json(args.output)


def _info(spark: SparkSession, args: argparse.Namespace) -> None:
    exporters.parameters_info(spark, args.parameters, *args.tables).show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sahifa", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build a dataset from a corpus")
    build.add_argument("--task", choices=["tashkeel", "indexing"], required=True)
    build.add_argument("--input", required=True)
    build.add_argument("--record", choices=["line", "blank-line", "file"], default="line")
    build.add_argument("--headings")
    build.add_argument("--target", type=int)
    build.add_argument("--output", required=True)
    build.set_defaults(run=_build)
    query = commands.add_parser("query", help="run a registered query over a folder of tables")
    query.add_argument("name", choices=sorted(queries.queries()))
    query.add_argument("--data", required=True)
    query.add_argument("--output", required=True)
    query.set_defaults(run=_query)
    spans = commands.add_parser("spans", help="structure spans of text files by the rules, as JSON lines")
    spans.add_argument("--input", required=True)
    spans.add_argument("--output", required=True)
    spans.set_defaults(run=_spans)
    infer = commands.add_parser("infer", help="a task over text files, line by line, as JSON lines")
    infer.add_argument("--task", choices=pipelines.task_names(), required=True)
    infer.add_argument("--input", required=True)
    infer.add_argument("--parameters", help="folder of saved parameters with a lexicon")
    infer.add_argument("--lang", default="ar")
    infer.add_argument("--output", required=True)
    infer.set_defaults(run=_infer)
    annotate = commands.add_parser("annotate", help="fill missing marks of whole text files, as JSON lines")
    annotate.add_argument("--input", required=True)
    annotate.add_argument("--parameters", required=True)
    annotate.add_argument("--full", action="store_true", help="restore all marks instead")
    annotate.add_argument("--output", required=True)
    annotate.set_defaults(run=_annotate)
    info = commands.add_parser("info", help="what saved parameters hold")
    info.add_argument("--parameters", required=True)
    info.add_argument("--tables", nargs="*", default=["lexicon"])
    info.set_defaults(run=_info)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sahifa").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
