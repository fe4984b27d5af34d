"""Dataset builders and tasks: compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sahifa.functions import labels as L, marks, text as X, tokens as K
from sahifa.operators import chain, runs, taggers

WINDOW_CHARS, BLOCK_WORDS, POS_WORDS = 380, 220, 120


def vocalized_windows(df: DataFrame, key: str, text: str, limit: int = WINDOW_CHARS, min_letters: int = 60, min_density: float = 0.6) -> DataFrame:
    """``(key, at, text, split)``: densely vocalized windows, which are their own labels."""
    cut = df.select(key, F.posexplode(K.windows(X.remove_junk(F.col(text)), limit)).alias("at", "text"))
    return cut.where(X.densely_vocalized(F.col("text"), min_letters, min_density)).withColumn("split", X.split_of(F.col("text")))


def build_tashkeel(df: DataFrame, key: str, text: str, target: int | None = None) -> DataFrame:
    """``(text, split)`` of the first ``target`` windows in input order (all without a target)."""
    rows = vocalized_windows(df, key, text)
    return (rows.orderBy(key, "at").limit(target) if target else rows).select("text", "split")


def confident_units(df: DataFrame, key: str, text: str, min_confidence: float = 0.9, min_offset: int = 30) -> DataFrame:
    """``(key, text, sanad_end, split)``: units whose boundary the rules are sure of. The length gate runs before the parser."""
    fit = df.where(F.length(text).between(150, 4000)).select(key, text)
    kept = chain.parse_chains(fit, text).where((F.col("confidence") >= min_confidence) & (F.col("sanad_end_raw") > min_offset))
    return kept.select(key, F.col(text).alias("text"), F.col("sanad_end_raw").alias("sanad_end"), X.split_of(F.col(text)).alias("split"))


def build_indexing(units: DataFrame, key: str, text: str, titles: DataFrame | None = None, target_units: int | None = None, target_titles: int = 5000, seed: int = 13) -> DataFrame:
    """``(text, sanad_end, kind, split)``: confident units in input order, then a seeded sample of titles of 15 to 200 characters."""
    rows = confident_units(units, key, text)
    rows = (rows.orderBy(key).limit(target_units) if target_units else rows).select("text", "sanad_end", "split")
    if titles is None:
        return rows.withColumn("kind", F.lit(None).cast("string")).select("text", "sanad_end", "kind", "split")
    fit = titles.where(F.length("text").between(15, 200)).select("text")
    picked = fit.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("text")))).limit(target_titles)
    heads = picked.select("text", F.lit("heading").alias("kind"), X.split_of(F.col("text")).alias("split"))
    return rows.unionByName(heads, allowMissingColumns=True).select("text", "sanad_end", "kind", "split")


def build_pos(df: DataFrame, key: str, text: str, load: Callable[[], taggers.Tagger], target: int | None = None, seed: int = 13) -> DataFrame:
    """``(tokens, tags, split)`` of passages of 200 to 2500 characters and at least 8 words, tagged by a pluggable teacher."""
    pool = df.where(F.length(text).between(200, 2500)).select(key, F.col(text).alias("raw"))
    if target:
        pool = pool.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("raw")))).limit(target)
    rows = pool.withColumn("clean", X.remove_junk(F.col("raw"))).withColumn("tokens", K.words(F.col("clean"))).where(F.size("tokens") >= 8)
    return taggers.apply_tagger(rows, "tokens", load, overflow="x").select("tokens", F.transform("labels", lambda t: F.when(F.coalesce(t, F.lit("")) == "", "x").otherwise(t)).alias("tags"), X.split_of(F.col("clean")).alias("split"))


def structure_rows(df: DataFrame, text: str = "text", boundary: str = "sanad_end", kind: str = "kind") -> DataFrame:
    """Adds ``words`` and ``labels`` of usable training rows: headings of two words or more, units of six or more with both labels."""
    toks = df.withColumn("_t", K.tokens(F.col(text)))
    heading = F.col(kind).eqNullSafe("heading")
    kept = F.slice("_t", 1, BLOCK_WORDS)
    labels = F.when(heading, F.transform(kept, lambda _: F.lit("HEADING"))).otherwise(runs.unit_labels(F.col("_t"), F.col(boundary), BLOCK_WORDS))
    rows = toks.withColumn("words", F.transform(kept, lambda t: t["text"])).withColumn("labels", labels).drop("_t")
    unit = (F.coalesce(F.col(boundary), F.lit(0)) > 0) & (F.size("words") >= 6) & F.array_contains("labels", "MATN") & F.array_contains("labels", "ISNAD")
    return rows.where(F.when(heading, F.size("words") >= 2).otherwise(unit))


def pos_rows(df: DataFrame, tokens: str = "tokens", tags: str = "tags", block: int = POS_WORDS) -> DataFrame:
    """Usable tagged rows in consecutive blocks: ``(..., block, tokens, tags)``; tokens and tags must be of equal, positive length."""
    good = df.where((F.size(tokens) == F.size(tags)) & (F.size(tokens) > 0))
    cut = F.arrays_zip(K.blocks(F.col(tokens), block).alias("t"), K.blocks(F.col(tags), block).alias("g"))
    return good.select(*[c for c in df.columns if c not in (tokens, tags)], F.posexplode(cut).alias("block", "b")).withColumn(tokens, F.col("b.t")).withColumn(tags, F.col("b.g")).drop("b")


def diacritization_rows(df: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    """Usable rows of a diacritization dataset: at least ``least`` characters without marks."""
    return df.where(F.length(marks.bare_text(F.col(text))) >= least)


def rows_of_split(df: DataFrame, name: str, column: str = "split") -> DataFrame:
    """The rows of one split, named exactly; pruned in the scan where a dataset is partitioned by it."""
    return df.where(F.col(column) == name)


def tag_windows(df: DataFrame, text: str, lexicon: DataFrame, default: str | None) -> DataFrame:
    """``df`` with ``tags`` beside each row: one tag per bare word of a window, ``x`` beyond the tagger's length."""
    bare = df.withColumn("_bare", marks.bare_text(F.col(text)))
    tagged = taggers.tag_texts(bare, "_bare", lexicon, default, POS_WORDS, overflow="x")
    return tagged.withColumn("tags", F.transform("pairs", lambda p: p["code"])).drop("_bare", "pairs")


@dataclass(frozen=True)
class Task:
    """One thing to do with a unit: its tag set, if any, and its names."""

    key: str
    name: str
    name_ar: str
    tag_kind: str | None = None


# The tasks and their names.
TASKS = {
    t.key: t
    for t in (
        Task("tashkeel", "Diacritize (tashkīl)", "التشكيل الكامل"),
        Task("tashkeel_gaps", "Fill missing diacritics", "إكمال الحركات الناقصة"),
        Task("pos", "Part-of-speech tags", "الوسم الصرفي", "pos"),
        Task("structure", "Hadith structure", "بنية الحديث", "structure"),
    )
}


def rule_labels(tokens: Column, boundary: Column) -> Column:
    """Structure labels by the rules' boundary: the stand-in for a trained structure tagger."""
    return F.transform(
        tokens,
        lambda t: F.when((t["idx"] == 0) & t["text"].rlike(r"^\p{Nd}+[-–.)\]]*$"), "HNUM").when(t["start"] < boundary, "ISNAD").otherwise("MATN"),
    )


def structure_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, source, pairs, narrators)`` by the rules: segments of each unit and the chain of each ISNAD segment; nothing is joined."""
    return chain.with_structure(df.select(key, F.col(text).alias("source")), "source")


def run_task(df: DataFrame, key: str, text: str, task: str, lang: str = L.DEFAULT_LANGUAGE, lexicon: DataFrame | None = None, default: str = "noun") -> DataFrame:
    """``(key, source, output)`` of every unit; blank units pass through untouched.

    ``lexicon`` has the trained counts for the task: vocalizations for the diacritizing tasks,
    tags for ``pos``. Codes stay beside the output (``pairs``), so another language is formatting.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task '{task}'")
    blank = X.is_blank(F.col(text))
    work, rest = df.where(~blank), df.where(blank)
    passed = rest.select(key, F.col(text).alias("source"), F.col(text).alias("output"))
    rows = work.select(key, F.col(text).alias("source"))
    if task in ("tashkeel", "tashkeel_gaps"):
        run = taggers.diacritize if task == "tashkeel" else taggers.fill_gaps
        return run(rows, "source", lexicon).unionByName(passed)
    if task == "pos":
        tagged = taggers.tag_texts(rows, "source", lexicon, default, POS_WORDS)
        return tagged.select(key, "source", L.format_pos(F.col("pairs"), lang).alias("output")).unionByName(passed)
    units = structure_units(work, key, text)
    return units.select(key, "source", L.format_structure(F.col("pairs"), F.col("narrators"), lang).alias("output")).unionByName(passed)


def infer_lines(df: DataFrame, key: str, text: str, task: str, lang: str = L.DEFAULT_LANGUAGE, lexicon: DataFrame | None = None, default: str = "noun") -> DataFrame:
    """``(key, output)``: a task line by line over whole texts, put together again in order.

    Blank lines are kept, save in the structure task: there they are left out and a blank line
    stands between the segments of two lines. Keys must be unique; a text without any line of
    content gives its blank lines, in the structure task an empty output.
    """
    lines = df.select(key, F.posexplode(X.lines_of(F.col(text))).alias("_line", "source"))
    if task == "structure":
        lines = lines.where(~X.is_blank(F.col("source")))
    place = F.struct(F.col(key).alias("key"), F.col("_line").alias("line"))
    done = run_task(lines.select(place.alias("place"), "source"), "place", "source", task, lang, lexicon, default)
    gathered = F.array_sort(F.collect_list(F.struct(F.col("place.line").alias("line"), "output")))
    joined = done.groupBy(F.col("place.key").alias(key)).agg(F.array_join(F.transform(gathered, lambda x: x["output"]), "\n\n" if task == "structure" else "\n").alias("output"))
    return df.select(key).join(joined, key, "left").withColumn("output", F.coalesce("output", F.lit("")))


def annotate_files(spark: SparkSession, path: str, lexicon: DataFrame, full: bool = False) -> DataFrame:
    """``(file, output)``: one row per text file with its gaps filled (``full``: all marks restored); white space stays as it is."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    run = taggers.diacritize if full else taggers.fill_gaps
    return run(files, "text", lexicon).select("file", "output")


def task_names() -> list[str]:
    return sorted(TASKS)


def relabel(units: DataFrame, kind: str, lang: str) -> DataFrame:
    """The output in another language from the codes kept in ``pairs`` (and ``narrators``): no tagger runs again."""
    form = L.format_pos(F.col("pairs"), lang) if kind == "pos" else L.format_structure(F.col("pairs"), F.col("narrators"), lang)
    return units.withColumn("output", form)
