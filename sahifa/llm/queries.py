"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sahifa.llm import bpe, mixing, names, neardup, overlap, pieces, residue, samelook, termfreq
from sahifa.session import read_table, ship_package


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(read_table(spark, sf_dir, "pos"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_pieces(read_table(spark, sf_dir, "pos"))


# Key and text (or tokens) of the tables with texts.
_TEXTS = {"pos": ("pos_id", "tokens"), "unit": ("unit_id", "source"), "indexing": ("idx_id", "text")}


def _each(spark: SparkSession, sf_dir: str, function: Callable[..., DataFrame], *tables: str) -> DataFrame:
    parts = [function(read_table(spark, sf_dir, t), *_TEXTS[t]).select(F.lit(t).alias("tbl"), "*") for t in tables]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, samelook.same_look_pairs, "pos", "unit")


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, samelook.same_look_members, "pos", "unit")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, samelook.with_one_form, "pos", "unit").select("tbl", "row_id", "form")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, neardup.near_duplicate_pairs, "pos", "unit")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, neardup.near_duplicate_groups, "pos", "unit")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_links(read_table(spark, sf_dir, "hop"), read_table(spark, sf_dir, "narrator"), read_table(spark, sf_dir, "narrator_ref"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names.mention_rows(read_table(spark, sf_dir, "hop"), read_table(spark, sf_dir, "narrator"))
    return names.linked_rows(rows, read_table(spark, sf_dir, "narrator_ref"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, overlap.overlap_pairs, "pos", "indexing")


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, overlap.overlap_members, "pos", "indexing")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, overlap.overlap_report, "pos", "indexing")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, overlap.overlap_records, "pos", "indexing")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = termfreq.marked_terms(read_table(spark, sf_dir, "pos"))
    return marked.where("mark is not null").select("field", "term", "mark")


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.marked_terms(read_table(spark, sf_dir, "pos"))


def p6_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.marked_terms(read_table(spark, sf_dir, "pos")).where("field = 'tags'").select("term", "n_occurrences", "n_rows", "mark")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).selection()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(read_table(spark, sf_dir, "documents"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(read_table(spark, sf_dir, "documents"))


_QUERIES = (p1_found, p1_pieces, p2_found, p2_members, p2_forms, p3_found, p3_groups, p4_found, p4_links, p5_found, p5_members, p5_report, p5_records, p6_found, p6_terms, p6_tags, p7_ids, p8_selection, p8_shares, p9_found, p9_clean)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        return run

    return {q.__name__: shipped(q) for q in _QUERIES}


# White space, line breaks and characters no reader sees, spelled out for DuckDB.
_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{2800}\x{3000}"
_BREAK = r"\x{0A}-\x{0D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}"
_UNSEEN = r"\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}"

_SQL = {
    "p1_found": rf"""
        with token as (select pos_id, unnest(tokens) as t, generate_subscripts(tokens, 1) as i from pos),
        part as (select pos_id, i, unnest(p) as w, generate_subscripts(p, 1) as j from (select pos_id, i, regexp_extract_all(t, '[{_BREAK}]|[^{_SPACE}]+') as p from token)),
        mark as (select pos_id, i, j, regexp_matches(w, '[^{_SPACE}{_UNSEEN}]')::int as word,
            (regexp_matches(w, '^[{_BREAK}]$') or regexp_matches(w, '[.؟?!۔…．？！][»)\]）］{_UNSEEN}]*$'))::int as stop from part),
        sentence as (select pos_id, word, coalesce(sum(stop) over (partition by pos_id order by i, j rows between unbounded preceding and 1 preceding), 0) as s from mark),
        counted as (select pos_id, s, sum(word) as n from sentence group by pos_id, s)
        select pos_id, case when max(n) > 120 then 'forced' else 'natural' end as cut_class from counted group by pos_id having sum(n) > 120
    """,
    "p6_tags": """
        with tag as (select pos_id, lower(trim(unnest(tags), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8195) || chr(12288))) as term from pos),
        counted as (select term, count(*) as n_occurrences, count(distinct pos_id) as n_rows from tag where term <> '' group by term)
        select term, n_occurrences, n_rows, case when n_rows < 3 then 'rare' when n_rows > 0.45 * (select count(*) from pos) then 'common' end as mark from counted
    """,
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries it can say; the others are tested against brute force, round trips and other encoders."""
    return dict(_SQL)
