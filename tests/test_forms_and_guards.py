from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.__main__ import main
from sahifa.functions import tokens as K
from sahifa.operators import chain, metrics, neural, taggers, vocab
from sahifa.plans import pipelines
from sahifa.sources import corpus, exporters, tables

# --- uploads ---------------------------------------------------------------


@pytest.mark.parametrize(
    ("data", "extension"),
    [
        (b"MZ\x90\0", ".txt"),
        (b"PK\x03\x04xx", ".csv"),
        (b"%PDF-1.7", ".txt"),
        (b"plain\0text", ".txt"),
        (b"no archive", ".docx"),
        (b"no archive", ".xlsx"),
        (b"PK\x03\x04xx", ".doc"),
        (b"text", ".doc"),
        (b"text", ".exe"),
        (b"x" * 11, ".txt"),
    ],
)
def test_bytes_that_are_not_what_they_say(data, extension):
    with pytest.raises(tables.UnsafeInput):
        tables.check_shape(data, extension, 10 if len(data) == 11 else None)


def test_wide_texts_are_no_binary_data():
    for mark in ("utf-16", "utf-32"):
        tables.check_shape("قال abc".encode(mark), ".csv")


def test_what_was_left_out_is_told(spark):
    text = "\n".join(["قال مالك", "", "x" * 50, "last"])
    full = tables.extract_units(spark, text.encode(), ".txt", max_units=None, max_chars=None).orderBy("n").collect()
    assert [(r["source"], r["truncated"]) for r in full] == [("قال مالك", False), ("", False), ("x" * 50, False), ("last", False)]
    cut = tables.extract_units(spark, text.encode(), ".txt", max_chars=10).orderBy("n").collect()
    assert [(len(r["source"]), r["truncated"]) for r in cut] == [(8, False), (0, False), (10, True), (4, False)]
    few = tables.extract_units(spark, text.encode(), ".txt", max_units=2).collect()
    assert len(few) == 2 and all(r["truncated"] for r in few)
    pasted = spark.createDataFrame([(1, "ا" * 200_000), (2, "ا" * 200_001), (3, None)], "id int, text string")
    assert sorted(r["id"] for r in corpus.acceptable_pastes(pasted, "text").collect()) == [1, 3]


def test_column_by_name_or_number(spark):
    rows = spark.createDataFrame([(0, "7", "قال", "x" * 9)], "_o int, c0 string, c1 string, c2 string")
    for wanted, index, told in (("MATN", 1, 0), (" 3 ", 2, 0), ("2", 0, 0), ("0", 1, 1), ("4", 1, 1), ("other", 1, 1), (None, 1, 0), ("", 1, 0)):
        notes: list[str] = []
        assert tables.choose_column(rows, ["c0", "c1", "c2"], ["2", "Matn", "matn"], wanted, notes) == index and len(notes) == told


# --- taggers ---------------------------------------------------------------


def slow_lstm(rows, w_in, w_rec, b):
    """One direction, one row and one gate at a time."""
    size = w_rec.shape[1]
    out = np.zeros((len(rows), len(rows[0]), size))
    for r, row in enumerate(rows):
        h, c = np.zeros(size), np.zeros(size)
        for t, x in enumerate(row):
            new_h, new_c = np.zeros(size), np.zeros(size)
            for k in range(size):
                i, f, g, o = (sum(w_in[q * size + k] * x) + sum(w_rec[q * size + k] * h) + b[q * size + k] for q in range(4))
                i, f, o = (1 / (1 + np.exp(-v)) for v in (i, f, o))
                new_c[k] = f * c[k] + i * np.tanh(g)
                new_h[k] = o * np.tanh(new_c[k])
            h, c = new_h, new_c
            out[r, t] = h
    return out


def layer(rng, prefix, n, suffix, inputs, size):
    return {f"{prefix}{name}_l{n}{suffix}": rng.normal(size=shape) for name, shape in (("weight_ih", (4 * size, inputs)), ("weight_hh", (4 * size, size)), ("bias_ih", 4 * size), ("bias_hh", 4 * size))}


def stack(rng, prefix, inputs, size, layers):
    out = {}
    for n in range(layers):
        for suffix in ("", "_reverse"):
            out |= layer(rng, prefix, n, suffix, inputs if n == 0 else 2 * size, size)
    return out


def test_recurrent_layers_against_a_slow_reading():
    rng = np.random.default_rng(3)
    p = stack(rng, "x.", 3, 4, 2)
    rows = rng.normal(size=(2, 5, 3))
    out, last = neural.bilstm(rows, p, "x.", 2)
    x = rows
    for n in range(2):
        of = lambda s: (p[f"x.weight_ih_l{n}{s}"], p[f"x.weight_hh_l{n}{s}"], p[f"x.bias_ih_l{n}{s}"] + p[f"x.bias_hh_l{n}{s}"])  # noqa: B023, E731
        forth, back = slow_lstm(x, *of("")), slow_lstm(x[:, ::-1], *of("_reverse"))[:, ::-1]
        x = np.concatenate([forth, back], axis=-1)
    assert np.allclose(out, x) and np.allclose(last, np.concatenate([forth[:, -1], back[:, 0]], axis=-1))


def test_word_and_mark_taggers_keep_their_contracts(spark):
    rng = np.random.default_rng(4)
    p = {"char_emb.weight": rng.normal(size=(6, 3)), "head.weight": rng.normal(size=(3, 4)), "head.bias": rng.normal(size=3)} | stack(rng, "char_lstm.", 3, 2, 1) | stack(rng, "word_lstm.", 4, 2, 2)
    tagger = neural.WordTagger(p, {"ق": 2, "ا": 3, "ل": 4}, ["a", "b", "c"])
    assert tagger([]) == [] and len(tagger(["قال", "", "ال" * 30])) == 3
    assert np.allclose(tagger.scores(["ال" * 9])[0], tagger.scores(["ال" * 30])[0])  # characters beyond the limit are not read
    df = spark.createDataFrame([(1, ["قال", "ال"], "kept"), (1, None, "kept"), (None, [], "kept")], "id int, words array<string>, note string")
    out = taggers.apply_tagger(df, "words", lambda: neural.WordTagger(p, {"ق": 2}, ["a", "b", "c"]), block=220).collect()
    assert sorted(len(r["labels"]) for r in out) == [0, 0, 2] and {r["note"] for r in out} == {"kept"}
    q = {"emb.weight": rng.normal(size=(6, 3)), "tag_emb.weight": rng.normal(size=(4, 2)), "head.weight": rng.normal(size=(16, 4)), "head.bias": rng.normal(size=16)} | stack(rng, "lstm.", 5, 2, 2)
    marks = neural.MarkTagger(q, {"ق": 2, "ا": 3}, {"noun": 2, "verb": 3})
    assert marks("") == [] and len(marks("قال  ا", ["verb", "noun"])) == 6
    assert not np.allclose(marks.scores("قال", ["verb"]), marks.scores("قال", ["noun"]))
    plain = {k: v for k, v in q.items() if k != "tag_emb.weight"} | stack(rng, "lstm.", 3, 2, 2)
    assert len(neural.MarkTagger(plain, {"ق": 2})("قال")) == 3
    assert neural.parameter_count({"a": np.zeros((2, 3)), "b": np.zeros(4)}) == 10


def test_training_goes_on_from_earlier_counts(spark):
    shape = "id long, at int, word string, label string"
    one = spark.createDataFrame([(1, 0, "w", "a"), (2, 0, "w", "a"), (3, 0, "v", "b")], shape)
    two = spark.createDataFrame([(0, 0, "w", "c"), (1, 0, "w", "c"), (2, 0, "u", "d"), (3, 0, "xending", "e"), (4, 0, "yending", "e")], shape)
    counts = taggers.fine_tuned(taggers.count_labels(one, "word", "label", ["id", "at"]), taggers.count_labels(two, "word", "label", ["id", "at"]))
    best = {r["word"]: (r["label"], r["n"]) for r in taggers.best_labels(counts).collect()}
    assert best["w"] == ("a", 2) and best["v"] == ("b", 1) and best["u"] == ("d", 1)  # a tie goes to what was seen before
    words = spark.createDataFrame([("zending",), ("w",), ("zz",)], "word string")
    tagged = taggers.tag_words(words, "word", taggers.best_labels(counts), "x", {3: taggers.suffix_lexicon(counts, 3)})
    assert {r["word"]: r["predicted"] for r in tagged.collect()} == {"zending": "e", "w": "a", "zz": "x"}
    assert taggers.majority(two, "label", ["id", "at"]) == "c"


# --- lines, files and windows ----------------------------------------------


def test_lines_keep_their_blanks_or_leave_them_out(spark):
    df = spark.createDataFrame([(1, "حدثنا مالك\r\n\nعن نافع\n"), (2, " "), (3, None)], "id int, text string")
    lexicon = spark.createDataFrame([("حدثنا", "verb")], "word string, label string")
    got = {r["id"]: r["output"] for r in pipelines.infer_lines(df, "id", "text", "pos", "en", lexicon).collect()}
    assert got == {1: "حدثنا/verb مالك/noun\n\nعن/noun نافع/noun\n", 2: " ", 3: ""}
    got = {r["id"]: r["output"] for r in pipelines.infer_lines(df, "id", "text", "structure", "en").collect()}
    assert got[1] == "[matn] حدثنا مالك\n\n[matn] عن نافع" and got[2] == "" and got[3] == ""


def test_files_are_annotated_one_by_one(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿قال\n\n رسول قَالَ\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text(" ", encoding="utf-8")
    lexicon = spark.createDataFrame([("قال", "قَالَ"), ("رسول", "رَسُولُ")], "word string, label string")
    got = {r["file"].rpartition("/")[2]: r["output"] for r in pipelines.annotate_files(spark, str(tmp_path / "*.txt"), lexicon).collect()}
    assert got == {"a.txt": "قَالَ\n\n رَسُولُ قَالَ\n", "b.txt": " "}


def test_windows_get_one_tag_a_word(spark):
    df = spark.createDataFrame([(1, "قَالَ رَسُولُ"), (2, "قَالَ " * 125)], "id int, text string")
    lexicon = spark.createDataFrame([("قال", "verb")], "word string, label string")
    got = {r["id"]: r["tags"] for r in pipelines.tag_windows(df, "text", lexicon, "noun").collect()}
    assert got == {1: ["verb", "noun"], 2: ["verb"] * 120 + ["x"] * 5}


def test_padding_and_chunks(spark):
    df = spark.createDataFrame([([[1, 2], [3]], ["ab"] * 7)], "ids array<array<int>>, words array<string>")
    row = df.select(K.pad_words(F.col("ids"), F.lit(3), F.lit(4)).alias("p"), K.context_chunks(F.col("words"), 9).alias("c"), K.encoder_words(F.array(F.lit("قَــالَ"))).alias("e")).first()
    assert row["p"] == [[1, 2, 0, 0], [3, 0, 0, 0], [0, 0, 0, 0]] and row["c"] == [["ab"] * 3, ["ab"] * 3, ["ab"]] and row["e"] == ["قال"]


def test_chains_without_a_boundary_and_other_languages(spark):
    df = spark.createDataFrame([(1, "حدثنا مالك قال : عن نافع"), (1, None)], "id int, chain string")
    assert sorted(len(r["hops"]) for r in chain.split_chains(df, "chain").collect()) == [0, 2]
    units = spark.createDataFrame([(1, [("قال", "verb")])], "id int, pairs array<struct<word:string,code:string>>")
    assert pipelines.relabel(units, "pos", "en").first()["output"] == "قال/verb" and pipelines.relabel(units, "pos", "ar").first()["output"] != "قال/verb"
    assert pipelines.task_names() == ["pos", "structure", "tashkeel", "tashkeel_gaps"]


def test_parameters_are_described(spark, tmp_path):
    exporters.save_parameters({"lexicon": spark.createDataFrame([("a", "b")], "word string, label string")}, str(tmp_path / "p"), task="pos", version="1")
    assert [tuple(r) for r in exporters.parameters_info(spark, str(tmp_path / "p"), "lexicon").collect()] == [("lexicon rows", "1"), ("task", "pos"), ("version", "1")]


def test_previews_and_inverse_vocabularies(spark):
    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(5)], "n int, item string")
    assert [r["n"] for r in corpus.first_rows(df, ["n"], 2).collect()] == [0, 1]
    built = vocab.build(df, "item", ["n"], 3)
    ids = {r["item"]: r["id"] for r in built.collect()}
    assert {r["id"]: r["item"] for r in vocab.inverse(built).collect()} == {i: item for item, i in ids.items()} and ids["a"] == 2
    assert tuple(metrics.builder_yield(df, F.col("n") < 2).first()) == (2, 5) and tuple(metrics.builder_yield(df.limit(0), F.col("n") < 2).first()) == (0, 0)


def test_spreadsheet_rows_are_numbered_without_gaps(spark):
    raw = spark.createDataFrame([(("" if i % 7 == 3 else f"قال {i}"),) for i in range(100)], "a string").repartitionByRange(5, F.length("a"), "a")
    table = tables.build_table(raw)
    rows = table.df.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1 + sum(i % 7 != 3 for i in range(100)))) and rows[0].asDict().keys() == {"c0", "n"}


def test_command_line_of_tasks(spark, tmp_path):
    (tmp_path / "in.txt").write_text("قال مالك\n\nحدثنا", encoding="utf-8")
    parameters = str(tmp_path / "p")
    exporters.save_parameters({"lexicon": spark.createDataFrame([("قال", "قَالَ", 1), ("حدثنا", "حَدَّثَنَا", 1)], "word string, label string, n long")}, parameters, task="tashkeel")
    main(["infer", "--task", "tashkeel", "--input", str(tmp_path / "in.txt"), "--parameters", parameters, "--output", str(tmp_path / "i")])
    assert spark.read.json(str(tmp_path / "i")).first()["output"] == "قَالَ مالك\n\nحَدَّثَنَا"
    main(["annotate", "--input", str(tmp_path / "in.txt"), "--parameters", parameters, "--output", str(tmp_path / "a")])
    assert spark.read.json(str(tmp_path / "a")).first()["output"] == "قَالَ مالك\n\nحَدَّثَنَا"
    main(["info", "--parameters", parameters, "--tables", "lexicon"])
