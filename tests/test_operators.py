from __future__ import annotations

import io
import json
import random
import re
import struct
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sahifa.functions import marks as M, tokens as K
from sahifa.operators import chain, metrics, ratelimit, runs, taggers
from sahifa.operators.rowmap import map_rows
from sahifa.plans import pipelines
from sahifa.sources import corpus, exporters, tables
from sahifa.streaming.ratelimit import rate_limit_stream

CHAIN = "حَدَّثَنَا عبد الله بن يوسف قال أخبرنا مالك عن نافع عن ابن عمر أن رسول الله صلى الله عليه وسلم قال كذا"


# --- chains: a plain reading of the rules, one character and one word at a time ---------------


def plain_fold(text):
    marks = set(map(chr, [*range(0x610, 0x61B), *range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6DD), *range(0x6DF, 0x6E9), *range(0x6EA, 0x6EE), 0x640]))
    fold = dict(zip("آأإٱةىؤئ", "اااا" + "هيءء"))
    out = []
    for i, c in enumerate(text):
        if c in marks:
            continue
        if c.isspace():
            if out and out[-1][0] != " ":
                out.append((" ", i))
        else:
            out.append((fold.get(c, c), i))
    while out and out[-1][0] == " ":
        out.pop()
    return "".join(c for c, _ in out), [i for _, i in out], marks


def plain_boundary(norm):
    opener = re.search(r'(قال|يقول|سمعت)\s+(رسول\s+الله|النبي)|ان\s+(رسول\s+الله|النبي)\s|عن\s+النبي\s*صلي|يقول\s*:|قال\s*:\s*"', norm)
    verbs = "حدثنا حدثني اخبرنا اخبرني انبانا ثنا نا انا ابنا انبا سمعت عن".split()
    speech = None
    for m in re.finditer(r"\b(قال|قالت)\s*:", norm):
        following = re.match(r"\w*", norm[m.end() :].lstrip()).group()
        if m.start() >= 8 and following not in verbs:
            speech = m.start()
            break
    if opener and (speech is None or opener.start() <= speech):
        return opener.start(), opener, False
    if speech is not None:
        return speech, opener, False
    return min(len(norm), 300), opener, True


TEXTS = [
    CHAIN,
    "حدثني محمد بن المثنى ، حدثنا عبد الرحمن ، عن سفيان ، عن أبي إسحاق",
    "١٢٤٨ - حدثنا مالك قال : حدثنا نافع قال : كان كذا",
    "قال : كذا وكذا",
    "عن صهيب صاحب رسول الله قال : مررت",
    "حدثنا ا عن نافع أن النبي قال",
    "حدثنا مالك رضي الله عنه قال سمعت نافعا يقول : كذا",
    "كان رسول الله يفعل كذا",
    "حدثنا « مالك » عن نافع",
    "عن ، الزهري عن نافع قالت : كذا",
    "حدثنا " + "طويل " * 20 + "عن نافع",
    "",
    "   ",
    None,
]


def test_boundaries_against_a_plain_reading(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "unit_id int, source string")
    for row in chain.parse_chains(df, "source").collect():
        text = TEXTS[row["unit_id"]] or ""
        norm, offsets, marks = plain_fold(text)
        end, opener, cut = plain_boundary(norm)
        assert row["sanad_end"] == end
        assert row["sanad_end_raw"] == (-1 if cut or end >= len(offsets) else offsets[end])
        assert ("no_matn_marker" in row["flags"]) == cut
        for hop in row["hops"]:
            shown = text[hop["start"] : hop["end"]]
            assert plain_fold(shown)[0] == hop["mention"]
            assert plain_fold(text[hop["verb_start"] : hop["verb_end"]])[0] == hop["verb"]
            assert 2 <= len(hop["mention"]) <= 60 and not (hop["end"] < len(text) and text[hop["end"]] in marks)


def test_golden_chains():
    end, raw, confidence, flags, hops = chain.parse(CHAIN)
    assert raw > 30 and confidence >= 0.9 and len(hops) >= 3 and not flags
    assert "عبد الله بن يوسف" in [h[1] for h in hops]
    text = TEXTS[1]
    found = chain.hops_of(*chain.fold(text))[0]
    assert [text[h[3] : h[4]] for h in found] == ["محمد بن المثنى", "عبد الرحمن", "سفيان", "أبي إسحاق"]
    assert [h[0] for h in found] == ["حدثني", "حدثنا", "عن", "عن"]
    assert chain.parse("عن صهيب صاحب رسول الله قال : مررت")[4][0][1] == "صهيب"
    # a dropped one-letter name leaves a gap in the positions and a warning
    _, _, _, flags, hops = chain.parse("حدثنا ا عن نافع قال : كذا وكذا")
    assert "dropped_mention" in flags and [h[2] for h in hops] == [1]
    # punctuation right after a verb leaves no name
    assert [h[1] for h in chain.parse("عن ، الزهري عن نافع")[4]] == ["نافع"]


def test_narrators_of_segments(spark):
    text = "حدثنا محمد بن بشار قال حدثنا يحيى عن عبيد الله"
    df = spark.createDataFrame([(1, [("ISNAD", text), ("MATN", "قال")])], "unit_id int, pairs array<struct<code:string,text:string>>")
    got = sorted(tuple(r) for r in chain.narrators(df, "unit_id").collect())
    assert got == [(1, 0, 1, "حدثنا", "محمد بن بشار"), (1, 0, 2, "حدثنا", "يحيى"), (1, 0, 3, "عن", "عبيد الله")]


# --- runs ------------------------------------------------------------------


def test_runs_both_ways(spark):
    rng = random.Random(1)
    made = [(i, [(f"w{k}", rng.choice("AB")) for k in range(rng.randint(0, 12))]) for i in range(40)]
    df = spark.createDataFrame(made, "id int, pairs array<struct<word:string,code:string>>")
    merged = {r["id"]: [(s["code"], s["text"]) for s in r["s"]] for r in df.select("id", runs.merge_runs(F.col("pairs")).alias("s")).collect()}
    exploded = df.select("id", F.posexplode("pairs").alias("at", "p")).select("id", "at", "p.word", "p.code")
    by_row = defaultdict(list)
    for r in runs.merged_segments(exploded, ["id"], "at", "code", "word").orderBy("id", "run").collect():
        by_row[r["id"]].append((r["code"], r["text"]))
    for key, pairs in made:
        want = []
        for word, code in pairs:
            if want and want[-1][0] == code:
                want[-1] = (code, want[-1][1] + " " + word)
            else:
                want.append((code, word))
        assert merged[key] == want == by_row[key]


def test_spans_are_ordered_and_short_pages_have_none(spark):
    text = " ".join(["حدثنا"] * 8 + ["قال"] * 8)
    df = spark.createDataFrame([(1, text, 44), (2, "حدثنا مالك", 3)], "id int, text string, b int").withColumn("t", K.tokens(F.col("text")))
    rows = df.select("id", runs.spans(F.col("t"), runs.unit_labels(F.col("t"), F.col("b"))).alias("s")).orderBy("id").collect()
    assert [(s["start"], s["end"], s["label"]) for s in rows[0]["s"]] == [(0, 47, "ISNAD"), (48, 79, "MATN")]
    assert rows[1]["s"] == []
    used = df.select("id", runs.usable(runs.spans(F.col("t"), runs.unit_labels(F.col("t"), F.col("b")))).alias("u")).orderBy("id")
    assert [r["u"] for r in used.collect()] == [False, False]  # 31 characters of report are not enough


# --- metrics ---------------------------------------------------------------


def test_upper_median_and_misses(spark):
    errors = spark.createDataFrame([(e,) for e in (4, 1, None, 3, 2)], "error int")
    row = metrics.boundary_scores(errors).first()
    assert (row["boundaries"], row["within_share"], row["median_error"]) == (5, 0.4, 3)
    empty = metrics.boundary_scores(errors.limit(0)).first()
    assert (empty["boundaries"], empty["within_share"], empty["median_error"]) == (0, 0.0, None)


def test_accuracy_and_confusions(spark):
    made = [("a", "a"), ("a", "b"), ("b", "a"), ("a", "b"), ("c", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(made)], "at int, gold string, predicted string")
    row = metrics.accuracy(df, "gold", "predicted").first()
    assert (round(row["accuracy"], 6), row["tokens"]) == (0.2, 5)
    top = metrics.top_confusions(df, "gold", "predicted", ["at"], 2).collect()
    assert [tuple(r) for r in top] == [("a", "b", 2), ("b", "a", 1)]
    assert metrics.accuracy(df.limit(0), "gold", "predicted").first()["accuracy"] == 1.0


def test_error_rates_count_letters_only(spark):
    df = spark.createDataFrame([("قَا لَ", "قَا لُ")], "g string, p string")
    rates = metrics.error_rates(df.select(M.letter_errors(M.split_marks(F.col("g")), M.split_marks(F.col("p"))).alias("e"))).first()
    assert rates["letters"] == 3 and round(rates["der_all"], 6) == round(1 / 3, 6) and rates["der_marked"] == 0.5


# --- taggers ---------------------------------------------------------------


def test_taggers_keep_their_contracts(spark):
    train = spark.createDataFrame([(1, "قَالَ رَسُولُ اللَّهِ"), (2, "قَالَ قِيلَ")], "id int, text string")
    lexicon = taggers.train_diacritizer(train, "text", "id")
    made = [(1, "  قَالَ رسول  الله ﴿الله﴾ "), (2, "قال"), (3, "  "), (4, ""), (5, None)]
    df = spark.createDataFrame(made, "id int, text string")
    gaps = {r["id"]: r["output"] for r in taggers.fill_gaps(df, "text", lexicon).collect()}
    assert gaps == {1: "  قَالَ رَسُولُ  اللَّهِ ﴿الله﴾ ", 2: "قَالَ", 3: "  ", 4: "", 5: ""}
    full = taggers.diacritize(df, "text", lexicon)
    assert full.where(~taggers.letters_unchanged("text", "output")).count() == 0
    # keys may repeat or be null, rows too, and other columns stay
    twice = spark.createDataFrame([(1, "قال"), (1, "قيل قال"), (None, "قال"), (None, None), (1, "قال")], "id int, text string").selectExpr("*", "'x' as label", "'y' as output")
    got = [(r["id"], r["output"], r["label"]) for r in taggers.diacritize(twice, "text", lexicon).collect()]
    assert sorted(got, key=str) == sorted([(1, "قَالَ", "x"), (1, "قِيلَ قَالَ", "x"), (None, "قَالَ", "x"), (None, "", "x"), (1, "قَالَ", "x")], key=str)


def test_plugged_tagger_in_blocks(spark):
    df = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, None)], "id int, words array<string>")
    load = lambda: lambda words: [f"{len(words)}{w}" for w in words]
    got = {r["id"]: r["labels"] for r in taggers.apply_tagger(df, "words", load, block=3).collect()}
    assert got == {1: ["3a", "3b", "3c", "3d", "3e", "3f", "1g"], 2: [], 3: []}
    cut = {r["id"]: r["labels"] for r in taggers.apply_tagger(df, "words", load, max_words=2).collect()}
    assert cut[1] == ["2a", "2b"] + ["?"] * 5


def test_tasks_pass_blanks_and_know_their_names(spark):
    df = spark.createDataFrame([(1, "حدثنا مالك عن نافع قال : كذا"), (2, " "), (3, "")], "unit_id int, source string")
    out = {r["unit_id"]: r["output"] for r in pipelines.run_task(df, "unit_id", "source", "structure", "en").collect()}
    assert out[2] == " " and out[3] == "" and out[1].startswith("[isnād] حدثنا مالك عن نافع\n    narrators:")
    lexicon = spark.createDataFrame([("حدثنا", "verb")], "word string, label string")
    tagged = {r["unit_id"]: r["output"] for r in pipelines.run_task(df, "unit_id", "source", "pos", "en", lexicon).collect()}
    assert tagged[1].startswith("حدثنا/verb مالك/noun")
    long = spark.createDataFrame([(1, "حدثنا " * 125), (1, "مالك")], "unit_id int, source string")
    tagged = sorted(r["output"] for r in pipelines.run_task(long, "unit_id", "source", "pos", "en", lexicon).collect())
    assert tagged[0].split(" ") == ["حدثنا/verb"] * 120 + ["حدثنا/?"] * 5 and tagged[1] == "مالك/noun"
    same = spark.createDataFrame([(7, "حدثنا مالك عن نافع قال : كذا"), (7, "عن صهيب"), (None, "حدثنا مالك عن نافع")], "unit_id int, source string")
    assert pipelines.structure_units(same, "unit_id", "source").count() == 3
    with pytest.raises(ValueError):
        pipelines.run_task(df, "unit_id", "source", "other")


def test_dataset_builders(spark):
    long = CHAIN + " " + "كلمات كثيرة " * 10
    units = spark.createDataFrame([(1, long), (2, "قصير"), (3, "بلا سند " * 30), (4, None)], "id int, text string")
    titles = spark.createDataFrame([("كتاب الإيمان والإسلام",), ("باب",)], "text string")
    got = pipelines.build_indexing(units, "id", "text", titles).collect()
    assert [(r["kind"], r["sanad_end"] is None) for r in got] == [(None, False), ("heading", True)]
    pos = pipelines.build_pos(units, "id", "text", lambda: lambda words: ["" if w == "بلا" else "noun" for w in words]).collect()
    assert len(pos) == 2 and all(len(r["tokens"]) == len(r["tags"]) and "" not in r["tags"] for r in pos)
    rows = pipelines.structure_rows(spark.createDataFrame(pipelines.build_indexing(units, "id", "text", titles).collect(), "text string, sanad_end int, kind string, split string"))
    assert sorted(set(x for r in rows.collect() for x in r["labels"])) == ["HEADING", "ISNAD", "MATN"]


# --- limits ----------------------------------------------------------------


def plain_limit(times, limit, window, inclusive):
    admitted, out = [], []
    for t in times:
        recent = [a for a in admitted if (a >= t - window if inclusive else t - a < window)]
        out.append(len(recent) < limit)
        if out[-1]:
            admitted.append(t)
    return out


@pytest.mark.parametrize("inclusive", [True, False])
def test_limits_against_brute_force(spark, inclusive):
    rng = random.Random(3)
    made = [(i, rng.choice([1, 1, 1, 2, None]), float(rng.randint(0, 300))) for i in range(500)]
    df = spark.createDataFrame(made, "event_id int, client int, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["admitted"] for r in ratelimit.rate_limit(df, "client", "ts", "event_id", 4, 10.0, inclusive).collect()}
    for client in (1, 2):
        mine = sorted((s, i) for i, c, s in made if c == client)
        assert [got[i] for _, i in mine] == plain_limit([s for s, _ in mine], 4, 10.0, inclusive)
    assert len(got) == sum(c is not None for _, c, _ in made) and False in got.values()


def test_limit_on_a_stream(spark, tmp_path):
    made = [(i, i % 2, float(i)) for i in range(60)]
    schema = "event_id int, client int, s double, ts timestamp"
    for k in range(2):  # two files are two batches
        part = spark.createDataFrame(made[30 * k : 30 * k + 30], "event_id int, client int, s double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1e9))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = rate_limit_stream(stream, "client", "ts", "event_id", 4, 10.0, "1 hour").writeStream.format("memory").queryName("limited").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r["event_id"]: r["admitted"] for r in spark.table("limited").collect()}
    for client in (0, 1):
        mine = [i for i, c, _ in made if c == client]
        assert [got[i] for i in mine] == plain_limit([float(i) for i in mine], 4, 10.0, True)


# --- sources and exports ---------------------------------------------------


def test_corpus_kinds(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_bytes("﻿قال مالك\r\n\r\n \n حدثنا نافع \x85y".encode())
    (tmp_path / "a.txt").write_text("واحد\nاثنان\n\nثلاثة", encoding="utf-8")
    (tmp_path / "c.jsonl").write_text(json.dumps({"text": " س "}) + "\n\n" + json.dumps({"text": " "}) + "\n" + json.dumps({"other": 1}) + "\n", encoding="utf-8")
    read = lambda record: [r["text"] for r in corpus.iter_texts(spark, str(tmp_path), record).orderBy("ord").collect()]
    assert read("line") == ["واحد", "اثنان", "ثلاثة", "قال مالك", "حدثنا نافع", "y", " س "]
    assert read("blank-line") == ["واحد\nاثنان", "ثلاثة", "قال مالك", "حدثنا نافع \x85y", " س "]
    assert read("file")[1].startswith("قال مالك\r\n")
    lines = corpus.read_jsonl(spark, str(tmp_path / "c.jsonl"), "text string", 1).collect()
    assert [r["text"] for r in lines] == [" س "]
    with pytest.raises(ValueError):
        read("page")


def test_encodings():
    text = "حدثنا محمد"
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-32", "cp1256"):
        assert tables.decode_text(text.encode(name)) == text


def test_spreadsheets(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id;page;matn\n1;5;قال مالك\n;;\n2;6;حدثنا نافع\n", encoding="utf-8")
    table = tables.read_csv(spark, str(path))
    assert table.columns == ["id", "page", "matn"] and table.text_column == 2 and table.had_header
    assert [(r["n"], r["c2"]) for r in table.df.orderBy("n").collect()] == [(1, "قال مالك"), (2, "حدثنا نافع")]
    assert tables.read_csv(spark, str(path), "PAGE").text_column == 1
    assert tables.read_csv(spark, str(path), "1").text_column == 0
    missing = tables.read_csv(spark, str(path), "other")
    assert missing.text_column == 2 and missing.notes
    out = exporters.table_export(table.df, table.columns, spark.createDataFrame([(1, "=x"), (2, "y")], "n int, output string"), "pos")
    assert [tuple(r) for r in out.collect()] == [("1", "5", "قال مالك", "'=x"), ("2", "6", "حدثنا نافع", "y")]
    units = tables.extract_units(spark, path.read_bytes(), ".csv")
    assert [tuple(r) for r in units.orderBy("n").collect()] == [(1, "قال مالك", False), (2, "حدثنا نافع", False)]


def archive(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in parts.items():
            out.writestr(name, content)
    return data.getvalue()


def test_office_files(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>قال</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert [r["source"] for r in tables.extract_units(spark, archive({"word/document.xml": body}), ".docx").orderBy("n").collect()] == ["قال", "a\tb"]
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = {
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="x" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>matn</t></si><si><t>قال</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1"><v>7</v></c><c r="C1" t="s"><v>0</v></c></row><row><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>',
    }
    assert [x["source"] for x in tables.extract_units(spark, archive(book), ".xlsx").collect()] == ["قال"]
    for bad in (b"not a zip", archive({"other": "x"}), archive({"word/document.xml": "<!DOCTYPE x>"}), archive({"word/vbaProject.bin": "x", "word/document.xml": body}), archive({"../x": "y", "word/document.xml": body}), archive({"word/document.xml": " " * 3_000_000})):
        with pytest.raises(tables.UnsafeInput):
            tables.extract_units(spark, bad, ".docx")
    for extension in (".exe", ".doc"):
        with pytest.raises(tables.UnsafeInput):
            tables.extract_units(spark, b"x", extension)


def compound(streams):
    """A compound file of 512-byte sectors: directory, FAT, then each stream in a chain of its own."""
    entries, body, fat, sector = [], b"", [0xFFFFFFFE, 0xFFFFFFFD], 2

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)

    entries.append(entry("Root Entry", 5, 0xFFFFFFFE, 0))
    for name, data in streams.items():
        data = data.ljust(4096, b"\0")  # at the cutoff, so no stream is a small one
        count = -(-len(data) // 512)
        entries.append(entry(name, 2, sector, len(data)))
        fat += [*range(sector + 1, sector + count), 0xFFFFFFFE]
        body += data.ljust(count * 512, b"\0")
        sector += count
    directory = b"".join(entries).ljust(512, b"\0")
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, 0, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 1, *[0xFFFFFFFF] * 108)
    return head + directory + table + body


def test_legacy_word_files(spark):
    wide, narrow = "قال مالك\rعن ".encode("utf-16-le"), "نافع\x13PAGE\x14\x15\r".encode("cp1256")
    word = bytearray(0x400) + wide + narrow
    pieces = struct.pack("<III", 0, len(wide) // 2, len(wide) // 2 + len(narrow)) + b"\0\0" + struct.pack("<I", 0x400) + b"\0\0" + b"\0\0" + struct.pack("<I", 2 * (0x400 + len(wide)) | 0x40000000) + b"\0\0"
    clx = b"\x01" + struct.pack("<H", 3) + b"xyz" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<H", word, 10, 0x200)
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    units = tables.extract_units(spark, compound({"WordDocument": bytes(word), "1Table": clx}), ".doc")
    assert [r["source"] for r in units.orderBy("n").collect()] == ["قال مالك", "عن نافع"]
    with pytest.raises(tables.UnsafeInput):
        tables.extract_units(spark, compound({"WordDocument": bytes(word), "Macros": b"x"}), ".doc")


def test_exports(spark, tmp_path):
    units = spark.createDataFrame([(2, "ب", "x"), (1, "ا", None), (3, " ", "y")], "n int, source string, output string").withColumn("doc", F.lit(1))
    assert exporters.as_text(units, ["doc"], "n", "output").first()["body"] == "\nx\ny"
    assert exporters.plain_export(units, "n", "source", "output").count() == 2
    exporters.write_csv(units.select("n", "source").coalesce(1), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith("﻿n,source\r\n".encode()) and raw.count(b"\r\n") == 4
    counts = exporters.write_dataset(spark.createDataFrame([("a", "train"), ("b", "dev")], "text string, split string"), str(tmp_path / "ds"))
    assert {tuple(r) for r in counts.collect()} == {("train", 1), ("dev", 1)}
    exporters.save_parameters({"lexicon": units.select("n")}, str(tmp_path / "m"), task="pos")
    loaded = exporters.load_parameters(spark, str(tmp_path / "m"), "lexicon")
    assert loaded["lexicon"].count() == 3 and loaded["metadata"].first()["value"] == "pos"
    assert exporters.file_name("x", "pos", "csv") == "x-pos.csv"


def test_map_rows_of_nothing(spark):
    df = spark.createDataFrame([], "a int")
    assert map_rows(df, lambda a: [a], "b int").collect() == []
