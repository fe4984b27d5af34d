from __future__ import annotations

import random
import unicodedata
from collections import Counter

import pytest

from sahifa.llm import bpe, oneform, pieces, samelook, termfreq
from sahifa.llm.words import Tokens, normalize_text, plain_words, raw_words, stored_texts, term


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- one form --------------------------------------------------------------


@pytest.mark.parametrize(
    ("stored", "form"),
    [
        ("‏قال​", "قال"),
        ("ﻗﺎﻝ", "قال"),
        ("ﻻ", "لا"),
        ("قال مالك　عن", "قال مالك عن"),
        ("أحمد", "أحمد"),
        ("إلى", "إلى"),
        ("کتاب", "كتاب"),
        ("علی", "على"),
        ("یقول", "يقول"),
        ("جدہ", "جده"),
        ("مدینۃ", "مدينة"),
        ("۱۲۳", "١٢٣"),
        ("۴۵۶", "۴۵۶"),
        ("：！．", ":!."),
        ("сору", "copy"),
        ("ab­cd", "abcd"),
        ("َّ", unicodedata.normalize("NFC", "َّ")),
        ("   ", ""),
        (None, ""),
        ("", ""),
    ],
)
def test_one_form(stored, form):
    assert oneform.one_form(stored) == form


@pytest.mark.parametrize(("a", "b"), [("a  b", "a b"), ("قَال", "قال"), ("قـال", "قال"), ("أحمد", "احمد"), ("على", "علي"), ("كتابة", "كتابه")])
def test_what_looks_different_stays_apart(a, b):
    assert oneform.one_form(a) != oneform.one_form(b)


def test_one_form_is_a_fixed_point():
    random.seed(3)
    pool = "قالكیهۃ​‏ﻻﻗَّٔ ab ۱۴"
    for _ in range(2000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 12)))
        form = oneform.one_form(text)
        assert oneform.one_form(form) == form == unicodedata.normalize("NFC", form)


def test_the_longest_key_of_a_cluster_wins():
    """Keys of several characters win over their prefixes, also past a mark that belongs to no key."""
    assert oneform.TABLE["\u0649\u0654"] == "\u0626" and oneform.transduce_word("\u0649") == "\u0649"
    assert oneform.TABLE["\u00e2\u0301"] == "\u1ea5" and oneform.transduce_word("a\u0302") == "\u00e2"
    assert oneform.transduce_word("a\u0302\u0301") == "\u1ea5"
    assert oneform.transduce_word("a\u200b\u0302\u200d\u0301") == "\u1ea5"
    assert oneform.transduce_word("a\u0301\u0323") == oneform.transduce_word("\u1ea1\u0301") == unicodedata.normalize("NFC", "a\u0301\u0323")
    assert oneform.transduce_word("\u1112\u1161\u11ab") == "\ud55c"


def test_the_table_has_no_conflict():
    oneform.check_table()
    random.seed(4)
    accents = [c for c in oneform.TABLE if len(c) == 1 and not c.isspace() and oneform._apart(c) == unicodedata.normalize("NFD", c) != c and c != "\u06c2"]
    pool = [*accents, *"aeo\u0627\u064a\u0648\u0301\u0302\u0323\u0653\u0654\u064e\u0651"]
    for _ in range(5000):
        text = "".join(random.choice(pool) for _ in range(random.randint(1, 7)))
        assert oneform.transduce_word(text) == unicodedata.normalize("NFC", text)


def test_same_look_pairs_against_brute_force(spark):
    random.seed(5)
    base = ["قال مالك", "عن نافع", "حدثنا يحيى", "", None, "​", "سمعت"]
    twist = lambda t: None if t is None else "".join(c + random.choice(["", "", "​"]) for c in t).replace(" ", random.choice([" ", " "]))
    texts = [(i, twist(random.choice(base))) for i in range(60)] + [(60, "قال مالك"), (61, "قال مالك")]
    df = spark.createDataFrame(texts, "row_id long, source string").selectExpr("row_id", "row_id as id", "source", "source as look", "1 as stored")
    got = rows(samelook.same_look_pairs(df, "id", "source"))
    want = sorted((a, b) for a, x in texts for b, y in texts if a < b and oneform.one_form(x) and oneform.one_form(x) == oneform.one_form(y) and x != y)
    assert got == sorted(want, key=repr) and got


def test_a_hot_look_does_not_multiply(spark):
    df = spark.createDataFrame([(i, "قال مالك" if i < 200 else "قال​ مالك") for i in range(300)] + [(500, "قال\u00a0مالك")], "id long, source string")
    got = {tuple(r) for r in samelook.same_look_pairs(df, "id", "source").collect()}
    want = {(i, 200) for i in range(200)} | {(0, j) for j in range(200, 300)} | {(i, 500) for i in range(300)}
    assert got == want
    full = {tuple(r) for r in samelook.same_look_pairs(df, "id", "source", expanded=None).collect()}
    assert full == {(i, j) for i in range(200) for j in range(200, 300)} | {(i, 500) for i in range(300)}
    members = samelook.same_look_members(df, "id", "source").collect()
    assert len(members) == 301 and {r["class_id"] for r in members} == {0} and {r["copies"] for r in members} == {200, 100, 1}


def test_same_look_of_tokens_and_empty_table(spark):
    df = spark.createDataFrame([(1, ["قال", None, "x"]), (2, ["قال", "", "​x"]), (3, None), (4, [])], "pos_id long, tokens array<string>")
    assert rows(samelook.same_look_pairs(df, "pos_id", "tokens")) == [(1, 2)]
    assert rows(samelook.same_look_pairs(df.limit(0), "pos_id", "tokens")) == []


def test_word_rules():
    assert plain_words("«قال:» - 12 … أَحْمَد") == ["قال", "12", "احمد"]
    assert term("12") == "" and term("(أحمد)") == "احمد"
    assert normalize_text("  مكتبة على ") == "مكتبه علي"


def test_tokens_of_a_batch_against_plain_words():
    import pyarrow as pa

    random.seed(12)
    pool = ["قال", "قَال،", "a b", "", None, "—", "\u200b", "x\u2800y z", "\u00a0", "«عن»"]
    lists = [None if random.random() < 0.1 else [random.choice(pool) for _ in range(random.randint(0, 12))] for _ in range(200)]
    texts = [None if x is None else random.choice([" ", "\n", "\u3000 "]).join(t or "" for t in x) for x in lists]
    for rows, column in ((lists, pa.array(lists, pa.list_(pa.string()))), (texts, pa.array(texts)), (texts[40:160], pa.array(texts)[40:160]), (lists[40:160], pa.array(lists, pa.list_(pa.string()))[40:160])):
        stored = [" ".join(t or "" for t in x or []) if rows is lists or x is None or isinstance(x, list) else x for x in rows]
        assert stored_texts(column) == stored
        sizes, values, _ = Tokens(column).spread(lambda t: [len(w) for w in raw_words(t)])
        want = [[len(w) for w in raw_words(t)] for t in stored]
        assert sizes.tolist() == [len(w) for w in want] and values.tolist() == [n for w in want for n in w]


# --- pieces ----------------------------------------------------------------


def brute_class(tokens, limit):
    """Longest stretch of words without an end of a sentence, word by word."""
    longest = run = 0
    for token in tokens or []:
        for k, line in enumerate((token or "").split("\n")):
            if k:
                longest, run = max(longest, run), 0
            for word in line.split():
                if oneform.one_form(word):
                    run += 1
                    if oneform.one_form(word).rstrip("»)]")[-1:] in tuple(".؟?!۔"):
                        longest, run = max(longest, run), 0
    return max(longest, run) > limit


def test_pieces_against_brute_force(spark):
    random.seed(1)
    made = []
    for i in range(60):
        n = random.choice([0, 1, 5, 119, 120, 121, 130, 300, 1000])
        toks = [random.choice(["قال", "عن", "نافع،", "مالك.", "x؟»", "\n", "a b", None, "​", "َ"]) if random.random() < 0.3 else "w" for _ in range(n)]
        made.append((i, toks if n else random.choice([None, []]), random.choice([None, ["noun"] * n, ["noun"] * (n // 2)])))
    df = spark.createDataFrame(made, "pos_id long, tokens array<string>, tags array<string>").selectExpr("*", "1 as piece", "'x' as words")
    cut = pieces.split_pieces(df).orderBy("pos_id", "piece").collect()
    found = {r["pos_id"]: r["cut_class"] for r in pieces.oversized(df).collect()}
    for key, toks, tags in made:
        words = [w for t in toks or [] if t for w in t.split() if oneform.one_form(w)]
        mine = [r for r in cut if r["pos_id"] == key]
        assert all(0 < len(r["words"]) <= 120 and r["word_end"] - r["word_start"] == len(r["words"]) for r in mine)
        assert [w for k, r in enumerate(mine) for w in r["words"][10 if k else 0 :]] == words
        assert all(a["words"][-10:] == b["words"][:10] for a, b in zip(mine, mine[1:]))
        assert all((r["tags"] is None) == (tags is None) and (tags is None or len(r["tags"]) == len(r["words"])) for r in mine)
        assert found.get(key) == (None if len(words) <= 120 else "forced" if brute_class(toks, 120) else "natural")


def test_the_class_is_that_of_the_cutting():
    random.seed(9)
    for _ in range(400):
        n, limit = random.randint(1, 400), 120
        ends = sorted(random.sample(range(1, n + 1), min(n, random.choice([0, 1, 3, 8]))))
        longest = max(b - a for a, b in zip([0, *ends], [*ends, n]))
        assert pieces.cut_class(n, ends, limit) == ("forced" if longest > limit else "natural")


def test_cuts_are_natural_where_possible():
    assert pieces.cut_points(130, [50, 100, 130], 120, 10) == [(0, 100), (90, 130)]
    assert pieces.cut_points(130, [], 120, 10) == [(0, 120), (110, 130)]
    assert pieces.cut_points(0, [], 120, 10) == []
    with pytest.raises(ValueError):
        pieces.split_pieces(None, 10, 10)


def test_pieces_of_an_empty_table(spark):
    df = spark.createDataFrame([], "pos_id long, tokens array<string>, tags array<string>")
    assert pieces.split_pieces(df).count() == 0 and pieces.oversized(df).count() == 0


# --- terms -----------------------------------------------------------------


def brute_terms(made):
    total, held = Counter(), Counter()
    for toks, tags in made:
        words = [term(w) for t in toks or [] if t for w in t.split()]
        words = [("tokens", w) for w in words if w]
        labels = [("tags", (t or "").strip().lower()) for t in tags or []]
        labels = [x for x in labels if x[1]]
        total.update(words + labels)
        held.update(set(words + labels))
    return {k: (n, held[k]) for k, n in total.items()}


def test_term_frequencies_against_brute_force(spark):
    random.seed(2)
    pool = ["قال", "قَال", "عن،", "12", None, "", "a b", "​عن"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    made = [([random.choice(pool) for _ in range(random.randint(0, 30))] if random.random() > 0.1 else None, random.choice([None, ["Noun ", "noun", "", None], ["verb"]])) for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(made)], "pos_id long, tokens array<string>, tags array<string>").selectExpr("*", "1 as term", "2 as n_rows").repartition(5)
    want = brute_terms(made)
    for limit in (1_000_000, 40):  # in memory, and spilled several levels deep
        got = {(r["field"], r["term"]): (r["n_occurrences"], r["n_rows"]) for r in termfreq.term_frequencies(df, limit).collect()}
        assert got == want
    marked = {(r["field"], r["term"]): r["mark"] for r in termfreq.marked_terms(df).collect()}
    assert all(m == ("rare" if want[k][1] < 3 else "common" if want[k][1] > 0.45 * 300 else None) for k, m in marked.items())
    assert termfreq.marked_terms(df.limit(0)).count() == 0


# --- tokenizer -------------------------------------------------------------


@pytest.fixture(scope="module")
def tool():
    return bpe.automaton(bpe.ranks_path())


def peer(tool):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})


def test_encoding_equals_the_merge_rule(tool):
    random.seed(7)
    encoder = peer(tool)
    pool = ["قال", "حَدَّثَنَا", " ", "  ", "\n", "\r\n", "\t", "don't", "The", "123", "٤٥", "—", "📖", "ﷺ", "a" * 40, " ", "‏", "<|endoftext|>", "_x_", "...."]
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 30))) for _ in range(1500)] + ["ab" * 3000, "ا" * 3000, " " * 50]
    for text in texts:
        ids = tool.encode(text)
        assert ids == encoder.encode_ordinary(text)
        assert tool.decode(ids) == text


def test_a_full_table_starts_anew(tool):
    random.seed(17)
    small, encoder = bpe.TokenAutomaton(tool.ranks, most_steps=300), peer(tool)
    for _ in range(300):
        word = "".join(random.choice("abcالقوم٤ \n—") for _ in range(random.randint(1, 40)))
        assert [i for w in small._split(word) for i in small.encode_bytes(w.encode())] == encoder.encode_ordinary(word)
        assert len(small._steps) < 300 + 2 * 160


def test_the_automaton_has_one_path_only(tool):
    """Every pair of labels the merge rule gives is open, and a closed pair is never one it gives."""
    random.seed(8)
    for _ in range(3000):
        a, b = random.randrange(50256), random.randrange(50256)
        joint = tool._merge_below(tool.labels[a] + tool.labels[b], 1 << 60)
        while len(joint) == 2 and joint != [a, b] and tool._gadgets.get(tuple(joint)) is not None:
            joint = [tool._gadgets[tuple(joint)]]
        assert tool.is_open(a, b) == (joint == [a, b])


def test_documents_encode_and_come_back(spark):
    made = [(1, "قال مالك"), (2, ""), (3, None), (4, "a" * 100_000), (4, "قال مالك"), (None, "x")]
    df = spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "1 as ids", "'s' as source")
    out = bpe.encode_documents(df.drop("ids"))
    assert sorted((r["doc_id"] or -1, len(r["ids"])) for r in out.collect())[:4] == [(-1, 1), (1, len(bpe.automaton(bpe.ranks_path()).encode("قال مالك"))), (2, 0), (3, 0)]
    back = sorted((r["doc_id"] or -1, r["text"]) for r in bpe.decode_documents(out).collect())
    assert back == sorted((k or -1, t or "") for k, t in made)
    assert bpe.encode_documents(df.limit(0)).count() == 0
