"""White-space tokens, their offsets, blocks of them, and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sahifa.functions import charclasses as C
from sahifa.functions.text import strip_diacritics


def words(text: Column) -> Column:
    """Maximal runs of visible characters; white space is what Unicode says it is."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{C.NONWS}+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{C.NONWS}+"))


def tokens(text: Column) -> Column:
    """``array<struct<idx, text, start, end>>`` with code-point offsets, ends exclusive.

    Lengths of the words with the blanks before them, added up, give the ends
    (regular-expression positions would count UTF-16 units).
    """
    whole = F.coalesce(text, F.lit(""))
    lengths = F.transform(F.regexp_extract_all(whole, F.lit(f"{C.WS}*{C.NONWS}+"), F.lit(0)), lambda piece: F.length(piece))
    return F.transform(
        F.arrays_zip(words(text).alias("w"), running_sums(lengths).alias("e")),
        lambda x, i: F.named_struct(F.lit("idx"), i, F.lit("text"), x["w"], F.lit("start"), x["e"] - F.length(x["w"]), F.lit("end"), x["e"]),
    )


RUN = 512


def _sums(numbers: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, n: Column) -> Column:
        return F.named_struct(F.lit("at"), state["at"] + n, F.lit("ends"), F.array_append(state["ends"], state["at"] + n))

    return F.aggregate(numbers, start, step, lambda state: state["ends"])


def running_sums(numbers: Column) -> Column:
    """Running sums of ``array<int>``.

    A fold that appends copies what it has, so a longer array is cut into runs of ``RUN``: sums
    within each, and sums of the runs before it. Very long texts cost about in proportion.
    """

    def of_runs(x: Column) -> Column:
        totals = F.transform(x["runs"], lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n))
        before = let(lambda y: F.zip_with(_sums(y["totals"]), y["totals"], lambda upto, own: upto - own), totals=totals)
        return F.flatten(F.zip_with(x["runs"], before, lambda run, base: F.transform(_sums(run), lambda n: n + base)))

    return let(lambda x: F.when(F.size(x["n"]) <= RUN, _sums(x["n"])).otherwise(let(of_runs, runs=blocks(x["n"], RUN))), n=numbers)


def let(body, **values: Column) -> Column:
    """``body(bound)`` with each value evaluated once: a lambda over an array of one struct.

    Expressions that a lambda takes from outside are evaluated again for each element, and a
    column that is used several times is inlined each time; a bound value is neither.
    """
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def explode_once(df: DataFrame, columns: list, array: Column, name: str) -> DataFrame:
    """Explodes an array that is expensive to make; the filter Spark infers for a plain explode would make it again."""
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def beside(items: Column, **values: Column) -> Column:
    """``array<struct<item, values...>>``: each item with the same values.

    A lambda evaluates what it takes from outside once per element; values handed over this way
    are evaluated once per row (the repeated array holds references).
    """
    repeated = [F.array_repeat(v, F.size(items)).alias(k) for k, v in values.items()]
    return F.arrays_zip(items.alias("item"), *repeated)


def blocks(items: Column, size: int) -> Column:
    """Consecutive blocks of ``size`` items without overlap; none for an empty array."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(beside(starts, of=items), lambda x: F.slice(x["of"], x["item"] + 1, F.lit(size)))


def pack(items: Column, limit: int) -> Column:
    """Greedy packing of words into windows; a window and the blank after it stay within ``limit``.

    A window is flushed when the next word and its blank would not fit, so a window of several
    words has at most ``limit - 1`` characters; a longer word stands alone.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, word: Column) -> Column:
        fits = F.length(state["open"]) + F.length(word) + 2 <= limit
        return (
            F.when(state["open"].isNull(), F.struct(state["done"].alias("done"), word.alias("open")))
            .when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit(" "), word).alias("open")))
            .otherwise(F.struct(F.array_append(state["done"], state["open"]).alias("done"), word.alias("open")))
        )

    return F.aggregate(items, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def windows(text: Column, limit: int = 380) -> Column:
    return pack(words(text), limit)


def wrap_words(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters; an overlong word stands alone; an empty text gives one empty line."""
    packed = pack(words(text), width + 1)
    return F.when(F.size(packed) == 0, F.array(F.lit(""))).otherwise(packed)


def encoder_words(items: Column) -> Column:
    """Words as a structure encoder reads them: marks and kashida stripped, the words themselves untouched elsewhere."""
    return F.transform(items, strip_diacritics)


def context_chunks(items: Column, limit: int = 380) -> Column:
    """``array<array<string>>``: bare words packed like :func:`pack`, kept apart: the context in which a diacritizer reads them."""
    return F.transform(pack(items, limit), lambda chunk: F.split(chunk, " ", -1))


def encode(items: Column, vocabulary: Column, unknown: int = 1) -> Column:
    """Ids of items by a ``map<string,int>``."""
    return F.transform(items, lambda x: F.coalesce(F.element_at(vocabulary, x), F.lit(unknown)))


def encode_word_chars(items: Column, vocabulary: Column, max_chars: int = 18) -> Column:
    """Character ids of each word's first ``max_chars`` characters; an empty word is one unknown."""

    def one(word: Column) -> Column:
        chars = F.regexp_extract_all(F.substring(word, 1, max_chars), F.lit("(?s)."), F.lit(0))
        return F.when(F.size(chars) == 0, F.array(F.lit(1))).otherwise(encode(chars, vocabulary))

    return F.transform(items, one)


def pad(ids: Column, length: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def pad_words(words: Column, max_words: Column, max_chars: Column, value: int = 0) -> Column:
    """``array<array<int>>`` of character ids filled up to ``max_words`` words of ``max_chars`` characters."""
    filled = F.transform(beside(words, size=max_chars), lambda x: pad(x["item"], x["size"], value))
    empty = F.array_repeat(F.lit(value), max_chars)
    return F.concat(filled, F.array_repeat(empty, F.greatest(max_words - F.size(words), F.lit(0))))


def char_tags(bare: Column, tags: Column, missing: str = "x") -> Column:
    """The tag of each character's word. The word counter goes up at each plain space and at nothing else."""
    text = F.coalesce(bare, F.lit(""))
    pieces = F.split(text, " ", -1)
    # a word's tag stands for its characters and for the space after it
    each = F.transform(
        beside(pieces, of=tags),
        lambda x, i: F.array_repeat(F.when(i < F.size(x["of"]), F.get(x["of"], i)).otherwise(missing), F.length(x["item"]) + 1),
    )
    return F.slice(F.flatten(each), F.lit(1), F.length(text))


def fit_tags(tags: Column, n: Column, overflow: str, max_words: int = 120) -> Column:
    """Tags cut at ``max_words`` and filled up to ``n`` with ``overflow``."""
    cut = F.slice(tags, F.lit(1), F.least(n, F.lit(max_words)))
    return F.concat(cut, F.array_repeat(F.lit(overflow), F.greatest(n - F.size(cut), F.lit(0))))
