"""Spelling variants: words that differ by one code point, found by PartEnum signatures.

A word's letters are a multiset, that is a binary vector with a bit for each (letter, occurrence).
One inserted or deleted letter changes one bit, one replaced letter two, so near words have
vectors within Hamming distance two. Partition and enumerate: letters are dealt to ``PARTS`` parts, and
for each two parts that could hold the difference there is a signature of all others, which agree.

A word of syllables has many near anagrams, so every signature is joined to a half of the word: the
difference lies in one half, and the other is the same in both. For words of lengths L and L
or L + 1, the halves are the first L div 2 and the last L - L div 2 letters.

Words are equi-joined on their signatures and verified there. Of the signatures that a pair shares, only the
first brings it forth, so that pairs need not be made distinct.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm import common

PARTS, DROPPED = 4, 2
#: Bits of a part's hash that its word carries along.
BITS = 16
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 19

_DROPS = list(combinations(range(PARTS), DROPPED))
#: Latin-1 bytes to themselves, with A-Z lower-cased, and to spaces where no letter of a run.
_RUNS = bytes(x if x in range(97, 123) or x >= 0xC0 else x + 32 if x in range(65, 91) else 32 for x in range(256))


def runs(text: str | None) -> list[bytes]:
    """The maximal runs [A-Za-z\\u00C0-\\u00FF]+ in Latin-1, A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_RUNS).split()


def slipped(run: bytes, prefix: int, every: int) -> bytes:
    """The run without one letter, where its checksum, continued from ``prefix``, is a multiple of ``every``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, every: int | None):
    def told(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array([x.decode("latin-1") for x in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                prefix = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(runs(text.as_py())).items():
                    own = word if every is None else slipped(word, prefix, every)
                    if len(own) >= least:
                        held[own] = held.get(own, 0) + n
                if len(held) >= HELD_WORDS:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    return run


def words(docs: DataFrame, *, id: str = "doc_id", text: str = "text", letters: int = 5, least: int = 3, slips: int | None = None) -> DataFrame:
    """(word, n): words of at least ``letters`` code points with at least ``least`` occurrences in all texts.

    With ``slips``, runs lose a letter by chance: of the crc32 h of ``<id>:<run>`` in UTF-8, where ``slips``
    divides h, the letter at h modulo the run's length. A null id counts as the empty string there. Null and
    empty texts have no words, repeated rows count again, an empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(_counted(letters, slips), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _shifted(part: int) -> int:
    return part * BITS


def _signatures(vocabulary: DataFrame) -> DataFrame:
    """(key, word, n, parts, role, kind, drop, half) rows; ``role`` 1 is that of the longer word of two lengths."""
    letters = F.array_sort(F.split("word", ""))
    hashed = lambda j: F.xxhash64(F.filter(letters, lambda c: F.ascii(c) % PARTS == j)).bitwiseAND((1 << BITS) - 1)
    packed = hashed(0)
    for j in range(1, PARTS):
        packed = packed.bitwiseOR(F.shiftleft(hashed(j), _shifted(j)))
    rows = vocabulary.select("word", "n", packed.alias("parts"), F.char_length("word").alias("size"))
    shapes = []
    for role in (0, 1):
        shorter = F.col("size") - role
        left = F.shiftright(shorter, 1)
        right = shorter - left
        halves = (F.substring("word", F.lit(1), left), F.substring(F.col("word"), F.col("size") - right + 1, right))
        for kind, half in enumerate(halves):
            for drop, parts in enumerate(_DROPS):
                key = F.xxhash64(F.lit(kind), F.lit(drop), shorter, half, F.col("parts").bitwiseAND(F.lit(_kept(parts))))
                shapes.append(F.struct(key.alias("key"), F.lit(role << 4 | kind << 3 | drop).cast("byte").alias("tag")))
    return rows.select("word", "n", "parts", F.explode(F.array(*shapes)).alias("s")).select("s.key", "word", "n", "parts", "s.tag")


def _kept(dropped: tuple[int, ...]) -> int:
    """The bits of all other parts, as a signed 64-bit number."""
    mask = sum(((1 << BITS) - 1) << _shifted(j) for j in range(PARTS) if j not in dropped)
    return mask - (1 << 64) if mask >> 63 else mask


def _first_drop(differ: Column) -> Column:
    """The number of the first signature that leaves out all parts in which ``differ`` has bits; null if none does."""
    found = F.lit(None).cast("int")
    for drop in reversed(range(len(_DROPS))):
        found = F.when(differ.bitwiseAND(F.lit(_kept(_DROPS[drop]))) == 0, drop).otherwise(found)
    return found


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each two words of ``vocabulary`` (word, n) with one code point inserted, deleted or replaced, once."""
    rows = _signatures(vocabulary)
    low, high = (rows.select(*(F.col(c).alias(f"{c}_{x}") for c in rows.columns)) for x in "ab")
    of = F.col("tag_a").bitwiseAND(7)
    size = F.char_length("word_a")
    left = F.shiftright(size, 1)
    starts = F.substring("word_a", F.lit(1), left) == F.substring("word_b", F.lit(1), left)
    ends = F.substring("word_a", left + 1, size - left) == F.substring(F.col("word_b"), F.char_length("word_b") - (size - left) + 1, size - left)
    by_start = F.col("tag_a").bitwiseAND(8) == 0
    longer = F.col("tag_b") >= 16
    # A pair within two lengths meets as shorter and longer, one of equal lengths in the order of its words.
    once = (
        (F.col("tag_a") == F.col("tag_b").bitwiseAND(15))
        & F.when(longer, F.char_length("word_b") == size + 1).otherwise((F.char_length("word_b") == size) & (F.col("word_a") < F.col("word_b")))
        & (_first_drop(F.col("parts_a").bitwiseXOR(F.col("parts_b"))) == of)
        & F.when(by_start, starts).otherwise(ends & ~starts)
        & (F.levenshtein("word_a", "word_b", 1) == 1)
    )
    # The exploded signatures are far larger than the file they come from, by which Spark would send them to all workers.
    found = low.filter("tag_a < 16").hint("merge").join(high, (F.col("key_a") == F.col("key_b")) & once)
    return found.select(F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of each word of ``forms`` (word, form) end.

    Each round doubles the links that words have followed; words that have come to an end take no part any more.
    """
    edges = forms.select("word", F.col("form").alias("to"), F.lit(False).alias("done"))
    while True:
        edges = common.materialize(edges, "spelling-links")
        open_ = edges.filter("not done")
        if open_.isEmpty():
            return edges.select("word", F.col("to").alias("root"))
        ahead = edges.select(F.col("word").alias("at"), F.col("to").alias("next"))
        moved = open_.join(ahead, F.col("to") == F.col("at"), "left")
        moved = moved.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNull().alias("done"))
        edges = moved.unionAll(edges.filter("done"))


def variants(vocabulary: DataFrame) -> DataFrame:
    """One row per row of ``vocabulary`` (word, n, words distinct): word, form, root, n, n_near, form_n.

    The form is the near word of largest n, of equals the smallest in code-point order, if it has twice the
    word's n at least. ``root`` is where the forms end, the word itself without any. Null words take no part.
    Other columns of ``vocabulary`` are left out; an empty one gives an empty result.
    """
    rows = common.materialize(vocabulary.select("word", "n").filter("word is not null"), "spelling-words")
    pairs = common.materialize(near_pairs(rows), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    # The smallest struct: largest n first, then the smallest word.
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    top = -F.col("best.less")
    twice = top >= 2 * F.col("n")
    found = rows.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(twice, F.col("best.near")).alias("form"),
        F.when(twice, top).alias("form_n"),
    )
    found = common.materialize(found, "spelling-forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
