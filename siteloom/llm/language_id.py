"""Language identification by interpolated Kneser-Ney character language models.

Texts become letter streams: lower-cased, each run of other characters one space. One
model per language gives every character a probability after the ``order - 1`` before it. The
n-grams of all languages lie in one sorted array of 64-bit hashes per order, with the
log-probabilities of the languages that have an n-gram beside it, so that a position of a text is
looked up once for all languages by binary search. The language with the lowest cross-entropy
per character wins.

Fitting takes a bounded sample of the labelled rows, cut to segments: of each language, segments are
drawn by a hash of their text at a rate that is expected to give ``max_chars`` characters, or
its share of ``max_total_chars`` where languages are many. Counting and estimating run in the
cluster, a task a language. What comes to the driver and goes to all workers is the model, of
at most ``order x max_total_chars`` entries (of which n-grams of the highest order that are rare
are left out beyond ``max_entries``), whatever the input's size.

A quarter of the rows, never all of a language, is held back. Their segments calibrate the score,
and the rejection: limits are set above what all held-back segments have but for a stated share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm import common

UNKNOWN = "und"
ORDER = 4
#: The bound of the sample, in characters: of a language, and of all together.
MAX_CHARS = 2_000_000
MAX_TOTAL_CHARS = 48_000_000
#: Entries (language and n-gram) of a model, about 20 bytes each.
MAX_ENTRIES = 12_000_000
SEGMENT_CHARS = 2_000
#: Of a language with fewer held-back segments, the limits of all languages together hold.
LEAST_HELD_BACK = 20
#: The limit lies by this factor above the excess that REJECT_SHARE of the held-back segments exceed.
REJECT_SHARE, REJECT_FACTOR = 1e-3, 2.0
#: Characters that are scored at once, and rows that are read at once.
SEGMENT = 1 << 18
ROWS = 250
#: Cells (n-gram and language) of a table that is filled in once instead of per batch.
DENSE_CELLS = 1 << 24
TEMPERATURES = np.geomspace(0.2, 20, 30)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> np.ndarray:
    """The letter stream as code points, with a space before and after; empty if no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(codes, return_inverse=True) if len(codes) < 512 else _kinds(codes)
    is_letter = np.fromiter((chr(x).isalpha() for x in kinds), bool, len(kinds))[at]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(is_letter, codes, np.uint32(32))
    stay = is_letter.copy()
    stay[1:] |= is_letter[:-1]  # a space stays after a letter only
    codes = codes[stay]
    lead = np.array([32], np.uint32)
    return np.concatenate((lead, codes) if codes[-1] == 32 else (lead, codes, lead))


def _kinds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    kinds = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[codes]


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n-gram that ends at each position from n - 1 on."""
    value = codes.astype(np.uint64) + np.uint64(1)
    found = [_mixed(value)]
    rolled = value
    for n in range(2, order + 1):
        rolled = rolled[:-1] * _MULTIPLIER + value[n - 1 :]
        found.append(_mixed(rolled))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


@dataclass
class Grams:
    """The n-grams of one order: sorted hashes; rows of the n-gram without its first and without
    its last character one order below (-1: none); and the entries of each, by language."""

    hashes: np.ndarray
    suffix: np.ndarray
    context: np.ndarray
    #: Entries of n-gram i are at starts[i] to starts[i + 1].
    starts: np.ndarray
    lang: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    filled: tuple[np.ndarray, np.ndarray] | None = None


@dataclass
class Model:
    """``grams[n - 1]`` of each order n; ``unseen`` is the log-probability of a character never met.

    A language's cross-entropy is over its limit if it exceeds ``mean`` by ``reach`` times the noise
    that ``spread`` and, for short texts, ``per_char`` tell.
    """

    languages: list[str]
    order: int
    grams: list[Grams] = field(default_factory=list)
    unseen: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    per_char: np.ndarray | None = None
    reach: float = np.inf
    temperature: float = 1.0

    def _values(self, n: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability and back-off weight of n-grams, a row each and a column per language."""
        k = len(self.languages)
        if n == 0:
            return np.broadcast_to(self.unseen, (len(rows), k)), np.zeros((len(rows), k), np.float32)
        own = self.grams[n - 1]
        if own.filled:
            return own.filled[0][rows], own.filled[1][rows]
        sizes = own.starts[rows + 1] - own.starts[rows]
        at = np.repeat(own.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        row, lang = np.repeat(np.arange(len(rows)), sizes), own.lang[at]
        left = np.zeros((len(rows), k), np.float32)
        left[row, lang] = own.backoff[at]
        # Languages without the n-gram have it by backing off.
        out = self._backed_off(n, own.suffix[rows], own.context[rows])
        out[row, lang] = own.logp[at]
        return out, left

    def _backed_off(self, n: int, suffix: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The log-probability of n-grams that a language hasn't seen, by their suffix and context."""
        out = np.empty((len(suffix), len(self.languages)), np.float32)
        known = suffix >= 0
        if n == 1:
            out[:] = self.unseen
        else:
            out[known] = self._values(n - 1, suffix[known])[0]
            out[~known] = self.unseen
            seen = context >= 0
            out[seen] += self._values(n - 1, context[seen])[1]
        return out

    def fill(self) -> None:
        """Fill in the tables of the lower orders first, as far as they are of bounded size."""
        for n, own in enumerate(self.grams, 1):
            if own.filled is None and len(own.hashes) * len(self.languages) <= DENSE_CELLS:
                own.filled = self._values(n, np.arange(len(own.hashes)))

    def _log_probability(self, hashes: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        """Of the n-grams that end at the positions ``at``, by language."""
        if n == 0:
            return np.broadcast_to(self.unseen, (len(at), len(self.languages)))
        own = self.grams[n - 1]
        row = _find(own.hashes, hashes[n - 1][at - (n - 1)])
        out = np.empty((len(at), len(self.languages)), np.float32)
        hit = row >= 0
        if own.filled:
            out[hit] = own.filled[0][row[hit]]
        else:
            some, where = np.unique(row[hit], return_inverse=True)
            out[hit] = self._values(n, some)[0][where]
        if not hit.all():
            rest = at[~hit]
            out[~hit] = self._log_probability(hashes, rest, n - 1)
            if n > 1:
                context = _find(self.grams[n - 2].hashes, hashes[n - 2][rest - 1 - (n - 2)])
                known = context >= 0
                out[np.flatnonzero(~hit)[known]] += self._values(n - 1, context[known])[1]
        return out

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Nats per character, a row per letter stream and a column per language."""
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([max(0, len(x) - 1) for x in texts])
        most = max(1 << 12, SEGMENT // max(1, len(self.languages) // 8))
        first = 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars + len(texts[last]) <= most):
                chars += len(texts[last])
                last += 1
            if chars > most:
                total[first] = sum(self._sums([part], overlap)[0] for part, overlap in self._parts(texts[first], most))
            else:
                total[first:last] = self._sums(texts[first:last], 1)
            first = last
        return -total / np.maximum(sizes, 1)[:, None]

    def _parts(self, codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
        """Parts of a long stream, with how many characters of each only give context."""
        yield codes[:most], 1
        for at in range(most, len(codes), most):
            yield codes[at - self.order + 1 : at + most], self.order - 1

    def _sums(self, texts: list[np.ndarray], context: int) -> np.ndarray:
        """Summed log-probabilities of all characters of each text but its first ``context``."""
        sizes = np.array([len(x) for x in texts])
        ends = np.cumsum(sizes)
        codes = np.concatenate(texts)
        if not len(codes):
            return np.zeros((len(texts), len(self.languages)))
        hashes = gram_hashes(codes, min(self.order, len(codes)))
        position = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        scores = np.zeros((len(codes), len(self.languages)), np.float32)
        # The first characters of a text have less before them.
        for n in range(2, self.order + 1):
            here = position >= n - 1 if n == self.order else position == n - 1
            at = np.flatnonzero(here & (position >= context))
            if len(at):
                scores[at] = self._log_probability(hashes, at, n)
        running = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)))
        return running[ends] - running[ends - sizes]

    def excess(self, lang: np.ndarray, entropy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By how many deviations cross-entropies lie above those of a language's own texts."""
        noise = np.sqrt(self.spread[lang] ** 2 + self.per_char[lang] ** 2 / np.maximum(sizes, 1))
        return (entropy - self.mean[lang]) / noise

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in [0, 1] and whether rejected, of each text."""
        streams = [letters(x) for x in texts]
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        some = [i for i, x in enumerate(streams) if len(x)]
        if not some or not self.languages:
            return names, scores, rejected
        found = self.cross_entropies([streams[i] for i in some])
        sizes = np.array([len(streams[i]) - 1 for i in some])
        best = found.argmin(1)
        scores[some] = confidence(found, sizes, self.temperature)
        if self.mean is None:
            rejected[some] = False
        else:
            rejected[some] = self.excess(best, found[np.arange(len(some)), best], sizes) > self.reach
        for i, k in zip(some, best, strict=True):
            names[i] = self.languages[k]
        return names, scores, rejected


def confidence(entropies: np.ndarray, sizes: np.ndarray, temperature: float) -> np.ndarray:
    """Share of the best language if each weighs exp(-entropy x sqrt(size) / temperature)."""
    gap = (entropies - entropies.min(1, keepdims=True)) * np.sqrt(sizes)[:, None] / temperature
    return 1 / np.exp(-np.minimum(gap, 700)).sum(1)


# Fitting


def _counts(order: int):
    """Reads (lang, text); yields (lang, gram, c), summed over what a task reads."""

    def flush(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.record_batch(
            {
                "lang": pa.array([k[0] for k in keys], pa.string()),
                "gram": pa.array([k[1] for k in keys], pa.string()),
                "c": pa.array(list(counts.values()), pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                stream = letters(text).tobytes().decode("utf-32-le", "surrogatepass")
                # The space that leads a text is context only, so no gram of one counts it.
                for n in range(1, order + 1):
                    for gram, c in Counter(map("".join, zip(*(stream[i + (n == 1) :] for i in range(n)), strict=False))).items():
                        counts[lang, gram] += c
                if len(counts) > 200_000:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    return run


def kneser_ney(grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int, cutoff: int = 1) -> Iterator[tuple]:
    """(n, hashes, suffixes, contexts, logp, backoff) of each order of one language.

    ``grams`` holds, for n = 1, 2, ..., the hashes of the n-grams, of their suffixes and contexts, and
    their counts. Below the highest order a gram counts the different characters that it follows, in place
    of how often it occurs. Of the highest order, grams that occur less than ``cutoff`` times are left
    out, and what they weigh goes to the back-off. Order 0 is the weight of a character never met.
    """
    below_hashes, below = np.empty(0, np.uint64), np.empty(0)
    found = []
    for n, (hashes, suffix, context, counts) in enumerate(grams, 1):
        by_hash = np.argsort(hashes)
        hashes, suffix, context, counts = hashes[by_hash], suffix[by_hash], context[by_hash], counts[by_hash].astype(float)
        if n < len(grams):
            wider, kinds = np.unique(grams[n][1], return_counts=True)
            at = _find(wider, hashes)
            counts = np.where(at >= 0, kinds[at], 1.0) if len(kinds) else np.ones(len(hashes))
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        kept = counts >= cutoff if n == len(grams) and n > 1 else np.ones(len(hashes), bool)
        heads, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, counts, len(heads))
        left = np.bincount(at, np.where(kept, discount, counts), len(heads)) / total
        lower = np.full(len(hashes), 1 / alphabet)
        if n > 1:
            place = _find(below_hashes, suffix)
            lower[place >= 0] = below[place[place >= 0]]
        p = (counts - discount) / total[at] + left[at] * lower
        if n > 1:  # what a gram of the order below leaves, as a context
            place = _find(heads, below_hashes)
            found[-1][5][place >= 0] = np.log(left[place[place >= 0]])
        else:
            weight = max(float(left[0]) if len(left) else 1.0, 1e-4) / alphabet
        below_hashes, below = hashes[kept], p[kept]
        found.append((n, hashes[kept], suffix[kept], context[kept], np.log(below), np.zeros(len(below))))
    none = np.zeros(1, np.uint64)
    yield 0, none, none, none, np.log(np.array([weight])), np.zeros(1)
    yield from found


ENTRIES = "lang string, n int, hash long, suffix long, context long, logp float, backoff float"


def _estimate(order: int, alphabet: int, cutoff: int):
    """One language's (gram, c) to its ENTRIES."""

    def run(group: pa.Table) -> pa.Table:
        lang = group["lang"][0].as_py()
        texts, counts = group["gram"].to_pylist(), group["c"].to_numpy()
        size = np.array([len(x) for x in texts])
        grams = []
        for n in range(1, order + 1):
            at = np.flatnonzero(size == n)
            codes = np.frombuffer("".join([texts[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            rolled = lambda part: _mixed(_rolled(part))
            grams.append((rolled(codes), rolled(codes[:, 1:]), rolled(codes[:, :-1]), counts[at]))
        parts = []
        for n, hashes, suffix, context, logp, backoff in kneser_ney(grams, alphabet, cutoff):
            columns = {"lang": pa.array([lang] * len(hashes), pa.string()), "n": pa.array(np.full(len(hashes), n, np.int32))}
            columns |= {k: pa.array(x.view(np.int64)) for k, x in (("hash", hashes), ("suffix", suffix), ("context", context))}
            columns |= {k: pa.array(x.astype(np.float32)) for k, x in (("logp", logp), ("backoff", backoff))}
            parts.append(pa.table(columns))
        return pa.concat_tables(parts)

    return run


def _rolled(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of code points before mixing, as in ``gram_hashes``."""
    out = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        out = out * _MULTIPLIER + (column.astype(np.uint64) + np.uint64(1))
    return out


def _assembled(entries: pa.Table, order: int) -> Model:
    languages = sorted(entries["lang"].unique().to_pylist())
    model = Model(languages, order)
    coded = entries["lang"].combine_chunks().dictionary_encode()
    place = np.array([languages.index(x) for x in coded.dictionary.to_pylist()], np.int32)
    lang, n = place[coded.indices.to_numpy()], entries["n"].to_numpy()
    logp, backoff = (entries[x].to_numpy() for x in ("logp", "backoff"))
    hashes, suffixes, contexts = (entries[x].to_numpy().view(np.uint64) for x in ("hash", "suffix", "context"))
    model.unseen = np.zeros(len(languages), np.float32)
    model.unseen[lang[n == 0]] = logp[n == 0]
    for k in range(1, order + 1):
        at = np.flatnonzero(n == k)
        at = at[np.lexsort((lang[at], hashes[at]))]
        own, first = np.unique(hashes[at], return_index=True)
        starts = np.append(first, len(at))
        below = model.grams[-1].hashes if k > 1 else np.empty(0, np.uint64)
        suffix, context = (_find(below, x[at[first]]).astype(np.int32) for x in (suffixes, contexts))
        model.grams.append(Grams(own, suffix, context, starts, lang[at].astype(np.int32), logp[at], backoff[at]))
    return model


def _unit(salt: str, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 30)) / F.lit(1 << 30)


def _sample(rows: DataFrame, max_chars: int, max_total_chars: int) -> DataFrame:
    """(lang, text, held): drawn segments of ``rows`` (key, text, lang), stored."""
    size = F.greatest(F.char_length("text"), F.lit(1))
    unit = _unit("calibrate", F.col("key"), F.col("text"))
    told = rows.groupBy("lang").agg(F.sum(size).alias("chars"), F.max(unit).alias("top"))
    told = common.materialize(told, "language-rates")
    most = min(max_chars, max_total_chars // max(1, told.count()))
    # The row of the highest number is never held back, so every language is learned.
    rates = told.select("lang", F.least(F.lit(1.0), F.lit(float(most)) / F.col("chars")).alias("rate"), F.least(F.lit(0.25), "top").alias("held_below"))
    segments = F.sequence(F.lit(0), F.floor((size - 1) / SEGMENT_CHARS).cast("int"))
    drawn = F.filter(segments, lambda i: _unit("draw", F.col("key"), F.col("digest"), i) < F.col("rate"))
    # One short row a language; Spark sends a table as small as that to the texts.
    found = rows.join(common.materialize(rates, "language-rates"), "lang").withColumn("digest", F.xxhash64("text"))
    found = found.select("lang", "text", (unit < F.col("held_below")).alias("held"), F.explode(drawn).alias("i"))
    part = F.substring(F.col("text"), F.col("i") * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS))
    return common.materialize(found.select("lang", part.alias("text"), "held"), "language-sample")


def _scored(shared):
    """Held-back segments to their (lang, size, entropy of that language, losses by temperature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(shared)
        places = {x: i for i, x in enumerate(model.languages)}
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            rows = [(places[x], letters(t)) for x, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) if x in places]
            rows = [x for x in rows if len(x[1])]
            if not rows:
                continue
            truth, sizes = np.array([x[0] for x in rows]), np.array([len(x[1]) - 1 for x in rows])
            found = model.cross_entropies([x[1] for x in rows])
            right = found.argmin(1) == truth
            losses = []
            for t in TEMPERATURES:
                p = np.clip(confidence(found, sizes, t), 1e-6, 1 - 1e-6)
                losses.append(-np.where(right, np.log(p), np.log(1 - p)))
            yield pa.record_batch(
                {
                    "lang": pa.array(truth, pa.int32()),
                    "size": pa.array(sizes, pa.int64()),
                    "entropy": pa.array(found[np.arange(len(rows)), truth], pa.float64()),
                    "losses": pa.array(np.array(losses).T.tolist(), pa.list_(pa.float64())),
                }
            )

    return run


def _calibrate(model: Model, held_back: DataFrame) -> None:
    """Sets the temperature, and the limits by language from the held-back segments."""
    shared = held_back.sparkSession.sparkContext.broadcast(model)
    scored = held_back.select("lang", "text").mapInArrow(_scored(shared), "lang int, size long, entropy double, losses array<double>").toArrow()
    shared.destroy()
    if not len(scored):
        return
    lang, sizes, entropy = (scored[x].to_numpy() for x in ("lang", "size", "entropy"))
    losses = scored["losses"].combine_chunks().values.to_numpy().reshape(len(lang), -1)
    model.temperature = float(TEMPERATURES[int(losses.mean(0).argmin())])

    def told(at: np.ndarray) -> tuple[float, float, float]:
        off = entropy[at] - entropy[at].mean()
        return entropy[at].mean(), max(off.std(), 1e-3), max(1.0, float(np.sqrt((off**2 * sizes[at]).mean())))

    k = len(model.languages)
    model.mean, model.spread, model.per_char = np.empty(k), np.empty(k), np.empty(k)
    for i in range(k):
        own = np.flatnonzero(lang == i)
        limits = told(own if len(own) >= LEAST_HELD_BACK else np.arange(len(lang)))
        model.mean[i], model.spread[i], model.per_char[i] = limits
    excess = model.excess(lang, entropy, sizes)
    model.reach = max(4.0, REJECT_FACTOR * float(np.quantile(excess, 1 - REJECT_SHARE)))


def _cutoff(counted: DataFrame, over: int, most: int = 1000) -> int:
    """The least count for which leaving out rarer n-grams leaves out ``over`` of them or more, ``most`` at most."""
    rows = counted.groupBy(F.least("c", F.lit(most)).alias("c")).agg(F.count("*").alias("n")).orderBy("c").collect()
    for x in rows:
        over -= x.n
        if over <= 0:
            return min(x.c + 1, most)
    return most


def fit(
    labelled: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    max_chars: int = MAX_CHARS,
    max_total_chars: int = MAX_TOTAL_CHARS,
    max_entries: int = MAX_ENTRIES,
) -> Model:
    """A model of all languages in ``labelled``; rows without text or language are left out.

    Each language has some text to learn from, also if it has one row only. Without any row the model has no
    language. Equal rows are drawn together.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = _sample(rows.filter("text is not null and lang is not null"), max_chars, max_total_chars)
    counted = sample.filter("not held").select("lang", "text").mapInArrow(_counts(order), "lang string, gram string, c long")
    counted = common.materialize(counted.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "language-grams")
    whole = F.char_length("gram") == order
    n, alphabet = counted.agg(F.count("*"), F.count_distinct(F.when(F.char_length("gram") == 1, F.col("gram")))).first()
    cutoff = _cutoff(counted.filter(whole), n - max_entries) if n > max_entries else 1
    entries = counted.groupBy("lang").applyInArrow(_estimate(order, alphabet + 1, cutoff), ENTRIES)
    model = _assembled(entries.toArrow(), order)
    if model.languages:
        _calibrate(model, sample.filter("held"))
    return model


_READY: dict[int, Model] = {}


def _ready(shared) -> Model:
    """The worker's model, its tables filled in once."""
    model = shared.value
    if id(model) not in _READY:
        _READY.clear()
        model.fill()
        _READY[id(model)] = model
    return model


def _predict(shared, columns: list[tuple[int, str]], text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(shared)
        for batch in batches:
            found = [model.predict(batch.column(text).slice(at, ROWS).to_pylist()) for at in range(0, len(batch), ROWS)]
            names = [x for part in found for x in part[0]]
            scores, rejected = (np.concatenate([part[i] for part in found] or [np.empty(0)]) for i in (1, 2))
            kept = [batch.column(i) for i, _ in columns]
            told = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected.astype(bool), pa.bool_())]
            yield pa.RecordBatch.from_arrays(kept + told, [x for _, x in columns] + ["lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred, score (0 to 1) and rejected (boolean) of each row.

    Kept columns of these three names are replaced. A null text, or one without any letter, is ``und``
    with score 0 and is rejected, and so is every text if the model knows no language. Other texts get a
    learned language; they are rejected if their cross-entropy is above the limit of that language, which
    no language has if none of its rows was held back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in ("lang_pred", "score", "rejected")]
    told = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept), *told).schema
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*kept, text))))
    return rows.mapInArrow(_predict(shared, list(enumerate(kept)), rows.columns.index(text)), schema)
