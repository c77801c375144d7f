"""Near-duplicates by the Jaccard similarity of five-word shingle sets.

Candidates come from SimHash: fingerprints of the shingle sets that differ in at most 3 of 64 bits meet in the balls
of ``simhash``, and each of their components is a key that its texts share. Every candidate is verified on the whole
shingle sets.

A pair of similarity 0.8 differs in about 10 bits, too far for balls. Such pairs get min-wise keys beside the
fingerprint's: 24 a text, each over four minima. A pair of similarity 0.8 shares none of these with
chance (1 - 0.8^4)^24, about 3 in a million, and less above.

Texts that share a key are linked, or verified not to be, by ``similar_components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import common, simhash
from siteloom.operators.components import similar_components

WORDS = 5
LEAST = Fraction(4, 5)
KEYS, MINIMA = 24, 4
#: Shingles that are hashed at a time, and rows that are held at a time.
BLOCK, ROWS = 1 << 12, 500

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, KEYS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, KEYS * MINIMA, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles of a text; of all its words, if fewer than a shingle.

    ASCII letters are lower-cased, words are split at ASCII white space.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    width = min(words, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1].tolist()
    hash64 = xxhash.xxh64_intdigest
    found = (hash64(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(found, np.uint64, len(starts)))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def _keys(own: np.ndarray) -> np.ndarray:
    low = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        mixed = (own[at : at + BLOCK, None] ^ _MASKS) * _FACTORS
        np.minimum(low, mixed.min(axis=0), out=low)
    rows = low.reshape(KEYS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(rows)], np.uint64).view(np.int64)


def _sketches(words: int, minwise: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            sets = [shingles(x.as_py(), words) for x in batch["text"]]
            nodes = np.array([_node(x) for x in sets], np.uint64).view(np.int64)
            prints = np.array([simhash.fingerprint_of(x) for x in sets], np.uint64).view(np.int64)
            keys = [_keys(x)[:minwise] if minwise and len(x) else [] for x in sets]
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "digest": batch["digest"],
                    "node": pa.array(nodes, pa.int64()),
                    "size": pa.array(list(map(len, sets)), pa.int64()),
                    "fp": pa.array(prints, pa.int64()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                }
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, wanted in zip(batch["text"], batch["node"].to_pylist(), strict=True):
                own = shingles(x.as_py(), words)
                if int(np.uint64(_node(own)).view(np.int64)) == wanted:
                    values = pa.array(own.view(np.int64))
                    offsets = pa.array([0, len(own)], pa.int32())
                    yield pa.record_batch({"node": pa.array([wanted], pa.int64()), "hashes": pa.ListArray.from_arrays(offsets, values)})

    return run


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, minwise: int = KEYS) -> DataFrame:
    """One row per row of ``docs``: id, component (smallest id reachable).

    Rows are linked if the Jaccard similarity of their shingle sets is 0.8 or more; all null and blank
    texts are one component. Repeated rows come back as often as they are given. A
    component without any id has a null. An empty table gives an empty result. With fewer than 24 ``minwise`` keys a text,
    more pairs beyond the radius of SimHash are missed; with 0 it is SimHash alone that finds candidates.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"))
    schema = docs.select(
        F.col(id).alias("id"), *(F.lit(0).cast("long").alias(x) for x in ("digest", "node", "size", "fp")), F.array(F.lit(0).cast("long")).alias("keys")
    ).schema
    rows = common.materialize(own.mapInArrow(_sketches(words, minwise), schema), "near-sketches")
    # Texts without a word are one node, which needs no key.
    worded = rows.filter("size > 0").select("fp", "node", "size")
    ball = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key")
    balls = worded.join(simhash.near_roots(worded), "fp", "left").select(ball, "node", "size")
    keyed = common.materialize(rows.select(F.explode("keys").alias("key"), "node", "size").unionByName(balls).distinct(), "near-keys")
    shared = keyed.groupBy("key").agg(F.min("node").alias("_l"), F.max("node").alias("_h")).filter("_l <> _h").select("key")
    members = common.materialize(keyed.join(common.materialize(shared, "near-shared"), "key", "left_semi"), "near-members")
    # The sets of texts that share a key, made again from one text each. A row is found by its id and a hash of its
    # text, so that rows without an id don't meet.
    ones = rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "digest")).alias("one"))
    ones = common.materialize(ones.select("node", F.col("one.id").alias("_id"), F.col("one.digest").alias("_digest")), "near-ones")
    ones = common.broadcast_if_small(ones)
    texts = own.join(ones, (own.digest == ones._digest) & own.id.eqNullSafe(ones._id)).select("text", "node")
    sets = texts.mapInArrow(_sets(words), "node long, hashes array<long>").dropDuplicates(["node"])
    sets = common.materialize(sets, "near-sets")
    roots = similar_components(members, sets, LEAST)
    lows = rows.groupBy("node").agg(F.min("id").alias("low")).join(roots, "node", "left")
    lows = common.materialize(lows.select("node", "low", F.coalesce("root", "node").alias("root")), "near-nodes")
    lowest = common.materialize(lows.groupBy("root").agg(F.min("low").alias("component")), "near-lowest")
    found = lows.join(lowest, "root").select("node", "component")
    return rows.select("id", "node").join(found, "node").select(F.col("id").alias(id), "component")
