"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 3 bits must be linked. The radius is odd, so
a pair at distance 3 has no middle within one flip of both; a ball of two flips would
have 2081 members. Instead the 64 bits are cut into three bands, and the ball is taken three
times, each time with one band punctured (set aside). If the band that is set aside holds
one of the differing bits, at most two are left, and the two fingerprints meet in a variant
that is within one flip of both. So each distinct fingerprint emits its balls of half the
radius, 3 x (1 + 42 or 43) variants, and the shuffle on the variants brings every linked
pair together at least once, at any distance up to 3.

What meets is verified on all 64 bits. Each task reduces its verified links to stars, so
that a bucket with many members makes as many rows as it has members, not pairs. In
buckets too large for comparing all members, links follow from the structure of the
bucket (see ``_large_bucket``), in time in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import common
from siteloom.operators.components import HELD_LINKS, connected_components, stars

RADIUS = 3
BANDS = ((0, 22), (22, 43), (43, 64))
#: Buckets of up to so many members are compared pair by pair.
SMALL_BUCKET = 1024
#: Variants that a task makes.
TASK_VARIANTS = 1 << 21

ONE = np.uint64(1)


def _band_bits(band: int) -> list[int]:
    return [1 << i for i in range(*BANDS[band])]


def _drop_mask(band: int) -> int:
    return sum(_band_bits(band))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit fingerprint over all shingles of a text, as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    width = min(words, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1].tolist()
    hash64 = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hash64(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)
    )
    return fingerprint_of(hashes)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of the unsigned hashes of shingles, 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch["text"]], np.uint64).view(np.int64)
            yield pa.record_batch({"id": batch["id"], "fp": pa.array(found, pa.int64())})

    return run


def simhash_fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each whole text.

    ASCII letters are lower-cased, words are split at ASCII white space. A null or blank
    text has fingerprint 0; fewer words than a shingle make one shingle of them all.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = docs.select(F.col(id).alias("id"), F.lit(0).cast("long").alias("fp")).schema
    return rows.mapInArrow(_fingerprints(words), schema)


def _variants(fp: str):
    """Array of the variants of column ``fp``, each with its band's number in that band."""
    balls = []
    for band in range(len(BANDS)):
        drop = _drop_mask(band)
        keep = F.lit(_signed(~drop & ((1 << 64) - 1)))
        tag = (band + 1) << BANDS[band][0]
        flips = [0, *(1 << i for i in range(64) if not drop >> i & 1)]
        centre = F.col(fp).bitwiseAND(keep)
        balls.append(F.array(*(centre.bitwiseXOR(F.lit(_signed(x | tag)).cast("long")) for x in flips)))
    return F.concat(*balls)


def _small_bucket(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS, 1))
    return fp[i], fp[j]


def _large_bucket(key: np.uint64, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of one bucket that keep all components of its linked pairs.

    Members lie within one flip of the variant in the bits that were kept. Let a class be
    the members that agree in the punctured band. Then (1) members of a class differ in two
    bits at most, (2) classes one flip apart are linked throughout, (3) a member that equals the
    variant is linked to all members of classes two flips away, and (4) to those equal
    to the variant three flips away. Any linked pair that these rules miss meets in another
    bucket, where one of them holds. Classes are found by binary search.
    """
    links_a, links_b = [], []
    for band in range(len(BANDS)):
        drop, bits = np.uint64(_drop_mask(band)), _band_bits(band)
        if int(key & drop) != (band + 1) << BANDS[band][0]:
            continue
        away = np.bitwise_count((fp ^ key) & ~drop)
        own = fp[away <= 1]
        if not len(own):
            continue
        equal = away[away <= 1] == 0
        values, first, inverse = np.unique(own & drop, return_index=True, return_inverse=True)
        links_a.append(own)
        links_b.append(own[first[inverse]])
        middle, middle_values = own[equal], (own & drop)[equal]

        def meet(source, wanted, values, rep):
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            hit = values[at] == wanted
            links_a.append(source[hit])
            links_b.append(rep[at[hit]])

        for x in bits:
            meet(own[first], values ^ np.uint64(x), values, own[first])
        if len(middle):
            by_value = np.argsort(middle_values)
            for x, y in combinations(bits, 2):
                meet(middle, middle_values ^ np.uint64(x | y), values, own[first])
            for x, y, z in combinations(bits, 3):
                meet(middle, middle_values ^ np.uint64(x | y | z), middle_values[by_value], middle[by_value])
    if not links_a:
        return fp[:0], fp[:0]
    return np.concatenate(links_a), np.concatenate(links_b)


def _verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    good = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
    return a[good], b[good]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (key, fp) sorted by key; yields (a, b) stars of the links of this task."""
    empty = np.empty(0, np.uint64)
    held_a, held_b, held = [empty], [empty], 0
    key, fp = empty, empty

    def hold(a, b):
        nonlocal held, held_a, held_b
        if len(a):
            held_a.append(a)
            held_b.append(b)
            held += len(a)
            if held > HELD_LINKS:
                a, b = stars(np.concatenate(held_a), np.concatenate(held_b))
                held_a, held_b, held = [a], [b], 0

    def bucket_ends(last: bool):
        """Link the buckets in key and fp; all but the last one, which may go on, if not last."""
        nonlocal key, fp
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.concatenate((starts[1:], [len(key)]))
        if not last:
            starts, ends, cut = starts[:-1], ends[:-1], starts[-1]
        else:
            cut = len(key)
        sizes = ends - starts
        pairs = starts[sizes == 2]
        hold(*_verified(fp[pairs], fp[pairs + 1]))
        for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            own = fp[a:b]
            links = _small_bucket(own) if b - a <= SMALL_BUCKET else _large_bucket(key[a], own)
            hold(*stars(*_verified(*links)))
        key, fp = key[cut:], fp[cut:]

    for batch in batches:
        key = np.concatenate((key, batch["key"].to_numpy().view(np.uint64)))
        fp = np.concatenate((fp, batch["fp"].to_numpy().view(np.uint64)))
        bucket_ends(False)
    bucket_ends(True)
    a, b = stars(np.concatenate(held_a), np.concatenate(held_b))
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.record_batch({"a": pa.array(a[part].view(np.int64)), "b": pa.array(b[part].view(np.int64))})


def near_links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs
    that differ in at most 3 bits. A link may come more than once."""
    distinct = common.materialize(fingerprints.select(F.col(fp).alias("fp")).distinct(), "simhash-distinct")
    n_variants = sum(1 + 64 - (high - low) for low, high in BANDS)
    # Few bytes become many rows, so tasks are counted by what they make.
    tasks = max(1, -(-distinct.count() * n_variants // TASK_VARIANTS))
    return (
        distinct.repartition(tasks, "fp")
        .select(F.explode(_variants("fp")).alias("key"), "fp")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_links, "a long, b long")
    )


def near_roots(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, root): the smallest fingerprint of its component, for those that lie within 3 bits of another one."""
    return connected_components(near_links(fingerprints, fp)).withColumnsRenamed({"node": fp})


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed 64 bits), component (smallest id reachable).

    Rows are linked if their fingerprints differ in 3 bits or fewer, equal ones included;
    so all null and blank texts are one component. Repeated rows come back as often as they
    are given. A component without any id has a null. An empty table gives an empty result.
    """
    rows = common.materialize(simhash_fingerprints(docs, id=id, text=text, words=words), "simhash")
    # Only fingerprints with links go through the component rounds.
    roots = near_roots(rows)
    nodes = common.materialize(
        rows.groupBy("fp")
        .agg(F.min("id").alias("low"))
        .join(roots, "fp", "left")
        .select("fp", "low", F.coalesce("root", "fp").alias("root")),
        "simhash-nodes",
    )
    # Stored, so that Spark can split the rows of a component or fingerprint that many rows share.
    lows = common.materialize(nodes.groupBy("root").agg(F.min("low").alias("component")), "simhash-lows")
    found = common.materialize(nodes.join(lows, "root").select("fp", "component"), "simhash-found")
    return rows.join(found, "fp").select(F.col("id").alias(id), "fp", "component")
