"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every row gets a 48-bit fingerprint and the SHA-256 of its normalised text. These small
   rows are written to the shared folder in blocks ("senders").
2. A sender sorts its distinct fingerprints, cuts them by range among the owners, and sends
   each owner the gaps between them, Golomb-Rice coded, with one bit per hash that says
   whether the sender itself holds it twice.
3. An owner decodes what all senders sent it, finds the hashes that occur twice, and
   answers each sender with a bitmap.
4. A sender marks its suspects by the bitmaps. Only rows whose fingerprint is a suspect go on: where
   there are no more suspects than can be sent to every worker, the texts are filtered where
   they lie, else by a shuffle. The suspects' texts are shuffled and grouped by the
   text itself, which compares all bytes.

A hash that a third of all rows share costs one entry per sender, and the grouping of
suspects is combined before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm import common

HASH_BITS = 48
#: Most rows of one sender.
SENDER_ROWS = 1 << 20
#: Rows that an owner should hear of, which sets the number of owners.
OWNER_ROWS = 1 << 22


def normalized(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def rice_encode(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Code the gaps of sorted distinct integers >= ``low``: (shift, quotients, remainders).

    Quotients are unary (zeros, then a one), remainders take ``shift`` bits each.
    """
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.int64(low)).astype(np.int64)
    shift = max(0, int(0.69 * gaps.mean()).bit_length() - 1)
    ends = np.cumsum((gaps >> shift) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(shift, dtype=np.int64)) & 1
    return shift, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def rice_decode(n: int, low: int, shift: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The integers that ``rice_encode`` coded."""
    if not n:
        return np.empty(0, np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n].astype(np.int64)
    gaps = (np.diff(ends, prepend=np.int64(-1)) - 1) << shift
    if shift:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * shift].reshape(n, shift)
        gaps += bits.astype(np.int64) @ (np.int64(1) << np.arange(shift, dtype=np.int64))
    return np.cumsum(gaps) + low


def _starts(owners: int) -> np.ndarray:
    """Where each owner's range of hashes begins, and one past the last."""
    return np.array([(k << HASH_BITS) // owners for k in range(owners + 1)], np.int64)


SENT = "src long, owner int, n int, shift int, quotients binary, remainders binary, twice binary"
ANSWER = "src long, owner int, again binary"


def _send(owners: int):
    def run(group: pa.Table) -> pa.Table:
        hashes, counts = np.unique(group["fp"].to_numpy(), return_counts=True)
        starts = _starts(owners)
        cuts = np.searchsorted(hashes, starts)
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            coded = rice_encode(hashes[part], int(starts[k]))
            rows.append((int(k), int(cuts[k + 1] - cuts[k]), *coded, np.packbits(counts[part] > 1).tobytes()))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["owner", "n", "shift", "quotients", "remainders", "twice"]
        src = pa.array([group["src"][0].as_py()] * len(rows), pa.int64())
        return pa.table({"src": src} | {x: pa.array(c, t) for x, c, t in zip(names, columns, kinds, strict=True)})

    return run


def _answer(owners: int):
    def run(group: pa.Table) -> pa.Table:
        owner = group["owner"][0].as_py()
        low = int(_starts(owners)[owner])
        sent = group.to_pylist()
        lists = [rice_decode(x["n"], low, x["shift"], x["quotients"], x["remainders"]) for x in sent]
        twice = [np.unpackbits(np.frombuffer(x["twice"], np.uint8))[: x["n"]].astype(bool) for x in sent]
        hashes, counts = np.unique(np.concatenate(lists), return_counts=True)
        again = np.union1d(hashes[counts > 1], np.concatenate([a[b] for a, b in zip(lists, twice, strict=True)]))
        bitmaps = [np.packbits(np.isin(x, again)).tobytes() for x in lists]
        return pa.table(
            {
                "src": group["src"].combine_chunks(),
                "owner": group["owner"].combine_chunks(),
                "again": pa.array(bitmaps, pa.binary()),
            }
        )

    return run


def _suspects(owners: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        fp = rows["fp"].to_numpy()
        hashes = np.unique(fp)
        cuts = np.searchsorted(hashes, _starts(owners))
        again = np.zeros(len(hashes), bool)
        for x in answers.to_pylist():
            a, b = cuts[x["owner"]], cuts[x["owner"] + 1]
            again[a:b] = np.unpackbits(np.frombuffer(x["again"], np.uint8))[: b - a]
        return pa.table({"fp": pa.array(hashes[again])})

    return run


def _fingerprint(norm: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - HASH_BITS)


def _hashed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, sha, fp, src) of every row, stored."""
    place = F.monotonically_increasing_id()
    block = F.shiftright(place.bitwiseAND(F.lit((1 << 33) - 1)), SENDER_ROWS.bit_length() - 1)
    rows = docs.select(F.col(id).alias("id"), normalized(F.col(text)).alias("norm")).select(
        "id",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        _fingerprint("norm").alias("fp"),
        (F.spark_partition_id().cast("long") * (1 << 13) + block).alias("src"),
    )
    return common.materialize(rows, "exact-dedup-hashes")


def suspect_fingerprints(rows: DataFrame, owners: int | None = None) -> DataFrame:
    """The fingerprints ``fp`` that occur twice or more in ``rows`` (src, fp), by the exchange; stored.

    ``src`` tells the sender of a row, which holds about SENDER_ROWS of them at most.
    """
    owners = owners or max(1, -(-rows.count() // OWNER_ROWS), common.shuffle_partitions(rows.sparkSession))
    sent = rows.select("src", "fp").groupBy("src").applyInArrow(_send(owners), SENT)
    answers = sent.groupBy("owner").applyInArrow(_answer(owners), ANSWER)
    found = rows.select("src", "fp").groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(_suspects(owners), "fp long")
    return common.materialize(found.distinct(), "exact-dedup-suspects")


def exact_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size (long), kept, text_sha256.

    Texts are equal when they are identical after runs of ASCII white space became one
    space; null counts as empty. ``keep_id`` is the smallest id of the group. Repeated rows
    (same id and text) count towards the size, and one of them is kept. Rows without an id
    count as well; such a row is kept only if no row of its group has an id. An empty table
    gives an empty result, and other columns of ``docs`` are not touched.
    """
    rows = _hashed(docs, id, text)
    suspects = common.broadcast_if_small(suspect_fingerprints(rows, owners))
    texts = docs.select(F.col(id).alias("id"), normalized(F.col(text)).alias("norm")).withColumn("fp", _fingerprint("norm"))
    groups = (
        texts.join(suspects, "fp", "left_semi")
        .groupBy("norm")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = common.materialize(groups, "exact-dedup-groups")
    # Which of the repeated rows of the smallest id stays is told by their place in the stored table.
    placed = rows.select("id", "sha", "fp", F.monotonically_increasing_id().alias("place"))
    first = F.min_by("place", F.struct(F.col("id").isNull(), "id", "place")).alias("first")
    firsts = placed.join(suspects, "fp", "left_semi").groupBy("sha").agg(first)
    groups = common.materialize(groups.join(firsts, "sha"), "exact-dedup-kept")
    alone = F.col("group_size").isNull()
    return placed.join(groups, "sha", "left").select(
        F.col("id").alias(id),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("place") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of equal texts.

    It is a row of the smallest id; rows without one come last. Rows that are no suspects stay where they
    are, the others are grouped by their normalised text. Columns may have any names.
    """
    norm, fp, row = (common.free_name(docs, x) for x in ("norm", "fp", "row"))
    suspects = common.broadcast_if_small(suspect_fingerprints(_hashed(docs, id, text), owners).withColumnRenamed("fp", fp))
    whole = docs.withColumn(norm, normalized(F.col(f"`{text}`"))).withColumn(fp, _fingerprint(f"`{norm}`"))
    single = whole.join(suspects, fp, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.xxhash64(f"`{text}`")))
    order = F.struct(F.col(f"`{id}`").isNull(), F.col(f"`{id}`"), F.xxhash64(rest))
    best = whole.join(suspects, fp, "left_semi").groupBy(F.col(f"`{norm}`")).agg(F.min_by(F.struct(*columns), order).alias(row))
    return single.unionByName(best.select(f"`{row}`.*"))
