"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text of up to ``chunk + overlap`` characters is one chunk and is encoded where it lies.
A longer one is cut into chunks that overlap, and

1. each chunk is pre-tokenised on its own, on any worker; copies of a text share its chunks,
2. neighbouring chunks are stitched at the first position in their overlap where both
   pre-tokenisations have a boundary. The pattern matches left to right and looks no more
   than one character ahead, so from such a position on both go on alike,
3. the pieces between those positions are encoded on any worker, and
4. their ids are put together in order.

Boundaries after white space are not used for stitching: a piece that ended there could
close its last run of white space differently. If two chunks have no boundary in common, the
rest of that text becomes one piece. So the ids are always those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 15
OVERLAP = 1 << 9
#: Ids that one record batch holds at most, but for a single text with more.
BATCH_IDS = 1 << 20
#: Rows that are decoded to one record batch.
DECODE_ROWS = 500


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; each worker reads the file once."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(ranks_path: str) -> list[bytes]:
    with open(ranks_path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks.get(x, b"") for x in range(max(ranks) + 1)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _encode(ranks_path: str, pattern: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks_path, pattern)
        for batch in batches:
            first, held, done = 0, [], 0
            for row, text in enumerate(batch["text"]):
                held.append(tokens.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(np.int32))
                done += len(held[-1])
                if done >= BATCH_IDS or row == batch.num_rows - 1:
                    own = batch.slice(first, len(held))
                    yield pa.record_batch({k: own[k] for k in keys} | {"ids": _lists(held)})
                    first, held, done = row + 1, [], 0

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text in zip(batch["sha"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)
                rows = [text[a : a + chunk + overlap] for a in starts]
                rows[-1] = text[starts[-1] :]
                yield pa.record_batch(
                    {"sha": pa.array([sha] * len(rows)), "k": pa.array(range(len(rows)), pa.int32()), "part": pa.array(rows)}
                )

    return run


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens begin, after the first one and not after white space."""
    starts = (m.start() for m in regex.finditer(pattern, text))
    return [p for p in starts if p and not text[p - 1].isspace()]


def _pretokenise(pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for part in batch["part"].to_pylist():
                found = boundaries(part, pattern)
                heads.append([p for p in found if p < overlap])
                tails.append([p - chunk for p in found if chunk <= p < chunk + overlap])
            kind = pa.list_(pa.int32())
            columns = {x: batch[x] for x in ("sha", "k", "part")}
            yield pa.record_batch(columns | {"head": pa.array(heads, kind), "tail": pa.array(tails, kind)})

    return run


def stitched_pieces(texts: DataFrame, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(sha, piece, text): the pieces of long texts given as (sha, text); copies count once."""
    chunks = texts.mapInArrow(_cut(chunk, overlap), "sha string, k int, part string")
    parallel = chunks.groupBy("sha", "k").agg(F.first("part").alias("part"))
    found = parallel.mapInArrow(
        _pretokenise(pattern, chunk, overlap), "sha string, k int, part string, head array<int>, tail array<int>"
    )
    along = W.partitionBy("sha").orderBy("k")
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(along)))
    stitched = (
        found.withColumn("meet", meet)
        .withColumn("lost", F.max((F.col("k") > 0) & F.col("meet").isNull()).over(so_far))
        .withColumn("opens", (F.col("k") == 0) | ~F.col("lost"))
        .withColumn("piece", F.sum(F.col("opens").cast("int")).over(so_far))
        .withColumn("begin", F.when(F.col("opens"), F.coalesce("meet", F.lit(0))).otherwise(0))
        .withColumn("next", F.lead(F.when(F.col("opens"), F.col("meet")).otherwise(0)).over(along))
    )
    end = F.when(F.col("next").isNull(), F.char_length("part")).otherwise(F.col("next") + chunk)
    part = F.substring(F.col("part"), F.col("begin") + 1, end - F.col("begin"))
    return (
        stitched.groupBy("sha", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("k", part.alias("part")))).alias("parts"))
        .select("sha", "piece", F.array_join("parts.part", "").alias("text"))
    )


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(id, ids): the token ids of each whole text, one row per row of ``docs``.

    A null text is empty and has no ids; repeated rows and rows without an id come back as
    they are given; an empty table gives an empty result. ``overlap`` may not exceed ``chunk``.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("0 < overlap <= chunk is needed")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.char_length("text") > chunk + overlap
    schema = f"id {dict(rows.dtypes)['id']}, ids array<int>"
    short = rows.filter(~is_long).mapInArrow(_encode(ranks_path, pattern, ["id"]), schema)
    named = rows.filter(is_long).select("id", F.sha2("text", 256).alias("sha"), "text")
    pieces = stitched_pieces(named.select("sha", "text"), pattern, chunk=chunk, overlap=overlap)
    encoded = pieces.mapInArrow(_encode(ranks_path, pattern, ["sha", "piece"]), "sha string, piece long, ids array<int>")
    whole = encoded.groupBy("sha").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("piece", "ids"))).getField("ids")).alias("ids")
    )
    long = named.select("id", "sha").join(whole, "sha").select("id", "ids")
    return short.unionByName(long).withColumnRenamed("id", id)


def _decode(ranks_path: str, ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(at, DECODE_ROWS)
                texts = []
                for x in batch[ids]:
                    own = x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else None
                    texts.append(None if own is None else b"".join(map(table.__getitem__, own)))
                columns = {x: batch[x] for x in batch.schema.names if x != ids}
                yield pa.record_batch(columns | {out: pa.array(texts, pa.binary())})

    return run


def decode(encoded: DataFrame, ranks_path: str, *, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``encoded`` with the column ``ids`` replaced by the raw bytes of its tokens.

    Null ids stay null, no ids give no bytes. An id that the rank file lacks is an error, but
    for one below its largest id, which has no bytes.
    """
    rest = encoded.drop(ids)
    schema = rest.withColumn(out, F.lit(None).cast("binary")).schema
    return encoded.mapInArrow(_decode(ranks_path, ids, out), schema)
