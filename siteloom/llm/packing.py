"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds the lengths in
(capacity / (k + 1), capacity / k], and a bin of class k always takes k pieces, so a bin is
full by count alone and workers fill their own bins without looking at any other's.

Documents may be cut. One longer than the capacity gives whole sequences first. A rest that
would leave more than ``max_waste`` of its place empty is cut at the next class's largest
length, capacity // (k + 1), which fills its place, and what is left is classified again. So
padding in full bins is bounded by ``max_waste`` plus capacity mod k.

Pieces are dealt by hash to groups (workers). In each group every class can leave one bin
that isn't full; the pieces of those, less than k for class k, are packed together by
first-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteloom.llm import bpe, common

CAPACITY = 2048
MAX_WASTE = 1 / 32
GROUP_DOCS = 1000
#: A sequence id holds the group, the class and the bin.
CLASS_BITS, BIN_BITS = 12, 24


def harmonic_cuts(length: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> list[int]:
    """Lengths of the pieces of one document, in order."""
    cuts = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        place = capacity // k
        take = rest if place - rest <= max_waste * place else capacity // (k + 1)
        cuts.append(take)
        rest -= take
    return cuts


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _special(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in _tokenizer(path).get_added_tokens_decoder().values())


def token_ids(text: str, tokenizer_path: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The ids by the tokenizer file. Texts without any of its added tokens go by the rank
    file of the same vocabulary, which gives the same ids sooner."""
    if any(x in text for x in _special(tokenizer_path)):
        return np.array(_tokenizer(tokenizer_path).encode(text, add_special_tokens=False).ids, np.uint32)
    return bpe.encoding(ranks_path, pattern).encode_to_numpy(text, disallowed_special=())


def _pieces(tokenizer_path: str, ranks_path: str, pattern: str, end_id: int, capacity: int, max_waste: float, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, crc, total, values = [], [], [], [], [], []
            for row, text in enumerate(batch["text"]):
                own = np.append(token_ids(text.as_py() or "", tokenizer_path, ranks_path, pattern), np.uint32(end_id))
                own = own.astype("<u4")
                at = 0
                for n in harmonic_cuts(len(own), capacity, max_waste):
                    rows.append(row)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own[at : at + n]))
                    total.append(len(own))
                    if ids:
                        values.append(own[at : at + n].astype(np.int32))
                    at += n
            columns = {"id": batch["id"].take(pa.array(rows, pa.int64()))}
            for name, x in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total)):
                columns[name] = pa.array(x, pa.int64())
            if ids:
                columns["ids"] = bpe._lists(values)
            yield pa.record_batch(columns)

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    max_waste: float = MAX_WASTE,
    ids: bool = True,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, and ids if asked for): the cut documents.

    Each document's ids end with ``end_id``; a null text is empty, so it has that id only.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    run = _pieces(tokenizer_path, ranks_path, pattern, end_id, capacity, max_waste, ids)
    return rows.mapInArrow(run, schema)


def _first_fit(capacity: int):
    """First-fit decreasing of one group's rest: adds bin and offset."""

    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        order = np.lexsort((group["_hp_pos"].to_numpy(), group["_hp_class"].to_numpy(), -lengths))
        used = np.zeros(len(lengths), np.int64)
        bins, offsets, open_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
        for i in order:
            fits = np.flatnonzero(used[:open_bins] + lengths[i] <= capacity)
            if len(fits):
                b = fits[0]
            else:
                b, open_bins = open_bins, open_bins + 1
            bins[i], offsets[i] = b, used[b]
            used[b] += lengths[i]
        for name, x in (("_hp_bin", bins), ("offset", offsets)):
            group = group.set_column(group.schema.get_field_index(name), name, pa.array(x, pa.int64()))
        return group

    return run


def harmonic_pack(
    pieces: DataFrame, groups: int, *, spread: tuple[str, ...], length: str = "length", capacity: int = CAPACITY
) -> DataFrame:
    """Stored ``pieces`` with sequence_id (long) and offset (long, gapless from 0 in the sequence).

    ``spread`` names the columns whose hash deals pieces to groups and, within a group, puts
    them in order. Pieces that agree in all of them are interchangeable; where more than a group
    should hold do so, they are dealt to groups by their places in the table. Lengths run from 1 to
    ``capacity``. An empty table gives an empty result.
    """
    own = W.partitionBy("_hp_group", "_hp_class")
    hashed = common.spread_hot(pieces.withColumn("_hp_hash", F.xxhash64(*spread)), ["_hp_hash"], GROUP_DOCS, "_hp_part")
    ordered = (
        hashed.withColumn("_hp_group", F.pmod(F.when(F.col("_hp_part") > 0, F.xxhash64("_hp_hash", "_hp_part")).otherwise(F.col("_hp_hash")), F.lit(groups)).cast("int"))
        .drop("_hp_part")
        .withColumn("_hp_class", F.expr(f"int({capacity} div `{length}`)"))
        .withColumn("_hp_pos", F.row_number().over(own.orderBy("_hp_hash", *spread)).cast("long") - 1)
        .withColumn("_hp_bin", F.expr("_hp_pos div _hp_class"))
        .withColumn("_hp_full", F.expr("_hp_bin < count(1) over (partition by _hp_group, _hp_class) div _hp_class"))
        .withColumn(
            "offset",
            F.coalesce(
                F.sum(length).over(
                    W.partitionBy("_hp_group", "_hp_class", "_hp_bin")
                    .orderBy("_hp_pos")
                    .rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).cast("long"),
        )
        .drop("_hp_hash")
    )
    full = ordered.filter("_hp_full")
    rest = ordered.filter("not _hp_full").groupBy("_hp_group").applyInArrow(_first_fit(capacity), ordered.schema)
    owner = f"shiftleft(bigint(_hp_group), {CLASS_BITS}) + if(_hp_full, _hp_class, 0)"
    number = f"shiftleft({owner}, {BIN_BITS}) + _hp_bin"
    return (
        full.unionByName(rest)
        .withColumn("sequence_id", F.expr(number))
        .drop("_hp_group", "_hp_class", "_hp_pos", "_hp_bin", "_hp_full")
    )


def groups_for(documents: int, group_docs: int = GROUP_DOCS) -> int:
    """How many groups fill their own bins; each leaves about half a sequence of padding."""
    return max(1, -(-documents // group_docs))
