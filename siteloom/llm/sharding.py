"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows of each source are put into a seeded random order, each row gets the fractional
rank ``(rank - u) / rows of the source``, and the rows of all sources, sorted by it, are
cut into runs of equal length. Any run of the sorted order holds each source in its
overall proportion, so every shard matches the mixture, and the row counts of two shards
differ by one at most.

No source is ever brought into one task. Both rankings count rows in buckets of the sort
key first, sum those counts to offsets, and number rows within a bucket only:

* within a source, buckets are ranges of the seeded hash, and
* over all rows, buckets are ranges of the fractional rank.

A bucket of the hash holds many rows only if they share one key. Such a bucket is dealt to parts
first, by the rows' places in the stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.llm import common

#: Rows that a bucket should hold, and the most buckets that are made. Offsets are summed
#: over buckets, so the second one bounds that table (per source).
BUCKET_ROWS = 64
MAX_BUCKETS = 65_536
#: Buckets of a source's hash that hold this many times the rows they should are dealt to parts.
HOT_TIMES = 64


def _unit(hex_digest: Column, first: int) -> Column:
    """52 bits of a hexadecimal digest as a double in [0, 1)."""
    return F.conv(F.substring(hex_digest, first, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def interleave_shards(
    rows: DataFrame,
    *,
    source: str = "source",
    key: str = "doc_id",
    shards: int = 40,
    seed: int = 17,
    tie_breaks: tuple[str, ...] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard).

    Nulls: a null source is a source of its own; rows with a null key are ordered after
    the others of their bucket. Repeated keys follow ``tie_breaks``; rows that are equal in
    all of these are interchangeable, so whichever gets a slot, the result is the same. Where one key
    repeats so often that its rows are dealt to parts, the parts come one after the other.
    An empty table gives an empty result. Columns named ``shard`` or ``slot`` are replaced, all
    others keep their names and values; the operator's own work columns start with ``_il_``.
    """
    rows = common.materialize(rows.drop("shard", "slot"), "shard-rows")
    n = rows.count()
    buckets = int(min(MAX_BUCKETS, max(1, -(-n // bucket_rows))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    keyed = (
        rows.withColumn("_il_s", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")))
        .withColumn("_il_h", digest)
        .withColumn("_il_u", _unit(F.col("_il_h"), 1))
        .withColumn("_il_b", F.floor(F.col("_il_u") * buckets).cast("int"))
    )
    keyed = common.spread_hot(keyed, ["_il_s", "_il_b"], HOT_TIMES * max(bucket_rows, -(-n // buckets)), "_il_part")
    order = [F.col("_il_u"), F.col(key).asc_nulls_last(), *(F.col(x).asc_nulls_last() for x in tie_breaks)]

    per_source = W.partitionBy("_il_s")
    before = per_source.orderBy("_il_b", "_il_part").rowsBetween(W.unboundedPreceding, -1)
    bucket = ["_il_s", "_il_b", "_il_part"]
    offsets = (
        keyed.groupBy(*bucket)
        .agg(F.count("*").alias("_il_c"))
        .select(
            *bucket,
            F.coalesce(F.sum("_il_c").over(before), F.lit(0)).alias("_il_off"),
            F.sum("_il_c").over(per_source).alias("_il_n"),
        )
    )
    # Within a source the position is known; u of the source's name keeps sources of a
    # single row from meeting at the same fractional rank.
    start = _unit(F.md5(F.concat_ws(":", F.lit(f"{seed}/start"), F.col("_il_s"))), 1)
    ranked = (
        keyed.join(offsets, bucket)
        .withColumn("_il_r", F.row_number().over(W.partitionBy(*bucket).orderBy(*order)) + F.col("_il_off"))
        .withColumn("_il_f", (F.col("_il_r") - start) / F.col("_il_n"))
        .withColumn("_il_fb", F.least(F.floor(F.col("_il_f") * buckets).cast("int"), F.lit(buckets - 1)))
        .drop("_il_b", "_il_part", "_il_off", "_il_n")
    )
    cuts = (
        ranked.groupBy("_il_fb")
        .agg(F.count("*").alias("_il_c"))
        .select(
            "_il_fb",
            F.coalesce(
                F.sum("_il_c").over(W.orderBy("_il_fb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_il_off"),
        )
    )
    within = W.partitionBy("_il_fb").orderBy("_il_f", "_il_s", *order)
    # Shard k takes the positions from floor(k n / shards) on.
    return (
        ranked.join(cuts, "_il_fb")
        .withColumn("_il_p", F.row_number().over(within) - 1 + F.col("_il_off"))
        .withColumn("shard", F.expr(f"int(((_il_p + 1) * {shards} - 1) div {max(n, 1)})"))
        .withColumn("slot", F.expr(f"_il_p - (shard * {n}L) div {shards}"))
        .drop("_il_s", "_il_h", "_il_u", "_il_r", "_il_f", "_il_fb", "_il_off", "_il_p")
    )
