"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.plans.shared import materialize, shared_dir, shared_path

__all__ = [
    "bound_batches", "broadcast_if_small", "free_name", "materialize", "read_table", "shared_dir", "shared_path", "shuffle_partitions", "spread_hot", "text_or_empty",
]

#: Rows that are sent to every worker at most, and bytes of texts in them.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 100_000_000

#: Bytes of rows that Spark hands to a Python worker at a time, and that a task and its worker each hold. Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches of ``BATCH_BYTES``, unless it has a bound of its own.

    It stays set, as a stage's result is made when it is read. Batches are what is held at a time; all rows are in one of them."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of numbers and texts, to be sent to all workers if it has ``rows`` and ``BROADCAST_BYTES`` of texts at most.

    Where it has more, joins with it shuffle both sides.
    """
    texts = [F.octet_length(f.name) for f in stored.schema if f.dataType.typeName() in ("string", "binary")]
    held = F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0))), F.lit(0))
    n, size = stored.agg(F.count("*"), held).first()
    return F.broadcast(stored) if n <= rows and size <= BROADCAST_BYTES else stored


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_hot(stored: DataFrame, keys: list[str], rows: int, salt: str) -> DataFrame:
    """A stored table with the int column ``salt``: 0, or where more than ``rows`` rows agree in
    ``keys``, a number by which those are dealt to parts of about ``rows`` rows.

    Rows are told apart by their place in the table. It is stored, so a row that is read again after
    an executor was lost has the same place. ``keys`` hold no nulls.
    """
    counts = stored.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(f"{salt}_n"))
    hot = materialize(counts.filter(F.col(f"{salt}_n") > 1), "hot-keys")
    placed = stored.withColumn(f"{salt}_p", F.monotonically_increasing_id())
    part = F.pmod(F.xxhash64(f"{salt}_p"), F.coalesce(F.col(f"{salt}_n"), F.lit(1))).cast("int")
    return placed.join(hot, keys, "left").withColumn(salt, part).drop(f"{salt}_n", f"{salt}_p")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
