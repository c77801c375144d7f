"""Current state that is kept: partial aggregates by key, into which each batch of new events is merged.

A state is a folder in shared storage. Keys are dealt to buckets by hash; a bucket's rows lie in
``rows/version=<batch>/bucket=<b>`` of the batch that last touched it, and ``commits/<batch>`` tells for every
bucket which version holds. So a batch reads its own events and the buckets that they touch, writes these
buckets anew, and is there for readers when its commit is. A batch that is run again does nothing if it was
committed, else it writes over what it left. Readers see the last commit; the one before is kept
for readers that began earlier, older versions are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.fold import FINISHED, PENDING

BUCKETS = 256
_MERGES: dict[str, Callable[[str], Column]] = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Fold:
    """What is kept for each key: ``parts`` are (merge, column of an event) by name, merged by max, min or sum; nulls
    don't count. ``result`` are the columns of the current state, made of the parts."""

    keys: tuple[str, ...]
    parts: dict[str, tuple[str, Column]]
    result: dict[str, Column]

    def partial(self, events: DataFrame) -> DataFrame:
        rows = events.select(*self.keys, *(column.alias(name) for name, (_, column) in self.parts.items()))
        return self.merged(rows)

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(_MERGES[merge](name).alias(name) for name, (merge, _) in self.parts.items()))

    def current(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.keys, *(column.alias(name) for name, column in self.result.items()))


def _when(condition: Column, *columns: str, seq: str = "event_seq") -> Column:
    return F.when(condition, F.struct(seq, *columns))


def pages_fold(site: tuple[str, ...] = ()) -> Fold:
    """The kept form of ``fold.current_pages``."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    text = lambda c: F.coalesce(F.col(f"{c}.{c}"), F.lit(""))
    return Fold(
        (*site, "url"),
        {
            "settled": ("max", _when(F.col("status") != PENDING, "status", "components")),
            "first": ("min", F.struct("event_seq", "components")),
            "description": ("max", _when(filled("description"), "description")),
            "title": ("max", _when(filled("title"), "title")),
            "finished": ("max", _when(F.col("status") == FINISHED, "ts")),
        },
        {
            "status": F.coalesce("settled.status", F.lit(PENDING)),
            "component_count": F.coalesce("settled.components", "first.components"),
            "description": text("description"),
            "title": text("title"),
            "visited_at": F.col("finished.ts"),
        },
    )


def edges_fold(site: tuple[str, ...] = ()) -> Fold:
    """The kept form of ``fold.current_edges``."""
    named = _when(F.coalesce(F.col("run_id"), F.lit("")) != "", "run_id")
    return Fold(
        (*site, "from", "to", "component", "action"),
        {"n": ("sum", F.lit(1).cast("long")), "first": ("min", named), "last": ("max", named), "created_at": ("min", F.col("ts"))},
        {"observation_count": F.col("n"), "first_seen_run": F.col("first.run_id"), "last_seen_run": F.col("last.run_id"), "created_at": F.col("created_at")},
    )


def rows_fold(keys: tuple[str, ...], columns: tuple[str, ...]) -> Fold:
    """The kept form of ``fold.current_rows``: of each key the last event, nulls and empty values included."""
    return Fold(keys, {"last": ("max", F.struct("event_seq", *columns))}, {c: F.col(f"last.{c}") for c in columns})


class StateTable:
    """The state of a fold in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold, buckets: int = BUCKETS):
        self.spark, self.path, self.fold, self.buckets = spark, path.rstrip("/"), fold, buckets

    def _fs(self, path: str):
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(context._jsc.hadoopConfiguration()), found

    def _batches(self) -> list[int]:
        fs, path = self._fs(f"{self.path}/commits")
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(int(x) for x in names if fs.exists(self._fs(f"{self.path}/commits/{x}/_SUCCESS")[1]))

    def _versions(self, batch: int) -> dict[int, int]:
        """The version of each bucket that has rows; one short row a bucket."""
        found = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/commits/{batch}").collect()
        return {x.bucket: x.version for x in found}

    def _rows(self, versions: dict[int, int], buckets: set[int] | None = None) -> DataFrame | None:
        """Keys and parts of all buckets, or of ``buckets``; null where there are none."""
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in versions.items() if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths).select(*self._named(), "after.*") if paths else None

    def _named(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.fold.keys]

    def _bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def append(self, events: DataFrame, batch: int) -> DataFrame:
        """Merge ``events`` as batch number ``batch``; a later batch has a larger number.

        Returns a row for each key that the batch touched: its parts ``after`` it and ``before`` it, null if the key
        is new. For the last batch that was committed already, these are read again; an older one is an error.
        """
        done, named, parts = self._batches(), self._named(), list(self.fold.parts)
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        partial = self.fold.partial(events)
        kind = partial.select(F.struct(*parts).alias("after")).schema["after"].dataType.simpleString()
        keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in partial.schema.fields[: len(named)])
        version = f"{self.path}/rows/version={batch}"
        if not done or batch > done[-1]:
            news = f"{self.path}/news/{batch}"
            partial.select("*", self._bucket(*named)).write.mode("overwrite").parquet(news)
            fresh = self.spark.read.schema(partial.select("*", F.lit(0).alias("bucket")).schema).parquet(news)
            touched = {x.bucket for x in fresh.select("bucket").distinct().collect()}  # at most one a bucket
            versions = self._versions(done[-1]) if done else {}
            old = self._rows(versions, touched)
            rows = fresh.select(*named, F.struct(*parts).alias("after"), F.lit(True).alias("new"))
            if old is not None:
                rows = rows.unionAll(old.select(*named, F.struct(*parts).alias("after"), F.lit(False).alias("new")))
            # At most one new row and one old row of each key meet.
            both = rows.groupBy(*named).agg(
                F.struct(*(_MERGES[merge](f"after.{p}").alias(p) for p, (merge, _) in self.fold.parts.items())).alias("after"),
                F.max(F.when(~F.col("new"), F.struct("after"))).alias("was"),
                F.max("new").alias("touched"),
            )
            told = both.select(*named, "after", F.when(F.col("touched"), F.col("was.after")).alias("before"), "touched", self._bucket(*named))
            told.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(version)
            versions |= dict.fromkeys(touched, batch)
            commit = self.spark.createDataFrame(list(versions.items()), "bucket int, version long")
            commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
            self._delete_old([*done, batch])
        stored = self.spark.read.schema(f"{keys}, after {kind}, before {kind}, touched boolean").parquet(version)
        return stored.filter("touched").select(*named, "before", "after")

    def _delete_old(self, done: list[int]) -> None:
        """Delete what neither the last commit nor the one before names."""
        for batch in done[:-2]:
            fs, at = self._fs(f"{self.path}/commits/{batch}")
            fs.delete(at, True)
        fs, at = self._fs(f"{self.path}/news")
        fs.delete(at, True)
        kept = {(v, b) for batch in done[-2:] for b, v in self._versions(batch).items()}
        fs, at = self._fs(f"{self.path}/rows")
        for version in fs.listStatus(at) if fs.exists(at) else []:
            number = int(version.getPath().getName().split("=")[1])
            own = [x.getPath() for x in fs.listStatus(version.getPath()) if x.getPath().getName().startswith("bucket=")]
            left = [x for x in own if (number, int(x.getName().split("=")[1])) in kept]
            for x in own if left or number in done[-2:] else [version.getPath()]:
                if x not in left:
                    fs.delete(x, True)

    def current(self, **key: object) -> DataFrame:
        """The current state by the last commit; with a key's values, of that key, whose bucket alone is read."""
        done = self._batches()
        versions = self._versions(done[-1]) if done else {}
        rows = self._rows(versions)
        if rows is None:
            raise ValueError(f"{self.path} holds no rows")
        if key:
            given = [F.lit(key[c]).cast(rows.schema[c].dataType) for c in self.fold.keys]
            bucket = self.spark.range(1).select(self._bucket(*given)).first()[0]
            own = self._rows(versions, {bucket})
            rows = rows.limit(0) if own is None else own
            for c, value in zip(self.fold.keys, given, strict=True):
                rows = rows.filter(F.col(f"`{c}`").eqNullSafe(value))
        return self.fold.current(rows)
