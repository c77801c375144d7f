"""Structured Streaming forms: the folds over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siteloom.functions import urls
from siteloom.operators import fold, incremental

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state on disk by key, as processors with state and timers need it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def observation_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files: int = 100) -> DataFrame:
    """Files of a folder as they arrive, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def append_observations(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without the repeated deliveries of an id within ``delay``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def live_pages(events: DataFrame) -> DataFrame:
    return fold.current_pages(events)


def live_edges(events: DataFrame) -> DataFrame:
    return fold.current_edges(events)


def live_endpoints(requests: DataFrame) -> DataFrame:
    return fold.endpoint_counts(requests)


def stamped(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """Stream rows with first_party by the static table of sites (site, root_url)."""
    found = requests.join(sites, "site", "left")
    return found.withColumn("is_first_party", urls.is_in_scope(F.col("host"), F.coalesce("root_url", F.lit("")), True))


def run_available_to(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """All files that are there now, each batch handed to ``each``."""
    with keyed_state(df.sparkSession):
        q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
        q = q.trigger(availableNow=True).start()
    q.awaitTermination()


class Frontier(StatefulProcessor):
    """What a route shape has had: the clean URLs that were admitted or visited, until there are ``most``.

    Of new ones those of the smallest (pos, url) are admitted, of which no more are held than are left to the limit.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "clean string", "visited boolean")
        self.count = handle.getValueState("count", "n long")

    def _had(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def handleInitialState(self, key, initialState, timerValues) -> None:
        had = self._had()
        if had < self.most and not self.known.containsKey((initialState.clean,)):
            self.known.updateValue((initialState.clean,), (True,))
            self.count.update((had + 1,))

    def handleInputRows(self, key, rows, timerValues):
        had, best = self._had(), {}
        for x in rows:
            if had >= self.most:
                best = {}
                break
            if self.known.containsKey((x.clean,)):
                continue
            if x.visited:
                self.known.updateValue((x.clean,), (True,))
                had += 1
                best.pop(x.clean, None)
            else:
                best[x.clean] = min(best.get(x.clean, (x.pos, x.url)), (x.pos, x.url))
            if len(best) > self.most - had:
                del best[max(best, key=best.get)]
        for clean, (pos, url) in sorted(best.items(), key=lambda x: x[1]):
            self.known.updateValue((clean,), (False,))
            had += 1
            yield Row(url=url, clean=clean, shape=key[0], pos=pos)
        self.count.update((had,))

    def close(self) -> None:
        pass


#: Rows that a task holds before it reduces them.
HELD_LINKS = 1 << 16


def _first_links(most: int):
    """Reads rows of the frontier; yields, of what it holds at a time, the first ``most`` clean URLs of a shape by (pos, url),
    visited ones and others, each once. At most as many of them as the shape has had are known, so the rest is enough."""

    def reduced(held: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(held).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        rows = rows.sort_values(["pos", "url"], kind="stable").drop_duplicates(["shape", "visited", "clean"])
        rows = rows.groupby(["shape", "visited"], dropna=False, sort=False).head(most)
        return pa.Table.from_pandas(rows, schema=held[0].schema, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > HELD_LINKS:
                held = reduced(held).to_batches()
                if sum(map(len, held)) > HELD_LINKS // 2:
                    yield from held
                    held = []
        if held:
            yield from reduced(held).to_batches()

    return run


def frontier(candidates: DataFrame, base: Column, per_shape: int = 3, visited: DataFrame | None = None) -> DataFrame:
    """The links (url, clean, shape, pos) that a stream of candidates (url, pos) admits: http links in scope, each
    clean URL once over all batches, and at most ``per_shape`` a route shape over all batches.

    ``visited`` (url) are pages visited before the stream began; pages that are visited meanwhile come as rows of
    the stream with a true column ``visited``. Both count for their shape, and aren't admitted.
    """
    keyed = lambda df: df.withColumns({"clean": urls.clean_url(F.col("url")), "shape": urls.route_shape(F.col("url"))})
    told = candidates if "visited" in candidates.columns else candidates.withColumn("visited", F.lit(False))
    own = keyed(told.filter(F.col("visited") | (F.col("url").rlike("^https?://") & urls.is_in_scope(F.col("url"), base))))
    own = own.select("shape", "clean", "url", F.col("pos").cast("long").alias("pos"), "visited")
    own = own.mapInArrow(_first_links(per_shape), own.schema).groupBy("shape")
    before = None if visited is None else keyed(visited).select("shape", "clean").distinct().groupBy("shape")
    return own.transformWithState(Frontier(per_shape), "url string, clean string, shape string, pos long", "append", "none", before)


def live_frontier(candidates: DataFrame, base: Column, path: str, checkpoint: str, per_shape: int = 3, visited: DataFrame | None = None) -> None:
    """Each batch's new links of ``frontier`` as a folder of ``path``; a batch that is run again overwrites its own."""
    found = frontier(candidates, base, per_shape, visited)
    run_available_to(found, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), "append")


def live_coverage(events: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Finished and all pages after each batch, as folders of ``path``.

    The state of the pages is kept in ``path``-pages. A batch's output is the last totals and the sum of what it changed:
    one more for a page that is new or finished by now, one less for a page that was finished and isn't.
    """
    spark = events.sparkSession
    pages = incremental.StateTable(spark, f"{path}-pages", incremental.pages_fold(), buckets)
    done = lambda side: F.coalesce((F.col(f"{side}.settled.status") == fold.FINISHED).cast("long"), F.lit(0))
    schema = "finished long, total long, changed long"

    def each(batch: DataFrame, number: int) -> None:
        changes = pages.append(batch, number)
        gained, new = done("after") - done("before"), F.col("before").isNull().cast("long")
        told = changes.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("finished", gained), ("total", new), ("changed", F.lit(1)))))
        if number:
            last = spark.read.schema(schema).parquet(f"{path}/batch={number - 1}").select(F.col("finished").alias("f"), F.col("total").alias("t"))
            told = told.crossJoin(last).select((F.col("finished") + F.col("f")).alias("finished"), (F.col("total") + F.col("t")).alias("total"), "changed")
        told.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available_to(events, checkpoint, each, "append")


STEPS = "steps array<struct<step_seq:long,page_url:string,action:string>>"
TRACE = f"visit_id string, {STEPS}, length long, complete boolean"


class Traces(StatefulProcessor):
    """The visits of a bucket: their steps, the number of the last one, when they are given up, and whether they were told.

    A visit that is closed is remembered until it would be given up, so that what is delivered again opens no new one. Calls
    of the store are dear, so the visits of a bucket are one value with one timer, that of the visit that is given up first.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", f"visits array<struct<visit_id:string,{STEPS.replace(' ', ':', 1)},last:long,expires:long,closed:boolean>>, due long")

    def _trace(self, visit: str | None, steps: dict, complete: bool) -> Row:
        told = [Row(step_seq=k, page_url=a, action=b) for k, (a, b) in sorted(steps.items())]
        return Row(visit_id=visit, steps=told, length=len(told), complete=complete)

    def _read(self, watermark: int) -> tuple[dict, list[Row], int]:
        """The visits that are open or remembered, those that are given up now, and the bucket's timer (0: none)."""
        held, due = self.bucket.get() or ([], 0)
        visits, ended = {}, []
        for visit, steps, last, expires, closed in held:
            steps = {k: (a, b) for k, a, b in steps}
            if expires > watermark:
                visits[visit] = [steps, last, expires, closed]
            elif not closed:
                ended.append(self._trace(visit, steps, False))
        return visits, ended, due

    def _store(self, visits: dict, due: int) -> None:
        first = min((x[2] for x in visits.values()), default=0)
        if first != due:
            if due:
                self.handle.deleteTimer(due)
            if first:
                self.handle.registerTimer(first)
        if visits:
            self.bucket.update(([(k, [(n, *x) for n, x in v[0].items()], *v[1:]) for k, v in visits.items()], first))
        else:
            self.bucket.clear()

    def handleInputRows(self, key, rows, timerValues):
        # Timers come after these rows.
        visits, ended, due = self._read(timerValues.getCurrentWatermarkInMs())
        yield from ended
        met = set()
        for x in rows:
            own = visits.setdefault(x.visit_id, [{}, None, 0, False])
            own[2] = max(own[2], x.at + self.timeout_ms)
            if own[3] or x.step_seq in own[0]:
                continue
            own[0][x.step_seq] = (x.page_url, x.action)
            own[1] = x.step_seq if x.finished else own[1]
            met.add(x.visit_id)
        for visit in met:
            steps, last, _, _ = own = visits[visit]
            if last is not None and len(steps) == last:
                yield self._trace(visit, steps, True)
                own[0], own[3] = {}, True
        self._store(visits, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        visits, ended, _ = self._read(timerValues.getCurrentWatermarkInMs())
        yield from ended
        self._store(visits, 0)

    def close(self) -> None:
        pass


def visit_traces(steps: DataFrame, timeout_minutes: int = 30, delay: str = "10 minutes", buckets: int = 1 << 13) -> DataFrame:
    """One row per visit, with its steps in order.

    A visit is complete once all steps up to the one that is ``finished`` are there, in whatever order they come; steps
    are numbered from 1. It is given up, with the steps it has, when the watermark (``delay`` behind the latest
    ``ts``) passes its last step by ``timeout_minutes``. Repeated steps count once; those of a visit that was told
    are left out until then, later ones by the watermark.

    State is kept by ``buckets`` of visits: a batch reads and stores the buckets that it has visits of, so their number
    should be such that a bucket's open visits are some hundreds.
    """
    rows = steps.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts")).select("visit_id", "step_seq", "page_url", "action", "finished", "at", "ts")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("visit_id"), F.lit(buckets))).groupBy("bucket").transformWithState(Traces(timeout_minutes * 60_000), TRACE, "append", "eventTime")


SLOWDOWN = "crawl_id string, seq long, ratio double, wait double, broken boolean"


class Slowdown(StatefulProcessor):
    """The fastest navigation of a crawl, its wait, whether its breaker was met, and its last number."""

    def __init__(self, ceiling: float | None, slow: float, stop: float, idle_ms: int | None):
        self.ceiling, self.slow, self.stop, self.idle_ms = ceiling, slow, stop, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.crawl = handle.getValueState("crawl", "fastest double, wait double, broken boolean, seq long, expires long")

    def handleInputRows(self, key, rows, timerValues):
        fastest, wait, broken, seq, expires = self.crawl.get() if self.crawl.exists() else (float("inf"), 0.0, False, None, 0)
        if expires and expires <= timerValues.getCurrentWatermarkInMs():
            self.handle.deleteTimer(expires)
            fastest, wait, broken, seq, expires = float("inf"), 0.0, False, None, 0
        latest = expires
        for x in sorted(rows, key=lambda x: x.seq):
            if self.idle_ms is not None:
                latest = max(latest, x.at + self.idle_ms)
            if seq is not None and x.seq <= seq:
                continue
            seq, fastest = x.seq, min(fastest, x.elapsed_seconds)
            ratio = x.elapsed_seconds / fastest if fastest > 0 else 1.0
            if self.ceiling is not None:
                wait = min(self.ceiling, max(wait, 0.5 * x.elapsed_seconds)) if ratio > self.slow else wait / 2
                broken = broken or ratio >= self.stop
            yield Row(crawl_id=key[0], seq=x.seq, ratio=ratio, wait=wait, broken=broken)
        if latest != expires:
            if expires:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(latest)
        self.crawl.update((fastest, wait, broken, seq, latest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.crawl.clear()
        return iter(())

    def close(self) -> None:
        pass


def slowdown_monitor(
    navigations: DataFrame, ceiling: float | None = 30.0, slow: float = 2.0, stop: float = 4.0, idle_minutes: int | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Ratio, wait and breaker after each navigation, the state carried across batches.

    Navigations come in the order of ``seq``; one of a number that was passed is a repeated delivery and left out.
    Without a ceiling only the ratio changes. With ``idle_minutes`` a crawl's state goes once the watermark
    (``delay`` behind the latest ``ts``) passes its last navigation by so much.
    """
    rows = navigations
    if idle_minutes is not None:
        rows = rows.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    idle = None if idle_minutes is None else idle_minutes * 60_000
    return rows.groupBy("crawl_id").transformWithState(Slowdown(ceiling, slow, stop, idle), SLOWDOWN, "append", "none" if idle is None else "eventTime")
