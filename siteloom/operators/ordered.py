"""Ordered operators: visits, budgets, slowdowns, snapshots, top-k with a remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import labels
from siteloom.plans.shared import materialize

BEFORE = (W.unboundedPreceding, 0)
BINS = "_bin"


def running(rows: DataFrame, by: list[str], order: list, sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums and minima, from the first row of the group to this one, in a total order.

    Rows are sorted by ranges, so that a group may lie in many tasks: each range adds what the ranges before it
    hold of the group, from one row per group and range.
    """
    totals = {k: (F.sum, F.lit(0), c) for k, c in (sums or {}).items()} | {k: (F.min, None, c) for k, c in (least or {}).items()}
    keys = [F.col(c) for c in by]
    placed = rows.select("*", *(c.alias(f"_of_{k}") for k, (_, _, c) in totals.items()))
    placed = materialize(placed.repartitionByRange(*keys, *order).withColumn(BINS, F.spark_partition_id()), "ranges")
    inner = W.partitionBy(*by, BINS).orderBy(*order).rowsBetween(*BEFORE)
    earlier = W.partitionBy(*by).orderBy(BINS).rowsBetween(W.unboundedPreceding, -1)
    ends = placed.groupBy(*by, BINS).agg(*(f(f"_of_{k}").alias(f"_in_{k}") for k, (f, _, _) in totals.items()))
    ends = ends.select(*by, BINS, *(f(f"_in_{k}").over(earlier).alias(f"_before_{k}") for k, (f, _, _) in totals.items()))
    ends = materialize(ends, "range-ends")
    same = [placed[c].eqNullSafe(ends[c]) for c in (*by, BINS)]
    found = placed.join(ends, same, "left").drop(*(ends[c] for c in (*by, BINS)))
    for k, (f, zero, _) in totals.items():
        own = f(f"_of_{k}").over(inner)
        before = F.col(f"_before_{k}")
        found = found.withColumn(k, own + F.coalesce(before, zero) if zero is not None else F.least(own, before))
    return found.drop(BINS, *(f"_{x}_{k}" for k in totals for x in ("of", "before")))


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "n") -> DataFrame:
    """``rows`` with their number, from 1, in the order of their group."""
    return running(rows, by, order, sums={name: F.lit(1).cast("long")})


def traces(steps: DataFrame) -> DataFrame:
    """Per visit the ordered steps (step_seq, page_url, action, label, navigated, target, requests)
    and where it began and ended; steps without a visit are left out, longest visits first."""
    own = steps.filter("visit_id is not null and step_seq is not null")
    step = F.struct("step_seq", "page_url", "action", "label", "navigated", "target", "requests")
    last = F.max_by("target", F.when(F.col("navigated"), F.col("step_seq")))
    start = F.min_by("page_url", "step_seq")
    return own.groupBy("visit_id").agg(
        F.array_sort(F.collect_list(step)).alias("steps"),
        F.count("*").alias("length"),
        start.alias("start_page"),
        F.coalesce(last, start).alias("end_page"),
    ).orderBy(F.desc("length"), "visit_id")


def observable_traces(found: DataFrame) -> DataFrame:
    """Traces where something navigated or called."""
    return found.filter(F.exists("steps", lambda x: x["navigated"] | (x["requests"] > 0)))


def trace_titles(found: DataFrame) -> DataFrame:
    """The first step's action and label, and the page where the visit ended."""
    first = F.get("steps", F.lit(0))
    return found.select("visit_id", F.trim(F.concat_ws(" ", first["action"], first["label"], F.lit("on"), "end_page")).alias("title"))


def trace_assertions(found: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per observed request outcome with its method and path, and the final page where it changed."""
    told = F.when(F.col("failed"), "failed").when(F.col("status").isNotNull(), F.concat(F.lit("answered "), F.col("status").cast("string"))).otherwise("sent")
    sent = requests.join(found.select("visit_id"), "visit_id", "left_semi").select("visit_id", "step_seq", F.concat_ws(" ", "method", "request_path").alias("subject"), told.alias("outcome"))
    moved = found.filter("end_page <> start_page").select(
        "visit_id", F.lit(None).cast("long").alias("step_seq"), F.col("end_page").alias("subject"), F.lit("page").alias("outcome")
    )
    return sent.unionByName(moved)


def budget_cut(visits: DataFrame, pages: int | None = None, nodes: int | None = None, minutes: float | None = None) -> DataFrame:
    """Per run the first visit (run_id, seq, elapsed_minutes, found, interrupted) at which a cap is
    met, with the reason. Pages come before nodes before minutes; only completed visits are pages."""
    counts = {"_done": F.when(F.col("interrupted"), 0).otherwise(1), "_seen": F.col("found")}
    so_far = running(visits, ["run_id"], [F.col("seq")], sums=counts)
    reason = F.lit(None).cast("string")
    for name, value, cap in (("minutes", "elapsed_minutes", minutes), ("nodes", "_seen", nodes), ("pages", "_done", pages)):
        if cap is not None:
            reason = F.when(F.col(value) >= cap, name).otherwise(reason)
    cut = so_far.withColumn("reason", reason).filter("reason is not null")
    return cut.groupBy("run_id").agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def slowdown_ratio(navigations: DataFrame) -> DataFrame:
    """Elapsed time over the fastest so far of the crawl."""
    found = running(navigations, ["crawl_id"], [F.col("seq")], least={"_fastest": F.col("elapsed_seconds")})
    fastest = F.col("_fastest")
    return found.withColumn("ratio", F.when(fastest > 0, F.col("elapsed_seconds") / fastest).otherwise(1.0)).drop("_fastest")


def backoff_step(acc: Column, x: Column, ceiling: float | None, slow: float, stop: float) -> Column:
    """One navigation: the wait grows to half the elapsed time if it is slow, else it halves. Without a ceiling
    neither wait nor breaker changes."""
    fastest = F.least(acc["fastest"], x["elapsed_seconds"])
    if ceiling is None:
        return F.struct(fastest.alias("fastest"), acc["wait"].alias("wait"), acc["broken"].alias("broken"))
    ratio = F.when(fastest > 0, x["elapsed_seconds"] / fastest).otherwise(1.0)
    grown = F.greatest(acc["wait"], x["elapsed_seconds"] * 0.5)
    wait = F.when(ratio > slow, F.least(grown, F.lit(ceiling))).otherwise(acc["wait"] / 2)
    return F.struct(fastest.alias("fastest"), wait.alias("wait"), (acc["broken"] | (ratio >= stop)).alias("broken"))


def backoff_state(navigations: DataFrame, ceiling: float | None = 30.0, slow: float = 2.0, stop: float = 4.0) -> DataFrame:
    """Per crawl the wait after its last navigation and whether the breaker was ever met."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "elapsed_seconds")))
    start = F.struct(F.lit(float("inf")).alias("fastest"), F.lit(0.0).alias("wait"), F.lit(False).alias("broken"))
    found = navigations.groupBy("crawl_id").agg(rows.alias("r"))
    state = F.aggregate("r", start, lambda acc, x: backoff_step(acc, x, ceiling, slow, stop))
    return found.select("crawl_id", state.alias("s")).select("crawl_id", "s.*")


def requeue_exhausted(visits: DataFrame, most: int = 3) -> DataFrame:
    """Pages interrupted more than ``most`` times."""
    n = visits.filter("interrupted").groupBy("run_id", "url").agg(F.count("*").alias("interruptions"))
    return n.filter(F.col("interruptions") > most)


def run_totals(visits: DataFrame, most: int = 3) -> DataFrame:
    gave_up = requeue_exhausted(visits, most).groupBy("run_id").agg(F.count("*").alias("gave_up"))
    found = visits.groupBy("run_id").agg(
        F.count("*").alias("visits"),
        F.countDistinct(F.when(~F.col("interrupted"), F.col("url"))).alias("unique_pages"),
        F.count_if("interrupted").alias("requeued"),
    )
    return found.join(gave_up, "run_id", "left").fillna(0, ["gave_up"])


def capped_rows(rows: DataFrame, by: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group, with whether there were more."""
    w = W.partitionBy(*by)
    found = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > cap)
    return found.filter(F.col("_n") <= cap).drop("_n")


def page_facts(components: DataFrame, cap: int = 60) -> DataFrame:
    """(page_url, type, text, current_value, choices, interacted, truncated): the controls of each page by path,
    a stepper once by its container and a choice group once by its name, ``cap`` of them at most.

    components: page_url, path, text, component_type, interacted, options (rows of path, text, selected), group_name.
    """
    told = components.withColumn("_o", labels.described_options(F.col("options"), F.coalesce("group_name", F.lit(""))))
    kind, none = F.col("_o.kind"), F.lit(None)
    single = F.when(kind == labels.STEPPER, F.concat(F.lit("s"), F.coalesce(F.nullif(F.col("_o.container"), F.lit("")), "path")))
    single = single.when(kind == "choice_group", F.concat(F.lit("g"), "_o.name"))
    first = F.row_number().over(W.partitionBy("page_url", F.coalesce(single, F.concat(F.lit("p"), "path"))).orderBy("path"))
    kept = told.withColumn("_first", first).filter("_first = 1")
    kept = capped_rows(kept, ["page_url"], ["path"], cap)
    text = F.nullif(F.coalesce("text", F.lit("")), F.lit(""))
    choices = F.filter(F.transform("_o.choices", lambda x: x["text"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return kept.select(
        "page_url", "path",
        F.when(kind == labels.STEPPER, "stepper control (increment/decrement)").when(kind == "choice_group", "choice group (dropdown/menu/radio/checkbox)")
        .otherwise(F.coalesce("component_type", F.lit("element"))).alias("type"),
        F.when(kind == labels.STEPPER, F.coalesce(text, F.lit("quantity control"))).when(kind == "choice_group", F.format_string("group '%s'", "_o.name"))
        .otherwise(F.coalesce(text, F.lit("(no accessible label found on this element)"))).alias("text"),
        F.when(kind == labels.STEPPER, F.col("_o.current_value")).otherwise(none).alias("current_value"),
        F.when(kind == "choice_group", choices).alias("choices"), "interacted", "truncated",
    )


def chunked(rows: DataFrame, by: str, order: list, size: int = 5) -> DataFrame:
    """Rows with ``chunk``: consecutive runs of ``size`` rows within a section."""
    found = numbered(rows, [by], [F.col(c) if isinstance(c, str) else c for c in order], "_n")
    return found.withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def first_texts(rows: DataFrame, by: str, text: str, pos: str, cap: int = 20) -> DataFrame:
    """The first ``cap`` distinct texts of each group in order of appearance, and how many were left out."""
    seen = materialize(rows.groupBy(by, text).agg(F.min(pos).alias("_pos")), "texts")
    # Each task passes on its own first ones only.
    ranked = seen.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("_pos", text))).filter(F.col("_n") <= cap)
    kept = F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda x: x[text])
    firsts = ranked.groupBy(F.col(by).alias("_by")).agg(kept.alias("texts"))
    counts = seen.groupBy(by).agg(F.count("*").alias("_c"))
    found = counts.join(firsts, F.col(by).eqNullSafe(F.col("_by")))
    return found.select(by, "texts", F.greatest(F.col("_c") - cap, F.lit(0)).alias("omitted"))


def top_with_rest(rows: DataFrame, name: str, value: str, top: int = 15) -> DataFrame:
    """The ``top`` largest rows and one row ``other`` with the sum of the rest."""
    largest = rows.orderBy(F.desc(value), name).limit(top)
    rest = rows.join(largest.select(name), name, "left_anti").agg(F.lit("other").alias(name), F.sum(value).alias(value))
    return largest.select(name, value).unionByName(rest.filter(F.col(value).isNotNull()))


def snapshot_signature(components: DataFrame, by: list[str]) -> DataFrame:
    """Order-independent fingerprint of the visible component identities of each snapshot."""
    identities = F.to_json(F.array_sort(F.collect_list("identity")))
    seen = components.filter("visible").groupBy(*by).agg(F.substring(F.sha1(identities), 1, 10).alias("signature"))
    return seen


def overlap_ratio(before: Column, after: Column) -> Column:
    """Share of the identities before that are still there; 1 if there were none."""
    kept, all_ = F.size(F.array_intersect(before, after)), F.size(F.array_distinct(before))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(kept / all_)


def state_transitions(snapshots: DataFrame, by: str, order: str, least: float = 0.5) -> DataFrame:
    """Consecutive snapshots (array ``identities``) of a page that overlap by less than ``least``."""
    w = W.partitionBy(by).orderBy(order)
    pairs = snapshots.withColumn("before", F.lag("identities").over(w)).withColumn("previous", F.lag(order).over(w))
    found = pairs.filter("before is not null").withColumn("overlap", overlap_ratio(F.col("before"), F.col("identities")))
    return found.filter(F.col("overlap") < least).select(by, "previous", order, "overlap")


def revealed_options(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Options that are new after an interaction, or were hidden before it."""
    roles = ("option", "menuitem", "menuitemcheckbox", "menuitemradio", "tab")
    prior = before.select(*keys, "path", F.col("visible").alias("_was"), F.lit(True).alias("_had"))
    found = after.filter(F.lower("role").isin(*roles)).join(prior, [*keys, "path"], "left")
    return found.filter(F.col("_had").isNull() | (~F.col("_was") & F.col("visible"))).drop("_was", "_had")
