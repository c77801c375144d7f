"""Crawl-shaped tables derived from the driver's tables, and the same derivations as SQL.

The SQL constants are common table expressions that oracles begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``k``, the page that the event is about."""
    events = read(spark, sf_dir, "events")
    return events.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))


EVENTS = """ev AS (
    SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events)"""


def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation events: of each user, from the page of one event to that of the next."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = event_rows(spark, sf_dir).withColumn("to", F.lead("k").over(w)).filter("`to` is not null and k <> `to`")
    return rows.select(
        F.col("k").alias("from"), "to", F.col("event_type").alias("component"), F.col("event_type").alias("action"),
        F.concat(F.lit("run"), (F.dayofmonth("ts") % 3).cast("string")).alias("run_id"), F.col("event_id").alias("event_seq"), "ts",
    )


EDGES = EVENTS + """, stepped AS (
    SELECT *, lead(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ev),
edge_events AS (
    SELECT k AS src, nxt AS dst, event_type AS component, event_type AS action,
           'run' || (day(ts) % 3) AS run_id, event_id AS event_seq, ts
    FROM stepped WHERE nxt IS NOT NULL AND k <> nxt)"""


def simple_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_events(spark, sf_dir).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


GRAPH = EDGES + ", g AS (SELECT DISTINCT src, dst FROM edge_events)"


def _named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site of pages in levels: regions link to nations, these to customers, these to their orders."""
    tables = (("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey"))
    levels = [read(spark, sf_dir, t).select(_named(p, a).alias("src"), _named(q, b).alias("dst")) for t, p, a, q, b in tables]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


TREE = """tr AS (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers around it."""
    return read(spark, sf_dir, "customer").select(_named("n", "c_nationkey").alias("src"), _named("c", "c_custkey").alias("dst"))


def wheel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five wheels: each market segment's hub is linked to its customers, each customer to the next one, and hub to hub."""
    c = read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    by = W.partitionBy("c_mktsegment").orderBy("c_custkey")
    spokes = c.select(F.concat(F.lit("hub "), "c_mktsegment").alias("src"), _named("c", "c_custkey").alias("dst"))
    rim = c.withColumn("next", F.lead("c_custkey").over(by)).filter("next is not null").select(_named("c", "c_custkey").alias("src"), _named("c", "next").alias("dst"))
    hubs = c.select("c_mktsegment").distinct().withColumn("next", F.lead("c_mktsegment").over(W.orderBy("c_mktsegment"))).filter("next is not null")
    return spokes.unionByName(rim).unionByName(hubs.select(F.concat(F.lit("hub "), "c_mktsegment").alias("src"), F.concat(F.lit("hub "), "next").alias("dst")))


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers alike in nation, segment and balance in a ring, each linked to the next one and the one after that."""
    c = read(spark, sf_dir, "customer").withColumn("bin", F.floor(F.col("c_acctbal") / 2000))
    by = W.partitionBy("c_nationkey", "c_mktsegment", "bin")
    at = c.select("c_custkey", F.row_number().over(by.orderBy("c_custkey")).alias("i"), F.collect_list("c_custkey").over(by.orderBy("c_custkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("ring"))
    nxt = at.select("c_custkey", "i", "ring", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    to = F.get("ring", F.expr("(i + d) % size(ring)"))
    return nxt.select(F.format_string("c%08d", "c_custkey").alias("src"), F.format_string("c%08d", to).alias("dst")).filter("src <> dst").distinct()


RINGS = """cr AS (
    SELECT c_custkey, row_number() OVER w AS i, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 2000)) AS n,
           c_nationkey AS a, c_mktsegment AS b, floor(c_acctbal / 2000) AS c
    FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 2000) ORDER BY c_custkey)),
ring AS (
    SELECT DISTINCT 'c' || lpad(x.c_custkey::VARCHAR, 8, '0') AS src, 'c' || lpad(y.c_custkey::VARCHAR, 8, '0') AS dst
    FROM cr x, unnest([0, 1]) AS t(d), cr y WHERE x.a = y.a AND x.b = y.b AND x.c = y.c AND y.i = (x.i + d) % x.n + 1 AND x.c_custkey <> y.c_custkey)"""


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "Finished").when(F.col("event_type") == "error", "Failed").otherwise("Pending")
    return event_rows(spark, sf_dir).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "k").alias("url"), status.alias("status"), F.floor("value").cast("long").alias("components"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("page "), F.col("event_id").cast("string"))).otherwise("").alias("description"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("title "), F.col("event_id").cast("string"))).otherwise("").alias("title"),
        F.col("event_id").alias("event_seq"), "ts",
    )


PAGE_EVENTS = EVENTS + """, pe AS (
    SELECT user_id || '/' || k AS url, CASE event_type WHEN 'purchase' THEN 'Finished' WHEN 'error' THEN 'Failed' ELSE 'Pending' END AS status,
           floor(value)::BIGINT AS components,
           CASE WHEN event_type = 'view' THEN 'page ' || event_id ELSE '' END AS description,
           CASE WHEN event_type = 'click' THEN 'title ' || event_id ELSE '' END AS title, event_id AS event_seq, ts
    FROM ev)"""


def visit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the visits of a user and day."""
    visit = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    rows = event_rows(spark, sf_dir).withColumn("visit_id", visit)
    w = W.partitionBy("visit_id").orderBy("ts", "event_id")
    target = F.lead("k").over(w)
    moved = F.coalesce(target != F.col("k"), F.lit(False))
    return rows.select(
        "visit_id", F.row_number().over(w).cast("long").alias("step_seq"), F.col("k").alias("page_url"), F.col("event_type").alias("action"),
        F.col("event_type").alias("label"), moved.alias("navigated"), target.alias("target"),
        (F.col("event_type") == "purchase").cast("long").alias("requests"), "event_id", "ts", "value",
    )


VISITS = EVENTS + """, vis AS (
    SELECT *, user_id || '/' || strftime(ts, '%Y-%m-%d') AS visit_id FROM ev),
steps AS (
    SELECT visit_id, row_number() OVER w AS step_seq, k AS page_url, event_type AS action, event_type AS label,
           coalesce(lead(k) OVER w <> k, false) AS navigated, lead(k) OVER w AS target,
           (event_type = 'purchase')::BIGINT AS requests, event_id, ts, value
    FROM vis WINDOW w AS (PARTITION BY visit_id ORDER BY ts, event_id))"""


def visit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a run (a user) in order, with what they found; errors interrupt them."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    first = F.min("at").over(W.partitionBy("user_id"))
    return event_rows(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select(
        F.col("user_id").alias("run_id"), F.row_number().over(w).cast("long").alias("seq"), F.col("k").alias("url"),
        F.floor("value").cast("long").alias("found"), (F.col("event_type") == "error").alias("interrupted"),
        ((F.col("at") - first) / 60e6).alias("elapsed_minutes"), "value",
    )


RESULTS = EVENTS + """, vr AS (
    SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, k AS url,
           floor(value)::BIGINT AS found, event_type = 'error' AS interrupted,
           (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 60e6 AS elapsed_minutes, value
    FROM ev)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of ``/orders/<token>/items`` on a host of their priority."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 404).otherwise(201).cast("long")
    return o.select(
        F.when(F.col("o_orderstatus") == "O", "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("api"), F.substring("o_orderpriority", 1, 1), F.lit(".example.com")).alias("host"),
        F.concat(F.lit("/orders/"), F.md5(F.col("o_orderkey").cast("string")), F.lit("/items")).alias("path"),
        status.alias("status"), F.floor("o_totalprice").cast("long").alias("latency_ms"),
        (F.substring("o_orderpriority", 1, 1) != "5").alias("is_first_party"), F.col("o_orderkey").alias("event_seq"), "o_custkey", "o_orderpriority", "o_orderkey",
    )


REQUESTS = """rq AS (
    SELECT CASE WHEN o_orderstatus = 'O' THEN 'POST' ELSE 'GET' END AS method,
           'api' || substr(o_orderpriority, 1, 1) || '.example.com' AS host,
           '/orders/' || md5(o_orderkey::VARCHAR) || '/items' AS path,
           CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 201 END::BIGINT AS status,
           floor(o_totalprice)::BIGINT AS latency_ms, substr(o_orderpriority, 1, 1) <> '5' AS is_first_party,
           o_orderkey AS event_seq, o_custkey, o_orderpriority, o_orderkey
    FROM orders)"""


def part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components: brand is the tag, type the component type, words the classes."""
    p = read(spark, sf_dir, "part")
    size = F.concat(F.lit("size-"), F.floor(F.col("p_size") / 10).cast("string"))
    return p.select(
        F.concat(F.lit("page"), (F.col("p_partkey") % 40).cast("string")).alias("page_url"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_brand").alias("tag"), F.element_at(F.split("p_type", " "), -1).alias("component_type"),
        F.concat_ws(" ", F.lower("p_name"), size).alias("css_class"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"),
        F.format_string("rgb(%d, %d, %d)", F.col("p_size") * 5, (F.col("p_partkey") % 50).cast("int") * 5, F.lit(40)).alias("background_color"),
        F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"),
    )


PARTS = """pc AS (
    SELECT 'page' || (p_partkey % 40) AS page_url, 'p' || p_partkey AS path, p_brand AS tag,
           list_last(string_split(p_type, ' ')) AS component_type,
           lower(p_name) || ' ' || 'size-' || floor(p_size / 10)::INT AS css_class, p_partkey AS pos, p_name AS text,
           format('rgb({}, {}, {})', p_size * 5, (p_partkey % 50) * 5, 40) AS background_color,
           p_size::DOUBLE AS x, p_retailprice AS y,
           list_sort(list_distinct(list_filter(string_split(lower(p_name) || ' ' || 'size-' || floor(p_size / 10)::INT, ' '), lambda t: t <> ''))) AS tokens
    FROM part)"""


# Colours by use, and for each the first of the leaders so far that can't be told from it, else itself, one colour a step.
_LINEAR = "CASE WHEN {0} / 255.0 <= 0.04045 THEN 100 * {0} / 255.0 / 12.92 ELSE 100 * pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_CURVED = "CASE WHEN {0} > 0.008856 THEN pow({0}, 1.0 / 3) ELSE 7.787 * {0} + 16.0 / 116 END"
LAB_COLORS = (
    PARTS
    + f""", cu AS (SELECT 'surface' AS role, (p_size * 5)::INT AS r, ((p_partkey % 50) * 5)::INT AS g, 40 AS b FROM part UNION ALL SELECT 'text', 1, 2, (p_partkey % 9 * 3)::INT FROM part),
cn AS (SELECT role, r, g, b, count(*) AS uses, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, r, g, b) AS i FROM cu GROUP BY role, r, g, b),
ln AS (SELECT *, {_LINEAR.format("r")} AS lr, {_LINEAR.format("g")} AS lg, {_LINEAR.format("b")} AS lb FROM cn),
xz AS (SELECT *, (0.4124 * lr + 0.3576 * lg + 0.1805 * lb) / 95.047 AS x, (0.2126 * lr + 0.7152 * lg + 0.0722 * lb) / 100.0 AS y, (0.0193 * lr + 0.1192 * lg + 0.9505 * lb) / 108.883 AS z FROM ln),
fz AS (SELECT *, {_CURVED.format("x")} AS fx, {_CURVED.format("y")} AS fy, {_CURVED.format("z")} AS fz FROM xz),
lab AS (SELECT role, r, g, b, uses, i, (116 * fy - 16)::DOUBLE AS l, (500 * (fx - fy))::DOUBLE AS aa, (200 * (fy - fz))::DOUBLE AS bb FROM fz),
step(role, i, leaders, lead) AS (
    SELECT role, 0::BIGINT, []::STRUCT(i BIGINT, l DOUBLE, aa DOUBLE, bb DOUBLE)[], 0::BIGINT FROM lab WHERE i = 1
    UNION ALL SELECT role, i, CASE WHEN f IS NULL THEN list_append(leaders, struct_pack(i := i, l := l, aa := aa, bb := bb)) ELSE leaders END, coalesce(f, i) FROM (
        SELECT n.*, s.leaders, list_filter(s.leaders, lambda p: sqrt((p.l - n.l) ** 2 + (p.aa - n.aa) ** 2 + (p.bb - n.bb) ** 2) <= 2.3)[1].i AS f
        FROM step s JOIN lab n ON n.role = s.role AND n.i = s.i + 1)),
led AS (SELECT lab.*, step.lead FROM lab JOIN step ON step.role = lab.role AND step.i = lab.i)"""
)
