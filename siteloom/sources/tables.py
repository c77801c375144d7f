"""Declared schemas, readers and sinks of observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECT = "struct<x:double,y:double,width:double,height:double>"
COMPONENT = (
    "struct<tag:string,role:string,text:string,path:string,input_type:string,name:string,form:string,visible:boolean,"
    f"selected:boolean,rect:{RECT},attributes:map<string,string>>"
)
PAGE_STATE = (
    "site string, url string, title string, event_seq long, metadata map<string,string>, "
    f"components array<{COMPONENT}>, "
    "links array<struct<href:string,text:string,scheme:string>>, "
    "text_content array<struct<tag:string,text:string,path:string,visible:boolean>>, "
    "pseudo_styles array<struct<path:string,states:map<string,map<string,string>>>>, "
    "network_requests array<struct<method:string,url:string,status:long,failed:boolean>>"
)
NETWORK_EVENT = (
    "batch string, seq long, event_type string, url string, method string, resource_type string, status long, "
    "status_text string, headers map<string,string>, timestamp double, post_data string, failure_text string, body string"
)
EDGE_EVENT = "site string, event_id string, `from` string, `to` string, component string, action string, run_id string, event_seq long, ts timestamp"
PAGE_EVENT = "site string, event_id string, url string, status string, components long, description string, title string, event_seq long, ts timestamp"
REQUEST_EVENT = "site string, event_id string, method string, host string, path string, is_first_party boolean, event_seq long, ts timestamp"
VISIT_STEP = "visit_id string, step_seq long, page_url string, action string, target string, finished boolean, ts timestamp"
NAVIGATION = "crawl_id string, seq long, elapsed_seconds double, ts timestamp"


def _read(spark: SparkSession, path: str, schema: str, form: str) -> DataFrame:
    return spark.read.schema(schema).format(form).load(path)


def load_page_states(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Nested page snapshots; the schema is declared, never inferred."""
    return _read(spark, path, PAGE_STATE, form)


def load_network_events(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return _read(spark, path, NETWORK_EVENT, form)


def snapshot_rows(states: DataFrame, child: str) -> DataFrame:
    """One row per element of a child array of the snapshots, with its position."""
    return states.select("site", F.col("url").alias("page_url"), "event_seq", F.posexplode(child).alias("pos", "c")).select(
        "site", "page_url", "event_seq", "pos", "c.*"
    )


def save_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table of many sites, a partition each."""
    df.write.mode(mode).partitionBy("site").parquet(path)


def load_table(spark: SparkSession, path: str, schema: str, site: str | None = None) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    return found if site is None else found.filter(F.col("site") == site)


def graph_export(pages: DataFrame, edges: DataFrame, components: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per page with its edges, components and texts as arrays, to be written as JSON."""
    listed = lambda df, key, name, cols: df.groupBy(F.col(key).alias("url")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    found = pages.join(listed(edges, "from", "edges", ["to", "component", "action"]), "url", "left")
    found = found.join(listed(components, "page_url", "components", ["path", "tag", "text"]), "url", "left")
    return found.join(listed(texts, "page_url", "text_content", ["path", "tag", "text"]), "url", "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def catalogue_data(entries: DataFrame, props: DataFrame, variants: DataFrame) -> DataFrame:
    """One row per catalogue entry with its properties and variants as arrays, to be written as JSON."""
    listed = lambda df, name: df.groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "family_id")))).alias(name))
    return entries.join(listed(props, "props"), "family_id", "left").join(listed(variants, "variants"), "family_id", "left")


def token_data(colours: DataFrame, types: DataFrame, states: DataFrame) -> DataFrame:
    """Design tokens of all kinds in one table (kind, name, value, uses), to be written as JSON."""
    a = colours.select(F.lit("color").alias("kind"), "name", "value", "uses")
    b = types.select(F.lit("type").alias("kind"), "name", F.concat_ws(" ", "font_size", "font_weight").alias("value"), "uses")
    c = states.select(F.lit("state").alias("kind"), F.concat_ws(":", "state", "property").alias("name"), "value", "uses")
    return a.unionByName(b).unionByName(c)


def record_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def latest_run(runs: DataFrame, site: str | None = None) -> DataFrame:
    """The last manifest row of each site (or of one)."""
    own = runs if site is None else runs.filter(F.col("site") == site)
    columns = [c for c in runs.columns if c != "site"]
    return own.groupBy("site").agg(F.max_by(F.struct(*columns), "timestamp").alias("r")).select("site", "r.*")


def run_index(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), "site")
