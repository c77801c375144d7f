"""A stored inverted index over the prose columns, and BM25 search in it.

An index is a folder a table: ``postings/bucket=<b>`` holds the terms that hash to b, each as blocks of up to ``BLOCK``
postings by falling weight, with the largest weight of the block; ``totals`` has the numbers of documents and of words,
``terms`` in how many documents a term is and up to which block its best ones go. A search reads the buckets of its words only.

A build shuffles twice: texts by id, so that the words of an id are counted where they lie, and postings into ranges of
(hash of the term, term, falling weight, id), so that a task cuts what it holds into blocks, and a frequent word lies in many tasks.

Blocks are left out before their postings are read: the best block of each word gives a lower bound of the last
score that is asked for; a block whose largest weight, with the largest ones of all other words, stays below
it can't hold a document of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.plans.shared import discard, materialize

# What can be searched, by table.
TARGETS = {"Page": "description", "Component": "text", "TextContent": "text", "ComponentFamily": "purpose"}
K1, B = 1.2, 0.75
BUCKET_BITS, BLOCK = 6, 1024
#: Rows, bytes of text and postings that a task of a build should hold.
TASK_ROWS, TASK_BYTES, TASK_POSTINGS = 100_000, 1 << 22, 500_000


def _column(table: str) -> str:
    if table not in TARGETS:
        raise ValueError(f"no index for table {table!r}; there are: {', '.join(TARGETS)}")
    return TARGETS[table]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _bucket(term: Column) -> Column:
    """The first bits of the hash, so that terms in the order of their hashes are in the order of their buckets."""
    return F.shiftrightunsigned(F.xxhash64(term), 64 - BUCKET_BITS).cast("int")


def _cut(size: int):
    """Reads postings (term, id, w), those of a term together and by falling weight; yields blocks of a term."""

    def blocks(own: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts, len(own)).astype(np.int32)
        firsts = pa.array(starts)
        postings = pa.StructArray.from_arrays([own["id"], own["w"]], ["id", "w"])
        return pa.record_batch(
            {
                "term": own["term"].take(firsts),
                "top": own["w"].take(firsts),
                "held": pa.array(np.diff(ends).astype(np.int64)),
                "postings": pa.ListArray.from_arrays(pa.array(ends), postings),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            own = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            term, at = own["term"], np.arange(len(own))
            new = np.append(True, pc.not_equal(term.slice(1), term.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False))
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % size == 0)
            # The last block may go on in the next batch.
            rest = own.slice(int(starts[-1]))
            if len(starts) > 1:
                yield blocks(own.slice(0, int(starts[-1])), starts[:-1])
        if rest is not None:
            yield blocks(rest, np.zeros(1, np.int64))

    return run


def build_index(rows: DataFrame, table: str, path: str) -> None:
    """Index the rows (id and the table's prose column, other columns are left out); null texts have no words."""
    own = rows.select("id", F.col(_column(table)).alias("t"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    own = own.repartition(n // TASK_ROWS + size // TASK_BYTES + 1, "id").select("id", _words(F.col("t")).alias("t"))
    tf = own.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    tf = materialize(tf, "search-tf")
    n_postings, n_words = tf.agg(F.count("*"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    mean = n_words / n if n else 0.0
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    weighed = tf.select(F.xxhash64("term").alias("hash"), "term", "id", weight.alias("w"))
    order = ["hash", "term", F.desc("w"), "id"]
    placed = weighed.repartitionByRange(n_postings // TASK_POSTINGS + 1, *order).sortWithinPartitions(*order)
    kind = rows.schema["id"].dataType
    posting = f"postings array<struct<id:{kind.simpleString()},w:double>>"
    # Numbers of blocks grow along a term, with gaps; at the ends of ranges blocks may be short.
    blocks = placed.drop("hash").mapInArrow(_cut(BLOCK), f"term string, top double, held long, {posting}")
    blocks = blocks.withColumns({"block": F.monotonically_increasing_id(), "bucket": _bucket(F.col("term"))})
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{table}/postings")
    discard(tf)
    stored = rows.sparkSession.read.schema(blocks.schema).parquet(f"{path}/{table}/postings").select("bucket", "term", "held", "block")
    upto = F.coalesce(F.min(F.when(F.col("held") >= BLOCK, F.col("block"))), F.max("block"))
    terms = stored.repartition("bucket").groupBy("bucket", "term").agg(F.sum("held").alias("df"), upto.alias("best"))
    terms.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{table}/terms")
    # A null id beside the totals tells its type.
    totals = rows.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(float(mean)).alias("mean"), F.lit(None).cast(kind).alias("id"))
    totals.write.mode("overwrite").parquet(f"{path}/{table}/totals")


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def kept_blocks(spark: SparkSession, path: str, table: str, words: list[str], limit: int) -> DataFrame:
    """(term, idf, top, postings) of the blocks that can hold a document of the result."""
    asked = sorted({x.lower() for x in words})
    buckets = [x[0] for x in spark.createDataFrame([(x,) for x in asked], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    totals = spark.read.parquet(f"{path}/{table}/totals")
    kinds = {"terms": "term string, df long, best long, bucket int", "postings": f"term string, block long, top double, postings array<struct<id:{totals.schema['id'].dataType.simpleString()},w:double>>, bucket int"}
    own = lambda part: spark.read.schema(kinds[part]).parquet(f"{path}/{table}/{part}").filter(F.col("bucket").isin(buckets) & F.col("term").isin(asked))
    n, df = F.col("n"), F.col("df")
    idf = own("terms").crossJoin(F.broadcast(totals.select("n"))).select("term", "best", F.ln(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    idf = F.broadcast(materialize(idf, "search-idf"))  # one row a word of the query
    blocks = own("postings").join(idf, "term")
    best = blocks.filter("block <= best")  # the blocks of each word up to its first whole one
    tops = {x.term: x.top for x in best.groupBy("term").agg(F.max(F.col("top") * F.col("idf")).alias("top")).collect()}
    first = best.select("idf", F.explode("postings").alias("p")).groupBy("p.id").agg(F.sum(F.col("p.w") * F.col("idf")).alias("score"))
    least = first.orderBy(F.desc("score")).limit(limit).agg(F.when(F.count("*") == limit, F.min("score"))).first()[0]
    if least is None:
        return blocks
    rest = sum(tops.values())
    # A rounding error's width is left, so that equal scores stay.
    return blocks.filter(F.col("top") * F.col("idf") + F.lit(rest) - F.element_at(F.create_map(*(F.lit(x) for pair in tops.items() for x in pair)), F.col("term")) >= least - 1e-6)


def search_index(spark: SparkSession, path: str, table: str, words: list[str], limit: int = 10) -> DataFrame | None:
    """(id, score): the ``limit`` best rows of a table by BM25, equal scores by id.

    An unknown table is an error. Where no index was built for the table there is nothing to search: null.
    """
    _column(table)
    if not _exists(spark, f"{path}/{table}/totals/_SUCCESS"):
        return None
    found = kept_blocks(spark, path, table, words, limit).select("idf", F.explode("postings").alias("p"))
    scored = found.groupBy("p.id").agg(F.round(F.sum(F.col("p.w") * F.col("idf")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)
