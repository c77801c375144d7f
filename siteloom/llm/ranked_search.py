"""Ranked search of a set of queries against all documents, by best positions.

1. Documents are tokenised once for the terms of the queries, and postings are stored: a row a document with
   its number of terms, and the numbers and frequencies of the query terms it holds.
2. The statistics are sums over that table.
3. Each task takes its postings in blocks. In a block, a term's impact list has the documents by falling impact, and
   the rows themselves are the forward index for direct access. For a query the lists are read down together,
   and every document met is scored whole by its row. As that row tells the document's positions in
   all lists, each list has a best position: all places before it are seen. No unseen document can have more than
   the sum of the impacts that lie next to the best positions, and reading stops when this is strictly below the
   k-th score, since an equal score could still win by its id. The k best go along from block to block.
4. The best of all tasks are ranked, first within groups of tasks.

Depths of reading grow eightfold, and the last step reads the lists to their ends.

Queries are taken in blocks of a bounded number of terms, each of which is one run over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.llm import common

#: Terms, summed over its queries, at which a block of queries is full; a single query may have more.
BLOCK_TERMS = 1 << 18
#: Postings that a task ranks at a time.
BLOCK_POSTINGS = 1 << 22
#: Places of each list that are read first.
DEPTH, GROWTH = 8, 8
#: Bytes of a text that are tokenised at a time.
PART_BYTES = 1 << 20
#: Groups in which the best of all tasks are ranked first.
GROUPS = 64

#: All ASCII bytes but letters and digits separate terms; A-Z are lower-cased.
_TERMS = bytes(x if x >= 128 or chr(x) in "0123456789abcdefghijklmnopqrstuvwxyz" else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def terms(text: bytes | None) -> Counter[bytes]:
    """The terms of a text in UTF-8 and how often it holds each."""
    found: Counter[bytes] = Counter()
    start = 0
    text = text or b""
    while start < len(text):
        end = len(text)
        if end - start > PART_BYTES and (cut := _SEPARATOR.search(text, start + PART_BYTES)):
            end = cut.start()
        found.update(text[start:end].translate(_TERMS).split())
        start = end
    return found


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [list(terms(x)) for x in batch["text"].to_pylist()]
        yield pa.record_batch({"item": batch["item"], "terms": pa.array(lists, pa.list_(pa.binary()))})


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = vocabulary.value
        for batch in batches:
            sizes, ends, held, often = [], [0], [], []
            for text in batch["text"]:
                found = terms(text.as_py())
                sizes.append(found.total())
                for term in found.keys() & places.keys():
                    held.append(places[term])
                    often.append(found[term])
                ends.append(len(held))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((held, pa.int32()), (often, pa.int64()))]
            yield pa.record_batch({"id": batch["id"], "n": pa.array(sizes, pa.int64()), "terms": lists[0], "tfs": lists[1]})

    return run


class Block:
    """Postings of some documents: rows for direct access, and a list by falling impact for each term."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = rows["id"].fill_null(0).to_numpy()
        self.no_id = rows["id"].is_null().to_numpy()
        lists, often = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
        self.row_ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
        self.row_terms = lists.flatten().to_numpy().astype(np.int64)
        tf = often.flatten().to_numpy()
        docs = np.repeat(np.arange(len(self.ids)), np.diff(self.row_ends))
        m = 10 + 90 * rows["n"].to_numpy() * n_docs // n_terms
        self.row_impacts = weights[self.row_terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
        order = np.lexsort((-self.row_impacts, self.row_terms))
        self.list_docs, self.list_impacts = docs[order], self.row_impacts[order]
        self.list_ends = np.concatenate(([0], np.cumsum(np.bincount(self.row_terms, minlength=len(weights)))))
        #: Where in the lists each entry of the rows lies.
        self.row_places = np.empty(len(order), np.int64)
        self.row_places[order] = np.arange(len(order))
        self.mark = np.full(len(weights), -1)

    def rows_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the entries of all rows of ``docs``, and for each the number of its document among them."""
        sizes = self.row_ends[docs + 1] - self.row_ends[docs]
        of = np.repeat(np.arange(len(docs)), sizes)
        begins = np.cumsum(sizes) - sizes
        return np.arange(len(of)) - begins[of] + self.row_ends[docs][of], of


class Best:
    """The k best (score, id) so far; a document without id comes after all others of its score."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.no_id, self.ids = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """The k-th score, 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero(scores >= max(1, self.least))
        if not len(at):
            return
        scores = np.concatenate((self.scores, scores[at]))
        no_id, ids = np.concatenate((self.no_id, no_id[at])), np.concatenate((self.ids, ids[at]))
        top = np.lexsort((ids, no_id, -scores))[: self.k]
        self.scores, self.no_id, self.ids = scores[top], no_id[top], ids[top]


def best_positions(block: Block, query: np.ndarray, best: Best) -> int:
    """Add to ``best`` what the block holds for the terms ``query``; returns how many places of the lists were read."""
    starts, ends = block.list_ends[query], block.list_ends[query + 1]
    query, starts, ends = (x[ends > starts] for x in (query, starts, ends))
    if not len(query) or block.list_impacts[starts].sum() < best.least:
        return 0
    block.mark[query] = np.arange(len(query))
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    seen_places = np.zeros(int(sizes.sum()), bool)
    seen = np.zeros(len(block.ids), bool)
    at = np.zeros(len(query), np.int64)  # the first place after each list's best position
    depth = DEPTH
    while True:
        whole = depth * 4 >= sizes.max()
        upto = sizes if whole else np.minimum(sizes, depth)
        read = np.concatenate([block.list_docs[s : s + d] for s, d in zip(starts, upto, strict=True)])
        if whole:
            impacts = np.concatenate([block.list_impacts[s : s + d] for s, d in zip(starts, upto, strict=True)])
            scores = _sums(read, impacts, len(block.ids))
            scores[seen] = 0
            best.add(scores, block.no_id, block.ids)
            break
        docs = np.unique(read[~seen[read]])
        seen[docs] = True
        entries, of = block.rows_of(docs)
        wanted = block.mark[block.row_terms[entries]]
        entries, of, wanted = entries[wanted >= 0], of[wanted >= 0], wanted[wanted >= 0]
        best.add(_sums(of, block.row_impacts[entries], len(docs)), block.no_id[docs], block.ids[docs])
        seen_places[block.row_places[entries] - starts[wanted] + offsets[wanted]] = True
        bound = 0
        for i, (offset, size) in enumerate(zip(offsets.tolist(), sizes.tolist(), strict=True)):
            ahead = seen_places[offset + at[i] : offset + size]
            step = int(ahead.argmin()) if len(ahead) else 0
            at[i] += len(ahead) if len(ahead) and ahead[step] else step
            bound += int(block.list_impacts[starts[i] + at[i]]) if at[i] < size else 0
        if bound < best.least or not bound:
            break
        depth *= GROWTH
    block.mark[query] = -1
    return int(upto.sum())


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit integers by their numbers, exact."""
    found = np.zeros(n, np.int64)
    np.add.at(found, of, values)
    return found


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries, n_docs, n_terms = shared.value
        bests = [Best(k) for _ in queries]

        def take(held: list[pa.RecordBatch]) -> None:
            block = Block(pa.Table.from_batches(held), weights, n_docs, n_terms)
            for query, best in zip(queries, bests, strict=True):
                best_positions(block, query, best)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch["terms"].flatten())
            if size >= BLOCK_POSTINGS:
                take(held)
                held, size = [], 0
        if held:
            take(held)
        for i, best in enumerate(bests):
            ids = pa.array(best.ids, pa.int64(), mask=best.no_id)
            yield pa.record_batch({"query": pa.array([i] * len(ids), pa.int32()), "id": ids, "score": pa.array(best.scores, pa.int64())})

    return run


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = (F.col("score").desc(), F.col("id").asc_nulls_last())
    near = found.withColumn("group", F.spark_partition_id() % GROUPS)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy(key, "group").orderBy(*order))).filter(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k).drop("group")


def _run(docs: DataFrame, items: list[tuple[object, set[bytes]]], k: int) -> DataFrame:
    """(query, rank, id, score) for one block of queries, numbered from 0."""
    spark = docs.sparkSession
    vocabulary = {x: i for i, x in enumerate(sorted(set().union(*(x for _, x in items))))}
    postings = docs.mapInArrow(_postings(spark.sparkContext.broadcast(vocabulary)), "id long, n long, terms array<int>, tfs array<long>")
    postings = common.materialize(postings, "search-postings")
    n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, count in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = count
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = [np.array(sorted(vocabulary[x] for x in own), np.int64) for _, own in items]
    found = postings.filter(F.size("terms") > 0).mapInArrow(_search(spark.sparkContext.broadcast((weights, queries, n_docs, n_terms)), k), "query int, id long, score long")
    return _ranked(found, "query", k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each item: item, rank, id, score.

    Ids are integers. Only scores above 0 are given; equal ones go by ascending id, null ids last. Rows with an id
    in common are documents each, so a repeated row comes twice. Items that share an id, or have none, are one item
    with all their terms. Null and empty texts have no terms: as a document they are never found, as an item they
    find nothing. Empty tables give an empty result. Other columns are left out.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    told = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("text"))
    kind = told.schema["item"].dataType
    schema = f"item {kind.simpleString()}, terms array<binary>"
    told = told.mapInArrow(_item_terms, schema).select("item", F.explode("terms").alias("term")).distinct()
    told = common.materialize(told.repartitionByRange("item").sortWithinPartitions("item"), "search-items")

    found, block, size = [], [], 0

    def take() -> None:
        numbers = docs.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"query int, item {kind.simpleString()}")
        best = _run(rows, block, k).join(numbers, "query")
        found.append(best.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score"))

    for row in told.orderBy("item").toLocalIterator():
        if not block or block[-1][0] != row.item:
            if size >= BLOCK_TERMS:
                take()
                block, size = [], 0
            block.append((row.item, set()))
        block[-1][1].add(bytes(row.term))
        size += 1
    if not block:
        return docs.sparkSession.createDataFrame([], f"`{item}` {kind.simpleString()}, rank int, `{id}` long, score long")
    take()
    result = found[0]
    for other in found[1:]:
        result = result.unionAll(other)
    return result
