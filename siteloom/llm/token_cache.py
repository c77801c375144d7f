"""Token counts through a cache of digests.

The cache is a table in shared storage with a folder per tokenizer version, of rows (digest, n_tokens).
The digest is that of a text's content, null being the empty text. A tokenizer's own file tells whether it would
normalise further; what it does to a text it does to all texts of that digest.

1. The digests of all texts are made distinct, with map-side combining, so copies cost one row a task. Each keeps the
   smallest id of its rows.
2. Those that the version's folder lacks are misses. Of each miss one text is encoded: where the misses can be sent to all
   workers, texts of the smallest id are encoded where they lie, and whole texts aren't shuffled. Rows that repeat both id and
   text, which nothing tells apart, cost one encoding a task. Beyond that, texts are made distinct by a shuffle.
3. The counts are appended to the folder, and every row takes its count from there.

A digest that two runs append at once lies there twice with the same count, and is read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import common

CACHE = "digest binary, n_tokens long"
#: Characters from which a text is cut where no token can cross, and texts that are encoded at a time.
CUT, ROWS = 1 << 16, 200

#: A space that a token may begin with but not go across, with something after it.
_CUTS = re.compile("(?s)(?<=[^ ▁]) (?=.)")


def version(model: str) -> str:
    """A tokenizer's version: the digest of its file and the library that reads it."""
    with open(model, "rb") as lines:
        file = hashlib.sha256(lines.read()).hexdigest()
    if model.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(f"{file}/{library.__name__}/{library.__version__}".encode()).hexdigest()[:32]


def _can_cut(model: str) -> bool:
    """Whether every token of a piece model lies between two cuts: none holds a space after something else,
    and nothing but the prefix is added to a text."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as lines:
        proto.ParseFromString(lines.read())
    text, train = proto.normalizer_spec, proto.trainer_spec
    plain = text.name == "identity" and text.add_dummy_prefix and not text.remove_extra_whitespaces and text.escape_whitespaces
    plain = plain and train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix
    return plain and not any(re.search("[^▁]▁", x.piece) for x in proto.pieces)


def cut(text: str, size: int) -> list[str]:
    """Parts of ``text`` of about ``size`` characters, without the one space between each two."""
    parts, start = [], 0
    while len(text) - start > size and (found := _CUTS.search(text, start + size)):
        parts.append(text[start : found.start()])
        start = found.end()
    return [*parts, text[start:]]


@lru_cache(maxsize=4)
def counter(model: str):
    """A function from texts to their numbers of tokens, without added tokens."""
    if model.endswith(".model"):
        import sentencepiece

        pieces, cuts = sentencepiece.SentencePieceProcessor(model_file=model), _can_cut(model)

        def count(texts: list[str]) -> list[int]:
            found = [0] * len(texts)
            short = [i for i, x in enumerate(texts) if len(x) <= CUT or not cuts]
            for i, ids in zip(short, pieces.encode([texts[i] for i in short], num_threads=1), strict=True):
                found[i] = len(ids)
            for i in set(range(len(texts))).difference(short):
                found[i] = sum(len(pieces.encode(x)) for x in cut(texts[i], CUT))
            return found

        return count

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


def _encoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(model), set()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            new = {}
            for i, x in enumerate(batch["digest"].to_pylist()):
                if x not in seen:
                    new.setdefault(x, i)
            seen.update(new)
            counts = count(batch["content"].take(pa.array(list(new.values()), pa.int64())).to_pylist())
            yield pa.record_batch({"digest": pa.array(list(new), pa.binary()), "n_tokens": pa.array(counts, pa.int64())})

    return run


def content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: str) -> Column:
    return F.unhex(F.sha2(content(text).cast("binary"), 256))


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n_tokens) of a version's folder, each digest once; empty where there is no folder yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, cache: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens by the tokenizer file ``model``.

    ``cache`` is a folder in storage that driver and executors share; it is made at the first call, and later
    ones encode only texts that no call of the same version has seen. Null and empty texts have no bytes, and the
    tokens of an empty text. Repeated rows come back as often as given, ids may be null, other columns are left out; an
    empty table gives an empty result and adds nothing.
    """
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/tokenizer={version(model)}"
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), digest(text).alias("digest"))
    wanted = common.materialize(rows.groupBy("digest").agg(F.min("_id").alias("first")), "token-digests")
    misses = common.materialize(wanted.join(cached(spark, folder), "digest", "left_anti"), "token-misses")
    if not misses.isEmpty():
        texts = docs.select(digest(text).alias("digest"), F.col(id).alias("_id"), content(text).alias("content"))
        few = common.broadcast_if_small(misses)
        if few is not misses:
            first = (texts["digest"] == few["digest"]) & texts["_id"].eqNullSafe(few["first"])
            texts = texts.join(few, first, "left_semi")
        else:
            texts = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
        texts.select("digest", "content").mapInArrow(_encoded(model), CACHE).write.mode("append").parquet(folder)
    counts = common.materialize(cached(spark, folder).join(wanted, "digest", "left_semi"), "token-counts")
    found = rows.join(common.broadcast_if_small(counts), "digest", "left")
    return found.select(F.col("_id").alias(id), "n_bytes", "n_tokens")
