"""The registered queries of this subpackage and their DuckDB SQL.

Each ``opN_`` query applies operator N to its whole table and derives the columns of its
result from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import (
    archive, bpe, common, exact_dedup, language_id, nearest, oracles, packing, page_text, ranked_search, secrets, sharding, simhash, spelling, token_cache, warc,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 4096


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_text.extract_texts(common.read_table(spark, sf_dir, "pages"))
    n_chars = F.char_length("text").cast("long").alias("n_chars")
    return found.select("page_id", "url", "text", n_chars, "n_lines", "n_shared", "pair_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    return bpe.decode(encoded, RANKS).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "op3-archive")
    archive.write_archive(archive.archive_records(common.read_table(spark, sf_dir, "pages")), path)
    records = archive.read_archive(spark, path).filter(F.col("warc_type").isin("response", "revisit"))
    told = F.substring_index("payload_digest", ":", -1)
    return records.select(
        archive.page_number(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        # Of a response, the digest of what was read; a revisit has its header only.
        F.when(F.col("payload").isNull(), told).otherwise(warc.base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        archive.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op4_rotated_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest.search(nearest.build_index(vectors), vectors.filter("vec_id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packed pieces of ``docs``, without the ids."""
    pieces = common.materialize(
        packing.token_pieces(docs, TOKENIZER, RANKS, public_tokenizers.PATTERN, ids=False), "packing-pieces"
    )
    groups = packing.groups_for(pieces.filter("start = 0").count())
    packed = packing.harmonic_pack(pieces, groups, spread=("id", "start", "ids_crc32"))
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read_table(spark, sf_dir, "documents"))


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = common.read_table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(common.text_or_empty().cast("binary")).alias("text_crc32"),
    )
    return sharding.interleave_shards(rows, shards=40, tie_breaks=("text_crc32", "size")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def language_model(docs: DataFrame) -> language_id.Model:
    """Fitted on the documents that the contract leaves for learning."""
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return language_id.fit(docs.filter(learns))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.read_table(spark, sf_dir, "documents"), words=3)
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of_kind("assign").alias("n_assign"),
        of_kind("access").alias("n_access"),
        of_kind("hex").alias("n_hex"),
        F.sha2(secrets.spans_text("base_spans"), 256).alias("base_sha256"),
        secrets.spans_text("spans").alias("spans"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(common.read_table(spark, sf_dir, "documents"), slips=97))


def op12_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"), k=10)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call begins with an empty cache, so it encodes every distinct text."""
    found = token_cache.count_tokens(common.read_table(spark, sf_dir, "documents"), PIECES, common.shared_path(spark, "token-cache"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_text": op1_page_text,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_rotated_bit_search": op4_rotated_bit_search,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_interleaved_shards": op6_interleaved_shards,
    "op7_exact_duplicates": op7_exact_duplicates,
    "op8_language": op8_language,
    "op9_simhash_components": op9_simhash_components,
    "op10_secret_spans": op10_secret_spans,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_best_positions": op12_best_positions,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op3_warc_round_trip": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
        SELECT page_id,
               strlen(payload)::BIGINT AS payload_bytes,
               translate(concat(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8),
                                to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8),
                                to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8),
                                to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8)),
                         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op7_exact_duplicates": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM t""",
} | oracles.SQL
