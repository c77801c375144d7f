import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siteloom.llm import archive, common, nearest, queries, sharding, warc

# WARC


ROWS = [
    (3, "http://a/é x\n", "<p>", 1),
    (1, "u", "<p>", 1),
    (2, None, None, 1),
    (4, "u", "", 1),
    (None, "z", "<p>", 1),
    (5, "y", "x" * 300_000, 1),
    (6, "y", "x" * 300_000, 1),
    (7, "r", "\r\n\r\n", 1),
    (8, "r", "one", 1),
    (8, "r", "one", 1),
]


@pytest.fixture(scope="module")
def written(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest int").repartition(3)
    path = common.shared_path(spark, "test-archive")
    archive.write_archive(archive.archive_records(pages), path)
    return path


def test_round_trip(spark, written):
    rows = archive.read_archive(spark, written).collect()
    assert len(rows) == len(ROWS)
    texts = {i: t or "" for i, _, t, _ in ROWS}
    for x in rows:
        number = x.record_id[len("<urn:page:") : -1]
        text = texts[None if number == "null" else int(number)].encode()
        digest = base64.b32encode(hashlib.sha1(text).digest()).decode()
        assert x.payload_length == len(text) and x.payload_digest == f"sha1:{digest}"
        assert (bytes(x.payload) == text) if x.warc_type == "response" else x.payload is None
    kinds = {x.record_id: (x.warc_type, x.refers_to) for x in rows}
    assert kinds["<urn:page:3>"] == ("revisit", "<urn:page:1>") and kinds["<urn:page:4>"] == ("revisit", "<urn:page:2>")
    assert kinds["<urn:page:null>"][0] == "revisit" and kinds["<urn:page:8>"] == ("response", None)


def test_filters_reach_the_source(spark, written, capsys):
    found = archive.read_archive(spark, written, payload=False).filter("warc_type = 'revisit' and target_uri like 'y%'")
    assert [x.record_id for x in found.collect()] == ["<urn:page:6>"]
    found.explain()
    assert "Filter" not in capsys.readouterr().out.replace("RuntimeFilters", "")
    assert archive.read_archive(spark, written).filter("warc_type in ('response', 'x') and payload_length > 9").count() == 1


def test_foreign_files_and_skipping():
    rows = [
        dict(record_id=f"r{i}", warc_type="revisit" if i == 2 else "response", target_uri="u" * i * 700, payload_digest=None,
             refers_to=None, payload=b"a\r\n\r\nb" * i * 20_000)
        for i in range(5)
    ]
    records = [warc.build_record(x, "2024-01-01T00:00:00Z") for x in rows]
    for join, compressed in ((warc.gzip_member, True), (gzip.compress, True), (bytes, False)):
        data = b"".join(map(join, records))
        for keep in (lambda x: True, lambda x: x["record_id"] == "r4"):
            got = list(warc.read_records(pa.BufferReader(data), compressed, keep, True))
            want = [x for x in rows if keep(x)]
            assert [x["record_id"] for x in got] == [x["record_id"] for x in want]
            assert all(x["payload_length"] == len(y["payload"]) for x, y in zip(got, want, strict=True))
            assert all(x["payload"] in (y["payload"], None) for x, y in zip(got, want, strict=True))


def test_empty_archive_and_overwrite(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = common.shared_path(spark, "test-archive")
    archive.write_archive(archive.archive_records(pages), path)
    assert archive.read_archive(spark, path).count() == 0


def test_small_files_share_a_partition(tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * 10)
    reader = warc.WarcReader({"path": str(tmp_path), "partitionbytes": "25"}, None)
    assert [len(x.files) for x in reader.partitions()] == [2, 2]


# Nearest neighbours


def test_search_equals_brute_force(spark, sf_dir):
    rows = common.read_table(spark, sf_dir, "embeddings").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in queries.op4_rotated_bit_search(spark, sf_dir).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        want = np.lexsort((ids, far))[:10]
        own = sorted(got[ids[i]])
        assert [k for k, _, _ in own] == list(range(1, 11))
        for _, v, score in own:
            assert abs(score - far[ids.tolist().index(v)]) < 1e-12
        hits += len({v for _, v, _ in own} & set(ids[want].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_search_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, None]),
        (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 3.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None),
        (9, [float("inf"), 1.0]), (10, []),
    ]
    vectors = spark.createDataFrame([(*x, b"c", 1.0) for x in rows], "vec_id long, embedding array<double>, code binary, length double")
    index = nearest.build_index(vectors)
    for block in (4096, 1):
        found = nearest.search(index, vectors.filter("vec_id % 100 = 0"), block=max(2, block)).collect()
        got = sorted((x.query_id, x["rank"], x.id) for x in found)
        assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 100), (0, 4, 6), (100, 1, 0), (100, 2, 1), (100, 3, 6)]
    empty = vectors.limit(0)
    assert nearest.search(nearest.build_index(empty), empty).count() == 0


# Shards


def _check_shards(rows, n, shards):
    sizes = Counter(x.shard for x in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for x in rows:
        slots[x.shard].append(x.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_match_the_mixture(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    found = sharding.interleave_shards(docs, shards=8, bucket_rows=16).collect()
    _check_shards(found, 2000, 8)
    for source in ("big", "s0", "s3"):
        counts = Counter(x.shard for x in found if x.source == source)
        assert max(counts.values()) - min(counts.values()) <= 4
    again = sharding.interleave_shards(docs.repartition(2), shards=8, bucket_rows=16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    other = sharding.interleave_shards(docs, shards=8, seed=1, bucket_rows=16).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, found))


def test_sources_of_one_row_spread_over_the_shards(spark):
    rows = spark.createDataFrame([(i, f"own{i}") for i in range(800)], "doc_id long, source string")
    found = sharding.interleave_shards(rows, shards=8, bucket_rows=16).collect()
    _check_shards(found, 800, 8)


def test_shards_odd_rows(docs, no_docs):
    # The given column named shard is replaced.
    found = sharding.interleave_shards(docs, shards=4, tie_breaks=("text",))
    assert sorted(found.columns) == sorted([*docs.columns, "slot"])
    _check_shards(found.collect(), docs.count(), 4)
    assert sharding.interleave_shards(no_docs, shards=4).count() == 0


def test_one_key_is_dealt_to_parts(spark):
    rows = [(None, "a", "same")] * 600 + [(7, "a", "t")] * 300 + [(i, "b", "u") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    stored = common.materialize(df.na.fill({"doc_id": -1}), "hot")
    salts = {x.salt for x in common.spread_hot(stored, ["doc_id"], 100, "salt").filter("doc_id = -1").collect()}
    assert salts == set(range(6))
    found = sharding.interleave_shards(df, shards=5, tie_breaks=("text",), bucket_rows=1).collect()
    _check_shards(found, len(rows), 5)
    assert {sum(x.shard == k and x.source == "b" for x in found) for k in range(5)} <= set(range(57, 64))


def test_op6(spark, sf_dir):
    rows = queries.op6_interleaved_shards(spark, sf_dir).collect()
    _check_shards(rows, common.read_table(spark, sf_dir, "documents").count(), 40)
