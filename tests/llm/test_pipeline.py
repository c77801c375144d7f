import duckdb
import pytest

import corpus_pipeline
from siteloom.llm import common, exact_dedup, language_id, near_text, packing, queries, simhash


def test_stages_take_effect(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = docs.count()
    found = exact_dedup.exact_duplicates(docs)
    assert found.filter("not kept").count() == 0
    assert simhash.near_duplicates(docs).filter("doc_id <> component").count() == 0
    texts = [x.text for x in docs.collect()]
    assert not any("token = \"" in x for x in texts)
    assert kept["secrets"] == kept["near_dedup"] <= kept["exact_dedup"] < kept["language"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept["secrets"]
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_stages_on_odd_rows(spark, docs, no_docs):
    own = docs.select("doc_id", "text", "lang", "source").withColumn("n_chars", common.F.lit(0).cast("long"))
    left = [x.doc_id for x in corpus_pipeline.exact(spark, own, "").collect()]
    assert sorted(left) == [1, 3, 5, 6, 7, 8, 9]
    assert sorted(x.doc_id for x in corpus_pipeline.near(spark, own.filter("doc_id <> 6"), "").collect())[0] == 1
    assert corpus_pipeline.redact_secrets(spark, own, "").filter("doc_id = 9").first().n_chars < 100
    nothing = own.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0


@pytest.mark.parametrize(("stage", "module", "name"), [("language", language_id, "_predict"), ("near", near_text, "_sketches"), ("pack", packing, "_pieces")])
def test_a_worker_gets_few_bytes_at_a_time(spark, monkeypatch, stage, module, name):
    most, make = 1 << 16, getattr(module, name)

    def watched(*args):
        run = make(*args)

        def held(batches):
            for batch in batches:
                assert batch.nbytes <= 2 * most
                yield batch

        return lambda batches: run(held(batches))

    monkeypatch.setattr(common, "BATCH_BYTES", most)
    monkeypatch.setattr(module, name, watched)
    before = spark.conf.get(common.BATCH_SETTING, None)
    spark.conf.unset(common.BATCH_SETTING)
    try:
        text = common.F.concat_ws(" ", common.F.transform(common.F.sequence(common.F.lit(1), common.F.lit(99)), lambda k: common.F.sha1(common.F.concat("id", k))))
        rows = spark.range(300).select(common.F.col("id").alias("doc_id"), text.alias("text"), common.F.lit("en").alias("lang")).coalesce(1)
        rows = common.materialize(rows, "few-bytes")
        assert getattr(corpus_pipeline, stage)(spark, rows, "").select("doc_id").distinct().count() == 300
        spark.conf.set(common.BATCH_SETTING, "5000")
        common.bound_batches(spark)
        assert spark.conf.get(common.BATCH_SETTING) == "5000"
    finally:
        spark.conf.unset(common.BATCH_SETTING) if before is None else spark.conf.set(common.BATCH_SETTING, before)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    rows = sorted(map(repr, want.project(", ".join(order)).fetchall()))
    assert sorted(repr(tuple(x)) for x in got.select(*order).collect()) == rows
