from siteloom.plans.queries import _customer_pages
from siteloom.plans.shared import spread


def test_a_task_per_so_many_rows(spark):
    rows = spark.range(5000).coalesce(1)
    assert spread(rows, "id").rdd.getNumPartitions() == 3
    assert spread(rows, "id", rows=1000).distinct().count() == 5000


def test_pages_of_a_table_in_one_split_are_parsed_in_many_tasks(spark, tmp_path):
    customers = spark.range(5000).selectExpr("id AS c_custkey", "'A' AS c_mktsegment", "1 AS c_nationkey")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert _customer_pages(spark, str(tmp_path), ("texts",)).rdd.getNumPartitions() == 3
