"""Work that must spread over the cluster and follow the rows."""

from tracewright.plans import derived_app as app
from tracewright.plans.catalog import QUERIES

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def part_table(spark, folder, n):
    rows = [(k, f"part {k}", f"Brand#{k % 3}", ("PROMO", "SMALL", "LARGE")[k % 3], k % 50 + 1, 1000.0 + k) for k in range(n)]
    spark.createDataFrame(rows, PART).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_parse_errors_spreads_a_table_of_one_file(spark, tmp_path):
    found = QUERIES["parse_errors"](spark, part_table(spark, tmp_path, 200))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    problems = {(r.path, r.problem) for r in found.collect()}
    expected = {(f"{('promo_report', 'tests', 'large')[k % 3]}/mod_{k}.py", "file cannot be read" if k % 50 + 1 > 45 else "no text")
                for k in range(200) if k % 50 + 1 > 45 or k % 50 + 1 < 5}
    assert problems == expected


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(app, "TASK_ROWS", 5)
    part = spark.read.parquet(part_table(spark, tmp_path, 200) + "/part.parquet")
    assert app.spread(part).rdd.getNumPartitions() == 40
