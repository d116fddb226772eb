"""Pages of a sorted table and look-ups in buckets: same rows, and what the plans read."""

import random
import uuid

from pyspark.sql import functions as F

from quillflow.operators import merge, relational
from quillflow.sources import layouts


def files_read(df):
    return len(df.inputFiles())


def test_pages(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(500)]), i, f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, n long, text string").repartition(5)
    path = str(tmp_path / "pages")
    layouts.write_paged(df, path, ["id", "n"], ranges=5)
    ranges = spark.read.parquet(f"{path}/ranks").count()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for skip, limit in ((0, 10), (0, 2000), (490, 30), (1990, 100), (1000, 1), (5000, 10), (7, 0)):
        got = [tuple(r) for r in layouts.read_page(spark, path, skip, limit).collect()]
        assert got == want[skip : skip + limit], (skip, limit)
        plain = relational.page(df.withColumn("key", F.struct(F.col("id").isNotNull(), "id", "n")), skip, limit, "key")
        assert got == [tuple(r)[:3] for r in plain.collect()]
    assert ranges > 2 and files_read(layouts.read_page(spark, path, 1990, 10)) == 1
    assert sorted(map(tuple, layouts.rows_between(spark, path, "id", 77, 78).collect())) == sorted(r for r in rows if r[0] in (77, 78))
    assert files_read(layouts.rows_between(spark, path, "id", 77, 77)) < ranges and layouts.rows_between(spark, path, "id", 900, 999).count() == 0
    layouts.write_paged(df.limit(0), str(tmp_path / "none"), ["id"])
    assert layouts.read_page(spark, str(tmp_path / "none")).count() == 0


def test_stored_works(spark):
    works = spark.createDataFrame([("10.1/A", "one"), ("10.1/a", "two"), (" 10.2/b", "three"), (None, "none")], "doi string, titulo_original string")
    records = spark.createDataFrame([(1, "10.1/a"), (2, "10.2/B "), (3, None), (4, "10.9/x"), (1, "10.1/a")], "id long, doi string")
    table = f"works_{uuid.uuid4().hex}"
    try:
        merge.store_works(works, table, 4)
        found = merge.with_stored_work(records, table)
        want = merge.with_work(records, works, by_title=False)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        joined = plan.split("== Initial Plan ==")[-1]
        left, right = joined[joined.index("SortMergeJoin") :].split("Scan ExistingRDD")
        assert "Exchange" in left and "Exchange" not in right and "Bucketed: true" in right, plan
        point = spark.table(table).where("doi_key = '10.2/b'")
        assert point.count() == 1 and "EqualTo(doi_key,10.2/b)" in point._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql(f"drop table if exists {table}")
