"""Values on the edge of a band, and keys that come twice."""

from siltstone.plans import analytics  # noqa: F401
from siltstone.registry import QUERIES, SQL

from .oracle import connection, duck_rows, spark_rows


def test_bucket_lookup_rounds_as_its_sql(spark, tmp_path):
    prices = [20000.5, 20001.5, 60000.5, 150000.5, 150000.51, 300000.5, 300001.0, 19999.5, None]
    rows = [*enumerate(prices), (0, 400000.0), (6, 5.0), (None, 70000.0), (None, 1.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = spark_rows(QUERIES["bucket_lookup"](spark, str(tmp_path)))
    assert got == duck_rows(connection(str(tmp_path)), SQL["bucket_lookup"])
