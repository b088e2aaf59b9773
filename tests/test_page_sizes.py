"""Pages of a folder log keep their size when the table grows."""

from siltstone.sources.pages import FolderLog, PagedSource
from siltstone.streaming import sinks


def test_pages_are_bounded(spark, tmp_path):
    sinks.add_pages(spark.range(100).repartition(2), f"{tmp_path}/log", "0", rows_a_page=20)
    sinks.add_pages(spark.range(100, 1000).coalesce(1), f"{tmp_path}/log", "1", rows_a_page=20)
    log = FolderLog({"path": f"{tmp_path}/log"})
    sizes = [len(log.fetch(t)[0]) for t in log.tokens()[:-1]]
    assert max(sizes) == 20 and sum(sizes) == 1000
    spark.dataSource.register(PagedSource)
    read = spark.read.format("pages").option("service", "siltstone.sources.pages:FolderLog").option("path", f"{tmp_path}/log").option("schema", "id long").load()
    assert sorted(r.id for r in read.collect()) == list(range(1000)) and read.rdd.getNumPartitions() == len(sizes)
