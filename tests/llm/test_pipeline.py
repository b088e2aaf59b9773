import random

import corpus_pipeline
from siltstone.llm.common import materialize

from .helpers import documents, prose, save


def corpus(spark, tmp_path):
    rng = random.Random(11)
    clean = [prose(rng, 200) for _ in range(60)]
    item = prose(rng, 40)
    toxic = [prose(rng, 60) + " vilest loathsome wretch vilest " + prose(rng, 40) for _ in range(60)]
    near = [t.rsplit(" ", 1)[0] + " ending" for t in clean[:5]]
    leak = [f"{prose(rng, 50)} {item} {prose(rng, 50)}" for _ in range(3)]
    private = [f"{prose(rng, 60)} u{i}@mail.com {prose(rng, 20)}" for i in range(4)]
    texts = [*clean, *toxic, *near, clean[7], *leak, *private, None, ""]
    save(documents(spark, texts), tmp_path, "documents")
    save(spark.createDataFrame([(0, item)], "item_id long, text string"), tmp_path, "benchmark")
    rows = [(i, 1, 0) for i in range(60)] + [(i, 1, 1) for i in range(60, 120)]
    return save(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), tmp_path, "labels"), texts


def test_stages(spark, tmp_path):
    sf, texts = corpus(spark, tmp_path)
    n = len(texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    want = set(range(n))
    gone = {
        "toxicity": set(range(60, 120)), "near_duplicates": {*range(120, 126), n - 1}, "decontamination": {126, 127, 128}, "personal_data": set(),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        want -= gone[name]
        rows = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in rows} == want and len(rows) == len(want), name
    assert all("[EMAIL]" in r.text and "@" not in r.text for r in rows if 129 <= r.doc_id < 133)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == want and max(r.offset + r.length for r in packed) <= 4096
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r)[:5] for r in packed)


def test_pipeline_of_nothing(spark, tmp_path):
    sf, _ = corpus(spark, tmp_path)
    save(documents(spark, []), tmp_path, "documents")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_take_any_rows(spark, tmp_path):
    """Null and repeated doc_ids, columns whose names the operators use themselves, and a large group of near copies."""
    from pyspark.sql import functions as F

    sf, texts = corpus(spark, tmp_path)
    rng = random.Random(2)
    base = prose(rng, 150).split()
    copies = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"v{i}"
        copies.append(" ".join(w))
    extra = documents(spark, [*copies, "null one", "null one", "twice", "twice"], [*range(1000, 1300), None, None, 2000, 2000])
    clashing = {"base": F.lit(1), "others": F.lit(2), "spans": F.lit("s"), "label": F.lit(3), "node": F.lit(4), "token": F.lit(5), "fp": F.lit(6), "same": F.lit(7), "hash": F.lit(8), "sequence_id": F.lit(9), "n": F.lit(10)}
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra).withColumns(clashing)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, columns = materialize(stage(spark, docs, sf), name), docs.columns
        assert docs.columns == columns, name
        assert docs.where("base = 1 AND others = 2 AND spans = 's' AND label = 3 AND n = 10").count() == docs.count() < before
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert [i for i in ids if i is not None and 1000 <= i < 1300] == [1000]
    assert ids.count(None) == 2 and ids.count(2000) == 2  # rows with a null doc_id stay; equal ids share their fate
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == len(set(ids))
