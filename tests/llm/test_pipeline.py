"""Every stage of the corpus pipeline against its own operator or plain Python."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_gam, shared


@pytest.fixture(scope="module")
def sf():
    """Larger than the other tests' table, so that the models have enough labels to learn from."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before the first stage and after each."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(shared.materialize(stage(spark, out[-1], sf), "stage"))
    return out


def test_columns_and_rows(stages):
    for before, after in zip(stages[:4], stages[1:5]):
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert after.exceptAll(before).count() == 0


def test_clean_documents_stay_and_junk_goes(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = stages[1].join(labels, "doc_id").groupBy("quality").count().collect()
    count = {r.quality: r["count"] for r in kept}
    total = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert count[1] >= 0.98 * total[1] and count.get(0, 0) <= 0.1 * total[0]
    assert stages[2].count() >= 0.97 * stages[1].count()


def test_one_of_each_copy(stages):
    assert stages[3].groupBy("text").count().where("count > 1").count() == 0


def test_no_leak_stays(spark, sf, stages):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = " ".join
    assert not [r for r in stages[4].collect() if any(whole(i.split()) in whole(r.text.split()) for i in items)]


def test_all_kept_documents_are_packed(stages):
    assert stages[5].select("doc_id").distinct().count() == stages[4].count()


def test_nulls_and_repeats(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "the and of", "en", "s", 1), (None, None, None, None, None), (990_001, "", "en", None, 0), (990_001, "", "en", None, 0)], base.schema)
    docs = base.limit(30).unionByName(base.limit(3)).unionByName(odd).withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    docs = shared.materialize(docs, "odd")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = shared.materialize(stage(spark, docs, sf), "odd")
        assert docs.columns[-2:] == ["score", "id"]
    assert corpus_pipeline.packed(spark, docs, sf).count() >= docs.count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark, sf):
    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(7, one, "x"), (7, two, "x"), (7, two, "y"), (8, one, "x"), (None, one, "x"), (None, three, "x"), (None, three, "x"), (9, two, "x"), (9, two, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 5):
        kept = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs.orderBy(F.rand(n)).repartition(n), sf).collect()), key=str)
        assert len(kept) == 3 and {(i, t) for i, t, _ in kept} == {(7, one), (7, two), (None, three)}
        assert n == 1 or kept == before
        before = kept


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[5].count()
    assert quality_gam.FEATURES[0] == "log_bytes"
