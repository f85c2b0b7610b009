import time
import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import common
from tidemark.llm import ngram_join as nj

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    return tmp_path


def kinds(folder):
    return sorted(x.name.rsplit("-", 1)[0] for x in folder.iterdir())


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_join_leaves_its_result_alone(spark, folder):
    got = nj.join_groups(common.table(spark, SF, "documents"), k=3, t=(9, 10))
    assert kinds(folder) == ["groups"]
    assert sorted(got.collect()) == sorted(got.collect()) and got.count() == 200


def test_join_without_families_leaves_its_result_alone(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (4, None)], "doc_id long, text string")
    got = nj.join_groups(docs, k=3, t=(9, 10))
    assert kinds(folder) == ["groups"]
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (2, 2, 1), (3, 2, 3), (4, 0, 4)]


def test_pipeline_keeps_one_stage(spark, folder):
    got = cp.run(spark, SF)
    assert [x for x in kinds(folder) if x.startswith("stage-")] == ["stage-sentencepiece"]
    assert got.count() > 50 and got.count() == got.count()


def test_steps_free_shuffle_files_and_tables(spark, folder):
    steps, before = common.Steps(spark), shuffle_files(spark)
    was = spark.conf.get(common.FREE_SHUFFLES, None)
    first = steps.cut(spark.range(20_000).groupBy(F.col("id") % 7_000).count(), "first")
    second = steps.cut(first.groupBy("count").agg(F.count("*").alias("n")), "second")
    assert spark.conf.get(common.FREE_SHUFFLES, None) == was
    end = time.time() + 20  # they are deleted in the background
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kinds(folder) == ["first", "second"]
    steps.drop(first)
    assert kinds(folder) == ["second"]
    assert sorted(map(tuple, second.collect())) == [(2, 1_000), (3, 6_000)]
    steps.drop_all_but(second)
    assert kinds(folder) == ["second"]
