import pytest

from foldwise import label_runs, multi_arange, prefix_sum, relabel_masked, relabel_unique, run_count, run_starts
from pyspark.sql import functions as F


def rows(spark, x):
    return spark.createDataFrame(list(enumerate(x)), "p long, x long")


def test_multi_arange(spark):
    got = multi_arange(rows(spark, [0, 0, 3, 0, 0, 2, 0, 2, 1]), "p", "x").orderBy("p", "value").collect()
    assert [r["value"] for r in got] == [0, 1, 2, 0, 1, 0, 1, 0]


@pytest.mark.parametrize("x, want", [([0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1, 1], [0, 1, 1, 0, 0, 2, 0, 0, 0, 3, 3, 3]), ([0, 3, 3, 0, 0, 5, 5, 5, 1, 1, 0, 2], [0, 1, 1, 0, 0, 2, 2, 2, 3, 3, 0, 4])])
@pytest.mark.parametrize("block", [2, 5, 100])
def test_label_runs(spark, x, want, block):
    assert [r["label"] for r in label_runs(rows(spark, x), "p", "x", block=block).orderBy("p").collect()] == want


def test_relabel(spark):
    x = [0, 3, 3, 3, 0, 2, 5, 2, 0, 1, 1, 0, 3, 5, 5]
    assert [r["relabelled"] for r in relabel_unique(rows(spark, x), "x").orderBy("p").collect()] == [0, 3, 3, 3, 0, 2, 4, 2, 0, 1, 1, 0, 3, 4, 4]
    mask = spark.createDataFrame(list(enumerate(map(bool, [0, 1, 0, 1, 1, 1]))), "x long, keep boolean")
    got = [r["relabelled"] for r in relabel_masked(rows(spark, x), "x", mask, "keep").orderBy("p").collect()]
    # Label 4 is kept by the mask, met or not, so 5 becomes 4.
    assert got == [0, 2, 2, 2, 0, 0, 4, 0, 0, 1, 1, 0, 2, 4, 4]


def test_runs_and_prefix(spark):
    df = rows(spark, [1, 1, 1, 2, 2, 3, 3, 4, 5, 2, 2])
    for block in (1, 3, 50):
        assert sorted(r["start"] for r in run_starts(df, "p", "x", block).collect()) == [0, 3, 5, 7, 8, 9, 11]
        assert run_count(df, "p", "x", block).first()["runs"] == 6
        assert [r["s"] for r in prefix_sum(df, "p", F.col("x"), "s", block).orderBy("p").collect()] == [1, 2, 3, 5, 7, 10, 13, 17, 22, 24, 26]
    assert run_starts(df.where("false"), "p", "x").count() == 0
