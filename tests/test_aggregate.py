import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise import NAMES, axis_aggregate, broadcast_aggregate, from_array, group_aggregate, resolve, unpack, windowed_aggregate
from foldwise.operators import aggregate

N = math.nan


def dense(spark, g, a, func, **kw):
    out = group_aggregate(from_array(spark, g, a), "g", "a", func, pos="p", **kw)
    key = "p" if "p" in out.columns else "g"
    return [r["value"] for r in out.orderBy(key).collect()]


def same(got, want):
    return len(got) == len(want) and all((x is None and y is None) or (isinstance(y, float) and math.isnan(y) and math.isnan(x)) or x == y or (isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(got, want, strict=True))


# Golden arrays, as labels, values, function, options, expected.
TIES = [0, 0, 0, 0, 3, 3, 3, 3]
STEPS = [4, 3, 3, 4, 4, 1, 1, 1, 7, 8, 7, 4, 3, 3, 1, 1]
STEP_VALUES = [3, 4, 1, 3, 9, 9, 6, 7, 7, 0, 8, 2, 1, 8, 9, 8]
GOLDEN = [
    ([0, 1, 3, 1, 3], [101, 102, 103, 104, 105], "sum", {}, [101, 206, 0, 208]),
    ([1, 1, 2, 2, 2, 2, 4, 4], [1.0] * 8, "sum", {"dtype": T.LongType()}, [0, 2, 4, 0, 2]),
    ([2, 2, 4, 4, 4, 7, 7, 7], [2, 2, 4, 4, 4, 7, 7, 7], "prod", {}, [0, 0, 4, 0, 64, 0, 0, 343]),
    ([0, 1, 3, 1, 3], [101, 102, 103, 104, 105], "array", {}, [[101], [102, 104], None, [103, 105]]),
    ([0, 2, 2], [0, 1, 2], "sum", {"fill_value": -1}, [0, -1, 3]),
    (TIES, [4, 4, 3, 1, 10, 9, 9, 11], "argmax", {"fill_value": -1}, [0, -1, -1, 7]),
    (TIES, [4, 4, 3, 1, 10, 9, 9, 11], "argmin", {"fill_value": -1}, [3, -1, -1, 5]),
    (TIES, [4, 4, 3, 1, N, 1, 2, 3], "argmax", {"fill_value": -1}, [0, -1, -1, -1]),
    (TIES, [4, 4, 3, 1, N, 1, 2, 3], "argmin", {"fill_value": -1}, [3, -1, -1, -1]),
    (TIES, [4, 4, N, 1, N, N, N, N], "nanargmax", {"fill_value": -1}, [0, -1, -1, -1]),
    (TIES, [4, 4, N, 1, N, N, N, N], "nanargmin", {"fill_value": -1}, [3, -1, -1, -1]),
    ([0, 1, 2, 0, 1, 2], [-math.inf, 0, -math.inf, -math.inf, 0, 0], "max", {}, [-math.inf, 0.0, 0.0]),
    ([0, 1, 2, 0, 1, 2], [-math.inf, 0, -math.inf, -math.inf, 0, 0], "argmax", {"fill_value": -1}, [0, 1, 5]),
    ([0, 1, 2, 0, 1, 2], [math.inf, 0, math.inf, math.inf, 0, 0], "argmin", {"fill_value": -1}, [0, 1, 5]),
    (TIES, list(range(8)), "mean", {}, [1.5, 0.0, 0.0, 5.5]),
    (STEPS, STEP_VALUES, "cumsum", {}, [3, 4, 5, 6, 15, 9, 15, 22, 7, 0, 15, 17, 6, 14, 31, 39]),
    (STEPS, STEP_VALUES, "cummax", {}, [3, 4, 4, 3, 9, 9, 9, 9, 7, 0, 8, 9, 4, 8, 9, 9]),
    ([0, 0, 0, 1, 1, 0, 0], [2, 2, N, 2, 2, 2, 2], "nancumsum", {}, [2.0, 4.0, 4.0, 2.0, 4.0, 6.0, 8.0]),
    ([3, 3, 3, 2, 2, 2, 1, 1, 1], [3, 2, 1, 3, 4, 5, 5, 10, 1], "sort", {}, [1, 2, 3, 3, 4, 5, 1, 5, 10]),
    ([3, 3, 3, 2, 2, 2, 1, 1, 1], [3, 2, 1, 3, 4, 5, 5, 10, 1], "sort", {"reverse": True}, [3, 2, 1, 5, 4, 3, 10, 5, 1]),
    ([0, 0, 0, 0, 1], [0.0, 0.0, 0.0, 32768.0, 9.99999975e-06], "cumsum", {}, [0.0, 0.0, 0.0, 32768.0, 9.99999975e-06]),
]


@pytest.mark.parametrize("g, a, func, options, want", GOLDEN)
def test_golden(spark, g, a, func, options, want):
    assert same(dense(spark, g, a, func, **options), want)


#: What each function makes of the groups (1, NaN, 3), (NaN, NaN), none, (2, 2, 0); None stands for the fill.
TABLE = {
    "sum": (N, N, None, 4.0), "mean": (N, N, None, 4 / 3), "var": (N, N, None, 8 / 9), "min": (N, N, None, 0.0), "max": (N, N, None, 2.0),
    "argmax": (None, None, None, 5), "argmin": (None, None, None, 7), "len": (3, 2, None, 3), "nansum": (4.0, None, None, 4.0), "nanmean": (2.0, None, None, 4 / 3),
    "nanmin": (1.0, None, None, 0.0), "nanmax": (3.0, None, None, 2.0), "nanlen": (2, None, None, 3), "nanargmax": (2, None, None, 5), "nanargmin": (0, None, None, 7),
    "first": (1.0, N, None, 2.0), "nanlast": (3.0, None, None, 0.0), "sumofsquares": (N, N, None, 8.0), "nanprod": (3.0, None, None, 0.0), "nanstd": (1.0, None, None, math.sqrt(8 / 9)),
}
FLAGS = {"all": (True, True, False, False), "any": (True, True, False, True), "allnan": (False, True, False, False), "anynan": (True, True, False, False), "nanall": (True, False, False, False), "nanany": (True, False, False, True)}
TABLE_G, TABLE_A = [0, 0, 0, 1, 1, 3, 3, 3], [1, N, 3, N, N, 2, 2, 0]


@pytest.mark.parametrize("func", TABLE)
def test_nan_table(spark, func):
    assert same(dense(spark, TABLE_G, TABLE_A, func, fill_value=-7), [(-7.0 if isinstance(TABLE[func][3], float) else -7) if x is None else x for x in TABLE[func]])


@pytest.mark.parametrize("func", FLAGS)
def test_nan_flags(spark, func):
    assert dense(spark, TABLE_G, TABLE_A, func, fill_value=False) == list(FLAGS[func])


@pytest.mark.parametrize("func, numpy", [("sum", np.sum), ("prod", np.prod), ("mean", np.mean), ("std", np.std), ("nanvar", np.nanvar), ("nansum", np.nansum), ("min", np.min), ("nanmax", np.nanmax)])
def test_against_numpy(spark, func, numpy):
    rng = np.random.default_rng(100)
    g, a = rng.integers(0, 20, 400), rng.standard_normal(400)
    if func.startswith("nan"):
        a[::3] = N
    got = dense(spark, g, a, func)
    assert np.allclose(got, [numpy(a[g == k]) for k in range(20)])


@pytest.mark.parametrize("ddof", [0, 1, 2])
def test_ddof(spark, ddof):
    got = dense(spark, [0, 0, 0, 1, 1, 2], [1.0, 2.0, 4.0, 1.0, 3.0, 5.0], "nanvar", ddof=ddof, fill_value=-1)
    assert same(got, [float(np.var([1, 2, 4], ddof=ddof)), [1.0, 2.0, -1.0][ddof], [0.0, -1.0, -1.0][ddof]])


def test_callables_and_several(spark):
    df = from_array(spark, [0, 1, 2, 3, 3, 3, 3, 4, 5, 5, 5, 6, 5, 4, 3, 8, 8], list(range(17)))

    def many(x: pd.Series) -> float:
        return float(len(x) > 1)

    rows = group_aggregate(df, "g", "a", [many, "sum", "argmax"], pos="p", fill_value=0).orderBy("g").collect()
    assert [r["many"] for r in rows] == [0, 0, 0, 1, 1, 1, 0, 0, 1]
    assert [r["sum"] for r in rows][3:6] == [32, 20, 39]
    assert [r["argmax"] for r in rows][3:6] == [14, 13, 12]


def test_labels_of_two_dimensions(spark):
    df = from_array(spark, [[0, 1, 1], [2, 0, 0]], [1.0, 2.0, 3.0])
    for order in "CF":
        rows = {r["index"]: r["value"] for r in group_aggregate(df, ["g0", "g1"], "a", "sum", order=order).collect()}
        want = np.zeros((2, 3))
        want[0, 2], want[1, 0] = 1, 5
        assert [rows[k] for k in range(6)] == want.ravel(order=order).tolist()
    assert [r["value"] for r in group_aggregate(df, ["g0", "g1"], 1, "sum", size=(2, 4)).orderBy("index").collect()] == [0, 0, 1, 0, 2, 0, 0, 0]


def test_axes(spark):
    rows = [[1.0, 2.0], [4.0, 4.0], [5.0, 2.0], [N, 3.0], [8.0, 7.0]]
    df = spark.createDataFrame([(k, g, a) for k, (g, a) in enumerate(zip([1, 2, 2, 0, 1], rows, strict=True))], "row long, g long, m array<double>")
    got = {(r["g"], r["dim"]): r["value"] for r in axis_aggregate(df, "m", "nanmax", 0, row="row", labels="g", fill_value=N).collect()}
    assert math.isnan(got.pop((0, 0))) and got == {(0, 1): 3.0, (1, 0): 8.0, (1, 1): 7.0, (2, 0): 5.0, (2, 1): 4.0}
    labels = [0, 0, 2, 2, 2, 1, 1, 2, 2, 1, 1, 0]
    df = spark.createDataFrame([(0, [1.0] * 12), (1, [N] * 12)], "row long, m array<double>")
    got = axis_aggregate(df, "m", "argmax", -1, row="row", labels=labels, fill_value=-1).orderBy("row", "label").collect()
    assert [r["value"] for r in got] == [0, 5, 2, -1, -1, -1]
    with pytest.raises(ValueError):
        axis_aggregate(df, "m", "sum", 2, row="row", labels=labels)


def along(values, labels, axis, func, size):
    """Brute force: {(other places.., label): result of the group along an axis}."""
    out = {}
    moved = np.moveaxis(values, axis, -1)
    for at in np.ndindex(*moved.shape[:-1]):
        for label in range(size):
            out[(*at, label)] = func([(k, x) for k, x in enumerate(moved[at]) if labels[k] == label])
    return out


IN_ROWS = {
    "sum": sum, "prod": math.prod, "max": max, "first": lambda x: x[0], "last": lambda x: x[-1], "mean": np.mean, "nanmean": np.nanmean, "nanvar": np.nanvar, "nanstd": np.nanstd,
    "nanmin": np.nanmin, "nansum": np.nansum, "min": lambda x: np.min(x), "len": len, "nanlen": lambda x: sum(not math.isnan(v) for v in x), "sumofsquares": lambda x: sum(v * v for v in x), "anynan": lambda x: any(map(math.isnan, x)),
    "all": lambda x: all(v != 0 for v in x), "nanfirst": lambda x: [v for v in x if not math.isnan(v)][0], "var": np.var,
}


@pytest.mark.parametrize("axis", [0, 1, 2, 3, -1, -3])
def test_axes_of_deep_arrays(spark, axis):
    rng = np.random.default_rng(5)
    shape = (4, 3, 5, 4)
    values = np.round(rng.standard_normal(shape), 3)
    values[1, :, 2, 0] = N
    k = axis % 4
    labels = [0, 2, 2, 0, 2][: shape[k]]
    df = spark.createDataFrame([(r, [0, 2, 2, 0][r], values[r].tolist()) for r in range(4)], "row long, g long, m array<array<array<double>>>")
    funcs = list(IN_ROWS)
    got = axis_aggregate(df, "m", funcs, axis, row="row", labels="g" if k == 0 else labels, size=4, fill_value=0)
    keys = [c for c in ("row", "dim1", "dim2", "dim3") if c in got.columns] + ["g" if k == 0 else "label"]
    rows = {tuple(r[c] for c in keys): r for r in got.collect()}
    for f in funcs:
        def group(cells, f=f):
            x = [v for _, v in cells]
            if not x or f.startswith("nan") and all(map(math.isnan, x)):
                return None
            return IN_ROWS[f](x) if f != "max" else (N if any(map(math.isnan, x)) else max(x))

        for at, want in along(values, labels, k, group, 4).items():
            assert same([float(rows[at][f])], [0.0 if want is None else float(want)]) or np.isclose(float(rows[at][f]), float(want)), (f, at)
    assert len(rows) == math.prod(shape) // shape[k] * 4


@pytest.mark.parametrize("func", ["cumsum", "nancumsum", "cumprod", "cummax", "cummin", "nancummax", "nancummin", "sort", "rsort"])
def test_running_along_an_axis(spark, func):
    """Within rows as over rows."""
    values = [[3.0, N, 1.0, 2.0, -4.0, 2.5], [N, N, 7.0, 1.0, 9.0, 0.0], [1.0, 2.0, 0.5, N, 2.0]]
    labels = [1, 0, 1, 1, 0, 1]
    df = spark.createDataFrame(list(enumerate(values)), "row long, m array<double>")
    got = {(r["row"], r["d1"]): r["value"] for r in axis_aggregate(df, "m", func, 1, row="row", labels=labels, fill_value=-9).collect()}
    tall = spark.createDataFrame([(r, k, labels[k], x) for r, m in enumerate(values) for k, x in enumerate(m)], "row long, p long, g long, a double")
    want = {(r["row"], r["p"]): r["value"] for r in group_aggregate(tall, ["row", "g"], "a", func, pos="p", fill_value=-9).collect()}
    assert got.keys() == want.keys() and same([got[k] for k in got], [want[k] for k in got])


@pytest.mark.parametrize("func", ["cumsum", "nancumsum", "cumprod", "nancumprod", "cummax", "nancummax", "cummin", "nancummin"])
@pytest.mark.parametrize("start", ["value", "nan"])
def test_hot_labels_run_in_parts(spark, monkeypatch, func, start):
    """A label cut into many parts runs as it does whole; null labels and sparse positions too."""
    rng = np.random.default_rng(3)
    a = (rng.integers(-8, 8, 300) + 0.5) / 4  # sums are exact
    a[rng.integers(0, 300, 20)] = N
    a[:40] = N if start == "nan" else 1.5
    g = [0 if k % 4 else (None if k % 8 else k) for k in range(300)]
    df = spark.createDataFrame([(x, float(v), int(k) ** 2) for k, (x, v) in enumerate(zip(g, a, strict=True))], "g long, a double, p long")
    runs = lambda: [r["value"] for r in group_aggregate(df, "g", "a", func, pos="p", validate=False, fill_value=-9).orderBy("p").collect()]
    whole = runs()
    monkeypatch.setattr(aggregate, "PART_ROWS", 10)
    assert same(runs(), whole)
    whole_numbers = df.withColumn("a", F.floor(F.nanvl("a", F.lit(1.0)) * 10).cast("int"))
    parts = [r["value"] for r in group_aggregate(whole_numbers, "g", "a", func, pos="p", validate=False).orderBy("p").collect()]
    monkeypatch.undo()
    assert same(parts, [r["value"] for r in group_aggregate(whole_numbers, "g", "a", func, pos="p", validate=False).orderBy("p").collect()])


def test_within_rows_no_shuffle(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, None), (2, []), (3, [7])], "row long, m array<int>")
    for func in ("sum", "nanargmax", "cumsum", "sort"):
        assert not any("Exchange" in line for line in final_plan(axis_aggregate(df, "m", func, 1, row="row", labels=[0, 1, 1])))
    got = {(r["row"], r["label"]): r["value"] for r in axis_aggregate(df, "m", "argmin", 1, row="row", labels=[0, 1, 1], fill_value=-1).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (3, 0): 0, (3, 1): -1}
    few = axis_aggregate(df, "m", "array", 1, row="row", labels=[0, 1, 1], dense=False).collect()
    assert sorted((r["row"], r["label"], r["value"]) for r in few) == [(0, 0, [1]), (0, 1, [2, 3]), (3, 0, [7])]
    called = axis_aggregate(df, "m", lambda x: float(x.iloc[-1]), 1, row="row", labels=[0, 1, 1], fill_value=-1)
    assert sorted((r["row"], r["label"], r["value"]) for r in called.collect()) == [(0, 0, 1.0), (0, 1, 3.0), (3, 0, 7.0), (3, 1, -1.0)]
    with pytest.raises(Exception, match="more than the 2 labelled places"):
        axis_aggregate(df, "m", "sum", 1, row="row", labels=[0, 1]).collect()
    with pytest.raises(Exception, match="null values"):
        axis_aggregate(spark.createDataFrame([(0, [1, None])], "row long, m array<int>"), "m", "sum", 1, row="row", labels=[0, 1]).collect()
    ragged = spark.createDataFrame([(0, [[1.0, 2.0], [3.0]])], "row long, m array<array<double>>")
    with pytest.raises(Exception, match="differ in length"):
        axis_aggregate(ragged, "m", "sum", 1, row="row", labels=[0, 1]).collect()


def test_broadcast_and_unpack(spark):
    df = from_array(spark, [1, 1, 0], [2.0, N, 5.0])
    assert [r["value"] for r in broadcast_aggregate(df, "g", "a", "nansum").orderBy("p").collect()] == [2.0, 2.0, 5.0]
    assert [r["value"] for r in broadcast_aggregate(df, "g", "a", "nancumsum", pos="p").orderBy("p").collect()][-1] == 5.0
    assert len({tuple(r["value"]) for r in broadcast_aggregate(df, "g", "p", "array", pos="p").collect()}) == 2
    assert broadcast_aggregate(df, "g", "p", lambda x: float(len(x)), pos="p").count() == 3
    assert resolve(np.asarray) == "array"
    assert [r["value"] for r in unpack(df, group_aggregate(df, "g", "a", "nansum"), "g").orderBy("p").collect()] == [2.0, 2.0, 5.0]


def test_complex(spark):
    df = from_array(spark, [0, 0, 2], [1.0, 2.0, 3.0]).select("g", "p", F.struct(F.col("a").alias("re"), F.col("p").cast("double").alias("im")).alias("a"))
    rows = group_aggregate(df, "g", "a", "sum").orderBy("g").collect()
    assert [tuple(r["value"]) for r in rows] == [(3.0, 1.0), (0.0, 0.0), (3.0, 2.0)]


def test_names():
    assert len(NAMES) == 43
    for alias, name in {"or": "any", "plus": "sum", "times": "prod", "amax": "max", "splice": "array", "asort": "sort", "dsort": "rsort"}.items():
        assert resolve(alias) == name
    assert [resolve(f) for f in (sum, len, sorted, max, np.add, np.nanmax, np.cumsum, np.multiply, np.mean)] == ["sum", "len", "sort", "max", "sum", "nanmax", "cumsum", "prod", "mean"]
    for wrong in ("nancount", "nansort", "nanallnan", "generic", "nope"):
        with pytest.raises(ValueError):
            resolve(wrong)
    assert callable(resolve(lambda x: 1))


@pytest.mark.parametrize("g, kw, error", [([0, -1], {}, ValueError), ([0, 5], {"size": 5}, ValueError), ([0.5, 1.5], {}, TypeError), ([0, 1], {"func": "mean", "value": 1}, ValueError), ([0, 1], {"func": "len", "fill_value": N}, ValueError), ([0, 1], {"func": "all", "fill_value": 3}, ValueError), ([0, 1], {"func": "sum", "dtype": T.BooleanType()}, TypeError), ([0, 1], {"func": "len", "dtype": T.DoubleType()}, TypeError), ([0, 1], {"func": "first"}, ValueError), ([0, 1], {"func": "sum", "ddof": 1}, TypeError), ([], {}, ValueError)])
def test_errors(spark, g, kw, error):
    df = from_array(spark, np.array(g, dtype=None if g else np.int64), np.array([1.0] * len(g))) if g else spark.createDataFrame([], "g long, a double, p long")
    kw = {"value": "a", "func": "sum"} | kw
    with pytest.raises(error):
        group_aggregate(df, "g", kw.pop("value"), kw.pop("func"), eager=True, **kw)


@pytest.mark.parametrize("g, kw, said", [([0, -1], {}, "negative labels in g"), ([0, 5], {"size": 5}, "labels in g reach 5, beyond the size 5"), ([0, None], {}, "null labels in g"), ([], {}, "no rows: give the size"), ([0, 1], {"value": "i"}, "null values in i"), ([0, -1], {"func": "cumsum", "pos": "p"}, "negative labels in g"), ([0, None], {"func": lambda x: 1.0, "pos": "p"}, "null labels in g"), ([0, 1], {"value": "i", "func": "len"}, "null values in i")])
def test_errors_of_the_running_plan(spark, g, kw, said):
    df = spark.createDataFrame([(x, 1.0, k, None) for k, x in enumerate(g)], "g long, a double, p long, i int")
    kw = {"value": "a", "func": "sum"} | kw
    plan = group_aggregate(df, "g", kw.pop("value"), kw.pop("func"), **kw)
    with pytest.raises(Exception, match=said):
        plan.collect()


def test_labels_left_out_without_checks(spark):
    df = spark.createDataFrame([(x, 1.0) for x in (0, -1, None, 2, 2)], "g long, a double")
    for size in (None, 3):
        assert [r["value"] for r in group_aggregate(df, "g", "a", "sum", size=size, validate=False).orderBy("g").collect()] == [1.0, 0.0, 2.0]
    assert group_aggregate(df.where("false"), "g", "a", "sum", validate=False).count() == 0


def final_plan(df):
    """The lines of the plan that ran, without what was planned at first."""
    kept, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = next((k for k, c in enumerate(line) if c not in " :|+-"), len(line))
        if hidden is not None and at >= hidden:
            continue
        hidden = at if "Initial Plan" in line else None
        if hidden is None:
            kept.append(line)
    return kept


def test_one_scan_and_no_job_ahead(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7 * 2).alias("g"), (F.col("id") % 3).alias("d"), F.col("id").cast("double").alias("a"), F.col("id").alias("p")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    spark.sparkContext.setJobGroup("planning", "")
    plans = [group_aggregate(df, "g", "a", ["sum", "nanmax", "first"], pos="p"), group_aggregate(df, "g", "a", "sum", over="d"), group_aggregate(df, ["g", "d"], "a", "sum"), group_aggregate(df, "g", "a", "sum", size=20)]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext._jsc.clearJobGroup()
    for plan, rows in zip(plans, (13, 39, 39, 20), strict=True):
        assert len(plan.collect()) == rows
        assert sum("FileScan parquet" in line for line in final_plan(plan)) == 1


def test_large_label_space_with_further_keys(spark):
    df = spark.createDataFrame([(0, 3_000_000_000, 1.0)], "d long, g long, a double")
    out = group_aggregate(df, "g", "a", "sum", over="d")
    assert out.select("g", "value").head() is not None
    few = group_aggregate(df.withColumn("g", F.lit(200_000)), "g", "a", "sum", over="d")
    assert few.agg(F.count("*"), F.sum("value"), F.max("g")).first()[:] == (200_001, 1.0, 200_000)


def test_null_in_further_keys(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (5, 0, 3.0)], "d long, g long, a double")
    got = {(r["d"], r["g"]): r["value"] for r in group_aggregate(df, "g", "a", "sum", over="d").collect()}
    assert got == {(None, 0): 0.0, (None, 1): 2.0, (5, 0): 3.0, (5, 1): 0.0}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (0, None, 1), (1, 2.0, 2)], "g long, a double, p long")
    assert same([r["value"] for r in group_aggregate(df, "g", "a", "sum").orderBy("g").collect()], [N, 2.0])
    with pytest.raises(ValueError):
        group_aggregate(df.withColumn("a", F.col("a").cast("int")), "g", "a", "sum", eager=True)
    empty = df.where("false")
    assert [r["value"] for r in group_aggregate(empty, "g", "a", "sum", size=2, fill_value=4).collect()] == [4.0, 4.0]
    with pytest.raises(ValueError):
        from_array(spark, [1, 2, 3], [1, 2])


def test_stream(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("a"), F.timestamp_seconds(F.col("id") * 60).alias("t")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("g long, a double, t timestamp").parquet(f"{tmp_path}/in")
    out = windowed_aggregate(stream, "g", "a", ["sum", "nanmax", "len"], time="t", window="1 hour")
    query = out.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows")
    assert got.count() == 6 and got.agg(F.sum("sum"), F.sum("len")).first()[:] == (4950.0, 100)
    with pytest.raises(ValueError):
        windowed_aggregate(stream, "g", "a", ["first"], time="t", window="1 hour")
