"""The library's queries over the star-schema tables, and their SQL.

Labels are keys with every seventh (of vectors, every fourth) number skipped, so that there are holes and every row
takes part. Events give labels (of user_id), positions (event_id, unique) and values;
NaN is set in every fifth event and in all of every eleventh user. NaN results are shown as -999.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import BOOLEAN, COUNTS, NAN_FORMS, REDUCTIONS
from ..operators import aggregate, axis, index_ops
from ..sources.tables import load
from ..streaming.reductions import windowed_aggregate

#: Numbers between skipped ones.
GAP, VECTOR_GAP = 6, 3


def spaced(key: str, gap: int = GAP) -> Column:
    """A label for a key: the whole numbers with every (gap + 1)th skipped."""
    return F.expr(f"{key} + {key} div {gap}").cast("long")


def _spaced_sql(key: str, gap: int = GAP) -> str:
    return f"{key} + {key} // {gap}"


_LINES = f"(SELECT * REPLACE ({_spaced_sql('l_suppkey')} AS l_suppkey) FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_suppkey", *columns).withColumn("l_suppkey", spaced("l_suppkey"))


Query = Callable[[SparkSession, str], DataFrame]
SHOWN_NAN = -999.0


def shown(c: str | Column, digits: int = 4) -> Column:
    """A floating result for comparison: rounded, NaN as a number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(SHOWN_NAN)).otherwise(F.round(c, digits))


def _sql_shown(x: str, digits: int = 4) -> str:
    return f"CASE WHEN isnan({x}) THEN {SHOWN_NAN}::DOUBLE ELSE round({x}, {digits}) END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, g, a, an): position, label, value, and value with NaN."""
    e = load(spark, sf_dir, "events", "event_id", "user_id", "value")
    gap = (F.col("event_id") % 5 == 0) | (F.col("user_id") % 11 == 0)
    return e.select(F.col("event_id").alias("p"), spaced("user_id").alias("g"), F.col("value").alias("a"), F.when(gap, F.lit(float("nan"))).otherwise(F.col("value")).alias("an"))


_EVENTS = f"""e AS (SELECT event_id AS p, {_spaced_sql("user_id")} AS g, value AS a,
  CASE WHEN event_id % 5 = 0 OR user_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END AS an FROM events)"""


def _dense_sql(expr: str, fill: str, ctes: str = "", source: str = "e") -> str:
    return f"WITH {_EVENTS}{ctes}, r AS (SELECT g, {expr} AS v FROM {source} GROUP BY g), i AS (SELECT unnest(range(0, (SELECT max(g) + 1 FROM e))) AS g) SELECT i.g, coalesce(v, {fill}) AS value FROM i LEFT JOIN r ON i.g = r.g"


#: SQL of each reduction over a column {a}; {k} keeps rows that aren't NaN.
_REDUCE_SQL = {
    "sum": "sum({a})", "prod": "product({a})", "len": "nullif(count(*), 0)", "mean": "avg({a})", "var": "var_pop({a})", "std": "stddev_pop({a})",
    "min": "min({a})", "max": "max({a})", "first": "arg_min({a}, p)", "last": "arg_max({a}, p)",
    "argmax": "min(p) FILTER (WHERE {a} = top)", "argmin": "min(p) FILTER (WHERE {a} = low)", "sumofsquares": "sum({a} * {a})",
    "all": "bool_and({a} <> 0)", "any": "bool_or({a} <> 0)", "allnan": "bool_and(isnan({a}))", "anynan": "bool_or(isnan({a}))",
}


def _reduction(func: str) -> tuple[Query, str]:
    nan_form = func.startswith("nan")
    name = func[3:] if nan_form else func
    column = "an" if nan_form or func in ("allnan", "anynan") else "a"
    fill = {True: False, False: -1}[func in BOOLEAN]
    exact = func in BOOLEAN | COUNTS

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir)
        if name == "prod":
            e = e.withColumn(column, F.when(F.isnan(column), F.col(column)).otherwise(1 + F.pmod("p", F.lit(2)).cast("double")))
        if name in ("all", "any"):
            e = e.withColumn(column, F.when(F.isnan(column), F.col(column)).otherwise(F.pmod("p", F.lit(3)).cast("double")))
        out = aggregate.group_aggregate(e, "g", column, func, pos="p", fill_value=fill)
        return out if exact else out.withColumn("value", shown("value"))

    a = {"prod": "(1 + p % 2)::DOUBLE", "all": "(p % 3)::DOUBLE", "any": "(p % 3)::DOUBLE"}.get(name, column)
    expr = _REDUCE_SQL[name].format(a=a)
    source = "e"
    ctes = ""
    if nan_form:
        ctes, source = ", k AS (SELECT * FROM e WHERE NOT isnan(an))", "k"
    if name in ("argmax", "argmin"):
        ctes += f", t AS (SELECT *, max({column}) OVER (PARTITION BY g) AS top, min({column}) OVER (PARTITION BY g) AS low FROM {source})"
        source = "t"
    sql = _dense_sql(expr if exact else _sql_shown(expr), {False: "-1", True: "false"}[func in BOOLEAN], ctes, source)
    return query, sql


def _with_nan(func: str) -> tuple[Query, str]:
    """What a plain reduction makes of NaN."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = aggregate.group_aggregate(events(spark, sf_dir), "g", "an", func, pos="p", fill_value=-1)
        return out if func in COUNTS else out.withColumn("value", shown("value"))

    clean = {"argmax": "min(p) FILTER (WHERE an = top)", "argmin": "min(p) FILTER (WHERE an = low)"}.get(func, _REDUCE_SQL[func].format(a="an"))
    if func in ("argmax", "argmin"):
        ctes = ", t AS (SELECT *, max(an) OVER (PARTITION BY g) AS top, min(an) OVER (PARTITION BY g) AS low FROM e)"
        return query, _dense_sql(f"CASE WHEN NOT bool_or(isnan(an)) THEN {clean} END", "-1", ctes, "t")
    return query, _dense_sql(f"CASE WHEN bool_or(isnan(an)) THEN {SHOWN_NAN}::DOUBLE ELSE round({clean}, 4) END", "-1")


def _spread(func: str, ddof: int) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = lines(spark, sf_dir, "l_quantity")
        return aggregate.group_aggregate(e, "l_suppkey", "l_quantity", func, ddof=ddof, fill_value=-1).withColumn("value", shown("value"))

    spread = f"var_pop(l_quantity) * count(*) / (count(*) - {ddof})"
    spread = f"CASE WHEN count(*) > {ddof} THEN {spread if func == 'var' else f'sqrt({spread})'} END"
    sql = f"""WITH r AS (SELECT l_suppkey, round({spread}, 4) AS v FROM {_LINES} GROUP BY l_suppkey),
      i AS (SELECT unnest(range(0, (SELECT max(l_suppkey) + 1 FROM r))) AS l_suppkey) SELECT i.l_suppkey, coalesce(v, -1) AS value FROM i LEFT JOIN r ON i.l_suppkey = r.l_suppkey"""
    return query, sql


_WINDOW = "OVER (PARTITION BY g ORDER BY p ROWS UNBOUNDED PRECEDING)"
_RUN_SQL = {"cumsum": "coalesce(sum({a}) {f} {w}, 0)", "cumprod": "coalesce(product(1 + {a} / 1000) {f} {w}, 1)", "cummax": "coalesce(max({a}) {f} {w}, -1)", "cummin": "coalesce(min({a}) {f} {w}, -1)"}


def _running(func: str) -> tuple[Query, str]:
    nan_form = func.startswith("nan")
    name, column = func.removeprefix("nan"), "an" if nan_form else "a"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir).select("p", "g", F.col(column).alias("x"))
        if name == "cumprod":
            e = e.withColumn("x", 1 + F.col("x") / 1000)
        return aggregate.group_aggregate(e, "g", "x", func, pos="p", fill_value=-1).select("p", "g", shown("value", 3).alias("value"))

    return query, f"WITH {_EVENTS} SELECT p, g, round({_RUN_SQL[name].format(a=column, f='FILTER (WHERE NOT isnan(an))' if nan_form else '', w=_WINDOW)}, 3) AS value FROM e"


def _sort(reverse: bool) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = aggregate.group_aggregate(events(spark, sf_dir), "g", "an", "sort", pos="p", reverse=reverse)
        return out.select("p", "g", shown("value").alias("value"))

    return query, f"""WITH {_EVENTS}, s AS (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY p) AS k FROM e),
      v AS (SELECT g, an, row_number() OVER (PARTITION BY g ORDER BY isnan(an), an {'DESC' if reverse else 'ASC'}, p) AS k FROM e)
      SELECT p, s.g, {_sql_shown('an')} AS value FROM s JOIN v ON s.g = v.g AND s.k = v.k"""


def array_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.group_aggregate(events(spark, sf_dir), "g", "p", "array", pos="p", fill_value=None)
    return out.select("g", F.concat_ws(",", F.transform("value", lambda x: x.cast("string"))).alias("value"))


def sum_of_squares(x: pd.Series) -> float:
    return float((x * x).sum())


def weighted_by_place(x: pd.Series) -> float:
    return float(sum(v * (k + 1) for k, v in enumerate(x)))


def callable_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("a", F.floor("a").cast("double"))
    out = aggregate.group_aggregate(e, "g", "a", [sum_of_squares, weighted_by_place, "len"], pos="p", fill_value=0)
    return out.select("g", F.round("sum_of_squares", 3).alias("squares"), F.round("weighted_by_place", 3).alias("weighted"), F.col("len").alias("n"))


def scalar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.group_aggregate(events(spark, sf_dir), "g", 3, "sum", fill_value=-1)


def scalar_two_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lines(spark, sf_dir, "l_linenumber")
    return aggregate.group_aggregate(e, ["l_suppkey", "l_linenumber"], 1, "sum").withColumns({c: F.col(c).cast("long") for c in ("l_suppkey", "l_linenumber")})


def _two_labels(order: str) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = lines(spark, sf_dir, "l_linenumber", "l_quantity")
        out = aggregate.group_aggregate(e, ["l_suppkey", "l_linenumber"], "l_quantity", "sum", order=order, fill_value=-1)
        return out.select("index", "l_suppkey", "l_linenumber", F.round("value", 2).alias("value"))

    index = "i.l_suppkey * n1 + i.l_linenumber" if order == "C" else "i.l_suppkey + i.l_linenumber * n0"
    return query, f"""WITH e AS {_LINES}, n AS (SELECT max(l_suppkey) + 1 AS n0, max(l_linenumber)::BIGINT + 1 AS n1 FROM e),
      r AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS v FROM e GROUP BY ALL),
      i AS (SELECT a AS l_suppkey, b::BIGINT AS l_linenumber, n0, n1 FROM n, unnest(range(0, n0)) AS x(a), unnest(range(0, n1)) AS y(b))
      SELECT CAST({index} AS BIGINT) AS "index", i.l_suppkey, i.l_linenumber, coalesce(round(v, 2), -1) AS value FROM i LEFT JOIN r ON i.l_suppkey = r.l_suppkey AND i.l_linenumber = r.l_linenumber"""


def _axis0(func: str) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = load(spark, sf_dir, "embeddings").withColumn("label", spaced("label", VECTOR_GAP))
        e = e.withColumn("embedding", F.transform("embedding", lambda x: F.when(x < -0.15, F.lit(float("nan")).cast("float")).otherwise(x).cast("double")))
        out = axis.axis_aggregate(e, "embedding", func, 0, row="vec_id", labels="label", fill_value=-1)
        return out.select("dim", F.col("label").cast("long").alias("label"), F.col("value") if func.endswith("argmax") else shown("value").alias("value"))

    expr = {"nansum": "sum(x)", "nanmax": "max(x)", "nanargmax": "arg_max(vec_id, x)"}[func]
    if func == "nanargmax":
        expr = "min(vec_id) FILTER (WHERE x = top)"
    value = expr if func == "nanargmax" else f"round({expr}, 4)"
    return query, f"""WITH c AS (SELECT vec_id, {_spaced_sql("label", VECTOR_GAP)} AS label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings),
      k AS (SELECT *, max(x) OVER (PARTITION BY dim, label) AS top FROM c WHERE x >= -0.15::FLOAT),
      r AS (SELECT dim, label, {value} AS v FROM k GROUP BY dim, label),
      i AS (SELECT d.dim, g AS label FROM (SELECT DISTINCT dim FROM c) d, unnest(range(0, (SELECT max(label)::BIGINT + 1 FROM c))) AS t(g))
      SELECT i.dim, i.label, coalesce(v, -1) AS value FROM i LEFT JOIN r ON i.dim = r.dim AND i.label = r.label"""


_PLACES = [k % 5 if k % 5 != 2 else 0 for k in range(64)]


def axis1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return axis.axis_aggregate(e, "embedding", "argmax", 1, row="vec_id", labels=_PLACES, fill_value=-1)


#: Labels of eight places, with a hole at 2.
_EIGHT = [0, 1, 1, 3, 0, 1, 3, 0]


def _deep(func: str, axis_no: int) -> tuple[Query, str]:
    """Vectors as arrays of eight by eight, so three dimensions with the rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
        eight = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
        e = load(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("embedding", thousandths).withColumn("embedding", eight)
        return axis.axis_aggregate(e, "embedding", func, axis_no, row="vec_id", labels=_EIGHT, fill_value=-1)

    along, other, name = ("j", "i", "dim1") if axis_no % 3 == 2 else ("i", "j", "dim2")
    value = {"sum": "CAST(sum(x) AS BIGINT)", "nanargmax": f"min({along}) FILTER (WHERE x = top)"}[func]
    return query, f"""WITH c AS (SELECT vec_id, CAST(round(unnest(embedding)::DOUBLE * 1000) AS BIGINT) AS x, unnest(range(0, 64)) AS k FROM embeddings),
      d AS (SELECT *, k // 8 AS i, k % 8 AS j FROM c), l AS (SELECT *, {_EIGHT}[{along} + 1]::BIGINT AS label FROM d),
      t AS (SELECT *, max(x) OVER (PARTITION BY vec_id, {other}, label) AS top FROM l),
      r AS (SELECT vec_id, {other}, label, {value} AS v FROM t GROUP BY ALL),
      g AS (SELECT DISTINCT vec_id, o::BIGINT AS {other}, n::BIGINT AS label FROM embeddings, unnest(range(0, 8)) AS a(o), unnest(range(0, 4)) AS b(n))
      SELECT g.vec_id, g.{other} AS {name}, g.label, coalesce(v, -1) AS value FROM g LEFT JOIN r ON g.vec_id = r.vec_id AND g.{other} = r.{other} AND g.label = r.label"""


def axis_cumsum_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("embedding", thousandths)
    out = axis.axis_aggregate(e, "embedding", "cumsum", 1, row="vec_id", labels=_PLACES)
    return out.select("vec_id", F.col("d1").alias("place"), "value")


_AXIS1 = "c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS k FROM embeddings), l AS (SELECT *, CASE WHEN k % 5 = 2 THEN 0 ELSE k % 5 END AS label FROM c)"


def uaggregate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("p", "g", "an")
    return aggregate.broadcast_aggregate(e, "g", "an", "nanmean", fill_value=-1).select("p", "g", shown("value").alias("value"))


def uaggregate_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("p", "g", F.floor("a").cast("double").alias("a"))
    return aggregate.broadcast_aggregate(e, "g", "a", weighted_by_place, pos="p").select("p", "g", F.round("value", 3).alias("value"))


def uaggregate_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("p", "g", "a")
    return aggregate.broadcast_aggregate(e, "g", "a", "cumsum", pos="p").select("p", "g", shown("value", 3).alias("value"))


def unpack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("p", "g", "a")
    totals = aggregate.group_aggregate(e, "g", "a", "max", fill_value=-1)
    return aggregate.unpack(e.select("p", "g"), totals, "g").select("p", "g", F.round("value", 4).alias("value"))


def multi_arange_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id").select(F.col("event_id").alias("p"), (F.pmod("event_id", F.lit(4)) - 1).alias("n"))
    return index_ops.multi_arange(e, "p", "n")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "event_id", "user_id").select(F.col("event_id").alias("p"), F.pmod(F.floor(F.col("user_id") / 20), F.lit(4)).cast("long").alias("x"))


def label_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_ops.label_runs(_runs(spark, sf_dir), "p", "x", block=1000)


def run_starts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_ops.run_starts(_runs(spark, sf_dir), "p", "x", block=1000)


def run_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_ops.run_count(_runs(spark, sf_dir), "p", "x")


def relabel_unique_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_ops.relabel_unique(events(spark, sf_dir).select("p", (F.col("g") * 3 + 1).alias("g")), "g")


def relabel_masked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("p", "g")
    return index_ops.relabel_masked(e, "g", e.select("g", (F.col("g") % 3 == 1).alias("keep")).distinct(), "keep")


def many_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reductions of one value, from one scan and one shuffle."""
    funcs = [f for f in [*REDUCTIONS, *NAN_FORMS] if "prod" not in f and "cum" not in f and not f.endswith(("all", "any")) and f not in BOOLEAN]
    out = aggregate.group_aggregate(events(spark, sf_dir), "g", "a", funcs, pos="p", fill_value=-1)
    return out.select("g", *(F.col(f) if f in COUNTS else shown(f).alias(f) for f in funcs))


def _many_sql() -> str:
    funcs = [f for f in [*REDUCTIONS, *NAN_FORMS] if "prod" not in f and "cum" not in f and not f.endswith(("all", "any")) and f not in BOOLEAN]
    columns = [(f, _REDUCE_SQL[f.removeprefix("nan")].format(a="a")) for f in funcs]
    made = ", ".join(f"{x if f in COUNTS else f'round({x}, 4)'} AS {f}" for f, x in columns).replace(" AS first", ' AS "first"').replace(" AS last", ' AS "last"')
    return f"""WITH {_EVENTS}, t AS (SELECT *, max(a) OVER (PARTITION BY g) AS top, min(a) OVER (PARTITION BY g) AS low FROM e), r AS (SELECT g, {made} FROM t GROUP BY g),
      i AS (SELECT unnest(range(0, (SELECT max(g) + 1 FROM e))) AS g) SELECT i.g, {", ".join(f'coalesce(r."{f}", -1) AS "{f}"' for f in funcs)} FROM i LEFT JOIN r ON i.g = r.g"""


def complex_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("g", "p", F.struct(F.col("a").alias("re"), (F.col("p") % 10).cast("double").alias("im")).alias("z"))
    out = aggregate.group_aggregate(e, "g", "z", ["sum", "mean"], fill_value=0)
    return out.select("g", *(F.round(f"{f}.{part}", 4).alias(f"{f}_{part}") for f in ("sum", "mean") for part in ("re", "im")))


def windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "ts", "user_id", "value")
    out = windowed_aggregate(e, "user_id", "value", ["sum", "len", "max"], time="ts", window="1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "user_id", F.round("sum", 3).alias("total"), F.col("len").alias("n"), F.round("max", 4).alias("top"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense reductions per supplier, holes filled: one scan, whose one shuffle is read for the labels' extent and for the result."""
    e = lines(spark, sf_dir, "l_extendedprice")
    out = aggregate.group_aggregate(e, "l_suppkey", "l_extendedprice", ["sum", "mean", "nanvar", "min", "max", "len"], fill_value=0)
    return out.select("l_suppkey", *(F.round(c, 2).alias(f"price_{c}") for c in ("sum", "mean", "nanvar", "min", "max")), F.col("len").alias("n"))


_FLAGSHIP_SQL = f"""WITH r AS (SELECT l_suppkey, sum(l_extendedprice) AS s, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n
  FROM {_LINES} GROUP BY l_suppkey), i AS (SELECT unnest(range(0, (SELECT max(l_suppkey) + 1 FROM r))) AS l_suppkey)
  SELECT i.l_suppkey, round(coalesce(s, 0), 2) AS price_sum, round(coalesce(m, 0), 2) AS price_mean, round(coalesce(v, 0), 2) AS price_nanvar, round(coalesce(lo, 0), 2) AS price_min, round(coalesce(hi, 0), 2) AS price_max, coalesce(n, 0) AS n
  FROM i LEFT JOIN r ON i.l_suppkey = r.l_suppkey"""

_RUNS_SQL = "e AS (SELECT event_id AS p, (user_id // 20) % 4 AS x FROM events), b AS (SELECT *, lag(x) OVER (ORDER BY p) AS y FROM e)"


def _all() -> dict[str, tuple[Query, str]]:
    out = {f: _reduction(f) for f in REDUCTIONS} | {f: _reduction(f) for f in NAN_FORMS if "cum" not in f}
    out |= {f"{f}_of_nan": _with_nan(f) for f in ("sum", "mean", "var", "std", "min", "max", "argmin", "argmax", "sumofsquares")}
    out |= {f"{f}_ddof{d}": _spread(f, d) for f in ("var", "std") for d in (0, 1, 2)}
    out |= {f: _running(f) for n in ("cumsum", "cumprod", "cummax", "cummin") for f in (n, f"nan{n}")}
    out |= {"sort": _sort(False), "rsort": _sort(True)}
    out["array"] = (array_query, f"WITH {_EVENTS}, r AS (SELECT g, string_agg(p::VARCHAR, ',' ORDER BY p) AS v FROM e GROUP BY g), i AS (SELECT unnest(range(0, (SELECT max(g) + 1 FROM e))) AS g) SELECT i.g, coalesce(v, '') AS value FROM i LEFT JOIN r ON i.g = r.g")
    out["callable"] = (callable_query, f"WITH {_EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS k FROM e), r AS (SELECT g, sum(floor(a) * floor(a)) AS s, sum(floor(a) * k) AS w, count(*) AS n FROM k GROUP BY g), i AS (SELECT unnest(range(0, (SELECT max(g) + 1 FROM e))) AS g) SELECT i.g, coalesce(round(s, 3), 0) AS squares, coalesce(round(w, 3), 0) AS weighted, coalesce(n, 0) AS n FROM i LEFT JOIN r ON i.g = r.g")
    out["scalar_sum"] = (scalar_query, _dense_sql("count(*) * 3", "-1"))
    out["scalar_two_labels"] = (scalar_two_labels, _two_labels("C")[1].replace("sum(l_quantity)", "count(*)").replace("coalesce(round(v, 2), -1)", "coalesce(v, 0)"))
    out |= {"two_labels_c": _two_labels("C"), "two_labels_f": _two_labels("F")}
    out |= {f"axis0_{f}": _axis0(f) for f in ("nansum", "nanmax", "nanargmax")}
    out |= {"axis2_nanargmax": _deep("nanargmax", 2), "axis_minus1_sum": _deep("sum", -1), "axis1_of_three_sum": _deep("sum", 1)}
    out["axis1_argmax"] = (axis1_query, f"WITH {_AXIS1}, t AS (SELECT *, max(x) OVER (PARTITION BY vec_id, label) AS top FROM l), r AS (SELECT vec_id, label, min(k) FILTER (WHERE x = top) AS v FROM t GROUP BY ALL), i AS (SELECT vec_id, g AS label FROM embeddings, unnest(range(0, 5)) AS u(g)) SELECT i.vec_id, i.label, coalesce(v, -1) AS value FROM i LEFT JOIN r ON i.vec_id = r.vec_id AND i.label = r.label")
    out["axis1_cumsum"] = (axis_cumsum_query, f"WITH {_AXIS1} SELECT vec_id, k AS place, CAST(sum(CAST(round(x * 1000) AS BIGINT)) OVER (PARTITION BY vec_id, label ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM l")
    out["uaggregate"] = (uaggregate_query, f"WITH {_EVENTS} SELECT p, g, coalesce(round(avg(an) FILTER (WHERE NOT isnan(an)) OVER (PARTITION BY g), 4), -1) AS value FROM e")
    out["uaggregate_callable"] = (uaggregate_callable, f"WITH {_EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS k FROM e) SELECT p, g, round(sum(floor(a) * k) OVER (PARTITION BY g), 3) AS value FROM k")
    out["uaggregate_cumsum"] = (uaggregate_cumsum, f"WITH {_EVENTS} SELECT p, g, round(sum(a) {_WINDOW}, 3) AS value FROM e")
    out["unpack"] = (unpack_query, f"WITH {_EVENTS} SELECT p, g, round(max(a) OVER (PARTITION BY g), 4) AS value FROM e")
    out["multi_arange"] = (multi_arange_query, "SELECT p, unnest(range(0, n)) AS value FROM (SELECT event_id AS p, event_id % 4 - 1 AS n FROM events) WHERE n > 0")
    out["label_runs"] = (label_runs_query, f"WITH {_RUNS_SQL} SELECT p, x, CASE WHEN x = 0 THEN 0 ELSE CAST(sum(CASE WHEN x <> 0 AND (y IS NULL OR x <> y) THEN 1 ELSE 0 END) OVER (ORDER BY p) AS BIGINT) END AS label FROM b")
    out["run_starts"] = (run_starts_query, f"WITH {_RUNS_SQL} SELECT p AS start FROM b WHERE y IS NULL OR x <> y UNION ALL SELECT max(p) + 1 FROM e")
    out["run_count"] = (run_count_query, f"WITH {_RUNS_SQL} SELECT count(*) AS runs FROM b WHERE y IS NULL OR x <> y")
    out["relabel_unique"] = (relabel_unique_query, f"WITH {_EVENTS}, x AS (SELECT p, g * 3 + 1 AS g FROM e), k AS (SELECT g, dense_rank() OVER (ORDER BY g) - 1 AS r FROM (SELECT g FROM x UNION SELECT 0)) SELECT p, x.g, k.r AS relabelled FROM x JOIN k ON x.g = k.g")
    out["relabel_masked"] = (relabel_masked_query, f"WITH {_EVENTS}, k AS (SELECT g, row_number() OVER (ORDER BY g) AS r FROM (SELECT DISTINCT g FROM e WHERE g % 3 = 1 AND g <> 0)) SELECT p, e.g, coalesce(k.r, 0) AS relabelled FROM e LEFT JOIN k ON e.g = k.g")
    out["many_functions"] = (many_functions, _many_sql())
    out["complex_sum_mean"] = (complex_query, f"WITH {_EVENTS}, r AS (SELECT g, sum(a) AS s, sum(p % 10) AS t, count(*) AS n FROM e GROUP BY g), i AS (SELECT unnest(range(0, (SELECT max(g) + 1 FROM e))) AS g) SELECT i.g, coalesce(round(s, 4), 0) AS sum_re, coalesce(t::DOUBLE, 0) AS sum_im, coalesce(round(s / n, 4), 0) AS mean_re, coalesce(round(t / n, 4), 0) AS mean_im FROM i LEFT JOIN r ON i.g = r.g")
    out["stream_windows"] = (windows_query, "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, round(sum(value), 3) AS total, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2")
    out["flagship"] = (flagship, _FLAGSHIP_SQL)
    return out


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}


