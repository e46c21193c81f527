import inspect
import os
import re

import pytest

import __spark_entry__ as entry
from panelwright.operators import clean, composite
from panelwright.sources.tables import MarketTables

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")
def test_tree_scores_grow_as_many_trees_as_the_operator(spark, monkeypatch):
    made, fit = [], composite.fit_trees
    monkeypatch.setattr(composite, "fit_trees", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    entry.queries()["c6_tree_scores"](spark, FOLDER)
    assert [m.getNumTrees for m in made] == [inspect.signature(fit).parameters["rounds"].default] == [50]


@pytest.mark.parametrize("method", [composite.ic_weighted, composite.icir_weighted])
def test_scores_behind_a_weighted_composite_are_worked_out_once(spark, method):
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rows = [(t, g, float(k)) for k, t in enumerate("abcd") for g in ("value", "momentum")]
    groups = spark.createDataFrame(rows, "ticker string, grp string, score double").mapInPandas(count, "ticker string, grp string, score double")
    ic = spark.createDataFrame([(d, g, v + 0.01 * d) for d in range(3) for g, v in (("value", 0.1), ("momentum", 0.05))], "date int, grp string, ic double")
    got = {r.ticker: r.composite for r in method(groups, ic).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}) and read.value == len(rows)


def test_weekly_panel_aggregates_lines_with_their_brand_only(spark, tmp_path):
    import datetime as dt

    days = [dt.datetime(2001, 1, d) for d in (1, 2, 9)]
    lines = [(1, days[0], 10.0, 2.0), (2, days[1], 30.0, 2.0), (1, days[2], 5.0, 1.0), (3, days[0], 8.0, 4.0), (None, days[0], 9.0, 1.0), (9, days[0], 9.0, 1.0)]
    spark.createDataFrame(lines, "l_partkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (None, "C")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    weekly = MarketTables(spark, str(tmp_path)).weekly
    got = {(r.ticker, str(r.date)): (r.close, r.volume) for r in weekly.collect()}
    assert got == {("A", "2001-01-01"): (10.0, 4.0), ("A", "2001-01-08"): (5.0, 1.0), ("B", "2001-01-01"): (2.0, 4.0)}
    assert weekly._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_imputed_cells_stay_with_their_ticker(spark):
    rows = [(1, "A", 0.1), (1, "B", 0.3), (1, "C", 0.8), (2, "A", None), (2, "B", 0.5), (2, "B", 0.7), (3, "C", None), (3, None, 9.0), (None, "A", 9.0), (None, "D", None)]
    returns = spark.createDataFrame(rows, "date int, ticker string, r double")
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "ticker string, sector string")
    only = spark.createDataFrame([("A",), ("C",), ("E",)], "ticker string")
    key = lambda x: (str(x[1]), x[0], str(x[2]))
    wanted = [(1, "A", 0.1), (2, "A", 0.6), (3, "A", None), (1, "B", 0.3), (2, "B", 0.5), (2, "B", 0.7), (3, "B", None), (1, "C", 0.8), (2, "C", 0.6), (3, "C", None)]
    wanted += [(1, t, 0.4) for t in ("D", None)] + [(2, t, 0.6) for t in ("D", None)] + [(3, t, None) for t in ("D", None)]
    got = clean.impute_by_sector(returns, sectors)
    near = lambda rows: sorted(((d, t, r and round(r, 12)) for d, t, r in rows), key=key)
    assert near(got.collect()) == near(wanted)
    assert not re.search(r"hashpartitioning\(date#\d+, ticker#", got._jdf.queryExecution().executedPlan().toString())
    assert near(clean.impute_by_sector(returns, sectors, only).collect()) == near([x for x in wanted if x[1] in ("A", "C")])
