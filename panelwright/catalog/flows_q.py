"""End-to-end flows."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from panelwright.catalog.base import PARTS, part, query, rd, sql
from panelwright.catalog.clean_q import sectors
from panelwright.catalog.factors_q import YEAR, with_growth
from panelwright.catalog.risk_q import N_CANDIDATES, clusters
from panelwright.catalog.sources_q import day
from panelwright.catalog.universe_q import SCREENS, members
from panelwright.config import CORE_FACTORS, CleaningConfig, DriftRule, SelectionConfig
from panelwright.functions.columns import rounded
from panelwright.operators import portfolios as W
from panelwright.plans import flows as J
from panelwright.session import fresh_path

RUN = J.RunConfig(cleaning=CleaningConfig(top_k=15), train=48, test=12, rule=DriftRule(0.03))


def pre_parts(tag, first, last, test_last, base="ret"):
    """Pre-selection fitted on index first..last and inverse-volatility weights, as SQL parts."""
    part(f"{tag}_s", f"SELECT ticker, avg(r) AS m, stddev_samp(r) AS s FROM {base} WHERE idx BETWEEN {first} AND {last} AND abs(r) <= 10 GROUP BY 1", base)
    part(f"{tag}_o", f"""SELECT date, ticker, idx, CASE WHEN r IS NULL OR abs(r) > 10 OR abs(r - m) / s >= 10 THEN NULL WHEN abs(r - m) / s >= 3 THEN least(greatest(r, m - 3 * s), m + 3 * s) ELSE r END AS r
      FROM {base} LEFT JOIN {tag}_s USING (ticker) WHERE idx BETWEEN {first} AND {test_last}""", f"{tag}_s", base)
    part(f"{tag}_c", f"""SELECT c.date, c.idx, c.ticker, coalesce(sector, '') AS sector, o.r FROM (SELECT date, idx, ticker FROM (SELECT DISTINCT date, idx FROM {tag}_o), (SELECT DISTINCT ticker FROM {tag}_o WHERE idx <= {last})) c
      LEFT JOIN {tag}_o o ON o.date = c.date AND o.ticker = c.ticker LEFT JOIN sec ON sec.ticker = c.ticker""", f"{tag}_o", "sec")
    part(f"{tag}_i", f"SELECT date, idx, ticker, coalesce(r, avg(r) OVER (PARTITION BY date, sector), avg(r) OVER (PARTITION BY date)) AS r FROM {tag}_c", f"{tag}_c")
    part(f"{tag}_p", f"SELECT ticker, stddev_samp(r) AS s FROM {tag}_i WHERE idx <= {last} GROUP BY 1 HAVING count(r) = {last} - {first} + 1 AND var_samp(r) > 1e-8 ORDER BY avg(r) DESC, ticker LIMIT 15", f"{tag}_i")
    part(f"{tag}_w", f"SELECT ticker AS asset, 1 / s / sum(1 / s) OVER () AS w FROM {tag}_p", f"{tag}_p")


pre_parts("ja", 2, "(SELECT max(n_dates) FROM ax)", "(SELECT max(n_dates) FROM ax)")
pre_parts("jb", 2, 49, 61)
pre_parts("jc", 14, 61, 73)
part("jbt", "SELECT 0 AS fold, date, sum(w * r) AS r FROM jb_i JOIN jb_w ON asset = ticker WHERE idx > 49 GROUP BY date UNION ALL SELECT 1, date, sum(w * r) FROM jc_i JOIN jc_w ON asset = ticker WHERE idx > 61 GROUP BY date", "jb_i", "jb_w", "jc_i", "jc_w")
part("jsr", "SELECT date, sum(w * r) AS r FROM ja_i JOIN ja_w ON asset = ticker GROUP BY date", "ja_i", "ja_w")


def previous(t):
    """Equal weights of the suppliers with a number divisible by five."""
    names = t.listing.where("instrument_id % 5 = 0").select(F.col("ticker").alias("ticker"))
    return W.equal_weight(names).select(F.lit(1).cast("long").alias("portfolio"), "asset", "w")


def run(t, backtest=False):
    return J.full_run(t.panel, sectors(t), config=replace(RUN, backtest=backtest), previous=previous(t))


@query("j1_weights", sql(f"SELECT asset, {rd('w')} AS w FROM ja_w", "ja_w"))
def j1(t):
    return rounded(run(t)["weights"])


@query("j1_backtest", sql(f"SELECT fold, CAST(date AS VARCHAR) AS date, {rd('r')} AS r FROM jbt", "jbt"))
def j1_backtest(t):
    return rounded(run(t, True)["backtest"].select("fold", day(), "r"))


@query("j1_summary", sql(f"""SELECT 1 AS portfolio, {rd('avg(r)')} AS mean, {rd('avg(r) * 252')} AS annualized_mean, {rd('var_samp(r)')} AS variance, {rd('stddev_samp(r)')} AS standard_deviation,
  {rd('avg(r) / stddev_samp(r)')} AS sharpe_ratio, {rd('avg(r) / sqrt(avg(least(r - m, 0) * least(r - m, 0)))')} AS sortino_ratio, {rd('max(1 - w / hw)')} AS max_drawdown, {rd('avg(-r) FILTER (rn <= greatest(1, floor(round(0.05 * n, 9))))')} AS cvar
  FROM (SELECT *, max(w) OVER (ORDER BY date) AS hw FROM (SELECT *, avg(r) OVER () AS m, count(*) OVER () AS n, row_number() OVER (ORDER BY r, date) AS rn, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS w FROM jsr))""", "jsr"))
def j1_summary(t):
    return rounded(run(t)["summary"])


@query("j1_decision", sql(f"""SELECT 1 AS portfolio, {rd('sum(abs(w - p)) / 2')} AS turnover, bool_or(abs(w - p) > 0.03) AS rebalance FROM (SELECT w, CASE WHEN sum(q) OVER () > 0 THEN q / sum(q) OVER () ELSE q END AS p FROM
  (SELECT asset, w, CASE WHEN CAST(substr(asset, 2) AS BIGINT) % 5 = 0 THEN 1.0 / (SELECT count(*) FROM listing WHERE instrument_id % 5 = 0) ELSE 0 END AS q FROM ja_w))""", "ja_w", "listing"))
def j1_decision(t):
    return rounded(run(t)["decision"])


# Selection run: the parts of the single steps once more, over the surviving names.

CHAIN = ["px", "ax", "pxi", "mom", "fr0", "lf", "grid", "mkt", "pf", "fundg", "allf", "alll", "alls", "gs"]


def again(names, swap):
    """Copies of parts under new names, reading each other's copies and the swapped tables."""
    new = {**{n: f"{n}_k" for n in names}, **swap}
    for n in names:
        if n in swap:
            continue
        needs, text = PARTS[n]
        body = re.sub(r"\b(" + "|".join(map(re.escape, new)) + r")\b(?!\s*\.?\s*\()", lambda m: new[m.group(1)], text)
        part(f"{n}_k", body, *[new.get(x, x) for x in needs])


part("px_k", "SELECT * FROM px WHERE ticker IN (SELECT ticker FROM investable)", "px", "investable")
part("fund_k", "SELECT * FROM fund WHERE ticker IN (SELECT ticker FROM investable)", "fund", "investable")
again(CHAIN, {"px": "px_k", "fund": "fund_k"})
part("core_k", "SELECT * FROM alls_k WHERE factor IN ('" + "', '".join(CORE_FACTORS) + "')", "alls_k")
PARTS["gs_k"] = (("core_k",), PARTS["gs_k"][1].replace("alls_k", "core_k"))
part("lastreg", "SELECT grp, w FROM tw WHERE country = 'EUROPE' AND date = (SELECT max(date) FROM macro WHERE country = 'EUROPE' AND date <= (SELECT max(date) FROM px) - 63)", "tw", "macro", "px")
part("comp_k", "SELECT ticker, sum(w * coalesce(score, 0)) / sum(w) AS score FROM gs_k JOIN lastreg USING (grp) GROUP BY 1", "gs_k", "lastreg")
part("pick_k", "SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY score DESC, ticker) AS rn, ticker IN (SELECT ticker FROM mem) AS m FROM comp_k) WHERE rn <= 20 OR (m AND rn <= 22)", "comp_k", "mem")
part("ret_k", "SELECT * FROM ret WHERE ticker IN (SELECT ticker FROM pick_k)", "ret", "pick_k")
pre_parts("jk", 2, "(SELECT max(n_dates) FROM ax)", "(SELECT max(n_dates) FROM ax)", "ret_k")

CHOICE = J.SelectionRunConfig(
    screens=SCREENS, factors=YEAR, factor_names=CORE_FACTORS, selection=SelectionConfig(target_count=20), use_regime=True, country="EUROPE",
    run=J.RunConfig(cleaning=CleaningConfig(top_k=15), backtest=False),
)


def tables(t):
    idx = t.statements.select("ticker", "period_type", "period_date").distinct()
    return dict(statements=idx, ratings=t.ratings, trades=t.insider, macro=t.macro, members=members(t))


@query("j2_selected", sql("SELECT ticker FROM pick_k", "pick_k"))
def j2(t):
    return J.select_universe(t.panel, with_growth(t), t.listing, CHOICE, **tables(t))


@query("j2_weights", sql(f"SELECT asset, {rd('w')} AS w FROM jk_w", "jk_w"))
def j2_weights(t):
    # Sector labels of the imputation follow the preset with unmapped names.
    chosen = j2(t)
    out = J.full_run(t.panel.join(chosen, "ticker", "left_semi"), sectors(t), config=CHOICE.run)
    return rounded(out["weights"])


# Strategies

BEST = "(SELECT portfolio FROM {} ORDER BY round({}, 12) DESC, portfolio LIMIT 1)"
part("pari", "SELECT portfolio, -sum((w * cw / pv - 1.0 / k) * (w * cw / pv - 1.0 / k)) AS parity, max(ws / sqrt(pv)) AS div FROM rc GROUP BY 1", "rc")
part("tailp", "SELECT portfolio, date FROM pd WHERE rn <= worst", "pd")
part("cvp", """SELECT portfolio, -sum((c / t - 1.0 / n) * (c / t - 1.0 / n)) AS parity FROM (SELECT portfolio, c, sum(c) OVER (PARTITION BY portfolio) AS t, count(*) OVER (PARTITION BY portfolio) AS n FROM (SELECT portfolio, asset, sum(w * r) AS c FROM tailp JOIN bret USING (date)
  JOIN cw ON cw.asset = bret.ticker AND cw.portfolio = tailp.portfolio GROUP BY tailp.portfolio, cw.portfolio, asset)) GROUP BY 1""".replace("SELECT portfolio, asset, sum", "SELECT tailp.portfolio, asset, sum"), "tailp", "bret", "cw")
part("inn2", "SELECT substr(ticker, 1, 7) AS cluster, ticker AS asset, 1 / v / sum(1 / v) OVER (PARTITION BY substr(ticker, 1, 7)) AS w FROM (SELECT ticker, var_samp(r) AS v FROM bret GROUP BY 1)", "bret")
part("out2", "SELECT cluster, 1 / v / sum(1 / v) OVER () AS v FROM (SELECT cluster, var_samp(r) AS v FROM (SELECT cluster, date, sum(w * r) AS r FROM inn2 JOIN bret ON ticker = asset GROUP BY 1, 2) GROUP BY 1)", "inn2", "bret")
_PICKS = {
    "max-sharpe": BEST.format("rt", "mean / standard_deviation"), "min-variance": BEST.format("rt", "-variance"), "min-cvar": BEST.format("rt", "-cvar"),
    "max-utility": BEST.format("rt", "mean - variance"), "risk-parity": BEST.format("pari", "parity"), "cvar-parity": BEST.format("cvp", "parity"),
    "max-diversification": BEST.format("pari", "div"),
}
_STRATEGY_SQL = " UNION ALL ".join(
    [f"SELECT '{s}' AS strategy, asset, {rd('w')} AS w FROM cw WHERE portfolio = {p}" for s, p in _PICKS.items()]
    + [f"SELECT 'hrp', asset, {rd('w * v')} FROM inn2 JOIN out2 USING (cluster)", f"SELECT 'herc', asset, {rd('w * v')} FROM innr JOIN outr USING (cluster)",
       f"SELECT 'equal-weight', ticker, {rd('1.0 / count(*) OVER ()')} FROM (SELECT DISTINCT ticker FROM bret)",
       f"SELECT 'inverse-vol', ticker, {rd('1 / s / sum(1 / s) OVER ()')} FROM (SELECT ticker, stddev_samp(r) AS s FROM bret GROUP BY 1)"])


@query("j3_strategies", sql(_STRATEGY_SQL, "cw", "rt", "pari", "cvp", "inn2", "out2", "innr", "outr", "bret"))
def j3(t):
    r = t.weekly_returns
    out = None
    for name in J.STRATEGIES:
        w = J.strategy_weights(name, r, clusters(t), N_CANDIDATES).select(F.lit(name).alias("strategy"), "asset", "w")
        out = w if out is None else out.unionByName(w)
    return rounded(out)


@query("j3_strategy_run", sql(f"SELECT 'latest' AS as_of, asset, {rd('w')} AS w FROM ja_w", "ja_w"))
def j3_run(t):
    path = fresh_path(t.spark, "strategy")
    J.run_strategy("inverse-vol", t.panel, sectors(t), sectors(t).withColumnRenamed("sector", "cluster"), J.RunConfig(cleaning=CleaningConfig(top_k=15), backtest=False), path)
    return rounded(t.spark.read.schema("asset string, w double, as_of string").option("header", True).csv(path).select("as_of", "asset", "w"))
