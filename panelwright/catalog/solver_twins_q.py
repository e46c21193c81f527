"""SQL twins that iterate: greedy pair removal, power iteration and conjugate gradients on lists."""

from panelwright.catalog import clean_q, moments_q, research_q  # noqa: F401  (queries and SQL parts read here)
from panelwright.catalog.base import part, rd, recursive, twin
from panelwright.catalog.research_q import FOUR

# One pass over the pairs above the limit, from the highest correlation down.
part("gm", "SELECT asset_i, avg(round(corr, 12)) AS m FROM bcov GROUP BY 1", "bcov")
part("gp", """SELECT row_number() OVER (ORDER BY c DESC, i DESC, j DESC) AS rn, i, j, CASE WHEN round(a.m - b.m, 12) > 0 THEN i ELSE j END AS loser
  FROM (SELECT asset_i AS i, asset_j AS j, round(corr, 12) AS c FROM bcov WHERE asset_i < asset_j AND round(corr, 12) > 0.05) JOIN gm a ON a.asset_i = i JOIN gm b ON b.asset_i = j""", "bcov", "gm")
part("gw", """SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone UNION ALL
  SELECT rn, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, loser) END FROM gw JOIN gp ON rn = k + 1""")
twin("p9_drop_correlated", recursive("SELECT unnest(gone) AS ticker FROM gw WHERE k = (SELECT max(k) FROM gw)", "gp", "gw"))

# The covariance as a list of rows.
part("cm", "SELECT list(r ORDER BY asset_i) AS m, list(asset_i ORDER BY asset_i) AS names FROM (SELECT asset_i, list(cov ORDER BY asset_j) AS r FROM bcov GROUP BY 1)", "bcov")
part("ml", "SELECT list(mu ORDER BY asset) AS mu, avg(mu) AS g, count(*) AS n FROM bmu", "bmu")

# Largest eigenvalue by power iteration.
part("pow", """SELECT 0 AS k, list_transform(names, lambda x: CAST(1 AS DOUBLE)) AS v FROM cm UNION ALL
  SELECT k + 1, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS y FROM pow, cm WHERE k < 4000)""")
part("eig", "SELECT v, names, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM pow, cm WHERE k = 4000")
part("ev", "SELECT unnest(names) AS asset, unnest(v) AS v, l FROM eig")
twin("e13_detoned", recursive(f"SELECT asset_i, asset_j, {rd('cov - a.l * a.v * b.v')} AS cov FROM bcov JOIN ev a ON a.asset = asset_i JOIN ev b ON b.asset = asset_j", "bcov", "cm", "pow", "eig", "ev"))

part("jsa", """SELECT 1 - (tr - 2 * l) / gap / t AS a, g FROM (SELECT sum(cov) AS tr FROM bcov WHERE asset_i = asset_j), (SELECT l FROM eig), ml,
  (SELECT sum((mu - gg) * (mu - gg)) AS gap FROM bmu, (SELECT avg(mu) AS gg FROM bmu)), (SELECT count(DISTINCT date) AS t FROM bret)""")
twin("e2_shrunk_mean_james_stein", recursive(f"SELECT asset, {rd('a * mu + (1 - a) * g')} AS mu FROM bmu, jsa", "bret", "bcov", "bmu", "cm", "ml", "pow", "eig", "jsa"))


def conjugate(tag, matrix, rhs):
    """Parts ``tag`` (steps) and ``tag_z`` (solution list) of matrix @ z = rhs; both are list columns m and b."""
    at = "generate_series(1, len(p))"
    part(tag, f"""SELECT 0 AS k, list_transform(b, lambda x: CAST(0 AS DOUBLE)) AS z, b AS r, b AS p, list_dot_product(b, b) AS rr FROM {rhs} UNION ALL
      SELECT k + 1, z2, r2, list_transform({at}, lambda i: r2[i] + rr2 / rr * p[i]), rr2 FROM (SELECT *, list_dot_product(r2, r2) AS rr2 FROM (
        SELECT k, rr, p, list_transform({at}, lambda i: z[i] + a * p[i]) AS z2, list_transform({at}, lambda i: r[i] - a * ap[i]) AS r2 FROM (
          SELECT *, rr / list_dot_product(p, ap) AS a FROM (SELECT {tag}.*, list_transform(m, lambda row_: list_dot_product(row_, p)) AS ap FROM {tag}, {matrix} WHERE k < 200 AND rr > 1e-30))))""")
    part(f"{tag}_z", f"SELECT z FROM {tag} WHERE k = (SELECT max(k) FROM {tag})")


part("bgap", "SELECT list_transform(mu, lambda x: x - g) AS b FROM ml", "ml")
part("bmul", "SELECT mu AS b FROM ml", "ml")
part("bone", "SELECT list_transform(mu, lambda x: CAST(1 AS DOUBLE)) AS b FROM ml", "ml")
conjugate("cgg", "cm", "bgap")
conjugate("cgm", "cm", "bmul")
conjugate("cgo", "cm", "bone")
part("bsa", "SELECT (n + 2) / ((n + 2) + t * list_dot_product(b, z)) AS s, g FROM ml, bgap, cgg_z, (SELECT count(DISTINCT date) AS t FROM bret)")
twin("e2_shrunk_mean_bayes_stein", recursive(f"SELECT asset, {rd('(1 - s) * mu + s * g')} AS mu FROM bmu, bsa", "bret", "bcov", "bmu", "cm", "ml", "bgap", "cgg", "cgg_z", "bsa"))
part("boq", """SELECT list_dot_product(mu, zm) AS u, g * g * list_dot_product(b, zo) AS v, g * list_dot_product(mu, zo) AS w, n, t, g FROM ml, bone, (SELECT z AS zm FROM cgm_z), (SELECT z AS zo FROM cgo_z), (SELECT count(DISTINCT date) AS t FROM bret)""")
part("boa", "SELECT ((u - n / (t - n)) * v - w * w) / (u * v - w * w) AS a, w / v AS q, g FROM boq")
twin("e2_shrunk_mean_bodnar_okhrin", recursive(f"SELECT asset, {rd('a * mu + (1 - a) * q * g')} AS mu FROM bmu, boa", "bret", "bcov", "bmu", "cm", "ml", "bmul", "bone", "cgm", "cgm_z", "cgo", "cgo_z", "boq", "boa"))

# Ridge: centred normal equations with the penalty on the diagonal.
part("zw", "SELECT date, ticker, " + ", ".join(f"max(x) FILTER (factor = '{f}') AS f{i}" for i, f in enumerate(FOUR)) + " FROM zs GROUP BY 1, 2", "zs")
part("rtr", "SELECT f0, f1, f2, f3, fwd AS y FROM zw JOIN fwd USING (date, ticker) WHERE date < (SELECT max(date) FROM zw JOIN fwd USING (date, ticker)) AND f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND fwd IS NOT NULL", "zw", "fwd")
part("rm", "SELECT [" + ", ".join("[" + ", ".join(f"count(*) * covar_pop(f{i}, f{j})" + (" + 1" if i == j else "") for j in range(4)) + "]" for i in range(4)) + "] AS m FROM rtr", "rtr")
part("rb", "SELECT [" + ", ".join(f"count(*) * covar_pop(f{i}, y)" for i in range(4)) + "] AS b FROM rtr", "rtr")
conjugate("cgr", "rm", "rb")
part("rw", "SELECT z, my - list_dot_product(z, mx) AS c FROM cgr_z, (SELECT avg(y) AS my, [avg(f0), avg(f1), avg(f2), avg(f3)] AS mx FROM rtr)")
RIDGE = ("rtr", "rm", "rb", "cgr", "cgr_z", "rw")
twin("c5_ridge_fit", recursive("SELECT term, " + rd("coefficient") + " AS coefficient FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS term, z[{i + 1}] AS coefficient FROM rw" for i, f in enumerate(FOUR)) + " UNION ALL SELECT 'intercept', c FROM rw)", *RIDGE))
part("rte", "SELECT * FROM zw JOIN fwd USING (date, ticker) WHERE date = (SELECT max(date) FROM zw JOIN fwd USING (date, ticker))", "zw", "fwd")
part("rp", "SELECT ticker, f0 IS NULL OR f1 IS NULL OR f2 IS NULL OR f3 IS NULL AS hole, c + " + " + ".join(f"z[{i + 1}] * coalesce(f{i}, avg(f{i}) OVER ())" for i in range(4)) + " AS raw FROM rte, rw", "rte")
RIDGE_SCORES = recursive(f"SELECT ticker, {rd('CASE WHEN NOT hole THEN (raw - avg(raw) OVER ()) / stddev_pop(raw) OVER () END')} AS composite FROM rp", *RIDGE, "rte", "rp")
twin("c7_ridge_scores", RIDGE_SCORES)
twin("c8_composite_ridge", RIDGE_SCORES)


def eigen(tag, matrix, count, steps):
    """Parts ``tag_e0..`` with (v, l): leading eigenpairs of the list matrix m by power iteration and deflation."""
    used = []
    source = matrix
    for c in range(count):
        p, e, d = f"{tag}_p{c}", f"{tag}_e{c}", f"{tag}_m{c + 1}"
        part(p, f"""SELECT 0 AS k, list_transform(m, lambda r: 1 + sin(1.7 * r[1] + len(r) * r[2])) AS v FROM {source} UNION ALL
          SELECT k + 1, list_transform(y, lambda q: q / sqrt(list_dot_product(y, y))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS y FROM {p}, {source} WHERE k < {steps})""")
        part(e, f"SELECT {c} AS c, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM {p}, {source} WHERE k = {steps}")
        used += [p, e]
        if c < count - 1:
            part(d, f"SELECT list_transform(generate_series(1, len(m)), lambda i: list_transform(generate_series(1, len(m)), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM {source}, {e}")
            used.append(d)
            source = d
    part(f"{tag}_all", " UNION ALL ".join(f"SELECT * FROM {tag}_e{c}" for c in range(count)))
    return [*used, f"{tag}_all"]


SPECTRUM = eigen("dn", "cm", 10, 2500)
part("dsum", "SELECT sum(cov) AS tr, max(n) AS n, max(n) * 0 + (SELECT count(DISTINCT date) FROM bret) AS t FROM bcov, ml WHERE asset_i = asset_j")
part("dsig", "SELECT v, l FROM dn_all, dsum WHERE l > tr / n * pow(1 + sqrt(n / t), 2)")
part("dnoise", "SELECT (tr - coalesce((SELECT sum(l) FROM dsig), 0)) / (n - (SELECT count(*) FROM dsig)) AS noise FROM dsum")
part("dload", "SELECT unnest(names) AS asset, unnest(v) AS x, l FROM dsig, cm")
part("dlow", "SELECT a.asset AS asset_i, b.asset AS asset_j, sum((a.l - noise) * a.x * b.x) AS s FROM dload a JOIN dload b ON a.l = b.l, dnoise GROUP BY 1, 2")
twin("e12_denoised", recursive(f"SELECT asset_i, asset_j, {rd('s + CASE WHEN asset_i = asset_j THEN noise ELSE 0 END')} AS cov FROM dlow, dnoise", "bret", "bcov", "cm", "ml", *SPECTRUM, "dsum", "dsig", "dnoise", "dload", "dlow"))

part("fcm", "SELECT [" + ", ".join("[" + ", ".join("1.0::DOUBLE" if i == j else f"corr(f{i}, f{j})" for j in range(4)) + "]" for i in range(4)) + "] AS m FROM wideok", "wideok")
FACTOR_EIGEN = eigen("fe", "fcm", 4, 1500)
part("fes", """SELECT c, l, list_transform(v, lambda x: x * CASE WHEN v[list_position(list_transform(v, lambda y: round(abs(y), 9)), list_max(list_transform(v, lambda y: round(abs(y), 9))))] >= 0 THEN 1 ELSE -1 END) AS v,
  l / 4 AS explained, sum(l / 4) OVER (ORDER BY c) AS cumulated FROM fe_all""")
NAME_LIST = "['" + "', '".join(FOUR) + "']"
twin("v12_factor_components", recursive(f"""SELECT 'PC' || CAST(c + 1 AS VARCHAR) AS component, {rd('explained')} AS explained, {rd('cumulated')} AS cumulated, (SELECT min(c) + 1 FROM fes WHERE cumulated >= 0.95) AS needed_95,
  unnest({NAME_LIST}) AS factor, {rd('unnest(v)')} AS loading FROM fes""", "wideok", "fcm", *FACTOR_EIGEN, "fes"))
part("fst", "SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(4)) + " FROM wideok")
part("fproj", "SELECT date, ticker, c, " + " + ".join(f"(f{i} - m{i}) / s{i} * v[{i + 1}]" for i in range(4)) + " AS x FROM wideok, fst, fes")
twin("z7_orthogonalize", recursive("SELECT CAST(w.date AS VARCHAR) AS date, w.ticker, " + ", ".join(f"{rd(f'max(x) FILTER (c = {i})')} AS PC{i + 1}" for i in range(4))
    + " FROM wide w LEFT JOIN fproj p ON p.date = w.date AND p.ticker = w.ticker GROUP BY 1, 2", "wide", "wideok", "fcm", *FACTOR_EIGEN, "fes", "fst", "fproj"))

# Regression imputation: the normal equations of every asset solved by conjugate gradients.
part("bg", "SELECT date, ticker, substr(ticker, 1, 7) AS sector, CASE WHEN (CAST(substr(ticker, 7) AS BIGINT) + date_diff('day', DATE '1995-01-02', date) // 7) % 29 <> 0 THEN r END AS r FROM (SELECT DISTINCT date FROM bret) CROSS JOIN (SELECT DISTINCT ticker FROM bret) LEFT JOIN bret USING (date, ticker)", "bret")
part("bgn", """SELECT ticker, nb, row_number() OVER (PARTITION BY ticker ORDER BY round(abs(c), 12) DESC, nb) AS k FROM (SELECT a.ticker, b.ticker AS nb, corr(a.r, b.r) AS c FROM bg a JOIN bg b USING (date) WHERE a.ticker <> b.ticker GROUP BY 1, 2)""", "bg")
part("bgx", "SELECT n.ticker, b.date, [1.0::DOUBLE, " + ", ".join(f"max(r) FILTER (k = {i})" for i in range(1, 6)) + "] AS x FROM bgn n JOIN bg b ON b.ticker = n.nb WHERE k <= 5 AND r IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 5", "bgn", "bg")
part("bge", "SELECT ticker, [" + ", ".join("[" + ", ".join(f"sum(x[{i}] * x[{j}])" for j in range(1, 7)) + "]" for i in range(1, 7)) + "] AS m, [" + ", ".join(f"sum(x[{i}] * r)" for i in range(1, 7)) + "] AS b FROM bgx JOIN bg USING (ticker, date) WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 60", "bgx", "bg")
part("cgb", """SELECT ticker, 0 AS k, list_transform(b, lambda x: CAST(0 AS DOUBLE)) AS z, b AS r, b AS p, list_dot_product(b, b) AS rr FROM bge UNION ALL
  SELECT ticker, k + 1, z2, r2, list_transform(generate_series(1, 6), lambda i: r2[i] + rr2 / rr * p[i]), rr2 FROM (SELECT *, list_dot_product(r2, r2) AS rr2 FROM (
    SELECT ticker, k, rr, p, list_transform(generate_series(1, 6), lambda i: z[i] + a * p[i]) AS z2, list_transform(generate_series(1, 6), lambda i: r[i] - a * ap[i]) AS r2 FROM (
      SELECT *, rr / list_dot_product(p, ap) AS a FROM (SELECT cgb.*, list_transform(m, lambda row_: list_dot_product(row_, p)) AS ap FROM cgb JOIN bge USING (ticker) WHERE k < 100 AND rr > 1e-28))))""")
part("bgz", "SELECT ticker, arg_max(z, k) AS z FROM cgb GROUP BY 1")
part("bgf", "SELECT ticker, date, list_dot_product(x, z) AS fit FROM bgx JOIN bgz USING (ticker)")
twin("p5_regression_imputation", recursive(f"SELECT CAST(date AS VARCHAR) AS date, ticker, {rd('coalesce(r, fit, sm, dm)')} AS r FROM (SELECT *, avg(r) OVER (PARTITION BY date, sector) AS sm, avg(r) OVER (PARTITION BY date) AS dm FROM bg) LEFT JOIN bgf USING (ticker, date)", "bg", "bgn", "bgx", "bge", "cgb", "bgz", "bgf"))
