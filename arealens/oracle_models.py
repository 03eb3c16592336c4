"""DuckDB SQL for least squares with HC3 errors on any number of regressors.

The normal equations of the standardised columns are inverted by Gauss-Jordan
steps over lists in a recursive CTE; a column without a pivot (a linear
combination of earlier ones) is left out, which does not change fitted values.
"""

from __future__ import annotations

TWO_SIDED_P = ("(CASE WHEN abs({z}) > 8 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 160), "
               "lambda q: exp((2 * q + 1) * ln(greatest(abs({z}), 1e-300) / sqrt(2)) + q * ln(4) + lgamma(q + 1) - lgamma(2 * q + 2)))) END)")


def _inverse(name: str, source: str, column: str) -> str:
    """CTE ``name``: a, the inverse of the square matrix ``column`` of the one row in
    ``source``; used, which columns had a pivot; m, the reduced matrix."""
    return f"""
{name}_gj AS (
  SELECT 0 AS p, len({column}) AS k, {column} AS g0, list_transform(range(1, len({column}) + 1), lambda i: list_concat({column}[i],
    list_transform(range(1, len({column}) + 1), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS m,
    CAST([] AS BOOLEAN[]) AS used FROM {source}
  UNION ALL
  SELECT p + 1, k, g0, CASE WHEN abs(m[p + 1][p + 1]) <= 1e-9 * g0[p + 1][p + 1] THEN m
    ELSE list_transform(range(1, k + 1), lambda i: CASE WHEN i = p + 1 THEN list_transform(m[p + 1], lambda v: v / m[p + 1][p + 1])
      ELSE list_transform(range(1, 2 * k + 1), lambda j: m[i][j] - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1]) END) END,
    list_append(used, abs(m[p + 1][p + 1]) > 1e-9 * g0[p + 1][p + 1])
  FROM {name}_gj WHERE p < k),
{name} AS (
  SELECT list_transform(range(1, k + 1), lambda i: list_transform(range(1, k + 1),
    lambda j: CASE WHEN used[i] AND used[j] THEN m[i][k + j] ELSE 0.0::DOUBLE END)) AS a, used, m FROM {name}_gj WHERE p = k)"""


def ols_ctes(src: str, y: str, terms: list[tuple[str, str]], keep: str = "") -> list[str]:
    """CTEs over the rows of ``src`` without a NULL in ``y`` or a term: d (the data),
    fit (one row: n, my, mx, sx, bz, b, b0, ...), res (e, h), cov (one row), coef."""
    k = len(terms)
    idx = range(1, k + 1)
    exprs = ", ".join(f"CAST({e} AS DOUBLE)" for _, e in terms)
    extra = f", {keep}" if keep else ""
    pair = lambda f: "[" + ", ".join("[" + ", ".join(f(i, j) for j in idx) + "]" for i in idx) + "]"
    return [f"""
d AS (SELECT CAST({y} AS DOUBLE) AS y, [{exprs}] AS x{extra} FROM {src}
      WHERE {y} IS NOT NULL AND list_bool_and([{", ".join(f"({e}) IS NOT NULL" for _, e in terms)}]))""", f"""
mo AS (SELECT count(*) AS n, avg(y) AS my, [{", ".join(f"avg(x[{i}])" for i in idx)}] AS mx,
         [{", ".join(f"stddev_pop(x[{i}])" for i in idx)}] AS sx FROM d)""", f"""
zc AS (SELECT d.*, y - my AS yc, list_transform(range(1, {k + 1}),
         lambda i: CASE WHEN sx[i] > 0 THEN (x[i] - mx[i]) / sx[i] ELSE 0.0::DOUBLE END) AS z FROM d, mo)""", f"""
gram AS (SELECT {pair(lambda i, j: f"sum(z[{min(i, j)}] * z[{max(i, j)}])")} AS g,
           [{", ".join(f"sum(z[{i}] * yc)" for i in idx)}] AS gy, sum(yc * yc) AS sst FROM zc)""",
            _inverse("inv", "gram", "g"), f"""
fit AS (SELECT mo.*, a, used, m, g, sst, list_transform(range(1, {k + 1}), lambda i: list_dot_product(a[i], gy)) AS bz FROM mo, inv, gram)""", f"""
slopes AS (SELECT fit.*, list_transform(range(1, {k + 1}), lambda i: CASE WHEN sx[i] > 0 THEN bz[i] / sx[i] ELSE 0.0::DOUBLE END) AS b FROM fit)""", """
full_fit AS (SELECT *, my - list_dot_product(b, mx) AS b0 FROM slopes)""", f"""
res AS (SELECT zc.*, yc - list_dot_product(z, bz) AS e,
          1.0::DOUBLE / n + list_dot_product(z, list_transform(range(1, {k + 1}), lambda i: list_dot_product(a[i], z))) AS h FROM zc, fit)""", """
wr AS (SELECT *, (e / (1 - h)) * (e / (1 - h)) AS w FROM res)""", f"""
meat AS (SELECT sum(w) AS w0, [{", ".join(f"sum(w * z[{i}])" for i in idx)}] AS w1,
           {pair(lambda i, j: f"sum(w * z[{min(i, j)}] * z[{max(i, j)}])")} AS w2 FROM wr)""", f"""
am AS (SELECT full_fit.*, w0, list_transform(range(1, {k + 1}), lambda i: list_dot_product(a[i], w1)) AS c01,
         list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 1}),
           lambda j: list_dot_product(a[i], list_transform(range(1, {k + 1}), lambda q: w2[q][j])))) AS aw FROM full_fit, meat)""", f"""
cov AS (SELECT *, list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 1}),
          lambda j: list_dot_product(aw[i], a[j]))) AS v,
          list_transform(range(1, {k + 1}), lambda i: CASE WHEN sx[i] > 0 THEN mx[i] / sx[i] ELSE 0.0::DOUBLE END) AS t FROM am)""", f"""
errors AS (SELECT *, w0 / (n * n) - 2 * list_dot_product(t, c01) / n
             + list_dot_product(t, list_transform(range(1, {k + 1}), lambda i: list_dot_product(v[i], t))) AS v0,
             list_transform(sx, lambda q: CASE WHEN q > 0 THEN q ELSE 1.0::DOUBLE END) AS sd FROM cov)""", f"""
raw AS (SELECT *, list_concat([b0], b) AS c, list_concat(
          [list_concat([v0], list_transform(range(1, {k + 1}), lambda j: (c01[j] / n - list_dot_product(t, v[j])) / sd[j]))],
          list_transform(range(1, {k + 1}), lambda i: list_concat([(c01[i] / n - list_dot_product(t, v[i])) / sd[i]],
            list_transform(range(1, {k + 1}), lambda j: v[i][j] / (sd[i] * sd[j]))))) AS cc,
          list_transform(list_filter(range(1, {k + 1}), lambda p: NOT used[p]), lambda p: list_transform(range(1, {k + 1}),
            lambda j: (CASE WHEN j = p THEN 1.0::DOUBLE WHEN used[j] THEN -m[j][p] ELSE 0.0::DOUBLE END) / sd[j])) AS nulls0
        FROM errors)""", """
nulled AS (SELECT *, list_transform(nulls0, lambda q: list_concat([-list_dot_product(q, mx)], q)) AS nulls FROM raw)""", """
nn AS (SELECT *, list_transform(nulls, lambda q: list_transform(nulls, lambda r: list_dot_product(q, r))) AS ng FROM nulled)""",
            _inverse("ninv", "nn", "ng"), f"""
off AS (SELECT nn.*, list_transform(range(1, {k + 2}), lambda i: list_transform(range(1, {k + 2}), lambda j:
          (CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - coalesce(list_sum(list_transform(range(1, len(nulls) + 1),
            lambda q: nulls[q][i] * list_sum(list_transform(range(1, len(nulls) + 1), lambda r: ninv.a[q][r] * nulls[r][j])))), 0.0::DOUBLE))) AS pr
        FROM nn, ninv)""", f"""
half AS (SELECT *, list_transform(pr, lambda q: list_dot_product(q, c)) AS cf,
           list_transform(pr, lambda q: list_transform(range(1, {k + 2}), lambda j: list_dot_product(q, cc[j]))) AS pc FROM off)""", f"""
least AS (SELECT *, list_transform(range(1, {k + 2}), lambda i: list_dot_product(pc[i], pr[i])) AS vf FROM half)"""]


def ols_coef(terms: list[tuple[str, str]], intercept: str = "Intercept") -> str:
    """SELECT body: term, coef, std_err, z_value, p_value; of least norm where the design is deficient."""
    names = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in [intercept, *(n for n, _ in terms)]) + "]"
    return f"""
terms AS (SELECT {names}[i] AS term, cf[i] AS coef, sqrt(greatest(vf[i], 0.0)) AS std_err FROM least, range(1, {len(terms) + 2}) r(i)),
coef AS (SELECT *, {TWO_SIDED_P.format(z="z_value")} AS p_value FROM (SELECT *, coef / nullif(std_err, 0) AS z_value FROM terms))"""


def fit_stats(k: int) -> list[str]:
    """CTE ``stats`` (metric, value) from ``res``, ``errors`` and the inverse of the slopes' covariance."""
    return [_inverse("vinv", "errors", "v"), """
sums AS (SELECT sum(e * e) AS ssr, avg(e) AS m1 FROM res)""", """
mom AS (SELECT avg(pow(e - m1, 2)) AS c2, avg(pow(e - m1, 3)) AS c3, avg(pow(e - m1, 4)) AS c4 FROM res, sums)""", f"""
base AS (SELECT errors.n::DOUBLE AS n, list_sum(list_transform(errors.used, lambda u: CASE WHEN u THEN 1 ELSE 0 END))::DOUBLE AS q, sst, ssr,
           c3 / pow(c2, 1.5) AS skew, c4 / (c2 * c2) AS kurt,
           list_dot_product(bz, list_transform(range(1, {k + 1}), lambda i: list_dot_product(vinv.a[i], bz))) AS wald
         FROM errors, sums, mom, vinv)""", """
stat AS (SELECT *, n - q - 1 AS dfr, 1 - ssr / sst AS r2, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS llf,
           n / 6 * (skew * skew + (kurt - 3) * (kurt - 3) / 4) AS jb FROM base)""", """
stats AS (
  SELECT unnest(['nobs', 'df_model', 'df_resid', 'rsquared', 'rsquared_adj', 'fvalue', 'llf', 'aic', 'bic', 'skew', 'kurtosis',
                 'jarque_bera', 'jarque_bera_pvalue', 'ssr', 'sst']) AS metric,
         unnest([n, q, dfr, r2, 1 - (1 - r2) * (n - 1) / dfr, wald / q, llf, -2 * llf + 2 * (q + 1), -2 * llf + ln(n) * (q + 1), skew, kurt,
                 jb, exp(-jb / 2), ssr, sst]) AS value
  FROM stat)"""]


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip("\n") for c in ctes) + "\n"
