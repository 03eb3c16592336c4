"""Least squares with HC3 errors, ridge with cross-validated penalty, and PCA,
all from distributed sufficient statistics.

OLS takes three aggregate passes over the (cached) model frame:
  1. means of y and every term;
  2. the centred Gram matrix and X'y;
  3. residuals, leverages, the HC3 "meat" and the residual moments.
Each pass adds up k x k numbers per task with NumPy on Arrow batches.
Only k x k matrices are solved on the driver.  The solution uses a
pseudo-inverse on the scaled, centred Gram, so a rank-deficient design gets
minimum-norm coefficients (equal split for duplicated columns).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats as ST
from .design import DesignTerm
from .moments import centered_gram, matrix_sums, means


@dataclass
class OLSResult:
    names: list
    coef: np.ndarray
    cov: np.ndarray
    n: int
    rank: int
    ssr: float
    sst: float
    metrics: dict = field(default_factory=dict)
    terms: list = field(default_factory=list)

    @property
    def std_err(self):
        return np.sqrt(np.maximum(np.diag(self.cov), 0.0))

    def prediction(self) -> Column:
        """Linear predictor as one column expression (no UDF, no collect)."""
        expr = F.lit(0.0)
        for t, b in zip(self.terms, self.coef):
            if b != 0.0:
                expr = expr + t.expr * F.lit(float(b))
        return expr

    def coefficient_rows(self):
        rows = []
        for name, b, se in zip(self.names, self.coef, self.std_err):
            z = b / se if se > 0 else float("nan")
            rows.append((name, float(b), float(se), float(z), ST.normal_two_sided_p(z)))
        return rows

    def coefficients(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.coefficient_rows(),
            "term string, coef double, std_err double, z_value double, p_value double")

    def fit_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in self.metrics.items()],
                                     "metric string, value double")


def _omnibus(n, skew, kurt):
    """D'Agostino-Pearson K^2 from sample skewness and (Pearson) kurtosis."""
    if n < 8:
        return float("nan"), float("nan")
    y = skew * math.sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    y = y if y != 0 else 1.0
    zs = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (kurt - e) / math.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + math.sqrt(1 + 4.0 / (sb1 ** 2)))
    t1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * math.sqrt(2 / (a - 4.0))
    if denom == 0:
        return float("nan"), float("nan")
    t2 = math.copysign(1.0, denom) * ((1 - 2.0 / a) / abs(denom)) ** (1 / 3.0)
    zk = (t1 - t2) / math.sqrt(2 / (9.0 * a))
    k2 = zs * zs + zk * zk
    return k2, ST.chi2_2df_tail(k2)


def fit_ols(df: DataFrame, terms, y: str, cov_type: str = "HC3", intercept_name=None) -> OLSResult:
    """OLS of ``y`` on ``terms`` (list of DesignTerm, with an intercept term).

    ``df`` must already be complete-case for y and every term."""
    names = [t.name for t in terms]
    icpt = [i for i, t in enumerate(terms)
            if (intercept_name and t.name == intercept_name) or t.name in ("Intercept", "const")]
    if len(icpt) != 1:
        raise ValueError("the design needs exactly one intercept/constant term")
    ii = icpt[0]
    slope_idx = [i for i in range(len(terms)) if i != ii]
    yx = F.col(f"`{y}`").cast("double")
    xs = [terms[i].expr for i in slope_idx]
    k = len(xs)

    # pass 1: means
    n, mu_all = means(df, [yx] + xs)
    if n == 0:
        raise ValueError("empty model frame")
    my, mx = mu_all[0], mu_all[1:]
    # pass 2: centred Gram of [y, x]
    g = centered_gram(df, [yx] + xs, mu_all)
    syy, cxy, cxx = g[0, 0], g[1:, 0], g[1:, 1:]
    d = np.sqrt(np.maximum(np.diag(cxx), 0.0))
    d_safe = np.where(d > 0, d, 1.0)
    cs = cxx / np.outer(d_safe, d_safe)
    cs[d == 0, :] = 0.0
    cs[:, d == 0] = 0.0
    pinv_s, rank_s, _ = ST.psd_pinv(cs)
    a_c = pinv_s / np.outer(d_safe, d_safe)
    beta = a_c @ cxy
    b0c = my
    rank = rank_s + 1

    # leverage factor: A_c = L L' (leverage does not depend on which
    # generalised inverse is used)
    w, v = np.linalg.eigh((pinv_s + pinv_s.T) / 2)
    keep = w > 1e-14 * max(w.max(initial=0), 0)
    lf = (v[:, keep] * np.sqrt(w[keep])) / d_safe[:, None]
    # pass 3: residual moments and the HC3 meat, summed task by task
    side = max(k + 2, 4)

    def residuals(rows):
        c = rows[:, 1:] - mx
        e = rows[:, 0] - b0c - c @ beta
        out = np.zeros((side, side))
        out[0, :4] = (e * e).sum(), e.sum(), (e ** 3).sum(), (e ** 4).sum()
        if cov_type == "HC3":
            h = 1.0 / n + ((c @ lf) ** 2).sum(axis=1)
            w = (e / (1.0 - h)) ** 2
        else:
            w = e * e
        z = np.column_stack([np.ones(len(e)), c])
        out[1:k + 2, 1:k + 2] = (z * w[:, None]).T @ z
        return out

    third = matrix_sums(df, [yx] + xs, residuals, (side, side))
    ssr, se1, se3, se4 = (float(v) for v in third[0, :4])
    meat = third[1:k + 2, 1:k + 2]

    # covariance in centred coordinates (intercept first), then map back
    if cov_type in ("HC3", "HC0"):
        bread = np.zeros((k + 1, k + 1))
        bread[0, 0] = 1.0 / n
        bread[1:, 1:] = a_c
        vc = bread @ meat @ bread
    else:
        sigma2 = ssr / max(n - rank, 1)
        vc = np.zeros((k + 1, k + 1))
        vc[0, 0] = sigma2 / n
        vc[1:, 1:] = sigma2 * a_c
    t = np.eye(k + 1)
    t[0, 1:] = -mx
    v_orig = t @ vc @ t.T
    coef_c = np.concatenate([[b0c - mx @ beta], beta])
    if rank_s < k:
        # The pseudo-inverse of the raw design (intercept included) gives the
        # solution of least norm: take away the part along the null space, whose
        # vectors are the slopes' null vectors with the intercept they shift.
        ws, vs0 = np.linalg.eigh((cs + cs.T) / 2)
        slopes0 = vs0[:, ws <= 1e-10 * max(ws.max(initial=0.0), 0.0)] / d_safe[:, None]
        null = np.vstack([-(mx @ slopes0), slopes0])
        off = np.eye(k + 1) - null @ np.linalg.pinv(null)
        coef_c, v_orig = off @ coef_c, off @ v_orig @ off

    # reorder to the term order
    order = [ii] + slope_idx
    coef = np.zeros(k + 1)
    cov = np.zeros((k + 1, k + 1))
    for a, ta in enumerate(order):
        coef[ta] = coef_c[a]
        for b, tb in enumerate(order):
            cov[ta, tb] = v_orig[a, b]

    sst = float(syy)
    df_model, df_resid = rank - 1, n - rank
    r2 = 1.0 - ssr / sst if sst > 0 else float("nan")
    m2 = ssr / n
    m1 = se1 / n
    c2 = m2 - m1 * m1
    skew = ((se3 / n) - 3 * m1 * m2 + 2 * m1 ** 3) / c2 ** 1.5 if c2 > 0 else float("nan")
    m4c = (se4 / n) - 4 * m1 * (se3 / n) + 6 * m1 * m1 * m2 - 3 * m1 ** 4
    kurt = m4c / (c2 * c2) if c2 > 0 else float("nan")
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else float("nan")
    # robust Wald F on all slopes
    vs = v_orig[1:, 1:]
    vs_inv, q, _ = ST.psd_pinv(vs, 1e-12)
    fval = float(beta @ vs_inv @ beta) / max(q, 1) if k else float("nan")
    jb = n / 6.0 * (skew ** 2 + (kurt - 3) ** 2 / 4.0)
    omni, omni_p = _omnibus(n, skew, kurt)
    raw = np.zeros((k + 1, k + 1))
    raw[0, 0] = n
    raw[0, 1:] = raw[1:, 0] = n * mx
    raw[1:, 1:] = cxx + n * np.outer(mx, mx)
    ev = np.linalg.eigvalsh(raw)
    cond = math.sqrt(ev.max() / ev.min()) if ev.min() > 0 else float("inf")
    metrics = {
        "nobs": float(n), "df_model": float(df_model), "df_resid": float(df_resid),
        "rsquared": r2,
        "rsquared_adj": 1.0 - (1.0 - r2) * (n - 1) / df_resid if df_resid > 0 else float("nan"),
        "fvalue": fval, "f_pvalue": ST.f_tail(fval, q, df_resid) if q and df_resid > 0 else float("nan"),
        "llf": llf, "aic": -2 * llf + 2 * rank, "bic": -2 * llf + math.log(n) * rank,
        "omnibus": omni, "omnibus_pvalue": omni_p, "skew": skew, "kurtosis": kurt,
        "jarque_bera": jb, "jarque_bera_pvalue": ST.chi2_2df_tail(jb), "condition_number": cond,
        "ssr": ssr, "sst": sst,
    }
    return OLSResult(names, coef, cov, n, rank, ssr, sst, metrics, list(terms))


# ---------------------------------------------------------------------------
# Ridge from sufficient statistics
# ---------------------------------------------------------------------------
RIDGE_ALPHAS = [10 ** (-3 + 6 * i / 24) for i in range(25)]  # logspace(-3, 3, 25)


@dataclass
class Suff:
    """Sufficient statistics of a row set: n, sum x, sum xx', sum xy, sum y, sum y^2."""
    n: float
    sx: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray
    sy: float
    syy: float

    def __add__(self, o):
        return Suff(self.n + o.n, self.sx + o.sx, self.sxx + o.sxx, self.sxy + o.sxy,
                    self.sy + o.sy, self.syy + o.syy)

    def __sub__(self, o):
        return Suff(self.n - o.n, self.sx - o.sx, self.sxx - o.sxx, self.sxy - o.sxy,
                    self.sy - o.sy, self.syy - o.syy)


def grouped_suff(df: DataFrame, xcols, y: str, group_cols) -> dict:
    """{group tuple: Suff} from one pass (groups are few: folds).

    Callers centre the columns first (``centred``): the sums are then well
    conditioned wherever the data lie."""
    k = len(xcols)

    def part(rows):
        z = np.column_stack([np.ones(len(rows)), rows])
        return z.T @ z

    exprs = [F.col(f"`{c}`") for c in xcols] + [F.col(f"`{y}`")]
    out = {}
    for key, m in matrix_sums(df, exprs, part, (k + 2, k + 2), group_cols).items():
        out[key] = Suff(float(m[0, 0]), m[0, 1:k + 1], m[1:k + 1, 1:k + 1], m[1:k + 1, k + 1], float(m[0, k + 1]), float(m[k + 1, k + 1]))
    return out


def centred(df: DataFrame, cols) -> tuple[DataFrame, dict]:
    """``df`` with the columns minus their overall means, and the means."""
    n, mu = means(df, [F.col(f"`{c}`").cast("double") for c in cols])
    shift = dict(zip(cols, map(float, mu), strict=True))
    return df.withColumns({c: F.col(f"`{c}`").cast("double") - F.lit(shift[c]) for c in cols}), shift


def scaler_from(s: Suff):
    mu = s.sx / s.n
    var = np.maximum(np.diag(s.sxx) / s.n - mu * mu, 0.0)
    sd = np.sqrt(var)
    return mu, np.where(sd > 0, sd, 1.0)  # a zero-variance column is left unscaled


def ridge_fit(s: Suff, alpha: float, mu, sd):
    """Ridge with intercept on rows ``s`` after standardising with (mu, sd).

    Returns (a, g, beta_std): prediction = a + g'x; beta_std the coefficients
    on the standardised scale."""
    n = s.n
    mx = s.sx / n
    cxx = s.sxx - n * np.outer(mx, mx)
    cxy = s.sxy - mx * s.sy
    dinv = 1.0 / sd
    zz = cxx * np.outer(dinv, dinv)
    zy = cxy * dinv
    beta = np.linalg.solve(zz + alpha * np.eye(len(sd)), zy)
    g = beta * dinv
    a = s.sy / n - g @ mx
    return a, g, beta


def r2_on(s: Suff, a: float, g) -> float:
    """R^2 of prediction a + g'x on the rows summarised by ``s``."""
    sse = s.syy - 2 * (a * s.sy + g @ s.sxy) + s.n * a * a + 2 * a * (g @ s.sx) + g @ s.sxx @ g
    sst = s.syy - s.sy * s.sy / s.n
    return 1.0 - sse / sst if sst > 0 else float("nan")


def ridge_path(s: Suff, alphas=RIDGE_ALPHAS, mu=None, sd=None):
    if mu is None:
        mu, sd = scaler_from(s)
    return [(a, ridge_fit(s, a, mu, sd)[2]) for a in alphas]


def pca_from_corr(r: np.ndarray, n_components: int):
    """Eigen-decomposition of a correlation matrix; each component's sign makes
    its largest-|loading| entry positive."""
    w, v = np.linalg.eigh(r)
    order = np.argsort(w)[::-1][:n_components]
    w, v = w[order], v[:, order]
    for j in range(v.shape[1]):
        i = int(np.argmax(np.round(np.abs(v[:, j]), 12)))  # ties: first entry
        if v[i, j] < 0:
            v[:, j] = -v[:, j]
    return w / np.trace(r), v, w
