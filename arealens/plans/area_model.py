"""Area-level model (one row per postal area) and the predictor audit.

Both read an area table with a median-price target and landmark distances.
Everything is a Spark job over that table; only k x k statistics (k <= a few
dozen predictors) and per-fold sufficient statistics come to the driver.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import features as FT
from ..operators import selection as SEL
from ..operators.area import AREA_ALIASES
from ..operators.ordering import kfold_blocks, running_sums
from ..operators.quantiles import medians
from ..sources.tables import rename_aliases, require_columns, strip_header
from . import linear as L
from .design import constant_design
from .moments import correlation_from_gram, gram_stats, high_pairs, vif_table
from .preprocess import kfold

# ---------------------------------------------------------------------------
# Fixed values as the reference defines them.
# ---------------------------------------------------------------------------
TARGET = "Median_Price_June"
LOG_TARGET = "log_median_price_june"
BASE_PREDICTORS = [
    "log_population", "log_part_1_crime_count", "crime_per_10k", "Count_Educational_Facility",
    "Count_Public_Safety", "Count_Fire_Stations", "Count_Police_Stations", "Count_Corrective_Facility",
]
AUDIT_BASE = [
    "log_population", "log_part_1_crime_count", "crime_per_10k", "crime_z", "Count_Educational_Facility",
    "education_facilities_z", "Count_Public_Safety", "public_safety_z", "Count_Fire_Stations",
    "Count_Police_Stations", "Count_Corrective_Facility", "external_amenities_index",
    "avg_landmark_distance_z", "centrality_index",
]
HIGH_CORR_THRESHOLD = 0.8
N_SPLITS = 5


def _typed(raw: DataFrame) -> DataFrame:
    df = rename_aliases(strip_header(raw), AREA_ALIASES)
    df = df.withColumn("ZIP_CODE", S.standardize_zip(F.col("ZIP_CODE"), df.schema["ZIP_CODE"].dataType))
    return df.withColumns({c: S.safe_numeric(F.col(f"`{c}`"), df.schema[c].dataType)
                           for c in df.columns if c != "ZIP_CODE"})


def load_area_target(raw: DataFrame):
    """Typed, target-filtered area table with engineered columns.

    Returns (df, distance_cols, warning)."""
    df = _typed(raw)
    require_columns(df, [TARGET], "area target")
    df = df.where(F.col("ZIP_CODE").isNotNull() & F.col(TARGET).isNotNull())
    df = df.where(S.open_range(F.col(TARGET), 0, 5000)).withColumn(LOG_TARGET, F.log(TARGET))
    df, warning, _ = SEL.duplicate_guard(df, "Count_Fire_Stations", "Count_Police_Stations")
    new = {}
    if "Population" in df.columns:
        new["log_population"] = S.log1p_clipped("Population")
    if "Part_1_Crime_Count" in df.columns:
        new["log_part_1_crime_count"] = S.log1p_clipped("Part_1_Crime_Count")
    if "Part_1_Crime_Per_Capita" in df.columns:
        new["crime_per_10k"] = S.per_10k(F.col("Part_1_Crime_Per_Capita"))
    df = df.withColumns(new)
    dist = SEL.name_group(df.columns, exclude_substr=("Sept",), exclude=("ZIP_CODE",))
    if dist:
        st = FT.moments(df, dist)
        zs = [FT.zscore_expr(c, *st[c], guard=False) for c in dist]
        df = df.withColumn("centrality_index", -FT.composite_skip_null(zs))
    return df, dist, warning


PCA_COMPONENTS = 3


def with_distance_scores(df: DataFrame, dist, n_components: int = PCA_COMPONENTS):
    """Principal components of the standardised, median-filled distances.

    Returns (df with distance_pc1.., explained variance ratios, loadings)."""
    med = medians(df, dist)
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(med[c])) for c in dist if med.get(c) is not None}
    cols = list(filled)
    n, mu, g = gram_stats(df.select(*[e.alias(c) for c, e in filled.items()]), cols)
    sd = np.sqrt(np.diag(g) / n)
    ratio, vec, _ = L.pca_from_corr(correlation_from_gram(g), min(n_components, len(cols)))
    scores = {}
    for j in range(vec.shape[1]):
        s = F.lit(0.0)
        for i, c in enumerate(cols):
            s = s + (filled[c] - F.lit(float(mu[i]))) / F.lit(float(sd[i])) * F.lit(float(vec[i, j]))
        scores[f"distance_pc{j + 1}"] = s
    return df.withColumns(scores), ratio, vec


def predictors(df: DataFrame, dist, strategy: str = "all_distances"):
    """Predictor list of a strategy: ``all_distances``, ``centrality_only`` or ``pca``
    (the last needs ``with_distance_scores`` first)."""
    scores = [c for c in df.columns if c.startswith("distance_pc")]
    return SEL.assemble_predictors(df.columns, BASE_PREDICTORS, strategy, dist, scores,
                                   exclude=(TARGET, LOG_TARGET, "ZIP_CODE"))


def prepare(df: DataFrame, preds):
    """Complete-case rows without all-null and constant predictors; on complete
    rows a median fill has nothing left to fill."""
    m = df.select("ZIP_CODE", TARGET, LOG_TARGET, *[F.col(f"`{c}`") for c in preds]).dropna()
    kept, _, _ = SEL.drop_all_null_and_constant(m, preds)
    return m.select("ZIP_CODE", TARGET, LOG_TARGET, *[F.col(f"`{c}`") for c in kept]), kept


def run_ols(m: DataFrame, kept):
    terms = constant_design(kept)
    return L.fit_ols(m, terms, LOG_TARGET)


def ridge_cv(m: DataFrame, kept, alphas=L.RIDGE_ALPHAS, k: int = N_SPLITS, seed: int = 42):
    """Outer shuffled k-fold; inside each training set an unshuffled k-fold in
    key order picks alpha; the final model refits on all rows.

    One grouped aggregate gives sufficient statistics for every (outer fold,
    inner fold) cell and for every outer fold; all fits are k x k solves."""
    m, shift = L.centred(m, [*kept, LOG_TARGET])
    m = m.persist(StorageLevel.MEMORY_AND_DISK)  # one row for each area; folds, positions and sums are passes over it
    folded, n = kfold(m, "ZIP_CODE", k, seed, "ofold")
    ind = {f"c{f}": (F.col("ofold") == f).cast("bigint") for f in range(k)}
    ind["gpos1"] = F.lit(1).cast("bigint")
    rs = running_sums(folded, ["ZIP_CODE"], ind)
    sizes = {r["ofold"]: r["count"] for r in folded.groupBy("ofold").count().collect()}
    gpos = F.col("gpos1") - 1
    cells = []
    for o in range(k):
        pos_o = gpos - F.col(f"c{o}")
        inner = kfold_blocks(pos_o, n - sizes.get(o, 0), k)
        cells.append(F.when(F.col("ofold") != o, F.struct(F.lit(o).alias("o"), inner.alias("i"))))
    cells.append(F.struct(F.lit(-1).alias("o"), kfold_blocks(gpos, n, k).alias("i")))
    ex = rs.select(*[F.col(f"`{c}`") for c in kept], LOG_TARGET, "ofold",
                   F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("cell"))
    ex = ex.select("*", "cell.o", "cell.i")
    stats = L.grouped_suff(ex, kept, LOG_TARGET, ["o", "i"])
    m.unpersist()
    total = reduce(add, [s for (o, _), s in stats.items() if o == -1])

    def choose(train_cells, mu, sd):
        train_all = reduce(add, list(train_cells.values()))
        best, best_score = None, -math.inf
        for a in alphas:
            scores = []
            for i, v in train_cells.items():
                ag, g, _ = L.ridge_fit(train_all - v, a, mu, sd)
                scores.append(L.r2_on(v, ag, g))
            sc = float(np.mean(scores))
            if sc > best_score:
                best, best_score = a, sc
        return best

    outer_scores = []
    for o in range(k):
        tcells = {i: s for (oo, i), s in stats.items() if oo == o}
        if not tcells:
            continue
        train = reduce(add, list(tcells.values()))
        test = total - train
        mu, sd = L.scaler_from(train)
        a = choose(tcells, mu, sd)
        ag, g, _ = L.ridge_fit(train, a, mu, sd)
        outer_scores.append(L.r2_on(test, ag, g))
    full_cells = {i: s for (oo, i), s in stats.items() if oo == -1}
    mu, sd = L.scaler_from(total)
    alpha = choose(full_cells, mu, sd)
    a0, g, beta = L.ridge_fit(total, alpha, mu, sd)
    pred = F.lit(float(a0) + shift[LOG_TARGET])
    for c, gi in zip(kept, g):
        pred = pred + (F.col(f"`{c}`") - F.lit(shift[c])) * F.lit(float(gi))
    metrics = {
        "ridge_cv_r2_log_mean": float(np.mean(outer_scores)),
        "ridge_cv_r2_log_std": float(np.std(outer_scores)),
        "ridge_chosen_alpha": float(alpha),
        "ridge_full_fit_r2_log": L.r2_on(total, a0, g),
    }
    coefs = sorted(zip(kept, map(float, beta)), key=lambda t: (-abs(t[1]), t[0]))
    return metrics, coefs, pred


# ---------------------------------------------------------------------------
# Predictor audit
# ---------------------------------------------------------------------------
def audit_features(raw: DataFrame) -> DataFrame:
    df = _typed(raw)
    df = df.where(F.col(TARGET).isNotNull() & S.open_range(F.col(TARGET), 0, 5000))
    new = {}
    if "Population" in df.columns:
        new["log_population"] = S.log1p_clipped("Population")
    if "Part_1_Crime_Count" in df.columns:
        new["log_part_1_crime_count"] = S.log1p_clipped("Part_1_Crime_Count")
    if "Part_1_Crime_Per_Capita" in df.columns:
        new["crime_per_10k"] = S.per_10k(F.col("Part_1_Crime_Per_Capita"))
    df = df.withColumns(new)
    zspec = {}
    if "Part_1_Crime_Per_Capita" in df.columns:
        zspec["crime_z"] = "Part_1_Crime_Per_Capita"
    if "Count_Educational_Facility" in df.columns:
        zspec["education_facilities_z"] = "Count_Educational_Facility"
    if "Count_Public_Safety" in df.columns:
        zspec["public_safety_z"] = "Count_Public_Safety"
    parts = SEL.existing(df, ["Count_Educational_Facility", "Count_Public_Safety", "Count_Fire_Stations",
                              "Count_Police_Stations"])
    for c in parts:
        zspec[f"__p_{c}"] = c
    dist = SEL.name_group(df.columns, exclude_substr=("Sept",), exclude=("ZIP_CODE",))
    for c in dist:
        zspec[f"__d_{c}"] = c
    df = FT.with_zscores(df, zspec)
    if parts:
        df = df.withColumn("external_amenities_index", FT.composite_strict([F.col(f"__p_{c}") for c in parts]))
    if dist:
        df = df.withColumn("avg_landmark_distance_z", FT.composite_strict([F.col(f"`__d_{c}`") for c in dist]))
        df = df.withColumn("centrality_index", -F.col("avg_landmark_distance_z"))
    return df.drop(*[k for k in zspec if k.startswith("__")])


def audit(spark, raw: DataFrame, threshold: float = HIGH_CORR_THRESHOLD):
    """(correlation long table, high pairs, VIF table, summary, predictors)."""
    df = audit_features(raw)
    dist = SEL.name_group(df.columns, exclude_substr=("Sept",), exclude=("ZIP_CODE",))
    cand = list(dict.fromkeys(AUDIT_BASE + dist))
    avail = SEL.existing(df, cand)
    x = df.select(*[F.col(f"`{c}`") for c in avail])
    kept, all_null, constant = SEL.drop_all_null_and_constant(x, avail)
    med = medians(x, kept)
    x = x.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(med[c])).alias(c) for c in kept])
    n, _, g = gram_stats(x, kept)
    r = correlation_from_gram(g)
    from .moments import correlation_long
    corr = correlation_long(spark, kept, r)
    pairs = high_pairs(spark, kept, r, threshold)
    vif = vif_table(spark, kept, r)
    return corr, pairs, vif, {"rows": n, "predictors": len(kept), "dropped_all_null": len(all_null),
                              "dropped_constant": len(constant)}, kept
