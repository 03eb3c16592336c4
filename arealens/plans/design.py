"""Design matrices as named column expressions.

A model term is ``(name, Column)``; the matrix is never materialised as a
vector column unless MLlib needs one.  Categoricals are treatment-coded with
the alphabetically first level as the base (``C(g)[T.level]``) and
``cat:num`` interactions get one column per non-base level when the main
effect is in the model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DesignTerm:
    name: str
    expr: Column


def levels(df: DataFrame, cols) -> dict:
    """Sorted distinct non-null levels of each categorical, in one job.

    The columns are stacked as (column index, level) and de-duplicated (partial
    aggregation, so a level holding most rows costs one row per partition).  A
    dense design has a term for each level, so its levels are as many as its
    k x k normal equations allow."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(c).cast("string").alias("l"))
                      for i, c in enumerate(cols)])
    rows = (df.select(F.explode(pairs).alias("p")).select("p.ci", "p.l").where(F.col("l").isNotNull())
            .distinct().collect())
    out = {c: [] for c in cols}
    for r in rows:
        out[cols[r["ci"]]].append(r["l"])
    return {c: sorted(v) for c, v in out.items()}


def build_design(numeric=(), categorical=(), interactions=(), level_map: dict | None = None,
                 intercept: bool = True, intercept_name: str = "Intercept"):
    """Terms in formula order: intercept, categorical mains, numerics, interactions.

    ``interactions``: (categorical, numeric) pairs; ``level_map``: {cat: levels}."""
    level_map = level_map or {}
    terms = []
    if intercept:
        terms.append(DesignTerm(intercept_name, F.lit(1.0)))
    for c in categorical:
        for lv in level_map[c][1:]:
            terms.append(DesignTerm(f"C({c})[T.{lv}]", (F.col(c) == F.lit(lv)).cast("double")))
    for c in numeric:
        terms.append(DesignTerm(c, F.col(f"`{c}`").cast("double")))
    for cat, x in interactions:
        lv = level_map[cat]
        reduced = cat in categorical
        use = lv[1:] if reduced else lv
        for level in use:
            terms.append(DesignTerm(f"C({cat})[T.{level}]:{x}" if reduced else f"C({cat})[{level}]:{x}",
                                    (F.col(cat) == F.lit(level)).cast("double") * F.col(f"`{x}`").cast("double")))
    return terms


def constant_design(numeric, name: str = "const"):
    """Explicit constant first, then the numeric columns (no categoricals)."""
    return [DesignTerm(name, F.lit(1.0))] + [DesignTerm(c, F.col(f"`{c}`").cast("double")) for c in numeric]
