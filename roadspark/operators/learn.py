"""Problem embeddings, their neighbours, and regressions of settings on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MST_SAMPLE = 200
LEAST_ROWS = 28


def moments(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population deviation, maximum and population skewness (0 where nothing varies)."""
    dev = F.stddev_pop(value)
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), dev.alias("std"), F.max(value).alias("max"), F.when(dev <= 1e-9, 0.0).otherwise(F.skewness(value)).alias("skew"))


def anisotropy(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """The ratio of the covariance's eigenvalues: 1 for round clouds, more for long ones."""
    c = points.groupBy(by).agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("d"), F.covar_pop(x, y).alias("b"))
    half, root = (F.col("a") + F.col("d")) / 2, F.sqrt(F.pow((F.col("a") - F.col("d")) / 2, 2) + F.col("b") * F.col("b"))
    return c.select(by, ((half + root) / F.greatest(half - root, F.lit(1e-12))).alias("anisotropy"))


def asymmetry(cells: DataFrame) -> DataFrame:
    """The summed gap of the two ways over their sum."""
    back = cells.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("dur").alias("back"))
    return cells.where("i < j").join(back, ["i", "j"]).agg((F.sum(F.abs(F.col("dur") - F.col("back"))) / F.sum(F.col("dur") + F.col("back"))).alias("asymmetry"))


def utilisation(demand: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Summed demand over summed capacity, the demand's coefficient of variation, and the share of tight windows."""
    d = demand.agg(F.sum("demand").alias("d"), (F.stddev_pop("demand") / F.avg("demand")).alias("demand_cv"), F.avg((F.col("due") - F.col("ready") < 7200).cast("double")).alias("tight"))
    return d.join(vehicles.agg(F.sum("capacity").alias("c")), how="cross").select((F.col("d") / F.col("c")).alias("utilisation"), "demand_cv", "tight")


def tree_kurtosis(points: DataFrame, by: str) -> DataFrame:
    """Excess kurtosis of the edges of a minimum spanning tree over MST_SAMPLE points at most, evenly strided by id before they meet."""
    order = Window.partitionBy(by).orderBy("id")
    sizes = points.groupBy(by).agg(F.ceil(F.count("*") / MST_SAMPLE).alias("stride"))
    points = points.select(by, "id", "x", "y", (F.row_number().over(order) - 1).alias("place")).join(sizes, by).where("place % stride = 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf.sort_values("id")[["x", "y"]].to_numpy()
        far, left, edges = np.full(len(xy), np.inf), np.ones(len(xy), bool), []
        at = 0
        left[0] = False
        for _ in range(len(xy) - 1):
            far = np.minimum(far, np.sqrt(((xy - xy[at]) ** 2).sum(axis=1)))
            at = int(np.where(left, far, np.inf).argmin())
            edges.append(far[at])
            left[at] = False
        e = np.array(edges)
        dev = e - e.mean() if len(e) else e
        var = float((dev**2).mean()) if len(e) else 0.0
        return pd.DataFrame({by: [pdf[by].iloc[0]], "edges": [len(e)], "kurtosis": [float((dev**4).mean() / var**2 - 3) if var > 1e-18 else 0.0]})

    return points.select(by, "id", "x", "y").groupBy(by).applyInPandas(run, f"{by} long, edges long, kurtosis double")


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores by population moments; constant ones become 0."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    out = rows.join(F.broadcast(stats), how="cross")
    return out.select(*[c for c in rows.columns if c not in columns], *[F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in columns])


def neighbours(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows of vectors(id, vector) nearest to one query by squared distance, ties to the smaller id."""
    q = F.array(*map(F.lit, map(float, query)))
    d = F.aggregate(F.zip_with(F.col("vector"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("id", d.alias("distance")).orderBy("distance", "id").limit(k)


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value in the middle of each group, the upper of two; by a sort that spills, not in memory."""
    order = Window.partitionBy(by).orderBy(value)
    sizes = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    ranked = rows.where(F.col(value).isNotNull()).select(by, value, F.row_number().over(order).alias("k")).join(sizes, by)
    return ranked.where(F.expr("k = n div 2 + 1")).select(by, F.col(value).alias("median"))


def weighted_regression(rows: DataFrame, features: list[str], target: str, weight: str, ridge: float = 1e-6) -> np.ndarray | None:
    """Weighted least squares through the normal equations; None below LEAST_ROWS rows. Spark sums the products."""
    names = ["1", *features]
    col = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    w = F.col(weight)
    parts = [F.sum(w * col(a) * col(b)) for i, a in enumerate(names) for b in names[i:]] + [F.sum(w * col(a) * F.col(target)) for a in names] + [F.count("*")]
    got = rows.agg(*parts).head()
    if got[-1] < LEAST_ROWS:
        return None
    n = len(names)
    a, k = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = got[k]
            k += 1
    factor = np.linalg.cholesky(a + ridge * np.eye(n))
    return np.linalg.solve(factor.T, np.linalg.solve(factor, np.array(got[k : k + n], float)))


def fingerprint(rows: DataFrame, columns: list[str], scale: str) -> DataFrame:
    """A hash of a problem that does not change when its lengths are scaled: columns over the mean of scale, to 4 digits, in any order."""
    mean = rows.agg(F.avg(F.abs(scale)).alias("mean"))
    parts = rows.join(F.broadcast(mean), how="cross").select(F.xxhash64(*[F.round(F.col(c) / F.col("mean"), 4) for c in columns]).alias("h"))
    return parts.agg(F.bit_xor("h").alias("fingerprint"), F.count("*").alias("n"))
