"""Orders of stops: exact up to 13, else nearest neighbour with 2-opt and or-opt, group by group in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import spread

EXACT = 13
GAIN = 1e-6


def tour_cost(d: np.ndarray, order: list[int], closed: bool) -> float:
    legs = list(zip(order, order[1:])) + ([(order[-1], order[0])] if closed and len(order) > 1 else [])
    return float(sum(d[a, b] for a, b in legs))


def exact_order(d: np.ndarray, closed: bool) -> list[int]:
    """Dynamic programming over subsets from stop 0; an open path ends at the last stop."""
    n = len(d)
    if n <= 2:
        return list(range(n))
    inner = n - 1 if closed else n - 2
    cost = np.full((1 << inner, inner), np.inf)
    back = np.zeros((1 << inner, inner), np.int16)
    cost[1 << np.arange(inner), np.arange(inner)] = d[0, 1 : inner + 1]
    masks = np.arange(1, 1 << inner)
    sizes = sum(masks >> k & 1 for k in range(inner))
    for size in range(1, inner):
        layer = masks[sizes == size]
        for k in range(inner):
            own = layer[layer >> k & 1 == 0]
            step = cost[own] + d[1 : inner + 1, k + 1]
            last = step.argmin(axis=1)
            cost[own | 1 << k, k], back[own | 1 << k, k] = step[np.arange(len(own)), last], last
    full = (1 << inner) - 1
    end = cost[full] + (d[1 : inner + 1, 0] if closed else d[1 : inner + 1, n - 1])
    last, mask, out = int(end.argmin()), full, []
    while mask:
        out.append(last + 1)
        mask, last = mask & ~(1 << last), int(back[mask, last])
    return [0, *out[::-1], *([] if closed else [n - 1])]


def improved(d: np.ndarray, order: list[int], closed: bool) -> list[int]:
    """First improvements by reversals and moves of one to three stops, until none is left; the first stop stays, as does an open path's last."""
    n = len(order)
    stop = n if closed else n - 1
    cost, better = tour_cost(d, order, closed), True
    while better:
        better = False
        for i in range(1, stop):
            for j in range(i + 1, stop):
                new = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if (c := tour_cost(d, new, closed)) < cost - GAIN:
                    order, cost, better = new, c, True
        for size in (1, 2, 3):
            for i in range(1, stop - size + 1):
                part, rest = order[i : i + size], order[:i] + order[i + size :]
                for j in range(1, len(rest) + (1 if closed else 0)):
                    new = rest[:j] + part + rest[j:]
                    if (c := tour_cost(d, new, closed)) < cost - GAIN:
                        order, cost, better = new, c, True
                        break
    return order


def best_order(d: np.ndarray, closed: bool = True) -> list[int]:
    n = len(d)
    if n <= EXACT and np.isfinite(d).all():
        return exact_order(d, closed)
    left, order = set(range(1, n if closed else n - 1)), [0]
    while left:
        nxt = min(left, key=lambda k: (d[order[-1], k], k))
        order.append(nxt)
        left.discard(nxt)
    if not closed and n > 1:
        order.append(n - 1)
    return improved(d, order, closed) if np.isfinite(tour_cost(d, order, closed)) else order


def trips(cells: DataFrame, closed: bool = True) -> DataFrame:
    """For cells(trip, i, j, dur), i and j from 0: trip, position, stop, and the trip's total; null totals for trips that are cut apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0)
        d[pdf["i"], pdf["j"]] = pdf["dur"].astype(float)
        order = best_order(d, closed)
        total = tour_cost(d, order, closed)
        return pd.DataFrame({"trip": pdf["trip"].iloc[0], "position": range(n), "stop": order, "total": total if np.isfinite(total) else None}).astype({"total": "float64"})

    return spread(cells, "trip").groupBy("trip").applyInPandas(run, "trip long, position long, stop long, total double")


def costs(orders: DataFrame, cells: DataFrame, closed: bool = True) -> DataFrame:
    """The summed legs of orders(trip, position, stop)."""
    w = Window.partitionBy("trip").orderBy("position")
    first = F.first("stop").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    legs = orders.withColumn("to", F.coalesce(F.lead("stop").over(w), first if closed else F.lit(None).cast("bigint"))).where("to IS NOT NULL")
    legs = legs.select("trip", F.col("stop").alias("i"), F.col("to").alias("j"))
    return legs.join(cells, ["trip", "i", "j"], "left").groupBy("trip").agg(F.sum(F.when(F.col("i") == F.col("j"), 0).otherwise(F.col("dur"))).alias("total"))
