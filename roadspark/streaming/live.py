"""The live delay layer: reports to factors, decayed averages by edge, snapshots.

An edge's state is (factor, updated_ms); a report moves it to half the decayed old factor and half its own.
Times come with the reports, so a replay gives the same answers. Reports of one edge are taken in order of time
within a micro-batch; idle edges time out after TTL_HALF_LIVES half-lives, when they are back at 1 in effect.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.geo import decayed

HALF_LIFE_MS = 600_000
TTL_HALF_LIVES = 10
#: Bounds of a stretch's factor, and of what is applied.
STRETCH, APPLIED = (0.33, 5.0), (0.33, 8.0)
STATE = "factor double, updated_ms long"
OUT = "src long, dst long, factor double, updated_ms long"


def parsed(lines: DataFrame) -> DataFrame:
    """report(report_id, body) with body `lon,lat,t;lon,lat,t;...` as pings; parts that are no triple are passed over, reports of fewer than two are dropped."""
    parts = lines.select("report_id", F.posexplode(F.split("body", ";")).alias("seq", "part")).withColumn("x", F.split("part", ","))
    num = lambda k: F.try_element_at("x", F.lit(k)).try_cast("double")
    rows = parts.select("report_id", F.col("seq").cast("bigint").alias("seq"), num(1).alias("lon"), num(2).alias("lat"), num(3).alias("t"), F.size("x").alias("n")).where("n = 3 AND lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL")
    good = rows.groupBy("report_id").count().where("count >= 2").select("report_id")
    return rows.drop("n").join(good, "report_id", "left_semi")


def stretches(pairs: DataFrame) -> DataFrame:
    """Factors of stretches (src, dst, t0, t1, base_s): observed over base time, within bounds; what cannot be told is dropped."""
    seen = F.col("t1") - F.col("t0")
    rows = pairs.where((seen > 0.5) & (F.col("base_s") > 0.5) & (F.col("src") != F.col("dst")))
    return rows.select("src", "dst", F.greatest(F.least(seen / F.col("base_s"), F.lit(STRETCH[1])), F.lit(STRETCH[0])).alias("factor"), (F.col("t1") * 1000).cast("bigint").alias("ms"))


def fold(old: tuple[float, int] | None, reports: list[tuple[int, float]]) -> tuple[float, int]:
    """An edge's state after reports in order of time."""
    factor, at = old if old else (1.0, reports[0][0])
    for ms, seen in sorted(reports):
        factor = 0.5 * (1 + (factor - 1) * 0.5 ** (max(0, ms - at) / HALF_LIFE_MS)) + 0.5 * seen
        at = max(at, ms)
    return factor, at


def averaged(stream: DataFrame, expire: bool = True) -> DataFrame:
    """The stateful stream of factors by edge, from reports(src, dst, factor, ms).

    Idle edges expire by the clock, for which the query keeps running batches; a run over what is there at its
    start (trigger availableNow) ends only with expire=False.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        reports = [(int(m), float(f)) for pdf in frames for m, f in zip(pdf["ms"], pdf["factor"])]
        new = fold(tuple(state.get) if state.exists else None, reports)
        state.update(new)
        if expire:
            state.setTimeoutDuration(HALF_LIFE_MS * TTL_HALF_LIVES)
        yield pd.DataFrame([(*key, *new)], columns=["src", "dst", "factor", "updated_ms"])

    return stream.groupBy("src", "dst").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


#: Halvings after which a double is 0.
VANISHED = 1075


def replayed(reports: DataFrame) -> DataFrame:
    """The same fold over a batch, in closed form: factor - 1 is the sum over an edge's reports of (seen - 1), halved for the report itself and each later one and once more for each half-life until the last.

    Of an edge's reports those before the last VANISHED add 0 in doubles; they are left out by a limit on ranks,
    so that an edge of very many reports is cut down before it meets in one task.
    """
    last = Window.partitionBy("src", "dst").orderBy(F.col("ms").desc(), F.col("factor").desc())
    rows = reports.select("src", "dst", "ms", "factor").withColumn("k", F.row_number().over(last)).where(F.col("k") <= VANISHED)
    ends = rows.groupBy("src", "dst").agg(F.max("ms").alias("updated_ms"))
    part = (F.col("factor") - 1) * F.pow(F.lit(0.5), F.col("k") + (F.col("updated_ms") - F.col("ms")) / HALF_LIFE_MS)
    return rows.join(ends, ["src", "dst"]).groupBy("src", "dst", "updated_ms").agg((F.sum(part) + 1).alias("factor")).select("src", "dst", "factor", "updated_ms")


def against_base(stretches: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Stretches whose base time came from a graph with delays applied, told against the undelayed base: the factor times what snapshot(src, dst, applied) had applied."""
    rows = stretches.join(snapshot.select("src", "dst", "applied"), ["src", "dst"], "left")
    factor = F.greatest(F.least(F.col("factor") * F.coalesce("applied", F.lit(1.0)), F.lit(STRETCH[1])), F.lit(STRETCH[0]))
    return rows.withColumn("factor", factor).drop("applied")


def applied(edges: DataFrame, delays: DataFrame, now_ms: int) -> DataFrame:
    """edges with their durations times the decayed factor, within bounds, where it differs from 1 by more than a hundredth."""
    rows = edges.join(delays, ["src", "dst"], "left")
    factor = F.greatest(F.least(decayed(F.col("factor"), F.lit(now_ms) - F.col("updated_ms"), HALF_LIFE_MS), F.lit(APPLIED[1])), F.lit(APPLIED[0]))
    use = F.when(F.col("factor").isNotNull() & (F.abs(factor - 1) > 0.01), factor).otherwise(1.0)  # bounds skip nulls
    return rows.select("src", "dst", (F.col("dur") * F.coalesce(use, F.lit(1.0))).alias("dur"), "dist", F.coalesce(use, F.lit(1.0)).alias("applied"))


def status(delays: DataFrame, now_ms: int) -> DataFrame:
    """Edges with a factor, the largest decayed one, how many are applied, and the last report."""
    f = decayed(F.col("factor"), F.lit(now_ms) - F.col("updated_ms"), HALF_LIFE_MS)
    return delays.agg(F.count("*").alias("edges"), F.round(F.max(f), 9).alias("max_factor"), F.count_if(F.abs(f - 1) > 0.01).alias("applied"), F.max("updated_ms").alias("last_ms"))


def snapshots(stream: DataFrame, path: str, checkpoint: str, every: str = "60 seconds"):
    """Writes each micro-batch's changed edges below path, one folder a version; the latest of an edge counts."""

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={version}")

    return averaged(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def latest(versions: DataFrame) -> DataFrame:
    """The last state of every edge."""
    return versions.groupBy("src", "dst").agg(F.max_by(F.struct("factor", "updated_ms"), "version").alias("s")).select("src", "dst", "s.factor", "s.updated_ms")
