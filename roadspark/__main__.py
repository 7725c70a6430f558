"""Command line: python -m roadspark VERB ..., each a thin call of the library."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Router, Settings, solve, validate
from .sources import files, more


def tables(spark: SparkSession, folder: str) -> Router:
    """A router of the tables that `build` has kept."""
    edges = spark.read.parquet(f"{folder}/edges").select("src", "dst", F.round("dur_s").cast("bigint").alias("dur"), F.round("dist_m").cast("bigint").alias("dist"))
    return Router(spark, spark.read.parquet(f"{folder}/nodes").select("node", "lat", "lon"), edges, spark.read.parquet(f"{folder}/names").select("street", "node"), spark.read.parquet(f"{folder}/addresses"))


def shown(df: DataFrame, most: int = 1000) -> None:
    """Rows as JSON lines, `most` of them at most."""
    for row in df.limit(most).toJSON().collect():
        print(row)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="roadspark")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options) -> argparse.ArgumentParser:
        one = verbs.add_parser(name)
        for a in args:
            one.add_argument(a)
        for k, v in options.items():
            one.add_argument(f"--{k}", type=type(v), default=v)
        return one

    verb("build", "extract", "folder", profile="car", force=0)
    verb("gen", "path", lat=59.9, lon=10.7, radius=5.0, jobs=100, seed=0)
    verb("route", "folder", "lat1", "lon1", "lat2", "lon2")
    verb("reverse", "folder", "lat", "lon")
    verb("geocode", "folder", "query")
    verb("crossing", "folder", "a", "b")
    verb("solve", "benchmark", capacity=200.0, vehicles=25, seeds=3, kicks=10, cluster=0, islands=0)
    for name in ("compress", "validate", "decompress", "roundtrip"):
        verb(name, "cells", "path")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("roadspark").getOrCreate()
    point = lambda name, lat, lon: spark.createDataFrame([(0, float(lat), float(lon))], f"{name} bigint, lat double, lon double")
    if a.verb == "build":
        router = Router.build(spark, [a.extract], a.folder, a.profile, bool(a.force))
        print(json.dumps({"edges": router.edges.count()}))
    elif a.verb == "gen":
        files.generated_jobs(spark, a.lat, a.lon, a.radius, a.jobs, a.seed).write.mode("overwrite").json(a.path)
    elif a.verb == "route":
        trips = spark.createDataFrame([(0, *map(float, (a.lat1, a.lon1, a.lat2, a.lon2)))], "trip bigint, lat1 double, lon1 double, lat2 double, lon2 double")
        shown(tables(spark, a.folder).route(trips))
    elif a.verb == "reverse":
        shown(tables(spark, a.folder).reverse(point("point", a.lat, a.lon)))
    elif a.verb == "geocode":
        shown(tables(spark, a.folder).geocode(spark.createDataFrame([(a.query,)], "query string")))
    elif a.verb == "crossing":
        shown(tables(spark, a.folder).intersection(a.a, a.b))
    elif a.verb == "solve":
        rows = files.solomon(spark, a.benchmark).select(F.lit(0).cast("bigint").alias("problem"), "*")
        shown(solve(rows, Settings(a.capacity, a.vehicles, a.seeds, a.kicks, cluster=a.cluster or None, islands=a.islands or None)))
    elif a.verb == "compress":
        shown(more.archive(spark.read.parquet(a.cells), a.path))
    elif a.verb == "decompress":
        more.unarchived(spark, a.path).write.mode("overwrite").parquet(a.cells)
    elif a.verb == "validate":
        shown(validate(spark.read.parquet(a.cells)))
    else:
        cells = spark.read.parquet(a.cells).select("block", "i", "j", "dur")
        more.archive(cells, a.path)
        back = more.unarchived(spark, a.path)
        print(json.dumps({"equal": cells.exceptAll(back).isEmpty() and back.exceptAll(cells).isEmpty()}))


if __name__ == "__main__":
    main()
