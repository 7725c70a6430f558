"""One object for the tables of a road graph, with the questions asked of it as methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import broker, construct, geocode, isochrone, matching, matrix, nearest, paths, search, trip
from .sources import osm

#: What a matrix may take in memory where nobody says.
DEFAULT_BUDGET = 500 << 20


@dataclass
class Router:
    """nodes(node, lat, lon) and edges(src, dst, dur, dist) make a router; street_nodes(street, node) and addresses a geocoder; both may be there."""

    spark: SparkSession
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    street_nodes: DataFrame | None = None
    addresses: DataFrame | None = None

    @classmethod
    def build(cls, spark: SparkSession, extracts: list[str], folder: str, profile: str = "car", force: bool = False) -> Router:
        """From OpenStreetMap extracts; tables are kept below folder."""
        t = osm.built(spark, extracts, folder, profile, force=force)
        edges = t["edges"].select("src", "dst", F.round("dur_s").cast("bigint").alias("dur"), F.round("dist_m").cast("bigint").alias("dist"))
        return cls(spark, t["nodes"].select("node", "lat", "lon"), edges, t["names"].select("street", "node"), t["addresses"])

    @property
    def has_graph(self) -> bool:
        return self.edges is not None and self.nodes is not None

    @property
    def has_names(self) -> bool:
        return self.street_nodes is not None

    @property
    def has_addresses(self) -> bool:
        return self.addresses is not None

    def streets(self) -> DataFrame:
        """Streets with an id: the hash of the name, so that no task numbers all of them."""
        return self.street_nodes.select("street").distinct().withColumn("name_id", F.xxhash64("street"))

    def main_nodes(self) -> DataFrame:
        """Nodes of the largest linked part, to which places snap."""
        return self.nodes.join(paths.largest_component(paths.components(self.edges)).select("node"), "node", "left_semi")

    def snap(self, points: DataFrame, k: int = 1) -> DataFrame:
        return nearest.nearest(points, self.main_nodes().select(F.col("node").alias("site"), "lat", "lon"), k)

    def route(self, trips: DataFrame) -> DataFrame:
        return paths.snapped_route(trips, self.main_nodes(), self.edges)

    def alternatives(self, pairs: DataFrame, **options) -> DataFrame:
        return paths.alternatives(self.edges, pairs, **options)

    def table(self, sources: DataFrame, targets: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        return paths.matrix(self.edges, sources, targets, limit)

    def table_blocks(self, sources: DataFrame, budget_bytes: int | None = None):
        """The matrix block by block within a budget (spark.roadspark.matrixBudgetBytes where none is given)."""
        budget = budget_bytes or int(self.spark.conf.get("spark.roadspark.matrixBudgetBytes", str(DEFAULT_BUDGET)))
        return paths.matrix_blocks(self.edges, sources, budget)

    def nearest_customers(self, customers: DataFrame, k: int) -> DataFrame:
        return paths.nearest_customers(self.edges, customers, k)

    def isochrone(self, sources: DataFrame, seconds: list[int], size: float = 0.005) -> DataFrame:
        return isochrone.rings(isochrone.reached_cells(self.edges, self.nodes, sources, seconds, size), size)

    def match(self, pings: DataFrame, k: int = 8, sigma: float = 15.0) -> DataFrame:
        return matching.matched(pings, self.nodes, self.edges, k, sigma)

    def trip(self, cells: DataFrame, closed: bool = True) -> DataFrame:
        return trip.trips(cells, closed)

    def geocode(self, queries: DataFrame) -> DataFrame:
        return geocode.locate_street(self.streets(), self.street_nodes, self.nodes, queries)

    def geocode_address(self, queries: DataFrame) -> DataFrame:
        return geocode.address_forward(self.addresses, queries)

    def reverse(self, points: DataFrame) -> DataFrame:
        """The nearest address where there are addresses, else the nearest street."""
        return geocode.address_reverse(points, self.addresses) if self.has_addresses else geocode.street_reverse(points, self.street_nodes, self.nodes)

    def intersection(self, a: str, b: str, **near) -> DataFrame:
        return geocode.crossing(self.street_nodes, self.nodes, a, b, **near)

    def suggest(self, text: str, limit: int = 10) -> DataFrame:
        return geocode.suggest(self.streets(), text, limit)

    def street_segments(self) -> DataFrame:
        return geocode.street_geometry(self.edges, self.street_nodes)

    def bbox(self) -> DataFrame:
        return geocode.bounding_box(self.nodes)


@dataclass(frozen=True)
class Settings:
    """How plans are searched."""

    capacity: float
    vehicles: int
    seeds: int = 3
    kicks: int = 10
    steps: int = 50
    #: Problems are cut into clusters of about so many stops; None searches them whole.
    cluster: int | None = None
    #: Breeding on so many islands instead of restarts; None does not breed.
    islands: int | None = None
    rounds: int = 2


def solve(problems: DataFrame, settings: Settings) -> DataFrame:
    """problem, cost, unserved and routes of the best plan found for each of problems(problem, i, x, y, demand, ready, due, service)."""
    s = settings
    if s.cluster is not None:
        found = construct.decomposed(problems, s.cluster, s.capacity, s.vehicles, s.kicks, s.steps)
    elif s.islands is not None:
        found = construct.islands(problems, s.islands, s.rounds, s.capacity, s.vehicles)
    else:
        found = search.multi_start(problems, s.seeds, s.capacity, s.vehicles, s.kicks, s.steps)
    return found.select("problem", "cost", "unserved", "routes")


def broker_matrix(prior: DataFrame, source: DataFrame, landmarks: DataFrame, depots: DataFrame, known: DataFrame | None = None, policy: broker.Policy = broker.Policy()) -> tuple[DataFrame, DataFrame]:
    return broker.matrix(prior, source, landmarks, depots, known, policy)


def validate(cells: DataFrame) -> DataFrame:
    return matrix.validation(cells)
