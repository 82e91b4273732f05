"""Two tiers, of which the project's rows win, and the type hierarchy over both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtab.scratch import bucketed, discard, forget


def overlay(project: DataFrame, dependency: DataFrame, on: str = "sym") -> DataFrame:
    """Both tiers; where an id is in both, the project's row."""
    return project.unionByName(dependency.join(project.select(on).distinct(), on, "left_anti"))


def subtypes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct direct children of each asked ``parent``. ``edges`` is the union of both tiers' (parent, child)."""
    return edges.join(ids, "parent").select(*ids.columns, "child").distinct()


def supertypes(symbols: DataFrame, ids: DataFrame, on: str = "sym", parents: str = "parents") -> DataFrame:
    """(id, pos, parent) of the winning rows, in order; not transitive. ``symbols`` is an overlay."""
    return symbols.join(ids, on).select(*ids.columns, F.posexplode(parents).alias("pos", "parent"))


#: Tables of visited pairs that are kept apart before they are made one.
ROUNDS_APART = 8


def one_round(frontier: DataFrame, edges: DataFrame, visited: list[DataFrame], buckets: int) -> DataFrame:
    """(start, child) that the frontier (start, at) reaches by one edge and that were not visited.

    Edges lie in buckets by parent, visited pairs in buckets by (start, child): neither is shuffled, only the frontier is, to
    the edges, and what it finds, to the visited pairs; there it is made distinct and can be written into the next buckets.
    """
    reached = frontier.join(edges, frontier["at"] == edges["parent"]).select("start", "child")
    found = reached.repartition(buckets, "start", "child").dropDuplicates(["start", "child"])
    for table in visited:
        found = found.join(table.select("start", "child"), ["start", "child"], "left_anti")
    return found


def transitive_subtypes(edges: DataFrame, ids: DataFrame, max_depth: int = 10, buckets: int | None = None) -> DataFrame:
    """(start, child, depth): breadth-first closure of each start, bounded in depth; each child once, at its least depth.

    A start is not visited at the outset, so a cycle that leads back puts it into its own result. Each round goes on from what
    the last one found alone; rounds end when that is nothing. Edges are dealt into ``buckets`` (by default as many as the
    session's shuffles have partitions) once, and what a round finds once; null ids are no nodes.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select("parent", "child").filter("parent is not null and child is not null").repartition(buckets, "parent").dropDuplicates(["parent", "child"])
    dealt = bucketed(dealt, "closure-edges", buckets, "parent")
    frontier = ids.select(F.col("parent").alias("start")).filter("start is not null").distinct().withColumn("at", F.col("start"))
    visited: list[DataFrame] = []
    try:
        for depth in range(1, max_depth + 1):
            found = one_round(frontier, dealt, visited, buckets).withColumn("depth", F.lit(depth))
            found = bucketed(found, "closure", buckets, "start", "child")
            visited.append(found)
            if found.isEmpty():
                break
            frontier = found.select("start", F.col("child").alias("at"))
            if len(visited) > ROUNDS_APART:
                together = reduce(DataFrame.unionByName, visited).repartition(buckets, "start", "child")
                whole = bucketed(together, "closure", buckets, "start", "child")
                frontier = whole.filter(F.col("depth") == depth).select("start", F.col("child").alias("at"))
                discard(*map(forget, visited))
                visited = [whole]
        return reduce(DataFrame.unionByName, map(forget, visited))
    finally:
        forget(dealt)


def implementations(symbols: DataFrame, edges: DataFrame, ids: DataFrame, max_depth: int = 10, on: str = "sym", kinds: tuple[str, ...] = ("Class", "Object", "Enum", "EnumCase")) -> DataFrame:
    """Transitive subtypes that have a row in the overlay and are concrete."""
    closure = transitive_subtypes(edges, ids, max_depth)
    concrete = symbols.filter(F.col("kind").isin(*kinds))
    return closure.join(concrete, closure["child"] == concrete[on]).select("start", concrete[on], "name", "kind", "depth")


def structural_references(symbols: DataFrame, sym: str = "sym", parents: str = "parents", overrides: str = "overrides", location: str = "location") -> DataFrame:
    """(sym, location, kind): an Extends use of each parent and an Override use of each overridden member, where the declaration has a location."""
    placed = symbols.filter(F.col(location).isNotNull())
    extends = placed.select(F.explode(parents).alias(sym), F.col(location).alias("location"), F.lit("Extends").alias("kind"))
    return extends.unionByName(placed.select(F.explode(overrides).alias(sym), F.col(location).alias("location"), F.lit("Override").alias("kind")))
