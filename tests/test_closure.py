"""Transitive subtypes: against a plain walk, and that rounds shuffle neither edges nor visited pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symtab.operators import hierarchy
from symtab.scratch import bucketed, forget


def walk(edges, starts, depth):
    out = []
    for start in starts:
        seen, level = {}, {start}
        for d in range(1, depth + 1):
            level = {c for p, c in edges if p in level and c not in seen}
            seen |= {c: d for c in level}
        out += [(start, c, d) for c, d in seen.items()]
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 3, 10, 25])
def test_like_a_plain_walk(spark, depth):
    rng = random.Random(depth)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    starts = [0, 5, 7, 100, 115, 999]
    df = spark.createDataFrame([*edges, *edges[:9], (None, 1), (2, None)], "parent long, child long")
    ids = spark.createDataFrame([(s,) for s in [*starts, 0, None]], "parent long")
    found = hierarchy.transitive_subtypes(df, ids, depth)
    assert sorted(map(tuple, found.collect())) == walk(set(edges), starts, depth)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("symtab_")]


def test_a_round_shuffles_only_what_is_new(spark):
    edges = spark.range(5000).select((F.col("id") % 700).alias("parent"), F.col("id").alias("child"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = bucketed(edges.repartition(4, "parent"), "t-edges", 4, "parent")
        pairs = edges.select(F.col("parent").alias("start"), "child", F.lit(1).alias("depth"))
        visited = [bucketed(pairs.filter(f"child % 2 = {i}").repartition(4, "start", "child"), "t-visited", 4, "start", "child") for i in (0, 1)]
        frontier = spark.range(50).select(F.col("id").alias("start"), F.col("id").alias("at"))
        found = hierarchy.one_round(frontier, dealt, visited, 4)
        assert found.count() == 0
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 2
        assert re.findall(r"\bExchange hashpartitioning\(at#", plan) and re.findall(r"\bExchange hashpartitioning\(start#\d+L?, child#", plan)
        assert plan.count("Bucketed: true") == 3
        for t in (dealt, *visited):
            forget(t)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_rounds_keep_few_tables(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "ROUNDS_APART", 2)
    edges = spark.range(40).select("id", (F.col("id") + 1).alias("child")).withColumnRenamed("id", "parent")
    found = hierarchy.transitive_subtypes(edges, edges.filter("parent in (0, 30)").select("parent"), 20)
    assert sorted(map(tuple, found.collect())) == [(0, i, i) for i in range(1, 21)] + [(30, i, i - 30) for i in range(31, 41)]
