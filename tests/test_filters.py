"""Blocked membership filters: sizes, rates of false hits, additions, folding and unions."""

import pytest
from pyspark.sql import functions as F

from symtab.operators import ingest


def made(spark, container, start, end, prefix="in"):
    return spark.range(start, end).select(F.lit(container).alias("container"), F.concat(F.lit(prefix), "id").alias("name"))


def hits(filters, probes):
    return ingest.membership_filter_probe(filters, probes).filter("might_contain").count()


def rate(spark, filters, container):
    return hits(filters, made(spark, container, 0, 10_000, "out")) / 10_000


def bytes_of(filters):
    return dict(filters.groupBy("container").agg(F.sum(F.octet_length("bits"))).collect())


def test_rate_and_no_misses(spark):
    names = made(spark, "c", 0, 1000, "In")
    filters = ingest.membership_filter_build(names)
    assert hits(filters, names) == 1000 and hits(filters, names.withColumn("name", F.upper("name"))) == 1000
    assert rate(spark, filters, "c") < 0.02
    assert hits(filters, names.withColumn("container", F.lit("d"))) == 0


@pytest.mark.parametrize("n", [1, 16, 42, 43, 2730, 2731, 30_000])
def test_bytes_follow_the_names(spark, n):
    names = made(spark, "c", 0, n)
    filters = ingest.membership_filter_build(names.unionByName(names))
    assert max(n, 16) * 12 / 8 <= bytes_of(filters)["c"] <= max(2 * max(n, 16) * 12 / 8, 64)
    assert {r.n for r in filters.collect()} == {n} and (filters.count() == 1) == (12 * n <= 64 * 512)
    assert hits(filters, names) == n and rate(spark, filters, "c") < 0.02


def test_filters_follow_additions(spark):
    """From two names to 6,000: never a miss, bytes and false hits as if built at once."""
    names = made(spark, "a", 0, 2).unionByName(made(spark, "other", 0, 100))
    filters = ingest.membership_filter_build(names)
    for end in (41, 700, 6000):
        added = made(spark, "a", names.filter("container = 'a'").count(), end)
        names = names.unionByName(added)
        filters = spark.createDataFrame(ingest.membership_filter_add(filters, added, names).collect(), filters.schema)
        assert hits(filters, names) == end + 100
        assert bytes_of(filters) == bytes_of(ingest.membership_filter_build(names))
        assert {r.n for r in filters.filter("container = 'a'").collect()} == {end}
        assert rate(spark, filters, "a") < 0.02 and rate(spark, filters, "other") < 0.02
    both = ingest.membership_filter_add(filters, made(spark, "new", 0, 5), names.unionByName(made(spark, "new", 0, 5)))
    assert hits(both, made(spark, "new", 0, 5)) == 5 and hits(both, names) == 6100


def test_union_of_filters_of_different_sizes(spark):
    names = made(spark, "small", 0, 30).unionByName(made(spark, "middle", 1000, 1300)).unionByName(made(spark, "large", 5000, 15_000))
    filters = ingest.membership_filter_build(names)
    assert {r.container: r.blocks for r in filters.collect()} == {"small": 1, "middle": 8, "large": 256}
    for blocks in (128, 8):
        folded = ingest.membership_filter_fold(filters, blocks)
        assert hits(folded, names) == 10_330
        assert {r.container: r.blocks for r in folded.collect()} == {"small": 1, "middle": min(8, blocks), "large": min(256, blocks)}
        assert bytes_of(folded) == {c: 64 * min(b, blocks) for c, b in (("small", 1), ("middle", 8), ("large", 256))}
    whole = ingest.membership_filter_union(filters)
    assert (whole.count(), whole.first().blocks, whole.first().n) == (1, 1, 10_330)
    assert hits(whole, names.withColumn("container", F.lit("*"))) == 10_330
    two = ingest.membership_filter_union(filters.filter("container <> 'small'"), container="both")
    assert two.first().blocks == 8 and hits(two, names.filter("container <> 'small'").withColumn("container", F.lit("both"))) == 10_300
    same = ingest.membership_filter_build(made(spark, "x", 0, 1500).unionByName(made(spark, "y", 9000, 9500)))
    united = ingest.membership_filter_union(same.filter("container = 'x'"))
    assert rate(spark, united, "*") < 0.02
    with pytest.raises(ValueError):
        ingest.membership_filter_union(filters, 64)


def test_a_probe_is_one_row(spark):
    """No row for each bit: only the probes themselves and a number for each container are shuffled."""
    filters = ingest.membership_filter_build(made(spark, "c", 0, 50))
    kept = spark.createDataFrame(filters.collect(), filters.schema)
    plan = ingest.membership_filter_probe(kept, made(spark, "c", 0, 9))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and plan.count("Join") == 2


def test_nulls_and_empty_names(spark):
    names = spark.createDataFrame([("c", ""), ("c", None), (None, "x")], "container string, name string")
    filters = ingest.membership_filter_build(names)
    assert [(r.container, r.n) for r in filters.collect()] == [("c", 1)]
    found = {(r.container, r.name): r.might_contain for r in ingest.membership_filter_probe(filters, names).collect()}
    assert found[("c", "")] is True and found[(None, "x")] is False and found[("c", None)] is False
    assert ingest.membership_filter_build(names.limit(0)).count() == 0
    assert ingest.membership_filter_union(filters.limit(0)).count() == 0
