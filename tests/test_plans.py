"""Plans: columns are pruned to what a question needs, and no join is a product of two tables."""

import pytest

from braidgraph.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_depth_reads_two_columns(spark, small):
    text = plan(catalog.QUERIES["segment_depth_only"](spark, small))
    assert "ReadSchema: struct<l_partkey:bigint>" in text and "Window" not in text
    text = plan(catalog.QUERIES["segment_depth"](spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text and "Window" not in text


def test_names_alone_need_no_join(spark, small):
    from braidgraph.operators.depth import path_length
    from braidgraph.plans.star_graph import star_graph

    assert "Join" not in plan(path_length(star_graph(spark, small)).select("name"))


@pytest.mark.parametrize("name", ["path_depth", "degree", "validate_links", "interval_depth", "bed_intersect", "gaf_sequences", "chop_steps", "path_overlaps", "flatten_bed"])
def test_joins_have_keys(spark, small, name):
    text = plan(catalog.QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_overlaps_shuffle_steps_not_pairs(spark, small):
    """Nothing stands above the join on handles but the reading of its pairs: they are many times the steps."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.QUERIES["path_overlaps"](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    above, join = text.split("Join", 1)
    assert "Exchange" not in above and "Aggregate" not in above
    assert "handle" in join.splitlines()[0]
