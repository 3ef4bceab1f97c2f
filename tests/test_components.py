"""Contraction of components: chains, hubs, loops, and splits that follow chains of groups."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import components as module
from palisade.operators import prepare


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_components(spark, hot_rows):
    r = random.Random(7)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(500, 500), (7, 7), (600, 601), (601, 600), (600, 601)]
    edges += [(900, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = module.components(df, hot_rows=hot_rows)
    assert {x["node"]: x["root"] for x in got.collect()} == roots(edges) and got.count() == len(roots(edges))
    assert module.components(df.limit(0)).count() == 0


def test_a_chain_of_ten_thousand_groups_takes_few_rounds(spark):
    r = random.Random(9)
    names = r.sample(range(10**9), 10_001)
    df = spark.createDataFrame(list(zip(names, names[1:])), "u long, v long")
    got = module.components(df, most_rounds=19)
    assert got.select("root").distinct().count() == 1 and got.count() == 10_001 and got.first()["root"] == min(names)


def test_a_hub_is_joined_by_broadcast(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    values = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = module.attach(rows, values, "k", hot_rows=1000)
    assert out.count() == 5000 and out.where("v <> 2 * k").isEmpty()


def test_splits_follow_chains_of_groups(spark):
    # record i is in groups i and i + 1; the last is test data
    entry = lambda g: F.struct(F.lit("s").alias("source"), g.cast("string").alias("group_id"))
    found = spark.range(60).select(F.concat(F.lit("r"), F.col("id")).alias("text_sha256"), F.when(F.col("id") == 59, 2).otherwise(0).alias("rank"), F.array(entry(F.col("id")), entry(F.col("id") + 1)).alias("provenance"))
    apart = found.select("text_sha256", F.lit(0).alias("rank"), F.array(entry(F.lit(999))).alias("provenance")).limit(1).withColumn("text_sha256", F.lit("alone"))
    out = {r["text_sha256"]: r["split"] for r in prepare.propagate(found.unionByName(apart), hot_rows=10).collect()}
    assert out.pop("alone") == "train" and set(out.values()) == {"test"} and len(out) == 60
