"""Components by contraction against union-find, and what the rounds write."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import components


def by_hand(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 120
    pairs = [(f"v{rng.randrange(n):03d}", f"v{rng.randrange(n):03d}") for _ in range(rng.choice([40, 90, 200]))]
    edges = spark.createDataFrame(pairs + [(None, "v001")], "a string, b string")
    alone = spark.createDataFrame([("v001",), ("w",)], "id string")
    got = {r.id: r.component for r in components.connected_components(edges, alone).collect()}
    want = by_hand(pairs) | {"w": "w"}
    assert got == {k: want.get(k, k) for k in ("v001", "w")}
    assert {r.id: r.component for r in components.connected_components(edges).collect()} == by_hand(pairs)


def test_nothing(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert components.connected_components(none).count() == 0
    assert components.connected_components(none, spark.createDataFrame([("x",)], "id string")).collect()[0].component == "x"


@pytest.mark.parametrize("kind", ["star", "star of the last", "chain", "mixed chain"])
def test_rounds_write_less_and_less(spark, monkeypatch, kind):
    n = 100_000 if kind == "star" else 20_000
    hub = {"star": 0, "star of the last": n}.get(kind)
    ids = spark.range(1, n) if kind != "star of the last" else spark.range(0, n)
    if hub is not None:
        edges = ids.select(F.lit(hub).cast("long").alias("a"), F.col("id").alias("b"))
    elif kind == "chain":
        edges = ids.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    else:  # a chain whose ids go up and down
        place = lambda c: F.pmod(c * 7_919, F.lit(n))
        edges = ids.select(place(F.col("id") - 1).alias("a"), place(F.col("id")).alias("b"))
    written, contract = [], components.contract

    def counted(left):
        roots, rest = contract(left)
        written.append(rest.count())
        return roots, rest

    monkeypatch.setattr(components, "contract", counted)
    found = components.connected_components(edges)
    assert found.agg(F.count("*"), F.max("component"), F.min("component")).first()[:] == ((n if kind != "star of the last" else n + 1), 0, 0)
    assert written[-1] == 0 and all(b < a for a, b in zip([n + 1, *written], written, strict=False)) and len(written) <= 12
