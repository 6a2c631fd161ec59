"""Cluster order against the sequential loop, on chains, trees and random forests."""

import random

import pytest

from storyloom.operators import clusters


@pytest.fixture
def counted(monkeypatch):
    rounds, plain = [], clusters.materialize

    def counting(df, name):
        if name == "cluster-round":
            rounds.append(name)
        return plain(df, name)

    monkeypatch.setattr(clusters, "materialize", counting)
    return rounds


def sequential(edges):
    """Items in id order choose their match unless they were chosen by an acting item before."""
    blocked = set()
    for i, m in sorted(edges):
        if i not in blocked and m > i:
            blocked.add(m)
    return blocked


def settle(spark, edges):
    rows = spark.createDataFrame([(i, m, None) for i, m in edges], "id bigint, match_id bigint, match_cluster bigint")
    return {r.id for r in clusters.blocked_items(rows).collect()}


def test_long_chain_takes_few_rounds(spark, counted):
    edges = [(i, i + 1) for i in range(1000)]
    assert settle(spark, edges) == sequential(edges)
    assert len(counted) <= 25


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, counted, seed):
    rng = random.Random(seed)
    edges = [(i, min(399, i + rng.choice([1, 1, 1, 2, 3, 50]))) for i in range(399)]
    edges += [(1000 + i, 1000 + rng.randint(0, i)) for i in range(1, 100)]
    assert settle(spark, edges) == sequential(edges)
    assert len(counted) <= 25


def test_no_edges(spark):
    assert settle(spark, []) == set()
