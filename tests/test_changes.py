"""Clocks, merges and the other bulk operators on small cases."""

from __future__ import annotations

import numpy as np

from scriptorium.operators import changes as H
from scriptorium.operators import listing, tagging, topics, vectors

LOG = "tbl string, row_id long, col string, val string, hlc_ts long, hlc_counter long, site_id string"


def log(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], LOG)


def cells(df):
    return {(r["row_id"], r["col"]): r["val"] for r in df.collect()}


def test_merge_is_commutative_associative_and_idempotent(spark):
    a = log(spark, (1, "x", "a", 100, 0, "p"), (1, "y", "a", 100, 0, "p"))
    b = log(spark, (1, "x", "b", 200, 0, "q"), (2, "x", "b", 50, 0, "q"))
    c = log(spark, (1, "x", "c", 200, 1, "a"), (1, "y", "c", 100, 0, "r"))
    want = {(1, "x"): "c", (1, "y"): "c", (2, "x"): "b"}
    merge = H.merge
    back = lambda df: df.select("tbl", "row_id", "col", "val", "hlc_ts", "hlc_counter", "site_id")
    assert cells(merge(back(merge(a, b)), c)) == want == cells(merge(a, back(merge(c, b))))
    assert cells(merge(back(merge(a, a)), a)) == cells(a)


def test_only_newer_changes_apply(spark):
    local = log(spark, (1, "title", "new", 900, 0, "p"), (2, H.ROW, None, 500, 0, "p"))
    remote = log(spark, (1, "title", "old", 1, 0, "q"), (1, "title", "same", 900, 0, "p"), (2, "title", "late", 400, 0, "q"), (2, "title", "ok", 600, 0, "q"), (3, "title", "fresh", 1, 0, "q"))
    assert {r["val"] for r in H.to_apply(local, remote).collect()} == {"ok", "fresh"}


def test_tombstones(spark):
    c = log(spark, (1, "x", "a", 100, 0, "p"), (2, "x", "b", 100, 0, "p"))
    dead = log(spark, (1, "", None, 200, 0, "q"), (2, "", None, 50, 0, "q"))
    assert cells(H.without_deleted(c, dead)) == {(2, "x"): "b"}


def test_hybrid_clock():
    clock = H.HybridClock("a")
    first = clock.now(100)
    assert first == (100, 0, "a") and clock.now(90) == (100, 1, "a")
    clock.observe((500, 3, "b"), 200)
    assert clock.now(200) > (500, 3, "b")
    assert (100, 0, "a") < (100, 1, "a") and (100, 0, "a") < (100, 0, "b") and (100, 0, "a") < (200, 0, "a")


def test_tags_without_entries_count_zero(spark):
    tags = spark.createDataFrame([("a",), ("b",)], "tag string")
    bridge = spark.createDataFrame([(1, "a"), (2, "a")], "entry_id long, tag string")
    assert [tuple(r) for r in tagging.counts(tags, bridge).collect()] == [("a", 2), ("b", 0)]


def test_negative_limits_and_unknown_sort_keys(spark):
    e = spark.createDataFrame([(i, f"t{i}", i) for i in range(5)], "id long, title string, created_s long")
    p = listing.ListParams(sort="nonsense", limit=-1, offset=-3)
    assert [r["id"] for r in listing.page(e, p).collect()] == [4, 3, 2, 1, 0]


def test_vectors(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, -1, 0]
    blob = spark.createDataFrame([(bytearray(np.arange(4, dtype="<f4").tobytes() + b"xy"),)], "b binary")
    assert blob.select(vectors.from_bytes("b").alias("v")).first()["v"] == [0, 1, 2, 3]


def test_two_far_groups_are_two_topics(spark):
    rng = np.random.default_rng(1)
    points = [(i, [float(x) for x in rng.normal(size=6) * 0.1 + (i % 2) * 50]) for i in range(24)]
    found = topics.clusters(spark.createDataFrame(points, "id long, embedding array<double>")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["topic"], set()).add(r["id"] % 2)
    assert len(groups) >= 2 and all(len(g) == 1 for g in groups.values())
    assert topics.clusters(spark.createDataFrame(points[:3], "id long, embedding array<double>")).count() == 0
