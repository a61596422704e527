from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from gleanframe.functions.vectors import HashingBackend
from gleanframe.operators import evolution, versions
from gleanframe.operators.snapshots import current_rows, snapshot_changes

SNAP = "index_name string, version string, doc_id string, content_hash string, text string, loaded_at timestamp, version_note string"
VERS = "index_name string, version string, taken_at timestamp, encoded_count bigint, rebuild_seconds double"


def day(n):
    return dt.datetime(2025, 1, n)


def test_changes_between_snapshots(spark, rows):
    snap = [
        ("i", "v9", "a", None, "one", day(1), ""), ("i", "v9", "a", None, "one", day(1), "again"), ("i", "v9", "b", None, None, day(1), ""), ("i", "v9", "gone", None, "x", day(1), ""),
        ("i", "v10", "a", None, "old", day(2), ""), ("i", "v10", "a", None, "two", day(3), ""), ("i", "v10", "b", None, "", day(2), ""), ("i", "v10", "new", None, "y", day(2), ""),
        ("i", "v12", "a", None, "two", None, ""), ("i", "v12", None, None, "z", day(5), ""), ("j", "v1", "a", None, "alone", day(1), ""),
    ]
    vers = [("i", "v10", day(2), 1, 0.1), ("i", "v9", day(1), 1, 0.1), ("i", "v9", day(1), 1, 0.1), ("i", "v11", day(3), 1, 0.1), ("i", "v12", day(4), None, None), ("j", "v1", day(1), 1, 0.1)]
    found = rows(snapshot_changes(spark.createDataFrame(snap, SNAP), spark.createDataFrame(vers, VERS)))
    assert found == [
        ("i", "v10", "a", "changed"), ("i", "v10", "gone", "removed"), ("i", "v10", "new", "added"),
        ("i", "v12", "b", "removed"), ("i", "v12", "new", "removed"),
    ]


def test_changes_of_empty_tables(spark):
    none = spark.createDataFrame([], SNAP), spark.createDataFrame([], VERS)
    assert snapshot_changes(*none).count() == 0


def test_rebuild_counts(spark):
    snap = [("i", "a", "1", None, "x", day(1), ""), ("i", "a", "2", None, "x", day(1), ""), ("i", "b", "1", None, "x", day(2), ""), ("i", "b", "2", None, "new", day(2), "")]
    vers = [("i", "a", day(1), 1, 0.1), ("i", "b", day(2), 1, 0.1)]
    got = {r.version: (r.documents, r.encoded_count, r.hit_rate) for r in versions.rebuild_counts(current_rows(spark.createDataFrame(snap, SNAP)), spark.createDataFrame(vers, VERS)).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (2, 1, 0.5)}


def test_version_search_covers_every_index(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from gleanframe.operators import dense
    from gleanframe.plans.ranking import BACKEND

    snap, vers = [], []
    for i, name in enumerate(("b", "a", "c", "late")):
        for no in range(1, 4):
            vers.append((name, f"v{10 - no}", day(no), 1, 0.1))
            if name == "late" and no == 3:
                continue  # never delivered: the one before is the newest
            snap += [(name, f"v{10 - no}", f"d{d:02}", None, f"sort list {name} {'read file ' * (d % 3)} w{(d * no + i) % 7}", day(no), "") for d in range(4 + 5 * i)]
    snap += [(None, "v7", "d", None, "x", day(1), ""), ("a", "v7", None, None, "x", day(1), "")]
    asks = [("q1", "sort list w3"), ("q2", "read file"), ("q3", None), ("q1", "sort list w3")]
    spark.createDataFrame(snap, SNAP).write.parquet(f"{tmp_path}/snapshots.parquet")
    spark.createDataFrame(vers, VERS).write.parquet(f"{tmp_path}/index_versions.parquet")
    spark.createDataFrame(asks, "query_id string, text string").write.parquet(f"{tmp_path}/queries.parquet")
    monkeypatch.setattr(dense, "DOCS_AT_ONCE", 3)
    got = {}
    for r in entry.queries()["version_search"](spark, str(tmp_path)).collect():
        got.setdefault((r.index_name, r.query_id), {})[r.pos] = (r.doc_id, r.score)

    def vectors(pairs):
        return {r.k: np.array(r.vec) for r in BACKEND.embed(spark.createDataFrame(pairs, "k string, text string"), ["k"], "text").collect()}

    newest = {"b": "v7", "a": "v7", "c": "v7", "late": "v8"}
    want, asked = {}, vectors(asks[:3])
    docs = vectors([(f"{s[0]}/{s[2]}", s[4]) for s in snap if s[2] and newest.get(s[0]) == s[1]])
    for name in newest:
        for q, v in asked.items():
            best = sorted((-round(float(v @ x), 6) + 0.0, k.split("/")[1]) for k, x in docs.items() if k.startswith(f"{name}/"))[:5]
            want[name, q] = {pos: (d, pytest.approx(-s, abs=1e-5)) for pos, (s, d) in enumerate(best, 1)}
    assert got == want


def test_index_encodes_only_what_is_new(spark, tmp_path):
    backend = HashingBackend(64)
    index = versions.VersionedIndex(spark, f"{tmp_path}/ix", backend.embed, 64)
    one = spark.createDataFrame([("a", "sort a list"), ("b", "read a file"), ("c", "open a socket")], "doc_id string, text string")
    two = spark.createDataFrame([("a", "sort a list"), ("b", "read a file"), ("c", "close the socket")], "doc_id string, text string")
    index.add_version("v1", one)
    index.add_version("v2", two)
    assert index.encoded_counts == {"v1": 3, "v2": 1}
    assert index.cache_hit_rate("v2") == pytest.approx(2 / 3) and index.cache_hit_rate("none") == 0.0
    index.add_version("v2", two)
    assert index.encoded_counts["v2"] == 0 and index.matrix_for("v2").count() == 3
    asked = backend.embed(spark.createDataFrame([("q", "close socket")], "query_id string, text string"), ["query_id"], "text")
    assert index.search("v2", asked, 1).first().doc_id == "c"
    with pytest.raises(KeyError):
        index.matrix_for("v3")
    index.save(f"{tmp_path}/saved")
    again = versions.VersionedIndex(spark, "unused", backend.embed, 0).load(f"{tmp_path}/saved")
    assert again.dim == 64 and again.matrix_for("v1").count() == 3


def test_stream_adds_versions(spark, tmp_path):
    from gleanframe.streaming.incremental import hits_per_window, stream_versions

    spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "z")], "doc_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    index = versions.VersionedIndex(spark, f"{tmp_path}/ix", HashingBackend(32).embed, 32)
    feed = spark.readStream.schema("doc_id string, text string").parquet(f"{tmp_path}/in")
    stream_versions(feed, index, f"{tmp_path}/state").awaitTermination()
    assert index.encoded_counts == {"batch-0": 2}
    hits = spark.createDataFrame([("q", 1.0, day(1)), ("q", 3.0, day(1)), ("q", 2.0, day(2))], "query_id string, score double, scored_at timestamp")
    assert sorted((r.hits, r.best) for r in hits_per_window(hits).collect()) == [(1, 2.0), (2, 3.0)]


def test_core_and_delta(spark):
    groups = spark.createDataFrame([("g", 0, "a = 1\nb = 2\nb = 2\n"), ("g", 1, "a  =  1\nnew\nb = 2"), ("h", 0, None)], "group_id string, version_no int, text string")
    got = {(r.group_id, r.version_no): (r.core, r.delta) for r in evolution.stable_core_and_delta(groups).collect()}
    assert got == {("g", 0): ("a = 1\nb = 2", ""), ("g", 1): ("a  =  1\nb = 2", "new"), ("h", 0): ("", "")}


def test_evolved_vectors(spark):
    groups = spark.createDataFrame([("g", 0, "alpha beta"), ("g", 1, "alpha beta\ngamma delta")], "group_id string, version_no int, text string")
    embed = HashingBackend(128).embed
    base = {r.version_no: r.vec for r in embed(groups, ["group_id", "version_no"], "text").collect()}
    same = {r.version_no: r.vec for r in evolution.evolved_vectors(groups, embed, 0.0).collect()}
    moved = {r.version_no: r.vec for r in evolution.evolved_vectors(groups, embed, 1.0).collect()}
    assert same == base and moved[0] == pytest.approx(base[0])
    assert np.linalg.norm(moved[1]) == pytest.approx(1) and np.dot(moved[1], base[1]) < 0.999
