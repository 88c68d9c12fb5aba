"""The stored upsert: reruns, crashes, other writers, untouched buckets."""

import os

import pytest

from auditspark.sources import versions as V

SCHEMA = "k long, seq long, v string"


def stored(spark, path):
    return {r.k: (r.seq, r.v) for r in V.read_stored(spark, path).collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.startswith("part-")}


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.read_stored(spark, path) is None
    base = [(k, 1, f"a{k}") for k in range(100)] + [(5, 3, "later"), (5, 2, "b5")]
    assert V.upsert_stored(spark.createDataFrame(base, SCHEMA), path, ["k"], buckets=8, change_id="first") == 1
    expected = {k: (1, f"a{k}") for k in range(100)} | {5: (3, "later")}
    assert stored(spark, path) == expected
    # The same change again does nothing.
    assert V.upsert_stored(spark.createDataFrame(base, SCHEMA), path, ["k"], change_id="first") == 1
    before = V.last_commit(spark, path)[1]["buckets"]
    kept = files(path)
    assert V.upsert_stored(spark.createDataFrame([(7, 0, "new"), (500, 9, "added")], SCHEMA), path, ["k"], change_id="second") == 2
    assert stored(spark, path) == expected | {7: (0, "new"), 500: (9, "added")}
    after = V.last_commit(spark, path)[1]["buckets"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and kept <= files(path)
    assert V.vacuum(spark, path) == 0
    assert stored(spark, path) == expected | {7: (0, "new"), 500: (9, "added")}
    assert V.upsert_stored(spark.createDataFrame([], SCHEMA), path, ["k"]) == 3 and len(stored(spark, path)) == 101


def test_crash_before_the_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.upsert_stored(spark.createDataFrame([(1, 1, "a")], SCHEMA), path, ["k"])

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(V, "commit", crash)
        with pytest.raises(KeyboardInterrupt):
            V.upsert_stored(spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], SCHEMA), path, ["k"], change_id="x")
    assert stored(spark, path) == {1: (1, "a")} and len(os.listdir(f"{path}/data")) == 2
    assert V.upsert_stored(spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], SCHEMA), path, ["k"], change_id="x") == 2
    assert stored(spark, path) == {1: (2, "b"), 2: (1, "c")}


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that another overtakes begins again: neither change is lost."""
    path = str(tmp_path / "t")
    V.upsert_stored(spark.createDataFrame([(1, 1, "a")], SCHEMA), path, ["k"], buckets=1)
    real, others = V.commit, [(1, 5, "other"), (3, 1, "other")]

    def overtaken(spark, path, number, content):
        if others:
            rows = others[:]
            others.clear()
            assert V.upsert_stored(spark.createDataFrame(rows, SCHEMA), path, ["k"]) == 2
        return real(spark, path, number, content)

    monkeypatch.setattr(V, "commit", overtaken)
    assert V.upsert_stored(spark.createDataFrame([(2, 1, "mine")], SCHEMA), path, ["k"]) == 3
    assert stored(spark, path) == {1: (5, "other"), 2: (1, "mine"), 3: (1, "other")}
    assert V.vacuum(spark, path) >= 1 and stored(spark, path) == {1: (5, "other"), 2: (1, "mine"), 3: (1, "other")}
