"""Clustering, phrases and exact search against brute force, with odd rows."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspark.llm import delta_lloyd as L
from auditspark.llm import kd_search as K
from auditspark.llm import phrases as P
from auditspark.llm.integer_vectors import MOST, pack_ints, unpack_ints

LONG = (1 << 63) - 1
KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def whole(x, scale):
    return max(-MOST, min(MOST, math.floor(Fraction(x) * scale)))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def with_clashes(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def lloyd(rows, k, rounds, dim):
    kept = [(i, [whole(x, 64) for x in v]) for i, v in rows if usable(v) and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, owner) in zip(kept, found) if owner == j]
                if mine:
                    centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    of = Counter()
    for d, j in found:
        of[j] += min(d, LONG)
    return [(i, j, min(d, LONG), min(of[j], LONG), min(of.total(), LONG), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)]


def cluster_rows(dim, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, dim))
    rows = [(i, [float(x) for x in np.round(base[i % 5] + rng.normal(size=dim) * 0.3, 2)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies
    odd = [(300, None), (301, []), (302, [1.0] * (dim - 1)), (303, [1.0] * (dim + 1)), (304, [float("nan")] + [1.0] * (dim - 1)), (305, [None] + [1.0] * (dim - 1)), (306, [float("-inf")] + [0.0] * (dim - 1))]
    return rows + odd + [(None, [0.5] * dim), (7, [-0.25] * dim), (7, [-0.25] * dim), (None, [0.5] * dim)]


@pytest.mark.parametrize("dim, k, block, more", [(6, 4, 16, []), (6, 3, 4096, [(400, 1e15), (401, -3e8)]), (3, 300, 8, []), (2, 2, 64, [(500, 1.7e308), (501, -1e200), (502, 5e-324)])])
def test_lloyd_equals_brute_force(spark, monkeypatch, dim, k, block, more):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = cluster_rows(dim) + [(i, [x] * dim) for i, x in more]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "cluster", "ids", "moved", "label")
    got = [tuple(r) for r in L.delta_lloyd(df, k=k, rounds=3, dim=dim).collect()]
    assert sorted(got, key=KEY) == sorted(lloyd(rows, k, 3, dim), key=KEY)


def test_lloyd_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert L.delta_lloyd(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and L.delta_lloyd(empty).count() == 0
    assert L.delta_lloyd(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_round_compares_only_what_changed():
    rng = np.random.default_rng(0)
    x, old = rng.integers(-50, 50, (400, 8)), rng.integers(-50, 50, (6, 8)).tolist()
    owner, best = L.assign(x, np.full(400, -1), np.full(400, -1), old, list(range(6)))
    new = [c if i not in (1, 4) else [v + 9 for v in c] for i, c in enumerate(old)]
    after, d = L.assign(x, owner, best, new, [1, 4])
    full = ((x[:, None] - np.array(new)[None]) ** 2).sum(axis=2)
    assert (after == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    gained = {m["cluster"]: m for m in L.transfers(x, owner, after, 6)}
    for c in range(6):
        m = gained.get(c, {"n": 0, "sums": [0] * 8})
        assert m["n"] == (after == c).sum() - (owner == c).sum()
        assert [int(s) for s in m["sums"]] == (x[after == c].sum(axis=0) - x[owner == c].sum(axis=0)).tolist()


@given(st.lists(st.integers(-MOST, MOST)))
def test_packed_numbers(numbers):
    assert unpack_ints(pack_ints(np.array(numbers, np.int64))).tolist() == numbers


def top(rows, every, k, scale=1024):
    kept = [(n, i, [whole(x, scale) for x in v]) for n, (i, v) in enumerate(rows) if usable(v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            found = [(-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q, v)))), j is None, j or 0) for m, j, v in kept if m != n and len(v) == len(q)]
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("shard, leaf, queries, scale", [(16, 4, 8, 1.0), (64, 4, 1024, 1.0), (8192, 32, 1024, 1.0), (32, 8, 16, 1e9)])
def test_search_equals_brute_force(spark, monkeypatch, shard, leaf, queries, scale):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("QUERIES", queries), ("LANE", 2), ("LONGEST", 3)):
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12)) * scale
    rows = [(i, [float(x) for x in np.round(base[i % 6] + rng.normal(size=12) * scale * 0.2, 3)]) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(60)]  # copies: ties
    rows += [(900, None), (910, []), (911, []), (920, [1.0, 2.0]), (921, [2.0, 1.0]), (922, [2.0, -1.0]), (930, [float("inf")] * 12), (940, [None] * 12), (None, rows[10][1]), (None, rows[10][1]), (10, rows[10][1]), (10, rows[10][1]), (-20, rows[11][1]), (0, [0.0] * 12)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "rank", "row", "score", "dim", "floor")
    got = [tuple(r) for r in K.exact_top_k(df, every=10, k=7).collect()]
    assert sorted(got, key=KEY) == sorted(top(rows, 10, 7), key=KEY)


def test_search_of_huge_components(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e300, -1e300, 1.0, 1e15, 2e15, 2e15, -3.0, 5e-324])]
    got = K.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1, k=3).collect()
    assert sorted(map(tuple, got)) == sorted(top(rows, 1, 3))


def test_search_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.exact_top_k(empty).count() == 0
    assert K.exact_top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")).count() == 0
    assert K.exact_top_k(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_boxes_are_tight_and_prune():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-3, 3, (500, 4)) + c for c in (-100, 0, 100)])
    order = K.tree_order(x)
    assert sorted(order.tolist()) == list(range(1500))
    x, edges = x[order], K.cuts(1500)
    for lo, hi in K.boxes(x, edges):
        n = len(lo)
        parts = [x[edges[i * (len(edges) - 1) // n] : edges[(i + 1) * (len(edges) - 1) // n]] for i in range(n)]
        assert all((p.min(axis=0) == a).all() and (p.max(axis=0) == b).all() for p, a, b in zip(parts, lo, hi))
    seen = []

    class Counting(K.Best):
        def add(self, query, *more):
            seen.append(len(query))
            super().add(query, *more)

    best = Counting(np.full(1, -1), np.full(1, -np.inf), 5)
    ids = np.arange(1500)
    K.visit(np.ones((1, 4)), x.astype(np.float64), ids, np.zeros(1500, np.uint8), ids, best)
    assert sorted(best.score.tolist(), reverse=True) == sorted(x.sum(axis=1).tolist(), reverse=True)[:5]
    assert sum(seen) < 300


def phrases(rows, least, limit, cover=50):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            sizes[lang] += len(words)
            f.update(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        covered = {}
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    covered[q] = max(covered.get(q, 0), a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and p in covered and 100 * covered[p] >= cover * a):
                s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, sizes[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:limit], 1)]
    return out


VOCABULARY = "the The of a ÉCOLE école x-y 1.5 new york city \x01b b 漢字 𝒳 c'est --".split(" ")


@pytest.mark.parametrize("least, limit, chunk", [(3, 2000, 12_000_000), (2, 5, 400), (10, 2000, 60)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, limit, chunk):
    monkeypatch.setattr(P, "PART_CHUNKS", 1)
    rng = np.random.default_rng(9)
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", "!?", "\r\n", ":", "\x0b", "\x0c", "\x1f", " "]
    text = lambda n: "".join(VOCABULARY[int(i)] + ends[int(e)] for i, e in zip(rng.zipf(1.6, n) % len(VOCABULARY), rng.integers(0, len(ends), n)))
    rows = [([None, "und", "en", "fr", ""][i % 5], text(int(rng.integers(0, 60)))) for i in range(120)]
    rows += [("en", "New York City never sleeps " * 30), ("en", None), (None, ""), ("de", "..."), ("de", "ein wort"), ("en", "same row again"), ("en", "same row again"), ("fr", text(4000))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    df = with_clashes(df, "part", "word", "n", "id", "copies", "rank")
    got = [tuple(r) for r in P.collocations(df, least=least, top=limit, range_keys=50, share=2, chunk_bytes=chunk).collect()]
    assert sorted(got) == sorted(phrases(rows, least, limit))
    assert len(got) > 5
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("phrase_")]


def test_phrases_without_rows(spark):
    assert P.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    assert P.collocations(spark.createDataFrame([(1, None, None), (2, "en", "one two three")], "doc_id long, lang string, text string")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(1, (1 << 40) - 1)] * 3), max_size=60))
def test_keys_sort_and_pack(triples):
    a, b, c = (np.array([t[i] for t in triples], np.int64) for i in range(3))
    keys, n = P.counted(P.packed(a, b, c))
    assert list(zip(*(x.tolist() for x in P.unpacked(keys)))) == sorted(set(triples))
    again, m = P.read_keys(P.press_keys(keys, n))
    assert (again == keys).all() and (m == n).all() and n.sum() == len(triples)
    splits = keys[::7]
    assert P.range_of(keys, splits).tolist() == [sum(tuple(s) <= tuple(k) for s in splits.tolist()) for k in keys.tolist()]
