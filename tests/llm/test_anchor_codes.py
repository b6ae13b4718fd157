"""Codes and codebooks against comparing every part with every entry, and against SQL."""

import hashlib
import random

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tallyscope.llm import anchor_codes, registry

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, parts, entries, rounds, scale):
    """Plain k-means of whole numbers, with Python's own."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[[int(np.floor(scale * np.float64(np.float32(x)))) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in rows]
    books = [[list(cut[i][p]) for i in range(min(entries, len(rows)))] for p in range(parts)]

    def assigned():
        out = []
        for v in cut:
            line = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(v[p], e)) for e in books[p]]
                line.append((min(d), d.index(min(d))))
            out.append(line)
        return out

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, line in zip(cut, now) if line[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    now = assigned()
    codes = [(r[0], r[2], bytes(c for _, c in line).hex(), sum(d for d, _ in line)) for r, line in zip(rows, now)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(codes, key=repr), hashlib.sha256(text.encode()).hexdigest()


def sample(seed, n, dim, kind):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    hot = [rng.choice([0.25, -0.5]) for _ in range(dim)]
    rows = []
    for i in range(n):
        if kind == "grid":  # many equal distances
            v = [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(dim)]
        elif kind == "far":  # one heap and some far points
            v = [rng.gauss(0, 0.01) * (1000 if i % 50 == 0 else 1) for _ in range(dim)]
        else:
            v = [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]
        rows.append((rng.randrange(10**6), [float(np.float32(x)) for x in (hot if rng.random() < 0.35 else v)], rng.choice([1, 2, 2, 2, None])))
    return rows


@pytest.mark.parametrize("kind", ["heaps", "grid", "far"])
@pytest.mark.parametrize("block,leaf", [(4096, 12), (50, 2)])
def test_equals_comparing_all(spark, monkeypatch, kind, block, leaf):
    monkeypatch.setattr(anchor_codes, "BLOCK_ROWS", block)
    monkeypatch.setattr(anchor_codes, "LEAF", leaf)
    rows = sample(len(kind), 400, 12, kind)
    coded, books = anchor_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, entries=7, rounds=5, scale=16 if kind == "grid" else 4096)
    want, digest = by_hand(rows, 4, 7, 5, 16 if kind == "grid" else 4096)
    got = sorted(((r.id, r.label, bytes(r.codes).hex(), r.error) for r in coded.collect()), key=repr)
    assert got == want and anchor_codes.digest(books) == digest


def test_balls_hold_their_points():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-500, 500, (700, 3)), np.repeat(rng.integers(-9, 9, (1, 3)), 300, axis=0)])
    tree = anchor_codes.Tree(points)
    assert sorted(tree.order.tolist()) == list(range(1000)) and (tree.start[-1], tree.stop[-1]) == (0, 1000)
    for i in range(len(tree.start)):
        mine = points[tree.order[tree.start[i] : tree.stop[i]]]
        assert (mine.sum(axis=0) == tree.total[i]).all()
        assert np.sqrt(((mine - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        if tree.left[i] >= 0:
            assert (tree.start[tree.left[i]], tree.stop[tree.right[i]]) == (tree.start[i], tree.stop[i]) and tree.stop[tree.left[i]] == tree.start[tree.right[i]]


def test_lists_shrink():
    """Separate heaps are owned as whole balls: few points are compared with any entry."""
    rng = np.random.default_rng(1)
    heaps = rng.integers(-20_000, 20_000, (16, 4))
    points = heaps[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 4))
    tree = anchor_codes.Tree(points)
    walk = anchor_codes.Walk({name: getattr(tree, name) for name in anchor_codes.Tree.FIELDS}, points[tree.order], heaps)
    nearest = ((points[tree.order][:, None] - heaps) ** 2).sum(axis=2).argmin(axis=1)
    assert (walk.code == nearest).all() and walk.compared < 4000
    assert walk.counts.sum() == 4000 and (walk.sums.sum(axis=0) == points.sum(axis=0)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [1.0, -1.0, 0.5, 0.25], None), (None, [2.0, 2.0, 2.0, 2.0], None), (5, [1.0, -1.0, 0.5, 0.25], 7), (5, [1.0, -1.0, 0.5, 0.0], 7), (-3, [0.0, 0.0, -0.0, 0.0001], 1)]
    bad = [(1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (3, [nan, 1.0, 1.0, 1.0], 1), (4, [inf, 1.0, 1.0, 1.0], 1), (6, [1.0, 1.0, 1.0, -inf], 1)]
    names = ["id", "vector", "codes", "error", "part", "entry", "place", "_label", "label_error", "points", "order"]
    df = spark.createDataFrame(good + bad, SCHEMA).select("*", *[F.lit("x").alias(x) for x in names])
    coded, books = anchor_codes.compress(df, parts=2, entries=3)
    want, digest = by_hand(good, 2, 3, 6, 4096)
    rows = anchor_codes.with_label_errors(coded).collect()
    assert sorted(((r.id, r.label, bytes(r.codes).hex(), r.error) for r in rows), key=repr) == want and anchor_codes.digest(books) == digest
    for r in rows:
        assert r.label_error == sum(x.error for x in rows if x.label == r.label)
    # nothing, nothing usable, empty vectors
    for empty in (df.limit(0), df.filter("vec_id = 1")):
        none, books = anchor_codes.compress(empty)
        assert none.count() == 0 and books.size == 0 and none.columns == coded.columns
        assert anchor_codes.with_label_errors(none).count() == 0
    hollow, books = anchor_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA))
    assert sorted((r.id, bytes(r.codes), r.error) for r in hollow.collect()) == [(1, bytes(8), 0), (2, bytes(8), 0)]


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0]], [[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]], [[1e30, 2.0]]])
def test_unfit_vectors_are_errors(spark, vectors):
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA)
    with pytest.raises(Exception, match="equal parts|different lengths|beyond"):
        anchor_codes.compress(df, parts=2)[0].collect()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_equals_sql(spark, size):
    name, folder = "op11_anchor_codes", f"/root/testdata/{size}"
    assert compare(registry.queries()[name](spark, folder), connect(folder), registry.oracle_sql()[name]) is None
