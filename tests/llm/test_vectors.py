"""Codes and centroids of vectors against plain loops over Python integers, and their odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import centroids, codes
from tessera.llm.common import Tables
from tessera.llm.integers import floors, sums_of

KIND = "vec_id bigint, embedding array<double>, label int, cluster int, id bigint, v int, code string"


def whole(v):
    return [math.floor(256 * x) for x in v]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def best(x, entries):
    return min((far(x, c), i) for i, c in enumerate(entries))


def floor_means(groups, old):
    return [[sum(col) // len(groups[i]) for col in zip(*groups[i])] if groups.get(i) else c for i, c in enumerate(old)]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    vecs = [(i, whole(v), lab) for i, v, lab in rows]
    width = len(vecs[0][1]) // parts
    ids = {}
    for i, v, _ in vecs:
        if i is not None:
            ids[i] = min(ids.get(i, v), v)
    seeds = [ids[i] for i in sorted(ids)[:entries]]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(s)[p] for s in seeds] for p in range(parts)]
    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in vecs:
            for p, x in enumerate(cut(v)):
                groups[p][best(x, books[p])[1]].append(x)
        books = [floor_means(groups[p], books[p]) for p in range(parts)]
    out, labels = [], Counter()
    for i, v, lab in vecs:
        got = [best(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), lab))
        labels[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab], sha) for i, c, e, lab in out), key=str)


def plain_clusters(rows, k=40, rounds=5):
    vecs = [(i, whole(v)) for i, v in rows]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in vecs if i is not None) + sorted(("~", v) for i, v in vecs if i is None)
    cents = [v for _, v in order[:k]]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in vecs:
            groups[best(v, cents)[1]].append(v)
        cents = floor_means(groups, cents)
    got = [(i, *best(v, cents)) for i, v in vecs]
    per = Counter()
    for _, d, c in got:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, d, c in got), key=str)


def mixed(n=400, dims=64, seed=3):
    """Vectors around few centres on a coarse grid, so that ties and repeats are many, and one third of all rows alike."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(int(i), np.round((centres[i % 6] + 0.1 * rng.normal(size=dims)) * 4).tolist(), int(i % 4) if i % 5 else None) for i in range(n)]
    rows += [(n + i, rows[0][1], 9) for i in range(n // 2)] + rows[:20] + [(None, rows[7][1], None), (3, rows[11][1], 1), (n * 2, (rng.normal(size=dims) * 1e-3).tolist(), 2)]
    return [(i, [x / 256 if j % 2 else x / 1000 for j, x in enumerate(v)], lab) for i, v, lab in rows]


ODD = [(901, None, 1), (902, [None] * 64, 1), (903, [float("nan")] + [0.0] * 63, 1), (904, [float("inf")] * 64, 1), (905, [], 1), (906, [0.5] * 32, 7), (907, [0.5] * 61, None), (908, [1e9] + [0.0] * 63, 3)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, "x") for i, v, lab in rows], KIND).repartition(5)


def test_codes_are_those_of_plain_rounds(spark):
    rows = mixed()
    got = [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in codes.compress(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = mixed(60)
    out = codes.compress(frame(spark, rows + ODD)).collect()
    want = {(w[0], w[1], w[2]) for w in plain_codes(rows)}
    assert {(r["vec_id"], r["code"], r["error"]) for r in out if r["code"] is not None} == want
    assert sorted(r["vec_id"] for r in out if r["code"] is None) == [905, 906, 907, 908] and all(r["error"] is None for r in out if r["code"] is None)
    assert codes.compress(frame(spark, [])).collect() == []
    assert [r["code"] for r in codes.compress(frame(spark, ODD[:4] + [(1, [0.25] * 64, None)])).collect()] == ["00" * 16]
    assert codes.compress(frame(spark, [(None, [0.25] * 64, None)])).first()["code"] == "00" * 16  # no id, so the only entry is zero until the first round


def test_only_parts_that_move_are_shuffled(spark):
    """Vectors that keep their codes from the second round on contribute nothing to it."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(i % 2 * 4 + x) for x in rng.uniform(0, 0.1, 64)], 0) for i in range(300)]
    df = frame(spark, rows).select("vec_id", "embedding", "label")
    x = floors(__import__("pyarrow").array([r[1] for r in rows[:2]]))
    books = x.reshape(2, 16, 4).transpose(1, 0, 2)
    start = df.selectExpr("vec_id AS id", "embedding AS v", "label").mapInArrow(codes._whole(64), "id bigint, label int, x binary, code binary")
    state, _, sent = codes.fit(start, books, 3, Tables(spark), "id bigint, label int, x binary")
    assert sent == [16 * 2 * 5, 0, 0] and state.count() == 300


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    rows = mixed(80)
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    got = [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in codes.compress(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_codes(rows)


def test_centroids_are_those_of_plain_rounds(spark):
    rows = [(i, v) for i, v, _ in mixed()]
    got = [tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in centroids.cluster(frame(spark, [(*r, 0) for r in rows])).collect()]
    assert sorted(got, key=str) == plain_clusters(rows)


def test_centroids_of_odd_rows(spark):
    rows = mixed(30)[:20]  # fewer rows than centroids
    out = centroids.cluster(frame(spark, rows + ODD)).collect()
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in out if r["cluster"] is not None} == {w[:3] for w in plain_clusters([r[:2] for r in rows])}
    assert [r["vec_id"] for r in out if r["cluster"] is None] == [908]
    assert centroids.cluster(frame(spark, [])).collect() == [] and len(centroids.cluster(frame(spark, ODD)).collect()) == 1


@pytest.mark.parametrize("scale", [1, 1 << 23])
def test_filtering_is_exact_with_large_numbers(scale):
    """Ties in the boxes stay, in doubles and where these would not be exact."""
    rng = np.random.default_rng(scale)
    x = rng.integers(-3, 4, (700, 5)) * scale
    tree, order = centroids.Tree.grow(x)
    assert (tree.points == x[order]).all()
    cents = np.concatenate((x[:9], x[:3], rng.integers(-3, 4, (9, 5)) * scale + 1))
    which, dist = tree.nearest(cents)
    want = ((x[order][:, None] - cents[None]) ** 2).sum(axis=2)
    assert (which == want.argmin(axis=1)).all() and (dist == want.min(axis=1)).all()
    total, _ = tree.totals(cents)
    assert (total == sums_of(x[order], want.argmin(axis=1), len(cents))).all()


def test_nodes_are_taken_whole_where_data_has_structure():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64)) * 2000
    x = (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 64)) * 20).astype(np.int64)
    tree, _ = centroids.Tree.grow(x)
    assert tree.totals(centres.astype(np.int64))[1] < 0.15 * 8000 * 40  # leaves that hold points of two clusters remain
