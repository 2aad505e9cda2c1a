import random

import numpy as np
import pytest
from plain import near_vectors

from ledgerlens.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<double>, label int"


def check(spark, rows):
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    want = near_vectors(rows)
    assert found == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())


def around(r, centre, n, angle):
    out = []
    for _ in range(n):
        v = r.normal(size=len(centre))
        v -= v @ centre * centre
        v /= np.linalg.norm(v)
        out.append((np.cos(angle) * centre + np.sin(angle) * v) * r.uniform(0.1, 9))
    return out


def test_groups_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1):
        for angle in (0.0, 0.05, 0.1, 0.14, 0.19):
            c = r.normal(size=32)
            c /= np.linalg.norm(c)
            for v in [c, c, *around(r, c, 25, angle)]:
                rows.append((k * 7 % 10_007, [float(x) for x in v], label))
                k += 1
    check(spark, rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0] * 4
    nan, inf = float("nan"), float("inf")
    rows = [(1, v, 0), (2, [2 * x for x in v], 0), (3, v, None), (4, v, None), (5, None, 0), (6, [0.0] * 12, 0), (7, [nan, *v[1:]], 0), (8, [inf, *v[1:]], 0), (9, [None, *v[1:]], 0), (10, [], 0), (11, v[:9], 0), (12, [1e300 * x for x in v], 0), (13, [1e-300 * x for x in v], 0), (14, v, 1)]
    check(spark, rows)


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 8)
    r = np.random.default_rng(4)
    c = r.normal(size=16)
    c /= np.linalg.norm(c)
    check(spark, [(i, [float(x) for x in v], 0) for i, v in enumerate(around(r, c, 60, 0.11))])


def test_repeated_ids_null_ids_and_empty(spark):
    v = [1.0, -1.0, 0.5] * 4
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (None, None, 0)], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=repr)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("dim", "number"), [(64, 1024), (64, 16384), (32, 1024), (384, 1024), (8, 4096)])
def test_recall_at_the_threshold(dim, number):
    """Of pairs at a cosine of just 0.98 nearly all meet in a list and share enough pivots; of closer ones more do."""
    r = np.random.default_rng(1)
    a = r.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.array([around(r, x, 1, np.arccos(0.98))[0] for x in a])
    near = [E.nearest(E.unit(list(x)), number) for x in (a, b)]
    keys = [E.list_keys(x) for x in near]
    met = [len(set(x) & set(y)) > 0 and len(set(u) & set(v)) >= E.SHARED for x, y, u, v in zip(*keys, *near, strict=True)]
    assert np.mean(met) > 0.995


def test_pivots_grow_with_the_table():
    assert [E.n_pivots(n) for n in (0, 65_536, 65_537, 10**6, 10**9)] == [1024, 1024, 2048, 4096, 131_072]
    assert E.n_pivots(10**11) < 1 << E.BITS


@pytest.mark.parametrize("n", [2, 5, 17, 40])
def test_short_and_long_lists_agree(n, monkeypatch):
    import pandas as pd

    r = np.random.default_rng(n)
    c = r.normal(size=8)
    x = np.array(around(r, c / np.linalg.norm(c), n, 0.12))
    near = E.nearest(E.unit(list(x)))
    out = []
    for key in random.Random(n).sample(E.list_keys(near)[0].tolist(), 6):
        df = pd.DataFrame({"label": 0, "dim": 8, "key": key, "b0": 0, "b1": 0, "id": range(n), "block": 0, "n": 1, "embedding": list(x), "near": [v.astype("<u4").tobytes() for v in near]})
        for small in (1, 100):
            monkeypatch.setattr(E, "SMALL", small)
            got = pd.concat([*E._verified(iter([df]), 0.98), pd.DataFrame({"id": [], "links": [], "least": []})])
            some = pd.concat([*E._candidates(iter([df])), pd.DataFrame({"id": []})])
            out.append((got.groupby("id")["links"].sum().to_dict(), sorted(some["id"])))
    assert out[::2] == out[1::2]


def test_order_decides_the_lists():
    """Pivots beyond the first PREFIX are no keys, whatever their numbers."""
    near = np.array([[9, 8, 7, 6, 5, 4, 3, 2, 1, 0]])
    assert {tuple(divmod(k, 1 << E.BITS)) for k in E.list_keys(near)[0].tolist()} == {(a, b) for a in range(2, 10) for b in range(a + 1, 10)}


def test_clashing_columns_and_wide_vectors(spark):
    v = [float(x) for x in np.random.default_rng(0).normal(size=5000)]
    df = spark.createDataFrame([(1, v, 0, "x", 1, 2), (2, [2 * x for x in v], 0, "y", 1, 2)], SCHEMA + ", key string, n int, near int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()} == {1: (1, 1), 2: (1, 1)}
