"""Near-duplicate embeddings through a pivot-permutation index.

Every vector is described by its `NEAREST` nearest reference points, in order (random directions of a fixed seed: none depends on a sample of the data).
The first `PREFIX` of that order, which are the most likely to stay near for a vector close by, put it into inverted lists: one for each pair of them, so
that vectors of one label and dimension that agree in two meet in a list. There are `PER_ROOT` pivots for the square root of the number of vectors, so that
lists don't grow with the table. In the lists, which hold numbers of vectors and their pivots alone, shared pivots are counted: vectors that share
`SHARED` of all `NEAREST` with another are candidates. Only these fetch their components, and cosines in double precision decide. A pair counts in the
first list it shares alone. Lists over `BLOCK` vectors are dealt out as pairs of blocks, whatever their length.

Vectors that are equal are one class, with its number of rows, before anything else; classes are linked, and rows are
counted from the classes. A list gives back, for each class, its number of links and its component's first class in that list:
never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ship, staged, table
from .components import components

COSINE = 0.98
PER_ROOT, LEAST_PIVOTS, SEED = 4, 1024, 11
NEAREST, PREFIX, SHARED, BLOCK = 10, 8, 3, 512
#: Lists of this many vectors or fewer are compared many lists at a time.
SMALL = 16
#: Dot products that a worker holds at a time.
HELD = 1 << 22
PAIRS = np.array(list(combinations(range(PREFIX), 2)))
#: A pivot's number takes so many bits of a list's key.
BITS = 24


def n_pivots(n_vectors: int) -> int:
    """A power of two, PER_ROOT for the square root of the table at least."""
    n = LEAST_PIVOTS
    while n < PER_ROOT * n_vectors**0.5:
        n *= 2
    return n


@lru_cache(4)
def pivots(dim: int, number: int) -> np.ndarray:
    p = np.random.default_rng([SEED, dim]).normal(size=(number, dim))
    return p / np.linalg.norm(p, axis=1)[:, None]


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1)[:, None]  # so that no square is out of range
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(x: np.ndarray, number: int = LEAST_PIVOTS) -> np.ndarray:
    """The nearest pivots of unit vectors, nearest first."""
    out, step = np.zeros((len(x), NEAREST), np.int64), max(1, HELD // number)
    for a in range(0, len(x), step):
        far = -(x[a : a + step] @ pivots(x.shape[1], number).T)
        some = np.sort(np.argpartition(far, NEAREST - 1, axis=1)[:, :NEAREST], axis=1)
        out[a : a + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return out


def list_keys(near: np.ndarray) -> np.ndarray:
    """For each row the pairs of the pivots that its order starts with, the lower number first."""
    pairs = np.sort(near[:, :PREFIX], axis=1)[:, PAIRS].astype(np.int64)
    return pairs[:, :, 0] << BITS | pairs[:, :, 1]


def usable(v: Column) -> Column:
    big = F.lit(float("inf"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def _closed(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row reaches."""
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(1))
        if (new == least).all():
            return least
        least = new


class Lists(NamedTuple):
    """Lists (or pairs of blocks of them) one after another: where each starts, its length, key and whether only pairs across blocks count."""

    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    split: np.ndarray
    block: np.ndarray  # of each row
    near: np.ndarray


def _few(a: Lists) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of many short lists at once, as numbers of rows."""
    left, right, which = [], [], []
    for m in np.unique(a.sizes):
        i, j = np.triu_indices(m, 1)
        at = np.flatnonzero(a.sizes == m)
        left.append((a.starts[at][:, None] + i).ravel())
        right.append((a.starts[at][:, None] + j).ravel())
        which.append(np.repeat(at, len(i)))
    i, j, w = map(np.concatenate, (left, right, which))
    other = ~a.split[w] | (a.block[i] != a.block[j])
    i, j, w = i[other], j[other], w[other]
    u, v = a.near[i], a.near[j]
    same = u[:, :, None] == v[:, None, :]
    first = (same[:, :PREFIX, :PREFIX] & (u[:, :PREFIX, None] <= (a.keys[w] & (1 << BITS) - 1)[:, None, None])).sum((1, 2)) == 2
    hit = first & (same.sum((1, 2)) >= SHARED)
    return i[hit], j[hit]


def _many(key: int, split: bool, block: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The candidates of a long list, as a matrix."""
    known, of = np.unique(near, return_inverse=True)
    of = of.reshape(near.shape)
    every = np.zeros((len(near), len(known)), np.float32)
    np.put_along_axis(every, of, 1, axis=1)
    early = np.zeros_like(every)
    np.put_along_axis(early, of[:, :PREFIX], 1, axis=1)
    early[:, known > (key & (1 << BITS) - 1)] = 0
    found = (early @ early.T == 2) & (every @ every.T >= SHARED)  # two shared up to the key's last pivot: this is the first list they share
    if split:
        found &= block[:, None] != block[None, :]
    np.fill_diagonal(found, False)
    return found


WHERE = ["label", "dim", "key", "b0", "b1"]


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """batches: sorted by list and block pair. Rows of whole lists of one dimension, where those of two or more start, and their sizes. What is held at a
    time is a batch and a list of 2 * BLOCK vectors or so."""
    held = None

    def cut(rows: pd.DataFrame, ends: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        starts = np.concatenate([[0], ends[:-1]])
        sizes, dims = ends - starts, rows["dim"].to_numpy()
        for dim in np.unique(dims):
            lists = np.flatnonzero((dims[starts] == dim) & (sizes > 1))
            if len(lists):
                size = sizes[lists]
                yield rows.iloc[np.concatenate([np.arange(starts[k], ends[k]) for k in lists])], np.cumsum(size) - size, size

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        k = rows[WHERE].to_numpy(np.int64)
        ends = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if len(ends):
            yield from cut(rows.iloc[: ends[-1]], ends)
        held = rows.iloc[ends[-1] if len(ends) else 0 :]
    if held is not None and len(held):
        yield from cut(held, np.array([len(held)]))


def _described(rows: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray) -> Lists:
    b0, b1 = rows["b0"].to_numpy()[starts], rows["b1"].to_numpy()[starts]
    near = np.frombuffer(b"".join(rows["near"]), "<u4").reshape(len(rows), NEAREST).astype(np.int64)
    return Lists(starts, sizes, rows["key"].to_numpy(np.int64)[starts], b0 != b1, rows["block"].to_numpy(np.int64), near)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of lists that share SHARED pivots with another row there."""
    for rows, starts, sizes in _whole(batches):
        a, hit, short = _described(rows, starts, sizes), np.zeros(len(rows), bool), sizes <= SMALL
        if short.any():
            i, j = _few(a._replace(starts=starts[short], sizes=sizes[short], keys=a.keys[short], split=a.split[short]))
            hit[i] = hit[j] = True
        for k in np.flatnonzero(~short):
            z = slice(starts[k], starts[k] + sizes[k])
            hit[z] = _many(int(a.keys[k]), bool(a.split[k]), a.block[z], a.near[z]).any(1)
        yield rows.loc[hit, [*WHERE, "block", "id"]]


def _verified(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links between candidates: id, links, least."""
    for rows, starts, sizes in _whole(batches):
        a, short = _described(rows, starts, sizes), sizes <= SMALL
        x, ids, n = unit(rows["embedding"].tolist()), rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        if short.any():
            i, j = _few(a._replace(starts=starts[short], sizes=sizes[short], keys=a.keys[short], split=a.split[short]))
            hit = (x[i] * x[j]).sum(1) >= threshold
            u, v = np.concatenate([i[hit], j[hit]]), np.concatenate([j[hit], i[hit]])
            yield pd.DataFrame({"id": ids[u], "links": n[v], "least": np.minimum(ids[u], ids[v])})
        for k in np.flatnonzero(~short):
            z = slice(starts[k], starts[k] + sizes[k])
            linked = _many(int(a.keys[k]), bool(a.split[k]), a.block[z], a.near[z]) & (x[z] @ x[z].T >= threshold)
            some = np.flatnonzero(linked.any(1))
            if len(some):
                linked, own = linked[np.ix_(some, some)], ids[z][some]
                yield pd.DataFrame({"id": own, "links": linked @ n[z][some], "least": _closed(linked, own)})


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vectors: vec_id long, embedding array<float or double>, label int. One row per row: vec_id, n_links long, component_id long, kept boolean.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing: no links, their own
    vec_id. Vectors of different length aren't compared. Repeated rows, and rows with one vec_id, are vectors of their own; a null vec_id
    stays, with a null component unless it has links; columns other than the three are neither read nor returned; an empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    v = vectors.select("vec_id", "label", "embedding", (usable(F.col("embedding")) & F.col("label").isNotNull()).alias("ok"))
    v = v.select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    same = v.filter("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))

    number = n_pivots(vectors.count())

    @F.pandas_udf("binary")
    def pivot_order(embedding: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(embedding), dtype=object)
        for _, at in embedding.groupby(embedding.map(len)).groups.items():
            for i, near in zip(at, nearest(unit(embedding[at].tolist()), number), strict=True):
                out[i] = near.astype("<u4").tobytes()
        return out

    @F.pandas_udf("array<long>")
    def keys(near: pd.Series) -> pd.Series:
        return pd.Series(list(list_keys(np.frombuffer(b"".join(near), "<u4").reshape(len(near), NEAREST)))) if len(near) else pd.Series([], dtype=object)

    classes = staged(same.select("label", "h1", "h2", "rep", "n", "embedding", F.xxhash64("label", "h1", "h2").alias("id"), F.size("embedding").alias("dim"), pivot_order("embedding").alias("near")))
    keyed = staged(classes.select("id", "label", "dim", F.explode(keys("near")).alias("key")))
    where = WHERE[:3]
    long = keyed.groupBy(where).agg(F.count("*").alias("size")).filter("size > 1")
    listed = keyed.join(long, where).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*where, "id", "block", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"))
    full = dealt.join(classes.select("id", "near"), "id")
    near = staged(full.repartition(*WHERE).sortWithinPartitions(*WHERE).mapInPandas(_candidates, f"label {classes.schema['label'].dataType.simpleString()}, dim int, key long, b0 int, b1 int, block int, id long"))
    full = near.join(classes.select("id", "n", "embedding", "near"), "id")
    found = staged(full.repartition(*WHERE).sortWithinPartitions(*WHERE).mapInPandas(lambda it: _verified(it, threshold), "id long, links long, least long"))
    discard(keyed), discard(near)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    named = staged(classes.select("id", "label", "h1", "h2", "rep", "n").join(links, "id", "left").join(of, F.col("id") == F.col("node"), "left").select("label", "h1", "h2", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("root")))
    roots = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = named.join(roots, "root").select(*(F.col(c).alias(f"_{c}") for c in ("label", "h1", "h2")), (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    linked = v.filter("ok").join(known, (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("vec_id", "n_links", "component_id")
    alone = v.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
