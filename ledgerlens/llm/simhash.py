"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. At most two differing bits leave one segment at
least untouched, and two or fewer in each other one. The binary Golay code [23, 12, 7] is perfect: every word lies within
3 of one codeword. A word's keys are the codewords within 4 of it, of which there are one or six, and words at
distance 2 or less share one (the codeword nearest to a word midway between them). So every pair of fingerprints to be linked agrees
on (untouched segment, a Golay key of the next segment) for one of the three segments: the candidates are joined on that and
verified by counting differing bits.

Equal fingerprints are one node before any join. A list of n different fingerprints costs the square of n as pairs, which a crowd of near copies makes
too many. The members of lists longer than `max_list` are therefore verified by a star instead, with 65 rows for each and no pair emitted: each names the
words within one bit of it, and all that name a word are joined to the smallest of them. This is exact. Two that name one word w differ from it in one
bit each, so from each other in two at most: no link too many. Two that differ in two bits or fewer both name the word that has one of the differing bits of
one and all others of the other (or either of them, if they differ in one): no link is lost. Which lists are crowded only decides how their members are
verified; the components are the same for every `max_list`, which the tests show against all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ship, staged, table
from .components import components

SEED, WIDTH, DISTANCE = 42, 3, 2
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def _syndrome(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 23 single bits by byte, and for each syndrome the error words of weight up to 4 (-1: none)."""
    unit = [_syndrome(1 << i) for i in range(23)]
    by_byte = np.zeros((3, 256), np.int32)
    for k in range(3):
        for b in range(256):
            for i in range(8):
                if b >> i & 1 and 8 * k + i < 23:
                    by_byte[k, b] ^= unit[8 * k + i]
    found: list[list[int]] = [[] for _ in range(2048)]

    def grow(word: int, syndrome: int, first: int, left: int) -> None:
        found[syndrome].append(word)
        if left:
            for i in range(first, 23):
                grow(word | 1 << i, syndrome ^ unit[i], i + 1, left - 1)

    grow(0, 0, 0, 4)
    errors = np.full((2048, 6), -1, np.int64)
    for s, own in enumerate(found):
        errors[s, : len(own)] = own
    return by_byte, errors, (errors >= 0).sum(1)


BY_BYTE, ERRORS, N_ERRORS = _tables()


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of the codewords within 4 of it: n x 6, -1 where there is just one."""
    w = words.astype(np.int64)
    s = BY_BYTE[0, w & 255] ^ BY_BYTE[1, w >> 8 & 255] ^ BY_BYTE[2, w >> 16]
    e = ERRORS[s]
    return np.where(e >= 0, (w[:, None] ^ e) >> 11, -1)


def fingerprint_keys(prints: np.ndarray) -> list[list[int]]:
    """The join keys of each fingerprint (int64): which segment is taken to be untouched, its bits, a Golay key of the next one."""
    u = prints.astype(np.int64).view(np.uint64)
    part = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    out = []
    for i in range(3):
        g = golay_keys(part[(i + 1) % 3])
        out.append(np.where(g >= 0, (i << 40) | (part[i][:, None] << 12) | g, -1))
    return [row[row >= 0].tolist() for row in np.concatenate(out, 1)]


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    if not words:
        return []
    x = xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return [x(b" ".join(words), SEED)]
    return [x(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:], strict=False))]


def _ones(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """How often each of the 64 bits is set in each run of `sizes` hashes. Eight counters of a byte are added at once, over 255 hashes at most."""
    h = np.array(hashes, np.uint64)
    lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    ends = np.cumsum(sizes)
    parts = [np.arange(e - n, e, 255) for e, n in zip(ends, sizes, strict=True)]
    few = np.add.reduceat(lanes, np.concatenate(parts), axis=0).view(np.uint8)
    first = np.cumsum([0, *map(len, parts[:-1])])
    return np.add.reduceat(few, first, axis=0, dtype=np.int64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """64-bit SimHash of each text, as int64."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    held: list[int] = []
    spans: list[tuple[int, int]] = []

    def flush() -> None:
        if spans:
            n = [k for _, k in spans]
            out[[i for i, _ in spans]] = np.where(2 * _ones(held, n) > np.array(n)[:, None], weights, np.uint64(0)).sum(1, dtype=np.uint64)
            held.clear(), spans.clear()

    for i, text in enumerate(texts):
        own = shingle_hashes(text)
        if len(own) > BLOCK:  # a very long text is counted block by block
            ones = sum(_ones(own[a : a + BLOCK], [len(own[a : a + BLOCK])])[0] for a in range(0, len(own), BLOCK))
            out[i] = np.where(2 * ones > len(own), weights, np.uint64(0)).sum(dtype=np.uint64)
        elif own:
            held += own
            spans.append((i, len(own)))
            if len(held) > BLOCK:
                flush()
    flush()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.tolist()))

    return docs.withColumn("fp", fp(F.col(text)))


def fingerprint_links(prints: DataFrame, max_list: int = 64) -> DataFrame:
    """prints: distinct fp (long). Edges (u, v) that join exactly the fingerprints reachable by links of DISTANCE bits or fewer.

    Null fingerprints have no keys and no edges; repeated ones add nothing; no fingerprints: no edges; other columns aren't read."""
    ship(prints.sparkSession)

    @F.pandas_udf("array<long>")
    def keys(fp: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_keys(fp.to_numpy()))

    keyed = staged(prints.select("fp", F.explode(keys("fp")).alias("key")))
    size = keyed.groupBy("key").agg(F.count("*").alias("n"))
    few, many = size.filter(f"n between 2 and {max_list}").select("key"), size.filter(f"n > {max_list}").select("key")
    listed = keyed.join(few, "key")
    pairs = listed.select("key", F.col("fp").alias("u")).join(listed.select("key", F.col("fp").alias("v")), "key").filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64))]
    crowded = keyed.join(many, "key", "left_semi").select("fp").distinct()
    around = crowded.select("fp", F.explode(F.array(*near)).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = around.join(least, "word").select(F.col("fp").alias("u"), "v").filter("u <> v")
    return pairs.select("u", "v").unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, max_list: int = 64) -> DataFrame:
    """docs: doc_id long, text. One row per row of docs: doc_id, fp long, component_id.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other; repeated
    rows stay, each with the same component; a null doc_id stays and never names a component unless all members'
    are null; columns other than doc_id and text are neither read nor returned; an empty table gives an empty result.
    """
    hashed = staged(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    reps = staged(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(fingerprint_links(reps.select("fp"), max_list))
    known = staged(reps.join(of, reps.fp == of.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return hashed.join(known.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near-duplicates; one with the smallest doc_id stays. Every column is kept.

    Of repeated rows with that doc_id one stays; a group without any doc_id keeps one row."""
    own = fresh("row", docs.columns)
    held = staged(docs.withColumn(own, F.monotonically_increasing_id()))  # numbers that later reads repeat
    found = near_duplicates(held.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(own).alias("row")).alias("doc_id"), "text"))
    first = found.filter("component_id = doc_id").select(F.col("doc_id.row").alias(own))
    return held.join(first, own, "left_semi").drop(own)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

