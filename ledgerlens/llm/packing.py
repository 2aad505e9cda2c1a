"""Packing documents into sequences by bin completion.

The plan is made on the histogram of lengths, which has at most `capacity` rows whatever the number of documents. It is a branch-and-bound search
(Korf 2002; dominance by Martello and Toth 1990): the next sequence takes the largest length left, and each branch is one undominated filling of
the rest of its room, those of least waste first and among them those of the largest lengths. Which sums the lengths left can make is known from
bit sets, so that the least waste is found without trying. A filling is dominated where a length left over fits into its waste, alone or in place of
shorter ones. The waste of a partial plan bounds it: a plan of no more sequences than the incumbent may waste just so much. The first incumbent is the
best-fit decreasing plan; every plan that the search completes replaces it, at first also one of as many sequences, since it leaves its waste in fewer
of them. The search goes back over all fillings and all numbers of their repetition until a plan meets the lower bound, no branch is left, or `nodes`
fillings were looked at; `Plan.proven` says whether the plan is known to be the best. A filling is at first repeated as often as the counts
allow, which exhausts a length, so that a dive has about as many steps as there are lengths.

Documents then take places by their rank among those of their length: ranks are counted by (length, bucket of
documents) and shifted by the counts of the buckets before, so that a length that a third of all documents share is no
single task. The search is a task of its own, on an executor.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from random import Random
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, vocabulary
from .common import ship, staged, table

CAPACITY, CLOSE = 4096, 1
#: Pre-tokens whose ids a worker keeps, and the longest that it keeps.
KEPT, LONG = 1_000_000, 64
#: Texts that are the same in all normal forms, and the vocabulary's pre-tokens in them once they are lowered.
LATIN = re.compile("[\x09-\x0d\x20-\x7eÀ-ÿ]*")
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-zß-öø-ÿ0-9]+")
SPACES = re.compile(r"[\x09-\x0d\x20]+")
#: Fillings that a search looks at before it leaves the plan unproven, and the deepest steps whose enumerations it holds; others are made anew.
NODES, LIVE = 20_000, 16
Run = tuple[int, int]  # a length and how often
Filling = tuple[Run, ...]  # longest first


class Plan(NamedTuple):
    bins: list[tuple[Filling, int]]  # a filling and how many sequences have it
    least: int  # no plan has fewer sequences
    proven: bool  # no plan has fewer sequences than this one
    searched: bool  # the bins come from the search, not from best fit

    @property
    def size(self) -> int:
        return sum(times for _, times in self.bins)


class Kept:
    """Values of the strings used last: what is not asked for while `most` / 2 others come in is forgotten."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def put(self, key, value):
        if len(key) <= LONG:
            if len(self.new) >= self.half:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


class Ids:
    """Token ids of texts, by the library, as little-endian bytes.

    Texts of ASCII and Latin letters, which no normal form changes, are lowered and cut into pre-tokens here, and the library's model gives
    the ids of those that aren't known. All others, and those that may hold a special string, are cut at white space, which no pre-token
    reaches over, and their words go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.pieces, self.words = Kept(KEPT), Kept(KEPT // 4)
        self.symbols = {b: ord(c) for b, c in enumerate(byte_symbols())}

    def piece(self, p: str) -> bytes:
        if (own := self.pieces.old.get(p)) is None:
            t = [t.id for t in self.model.tokenize(p.encode().decode("latin1").translate(self.symbols))]
            own = struct.pack(f"<{len(t)}I", *t)
        return self.pieces.put(p, own)

    def word(self, w: str) -> bytes:
        if (own := self.words.old.get(w)) is None:
            e = self.tokenizer.encode(w, add_special_tokens=False).ids
            own = struct.pack(f"<{len(e)}I", *e)
        return self.words.put(w, own)

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if LATIN.fullmatch(text) and not self.special.search(text):
            own, kept, new = PRETOKEN.findall(text.lower()), self.pieces, self.piece
        else:
            own, kept, new = [w for w in SPACES.split(text) if w], self.words, self.word
        found = list(map(kept.new.get, own))
        if None in found:
            found = [new(w) if f is None else f for w, f in zip(own, found, strict=True)]
        return b"".join(found)


@lru_cache(2)
def ids(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. doc_id, piece, start, length, ids_crc32 and, on demand, the ids (binary, little-endian unsigned 32-bit) of each piece.

    A null or empty text is one piece, the closing id alone; repeated rows and null doc_ids have pieces of their own; other columns are neither read nor
    returned; an empty table gives an empty result."""
    ship(docs.sparkSession)
    close = np.array([CLOSE], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = ids(path or vocabulary(name)).of
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                all_ids = of(text) + close
                for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    own = all_ids[at : at + 4 * capacity]
                    rows.append((None if doc is None else int(doc), k, k * capacity, len(own) // 4, zlib.crc32(own), *([own] * with_ids)))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=kind) for i, (c, kind) in enumerate([("doc_id", "Int64"), ("piece", "int32"), ("start", "int64"), ("length", "int64"), ("ids_crc32", "int64"), *([("ids", "object")] * with_ids)])})

    # as text, a null doc_id doesn't turn the others into floating-point numbers
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: each length goes to the open sequences of the least room that it fits into, equal sequences together."""
    out: list[tuple[Filling, int]] = []
    rooms: list[int] = []
    open_: dict[int, list[tuple[Filling, int]]] = {}
    shortest = min(counts, default=0)

    def put(room: int, filling: Filling, times: int) -> None:
        if room < shortest and times:
            out.append((filling, times))
        elif times:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((filling, times))

    for n in sorted(counts, reverse=True):
        k = counts[n]
        while k:
            if (at := bisect_left(rooms, n)) < len(rooms):
                room = rooms[at]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, filling, times = capacity, (), -(-k // (capacity // n))
            each = room // n  # what a sequence has taken makes it the one of least room again
            full = min(times, k // each)
            put(room - each * n, (*filling, (n, each)), full)
            k, times = k - full * each, times - full
            if k and times:
                put(room - k * n, (*filling, (n, k)), 1)
                k, times = 0, times - 1
            put(room, filling, times)
    return out + [b for own in open_.values() for b in own]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound (Martello and Toth's L2): those over half the capacity are alone among themselves, and the others of at least `a` need what room they leave."""
    n = np.array(sorted(counts), np.int64)
    k = np.array([counts[x] for x in n.tolist()], np.int64)
    number, length = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (k, n * k))
    half = int(np.searchsorted(n, capacity // 2, "right"))
    best = -(-length[-1] // capacity)
    for a in [0, *n[:half].tolist()]:
        low, high = int(np.searchsorted(n, a)), int(np.searchsorted(n, capacity - a, "right"))
        high = max(high, half)
        free = (number[high] - number[half]) * capacity - (length[high] - length[half])
        best = max(best, number[-1] - number[half] + max(0, -(-(length[half] - length[low] - free) // capacity)))
    return best


def _grown(sums: int, n: int, most: int, within: int) -> int:
    """The sums (a bit each) with up to `most` times n added."""
    part = 1
    while most > 0:
        part = min(part, most)
        sums |= (sums << n * part) & within
        most, part = most - part, part * 2
    return sums


def _spread(sums: int, by: int) -> int:
    """The sums and those up to `by` more."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        sums |= sums << step
        done += step
    return sums


def dominated(filling: Filling, waste: int, left: dict[int, int], open_: int) -> bool:
    """Does a length left over fit into the waste, alone or in place of shorter ones? left: before the filling, open_: its lengths as bits."""
    own, sums = 0, 1
    for n, k in filling:
        own |= 1 << n
        sums = _grown(sums, n, k, -1)
    if _spread(sums, waste) & open_ & ~own:
        return True
    for n, k in filling:
        if left[n] > k:  # one more of a length that the filling has: in place of others
            sums = 1
            for m, j in filling:
                if m < n:
                    sums = _grown(sums, m, j, -1)
            if _spread(sums, waste) >> n & 1:
                return True
    return False


def _fillings_of(total: int, upto: int, lengths: list[int], left: dict[int, int], sums: list[int], low: int = 1) -> Iterator[Filling]:
    """Fillings of just `total` by the first `upto` lengths, the last of them not before number `low`; sums[i]: what the first i make."""
    if not total:
        yield ()
        return
    a, b = low, upto + 1
    while a < b:  # what the first i make, the first i + 1 make
        mid = (a + b) // 2
        a, b = (a, mid) if sums[mid] >> total & 1 else (mid + 1, b)
    for last in range(a, upto + 1):
        n = lengths[last - 1]
        for k in range(1, min(left[n], total // n) + 1):
            if sums[last - 1] >> total - n * k & 1:
                for rest in _fillings_of(total - n * k, last - 1, lengths, left, sums):
                    yield (*rest, (n, k))


def fillings(left: dict[int, int], order: list[int], open_: int, room: int, allowed: int) -> Iterator[tuple[int, Filling | None]]:
    """The undominated fillings of `room` as (waste, filling), least waste first, none of more waste than `allowed`; for those that are dominated None.

    order: the lengths, ascending; open_: those that are left, as bits. An exact filling by the largest lengths comes before all sums are made."""
    within, lengths, sums, first = (1 << room + 1) - 1, [], [1], 0
    open_ &= within
    for at in range(bisect_right(order, room) - 1, -1, -1):
        n = order[at]
        if left[n]:
            lengths.append(n)
            sums.append(_grown(sums[-1], n, min(left[n], room // n), within))
            if not first and sums[-1] >> room & 1:
                first = len(lengths)
                for f in _fillings_of(room, first, lengths, left, sums):
                    yield 0, None if dominated(f, 0, left, open_) else f
    for waste in range(min(allowed, room) + 1):
        if sums[-1] >> room - waste & 1:
            for f in _fillings_of(room - waste, len(lengths), lengths, left, sums, 1 if waste else first + 1):
                yield waste, None if dominated(f, waste, left, open_) else f


class _Search:
    """Bin completion over the lengths left; `plan` is the best so far."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int):
        self.capacity, self.nodes = capacity, nodes
        self.left = {n: k for n, k in counts.items() if k > 0}
        self.order = sorted(self.left)
        self.open = sum(1 << n for n in self.order)
        self.least = least_sequences(self.left, capacity)
        self.plan = best_fit(self.left, capacity)
        self.most = sum(t for _, t in self.plan)  # sequences that a plan may have
        self.total = sum(n * k for n, k in self.left.items())
        self.used = self.waste = self.state = 0
        marks = Random(0)
        self.mark = {n: marks.getrandbits(128) for n in self.order}  # a state is the sum of the marks of the documents placed

    def allowed(self) -> int:
        return self.most * self.capacity - self.total - self.waste

    def take(self, filling: Filling, times: int) -> None:
        """Places `times` sequences; a negative number takes them back."""
        for n, k in filling:
            before = self.left[n]
            self.left[n] = now = before - k * times
            self.state += self.mark[n] * k * times
            if bool(before) != bool(now):
                self.open ^= 1 << n
                if now:
                    insort(self.order, n)
                else:
                    del self.order[bisect_left(self.order, n)]
        self.used += times
        self.waste += times * (self.capacity - sum(n * k for n, k in filling))

    def branches(self, after: tuple[Filling, int] | None = None) -> Iterator[tuple[Filling, int]]:
        """Fillings of the next sequence and how many sequences get them, most first; those that come after a given one."""
        longest, room = self.order[-1], self.capacity - self.order[-1]
        rest, order = dict(self.left), self.order.copy()
        rest[longest] -= 1
        open_ = self.open if rest[longest] else self.open ^ 1 << longest
        for waste, f in fillings(rest, order, open_, room, self.allowed()):
            self.nodes -= 1
            if self.nodes <= 0 or waste > self.allowed():
                return
            if f is None:
                continue
            whole = ((longest, 1 + f[0][1]), *f[1:]) if f and f[0][0] == longest else ((longest, 1), *f)
            if after is not None and whole != after[0]:
                continue
            most = min(self.left[n] // k for n, k in whole) if after is None else after[1] - 1
            after = None
            for times in range(min(most, self.allowed() // waste) if waste else most, 0, -1):
                if self.nodes <= 0 or waste * times > self.allowed():
                    break
                yield whole, times

    def run(self) -> Plan:
        """Depth first. A step is the branch that led to it, the one it has taken last, and, for the deepest, what comes next."""
        seen: dict[int, int] = {}
        stack: list[list] = [[None, None, self.branches()]] if self.order else []
        searched = not self.order
        while stack and self.nodes > 0:
            step = stack[-1]
            if step[2] is None:
                step[2] = self.branches(step[1])
            step[1] = branch = next(step[2], None)
            if branch is None:
                if (led := stack.pop()[0]) is not None:
                    self.take(led[0], -led[1])
                continue
            self.take(*branch)
            if not self.order:
                if self.used <= self.most:
                    self.plan = [led for led, *_ in stack[1:]] + [branch]
                    self.most, searched = self.used - 1, True
                    if self.used <= self.least:
                        return Plan(self.plan, self.least, True, True)
            elif self.allowed() >= 0 and self.used + 1 <= self.most and seen.get(self.state, self.used + 1) > self.used:
                seen[self.state] = self.used
                stack.append([branch, None, self.branches()])
                if len(stack) > LIVE:
                    stack[-LIVE - 1][2] = None
                continue
            self.take(branch[0], -branch[1])
        return Plan(self.plan, self.least, self.nodes > 0 or sum(t for _, t in self.plan) == self.least, searched)


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """Bin completion of a histogram of lengths, none of which is over the capacity."""
    return _Search(counts, capacity, nodes).run()


def places(plan: Plan) -> pd.DataFrame:
    """For each length, ranges of ranks: rank lo + i goes to sequence first + i % times, at offset at + i // times * length."""
    rows, taken, first = [], {}, 0
    for filling, times in plan.bins:
        at = 0
        for n, k in filling:
            rows.append((n, taken.get(n, 0), first, at, times))
            taken[n] = taken.get(n, 0) + times * k
            at += n * k
        first += times
    return pd.DataFrame(rows, columns=["length", "lo", "first", "at", "times"], dtype="int64").sort_values(["length", "lo"], kind="stable")


def ranked(cut: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """cut (of `pieces`, staged) with `rank`, from 0 among the rows of a length, without bringing the rows of a length together.

    Repeated rows get ranks of their own, in any order; null doc_ids come first in their bucket; an empty table gives an empty result."""
    buckets = min(65_536, max(32, cut.count() // bucket_rows))
    own = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = own.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("shift"))
    inside = own.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return inside.join(before, ["length", "bucket"]).withColumn("rank", F.col("nth") + F.col("shift")).drop("nth", "shift", "bucket")


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, **vocabulary_of) -> DataFrame:
    """docs: doc_id, text. Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, on demand, its ids.

    A null or empty text is one piece, the closing id alone; repeated rows and null doc_ids each get places of their own;
    other columns are neither read nor returned; an empty table gives an empty result.
    """
    cut = staged(pieces(docs, capacity=capacity, with_ids=with_ids, **vocabulary_of))

    def searched(histogram: pd.DataFrame) -> pd.DataFrame:
        return places(complete(dict(zip(histogram["length"].tolist(), histogram["n"].tolist(), strict=True)), capacity))

    # one task, on an executor, whatever the number of documents; its result has a row for each run of equal lengths in a filling
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).withColumn("one", F.lit(0))  # at most `capacity` rows
    at = staged(counts.groupBy("one").applyInPandas(searched, "length long, lo long, first long, at long, times long")).orderBy("length", "lo").toPandas()
    length, lo, first, offset, times = (at[c].to_numpy(np.int64) for c in ("length", "lo", "first", "at", "times"))
    # one sorted key for (length, lo): documents of a length have ranks below 2 ** 48
    key = (length << 48) | lo

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, n = b["rank"].to_numpy(np.int64), b["length"].to_numpy(np.int64)
            k = np.searchsorted(key, (n << 48) | rank, "right") - 1
            i = rank - lo[k]
            at = {"sequence_id": first[k] + i % times[k], "offset": offset[k] + i // times[k] * n}
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), **{c: b[c] for c in ("piece", "start", "length", "ids_crc32")}, **at, **{c: b[c] for c in ["ids"] * with_ids}})

    given = ranked(cut).withColumn("doc_id", F.col("doc_id").cast("string"))
    return given.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """packed (with ids). One row per sequence: sequence_id, n_tokens, ids (little-endian unsigned 32-bit, the pieces in order). A sequence is no longer
    than the capacity, and so is its group. A null or repeated doc_id makes no difference, nor do other columns; no rows: no sequences."""
    by = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    return by.select("sequence_id", "n_tokens", F.aggregate("own", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
