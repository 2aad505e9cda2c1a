"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text starts as its bytes, one symbol each. All adjacent pairs that have a rank are in a heap; the pair
of the lowest rank (the leftmost among equals) is popped and merged again and again, and the linked list gives its new
neighbours, whose pairs are pushed. The count is the number of initial symbols less the number of merges: no token
ids are ever looked up or emitted.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

LIMIT = 1024
#: Chunks and pre-tokens whose counts a worker keeps; then it starts anew, so that memory stays bounded.
KEPT = 400_000
#: A blank stretch and the word after it. No pre-token reaches from one such chunk into the next.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Blank to Python's \s, not to Unicode's White_Space: texts with these aren't cut into chunks.
ODD = re.compile("[\x1c-\x1f]")
#: The pre-tokens of byte-level vocabularies.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens as the vocabulary file at `path` (tokenizers, byte-level BPE) gives them, without added ones."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        number: dict[str, int] = {s: b for b, s in enumerate(byte_symbols())}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((number[a], number[b]), (rank, number.setdefault(a + b, len(number))))
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one pre-token."""
        sym = list(text.encode("utf-8", "surrogatepass"))
        n = len(sym)
        if n < 2:
            return n
        merge = self.merge
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(merge[p][0], i, p) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in merge]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or sym[i] != pair[0] or sym[j] != pair[1]:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = merge[pair][1], -1
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (p := (sym[i], sym[k])) in merge:
                    heapq.heappush(heap, (merge[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (sym[h], sym[i])) in merge:
                heapq.heappush(heap, (merge[p][0], h, p))
        return n - merges

    def pretokens(self, text: str) -> int:
        known, total = self.pieces, 0
        for piece in PRETOKEN.findall(text):
            n = known.get(piece)
            if n is None:
                n = self.piece(piece)
                if len(piece) <= 64:
                    if len(known) >= KEPT:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if ODD.search(text):
            return self.pretokens(text)
        known, total = self.chunks, 0
        for chunk in CHUNK.findall(text):
            n = known.get(chunk)
            if n is None:
                n = self.pretokens(chunk)
                if len(chunk) <= 64:
                    if len(known) >= KEPT:
                        known.clear()
                    known[chunk] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        """A special string inside the text is one token, as is the library's default."""
        if not text:
            return 0
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        return len(self.at_special.findall(text)) + sum(map(self.plain, self.at_special.split(text)))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies has a file; on executors it may lie elsewhere than on the driver."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k.json", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes long, n_tokens long and over_limit boolean; path: of a vocabulary file that all executors can read.

    Null and empty texts have no bytes and no tokens; every row keeps its place, repeated rows and null doc_ids included; columns
    named like the three are replaced; an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        count = counter(path or vocabulary(name)).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    n = docs.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).withColumn("n_tokens", tokens(F.col(text)))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
