"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into the special strings of the vocabulary file and the pieces
between them by the byte-level pattern; each piece starts as one symbol per
UTF-8 byte.  A heap holds the adjacent pairs by (rank, place), a doubly linked
list the symbols; the lowest-ranked pair is merged until none has a rank.  The
count of a piece is its bytes minus its merges: no identifiers are produced.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from larkspur.llm.runtime import Shield, ship

#: Fixed value: the split pattern of byte-level BPE vocabularies, with Unicode's White_Space for \s.
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces remembered by a worker; at the bound it starts afresh.
REMEMBERED = 400_000
#: Longer pieces are counted each time, so that memory follows the bound.
LONGEST_REMEMBERED = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if visible in Latin-1, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PieceCounts(dict):
    """Token count by piece."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks = ranks
        self.symbols = byte_symbols()

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, piece: str) -> int:
        rank = self.ranks.get
        sym: list[str | None] = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(sym)
        if n < 2:
            return n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if j >= len(sym) or sym[i] != a or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = a + b, None
            merges += 1
            after[i] = k = after[j]
            if k < len(sym):
                before[k] = i
                if (r := rank((sym[i], sym[k]))) is not None:
                    heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := rank((sym[h], sym[i]))) is not None:
                heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level BPE without normaliser or added space is counted")
        merges = (m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.counts = PieceCounts({(a, b): i for i, (a, b) in enumerate(merges)})
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens that take in spaces or whole words aren't supported")
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.pieces = regex.compile(PIECE).findall

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return sum(map(self.counts.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.pieces(p))) for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of each text, as a column.  ``vocabulary`` is a path on every executor."""

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        one = counter(vocabulary)
        return pa.array([one(t.as_py()) for t in texts], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of its text column, written to column ``into`` (one of that name is replaced).

    Null and empty texts have 0 tokens; repeated rows are each counted; other
    columns pass through; an empty table stays empty.  Memory of a worker: one
    Arrow batch and REMEMBERED pieces of at most LONGEST_REMEMBERED characters.
    """
    ship(docs.sparkSession)
    own = Shield(docs)
    return own.restore(own.inner.withColumn(into, token_count(F.col(own(text)), vocabulary)), into)
