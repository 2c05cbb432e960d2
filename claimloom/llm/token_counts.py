"""Token counts of byte-level BPE by heap and linked list, without making ids."""

from __future__ import annotations

import heapq
import json
from itertools import islice

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.frames import Memo, map_slices

#: Pieces that a task holds at a time, so that one very long text needs bounded memory.
PIECES_AT_ONCE = 100_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where visible, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of pieces. ``merges`` are (left, right) pairs, best first."""

    def __init__(self, merges: list[tuple[str, str]], pattern: str, specials: list[str]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.symbols = byte_symbols()
        self.pattern = regex.compile(pattern)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.memo = Memo(self.piece)

    def piece(self, piece: str) -> int:
        """Symbols at first, less one for each merge; the lowest rank goes first, the leftmost among equals."""
        parts: list[str | None] = [self.symbols[b] for b in piece.encode()]
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue  # one side has merged since
            parts[k], parts[j] = a + b, None
            after[k] = i = after[j]
            if i < n:
                before[i] = k
            left -= 1
            if i < n and (r := rank.get((parts[k], parts[i]))) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[i]))
            if (h := before[k]) >= 0 and (r := rank.get((parts[h], parts[k]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[k]))
        return left

    def text(self, text: str) -> int:
        if not self.specials:
            return self._segment(text)
        segments = self.specials.split(text)
        return len(segments) - 1 + sum(map(self._segment, segments))

    def _segment(self, text: str) -> int:
        if len(text) < 4 * PIECES_AT_ONCE:
            return sum(map(self.memo.__getitem__, self.pattern.findall(text)))
        total, pieces = 0, (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(pieces, PIECES_AT_ONCE)):
            total += sum(map(self.memo.__getitem__, some))
        return total


def read_vocabulary(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges and special strings of a tokenizers file. Read on the driver; executors get the bounded list by broadcast."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
    return merges, [t["content"] for t in held["added_tokens"]]


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens above ``limit``) of each row's whole text.

    A null text counts as empty (0 bytes, 0 tokens). Null and repeated ids stay, one row each; columns beside id and
    text are left out, whatever their names; an empty table gives an empty result. Nothing is shuffled.
    """
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        counter = MergeCounter(held.value[0], pattern, held.value[1])

        def step(columns):
            for key, size, text in zip(*columns):
                n = counter.text(text)
                yield key, size, n, n > limit

        return step

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("whole"))
    return map_slices(rows, make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
