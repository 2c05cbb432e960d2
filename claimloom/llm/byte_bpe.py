"""Byte-level BPE encoding by longest matches with backtracking, and decoding."""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.frames import Memo, map_slices

PIECES_AT_ONCE = 100_000
#: Pieces whose ids a worker holds twice over (see ``Memo``).
PIECES_HELD = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encodes pieces exactly as repeated lowest-rank merging would.

    A list of tokens is what merging gives if each adjacent pair is; so it is enough to walk from longest match to
    longest match, to take a shorter one where a pair doesn't hold, and to step back from positions that lead nowhere.
    No position is tried again once it has failed, so the time is linear in the text.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.bytes_of_text = {str(r): t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (len(token), rank))
        self.trie.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[tuple[int | None, int], bool] = {}
        self.memo = Memo(self._both, limit=PIECES_HELD)

    def _both(self, piece: str) -> tuple[str, bytes]:
        """A piece's ids as decimal text, and what they decode to."""
        ids = " ".join(map(str, self.piece(piece.encode())))
        return ids, self.decode(ids)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a single byte; None if merging never makes it."""
        if token not in self._halves:
            whole = self.bytes_of[token]
            parts = [whole[k : k + 1] for k in range(len(whole))]
            while len(parts) > 2:
                r, k = min(((self.ranks.get(a + b, token), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
                if r >= token:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known = len(parts) <= 2 and all(p in self.ranks for p in parts)
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[-1]]) if known else None
        return self._halves[token]

    def shorter(self, token: int) -> int | None:
        """The longest other token that this one begins with."""
        if token not in self._shorter:
            whole = self.bytes_of[token]
            found = (self.ranks.get(whole[:n]) for n in range(len(whole) - 1, 0, -1))
            self._shorter[token] = next((r for r in found if r is not None), None)
        return self._shorter[token]

    def fits(self, left: int | None, right: int) -> bool:
        """Whether merging makes ``right`` at all and leaves these two side by side; left is None at the start.

        Of the tokens that end ``left`` and those that begin ``right`` while they form, two merge across the border
        if their rank comes before the merges that use either up; among equal ranks the leftmost goes first.
        """
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            known = self.halves(right) is not None and (left is None or self._apart(self._edge(left, 1), self._edge(right, 0)))
            self._fits[left, right] = known
        return known

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """Each token on that side with the rank of the merge that uses it up."""
        out, used = [], float("inf")
        while True:
            out.append((self.bytes_of[token], used))
            halves = self.halves(token)
            if halves is None or halves == (token, token):
                return out
            used, token = token, halves[side]

    def _apart(self, ends: list[tuple[bytes, float]], begins: list[tuple[bytes, float]]) -> bool:
        for a, a_used in ends:
            for b, b_used in begins:
                r = self.ranks.get(a + b)
                if r is not None and r < a_used and r <= b_used:
                    return False
        return True

    def piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, size, known = len(piece), self.size, self._fits
        longest: list[int | None] = [None] * n
        reach = [0] * n
        for end, (length, rank) in self.trie.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                longest[start], reach[start] = rank, length
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, token, last = 0, longest[0], None
        while at < n:
            while token is not None:
                if not dead[at + size[token]]:
                    fit = known.get((last, token))
                    if fit is None:
                        fit = self.fits(last, token)
                    if fit:
                        break
                token = self.shorter(token)
            if token is None:
                if last is None:
                    raise ValueError(f"the vocabulary cannot write byte {piece[at]}")
                dead[at] = 1
                tokens.pop()
                at -= size[last]
                token = self.shorter(last)
                last = tokens[-1] if tokens else None
                continue
            tokens.append(token)
            at += size[token]
            last = token
            token = longest[at] if at < n else None
        return tokens

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of_text.__getitem__, ids.split(" "))) if ids else b""

    def blocks(self, text: str):
        """What ``_both`` gives for a text's pieces, in lists of bounded size."""
        if len(text) < 4 * PIECES_AT_ONCE:
            yield list(map(self.memo.__getitem__, self.pattern.findall(text)))
            return
        pieces = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(pieces, PIECES_AT_ONCE)):
            yield list(map(self.memo.__getitem__, some))

    def encode(self, text: str) -> list[int]:
        return [int(x) for block in self.blocks(text) for ids, _ in block for x in ids.split()]


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("whole"))


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids array<int> of each row's whole text; null and empty texts have no ids, repeated rows stay."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def make():
        bpe = ByteBpe(ranks.value, pattern)
        return lambda columns: ((key, bpe.encode(text)) for key, text in zip(*columns))

    return map_slices(_rows(df, id_col, text_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and data binary of each row's ids; null ids give null, an id outside the vocabulary is an error."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def make():
        bytes_of = {r: t for t, r in ranks.value.items()}
        return lambda columns: ((key, None if ids is None else b"".join(bytes_of[i] for i in ids)) for key, ids in zip(*columns))

    return map_slices(df.select(id_col, ids_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, data binary")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: each whole text encoded, and its ids decoded again.

    Null texts count as empty: 0 tokens and the digests of nothing. Repeated rows and null ids stay, one row each;
    other columns are left out, an empty table gives an empty result. Nothing is shuffled; ids of a long text are
    made, digested and decoded in blocks.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def make():
        bpe = ByteBpe(ranks.value, pattern)

        def step(columns):
            for key, text in zip(*columns):
                ids_hash, data_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                for block in bpe.blocks(text):
                    if block:
                        pieces, data = zip(*block)
                        ids = " ".join(pieces)
                        ids_hash.update((" " * (n > 0) + ids).encode())
                        data_hash.update(b"".join(data))
                        n += ids.count(" ") + 1
                yield key, n, ids_hash.hexdigest(), data_hash.hexdigest()

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(_rows(df, id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
