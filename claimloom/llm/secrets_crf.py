"""Secret scans: patterns, and a linear-chain conditional random field over white-space tokens decoded by Viterbi."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.frames import Memo, map_slices

#: Fixed patterns, least lengths and order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs; shorter ones fail in any case
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "crf")
#: What ASSIGN needs somewhere in a text: a word (in lower case) to look for first, as it is far faster.
STEMS = ("passw", "secret", "token", "api")

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: The field is fitted on windows of at most so many documents with base spans (the first by a hash of the id), a few
#: windows each, and as many windows without any.
TRAIN_DOCUMENTS, WINDOWS_EACH, REACH = 1500, 3, 12
WIDTH = 1 << 14

_TOKEN = re.compile(r"\S+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, leftmost and not overlapping within a kind, by start, then kind."""
    out = []
    low = text.lower()
    if any(s in low for s in STEMS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _shape(word: str) -> str:
    """Runs of upper, lower, digit and other characters, each as one mark."""
    out = []
    for ch in word[:48]:
        m = "9" if ch.isdigit() else "X" if ch.isupper() else "x" if ch.isalpha() else ch if ch in "=:_-./+\"'" else "#"
        if not out or out[-1] != m:
            out.append(m)
    return "".join(out[:12])


_CUE = re.compile(r"passw|secret|token|api_?key|credential|bearer|private|access|AKIA", re.I | re.A)


def _traits(word: str) -> list[str]:
    """What one token says of itself: its shape, length, mixture, variety and cue words."""
    core = word.strip("\"'`,;()[]{}<>.")
    n, digits = len(core), sum(c.isdigit() for c in core)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    return [
        "s:" + _shape(word), f"n:{min(10, n // 4)}", f"d:{min(8, 8 * digits // max(1, n))}", f"c:{min(6, changes)}",
        f"v:{min(8, 8 * len(set(core)) // max(1, n))}", f"k:{_CUE.search(word) is not None}", f"e:{word[-1:] in ':='}",
        f"a:{'=' in word or ':' in word}", f"l:{core.isalpha()}", f"h:{n >= 8 and set(core.lower()) <= set('0123456789abcdef')}:{n // 8 if n < 80 else 10}",
    ]


def _slots(place: str, traits: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(f"{place}{t}".encode()) % WIDTH for t in traits], np.int64)


def _own(word: str) -> np.ndarray:
    return _slots("0", _traits(word))


#: Turns a word's slot into the one of the word as neighbour at a place.
_PLACES = {p: zlib.crc32(f"place {p}".encode()) % WIDTH for p in "-+"}


def _word_slot(word: str) -> int:
    """The slot of which word it is, of its first 200 characters (as in the windows) in lower case."""
    return zlib.crc32(f"w:{word[:200].lower()}".encode("utf-8", "replace")) % WIDTH


def _side(place: str, word: str) -> np.ndarray:
    """What a token says of its neighbour: which word it is, and what ``_side_kind`` tells."""
    return np.append(_side_kind(place, word), _word_slot(word) ^ _PLACES[place])


def _side_kind(place: str, word: str) -> np.ndarray:
    """What a token says of its neighbour without the word itself; a cue is told by its letters too."""
    t = _traits(word)
    cue = _CUE.search(word)
    return _slots(place, [t[0], t[5], t[6], t[7], t[8], f"w:{cue.group().lower() if cue else ''}"])


def _kind(word: str):
    """What decides the traits of a plain word (letters, perhaps one mark after them): words of one kind have the same. Others are their own kind."""
    core = word if word.isalpha() else word[:-1] if word[-1:] in ",.;?!" and word[:-1].isalpha() else ""
    if not core or len(core) > 40 or _CUE.search(word):
        return word
    case = "x" if core.islower() else "X" if core.isupper() else "Xx" if core[0].isupper() and core[1:].islower() else None
    if case is None:
        return word
    n, low = len(core), set(core.lower())
    return case, word[n:], n // 4, 8 * len(set(core)) // n, n >= 8 and low <= _HEX and n // 8


_HEX = frozenset("0123456789abcdef")


def _flags(word: str) -> tuple[bool, bool]:
    """Whether a token looks like an assignment, and whether it mixes in digits."""
    return "=" in word or ":" in word, not word.isalpha() and any(c.isdigit() for c in word)


def _file(n: int, assigning: float, digits: float) -> np.ndarray:
    """What the whole text says: how many tokens it has, and which shares of them are assignments or have digits."""
    return _slots("f", [f"n:{n.bit_length()}", f"a:{int(20 * assigning)}", f"d:{int(20 * digits)}"])


def _file_of(words: list[str]) -> np.ndarray:
    flags = np.array([_flags(w) for w in words], float).reshape(-1, 2)
    return _file(len(words), *(flags.mean(0) if len(words) else (0.0, 0.0)))


@dataclass
class Field:
    weights: np.ndarray  # of each feature for the three tags
    steps: np.ndarray  # from tag to tag

    def gain(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(0)


def viterbi(gains: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best tags of a chain that OUTSIDE stands before and after.

    Where OUTSIDE leads by more than any change of two steps can weigh, the best chain has it; only the stretches in
    between are decoded, one by one. This gives the same tags as decoding the whole chain.
    """
    out = np.zeros(len(gains), np.int8)
    room = (steps.max(1)[:, None] + steps.max(0)[None] - steps[:, :1] - steps[:1]).max()
    open_ = np.flatnonzero(gains[:, 0] - gains[:, 1:].max(1) <= room)
    if not len(open_):
        return out
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
        back = []
        best = steps[OUTSIDE] + gains[part[0]]
        for k in part[1:]:
            all_ = best[:, None] + steps
            back.append(all_.argmax(0))
            best = all_.max(0) + gains[k]
        tag = int((best + steps[:, OUTSIDE]).argmax())
        for k in range(len(part) - 1, -1, -1):
            out[part[k]] = tag
            if k:
                tag = int(back[k - 1][tag])
    return out


def fit(windows: list[tuple[list[str], list[int], list[int]]], steps: int = 60, decay: float = 1e-4) -> Field:
    """Maximum likelihood by forward-backward over all windows at once and Adam. A window: tokens, tags, the file's features."""
    w, t = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    t[OUTSIDE, INSIDE] = -4.0  # never seen, so it stays low
    if not windows:
        w[:, OUTSIDE] = 1.0
        return Field(w, t)
    n, longest = len(windows), max(len(x[0]) for x in windows)
    rows, cols, tags, mask = [], [], np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (words, y, file_slots) in enumerate(windows):
        for j, word in enumerate(words):
            f = np.concatenate([_own(word), _side("-", words[j - 1]) if j else [], _side("+", words[j + 1]) if j + 1 < len(words) else [], file_slots]).astype(np.int64)
            rows.append(np.full(len(f), i * longest + j))
            cols.append(f)
        tags[i, : len(y)], mask[i, : len(y)] = y, True
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    truth = np.eye(3)[tags] * mask[..., None]
    first, second = np.zeros((WIDTH + 3, 3)), np.zeros((WIDTH + 3, 3))
    for k in range(1, steps + 1):
        e = np.stack([np.bincount(rows, weights=w[cols, s], minlength=n * longest) for s in range(3)], 1).reshape(n, longest, 3)
        e = np.where(mask[..., None], e, np.array([0.0, -1e9, -1e9]))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = t[OUTSIDE] + e[:, 0]
        for j in range(1, longest):
            alpha[:, j] = _lse(alpha[:, j - 1][:, :, None] + t) + e[:, j]
        beta[:, -1] = t[:, OUTSIDE]
        for j in range(longest - 2, -1, -1):
            beta[:, j] = _lse((t + (e[:, j + 1] + beta[:, j + 1])[:, None, :]).transpose(0, 2, 1))
        total = _lse((alpha[:, -1] + t[:, OUTSIDE])[:, :, None])[:, 0]
        p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        seen = (truth[:, :-1, :, None] * truth[:, 1:, None, :]).sum((0, 1))
        gt = (pair.sum((0, 1)) - seen) / n
        flat = (p - truth).reshape(-1, 3)
        gw = np.stack([np.bincount(cols, weights=flat[rows, s], minlength=WIDTH) for s in range(3)], 1) / n + decay * w
        g = np.concatenate([gw, gt])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.1 * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        w, t = w - step[:WIDTH], t - step[WIDTH:]
    return Field(w, t)


def _lse(x: np.ndarray) -> np.ndarray:
    m = x.max(1, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(1, keepdims=True)))[:, 0]


def tagged(text: str) -> tuple[list[str], list[tuple[int, int]], list[int]]:
    """Tokens, their places, and tags after the base spans: BEGIN for a span's first token, INSIDE for its others."""
    found = [(m.group(), m.span()) for m in _TOKEN.finditer(text)]
    tags, spans, at = [], base_spans(text), 0
    last = None
    for _, (a, b) in found:
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        hit = next((s for s in spans[at : at + 8] if s[0] < b and s[1] > a), None)
        tags.append(OUTSIDE if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
    return [w for w, _ in found], [s for _, s in found], tags


def windows_of(text: str) -> list[tuple[list[str], list[int], list[int]]]:
    """Windows around a text's first, middle and last base spans, and as many without any."""
    words, _, tags = tagged(text)
    file_slots = _file_of(words).tolist()
    begins = [k for k, t in enumerate(tags) if t == BEGIN]
    chosen = begins if len(begins) <= WINDOWS_EACH else [begins[0], begins[len(begins) // 2], begins[-1]]
    out = [(words[max(0, k - REACH) : k + REACH], tags[max(0, k - REACH) : k + REACH], file_slots) for k in chosen]
    out = [(w, [BEGIN if j == 0 and t == INSIDE else t for j, t in enumerate(y)], f) for w, y, f in out]
    for k in range(0, len(words), max(2 * REACH, len(words) // (WINDOWS_EACH + 1))):
        if not any(tags[k : k + 2 * REACH]) and len(out) < 2 * WINDOWS_EACH:
            out.append((words[k : k + 2 * REACH], tags[k : k + 2 * REACH], file_slots))
    return out


def varied(windows: list, seed: int = 3) -> list:
    """The windows, and each that has a span once more with another cue, sign and value in its place and another plain
    word after it, so that the field learns contexts and shapes beyond the patterns that tagged them and does not lean
    on the one word that happened to follow."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    cues, signs = ["token", "secret", "password", "api_key", "bearer", "credential", "access_key", "private_key"], ["is", ":", "=", "->", ""]
    out = list(windows)
    plain = sorted({w for words, tags, _ in windows for w, t in zip(words, tags) if t == OUTSIDE and w.isalpha()})
    for words, tags, file_slots in windows:
        if BEGIN in tags:
            k = tags.index(BEGIN)
            after = next((j for j in range(k + 1, len(tags)) if tags[j] != INSIDE), len(tags))
            value = "".join(letters[rng.integers(0, len(letters), rng.integers(16, 44))])
            cue = [c for c in (str(rng.choice(cues)), str(rng.choice(signs))) if c]
            rest = list(words[after:])
            if rest and tags[after] == OUTSIDE and plain:
                rest[0] = plain[rng.integers(len(plain))]
            out.append(([*words[:k], *cue, value, *rest], [*tags[:k], *[OUTSIDE] * len(cue), BEGIN, *tags[after:]], file_slots))
    return out


class Scanner:
    def __init__(self, field: Field):
        self.field = field
        self.rows: dict = {}
        self.memo = Memo(self._row)
        self._clear()

    def _clear(self) -> None:
        self.rows.clear()
        self.memo.forget()
        self.table = np.zeros((4096, 11))
        self.used = 0

    def _row(self, word: str) -> int:
        """The row of the word's kind and the slot of the word, as one number."""
        kind = _kind(word)
        row = self.rows.get(kind)
        if row is None:
            row = self.rows[kind] = self._add(word)
        return row * WIDTH + _word_slot(word)

    def _add(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        f = self.field
        self.table[self.used] = np.concatenate([f.gain(_own(word)), f.gain(_side_kind("-", word)), f.gain(_side_kind("+", word)), _flags(word)])
        self.used += 1
        return self.used - 1

    def gains(self, words: list[str]) -> np.ndarray:
        if self.used > 300_000:
            self._clear()
        ids, slots = np.divmod(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)), WIDTH)
        x = self.table[ids]
        out = x[:, :3] + self.field.gain(_file(len(words), *x[:, 9:].mean(0).tolist()))
        out[1:] += x[:-1, 3:6] + self.field.weights[slots[:-1] ^ _PLACES["-"]]
        out[:-1] += x[1:, 6:9] + self.field.weights[slots[1:] ^ _PLACES["+"]]
        return out

    def __call__(self, text: str) -> tuple[list, list]:
        """(base spans, all spans): the field adds what it tags and no base span touches."""
        base = base_spans(text)
        words = text.split()
        added = []
        if words:
            tags = viterbi(self.gains(words), self.field.steps)
            if tags.any():
                wanted = np.flatnonzero(tags)
                places, at = {}, 0
                spots = _TOKEN.finditer(text)
                for k in wanted.tolist():
                    m = next(islice(spots, k - at, None))
                    places[k], at = m.span(), k + 1
                for k in wanted.tolist():
                    if tags[k] == BEGIN or k == 0 or tags[k - 1] == OUTSIDE:
                        added.append(list(places[k]))
                    else:
                        added[-1][1] = places[k][1]
                added = [(a, b, 3) for a, b in added if not any(s < b and e > a for s, e, _ in base)]
        return base, sorted([*base, *added], key=lambda x: (x[0], x[2]))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted on windows of at most ``TRAIN_DOCUMENTS`` documents that hold base spans, tagged by these."""
    text = F.col(text_col)
    likely = text.rlike(r"(?i)(passw|secret|token|api_?key)[a-z]*[\"']?\x20*[:=]") | text.contains("AKIA") | text.rlike("[0-9a-f]{16}")
    ids = df.where(likely & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_DOCUMENTS)
    ids = df.sparkSession.createDataFrame(ids.collect(), ids.schema)

    def make():
        def step(columns):
            for doc, text in zip(*columns):
                for k, (words, tags, file_slots) in enumerate(windows_of(text or "")):
                    yield doc, k, [w[:200] for w in words], tags, file_slots

        return step

    rows = df.select(F.col(id_col), F.col(text_col).alias("__t")).join(F.broadcast(ids), F.col(id_col) == F.col("__id")).select("__id", "__t")
    found = map_slices(rows.select(F.col("__id").cast("string"), "__t"), make, "id string, k int, words array<string>, tags array<int>, file array<long>")
    held = sorted((r["id"], r["k"], r["words"], r["tags"], r["file"]) for r in found.toLocalIterator())
    return fit(varied([(w, y, f) for _, _, w, y, f in held if w]))


def scan(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of each row's whole text.

    Base spans are the patterns' whole matches; the field adds spans of kind ``crf`` that touch none of them. Places
    are code points, ends exclusive. Null texts count as empty: no spans. Null and repeated ids stay, one row each;
    other columns are left out. Nothing is shuffled; the field has a fixed size.
    """
    held = df.sparkSession.sparkContext.broadcast(field)

    def make():
        scanner = Scanner(held.value)

        def step(columns):
            for doc, text in zip(*columns):
                base, spans = scanner(text or "")
                n = [sum(k == j for _, _, k in base) for j in range(3)]
                yield doc, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
