"""LM scoring by a log-bilinear model trained in numpy with noise-contrastive estimation.

Words fall into ``CLASSES`` classes: the text's end, the most frequent words one by one, and the others by their last
bytes. A first log-bilinear model gives a word's class from the classes of the two words before; within its class a word
has its smoothed share of the class. On top of it stands a log-bilinear model over words: each of the ``HEAD_WORDS`` most
frequent words, and each class of the rarer ones, has a vector as context and one as target, and their product is added
to the first model's log probability. The vectors are trained by noise-contrastive estimation on every position of all
training texts, in all tasks, and meet word by word.

A score is a probability: words are leaves of a tree of classes, groups of words with like vectors, and words. Each level
divides out the sum over its choices (see ``Tree``), so the probabilities of all words after a context sum to one.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import frames
from claimloom.llm.components import checkpoint_folder
from claimloom.llm.frames import crc_remainder, map_slices, word_list

#: Classes: 0 is the end, then single words, then ``SHAPES`` classes by shape.
CLASSES, SHAPES, DIMENSIONS, NOISE = 64, 32, 16, 8
#: Words whose counts all tasks hold, of at most ``KEY_BYTES`` bytes each; rarer ones are joined.
HEAD_WORDS, KEY_BYTES = 1 << 18, 24
#: Words that a task counts before it hands them on.
COUNTED_AT_ONCE = 300_000
#: Word vectors: positions in a step and the noise words that they share, positions held at a time, and rounds over them
#: (more for few: ``LEAST_STEPS`` steps at least).
BATCH, SHARED, HELD_POSITIONS, ROUNDS, LEAST_STEPS, RATE = 1024, 32, 1 << 20, 1, 400, 0.1
#: Words whose vectors meet in one row of the exchange.
BLOCK = 1024
#: Positions that are scored at a time, rows of a product of matrices, and what bounds the exponents of a tree.
SCORED_AT_ONCE, PRODUCT_ROWS, BOUND = 1 << 17, 512, 60
END = b""


def word_key(word: bytes) -> bytes:
    """The word, or as many bytes that stand for a longer one."""
    return word if len(word) <= KEY_BYTES else b"\x00" + hashlib.blake2b(word, digest_size=KEY_BYTES - 1).digest()


def shape(word: bytes) -> int:
    return CLASSES - SHAPES + crc32(word[-3:]) % SHAPES


def tokens(text: bytes | None) -> list[bytes]:
    """Words, then one end."""
    return [*word_list(text), END]


def log_bilinear(triples: np.ndarray, steps: int = 300) -> np.ndarray:
    """log10 P(class | two classes before), normalised, as [before that, before, class].

    triples: counts in that shape. Word vectors R and Q, a matrix for each place and a bias; the score of a class is
    the product of its Q with what the context predicts. Each step takes all counts; the noise, ``NOISE`` classes by
    frequency for each token, enters by expectation.
    """
    c = triples.shape[0]
    n = triples.reshape(c * c, c).astype(np.float64)
    total = n.sum()
    if total == 0:
        return np.full((c, c, c), -math.log10(c))
    noise = (n.sum(0) + 1) / (total + c)
    rng = np.random.default_rng(7)
    p = {"R": rng.normal(0, 0.1, (c, DIMENSIONS)), "Q": rng.normal(0, 0.1, (c, DIMENSIONS)), "A": np.eye(DIMENSIONS), "B": 0.5 * np.eye(DIMENSIONS), "b": np.log(noise)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    far, near = np.divmod(np.arange(c * c), c)
    of_context, shift = n.sum(1, keepdims=True) / total, np.log(NOISE * noise)
    n = n / total
    for t in range(1, steps + 1):
        h = p["R"][near] @ p["A"] + p["R"][far] @ p["B"]
        s = 1 / (1 + np.exp(-np.clip(h @ p["Q"].T + p["b"] - shift, -30, 30)))
        d = NOISE * of_context * noise * s - n * (1 - s)
        dh = d @ p["Q"]
        by_near, by_far = dh.reshape(c, c, -1).sum(0), dh.reshape(c, c, -1).sum(1)
        g = {"Q": d.T @ h, "b": d.sum(0), "A": p["R"].T @ by_near, "B": p["R"].T @ by_far, "R": by_near @ p["A"].T + by_far @ p["B"].T}
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.05 * (1 - t / (steps + 1)) * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-12)
    s = (p["R"][near] @ p["A"] + p["R"][far] @ p["B"]) @ p["Q"].T + p["b"]
    s -= s.max(1, keepdims=True)
    return ((s - np.log(np.exp(s).sum(1, keepdims=True))) / math.log(10)).reshape(c, c, c)


def _word_counts(rows: DataFrame) -> DataFrame:
    def make():
        class Step:
            held: Counter = Counter()

            def __call__(self, columns):
                for text in columns[0]:
                    self.held.update(tokens(text))
                return self.finish() if len(self.held) > COUNTED_AT_ONCE else ()

            def finish(self):
                held, self.held = self.held, Counter()
                return ((word_key(w), shape(w), n) for w, n in held.items())

        step = Step()
        step.held = Counter()
        return step

    return map_slices(rows, make, "key binary, shape int, c long").groupBy("key").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


class Numbers(dict):
    """Numbers of words by key; what it lacks is found by its key, if that is another, or by its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > KEY_BYTES and (key := word_key(word)) in self:
            return self[key]
        return len(self) + crc32(word[-3:]) % SHAPES

    def sequence(self, found: list[bytes]) -> np.ndarray:
        """The numbers of words after two ends."""
        seq = np.full(len(found) + 2, self[END], np.int32)
        seq[2:] = np.fromiter(map(self.__getitem__, found), np.int32, len(found))
        return seq


def _numbered(rows: DataFrame, number: Numbers, end_known: bool) -> DataFrame:
    """id, signature of the text, h, the numbers of its tokens after two ends (``seq``), and the keys of those without a count of their own (``far``), each after its length.

    Each text is cut into words and looked up here once, for the classes, the vectors and the scores.
    """
    sent = rows.sparkSession.sparkContext.broadcast(number)

    def make():
        number = sent.value
        end, own = number[END], len(number)

        def step(columns):
            for doc, text, h in zip(*columns):
                found = tokens(text)
                seq = number.sequence(found)
                far = seq[2:] >= own
                if not end_known:
                    far |= seq[2:] == end
                keys = [word_key(found[k]) for k in np.flatnonzero(far).tolist()]
                sig = int.from_bytes(hashlib.blake2b(text or b"", digest_size=8).digest(), "little", signed=True)
                yield doc, sig, h, seq.tobytes(), b"".join([b"%c%b" % (len(k), k) for k in keys])

        return step

    kind = rows.schema["id"].dataType.simpleString()
    return map_slices(rows.select("id", "__t", "h"), make, f"id {kind}, sig long, h boolean, seq binary, far binary")


def _keys(far: bytes) -> list[bytes]:
    out, k = [], 0
    while k < len(far):
        e = k + 1 + far[k]
        out.append(far[k + 1 : e])
        k = e
    return out


def _triples(rows: DataFrame, of_class: np.ndarray) -> np.ndarray:
    """How often each class follows two others; rows: sequences of numbers."""
    sent = rows.sparkSession.sparkContext.broadcast(of_class.astype(np.int32))

    def make():
        class Step:
            def __call__(self, columns):
                found = [sent.value.take(np.frombuffer(seq, np.int32)) for seq in columns[0]]
                codes = np.concatenate([(s[:-2] * CLASSES + s[1:-1]) * CLASSES + s[2:] for s in found])
                self.sums += np.bincount(codes, minlength=CLASSES**3)
                return ()

            def finish(self):
                at = np.flatnonzero(self.sums)
                return zip(at.tolist(), self.sums[at].tolist())

        step = Step()
        step.sums = np.zeros(CLASSES**3, np.int64)
        return step

    table = map_slices(rows, make, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES ** 3 rows
    out = np.zeros(CLASSES**3, np.int64)
    out[table["code"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES, CLASSES)


def _like(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Rows in ``parts`` (a power of two) groups of one size, or nearly: halved again and again along the direction in which they differ most."""
    runs = [np.arange(len(x))]
    while len(runs) < parts:
        halves = []
        for r in runs:
            y = x[r] - x[r].mean(0)
            r = r[np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")]
            halves += [r[: len(r) // 2], r[len(r) // 2 :]]
        runs = halves
    return runs


def _moments(q: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean and half the variance of vectors: times (h, h ** 2) about the log of their mean exp(h q)."""
    mean = np.average(q, axis=0, weights=weight)
    return np.append(mean, np.average((q - mean) ** 2, axis=0, weights=weight) / 2)


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist() if len(at) else []
    return list(zip(first, [*first[1:], len(at)]))


class Tree:
    """Probabilities of words by class, group and word, each divided by its sum over the classes, the class's groups, the group's words.

    of_class, weight, q: each word's class, share (up to a factor) and vector as target. logp: natural log of the class
    given two classes. The groups of a class, about as many as words in each, hold words of like vectors; classes and
    groups enter with the first two moments of their words' vectors.
    """

    def __init__(self, of_class: np.ndarray, weight: np.ndarray, q: np.ndarray, logp: np.ndarray):
        self.of_class, self.logp = of_class, logp
        order, group, first, moments = [], np.zeros(len(q), np.int64), [0], []
        self.classes = np.zeros((logp.shape[1], 2 * q.shape[1]), np.float32)
        members = np.argsort(of_class, kind="stable")
        edges = np.searchsorted(of_class[members], np.arange(logp.shape[1] + 1))
        for c in range(logp.shape[1]):
            own = members[edges[c] : edges[c + 1]]
            if len(own):
                self.classes[c] = _moments(q[own].astype(np.float64), weight[own])
                for r in _like(q[own].astype(np.float64), 1 << round(math.log2(len(own)) / 2)):
                    group[own[r]] = len(moments)
                    moments.append(_moments(q[own[r]].astype(np.float64), weight[own[r]]))
                    order.append(own[r])
            first.append(len(moments))
        self.first, self.group, self.groups = np.array(first), group, np.array(moments, np.float32)
        order, mass = np.concatenate(order), np.bincount(group, weights=weight)
        self.slot = np.empty(len(q), np.int64)
        self.slot[order] = np.arange(len(q))
        self.start = np.searchsorted(group[order], np.arange(len(moments) + 1))
        self.q, self.log_word = q[order], np.log(weight[order] / mass[group[order]]).astype(np.float32)
        self.log_group = np.log(mass / np.bincount(of_class, weights=weight)[of_class[order[self.start[:-1]]]]).astype(np.float32)
        self.share_of_word, self.share_of_group = np.exp(self.log_word), np.exp(self.log_group)
        n = q.shape[1]
        self.longest = [[max(_longest(y[:, k]) for y in (self.classes, self.groups)) for k in (slice(n), slice(n, None))], [_longest(self.q)]]

    def log_p(self, h: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability; h: what its context predicts, before: the number of the two classes before."""
        g = self.group.take(word)
        order = np.argsort(g.astype(np.uint16) if len(self.groups) <= 1 << 16 else g, kind="stable")  # words of a class and of a group lie together
        g, word, before, h = g.take(order), word.take(order), before.take(order), h.take(order, axis=0)
        x, c, slot = np.concatenate([h, h * h], 1), self.of_class.take(word), self.slot.take(word)
        far = [sum(_longest(y) * n for y, n in zip((h, x[:, h.shape[1] :]), level)) > BOUND for level in self.longest]  # only then may a product be beyond BOUND
        own, sums = np.zeros((3, len(h)), np.float32), np.ones((3, len(h)), np.float32)
        place = np.arange(PRODUCT_ROWS)
        one = np.ones(self.classes.shape[0], np.float32)
        for k in range(0, len(h), PRODUCT_ROWS):
            z, prior = _products(x[k : k + PRODUCT_ROWS], self.classes, far[0]), self.logp.take(before[k : k + PRODUCT_ROWS], axis=0)
            z += prior
            own[0, k : k + PRODUCT_ROWS] = z[place[: len(z)], c[k : k + PRODUCT_ROWS]]
            np.matmul(np.exp(z, out=z), one, out=sums[0, k : k + PRODUCT_ROWS])
        for a, b in _runs(c):
            low, high = self.first[c[a]], self.first[c[a] + 1]
            for k in range(a, b if high - low > 1 else a, PRODUCT_ROWS):
                e = min(b, k + PRODUCT_ROWS)
                z = _products(x[k:e], self.groups[low:high], far[0])
                own[1, k:e] = z[place[: e - k], g[k:e] - low]
                np.matmul(np.exp(z, out=z), self.share_of_group[low:high], out=sums[1, k:e])
        own[1] += self.log_group.take(g)
        np.einsum("ij,ij->i", h, self.q.take(slot, axis=0), out=own[2])
        if far[1]:
            np.clip(own[2], -BOUND, BOUND, out=own[2])
        for a, b in _runs(g):
            low, high = self.start[g[a]], self.start[g[a] + 1]
            for k in range(a, b, PRODUCT_ROWS):
                e = min(b, k + PRODUCT_ROWS)
                z = _products(h[k:e], self.q[low:high], far[1])
                np.matmul(np.exp(z, out=z), self.share_of_word[low:high], out=sums[2, k:e])
        own[2] += self.log_word.take(slot)
        own -= np.log(sums, out=sums)
        out = np.empty(len(h), np.float32)
        out[order] = own.sum(0)
        return out


def _longest(x: np.ndarray) -> float:
    return math.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))


def _products(x: np.ndarray, q: np.ndarray, far: bool) -> np.ndarray:
    z = x @ q.T
    return np.clip(z, -BOUND, BOUND, out=z) if far else z


def numbers(head: dict, single: dict[bytes, int]) -> tuple[Numbers, np.ndarray, np.ndarray]:
    """Words by number: those of ``head`` by falling count, with the end; their counts, and the classes of these and of the rarer words of each shape."""
    keys = sorted({END, *head}, key=lambda k: (-head[k][1] if k in head else 0, k))  # frequent words lie together
    count = np.array([head[k][1] if k in head else 0 for k in keys], np.float64)
    cls = np.array([0 if k == END else single.get(k, head[k][0]) for k in keys] + list(range(CLASSES - SHAPES, CLASSES)), np.int64)
    return Numbers((k, j) for j, k in enumerate(keys)), count, cls


def word_model(count: np.ndarray, cls: np.ndarray, table_of: np.ndarray, share: np.ndarray, mass: np.ndarray, vocab: np.ndarray) -> WordModel:
    """What training needs to know of words, from the counts and the model of classes."""
    own = cls[: len(count)]
    rare = np.maximum(mass[CLASSES - SHAPES :] - np.bincount(own, weights=count, minlength=CLASSES)[CLASSES - SHAPES :], 0)
    kinds = np.maximum(vocab - np.bincount(own, minlength=CLASSES), 0)[CLASSES - SHAPES :]
    weight = np.append(count, rare + 0.5 * kinds) + 0.5  # all rarer words of a class, and one unknown
    count = np.append(count, rare) + 0.5
    log_share = np.minimum(np.log(count) - math.log(10) * share[cls], 0)
    return WordModel(log_share.astype(np.float32), cls, count / count.sum(), weight, (math.log(10) * table_of.reshape(-1, CLASSES)).astype(np.float32))


@dataclass
class WordModel:
    """Words by number: those of ``head`` by falling count, then the classes by shape for all others."""

    log_share: np.ndarray  # natural log of a word's share of its class; all rarer words of a class as one
    of_class: np.ndarray
    noise: np.ndarray
    weight: np.ndarray  # count + 0.5; of all rarer words of a class the sum, with one unknown
    logp: np.ndarray  # natural log of the class given two classes, as [before that * CLASSES + before, class]

    def start(self) -> np.ndarray:
        """Vectors as context (random, the same in all tasks) and as target (zero)."""
        out = np.zeros((len(self.noise), 2, DIMENSIONS), np.float32)
        out[:, 0] = np.random.default_rng(11).normal(0, 0.5, (len(out), DIMENSIONS))
        return out


def _turn() -> np.ndarray:
    """How the word before the last enters: turned, so that places differ, and by half."""
    return (0.5 * np.linalg.qr(np.random.default_rng(5).normal(size=(DIMENSIONS, DIMENSIONS)))[0]).astype(np.float32)


def _add_rows(to: np.ndarray, size: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """One step of AdaGrad on the rows ``at`` (at most 2^12, which may repeat), with one size a row."""
    n = len(at)
    key = at.astype(np.int64)
    key <<= 12
    key |= np.arange(n)
    key.sort()  # places of equal rows stay in order
    order = key & 4095
    key >>= 12
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = key[new]
    cell = np.empty(n, np.int64)
    cell[order] = np.cumsum(new) - 1
    cells = cell[:, None] * DIMENSIONS + np.arange(DIMENSIONS)
    g = np.bincount(cells.ravel(), weights=g.ravel()).astype(np.float32).reshape(-1, DIMENSIONS)
    now = size.take(at)
    now += (g * g) @ np.full(DIMENSIONS, 1 / DIMENSIONS, np.float32)
    size[at] = now
    now += np.float32(1e-6)
    g *= np.divide(np.float32(-RATE), np.sqrt(now, out=now), out=now)[:, None]
    g += to.take(at, axis=0)
    to[at] = g


class WordTrainer:
    """Noise-contrastive estimation of word vectors from sequences of word numbers, ``HELD_POSITIONS`` at a time."""

    def __init__(self, model: WordModel):
        start = model.start()
        self.model, self.turn, self.context, self.target = model, _turn(), start[:, 0].copy(), start[:, 1].copy()
        self.sizes = np.zeros((2, len(start)), np.float32)
        self.weight = np.zeros(len(start), np.int64)
        self.cdf, self.base = np.cumsum(model.noise), (model.log_share - np.log(NOISE * model.noise)).astype(np.float32)
        self.one_hot = np.eye(CLASSES, dtype=np.float32)
        self.rng, self.held, self.n = np.random.default_rng(13), [], 0

    def add(self, seq: np.ndarray) -> None:
        """seq: two ends, then the text's words and its end."""
        self.held.append(np.stack([seq[:-2], seq[1:-1], seq[2:]], 1))
        self.n += len(seq) - 2
        if self.n >= HELD_POSITIONS:
            self.learn()

    def learn(self) -> None:
        if not self.n:
            return
        rows, self.held, self.n = np.concatenate(self.held), [], 0
        for k in range(3):
            self.weight += np.bincount(rows[:, k], minlength=len(self.weight))
        steps = -(-len(rows) // BATCH)
        for _ in range(max(ROUNDS, -(-LEAST_STEPS // steps))):
            order = self.rng.permutation(len(rows))
            for k in range(0, len(rows), BATCH):
                self.step(rows.take(order[k : k + BATCH], axis=0))

    def step(self, rows: np.ndarray) -> None:
        m, n, (far, near, word) = self.model, len(rows), rows.T.astype(np.int64)
        context, target = self.context, self.target
        h = context.take(far, axis=0) @ self.turn
        h += context.take(near, axis=0)
        before = m.of_class.take(far) * CLASSES
        before += m.of_class.take(near)
        logp = m.logp.take(before, axis=0)
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(SHARED)), len(self.cdf) - 1)
        words = np.concatenate([word, noise])
        q = target.take(words, axis=0)
        q, qn = q[:n], q[n:]
        s = np.einsum("ij,ij->i", h, q)
        s += logp[np.arange(n), m.of_class.take(word)]
        s += self.base.take(word)
        sn = h @ qn.T
        sn += logp @ self.one_hot.take(m.of_class.take(noise), axis=0).T  # the columns of the noise's classes
        sn += self.base.take(noise)
        d = -1 / (1 + np.exp(np.clip(s, -30, 30)))
        np.clip(sn, -30, 30, out=sn)
        np.negative(sn, out=sn)
        np.exp(sn, out=sn)
        sn += 1
        dn = np.divide(np.float32(NOISE / SHARED), sn, out=sn)
        of_target, of_context = np.empty((n + SHARED, DIMENSIONS), np.float32), np.empty((2 * n, DIMENSIONS), np.float32)
        np.multiply(d[:, None], h, out=of_target[:n])
        np.matmul(dn.T, h, out=of_target[n:])
        dh = np.multiply(d[:, None], q, out=of_context[:n])
        dh += dn @ qn
        np.matmul(dh, self.turn.T, out=of_context[n:])
        _add_rows(target, self.sizes[1], words, of_target)
        _add_rows(context, self.sizes[0], np.concatenate([near, far]), of_context)


def _train_words(rows: DataFrame, model: WordModel) -> np.ndarray:
    """The vectors of all tasks, each word's averaged by how often a task met it; rows: sequences of numbers."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        class Step:
            trainer = None

            def __call__(self, columns):
                if self.trainer is None:
                    self.trainer = WordTrainer(sent.value)
                for seq in columns[0]:
                    self.trainer.add(np.frombuffer(seq, np.int32))
                return ()

            def finish(self):
                t = self.trainer
                if t is None:
                    return
                t.learn()
                change = np.stack([t.context, t.target], 1) - sent.value.start()
                for k in range(0, len(change), BLOCK):
                    at = np.flatnonzero(t.weight[k : k + BLOCK])
                    if len(at):
                        yield k, at.astype(np.int32).tobytes(), t.weight[k + at].tobytes(), change[k + at].tobytes()

        return Step()

    def meet(table: pa.Table) -> pa.Table:
        total, weight = np.zeros((BLOCK, 2, DIMENSIONS)), np.zeros(BLOCK)
        for at, w, change in zip(*(table[c].to_pylist() for c in ("at", "w", "change"))):
            at, w = np.frombuffer(at, np.int32), np.frombuffer(w, np.int64)
            total[at] += w[:, None, None] * np.frombuffer(change, np.float32).reshape(-1, 2, DIMENSIONS)
            weight[at] += w
        mean = (total / np.maximum(weight, 1)[:, None, None]).astype(np.float32)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "mean": pa.array([mean.tobytes()], pa.binary())})

    parts = map_slices(rows, make, "block int, at binary, w binary, change binary")
    out = model.start()
    for r in parts.groupBy("block").applyInArrow(meet, "block int, mean binary").collect():  # at most HEAD_WORDS / BLOCK rows
        mean = np.frombuffer(r["mean"], np.float32).reshape(-1, 2, DIMENSIONS)
        out[r["block"] : r["block"] + BLOCK] += mean[: len(out) - r["block"]]
    return out


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row's whole text.

    Trained on the rows whose crc32 remainder is not ``fold``. base_score: smoothed unigram log10 probability; score:
    the model's. Null and empty texts are one end. Repeated rows stay; rows of one id are told apart by their text.
    Other columns are left out. Without training rows all words are unknown and all classes alike.

    Counts of the ``HEAD_WORDS`` most frequent words go to all tasks (at most ``KEY_BYTES`` bytes a word); only rarer
    words of a text are joined with the full table of counts.
    """
    checkpoint_folder(df)
    spark = df.sparkSession
    all_rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("__t"), (crc_remainder(id_col, folds) == fold).alias("h"))
    rows = all_rows.where(~F.col("h")).select("__t")
    counts = _word_counts(rows).checkpoint()
    sizes = {r["shape"]: (r["n"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    total, kinds = sum(n for n, _ in sizes.values()), sum(v for _, v in sizes.values())
    # a count that at most HEAD_WORDS words reach, from the numbers of words by quarter powers of two
    bands = sorted(((r["b"], r["n"]) for r in counts.where(F.length("key") <= KEY_BYTES).groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for band, n in bands:
        held += n
        if held > HEAD_WORDS:
            break
        least = band
    in_head = (F.length("key") <= KEY_BYTES) & (F.floor(F.log2("c") * 4) >= (least if least is not None else 1 << 20))
    table = counts.where(in_head).select("key", "shape", "c").toArrow()
    head = {bytes(k): (s, n) for k, s, n in zip(table["key"].to_pylist(), table["shape"].to_pylist(), table["c"].to_pylist())}
    best = sorted(((-n, k) for k, (_, n) in head.items() if k != END))[: CLASSES - SHAPES - 1]
    single = {k: j + 1 for j, (_, k) in enumerate(best)}
    end_known = END in head
    number, count, cls = numbers(head, single)
    numbered = _numbered(all_rows, number, end_known).checkpoint()
    learned = numbered.where(~F.col("h")).select("seq")
    table_of = log_bilinear(_triples(learned, cls))
    mass, vocab = np.zeros(CLASSES), np.zeros(CLASSES)
    for s, (n, v) in sizes.items():
        mass[s], vocab[s] = n, v
    for k in [END, *single]:
        s, n = head.get(k, (shape(k), 0))
        j = single.get(k, 0)
        mass[s] -= n
        vocab[s] -= k in head
        mass[j], vocab[j] = n, 1
    share = np.log10(mass + 0.5 * (vocab + (np.arange(CLASSES) >= CLASSES - SHAPES)))  # a class by shape has room for one unknown word
    share[:1] = np.log10(mass[:1] + 0.5)
    rest = math.log10(total + 0.5 * (kinds + 1))
    words, end = word_model(count, cls, table_of, share, mass, vocab), number[END]
    del table, head, number
    frames.rest(spark)
    vectors = _train_words(learned, words) if total else words.start()
    tree = Tree(words.of_class, words.weight, vectors[:, 1], words.logp)
    near = vectors[:, 0].copy()
    del vectors
    frames.rest(spark)
    sent = spark.sparkContext.broadcast((words.weight, len(count), None if end_known else end, near, tree))

    def make():
        weight, own, unknown, near, tree = sent.value
        far_, adjust = near @ _turn(), np.log10(weight)
        logs = adjust.copy()
        logs[own:] = np.nan
        if unknown is not None:
            logs[unknown] = np.nan

        def probabilities(seqs):
            """What each text's words have over their own counts in log10 probability."""
            far, before, word = (np.concatenate([s[k : len(s) - 2 + k] for s in seqs]) for k in range(3))
            value = np.empty(len(word))
            for k in range(0, len(word), SCORED_AT_ONCE):
                e = k + SCORED_AT_ONCE
                h = near.take(before[k:e], axis=0)
                h += far_.take(far[k:e], axis=0)
                value[k:e] = tree.log_p(h, tree.of_class.take(far[k:e]) * CLASSES + tree.of_class.take(before[k:e]), word[k:e])
            value /= math.log(10)
            value -= adjust.take(word)
            return np.add.reduceat(value, np.cumsum([0, *(len(s) - 2 for s in seqs[:-1])]))

        def step(columns):
            seqs = [np.frombuffer(seq, np.int32).astype(np.int64) for seq in columns[3]]
            for doc, sig, h, seq, far, lm in zip(*columns[:3], seqs, columns[4], probabilities(seqs).tolist()):
                value = logs.take(seq[2:])
                yield doc, sig, h, len(value), float(value[~np.isnan(value)].sum()), lm, _keys(far)

        return step

    kind = df.schema[id_col].dataType.simpleString()
    first = map_slices(numbered, make, f"id {kind}, sig long, h boolean, n long, s double, lm double, keys array<binary>")
    far = first.select("*", F.size("keys").alias("k"), F.explode_outer("keys").alias("key")).drop("keys")
    far = far.join(counts.select("key", "c"), "key", "left")
    value = F.when(F.col("key").isNotNull(), F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).otherwise(F.lit(0.0))
    sums = far.groupBy("id", "sig", "h", "n", "s", "lm", "k").agg(F.sum(value).alias("t"), F.count("c").alias("found"), F.count("*").alias("rows"))
    # a row repeated m times has given m times its words
    m = F.greatest(F.lit(1), F.col("rows") / F.greatest("k", F.lit(1))).cast("int")
    sums = sums.withColumn("m", m).withColumn("s", F.col("s") + F.col("t") / F.col("m"))
    sums = sums.select("*", F.explode(F.array_repeat(F.lit(0), F.col("m"))))
    return sums.select(
        F.col("id").alias(id_col), F.col("h").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("n") - F.col("k") + F.col("found") / F.col("m")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("s") - F.col("n") * F.lit(rest)).alias("base_score"), (F.col("s") + F.col("lm")).alias("score"),
    )
