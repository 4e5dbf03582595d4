"""Toxicity by averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, hashed into a
table; a document's is the mean over its words. Misspellings share most n-grams with the words they distort.
Since the output layer is linear, a word adds one number to a document's score, which a worker computes once
for each distinct word and keeps, within a bound.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import Generations, slices
from loomgraph.llm.common import small_batches, texts
from loomgraph.llm.langid import fold, labelled_sample
from loomgraph.llm.nearcopy import mix

GRAMS, BUCKETS, DIM, KEPT = (3, 4, 5), 1 << 19, 8, 300_000
#: The sample that the model is fitted on: documents of each label at most, read whole.
DOCS_EACH, EPOCHS, BATCH = 1500, 5, 32
#: Table rows that fewer documents of the sample have stay zero.
LEAST_DOCS = 4
#: Toxic words are a few in hundreds, so a mean over words is scaled up before the softmax.
SCALE, RATE, SHRINK = 40.0, 0.15, 0.08
#: Characters hashed at once.
PIECE = 1 << 20
#: Longer words are not kept by workers from batch to batch.
LONG = 256
EDGES = ".,;:!?()[]{}\"'*#$%&|"


_P = np.uint64(0x100000001B3)


def _grams(cp: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of the n-grams of each length; ``left`` counts the characters from a start to its word's end."""
    h = cp.copy()
    for g in range(2, max(GRAMS) + 1):
        m = max(0, len(h) - g + 1)
        h[:m] = h[:m] * _P + cp[g - 1 : g - 1 + m]
        if g in GRAMS:
            ok = np.flatnonzero(left >= g)
            yield ok, mix(h[ok] * _P + np.uint64(g))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _table_rows(hashes: list[np.ndarray]) -> np.ndarray:
    return (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int32)


def _long(marked: str) -> np.ndarray:
    """Table rows of one long word, by pieces; each reaches into the next far enough for the n-grams that start in it."""
    found, whole, power = [], np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(marked), PIECE):
        cp = _code_points(marked[at : at + PIECE + max(GRAMS) - 1])
        own = min(PIECE, len(marked) - at)
        left = len(marked) - at - np.arange(len(cp))
        left[own:] = 0
        found.append(_table_rows([h for _, h in _grams(cp, left)]))
        powers = np.multiply.accumulate(np.full(own, _P)) * power
        whole, power = whole + (cp[:own] * powers).sum(keepdims=True, dtype=np.uint64), powers[-1:]
    return np.concatenate([*found, _table_rows([mix(whole)])])


def _short(marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in marked], np.int64)
    first = np.cumsum(n) - n
    cp = _code_points("".join(marked))
    word = np.repeat(np.arange(len(marked)), n)
    left = np.repeat(first + n, n) - np.arange(len(cp))  # characters from here to the word's end
    rows, owner = [], []
    for ok, h in _grams(cp, left):
        rows.append(h)
        owner.append(word[ok])
    powers = np.multiply.accumulate(np.full(int(n.max(initial=1)), _P))
    rows.append(mix(np.add.reduceat(cp * powers[np.arange(len(cp)) - np.repeat(first, n)], first)))
    owner.append(np.arange(len(marked)))
    at = np.concatenate(owner)
    return _table_rows(rows)[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(marked))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, how many of them each word has): a word's n-grams with edge marks, and the word itself.

    Case and edge punctuation don't count. Words are hashed whole, however long (a text without blanks is one
    word). Hashes are polynomials over code points, for about PIECE characters at once.
    """
    rows, sizes = [], []
    for some in slices([f"<{w.lower().strip(EDGES)}>" for w in words], PIECE):
        if len(some) == 1 and len(some[0]) > PIECE:
            rows.append(_long(some[0]))
            sizes.append(np.array([len(rows[-1])]))
        else:
            with_sizes = _short(some)
            rows.append(with_sizes[0])
            sizes.append(with_sizes[1])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(sizes)


@dataclass
class Model:
    known: np.ndarray  # the table rows that were learned, ascending; all others are zero
    table: np.ndarray  # len(known) x DIM
    out: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def key(self) -> str:
        return hashlib.sha256(self.known.tobytes() + self.table.tobytes() + self.out.tobytes() + self.bias.tobytes()).hexdigest()

    def rows(self) -> np.ndarray:
        """What each table row adds to the log odds, before the mean."""
        found = np.zeros(BUCKETS, np.float32)
        found[self.known] = SCALE * (self.table @ (self.out[:, 1] - self.out[:, 0]))
        return found


def train(rows: list[tuple[str, int]], odds: float = 1.0, seed: int = 8) -> Model | None:
    """Fit on (text, 0 or 1) rows; None unless both labels occur.

    A fifth of the rows is kept back to set the bias: there score 0.5 separates the labels best, with label 1
    weighted to be ``odds`` times as frequent as label 0.
    """
    rows = [(t, int(y)) for t, y in rows if y in (0, 1)]
    if len({y for _, y in rows}) < 2:
        return None
    back = [k for k, (t, _) in enumerate(rows) if zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0]
    rest = [x for k, x in enumerate(rows) if k not in set(back)]
    if len(rows) < 100 or len({rows[k][1] for k in back}) < 2 or len({y for _, y in rest}) < 2:
        return fit(rows, seed)
    m = fit(rest, seed)
    s = Scorer(m)
    found = np.array(s.odds([rows[k][0] for k in back]))
    y = np.array([rows[k][1] for k in back])
    weight = np.where(y == 1, odds / (y == 1).sum(), 1 / (y == 0).sum())
    cuts = np.unique(np.concatenate([found, [found.max() + 1]]))
    wrong = np.array([weight[(found >= c) != (y == 1)].sum() for c in cuts])
    best = cuts[wrong == wrong.min()]
    lower = found[found < best[-1]].max(initial=best[-1] - 1)
    m.bias[1] -= np.float32((best[-1] + lower) / 2)
    return m


def fit(rows: list[tuple[str, int]], seed: int) -> Model:
    """Stochastic gradient descent with Adagrad on table and output layer together."""
    r = np.random.default_rng(seed)
    names: dict[str, int] = {}
    bags = []
    for t, _ in rows:
        words = t.split()
        ids, n = np.unique([names.setdefault(w, len(names)) for w in words] or [names.setdefault("", len(names))], return_counts=True)
        bags.append((ids, (n / n.sum()).astype(np.float32)))
    flat, sizes = subwords(list(names))
    first = np.cumsum(sizes) - sizes
    grams = np.split(flat, first[1:])
    in_docs = np.zeros(BUCKETS, np.int64)
    for ids, _ in bags:
        in_docs[np.unique(np.concatenate([grams[k] for k in ids]))] += 1
    known = np.flatnonzero(in_docs >= LEAST_DOCS)
    place = np.full(BUCKETS, len(known))  # the last row of the table is the zero row
    place[known] = np.arange(len(known))
    flat, size = place[flat], len(known) + 1
    m = Model(known, (r.standard_normal((size, DIM)) * 0.01).astype(np.float32), (r.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32))
    seen_t, seen_o, seen_b = np.full((size, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    labels = np.array([y for _, y in rows])
    rate_of = np.array([1.0, (labels == 0).sum() / max(1, (labels == 1).sum())], np.float32) ** 0.5
    for epoch in range(EPOCHS):
        order = r.permutation(len(rows))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            ids = np.concatenate([bags[k][0] for k in some])
            share = np.concatenate([bags[k][1] for k in some])
            doc = np.repeat(np.arange(len(some)), [len(bags[k][0]) for k in some])
            n = sizes[ids]
            at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows_ = flat[at]
            weight = np.repeat(share / n, n) * SCALE
            d = np.repeat(doc, n)
            ink = m.table[rows_] * weight[:, None]
            mean = np.add.reduceat(ink, np.searchsorted(d, np.arange(len(some))))
            logits = mean @ m.out + m.bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= (rate_of[labels[some]] / len(some))[:, None]
            d_out, d_bias, d_mean = mean.T @ p, p.sum(axis=0), p @ m.out.T
            # gradients of the table rows that occur
            g = np.empty((size, DIM), np.float32)
            for k in range(DIM):
                g[:, k] = np.bincount(rows_, weight * d_mean[d, k], size)
            g[-1] = 0
            for x, dx, s in ((m.table, g, seen_t), (m.out, d_out, seen_o), (m.bias, d_bias, seen_b)):
                s += dx * dx
                x -= rate * dx / np.sqrt(s)
            # groups of weights that the labels don't need vanish: each row shrinks by a length, to zero at last
            length = np.sqrt((m.table * m.table).sum(axis=1, keepdims=True)) + 1e-12
            m.table *= np.maximum(0, 1 - rate * SHRINK / length)
            m.table[-1] = 0
    m.table = m.table[:-1]
    return m


class Scorer:
    def __init__(self, model: Model):
        self.rows, self.bias, self.kept = model.rows(), float(model.bias[1] - model.bias[0]), Generations(KEPT)

    def words(self, some: list[str]) -> np.ndarray:
        """What each word adds to the log odds, before the mean."""
        flat, sizes = subwords(some)
        return np.add.reduceat(self.rows[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes if some else np.zeros(0)

    def odds(self, some: list[str]) -> list[float]:
        """Log odds of label 1 for each text."""
        self.kept.turn()
        young, old = self.kept.young, self.kept.old
        cut = [t.split() for t in some]
        new = []
        for w in {w for x in cut for w in x if w not in young}:
            if (found := old.get(w)) is not None:
                young[w] = found
            else:
                new.append(w)
        for some in slices(new, PIECE):
            for i in range(0, len(some), 20_000):
                young.update(zip(some[i : i + 20_000], self.words(some[i : i + 20_000]).tolist(), strict=True))
        found = [(sum(map(young.__getitem__, x)) / len(x) if x else 0.0) + self.bias for x in cut]
        for w in new:
            if len(w) > LONG:
                del young[w]
        return found


_SCORERS: dict[str, Scorer] = {}


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with score (0 to 1) and predicted (1 if score >= 0.5). A null text counts as empty.

    An empty text gets the bias alone; without a model every score is 0. Rows are kept; other columns ignored.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = model.key() if model else ""
        if model and key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model)
        for b in batches:
            said = texts(b.column(b.num_columns - 1))
            odds = np.array([x for part in slices(said, 1_000_000) for x in _SCORERS[key].odds(part)] if model else [0.0] * len(said), np.float64)
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500))) if model else np.zeros(len(odds))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"])

    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text"))
    types = dict(d.dtypes)
    return d.mapInArrow(work, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double, predicted int"]))


def learn(docs: DataFrame, labels: DataFrame, where=None) -> Model | None:
    """Fit on at most DOCS_EACH labelled documents of each label; labels has doc_id and toxic.

    A doc_id with both labels is toxic. Null labels, ids or texts, and labels other than 0 and 1, teach nothing.
    The bound is in rows; the driver holds those texts whole, however long.
    """
    l = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    l = l.where(where if where is not None else F.lit(True))
    n = {r["toxic"]: r["count"] for r in l.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    d = docs.select("doc_id", "text").join(l, "doc_id")
    return train(labelled_sample(d, "toxic", DOCS_EACH, F.lit(True)), n.get(1, 0) / max(1, n.get(0, 0)))


__all__ = ["fold", "learn", "score", "train"]
