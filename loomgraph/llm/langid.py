"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's bytes in both directions, across words, and gives every position a probability for
each language; a document's probabilities are the mean over all its positions. To read many texts at once they
are cut into windows of WINDOW bytes, each read with CONTEXT more bytes on either side, from which its states
warm up; those positions belong to the neighbours and aren't pooled. Training is backpropagation through time
on the driver, over the whole texts of a bounded number of labelled rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, give_back, small_batches, use_worker

WINDOW, CONTEXT, HIDDEN = 480, 16, 12
#: Windows that run at once; bytes of texts that are cut at once.
AT_ONCE, PIECE = 1024, 1 << 20
#: The network is fitted on the whole texts of DOCS_EACH rows of each language at most, in pieces of TRAINED bytes;
#: so many times that about BYTES_READ are read, once at least and EPOCHS times at most.
DOCS_EACH, TRAINED, BYTES_READ, EPOCHS, BATCH = 150, 96, 4_000_000, 6, 64
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Network:
    """Per direction: input table (256 x 3H, embedding and bias in one), recurrent matrix (H x 3H); then the output layer."""

    classes: list[str]
    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, self.out, self.bias]

    def key(self) -> str:
        return hashlib.sha256(b"".join(p.tobytes() for p in self.parameters()) + repr(self.classes).encode()).hexdigest()


def new_network(classes: list[str], seed: int = 9) -> Network:
    r = np.random.default_rng(seed)
    h = HIDDEN
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return Network(classes, [f(256, 3 * h, scale=0.3) for _ in range(2)], [f(h, 3 * h, scale=h**-0.5) for _ in range(2)], f(2 * h, len(classes), scale=0.3), np.zeros(len(classes), np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(bytes_: np.ndarray, table: np.ndarray, inner: np.ndarray, keep: bool):
    """States (n x length x H) of one direction, left to right; with ``keep`` also what training needs."""
    n, length = bytes_.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((n, length, HIDDEN), np.float32)
    kept = []
    for t in range(length):
        x, u = table[bytes_[:, t]], h @ inner
        gates = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r, un = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * un)
        if keep:
            kept.append((h, z, r, un, new))
        h = new + z * (h - new)
        states[:, t] = h
    return states, kept


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def positions(net: Network, bytes_: np.ndarray) -> np.ndarray:
    """Probabilities (n x length x classes) of units of one length."""
    a, _ = _run(bytes_, net.table[0], net.inner[0], False)
    b, _ = _run(bytes_[:, ::-1], net.table[1], net.inner[1], False)
    return _softmax(np.concatenate([a, b[:, ::-1]], axis=2) @ net.out + net.bias)


def gradients(net: Network, bytes_: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross entropy over all positions, by backpropagation through time; and the loss.

    ``weight`` multiplies each row's part of the gradients.
    """
    n, length = bytes_.shape
    runs = [_run(bytes_, net.table[0], net.inner[0], True), _run(bytes_[:, ::-1], net.table[1], net.inner[1], True)]
    both = np.concatenate([runs[0][0], runs[1][0][:, ::-1]], axis=2)
    p = _softmax(both @ net.out + net.bias)
    loss = float(-np.log(p[np.arange(n), :, label] + 1e-9).mean())
    p[np.arange(n), :, label] -= 1
    p /= n * length
    if weight is not None:
        p *= weight[:, None, None].astype(p.dtype)
    d_out = both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2])
    d_bias = p.sum(axis=(0, 1))
    d_both = p @ net.out.T
    tables, inners = [], []
    for way in range(2):
        d_states = d_both[:, :, :HIDDEN] if way == 0 else d_both[:, ::-1, HIDDEN:]
        read = bytes_ if way == 0 else bytes_[:, ::-1]
        inner, kept = net.inner[way], runs[way][1]
        d_table, d_inner = np.zeros_like(net.table[way]), np.zeros_like(inner)
        dh = np.zeros((n, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            h, z, r, un, new = kept[t]
            dh = dh + d_states[:, t]
            dz = dh * (h - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * un * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(d_table, read[:, t], dx)
            d_inner += h.T @ du
            dh = dh * z + du @ inner.T
        tables.append(d_table)
        inners.append(d_inner)
    return [*tables, *inners, d_out, d_bias], loss


def pieces(text: str) -> list[bytes]:
    """Pieces of TRAINED bytes that cover a text; the last one reaches back into the one before."""
    b = text.encode("utf-8", "surrogatepass")
    return [b[max(0, min(i, len(b) - TRAINED)) :][:TRAINED] for i in range(0, len(b), TRAINED)]


def train(rows: list[tuple[str, str]], seed: int = 9) -> Network | None:
    """Fit a network on (text, language) rows; None without rows."""
    classes = sorted({c for _, c in rows})
    if not classes:
        return None
    r, net = np.random.default_rng(seed), new_network(classes, seed)
    by: list[tuple[bytes, int]] = []
    for k, c in enumerate(classes):
        by += [(u, k) for t, x in rows if x == c for u in pieces(t)]
    if not by:
        return net
    by.sort(key=lambda x: len(x[0]))
    lengths = np.array([len(u) for u, _ in by])
    p = net.parameters()
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    # every language weighs alike, however long its texts
    share = np.bincount([k for _, k in by], weights=lengths, minlength=len(classes))
    weight = np.clip(share.mean() / np.maximum(share, 1), 0.2, 5.0)
    epochs = int(np.clip(BYTES_READ // max(1, lengths.sum()), 1, EPOCHS))
    for epoch in range(epochs):
        jobs = [idx[i : i + BATCH] for n in np.unique(lengths) for idx in [r.permutation(np.flatnonzero(lengths == n))] for i in range(0, len(idx), BATCH)]
        for k in r.permutation(len(jobs)):
            some = [by[i] for i in jobs[k]]
            label = np.array([c for _, c in some])
            g, _ = gradients(net, np.frombuffer(b"".join(u for u, _ in some), np.uint8).reshape(len(some), -1), label, weight[label])
            step += 1
            rate = 0.02 * (1 - epoch / epochs) * min(1.0, len(some) / 64)
            for x, d, a, b in zip(p, g, m, v, strict=True):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                x -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _states(bytes_: np.ndarray, table: np.ndarray, inner: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """States (positions x rows x HIDDEN) of one direction over bytes (positions x rows); where ``live`` is 0 they stay 0.

    Gates are computed apart, so that every array is contiguous.
    """
    n = bytes_.shape[1]
    # the sigmoid of x is half of tanh(x / 2), plus a half
    of = [(table[:, k * HIDDEN : (k + 1) * HIDDEN] * f, inner[:, k * HIDDEN : (k + 1) * HIDDEN] * f) for k, f in enumerate(np.array([0.5, 0.5, 1.0], np.float32))]
    of = [(np.ascontiguousarray(a), np.ascontiguousarray(b)) for a, b in of]
    h, states = np.zeros((n, HIDDEN), np.float32), np.empty((len(bytes_), n, HIDDEN), np.float32)
    z, r, new, u = (np.empty((n, HIDDEN), np.float32) for _ in range(4))
    for t, b in enumerate(bytes_):
        for gate, (table_, inner_) in zip((z, r), of[:2], strict=True):
            np.take(table_, b, axis=0, out=gate, mode="clip")
            gate += np.matmul(h, inner_, out=u)
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        np.take(of[2][0], b, axis=0, out=new, mode="clip")
        np.matmul(h, of[2][1], out=u)
        u *= r
        new += u
        np.tanh(new, out=new)
        h -= new
        h *= z
        h += new
        if live is not None:
            h *= live[t][:, None]
        states[t] = h
    return states


class Reader:
    """Pools position probabilities of texts."""

    def __init__(self, net: Network):
        self.net = net

    def read(self, some: list[str]) -> np.ndarray:
        """Mean probabilities (texts x classes); zeros for empty texts."""
        data = [t.encode("utf-8", "surrogatepass") for t in some]
        sums, n = np.zeros((len(some), len(self.net.classes))), np.array([len(x) for x in data])
        at = 0
        while at < len(data):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(n[at:]), PIECE, "right")))
            # a longer text goes by parts, each with the context of its neighbours
            for a in range(0, max(1, int(n[at])), PIECE) if to == at + 1 else [0]:
                lo, hi = (max(0, a - CONTEXT), min(int(n[at]), a + PIECE + CONTEXT)) if to == at + 1 else (0, 0)
                part = [data[at][lo:hi]] if to == at + 1 else data[at:to]
                core = (a - lo, min(int(n[at]), a + PIECE) - lo) if to == at + 1 else None
                sums[at:to] += self._sums(part, core)
            at = to
        return sums / np.maximum(n, 1)[:, None]

    def _sums(self, data: list[bytes], core: tuple[int, int] | None) -> np.ndarray:
        """Sums of position probabilities; ``core`` tells which positions of a single text count."""
        net, k = self.net, len(self.net.classes)
        buf = np.frombuffer(b"".join(data), np.uint8)
        n = np.array([len(x) for x in data])
        text_end = np.cumsum(n)
        text_start = text_end - n
        low, high = (np.array([core[0]]), np.array([core[1]])) if core else (text_start, text_end)
        count = -(-(high - low) // WINDOW)
        text = np.repeat(np.arange(len(data)), count)
        own_a = low[text] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        own_b = np.minimum(own_a + WINDOW, high[text])
        a, b = np.maximum(own_a - CONTEXT, text_start[text]), np.minimum(own_b + CONTEXT, text_end[text])
        sums = np.zeros((len(data), k))
        order = np.argsort(b - a, kind="stable")
        for i in range(0, len(order), AT_ONCE):
            w = order[i : i + AT_ONCE]
            steps = np.arange(int((b[w] - a[w]).max()))[:, None]
            size = b[w] - a[w]
            live = (steps < size).astype(np.float32)
            x = buf[np.minimum(a[w] + steps, len(buf) - 1)].astype(np.intp)
            ragged = int(size.min()) < len(x)
            ahead = _states(x, net.table[0], net.inner[0])
            back = _states(x[::-1], net.table[1], net.inner[1], live[::-1] if ragged else None)[::-1]
            # classes first, so that sums over them run along whole arrays
            e = net.out[:HIDDEN].T @ ahead.reshape(-1, HIDDEN).T + net.out[HIDDEN:].T @ back.reshape(-1, HIDDEN).T + net.bias[:, None]
            e -= e.max(axis=0)
            np.exp(e, out=e)
            pooled = ((steps >= own_a[w] - a[w]) & (steps < own_b[w] - a[w])).reshape(-1) / e.sum(axis=0)
            np.add.at(sums, text[w], (e * pooled).reshape(k, *x.shape).sum(axis=1).T)
        return sums


_READERS: dict[str, Reader] = {}


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, label: str, each: int, where: Column) -> list[tuple[str, object]]:
    """(text, label) of at most ``each`` rows a label, those with the least hash of doc_id; chosen on narrow rows."""
    d = docs.where(where & F.col(label).isNotNull() & F.col("text").isNotNull())
    # only rows with hashes below about three times the needed share are ranked, so no task sees a whole label
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    narrow = d.select("doc_id", label, h.alias("_h"))
    # one row a class, as many as the model has outputs; as literals they filter where the table is read, without a join
    least = {r[0]: (3 * each + 30) * (1 << 40) // r[1] for r in narrow.groupBy(label).count().collect()}
    if not least:
        return []
    kind = dict(narrow.dtypes)[label]
    bound = F.create_map(*[x for k, v in least.items() for x in (F.lit(k).cast(kind), F.lit(min(v, 1 << 40)))])
    low = narrow.where(F.col("_h") <= F.try_element_at(bound, F.col(label)))
    order = Window.partitionBy(label).orderBy("_h", "doc_id")
    best = low.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select("doc_id").distinct()
    best = cut(best, "sample")  # of known size: the planner broadcasts it if small, so the texts stay where they are
    rows = d.join(best, "doc_id", "left_semi").select("doc_id", "text", label).collect()
    seen: dict = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        seen.setdefault((r[2], r[0]), r)
    return [(r[1], r[2]) for r in seen.values()]


def predict(docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred and score, the mean probability of lang_pred over all positions.

    A null text, one without a letter, or any text when nothing was learned, is ``und`` with score 0. Texts of any
    length are read whole; of languages with equal scores the first by name is told. Rows are kept, repeated ones
    too; no rows give none. Other columns are ignored, and ``keep`` may not name the two that are added.
    """
    small_batches(docs.sparkSession)
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are added")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker(_READERS)
        key = net.key() if net else ""
        if net and key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(net)
        for b in batches:
            some = b.column(b.num_columns - 1).to_pylist()
            said, scores = [UNKNOWN] * len(some), [0.0] * len(some)
            ok = [k for k, t in enumerate(some) if net and t and LETTER.search(t)]
            for k, p in zip(ok, _READERS[key].read([some[k] for k in ok]) if ok else [], strict=True):
                best = int(p.argmax())
                said[k], scores[k] = net.classes[best], round(min(1.0, float(p[best])), 6)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
        give_back()

    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    types = dict(d.dtypes)
    return d.mapInArrow(work, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string, score double"]))


def learn(docs: DataFrame, where: Column | None = None) -> Network | None:
    """Fit on at most DOCS_EACH documents of each language among the rows that ``where`` admits."""
    return train(labelled_sample(docs, "lang", DOCS_EACH, where if where is not None else F.lit(True)))
