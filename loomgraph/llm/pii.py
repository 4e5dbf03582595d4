"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The patterns (email, ip, card, phone) give the base spans. The field is trained on a small labelled table of
sentences and adds spans that the patterns cannot see, such as phone numbers without a plus sign or addresses
spelled "name (at) host (dot) com". Its sequences are the stretches of a text around digits, signs and words
that can belong to such data, with context on both sides; plain stretches between them have no labels by
construction. Labels are decoded by Viterbi in numpy over batches of sequences of similar length. A decoded
span counts if it passes its kind's check and overlaps no base span.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import slices
from loomgraph.llm.common import give_back, small_batches, texts, use_worker

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: A digit run never ends inside a match, so a match begins where no digit stands before; likewise below.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IN_EMAIL = re.compile(r"[A-Za-z0-9._%+@-]*")
BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@label(.label)+, in time linear in the text: only runs around an @ are looked at."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and text[start - 1] in BEFORE:
            start -= 1
        end = IN_EMAIL.match(text, at).end()
        while at >= 0:  # start: where a local part may begin
            m = DOMAIN.match(text, at + 1, end) if at > start else None
            if m:
                yield start, m.end()
            start = m.end() if m else at + 1
            at = text.find("@", start, end)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's ordinal, end) of the patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the field

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: What every span that ``passes`` holds: a digit, an @, "at" in brackets, or "at" as a word before a point or "dot".
DOT = r"\s{0,3}(?:\.|[(\[{]\s{0,3}dot\s{0,3}[)\]}]|\sdot\s)\s{0,3}"
AT = r"\s{0,3}(?:@|[(\[{]\s{0,3}at\s{0,3}[)\]}]|\sat\s)\s{0,3}"
TRIGGER = re.compile(rf"[0-9@]|[(\[{{]\s{{0,3}}(?:at|dot)\s{{0,3}}[)\]}}]|\sdot\s|\sat(?=\s{{1,4}}[^\s@]+?{DOT}[^\s@])", re.I)
#: How an address may go on behind the end of what was read.
MORE = re.compile(rf"(?:(?<=\.)\s{{0,3}}|{DOT})[^\s@]+", re.I)
EMAIL = re.compile(rf"[^\s@]+{AT}[^\s@]+(?:{DOT}[^\s@]+)+", re.I)
MARGIN = 48
SPACE = re.compile(r"\s")
FEATURES = 1 << 13
WORDS = frozenset("at dot com org net edu tel phone fax mobile cell call card visa account ip host server mail email e token key id version no order".split())


def shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return f"d{n}" if n < 5 else "d8" if n < 9 else "d11" if n < 12 else "d19" if n < 20 else "d20"
    if c.isalpha():
        low = token.lower()
        return f"w:{low}" if low in WORDS else ("x" if token.islower() else "X" if token.isupper() else "Xx") + ("1" if len(token) == 1 else "")
    return f"p{c}" if c in "@.()-+[]{}:=/_%,;#*|\"" else "p"


def features(shapes: list[str], gaps: list[str]) -> list[list[int]]:
    """Hashed features of each token: shapes in a window of two on either side, and white space before them."""
    s = ["<<", "<", *(a + b for a, b in zip(gaps, shapes, strict=True)), ">", ">>"]
    out = []
    for i in range(2, len(s) - 2):
        own = (f"0{s[i]}", f"a{s[i - 1]}", f"b{s[i + 1]}", f"c{s[i - 2]}", f"d{s[i + 2]}", f"e{s[i - 1]} {s[i]}", f"f{s[i]} {s[i + 1]}", f"g{s[i - 2]} {s[i - 1]} {s[i]}", f"h{s[i]} {s[i + 1]} {s[i + 2]}")
        out.append([_hash(x) for x in own])
    return out


_HASHES: dict[str, int] = {}


def _hash(x: str) -> int:
    h = _HASHES.get(x)
    if h is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        h = _HASHES[x] = zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES
    return h


@dataclass
class Field:
    emit: np.ndarray  # FEATURES x labels
    move: np.ndarray  # labels x labels
    first: np.ndarray  # labels


def tokens(text: str, a: int = 0, b: int | None = None) -> tuple[list[tuple[int, int]], list[str], list[str]]:
    """Places, shapes and gaps of the tokens in text[a:b]."""
    places, shapes, gaps, last = [], [], [], a
    for m in TOKEN.finditer(text, a, len(text) if b is None else b):
        places.append(m.span())
        shapes.append(shape(m[0]))
        gaps.append("" if m.start() == last else "\n" if "\n" in text[last : m.start()] else " ")
        last = m.end()
    return places, shapes, gaps


def _padded(seqs: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    x = np.zeros((len(seqs), n.max(), len(seqs[0][0])), np.int64)
    for i, s in enumerate(seqs):
        x[i, : len(s)] = s
    return x, n


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def likelihood(field: Field, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, Field]:
    """Mean log likelihood by tokens of labelled sequences, and its gradient, by forward and backward sums."""
    b, t = x.shape[:2]
    e = field.emit[x].sum(axis=2)
    ahead, back = np.empty_like(e), np.zeros_like(e)
    ahead[:, 0] = field.first + e[:, 0]
    for i in range(1, t):
        ahead[:, i] = _lse(ahead[:, i - 1, :, None] + field.move, 1) + e[:, i]
    for i in range(t - 2, -1, -1):
        back[:, i] = np.where((i + 1 < n)[:, None], _lse(field.move + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0)
    ends = np.arange(b), n - 1
    z = _lse(ahead[ends], 1)
    live = np.arange(t) < n[:, None]
    p = np.exp(np.minimum(ahead + back - z[:, None, None], 0)) * live[:, :, None]
    total = n.sum()
    true = np.zeros_like(p)
    np.put_along_axis(true, y[:, :, None], 1, 2)
    true *= live[:, :, None]
    g = Field(np.zeros_like(field.emit), np.zeros_like(field.move), ((true - p)[:, 0]).sum(axis=0) / total)
    np.add.at(g.emit, x.reshape(-1), np.repeat((true - p).reshape(b * t, -1) / total, x.shape[2], axis=0))
    value = (e * true).sum() + (field.first * true[:, 0]).sum() - z.sum()
    for i in range(1, t):
        on = live[:, i]
        pair = np.exp(np.minimum(ahead[on, i - 1, :, None] + field.move + (e[on, i] + back[on, i])[:, None, :] - z[on, None, None], 0))
        seen = true[on, i - 1][:, :, None] * true[on, i][:, None, :]
        g.move += (seen - pair).sum(axis=0) / total
        value += (seen * field.move).sum()
    return float(value / total), g


def viterbi(field: Field, seqs: list[list[list[int]]], batch: int = 512) -> list[list[int]]:
    """The likeliest labels of each sequence."""
    out: list[list[int]] = [[] for _ in seqs]
    order = sorted((i for i, s in enumerate(seqs) if s), key=lambda i: len(seqs[i]))
    at = 0
    while at < len(order):
        most, k = 0, at
        while k < len(order) and k - at < batch and (k == at or len(seqs[order[k]]) * (k - at + 1) <= 40_000):
            most, k = len(seqs[order[k]]), k + 1
        some = order[at:k]
        x, n = _padded([seqs[i] for i in some])
        e = field.emit[x].sum(axis=2)
        best, came = field.first + e[:, 0], np.zeros(e.shape, np.int8)
        last = best.copy()
        for i in range(1, most):
            s = best[:, :, None] + field.move
            came[:, i] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, i]
            last[i < n] = best[i < n]
        y = np.zeros(x.shape[:2], np.int64)
        label = last.argmax(axis=1)
        rows = np.arange(len(some))
        for i in range(most - 1, -1, -1):
            y[:, i] = label
            label = np.where(i < n, came[rows, i, label], label)
        for r, i in enumerate(some):
            out[i] = y[r, : n[r]].tolist()
        at = k
    return out


def to_labels(places: list[tuple[int, int]], spans: Iterable[tuple[int, int, int]]) -> list[int]:
    """Labels of tokens under (start, kind, end) spans."""
    y = [0] * len(places)
    for a, k, b in spans:
        inside = [i for i, (p, q) in enumerate(places) if a <= p and q <= b]
        for i in inside:
            y[i] = 1 + 2 * k + (i != inside[0])
    return y


def to_spans(places: list[tuple[int, int]], y: list[int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled runs; one begins at a B label."""
    out: list[tuple[int, int, int]] = []
    for i, label in enumerate(y):
        k, inside = (label - 1) // 2, label > 0 and label % 2 == 0
        if inside and i and y[i - 1] > 0 and (y[i - 1] - 1) // 2 == k and out and out[-1][2] == places[i - 1][1]:
            out[-1] = (out[-1][0], k, places[i][1])
        elif label > 0 and not inside:
            out.append((places[i][0], k, places[i][1]))
    return out


def train(table: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 70) -> Field:
    """Fit on (text, spans) rows by Adam on the penalised likelihood."""
    seqs, ys = [], []
    for text, spans in table:
        places, shapes, gaps = tokens(text)
        if places:
            seqs.append(features(shapes, gaps))
            ys.append(to_labels(places, spans))
    n_labels = len(LABELS)
    field = Field(np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if not seqs:
        field.first[0] = 1.0
        return field
    x, n = _padded(seqs)
    y = np.zeros(x.shape[:2], np.int64)
    for i, own in enumerate(ys):
        y[i, : len(own)] = own
    own = (field.emit, field.move, field.first)
    m, v = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
    for step in range(1, steps + 1):
        _, g = likelihood(field, x, n, y)
        for p, d, a, b in zip(own, (g.emit, g.move, g.first), m, v, strict=True):
            d = d - 1e-5 * p
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p += 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    # an inside label only follows a label of its kind
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        field.first[inside] = -1e4
        field.move[[i for i in range(n_labels) if i not in (inside - 1, inside)], inside] = -1e4
    return field


def labelled_table(n: int = 700, seed: int = 4) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The default training table, by rule: sentences of filler words with one or two items, some of them harmless."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randrange(2, 9)))

    def card(sep: str) -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice([("@", "."), (" ( at ) ", " ( dot ) "), (" {at} ", " {dot} "), (" (At) ", " (Dot) "), (" At ", " Dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "[dot]"), (" AT ", " DOT ")])
        return name() + r.choice(["", digits(2), "." + name() if dot == "." else digits(1)]) + at + name() + dot + r.choice(["example" + dot + "com", "org", "net", "com"])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"({a}){b}-{c}"])

    def ip() -> str:
        return ".".join(str(r.randrange(256)) for _ in range(4))

    def harmless() -> str:
        return r.choice([
            f"version {r.randrange(9)}.{r.randrange(9)}", f"CC BY-NC {r.randrange(9)}.0", digits(r.randrange(1, 9)), f"{digits(2)}.{digits(2)}", f"19{digits(2)}-{digits(2)}-{digits(2)}",
            f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"({digits(1)})", f"{digits(3)}-{digits(2)}", f"{digits(1)},{digits(3)}", name() + " at " + name(), f"{digits(4)}/{digits(2)}",
            f"{name()} (at) {digits(2)}", f"{digits(3)}.{digits(3)}", f"order {digits(6)}", digits(20), f"{digits(2)}:{digits(2)}", name() + digits(3), f"({digits(3)}) {name()}", f"{digits(3)}-{digits(3)}",
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randrange(1, 3)):
            text += "".join(r.choice([name(), name().capitalize(), name() + r.choice(",.")]) + r.choice([" ", " ", " ", "\n"]) for _ in range(r.randrange(0, 5)))
            k = r.randrange(6)
            said = (email, ip, lambda: card(r.choice(["", " ", "-", "."])), phone, harmless, harmless)[k]()
            if k < 4:
                spans.append((len(text), k, len(text) + len(said)))
            text += said + r.choice([" ", ". ", ", ", "\n", " | "])
        out.append((text + "".join(name() + " " for _ in range(r.randrange(0, 4))), spans))
    return out


#: A small table labelled by hand; marks are {kind|text}.
BY_HAND = """
Please write to {email|anna ( at ) example ( dot ) com} before Friday.
Contact: {email|j.doe{at}mail{dot}org}, room 4.
mail me: {email|marta AT uni-bonn DOT de} thanks
{email|support [ at ] firm [ dot ] co [ dot ] uk} answers within 2 days
You find him at home. The dot is small.
reach {email|peter (At) post (Dot) ch} or ring {phone|(044) 555-0199}
Call {phone|555-867-5309} or {phone|+1 212 555 0100} after 5 pm.
tel. {phone|+49 (30) 901820-11}; fax no longer used
We met at 10.30 at the station, platform 12.
server {ip|10 . 0 . 0 . 17} is down, see ticket 48213
ping {ip|192.168.1.254} from version 2.4.1
Section 3.1.4 and section 3.1.5 of 1998
card {card|4111 1111 1111 1111} exp 09/27
pay with {card|5500.0000.0000.0004} today
order 1234 5678 9012 was sent on 2021-03-04
serial 00112233445566778899 is not a number to call
ISBN 978-3-16-148410-0 costs 24.90
it rose from 1,204 to 3,410 in 1987-1990
his address is {email|lee@example . net} as before
look at example.com or at the map
write {email|kim at school dot edu} (no spam)
dot at dot com is no address at all.
population 1 204 567 in 2011
phone: {phone|617.555.0143} ext 9
"""


def by_hand(table: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of each line of a marked table. A mark ends at the last brace before the next mark or line end."""
    rows = []
    for line in table.strip().splitlines():
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(" + "|".join(KINDS) + r")\|((?:[^{}]|\{[^{}|]*\})*)\}", line):
            text += line[at : m.start()]
            spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        rows.append((text + line[at:], spans))
    return rows


@functools.cache
def default_field() -> Field:
    """The field trained on the default tables, once a driver; lines by hand count five times."""
    return train(labelled_table() + by_hand(BY_HAND) * 5)


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that the field reads: MARGIN characters around triggers, widened to white space, merged.

    A text without a trigger has no span that ``passes``. Runs without white space are read whole, however long.
    """
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() + MARGIN <= out[-1][1]:
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        least = out[-1][1] if out else 0
        while a > least and not text[a - 1].isspace():
            a -= 1
        to = SPACE.search(text, b)
        b = to.start() if to else len(text)
        while (more := MORE.match(text, b)) is not None:
            b = more.end()
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def passes(kind: int, said: str) -> bool:
    """The check of a decoded span."""
    d = only_digits(said)
    if kind == 0:
        return EMAIL.fullmatch(said) is not None
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\s{0,3}\.\s{0,3}[0-9]{1,3}){3}", said)) and all(int(x) < 256 for x in re.findall("[0-9]+", said))
    if kind == 2:
        return 12 <= len(d) <= 19 and re.fullmatch("[0-9](?:[^0-9]{0,3}[0-9])+", said) is not None and luhn(d)
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|\+[0-9 ().-]+", said))


def find(field: Field, some: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in some]
    seqs, where = [], []
    for i, t in enumerate(some):
        for a, b in stretches(t):
            places, shapes, gaps = tokens(t, a, b)
            if places:
                seqs.append(features(shapes, gaps))
                where.append((i, places))
    every = [list(x) for x in base]
    for (i, places), y in zip(where, viterbi(field, seqs), strict=True):
        for a, k, b in to_spans(places, y):
            if passes(k, some[i][a:b]) and not any(p < b and a < q for p, _, q in every[i]):
                every[i].append((a, k, b))
    return [(x, sorted(y)) for x, y in zip(base, every, strict=True)]


SPAN = "array<struct<start:int,kind:string,end:int>>"


def detect(docs: DataFrame, field: Field | None = None, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Columns ``keep`` with base and spans (start, kind, end in code points); with ``with_text`` also redacted.

    ``redacted`` is the text with each span replaced by its kind in brackets; overlapping spans are replaced as
    one, by the first kind. A null text counts as empty. Rows are kept; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    field = field or default_field()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker(_HASHES)
        for b in batches:
            said = texts(b.column(b.num_columns - 1))
            found = [x for part in slices(said) for x in find(field, part)]
            told = lambda spans: [{"start": p, "kind": KINDS[k], "end": q} for p, k, q in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            cols = [*b.columns[:-1], pa.array([told(x) for x, _ in found], kind), pa.array([told(y) for _, y in found], kind)]
            if with_text:
                cols.append(pa.array([redact(t, y) for t, (_, y) in zip(said, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "base", "spans", *["redacted"] * with_text])
        give_back()

    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))
    types = dict(d.dtypes)
    return d.mapInArrow(work, ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"base {SPAN}", f"spans {SPAN}", *["redacted string"] * with_text]))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digests(found: DataFrame) -> DataFrame:
    told = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    n = [count(k) for k in KINDS]
    return found.select("doc_id", *n, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
