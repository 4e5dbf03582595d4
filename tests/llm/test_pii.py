"""Patterns against plain regular expressions; the field against brute force and on held-out sentences."""

import itertools
import random
import re

import numpy as np

from loomgraph.llm import pii

PLAIN = {
    0: (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    1: (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    2: (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    3: (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in PLAIN.items() for m in p.finditer(text) if ok(m[0]))


def test_base_spans_equal_plain_patterns():
    r = random.Random(1)
    bits = ["a@b.c", "@", ".", "-", "x.y@z", "é", " ", "\n", "1", "255", "256", "10.0.0.1", "0000001", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "+", "(", ")", "%", "_", "com", "٣", "79927398713"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))
        assert pii.base_spans(t) == plain(t), t
    for t in ("a" * 50000 + "@", "@" * 50000, "1" * 50000, "1." * 20000, "+1" + "(" * 50000, "a@" * 20000):
        pii.base_spans(t)


def test_luhn():
    assert pii.luhn("4111111111111111") and pii.luhn("79927398713") and not pii.luhn("79927398710")


def small_field(seed=0):
    r = np.random.default_rng(seed)
    n = len(pii.LABELS)
    return pii.Field(r.standard_normal((pii.FEATURES, n)), r.standard_normal((n, n)), r.standard_normal(n))


def test_viterbi_and_likelihood_equal_brute_force():
    r, f = np.random.default_rng(2), small_field()
    seqs = [r.integers(0, pii.FEATURES, (n, 2)).tolist() for n in (1, 3, 4, 2, 3)]
    every = lambda n: itertools.product(range(len(pii.LABELS)), repeat=n)

    def worth(s, y):
        return f.first[y[0]] + sum(f.emit[x, k] for x, k in zip(s[0], [y[0]] * 2)) + sum(f.move[y[i - 1], y[i]] + sum(f.emit[x, y[i]] for x in s[i]) for i in range(1, len(s)))

    got = pii.viterbi(f, seqs)
    want, z, true = [], [], []
    for s in seqs:
        all_ = [(worth(s, y), y) for y in every(len(s))]
        want.append(list(max(all_)[1]))
        z.append(np.log(np.exp([w for w, _ in all_]).sum()))
        true.append(list(all_[7][1]))
    assert got == want
    x, n = pii._padded(seqs)
    y = np.zeros(x.shape[:2], int)
    for i, own in enumerate(true):
        y[i, : len(own)] = own
    value, g = pii.likelihood(f, x, n, y)
    assert abs(value - (sum(worth(s, t) for s, t in zip(seqs, true)) - sum(z)) / n.sum()) < 1e-9
    for p, d in ((f.move, g.move), (f.emit, g.emit), (f.first, g.first)):
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(5)] + ([(seqs[0][0][0], 3)] if p.shape[0] == pii.FEATURES else []):
            old = p[at]
            p[at] = old + 1e-5
            up = pii.likelihood(f, x, n, y)[0]
            p[at] = old - 1e-5
            down = pii.likelihood(f, x, n, y)[0]
            p[at] = old
            assert abs((up - down) / 2e-5 - d[at]) < 1e-6


def test_field_on_held_out_sentences():
    f = pii.train(pii.labelled_table())
    held = pii.labelled_table(300, seed=99)
    hit = total = wrong = said = 0
    for (t, want), (_, got) in zip(held, pii.find(f, [t for t, _ in held]), strict=True):
        w = {(a, b) for a, _, b in want}
        g = {(a, b) for a, _, b in got}
        hit += len(w & g)
        total += len(w)
        said += len(g)
        wrong += sum(not any(a < q and p < b for p, q in w) for a, b in g)
    assert hit >= 0.9 * total and wrong <= 0.02 * said


def test_detect(spark):
    rows = [(1, "write ann@mail7.example.com or call (017) 555-7713 now", "s"), (2, None, "s"), (None, "", "s"), (3, "no data 3.0 at all, version 2.0", "s"), (4, "x " * 60000 + "10.1.2.3", "s"), (4, "x " * 60000 + "10.1.2.3", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(pii.detect(df, with_text=True).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [x.kind for x in got[0].spans] == ["email", "phone"] and [x.kind for x in got[0].base] == ["email"]
    assert got[0].redacted == "write [EMAIL] or call [PHONE] now"
    assert got[1].spans == [] and got[1].redacted == "" and got[2].spans == [] and got[4].spans == got[3].spans != [] and len(got) == 6
    d = pii.digests(pii.detect(df)).where("doc_id = 4").first()
    assert d.n_ip == 1 and d.spans == "ip:120000:120008" and len(d.base_sha256) == 64
    assert pii.detect(df.limit(0)).count() == 0
