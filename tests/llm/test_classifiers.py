"""Language and toxicity: gradients, held-out accuracy, hard cases."""

import random

import numpy as np

from loomgraph.llm import langid, toxicity

SYLLABLES = {"aa": ["th", "ing", "er", "wh", "ou"], "bb": ["sch", "ung", "ei", "zu", "ä"], "cc": ["ción", "ado", "que", "ll", "ñ"]}


def text(r, lang, n=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    net = langid.new_network(["a", "b", "c"])
    for p in (net.table, net.inner):
        p[:] = [x.astype(np.float64) for x in p]
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    x, y = r.integers(0, 256, (3, 6)).astype(np.uint8), np.array([0, 2, 1])
    x[0] = x[1]
    g, _ = langid.gradients(net, x, y)
    for p, d in zip(net.parameters(), g, strict=True):
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(6)] + ([(x[0, 2], 5)] if p.shape[0] == 256 else []):
            old, e = p[at], 1e-3
            p[at] = old + e
            up = langid.gradients(net, x, y)[1]
            p[at] = old - e
            down = langid.gradients(net, x, y)[1]
            p[at] = old
            assert abs((up - down) / (2 * e) - d[at]) < 2e-4


def test_language_of_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "BYTES_READ", 300_000)
    r = random.Random(3)
    rows = [(i, text(r, lang, r.randrange(3, 80)), lang, "x") for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(240))]
    odd = [(1000, None, None, "x"), (1001, "", "aa", "x"), (1002, "12 !!", "bb", "x"), (None, text(r, "cc"), None, "x"), (1003, text(r, "bb", 9000), "bb", "x"), (1003, text(r, "bb", 20), "bb", "x"), (1004, "thing" * 4000, "aa", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    from pyspark.sql import functions as F

    held = langid.fold(F.col("doc_id"), 4) == 2
    got = {(x.doc_id, x.lang): x for x in langid.predict(df, langid.learn(df, ~held), keep=("doc_id", "lang")).collect()}
    assert sum(got[i, lang].lang_pred == lang for i, _, lang, _ in rows) >= 0.97 * len(rows)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in ((1000, None), (1001, "aa"), (1002, "bb")))
    assert got[None, None].lang_pred == "cc" and got[1003, "bb"].lang_pred == "bb" and got[1004, "aa"].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())
    none = langid.predict(df, langid.learn(df.limit(0)))
    assert {x.lang_pred for x in none.collect()} == {"und"} and langid.predict(df.limit(0), None).count() == 0


def test_pooling_over_windows_with_context(monkeypatch):
    net = langid.new_network(["a", "b"])
    monkeypatch.setattr(langid, "WINDOW", 20)
    monkeypatch.setattr(langid, "CONTEXT", 7)
    some = ["ab cde é " + "x" * 100 + " ab", "z", "", "q" * 20, "two words and more é" * 9]
    for piece in (1 << 20, 33):
        monkeypatch.setattr(langid, "PIECE", piece)
        got = langid.Reader(net).read(some)
        for k, t in enumerate(some):
            b = np.frombuffer(t.encode(), np.uint8)
            p = []
            for part in range(0, len(b), piece):  # parts, then windows, each with the bytes around it
                end = min(part + piece, len(b))
                for i in range(part, end, 20):
                    lo, hi = max(0, max(part - 7, i - 7)), min(len(b), end + 7, min(i + 20, end) + 7)
                    p.append(langid.positions(net, b[None, lo:hi])[0][i - lo : min(i + 20, end) - lo])
            want = np.concatenate(p).mean(axis=0) if p else np.zeros(2)
            assert np.allclose(got[k], want, atol=1e-5)


def test_words_have_context():
    """The same word is read differently after different words."""
    net = langid.new_network(["a", "b"])
    one, two = (langid.positions(net, np.frombuffer(x.encode(), np.uint8)[None])[0][-4:] for x in ("tttt word", "zzzz word"))
    assert np.abs(one - two).max() > 1e-4


def test_toxic_words_and_their_misspellings(spark):
    r = random.Random(1)
    bad = ["worthless", "disgusting", "pathetic", "stupid"]
    rows, labels = [], []
    for i in range(500):
        words = text(r, r.choice(list(SYLLABLES)), r.randrange(20, 150)).split()
        y = int(i % 4 == 0)
        for _ in range(y * max(2, len(words) // 25)):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), "q"))
        labels.append((i, y, 1))
    rows += [(1000, "thing " * 30 + "worthles disgustingg patthetic", "q"), (1001, "thing wher er " * 12, "q"), (1002, None, "q"), (1003, "", "q"), (None, "er " * 50, "q"), (1004, "wher thing " * 20000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([*labels, labels[0], (5000, 1, 1), (1001, None, 0)], "doc_id long, toxic int, quality int")
    from pyspark.sql import functions as F

    m = toxicity.learn(df, lab, langid.fold(F.col("doc_id"), 5) != 0)
    got = {x.doc_id: x for x in toxicity.score(df, m).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    held = [(got[i].predicted, y) for i, y, _ in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) and {y for _, y in held} == {0, 1}
    assert got[1000].score > 0.5 > got[1001].score and got[1002].score == got[1003].score
    assert {x.score for x in toxicity.score(df, toxicity.learn(df, lab.limit(0))).collect()} == {0.0}
