"""Nothing of a long text is left out."""

import random

import numpy as np

from loomgraph.llm import fingerprint, toxicity


def test_toxic_words_far_inside_a_run_without_blanks_count(monkeypatch):
    r = random.Random(6)
    plain = lambda n: "-".join("".join(r.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))
    text = lambda bad: f"{plain(20)}-{'zorkwug' if bad else plain(1)}-{plain(3)}"
    s = toxicity.Scorer(toxicity.train([(text(k % 2), k % 2) for k in range(300)]))
    new = [(text(k % 2), k % 2) for k in range(100)]
    found = s.odds([t for t, _ in new])
    assert np.mean([(x > 0) == y for x, (_, y) in zip(found, new)]) > 0.95
    assert s.odds(["b" * 100 + "zorkwug"]) != s.odds(["b" * 100 + "sunnyle"])
    assert all(len(w) <= toxicity.LONG for w in s.kept.young)

    words = ["", "a", ",,", "é" * 7, "".join(r.choice("abc漢字") for _ in range(1000)), "tail", plain(40)]
    whole = toxicity.subwords(words)
    assert whole[1].tolist() == [1 + sum(max(0, len(w.strip(toxicity.EDGES)) + 3 - g) for g in toxicity.GRAMS) for w in words]
    monkeypatch.setattr(toxicity, "PIECE", 50)
    parts = toxicity.subwords(words)
    assert parts[1].tolist() == whole[1].tolist()
    for a, b in zip(*(np.split(x[0], np.cumsum(x[1])[:-1]) for x in (whole, parts))):
        assert sorted(a) == sorted(b)


def test_likeness_counts_every_anchor_of_both_texts(spark):
    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("aeiourstl") for _ in range(6)) for _ in range(n))
    shared = words(80)
    rows = [(1, f"{words(3000)} {shared} {words(900)}"), (2, f"{shared} {words(2000)}"), (3, words(3)), (4, "a b c d e f g h " * 40), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at = {x.doc_id: {} for x in df.collect()}
    for x in fingerprint.with_anchors(df, "text", "a").collect():
        for y in x.a:
            at[x.doc_id].setdefault(y.hash, y.pos)
    got = {x.doc_id: x for x in fingerprint.fingerprints(df).collect()}
    for k in at:
        a, b = at[k], at[k % 5 + 1]
        assert got[k].near_next == len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    assert 0.005 < got[1].near_next < 0.05
    d = fingerprint.with_anchors(df.where("doc_id = 1"), "text", "a").crossJoin(fingerprint.with_anchors(df.where("doc_id = 2"), "text", "b").select("b"))
    found = fingerprint.with_matches(d, "a", "b", "m").first().m
    assert sorted(map(tuple, found)) == sorted((at[1][h], at[2][h]) for h in at[1].keys() & at[2].keys()) and len(found) > 20
