"""Ties, triggers, hand-labelled text, unknown languages, empty tables, clashing names, large buckets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, langid, mixing, nearcopy, pii, toxicity

#: Lines for measuring only; training has its own in pii.BY_HAND.
HELD = """
ask {email|nora (at) lab (dot) eu} for the 3 keys
{email|info [at] shop [dot] com} or {phone|(212) 555-0188}
Mail {email|tim AT web DOT de}, not before 8.
she waited at noon. Nobody came at 7.45 either
host {ip|172.16.0.9} and host {ip|8.8.4.4}
visa {card|4012-8888-8888-1881} declined
the {card|3782 822463 10005} was charged 49.90
order 99881 of 2020-12-01, total 1.204,50
{phone|+44 20 7946 0018} is the desk, ext 114
dial {phone|312-555-0137} now
write to {email|o.berg ( at ) mail ( dot ) no} soon
page 12, line 4.5.6, build 20230114
{email|rosa at garden dot org} grows them
chapter 10 at 10.10.10 of 1850
his fax: {phone|(030) 555-4471}.
{email|hello {at} site {dot} io}
"""


def test_chat_ties_go_by_unescaped_text(spark):
    said = ["a!", "a", "<x", "Zx", "[b", "\\", "a\n", "ab"]
    rows = [(1, 0, "user", x) for x in said] + [(2, None, None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert got == {1: sorted(said), 2: ["", ""]}


def test_every_span_that_passes_is_read():
    r = random.Random(6)
    parts = ["at", "At", "AT", "dot", "Dot", "(at)", "( at )", "{dot}", "[ DOT ]", ".", "@", "anna", "x", "com", "7", "12", "+1", " ", " ", "\n", " ", "-", "(", ")", "w" * 60]
    found = 0
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(3, 14)))
        read = pii.stretches(text)
        for a in range(len(text)):
            for b in range(a + 1, min(len(text), a + 130) + 1):
                if any(pii.passes(k, text[a:b]) for k in range(4)):
                    found += 1
                    assert any(p <= a and b <= q for p, q in read), (text, text[a:b])
    assert found > 200


def test_field_on_lines_labelled_by_hand():
    hit = total = wrong = 0
    for text, spans in pii.by_hand(HELD):
        ((_, got),) = pii.find(pii.default_field(), [text])
        hit, total, wrong = hit + len(set(got) & set(spans)), total + len(spans), wrong + len(set(got) - set(spans))
    assert total == 14 and hit >= 10 and wrong <= 2


def test_pipeline_without_languages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "some words here", None, "a", 15), (2, "12 34", None, "a", 5), (3, None, None, "a", None), (4, "été", None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.language(spark, df, "").collect()) == [1, 4]
    for _, stage in pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0


def test_mix_tells_documents_without_id_by_text(spark):
    r = random.Random(1)
    rows = [(None, " ".join(r.choice("abcdef") for _ in range(10)) + f" {i}", "s") for i in range(400)] + [(i, "a b c d", "t") for i in range(1200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(x.n - x.t) <= 0.01 * x.t + 12 for x in got)


def test_labels_that_clash_are_toxic(spark):
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1), (41, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "vile" if i % 2 else "kind") for i in range(42)], "doc_id long, text string")
    one, two = (toxicity.learn(docs, lab.repartition(n), None) for n in (1, 7))
    assert one.key() == two.key() and toxicity.score(docs.limit(0), one).count() == 0


def test_prediction_refuses_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, score double")
    with pytest.raises(ValueError, match="score"):
        langid.predict(df, None, keep=("doc_id", "score"))


def test_bucket_of_one_large_component_and_a_few_odd_nodes(spark, monkeypatch):
    """Comparisons of blocks are foreign ones only, and none is lost."""
    monkeypatch.setattr(nearcopy, "BLOCK", 50)
    r = np.random.default_rng(5)
    base, n, odd = r.integers(0, 256, nearcopy.REGISTERS).astype(np.uint8), 3000, 4
    rows = []
    for i in range(n + odd):
        sig = base.copy()
        if i >= n:
            at = r.choice(nearcopy.REGISTERS, 40 if i < n + 2 else 400, replace=False)
            sig[at] ^= 1
        rows.append((7, i, 0 if i < n else i, [7, *range(100 + i * 30, 123 + i * 30)], bytearray(sig.tobytes())))
    df = spark.createDataFrame(rows, "key long, nid long, root long, bands array<long>, sig binary")
    got = {(x.a, x.b) for x in nearcopy._blocks(df, 0.8).collect()}
    sigs = np.frombuffer(b"".join(bytes(x[4]) for x in rows), np.uint8).reshape(-1, nearcopy.REGISTERS)
    least = nearcopy._least(0.8)
    want = {(a, b) for b in range(n, n + odd) for a in range(b) if (sigs[a] == sigs[b]).sum() >= least}
    assert got == want and len(want) >= 2 * n


def test_verified_pairs_of_a_hub_in_many_slots(spark, monkeypatch):
    monkeypatch.setattr(nearcopy, "SLOT", 300)
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    some = [" ".join(base)] + [" ".join(w if r.random() > share else "zz" + str(r.random()) for w in base) for share in (0.0, 0.01, 0.03, 0.2) for _ in range(15)]
    bags = []
    for t in some:
        h, _ = nearcopy.shingles([t])
        b = np.sort(h).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        assert nearcopy.unpacked(b).tolist() == sorted(h.tolist())
        bags.append((len(bags), len(b), bytearray(b)))
    pairs = spark.createDataFrame([(0, k) for k in range(1, len(some))], "a long, b long")
    got = {x.b for x in nearcopy._verify(pairs, spark.createDataFrame(bags, "nid long, size long, bag binary"), 0.8).collect()}
    of = lambda t: {tuple(w) for w in zip(*[t.split()[i:] for i in range(5)])}
    want = {k for k in range(1, len(some)) if len(of(some[0]) & of(some[k])) / len(of(some[0]) | of(some[k])) >= 0.8}
    assert got == want and 10 < len(want) < len(some) - 10 and re.fullmatch("w0", base[0])
