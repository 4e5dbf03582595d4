"""Chat formatting, mixing and fingerprints against plain Python."""

import hashlib
import math
import random
import re

from loomgraph.llm import chat, fingerprint, mixing

MARKS = ["</s>", "[INST]", "<|turn|>", "<|end|>", "\\", "\\l", "\\b", "<", "[", "é", " ", "\n", "x", "😀", "<|image|>"]


def test_chats_read_back(spark):
    r = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 8)):
            rows.append((c, t, r.choice(["user", "assistant", "sys<tem>", None]), r.choice([None, "", "".join(r.choice(MARKS) for _ in range(r.randrange(0, 30)))]), "z"))
    rows += [(None, 1, "assistant", "alone", "z"), (None, None, "user", "first", "z"), (50, 3, "assistant", "tie b", "z"), (50, 3, "assistant", "tie a", "z"), (50, 3, "assistant", "tie a", "z"), (51, 0, "assistant", "y" * 200000, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(df)
    got = {x.conv_id: x for x in chat.chat_digests(chat.read_chats(formatted)).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        flat, loss = "".join(f"{a}\n{b}\n" for _, _, a, b in turns), "".join(b for _, _, a, b in turns if a == "assistant")
        x = got[c]
        assert (x.n_turns, x.loss_chars) == (len(turns), len(loss))
        assert x.turns_sha256 == hashlib.sha256(flat.encode()).hexdigest() and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for x in formatted.collect():  # content cannot bring markers in
        assert x.formatted.count("<|turn|>") == len(by[x.conv_id]) and "[INST]" not in x.formatted
    assert chat.format_chats(df.limit(0)).count() == 0


def test_typed_parts_become_placeholders(spark):
    rows = [(1, 0, "user", [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.01, None)]), (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("odd", None, "d", None, None, None, None)]), (1, 2, "user", None)]
    x = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text array<{chat.PART}>")).first()
    assert "see \\l|image|> <|image|><|audio|><|end|>" in x.formatted and "<|document|><|file|>" in x.formatted
    assert [(a.turn, a.kind, a.uri, a.tokens) for a in x.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 26), (1, "document", "c.pdf", 768), (1, "odd", "d", 0)]
    assert x.n_attachment_tokens == 797


def plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(t) for _, z, t in rows if z == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    left, target, open_ = share * sum(total.values()), {}, set(sources)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * total[s]}
        for s in full or open_:
            target[s] = most * total[s] if full else level * w[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    return size, total, target


def test_mix_meets_targets(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", "é", None, "hot", "hot", "hot"]), r.choice([None, "", " w\x85x " * r.randrange(1, 60)])) for i in range(500)] + [(None, "a", "q q"), (7, "b", "dup dup"), (7, "b", "dup dup"), (900, "long", "w " * 50000)]
    df = spark.createDataFrame([(a, b, c, 5) for a, b, c in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(df).collect()
    size, total, target = plain_mix(rows)
    assert len(got) == len(rows) and mixing.mix(df).select("doc_id", "text", "taken").exceptAll(spark.createDataFrame(got).select("doc_id", "text", "taken")).count() == 0
    taken = {}
    for x in got:
        assert x["size"] == size(x.text) and x.source_size == total[x.source] and math.isclose(x.target, target[x.source], abs_tol=1e-6)
        assert 0 <= x.taken <= 2 * x["size"]
        taken[x.source] = taken.get(x.source, 0) + x.taken
    longest = {s: max(size(t) for _, z, t in rows if z == s) for s in total}
    assert all(target[s] - 2 * longest[s] <= taken[s] <= target[s] + 1e-6 for s in total)
    assert mixing.mix(df.limit(0)).count() == 0
    copies = mixing.mixed_rows(df)
    assert copies.columns == df.columns and copies.count() == sum(x.repeats for x in got)


def plain_anchors(text, rank):
    """Closed syncmers with the ranks of inner substrings given, by position."""
    w = re.findall(r"[^\x20\x09-\x0d]{1,32}", text)
    s = [rank[tuple(w[i : i + 2])] for i in range(len(w) - 1)]
    return [i for i in range(len(w) - 4) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]


def test_anchors_are_closed_syncmers(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    some = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(n)) for n in (0, 1, 4, 5, 6, 30, 200)] + ["x" * 200, "日本語" * 60]
    df = spark.createDataFrame(list(enumerate(some)), "id int, text string")
    pairs = {tuple(w[i : i + 2]) for t in some for w in [re.findall(r"[^\x20\x09-\x0d]{1,32}", t)] for i in range(len(w) - 1)}
    p = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h"))
    rank = {(x.a, x.b): x.h for x in p.collect()}
    for x in fingerprint.with_anchors(df, "text", "anchors").collect():
        want = plain_anchors(x.text, rank)
        assert [a.pos for a in x.anchors] == (want or [0])


def test_fingerprints(spark):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("aeiourstlé") for _ in range(r.randrange(2, 8))) for _ in range(n))
    rows = [(10 * i, words(r.randrange(0, 300))) for i in range(40)] + [(55, None), (56, ""), (57, "\n"), (None, "a b"), (999, words(20000)), (58, "tie one"), (58, "tie two"), (58, "tie two")]
    df = spark.createDataFrame([(a, b, "e") for a, b in rows], "doc_id long, text string, edited string")
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == len(rows)
    unique = sorted({(d is not None, d or 0, t or "") for d, t in rows if d != 58})
    follows = {x[1] if x[0] else None: unique[(i + 1) % len(unique)] for i, x in enumerate(unique)}
    text = {d: t or "" for d, t in rows}
    for x in got:
        if x.doc_id == 58 or x.doc_id == 57:
            continue
        t = text[x.doc_id]
        n = len(t) // 4
        want = t[: len(t) - n] + follows[x.doc_id][2][:n]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if len(t) > 400:
            assert x.near_edited > 0.3 > x.near_next
    prints = {}
    for x in got:
        if x.doc_id != 58:
            assert prints.setdefault(text[x.doc_id], x.fingerprint) == x.fingerprint
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    one = fingerprint.fingerprints(df.where("doc_id = 999")).first()
    assert one.near_next == 1.0
