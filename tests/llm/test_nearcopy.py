"""Near copies against brute force; BagMinHash against exact weighted Jaccard."""

import random
from collections import Counter, defaultdict

import numpy as np

from loomgraph.llm import nearcopy


def bag(t):
    w = [x for x in __import__("re").split("[ \t-\r]+", t or "") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def edited(r, words, share):
    return [r.choice("qrstuvw") * 3 + str(r.randrange(10**6)) if r.random() < share else w for w in words]


def sample(r):
    out = []
    for _ in range(14):
        base = [r.choice("abcdefg") * r.randrange(1, 5) + str(r.randrange(400)) for _ in range(r.randrange(1, 220))]
        if r.random() < 0.3:
            base = base[:8] * 12
        out.append(" ".join(base))
        for share in (0.0, 0.005, 0.02, 0.06):
            for _ in range(3):
                out.append(" ".join(edited(r, base, share)))
    return out + ["", None, " \n", "one", "one two", "one two", "x" * 5000, "é è ê ü ö", "é è ê ü ö"]


def test_classes_equal_brute_force(spark):
    some = sample(random.Random(4))
    rows = [(i, t, "n") for i, t in enumerate(some)] + [(None, "alone with no id at all", "z"), (3, some[3], None)]
    got = {(r.doc_id, r.class_id, r.class_size) for r in nearcopy.near_classes(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()}
    bags = [bag(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    want = {(d, min((x for x in c if x is not None), default=None), len(c)) for c in classes.values() for d in c}
    assert got == want
    assert nearcopy.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each(spark):
    rows = [(5, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (9, "something else entirely here now", "x"), (9, "something else entirely here now", "x"), (None, "no id one", "x"), (None, "no id two", "x"), (None, "a b c d e f g", "x")]
    got = nearcopy.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"] and sorted((str(r.doc_id), r.text[:9]) for r in got.collect()) == [("2", "a b c d e"), ("9", "something"), ("None", "no id one"), ("None", "no id two")]


def test_registers_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    a = {int(x): int(r.integers(1, 40)) for x in r.integers(0, 2**48, 60)}
    b = {k: (v if r.random() < 0.6 else int(r.integers(1, 40))) for k, v in a.items() if r.random() < 0.9} | {int(x): 5 for x in r.integers(0, 2**48, 8)}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    hits = n = 0
    for turn in range(40):
        doc, el, w = [], [], []
        for i, x in enumerate((a, b)):
            doc += [i] * len(x)
            el += [(k * 2654435761 + turn * 97) % 2**48 for k in x]
            w += list(x.values())
        m = nearcopy.bag_min_hash(np.array(doc), np.array(el, np.uint64), np.array(w), 2)
        hits += int((m[0] == m[1]).sum())
        n += m.shape[1]
    assert abs(hits / n - want) < 0.02


def test_overlap_is_exact():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.sort(r.integers(0, 12, int(r.integers(0, 40)))).astype(np.uint64) for _ in range(2))
        x, y = Counter(a.tolist()), Counter(b.tolist())
        want = sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
        assert nearcopy.overlap(a, b) == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([200]), bytes([100 + i])) for i in range(30)]
    got = {r.node[0]: r.root[0] for r in nearcopy.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 100}
