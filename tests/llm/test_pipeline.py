"""The pipeline's stages on a small table against brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from loomgraph.llm import langid, pii  # noqa: E402
from test_nearcopy import bag, edited, jaccard  # noqa: E402
from test_classifiers import SYLLABLES, text  # noqa: E402


def test_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "BYTES_READ", 300_000)
    r = random.Random(11)
    rows = []
    for i in range(90):
        lang = r.choice(list(SYLLABLES))
        said = text(r, lang, r.randrange(5, 90)) + r.choice(["", " write ann@mail7.example.com ", " 10.2.3.4 "]) + text(r, lang, 12)
        rows.append((i, said, lang, r.choice(["s1", "s2", None]), len(said)))
        if r.random() < 0.3:
            near = " ".join(edited(r, said.split(), 0.004))
            rows.append((1000 + i, near, lang, "s2", len(near)))
    rows += [(5000, None, None, "s1", 0), (5001, "", "aa", "s1", 0), (5002, "12 34", "aa", None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.language(spark, docs, "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(x[0] for x in rows if x[0] < 5000)
    root = {}
    for x in sorted(kept):  # near copies here come in pairs with a base of lower id
        root[x.doc_id] = next((b.doc_id for b in sorted(kept) if b.doc_id < x.doc_id and jaccard(bag(b.text), bag(x.text)) >= 0.8), x.doc_id)
    first = pipeline.near_copies(spark, spark.createDataFrame(kept), "").collect()
    assert sorted(x.doc_id for x in first) == sorted({v for k, v in root.items() if v == k})
    clean = pipeline.personal_data(spark, spark.createDataFrame(first, docs.schema), "").collect()
    assert len(clean) == len(first) and not any(pii.base_spans(x.text) for x in clean) and all(x.n_chars == len(x.text) for x in clean)
    mixed = pipeline.mixture(spark, spark.createDataFrame(clean, docs.schema), "").collect()
    words = lambda xs: sum(len(x.text.split()) for x in xs)
    assert {x.doc_id for x in mixed} <= {x.doc_id for x in clean} and abs(words(mixed) - 1.5 * words(clean)) < 400
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in mixed) and all(len(x.ids) == 4 * x.n_tokens > 0 for x in got)
