"""What an operator keeps in a Python worker goes when another operator's task begins there."""

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from loomgraph.llm import bpe, langid, nearcopy, pii  # noqa: E402
from loomgraph.llm.queries import tokenizer_file  # noqa: E402


def test_caches_of_one_operator_only(spark, monkeypatch):
    df = spark.createDataFrame([(1, "some words here, some more there", b"k")], "doc_id long, text string, node binary")
    found, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, work, *a, **b: found.append(work) or real(self, work, *a, **b))
    bpe.encode_documents(df, tokenizer_file("word_bpe_49k.json"))
    langid.predict(df, langid.new_network(["aa", "bb"]))
    pii.detect(df)
    nearcopy._nodes(df)
    encode, predict, detect, sign = found
    batch = lambda *c: iter([pa.RecordBatch.from_arrays([pa.array([x]) for x in c], names=[str(k) for k in range(len(c))])])
    said = "some words here, some more there: ann@mail7.example.com"
    ids = next(encode(batch(1, said))).column(1).to_pylist()
    assert bpe._ENCODERS and ids[0]
    lang = next(predict(batch(1, said))).column(1).to_pylist()
    assert not bpe._ENCODERS and not bpe._VOCABULARIES and langid._READERS
    next(detect(batch(1, said)))
    assert not langid._READERS and pii._HASHES
    assert next(encode(batch(1, said))).column(1).to_pylist() == ids and not pii._HASHES
    kept = bpe._ENCODERS.copy()
    next(encode(batch(2, said)))
    assert bpe._ENCODERS == kept  # the same operator goes on with what it has
    next(sign(batch(b"k", 1, said)))
    assert not bpe._ENCODERS
    assert next(predict(batch(1, said))).column(1).to_pylist() == lang
