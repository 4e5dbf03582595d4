"""Token ids in files of directly addressable codes.

An id is split into bytes, the levels. Level 0 has the low byte of every id; a bitmap says which ids go on;
level 1 has the next byte of those only, and so on. A directory of ranks, one count each 512 bits, finds an
id's place on the next level, so any token is read without decoding a block.

A file holds the documents of one range of doc_id in ascending order:

    8 bytes   magic LOOMDAC1
    8 x int64 documents, tokens, levels, then zeros
    int64     doc_id by document (null as the least int64), then first token by document and the number of tokens
    by level  int64 n; n bytes; bitmap of ceil(n / 8) bytes, least bit first; ranks, uint32 each 512 bits

Files are named by attempt and listed in a manifest table; a lost or repeated task leaves files that no
manifest names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import sharedfs
from loomgraph.llm.bpe import Words, vocabulary
from loomgraph.llm.common import small_batches, work_dir

MAGIC, BLOCK = b"LOOMDAC1", 512
#: Tokens after which a file ends; it bounds the memory of a writer or reader.
FILE_TOKENS = 8_000_000
NO_ID = -(2**63)
#: Bytes of texts that are encoded at once.
AT_ONCE = 12 << 20
#: Words behind a blank that a worker keeps; how byte-level vocabularies write a blank.
SPACED_KEPT, BLANK = 1_200_000, "\u0120"
#: Words that aren't encoded together with others: with white space but newlines inside, or what may be a special token.
NOT_JOINED = r"\A(?:[\s\x1c-\x1f]|\z)|[\s\x1c-\x1f]\z|[\t\r\f\v\x1c-\x1f]|<\|"
#: A piece is a run of blanks with the word after it: pre-tokens never reach from a word into blanks.
PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space beyond blank and newline, where cutting at blanks could go wrong.
OTHER = "\\t\\x0b-\\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = re.compile(f"[{OTHER}]")
#: The same, or a run of blanks and newlines before a blank.
UNEVEN = f"[{OTHER}]|[ \\n] "


class Levels:
    """Random access to the ids of a file; ids by slice without touching others."""

    def __init__(self, data: bytes):
        assert data[:8] == MAGIC, "not a file of directly addressable codes"
        self.n_docs, self.n_tokens, levels = np.frombuffer(data, "<i8", 3, 8).tolist()
        at = 72
        self.docs = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(data, "<i8", 1, at)[0])
            codes = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", n // BLOCK + 1, at)
            at += 4 * len(ranks)
            self.levels.append((codes, bits, ranks))

    def rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, bits, ranks = self.levels[level]
        b = i // BLOCK
        own = np.unpackbits(bits[b * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - b * BLOCK]
        return int(ranks[b]) + int(own.sum())

    def token(self, i: int) -> int:
        value, level = 0, 0
        while True:
            codes, bits, _ = self.levels[level]
            value |= int(codes[i]) << 8 * level
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b - 1."""
        out = np.zeros(b - a, np.uint32)
        where = None
        for level, (codes, bits, _) in enumerate(self.levels):
            if b <= a:
                break
            own = codes[a:b].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= own
            else:
                out[where] |= own
            on = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            where = np.flatnonzero(on) if where is None else where[on]
            a = self.rank(level, a)
            b = a + len(where)
        return out


def pack(doc_ids, lengths, ids: np.ndarray) -> list[bytes]:
    """A file's byte strings."""
    starts = np.zeros(len(lengths) + 1, "<i8")
    np.cumsum(lengths, out=starts[1:])
    parts, rest = [], ids.astype("<u4")
    while True:
        on = rest > 255
        bits = np.packbits(on, bitorder="little")
        sums = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        ranks = np.zeros(len(rest) // BLOCK + 1, "<u4")
        ranks[1:] = np.cumsum(sums)[: len(ranks) - 1]
        parts.append([np.array([len(rest)], "<i8").tobytes(), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()])
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            break
    head = np.zeros(8, "<i8")
    head[:3] = len(doc_ids), len(ids), len(parts)
    return [MAGIC, head.tobytes(), np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), *[x for p in parts for x in p]]


def plain(texts_: pa.Array) -> np.ndarray:
    """Which texts have single blanks only, so that no pre-token of byte-level BPE crosses a cut before a blank."""
    return ~pc.match_substring_regex(texts_, UNEVEN).to_numpy(zero_copy_only=False)


class ByteEncoder:
    """Encodes texts by distinct piece; a text is gathered from the ids of its pieces.

    Texts are split at blanks, and equal words numbered, by Arrow. A worker keeps the ids of words met behind a
    blank in one array, until it holds more than SPACED_KEPT words. New words are encoded together in one text.
    """

    def __init__(self, path: str):
        self.words = Words(path)
        names = vocabulary(self.words.tokenizer)
        self.blank = np.array([x.startswith(BLANK) for x in names] or [False])
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep words of known ids."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, words])

    def _alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = self.words.encode([" " + w for w in words.to_pylist()])
        return np.frombuffer(b"".join(own), np.uint32), np.array([len(x) // 4 for x in own], np.int64)

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of words without white space, each behind a blank, encoded in one text.

        Pre-tokens begin at such a blank, and only those do; if their count is another, words are encoded alone.
        """
        text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        ids = np.array(self.words.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        first = np.flatnonzero(self.blank[ids])
        return (ids, np.diff(np.append(first, len(ids)))) if len(first) == len(words) else self._alone(words)

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where ``starts`` and ``sizes`` have the words as they are behind a blank; new ones are learned."""
        if len(self.known) > SPACED_KEPT:
            self._clear()
        at = pc.index_in(distinct, value_set=self.known)
        if at.null_count:
            new = distinct.filter(pc.is_null(at))
            alone = pc.match_substring_regex(new, NOT_JOINED)
            if pc.any(alone).as_py():
                self._add(x := new.filter(alone), *self._alone(x))
                new = pa.concat_arrays([x, y := new.filter(pc.invert(alone))])
            else:
                y = new
            for i in range(0, len(y), 5000):
                self._add(z := y.slice(i, 5000), *self._joined(z))
            found = at.to_numpy(zero_copy_only=False)
            place = np.where(np.isnan(found), -1, found).astype(np.int64)
            place[place < 0] = len(self.known) - len(new) + pc.index_in(distinct.filter(pc.is_null(at)), value_set=new).to_numpy()
            return place
        return at.to_numpy().astype(np.int64)

    def flat(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of all texts in order."""
        even = plain(some)
        split = pc.split_pattern(some.filter(pa.array(even)), " ")
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        place = self.places(words.dictionary)[words.indices.to_numpy()]
        starts, sizes = self.starts[place], self.sizes[place]
        doc = np.repeat(np.flatnonzero(even), count)
        # a text's first word has no blank before it, and other texts are encoded on their own
        first = np.cumsum(count) - count
        firsts = split.flatten().take(pa.array(first)).to_pylist()
        others = some.filter(pa.array(~even)).to_pylist()
        self.words.learn([[w] for w in firsts if w])
        memo = self.words.memo.young
        own = [memo[w] if w else b"" for w in firsts]
        cut = [None if ODD.search(t) else PIECE.findall(t) for t in others]
        self.words.learn(x for x in cut if x)
        memo = self.words.memo.young
        whole = iter(self.words.encode([t for t, x in zip(others, cut, strict=True) if x is None]))
        own += [next(whole) if x is None else b"".join(map(memo.__getitem__, x)) for x in cut]
        flat = np.concatenate([self.ids[: self.used], np.frombuffer(b"".join(own), np.uint32)])
        n = np.array([len(x) // 4 for x in own], np.int64)
        at = self.used + np.cumsum(n) - n
        starts[first], sizes[first] = at[: len(first)], n[: len(first)]
        if len(others):
            order = np.argsort(np.concatenate([doc, np.flatnonzero(~even)]), kind="stable")
            doc = np.concatenate([doc, np.flatnonzero(~even)])[order]
            starts, sizes = np.concatenate([starts, at[len(first) :]])[order], np.concatenate([sizes, n[len(first) :]])[order]
        lengths = np.bincount(doc, sizes, len(some)).astype(np.int64)
        total = int(sizes.sum())
        number = np.int32 if max(total, len(flat)) < 2**31 else np.int64
        at = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(number), sizes)
        at += np.arange(total, dtype=number)
        return lengths, flat[at]

    def encode(self, some: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        lengths, ids = self.flat(pa.array(some, pa.string()))
        ends = np.cumsum(lengths)
        return [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def runs(some: pa.Array) -> Iterator[range]:
    """Ranges of texts of about AT_ONCE bytes at most, or of one text."""
    ends, at = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield range(at, to)
        at = to


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def write_codes(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode the documents, append ``end_id`` to each, and write files in ascending doc_id order.

    Returns the manifest: range, number, path, n_docs, n_tokens, start (tokens in all files before). Texts are
    dealt once by range of doc_id and encoded after. A null doc_id comes first, a null text is empty; documents
    with the same doc_id are ordered by text; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("range", F.spark_partition_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        doc_ids, lengths, ids, number, total, where = [], [], [], 0, 0, 0
        held: list[pa.RecordBatch] = []

        def flush():
            path = f"{folder}/ids-{where:06d}-{number:04d}-{uuid.uuid4().hex}.dac"
            own, n = np.concatenate(doc_ids), np.concatenate(lengths)
            sharedfs.write(path, pack(own, n, np.concatenate(ids)))
            return pa.RecordBatch.from_pydict({"range": pa.array([where], pa.int32()), "number": pa.array([number], pa.int32()), "path": [path], "n_docs": [len(own)], "n_tokens": [total]})

        def encode():
            t = pa.Table.from_batches(held)
            for part in runs(t.column(1).combine_chunks()):
                n, x = e.flat(t.column(1).slice(part.start, len(part)).combine_chunks())
                lengths.append(n + 1)
                ids.append(np.insert(x, np.cumsum(n), end_id))
                yield part
            doc_ids.append(t.column(0).to_numpy())

        for b in batches:
            if b.num_rows:
                where = b.column(2)[0].as_py()
                held.append(b.select([0, 1]))
            if sum(x.column(1).nbytes for x in held) >= AT_ONCE:
                for _ in encode():
                    total += int(lengths[-1].sum())
                held = []
                if total >= FILE_TOKENS:
                    yield flush()
                    doc_ids, lengths, ids, number, total = [], [], [], number + 1, 0
        if held:
            for _ in encode():
                total += int(lengths[-1].sum())
        if doc_ids:
            yield flush()

    written = d.mapInArrow(work, "range int, number int, path string, n_docs bigint, n_tokens bigint")
    written.write.parquet(f"{folder}/written")
    # sums before a file: inside its range, and over one row a range
    w = spark.read.parquet(f"{folder}/written")
    until = lambda by: F.coalesce(F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = w.groupBy("range").agg(F.sum("n_tokens").alias("n_tokens")).select("range", until(Window.orderBy("range")).alias("before"))
    m = w.withColumn("start", until(Window.partitionBy("range").orderBy("number"))).join(ranges, "range").withColumn("start", F.col("start") + F.col("before")).drop("before")
    m.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_codes(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document in the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with sharedfs.opened(path) as f:
                    x = Levels(f.read())
                for i in range(0, x.n_docs, 512):
                    some = range(i, min(i + 512, x.n_docs))
                    base = int(x.starts[i])
                    run = x.ids(base, int(x.starts[some[-1] + 1]))
                    a, e = x.starts[some.start : some.stop] - base, x.starts[some.start + 1 : some.stop + 1] - base
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if k == NO_ID else k for k in x.docs[some.start : some.stop].tolist()], pa.int64()),
                            "start": pa.array(x.starts[some.start : some.stop] + start, pa.int64()), "n_tokens": pa.array(e - a, pa.int64()),
                            "ids": pa.array([run[p:q].astype("<u4").tobytes() for p, q in zip(a.tolist(), e.tolist(), strict=True)], pa.binary()),
                        }
                    )

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def coded(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the documents' codes to the shared folder and read them back."""
    return read_codes(write_codes(docs, tokenizer_path, work_dir(spark, "codes")))
