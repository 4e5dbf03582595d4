"""BPE encoding and decoding with content-defined chunk reuse.

A document's bytes are cut where a rolling hash of the last 32 bytes has its low bits zero, so a passage that
documents share is cut alike in all of them. A chunk met before in a worker is not encoded again. Of a new
chunk the words between its first and last white space are encoded, each distinct word once a worker. The
word across a chunk join is repaired: a window of the join and its neighbouring words is encoded anew and
accepted if it agrees exactly with what both chunks have for their outer words; else the window grows to the
whole document in one step. Caches are bounded, so a worker's memory does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import give_back, small_batches, texts, use_worker

#: A cut where the low MASK_BITS of the rolling hash are zero, at least LEAST bytes after the last cut.
MASK_BITS, LEAST, WINDOW = 11, 256, 32
#: Words and chunks that a worker keeps in each of two generations.
WORDS_KEPT, CHUNKS_KEPT = 250_000, 12_000
WORD = re.compile(r"[^ \n\t\r]+")
SPACES = " \n\t\r"
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


class Generations:
    """A bounded cache: when the young half is full it becomes the old one; what is used is kept."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class Words:
    """Memo of a tokenizer by word: ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Generations(WORDS_KEPT)

    def encode(self, some: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, lists: Iterable[list[str]]) -> None:
        """Afterwards ``self.memo.young`` has every word of the lists."""
        self.memo.turn()
        young, old = self.memo.young, self.memo.old
        new = []
        for w in {w for x in lists for w in x if w not in young}:
            if (found := old.get(w)) is not None:
                young[w] = found
            else:
                new.append(w)
        for i in range(0, len(new), 20_000):
            young.update(zip(new[i : i + 20_000], self.encode(new[i : i + 20_000]), strict=True))


def cuts(data: bytes) -> list[int]:
    """End positions of the chunks of ``data``, never inside a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    step = 1
    while step < WINDOW:  # afterwards h[i] = sum of gear[b[i - j]] << j over j < WINDOW
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    # the high bits hold the whole window; the low ones only the last bytes
    places = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    found, last = [], 0
    for p in places.tolist():
        while p < n and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= LEAST and p < n:
            found.append(p)
            last = p
    return [*found, n]


class ChunkEncoder:
    """Encodes lists of texts with chunk reuse, for tokenizers that never join characters across ASCII white space."""

    def __init__(self, path: str):
        self.words = Words(path)
        self.chunks = Generations(CHUNKS_KEPT)
        self.made = self.reused = self.repairs = self.grown = 0

    def _chunk(self, c: str, key: bytes) -> tuple:
        """(head, core words' ids, tail, first core word, last core word); core is None without white space."""
        i = next((i for i, x in enumerate(c) if x in SPACES), -1)
        if i < 0:
            return (c, None, "", "", "")
        j = max(c.rfind(x) for x in SPACES)
        words = WORD.findall(c, i, j)
        memo = self.words.memo.young
        return (c[:i], b"".join(map(memo.__getitem__, words)), c[j + 1 :], words[0] if words else "", words[-1] if words else "")

    def encode(self, some: list[str]) -> list[bytes]:
        plans, new, waiting = [], {}, []
        for t in some:
            data, last, plan = t.encode("utf-8", "surrogatepass"), 0, []
            for p in cuts(data):
                part = data[last:p]
                key = hashlib.blake2b(part, digest_size=16).digest()
                if self.chunks.get(key) is None and key not in new:
                    new[key] = part.decode("utf-8", "surrogatepass")
                else:
                    self.reused += 1
                plan.append(key)
                last = p
            plans.append(plan)
        self.made += len(new)
        self.words.learn(WORD.findall(c) for c in new.values())
        have = {k: self._chunk(c, k) for k, c in new.items()}
        for plan in plans:
            for k in plan:
                if k not in have:
                    have[k] = self.chunks.get(k)
        # the parts of each document: ids, or a window to be encoded
        out: list[list] = []
        for plan in plans:
            parts: list = []
            carry, left = "", ""
            for k in plan:
                head, core, tail, first, last = have[k]
                carry += head
                if core is None:
                    continue
                if carry:
                    waiting.append((parts, len(parts), left, carry, first))
                    parts.append(None)
                parts.append(core)
                carry, left = tail, last
            if carry:
                waiting.append((parts, len(parts), left, carry, ""))
                parts.append(None)
            out.append(parts)
        agreed = self._repair(waiting)
        done = [b"".join(p) if all(x is not None for x in p) else b"" for p in out]
        if not agreed:  # a join where no window agreed: its whole document is encoded
            again = [i for i, p in enumerate(out) if any(x is None for x in p)]
            for i, ids in zip(again, self.words.encode([some[i] for i in again]), strict=True):
                done[i] = ids
            self.grown += len(again)
        self.chunks.turn()
        self.chunks.young.update((k, v) for k, v in have.items() if k in new)
        return done

    def _repair(self, waiting: list[tuple]) -> bool:
        """Fill the joins; a window is the neighbours' outer words around the join's text."""
        self.repairs += len(waiting)
        memo = self.words.memo
        self.words.learn([[w for _, _, a, _, b in waiting for w in (a, b) if w]])
        ids = self.words.encode([" ".join(x for x in (a, join, b) if x) for _, _, a, join, b in waiting])
        agreed = True
        for (parts, at, a, _, b), x in zip(waiting, ids, strict=True):
            before, after = memo.young.get(a, b""), memo.young.get(b, b"")
            if len(x) >= len(before) + len(after) and x.startswith(before) and x.endswith(after):
                parts[at] = x[len(before) : len(x) - len(after)]
            else:
                agreed = False
        return agreed


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def vocabulary(tokenizer) -> list[str]:
    size = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
    return [tokenizer.id_to_token(i) or "" for i in range(size)]


def slices(some: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters at most, or one text."""
    held, n = [], 0
    for t in some:
        if held and n + len(t) > most:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ids, binary: the token ids of ``text`` as little-endian unsigned 32-bit integers.

    They are what the tokenizers library gives for the whole text without added special tokens. A null or
    empty text has no ids. Repeated rows are kept; ``keep`` may have nulls; other columns are ignored. No rows
    give no rows.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker(_ENCODERS, _VOCABULARIES)
        e = encoder(tokenizer_path)
        for b in batches:
            some = texts(b.column(b.num_columns - 1))
            ids = [x for part in slices(some) for x in e.encode(part)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], names=[*keep, "ids"])
        give_back()

    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text"))
    types = dict(d.dtypes)
    return d.mapInArrow(work, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids binary"]))


_VOCABULARIES: dict[str, list[str]] = {}


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of ``encoded`` with decoded: what the library's decode(ids, skip_special_tokens=False) gives.

    For a tokenizer file without a decoder that is its tokens joined by blanks; else the library decodes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker(_ENCODERS, _VOCABULARIES)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = encoder(tokenizer_path).words.tokenizer
        if tok.decoder is None and tokenizer_path not in _VOCABULARIES:
            _VOCABULARIES[tokenizer_path] = vocabulary(tok)
        names = _VOCABULARIES.get(tokenizer_path)
        for b in batches:
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            said = [" ".join([names[i] for i in x]) for x in ids] if tok.decoder is None else tok.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, "decoded"])

    types = encoded.dtypes
    return encoded.mapInArrow(work, ", ".join([*(f"`{c}` {t}" for c, t in types), "decoded string"]))


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
