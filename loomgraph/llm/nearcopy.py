"""Near-copy detection with BagMinHash signatures over multisets of five-word shingles.

Every distinct shingle of a text with its count is a weighted element. Its weight range is discretised to whole
numbers and cut at powers of two, (0,1], (1,2], (2,4], ...; each piece has a Poisson process of points, seeded
by element and piece alone, with the piece's length as rate. A point has a time, a register and a cell of the
piece; it counts if the weight reaches its cell. A register keeps the earliest counting point, so two texts
agree in a register with the probability of their weighted Jaccard index. Elements stop as soon as their next
point is later than all registers, so most give one or two points.

Bands of registers give candidate buckets. Equal texts are one node from the start. Then, without emitting all
pairs of a bucket:

1. Each bucket's most central node (largest sum of bucket sizes) is compared with its other nodes, which joins
   the bulk of a large group of copies into one component.
2. In buckets that still hold several components, signatures of different components are compared block against
   block; only pairs that could reach the threshold, within four standard deviations, are emitted.

All pairs are verified on exact multisets. Classes are the connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import slices
from loomgraph.llm.common import cut, discard, give_back, join_counted, small_batches, texts, use_worker

SHINGLE, REGISTERS, BANDS, ROWS = 5, 512, 24, 4
BLOCK = 384
#: Pairs whose signatures are compared at once.
PAIRS = 8192
#: Points that are drawn at once.
AT_ONCE = 16_384
#: Bytes of bags that one task of the exact check reads of one node's partners.
SLOT = 8 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than ASCII white space) of all texts, and words by text."""
    data = [t.encode("utf-8", "surrogatepass") for t in some]
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ink = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ink]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    docs_end = np.cumsum([len(x) + 1 for x in data])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], docs_end])))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), _POWER | _U(1)))
        return mix(np.add.reduceat((buf[ink].astype(np.uint64) + _U(1)) * powers[place], first) + lengths.astype(np.uint64)), counts


def shingles(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of 48 bits, with repeats, of all texts, and shingles by text. A text of fewer words has one."""
    words, counts = word_hashes(some)
    first = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    end = np.repeat(first + counts, n)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            w = words[np.minimum(at + k, len(words) - 1)] if len(words) else h
            h = mix(h * _U(31) + np.where(at + k < end, w, _U(k + 1)))
    return h >> _U(16), n


def weighted(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their text and count."""
    h, n = shingles(some)
    key = np.sort(np.repeat(np.arange(len(some), dtype=np.uint64) << _U(48), n) | h)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[new] >> _U(48)).astype(np.int64), key[new] & _U(2**48 - 1), np.diff(np.append(new, len(key)))


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Registers (n_docs x REGISTERS, uint64 bit patterns of times); elements have a text, a 48-bit hash and a count."""
    registers = np.full(n_docs * REGISTERS, np.inf).view(np.uint64)
    # pieces of each weight: piece 0 is (0,1], piece l is (2^(l-1), 2^l]
    n_pieces = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    who = np.repeat(np.arange(len(doc)), n_pieces)
    piece = np.arange(len(who)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    doc, weight = doc[who], weight[who]
    low = np.where(piece > 0, 1 << np.maximum(piece - 1, 0), 0)
    length = np.where(piece > 0, low, 1)
    with np.errstate(over="ignore"):
        state = mix(element[who] * _U(64) + piece.astype(np.uint64) + _U(1))
        time = np.zeros(len(who))
        while len(doc):
            # several points of each element at once where few are left; points after all registers change nothing
            some = int(np.clip(AT_ONCE // len(doc), 1, 256))
            steps = state + np.arange(1, some + 1, dtype=np.uint64)[:, None] * _POWER
            a = mix(steps)
            b = mix(a ^ _U(0x5851F42D4C957F2D))
            gaps = -np.log1p(-(a >> _U(11)).astype(np.float64) * 2.0**-53) / length
            gaps[0] += time
            times = np.cumsum(gaps, axis=0)
            cell = low + ((b >> _U(32)).astype(np.float64) * 2.0**-32 * length).astype(np.int64) + 1
            counts = cell <= weight
            at = doc * REGISTERS + (b & _U(REGISTERS - 1)).astype(np.int64)
            np.minimum.at(registers, at[counts], times.view(np.uint64)[counts])
            state, time = steps[-1], times[-1]
            new = np.concatenate([[True], doc[1:] != doc[:-1]])  # elements are in the order of their texts
            latest = registers.reshape(-1, REGISTERS)[doc[new]].max(axis=1).view(np.float64)
            on = time < latest[np.cumsum(new) - 1]
            doc, weight, low, length, state, time = doc[on], weight[on], low[on], length[on], state[on], time[on]
    return registers.reshape(-1, REGISTERS)


def signatures(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(registers, whether a text has words)."""
    doc, element, weight = weighted(some)
    r = bag_min_hash(doc, element, weight, len(some))
    return r, np.bincount(doc, minlength=len(some)) > 0


def band_keys(registers: np.ndarray) -> np.ndarray:
    """BANDS keys by text."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), 1))
        for k in range(ROWS):
            key = mix(key * _U(31) + registers[:, k : BANDS * ROWS : ROWS])
    return key.view(np.int64)


def _nodes(docs: DataFrame) -> DataFrame:
    """One row of each distinct text: nid, node (its 128-bit digest), doc_id (the least), copies, bands, sig.

    ``sig`` has 8 bits of each register. Two registers that differ have equal bits once in 256, so a comparison
    may overrate a pair by two registers or so, and never underrates one. ``nid`` holds once the table is written.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker()
        for b in batches:
            said, done = texts(b.column(2)), 0
            for part in slices(said, 2_000_000):
                registers, has = signatures(part)
                keys, short = band_keys(registers), (registers >> _U(20)).astype(np.uint8)
                lists = pa.array([k.tolist() if ok else [] for k, ok in zip(keys, has.tolist(), strict=True)], pa.list_(pa.int64()))
                sig = pa.array([s.tobytes() for s in short], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(part)), b.column(1).slice(done, len(part)), lists, sig], names=["node", "doc_id", "bands", "sig"])
                done += len(part)
        give_back()

    signed = docs.select("node", "doc_id", "text").mapInArrow(work, "node binary, doc_id bigint, bands array<bigint>, sig binary")
    by = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    return by.select(F.monotonically_increasing_id().alias("nid"), "*")


def _agree(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Registers in which two columns of signatures agree."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (a, b))
    return (x == y).sum(axis=1)


def _least(similarity: float) -> int:
    """Registers that a pair of this similarity agrees in, less four standard deviations."""
    return int(REGISTERS * similarity - 4 * (REGISTERS * similarity * (1 - similarity)) ** 0.5)


def _likely(pairs: DataFrame, sig: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose signatures (nid, sig) agree enough."""
    least = _least(similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker()
        for b in batches:
            yield b.filter(pa.array(_agree(b.column(2), b.column(3)) >= least)).select([0, 1])

    p = pairs.join(sig.withColumnsRenamed({"nid": "b", "sig": "sig_b"}), "b").join(sig.withColumnsRenamed({"nid": "a", "sig": "sig_a"}), "a")
    return p.select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a bigint, b bigint")


def _blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs of different components in each bucket; rows: key, nid, root, bands, sig.

    In each bucket the largest component is told from the odd rest. Nodes of one component are never sent for
    each other: those of the largest go to the blocks of odd nodes, those to all blocks of the bucket. So a few
    odd nodes in a bucket of a million copies cost a million comparisons each, and a block's task holds about
    2 * BLOCK nodes. A pair that shares several bands is told by the first of them.
    """
    least = _least(similarity)
    by = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    by = by.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    by = by.select("key", F.col("top.root").alias("top"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("n_top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("n_odd"))
    r = rows.join(by, "key").withColumn("odd", F.col("root") != F.col("top"))
    r = r.withColumn("own", F.pmod(F.xxhash64("nid"), F.when(F.col("odd"), F.col("n_odd")).otherwise(F.col("n_top"))).cast("int"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = F.col("own")
    for_odd = F.concat(F.transform(span("n_top"), lambda i: task(0, i, own)), F.transform(span("n_odd"), lambda j: task(1, F.least(own, j), F.greatest(own, j))))
    at = F.explode(F.when(F.col("odd"), for_odd).otherwise(F.transform(span("n_odd"), lambda j: task(0, own, j))))
    r = r.withColumn("at", at).select("key", "at.kind", "at.i", "at.j", "odd", "own", "nid", "root", "bands", "sig")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = ["key", "kind", "i", "j"]

    def told(t: pa.Table) -> pa.RecordBatch:
        """The pairs of whole groups."""
        key, kind, i, j, odd, own, node, root = (t.column(c).to_numpy() for c in t.column_names[:8])
        keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        here = (keys == key[:, None]).argmax(axis=1)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        found: list[np.ndarray] = []

        def compare(p: np.ndarray, q: np.ndarray) -> None:
            on = root[p] != root[q]
            p, q = p[on], q[on]
            on = (keys[p] == keys[q]).argmax(axis=1) == here[p]  # the first band in which they meet
            p, q = p[on], q[on]
            on = (sig[p] == sig[q]).sum(axis=1) >= least
            found.append(np.stack([np.minimum(node[p[on]], node[q[on]]), np.maximum(node[p[on]], node[q[on]])]))

        held, n_held = [], 0
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            x = np.arange(lo, hi)
            inside = kind[lo] == 1 and i[lo] == j[lo]
            side = odd[lo:hi] if kind[lo] == 0 else own[lo:hi] == j[lo]
            a, b = (x, x) if inside else (x[~side], x[side])
            step = max(1, PAIRS // max(1, len(b)))
            for at in range(0, len(a), step):
                p, q = np.repeat(a[at : at + step], len(b)), np.tile(b, len(a[at : at + step]))
                held.append((p[p < q], q[p < q]) if inside else (p, q))
                n_held += len(p)
                if n_held > PAIRS:
                    compare(*map(np.concatenate, zip(*held, strict=True)))
                    held, n_held = [], 0
        if held:
            compare(*map(np.concatenate, zip(*held, strict=True)))
        ab = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker()
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ends = [b.column(c)[b.num_rows - 1].as_py() for c in range(4)]
            if held and ends == last and all(b.column(c)[0].as_py() == x for c, x in enumerate(last)):
                held.append(b)  # still the same group
                continue
            same = np.logical_and.reduce([b.column(c).to_numpy() == x for c, x in enumerate(ends)])
            cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            whole = [*held, b.slice(0, cut_at)]
            if sum(x.num_rows for x in whole):
                yield told(pa.Table.from_batches(whole))
            held, last = [b.slice(cut_at)], ends
        if held:
            yield told(pa.Table.from_batches(held))

    return r.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(work, "a bigint, b bigint")


def _bags(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nid, size (bytes), bag: the sorted shingle hashes, repeats kept, 6 bytes each, of the nodes' texts.

    ``docs`` and ``nodes`` meet on digest and hashed doc_id, so many copies of a text are dealt apart.
    """
    h = F.xxhash64("doc_id").alias("h")
    t = docs.select("node", h, "text").join(nodes.select("node", h, "nid"), ["node", "h"]).dropDuplicates(["node", "h"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker()
        for b in batches:
            said, bags = texts(b.column(1)), []
            for part in slices(said, 2_000_000):
                x, n = shingles(part)
                for own in np.split(x, np.cumsum(n)[:-1]):
                    bags.append(np.sort(own).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in bags], pa.int64()), pa.array(bags, pa.binary())], names=["nid", "size", "bag"])
        give_back()

    return t.select("nid", "text").mapInArrow(work, "nid bigint, size bigint, bag binary")


def unpacked(bag: bytes) -> np.ndarray:
    """The hashes of a bag."""
    x = np.zeros((len(bag) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(bag, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel().astype(_U)


def numbered(bag: np.ndarray) -> np.ndarray:
    """Distinct hashes of a sorted bag's elements with the ordinal of each repeat, so that k-th copies match each other."""
    at = np.arange(len(bag))
    k = at - np.maximum.accumulate(np.where(np.concatenate([[True], bag[1:] != bag[:-1]]), at, 0)) if len(bag) else at
    with np.errstate(over="ignore"):
        return np.sort(mix(mix(bag) + k.astype(np.uint64)))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two multisets, each a sorted array; 1 if both are empty."""
    return _overlap(numbered(a), numbered(b))


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verify(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact multisets are as similar.

    Pairs of one ``a`` are dealt to slots by the bytes of their bags, SLOT in each. The bag of ``a`` goes to
    each of its slots once, sorted before the others, so a task holds one such bag and a batch of others.
    """
    sizes = bags.select(F.col("nid").alias("b"), "size")
    narrow = cut(pairs.join(sizes, "b"), "narrow")
    per = narrow.groupBy("a").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    per = cut(per.select("a", "n", F.ceil((F.col("bytes") + 1) / SLOT).cast("int").alias("slots")), "per")
    dealt = join_counted(narrow.drop("size"), per, "a", "n", _total(per, "n"))
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), "b")
    own = per.join(bags.withColumnRenamed("nid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("bigint").alias("b"), "bag")
    rest = dealt.join(bags.select(F.col("nid").alias("b"), "bag"), "b").select("a", "slot", "b", "bag")
    n = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = own.unionByName(rest).repartition(n, "a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker()
        held = np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for other, bag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = numbered(unpacked(bag))
                if other is None:
                    held = x
                good.append(other is not None and _overlap(held, x) >= similarity)
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    good = cut(every.select("a", "b", "bag").mapInArrow(work, "a bigint, b bigint"), "links")
    discard(narrow, per)
    return good


def _total(counted: DataFrame, column: str) -> int:
    return counted.agg(F.sum(column)).head()[0] or 0


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """node, root (the least node) for every node of the links (a, b), by alternating large and small stars.

    Nodes with many links get their star's least node by broadcast (see ``join_counted``), so no task has a hub.
    """
    e = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    n = e.count()
    star = lambda x: x.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_counted(both, star(both), "u", "d", 2 * n).select("u", "v", F.least("u", "m").alias("m"))
        large = cut(large.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        least = star(large)
        small = join_counted(large, least, "u", "d", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, n = n, new.count()
        same = n == before and new.exceptAll(e).isEmpty()
        discard(e, large)
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _classified(docs: DataFrame, similarity: float) -> DataFrame:
    """nid, node, doc_id (its least), copies, root of every distinct text of docs (doc_id, text, node)."""
    nodes = cut(_nodes(docs), "nodes")
    keys = nodes.select(F.explode("bands").alias("key"), "nid")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = cut(keys.join(sizes, "key"), "member")
    score = member.groupBy("nid").agg(F.sum("n").alias("score"))
    shared = cut(score.join(nodes.select("nid", "node", "doc_id", "bands", "sig"), "nid"), "shared")
    bags = cut(_bags(docs, shared), "bags")
    hubs = member.join(shared.select("nid", "score"), "nid").groupBy("key").agg(F.max(F.struct("score", "nid"))["nid"].alias("hub"))
    pairs = member.join(hubs, "key").where("nid <> hub").select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct()
    sig = shared.select("nid", "sig")
    likely = cut(_likely(pairs, sig, similarity), "likely")
    links = _verify(likely, bags, similarity)
    discard(likely)
    found = cut(components(links).withColumnRenamed("node", "nid"), "found")
    rows = member.join(found, "nid", "left").select("key", "nid", F.coalesce("root", "nid").alias("root"))
    open_keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rows = cut(rows.join(open_keys, "key"), "open")
    more = cut(_blocks(rows.join(shared.select("nid", "bands", "sig"), "nid"), similarity), "more")
    discard(member, rows)
    new = _verify(more, bags, similarity)
    discard(shared, bags, more)
    if not new.isEmpty():
        found, old = cut(components(links.unionByName(new)).withColumnRenamed("node", "nid"), "found"), found
        discard(old)
    c = cut(nodes.select("nid", "node", "doc_id", "copies").join(found, "nid", "left").withColumn("root", F.coalesce("root", "nid")), "classes")
    discard(nodes, links, new, found)
    return c


def _with_node(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))


def near_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size, n_texts for every row of ``docs`` (doc_id, text).

    ``class_id`` is the least doc_id of the class; ``n_texts`` counts its different texts. Two texts are linked
    if the Jaccard index of their multisets of five-word shingles is at least ``similarity``; classes are what
    links and equal texts connect. Null and empty texts are equal texts; texts without words have no other
    links. Repeated rows are kept; a null doc_id is kept and never a class_id unless the class has no other.
    Other columns are ignored. An empty table gives none.
    """
    d = _with_node(docs)
    c = _classified(d, similarity)
    by = c.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n_texts"))
    classes = cut(join_counted(c.select("node", "root", "copies"), by, "root", "n_texts", c.count()).select("node", "copies", "class_id", "class_size", "n_texts"), "by_text")
    rows = cut(d.select("doc_id", "node"), "rows")
    found = join_counted(rows, classes, "node", "copies", _total(c, "copies"))
    return found.select("doc_id", "class_id", "class_size", "n_texts")


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each class of ``docs``: that of the least doc_id (null last), then of the least text digest.

    All columns are kept. Which rows stay is decided on narrow rows; then the texts are dealt once.
    """
    c = _classified(_with_node(docs), similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"))).alias("first")
    kept = c.groupBy("root").agg(first).select("first.kept_id", "first.kept_node")
    at = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    at = at.withColumn("id", F.xxhash64(F.col("row.doc_id").cast("bigint"))).withColumn("node", F.unhex(F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))))
    kept = kept.select(F.xxhash64("kept_id").alias("id"), F.col("kept_node").alias("node"))
    at = at.join(kept, ["node", "id"], "left_semi").dropDuplicates(["node", "id"])
    return at.select(*[F.col("row").getField(x).alias(x) for x in docs.columns])
