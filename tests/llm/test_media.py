"""Archives of images: exact round trips, byte ranges, retries, damage."""

import random
import zlib

import numpy as np
import pytest

from loomgraph.llm import media, sharedfs
from loomgraph.llm.common import work_dir


def test_images_keep_every_byte():
    r = random.Random(1)
    for n in (0, 1, 63, 64, 65, 5000, 200000):
        data = r.randbytes(n)
        image = media.to_png(data)
        payload, size = media.from_png(image)
        assert size == n and payload == data + bytes(len(payload) - n) and len(payload) % 64 == 0 and len(payload) == max(64, -(-n // 64) * 64)
        assert image == media.to_png(data) and media.feature(payload) == media.feature(payload)
    bad = bytearray(media.to_png(b"abc"))
    bad[60] ^= 1
    with pytest.raises(Exception):
        media.from_png(bytes(bad))


def test_store_and_read(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcé😀 \n") for _ in range(r.randrange(0, 3000)))) for i in range(120)] + [(None, None), (7, ""), (7, ""), (8, "z" * 300000)]
    df = spark.createDataFrame([(a, b, "m") for a, b in rows], "doc_id long, text string, media string")
    folder = work_dir(spark, "media")
    media.write_media(df, folder)
    got = media.decode_media(media.read_media(spark, folder)).collect()
    assert sorted((str(x.doc_id), bytes(x.payload)) for x in got) == sorted((str(d), media.padded((t or "").encode())) for d, t in rows)
    d = media.digests(media.decode_media(media.read_media(spark, folder))).where("doc_id = 8").first()
    assert d.n_bytes == 300000 and d.tail_crc32 == zlib.crc32(media.padded(b"z" * 300000)[-64:]) and d.payload_bytes == 300032
    empty = work_dir(spark, "media")
    media.write_media(df.limit(0), empty)
    assert media.read_media(spark, empty).count() == 0


def archive(tmp_path, images):
    import pyarrow as pa

    w = media.Writer(f"file://{tmp_path}/a")
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(images)), pa.int64()), "media": pa.array(images, pa.binary())})
    w.commit([w.write(iter([batch]))])
    return media.Reader(f"file://{tmp_path}/a")


def test_ranges_cover_each_member_once(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE_BYTES", 100)
    images = [bytes([i]) * (i * 7 % 90) for i in range(60)] + [b""]
    reader = archive(tmp_path, images)
    parts = reader.partitions()
    assert len(parts) > 10
    seen = [(i, bytes(x)) for p in parts for b in reader.read(p) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(seen) == list(enumerate(images))


def test_a_member_is_read_again_by_its_offset(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "WAIT_S", 0.0)
    reader = archive(tmp_path, [b"one", b"two", b"three"])
    opened, fails = sharedfs.opened, [0]

    class Flaky:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            fails[0] += 1
            return b"?" * n if fails[0] in (5, 6) else self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    monkeypatch.setattr(sharedfs, "opened", lambda u: Flaky(opened(u)))
    got = [bytes(x) for b in reader.read(reader.partitions()[0]) for x in b.column(1).to_pylist()]
    assert got == [b"one", b"two", b"three"] and fails[0] > 7
    monkeypatch.setattr(sharedfs, "opened", opened)
    path = next((tmp_path / "a").glob("*.arc"))
    data = bytearray(path.read_bytes())
    data[4] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(OSError, match="damaged"):
        list(reader.read(reader.partitions()[0]))
    assert np.dtype(media.ENTRY).itemsize == 32
