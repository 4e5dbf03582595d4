"""Files of our own in the shared folder, opened from Python workers by URI (file, hdfs, s3, gs, ...)."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str):
    """(file system, path in it) of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1) if uri.startswith("file:") else uri)


def write(uri: str, parts) -> int:
    """Write the byte strings; returns their length. Names are unique a task attempt, so nothing is replaced."""
    f, path = at(uri)
    f.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with f.open_output_stream(path) as out:
        for x in parts:
            out.write(x)
            n += len(memoryview(x).cast("B")) if not isinstance(x, bytes) else len(x)
    return n


def opened(uri: str):
    f, path = at(uri)
    return f.open_input_file(path)
