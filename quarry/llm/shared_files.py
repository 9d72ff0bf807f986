"""Arrays in the shared folder that workers map into memory.

Where the folder is on a file system that all machines mount, the arrays are mapped in place. In any other store, pyarrow's file
systems read and write them, and a worker maps a copy that it has fetched and already unlinked.
"""
from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

import numpy as np

from quarry.llm._common import worker_cache


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return re.sub(r"^file:/*", "/", uri)
    return uri if "://" not in uri else None


def make_folder(uri: str) -> None:
    if (path := local_path(uri)) is not None:
        os.makedirs(path, exist_ok=True)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(at, recursive=True)


def write_array(uri: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a task that runs twice does no harm."""
    if (path := local_path(uri)) is not None:
        own = f"{path}.{uuid.uuid4().hex}.part"
        with open(own, "wb") as f:
            array.tofile(f)
        os.replace(own, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(at) as f:
        f.write(array.tobytes())


def mapped(uri: str, dtype) -> np.ndarray:
    """The array, mapped once in a worker."""
    cache = worker_cache()
    if ("map", uri) not in cache:
        if (path := local_path(uri)) is None:
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(uri)
            copy = tempfile.NamedTemporaryFile()
            with store.open_input_stream(at) as f:
                while piece := f.read(1 << 22):
                    copy.write(piece)
            copy.flush()
            path = copy.name
        size = os.path.getsize(path)
        cache["map", uri] = np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype)
    return cache["map", uri]


def write_arrays(uri: str, *arrays: np.ndarray) -> None:
    """Several arrays in one file: a head of 16 bytes an array (type, length), then each one's bytes, padded to eight."""
    head, body = [np.array([len(arrays)], "<u8").tobytes()], []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        head.append(a.dtype.str.encode().ljust(8) + np.array([a.size], "<u8").tobytes())
        body.append(raw + bytes(-len(raw) % 8))
    write_array(uri, np.frombuffer(b"".join(head + body), np.uint8))


def mapped_arrays(uri: str) -> list[np.ndarray]:
    """The arrays of such a file, as views of the mapped file."""
    cache = worker_cache()
    if ("arrays", uri) not in cache:
        raw = mapped(uri, np.uint8)
        n, out = int(raw[:8].view("<u8")[0]), []
        at = 8 + 16 * n
        for k in range(n):
            entry = raw[8 + 16 * k : 24 + 16 * k]
            dtype, size = np.dtype(bytes(entry[:8]).decode().strip()), int(entry[8:].view("<u8")[0])
            out.append(raw[at : at + size * dtype.itemsize].view(dtype))
            at += -(-size * dtype.itemsize // 8) * 8
        cache["arrays", uri] = out
    return cache["arrays", uri]


@contextlib.contextmanager
def written(uri: str):
    """A file to write in pieces; it has its name when it is whole."""
    if (path := local_path(uri)) is not None:
        own = f"{path}.{uuid.uuid4().hex}.part"
        with open(own, "wb") as f:
            yield f
        os.replace(own, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(at) as f:
        yield f
