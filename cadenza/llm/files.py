"""Small binary files of named arrays in the shared folder, written whole and mapped into memory."""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), os.path.abspath(uri))


def put(folder: str, name: str, content: bytes) -> str:
    """Write under another name, then rename: a file is whole or not there, and a task that runs again replaces it."""
    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


def get(folder: str, name: str) -> bytes:
    store, path = _at(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read()


def arrays(parts: dict[str, np.ndarray], meta: dict) -> bytes:
    """A header in JSON, then each array at a multiple of 8 bytes, and 8 spare bytes at the end."""
    body, table, at = [], {}, 0
    for name, x in parts.items():
        raw = np.ascontiguousarray(x).tobytes()
        table[name] = (at, len(x), x.dtype.str)
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    head = json.dumps({"meta": meta, "arrays": table}).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *body, b"\0" * 8])


class Mapped:
    """The arrays of a file, on a local or shared path mapped into memory, else read."""

    def __init__(self, uri: str):
        store, path = _at(uri)
        if isinstance(store, fs.LocalFileSystem):
            with open(path, "rb") as f:
                self.buffer = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        else:
            with store.open_input_file(path) as f:
                self.buffer = memoryview(pa.py_buffer(f.read()))
        n = int.from_bytes(self.buffer[:8], "little")
        spec = json.loads(bytes(self.buffer[8 : 8 + n]))
        self.meta = spec["meta"]
        for name, (at, size, kind) in spec["arrays"].items():
            setattr(self, name, np.frombuffer(self.buffer, kind, size, 8 + n + at))
        self.places = {name: 8 + n + at for name, (at, _, _) in spec["arrays"].items()}


_open: OrderedDict[str, Mapped] = OrderedDict()
#: Files a process keeps mapped; mapping one again costs little.
OPEN = 4096


def mapped(uri: str) -> Mapped:
    if uri in _open:
        _open.move_to_end(uri)
    else:
        _open[uri] = Mapped(uri)
        while len(_open) > OPEN:
            _open.popitem(last=False)
    return _open[uri]
