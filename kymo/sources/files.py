"""Files that Python code reads and writes by itself, in any store that pyarrow knows by its address (local, HDFS, S3, GCS)."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """(store, path in it, what an address in it begins with)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file://"
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(address, bytes) of the file ``path``, or of all files with a suffix in the folder and those below it; in order."""
    store, inner, begin = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(begin + info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((begin + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


def exists(path: str) -> bool:
    store, inner, _ = store_of(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    store, inner, _ = store_of(path)
    return store.open_input_file(inner)


def created(path: str) -> pa.NativeFile:
    """A new file for writing from start to end, and the folders above it."""
    store, inner, _ = store_of(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


def removed(path: str) -> None:
    """Delete a file; silent where there is none."""
    store, inner, _ = store_of(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        store.delete_file(inner)


def put_json(path: str, value: object) -> None:
    """Write a small file at once: readers see all of it or none."""
    half = f"{path}.{uuid.uuid4().hex}.tmp"
    with created(half) as f:
        f.write(json.dumps(value).encode())
    store, inner, _ = store_of(path)
    store.move(store_of(half)[1], inner)


def get_json(path: str) -> object:
    with opened(path) as f:
        return json.loads(f.read().decode())
