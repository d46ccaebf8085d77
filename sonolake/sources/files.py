"""Bytes of files by path, inside tasks: local paths and the URIs that pyarrow.fs opens (file, hdfs, s3, gs)."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import quote

from pyarrow import fs as pafs

from ..functions.constants import READ_BACKOFF, READ_DELAY, READ_TRIES, TEMPORARY


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a path as Spark names it: blanks and other signs are not escaped."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme == "file" else path
    authority, _, inner = rest.removeprefix("//").partition("/")
    files, root = pafs.FileSystem.from_uri(f"{scheme}://{quote(authority, safe='@:.')}/")
    return files, f"{root.rstrip('/')}/{inner}"


def read_bytes(path: str) -> bytes:
    files, inner = place(path)
    with files.open_input_file(inner) as f:
        return f.read()


def is_temporary(message: str) -> bool:
    return any(t in message.lower() for t in TEMPORARY)


def with_retries(path: str, decode: Callable[[bytes], tuple], tries: int = READ_TRIES, delay: float = READ_DELAY, read: Callable[[str], bytes] = read_bytes, wait: Callable[[float], None] = time.sleep) -> tuple[tuple, int]:
    """decode(bytes) and how often the file was read again. The last field of what decode gives is a message or None.

    A temporary message, and a read that fails, may come from the storage: the file is read again, later each time. If the same bytes
    come back, decoding them again would say the same, so that reading ends there.
    """
    last, out = None, None
    for n in range(tries):
        if n:
            wait(delay * READ_BACKOFF ** (n - 1))
        try:
            data = read(path)
        except FileNotFoundError:
            raise
        except OSError:
            if n == tries - 1 and out is None:
                raise
            continue
        if data == last:
            return out, n
        last, out = data, decode(data)
        if out[-1] is None or not is_temporary(out[-1]):
            return out, n
    return out, tries - 1
