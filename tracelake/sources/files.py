"""Bytes of files, local or in any store that pyarrow can open.

Containers are read by range, so one epoch costs one small read however large the file is.
Containers in a store that only Spark can read go through Spark's ``binaryFile`` source instead
(:func:`tracelake.sources.container.read_binary`).
"""

from __future__ import annotations

import os
import re
from typing import BinaryIO


def plain_path(path: str) -> str:
    return re.sub(r"^file:(//)?(?=/)", "", path)


def open_file(path: str) -> BinaryIO:
    path = plain_path(path)
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path, "rb")


def exists(path: str) -> bool:
    path = plain_path(path)
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.get_file_info(inner).type != fs.FileType.NotFound
    return os.path.exists(path)


def sibling(path: str, extension: str) -> str:
    """The file beside ``path`` with another extension."""
    head, dot, tail = path.rpartition(".")
    return f"{head if dot and '/' not in tail else path}.{extension}"
