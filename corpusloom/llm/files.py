"""Files in the folder that all executors share, by path or URI."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def fresh(shared: str, kind: str) -> str:
    """A new folder's URI below the shared one."""
    uri = posixpath.join(shared, f"{kind}-{uuid.uuid4().hex}")
    system, path = at(uri)
    system.create_dir(path, recursive=True)
    return uri


def attempt(folder: str, task: int, suffix: str) -> str:
    """A name that no other attempt of the task has; the manifest of what committed tasks return is what counts."""
    return posixpath.join(folder, f"part-{task:06d}-{uuid.uuid4().hex[:12]}.{suffix}")
