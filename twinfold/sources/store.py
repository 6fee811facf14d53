"""Files by path or by URI, on the executors: listed, read in ranges, written, moved and deleted where they are.

A path without a scheme is of the mounted file system. One with a scheme (``s3:``, ``gs:``, ``hdfs:``, ``file:`` ...) goes through the
Arrow file system of that scheme, which reads ranges, so nothing needs to be mounted and no file is held whole.
"""

from __future__ import annotations

import os
import re
from datetime import datetime, timezone
from functools import lru_cache
from typing import NamedTuple

from pyarrow import fs

URI = re.compile(r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]+):(?P<authority>//[^/]*)?(?P<rest>/.*)?$", re.S)


class Entry(NamedTuple):
    path: str
    name: str
    folder: bool
    length: int | None
    changed: datetime | None


@lru_cache(maxsize=64)
def _system(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    """An Arrow file system, and what stands before a path in it."""
    if scheme == "file":
        return fs.LocalFileSystem(), ""
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, base.rstrip("/")


def located(path: str) -> tuple[fs.FileSystem, str, str, str]:
    """The file system of a path, the path in it, and what to put before a path of it instead of what else to make it whole again."""
    found = URI.match(path)
    if not found:
        return fs.LocalFileSystem(), path, "", ""
    system, base = _system(found["scheme"].lower(), (found["authority"] or "//")[2:])
    rest = "/" + (found["rest"] or "").lstrip("/")
    return system, base + rest, path[: len(path) - len(found["rest"] or "")], base


def absolute(path: str) -> str:
    return path if URI.match(path) else os.path.abspath(path)


def reason(x: OSError) -> str:
    """What went wrong, in the same words whichever file system says it."""
    return os.strerror(x.errno) if x.errno else str(x)


def entries(folder: str) -> list[Entry]:
    """Files and folders right below a folder, by name; links are neither. Raises OSError."""
    if not URI.match(folder):
        out = []
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    out.append(Entry(e.path, e.name, True, None, None))
                elif e.is_file(follow_symlinks=False):
                    try:
                        s = e.stat(follow_symlinks=False)
                    except FileNotFoundError:  # gone meanwhile
                        continue
                    out.append(Entry(e.path, e.name, False, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)))
        return sorted(out, key=lambda e: e.name)
    system, inner, before, base = located(folder)
    kinds = (fs.FileType.File, fs.FileType.Directory)
    found = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type in kinds]
    if isinstance(system, fs.LocalFileSystem):
        found = [i for i in found if not os.path.islink(i.path)]
    return sorted((Entry(before + i.path.removeprefix(base), i.base_name, i.type == fs.FileType.Directory, i.size, i.mtime) for i in found), key=lambda e: e.name)


def opened(path: str):
    """A file to be read from any place on: ``read(n)`` and ``seek(at, whence)``; a context that closes it."""
    if not URI.match(path):
        return open(path, "rb")
    system, inner, _, _ = located(path)
    return system.open_input_file(inner)


def kind(path: str) -> str:
    """``file``, ``folder`` or ``none``."""
    system, inner, _, _ = located(path)
    found = system.get_file_info(inner).type
    return {fs.FileType.NotFound: "none", fs.FileType.Directory: "folder"}.get(found, "file")


def put(path: str, data: bytes) -> None:
    """Writes a file, and the folders that it is in where there are such things."""
    system, inner, _, _ = located(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(data)


def moved(source: str, to: str) -> None:
    """Moves a file within its file system; raises where something is there already or it is another file system."""
    a, b = URI.match(source), URI.match(to)
    if bool(a) != bool(b) or (a and (a["scheme"], a["authority"]) != (b["scheme"], b["authority"])):
        raise OSError(f"{to} is in another file system")
    if kind(to) != "none":
        raise FileExistsError(17, "File exists", to)
    system, inner, _, _ = located(source)
    target = located(to)[1]
    system.create_dir(os.path.dirname(target), recursive=True)
    system.move(inner, target)


def deleted(path: str) -> None:
    system, inner, _, _ = located(path)
    system.delete_file(inner)
