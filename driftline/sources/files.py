"""File access inside tasks, through the Arrow filesystems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import stat
import time
from collections.abc import Iterator

import pyarrow.fs as pafs

CHUNK = 1 << 20
RETRIES = 3
FIRST_WAIT_SECONDS = 2.0


class ReadFailure(OSError):
    """The source could not be read; the one failure of a copy that may be ignored."""


def open_root(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and plain path of a URI; Hadoop's one-slash ``file:/x`` is accepted."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def retried(action, retries: int = RETRIES, wait: float = FIRST_WAIT_SECONDS):
    """Run ``action``, trying again after an I/O error with doubling waits. A missing file is not retried."""
    for attempt in range(retries + 1):
        try:
            return action()
        except FileNotFoundError:
            raise
        except OSError:
            if attempt == retries:
                raise
            time.sleep(wait * 2 ** attempt)


def chunks(fs: pafs.FileSystem, path: str, start: int = 0, length: int | None = None) -> Iterator[bytes]:
    with fs.open_input_file(path) as stream:
        stream.seek(start)
        left = length
        while left is None or left > 0:
            block = stream.read(CHUNK if left is None else min(CHUNK, left))
            if not block:
                return
            if left is not None:
                left -= len(block)
            yield block


def digest(fs: pafs.FileSystem, path: str, length: int | None = None) -> str:
    """MD5 of a file, or of its first ``length`` bytes, read in chunks."""
    found = hashlib.md5()
    for block in chunks(fs, path, 0, length):
        found.update(block)
    return found.hexdigest()


def kind(fs: pafs.FileSystem, path: str) -> pafs.FileInfo:
    return fs.get_file_info([path])[0]


# Fixed value: the extended attribute in which a local disk keeps a file's access list.
ACL_NAME = "system.posix_acl_access"


def attributes(fs: pafs.FileSystem, path: str) -> dict:
    """Owner, group, permission, times, block size, replication, access list and extended attributes of a local file.

    Arrow's other filesystems tell none of these; all values are None there. Raises FileNotFoundError for a file that has
    vanished.
    """
    names = ("owner", "group", "permission", "atime_ns", "block_size", "replication", "acl", "xattrs")
    if not isinstance(fs, pafs.LocalFileSystem):
        return dict.fromkeys(names)
    facts = os.stat(path)
    try:
        held = {name: os.getxattr(path, name).hex() for name in os.listxattr(path)}
    except OSError:  # a disk without extended attributes
        held = {}
    return dict(zip(names, (str(facts.st_uid), str(facts.st_gid), stat.filemode(facts.st_mode)[1:], facts.st_atime_ns,
                            facts.st_blksize, 1, held.pop(ACL_NAME, None), held)))


def mode(permission: str) -> int:
    """``rwxr-x--T`` to the mode bits."""
    bits = 0
    for place, char in enumerate(permission):
        if char in "rwxst":
            bits |= 1 << 8 - place
        if char in "sStT":
            bits |= (stat.S_ISUID, stat.S_ISGID, stat.S_ISVTX)[place // 3]
    return bits


def set_attributes(path: str, wanted: list[str], row: dict) -> None:
    """Give a local file or directory the named attributes of ``row``; times go last, since the others touch them."""
    if "USER" in wanted or "GROUP" in wanted:
        os.chown(path, int(row["owner"]) if "USER" in wanted else -1, int(row["group"]) if "GROUP" in wanted else -1)
    if "XATTR" in wanted:
        ours = {name: bytes.fromhex(value) for name, value in dict(row["xattrs"] or {}).items()}
        for name in os.listxattr(path):
            if name != ACL_NAME and name not in ours:
                os.removexattr(path, name)
        for name, value in ours.items():
            os.setxattr(path, name, value)
    if "PERMISSION" in wanted or "ACL" in wanted and row.get("permission"):
        os.chmod(path, mode(row["permission"]))
    if "ACL" in wanted:
        if row["acl"]:
            os.setxattr(path, ACL_NAME, bytes.fromhex(row["acl"]))
        elif ACL_NAME in os.listxattr(path):
            os.removexattr(path, ACL_NAME)
    if "TIMES" in wanted:
        os.utime(path, ns=(int(row["atime_ns"]), int(row["mtime_ns"])))


def make_parent(fs: pafs.FileSystem, path: str, made: set[str] | None = None) -> None:
    """``made`` remembers, for a task whose folders nobody deletes meanwhile, the parents that exist."""
    above = path.rsplit("/", 1)[0]
    if above and (made is None or above not in made):
        fs.create_dir(above, recursive=True)
        if made is not None:
            made.add(above)


def remove(fs: pafs.FileSystem, path: str) -> bool:
    """Delete a file or a whole directory; False when it was not there."""
    info = kind(fs, path)
    if info.type == pafs.FileType.NotFound:
        return False
    try:
        fs.delete_dir(path) if info.type == pafs.FileType.Directory else fs.delete_file(path)
    except FileNotFoundError:
        return False
    return True


def _alternatives(pattern: str) -> list[str]:
    """``a{b,c}`` to ``ab`` and ``ac``."""
    braces = re.search(r"\{([^{}]*)\}", pattern)
    if not braces:
        return [pattern]
    head, tail = pattern[:braces.start()], pattern[braces.end():]
    return [p for word in braces.group(1).split(",") for p in _alternatives(head + word + tail)]


def expand(pattern: str) -> list[str]:
    """Existing paths, as URIs like the pattern, that match it; only directories of its wild segments are listed."""
    found: list[str] = []
    for one in _alternatives(pattern):
        wild = re.search(r"[*?\[]", one)
        if not wild:
            fs, path = open_root(one)
            found += [one] if kind(fs, path).type != pafs.FileType.NotFound else []
            continue
        fixed, rest = one[:wild.start()].rsplit("/", 1)
        segments = (rest + one[wild.start():]).split("/")
        level = [fixed]
        for segment in segments:
            below = []
            for place in level:
                fs, path = open_root(place or "/")
                entries = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
                below += [f"{place}/{e.base_name}" for e in entries if fnmatch.fnmatchcase(e.base_name, segment)]
            level = below
        found += level
    return sorted(set(found))
