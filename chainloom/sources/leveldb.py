"""Reading LevelDB folders: sorted tables (.ldb, .sst) and write-ahead logs, by the published file format. Read-only.

Block contents must be stored plain, as a node's block index has them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

FOOTER = 48
TABLE_MAGIC = 0xDB4775248B80FB57
LOG_BLOCK = 32768


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 0x80:
            return n, at


def _block(b: bytes, offset: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    if b[offset + size]:
        raise ValueError("compressed LevelDB blocks are not supported")
    data = b[offset : offset + size]
    end = len(data) - 4 - 4 * int.from_bytes(data[-4:], "little")
    at, key = 0, b""
    while at < end:
        shared, at = _varint(data, at)
        own, at = _varint(data, at)
        n, at = _varint(data, at)
        key = key[:shared] + data[at : at + own]
        yield key, data[at + own : at + own + n]
        at += own + n


def table_entries(b: bytes) -> Iterator[tuple[bytes, int, bytes | None]]:
    """(key, sequence, value or None if deleted) of a sorted table."""
    foot = b[-FOOTER:]
    if int.from_bytes(foot[-8:], "little") != TABLE_MAGIC:
        raise ValueError("not a LevelDB table")
    _, at = _varint(foot, 0)
    _, at = _varint(foot, at)
    offset, at = _varint(foot, at)
    size, _ = _varint(foot, at)
    for _, handle in _block(b, offset, size):
        where, k = _varint(handle, 0)
        n, _ = _varint(handle, k)
        for key, value in _block(b, where, n):
            tag = int.from_bytes(key[-8:], "little")
            yield key[:-8], tag >> 8, value if tag & 0xFF else None


def log_entries(b: bytes) -> Iterator[tuple[bytes, int, bytes | None]]:
    """(key, sequence, value or None if deleted) of a write-ahead log; a cut-off tail ends it."""
    at, record = 0, b""
    while at + 7 <= len(b):
        left = LOG_BLOCK - at % LOG_BLOCK
        if left < 7:
            at += left
            continue
        n, kind = int.from_bytes(b[at + 4 : at + 6], "little"), b[at + 6]
        part = b[at + 7 : at + 7 + n]
        if kind == 0 or len(part) < n:
            return
        at += 7 + n
        record = part if kind in (1, 2) else record + part
        if kind in (1, 4):
            sequence, k = int.from_bytes(record[:8], "little"), 12
            while k < len(record):
                put, size, = record[k], None
                size, k = _varint(record, k + 1)
                key, k = record[k : k + size], k + size
                value = None
                if put:
                    size, k = _varint(record, k)
                    value, k = record[k : k + size], k + size
                yield key, sequence, value
                sequence += 1


def pairs(folder: str) -> Iterator[tuple[bytes, bytes]]:
    """The live (key, value) pairs in key order: the newest entry of each key unless it is a deletion."""
    newest: dict[bytes, tuple[int, bytes | None]] = {}
    for name in sorted(os.listdir(folder)):
        read = table_entries if name.endswith((".ldb", ".sst")) else log_entries if name.endswith(".log") else None
        if read is None:
            continue
        with open(os.path.join(folder, name), "rb") as f:
            for key, sequence, value in read(f.read()):
                if key not in newest or newest[key][0] <= sequence:
                    newest[key] = sequence, value
    for key in sorted(newest):
        if newest[key][1] is not None:
            yield key, newest[key][1]
