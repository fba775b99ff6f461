"""Bytes of blocks, transactions and index records to plain values, and back.

Hashes are bytes in internal order; `shown` gives the customary reversed hex.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

from chainloom.coins import Coin

HEADER, HEADER_SIZE = "<I32s32sIII", 80


class Truncated(ValueError):
    """The bytes end before the value does."""


def dsha(data: bytes) -> bytes:
    """Double SHA-256."""
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def shown(h: bytes) -> str:
    return h[::-1].hex()


def take(buf: bytes, at: int, n: int) -> bytes:
    if at + n > len(buf):
        raise Truncated(f"{n} bytes wanted at {at} of {len(buf)}")
    return buf[at : at + n]


def compact_size(buf: bytes, at: int) -> tuple[int, int]:
    """(value, position behind it) of a CompactSize."""
    first = take(buf, at, 1)[0]
    if first < 0xFD:
        return first, at + 1
    width = 1 << (first - 0xFC)
    return int.from_bytes(take(buf, at + 1, width), "little"), at + 1 + width


def write_compact_size(n: int) -> bytes:
    """The shortest CompactSize of a value below 2 ** 64."""
    if n < 0xFD:
        return bytes([n])
    for first, width in ((0xFD, 2), (0xFE, 4), (0xFF, 8)):
        if n < 1 << 8 * width:
            return bytes([first]) + n.to_bytes(width, "little")
    raise ValueError("a CompactSize is below 2 ** 64")


def read_tx(buf: bytes, at: int = 0) -> tuple[dict, int]:
    """(transaction, position behind it).

    A zero input count is the marker of the witness form: a flag byte follows, and with its lowest bit set the witnesses stand
    before the lock time; they are skipped. Counts and lengths keep their written width in the hashed bytes.
    """
    start = at
    version = int.from_bytes(take(buf, at, 4), "little")
    body = at = at + 4
    n, at = compact_size(buf, at)
    flag = 0
    if n == 0:
        flag = take(buf, at, 1)[0]
        body = at + 1
        n, at = compact_size(buf, body)
    inputs, outputs = [], []
    for _ in range(n):
        prev, index = struct.unpack("<32sI", take(buf, at, 36))
        size, at = compact_size(buf, at + 36)
        inputs.append({"hash_prev_out": shown(prev), "index_prev_out": index, "script_sig": take(buf, at, size), "sequence": int.from_bytes(take(buf, at + size, 4), "little")})
        at += size + 4
    count, at = compact_size(buf, at)
    for _ in range(count):
        value = int.from_bytes(take(buf, at, 8), "little")
        size, at = compact_size(buf, at + 8)
        outputs.append({"value": value, "script_pubkey": take(buf, at, size)})
        at += size
    end = at
    if flag & 1:
        for _ in range(n):
            items, at = compact_size(buf, at)
            for _ in range(items):
                size, at = compact_size(buf, at)
                take(buf, at, size)
                at += size
    lock = take(buf, at, 4)
    plain = buf[start : start + 4] + buf[body:end] + lock
    tx = {
        "txid": shown(dsha(plain)),
        "version": version,
        "lock_time": int.from_bytes(lock, "little"),
        "in_count": n,
        "out_count": count,
        "stripped_size": len(plain),
        "inputs": inputs,
        "outputs": outputs,
    }
    return tx, at + 4


def write_tx(tx: dict, witness: Iterable[Iterable[bytes]] | None = None) -> bytes:
    """The bytes of a transaction of read_tx, in the witness form where `witness` has the items of each input."""
    parts = [struct.pack("<I", tx["version"]), b"\x00\x01" if witness is not None else b"", write_compact_size(len(tx["inputs"]))]
    for i in tx["inputs"]:
        parts += [bytes.fromhex(i["hash_prev_out"])[::-1], struct.pack("<I", i["index_prev_out"]), write_compact_size(len(i["script_sig"])), i["script_sig"], struct.pack("<I", i["sequence"])]
    parts.append(write_compact_size(len(tx["outputs"])))
    for o in tx["outputs"]:
        parts += [struct.pack("<Q", int(o["value"])), write_compact_size(len(o["script_pubkey"])), o["script_pubkey"]]
    for items in witness or ():
        items = list(items)
        parts += [write_compact_size(len(items)), *[write_compact_size(len(x)) + x for x in items]]
    return b"".join([*parts, struct.pack("<I", tx["lock_time"])])


def read_header(buf: bytes, at: int = 0) -> dict:
    raw = take(buf, at, HEADER_SIZE)
    version, prev, merkle, time, bits, nonce = struct.unpack(HEADER, raw)
    return {"block_hash": shown(dsha(raw)), "version": version, "hash_prev": shown(prev), "hash_merkle_root": shown(merkle), "n_time": time, "n_bits": bits, "n_nonce": nonce}


def write_header(h: dict) -> bytes:
    prev, merkle = (bytes.fromhex(h[k])[::-1] for k in ("hash_prev", "hash_merkle_root"))
    return struct.pack(HEADER, h["version"], prev, merkle, h["n_time"], h["n_bits"], h["n_nonce"])


def read_branch(buf: bytes, at: int) -> tuple[dict, int]:
    """(hashes and side mask of a merkle branch, position behind it)."""
    n, at = compact_size(buf, at)
    hashes = [shown(take(buf, at + 32 * k, 32)) for k in range(n)]
    at += 32 * n
    return {"hashes": hashes, "side_mask": int.from_bytes(take(buf, at, 4), "little")}, at + 4


def read_auxpow(buf: bytes, at: int) -> tuple[dict, int]:
    """(merged-mining extension, position behind it)."""
    tx, at = read_tx(buf, at)
    parent_hash = shown(take(buf, at, 32))
    coinbase, at = read_branch(buf, at + 32)
    chain, at = read_branch(buf, at)
    return {"coinbase_txid": tx["txid"], "block_hash": parent_hash, "coinbase_branch": coinbase, "blockchain_branch": chain, "parent_block": read_header(buf, at)}, at + HEADER_SIZE


def read_block(buf: bytes, coin: Coin, size: int | None = None) -> dict:
    """A block of `coin` with its transactions; `size` is the size written before it, by default the number of bytes."""
    block = read_header(buf)
    at, aux = HEADER_SIZE, None
    if coin.auxpow_from is not None and block["version"] >= coin.auxpow_from:
        aux, at = read_auxpow(buf, at)
    n, at = compact_size(buf, at)
    txs = []
    for _ in range(n):
        tx, at = read_tx(buf, at)
        txs.append(tx)
    return block | {"blocksize": len(buf) if size is None else size, "aux_pow": aux, "tx_count": n, "txs": txs}


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of the pairwise tree; an odd last node is paired with itself. No hashes: ValueError."""
    if not hashes:
        raise ValueError("a merkle tree has a leaf at least")
    while len(hashes) > 1:
        hashes = hashes + hashes[len(hashes) & ~1 :]
        hashes = [dsha(a + b) for a, b in zip(hashes[::2], hashes[1::2])]
    return hashes[0]


def index_varint(buf: bytes, at: int) -> tuple[int, int]:
    """(value, position behind it) of the block index' integers: groups of 7 bits, high first, each continued one adding 1."""
    n = 0
    while True:
        b = take(buf, at, 1)[0]
        at, n = at + 1, (n << 7) | (b & 0x7F)
        if n >> 64:
            raise ValueError("index integer above 64 bits")
        if b < 0x80:
            return n, at
        n += 1


def write_index_varint(n: int) -> bytes:
    out = [n & 0x7F]
    while n > 0x7F:
        n = (n >> 7) - 1
        out.append((n & 0x7F) | 0x80)
    return bytes(out[::-1])


INDEX_FIELDS = ("version", "height", "status", "tx_count", "blk_index", "data_offset")


def read_index_record(key: bytes, value: bytes) -> dict:
    """The record of a key `b` + block hash."""
    at, out = 0, {"block_hash": shown(key[1:33])}
    for f in INDEX_FIELDS:
        out[f], at = index_varint(value, at)
    return out


def write_index_record(r: dict) -> tuple[bytes, bytes]:
    return b"b" + bytes.fromhex(r["block_hash"])[::-1], b"".join(write_index_varint(r[f]) for f in INDEX_FIELDS)


def unxor(data: bytes, key: bytes | None, position: int = 0) -> bytes:
    """`data`, read at `position` of a file whose bytes are XORed with the repeated key. No or an empty key: as it is."""
    if not key:
        return data
    import numpy as np

    phase = position % len(key)
    turned = np.frombuffer(key[phase:] + key[:phase], np.uint8)
    return (np.frombuffer(data, np.uint8) ^ np.resize(turned, len(data))).tobytes()
