import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chainloom.coins import COINS, coin
from chainloom.functions import codec

# Public data: the first Bitcoin block.
GENESIS = bytes.fromhex(
    "0100000000000000000000000000000000000000000000000000000000000000000000003ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a29ab5f49ffff001d1dac2b7c"
    "0101000000010000000000000000000000000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054696d65732030332f4a616e2f32303039204368616e63656c6c6f72206f6e206272696e6b206f66207365636f6e64206261696c6f757420666f722062616e6b73ffffffff0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5fac00000000"
)
tx_of = st.fixed_dictionaries(
    {
        "version": st.integers(0, 2**32 - 1),
        "lock_time": st.integers(0, 2**32 - 1),
        "inputs": st.lists(st.fixed_dictionaries({"hash_prev_out": st.binary(min_size=32, max_size=32).map(bytes.hex), "index_prev_out": st.integers(0, 2**32 - 1), "script_sig": st.binary(max_size=300), "sequence": st.integers(0, 2**32 - 1)}), min_size=1, max_size=4),
        "outputs": st.lists(st.fixed_dictionaries({"value": st.integers(0, 2**64 - 1), "script_pubkey": st.binary(max_size=300)}), max_size=4),
    }
)


def test_first_block():
    b = codec.read_block(GENESIS, coin("Bitcoin"))
    assert b["block_hash"] == coin().genesis
    assert (b["version"], b["n_time"], b["n_bits"], b["n_nonce"], b["tx_count"], b["blocksize"]) == (1, 1231006505, 0x1D00FFFF, 2083236893, 1, 285)
    assert b["hash_prev"] == "0" * 64
    tx = b["txs"][0]
    assert tx["txid"] == b["hash_merkle_root"] == codec.shown(codec.merkle_root([bytes.fromhex(tx["txid"])[::-1]]))
    assert tx["outputs"][0]["value"] == 5_000_000_000 and len(tx["inputs"][0]["script_sig"]) == 0x4D and len(tx["outputs"][0]["script_pubkey"]) == 0x43
    assert codec.write_header(b) == GENESIS[:80]
    assert codec.write_tx(tx) == GENESIS[81:]


@given(tx_of, st.booleans())
def test_transactions_survive(tx, witness):
    plain = codec.write_tx(tx)
    raw = codec.write_tx(tx, [[b"ab", b""] for _ in tx["inputs"]]) if witness else plain
    back, end = codec.read_tx(raw)
    assert end == len(raw)
    assert back["stripped_size"] == len(plain) and back["txid"] == codec.shown(codec.dsha(plain))
    assert {k: back[k] for k in tx} == tx


@given(st.binary(max_size=60))
def test_any_bytes_end_cleanly(data):
    for read in (lambda: codec.read_tx(data), lambda: codec.read_block(data, coin("dogecoin")), lambda: codec.compact_size(data, 0)):
        try:
            read()
        except codec.Truncated:
            pass


def test_merged_mining_extension():
    parent = dict(version=2, hash_prev="11" * 32, hash_merkle_root="22" * 32, n_time=5, n_bits=6, n_nonce=7)
    own = dict(version=0x620104, hash_prev="33" * 32, hash_merkle_root="44" * 32, n_time=1, n_bits=2, n_nonce=0)
    tx = {"version": 1, "lock_time": 0, "inputs": [{"hash_prev_out": "0" * 64, "index_prev_out": 2**32 - 1, "script_sig": b"x", "sequence": 1}], "outputs": [{"value": 5, "script_pubkey": b"\x51"}]}
    branch = codec.write_compact_size(2) + bytes(32) + b"\1" * 32 + (3).to_bytes(4, "little")
    aux = codec.write_tx(tx) + b"\7" * 32 + branch + codec.write_compact_size(0) + bytes(4) + codec.write_header(parent)
    body = codec.write_compact_size(1) + codec.write_tx(tx)
    b = codec.read_block(codec.write_header(own) + aux + body, coin("dogecoin"))
    assert b["aux_pow"]["block_hash"] == "07" * 32 and b["aux_pow"]["parent_block"]["n_nonce"] == 7 and b["aux_pow"]["coinbase_branch"]["side_mask"] == 3 and b["tx_count"] == 1
    old = codec.read_block(codec.write_header(own | {"version": 1}) + body, coin("dogecoin"))
    assert old["aux_pow"] is None and old["tx_count"] == 1
    assert codec.read_block(codec.write_header(own) + body, coin("litecoin"))["aux_pow"] is None


# Sizes and their bytes.
SIZES = {250: "fa", 4444: "fd5c11", 515: "fd0302", 3333333333: "fe55a1aec6", 9000000000000000000: "ff000084e2506ce67c"}


def test_sizes():
    for n, h in SIZES.items():
        assert codec.write_compact_size(n).hex() == h and codec.compact_size(bytes.fromhex(h), 0) == (n, len(h) // 2)
    assert codec.compact_size(bytes.fromhex("fd0100"), 0) == (1, 3)
    with pytest.raises(codec.Truncated):
        codec.compact_size(b"\xfe\0", 0)


@given(st.integers(0, 2**64 - 1))
def test_index_integers(n):
    raw = codec.write_index_varint(n)
    assert codec.index_varint(raw, 0) == (n, len(raw))


def test_index_integers_known():
    assert [codec.write_index_varint(n).hex() for n in (0, 127, 128, 255, 256, 16511, 65535)] == ["00", "7f", "8000", "807f", "8100", "ff7f", "82fe7f"]
    with pytest.raises(ValueError):
        codec.index_varint(b"\xff" * 11 + b"\0", 0)


def test_xor():
    key = bytes(range(1, 9))
    data = bytes.fromhex("0102030405060708010203040506")
    assert codec.unxor(data, key) == bytes(14) and codec.unxor(data, None) == data == codec.unxor(data, b"")
    assert codec.unxor(data[5:], key, 5) == bytes(9)


@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=20))
def test_merkle(hashes):
    def naive(level):
        if len(level) == 1:
            return level[0]
        level = level + [level[-1]] * (len(level) % 2)
        two = lambda x: hashlib.sha256(hashlib.sha256(x).digest()).digest()
        return naive([two(level[i] + level[i + 1]) for i in range(0, len(level), 2)])

    assert codec.merkle_root(hashes) == naive(hashes)
    with pytest.raises(ValueError):
        codec.merkle_root([])


def test_coins():
    assert len(COINS) == 8 and coin(" Dogecoin ").auxpow_from == 0x620102
    with pytest.raises(ValueError):
        coin("nocoin")
