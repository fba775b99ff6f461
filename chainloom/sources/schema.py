"""Schemas of decoded blocks and of the four relations made from them."""

from __future__ import annotations

OUTPUT = "struct<value: decimal(20,0), script_pubkey: binary>"
INPUT = "struct<hash_prev_out: string, index_prev_out: bigint, script_sig: binary, sequence: bigint>"
TX = (
    "struct<txid: string, version: bigint, lock_time: bigint, in_count: bigint, out_count: bigint, stripped_size: bigint, "
    f"inputs: array<{INPUT}>, outputs: array<{OUTPUT}>>"
)
BRANCH = "struct<hashes: array<string>, side_mask: bigint>"
HEADER = "block_hash: string, version: bigint, hash_prev: string, hash_merkle_root: string, n_time: bigint, n_bits: bigint, n_nonce: bigint"
AUXPOW = f"struct<coinbase_txid: string, block_hash: string, coinbase_branch: {BRANCH}, blockchain_branch: {BRANCH}, parent_block: struct<{HEADER}>>"
BLOCK = (
    "height bigint, block_hash string, version bigint, hash_prev string, hash_merkle_root string, n_time bigint, n_bits bigint, "
    f"n_nonce bigint, blocksize bigint, tx_count bigint, aux_pow {AUXPOW}, txs array<{TX}>"
)
INDEX = "block_hash string, version bigint, height bigint, status bigint, tx_count bigint, blk_index bigint, data_offset bigint"

#: Blocks per partition folder of the saved tables.
HEIGHTS_PER_BUCKET = 10_000

# Column order of the CSV files.
CSV = {
    "blocks": ["block_hash", "height", "version", "blocksize", "hash_prev", "hash_merkle_root", "n_time", "n_bits", "n_nonce"],
    "transactions": ["txid", "hash_block", "version", "lock_time"],
    "tx_in": ["txid", "hash_prev_out", "index_prev_out", "script_sig", "sequence"],
    "tx_out": ["txid", "index_out", "value", "script_pubkey", "address"],
}
CSV_TYPES = {
    "blocks": "block_hash string, height bigint, version bigint, blocksize bigint, hash_prev string, hash_merkle_root string, n_time bigint, n_bits bigint, n_nonce bigint",
    "transactions": "txid string, hash_block string, version bigint, lock_time bigint",
    "tx_in": "txid string, hash_prev_out string, index_prev_out bigint, script_sig string, sequence bigint",
    "tx_out": "txid string, index_out bigint, value decimal(20,0), script_pubkey string, address string",
}
