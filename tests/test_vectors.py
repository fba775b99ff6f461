"""Decoding of real blocks and transactions."""

import vectors

from chainloom.coins import coin
from chainloom.functions import codec, scripts
from chainloom.operators import utxo


def merkle(block):
    return codec.shown(codec.merkle_root([bytes.fromhex(t["txid"])[::-1] for t in block["txs"]]))


def test_transaction_with_witness():
    tx, end = codec.read_tx(vectors.SEGWIT_TX)
    assert end == len(vectors.SEGWIT_TX) and (tx["version"], tx["lock_time"], tx["in_count"], tx["out_count"]) == (1, 0, 1, 1)
    (i,), (o,) = tx["inputs"], tx["outputs"]
    assert (i["index_prev_out"], len(i["script_sig"]), i["sequence"]) == (3, 23, 0xFFFFFFFF) and bytes.fromhex(i["hash_prev_out"])[::-1] == vectors.SEGWIT_TX[7:39]
    assert o["value"] == 99987100 and scripts.evaluate(o["script_pubkey"]) == ("13gv9XbKJPxxRF8Zm1LsVKeeiMCFguQPqm", scripts.P2PKH, None)
    plain = codec.write_tx(tx)
    assert tx["stripped_size"] == len(plain) and len(vectors.SEGWIT_TX) == len(plain) + 2 + 1 + 73 + 34
    assert codec.write_tx(tx, [[vectors.SEGWIT_TX[108:180], vectors.SEGWIT_TX[181:214]]]) == vectors.SEGWIT_TX


def test_namecoin_block():
    b = codec.read_block(vectors.NAMECOIN_BLOCK, coin("namecoin"))
    assert (b["version"], b["n_time"], b["n_bits"], b["n_nonce"], b["tx_count"], b["blocksize"]) == (0x10101, 1318066829, 0x1B00B269, 0, 1, 678)
    assert b["block_hash"] == "d8a7c3e01e1e95bcee015e6fcc7583a2ca60b79e5a3aa0a171eddd344ada903d" and merkle(b) == b["hash_merkle_root"]
    aux = b["aux_pow"]
    assert aux["block_hash"] == aux["parent_block"]["block_hash"] == "0000000000003d47277359fb969c43e3c7e7c0306a17f6444b8e91e19def03a9"
    assert aux["parent_block"]["hash_prev"] == "00000000000004a59b7deb5c4e01b9786ea01ee8da000db77ce6035c2913be08"
    (i,), (o,) = b["txs"][0]["inputs"], b["txs"][0]["outputs"]
    assert i["hash_prev_out"] == "0" * 64 and i["script_sig"].hex() == "0469b2001b010152" and (o["value"], len(o["script_pubkey"])) == (5_000_000_000, 0x43)
    assert scripts.evaluate(o["script_pubkey"], coin("namecoin").version_id)[0] == "NHk86XHZ77H2uNgESo4ut598orZq8rcVKL"
    h = bytes.fromhex(aux["coinbase_txid"])[::-1]
    for other in aux["coinbase_branch"]["hashes"]:  # the branch leads from the coinbase to the parent's root
        h = codec.dsha(h + bytes.fromhex(other)[::-1])
    assert codec.shown(h) == aux["parent_block"]["hash_merkle_root"]


def test_dogecoin_block():
    b = codec.read_block(vectors.DOGECOIN_BLOCK, coin("dogecoin"))
    assert (b["version"], b["n_time"], b["n_bits"], b["n_nonce"], b["tx_count"], b["blocksize"]) == (0x620104, 1637169061, 0x1A04A51B, 0, 8, 2818)
    assert b["block_hash"] == "038ca8bfebd5d35e9c676b459f2c6ba4c03975ba653414b303d7bc4ac6fa787f" and merkle(b) == b["hash_merkle_root"]
    assert b["aux_pow"]["block_hash"] == "c5c290df0f691794805e9ccfdc932e5dfee4e440510f0e3cb5e171303239491c"
    assert b["aux_pow"]["parent_block"]["hash_prev"] == "bcf46567b86d599288fe672a913762d7292b461a04b891dee88e52196adefd9e"
    tx = b["txs"][0]
    assert tx["txid"] == "dc8dbed0461ec54a9524fc12fbed7466e6acb0f0637fcb2a0111174c84753fec"
    assert tx["inputs"][0]["script_sig"].hex() == "0369c93c0101" and tx["outputs"][0]["value"] == 1000201725200
    assert scripts.evaluate(tx["outputs"][0]["script_pubkey"], coin("dogecoin").version_id)[0] == "DEfXb18bE8RoC6edc9jXaMpEpuvVkcjJFq"


def test_trace_of_two_transactions(spark):
    spent, spending = (codec.read_tx(x)[0] for x in (vectors.SPENT_TX, vectors.SPENDING_TX))
    assert spent["txid"] == "fff2525b8931402dd09222c50775608f75787bd2b87e56995a7bdd30f79702c4"
    assert spending["txid"] == "5aa8e36f9423ee5fcf17c1d0d45d6988b8a5773eae8ad25d945bf34352040009" and spending["in_count"] == 9

    def live(*txs):
        outs = [(t["txid"], k, h, 0, o["value"], scripts.evaluate(o["script_pubkey"])[0]) for h, t in txs for k, o in enumerate(t["outputs"])]
        ins = [(i["hash_prev_out"], i["index_prev_out"], h, 0) for h, t in txs for i in t["inputs"]]
        o = spark.createDataFrame(outs, "txid string, index_out bigint, height bigint, tx_index bigint, value bigint, address string")
        i = spark.createDataFrame(ins, "hash_prev_out string, index_prev_out bigint, height bigint, tx_index bigint")
        return {(r.txid, r.index_out): (r.height, int(r.value), r.address) for r in utxo.utxo_set(o, i).collect()}

    assert live((100000, spent))[spent["txid"], 0] == (100000, 556000000, "1JqDybm2nWTENrHvMyafbSXXtTk5Uv5QAn")
    after = live((100000, spent), (105001, spending))
    assert (spent["txid"], 0) not in after and after[spending["txid"], 0] == (105001, 9070000000, "1EYXXHs5gV4pc7QAddmDj5z7m14QPHGvWL")
