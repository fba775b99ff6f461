"""Queries that give whole results, compared row by row with the tables."""

from compare import duck

from chainloom.coins import COINS
from chainloom.functions.scripts import base58check
from chainloom.operators import heights
from chainloom.plans import catalog, ledger


def test_addresses_of_every_output(spark, small):
    got = {(r.txid, r.index_out): r for r in catalog.script_addresses_all(spark, small).collect()}
    rows = duck(small).execute(ledger.SQL + "SELECT coin, txid, index_out, script_pubkey, address, pattern FROM o").fetchall()
    assert len(got) == len(rows)
    differ, coins = 0, set()
    for coin, txid, k, script, recorded, pattern in rows:
        r = got[txid, k]
        assert (r.coin, r.recorded, r.pattern) == (coin, recorded, pattern)
        if script and len(script) == 25 and script.startswith(b"\x76\xa9\x14") and script.endswith(b"\x88\xac"):
            assert r.address == base58check(COINS[coin].version_id, script[3:23])
            coins.add(coin)
            differ += recorded is not None and recorded != r.address
    assert coins == {"bitcoin", "litecoin", "dogecoin"}
    assert differ  # a prefix filter on both sides would hide these


def test_every_block_has_a_height(spark, small):
    got = {r.block_hash: r for r in catalog.derived_heights_all(spark, small).collect()}
    rows = {h: (coin, prev, height) for coin, h, prev, height in duck(small).execute(ledger.SQL + "SELECT coin, block_hash, hash_prev, height FROM b").fetchall()}
    assert set(got) == set(rows) and len({r.base for r in got.values()}) > 3
    for h, (coin, prev, height) in rows.items():
        base, above = h, 0
        while rows[base][1] in rows:
            base, above = rows[base][1], above + 1
        assert (got[h].coin, got[h].height, got[h].base, got[h].derived) == (coin, height, base, rows[base][2] + above)


def test_lost_and_wrong_heights_show(spark, small, monkeypatch):
    recorded = {r.block_hash: r.height for r in ledger.blocks(spark, small).collect()}
    derived = lambda: {r.block_hash: r.derived for r in catalog.derived_heights(spark, small).collect()}
    assert derived() == recorded
    whole = heights.lines
    monkeypatch.setattr(heights, "lines", lambda *a: whole(*a).where("false"))
    assert set(derived().values()) == {None}
    monkeypatch.setattr(heights, "lines", lambda *a: whole(*a).where("above > 0"))
    assert derived() != recorded and None in derived().values()


def test_inputs_without_outpoint_are_kept(spark, small):
    txids = [r[0] for r in duck(small).execute(ledger.SQL + f"SELECT t.txid FROM t JOIN tx_in x ON {ledger._h('x.txid')} = t.txid WHERE x.dropped_at IS NULL AND (x.hashprevout IS NULL OR x.indexprevout IS NULL)").fetchall()]
    assert txids
    whole = catalog.QUERIES["chain_tx_in_whole"](spark, small)
    assert sorted(r.txid for r in whole.where("hash_prev_out IS NULL OR index_prev_out IS NULL").collect()) == sorted(txids)
    assert whole.count() == catalog.chain_tx_in(spark, small).count() + len(txids)
    sizes = {r.txid: r.stripped_size for r in catalog.QUERIES["tx_sizes_whole"](spark, small).collect()}
    for name in ("tx_decode_whole", "segwit_decode_whole"):
        read = {r.txid: r for r in catalog.QUERIES[name](spark, small).collect()}
        assert set(txids) <= set(read) and all(r.stripped_size == sizes[t] for t, r in read.items())
