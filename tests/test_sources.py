import io
import os
import random
import shutil
from contextlib import redirect_stdout
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chainloom import cli, plugins, sinks
from chainloom.coins import coin
from chainloom.functions import codec, scripts
from chainloom.functions.scripts import OP_RETURN, P2PKH
from chainloom.operators import utxo
from chainloom.operators.verify import ChainError, verify
from chainloom.progress import Progress
from chainloom.sources import blkdat, leveldb
from chainloom.sources.tables import flatten, load, load_csv, read_blocks, save
from chainloom.streaming.utxo_stream import utxo_changes

ZERO = "0" * 64
# A public script and its address.
SCRIPT = bytes.fromhex("76a91412ab8dc588ca9d5787dde7eb29569da63c3a238c88ac")
ADDRESS = "12higDjoCCNXSA95xZMWUdPvXNmkAduhWv"


def build_chain(n=12):
    """Blocks of a small chain: each has a coinbase, from the third on a spend of an earlier coinbase."""
    blocks, prev, coinbases = [], ZERO, []
    for h in range(n):
        txs = [{"version": 1, "lock_time": 0, "inputs": [{"hash_prev_out": ZERO, "index_prev_out": 2**32 - 1, "script_sig": bytes([h]), "sequence": 2**32 - 1}],
                "outputs": [{"value": 5_000_000_000 + h, "script_pubkey": SCRIPT}, {"value": 0, "script_pubkey": b"\x6a\x05" + b"note%d" % (h % 10)}]}]
        if h >= 2:
            txs.append({"version": 2, "lock_time": h, "inputs": [{"hash_prev_out": coinbases[h - 2], "index_prev_out": 0, "script_sig": b"sig", "sequence": 1}], "outputs": [{"value": 7, "script_pubkey": SCRIPT}]})
        raw = [codec.write_tx(t, [[b"w"]] if h % 3 == 2 and t["version"] == 2 else None) for t in txs]
        ids = [codec.read_tx(r)[0]["txid"] for r in raw]
        coinbases.append(ids[0])
        head = {"version": 1, "hash_prev": prev, "n_time": 1000 + 600 * h, "n_bits": 1, "n_nonce": h}
        head["hash_merkle_root"] = codec.shown(codec.merkle_root([bytes.fromhex(i)[::-1] for i in ids]))
        data = codec.write_header(head) + codec.write_compact_size(len(raw)) + b"".join(raw)
        prev = codec.read_header(data)["block_hash"]
        blocks.append(data)
    return blocks


def write_files(folder, blocks, key=b"", order=None):
    """Block files with the blocks in a mixed order, and the records of an index."""
    magic, files, records = coin().magic.to_bytes(4, "little"), {0: b"", 7: b""}, []
    for k, h in enumerate(order or range(len(blocks))):
        n = 7 if k >= len(blocks) // 2 else 0
        files[n] += magic + len(blocks[h]).to_bytes(4, "little")
        head = codec.read_header(blocks[h])
        records.append({"block_hash": head["block_hash"], "version": 1, "height": h, "status": 13, "tx_count": 1, "blk_index": n, "data_offset": len(files[n])})
        files[n] += blocks[h] + bytes(5)
    for n, data in files.items():
        (folder / ("blk00000.dat" if n == 0 else "blk7.dat")).write_bytes(codec.unxor(data, key))
    (folder / "blkindex.dat").write_bytes(b"")
    (folder / "rev00000.dat").write_bytes(b"x")
    if key:
        (folder / "xor.dat").write_bytes(key)
    return records


def write_index(folder, records):
    folder.mkdir()
    pairs = sorted(codec.write_index_record(r) for r in records) + [(b"F", b"flag")]
    pq.write_table(pa.table({"key": pa.array([k for k, _ in pairs], pa.binary()), "value": pa.array([v for _, v in pairs], pa.binary())}), folder / "part.parquet")


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    folder = tmp_path_factory.mktemp("blocks")
    order = random.Random(1).sample(range(12), 12)
    write_index(folder / "index", write_files(folder, build_chain(), bytes(range(3, 11)), order))
    return folder


def test_file_names(tmp_path):
    assert [blkdat.file_index(n) for n in ("blk00000.dat", "blk6.dat", "blk1202.dat", "blk13412451.dat", "blkindex.dat", "invalid.dat")] == [0, 6, 1202, 13412451, None, None]
    with pytest.raises(FileNotFoundError):
        blkdat.block_files(str(tmp_path))
    (tmp_path / "real.bin").write_bytes(b"x")
    os.symlink(tmp_path / "real.bin", tmp_path / "blk3.dat")
    assert list(blkdat.block_files(str(tmp_path))) == [3] and blkdat.xor_key(str(tmp_path)) is None
    (tmp_path / "xor.dat").write_bytes(b"")
    assert blkdat.xor_key(str(tmp_path)) is None


def test_blocks_by_index_and_by_frames(spark, home):
    by_index = read_blocks(spark, str(home), coin(), str(home / "index"))
    rows = {r.height: r.block_hash for r in by_index.select("height", "block_hash").collect()}
    assert rows == {h: codec.read_header(b)["block_hash"] for h, b in enumerate(build_chain())}
    framed = read_blocks(spark, str(home), coin())
    assert {r.block_hash for r in framed.collect()} == set(rows.values()) and framed.where("height IS NOT NULL").count() == 0
    assert sorted(r.height for r in read_blocks(spark, str(home), coin(), str(home / "index"), 3, 5).collect()) == [3, 4, 5]


def test_height_filter_reaches_the_source(home):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = blkdat.BlockReader({"path": str(home), "index": str(home / "index"), "blocksPerTask": "2"})
    assert sum(len(p.blocks) for p in reader.partitions()) == 12
    other = EqualTo(("n_time",), 5)
    assert list(reader.pushFilters([GreaterThanOrEqual(("height",), 4), LessThan(("height",), 7), other])) == [other]
    assert sorted(h for p in reader.partitions() for h, _ in p.blocks) == [4, 5, 6]
    plain = blkdat.UnfilteredBlockReader({"path": str(home)})
    assert len(plain.partitions()) == 2


def test_filter_on_height_in_sql(spark, home):
    df = read_blocks(spark, str(home), coin(), str(home / "index")).where("height >= 10 AND tx_count = 2")
    assert sorted(r.height for r in df.collect()) == [10, 11]


def test_gap_and_bad_status_end_the_chain(tmp_path):
    records = {r["height"]: r for r in write_files(tmp_path, build_chain())}
    del records[5]
    assert [r["height"] for r in blkdat.selected(records, 2, None)] == [2, 3, 4] and blkdat.selected(records, 5, None) == []
    write_index(tmp_path / "i", [{**r, "status": 3} for r in records.values()])
    with pytest.raises(ValueError):
        blkdat.index_records(str(tmp_path / "i"))


def leveldb_table(entries):
    """A sorted table by the published format, with one block and shared key prefixes."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def block(pairs):
        data, last = b"", b""
        for k, v in pairs:
            shared = len(os.path.commonprefix([last, k]))
            data, last = data + varint(shared) + varint(len(k) - shared) + varint(len(v)) + k[shared:] + v, k
        return data + bytes(4) + (1).to_bytes(4, "little")

    tagged = [(k + ((s << 8) | (v is not None)).to_bytes(8, "little"), v or b"") for k, s, v in entries]
    body = block(tagged)
    index = block([(tagged[-1][0], varint(0) + varint(len(body)))])
    handle = varint(0) + varint(0) + varint(len(body) + 5) + varint(len(index))
    return body + bytes(5) + index + bytes(5) + handle + bytes(40 - len(handle)) + leveldb.TABLE_MAGIC.to_bytes(8, "little")


def test_leveldb_folder(tmp_path, home):
    (tmp_path / "000005.ldb").write_bytes(leveldb_table([(b"ka", 1, b"old"), (b"kb", 2, b"stays"), (b"kc", 3, b"goes")]))
    batch = (10).to_bytes(8, "little") + (2).to_bytes(4, "little") + b"\1\2ka\3new" + b"\0\2kc"
    (tmp_path / "000006.log").write_bytes(bytes(4) + len(batch).to_bytes(2, "little") + b"\1" + batch + b"\0\0")
    assert list(leveldb.pairs(str(tmp_path))) == [(b"ka", b"new"), (b"kb", b"stays")]
    records = blkdat.index_records(str(home / "index"))
    folder = tmp_path / "db"
    folder.mkdir()
    pairs = sorted(codec.write_index_record(r) for r in records.values())
    (folder / "1.ldb").write_bytes(leveldb_table([(k, i + 1, v) for i, (k, v) in enumerate(pairs)]))
    assert blkdat.index_records(str(folder)) == records
    with pytest.raises(ValueError):
        list(leveldb.table_entries(bytes(100)))


@pytest.fixture(scope="module")
def tables(spark, home):
    return flatten(read_blocks(spark, str(home), coin(), str(home / "index")), coin())


def test_relations(tables):
    assert {n: df.count() for n, df in tables.items()} == {"blocks": 12, "transactions": 22, "tx_in": 22, "tx_out": 34}
    assert tables["transactions"].where("is_coinbase").count() == 12
    kinds = {r.pattern: r["count"] for r in tables["tx_out"].groupBy("pattern").count().collect()}
    assert kinds == {P2PKH: 22, OP_RETURN: 12}
    live = utxo.utxo_set(tables["tx_out"], tables["tx_in"])
    assert live.count() == 12 and {r.address for r in live.collect()} == {ADDRESS}
    assert utxo.balances(live).first().balance == Decimal(5_000_000_010 + 5_000_000_011 + 70)
    verify(tables["blocks"], tables["transactions"], tables["blocks"].where("height = 0").first().block_hash)
    with pytest.raises(ChainError):
        verify(tables["blocks"], tables["transactions"], ZERO)
    with pytest.raises(ChainError, match="merkle"):
        verify(tables["blocks"].withColumn("hash_merkle_root", F.lit(ZERO)), tables["transactions"], tables["blocks"].where("height = 0").first().block_hash)


def test_saved_tables_prune_by_height(spark, tables, tmp_path):
    save(tables, str(tmp_path / "t"))
    some = load(spark, str(tmp_path / "t"), 3, 4)
    assert {n: df.count() for n, df in some.items()} == {"blocks": 2, "transactions": 4, "tx_in": 4, "tx_out": 6}
    plan = some["tx_out"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "height_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_csv_files(spark, tables, tmp_path):
    sinks.dump_csv(tables, str(tmp_path), 0, 11)
    lines = sorted(x for x in spark.read.text(str(tmp_path / "tx_out-0-11.csv")).toPandas().value)
    assert sum(x.endswith(f";{SCRIPT.hex()};{ADDRESS}") for x in lines) == 22 and sum(x.endswith(";") for x in lines) == 12
    back = load_csv(spark, {n: str(tmp_path / f"{n}-0-11.csv") for n in ("blocks", "transactions", "tx_in", "tx_out")})
    assert back["tx_out"].where("address = ''").count() == 12 and back["blocks"].count() == 12
    assert {bytes(r.script_pubkey) for r in back["tx_out"].where("address <> ''").collect()} == {SCRIPT}
    parts = sorted(p for p in os.listdir(tmp_path / "blocks-0-11.csv") if p.endswith(".csv"))
    heights = [int(x.split(";")[1]) for p in parts for x in (tmp_path / "blocks-0-11.csv" / p).read_text().split()]
    assert heights == list(range(12))


def run_cli(*args):
    out = io.StringIO()
    with redirect_stdout(out):
        code = cli.main(list(args))
    return code, out.getvalue()


def test_command_line(spark, home, tmp_path):
    code, text = run_cli("-d", str(home), "simplestats")
    lines = {x[:29].strip(): x[29:].strip() for x in text.splitlines()}
    assert code == 0 and (lines["blocks"], lines["transactions"], lines["mean minutes between blocks"]) == ("12", "22", "10.00")
    assert lines["fees"] == "0.00000066 = 66 of the smallest unit" and lines["scripts Pay2PublicKeyHash"].startswith("22, 64.71 %, first at height 0")
    code, text = run_cli("-d", str(home), "-s", "3", "-e", "4", "opreturn")
    assert code == 0 and [x.split()[-1] for x in text.splitlines()] == ["note3", "note4"] and text.startswith("height: 3         txid: ")
    assert run_cli("-d", str(home), "balances", str(tmp_path))[0] == 0
    assert f"{ADDRESS};10000000091" in spark.read.text(str(tmp_path / "balances-0-11.csv")).toPandas().value.tolist()
    assert run_cli("-d", str(home), "unspentcsvdump", str(tmp_path))[0] == 0
    text = spark.read.text(str(tmp_path / "unspent-0-11.csv")).toPandas().value.tolist()
    assert "txid;indexOut;height;value;address" in text
    assert run_cli("-d", str(home), "-s", "5", "-e", "2", "simplestats")[0] == 1
    assert run_cli("-d", str(home / "nowhere"), "simplestats")[0] == 1
    assert run_cli("-d", str(home), "--verify", "simplestats")[0] == 1  # this chain's first block isn't Bitcoin's
    assert run_cli("-d", str(home), "--verify", "-s", "2", "simplestats")[0] == 0


def test_counts_and_progress(spark, home, tmp_path, caplog):
    with caplog.at_level("INFO"):
        assert run_cli("-d", str(home), "csvdump", str(tmp_path))[0] == 0 and run_cli("-d", str(home), "balances", str(tmp_path))[0] == 0
    said = caplog.text
    assert all(x in said for x in ("blocks: 12", "transactions: 22", "tx_in: 22", "tx_out: 34", "addresses: 1", "12 blocks, "))
    with caplog.at_level("INFO"), Progress(spark, 0.2) as p:
        spark.range(4, numPartitions=4).repartition(4).foreachPartition(lambda _: __import__("time").sleep(1))
        assert p.done(10, "things") > 0
    assert "tasks of the running stages" in caplog.text and "10 things" in caplog.text


def test_plugins(spark, home, tmp_path, monkeypatch):
    (tmp_path / "tip_plugin.py").write_text("from pyspark.sql import functions as F\nfrom chainloom.plugins import analytic\n\n\n@analytic('tips', help='the highest block')\ndef tips(t):\n    return {'tips': t['blocks'].agg(F.max('height'), F.count(F.lit(1)))}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    try:
        code, text = run_cli("-d", str(home), "--plugin", "tip_plugin", "-e", "7", "tips")
        assert code == 0 and text == "7\t8\n"
    finally:
        plugins.ANALYTICS.pop("tips", None)


def test_magic_within_a_block(spark, tmp_path, monkeypatch):
    """The magic bytes inside of a script are no frame, also where a split begins right before them."""
    blocks = build_chain(3)
    magic = coin().magic.to_bytes(4, "little")
    tx = {"version": 1, "lock_time": 0, "inputs": [{"hash_prev_out": ZERO, "index_prev_out": 2**32 - 1, "script_sig": b"", "sequence": 0}], "outputs": [{"value": 1, "script_pubkey": (magic + len(blocks[0]).to_bytes(4, "little") + blocks[0]) * 3}]}
    raw = codec.write_tx(tx)
    head = {"version": 1, "hash_prev": codec.read_header(blocks[-1])["block_hash"], "n_time": 1, "n_bits": 1, "n_nonce": 1, "hash_merkle_root": codec.read_tx(raw)[0]["txid"]}
    blocks.append(codec.write_header(head) + b"\1" + raw)
    write_files(tmp_path, blocks)
    monkeypatch.setattr(blkdat, "SPLIT", 100)
    reader = blkdat.BlockReader({"path": str(tmp_path)})
    found = [b for p in reader.partitions() for _, b in reader._raw(p)]
    assert len(reader.partitions()) > 8 and sorted(found) == sorted(blocks)


def test_literal_pushdata_and_errors(spark):
    odd = b"\x6a\x4c\x02" + b"z" * 2
    assert scripts.evaluate(odd, 0x1E)[1:] == (OP_RETURN, "zz") and scripts.evaluate(odd, 0x1E, literal=True)[1] == scripts.UNKNOWN
    assert scripts.script_error(odd, 0x1E) is None and scripts.script_error(odd, 0x1E, literal=True) == "ScriptError: Unexpected EOF" and scripts.script_error(None) is None
    row = spark.createDataFrame([(bytearray(b"\xa9\x14" + bytes(20) + b"\x87"),)], "s binary")
    read = [row.select(scripts.evaluated(F.col("s"), F.lit(0x1E), p2sh_version=v)["address"]).first()[0] for v in (5, 0x16)]
    assert read == [scripts.base58check(5, bytes(20)), scripts.base58check(0x16, bytes(20))]


def test_stream_of_blocks(spark, tmp_path):
    spark.dataSource.register(blkdat.BlockFiles)
    records = write_files(tmp_path, build_chain())
    write_index(tmp_path / "index", [r for r in records if r["height"] < 5])
    stream = spark.readStream.format("blkdat").option("index", str(tmp_path / "index")).option("start", "2").load(str(tmp_path)).select("height", "block_hash")

    def batch():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.height for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert batch() == [2, 3, 4]
    shutil.rmtree(tmp_path / "index")
    write_index(tmp_path / "index", records)
    assert batch() == list(range(2, 12))


def test_command_line_without_index(spark, tmp_path):
    write_files(tmp_path, build_chain(6), order=[3, 1, 0, 2, 5, 4])
    code, text = run_cli("-d", str(tmp_path), "-s", "1", "-e", "3", "opreturn")
    assert code == 0 and [x.split()[-1] for x in text.splitlines()] == ["note1", "note2", "note3"]


@pytest.mark.parametrize("args", [["simplestats"], ["-s", "10", "simplestats"], ["-e", "10", "opreturn"], ["-s", "1", "-e", "2", "csvdump", "x"]])
def test_arguments(args):
    a = cli.parser().parse_args(args)
    assert a.coin == "bitcoin" and not a.verify


@pytest.mark.parametrize("args", [[], ["csvdump"], ["-c", "nocoin", "simplestats"], ["-s", "x", "simplestats"]])
def test_bad_arguments(args):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(args)


def test_stream_gives_the_same_live_outputs(spark, tables, tmp_path):
    events = utxo.events(tables["tx_out"], tables["tx_in"])
    for k in range(3):  # three micro-batches in no order of the chain
        events.where(F.pmod(F.xxhash64("txid", "index_out"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = utxo_changes(stream).writeStream.outputMode("update").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = spark.table("changes").groupBy("txid", "index_out").agg(F.max_by(F.struct("live", "value"), F.struct("height", "tx_index")).alias("e")).where("e.live")
    want = utxo.utxo_set(tables["tx_out"], tables["tx_in"])
    assert {(r.txid, r.index_out, r.e.value) for r in last.collect()} == {(r.txid, r.index_out, r.value) for r in want.collect()}
