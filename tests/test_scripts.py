import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.functions import exprs, scripts
from chainloom.functions.codec import merkle_root, shown
from chainloom.functions.normalise import clean_address, clean_hash, clean_name, epoch_seconds, real_hash, real_hash_of

# Published scripts with their patterns and addresses.
BITCOIN = [
    ("76a91412ab8dc588ca9d5787dde7eb29569da63c3a238c88ac", scripts.P2PKH, "12higDjoCCNXSA95xZMWUdPvXNmkAduhWv", None),
    ("41044bca633a91de10df85a63d0a24cb09783148fe0e16c92e937fc4491580c860757148effa0595a955f44078b48ba67fa198782e8bb68115da0daa8fde5301f7f9ac", scripts.P2PK, "1LEWwJkDj8xriE87ALzQYcHjTmD8aqDj1f", None),
    ("a914e9c3dd0c07aac76179ebc76a6c78d4d67c6c160a87", scripts.P2SH, "3P14159f73E4gFr7JterCCQh9QjiTjiZrG", None),
    ("6a13636861726c6579206c6f766573206865696469", scripts.OP_RETURN, None, "charley loves heidi"),
    ("736372697074", scripts.UNKNOWN, None, None),
    ("4cff00", scripts.UNKNOWN, None, None),
    ("", scripts.UNKNOWN, None, None),
    ("6a02fffe", scripts.OP_RETURN, None, ""),
    ("50", scripts.UNSPENDABLE, None, None),
    ("0014751e76e8199196d454941c45d1b3a323f1433bd6", scripts.P2WPKH, "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", None),
    ("512079be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798", scripts.P2TR, "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", None),
    ("5210751e76e8199196d454941c45d1b3a323", scripts.WITNESS, "bc1zw508d6qejxtdg4y5r3zarvaryvaxxpcs", None),
    ("5121" + "02" * 33 + "21" + "03" * 33 + "52ae", scripts.MULTISIG, None, None),
    ("5321" + "02" * 33 + "21" + "03" * 33 + "52ae", scripts.UNKNOWN, None, None),
]
OTHER = [
    ("4104458bf7d944ce58c007d0f16fa54c0640694568954e162c06be0a0cba7275714b6672c589e7393fa48f8a5f6b6259061d394e9db005651d1bb28349d31339daa8ac", 0x30, "LfcUcxALy1gSeqZLrixAm4ETZbEWA7GLat", scripts.P2PK),
    ("210338bf57d51a50184cf5ef0dc42ecd519fb19e24574c057620262cc1df94da2ae5ac", 0x1E, "DLAznsPDLDRgsVcTFWRMYMG5uH6GddDtv8", scripts.P2PK),
    ("76a91412ab8dc588ca9d5787dde7eb29569da63c3a238c88ac", 0x30, None, scripts.P2PKH),
    ("6176a91412ab8dc588ca9d5787dde7eb29569da63c3a238c88ac", 0x30, None, scripts.P2PKH),
    ("6a13636861726c6579206c6f766573206865696469", 0x34, None, scripts.OP_RETURN),
    ("4cff00", 0x34, None, scripts.UNKNOWN),
    ("52" + "21" + "02" * 33 + "21" + "03" * 33 + "21" + "02" * 33 + "53ae", 0x34, None, scripts.MULTISIG),
]


@pytest.mark.parametrize("script,pattern,address,text", BITCOIN)
def test_bitcoin(script, pattern, address, text):
    assert scripts.evaluate(bytes.fromhex(script), 0) == (address, pattern, text)


@pytest.mark.parametrize("script,version,address,pattern", OTHER)
def test_other_coins(script, version, address, pattern):
    got = scripts.evaluate(bytes.fromhex(script), version)
    assert got[1] == pattern and (address is None or got[0] == address)


def test_other_coin_details():
    assert scripts.evaluate(bytes.fromhex("a914e9c3dd0c07aac76179ebc76a6c78d4d67c6c160a87"), 0x30)[0] == "3P14159f73E4gFr7JterCCQh9QjiTjiZrG"
    assert scripts.evaluate(b"\x6a\x02\xff\x41", 0x30) == (None, scripts.OP_RETURN, "�A")
    long = b"\x6a\x4c\x50" + b"x" * 80
    assert scripts.evaluate(long, 0x30)[2] == "x" * 80
    assert scripts.evaluate(long, 0x30, literal=True)[1] == scripts.UNKNOWN
    assert scripts.evaluate(None, 0x30) == (None, None, None)


def test_test_network():
    assert scripts.evaluate(bytes.fromhex("0014751e76e8199196d454941c45d1b3a323f1433bd6"), 0x6F)[0] == "tb1qw508d6qejxtdg4y5r3zarvary0c5xw7kxpjzsx"


@given(st.binary(max_size=120))
def test_any_script(data):
    for v in (0, 0x6F, 0x30):
        scripts.evaluate(data, v)


def test_expressions_agree(spark):
    rows = [(bytes.fromhex(s),) for s, *_ in BITCOIN] + [(None,)]
    df = spark.createDataFrame(rows, "s binary")
    got = df.select("s", scripts.classify(F.col("s")).alias("k"), scripts.evaluated(F.col("s")).alias("e"), scripts.op_return_text(F.col("s")).alias("t")).collect()
    for r in got:
        want = scripts.evaluate(None if r.s is None else bytes(r.s), 0)
        assert r.k == r.e.pattern == want[1] and r.e.address == want[0]
        if want[1] == scripts.OP_RETURN:
            assert r.t == want[2]


def test_scalars(spark):
    one = spark.range(1)
    row = lambda *c: tuple(one.select(*c).first())
    assert row(*[exprs.base_reward(F.lit(h)) for h in (0, 209999, 210000, 419999, 420000, 630000, 64 * 210000, 10**9)]) == (5000000000, 5000000000, 2500000000, 2500000000, 1250000000, 625000000, 0, 0)
    assert row(exprs.target(F.lit(0x1D00FFFF)))[0] == pytest.approx(2.695953529101131e67)
    assert row(*[exprs.compact_size(F.unhex(F.lit(h))) for h in ("fa", "fd5c11", "fe55a1aec6", "ff000084e2506ce67c", "fd01")]) == (250, 4444, 3333333333, 9000000000000000000, None)
    assert row(exprs.from_hex(F.lit("abc")), exprs.from_hex(F.lit("zz")), exprs.reverse_hex(F.lit("0102ff"))) == (None, None, "ff0201")
    leaves = [bytes([i]) * 32 for i in range(7)]
    for n in range(1, 8):
        assert row(exprs.merkle_of(F.array(*[F.lit(shown(h)) for h in leaves[:n]])))[0] == shown(merkle_root(leaves[:n]))
    exprs.register_sql(spark)
    assert tuple(spark.sql("SELECT base_reward(210000L), hash_display('0102')").first()) == (2500000000, "0201")


def test_normalisation(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(f"  0x{h.upper()}\t", 1), (None, 2), ("", 3), ("0" * 64, 4), (" 0X" + "0" * 64, 5), ("0xzz", 6)], "h string, i int")
    got = {r.i: (r.c, r.r, r.b and bytes(r.b)) for r in df.select("i", clean_hash("h").alias("c"), real_hash("h").alias("r"), real_hash_of("h").alias("b")).collect()}
    assert got == {1: (h, h, b"\xab" * 32), 2: (None, None, None), 3: ("", "", None), 4: ("0" * 64, "", None), 5: ("0" * 64, "", None), 6: ("zz", "zz", b"?zz")}
    df = spark.createDataFrame([(" BC1QaB ",), ("1aB",), ("  ",), (None,), ("",), ("\t3x",)], "a string")
    assert [r[0] for r in df.select(clean_address("a")).collect()] == ["bc1qab", "1aB", None, None, None, "3x"]
    assert [r[0] for r in df.select(clean_name("a")).collect()] == ["bc1qab", "1ab", None, None, None, "3x"]
    df = spark.createDataFrame([(None,), (0,), (-5,), (1357000000,), (1357000000123,), (1357000000123456,)], "t bigint")
    assert [r[0] for r in df.select(epoch_seconds("t")).collect()] == [None, None, None, 1357000000, 1357000000, 1357000000]
