import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.functions import normalise
from chainloom.operators import heights, orphans, stats, utxo, verify, views
from chainloom.operators.tree_aggregate import State, exact_sum, rounds, tree_aggregate
from chainloom.session import Saved, fits, shared_dir, small_side

slow = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def states():
    return [State("n", F.count(F.lit(1))), *exact_sum("s", F.col("v")), State("m", F.max("v"), "max")]


def test_tree_is_exact_and_bounded(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(300)}", rng.choice([None, 0, 5, -7, 2**63 - 1, -(2**63)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(13)
    got = {r.k: (r.n, r.s, r.m) for r in tree_aggregate(df, ["k"], states(), splits=13, fan_in=2).collect()}
    per = defaultdict(list)
    for k, v in rows:
        per[k].append(v)
    for k, vs in per.items():
        known = [v for v in vs if v is not None]
        assert got[k] == (len(vs), Decimal(sum(known)) if known else None, max(known, default=None))
    assert len(got) == len(per)
    assert rounds(13, 2) == 4 and [rounds(p) for p in (1, 64, 4096, 4097, 800_000)] == [2, 2, 2, 3, 4]
    plan = tree_aggregate(df, ["k"], states(), splits=13, fan_in=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 4


def test_tree_edge_cases(spark):
    empty = spark.createDataFrame([], "k string, v bigint")
    assert tree_aggregate(empty, ["k"], states()).count() == 0
    odd = spark.createDataFrame([(None, 1, "x"), (None, None, "y"), ("", 2, "z"), ("", 2, "z")], "k string, v bigint, __node string")
    got = {r.k: (r.n, r.s, r.m) for r in tree_aggregate(odd, ["k"], states()).collect()}
    assert got == {None: (2, Decimal(1), 1), "": (2, Decimal(4), 2)}
    twice = odd.select("k", "v", F.lit(1).alias("same"), F.lit(2).alias("same"))
    assert tree_aggregate(twice, ["k"], states()).count() == 2


def test_sums_beyond_64_bits(spark):
    """Merged states as large as those of 2 ** 40 rows, and values of the whole unsigned range."""
    big = spark.createDataFrame([("a", Decimal(2**64 - 1)), ("a", Decimal(2**63)), ("b", Decimal(0)), ("b", None)], "k string, v decimal(20,0)")
    assert {r.k: r.s for r in tree_aggregate(big, ["k"], exact_sum("s", F.col("v"))).collect()} == {"a": Decimal(2**64 - 1 + 2**63), "b": Decimal(0)}
    merged = spark.createDataFrame([("a", Decimal(2**103))] * 3, "k string, s decimal(38,0)")
    state = exact_sum("s", F.col("s"))[0]
    assert merged.groupBy("k").agg(getattr(F, state.merge)("s").alias("s")).select(state.final).first().s == 3 * 2**103
    live = spark.createDataFrame([("t", 0, 5, Decimal(2**63), "x"), ("u", 0, 5, Decimal(2**64 - 1), "x")], "txid string, index_out bigint, height bigint, value decimal(20,0), address string")
    assert utxo.balances(live).first().balance == 2**63 + 2**64 - 1
    seen = views.view_balances(live.withColumn("unspent", F.lit(True))).first()
    assert seen.balance == (Decimal(2**63 + 2**64 - 1) * Decimal("0.00000001"))


def test_outputs_without_outpoint_and_coinbases(spark):
    o = spark.createDataFrame([("a", 0, 1, 0, 5, "x"), (None, 0, 1, 1, 6, "x"), (None, 0, 1, 2, 7, "x"), ("b", None, 1, 3, 8, "x")], "txid string, index_out bigint, height bigint, tx_index bigint, value bigint, address string")
    i = spark.createDataFrame([("0" * 64, 2**32 - 1, 2, 0), ("a", 0, 2, 1), ("a", 0, 2, 1), (None, 0, 3, 0)], "hash_prev_out string, index_prev_out bigint, height bigint, tx_index bigint")
    assert sorted(int(r.value) for r in utxo.utxo_set(o, i).collect()) == [6, 7, 8]


def test_hashes_as_bytes(spark):
    texts = ["AB" * 32, " 0x" + "ab" * 32 + "\n", "0" * 64, "0x" + "0" * 64, "junk", "", "  ", None, "x" * 64, "y" * 31, "é" * 31, "?" + "z" * 31, " " + "c" * 63]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("t", normalise.hash_of("t").alias("b"), normalise.real_hash_of("t").alias("r"), normalise.clean_hash("t").alias("c"), normalise.real_hash("t").alias("d")).withColumn("back", normalise.hash_text("b")).orderBy("k").collect()
    assert [r.back for r in rows] == [r.c or None for r in rows]
    assert [r.r is None for r in rows] == [not r.d for r in rows]
    assert {len(r.b) == 32 for r in rows if r.c and set(r.c) <= set("0123456789abcdef") and len(r.c) == 64} == {True}
    assert all(len(r.b) != 32 for r in rows if r.c in ("junk", "x" * 64, "y" * 31, "é" * 31, "?" + "z" * 31, "c" * 63))


def test_addresses(spark):
    cases = {" a ": "a", "\t\r\n a\n": "a", "BC1Q ": "bc1q", "Bc1q": "bc1q", "1BC1": "1BC1", "": None, " \n": None, None: None, "a b": "a b"}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", normalise.clean_address("a").alias("c")).collect()
    assert {r.a: r.c for r in rows} == cases


def test_broadcast_only_what_fits(spark):
    rows = Saved(spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("t")), "rows")
    assert fits(rows, 1 << 20) and not fits(rows, 150_000) and not fits(rows, 10_000)
    assert small_side(rows, 0).count() == small_side(rows).count() == 1000
    assert fits(Saved(spark.range(0), "none"), 0)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://head:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def keys(spark, rows):
    return spark.createDataFrame(rows, "p string, n bigint").select(F.col("p").cast("binary").alias("p"), "n")


def refs(spark, rows):
    return spark.createDataFrame(rows, "p string, n bigint, row_id bigint").select(F.col("p").cast("binary").alias("p"), "n", "row_id")


def test_runs(spark):
    far = 1 << orphans.BLOCK_BITS
    got = orphans.runs(keys(spark, [("a", n) for n in (1, 2, 3, 3, 7, far - 1, far, far + 1)] + [("b", 0), (None, 1), ("c", None)])).collect()
    assert sorted((bytes(r.p), r.first, r["last"]) for r in got) == [(b"a", 1, 3), (b"a", 7, 7), (b"a", far - 1, far - 1), (b"a", far, far + 1), (b"b", 0, 0)]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_orphans_against_brute_force(spark, limit):
    rng = random.Random(2)
    parents = [(f"h{rng.randrange(20)}", rng.choice([rng.randrange(9), (1 << 20) - 1, 1 << 20, -1])) for _ in range(150)]
    asked = [(rng.choice([None, "hot", f"h{rng.randrange(25)}"]), rng.choice([None, rng.randrange(10), 1 << 20]), i) for i in range(600)]
    got = sorted(r.row_id for r in orphans.orphans(keys(spark, parents), refs(spark, asked), ["row_id"], limit=limit).collect())
    assert got == sorted(i for p, n, i in asked if p is not None and (n is None or (p, n) not in set(parents)))


def test_orphans_empty(spark):
    none = spark.createDataFrame([], "p binary, n bigint, row_id bigint")
    assert orphans.orphans(keys(spark, [("a", 1)]), none, ["row_id"]).count() == 0
    some = refs(spark, [("a", 1, 5), ("a", 1, 6), (None, 1, 7)])
    assert sorted(r.row_id for r in orphans.orphans(none.select("p", "n"), some, ["row_id"]).collect()) == [5, 6]


def test_hash_keys(spark):
    df = spark.createDataFrame([("ab" * 32, 1), ("junk", 2), (None, 3), ("", 4)], "x string, h int")
    got = {r.h: (r.p and bytes(r.p), r.n) for r in orphans.hash_key(df, normalise.hash_bytes("x"), F.col("h")).collect()}
    assert got == {1: (b"\xab" * 26, 0xABABABABABAB), 2: (b"?junk", -1), 3: (None, -1), 4: (None, -1)}


# Unspent outputs.
trace = st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=3), st.lists(st.tuples(st.integers(0, 5), st.booleans()), max_size=3, unique_by=lambda x: x[0])), min_size=1, max_size=12)


@slow
@given(trace)
def test_utxo_against_a_scan(spark, txs):
    live, outs, ins = {}, [], []
    for seq, (spends, makes) in enumerate(txs):
        height, index = divmod(seq, 3)
        for k in spends:
            live.pop(k, None)
            ins.append((f"t{k}", 0, height, index))
        for k, addressed in makes:
            outs.append((f"t{k}", 0, height, index, seq * 10, "a" if addressed else None))
            if addressed:
                live[k] = (height, seq * 10)
    o = spark.createDataFrame(outs, "txid string, index_out bigint, height bigint, tx_index bigint, value bigint, address string")
    i = spark.createDataFrame(ins, "hash_prev_out string, index_prev_out bigint, height bigint, tx_index bigint")
    got = utxo.utxo_set(o, i)
    assert {int(r.txid[1:]): (r.height, int(r.value)) for r in got.collect()} == live
    total = sum(v for _, v in live.values())
    assert sum(int(r.balance) for r in utxo.balances(got).collect()) == total


def test_mark_spent_and_views(spark):
    o = spark.createDataFrame([("a", 0, 150_000_000, "x"), ("a", 1, 5, "x"), ("b", 0, 7, ""), ("c", 0, None, None)], "txid string, index_out bigint, value bigint, address string")
    i = spark.createDataFrame([("a", 1), ("a", 1), ("zz", 0), (None, None)], "hash_prev_out string, index_prev_out bigint")
    marked = utxo.mark_spent(o, i)
    assert {(r.txid, r.index_out): r.unspent for r in marked.collect()} == {("a", 0): True, ("a", 1): False, ("b", 0): True, ("c", 0): True}
    rows = [(r.address, r.balance) for r in views.view_balances(marked).collect()]
    assert rows[0] == ("x", Decimal("1.5")) and ("", Decimal("0.00000007")) in rows and (None, None) in rows


# Heights.
def chain(spark, links):
    return spark.createDataFrame([(b, p, h, 0) for b, p, h in links], "block_hash string, hash_prev string, height bigint, n_time bigint")


def test_heights_from_links(spark):
    links = [(f"b{i:03}", f"b{i - 1:03}" if i else "0", None) for i in range(40)] + [("fork1", "b010", None), ("fork2", "fork1", None), ("alone", "nowhere", None)]
    got = {r.block_hash: r.height for r in heights.with_heights(chain(spark, links)).collect()}
    assert got == {f"b{i:03}": i for i in range(40)}
    assert heights.with_heights(chain(spark, [])).count() == 0
    with pytest.raises(ValueError):
        heights.with_heights(chain(spark, [("a", "b", None), ("b", "a", None)]), max_rounds=5)


def test_ranges_and_gaps(spark):
    df = chain(spark, [(f"b{h}", "", h) for h in (0, 1, 2, 2, 3, 5, 6)])
    assert heights.in_range(df, 1, 3).count() == 4 and heights.in_range(df, 1, None, half_open=True).count() == 5 and heights.in_range(df, 0, 2, half_open=True).count() == 2
    assert sorted(r.height for r in heights.until_gap(df).collect()) == [0, 1, 2, 2, 3]
    assert heights.until_gap(df, 4).count() == 0
    assert heights.in_range(df.limit(0), 0, None, half_open=True).count() == 0
    assert heights.check_range(5, 5) == (5, 5) and heights.show_range(0) == "0..HEAD"
    for bad in ((2, 1), (-1, None)):
        with pytest.raises(ValueError):
            heights.check_range(*bad)


def test_index_rules(spark):
    df = spark.createDataFrame([(1, 4, "a", 0), (1, 8, "b", 1), (2, 3, "c", 1), (3, 13, "d", 1)], "height bigint, status bigint, k string, blk_index bigint")
    use = heights.usable(df)
    assert sorted(r.k for r in use.collect()) == ["a", "b", "d"]
    assert sorted(r.k for r in heights.last_by_height(use, "k").collect()) == ["b", "d"]
    assert {r.blk_index: r.max_height for r in heights.max_height_by_file(use).collect()} == {0: 1, 1: 3}


def test_violations(spark):
    df = chain(spark, [("a", "0", 0), ("b", "a", 1), ("c", "x", 2)])
    assert [(r.height, r.expected, r.found) for r in verify.link_violations(df).collect()] == [(2, "b", "x")]
    assert verify.genesis_violations(df, "a").count() == 0 and verify.genesis_violations(df, "z").count() == 1


def test_statistics_of_three_blocks(spark):
    zero = "0" * 64
    b = spark.createDataFrame([("A", 0, 1000, 100), ("B", 1, 400, 3000), ("C", 2, 2000, None)], "block_hash string, height bigint, n_time bigint, blocksize bigint").withColumn("c", F.lit(1))
    t = spark.createDataFrame([("t0", 0, 0), ("t1", 1, 0), ("t2", 1, 1)], "txid string, height bigint, tx_index bigint").withColumn("c", F.lit(1))
    i = spark.createDataFrame([("t0", zero, 4294967295, b"ab"), ("t1", zero, 4294967295, b""), ("t2", "t0", 0, b"x" * 300)], "txid string, hash_prev_out string, index_prev_out bigint, script_sig binary").withColumn("c", F.lit(1))
    o = spark.createDataFrame([("t0", 0, 0, 0, 5000000007, b"y", "P"), ("t1", 0, 1, 0, 1, None, "P"), ("t2", 0, 1, 1, 5000000007, b"", "Q")], "txid string, index_out bigint, height bigint, tx_index bigint, value bigint, script_pubkey binary, pattern string").withColumn("c", F.lit(1))
    total = stats.totals(b, t, i, o, ["c"])
    assert tuple(total.first())[1:] == (3, 3, 3, 3, Decimal(10000000015))
    assert stats.ratios(total, ["c"]).first().txs_per_block == 1.0
    assert stats.fees(i, o, ["c"]).first().total_fee == 7
    sizes = stats.tx_sizes(t, i, o, ["c"])
    assert {r.txid: r.stripped_size for r in sizes.collect()} == {"t0": 8 + 1 + 43 + 1 + 10, "t1": 8 + 1 + 41 + 1 + 9, "t2": 8 + 1 + 40 + 303 + 1 + 9}
    assert tuple(stats.biggest(sizes, "total_value", ["c"]).first())[1:] == (Decimal(5000000007), 0, "t0")
    assert tuple(stats.biggest(sizes, "stripped_size", ["c"]).first())[1:] == (362, 1, "t2")
    nothing = stats.biggest(sizes.withColumn("total_value", F.lit(0)), "total_value", ["c"]).first()
    assert tuple(nothing)[1:] == (0, 0, zero)
    assert {r.pattern: (r.n, float(r.percent), r.height, r.txid) for r in stats.script_types(o, ["c"]).collect()} == {"P": (2, 66.67, 0, "t0"), "Q": (1, 33.33, 1, "t2")}
    assert {r.height: r.seconds for r in stats.intervals(b, ["c"]).collect()} == {1: 0, 2: 1600}
    m = stats.block_means(b, ["c"]).first()
    assert m.mean_kib == 1550 / 1024 and m.mean_minutes == 800 / 60
    assert Counter(r.txid for r in stats.coinbase_txids(i, ["c"]).collect()) == Counter(["t0", "t1"])
