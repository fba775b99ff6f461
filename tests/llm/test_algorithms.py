import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.llm import components, distinct_runs, percentiles
from chainloom.llm.components import group_members
from chainloom.llm.distinct_runs import decode_runs, encode_runs, kway_union, load_states, merge_counts, refined, run_states, save_states
from chainloom.llm.percentiles import float_key, key_float, leading, radix_select, radix_state

slow = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# Problem 1.
@given(st.lists(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=30), max_size=6))
def test_runs_round_trip(sets):
    runs = [np.array(sorted(s), np.int64) for s in sets]
    counts = np.array([len(r) for r in runs], np.int64)
    starts = np.cumsum(counts) - counts
    data, ends = encode_runs(np.concatenate([*runs, np.zeros(0, np.int64)]), starts)
    assert len(ends) == len(runs) and (not len(ends) or ends[-1] == len(data))
    assert decode_runs(data, counts).tolist() == [v for r in runs for v in r.tolist()]


def brute(rows, dims, sets):
    out = {}
    for chosen in sets:
        groups = defaultdict(set)
        for r in rows:
            if r[-1] is not None:
                groups[tuple(r[k] if d in chosen else None for k, d in enumerate(dims)) + tuple(int(d not in chosen) for d in dims)].add(r[-1])
        out |= {k: len(v) for k, v in groups.items()}
    return out


def test_counts_of_all_groupings(spark, monkeypatch):
    monkeypatch.setattr(distinct_runs, "BUCKET_HASHES", 40)
    monkeypatch.setattr(distinct_runs, "RUN", 7)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", ""]), rng.choice([None, "hot", f"x{rng.randrange(150)}"])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "day int, coin string, who string").withColumn("bucket", F.lit("clash")).withColumn("__h", F.lit(1))
    sets = [[], ["day"], ["coin"], ["day", "coin"]]
    got = merge_counts(run_states(df, ["day", "coin"], "who"), ["day", "coin"], sets).collect()
    assert {(r.day, r.coin, r.day_all, r.coin_all): r.n_distinct for r in got} == brute(rows, ["day", "coin"], sets)
    assert all(r.collision_bound == r.n_distinct * (r.n_distinct - 1) / 2**65 for r in got)


@given(st.lists(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=30), min_size=1, max_size=6))
def test_union_of_runs(sets):
    assert kway_union([np.array(sorted(s), np.int64) for s in sets]).tolist() == sorted(set().union(*sets))


def test_states_of_days_merge(spark, monkeypatch, tmp_path):
    """States of very unlike size, built and saved apart: the small one takes the buckets of the large one, and nothing counts twice."""
    monkeypatch.setattr(distinct_runs, "BUCKET_HASHES", 16)
    monkeypatch.setattr(distinct_runs, "RUN", 9)
    rows = [(1, f"x{i}") for i in range(5)] + [(2, f"x{i}") for i in range(600)] + [(3, f"x{i}") for i in range(550, 640)] + [(None, "x1")]
    day = lambda d: spark.createDataFrame([r for r in rows if r[0] == d], "day int, who string")
    parts = [run_states(day(d), ["day"], "who") for d in (1, 2, 3, None)]
    bits = [p.first().bits for p in parts]
    assert bits[0] == 1 < bits[2] < bits[1]
    for k, p in enumerate(parts):
        save_states(p, str(tmp_path / str(k)))
    whole = load_states(spark, *[str(tmp_path / str(k)) for k in (0, 1, 2, 3, 2)])
    fine = refined(whole)
    assert {r.bits for r in fine.select("bits").distinct().collect()} == {bits[1]}
    assert fine.agg(F.sum("n")).first()[0] == whole.agg(F.sum("n")).first()[0]
    got = {(r.day, r.day_all): r.n_distinct for r in merge_counts(whole, ["day"], [[], ["day"]]).collect()}
    assert got == {(None, 1): 640, (1, 0): 5, (2, 0): 600, (3, 0): 90, (None, 0): 1}


def test_no_identifiers(spark):
    df = spark.createDataFrame([], "day int, who string")
    assert merge_counts(run_states(df, ["day"], "who"), ["day"], [[], ["day"]]).count() == 0
    nulls = spark.createDataFrame([(1, None)], "day int, who string")
    assert run_states(nulls, ["day"], "who").count() == 0 and refined(run_states(nulls, ["day"], "who")).count() == 0


# Problem 3.
def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in up}


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=70))
def test_decomposition_in_memory(edges):
    v, root = components.decompose(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    assert dict(zip(v.tolist(), root.tolist())) == union_find(edges)


def test_decomposition_of_a_long_path():
    a = np.random.default_rng(1).permutation(20_000)
    v, root = components.decompose(a[:-1], a[1:])
    assert len(v) == 20_000 and set(root.tolist()) == {0}


@slow
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=70), st.sampled_from([0, 3, 1000]))
def test_components_against_union_find(spark, edges, task_edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.v: r.root for r in components.components(df, task_edges).collect()}
    want = union_find(edges)
    assert set(got) == set(want)
    assert len({(got[v], want[v]) for v in got}) == len(set(got.values())) == len(set(want.values()))


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(None, 1), (2, None), (5000, 5000), (1, 2)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), 100).collect()}
    assert len(got) == 301 + 400 + 1 and len(set(got.values())) == 3
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(400)}) == 1


def test_group_members(spark):
    rows = [("t1", "b"), ("t1", "a"), ("t1", "a"), ("t2", "b"), ("t2", "c"), ("t3", "z"), (None, "q"), (None, "r"), ("t4", None), ("t4", "z"), ("t5", "Y"), ("t5", "y")]
    df = spark.createDataFrame(rows, "e string, m string").withColumn("root", F.lit(0)).withColumn("hub", F.lit(0))
    assert {r.m: r.first for r in group_members(df, "e", "m").select("m", F.col("first")).collect()} == {"a": "a", "b": "a", "c": "a", "Y": "Y", "y": "Y"}
    assert group_members(df.limit(0), "e", "m").count() == 0


# Problem 4.
def rank(values, q):
    values = sorted(values)
    return values[max(1, math.ceil(q * len(values))) - 1]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_radix_select(spark, limit):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 0, 0, -1, 2**63 - 1, -(2**63), rng.randrange(10**12), rng.randrange(70000)])) for _ in range(900)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v bigint").withColumn("__key", F.lit("clash")).withColumn("x", F.lit(1))
    qs = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): (r.n, r.value) for r in radix_select(df, ["g"], "v", qs, limit=limit).collect()}
    per = defaultdict(list)
    for g, v in rows:
        if v is not None:
            per[g].append(v)
    assert got == {(g, q): (len(vs), rank(vs, q)) for g, vs in per.items() for q in qs}


def test_radix_edge_cases(spark):
    assert radix_select(spark.createDataFrame([], "g string, v bigint"), ["g"], "v", [0.5]).count() == 0
    same = spark.createDataFrame([("a", 7)] * 50, "g string, v bigint")
    assert [r.value for r in radix_select(same, ["g"], "v", [0.5, 0.99]).collect()] == [7, 7]


def test_states_are_mergeable_within_the_bound(spark):
    rng = random.Random(5)
    rows = [(d, int(10 ** rng.uniform(0, 15))) for d in range(5) for _ in range(200)] + [(0, 0), (1, -123456789), (2, None)]
    df = spark.createDataFrame(rows, "d int, v bigint")
    whole = None
    for d in range(5):
        part = radix_state(df.where(F.col("d") == d), ["d"], "v")
        whole = part if whole is None else whole.unionByName(part)
    got = radix_select(whole.withColumn("all", F.lit(1)), ["all"], "key", [0.0, 0.1, 0.5, 0.9, 1.0], weight="weight").collect()
    values = [v for _, v in rows if v is not None]
    for r in got:
        exact = rank(values, r.q)
        assert r.n == len(values) and abs(exact) - abs(r.value) <= abs(exact) * 2**-percentiles.STATE_BITS and abs(r.value) <= abs(exact)
    assert [r[0] for r in spark.createDataFrame([(2**63 - 1,), (5000,), (12345,)], "v bigint").select(leading(F.col("v"), 2)).collect()] == [7 * 2**60, 4096, 12288]


def test_floating_values(spark):
    values = [0.0, -0.0, 1.5, -1.5, float("inf"), float("-inf"), 1e-300, -1e300, 3.14, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_key("v").alias("k"))
    rows = df.select("v", "k", key_float("k").alias("back")).collect()
    known = sorted([r for r in rows if r.v is not None and r.v == r.v], key=lambda r: r.k)
    assert [r.v for r in known] == sorted(r.v for r in known) and all(r.back == r.v for r in known)
    picked = radix_select(df.where("v = v OR v IS NULL"), [], "k", [0.5])
    assert picked.select(key_float("value").alias("m")).first().m == rank([v for v in values if v is not None and v == v], 0.5)
