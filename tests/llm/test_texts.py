import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chainloom.llm import language, mixing, queries, tokens
from chainloom.llm.mixing import mix
from chainloom.llm.tokens import decode, encode, token_counts

TEXTS = [
    None, "", " ", "\n\n", "a", "Hello  world\n\n  we're   HERE'S it's'll", "x" * 3000, "数字 １２３ テスト。", "tab\t  　end \u0085 ", "\u001c\u001d odd", "<|endoftext|> ordinary",
    "👩‍👩‍👧 é � ﻿", "'S 'll 'LL don''t", "1234 5,6.7 ½ ٣", "Повторение  текста\r\n\r\n", "word " * 4000, "a", "a", "​‌ zero", "_under_score__ a_b", "\x00\x01 control",
]


@pytest.fixture(scope="module")
def reference():
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def corpus(spark, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return df.withColumn("chunk", F.lit("clash")).withColumn("word", F.lit(1)).withColumn("ids", F.lit(None).cast("string"))


@pytest.mark.parametrize("size", [1_000_000, 50])
def test_encoding_equals_the_tokenizer(spark, reference, monkeypatch, size):
    monkeypatch.setattr(tokens, "CHUNK_WORDS", size)
    got = encode(corpus(spark).repartition(3))
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert rows == {i: reference(t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in token_counts(corpus(spark)).collect()} == {i: len(x) for i, x in rows.items()}
    assert {r.doc_id: r.text for r in decode(got).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_random_texts(spark, reference):
    rng = random.Random(6)
    signs = "ab Z9'\n\t .,é中 ß'sñ½_-"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(300)]
    assert {r.doc_id: r.ids for r in encode(corpus(spark, texts)).collect()} == {i: reference(t) for i, t in enumerate(texts)}


def test_no_documents_and_repeated_keys(spark):
    assert encode(corpus(spark).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "c")], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in encode(odd).collect()) == ["1", "1", "None"]
    assert [r.text for r in decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).collect()] == [""]


# Mixing.
def sizes_of(rows):
    out = {}
    for d, s, n in rows:
        out.setdefault(s, []).append((d, n))
    return out


def check_mix(rows, targets, records, total):
    """Weighted fair queueing done plainly on what the operator says: order, running totals and caps."""
    share, cap = {s: w for s, w, _ in targets}, {s: c for s, _, c in targets}
    line, end, used = {}, 0, {}
    for r in sorted(records, key=lambda r: r.end_token):
        line[r.source] = line.get(r.source, 0) + r.n_tokens
        end += r.n_tokens
        assert r.end_token == end <= total
        assert r.finish == pytest.approx(line[r.source] / share[r.source])
        used[(r.doc_id, r.source)] = used.get((r.doc_id, r.source), 0) + 1
    assert all(n <= cap[s] for (_, s), n in used.items())
    finish = [r.finish for r in sorted(records, key=lambda r: r.end_token)]
    assert finish == sorted(finish)


def build(spark, rows, targets):
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("pass", F.lit("clash"))
    return sizes, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_are_reached(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 25)
    rng = random.Random(7)
    rows = [(i, rng.choice(["big"] * 6 + ["mid", "mid", "tiny"]), rng.randrange(0, 40)) for i in range(2000)] + [(9000, None, 5), (9001, "unlisted", 5)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), (" TINY", 0.1, 3), ("absent", 0.1, 5)]
    records, shares = mix(*build(spark, rows, targets))
    records, shares = records.collect(), {r.source: r for r in shares.collect()}
    per = {s: sum(n for _, n in v) for s, v in sizes_of(rows).items()}
    total = int(min(per["big"] / 0.5, 2 * per["mid"] / 0.3, 3 * per["tiny"] / 0.1) * 0.9)
    check_mix(rows, [(s.strip().lower(), w, c) for s, w, c in targets], records, total)
    assert sum(r.n_tokens for r in records) > total - 3 * 40
    for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert shares[s].actual_share == pytest.approx(w / 0.9, abs=0.02)
    assert shares["absent"].n_records == 0 and shares["absent"].actual_share == 0
    assert {r.doc_id for r in records}.isdisjoint({9000, 9001}) and all(r.n_tokens > 0 for r in records)


def test_larger_budget_uses_small_sources_up(spark):
    rows = [(i, "a", 10) for i in range(100)] + [(500 + i, "b", 10) for i in range(5)]
    targets = [("a", 0.5, 1), ("b", 0.5, 2)]
    records, shares = mix(*build(spark, rows, targets), budget=600)
    got = {r.source: r.taken for r in shares.collect()}
    assert got == {"a": 500, "b": 100}
    check_mix(rows, targets, records.collect(), 600)
    everything = mix(*build(spark, rows, targets), budget=10**9)[1]
    assert {r.source: r.taken for r in everything.collect()} == {"a": 1000, "b": 100}


def test_mixing_edge_cases(spark):
    rows, targets = [(1, "a", 3), (2, "a", 3)], [("a", None, 1), ("a", 0.5, None), (None, 0.5, 1), ("b", -1.0, 1)]
    sizes, wanted = build(spark, rows, targets)
    records, shares = mix(sizes, wanted)
    assert records.count() == 2 and {r.source: r.taken for r in shares.collect()} == {"a": 6, "b": 0}
    assert mix(sizes.limit(0), wanted)[0].count() == 0 and mix(sizes, wanted.limit(0))[0].count() == 0
    assert mix(sizes, wanted.where("source = 'b'"))[0].count() == 0


def test_mixture_of_null_and_repeated_ids(spark, tmp_path):
    ids = [None, None, 1, 1, 1, 2, 3]
    docs = spark.createDataFrame([(i, f"text number {k} of the source", " A " if k % 2 else "a") for k, i in enumerate(ids)], "doc_id bigint, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = Counter((r.doc_id, r["pass"]) for r in queries.p7_mix(spark, str(tmp_path)).collect())
    assert got == Counter((i, p) for i in ids for p in (1, 2))
    shares = queries.p7_shares(spark, str(tmp_path)).collect()
    assert [(r.n_docs, r.n_records, r.actual_share) for r in shares] == [(7, 14, 1.0)]


# Languages.
EN = "The {} is connected to the {} so that no operator has to enter the danger zone."
DE = "Der {} ist mit dem {} verbunden, sodass niemand den Gefahrenbereich betreten muss."
ES = "El {} comunica con el {} de modo que nadie tiene que entrar en la zona de peligro."
JA = "安全上の理由から、{}は圧力センサと一体に形成され、{}に緩く当接するものである。"
WORDS = {"en": ["guide rail", "valve body", "drive shaft", "support frame"], "de": ["Dichtring", "Sperrstift", "Drucksensor", "Ventilkörper"], "es": ["cartucho", "pasador", "resorte", "bastidor"], "ja": ["弁本体", "案内レール", "混合室", "駆動軸"]}
FORMS = {"en": EN, "de": DE, "es": ES, "ja": JA}
NAMES = [("en", "eng", "English"), ("de", "deu", "German"), ("es", "spa", "Spanish"), ("ja", "jpn", "Japanese"), ("fi", "fin", "Finnish")]


def sentence(code, rng):
    return FORMS[code].format(*rng.sample(WORDS[code], 2))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        code = rng.choice(list(FORMS))
        label = rng.choice(["fi", "en", "de"]) if i % 10 == 0 else rng.choice([code, code.upper() + "-XA", dict((n[0], n[2]) for n in NAMES)[code]])
        rows.append((i, " ".join(sentence(code, rng) for _ in range(4)), label))
    names = spark.createDataFrame(NAMES, "code string, code3 string, english_name string")
    docs = language.label_codes(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), names)
    return names, language.train(docs)


def test_labels(spark, trained):
    labels = ["EN", " eng ", "english", "en_US", "de-AT", "xx", None, "", "-", "Finnish", "jpn-x"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, lang string").withColumn("label_code", F.lit("old"))
    got = {r.i: r.label_code for r in language.label_codes(df, trained[0]).collect()}
    assert [got[i] for i in range(len(labels))] == ["en", "en", "en", "en", "de", None, None, None, None, "fi", "ja"]


def test_languages_that_are_only_wrong_labels_drop_out(trained):
    assert trained[1].langs == ["de", "en", "es", "ja"]


def cases():
    rng = random.Random(9)
    s = lambda c: sentence(c, rng)
    garbled = s("de").replace("Ventilkörper", "Sperrstift").replace("Der", "Für die Größe der Maschine gilt: der").encode().decode("latin-1")
    return [
        (s("en"), "en", []),
        (s("en"), "de", ["en"]),
        (s("en") + " " + s("de"), "en", ["de"]),
        (s("ja") + s("ja") + "\n\n" + s("es"), None, ["es", "ja"]),
        ("El pasador de bloqueo\n\n" + s("en"), "en", []),
        (s("en") + " El cartucho comunica.", "en", []),
        (s("en") + " " + s("de")[:60], "en", []),
        ("The El {} cartucho is connected to the drive shaft so that no operator has to enter the zone.", "en", []),
        (garbled, "en", ["de"]),
        ("<p>" + s("es") + "</p>", "en", ["es"]),
        (None, "en", []),
        ("", None, []),
        ("F = k7 × Δx ± 37 %\n\n$$\\frac{x}{y}$$", None, []),
        (s("es") * 3000, "es", []),
    ]


def test_found(spark, trained):
    rows = [(i, t, lang) for i, (t, lang, _) in enumerate(cases())]
    docs = language.label_codes(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), trained[0])
    got = {}
    for r in language.found(docs, trained[1]).collect():
        got.setdefault(r.doc_id, []).append(r.lang)
    assert {i: sorted(v) for i, v in got.items()} == {i: want for i, (_, _, want) in enumerate(cases()) if want}


def test_segments_and_documents(spark, trained):
    rng = random.Random(10)
    a, b, c = sentence("en", rng), sentence("en", rng), sentence("de", rng)
    text = f"(1) {a} {b}\n\n{c}"
    docs = spark.createDataFrame([(1, text, "en"), (2, None, None), (3, "", "de"), (4, sentence("ja", rng), None)], "doc_id bigint, text string, lang string")
    docs = language.label_codes(docs, trained[0])
    parts = sorted(language.segments(docs, trained[1]).collect(), key=lambda r: (r.doc_id, r.segment))
    assert [(r.doc_id, r.lang) for r in parts] == [(1, "en"), (1, "de"), (4, "ja")]
    assert text[parts[0].first_char : parts[0].last_char].strip() == f"(1) {a} {b}" and text[parts[1].first_char : parts[1].last_char].strip() == c
    assert all(0.5 < r.confidence <= 1 for r in parts)
    whole = {r.doc_id: r for r in language.documents(docs, trained[1]).collect()}
    assert {i: r.lang for i, r in whole.items()} == {1: "en", 2: None, 3: None, 4: "ja"}
    assert whole[2].confidence == 0 and 0.5 < whole[1].share < 0.8 and whole[1].label_code == "en"


def test_held_out_accuracy(trained):
    rng = random.Random(11)
    rows = [(c, language.letters(sentence(c, rng))) for c in rng.choices(list(FORMS), k=400)]
    which, sure = trained[1].name([w for _, w in rows])
    assert sum(k >= 0 and trained[1].langs[k] == c for k, (c, _) in zip(which, rows)) >= 396
    assert sure.min() > 0.5


def test_fitting_reads_a_bounded_number_of_files(spark, trained, monkeypatch, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join(sentence(c, rng) for _ in range(3)), c) for i, c in enumerate(rng.choices(list(FORMS), k=120))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    trained[0].write.parquet(f"{tmp_path}/lang_names.parquet")
    docs = queries._labelled(spark, str(tmp_path))
    names = sorted(r[0] for r in docs.select(language.FILE).distinct().collect())
    assert len(names) > 2
    monkeypatch.setattr(language, "FIT_FILES", 2)
    assert language.train(docs).langs == sorted(FORMS)
    plan = docs.where(F.col(language.FILE).isin(names[:2])).select("text")
    assert plan.rdd.getNumPartitions() <= 2 and 0 < plan.count() < 120
    assert {(r.doc_id, r.lang) for r in language.found(docs, language.train(docs)).collect()} == set()


def test_nothing_to_learn(spark, trained):
    docs = language.label_codes(spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id bigint, text string, lang string"), trained[0])
    model = language.train(docs)
    assert model.langs == [] and language.found(docs, model).count() == 0
    assert language.documents(docs, model).where("lang IS NOT NULL").count() == 0 and language.segments(docs, model).count() == 0
