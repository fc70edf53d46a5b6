"""Table operators on small fixtures: results, nulls, ties, repeated rows, clashing names, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import consensus, heavy, increment, lookalike, mixture, mojibake, packing, passages, quality, queries, variants


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_heavy_hitters(spark):
    data = [("a", "x")] * 60 + [("b", None)] * 30 + [("a", f"v{i}") for i in range(10)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "type string, value string, count int, _h int")
    assert rows(heavy.heavy_hitters(df, ["type", "value"], one_in=10, exact=True).select("type", "value", "count")) == [("a", "x", 60), ("b", None, 30)]
    assert heavy.heavy_hitters(df.limit(0), ["type", "value"]).count() == 0
    tight = heavy.heavy_hitters(df, ["type", "value"], one_in=10, width=2, depth=1, heap=2, exact=True)
    assert rows(tight.select("type", "value")) == [("a", "x"), ("b", None)]


FINDINGS = [
    (1, "url", "http://a.test/x?b=1&c=2"),
    (2, " URL ", "hxxp://A[.]test/x?c=2&b=1"),
    (3, "url", "http://a.test/x?b=2&c=1"),
    (4, "hash_md5", "aa:bb:cc"),
    (5, "hash_md5", "AABB CC"),
    (6, "domain", "ab.cd"),
    (7, "domain", "abc.d"),
    (8, "domain", "äb.cd"),
    (9, None, "ab.cd"),
    (10, "domain", None),
    (11, "scheduled_task", "/TN a /TR C:\\x.exe"),
    (12, "scheduled_task", '</tr "C:/x.exe"  /tn "A">'),
    (13, "domain", "ab.cd"),
    (14, "domain", ""),
    (15, "mutex", "x" * 100_000),
]


def test_variants(spark):
    df = spark.createDataFrame([(*r, "k", 1) for r in FINDINGS], "id long, type string, value string, key string, _h int")
    assert rows(variants.copies(df)) == [(1, 2), (11, 12), (4, 5)]
    got = {r["rep_id"]: r["copies"] for r in variants.collapse(df).collect()}
    assert got[1] == 2 and got[3] == 1 and got[6] == 2 and got[7] == 1 and 8 not in got and got[14] == 1 and sum(got.values()) == 12
    assert variants.copies(df.limit(0)).count() == 0 and variants.collapse(df.limit(0)).count() == 0


def test_variants_without_id_count_as_writings(spark):
    df = spark.createDataFrame([(1, "ip", "10.0.0.1"), (2, "ip", "10.0.0.1"), (None, "ip", "10[.]0[.]0[.]1"), (None, "url", "x"), (None, "url", "X")], "id long, type string, value string")
    assert rows(variants.copies(df)) == [(1, 2)]


def test_variants_hot_key(spark):
    df = spark.range(6000).selectExpr("id", "'ip' AS type", "CASE WHEN id % 3 = 0 THEN '10.0.0.1' WHEN id = 1 THEN '10[.]0[.]0[.]1' ELSE concat('10.0.', id, '.7') END AS value")
    assert variants.copies(df).count() == 2000


def test_consensus_finds_the_inverter(spark):
    rng = random.Random(2)
    truth = {i: rng.choice(consensus.CLASSES) for i in range(400)}
    flip = {"malicious": "clean", "clean": "malicious", "suspicious": "suspicious"}
    edges = []
    for i, t in truth.items():
        for s, p in (("good", 0.95), ("fair", 0.8), ("okay", 0.8), ("coin", 0.34)):
            edges.append((i, s, t if rng.random() < p else rng.choice(consensus.CLASSES)))
        edges.append((i, "inverted", flip[t] if rng.random() < 0.95 else t))
    df = spark.createDataFrame([(i, s, f" {v.upper()} ") for i, s, v in edges] + [(1, "good", "unknown"), (None, "good", "clean"), (2, None, "clean"), (3, "good", None)], "finding_id long, source string, verdict string")
    items, annotators = consensus.consensus(consensus.opinions(df.unionByName(df)))
    got = {r["item"]: r for r in items.collect()}
    assert sum(got[i]["verdict"] == t for i, t in truth.items()) > 0.95 * len(truth)
    assert all(0 <= r["agreement"] <= 1 and r["opinions"] == 5 for r in got.values())
    rel = {r["annotator"]: r["reliability"] for r in annotators.collect()}
    assert rel["good"] > rel["coin"] > rel["inverted"]
    items, annotators = consensus.consensus(consensus.opinions(df.limit(0)))
    assert items.count() == 0 and annotators.count() == 0


def brute_duplicates(docs):
    accepted, out = [], set()
    for i, _, t in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[1], d[0])):
        w = (t or "").lower().split()
        s = set(zip(w, w[1:], w[2:]))
        hit = next((a for a, b in accepted if s and len(s & b) >= 0.7 * len(s | b)), None)
        if hit is None:
            accepted.append((i, s))
        else:
            out.add((i, hit))
    return out


def test_increment(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for n in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 20, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 15))):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [words[k], rng.choice(vocab)]]) or words[k : k + 1]
            docs.append((" ".join(words)))
    rng.shuffle(docs)
    table = [(i, float(rng.randrange(6)), t) for i, t in enumerate(docs)]
    table += [(1001, 0.0, None), (1002, 1.0, ""), (1003, 1.0, "a b"), (1004, 2.0, "a b"), (1005, None, docs[0])]
    df = spark.createDataFrame(table, "id long, at double, text string")
    assert set(map(tuple, increment.deduplicate(df, (0.3, 0.6)).collect())) == brute_duplicates(table)
    assert increment.deduplicate(df.limit(0)).count() == 0


def test_store_outgrows_its_parts_and_is_opened_again(spark, tmp_path):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(50)) for _ in range(30)]
    docs = [(i, float(i // 20), (base[rng.randrange(30)] + f" end{i}") if i % 2 else " ".join(rng.choice(vocab) for _ in range(40))) for i in range(80)]
    df = spark.createDataFrame(docs, "id long, at double, text string")
    found = set()
    for day in range(4):
        store = increment.FingerprintStore(spark, f"file://{tmp_path}/store", part=64)
        found |= set(map(tuple, increment.ingest(df.where(f"at = {day}"), store).collect()))
    assert store.parts > 1 and store.generation > 0 and found == brute_duplicates(docs)
    with pytest.raises(ValueError):
        increment.ingest(df.where("at = 1"), store)
    assert increment.ingest(df.limit(0), store).count() == 0


def test_increment_hot_boilerplate(spark):
    """A run of words that very many short texts share doesn't pair them all."""
    docs = [(i, float(i), f"all rights reserved by us q{i} r{i * 7} s{i * 3} t{i} u{i * 5}") for i in range(3000)] + [(5000, 5000.0, docs0) for docs0 in ["all rights reserved by us q7 r49 s21 t7 u35 v"]]
    df = spark.createDataFrame(docs, "id long, at double, text string")
    assert set(map(tuple, increment.deduplicate(df, (0.5,)).collect())) == {(5000, 7)}


def test_consensus_by_joins_is_the_same(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(i, s, rng.choice(consensus.CLASSES)) for i in range(200) for s in "abcdef" if rng.random() < 0.7], "item long, annotator string, label string")
    a, b = (sorted((r["item"], r["verdict"], r["opinions"], round(r["agreement"], 9), round(r["confidence"], 6)) for r in consensus.consensus(edges, few=n)[0].collect()) for n in (100, 1))
    assert a == b and len(a) > 190


def test_passages(spark):
    rng = random.Random(6)

    def text(n):
        return "".join(rng.choice("abcdefghij \n") for _ in range(n))

    s200, s199, s230 = text(200), text(199), text(230)
    data = [
        (1, text(50) + s200 + text(70), None),
        (2, text(10), text(333) + s200),
        (3, s199 + text(400), text(5)),
        (4, text(90) + s199, ""),
        (5, text(300), s230 + text(20)),
        (6, "é" + s230, text(100)),
        (7, text(400) + text(10), text(250)),
        (None, s200, s200),
    ]
    same = text(500)
    data += [(8, same, same)]
    df = spark.createDataFrame([(*r, 0, "t") for r in data], "id long, o string, d string, start int, text string")
    assert rows(passages.shared_fields(df, "id", ["o", "d"])) == [(1, "o"), (2, "d"), (5, "d"), (6, "o")]
    amounts = {(r[0], r[1]): r for r in passages.shared_amount(df.where("id is not null"), "id", ["o", "d"]).collect()}
    assert len(amounts) == 16 and amounts[8, "o"]["shared_chars"] == 0
    assert amounts[5, "d"]["shared_chars"] == 230 and amounts[1, "o"]["shared_chars"] == 200
    assert passages.shared_fields(df.limit(0), "id", ["o", "d"]).count() == 0


def test_passages_hot(spark):
    hot = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(150))
    df = spark.range(300).selectExpr("id", f"concat(repeat(sha2(cast(id AS string), 256), 5), CASE WHEN id % 3 = 0 THEN '{hot}' ELSE '' END) AS o")
    assert passages.shared_fields(df, "id", ["o"]).count() == 100


def test_lookalike_tables(spark):
    df = spark.createDataFrame([(1, "ｅvil.test"), (2, None), (None, "ｅvil.test"), (1, "ｅvil.test"), (3, "evil.test"), (4, "x ev\u0456l.test y")], "id long, value string")
    assert rows(lookalike.find(df, "id", "value", [(7, "evil.test"), (8, None), (9, "")], True)) == [(1, 7)]
    assert rows(lookalike.find(df, "id", "value", [(7, "evil.test")], False)) == [(1, 7), (4, 7)]
    assert lookalike.find(df, "id", "value", [], False).count() == 0
    assert {r["id"]: r["c"] for r in lookalike.normalized(df, "value", "c").collect()}[4] == "x evil.test y"


def test_garbled_tables(spark):
    df = spark.createDataFrame([(1, "gelÃ¶scht", "gelöscht"), (2, None, ""), (3, "a", "t\ufffdche")], "id long, o string, d string")
    assert rows(mojibake.garbled(df, "id", ["o", "d"])) == [(1, "o", 1, 0, "gelöscht"), (3, "d", 0, 1, "t\ufffdche")]


def test_packing(spark):
    data = [(i, "s", i % 40, 30 + i % 50) for i in range(500)] + [(900, None, None, 1000), (901, "s", None, 0), (902, "s", None, None)]
    df = spark.createDataFrame(data, "item long, source string, cluster long, size int")
    out = packing.pack(df, [("small", 100), ("big", 700)]).collect()
    for kind, capacity in (("small", 100), ("big", 700)):
        part = [r for r in out if r["kind"] == kind]
        assert sum(r["size"] for r in part) == sum(d[3] or 0 for d in data)
        load, held = {}, {}
        for r in part:
            load[r["bin"]] = load.get(r["bin"], 0) + r["size"]
            held.setdefault(r["bin"], []).append(r["item"])
        assert max(load.values()) <= capacity
        assert all(len({i % 40 for i in b if i < 900}) == len([i for i in b if i < 900]) for b in held.values())
        assert len({r["piece"] for r in part if r["item"] == 900}) == -(-1000 // capacity) and all(r["piece"] == 0 for r in part if r["item"] < 900)
    assert packing.pack(df.limit(0), [("small", 100)]).count() == 0 and packing.pack(df, []).count() == 0


def test_mixture(spark):
    data = [(i, "a", 10 + i % 90) for i in range(2000)] + [(5000 + i, "b", 5 + i % 30) for i in range(300)] + [(1, None, 5), (2, "none", 5), (3, "a", None)]
    df = spark.createDataFrame(data, "item long, source string, size int")
    out = mixture.mix(df, [("a", 0.6, 2), ("b", 0.4, 3), ("c", 0.1, 1)]).collect()
    tokens = {s: sum(r["size"] * r["copies"] for r in out if r["source"] == s) for s in "ab"}
    assert abs(tokens["a"] / (tokens["a"] + tokens["b"]) - 0.6) < 0.02
    assert max(r["copies"] for r in out if r["source"] == "b") == 3 and {r["source"] for r in out} == {"a", "b"}
    assert mixture.mix(df.limit(0), [("a", 1.0, 1)]).count() == 0 and mixture.mix(df, []).count() == 0


def test_quality_sample_is_of_different_texts(spark, monkeypatch):
    base = [(f"text number {i} about the weather and the sea",) for i in range(40)]
    docs = spark.createDataFrame(base, "text string")
    first = docs.select("text", F.xxhash64("text").alias("h")).orderBy("h").first()[0]
    many = docs.unionByName(spark.createDataFrame([(first,)] * 30, "text string"))
    seen = []
    real = quality.training_set
    monkeypatch.setattr(quality, "training_set", lambda texts, words: (seen.append(texts), real(texts, words))[1])
    quality.train(docs, frozenset(["the"]), 20)
    quality.train(many, frozenset(["the"]), 20)
    assert seen[0] == seen[1] and len(set(seen[1])) == 20


def test_quality_reads_every_text(spark):
    words = frozenset(["the", "and", "was", "of", "zebra", "quagga"])
    prose = "The man was glad of the rain and the sea was calm and the road of the old town was wet."
    long = " ".join(f"The zebra quagga was at the end of road and the man of town was glad number {i}." for i in range(400))
    docs = spark.createDataFrame([(prose,), (long,), ("- a\n- b\n- c",)], "text string")
    assert len(long) > 20_000
    model, flow = quality.train(docs, words)
    assert ("zebra", "quagga") in flow.chance and len(model.trees) == model.rounds


def test_quality_trees_of_rows_that_lie_apart(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(1, 9, (900, len(quality.NAMES))), 2)
    y = (x[:, 0] + x[:, 3] > 10).astype(float)
    rows_ = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "label double, " + ", ".join(f"{n} double" for n in quality.NAMES))
    one, other = quality.boosted(rows_.repartition(3)), quality.boosted(rows_.repartition(7))
    assert np.array_equal(one.score(x), other.score(x))
    assert ((one.probability(x) >= 0.5) == y).mean() > 0.97
    assert np.corrcoef(one.score(x), quality.Trees().fit(x, y).score(x))[0, 1] > 0.99


def test_quality_tables(spark):
    words = frozenset(["the", "and", "is"])
    docs = spark.createDataFrame([(1, "The host is clean and the file is gone."), (2, None), (3, ""), (3, "..."), (4, "- a\n- b")], "doc_id long, text string")
    out = quality.assess(docs, "doc_id", "text", words, quality.train(docs, words))
    assert out.count() == 5 and not any(r["natural"] for r in out.where("doc_id in (2, 3)").collect())
    assert quality.assess(docs.limit(0), "doc_id", "text", words, quality.train(docs.limit(0), words)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, data, oracle, name):
    got = queries.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    expected = oracle.sql(queries.SQL[name]).df()
    assert rows(got.select(*columns)) == sorted(map(tuple, expected[columns].itertuples(index=False, name=None)), key=str)
