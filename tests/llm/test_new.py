"""Periodic runs, vector codes and fingerprints against brute force, odd inputs; what changed in the older operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import ann, codes, core, dedup, fingerprints, langid, packing, periodic, queries, toxicity

SF = "/root/testdata/sf0.001"


def slow_runs(w, repeats, least):
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            part = w[i : i + size]
            if j > i and size >= max(least, repeats * q) and not any(all(a == b for a, b in zip(part, part[p:])) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("repeats", "least"), [(4, 6), (2, 2), (2, 6), (3, 5)])
def test_runs_against_brute_force(spark, repeats, least):
    random.seed(repeats * 10 + least)
    texts = []
    for _ in range(250):
        w = [random.randrange(random.choice((1, 2, 3, 9))) for _ in range(random.randrange(0, 30))]
        p, at = [random.randrange(9) for _ in range(random.randrange(1, 7))], random.randrange(0, 20)
        w[at:at] = (p * 9)[: random.randrange(1, 9 * len(p))]
        texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(map(str, w)), 1) for i, w in enumerate(texts)], "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in periodic.find(docs, repeats, least).collect()}
    for i, w in enumerate(texts):
        want = slow_runs(w, repeats, least)
        gone = {x for s, n, q in want for x in range(s + q, s + n)}
        assert [tuple(r) for r in got[i]["runs"]] == want and got[i]["collapsed"] == " ".join(str(x) for j, x in enumerate(w) if j not in gone)


def test_runs_of_odd_texts(spark):
    rows = [(None, "a " * 8), (1, None), (1, ""), (2, "\t\n "), (3, "é\x0bé é  é\né é"), (4, "x y " * 30_000), (4, "x y " * 30_000)]
    got = periodic.digest(periodic.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    found = sorted((r["doc_id"] or 0, r["n_runs"], r["length"], r["period"], r["exponent_milli"]) for r in got if r["n_runs"])
    assert len(got) == 7 and found == [(0, 1, 8, 1, 8000), (3, 1, 6, 1, 6000), (4, 1, 60_000, 2, 30_000_000), (4, 1, 60_000, 2, 30_000_000)]
    assert periodic.find(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    with pytest.raises(ValueError):
        periodic.find(spark.createDataFrame(rows, "doc_id long, text string"), repeats=1)


def test_filtering_assigns_as_a_full_search():
    rng = np.random.default_rng(1)
    for n, k, w, high in ((1, 1, 2, 3), (40, 5, 1, 4), (700, 64, 4, 60), (3000, 64, 4, 9), (900, 30, 3, 1)):
        x, entries = rng.integers(-high, high + 1, (n, w)), rng.integers(-high, high + 1, (k, w))
        want = ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        near = np.full(n, -1)
        total, count = codes.walk(codes.build(x), x, entries, near)
        assert (near == want).all() and (count == np.bincount(want, minlength=k)).all() and all((total[:, j] == np.bincount(want, x[:, j], k)).all() for j in range(w))


def test_codes_of_odd_vectors(spark):
    shape = "vec_id long, embedding array<float>, label int"
    rows = [(i % 90, [float((i * 7 + j) % 11) / 4 - 1 for j in range(4)], i % 3 if i % 5 else None) for i in range(200)]
    odd = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [float("inf")] * 4, 1), (None, [9.0] * 4, 7)]
    df = spark.createDataFrame(rows + odd, shape).withColumn("code", F.lit("x"))
    got = codes.compress(df, parts=2, entries=8, rounds=2)
    assert got.count() == 201 and got.select("codebooks_sha256").distinct().count() == 1
    again = codes.compress(df.repartition(7), parts=2, entries=8, rounds=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert codes.compress(spark.createDataFrame([], shape)).isEmpty() and codes.compress(spark.createDataFrame(odd[:4], shape)).isEmpty()
    assert [r["error"] for r in codes.compress(spark.createDataFrame([odd[4]], shape), parts=2).collect()] == [0]
    with pytest.raises(ValueError):
        codes.compress(df, parts=3)


def prints(spark, texts):
    df = fingerprints.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "f")
    return df.orderBy("i")


def test_fingerprints_are_homomorphic(spark):
    texts = ["One a. Two b!\nThree c.", "Three c.\nOne a. Two b!", "Two b. One a!\nThree c.", "Three c.", "One a. Two b!", None, "\n\n", "One a. Two b!\nThree c.\nThree c."]
    rows = {r["i"]: r for r in prints(spark, texts).withColumn("s", fingerprints.as_text(F.col("f"))).collect()}
    assert rows[0]["s"] == rows[1]["s"] != rows[2]["s"] and rows[5]["s"] == rows[6]["s"] and len({r["s"] for r in rows.values()}) == 6
    one = prints(spark, texts).select(F.map_from_entries(F.collect_list(F.struct("i", "f")).over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy())).alias("m")).limit(1)
    m = lambda i: F.col("m")[i]
    got = one.select(*(fingerprints.as_text(x) for x in (fingerprints.inserted(m(3), m(4)), fingerprints.deleted(m(0), m(3)), fingerprints.deleted(m(7), m(0)), fingerprints.inserted(fingerprints.deleted(m(5), m(3)), m(3))))).first()
    assert list(got) == [rows[0]["s"], rows[4]["s"], rows[3]["s"], rows[5]["s"]]


def test_likeness_follows_common_sentences(spark):
    random.seed(3)
    base = [f"sentence {i} here" for i in range(40)]
    texts = [". ".join(base[: 40 - k] + [f"other {k} {j}" for j in range(k)]) for k in (0, 10, 20, 40)]
    df = prints(spark, texts)
    pairs = df.alias("a").join(df.where("i = 0").select(F.col("f").alias("g")))
    got = [r["near"] for r in fingerprints.with_likeness(pairs, "f", "g", "near").orderBy("i").collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.75) < 0.15 and abs(got[2] - 0.5) < 0.2 and got[3] < 0.3


def test_next_documents_whatever_the_ranges(spark):
    rows = [(i * 3, f"t{i}") for i in range(60)] + [(9, "again"), (9, "t3"), (None, "none"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    want = sorted((*x, order[(n + 1) % len(order)][1]) for n, x in enumerate(order))
    for size in (1, 7, 1000):
        got = fingerprints.with_next(df, size).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["next_text"]) for r in got) == want
    one = fingerprints.edited(spark.createDataFrame([(5, "abcde", 1)], "doc_id long, text string, N_CHARS int")).first()
    assert one["n_chars"] == 5 and one["edited_sha256"] == __import__("hashlib").sha256(b"abcab").hexdigest()
    assert fingerprints.edited(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_fingerprints_use_no_python(spark):
    plan = queries.op13_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas", "ExistingRDD") if w in plan]


def test_repeated_ids_keep_every_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, f"{b} y"), (5, "q q"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in dedup.near_duplicates(docs, 5, 80).collect())
    assert found == [(3, 56, 3, True), (5, 1, 5, True), (5, 56, 3, False), (5, 56, 5, True), (5, 56, 5, True), (7, 57, 5, False), (8, 0, 8, True), (8, 0, 8, True)]
    kept = sorted(((r["doc_id"], r["text"]) for r in dedup.one_of_each(docs, 5, 80).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (5, "q q"), (8, None), (8, "")], key=str)


def test_repeated_queries_have_all_their_neighbours(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id = 4").union(vectors.where("vec_id = 4"))
    got = ann.search(vectors, asked, k=10).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and len({r["vec_id"] for r in got}) == 10


def test_penalty_binds(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.examples(docs, labels)
    free, held = toxicity.fit(rows, penalty=0.0), toxicity.fit(rows, penalty=1.0)
    assert not np.allclose(free.weights, held.weights) and toxicity.swap_change(rows, held) < 0.1 * toxicity.swap_change(rows, free)
    scored = toxicity.score(docs, held).join(labels, "doc_id").where(core.held_out()).toPandas()
    bad, fine = (scored[scored.toxic == y].score.to_numpy() for y in (1, 0))
    assert (bad[:, None] > fine[None]).mean() > 0.95


@pytest.mark.parametrize("partitions", [4, 200])
def test_sequences_are_as_few_as_can_be(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        packed = queries.op8_packing(spark, "/root/testdata/sf0.01")
        n, tokens = packed.agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert n <= 1.01 * -(-tokens // 2048)
    assert packing.pack(packing.tokenize(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path())).isEmpty()


def test_words_of_switching_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    part = {r["lang"]: r["text"].split()[:40] for r in docs.where("lang is not null and size(split(text, ' ')) > 60").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    langs = sorted(part)[:3]
    mixed = " ".join(w for x in langs for w in part[x])
    words = langid.label_words(spark.createDataFrame([(1, mixed), (2, None), (3, "12 !")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    truth = [x for x in langs for _ in part[x]]
    right = [w["lang"] == t for w, t in zip(words[0]["words"], truth, strict=True) if w["lang"] != "und"]
    assert sum(right) > 0.9 * len(right) > 60 and words[1]["words"] == [] and [w["lang"] for w in words[2]["words"]] == ["und", "und"]
