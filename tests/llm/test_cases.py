"""Odd inputs, bounds and the queries themselves: SQL, brute force, held-out rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import ann, core, decontaminate, dedup, langid, oracle, packing, pii, quality, queries, toxicity, urls, warc
from shelfspark.llm.words import Words, chunks

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(oracle.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    key = [c for c in ("query_id", "rank", "page_id", "record_type", "doc_id", "vec_id") if c in columns]
    for c in columns:
        a, b = (x.sort_values(key)[c].reset_index(drop=True) for x in (want, got))
        assert np.allclose(a, b, rtol=1e-12) if c in ("score", "near_edited", "near_next") else ((a == b) | (a.isna() & b.isna())).all(), c


def test_words_of_any_length_differ():
    texts = ["a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096, "a" * 8192, "a" * 8191 + "b", "a" * 12288]
    hashes = [h for _, _, buf, offsets in chunks(pa.array(texts)) for h in Words(buf, offsets).hashes().tolist()]
    assert len(set(hashes)) == len(texts)


def test_texts_are_taken_in_small_chunks():
    texts = ["word " * 200] * 1000 + ["a" * 300_000] + ["word " * 200] * 3
    found = list(chunks(pa.array(texts)))
    assert [lo for lo, *_ in found[1:]] == [hi for _, hi, *_ in found[:-1]] and found[-1][1] == len(texts)
    assert all(len(buf) <= 128 << 10 or hi - lo == 1 for lo, hi, buf, _ in found)


def test_batches_are_small_where_the_session_has_no_bound_of_its_own():
    class Session:
        def __init__(self, own, now=core.DEFAULT_BYTES):
            self.set_to = {core.BATCH_BYTES: now}
            self.sparkContext = type("C", (), {"getConf": lambda _: {core.BATCH_BYTES: own}})()
            self.conf = type("F", (), {"get": lambda _, k, d=None: self.set_to.get(k, d), "set": lambda _, k, v: self.set_to.update({k: v})})()

    for own, now, then in ((None, core.DEFAULT_BYTES, "1m"), ("67108864b", core.DEFAULT_BYTES, core.DEFAULT_BYTES), (None, "2m", "2m")):
        session = Session(own, now)
        core.bound_batches(session)
        assert session.set_to[core.BATCH_BYTES] == then


def test_a_sessions_batches_are_small_where_it_has_no_bounds_of_its_own(spark):
    for name, least, own in ((core.BATCH_BYTES, "1m", "3m"), (core.READ_ROWS, "256", "1000")):
        spark.conf.unset(name)
        core.bound_batches(spark)
        assert spark.conf.get(name) == least
        spark.conf.set(name, own)
        core.bound_batches(spark)
        assert spark.conf.get(name) == own
        spark.conf.unset(name)


def test_texts_reach_python_in_small_batches(spark, tmp_path):
    spark.createDataFrame([(i, "word " * 1000) for i in range(1500)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    sizes = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in it)
    got = [r["n"] for r in core.narrow(spark.read.parquet(f"{tmp_path}/d"), "doc_id", "text").mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 7_000_000 and max(got) < 2 << 20


def test_tables_of_short_rows_are_few_files_whatever_the_partitions(spark, monkeypatch):
    texts = [f"common words of copy {i // 4} here {' '.join(f'w{i // 4}x{j}' for j in range(20))}" for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files: list[tuple[list[str], int]] = []
    save = core.Tables.save
    monkeypatch.setattr(core.Tables, "save", lambda self, df, *a, **b: (files.append(((out := save(self, df, *a, **b)).columns, len(out.inputFiles()))), out)[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = dedup.near_duplicates(docs, 2, 80).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i // 4 * 4) for i in range(160)]
    short = [n for columns, n in files if columns in (["a", "b"], ["node", "component"], ["id"])]
    assert short and max(short) <= spark.sparkContext.defaultParallelism


def test_shared_folder_is_the_sessions(spark, monkeypatch, tmp_path):
    class Session:
        def __init__(self, master, path):
            self.sparkContext = type("C", (), {"master": master})
            self.conf = type("F", (), {"get": staticmethod(lambda k, d=None: path)})

    assert core.shared_dir(Session("spark://x:7077", "hdfs:///tmp")) == "hdfs:///tmp" and core.shared_dir(Session("local[2]", None)) == core.shared_dir(Session("local", None))
    for master in ("local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="shared|share"):
            core.shared_dir(Session(master, None))


def exact_nearest(x, ids, q, k):
    with np.errstate(over="ignore"):
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]


def test_nearest_of_huge_and_tiny_numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) * 10.0 ** rng.choice([-20, 0, 20], size=(300, 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), block=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {q: exact_nearest(x, np.arange(300), q, 10) for q in range(0, 300, 20)}
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(want, 10)
    for q, own in got.items():
        assert len({v for v, _ in own} & {v for v, _ in want[q]}) >= 9, q


def test_nearest_of_mixed_lengths_lots_repeats_and_clashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 300)
    rng = np.random.default_rng(5)
    every = {i: rng.normal(size=(3, 6, 6, 9)[i % 4]).tolist() for i in range(200)}
    df = spark.createDataFrame([*every.items(), (7, every[3]), (7, every[3]), (None, [1.0] * 6), (300, [])], "vec_id long, embedding array<double>").withColumn("VEC_ID2", F.lit(1)).withColumn("Embedding_", F.lit(2))
    got = ann.search(df, df.where("vec_id % 25 = 0"), k=4).cache()
    for q, own in collections.Counter(r["query_id"] for r in got.collect()).items():
        assert own == 4
        same = {i: v for i, v in every.items() if len(v) == len(every[q])}
        if 3 not in same and 7 not in same:
            mine = rows(got.where(F.col("query_id") == q).select("vec_id", "score", "rank"), "rank")
            want = exact_nearest(np.array(list(same.values())), np.array(list(same)), q, 4)
            assert [m[0] for m in mine] == [w[0] for w in want] and np.allclose([m[1] for m in mine], [w[1] for w in want])
    assert got.select("query_id").distinct().count() == 8 and ann.search(df, df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 4)")
    assert rows(ann.search(few, few).select("query_id", "vec_id", "rank"), "query_id") == [(0, 4, 1), (4, 0, 1)]


def test_codes_are_four_bits():
    x = np.random.default_rng(6).normal(size=(500, 7))
    book = ann.fit(x)
    code = ann.encode(x, book)
    packed = ann.pack(code)
    assert packed.dtype == np.uint8 and packed.shape == (500, 4) and code.max() < 16
    est = ann._scan(x[:3], packed, (x**2).sum(1), book)
    near = np.stack([book.centres[p][code[:, p]] for p in range(7)], 1)[:, :, 0]
    assert np.allclose(est, (x**2).sum(1) - 2 * x[:3] @ near.T, atol=1e-4)
    ties = np.array([[1, 0, 0, np.nan, 0]], np.float32)
    assert sorted(ann._best(ties, 3)[0]) == [1, 2, 3]


def test_warc_keeps_columns_repeated_headers_and_one_line_uris(spark, tmp_path):
    source = warc.responses(spark.createDataFrame([(1, "http://a.org/\r\nX: y", "<title>t</title>" + "<p>long text</p>" * 20_000, "2024-05-01T00:00:00Z"), (2, None, None, None)], "page_id long, url string, html string, date string"))
    more = source.withColumn("headers", F.concat("headers", warc.headers_of(("Set-Cookie", F.lit("a")), ("Set-Cookie", F.lit("b")))))
    more = more.withColumns({"text": F.lit("MINE"), "payload": F.lit(2), "title": F.lit("own"), "_src": F.lit(3), "Block_": F.lit(4)})
    made = warc.derive(more).cache()
    assert set(more.columns) == set(made.columns) and made.where("text <> 'MINE' or title <> 'own' or _src <> 3").count() == 0
    meta = made.where("page_id = 1 and record_type = 'metadata'").first()
    assert meta["block"].count("source-header: Set-Cookie: ") == 2 and meta["date"] == "2024-05-01T00:00:00Z" and dict(meta["headers"])["WARC-Refers-To-Date"] == meta["date"]
    assert made.where("page_id = 1 and record_type = 'conversion'").first()["block"] == "t\n" + "long text\n" * 19_999 + "long text"
    warc.write(made, str(tmp_path / "w"), records_a_file=1)
    back = warc.read(spark, str(tmp_path / "w")).cache()
    assert back.count() == 4 and rows(back.select("record_id", "date", "refers_to"), "record_id") == rows(made.select("record_id", "date", "refers_to"), "record_id")
    assert {r["target_uri"] for r in back.collect()} == {"http://a.org/%0D%0AX: y", ""} and all("WARC-Refers-To-Target-URI" in dict(r["headers"]) for r in back.collect())


def test_pii_query_against_brute_force(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    texts = dict(rows(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id"))
    for r in queries.op3_pii(spark, SF).collect():
        text, spans = texts[r["doc_id"]] or "", []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[k]
                spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}")] if ok else []
        joined = ",".join(x[2] for x in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in patterns] == [sum(x[1] == i for x in spans) for i in range(4)] and set(joined.split(",")) <= {*r["spans"].split(","), ""}


def test_toxicity_twins_and_odd_tables(spark):
    for text in ("the muslims came home", "Nothing of the kind", ""):
        a, b = toxicity.twins(text)
        assert a != b and len(a.split()) == len(b.split()) and sum(x != y for x, y in zip(a.split(), b.split(), strict=True)) == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("TEXT_", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("Toxic_", F.lit(1))
    odd = labels.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, toxic int"))
    model = toxicity.train(docs, odd)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {1 / (1 + np.exp(4.0))}
    # a bound on features takes fewer rows, not parts of rows
    assert 0 <= toxicity.score(docs, toxicity.train(docs, labels, most_features=20_000)).first()["score"] <= 1


def test_toxicity_query_on_rows_it_learned_nothing_from(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").where("held_out and toxic is not null").toPandas()
    rank, bad = got["score"].rank(), got["toxic"] == 1
    assert bad.sum() > 5 and (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()) > 0.95


def test_quality_by_grade_seen(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "spam spam spam") for i in range(80)] + [(100, None), (101, ""), (101, "")], "doc_id long, text string").withColumn("Doc", F.lit(1))
    rated = lambda *grades: docs.where("doc_id < 80").select("doc_id", F.when(F.col("doc_id") % 2 == 1, grades[-1]).otherwise(grades[0]).alias("grade"))
    for grades, at_0, at_1 in (((1, 2), 1.0, None), ((0, 1), None, 0.0), ((2, 2), 1.0, 1.0), ((0, 0), 0.0, 0.0)):
        m = quality.train(docs, rated(*grades))
        got = quality.grade(docs, m).select("doc_id", quality.over(m, 0).alias("a"), quality.over(m, 1).alias("b"), "expected_grade").collect()
        assert len(got) == 83 and (at_0 is None or {r["a"] for r in got} == {at_0}) and (at_1 is None or {r["b"] for r in got} == {at_1})
        assert all(grades[0] <= r["expected_grade"] <= grades[-1] for r in got)
        if at_0 is None:
            assert min(r["a"] for r in got if r["doc_id"] % 2 and r["doc_id"] < 80) > 0.9
    none = quality.train(docs, rated(0, 1).limit(0))
    assert {r["expected_grade"] for r in quality.grade(docs, none).collect()} == {0.0} and quality.grade(docs.limit(0), none).count() == 0


def test_quality_query_on_rows_it_learned_nothing_from(spark):
    got = queries.op9_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").where("quality is not null").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]]
    assert len(held) > 50 and (held["kept"] == (held["quality"] == 1)).mean() > 0.9


def test_features_of_a_text_are_summed():
    texts = pa.array(["one two one", None, "", "x " * 5000])
    cells, values = quality.features(texts)
    for i, (c, v) in enumerate(zip(cells.to_pylist(), values.to_pylist(), strict=True)):
        assert c == sorted(set(c)) and len(c) == len(v)
        own = np.zeros(quality.SIZE)
        for _, _, doc, cell, value in quality._cells(texts):
            np.add.at(own, cell[doc == i], value[doc == i])
        assert np.allclose(own[c], v, rtol=1e-5)


def test_sample_of_each_takes_its_bound_of_a_frequent_value(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("lang"))
    assert {r["lang"]: r["count"] for r in core.sample_of_each(df, "doc_id", "lang", 60).groupBy("lang").count().collect()} == {"rare": 50, "often": 60}


def test_urls_trees_on_other_hosts_and_odd_urls(spark):
    got = urls.held_out_rows(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).toPandas()
    assert len(got) > 100 and ((got["block_score"] >= 0.5) == (got["ruled"] == "block")).mean() > 0.85
    odd = [(1, "http://x.net/" + "a/" * 50_000), (1, "http://x.net/" + "a/" * 50_000), (2, "://"), (3, "http://"), (4, ""), (None, "http://y.net/é?a=1&b=2#é")]
    train = [(100 + i, f"http://h{i % 9}.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(60)]
    df = spark.createDataFrame([*odd, *train], "page_id long, url string").withColumn("URL_", F.lit(1))
    out = urls.judge(df).cache()
    assert out.count() == len(odd) + len(train) and out.where("page_id = 1").select("verdict", "block_score").distinct().count() == 1 and out.where("verdict is null").count() == 0
    entropy = urls.lexical(spark.createDataFrame([("aabb", "", ""), ("abcd", "", ""), ("", "", "")], "_url string, host string, path string")).select("entropy").collect()
    assert [round(r[0], 9) for r in entropy] == [1.0, 2.0, 0.0]


def test_packing_odd_rows_and_capacities(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(400)] + [(None, "a b"), (None, None), (3, "repeated"), (3, "repeated"), (5, "long " * 9000)], "doc_id long, text string").withColumn("TEXT_", F.lit(1))
    pieces = packing.tokenize(docs, queries.tokenizer_path()).cache()
    for rule in ("norm", "dot"):
        got = packing.pack(pieces, max_docs=20, rule=rule).toPandas()
        assert len(got) == pieces.count() and got["doc_id"].isna().sum() == 2
        for _, own in got.groupby("sequence_id"):
            own = own.sort_values("offset")
            assert own["length"].sum() <= 2048 and len(own) <= 20 and (own["offset"] == own["length"].cumsum() - own["length"]).all()
    plain = packing.pack(pieces, max_docs=2048).select("sequence_id").distinct().count()
    assert plain <= -(-sum(r["length"] for r in pieces.collect()) // 2048) + 4


def test_language_of_long_texts_repeats_and_many_languages(spark):
    text = lambda y, i: " ".join(f"l{y}x{(i * 7 + k) % 12}q" for k in range(30))
    docs = spark.createDataFrame([(100 * y + i, text(y, i), f"lang{y}") for y in range(65) for i in range(4)] + [(9000, "abc " * 60_000, "lang1"), (9000, "abc " * 60_000, "lang1"), (9001, None, "lang2"), (None, "x y", "lang3"), (9002, "a b", None)], "doc_id long, text string, lang string").withColumn("Lang_", F.lit(1))
    m = langid.train(docs, sequences=400, rounds=10)
    assert len(m.labels) >= 60
    got = {r["doc_id"]: r for r in langid.predict(docs, m).collect()}
    assert np.mean([got[100 * y + i]["lang_pred"] == f"lang{y}" for y in range(65) for i in range(4)]) > 0.8 and got[9001]["lang_pred"] == "und" and got[9000]["lang_pred"] != "und"
    assert langid.predict(docs.limit(0), m).count() == 0


ODD = [(1, None, None), (2, "", "en"), (3, " \n", "fr"), (None, "some words of a row without an id here", "en"), (5, "the same text twice over and over again", "en"), (5, "the same text twice over and over again", "en"), (6, "one", None), (7, "!!! 123", "en"), (8, "word " * 30_000, "en")]


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "Text_": F.lit("extra")})
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "the same text twice over and over again")], "item_id long, text string")
    for name, docs, items in (("odd", odd, bench), ("empty", odd.limit(0), bench.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len(got) == 0 if name == "empty" else {r["doc_id"] for r in got} >= {5, 8}


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = corpus_pipeline.language(spark, docs, SF).cache()
    labels = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(i for i, r in labels.items() if r["lang_pred"] != "und" and r["lang_score"] >= corpus_pipeline.LANGUAGE_SHARE)

    sets = {}
    for r in known.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    from tests.llm.test_llm import components, most_agreeing

    one = corpus_pipeline.near_duplicates(spark, known, SF).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, c in components(sets, 80).items() if i == c) and one.columns == docs.columns

    clean = corpus_pipeline.benchmark_passages(spark, one, SF).cache()
    tokens = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in clean.collect()}
    for r in one.where(F.length("text") < 1500).collect():
        words = tokens(r["text"])
        assert (r["doc_id"] in gone) == any(len(set(words) & set(i)) >= min(4, len(i)) and most_agreeing(words, i, 10, 0.75) > 0 for i in items)
    private = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, clean, SF).collect()}
    assert len(private) == clean.count() and not any(pii.spans(t, pii.BASE) for t in private.values())
    assert len(decontaminate.MASKS) == 5 and dedup.TREES == 16
