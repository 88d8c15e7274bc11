"""The ten operators against brute force, round trips and held-out labels, with odd rows in every one."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import ann, decontaminate, dedup, langid, packing, pii, quality, queries, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, TEXT2 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows and ids."""
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t", "en"), (None, "some words of a row without id", "en"), (4, "word " * 50_000, "en"), (5, "one two three four five six", "en"), (5, "one two three four five six", "en"), (6, "one", None), (7, "!!! 123 ...", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("TEXT_", F.lit("extra"))


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(800)] + [(900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16), (1200, [1.0, None] * 8), (801, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 800, 100)) and sorted(got[0])[0][1:] == (801, 0.0)
    ids, full = np.r_[np.arange(800), 801], np.vstack([x, x[:1]])
    hits = 0
    for q in got:
        d = np.sqrt(((full - x[q]) ** 2).sum(1))
        true = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(true) & {v for _, v, _ in got[q]})
        assert all(abs(s - d[list(ids).index(v)]) < 1e-12 for _, v, s in got[q])
    assert hits / 80 >= 0.9
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_warc_links_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<html><title>T &amp; t</title><script>var a;</script><p>One</p><p>Two &lt;3</p></html>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages)).cache()
    assert made.count() == 6 and made.where("refers_to is null").count() == 0
    text = made.where("page_id = 1 and record_type = 'conversion'").first()
    assert text["block"] == "T & t\nOne\nTwo <3" and dict(text["headers"])["WARC-Source-Payload-Digest"].startswith("sha256:")
    warc.write(made, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    assert sorted(map(str, back.select("record_id", "refers_to", "block").collect())) == sorted(map(str, made.select("record_id", "refers_to", "block").collect()))
    assert back.where("block_digest <> payload_digest").count() == 0 and warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_text_decodes_all_entities(spark):
    page = "<p>&copy; 2024 &middot; caf&eacute; it&#8217;s &#xe9;&nbsp;x &amp;copy; &hellip; &lt;b&gt; AT&T &bogus;</p><footer>a&nbsp;&nbsp;b</footer>"
    made = warc.derive(warc.responses(spark.createDataFrame([(1, "http://a.org/", page), (2, "", None)], "page_id long, url string, html string")))
    got = {r["page_id"]: r["block"] for r in made.where("record_type = 'conversion'").collect()}
    assert got == {1: "\u00a9 2024 \u00b7 caf\u00e9 it\u2019s \u00e9 x &copy; \u2026 <b> AT&T &bogus;\na b", 2: ""}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_pii(spark, docs, odd):
    hard = ["a@b@c.de x.y@z.org.", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567, +12 3", "IBAN DE89 3704 0044 0532 0130 00 bank"]
    for t in [r["text"] or "" for r in docs.collect()] + hard:
        want = []
        for kind, p in BASE.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                    want.append((m.start(), m.end(), kind))
        assert sorted(x[:3] for x in pii.spans(t, pii.BASE)) == sorted(want)
    assert [x[2] for x in pii.spans(hard[4])] == ["iban"]
    assert pii.find(odd).count() == odd.count() and pii.redact(odd).columns == odd.columns
    assert pii.redact(spark.createDataFrame([(1, "to a@b.de now")], "doc_id long, text string")).first()["text"] == "to <email> now"


def test_toxicity(spark, docs, odd):
    rng = np.random.default_rng(3)
    plain, bad = ["calm", "river", "stone", "paper", "window", "garden"], ["vile", "scum"]
    rows, labels = [], []
    for i in range(400):
        y = int(i % 4 == 0)
        words = list(rng.choice(plain, 12)) + ["muslims"] * (y or rng.random() < 0.1) + [str(rng.choice(bad))] * y
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plainly, fair = toxicity.train(d, lab, penalty=0.0), toxicity.train(d, lab, penalty=20.0)
    one = spark.createDataFrame([(1, "calm river muslims"), (2, "calm river christians"), (3, "calm vile scum")], "doc_id long, text string")
    gap = lambda m: (lambda s: abs(s[1] - s[2]))({r["doc_id"]: r["score"] for r in toxicity.score(one, m).collect()})
    assert gap(fair) < gap(plainly)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, fair).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert min(got[i] for i in held if i % 4 == 0) > max(got[i] for i in held if i % 4)
    assert toxicity.score(odd, fair).count() == odd.count() and 0 <= toxicity.score(odd, toxicity.train(d, lab.limit(0))).first()["score"] <= 1


def components(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, k):
    base = " ".join(f"w{i}" for i in range(200))
    near = [(10_000 + i, base.replace(f" w{i} ", f" x{i} ") + f" tail{i}") for i in range(1, 120)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*near, (20_000, None), (20_001, "ONE"), (20_002, "one"), (20_003, " ")], "doc_id long, text string"))
    sets = {}
    for r in df.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    want = components(sets, 80)
    got = dedup.near_duplicates(df, k, 80).collect()
    assert len(got) == len(sets)
    assert [r for r in got if r["component_id"] != want[r["doc_id"]] or r["n_shingles"] != len(sets[r["doc_id"]]) or r["kept"] != (want[r["doc_id"]] == r["doc_id"])] == []
    kept = dedup.one_of_each(df.withColumn("TEXT2", F.lit(1)), k, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c) and kept.columns == ["doc_id", "text", "TEXT2"]


def test_near_duplicates_hub_and_spokes(spark, monkeypatch):
    """Copies that are near one hub only, in regions larger than a task takes, all reach it."""
    monkeypatch.setattr(dedup, "HOT", 10)
    rng, rows = np.random.default_rng(8), []
    for hub in range(2):
        base = [f"h{hub}w{i}" for i in range(201)]
        rows.append((hub, " ".join(base)))
        for i in range(450):
            words = list(base)
            for at in rng.choice(np.arange(1, 100), 11, replace=False):
                words[2 * at] = f"own{hub}x{i}x{at}"
            rows.append((1000 * (hub + 1) + i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: 0 if i in (0, *range(1000, 1450)) else 1 for i in got} and len(got) == 902


def test_near_duplicates_odd(spark, odd):
    got = dedup.near_duplicates(odd, 2, 80)
    assert got.count() == odd.count() and dedup.near_duplicates(odd.limit(0)).count() == 0
    assert dedup.one_of_each(odd, 2, 80).where("doc_id = 5").count() == 1 and dedup.one_of_each(odd, 2, 80).where("doc_id is null").count() == 1


def test_urls(spark):
    cases = {
        "http://A.Org/x": ("a.org", "/x", "org/", "allow"), "https://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "http://sub.example.org/en/12": ("sub.example.org", "/en/12", "example.org/en/1", "block"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "http://x.com/de/?q=1#f": ("x.com", "/de/", "com/de/", "block"), "http://x.com": ("x.com", "", None, None), "no scheme": ("", "", None, None), "http://xorg/": ("xorg", "/", None, None),
    }
    df = spark.createDataFrame([*((i, u) for i, u in enumerate(cases)), (99, None)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or (verdict is None and got[i]["verdict"] in ("allow", "block"))
    assert got[99]["host"] == "" and urls.judge(df.limit(0)).count() == 0
    plan = urls.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_decontaminate(spark, odd):
    item = "the quick brown fox jumps over the lazy dog while seven clever cats watch from a warm stone wall".split()
    one_off = [*item[:9], "replaced", *item[10:]]
    rows = [(1, "before " * 30 + " ".join(item) + " after" * 30), (2, "x " * 9 + " ".join(one_off)), (3, " ".join(item[:6]) + " other words entirely here"), (4, "clean text " * 40)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_match"], r["start_word"]) for r in decontaminate.find(df, bench).collect()}
    assert got == {(1, 7): (19, 30), (2, 7): (18, 9)}
    assert sorted(r["doc_id"] for r in decontaminate.remove(df, bench).collect()) == [3, 4]
    assert decontaminate.remove(odd, bench).count() == odd.count() and decontaminate.find(df, bench.limit(0)).count() == 0


def test_masks_hit_every_overlap():
    """The fewest differing words that avoid all masks are more than an overlap of that length may have."""
    masks, span = [(int(m, 2), len(m)) for m in decontaminate.MASKS], max(map(len, decontaminate.MASKS))
    least = {0: 0}
    for n in range(1, 32):
        after = {}
        for state, cost in least.items():
            for same in (0, 1):
                t = state << 1 | same
                if not any(n >= size and t & m == m for m, size in masks):
                    t &= (1 << span) // 2 - 1
                    after[t] = min(after.get(t, 99), cost + 1 - same)
        least = after
        assert n < decontaminate.LEAST_WORDS or min(least.values()) > min(n - decontaminate.LEAST_WORDS, int(n * (1 - decontaminate.LEAST_SHARE)))


def most_agreeing(doc, item, least, share):
    """Brute force: over all diagonals and runs of words, the most agreeing words of an overlap."""
    top = 0
    for d in range(-len(item) + 1, len(doc)):
        same = [doc[i + d] == item[i] for i in range(max(0, -d), min(len(item), len(doc) - d))]
        count = np.concatenate([[0], np.cumsum(same)])
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                agree = count[j] - count[i]
                if agree >= min(least, len(item)) and agree >= share * (j - i) - 1e-9:
                    top = max(top, int(agree))
    return top


def planted(seed, n):
    """Documents with a part of their item, words replaced and others around; few or many different words."""
    rng, docs, items = np.random.default_rng(seed), {}, {}
    for i in range(n):
        v = int(rng.choice([2, 4, 1000]))
        items[i] = [f"v{v}w{rng.integers(v)}" for _ in range(int(rng.integers(1, 32)))]
        core = ["zz" if rng.random() < 0.2 else w for w in items[i]]
        around = lambda: [f"v{v}w{rng.integers(v)}" for _ in range(int(rng.integers(0, 8)))]  # noqa: B023, E731
        docs[i] = around() + core + around() + (core if i % 7 == 0 else [])
    return docs, items


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_decontaminate_against_all_diagonals(spark, most_bytes):
    """By broadcast and by join: every document and item that overlap by brute force are found, and no others."""
    docs, items = planted(6, 40)
    got = collections.defaultdict(list)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    for r in decontaminate.find(df, bench, most_bytes=most_bytes).collect():
        got[r["doc_id"], r["item_id"]].append((r["start_word"], r["n_words"], r["n_match"]))
    want = {(d, i): n for d in docs for i in items if set(docs[d]) & set(items[i]) and (n := most_agreeing(docs[d], items[i], 10, 0.75))}
    assert {k: max(m for _, _, m in v) for k, v in got.items()} == want and len(want) > 40
    for found in got.values():
        found.sort()
        assert all(s + n <= t for (s, n, _), (t, _, _) in zip(found[:-1], found[1:], strict=True))
    clean = {r["doc_id"] for r in decontaminate.remove(df, bench, most_bytes=most_bytes).collect()}
    assert clean == {d for d in docs if not any(k[0] == d and len(items[k[1]]) >= 4 for k in want)}


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_decontaminate_repeats_ties_and_long_texts(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(decontaminate, "SHARE", 50)
    monkeypatch.setattr(decontaminate, "ITEMS", 1)
    item = " ".join(f"i{k}" for k in range(12))
    df = spark.createDataFrame([(1, item), (1, item), (2, "word " * 3000), (None, f"{item} x {item}"), (4, None), (5, "")], "doc_id long, text string").withColumn("TEXT_", F.lit(1))
    bench = spark.createDataFrame([(7, item), (7, item), (8, "word " * 30), (9, None), (None, item)], "item_id long, text string").withColumn("Text_", F.lit(1))
    got = collections.Counter((r["doc_id"], r["item_id"], r["start_word"], r["n_match"]) for r in decontaminate.find(df, bench, most_bytes=most_bytes).collect())
    assert got.pop((1, 7, 0, 12)) == 4 and got.pop((None, 7, 0, 12)) == 2 and got.pop((None, 7, 13, 12)) == 2
    assert {k[:2] for k in got} == {(2, 8)} and len(got) == 100 and {k[3] for k in got} == {30}
    left = decontaminate.remove(df, bench, most_bytes=most_bytes)
    assert sorted(r["doc_id"] for r in left.collect()) == [4, 5] and left.columns == df.columns
    assert decontaminate.remove(df, bench.limit(0), most_bytes=-1).count() == 6 and decontaminate.find(df.limit(0), bench, most_bytes=most_bytes).count() == 0


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    df = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = packing.pack(packing.tokenize(df, queries.tokenizer_path())).collect()
    of, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids, at = [*tok.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(of[doc], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and len(of[doc]) == -(-len(ids) // 2048)
    for places in seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(packing.tokenize(df.limit(0), queries.tokenizer_path())).count() == 0


def test_packing_texts_with_added_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["ab<|endoftext|>cd", "<|endoftext|>", " two  words  <|endoftext|> and  <|endoftext|><|endoftext|>\n", "<|endoftext", "word <|endoftext|> " * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.tokenize(df, queries.tokenizer_path(), keep_ids=True).orderBy("doc_id", "piece").collect():
        got[r["doc_id"]] += r["ids"]
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)} and got[0] == [397, 50256, 10210, 0]


def test_best_fit_keeps_every_capacity():
    n = np.sort(np.random.default_rng(5).integers(1, 60, 500))[::-1]
    for rule in ("norm", "dot"):
        bins, _ = packing.best_fit(n, 100, 4, 4000.0, rule)
        for b in np.unique(bins):
            own = n[bins == b]
            assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 4000


def test_quality_orders_grades(spark, odd):
    rng = np.random.default_rng(2)
    words = (["spam", "buy", "now", "click"], ["good", "text", "with", "words"], ["rich", "essay", "argues", "well"])
    rows = [(i, " ".join(rng.choice(words[i % 3], 30)), i % 3) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    m = quality.train(d, d.select("doc_id", "grade"))
    assert list(m.thresholds) == sorted(m.thresholds)
    got = {r["doc_id"]: r for r in quality.grade(d, m).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([round(got[i]["expected_grade"]) == i % 3 for i in held]) > 0.9 and all(r["tails"][0] >= r["tails"][1] for r in got.values())
    assert quality.grade(odd, m).count() == odd.count()


def test_language(spark, docs, odd):
    m = langid.train(docs)
    got = langid.predict(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, m).collect()}
    assert out[1] == out[2] == out[3] == out[7] == "und" and out[4] != "und"
    assert langid.predict(docs, langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.keep_known(odd, m).where("doc_id in (1, 2, 3, 7)").count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(4)
    e, t, s = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.posteriors(e, np.array([0, 7]), t, s)
    total, want = 0.0, np.zeros((7, 3))
    for path in np.ndindex(*(3,) * 7):
        w = np.exp(s[path[0]] + sum(e[i, p] for i, p in enumerate(path)) + sum(t[a, b] for a, b in zip(path[:-1], path[1:])))
        total += w
        for i, p in enumerate(path):
            want[i, p] += w
    assert np.allclose(got, want / total)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_passages", "personal_data", "packing"]
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
