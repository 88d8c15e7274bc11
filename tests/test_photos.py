import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.operators import alike, images


def _rows(n, seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice(["red", "bolt", "ring", "hub", "old", "cold", "é", "p"])

    def name():
        odd = rng.random()
        if odd < 0.1:
            return rng.choice(["", "x" * rng.choice([3, 63, 64, 65, 130]) + f" {word()}", " ".join(f"w{rng.randint(0, 20)}" for _ in range(20))])
        return " ".join([*(word() for _ in range(rng.randint(1, 3))), *([str(rng.randint(0, 300))] if odd < 0.7 else [])])

    x = {"k": [name() for _ in range(n)], "category": [rng.choice(["C", None, "D"]) for _ in range(n)], "subcategory": [rng.choice([None, "x", "z"]) for _ in range(n)]}
    y = {"k": [name() for _ in range(n)], "sk": [rng.choice(["", f"p {i}", f"a {i:03}b", "red", name()]) for i in range(n)], "category": [rng.choice(["C", "H", None]) for _ in range(n)], "subcategory": [rng.choice([None, "x", "y"]) for _ in range(n)]}
    return x, y


def _frames(spark, x, y):
    f = spark.createDataFrame([(f"C/{i}", *r) for i, r in enumerate(zip(x["category"], x["subcategory"], x["k"], strict=True))], "folder string, category string, subcategory string, title string")
    p = spark.createDataFrame(list(zip(range(len(y["k"])), y["category"], y["subcategory"], y["k"], y["sk"], strict=True)), "id long, category string, subcategory string, name string, sku string")
    return f, p


def _every_pair(f, p, least):
    """The score of every pair by Spark's own functions: folder, id, score and whether a word or the SKU is common."""
    x = f.select("folder", "category", F.col("subcategory").alias("sub"), F.col("title").alias("fk")).crossJoin(p.select("id", F.col("category").alias("pc"), F.col("subcategory").alias("ps"), F.col("name").alias("pk"), F.col("sku").alias("sk")))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    inside = (F.length("sk") >= 4) & F.contains("fk", "sk")
    few, many = (F.when(F.length("fk") <= F.length("pk"), words(a)).otherwise(words(b)) for a, b in (("fk", "pk"), ("pk", "fk")))
    base = F.greatest(text.key_similarity(F.col("fk"), F.col("pk")), text.key_similarity(F.col("fk"), F.col("sk")), F.when(inside, 0.95).otherwise(0.0), F.when((F.size(few) > 0) & (F.size(F.array_except(few, many)) == 0), 0.78).otherwise(0.0))
    move = F.when(F.col("category") == F.col("pc"), 0.08).otherwise(0.0) + F.when(F.col("sub").isNull() | F.col("ps").isNull(), 0.0).when(F.col("sub") == F.col("ps"), 0.06).otherwise(-0.15)
    shared = inside | (F.size(F.array_intersect(words("fk"), words(F.concat_ws(" ", "pk", "sk")))) > 0)
    rows = x.select("folder", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + move)), 3).alias("score"), shared.alias("shared")).collect()
    return [tuple(r) for r in rows if r["score"] >= least]


@pytest.mark.parametrize("least", [0.3, 0.55, 0.7, 0.95])
def test_pairs_of_the_tree_are_those_of_every_pair(spark, monkeypatch, least):
    x, y = _rows(60)
    f, p = _frames(spark, x, y)
    want = sorted((int(r[0][2:]), r[1]) for r in _every_pair(f, p, least) if r[3])
    for bushy in (1, 8):
        monkeypatch.setattr(alike, "BUSHY", bushy)
        got = [(i, j) for a, b, raw in alike.scores(x, y, least, False) for i, j, s in zip(a.tolist(), b.tolist(), raw.tolist(), strict=True) if round(s + 1e-12, 3) >= least]
        assert sorted(got) == want and want


def test_scores_need_no_join_of_words(spark):
    f, p = _frames(spark, *_rows(60))
    scores = images.score_matches(f, p, 0.55)
    assert sorted(map(tuple, scores.collect())) == sorted(r[:3] for r in _every_pair(f, p, 0.55) if r[3])
    assert "Join" not in scores._jdf.queryExecution().executedPlan().toString()


def test_most_pairs_are_never_looked_at():
    names = [f"{a} {b} {i}" for i, (a, b) in enumerate((a, b) for _ in range(40) for a in ("hot", "old", "small", "large") for b in ("ring", "gizmo", "plate", "anvil"))]
    x = {"k": names[::5], "category": [None] * 128, "subcategory": [None] * 128}
    y = {"k": names, "sk": [f"p {i}" for i in range(len(names))], "category": [None] * len(names), "subcategory": [None] * len(names)}
    words = {}
    f, p = alike.Keys(x["k"], words), alike.Keys(y["k"], words)
    p.tree()
    seen = sum(len(i) for i, _, _ in alike.near(f, alike.np.arange(128), p, 0.7))
    shared = sum(bool(set(a.split()) & set(b.split())) for a in x["k"] for b in names)
    assert 0 < seen < shared / 3


def test_scores_of_every_pair(spark):
    f, p = _frames(spark, *_rows(60))
    want = _every_pair(f, p, 0.3)
    got = images.score_matches(f, p, 0.3, every=True)
    assert sorted(map(tuple, got.collect())) == sorted(r[:3] for r in want) and not all(r[3] for r in want)


@pytest.fixture(scope="module")
def wordless(spark, tmp_path_factory):
    """A folder and a product without a common word whose names are nearly the same."""
    root = str(tmp_path_factory.mktemp("wordless"))
    parts = spark.createDataFrame([(12345678903, "old rod"), (12345678904, "cold bolt")], "p_partkey long, p_name string")
    parts.withColumn("p_type", F.lit("SMALL")).write.parquet(f"{root}/part.parquet")
    return root


def _both(spark, root, name):
    """Rows of the query and of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{root}/part.parquet/*.parquet'")
    return sorted(map(tuple, entry.queries()[name](spark, root).collect())), sorted(c.execute(entry.oracle_sql()[name]).fetchall())


def test_assign_folders_links_names_without_a_common_word(spark, wordless):
    got, want = _both(spark, wordless, "assign_folders")
    assert got == want == [("Other/old rod 12345678903", 12345678904, 0.724)]


def test_unmatched_folders_have_no_product_without_a_common_word(spark, wordless):
    got, want = _both(spark, wordless, "unmatched_folders")
    assert got == want == []


def test_links_by_falling_bounds_are_those_of_all_pairs(spark, monkeypatch):
    from shelfspark.sources import scratch

    x, y = _rows(60)
    f, p = _frames(spark, x, y)
    used, want = set(), []
    for folder, i, score, _ in sorted(_every_pair(f, p, 0.3), key=lambda r: (-r[2], r[0], r[1])):
        if not {folder, i} & used:
            used |= {folder, i}
            want.append((folder, i, score))
    asked, one = [], images.score_matches

    def score_matches(f, p, least, every):
        asked.append((least, f.count(), p.count()))
        return one(f, p, least, every)

    monkeypatch.setattr(images, "score_matches", score_matches)
    monkeypatch.setattr(images, "BOUNDS", (0.85, 0.6))
    got = images.links(f, p, 0.3, scratch.save, every=True)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # below a bound only those are asked that are still free
    assert [a[0] for a in asked] == [0.85, 0.6, 0.3] and 60 == asked[0][1] > asked[1][1] > asked[2][1]


@pytest.mark.parametrize("piece", [7, 100_000])
def test_best_scores_give_the_same_suggestions(spark, monkeypatch, piece):
    x, y = _rows(60)
    y = {c: [*v, *v[:20]] for c, v in y.items()}  # equal scores
    f, p = _frames(spark, x, y)
    monkeypatch.setattr(images, "PIECE", piece)
    few, every = images.score_matches(f, p, 0.3, best=3), images.score_matches(f, p, 0.3)
    want = {}
    for folder, i, score, shared in sorted(_every_pair(f, p, 0.3), key=lambda r: (r[0], -r[2], r[1])):
        if shared and len(want.setdefault(folder, [])) < 3:
            want[folder].append((folder, i, score, len(want[folder]) + 1))
    assert sorted(map(tuple, images.suggestions(few).collect())) == sorted(r for rows in want.values() for r in rows)
    assert few.count() < every.count()


@pytest.mark.parametrize("name, every", [("unmatched_folders", True), ("photo_overview", False)])
def test_folders_ask_low_bounds_of_few(spark, monkeypatch, name, every):
    import __spark_entry__ as entry

    asked, one = [], images.score_matches

    def score_matches(f, p, least, every):
        asked.append((least, f.count(), every))
        return one(f, p, least, every)

    monkeypatch.setattr(images, "score_matches", score_matches)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert [(a[0], a[2]) for a in asked] == [(0.85, every), (0.7, every)] and asked[1][1] < 0.6 * asked[0][1]


def test_overview_counts_links_as_its_sql_does(spark, wordless):
    got, want = _both(spark, wordless, "photo_overview")
    assert got == want == [(1, 3, 0, 1, 1)]


def test_small_blocks_of_links_are_dealt_together(spark, tmp_path, monkeypatch):
    def save(df):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        df.write.parquet(path)
        return spark.read.parquet(path)

    log = tmp_path.parent / f"{tmp_path.name}-calls"
    log.mkdir()
    one = images._greedy

    def greedy(pairs):
        (log / f"{id(pairs)}-{pairs['folder'].min()}").touch()
        return one(pairs)

    monkeypatch.setattr(images, "_greedy", greedy)
    pairs = [(f"f{i:03}", 2 * i + d, 0.8) for i in range(300) for d in (1, 0)]
    got = images._by_blocks(spark.createDataFrame(pairs, "folder string, id long, score double"), save, 200)
    assert sorted(map(tuple, got.select("folder", "id", "score").collect())) == [(f"f{i:03}", 2 * i, 0.8) for i in range(300)]
    assert len(list(log.iterdir())) <= 4
