"""What large tables and odd values showed: joins that broadcast, rows in one task, halves that rounded up."""

import random

from pyspark.sql import functions as F

from shelfspark.functions import display, text
from shelfspark.operators import images, quality, search, substrings
from shelfspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_substrings_by_length_and_by_index(spark):
    texts = ["XM-12B", "M-1, M-12", "ZZ-7", "", None, "a%b_c"]
    patterns = ["M-1", "M-12", "ZZ", "%b_", "M-123456", "", None]
    t, p = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in patterns], "pattern string")
    want = sorted((a, b) for a in texts if a for b in patterns if b and b in a)
    for lengths in (32, 1):
        found = substrings.found(t, p, lengths=lengths)
        assert sorted(map(tuple, found.collect())) == want
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert substrings.found(t, p.where("false")).count() == 0


def test_halves_go_to_even_and_binary_values_count(spark):
    row = spark.createDataFrame([(12.25, 12.35, 12250.0, 100500.0, -0.75, None)], "a double, b double, c double, d double, e double, f double")
    shown = row.select(*(display.percent(F.col(c)) for c in "abef"), *(display.money_compact(F.col(c), F.lit("EGP")) for c in "cd")).first()
    assert list(shown) == ["12.2%", "12.3%", "-0.8%", "—", "12.2K EGP", "100K EGP"]


def test_collision_members_have_their_number_of_links(spark):
    rows = spark.createDataFrame([(i, f"p{i}", "c", "A-1" if i < 30 else "B-1" if i < 31 else None) for i in range(35)], "id long, name string, source_catalog string, sku string")
    got = quality.collision_members(rows).collect()
    assert sorted((r["id"], r["n_others"]) for r in got) == [(i, 29) for i in range(30)]


def test_search_stems_what_is_asked_only(spark):
    texts = ["ponies and pony cried", "hopping hoped hop hope", "the ties tie tied", "sky skies", "", None, "matting mated mats red"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, name string")
    index = search.postings(rows, ("name",))
    for query in ("pony", "hopping tied", "hope -hopped", "skies sky mate", "s", "", "-red mat"):
        assert sorted(map(tuple, search.ranked(rows, query, ("name",)).collect())) == sorted(map(tuple, search.ranked(rows, query, ("name",), index=index).collect())), query


def test_costly_rows_are_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for name in ("normalize_brand", "normalize_category"):
        assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= cores
    assert "REPARTITION_BY_NUM" in QUERIES["import_products"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_folders_and_products_are_made_once_in_lots(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: rng.choice(["red", "bolt", "ring", "hub", "old"])
    folders = [(f"C/{i}", rng.choice(["Cables", None]), rng.choice([None, "x"]), rng.choice(["", f"{word()} {word()} {i}", f"{word()} A-{i:03}b"])) for i in range(60)]
    products = [(i, rng.choice(["Cables", "Hubs"]), rng.choice([None, "x", "y"]), rng.choice([f"{word()} {word()} {i}", word(), "", None]), rng.choice([f"A-{i:03}", "red", None])) for i in range(60)]
    f = spark.createDataFrame(folders, "folder string, category string, subcategory string, title string")
    p = spark.createDataFrame(products, "id long, category string, subcategory string, name string, sku string")
    key = lambda c: text.normalize_key(F.col(c))
    x = f.select("folder", "category", F.col("subcategory").alias("sub"), key("title").alias("fk")).crossJoin(p.select("id", F.col("category").alias("pc"), F.col("subcategory").alias("ps"), key("name").alias("pk"), key("sku").alias("sk")))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    inside = (F.length("sk") >= 4) & F.contains("fk", "sk")
    x = x.where((F.size(F.array_intersect(words("fk"), words(F.concat_ws(" ", "pk", "sk")))) > 0) | inside)
    few, many = F.when(F.length("fk") <= F.length("pk"), words("fk")).otherwise(words("pk")), F.when(F.length("fk") <= F.length("pk"), words("pk")).otherwise(words("fk"))
    base = F.greatest(text.key_similarity(F.col("fk"), F.col("pk")), text.key_similarity(F.col("fk"), F.col("sk")), F.when(inside, 0.95).otherwise(0.0), F.when((F.size(few) > 0) & (F.size(F.array_except(few, many)) == 0), 0.78).otherwise(0.0))
    move = F.when(F.col("category") == F.col("pc"), 0.08).otherwise(0.0) + F.when(F.col("sub").isNull() | F.col("ps").isNull(), 0.0).when(F.col("sub") == F.col("ps"), 0.06).otherwise(-0.15)
    want = sorted(map(tuple, x.select("folder", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + move)), 3).alias("score")).where("score >= 0.5").collect()))
    for lot in (1, 100):
        monkeypatch.setattr(images, "LOT", lot)
        scores = images.score_matches(f, p, 0.5)
        assert sorted(map(tuple, scores.collect())) == want and len(want) > 50
    assert scores._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
