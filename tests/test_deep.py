"""Substring joins, ranked search, workbooks, listings, nested products, ordered merges, recalculation, components."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import identity
from shelfspark.operators import fold, graph, images, imports, nested, pricing, reports, search, substrings
from shelfspark.operators.pricing import with_pricing
from shelfspark.plans import samples
from shelfspark.sources import scratch, workbook_format
from shelfspark.sources.testdata import products

SF = "/root/testdata/sf0.001"


def test_substrings_against_all_pairs(spark):
    random.seed(5)
    word = lambda n: "".join(random.choice("AB-1") for _ in range(n))
    texts, patterns = [word(random.randrange(0, 14)) for _ in range(300)] + [None], [word(random.randrange(0, 9)) for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, sku string")
    listed = spark.createDataFrame([(p,) for p in patterns], "sku string")
    want = {i for i, t in enumerate(texts) if t and any(p and p in t for p in patterns)}
    assert {r["id"] for r in substrings.holding(rows, "sku", listed, "sku").collect()} == want
    assert {r["id"] for r in reports.unlisted(rows, listed).collect()} == set(range(301)) - want
    assert substrings.holding(rows, "sku", listed.limit(0), "sku").isEmpty() and reports.unlisted(rows, listed.limit(0)).count() == 301


def test_listed_sku_inside_a_longer_word(spark):
    rows = spark.createDataFrame([(1, "XJR-QP192B"), (2, "JR-QP19"), (3, "")], "row_id long, sku string")
    assert {r["row_id"] for r in reports.unlisted(rows, spark.createDataFrame([("JR-QP192",)], "sku string")).collect()} == {2, 3}


def test_stems(spark):
    words = ["caresses", "ponies", "cats", "boss", "agreed", "feed", "plastered", "motoring", "sing", "conflated", "hopping", "falling", "happy", "sky", "as", "p77s"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(search.stem(F.col("w"))).collect()]
    assert got == ["caress", "poni", "cat", "boss", "agree", "feed", "plaster", "motor", "sing", "conflate", "hop", "fall", "happi", "sky", "as", "p77s"]


def test_search_scores(spark):
    rows = spark.createDataFrame([(1, "red cables and a red cable", "Anker"), (2, "cable", None), (3, "blue plug", "cable"), (4, "the hub", "x"), (5, None, None)], "id long, name string, brand string")
    got = {r["id"]: r["score"] for r in search.ranked(rows, "Cables").collect()}
    # of row 1's four words two are the stem: (0.5 + 0.5 * 2 / 4) * 1.5; a field that is the stem alone counts a tenth more
    assert got == {1: 1.125, 2: 1.1, 3: 1.1}
    assert {r["id"] for r in search.ranked(rows, "cable -plug").collect()} == {1, 2}
    assert {r["id"] for r in search.ranked(rows, '"red cable"').collect()} == {1} and search.ranked(rows, "the and").isEmpty()
    saved = search.postings(rows)
    assert [(r["id"], r["score"]) for r in search.top(rows, "cable", 2, index=saved).collect()] == [(1, 1.125), (2, 1.1)]


@pytest.fixture
def report(spark, tmp_path):
    path = str(tmp_path / "r.xlsx")
    long = spark.range(0, 5000, 1, 7).select(F.col("id").alias("N"), F.concat(F.lit("name <&> "), "id").alias("Name"), (F.col("id") / 4).alias("Share")).orderBy(F.desc("N"))
    empty = spark.createDataFrame([], "A string, B long")
    odd = spark.createDataFrame([("é\x01", None), (None, 1.5), ("x" * 100, -2.0)], "Text string, Number double").coalesce(1)
    workbook_format.write({"Long": long, "Empty": empty, "Odd & so": odd}, path)
    return path


def test_workbook_round_trip(spark, report):
    rows = workbook_format.read(spark, report)
    got = {s: [(r["row_index"], r["cells"], r["width"]) for r in rows.where(F.col("sheet") == s).orderBy("row_index").collect()] for s in ("Long", "Empty", "Odd & so")}
    assert got["Empty"] == [] and len(got["Long"]) == 5001 and got["Long"][0] == (1, ["N", "Name", "Share"], 3)
    assert got["Long"][1] == (2, ["4999", "name <&> 4999", "1249.75"], 3) and got["Long"][-1] == (5001, ["0", "name <&> 0", "0"], 3)
    assert [c for _, c, _ in got["Odd & so"]] == [["Text", "Number"], ["é", None], [None, "1.5"], ["x" * 100, "-2"]]
    with zipfile.ZipFile(report) as z:
        long, odd = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/worksheets/sheet3.xml").decode()
        assert z.testzip() is None and 'ref="A1:C5001"' in long and '<col min="2" max="2" width="15"' in long and 'width="70"' in odd
    assert not [x for x in __import__("os").listdir(report.rsplit("/", 1)[0]) if x.endswith(".parts")]


def test_workbook_is_not_replaced_unasked(spark, report):
    other = spark.createDataFrame([("b",)], "A string")
    with pytest.raises(Exception, match="FileExistsError"):
        workbook_format.write({"S": other}, report)
    workbook_format.write({"S": other}, report, overwrite=True)
    assert [r["cells"] for r in workbook_format.read(spark, report).orderBy("row_index").collect()] == [["A"], ["b"]]


def test_gates_and_refusals(spark, tmp_path):
    assert workbook_format.supported("A.XLSX") and workbook_format.supported("a.csv", "upload") and not workbook_format.supported("a.tsv", "upload") and not workbook_format.supported("a.xls")
    (tmp_path / "old.xls").write_bytes(b"")
    with pytest.raises(Exception, match="cannot read"):
        workbook_format.read(spark, str(tmp_path / "old.xls")).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        workbook_format.read(spark, str(tmp_path / "none.xlsx")).collect()
    assert workbook_format.read(spark, str(tmp_path)).isEmpty()


def test_listing_of_a_tree(spark, tmp_path):
    for name in ("Cables/Long one/1.JPG", "Cables/Long one/Black & blue/2.jfif", "Cables/Long one/notes.txt", "Cables/loose.png", "Hubs/Ünï #1/a b.webp", "Cables/Bare/readme.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    (tmp_path / "Cables/Nothing/Inside").mkdir(parents=True)
    listed = images.list_files(spark, str(tmp_path))
    assert {r["path"] for r in listed.collect()} == {"Cables/Long one/1.JPG", "Cables/Long one/Black & blue/2.jfif", "Cables/Long one/notes.txt", "Cables/loose.png", "Hubs/Ünï #1/a b.webp", "Cables/Bare/readme.md"}
    assert {(r["folder"], r["n_images"]) for r in images.folders(listed).collect()} == {("Cables/Long one", 2), ("Hubs/Ünï #1", 1)}
    assert images.list_files(spark, str(tmp_path / "absent")).isEmpty()


def test_components(spark):
    random.seed(2)
    edges = [(f"n{random.randrange(300):03}", f"n{random.randrange(300):03}") for _ in range(200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a string, b string"), scratch.save).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a string, b string"), scratch.save).isEmpty()


SHAPE = "fingerprint string, id long, name string, pricing struct<rdp:double,currency:string>, specs struct<features:array<string>,attributes:map<string,string>>, status struct<is_verified:boolean,lifecycle:string>, metadata struct<locked_fields:array<string>,overrides:array<struct<field:string,previous:string,next:string,reason:string,by:string>>>"


def nested_rows(spark):
    rows = [("a", 1, "x", (1.0, "EGP"), (["f"], {"k": "v"}), (False, "review"), ([], [])), ("b", 2, "y", (2.0, None), (None, None), (True, "approved"), (["pricing"], None)), (None, 3, None, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE)


def test_nested_patch(spark):
    edits = [(1, "pricing.rdp", "5"), (1, "specs.attributes", '{"k":"w"}'), (2, "specs.features", '["n"]'), (2, "status.is_verified", "true"), (3, "name", None), (9, "name", "z")]
    got = {r["id"]: r for r in nested.patch(nested_rows(spark), spark.createDataFrame(edits, "id long, path string, value string"), reason="why").collect()}
    one = got[1]
    assert (one["pricing"]["rdp"], one["pricing"]["currency"], one["specs"]["attributes"], one["specs"]["features"]) == (5.0, "EGP", {"k": "w"}, ["f"]) and one["outcome"] == "updated"
    assert one["metadata"]["locked_fields"] == ["pricing.rdp", "specs.attributes"] and [o["next"] for o in one["metadata"]["overrides"]] == ['{"v":5.0}', '{"v":{"k":"w"}}']
    assert got[2]["outcome"] == "failed" and got[2]["invalid"] == ["status.is_verified"] and got[2]["specs"]["features"] is None
    assert got[3]["outcome"] == "unchanged" and len(got) == 3 and len(nested.EDITABLE_PATHS) == 41
    assert {r["outcome"] for r in nested.patch(nested_rows(spark), spark.createDataFrame([], "id long, path string, value string")).collect()} == {None}


def test_nested_upsert_keeps_what_is_locked(spark):
    drafts = nested_rows(spark).where("id < 3").select("fingerprint", F.struct((F.col("pricing.rdp") + 1).alias("rdp")).alias("pricing"), F.struct(F.lit("review").alias("lifecycle")).alias("status"))
    new = spark.createDataFrame([("c", (9.0,), ("draft",))], "fingerprint string, pricing struct<rdp:double>, status struct<lifecycle:string>")
    got = {r["fingerprint"]: r for r in nested.upsert(nested_rows(spark), drafts.unionByName(new)).collect()}
    assert got["a"]["pricing"]["rdp"] == 2.0 and got["a"]["specs"]["features"] == ["f"] and got["a"]["locks_kept"] == 0
    assert got["b"]["pricing"]["rdp"] == 2.0 and got["b"]["status"]["lifecycle"] == "approved" and got["b"]["locks_kept"] == 2
    assert got["c"]["outcome"] == "created" and got["c"]["pricing"]["rdp"] == 9.0 and got[None]["outcome"] == "kept"
    with pytest.raises(ValueError, match="lack"):
        nested.upsert(nested_rows(spark), new.withColumn("more", F.lit(1)))


def test_fill_missing(spark):
    shape = "a struct<x:string,y:struct<l:array<int>,n:int>>, b struct<x:string,y:struct<l:array<int>,n:int>>"
    df = spark.createDataFrame([((" ", ([], 0)), ("t", ([1], 5)))], shape)
    got = df.select(nested.fill_missing(df.schema["a"].dataType, "a", "b").alias("m")).first()["m"]
    assert got["x"] == "t" and got["y"]["l"] == [1] and got["y"]["n"] == 0


def test_fold_differs_from_the_best_row(spark):
    # the merged row of 1 and 2 is worth 85, less than the third row's 90, though the first alone is worth more
    rows = [("k", 95.0, 1, "a", None, "n1"), ("k", 10.0, 2, None, "b", "n2"), ("k", 90.0, 3, "c", None, "n1"), (None, 1.0, 4, "z", None, None), (None, 2.0, 5, "z", None, None)]
    drafts = spark.createDataFrame(rows, "fingerprint string, score double, row_index int, p string, q string, notes string").withColumns({"file": F.lit("f"), "sheet": F.lit("s")})
    got = [tuple(r) for r in fold.dedupe(drafts, ["p", "q"]).select("fingerprint", "row_index", "p", "q", "score", "notes", "n_sources").orderBy("row_index").collect()]
    assert got == [("k", 3, "c", "b", 85.0, ["n1", "n2"], 3), (None, 4, "z", None, 1.0, [], 1), (None, 5, "z", None, 2.0, [], 1)]
    assert fold.dedupe(drafts.limit(0), ["p", "q"]).isEmpty()


def test_recalculation_counts_what_it_writes(spark, tmp_path):
    stored = with_pricing(products(spark, SF, supplier=False)).withColumn("margin", F.when(F.col("id") % 5 == 0, F.col("margin") + 1).otherwise(F.col("margin")))
    n, stale = stored.count(), stored.where("id % 5 = 0 and margin is not null").count()
    assert pricing.recalculate(stored, None) == {"examined": n, "changed": stale, "written": 0, "dry_run": True}
    path = str(tmp_path / "t")
    assert pricing.recalculate(stored, lambda d: d.write.parquet(path)) == {"examined": n, "changed": stale, "written": n, "dry_run": False}
    assert pricing.recalculate(spark.read.parquet(path), None)["changed"] == 0 and spark.read.parquet(path).columns == stored.columns


def test_import_run_keeps_sheets_and_skipped_rows(spark):
    grid = samples.grid(spark, SF)
    audits = []
    stored = spark.createDataFrame([], "fingerprint string, name string, rdp double, is_verified boolean, is_active boolean, lifecycle string, locked_fields array<string>")
    imports.run(spark, "r1", "parts", grid, stored, lambda d: d.write.format("noop").mode("overwrite").save(), lambda d: audits.append(d.first()), scratch.save)
    assert audits[0]["status"] == "completed" and len(audits[0]["sheet_reports"]) == 5 and audits[0]["skipped_rows"][0]["reason"] == "title"
    with pytest.raises(ValueError):
        imports.run(spark, "r2", "parts", grid, stored, lambda d: (_ for _ in ()).throw(ValueError("no room")), lambda d: audits.append(d.first()), scratch.save)
    assert audits[1]["status"] == "failed" and audits[1]["error"] == "no room" and audits[1]["sheet_reports"] is None


def test_locale_order(spark):
    names = ["zebra", "Éclair", "apple", "Zoo", "eclipse", "شاحن", "كابل", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(*reports.by_locale("n")).collect()]
    assert got == [None, "apple", "Éclair", "eclipse", "zebra", "Zoo", "شاحن", "كابل"]


def test_approved_skus_without_sheets_or_columns(spark):
    grid = spark.createDataFrame([("f", "Must Buy", 1, ["x"]), ("f", "Must Buy", 3, ["Product", None]), ("f", "Must Buy", 4, ["p", "s"])], "file string, sheet string, row_index int, cells array<string>")
    assert reports.approved_skus(grid).isEmpty() and reports.approved_skus(grid.limit(0)).isEmpty()


def test_skus_of_odd_cells(spark):
    cells = ["JR-TCG13", "JR-QP192 Mini", "JR-PK1 → JR-PR1", "Robovac G50 Hybrid (T2212)", "SmartTrack Card, Android (T87B5011)", "", "-", "n/a", "USD $5-15 est., unverified EGP", None]
    got = [r["s"]["sku"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(identity.normalize_sku(F.col("c")).alias("s")).collect()]
    assert got == ["JR-TCG13", "JR-QP192 Mini", "JR-PR1", "T2212", "T87B5011", None, None, None, None, None]
