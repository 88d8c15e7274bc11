"""Operators on small tables: upserts, imports, links, pages and duplicates."""

import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog, images, ingest, pricing, quality, slugs, store
from shelfspark.sources import scratch
from shelfspark.sources import workbook
from shelfspark.sources.testdata import products

SF = "/root/testdata/sf0.001"


def test_quote(spark):
    r = pricing.quote(spark, 440, 750).first()
    assert (r["margin"], r["gross_margin"], r["price_at_target"], r["band"]) == (70.45, 41.33, 677.6, "target")
    with pytest.raises(ValueError):
        pricing.quote(spark, -1, 5)


def test_upsert_keeps_locks_and_is_idempotent(spark):
    stored = spark.createDataFrame([("a", 1.0, "x", True, ["rdp"]), ("b", 2.0, "y", False, [])], "fingerprint string, rdp double, lifecycle string, is_verified boolean, locked_fields array<string>")
    drafts = spark.createDataFrame([("a", 9.0, "z"), ("b", 8.0, "z"), ("c", 7.0, "z")], "fingerprint string, rdp double, lifecycle string")
    once = store.upsert(stored, drafts)
    got = {r["fingerprint"]: r for r in once.collect()}
    assert got["a"]["rdp"] == 1.0 and got["a"]["lifecycle"] == "x" and got["b"]["rdp"] == 8.0 and got["c"]["outcome"] == "created" and got["c"]["is_verified"] is False
    again = store.upsert(once.drop("outcome", "locks_kept"), drafts).collect()
    assert {r["outcome"] for r in again} == {"unchanged"}


def test_snapshots(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "t"))
    assert s.read() is None
    s.write(spark.range(3))
    s.write(s.read().where("id > 0"))
    assert s.read().count() == 2 and s.versions() == [1, 2]


def test_patches(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, []), (2, "b", 2.0, ["name"])], "id long, name string, rdp double, locked_fields array<string>")
    patches = spark.createDataFrame([(1, "rdp", "5"), (2, "name", "b"), (9, "rdp", "1"), (1, "score", "1")], "id long, field string, value string")
    got = {r["id"]: r for r in store.patch(rows, patches).collect()}
    assert got[1]["rdp"] == 5.0 and got[1]["locked_fields"] == ["rdp"] and got[2]["changed_fields"] == []
    assert sorted(r["outcome"] for r in store.patch_outcomes(rows, patches).collect()) == ["failed", "failed", "unchanged", "updated"]


def test_patches_of_one_field_and_bad_values(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, [])], "id long, name string, rdp double, locked_fields array<string>")
    patches = spark.createDataFrame([(1, "name", "b"), (1, "name", "c"), (1, "rdp", "abc")], "id long, field string, value string")
    r = store.patch(rows, patches).first()
    assert (r["name"], r["rdp"], r["changed_fields"]) == ("c", 1.0, ["name"])
    assert {(x["field"], x["outcome"]) for x in store.patch_outcomes(rows, patches).collect()} == {("name", "updated"), ("rdp", "failed")}


def test_create_locks_what_is_given(spark):
    stored = spark.createDataFrame([("a", "x", 1.0, [])], "fingerprint string, name string, rdp double, locked_fields array<string>")
    new = spark.createDataFrame([("a", "y", 2.0), ("b", "z", None)], "fingerprint string, name string, rdp double")
    got = {(r["fingerprint"], r["outcome"]): r for r in store.create(stored, new).collect()}
    assert set(got) == {("a", "kept"), ("a", "conflict"), ("b", "created")} and got["b", "created"]["locked_fields"] == ["name"]


def test_slugs(spark):
    shape = "fingerprint string, arrival long, name string, sku string, slug string"
    rows = [("f1", 1, "Cable", "A", None), ("f2", 2, "Cable", "A", None), ("f3", 3, "Cable", "A", None), ("f4", 4, "Cable", None, None), ("f5", 5, "Cable A 2", None, None), ("f6", 6, "Plug", "B", None), ("f7", 7, "Plug", "B", "plug"), ("f8", 8, "Hub", "C", None)]
    reserved = spark.createDataFrame([("plug", "other"), ("plug-b-3", "f7"), ("hub", "f8")], "slug string, owner string")
    got = {r["fingerprint"]: r["slug"] for r in slugs.resolve(spark.createDataFrame(rows, shape), reserved, lambda d: d.cache()).collect()}
    assert got == {"f1": "cable", "f2": "cable-a", "f3": "cable-a-3", "f4": "cable-2", "f5": "cable-a-2", "f6": "plug-b", "f7": "plug-b-3", "f8": "hub"}
    assert slugs.resolve(spark.createDataFrame([], shape), reserved, lambda d: d.cache()).isEmpty()


def test_slugs_of_two_bases_meet(spark):
    shape = "fingerprint string, arrival long, name string, sku string, slug string"
    rows = [("a1", 1, "x", None, "x"), ("a2", 2, "x", None, "x"), ("b1", 3, "x", "2", "y"), ("b2", 4, "x", "2", "y"), ("b3", 5, "x", "2", "y")]
    got = {r["fingerprint"]: r["slug"] for r in slugs.resolve(spark.createDataFrame(rows, shape), spark.createDataFrame([], "slug string, owner string"), lambda d: d.cache()).collect()}
    assert got["a1"] == "x" and got["b1"] == "y" and got["a2"] == "x-2" and len(set(got.values())) == 5


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.65, 0.8])
def test_near_duplicates_lose_no_pair(spark, threshold):
    names = ["anker usb c cable 1m", "anker usb c cable 2m", "usb c cable anker 1m", "wall charger compact 25w", "wall charger compact 25 w", "wall charger compct 25w", "short", "shart", "shorter", "ab", "ac", "cable", "tables"] + [f"item number {i}" for i in range(20)]
    df = spark.createDataFrame([(i, n, "b", True) for i, n in enumerate(names)], "id long, name string, brand string, is_active boolean")
    fast = {(r["name_a"], r["name_b"]) for r in quality.near_duplicates(df, threshold).collect()}
    a, b = df.select(F.col("name").alias("a")), df.select(F.col("name").alias("b"))
    from shelfspark.functions.text import similarity

    slow = {(r["a"], r["b"]) for r in a.join(b, F.col("a") < F.col("b")).where(F.round(similarity(F.col("a"), F.col("b")), 3) >= threshold).collect()}
    assert fast == slow and len(slow) > 3


def test_public_projection_hides_costs(spark):
    shown = catalog.public(quality.with_quality(pricing.with_pricing(products(spark, SF))))
    assert not {"rdp", "margin", "supplier", "norm_rdp", "issues"} & set(shown.columns)


def test_links_are_one_to_one(spark):
    scores = spark.createDataFrame([("f", 1, 0.9), ("f", 2, 0.9), ("g", 1, 0.95), ("g", 2, 0.5), ("h", 2, 0.9)], "folder string, id long, score double")
    got = {(r["folder"], r["id"]) for r in images.assign(scores, scratch.save).collect()}
    assert got == {("g", 1), ("f", 2)}


def test_links_of_equal_and_falling_scores_are_all_made(spark, tmp_path):
    def save(df):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        df.write.parquet(path)
        return spark.read.parquet(path)

    equal = [(f"f{i:03}", j, 0.8) for i in range(60) for j in range(60)]
    falling = [(f"g{i:03}", 100 + i + d, 0.9 - 0.002 * (2 * i + d)) for i in range(70) for d in (0, 1)]
    pairs, used, want = [*equal, *falling], set(), set()
    for folder, i, score in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if folder not in used and i not in used:
            used |= {folder, i}
            want.add((folder, i))
    got = images.assign(spark.createDataFrame(pairs, "folder string, id long, score double"), save)
    assert sorted((r["folder"], r["id"]) for r in got.collect()) == sorted(want) and len(want) == 130
    few = spark.createDataFrame([x for x in pairs if x[0] < "f004" and x[1] < 4], "folder string, id long, score double")
    assert {(r["folder"], r["id"]) for r in images.assign(few, save, block=0).collect()} == {(f"f{i:03}", i) for i in range(4)}


def test_merge_of_repeated_drafts(spark):
    shape = "fingerprint string, score double, file string, sheet string, row_index int, rdp double, notes string, extras map<string,string>"
    rows = [("a", 1.0, "f", "s", i, float(i), f"n{i % 2}", {"x": str(i), f"y{i % 3}": str(i)}) for i in range(9)] + [("a", 5.0, "f", "s", 9, None, None, None), ("b", 2.0, "f", "s", 10, 3.0, None, {}), (None, 1.0, "f", "s", 11, 1.0, "n", {"k": "v"}), (None, 1.0, "f", "s", 12, 2.0, "n", {"k": "w"})]
    drafts = spark.createDataFrame(rows, shape)
    got = {r["fingerprint"]: r for r in ingest.dedupe(drafts).collect()}
    assert set(got) == {"a", "b", None} and (got["a"]["row_index"], got["a"]["rdp"], got["a"]["notes"], got["a"]["n_sources"]) == (9, 0.0, ["n0", "n1"], 10)
    assert got["a"]["extras"] == {"x": "0", "y0": "0", "y1": "1", "y2": "2"} and got["b"]["extras"] == {} and got[None]["extras"] == {"k": "v"}
    left = {(r["fingerprint"], r["row_index"]) for r in ingest.other_sources(drafts).collect()}
    assert left == {*(("a", i) for i in range(9)), (None, 12)} and ingest.dedupe(drafts.limit(0)).count() == 0


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Must Buy" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Product</t></si><si><t>RDP (EGP)</t></si><si><t>Qty</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>USB cable 1m</t></is></c><c r="B3"><v>45</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
    got = ingest.parse(workbook.read(spark, str(tmp_path / "a.xlsx"))).collect()
    assert [(r["name"], r["rdp"], r["quantity"], r["category"], r["procurement"]) for r in got] == [("USB cable 1m", 45.0, 7, "Cables", "must_buy")]
    with pytest.raises(ValueError):
        workbook.read(spark, "a.pdf")


def test_dates_and_folders(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {m}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" s="1"><v>45293</v></c><c r="B1" s="2"><v>45293.5</v></c><c r="C1" s="3"><v>45293</v></c><c r="D1"><v>7.0</v></c><c r="E1" s="1"><v>59</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.csv").write_text("x,y\n")
    (tmp_path / "c.tsv").write_text("p\tq\n")
    (tmp_path / "d.pdf").write_text("no")
    got = {(r["file"], r["row_index"]): r["cells"] for r in workbook.read(spark, str(tmp_path)).collect()}
    assert got["a.xlsx", 1] == ["2024-01-02T00:00:00.000Z", "2024-01-02T12:00:00.000Z", "45293", "7", "1900-02-28T00:00:00.000Z"]
    assert got["b.csv", 1] == ["x", "y"] and got["c.tsv", 1] == ["p", "q"] and not any(f == "d.pdf" for f, _ in got)
