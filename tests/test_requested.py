"""Requests and edits checked, pages, quotes over tables, the dashboard in one pass, delimited files by lines, running sums and slugs of hot keys."""

import threading

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import analytics, pricing, requests, slugs
from shelfspark.operators.running import running_sum
from shelfspark.plans import requested
from shelfspark.sources import scratch, workbook, workbook_format


def test_one_request_is_checked_as_a_table_of_them(spark):
    asked = [{}, {"page": "2", "limit": "200", "min_price": " 5 ", "max_price": "1e2", "brand": "a, b,,", "sort": "name"}, {"min_price": "0", "max_price": "0"}, {"is_active": "TRUE", "limit": "201"}, {"min_margin": "7", "max_margin": "3"}, {"max_quantity": "1.5", "currency": "EUR"}, {"min_quality": "nan", "page": "", "else": "x"}]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, given map<string,string>")
    got = {r["id"]: r for r in requests.checked(rows).collect()}
    for i, given in enumerate(asked):
        try:
            filters, page, limit, sort = requests.admin_query(given)
            assert got[i]["errors"] == [] and (got[i]["page"], got[i]["limit"], got[i]["sort"]) == (page, limit, sort)
            assert filters == got[i]["numbers"] | got[i]["flags"] | got[i]["lists"] | got[i]["texts"]
        except requests.Invalid as e:
            assert got[i]["errors"] == [f"{k}: {v}" for k, v in sorted(e.errors.items())]
    assert [bool(got[i]["errors"]) for i in range(7)] == [False, False, False, True, True, True, True]


def test_requests_that_are_null_or_none(spark):
    none = requests.checked(spark.createDataFrame([(1, None)], "id int, given map<string,string>")).first()
    assert (none["errors"], none["page"], none["limit"], none["numbers"]) == ([], 1, 25, {})
    assert requests.checked(spark.createDataFrame([], "id int, given map<string,string>")).count() == 0


def test_edits_and_bulk_bodies(spark):
    body = requests.bulk_body([{"id": 1, "patch": {"rdp": -1, "is_active": True}}, {"id": 2, "patch": {"name": None}}])
    assert body == [(1, "rdp", "-1", 0), (1, "is_active", "true", 1), (2, "name", None, 2)]
    got = requests.checked_edits(spark.createDataFrame(body, "id int, field string, value string, seq int")).orderBy("seq").collect()
    assert [r["error"] for r in got] == ["under 0", None, None]
    for bad in ([], [{"id": 1}] * 2, [{"id": 1, "patch": {"a": 1}}] * 201):
        with pytest.raises(requests.Invalid):
            requests.bulk_body(bad)


def test_pages(spark):
    for n, page in ((0, 1), (20, 1), (21, 1), (21, 2)):
        meta, row = requests.page_meta(n, page, 20), requests.page_row(spark.range(n), page, 20).first()
        assert list(meta.values()) == list(row)
    told = requests.envelope(spark.range(30).orderBy("id"), 2, 25)
    assert [r["id"] for r in told["data"]] == [25, 26, 27, 28, 29] and told["meta"]["hasNext"] is False


def test_quotes_agree_with_one_quote(spark):
    rows = spark.createDataFrame([(100.0, 150.0, None, "EGP"), (100.0, None, 130.0, "USD"), (0.0, 5.0, None, "EGP"), (None, None, None, None)], "rdp double, selling_price double, rrp double, currency string")
    got = pricing.quotes(rows).collect()
    assert got[0] == pricing.quote(spark, 100, 150).first() and got[1] == pricing.quote(spark, 100, None, 130, "USD").first()
    assert (got[2]["break_even"], got[2]["price_at_target"], got[3]["margin"]) == (None, None, None)


def test_dashboard_groups_are_the_single_views(spark):
    scored = requested._scored(spark, "/root/testdata/sf0.001").cache()
    groups = analytics.dashboard_groups(scored).cache()
    of = lambda view, *names: sorted(map(tuple, groups.where(F.col("view") == view).select(*names).collect()), key=str)
    rows = lambda df, *names: sorted(map(tuple, df.select(*names).collect()), key=str)
    own = ("products", "units", "cost", "retail", "avg_margin", "profit")
    assert of("category", "group", *own) == rows(analytics.inventory_value(scored), "group", *own)
    assert of("procurement", "group", *own) == rows(analytics.procurement_baskets(scored), "procurement", *own)
    assert of("band", "group", "products", "avg_margin", "cost") == rows(analytics.margin_bands(scored), "band", "products", "avg_margin", "cost")
    assert of("supplier", "group", "products", "cost", "must_buy", "avoid") == rows(analytics.supplier_breakdown(scored), "supplier", "products", "spend", "must_buy", "avoid")
    assert of("summary", *own, "verified", "priced", "avg_score") == rows(analytics.summary(scored), *own, "verified", "priced", "avg_score")
    assert groups.where("view = 'summary'").count() == 1


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {"a.csv": [f"{i},x{'y' * (i % 40)}" for i in range(3000)], "b +c.csv": ["one", "", '"q, ""r""",2'], "empty.csv": []}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes("".join(x + ("\r\n" if name == "a.csv" else "\n") for x in lines).encode())
    (tmp_path / "last.csv").write_text("﻿ü,1\nno end")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = workbook.lines(spark, str(tmp_path))
        assert got.select("line").count() == 3005
        found = {}
        for r in got.orderBy("file", "row_index").collect():
            found.setdefault(r["file"], []).append((r["row_index"], r["line"]))
        texts["last.csv"] = ["ü,1", "no end"]
        assert found == {name: list(enumerate(lines, 1)) for name, lines in texts.items() if lines}
        cells = workbook.read_delimited(spark, str(tmp_path), names="b*").orderBy("row_index").collect()
        assert [r["cells"] for r in cells] == [["one"], [None], ['q, "r"', "2"]] and cells[0]["sheet"] == "b +c"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_workbooks_are_found_from_another_thread(spark, tmp_path):
    path, seen = str(tmp_path / "w.xlsx"), []

    def work():
        workbook_format.write({"s": spark.range(3).selectExpr("cast(id as string) AS id")}, path)
        seen.append(workbook_format.read(spark, path).count())

    t = threading.Thread(target=work)
    t.start()
    t.join()
    assert seen == [4]


def test_running_sums_of_a_hot_key(spark):
    given = [("hot" if i % 3 else None if i % 7 == 0 else f"k{i % 5}", (i * 37) % 2001, i, i % 4) for i in range(2000)]
    rows = spark.createDataFrame(given, "key string, at long, id long, v long")
    cut = []

    def save(df):
        cut.append(scratch.save(df))
        return cut[-1]

    got = {r["id"]: r["total"] for r in running_sum(rows, ("key",), ("at", "id"), F.col("v"), "total", save).collect()}
    sums, want = {}, {}
    for key, at, i, v in sorted(given, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = sums[key] = sums.get(key, 0) + v
    assert got == want
    ranges = cut[0].where("key = 'hot'").groupBy("_range").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 1000
    assert running_sum(rows.limit(0), ("key",), ("at", "id"), F.col("v"), "total", scratch.save).isEmpty()


def test_a_slug_that_most_products_want(spark):
    rows = [(f"f{i:04}", (i * 53) % 997, "Cable", None, None) for i in range(997)] + [("own", 2000, "Plug", None, None)]
    reserved = [(f"cable-{n}", "gone") for n in range(2, 900, 3)] + [("cable", "gone")]
    shape = "fingerprint string, arrival long, name string, sku string, slug string"
    # the first to arrive finds the clean slug taken and is numbered like all others
    held, free = {s for s, _ in reserved}, 2
    want = {"own": "plug"}
    for fingerprint, _, *_ in sorted(rows[:-1], key=lambda r: r[1]):
        while f"cable-{free}" in held:
            free += 1
        want[fingerprint] = f"cable-{free}"
        free += 1
    for hot in (0, 10_000):
        got = {r["fingerprint"]: r["slug"] for r in slugs.resolve(spark.createDataFrame(rows, shape), spark.createDataFrame(reserved, "slug string, owner string"), scratch.save, hot).collect()}
        assert got == want
