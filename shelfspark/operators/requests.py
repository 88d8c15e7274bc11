"""What comes from outside, checked and typed before it reaches a query; pages as they are told of."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import catalog, store

#: Names that the admin list takes, by how their text is read.
NUMBERS = tuple(f"{end}_{r}" for end in ("min", "max") for r in catalog.RANGES)
FLAGS = (*catalog.FLAGS, "has_issues")
LISTS = ("brand", *(m for m in catalog.MEMBER if m != "currency"), "issue_code", "issue_severity")
TEXTS = ("search", "sku")
PAGE, MOST, BULK = 25, 200, 200
#: What numbers, texts and choices may be.
BOUNDS = {"price": (0, None, False), "margin": (None, None, False), "quality": (0, 100, False), "quantity": (0, None, True)}
LENGTHS = {"name": (2, 300), "brand": (0, 120), "category": (0, 120), "sku": (0, 120), "supplier": (0, 120)}
CHOICES = {
    "currency": ("EGP", "USD"), "procurement": ("must_buy", "test_buy", "avoid", "opportunity", "unclassified"),
    "lifecycle": ("not_started", "draft", "review", "approved", "published", "archived"), "condition": ("new", "used", "refurbished", "original_pull", "unknown"),
}
YES, NO = ("true", "1"), ("false", "0")
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_RANGED = ("price", "margin")  # their minimum may not pass their maximum; 0 counts as not given


class Invalid(ValueError):
    """What is wrong with each name."""

    def __init__(self, errors: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in sorted(errors.items())))
        self.errors = errors


def _number(text: object, low: float | None = None, high: float | None = None, integral: bool = False) -> float:
    given = str(text).strip()
    n = float(given) if re.fullmatch(_NUMBER, given) else math.nan
    if not math.isfinite(n):
        raise ValueError("not a number")
    if integral and not n.is_integer():
        raise ValueError("not a whole number")
    if low is not None and n < low:
        raise ValueError(f"under {low}")
    if high is not None and n > high:
        raise ValueError(f"over {high}")
    return n


def _flag(text: object) -> bool:
    if text is True or text in YES:
        return True
    if text is False or text in NO:
        return False
    raise ValueError("neither true nor false")


def admin_query(given: Mapping[str, object]) -> tuple[dict[str, object], int, int, str]:
    """Filters, page, limit and sort of an admin list; Invalid names everything that does not fit.

    Empty texts count as not given, names that the list does not know are passed over.
    """
    out: dict[str, object] = {}
    errors: dict[str, str] = {}
    page, limit = 1, PAGE
    for name, v in given.items():
        if v is None or v == "":
            continue
        try:
            if name in NUMBERS:
                out[name] = _number(v, *BOUNDS[name[4:]])
            elif name in FLAGS:
                out[name] = _flag(v)
            elif name in LISTS:
                out[name] = [x.strip() for x in (v.split(",") if isinstance(v, str) else list(v)) if x.strip()]
            elif name in TEXTS:
                out[name] = str(v).strip()
            elif name == "currency":
                if v not in CHOICES["currency"]:
                    raise ValueError("not one of EGP, USD")
                out[name] = v
            elif name == "page":
                page = int(_number(v, 1, None, True))
            elif name == "limit":
                limit = int(_number(v, 1, MOST, True))
        except ValueError as e:
            errors[name] = str(e)
    for r in _RANGED:
        low, high = out.get(f"min_{r}"), out.get(f"max_{r}")
        if low and high and low > high:
            errors[f"min_{r}"] = "over the maximum"
    if errors:
        raise Invalid(errors)
    return out, page, limit, str(given.get("sort") or "-updated")


def _numeric(text: Column) -> Column:
    n = F.when(F.trim(text).rlike(f"^{_NUMBER}$"), F.trim(text)).cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def _misfit(text: Column, low: float | None = None, high: float | None = None, integral: bool = False) -> Column:
    """What is wrong with a text that should be a number, null if nothing is."""
    n, no = _numeric(text), F.lit(False)
    out = F.when(n.isNull(), "not a number").when(n != F.floor(n) if integral else no, "not a whole number")
    return out.when(n < low if low is not None else no, f"under {low}").when(n > high if high is not None else no, f"over {high}")


def checked(requests: DataFrame, given: str = "given") -> DataFrame:
    """The rules of admin_query over a table of requests, whose `given` maps names to texts.

    Adds numbers, flags, lists and texts (maps by name, of what fits), currency, page, limit, sort, and errors
    (`name: what is wrong`, in the order of names). A null map is a request for everything.
    """
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))
    rows = requests.withColumn("_g", own)
    g = lambda name: F.col("_g")[name]
    rules = {n: _misfit(g(n), *BOUNDS[n[4:]]) for n in NUMBERS} | {n: F.when(~g(n).isin(*YES, *NO), "neither true nor false") for n in FLAGS}
    rules |= {"currency": F.when(~g("currency").isin(*CHOICES["currency"]), "not one of EGP, USD"), "page": _misfit(g("page"), 1, None, True), "limit": _misfit(g("limit"), 1, MOST, True)}
    for r in _RANGED:
        low, high = _numeric(g(f"min_{r}")), _numeric(g(f"max_{r}"))
        rules[f"min_{r}"] = F.coalesce(rules[f"min_{r}"], F.when(rules[f"max_{r}"].isNull() & (low != 0) & (high != 0) & (low > high), "over the maximum"))
    errors = F.array_compact(F.array(*(F.when(g(n).isNotNull(), F.concat(F.lit(f"{n}: "), rules[n])) for n in sorted(rules))))
    bad = F.transform("errors", lambda e: F.split(e, ": ")[0])
    of = lambda names: F.map_filter("_g", lambda k, v: k.isin(*names) & ~F.array_contains(bad, k))
    fits = lambda name: F.when(~F.array_contains(bad, name), g(name))
    return rows.withColumn("errors", errors).withColumns({
        "numbers": F.transform_values(of(NUMBERS), lambda k, v: _numeric(v)), "flags": F.transform_values(of(FLAGS), lambda k, v: v.isin(*YES)),
        "lists": F.transform_values(of(LISTS), lambda k, v: F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")), "texts": F.transform_values(of(TEXTS), lambda k, v: F.trim(v)),
        "currency": fits("currency"), "page": F.coalesce(_numeric(fits("page")), F.lit(1)).cast("long"), "limit": F.coalesce(_numeric(fits("limit")), F.lit(PAGE)).cast("long"), "sort": F.coalesce(g("sort"), F.lit("-updated")),
    }).drop("_g")


def checked_edits(edits: DataFrame) -> DataFrame:
    """Edits (id, field, value as text) with `error`: what is wrong with each, null if it may be made."""
    value, field = F.col("value"), F.col("field")
    error = F.when(F.col("id").isNull(), "no id").when(field.isNull() | ~field.isin(*store.EDITABLE), "not editable")
    for name in store.EDITABLE:
        mine = (field == name) & value.isNotNull()
        if name in LENGTHS:
            low, high = LENGTHS[name]
            size = F.length(F.trim(value))
            error = error.when(mine & (size < low), f"under {low} characters").when(mine & (size > high), f"over {high} characters")
        elif name in CHOICES:
            error = error.when(mine & ~value.isin(*CHOICES[name]), "not a choice")
        elif name in ("rdp", "rrp", "selling_price", "quantity"):
            wrong = _misfit(value, 0, None, name == "quantity")
            error = error.when(mine & wrong.isNotNull(), wrong)
        else:
            error = error.when(mine & ~value.isin("true", "false"), "neither true nor false")
    return edits.withColumn("error", error)


def shop_query(given: Mapping[str, object], default_sort: str = "featured", page_size: int = 24) -> dict[str, object]:
    """Filters of a shop's address: of repeated names the first, lists by comma, numbers that are not negative, or none."""
    first = lambda k: (v[0] if isinstance(v := given.get(k), (list, tuple)) and v else v) or None

    def number(k: str) -> float | None:
        try:
            n = _number(first(k)) if first(k) is not None else None
        except ValueError:
            return None
        return n if n is not None and n >= 0 else None

    listed = lambda k: [x for x in str(first(k) or "").split(",") if x]
    return {
        "search": first("search"), "category": listed("category"), "brand": listed("brand"), "min_price": number("min_price"), "max_price": number("max_price"),
        "sort": first("sort") or default_sort, "page": number("page") if number("page") is not None else 1, "limit": page_size,
    }


def bulk_body(updates: list[Mapping[str, object]]) -> list[tuple[object, str, str | None, int]]:
    """(id, field, value, place) of a bulk edit of 1 to 200 items, each an id and a patch; their values are for checked_edits to judge."""
    if not 1 <= len(updates) <= BULK:
        raise Invalid({"updates": f"1 to {BULK} items"})
    errors = {f"updates.{i}": "an id and a patch" for i, u in enumerate(updates) if u.get("id") in (None, "") or not isinstance(u.get("patch"), Mapping) or not u["patch"]}
    if errors:
        raise Invalid(errors)
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    every = [(u["id"], field, text(v)) for u in updates for field, v in u["patch"].items()]
    return [(*edit, place) for place, edit in enumerate(every)]


def page_meta(total: int, page: int, limit: int) -> dict[str, object]:
    return {"total": total, "page": page, "limit": limit, "pages": -(-total // limit), "hasNext": page * limit < total, "hasPrev": page > 1}


def page_row(rows: DataFrame, page: int = 1, limit: int = PAGE) -> DataFrame:
    """page_meta of a table as a row, counted by Spark."""
    return rows.agg(F.count("*").alias("total")).select(
        "total", F.lit(page).cast("long").alias("page"), F.lit(limit).cast("long").alias("limit"), F.ceil(F.col("total") / limit).alias("pages"), (F.col("total") > page * limit).alias("has_next"), F.lit(page > 1).alias("has_prev")
    )


def envelope(rows: DataFrame, page: int = 1, limit: int = PAGE) -> dict[str, object]:
    """A page of ordered rows and what is told of it; at most MOST rows come to the driver."""
    limit = max(1, min(limit, MOST))
    data = [r.asDict(recursive=True) for r in catalog.page(rows, page, limit).collect()]
    return {"success": True, "data": data, "meta": page_meta(rows.count(), page, limit)}
