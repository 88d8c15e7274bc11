"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import bound_batches, narrow

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
# Where an @ is, the local part reaches back as far as its characters go: the leftmost match, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that is no part of an address from its start is none from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Score of a confirmed span, and how far nearby words move it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.45}
RAISE, LOWER, NEAR = 0.25, 0.25, 48
CONTEXT = {
    "email": ("mail", "contact", "e-mail", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "mastercard", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "móvil"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "isbn", "example", "sample", "order", "serial", "invoice", "build")
#: Texts that are Python strings at once.
AT_ONCE = 500
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
                at = text.find("@", end)
                continue
        at = text.find("@", at + 1)


def _matches(kind: str, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        found = m[0]
        if kind == "ip":
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
        elif kind == "card":
            digits = found.replace(" ", "").replace("-", "")
            ok = 14 <= len(digits) <= 19 and luhn(digits)
        elif kind == "phone":
            ok = 10 <= sum(c.isdigit() for c in found) <= 15
        elif kind == "iban":
            ok = mod97(found)
        else:
            ok = found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
        if ok:
            yield m.start(), m.end()


def spans(text: str | None, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of each confirmed span, by start and then by kind; code points, end exclusive."""
    if not text:
        return []
    out = []
    if "@" in text and "email" in kinds:
        out += [(s, e, "email") for s, e in _emails(text)]
    # Every other kind holds a digit.
    if re.search("[0-9]", text):
        for kind, pattern, needs in (("ip", _IP, "."), ("card", _CARD, ""), ("phone", _PHONE, "+"), ("iban", _IBAN, ""), ("ssn", _SSN, "-")):
            if kind in kinds and needs in text:
                out += [(s, e, kind) for s, e in _matches(kind, pattern, text)]
    found = []
    for s, e, kind in out:
        near = {w.lower() for w in _WORD.findall(text[max(0, s - NEAR) : s] + " " + text[e : e + NEAR])}
        score = PRIOR[kind] + RAISE * any(w in near for w in CONTEXT[kind]) - LOWER * any(w in near for w in AGAINST)
        found.append((s, e, kind, round(min(1.0, max(0.0, score)), 3)))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _find(batches: Iterator[pa.RecordBatch], least: float, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])
    for batch in (whole.slice(s, AT_ONCE) for whole in batches for s in range(0, whole.num_rows, AT_ONCE)):
        found = [[dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in spans(t, kinds) if x[2] in BASE or x[3] >= least] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])


def find(docs: DataFrame, least: float = 0.5, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id and `spans`, an array of (start, end, kind, score).

    Confirmed spans of the base kinds always stay, with their score; the further kinds need a score of
    `least`. Null and empty texts have no spans; repeated rows and null ids give one row each.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(partial(_find, least=least, kinds=kinds), "doc_id long, spans array<struct<start:int,end:int,kind:string,score:double>>")


def _redact(batches: Iterator[pa.RecordBatch], at: int, size_at: int | None, least: float) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(s, AT_ONCE) for whole in batches for s in range(0, whole.num_rows, AT_ONCE)):
        texts = []
        for text in batch.column(at).to_pylist():
            parts, end = [], 0
            for s, e, kind, score in spans(text):
                if (kind in BASE or score >= least) and s >= end:
                    parts += [text[end:s], f"<{kind}>"]
                    end = e
                elif (kind in BASE or score >= least) and e > end:
                    end = e
            texts.append("".join([*parts, text[end:]]) if parts else text)
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if size_at is not None:
            columns[size_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(size_at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The same rows and columns, each span replaced by its kind in angle brackets; overlapping spans go together.

    `n_chars`, if there, counts the new text. Null texts stay null.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(partial(_redact, at=at, size_at=size, least=least), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Per document: how many spans of each base kind, the digest of the base spans, and all spans as text."""
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(of(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.transform("spans", lambda x: x["score"]).alias("scores"))
