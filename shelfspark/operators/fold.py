"""The ordered merge of drafts: rows of one product folded left to right, each step judged by the row merged so far.

Order matters: after a step the merged row has a new score, which the next row is compared with. Rows are
partitioned by product and sorted within, and a task folds them as they come, holding one merged row. The
fold's state is small, so a product of any number of rows needs no memory; one that holds most rows is a
long task, as a strict fold is. What a merged row's score is, a function of its filled fields says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _empty(value) -> bool:
    if value is None or (isinstance(value, float) and value != value):
        return True
    if isinstance(value, str):
        return value.strip() == ""
    return isinstance(value, (list, dict, tuple)) and not len(value)


class Merged:
    """The row merged so far of one product."""

    def __init__(self, row: dict, fields: list[str], score: Callable[[dict, int], float]):
        self.row, self.fields, self.rescored = row, fields, score
        self.score, self.rows, self.notes = row["score"] or 0.0, 1, [row["notes"]] if not _empty(row.get("notes")) else []

    def add(self, row: dict) -> None:
        """The better of the two, the earlier of equals, keeps its fields and takes those it lacks from the other."""
        later = (row["score"] or 0.0) > self.score
        winner, loser = (row, self.row) if later else (self.row, row)
        merged = dict(winner)
        for f in self.fields:
            if _empty(winner[f]) and not _empty(loser[f]):
                merged[f] = loser[f]
        new = [row["notes"]] if not _empty(row.get("notes")) else []
        self.notes = list(dict.fromkeys(new + self.notes if later else self.notes + new))
        self.row, self.rows = merged, self.rows + 1
        self.score = self.rescored(merged, self.rows)


def filled_share(fields: list[str], penalty: float = 15.0) -> Callable[[dict, int], float]:
    """A score for merged rows: the share of filled fields out of 100, less the penalty of a product found in several rows."""

    def score(row: dict, rows: int) -> float:
        filled = sum(not _empty(row[f]) for f in fields)
        return max(0.0, 100.0 * filled / len(fields) - (penalty if rows > 1 else 0.0))

    return score


def _folded(parts: Iterator[pd.DataFrame], key: str, fields: list[str], order: list[str], score) -> Iterator[pd.DataFrame]:
    now: Merged | None = None
    done: list[dict] = []

    def close() -> None:
        if now is not None:
            done.append({**{c: now.row[c] for c in (key, *order, *fields)}, "score": now.score, "notes": now.notes, "n_sources": now.rows})

    columns = [key, *order, *fields, "score", "notes", "n_sources"]
    for part in parts:
        for row in part.astype(object).where(part.notna(), None).to_dict("records"):
            if now is None or now.row[key] != row[key]:
                close()
                now = Merged(row, fields, score)
            else:
                now.add(row)
        if done:
            yield pd.DataFrame(done, columns=columns)
            done = []
    close()
    if done:
        yield pd.DataFrame(done, columns=columns)


def dedupe(drafts: DataFrame, fields: list[str], score: Callable[[dict, int], float] | None = None, key: str = "fingerprint", order: tuple[str, ...] = ("file", "sheet", "row_index")) -> DataFrame:
    """One row a key by a strict fold in `order`: the merged row's place, fields, score, notes and number of rows.

    A later row wins only with a greater score than that of the row merged so far, which is scored anew after
    each merge by `score(row, rows)`. `notes` are those of all rows, each once, the winner's first. A row
    without a key is a product of its own.
    """
    score = score or filled_share(fields)
    kinds = dict(drafts.dtypes)
    own = drafts.select(key, *order, *fields, F.col("score").cast("double"), (F.col("notes") if "notes" in kinds else F.lit(None)).cast("string").alias("notes"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order, *fields)) + ", score double, notes array<string>, n_sources long"
    sorted_ = own.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    folded = sorted_.mapInPandas(lambda parts: _folded(parts, key, fields, list(order), score), schema)
    alone = own.where(F.col(key).isNull()).select(key, *order, *fields, "score", F.array_compact(F.array("notes")).alias("notes"), F.lit(1).cast("long").alias("n_sources"))
    return folded.unionByName(alone)
