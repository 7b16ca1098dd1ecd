"""Ordered folds over a video's rows: what a window cannot say, because a step compares with what the steps before have made.

One exchange by video_id, one sort, then plain Python per video over Arrow batches. A video is the unit of parallelism; its rows are
cues or runs of frames, some ten thousand for a long film.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Rows = list[dict]
CONFUSED = str.maketrans("01|!$@", "oiiisa")


def fold(df: DataFrame, run: Callable[[Rows], Rows], order: list[str], schema: str | None = None, key: str = "video_id") -> DataFrame:
    """run over each video's rows in order; its rows have df's columns, or the schema's."""
    kind = df.schema if schema is None else T.StructType.fromDDL(schema)
    made = to_arrow_schema(kind)

    def one(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: [(r[c] is not None, r[c]) for c in order])
        return pa.Table.from_pylist(run(found), schema=made)

    return df.groupBy(key).applyInArrow(one, kind)


Rule = tuple[Callable[[dict, dict], bool], Callable[[dict, dict], dict]]


def merging(rule: Rule) -> Callable[[Rows], Rows]:
    """Over cues in order: one that joins the last of those kept so far becomes a part of it."""
    joins, joined = rule

    def run(rows: Rows) -> Rows:
        out: Rows = []
        for row in rows:
            row["text"] = row["text"] or ""
            if out and joins(out[-1], row):
                out[-1] = joined(out[-1], row)
            else:
                out.append(row)
        return out

    return run


def merge(df: DataFrame, rule: Rule, order: list[str] | None = None) -> DataFrame:
    return fold(df, merging(rule), order or ["start_ms", "idx"])


def is_alnum(c: str) -> bool:
    import unicodedata

    k = unicodedata.category(c)
    return k[0] == "L" or k == "Nd"


def is_cjk(c: str) -> bool:
    return "\u4e00" <= c <= "\u9fff" or "\u3040" <= c <= "\u30ff" or "\uac00" <= c <= "\ud7af"


def is_word(c: str) -> bool:
    import unicodedata

    k = unicodedata.category(c)
    return k[0] in "LM" or k in ("Nd", "Pc", "Nl") or "\u0600" <= c <= "\u06ff" or is_cjk(c)


@lru_cache(100_000)
def counts(text: str) -> tuple[int, int, int, int]:
    """Length, letters and digits, specials, CJK."""
    alnum = sum(map(is_alnum, text))
    return len(text), alnum, len(text) - alnum - sum(c.isspace() and not is_alnum(c) for c in text), sum(map(is_cjk, text))


def score_text(text: str) -> int:
    n, alnum, special, cjk = counts(text)
    return n + 2 * alnum + 3 * cjk - 2 * special


def alnum_ratio(text: str) -> float:
    n, alnum, *_ = counts(text)
    return alnum / n if n else 0.0


def is_better(new: str, held: str) -> bool:
    if not held or not new:
        return not held
    if len(new) > len(held) + 3 or alnum_ratio(new) > alnum_ratio(held) + 0.05:
        return True
    return abs(len(new) - len(held)) <= 2 and counts(new)[2] < counts(held)[2]


@lru_cache(100_000)
def normalized(text: str) -> str:
    kept = (c for c in text.lower().strip().translate(CONFUSED) if is_word(c) or c.isspace())
    return " ".join("".join(kept).split())


def edits(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@lru_cache(100_000)
def similarity(first: str, second: str) -> float:
    """As functions.text.similarity has it, which tests hold this against."""
    if not first or not second:
        return 0.0
    a, b = normalized(first), normalized(second)
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    longest = max(len(a), len(b))
    best = 1 - edits(a, b) / longest
    if a in b or b in a:
        best = max(best, min(len(a), len(b)) / longest)
    wa, wb = a.split(" "), b.split(" ")
    if min(len(a), len(b)) > 5 and len(wa) > 1 and len(wb) > 1:
        best = max(best, len(set(wa) & set(wb)) / max(len(wa), len(wb)))
    return max(0.0, min(1.0, best))


def quality(text: str) -> float:
    """As functions.text.quality_of has it, which tests hold this against."""
    c = text.replace(" ", "").replace("\n", "")
    if not c.strip():
        return 0.0
    n, alnum, _, cjk = counts(c)
    kinds, marks = len(set(c)), len({x for x in c if not is_alnum(x) and not x.isspace()})
    total = 0.5 + (0.2 + min(0.15, cjk * 0.03) if cjk else (alnum / n - 0.5) * 0.3)
    total += 0.1 if 2 <= n <= 200 else 0.05 if n == 1 and cjk else 0.0
    total -= 0.12 if marks > 6 else 0.05 if marks > 3 else 0.0
    if n > 3:
        total -= 0.35 if kinds <= 1 else 0.20 if kinds <= 2 and not cjk else 0.10 if kinds / n < 0.15 and not cjk else 0.0
    return max(0.0, min(1.0, total))
