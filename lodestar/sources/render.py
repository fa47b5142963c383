"""Small results as a table, JSON or CSV."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence

from ..functions.metrics import number_text, vector_text


def cell(x: object) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return number_text(x)
    return vector_text(x) if isinstance(x, list) else "" if x is None else str(x)


def table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    lines = [list(columns), *([cell(x) for x in r] for r in rows)]
    wide = [max(len(r[i]) for r in lines) for i in range(len(columns))]
    text = ["  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in lines]
    return "\n".join([text[0], "  ".join("-" * w for w in wide), *text[1:], f"({len(rows)} row{'s' * (len(rows) != 1)})"])


def as_json(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    return json.dumps([dict(zip(columns, r)) for r in rows], ensure_ascii=False)


def as_csv(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([cell(x) for x in r] for r in rows)
    return out.getvalue().rstrip("\n")


FORMATS = {"table": table, "json": as_json, "csv": as_csv}
