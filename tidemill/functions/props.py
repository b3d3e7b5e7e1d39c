"""A table function: JSON objects of any keys as typed rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

FOUND = (("key", T.StringType()), ("kind", T.StringType()), ("number", T.DoubleType()), ("text", T.StringType()), ("before", T.DoubleType()))


def _no_number(name: str) -> None:
    raise ValueError(f"no JSON: {name}")


def typed(value: object) -> tuple[str, float | None, str | None]:
    """kind, number and text of a JSON value; a number beyond a double is kept as text."""
    if value is None:
        return "null", None, None
    if isinstance(value, bool):
        return "boolean", float(value), None
    if isinstance(value, int | float):
        try:
            return "number", float(value), None
        except OverflowError:
            return "number", None, str(value)
    return ("string", None, value) if isinstance(value, str) else ("nested", None, json.dumps(value, sort_keys=True, ensure_ascii=False))


class TypedProps:
    """A row for each key of each object, with the number that the key had before in the partition.

    Its arguments are a table, the column with the JSON text and the columns to keep,
    comma-joined. Rows pass one at a time; what a partition remembers is a number a key.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, keep: AnalyzeArgument) -> AnalyzeResult:
        kept = keep.value.split(",") if keep.value else []
        if missing := {column.value, *kept} - set(rows.dataType.names):
            raise ValueError(f"not in the table: {sorted(missing)}")
        return AnalyzeResult(T.StructType([*(rows.dataType[c] for c in kept), *(T.StructField(*f) for f in FOUND)]))

    def __init__(self) -> None:
        self.numbers: dict[str, float | None] = {}

    def eval(self, row: Row, column: str, keep: str) -> Iterator[tuple]:
        if row[column] is None:
            return
        kept = [row[c] for c in keep.split(",")] if keep else []
        try:
            values = json.loads(row[column], parse_constant=_no_number)
        except (ValueError, RecursionError):
            values = None
        if not isinstance(values, dict):
            yield (*kept, None, "malformed", None, row[column], None)
            return
        for key, value in values.items():
            kind, number, text = typed(value)
            yield (*kept, key, kind, number, text, self.numbers.get(key))
            if number is not None:
                self.numbers[key] = number


def typed_props(rows: DataFrame, column: str, keep: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keep..., key, kind, number, text, before: a row for each key of the JSON objects in a column.

    kind is number, string, boolean (as 0 and 1), null, nested (text is its JSON) or
    malformed, with the text as it is, where there is no object. before is the last
    number of the same key among the rows ahead, in ``order``, with equal columns
    ``by``; those rows pass through one task, so name a slice of time among them where
    a key has very many. Null text gives no row; of a key that an object repeats, the
    last value counts.
    """
    if any("," in c for c in keep):
        raise ValueError(f"a comma in a name: {list(keep)}")
    if clash := {c.lower() for c in keep} & {name for name, _ in FOUND}:
        raise ValueError(f"columns of the result, too: {sorted(clash)}")
    needed = dict.fromkeys([*keep, column, *by, *order])
    cut = rows.select(*(F.col(f"`{c}`") for c in needed))
    dealt = cut.asTable().partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy(*(F.col(f"`{c}`") for c in order))
    return F.udtf(TypedProps)(dealt, F.lit(column), F.lit(",".join(keep)))
