"""JSON of any keys as typed rows."""

import pytest

from tidemill.functions.props import typed_props

SCHEMA = "id long, `a user` string, at int, props string"


def test_any_keys_become_typed_rows(spark):
    rows = [
        (1, "x", 1, '{"k": 30, "name": "é", "on": true}'),
        (2, "x", 2, '{"k": 2.5, "new": null, "deep": {"b": [1, 2], "a": 0}}'),
        (3, "x", 3, '{"k": "many", "on": false}'),
        (4, "x", 4, '{"k": 4}'),
        (5, "y", 0, '{"k": 7, "k": 8}'),
        (6, None, 0, "[1]"),
        (7, None, 1, '{"k": NaN}'),
        (8, None, 2, None),
        (9, None, 3, "{"),
        (10, None, 4, "{}"),
        (11, None, 5, '{"k": 1' + "0" * 400 + "}"),
        (12, None, 6, '{"k": -1}'),
    ]
    found = typed_props(spark.createDataFrame(rows[::-1], SCHEMA), "props", ["id", "a user"], ["a user"], ["at"])
    assert found.columns == ["id", "a user", "key", "kind", "number", "text", "before"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(
        [
            (1, "x", "k", "number", 30.0, None, None),
            (1, "x", "name", "string", None, "é", None),
            (1, "x", "on", "boolean", 1.0, None, None),
            (2, "x", "k", "number", 2.5, None, 30.0),
            (2, "x", "new", "null", None, None, None),
            (2, "x", "deep", "nested", None, '{"a": 0, "b": [1, 2]}', None),
            (3, "x", "k", "string", None, "many", 2.5),
            (3, "x", "on", "boolean", 0.0, None, 1.0),
            (4, "x", "k", "number", 4.0, None, 2.5),
            (5, "y", "k", "number", 8.0, None, None),
            (6, None, None, "malformed", None, "[1]", None),
            (7, None, None, "malformed", None, '{"k": NaN}', None),
            (9, None, None, "malformed", None, "{", None),
            (11, None, "k", "number", None, "1" + "0" * 400, None),
            (12, None, "k", "number", -1.0, None, None),
        ],
        key=str,
    )


def test_props_of_no_rows_and_of_no_column(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert typed_props(rows, "props", ["id"], ["a user"], ["at"]).count() == 0
    with pytest.raises(ValueError, match="key"):
        typed_props(rows.withColumnRenamed("id", "key"), "props", ["key"], ["a user"], ["at"])
