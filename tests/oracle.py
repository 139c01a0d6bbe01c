"""Compare a Spark result with DuckDB's, column by column and value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    return named, sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(str, r))
    )


def _kind(name: str) -> str:
    name = name.lower()
    if name.startswith("timestamp"):
        return "timestamp"
    return {"int": "integer", "varchar": "string"}.get(name, name)


def differences(spark_df, connection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    want_columns, want = _table(relation.columns, relation.fetchall())
    got_columns, got = _table(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    found = []
    if want_columns != got_columns:
        return [f"columns {got_columns} instead of {want_columns}"]
    want_types = {c: _kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    got_types = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    if want_types != got_types:
        found.append(
            "types " + str({c: (got_types[c], want_types[c]) for c in want_types if got_types[c] != want_types[c]})
        )
    if len(want) != len(got):
        found.append(f"{len(got)} rows instead of {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[:2]} of {want_columns}")
    return found
