"""Run catalogue queries and their SQL side by side: ``python tests/oracle_check.py DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def family(name: str) -> str:
    """Type family of a column on either side."""
    name = name.lower()
    if name in ("int", "integer", "bigint", "smallint", "tinyint"):
        return "integer"
    return {"varchar": "string"}.get(name, name)


def compare(spark, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    """Empty when both sides agree, else the first difference."""
    df = contract.queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "" if got[1] else "no rows"
    result = con.execute(sql)
    want = normal([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    kinds = {c: family(t) for c, t in df.dtypes}
    other = {d[0]: family(str(d[1])) for d in result.description}
    if kinds != other:
        return f"types {sorted(set(kinds.items()) ^ set(other.items()))}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{str(a)[:400]} != {str(b)[:400]}"
    return ""


def main() -> None:
    from tests.conftest import make_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    for name in names or contract.queries():
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "" if name in contract.oracle_sql() else " (rows only)"
        print(f"{name}{kind}: {'ok' if not problem else 'DIFFERS ' + problem} {time.time() - start:.1f}s", flush=True)


if __name__ == "__main__":
    main()
