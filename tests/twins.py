"""Run a registered query in Spark and its twin in DuckDB and compare them."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value) + 0.0
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple(str(v) for v in r))


def compare(spark, con, build, sql, sf_dir) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = build(spark, sf_dir)
    names, mine = _rows(df.columns, df.collect())
    result = con.sql(sql)
    other_names, other = _rows(list(result.columns), result.fetchall())
    if names != other_names:
        return f"columns differ: {set(names) ^ set(other_names)}"
    if len(mine) != len(other):
        return f"rows differ: spark {len(mine)}, sql {len(other)}"
    different = [(a, b) for a, b in zip(mine, other) if a != b]
    if different:
        a, b = different[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(different)} of {len(mine)} rows differ, first: {cells[:4]}"
    if not mine:
        return "no rows"
    return None


def main(sf_dir: str, chosen: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    spark, con, twins = make_session(), connect(sf_dir), oracle_sql()
    for name, build in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in twins:
                problem = compare(spark, con, build, twins[name], sf_dir)
            else:
                rows = build(spark, sf_dir).collect()
                problem = None if rows else "no rows"
                problem = problem or (f"rows only: {len(rows)} {rows[0]}"[:300])
        except Exception as error:  # report every query, then go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'equal'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
