"""Order-free comparison of a Spark result with DuckDB SQL over the same files."""

from pathlib import Path

import duckdb


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark_df, con, sql, shown=3):
    """A list of what differs; empty if the two are equal."""
    names = sorted(spark_df.columns)
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    if sorted(theirs) != names:
        return [f"columns {names} vs {sorted(theirs)}"]
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(r) for r in spark_df.select(*names).collect()), key=repr)
    if got == want:
        return []
    only_got = sorted(set(map(repr, got)) - set(map(repr, want)))
    only_want = sorted(set(map(repr, want)) - set(map(repr, got)))
    return [
        f"rows {len(got)} vs {len(want)}",
        f"columns {names}",
        *[f"spark only: {r}" for r in only_got[:shown]],
        *[f"duckdb only: {r}" for r in only_want[:shown]],
    ]
