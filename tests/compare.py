"""Run registered queries and their SQL oracles side by side: ``python -m tests.compare [--sf 0.01] [key ..]``."""

import datetime
import glob
import os
import sys
import time

import duckdb

TESTDATA = "/root/testdata"


def oracle_connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def main(argv):
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"{TESTDATA}/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = make_session(), oracle_connection(sf_dir)
    bad = 0
    for key in argv or queries:
        start = time.time()
        try:
            names, got = spark_rows(queries[key](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            print(f"{key}: FAILED {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if key not in oracles:
            print(f"{key}: {len(got)} rows, no oracle, {took:.1f}s", flush=True)
            continue
        try:
            want_names, want = oracle_rows(con, oracles[key])
        except Exception as e:  # noqa: BLE001
            print(f"{key}: ORACLE FAILED {str(e)[:1000]}", flush=True)
            bad += 1
            continue
        same = names == want_names and got == want
        bad += not same
        print(f"{key}: {'ok' if same else 'DIFFERENT'} {len(got)}/{len(want)} rows, {took:.1f}s", flush=True)
        if not same:
            print("  columns", names, want_names)
            g, w = set(got), set(want)
            print("  only spark ", sorted(g - w)[:4])
            print("  only oracle", sorted(w - g)[:4])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
