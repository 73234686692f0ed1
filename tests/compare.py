"""Run registered queries against another SQL engine on the same parquet files."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def open_oracle(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return con


def canonical(pdf):
    cols = sorted(pdf.columns)
    kinds = {c: pdf[c].dtype.kind for c in cols}

    def show(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "null"
        if isinstance(v, float):
            return repr(v)
        return str(v)

    rows = sorted(tuple(show(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))
    return cols, kinds, rows


def difference(spark_df, oracle_df) -> str | None:
    ca, ka, ra = canonical(spark_df)
    cb, kb, rb = canonical(oracle_df)
    if ca != cb:
        return f"columns {ca} vs {cb}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} vs {len(rb)}"
    if ra != rb:
        bad = [(x, y) for x, y in zip(ra, rb) if x != y]
        return f"{len(bad)} rows differ, first {bad[:2]}"
    odd = {c: (ka[c], kb[c]) for c in ca if ka[c] != kb[c] and not {ka[c], kb[c]} <= {"O", "b"}}
    if odd and ra:
        return f"types {odd}"
    return None


def main(root: str, only: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tidemark.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = open_oracle(root)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            got = fn(spark, root).toPandas()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:700]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracle:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(oracle[name]).df()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: oracle {str(e)[:600]}", flush=True)
            continue
        d = difference(got, want)
        bad += d is not None
        print(f"{'ok  ' if d is None else 'FAIL'} {name}: {len(got)} rows {t1 - t0:.1f}s / {time.time() - t1:.1f}s {d or ''}",
              flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
