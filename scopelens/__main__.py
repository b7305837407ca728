"""Command line: ``python -m scopelens list | run NAME | explain NAME | sql NAME`` over a folder of tables."""

from __future__ import annotations

import argparse

from .plans import ORACLES, QUERIES
from .session import build_session, ship
from .sources.files import markdown


def main() -> None:
    p = argparse.ArgumentParser(prog="scopelens")
    p.add_argument("what", choices=("list", "run", "explain", "sql"))
    p.add_argument("name", nargs="?", choices=sorted(QUERIES))
    p.add_argument("--sf", default="/root/testdata/sf0.01", help="folder with the Parquet tables")
    p.add_argument("--out", help="write the result there as Parquet instead of printing it")
    p.add_argument("--rows", type=int, default=20, help="rows to print")
    a = p.parse_args()
    if a.what == "list":
        print("\n".join(f"{k}{'' if k in ORACLES else '  (no SQL)'}" for k in sorted(QUERIES)))
        return
    if a.name is None:
        p.error("a query's name is needed")
    if a.what == "sql":
        print(ORACLES.get(a.name, "-- SQL cannot express this query"))
        return
    spark = build_session("scopelens")
    ship(spark)
    df = QUERIES[a.name](spark, a.sf)
    if a.what == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        print(markdown(df, a.rows))


if __name__ == "__main__":
    main()
