"""A thin command line over the queries: `python -m quern.cli list`, `... run NAME DIR --out DIR`, `... explain NAME DIR`."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    for name, text in (("run", "run a query and write or show its result"), ("explain", "show a query's plan")):
        p = sub.add_parser(name, help=text)
        p.add_argument("query")
        p.add_argument("folder", help="folder of the Parquet tables")
        if name == "run":
            p.add_argument("--out", help="folder for the result as Parquet; without it 20 rows are shown")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from quern.queries import queries

    known = queries()
    if args.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if args.query not in known:
        print(f"no such query: {args.query}", file=sys.stderr)
        return 2
    from quern.session import session

    found = known[args.query](session(), args.folder)
    if args.command == "explain":
        found.explain("formatted")
    elif args.out:
        found.write.parquet(args.out)
    else:
        found.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
