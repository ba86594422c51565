"""Command line: version, create, list, drop, insert, get, search.

    python -m tessera.cli --data-dir DIR create docs --dim 3 --metric cosine
"""

from __future__ import annotations

import argparse
import os
import sys

import tessera
from tessera.errors import VectorError


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--data-dir", default=os.environ.get("TESSERA_DATA_DIR") or os.path.join(os.path.expanduser("~") or ".", ".tessera"))
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("list")
    create = sub.add_parser("create")
    create.add_argument("name")
    create.add_argument("--dim", type=int, required=True)
    create.add_argument("--metric", default="cosine")
    create.add_argument("--model")
    sub.add_parser("drop").add_argument("name")
    insert = sub.add_parser("insert")
    insert.add_argument("name")
    insert.add_argument("--id", required=True)
    insert.add_argument("--file", required=True, help="float32 values, little-endian")
    insert.add_argument("--metadata")
    get = sub.add_parser("get")
    get.add_argument("name")
    get.add_argument("id")
    find = sub.add_parser("search")
    find.add_argument("name")
    find.add_argument("--file", required=True)
    find.add_argument("-k", type=int, default=10)
    find.add_argument("--filter")
    return parser


def main(argv: list[str] | None = None, spark=None, out=print) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        out(tessera.__version__)
        return 0
    from pyspark.sql import SparkSession

    from tessera.sources import binary
    from tessera.sources.catalog import Catalog

    spark = spark or SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").getOrCreate()
    catalog = Catalog(spark, args.data_dir)

    def vector() -> list[float]:
        got = binary.raw_vectors(spark, args.file).head(1)
        if not got:
            raise VectorError("DIM_TOO_SMALL", args.file)
        return got[0]["vector"]

    try:
        if args.command == "create":
            catalog.create(args.name, args.dim, args.metric, args.model)
        elif args.command == "list":
            for r in catalog.describe().collect():
                out(f"{r['name']:<20} {r['dim']:4d}  {r['metric']:<8} {r['vector_count']} vectors")
        elif args.command == "drop":
            catalog.drop(args.name)
        elif args.command == "insert":
            catalog.insert(args.name, args.id, vector(), args.metadata)
        elif args.command == "get":
            out(",".join(f"{x:g}" for x in catalog.get(args.name, args.id)))
        else:
            for r in catalog.search(args.name, vector(), args.k, args.filter).collect():
                out(f"{r['id']}\t{r['score']:g}")
    except VectorError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
