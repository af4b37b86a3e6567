"""Command line: ``python -m riskframe prepare|train|show``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from riskframe import jobs
from riskframe.session import build_session


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="riskframe")
    commands = parser.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="raw CSV to the patients table")
    prepare.add_argument("raw_csv")
    prepare.add_argument("folder")
    prepare.add_argument(
        "--most-bad", type=int, help="put so many lines that cannot be read beside the table"
    )
    train = commands.add_parser("train", help="train, score and store")
    train.add_argument("folder")
    show = commands.add_parser("show", help="print the first rows of a view")
    show.add_argument("folder")
    show.add_argument("view")
    show.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)

    spark = build_session()
    if args.command == "prepare":
        jobs.prepare_patients(spark, args.raw_csv, args.folder, most_bad=args.most_bad)
    elif args.command == "train":
        jobs.train_and_store(spark, args.folder)
    else:
        names = jobs.open_views(spark, args.folder)
        if args.view not in names:
            parser.error(f"no such view; there are {', '.join(names)}")
        spark.table(args.view).show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
