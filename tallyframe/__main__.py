"""Run the whole analysis on a ticket CSV and write every answer as Parquet.

    spark-submit --master yarn tallyframe/__main__.py \
        --csv hdfs:///data/tickets.csv --year 2017 --date-format MM/dd/yyyy \
        --out hdfs:///results/tickets-2017

or ``python -m tallyframe ...`` for a local session.  Each answer goes to
``<out>/<question>`` and is written by the executors.  The files are parsed once;
values that do not parse go to ``--rejects``, and the run fails if a column has
more of them than ``--max-rejected`` allows.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.plans.report import ticket_report  # noqa: E402
from tallyframe.sources.intake import MAX_REJECTED, TooManyRejects, take_in  # noqa: E402
from tallyframe.sources.records import TICKET_COLUMNS  # noqa: E402
from tallyframe.sources.stage import StageFolder  # noqa: E402


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyframe", description=__doc__.splitlines()[0])
    parser.add_argument("--csv", required=True, help="ticket CSV file or folder (header row)")
    parser.add_argument("--out", required=True, help="output folder, one Parquet table per answer")
    parser.add_argument("--year", type=int, default=2017)
    parser.add_argument("--date-format", default=None, help="e.g. MM/dd/yyyy; ISO dates need none")
    parser.add_argument("--max-rejected", type=float, default=MAX_REJECTED, help="share of a column's values")
    parser.add_argument("--rejects", default=None, help="folder for the values that do not parse")
    parser.add_argument("--state-sentinel", default="99")
    parser.add_argument("--midnight", choices=("reference", "strict"), default="reference")
    parser.add_argument("--stage", default=None, help="shared folder for intermediate tables; by default --out")
    parser.add_argument("--only", nargs="*", default=None, help="answer only these questions")
    parser.add_argument(
        "--split-mb",
        type=int,
        default=None,
        help="input split size in MB (spark.sql.files.maxPartitionBytes); larger splits stage fewer files",
    )
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    if args.split_mb:
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{args.split_mb}m")
    with StageFolder(spark, args.stage or args.out) as stage:
        try:
            taken = take_in(
                spark, args.csv, stage, TICKET_COLUMNS, date_format=args.date_format, max_rejected=args.max_rejected
            )
        except TooManyRejects as stop:
            print(f"{stop}; is --date-format right?", file=sys.stderr)
            if args.rejects:
                stop.intake.rejects.write.mode("overwrite").parquet(args.rejects)
            return 2
        for column, (given, bad) in taken.counts.items():
            if bad:
                print(f"{column}: {bad} of {given} values cannot be read", file=sys.stderr)
        if args.rejects:
            taken.rejects.write.mode("overwrite").parquet(args.rejects)
        tickets = taken.records
        answers = ticket_report(
            tickets, stage, year=args.year, state_sentinel=args.state_sentinel, midnight=args.midnight
        )
        wanted = args.only or list(answers)
        unknown = sorted(set(wanted) - set(answers))
        if unknown:
            parser.error(f"unknown questions: {unknown}")
        for name in wanted:
            answers[name].write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
            print(f"wrote {name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
