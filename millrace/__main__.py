"""python -m millrace COMMAND: prepare, land, features, parity, drift."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.operators import dataset, drift, gates
from millrace.sources import events as source


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="raw CSV, or generated events, to the event table")
    prepare.add_argument("--csv")
    prepare.add_argument("--events", type=int, default=5000)
    prepare.add_argument("--sample-cards", type=int)
    prepare.add_argument("--out", required=True)
    for name, about in (("land", "events to landing files"), ("features", "events to the stored feature table"), ("parity", "compare both implementations"), ("drift", "the drift experiment")):
        one = commands.add_parser(name, help=about)
        one.add_argument("--events", required=True)
        one.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "prepare":
        rows = source.canonical(source.read_raw_csv(spark, args.csv)) if args.csv else source.synthetic(spark, n_events=args.events)
        source.write_events(source.sample_keys(rows, args.sample_cards) if args.sample_cards else rows, args.out)
        return 0
    rows = source.load_events(spark, args.events)
    if args.command == "land":
        source.land(rows, args.out)
    elif args.command == "features":
        dataset.feature_table(rows).write.mode("overwrite").parquet(args.out)
    elif args.command == "parity":
        found = gates.run_gates({"parity": lambda: gates.parity_gate(rows)})
        gates.write_report(spark, gates.as_rows(found), args.out)
        return int(not all(g.passed for g in found))
    else:
        gates.write_report(spark, drift.drift_experiment(rows), args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
