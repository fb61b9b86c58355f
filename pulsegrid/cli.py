"""Command line over a dataset: ``python -m pulsegrid.cli DATASET measures|devices|patients|export``."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pulsegrid")
    p.add_argument("dataset")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("measures", "devices"):
        s = sub.add_parser(name)
        s.add_argument("--tag", default="")
        s.add_argument("--name", default="")
    s = sub.add_parser("patients")
    s.add_argument("--skip", type=int, default=0)
    s.add_argument("--limit", type=int, default=100)
    s = sub.add_parser("export")
    s.add_argument("definition")
    s.add_argument("target")
    s.add_argument("--format", default="parquet")
    s.add_argument("--shift-ns", type=int, default=0)
    args = p.parse_args(argv)

    from pyspark.sql import functions as F

    from .plans.definition import Definition, validate
    from .session import session
    from .sources import files
    from .sources.dataset import Dataset

    d = Dataset(session(), args.dataset)
    if args.what in ("measures", "devices"):
        like = {c: v for c, v in (("tag", args.tag), ("name", args.name)) if v}
        d.find(args.what, like).show(1000, truncate=False)
    elif args.what == "patients":
        d.table("patients").orderBy("patient_id").offset(args.skip).limit(args.limit).show(args.limit, truncate=False)
    else:
        definition = Definition.from_yaml(args.definition)
        now = d.table("samples").agg(F.max("time_n")).first()[0] or 0
        cover = d.table("intervals").select("device_id", "start_n", "end_n")
        ranges = validate(definition, d.spark, cover, d.table("device_patient"), now + 1, d.table("devices"), d.table("patients"))
        files.export(files.transfer(d.table("samples").drop("day"), ranges, shift_ns=args.shift_ns), args.target, args.format)


if __name__ == "__main__":
    main()
