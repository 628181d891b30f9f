"""Command line: ``python -m threadmoss INPUT.tif?calibration=0.09;interval=600 --output results``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .config import Tunables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadmoss")
    p.add_argument("input", nargs="?")
    p.add_argument("-m", "--module", default=None, help="accepted, has no effect")
    p.add_argument("-n", "--processes", type=int, default=-1, help="cores of a local session; -1 all, 0 one")
    p.add_argument("-tp", "--timepoints", default="0-")
    p.add_argument("-mp", "--positions", default="0-")
    p.add_argument("-t", "--tunable", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--tunables-show", action="store_true")
    p.add_argument("--tunables-load", metavar="FILE")
    p.add_argument("--tunables-save", metavar="FILE")
    p.add_argument("--meta", default="", help="metadata kept with the results")
    p.add_argument("--output", default="output")
    return p


def tunables_of(args: argparse.Namespace) -> Tunables:
    t = Tunables()
    if args.tunables_load:
        with open(args.tunables_load) as f:
            t = t.with_values(**json.load(f))
    return t.with_values(**dict(x.split("=", 1) for x in args.tunable))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    t = tunables_of(args)
    if args.tunables_show:
        print(json.dumps(json.loads(t.to_json()), indent=2))
    if args.tunables_save:
        with open(args.tunables_save, "w") as f:
            f.write(t.to_json())
    if not args.input:
        return 0
    from pyspark.sql import functions as F

    from .operators.results import in_range
    from .plans.pipeline import analyse
    from .session import local_session
    from .sources.tiff import TiffStack, path_and_options

    spark = local_session("*" if args.processes < 0 else max(1, args.processes))
    spark.dataSource.register(TiffStack)
    frames = spark.read.format("tiff_stack").load(args.input)
    frames = frames.where(in_range(F.col("t"), args.timepoints) & in_range(F.col("pos"), args.positions))
    analyse(frames, t, args.meta).write(args.output, os.path.basename(path_and_options(args.input)[0]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
