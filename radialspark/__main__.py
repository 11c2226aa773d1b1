"""Command line: python -m radialspark count | halos | particles | decode | generate-particles | generate-halos."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from radialspark.functions.geometry import log_radii


def radius_range(text: str) -> list[float]:
    """min:max:n -> n log-spaced radii."""
    parts = text.split(":")
    if len(parts) != 3:
        raise argparse.ArgumentTypeError("radius must be min:max:n")
    try:
        return log_radii(float(parts[0]), float(parts[1]), int(parts[2]))
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="radialspark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("count", help="shell counts of halos")
    c.add_argument("--particle-files", nargs="+", required=True)
    c.add_argument("--compressed", action="store_true")
    c.add_argument("--halo-file", required=True)
    c.add_argument("--filter-file")
    c.add_argument("--radius", type=radius_range, required=True, metavar="MIN:MAX:N")
    c.add_argument("--non-periodic", action="store_true")
    c.add_argument("--exclude-coincident", action="store_true")
    c.add_argument("--mode", choices=["batch", "incremental"], default="batch")
    c.add_argument("--output-file", help="a report file; standard output without it")
    c.add_argument("--output-folder", help="the report as text files written in parallel")
    for name, what in (("halos", "halo lists"), ("particles", "decoded particle files")):
        p = sub.add_parser(name, help=f"print {what}")
        p.add_argument("-f", "--files", nargs="+", required=True)
    d = sub.add_parser("decode", help="compressed particle files to decoded_<name>")
    d.add_argument("-f", "--files", nargs="+", required=True)
    d.add_argument("--folder", required=True)
    for name, n, seed in (("generate-particles", 10_000_000, 113), ("generate-halos", 10_000, 1659533)):
        g = sub.add_parser(name, help="seeded uniform files")
        g.add_argument("-f", "--files", nargs="+", required=True)
        g.add_argument("-n", type=int, default=n)
        g.add_argument("-s", "--seed", type=int, default=seed)
    return top


def _session() -> SparkSession:
    return SparkSession.builder.appName("radialspark").getOrCreate()


def count(args: argparse.Namespace) -> None:
    from radialspark.operators.search import search
    from radialspark.sources.text import write_report, write_report_files

    if args.output_file and args.output_folder:
        sys.exit("give --output-file or --output-folder")
    for name, value in sorted(vars(args).items()):  # the settings as they are, before anything runs
        print(f"{name}: {value}", file=sys.stderr)
    spark, began = _session(), time.perf_counter()
    files = args.particle_files if len(args.particle_files) > 1 else args.particle_files[0]
    options = {"periodic": not args.non_periodic, "exclude_coincident": args.exclude_coincident}
    counts = search(spark, args.halo_file, files, args.radius, filter_file=args.filter_file, compressed=args.compressed, mode=args.mode, **options)
    if args.mode == "batch":  # the report reads the counts twice
        counts = counts.cache()
        counts.count()
    print(f"searching: {1000 * (time.perf_counter() - began):.0f} ms", file=sys.stderr)
    began = time.perf_counter()
    if args.output_folder:
        write_report_files(counts, args.radius, args.output_folder)
    else:
        write_report(counts, args.radius, args.output_file or "/dev/stdout")
    print(f"writing: {1000 * (time.perf_counter() - began):.0f} ms", file=sys.stderr)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "count":
        count(args)
    elif args.command in ("halos", "particles"):
        from radialspark.sources.binary import read_particles
        from radialspark.sources.text import halo_line, particle_line, read_halos

        if args.command == "halos":
            rows = read_halos(_session(), args.files).orderBy("halo_row").select(halo_line())
        else:
            rows = read_particles(_session(), args.files).orderBy("file", "pid").select(particle_line())
        for r in rows.toLocalIterator():
            print(r[0])
    elif args.command == "decode":
        from radialspark.sources.binary import decode_files

        for r in decode_files(_session(), args.files, args.folder).collect():
            print(f"{r['file']}: {r['rows']}")
    else:
        from radialspark.sources.generate import write_uniform_halos, write_uniform_particles

        write = write_uniform_particles if args.command == "generate-particles" else write_uniform_halos
        write(args.files, args.n, args.seed)


if __name__ == "__main__":
    main()
