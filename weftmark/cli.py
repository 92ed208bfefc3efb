"""Command line: ``python -m weftmark.cli DIRECTORY`` or ``... LEFT RIGHT``."""

from __future__ import annotations

import argparse
import datetime
import sys
import time

from pyspark.sql import SparkSession

from weftmark import __version__
from weftmark.options import Options, RunInfo
from weftmark.plans.analysis import analyze_directory, compare, compare_sources
from weftmark.plans.report import Report, parse_format

#: (name, left, right, what to expect, least and greatest percent)
SELF_TEST = (
    ("the same code", "int mul(int p, int q) { int r = p * q; return r; }", "int mul(int p, int q) { int r = p * q; return r; }", "100%", 100.0, 100.0),
    (
        "renamed and laid out anew",
        "long total(int n) { long s = 0; while (n > 0) { s += n; n -= 1; } return s; }",
        "// names and layout differ\nlong   sum( int m )\n{ long t = 0; /* so far */ while( m > 0 ){ t += m; m -= 1; }\n return t; }",
        "more than 80%", 80.0, 100.0,
    ),
    ("other code", 'class Log { public: void write(const char* s) { puts("x"); } };', "for (;;) if (a[i] < b) a[i]++; else break;", "0%", 0.0, 0.0),
)


def positive(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) <= 0:
        raise argparse.ArgumentTypeError(f"{text!r} is no positive number")
    return int(text)


def percentage(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0 <= value <= 100:
        raise argparse.ArgumentTypeError(f"{text!r} isn't within 0 and 100")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftmark", description=__doc__)
    p.add_argument("paths", nargs="*")
    p.add_argument("--dir")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--self-test", action="store_true")
    p.add_argument("-k", "--k", type=positive, default=5)
    p.add_argument("-w", "--w", dest="window", type=positive, default=4)
    p.add_argument("-j", "--threads", type=positive, help="cores of the local session")
    p.add_argument("--threshold", "--min", type=percentage, default=0.0)
    p.add_argument("--top", "--top-n", dest="top_n", type=positive, default=0)
    p.add_argument("--format", default="text")
    p.add_argument("-o", "--output")
    p.add_argument("--no-normalize", action="store_true")
    p.add_argument("--lexer", default="cpp", choices=("cpp", "python", "java", "javascript", "verbatim", "auto"))
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    paths = [*([a.dir] if a.dir else []), *a.paths]
    if not a.self_test and len(paths) not in (1, 2):
        p.error("give a directory or two files")
    try:
        fmt = parse_format(a.format)
    except ValueError as e:
        p.error(str(e))
    spark = SparkSession.builder.master(f"local[{a.threads or '*'}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    options = Options(a.k, a.window, a.threshold, a.top_n, not a.no_normalize, lexer=a.lexer)
    if a.self_test:
        return self_test(spark, a.k, a.window)
    if len(paths) == 2:
        print_comparison(spark, paths, options)
        return 0
    began = time.time()
    analysis = analyze_directory(spark, paths[0], options)
    report = Report(analysis)
    report.info = RunInfo(paths[0], datetime.datetime.now().isoformat(timespec="seconds"), (time.time() - began) * 1000, a.threads or 0)
    for w in analysis.warnings:
        print(w, file=sys.stderr)
    if a.output:
        with open(a.output, "w", encoding="utf-8", newline="") as f:
            f.writelines(report.parts(fmt))
        print(f"Report written to {a.output}", file=sys.stderr)
    else:
        sys.stdout.writelines(report.parts(fmt))
    analysis.close()
    return 0


def self_test(spark: SparkSession, k: int, window: int) -> int:
    """0 if every case of SELF_TEST is as expected."""
    failed = 0
    for name, left, right, expected, least, most in SELF_TEST:
        found = compare(spark, left, right, Options(k, window, normalize=False))
        right_ = least <= found <= most
        failed += not right_
        print(f"{name}: {found:.2f}%, expected {expected}{'' if right_ else ': FAILED'}")
    return int(failed > 0)


def print_comparison(spark: SparkSession, paths: list[str], options: Options) -> None:
    sources = []
    for x in paths:
        with open(x, "rb") as f:
            sources.append(f.read())
    profiles, pair = compare_sources(spark, *sources, options)
    title = "Weftmark file comparison"
    print(f"{title}\n{'-' * len(title)}\nk-gram size:       {options.k}\nwinnow window:     {options.window}\n")
    for label, path, p in zip(("Left ", "Right"), paths, profiles.orderBy("doc_id").collect(), strict=True):
        print(f"{label}: {path}\n  tokens:       {p.tokens}\n  k-grams:      {p.kgrams}\n  fingerprints: {p.fingerprints}")
    print(f"\nSimilarity: {pair.first().similarity:.2f}%")


if __name__ == "__main__":
    sys.exit(main())
