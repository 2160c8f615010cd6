"""Commands: summary, write, filter, summarize, tsv2parquet, map, scores and record."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from spectrail import schemas
from spectrail.operators import distribution, mapping, registry, summary
from spectrail.sources import columns, figures, tables

REGISTRY_VARIABLE = "SPECTRAIL_REGISTRY"
_COLUMNS = ("label", *summary.COUNTS)
PLOT_DATA = ("cells", "contours", "scores", "by_charge")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("spectrail").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _counts(spark: SparkSession, files: Sequence[tuple[str, str]], fdr: float, level: str) -> list[dict]:
    """A row of counts for each file, in the order of the files."""
    place = {label: i for i, (_, label) in enumerate(files)}
    rows = [r.asDict() for r in summary.compare(tables.read_many(spark, files), fdr, level).collect()]  # one row for each file
    rows += [dict.fromkeys(_COLUMNS, 0) | {"label": label} for label in place if label not in {r["label"] for r in rows}]
    return sorted(rows, key=lambda r: place[r["label"]])


def _lines(rows: list[dict], separator: str) -> str:
    return "\n".join([separator.join(_COLUMNS), *(separator.join(str(r[c]) for c in _COLUMNS) for r in rows)]) + "\n"


def run_summary(args: argparse.Namespace) -> int:
    remote = _spark() if any("://" in x for x in args.inputs) else None
    files, empty = tables.discover(args.inputs, args.glob, remote)
    for item in empty:
        print(f"nothing found in {item}", file=sys.stderr)
    rows = _counts(_spark(), files, args.fdr, args.level) if files else []
    if args.output == "json":
        print(json.dumps(rows, indent=2))
    else:
        print(_lines(sorted(rows, key=lambda r: (-r[f"{args.level}_count"], r["label"])), ","), end="")
    return 0


def run_write(args: argparse.Namespace) -> int:
    text = _lines(_counts(_spark(), [(x, x) for x in args.inputs], args.fdr, args.level), "\t")
    if args.output is None:
        print(text, end="")
        return 0
    target = args.output
    if target == "next-to-input":
        if len(args.inputs) != 1:
            raise SystemExit("next-to-input needs exactly one input")
        source = Path(args.inputs[0])
        target = source.with_name(f"{source.stem}.summary.tsv")
    Path(target).write_text(text)
    print(target)
    return 0


def run_filter(args: argparse.Namespace) -> int:
    summary.fdr_filter(_spark().read.parquet(args.input), args.fdr, "peptide").write.mode("overwrite").parquet(args.output)
    return 0


def run_summarize(args: argparse.Namespace) -> int:
    row = summary.count_all(_spark().read.parquet(args.input)).first()
    Path(args.output).write_text("\t".join(summary.COUNTS) + "\n" + "\t".join(str(row[c]) for c in summary.COUNTS) + "\n")
    return 0


def run_convert(args: argparse.Namespace) -> int:
    tables.tsv_to_parquet(_spark(), args.input, args.output, schemas.PSMS)
    return 0


def run_map(args: argparse.Namespace) -> int:
    spark = _spark()
    psms, fragments = spark.read.parquet(args.psms), tables.with_row_position(spark, args.fragments)
    found = mapping.map_fragments(psms, fragments, spark.read.parquet(args.precursors), columns.read_library(spark, args.library, ["mz"]), args.mz_err_tol)
    tables.write_mapping(found, args.output)
    return 0


def run_scores(args: argparse.Namespace) -> int:
    """Writes each slice's plot data as Parquet, its axes and label as JSON and its drawings as SVG, and tells how many rows were dropped."""
    spark = _spark()
    read = lambda path: spark.read.parquet(path)
    method, params = tables.score_label(args.config)
    slices = distribution.compare_scores(columns.read_library(spark, args.library, ["score", "intensity"]), read(args.mapping), read(args.mapped))
    if not slices:
        print("no finite score or no matched peak")
    for s in slices:
        print("\n".join(s.notes), end="\n" if s.notes else "")
        for name in PLOT_DATA:
            df: DataFrame = getattr(s, name)
            df.write.mode("overwrite").parquet(f"{args.output}/{s.name}/{name}.parquet")
        label = distribution.plot_label(method, params, s.threshold)
        ranges = {"label": label, "score": [s.score_axis.low, s.score_axis.high], "log_intensity": [s.log_axis.low, s.log_axis.high]}
        Path(args.output, s.name, "axes.json").write_text(json.dumps(ranges))
        # at most a row for each cell of the grid, each bin, and each charge and bin
        data = [read(f"{args.output}/{s.name}/{name}.parquet").toPandas() for name in PLOT_DATA]
        for name, svg in figures.drawings(*data, s.score_axis, s.log_axis, distribution.BINS_FACET, label).items():
            Path(args.output, s.name, name).write_text(svg)
    return 0


def _git_rows(root: str | None) -> list[dict]:
    if root is None:
        return []
    helper = Path(root) / "get_commits"
    if not helper.exists():
        raise SystemExit(f"{helper} is missing")
    return registry.capture_commits(lambda: subprocess.run([str(helper)], cwd=root, capture_output=True, text=True, check=True).stdout.splitlines())


def run_record(args: argparse.Namespace) -> int:
    path = os.environ.get(REGISTRY_VARIABLE)
    if not path:
        raise SystemExit(f"set {REGISTRY_VARIABLE} to the registry's folder")
    if args.regression is not None and not args.review_marker:
        raise SystemExit("--regression goes with --review-marker")
    if args.review_marker and args.regression is None:
        raise SystemExit("--review-marker needs --regression")
    book = registry.Registry(_spark(), path)
    if args.init_db:
        book.init()
    elif args.review_marker:
        book.review(tables.read_marker(args.review_marker), args.regression, args.message)
    elif args.mark_bested_marker:
        print(book.mark_bested(tables.read_marker(args.mark_bested_marker), args.message))
    else:
        if not args.run_info or not args.summary:
            raise SystemExit("--run-info and --summary are needed")
        info = tables.read_sidecar(args.run_info)
        text = Path(args.summary).read_text()
        if args.summary.endswith(".tsv"):
            counts = tables.read_summary(args.summary)
        else:
            counts = {f"{k[:-1]}_count": v for k, v in tables.log_metrics(text).items()}
        accepted, reason = args.accept_run, args.acceptance_reason
        if accepted and not reason:
            raise SystemExit("--accept-run needs --acceptance-reason")
        if not accepted and not args.no_prompt and sys.stdin.isatty():
            accepted = input(f"{counts}\naccept this run? [y/N] ").strip().lower() == "y"
            while accepted and not reason:
                reason = input("reason: ").strip()
        run = {k: info.get(k) for k in ("search_engine", "dataset", "cfg", "pipeline_config", "search_config", "pipeline_call", "search_tool_call")} | counts
        run |= {"pipeline_path": str(Path(args.run_info).resolve().parent), "accepted": accepted, "acceptance_reason": reason}
        new = book.record(run, _git_rows(args.git_root))
        if args.marker:
            status = "reviewed" if accepted else "unreviewed"
            tables.write_marker(args.marker, {"run_id": new, "accepted": int(accepted), "acceptance_reason": reason, "status": status, "regression": 0, "message": reason})
        print(new)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spectrail")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x.rstrip("+"), nargs="+" if x.endswith("+") else None)
        p.set_defaults(run=run)
        return p

    def levels(p: argparse.ArgumentParser) -> None:
        p.add_argument("--fdr", type=float, default=0.01)
        p.add_argument("--level", choices=list(summary.LEVELS), default="peptide")

    p = command("summary", run_summary, "inputs+")
    levels(p)
    p.add_argument("--glob", default="**/results.sage.tsv")
    p.add_argument("--output", choices=["table", "json", "csv"], default="table")
    p = command("write", run_write, "inputs+")
    levels(p)
    p.add_argument("--output")
    command("filter", run_filter, "input", "output").add_argument("--fdr", type=float, default=0.01)
    command("summarize", run_summarize, "input", "output")
    command("tsv2parquet", run_convert, "input", "output")
    command("map", run_map, "psms", "fragments", "precursors", "library", "output").add_argument("--mz-err-tol", type=float, default=0.001)
    p = command("scores", run_scores, "library", "mapped", "mapping")
    p.add_argument("--config", required=True)
    p.add_argument("-o", "--output", required=True)
    p = command("record", run_record)
    for flag in ("--init-db", "--accept-run", "--no-prompt"):
        p.add_argument(flag, action="store_true")
    for option in ("--run-info", "--summary", "--git-root", "--marker", "--acceptance-reason", "--review-marker", "--message", "--mark-bested-marker"):
        p.add_argument(option)
    p.add_argument("--regression", type=int, choices=[0, 1])
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
