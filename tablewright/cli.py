"""The command line: profile, impute, eda, correlate, importance, validate."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import figures as G
from tablewright.config import NUMERIC_THRESHOLD, ImportanceConfig, ImputationConfig, SchemaConfig
from tablewright.functions.parse import name
from tablewright.operators import correlate, explore, supervise
from tablewright.operators import impute as impute_op
from tablewright.operators import profile as profile_op
from tablewright.operators import validate as validate_op
from tablewright.operators.roles import Roles
from tablewright.plans.shared import ship_package
from tablewright.sources.io import SourceError, load, source_for, with_row_key, write_frame

OK, FAILED, BAD_INPUT, INTERRUPTED = 0, 1, 2, 130
log = logging.getLogger("tablewright")


@dataclass
class Output:
    """What a command leaves: lines to print, tables by path below the output folder (or as given, where they have a folder of
    their own), figures with their drawing, notes to log, and the exit code."""

    lines: list[str] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    results: dict[str, DataFrame] = field(default_factory=dict)
    figures: dict[str, tuple[DataFrame, Callable | None]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    code: int = OK


@dataclass(frozen=True)
class Command:
    """options: flag and settings of its argument. as_text: read every column as text; keyed: number the rows."""

    help: str
    work: Callable[[DataFrame, Roles, argparse.Namespace], Output]
    options: dict[str, dict] = field(default_factory=dict)
    as_text: bool = False
    keyed: bool = False


def _profile(df: DataFrame, roles: Roles, a: argparse.Namespace) -> Output:
    lines = profile_op.profile(df, roles).to_text().split("\n")
    kept = df.sparkSession.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    return Output(lines, {"profile.csv": kept} if a.save else {})


def _impute(df: DataFrame, roles: Roles, a: argparse.Namespace) -> Output:
    config = ImputationConfig(n_neighbors=a.neighbors, skip_columns=(*a.skip, "_row_id"), keep_original_columns=a.keep_originals)
    made = impute_op.impute(df, "_row_id", config, roles)
    return Output([made.summary()], results={a.output: made.frame.drop("_row_id")})


_DRAWINGS = {
    "pca_projection": lambda r, s, t: G.scatter_svg(r, "pc1", "pc2", s, t), "tsne_projection": lambda r, s, t: G.scatter_svg(r, "x", "y", s, t),
    "missing_values_heatmap": lambda r, s, t: G.heat_svg(r, "band", "column_name", "missing_fraction", s, t, (0, 1), s["sequential"]),
}


def _eda(df: DataFrame, roles: Roles, a: argparse.Namespace) -> Output:
    made = explore.explore(df, roles, "_row_id", with_tsne=not a.skip_tsne)
    return Output(list(made.figures), figures={stem: (marks, _DRAWINGS.get(stem)) for stem, marks in made.figures.items()}, notes=made.skipped)


def _correlate(df: DataFrame, roles: Roles, a: argparse.Namespace) -> Output:
    made = correlate.correlations(df, roles, a.method)
    square = made.matrix().groupBy("feature_1").pivot("feature_2", list(made.columns)).agg(F.first("correlation"))
    strongest = [f"{r.feature_1} ~ {r.feature_2}: {r.correlation:+.3f}" for r in made.top(10).collect()]
    return Output(
        [*strongest, f"{made.above(a.threshold).count()} pairs at {a.threshold} or above"],
        {f"correlation_matrix_{a.method}.csv": square, f"correlation_ranked_{a.method}.csv": made.ranked},
        figures={f"correlation_{a.method}": (G.heatmap_marks(made.pairs, list(made.columns)), lambda r, s, t: G.heat_svg(r, "column_feature", "row_feature", "correlation", s, t, (-1, 1), s["diverging"]))},
    )


def _importance(df: DataFrame, roles: Roles, a: argparse.Namespace) -> Output:
    study = supervise.importance_study(df, "_row_id", roles, ImportanceConfig(a.target, test_size=a.test_size, n_permutation_repeats=a.permutation_repeats))
    bars = lambda r, s, t: G.bars_svg(r, "feature", "value", s, t)
    ways = {way: "shap_summary" if way == "shap" else f"importance_{way}" for way in study.rankings.columns[1:]}
    figures = {stem: (study.top(30, way).select("feature", name(way).alias("value")), bars) for way, stem in ways.items()}
    return Output([study.to_text()], {f"importance_{a.target}.csv": study.rankings}, figures=figures, notes=study.failures)


def _validate(df: DataFrame, roles: Roles | None, a: argparse.Namespace) -> Output:
    original = source_for(a.original).read(df.sparkSession, as_text=True) if a.original else None
    made = validate_op.validate(df, original, tuple(a.expect_skipped))
    return Output([made.to_text()], code=OK if made.passed else FAILED)


_FLAG, _COLUMNS = {"action": "store_true"}, {"nargs": "*", "default": [], "metavar": "COL"}
COMMANDS = {
    "profile": Command("gaps, skew, dominant values, correlations", _profile, {"--save": _FLAG}),
    "impute": Command("fill missing values", _impute, {"--output": {"required": True}, "--neighbors": {"type": int, "default": 20}, "--skip": _COLUMNS, "--keep-originals": _FLAG}, as_text=True, keyed=True),
    "eda": Command("tables behind the exploratory figures", _eda, {"--skip-tsne": _FLAG}, keyed=True),
    "correlate": Command("pairwise correlations", _correlate, {"--method": {"choices": tuple(correlate.METHODS), "default": "pearson"}, "--threshold": {"type": float, "default": 0.8}}),
    "importance": Command("rank features for a target", _importance, {"--target": {"required": True}, "--test-size": {"type": float, "default": 0.2}, "--permutation-repeats": {"type": int, "default": 10}}, keyed=True),
    "validate": Command("check a repaired table", _validate, {"--original": {}, "--expect-skipped": _COLUMNS}, as_text=True),
}
#: Options of every command.
COMMON = {"--input": {"required": True}, "--output-dir": {"default": "output"}, "--numeric-threshold": {"type": float, "default": NUMERIC_THRESHOLD}}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tablewright", description=__doc__)
    top.add_argument("-v", "--verbose", action="store_true")
    each = top.add_subparsers(dest="command", required=True)
    for title, command in COMMANDS.items():
        sub = each.add_parser(title, help=command.help)
        for flag, settings in (COMMON | command.options).items():
            sub.add_argument(flag, **settings)
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    command = COMMANDS[a.command]
    if a.command == "validate":  # types and roles don't matter to the checks
        df, roles = source_for(a.input).read(spark, as_text=True), None
    else:
        df, roles = load(spark, a.input, SchemaConfig(numeric_threshold=a.numeric_threshold), as_text=command.as_text)
    out = command.work(with_row_key(df) if command.keyed else df, roles, a)
    for line in out.lines:
        print(line)
    for path, result in out.results.items():
        write_frame(result, path)
    for path, result in out.tables.items():
        write_frame(result, f"{a.output_dir}/{path}", single_file=True)
    sink = G.FigureSink(a.output_dir)
    for stem, (marks, drawing) in out.figures.items():
        sink.write(stem, marks, drawing)
    for what, why in out.notes.items():
        log.warning("%s: %s", what, why)
    return out.code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if a.verbose else logging.WARNING)
    try:
        session = spark or SparkSession.builder.appName("tablewright").getOrCreate()
        ship_package(session)
        return run(session, a)
    except (SourceError, ValueError, KeyError) as e:
        log.error("%s", e)
        return BAD_INPUT
    except KeyboardInterrupt:
        return INTERRUPTED


if __name__ == "__main__":
    sys.exit(main())
