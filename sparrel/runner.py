"""Suite runner: executes JSON plans and checks their text against expected lines.

A suite file is JSON: ``query_configs``, a list of ``execution_name``, ``query`` (a plan),
``expected_output_file`` (a path, relative to the suite's folder), ``sort_before_check``, ``disabled``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from sparrel.catalog import Catalog
from sparrel.operators.compiler import compile_plan
from sparrel.plans.algebra import Query
from sparrel.sources.row_text import to_row_text


@dataclass(frozen=True)
class Case:
    name: str
    plan: str
    expected: tuple[str, ...]
    sort_before_check: bool = False
    disabled: bool = False


class Mismatch(AssertionError):
    pass


def check_lines(name: str, found: Iterable[str], expected: Iterable[str], sort_before_check: bool) -> None:
    """Compare trimmed lines, in order or as multisets."""
    got, want = [x.strip() for x in found], [x.strip() for x in expected]
    if len(got) != len(want):
        raise Mismatch(f"{name}: {len(got)} rows, expected {len(want)}")
    if sort_before_check:
        got, want = sorted(got), sorted(want)
    for n, (a, b) in enumerate(zip(got, want, strict=True)):
        if a != b:
            raise Mismatch(f"{name}: row {n} is {a!r}, expected {b!r}")


def run_suite(catalog: Catalog, cases: Iterable[Case]) -> list[str]:
    """Run cases in turn; the first mismatch raises. Returns the names that passed."""
    passed = []
    for case in cases:
        if case.disabled:
            continue
        lines = to_row_text(compile_plan(Query.from_json(case.plan), catalog)).toLocalIterator()
        check_lines(case.name, (r.value for r in lines), case.expected, case.sort_before_check)
        passed.append(case.name)
    return passed


def load_suite(path: str) -> list[Case]:
    """Cases of a suite file with their expected lines."""
    cases = []
    for entry in json.loads(Path(path).read_text())["query_configs"]:
        lines = Path(Path(path).parent, entry["expected_output_file"]).read_text().splitlines()
        cases.append(Case(entry["execution_name"], json.dumps(entry["query"]), tuple(lines), entry.get("sort_before_check", False), entry.get("disabled", False)))
    return cases


def save_suite(path: str, cases: Iterable[Case]) -> None:
    """Write a suite file and, beside it, a file of expected lines for each case."""
    entries = []
    for case in cases:
        expected = f"{case.name}.expected"
        Path(Path(path).parent, expected).write_text("".join(f"{line}\n" for line in case.expected))
        entries.append({"execution_name": case.name, "query": json.loads(case.plan), "expected_output_file": expected, "sort_before_check": case.sort_before_check, "disabled": case.disabled})
    Path(path).write_text(json.dumps({"query_configs": entries}, indent=1))


def main(argv: list[str]) -> int:
    """Print a plan's rows, or check a suite, over a folder of Parquet tables.

    ``python -m sparrel.runner PLAN.json FOLDER`` or ``python -m sparrel.runner --suite SUITE.json FOLDER``
    """
    if len(argv) == 3 and argv[0] == "--suite":
        spark = SparkSession.builder.appName("sparrel").getOrCreate()
        print(*run_suite(Catalog.parquet(spark, argv[2]), load_suite(argv[1])), sep="\n")
        return 0
    if len(argv) != 2:
        sys.exit(main.__doc__)
    spark = SparkSession.builder.appName("sparrel").getOrCreate()
    with open(argv[0]) as f:
        plan = json.dumps(json.load(f))
    for row in to_row_text(compile_plan(Query.from_json(plan), Catalog.parquet(spark, argv[1]))).toLocalIterator():
        print(row.value)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
