"""The commands as functions: index, doctor, slice, map and version. Errors are exceptions; ``main`` turns them into exit codes."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators.doctor import examine
from codeloom.operators.levels import ImpossibleBudget
from codeloom.plans import incremental, select
from codeloom.plans.store import Index, IndexProblem
from codeloom.sources.scan import CapExceeded, scan_tree

FOLDER = ".codeloom"
OK, FAILED, BUDGET, NOT_READY = 0, 2, 3, 4


def locate(start: str) -> str | None:
    """The index folder of a directory or of the nearest one above it."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, FOLDER)):
            return os.path.join(at, FOLDER)
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)


def index(spark: SparkSession, root: str, path: str | None = None, rebuild: bool = False) -> Index:
    """Builds, resumes or updates the index of a tree."""
    found = Index(spark, path or os.path.join(os.path.abspath(root), FOLDER))
    scan = scan_tree(spark, root)
    if rebuild:
        incremental.rebuild(found, scan)
    else:
        incremental.bring_up(found, scan)
    return found


def _open(spark: SparkSession, root: str, path: str | None) -> Index:
    at = path or locate(root)
    if at is None:
        raise IndexProblem("no index here or above: build one first")
    return Index(spark, at)


def doctor(spark: SparkSession, root: str, path: str | None = None) -> DataFrame:
    return examine(_open(spark, root, path))


def _reader(root: str):
    def read(path: str) -> str:
        with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
            return f.read()

    return read


def slice_(spark: SparkSession, root: str, task: str, tokens: int = 16_000, include: list[str] | None = None, path: str | None = None) -> str:
    """The rendered context for a task."""
    plan = select.select(_open(spark, root, path), task, tokens, include, _reader(root))
    return select.render(plan, _reader(root))


def map_(spark: SparkSession, root: str, tokens: int = 16_000, path: str | None = None) -> str:
    """What is imported most, at the level of declarations."""
    return slice_(spark, root, "", tokens, None, path)


def version() -> str:
    return "codeloom 0.1"


def main(args: list[str]) -> int:
    """index DIR | doctor DIR | slice DIR TASK | map DIR | version."""
    if args[:1] == ["version"]:
        print(version())
        return OK
    if len(args) < 2 or args[0] not in ("index", "doctor", "slice", "map"):
        print(main.__doc__, file=sys.stderr)
        return FAILED
    spark = SparkSession.builder.getOrCreate()
    try:
        if args[0] == "index":
            index(spark, args[1])
        elif args[0] == "doctor":
            bad = doctor(spark, args[1]).filter("severity = 'error'").count()
            return NOT_READY if bad else OK
        else:
            print(slice_(spark, args[1], " ".join(args[2:])), end="")
    except ImpossibleBudget as e:
        print(e, file=sys.stderr)
        return BUDGET
    except IndexProblem as e:
        print(e, file=sys.stderr)
        return NOT_READY
    except (OSError, CapExceeded) as e:
        print(e, file=sys.stderr)
        return FAILED
    return OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
