"""Detail levels of files, and their fit into a token budget."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ((0.75, 5), (0.5, 3), (0.3, 2), (0.15, 1))
LIKELY_EDIT = 0.1
LOSS = {5: 1.0, 4: 0.5, 3: 0.5, 2: 0.25, 1: 0.1}
RESERVE, TRIGGER, SLACK = (8, 100), (5, 100), (115, 100)
#: Levels a file passes through, down; a file without bodies to select goes from 5 to 3.
_DOWN = {5: 3, 4: 3, 3: 2, 2: 1, 1: 0}
_UP = {0: 1, 1: 2, 2: 3, 3: 5, 4: 5}


def band(total: Column) -> Column:
    out = F.lit(0)
    for least, level in reversed(BANDS):
        out = F.when(total >= least, level).otherwise(out)
    return out


def assign(totals: DataFrame, edges: DataFrame, named: DataFrame, config_bias: bool = False) -> DataFrame:
    """(task_id, path, total, level) from totals (task_id, path, total, role), role code, config or data.

    named: (task_id, path) of files whose symbol or stem the task names, which get 0.1 more. Config files stay
    at 3 unless the task is about configuration, data files at 4; test partners of a file at 5 get at least 4.
    """
    hit = named.select("task_id", "path").distinct().withColumn("likely", F.lit(True))
    boosted = totals.join(hit, ["task_id", "path"], "left").withColumn("total", F.col("total") + F.when(F.col("likely"), LIKELY_EDIT).otherwise(0.0)).drop("likely")
    level = band(F.col("total"))
    capped = F.when((F.col("role") == "config") & F.lit(not config_bias), F.least(level, F.lit(3))).when(F.col("role") == "data", F.least(level, F.lit(4))).otherwise(level)
    rows = boosted.withColumn("level", capped)
    full = rows.filter("level = 5 AND role = 'code'").select("task_id", F.col("path").alias("src"))
    partners = edges.filter("kind = 'test_affinity'").join(full, "src").select("task_id", F.col("dst").alias("path")).distinct().withColumn("partner", F.lit(True))
    return rows.join(partners, ["task_id", "path"], "left").withColumn("level", F.when(F.col("partner"), F.greatest("level", F.lit(4))).otherwise(F.col("level"))).drop("partner")


def estimate(text: str) -> int:
    """Tokens of a text, about: runs of letters by four, digits by three, other marks one each. Shared by the fit and the rendering."""
    n, run, kind = 0, 0, ""
    for c in text:
        now = "a" if c.isalpha() else "d" if c.isdigit() else " " if c.isspace() else "."
        if now != kind or now == ".":
            n += -(-run // (3 if kind == "d" else 4)) if kind in "ad" and kind else 0
            n += now == "."
            run, kind = 0, now
        run += 1
    return n + (-(-run // (3 if kind == "d" else 4)) if kind in ("a", "d") else 0)


def slack(cost: int) -> int:
    """A cost with what the rendering adds around it, never less."""
    return -(-cost * SLACK[0] // SLACK[1])


class ImpossibleBudget(ValueError):
    """The least that a task needs does not fit; smallest is a budget that does."""

    def __init__(self, smallest: int) -> None:
        super().__init__(f"smallest workable budget: {smallest} tokens")
        self.smallest = smallest


def fit(files: list[dict], budget: int, forced: frozenset[str] = frozenset()) -> dict[str, int]:
    """Final level by path. files: path, total, level and cost, a mapping of levels to tokens (with slack), of one task.

    Demotes the file with most gain for its loss until the sum fits, then promotes while more than 5 % stay free. Forced files keep 2.
    """
    room = budget - -(-budget * RESERVE[0] // RESERVE[1])
    level, by = {f["path"]: f["level"] for f in files}, {f["path"]: f for f in files}
    cost = lambda p, at: by[p]["cost"].get(at, 0)
    total = sum(cost(p, at) for p, at in level.items())

    def down(p: str) -> list[tuple[float, str]]:
        at = level[p]
        if at < 1 or (p in forced and at <= 2):
            return []
        return [(-(cost(p, at) - cost(p, _DOWN[at])) / (max(by[p]["total"], 1e-12) * LOSS[at]), p)]

    heap = [x for p in level for x in down(p)]
    heapq.heapify(heap)
    while total > room:
        if not heap:
            raise ImpossibleBudget(-(-total * RESERVE[1] // (RESERVE[1] - RESERVE[0])))
        p = heapq.heappop(heap)[1]
        at = level[p]
        total -= cost(p, at) - cost(p, _DOWN[at])
        level[p] = _DOWN[at]
        for x in down(p):
            heapq.heappush(heap, x)
    spare = -(-budget * TRIGGER[0] // TRIGGER[1])

    def up(p: str) -> list[tuple[float, str, int]]:
        at = level[p]
        if at not in _UP or at >= by[p]["level"]:  # never above what its total earned
            return []
        step = cost(p, _UP[at]) - cost(p, at)
        return [(-by[p]["total"] / max(step, 1), p, step)]

    heap, waiting = [x for p in level for x in up(p)], []
    heapq.heapify(heap)
    while total <= room - spare and heap:
        x = heapq.heappop(heap)
        if total + x[2] > room:
            waiting.append(x)
            continue
        level[x[1]] = _UP[level[x[1]]]
        total += x[2]
        for y in up(x[1]) + (waiting if x[2] < 0 else []):
            heapq.heappush(heap, y)
        if x[2] < 0:  # what did not fit may fit now
            waiting = []
    return level


def fit_tasks(rows: DataFrame, budget: int) -> DataFrame:
    """(task_id, path, level) from (task_id, path, total, level, costs map<int,int>), all files of a task in one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        files = [{"path": r.path, "total": r.total, "level": int(r.level), "cost": {int(k): int(v) for k, v in dict(r.costs).items()}} for r in group.itertuples()]
        fitted = fit(files, budget)
        return pd.DataFrame({"task_id": group["task_id"].iloc[0], "path": list(fitted), "level": list(fitted.values())})

    kind = dict(rows.dtypes)["task_id"]
    return rows.groupBy("task_id").applyInPandas(run, f"task_id {kind}, path string, level int")


def render(header: dict[str, str], rows: list[dict], source: Callable[[str], str], excluded: int = 0) -> str:
    """Markdown of a plan: rows (path, level, total, lang, size, symbols) of one task; source reads a file's text; excluded counts files that are not among the rows.

    Fences are longer than any in the content; likely credentials are masked. Highest levels first, then by total and path.
    """
    import re

    secret = re.compile(r"(?i)((?:password|passwd|secret|token|api[_-]?key)\w*\s*[:=]+\s*)([\"']?)[^\s\"']{8,}\2|AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
    mask = lambda s: secret.sub(lambda m: (m[1] or "") + "[redacted]", s)
    out = ["# Context", *(f"{k}: {v}" for k, v in header.items()), "", "## Tree"]
    out += [f"L{r['level']} {r['path']} ({r['lang']}, {r['size']} B, {len(r['symbols'])} symbols)" for r in sorted(rows, key=lambda r: r["path"]) if r["level"] >= 1]
    for r in sorted((r for r in rows if r["level"] >= 2), key=lambda r: (-r["level"], -r["total"], r["path"])):
        out += ["", f"### {r['path']}"]
        if r["level"] == 2:
            out += [f"{r['path']}:{s['line']} {s['kind']} {s['name']}" for s in r["symbols"]]
        elif r["level"] in (3, 4):
            for s in r["symbols"]:
                doc = (s.get("doc") or "").split("\n")[0]
                out += ([f"// {mask(doc)}"] if doc else []) + [f"{r['path']}:{s['line']} {mask(s.get('signature') or s['name'])}"]
        if r["level"] >= 4:
            lines = source(r["path"]).split("\n")
            if r["level"] == 4:
                keep = sorted({n for s in r["symbols"] if s.get("selected") for n in range(s["line"], s["end_line"] + 1)})
                body = "\n".join(f"{n:>5} {lines[n - 1]}" for n in keep if n <= len(lines))
            else:
                body = "\n".join(f"{n:>5} {x}" for n, x in enumerate(lines, 1))
            fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", body)), default=0))
            out += [fence, mask(body), fence]
    gone = excluded + sum(r["level"] == 0 for r in rows)
    out += ["", f"{gone} files excluded, {sum(r['level'] == 1 for r in rows)} at path only"]
    return "\n".join(out) + "\n"
