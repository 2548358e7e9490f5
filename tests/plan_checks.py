"""What a physical plan must not contain if it is to hold at cluster scale."""

from __future__ import annotations

import re

# An unkeyed window is allowed only over summaries: slices of slices, one row per day, or one row per
# lag snapshot (keyed by topic, which the optimizer folds away where there is a single one).
_SUMMARY_ORDER = re.compile(r"_slice|_day|^ts#")


def plan_problems(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    problems = []
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        if bad in plan:
            problems.append(bad)
    for line in plan.splitlines():
        found = re.search(r"Window \[.*windowspecdefinition\((\S+) (?:ASC|DESC)", line)
        if found and not _SUMMARY_ORDER.search(found.group(1)):
            problems.append(f"unkeyed window over {found.group(1)}")
    return problems
