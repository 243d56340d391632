"""Control of an evolution on the driver: when it ends, and which variables and iterations are written."""

from __future__ import annotations

import re


def ended(kind: str, iteration: int, time: float, runtime: float, last_iteration: int = 0, last_time: float = 0.0, last_runtime: float = 0.0) -> bool:
    """Whether a run is over. kind: never, iteration, time, runtime, any or all of the three, either or both of iteration and
    time. The runtime's limit of 0 is none."""
    by = {"iteration": iteration >= last_iteration, "time": time >= last_time, "runtime": 0 < last_runtime <= runtime}
    if kind == "never":
        return False
    if kind in by:
        return by[kind]
    two = [by["iteration"], by["time"]]
    rules = {"any": any(by.values()), "all": all(by.values()), "either": any(two), "both": all(two)}
    if kind not in rules:
        raise ValueError(f"unknown kind of termination: {kind}")
    return rules[kind]


def chosen(spec: str, columns: list, groups: dict | None = None) -> list:
    """Columns named by a list of variables and groups, separated by white space or commas, in the table's order."""
    names = {v for part in re.split(r"[\s,]+", spec.strip()) if part for v in (groups or {}).get(part, [part])}
    unknown = names - set(columns)
    if unknown:
        raise ValueError(f"unknown variables: {', '.join(sorted(unknown))}")
    return [c for c in columns if c in names]


def cadence(own: int, general: int) -> int:
    """How often a format is written: -1 takes the general setting; 0 is never."""
    return general if own == -1 else own


def regrid(base, refine, most: int) -> list:
    """The levels of a hierarchy, as DataFrames of blocks: refine(levels) gives the blocks of the next level from those at hand, until
    it gives none or there are so many."""
    levels = [base]
    while len(levels) < most:
        new = refine(levels)
        if new.isEmpty():
            break
        levels.append(new)
    return levels
