"""Detectors by name, behind one signature, and rules that have a manifest but no detector.

A detector takes a ``Sources`` (the index and what external tools found) and returns candidates of one schema. A rule's
manifest names it; a rule without a detector of that name asks for one audit of the whole project.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detectors as D
from .leaks import memleak

Detector = Callable[["Sources"], DataFrame]
COLUMNS = ["file", "line", "function", "description", "vuln_type", "related_functions", "metadata"]


@dataclass
class Sources:
    functions: DataFrame
    structs: DataFrame | None = None
    errors: DataFrame | None = None
    #: Matches of the external matcher, by the detector that asked for them.
    matches: dict[str, DataFrame] = field(default_factory=dict)
    null_returners: DataFrame | None = None

    def need(self, what: str) -> DataFrame:
        found = getattr(self, what)
        if found is None:
            raise ValueError(f"this detector needs {what}")
        return found


def _matched(name: str, sources: Sources) -> DataFrame:
    if name not in sources.matches:
        raise ValueError(f"{name} needs the matches of its rules")
    return D.from_matches(sources.matches[name], sources.functions, name, sources.null_returners if name == "npd_funcret" else None)


DETECTORS: dict[str, Detector] = {
    "oob": lambda s: D.oob(s.functions),
    "npd": lambda s: D.npd(s.functions),
    "chain_npd": lambda s: D.chain_npd(s.functions),
    "atoi_read_oob": lambda s: D.atoi_calls(s.functions),
    "sensitive_clear": lambda s: D.sensitive_clear(s.functions),
    "memleak": lambda s: memleak(s.functions),
    "multi_ptr_leak2": lambda s: D.released_structs(s.functions, s.need("structs")),
    "resleak": lambda s: D.resource_leaks(s.need("errors"), s.functions),
    **{name: partial(_matched, name) for name in D.MATCH_DETECTORS},
}


def register(name: str, detector: Detector) -> None:
    """A detector of the user's own; a name is given once."""
    if name in DETECTORS:
        raise ValueError(f"there is a detector {name}")
    DETECTORS[name] = detector


def run_rules(names: list[str], sources: Sources) -> DataFrame:
    """Candidates of the rules of these names, each by its detector, or one of the whole project where it has none."""
    found = None
    for name in dict.fromkeys(names):
        rows = (DETECTORS[name](sources) if name in DETECTORS else D.project_rule(name)).withColumn("vuln_type", F.lit(name)).select(*COLUMNS)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no rules")
    return found


def run_manifests(manifests: DataFrame, sources: Sources) -> DataFrame:
    """As run_rules, for the enabled rules of ``manifests(name[, enabled])``, as the manifest reader gives them: a few rows."""
    if "enabled" in manifests.columns:
        manifests = manifests.filter("enabled")
    return run_rules([r.name for r in manifests.select("name").orderBy("name").collect()], sources)
