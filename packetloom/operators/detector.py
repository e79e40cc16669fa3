"""Detector plug-ins.

A detector turns its input into the columns ``<module>_score`` and
``<module>_findings``. It is declared in parts, each a set of flat columns, so
that Spark evaluates every costly piece once per row: ``prepare`` derives
shared inputs such as the lower-case text, ``signals`` does the matching on
them, ``score`` and ``findings`` only read the signals. Flat columns matter:
fields taken from a struct or array would be merged back into each use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Columns = dict[str, Column]
_GIVEN = "given"


def _as_is(**inputs: Column) -> Columns:
    return inputs


@dataclass(frozen=True)
class Detector:
    module: str
    score: Callable[..., Column]               # takes the signals as keywords
    findings: Callable[..., Column]            # takes the signals as keywords
    signals: Callable[..., Columns] = _as_is   # takes the prepared columns as keywords
    prepare: Callable[..., Columns] = _as_is   # takes the inputs as keywords


REGISTRY: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    """Make a detector available by its module name."""
    REGISTRY[detector.module] = detector
    return detector


def detect(df: DataFrame, inputs: dict[str, Column | Columns], where: Column | None = None) -> DataFrame:
    """Add ``<module>_score`` and ``<module>_findings`` for every module.

    ``inputs`` maps a module to the column it reads, or to several columns by
    name. Rows outside ``where`` are not matched. A detector that yields
    nothing scores 0; if it was given something, a finding says so.
    """
    kept = [F.col(c) for c in df.columns]

    def stage(frame: DataFrame, columns: dict[str, Columns], suffix: str) -> tuple[DataFrame, dict[str, Columns]]:
        names = {(m, part): f"_{m}_{part}_{suffix}" for m, parts in columns.items() for part in parts}
        frame = frame.select(*kept, *[columns[m][part].alias(name) for (m, part), name in names.items()])
        return frame, {m: {part: F.col(names[m, part]) for part in parts} for m, parts in columns.items()}

    given = {m: value if isinstance(value, dict) else {"input": value} for m, value in inputs.items()}
    if where is not None:
        given = {m: {part: F.when(where, column) for part, column in parts.items()} for m, parts in given.items()}
    # Whether a detector was given anything travels with its columns.
    asked = {m: {_GIVEN: reduce(or_, [c.isNotNull() for c in parts.values()])} for m, parts in given.items()}
    df, prepared = stage(df, {m: REGISTRY[m].prepare(**parts) | asked[m] for m, parts in given.items()}, "in")
    flags = {m: parts.pop(_GIVEN) for m, parts in prepared.items()}
    df, signals = stage(df, {m: REGISTRY[m].signals(**parts) | {_GIVEN: flags[m]} for m, parts in prepared.items()}, "hit")
    none = F.array().cast("array<string>")
    flags = {m: parts.pop(_GIVEN) for m, parts in signals.items()}
    scores = {m: REGISTRY[m].score(**parts) for m, parts in signals.items()}

    def findings(m: str) -> Column:
        found = F.coalesce(REGISTRY[m].findings(**signals[m]), none)
        return F.when(flags[m] & scores[m].isNull(), F.array_append(found, F.lit(f"error: {m} could not read its input"))).otherwise(found)

    return df.select(*kept, *[column for m in signals for column in (
        F.coalesce(scores[m], F.lit(0.0)).alias(f"{m}_score"), findings(m).alias(f"{m}_findings"))])


def long_form(df: DataFrame, key: str, modules: list[str]) -> DataFrame:
    """One row (key, module, score, findings) per event and module."""
    return df.select(key, F.inline(F.array(*[
        F.struct(F.lit(m).alias("module"), F.col(f"{m}_score").alias("score"), F.col(f"{m}_findings").alias("findings"))
        for m in modules
    ])))
