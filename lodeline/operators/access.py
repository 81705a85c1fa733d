"""Who may see what: grants, scopes and exclusions compiled to predicates that reach the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exclusion:
    """A glob that withholds paths from ``effective_from`` on (epoch: always)."""

    pattern: str
    effective_from: str = "1970-01-01 00:00:00"


@dataclass(frozen=True)
class Access:
    """What a caller may see. No grants: only rows without a scope. No include list: every scope."""

    grants: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclusions: tuple[Exclusion, ...] = field(default_factory=tuple)


def permitted(scope: Column, grants: tuple[str, ...]) -> Column:
    """A grant covers its own scope and those below it, ``a`` covers ``a:b`` but not ``ab``; blank grants cover nothing."""
    out = scope.isNull()
    names = [g for g in grants if g.strip()]
    if names:
        out = out | scope.isin(names)
    for g in names:
        out = out | scope.startswith(g + ":")
    return out


def in_scope(scope: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """Exclusion beats inclusion; an empty include list means all; a row without a scope is seen."""
    wanted = F.lit(True) if not include else scope.isin(list(include))
    banned = scope.isin(list(exclude)) if exclude else F.lit(False)
    return scope.isNull() | (wanted & ~banned)


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob; a bare name stands for it at any depth, as a file or as a folder."""
    if pattern.startswith("!"):
        raise ValueError("negated exclusions are not supported")
    if "/" not in pattern:
        return f"(?:.*/)?{_glob(pattern)}(?:/.*)?"
    return _glob(pattern)


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            j = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(map(_glob, pattern[i + 1 : j].split(","))) + ")", j + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def excluded_by(path: Column, at: Column, rules: tuple[Exclusion, ...]) -> Column:
    """Pattern of the first rule in force that matches a path; null if none does."""
    out = None
    for r in rules:
        hit = path.rlike(f"^{glob_regex(r.pattern)}$") & (F.lit(r.effective_from).cast("timestamp_ntz") <= at)
        out = F.when(hit, r.pattern) if out is None else out.when(hit, r.pattern)
    return F.lit(None).cast("string") if out is None else out


def withheld_reason(scope: Column, path: Column, at: Column, access: Access) -> Column:
    """Why a row is withheld, null if it is not; unknown values count against the caller only where a rule names them."""
    return (
        F.when(~permitted(scope, access.grants), "permission")
        .when(~in_scope(scope, access.include, access.exclude), "scope")
        .when(excluded_by(path, at, access.exclusions).isNotNull(), "exclusion")
    )


def visible(df: DataFrame, reason: Column) -> DataFrame:
    return df.where(reason.isNull())


def withheld_tally(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n): counts only, nothing of what is withheld."""
    return df.select(reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
