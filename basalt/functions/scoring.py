"""Ranking and freshness formulas, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, dirname


def _initials(name: Column, query: str) -> Column:
    """Whether the query's letters fall, in order, on letters that begin a word of the name."""
    low = query.lower()
    n = F.char_length(name)
    at = lambda i: F.substring(name, i, 1)
    starts = lambda i: (i == 1) | at(i - 1).rlike("[_.-]") & ~at(i).rlike("[_.-]") | at(i - 1).rlike("[a-z]") & at(i).rlike("[A-Z]")
    step = lambda done, i: F.when(starts(i) & (F.lower(at(i)) == F.substring(F.lit(low), done + 1, 1)), done + 1).otherwise(done)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) == len(low)).otherwise(F.lit(False))


def fuzzy_score(name: Column, query: str) -> Column:
    """Equal, prefix, part, initials; 0 where nothing matches. Shorter names first within a kind."""
    if not query:
        return F.lit(1.0)
    low, q = F.lower(name), F.lit(query.lower())
    n = F.char_length(name)
    at = F.instr(low, query.lower())
    initials = _initials(name, query) if len(query) >= 2 else F.lit(False)
    return (
        F.when(low == q, 1000.0).when(low.startswith(query.lower()), 800.0 - n)
        .when(at > 0, 600.0 - (at - 1) - n * 0.1).when(initials, 250.0 - n * 0.1).otherwise(0.0)
    )


def path_score(path: Column, query: str, current: str | None = None, recent: tuple[str, ...] = ()) -> Column:
    """Rank of a path for quick opening: kind of match, place of the match, depth, nearness to the open file, recency."""
    if not query:
        return F.lit(1.0)
    t, q = F.lower(path), query.lower()
    base = basename(t)
    base_at = F.char_length(t) - F.char_length(base)
    in_base, in_path = F.instr(base, q), F.instr(t, q)
    kind = (
        F.when(t == q, 1000.0).when(base.startswith(q), 900.0 - F.char_length(base)).when(t.startswith(q), 800.0 - F.char_length(t))
        .when(in_base > 0, 600.0 - (in_base - 1) - F.char_length(base) * 0.1).when(in_path > 0, 500.0 - (in_path - 1) - F.char_length(t) * 0.1)
    )
    hit = F.when(t == q, 0).when(base.startswith(q), base_at).when(t.startswith(q), 0).when(in_base > 0, base_at + in_base - 1).otherwise(in_path - 1)
    dirs = F.split(dirname(t), "/")
    depth = F.char_length(t) - F.char_length(F.replace(t, F.lit("/"), F.lit("")))
    total = kind + F.when(hit >= base_at, 20).otherwise(0) - F.least(depth, F.lit(10)) * 2
    if current:
        own = current.lower().split("/")[:-1]
        same = F.when(depth == len(own), F.lit(True)) & (dirname(t) == "/".join(own))
        shared = F.lit(0)
        for k in range(1, min(4, len(own)) + 1):
            prefix = "/".join(own[:k])
            shared = shared + F.when((depth >= k) & (F.array_join(F.slice(dirs, 1, k), "/") == prefix), 1).otherwise(0)
        total = total + F.when(same, 12).otherwise(0) + shared * 3
    if recent:
        total = total + F.when(t.isin([r.lower() for r in recent]), 15).otherwise(0)
    return F.coalesce(total, F.lit(0.0))


def freshness(at: Column, now: Column) -> Column:
    """1 today, then by three and seven days before ``now``."""
    return (
        F.when(at >= F.date_trunc("day", now), 1.0).when(at >= now - F.expr("INTERVAL 3 DAYS"), 0.75)
        .when(at >= now - F.expr("INTERVAL 7 DAYS"), 0.5).otherwise(0.25)
    )


def age_bucket(at: Column, now: Column) -> Column:
    return (
        F.when(at >= F.date_trunc("day", now), "today").when(at >= now - F.expr("INTERVAL 3 DAYS"), "3d")
        .when(at >= now - F.expr("INTERVAL 7 DAYS"), "7d").otherwise("older")
    )
