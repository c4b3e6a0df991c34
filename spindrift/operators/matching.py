"""Matching without replacement, by deferred acceptance in rounds over ranges of partners.

The sequential rule, "units in stable order, each takes the nearest partner left", has the same result as deferred
acceptance in which all partners prefer the unit that is first in order: it doesn't matter when a unit asks, only that
it asks partners from its nearest on, and that a partner keeps the first of those who ask.  So a group need not be
one task's work.  Its partners are cut into ranges of ``RANGE`` along their size.  A unit asks its home range first and
then, as partners there are gone to earlier units, ranges to the left and right.  It carries a lower bound (distance,
tie rank) for each of the ranges that it may ask next, and takes a partner only if none of the other
bounds lies below; else the bound is made exact and the unit goes where the least bound is.

A task holds one range's partners and goes through the units that ask it one by one in order, however many there are; a
unit that loses its partner to an earlier one asks on in the same task.  Rounds go on until no unit asks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import stored
from .cohort import CohortError, nearest_match
from .numbering import counted

#: Partners of a range.
RANGE = 8192
_FREE = np.iinfo(np.int64).max
_ASKS = "array<struct<d:double,t:bigint,b:bigint,side:int>>"
_STATE = f"g string, prio bigint, s double, asks {_ASKS}, b bigint, i int, d double"
_OUT = 4096


class _Range:
    """A range's partners, who holds them, and the edges of the ranges beside it."""

    def __init__(self, b: int, partners: list[tuple]) -> None:
        self.b = b
        self.sizes = np.array([p[4] for p in partners])
        self.ties = np.array([p[5] for p in partners], dtype=np.int64)
        self.left, self.right = partners[0][6], partners[0][7]
        self.prio = np.full(len(partners), _FREE, dtype=np.int64)
        self.held: list[tuple | None] = [None] * len(partners)
        self.latest = _FREE

    def give(self, i: int, prio: int, unit: tuple | None) -> None:
        self.prio[i], self.held[i] = prio, unit
        self.latest = int(self.prio.max())

    def best(self, prio: int, s: float) -> tuple[float, int, int] | None:
        """(distance, tie rank, place) of the nearest partner that is free or held by a later unit."""
        if self.latest <= prio:
            return None
        d = np.where(self.prio > prio, np.abs(self.sizes - s), np.inf)
        least = d.min()
        at = np.flatnonzero(d == least)
        i = int(at[np.argmin(self.ties[at])])
        return float(least), int(self.ties[i]), i

    def beyond(self, s: float, side: int) -> list[tuple]:
        """The next range's edge on one side as a lower bound, if there is one."""
        edge = self.left if side < 0 else self.right
        return [] if edge is None else [(abs(s - edge), -1, self.b + side, side)]

    def ask(self, unit: tuple) -> tuple[tuple | None, tuple | None]:
        """(the unit as it goes on or holds, the unit that it displaces)."""
        prio, s, asks = unit
        own = min(a for a in asks if a[2] == self.b)
        others = [a for a in asks if a is not own]
        if own[3] and own[1] < 0:  # here for the first time: what lies further out may be as near, by a lower tie rank
            others += self.beyond(s, own[3])
        found = self.best(prio, s)
        if found is None:
            return (prio, s, others, None, None, None), None
        d, t, i = found
        exact = (d, t, self.b, own[3])
        if others and min(others)[:2] < (d, t):
            return (prio, s, [exact, *others], None, None, None), None
        displaced = self.held[i]
        self.give(i, prio, (prio, s, [exact, *others]))
        return None, displaced


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.list_(pa.struct([("d", pa.float64()), ("t", pa.int64()), ("b", pa.int64()), ("side", pa.int32())])), pa.int64(), pa.int32(), pa.float64())
    names = ["g", "prio", "s", "asks", "b", "i", "d"]

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def emit(g: str, prio: int, s: float, asks: list[tuple], b, i, d) -> None:
        out.append((g, prio, s, [dict(zip(("d", "t", "b", "side"), a, strict=True)) for a in asks], b, i, d))

    rows = chain.from_iterable(zip(*batch.to_pydict().values(), strict=True) for batch in batches)
    for (g, b), own in groupby(rows, key=itemgetter(0, 1)):
        partners, here, waiting = [], None, []
        for r in chain(own, [None]):  # partners, then those who hold one, then those who ask, in order
            if r is not None and r[2] == 0:
                partners.append(r)
                continue
            here = here or _Range(b, partners)
            if r is not None:
                unit = (r[3], r[4], [(a["d"], a["t"], a["b"], a["side"]) for a in r[8]])
                if r[2] == 1:
                    here.give(r[9], r[3], unit)
                    continue
            while waiting and (r is None or waiting[0][0] < r[3]):  # who lost a partner asks on, in its turn
                moved, lost = here.ask(heapq.heappop(waiting))
                if lost:
                    heapq.heappush(waiting, lost)
                if moved:
                    emit(g, *moved)
            if r is not None:
                moved, lost = here.ask(unit)
                if lost:
                    heapq.heappush(waiting, lost)
                if moved:
                    emit(g, *moved)
            if len(out) >= _OUT:
                yield told()
                out.clear()
        for i, unit in enumerate(here.held):
            if unit is not None:
                emit(g, unit[0], unit[1], unit[2], b, i, abs(unit[1] - float(here.sizes[i])))
    yield told()


def match_without_replacement(df: DataFrame, group: str, positive: str, size: str, key: str, span: int = RANGE, most_rounds: int = 10_000) -> DataFrame:
    """(group, unit, match, distance): positives, in stable order, each take the nearest negative left, by log size; ties by stable key.

    Rows without a size have no part, positives for whom none is left have no row, and a null group is a group.
    """
    s = F.log1p(F.col(size).cast("double"))
    rows = df.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(group).alias("grp"), F.coalesce(F.col(positive).cast("boolean"), F.lit(False)).alias("is_unit"), s.alias("s"), F.col(key).alias("k"), text.stable_key(F.col(key).cast("string")).alias("h"))
    rows = counted(rows.filter("s IS NOT NULL AND NOT isnan(s)"), ["g", "is_unit"], ["h", "k"], "rank")  # order of units, and of partners at one distance
    rows = counted(rows, ["g"], ["s", "is_unit", "rank"], "below", ~F.col("is_unit"))  # for a partner its place, for a unit where it stands among them
    partners = rows.filter("NOT is_unit").withColumn("b", F.floor(F.col("below") / span)).withColumn("i", (F.col("below") % span).cast("int"))
    edges = partners.groupBy("g", "b").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    line = Window.partitionBy("g").orderBy("b")  # one row a range
    edges = edges.select(F.col("g").alias("eg"), F.col("b").alias("eb"), F.lag("hi").over(line).alias("left"), F.lead("lo").over(line).alias("right"), F.max("b").over(Window.partitionBy("g")).alias("last"))
    edges = stored(edges, "edges")
    partners = partners.join(edges, (F.col("g") == F.col("eg")) & (F.col("b") == F.col("eb"))).select("g", "b", "i", "s", "rank", "left", "right", "k")
    partners = stored(partners, "partners")
    last = edges.filter("eb = last").select(F.col("eg").alias("lg"), "last")
    units = rows.filter("is_unit").join(last, F.col("g") == F.col("lg"))
    home = F.least(F.floor(F.col("below") / span), F.col("last")).alias("home")
    units = units.select("g", F.col("rank").alias("prio"), "s", home).join(edges, (F.col("g") == F.col("eg")) & (F.col("home") == F.col("eb")))
    ask = lambda d, b, side: F.struct(d.cast("double").alias("d"), F.lit(-1).cast("long").alias("t"), b.cast("long").alias("b"), F.lit(side).alias("side"))
    asks = F.array_compact(F.array(ask(F.lit(0.0), F.col("home"), 0), F.when(F.col("left").isNotNull(), ask(F.abs(F.col("s") - F.col("left")), F.col("home") - 1, -1)), F.when(F.col("right").isNotNull(), ask(F.abs(F.col("s") - F.col("right")), F.col("home") + 1, 1))))
    none = lambda kind: F.lit(None).cast(kind)
    state = stored(units.select("g", "prio", "s", asks.alias("asks"), none("bigint").alias("b"), none("int").alias("i"), none("double").alias("d")), "units")
    asking = F.col("i").isNull() & (F.size("asks") > 0)
    for _ in range(most_rounds):
        aim = F.when(F.col("i").isNull(), F.array_min("asks")["b"]).otherwise(F.col("b"))
        placed = state.withColumn("aim", aim)
        busy = stored(placed.filter(asking).select(F.col("g").alias("bg"), F.col("aim").alias("bb")).distinct(), "busy")
        if not busy.limit(1).count():
            break
        on = lambda b: (F.col("g") == F.col("bg")) & (F.col(b) == F.col("bb"))
        there = partners.join(busy, on("b"), "left_semi").select("g", "b", F.lit(0).alias("kind"), F.col("i").cast("long").alias("prio"), "s", F.col("rank").alias("t"), "left", "right", F.lit(None).cast(_ASKS).alias("asks"), none("int").alias("i"))
        moving = placed.filter("i IS NOT NULL OR size(asks) > 0")
        asked = moving.join(busy, on("aim"), "left_semi").select("g", F.col("aim").alias("b"), F.when(F.col("i").isNull(), 2).otherwise(1).alias("kind"), "prio", "s", none("long").alias("t"), none("double").alias("left"), none("double").alias("right"), "asks", "i")
        still = placed.join(busy, on("aim"), "left_anti").drop("aim")
        work = there.unionByName(asked).repartition("g", "b").sortWithinPartitions("g", "b", "kind", "prio")
        state = stored(work.mapInArrow(_rounds, _STATE).unionByName(still), "units")
    else:
        raise RuntimeError("matches did not settle")
    names = rows.filter("is_unit").select(F.col("g").alias("ug"), F.col("rank").alias("up"), "grp", F.col("k").alias("unit"))
    held = state.filter("i IS NOT NULL").select(F.col("g").alias("hg"), "prio", F.col("b").alias("hb"), F.col("i").alias("hi"), F.col("d").alias("distance"))
    found = held.join(partners.select("g", "b", "i", F.col("k").alias("match")), (F.col("hg") == F.col("g")) & (F.col("hb") == F.col("b")) & (F.col("hi") == F.col("i")))
    found = found.join(names, (F.col("hg") == F.col("ug")) & (F.col("prio") == F.col("up")))
    return found.select(F.col("grp").alias(group), "unit", "match", "distance")


def fill_quotas(df: DataFrame, project: str, category: str, key: str, quotas: dict[str, int], total: int, label: str = "quota") -> DataFrame:
    """(unit, project, category, place): each category takes its quota in stable order, no project twice, then all fill up to ``total``.

    The choice is one sequence over all categories, but only rows that it can reach go to one task.  At most ``total``
    projects are ever taken, so a category's choice is among its first quota + ``total`` projects, and the rest's among
    the first 2 x ``total``; these come from partial top-k aggregates, each project by its first row.
    """
    return _candidates(df, project, category, key, quotas, total, label).groupBy().applyInPandas(_chooser(quotas, total), "unit string, project string, category string, place long")


def _candidates(df: DataFrame, project: str, category: str, key: str, quotas: dict[str, int], total: int, label: str = "quota") -> DataFrame:
    h = text.stable_key(F.lit(label), F.col(project).cast("string"), F.col(key).cast("string"))
    rows = df.select(F.col(key).cast("string").alias("unit"), F.col(project).cast("string").alias("project"), F.col(category).cast("string").alias("category"), h.alias("h"))
    first = stored(rows.groupBy("project", "category").agg(F.min(F.struct("h", "unit")).alias("x")).select("project", "category", "x.h", "x.unit"), "first")
    rest = first.groupBy("project").agg(F.min(F.struct("h", "unit", "category")).alias("x")).select("project", "x.category", "x.h", "x.unit")
    reach = rest.orderBy("h", "unit").limit(2 * total)
    for c, n in quotas.items():
        reach = reach.unionByName(first.filter(F.col("category") == c).orderBy("h", "unit").limit(min(n, total) + total))
    return reach.distinct()


def _chooser(quotas: dict[str, int], total: int):
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "unit"])
        taken: dict = {}
        for wanted, most in [*quotas.items(), (None, total)]:
            here = rows if wanted is None else rows[rows["category"] == wanted]
            for r in here.itertuples(index=False):
                if most <= 0 or len(taken) >= total:
                    break
                if r.project not in taken:
                    taken[r.project] = (r.unit, r.project, r.category, len(taken) + 1)
                    most -= 1
        return pd.DataFrame(list(taken.values()), columns=["unit", "project", "category", "place"])

    return choose


def one_pair_a_project(df: DataFrame, project: str, positive: str, category: str, size: str, key: str, quotas: dict[str, int], total: int, exact: bool = False) -> DataFrame:
    """(place, project, category, unit, match, distance): one positive a project, by quotas of categories, with its nearest negative.

    Only projects that have a negative count.  With ``exact``, fewer than ``total`` pairs are an error.
    """
    rows = df.filter(F.col(size).isNotNull() & F.col(project).isNotNull() & F.col(positive).isNotNull())
    negatives = rows.filter(~F.col(positive))
    able = rows.filter(F.col(positive)).join(negatives.select(F.col(project).alias("_p")).distinct(), F.col(project) == F.col("_p"), "left_semi")
    chosen = stored(fill_quotas(able, project, category, key, quotas, total), "chosen")  # at most `total` rows
    if exact and (n := chosen.count()) != total:
        raise CohortError(f"pair_count_not_{total}:{n}")
    chosen = chosen.select("place", "category", F.col("unit").alias("_u"), F.col("project").alias("_p"))
    units = able.join(F.broadcast(chosen), (F.col(key).cast("string") == F.col("_u")) & (F.col(project).cast("string") == F.col("_p")))
    others = negatives.join(F.broadcast(chosen.select("_p")), F.col(project).cast("string") == F.col("_p"), "left_semi")
    pairs = nearest_match(units.select(project, size, key), others.select(project, size, key), project, size, key)
    found = pairs.join(F.broadcast(chosen), (F.col("unit").cast("string") == F.col("_u")) & (F.col(project).cast("string") == F.col("_p")))
    return found.select("place", project, "category", "unit", "match", "distance")
