"""Rank statistics as window and aggregate expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .probability import Z975

#: Ranges that a group's distinct values are dealt out to.
RANGES = 64


def average_rank(value: str, by: list[str] | None = None) -> Column:
    """Ascending rank with ties at their mean, within groups.

    Ranks need the group in order, and a group is one task's work: for small groups.  :func:`with_ranks`
    is for groups of any size.
    """
    group = Window.partitionBy(*(by or []))
    return F.rank().over(group.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*(by or []), value)) - 1) / 2.0


def _below(df: DataFrame, places: dict[str, tuple[str, str]], ranges: int = RANGES) -> DataFrame:
    """Adds, for each new name, how many of an array's (sorted, under ``ranges`` values) are less than a value, from (array, value) columns.

    By halving, in steps that compile: a filter of the array is interpreted, value by value of every row.
    """
    step = 1 << (ranges - 1).bit_length() >> 1
    df = df.withColumns({name: F.lit(0) for name in places})
    while step:
        df = df.withColumns({name: F.col(name) + F.when(F.get(array, F.col(name) + (step - 1)) < F.col(value), step).otherwise(0) for name, (array, value) in places.items()})
        step //= 2
    return df


def _by_cell(entries: Column) -> Column:
    """An array by cell of a map's values; null where a cell has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 * RANGES)), lambda c: F.try_element_at(entries, c))


def with_ranks(df: DataFrame, columns: dict[str, str], by: list[str] | None = None, fixed: bool = False) -> DataFrame:
    """Adds average ranks (new name: value column) within groups; rows with a null value are dropped.

    No task ever sees a whole group in order.  A group's values are cut into cells at approximate quantiles: one cell for
    each value that is a cut, one for what lies between two cuts.  A rank is what stands in lower cells and, between cuts,
    the rank inside the cell.  Values that are cuts have a cell of their own and need no order, so their rows are
    dealt out evenly; whatever is frequent is a cut.

    Rows are read several times and the cuts depend on the order in which parts arrive.  So both are written once: all
    steps see the same sums, rows and cuts.  ``fixed`` says that ``df`` is already what is stored.
    """
    by, values = by or [], list(columns.values())
    df = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in values]))
    base, each = df if fixed else stored(df, "ranked"), range(len(values))
    keys = [f"_k{i}" for i in range(len(by))]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        if not keys:
            return left.crossJoin(F.broadcast(right))  # one row
        return left.join(right, [left[c].eqNullSafe(right[k]) for c, k in zip(by, keys, strict=True)]).drop(*keys)

    def celled(rows: DataFrame) -> DataFrame:
        rows = _below(rows, {f"_c{i}": (f"_b{i}", values[i]) for i in each})
        return rows.withColumns({f"_c{i}": 2 * F.col(f"_c{i}") + F.coalesce(F.get(f"_b{i}", F.col(f"_c{i}")) == F.col(values[i]), F.lit(False)).cast("int") for i in each})

    cuts = stored(base.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c, [i / RANGES for i in range(1, RANGES)], 10 * RANGES))).alias(f"_b{i}") for i, c in enumerate(values)]), "cuts")
    cells = celled(joined(base, cuts)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.posexplode(F.array(*[f"_c{i}" for i in each])).alias("_i", "_c"))
    lower = Window.partitionBy(*keys, "_i").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * RANGES rows a group
    counts = cells.groupBy(*keys, "_i", "_c").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    of = lambda i: _by_cell(F.map_from_entries(F.collect_list(F.when(F.col("_i") == i, F.struct("_c", F.struct("_before", "_n")))))).alias(f"_m{i}")
    counted = counts.groupBy(*keys).agg(*[of(i) for i in each])
    same = reduce(lambda a, b: a & b, [cuts[k].eqNullSafe(counted[k]) for k in keys], F.lit(True))
    places = stored(cuts.join(F.broadcast(counted) if not keys else counted, same).select(*[cuts[k] for k in keys], *[f"_{x}{i}" for i in each for x in "bm"]), "cells")
    out = celled(joined(base, places))
    out = out.select(*base.columns, *[f"_c{i}" for i in each], *[F.get(f"_m{i}", F.col(f"_c{i}")).alias(f"_p{i}") for i in each]).withColumn("_lot", F.floor(F.rand(1) * RANGES))
    for i, (name, value) in enumerate(columns.items()):
        is_cut = F.col(f"_c{i}") % 2 == 1
        out = out.withColumn("_own_lot", F.when(is_cut, F.col("_lot")).otherwise(F.lit(-1)))
        part = [*by, f"_c{i}", "_own_lot"]
        inside, equal = Window.partitionBy(*part).orderBy(value), Window.partitionBy(*part, value)
        between = F.rank().over(inside) + (F.count(F.lit(1)).over(equal) - 1) / 2.0
        out = out.withColumn(name, F.col(f"_p{i}")["_before"] + F.when(is_cut, (F.col(f"_p{i}")["_n"] + 1) / 2.0).otherwise(between)).drop("_own_lot", f"_c{i}", f"_p{i}")
    return out.drop("_lot")


def medians(df: DataFrame, value: str, by: list[str], name: str = "median") -> DataFrame:
    """(by..., name): the exact median of each group; nulls don't count.

    Equal values are counted before the shuffle, and the distinct values of a group are dealt out to ranges
    as for ranks; only the ranges that hold the middle are put in order, so no task sees a whole group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    same = lambda a, b, on: [a[k].eqNullSafe(b[f"{k}_"]) for k in on]
    other = lambda b, on: b.withColumnsRenamed({k: f"{k}_" for k in on})
    drop = lambda on: [f"{k}_" for k in on]
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    bounds = other(counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_b"), F.sum("_n").alias("_all")), keys)
    placed = _below(counts.join(bounds, same(counts, bounds, keys)).drop(*drop(keys)) if keys else counts.crossJoin(F.broadcast(bounds)), {"_r": ("_b", "_v")}).drop("_b")
    placed = stored(placed, "placed")  # cut once: approximate quantiles may come differently when they are computed again
    lower = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a group
    totals = placed.groupBy(*keys, "_r").agg(F.sum("_n").alias("_t"), F.max("_all").alias("_m")).withColumn("_before", F.coalesce(F.sum("_t").over(lower), F.lit(0)))
    low, high = F.floor((F.col("_m") + 1) / 2), F.floor((F.col("_m") + 2) / 2)
    middle = other(totals.filter((F.col("_before") < high) & (F.col("_before") + F.col("_t") >= low)).drop("_t"), [*keys, "_r"])
    inside = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(middle, same(placed, middle, [*keys, "_r"])).withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    at = lambda place: F.max(F.when((F.col("_from") < place) & (F.col("_from") + F.col("_n") >= place), F.col("_v")))
    found = near.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], name)


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """(by..., q0, q1, ...): exact quantiles (linear between neighbours) of each group; nulls and NaN don't count.

    Selection by ranges, as for medians: equal values are counted before the shuffle, a group's distinct values are dealt
    out to ranges cut at approximate quantiles, and only ranges that hold a wanted place are put in order.  No buffer holds a
    group's values, and no task a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    named = lambda b, on: b.withColumnsRenamed({k: f"{k}_" for k in on})
    same = lambda a, b, on: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{k}_"]) for k in on], F.lit(True))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    bounds = named(counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_b"), F.sum("_n").alias("_all")), keys)
    placed = _below(counts.join(bounds, same(counts, bounds, keys)), {"_r": ("_b", "_v")}).select(*keys, "_v", "_n", "_all", "_r")
    placed = stored(placed, "placed")  # cut once: approximate quantiles may come differently when they are computed again
    lower = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a group
    totals = placed.groupBy(*keys, "_r").agg(F.sum("_n").alias("_t"), F.max("_all").alias("_m")).withColumn("_before", F.coalesce(F.sum("_t").over(lower), F.lit(0)))
    places = [(F.floor(F.col("_m") * s - F.lit(s)) + 1, F.col("_m") * s - F.lit(s) - F.floor(F.col("_m") * s - F.lit(s))) for s in shares]  # place from 1 of the lower neighbour, and the part of the way to the next
    wanted = reduce(lambda a, b: a | b, [(F.col("_before") < p + 1) & (F.col("_before") + F.col("_t") >= p) for p, _ in places])
    kept = named(totals.filter(wanted).drop("_t"), [*keys, "_r"])
    inside = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(kept, same(placed, kept, [*keys, "_r"])).withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    at = lambda p: F.max(F.when((F.col("_from") < p) & (F.col("_from") + F.col("_n") >= p), F.col("_v")))
    told = [x for i, (p, part) in enumerate(places) for x in (at(p).alias(f"_lo{i}"), at(p + 1).alias(f"_hi{i}"), F.max(part).alias(f"_part{i}"))]
    found = near.groupBy(*keys).agg(*told)
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *[(F.col(f"_lo{i}") + F.col(f"_part{i}") * (F.coalesce(f"_hi{i}", f"_lo{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i in range(len(shares))])


def with_median(rows: DataFrame, df: DataFrame, value: str, by: list[str], name: str = "median") -> DataFrame:
    """``rows`` (one a group of ``df``) with the group's median; null where a group has no values."""
    found = medians(df, value, by, name)
    if not by:
        return rows.join(found, F.lit(True), "left")
    found = found.withColumnsRenamed({c: f"_m{i}" for i, c in enumerate(by)})
    return rows.join(found, [rows[c].eqNullSafe(found[f"_m{i}"]) for i, c in enumerate(by)], "left").drop(*[f"_m{i}" for i in range(len(by))])


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null under three points or if one side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.lit(1)) >= 3) & (spread > 2.220446049250313e-16), F.try_divide(F.covar_pop(x, y), spread))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, rho) of complete rows: Pearson correlation of average ranks."""
    by = by or []
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = with_ranks(rows, {"rx": "_x", "ry": "_y"}, by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("rho"))


def partial(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y with z held, from the three plain ones; null where undefined."""
    return F.try_divide(xy - xz * yz, F.sqrt(F.nullif(F.greatest((1 - xz * xz) * (1 - yz * yz), F.lit(0.0)), F.lit(0.0))))


def partial_spearman(df: DataFrame, x: str, y: str, z: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, rho) with one ranked control; the closed form equals that of residuals."""
    by = by or []
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*by, *[F.col(c).cast("double").alias(f"_{n}") for c, n in ((x, "x"), (y, "y"), (z, "z"))])
    ranked = with_ranks(rows, {f"r{n}": f"_{n}" for n in "xyz"}, by)
    plain = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("xy"), correlation("rx", "rz").alias("xz"), correlation("ry", "rz").alias("yz"))
    return plain.select(*by, "n", F.when(F.col("n") >= 4, partial(F.col("xy"), F.col("xz"), F.col("yz"))).alias("rho"))


def partial_of(plain: dict[frozenset, Column], x: str, y: str, controls: tuple[str, ...]) -> Column:
    """Correlation of x and y with all controls held, from the plain ones of each two, one control at a time."""
    if not controls:
        return plain[frozenset((x, y))]
    *rest, z = controls
    rest = tuple(rest)
    return partial(partial_of(plain, x, y, rest), partial_of(plain, x, z, rest), partial_of(plain, y, z, rest))


def partial_spearman_of(df: DataFrame, x: str, y: str, controls: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., n, rho) with several ranked controls: one aggregate gives all plain correlations of ranks."""
    by, names = by or [], [f"v{i}" for i in range(2 + len(controls))]
    rows = df.select(*by, *[F.col(c).cast("double").alias(n) for c, n in zip((x, y, *controls), names, strict=True)]).dropna(subset=names)
    ranked = with_ranks(rows, {f"r{n}": n for n in names}, by)
    each = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    plain = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[correlation(f"r{a}", f"r{b}").alias(a + b) for a, b in each])
    rho = partial_of({frozenset(p): F.col("".join(p)) for p in each}, "v0", "v1", tuple(names[2:]))
    return plain.select(*by, "n", F.when(F.col("n") >= 3 + len(controls), rho).alias("rho"))


def association(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, rho, low, high): raw rank correlation with Fisher's interval, as of a size measure against another."""
    rows = spearman(df, x, y, by)
    low, high = fisher_interval(F.col("rho"), F.col("n"))
    return rows.withColumn("low", low).withColumn("high", high)


def association_table(df: DataFrame, predictors: list[str], outcomes: list[str], control: str) -> DataFrame:
    """(predictor, outcome, n, rho, low, high, partial, partial_low, partial_high): every predictor with every outcome, raw and with the control held.

    Each pair takes the rows that have all three values.  Rows are unpivoted once, so one plan gives the whole table.
    """
    long = lambda names, k, v: F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias(k, v)
    rows = df.select(*dict.fromkeys(outcomes), F.col(control).cast("double").alias("z"), long(predictors, "predictor", "x"))
    rows = rows.select("predictor", "x", "z", long(outcomes, "outcome", "y")).dropna(subset=["x", "y", "z"])
    pair = ["predictor", "outcome"]
    ranked = with_ranks(rows, {"rx": "x", "ry": "y", "rz": "z"}, pair)
    found = ranked.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("rho"), correlation("rx", "rz").alias("xz"), correlation("ry", "rz").alias("yz"))
    found = found.withColumn("partial", F.when(F.col("n") >= 4, partial(F.col("rho"), F.col("xz"), F.col("yz")))).drop("xz", "yz")
    (low, high), (plow, phigh) = fisher_interval(F.col("rho"), F.col("n")), fisher_interval(F.col("partial"), F.col("n"), 1)
    return found.withColumns({"low": low, "high": high, "partial_low": plow, "partial_high": phigh})


def strongest(df: DataFrame, name: str, rho: str, by: list[str]) -> DataFrame:
    """(by..., name, rho): the row of the greatest absolute correlation of each group; of ties, the first name."""
    best = df.filter(F.col(rho).isNotNull()).groupBy(*by).agg(F.min(F.struct((-F.abs(rho)).alias("s"), F.col(name).alias("n"), F.col(rho).alias("r"))).alias("b"))
    return best.select(*by, F.col("b.n").alias(name), F.col("b.r").alias(rho))


def displayed(p: Column, separation: Column, alpha: float = 0.05, least: float = 0.55) -> Column:
    """Whether a contrast is marked in a report: significant and separated; missing values never are."""
    return F.coalesce((p < alpha) & (separation >= least), F.lit(False))


def fisher_interval(rho: Column, n: Column, controls: int = 0) -> tuple[Column, Column]:
    """95 % interval by Fisher's z; null for n <= controls + 3."""
    room = n - controls - 3
    half = F.lit(Z975) / F.sqrt(F.nullif(F.greatest(room, F.lit(0)), F.lit(0)))
    held = F.when((room > 0) & (F.abs(rho) < 1), rho)
    return F.tanh(F.atanh(held) - half), F.tanh(F.atanh(held) + half)


def auc(df: DataFrame, label: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n1, n0, auc): P(positive > negative) + P(equal) / 2, from ranks instead of pairs."""
    by = by or []
    rows = df.select(*by, F.col(label).alias("_l"), F.col(value).cast("double").alias("_x"))
    sums = with_ranks(rows, {"rx": "_x"}, by).groupBy(*by).agg(F.sum("_l").cast("long").alias("n1"), F.sum(1 - F.col("_l")).cast("long").alias("n0"), F.sum(F.col("_l") * F.col("rx")).alias("s"))
    n1, n0 = F.col("n1"), F.col("n0")
    return sums.select(*by, "n1", "n0", F.try_divide(F.col("s") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def holm(df: DataFrame, name: str, p: str, family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds ``adjusted`` and ``rejected``.  Missing p-values keep their place in the family's size and are never rejected."""
    family = family or []
    # p-value families are short lists of tests; each is one window partition
    whole, order = Window.partitionBy(*family), Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), name)
    m, i = F.count(F.lit(1)).over(whole), F.row_number().over(order)
    raw = df.withColumn("_raw", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - i + 1) * F.col(p))))
    running = F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn("adjusted", F.when(F.col(p).isNotNull(), running)).withColumn("rejected", F.coalesce(F.col("adjusted") <= alpha, F.lit(False))).drop("_raw")
