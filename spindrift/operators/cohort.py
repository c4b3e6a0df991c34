"""Cohort mining: review rows and timelines, matching, manifests, asserted joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


class CohortError(ValueError):
    """An input that breaks a cohort's rules; ``code`` is stable."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def require_none(df: DataFrame, code: str) -> None:
    """Fails with ``code`` if there is any row."""
    if df.limit(1).count():
        raise CohortError(code)


def strict_join(left: DataFrame, right: DataFrame, on: list[str], code: str) -> DataFrame:
    """Inner join in which every left row must have a partner."""
    require_none(left.join(right, on, "left_anti"), code)
    return left.join(right, on)


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the one with the greatest ``order``.  An aggregate, so repeated keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    rows = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return rows.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def row_candidates(df: DataFrame) -> DataFrame:
    """Review rows that can be studied: a .java path, a 40-digit commit, 12 to 900 tokens, at most 24,000 bytes."""
    items = text.tokens(F.col("code"))
    cheap = F.endswith(F.lower("path"), F.lit(".java")) & F.col("commit").rlike("^[0-9a-fA-F]{40}$") & (F.octet_length("code") <= 24_000)
    return df.filter(cheap).withColumn("token_count", F.size(items)).filter("token_count BETWEEN 12 AND 900")


def review_event(timeline: Column, review_id: Column) -> Column:
    """The one inline review with the id; null if there is none or more than one."""
    hits = F.filter(timeline, lambda e: (e["type"] == "inlineReview") & (e["id"] == review_id))
    return F.when(F.size(hits) == 1, hits[0])


def _chunks(event: Column, path: Column) -> Column:
    return F.filter(event["revised_code"]["changed_code"], lambda c: F.contains(c["header"], F.concat(F.lit("b/"), path)))


def same_file_revision(event: Column, path: Column) -> Column:
    """New sides of the chunks of the reviewed file, blank line between; null without commit, chunks or text."""
    sides = F.filter(F.transform(_chunks(event, path), lambda c: text.diff_new_side(c["chunk"])), lambda x: x != "")
    return F.when(event["revised_code"]["commit"].isNotNull() & (F.size(sides) > 0), F.array_join(sides, "\n\n"))


def aligned_revision(event: Column, path: Column) -> Column:
    """(old, new) sides of the file's chunks; null unless both have text and differ."""
    chunks = _chunks(event, path)
    side = lambda f: F.array_join(F.filter(F.transform(chunks, lambda c: f(c["chunk"])), lambda x: x != ""), "\n\n")
    old, new = side(text.diff_old_side), side(text.diff_new_side)
    return F.when(event["revised_code"]["commit"].isNotNull() & (old != "") & (new != "") & (old != new), F.struct(old.alias("before"), new.alias("after")))


def exclusion_reason(revision: Column, recorded: Column, request: Column) -> Column:
    """The first reason that a case is left out for; null if it stays."""
    return F.when(~recorded, "no_recorded_revision").when(revision.isNull(), "same_file_nonempty_revision_unavailable").when(request.isNull() | (F.trim(request) == ""), "review_request_invalid")


def nearest_match(left: DataFrame, right: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """For each left row the right row of its group nearest in log size, with replacement; ties by stable key.

    Instead of pairing all rows of a group, both sides are sorted together by size: the nearest row
    is the last one before or the first one after, found by one window per group.  Of equal sizes on
    the right, the least key stands for all.
    """
    side = lambda df, is_left: df.select(group, F.log1p(F.col(size).cast("double")).alias("s"), F.col(key).alias("k"), F.lit(is_left).alias("is_left"))
    rights = side(right, False).groupBy(group, "s", "is_left").agg(F.min_by("k", text.stable_key(F.col("k").cast("string"))).alias("k"))
    rows = side(left, True).unionByName(rights.select(group, "s", "k", "is_left"))
    # both frames only grow from row to row, so a group of any size takes linear time
    until = lambda *order: Window.partitionBy(group).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    candidate = F.when(~F.col("is_left"), F.struct("s", "k"))
    down = F.last(candidate, ignorenulls=True).over(until("s"))
    up = F.last(candidate, ignorenulls=True).over(until(F.desc("s")))
    rows = rows.withColumn("down", down).withColumn("up", up).filter("is_left")
    told = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("s") - F.col(c)["s"]).alias("distance"), text.stable_key(F.col(c)["k"].cast("string")).alias("h"), F.col(c)["k"].alias("match")))
    best = F.array_min(F.array_compact(F.array(told("down"), told("up"))))
    return rows.withColumn("b", best).filter("b IS NOT NULL").select(group, F.col("k").alias("unit"), F.col("b.match").alias("match"), F.col("b.distance").alias("distance"))


def closest_pairs(pairs: DataFrame, distance: str, key: str, k: int) -> DataFrame:
    """The ``k`` pairs of least distance (ties by stable key), numbered in stable order."""
    top = pairs.withColumn("_h", text.stable_key(F.col(key).cast("string"))).orderBy(distance, "_h").limit(k)
    number = F.row_number().over(Window.orderBy("_h"))  # at most k rows
    return top.withColumn("pair_id", F.format_string("half-pair-%04d", number)).drop("_h")


def next_event(df: DataFrame, by: str, at: str, asked: Column, answers: Column) -> DataFrame:
    """For each asking row the time of the first answering row of its group at or after it (null if none).

    One window per group, over times from the last to the first, so that its frame only grows; rows with
    equal times see each other.
    """
    later = Window.partitionBy(by).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("next_at", F.min(F.when(answers, F.col(at))).over(later)).filter(asked)


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, finding) of two (path, bytes, sha256) manifests."""
    e, a = expected.select("path", F.col("bytes").alias("eb"), F.col("sha256").alias("eh")), actual.select("path", F.col("bytes").alias("ab"), F.col("sha256").alias("ah"))
    rows = e.join(a, "path", "full_outer")
    finding = F.when(F.col("ab").isNull(), "missing").when(F.col("eb").isNull(), "unexpected").when(F.col("eb") != F.col("ab"), "size_mismatch").when(F.col("eh") != F.col("ah"), "hash_mismatch")
    return rows.select("path", finding.alias("finding")).filter("finding IS NOT NULL")


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def pivot_stages(df: DataFrame, key: str, stage: str, value: str, stages: list, code: str | None = None) -> DataFrame:
    """(key, one column a stage) of the units that have all stages; with ``code``, one that lacks any is an error.  One aggregate."""
    wide = df.groupBy(key).agg(*[F.max(F.when(F.col(stage) == s, F.col(value))).alias(f"{stage}_{s}") for s in stages])
    whole = reduce(lambda a, b: a & b, [F.col(f"{stage}_{s}").isNotNull() for s in stages])
    if code:
        require_none(wide.filter(~whole), code)
    return wide.filter(whole)


def by_content(df: DataFrame, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(contents, rows): each distinct text once with its digest (what is computed on it is computed once), and ``df`` with a digest ``<text>_sha256`` for each text column to join results back by."""
    rows = df.withColumns({f"{c}_sha256": F.sha2(c, 256) for c in texts})
    each = rows.select(F.explode(F.array(*[F.struct(F.col(f"{c}_sha256").alias("sha256"), F.col(c).alias("text")) for c in texts])).alias("x")).select("x.*")
    return each.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.first("text").alias("text")), rows


def complete_records(df: DataFrame, unit: str, predictor: str, outcomes: list[str], size: str) -> DataFrame:
    """Rows with a predictor.  A repeated unit, an outcome outside [0, 1] or a size that isn't positive is an error."""
    require_none(df.groupBy(unit).count().filter("count > 1"), "duplicate_unit")
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | ~F.col(c).between(0, 1) for c in outcomes])
    require_none(df.filter(bad), "outcome_out_of_range")
    require_none(df.filter(F.col(size).isNull() | (F.col(size) <= 0)), "size_not_positive")
    return df.filter(F.col(predictor).isNotNull())


def three_way(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): in the first only, the second only, or both."""
    rows = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return rows.select(key, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").otherwise("common").alias("side"))


def review_metadata(timeline: Column, event: Column, pr_created: Column, merge_commit: Column) -> Column:
    """Times, counts and flags of a review within its timeline."""
    at = F.to_timestamp(event["createdAt"])
    hours = lambda later, earlier: (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9
    commits = F.filter(F.transform(F.filter(timeline, lambda e: e["type"] == "commit"), lambda e: F.to_timestamp(e["committedDate"])), lambda t: t >= at)
    reviews = F.filter(timeline, lambda e: e["type"] == "inlineReview")
    return F.struct(
        hours(at, F.to_timestamp(pr_created)).alias("hours_since_pr_created"), hours(F.array_min(commits), at).alias("hours_to_next_commit"),
        F.size(reviews).alias("inline_review_count"), F.size(F.filter(timeline, lambda e: e["type"] == "commit")).alias("commit_count"),
        F.size(F.array_distinct(F.transform(reviews, lambda e: e["author"]))).alias("reviewer_count"), F.size(event["replies"]).alias("reply_count"), merge_commit.isNotNull().alias("merged"),
    )
