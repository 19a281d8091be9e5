"""Snapshots, diffs, merges and collection over commits (id, parents) and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import reaches


def snapshot(deltas: DataFrame, depth: DataFrame) -> DataFrame:
    """Entries after replaying the deltas of a chain: per uri the newest change, deletes left out.

    ``depth``: commit_id, depth (0 is the newest). A rename is a delete of its source and a set of its target.
    """
    own = deltas.select("commit_id", "log_pos", "uri", "op")
    moved = deltas.filter("op = 'rename' and rename_from is not null").select("commit_id", "log_pos", F.col("rename_from").alias("uri"), F.lit("delete").alias("op"))
    every = own.filter(F.col("op").isin("add", "update", "delete", "rename")).unionByName(moved).join(depth, "commit_id")
    last = every.groupBy("uri").agg(F.max_by(F.struct("op", "commit_id"), F.struct((-F.col("depth")).alias("d"), "log_pos", "commit_id", "op")).alias("l"))
    return last.filter("l.op <> 'delete'").select("uri", F.col("l.commit_id").alias("commit_id"))


def diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or changed keys from a to b."""
    x, y = a.select(key, F.col(value).alias("x"), F.lit(1).alias("ix")), b.select(key, F.col(value).alias("y"), F.lit(1).alias("iy"))
    j = x.join(y, key, "full_outer")
    change = F.when(F.col("ix").isNull(), "added").when(F.col("iy").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return j.select(key, change.alias("change")).filter("change is not null")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str, prefer: str | None = None) -> DataFrame:
    """Merged value per key. Only one side changed: that side; both alike: that value; else a conflict, decided by ``prefer`` (ours, theirs) or left open."""
    j = base.select(key, F.col(value).alias("b")).join(ours.select(key, F.col(value).alias("o")), key, "full_outer").join(theirs.select(key, F.col(value).alias("t")), key, "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    state = F.when(o.eqNullSafe(t), "same").when(t.eqNullSafe(b), "ours").when(o.eqNullSafe(b), "theirs").otherwise("conflict")
    won = {"ours": o, "theirs": t}.get(prefer or "", F.lit(None).cast("string"))
    merged = F.when(state == "theirs", t).when(state == "conflict", won).otherwise(o)
    return j.select(key, state.alias("state"), merged.alias("merged")).filter("merged is not null or state = 'conflict'")


def last_writer(df: DataFrame, key: list[str], clock: list[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*clock)).alias(value))


def collectable(commits: DataFrame, reachable: DataFrame, keep_recent: int, before: Column) -> DataFrame:
    """Commits that no ref reaches, older than ``before`` and not among the most recent ones."""
    recent = commits.orderBy(F.desc("committed_at"), F.desc("id")).limit(keep_recent).select("id")
    return commits.filter(F.col("committed_at") < before).join(reachable, "id", "left_anti").join(recent, "id", "left_anti").select("id")


def heads(commits: DataFrame) -> DataFrame:
    """Newest commit of each scope."""
    return commits.groupBy("scope").agg(F.max_by("id", F.struct("committed_at", "id")).alias("head"))


def pick(parent: DataFrame, commit: DataFrame, target: DataFrame, key: str, value: str, prefer: str | None = None) -> DataFrame:
    """The change from parent to commit applied to the target: a three-way merge on the parent."""
    return three_way(parent, target, commit, key, value, {"ours": "ours", "theirs": "theirs"}.get(prefer or ""))


def to_rebase(pairs: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits that a rebase of ``head`` onto ``onto`` (scope, head, onto) applies: scope, commit_id, back (steps from the head).

    They are those of the head's first-parent path (node, path) before the first one that ``onto`` reaches or is. A head without path stands alone.
    """
    p = pairs.join(paths.select(F.col("node").alias("head"), "path"), "head", "left").select("scope", "onto", F.posexplode(F.reverse(F.coalesce("path", F.array("head")))).alias("back", "commit_id"))
    known = reaches(edges, p.select(F.col("onto").alias("start"), F.col("commit_id").alias("goal")))
    met = p.join(known.select(F.col("start").alias("onto"), F.col("goal").alias("commit_id")), ["onto", "commit_id"], "left_semi").groupBy("scope").agg(F.min("back").alias("stop"))
    return p.join(met, "scope", "left").filter("stop is null or back < stop").select("scope", "commit_id", "back")
