"""Current state of a keyed table from a feed of changes, repeated and out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import keep

SEGMENT = 65_536

SET, GONE, MOVED_IN = "set", "gone", "in"


def distinct_changes(feed: DataFrame, scope: str, seq: str, arrival: str) -> DataFrame:
    """One row per (scope, sequence): the copy that arrived first, other columns with it.

    Rows without sequence number cannot be ordered and change nothing.
    """
    rest = [c for c in feed.columns if c not in (scope, seq)]
    first = feed.filter(F.col(seq).isNotNull()).groupBy(scope, seq).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("first"))
    return first.select(scope, seq, *[F.col("first")[c].alias(c) for c in rest])


def key_events(changes: DataFrame) -> DataFrame:
    """What each change (scope, seq, key, op, full, source, ref) does to which key: scope, key, seq, kind, ref, source, value_seq.

    ``set`` puts a value, ``gone`` leaves a tombstone, ``in`` takes over the
    value of ``source``. A rename is a tombstone at its source and ``in`` at its
    target. Unknown ops, sets without payload, renames onto themselves or
    without source, and changes without key change nothing.
    """
    one = lambda k, kind, source: F.struct(k.alias("key"), F.lit(kind).alias("kind"), source.cast("string").alias("source"))
    none = F.lit(None)
    key_, source = F.col("key"), F.col("source")
    does = (
        F.when(F.col("op").isin("add", "update") & F.col("full"), F.array(one(key_, SET, none)))
        .when(F.col("op") == "delete", F.array(one(key_, GONE, none)))
        .when((F.col("op") == "rename") & (source != key_), F.array(one(key_, MOVED_IN, source), one(source, GONE, none)))
    )
    return changes.filter(key_.isNotNull()).select("scope", "seq", "ref", F.explode(does).alias("e")).select("scope", F.col("e.key").alias("key"), "seq", F.col("e.kind").alias("kind"), "ref", F.col("e.source").alias("source"), F.col("seq").alias("value_seq"))


def base_events(base: DataFrame) -> DataFrame:
    """Rows of an earlier state as events at their last change: a value, or a tombstone."""
    kind = F.when(F.col("present"), SET).otherwise(GONE)
    return base.select("scope", "key", F.col("last_seq").alias("seq"), kind.alias("kind"), F.col("value_ref").alias("ref"), F.lit(None).cast("string").alias("source"), "value_seq")


def _before(events: DataFrame) -> DataFrame:
    """Each event with the event before it at the same key (``prev``).

    Sequence numbers are unique within a scope, so a segment of ``SEGMENT``
    numbers bounds what one task sorts even where one key holds a third of all
    changes; the last event of each segment is handed on to the next.
    """
    e = events.withColumn("segment", F.floor(F.col("seq") / SEGMENT))
    what = F.struct("seq", "kind", "ref", "value_seq")
    inside = e.withColumn("prev", F.lag(what).over(W.partitionBy("scope", "key", "segment").orderBy("seq", "kind")))
    lasts = e.groupBy("scope", "key", "segment").agg(F.max(what).alias("last"))
    handed = lasts.withColumn("handed", F.lag("last").over(W.partitionBy("scope", "key").orderBy("segment"))).filter(F.col("handed").isNotNull())
    same = [F.col("i.scope").eqNullSafe(F.col("h.scope")), F.col("i.key") == F.col("h.key"), F.col("i.segment") == F.col("h.segment")]
    return inside.alias("i").join(handed.alias("h"), same, "left").select("i.scope", "i.key", "i.seq", "i.kind", F.coalesce("i.prev", "h.handed").alias("prev"))


def _cut(options: Column) -> Column:
    """Options in order of precedence: tombstones and repeats fall out, nothing counts after the first value."""
    live = F.array_distinct(F.filter(options, lambda o: o["kind"] != GONE))
    first = F.array_position(F.transform(live, lambda o: o["kind"]), SET).cast("int")
    return F.when(first > 0, F.slice(live, F.lit(1), first)).otherwise(live)


def resolve_moves(events: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The value that each ``in`` event leaves at its key: scope, seq, value_seq, value_ref (null: none).

    An ``in`` event depends on what its source held before it and, if that was
    nothing, on what its own key held. These two are its options; options that
    are ``in`` events themselves are replaced by their own options, for all at
    once, so a chain of renames halves with each round.
    """
    touched = events.filter(F.col("kind") == MOVED_IN).select("scope", F.explode(F.array("key", "source")).alias("key")).distinct()
    near = events.join(touched.select(F.col("scope").alias("s"), F.col("key").alias("k")), F.col("scope").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")), "left_semi")
    both = _before(near).groupBy("scope", "seq").agg(
        F.max(F.col("kind") == MOVED_IN).alias("moves"),
        F.max_by("prev", F.when(F.col("kind") == GONE, 1).otherwise(0)).alias("at_source"),
        F.max_by("prev", F.when(F.col("kind") == MOVED_IN, 1).otherwise(0)).alias("at_key"),
    )
    state = keep(both.filter("moves").select("scope", "seq", _cut(F.filter(F.array("at_source", "at_key"), lambda o: o.isNotNull())).alias("options")), "moves")
    for _ in range(max_rounds):
        is_open = F.exists("options", lambda o: o["kind"] == MOVED_IN)
        todo = state.filter(is_open)
        if todo.isEmpty():
            break
        asked = todo.select("scope", "seq", F.posexplode("options").alias("at", "o"))
        known = state.select(F.col("scope").alias("s"), F.col("seq").alias("q"), F.col("options").alias("inner"))
        inner = asked.join(known, F.col("scope").eqNullSafe(F.col("s")) & (F.col("o.seq") == F.col("q")) & (F.col("o.kind") == MOVED_IN), "left")
        spliced = inner.groupBy("scope", "seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("o.kind") == MOVED_IN, F.col("inner")).otherwise(F.array("o")).alias("os")))), lambda x: x["os"])).alias("options"))
        state = keep(state.filter(~is_open).unionByName(spliced.select("scope", "seq", _cut(F.col("options")).alias("options"))), "moves")
    else:
        raise RuntimeError("renames did not settle")
    return state.select("scope", "seq", F.get("options", F.lit(0))["value_seq"].alias("value_seq"), F.get("options", F.lit(0))["ref"].alias("value_ref"))


def current_state(
    feed: DataFrame, scope: str = "scope", seq: str = "log_pos", arrival: str = "feed_pos", key: str = "uri", op: str = "op", payload: str = "entry_json", moved_from: str = "rename_from", ref: str = "commit_id", tombstones: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """State of every key after all changes of its scope, each change once, in sequence order.

    Fold: the maximum of struct(sequence, operation, payload reference) per key.
    It is commutative and associative, so copies, disorder and late changes don't
    matter and hot keys are combined before the shuffle. Of the payload only whether there is one is read.
    ``base``: an earlier result with ``tombstones``, whose rows take part at their last change, so changes that come in
    after it, or once more, find their place (what a key held before its last change is not in the base: a rename older than that finds nothing at such a source). Renames first become a tombstone at the source and a
    reference at the target (``key_events``); references that win the fold are
    looked up in ``resolve_moves``.

    Result: scope, key, last_seq, value_seq, value_ref, present; with
    ``tombstones`` also the keys that are gone, so that a later batch can be
    folded onto the result. Keys equal but for scope are different keys; a null
    scope is one scope. Rows without sequence number or key change nothing. An
    empty feed gives no rows. Extra columns are not read.
    """
    c = feed.select(F.col(scope).alias("scope"), F.col(seq).cast("bigint").alias("seq"), F.col(arrival).alias("arrival"), F.col(key).alias("key"), F.col(op).alias("op"), F.col(payload).isNotNull().alias("full"), F.col(moved_from).alias("source"), F.col(ref).cast("string").alias("ref"))
    events = key_events(distinct_changes(c, "scope", "seq", "arrival"))
    events = keep(events if base is None else events.unionByName(base_events(base)), "events")
    last = events.groupBy("scope", "key").agg(F.max(F.struct("seq", "kind", "ref", "value_seq")).alias("last"))
    moves = resolve_moves(events).select(F.col("scope").alias("s"), F.col("seq").alias("q"), F.col("value_seq").alias("moved_seq"), F.col("value_ref").alias("moved_ref"))
    out = last.join(moves, F.col("scope").eqNullSafe(F.col("s")) & (F.col("last.seq") == F.col("q")) & (F.col("last.kind") == MOVED_IN), "left")
    kind = F.col("last.kind")
    out = out.select(
        "scope",
        "key",
        F.col("last.seq").alias("last_seq"),
        F.when(kind == SET, F.col("last.value_seq")).when(kind == MOVED_IN, F.col("moved_seq")).alias("value_seq"),
        F.when(kind == SET, F.col("last.ref")).when(kind == MOVED_IN, F.col("moved_ref")).alias("value_ref"),
    ).withColumn("present", F.col("value_seq").isNotNull())
    return out if tombstones else out.filter("present")
