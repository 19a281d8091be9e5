"""Claims as literals, contradictions between them, and what they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: words that deny a claim, in the order in which they are looked for
NEGATIONS = ("not", "never", "no", "cannot", "can't", "does not", "do not", "without", "false", "禁用", "不能", "不会", "不是", "不支持", "无")
# fixed values: words of a claim that carry nothing
FILLERS = ("the", "a", "an", "to", "of", "and", "or", "for", "with", "in", "on", "this", "that", "is", "are", "be", "should", "must", "can", "will")


def _plain(text: Column) -> Column:
    """Lower case, letters, digits and ``_ - = : !`` only, words one space apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s_=:!-]", " "), r"\s+", " "))


def literals(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct literals of each text: key, subject, relation, object, negated.

    A sentence with ``!=``, ``=`` or ``:`` between two sides says what its left side is; any other says
    its first word (fillers and the first denying word left out) of the rest, or that it is true.
    """
    s = df.select(key, F.explode(F.split(text, r"[.;\n。；]")).alias("s")).select(key, _plain(F.col("s")).alias("s")).filter("s <> ''")
    for i, sep in enumerate(("!=", "=", ":")):
        at = F.instr("s", sep)
        s = s.withColumn(f"l{i}", F.when(at > 0, F.trim(F.substring("s", F.lit(1), at - 1)))).withColumn(f"r{i}", F.when(at > 0, F.trim(F.substring("s", at + len(sep), F.length("s")))))
    left, right = F.coalesce("l0", "l1", "l2"), F.coalesce("r0", "r1", "r2")
    paired = (left != "") & (right != "")
    claim, negated = F.col("s"), F.lit(False)
    for m in reversed(NEGATIONS):
        at = F.instr("s", f" {m} ")
        inside = F.concat(F.substring("s", F.lit(1), at - 1), F.lit(" "), F.substring("s", at + len(m) + 2, F.length("s")))
        starts = F.startswith(F.col("s"), F.lit(m))
        claim = F.when(starts, F.substring("s", len(m) + 1, 1 << 30)).when(at > 0, inside).otherwise(claim)
        negated = F.when(starts | (at > 0), True).otherwise(negated)
    s = s.withColumn("paired", F.coalesce(paired, F.lit(False))).withColumn("left", left).withColumn("right", right).withColumn("not_equal", F.col("l0").isNotNull())
    s = s.withColumn("w", F.filter(F.split(claim, " "), lambda w: (w != "") & ~w.isin(*FILLERS))).withColumn("denied", negated)
    out = s.filter("paired or size(w) > 0").select(
        key,
        F.when(F.col("paired"), F.col("left")).otherwise(F.get("w", F.lit(0))).alias("subject"),
        F.when(F.col("paired"), "is").otherwise("asserts").alias("relation"),
        F.when(F.col("paired"), F.col("right")).when(F.size("w") == 1, "true").otherwise(F.array_join(F.slice("w", 2, 1 << 30), " ")).alias("object"),
        F.when(F.col("paired"), F.col("not_equal")).otherwise(F.col("denied")).alias("negated"),
    )
    return out.distinct()


def literal_conflicts(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pairs of claims of which one affirms what the other denies: incoming, existing, subject, object, severity.

    Both: uri, l0, entrenchment. Severity is the mean entrenchment, between 0 and 1.
    """
    said = ["subject", "relation", "object"]
    a = literals(incoming, "uri", "l0").join(incoming.select("uri", F.col("entrenchment").alias("ea")), "uri").select(F.col("uri").alias("incoming"), *said, F.col("negated").alias("na"), "ea")
    b = literals(base, "uri", "l0").join(base.select("uri", F.col("entrenchment").alias("eb")), "uri").select(F.col("uri").alias("existing"), *said, F.col("negated").alias("nb"), "eb")
    severity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("ea") + F.col("eb")) / 2))
    return a.join(b, said).filter("na <> nb").select("incoming", "existing", "subject", "object", severity.alias("severity"))


def snapshot_contradictions(left: DataFrame, right: DataFrame, least: float, confidence=None) -> DataFrame:
    """Entries (uri, l0) of two snapshots whose texts differ and contradict each other with a ``confidence`` (a column of two texts; by default word similarity where phrases are opposed) of ``least`` or more."""
    if not 0 <= least <= 1:
        raise ValueError("least must be within 0 and 1")
    confidence = confidence or (lambda a, b: F.when(T.claims_contradict(a, b), T.jaccard(T.words(a), T.words(b))).otherwise(0.0))
    j = left.select("uri", F.col("l0").alias("a")).join(right.select("uri", F.col("l0").alias("b")), "uri").filter("a <> b")
    return j.select("uri", confidence(F.col("a"), F.col("b")).alias("confidence")).filter(F.col("confidence") >= least)


def evolve_backward(products: DataFrame, entries: DataFrame, edges: DataFrame, group: str, least: float = 0.3) -> DataFrame:
    """Which earlier entries a new product changes: group, product, uri, summary.

    ``products``: product, the group, text; ``entries``: uri, the group, l0; ``edges``: from, to. Entries whose set of words has a
    similarity of ``least`` or more, and those one edge away from them.
    """
    bag = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    j = products.select(group, "product", bag(F.col("text")).alias("pw")).filter("size(pw) > 0").join(entries.select(group, "uri", bag(F.col("l0")).alias("w")), group)
    hit = j.filter(T.jaccard(F.col("pw"), F.col("w")) >= least).select(group, "product", "uri")
    near = hit.join(edges.select(F.col("from").alias("uri"), "to"), "uri").select(group, "product", F.col("to").alias("uri"))
    known = entries.select("uri")
    every = hit.unionByName(near.join(known, "uri", "left_semi")).distinct()
    return every.withColumn("summary", F.concat(F.lit("backward-evolved from "), "product", F.lit(" (jaccard+graph)")))


def curiosity(df: DataFrame, at: Column, least: float = 0.45, far: float = 0.68) -> DataFrame:
    """What to look into: uri, query, action, priority. ``df``: uri, l0, quality, tags, valid_until.

    A valid entry of an uncertainty (1 - quality) of ``least`` or more is searched for, beyond ``far`` elsewhere too; one
    tagged for it is looked for elsewhere anyhow.
    """
    v = df.filter(F.coalesce(F.col("valid_until") > at, F.lit(True)))
    u = F.round(1 - F.coalesce("quality", F.lit(0.5)), 9)
    tasks = F.array(
        F.when(u >= least, F.struct(F.when(u > far, "FederatedDiscovery").otherwise("LocalSearch").alias("action"), u.alias("priority"))),
        F.when(F.array_contains("tags", "active-learning:federated-discovery"), F.struct(F.lit("FederatedDiscovery").alias("action"), F.lit(0.72).alias("priority"))),
    )
    t = v.select("uri", F.substring("l0", 1, 160).alias("query"), F.explode(F.array_compact(tasks)).alias("t"))
    return t.groupBy("uri", "query", "t.action").agg(F.max("t.priority").alias("priority"))


def inherited(entries: DataFrame, nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Where an entry (uri, agent) of an agent really comes from: uri, effective, from_parent.

    ``nodes``: agent, scope, parent (null: none); ``overrides``: agent, pattern, action, place. The first pattern that the
    address starts with decides: Hide drops it, any other keeps it. Without one the address is mapped to the
    parent's scope, if there is a parent; an unknown parent or agent gives nothing.
    """
    e = entries.select("uri", "agent").join(nodes.select("agent", "scope", "parent"), "agent")
    first = e.select("agent", "uri").join(overrides, "agent").filter(F.startswith(F.col("uri"), F.col("pattern"))).groupBy("agent", "uri").agg(F.min_by("action", "place").alias("action"))
    up = nodes.select(F.col("agent").alias("parent"), F.col("scope").alias("above"))
    j = e.join(first, ["agent", "uri"], "left").join(up, "parent", "left").filter("action is null or action <> 'Hide'")
    mapped = F.when(F.col("action").isNotNull() | F.col("parent").isNull(), F.col("uri")).when(F.col("above").isNotNull(), F.concat(F.substring("uri", F.lit(1), F.instr(F.col("uri"), F.col("scope")) - 1), "above", F.substring("uri", F.instr(F.col("uri"), F.col("scope")) + F.length("scope"), F.length("uri"))))
    return j.select("uri", mapped.alias("effective"), (F.col("action").isNull() & F.col("parent").isNotNull()).alias("from_parent")).filter("effective is not null")


def instantiate(templates: DataFrame, variables: DataFrame) -> DataFrame:
    """Entries of every template (uri_template, abstract_template, content_type) for every scope (scope, vars): ``{name}`` gives way to the value. The templates go to every task; over a thousand are refused."""
    if templates.limit(1001).count() > 1000:
        raise ValueError("over 1000 templates")
    j = variables.crossJoin(F.broadcast(templates))
    fill = lambda c: F.aggregate(F.map_entries("vars"), F.col(c), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return j.select(F.concat_ws("/", "scope", fill("uri_template")).alias("uri"), fill("abstract_template").alias("l0"), "content_type")


def peer_order(peers: DataFrame, intent: str, weight: float = 0.18) -> DataFrame:
    """Score and place of each peer (peer, utility) for an intent, best first, ties by name."""
    # fixed values: what an intent adds
    bonus = {"FastLookup": 0.04, "HighPrecision": 0.06, "HighRecall": 0.02, "CrossDomainSynthesis": 0.02, "PrivacyCritical": 0.08, "TrainingCandidate": 0.05, "CorroborationCheck": 0.05}[intent]
    learnt = F.coalesce((F.col("utility") - 0.5) * 0.18, F.lit(0.0)) * weight
    return peers.groupBy("peer").agg(F.max("utility").alias("utility")).select("peer", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + learnt + bonus)), 9).alias("score"))
