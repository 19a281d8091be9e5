"""Trees out of child-parent links: paths, depths, roots, descendants, and circles.

Nodes lie in blocks: ranges in the order of history (connected component, as far
as a few rounds of contraction tell), time and node, small enough for one task. In every round each block peels its leaves
bottom up, as far as it gets by itself, and draws together what is left: a node
with one way in and one way out gives way to a longer link. So of a history cut
by blocks little but its crossings stays, and neighbouring blocks are merged for
the next round. Rounds grow with the logarithm of the number of blocks, not
with the depth. In reverse order of the rounds, and of the peeling within a
block, every node then gets its place from its parent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, keep
from .components import connected_components

BLOCK_LINKS = 200_000
LEAST_LINKS = 5_000
NO_SHRINK = 8


def _blocks(links: DataFrame, block_links: int | None) -> tuple[DataFrame, int]:
    """Columns node, block, and the number of blocks. ``links``: child, parent, seen_at. Two blocks a core, if that makes between ``LEAST_LINKS`` and ``BLOCK_LINKS`` links a block."""
    n = links.count()
    per = block_links or min(BLOCK_LINKS, max(LEAST_LINKS, n // (2 * links.sparkSession.sparkContext.defaultParallelism)))
    blocks = max(1, -(-n // per))
    # numbers for names: two names with one number would only lie in one history
    numbered = links.select(F.xxhash64("child").alias("a"), F.xxhash64("parent").alias("b"))
    comp = connected_components(numbered, max_rounds=4, settle=False).select(F.col("node").alias("number"), "component")
    ends = links.select(F.col("child").alias("node"), "seen_at").unionByName(links.select(F.col("parent").alias("node"), F.lit(None).cast("timestamp_ntz").alias("seen_at")))
    nodes = ends.groupBy("node").agg(F.min("seen_at").alias("at")).withColumn("number", F.xxhash64("node"))
    placed = nodes.join(comp, "number").repartitionByRange(blocks, "component", "at", "node")
    return keep(placed.select("node", F.spark_partition_id().alias("block")), "blocks"), blocks


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _fewer(blocks: int, left: int, per: int) -> int:
    """How many neighbouring blocks become one, at least two, for ``left`` links to fill blocks of ``per``."""
    return max(2, -(-blocks // max(1, -(-left // per))))


# circles


_SHRUNK = "block int, what string, src string, dst string, db int, via string"


def _shrink(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a graph. Rows: ``arc`` (src in the block, dst in block db), ``in`` (src in the block has n arcs from outside).

    Gives the arcs that stay (``arc``), nodes that other blocks must know of as gone (``to``, dst null) or as
    part of another (``to``), and ``on``: src is on a circle if and only if dst and ``via`` are on the same one.
    """
    block = int(rows["block"].iloc[0])
    outs: dict = defaultdict(dict)
    ins: dict = defaultdict(set)
    arcs = rows[rows["what"] == "arc"]
    for a, b, db in zip(arcs["src"], arcs["dst"], arcs["db"]):
        outs[a][b] = db
        if db == block:
            ins[b].add(a)
    given = rows[rows["what"] == "in"]
    outside = dict(zip(given["src"], given["n"].astype("int64")))
    nodes = set(outs) | set(ins) | set(outside)
    gone, moved, on = set(), {}, []

    def leave(x: str) -> list[str]:
        touched = []
        for b, db in outs.pop(x, {}).items():
            if db == block and b != x:
                ins[b].discard(x)
                touched.append(b)
        for a in ins.pop(x, ()):
            if a != x:
                outs[a].pop(x, None)
                touched.append(a)
        return touched

    ready = list(nodes)
    while ready:
        x = ready.pop()
        if x not in gone and (not outs.get(x) or not (ins.get(x) or outside.get(x))):
            gone.add(x)
            ready += leave(x)
    local = pd.DataFrame([(a, b) for a, to in outs.items() for b, db in to.items() if db == block], columns=["src", "dst"])
    groups = defaultdict(list)
    for x, head in _knots(local)[["node", "circle"]].itertuples(index=False):
        groups[head].append(x)
    for head, members in groups.items():
        inside = set(members)
        for x in members:
            if x != head:
                moved[x] = head
                on.append((x, head, head))
                outside[head] = outside.get(head, 0) + outside.pop(x, 0)
                for b, db in outs.pop(x, {}).items():
                    if db == block:
                        ins[b].discard(x)
                    if b not in inside:
                        outs[head][b] = db
                        if db == block:
                            ins[b].add(head)
                for a in ins.pop(x, ()):
                    if a in outs:
                        outs[a].pop(x, None)
                        if a not in inside:
                            outs[a][head] = block
                            ins[head].add(a)
        outs[head] = {b: db for b, db in outs[head].items() if b not in inside} | {head: block}
        ins[head] = {a for a in ins[head] if a not in inside} | {head}
    ready = list(outs)
    spliced = []
    while ready:
        x = ready.pop()
        if x not in outs or len(outs[x]) != 1 or len(ins.get(x, ())) != 1 or outside.get(x):
            continue
        (a,), ((b, db),) = ins[x], outs[x].items()
        if a == x or b == x:
            continue
        del outs[x], ins[x]
        spliced.append((x, a, b))
        gone.add(x)
        del outs[a][x]
        outs[a][b] = db
        if db == block:
            ins[b].discard(x)
            ins[b].add(a)
            ready.append(b)
        ready.append(a)
    # an end that was drawn together later stands for what lies on its own longer link
    ends: dict = {}
    for x, a, b in reversed(spliced):
        ends[x] = ends.get(a) or ends.get(b) or (a, b)
    on += [(x, *e) for x, e in ends.items()]
    stay = [(block, "arc", a, b, db, None) for a, to in outs.items() for b, db in to.items()]
    told = [(block, "to", x, None, block, None) for x in outside.keys() & gone] + [(block, "to", x, h, block, None) for x, h in moved.items()]
    made = [(block, "on", x, a, block, b) for x, a, b in on]
    return _frame(stay + told + made, _SHRUNK)


def _knots(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one group of links that lie on circles: Tarjan's strong components, without recursion."""
    out = defaultdict(list)
    for a, b in zip(rows["src"], rows["dst"]):
        out[a].append(b)
    number: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    found = []
    for start in list(out):
        if start in number:
            continue
        walk: list[tuple[str, Iterator]] = [(start, iter(out[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on.add(start)
        while walk:
            x, rest = walk[-1]
            for y in rest:
                if y not in number:
                    number[y] = low[y] = len(number)
                    stack.append(y)
                    on.add(y)
                    walk.append((y, iter(out.get(y, ()))))
                    break
                if y in on:
                    low[x] = min(low[x], number[y])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[x])
                if low[x] == number[x]:
                    at = stack.index(x) if len(stack) < 50 else len(stack) - 1 - stack[::-1].index(x)
                    group = stack[at:]
                    del stack[at:]
                    on.difference_update(group)
                    if len(group) > 1 or x in out.get(x, ()):
                        found += [(y, min(group), len(group)) for y in group]
    return _frame(found, "node string, circle string, circle_size bigint")


def _spread(arcs: DataFrame) -> DataFrame:
    """Strong components of residual links too many for one task: forward colouring, then backward reach within a colour."""
    found, left = None, arcs.select("src", "dst")
    while not left.isEmpty():
        color = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("color", F.col("node"))
        while True:
            heard = left.join(color, left["src"] == color["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("heard"))
            new = keep(color.join(heard, "node", "left").select("node", F.greatest("color", F.coalesce("heard", "color")).alias("color"), (F.coalesce("heard", "color") > F.col("color")).alias("moved")), "colors")
            color = new.select("node", "color")
            if new.filter("moved").isEmpty():
                break
        same = keep(left.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").filter("cs = cd").select("src", "dst", "cs"), "colored")
        reach = color.filter("node = color").select("node", "color")
        size = -1
        while (n := reach.count()) != size:
            size = n
            reach = keep(same.join(reach, (same["dst"] == reach["node"]) & (same["cs"] == reach["color"])).select(F.col("src").alias("node"), "color").unionByName(reach).distinct(), "reach")
        groups = reach.groupBy("color").agg(F.count("*").alias("circle_size"), F.min("node").alias("circle"))
        loops = left.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
        new = reach.join(groups, "color").join(loops, "node", "left").filter("circle_size > 1 or loop").select("node", "circle", "circle_size")
        found = new if found is None else found.unionByName(new)
        left = keep(left.join(reach.select(F.col("node").alias("src")), "src", "left_anti").join(reach.select(F.col("node").alias("dst")), "dst", "left_anti"), "rest")
    return found if found is not None else arcs.select(F.col("src").alias("node"), F.col("src").alias("circle"), F.lit(1).cast("bigint").alias("circle_size")).limit(0)


def _links(df: DataFrame, child: str, parent: str, ordinal: str | None, seen_at: str | None) -> DataFrame:
    cols = [F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent"), (F.col(ordinal) if ordinal else F.lit(0)).alias("ordinal"), (F.col(seen_at) if seen_at else F.lit(None).cast("timestamp_ntz")).alias("seen_at")]
    return df.select(*cols).filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("child", "parent").agg(F.min("ordinal").alias("ordinal"), F.min("seen_at").alias("seen_at"))


def circles(df: DataFrame, child: str, parent: str, seen_at: str | None = None, block_links: int | None = None) -> DataFrame:
    """Nodes from which links lead back to themselves: node, circle (its smallest node), circle_size.

    All links count, whatever their ordinal. Blocks are peeled from below and from
    above; circles within a block become one node, chains one link, and neighbouring blocks are merged
    until one is left, or the links between circles alone. Should a graph not shrink, strong components of the rest
    are found by colouring. Null ends are no links, repeated links count once, a link to itself is a circle of one.
    """
    links = keep(_links(df, child, parent, None, seen_at), "links")
    home, blocks = _blocks(links, block_links)
    s, t = home.select(F.col("node").alias("src"), F.col("block").alias("sb")), home.select(F.col("node").alias("dst"), F.col("block").alias("db"))
    arcs = keep(links.select(F.col("child").alias("src"), F.col("parent").alias("dst")).join(s, "src").join(t, "dst").select("src", "dst", "sb", "db"), "arcs")
    left = arcs.count()
    per = max(1, -(-left // blocks))
    drawn: list[DataFrame] = []
    null = F.lit(None).cast("string")
    while True:
        own = arcs.select(F.col("sb").alias("block"), F.lit("arc").alias("what"), "src", "dst", "db", F.lit(0).cast("bigint").alias("n"))
        # how many, not which: a parent of any number of children elsewhere is one row
        heard = arcs.filter("sb <> db").groupBy(F.col("db").alias("block"), F.col("dst").alias("src")).agg(F.count("*").alias("n"))
        outside = heard.select("block", F.lit("in").alias("what"), "src", null.alias("dst"), F.lit(None).cast("int").alias("db"), "n")
        done = keep(own.unionByName(outside).groupBy("block").applyInPandas(_shrink, _SHRUNK), "shrunk")
        drop(arcs)
        drawn.append(done.filter("what = 'on'").select(F.col("src").alias("node"), F.col("dst").alias("a"), F.col("via").alias("b")))
        fixes = done.filter("what = 'to'").select(F.col("src").alias("dst"), F.col("dst").alias("now"), F.lit(True).alias("fix"))
        stay = done.filter("what = 'arc'").select("src", "dst", F.col("block").alias("sb"), "db").join(fixes, "dst", "left").filter("fix is null or now is not null").withColumn("dst", F.coalesce("now", "dst"))
        before = left
        if blocks == 1:
            left_arcs = keep(stay.select("src", "dst", "sb", "db").distinct(), "arcs")
            break
        left_arcs = keep(stay.select("src", "dst", "sb", "db").distinct(), "arcs")
        left = left_arcs.count()
        if left_arcs.filter("src <> dst").isEmpty():
            break
        many = _fewer(blocks, left, per)
        if left > 0.9 * before and left * many > NO_SHRINK * BLOCK_LINKS * blocks:
            rest = _spread(left_arcs).select("node", F.col("circle").alias("label"))
            left_arcs = None
            break
        blocks = -(-blocks // many)
        arcs = left_arcs.withColumns({"sb": F.floor(F.col("sb") / many).cast("int"), "db": F.floor(F.col("db") / many).cast("int")})
    found = keep(rest if left_arcs is None else left_arcs.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("label")), "labels")
    for step in reversed(drawn):
        a, b = found.select(F.col("node").alias("a"), "label"), found.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        more = step.join(a, "a").join(b, "b").filter("label = lb").select("node", "label")
        found = keep(found.unionByName(more), "labels")
    whole = found.groupBy("label").agg(F.min("node").alias("circle"), F.count("*").alias("circle_size"))
    return found.join(whole, "label").select("node", "circle", "circle_size")


# trees over first parents


_STATE = "block int, what string, seq bigint, node string, size bigint, parent string, pb int, hops bigint, held bigint, last string, child string"
_COLS = [c.split()[0] for c in _STATE.split(", ")]


def _peel(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a forest, or of trees that hang on circles. Rows: ``live`` (a node, its subtree's size as far as known, and its link: parent
    in block pb, hops, ``held``: sizes of the nodes drawn into the link, ``last``: the one next to the parent), ``in`` (node has ``size`` links from outside).

    Leaves are peeled bottom up (``leaf``, its size is final); a node with one child left, in the block, is
    drawn into the link of that child (``mid``). Sizes for parents elsewhere are sent (``add``); the rest stays ``live``.
    """
    block = int(rows["block"].iloc[0])
    live = rows[rows["what"] == "live"]
    given = rows[rows["what"] == "in"]
    outside = dict(zip(given["node"], given["size"].astype("int64")))
    at: dict = {}
    kids: dict = defaultdict(set)
    for n, size, parent, pb, hops, held, last in zip(live["node"], live["size"], live["parent"], live["pb"], live["hops"], live["held"], live["last"]):
        parent = parent if isinstance(parent, str) else None
        at[n] = [int(size), parent, int(pb) if parent is not None else None, int(hops), int(held), last]
        if parent is not None and pb == block:
            kids[parent].add(n)
    out = []
    adds: dict = defaultdict(int)
    ready = [n for n in at if not kids.get(n) and not outside.get(n)]
    while ready:
        n = ready.pop()
        size, parent, pb, hops, held, last = at.pop(n)
        out.append(("leaf", n, size, parent, pb, hops, held, last, None))
        if parent is None:
            continue
        if pb != block:
            adds[parent, pb] += size + held
            continue
        at[parent][0] += size + held
        kids[parent].discard(n)
        if not kids[parent] and not outside.get(parent):
            ready.append(parent)
    for n in list(at):
        size, parent, pb, hops, held, last = at[n]
        if parent is None or parent == n or outside.get(n) or len(kids[n]) != 1:
            continue
        (child,) = kids[n]
        low = at[child]
        out.append(("mid", n, size + low[4], parent, pb, hops, held, last, child))
        at[child] = [low[0], parent, pb, low[3] + hops, low[4] + size + held, last]
        del at[n]
        if pb == block:
            kids[parent].discard(n)
            kids[parent].add(child)
    done = [(block, what, i, *rest) for i, (what, *rest) in enumerate(out)]
    done += [(block, "add", 0, p, size, None, pb, 0, 0, None, None) for (p, pb), size in adds.items()]
    done += [(block, "live", 0, n, size, parent, pb, hops, held, last, None) for n, (size, parent, pb, hops, held, last) in at.items()]
    return _frame(done, _STATE)


_PLACE = "node string, state string, top string, depth bigint, size bigint"


def _place(rows: pd.DataFrame) -> pd.DataFrame:
    """What one block peeled in one round, in reverse order; rows ``known`` are the nodes outside of it that it refers to (state in ``last``, top in ``parent``, depth in ``hops``)."""
    known = rows[rows["what"] == "known"]
    at = {n: (state, top, depth, size) for n, state, top, depth, size in zip(known["node"], known["last"], known["parent"], known["hops"], known["size"])}
    mine = rows[rows["what"] != "known"].sort_values("seq", ascending=False, kind="stable")
    done = []
    for what, n, size, parent, hops, last, child in zip(mine["what"], mine["node"], mine["size"], mine["parent"], mine["hops"], mine["last"], mine["child"]):
        if what == "mid":
            size += at[child][3]
        if what == "mid" and at[child][0] == "circle":
            place = "circle", None, 0, 0
        elif not isinstance(parent, str):
            place = "tree", n, 0, size
        else:
            state, top, depth, _ = at[parent]
            place = ("below_circle", last, hops - 1, size) if state == "circle" else (state, top, depth + hops, size)
        at[n] = place
        done.append((n, *place))
    return _frame(done, _PLACE)


def places(df: DataFrame, child: str, parent: str, ordinal: str | None = None, seen_at: str | None = None, block_links: int | None = None) -> DataFrame:
    """Parent, root, depth and number of descendants of every node, over first parents, without the paths.

    Result: node, parent, root, depth (0 at a root), n_descendants, state, and for ``below_circle`` top and
    below (the first node outside the circle, and the distance to it). See ``hierarchy``.
    """
    ids = df.select(F.col(child).cast("string").alias("node")).unionByName(df.select(F.col(parent).cast("string").alias("node"))).filter("node is not null").distinct()
    links = _links(df, child, parent, ordinal, seen_at)
    first = links.groupBy("child").agg(F.min(F.struct("ordinal", "parent", "seen_at")).alias("f")).select("child", F.col("f.parent").alias("parent"), F.col("f.seen_at").alias("seen_at"))
    first = keep(first, "first")
    home, blocks = _blocks(first, block_links)
    up = first.select(F.col("child").alias("node"), "parent")
    start = home.join(up, "node", "left").join(home.select(F.col("node").alias("parent"), F.col("block").alias("pb")), "parent", "left")
    zero = F.lit(0).cast("bigint")
    null = F.lit(None).cast("string")
    live = keep(start.select("block", F.lit("live").alias("what"), zero.alias("seq"), "node", F.lit(1).cast("bigint").alias("size"), "parent", "pb", F.lit(1).cast("bigint").alias("hops"), zero.alias("held"), F.col("node").alias("last"), null.alias("child")), "live")
    per = max(1, -(-live.count() // blocks))
    rounds = []
    while True:
        heard = live.filter("pb <> block").groupBy(F.col("pb").alias("block"), F.col("parent").alias("node")).agg(F.count("*").alias("size"))
        outside = heard.select("block", F.lit("in").alias("what"), zero.alias("seq"), "node", "size", null.alias("parent"), F.lit(None).cast("int").alias("pb"), zero.alias("hops"), zero.alias("held"), null.alias("last"), null.alias("child"))
        done = keep(live.unionByName(outside).groupBy("block").applyInPandas(_peel, _STATE), "peeled")
        drop(live)
        rounds.append(done.filter("what in ('leaf', 'mid')"))
        adds = done.filter("what = 'add'").groupBy("node").agg(F.sum("size").alias("more"))
        rest = done.filter("what = 'live'").join(adds, "node", "left").withColumn("size", F.col("size") + F.coalesce("more", zero)).select(*_COLS)
        live = keep(rest, "live")
        left = live.count()
        if blocks == 1 or not left:
            break
        many = _fewer(blocks, left, per)
        blocks = -(-blocks // many)
        live = live.withColumns({"block": F.floor(F.col("block") / many).cast("int"), "pb": F.floor(F.col("pb") / many).cast("int")})
    # what is left at the end are circles
    found = keep(live.select("node", F.lit("circle").alias("state"), null.alias("top"), zero.alias("depth"), zero.alias("size")), "placed")
    for step in reversed(rounds):
        refs = step.select("block", F.explode(F.array("parent", "child")).alias("node")).filter("node is not null").distinct().join(found, "node")
        known = refs.select("block", F.lit("known").alias("what"), zero.alias("seq"), "node", "size", F.col("top").alias("parent"), F.lit(None).cast("int").alias("pb"), F.col("depth").alias("hops"), zero.alias("held"), F.col("state").alias("last"), null.alias("child"))
        found = keep(found.unionByName(step.unionByName(known).groupBy("block").applyInPandas(_place, _PLACE)), "placed")
    every = ids.join(found, "node", "left").join(up, "node", "left")
    state = F.coalesce("state", F.lit("tree"))
    tree = state == "tree"
    return keep(
        every.select(
            "node", "parent", F.when(tree, F.coalesce("top", "node")).alias("root"), F.when(tree, F.coalesce("depth", zero)).cast("int").alias("depth"),
            F.when(state != "circle", F.coalesce("size", F.lit(1)) - 1).cast("bigint").alias("n_descendants"), state.alias("state"),
            F.when(state == "below_circle", F.col("top")).alias("top"), F.when(state == "below_circle", F.col("depth")).cast("int").alias("below"),
        ),
        "places",
    )


def paths(tree: DataFrame) -> DataFrame:
    """Node and path (from the root, or from the first node outside a circle, to the node) of all nodes of ``places`` but circles'. Paths are doubled in length in every round."""
    top = F.coalesce("depth", "below") == 0
    now, earlier = keep(tree.filter("state <> 'circle'").select("node", F.when(~top, F.col("parent")).alias("jump"), F.array("node").alias("path")), "paths"), None
    while True:
        known = now if earlier is None else now.unionByName(earlier)
        active = now.filter("jump is not null")
        if active.isEmpty():
            return known.select("node", "path")
        above = known.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("upper"))
        ended = now.filter("jump is null")
        now = keep(active.join(above, "jump").select("node", F.col("next").alias("jump"), F.concat("upper", "path").alias("path")), "paths")
        earlier = ended if earlier is None else earlier.unionByName(ended)


def hierarchy(df: DataFrame, child: str, parent: str, ordinal: str | None = None, seen_at: str | None = None, block_links: int | None = None) -> DataFrame:
    """Full path, depth, root and number of descendants of every node, over first parents.

    Bottom-up peeling sends subtree sizes to the parents; in reverse peel order
    every node then takes its place from its parent. Result: node, parent, root, depth
    (0 at a root), path (root first), n_descendants, state: ``tree``, ``circle``
    (on a circle of first parents) or ``below_circle``. The latter two have no
    root or depth; paths below a circle start at the first node outside it, and a
    circle's nodes have neither path nor n_descendants. An id that only occurs as parent is a node. The first parent is
    the one with the smallest ordinal, then the smallest id. Null ends are no
    links; a child with null parents only is a root. Repeated rows count once.
    The paths are as large as the sum of all depths; where histories are very deep, use ``places``.
    """
    tree = places(df, child, parent, ordinal, seen_at, block_links)
    return tree.join(paths(tree), "node", "left").select("node", "parent", "root", "depth", "path", "n_descendants", "state")


def descendants(tree: DataFrame) -> DataFrame:
    """One row per node, circles' nodes excepted, and descendant: ancestor, descendant, distance. ``tree``: result of ``hierarchy``."""
    p = tree.filter("path is not null").select("node", (F.size("path") - 1).alias("depth"), F.posexplode("path").alias("at", "ancestor"))
    return p.filter("at < depth").select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))
