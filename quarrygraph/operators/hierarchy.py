"""Parent-child rows to full hierarchies (problem 3): depth, root, nested-set range, paths, descendants, cycles.

Upward, every node's subtree size is summed; downward, prefix sums over siblings give each node a range of preorder
positions, [lft, rgt], that holds exactly its descendants. Both passes work by doubling: round k knows the 2^k-th
ancestor of every node, so a tree of depth d takes log2(d) rounds. Nodes for which no round finds a top are what the
upward pass cannot process: they lie on a cycle or lead into one. Roots and depths are known after the upward pass;
the ranges are worked out where they are asked for (descendants, ancestors, paths).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators.counted import counted
from quarrygraph.operators.joins import spread_join
from quarrygraph.session import Scratch

#: Siblings are numbered in this many buckets per parent, so no task gets all children of a hot parent.
SIBLING_BUCKETS = 256
#: A jump target with more followers than this is joined by broadcast of the hottest targets.
HOT_FOLLOWERS = 50_000
#: Positions per step when a range is unfolded.
UNFOLD = 8192


def inheritance_links(relations: DataFrame) -> DataFrame:
    """(child, parent) of the resolved (or null-qualified) relations whose keywords are 'inherits' or 'extends', trimmed
    and in lower case, and whose target is neither null, empty nor '<unresolved>'; equal links are merged later."""
    rel = counted(relations, ["ord"], "indexed_at", ["src_id", "tgt_id", "keywords", "resolution_qualifier"])
    kind = F.lower(F.regexp_replace("keywords", r"^\s+|\s+$", ""))
    return rel.where(kind.isin("inherits", "extends") & (F.coalesce("resolution_qualifier", F.lit("resolved")) == "resolved") & ~F.col("tgt_id").isin("", "<unresolved>")).select(F.col("src_id").alias("child"), F.col("tgt_id").alias("parent"))


def _follow(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    return left.join(right, key, how) if hot is None else spread_join(left, right, key, hot, "followers", how)


@dataclass
class _Upward:
    """What the upward pass leaves: all nodes, those of trees with their sizes, those on or below cycles, and each round's jumps."""

    work: Scratch
    nodes: DataFrame
    trees: DataFrame
    cyclic: DataFrame | None
    steps: list[tuple[DataFrame, DataFrame | None]]


def _upward(links: DataFrame, keep_steps: bool) -> _Upward:
    work = Scratch(links.sparkSession)
    parents = links.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    ends = F.array(F.struct("node", "parent"), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    n, inner = F.count(F.lit(1)), F.count_if(F.col("parent").isNotNull())
    nodes, told = work.told(parents.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.max("parent").alias("parent")), n=n, active=inner)
    total, active = told["n"], told["active"]
    top = F.col("parent").isNull()
    state = nodes.select(
        "node", F.col("parent").alias("jump"), F.when(top, 0).cast("bigint").alias("depth"), F.when(top, F.col("node")).alias("root"), F.col("node").alias("low"), F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("moved")
    )
    steps: list[tuple[DataFrame, DataFrame | None]] = []
    images, k, followers = -1, 0, None
    while active:
        old = (state, followers)
        going = state.where("jump IS NOT NULL")
        followers, told = work.told(going.groupBy("jump").agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("followers")), seen=n, widest=F.max("followers"))
        seen, hot = told["seen"], followers if told["widest"] > HOT_FOLLOWERS else None
        if keep_steps:
            steps.append((going.select("node", "jump"), hot))
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"), F.col("low").alias("low2"))
        on = _follow(going, ahead, "jump", hot).select(
            "node", F.col("jump2").alias("jump"), (F.col("depth2") + F.lit(1 << k)).alias("depth"), F.col("root2").alias("root"), F.least("low", "low2").alias("low"), "size", (F.col("low2") < F.col("low")).cast("int").alias("moved")
        )
        both = state.where("jump IS NULL").select(*on.columns[:-1], F.lit(0).alias("moved")).unionByName(on)
        grown = both.join(followers.select(F.col("jump").alias("node"), "more"), "node", "left")
        grown = grown.select("node", "jump", "depth", "root", "low", F.least(F.col("size") + F.coalesce("more", F.lit(0)), F.lit(total)).alias("size"), "moved")
        state, told = work.told(grown, left=F.count_if(F.col("jump").isNotNull()), moved=F.coalesce(F.sum(F.when(F.col("jump").isNotNull(), F.col("moved"))), F.lit(0)))
        k += 1
        still = told["left"] == active and seen == images and not told["moved"]
        active, images = told["left"], seen
        if not keep_steps:
            work.drop(*[f for f in old if f is not None])
        if still:
            break
    cyclic = None
    if active:
        going = state.where("jump IS NOT NULL")
        ring = going.join(followers.select(F.col("jump").alias("node")), "node", "left_semi").select("node", "low")
        on_ring = ring.select("node", F.col("low").alias("ring_low"))
        ahead = ring.select(F.col("node").alias("jump"), F.col("low").alias("root"))
        tails = _follow(going.join(ring, "node", "left_anti").select("node", "jump"), ahead, "jump", followers)
        cyclic = on_ring.select("node", F.col("ring_low").alias("root"), F.lit(-1).cast("bigint").alias("depth")).unionByName(tails.select("node", "root", F.lit(-2).cast("bigint").alias("depth")))
    trees = nodes.join(state.where("jump IS NULL").select("node", "depth", "root", "size"), "node")
    return _Upward(work, nodes, trees, cyclic, steps)


def depths(links: DataFrame) -> DataFrame:
    """(node, parent, root, depth, size) as in ``hierarchy``, from the upward pass alone."""
    up = _upward(links, keep_steps=False)
    out = up.trees.select("node", "parent", "root", "depth", "size")
    if up.cyclic is None:
        return out
    return out.unionByName(up.nodes.join(up.cyclic, "node").select("node", "parent", "root", "depth", F.lit(None).cast("bigint").alias("size")))


def hierarchy(links: DataFrame) -> DataFrame:
    """(node, parent, root, depth, size, lft, rgt), one row per node of ``links`` (child, parent).

    Tops have a null parent, depth 0 and themselves as root; ``size`` counts the node and its descendants, whose
    positions within the root are lft..rgt (the top has 0). Nodes on a cycle have depth -1, nodes whose ancestors lead
    into one -2, both with the cycle's smallest name as root and null size, lft and rgt. A child with several parents
    keeps the smallest name; rows with a null end are no links; repeated links count once; no links give no rows.
    """
    up = _upward(links, keep_steps=True)
    trees = up.work.cut(up.trees)
    place = up.work.cut(_offsets(trees))
    for going, hot in up.steps:
        old = place
        ahead = place.select(F.col("node").alias("jump"), F.col("pos").alias("before"))
        step = _follow(going, ahead, "jump", hot).select("node", "before")
        place = up.work.cut(place.join(step, "node", "left").select("node", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos")))
        up.work.drop(old, going)
    out = trees.join(place, "node").select("node", "parent", "root", "depth", "size", F.col("pos").alias("lft"), (F.col("pos") + F.col("size") - 1).alias("rgt"))
    if up.cyclic is not None:
        null = F.lit(None).cast("bigint")
        out = out.unionByName(up.nodes.join(up.cyclic, "node").select("node", "parent", "root", "depth", null.alias("size"), null.alias("lft"), null.alias("rgt")))
    return out


def _offsets(trees: DataFrame) -> DataFrame:
    """(node, pos): each node's preorder position less its parent's: 1 + the sizes of the siblings before it."""
    sib = trees.where("parent IS NOT NULL").select("node", "parent", "size", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)).alias("bucket"))
    before = Window.partitionBy("parent", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sib.groupBy("parent", "bucket").agg(F.sum("size").alias("all")).select("parent", "bucket", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    inner = sib.select("node", "parent", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("inner"))
    child = inner.join(base, ["parent", "bucket"]).select("node", (F.col("inner") + F.col("base") + 1).alias("pos"))
    return child.unionByName(trees.where("parent IS NULL").select("node", F.lit(0).cast("bigint").alias("pos")))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance): all descendants of every node, from the nested-set ranges of ``hierarchy``.

    Each range is unfolded into positions, in steps, and joined to the nodes at these positions: the work is in
    proportion to the result. Nodes on or below a cycle have no range and give no rows.
    """
    t = tree.where("lft IS NOT NULL")
    wide = t.where("size > 1").select("root", F.col("node").alias("ancestor"), F.col("depth").alias("above"), "lft", "rgt", F.explode(F.expr(f"sequence(lft + 1, rgt, {UNFOLD})")).alias("lo"))
    # the steps of a long range are dealt over all tasks before they are unfolded; their number is given, as such small rows would be put together again
    wide = wide.repartition(int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "ancestor", "lo")
    at = wide.select("root", "ancestor", "above", F.explode(F.expr(f"sequence(lo, least(lo + {UNFOLD - 1}, rgt))")).alias("lft"))
    return at.join(t.select("root", "lft", "node", "depth"), ["root", "lft"]).select("ancestor", "node", (F.col("depth") - F.col("above")).alias("distance"))


def paths(tree: DataFrame, sep: str = " > ") -> DataFrame:
    """(node, path): the names from the root down to each node below a root, joined by ``sep``. A path is as long as the node is deep."""
    up = descendants(tree).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False).alias("up"))
    return up.select("node", F.array_join(F.concat(F.transform("up", lambda x: x["ancestor"]), F.array("node")), sep).alias("path"))
