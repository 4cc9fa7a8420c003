"""Comparing two states of a graph: symmetrically, and as base and head of a branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.graph import both_known, edges_of, named, resolvable
from quarrygraph.session import Scratch

LIST_CAP = 50
MODULE_CAP = 20
KEY = ["src", "tgt", "kind"]


def entity_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """(name, side, type, source_id): side 'only1', 'only2' or 'both', in one grouping of both sides by name."""
    tag = lambda df, n: named(df).select(F.col("entity_name").alias("name"), F.lit(n).alias("n"), F.struct(F.col("entity_type").alias("type"), "source_id").alias("info"))
    both = tag(one, 1).unionByName(tag(two, 2)).groupBy("name").agg(F.max(F.when(F.col("n") == 1, F.struct("n", "info"))).alias("a"), F.max(F.when(F.col("n") == 2, F.struct("n", "info"))).alias("b"))
    side = F.when(F.col("b").isNull(), "only1").when(F.col("a").isNull(), "only2").otherwise("both")
    info = F.coalesce("b.info", "a.info")
    return both.select("name", side.alias("side"), info["type"].alias("type"), info["source_id"].alias("source_id"))


def edge_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """(src, tgt, kind, side) of distinct edges: 'only1', 'only2' or 'both'."""
    both = one.select(*KEY, F.lit(1).alias("n")).unionByName(two.select(*KEY, F.lit(2).alias("n"))).groupBy(*KEY).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return both.select(*KEY, F.when(F.col("lo") != F.col("hi"), "both").when(F.col("lo") == 1, "only1").otherwise("only2").alias("side"))


def relation_changes(rel1: DataFrame, rel2: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, change, src, tgt, kind): edges that one of the shared ``names`` (name) gained or lost, as either end; a loop once."""
    changed = edge_diff(edges_of(rel1), edges_of(rel2)).where("side <> 'both'")
    per = changed.select("*", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("name")).join(names.select("name"), "name", "left_semi")
    return per.select(F.col("name").alias("entity"), F.when(F.col("side") == "only2", "added").otherwise("removed").alias("change"), *KEY)


def compare(ent1: DataFrame, rel1: DataFrame, ent2: DataFrame, rel2: DataFrame) -> dict[str, DataFrame]:
    """'entities' (``entity_diff``), 'relations' (``relation_changes`` of shared names) and 'summary', one row."""
    ents = entity_diff(ent1, ent2)
    rels = relation_changes(rel1, rel2, ents.where("side = 'both'"))
    n = lambda s: F.count_if(F.col("side") == s)
    one = F.lit(1).alias("one")
    summary = ents.agg(n("only1").alias("only_in_ws1"), n("only2").alias("only_in_ws2"), n("both").alias("in_both")).withColumn("one", one)
    summary = summary.join(F.broadcast(rels.agg(F.count_distinct("entity").alias("relations_diff")).withColumn("one", one)), "one").drop("one")
    return {"entities": ents, "relations": rels, "summary": summary}


class BranchDiff:
    """What a head has gained and lost against its base; edges count if both ends are entities of their side."""

    def __init__(self, base_ent: DataFrame, base_rel: DataFrame, head_ent: DataFrame, head_rel: DataFrame):
        work = Scratch(base_ent.sparkSession)
        self.base_ent, self.head_ent = work.cut(named(base_ent)), work.cut(named(head_ent))
        self._all = {"base": edges_of(base_rel), "head": edges_of(head_rel)}
        self._edges = work.cut(edge_diff(resolvable(edges_of(base_rel), self.base_ent), resolvable(edges_of(head_rel), self.head_ent)))

    def entities(self) -> DataFrame:
        """(name, change, type, source_id): 'added', 'removed' or 'shared'."""
        d = entity_diff(self.base_ent, self.head_ent)
        return d.select("name", F.when(F.col("side") == "only1", "removed").when(F.col("side") == "only2", "added").otherwise("shared").alias("change"), "type", "source_id")

    def edges(self) -> DataFrame:
        """(src, tgt, kind, change) of removed and added edges."""
        return self._edges.where("side <> 'both'").select(*KEY, F.when(F.col("side") == "only1", "removed").otherwise("added").alias("change"))

    def broken_chains(self) -> DataFrame:
        """Removed edges whose source is still there."""
        return self._chains("removed", self.head_ent)

    def new_chains(self) -> DataFrame:
        """Added edges whose source was there before."""
        return self._chains("added", self.base_ent)

    def _chains(self, change: str, ents: DataFrame) -> DataFrame:
        return self.edges().where(F.col("change") == change).join(ents.select(F.col("entity_name").alias("src")), "src", "left_semi").select(*KEY)

    def content(self, digest: Column | None, comparable: bool = True) -> DataFrame:
        """(name, state) of shared names: 'same', 'changed' or, without a digest on either side, 'unknown'."""
        d = digest if digest is not None and comparable else F.lit(None).cast("string")
        a = self.base_ent.select(F.col("entity_name").alias("name"), d.alias("a"))
        b = self.head_ent.select(F.col("entity_name").alias("name"), d.alias("b"))
        return a.join(b, "name").select("name", F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))

    def content_status(self, content: DataFrame) -> DataFrame:
        """One row (status, comparable, uncomparable, changed); ``changed`` is null if nothing can be compared."""
        n = lambda s: F.count_if(F.col("state") == s)
        c = content.agg((n("same") + n("changed")).alias("comparable"), n("unknown").alias("uncomparable"), n("changed").alias("_changed"))
        none = (F.col("comparable") == 0) & (F.col("uncomparable") > 0)
        status = F.when(none, "unavailable").when(F.col("uncomparable") > 0, "partial").otherwise("available")
        return c.select(status.alias("status"), "comparable", "uncomparable", F.when(~none, F.col("_changed")).alias("changed"))

    def module_delta(self, depth: int = 2) -> DataFrame:
        """(module, edges_added, edges_removed): by the module of the edge's source, on the side that has the edge."""
        side = lambda change, ents: self.edges().where(F.col("change") == change).groupBy("src", "change").agg(F.count(F.lit(1)).alias("n")).join(ents.select(F.col("entity_name").alias("src"), X.module_of(F.col("source_id"), depth).alias("module")), "src")
        both = side("added", self.head_ent).unionByName(side("removed", self.base_ent))
        s = lambda c: F.coalesce(F.sum(F.when(F.col("change") == c, F.col("n"))), F.lit(0))
        return both.groupBy("module").agg(s("added").alias("edges_added"), s("removed").alias("edges_removed"))

    def capped(self, frame: DataFrame, *order: str, limit: int = LIST_CAP) -> DataFrame:
        return frame.orderBy(*order).limit(limit)

    def top_modules(self) -> DataFrame:
        return self.module_delta().orderBy(F.desc(F.col("edges_added") + F.col("edges_removed")), "module").limit(MODULE_CAP)

    def unresolved(self) -> DataFrame:
        """One row (base_unresolved_edges, head_unresolved_edges): edge rows of each side with an end that is no entity of it."""
        sides = [("base", self.base_ent), ("head", self.head_ent)]
        one = lambda side, ents: both_known(self._all[side].select("src", "tgt"), ents).agg(F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias(f"{side}_unresolved_edges")).withColumn("one", F.lit(1))
        a, b = [one(*s) for s in sides]
        return a.join(F.broadcast(b), "one").drop("one")

    def summary(self) -> DataFrame:
        """One row of uncapped totals."""
        one = lambda df, *a: df.agg(*a).withColumn("one", F.lit(1))
        n = lambda c, s, name: F.count_if(F.col(c) == s).alias(name)
        count = lambda name: F.count(F.lit(1)).alias(name)
        out = one(self.entities(), n("change", "added", "entities_added"), n("change", "removed", "entities_removed"), n("change", "shared", "entities_shared"))
        parts = [
            one(self._edges, n("side", "only2", "edges_added"), n("side", "only1", "edges_removed")),
            one(self.broken_chains(), count("broken_chains")),
            one(self.new_chains(), count("new_chains")),
            one(self.module_delta(), count("modules_changed")),
            self.unresolved().withColumn("one", F.lit(1)),
        ]
        for p in parts:
            out = out.join(F.broadcast(p), "one")
        return out.drop("one")
