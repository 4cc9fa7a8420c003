"""Degrees, orphans, coupling and topology of a graph of entities and relations.

Entities have one row per entity_name with entity_type and source_id; relations have src_id, tgt_id and keywords, one
row per edge. Names and endpoints that are null or '' are missing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.joins import spread_join
from quarrygraph.session import Scratch


def named(entities: DataFrame) -> DataFrame:
    """Entities that have a name."""
    return entities.where(F.coalesce("entity_name", F.lit("")) != "")


def edges_of(relations: DataFrame) -> DataFrame:
    """(src, tgt, kind) of relations with both endpoints."""
    return relations.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), X.text(F.col("keywords")).alias("kind")).where("src <> '' AND tgt <> ''")


def analysed(entities: DataFrame) -> DataFrame:
    """Entities that analyses look at: named, neither external nor noise."""
    return named(entities).where(~X.is_external(F.col("entity_type"), F.col("source_id")) & ~X.is_noise(F.col("entity_name")))


def attach(edges: DataFrame, entities: DataFrame, end: str, **cols: Column) -> DataFrame:
    """``edges`` whose ``end`` is an entity, with columns of that entity. Hot endpoints are spread over all tasks."""
    dims = entities.select(F.col("entity_name").alias(end), *[c.alias(k) for k, c in cols.items()])
    counts = edges.groupBy(end).agg(F.count(F.lit(1)).alias("_edges"))
    return spread_join(edges, dims, end, counts, "_edges")


def resolvable(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose endpoints are entities."""
    return attach(attach(edges, entities, "src"), entities, "tgt")


def degrees(relations: DataFrame, entities: DataFrame, direction: str = "in", least: int = 5, prefix: str = "") -> DataFrame:
    """(entity, type, source_id, degree): entities with at least ``least`` resolvable edge rows at that end, in ``prefix``."""
    end = "tgt" if direction == "in" else "src"
    counts = resolvable(edges_of(relations), named(entities)).groupBy(end).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)
    info = named(entities).where(X.text(F.col("source_id")).startswith(prefix)).select(F.col("entity_name").alias(end), F.col("entity_type").alias("type"), "source_id")
    return counts.join(info, end).select(F.col(end).alias("entity"), "type", "source_id", "degree")


def endpoints(edges: DataFrame) -> DataFrame:
    """(name) distinct endpoints: both ends unioned, never one join on either."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("name")).distinct()


def orphans(relations: DataFrame, entities: DataFrame, exclude_types: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(entity, type, source_id, has_relations): entities without a resolvable edge; null types are never excluded."""
    edges = edges_of(relations)
    linked = endpoints(resolvable(edges, named(entities)))
    found = named(entities).where(X.text(F.col("source_id")).startswith(prefix))
    if exclude_types:
        found = found.where(F.col("entity_type").isNull() | ~F.col("entity_type").isin(exclude_types))
    found = found.select(F.col("entity_name").alias("name"), "entity_type", "source_id").join(linked, "name", "left_anti")
    touched = endpoints(edges).withColumn("_t", F.lit(True))
    return found.join(touched, "name", "left").select(F.col("name").alias("entity"), F.col("entity_type").alias("type"), "source_id", F.coalesce("_t", F.lit(False)).alias("has_relations"))


def module_edges(edges: DataFrame, entities: DataFrame, module: Column) -> DataFrame:
    """(src_module, tgt_module, kind, n): edges between entities by the modules of their ends.

    Edges are first counted by endpoint pair's module on one side, so only (module, other end, kind) rows meet the second join.
    """
    half = attach(edges, entities, "src", src_module=module).groupBy("src_module", "tgt", "kind").agg(F.count(F.lit(1)).alias("n"))
    dims = entities.select(F.col("entity_name").alias("tgt"), module.alias("tgt_module"))
    counts = half.groupBy("tgt").agg(F.count(F.lit(1)).alias("_rows"))
    return spread_join(half, dims, "tgt", counts, "_rows").groupBy("src_module", "tgt_module", "kind").agg(F.sum("n").alias("n"))


def graph_stats(relations: DataFrame, entities: DataFrame, prefix: str = "", depth: int = 2) -> DataFrame:
    """One row (entity_count, relation_count, cross_module, intra_module, density); with ``prefix`` of edges touching an entity in it."""
    ents = named(entities).where(X.text(F.col("source_id")).startswith(prefix))
    edges = edges_of(relations)
    module = X.store_module(F.col("source_id"), depth, prefix)
    pairs = module_edges(edges, ents, module).where("src_module <> '' AND tgt_module <> ''")
    cross = F.coalesce(F.sum(F.when(F.col("src_module") != F.col("tgt_module"), F.col("n"))), F.lit(0))
    intra = F.coalesce(F.sum(F.when(F.col("src_module") == F.col("tgt_module"), F.col("n"))), F.lit(0))
    if prefix:
        total = relations.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt")).join(ents.select(F.col("entity_name").alias("src"), F.lit(1).alias("_s")), "src", "left")
        total = total.join(ents.select(F.col("entity_name").alias("tgt"), F.lit(1).alias("_t")), "tgt", "left").where("_s IS NOT NULL OR _t IS NOT NULL")
    else:
        total = relations
    one = F.lit(1).alias("one")
    parts = [ents.agg(F.count(F.lit(1)).alias("entity_count")).withColumn("one", one), total.agg(F.count(F.lit(1)).alias("relation_count")).withColumn("one", one)]
    out = pairs.agg(cross.alias("cross_module"), intra.alias("intra_module")).withColumn("one", one)
    for p in parts:
        out = out.join(F.broadcast(p), "one")
    density = F.coalesce(F.col("cross_module") / F.nullif(F.col("cross_module") + F.col("intra_module"), F.lit(0)), F.lit(0.0))
    return out.select("entity_count", "relation_count", "cross_module", "intra_module", density.alias("density"))


def coupled_pairs(relations: DataFrame, entities: DataFrame, top: int = 5) -> DataFrame:
    """(from_module, to_module, n): the ``top`` pairs of modules with the most edges between them; ties by name."""
    ents = analysed(entities).where("source_id <> ''")
    pairs = module_edges(edges_of(relations), ents, X.module_of(F.col("source_id"), 2)).where("src_module <> tgt_module")
    return pairs.groupBy(F.col("src_module").alias("from_module"), F.col("tgt_module").alias("to_module")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "from_module", "to_module").limit(top)


def resolution(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One row (edges, resolvable, ratio) of edge rows and those whose ends are both entities; ratio null without edges."""
    marks = both_known(relations.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt")), named(entities))
    n, ok = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return marks.agg(n.alias("edges"), ok.alias("resolvable")).select("edges", "resolvable", F.round(F.col("resolvable") / F.nullif("edges", F.lit(0)), 4).alias("ratio"))


def resolution_caveat(ratio: Column) -> Column:
    """What to say of a graph under half of whose edges are resolved; null if they are or if the ratio is unknown."""
    return F.when(ratio < 0.5, F.concat(F.lit("edge resolution ratio "), F.format_string("%.1f%%", ratio * 100), F.lit(" is below 50%: orphans and the score may tell of unresolved edges, not of dead code")))


def both_known(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(known, n): how many pairs have both ends among the entities, counted by distinct pair first."""
    by_pair = pairs.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))
    names = entities.select(F.col("entity_name").alias("src"), F.lit(True).alias("_s")).distinct()
    return by_pair.join(names, "src", "left").join(names.select(F.col("src").alias("tgt"), F.col("_s").alias("_t")), "tgt", "left").select((F.coalesce("_s", F.lit(False)) & F.coalesce("_t", F.lit(False))).alias("known"), "n")


def placeholder_modules(entities: DataFrame, depth: int = 2) -> DataFrame:
    """(module, entities): modules all of whose entities' names end with '__init__'."""
    ents = analysed(entities).where("source_id <> ''")
    init = F.col("entity_name").endswith("__init__")
    return ents.groupBy(X.module_of(F.col("source_id"), depth).alias("module")).agg(F.bool_and(init).alias("only"), F.count(F.lit(1)).alias("entities")).where("only").select("module", "entities")


class Topology:
    """The findings of one graph: orphans, hubs, god functions, placeholder modules, coupling, resolution and a score.

    Edges count if both ends are analysed entities anywhere in the graph; findings are about the entities in scope:
    those whose source begins with ``scope``, else with ``module`` + '/'.
    """

    def __init__(self, relations: DataFrame, entities: DataFrame, hub: int = 8, god: int = 10, module: str = "", scope: str = ""):
        work = Scratch(relations.sparkSession)
        self.hub, self.god = hub, god
        self.relations = relations
        # the findings read these several times each, so they are worked out once
        self.all = work.cut(analysed(entities).select("entity_name", "entity_type", "source_id"))
        within = scope or (f"{module}/" if module else "")
        self.entities = self.all.where(X.text(F.col("source_id")).startswith(within)) if within else self.all
        self.edges = work.cut(edges_of(relations))
        self.resolvable = work.cut(resolvable(self.edges, self.all))
        self._work, self._pairs = work, None

    def _info(self) -> DataFrame:
        return self.entities.select(F.col("entity_name").alias("entity"), F.coalesce("entity_type", F.lit("unknown")).alias("type"), X.text(F.col("source_id")).alias("source_id"))

    def orphans(self) -> DataFrame:
        """(entity, type, source_id, reason). A class is linked if its constructor is."""
        linked = endpoints(self.resolvable)
        owners = linked.where(F.col("name").endswith(".__init__")).select(F.regexp_replace("name", r"\.__init__$", "").alias("name"))
        info = self._info().withColumn("name", F.col("entity")).where(~F.col("type").isin(X.CONTAINER_TYPES))
        left = info.join(linked, "name", "left_anti").join(owners.select("name", F.lit("class").alias("type")).distinct(), ["name", "type"], "left_anti")
        left = left.where(~X.may_be_unlinked(F.col("entity"), F.col("source_id")))
        touched = endpoints(self.edges).withColumn("_t", F.lit(True))
        reason = F.when(F.col("_t"), "neighbors_unresolved").otherwise("truly_isolated")
        return left.join(touched, "name", "left").select("entity", "type", "source_id", reason.alias("reason"))

    def _degree(self, end: str, least: int) -> DataFrame:
        counts = self.resolvable.groupBy(F.col(end).alias("entity")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)
        return counts.join(self._info(), "entity").where(~F.col("type").isin(X.CONTAINER_TYPES)).select("entity", "type", "source_id", "degree")

    def hubs(self) -> DataFrame:
        shared = F.col("entity").isin(X.SHARED_NAMES) | F.col("source_id").contains("_common.py") | F.col("source_id").contains("/config.py")
        return self._degree("tgt", self.hub).where(~shared)

    def gods(self) -> DataFrame:
        return self._degree("src", self.god)

    def ordered_hubs(self) -> DataFrame:
        """(entity, type, source_id, in_degree): the hubs by falling degree, then by name."""
        return self.hubs().withColumnRenamed("degree", "in_degree").orderBy(F.desc("in_degree"), "entity")

    def ordered_gods(self) -> DataFrame:
        """(entity, type, source_id, out_degree): the god functions by falling degree, then by name."""
        return self.gods().withColumnRenamed("degree", "out_degree").orderBy(F.desc("out_degree"), "entity")

    def samples(self, end: str, found: DataFrame, n: int = 5) -> DataFrame:
        """(entity, sample): up to ``n`` neighbours by name of each found entity, merged from bounded partial lists."""
        other = "src" if end == "tgt" else "tgt"
        near = self.resolvable.select(F.col(end).alias("entity"), F.col(other).alias("other")).join(found.select("entity"), "entity", "left_semi")
        from pyspark.sql import Window

        few = near.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy("other"))).where(F.col("_r") <= n)
        return few.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "other"))), lambda s: s["other"]), ", ").alias("sample"))

    def placeholders(self) -> DataFrame:
        return placeholder_modules(self.entities)

    def pairs(self) -> DataFrame:
        """(src_module, tgt_module, kind, n) of edges with both ends in scope."""
        if self._pairs is None:
            self._pairs = self._work.cut(module_edges(self.edges, self.entities, X.module_of(F.col("source_id"), 2)))
        return self._pairs

    def coupling(self) -> DataFrame:
        """One row (cross_module, intra_module, density)."""
        cross = F.coalesce(F.sum(F.when(F.col("src_module") != F.col("tgt_module"), F.col("n"))), F.lit(0))
        intra = F.coalesce(F.sum(F.when(F.col("src_module") == F.col("tgt_module"), F.col("n"))), F.lit(0))
        return self.pairs().agg(cross.alias("cross_module"), intra.alias("intra_module")).withColumn("density", F.coalesce(F.col("cross_module") / F.nullif(F.col("cross_module") + F.col("intra_module"), F.lit(0)), F.lit(0.0)))

    def most_coupled(self, top: int = 5) -> DataFrame:
        p = self.pairs().where("src_module <> tgt_module").groupBy(F.col("src_module").alias("from_module"), F.col("tgt_module").alias("to_module")).agg(F.sum("n").alias("n"))
        return p.orderBy(F.desc("n"), "from_module", "to_module").limit(top)

    def resolution(self) -> DataFrame:
        """One row (edges, resolvable, ratio, low, caveat): of all relation rows; ``low`` if under a half are resolvable."""
        r = resolution(self.relations, self.all)
        return r.withColumn("low", F.coalesce(F.col("ratio") < 0.5, F.lit(False))).withColumn("caveat", resolution_caveat(F.col("ratio")))

    def score(self) -> DataFrame:
        """One row: the counts behind the score and the score, 100 less capped penalties."""
        one = lambda df, *aggs: df.agg(*aggs).withColumn("one", F.lit(1))
        n = lambda name: F.count(F.lit(1)).alias(name)
        parts = [
            one(self.entities, n("entities")),
            one(self.orphans(), n("orphans")),
            one(self.hubs(), n("hubs"), F.count_if(F.col("degree") >= 15).alias("big_hubs")),
            one(self.gods(), n("gods"), F.count_if(F.col("degree") >= 25).alias("huge_gods"), F.count_if((F.col("degree") >= 15) & (F.col("degree") < 25)).alias("big_gods")),
            one(self.placeholders(), n("placeholders")),
        ]
        out = self.coupling().withColumn("one", F.lit(1))
        for p in parts:
            out = out.join(F.broadcast(p), "one")
        ratio = F.coalesce(F.col("orphans") / F.nullif("entities", F.lit(0)), F.lit(0.0))
        penalty = (
            F.when(ratio > 0.2, 25).when(ratio > 0.1, 15).otherwise(0)
            + F.least(F.col("big_hubs") * 5, F.lit(20))
            + F.least(F.col("huge_gods") * 5 + F.col("big_gods") * 3, F.lit(25))
            + F.least(F.col("placeholders") * 5, F.lit(15))
            + F.when(F.col("density") > 0.5, 10).when(F.col("density") > 0.3, 5).otherwise(0)
        )
        return out.select("entities", "orphans", "hubs", "gods", "placeholders", "cross_module", "intra_module", "density", F.greatest(F.lit(0), 100 - penalty).cast("int").alias("score"))


def common_prefix(entities: DataFrame) -> str:
    """The directories that all sources begin with, with a final '/', or ''. From the least and the greatest list of directories."""
    parts = F.split(X.without_lines(F.col("source_id")), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    row = entities.where("source_id <> ''").agg(F.min(dirs).alias("a"), F.max(dirs).alias("b")).first()
    if not row or not row.a or not row.b:
        return ""
    same = []
    for x, y in zip(row.a, row.b, strict=False):
        if x != y:
            break
        same.append(x)
    return "/".join(same) + "/" if same else ""


def store_topology(relations: DataFrame, entities: DataFrame, hub: int = 8, god: int = 10, module: str = "", scope: str = "", prefix: str | None = None, ratio: float | None = None) -> dict[str, DataFrame]:
    """Topology as the store computes it: degrees over all named entities, filters afterwards, coupling of the whole graph, no
    placeholders; ``ratio`` is the resolved ratio that the store has recorded."""
    base = common_prefix(named(entities)) if prefix is None else prefix
    within = scope or base + (f"{module}/" if module else "")
    keep = ~X.is_noise(F.col("entity")) & ~X.is_external(F.col("type"), F.col("source_id"))
    container = X.text(F.col("type")).isin(X.CONTAINER_TYPES)
    lost = orphans(relations, entities, X.CONTAINER_TYPES, within).where(keep & ~X.may_be_unlinked(F.col("entity"), F.col("source_id")))
    reason = F.when(F.col("has_relations"), "neighbors_unresolved").otherwise("truly_isolated")
    return {
        "orphans": lost.select("entity", "type", "source_id", reason.alias("reason")),
        "hubs": degrees(relations, entities, "in", hub, within).where(keep & ~container & ~F.col("entity").isin(X.SHARED_NAMES)),
        "gods": degrees(relations, entities, "out", god, within).where(keep & ~container),
        "resolution": relations.sparkSession.range(1).select(F.lit(ratio).cast("double").alias("ratio"), resolution_caveat(F.lit(ratio).cast("double")).alias("caveat")),
        "stats": graph_stats(relations, entities, base, 2),
        "most_coupled": coupled_pairs(relations, entities),
    }
