"""Workspaces: versioned tables of one graph, replaced as a whole; upserts, deletes and incremental ingestion."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.functions import exprs as X
from quarrygraph.session import Scratch

TABLES = {"entities": schema.ENTITIES, "relations": schema.RELATIONS, "vectors": schema.VECTORS, "meta": schema.META}
# Fixed value: the tag of workspaces made as snapshots of a ref.
PROVISIONER = "branch-diff"
KEYS = {"entities": ["entity_name"], "relations": ["src_id", "tgt_id", "keywords"], "vectors": ["entity_name"], "meta": ["key"]}


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and of ``old`` whose key is not in ``new``. Keys must be unique in ``new``; columns are those of ``old``."""
    given = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    return old.join(given.select(*keys), list(keys), "left_anti").unionByName(given)


def delete_by_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose own source_id is not among ``sources`` (source_id)."""
    return df.join(sources.select("source_id").distinct(), "source_id", "left_anti").select(*df.columns)


def delete_names(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without ``names`` (entity_name), and relations that have none of them at either end (two anti joins)."""
    gone = names.select("entity_name").distinct()
    rels = relations.join(gone.withColumnRenamed("entity_name", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("entity_name", "tgt_id"), "tgt_id", "left_anti")
    return entities.join(gone, "entity_name", "left_anti").select(*entities.columns), rels.select(*relations.columns)


def by_source(entities: DataFrame, sources: DataFrame) -> DataFrame:
    return entities.join(sources.select("source_id").distinct(), "source_id", "left_semi").select(*entities.columns)


def source_ids(entities: DataFrame, prefix: str = "") -> DataFrame:
    """(source_id) distinct, with the prefix, in order."""
    return entities.where(F.col("source_id").isNotNull() & F.col("source_id").startswith(prefix)).select("source_id").distinct().orderBy("source_id")


def incremental_actions(old: DataFrame, new: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(entity_name, action) of the symbols (entity_name, source_id, content_hash) in ``changed_files`` (file): 'skip' if
    both hashes are known and equal, 'delete' if only the old state has the symbol, else 'upsert'. Symbols are matched by file and name."""
    side = lambda df, h: df.select(X.file_of(F.col("source_id")).alias("file"), "entity_name", F.col("content_hash").alias(h), F.lit(True).alias(f"has_{h}")).join(changed_files.select("file").distinct(), "file", "left_semi")
    both = side(old, "a").join(side(new, "b"), ["file", "entity_name"], "full")
    action = F.when(F.col("has_b").isNull(), "delete").when(F.col("a") == F.col("b"), "skip").otherwise("upsert")
    # a symbol that moved between changed files is upserted, not deleted
    rank = F.max(F.when(action == "delete", 0).when(action == "skip", 1).otherwise(2)).alias("r")
    return both.groupBy("entity_name").agg(rank).select("entity_name", F.element_at(F.array(F.lit("delete"), F.lit("skip"), F.lit("upsert")), F.col("r") + 1).alias("action"))


class Workspace:
    """One graph under ``root/name``. Every write makes a new version of its tables and then moves a pointer, so readers
    see either state whole. Old versions stay for ``keep_seconds``, for those who still read them. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, name: str, keep_seconds: int = 6 * 3600):
        self.spark, self.root, self.name, self.keep_seconds = spark, root.rstrip("/"), name, keep_seconds
        self.path = f"{self.root}/{name.replace('/', '-')}"

    # files

    def _fs(self):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, path: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> dict[str, str]:
        """The directory of each table's current version."""
        fs, p = self._fs(), self._p(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return {}
        s = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()
        return dict(line.split("=", 1) for line in text.splitlines() if line)

    def table(self, name: str) -> DataFrame:
        at = self.versions().get(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], TABLES[name])

    def replace(self, **tables: DataFrame) -> None:
        """Writes the given tables as new versions and makes all of them current at once."""
        now, made = self.versions(), f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            cols = [F.col(c).cast(f.dataType).alias(c) if c in df.columns else F.lit(None).cast(f.dataType).alias(c) for f in self.spark.createDataFrame([], TABLES[name]).schema.fields for c in [f.name]]
            df.select(*cols).write.parquet(f"{self.path}/{name}/{made}")
        fresh = now | {name: f"{name}/{made}" for name in tables}
        fs, tmp, to = self._fs(), self._p(f"{self.path}/.CURRENT-{made}"), self._p(f"{self.path}/CURRENT")
        out = fs.create(tmp, True)
        out.write(bytearray("\n".join(f"{k}={v}" for k, v in sorted(fresh.items())).encode()))
        out.close()
        opts = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, to, opts)
        self._expire(fs, tables)

    def _expire(self, fs, tables) -> None:  # noqa: ANN001
        """Removes versions that were superseded more than ``keep_seconds`` ago. A version is superseded when the next one is made."""
        oldest = int(time.time() * 1000) - self.keep_seconds * 1000
        for name in tables:
            p = self._p(f"{self.path}/{name}")
            made = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
            for old, after in zip(made, made[1:], strict=False):
                if int(after.split("-")[0]) <= oldest:
                    fs.delete(self._p(f"{self.path}/{name}/{old}"), True)

    @classmethod
    def names(cls, spark: SparkSession, root: str) -> list[str]:
        """The workspaces under ``root``, sorted."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def drop(self) -> None:
        self._fs().delete(self._p(self.path), True)

    @classmethod
    def first_filled(cls, spark: SparkSession, root: str, repo: str, branch: str) -> Workspace:
        """The workspace of a branch or, if it is empty, of main, develop or master."""
        for b in [branch, "main", "develop", "master"]:
            w = cls(spark, root, f"{repo}:{b}")
            if not w.table("entities").isEmpty():
                return w
        return cls(spark, root, f"{repo}:{branch}")

    # meta

    def set_meta(self, **values: str) -> None:
        new = self.spark.createDataFrame([(k, v) for k, v in values.items()], schema.META)
        self.replace(meta=upsert(self.table("meta"), new, ["key"]))

    def get_meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row.value if row else None

    # writes

    def write(self, entities: DataFrame | None = None, relations: DataFrame | None = None) -> None:
        """Upserts a batch in one step; rows without a name or endpoint are dropped, of equal keys the last row counts: that with the greatest ``seq``, then ``ord``, where there is one."""
        self.replace(**self._merged({}, entities, relations))

    def _merged(self, base: dict[str, DataFrame], entities: DataFrame | None = None, relations: DataFrame | None = None, vectors: DataFrame | None = None, **meta: str) -> dict[str, DataFrame]:
        """The tables after an upsert of the given rows into ``base``, or into the current tables where it has none."""
        out = dict(base)
        at = lambda t: out[t] if t in out else self.table(t)
        if entities is not None:
            out["entities"] = upsert(at("entities"), self._last(entities.where("entity_name <> ''"), "entities"), KEYS["entities"])
        if relations is not None:
            rows = relations.where("src_id <> '' AND tgt_id <> ''").withColumn("keywords", X.text(F.col("keywords")))
            out["relations"] = upsert(at("relations"), self._last(rows, "relations"), KEYS["relations"])
        if vectors is not None:
            out["vectors"] = upsert(at("vectors"), vectors, ["entity_name"])
        if meta:
            out["meta"] = upsert(at("meta"), self.spark.createDataFrame(list(meta.items()), schema.META), ["key"])
        return out

    def _staged(self, rows: DataFrame, dims: int) -> tuple[DataFrame, int]:
        """Usable vectors, one per name, written once, so that an embedder behind them meets every text once; and their number."""
        ok = rows.where((F.size("embedding") == dims) & F.col("entity_name").isNotNull())
        one = ok.groupBy("entity_name").agg(F.max(F.struct("embedding", "source_id")).alias("r")).select("entity_name", "r.source_id", "r.embedding")
        staged, told = Scratch(self.spark).told(one, n=F.count(F.lit(1)))
        return staged, told["n"]

    @staticmethod
    def _last(rows: DataFrame, name: str) -> DataFrame:
        keys = KEYS[name]
        # maps cannot be compared, so they are carried as sorted entries
        maps = [c for c in rows.columns if rows.schema[c].dataType.typeName() == "map"]
        rest = [c for c in rows.columns if c not in [*keys, *maps]]
        first = [c for c in ("seq", "ord") if c in rest]
        order = first + [c for c in rest if c not in first]
        if not order and not maps:
            return rows.dropDuplicates(keys)
        best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[F.array_sort(F.map_entries(c)).alias(c) for c in maps])).alias("_r"))
        return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in order], *[F.map_from_entries(f"_r.{c}").alias(c) for c in maps])

    def clear(self) -> None:
        """Empties the graph, not the metadata."""
        self.replace(**{t: self.spark.createDataFrame([], TABLES[t]) for t in ("entities", "relations", "vectors")})

    def delete_sources(self, sources: DataFrame) -> None:
        self.replace(**{t: delete_by_source(self.table(t), sources) for t in ("entities", "relations", "vectors")})

    def delete_entities(self, names: DataFrame) -> None:
        e, r = delete_names(self.table("entities"), self.table("relations"), names)
        v = self.table("vectors").join(names.select("entity_name").distinct(), "entity_name", "left_anti").select("entity_name", "source_id", "embedding")
        self.replace(entities=e, relations=r, vectors=v)

    def write_embeddings(self, rows: DataFrame, dims: int, **meta: str) -> int:
        """Replaces vectors by name; rows of another length or null are passed over. Returns how many were written."""
        self.check_dims(dims)
        staged, n = self._staged(rows, dims)
        self.replace(**self._merged({}, vectors=staged, **meta))
        return n

    def vector_count(self) -> int:
        return self.table("vectors").count()

    def check_dims(self, dims: int) -> None:
        row = self.table("vectors").where(F.size("embedding") != dims).first()
        if row:
            raise ValueError(f"vectors of {len(row.embedding)} numbers, not {dims}")

    def _vectors(self, entities: DataFrame, embed: Callable[[DataFrame], DataFrame] | None, dims: int, strict: bool) -> tuple[DataFrame | None, int]:
        """The vectors of ``entities``. Without an embedder none; an embedder that fails gives none and a warning, unless ``strict``
        or it is a mistake that every try would repeat (ValueError, TypeError)."""
        if embed is None:
            return None, 0
        self.check_dims(dims)
        try:
            return self._staged(embed(entities), dims)
        except (ValueError, TypeError):
            raise
        except Exception as e:
            if strict or any(k in str(e) for k in ("ValueError", "TypeError")):
                raise
            warnings.warn(f"embedding failed, no vectors are written: {str(e)[:200]}", stacklevel=3)
            return None, 0

    def ingest(self, entities: DataFrame, relations: DataFrame, *, clear: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None, dims: int = 768, strict: bool = False, **meta: str) -> dict[str, object]:
        """Writes a full export in one step; records the share of its edges whose ends are its entities, before duplicates are merged."""
        from quarrygraph.operators.graph import resolution

        base = {t: self.spark.createDataFrame([], TABLES[t]) for t in ("entities", "relations", "vectors")} if clear else {}
        vectors, embedded = self._vectors(entities, embed, dims, strict)
        told = resolution(relations, entities).first()
        ratio = "" if told.ratio is None else str(told.ratio)
        self.replace(**self._merged(base, entities, relations, vectors, resolved_ratio=ratio, **meta))
        return {"entities": entities.count(), "relations": told.edges, "resolved_ratio": told.ratio, "embedded": embedded}

    def ingest_changes(self, entities: DataFrame, relations: DataFrame, changed_files: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, dims: int = 768, strict: bool = False, **meta: str) -> dict[str, object]:
        """Symbol by symbol and in one step: unchanged symbols of changed files are skipped, vanished ones deleted with their
        relations and vectors, others upserted; the resolved ratio is that of the whole new export."""
        from quarrygraph.operators.graph import resolution

        actions, _ = Scratch(self.spark).told(incremental_actions(self.table("entities"), entities, changed_files), n=F.count(F.lit(1)))
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        gone = actions.where("action = 'delete'").select("entity_name")
        todo = entities.join(actions.where("action = 'upsert'").select("entity_name"), "entity_name", "left_semi")
        rels = relations.withColumn("_f", X.file_of(F.col("source_id"))).join(changed_files.select(F.col("file").alias("_f")).distinct(), "_f", "left_semi").drop("_f")
        base = {}
        if counts.get("delete"):
            base["entities"], base["relations"] = delete_names(self.table("entities"), self.table("relations"), gone)
            base["vectors"] = self.table("vectors").join(gone, "entity_name", "left_anti").select("entity_name", "source_id", "embedding")
        vectors, embedded = self._vectors(todo, embed, dims, strict)
        told = resolution(relations, entities).first()
        ratio = "" if told.ratio is None else str(told.ratio)
        self.replace(**self._merged(base, todo, rels, vectors, resolved_ratio=ratio, **meta))
        return {**{k: counts.get(k, 0) for k in ("skip", "upsert", "delete")}, "resolved_ratio": told.ratio, "embedded": embedded}

    def refresh(self, mode: str, entities: DataFrame, relations: DataFrame, changed_files: DataFrame | None = None, fingerprint: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, dims: int = 768, config: str | None = None) -> dict[str, object]:
        """'rebuild', 'append', 'incremental' or 'auto'; a known, equal fingerprint makes it a no-op. Another ``config`` than the
        one recorded makes 'auto' a rebuild."""
        same_config = config is None or self.get_meta("config") == config
        if fingerprint is not None and same_config and self.get_meta("fingerprint") == fingerprint:
            return {"mode": "noop"}
        if mode == "auto":
            mode = "rebuild" if not same_config or self.table("entities").isEmpty() else "incremental" if changed_files is not None else "append"
        meta = {k: v for k, v in (("fingerprint", fingerprint), ("config", config)) if v is not None}
        if mode == "incremental":
            if changed_files is None:
                raise ValueError("incremental needs changed_files")
            return {"mode": mode, **self.ingest_changes(entities, relations, changed_files, embed, dims, **meta)}
        return {"mode": mode, **self.ingest(entities, relations, clear=mode == "rebuild", embed=embed, dims=dims, **meta)}

    def provision(self, ref: str, sha: str, load: Callable[[], tuple[DataFrame, DataFrame]]) -> str:
        """Makes this the snapshot of a ref at commit ``sha``: 'created', 'reused' or 'rebuilt' from what ``load`` gives
        (entities, relations), tagged in the same step. A workspace that something else has filled is refused with an error."""
        meta = {r.key: r.value for r in self.table("meta").collect()}
        todo = provisioning(meta, self.table("entities").limit(1).count(), ref, sha)
        if todo == "refuse":
            raise ValueError(f"{self.name} holds data that no snapshot has put there")
        if todo != "reuse":
            self.ingest(*load(), clear=True, provisioned_by=PROVISIONER, provisioned_ref=ref, provisioned_sha=sha)
        return {"create": "created", "reuse": "reused", "rebuild": "rebuilt"}[todo]


def provisioning(meta: dict[str, str], entities: int, ref: str, sha: str) -> str:
    """What to do for a snapshot of a ref: 'create' an empty workspace, 'reuse' one of the same commit, 'rebuild' one it
    has made before; 'refuse' one that something else has filled."""
    if entities == 0:
        return "create"
    if meta.get("provisioned_by") != PROVISIONER:
        return "refuse"
    return "reuse" if meta.get("provisioned_sha") == sha and meta.get("provisioned_ref") in (ref, None) else "rebuild"
