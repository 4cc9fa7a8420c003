"""One object per set of workspaces with the analyses as methods; each returns DataFrames."""

from __future__ import annotations

import json
import shutil
import tempfile
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators import debt, diffs, graph, history, impact, modules, search, traverse
from quarrygraph.operators.store import Workspace
from quarrygraph.session import Scratch, ship
from quarrygraph.sources import ndjson, reports, textlogs


class Quarry:
    """The workspaces under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self.spark, self.root = spark, root

    def workspace(self, name: str) -> Workspace:
        return Workspace(self.spark, self.root, name)

    def tables(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(entities, relations)."""
        w = self.workspace(name)
        return w.table("entities"), w.table("relations")

    def list(self) -> list[str]:
        return Workspace.names(self.spark, self.root)

    def info(self, name: str) -> DataFrame:
        return modules.type_counts(*self.tables(name))

    def drop(self, name: str, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("dropping a workspace needs confirm=True")
        self.workspace(name).drop()

    def import_ndjson(self, path: str, name: str | None = None, clear: bool = False, dry_run: bool = False) -> DataFrame:
        """Stores a file, by default in '<stem>:imported'; returns its summary. A file without entities is refused."""
        name = name or f"{path.rstrip('/').rsplit('/', 1)[-1].rsplit('.', 1)[0]}:imported"
        records = ndjson.read(self.spark, path)
        if not dry_run:
            if not ndjson.is_safe(records):
                raise ValueError("the file has no entities")
            self.workspace(name).ingest(ndjson.entities(records), ndjson.relations(records), clear=clear)
        return ndjson.summary(records)

    def embed_backfill(self, name: str, embed: search.Embedder, provider: str, dims: int = 768) -> int:
        """Embeds all descriptions of a workspace that has no vectors; else does nothing."""
        w = self.workspace(name)
        if not w.table("vectors").isEmpty():
            return 0
        return w.write_embeddings(search.embed_entities(w.table("entities"), embed), dims, embedding_provider=provider)

    def find(self, name: str, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return search.find(self.tables(name)[0], query, kind, limit)

    def find_with_relations(self, name: str, query: str, kind: str | None = None, limit: int = 20, depth: int = 1) -> DataFrame:
        return traverse.attach_relations(self.find(name, query, kind, limit), self.tables(name)[1], depth)

    def search(self, name: str, query: str, embed: search.Embedder, provider: str, kind: str | None = None, limit: int = 20, query_prefix: str = "") -> DataFrame:
        w = self.workspace(name)
        vectors = w.table("vectors")
        search.check_provider(w.get_meta("embedding_provider"), provider, vectors.limit(1).count())
        return search.search(vectors, w.table("entities"), embed([query_prefix + query])[0], kind, limit)

    def graph(self, name: str, entity: str, direction: str = "both", kind: str = "all", depth: int = 1, include_unresolved: bool = False) -> DataFrame:
        e, r = self.tables(name)
        return traverse.graph_query(r, e, entity, direction, kind, depth, include_unresolved)

    def deps(self, name: str, depth: int = 2) -> DataFrame:
        e, r = self.tables(name)
        return modules.dependencies(r, e, depth)

    def overview(self, name: str, depth: int = 2) -> dict[str, DataFrame]:
        e, r = self.tables(name)
        return {"counts": modules.overview_counts(e, depth), "files": modules.overview_files(e, depth), "top": modules.overview_top(r, e, depth), "dependencies": modules.dependencies(r, e, depth)}

    def topology(self, name: str, hub: int = 8, god: int = 10, module: str = "", scope: str = "", mode: str = "full") -> dict[str, DataFrame]:
        e, r = self.tables(name)
        if mode == "store":
            ratio = self.workspace(name).get_meta("resolved_ratio")
            return graph.store_topology(r, e, hub, god, module, scope, ratio=float(ratio) if ratio else None)
        t = graph.Topology(r, e, hub, god, module, scope)
        return {"orphans": t.orphans(), "hubs": t.ordered_hubs(), "gods": t.ordered_gods(), "placeholders": t.placeholders(), "coupling": t.coupling(), "most_coupled": t.most_coupled(), "resolution": t.resolution(), "score": t.score()}

    def impact(self, name: str, changed_files: DataFrame, symbols: DataFrame, depth: int = 2, full: bool = False) -> dict[str, DataFrame]:
        w = self.workspace(name)
        changed = impact.qualified(impact.changed_symbols(changed_files, symbols))
        found = impact.callers(w.table("relations"), changed, depth, full)
        ratio = w.get_meta("resolved_ratio")
        return {"symbols": changed, "callers": found, "modules": impact.affected_modules(changed, found), "tests": impact.affected_tests(found), "risk": impact.risk(changed, found, float(ratio) if ratio else None)}

    def check(self, name: str, files: DataFrame) -> dict[str, DataFrame]:
        fresh = modules.freshness(self.tables(name)[0], files)
        return {"summary": modules.freshness_summary(fresh), "stale": fresh.where("NOT fresh")}

    def git_metrics(self, commits: DataFrame) -> dict[str, DataFrame]:
        m = Scratch(self.spark).cut(history.file_metrics(commits))
        hot, silos = history.hotspots(m), history.bus_factor(m, commits)
        return {"files": m, "hotspots": hot, "bus_factor": silos, "summary": history.git_summary(m, hot, silos)}

    def trends(self, snapshots: DataFrame, entity: str | None = None, metric: str | None = None, months: int = 6, workspace: str | None = None) -> DataFrame:
        points = history.metric_points(snapshots if entity is None else snapshots.where(F.col("entity") == entity), months, workspace)
        return history.trends(points if metric is None else points.where(F.col("metric") == metric))

    def debt(self, name: str, report: DataFrame | None = None, commits: DataFrame | None = None, module: str = "", scope: str = "", skip_topology: bool = False) -> dict[str, DataFrame]:
        e, r = self.tables(name)
        t = graph.Topology(r, e, 8, 10, module, scope)
        score = self.spark.createDataFrame([(100,)], "score int") if skip_topology else t.score()
        parts = [] if skip_topology else [debt.topology_issues(t)]
        if report is not None:
            parts.append(debt.static_issues(report, scope or module))
        git = None
        if commits is not None:
            g = self.git_metrics(commits)
            parts.append(debt.git_issues(g["hotspots"], g["bus_factor"]))
            git = debt.git_score(g["hotspots"], g["bus_factor"])
        issues = debt.no_issues(self.spark)
        for p in parts:
            issues = issues.unionByName(p)
        if commits is not None:
            issues = debt.enriched(issues, g["files"])
        maintain = debt.maintainability(report, scope or module) if report is not None else None
        return {"issues": debt.numbered(issues), "counts": debt.issue_counts(issues), "health": debt.health(issues, score, maintain, git)}

    def compare(self, one: str, two: str) -> dict[str, DataFrame]:
        return diffs.compare(*self.tables(one), *self.tables(two))

    def branch_diff(self, base: str, head: str) -> diffs.BranchDiff:
        return diffs.BranchDiff(*self.tables(base), *self.tables(head))

    def provision(self, name: str, ref: str, sha: str, path: str) -> str:
        """Makes a workspace the snapshot of a ref from an interchange file: 'created', 'reused' or 'rebuilt'."""

        def load() -> tuple[DataFrame, DataFrame]:
            records = ndjson.read(self.spark, path)
            return ndjson.entities(records), ndjson.relations(records)

        return self.workspace(name).provision(ref, sha, load)

    # from files, for the command line

    def impact_of_diff(self, name: str, diff_path: str, depth: int = 2, full: bool = False) -> dict[str, DataFrame]:
        """Impact of a unified diff on a workspace; its symbols are the entities whose source has a range of lines."""
        place = r"^(.*):(\d+)-(\d+)$"
        part = lambda i: F.regexp_extract("source_id", place, i)
        e = self.tables(name)[0].where(F.col("source_id").rlike(place))
        symbols = e.select(part(1).alias("file"), F.col("entity_name").alias("name"), part(2).cast("int").alias("line_start"), part(3).cast("int").alias("line_end"))
        return self.impact(name, textlogs.changed_files(textlogs.lines(self.spark, diff_path)), symbols, depth, full)

    def check_files(self, name: str, listing_path: str) -> dict[str, DataFrame]:
        """Freshness against a Parquet table of files."""
        return self.check(name, self.spark.read.parquet(listing_path))

    def git_metrics_of_log(self, log_path: str) -> dict[str, DataFrame]:
        return self.git_metrics(textlogs.commits(textlogs.lines(self.spark, log_path)))

    def trends_of(self, snapshots_path: str, entity: str | None = None, metric: str | None = None, months: int = 6) -> DataFrame:
        return self.trends(history.dedupe_snapshots(reports.read_snapshots(self.spark, snapshots_path)), entity, metric, months)

    def branch_summary(self, base: str, head: str) -> dict[str, DataFrame]:
        d = self.branch_diff(base, head)
        return {"summary": d.summary(), "edges": d.edges(), "broken_chains": d.broken_chains(), "new_chains": d.new_chains(), "modules": d.top_modules()}

    def update(self, name: str, path: str, mode: str = "auto", listing_path: str | None = None, fingerprint: str | None = None) -> dict[str, object]:
        """Brings a workspace up to an interchange file; ``listing_path`` names the changed files, one per line."""
        records = ndjson.read(self.spark, path)
        changed = textlogs.listing(textlogs.lines(self.spark, listing_path)) if listing_path else None
        return self.workspace(name).refresh(mode, ndjson.entities(records), ndjson.relations(records), changed, fingerprint)

    def similar(self, entity: str, names: list[str] | None = None) -> DataFrame:
        return search.similar({n: self.tables(n) for n in names or self.list()}, entity)

    # several analyses at once; each part has its data or its error

    def _each(self, **parts) -> dict[str, dict[str, object]]:  # noqa: ANN003
        out: dict[str, dict[str, object]] = {}
        for k, f in parts.items():
            try:
                out[k] = {"data": f(), "error": None}
            except Exception as e:  # noqa: BLE001
                out[k] = {"data": None, "error": str(e)}
        return out

    def debt_audit(self, name: str, commits: DataFrame | None = None, snapshots: DataFrame | None = None, files: DataFrame | None = None, trends_top: int = 3) -> dict[str, dict[str, object]]:
        parts = {"debt": lambda: self.debt(name, commits=commits), "deps": lambda: self.deps(name), "overview": lambda: self.overview(name, 1), "topology": lambda: self.topology(name, 10, 10), "info": lambda: self.info(name)}
        if files is not None:
            parts["check"] = lambda: self.check(name, files)
        if commits is not None:
            parts["git"] = lambda: self.git_metrics(commits)
        if snapshots is not None:
            parts["trends"] = lambda: self.trends(snapshots).orderBy(F.desc(F.abs("slope")), "entity", "metric").limit(trends_top)
        return self._each(**parts)

    def evolution_track(self, entity: str, names: list[str]) -> dict[str, dict[str, object]]:
        if len(names) < 2:
            raise ValueError("needs two workspaces")
        parts = {"similar": lambda: self.similar(entity, names)}
        for a, b in zip(names, names[1:], strict=False):
            parts[f"compare {a} {b}"] = lambda a=a, b=b: self.compare(a, b)
        for n in names:
            parts[f"graph {n}"] = lambda n=n: self.graph(n, entity)
        return self._each(**parts)

    def sync_advice(self, upstream: str, downstream: str, entities: list[str] | None = None) -> dict[str, dict[str, object]]:
        parts = {"compare": lambda: self.compare(upstream, downstream), "upstream_debt": lambda: self.debt(upstream), "downstream_debt": lambda: self.debt(downstream)}
        for e in entities or []:
            parts[f"callers {e}"] = lambda e=e: self.graph(downstream, e, "callers")
        return self._each(**parts)


def chart(values: list[float], height: int = 8, mark: str = "*") -> str:
    """A plain text chart of a few values."""
    if not values:
        return ""
    lo, hi = min(values), max(values)
    rows = [round((v - lo) / (hi - lo) * (height - 1)) if hi > lo else 0 for v in values]
    return "\n".join("".join(mark if r == h else " " for r in rows).rstrip() for h in range(height - 1, -1, -1))


def markdown(df: DataFrame, limit: int = 50) -> str:
    """The first rows of a result as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    return "\n".join("| " + " | ".join(v.replace("|", "\\|") for v in r) + " |" for r in rows)


def envelope(f) -> dict[str, object]:  # noqa: ANN001
    """{'success': true, 'data': all rows} of a function that gives a DataFrame or a dict of them, else the error."""

    def rows(x: object) -> object:
        if isinstance(x, DataFrame):
            return [r.asDict(True) for r in x.toLocalIterator()]
        return {k: rows(v) for k, v in x.items()} if isinstance(x, dict) else x

    try:
        return {"success": True, "data": rows(f())}
    except Exception as e:  # noqa: BLE001
        return _failure(e)


def _failure(e: Exception) -> dict[str, object]:
    return {"success": False, "error": {"code": type(e).__name__, "message": str(e)}}


def print_envelope(f, out: TextIO) -> bool:  # noqa: ANN001
    """Writes the envelope of ``f`` as JSON with all rows, which go through a file, so the driver never holds a result; whether it succeeded."""
    text = lambda x: json.dumps(x, default=str, ensure_ascii=False)

    def put(x: object, to: TextIO) -> None:
        if isinstance(x, DataFrame):
            to.write("[")
            for i, r in enumerate(x.toLocalIterator()):
                to.write(", " * (i > 0) + text(r.asDict(True)))
            to.write("]")
        elif isinstance(x, dict):
            to.write("{")
            for i, (k, v) in enumerate(x.items()):
                to.write(", " * (i > 0) + text(str(k)) + ": ")
                put(v, to)
            to.write("}")
        else:
            to.write(text(x))

    with tempfile.TemporaryFile("w+", encoding="utf-8") as data:
        try:
            put(f(), data)
        except Exception as e:  # noqa: BLE001
            out.write(text(_failure(e)) + "\n")
            return False
        data.seek(0)
        out.write('{"success": true, "data": ')
        shutil.copyfileobj(data, out)
        out.write("}\n")
    return True
