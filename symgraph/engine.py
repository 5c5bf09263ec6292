"""The tools of the engine as methods that return lazy DataFrames.

>>> engine = Engine.of_directory(spark, "/data/sf1")
>>> engine.callers("Order.save").show()
>>> engine.winnow([("kind", "eq", "model"), ("tested", "eq", "false")], rank="risk").show()

Roles are plain DataFrames (see :mod:`symgraph.sources.graph` for their columns), so an engine
also runs on tables of a lake or on what :mod:`symgraph.extraction` made of a checkout. Plug-ins
(:meth:`Engine.plug`) rewrite roles before a tool runs. A symbol argument is a name, an
``Owner.member`` or a qualified name; it may mean several nodes, which are answered together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import domain as D
from .functions import predicates as P
from .functions.arguments import decode_cursor, encode_cursor, parse_date
from .operators import flows as FL
from .operators import graph as GR
from .operators import reads as R
from .operators import resolution as RES
from .operators import risk as RK
from .operators import search as SE
from .operators import temporal as T
from .operators.winnow import cascade, winnow
from .sources import graph as G


@dataclass(frozen=True)
class Profile:
    """Conventions of a code base on top of the framework's own."""

    hooks: tuple[str, ...] = ()
    companions: tuple[str, ...] = ()

    @property
    def hook_names(self) -> tuple[str, ...]:
        return (*D.HOOK_NAMES, *self.hooks)


@dataclass
class Engine:
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame
    candidates: DataFrame | None = None
    files: DataFrame | None = None
    content: DataFrame | None = None
    projects: DataFrame | None = None
    commits: DataFrame | None = None
    commit_files: DataFrame | None = None
    changes: DataFrame | None = None
    profile: Profile = field(default_factory=Profile)
    generation: int = 0
    _flows: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def of_directory(cls, spark: SparkSession, d: str, profile: Profile | None = None) -> "Engine":
        return cls(
            G.nodes(spark, d), G.edges(spark, d), G.refs(spark, d), G.ref_candidates(spark, d), G.files(spark, d), G.content(spark, d), G.projects(spark, d),
            G.commits(spark, d), G.commit_files(spark, d), T.symbol_changes(G.revisions(spark, d)), profile or Profile(),
        )

    def plug(self, fn: Callable[["Engine"], "Engine"]) -> "Engine":
        """A framework's rewrite of the roles."""
        return fn(self)

    # -- lookups
    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def seeds(self, symbol: str) -> DataFrame:
        asked = self.spark.createDataFrame([(symbol,)], "symbol string")
        return R.seeds(asked, self.nodes).select("id")

    def _seeded(self, symbol: str) -> DataFrame:
        return self.seeds(symbol).select(F.lit(symbol).alias("seed"), F.col("id").alias("node"))

    def node(self, symbol: str) -> DataFrame:
        found = self.nodes.join(self.seeds(symbol), "id", "left_semi")
        role = P.symbol_role("kind", "name", "file_path")
        return found.select("*", role.alias("role"), P.python_import_line("language", "kind", "file_path", "qualified_name").alias("import_line")).orderBy(*P.listing_order())

    def at(self, file: str, line: int, limit: int = 5) -> DataFrame:
        hit = self.nodes.where(F.col("file_path").ilike("%" + file) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
        return hit.orderBy(F.col("end_line") - F.col("start_line"), "id").limit(limit)

    def page(self, listing: DataFrame, cursor: str | None = None, limit: int = 50) -> tuple[DataFrame, str, str | None]:
        """A page of an ordered listing, the next cursor and a note if the cursor was stale."""
        offset, note = decode_cursor(cursor, self.generation)
        return listing.offset(offset).limit(limit), encode_cursor(offset + limit, self.generation), note

    # -- relations
    def callers(self, symbol: str, limit: int = 200) -> DataFrame:
        mine = self.edges.join(self.seeds(symbol).withColumnRenamed("id", "target"), "target", "left_semi")
        return R.ranked(R.related(mine, self.nodes, "source"), limit).orderBy("symbol", "position")

    def callees(self, symbol: str, limit: int = 200) -> DataFrame:
        mine = self.edges.join(self.seeds(symbol).withColumnRenamed("id", "source"), "source", "left_semi")
        return R.ranked(R.related(mine, self.nodes, "target"), limit).orderBy("symbol", "position")

    def dark_callers(self, name: str) -> DataFrame:
        return self.refs.where((F.col("reference_name") == name) & (F.col("reference_kind") == "calls"))

    def impact(self, symbol: str, depth: int = 2) -> DataFrame:
        return GR.impact(self._seeded(symbol), self.edges, self.nodes, min(depth, 8)).join(self.nodes.select(F.col("id").alias("node"), "name", "file_path"), "node").orderBy("level", P.edge_rank("kind"), "node")

    def tests(self, symbol: str) -> DataFrame:
        """Covering references of the symbol, or of its owner if it has none."""
        ids = self.seeds(symbol)
        src = self.nodes.select(F.col("id").alias("source"), "name", "file_path")
        cover = self.edges.join(src, "source").where(P.is_covering("kind", "file_path"))
        own = cover.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        if not own.isEmpty():
            return own
        up = GR.owners(self.nodes).join(ids.withColumnRenamed("id", "member"), "member", "left_semi").select(F.col("owner").alias("target"))
        return cover.join(up, "target", "left_semi")

    def subclasses(self, symbol: str) -> DataFrame:
        below = GR.reach(self._seeded(symbol), GR.links(self.edges, ("extends",), reverse=True), 16)
        return below.where(F.col("depth") > 0).select("node", "depth").orderBy("depth", "node")

    def orphans(self, limit: int = 200) -> DataFrame:
        found = R.orphans(self.nodes, self.edges, self.refs).where(~F.col("name").isin(*self.profile.hook_names))
        return found.orderBy("file_path", "start_line", "id").limit(limit)

    def model(self, symbol: str) -> DataFrame:
        return GR.model_fields(self.edges, self.nodes, self.seeds(symbol)).orderBy("model", "depth", "base", "field")

    def model_relations(self, symbol: str) -> DataFrame:
        """``(model, direction, other, name)``: relations of a model, each once, with direction."""
        return R.model_relations(self.seeds(symbol), self.edges, self.nodes).orderBy("model", "direction", "other")

    def feature(self, symbol: str) -> DataFrame:
        return GR.feature(self._seeded(symbol), self.edges, self.nodes).orderBy("level", "node")

    def path(self, source: str, target: str) -> DataFrame:
        """The shortest path, forward or else backward."""
        both = self.seeds(source).withColumn("name", F.lit("from")).unionByName(self.seeds(target).withColumn("name", F.lit("to")))
        ways = GR.connect(both, self.edges, 2)
        best = ways.orderBy(F.col("from_name") != "from", "hops", "path").limit(1)
        ends = F.col("path")[0].alias("source"), F.element_at("path", -1).alias("target")
        return best.select(*ends, "hops", "path")

    # -- flows, risk, filters
    @property
    def flow_tables(self) -> tuple[DataFrame, DataFrame]:
        if self._flows is None:
            self._flows = FL.compute(self.nodes, self.edges, self.refs)
        return self._flows

    def flows(self, text: str | None = None, sort: str = "criticality", limit: int = 50) -> DataFrame:
        return FL.listing(self.flow_tables[0], text, sort, limit)

    def affected_flows(self, hunks: DataFrame) -> DataFrame:
        touched = R.touched(hunks, self.nodes).select(F.col("node_id").alias("node"))
        return FL.touching(*self.flow_tables, touched).orderBy(F.desc("criticality"), "name", "flow")

    def changed(self, hunks: DataFrame, now: int | None = None) -> DataFrame:
        """Changed symbols by review risk, with churn if there is history."""
        churn = None
        if now is not None and self.commits is not None:
            churn = T.churn(self.commits, self.commit_files, now - D.CHURN_DAYS * 86_400)
        return RK.changed(R.touched(hunks, self.nodes), self.nodes, self.edges, FL.participation(*self.flow_tables), churn)

    def winnow(self, criteria: list[tuple], rank: str = "callers", limit: int = 50, now: int | None = None) -> DataFrame:
        axes = {c[0] for c in criteria}
        flows = members = churn = None
        if axes & {"in_flow", "risk"} or rank in ("risk", "criticality"):
            flows, members = self.flow_tables
        if (axes & {"churn", "risk"} or rank in ("churn", "risk")) and now is not None and self.commits is not None:
            churn = T.churn(self.commits, self.commit_files, now - D.CHURN_DAYS * 86_400)
        return winnow(self.nodes, self.edges, criteria, rank, limit, flows, members, churn, self.changes)

    def winnow_cascade(self, criteria: list[tuple]) -> DataFrame:
        return cascade(self.nodes, self.edges, criteria)

    # -- overviews
    def overview(self) -> DataFrame:
        return self.nodes.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("symbols")).orderBy("project_id", F.desc("symbols"), "kind")

    def files_rollup(self, depth: int = 2) -> DataFrame:
        n = self.nodes.where(F.col("file_path").isNotNull())
        return n.groupBy("project_id", P.directory_at("file_path", depth).alias("directory")).agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file_path").alias("files")).orderBy("project_id", F.desc("symbols"), "directory")

    def status(self) -> DataFrame:
        parts = {"nodes": self.nodes, "edges": self.edges, "refs": self.refs}
        rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, df in parts.items()]
        return rows[0].union(rows[1]).union(rows[2])

    def routes(self) -> DataFrame:
        """Route, its view, that view's template, the URL pattern, a handler that is still pending and
        how often the route is reversed; mounts are left out."""
        r = self.nodes.where(F.col("kind") == "route").select("id", "kind", "name", "signature", "file_path")
        rows = R.routes(r, self.edges, self.refs)
        return rows.where(F.col("view").isNotNull() | ~F.col("name").contains("/")).orderBy("file_path", "name", "route")

    def links(self, limit: int = 200) -> DataFrame:
        rows = R.link_page(self.edges, self.nodes, limit).withColumns({"from_project": P.project_of("source"), "to_project": P.project_of("target")})
        totals = R.link_pairs(self.edges)
        return rows.join(totals, ["from_project", "to_project"], "left").orderBy(F.desc("links"), F.desc("edge_id"))

    # -- history
    def history(self, path: str, limit: int = 50) -> DataFrame:
        return T.by_commit(self.commits, self.commit_files, f"%{path}%").orderBy(F.desc("committed_at"), "commit_hash").limit(limit)

    def symbol_history(self, symbol: str, limit: int = 50) -> DataFrame:
        return T.symbol_history(self.changes, symbol).limit(limit)

    def as_of(self, when: str) -> DataFrame:
        """Symbols alive at a date, or at the commit whose hash begins with ``when``."""
        try:
            at = parse_date(when)
        except ValueError:
            row = self.changes.where(F.startswith("commit_hash", F.lit(when))).agg(F.max("committed_at")).first()
            if row is None or row[0] is None:
                raise ValueError(f"neither a date nor a commit: {when!r}") from None
            at = row[0]
        return T.as_of(self.changes, at).orderBy("project_id", "file_path", "qualified_name")

    # -- search and resolution
    def search(self, query: str, limit: int = 20) -> DataFrame:
        return SE.search_text(self.nodes, query, limit)

    def explore(self, query: str, files: int = 10) -> DataFrame:
        return SE.explore(self.nodes, self.edges, self.content, query, files)

    def enrich(self, pattern: str, limit: int = 4) -> DataFrame:
        """For a search: the best definitions with how many call, test and run through them."""
        found = self.search(pattern, 50).where(P.is_definition("kind")).limit(limit).select("id", "kind", "name", "file_path", "start_line")
        mine = self.edges.where(F.col("kind") != "contains").join(found.select(F.col("id").alias("target")), "target", "left_semi")
        about = R.related(mine, self.nodes, "source").groupBy(F.col("symbol").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.count(F.when(P.is_covering("kind", "file_path"), 1)).alias("tests"))
        runs = self.flow_tables[1].groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("flows"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return found.join(about, "id", "left").join(runs, "id", "left").select("id", "kind", "name", "file_path", "start_line", zero("callers"), zero("tests"), zero("flows"))

    def resolve(self) -> DataFrame:
        mappings = RES.import_mappings(self.content) if self.content is not None else None
        return RES.resolve(self.refs, self.candidates, self.nodes, mappings)


#: The tools by name, for the command line.
TOOLS = (
    "node", "at", "callers", "callees", "dark_callers", "impact", "tests", "subclasses", "orphans", "model", "model_relations", "feature", "path", "flows", "affected_flows", "changed",
    "winnow", "winnow_cascade", "overview", "files_rollup", "status", "routes", "links", "history", "symbol_history", "as_of", "search", "explore", "enrich", "resolve",
)
