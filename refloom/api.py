"""The five verbs. Each returns a Result: a status, the rows, and what to print."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import grammar
from refloom.operators import extract, render, resolve, scan
from refloom.operators import verify as gate
from refloom.sources import index as store
from refloom.sources import tree
from refloom.sources.config import Config, load
from refloom.sources.globs import in_scope


class Status(IntEnum):
    OK = 0
    ADVERSE = 1
    USAGE = 2
    STALE = 3


@dataclass(frozen=True)
class Result:
    status: Status
    rows: DataFrame | None = None
    message: str = ""

    def text(self, lines: DataFrame) -> str:
        return "\n".join(r["out"] for r in lines.collect())


class Engine:
    """A tree and its index. ``index_path`` is a folder; rows are returned as frames, so large answers stay distributed."""

    def __init__(self, spark: SparkSession, root: str, index_path: str | None = None, config: Config | None = None):
        self.spark, self.root = spark, root
        self.index_path = index_path or f"{root}/.ref-cache/index"
        self.config = config or load(root)

    def files(self, content: bool = True) -> DataFrame:
        return tree.read_tree(self.spark, self.root, content=content)

    def scoped(self, paths: list[str] | None = None) -> DataFrame:
        """Named files, or the tree's in scope; only readable ones."""
        if paths:
            return tree.read_named(self.spark, self.root, paths)
        return self.files().where(in_scope(F.col("path"), self.config.in_scope, self.config.exclude) & F.col("content").isNotNull())

    def index(self) -> Result:
        files = self.files().persist()
        try:
            anchors, mentions = extract.anchors(files), scan.mention_table(files.where("content is not null"))
            # a build is as old as the newest file it has read
            built = files.agg(F.max(F.unix_seconds("modified_at"))).first()[0] or 0
            store.write(self.index_path, anchors, mentions, files.select("path"), store.git_tree(self.root), built)
            now = store.read(self.spark, self.index_path)
            n = [df.count() for df in (now.forward, now.mentions, now.paths)]
        finally:
            files.unpersist()
        return Result(Status.OK, None, f"indexed {n[0]} anchors and {n[1]} path mentions across {n[2]} files")

    def _fresh(self, skip: bool) -> store.Index | None:
        found = store.read(self.spark, self.index_path)
        if found is None:
            return None
        return found if store.is_fresh(found, self.files(content=False), skip, store.git_tree(self.root)) else None

    def read(self, ref: str, skip_freshness: bool = False) -> Result:
        asked = self.spark.createDataFrame([(ref,)], "token string").select(grammar.reference(F.col("token")).alias("ref"))
        if asked.first()["ref"] is None:
            return Result(Status.USAGE, None, f"malformed marker: {ref}")
        if (index := self._fresh(skip_freshness)) is None:
            return Result(Status.STALE, None, "the index is missing or stale")
        rows = resolve.resolve(asked, index.forward).where("anchor is not null")
        rows = rows.orderBy(grammar.location(F.col("file"), F.col("start_line"), F.col("end_line")))
        n = rows.limit(2).count()
        message = "" if n == 1 else f"no such anchor: {ref}" if n == 0 else f"ambiguous anchor: {ref}"
        return Result(Status.OK if n == 1 else Status.ADVERSE, rows, message)

    def at(self, position: str, all_levels: bool = False, skip_freshness: bool = False) -> Result:
        where = self.spark.createDataFrame([(position,)], "p string").select(grammar.parse_position(F.col("p")).alias("p")).select("p.*")
        first = where.first()
        if first["file"] is None or first["line"] is None:
            return Result(Status.USAGE, None, f"not a position: {position}")
        if (index := self._fresh(skip_freshness)) is None:
            return Result(Status.STALE, None, "the index is missing or stale")
        rows = resolve.locate(where, index.by_file.where(F.col("file") == first["file"]), all_levels, index.forward).orderBy("depth")
        n = rows.limit(2).count()
        bad = n == 0 or (n > 1 and not all_levels)
        return Result(Status.ADVERSE if bad else Status.OK, rows, f"no anchor covers {position}" if n == 0 else "ambiguous: anchors tie on the innermost span" if bad else "")

    def search(self, ref: str | None = None, mentions: bool = False, paths: list[str] | None = None) -> Result:
        """Markers (of one name, if given) or mentions; no index is read."""
        want = None
        if ref is not None:
            want = self.spark.createDataFrame([(ref,)], "t string").select(grammar.reference(F.col("t")).alias("r")).first()["r"]
            if want is None:
                return Result(Status.USAGE, None, f"malformed marker: {ref}")
        try:
            files = self.scoped(paths)
        except ValueError as e:
            return Result(Status.USAGE, None, str(e))
        found = scan.hits(files, self.config.scan).where(F.col("hit") == ("mention" if mentions else "marker"))
        found = found if want is None else found.where(resolve.search_filter(F.col("anchor"), want))
        rows = self._ordered(found, files)
        return Result(Status.ADVERSE if rows.isEmpty() else Status.OK, rows)

    def verify(self, paths: list[str] | None = None, skip_freshness: bool = False) -> Result:
        try:
            gate.check_rules(self.config.rules)
        except ValueError as e:
            return Result(Status.USAGE, None, str(e))
        if (index := self._fresh(skip_freshness)) is None:
            return Result(Status.STALE, None, "the index is missing or stale")
        try:
            files = self.scoped(paths)
        except ValueError as e:
            return Result(Status.USAGE, None, str(e))
        found = gate.findings(files, index.forward, tree.entries(self.spark, self.root), self.config.rules, self.config.scan)
        rows = self._ordered(found, files)
        return Result(Status.OK if rows.isEmpty() else Status.ADVERSE, rows)

    @staticmethod
    def _ordered(found: DataFrame, files: DataFrame) -> DataFrame:
        """In reading order; named files in the order they were named."""
        if "position" not in files.columns:
            return found.orderBy(*scan.ORDER)
        named = found.join(files.select(F.col("path").alias("file"), "position"), "file")
        return named.orderBy("position", *scan.ORDER[1:]).drop("position")

    def lines(self, result: Result, kind: str) -> str:
        """The text form: kind is read, at, search or verify."""
        if result.rows is None:
            return ""
        if kind == "at":
            return "\n".join(r["marker"] for r in result.rows.collect())
        form = {"read": render.location_lines, "search": render.hit_lines, "verify": render.finding_lines}[kind]
        shown = result.text(form(result.rows))
        if kind == "read":
            return shown
        what = "findings" if kind == "verify" else "mentions" if result.rows.where("hit = 'mention'").limit(1).count() else "markers"
        return "\n".join([*filter(None, [shown]), render.count_line(len(shown.splitlines()), what)])
