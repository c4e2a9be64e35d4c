"""A file tree as a table: (path, ext, content, modified_at, length).

The listing follows ignore files and runs once, on the driver; contents are read
by the partitions, and only if the column is asked for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from refloom.sources.globs import regex

SCHEMA = "path string, ext string, content string, modified_at timestamp, length bigint"


class _Rule:
    """One line of an ignore file; ``base`` is the folder it stands in."""

    def __init__(self, line: str, base: str):
        self.keep = line.startswith("!")
        line = line[1:] if self.keep else line
        self.only_folders = line.endswith("/")
        self.base = base
        self.pattern = re.compile(regex(line) + r"\Z")

    def fits(self, path: str, is_dir: bool) -> bool:
        own = path[len(self.base) :] if path.startswith(self.base) else None
        return own is not None and (is_dir or not self.only_folders) and self.pattern.match(own) is not None


def _rules(file: str, base: str) -> list[_Rule]:
    try:
        with open(file, encoding="utf-8", errors="replace") as f:
            rows = [re.sub(r"(?<!\\)\s+$", "", x) for x in f]
    except OSError:
        return []
    return [_Rule(x, base) for x in rows if x and not x.startswith("#")]


def listing(root: str, hidden: bool = False, ignore: bool = True, follow: bool = False, require_git: bool = True, skip: str | None = None) -> Iterator[tuple[str, bool]]:
    """(path, is_dir) below root that ignore rules leave, paths relative and with /."""
    git = os.path.exists(os.path.join(root, ".git"))
    start = _rules(os.path.join(root, ".git", "info", "exclude"), "") if ignore and git else []

    def walk(folder: str, rules: list[_Rule]) -> Iterator[tuple[str, bool]]:
        if ignore:
            names = [".ignore", ".rgignore", *([".gitignore"] if git or not require_git else [])]
            rules = rules + [r for n in reversed(names) for r in _rules(os.path.join(root, folder, n), folder)]
        try:
            found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for entry in found:
            path = folder + entry.name
            is_dir = entry.is_dir(follow_symlinks=follow)
            if (not hidden and entry.name.startswith(".")) or path == ".git" or path == skip:
                continue
            last = next((r for r in reversed(rules) if r.fits(path, is_dir)), None)
            if last is not None and not last.keep:
                continue
            if is_dir:
                yield path, True
                yield from walk(path + "/", rules)
            elif entry.is_file(follow_symlinks=follow):
                yield path, False

    yield from walk("", start)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.root = options["root"] if "root" in options else options["path"]
        self.per_partition = int(options.get("filesperpartition", 256))
        self.listed = {"hidden": flag("hidden", False), "ignore": flag("ignore", True), "follow": flag("follow", False), "require_git": flag("requiregit", True), "skip": options.get("skip")}
        self.with_content = flag("content", True)

    def partitions(self):
        paths = [p for p, is_dir in listing(self.root, **self.listed) if not is_dir]
        return [_Files(paths[i : i + self.per_partition]) for i in range(0, len(paths), self.per_partition)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            try:
                stat = os.stat(os.path.join(self.root, path))
                content = None
                if self.with_content:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read().decode("utf-8")
            except UnicodeDecodeError:
                content = None
            except OSError:
                continue
            ext = os.path.splitext(os.path.basename(path))[1][1:] or None
            yield path, ext, content, datetime.fromtimestamp(stat.st_mtime, UTC), stat.st_size


class TreeSource(DataSource):
    """format("source_tree").load(root), with options hidden, ignore, follow, requireGit, skip, content, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(**{k: str(v) for k, v in options.items()}).option("root", root).load()


def read_named(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Named files in the order given, each once, whatever the scope; others than readable files inside root are errors."""
    top, rows = os.path.realpath(root), {}
    for given in paths:
        real = os.path.realpath(os.path.join(root, given.replace("\\", "/")))
        if not os.path.isfile(real):
            raise ValueError(f"not a file: {given}")
        if os.path.commonpath([top, real]) != top:
            raise ValueError(f"outside the tree: {given}")
        rel = os.path.relpath(real, top).replace(os.sep, "/")
        try:
            rows.setdefault(rel, (len(rows), rel, open(real, encoding="utf-8", newline="").read()))
        except UnicodeDecodeError as e:
            raise ValueError(f"not UTF-8: {given}") from e
    return spark.createDataFrame(list(rows.values()), "position int, path string, content string")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_dir) of all that exists, ignored and hidden things too."""
    return spark.createDataFrame(list(listing(root, hidden=True, ignore=False)), "path string, is_dir boolean")
