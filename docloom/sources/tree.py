"""Document trees as a data source: files of any name, listed with pruning, and written one by one.

``document_tree`` lists a tree in tasks.  The driver opens directories from the top until
there are enough of them to share out; each task walks the subtrees it was given.  Ignore lists are read on the way
down, and a directory that one of them excludes is never opened.  Only entries are listed; ``read_contents``
spreads them anew and reads the files, so one crowded directory is read by many tasks.

As a sink, each document becomes one file at its own path.  A task writes to a temporary name
and moves the finished file into place, so a task that is run again, or twice at a time, leaves each file once; the commit
removes what is left of temporary files and writes ``_SUCCESS``, which a job that failed lacks.

Files are reached through Arrow's file systems (local, HDFS, S3, GCS): from executors, by URI.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC
from fnmatch import fnmatchcase
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.text import base_name, parent_dir

ENTRIES = "path string, size long, modified timestamp"
TEMPORARY = ".part-"


def located(root: str) -> tuple[afs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    return afs.FileSystem.from_uri(root if re.match(r"[a-z][a-z0-9+.-]+:", root) else str(Path(root).absolute()))


def joined(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts if p)


# --- ignore lists in tasks -----------------------------------------------------------------


def rule_regex(pattern: str) -> str:
    """A rule without its negation and closing slash, for paths relative to its list."""
    parts, out = pattern.lstrip("/").split("/"), ""
    for i, part in enumerate(parts):
        if part == "**":
            out += ".*" if i == len(parts) - 1 else "(?:.+/)?"
            continue
        for token in re.findall(r"\\.|\[!?\]?[^\]]*\]|\*+|\?|[^\\*?\[]+|.", part):
            if token.startswith("*"):
                out += "[^/]+" if part.strip("*") == "" else "[^/]*"
            elif token == "?":
                out += "[^/]"
            elif token.startswith("[") and len(token) > 2:
                out += re.sub(r"\\", r"\\\\", re.sub(r"^\[!", "[^", token))
            else:
                out += re.escape(re.sub(r"^\\(.)$", r"\1", token))
        out += "/" if i < len(parts) - 1 else ""
    return out if "/" in pattern else "(?:.+/)?" + out


@dataclass(frozen=True)
class RuleList:
    """The rules of one directory; the last one that fits decides."""

    base: str
    rules: tuple[tuple[bool, str], ...]

    @classmethod
    def of(cls, base: str, text: str) -> RuleList:
        rules = []
        for line in re.sub(r"\r\n?", "\n", text).split("\n"):
            line = re.sub(r"(?<!\\) +$", "", line)
            if line and not line.startswith("#"):
                negated, line = line.startswith("!"), re.sub(r"^\\([#!])", r"\1", line.removeprefix("!"))
                if bare := line.removesuffix("/"):
                    rules.append((negated, rule_regex(bare) + ("/.*" if line.endswith("/") else "(?:/.*)?")))
        return cls(base, tuple(rules))

    def excludes(self, path: str) -> bool:
        """``path`` is relative to the root, and ends with a slash for a directory; those above it are not excluded."""
        rel = path[len(self.base) + 1 :] if self.base else path
        steps = rel.rstrip("/").split("/")
        for negated, regex in reversed(self.rules):
            if any(re.fullmatch(regex, "/".join(steps[:n]) + "/") for n in range(1, len(steps))) or re.fullmatch(regex, rel):
                return not negated
        return False


# --- listing -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Walk:
    """What is wanted of a tree."""

    root: str
    glob: str = "*"
    ignore_file: str = ""
    hidden: bool = False

    def opened(self, files: afs.FileSystem, top: str, directory: str, lists: tuple[RuleList, ...]) -> tuple[list[tuple], list[tuple[str, tuple[RuleList, ...]]]]:
        """The files of a directory that are wanted, and the directories to open, each with the rule lists above it."""
        infos = sorted(files.get_file_info(afs.FileSelector(joined(top, directory) or "/")), key=lambda i: i.base_name)
        if self.ignore_file and any(i.base_name == self.ignore_file and i.is_file for i in infos):
            with files.open_input_stream(joined(top, directory, self.ignore_file)) as stream:
                lists = (*lists, RuleList.of(directory, stream.read().decode()))
        found, below = [], []
        for info in infos:
            path = joined(directory, info.base_name)
            if info.base_name.startswith(".") and not self.hidden and info.base_name != self.glob:
                continue
            if info.type == afs.FileType.Directory:
                if not any(x.excludes(path + "/") for x in lists):
                    below.append((path, lists))
            elif fnmatchcase(info.base_name, self.glob) and not any(x.excludes(path) for x in lists):
                found.append((path, info.size, info.mtime.astimezone(UTC) if info.mtime else None))
        return found, below


@dataclass
class Subtrees(InputPartition):
    files: list
    directories: list


class TreeReader(DataSourceReader):
    def __init__(self, walk: Walk, tasks: int):
        self.walk, self.tasks = walk, tasks

    def partitions(self) -> list[InputPartition]:
        files, top = located(self.walk.root)
        found, todo = [], deque([("", ())])
        for _ in range(4 * self.tasks):
            if not todo or len(todo) >= self.tasks:
                break
            some, below = self.walk.opened(files, top, *todo.popleft())
            found += some
            todo.extend(below)
        parts = [Subtrees([], list(todo)[i :: self.tasks]) for i in range(min(self.tasks, len(todo)))]
        return parts + [Subtrees(found[i : i + 10_000], []) for i in range(0, len(found), 10_000)] or [Subtrees([], [])]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        yield from partition.files
        files, top = located(self.walk.root)
        todo = list(reversed(partition.directories))
        while todo:
            found, below = self.walk.opened(files, top, *todo.pop())
            yield from found
            todo += reversed(below)


# --- writing -------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    count: int


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = located(self.root)
        made, count, mark = set(), 0, f"{TEMPORARY}{self.job}-"
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path is None or path.startswith("/") or any(step in ("", ".", "..") for step in path.split("/")):
                    raise ValueError(f"not a path inside the tree: {path!r}")
                directory, _, name = path.rpartition("/")
                if directory not in made:
                    files.create_dir(joined(top, directory), recursive=True)
                    made.add(directory)
                part = joined(top, directory, f"{mark}{uuid.uuid4().hex}")
                with files.open_output_stream(part) as stream:
                    stream.write((content or "").encode())
                files.move(part, joined(top, directory, name))
                count += 1
        return Written(count)

    def _cleared(self) -> tuple[afs.FileSystem, str]:
        files, top = located(self.root)
        files.create_dir(top, recursive=True)
        for info in files.get_file_info(afs.FileSelector(top, recursive=True)):
            if info.base_name.startswith(f"{TEMPORARY}{self.job}-"):
                files.delete_file(info.path)
        return files, top

    def commit(self, messages: list[Written | None]) -> None:
        files, top = self._cleared()
        with files.open_output_stream(joined(top, "_SUCCESS")) as stream:
            stream.write(f"{sum(m.count for m in messages if m)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()


class TreeSource(DataSource):
    """``spark.read.format("document_tree")`` with options ``glob``, ``ignoreFile``, ``hidden`` and ``tasks``; as a sink for ``path, content``."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> TreeReader:
        o = self.options
        return TreeReader(Walk(o["path"], o.get("glob", "*"), o.get("ignoreFile", ""), o.get("hidden", "false").lower() == "true"), int(o.get("tasks", 64)))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def list_tree(spark: SparkSession, root: str, glob: str = "*", ignore_file: str = "", hidden: bool = False, tasks: int | None = None) -> DataFrame:
    """``(path, size, modified)`` of the files below ``root``; paths are relative to it.

    Names that start with a dot are passed over unless ``hidden``; ``ignore_file`` names the rule lists to obey.
    """
    spark.dataSource.register(TreeSource)
    source = spark.read.format("document_tree").option("glob", glob).option("ignoreFile", ignore_file).option("hidden", str(hidden).lower())
    return source.option("tasks", str(tasks or max(64, spark.sparkContext.defaultParallelism))).load(root)


def read_contents(entries: DataFrame, root: str) -> DataFrame:
    """``(path, content)`` of listed files, read by tasks that each got a like number of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = located(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(joined(top, path)) as stream:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "content": pa.array([stream.read()], pa.binary())})

    return entries.select("path").repartition("path").mapInArrow(read, "path string, content binary")


def write_documents(documents: DataFrame, out: str) -> None:
    """Write ``(path, content)`` as one file per document; files of other paths stay, a path that occurs twice is an error."""
    twice = documents.groupBy("path").count().where("count > 1").orderBy("path").take(1)
    if twice:
        raise ValueError(f"several documents at {twice[0]['path']!r}")
    documents.sparkSession.dataSource.register(TreeSource)
    documents.select("path", F.col("content").cast("string").alias("content")).write.format("document_tree").mode("append").save(out)


def with_location(documents: DataFrame) -> DataFrame:
    rest = [c for c in documents.columns if c != "path"]
    return documents.select("path", parent_dir(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"), *rest)
