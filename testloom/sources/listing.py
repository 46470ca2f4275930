"""Files under globs as a table: folders are listed by the tasks, not by the driver.

A glob is an automaton over the parts of a path: a state is the number of parts that are
matched, and `**` stays where it is for any folder or is passed over. Going down a tree, a
folder in which no state is left isn't listed.
"""

from __future__ import annotations

import io
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders the driver looks into at most before it deals what is left to tasks.
FOLDERS = 64
SCHEMA = "set_pos int, path string, size long, modified timestamp"
_WILD = re.compile(r"[*?\[]")


def _part(text: str) -> re.Pattern | None:
    """The regex of one part; None for `**`."""
    if text == "**":
        return None
    out, i = "", 0
    while i < len(text):
        c, end = text[i], text.find("]", i + 2 + text.startswith("[!", i))
        if c == "[" and end > 0:
            inner = text[i + 1 : end]
            out += "[" + ("^" if inner[0] == "!" else "") + re.sub(r"([\\\[\]^&~|])", r"\\\1", inner[inner[0] == "!" :]) + "]"
            i = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return re.compile(out + r"\Z", re.DOTALL)


class PathAutomaton:
    """Which parts of a path match a glob's parts, part by part."""

    def __init__(self, parts: list[str]):
        self.parts = [_part(p) for p in parts]

    def closed(self, states: set[int]) -> frozenset[int]:
        """`**` also matches no folder at all."""
        out = set(states)
        for s in sorted(states):
            while s < len(self.parts) and self.parts[s] is None:
                s += 1
                out.add(s)
        return frozenset(out)

    def start(self) -> frozenset[int]:
        return self.closed({0})

    def step(self, states: frozenset[int], name: str) -> frozenset[int]:
        """States after one more part of the path."""
        found = set()
        for s in states:
            if s < len(self.parts):
                if self.parts[s] is None:
                    found.add(s)
                elif self.parts[s].match(name):
                    found.add(s + 1)
        return self.closed(found)

    def accepts(self, states: frozenset[int]) -> bool:
        """Whether a file may end here; `**` at the end stands for any file below."""
        return len(self.parts) in states and bool(self.parts)

    def matches(self, path: str) -> bool:
        states = self.start()
        for name in path.split("/"):
            states = self.step(states, name)
        return self.accepts(states)


def split_glob(glob: str) -> tuple[str, list[str]]:
    """The folder before the first wildcard, and the parts after it."""
    parts = glob.rstrip("/").split("/")
    at = next((i for i, p in enumerate(parts) if _WILD.search(p)), len(parts) - 1)
    return "/".join(parts[:at]) or "/", parts[at:]


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """(file system, path in it, what stands before a path in a URI)."""
    if "://" not in uri:
        path = re.sub("^file:/*", "/", uri)
        return pyarrow.fs.LocalFileSystem(), path, "file://"
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", uri), "file://"
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path, uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"


@dataclass
class Folders(InputPartition):
    """(number of the glob, folder, states, whether to go below it) for a task."""

    value: list[tuple[int, str, frozenset[int], bool]]


class ListingReader(DataSourceReader):
    def __init__(self, globs: list[str], tasks: int):
        self.globs, self.tasks = globs, tasks

    def _opened(self, i: int):
        root, parts = split_glob(self.globs[i])
        fs, path, prefix = file_system(root)
        return fs, path, prefix, PathAutomaton(parts)

    def _inside(self, fs, automaton: PathAutomaton, folder: str, states: frozenset[int]) -> Iterator[tuple[object, frozenset[int], bool]]:
        """(entry, states after its name, whether it is a folder) for what may match or hold a match."""
        if fs.get_file_info(folder).type != pyarrow.fs.FileType.Directory:
            return  # a glob may begin with the name of a file, or of nothing
        for entry in fs.get_file_info(pyarrow.fs.FileSelector(folder, recursive=False)):
            after = automaton.step(states, entry.base_name)
            if after:
                yield entry, after, entry.type == pyarrow.fs.FileType.Directory

    def partitions(self) -> list[Folders]:
        """One folder a piece of work, opened breadth first until there are enough; files met there are found again by the tasks."""
        todo = []
        for i in range(len(self.globs)):
            _, path, _, automaton = self._opened(i)
            todo.append((i, path, automaton.start(), True))
        opened = 0
        while opened < FOLDERS and len(todo) < self.tasks and any(deep for *_, deep in todo):
            at = next(k for k, x in enumerate(todo) if x[3])
            i, path, states, _ = todo.pop(at)
            fs, _, _, automaton = self._opened(i)
            below = [(i, e.path, after, True) for e, after, is_folder in self._inside(fs, automaton, path, states) if is_folder]
            todo.append((i, path, states, False))  # its own files alone
            todo += below
            opened += 1
        tasks = [Folders([]) for _ in range(max(1, min(self.tasks, len(todo))))]
        for k, x in enumerate(todo):
            tasks[k % len(tasks)].value.append(x)
        return tasks

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for i, path, states, deep in partition.value:
            fs, _, prefix, automaton = self._opened(i)
            todo = [(path, states)]
            while todo:
                folder, at = todo.pop()
                for entry, after, is_folder in self._inside(fs, automaton, folder, at):
                    if is_folder:
                        if deep:
                            todo.append((entry.path, after))
                    elif automaton.accepts(after):
                        rows.append((i, prefix + entry.path, entry.size, entry.mtime))
                if len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.timestamp("us", tz="UTC"))], ["set_pos", "path", "size", "modified"])


class FileListing(DataSource):
    """spark.read.format("file_listing").option("globs", json list).load()"""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(json.loads(self.options["globs"]), int(self.options.get("tasks", "32")))


def knows(uri: str) -> bool:
    """Whether tasks can list this store themselves."""
    try:
        file_system(split_glob(uri)[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def list_files(spark: SparkSession, globs: list[str]) -> DataFrame:
    """set_pos (number of the glob), path, size, modified of the files that match each glob.

    Parts of a glob: `*`, `?`, `[ab]`, `[!ab]` within a name, `**` for any number of folders
    or, at the end, anything below. A file that matches several globs has a row for each.
    Folders aren't files, what doesn't exist has no rows. For a store that only the JVM can
    open, Spark's own index lists the files instead; it holds their names in the driver.
    """
    own = [g for g in globs if knows(g)]
    if len(own) == len(globs):
        cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks needn't find this module
        spark.dataSource.register(FileListing)
        tasks = max(2, min(1024, 4 * spark.sparkContext.defaultParallelism))
        return spark.read.format("file_listing").option("globs", json.dumps(globs)).option("tasks", tasks).load()
    out = None
    for i, g in enumerate(globs):
        root, parts = split_glob(g)
        automaton = "^" + re.escape(root) + "/" + "/".join(p.pattern.removesuffix(r"\Z") if p else "@" for p in map(_part, parts)).replace("@/", "(?:[^/]+/)*").replace("@", ".*") + "$"
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).selectExpr(f"{i} as set_pos", "path", "length as size", "modificationTime as modified")
        rows = rows.where(rows.path.rlike(automaton))
        out = rows if out is None else out.union(rows)
    return out


def first_match(pattern: str):
    """For mapInArrow over (runner_dir, paths): runner_dir, job_id, bytes_read; the id is the first group that matches in the first line with a match of the first path with one, bytes read.

    Paths after that aren't opened, and a file is read up to its match.
    """

    def found(path: str) -> tuple[str | None, int]:
        fs, inner, _ = file_system(path)
        size = 0
        with fs.open_input_stream(inner) as stream:
            for line in io.BufferedReader(stream):
                size += len(line)
                if m := re.search(pattern, line.decode("utf-8", "replace")):
                    return next(g for g in m.groups() if g is not None).strip(), size
        return None, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = [], []
            for paths in batch.column(1).to_pylist():
                value, total = None, 0
                for path in paths:
                    value, size = found(path)
                    total += size
                    if value is not None:
                        break
                values.append(value)
                sizes.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), pa.array(sizes, pa.int64())], ["runner_dir", "job_id", "bytes_read"])

    return run
