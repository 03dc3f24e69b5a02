"""Epochs of an index: a log of commits on any file system that Hadoop knows, each naming the Parquet folders of its tables.

root/log/NNNNNN.json is the commit of an epoch: its tables, each a list of folders, and its values. root/data/ holds the folders, which never
change once written; epochs share those of unchanged tables by naming them. A commit is made only where none of its number is there yet, so of
two writers that started from one epoch the first wins and the other ends with Conflict.
"""

from __future__ import annotations

import contextlib
import functools
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

KEEP = 3


class Conflict(RuntimeError):
    """Another writer has made this epoch's number."""


class Files:
    """Small files and folders of a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.jvm = spark._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(str(root))
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def _put(self, path, text: str) -> None:
        out = self.fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, whole as soon as it is seen; False if it is there.

        A local file gets its name by a link and one of HDFS by a rename: neither replaces a file. Elsewhere, as on object stores, a file is seen
        when it is closed, and is put only if absent.
        """
        target, scheme = self.at(name), self.fs.getUri().getScheme()
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target):
            return False
        if scheme not in ("file", "hdfs"):
            try:
                self._put(target, text)
            except Exception as e:
                if self.fs.exists(target) and "Exists" in str(e):
                    return False
                raise
            return True
        new = self.at(f"{name}.{uuid.uuid4().hex}")
        self._put(new, text)
        try:
            if scheme == "hdfs":
                return self.fs.rename(new, target)
            local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(local(target), local(new))
            return True
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self.fs.delete(new, False)


class Epoch:
    """One epoch's tables. What is written is seen by this epoch only until it is committed; a reader keeps the epoch it has opened."""

    def __init__(self, spark: SparkSession, root: str | Path, number: int = 0, commit: dict | None = None):
        self.spark, self.files, self.number = spark, Files(spark, root), number
        commit = commit or {}
        self.tables: dict[str, list[str]] = {k: list(v) for k, v in commit.get("tables", {}).items()}
        self.values: dict = dict(commit.get("meta", {}))
        self.written: list[str] = []

    @property
    def path(self) -> str:
        return f"{self.files.root}/log/{self.number:06d}.json"

    def __contains__(self, table: str) -> bool:
        return table in self.tables or any(t.startswith(table + "/") for t in self.tables)

    def _new(self, table: str, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}-{table.replace('/', '-')}"
        self.written.append(name)
        df.write.parquet(f"{self.files.root}/{name}")
        return name

    def read(self, table: str) -> DataFrame | None:
        found = self.tables.get(table)
        return self.spark.read.parquet(*(f"{self.files.root}/{f}" for f in found)) if found else None

    def write(self, table: str, df: DataFrame) -> None:
        """Replace a table; df may read the one that it replaces."""
        self.tables[table] = [self._new(table, df)]

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to a table: what it has is neither read nor copied."""
        self.tables[table] = [*self.tables.get(table, []), self._new(table, df)]

    def drop(self, *tables: str) -> None:
        for t in tables:
            self.tables.pop(t, None)

    def write_edges(self, df: DataFrame, channel: str) -> None:
        """Replace one channel's edges; other channels' files stay."""
        self.write(f"edges/{channel}", df.drop("channel"))

    def edges(self, channel: str | None = None) -> DataFrame | None:
        """One channel's edges, or all with their channel; columns that a channel lacks are null."""
        if "edges" not in self:
            return None
        names = sorted(t.split("/", 1)[1] for t in self.tables if t.startswith("edges/"))
        parts = [self.read(f"edges/{c}").withColumn("channel", F.lit(c)) for c in names if channel in (None, c)]
        if not parts:
            return self.read(f"edges/{names[0]}").withColumn("channel", F.lit(channel)).limit(0)
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def meta(self) -> dict:
        return dict(self.values)

    def put_meta(self, **values) -> None:
        """Values as JSON keeps them."""
        self.values = json.loads(json.dumps(self.values | values))

    def commit(self) -> str:
        return json.dumps({"tables": self.tables, "meta": self.values}, sort_keys=True)

    def clear(self, keep: bool = False) -> None:
        """Delete the folders that this epoch wrote; with keep, only those that it has replaced again."""
        named = {f for t in self.tables.values() for f in t} if keep else set()
        for f in self.written:
            if f not in named:
                self.files.delete(f)


class Store:
    """The epochs under a root: a path or a URI."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("log") if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, number: int) -> dict:
        return json.loads(self.files.text(f"log/{number:06d}.json"))

    def current(self) -> int | None:
        return max(self.numbers(), default=None)

    def exists(self) -> bool:
        return self.current() is not None

    def open(self) -> Epoch:
        n = self.current()
        if n is None:
            raise FileNotFoundError(f"no index in {self.root}")
        return Epoch(self.spark, self.root, n, self.commit(n))

    @contextlib.contextmanager
    def aside(self) -> Iterator[Epoch]:
        """An epoch that is never committed, deleted when the block ends: it starts with the current one's tables."""
        now = self.current()
        epoch = Epoch(self.spark, self.root, 0, None if now is None else self.commit(now))
        try:
            yield epoch
        finally:
            epoch.clear()

    @contextlib.contextmanager
    def begin(self, inherit: bool = True) -> Iterator[Epoch]:
        """A new epoch, committed if the block ends well and deleted if it raises or if another writer was first."""
        now = self.current()
        epoch = Epoch(self.spark, self.root, (now or 0) + 1, self.commit(now) if inherit and now is not None else None)
        try:
            yield epoch
            if not self.files.create(f"log/{epoch.number:06d}.json", epoch.commit()):
                raise Conflict(f"epoch {epoch.number} was committed by another writer")
        except BaseException:
            epoch.clear()
            raise
        epoch.clear(keep=True)
        self.prune()

    def prune(self) -> None:
        """Keep the last epochs. Folders go only if an epoch that goes named them and none that stays does: those of a writer at work are named by none."""
        numbers = self.numbers()
        old = {n: self.commit(n)["tables"] for n in numbers[:-KEEP]}
        if not old:
            return
        kept = {f for n in numbers[-KEEP:] for t in self.commit(n)["tables"].values() for f in t}
        for n in old:
            self.files.delete(f"log/{n:06d}.json")
        for f in {f for tables in old.values() for t in tables.values() for f in t} - kept:
            self.files.delete(f)
