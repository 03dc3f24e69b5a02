"""Source trees as tables of files.

Folders are listed level by level, each level in parallel, and those that are skipped are never listed; then the kept files
are read in parallel.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gneiss.plans.checkpoint import truncate

# Folders that are not read, endings of documents, sizes that are read at most.
SKIP_DIRS = [
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build", "target",
    "vendor", ".next", ".nuxt", ".output", ".terraform", ".idea", ".vscode", "coverage", ".tox", ".eggs", ".worktrees", ".codex_worktrees",
]
# Folders that the walk for definitions skips; hidden ones besides these are read.
SOURCE_SKIP_DIRS = [
    ".git", ".hg", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", "vendor", ".mypy_cache", ".pytest_cache", ".tox", ".next", ".cache",
]
DOC_ENDINGS = [".md", ".rst", ".txt"]
MOST_TEXT, MOST_SOURCE = 1_500_000, 2_000_000

# Languages by file ending.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".lua": "lua", ".sh": "bash", ".bash": "bash", ".ex": "elixir", ".exs": "elixir",
    ".zig": "zig", ".jl": "julia",
}


def ending(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(p, r"[^/](\.[^./]*)$", 1))


def language(path: str | Column) -> Column:
    """The language of a path by its ending; null if none is known."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.element_at(table, ending(path))


def is_document(path: str | Column) -> Column:
    return ending(path).isin(DOC_ENDINGS)


def folder_read(name: str | Column, sources: bool = False) -> Column:
    """Whether a folder of this name is listed: not if it is skipped or, but for .github and the walk for definitions, hidden."""
    n = F.col(name) if isinstance(name, str) else name
    return ~n.isin(SOURCE_SKIP_DIRS) if sources else ~(n.isin(SKIP_DIRS) | (n.startswith(".") & (n != ".github")))


def walkable(path: str | Column, sources: bool = False) -> Column:
    """Whether a relative path is read: no skipped folder, and no hidden file unless a document. For definitions (sources): no skipped
    name anywhere in the path, and an ending of a known language."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    if sources:
        return ~F.exists(parts, lambda d: ~folder_read(d, True)) & language(p).isNotNull()
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return ~F.exists(dirs, lambda d: ~folder_read(d)) & (~F.element_at(parts, -1).startswith(".") | is_document(p))


def contained(root: str | Path, path: str | Path) -> Path | None:
    """The real path of a regular file that lies inside root, links followed; None for any other."""
    base = Path(root).resolve()
    try:
        real = (base / path).resolve(strict=True)
    except (OSError, RuntimeError, ValueError):
        return None
    return real if real.is_file() and real.is_relative_to(base) else None


def read_lines(root: str | Path, path: str | Path) -> list[str]:
    real = contained(root, path)
    return real.read_bytes().decode("utf-8", "replace").splitlines() if real else []


def store_of(root: str):
    """(file system, path) of a folder: a local path, or an address that pyarrow knows."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), os.path.realpath(root)
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root).rstrip("/"))


def entries(root: str, folder: str) -> Iterator[tuple[str, str, bool, int]]:
    """(path, name, is_dir, size) of what lies in a folder below root. Links to folders, and to files outside root, are left out."""
    from pyarrow import fs

    store, base = store_of(root)
    at = posixpath.join(base, folder) if folder else base
    local = isinstance(store, fs.LocalFileSystem)
    try:
        found = store.get_file_info(fs.FileSelector(at))
    except OSError:  # a folder that may not be read, or is gone
        return
    for f in found:
        path = posixpath.join(folder, f.base_name) if folder else f.base_name
        if local and os.path.islink(f.path) and (f.type == fs.FileType.Directory or contained(base, path) is None):
            continue
        if f.type in (fs.FileType.Directory, fs.FileType.File):
            yield path, f.base_name, f.type == fs.FileType.Directory, f.size or 0


def listed(spark: SparkSession, root: str, sources: bool = False) -> DataFrame:
    """(path, size) of all files in folders that are read; paths are relative to root. A job for each level of folders."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for folder in pdf["path"]:
                yield pd.DataFrame(list(entries(root, folder)), columns=["path", "name", "is_dir", "size"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = truncate(level.mapInPandas(run, "path string, name string, is_dir boolean, size long"))
        own = found.where("not is_dir").select("path", "size")
        files = own if files is None else files.unionByName(own)
        level = found.where(F.col("is_dir") & folder_read("name", sources)).select("path").repartition(spark.sparkContext.defaultParallelism)
        if not level.limit(1).count():
            return files


def scan(spark: SparkSession, root: str, most: int = MOST_TEXT, sources: bool = False) -> DataFrame:
    """(path, text, language, is_doc) of the tree's code and documents, in parallel over files.

    Paths are relative to root. Links of a local tree that lead out of it are left out. sources: the walk for definitions, which takes
    code only, by another rule; as that rule looks at the root's own folders too, a tree below a skipped folder has none.
    """
    if sources and not set(SOURCE_SKIP_DIRS).isdisjoint(store_of(root)[1].split("/")):
        return spark.createDataFrame([], "path string, text string, language string, is_doc boolean")
    kept = listed(spark, root, sources).where(walkable("path", sources) & (F.col("size") <= most))
    kept = kept.where(language("path").isNotNull() | is_document("path")).select("path")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = store_of(root)
        for pdf in parts:
            rows, held = [], 0
            for path in pdf["path"]:
                try:
                    with store.open_input_stream(posixpath.join(base, path)) as f:
                        data = f.read()
                except OSError:
                    continue
                rows.append((path, data.decode("utf-8", "replace")))
                held += len(data)
                if held > 16 << 20:
                    yield pd.DataFrame(rows, columns=["path", "text"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "text"])

    texts = kept.repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, "path string, text string")
    return texts.select("path", "text", language("path").alias("language"), is_document("path").alias("is_doc"))


def line_array(text: str | Column) -> Column:
    """The lines of a text, at every kind of line end that Python knows; a line end at the end begins no line."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(line_array("text")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
