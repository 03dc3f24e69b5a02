"""Imports between files, as candidate paths that are joined to the files there are."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gneiss.operators.ingest import resolve_imports

# Endings that a relative import may leave out, in order.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]

# The forms of imports that are read.
_FROM = re.compile(r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n]+)")
_IMPORT = re.compile(r"(?m)^[ \t]*import[ \t]+([^\n#]+)")
_SCRIPT = re.compile(r"""\b(?:import|export)\s+(?:[\w\s{},*$]+\s+from\s+)?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)""")
SCHEMA = "importer string, import_id string, priority int, path string"


def python_modules(text: str) -> set[str]:
    """Modules that a text may import; of `from x import a`, both x and x.a."""
    out = set()
    for m in _FROM.finditer(text):
        base = m[1] or "."
        out.add(base)
        for name in m[2].strip("()").replace("\n", ",").split(","):
            name = name.split("#")[0].split(" as ")[0].strip()
            if name and name != "*":
                out.add(base + ("" if base.endswith(".") else ".") + name)
    for m in _IMPORT.finditer(text):
        out |= {x.split(" as ")[0].strip() for x in m[1].split(",")}
    return {x for x in out if re.fullmatch(r"\.*[\w.]*", x) and x}


def python_candidates(module: str, importer: str) -> list[str]:
    """Paths for a module, best first: from the root, then from the importer's folder; longest names first."""
    name = module.lstrip(".")
    up, folder = len(module) - len(name), posixpath.dirname(importer)
    if up:
        for _ in range(up - 1):
            folder = posixpath.dirname(folder)
        bases = [folder]
    else:
        bases = ["", folder]
    parts = name.split(".") if name else []
    return [posixpath.join(b, *parts[:n]) + end for b in bases for n in range(len(parts), 0, -1) for end in (".py", "/__init__.py")]


def script_candidates(spec: str, importer: str) -> list[str]:
    """Paths for a relative import, best first; none for packages and for paths above the root."""
    if not spec.startswith("."):
        return []
    p = posixpath.normpath(posixpath.join(posixpath.dirname(importer), spec))
    if p == ".." or p.startswith("../"):
        return []
    return [p, *(p + e for e in SCRIPT_ENDINGS), *(f"{p}/index{e}" for e in SCRIPT_ENDINGS)]


def candidates(path: str, text: str, language: str | None) -> list[tuple[str, str, int, str]]:
    if language == "python":
        found = [(m, python_candidates(m, path)) for m in sorted(python_modules(text))]
    elif language in ("javascript", "typescript"):
        found = [(s, script_candidates(s, path)) for s in sorted({m[1] or m[2] for m in _SCRIPT.finditer(text)})]
    else:
        return []
    return [(path, key, i, p) for key, paths in found for i, p in enumerate(dict.fromkeys(paths))]


def import_edges(files: DataFrame) -> DataFrame:
    """(importer, target) between files (path, text, language)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [r for p, t, l in zip(pdf["path"], pdf["text"], pdf["language"]) for r in candidates(p, t or "", l)]
            yield pd.DataFrame(rows, columns=["importer", "import_id", "priority", "path"])

    c = files.where(F.col("language").isin("python", "javascript", "typescript")).select("path", "text", "language").mapInPandas(run, SCHEMA)
    return resolve_imports(c, files.select("path"))
