"""Text functions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The words that identifiers share too widely to tell them apart.
STOP_WORDS = ["get", "set", "the", "and", "for", "with", "from", "into", "self", "cls", "init", "main", "new", "obj", "val", "tmp", "var", "func", "def"]

# Paths that say nothing about how files change together.
NOISE_PATH = (
    r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|go\.sum|Gemfile\.lock|composer\.lock|uv\.lock"
    r"|CHANGELOG(\.md)?|[^/]*\.min\.(js|css)|.*\.generated\..*|.*_pb2\.py|.*\.pb\.go)$"
)
# Paths of tests, of generated files, and subjects about process, for evaluation.
TEST_PATH = r"(?i)(^|/)(tests?|spec|__tests__|testing)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(spec|test)\.[a-z]+$"
EVAL_NOISE_PATH = r"(?i)(^|/)(package-lock\.json|yarn\.lock|poetry\.lock|Cargo\.lock|uv\.lock|go\.sum|CHANGELOG(\.md)?)$|\.(min\.js|min\.css|lock)$|(^|/)(dist|build|vendor)/"
PROCESS_SUBJECT = r"(?i)^\s*(merge|revert|bump|release|v?\d+\.\d+\.\d+|chore\(deps\)|update changelog|typo|formatting|lint|rename)\b"

# Parts of identifiers, words of texts, and the signs whose pairs count.
PART = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"
WORD = r"[\p{L}\p{M}]+|\p{Nd}+"
CJK = "一-鿿぀-ヿ가-힯"
#: Runs of letters, what tells those that may have several parts, and what a text with such a run holds.
LETTERS = r"[\p{L}\p{M}]+"
INNER = r"[a-z][A-Z]|[A-Z][A-Z][a-z]|[^A-Za-z]"
SOME_SPLIT = r"[a-z][A-Z]|[A-Z][A-Z][a-z]|[^\x00-\x7F]"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_identifier(name: str | Column, keep_stop: bool = False) -> Column:
    """Lower-cased words of camelCase, snake_case, path-like and ACRONYMWord names, two letters or longer, each once."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(_col(name), F.lit("")), F.lit(PART), F.lit(0)), lambda x: F.lower(x))
    keep = F.filter(parts, lambda x: F.length(x) >= 2)
    if not keep_stop:
        keep = F.filter(keep, lambda x: ~x.isin(STOP_WORDS))
    return F.array_distinct(keep)


def path_terms(path: str | Column) -> Column:
    """Words of a path's directories and file name, without extensions."""
    parts = F.filter(F.split(F.coalesce(_col(path), F.lit("")), r"[/\\]"), lambda p: ~p.isin("", ".", ".."))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: split_identifier(F.regexp_replace(p, r"\.\w+$", "")))))


def tokenize(text: str | Column) -> Column:
    """Lower-cased words and numbers; the parts of words that split; the pairs of neighbours in runs of Chinese, Japanese and Korean signs.

    Only words with an inner capital, or a letter that is not one of A-Z and a-z, can split; the others are not taken apart.
    """
    t = F.coalesce(_col(text), F.lit(""))
    none = F.array().cast("array<string>")

    words = F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))
    split = F.filter(F.regexp_extract_all(t, F.lit(LETTERS), F.lit(0)), lambda w: w.rlike(INNER))
    parts = F.flatten(F.filter(F.transform(split, lambda w: split_identifier(w)), lambda p: F.size(p) > 1))
    runs = F.regexp_extract_all(t, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2)))))
    out = F.concat(words, F.when(t.rlike(SOME_SPLIT), parts).otherwise(none))
    return F.when(t.rlike(f"[{CJK}]"), F.concat(out, pairs)).otherwise(out)


def estimate_tokens(text: str | Column) -> Column:
    return (F.floor(F.length(F.coalesce(_col(text), F.lit(""))) / F.lit(3.2)) + 1).cast("long")


def clean_label(label: str | Column) -> Column:
    """A label without closing parentheses and leading dots."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(label), F.lit("")), r"[()]+$", ""), r"^\.+", "")


def ingest_label(label: str | Column) -> Column:
    """A raw node's label as spans name it: without blanks and a call's parentheses at the end, quotes around it and leading dots."""
    bare = F.regexp_replace(F.trim(F.coalesce(_col(label), F.lit(""))), r"\(\)\s*$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^[\"']+|[\"']+$", ""), r"^\.+", "")


def _line(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def node_text(label: str | Column, kind=None, path=None, signature=None, docstring=None, neighbours=None, body=None, body_lines: int = 15) -> Column:
    """A node's document, one part a line: label, its words, kind, path words, signature, docstring or else the body's head, neighbours' words."""
    none = F.lit(None).cast("string")
    kind, path, signature, docstring, body = (none if c is None else _col(c) for c in (kind, path, signature, docstring, body))
    label = clean_label(label)
    doc = F.trim(F.coalesce(docstring, F.lit("")))
    head = F.filter(F.transform(F.slice(F.split(F.trim(F.coalesce(body, F.lit(""))), r"\r\n|\r|\n"), 1, body_lines), lambda x: F.trim(x)), lambda x: x != "")
    parts = [
        _line(label), _line(F.array_join(split_identifier(label), " ")), _line(kind), _line(F.array_join(path_terms(path), " ")),
        _line(F.substring(F.trim(F.coalesce(signature, F.lit(""))), 1, 300)), _line(F.substring(doc, 1, 600)),
        F.when(doc == "", _line(F.substring(F.array_join(head, " "), 1, 500))),
    ]
    if neighbours is not None:
        near = F.slice(F.coalesce(_col(neighbours), F.array().cast("array<string>")), 1, 12)
        words = F.array_distinct(F.flatten(F.transform(near, lambda x: split_identifier(clean_label(x)))))
        parts.append(_line(F.array_join(F.slice(words, 1, 24), " ")))
    return F.concat_ws("\n", *parts)


def is_noise(path: str | Column) -> Column:
    return _col(path).rlike(NOISE_PATH)


def is_test_path(path: str | Column) -> Column:
    """The rule of the ranking prior."""
    return F.coalesce(_col(path), F.lit("")).rlike(TEST_PATH)


def is_test_file(path: str | Column) -> Column:
    """The rule of tests_for: a path that mentions test or spec and is no Markdown file."""
    p = F.lower(_col(path))
    return (p.contains("test") | p.contains("spec")) & ~p.endswith(".md")


def eval_query(subject: str | Column, body: str | Column) -> Column:
    return F.substring(F.trim(F.concat(F.trim(_col(subject)), F.lit(". "), F.trim(F.coalesce(_col(body), F.lit(""))))), 1, 600)


def line_slice(lines: Column, start: Column, end: Column, most: int = 40) -> Column:
    """Lines start to end (from 1, inclusive); past `most`, a line says how many are left out."""
    n = F.greatest(F.lit(0), F.least(F.size(lines), F.coalesce(end, start)) - start + 1)
    part = F.array_join(F.slice(lines, start, F.least(n, F.lit(most))), "\n")
    more = F.concat(part, F.lit("\n    ... "), (n - most).cast("string"), F.lit(" more lines ..."))
    return F.when(start.isNull() | (n <= 0), F.lit("")).otherwise(F.when(n > most, more).otherwise(part))


def start_line(location: str | Column) -> Column:
    """The number of "L<n>"."""
    return F.nullif(F.regexp_extract(_col(location), r"^L(\d+)", 1), F.lit("")).cast("int")


def escape_json_for_html(text: str | Column) -> Column:
    return F.replace(_col(text), F.lit("<"), F.lit("\\u003c"))
