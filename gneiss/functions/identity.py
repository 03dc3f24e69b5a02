"""Stable keys and content hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def framed(*parts: Column) -> Column:
    """Parts with their lengths in front, so that ("ab", "c") and ("a", "bc") differ."""
    out = []
    for p in parts:
        p = F.coalesce(p.cast("string"), F.lit(""))
        out += [F.octet_length(p).cast("string"), F.lit("\x1f"), p, F.lit("\x1e")]
    return F.concat(*out)


def node_key(path: Column, label: Column, kind: Column, line: Column | None = None) -> Column:
    """128 bits in hex for a node; the line tells overloads apart."""
    return F.substring(F.sha2(framed(path, label, kind, *([] if line is None else [line])), 256), 1, 32)


def file_key(path: Column) -> Column:
    return node_key(path, F.lit(""), F.lit("file"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def blake_key(*parts: str) -> str:
    """BLAKE2b-128 over framed parts, for keys made on the driver."""
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        data = p.encode("utf-8", "surrogatepass")
        h.update(str(len(data)).encode() + b"\x1f" + data + b"\x1e")
    return h.hexdigest()


def member_hash(keys: Column) -> Column:
    """A hash of an ordered list of keys."""
    return F.sha2(F.array_join(keys, "\n"), 256)
