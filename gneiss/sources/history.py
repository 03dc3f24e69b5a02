"""Git histories as tables."""

from __future__ import annotations

import codecs
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gneiss.operators.temporal import HistoryConfig
from gneiss.plans.checkpoint import truncate

RECORD, FIELD = "\x1e", "\x1f"
SCHEMA = "sha string, ts long, author string, path string"


def git(root: str | Path, *args: str) -> str:
    out = subprocess.run(["git", "-c", "core.quotepath=off", "-C", str(root), *args], capture_output=True, check=True)
    return out.stdout.decode("utf-8", "replace")


def is_repo(root: str | Path) -> bool:
    try:
        return git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (OSError, subprocess.CalledProcessError):
        return False


def head(root: str | Path) -> str:
    return git(root, "rev-parse", "HEAD").strip()


def is_ancestor(root: str | Path, older: str, newer: str) -> bool:
    """Whether a commit is there and all of its history belongs to another's."""
    return subprocess.run(["git", "-C", str(root), "merge-base", "--is-ancestor", older, newer], capture_output=True).returncode == 0


def reach(config: HistoryConfig) -> list[str]:
    return ["--no-merges"] + ([f"--since={config.since}"] if config.since else [])


def kept(spark: SparkSession, root: str | Path, config: HistoryConfig, at: str) -> DataFrame:
    """(sha) of the commits that a whole reading would take, max_commits at most: names only, no files."""
    names = git(root, "rev-list", *reach(config), f"--max-count={config.max_commits}", at).split()
    return spark.createDataFrame([(n,) for n in names], "sha string")


def records(chunks: Iterable[str], end: str = "\0") -> Iterator[str]:
    """The fields of a text that comes in chunks."""
    left = ""
    for chunk in chunks:
        *fields, left = (left + chunk).split(end)
        yield from fields
    yield left


def parse_log(raw: str | Iterable[str]) -> Iterator[tuple[str, int, str, list[str]]]:
    """Commits (sha, ts, author, files) of a log with NUL between fields, whole or in chunks; a rename, which has an empty path and then two more fields, counts as its new path."""
    head, files = None, []
    fields = records([raw] if isinstance(raw, str) else raw)
    for f in fields:
        at = f.find(RECORD)
        if at >= 0:
            if head:
                yield (*head, files)
            sha, ts, author = (f[at + 1 :].split(FIELD) + ["", ""])[:3]
            head, files = (sha.strip(), int(ts or 0), author), []
            continue
        counts = f.lstrip("\n").split("\t", 2)
        if len(counts) < 3 or head is None:
            continue
        path = counts[2]
        if not path:
            next(fields, None)
            path = next(fields, "")
        if path:
            files.append(path)
    if head:
        yield (*head, files)


def logs(raw: DataFrame) -> DataFrame:
    """SCHEMA rows of exported logs (raw string), each parsed by the task that holds it; a commit without files has a null path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for text in pdf["raw"]:
                rows = [(sha, ts, author, p) for sha, ts, author, files in parse_log(text) for p in dict.fromkeys(files or [None])]
                yield pd.DataFrame(rows, columns=["sha", "ts", "author", "path"])

    return raw.select("raw").mapInPandas(run, SCHEMA)


def parse_subjects(raw: str) -> Iterator[tuple[str, int, str, str, str]]:
    """(sha, ts, subject, body, path) of a log whose records have these four fields, and names with NUL between them."""
    for record in raw.split(RECORD)[1:]:
        sha, ts, subject, body, files = record.split(FIELD, 4)
        for p in files.split("\0"):
            if p := p.strip("\n"):
                yield sha.strip("\n"), int(ts), subject, body, p


SUBJECTS = "sha string, ts long, subject string, body string, path string"


def subject_logs(raw: DataFrame) -> DataFrame:
    """SUBJECTS rows of exported logs (raw string)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for text in pdf["raw"]:
                yield pd.DataFrame(list(parse_subjects(text)), columns=["sha", "ts", "subject", "body", "path"])

    return raw.select("raw").mapInPandas(run, SUBJECTS)


def log_args(config: HistoryConfig, revisions: str | None = None, skip: int = 0, most: int | None = None) -> list[str]:
    args = ["log", "--no-merges", "--numstat", "-z", "--encoding=UTF-8", f"--skip={skip}", f"--max-count={config.max_commits if most is None else most}", f"--format={RECORD}%H{FIELD}%at{FIELD}%an%x00"]
    args += ["-M"] if config.follow_renames else ["--no-renames"]
    args += [f"--since={config.since}"] if config.since else []
    return args + ([revisions] if revisions else [])


def streamed(root: str | Path, *args: str, size: int = 1 << 20) -> Iterator[str]:
    """A git command's output in chunks."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    with subprocess.Popen(["git", "-c", "core.quotepath=off", "-C", str(root), *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        while data := run.stdout.read(size):
            yield decoder.decode(data)
        yield decoder.decode(b"", True)
        if run.wait():
            raise subprocess.CalledProcessError(run.returncode, run.args)


def mine(root: str | Path, config: HistoryConfig = HistoryConfig(), revisions: str | None = None, skip: int = 0, most: int | None = None) -> Iterator[tuple[str, int, str, list[str]]]:
    """Commits one by one, never the whole log."""
    return (c for c in parse_log(streamed(root, *log_args(config, revisions, skip, most))) if config.before_ts is None or c[1] < config.before_ts)


class Slice(InputPartition):
    def __init__(self, skip: int, most: int):
        self.skip, self.most = skip, most


class GitLogReader(DataSourceReader):
    """The commits in slices of `slice` commits, a partition each; those of a range of revisions, if one is named. All tasks read from one commit back."""

    def __init__(self, options: dict):
        self.root, self.slice = options["path"], int(options.get("slice", 5_000))
        self.revisions = options.get("revisions") or head(self.root)
        if self.revisions.startswith("-"):
            raise ValueError(f"not a range: {self.revisions}")
        before = options.get("before_ts")
        self.config = HistoryConfig(max_commits=int(options.get("max_commits", HistoryConfig.max_commits)), since=options.get("since"), follow_renames=options.get("follow_renames", "true") == "true", before_ts=int(before) if before else None)

    def partitions(self) -> list[Slice]:
        n = min(int(git(self.root, "rev-list", "--count", *reach(self.config), self.revisions)), self.config.max_commits)
        return [Slice(i, min(self.slice, n - i)) for i in range(0, max(1, n), self.slice)]

    def read(self, partition: Slice):
        for sha, ts, author, files in mine(self.root, self.config, self.revisions, skip=partition.skip, most=partition.most):
            for path in sorted(set(files)) or [None]:
                yield sha, ts, author, path


class GitLog(DataSource):
    """spark.read.format("gitlog").load(root): one row per commit and file, and one without a path for a commit without files."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


def commits(spark: SparkSession, root: str | Path, config: HistoryConfig = HistoryConfig()) -> tuple[DataFrame, int]:
    """(sha, ts, author, path) rows, read in slices by tasks, and the number of commits, those without files too."""
    found = log_of(spark, root, config)
    return found.where("path is not null"), found.select("sha").distinct().count()


def log_of(spark: SparkSession, root: str | Path, config: HistoryConfig = HistoryConfig(), revisions: str | None = None) -> DataFrame:
    """SCHEMA rows of a repository or of a range of its revisions."""
    spark.dataSource.register(GitLog)
    options = {"max_commits": config.max_commits, "follow_renames": str(config.follow_renames).lower()} | ({"since": config.since} if config.since else {}) | ({"before_ts": config.before_ts} if config.before_ts is not None else {})
    options |= {"revisions": revisions} if revisions else {}
    return truncate(spark.read.format("gitlog").options(**options).load(str(root)))


def subjects(spark: SparkSession, root: str | Path, after_ts: int = 0) -> DataFrame:
    """(sha, ts, subject, body, path) of changes after a time."""
    raw = git(root, "log", "--no-merges", "--name-only", "-z", f"--format={RECORD}%H{FIELD}%at{FIELD}%s{FIELD}%b{FIELD}", *[f"--since=@{after_ts}"] * bool(after_ts))
    return spark.createDataFrame(list(parse_subjects(raw)), SUBJECTS)


def current_files(spark: SparkSession, root: str | Path) -> DataFrame:
    return spark.createDataFrame([(p,) for p in git(root, "ls-files", "-z").split("\0") if p], "path string")


def changed_files(spark: SparkSession, root: str | Path, revisions: str) -> DataFrame:
    """Paths that a range of revisions changes. The range is never taken for an option."""
    if revisions.startswith("-"):
        raise ValueError(f"not a range: {revisions}")
    names = git(root, "diff", "--name-only", "-z", "--end-of-options", revisions).split("\0")
    return spark.createDataFrame([(p,) for p in names if p], "path string")
