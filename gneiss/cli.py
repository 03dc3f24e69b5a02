"""python -m gneiss.cli COMMAND: build, refresh, ask, pack, impact, co-change, hotspots, stats, eval, serve, map, summarize."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gneiss").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gneiss", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--out", default="gneiss-index")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for k, v in options.items():
            s.add_argument("--" + k.replace("_", "-"), **v)

    flag, number = {"action": "store_true"}, lambda n: {"type": int, "default": n}
    for name in ("build", "refresh"):
        add(name, graph={"default": None}, backend={"default": "none"}, force=flag, yes=flag, max_commits=number(20_000), since={"default": None})
    add("ask", "query", k=number(10), no_tests=flag, json=flag)
    add("pack", "query", budget=number(8000))
    add("impact", "query", k=number(20))
    add("co-change", "path", n=number(10))
    add("hotspots", n=number(20))
    add("stats")
    add("eval", fraction={"type": float, "default": 0.8}, limit=number(200), json={"default": None}, no_rebuild=flag)
    add("serve")
    add("map", "file", symbols=flag)
    add("summarize", command={"default": None, "dest": "caller"}, n=number(12))
    return p


def evaluate(spark, store, root: str, fraction: float, limit: int, rebuild: bool = True, least: int = 20) -> list:
    """Rungs over changes after the cutoff, with a history that ends there, in an epoch that is never published; rebuild=False takes the history that the index has."""
    import contextlib

    from gneiss.operators import evaluation, temporal
    from gneiss.plans.history import refresh
    from gneiss.plans.index import encoder_of
    from gneiss.plans.batch import BatchRetriever
    from gneiss.sources import history

    commits, _ = history.commits(spark, root)
    cutoff = evaluation.time_split(commits, fraction).first()["ts"]
    items = evaluation.eval_set(history.subjects(spark, root, cutoff), history.current_files(spark, root), cutoff, limit)
    rows = items.collect()
    if len(rows) < least:
        raise ValueError(f"{len(rows)} changes are too few to evaluate")
    queries = spark.createDataFrame([(r["sha"], r["query"]) for r in rows], "query_id string, query string")
    truth = spark.createDataFrame([(r["sha"], p) for r in rows for p in r["files"]], "query_id string, path string")
    with store.aside() if rebuild else contextlib.nullcontext(store.open()) as epoch:
        if rebuild:
            refresh(epoch, root, cutoff, temporal.HistoryConfig(before_ts=cutoff))
        encoder = encoder_of(epoch)

        def rung(use_lexical: bool, use_dense: bool, ppr: bool = False):
            r = BatchRetriever(epoch, encoder=encoder, use_lexical=use_lexical, use_dense=use_dense)
            return lambda asked: r.search(asked, k=3 * max(evaluation.KS), use_ppr=ppr).select("query_id", "rank", "source_file")

        dense = rung(False, True) if "vectors" in epoch and encoder is not None else None
        return evaluation.run_ladder({"bm25": rung(True, False), "dense": dense, "hybrid": rung(True, True), "hybrid+ppr": rung(True, True, True)}, queries, truth)


def serve(tools) -> None:
    """Tool calls as JSON lines: {"tool": name, "args": {...}} in, {"text": ...} or {"error": ...} out."""
    from gneiss.tools import names

    for line in sys.stdin:
        try:
            call = json.loads(line)
            if call["tool"] not in names():
                raise ValueError(f"no tool {call['tool']}; there are {', '.join(names())}")
            out = {"text": getattr(tools, call["tool"])(**call.get("args", {}))}
        except Exception as e:  # a bad call must not end the server
            out = {"error": f"{type(e).__name__}: {e}"}
        print(json.dumps(out), flush=True)


def run(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from gneiss.operators.temporal import HistoryConfig
    from gneiss.plans import index
    from gneiss.plans.store import Store

    spark = spark or session()
    store = Store(spark, a.out)
    if a.command in ("build", "refresh"):
        try:
            out = index.build_index(spark, a.root, store, a.graph, HistoryConfig(max_commits=a.max_commits, since=a.since), a.backend, a.force, a.yes)
        except index.LongBuild as e:
            print(f"embedding would take {e}; --yes goes on", file=sys.stderr)
            return 2
        print(json.dumps(out))
        return 0
    if not store.exists():
        print(f"no index in {a.out}", file=sys.stderr)
        return 1
    from gneiss.tools import Tools

    tools = Tools(store, a.root, index.encoder_of(store.open()))
    if a.command == "ask":
        if a.json:
            hits, warnings = tools._hits(a.query, a.k, not a.no_tests)
            print(json.dumps({"hits": [h.asDict() for h in hits], "warnings": warnings}))
        else:
            print(tools.search(a.query, a.k, not a.no_tests))
    elif a.command == "pack":
        print(tools.context_pack(a.query, a.budget))
    elif a.command == "impact":
        print(tools.impact_of(a.query, a.k))
    elif a.command == "co-change":
        print(tools.co_change(a.path, a.n))
    elif a.command == "hotspots":
        print(tools.hotspots(a.n))
    elif a.command == "stats":
        print(tools.graph_stats())
    elif a.command == "eval":
        from gneiss.operators import evaluation

        try:
            rungs = evaluate(spark, store, a.root, a.fraction, a.limit, not a.no_rebuild)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print(evaluation.report(rungs))
        if a.json:
            Path(a.json).write_text(json.dumps([{"rung": r.name, "recall": r.recall, "mrr": r.mrr, "seconds_per_query": r.seconds} for r in rungs]))
    elif a.command == "serve":
        serve(tools)
    elif a.command == "map":
        from gneiss import viz

        (viz.write_symbols if a.symbols else viz.write)(store.open(), a.file, Path(a.root).resolve().name)
    elif a.command == "summarize":
        import subprocess

        from gneiss.operators import reports

        if not a.caller:
            print("--command names a program that reads a prompt and writes a summary", file=sys.stderr)
            return 1
        with store.begin() as epoch:
            old = epoch.read("community_summaries")
            if old is None:
                old = spark.createDataFrame([], "community long, name string, member_hash string, summary string")
            new, counts = reports.summarize(epoch.read("nodes"), old, lambda p: subprocess.run(a.caller, shell=True, input=p, capture_output=True, text=True, check=True).stdout.strip(), a.n)
            epoch.write("community_summaries", new)
        print(json.dumps(counts))
    return 0


def main() -> None:
    try:
        sys.exit(run())
    except KeyboardInterrupt:
        sys.exit(130)


if __name__ == "__main__":
    main()
