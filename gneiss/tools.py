"""The questions that an index answers, as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import graph, pack, reports
from gneiss.plans import index
from gneiss.plans.retrieve import Retriever
from gneiss.plans.store import Store
from gneiss.sources import history, tree

MOST = 50


class Tools:
    def __init__(self, store: Store, root: str, encoder=None):
        self.epoch, self.root, self.encoder, self.spark = store.open(), root, encoder, store.spark
        self.nodes = self.epoch.read("nodes")

    def retriever(self, include_tests: bool = True) -> Retriever:
        return Retriever(self.epoch, include_tests=include_tests, encoder=self.encoder)

    def _hits(self, query: str, k: int, include_tests: bool = True, reverse: bool = False) -> tuple[list, list[str]]:
        r = self.retriever(include_tests).search(query, k=min(k, MOST), reverse=reverse)
        return ([] if r.hits is None else r.hits.orderBy("rank").collect()), r.warnings

    @staticmethod
    def _line(h) -> str:
        at = f"{h['source_file']}:{h['start_line']}" if h["source_file"] and h["start_line"] else h["source_file"] or ""
        return f"{h['score']:.3f} {h['label']} {at} ({h['why']})"

    def search(self, query: str, k: int = 10, include_tests: bool = True) -> str:
        hits, warnings = self._hits(query, k, include_tests)
        return "\n".join(self._line(h) for h in hits) or "\n".join(warnings)

    def context_pack(self, query: str, budget: int = 8000, k: int = 40) -> str:
        hits, warnings = self._hits(query, k)
        items = []
        for h in hits:
            at = f"{h['source_file']}:{h['start_line']}" if h["source_file"] and h["start_line"] else h["source_file"] or ""
            lines = tree.read_lines(self.root, h["source_file"])[(h["start_line"] or 1) - 1 : h["end_line"] or h["start_line"]] if h["source_file"] and h["start_line"] else []
            body = "\n".join(lines[:40] + [f"    ... {len(lines) - 40} more lines ..."] * (len(lines) > 40))
            items.append({"label": h["label"], "location": at, "kind": h["kind"], "why": h["why"], "text": body, "community": h["community"], "source_file": h["source_file"], "cost": pack.cost(h["label"], at, body)})
        taken, used = pack.order(items, budget)
        return pack.render(query, [items[i] for i in taken], used, len(items) - len(taken), warnings)

    def impact_of(self, query: str, k: int = 20) -> str:
        r = self.retriever().search(query, k=min(k, MOST), reverse=True)
        if r.hits is None:
            return "\n".join(r.warnings)
        by_history, others = reports.impact_split(r.hits)
        out = ["By code:", *(self._line(h) for h in others.orderBy("rank").collect()), "By history:", *(self._line(h) for h in by_history.orderBy("rank").collect())]
        files = self.epoch.read("files")
        if files is not None:
            out += ["Owners:", *(f"{o['path']} {o['primary_owner']} {o['owner_share']:.0%}" for o in reports.impact_owners(r.hits, files).orderBy("path").collect())]
        return "\n".join(out)

    def co_change(self, path: str, n: int = 10) -> str:
        pairs = self.epoch.read("cochange")
        rows = [] if pairs is None else reports.cochange_partners(pairs, path, min(n, MOST)).collect()
        return "\n".join(f"{r['other']} {r['support']:.2f} ({r['n_ab']} commits, lift {r['lift']:.1f})" for r in rows) or f"nothing changes with {path}"

    def hotspots(self, n: int = 10) -> str:
        files = self.epoch.read("files")
        rows = [] if files is None else reports.hotspots(files, min(n, MOST)).collect()
        return "\n".join(f"{r['path']} {r['hotspot']:.2f} (churn {r['churn']:.2f}, bus factor {r['bus_factor']})" for r in rows) or "no history"

    def owners(self, path: str) -> str:
        owned = self.epoch.read("ownership")
        rows = [] if owned is None else reports.owners(owned, path).collect()
        return "\n".join(f"{r['author']}: {r['n_commits']} commits" for r in rows) or f"no owner of {path} is known"

    def _node(self, text: str):
        return graph.find_node(self.nodes, text).first()

    def explain(self, name: str) -> str:
        n = self._node(name)
        if n is None:
            return f"no node named {name}"
        near = graph.explain_neighbours(self.epoch.edges("structural"), self.nodes, n["idx"]).collect()
        return "\n".join([f"{n['label']} ({n['kind']}) {n['source_file']}:{n['start_line']}", n["signature"] or "", n["docstring"] or "", *(f"{r['relation']} {r['label']} {r['source_file']}" for r in near)])

    def path(self, a: str, b: str) -> str:
        x, y = self._node(a), self._node(b)
        if x is None or y is None:
            return f"no node named {a if x is None else b}"
        ids = graph.shortest_path(self.epoch.edges(), x["idx"], y["idx"])
        names = {r["idx"]: r["label"] for r in self.nodes.where(F.col("idx").isin(ids)).select("idx", "label").collect()} if ids else {}
        return " -> ".join(names[i] for i in ids) or f"no path from {a} to {b}"

    def cycles(self, min_size: int = 2, n: int = 10) -> str:
        rows = graph.file_cycles(self.epoch.edges(), self.nodes, min_size, n).collect()
        return "\n".join(f"{r['size']}: {', '.join(r['files'][:20])}" for r in rows) or "no cycles"

    def diff_impact(self, revisions: str, n: int = 20) -> str:
        changed = history.changed_files(self.spark, self.root, revisions)
        rows = graph.diff_impact(self.epoch.edges(), self.nodes, changed, n).collect()
        missing = graph.unindexed(self.nodes, changed).count()
        out = [f"{r['path']} ({r['connections']} connection(s) to the change)" for r in rows] or ["nothing else is joined to the change"]
        return "\n".join(out + [f"{missing} changed file(s) are not indexed"] * bool(missing))

    def tests_for(self, path: str, n: int = 10) -> str:
        node = self._node(path)
        target = node["source_file"] if node is not None else path
        rows = graph.tests_for(self.epoch.edges(), self.nodes, target, n).collect()
        return "\n".join(f"{r['path']} ({r['connections']})" for r in rows) or f"no tests are joined to {target}"

    def overview(self, n: int = 12) -> str:
        s = self.epoch.read("community_summaries")
        rows = [] if s is None else reports.overview(self.nodes, s, n).collect()
        return "\n".join(f"{r['name']} ({r['size']}): {r['summary']}" for r in rows) or "no summaries"

    def graph_stats(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in index.stats(self.epoch).first().asDict().items())


def names() -> list[str]:
    return sorted(n for n, f in vars(Tools).items() if callable(f) and not n.startswith("_") and n != "retriever")
