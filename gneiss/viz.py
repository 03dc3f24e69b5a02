"""The map's payload and pages."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import functions as F

from gneiss.operators import graph, mapview
from gneiss.plans.store import Epoch

PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><svg id="map" width="1000" height="1000"></svg><script type="application/json" id="data">{data}</script><script>
const d = JSON.parse(document.getElementById("data").textContent), s = document.getElementById("map"), n = d.files.length;
const at = i => { const a = 2 * Math.PI * i / Math.max(1, n), r = 300 + 20 * (d.files[i].r % 8); return [500 + r * Math.cos(a), 500 + r * Math.sin(a)]; };
const add = (t, a) => { const e = document.createElementNS("http://www.w3.org/2000/svg", t); for (const k in a) e.setAttribute(k, a[k]); s.appendChild(e); return e; };
for (const [a, b] of d.edges) { const [x1, y1] = at(a), [x2, y2] = at(b); add("line", {x1, y1, x2, y2, stroke: "#ccc"}); }
d.files.forEach((f, i) => { const [cx, cy] = at(i); const t = document.createElementNS("http://www.w3.org/2000/svg", "title"); t.textContent = f.p; add("circle", {cx, cy, r: 3 + Math.sqrt(f.h), fill: `hsl(${f.r * 45} 60% 50%)`}).appendChild(t); });
</script></body></html>"""


SYMBOLS = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body style="margin:0;background:#0b0e14;color:#ccc;font:13px sans-serif"><input id="find" placeholder="find" style="position:fixed;left:8px;top:8px"><div id="said" style="position:fixed;left:8px;top:40px;white-space:pre"></div><canvas id="map"></canvas><script type="application/json" id="data">{data}</script><script>
const d = JSON.parse(document.getElementById("data").textContent), c = document.getElementById("map"), g = c.getContext("2d"), n = d.nodes;
let zoom = 1, at = [0, 0], chosen = -1;
const near = n.map(() => []);
for (const [a, b] of d.edges) { near[a].push(b); near[b].push(a); }
const place = i => [c.width / 2 + (n[i].x - at[0]) * zoom, c.height / 2 + (n[i].y - at[1]) * zoom];
const draw = () => {
  c.width = innerWidth; c.height = innerHeight;
  g.strokeStyle = "#ffffff30";
  for (const b of chosen < 0 ? [] : near[chosen]) { g.beginPath(); g.moveTo(...place(chosen)); g.lineTo(...place(b)); g.stroke(); }
  n.forEach((f, i) => { const [x, y] = place(i); g.fillStyle = "#" + f.c.toString(16).padStart(6, "0"); g.fillRect(x - 1, y - 1, i === chosen ? 6 : 2 + Math.min(4, Math.sqrt(f.d) / 2), i === chosen ? 6 : 2 + Math.min(4, Math.sqrt(f.d) / 2)); });
};
const choose = i => { chosen = i; document.getElementById("said").textContent = i < 0 ? "" : [n[i].l + " (" + n[i].k + ")", n[i].p, ...near[i].slice().sort((a, b) => n[b].d - n[a].d).slice(0, 30).map(b => "  " + n[b].l)].join("\\n"); draw(); };
c.onclick = e => { let best = -1, least = 100; n.forEach((_, i) => { const [x, y] = place(i), q = (x - e.clientX) ** 2 + (y - e.clientY) ** 2; if (q < least) { least = q; best = i; } }); choose(best); };
c.onwheel = e => { zoom *= e.deltaY < 0 ? 1.2 : 1 / 1.2; draw(); };
c.onmousemove = e => { if (e.buttons) { at = [at[0] - e.movementX / zoom, at[1] - e.movementY / zoom]; draw(); } };
document.getElementById("find").onchange = e => choose(n.findIndex(f => f.l.toLowerCase().startsWith(e.target.value.toLowerCase())));
onresize = draw; draw();
</script></body></html>"""


def symbol_payload(epoch: Epoch, cap: int = mapview.MAX_NODES, links: int = mapview.MAX_EDGES) -> dict:
    """Nodes of the symbol map (label, kind, path, degree, place and colour), at most `cap`, and at most `links` edges between them, of the largest weights."""
    e = epoch.edges()
    rows = mapview.symbols(epoch.read("nodes"), e, cap).orderBy("idx").collect()
    number = {r["idx"]: i for i, r in enumerate(rows)}
    some = e.where((F.col("src") < cap) & (F.col("dst") < cap)).orderBy(F.desc("weight"), "src", "dst").limit(links).select("src", "dst").collect()
    nodes = [{"l": r["label"] or "", "k": r["kind"] or "", "p": r["source_file"] or "", "g": r["group"], "d": r["degree"], "x": round(r["x"], 2), "y": round(r["y"], 2), "c": r["color"]} for r in rows]
    return {"nodes": nodes, "edges": [[number[r["src"]], number[r["dst"]]] for r in some]}


def payload(epoch: Epoch, max_files: int | None = None) -> dict:
    """Regions, files (path, region, hotspot), edges between them and key files; if max_files is given, that many files by hotspot at most."""
    nodes, spark = epoch.read("nodes"), epoch.spark
    files = epoch.read("files")
    hot = files.select("path", F.coalesce("hotspot", F.lit(0.0)).alias("hotspot")) if files is not None else spark.createDataFrame([], "path string, hotspot double")
    r = mapview.regions(nodes).join(hot, "path", "left").fillna(0.0, ["hotspot"])
    names = mapview.majority(nodes, "community_name")
    found = r.join(names, "path", "left")
    found = found if max_files is None else found.orderBy(F.desc("hotspot"), "path").limit(max_files)
    rows = sorted(found.collect(), key=lambda x: x["path"])  # the page holds them all
    at = {x["path"]: i for i, x in enumerate(rows)}
    shown: dict[int, dict] = {}
    for x in rows:
        n = shown.setdefault(x["region"], {})
        n[x["community_name"] or f"community {x['community']}"] = n.get(x["community_name"] or f"community {x['community']}", 0) + 1
    last = max(shown, default=0)
    regions = [{"name": max(sorted(shown[i]), key=lambda k: shown[i][k])[:26]} if i in shown and not (i == last and i == 7) else {"name": "everything else"} for i in range(last + 1)]
    pairs = graph.file_pairs(epoch.edges(), nodes)
    edges = [[at[a], at[b]] for a, b in mapview.capped_edges(pairs).collect() if a in at and b in at]
    degree: dict[int, int] = {}
    for e in edges:
        for i in e:
            degree[i] = degree.get(i, 0) + 1
    key = sorted(range(len(rows)), key=lambda i: (-rows[i]["hotspot"], -degree.get(i, 0), i))[: mapview.KEY_FILES]
    return {"regions": regions, "files": [{"p": x["path"], "r": x["region"], "h": round(x["hotspot"], 2)} for x in rows], "edges": edges, "key": key}


def page(data: dict, title: str, template: str = PAGE) -> str:
    """One page with all it needs; no text of the data can end its script or open a tag."""
    first, rest = template.split("{title}")
    middle, last = rest.split("{data}")
    return first + html.escape(title) + middle + json.dumps(data).replace("<", "\\u003c") + last


def write(epoch: Epoch, path: str | Path, title: str = "map") -> None:
    """The map of files."""
    Path(path).write_text(page(payload(epoch), title), encoding="utf-8")


def write_symbols(epoch: Epoch, path: str | Path, title: str = "map") -> None:
    """The map of symbols."""
    Path(path).write_text(page(symbol_payload(epoch), title, SYMBOLS), encoding="utf-8")
