"""Refreshing a history reads what is new and gives what a whole reading gives."""

import os
import random
import subprocess

import pytest

from gneiss.operators.temporal import HistoryConfig
from gneiss.plans import history
from gneiss.plans.store import Epoch, Store
from gneiss.sources import history as source

AS_OF = 1_720_000_000.0
EASY = {"min_count": 1, "min_support": 0.0, "max_p": 1.0}


def git(root, *args, **env):
    return subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", *args], check=True, capture_output=True, env=os.environ | env).stdout.decode().strip()


def change(root, rng, i):
    for f in rng.sample(range(8), rng.randint(1, 4)):
        at = root / f"f{f}.py"
        at.write_text((at.read_text() if at.exists() else "") + f"{i}\n")
    git(root, "add", "-A")
    when = f"{1_700_000_000 + i * 3600} +0000"
    git(root, "-c", f"user.name=u{i % 3}", "commit", "-qm", f"c{i}", GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)


def layer(epoch):
    """Pairs, files and owners, rounded."""
    rows = []
    for t in ("cochange", "files", "ownership"):
        d = epoch.read(t)
        rows.append(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(sorted(d.columns)).collect()))
    return rows


def whole(spark, root, folder, config):
    epoch = Epoch(spark, folder)
    rows, n = source.commits(spark, root, config)
    history.enrich(epoch, rows, n, AS_OF, config)
    return layer(epoch)


def test_a_refresh_reads_new_commits_and_gives_the_whole_runs_rows(spark, tmp_path):
    root, rng, config = tmp_path / "r", random.Random(3), HistoryConfig(**EASY)
    root.mkdir()
    git(root, "init", "-q")
    for i in range(20):
        change(root, rng, i)
    git(root, "-c", "user.name=u", "commit", "-q", "--allow-empty", "-m", "nothing")
    store = Store(spark, tmp_path / "index")
    with store.begin() as e:
        assert history.mined(e, root, config) == {"read": 21, "gone": 0, "whole": True}
    for i in range(20, 30):
        change(root, rng, i)
    with store.begin() as e:
        before = e.tables[history.COMMITS]
        out = history.refresh(e, root, AS_OF, config)
        assert (out["read"], out["gone"], out["whole"], out["commits"]) == (10, 0, False, 31)
        # what was there is named, not copied, and the new part holds the ten commits alone
        assert e.tables[history.COMMITS][:1] == before and spark.read.parquet(f"{e.files.root}/{e.tables[history.COMMITS][1]}").select("sha").distinct().count() == 10
    assert layer(store.open()) == whole(spark, root, tmp_path / "w", config)
    cut = HistoryConfig(**EASY, before_ts=1_700_000_000 + 12 * 3600)
    with store.aside() as e:
        assert history.refresh(e, root, AS_OF, cut) | {"pairs": 0, "files": 0} == {"commits": 12, "pairs": 0, "files": 0, "read": 0, "gone": 0, "whole": False}
        got = layer(e)[0], layer(e)[2]
    want = whole(spark, root, tmp_path / "c", cut)
    assert got == (want[0], want[2])


def test_a_window_moves_and_a_rewritten_history_is_read_again(spark, tmp_path):
    root, rng, config = tmp_path / "r", random.Random(4), HistoryConfig(**EASY, max_commits=12)
    root.mkdir()
    git(root, "init", "-q")
    for i in range(12):
        change(root, rng, i)
    epoch = Epoch(spark, tmp_path / "e")
    assert history.mined(epoch, root, config)["whole"]
    for i in range(12, 17):
        change(root, rng, i)
    out = history.refresh(epoch, root, AS_OF, config)
    assert (out["read"], out["gone"], out["whole"], out["commits"]) == (5, 5, False, 12)
    want = whole(spark, root, tmp_path / "w", config)
    assert layer(epoch)[0] == want[0] and layer(epoch)[2] == want[2]
    assert history.mined(epoch, root, config) == {"read": 0, "gone": 0, "whole": False}
    git(root, "reset", "-q", "--hard", "HEAD~3")
    change(root, rng, 40)
    assert history.mined(epoch, root, config) == {"read": 12, "gone": 0, "whole": True}
    assert history.mined(epoch, root, HistoryConfig(**EASY))["whole"]


def test_a_range_is_no_option(spark, tmp_path):
    git(tmp_path, "init", "-q")
    with pytest.raises(Exception, match="not a range"):
        source.log_of(spark, tmp_path, revisions="--output=x")
