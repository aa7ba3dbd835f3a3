import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.sources import commits, crawl, snapshots

POLICY = {"law.example": [r"/doc/\d+", "/start"]}
SITE = {
    "https://law.example/start": "".join(f'<a href="/doc/{i}">x</a>' for i in range(1, 8)) + '<a href="http://evil/">e</a>',
    **{f"https://law.example/doc/{i}": f'<a href="/doc/{10 + i}">x</a><a href="/start">s</a>' for i in range(1, 8)},
    **{f"https://law.example/doc/{10 + i}": "end" for i in range(1, 6)},
}


def fetcher(seen, fail_at=None):
    """A fetcher that notes each url in a folder, and breaks off at one."""

    def fetch(wave):
        def get(batches):
            for b in batches:
                for u in b["url"]:
                    if fail_at and u.endswith(fail_at):
                        raise RuntimeError("killed")
                    with open(f"{seen}/{time.time_ns()}-{u.rpartition('/')[2]}", "w") as f:
                        f.write(u)
                yield pd.DataFrame({"url": b["url"], "html": [SITE.get(u) for u in b["url"]], "code": [None if u in SITE else "HTTP_STATUS" for u in b["url"]]})

        return wave.coalesce(1).mapInPandas(get, "url string, html string, code string")

    return fetch


def noted(seen):
    return sorted(open(f"{seen}/{f}").read().rpartition("/")[2] for f in os.listdir(seen))


@pytest.fixture
def start(rows):
    return rows("url string", ("https://law.example/start",))


def result(tables):
    docs, failures = tables
    return {(r["url"], r["depth"]) for r in docs.collect()}, {tuple(r) for r in failures.collect()}


def test_a_killed_crawl_fetches_only_what_is_left(spark, start, tmp_path):
    seen, again, whole = (tmp_path / x for x in ("seen", "again", "whole"))
    for p in (seen, again, whole):
        p.mkdir()
    folder = f"file://{tmp_path}/crawl"
    args = (POLICY, [(".*", 50)])
    with pytest.raises(Exception, match="killed"):
        crawl.crawl(start, fetcher(seen, "/doc/12"), *args, folder=folder, batch=3)
    log = commits.CommitLog(spark, folder, crawl.LOG)
    before, _, left = crawl.inventory(log)
    committed = {r["url"].rpartition("/")[2] for r in before.collect()}
    assert not log.complete() and {"start", *map(str, range(1, 8))} <= committed and left.count() > 0
    got = result(crawl.crawl(start, fetcher(again), *args, folder=folder, batch=3))
    assert not committed & set(noted(again)) and log.complete()
    assert got == result(crawl.crawl(start, fetcher(whole), *args))
    assert len(noted(again)) + len(committed) == len(noted(whole))
    n = log.commits()
    assert result(crawl.crawl(start, fetcher(again, "start"), *args, folder=folder)) == got and log.commits() == n


def test_limits_leave_rows(spark, start, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    args = (start, fetcher(seen), POLICY, [(".*", 50)])
    docs, failures = result(crawl.crawl(*args, max_documents=3))
    assert len(docs) == 3 and (None, "DOCUMENT_LIMIT", 5) in failures
    docs, failures = result(crawl.crawl(*args, max_depth=1))
    assert len(docs) == 8 and (None, "DEPTH_LIMIT", 7) in failures
    docs, failures = result(crawl.crawl(*args, max_pages=4, batch=2))
    assert len(docs) > 4 and any(c == "PAGE_LIMIT" for _, c, _ in failures)
    assert ("http://evil/", "URL_POLICY", None) in failures


def test_a_part_without_its_mark_does_not_count(spark, rows, tmp_path):
    log = commits.CommitLog(spark, f"file://{tmp_path}/log", "a int, b string")
    assert log.read().count() == 0 and not log.complete()
    log.append(rows("a int, b string", (1, "x")))
    rows("a int, b string", (2, "lost")).write.parquet(f"file://{tmp_path}/log/parts/00000001")
    assert [r["a"] for r in log.read().collect()] == [1]
    log.append(rows("b string, a int", ("y", 3)))
    log.finish()
    log.finish()
    assert sorted(r["a"] for r in log.read().collect()) == [1, 3] and log.complete() and log.commits() == 2


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    files = tmp_path / "files"
    files.mkdir()
    for name, text in {"same": "s", "touched": "t", "resized": "r", "edited": "abc", "gone": "g"}.items():
        (files / f"{name}.txt").write_text(text)
    folder = f"file://{tmp_path}/looks"
    look = lambda: {os.path.basename(r["path"])[:-4]: r["state"] for r in snapshots.changes(spark, f"file://{files}/*.txt", folder).collect()}
    assert set(look().values()) == {"new"}
    assert set(look().values()) == {"same"}
    read, plain = [], snapshots.hashed
    monkeypatch.setattr(snapshots, "hashed", lambda s, f: (read.extend(os.path.basename(r["path"])[:-4] for r in f.collect()), plain(s, f))[1])
    later = time.time() + 100
    os.utime(files / "touched.txt", (later, later))
    (files / "resized.txt").write_text("longer")
    (files / "edited.txt").write_text("xyz")
    os.utime(files / "edited.txt", (later, later))
    (files / "gone.txt").unlink()
    (files / "added.txt").write_text("a")
    assert look() == {"same": "same", "touched": "touched", "resized": "changed", "edited": "changed", "gone": "gone", "added": "new"}
    assert sorted(read) == ["added", "edited", "resized", "touched"]
    monkeypatch.setattr(snapshots, "AT_ONCE", 1)
    (files / "gone.txt").write_text("back")
    assert look() == {"same": "same", "touched": "same", "resized": "same", "edited": "same", "gone": "new", "added": "same"}


def test_inventories_may_be_used_again(rows):
    docs = rows("id string, path string", ("a", "p"), ("b", "q"), ("c", "r"))
    changed = rows("path string, state string", ("p", "touched"), ("q", "changed"))
    state = lambda *x: {r["id"]: r["issue"] for r in snapshots.inventory_state(docs, changed, *x).collect()}
    assert state(2, True, 2, "h", "h") == {"a": None, "b": "changed", "c": "no file"}
    assert set(state(1, True, 2, "h", "h").values()) == {"version"} and set(state(2, True, 2, "g", "h").values()) == {"policy"}
    assert set(state(2, False, 2, "h", "h").values()) == {"incomplete"}
