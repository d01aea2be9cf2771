"""Registered queries over small tables of our own: whole inputs, results by hand."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from hashlib import md5

import pytest

from heapstone.operators import context
from heapstone.plans import joins, parsed, texts, timelines
from heapstone.plans.base import SQL


def stored(spark, tmp_path, **tables):
    """A data folder with the given tables: name = (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_cogroup_takes_every_id(spark, tmp_path):
    orders = [(i, float(i)) for i in range(1, 13)]
    lines = [(i, float(k)) for i in range(1, 13) for k in (1, 2)]
    path = stored(spark, tmp_path, orders=(orders, "o_orderkey long, o_totalprice double"), lineitem=(lines, "l_orderkey long, l_extendedprice double"))
    got = {(r["id"], r["kind"]): (r["n"], r["c"]) for r in joins.cogroup_by_id(spark, path).collect()}
    assert got == {(i, "order"): (1, 100 * i) for i in range(1, 13)} | {(i, "line"): (2, 300) for i in range(1, 13)}


def test_paging_gives_every_page(spark, tmp_path):
    long = "".join(chr(97 + k % 26) for k in range(8400)) + "\U0001f642\nend"
    rows = [(1, long), (2, "x" * 4200), (3, ""), (4, None)]
    path = stored(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = sorted(tuple(r) for r in texts.text_paging(spark, path).collect())
    digest = lambda t: md5(t.encode()).hexdigest()
    assert got == sorted(
        [(1, digest(long[k : k + 4200]), k + 1, min(k + 4200, 8405), 8405, k < 8400) for k in (0, 4200, 8400)] + [(2, digest("x" * 4200), 1, 4200, 4200, False), (3, digest(""), 1, 0, 0, False)]
    )


def test_snippets_come_from_whole_texts_of_all_documents(spark, tmp_path):
    docs = {1: "one two three four five\nx one two three four five y\nthree\n\nseveral of three", 2: "a b\nza bz\n  a b  ", 4: "last  gap here\nblast  gap hereby\nlast gap here"}
    path = stored(spark, tmp_path, documents=([(i, t) for i, t in docs.items()] + [(5, None)], "doc_id long, text string"))
    want = {}
    for i, t in docs.items():
        lines = t.split("\n")
        for s in {t[:20].strip(" "), *(x.strip(" ") for x in lines)} - {""}:
            if any(s in x for x in lines):
                want[i, s] = [k + 1 for k, x in enumerate(lines) if s in x]
    got = {(r["doc_id"], r["snippet"]): r["line_numbers"] for r in texts.snippet_lines(spark, path).collect()}
    assert got == want and got[1, "three"] == [1, 2, 3, 5] and got[4, "last  gap here"] == [1, 2]


DOCUMENTS = [
    (1, "one two three four five\nx one two three four five y\nthree\n\nseveral of three"), (2, "a b\nza bz\n  a b  \n1 a b 0\n0 a b 1"), (3, "last  gap here\r\nblast  gap hereby\rlast gap here\n"), (4, None), (5, ""), (6, " \n "), (None, "none\nnone"),
    (7, "beta gamma delta\nalpha beta gamma delta"), (7, "alpha beta gamma delta\nx\n\nx"), (7, "x"), (8, "short\nbreak in the start"), (9, "\u00e4\u00f6 \U0001f642 \u00fc\n\u00f6 \U0001f642"), (10, "x" * 30 + "\n" + "x" * 20), (10, None),
]


@pytest.mark.parametrize("most", [context.AT_ONCE, 300, 0])
def test_snippets_of_long_texts_and_shared_ids_are_as_in_sql(spark, tmp_path, monkeypatch, most):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(context, "AT_ONCE", most)
    path = stored(spark, tmp_path, documents=(DOCUMENTS, "doc_id long, text string"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{path}/documents.parquet/*.parquet'")
    want = db.sql(SQL["snippet_lines"]).fetchall()
    got = [(r["doc_id"], r["snippet"], r["line_numbers"]) for r in texts.snippet_lines(spark, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and (7, "x", [1, 2, 4]) in got


def test_snippets_of_usual_texts_are_found_where_these_are_read(spark, tmp_path):
    path = stored(spark, tmp_path, documents=([(k, f"start {k}\nstart {k} again") for k in range(20)], "doc_id long, text string"))
    found = texts.snippet_lines(spark, path)
    assert not {"Join", "Aggregate", "Exchange"} & set(re.findall("Join|Aggregate|Exchange", found._jdf.queryExecution().toString()))
    assert {(r["doc_id"], r["snippet"]): r["line_numbers"] for r in found.collect()} == {(k, t): n for k in range(20) for t, n in ((f"start {k}", [1, 2]), (f"start {k} again", [2]))}


EVENT_COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1)


def event(event_id, user_id=1, hours=0.0, kind="error", value=50.0):
    return event_id, START + timedelta(hours=hours), user_id, kind, value, "{}"


def test_alignment_scores_threads_of_all_pools(spark, tmp_path):
    kinds, threads = ["error", "purchase", "view"], {}
    for user in range(40):
        threads[user] = {(kinds[k], 50.0 + j) for k in range(3) if (user * 7 // 3) >> k & 1 for j in range(2) if (user >> j) & 1 or not j}
    rows = [event(n, u, kind=kind, value=value) for n, (u, (kind, value)) in enumerate((u, x) for u in threads for x in sorted(threads[u]))]
    got = joins.signal_alignment_score(spark, stored(spark, tmp_path, events=(rows, EVENT_COLUMNS))).collect()
    of = {r["b_id"]: r["a_id"] for r in got if r["relation"] == "member"}
    scores = {(r["a_id"], r["b_id"]): r["score"] for r in got if r["relation"] == "pair"}
    assert len(scores) + len(of) == len(got) and set(of) == {u for u in threads if threads[u]}
    for x in of:
        for y in of:
            if x < y:
                k = len({kind for kind, _ in threads[x]} & {kind for kind, _ in threads[y]})
                l = len({round(v * 100) % 7 for _, v in threads[x]} & {round(v * 100) % 7 for _, v in threads[y]})  # noqa: E741
                assert scores.get(tuple(sorted((of[x], of[y])))) == (60 + min(12, 6 * k) + min(8, 4 * l) if k else None)


def test_clusters_keep_events_without_a_line(spark, tmp_path):
    rows = [event(1, hours=0), event(50, hours=1), event(500, hours=300), event(0, hours=300), event(None, hours=301), event(-3, hours=900), event(0, 2), event(None, 3)]
    path = stored(spark, tmp_path, events=(rows, EVENT_COLUMNS))
    got = sorted((r["user_id"], r["cluster"], r["n"], r["cents"]) for r in timelines.gap_clusters(spark, path).collect())
    assert got == [(1, 0, 2, 10000), (1, 1, 4, 20000), (2, 0, 1, 5000), (3, 0, 1, 5000)]
    best = sorted((r["user_id"], r["cluster"], r["n"], r["weight"]) for r in timelines.best_gap_cluster(spark, path).collect())
    assert best == [(1, 1, 4, 20000), (2, 0, 1, 5000), (3, 0, 1, 5000)]


def test_windows_reach_the_last_event(spark, tmp_path):
    rows = [event(k, hours=24 * day, value=0.01) for k, day in enumerate((0, 1, 5, 29, 50, 71))]
    got = sorted(tuple(r) for r in joins.interval_overlap_join(spark, stored(spark, tmp_path, events=(rows, EVENT_COLUMNS))).collect())
    assert got == [(0, 2, 2), (4, 1, 1), (7, 1, 1), (10, 1, 1)]


def test_pause_focus_gives_the_rows_of_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    tie = [event(1, 1, value=0.41), event(2, 1, kind="view", value=5.99)]  # 41 / 640 = 0.0640625
    short = [event(2 * k + 1, 2, value=v) for k, v in enumerate((0.0, 0.001, 3.0, 4.0, 5.0))]
    none = [event(1, 3, value=0.0), event(3, 3, kind="purchase", value=0.0)]
    path = stored(spark, tmp_path, events=(tie + short + none, EVENT_COLUMNS))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM '{path}/events.parquet/*.parquet'")
    got = sorted(map(str, (tuple(r) for r in parsed.gc_pause_focus(spark, path).collect())))
    assert got == sorted(map(str, db.sql(SQL["gc_pause_focus"]).fetchall())) and len(got) == 3
