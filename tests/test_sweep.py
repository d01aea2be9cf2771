"""Levels of overlapping spans against a plain count at every moment."""

from __future__ import annotations

import random

from heapstone.operators import sweep


def test_levels_as_a_count_at_every_moment(spark):
    rng = random.Random(8)
    spans = [(g, a, s, s + rng.choice([0, 1, 5, 20])) for g in "xy" for a in "abcd" for s in rng.sample(range(120), 9)] + [("x", "a", 9, 3)]
    found = sweep.levels(spark.createDataFrame(spans, "g string, a string, s long, e long"), ["g"], "a", "s", "e").collect()
    for g in "xy":
        mine = [r for r in found if r["g"] == g]
        assert all(r["s"] < r["e"] for r in mine)
        for moment in range(150):
            at = moment + 0.5
            want = len({a for h, a, s, e in spans if h == g and s <= at <= e})
            assert sum(r["n"] for r in mine if r["s"] <= at <= r["e"]) == want
        ordered = sorted((r["s"], r["e"], r["n"]) for r in mine)
        assert all(a[1] < b[0] or a[2] != b[2] for a, b in zip(ordered, ordered[1:], strict=False))
        told = next(r for r in sweep.summary(spark.createDataFrame(mine, "g string, s long, e long, n long"), ["g"], "s", "e").collect())
        top = max(n for *_, n in ordered)
        assert (told["first"], told["last"], told["most"], told["most_from"]) == (ordered[0][0], max(e for _, e, _ in ordered), top, min(s for s, _, n in ordered if n == top))
        assert told["covered"] == sum(e - s for s, e, _ in ordered)


def test_no_spans(spark):
    assert sweep.levels(spark.createDataFrame([], "g string, a string, s long, e long"), ["g"], "a", "s", "e").count() == 0
