import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipweave.operators import intervals
from clipweave.operators.intervals import dyadic_union, merge_intervals
from clipweave.operators.presence import presence


def plain(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 200)), min_size=1, max_size=30))
def test_dyadic_union_is_the_union(pairs):
    pairs = [(s, min(s + n, 1024)) for s, n in pairs]
    s, e = dyadic_union(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), 10)
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == plain(pairs)


@pytest.mark.parametrize("span", [4096, 3, 0])
def test_merge_over_many_chunks(spark, monkeypatch, span):
    """``span``: top blocks from which an interval's middle goes by higher blocks."""
    monkeypatch.setattr(intervals, "SPAN_BLOCKS", span)
    rng = np.random.default_rng(3)
    rows = [("v", f"p{i % 3}", int(s), int(s + n), int(i)) for i, (s, n) in enumerate(zip(rng.integers(0, 4000, 120), rng.integers(1, 90, 120), strict=True))]
    rows += [("v", "p0", 500, 1700, 900), ("v", "p0", 1690, 1691, 904), ("v", "p1", 640, 1344, 901), ("v", "p1", 1344, 2000, 902), ("v", "p2", -700, 5, 903), rows[0]]
    df = spark.createDataFrame(rows, "k0 string, k1 string, s bigint, e bigint, event bigint")
    got = merge_intervals(df, levels=6).collect()
    for p in ("p0", "p1", "p2"):
        mine = [(r[2], r[3], r[4]) for r in rows if r[1] == p]
        want = plain([(s, e) for s, e, _ in mine])
        assert sorted((r["s"], r["e"]) for r in got if r["k1"] == p and r["kind"] == "period") == want
        assert sorted((r["s"], r["e"]) for r in got if r["k1"] == p and r["kind"] == "gap") == [(a[1], b[0]) for a, b in zip(want, want[1:], strict=False)]
        for r in got:
            if r["k1"] == p and r["kind"] == "period":
                assert r["events_many"] == (len({i for s, e, i in mine if r["s"] <= s < r["e"]}) > 1)


EVENTS = "id string, video_id string, people_ids array<string>, start_ms bigint, end_ms bigint, start_timestamp string, end_timestamp string, k0 int, chunk int"


def test_presence_reads_dirty_events(spark):
    rows = [
        ("a", "v", ["x", None, "x"], 0, 10, None, None, 1, 1),
        ("a", "v", ["x", None, "x"], 0, 10, None, None, 1, 1),  # the same record again
        ("b", "v", ["x"], 10, 20, None, None, 1, 1),  # touches
        ("c", "v", ["x"], None, None, "00:01", "at 00:02", 1, 1),  # clocks only
        ("d", "v", ["x"], 9000, 8000, None, None, 1, 1),  # ends before it starts
        ("e", "v", ["x"], None, 5, "mid clip", None, 1, 1),  # no start
        ("f", "v", None, 0, 10, None, None, 1, 1),
        ("g", "v", [], 0, 10, None, None, 1, 1),
        ("h", None, ["x"], 0, 10, None, None, 1, 1),
    ]
    got = {tuple(r) for r in presence(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {("v", "x", "merged", 0, 20), ("v", "x", "gap", 20, 1000)}


def test_presence_of_nothing(spark):
    assert presence(spark.createDataFrame([], EVENTS)).count() == 0


def test_an_absurdly_long_interval(spark):
    rows = [("v", "p", 5, 10**17, 1), ("v", "p", 10**17, 10**17 + 5, 2), ("v", "q", 1, 2, 3), ("v", "q", 4, 6, 4)]
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, "k0 string, k1 string, s bigint, e bigint, event bigint")).collect()}
    assert got == {("v", "p", "period", 5, 10**17 + 5, True), ("v", "q", "period", 1, 2, False), ("v", "q", "period", 4, 6, False), ("v", "q", "gap", 2, 4, None)}


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**40), 2**40), st.integers(1, 2**40))
def test_higher_blocks_are_the_range(first, n):
    _, level, block = intervals._higher_blocks(np.array([first]), np.array([first + n]))
    spans = sorted((int(b) << int(up), (int(b) + 1) << int(up)) for up, b in zip(level, block, strict=True))
    assert spans[0][0] == first and spans[-1][1] == first + n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(spans) <= 2 * 42


def test_one_long_interval_changes_nothing_for_others(spark):
    rows = [("v", f"p{i % 4}", i * 1000, i * 1000 + 400, i) for i in range(400)]
    schema = "k0 string, k1 string, s bigint, e bigint, event bigint"
    plain_rows = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, schema)).collect()}
    long_rows = {tuple(r) for r in merge_intervals(spark.createDataFrame([*rows, ("v", "x", 0, 2**61, 999), ("v", "p0", 90_000, 2**60, 1000)], schema)).collect()}
    assert {r for r in long_rows if r[1] in ("p1", "p2", "p3")} == {r for r in plain_rows if r[1] != "p0"}
    mine = sorted(r for r in long_rows if r[1] == "p0" and r[2] == "period")
    assert mine[-1][3:] == (88_000, 88_400, False) or mine[-1][4] == 2**60
    assert ("v", "p0", "period", 90_000, 2**60, True) in long_rows and not [r for r in long_rows if r[1] == "p0" and r[3] > 90_000]


def test_hot_keys_are_joined_in_place(spark, monkeypatch):
    from clipweave import session

    left = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 1), ("c", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", "A"), ("b", "B"), ("z", "Z")], "k string, y string")
    want = {how: sorted(map(str, left.join(right, ["k"], how).collect())) for how in ("inner", "left")}
    for rows in (10, 10_000):
        monkeypatch.setattr(session, "HOT_ROWS", rows)
        for how, rows_ in want.items():
            assert sorted(map(str, session.join_unique(left, right, ["k"], how).collect())) == rows_
