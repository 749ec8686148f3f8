"""Fusion, mapping, groups and runs: dirty cases with defined results, and brute force where SQL can't say it."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clipweave.llm import canonical, fusion, groups, runs

CARDS = "id string, card_id bigint, source string, updated_at timestamp, clothes string, description string, signature string, value string, field int"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_best_cards(spark):
    rows = [
        ("a", 1, "local", T2, "red coat", "N/A", None, "x", 1),
        ("a", 2, "gemini", T1, "blue coat", "tall", " ", "x", 1),
        ("a", 3, "gemini", T1, "green coat", "???", "unknown", "x", 1),
        ("a", 3, "gemini", T1, "green coat", "???", "unknown", "x", 1),  # the same card again
        ("a", 4, "user", T1, "see prior card", None, "-", "x", 1),
        ("b", 5, "user", T1, "alone", "alone", "alone", "x", 1),  # one card only
        ("b", 5, "user", T1, "alone", "alone", "alone", "x", 1),
        ("c", 6, None, None, "hat", None, None, "x", 1),
        ("c", 7, None, T1, "cap", None, None, "x", 1),
        ("c", 8, "other", T1, "x" * 100_000, None, None, "x", 1),
        (None, 9, "user", T1, "x", "x", "x", "x", 1),
        ("d", 10, "user", T1, None, None, None, "x", 1),
        ("d", 11, "user", T1, "", "", "", "x", 1),
    ]
    found = fusion.by_order(spark.createDataFrame(rows, CARDS))
    _, model = fusion.fuse(spark.createDataFrame(rows, CARDS))
    assert {(r["id"], r["field"], r["card_id"]) for r in found.collect()} == {("a", "clothes", 3), ("a", "description", 2), ("c", "clothes", 8)}
    assert set(model.accuracy) == {"user", "gemini", "local", "other"}
    wide = {r["id"]: r for r in fusion.best_cards(spark.createDataFrame(rows, CARDS)).collect()}
    assert wide["a"]["clothes"] == "green coat" and wide["a"]["description_card"] == 2 and wide["a"]["signature"] is None


def test_no_cards(spark):
    found, _ = fusion.fuse(spark.createDataFrame([], CARDS))
    assert found.count() == 0 and fusion.by_order(spark.createDataFrame([], CARDS)).count() == 0


def test_votes_recover_planted_values_better_than_a_majority(spark):
    """Two sources are right eight times in ten on their own; one is right half of the time, and two copy it, errors included."""
    random.seed(5)
    said = lambda right, p: right if random.random() < p else f"{right} x{random.randint(1, 20)}"
    rows, truth, majority = [], {}, 0
    for i in range(3000):
        truth[f"r{i}"] = right = f"value {i % 40}"
        weak = said(right, 0.5)
        told = {"c": weak, "a": said(right, 0.8), "d": weak if random.random() < 0.9 else said(right, 0.5), "b": said(right, 0.8), None: weak if random.random() < 0.9 else said(right, 0.5)}
        rows += [(f"r{i}", 10 * i + k, s, T1, v, None, None, "", 0) for k, (s, v) in enumerate(told.items())]
        majority += max(told.values(), key=list(told.values()).count) == right
    found, model = fusion.fuse(spark.createDataFrame(rows, CARDS), trust=("c", "a", "d", "b"))
    voted = sum(r["value"] == truth[r["id"]] for r in found.where("field = 'clothes'").collect())
    assert voted > 0.8 * 3000 > majority + 300
    assert min(model.accuracy[x] for x in "ab") > 0.75 > 0.65 > max(model.accuracy[x] for x in ("c", "d", "other"))
    copies, own = ("c", "d", "other"), ("a", "b")
    assert max(model.dependence[x, y] for x in copies for y in copies if x != y) > 0.7
    assert max(v for (x, y), v in model.dependence.items() if x in own or y in own) < 0.1


def test_votes_beat_trust_without_the_ordered_prior(spark):
    """Two sources that agree outvote a third of equal accuracy; a copier's vote is discounted."""
    random.seed(1)
    rows = []
    for i in range(400):
        truth = f"value {i}"
        user = truth if random.random() < 0.6 else f"wrong {i} {random.randrange(9)}"
        gemini = truth if random.random() < 0.9 else f"wrong {i} {random.randrange(9)}"
        local = truth if random.random() < 0.9 else f"wrong {i} {random.randrange(9)}"
        rows += [(str(i), 3 * i, "user", T1, user, None, None, None, 0), (str(i), 3 * i + 1, "gemini", T1, gemini, None, None, None, 0), (str(i), 3 * i + 2, "local", T1, local, None, None, None, 0)]
    found, model = fusion.fuse(spark.createDataFrame(rows, CARDS), rounds=4)
    right = sum(r["value"] == f"value {r['id']}" for r in found.collect())
    assert right > 370 and model.accuracy["gemini"] > model.accuracy["user"]
    copied = [(r[0], r[1], r[2], r[3], rows[i - 1][4] if r[2] == "gemini" else r[4], *r[5:]) for i, r in enumerate(rows)]
    _, model = fusion.fuse(spark.createDataFrame(copied, CARDS), rounds=4)
    assert max(model.dependence[("user", "gemini")], model.dependence[("gemini", "user")]) > 0.7


REF = [("event_type", "door_knock", n) for n in ("door_knock", "Door knock", "front step visit")]
REF += [("event_type", "cart_collision", n) for n in ("cart_collision", "Cart collision")]
REF += [("vehicle_color", "gray", n) for n in ("gray", "gunmetal")] + [("vehicle_color", "teal", "teal"), ("vehicle_color", "yellow", "yellow")]


def reference(spark):
    return spark.createDataFrame(REF, "kind string, entry string, name string")


MEANINGS = [
    ("event_type", "DOOR-KNOCK", "door_knock"), ("event_type", "knock / door", "door_knock"), ("event_type", "Dooor_nkock", "door_knock"), ("event_type", "ｄｏｏｒ ｋｎｏｃｋ", "door_knock"),
    ("event_type", "döör kñöçk", "door_knock"), ("event_type", "d00r kn0ck", "door_knock"), ("event_type", "poss. front step visit!", "door_knock"), ("event_type", "#doorknock", "door_knock"),
    ("event_type", "door repaint", "unmatched"), ("event_type", "Car collision", "cart_collision"), ("event_type", "", "unmatched"), ("event_type", "???", "unmatched"), ("event_type", "x" * 5000, "unmatched"),
    ("vehicle_color", "slvr", "unmatched"), ("vehicle_color", "gry", "gray"), ("vehicle_color", "yel", "yellow"), ("vehicle_color", "gnmetal metallic", "gray"), ("vehicle_color", "gray/gray", "gray"),
    ("vehicle_color", "door_knock", "unmatched"), ("vehicle_color", "tl", "teal"),
]


def test_meaning_of_values(spark):
    got = canonical.map_values(spark.createDataFrame([(k, v, 1) for k, v, _ in MEANINGS], "kind string, value string, entry int"), reference(spark))
    assert {tuple(r) for r in got.collect()} == set(MEANINGS)


def test_pigeonhole_join_finds_what_levenshtein_finds(spark):
    random.seed(5)
    values = set()
    for _, _, name in REF[:5]:
        for _ in range(12):
            w = list(name.replace("_", " ").lower())
            for _ in range(random.randint(1, 5)):
                i = random.randrange(len(w))
                w[i : i + random.randint(0, 1)] = random.choice("abcdefghkors")
            values.add("".join(w))
    df = spark.createDataFrame([("event_type", v) for v in values], "kind string, value string")
    got = {r["value"]: r["canonical"] for r in canonical.map_values(df, reference(spark), {}).collect()}
    pairs = df.withColumn("letters", F.regexp_replace("value", "[^a-z]", "")).crossJoin(spark.createDataFrame([(e, n.lower().replace("_", "").replace(" ", "")) for k, e, n in REF[:5]], "entry string, name string").distinct())
    near = pairs.withColumn("d", F.levenshtein("letters", "name")).groupBy("value").agg(F.min("d").alias("d")).collect()
    for r in near:
        assert (got[r["value"]] != "unmatched") == (r["d"] <= 3), r


def test_records_that_are_entries_already_have_no_row(spark):
    rows = [("event_type", "1", "door_knock"), ("event_type", "2", "Door Knock"), ("event_type", "2", "Door Knock"), ("event_type", "3", None), ("event_type", None, "x"), ("vehicle_color", "4", "Gray")]
    got = canonical.map_records(spark.createDataFrame(rows, "kind string, record_id string, value string"), reference(spark))
    assert {tuple(r) for r in got.collect()} == {("event_type", "2", "door_knock"), ("vehicle_color", "4", "gray")}
    assert [tuple(r) for r in canonical.unmatched_report(got).orderBy("kind").collect()] == [("event_type", 1, 0), ("vehicle_color", 1, 0)]
    assert canonical.map_records(spark.createDataFrame([], "kind string, record_id string, value string"), reference(spark)).count() == 0


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("core", [10_000, 60])
def test_groups_equal_union_find(spark, core):
    random.seed(2)
    links = [(i, i + 1) for i in range(150)] + [(1000, 1001 + i) for i in range(80)] + [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)]
    links += [(random.randint(3000, 3030), random.randint(3000, 3030)) for _ in range(120)] + [(5, 5), (None, 3), (1, 0), (0, 1)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {}
    rows = groups.group_labels(df, core).collect()
    for r in rows:
        got.setdefault(r["root"], []).append(r["v"])
    assert sorted(map(sorted, got.values())) == components(links) and len(rows) == len({r["v"] for r in rows})


def test_stars_alone(spark):
    random.seed(3)
    links = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(50)]
    got = {}
    for r in groups._stars(spark.createDataFrame(links, "a bigint, b bigint").where("a <> b")).distinct().collect():
        got.setdefault(r["root"], []).append(r["v"])
    assert sorted(map(sorted, got.values())) == components(links)


def test_names_of_events(spark):
    e = "id string, video_id string, continues_from string, group_id int"
    events = [("v:c:X:1", "v", None, 0), ("v:c:X:2", "v", " C:x:1 ", 0), ("v:c:X:2", "v", " C:x:1 ", 0), ("v:c:X:3", "v", "V:C:X:2", 0), ("w:c:X:1", "w", "c:x:9", 0), ("w:c:X:2", "w", "", 0), ("w:c:X:3", "w", "w:c:x:3", 0), (None, "w", "w:c:x:3", 0), ("w:c:X:4", None, "w:c:X:2", 0)]
    links = [("W:C:X:1", "w:c:x:2 ", None, None), (None, "w:c:x:1", None, None), ("nothing", "w:c:x:1", None, None), ("w:c:x:2", "w:c:x:1", None, None)]
    got = groups.linked_events(spark.createDataFrame(events, e), spark.createDataFrame(links, "src_id string, dst_id string, correction_note string, corrected_at timestamp"))
    assert {tuple(r) for r in got.collect()} == {("v:c:X:1", "v:c:X:1"), ("v:c:X:2", "v:c:X:1"), ("v:c:X:3", "v:c:X:1"), ("w:c:X:1", "w:c:X:1"), ("w:c:X:2", "w:c:X:1"), ("w:c:X:4", "w:c:X:1")}


def test_no_links(spark):
    events = spark.createDataFrame([("a", "v", None)], "id string, video_id string, continues_from string")
    assert groups.linked_events(events, spark.createDataFrame([], "src_id string, dst_id string")).count() == 0
    assert groups.linked_events(events.limit(0), spark.createDataFrame([], "src_id string, dst_id string")).count() == 0


RUN = "video_id string, id string, ms bigint, to_ms bigint, what bigint, says string, chunk int, n int"


def test_runs_against_a_loop(spark):
    random.seed(4)
    rows, ms = [], 0
    for i in range(600):
        ms += random.choice([0, 1000, 29_999, 30_000, 30_001, 900_000])
        before = rows[-1][1] if rows else None
        rows.append(("v", f"v:e{i:04d}", ms, ms + 10, random.choice([1, 1, 1, 2, None]), random.choice([None, before, before and before[2:].upper() + " ", "x"]), 0, 0))
    df = spark.createDataFrame(rows + rows[10:20], RUN)
    want, run = [], [rows[0]]
    for a, b in zip(rows, rows[1:], strict=False):
        said = (b[5] or "").strip().lower()
        if a[4] and a[4] == b[4] and (b[2] - a[2] <= 30_000 or said in (a[1], a[1][2:])):
            run.append(b)
        else:
            want.append(("v", run[0][1], run[-1][1], len(run)))
            run = [b]
    want.append(("v", run[0][1], run[-1][1], len(run)))
    got = [tuple(r) for r in runs.collapse_runs(df).select("video_id", "first_id", "last_id", "n").collect()]
    assert sorted(got) == sorted(want)
    few = runs.collapse_runs(df, singles=False).where("n > 1").select("video_id", "first_id", "last_id", "n").collect()
    assert sorted(map(tuple, few)) == sorted(w for w in want if w[3] > 1)


def test_events_without_a_place_are_left_out(spark):
    rows = [("v", "a", None, None, 1, None, 0, 0), (None, "b", 1, None, 1, None, 0, 0), ("v", None, 1, None, 1, None, 0, 0), ("v", "c", 5, None, 1, "", 0, 0), ("v", "d", 5, None, 1, None, 0, 0)]
    got = runs.collapse_runs(spark.createDataFrame(rows, RUN)).collect()
    assert [(r["first_id"], r["last_id"], r["n"]) for r in got] == [("c", "d", 2)]
    assert runs.collapse_runs(spark.createDataFrame([], RUN)).count() == 0


def test_every_size_is_reduced_first(spark, monkeypatch):
    took = []
    real = groups._removable
    monkeypatch.setattr(groups, "_removable", lambda links, turn: took.append(turn) or real(links, turn))
    links = [(i, i + 1) for i in range(40)]
    rows = groups.group_labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(took) >= 3 and len({r["root"] for r in rows}) == 1 and len(rows) == 41


def test_a_hub_is_joined_in_place(spark, monkeypatch):
    from clipweave import session

    monkeypatch.setattr(session, "HOT_ROWS", 20)
    links = [(0, i) for i in range(1, 300)] + [(300, 301)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    for rows in (groups.group_labels(df).collect(), groups._stars(df).distinct().collect()):
        got = {}
        for r in rows:
            got.setdefault(r["root"], []).append(r["v"])
        assert sorted(map(sorted, got.values())) == [list(range(300)), [300, 301]]
