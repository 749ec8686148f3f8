import pytest

from clipweave.plans import blocks, dml, fixed
from clipweave.plans.catalog import Catalog
from clipweave.plans.graph import FootageGraph, clip_chain
from clipweave.plans.tools import Footage


@pytest.fixture(scope="module")
def catalog():
    return Catalog(
        {
            "traffic_stop": {"title": "Traffic stop / pulled over", "aliases": ["pulled_over"], "topics": ["stops"], "transcript_any": ["Pull over", "pull over"]},
            "arrest": {"title": "Arrest", "aliases": ["taken into custody"]},
            "field_sobriety_test": {"title": "Field sobriety test", "aliases": ["sobriety"]},
        },
        {"dui": {"title": "DUI", "aliases": ["dui", "drunk driving"], "event_types": ["field_sobriety_test"]}, "stops": {"title": "Stops", "event_types": ["traffic_stop"]}},
    )


@pytest.fixture(scope="module")
def graph(spark, catalog):
    df = spark.createDataFrame
    t = catalog.tables(spark)
    clips = [(f"{v}:clip_{i:04d}", v, f"clip_{i:04d}", i, i * 170000, i * 170000 + 180000, "please pull over" if i == 1 else None) for v in ("v1", "v2") for i in range(5)]
    events = [(f"v1:clip_{i:04d}:traffic_stop:{i * 170000}", "v1", "v1.mp4", f"v1:clip_{i:04d}", "traffic_stop", i * 170000, i * 170.0) for i in (0, 1, 2, 4)]
    events += [("v2:clip_0000:arrest:60000", "v2", "v2.mp4", "v2:clip_0000", "arrest", 60000, 60.0), ("v2:clip_0001:field_sobriety_test:175000", "v2", "v2.mp4", "v2:clip_0001", "field_sobriety_test", 175000, 175.0)]
    people = [("v1:person_1", "v1", "person_1", "white shirt", "civilian", None, None), ("v1:person_2", "v1", "person_2", "POLICE vest", "officer", True, False), ("v2:person_1", "v2", "person_1", "red coat", "potential_suspect", False, True)]
    involves = [(events[0][0], "event", "v1:person_1", "person", "civilian"), (events[0][0], "event", "v1:person_2", "person", "officer"), (events[1][0], "event", "v1:person_1", "person", "potential_suspect"),
                (events[4][0], "event", "v2:person_1", "person", "potential_suspect"), (events[4][0], "event", "v2:vehicle_1", "vehicle", None), (events[0][0], "event", "v1:object_1", "object", None)]
    edge = "src_id string, src_kind string, dst_id string, dst_kind string, role string"
    clips_df = df(clips, "id string, video_id string, local_id string, index int, start_ms bigint, end_ms bigint, transcript string")
    first, following = clip_chain(clips_df)
    return FootageGraph.of(
        spark,
        {
            "video": df([("v1", "v1.mp4"), ("v2", "v2.mp4")], "id string, source_name string"),
            "clip": clips_df,
            "event": df(events, "id string, video_id string, source_name string, clip_id string, type string, start_ms bigint, seek_s double"),
            "person": df(people, "id string, video_id string, local_id string, clothes string, role string, is_cop boolean, potential_suspect boolean"),
            "vehicle": df([("v2:vehicle_1", "v2", "vehicle_1", "dark Grey", "ABC123"), ("v1:vehicle_1", "v1", "vehicle_1", "white", None)], "id string, video_id string, local_id string, color string, plate string"),
            "object": df([("v1:object_1", "v1", "object_1", "bottle"), ("v2:object_1", "v2", "object_1", "bag")], "id string, video_id string, local_id string, label string"),
            "plate": df([("v2:plate:ABC123", "ABC123", "v2", 0.9)], "id string, text string, video_id string, confidence double"),
            "event_type": t["event_type"],
            "topic": t["topic"],
        },
        {
            "involves": df(involves, edge),
            "contains": df([(e[3], "clip", e[0], "event", None) for e in events] + [("v1:clip_0000", "clip", "v1:object_1", "object", None)], edge),
            "instance_of": df([(e[0], "event", e[4], "event_type", None) for e in events], edge),
            "in_topic": t["in_topic"],
            "bundles": t["bundles"],
            "has_plate": df([("v2:vehicle_1", "vehicle", "v2:plate:ABC123", "plate", None)], edge),
            "continues": df([(events[0][0], "event", events[1][0], "event", None), (events[1][0], "event", events[2][0], "event", None)], edge),
            "has_person": df([(p[1], "video", p[0], "person", None) for p in people], edge),
            "has_vehicle": df([("v2", "video", "v2:vehicle_1", "vehicle", None), ("v1", "video", "v1:vehicle_1", "vehicle", None)], edge),
            "starts_at": first,
            "next": following,
        },
    )


@pytest.fixture
def footage(graph, catalog):
    return Footage(graph, catalog)


def ids(df, column="event_id"):
    return sorted(r[column] for r in df.collect())


STOP0, STOP1, STOP2 = (f"v1:clip_{i:04d}:traffic_stop:{i * 170000}" for i in range(3))


def test_filters(footage):
    n = lambda q: footage.run_blocks(f"{q} | count").first()["n"]
    assert n("events") == 6
    assert n("events | topic query='drunk driving'") == 1
    assert n("events | event_type arrest") == 1
    assert n("events | video v2") == 2
    assert n("events | timeframe start=01:00 end=180") == 3
    assert n("events | at_time 02:50") == 2
    assert n("people | role officer") == 1
    assert n("people | potential_suspect") == 1
    assert n("people | is_cop") == 1
    assert n("people | clothes police") == 1
    assert n("people | person_id person_1") == 2
    assert n("vehicles | vehicle_color GREY") == 1
    assert n("vehicles | plate abc") == 1
    assert n("plates | plate bc1") == 1
    assert n("plates | video v1") == 0
    assert n("objects | object_label BOT") == 1
    assert n("clips | transcript 'PULL OVER'") == 2
    assert n("videos") == 2


def test_joins(footage):
    n = lambda q: footage.run_blocks(f"{q} | count").first()["n"]
    assert n("events | with_people") == 7
    assert n("events | with_people | with_people") == 7
    assert n("events | with_people | role officer") == 1
    assert n("events | with_clip") == 6
    assert n("events | with_vehicles") == 6
    assert n("events | with_objects | object_label bottle") == 1
    assert n("events | with_topic") == 6
    assert n("people | with_events") == 4
    assert n("events | involving_person person_1") == 3
    assert n("events | involving_object bottle") == 1
    assert n("events | continues") == 6


def test_outputs(footage):
    rows = {r["event_id"]: r for r in footage.run_blocks("events | with_clip | with_people | with_topic | continues").collect()}
    first = rows[STOP0]
    assert {(p["id"], p["role"]) for p in first["people"]} == {("person_1", "civilian"), ("person_2", "officer")}
    assert (first["clip"], first["topics"], first["continues_to"], first["start_timestamp"]) == ("clip_0000", ["stops"], ["02:50"], "00:00")
    lonely = rows["v2:clip_0001:field_sobriety_test:175000"]
    assert [p["id"] for p in lonely["people"]] == [None] and lonely["topics"] == ["dui"]
    assert [r["people"] for r in footage.run_blocks("videos").collect()] == [2, 1]
    assert footage.run_blocks("plates").first()["vehicle_color"] == "dark Grey"
    assert [r["n"] for r in footage.run_blocks("events | count_by_type").collect()] == [4, 1, 1]
    assert [len(r["events"]) for r in footage.run_blocks("people | with_events").collect()] == [2, 1, 1]
    assert footage.run_blocks("objects | with_events").count() == 2
    assert footage.run_blocks("vehicles").count() == 2
    assert footage.run_blocks("clips").columns[:2] == ["video_id", "clip"]


@pytest.mark.parametrize("bad", ["nonsense", "events | people", "count", "events | role officer", "people | return_events", "events | timeframe", "events | at_time x", "events | topic zzz", "", "people | person_id", "events | video a b", "[1", "events | with_events"])
def test_pipeline_errors(footage, bad):
    with pytest.raises(blocks.PipelineError):
        footage.run_blocks(bad)


def test_parsing_round_trip():
    steps = blocks.parse_pipeline("events | topic dui | video video_id='a b' | with_people")
    assert steps == [{"block": "events"}, {"block": "topic", "query": "dui"}, {"block": "video", "video_id": "a b"}, {"block": "with_people"}]
    assert blocks.parse_pipeline(blocks.render(steps)) == steps
    assert blocks.parse_pipeline('{"blocks": [{"block": "events"}]}') == [{"block": "events"}]
    assert blocks.parse_pipeline({"recipe": "count_events"}) == blocks.RECIPES["count_events"]


@pytest.mark.parametrize("name", sorted(blocks.RECIPES))
def test_recipes(footage, name):
    params = {"events_in_timeframe": {"start": "00:00", "end": "05:00"}, "person_timeline": {"person_id": "person_1"}}.get(name, {})
    if name == "all_miranda":
        with pytest.raises(blocks.PipelineError):
            footage.run_recipe(name)
    else:
        assert footage.run_recipe(name, **params).count() > 0


def test_recipe_parameters():
    steps = blocks.recipe_steps("all_dui", video_id="v1")
    assert steps[-2:] == [{"block": "video", "video_id": "v1"}, {"block": "return_events"}]
    with pytest.raises(blocks.PipelineError):
        blocks.recipe_steps("all_dui", clothes="x")
    with pytest.raises(blocks.PipelineError):
        blocks.recipe_steps("no_such")


def test_fixed_questions(footage, graph):
    assert ids(footage.events_in_timeframe("00:00", "03:00")) == [STOP0, STOP1, "v2:clip_0000:arrest:60000", "v2:clip_0001:field_sobriety_test:175000"]
    assert footage.event_at_time("01:00").first()["event_id"] == "v2:clip_0000:arrest:60000"
    resolved, found = footage.find_events("find all drunk driving")
    assert resolved["event_types"] == ["field_sobriety_test"] and found.count() == 1
    assert ids(fixed.person_timeline(graph, "person_1")) == [STOP0, STOP1, "v2:clip_0000:arrest:60000"]
    assert [tuple(r) for r in fixed.event_chain(graph).select("start_id", "end_id", "hops").collect()] == [(STOP0, STOP1, 1), (STOP0, STOP2, 2), (STOP1, STOP2, 1)]
    suspects = fixed.find_potential_suspects(graph).collect()
    assert [(r["id"], len(r["events"])) for r in suspects] == [("v2:person_1", 1)]
    assert fixed.find_vehicles(graph, color="grey").first()["plates"] == ["ABC123"]
    assert fixed.find_plates(graph, "abc").first()["vehicle_id"] == "v2:vehicle_1"
    assert fixed.object_appearances(graph, "bottle").first()["clips"] == ["clip_0000"]
    assert [r["clip"] for r in fixed.clip_at_timestamp(graph, "02:55", "v1").collect()] == ["clip_0000", "clip_0001"]
    assert fixed.clip_attachments(graph, "v1", "clip_0001").count() == 1
    assert {r["label"]: r["n"] for r in fixed.inventory(graph).collect()}["event"] == 6
    assert graph.duplicate_ids().count() == 0
    got = fixed.event_participants(graph.with_node("event", graph.node("event").withColumn("start_timestamp", __import__("pyspark").sql.functions.lit("00:00"))), "field_sobriety_test", "00:00").collect()
    assert [(r["kind"], r["name"]) for r in got] == [(None, None)]


def test_chain_survives_a_circle(spark):
    from clipweave.operators.windows import event_chains

    got = event_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "src_id string, dst_id string"))
    assert {tuple(r) for r in got.collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}


def test_sql_guard(footage):
    assert footage.sql("select count(*) as n from event where 'drop table x; set y' <> type").first()["n"] == 6
    assert footage.sql("select * from event where type = :t", {"t": "arrest"}).count() == 1
    for bad in ("drop table event", "create table x as select 1", "select 1; select 2", "set a=b", "insert into event select * from event"):
        with pytest.raises(blocks.PipelineError):
            footage.sql(bad)


NOTE, AT = "the user asked for this", "2024-01-01T00:00:00Z"


def test_preview_writes_nothing_and_update_is_audited(footage):
    before = footage.graph
    done = footage.correct("update", kind="event", node_id=STOP0, patch={"type": "Arrest", "start_timestamp": "1:30"}, request=NOTE, at=AT)
    assert done.graph is None and footage.graph is before
    footage.correct("update", kind="event", node_id=STOP0, patch={"type": "Arrest", "start_timestamp": "1:30"}, request=NOTE, at=AT, confirmed=True)
    row = footage.graph.node("event").where(f"id = '{STOP0}'").first()
    assert (row["type"], row["seek_s"], row["start_timestamp"], row["correction_note"], row["corrected_at"]) == ("arrest", 90.0, "01:30", NOTE, AT)
    assert [r["dst_id"] for r in footage.graph.edge("instance_of").where(f"src_id = '{STOP0}'").collect()] == ["arrest"]
    assert footage.graph.edge("has_type").where("dst_id = 'arrest'").count() == 1


def test_refused_corrections(footage):
    for args in (
        {"action": "update", "kind": "event", "node_id": STOP0, "patch": {"type": "x"}, "request": "short", "at": AT},
        {"action": "update", "kind": "event", "node_id": STOP0, "patch": {"id": "x"}, "request": NOTE, "at": AT},
        {"action": "update", "kind": "person", "node_id": "person_1", "patch": {"clothes": "x"}, "request": NOTE, "at": AT},
        {"action": "link", "rel": "involves", "src_kind": "clip", "src_id": "v1:clip_0000", "dst_kind": "person", "dst_id": "v1:person_1", "request": NOTE, "at": AT},
        {"action": "merge", "kind": "person", "keep_id": "v1:person_1", "drop_id": "v2:person_1", "request": NOTE, "at": AT},
        {"action": "create", "kind": "event", "video_id": "v1", "values": {"type": "arrest"}, "request": NOTE, "at": AT},
    ):
        with pytest.raises(dml.CorrectionError):
            footage.correct(**args)


def test_create_and_link(footage):
    footage.correct("create", kind="person", video_id="v1", values={"clothes": "blue coat"}, request=NOTE, at=AT, clip_id="v1:clip_0002", confirmed=True)
    assert footage.graph.node("person").where("id = 'v1:person_3'").first()["correction_note"] == NOTE
    assert footage.graph.edge("has_person").where("corrected_at is not null").count() == 1
    for _ in range(2):
        footage.correct("link", rel="involves", src_kind="event", src_id=STOP2, dst_kind="person", dst_id="v1:person_3", role="potential_suspect", request=NOTE, at=AT, confirmed=True)
    e = footage.graph.edge("involves").where("dst_id = 'v1:person_3'").collect()
    assert [(r["src_id"], r["role"]) for r in e] == [(STOP2, "potential_suspect")]
    assert footage.graph.node("person").where("id = 'v1:person_3'").first()["potential_suspect"] is False
    done = dml.involve(footage.graph, STOP2, NOTE, AT, {"person": "v1:person_3", "role": "potential_suspect", "vehicle": "v1:vehicle_1"}, True)
    person = done.graph.node("person").where("id = 'v1:person_3'").first()
    assert (person["potential_suspect"], person["role"]) == (True, "potential_suspect")
    assert done.graph.node("event").where(f"id = '{STOP2}'").first()["subject_ids"] == ["person_3"]
    assert done.graph.edge("involves", "event", "vehicle").where(f"src_id = '{STOP2}'").count() == 1
    counted = {r["name"]: (r["created"], r["deleted"], r["changed"]) for r in dml.write_counters(footage.graph, done.graph).collect()}
    assert counted["edge_involves"] == (1, 0, 0) and counted["person"] == (0, 0, 1) and counted["event"] == (0, 0, 1)


def test_create_with_defaults_and_links(footage):
    footage.correct("create", kind="vehicle", video_id="v1", values={"color": " Red ", "plate": "xy 123"}, request=NOTE, at=AT, clip_id="clip_0002", confirmed=True)
    row = footage.graph.node("vehicle").where("id = 'v1:vehicle_2'").first()
    assert (row["color"], row["plate"]) == ("red", "XY 123")
    assert footage.graph.node("plate").where("id = 'v1:plate:XY 123'").count() == 1
    assert {(r["src_id"], r["dst_id"]) for r in footage.graph.edge("has_plate").where("dst_id like 'v1%'").collect()} == {("v1:vehicle_2", "v1:plate:XY 123"), ("v1", "v1:plate:XY 123")}
    also = {"person": "person_1", "role": "civilian", "continues_from": STOP2}
    footage.correct("create", kind="event", video_id="v1", values={"type": "Night Patrol", "start_timestamp": "06:00"}, request=NOTE, at=AT, also=also, confirmed=True)
    event = "v1:clip_0002:night_patrol:360000"
    row = footage.graph.node("event").where(f"id = '{event}'").first()
    assert (row["title"], row["seek_s"], row["clip_id"], row["source"]) == ("night patrol", 360.0, "v1:clip_0002", "user")
    assert footage.graph.edge("continues").where(f"dst_id = '{event}'").first()["src_id"] == STOP2
    assert footage.graph.node("event_type").where("id = 'night_patrol'").first()["title"] == "night patrol"
    assert sorted(r["src_id"] for r in footage.graph.edge("has_type").where("dst_id = 'night_patrol'").collect()) == ["v1", "v1:clip_0002"]
    with pytest.raises(dml.CorrectionError):
        footage.correct("create", kind="event", video_id="v1", values={"type": "Night Patrol", "start_timestamp": "06:00"}, request=NOTE, at=AT, confirmed=True)


def test_names_of_nodes(graph):
    assert dml.locate(graph, "person", "person_1", "v2")["id"] == "v2:person_1"
    assert dml.locate(graph, "vehicle", "abc123")["id"] == "v2:vehicle_1"
    assert dml.locate(graph, "plate", "abc123")["id"] == "v2:plate:ABC123"
    assert dml.locate(graph, "object", "BOTTLE")["id"] == "v1:object_1"
    assert dml.locate_event(graph, "traffic_stop", "02:50", "v1")["id"] == STOP1
    for kind, name in (("person", "person_1"), ("object", "object_1"), ("event", "nothing"), ("person", "")):
        with pytest.raises(dml.CorrectionError):
            dml.locate(graph, kind, name)


def test_clean_patch():
    assert dml.clean_patch("person", {"role": "officer"}) == {"role": "officer", "is_cop": True}
    assert dml.clean_patch("person", {"is_cop": "yes"}) == {"is_cop": True, "role": "officer"}
    assert dml.clean_patch("person", {"role": "potential_suspect", "hair": ""}) == {"role": "potential_suspect", "potential_suspect": True}
    assert dml.clean_patch("person", {"is_cop": "unknown"}) == {"is_cop": None}
    assert dml.clean_patch("event", {"cell": "3", "end_timestamp": "1:02:03"}) == {"cell": 3, "end_timestamp": "1:02:03", "end_ms": 3723000}
    for kind, patch in (("person", {"role": "boss"}), ("person", {"is_cop": "maybe"}), ("event", {"type": "a-b"}), ("event", {"cell": "x"}), ("clip", {"transcript": "x"}), ("video", {"source_name": "x"})):
        with pytest.raises(dml.CorrectionError):
            dml.clean_patch(kind, patch)


def test_merge(footage):
    footage.correct("merge", kind="person", keep_id="v1:person_1", drop_id="v1:person_2", request=NOTE, at=AT, confirmed=True)
    row = footage.graph.node("person").where("video_id = 'v1'").collect()
    assert [(r["id"], r["role"], r["also_known_as"]) for r in row] == [("v1:person_1", "officer", ["person_2"])]
    e = footage.graph.edge("involves").where("dst_kind = 'person' and src_id like 'v1%'").collect()
    assert {(r["src_id"], r["dst_id"], r["role"]) for r in e} == {(STOP0, "v1:person_1", "officer"), (STOP1, "v1:person_1", "potential_suspect")}


def test_replace_videos_is_idempotent(graph):
    again = graph.replace_videos(graph, ["v1"]).replace_videos(graph, ["v1"])
    count = lambda g: {r["label"]: r["n"] for r in g.inventory().collect()}
    assert count(again) == count(graph)
    assert again.edge("involves").count() == graph.edge("involves").count()


def test_catalog(catalog):
    assert catalog.resolve("")["event_types"] == []
    assert catalog.resolve("pulled over")["event_types"] == ["traffic_stop"]
    assert catalog.canonical("Pulled Over") == "traffic_stop" and catalog.canonical("x") is None
    c = Catalog(dict(catalog.definitions), dict(catalog.topics))
    assert c.learn([{"id": "Door Knock", "description": "somebody knocks at a door", "aliases": ["knock", "Knock"]}, {"id": "bad", "description": "short"}]) == ["door_knock"]
    assert c.definitions["door_knock"]["aliases"] == ["knock", "Knock"]
    assert c.learn([{"id": "murder scene", "description": "a long enough description"}, {"id": "door knock", "title": "No", "description": "short"}]) == []
    assert c.learn([], [{"id": "none", "title": "x"}, {"id": "door knock", "title": "Knock", "description": "short", "how_to_confirm": "look"}]) == ["door_knock"]
    knock = c.definitions["door_knock"]
    assert (knock["title"], knock["description"], knock["how_to_confirm"], knock["source"]) == ("Knock", "somebody knocks at a door", "look", "gemini")
    assert c.learn([{"id": "door knock", "description": "a quite different description"}]) == ["door_knock"] and c.definitions["door_knock"]["description"] == "a quite different description"
    assert c.learn([], [{"id": "door knock", "aliases": ["knock"]}]) == []
    assert c.learn_types([{"type": "event", "id": "Flat tyre"}, {"type": "arrest"}, {"type": "flat tyre"}]) == ["flat_tyre"]
    assert c.definitions["flat_tyre"]["description"] == "Observable scene labeled flat tyre."
    assert c.prompt().splitlines()[:2] == ["- traffic_stop (aliases: pulled_over): Traffic stop / pulled over", "  phrases: Pull over; pull over"]


def test_many_questions_are_resolved_as_one_is(spark, catalog):
    said = ["find all drunk driving", "Pulled Over!", "arrest", "", "zzz", None, "the events", "custody"]
    got = {r["question"]: r["event_types"] for r in catalog.resolve_all(spark.createDataFrame([(s,) for s in said], "question string")).collect()}
    assert got == {s: catalog.resolve(s)["event_types"] for s in said}
    names = spark.createDataFrame([("Pulled Over",), ("arrest",), ("x",), (None,)], "n string")
    assert {r["n"]: r["canonical"] for r in catalog.canonicalise(names, "n").collect()} == {"Pulled Over": "traffic_stop", "arrest": "arrest", "x": None, None: None}


def test_recipes_in_the_short_form():
    assert blocks.parse_pipeline("person_timeline person_id=x") == blocks.recipe_steps("person_timeline", person_id="x")
    assert blocks.parse_pipeline("all_dui video_id='a b' | count") == [*blocks.recipe_steps("all_dui", video_id="a b"), {"block": "count"}]
    assert blocks.parse_pipeline("objects") == [{"block": "objects"}] and blocks.parse_pipeline("objects label=kit")[-1] == {"block": "return_objects"}
    with pytest.raises(blocks.PipelineError):
        blocks.parse_pipeline("person_timeline x")


def test_a_question_reads_only_its_columns(spark, tiny):
    from clipweave.plans.graph import graph_of_tables

    plan = blocks.assemble(graph_of_tables(spark, tiny), "events | event_type door_knock | count_by_video")._jdf.queryExecution().executedPlan().toString()
    assert "struct<id:string,video_id:string,source_name:string,type:string>" in plan
    assert "EqualTo(type,door_knock)" in plan and "SortAggregate" not in plan


def test_chains_from_some_starts_only(spark):
    from clipweave.operators.windows import event_chains

    edges = spark.createDataFrame([(f"e{i}", f"e{i + 1}") for i in range(20)] + [("e3", "x")], "src_id string, dst_id string")
    got = event_chains(edges, spark.createDataFrame([("e2",), ("nothing",)], "start_id string"))
    assert {tuple(r) for r in got.collect()} == {("e2", f"e{i}", i - 2) for i in range(3, 21)} | {("e2", "x", 2)}


def test_continues_edges_from_loose_names_and_users(spark):
    from clipweave.plans.graph import continues

    events = spark.createDataFrame(
        [("v:a", "v", None), ("v:b", "v", "v:a"), ("v:c", "v", " V:B "), ("v:d", "v", "C"), ("v:e", "v", "null"), ("v:f", "v", ""), ("w:x", None, "v:a"), (None, "v", "v:a")],
        "id string, video_id string, continues_from string",
    )
    links = spark.createDataFrame(
        [("v:D", "v:e ", "old", "2024-01-01"), ("v:d", "v:e", "new", "2024-02-01"), ("v:a", "v:b", "seen", None), (None, "v:a", "x", None), ("v:zz", "v:a", "x", None)],
        "src_id string, dst_id string, correction_note string, corrected_at string",
    )
    got = {(r["src_id"], r["dst_id"]): r["correction_note"] for r in continues(events, links).collect()}
    assert got == {("v:a", "v:b"): "seen", ("v:b", "v:c"): None, ("v:c", "v:d"): None, ("v:d", "v:e"): "new", ("v:a", "w:x"): None}


def test_the_graph_of_tables_has_the_links_of_users(spark, tiny):
    from clipweave.plans.graph import graph_of_tables
    from clipweave.sources.tables import table

    edges = graph_of_tables(spark, tiny).edge("continues")
    assert edges.where("corrected_at is not null").count() > 0
    ids = table(spark, tiny, "clip_events").select("id").distinct()
    links = table(spark, tiny, "continues_links").select("src_id", "dst_id").distinct()
    both = links.join(ids.withColumnRenamed("id", "src_id"), "src_id").join(ids.withColumnRenamed("id", "dst_id"), "dst_id")
    assert both.count() > 0 and both.join(edges, ["src_id", "dst_id"], "left_anti").count() == 0
