import datetime
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.operators import detect, identity, links, roles, rules, vision, windows
from clipweave.sources import media, sinks
from clipweave.streaming import folder


@pytest.mark.parametrize(("d", "want"), [(60, [(0, 60)]), (180, [(0, 180)]), (181, [(0, 180), (170, 181)]), (350, [(0, 180), (170, 350)]), (400, [(0, 180), (170, 350), (340, 400)]), (0, None)])
def test_clip_windows(spark, d, want):
    got = spark.createDataFrame([(float(d),)], "d double").select(windows.clip_windows(F.col("d")).alias("w")).first()["w"]
    assert got == want if want is None else [(r["start_s"], r["end_s"]) for r in got] == want


def test_stitch_and_share(spark):
    rows = [("v", "stop", i, f"e{i}", p) for i, p in ((0, ["a"]), (1, []), (2, None), (4, []), (5, ["b"]))]
    df = spark.createDataFrame(rows, "video string, type string, idx int, id string, people array<string>")
    got = {r["id"]: r["continues_from"] for r in windows.stitch(df, ["video", "type"], "idx", [], "id").collect()}
    assert got == {"e0": None, "e1": "e0", "e2": "e1", "e4": None, "e5": "e4"}
    shared = {r["id"]: r["people"] for r in windows.share_participants(df, ["video", "type"], ["idx"], ["people"]).collect()}
    assert shared == {"e0": ["a"], "e1": ["a"], "e2": ["a"], "e4": ["a"], "e5": ["b"]}


def test_point_in_interval_equals_the_nested_loop(spark):
    rng = np.random.default_rng(2)
    spans = [("v", int(s), int(s + n), i) for i, (s, n) in enumerate(zip(rng.integers(0, 5000, 60), rng.integers(0, 900, 60), strict=True))]
    points = [("v", int(x)) for x in rng.integers(0, 6000, 80)]
    got = windows.point_in_interval(spark.createDataFrame(points, "k string, at bigint"), spark.createDataFrame(spans, "k string, s bigint, e bigint, i int"), ["k"], "at", "s", "e", 6)
    want = sorted((p, i) for _, p in points for _, s, e, i in spans if s <= p <= e)
    assert sorted((r["at"], r["i"]) for r in got.collect()) == want


def test_rules(spark):
    clips = spark.createDataFrame([("c1", "v", 0, 90, 7, "Please STOP the car. stop", [(0, 5, "please"), (5, 9, "STOP the car")]), ("c2", "v", 10, 99, 3, None, None)], "id string, video_id string, start_ms bigint, end_ms bigint, impact_at_ms int, transcript string, transcript_segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>")
    phrases = spark.createDataFrame([("halt", 0, "stop")], "definition string, rank int, phrase string")
    hits = rules.keyword_hits(clips, phrases)
    assert [tuple(r) for r in hits.collect()] == [("c1", "halt", 0, "stop", 2, 5)]
    signals = spark.createDataFrame([("c1", None, 0.9, None, None, 0.0), ("c2", 0.2, 0.5, None, 0.7, None)], "id string, loudness double, loud_impact double, loud_speech double, yelling double, repeated_commands double")
    rule = spark.createDataFrame([("crash", 1, ["loud_impact", "yelling"], 2, []), ("quiet", 2, ["loud_impact"], 1, ["yelling"]), ("loud_impact", 3, ["loud_impact"], 1, [])], "definition string, rank int, signals array<string>, need int, exclude array<string>")
    found = rules.candidates(signals, rule, hits)
    assert {(r["id"], r["definition"], r["by"]) for r in found.collect()} == {("c1", "halt", "keyword"), ("c1", "quiet", "signal"), ("c2", "crash", "signal"), ("c1", "loud_impact", "signal"), ("c2", "loud_impact", "signal")}
    events = rules.local_events(clips, found, hits).collect()
    assert {(r["id"], r["type"], r["start_ms"], r["end_ms"], r["confidence"], r["source"]) for r in events} == {
        ("c1", "halt", 5, 90, 0.7, "keyword"), ("c1", "quiet", 0, 90, 0.6, "local_signals"), ("c2", "crash", 10, 99, 0.6, "local_signals"),
        ("c1", "loud_impact", 7, 90, 0.6, "local_signals"), ("c2", "loud_impact", 13, 99, 0.6, "local_signals"),
    }
    assert {tuple(x) for r in events for x in r["evidence"]} == {("transcript", "stop"), ("signal", "quiet"), ("signal", "crash"), ("signal", "loud_impact")}


def test_key_clips_and_scenes(spark):
    df = spark.createDataFrame(
        [(0.7, None, None, 0, []), (None, 0.0, 0.8, 0, []), (None, 0.2, 0.8, 0, []), (None, None, None, 2, []), (None, None, None, None, ["arrest"]), (None, None, None, None, None)],
        "loud_impact double, yelling double, loud_speech double, repeated_commands int, names array<string>",
    )
    assert [r[0] for r in df.select(rules.is_key_clip(F.col("names"))).collect()] == [True, True, False, True, True, False]
    e = spark.createDataFrame(
        [("a", "vehicle", "CAR", 0.9), ("a", "object", "Surfboard", 0.9), ("a", "object", "bottle", 0.4), ("b", "object", "bench", 0.9), ("b", "object", None, 0.9), ("c", "vehicle", "boat", 0.9), ("c", "vehicle", "car", 0.9), ("c", "object", "surfboard", 0.9)],
        "video_id string, type string, label string, confidence double",
    )
    scenes = rules.scene_prior(e)
    assert {r["video_id"]: r["scene"] for r in scenes.collect()} == {"a": "land", "b": "other", "c": "other"}
    kept = sorted((r["video_id"], r["label"] or "") for r in rules.denoise(e, scenes).collect())
    assert kept == [("a", "CAR"), ("b", ""), ("b", "bench"), ("c", "boat"), ("c", "car"), ("c", "surfboard")]


def test_roles(spark):
    rows = [
        ("p1", "arrest", "00:10", 10, "e1", False, "coat", None, "you are under arrest"),
        ("p1", "arrest", "00:05", 5, "e0", False, "coat", None, None),
        ("p2", "arrest", "00:05", 5, "e0", True, "coat", None, None),
        ("p3", "arrest", "00:05", 5, "e0", None, "Police vest", "tall", None),
        ("p4", "arrest", "00:05", 5, "e0", None, None, "tall", "x"),
        ("p5", "arrest", "00:05", 5, "e0", None, None, None, None),
        ("p6", "parade", "00:05", 5, "e0", False, "coat", None, None),
    ]
    involved = spark.createDataFrame(rows, "person_id string, type string, clock string, start_ms bigint, id string, is_cop boolean, clothes string, description string, transcript string").withColumn("clip_start", F.lit(0))
    found = roles.first_subjects(involved, ["arrest"], ["start_ms", "id"])
    assert {r["person_id"]: (r["at"], r["reason"]) for r in found.collect()} == {
        "p1": ("00:05", "arrest at 00:05: only civilian on this event."),
        "p4": ("00:05", 'arrest at 00:05: officer is addressing this civilian. Transcript: "x"'),
    }
    people = spark.createDataFrame([("p1", False, "coat", "in a coat", "scar"), ("p2", True, None, None, None), ("p4", True, None, None, None), ("p5", None, None, None, None)], "id string, is_cop boolean, clothes string, description string, distinctive string")
    got = {r["id"]: (r["role"], r["potential_suspect"], r["suspect_snapshot"]) for r in roles.tag_people(people, found).collect()}
    assert got == {"p1": ("potential_suspect", True, "in a coat | scar"), "p2": ("officer", False, None), "p4": ("officer", False, None), "p5": ("civilian", False, None)}


def test_summary(spark):
    df = spark.createDataFrame([("c1", 0, 180000, "x" * 500, 1, 0, 0)], "id string, start_ms bigint, end_ms bigint, transcript string, person_count int, vehicle_count int, object_count int")
    got = df.select(rules.local_summary(F.array(F.lit("car")), F.array(F.lit("p1: red")), F.array(F.lit("speech"))).alias("s")).first()["s"]
    assert got == f"Clip c1 (00:00–03:00). Visible: 1 person(s), 0 vehicle(s), 0 object(s) (car). People: p1: red. Speech: {'x' * 400}… Tags: speech."


def test_suppress():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30]])
    assert detect.suppress(boxes, np.array([0.5, 0.9, 0.4])).tolist() == [1, 2]
    assert detect.suppress(np.empty((0, 4)), np.empty(0)).tolist() == []
    out = np.zeros((6, 2))
    out[:4, 0], out[4, 0] = [50, 50, 20, 20], 0.9
    out[:4, 1], out[5, 1] = [50, 50, 20, 20], 0.3
    assert detect.decode(out, ["person", "bottle"], {"person": "person", "bottle": "object"}, False, 1.0, (0, 0)) == [("person", "person", 0.9, [40, 40, 60, 60])]


def test_identity_fold(spark):
    rows = [
        ("v", 0, 0, "s0", "short brown", "none", "red coat", None),
        ("v", 1, 0, "s1", "short brown", None, "long red coat", None),
        ("v", 1, 1, "s2", "short brown", "none", "red coat", True),
        ("v", 2, 0, "s3", None, None, None, None),
        ("w", 0, 0, "s4", "short brown", "none", "red coat", None),
    ]
    df = spark.createDataFrame(rows, "video_id string, clip_index int, position int, sighting_id string, hair string, glasses string, clothes string, is_cop boolean")
    folded = identity.fold_people(df)
    card = {r["sighting_id"]: (r["video_id"], r["local_id"]) for r in identity.assignments_of(folded).collect()}
    assert card == {"s0": ("v", "person_1"), "s1": ("v", "person_1"), "s2": ("v", "person_1"), "s3": ("v", "person_2"), "s4": ("w", "person_1")}
    got = {r["id"]: r for r in identity.cards_of(folded).collect()}
    assert (got["v:person_1"]["clothes"], got["v:person_1"]["is_cop"], got["v:person_1"]["last_clip"]) == ("long red coat", True, 1)
    assert identity.clips_of(folded).where("video_id = 'v' and local_id = 'person_1'").count() == 2


def test_identity_fold_claims_officers_and_marks(spark):
    rows = [
        ("v", 0, 0, "a", "bald", "unknown", None, None, None, False),
        ("v", 0, 1, "b", "bald", "unknown", None, None, None, False),  # two points, a mark, and both say unknown clothes
        ("v", 0, 2, "c", "bald", "coat", None, None, None, False),  # two points, but clothes that only one knows
        ("v", 1, 0, "d", "bald", "coat", True, None, None, False),
        ("v", 1, 1, "e", "bald", "coat", False, None, None, False),  # no civilian is the officer
        ("v", 1, 2, "f", None, None, None, None, "person_9", False),
        ("v", 2, 0, "g", None, None, None, "officer", "person_9", False),
        ("v", 2, 1, "h", "bald", "coat", None, None, None, True),
    ]
    df = spark.createDataFrame(rows, "video_id string, clip_index int, position int, sighting_id string, hair string, clothes string, is_cop boolean, role string, claimed_id string, is_new boolean")
    folded = identity.fold_people(df)
    card = {r["sighting_id"]: r["local_id"] for r in identity.assignments_of(folded).collect()}
    assert card == {"a": "person_1", "b": "person_1", "c": "person_2", "d": "person_2", "e": "person_3", "f": "person_9", "g": "person_9", "h": "person_10"}
    assert {r["local_id"]: r["is_cop"] for r in identity.cards_of(folded).collect()} == {"person_1": None, "person_2": True, "person_3": False, "person_9": True, "person_10": None}
    assert identity.fold_people(df.limit(0)).count() == 0


def test_things_fold(spark):
    rows = [
        ("v", 0, 0, "a", "vehicle", "Red", None, "", None, None, None, False),
        ("v", 0, 1, "b", "vehicle", "red", "abc-1234", "parked", None, None, None, False),  # the red one without a plate
        ("v", 1, 0, "c", "vehicle", "blue", "ABC1234", "x", None, None, None, False),
        ("v", 1, 1, "d", "vehicle", "red", None, None, None, None, None, True),
        ("v", 1, 2, "e", "object", None, None, None, "Bag", "torn strap", None, False),
        ("v", 2, 0, "f", "object", None, None, None, "bag", "TORN STRAP", None, False),
        ("v", 2, 1, "g", "object", None, None, None, "bag", None, None, False),
        ("v", 2, 2, "h", "object", None, None, None, "bag", None, "object_7", False),
        ("v", 2, 3, "i", "plate", None, "zz 99 xx", None, None, None, None, False),
        ("v", 2, 4, "j", "plate", None, "none", None, None, None, None, False),
        ("v", 3, 0, "k", "vehicle", None, "NEW1111", None, None, None, "vehicle_1", False),  # by id: the plate is replaced
        ("v", 3, 1, "l", "vehicle", None, "ABC1234", None, None, None, None, False),  # so the old one is a new vehicle
    ]
    df = spark.createDataFrame(rows, "video_id string, clip_index int, position int, sighting_id string, kind string, color string, plate string, analysis string, label string, distinctive string, claimed_id string, is_new boolean")
    folded = identity.fold_things(df)
    card = {r["sighting_id"]: r["local_id"] for r in identity.assignments_of(folded).collect()}
    assert card == {
        "a": "vehicle_1", "b": "vehicle_1", "c": "vehicle_1", "d": "vehicle_2", "e": "object_1", "f": "object_1", "g": "object_2", "h": "object_7", "i": "plate_ZZ99XX", "k": "vehicle_1", "l": "vehicle_3",
    }
    cards = {r["local_id"]: r for r in identity.cards_of(folded).collect()}
    assert (cards["vehicle_1"]["color"], cards["vehicle_1"]["plate"], cards["vehicle_1"]["analysis"]) == ("red", "NEW1111", "parked")
    assert (cards["plate_ABC1234"]["vehicle_id"], cards["plate_NEW1111"]["vehicle_id"], cards["plate_ZZ99XX"]["confidence"]) == ("vehicle_3", "vehicle_1", 0.6)


def test_things_named_by_events(spark):
    things = spark.createDataFrame([("v:vehicle_1", "v", "vehicle_1", "ABC123"), ("w:vehicle_1", "w", "vehicle_1", None), ("v:vehicle_11", "v", "vehicle_11", "")], "id string, video_id string, local_id string, plate string")
    said = spark.createDataFrame([("e1", "v", "vehicle_1"), ("e2", "v", "abc123"), ("e3", "w", "w:vehicle_1"), ("e4", "w", "ABC123"), ("e5", "v", ""), ("e6", "v", None)], "e string, video_id string, x string")
    assert {(r["e"], r["thing_id"]) for r in links.link_names(said, things, "plate").collect()} == {("e1", "v:vehicle_1"), ("e2", "v:vehicle_1"), ("e3", "w:vehicle_1")}


def test_probe_and_ingest(spark, tmp_path):
    answers = ['{"streams": [{"width": 640, "height": 360, "r_frame_rate": "30000/1001"}], "format": {"duration": "12.5"}}', '{"streams": [], "format": {}}', '{"streams": [{"r_frame_rate": "1/0"}]}', "broken", None]
    df = spark.createDataFrame([(str(i), a) for i, a in enumerate(answers)], "path string, a string")
    got = [tuple(r) for r in df.select(media.probe_fields(F.col("a")).alias("p")).select("p.*").collect()]
    assert got == [(640, 360, 29.97, 12.5), *[(None, None, None, None)] * 4]

    def tool():
        return lambda p: answers[int(p)] if p != "4" else 1 / 0

    assert [r["fps"] for r in media.probe(df, tool).orderBy("path").collect()] == [29.97, None, None, None, None]
    assert media.probe(df).where("fps is null").count() == 5
    files = spark.createDataFrame([("/in/My Car.MP4", "My Car.MP4", 10)], "path string, source_name string, size_bytes bigint")
    old = spark.createDataFrame([("my_car_2", "graphed"), ("my_car_1", "failed")], "video_id string, status string")
    row = media.ingest_records(files, old, None, F.lit("now"), "/data").first()
    assert (row["video_id"], row["original_uri"], row["status"], row["ingested_at"]) == ("my_car_2", "/data/videos/my_car_2/original.mp4", "copied", "now")


def test_clip_files_registry_and_identities(spark, tmp_path):
    (tmp_path / "v" / "clip_0001").mkdir(parents=True)
    (tmp_path / "v" / "clip_0000").mkdir()
    (tmp_path / "v" / "clip_0001" / "clip.json").write_text('{"id": "clip_0001", "video_id": "v", "index": 1}')
    (tmp_path / "v" / "clip_0000" / "clip.json").write_text('{"id": "clip_0000", "video_id": "v", "index": 0, "transcript": "x"}')
    assert [r["id"] for r in media.clip_records(spark, str(tmp_path / "v")).collect()] == ["clip_0000", "clip_0001"]
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "clip_0003.json").write_text('{"id": "clip_0003", "index": 3}')
    assert [r["id"] for r in media.clip_records(spark, str(tmp_path / "flat")).collect()] == ["clip_0003"]
    (tmp_path / "registry.json").write_text('{"a.mp4": {"video_id": "a", "status": "graphed", "size_bytes": 3}, "_note": {}}')
    got = media.registry(spark, str(tmp_path / "registry.json")).collect()
    assert [(r["source_name"], r["video_id"], r["size_bytes"]) for r in got] == [("a.mp4", "a", 3)]
    assert media.registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "ids.json").write_text('{"people": [{"id": "person_1", "clothes": "coat"}, {"clothes": "x"}], "vehicles": []}')
    (tmp_path / "people.json").write_text('[{"id": "person_2"}]')
    (tmp_path / "bad.json").write_text("{")
    of = lambda name, kind="people": [r["id"] for r in media.identities(spark, str(tmp_path / name), "id string, clothes string", kind).collect()]
    assert (of("ids.json"), of("people.json"), of("bad.json"), of("none.json"), of("ids.json", "vehicles")) == (["person_1"], ["person_2"], [], [], [])
    clips = spark.createDataFrame([("v", "c0", 0, "x"), ("w", "c1", 1, "y")], "video_id string, id string, index int, transcript string")
    for _ in range(2):
        sinks.write_clip_records(clips, str(tmp_path / "out"))
    sinks.write_clip_records(clips.where("video_id = 'w'").withColumn("transcript", F.lit("z")), str(tmp_path / "out"))
    assert {(r["id"], r["transcript"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("c0", "x"), ("c1", "z")}


def test_merged_answers(spark):
    clips = spark.createDataFrame([("a", "old", "local", ["speech"]), ("b", "old", "local", ["speech"])], "id string, summary string, summary_source string, tags array<string>")
    answers = spark.createDataFrame([("a", 'ok {"summary": "new", "tags": ["speech", "car"], "plates": ["ab-1234", "x"]}'), ("b", "broken {")], "id string, answer string")
    got = {r["id"]: r for r in vision.merge_answers(clips, answers).collect()}
    assert (got["a"]["summary"], got["a"]["tags"], got["a"]["plates"]) == ("new", ["speech", "car"], ["AB1234"])
    assert (got["b"]["summary"], got["b"]["summary_source"], got["b"]["plates"]) == ("old", "local", [])
    none = vision.call_model(clips, "id", ["summary"], None)
    assert [r["answer"] for r in none.collect()] == [None, None]
    told = vision.call_model(clips, "id", ["summary"], lambda: lambda row: row["summary"].upper())
    assert [r["answer"] for r in told.collect()] == ["OLD", "OLD"]


def test_drop_folder_and_registry(spark, tmp_path):
    for name in ("b.mp4", "A.MOV", ".hidden.mp4", "notes.txt", "new.mp4"):
        (tmp_path / name).write_bytes(b"x" * 10)
        os.utime(tmp_path / name, (1e9, 1e9) if name != "new.mp4" else None)
    known = spark.createDataFrame([("b.mp4", "b", "f", "graphed", 10, None)], media.REGISTRY)
    assert [r["source_name"] for r in media.drop_folder(spark, str(tmp_path)).collect()] == ["A.MOV", "b.mp4"]
    assert [r["source_name"] for r in media.next_video(media.drop_folder(spark, str(tmp_path), known)).collect()] == ["A.MOV"]
    ids = spark.createDataFrame([("My Video (1).mp4",), ("(?).mp4",), ("Car-7.b.MP4",)], "n string").select(media.video_id(F.col("n"))).collect()
    assert [r[0] for r in ids] == ["my_video_1", "video", "car-7.b"]
    up = sinks.upsert(known, spark.createDataFrame([("b.mp4", "b", "f", "done", None, "now")], media.REGISTRY), ["source_name"], ["size_bytes"]).collect()
    assert [(r["status"], r["size_bytes"]) for r in up] == [("done", 10)]
    files = spark.createDataFrame([("x.mp4", 1, "f"), ("b.mp4", 10, "g"), ("c.mp4", 1, "h")], "source_name string, size_bytes bigint, fingerprint string")
    assert sorted(r["source_name"] for r in media.cached(files, known).collect()) == ["b.mp4", "x.mp4"]


def test_wav_and_transcripts(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, 16000, 0, "NONE", ""))
        w.writeframes(np.arange(1000, dtype="<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"broken")
    got = {os.path.basename(r["path"]): r["samples"] for r in media.wav_samples(spark, str(tmp_path)).collect()}
    assert got["a.wav"] == list(range(1000)) and got["b.wav"] == []
    clips = spark.createDataFrame([("v", "c1", "c1", 1, 60000, 90000, None), ("v", "c0", "c0", 0, 0, 60000, " hi ")], "video_id string, id string, local_id string, index int, start_ms bigint, end_ms bigint, transcript string")
    assert sinks.video_transcripts(clips).first()["value"] == "## c0  00:00–01:00\n\nhi\n\n## c1  01:00–01:30\n\n(no speech)\n"
    assert sinks.move_uris(spark.createDataFrame([("/old/x", "/old/y")], "clip_uri string, id string"), "/old", "/new").first() == ("/new/x", "/old/y")


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=37 * i), "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = folder.hop_counts(folder.record_stream(spark, str(tmp_path / "in"), "ts timestamp, kind string"), "ts", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hops").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hops").collect())) == sorted(map(tuple, folder.hop_counts(df, "ts", "kind").collect()))
    seen = []
    folder.run_available(folder.record_stream(spark, str(tmp_path / "in"), "ts timestamp, kind string"), lambda b, i: seen.append(b.count()), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(seen) == 60


def test_graph_round_trip(spark, tmp_path, tiny):
    from clipweave.plans.graph import graph_of_tables

    g = graph_of_tables(spark, tiny)
    sinks.write_graph(g, str(tmp_path / "g"))
    back = sinks.read_graph(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in back.inventory().collect()} == {tuple(r) for r in g.inventory().collect()}
