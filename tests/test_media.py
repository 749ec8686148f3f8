import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.operators import detect, identity, imaging, vision
from clipweave.sources import media, paths


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_crops_stay_in_the_picture(spark):
    df = spark.createDataFrame([([-5, -5, 30, 30],), ([0, 0, 19, 90],), ([600, 300, 900, 900],), ([1, 2, 3],), (None,)], "b array<int>")
    w, h = F.lit(640), F.lit(360)
    assert [r[0] for r in df.select(imaging.person_crop(F.col("b"), w, h)).collect()] == [[0, 0, 30, 30], None, [600, 300, 640, 360], None, None]
    assert [r[0] for r in df.select(imaging.plate_crop(F.col("b"), w, h)).collect()] == [[2, 16, 28, 30], None, [603, 333, 637, 360], None, None]


def test_fitting(spark):
    assert tuple(one(spark, imaging.letterbox(F.lit(1280), F.lit(720)))) == (0.5, 640, 360, 0.0, 140.0)
    assert tuple(one(spark, imaging.fit_cell(F.lit(100), F.lit(400), 320, 180))) == (45, 180, 137, 0)


def test_brightness(spark):
    df = spark.createDataFrame([([0, 100, 200],), ([],)], "p array<int>")
    assert [r[0] for r in df.select(imaging.luma_mean(F.col("p"))).collect()] == [100.0, 0.0]
    nights = spark.createDataFrame([([True, None, False, True],), ([True, False, False, False],), ([],), ([True],)], "n array<boolean>")
    assert [r[0] for r in nights.select(imaging.night_clip(F.col("n"))).collect()] == [True, False, False, True]


def test_images_are_shown_once_and_capped(spark):
    df = spark.createDataFrame([(True, "s", ["f0", "f1", "f2"], ["s", None, "c1", "c2"]), (False, "s", ["f0"], ["c1"]), (True, None, [], None)], "k boolean, s string, f array<string>, c array<string>")
    got = [r[0] for r in df.select(imaging.shown_images(*[F.col(c) for c in "ksfc"])).collect()]
    assert got == [["s", "f1", "c1"], ["s"], []]


def test_places(spark):
    places = {"/data/in": "/mnt/in/", "/data": "/host"}
    df = spark.createDataFrame([("file:///data/in/a.mp4",), (" /data/videos/car_00ab12cd/x.mp4",), ("/database/x",), (None,), ("/data",)], "u string")
    assert [r[0] for r in df.select(paths.local_uri(F.col("u"), places)).collect()] == ["/mnt/in/a.mp4", "/host/videos/car/x.mp4", "/database/x", None, "/host"]
    may = spark.createDataFrame([("/a/b/c",), ("/a/b",), ("/a/bc",), ("/a/b/../c",), (None,)], "p string")
    assert [r[0] for r in may.select(paths.allowed(F.col("p"), ["/a/b/"])).collect()] == [True, True, False, False, False]
    ids = spark.createDataFrame([("v", "", "V.mp4"), ("a", "b", None), (None, None, "")], "v string, p string, s string")
    assert [r[0] for r in ids.select(paths.previous_ids(F.col("v"), F.col("p"), F.col("s"))).collect()] == [["v"], ["a", "b"], []]


def test_kept_classes():
    labels, kinds = detect.kept_classes()
    assert len(labels) == 80 and (labels[2], labels[4], kinds["bus"], kinds["knife"], kinds["person"]) == ("car", "", "vehicle", "object", "person")
    out = np.zeros((84, 2))
    out[:4, 0], out[4 + 4, 0] = [50, 50, 20, 20], 0.9  # an aeroplane is not kept
    out[:4, 1], out[4 + 2, 1] = [50, 50, 20, 20], 0.3
    assert [(k, n) for k, n, *_ in detect.decode(out, labels, kinds, False, 1.0, (0, 0))] == [("vehicle", "car")]


def test_committed_identities_are_folded(spark):
    answers = [
        ("v", 0, 'I see {"people": [{"id": "", "local_id": "a", "match": "new", "clothes": "red coat"}], "vehicles": [{"id": "vehicle_4", "local_id": "x", "match": "new", "color": "Blue", "plate": "ab-1234"}], "objects": [{"local_id": "o", "match": "new", "label": "Bag"}]}'),
        ("v", 1, '{"people": [{"id": "person_1", "local_id": "b", "match": "existing", "hair": "bald"}], "plates": [{"text": "AB 1234", "vehicle_id": "vehicle_9"}, {"text": "no"}], "objects": [{"id": "object_1", "match": "existing", "distinctive": "torn"}]}'),
        ("v", 2, "broken {"),
        ("w", 0, None),
    ]
    people, things = vision.committed(spark.createDataFrame(answers, "video_id string, clip_index int, answer string"))
    cards = identity.cards_of(identity.fold_people(people)).collect()
    assert [(r["id"], r["clothes"], r["hair"], r["last_clip"]) for r in cards] == [("v:person_1", "red coat", "bald", 1)]
    folded = identity.fold_things(things)
    got = {r["local_id"]: r for r in identity.cards_of(folded).collect()}
    assert set(got) == {"vehicle_4", "plate_AB1234", "object_1"}
    assert (got["vehicle_4"]["plate"], got["plate_AB1234"]["vehicle_id"], got["object_1"]["distinctive"]) == ("AB1234", "vehicle_9", "torn")
    names = {(r["kind"], r["sighting_id"]): r["local_id"] for r in identity.assignments_of(folded).collect()}
    assert names["vehicle", "x"] == "vehicle_4" and names["object", "o"] == "object_1"


@pytest.mark.parametrize("n", [0, 1])
def test_no_pictures(spark, n):
    df = spark.createDataFrame([], "b array<int>")
    assert df.select(imaging.person_crop(F.col("b"), F.lit(n), F.lit(n))).count() == 0


def test_prints_of_files_are_those_of_their_contents(spark, tmp_path):
    mib = 1 << 20
    for i, n in enumerate((1, 10, mib, 2 * mib, 2 * mib + 1, 3 * mib)):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * (n // 2) + bytes([i + 9]) * (n - n // 2))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    want = {r["path"]: r["p"] for r in files.select("path", media.fingerprint(F.col("content"), F.col("length")).alias("p")).collect()}
    gone = spark.createDataFrame([("/no/such/file",)], "path string")
    got = {r["path"]: r["fingerprint"] for r in media.file_prints(files.select("path").unionAll(gone)).collect()}
    assert got == want | {"/no/such/file": None} and len(set(want.values())) == 6


def test_a_long_video_is_chained_by_stretches(spark, monkeypatch):
    from clipweave.plans import graph

    monkeypatch.setattr(graph, "STRETCH", 3)
    rows = [(f"c{i:02d}", "v", i if i != 5 else None, i * 10) for i in range(12)] + [("d1", "w", 7, 0), ("d0", "w", 7, 0)]
    first, following = graph.clip_chain(spark.createDataFrame(rows, "id string, video_id string, index int, start_ms bigint"))
    assert {tuple(r) for r in first.collect()} == {("v", "c05"), ("w", "d0")}
    order = ["c05", *[f"c{i:02d}" for i in range(12) if i != 5]]
    assert {tuple(r) for r in following.collect()} == {*zip(order, order[1:], strict=False), ("d0", "d1")}
