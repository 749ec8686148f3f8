import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.functions import arrays, clock, text


def column_of(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_format_clock(spark):
    assert column_of(spark, [None, 116000, 3723000, -5], "bigint", clock.format_clock) == ["00:00", "01:56", "1:02:03", "00:00"]


CLOCKS = {"01:56": 116000, "1:02:03.5": 3723500, "90": 90, "at 03:12 pm": 192000, "x": None, "": None, " 12:03 ": 723000, "--:--": None, "27:38:21": 99501000, "~10:02 (est.)": 602000}


def test_parse_clock(spark):
    assert column_of(spark, [*CLOCKS, None], "string", clock.parse_clock) == [*CLOCKS.values(), None]
    assert [clock.parse_ms(x) for x in CLOCKS] == list(CLOCKS.values())


def test_clock_seconds(spark):
    said = ["90", "1500", "01:56", "x", None]
    assert column_of(spark, said, "string", clock.clock_seconds) == [90.0, 1.5, 116.0, None, None]
    assert [clock.parse_seconds(x) for x in said] == [90.0, 1.5, 116.0, None, None]


def test_event_window(spark):
    rows = [
        (None, "02:55", None, None, None, None, 170000, 350000),
        (None, None, None, None, None, None, 0, 10000),
        (5000, None, 4000, None, None, None, 0, 9000),
        (8900, None, 100, None, None, None, 0, 9000),
        (None, "x", None, "04:00", 200000, 180000, 170000, 350000),
        (None, None, None, None, None, 180000, 170000, None),
    ]
    df = spark.createDataFrame(rows, "a bigint, b string, c bigint, d string, e bigint, f bigint, g bigint, h bigint")
    got = df.select(clock.event_window(*[F.col(c) for c in "abcdefgh"]).alias("w")).select("w.*").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(175000, 205000), (0, 10000), (5000, 6000), (8900, 9000), (200000, 240000), (180000, 170000)]
    assert (got[0]["clock"], got[0]["end_clock"], got[0]["seek_s"]) == ("02:55", "03:25", 175.0)


def test_clip_time_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([(None, 10, 20), (5, 10, 20), (25, 10, 20), (15, 10, None)], "x bigint, a bigint, b bigint")
    assert [r[0] for r in df.select(clock.clip_time(F.col("x"), F.col("a"), F.col("b"))).collect()] == [None, 10, 20, 10]
    assert [r[0] for r in df.select(clock.clip_time(F.col("x"), F.col("a"), F.col("b"), True)).collect()] == [None, 15, 20, 10]


def test_timelines(spark):
    rows = [(60000, [(0, 1, "hello"), (65000, 66000, " stop "), (1, 2, " ")], "x"), (None, [], " hi "), (0, None, None)]
    df = spark.createDataFrame(rows, "s bigint, g array<struct<start_ms:bigint,end_ms:bigint,text:string>>, t string")
    got = [r[0] for r in df.select(clock.transcript_timeline(F.col("s"), F.col("g"), F.col("t"))).collect()]
    assert got == ["[01:00] hello\n[02:05] stop", "[00:00] hi", "(no speech)"]
    cells = spark.createDataFrame([([1000, 61000],), ([],), (None,)], "c array<bigint>")
    assert [r[0] for r in cells.select(clock.cell_timeline(F.col("c"))).collect()] == ["cell_00 at 00:01 (1000ms)\ncell_01 at 01:01 (61000ms)", "(no splice cells)", "(no splice cells)"]
    assert column_of(spark, [3723000, 60000, None], "bigint", clock.minute_clock) == ["62:03", "01:00", "00:00"]
    assert column_of(spark, [3723000, 60000, None], "bigint", clock.padded_clock) == ["01:02:03", "01:00", "00:00"]


def test_signature_has_cleaned_values(spark):
    df = spark.createDataFrame([("Unknown", " F ", "N/A", "No Glasses", "Red Jacket\u00a0", None, "", "none")], ", ".join(f"{k} string" for k in text.SIGNATURE))
    assert df.select(text.signature()).first()[0] == "f | none | red jacket | none"


def test_text(spark):
    assert column_of(spark, ["Traffic Stop / Pulled Over", "", None], "string", text.slug) == ["traffic_stop_pulled_over", "", None]
    assert column_of(spark, ["abc-1234", "ABCD", "A12", "a1234567890x"], "string", text.normal_plate) == ["ABC1234", "", "", ""]
    assert column_of(spark, ["N/A", "no glasses", " Red ", None], "string", text.clean) == ["unknown", "none", "red", "unknown"]
    assert column_of(spark, ["Stop! Get down, stop.", None], "string", text.repeated_commands) == [3, 0]
    assert column_of(spark, ["x {\"a\": {\"b\": 1}} y", "none"], "string", text.braces) == ['{"a": {"b": 1}}', None]
    assert column_of(spark, ["  a \n b ", None], "string", text.one_line) == ["a b", None]


@pytest.mark.parametrize(("value", "role", "want"), [("true", None, True), ("officer", None, True), (None, "civilian", False), ("maybe", None, None)])
def test_officer_is_never_guessed(spark, value, role, want):
    df = spark.createDataFrame([(value, role)], "v string, r string")
    assert df.select(text.is_officer(F.col("v"), F.col("r"))).first()[0] is want


@pytest.mark.parametrize(("a", "b", "want"), [("officer", "potential_suspect", "potential_suspect"), ("officer", "civilian", "officer"), (None, None, "unknown")])
def test_stronger_role(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.stronger_role(F.col("a"), F.col("b"))).first()[0] == want


def test_truthy(spark):
    assert column_of(spark, [None, 0.49, 0.5, 1.0], "double", text.truthy) == [False, False, True, True]


def test_phrase_count(spark):
    df = spark.createDataFrame([("Stop stop STOPPED", "stop"), ("aaaa", "aa"), ("x", ""), (None, "a")], "t string, p string")
    assert [r[0] for r in df.select(text.phrase_count(F.col("t"), F.col("p"))).collect()] == [3, 2, 0, None]


def test_arrays(spark):
    assert column_of(spark, [[True, True, False, True], [], None], "array<boolean>", arrays.longest_run) == [2, 0, None]
    assert column_of(spark, [[4.0, 1.0, 3.0, 2.0], []], "array<double>", arrays.upper_median) == [3.0, None]


def test_audio_signals(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 300, 16000)).astype(np.int16)
    x[8000:8800] = 20000
    got = spark.createDataFrame([(x.tolist(),), ([],)], "s array<smallint>").select(arrays.audio_signals(F.col("s")).alias("a")).select("a.*").collect()
    rms = [np.sqrt((x[i : i + 800].astype(float) ** 2).mean()) / 32768 for i in range(0, len(x) - 800, 800)]
    floor = max(sorted(rms)[len(rms) // 2], 1e-4)
    assert got[0]["loud_impact"] == pytest.approx(min(max((max(rms) / floor - 4) / 8, 0), 1), abs=1e-3)
    assert got[0]["impact_at_ms"] == 500
    assert tuple(got[1]) == (0.0, 0.0, 0.0, 0)
