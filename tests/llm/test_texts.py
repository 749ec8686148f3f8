"""Personal data, tokens, leaks and cut texts."""

import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from clipweave.llm import bpe, leaks, pii, truncation

RANKS = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
VOCABULARY = bpe.Vocabulary(RANKS)
EXACT = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=VOCABULARY.id, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aabe 's\n\t01é日"))), max_size=300), st.integers(1, 9))
def test_encoding_is_the_tokenizers(text, step):
    assert bpe.Encoder(VOCABULARY).encode(text) == EXACT.encode_ordinary(text)
    parts, whole = bpe.Encoder(VOCABULARY), []
    for i in range(0, len(text), step):
        whole += parts.feed(text[i : i + step])
    whole += parts.finish()
    assert whole == EXACT.encode_ordinary(text)
    out = bpe.Decoder(VOCABULARY)
    assert "".join(out.feed([i]) for i in whole) + out.finish() == text


@pytest.mark.parametrize("part", [1, 2, 3, 7])
def test_parts_never_show(monkeypatch, part):
    monkeypatch.setattr(bpe, "PART", part)
    for text in ("we'll they've 'll '' re'  \n\n x", "a  b   c\n \n", "'" * 4 + "s'll", "x" * 50 + "'ve", "日本 '日 'd 1234567 \u3000 \u00a0'm", " ", "\n"):
        assert bpe.Encoder(VOCABULARY).encode(text) == EXACT.encode_ordinary(text)


def test_memory_stays_bounded():
    run, n = bpe.PieceEncoder(VOCABULARY), 0
    for _ in range(40):
        n += len(run.feed(b"abcdefgh" * 50))
        assert len(run.window) <= 4 * VOCABULARY.lookahead
    assert n + len(run.finish()) == len(EXACT.encode_ordinary("abcdefgh" * 2000))


def test_ranks_are_read_as_documented():
    first = RANKS.splitlines()[0].split()
    assert VOCABULARY.id[base64.b64decode(first[0])] == int(first[1])


def test_every_row_is_encoded(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0), (None, "x" * 20_000, 0), (5, "<|endoftext|>", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = bpe.encode_texts(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((k or 0, EXACT.encode_ordinary(t or "")) for k, t, _ in rows)
    back = bpe.decode_ids(bpe.encode_texts(df, "doc_id", "text"), "doc_id").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((k or 0, t or "") for k, t, _ in rows)
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


ITEM = " ".join(f"Word{i}" for i in range(20))


def test_leaks(spark):
    low = ITEM.lower()
    docs = [(1, f"Before. {ITEM.upper()}! After", 0), (2, "x " + "--".join(low.split()[3:15]) + " y", 0), (3, " ".join(low.split()[3:14]), 0), (4, None, 0), (5, "", 0), (6, ITEM, 0), (6, ITEM, 0), (7, "a " * 100_000 + ITEM, 0)]
    items = [(10, ITEM), (11, "prefix " + " ".join(low.split()[:12])), (12, "short"), (13, None), (None, ITEM)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks.find_leaks(d, i)
    want = {(1, 10), (1, 11), (2, 10), (6, 10), (6, 11), (7, 10), (7, 11)}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, i, block_chars=100).collect()} == want
    clean = {r["doc_id"]: r["text"] for r in leaks.without_leaks(d.where("doc_id < 6"), found.where("doc_id < 6")).collect()}
    assert clean[1] == "Before. ! After" and clean[2] == "x  y" and clean[3] == docs[2][1] and clean[4] is None and clean[5] == ""
    assert leaks.without_leaks(d, found, spans_only=False).count() == 3
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_leaks_with_letters_that_grow_in_lower_case(spark):
    """A dotted capital I has two characters in lower case; the passage is cut out where it stands."""
    text = f"İİ {ITEM.upper()} İ end"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = leaks.find_leaks(d, spark.createDataFrame([(10, ITEM)], "item_id bigint, text string"))
    row = found.first()
    assert text[row["first_char"] : row["last_char"]] == ITEM.upper()
    assert leaks.without_leaks(d, found).first()["text"] == "İİ  İ end"


@pytest.mark.parametrize("block_chars", [leaks.BLOCK_CHARS, 100])
def test_every_leaked_passage_is_cut_out(spark, block_chars):
    """Passages that stand twice, those that a cut brings together, and null, repeated and large keys."""
    w, other = ITEM.split(), " ".join(f"other{i}" for i in range(12))
    nested = " ".join([*w[:6], ITEM, *w[6:12]])
    texts = [
        (1, f"a {ITEM} b {ITEM} c", "a  b  c"),
        (2, f"{' '.join(w[:13])} and {' '.join(w[5:18])} z", " and  z"),
        (3, f"a {nested} end", "a  end"),
        (4, f"a {' '.join(w[:6])} {other} {nested} {' '.join(w[6:12])} end", "a  end"),
        (5, f"İ {ITEM} İ {ITEM} İ", "İ  İ  İ"),
        (6, f"{ITEM} {other} 😀 {other}", "  😀 "),
        (7, " ".join(w[:11]), " ".join(w[:11])),
        (8, None, None),
        (8, "", ""),
        (None, f"q {ITEM}", "q "),
        (None, f"qqqq {ITEM}", "qqqq "),
        (None, "q", "q"),
        (2**53 + 1, f"{ITEM} r", " r"),
        (2**53 + 1, f"rr {ITEM}", "rr "),
        (2**53 + 1, f"rr {ITEM}", "rr "),
    ]
    d = spark.createDataFrame([(k, t, i) for i, (k, t, _) in enumerate(texts)], "doc_id bigint, text string, n int")
    items = spark.createDataFrame([(10, ITEM), (11, other), (12, " ".join(w[2:16]))], "item_id bigint, text string")
    clean = leaks.remove_leaks(d, items, block_chars=block_chars)
    assert clean.columns == d.columns
    assert {r["n"]: (r["doc_id"], r["text"]) for r in clean.collect()} == {i: (k, t) for i, (k, _, t) in enumerate(texts)}
    assert leaks.find_leaks(clean, items).count() == 0 and clean.count() == len(texts)
    found = leaks.find_leaks(d, items, block_chars=block_chars)
    cut = {r["n"]: r["text"] for r in leaks.without_leaks(d, found).collect()}
    assert all(cut[i] == t for i, (k, _, t) in enumerate(texts) if k not in (3, 4))
    assert leaks.without_leaks(d, found, spans_only=False).count() == 4
    assert {r["doc_id"] for r in found.where("item_id = 10").collect()} == {1, 2, 3, 4, 5, 6, None, 2**53 + 1}


def test_a_letter_that_a_cut_changes_in_lower_case(spark):
    """A capital sigma has another lower case at the end of a word; without its neighbour it makes a passage."""
    d = spark.createDataFrame([(1, f"α β ΑΣ.{ITEM} end")], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM), (11, "α β ας")], "item_id bigint, text string")
    clean = leaks.remove_leaks(d, items, words=3)
    assert clean.first()["text"] == ". end" and leaks.find_leaks(clean, items, words=3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), max_size=4))
def test_the_stretches_told_are_all_windows_of_an_item(doc, items):
    grams = leaks.Grams([(i, " ".join(map(str, t))) for i, t in enumerate(items)], 3)
    got = grams.hits(np.array([grams.number.get(str(w), -1) for w in doc], np.int32))
    for i, t in enumerate(items):
        windows = [a for a in range(len(doc) - 2) if any(doc[a : a + 3] == t[b : b + 3] for b in range(len(t) - 2))]
        assert sorted(a for since, n in got.get(i, {}).items() for a in range(since, since + n - 2)) == windows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=4))
def test_leaks_equal_a_search_by_hand(doc, items):
    grams = leaks.Grams([(i, " ".join(map(str, t))) for i, t in enumerate(items)], 3)
    import numpy as np

    got = grams.hits(np.array([grams.number.get(str(w), -1) for w in doc], np.int32))
    want = {i for i, t in enumerate(items) if any(doc[a : a + 3] == t[b : b + 3] for a in range(len(doc) - 2) for b in range(len(t) - 2))}
    assert set(got) == want


SHAPED = {
    "write me at jo.x+y@mail.example.": ("email", "jo.x+y@mail.example"),
    "you can write me at jo underscore 9 at mail dot example please": ("email", "jo underscore 9 at mail dot example"),
    "you can write me at jo dot doe at mail dot example please": ("email", "jo dot doe at mail dot example"),
    "to ab(dot)cd(at)mail(dot)test, please": ("email", "ab(dot)cd(at)mail(dot)test"),
    "call +44 (0)1632 960 133 now": ("phone", "+44 (0)1632 960 133"),
    "Try 409 555 0173 ext. 27.": ("phone", "409 555 0173 ext. 27"),
    "Cell: (499) 555-0121": ("phone", "(499) 555-0121"),
    "dialed six four three five five five oh one four four with no answer": ("phone", "six four three five five five oh one four four"),
    "license number nine two nine five four two six two five there": ("id_number", "nine two nine five four two six two five"),
    "SSN 913-28-7207.": ("id_number", "913-28-7207"),
    "card X756-2387-7092.": ("id_number", "X756-2387-7092"),
    "Respond to 551 Saltmarsh Rd, please.": ("address", "551 Saltmarsh Rd"),
    "I live at 29B Tarn Hollow Terrace, apartment 11.": ("address", "29B Tarn Hollow Terrace, apartment 11"),
    "the parcel goes to one six six one quarry court i was": ("address", "one six six one quarry court"),
    "Outside 4579A North Fennel Way #74.": ("address", "4579A North Fennel Way #74"),
}


@pytest.mark.parametrize(("text", "want"), SHAPED.items())
def test_shapes(text, want):
    assert [(k, text[s:e]) for s, e, k in pii.personal_data(text, pii.Patterns(), {})] == [want]


#: Forms that a gate in front of the patterns must let through.
GATED = {
    "call +33 612 345 678 now": ("phone", "+33 612 345 678"),
    "call +34 612-345-678 now": ("phone", "+34 612-345-678"),
    "call +48 601 234 567 now": ("phone", "+48 601 234 567"),
    "call +49 30 123 456 now": ("phone", "+49 30 123 456"),
    "dialed six-one-seven-five-five-five-oh-one-two-three today": ("phone", "six-one-seven-five-five-five-oh-one-two-three"),
    "We saw 551 Saltmarsh Street's lights.": ("address", "551 Saltmarsh Street"),
}


@pytest.mark.parametrize(("text", "want"), GATED.items())
def test_gates_let_every_form_through(text, want):
    assert [(k, text[s:e]) for s, e, k in pii.personal_data(text, pii.Patterns(), {})] == [want]


#: Numbers in words whose length tells what they are, and longer runs that 555 splits.
SPOKEN = {
    "call four nine five one two three four": [("phone", "four nine five one two three four")],
    "call six one seven four nine five one two three four": [("phone", "six one seven four nine five one two three four")],
    "call one six one seven four nine five one two three four": [("phone", "one six one seven four nine five one two three four")],
    "call oh one six three two nine six oh one three three": [("phone", "oh one six three two nine six oh one three three")],
    "call plus four four one six three two nine six oh one three three": [("phone", "plus four four one six three two nine six oh one three three")],
    "id five five five one two three four five six": [("id_number", "five five five one two three four five six")],
    "after six nine oh eight five five five zero one two zero": [("phone", "nine oh eight five five five zero one two zero")],
    "nine two nine five four two six two one six oh eight five five five zero one two zero": [("id_number", "nine two nine five four two six two one"), ("phone", "six oh eight five five five zero one two zero")],
    "four two four two four two four two four two four two four": [("id_number", "four two four two four two four two four two four two four")],
    "ticket four two four two four two four two": [],
}


@pytest.mark.parametrize(("text", "want"), SPOKEN.items())
def test_spoken_numbers_by_their_length(text, want):
    assert [(k, text[s:e]) for s, e, k in pii.personal_data(text, pii.Patterns(), {})] == want


@pytest.mark.parametrize("text", ["Case number 77-125-25, please.", "ticket 513 198 the desk", "badge 4238 on scene", "channel 6 go ahead", "plate starts with K L 8 4", "we turned onto weir cross lane", "clip 495 stays pending because Street lamp", "it happened around 03:27", "radio check on one five five", "", None])
def test_what_is_no_personal_data(text):
    assert pii.personal_data(text, pii.Patterns(), {}) == []


LEXICON = {"dana": "F", "marek": "F", "ottermole": "L", "loock": "L", "ceallmhar": "L"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Officer Dana S. Ottermole has", ["Dana S. Ottermole"]), ("ask for Ottermole, Dana at", ["Ottermole, Dana"]), ("MAREK VAN DER LOOCK here", ["MAREK VAN DER LOOCK"]), ("thanks dana ottermole marek loock said", ["dana ottermole", "marek loock"]),
        ("are you ottermole dana", ["ottermole dana"]), ("Marek Dana Ó Ceallmhar left", ["Marek Dana Ó Ceallmhar"]), ("W. Loock", ["W. Loock"]), ("dana. Marek", ["Marek"]), ("i think a ottermole", ["ottermole"]), ("Dana", ["Dana"]),
    ],
)
def test_names(text, want):
    assert [text[s:e] for s, e, k in pii.personal_data(text, pii.Patterns(), LEXICON) if k == "name"] == want


def test_names_are_learnt_from_the_corpus(spark):
    people = [f"{a} {b}" for a in ("Dana", "Marek", "Ilse") for b in ("Ottermole", "Loock", "Wexcombe")]
    rows = [(i, f"We met. My name is {p}. The officer drags the crate by Kestrel Way.", f"then {p} left the Kestrel yard") for i, p in enumerate(people)]
    rows += [(90, "my name is dana ottermole and i left", None), (91, None, ""), (92, "Nobody was at Kestrel.", "x" * 50_000), (92, "Nobody was at Kestrel.", "x" * 50_000)]
    df = spark.createDataFrame(rows, "id bigint, transcript string, summary string")
    told = pii.sanitise(df, "id", ["transcript", "summary"])
    texts = {r["id"]: (r["transcript"], r["summary"]) for r in told.collect()}
    assert texts[0] == ("We met. My name is [NAME]. The officer drags the crate by Kestrel Way.", "then [NAME] left the Kestrel yard")
    assert texts[90] == ("my name is [NAME] and i left", None) and texts[91] == (None, "") and texts[92][0] == "Nobody was at Kestrel."
    found = {tuple(r) for r in pii.found_pieces(told, "id", ["transcript", "summary"]).collect()}
    assert len(found) == 2 * len(people) + 1 and (90, "transcript", "name", "dana ottermole") in found
    beyond = pii.sanitise(df, "id", ["transcript", "summary"], lexicon_rows=1)
    assert {tuple(r) for r in pii.found_pieces(beyond, "id", ["transcript", "summary"]).collect()} == found
    assert pii.found_pieces(pii.sanitise(df.limit(0), "id", ["transcript", "summary"]), "id", ["transcript", "summary"]).count() == 0


def test_unknown_forms_of_numbers_are_learnt_from_what_stands_before(spark):
    """No pattern knows these forms; the ones that stand with a kind's cues are protected, case numbers of the same length are not."""
    rows = [(i, f"Please call {i % 90 + 10}.{i % 89 + 10}.{i % 88 + 10}.{i % 87 + 10} today. The guard waits at gate {i}.", f"Case number {i % 80 + 10}-{i % 70 + 100}-{i % 60 + 10} is open.") for i in range(40)]
    rows += [(100 + i, f"My passport is {i % 90 + 10}/{100000 + i} I think.", "The desk closed the report and nobody left the yard again. " * 20) for i in range(20)]
    rows += [(200, "Nobody said what 55.44.33.22 means.", None)]
    df = spark.createDataFrame(rows, "id bigint, transcript string, summary string")
    for limit in (pii.LEXICON_ROWS, 0):
        told = pii.sanitise(df, "id", ["transcript", "summary"], lexicon_rows=limit)
        texts = {r["id"]: (r["transcript"], r["summary"]) for r in told.collect()}
        assert texts[3][0] == "Please call [PHONE] today. The guard waits at gate 3." and texts[3][1] == rows[3][2]
        assert texts[104][0] == "My passport is [ID] I think." and texts[200][0] == "Nobody said what [PHONE] means."


def test_cut_texts(spark):
    line = "the guard drops the {} crate near the gate of Kestrel at 10:2{}"
    words = ("red", "blue", "torn", "wet", "old")
    rows, n = [], 0
    for i in range(60):
        body = ". ".join(line.format(words[(i + j) % 5], j % 10).capitalize() for j in range(3 + i % 4)) + "."
        rows.append((n, body + (" And more." * (i % 7)), f"s{i % 3}", 0))
        n += 1
    whole = {r[0] for r in rows}
    for i in range(40):  # a source with a field limit
        body = ". ".join(line.format(words[(i + j) % 5], j % 10).capitalize() for j in range(9)) + "."
        rows.append((1000 + i, body[:200], "limited", 0))
    cases = {
        2000: "The guard drops the red crate near the ga", 2001: "The guard drops the red crate near the gate of …", 2002: "The guard drops the red [cont", 2003: '{"a": "the guard dr', 2004: "A line.\n[05:1", 2005: "The guard drops,",
    }
    fine = {3000: '{"a": [1, 2]}', 3001: '«ok» {"a": "x"}\n', 3002: "The guard drops the red crate.", 3003: "Is it so?", 3004: "多い。"}
    for k, v in {**cases, **fine}.items():
        rows.append((k, v, "mixed", 0))
    rows += [(4000, None, "mixed", 0), (4001, "", "mixed", 0), (4002, "  \n ", None, 0), (4003, "The end.", None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cut int")
    cut = {r["doc_id"] for r in truncation.truncated(df).collect()}
    assert not cut & (whole | set(fine) | {4000, 4001, 4002, 4003})
    assert set(cases) <= cut
    assert {1000 + i for i in range(40)} - cut <= {r[0] for r in rows if 1000 <= r[0] < 2000 and r[1].endswith(".")}
    rates = {r["source"]: r for r in truncation.truncation_rates(df).collect()}
    assert rates["limited"]["documents"] == 40 and rates["limited"]["at_spike"] >= 35
    assert truncation.truncated(df.limit(0)).count() == 0
