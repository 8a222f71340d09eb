from __future__ import annotations

import json

import pytest

from mnemoframe.llm import pii

NAMES = {"darius": "given", "mirelle": "given", "tarkeld": "family", "rennskog": "family", "pernilla": "given"}


@pytest.fixture(scope="module")
def auto():
    return pii.automaton(NAMES)


def kinds(text, auto):
    return [(s.kind, text[s.start : s.end]) for s in pii.scan([text], auto, NAMES)[0]]


@pytest.mark.parametrize(("text", "want"), [
    ("write to a.b+1@post.example.net today", [("EMAIL", "a.b+1@post.example.net")]),
    ("cc tarkeld (at) uni (dot) test on replies", [("EMAIL", "tarkeld (at) uni (dot) test")]),
    ("mail=darius%40corp.example&tab=2", [("EMAIL", "darius%40corp.example")]),
    ("mirelle-65＠uni.test", [("EMAIL", "mirelle-65＠uni.test")]),
    ("call +44 7700 900123 when done", [("PHONE", "+44 7700 900123")]),
    ("tel 5 5 5 - 0 1 0 - 2 2 3 4", [("PHONE", "5 5 5 - 0 1 0 - 2 2 3 4")]),
    ("(555.010.9560, later)", [("PHONE", "555.010.9560")]),
    ("five five five zero one zero one two three four", [("PHONE", "five five five zero one zero one two three four")]),
    ("my cell is ０５５５-０１０６９２０", [("PHONE", "０５５５-０１０６９２０")]),
    ("DNI 000-52-5048", [("ID_NUMBER", "000-52-5048")]),
    ("national identity QX1234567 was shown", [("ID_NUMBER", "QX1234567")]),
    ("身份证号 990101197411219891", [("ID_NUMBER", "990101197411219891")]),
    ("moved from 52 Hazelmere Ln last spring", [("ADDRESS", "52 Hazelmere Ln")]),
    ("wohnhaft Osierbankallee 81, 00121 Ilmen", [("ADDRESS", "Osierbankallee 81, 00121 Ilmen")]),
    ("pick-up at Paseo Brindle 43a please", [("ADDRESS", "Paseo Brindle 43a")]),
    ("地址：柳塘巷105号16室", [("ADDRESS", "柳塘巷105号16室")]),
    ("signed off by Darius Tarkeld.", [("NAME", "Darius Tarkeld")]),
    ("Rennskog, Mirelle called about the booking", [("NAME", "Rennskog, Mirelle")]),
    ("O. Tarkeld approved it", [("NAME", "O. Tarkeld")]),
    ("caregiver Saorla Ubregon picks up the parcel", [("NAME", "Saorla Ubregon")]),
    ("联系人 诸葛青柚 Gilkapod moved", [("NAME", "诸葛青柚")]),
    ("the Pernilla theme is dark", []), ("module Tarkeld passed review", []), ("cluster Rennskog-41 restarted", []), ("the Rennskog rollout", []),
    ("part number 555-3484-2639", []), ("batch 4987 2531 1033 weighed", []), ("order 978-66-7616 shipped", []), ("invoice 4645 78 4321 paid", []), ("ticket QX-531068 is open", []),
    ("window 2025-01-11 10:7:05", []), ("ping 192.0.2.64 twice", []), ("22 Lane changes in the diff", []), ("route 66 exit 46", []), ("see pepper@20.51.0 in the lock file", []), ("@radish channel was renamed", []),
])
def test_cases(text, want, auto):
    assert kinds(text, auto) == want


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.mod11("11010519491231002X") and not pii.mod11("110105194912310021")


@pytest.mark.parametrize(("validator", "text", "held", "failed"), [
    ("mod11", "seen {} there", "11010519491231002X", "110105194912310021"),
    ("luhn", "number {} there", "046454286", "046454287"),
    ("luhn", "{} there", "QX1234566", "QX1234567"),
    ("mod23", "{} there", "12345678Z", "12345678A"),
    ("key97", "id {} there", "85073003328", "85073003329"),
])
def test_a_checksum_decides(validator, text, held, failed, auto):
    assert getattr(pii, validator)(held if validator != "luhn" else held.lstrip("QX")) and not getattr(pii, validator)(failed if validator != "luhn" else failed.lstrip("QX"))
    assert kinds(text.format(held), auto) == [("ID_NUMBER", held)] and kinds(text.format(failed), auto) == []


def test_an_account_number_is_no_identity_number(auto):
    assert kinds("tax id GB82WEST12345698765432", auto) == [] and kinds("tax id GB82WEST12345698765433", auto) == [("ID_NUMBER", "GB82WEST12345698765433")]


def test_words_that_name_the_number_outweigh_the_checksum(auto):
    assert kinds("passport no. 110105194912310021", auto) == [("ID_NUMBER", "110105194912310021")]


def test_many_name_words(spark):
    letters = "abcdefghij"
    word = lambda k: "Zu" + "".join(letters[int(c)] for c in str(k))
    tokens = spark.createDataFrame([(word(k), "family") for k in range(10_001)] + [("Darius", "given")], "name_token string, token_use string")
    assert len(pii.name_words(tokens)) == 10_002
    df = spark.createDataFrame([("t", str(k), f"told darius {word(k).lower()} so") for k in (0, 10_000)], "table_name string, record_id string, text string")
    assert {r[1] for r in pii.personal_types(df, tokens).collect()} == {"0", "10000"}
    with pytest.raises(ValueError, match="10002 name words"):
        pii.name_words(tokens, most=10_000)


def test_rest_is_unchanged_through_escapes(auto):
    inner = "姓名: 诸葛青柚\n\"call\" +44 7700 900123 \U0001f600 now"
    for raw in (json.dumps({"text": inner}), json.dumps({"text": inner}, ensure_ascii=False), json.dumps({"text": inner})[:-2], "a\0b\\" + inner):
        spans = pii.scan(["x", raw, None, "", raw], auto, NAMES)
        assert spans[1] == spans[4] and not spans[0] and not spans[2] and not spans[3]
        out = pii.mask(raw, spans[1])
        assert [s.kind for s in spans[1]] == ["NAME", "PHONE"] and "[NAME]" in out and "[PHONE]" in out
        at = 0
        for piece in out.replace("[NAME]", "|~|").replace("[PHONE]", "|~|").split("|~|"):
            at = raw.index(piece, at) + len(piece)
    decoded = json.loads(pii.mask(json.dumps({"text": inner}), pii.scan([json.dumps({"text": inner})], auto, NAMES)[0]))["text"]
    assert decoded == "姓名: [NAME]\n\"call\" [PHONE] \U0001f600 now"


def test_frames(spark):
    tokens = spark.createDataFrame([("Darius", "given"), ("Tarkeld", "family"), ("Tarkeld", "family"), (None, "given"), ("", "given")], "name_token string, token_use string")
    rows = [("t", "1", "Darius Tarkeld at a@b.example"), ("t", "1", "Darius Tarkeld at a@b.example"), ("t", "2", None), ("t", "3", ""), ("t", None, "a@b.example"), ("t", "4", "x" * 200_000 + " a@b.example " + "9" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "table_name string, record_id string, text string, masked string")
    got = {tuple(r) for r in pii.personal_types(df, tokens).collect()}
    assert got == {("t", "1", "NAME"), ("t", "1", "EMAIL"), ("t", None, "EMAIL"), ("t", "4", "EMAIL")}
    full = pii.personal_data(df, tokens).collect()
    assert len(full) == 4 and {r.masked for r in full if r.record_id == "1"} == {"[NAME] at [EMAIL]"}
    assert [len(r.masked) for r in full if r.record_id == "4"] == [400_000 + 2 + len("[EMAIL]")]
    assert pii.personal_data(df.limit(0), tokens.limit(0)).count() == 0
