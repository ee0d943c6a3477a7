import json

import pytest

from fleetlens.sources.logs import parse_journal, parse_kmsg


def kmsg(spark, *lines):
    df = spark.createDataFrame([("b", l, 0) for l in lines], "boot_id string, line string, boot_epoch_ms bigint")
    return parse_kmsg(df.coalesce(1)).collect()


def test_kmsg_fields(spark):
    a, b, c = kmsg(
        spark, "14,907,2500999,c;disk sdq: 12 sectors\n DEVICE=b8:0", "35,0,999,-;\tsplit;in;three  ",
        " 2 ,+1_1, 3001;late",
    )
    assert (a.level, a.dedup, a.ts, a.text, a.seq) == (6, "b:907", 2500, "disk sdq: 12 sectors", 907)
    assert (b.level, b.ts, b.text) == (3, 0, "split;in;three")
    assert (c.level, c.dedup, c.ts) == (2, "b:11", 3)


def broken_heads():
    """Each of the three numbers missing, no number, negative, fractional or too large; and no `;`."""
    for place in range(3):
        for value in ("", "q", "-4", "2.5", "9" * 40 if place == 2 else "-", " "):
            head = ["5", "8", "700"]
            head[place] = value
            yield ",".join(head) + ";body"
        yield ",".join(["5", "8", "700"][:place]) + ";body"
    yield "5,8,700 body"
    yield " CONTINUED=yes;body"
    yield ""


def test_kmsg_malformed(spark):
    assert kmsg(spark, *broken_heads()) == []


def journal(spark, *entries):
    lines = [e if isinstance(e, str) else json.dumps(e) for e in entries]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    return [(r.ts, r.level, r.text, r.dedup) for r in parse_journal(df.coalesce(1)).collect()]


GOOD = {"MESSAGE": "fan stalled", "__REALTIME_TIMESTAMP": "1650000000777888", "PRIORITY": "4"}


def test_journal_good(spark):
    assert journal(
        spark,
        {**GOOD, "__CURSOR": "c=1;x=2", "MESSAGE": "\tfan größer "},
        {**GOOD, "MESSAGE": list("läuft".encode())},
        {**GOOD, "MESSAGE": [200, 111, 107], "PRIORITY": 0, "__REALTIME_TIMESTAMP": 2999},
        '{"MESSAGE":"bare","__REALTIME_TIMESTAMP":"1000"}',
        {**GOOD, "__CURSOR": None},
        '{"MESSAGE":"both \\ud83d\\ude80","__REALTIME_TIMESTAMP":"0"}',
        '{"MESSAGE":"only \\\\udc00","__REALTIME_TIMESTAMP":"0"}',
    ) == [
        (1650000000777, 4, "fan größer", "c=1;x=2"),
        (1650000000777, 4, "läuft", None),
        (2, 0, "\ufffdok", None),
        (1, 6, "bare", None),
        (1650000000777, 4, "fan stalled", None),
        (0, 6, "both \U0001f680", None),
        (0, 6, "only \\udc00", None),
    ]


# Wrong by JSON type or by value, for every member that is read.
WRONG = {
    "MESSAGE": [None, 7, 2.5, False, {}, {"a": 1}, [], [300], [-3], [1, "b"], [[1]], "", "\n\t ", "\udfff!"],
    "__REALTIME_TIMESTAMP": [None, False, 0.25, [], {}, "soon", "-7", -7, "", str(10**30)],
    "PRIORITY": [None, True, 3.5, [], {}, "high", "8", 9, -1, ""],
    "__CURSOR": [12, True, [], {}, ""],
}


@pytest.mark.parametrize("member", WRONG)
def test_journal_bad_members(spark, member):
    assert journal(spark, *[{**GOOD, member: value} for value in WRONG[member]]) == []


def test_journal_bad_shapes(spark):
    whole = json.dumps(GOOD)
    shapes = ["", "fan", "null", "3", '"text"', "true", f"[{whole}]", whole[:-1], whole + "}", "{}"]
    shapes += [json.dumps({k: v for k, v in GOOD.items() if k != gone}) for gone in ("MESSAGE", "__REALTIME_TIMESTAMP")]
    assert journal(spark, *shapes) == []
