import re

import pytest

from horograph.sources.route_lines import parse_routes

SCHEMA = "line_id bigint, raw_line string, id string, fields string, reason int"


def judge(line):
    """A reader of one line, character by character."""
    if line is None:
        return "columns"
    if line.endswith("\r"):
        line = line[:-1]
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, text = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return "quoting"
                text += line[j:k]
                if line[k + 1 : k + 2] == '"':
                    text, j = text + '"', k + 2
                    continue
                break
            fields.append(text)
            i = k + 1
            if i == n:
                break
            if line[i] != ",":
                return "quoting"
            i += 1
        else:
            k = line.find(",", i)
            e = n if k < 0 else k
            if '"' in line[i:e]:
                return "quoting"
            fields.append(line[i:e])
            if k < 0:
                break
            i = k + 1
    if len(fields) != 9:
        return "columns"
    for c in (3, 5):
        v = fields[c].strip(" ")
        if v != r"\N" and not (re.fullmatch("[0-9]{1,6}", v) and int(v) > 0):
            return "value"
    return None


LINES = [
    "A,1,X,10,Y,20,,0,", "A,1,X,10,Y,20,,0,\r", "A,1,X,10,Y,20,,0,\r\r", None, "", ",,,,,,,,", "A,1,X,\\N,Y,\\N,,0,E",
    'A,1,X," 10 ",Y,"\\N",,0,"a,b"', 'A,1,X,10,Y,20,,0,"a ""b"" c"', 'A,1,X,10,Y,20,,0,"a "b" c"', 'A,1,X,10,Y,20,,0,"open', 'A,1,X,10,Y,20,,0,x"y"',
    'A,1,X,10,Y,20,,0,""', 'A,1,X,10,Y,20,,0,""""', 'A,1,X,10,Y,20,,0,"""', 'A,1,X, "10",Y,20,,0,', 'A,1,X,"10"0,Y,20,,0,', "A,1,X,0,Y,20,,0,", "A,1,X,000001,Y,20,,0,",
    "A,1,X,1234567,Y,20,,0,", "A,1,X,-5,Y,20,,0,", "A,1,X,,Y,20,,0,", "A,1,X,1 0,Y,20,,0,", "A,1,X,10\n,Y,20,,0,", 'A,1,X,"10\n",Y,20,,0,', "A,1,X,10,Y,20,,0", "A,1,X,10,Y,20,,0,,",
    'A,1,X,"10,20",Y,20,,0,', '"A\nB",1,X,10,Y,20,,0,z', "A,1,X,１０,Y,20,,0,", "A,1,X,\\n,Y,20,,0,", 'A,1,X,10,Y,20,,0,"' + 'x""' * 20000 + '"', "A" * 50000 + ",1,X,10,Y,20,,0,",
    "a," * 20000, 'A,1,X,10,Y,20,,0,"\x01a\x01b,\x01"', '"",1,X,10,Y,20,,0,"",""',
]


def test_reasons_match_a_plain_reader(spark):
    rows = [(k, line, "x", "y", 1) for k, line in enumerate(LINES * 2)]
    good, bad = parse_routes(spark.createDataFrame(rows, SCHEMA))
    want = {k: j for k, line, *_ in rows if (j := judge(line))}
    assert {r["line_id"]: r["reason"] for r in bad.collect()} == want
    assert {r["line_id"] for r in good.collect()} == {r[0] for r in rows} - set(want)


def test_values_are_typed_and_text_is_kept(spark):
    good, _ = parse_routes(spark.createDataFrame([(1, 'A, 7,X," 10 ",Y,\\N,,0,"a,""b\x01a"', "", "", 0)], SCHEMA))
    r = good.first()
    assert (r["airline_id"], r["src"], r["dst"], r["stops"], r["equipment"], r["codeshare"]) == (7, 10, None, 0, 'a,"b\x01a', "")
    assert r["untyped"] == []
    other, _ = parse_routes(spark.createDataFrame([(1, "A,n/a,X,1,Y,2,,few,", "", "", 0), (2, "A,\\N,X,1,Y,2,,99999999999,", "", "", 0)], SCHEMA))
    assert [(r["airline_id"], r["stops"], r["untyped"]) for r in other.orderBy("line_id").collect()] == [(None, None, ["airline_id", "stops"]), (None, None, ["stops"])]


def test_hot_values_beyond_the_broadcast_bound(spark, monkeypatch):
    import horograph.sources.route_lines as m

    monkeypatch.setattr(m, "is_small", lambda df, **kw: False)
    rows = [(k, f"A,1,X,{'bad' if k % 3 else k + 1},Y,\\N,,0,", "", "", 0) for k in range(300)]
    broken = [(1000 + k, 'x"y' if k % 2 else "a,b", "", "", 0) for k in range(60)]
    good, bad = m.parse_routes(spark.createDataFrame(rows + broken, SCHEMA))
    assert {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()} == {"value": 200, "quoting": 30, "columns": 30}
    bad = bad.where("reason = 'value'")
    assert bad.count() == 200 and good.count() == 100 and good.agg({"src": "max"}).first()[0] == 298


def test_empty_table(spark):
    good, bad = parse_routes(spark.createDataFrame([], SCHEMA))
    assert good.count() == 0 and bad.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice('",ab1\r\n \\N') for _ in range(rng.randrange(30))), "", "", 0) for k in range(400)]
    _, bad = parse_routes(spark.createDataFrame(rows, SCHEMA))
    assert {r["line_id"]: r["reason"] for r in bad.collect()} == {k: j for k, line, *_ in rows if (j := judge(line))}
