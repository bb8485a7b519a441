import csv
import io
import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.operators import parse_errors as P

GOOD = '7;Œuvre;"{""zones"": []}"'


def dump(*fields):
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="").writerow(fields)
    return out.getvalue()


def reason(line):
    return P.examine(line)[0]


@pytest.mark.parametrize("line", [GOOD, GOOD + "\r", '"7"; OEUVRE ;"{""zones"":[],""a"":1e5}"', '7;identite publique de personne;"{\n""zones"": [\n]}"', "7;Marque;{} ".replace("{} ", '"{""zones"":[{}]}"')])
def test_loaded(line):
    assert reason(line) is None


@pytest.mark.parametrize(
    "line,start",
    [
        (None, "record"), ("", "shape"), (GOOD + "\r\r", "shape"), (GOOD + ";", "shape"), ("7;Œuvre", "shape"), ("7,Œuvre,x", "shape"), ('7;Œuvre;"{', "shape"), ('7;Œu"vre;"{""zones"": []}"', "shape"), ('7;Œuvre;"a"b', "shape"), ("7;a\nb;c", "shape"),
        (";Œuvre;{}", "id"), ("７;Œuvre;{}", "id"), ("7 ;Œuvre;{}", "id"), ("7;Livre;{}", "type"), ("7;;{}", "type"), ("7;Œuvre;", "intermarc"), ("7;Œuvre;[]", "intermarc"), ("7;Œuvre;{}", "intermarc"),
        (dump("7", "Œuvre", '{"zones": {}}'), "intermarc"), (dump("7", "Œuvre", '{"zones": [],}'), "intermarc"), (dump("7", "Œuvre", "{'zones': []}"), "intermarc"), (dump("7", "Œuvre", '{"zones": [NaN]}'), "intermarc"),
        (dump("7", "Œuvre", '{"zones": []} x'), "intermarc"), (dump("7", "Œuvre", '{"zones": ["\t"]}'), "intermarc"), (dump("7", "Œuvre", '﻿{"zones": []}'), "intermarc"),
    ],
)
def test_set_apart(line, start):
    assert reason(line).startswith(start)


def test_edits_state_the_reason():
    assert reason('7;Œuvre;"{') == 'shape: insert " at 10'
    assert reason(GOOD + ";") == f"shape: delete ; at {len(GOOD)}"
    assert reason("7;Œuvre") == "shape: insert ; at 7"


def brute_cost(text, fields, most=3):
    """Fewest insertions and deletions of quotes and delimiters that make text well shaped, by trying."""
    level, seen = {text}, {text}
    shape = P._shape(fields)
    for cost in range(most + 1):
        if any(shape.fullmatch(t) for t in level):
            return cost
        new = set()
        for t in level:
            new |= {t[:i] + t[i + 1 :] for i, c in enumerate(t) if c in '";'}
            new |= {t[:i] + c + t[i:] for i in range(len(t) + 1) for c in '";'}
        level = new - seen
        seen |= level
    return None


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_cheapest_edits_against_brute_force(n):
    for chars in itertools.product('";x', repeat=n):
        text = "".join(chars)
        want = brute_cost(text, 2)
        got = P.cheapest_edits(text, 2)
        assert want is None or got[0] == want, (text, got, want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('a";\n,', max_size=6), min_size=3, max_size=3))
def test_well_quoted_records_split_as_written(fields):
    line = ";".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert P._shape(3).fullmatch(line) and P.split_record(line) == fields and P.cheapest_edits(line)[0] == 0


def test_deep_nesting_is_checked_without_recursion():
    deep = '{"zones": [' + "[" * 200_000 + "]" * 200_000 + "]}"
    assert P.json_fault(deep) is None and P.json_fault(deep[:-1]) is not None
    for text in ('{"zones": []}', '{"zones": [1, {"a": "b"}], "x": null}', '{"a": {"zones": []}}', '{"zones": [1,]}', '{"zones": [] "b": 1}', '{"zones": {}}', "[]", '{"zones": [}'):
        try:
            value = json.loads(text)
            want = isinstance(value, dict) and isinstance(value.get("zones"), list)
        except ValueError:
            want = False
        assert P._deep_check(text) == want, text


def test_tables(spark):
    rows = [(1, 1, "id;type;im"), (2, 2, GOOD), (3, 3, "x"), (4, None, None), (5, 2, ""), (3, 3, "x"), (6, 9, '7;Œuvre;"' + "a" * 1_000_000)]
    lines = spark.createDataFrame([(*r, "clash") for r in rows], "line_id long, line_no int, line string, reason string")
    assert [tuple(r) for r in P.load_rows(lines).collect()] == [(2, "7", "Œuvre", '{"zones": []}')]
    assert sorted(r.line_id for r in P.reject_rows(lines).collect()) == [3, 3, 4, 5, 6]
    assert P.reject_rows(lines.limit(0)).count() == 0
