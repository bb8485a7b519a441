"""Rows that fail to parse: valid rows are loaded, the others set apart with a reason.

Method: minimum-cost error parse. A dynamic program runs over the row's quotes, delimiters, line
breaks and the text between them, and may delete or insert quotes and delimiters at a cost of one
each. A row whose cheapest parse costs nothing has the right shape and is checked field by field; a row
that needs edits is set apart, and the edits state the reason.

The zero-cost parse is a deterministic automaton (a regular expression here), so the program itself
only runs for rows that have no such parse. Rows are independent: no shuffle, one Arrow pass.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The eight entity types, without accents, ligatures and case.
ENTITY_TYPES = ("oeuvre", "expression", "manifestation", "identite publique de personne", "collectivite", "valeur controlee", "marque", "concept dewey")

_START, _BARE, _QUOTED, _AFTER = range(4)
_TOKEN = re.compile(r'"|;|[\r\n]|[^";\r\n]+')


def _shape(fields: int) -> re.Pattern:
    field = r'(?:"(?:[^"]|"")*"|[^";\r\n]*)'
    return re.compile(rf"{field}(?:;{field}){{{fields - 1}}}", re.S)


def split_record(line: str) -> list[str]:
    """The fields of a well-quoted record."""
    out, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            end = at + 1
            while True:
                end = line.index('"', end)
                if line[end : end + 2] != '""':
                    break
                end += 2
            out.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find(";", at)
            end = n if end < 0 else end
            out.append(line[at:end])
            at = end
        if at >= n:
            return out
        at += 1


def cheapest_edits(line: str, fields: int = 3) -> tuple[int, list[str]] | None:
    """(cost, edits) of the cheapest parse of a record as so many fields, or None if line breaks
    outside of quotes leave none. Among parses of one cost, that with the later edits counts: what stands before
    an error is taken as meant."""
    n_states = 4 * fields
    far = 1 << 100
    # An edit costs one; the later it stands, the smaller a fraction is added.
    unit = len(line) + 2
    edit = lambda at: unit * unit + (unit - at)
    tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(line)]

    def step(state: int, kind: str) -> int:
        """The state after a symbol, or -1."""
        f, s = divmod(state, 4)
        if kind == '"':
            return 4 * f + (_QUOTED if s in (_START, _AFTER) else _AFTER) if s != _BARE else -1
        if s == _QUOTED:
            return state
        if kind == ";":
            return 4 * (f + 1) + _START if f + 1 < fields else -1
        if kind == "x":
            return 4 * f + _BARE if s in (_START, _BARE) else -1
        return -1

    moves = {k: [step(s, k) for s in range(n_states)] for k in ('"', ";", "x", "n")}

    def insertions(cost: list[int], how: list, at: int) -> None:
        """Relax insertions before a symbol: to a later field, or two quotes in a row at most."""
        for _ in range(2 * fields):
            changed = False
            for s in range(n_states):
                if cost[s] < far:
                    for k in ('"', ";"):
                        to = moves[k][s]
                        if to >= 0 and to != s and cost[s] + edit(at) < cost[to]:
                            cost[to], how[to], changed = cost[s] + edit(at), (how[s], f"insert {k} at {at}"), True
            if not changed:
                return

    cost, how = [far] * n_states, [None] * n_states
    cost[_START] = 0
    for at, text in tokens:
        insertions(cost, how, at)
        kind = text if text in '";' else "n" if text in "\r\n" else "x"
        move = moves[kind]
        new, new_how = [far] * n_states, [None] * n_states
        for s in range(n_states):
            c = cost[s]
            if c >= far:
                continue
            if kind in '";' and c + edit(at) < new[s]:
                new[s], new_how[s] = c + edit(at), (how[s], f"delete {kind} at {at}")
            to = move[s]
            if to >= 0 and c < new[to]:
                new[to], new_how[to] = c, how[s]
        cost, how = new, new_how
    insertions(cost, how, len(line))
    ends = [4 * (fields - 1) + s for s in (_START, _BARE, _AFTER)]
    best = min(ends, key=lambda s: cost[s])
    if cost[best] >= far:
        return None
    edits, chain = [], how[best]
    while chain:
        chain, edit = chain
        edits.append(edit)
    return len(edits), edits[::-1]


def normal_type(kind: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", kind) if not unicodedata.combining(c))
    return plain.replace("œ", "oe").replace("Œ", "oe").lower().strip()


class _NotStrict(ValueError):
    pass


def _refuse(name: str) -> None:
    raise _NotStrict(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=str, parse_float=str)
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null')
_SPACE = re.compile(r"[ \t\n\r]*")


def _deep_check(text: str) -> bool:
    """Whether text is an object with an array `zones`, without recursion: for records nested deeper than the decoder goes."""
    at, stack, want, zones, key = 0, [], "value", False, None
    n = len(text)
    while True:
        at = _SPACE.match(text, at).end()
        if want == "end":
            return at == n and zones
        if at >= n:
            return False
        ch = text[at]
        if want in ("value", "value or ]"):
            if ch in "{[":
                if not stack and ch == "[":
                    return False
                if len(stack) == 1 and key == "zones":
                    zones = ch == "["
                stack.append(ch)
                want, at = ("key or }" if ch == "{" else "value or ]"), at + 1
                continue
            if ch == "]" and want == "value or ]":
                stack.pop()
                at += 1
            else:
                m = _SCALAR.match(text, at)
                if not m or not stack:
                    return False
                if len(stack) == 1 and key == "zones":
                    zones = False
                at = m.end()
        elif want in ("key", "key or }"):
            if ch == "}" and want == "key or }":
                stack.pop()
                at += 1
            else:
                m = _SCALAR.match(text, at)
                if not m or ch != '"':
                    return False
                if len(stack) == 1:
                    key = json.loads(m.group())
                at = _SPACE.match(text, m.end()).end()
                if text[at : at + 1] != ":":
                    return False
                want, at = "value", at + 1
                continue
        else:
            if ch == ",":
                want, at = ("key" if stack[-1] == "{" else "value"), at + 1
                continue
            if ch != ("}" if stack[-1] == "{" else "]"):
                return False
            stack.pop()
            at += 1
        want = "next" if stack else "end"


def json_fault(text: str) -> str | None:
    """Why text isn't strict JSON of an object with an array `zones`, or None."""
    try:
        value = _DECODER.decode(text)
    except RecursionError:
        return None if _deep_check(text) else "intermarc: not JSON"
    except ValueError as e:
        return f"intermarc: {e}"
    if not isinstance(value, dict):
        return "intermarc: not an object"
    if not isinstance(value.get("zones"), list):
        return "intermarc: no array zones"
    return None


def examine(line: str | None, fields: int = 3, shape: re.Pattern | None = None) -> tuple[str | None, list[str] | None]:
    """(reason, None) for a record that can't be loaded, (None, fields) for one that can."""
    if line is None:
        return "record: null", None
    if line.endswith("\r"):
        line = line[:-1]
    if not (shape or _shape(fields)).fullmatch(line):
        found = cheapest_edits(line, fields)
        if found is None:
            return "shape: line break outside quotes", None
        return "shape: " + ", ".join(found[1]), None
    values = split_record(line)
    if not re.fullmatch(r"[0-9]+", values[0]):
        return "id: not ASCII digits", None
    if normal_type(values[1]) not in ENTITY_TYPES:
        return "type: none of the known ones", None
    fault = json_fault(values[2])
    return (fault, None) if fault else (None, values)


def _parser(load: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = _shape(3)
        for batch in batches:
            ids, firsts, lines = (batch.column(i).to_pylist() for i in range(3))
            out: list[list] = [[], [], [], [], []]
            for key, first, line in zip(ids, firsts, lines):
                if first:
                    continue
                reason, values = examine(line, shape=shape)
                if load == (values is not None):
                    for col, v in zip(out, (key, reason, *(values or (None, None, None)))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], names=["line_id", "reason", "id_entitelrm", "type_entite", "intermarc"])

    return run


_SCHEMA = "line_id long, reason string, id_entitelrm string, type_entite string, intermarc string"


def _parsed(lines: DataFrame, load: bool) -> DataFrame:
    return lines.selectExpr("line_id", "coalesce(line_no = 1, false) as header", "line").mapInArrow(_parser(load), _SCHEMA)


def load_rows(lines: DataFrame) -> DataFrame:
    """The records of raw lines (line_id, line_no, line) that can be loaded: line_id, id_entitelrm,
    type_entite, intermarc as they stand. Row 1 of a file is its header and skipped. Other columns of
    the input are ignored."""
    return _parsed(lines, True).drop("reason")


def reject_rows(lines: DataFrame) -> DataFrame:
    """The records that can't be loaded, with the reason: line_id, reason.

    A record is rejected if it isn't well-quoted CSV of three fields (`shape:` and the cheapest edits
    that would make it so), if its id isn't ASCII digits (`id:`), its type unknown (`type:`) or its
    intermarc not strict JSON of an object with an array zones (`intermarc:`). A null line is rejected
    (`record: null`), as is an empty one (`shape:`); rows standing twice are judged twice; a null
    line_no is no header. One carriage return at the end isn't part of the record.
    """
    return _parsed(lines, False).select("line_id", "reason")
