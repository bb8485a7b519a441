"""Sentence boundaries across languages and scripts.

Method: hidden-event n-gram language model. Between the words of a text a boundary token may stand unseen, at
every place where a sentence could end: after a final stop and its closing quotes, and at the spaces
of scripts that don't write stops. The model holds

- P(boundary | what stands left of the place): the word before the stop (an initial or numeral
  with the word before it), the stop, the closing quote and what its quotation followed;
- P(next word | boundary) and P(next word | no boundary), a number with the word after it; both over all
  languages, so that the openings of a rare language weigh alike on either side.

Nothing is labelled. Where a paragraph begins and ends is a boundary for certain, which gives the first
estimate (a word that never ends a paragraph though it often stands before a stop is an
abbreviation); expectation-maximisation over all documents' places gives the rest. Forward-backward posteriors
over a paragraph's places decide: a boundary makes another one right after it unlikely.

The layout comes first: blank lines part blocks; a line break of a block filled up to a common width is only a
space; otherwise lines stand for themselves, and headings and list entries are units whatever they hold.

Counts are gathered in Arrow passes and summed by Spark over all documents. Keys below `min_share` of all
places count under their shape, so the model has at most 1/min_share keys of a kind: that bounds what is sent
to the executors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialize

_PAIRS = {"«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", '"': '"'}
_CLOSERS = set(_PAIRS.values())
_OPENERS = set(_PAIRS)
_OPEN_SIGNS, _CLOSE_SIGNS = "".join(_OPENERS), "".join(_CLOSERS)
#: Final stops, those of scripts whose words or sentences needn't be parted by spaces, and further ones.
_WIDE = "。！？｡．។៕။།༎"
_OTHER = "։፧።᠃᠉‽⁇⁈⁉꓿꘎꘏꛳꛷꡶꡷꣎꣏"
_STOPS = ".!?…।॥؟۔" + _WIDE + _OTHER
_FOREIGN = set(_WIDE[3:] + _OTHER)
_THAI = "฀-๿"
_MARK = re.compile(rf'[{_STOPS};;]+|[«»„“”「」『』《》〈〉()（）\[\]"]|(?<=[{_THAI}0-9])[^\S\n]+(?=[{_THAI}])')
_IN_THAI = re.compile(f"[{_THAI}]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_LETTER = re.compile(r"[^\W\d_]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_FIRST = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*['’]?|\d+")
_ENTRY = re.compile(r"(?:[—–•*·▪‣-]\s|\(?(?:\d{1,4}[.)]|[a-zA-Z]\))\s+\S|(?=\S*\d|\S+ \S*\d)[A-Z0-9][A-Z0-9.\-]*(?: [A-Z]{0,2}-?\d+)?\s+:\s)")
_ENTRY_END = re.compile(r"(?:\d{4}|\bp|\))\.?\s*$|[^.!?…]\s*$")
#: What a wrapping program doesn't break: up to a space, but not a hard one.
_CHUNK = re.compile(r"[^ \t]+")
_ROMAN = re.compile(r"[IVXLCDM]{2,}$")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"[\d.,/°\-–]*\d[\d.,/°\-–]*")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_BROKEN = re.compile(r"[^\W\d_][-\u2010\u00ad]$")
_HEADING = re.compile(r"(?:§|[^\W\d_]+) *(?:\d+|[IVXLC]+)\. ")
#: Lines are wrapped to a width between these; a line may be this much shorter than it had to be.
MIN_WIDTH, MAX_WIDTH, SLACK = 45, 100, 8


def _strip(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def _is_unit(line: str) -> bool:
    """Whether a line is a heading or an entry: one unit whatever it holds."""
    if _ENTRY.match(line):
        return bool(_ENTRY_END.search(line)) or line[0] in "—–•*·▪‣-"
    last = line.rstrip(_CLOSE_SIGNS + "   ")[-1:]
    return len(line) <= 120 and last not in _STOPS + ";;:," and not _IN_THAI.search(line)


def pieces(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is a unit already) of the headings, entries and paragraphs of a text."""
    blocks, at = [], 0
    for m in _BLANK_LINE.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    widest = max((len(x.rstrip()) for x in text.split("\n")), default=0)
    out = []
    for start, end in blocks:
        lines, at = [], start
        for raw in text[start:end].split("\n"):
            s, e = _strip(text, at, at + len(raw))
            if s < e and lines and _BROKEN.search(text, max(lines[-1][0], lines[-1][1] - 2), lines[-1][1]) and text[s].islower():
                lines[-1] = (lines[-1][0], e)  # a word broken at the end of the line
            elif s < e:
                lines.append((s, e))
            at += len(raw) + 1
        if not lines:
            continue
        width = max(e - s for s, e in lines)
        top = widest if widest <= MAX_WIDTH else width
        # What each line had left for the next word. Later edits of a text shift it by a few letters.
        left = [top - (e - s + 1 + len(_CHUNK.match(text, s2, e2).group())) for (s, e), (s2, e2) in zip(lines, lines[1:])]
        entries = sum(bool(_ENTRY.match(text[s:e])) for s, e in lines)
        first = text[slice(*lines[0])]
        head = 1 if left and (left[0] >= SLACK or _HEADING.match(first) and first[-1] not in _STOPS) else 0
        rest = left[head:]
        fits = MIN_WIDTH <= top <= MAX_WIDTH and (len(rest) > 1 or widest <= MAX_WIDTH)
        wrapped = bool(rest) and fits and sum(x < SLACK / 2 for x in rest) >= 0.6 * len(rest) and entries * 2 < len(lines)
        if wrapped:
            if head:
                out.append((*lines[0], _is_unit(text[slice(*lines[0])])))
            out.append((lines[head][0], lines[-1][1], False))
        else:
            out += [(s, e, _is_unit(text[s:e])) for s, e in lines]
    return out


def _right(text: str, at: int, end: int) -> tuple[str, str]:
    """(key, shape) of what follows a place."""
    ch = text[at]
    if ch in _OPENERS:
        return ch, ch
    if ch in "¿¡—–-•":
        return ch, ch
    m = _FIRST.match(text, at, end)
    if not m:
        return ch, "other"
    word = m.group() if m.group().isascii() else unicodedata.normalize("NFKC", m.group())
    if word[0].isdigit():
        after = _FIRST.match(text, m.end() + 1, end)
        return f"9 {after.group().lower() if after and not after.group()[0].isdigit() else ''}", "9"
    if word[0] > "\u2fff" and _CJK.match(word):
        return word[0], "cjk"
    if len(word) == 1 and word.isupper() and text[m.end() : m.end() + 1] == ".":
        return "A.", "A."
    low = word.lower()
    if word[0].isupper():
        return f"{low}^", "Cap"
    return (low, "low") if word[0].islower() else (low, "word")


def _before(word: str) -> str:
    """The class of the word before an initial or a numeral."""
    if not word.isalpha() and _DIGIT.search(word):
        return "9"
    low = word.lower().lstrip(_OPEN_SIGNS)
    return low if len(low) <= 6 else "w"


def _left(text: str, start: int, at: int, stop: str) -> tuple[str, str]:
    """(key, shape) of the word before a stop at a place."""
    stop = "…" if stop.startswith("..") else stop[0]
    if stop in _FOREIGN:  # what is learned of one such stop holds for the others, where they are rare
        return f"stop|{stop}", "cjk|。"
    words = text[max(start, at - 60) : at].split()
    last = words[-1].lstrip(_OPEN_SIGNS) if words else ""
    if not last:
        return f"|{stop}", f"|{stop}"
    if last[-1] in _CLOSERS:
        return f"{last[-1]}|{stop}", f"{last[-1]}|{stop}"
    if last[-1] > "\u2fff" and _CJK.match(last[-1]):
        return f"cjk|{stop}", f"cjk|{stop}"
    before = lambda: _before(words[-2]) if len(words) > 1 else ""
    if len(last) == 1 and not last.isdigit():
        key = "A" if last.isupper() else last
        return f"{before()} {key}|{stop}", f"{'A' if last.isupper() else 'a'}|{stop}"
    if not last.isalpha() and _NUMBER.fullmatch(last):
        return f"{before()} 9|{stop}", f"9|{stop}"
    if last[0] in "IVXLCDM" and _ROMAN.fullmatch(last):
        return f"{before()} X|{stop}", f"X|{stop}"
    if stop != ".":
        return f"{'Cap' if last[0].isupper() else 'low'}|{stop}", f"{'Cap' if last[0].isupper() else 'low'}|{stop}"
    shape = "Cap" if last[0].isupper() else "low" if last[0].islower() else "word"
    return f"{last.lower()}|{stop}", f"{shape}|{stop}"


Place = tuple[int, int, tuple[str, str], tuple[str, str]]


def places(text: str, start: int, end: int) -> tuple[list[Place], tuple[str, str] | None]:
    """The places of a paragraph where a sentence could end: (end, start of what follows, left, right); and
    the left key of the paragraph's own end, if it ends like a sentence."""
    marks = list(_MARK.finditer(text, start, end))
    pair: dict[int, int] = {}
    stack: list[int] = []
    waiting: Counter = Counter()  # how many open marks wait for a closing one
    for i, m in enumerate(marks):
        ch = m.group()
        top = marks[stack[-1]].group() if stack else ""
        if stack and _PAIRS.get(top) == ch:
            pair[stack.pop()] = i
            waiting[ch] -= 1
        elif ch in _OPENERS:
            stack.append(i)
            waiting[_PAIRS[ch]] += 1
        elif ch in _CLOSERS and waiting[ch]:  # closes an outer one: those in between never close and don't count
            while True:
                k = stack.pop()
                waiting[_PAIRS[marks[k].group()]] -= 1
                if _PAIRS[marks[k].group()] == ch:
                    pair[k] = i
                    break
    close = {j: i for i, j in pair.items()}
    out: list[Place] = []
    depth, final, after_stop, opened = 0, None, start, {}
    for i, m in enumerate(marks):
        ch = m.group()
        if i in pair:
            if not depth:
                gap = text[max(start, m.start() - 3) : m.start()].rstrip()
                opened[i] = "S" if m.start() == start or text[after_stop : m.start()].strip() == "" else "C" if gap[-1:] in ":：" else "O"
            depth += 1
            continue
        if i in close:
            depth -= 1
            if depth:
                continue
            inner = text[m.start() - 2 : m.start()].rstrip()[-1:]
            if inner not in _STOPS:
                continue
            key = f"{inner}{ch}{opened[close[i]]}"
            left = (key, key)
        elif depth or ch in _OPENERS or ch in _CLOSERS:
            continue
        elif ch[0].isspace():
            left = ("thai", "thai")
        else:
            if ch[0] in ";;":
                letters = _LETTER.findall(text[max(start, m.start() - 30) : m.start()])
                if not letters or not _GREEK.match(letters[-1]):
                    continue
            left = _left(text, start, m.start(), ch)
        at = m.end()
        if at >= end:
            final = left
            break
        after, _ = _strip(text, at, end)
        wide = ch[0] in _WIDE or i in close and inner in _WIDE
        if after == at and not wide and left[0] != "thai":
            continue
        if text[after] in ",;:)»”」』，；：、،؛!?.…":
            continue
        if left[0] == "thai":
            at = m.start()
        after_stop = at
        out.append((at, after, left, _right(text, after, end)))
    if final is None and _IN_THAI.match(text[end - 1 : end]):
        final = ("thai", "thai")
    return out, final


_EVENTS = "kind string, left string, lshape string, right string, rshape string, n long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for start, end, unit in pieces(text):
                if unit:
                    continue
                gaps, final = places(text, start, end)
                found["start", "", "", *_right(text, start, end)] += 1
                if final:
                    found["end", *final, "", ""] += 1
                for _, _, left, right in gaps:
                    found["gap", *left, *right] += 1
        rows = list(found)
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(5)), pa.array([found[r] for r in rows], pa.int64())], names=["kind", "left", "lshape", "right", "rshape", "n"])


class Model:
    """The language model: parameters by key, with those of the shape behind them."""

    def __init__(self, lefts: frozenset[str], rights: frozenset[str]) -> None:
        self.lefts, self.rights = lefts, rights
        self.boundary: dict[str, float] = {}
        self.opens: dict[str, float] = {}
        self.follows: dict[str, float] = {}
        self.floor = 1e-6

    def keys(self, left: tuple[str, str], right: tuple[str, str]) -> tuple[str, str]:
        return (left[0] if left[0] in self.lefts else left[1], right[0] if right[0] in self.rights else right[1])

    def odds(self, left: tuple[str, str], right: tuple[str, str]) -> tuple[float, float]:
        """(likelihood of what follows with a boundary, without) times the chance of either."""
        lk, rk = self.keys(left, right)
        p = self.boundary.get(lk, self.boundary.get(left[1], 0.5))
        return p * self.opens.get(rk, self.floor), (1 - p) * self.follows.get(rk, self.floor)


def _e_step(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], list[float]] = {}
        for batch in batches:
            for left, lshape, right, rshape, n in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = model.odds((left, lshape), (right, rshape))
                p = n * a / (a + b)
                for kind, x, y in (("l", left, lshape), ("r", right, ""), ("h", lshape, "")):
                    s = sums.setdefault((kind, x, y), [0.0, 0.0])
                    s[0] += p
                    s[1] += n - p
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), *(pa.array([sums[k][i] for k in keys], pa.float64()) for i in range(2))], names=["kind", "x", "y", "b", "nb"]
        )

    return run


def train(texts: DataFrame, min_share: float = 1e-5, least: int = 3, rounds: int = 6, weight: float = 2.0) -> Model:
    """The model of all texts (one column). Keys count for themselves from `least` places on, and from a share
    of min_share of all; the others under their shape."""
    raw = materialize(texts.mapInArrow(_gather, _EVENTS).groupBy("kind", "left", "lshape", "right", "rshape").agg(F.sum("n").alias("n")), "places")
    total = raw.agg(F.sum("n")).first()[0] or 0
    floor = max(least, total * min_share)
    often = lambda c: [r[0] for r in raw.filter(f"{c} <> ''").groupBy(c).agg(F.sum("n").alias("n")).filter(F.col("n") >= floor).select(c).collect()]
    model = Model(frozenset(often("left")), frozenset(often("right")))
    lk = F.when(F.col("nl") >= floor, F.col("left")).otherwise(F.col("lshape"))
    rk = F.when(F.col("nr") >= floor, F.col("right")).otherwise(F.col("rshape"))
    nl, nr = (raw.groupBy(c).agg(F.sum("n").alias(a)) for c, a in (("left", "nl"), ("right", "nr")))
    keyed = materialize(raw.join(nl, "left").join(nr, "right").select("kind", lk.alias("left"), "lshape", rk.alias("right"), "rshape", "n").groupBy("kind", "left", "lshape", "right", "rshape").agg(F.sum("n").alias("n")), "keyed")
    starts = {r[0]: r[1] for r in keyed.filter("kind = 'start'").groupBy("right").agg(F.sum("n")).collect()}
    ends: Counter = Counter()
    shape_ends: Counter = Counter()
    for left, shape, n in keyed.filter("kind = 'end'").groupBy("left", "lshape").agg(F.sum("n")).collect():
        ends[left] += n
        shape_ends[shape] += n
    gaps = keyed.filter("kind = 'gap'").select("left", "lshape", "right", "rshape", "n")
    sizes: Counter = Counter()
    shape_sizes: Counter = Counter()
    maybe = 0
    for left, shape, opens, n in gaps.groupBy("left", "lshape", F.expr("rshape not in ('low', '9')").alias("o")).agg(F.sum("n")).collect():
        sizes[left] += n
        shape_sizes[shape] += n
        maybe += n * opens
    # Boundaries inside paragraphs for each one at a paragraph's end.
    inner = 0.7 * maybe / max(1, sum(ends.values()))
    clip = lambda p: min(0.995, max(0.005, p))
    by_shape = {s: clip((inner * shape_ends[s] + 1) / (shape_sizes[s] + 2)) for s in shape_sizes}
    shape_of = {r[0]: r[1] for r in keyed.filter("left <> ''").select("left", "lshape").distinct().collect()}
    model.boundary = by_shape | {k: clip((inner * ends[k] + weight * by_shape.get(shape_of[k], 0.5)) / (sizes[k] + weight)) for k in sizes}
    n_starts = max(1, sum(starts.values()))
    model.opens = {k: n / n_starts for k, n in starts.items()}
    n_gaps = max(1, sum(sizes.values()))
    model.follows = {r[0]: r[1] / n_gaps for r in gaps.groupBy("right").agg(F.sum("n")).collect()}
    for _ in range(rounds):
        sums = gaps.mapInArrow(_e_step(model), "kind string, x string, y string, b double, nb double").groupBy("kind", "x", "y").agg(F.sum("b"), F.sum("nb")).collect()
        new = Model(model.lefts, model.rights)
        by_kind: dict[str, list] = {}
        for kind, x, y, b, nb in sums:
            by_kind.setdefault(kind, []).append((x, y, b, nb))
        for x, _, b, nb in by_kind.get("h", []):
            new.boundary[x] = clip((b + 1) / (b + nb + 2))
        for x, y, b, nb in by_kind.get("l", []):
            seen, share = b + nb, min(1.0, inner * ends[x] / (b + nb))
            p = clip((b + weight * (share + new.boundary[y])) / (seen + 2 * weight))
            # Paragraphs' ends bound it: a left side that ends none of them, though it stands often, ends few sentences.
            # What follows it may say otherwise; then its odds are lowered, more in each round. Question and
            # exclamation marks abbreviate nothing and aren't bounded.
            most = seen * min(1.0, inner * (ends[x] + 3) / seen)
            if b > most and x[-1] not in "?!؟;;":
                old = min(model.boundary.get(x, p), p)
                p = 1 / (1 + (1 - old) / old * (b / most) ** 2)
            new.boundary[x] = max(p, 1e-9)
        all_b = sum(b for _, _, b, _ in by_kind.get("r", []))
        opened: Counter = Counter(starts)
        for x, _, b, nb in by_kind.get("r", []):
            opened[x] += min(b, inner * (starts.get(x, 0) + 3))  # so do their starts
        new.opens = {k: (v + 0.01) / (all_b + n_starts) for k, v in opened.items()}
        all_nb = sum(nb for _, _, _, nb in by_kind.get("r", []))
        new.follows = {x: (nb + 0.01) / (all_nb + 1) for x, _, _, nb in by_kind.get("r", [])}
        model = new
    return model


#: How likely a sentence of one word is, against what the model says otherwise.
SHORT = 0.1


def _posteriors(chain: list[tuple[float, float]], close: list[bool]) -> list[float]:
    """Forward-backward over the places of a paragraph; close: whether hardly anything stands between a place and the one before."""
    n = len(chain)
    ahead, behind = [], [(1.0, 1.0)] * n
    b, nb = 0.0, 1.0
    for (p, q), near in zip(chain, close):
        t = SHORT if near else 1.0
        b, nb = p * (b * t + nb), q * (b + nb)
        z = (b + nb) or 1.0
        b, nb = b / z, nb / z
        ahead.append((b, nb))
    for i in range(n - 2, -1, -1):
        p, q = chain[i + 1]
        t = SHORT if close[i + 1] else 1.0
        nb2, b2 = p * behind[i + 1][0] + q * behind[i + 1][1], p * t * behind[i + 1][0] + q * behind[i + 1][1]
        z = (nb2 + b2) or 1.0
        behind[i] = (b2 / z, nb2 / z)
    return [a[0] * c[0] / ((a[0] * c[0] + a[1] * c[1]) or 1.0) for a, c in zip(ahead, behind)]


def split_text(text: str, model: Model) -> list[tuple[int, int]]:
    """The sentence units of a text as (start, end)."""
    out = []
    for start, end, unit in pieces(text):
        if unit:
            out.append((start, end))
            continue
        gaps, _ = places(text, start, end)
        chain = [model.odds(left, right) for _, _, left, right in gaps]
        close = [len(text[a:b].split()) < 2 for a, b in zip([start, *(g[1] for g in gaps)], (g[0] for g in gaps))]
        at = start
        for (stop, after, _, _), p in zip(gaps, _posteriors(chain, close)):
            if p > 0.5:
                out.append((at, stop))
                at = after
        out.append((at, end))
    return [(s, e) for s, e in (_strip(text, s, e) for s, e in out) if s < e]


def _split(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s, e in split_text(text, model):
                    keys.append(key)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "sent_start", "sent_end"])

    return run


def sentences(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_start, sent_end): one row per sentence unit, as code-point offsets from 0, end exclusive.

    Trains on the same documents if no model is given. Null, empty and blank texts have no units; rows that
    stand twice are split twice; a null key is kept; texts of any length are split whole.
    """
    filled = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null and text <> ''")
    model = model or train(filled.select("text"))
    return filled.mapInArrow(_split(model), "doc_id long, sent_start int, sent_end int")
