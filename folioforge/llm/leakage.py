"""Evaluation texts leaking into training text.

Method: spaced-seed hashing. Fixed masks select some of a window's token positions and ignore the others; the
hashes of the selected tokens are joined between items and documents, so a misprint under an ignored
position costs nothing. Around each hit the two texts are aligned with tolerance for substituted, stray and
missing words, and the item's words found this way are counted.

Items are the stated query set: they go to the documents in blocks of bounded size, each broadcast as a
whole, and every document is read whole. Documents are never shuffled or collected.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.confusables import LOOK_ALIKES
from folioforge.llm.names import edit_distance, reach

#: The masks: token positions that count.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 7), (0, 1, 3, 5, 6), (0, 2, 3, 6, 8))
#: Documents are searched some at a time: so many tokens, with gaps wider than any mask.
CHUNK, GAP = 200_000, 16
#: Scripts written without spaces: each of their characters is a token, two of them count as a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_IS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(r"\S+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐]\n\s*(?=[^\W\d_])")
_END = re.compile(r"[.!?…。！？।؟]['\"»”’)\]]*$")


def _drop_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(ch := chr(c)) or unicodedata.category(ch) == "Cf"}
    table |= {ord(c): to for group, to in LOOK_ALIKES for c in group}
    return table | {ord("œ"): "oe", ord("Œ"): "oe", ord("æ"): "ae", ord("Æ"): "ae", ord("ß"): "ss"}


_TABLE = _drop_table()
_BEYOND = re.compile(r"[^\x00-\x7f]+")


def plain(text: str) -> str:
    """Lower case without accents, invisible characters, look-alikes and words broken at line ends."""
    text = _BROKEN.sub("", text) if "\n" in text else text
    if text.isascii():
        return text.lower()
    return _BEYOND.sub(lambda m: m.group().translate(_TABLE), unicodedata.normalize("NFKD", text)).lower()


class Item:
    """An item's tokens, the word of each, and where its sentences end."""

    def __init__(self, key: int, text: str) -> None:
        self.key = key
        self.tokens: list[str] = []
        self.word: list[int] = []
        self.ends: set[int] = set()  # words that end a sentence
        self.n_words = 0
        for m in _WORD.finditer(plain(text)):
            found = _TOKEN.findall(m.group())
            if found:
                self.tokens += found
                half = 0  # of a word of an unspaced script
                for i, t in enumerate(found):
                    unspaced = bool(_IS_UNSPACED.match(t))
                    if i and (unspaced or half) and half != 1:
                        self.n_words += 1
                    half = half % 2 + 1 if unspaced else 0
                    self.word.append(self.n_words)
                if _END.search(m.group()):
                    self.ends.add(self.n_words)
                self.n_words += 1
        self.formula = np.zeros(self.n_words, bool)


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2 or a.isdigit() and b.isdigit():
        return False
    if a[0] != b[0] and a[-1] != b[-1]:  # a misprint spares one end at least
        return False
    return _misprint(a, b)


@lru_cache(1 << 16)
def _misprint(a: str, b: str) -> bool:
    return edit_distance(a, b, 2) <= max(1, reach(a))


def _extend(doc: list[str], item: list[str], d: int, i: int, step: int, found: set[int]) -> tuple[int, int]:
    """Follow doc and item from (d, i) in one direction while they agree; adds the item's tokens found. Returns where it ended."""
    n_doc, n_item = len(doc), len(item)
    last_d, last_i = d - step, i - step

    def same(x: int, y: int) -> bool:
        return 0 <= x < n_doc and 0 <= y < n_item and _alike(doc[x], item[y])

    while 0 <= d < n_doc and 0 <= i < n_item:
        if _alike(doc[d], item[i]):
            found.add(i)
            last_d, last_i = d, i
            d, i = d + step, i + step
            continue
        # A word written apart or together.
        for da, ia in ((2, 1), (1, 2)):
            longer, part = (item[i], doc[d]) if da == 2 else (doc[d], item[i])
            if not (longer.startswith(part) if step > 0 else longer.endswith(part)):
                continue
            x = "".join(doc[d + k * step] for k in (range(da) if step > 0 else range(da - 1, -1, -1)) if 0 <= d + k * step < n_doc)
            y = "".join(item[i + k * step] for k in (range(ia) if step > 0 else range(ia - 1, -1, -1)) if 0 <= i + k * step < n_item)
            if x == y:
                found.update(i + k * step for k in range(ia))
                last_d, last_i = d + (da - 1) * step, i + (ia - 1) * step
                d, i = d + da * step, i + ia * step
                break
        else:
            # A substituted, a stray or a missing word, or two: the text has to go on with two words that agree.
            for da, ia in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)):
                if same(d + da * step, i + ia * step) and same(d + (da + 1) * step, i + (ia + 1) * step):
                    d, i = d + da * step, i + ia * step
                    break
            else:
                break
    return last_d, last_i


class Index:
    """The spaced seeds of a block of items."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.ids: dict[str, int] = {}
        for it in items:
            for t in it.tokens:
                self.ids.setdefault(t, len(self.ids) + 1)
        # Items that are too short to hold a window of each mask are sought whole.
        self.short = {k: n for k, it in enumerate(items) if 0 < (n := len(it.tokens)) <= MASKS[-1][-1]}
        self.masks = (*MASKS, *(tuple(range(n)) for n in sorted(set(self.short.values()))))
        self.factors = np.random.default_rng(7).integers(1, 2**63, size=(len(self.masks), 8), dtype=np.uint64) | np.uint64(1)
        parts: list[list[np.ndarray]] = [[], [], []]
        for k, it in enumerate(items):
            ids = np.fromiter((self.ids[t] for t in it.tokens), np.uint64, len(it.tokens))
            for m in range(len(self.masks)):
                if m >= len(MASKS) and len(self.masks[m]) != self.short.get(k):
                    continue
                h, ok = self.seeds(ids, m)
                parts[0].append(h[ok])
                parts[1].append(np.full(int(ok.sum()), k))
                parts[2].append(np.flatnonzero(ok))
        hashes = np.concatenate(parts[0]) if parts[0] else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item, self.at = (np.concatenate(p)[order] if p else np.zeros(0, int) for p in parts[1:])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.hashes >> np.uint64(44)] = True

    def seeds(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the masked window at each position, and whether all its selected tokens are known."""
        n = len(ids) - self.masks[m][-1]
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h, ok = np.full(n, np.uint64(m + 1)), np.ones(n, bool)
        for k, o in enumerate(self.masks[m]):
            part = ids[o : o + n]
            ok &= part > 0
            h = (h ^ (part * self.factors[m, k])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9), ok

    def hits(self, ids: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], set[tuple[int, int]]]:
        """(document, item) -> the pairs (document position, item position) where seeds meet; starts: where documents begin."""
        out: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for m in range(len(self.masks)):
            h, ok = self.seeds(ids, m)
            places = np.flatnonzero(ok & self.sieve[h >> np.uint64(44)]) if len(h) else np.zeros(0, int)
            if not len(places):
                continue
            lo = np.searchsorted(self.hashes, h[places], "left")
            hi = np.searchsorted(self.hashes, h[places], "right")
            met = hi > lo
            places, lo, hi = places[met], lo[met], hi[met]
            doc = np.searchsorted(starts, places, "right") - 1
            for n, p, a, b in zip(doc.tolist(), (places - starts[doc]).tolist(), lo.tolist(), hi.tolist()):
                for k, i in zip(self.item[a:b].tolist(), self.at[a:b].tolist()):
                    out.setdefault((n, k), set()).add((p, i))
        return out


#: The share of a run's words that must be found: a word here and there may be missing, but a
#: sentence of the same build about other names is no quotation.
DENSITY = 0.87


def _densest(covered: np.ndarray, plain_word: np.ndarray) -> int:
    """Most words, formulas aside, of a stretch that begins and ends with a found word and of which DENSITY is found."""
    at = np.flatnonzero(covered)
    if not len(at):
        return 0
    found, counted = np.concatenate([[0], np.cumsum(covered)]), np.concatenate([[0], np.cumsum(plain_word)])
    first, last = at[:, None], at[None, :]
    length = last - first + 1
    good = (length > 0) & (found[last + 1] - found[first] >= DENSITY * length)
    return int(np.where(good, counted[last + 1] - counted[first], 0).max())


def longest_run(doc: list[str], it: Item, hits: set[tuple[int, int]], least: int = 6, words: int = 0, whole: float = 0.0) -> tuple[int, float]:
    """(words of the longest run of the item found in the document, formulas aside; share of its words found in stretches).
    Stretches of fewer than `least` tokens don't count, unless the item itself is shorter. Where all that is found is too little
    for `words` in a run and for the share `whole`, nothing is put together and 0 is returned for both."""
    least = min(least, len(it.tokens))
    segments: list[tuple[int, int, int, int, set[int]]] = []
    active: list[tuple[int, int, int, int, set[int]]] = []  # those that reach as far as the hit at hand
    short: set[tuple[int, int]] = set()  # places whose alignment is known to be too short
    for d, i in sorted(hits):
        if (d, i) in short:
            continue
        active = [s for s in active if s[3] >= d]
        if any(s[0] <= i <= s[1] and s[2] <= d and abs((d - s[2]) - (i - s[0])) <= 6 for s in active):
            continue
        found: set[int] = set()
        d1, i1 = _extend(doc, it.tokens, d, i, 1, found)
        d0, i0 = _extend(doc, it.tokens, d - 1, i - 1, -1, found)
        if len(found) >= least:
            segments.append((min(i0, i), max(i1, i), min(d0, d), max(d1, d), found))
            active.append(segments[-1])
        else:
            # From any place further on in the same words that agree, the same alignment comes out.
            while d < len(doc) and i < len(it.tokens) and _alike(doc[d], it.tokens[i]):
                short.add((d, i))
                d, i = d + 1, i + 1
    if not segments:
        return 0, 0.0
    held = {it.word[i] for s in segments for i in s[4]}
    counted = sum(not it.formula[w] for w in held)
    if len(held) < DENSITY * words and counted < whole * (it.n_words - int(it.formula.sum())):
        return 0, 0.0
    segments.sort(key=lambda s: s[:4])
    best, plain_word = 0, ~it.formula
    all_found = np.zeros(it.n_words, bool)
    # Chains of segments that follow each other in the item: right behind each other in the document as well, or
    # apart where a sentence of the item ends. Of chains that end at the same word, the longest is carried on.
    by_place: dict[int, np.ndarray] = {}
    by_word: dict[int, tuple[int, np.ndarray]] = {}
    for s in segments:
        covered = np.zeros(it.n_words, bool)
        covered[[it.word[i] for i in s[4]]] = True
        first, last = it.word[s[0]], it.word[s[1]]
        before = [by_place[p] for p in range(s[2] - 5, s[2]) if p in by_place]
        for end in range(first - 4, min(first + 3, last)):
            if end in by_word and any(w in it.ends for w in range(max(0, end - 1), first + 1)):
                before.append(by_word[end][1])
        for b in before:
            if -3 <= first - int(np.flatnonzero(b)[-1]) - 1 <= 3:
                covered = covered | b
        by_place[s[3]] = covered
        words = _densest(covered, plain_word)
        if last not in by_word or words > by_word[last][0]:
            by_word[last] = (words, covered)
        best = max(best, words)
        if words >= min(least, it.n_words):
            all_found |= covered
    return best, float(all_found[plain_word].mean()) if plain_word.any() else 0.0


def _search(block: list[tuple[int, str]], formulas: dict[int, list[int]], words: int, whole: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Item(k, t) for k, t in block]
        for it in items:
            it.formula[formulas.get(it.key, [])] = True
        index = Index(items)
        known = index.ids.get
        for batch in batches:
            docs, found = [], []
            keys, texts = (batch.column(i).to_pylist() for i in range(2))
            at = 0
            while at < len(keys):
                # Some documents at once, with gaps between them that no mask bridges.
                parts, starts, size = [], [], 0
                first = at
                while at < len(keys) and size < CHUNK:
                    tokens = _TOKEN.findall(plain(texts[at]))
                    parts.append(tokens)
                    starts.append(size)
                    size += len(tokens) + GAP
                    at += 1
                ids = np.zeros(size, np.uint64)
                for tokens, s in zip(parts, starts):
                    ids[s : s + len(tokens)] = [known(t, 0) for t in tokens]
                for (n, k), hits in index.hits(ids, np.array(starts)).items():
                    run_words, share = longest_run(parts[n], items[k], hits, words=words, whole=whole)
                    if run_words >= words or share >= whole:
                        docs.append(keys[first + n])
                        found.append((items[k].key, run_words, share))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.float64())],
                names=["doc_id", "item_id", "words", "share"],
            )

    return run


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 20, whole: float = 0.9, block_words: int = 500_000, formula_window: int = 8, formula_share: float = 0.03) -> DataFrame:
    """(doc_id, item_id, words, share): each document and item where the document holds at least `words` words
    on end of the item, or the share `whole` of all its words, intact or recognisable.

    docs: doc_id, text; items: item_id, text. Case, accents, punctuation, line breaks, kinds of characters, misprints and
    single stray or missing words don't matter; the item's sentences may lie apart. Scripts without spaces are compared by
    character, two of which count as a word; items of up to eight tokens are sought as they are. Words of formulas
    (windows of `formula_window` tokens in more than `formula_share` of all items, 5 at least) aren't counted. Null and
    blank texts hold nothing; items or documents that stand twice are reported once; empty tables give
    an empty result. Items are sent in blocks of about block_words words, so any number of them can be searched.
    """
    filled = docs.filter("text is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    out: DataFrame | None = None
    rows = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").distinct()
    common = _formula_windows(rows, formula_window, formula_share)
    block: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal out, block, size
        if block:
            parsed = [Item(k, t) for k, t in block]
            formulas = {it.key: sorted({w for i in range(len(it.tokens) - formula_window + 1) if " ".join(it.tokens[i : i + formula_window]) in common for w in it.word[i : i + formula_window]}) for it in parsed}
            one = filled.mapInArrow(_search(block, formulas, words, whole), "doc_id long, item_id long, words int, share double")
            out = one if out is None else out.unionByName(one)
        block, size = [], 0

    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        size += row[1].count(" ") + 1
        if size >= block_words:
            flush()
    flush()
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, words int, share double")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("share").alias("share"))


def _formula_windows(rows: DataFrame, window: int, share: float) -> set[str]:
    """The windows of tokens in more than the share of all items: at most words-an-item/share of them."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                tokens = _TOKEN.findall(plain(text))
                out += {" ".join(tokens[i : i + window]) for i in range(len(tokens) - window + 1)}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["w"])

    n = rows.count()
    held = rows.select("text").mapInArrow(windows, "w string").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r[0] for r in held.filter(F.col("n") >= max(5, share * n)).select("w").collect()}
