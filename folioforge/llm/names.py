"""Variant spellings of names: keys of one person or body are linked.

Method: a symmetric-delete neighbourhood index over the distinct tokens of all names finds the token pairs within
a small edit distance (every token is filed under what is left of it after deleting one or two
letters; tokens that meet in a file are compared). Keys that share a token or hold neighbouring ones
are candidates; their names are then aligned token by token by optimal assignment, which
permits misprints, initials, abbreviations and bynames.

Every token is filed under itself (own) and under the tokens that it may stand for or be shortened to
(borrowed). In names that agree all tokens do, so those that meet under no token of at most `common` keys meet
under a choice of all their tokens (three of them, if there are more); hot tokens are never joined alone. What large
files are left, those of one and the same frequent name, are met in blocks of bounded size.

Bynames and contracted abbreviations are learned from the names themselves: two tokens that stand for each
other in the names of several keys, all else being equal, are aliases.

Where an initial, a shortening or a byname stands on one side, the names are linked if the shortened one can stand for one
person only: if all that it agrees with are linked otherwise. No count of keys decides whether names agree in full.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, permutations, product

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.components import connected_components
from folioforge.llm.confusables import LOOK_ALIKES
from folioforge.operators import authority
from folioforge.session import materialize

#: Words of names that don't tell them apart.
PARTICLES = frozenset(("de", "du", "des", "d", "la", "le", "les", "l", "von", "van", "der", "den", "di", "da", "del", "et", "the", "of", "and", "zu", "zur"))
TITLES = ("abbe",)

_LOOK = {ord(c): to for group, to in LOOK_ALIKES for c in group}
_TOKEN = re.compile(r"[^\W_]+\.?")


class _Plain(dict):
    """Code point -> what stands for it: nothing for combining and invisible characters. Filled as characters are met."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        self[code] = to = None if unicodedata.combining(ch) or unicodedata.category(ch) == "Cf" else ch
        return to


_PLAIN = _Plain(_LOOK | {ord("œ"): "oe", ord("Œ"): "oe", ord("æ"): "ae"})


def plain(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).translate(_PLAIN).lower()


#: The catalogue's honorifics and their abbreviations, single letters aside: those are initials.
HONORIFICS = frozenset(w for pair in authority.HONORIFICS for t in pair if len(w := plain(t).rstrip(".")) > 1) | {*TITLES}


def name_tokens(text: str, body: bool = False) -> list[str]:
    """The tokens that tell a name apart; a final stop marks an abbreviation. Honorifics count in names of bodies."""
    found = _TOKEN.findall(plain(text))
    kept = [t for t in found if t.rstrip(".") not in PARTICLES and (body or t.rstrip(".") not in HONORIFICS)]
    return kept or found


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b, or most + 1. A column of the table is
    held as the bits of two numbers, one for its steps up and one for its steps down."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    every = (1 << len(a)) - 1
    last = 1 << len(a) - 1
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    up, down, level, before, far = every, 0, 0, 0, len(a)
    for ch in b:
        here = at.get(ch, 0)
        swap = ((~level & here) << 1) & before
        level = (((here & up) + up) ^ up | here | down | swap) & every
        plus, minus = (down | ~(level | up)) & every, level & up
        far += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & every, minus << 1 & every
        up, down, before = (minus | ~(level | plus)) & every, plus & level, here
    return min(far, most + 1)


@lru_cache(1 << 16)
def letters(token: str) -> int:
    """Which letters a token holds, as bits; rare ones share bits."""
    out = 0
    for ch in token:
        out |= 1 << ord(ch) % 61
    return out


def reach(token: str) -> int:
    """How many edits a token of this length may differ by."""
    return 0 if len(token) < 4 else 1 if len(token) < 8 else 2


def assign(cost: list[list[float]]) -> tuple[float, list[int]]:
    """Optimal assignment of rows to columns (as many or more): (total, column of each row)."""
    n, m, far = len(cost), len(cost[0]), float("inf")
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [far] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], far, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    place = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            place[match[j] - 1] = j - 1
    return sum(cost[i][place[i]] for i in range(n)), place


_NEVER = 1000.0


class Named:
    """The names of one key, ready to be compared: its forms, those of the same tokens once; readings adds those with two neighbouring
    tokens as one; tokens are those of either."""

    def __init__(self, forms: list[list[str]]) -> None:
        once = lambda found: list({tuple(sorted(f)): f for f in reversed(found)}.values())[::-1]
        self.forms = once(forms)
        self.joined = once([j for f in forms for j in joinings(f)])
        self.tokens = list({t: None for f in (*self.forms, *self.joined) for t in f})


class Matcher:
    """Compares names. info: token -> (number of keys that hold it, aliases), the same in every pair; costs are kept for the next one."""

    def __init__(self, info: dict[str, tuple[int, frozenset[str]]]) -> None:
        self.info, self.more = info, {}
        self.costs: dict[tuple[str, str], float] = {}

    def _known(self, token: str) -> tuple[int, frozenset[str]]:
        return self.info.get(token) or self.more.get(token) or (1, frozenset())

    def keys_of(self, token: str) -> int:
        return self._known(token)[0]

    def aliases(self, token: str) -> frozenset[str]:
        return self._known(token)[1]

    def kept_cost(self, t: str, u: str) -> float:
        found = self.costs.get((t, u))
        if found is None:
            if len(self.costs) > 1 << 19:
                self.costs.clear()
            found = self.costs[t, u] = self.cost(t, u)
        return found

    def cost(self, t: str, u: str) -> float:
        """0 for the same token, under 1 for a shortening or alias, 1 or 2 for misprints."""
        if t == u:
            return 0.0
        a, b = t.rstrip("."), u.rstrip(".")
        if a == b:
            return 0.0
        if len(a) > len(b):
            a, b, t, u = b, a, u, t
        if len(a) == 1:
            return 0.5 if b[0] == a or any(x[0] == a for x in self.aliases(b)) else _NEVER
        if b in self.aliases(a) or a in self.aliases(b):
            return 0.5
        if b.startswith(a) and t.endswith("."):
            return 0.5
        n, m = self.keys_of(a), self.keys_of(b)
        n, m = min(n, m), max(n, m)
        # Two tokens that both are well established are two names, not a name and its shortening or misprint.
        if len(a) < 3 or n >= 5 and n * 10 >= m:
            return _NEVER
        if len(b) - len(a) >= 2 and (b.startswith(a) or len(a) >= 4 and b.endswith(a)):
            return 0.5
        most = min(max(reach(a), 1), reach(b))
        # A letter that only one of them holds takes an edit.
        held, other = letters(a), letters(b)
        if len(b) - len(a) > most or (held & ~other).bit_count() > most or (other & ~held).bit_count() > most:
            return _NEVER
        d = edit_distance(a, b, most)
        return float(d) if d <= most else _NEVER

    def judge(self, one: list[str], two: list[str], most: float) -> int:
        """-1 if the names differ, 0 if they agree token by token, misprints aside; if a token agrees as an initial, a shortening or a
        byname, the sides that are shortened: 1, 2 or both (3)."""
        if len(one) != len(two):
            return -1
        if sorted(one) == sorted(two):
            return 0
        costs = []
        for t in one:
            costs.append([self.kept_cost(t, u) for u in two])
            if min(costs[-1]) > most:
                return -1
        total, place = assign(costs)
        if total > most:
            return -1
        # Something must stand in full on both sides; what is shortened may be of several persons.
        full = [(i, j) for i, j in enumerate(place) if costs[i][j] in (0.0, 1.0, 2.0) and min(len(one[i]), len(two[j])) >= 4]
        if not full:
            return -1
        count = lambda t: self.keys_of(t.rstrip("."))
        if all(costs[i][j] != 0.5 for i, j in enumerate(place)):
            return 0
        short = 0
        for i, j in enumerate(place):
            if costs[i][j] == 0.5:
                a, b = len(one[i].rstrip(".")), len(two[j].rstrip("."))
                aliases = two[j].rstrip(".") in self.aliases(one[i].rstrip("."))
                if aliases:
                    a, b = count(one[i]), count(two[j])
                short |= (a <= b) | (b <= a) << 1
        return short

    def align(self, one: list[str], two: list[str], most: float) -> bool:
        return self.judge(one, two, most) == 0

    def grade(self, one: Named, two: Named, most: float = 3.0) -> int:
        """The best that judge() finds among the forms of two keys: 0, then a side that is shortened, then both; -1 if none agree.
        Forms of which a token has no counterpart in any form of the other key are passed over."""
        cost = self.kept_cost
        able = {t for t in one.tokens if any(cost(t, u) <= most for u in two.tokens)}
        if not able:
            return -1
        fits = lambda forms: [f for f in forms if all(t in able for t in f)]
        plain, joined = fits(one.forms), fits(one.joined)
        best = -1
        for x, y in ((plain, two.forms), (plain, two.joined), (joined, two.forms)):
            for a in x:
                for b in y:
                    found = self.judge(a, b, most) if len(a) == len(b) else -1
                    if found == 0:
                        return 0
                    if found > 0:
                        best = found if best < 0 else min(best, found)
        return best

    def same(self, one: list[list[str]], two: list[list[str]], most: float = 3.0) -> bool:
        return self.grade(Named(one), Named(two), most) >= 0


def joinings(form: list[str]) -> Iterator[list[str]]:
    """A form with two neighbouring tokens read as one."""
    for i in range(len(form) - 1):
        if "." not in form[i]:
            yield [*form[:i], form[i] + form[i + 1], *form[i + 2 :]]


def usable(forms: list[list[str]]) -> list[list[str]]:
    """The forms of one key to compare: those of one token only if there are no others, those with initials
    only if no form is in full."""
    forms = [f for f in forms if len(f) > 1] or forms
    full = [f for f in forms if all(len(t.rstrip(".")) > 1 for t in f)]
    return full or forms


def _years(text: str | None) -> tuple[str, str]:
    """Birth and death of `1900-1980`, each '' unless it is a full year."""
    m = re.match(r"\s*([^-–]*)[-–]([^-–]*)$", text or "")
    return tuple(y.strip() if re.fullmatch(r"\s*\d{4}\s*", y) else "" for y in (m.groups() if m else ("", "")))


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, kinds, years, heads = (batch.column(i).to_pylist() for i in range(5))
        out: list[list] = [[], [], [], [], [], []]
        for key, text, kind, year, head in zip(keys, texts, kinds, years, heads):
            tokens = name_tokens(text, kind == "body")
            if tokens:
                for col, v in zip(out, (key, " ".join(tokens), kind, *_years(year), head)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in out[:5]), pa.array(out[5], pa.bool_())], names=["key", "form", "kind", "born", "died", "head"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (batch.column(i).to_pylist() for i in range(2))
        keep = [edit_distance(a, b) <= min(reach(a), reach(b)) for a, b in zip(one, two)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the names: by sort and merge, never by broadcast, which takes a table through the driver's memory.
    Spark would judge them by the size of their files, and dictionaries make those of tokens far smaller than their rows."""
    return left.join(right.hint("merge"), on, how)


def deletions(token: str) -> set[str]:
    """A token and what is left of it without as many letters as it may differ by: the files it stands in."""
    out, edge = {token}, {token}
    for _ in range(reach(token)):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def _file_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        files, ends = [], [0]
        for token in batch.column(1).to_pylist():
            files += [digest(rest) - (1 << 63) for rest in deletions(token)]
            ends.append(len(files))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(files, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "files"])


def neighbours(tokens: DataFrame) -> DataFrame:
    """(one, two): the pairs one < two of a table of distinct tokens (column token) within reach of each other.

    A file holds distinct tokens that are a letter or two longer than its name, so its size is bounded by the alphabet, not
    by the rows. Only pairs that may owe their nearness to a swap of neighbouring letters, which the built-in distance
    counts as two edits, go through Python."""
    keyed = tokens.select("token", F.xxhash64("token").alias("id"))
    files = keyed.select("id", "token").mapInArrow(_file_tokens, "id long, files array<long>").select("id", F.explode("files").alias("file"))
    met = merged(files, files.select("file", F.col("id").alias("id2")), "file").filter("id < id2").select("id", "id2").distinct()
    # Tokens of one number, should there be any, all come back here and are compared.
    back = merged(merged(met, keyed.select("id", F.col("token").alias("x")), "id"), keyed.select(F.col("id").alias("id2"), F.col("token").alias("y")), "id2")
    most = F.when(F.least(F.length("one"), F.length("two")) < 4, 0).when(F.least(F.length("one"), F.length("two")) < 8, 1).otherwise(2)
    near = back.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")).withColumn("most", most).withColumn("d", F.levenshtein("one", "two", 4)).filter("d >= 0 and d <= 2 * most")
    told = materialize(near.distinct(), "near")
    return told.filter("d <= most").select("one", "two").unionByName(told.filter("d > most").select("one", "two").mapInArrow(_close, "one string, two string"))


def _swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key, the tokens that stand for one another in its first and another form."""
    bare = Matcher({})
    for batch in batches:
        found: list[tuple[str, str]] = []
        for head, forms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            first = head.replace(".", "").split(" ")
            seen = set()
            for form in forms:
                other = form.replace(".", "").split(" ")
                a, b = list(first), []
                for t in other:
                    if t in a:
                        a.remove(t)
                    else:
                        b.append(t)
                if a and len(b) == 1 and len(a) <= 2 and len(first) > len(a):
                    t, u = "".join(a), b[0]
                    if min(len(t), len(u)) > 1 and bare.cost(t, u) == _NEVER:
                        seen.add((t, u))
            found += seen
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([u for _, u in found], pa.string())], names=["t", "u"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Keys come in many pairs: what is read of one is kept for the next.
    names = lru_cache(1 << 14)(lambda forms: Named(usable([f.split(" ") for f in forms.split("\n")])))
    known = lru_cache(1 << 14)(_read_info)
    matcher = Matcher({})
    for batch in batches:
        short = []
        for forms_a, forms_b, info_a, info_b in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            matcher.info, matcher.more = known(info_a), known(info_b)
            short.append(matcher.grade(names(forms_a), names(forms_b)))
        graded = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(short, pa.int32())], names=["a", "b", "short"])
        yield graded.filter(pa.array([x >= 0 for x in short], pa.bool_()))


def _read_info(info: str | None) -> dict[str, tuple[int, frozenset[str]]]:
    out = {}
    for entry in (info or "").split("\n"):
        token, n, *aliases = (entry or " 1").split(" ")
        out[token] = (int(n or 1), frozenset(aliases))
    return out


def name_groups(links: DataFrame, who: DataFrame) -> DataFrame:
    """(key, root, sure) of each linked key: its group, and whether no two keys of it have different full years."""
    member = merged(connected_components(links).select(F.col("node").alias("key"), "root"), who.select("key", "born", "died"), "key")
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    one = lambda c: F.coalesce(F.min(known(c)) == F.max(known(c)), F.lit(True))
    sure = member.groupBy("root").agg((one("born") & one("died")).alias("sure"))
    return merged(member, sure, "root").select("key", "root", "sure")


def pairs_of(groups: DataFrame, links: DataFrame, block: int = 1000) -> DataFrame:
    """All pairs a < b of keys of one group, in blocks of bounded size; of groups that aren't sure only the links themselves."""
    sure = groups.filter("sure")
    parts = sure.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    one = merged(sure, parts, "root").select("root", F.col("key").alias("a"), "parts")
    two = one.select("root", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    pairs = merged(one.withColumn("block", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")), two, ["root", "block"]).filter("a < b").select("a", "b")
    return pairs.unionByName(merged(links, groups.filter("not sure").select(F.col("key").alias("a")), "a", "left_semi"))


def _pieces(token: Column, lengths: list[int]) -> Column:
    """What a token may be shortened to, of the lengths that tokens have: its beginnings, its ends of four letters or more, and for one
    of four letters those without one of them."""
    n = F.length(token)
    sizes = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k < n)
    ends = F.transform(F.filter(sizes, lambda k: (k >= 4) & (k <= n - 2)), lambda k: F.right(token, k))
    without = F.when(n == 4, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(sizes, lambda k: F.left(token, k)), ends, without))


def _joint_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of a form, as it is and with two neighbouring tokens as one: every choice of a feature of each of its tokens (of three
    of them, if it has more), of which one at least is common and none has a file of its own for all that share it; with the number of tokens. Side: which
    of the features are borrowed, as bits in their order, and 8 for tokens read as one."""
    for batch in batches:
        keys, files, sides = [], [], []
        for key, k, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = [p for p in parts if p["width"] == 1]
            readings = [(k, 0, own)]
            for i in range(k - 1):
                readings.append((k - 1, 8, [p for p in own if p["pos"] not in (i, i + 1)] + [p for p in parts if p["width"] == 2 and p["pos"] == i]))
            out = set()
            for n, joined, held in readings:
                feats = [[(f["feature"], f["borrowed"], f["hot"]) for f in p["feats"] if f["lent"] or not f["solo"]] for p in held]
                for some in combinations(feats, min(n, 3)):
                    for chosen in product(*some):
                        if any(f[2] for f in chosen):
                            chosen = sorted(chosen)
                            name = "+".join(f[0] for f in chosen)
                            # Tokens of one feature may change places.
                            for bits in {tuple(f[1] for f in x) for x in permutations(chosen) if [f[0] for f in x] == [f[0] for f in chosen]}:
                                out.add((f"{n}+{name}", sum(b << i for i, b in enumerate(bits)) | joined))
            for name, side in out:
                keys.append(key)
                files.append(xxhash.xxh3_64_intdigest(name) - (1 << 63))
                sides.append(side)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(sides, pa.int32()), pa.array(keys, pa.string())], names=["file", "side", "key"])


def _clear(graded: DataFrame) -> DataFrame:
    """The links (a, b) of those graded (a, b, short): all that agree, and shortened names where all that they agree with are linked."""
    sure = graded.filter("short = 0").select("a", "b")
    if graded.filter("short > 0").isEmpty():
        return sure
    group = materialize(connected_components(sure).select(F.col("node").alias("key"), "root"), "agreeing")
    weak = graded.filter("short > 0")
    for side in ("a", "b"):
        weak = merged(weak, group.select(F.col("key").alias(side), F.col("root").alias(f"r_{side}")), side, "left").withColumn(f"r_{side}", F.coalesce(f"r_{side}", side))
    weak = materialize(weak, "shortened")
    sides = weak.filter("short % 2 = 1").select(F.col("r_a").alias("r"), F.col("r_b").alias("o")).unionByName(weak.filter("short >= 2").select(F.col("r_b").alias("r"), F.col("r_a").alias("o")))
    vague = materialize(sides.filter("r <> o").groupBy("r").agg(F.min("o").alias("x"), F.max("o").alias("y")).filter("x <> y").select("r"), "vague")
    of = lambda side: vague.select(F.col("r").alias(f"r_{side}"), F.lit(True).alias(f"v_{side}"))
    told = merged(merged(weak, of("a"), "r_a", "left"), of("b"), "r_b", "left")
    clear = told.filter("not (short % 2 = 1 and v_a is not null) and not (short >= 2 and v_b is not null)").select("a", "b")
    return sure.unionByName(clear)


def link_names(names: DataFrame, common: int = 200, alias_support: int = 2, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(links, groups): links are the pairs (a, b), a < b, of keys whose names agree; groups (key, root, sure) has the group of
    each linked key, see name_groups. pairs_of(groups, links) gives all pairs of a group where they are asked for.

    names: key, text, kind ('person', 'body' or ''), years (of life, as `1900-1980`) and head (whether the
    text is the key's heading). Keys of known different kinds, and keys with different full years of
    birth or of death, are never linked directly. Null keys and blank texts are no names; repeated rows change
    nothing; a key without any usable name is linked to none; other columns are ignored. `common` only says under
    what files names meet, never whether they agree; `block` how many keys of a large file meet in one task.
    """
    filled = names.filter("key is not null and text rlike '[^\\\\s]'").select("key", "text", F.coalesce("kind", F.lit("")).alias("kind"), "years", F.coalesce("head", F.lit(False)).alias("head")).distinct()
    forms = materialize(filled.mapInArrow(_tokenise, "key string, form string, kind string, born string, died string, head boolean"), "forms")
    profile = materialize(
        forms.groupBy("key").agg(
            F.sort_array(F.collect_set("form")).alias("forms"), F.max_by("form", F.struct("head", "form")).alias("head"), F.max("kind").alias("kind"), F.max("born").alias("born"), F.max("died").alias("died")
        ),
        "profiles",
    )
    swaps = profile.select("head", "forms").mapInArrow(_swaps, "t string, u string").groupBy("t", "u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= alias_support)
    aliases = swaps.select(F.col("t").alias("token"), F.col("u").alias("alias")).unionByName(swaps.select(F.col("u").alias("token"), F.col("t").alias("alias"))).groupBy("token").agg(F.collect_set("alias").alias("aliases"))

    words = F.split(F.regexp_replace("form", r"\.", ""), " ")
    joined = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.get("w", i + 1)))
    split = forms.select("key", words.alias("w"))
    held = materialize(
        split.select("key", F.explode("w").alias("token"), F.lit(True).alias("own"))
        .unionByName(split.filter("size(w) > 1").select("key", F.explode(joined).alias("token"), F.lit(False).alias("own")))
        .groupBy("key", "token").agg(F.max("own").alias("own")),
        "held",
    )
    tokens = materialize(merged(held.groupBy("token").agg(F.count_if("own").alias("n")), aliases, "token", "left"), "tokens")
    # Per key: what is known of its tokens, for the comparison.
    info = merged(held, tokens, "token").groupBy("key").agg(F.array_join(F.collect_list(F.concat_ws(" ", "token", F.greatest("n", F.lit(1)).cast("string"), "aliases")), "\n").alias("info"))
    known = materialize(merged(profile, info, "key", "left"), "known")

    # Features of each token: itself, and (borrowed) what it may stand for. Of tokens that stand for each other the rarer one borrows.
    real = tokens.filter("n > 0").select("token", "n")
    full = real.filter("length(token) >= 4").select("token")
    pairs_of = neighbours(full).unionByName(swaps.select(F.col("t").alias("one"), F.col("u").alias("two"))).filter("one <> two")
    counted = merged(merged(pairs_of, real.toDF("one", "n1"), "one"), real.toDF("two", "n2"), "two")
    first_rarer = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("one") > F.col("two")))
    stands = counted.select(F.when(first_rarer, F.col("one")).otherwise(F.col("two")).alias("token"), F.when(first_rarer, F.col("two")).otherwise(F.col("one")).alias("feature"))
    lengths = sorted(r[0] for r in real.select(F.length("token")).distinct().collect())
    initials = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.left(x, F.lit(1)))
    pieces = tokens.filter("n > 0").select("token", F.explode(F.array_distinct(F.concat(_pieces(F.col("token"), lengths), initials))).alias("feature"))
    shorter = merged(pieces, real.select(F.col("token").alias("feature")), "feature", "left_semi")
    features = (
        real.select("token", F.col("token").alias("feature"), F.lit(0).alias("borrowed"), F.lit(1).alias("full"))
        .unionByName(stands.select("token", "feature", F.lit(1).alias("borrowed"), F.lit(1).alias("full")))
        .unionByName(shorter.select("token", "feature", F.lit(1).alias("borrowed"), F.lit(0).alias("full")))
        .filter("feature <> token or borrowed = 0").groupBy("token", "feature").agg(F.min("borrowed").alias("borrowed"), F.max("full").alias("full"))
    ).withColumn("full", (F.col("full") == 1) & (F.least(F.length("token"), F.length("feature")) >= 4))
    features = materialize(features, "features")
    # Tokens that are shortened to a rare one don't stand in its own file: it meets them beside common tokens.
    lent = features.filter("borrowed = 1 and not full").select("feature", F.lit(True).alias("lent")).distinct()
    sized = materialize(
        merged(merged(features, real.select(F.col("token").alias("feature"), F.col("n").alias("size")), "feature"), lent, "feature", "left")
        .select(
            "token", "feature", "borrowed", (F.col("full") & (F.col("size") <= common)).alias("solo"), (F.col("full") & (F.col("size") > common)).alias("hot"), (F.coalesce("lent", F.lit(False)) & (F.col("borrowed") == 0)).alias("lent"),
        ),
        "sized",
    )
    alone = merged(held, sized.filter("solo"), "token").select(F.xxhash64("feature").alias("file"), F.col("borrowed").bitwiseOR(F.when(F.col("own"), 0).otherwise(8)).alias("side"), "key")
    # Forms of short tokens only meet as they are: nothing in them may be misprinted or stand for something else.
    short = split.filter(~F.exists("w", lambda t: F.length(t) >= 4)).select(F.xxhash64(F.array_join(F.array_sort("w"), " "), F.lit("short")).alias("file"), F.lit(0).alias("side"), "key")
    # The rest: each common feature with each other one of the same form.
    of_token = sized.groupBy("token").agg(F.collect_list(F.struct("feature", "borrowed", "solo", "hot", "lent")).alias("feats"), F.max("hot").alias("hot"))
    each = split.select("key", F.array_join("w", " ").alias("form"), "w").distinct().withColumn("k", F.size("w"))
    placed = each.select("key", "form", "k", F.lit(1).alias("width"), F.posexplode("w").alias("pos", "token")).unionByName(
        each.filter("k > 1").select("key", "form", "k", F.lit(2).alias("width"), F.posexplode(joined).alias("pos", "token"))
    )
    parts = merged(placed, of_token, "token").groupBy("key", "form", "k").agg(F.collect_list(F.struct("pos", "width", "feats")).alias("parts"), F.max("hot").alias("hot"))
    paired = parts.filter("hot").select("key", "k", "parts").mapInArrow(_joint_files, "file long, side int, key string")
    filed = materialize(alone.unionByName(short).unionByName(paired).distinct(), "filed")

    side = lambda s: known.select(F.col("key").alias(s), F.array_join("forms", "\n").alias(f"forms_{s}"), F.col("info").alias(f"info_{s}"))
    who = known.select("key", "kind", "born", "died")
    # A large file is met in blocks: its keys on the left are spread over some, on the right they stand in each.
    parts = filed.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).filter("parts > 1")
    card = merged(filed.join(parts, "file", "left").withColumn("parts", F.coalesce("parts", F.lit(1))), who, "key")
    other = card.select("file", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), *(F.col(c).alias(f"_{c}") for c in ("side", "key", "kind", "born", "died")))
    card = card.withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    agree = lambda c: (F.col(c) == "") | (F.col(f"_{c}") == "") | (F.col(c) == F.col(f"_{c}"))
    pairs = merged(card, other, ["file", "block"]).filter((F.col("key") < F.col("_key")) & (F.col("side").bitwiseAND(F.col("_side")) == 0) & agree("kind") & agree("born") & agree("died")).select(F.col("key").alias("a"), F.col("_key").alias("b")).distinct()
    both = merged(merged(materialize(pairs, "pairs"), side("a"), "a"), side("b"), "b")
    graded = both.select("a", "b", "forms_a", "forms_b", "info_a", "info_b").mapInArrow(_compare, "a string, b string, short int")
    links = materialize(_clear(materialize(graded, "graded")), "links")
    return links, materialize(name_groups(links, who), "groups")
