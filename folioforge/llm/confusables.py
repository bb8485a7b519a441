"""Canonical text: one form for texts that look the same.

Method: DuckDB runs inside Arrow partitions; embedded SQL maps invisible characters with a regular
expression, compatibility forms and look-alikes with translate, and composes with nfc_normalize.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones, in the order of the Latin letters.
LOOK_ALIKES = (
    ("АΑ", "A"), ("ВΒ", "B"), ("С", "C"), ("ЕΕ", "E"), ("НΗ", "H"), ("ІΙ", "I"), ("Ј", "J"), ("КΚ", "K"), ("МΜ", "M"), ("Ν", "N"),
    ("ОΟ", "O"), ("РΡ", "P"), ("Ѕ", "S"), ("ТΤ", "T"), ("ХΧ", "X"), ("ҮΥ", "Y"), ("Ζ", "Z"), ("Ԛ", "Q"), ("Ԝ", "W"),
    ("аα", "a"), ("сϲ", "c"), ("ԁ", "d"), ("е", "e"), ("һ", "h"), ("і", "i"), ("јϳ", "j"), ("ӏ", "l"), ("оο", "o"), ("р", "p"), ("ԛ", "q"),
    ("ѕ", "s"), ("ν", "v"), ("ԝ", "w"), ("х", "x"), ("у", "y"), ("ı", "i"), ("ɡ", "g"), ("ɑ", "a"),
)
#: Ranges whose one-character compatibility forms are mapped: letterlike forms of fonts, presentation forms, widths.
_FORMS = ((0x2100, 0x214F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0xFF01, 0xFFEF), (0x1D400, 0x1D7FF))
_SEEN_AS_SAME = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Signs that look like several letters.
_SEVERAL = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("Ǉ", "LJ"), ("ǉ", "lj"), ("Ǌ", "NJ"), ("ǌ", "nj"), ("…", "..."))
#: What has no width: soft hyphen, joiners, marks of direction, variation selectors, fillers, tags.
_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
_SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _single() -> tuple[str, str]:
    table = {c: to for group, to in LOOK_ALIKES for c in group}
    for lo, hi in _FORMS:
        for code in range(lo, hi + 1):
            ch = chr(code)
            kind = unicodedata.decomposition(ch).split(" ")[0]
            to = unicodedata.normalize("NFKC", ch)
            if kind in _SEEN_AS_SAME and len(to) == 1:
                table[ch] = table.get(to, to)
    # Letters with accents: the look-alike of the bare letter with the same accents.
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] in table:
            to = unicodedata.normalize("NFC", table[parts[0]] + parts[1:])
            if len(to) == 1:
                table[ch] = to
    return "".join(table), "".join(table.values())


_FROM, _TO = _single()


def canonical_sql(column: str) -> str:
    """DuckDB expression of the canonical form of a text column."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace({column}, '{_INVISIBLE}', '', 'g')"
    for sign, letters in _SEVERAL:
        out = f"replace({out}, {q(sign)}, {q(letters)})"
    out = f"nfc_normalize(translate({out}, {q(_FROM)}, {q(_TO)}))"
    return f"trim(regexp_replace({out}, '{_SPACES}', ' ', 'g'))"


def _run(select: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            yield from con.sql(f"SELECT {select} FROM batch").to_arrow_table().to_batches()
            con.unregister("batch")

    return run


def canonical_texts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a new column for each text column of `columns` (old name -> new name): its canonical form.

    Invisible characters go; letters that differ in width, font or script but look the same become one
    (Latin where there is a choice); ligatures become letters; accents are composed; every run of white
    space becomes one space, none stays at the ends. Case, accents and punctuation are kept. Null
    stays null, empty stays empty; equal texts get equal forms, and a canonical text is its own form.
    New names must not clash with those of df; names in df are never touched. No shuffle.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    new = [f"n{i}" for i in range(len(columns))]
    place = {c: names[df.columns.index(c)] for c in columns}
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    select = ", ".join([*names, *(f"{canonical_sql(place[c])} AS {n}" for c, n in zip(columns, new))])
    out = df.toDF(*names).mapInArrow(_run(select), ", ".join([fields, *(f"{n} string" for n in new)]))
    return out.toDF(*df.columns, *columns.values())


def same_look(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The rows of pairs whose two texts differ in code points but look the same. Null matches nothing."""
    differ = pairs.filter(F.col(f"`{left}`") != F.col(f"`{right}`"))
    one, two = (next(n for i in range(len(pairs.columns) + 2) if (n := f"_{side}{i}") not in pairs.columns) for side in ("left", "right"))
    both = canonical_texts(differ, {left: one, right: two})
    return both.filter(F.col(one) == F.col(two)).drop(one, two)
