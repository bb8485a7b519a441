"""Text normalisation as native expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The precomposed letters of these blocks are folded to what NFKD without marks leaves of them.
FOLD_BLOCKS = ((0x00A0, 0x024F), (0x0370, 0x052F), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x3000, 0x3000), (0xFF01, 0xFF5E))


def _bare(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    one, to, many = [], [], []
    for lo, hi in FOLD_BLOCKS:
        for code in range(lo, hi + 1):
            ch = chr(code)
            bare = _bare(ch)
            if bare == ch or unicodedata.category(ch) == "Cn":
                continue
            if len(bare) == 1:
                one.append(ch)
                to.append(bare)
            else:
                many.append((ch, bare))
    return "".join(one), "".join(to), many


_ONE, _TO, _MANY = _fold_tables()
#: Signs that expand to several and are met in titles; others of the blocks are left to exact_fold.
_EXPAND = [("œ", "oe"), ("Œ", "oe"), ("…", "..."), ("Ĳ", "IJ"), ("ĳ", "ij")]
_MARKS = r"[\u0300-\u036F\u0483-\u0487\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\uFE20-\uFE2F]"


def fold(text: Column, ligature: bool = True) -> Column:
    """Text without diacritics: one `translate` over the Latin, Greek and Cyrillic letters, combining
    marks removed; with `ligature`, the oe ligature of either case becomes `oe`. Case is kept."""
    out = F.regexp_replace(F.translate(text, _ONE, _TO), _MARKS, "")
    for sign, plain in _EXPAND if ligature else _EXPAND[2:]:
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def normalize_title(title: Column) -> Column:
    """Grouping key of a title: a leading article directly before a pipe is dropped, pipes and
    punctuation become spaces, accents and case go, white space is collapsed. The oe ligature and
    symbols such as $ + = stay. Null gives ''."""
    text = F.trim(F.coalesce(title, F.lit("")))
    text = F.regexp_replace(text, r"(?iu)^(?:un|une|le|la|les)\s*\|\s*", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\|", " "), r"\p{P}", " ")
    return F.trim(F.regexp_replace(F.lower(fold(text, ligature=False)), r"(?U)\s+", " "))


def normalize_match(text: Column) -> Column:
    """Matching form: folded, lower case, everything but letters, digits, _ and ' becomes one space."""
    return F.trim(F.regexp_replace(F.lower(fold(text)), r"[^\p{L}\p{N}_']+", " "))


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_match(text), " "), lambda w: w != "")


SUFFIX = r"(?iuU)\b(illustrations?|vignettes?|illustré(?:e|s)?)\s+(de|par)\b"


def has_suffix(title: Column) -> Column:
    """Whether a title carries an illustration statement. Null titles have none."""
    return F.coalesce(title, F.lit("")).rlike(SUFFIX)


#: Folded terms that point to an illustration statement.
ILLUSTRATION_TERMS = ("illustre", "illustree", "illustrations", "ill.", "illustr.", "vignettes", "images", "gravures", "dessins", "photographies", "lithographies", "lith.", "couverture", "couv.")


def merge_ranges(ranges: Column) -> Column:
    """Sorted [start, end) structs with overlapping or touching ones merged; null and empty stay so."""
    sort = F.array_sort(ranges)
    kind = "array<struct<start:int,end:int>>"

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (r["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(F.struct(r["start"].alias("start"), r["end"].alias("end")))))

    return F.aggregate(sort.cast(kind), F.array().cast(kind), step)
