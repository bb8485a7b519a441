"""Names of agents in titles: occurrences, their scores, and titles without responsibility statements."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import ILLUSTRATION_TERMS, normalize_match

#: Words that don't count as parts of a name, and terms of responsibility near it.
STOP_TOKENS = ("de", "la", "le", "les", "du", "des", "d")
RESPONSIBILITY_TERMS = (*ILLUSTRATION_TERMS, "d'après", "adapt.", "adaptation", "tiré", "traduit", "traduction", "presente", "preface", "introduction", "edite", "edition", "commentaire", "accompagne", "suivi")
SEPARATORS = ("|", ":", ";", "—", "–", "-", ".", "…")
_GAP = re.compile(r"[^\w']+")


def fold_char(ch: str) -> str:
    out = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    return out.replace("œ", "oe").replace("Œ", "oe")


def folded_map(title: str) -> tuple[str, list[int]]:
    """(matching form, place in the title of each of its characters).

    Places are those of the folded characters before runs of signs shrink to one space, so they fall behind by
    one for each sign that was dropped before them: spans after such a run begin too early. That is how the
    places have always been counted, and reports keep to it.
    """
    chars, at = [], []
    for i, ch in enumerate(title):
        for c in fold_char(ch):
            chars.append(c.lower())
            at.append(i)
    norm = _GAP.sub(" ", "".join(chars)).strip()
    places = at[: len(norm)]
    return norm, places + [places[-1] if places else 0] * (len(norm) - len(places))


def matching_form(text: str) -> str:
    return _GAP.sub(" ", "".join(fold_char(c) for c in text).lower()).strip()


def occurrences(title: str, variant: str) -> list[tuple[int, int, int, int]]:
    """(start, end, place, place after) of each occurrence of a variant, none overlapping: in the matching form, and in the title."""
    norm, at = folded_map(title)
    name = matching_form(variant)
    out, i = [], norm.find(name) if name else -1
    while i >= 0:
        e = i + len(name)
        out.append((i, e, at[min(i, len(at) - 1)], at[min(e - 1, len(at) - 1)] + 1))
        i = norm.find(name, e)
    return out


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mapped = [folded_map(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in mapped], pa.string()), pa.array([m[1] for m in mapped], pa.list_(pa.int32()))], names=["id", "form", "places"])


def folded_maps(titles: DataFrame) -> DataFrame:
    """(id, form, places) of titles (id, title): the matching form and the place of each of its characters."""
    return titles.filter("title is not null").select(F.col("id").cast("string"), "title").mapInArrow(_map, "id string, form string, places array<int>")


def context_score(norm: str, start: int, end: int) -> float:
    """How likely a name at this place is a statement of responsibility."""
    near = norm[max(0, start - 32) : end + 32]
    score = 0.5 * any(s in near for s in SEPARATORS) + 0.3 * any(t in near for t in RESPONSIBILITY_TERMS) + (0.15 if start <= 5 else 0.0)
    return min(1.0, score)


def _scan(least: float, high: float, telling: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["id", "ark", "variant", "score", "start", "end", "snippet", "confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, title, ark, variant in zip(*(batch.column(i).to_pylist() for i in range(4))):
                useful = [t for t in matching_form(variant).split(" ") if t and t not in STOP_TOKENS]
                if len(useful) < telling:
                    continue
                norm, _ = folded_map(title)
                for s, e, a, b in occurrences(title, variant):
                    score = context_score(norm, s, e)
                    if score >= least:
                        rows.append((key, ark, variant, round(score, 3), a, b, title[max(0, a - 40) : b + 40], "high" if score >= high else "medium"))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


def holds_name(title: Column, variant: Column) -> Column:
    """Whether the matching form of a title holds that of a name, which no name without letters has."""
    return F.contains(normalize_match(title), normalize_match(variant)) & (normalize_match(variant) != "")


def find_names(titles: DataFrame, least: float = 0.65, high: float = 0.85, telling: int = 2) -> DataFrame:
    """Occurrences of names in titles (id, title, ark, variant): id, ark, variant, score, start, end, snippet, confidence.
    Names of fewer than so many telling tokens are never looked for. Null titles and names have none. Only titles that hold the name
    go through Python, for its places."""
    pairs = titles.filter("title is not null and variant is not null").select("id", "title", "ark", "variant")
    return pairs.filter(holds_name(F.col("title"), F.col("variant"))).mapInArrow(
        _scan(least, high, telling), "id string, ark string, variant string, score double, start int, end int, snippet string, confidence string"
    )


_SIDE = " \t\n,;:|—–-"
_CONNECTIVE = re.compile(r"(?:\b(?:(?:illustr|traduit|adapt|présent|préfac|annot|édit)\w*|vignettes|illustrations|dessins|gravures|images)?\s*(?:par|de|d'|d’|avec|d'après|d’après)\s*)$", re.I)
_ILLUSTRATION = re.compile(r"[,;:/|—–-]?\s*\b(?:illustr\w*|vignettes?|ill\.|lith\.|couv\.|dessins|gravures)\b[^,;:|—–]*", re.I)


def remove_statements(title: str, spans: list[tuple[int, int]], illustration: bool) -> str:
    """The title without names at spans (with what introduces them) and, if asked, without illustration statements.

    A rule takes the place of a parser: a name takes with it the preposition and participle before it and the
    signs around it. Results are approximate; a title without spans and statements comes back as it is.
    """
    cuts = []
    for s, e in spans:
        m = _CONNECTIVE.search(title[:s])
        s = m.start() if m else s
        while s and title[s - 1] in _SIDE:
            s -= 1
        while e < len(title) and title[e] in _SIDE:
            e += 1
        cuts.append((s, e))
    if illustration:
        cuts += [m.span() for m in _ILLUSTRATION.finditer(title)]
    if not cuts:
        return title
    out, at = [], 0
    for s, e in sorted(cuts):
        out.append(title[at : max(s, at)])
        at = max(at, e)
    out.append(title[at:])
    return " ".join(" ".join(out).split()).strip(_SIDE)


def has_illustration(title: Column) -> Column:
    """Whether a title holds one of the illustration terms anywhere, accents and case aside (`vill.` holds `ill.`)."""
    from folioforge.functions.text import fold

    low = F.lower(fold(F.coalesce(title, F.lit(""))))
    out = F.lit(False)
    for t in ILLUSTRATION_TERMS:
        out = out | F.contains(low, F.lit(t))
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, titles, variants, illustrated = (batch.column(i).to_pylist() for i in range(4))
        out = [remove_statements(t, sorted({o[2:] for v in vs or () for o in occurrences(t, v)}), bool(x)) for t, vs, x in zip(titles, variants, illustrated)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["id", "cleaned_title"])


def clean_titles(titles: DataFrame) -> DataFrame:
    """(id, cleaned_title) of titles (id, title, variants ARRAY). Only titles with a name or a statement go through Python."""
    marked = titles.filter("title is not null").withColumn("illustrated", has_illustration(F.col("title")))
    maybe = F.col("illustrated") | (F.size(F.coalesce("variants", F.array().cast("array<string>"))) > 0)
    dirty = marked.filter(maybe).select("id", "title", "variants", "illustrated").mapInArrow(_clean, "id string, cleaned_title string")
    return marked.filter(~maybe).select("id", F.col("title").alias("cleaned_title")).unionByName(dirty)


def contamination(works: DataFrame, names: DataFrame, cleaned: DataFrame, least: float = 0.65, high: float = 0.85) -> DataFrame:
    """The report of names in titles: id_entitelrm, work_ark, title, cleaned_title, author_ark, matched_variant, score, snippet,
    confidence. works: id, ark, title; names: id, title, ark, variant, those of each work's own agents; cleaned: see clean_titles."""
    found = find_names(names, least, high).select("id", F.col("ark").alias("author_ark"), F.col("variant").alias("matched_variant"), "score", "snippet", "confidence")
    known = works.select("id", F.col("ark").alias("work_ark"), "title")
    return found.join(known, "id").join(cleaned, "id", "left").select(F.col("id").alias("id_entitelrm"), "work_ark", "title", "cleaned_title", "author_ark", "matched_variant", "score", "snippet", "confidence")


def write_report(records: DataFrame, path: str) -> None:
    """Write the report as JSON, one record a line, null fields included."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
