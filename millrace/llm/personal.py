"""Personal information inside free text: found by a trained character tagger, replaced by typed placeholders.

The tagger (:mod:`millrace.llm.tagger`) marks spans on whole texts, and its marks alone decide what is found. Bounds are then
trimmed: where the line holds a text of the kind's usual form that mostly overlaps the mark, the mark takes its bounds, so one
that is off by a character is put right; a mark on any other form stays, less the signs around it.

Defined cases: null and empty texts hold nothing; the same text of a kind counts once for a document; repeated documents
are rows of their own; an empty table gives an empty result; only the named columns are read; texts are read whole, in
overlapping windows, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tagger as T
from millrace.session import table

_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
_AT = r"(?:@| ?\[at\] ?| ?\(at\) ?| at )"
_USER = rf"[A-Za-z0-9][A-Za-z0-9_%+-]*(?:{_DOT}[A-Za-z0-9_%+-]+)*"
_HOST = rf"(?!\d)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"
_UP, _LOW = "A-ZÀ-ÖØ-ÞŁŚŻŠŽČĆ", "a-zß-öø-ÿłśżšžčćńęąőű"
_WORD = rf"[{_UP}](?:[{_LOW}]+|[{_UP}]+|)(?:['’-][{_UP}]?[{_LOW}{_UP}]+)*"
_TYPE = r"(?:Street|St\.?|Avenue|Ave\.?|Av\.?|Road|Rd\.?|Drive|Dr\.?|Lane|Ln\.?|Court|Ct\.?|Boulevard|Blvd\.?|Place|Pl\.?|Square|Sq\.?|Terrace|Ter\.?|Highway|Hwy\.?|Parkway|Pkwy\.?|Way|Crescent)"
_CITY = rf"(?:, {_WORD}(?: {_WORD})?(?:,? [A-Z]{{2}}(?: \d{{5}}(?:-\d{{4}})?)?)?)?"
_UNIT = r"(?:,? (?:Unit|Apt\.?|Suite|Ste\.?|Floor|Fl\.?|Rm\.?|Room|#) ?#?\w+)?"

#: Signs that never begin or end a found text; characters that one has at least.
EDGES, LEAST = " \t\r\n\"'`,;:<>[]{}()|=*", 4

#: The usual form of each kind, for bounds alone.
GRAMMAR = {
    "email": re.compile(rf"(?<![\w.@])(?<![\w.][+-]){_USER}{_AT}{_HOST}(?![\w@]|:[\w/])"),
    "phone": re.compile(r"(?<![\w.+-])(?:(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?\(?\d{2,5}\)?(?:[ .-]?\d{2,6}){1,3}|0\d{3,4}[ .-]\d{5,7}|[2-9]\d{9})(?:,? ?(?:ext\.?|x|extension) ?\d{1,5})?(?![\w]|[.-]\d)"),
    "id_number": re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2}\d{6}[A-D]|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[A-Z]{2}\d{7}|[A-Z]{2} \d{7})(?![\w]|-\d)"),
    "street_address": re.compile(rf"(?<![\w.-])(?:\d{{1,5}}[A-Z]? (?:(?:[NSEW]\.?|North|South|East|West|[NS][EW]) )?(?:\d+(?:st|nd|rd|th)|{_WORD})(?: {_WORD}){{0,2}}? {_TYPE}(?![\w])(?: (?:North|South|East|West|[NSEW])\b\.?)?{_UNIT}{_CITY}|(?:P\. ?O\. ?|PO |Post Office )Box \d+{_CITY})"),
    "person_name": re.compile(rf"(?<![\w@.])(?<![\w]-)(?:{_WORD}, {_WORD}(?:-{_WORD})?(?: [{_UP}]\.)?|(?:{_WORD}(?:-{_WORD})?|[{_UP}]\.)(?: [{_UP}]\.)? (?:(?:van|von|de|der|da|del|di|la|le|bin|al) )?[{_UP}](?:[{_LOW}]+|[{_UP}]+)(?:['’-][{_UP}]?[{_LOW}{_UP}]+)*)(?![\w@])"),
}
def matches(kind: str, line: str) -> Iterator[re.Match]:
    """All texts of the kind's form on a line; names from every place, since a title or preposition may look like one."""
    rx, at = GRAMMAR[kind], 0
    while m := rx.search(line, at):
        yield m
        at = m.start() + 1 if kind == "person_name" else max(m.end(), m.start() + 1)


def exact_spans(text: str, marks: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The marks with their bounds put right, without overlaps among them, in their order."""
    found: set[tuple[int, int, str]] = set()
    lines: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for a, b, kind in marks:
        start = text.rfind("\n", 0, a) + 1
        key = (start, kind)
        if key not in lines:
            end = text.find("\n", a)
            line = text[start : end if end >= 0 else len(text)]
            lines[key] = [(start + m.start(), start + m.end()) for m in matches(kind, line)]
        # most in common, least apart
        best = max(((2 * (min(b, y) - max(a, x)) - max(b, y) + min(a, x), x, y) for x, y in lines[key]), default=(0, 0, 0))
        both = min(b, best[2]) - max(a, best[1])
        if both > 0 and 2 * both >= min(b - a, best[2] - best[1]):
            a, b = best[1:]
        else:
            while a < b and text[a] in EDGES:
                a += 1
            while b > a and text[b - 1] in EDGES:
                b -= 1
        if b - a >= LEAST:
            found.add((a, b, kind))
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (T.KINDS.index(s[2]), s[0])):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in out):
            out.append(s)
    return sorted(out)


def personal(documents: DataFrame, weights: str | None = None) -> DataFrame:
    """doc_id, spans (start, end, kind in code points), text of every document that holds any."""
    p = documents.sparkSession.sparkContext.broadcast(T.load(weights or T.WEIGHTS))  # a model of fixed size

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = T.Tagger(p.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            spans = [exact_spans(t, m) for t, m in zip(texts, tagger(texts))]
            keep = [bool(s) for s in spans]
            out = pdf[keep].copy()
            out["spans"] = pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans if s], index=out.index, dtype=object)
            yield out[["doc_id", "text", "spans"]]

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    return docs.mapInPandas(find, "doc_id bigint, text string, spans array<struct<start:int,end:int,kind:string>>")


def found_texts(documents: DataFrame) -> DataFrame:
    """doc_id, kind, found_text: each distinct text of a kind in a document."""
    one = personal(documents).select("doc_id", F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.substring("text", s["start"] + 1, s["end"] - s["start"]).alias("found_text")))).alias("found"))
    return one.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.kind", "f.found_text")


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id, text with [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS], [PERSON_NAME] in place of what was found."""

    def replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            parts, at = [], 0
            for x in s:
                parts += [t[at : x["start"]], f"[{x['kind'].upper()}]"]
                at = x["end"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return personal(documents).select("doc_id", F.pandas_udf(replace, "string")("text", "spans").alias("text"))


QUERIES = {
    "p8_found": lambda spark, d: found_texts(table(spark, d, "documents")),
    "p8_redacted": lambda spark, d: redacted(table(spark, d, "documents")),
}
