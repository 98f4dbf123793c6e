"""Texts cut off by field limits, found by word trigrams in pure SQL.

Texts are lower-cased, digits become 9 (a letter a to d after a number belongs to it), and every text is read as words. Over all texts of a table each trigram is counted
inside texts and at their ends; a trigram that ends in the beginning of a longer word counts as one that went on there. The
final trigram of a text is then looked up: where it is frequent inside texts but almost never terminal, at the level of
trigram, bigram and word alike, the text was cut; a fragment of a word is judged by the word level alone. Ends of texts that fill their source's limit (its longest length but for stray ones) aren't counted
as ends (a fixed limit piles cuts up there), nor is the judged record itself; other records with the same text are ends like
any, so that a short remark that many records make is known to be whole.

Defined cases: null and blank values are never cut; repeated rows count and are judged each; an empty table gives an empty
result; only the named columns are read, so extra columns never clash; words of any length are judged; a text without words or
signs can't occur.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.session import broadcast_if_small, cut_lineage, table


@dataclass(frozen=True)
class Field:
    """A text column to judge, with the columns naming its record and its source."""

    table: str
    column: str
    record: str = "rec_no"
    source: str = "source_sys"


#: Share of ends below which a word sequence is almost never terminal, in texts that fill their source's length too, and in
#: the context of a word of three letters and more that is itself almost never terminal (letters alone may be directions);
#: weight of a lower level in a higher one; least continuations; share of whole words below which a final is a mere word fragment;
#: share of ends expected of a whole word that is rare, and the weight of that; share of a source's values from which a length
#: is no stray one (the longest such length is the source's limit).
PARAMETERS = {"rate": 0.03, "rate_full": 0.08, "rate_long": 0.2, "weight": 10, "least": 2, "fragment": 0.02, "rate_word": 0.06, "weight_word": 50, "pile": 0.002}

WORDS = r"\p{L}[\p{L}'']*(/\p{L}[\p{L}'']*)*|9+([.,]9+)*|[^\s\p{L}9]"

#: Letters up to which every beginning of a word is listed; longer beginnings are joined to the finals they may explain.
LISTED = 60

_MASKED = r"""
masked AS (
  SELECT table_name, record, source, txt, len, {mask} AS t FROM filled)"""
# distinct texts: how many records hold one, and how many of those don't fill their source's length
_WORDED = r""",
filled_limits AS ({limits}),
texts AS (
  SELECT m.table_name, m.t, count(*) AS n, sum(CASE WHEN m.len BETWEEN l.longest - 1 AND l.longest THEN 0 ELSE 1 END) AS free
  FROM masked m JOIN filled_limits l ON m.table_name = l.tn AND m.source = l.src GROUP BY m.table_name, m.t),
worded AS (SELECT table_name, t, n, free, {words} AS w FROM texts)"""
_GRAMS = r"""
steps AS (SELECT table_name, n, free, w, {positions} AS i FROM {worded}),
grams AS (
  SELECT table_name, {at_i2} AS a, {at_i1} AS b, {at_i} AS c, sum(CASE WHEN i < {size} THEN n ELSE 0 END) AS inside,
         sum(CASE WHEN i = {size} THEN n ELSE 0 END) AS finals, sum(CASE WHEN i = {size} THEN free ELSE 0 END) AS ends
  FROM steps GROUP BY 1, 2, 3, 4)"""
_JUDGED = r"""
starts AS (
  SELECT table_name, a, b, c, inside, finals, ends, {prefixes} AS k FROM {grams}),
longs AS (SELECT DISTINCT table_name, c FROM {grams} WHERE length(c) > {listed} AND finals > 0 AND c NOT LIKE '9%'),
begun AS (
  SELECT table_name, a, b, substr(c, 1, k) AS p, CASE WHEN k < length(c) THEN inside + finals ELSE inside END AS goes_on,
         CASE WHEN k = length(c) THEN ends ELSE 0 END AS ends, CASE WHEN k = length(c) THEN finals ELSE 0 END AS finals,
         CASE WHEN k = length(c) THEN inside ELSE 0 END AS whole
  FROM starts
  UNION ALL
  SELECT g.table_name, g.a, g.b, f.c, g.inside + g.finals, 0, 0, 0
  FROM longs f JOIN {grams} g ON f.table_name = g.table_name AND substr(f.c, 1, {listed}) = substr(g.c, 1, {listed})
  WHERE length(g.c) > length(f.c) AND substr(g.c, 1, length(f.c)) = f.c),
s3 AS (SELECT table_name, a, b, p, sum(goes_on) AS goes_on, sum(ends) AS ends, sum(finals) AS finals, sum(whole) AS whole FROM begun GROUP BY 1, 2, 3, 4),
s2 AS (SELECT table_name, b, p, sum(goes_on) AS goes_on, sum(ends) AS ends, sum(finals) AS finals, sum(whole) AS whole FROM s3 GROUP BY 1, 2, 3),
s1 AS (SELECT table_name, p, sum(goes_on) AS goes_on, sum(ends) AS ends, sum(finals) AS finals, sum(whole) AS whole FROM s2 GROUP BY 1, 2),
one AS (SELECT *, CASE WHEN whole < {fragment} * goes_on THEN 1 ELSE 0 END AS fragment FROM s1 WHERE finals > 0 AND goes_on >= {least}),
two AS (
  SELECT s2.table_name, s2.b, s2.p, s2.goes_on AS g2, s2.ends AS e2, one.goes_on AS g1, one.ends AS e1, one.fragment
  FROM s2 JOIN one ON s2.table_name = one.table_name AND s2.p = one.p WHERE s2.finals > 0),
judged AS (
  SELECT s3.table_name, s3.a, s3.b, s3.p, s3.goes_on AS g3, s3.ends AS e3, g2, e2, g1, e1, fragment
  FROM s3 JOIN two ON s3.table_name = two.table_name AND s3.b = two.b AND s3.p = two.p WHERE s3.finals > 0),
ending AS (SELECT table_name, t, n, free, {last3} AS a, {last2} AS b, {last1} AS p FROM {worded}),
rates AS (
  SELECT e.table_name, e.t, fragment, CASE WHEN free < n THEN {rate_full} ELSE {rate} END AS rate,
         CASE WHEN length(e.p) >= 3 OR e.p = ',' THEN {rate_long} WHEN free < n THEN {rate_full} ELSE {rate} END AS context_rate, g1, e1 - least(free, 1) AS x1, g2, e2 - least(free, 1) AS x2, g3, e3 - least(free, 1) AS x3
  FROM ending e JOIN judged j ON e.table_name = j.table_name AND e.a = j.a AND e.b = j.b AND e.p = j.p),
level1 AS (SELECT *, CASE WHEN fragment = 1 THEN (x1 + {weight} * {rate} / 2) / (g1 + x1 + {weight}) ELSE (x1 + {weight_word} * {rate_word}) / (g1 + x1 + {weight_word}) END AS r1 FROM rates),
level2 AS (SELECT *, (x2 + {weight} * CASE WHEN fragment = 1 THEN r1 ELSE greatest(r1, {rate_word}) END) / (g2 + x2 + {weight}) AS r2 FROM level1),
level3 AS (SELECT *, (x3 + {weight} * r2) / (g3 + x3 + {weight}) AS r3 FROM level2),
cut AS (SELECT table_name, t FROM level3 WHERE r1 < rate AND (fragment = 1 OR r2 < context_rate AND r3 < context_rate))
"""

_LIMITS = f"""SELECT tn, src, max(CASE WHEN n >= {PARAMETERS["pile"]} * filled_n THEN len END) AS longest FROM (
  SELECT table_name AS tn, source AS src, len, count(*) AS n, sum(count(*)) OVER (PARTITION BY table_name, source) AS filled_n
  FROM filled GROUP BY table_name, source, len) AS lengths GROUP BY tn, src"""
_SPARK = {
    "limits": "SELECT * FROM {limits}",  # counted first, so that the texts needn't be shuffled by source
    "mask": r"""regexp_replace(regexp_replace(lower(txt), '[0-9]', '9'), r'9[a-d]\b', '9')""",
    "words": f'concat(array("^", "^"), regexp_extract_all(t, r"{WORDS.replace("{L}", "{{L}}")}", 0))',
    "positions": "explode(sequence(3, size(w)))", "size": "size(w)", "at_i2": "w[i - 3]", "at_i1": "w[i - 2]", "at_i": "w[i - 1]",
    "prefixes": f"explode(CASE WHEN c LIKE '9%' THEN array(length(c)) WHEN length(c) > {LISTED} THEN array_append(sequence(1, {LISTED}), length(c)) ELSE sequence(1, length(c)) END)",
    "last3": "w[size(w) - 3]", "last2": "w[size(w) - 2]", "last1": "w[size(w) - 1]",
}
_DUCK = {
    "limits": _LIMITS,
    "mask": r"""regexp_replace(regexp_replace(lower(txt), '[0-9]', '9', 'g'), '9[a-d]\b', '9', 'g')""",
    "words": f"list_concat(['^', '^'], regexp_extract_all(t, '{WORDS.replace(chr(39), chr(39) * 2)}'))",
    "positions": "unnest(range(3, len(w) + 1))", "size": "len(w)", "at_i2": "w[i - 2]", "at_i1": "w[i - 1]", "at_i": "w[i]",
    "prefixes": f"unnest(CASE WHEN c LIKE '9%' THEN [length(c)] WHEN length(c) > {LISTED} THEN list_append(range(1, {LISTED + 1}), length(c)) ELSE range(1, length(c) + 1) END)",
    "last3": "w[-3]", "last2": "w[-2]", "last1": "w[-1]",
}


def _filled(fields: Sequence[Field], named) -> str:
    """``named(field)``: how the field's table is read in the dialect."""
    # trimmed of the blanks a field is padded with
    union = "\n  UNION ALL ".join(
        f"SELECT '{f.table}' AS table_name, {f.record} AS record, coalesce({f.source}, '') AS source, trim({f.column}) AS txt, length(trim({f.column})) AS len FROM {named(f)} WHERE trim({f.column}) <> ''"
        for f in fields
    )
    return f"WITH filled AS (\n  {union})"


def _sql(fields: Sequence[Field], select: str) -> str:
    """The whole judgement as one DuckDB statement."""
    names = {**_DUCK, **PARAMETERS, "listed": LISTED, "worded": "worded", "grams": "grams"}
    return _filled(fields, lambda f: f.table) + "," + ",".join(x.format(**names) for x in (_MASKED + _WORDED, _GRAMS, _JUDGED)) + select


_CUT = "SELECT m.table_name, m.record AS rec_no FROM masked m JOIN cut c ON m.table_name = c.table_name AND m.t = c.t"
_SHARES = """SELECT m.table_name, m.source AS source_sys, count(*) AS filled, count(c.t) AS cut, count(c.t) / CAST(count(*) AS DOUBLE) AS share
FROM masked m LEFT JOIN cut c ON m.table_name = c.table_name AND m.t = c.t GROUP BY 1, 2"""

FIELDS = (Field("client", "address"), Field("dbase_31", "quantitype"), Field("dbase_03", "comments"))


def _run(spark: SparkSession, sources: dict[str, DataFrame], fields: Sequence[Field], select: str) -> DataFrame:
    """Distinct texts, then their trigrams, are written once each and read from there by all levels."""
    frames = {f"f{i}": sources[f.table].select(f.record, f.source, f.column) for i, f in enumerate(fields)}
    where = {id(f): "{" + f"f{i}" + "}" for i, f in enumerate(fields)}
    names = {**_SPARK, **PARAMETERS, "listed": LISTED, "worded": "{worded}", "grams": "{grams}"}
    filled = _filled(fields, lambda f: where[id(f)])
    limits = cut_lineage(spark.sql(f"{filled} {_LIMITS}", **frames))
    worded = cut_lineage(spark.sql(f"{filled},{(_MASKED + _WORDED).format(**names)} SELECT * FROM worded", **frames, limits=broadcast_if_small(limits)))
    grams = cut_lineage(spark.sql(f"WITH {_GRAMS.format(**names)} SELECT * FROM grams", worded=worded))
    return spark.sql(f"{filled},{_MASKED.format(**names)},{_JUDGED.format(**names)}{select}", **frames, worded=worded, grams=grams)


def truncated(spark: SparkSession, sources: dict[str, DataFrame], fields: Sequence[Field] = FIELDS) -> DataFrame:
    """table_name, rec_no of every value that was cut."""
    return _run(spark, sources, fields, _CUT)


def truncation_shares(spark: SparkSession, sources: dict[str, DataFrame], fields: Sequence[Field] = FIELDS) -> DataFrame:
    """table_name, source_sys, filled, cut, share: how often each source truncates."""
    return _run(spark, sources, fields, _SHARES)


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {f.table: table(spark, d, f.table) for f in FIELDS}


QUERIES = {
    "p1_found": lambda spark, d: truncated(spark, _tables(spark, d)),
    "p1_shares": lambda spark, d: truncation_shares(spark, _tables(spark, d)),
}
ORACLES = {"p1_found": _sql(FIELDS, _CUT), "p1_shares": _sql(FIELDS, _SHARES)}
