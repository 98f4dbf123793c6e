"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, then exact verification.

A leak is a passage of at least ``WORDS`` consecutive words of an item inside a document; as sets of word shingles
(``SHINGLE`` words) the document contains at least ``BOUND`` shingles in a row of the item's. Items are partitioned by size
(powers of two of their shingles); in a partition of items of at most ``u`` shingles the containment sought is thus at least
``BOUND / u``, and the sketch of an item has one MinHash value for each run of ``BOUND`` shingles, the number that the bound
asks for: whatever passage leaked, its copy in the document has the same minimum, so one common value is sure and no leak is
lost (neighbouring runs mostly share theirs, so a sketch is about a fifth as large as its text). Documents are sketched alike,
whatever their length, and looked up in every partition. Candidates are verified on exact passages, and their containment is
then counted exactly on shingles.

The items are held in a broadcast index where their measured size allows (``BROADCAST_CHARS``; it changes the cost alone) and
documents are then read once without any shuffle; beyond that, sketches of both sides are joined by partition and value. A
value that many texts share (a licence, say) is salted on the documents' side.

Defined cases: null or short texts hold no passage; repeated documents and items count each; empty tables give an empty
result; only the named columns are read; a very long text is searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import cut_lineage, table

WORDS, SHINGLE = 12, 5
BOUND = WORDS - SHINGLE + 1
#: Parts that documents' rows of one value are spread over before they meet the items'.
SALT = 16
#: Characters of all items up to which their index is sent to every executor.
BROADCAST_CHARS = 16_000_000

TOKEN = re.compile(r"[a-z0-9]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Word hashes with a bounded memory of the words seen."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mix(out * _MUL + h[k : k + m])
    return out


def signatures(h: np.ndarray, words: int = WORDS, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct MinHash values of all windows of ``words`` words, over their word shingles."""
    s = runs(h, shingle)
    width = words - shingle + 1
    m = len(s) - width + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    low = s[:m].copy()
    for k in range(1, width):
        np.minimum(low, s[k : k + m], out=low)
    return np.unique(low)


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def partition_of(shingles: int) -> int:
    """The size partition of an item with so many shingles."""
    return max(shingles, 1).bit_length()


def _index(items: list[tuple[int, str]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For each size partition its sorted values with the item of each; the passages and the shingles (hashes) of each item."""
    sketches: dict[int, list[tuple[int, np.ndarray]]] = {}
    passages, shingles = {}, {}
    hasher = Hasher()
    for item, text in items:
        h = hasher(words_of(text))
        passages[item], shingles[item] = np.unique(runs(h, WORDS)), np.unique(runs(h, SHINGLE))
        if len(passages[item]):
            sketches.setdefault(partition_of(len(shingles[item])), []).append((item, signatures(h)))
    parts = []
    for _, members in sorted(sketches.items()):
        sig = np.concatenate([s for _, s in members])
        owner = np.concatenate([np.full(len(s), item, dtype=np.int64) for item, s in members])
        order = np.argsort(sig, kind="stable")
        parts.append((sig[order], owner[order]))
    return parts, passages, shingles


def _shared(words_a: list[str], words_b_runs: set[tuple[str, ...]]) -> bool:
    return any(tuple(words_a[i : i + WORDS]) in words_b_runs for i in range(len(words_a) - WORDS + 1))


_LEAK = "doc_id bigint, item_id bigint, containment double"


def _containment(item: np.ndarray, document: np.ndarray) -> float:
    """Share of the item's distinct shingles that the document has."""
    return float(np.isin(item, document).sum()) / len(item)


def _broadcast_search(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    index = documents.sparkSession.sparkContext.broadcast((*_index(items), dict(items)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, passages, shingles, texts = index.value
        hasher, exact = Hasher(), {}
        for pdf in batches:
            found = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words = words_of(text)
                h = hasher(words)
                s = signatures(h)
                candidates: set[int] = set()
                for sig, owner in parts:
                    lo, hi = np.searchsorted(sig, s, "left"), np.searchsorted(sig, s, "right")
                    for a, b in zip(lo[hi > lo], hi[hi > lo]):
                        candidates.update(owner[a:b].tolist())
                if not candidates:
                    continue
                own = runs(h, WORDS)
                for item in candidates:
                    if np.isin(passages[item], own).any():  # then word by word, so that no hash decides
                        if item not in exact:
                            w = words_of(texts[item])
                            exact[item] = {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}
                        if _shared(words, exact[item]):
                            found.append((doc, item, _containment(shingles[item], runs(h, SHINGLE))))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "containment"])

    return documents.mapInPandas(search, _LEAK)


def _sketch_rows(df: DataFrame, key: str, sized: bool) -> DataFrame:
    """``key``, ``sig`` and, for items, ``part``: the sketch of each text."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            keys, sigs, parts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for k, text in zip(pdf[key], pdf["text"]):
                h = hasher(words_of(text))
                s = signatures(h).view(np.int64)
                keys.append(np.full(len(s), k, dtype=np.int64))
                sigs.append(s)
                parts.append(np.full(len(s), partition_of(len(np.unique(runs(h, SHINGLE)))) if sized else 0, dtype=np.int32))
            yield pd.DataFrame({key: np.concatenate(keys), "sig": np.concatenate(sigs)} | ({"part": np.concatenate(parts)} if sized else {}))

    return df.mapInPandas(sign, f"{key} bigint, sig bigint" + (", part int" if sized else ""))


def _shuffled_search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Sketches joined by value in each size partition; documents' rows of a value are salted, items' rows repeated per salt."""
    sketched = cut_lineage(_sketch_rows(items, "item_id", True))
    salted = _sketch_rows(documents, "doc_id", False).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    spread = sketched.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    candidates = cut_lineage(salted.join(spread, ["sig", "salt"]).select("part", "doc_id", "item_id").distinct())
    pairs = candidates.join(documents, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            found = []
            for doc, item, text, item_text in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item_text"]):
                w, own = words_of(item_text), words_of(text)
                if _shared(own, {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}):
                    found.append((doc, item, _containment(np.unique(runs(hasher(w), SHINGLE)), runs(hasher(own), SHINGLE))))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "containment"])

    return pairs.mapInPandas(verify, _LEAK)


def leaks(documents: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """doc_id, item_id, containment (share of the item's shingles that the document has) of every document that holds a passage
    of an item."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size <= broadcast_chars:
        return _broadcast_search(docs, [(r["item_id"], r["text"]) for r in tests.collect()])
    return _shuffled_search(docs, tests)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_containment(spark, d).select("doc_id", "item_id")


def p6_containment(spark: SparkSession, d: str) -> DataFrame:
    """How much of each leaked item a document holds."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p6_found": p6_found, "p6_items": p6_items, "p6_containment": p6_containment}
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_FOUND = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dp AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {WORDS - 2}, 1)), lambda k: hash(array_to_string(w[k:k + {WORDS - 1}], ' ')))) AS p FROM d),
ip AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {WORDS - 2}, 1)), lambda k: hash(array_to_string(w[k:k + {WORDS - 1}], ' ')))) AS p FROM i)
SELECT DISTINCT doc_id, item_id FROM dp JOIN ip USING (p)"""
_PARTS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items), leak AS ({_FOUND}),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 1)), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' '))) AS s FROM d SEMI JOIN leak USING (doc_id)),
isg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 1)), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' '))) AS s FROM i)
SELECT l.doc_id, l.item_id, count(ds.s) / CAST(count(*) AS DOUBLE) AS containment FROM leak l JOIN isg USING (item_id) LEFT JOIN ds ON ds.doc_id = l.doc_id AND ds.s = isg.s GROUP BY 1, 2"""
ORACLES = {"p6_containment": _PARTS, "p6_found": _FOUND, "p6_items": f"SELECT item_id, count(*) AS documents FROM ({_FOUND}) GROUP BY item_id"}
