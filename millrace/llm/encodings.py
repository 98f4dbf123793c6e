"""Text decoded with the wrong code page: found, and restored where the bytes allow.

A bounded sample of the most frequent words with characters beyond ASCII is counted over all records. From the trusted ones
synthetic garbled records are made with every known encoding chain (true page, wrong page, once or twice), and a multinomial
classifier on hashed byte bigrams is trained to predict the exact chain of a word, "as it should be" included. Its
prediction decides: a word is garbled where a chain is more likely than none. The chain is inverted, and an inverse that
doesn't decode strictly rules its chain out, so that the next likely one (or none) is taken.

Characters lost for good have no inverse. A replacement or control character and a question
mark between two letters tell by themselves; a question mark at a word's edge tells where the word is, but for it, a
frequent word of the table (a join on words, of any number).

Defined cases: null and blank values, and values of ASCII alone (but for question marks in place of letters), are never
garbled; repeated rows count each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import broadcast_if_small, cut_lineage, table


@dataclass(frozen=True)
class Field:
    table: str
    column: str
    record: str = "rec_no"


FIELDS = (Field("client", "clien_hist"), Field("client", "address"), Field("dbase_31", "productnam"))

#: Encoding chains: (true page, page it was read in), applied once or more.
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "cp1250"),
    ("utf-8", "mac_roman"), ("utf-8", "cp866"), ("utf-8", "koi8-r"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp437", "cp1252"),
    ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1251", "cp866"),
    ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "koi8-r"), ("koi8-r", "cp866"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"), ("cp1252", "latin-1"),
)
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = ((), *((p,) for p in PAIRS), *((p, p) for p in PAIRS[:2]), (("utf-8", "cp1252"), ("utf-8", "latin-1")), (("utf-8", "latin-1"), ("utf-8", "cp1252")))

#: Hashed features; most frequent odd words (ties by the word) from which the trusted ones are taken that the classifier is
#: fitted on. The bound is on the fit alone: every word of every record is judged.
WIDTH, TRAINING_WORDS = 16384, 32_000
#: Share of odd words expected to be as they should be; weight of a word in capitals beside its count; share of the
#: even distribution in each class.
PRIOR, CAPITALS, SMOOTHING = 0.99, 0.1, 0.001
#: Occurrences from which a word is frequent.
TRUST = 4

#: Words between blanks; a non-breaking space may stand for a letter and splits nothing.
WORD = re.compile(r"[^ \t\r\n]+")
ODD = re.compile(r"[^\x00-\x7f]")
LOST = re.compile(r"�|[A-Za-zÀ-ɏЀ-ӿ]\?[A-Za-zÀ-ɏЀ-ӿ]")
#: Signs around a word that are no part of it.
EDGES = ".,;:()\"'#&/-"
SIGNS = set("⁄½¼¾×®©™°“”‘’–—…€£§«»№·•±²³µªº¿¡")


def _decode(data: bytes, page: str) -> str:
    """Strict but for bytes that the page leaves open, which become control characters as most readers do."""
    if page in ("cp1252", "cp1250", "cp1251"):
        return "".join(chr(b) if _open(b, page) else bytes([b]).decode(page) for b in data)
    return data.decode(page)


_OPEN: dict[tuple[int, str], bool] = {}


def _open(b: int, page: str) -> bool:
    if (b, page) not in _OPEN:
        try:
            bytes([b]).decode(page)
            _OPEN[b, page] = False
        except UnicodeDecodeError:
            _OPEN[b, page] = True
    return _OPEN[b, page]


def _encode(text: str, page: str) -> bytes:
    if page in ("cp1252", "cp1250", "cp1251"):
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 and _open(ord(c), page) else c.encode(page) for c in text)
    return text.encode(page)


def garble(text: str, chain: Sequence[tuple[str, str]]) -> str | None:
    """``text`` after the chain, None where a page lacks a character."""
    try:
        for true, wrong in chain:
            text = _decode(_encode(text, true), wrong)
    except UnicodeError:
        return None
    return text


def restore(text: str, chain: Sequence[tuple[str, str]]) -> str | None:
    """The text that the chain garbled, None where it isn't strictly decodable."""
    try:
        for true, wrong in reversed(chain):
            text = _decode(_encode(text, wrong), true)
    except UnicodeError:
        return None
    return text


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        return "ascii"
    if c in SIGNS:
        return "sign"
    if 0xC0 <= o < 0x250 and c.isalpha():
        return "latin"
    if 0x400 <= o < 0x460:
        return "cyrillic"
    return "other"


def oddness(word: str) -> float:
    """How little a word looks like writing: mixed scripts, stray signs and controls, capitals after small letters."""
    kinds = [_script(c) for c in word]
    bad = 3.0 * kinds.count("other") + (1.5 if "cyrillic" in kinds and "latin" in kinds else 0)
    if "cyrillic" in kinds and any(c.isascii() and c.isalpha() for c in word):
        bad += 1.5
    letters = [(c, k) for c, k in zip(word, kinds) if k in ("latin", "cyrillic") or c.isascii() and c.isalpha()]
    for (p, _), (c, _) in zip(letters, letters[1:]):
        bad += 1.0 * (p.islower() and c.isupper())
    for i, k in enumerate(kinds):
        if k == "sign":
            near = [kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(word) and (word[j].isalpha())]
            bad += 1.0 * bool(near) * (word[i] not in "“”‘’®©™")
    return bad


def features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams: row numbers and columns of the ones."""
    rows, cols = [], []
    for i, w in enumerate(words):
        b = b"^" + w.encode("utf-8", "surrogatepass") + b"$"
        for x, y in zip(b, b[1:]):
            if x > 127 or y > 127:
                rows.append(i)
                cols.append((x * 31337 + y * 65599 + (x * y) % 7919) % WIDTH)
    return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)


class ChainClassifier:
    """Multinomial classifier of the chain by hashed byte bigrams (event model, mixed with an even one)."""

    def __init__(self, smoothing: float = SMOOTHING, prior: float = PRIOR):
        self.smoothing = smoothing
        self.prior = np.full(len(CHAINS), np.log((1 - prior) / (len(CHAINS) - 1)))
        self.prior[0] = np.log(prior)

    def fit(self, words: Sequence[str], labels: Sequence[int], weights: Sequence[float]) -> ChainClassifier:
        counts = np.zeros((len(CHAINS), WIDTH))
        rows, cols = features(words)
        y, w = np.asarray(labels, dtype=np.int64), np.asarray(weights, dtype=float)
        np.add.at(counts, (y[rows], cols), w[rows])
        # a class has the mass of the words that its pages can write; a feature that no class has seen says the same of all
        mass = np.bincount(y, weights=w, minlength=len(CHAINS))
        share = mass / max(mass[0], 1e-9)
        mix = (1 - self.smoothing) * counts * (share / np.maximum(counts.sum(1), 1e-9))[:, None] + self.smoothing / WIDTH
        self.table = np.log(mix).astype(np.float32)
        return self

    def scores(self, words: Sequence[str]) -> np.ndarray:
        rows, cols = features(words)
        out = np.tile(self.prior, (len(words), 1))
        np.add.at(out, rows, self.table[:, cols].T)
        return out


def verified(word: str, scores: np.ndarray) -> str | None:
    """The restored word by the most likely chain that decodes strictly; None where none is more likely than no chain."""
    for k in np.argsort(-scores, kind="stable"):
        if k == 0:
            return None
        text = restore(word, CHAINS[k])
        if text is not None and text != word and not any(ord(c) < 32 or 0x7F <= ord(c) < 0xA0 for c in text):
            return text
    return None


def judge(classifier: ChainClassifier, words: Sequence[str]) -> list[tuple[bool, str | None]]:
    """(garbled, restored) of each word: the restored word is None where it is lost."""
    odd = [w for w in words if ODD.search(w) and "�" not in w]
    restored = {w: verified(w, s) for w, s in zip(odd, classifier.scores(odd))} if odd else {}
    out: list[tuple[bool, str | None]] = []
    for w in words:
        good = restored.get(w)
        out.append((good is not None or bool(LOST.search(w)) or any(0x7F <= ord(c) < 0xA0 for c in w), good))
    return out


def train(counted: list[tuple[str, int]]) -> ChainClassifier:
    """The classifier from the counted odd words of the sample.

    A word is trusted where no strict inverse of any chain looks more like writing, or is found more often. Trusted words are
    garbled with every chain; what comes out is the training set.
    """
    count: Counter[str] = Counter()
    for w, n in counted:
        count[bare(w)] += n
    words, labels, weights = sorted(SIGNS), [0] * len(SIGNS), [1.0] * len(SIGNS)  # signs that correct text has anywhere
    for w, n in counted:
        if not ODD.search(w) or "�" in w or any(0x7F <= ord(c) < 0xA0 for c in w):
            continue
        core = w.strip(EDGES)
        here = oddness(core)
        for chain in CHAINS[1:]:
            text = restore(core, chain)
            if text is not None and text != core and (oddness(text) < here or count.get(text.lower(), 0) > 2 * count[core.lower()]):
                break
        else:
            for form, weight in {w.upper(): CAPITALS * n, w: float(n)}.items():
                for k, chain in enumerate(CHAINS):
                    g = garble(form, chain)
                    if g is not None and (k == 0 or g != form):
                        words.append(g)
                        labels.append(k)
                        weights.append(weight)
    return ChainClassifier().fit(words, labels, weights)


def _odd_words(frames: Sequence[DataFrame]) -> DataFrame:
    """w, n: all distinct odd words of all records with their counts."""
    union = None
    for f in frames:
        one = f.where(F.col("txt").rlike(r"[^\x00-\x7f]")).select(F.explode(F.regexp_extract_all("txt", F.lit(r"([^ \t\r\n]*[^\x00-\x7f ][^ \t\r\n]*)"), F.lit(1))).alias("w"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("w").agg(F.count("*").alias("n"))


def _frame(df: DataFrame, f: Field) -> DataFrame:
    return df.select(F.lit(f.table).alias("table_name"), F.lit(f.column).alias("field_name"), F.col(f.record).cast("bigint").alias("rec_no"), F.col(f.column).alias("txt"))


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def garbled(spark: SparkSession, sources: dict[str, DataFrame], fields: Sequence[Field] = FIELDS) -> DataFrame:
    """table_name, field_name, rec_no, restored of every value with a wrong character.

    ``restored`` is the value with every restorable word restored. One pass counts odd words, a second one judges the
    values that hold one; no value is shuffled but those with a question mark at the edge of a word.
    """
    frames = [_frame(sources[f.table], f) for f in fields]
    vocabulary = cut_lineage(_odd_words(frames))
    sample = vocabulary.orderBy(F.desc("n"), "w").limit(TRAINING_WORDS).collect()
    classifier = spark.sparkContext.broadcast(train([(r["w"], r["n"]) for r in sample]))  # of fixed size

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[bool, str | None]] = {}
        for pdf in batches:
            spans = [[(x.start(), x.end(), x.group()) for x in WORD.finditer(t) if not x.group().isascii() or "?" in x.group()] for t in pdf["txt"]]
            fresh = list({w for one in spans for _, _, w in one} - seen.keys())
            if len(seen) + len(fresh) > 200_000:
                seen.clear()
                fresh = list({w for one in spans for _, _, w in one})
            seen.update(zip(fresh, judge(classifier.value, fresh)))
            hits, texts, asked = [], [], []
            for t, one in zip(pdf["txt"], spans):
                hit, parts, at, ask = False, [], 0, set()
                for a, b, w in one:
                    bad, good = seen[w]
                    hit |= bad
                    if bad and good is not None:
                        parts += [t[at:a], good]
                        at = b
                    elif not bad and "?" in w:
                        ask.add(bare(w))
                hits.append(hit)
                texts.append("".join([*parts, t[at:]]))
                asked.append([] if hit else sorted(ask))
            out = pdf.drop(columns="txt").assign(restored=texts, hit=hits, asked=pd.Series(asked, index=pdf.index, dtype=object))
            yield out[[h or bool(a) for h, a in zip(hits, asked)]]

    union = None
    for f in frames:
        one = f.where(F.col("txt").rlike(r"[^\x00-\x7f]") | F.col("txt").contains("?"))
        union = one if union is None else union.unionByName(one)
    looked = cut_lineage(union.mapInPandas(look, "table_name string, field_name string, rec_no bigint, restored string, hit boolean, asked array<string>"))
    columns = ["table_name", "field_name", "rec_no", "restored"]
    # a question mark in place of a first or last letter: the word is a frequent one but for it
    good = F.pandas_udf(lambda w: pd.Series([not bad for bad, _ in judge(classifier.value, w.tolist())], dtype="bool"), "boolean")
    frequent = vocabulary.where((F.col("n") >= TRUST) & good("w")).select(F.regexp_replace(F.lower(F.trim("w", F.lit(EDGES))), r"[^\x00-\x7f]", "?").alias("word")).distinct()
    doubtful = looked.where("not hit").groupBy(*columns, "asked").agg(F.count("*").alias("rows")).withColumn("word", F.explode("asked"))
    lost = doubtful.join(broadcast_if_small(frequent), "word", "left_semi").select(*columns, "rows").distinct()
    return looked.where("hit").select(columns).unionByName(lost.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(columns))


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {f.table: table(spark, d, f.table) for f in FIELDS}


QUERIES = {
    "p2_found": lambda spark, d: garbled(spark, _tables(spark, d)).select("table_name", "field_name", "rec_no"),
    "p2_restored": lambda spark, d: garbled(spark, _tables(spark, d)),
}
