"""Variant spellings of organisations and persons typed by people: noisy-channel attribution.

Frequent spellings are the candidate canonical forms. A variant is attached to the candidate with the largest posterior:
the log of how often the candidate occurs (the prior) plus the log likelihood that the variant was typed for it (typos per
letter, abbreviations of a trade, missing parts). Records attributed to one canonical form name one entity.

Organisations: the family names of a firm are attributed first, over the whole table, through deletion keys; then its trade
word ("Hdwe." for "Hardware"), looked up in fixed lists (none is learned); a firm that leaves its trade out goes
to the firm of that family with the largest posterior, where records of its own place weigh most. Persons: inside each
organisation the parts of a name are read (titles set aside, order, initials, nicknames), and attached to the most frequent
full form that explains them.

No group is ever expanded into its pairs before the end: attribution works on distinct spellings, and the final expansion
into pairs of records, the form the result has, is a join on the entity.

Defined cases: a null or blank client names no organisation, and its person goes to the organisation in whose postcode a
like last name stands; a person needs a last name and an organisation; rows loaded
twice under numbers of their own are records, a row repeated with its number counts once; an empty table gives an empty result; only the named columns are read; long values are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.addresses import distance, folded, less_one
from millrace.session import cut_lineage, table

# Legal forms, titles, suffixes, nicknames.
LEGAL = {"inc", "incorporated", "ltd", "limited", "co", "company", "corp", "corporation", "llc", "plc", "gmbh", "lp", "llp"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "rev", "sir"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "esq"}
NICKNAMES = {
    "alex": "alexandra", "sandra": "alexandra", "lexi": "alexandra", "joe": "joseph", "joey": "joseph", "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert",
    "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "nat": "nathaniel", "nate": "nathaniel", "flo": "florence", "bill": "william", "will": "william",
    "billy": "william", "willie": "william", "jim": "james", "jimmy": "james", "jamie": "james", "gus": "augustine", "augie": "augustine", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward", "becky": "rebecca", "becca": "rebecca",
    "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "deb": "deborah", "debbie": "deborah", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "marge": "margaret", "wally": "walter", "walt": "walter",
    "tom": "thomas", "tommy": "thomas", "zack": "zachary", "zach": "zachary", "jerry": "gerald", "gerry": "gerald", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine", "kitty": "katherine",
    "sue": "susan", "suzie": "susan", "susie": "susan", "bea": "beatrice", "trixie": "beatrice", "tony": "anthony", "izzy": "isabel", "bella": "isabel", "belle": "isabel", "dick": "richard", "rick": "richard", "rich": "richard", "richie": "richard",
    "vicky": "victoria", "tori": "victoria", "vickie": "victoria", "chris": "christopher", "kris": "christopher", "topher": "christopher", "mike": "michael", "mick": "michael", "mickey": "michael", "steve": "stephen", "fred": "frederick", "freddy": "frederick", "freddie": "frederick",
    "vince": "vincent", "vinny": "vincent", "charlie": "charles", "chuck": "charles", "chas": "charles", "hank": "henry", "harry": "henry", "obie": "obadiah", "ossie": "oscar", "hughie": "hugo",
}
#: Names that a nickname may stand for beside the first (fixed values).
ALSO = {"pat": ("patrick",), "alex": ("alexander",), "chris": ("christine",), "bill": (), "kit": ("christopher",), "ted": ("theodore", "edward")}
FULL = sorted(set(NICKNAMES.values()) | {"ursula", "quentin", "yvonne", "ingrid", "oscar", "hugo", "obadiah"})

#: Log likelihoods: a typo, an abbreviation, a missing trade, a missing initial, what can't be.
TYPO, ABBREVIATED, MISSING, UNTOLD, UNLIKE = -4.0, -0.7, -2.3, -0.5, -30.0


def _keys(word: str) -> list[str]:
    """Deletion keys of a name."""
    return sorted({word.replace("?", "")} | less_one({word}))


def edit_keys(word: str) -> list[str]:
    """Words as far apart as :func:`far` allows share one of these: the word and its spellings less one letter, less two from six
    letters on; of words of eighteen letters and more also their first and last ten letters, less one (two edits can't both be
    in both), and of words of more than twenty these alone. A lost letter (``?``) stands for each letter in turn; words with
    more of them meet by length (:func:`alike`)."""
    if word.count("?") > 1:
        return [word]
    forms = {word.replace("?", c) for c in "?abcdefghijklmnopqrstuvwxyz"} if "?" in word else {word}
    n, keys = len(word), set()
    if n <= 20:
        keys = less_one(forms)
        if n > 5:
            keys = less_one(keys)
    if n >= 18:
        keys |= {f"{w}_" for w in less_one({w[:10] for w in forms})} | {f"_{w}" for w in less_one({w[-10:] for w in forms})}
    return sorted(keys)


def one_slip(a: str, b: str) -> bool:
    """Whether one letter dropped from each, at most, makes the words equal."""
    if max(len(a), len(b)) > 40:
        return distance(a, b, 1) <= 1
    return not set(_keys(a)).isdisjoint(_keys(b))


def far(word: str) -> F.Column:
    """Edits up to which a spelling may be the word."""
    return F.when(F.length(word) <= 5, 1).otherwise(2)


def _lost(word: str) -> F.Column:
    """How many letters of a word are lost."""
    return F.length(word) - F.length(F.replace(word, F.lit("?"), F.lit("")))


def _plausible(a: str, b: str) -> F.Column:
    """Holds wherever two words are at most two edits apart (a swap counts as two there and a lost letter as one)."""
    a, b = F.col(a), F.col(b)
    whole = ~F.contains(a, F.lit("?")) & ~F.contains(b, F.lit("?"))
    near = F.when(whole, F.levenshtein(a, b, 4) >= 0).otherwise(F.levenshtein(a, b) <= 4 + _lost(a) + _lost(b))
    return (F.abs(F.length(a) - F.length(b)) <= 2) & near


#: A block whose words are compared each with each costs at most so many comparisons a word, else they meet by keys.
COMPARED = 250


def met_by_keys(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Distinct rows equal in ``on`` whose words may be two edits apart: they share one of :func:`edit_keys`, or have like length
    where one has several lost letters."""
    keys = F.pandas_udf(lambda s: s.map(edit_keys), "array<string>")
    keyed = lambda df, w: df.withColumn("key", F.explode(F.transform(keys(w), lambda k: F.xxhash64(k))))
    met = keyed(left, a).join(keyed(right, b), [*on, "key"]).drop("key")
    return met.unionByName(met_by_size(left, right, on, a, b).select(met.columns)).where(_plausible(a, b)).distinct()


def met_by_size(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Rows equal in ``on`` whose words have like length, where one has several lost letters."""
    sized = left.withColumn("size", F.length(a))
    sizes = right.withColumn("size", F.explode(F.sequence(F.length(b) - 2, F.length(b) + 2)))
    rest = sized.where(_lost(a) > 1).join(sizes, [*on, "size"])
    return rest.unionByName(sized.where(_lost(a) <= 1).join(sizes.where(_lost(b) > 1), [*on, "size"])).drop("size")


def met_in_blocks(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, where: F.Column, same: bool = False) -> DataFrame:
    """Rows equal in ``on`` whose words may be two edits apart: each is compared with each, but those of large blocks meet by
    keys. Either way none is left out that fulfils ``where``. ``same`` tells that both sides have the same blocks; the rows of each are distinct."""
    many = left.groupBy(on).agg(F.count("*").alias("n_left"))
    many = many.withColumn("n_right", F.col("n_left")) if same else many.join(right.groupBy(on).agg(F.count("*").alias("n_right")), on)
    large = cut_lineage(many.where(F.col("n_left") * F.col("n_right") > COMPARED * (F.col("n_left") + F.col("n_right"))).select(on))
    if large.isEmpty():
        return left.join(right, on).where(where & _plausible(a, b))
    small = left.join(large, on, "left_anti").join(right, on).where(where & _plausible(a, b))
    return small.unionByName(met_by_keys(left.join(large, on, "left_semi"), right.join(large, on, "left_semi"), on, a, b).where(where).select(small.columns))


def alike(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, where: F.Column | None = None, same: bool = False) -> DataFrame:
    """Rows of ``left`` and ``right``, distinct in each, equal in ``on`` whose words ``a`` and ``b`` are at most two edits apart
    (none is left out that :func:`far` accepts), with their distance ``d``."""
    where = F.lit(True) if where is None else where
    met = met_in_blocks(left, right, on, a, b, where, same) if on else met_by_keys(left, right, on, a, b).where(where)
    return apart(met, a, b).where("d <= 2")


def apart(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the distance ``d`` of its words, 3 where they are further apart."""
    near = F.pandas_udf(lambda x, y: pd.Series([distance(v, w, 2) for v, w in zip(x, y)], dtype="int32"), "int")
    return df.withColumn("d", near(a, b))


#: Words up to this length have their keys of one slip built in the plan; :func:`edit_keys` bounds the keys of longer ones.
PLAIN = 17


def met_by_slip(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose words :func:`one_slip` accepts or that are one edit apart, with others."""
    long = F.pandas_udf(lambda s: s.map(edit_keys), "array<string>")
    odd = lambda w: (F.length(w) > PLAIN) | F.contains(w, F.lit("?"))

    def keyed(df: DataFrame, w: str) -> DataFrame:
        less = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(PLAIN))))
        plain = F.array_distinct(F.concat(F.array(w), less))
        key = lambda ks: F.explode(F.transform(ks, lambda k: F.xxhash64(k)))
        return df.where(~odd(F.col(w))).withColumn("key", key(plain)).unionByName(df.where(odd(F.col(w))).withColumn("key", key(long(w))))

    met = keyed(left, a).join(keyed(right, b), "key").drop("key")
    several = left.select(a).unionByName(right.select(F.col(b).alias(a))).where(_lost(a) > 1)
    return met if several.isEmpty() else met.unionByName(met_by_size(left, right, [], a, b).select(met.columns))


_AND, _THE, _TURNED = re.compile(r"\s(\+|/|and)\s|\s*&\s*"), re.compile(r"^\s*the\s+"), re.compile(r"\s*([^,&]+?)\s*,\s*(.+?)\s*")
_ORG_WORDS, _WORDS, _NUMBER, _NO_DIGIT = re.compile(r"[a-z?']+|&"), re.compile(r"[a-z?']+"), re.compile(r"\d+"), re.compile(r"\D")


def org_parts(name: str | None) -> tuple[str, str, str] | None:
    """(initials, family names joined by &, trade words) of a firm; legal forms and articles are set aside."""
    if not name or not name.strip():
        return None
    text = folded(name)
    text = _AND.sub(" & ", f" {text} ")
    if "the" in text:
        text = _THE.sub(" ", text)
    if "," in text and (m := _TURNED.fullmatch(text)):  # "Bookshop, Preinbuell", "Cintekell, R. Textiles"
        head, tail = m[1], m[2]
        bare = [w for w in re.findall(r"[a-z?]+", tail) if w not in LEGAL]
        if bare:
            text = f"{tail} {head}" if not re.match(r"[a-z]\.", tail) else f"{re.match(r'[a-z]', tail)[0]}. {head} {tail[2:]}"
    words = _ORG_WORDS.findall(text.replace("'s ", "s "))
    while words and (words[-1] in LEGAL or words[-1] == "&"):
        words.pop()
    words = [w for i, w in enumerate(words) if not (w in LEGAL and i > 0)]
    initials = "".join(w for w in words if len(w) == 1 and w not in "&?")
    words = [w for w in words if len(w) > 1 or w == "&"]
    while words and words[0] == "&":
        words.pop(0)
    if not words:
        return None
    return initials, " ".join(words), ""


# Trades and kinship words of firms (the open part of a firm's name is its family).
TRADES = (
    "music drainage motors orchards exports optical rentals trading leather printing packaging interiors timber associates ceramics foods bakery bookshop marine glass furniture "
    "fisheries hardware papers dairy surveying catering metals electric imports brothers textiles gardens lighting galleries plumbing supply freight sons daughters"
).split()
SPECIAL = {
    "printers": "printing", "bakers": "bakery", "books": "bookshop", "book": "bookshop", "shop": "bookshop", "pkg": "packaging", "pack": "packaging", "bkry": "bakery", "prtg": "printing", "sply": "supply", "supplies": "supply", "dtrs": "daughters", "son": "sons",
    "bros": "brothers", "int": "interiors", "imp": "imports", "exp": "exports", "frt": "freight", "mar": "marine", "mus": "music", "opt": "optical", "glassworks": "glass", "gallery": "galleries", "gall": "galleries", "dairies": "dairy", "electrical": "electric", "elec": "electric",
    "survey": "surveying", "surv": "surveying", "rent": "rentals", "rental": "rentals", "text": "textiles", "ceram": "ceramics", "cater": "catering", "fish": "fisheries", "orch": "orchards", "furn": "furniture", "furnit": "furniture", "hdwe": "hardware", "lghtg": "lighting", "lthr": "leather", "plbg": "plumbing",
    "trdg": "trading", "drain": "drainage", "assoc": "associates", "metal": "metals", "paper": "papers", "motor": "motors", "food": "foods", "timbers": "timber", "garden": "gardens",
}


#: No known word is longer than this less one letter.
LONGEST_KNOWN = 40


def _near_index(words) -> dict[str, str]:
    """Deletion keys of words of five letters and more."""
    return {k: w for w in words if len(w) >= 5 for k in _keys(w)}


def _near(word: str, index: dict[str, str]) -> list[str]:
    """Words of the index that share a key with the word, in the order of the keys; most words share none."""
    keys = [k for k in (word.replace("?", ""), word, *[word[:i] + word[i + 1 :] for i in range(len(word))]) if k in index]
    return [index[k] for k in sorted(set(keys))]


@lru_cache(maxsize=200_000)
def trade_of(word: str) -> str | None:
    """The trade that a word of a firm's name stands for, also mistyped."""
    if word in _TRADES:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if 5 <= len(word) <= LONGEST_KNOWN:
        for w in _near(word, _TRADE_KEYS):
            if distance(word, w, 1) <= 1:
                return SPECIAL.get(w, w)
    return None


def firm(name: str | None) -> tuple[str, str, str] | None:
    """(initials, families, trade): families in their order, joined by &; the trade is empty where it is left out."""
    p = org_parts(name)
    if p is None:
        return None
    initials, words, _ = p
    families, trades = [], []
    for w in words.split():
        if w == "&":
            continue
        t = trade_of(w)
        if t:
            trades.append(t)
        else:
            families.append(w)
    if not families:  # a family that reads like a trade
        families, trades = words.replace("&", " ").split()[:1], trades[1:]
    return initials, "&".join(families[:2]), trades[0] if trades else ""


def person(last: str | None, first: str | None) -> tuple[str, str, str] | None:
    """(last name, first name or initial, middle initial) as typed, in their likely order; both may stand in one field."""
    raw = folded(last or "").strip()
    if not raw:
        return None
    second = folded(first or "").strip()
    clean = lambda s: [w for w in _WORDS.findall(s) if w not in TITLES and w not in SUFFIXES]
    a, b = clean(raw), clean(second)
    if not a and not b:
        return None
    if not b:
        if "," in raw and len(a) >= 2:
            tail = clean(raw.split(",", 1)[1])
            if tail:
                return a[0], tail[0], tail[1][0] if len(tail) > 1 else ""
        if len(a) >= 2:
            return a[-1], a[0], a[1][0] if len(a) > 2 else ""
        return a[0], "", ""
    if not a:
        return None
    # swapped fields: the last name holds a given name or an initial and the other doesn't
    given = lambda w: bool(w) and (len(w[0]) == 1 or first_names(w[0]) is not None)
    if given(a) and not given(b):
        a, b = b, a
    return a[-1] if len(a[0]) == 1 else a[0], b[0], b[1][0] if len(b) > 1 else ""


@lru_cache(maxsize=200_000)
def first_names(word: str) -> frozenset[str] | None:
    """Full first names that a word may stand for, None where it is no known name."""
    if word in NICKNAMES:
        return frozenset((NICKNAMES[word], *ALSO.get(word, ())))
    if word in _FULL:
        return frozenset((word,))
    if 4 <= len(word) <= LONGEST_KNOWN:
        for w in _near(word, _FIRST_KEYS):
            if distance(word, w, 1) <= 1:
                return frozenset((w,))
    return None


_FULL, _TRADES = frozenset(FULL), frozenset(TRADES)
_FIRST_KEYS = _near_index(FULL)
_TRADE_KEYS = _near_index([*TRADES, *SPECIAL])


def likelihood(last: str, first: str, middle: str, c_last: str, c_first: str, c_middle: str) -> float:
    """Log likelihood that a person typed as given is the candidate (whose first name is written out where it is known)."""
    d = distance(last, c_last, 2)
    if d > (1 if len(c_last) <= 5 else 2):
        return UNLIKE
    score = TYPO * d
    if not first:
        score += MISSING
    elif len(first) == 1:
        score += ABBREVIATED if c_first.startswith(first) else UNLIKE
    elif first != c_first:
        names, theirs = first_names(first), first_names(c_first)
        if names and theirs and names & theirs:
            score += ABBREVIATED
        elif len(c_first) == 1 and (first[0] == c_first or names and any(n[0] == c_first for n in names)):
            score += ABBREVIATED
        elif distance(first, c_first, 2) <= (1 if len(first) <= 5 else 2):
            score += TYPO * distance(first, c_first, 2)
        else:
            score += UNLIKE
    if middle and c_middle and middle != c_middle:
        score += 2 * TYPO
    return score


def attribute(forms: list[tuple[str, str, str]], counts: list[int]) -> list[int]:
    """For each distinct person of one organisation the index of the canonical form of largest posterior.

    Candidates are ranked by how much they tell and how often they occur; a form that no better one explains is its own.
    """

    def told(i: int) -> tuple[int, int, int]:
        last, first, middle = forms[i]
        known = first_names(first) is not None and first in _FULL
        return (2 if known else 1 if len(first) > 1 else 0, counts[i], len(middle))

    order = sorted(range(len(forms)), key=lambda i: (told(i), forms[i]), reverse=True)
    home, logs = list(range(len(forms))), [np.log(n) for n in counts]
    heads: list[int] = []
    for i in order:
        best, score = i, UNLIKE / 2
        for h in heads:
            s = logs[h] + likelihood(*forms[i], *forms[h])
            if s > score:
                best, score = h, s
        home[i] = best
        if best == i:
            heads.append(i)
    return home


_PARTS = "rec_no bigint, initials string, family string, trade string, place string, last string, first string, middle string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for rec_no, client, last, first, code, address in zip(*(pdf[c] for c in ("rec_no", "client", "lastname", "firstname", "zip", "address"))):
            f = firm(client) or (None, None, None)
            p = person(last, first) or (None, None, None)
            zip5 = _NO_DIGIT.sub("", code)[:5] if isinstance(code, str) else ""
            number = _NUMBER.search(address) if isinstance(address, str) else None
            out.append((rec_no, *f, f"{zip5}/{number[0] if number else ''}", *p))
        yield pd.DataFrame(out, columns=["rec_no", "initials", "family", "trade", "place", "last", "first", "middle"])


def canonical_words(df: DataFrame, times: int = 2) -> DataFrame:
    """``word``, ``usual``: for each family name the candidate of largest posterior (log frequency plus typo likelihood).

    ``df`` has word and ctx (places and trades it stands at). Candidates are one edit away, two from six letters on, and are more than ``times`` as
    frequent, or at least as frequent where both stand in one context.
    """
    spelled = cut_lineage(df.groupBy("word").agg(F.count("*").alias("n")))
    others = spelled.select(F.col("word").alias("usual"), F.col("n").alias("n2"))
    better = (F.col("n2") > F.col("n")) | (F.col("n2") == F.col("n")) & (F.col("usual") < F.col("word"))
    # words that share a context, any two edits apart: each two meet once, then the better one is the candidate
    contexts = df.select("word", F.explode("ctx").alias("c")).where("c is not null").repartition("c").distinct()
    there = met_in_blocks(contexts, contexts.select("c", F.col("word").alias("usual")), ["c"], "word", "usual", F.col("word") < F.col("usual"), same=True)
    there = there.select("word", "usual").distinct()
    there = there.join(spelled, "word").join(others, "usual").withColumn("better", better)
    turned = (("word", "usual"), ("usual", "word"), ("n", "n2"), ("n2", "n"))
    there = there.select(*[F.when(F.col("better"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in turned], F.lit(True).alias("together"))
    # elsewhere a candidate is more than ``times`` as frequent, so that few words are candidates
    frequent = F.col("n2") > times * F.col("n")
    slipped = met_by_slip(spelled, others.where(F.col("n2") > times), "word", "usual").where(frequent & _plausible("word", "usual")).withColumn("together", F.lit(False))
    met = there.unionByName(slipped.select(there.columns)).groupBy("word", "usual", "n", "n2").agg(F.max("together").alias("together"))
    scored = apart(met, "word", "usual").where(F.col("d") <= far("usual"))
    # two slips apart from each other tell the same family only where a place agrees: many families are as near as that
    slip = F.pandas_udf(lambda a, b: pd.Series([one_slip(x, y) for x, y in zip(a, b)], dtype="bool"), "boolean")
    scored = scored.where(F.col("together") | (F.col("d") <= 1) | (F.col("n2") > 4 * F.col("n"))).withColumn("slip", slip("word", "usual"))
    scored = scored.where(F.col("together") | (F.col("d") <= 1) | F.col("slip"))
    scored = scored.withColumn("posterior", F.log("n2") + F.lit(TYPO) * F.col("d") + F.when(F.col("together"), F.lit(-TYPO)).otherwise(0.0))
    best = cut_lineage(scored.groupBy("word").agg(F.max(F.struct("posterior", "usual")).alias("m")).select("word", F.col("m.usual").alias("usual")))
    for _ in range(2):  # the candidate of the candidate
        best = best.join(best.select(F.col("word").alias("usual"), F.col("usual").alias("next")), "usual", "left").select("word", F.coalesce("next", "usual").alias("usual"))
    return best


def organisations(read: DataFrame) -> DataFrame:
    """rec_no and ``org``, the canonical firm of each record that names one; also place, last, first, middle."""
    named = read.where("family is not null and family <> ''")
    zip5 = F.substring_index("place", "/", 1)
    ctx = F.array(F.when(zip5 != "", F.concat_ws("|", zip5, "trade")), F.when((zip5 != "") & ~F.endswith("place", F.lit("/")), F.col("place")))
    usual = canonical_words(named.select(F.explode(F.split("family", "&")).alias("word"), ctx.alias("ctx")))
    # a family of one word takes the word's usual spelling, one of several is put together again
    words = named.where("family like '%&%'").select("family").distinct().withColumn("pos_word", F.explode(F.transform(F.split("family", "&"), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))))
    words = words.select("family", "pos_word.pos", "pos_word.word").join(usual, "word", "left")
    families = words.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("usual", "word").alias("w")))).alias("ws"))
    families = families.select("family", F.array_join(F.transform("ws", lambda x: x["w"]), "&").alias("house"))
    families = families.unionByName(usual.select(F.col("word").alias("family"), F.col("usual").alias("house")))
    named = cut_lineage(named.join(families, "family", "left").withColumn("house", F.coalesce("house", "family")))
    # the firms of a house: its initials, where given, and its trade; a part left out goes to the likeliest firm
    firms = named.where("trade <> '' or family like '%&%'").groupBy("house", "initials", "trade").agg(F.count("*").alias("n"))
    places = named.where("trade <> '' or family like '%&%'").groupBy("house", "initials", "trade", "place").agg(F.count("*").alias("at"))
    asked = named.groupBy("house", "initials", "trade", "place").agg(F.count("*").alias("m"))
    cand = firms.select("house", F.col("initials").alias("ci"), F.col("trade").alias("ct"), "n")
    at = places.select("house", F.col("initials").alias("ci"), F.col("trade").alias("ct"), "place", "at")
    fits = ((F.col("trade") == F.col("ct")) | (F.col("trade") == "")) & ((F.col("initials") == F.col("ci")) | (F.col("initials") == ""))
    scored = (
        asked.join(cand, "house").where(fits).join(at, ["house", "ci", "ct", "place"], "left")
        # a form is no evidence for itself
        .withColumn("own", F.when((F.col("trade") == F.col("ct")) & (F.col("initials") == F.col("ci")), F.col("m")).otherwise(0))
        .withColumn("posterior", F.log(F.greatest(F.col("n") - F.col("own"), F.lit(0.5))) + F.when(F.col("trade") == F.col("ct"), 0.0).otherwise(MISSING) + F.when(F.col("initials") == F.col("ci"), 0.0).otherwise(UNTOLD) + 5 * F.log1p(F.greatest(F.coalesce("at", F.lit(0)) - F.col("own"), F.lit(0))))
        .groupBy("house", "initials", "trade", "place").agg(F.max(F.struct("posterior", "ct", "ci")).alias("m"))
    )
    homes = scored.select("house", "initials", "trade", "place", F.concat_ws("|", "house", "m.ct", "m.ci").alias("org"))
    out = named.join(homes, ["house", "initials", "trade", "place"], "left")
    return out.withColumn("org", F.coalesce("org", F.concat_ws("|", "house", "trade", "initials"))).select("rec_no", "org", "place", "last", "first", "middle")


def people(orgs: DataFrame) -> DataFrame:
    """rec_no and ``who``, the canonical person of an organisation. Distinct forms are attributed inside blocks of one
    organisation and last names of like spelling, so a block is as large as the spellings of one name, not as its records."""
    typed = orgs.where("last is not null and last <> ''")
    forms = cut_lineage(typed.groupBy("org", "last", "first", "middle").agg(F.count("*").alias("n")))
    usual = _usual_in_org(forms)
    forms = forms.join(usual, ["org", "last"], "left").withColumn("block", F.coalesce("usual", "last")).drop("usual")

    blocks = forms.groupBy("org", "block").agg(F.collect_list(F.struct("last", "first", "middle", "n")).alias("forms"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for org, block in zip(pdf["org"], pdf["forms"]):
                block = sorted((r["last"], r["first"], r["middle"], r["n"]) for r in block)
                rows = [r[:3] for r in block]
                home = attribute(rows, [r[3] for r in block]) if len(rows) > 1 else [0]
                out += [(org, *r, " ".join((org, *rows[h]))) for r, h in zip(rows, home)]
            yield pd.DataFrame(out, columns=["org", "last", "first", "middle", "who"])

    solved = blocks.mapInPandas(solve, "org string, last string, first string, middle string, who string")
    return typed.join(solved, ["org", "last", "first", "middle"]).select("rec_no", "who")


def placed_orgs(read: DataFrame, orgs: DataFrame) -> DataFrame:
    """Records that name no firm but a person: they go to the firm in whose postcode a like last name stands, first where
    the house number is the same too, then where it stands most often. Columns as :func:`organisations`."""
    zip5 = F.substring_index("place", "/", 1)
    alone = read.where("(family is null or family = '') and last is not null and length(last) > 1").withColumn("zip5", zip5).where("zip5 <> ''")
    known = orgs.where("last is not null and length(last) > 1").groupBy("org", "place", "last").agg(F.count("*").alias("n")).withColumn("zip5", zip5).where("zip5 <> ''")
    asked = alone.select("zip5", "place", "last").distinct()
    there = known.select("zip5", F.col("place").alias("there"), F.col("last").alias("like"), "org", "n")
    there = there.join(asked.select("zip5").distinct(), "zip5", "left_semi")
    met = alike(asked, there, ["zip5"], "last", "like").where(F.col("d") <= far("like"))
    same = (F.col("place") == F.col("there")) & ~F.endswith("place", F.lit("/"))
    best = met.groupBy("place", "last").agg(F.max(F.struct(same.cast("int").alias("same"), -F.col("d"), F.col("n"), F.col("org"))).alias("m")).select("place", "last", F.col("m.org").alias("org"))
    return alone.join(best, ["place", "last"]).select("rec_no", "org", "place", "last", "first", "middle")


def _usual_in_org(forms: DataFrame) -> DataFrame:
    """org, last, usual: the most frequent like spelling of a last name inside its organisation."""
    spelled = cut_lineage(forms.groupBy("org", "last").agg(F.sum("n").alias("n")))
    better = (F.col("n2") > F.col("n")) | (F.col("n2") == F.col("n")) & (F.col("usual") < F.col("last"))
    scored = alike(spelled, spelled.select("org", F.col("last").alias("usual"), F.col("n").alias("n2")), ["org"], "last", "usual", better, same=True)
    best = scored.where(F.col("d") <= far("last")).groupBy("org", "last").agg(F.max(F.struct(F.log("n2") + F.lit(TYPO) * F.col("d"), F.col("usual"))).alias("m")).select("org", "last", F.col("m.usual").alias("usual"))
    best = cut_lineage(best)
    # one more step: the usual form of the usual form
    two = best.select("org", F.col("last").alias("usual"), F.col("usual").alias("usual2"))
    return best.join(two, ["org", "usual"], "left").select("org", "last", F.coalesce("usual2", "usual").alias("usual"))


def _pairs(df: DataFrame, entity: str, kind: str) -> DataFrame:
    a, b = df.select(entity, F.col("rec_no").alias("rec_no_a")), df.select(entity, F.col("rec_no").alias("rec_no_b"))
    return a.join(b, entity).where("rec_no_a < rec_no_b").select(F.lit(kind).alias("kind"), "rec_no_a", "rec_no_b")


def same_names(clients: DataFrame) -> DataFrame:
    """kind, rec_no_a, rec_no_b of every two records of one organisation or one person."""
    cols = clients.select(F.col("rec_no").cast("bigint").alias("rec_no"), "client", "lastname", "firstname", "zip", "address").where("rec_no is not null and (client is not null or lastname is not null)").distinct()
    read = cut_lineage(cols.mapInPandas(_read, _PARTS))
    orgs = cut_lineage(organisations(read))
    return _pairs(orgs, "org", "org").unionByName(_pairs(people(cut_lineage(orgs.unionByName(placed_orgs(read, orgs)))), "who", "person"))


QUERIES = {"p4_found": lambda spark, d: same_names(table(spark, d, "client"))}
