"""The same postal address written differently: which records denote one location.

Addresses are split into components (number or box, direction, street words, street type; unit, floor and landmark are
set aside) and the town is settled from city, state and zip by the spellings most records use. Equal components become one
variant with its records as members. Variants meet through a deletion-neighbourhood index on their street words inside blocks
of town and house number (the number is a hard veto; the blocks of a postcode and of its neighbouring locality are the same
town). The index covers every distance that is accepted (:func:`index_keys`), whatever the size of a block. Street words
of two variants are then put together by the optimal assignment; types and directions veto where both are given.

Work is between variants, so that any number of equal records costs one comparison; only the final expansion gives a row
for each pair of records, which is the form the result has.

Defined cases: a null or blank address, one without a number or box, or without any town, matches nothing; rows loaded
twice under numbers of their own are records and match each other, a row repeated with its number counts once; an empty table gives an empty result; only the named columns are read; a
text of any length is read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.encodings import PAIRS, restore
from millrace.session import broadcast_if_small, cut_lineage, table

# Street types and their abbreviations, directions, words of units and landmarks.
TYPES = {
    "street": "st", "str": "st", "st": "st", "avenue": "av", "ave": "av", "av": "av", "road": "rd", "rd": "rd", "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln",
    "boulevard": "bl", "blvd": "bl", "boul": "bl", "court": "ct", "ct": "ct", "place": "pl", "pl": "pl", "square": "sq", "sq": "sq", "terrace": "te", "ter": "te", "terr": "te",
    "highway": "hw", "hwy": "hw", "parkway": "pk", "pkwy": "pk", "pky": "pk", "crescent": "cr", "cres": "cr", "cr": "cr", "way": "wy", "circle": "ci", "cir": "ci",
}
LONG_TYPES = [w for w in TYPES if len(w) >= 4]
DIRECTIONS = {"n": "n", "north": "n", "no": "n", "s": "s", "south": "s", "so": "s", "e": "e", "east": "e", "w": "w", "west": "w", "northeast": "ne", "ne": "ne", "northwest": "nw", "nw": "nw", "southeast": "se", "se": "se", "southwest": "sw", "sw": "sw"}
UNITS = {"apt", "apartment", "ste", "suite", "unit", "rm", "room", "fl", "floor", "bldg", "building", "dept"}
LANDMARKS = {"near", "opp", "opposite", "behind", "rear", "upstairs", "c", "co", "at", "lobby", "annex", "warehouse", "loading", "gatehouse", "kiosk", "mezzanine", "courtyard", "basement", "depot", "dock", "entrance", "attn", "wing", "next", "level", "lower", "upper"}
_UNIT_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth".split()
_TEENS = "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {w: str(i) for i, w in enumerate([*_UNIT_ORDINALS, *_TEENS], 1)} | {f"{w[:-1]}ieth": str(10 * i) for i, w in enumerate(_TENS, 2)}
_TEN_VALUES = {w: 10 * i for i, w in enumerate(_TENS, 2)}
CITY_WORDS = {"mt": "mount", "st": "saint", "ft": "fort", "n": "north", "s": "south", "e": "east", "w": "west"}

_TOKEN = re.compile(r"\d+(?:st|nd|rd|th)\b|#?\d+[a-z]?(?![a-z\d])|\d+|[^\W\d_?]*(?:\?+[^\W\d_?]*)+|[^\W\d_]+|[#,/&]")
_LETTERS = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ð": "d", "þ": "th"}


def folded(text: str) -> str:
    """Lower case without accents; text in a wrong code page is put right where its bytes say so, and otherwise each
    run of strange signs becomes one question mark."""
    if not text.isascii():
        for _ in range(2):
            for chain in PAIRS:
                if chain[0] == "utf-8" and (t := restore(text, (chain,))) is not None and t != text:
                    text = t
                    break
            else:
                break
        out = []
        for c in text.lower():
            base = c if c.isascii() or not c.isalpha() else _LETTERS.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            out.append(base if base.isascii() else "\x00")
        text = re.sub("\x00+", "?", "".join(out))
    return text.lower()


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits (letters inserted, dropped, replaced, two neighbours swapped) between words; ``most`` + 1 where more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # equal ends cost nothing; between them only the band of the matrix that can end within ``most`` is filled
    low, size = 0, min(len(a), len(b))
    while low < size and a[low] == b[low]:
        low += 1
    high = 0
    while high < size - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    far, n = most + 1, len(b)
    before, row = None, [min(j, far) for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        new = [far] * (n + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y and x != "?" and y != "?"))
            if before is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            new[j] = best
        if min(new[max(0, i - most) : i + most + 1]) > most:
            return far
        before, row = row, new
    return min(row[-1], far)


def _type(word: str) -> str | None:
    """The street type of a word that may be mistyped or cut."""
    if word in TYPES:
        return TYPES[word]
    if len(word) >= 5:
        for t in LONG_TYPES:
            if len(t) >= 5 and distance(word, t, 1) <= 1:
                return TYPES[t]
    return None


def components(address: str | None) -> tuple[str, str, str, str, bool] | None:
    """(number, direction, street, type, cut): street words joined by blanks; a box has the number and the street ``box``.

    ``cut`` tells that the street is the last thing in the text, so that it may be cut short.
    """
    if not address or not address.strip():
        return None
    text = folded(address).replace("p.o.", "po ").replace("p. o.", "po ").replace("c/o", "near")
    tokens = _TOKEN.findall(text)
    flat = [t for t in tokens if t not in ",/&"]
    for i, t in enumerate(flat):
        if t == "box" and i + 1 < len(flat) and flat[i + 1].lstrip("#").isdigit() and all(x in ("p", "o", "po", "post", "office") for x in flat[:i]):
            return flat[i + 1].lstrip("#").lstrip("0") or "0", "", "box", "", False
    # a unit before the number: "Fl 7, 6506 E Main"
    i, plain = 0, []
    while i < len(tokens):
        t = tokens[i]
        if t in UNITS:
            j = i + 1
            while j < len(tokens) and tokens[j] in (",", "#"):
                j += 1
            if j < len(tokens) and (tokens[j][0].isdigit() or tokens[j][0] == "#" or len(tokens[j]) == 1):
                j += 1
            if plain and any(x[0].isdigit() for x in plain):  # behind the street everything is set aside
                break
            i = j
            continue
        if t[0] == "#" and len(t) > 1:
            if plain or any(x.isdigit() for x in tokens[i + 1 :]):
                i += 1
                continue
            t = t[1:]
        plain.append(t)
        i += 1
    words = [t for t in plain if t not in ("#", "/", "&")]
    while words and words[0] == ",":
        words.pop(0)
    for j in range(len(words) - 1):  # "twenty first"
        if words[j] in _TEN_VALUES and words[j + 1] in _UNIT_ORDINALS:
            words[j : j + 2] = [f"{_TEN_VALUES[words[j]] + _UNIT_ORDINALS.index(words[j + 1]) + 1}th"]
            break
    number, street, direction, kind, cut = None, [], "", "", False
    ended = False
    k = 0
    while k < len(words):
        w = words[k]
        if w == ",":
            if street:
                ended = True
            k += 1
            continue
        if w == "no" and k + 1 < len(words) and words[k + 1].isdigit() and number is None and (k == 0 or street or not any(x.isdigit() for x in words[k + 2 :])):
            if k == 0 or street:
                number = words[k + 1]
                k += 2
                continue
        if re.fullmatch(r"\d+[a-z]?", w):
            later = [x for x in words[k + 1 :] if x != ","]
            if number is None and not street and (later and not (len(later) >= 2 and _type(later[0]) and later[-1].isdigit() and "," not in words[:k])):
                number = w
            elif number is None and street:
                number = w
            elif number is None:
                street.append(w)  # "41 St 12": a numbered street with its house number behind
            elif not street:
                street.append(w)
            k += 1
            continue
        if m := re.fullmatch(r"(\d+)(st|nd|rd|th)", w):
            if not street:
                street.append(m[1])
            k += 1
            continue
        if ended or w == "old" and street or w in LANDMARKS and (street or number is None and not street):
            if w in LANDMARKS and not street:
                k += 1
                continue
            ended = True
            k += 1
            # a number behind a landmark is still the house number of a street given first
            rest = [x for x in words[k:] if x.isdigit()]
            if number is None and rest:
                number = rest[-1]
            continue
        if w in DIRECTIONS and not direction and (len(w) != 2 or w in ("no", "so") or not street) and (not street or kind or k == len(words) - 1 or words[k + 1] == "," or words[k + 1].isdigit() or words[k + 1] in LANDMARKS or words[k + 1] in UNITS or words[k + 1] == "no"):
            after = [x for x in words[k + 1 :] if x != "," and not x.isdigit()]
            if street or after and not (len(after) == 1 and _type(after[0]) and not any(re.match(r"\d", x) for x in words[k + 1 :])):
                direction = DIRECTIONS[w]
                k += 1
                continue
        if street and not kind and (t := _type(w)):
            kind = t
            k += 1
            continue
        if kind:
            ended = True
            k += 1
            continue
        if street and k == len(words) - 1 and (t := [x for x in LONG_TYPES if x.startswith(w)] or len(w) <= 2):
            if len(w) >= 3 and t is not True and len({TYPES[x] for x in t}) == 1:
                kind = TYPES[t[0]]
            else:
                cut = True  # the fragment of a type or of one more street word
            k += 1
            continue
        street.append(ORDINALS.get(w, w) if not street else w)
        cut = all(x == "," for x in words[k + 1 :])
        k += 1
    if number is None or not street:
        return None
    street = [re.sub("(?<=[aou])e", "", {"saint": "st", "mount": "mt"}.get(w, w)) for w in street]  # also umlauts typed as ae, oe, ue
    return number.lstrip("0") or "0", direction, " ".join(street), kind, cut and not kind and i >= len(tokens)


#: Edits that a street word left over in an assignment costs, more than any street may differ by.
LEFT_OVER = 3


def assignment(a: list[str], b: list[str], most: int) -> int:
    """Edits of the cheapest way to put street words together: one to one, in any order and of any number, a word left over
    costing ``LEFT_OVER``; or written as one word, where only the blanks differ."""
    joined = distance("".join(a), "".join(b), most)
    if joined == 0 or len(a) != len(b) and abs(len(a) - len(b)) * LEFT_OVER > most:
        return joined
    size = max(len(a), len(b))
    cost = [[distance(a[i], b[j], LEFT_OVER) if i < len(a) and j < len(b) else LEFT_OVER for j in range(size)] for i in range(size)]
    return min(joined, cheapest(cost), most + 1)


def cheapest(cost: list[list[int]]) -> int:
    """The least sum that takes one cost of each row and column (shortest augmenting paths with row and column prices)."""
    n = len(cost)
    row_price, column_price, row_of = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1)
    for start in range(n):
        row_of[n], at = start, n
        short, back, done = [1 << 30] * n, [n] * n, [False] * (n + 1)
        while row_of[at] != n:
            done[at] = True
            i, step, following = row_of[at], 1 << 30, n
            for j in range(n):
                if not done[j]:
                    reduced = cost[i][j] - row_price[i] - column_price[j]
                    if reduced < short[j]:
                        short[j], back[j] = reduced, at
                    if short[j] < step:
                        step, following = short[j], j
            for j in range(n + 1):
                if done[j]:
                    row_price[row_of[j]] += step
                    column_price[j] -= step
                elif j < n:
                    short[j] -= step
            at = following
        while at != n:
            row_of[at], at = row_of[back[at]], back[at]
    return sum(cost[row_of[j]][j] for j in range(n))


def less_one(words: set[str]) -> set[str]:
    return words | {w[:i] + w[i + 1 :] for w in words for i in range(len(w))}


def word_keys(word: str) -> set[str]:
    """Keys of a street word: two words share one wherever they are one edit apart, or two from six letters on.

    Words of up to five letters give their spellings less one letter, those of six and seven less two. Of longer words the
    first and the last four letters are taken, less one: two edits can't both be in both. A lost letter (``?``) stands for
    each letter in turn.
    """
    forms = {word.replace("?", c) for c in "?abcdefghijklmnopqrstuvwxyz"} if "?" in word else {word}
    n = len(word)
    keys: set[str] = less_one(forms) if n <= 7 else set()
    if 6 <= n <= 7:
        keys = less_one(keys)
    if n >= 6:
        keys |= {f"{w}_" for w in less_one({w[:4] for w in forms})} | {f"_{w}" for w in less_one({w[-4:] for w in forms})}
    return keys


def index_keys(street: str, cut: bool) -> list[str]:
    """Keys of a street: any two that :func:`same_street` accepts share one, but where more than one letter of a word is lost
    (``?`` alone is the key that asks for every street of the block).

    Each word is keyed, and the street written as one word where it has several; of words put together in an order of their
    own at least one pair is at most one edit apart. The first letters cover a street that was cut.
    """
    if street == "box" or street.isdigit():
        return [street]
    words = {*street.split(), street.replace(" ", "")}
    keys = set().union(*(word_keys(w) for w in words if w.count("?") <= 1))
    keys |= {f"^{w}" for w in less_one({street[:6]})} | {f"^^{street[:4]}"}
    if any(w.count("?") > 1 for w in words) or "?" in street[:6]:
        keys.add("?")
    return sorted(keys)


def same_street(a: tuple[str, str, str, bool], b: tuple[str, str, str, bool]) -> bool:
    """Whether two (direction, street, type, cut) at one number in one town denote the same street."""
    (da, sa, ta, ca), (db, sb, tb, cb) = a, b
    if da and db and da != db or ta and tb and ta != tb:
        return False
    if sa == sb:
        return True
    if "box" in (sa, sb) or sa.isdigit() or sb.isdigit():
        return False
    short, long, cut = (sa, sb, ca) if len(sa) <= len(sb) else (sb, sa, cb)
    if cut and len(short) >= 4 and long.startswith(short):
        return True
    if cut and len(short) >= 6 and len(long) > len(short) and distance(short, long[: len(short)], 1) <= 1:
        return True
    most = 1 if len(short) <= 5 else 2
    return assignment(sa.split(), sb.split(), most) <= most


_PARSED = "rec_no bigint, number string, direction string, street string, kind string, cut boolean, city string, state string, zip string, extra string"


def _city(text: str) -> str:
    words = re.sub(r"[^a-z?]+", " ", folded(text)).split()
    return " ".join([*(CITY_WORDS.get(w, w) for w in words[:1]), *words[1:]])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            c = components(r.address)
            if c is None:
                continue
            city = _city(r.city) if isinstance(r.city, str) else ""
            state = r.state.strip().lower() if isinstance(r.state, str) else ""
            zip5 = (re.sub(r"\D", "", r.zip)[:5] if isinstance(r.zip, str) else "").rjust(5, "0") if isinstance(r.zip, str) and r.zip.strip() else ""
            extra = ""
            if not city and "," in r.address:
                extra = _city(r.address.rsplit(",", 1)[1])
            out.append((r.rec_no, *c, city, state, zip5, extra))
        yield pd.DataFrame(out, columns=["rec_no", "number", "direction", "street", "kind", "cut", "city", "state", "zip", "extra"])


def towns(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``town``: the state and the usual spelling of the city, null where neither city nor zip tells.

    Spellings of cities are counted per state; a rare one takes the name of the most frequent spelling within two edits
    that shares a deletion key. A zip stands for the town most of its records name.
    """
    w_zip = Window.partitionBy("zip").orderBy(F.desc("n"), "state", "city")
    of_zip = (
        parsed.where("zip <> '' and city <> '' and state <> ''").groupBy("zip", "state", "city").agg(F.count("*").alias("n"))
        .withColumn("r", F.row_number().over(w_zip)).where("r = 1").select("zip", F.col("city").alias("zip_city"), F.col("state").alias("zip_state"))
    )
    blank = parsed.where("zip = ''").withColumn("zip_city", F.lit(None).cast("string")).withColumn("zip_state", F.lit(None).cast("string"))  # never one hot key of a join
    named = parsed.where("zip <> ''").join(broadcast_if_small(of_zip), "zip", "left").unionByName(blank).withColumn("st", F.when(F.col("state") != "", F.col("state")).otherwise(F.col("zip_state")))
    named = named.withColumn("ct", F.when(F.col("city") != "", F.col("city")).otherwise(F.coalesce(F.when(F.col("zip_state") == F.col("st"), F.col("zip_city")), F.when(F.col("extra") != "", F.col("extra")))))
    named = cut_lineage(named)
    better = usual_spellings(named.where("st is not null and ct is not null"), ["st"], "ct", 3, 2)
    return named.join(better, ["st", "ct"], "left").withColumn("town", F.when(F.col("st").isNotNull() & F.col("ct").isNotNull(), F.concat_ws("/", "st", F.coalesce("usual", "ct")))).drop("usual")


def usual_spellings(df: DataFrame, group: list[str], word: str, times: int, most: int) -> DataFrame:
    """``group``, ``word``, ``usual``: for rare spellings the most frequent one of their group within ``most`` edits that is
    more than ``times`` as frequent. Distinct spellings meet by deletion keys."""
    spelled = df.groupBy(*group, word).agg(F.count("*").alias("n"))
    keys = F.pandas_udf(lambda s: s.map(lambda c: sorted(_city_keys(c))), "array<string>")
    by_key = spelled.withColumn("key", F.explode(keys(word)))
    near = F.pandas_udf(lambda a, b: pd.Series([distance(x, y, most) for x, y in zip(a, b)], dtype="int32"), "int")
    left, right = by_key.select(*group, "key", word, "n"), by_key.select(*group, "key", F.col(word).alias("other"), F.col("n").alias("n2"))
    return (
        left.join(right, [*group, "key"]).where(f"n2 > {times} * n").select(*group, word, "other", "n2").distinct()
        .withColumn("d", near(word, "other")).where(f"d <= {most}").groupBy(*group, word).agg(F.max(F.struct(F.col("n2"), -F.col("d"), F.col("other"))).alias("m"))
        .select(*group, word, F.col("m.other").alias("usual"))
    )


def _city_keys(city: str) -> set[str]:
    c = city.replace(" ", "")
    forms = {c.replace("?", x) for x in "?abcdefghijklmnopqrstuvwxyz"} if c.count("?") == 1 else {c}  # a lost letter is any letter
    return {c.replace("?", "")} | forms | {w[:i] + w[i + 1 :] for w in forms for i in range(len(w))}


_PARTS = ["town", "number", "direction", "street", "kind", "cut"]


def variants_of(clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, variants): the variant of each record that has a place, and the components of each variant."""
    read = clients.select(F.col("rec_no").cast("bigint").alias("rec_no"), "address", "city", "state", "zip").where("rec_no is not null and trim(address) <> ''").distinct()
    placed = towns(cut_lineage(read.mapInPandas(_parse, _PARSED))).where("town is not null")
    # a rare spelling of a street takes the usual one of all towns, one edit away and far more frequent
    words = usual_spellings(placed.where("length(street) >= 5 and street rlike '[a-z]'").select("street"), [], "street", 10, 1)
    placed = placed.join(words, "street", "left").withColumn("street", F.coalesce("usual", "street")).drop("usual")
    members = cut_lineage(placed.select("rec_no", *_PARTS, F.xxhash64(*_PARTS).alias("variant")))
    return members, cut_lineage(members.groupBy("variant").agg(*(F.first(c).alias(c) for c in _PARTS)))


def links(variants: DataFrame) -> DataFrame:
    """variant_a, variant_b of every two variants of one place."""
    keys = F.pandas_udf(lambda street, cut: pd.Series([index_keys(s, c) for s, c in zip(street, cut)], dtype=object), "array<string>")
    keyed = variants.withColumn("key", F.explode(keys("street", "cut")))
    block = F.xxhash64("town", "number", "key").alias("block")
    side = lambda df, x, *more: df.select(*more, *(F.col(c).alias(f"{c}_{x}") for c in ("variant", "direction", "street", "kind", "cut")))
    met = side(keyed.where("key <> '?'"), "a", block).join(side(keyed.where("key <> '?'"), "b", block), "block").where("variant_a < variant_b").drop("block")
    # several lost letters: the few streets that hold such a word ask every street of their block
    asked = side(keyed.where("key = '?'"), "a", "town", "number").join(side(variants, "b", "town", "number"), ["town", "number"]).where("variant_a <> variant_b").drop("town", "number")
    # what same_street can never accept isn't handed to it
    given = lambda c: (F.col(f"{c}_a") == "") | (F.col(f"{c}_b") == "") | (F.col(f"{c}_a") == F.col(f"{c}_b"))
    letters = lambda x: F.length(F.replace(f"street_{x}", F.lit(" "), F.lit("")))
    size = F.col("cut_a") | F.col("cut_b") | (F.abs(letters("a") - letters("b")) <= 2)
    candidates = met.where(given("direction") & given("kind") & size).distinct().unionByName(asked.where(given("direction") & given("kind") & size))

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [same_street((r.direction_a, r.street_a, r.kind_a, r.cut_a), (r.direction_b, r.street_b, r.kind_b, r.cut_b)) for r in pdf.itertuples(index=False)]
            yield pdf.loc[pd.Series(keep, index=pdf.index, dtype=bool), ["variant_a", "variant_b"]]

    agreed = candidates.mapInPandas(agree, "variant_a bigint, variant_b bigint")
    return agreed.select(F.least("variant_a", "variant_b").alias("variant_a"), F.greatest("variant_a", "variant_b").alias("variant_b")).distinct()


def place_classes(clients: DataFrame) -> DataFrame:
    """rec_no, variant, records (of the same variant), links (other variants of the same place): one row per record, whatever
    the number of equal ones."""
    members, variants = variants_of(clients)
    pairs = cut_lineage(links(variants))
    both = pairs.select(F.col("variant_a").alias("variant")).unionByName(pairs.select(F.col("variant_b").alias("variant"))).groupBy("variant").agg(F.count("*").alias("links"))
    sizes = members.groupBy("variant").agg(F.count("*").alias("records")).join(both, "variant", "left")
    return members.select("rec_no", "variant").join(sizes, "variant").select("rec_no", "variant", "records", F.coalesce("links", F.lit(0)).alias("links"))


def same_places(clients: DataFrame) -> DataFrame:
    """rec_no_a, rec_no_b of every two records at one location."""
    members, variants = variants_of(clients)
    one = members.select("rec_no", "variant")
    a, b = one.select(F.col("rec_no").alias("ra"), F.col("variant").alias("variant_a")), one.select(F.col("rec_no").alias("rb"), F.col("variant").alias("variant_b"))
    across = links(variants).join(a, "variant_a").join(b, "variant_b").select(F.least("ra", "rb").alias("rec_no_a"), F.greatest("ra", "rb").alias("rec_no_b"))
    within = a.join(b, F.col("variant_a") == F.col("variant_b")).where("ra < rb").select(F.col("ra").alias("rec_no_a"), F.col("rb").alias("rec_no_b"))
    return across.unionByName(within)


QUERIES = {"p3_found": lambda spark, d: same_places(table(spark, d, "client")), "p3_places": lambda spark, d: place_classes(table(spark, d, "client"))}
