"""Quantities recorded in different units: pack contents from text, price scales from source histories.

Pack texts are parsed to one amount in grams, millilitres or pieces. Prices are put on one scale (dollars for one whole
pack) by an exact penalised changepoint search over each source's history: for every day of a source the cost of each
known scale is summed on log values, and the segmentation that minimises cost plus a penalty per level shift is found by
dynamic programming over the days. Level shifts thus always match a known factor, which is then reversed.

Defined cases: a null, blank or incompletely parsed pack text (a cut one ends in a word fragment) gives null contents;
a null or non-positive price takes no part in the search and gets a null pack price; an empty table gives an empty result.
Only the named input columns are read, so extra columns never clash. Rows loaded twice under keys of their own count as
rows; a row repeated with its key counts once.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import broadcast_if_small, cut_lineage

# Unit of text -> (base, factor to grams, millilitres or pieces).
UNITS = {
    "kg": ("g", 1000.0), "kgs": ("g", 1000.0), "g": ("g", 1.0), "gr": ("g", 1.0), "grams": ("g", 1.0),
    "gram": ("g", 1.0), "gramme": ("g", 1.0), "grammes": ("g", 1.0), "kilo": ("g", 1000.0), "kilos": ("g", 1000.0), "kilogram": ("g", 1000.0), "kilograms": ("g", 1000.0),
    "milligram": ("g", 0.001), "milligrams": ("g", 0.001), "ounce": ("g", 28.349523125), "ounces": ("g", 28.349523125), "pound": ("g", 453.59237), "pounds": ("g", 453.59237),
    "mg": ("g", 0.001), "oz": ("g", 28.349523125), "lb": ("g", 453.59237), "lbs": ("g", 453.59237),
    "ml": ("ml", 1.0), "cl": ("ml", 10.0), "dl": ("ml", 100.0), "l": ("ml", 1000.0), "litre": ("ml", 1000.0),
    "litres": ("ml", 1000.0), "liter": ("ml", 1000.0), "liters": ("ml", 1000.0), "fl oz": ("ml", 29.5735295625),
    "pt": ("ml", 16 * 29.5735295625), "qt": ("ml", 32 * 29.5735295625), "gal": ("ml", 128 * 29.5735295625),
    "millilitre": ("ml", 1.0), "millilitres": ("ml", 1.0), "milliliter": ("ml", 1.0), "milliliters": ("ml", 1.0), "centilitre": ("ml", 10.0), "centilitres": ("ml", 10.0),
    "centiliter": ("ml", 10.0), "centiliters": ("ml", 10.0), "decilitre": ("ml", 100.0), "decilitres": ("ml", 100.0), "deciliter": ("ml", 100.0), "deciliters": ("ml", 100.0),
    "pint": ("ml", 16 * 29.5735295625), "pints": ("ml", 16 * 29.5735295625), "quart": ("ml", 32 * 29.5735295625), "quarts": ("ml", 32 * 29.5735295625),
    "gallon": ("ml", 128 * 29.5735295625), "gallons": ("ml", 128 * 29.5735295625), "pts": ("ml", 16 * 29.5735295625), "qts": ("ml", 32 * 29.5735295625), "gals": ("ml", 128 * 29.5735295625),
    "piece": ("pc", 1.0), "ea": ("pc", 1.0), "unit": ("pc", 1.0), "units": ("pc", 1.0), "count": ("pc", 1.0), "pair": ("pc", 2.0), "pairs": ("pc", 2.0),
    "pc": ("pc", 1.0), "pcs": ("pc", 1.0), "pieces": ("pc", 1.0), "each": ("pc", 1.0), "ct": ("pc", 1.0),
    "doz": ("pc", 12.0), "dozen": ("pc", 12.0), "dz": ("pc", 12.0), "gro": ("pc", 144.0), "gross": ("pc", 144.0),
}
# Names of packings, and those that make ounces fluid.
PACKINGS = "bag bags bottle bottles box boxes can cans carton cartons case cases crock crocks drum drums flask flasks jar jars jug jugs keg kegs pkg pkgs pouch pouches sachet sachets sack sacks tin tins tray trays tub tubs vial vials wheel wheels pack packs".split()
FLUID = ("bottle", "bottles", "can", "cans", "carton", "cartons")
SINGULAR = {w for w in PACKINGS if f"{w}s" in PACKINGS or f"{w}es" in PACKINGS}
#: Written-out units in the singular: behind a number other than one such a word ends a text that was cut.
ONE_UNIT = {w for w in UNITS if f"{w}s" in UNITS and len(w) > 3 and w not in ("litre", "liter")}
# Number words; those up to ninety-nine are put together from them.
_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: i for i, w in enumerate(_ONES, 1)} | {w: 10 * i for i, w in enumerate(_TENS, 2)} | {"hundred": 100}
NUMBER_WORDS |= {f"{t}{sep}{o}": 10 * i + k for i, t in enumerate(_TENS, 2) for k, o in enumerate(_ONES[:9], 1) for sep in ("-", " ")}
# Fractions in one character or three.
FRACTIONS = {"½": "0.5", "¼": "0.25", "¾": "0.75", "1/2": "0.5", "1/4": "0.25", "3/4": "0.75"}

NUM = r"(\d+(?:\.\d+)?|\.\d+)"
COUNT_UNITS = {"doz": 12.0, "dozen": 12.0, "dz": 12.0, "gro": 144.0, "gross": 144.0}


def _alternatives(words) -> str:
    return "|".join(sorted((w.replace(" ", r"\.? ?") for w in words), key=len, reverse=True))


_UNIT = f"({_alternatives(UNITS)})\\.?"
_PACK = f"({_alternatives(PACKINGS)})\\.?"
_COUNT = f"({_alternatives(COUNT_UNITS)})\\.?"
_SEP = r" ?(?:x|-|/|of|×) ?"


_NUMBER_WORD = re.compile(rf"({_alternatives(NUMBER_WORDS)})(?![a-z])")


def normalised(text: str) -> str:
    """Lower case, single spaces, decimal points, number words and fractions as digits."""
    q = re.sub(r"(\d),(\d)", r"\1.\2", " ".join(text.lower().split()))
    q = re.sub(r"(\d)½", r"\1.5", q)
    for sign in "½¼¾":
        q = q.replace(sign, FRACTIONS[sign])
    q = re.sub(r"(?<![\d/.])(1/2|1/4|3/4)(?= ?[a-z])", lambda m: FRACTIONS[m[1]], q)
    q = re.sub(r"\bfluid (?=ounces?\b|oz\b)", "fl ", q)
    q = re.sub(r"\bfl\.? ounces?\b", "fl oz", q)
    q = re.sub(r"^([a-z]+|\d+) ?(dozen|doz\.?|dz\.?|gross|gro\.?) (?=\d)", r"\1 \2 x ", q)
    if m := _NUMBER_WORD.match(q):  # a number alone before digits counts packs; before a unit or packing it is the size
        between = re.match(r" (?=\d)| ?x ?| - ?|/", q[m.end() :])
        q = f"{NUMBER_WORDS[m[1]]} x {q[m.end() + between.end() :]}" if between else f"{NUMBER_WORDS[m[1]]}{q[m.end() :]}"
    return q


FIRST = re.compile(rf"{NUM} ?(?:{_COUNT}|{_PACK})?{_SEP}{NUM} ?(?:{_UNIT}|{_PACK})?(?: ?{_PACK})?")
SECOND = re.compile(rf"{NUM} ?{_UNIT}{_SEP}{NUM} ?(?:{_COUNT})?(?: ?{_PACK})?")
SINGLE = re.compile(rf"{NUM} ?(?:{_UNIT}|{_PACK})(?: ?{_PACK})?")


def contents(text: str | None) -> tuple[str | None, float | None]:
    """(base, amount) of a pack text, nulls where it isn't one whole statement.

    Forms: ``count [packing] sep size unit [packing]``, ``size unit sep count [packing]``, ``size unit [packing]``, the
    count also in dozens or grosses; a count of packings alone counts pieces.
    """
    q = normalised(text or "")
    if m := SECOND.fullmatch(q):
        size, unit, count, many, packs = m[1], m[2], m[3], m[4], [m[5]]
    elif m := FIRST.fullmatch(q):
        count, many, size, unit, packs = m[1], m[2], m[4], m[5], [m[3], m[6], m[7]]
        last = m[7] or m[6]
        if float(count) > 1 and last in SINGULAR or not (unit or last or re.search(r"\bof\b", q)):
            return None, None  # "24 - 330 ml bottle", "24 bags x 2": more was entered
    elif m := SINGLE.fullmatch(q):
        count, many, size, unit, packs = "1", None, m[1], m[2], [m[3], m[4]]
    else:
        return None, None
    unit = re.sub(r"^fl\.? ?oz", "fl oz", unit or "")
    if unit in ONE_UNIT and float(size) != 1 and not any(packs):
        return None, None
    base, factor = UNITS["fl oz"] if unit in ("oz", "ounce", "ounces") and any(p in FLUID for p in packs) else UNITS[unit] if unit else ("pc", 1.0)
    amount = float(count) * COUNT_UNITS.get(many or "", 1.0) * float(size) * factor
    return (base, amount) if 0 < amount < math.inf else (None, None)


def contents_batch(text: pd.Series) -> pd.DataFrame:
    """:func:`contents`, each distinct text of a batch parsed once."""
    codes, values = pd.factorize(text)
    parsed = [*map(contents, values), (None, None)]
    return pd.DataFrame([parsed[c] for c in codes], columns=["base", "amount"])


#: Known price scales: what one dollar for a whole pack is stored as.
SCALES = ("pack", "cents", "dozen packs", "kg, litre or piece", "thousandth", "gross packs")


def _log_factors(base: Column, amount: Column) -> dict[str, Column]:
    per = F.when(base == "pc", amount).otherwise(amount / 1000.0)
    return {
        "pack": F.lit(0.0),
        "cents": F.lit(math.log(100.0)),
        "dozen packs": F.lit(math.log(12.0)),
        "kg, litre or piece": -F.log(per),
        "thousandth": F.lit(-math.log(1000.0)),
        "gross packs": F.lit(math.log(144.0)),
    }


def segment(costs: np.ndarray, penalty: float) -> np.ndarray:
    """The level of each step that minimises summed cost plus ``penalty`` per change of level; exact, O(steps x levels)."""
    n, k = costs.shape
    best, back = costs[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        low = int(np.argmin(best))
        stay = best <= best[low] + penalty
        back[i] = np.where(stay, np.arange(k), low)
        best = np.where(stay, best, best[low] + penalty) + costs[i]
    out = np.empty(n, dtype=np.int64)
    out[-1] = int(np.argmin(best))
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def price_scales(rows: DataFrame, reference: DataFrame, penalty: float = 3.0, cap: float = 0.35) -> DataFrame:
    """(source, day, scale) by changepoint search. ``rows``: product, source, day, base, amount, lp; ``reference``: product, ref.

    Costs are summed per source and day before they leave the executors, so a history's size is its number of days,
    whatever the number of its rows.
    """
    factors = _log_factors(F.col("base"), F.col("amount"))
    joined = rows.join(reference, "product")
    costs = joined.groupBy("source", "day").agg(
        *(F.sum(F.least(F.abs(F.col("lp") - F.col("ref") - f), F.lit(cap))).alias(f"h{i}") for i, f in enumerate(factors.values()))
    )
    names = list(factors)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        level = segment(pdf[[f"h{i}" for i in range(len(names))]].to_numpy(dtype=float), penalty)
        return pd.DataFrame({"source": pdf["source"].to_numpy(), "day": pdf["day"].to_numpy(), "scale": np.array(names, dtype=object)[level]})

    return costs.groupBy("source").applyInPandas(best, "source string, day int, scale string")


def common_units(df: DataFrame, key: str, product: str, pack_text: str, price: str, source: str, changed: str, penalty: float = 3.0) -> DataFrame:
    """key, product, digits, text_state (blank, unparsed, parsed), base, amount, price (double), pack_price (dollars for one
    whole pack), scale.

    The reference level of a product is first the median log price of one source, then, in a second search over all sources,
    the median over all rows put on their scale. The source is the one with most rows under which at least half of all rows
    come out in dollars per pack, as most records are kept; failing that, the one under which most do.
    """
    rows = df.select(
        F.col(key).alias("key"), F.col(product).alias("product"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.unix_date(F.to_date(F.col(changed))), F.lit(-1)).cast("int").alias("day"),
        F.col(price).cast("double").alias("price"), F.regexp_replace(F.col(pack_text), "[^0-9]", "").alias("digits"), F.col(pack_text).alias("__text"),
    ).distinct()
    rows = rows.withColumn("c", F.pandas_udf(contents_batch, "base string, amount double")("__text")).select("*", "c.base", "c.amount")
    state = F.when(F.coalesce(F.trim("__text"), F.lit("")) == "", "blank").when(F.col("amount").isNull(), "unparsed").otherwise("parsed")
    rows = rows.withColumn("text_state", state).drop("c", "__text")
    rows = cut_lineage(rows)
    priced = rows.where("price > 0 and amount > 0 and product is not null").withColumn("lp", F.log("price"))
    days = cut_lineage(priced.groupBy("source", "day").agg(F.count("*").alias("rows")))
    scales, best = None, -1.0
    sources = [r["source"] for r in days.groupBy("source").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), "source").select("source").collect()]  # a row per source
    for name in sources:
        first = priced.where(F.col("source") == name).groupBy("product").agg(F.percentile_approx("lp", 0.5, 1000).alias("ref"))
        tried = cut_lineage(price_scales(priced, first, penalty))
        whole = days.join(broadcast_if_small(tried), ["source", "day"], "left").agg(F.sum(F.when(F.col("scale") == "pack", F.col("rows")).otherwise(0)) / F.sum("rows")).first()[0] or 0.0
        if whole > best:
            scales, best = tried, whole
        if whole >= 0.5:
            break
    if scales is None:
        scales = price_scales(priced, priced.select("product", F.col("lp").alias("ref")), penalty)  # no prices at all

    def on_scale(scale_rows: DataFrame) -> DataFrame:
        f = _log_factors(F.col("base"), F.col("amount"))
        factor = F.lit(0.0)
        for name, c in f.items():
            factor = F.when(F.col("scale") == name, c).otherwise(factor)
        return scale_rows.withColumn("lpp", F.col("lp") - factor)

    # a day of a source without any row in the reference keeps the scale of the day before it
    second = on_scale(_with_scale(priced, scales)).groupBy("product").agg(F.percentile_approx("lpp", 0.5, 1000).alias("ref"))
    scales = cut_lineage(price_scales(priced, second, penalty))
    known = (F.col("price") > 0) & (F.col("amount") > 0) & F.col("product").isNotNull()
    final = on_scale(_with_scale(rows.withColumn("lp", F.when(known, F.log("price"))), scales))
    return final.withColumn("pack_price", F.exp("lpp")).withColumn("scale", F.when(F.col("lp").isNotNull(), F.col("scale"))).drop("lp", "lpp")


def _with_scale(priced: DataFrame, scales: DataFrame) -> DataFrame:
    """Each row with its segment's scale; scales are first turned into segments [from, to) of days, a few per source."""
    w = Window.partitionBy("source").orderBy("day")
    starts = (
        scales.withColumn("before", F.lag("scale").over(w)).where("before is null or before <> scale")
        .withColumn("to", F.coalesce(F.lead("day").over(w), F.lit(2**31 - 1)))
        .withColumn("from", F.when(F.col("before").isNull(), F.lit(-(2**31))).otherwise(F.col("day")))
    )
    per_source = starts.groupBy("source").agg(F.collect_list(F.struct("from", "to", "scale")).alias("segments"))
    hit = F.filter("segments", lambda s: (F.col("day") >= s["from"]) & (F.col("day") < s["to"]))
    return priced.join(broadcast_if_small(per_source), "source", "left").withColumn("scale", F.coalesce(hit[0]["scale"], F.lit("pack"))).drop("segments")


def close_pairs(rows: DataFrame, value: str, tolerance: float = 0.005) -> DataFrame:
    """Pairs of one product whose positive ``value`` agree within ``tolerance``, the smaller key first.

    A range join on bins of the log value: only rows in the same or a neighbouring bin meet, never a product's whole group.
    """
    width = math.log1p(tolerance) * 1.01
    bins = rows.withColumn("lv", F.log(value)).withColumn("bin", F.floor(F.col("lv") / width))
    left = bins.select(*(F.col(c).alias(f"{c}_a") for c in bins.columns))
    right = bins.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).select(*(F.col(c).alias(f"{c}_b") for c in bins.columns))
    return left.join(right, (F.col("product_a") == F.col("product_b")) & (F.col("bin_a") == F.col("bin_b"))).where(
        (F.col("key_a") < F.col("key_b")) & (F.abs(F.col("lv_a") - F.col("lv_b")) <= math.log1p(tolerance) + 1e-12)
    )


def unit_matches(units: DataFrame) -> DataFrame:
    """kind, rec_no_a, rec_no_b of the result of :func:`common_units`."""
    whole = units.where("amount > 0 and product is not null").select("key", "product", "digits", "base", "amount", "price", "pack_price")
    packs = close_pairs(whole, "amount").where("base_a = base_b and digits_a <> digits_b")
    prices = close_pairs(whole.where("pack_price > 0"), "pack_price").where(F.abs(F.log("price_a") - F.log("price_b")) > math.log1p(0.005))
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("key_a").alias("rec_no_a"), F.col("key_b").alias("rec_no_b"))
    return pick(packs, "pack").unionByName(pick(prices, "price"))
