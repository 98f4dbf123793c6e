import datetime as dt
import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import units as U


@pytest.mark.parametrize(
    ("text", "want"),
    [("24 - 330 ml bottles", ("ml", 7920)), ("16x227G", ("g", 3632)), ("0,355 l x 24", ("ml", 8520)), ("3 doz. x 0.125 gal", ("ml", 36 * 473.176473)), ("12 bags of 20", ("pc", 240)), ("50 doz.", ("pc", 600)), ("2 gross", ("pc", 288)), ("½ kg tin", ("g", 500)),
     ("1/2 lbs pouch", ("g", 226.796185)), ("12/2 lb", ("g", 24 * 453.59237)), ("25.4 oz carton", ("ml", 25.4 * 29.5735295625)), ("10/3.53 oz.", ("g", 35.3 * 28.349523125)), ("seven x 100 g", ("g", 700)), ("3 gallons", ("ml", 3 * 3785.411784)), ("2 pints", ("ml", 946.352946)), ("5 pounds", ("g", 5 * 453.59237)), ("16 ounces", ("g", 453.59237)), ("1 quart", ("ml", 946.352946)),
     ("eleven dozen", ("pc", 132)), ("forty-two pieces", ("pc", 42)), ("6 x 12 ounce bottles", ("ml", 72 * 29.5735295625)), ("16 fluid ounces", ("ml", 16 * 29.5735295625)), ("12 - 340 gram", None), ("TWELVE 6 OZ", ("g", 72 * 28.349523125)), ("two dozen 1 lbs", ("g", 24 * 453.59237)), ("8 boxes x 6 bags", ("pc", 48)),
     ("24 - 330 ml bottl", None), ("10 - 0.25 LBS JA", None), ("24 - 330 ml bottle", None), ("12 bags x", None), ("1 kg bags in", None), ("", None), (None, None), ("x" * 9999, None), ("0 g", None)],
)
def test_contents(text, want):
    base, amount = U.contents(text)
    assert (base, amount) == (None, None) if want is None else (base == want[0] and amount == pytest.approx(want[1]))


def test_segment_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        costs = rng.random((6, 3)) * 4
        best = min(sum(costs[i, s] for i, s in enumerate(p)) + 1.5 * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=6))
        got = U.segment(costs, 1.5)
        assert sum(costs[i, s] for i, s in enumerate(got)) + 1.5 * sum(a != b for a, b in zip(got, got[1:])) == pytest.approx(best)


SCHEMA = "rec_no bigint, productid int, quantitype string, unitprice decimal(19,4), source_sys string, updated_at timestamp, key string, amount string"


def history(seed=1, products=60):
    """Rows of four sources; one keeps cents until a day, one prices per kilogram, one per dozen packs."""
    r = random.Random(seed)
    rows, n = [], 0
    for p in range(products):
        grams, dollars = r.choice([250, 500, 2000, 6000]), r.randint(500, 9000) / 100
        for s in ("main", "main", "cents", "metric", "dozens"):
            n += 1
            day = r.randrange(400)
            price = {"main": dollars, "cents": dollars * (100 if day < 200 else 1), "metric": dollars / (grams / 1000), "dozens": dollars * 12}[s]
            text = r.choice([f"{grams} g", f"{grams / 1000:g} kg", f"2 x {grams // 2} g bags"])
            rows.append((n, p, text, Decimal(f"{price:.4f}"), s, dt.datetime(2020, 1, 1) + dt.timedelta(days=day), "clash", "clash"))
    return rows


def test_scales_and_matches_against_brute_force(spark):
    rows = history() + [(9001, None, "1 g", Decimal(1), "main", None, "", ""), (9002, 1, None, None, None, None, "", ""), (9003, 1, "500 g", Decimal(0), "main", None, "", "")]
    u = U.common_units(spark.createDataFrame(rows, SCHEMA), "rec_no", "productid", "quantitype", "unitprice", "source_sys", "updated_at").cache()
    got = {r["key"]: r for r in u.collect()}
    for n, _, _, _, s, at, *_ in rows[:-3]:
        want = {"main": "pack", "metric": "kg, litre or piece", "dozens": "dozen packs"}.get(s) or ("cents" if at < dt.datetime(2020, 7, 19) else "pack")
        assert got[n]["scale"] == want
    brute = set()
    good = [r for r in got.values() if r["product"] is not None and r["amount"]]
    for a, b in itertools.combinations(sorted(good, key=lambda r: r["key"]), 2):
        if a["product"] != b["product"]:
            continue
        if a["base"] == b["base"] and a["digits"] != b["digits"] and max(a["amount"], b["amount"]) / min(a["amount"], b["amount"]) <= 1.005:
            brute.add(("pack", a["key"], b["key"]))
        if a["pack_price"] and b["pack_price"] and max(a["pack_price"], b["pack_price"]) / min(a["pack_price"], b["pack_price"]) <= 1.005 < max(a["price"], b["price"]) / min(a["price"], b["price"]):
            brute.add(("price", a["key"], b["key"]))
    found = [tuple(r) for r in U.unit_matches(u).collect()]
    assert set(found) == brute and len(found) == len(brute) and len(brute) > 50


def test_empty(spark):
    u = U.common_units(spark.createDataFrame([], SCHEMA), "rec_no", "productid", "quantitype", "unitprice", "source_sys", "updated_at")
    assert U.unit_matches(u).count() == 0 and u.agg(F.count("*")).first()[0] == 0


def test_repeated_rows_count_once(spark):
    rows = history()
    df = spark.createDataFrame(rows, SCHEMA)
    args = ("rec_no", "productid", "quantitype", "unitprice", "source_sys", "updated_at")
    once, twice = (U.unit_matches(U.common_units(x, *args)) for x in (df, df.union(df)))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_the_largest_source_may_keep_another_scale(spark):
    """The source with most rows prices by the dozen; most rows of all are dollars per pack, so another source is the reference."""
    rows, n = [], 0
    for p in range(40):
        dollars = 5 + p * 1.37
        for s, copies, factor in (("bulk", 3, 12), ("north", 2, 1), ("south", 2, 1), ("west", 2, 1)):
            for _ in range(copies):
                n += 1
                rows.append((n, 1000 + p, "500 g", Decimal(f"{dollars * factor:.4f}"), s, dt.datetime(2020, 1, 1) + dt.timedelta(days=n % 90), "", ""))
    u = U.common_units(spark.createDataFrame(rows, SCHEMA), "rec_no", "productid", "quantitype", "unitprice", "source_sys", "updated_at")
    scales = {(r["key"] > 0, r["scale"]) for r in u.where("abs(price - pack_price) < 0.001").select("key", "scale").collect()}
    assert scales == {(True, "pack")} and u.where("scale = 'dozen packs'").count() == 120 and u.where("text_state <> 'parsed'").count() == 0
