import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import names as N


@pytest.mark.parametrize(
    ("text", "want"),
    [("Launtamand Hdwe., Corp.", ("", "launtamand", "hardware")), ("The Launtamand Hardware Corp", ("", "launtamand", "hardware")), ("Bookshop, Preinubell", ("", "preinubell", "bookshop")), ("Preinubell Book Shop Ltd.", ("", "preinubell", "bookshop")), ("Cintekell, R. Textiles", ("r", "cintekell", "textiles")),
     ("Rombubin + Heirasand", ("", "rombubin&heirasand", "")), ("RMBUBIN AND HEIRASAND INC.", ("", "rmbubin&heirasand", "")), ("Feibuvard & Dtrs., Inc.", ("", "feibuvard", "daughters")), ("Veilmibis, Inc.", ("", "veilmibis", "")), (None, None), ("  ", None)],
)
def test_firm(text, want):
    assert N.firm(text) == want


@pytest.mark.parametrize(
    ("last", "first", "want"),
    [("Zeirirorn", "Maggie", ("zeirirorn", "maggie", "")), ("Liz", "Tombeoxis", ("tombeoxis", "liz", "")), ("Tossiadow, Bill", None, ("tossiadow", "bill", "")), ("E Fulmohic", None, ("fulmohic", "e", "")), ("GOLTAKEY JR.", "HUGO", ("goltakey", "hugo", "")), ("Gagasey", "Dr Ingrid D.", ("gagasey", "ingrid", "d")), ("H.", "Wildekan", ("wildekan", "h", "")), (None, "X", None), ("", None, None)],
)
def test_person(last, first, want):
    assert N.person(last, first) == want


def test_attribution_prefers_the_frequent_full_form():
    forms = [("gauduxic", "robert", "h"), ("gauduxic", "bob", ""), ("gaudxuic", "r", ""), ("gauduxic", "anna", "")]
    home = N.attribute(forms, [5, 1, 1, 2])
    assert home[1] == home[2] == home[0] == 0 and home[3] == 3


ROWS = [
    (1, "Launtamand Hardware Corp.", "Gauduxic", "Robert", "11111", "5 Elm St"), (2, "The Launtamand Hdwe., Corp.", "GAUDUXIC", "Bob", "11111", "5 Elm St"), (3, "LAUNTAMNAD HARDWARE", "R.", "Gauduxic", "11111", "5 Elm Street"), (4, "Hardware, Launtamand", "Gauduxic, Robert", None, "22222", "9 Oak St"),
    (5, "Launtamand Bakery", "Gauduxic", "Robert", "33333", "7 Fir St"), (6, "Launtamand Bakery Inc", None, None, "33333", "7 Fir St"), (7, "Launtamand", "Weber", "Anna", "33333", "7 Fir St"), (8, None, "Gauduxic", "Robert", "11111", "5 Elm St"), (9, "  ", None, None, None, None),
    (10, "Rombubin & Heirasand", "Weber", None, "44444", None), (11, "Rombubin / Heirasand Inc.", "Weber", None, "44444", None),
]


def test_pairs(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "rec_no bigint, client string, lastname string, firstname string, zip string, address string, org string")
    got = [tuple(r) for r in N.same_names(df).collect()]
    assert len(got) == len(set(got))
    orgs = {(a, b) for k, a, b in got if k == "org"}
    assert orgs == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6), (5, 7), (6, 7), (10, 11)}
    persons = {(a, b) for k, a, b in got if k == "person"}
    # record 8 names no firm, but stands at the place of 1 to 3
    assert persons == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11), (1, 8), (2, 8), (3, 8), (4, 8)}
    assert N.same_names(df.limit(0)).count() == 0


def test_very_long_and_repeated_rows(spark):
    name = "q" * 20000 + " Bakery"
    rows = [(1, name, "w" * 20000, "Anna", "1", "1 x"), (2, name.upper(), "W" * 20000, "A.", "1", "1 x"), (2, name.upper(), "W" * 20000, "A.", "1", "1 x")]
    df = spark.createDataFrame(rows, "rec_no bigint, client string, lastname string, firstname string, zip string, address string")
    assert sorted(map(tuple, N.same_names(df).collect())) == [("org", 1, 2), ("person", 1, 2)]


def test_spellings_two_edits_apart_meet(spark):
    """All mistyped, no spelling one edit from two others; lost letters too."""
    words = [("crinuabey", "crinaubye"), ("launtamand", "lauxtamnad"), ("gaud?xic", "gaudxuci"), ("gauduxic", "g?udu?ci"), ("abcdef", "bcde"), ("preinubell", "wholly")]
    df = spark.createDataFrame([(a, b) for a, b in words], "a string, b string")
    got = {(r.a, r.b): r.d for r in N.alike(df.select("a"), df.select("b"), [], "a", "b").collect()}
    assert set(words[:5]) <= set(got) and got == {p: N.distance(*p, 2) for p in got}
    rows = [(1, "The Crrinuabey & Sons", "Weber", "Anna", "11111", "5 Elm St"), (2, "Crinuabye & Sons", "Weber", "Anna", "11111", "5 Elm St")]
    df = spark.createDataFrame(rows, "rec_no bigint, client string, lastname string, firstname string, zip string, address string")
    assert sorted(map(tuple, N.same_names(df).collect())) == [("org", 1, 2), ("person", 1, 2)]
    # without a place in common two slips apart from each other are another family
    rows = [(i, "Jauneher Supply", None, None, f"{20000 + i}", "1 Elm St") for i in range(8)] + [(9, "Gaunemer Supply", None, None, "30000", "1 Elm St")]
    df = spark.createDataFrame(rows, "rec_no bigint, client string, lastname string, firstname string, zip string, address string")
    assert not [r for r in N.same_names(df).collect() if r.rec_no_b == 9]


COLUMNS = "rec_no bigint, client string, lastname string, firstname string, zip string, address string"


def _shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_moved_stay_near_the_records(spark):
    """Keys for every spelling less two letters moved 128 rows a record."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("bdgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(5))
    names = [(word().title(), word().title()) for _ in range(500)]
    rows = [(2 * i + j, f"{org} Bakery", last, "Anna", f"{10000 + i}", f"{i} Elm St") for i, (org, last) in enumerate(names) for j in range(2)]
    before = _shuffled(spark)
    assert N.same_names(spark.createDataFrame(rows, COLUMNS)).count() >= 1000
    assert _shuffled(spark) - before < 75 * len(rows)


def test_large_blocks_give_what_small_ones_do(spark, monkeypatch):
    words = ["crinuabey", "crinaubye", "crinuabeyy", "cr?nuabey", "c?inu?bey", "launtamand", "lauxtamnad", "abcdef", "bcde", "abcd", "abdc", "q" * 30, "q" * 29 + "wq", "q" * 60]
    df = spark.createDataFrame([(z, w) for z in ("1", "2") for w in words[: 99 if z == "1" else 6]], "z string, a string")
    right = df.withColumnRenamed("a", "b")
    want = {(z, v, w) for z, v in map(tuple, df.collect()) for y, w in map(tuple, df.collect()) if y == z and N.distance(v, w, 2) <= (1 if len(w) <= 5 else 2)}
    for compared in (100, 4, 0):  # none, one and both of the blocks are large
        monkeypatch.setattr(N, "COMPARED", compared)
        got = N.alike(df, right, ["z"], "a", "b").where(F.col("d") <= N.far("b"))
        assert {(r.z, r.a, r.b) for r in got.collect()} == want


def test_slips_of_any_word_meet(spark):
    words = ["gauduxic", "gaduxic", "gaudxuic", "gaudusic", "g?uduxic", "g?ud?xic", "w" * 17, "w" * 18, "w" * 19 + "v", "w" * 21, "w" * 40, "w" * 41, "a", "ab"]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r.a, r.b) for r in N.met_by_slip(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert {(v, w) for v in words for w in words if N.distance(v, w, 2) <= 1 or N.distance(v, w, 2) == 2 and N.one_slip(v, w)} <= got


def test_large_blocks_of_one_table(spark, monkeypatch):
    df = spark.createDataFrame([r for r in ROWS if r[1]], COLUMNS)
    want = sorted(map(tuple, N.same_names(df).collect()))
    monkeypatch.setattr(N, "COMPARED", 0)
    assert sorted(map(tuple, N.same_names(df).collect())) == want
