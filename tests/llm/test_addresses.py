import random
from itertools import permutations

import pytest

from millrace.llm import addresses as A


@pytest.mark.parametrize(
    ("text", "want"),
    [("North Harborview Ave., 7829", ("7829", "n", "harborview", "av")), ("No. 1921 Cedarfield Road", ("1921", "", "cedarfield", "rd")), ("E. Cedarbrook Pky No. 6506", ("6506", "e", "cedarbrook", "pk")), ("Apt. 248C, 2078 Saffrongate Ln", ("2078", "", "saffrongate", "ln")),
     ("41ST LN, 1141", ("1141", "", "41", "ln")), ("4991 S 51 Drive", ("4991", "s", "51", "dr")), ("147 Fourteenth Road, Warehouse", ("147", "", "14", "rd")), ("277 17th Road Cour", ("277", "", "17", "rd")), ("P.O.Box 979", ("979", "", "box", "")), ("Box 268", ("268", "", "box", "")),
     ("296 NiÃ±era Av., c/o Annex", ("296", "", "ninera", "av")), ("84 Nettlestone Place South", ("84", "s", "nettlestone", "pl")), ("Jardín Azul Sq 6038", ("6038", "", "jardin azul", "sq")), ("#10, 8406 Dovermere Dr", ("8406", "", "dovermere", "dr")), ("Unit 135, No. 8593 52nd Road S", ("8593", "s", "52", "rd"))],
)
def test_components(text, want):
    assert A.components(text)[:4] == want


@pytest.mark.parametrize("text", [None, "", "  ", "Main Street", "12345", "x" * 5000, "1 " * 3000])
def test_without_a_place(text):
    A.components(text)
    assert A.components(text) is None or text


def test_distance_and_assignment():
    assert A.distance("cedar", "cedra") == 1 and A.distance("ni?era", "ninera") == 0 and A.distance("abc", "xyz", 2) == 3
    assert A.assignment(["old", "mill"], ["mill", "old"], 2) == 0
    assert A.assignment("a big old oak grove".split(), "oak a big old grove".split(), 2) == 0 and A.assignment(["glass", "works"], ["glassworks"], 2) == 0
    assert A.assignment(["old", "mill"], ["mill"], 2) == 3


def test_cheapest_against_all_orders():
    r = random.Random(4)
    for n in (1, 2, 3, 4, 5):
        for _ in range(30):
            cost = [[r.randint(0, 3) for _ in range(n)] for _ in range(n)]
            assert A.cheapest(cost) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))


def test_streets_that_agree_share_a_key():
    """Words in another order, two typos anywhere, lost letters, cut ends: whatever same_street accepts is a candidate."""
    r = random.Random(9)
    words = ["kestrelwood", "old", "main", "harbor", "view", "elm", "saffrongate", "mill", "stream", "oaks", "quarry", "cedars"]

    def typo(s):
        i = r.randrange(len(s))
        return r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abcxyz") + s[i:], s[:i] + r.choice("aeiou") + s[i + 1 :], s[:i] + s[i : i + 2][::-1] + s[i + 2 :], s[:i] + "?" + s[i + 1 :]]) or s

    agreed = 0
    for _ in range(6000):
        w = r.sample(words, r.randint(1, 3))
        a = " ".join(w)
        r.shuffle(w)
        b, cut = " ".join(w), False
        for _ in range(r.randint(0, 2)):
            b = typo(b).strip() or b
        if r.random() < 0.2 and len(b) > 5:
            b, cut = b[: r.randint(4, len(b))].strip(), True
        if A.same_street(("", a, "", False), ("", b, "", cut)):
            agreed += 1
            ka, kb = A.index_keys(a, False), A.index_keys(b, cut)
            assert "?" in kb or set(ka) & set(kb), (a, b, cut)
    assert agreed > 2500


def test_pairs(spark):
    filler = [(1000 + i, f"{100 + i} Cedarfield Road", "Ruldumont", "FL", "33832") for i in range(12)]
    rows = filler + [
        (1, "77 Harborview Ave. N", "Ruldumont", "FL", "33832"), (2, "North Harborview Avenue, 77", "Rulddumont", "FL", "33832-1111"), (3, "Apt 5, 77 Harbrview", None, "FL", "33832"), (4, "77 Harborview Ave S", "Ruldumont", "FL", "33832"),
        (5, "77 Harborview Street", "Ruldumont", "FL", "33832"), (6, "77 Harborview Ave N", "Ruldumont", "UT", "90000"), (7, "78 Harborview Ave N", "Ruldumont", "FL", "33832"), (8, "PO Box 77", "Ruldumont", "FL", "33832"), (9, "Box 77", "RULDUMONT", None, "33832"), (10, None, "Ruldumont", "FL", "33832"), (11, " ", "Ruldumont", "FL", "33832"), (12, "77 Harbor", "Ruldumont", "FL", "33832"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "rec_no bigint, address string, city string, state string, zip string, town string, key string")
    got = [tuple(r) for r in A.same_places(df).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert {(1, 2), (1, 3), (2, 3), (8, 9)} <= set(got)
    assert not {(1, 4), (1, 5), (1, 6), (1, 7), (2, 4), (1, 8)} & set(got)
    assert (1, 12) in got and not any(10 in p or 11 in p for p in got)
    twice = A.same_places(df.where("rec_no = 1").union(df.where("rec_no = 1").selectExpr("rec_no + 500", "address", "city", "state", "zip", "town", "key")).union(df.where("rec_no >= 1000")))
    assert (1, 501) in [tuple(r) for r in twice.collect()]
    assert A.same_places(df.limit(0)).count() == 0
    classes = {r["rec_no"]: r for r in A.place_classes(df).collect()}
    linked = {r for p in got for r in p}
    assert all((classes[r]["records"] > 1 or classes[r]["links"] > 0) == (r in linked) for r in classes)


def test_very_long_and_repeated_rows(spark):
    rows = [(1, "5 " + "q" * 20000 + " Street", "Ruldumont", "FL", "33832"), (2, "5 " + "q" * 20000 + " St.", "Ruldumont", "FL", "33832"), (2, "5 " + "q" * 20000 + " St.", "Ruldumont", "FL", "33832")]
    df = spark.createDataFrame(rows, "rec_no bigint, address string, city string, state string, zip string")
    assert [tuple(r) for r in A.same_places(df).collect()] == [(1, 2)]


def test_every_pair_that_agrees_is_compared(spark):
    """A lost letter and a typo, two typos apart from each other, words in another order, a cut street mistyped at its start."""
    texts = ["1832 Ni\ufffdeta Dr", "1832 NIÑERA DR", "38 W Montréval Ave", "38 West Motr\ufffdval Avenue", "77 Harborview Ave", "77 Hxrborvixw Ave", "9 Mill Stream Road", "9 Stream Mill Road", "5 Saffrongate Lane", "5 Zaffrong"]
    df = spark.createDataFrame([(i, t, "Ruldumont", "FL", "33832") for i, t in enumerate(texts)], "rec_no bigint, address string, city string, state string, zip string")
    assert sorted(map(tuple, A.same_places(df).collect())) == [(i, i + 1) for i in range(0, len(texts), 2)]
