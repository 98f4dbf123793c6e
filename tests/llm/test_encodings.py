import random

import numpy as np

from millrace.llm import encodings as E

WORDS = "Lámpara Canapé Estantería Bücherregal Größe Schlüssel Pförtner Sillón Corazón maçã Crédence chêne Rødgrød añejo Кресло Стол дубовый Гречка Étagère Über".split()


def model():
    return E.train([(w, 50) for w in WORDS] + [("dock?", 3)])


def judge(m, w):
    return E.judge(m, [w])[0]


def test_round_trip_of_every_chain():
    for chain in E.CHAINS[1:]:
        for w in WORDS:
            g = E.garble(w, chain)
            if g is not None:
                assert E.restore(g, chain) == w


def test_held_out_words_are_found_and_restored():
    m = model()
    hits = right = total = 0
    r = random.Random(1)
    for w in WORDS:
        typo = w[:-1] + r.choice("aeio") if w.isascii() or ord(w[-1]) < 128 else w
        for chain in E.CHAINS[1:]:
            g = E.garble(typo, chain)
            if g is None or g == typo:
                continue
            bad, good = judge(m, g)
            total += 1
            hits += bad
            right += good == typo
    assert total > 300 and hits / total > 0.95 and right / total > 0.75


def test_correct_text_is_left_alone():
    m = model()
    for w in [*WORDS, "MAÇÃ,", "LÁMPARA", "dock?", "9×12", "½", "plain", "Canapé,"]:
        assert judge(m, w) == (False, None), w


def test_lost_for_good():
    m = model()
    for w in ("L?mpara", "��mpara", "Schl?ssel"):
        assert judge(m, w) == (True, None), w


def test_the_classifier_decides():
    """Scores that tell nothing, or always none, wreck the result: nothing beside the classifier finds garbled words."""
    m = model()
    pairs = [(g, w) for w in WORDS for c in E.CHAINS[1:] if (g := E.garble(w, c)) is not None and g != w and not any(0x7F <= ord(x) < 0xA0 for x in g)]
    garbled = [g for g, _ in pairs]
    right = lambda: sum(good == w for (_, good), (_, w) in zip(E.judge(m, garbled), pairs))
    assert right() >= 0.9 * len(pairs) and sum(bad for bad, _ in E.judge(m, garbled)) >= 0.97 * len(pairs) and not any(bad for bad, _ in E.judge(m, WORDS))
    m.scores = lambda words: np.tile(np.eye(len(E.CHAINS))[0], (len(words), 1))
    assert not any(bad for bad, _ in E.judge(m, garbled))
    m.scores = lambda words, r=np.random.default_rng(1): r.normal(size=(len(words), len(E.CHAINS)))
    assert right() < 0.5 * len(pairs) and sum(bad for bad, _ in E.judge(m, WORDS)) > 0.5 * len(WORDS)


def test_records(spark):
    good = ["una Lámpara", "Bücherregal neu", "Größe über Canapé", "Стол дубовый"] * 12
    rows = [(i, t, "x") for i, t in enumerate(good)] + [(900, "una LÃ¡mpara y\nSillÃ³n", "x"), (901, None, "x"), (902, "", "x"), (903, "plain?", "x"), (904, "GrГ¶Гџe", "x"), (905, "a L?mpara", "x"), (906, "Größe " * 20000 + "GrÃ¶ÃŸe", "x"), (906, "Canap�", "x")]
    df = spark.createDataFrame(rows, "rec_no bigint, txt string, table_name string").withColumnRenamed("txt", "memo")
    out = E.garbled(spark, {"t": df}, (E.Field("t", "memo"),)).collect()
    assert sorted(r["rec_no"] for r in out) == [900, 904, 905, 906, 906]
    assert {r["rec_no"]: r["restored"] for r in out if r["rec_no"] in (900, 904)} == {900: "una Lámpara y\nSillón", 904: "Größe"}
    assert E.garbled(spark, {"t": df.limit(0)}, (E.Field("t", "memo"),)).count() == 0


def test_words_beyond_those_fitted_are_known(spark, monkeypatch):
    monkeypatch.setattr(E, "TRAINING_WORDS", 2)
    rows = [(k, f"{a}é{b}") for k, (a, b) in enumerate([(a, b) for a in "bcdfgl" for b in ("ron", "las", "tin", "mar", "nel")] * 20)] + [(2000 + i, "Canapé") for i in range(12)] + [(3000, "Canap?")]
    df = spark.createDataFrame(rows, "rec_no bigint, memo string")
    assert [r["rec_no"] for r in E.garbled(spark, {"t": df}, (E.Field("t", "memo"),)).collect()] == [3000]
