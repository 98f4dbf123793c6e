import numpy as np

from millrace.llm import personal as P
from millrace.llm import tagger as T
from millrace.llm.train_tagger import written


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in T.initial(3).items()}
    x, y = rng.integers(0, 40, (7, 2)), rng.integers(0, T.N, (7, 2))
    _, g = T.loss_and_gradients(p, x, y)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape) if name[0] != "x" else (int(x[2, 0]), 4)
        old = p[name][at]
        e = 1e-3
        p[name][at] = old + e
        up = T.loss_and_gradients(p, x, y)[0]
        p[name][at] = old - e
        down = T.loss_and_gradients(p, x, y)[0]
        p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at]), name


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(4, 1, T.N)), rng.normal(size=(T.N, T.N))
    best = max(itertools.product(range(T.N), repeat=4), key=lambda p: sum(e[i, 0, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])))
    assert tuple(T.viterbi(e, t)[:, 0]) == best


def test_held_out_lines():
    rows = written(1500, seed=99)
    spans = T.Tagger(T.load())([r[0] for r in rows])
    right = total = found = 0
    for (line, want), marks in zip(rows, spans):
        got = set(P.exact_spans(line, marks))
        total += len(want)
        found += len(got)
        right += len(got & set(want))
    assert right / total > 0.93 and right / found > 0.93


def test_windows_are_reconciled():
    line = "    ping mimbigis_torben@example.org, not the list"
    text = "x = 1; " * 14 + line.strip() + " " + "y = 2; " * 40
    spans = [P.exact_spans(t, m) for t, m in zip([text], T.Tagger(T.load())([text]))][0]
    assert ("mimbigis_torben@example.org", "email") in {(text[a:b], k) for a, b, k in spans}


def test_found_and_redacted(spark):
    text = "Author: Torben Droneban <torben.droneban@example.org>\n\n    call 703 555 0187 ext. 33 before deploying\n    Clone with git@forge.example:tools/key.git to reproduce.\n    tel 1 (395) 555 0179\n    ships to P.O. Box 4186, Rindaville now\n    passport QQ 95 93 79 B in the fixture\n"
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "nothing here", "d"), (5, text * 300, "e"), (6, text, "f")], "doc_id bigint, text string, kind string")
    got = {}
    for r in P.found_texts(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["found_text"]))
    want = {("person_name", "Torben Droneban"), ("email", "torben.droneban@example.org"), ("phone", "703 555 0187 ext. 33"), ("phone", "1 (395) 555 0179"), ("street_address", "P.O. Box 4186, Rindaville"), ("id_number", "QQ 95 93 79 B")}
    assert got[1] == got[5] == got[6] == want and set(got) == {1, 5, 6}
    red = {r["doc_id"]: r["text"] for r in P.redacted(docs).collect()}
    assert "[PERSON_NAME] <[EMAIL]>" in red[1] and "call [PHONE] before" in red[1] and "git@forge.example:tools/key.git" in red[1]
    assert P.found_texts(docs.limit(0)).count() == 0


def test_spans_do_not_depend_on_the_batch():
    lines = [r[0] for r in written(600, seed=5)]
    alone = [T.tag_lines(T.load(), [line])[0] for line in lines[:150]]
    assert T.tag_lines(T.load(), lines)[:150] == alone and T.tag_lines(T.load(), lines, 500)[:150] == alone
    assert T.Tagger(T.load())(["x" * 5000, "", "\n"]) == [[], [], []]


def test_lines_passed_over_hold_nothing():
    """Every line written with a value may hold one by the quick look."""
    rows = [(line, spans) for line, spans in written(6000, seed=8) if spans]
    assert all(T.POSSIBLE.search(line) for line, spans in rows)


def test_unseen_names_and_forms():
    """Values that no list or pattern of the trainer holds."""
    want = {
        "reviewed by Mateusz Kowalczyk": "Mateusz Kowalczyk", "Author: Thandiwe Nkosi <t.nkosi@wits.example>": "Thandiwe Nkosi", "thanks to Anneliese Brockhaus": "Anneliese Brockhaus", "reported by Obinna Chukwuemeka": "Obinna Chukwuemeka", "Signed-off-by: Padraig Hennessy <p@x.example>": "Padraig Hennessy",
        "    author = \"Ludmila Vavrova\"": "Ludmila Vavrova", "owner: Giuseppe Tornatore": "Giuseppe Tornatore", "# maintainer: Siobhan McGuigan": "Siobhan McGuigan", "    ping bjarne.s@uni-ulm.de please": "bjarne.s@uni-ulm.de", "mail oyelaran77@futa.example": "oyelaran77@futa.example",
        "write to k.tanaka at riken dot example": "k.tanaka at riken dot example", "contact: ROSALIND.HU@MIT.EXAMPLE": "ROSALIND.HU@MIT.EXAMPLE", "office: Hauptstraße 15, 10115 Berlin": "Hauptstraße 15, 10115 Berlin", "ships to 4711 Larkspur Hollow Road, Dunmore, PA 18512": "4711 Larkspur Hollow Road, Dunmore, PA 18512", "address: 88 Wexcombe Street": "88 Wexcombe Street",
        "call 020 7946 0958 today": "020 7946 0958", "tel: +49 30 9018 2044": "+49 30 9018 2044", "phone (617) 253-1000": "(617) 253-1000", "ssn: 078-05-1120": "078-05-1120", "passport XK4471902": "XK4471902",
    }
    got = [{line[a:b] for a, b, _ in P.exact_spans(line, marks)} for line, marks in zip(want, T.Tagger(T.load())(list(want)))]
    missed = [v for v, found in zip(want.values(), got) if v not in found]
    assert len(missed) <= len(want) // 10, missed


def test_very_long_line(spark):
    text = "some plain words " * 12_000 + "ping mimbigis_torben@example.org, not the list" + " and more words" * 5000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r["found_text"] for r in P.found_texts(docs).collect()] == ["mimbigis_torben@example.org"]
