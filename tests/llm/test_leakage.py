import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import leakage as L


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = L.words_of(text)
        own = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for k, t in items:
            v = L.words_of(t)
            if any(tuple(v[i : i + 12]) in own for i in range(len(v) - 11)):
                out.add((d, k))
    return out


def corpus(seed=2):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(5, 60)))) for k in range(25)]
    docs = []
    for d in range(80):
        text = [r.choice(words) for _ in range(r.randint(0, 120))]
        if d % 3 == 0:
            v = L.words_of(items[d % 25][1])
            n = r.choice([11, 12, 13, 30])
            at = r.randint(0, max(0, len(v) - n))
            text[len(text) // 2 : len(text) // 2] = v[at : at + n]
        docs.append((d, "\n+  // ".join([" ".join(text[:50]).upper(), ", ".join(text[50:])])))
    return docs + [(900, None), (901, ""), (902, docs[0][1])], items + [(901, None), (902, "short")]


def test_both_ways_against_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 15
    for limit in (L.BROADCAST_CHARS, 0):
        rows = L.leaks(d, i, limit).collect()
        got = [tuple(r)[:2] for r in rows]
        shingles = lambda t: {tuple(w[k : k + 5]) for w in [L.words_of(t)] for k in range(len(w) - 4)}
        for r in rows[:20]:
            item, doc = shingles(dict(items)[r["item_id"]]), shingles(dict(docs)[r["doc_id"]])
            assert r["containment"] == len(item & doc) / len(item) >= L.BOUND / 2 ** L.partition_of(len(item))
        assert set(got) == want and len(got) == len(want)
        assert L.leaks(d.limit(0), i, limit).count() == 0 and L.leaks(d, i.limit(0), limit).count() == 0


def test_long_document(spark):
    item = " ".join(f"q{i}" for i in range(12))
    d = spark.createDataFrame([(1, "filler " * 200_000 + item + " tail" * 1000)], "doc_id bigint, text string")
    assert L.leaks(d, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()[0] == (1, 7, 1.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=12, max_size=40), st.lists(st.sampled_from("abcdef"), max_size=40), st.lists(st.sampled_from("abcdef"), max_size=40))
def test_shared_passages_always_share_a_signature(passage, before, after):
    h = L.Hasher()
    a, b = set(L.signatures(h(passage)).tolist()), set(L.signatures(h(before + passage + after)).tolist())
    assert a <= b or a & b


def test_a_text_that_most_share(spark):
    """A value on a third of all rows of both sides is spread over salts and loses nothing."""
    licence = " ".join(f"l{k}" for k in range(40))
    docs = [(d, f"{licence} own{d}" if d % 3 == 0 else f"other words number {d}") for d in range(300)]
    items = [(k, f"x{k} {licence}") for k in range(30)] + [(100, "something else entirely")]
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 0)
    assert got.count() == 100 * 30 and got.select("doc_id", "item_id").distinct().count() == 3000
