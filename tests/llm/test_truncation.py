import random

import duckdb
import pytest

from millrace.llm import truncation as T

PHRASES = ["leaking at the joint", "crushed on one side", "overgrown with brush", "half full of sediment"]
PLACES = ["near the north driveway", "behind the fence line", "below the parking area"]
HEADS = ["Inlet", "Outlet", "Grate", "Culvert", "Weir"]


def rows():
    out = []
    for k, h in enumerate(HEADS * 6):
        for p in PHRASES:
            out.append(f"{h} {p}")
            out += [f"{h} {p} {q}" for q in PLACES]
    cut = ["Inlet leaking at the jo", "Grate crushed on one side behind the", "Weir half full of sediment near the nor", "Outlet overgrown wi"]
    whole = ["Inlet leaking at the joint, new spruce", "Seldom seen remark"]
    texts = out + cut + whole + [None, "", "   "]
    return [(i, t, "crew" if i % 2 else None, "clash") for i, t in enumerate(texts)], {len(out) + i for i in range(len(cut))}


@pytest.fixture(scope="module")
def found(spark):
    data, want = rows()
    df = spark.createDataFrame(data, "rec_no bigint, comments string, source_sys string, table_name string")
    fields = (T.Field("t", "comments"),)
    return df, want, [tuple(r) for r in T.truncated(spark, {"t": df}, fields).collect()], fields


def test_cut_and_complete(found):
    _, want, got, _ = found
    assert {r for _, r in got} == want and len(got) == len(want)


def test_same_as_duckdb(spark, found):
    df, _, got, fields = found
    con = duckdb.connect()
    con.register("t", df.toPandas())
    assert sorted(con.execute(T._sql(fields, T._CUT)).fetchall()) == sorted(got)
    shares = {tuple(r) for r in T.truncation_shares(spark, {"t": df}, fields).collect()}
    assert sum(s[3] for s in shares) == len(got) and sum(s[2] for s in shares) == len(rows()[0]) - 3


def test_repeated_rows_and_empty_table(spark, found):
    df, want, _, fields = found
    twice = T.truncated(spark, {"t": df.union(df)}, fields)
    assert twice.count() == 2 * len(want)
    assert T.truncated(spark, {"t": df.limit(0)}, fields).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 20000, "s"), (2, "word", "s")], "rec_no bigint, comments string, source_sys string")
    T.truncated(spark, {"t": df}, (T.Field("t", "comments"),)).collect()


def test_very_long_word(spark):
    df = spark.createDataFrame([(1, "w" * 200_000, "s"), (2, "w" * 199_999 + " end", "s")], "rec_no bigint, comments string, source_sys string")
    assert T.truncated(spark, {"t": df}, (T.Field("t", "comments"),)).count() == 0


def test_cut_inside_a_very_long_word(spark):
    long = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(300))
    texts = [f"see {long} today"] * 8 + [f"see {long[:170]}", f"see {long[:30]}"] + ["see it today"] * 40
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "rec_no bigint, comments string, source_sys string")
    assert sorted(r["rec_no"] for r in T.truncated(spark, {"t": df}, (T.Field("t", "comments"),)).collect()) == [8, 9]


def test_whole_remarks_that_many_records_make(spark):
    """A remark made by hundreds of records is whole, even where its words mostly go on elsewhere."""
    remarks = ["sed", "ok", "12 in dia", "no access", "w/ flap gate", "N/A", "private prop"]
    longer = ["sediment removed", "ok to enter gate now", "pipe 12 in dia at inlet", "no access road here", "flap gate w/ chain", "new access gate", "a new gate at inlet", "private property line"]
    texts = remarks * 300 + longer * 900 + ["sediment rem", "private prope"]
    df = spark.createDataFrame([(i, t, "crew") for i, t in enumerate(texts)], "rec_no bigint, comments string, source_sys string")
    got = {texts[r["rec_no"]] for r in T.truncated(spark, {"t": df}, (T.Field("t", "comments"),)).collect()}
    assert not got & set(remarks) and {"sediment rem", "private prope"} <= got


def test_planted_cuts_are_told_from_whole_texts(spark):
    """Independent of the statement: whole texts of a small grammar, a twentieth cut at a random place inside a word or phrase."""
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("bol", "cran", "dul", "fen", "gor", "hast", "kel", "mor") for b in ("ert", "ingle", "ow", "ade", "ip")]
    head, tail = words[:20], words[20:]
    texts, cut = [], set()
    for i in range(6000):
        whole = " ".join(r.choice(head) for _ in range(r.randint(2, 4))) + " " + r.choice(tail)
        if i % 20 == 0:
            texts.append(whole[: whole.rindex(" ")] if r.random() < 0.5 else whole[: r.randint(6, len(whole) - 1)].rstrip())
            cut |= {i} if texts[-1] != whole else set()
        else:
            texts.append(whole)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "rec_no bigint, comments string, source_sys string")
    got = {x["rec_no"] for x in T.truncated(spark, {"t": df}, (T.Field("t", "comments"),)).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got & cut) >= 0.95 * len(got), (len(got), len(cut), len(got & cut))


def test_a_stray_long_value_is_no_limit(spark):
    """The limit is the length where values pile up; one dirty value beyond it changes nothing."""
    texts = ["alpha beta gamma delta"] * 600 + ["alpha beta gamma del"] * 60 + ["alpha beta"] * 300 + ["alpha beta gamma " + "delta " * 30]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "rec_no bigint, comments string, source_sys string")
    limits = spark.sql(f"{T._filled((T.Field('t', 'comments'),), lambda f: '{t}')} {T._LIMITS}", t=df).collect()
    assert [x["longest"] for x in limits] == [22]
