import math

import pytest
from pyspark.sql import functions as F

from rxweave.llm import canonical as K

NAMES = [(1, "Foliobemoxane"), (1, "Doquuwira"), (2, "Nyqniacozifane"), (3, "Nyquacozifane"), (4, "Stowygudolact"), (5, "Xuxixyn"), (6, None), (7, " ")]


def mapped(spark, values, names=NAMES, **params):
    v = spark.createDataFrame([(x, "s") for x in values], "entered string, target string")
    r = spark.createDataFrame([(*n, 1) for n in names], "target bigint, surface string, score int")
    return {x.entered: x.target for x in K.map_values(v, r, **params).collect()}


CASES = {
    "FOLIOBEMOXANE": 1, "Tab. foliobemoxane 50 mg": 1, "Foliobe moxane": 1, "Foliobem­oxane": 1, " Foliobemoxane": 1, "Folíobemoxane": 1, "foliobemoxane500MG": 1, "F0liobem0xane": 1,
    "Foliobemoxane hydrochloride": 1, "doquuwria": 1, "Nyqniacozifane": 2, "Nyquacozifane SR": 3, "Stowygudo1act*": 4, "StowygudoIact": 4, "Xuxxiyn": 5,
    "bed rest 3 days": None, "nil": None, "??": None, "  ": None, "Grozhiokrigen": None, "500 mg": None,
}


def test_values(spark):
    assert mapped(spark, [*CASES, None, "FOLIOBEMOXANE"]) == CASES


def test_lists_joined_by_a_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_POSTINGS", 0)
    assert mapped(spark, CASES) == CASES


def test_threshold_and_margin_decide(spark):
    names = [(1, "abcdefghix"), (2, "abcdefghiy")]
    assert mapped(spark, ["abcdefghiz"], names) == {"abcdefghiz": None}
    assert mapped(spark, ["abcdefghiz"], names, margin=0.0) == {"abcdefghiz": 1}
    assert mapped(spark, ["same"], [(1, "same"), (2, "same")]) == {"same": None}
    assert mapped(spark, ["Grozhiokrigen"], threshold=0.0, margin=0.0, reported=0.0)["Grozhiokrigen"] is not None


def test_grams_and_scores(spark):
    def sets(key):
        p = f"^{key}$"
        three = [p[i : i + 3] for i in range(len(p) - 2)]
        return {p[i : i + 2] for i in range(len(p) - 1)} | set(three) | {g[0] + "_" + g[2] for g in three} | {"~" + "".join(sorted(g)) for g in three} | {"|" + key[:2] + key[-2:]}

    df = spark.createDataFrame([("abcab",), ("x",)], "key string")
    assert {r.key: set(r.g) for r in df.select("key", K.grams(F.col("key")).alias("g")).collect()} == {k: sets(k) for k in ("abcab", "x")}
    names = ["cadebe", "cabeda", "becada"]
    count = {g: sum(g in sets(n) for n in names) for n in names for g in sets(n)}
    weight = lambda g: math.log(4 / (1 + count[g])) + 1 if g in count else 1.0
    norm = lambda k: math.sqrt(sum(weight(g) ** 2 for g in sets(k)))
    cosine = lambda x, y: sum(weight(g) ** 2 for g in sets(x) & sets(y)) / norm(x) / norm(y)
    v = spark.createDataFrame([("cabede",), ("dabeca",)], "entered string")
    r = spark.createDataFrame(list(enumerate(names)), "target bigint, surface string")
    for row in K.map_values(v, r, reported=0.0).collect():
        want = sorted(((cosine(row.entered, n), -k) for k, n in enumerate(names)), reverse=True)
        assert (row["first"], row.score, row.next_score) == (-want[0][1], pytest.approx(want[0][0]), pytest.approx(want[1][0]))


def test_empty_list_and_no_values(spark):
    assert mapped(spark, ["x"], []) == {"x": None}
    assert mapped(spark, []) == {}


@pytest.mark.parametrize(
    "text, values",
    [("['a', \"b'c\"]", ["a", "b'c"]), ('["a", "b"]', ["a", "b"]), ("('a',)", ["a"]), ("['x\\xadz', '\\t y']", ["x­z", "\t y"]), ('["a", null]', ["a"]), ("[]", []), ("", []), (None, []), ("['a', 'b", ["a"]), ("['a', None, 3]", ["a"]), ("'a'", ["a"])],
)
def test_lists_written_as_text(text, values):
    assert K.literal_values(text) == values


def test_parse_lists(spark):
    df = spark.createDataFrame([("['a']", 1), ("['a']", 2), (None, 3)], "written string, values int")
    assert [(r.written, r["values"]) for r in K.parse_lists(df).collect()] == [("['a']", ["a"])]
    assert K.parse_lists(df.where(F.lit(False))).count() == 0
