import itertools
import math
import random
from collections import Counter

import pytest

from rxweave.llm import cooccurrence as C


def brute(baskets):
    return Counter(p for items in baskets for p in itertools.combinations(sorted(set(items)), 2))


def entries(spark, baskets):
    rows = [(k, i, "x") for k, items in enumerate(baskets) for i in set(items)]
    return spark.createDataFrame(rows, "basket int, item string, together string")


@pytest.mark.parametrize("block", [3, 64])
def test_counts_with_and_without_blocks(spark, block):
    rng = random.Random(2)
    baskets = [[f"i{rng.randrange(30)}" for _ in range(rng.randrange(1, 25))] for _ in range(60)]
    got = {(r.a, r.b): r.together for r in C.pair_counts(entries(spark, baskets), block).collect()}
    assert got == dict(brute(baskets))


def test_a_basket_with_a_third_of_all_rows(spark):
    baskets = [[f"h{k}" for k in range(300)], *[[f"h{k % 300}", f"x{k}"] for k in range(300)]]
    got = C.pair_counts(entries(spark, baskets), 32)
    assert got.count() == 300 * 299 // 2 + 300


def test_scores(spark):
    baskets = [["a", "b"]] * 6 + [["a"]] * 2 + [["b", "c"]] * 2 + [["d"]] * 10
    r = {(x.a, x.b): x for x in C.associations(entries(spark, baskets), 20, least=3).collect()}
    assert set(r) == {("a", "b")}
    x = r["a", "b"]
    assert (x.together, x.n_a, x.n_b) == (6, 8, 8) and x.lift == pytest.approx(6 * 20 / 64) and x.jaccard == 0.6
    assert x.pmi == pytest.approx(math.log(6 * 20 / 64)) and x.npmi == pytest.approx(math.log(6 * 20 / 64) / -math.log(0.3))
    cells = [(6, 8 * 8 / 20), (2, 8 * 12 / 20), (2, 12 * 8 / 20), (10, 12 * 12 / 20)]
    assert x.g2 == pytest.approx(2 * sum(o * math.log(o / e) for o, e in cells))


def test_cleaning_repeats_and_nulls(spark):
    rows = [(1, ["\tA ", "a", " B ", None, "", " "]), (1, ["b"]), (2, None), (None, ["a", "b"]), (3, []), (4, ["c"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "basket int, items array<string>, item string")
    got = C.basket_items(df, "basket", "items")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (4, "c")]
    assert [tuple(r) for r in C.pair_counts(got).collect()] == [("a", "b", 1)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "basket int, item string")
    assert C.pair_counts(empty).count() == 0 and C.associations(empty, 0).count() == 0
