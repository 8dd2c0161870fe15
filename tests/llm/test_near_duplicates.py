import random

import numpy as np
import pytest

from rxweave.llm import near_duplicates as N
from rxweave.llm.minhash import least_matches, lost_in_tests, minima, posterior_cut, signatures

SCHEMA = "source string, text_id bigint, text string, rep string, h string, a int"


def found(spark, records, **params):
    df = spark.createDataFrame([(s, i, t, "x", "y", 1) for s, i, t in records], SCHEMA)
    pairs, members = N.similar_pairs(df, **params)
    return {tuple(r) for r in N.expand_pairs(pairs, members).collect()}


def jaccard(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        words = rng.sample(vocab, rng.randrange(5, 40))
        rows.append(words)
        for _ in range(rng.randrange(3)):
            edited = list(words)
            for _ in range(rng.randrange(1, 1 + len(words) // 3)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            rng.shuffle(edited)
            rows.append(edited)
    return [("conflicts" if k % 3 else "other", k, " ".join(w)) for k, w in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = corpus(4, 150)
    want = {(i, j) for s, i, t in rows for r, j, u in rows if i < j and s == r and jaccard(t, u) >= 0.6}
    got = found(spark, rows)
    assert got <= want
    assert {p for p in want if jaccard(rows[p[0]][2], rows[p[1]][2]) >= 0.65} <= got
    assert len(want - got) <= 0.02 * len(want)


def test_copies_case_and_separators(spark):
    rows = [("s", 1, "A b, c"), ("s", 2, "c B a!"), ("s", 3, "a b c"), ("t", 4, "a b c"), ("s", 9, "x y z")]
    assert found(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_null_empty_wordless_and_long_texts(spark):
    long = " ".join(f"word{k}" for k in range(50_000))
    rows = [("s", 1, None), ("s", 2, ""), ("s", 3, " --- "), ("s", 4, None), ("s", 5, long), ("s", 6, long + " one more"), ("s", 7, "single"), ("s", 8, "single")]
    assert found(spark, rows) == {(5, 6), (7, 8)}


def test_no_rows(spark):
    assert found(spark, [("s", 1, "a")]) == set()
    df = spark.createDataFrame([], SCHEMA)
    pairs, members = N.similar_pairs(df)
    assert pairs.count() == 0 and members.count() == 0


def test_a_family_of_a_third_of_all_rows_keeps_every_link(spark):
    base = [f"b{k}" for k in range(40)]
    rows = [("s", k, " ".join(base + [f"v{k}"])) for k in range(100)] + [("s", 100 + k, " ".join(f"u{k}x{m}" for m in range(10))) for k in range(200)]
    assert len(found(spark, rows, hot=16)) == 100 * 99 // 2


def test_banding_weighs_rows_against_pairs():
    for n in (10**3, 10**6, 10**10):
        pairs = {r: n * n / 2 * 0.08**r for r in N.LENGTHS}
        bands, rows = N.banding(n, pairs, 0.6, 0.007)
        assert (1 - 0.6**rows) ** bands <= 0.007
        work = lambda r: N.bands_for(r, 0.6, 0.007) * (n * N.PAIRS_PER_ROW + pairs[r])  # noqa: B023, E731
        assert all(work(rows) <= work(r) for r in N.LENGTHS)
    assert N.banding(0, dict.fromkeys(N.LENGTHS, 0.0), 0.6, 0.007)[1] == N.LENGTHS[0]


def test_pairs_per_band_follow_the_counted_ones(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(14)], 9)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "tid bigint, text string")
    sets = N.with_sets(df.selectExpr("'s' AS grp", "tid", "text"))
    records, pairs = N.pairs_per_band(sets, 3)
    flat = [np.array(r.h) for r in sets.select("h").collect()]
    starts = np.cumsum([0] + [len(x) for x in flat[:-1]])
    made = list(minima(np.concatenate(flat), starts, N.LENGTHS[-1], 4))
    assert records == 3000
    for rows in (4, 5, 6):
        _, n = np.unique(np.stack(made[:rows], 1), axis=0, return_counts=True)
        assert pairs[rows] == pytest.approx((n * (n - 1) // 2).sum(), rel=0.15, abs=300)
    assert N.pairs_per_band(sets.limit(0), 3) == (0, dict.fromkeys(N.LENGTHS, 0.0))


@pytest.mark.parametrize("params", [{"rows": 2, "hot": 8}, {"rows": 5, "hot": 256}, {"rows": 7, "hot": 4}])
def test_length_of_bands_and_splitting_change_nothing(spark, params):
    rows = corpus(9, 80)
    sure = {(i, j) for s, i, t in rows for r, j, u in rows if i < j and s == r and jaccard(t, u) >= 0.65}
    got = found(spark, rows, **params)
    assert sure <= got and all(jaccard(rows[i][2], rows[j][2]) >= 0.6 for i, j in got)


def test_ids_and_group_names_that_clash(spark):
    base = " ".join(f"b{k}" for k in range(20))
    rows = [("x", 1, base), ("x", 2, base + " more"), ("y", 1, base), ("y", 2, "other words"), (None, 3, base), (None, 4, base + " less")]
    for name in ("g", "source", "id", "key"):
        df = spark.createDataFrame([(s, i, t, "x") for s, i, t in rows], f"{name} string, text_id bigint, text string, h string")
        pairs, members = N.similar_pairs(df, group=name)
        assert {tuple(r)[:3] for r in pairs.collect()} == {("x", 1, 2), (None, 3, 4)}
        assert members.count() == 6


def test_agreement_of_one_bit_signatures():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 300)
    x, y = base[:200], base[100:]
    _, sketch = signatures(np.concatenate([x, y]), np.array([0, 200]), 1, 1, 1024, 3)
    agree = 1024 - sum(int(v).bit_count() for v in sketch[0] ^ sketch[1])
    assert agree / 1024 == pytest.approx((1 + 1 / 3) / 2, abs=0.06)


def test_pruning_bound():
    least = least_matches(0.6, N.BATCHES, posterior_cut(0.6, N.BATCHES, 0.003))
    bits = np.random.default_rng(0).random((40_000, 256)) < 0.8
    kept = np.ones(len(bits), bool)
    for n, m in zip(N.BATCHES, least):
        kept &= bits[:, :n].sum(1) >= m
        assert m > n * 0.5
    assert (~kept).mean() < 0.004
    assert lost_in_tests(0.6, N.BATCHES, least) == pytest.approx((~kept).mean(), abs=0.001)
