"""Target similarity: against brute force, and without a row for every pair and edge."""

import datetime as dt
import difflib
import random

import pytest
from shuffles import shuffled

from rxweave.operators import matching as X
from rxweave.queries import queries

ROWS = "prescription_id int, drugs array<string>, interactions array<struct<text_id: bigint, drug_a: string, drug_b: string, ground_truth_severity: string, drugbank_description: string, drugbank_id: string>>, loaded_at timestamp"


def altered(rng, word, most=3):
    for _ in range(rng.randrange(most + 1)):
        k = rng.randrange(len(word) + 1)
        word = word[:k] + rng.choice(("", rng.choice("abcd"))) + word[k + rng.randrange(2) :]
    return word


def test_block_loses_no_pair(spark):
    rng = random.Random(5)
    right = list({"".join(rng.choices("abcdefgh", k=rng.randrange(1, 30))) for _ in range(150)})
    left = list({altered(rng, w) for w in right for _ in range(4)} | {"a", "ab", "", "é", "öß"} | set(right))
    want = {(x, y) for x in left for y in right if difflib.SequenceMatcher(None, x, y).ratio() >= 0.85}
    got = X.blocked_alike(spark.createDataFrame([(x,) for x in [*left, None]], "l string"), spark.createDataFrame([(y,) for y in [*right, None]], "r string"), 0.85).collect()
    assert len(got) == len(set(got)) and want <= {(x.l, x.r) for x in got}
    assert len(got) < 0.1 * len(left) * len(right)


@pytest.fixture
def many_edges(spark, tmp_path):
    """One drug with many targets and many partners; prescriptions delivered twice, the later one holds."""
    rng = random.Random(2)
    targets = ["".join(rng.choices("abcdefghij", k=rng.randrange(9, 13))) for _ in range(400)]
    rows = []
    for k, t in enumerate(targets):
        x = (900 - k, "Hub " if k % 2 else "hub", t.title() if k % 3 else t, "Mild", "text", "D1")
        rows.append((k, ["Hub", altered(rng, t), None, " "], [x, (2000 + k, None, t, None, None, None)], 2))
        rows.append((k, ["Hub", t + "zzz"], [(3000 + k, "hub", t + "zz", None, None, None)], 1))
    spark.createDataFrame([(i, d, x, dt.datetime(2024, 1, n)) for i, d, x, n in rows], ROWS).write.parquet(f"{tmp_path}/keyword_smoke10.parquet")
    spark.createDataFrame([(1, "Hub", None, "c")], "drug_id int, drug_name string, brand_names array<string>, drug_class string").write.parquet(f"{tmp_path}/drug_reference.parquet")
    return str(tmp_path), targets, [r[1][1] for r in rows[::2]]


def test_targets_of_a_drug_with_many_edges(spark, many_edges):
    folder, targets, names = many_edges
    want = {}
    for b in names:
        hits = [(900 - k, t) for k, t in enumerate(targets) if difflib.SequenceMatcher(None, b, t).ratio() >= 0.85]
        if hits:
            want["hub", b] = min(hits)
    got = []
    records, _ = shuffled(spark, lambda: got.extend(queries()["kb_target_similarity"](spark, folder).collect()))
    assert len(want) > 200 and {(r.a, r.b): (r.pos, r.target) for r in got} == want
    assert records < 40_000, "a name meets each target once, not in every pair and edge"
