import random

from rxweave.llm import leakage as L


def found(spark, docs, items, **params):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*x, "x") for x in items], "item_id bigint, text string, doc_id string")
    return {(r.doc_id, r.item_id): r.longest for r in L.leaked_items(d, i, **params).collect()}


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def test_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(2, 25)))) for k in range(20)]
    docs = [(k, ", ".join(rng.choice("abcABC") for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    want = {}
    for i, t in docs:
        for k, u in items:
            n = longest(L.words_of(t), L.words_of(u))
            if n >= 6:
                want[i, k] = n
    assert want and found(spark, docs, items, least=6) == want
    assert found(spark, docs, items, least=6, block_words=30) == want


def test_edges(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, passage.upper().replace(" ", " -- ")), (2, passage.replace("five", "five x")), (3, None), (4, ""), (5, "pre " + passage + " post"), (5, passage), (6, "z " * 100_000 + passage)]
    items = [(1, passage), (1, passage), (2, None), (3, "one two"), (None, passage), (4, "so " + passage + " then")]
    assert found(spark, docs, items) == {(d, i): 10 for d in (1, 5, 6) for i in (1, 4)}
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}


def test_decontamination(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"Keep this. {passage}! And quite a lot of other text that stays in the document as it was."), (2, passage + " end"), (3, "clean"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(9, passage)], "item_id bigint, text string")
    got = {r.doc_id: (r.action, r.spans, r.text) for r in L.decontaminate(d, i).collect()}
    assert got[1] == ("strip", 1, "Keep this. ! And quite a lot of other text that stays in the document as it was.")
    assert got[2] == ("drop", 1, None) and got[3] == ("keep", 0, "clean") and got[4] == ("keep", 0, None)


def test_blocks_of_items_cut_the_same_spans(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(4, 30)))) for k in range(25)]
    docs = [(k // 2, " ".join(rng.choice("abcdxyz") for _ in range(rng.randrange(0, 80)))) for k in range(60)] + [(99, None)]
    d = spark.createDataFrame([(*x, "r") for x in docs], "doc_id bigint, text string, row string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda **params: sorted(map(repr, L.decontaminate(d, i, least=4, **params).collect()))
    assert rows(block_words=40) == rows()
    assert len({r.action for r in L.decontaminate(d, i, least=4).collect()}) > 1
