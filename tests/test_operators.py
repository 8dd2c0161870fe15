"""Operators on small fixtures: nulls, empty tables, ties, repeated rows, extra columns; and against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxweave.functions import similarity
from rxweave.operators import lexicon as L
from rxweave.operators import matching as X
from rxweave.operators import metrics as M
from rxweave.operators import pairs as P
from rxweave.operators import scan
from rxweave.operators import search as Q
from rxweave.plans.prefix import numbered, running_totals
from rxweave.sources import readers as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pairs_of_a_record(spark):
    items = spark.createDataFrame([(1, "a", 0, "x"), (1, "b", 1, "x"), (1, "b", 2, "x"), (2, "a", 0, "x"), (None, "a", 0, "x"), (None, "b", 1, "x")], "k int, item string, ord int, second string")
    got = P.enumerate_pairs(items, "k", "item", "ord")
    assert rows(got.select("k", "first", "second")) == [(1, "a", "b"), (1, "a", "b"), (1, "b", "b")]
    assert P.enumerate_pairs(items.limit(0), "k", "item", "ord").count() == 0


def test_lookup_prefers_the_first_edge_and_falls_back_to_the_reverse(spark):
    edges = spark.createDataFrame([("A", "I1", "B", "d1", "t1", 2), ("A ", None, "b", "d0", "t0", 1), ("C", "", "A", "d2", None, 3), (None, None, "A", "d3", "t3", 4)], "source string, source_id string, target string, description string, target_id string, pos int")
    index = P.flatten_index(edges)
    assert rows(index.select("src_key", "key_kind", "pos")) == [("a", "name", 1), ("a", "name", 2), ("c", "name", 3), ("i1", "id", 2)]
    pairs = spark.createDataFrame([("a", "B", 7), ("a", "c", 7), ("b", "x", 7), (None, "a", 7)], "a string, b string, extra int")
    got = {(r.a, r.b): (r.description, r.direction) for r in P.lookup(pairs, index).collect()}
    assert got == {("a", "B"): ("d0", "forward"), ("a", "c"): ("d2", "reverse"), ("b", "x"): (None, None), (None, "a"): (None, None)}


def test_match_counts_the_first_of_repeated_pairs(spark):
    schema = "k int, a string, b string, severity string, ord int"
    truth = spark.createDataFrame([(1, "x", "Y", "Mild", 0), (1, "y", "x", "Severe", 1), (1, "p", None, "Mild", 2)], schema)
    found = spark.createDataFrame([(1, "Y ", "x", "Mild", 0), (2, "x", "y", "Mild", 0)], schema)
    got = rows(P.match_pairs(truth, found, "k").select("k", "lo", "hi", "outcome", "severity_agrees"))
    assert got == [(1, "", "p", "fn", None), (1, "x", "y", "tp", True), (2, "x", "y", "fp", None)]
    assert P.match_pairs(truth.limit(0), found.limit(0), "k").count() == 0


def test_metrics_with_one_class_and_without_rows(spark):
    one = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "t string, p string")
    report = {r.label: (r.precision, r.recall, r.f1, r.support) for r in M.class_report(one, "t", "p", ("a", "b", "c")).collect()}
    assert report["a"] == (1.0, 0.5, pytest.approx(2 / 3), 2) and report["b"] == (0.0, 0.0, 0.0, 0) and report["c"] == (0.0, 0.0, 0.0, 0)
    s = M.summary(one, "t", "p", ("a", "b", "c")).first()
    assert (s.n, s.accuracy, s.macro_f1) == (2, 0.5, pytest.approx(1 / 3))
    scores = spark.createDataFrame([(0.1, True), (0.2, True)], "s double, y boolean")
    assert M.auc(scores, "s", F.col("y")).first().auc == 0.5
    assert M.auc(scores.limit(0), "s", F.col("y")).first().auc == 0.5
    assert M.roc(scores.limit(0), "s", F.col("y")).count() == 0
    empty = M.describe(scores.limit(0), "s").first()
    assert (empty.mean, empty["std"], empty["min"], empty.confidence) == (0.0, 0.0, 0.0, 1.0)


def test_auc_against_all_pairs(spark):
    rng = random.Random(3)
    data = [(float(rng.randrange(6)), rng.random() < 0.4) for _ in range(300)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert M.auc(spark.createDataFrame(data, "s double, y boolean"), "s", F.col("y")).first().auc == pytest.approx(want)


def test_bootstrap_interval_holds_the_mean(spark):
    data = spark.range(400).select("id", (F.col("id") % 4 != 0).alias("hit"))
    got = M.bootstrap(data, F.col("hit"), 500, 1).first()
    assert 0.68 < got.low < 0.75 < got.high < 0.82 and got["mean"] == pytest.approx(0.75, abs=0.01) and got.above == 1
    assert got == M.bootstrap(data.repartition(3), F.col("hit"), 500, 1).first()
    assert M.bootstrap(data.limit(0), F.col("hit"), 10, 1).count() == 0


def test_class_bootstrap_against_resampled_rows(spark):
    rng = np.random.default_rng(4)
    truth = rng.choice(["a", "b", "c"], 200)
    found = np.where(rng.random(200) < 0.7, truth, rng.choice(["a", "b", "c"], 200))
    df = spark.createDataFrame(list(zip(truth.tolist(), found.tolist())) + [("a", None)], "t string, f string")
    got = {r.metric: (r["mean"], r.low, r.high) for r in M.bootstrap_classes(df, "t", "f", ["b", "c"], 2000, 3).collect()}

    def f1(t, f):
        return 2 * (t & f).sum() / max(1, t.sum() + f.sum())

    draws = []
    for _ in range(2000):
        at = rng.integers(0, 200, 200)
        t, f = truth[at], found[at]
        draws.append(((t == f).mean(), np.mean([f1(t == x, f == x) for x in "abc"]), f1(t != "a", f != "a")))
    for k, name in enumerate(("accuracy", "macro_f1", "binary_f1")):
        v = np.array(draws)[:, k]
        assert got[name] == pytest.approx((v.mean(), *np.percentile(v, [2.5, 97.5])), abs=0.012)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_plain_sum(spark, descending):
    values = random.Random(1).sample(range(100_000), 3000)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v int, w int")
    got = {r.v: r.t for r in running_totals(df, "v", {"t": "w"}, descending=descending).collect()}
    total = 0
    for v in sorted(values, reverse=descending):
        total += v % 7
        assert got[v] == total
    assert sorted(r.rn for r in numbered(df, "v").collect()) == list(range(1, 3001))
    assert running_totals(df.limit(0), "v", {"t": "w"}).count() == 0


def test_dictionary_takes_the_longest_first_and_never_overlaps(spark):
    texts = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None)], "k int, t string").select("k", scan.tokens(F.col("t")).alias("ws"))
    keys = spark.createDataFrame([("a b",), ("b c",), ("a",), ("a",), ("c",)], "key string")
    assert rows(scan.dictionary(texts, "k", "ws", keys).select("k", "at", "key")) == [(1, 0, "a b"), (1, 2, "c"), (1, 3, "a")]
    longer = keys.unionByName(spark.createDataFrame([("a b c a",)], "key string"))
    assert rows(scan.dictionary(texts, "k", "ws", longer).select("k", "at", "key")) == [(1, 0, "a b c a")]


def test_noise_keeps_names_and_cuts_lines(spark):
    text = "Tab. Abc 5 mg, to be taken daily with a lot of water\nplain words of a line\n10 gram Modern"
    df = spark.createDataFrame([(1, text, ["abc", "Abc", "", None]), (2, text, ["of a", "abc"]), (3, "fern 0 e", None)], "k int, t string, names array<string>")
    got = {r.k: (r.a, r.b, r.c) for r in df.select("k", scan.noise_dropped(F.col("k"), F.col("t"), F.col("names"), ("x ",)).alias("a"), scan.noise_glued(F.col("t"), F.col("names")).alias("b"), scan.noise_letters(F.col("k"), F.col("t")).alias("c")).collect()}
    assert got[1][0] == "x Tab. Abc, to be ...\nplain words of ...\n10 gram Modern"
    assert got[1][1].startswith("tab. abc5 mg, to be taken daiIy")
    assert got[3][2] in {"fcm 0 e", "fcrn O e", "fcrn 0 c", "fem O e", "fem 0 c", "fern O c"}
    dosed = spark.createDataFrame([("a 5 mg b 7.5mg 10 gram",)], "t string").select(F.regexp_replace("t", f"(?i){scan.STRENGTH}", "").alias("t")).first().t
    assert dosed == "a b 10 gram"


def test_combination_splits_need_a_known_stem(spark):
    mentions = spark.createDataFrame([("amox/clav",), ("Telma-H",), ("Vitamin-D",), ("Xyz-Plus",), ("a with b",)], "mention string")
    known = spark.createDataFrame([("telma",), ("xyz",)], "name string")
    got = {r.mention: r.fragments for r in scan.split_combos(mentions, known).collect()}
    assert got == {"amox/clav": ["amox", "clav"], "Telma-H": ["telma", "hydrochlorothiazide"], "Vitamin-D": ["vitamin-d"], "Xyz-Plus": ["xyz"], "a with b": ["a", "b"]}


def test_brand_texts(spark):
    rx = spark.createDataFrame([(1, "Simvastatin20mg and simvastatina, Warf", ["simvastatin", "WARF", None]), (2, "nothing", None), (3, "take a(b now", ["A(B"])], "prescription_id int, prescription_text string, drugs array<string>")
    reference = spark.createDataFrame([("Simvastatin", ["Simvotin"]), ("a(b", ["$1\\\\x"]), ("warf", ["Warfex", "W"]), ("other", None)], "drug_name string, brand_names array<string>")
    got = {r.prescription_id: (r.substituted, r.text) for r in scan.brand_texts(rx, reference).collect()}
    assert got == {1: (2, "Simvotin20mg and simvastatina, Warfex"), 2: (0, "nothing"), 3: (1, "take $1\\\\x now")}


def test_vote_prefers_longer_lists_among_contenders(spark):
    facts = spark.createDataFrame([("k", "x", ["a"])] * 3 + [("k", "y", ["a", "b"])] * 2 + [("k", "y", ["a", "b", "c"])] + [("lone", "x", ["z"])], "key string, source string, ings array<string>")
    got = {r.key: (r.ings, r.votes, r.verified) for r in L.vote(facts, "key", "source", "ings", "cdci").collect()}
    assert got == {"k": (["a", "b"], 2, False), "lone": (["z"], 1, False)}


def test_lexicon_pieces(spark):
    base = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "alias string, concepts array<string>")
    over = spark.createDataFrame([("b", ["z"]), ("c", ["w", "v"])], "alias string, concepts array<string>")
    merged = L.upsert(base, over)
    assert rows(merged) == [("a", ["x"], "base"), ("b", ["z"], "over"), ("c", ["w", "v"], "over")]
    mentions = spark.createDataFrame([("C 20mg",), ("no",), ("B",), ("q",)], "mention string")
    assert rows(L.resolve(mentions, merged)) == [("B", "z", "raw"), ("C 20mg", "v", "cleaned"), ("C 20mg", "w", "cleaned"), ("no", "no", "stopword"), ("q", "q", "itself")]
    known = spark.createDataFrame([("salmon calcitonin", "s c"), ("povidone-iodine", "p-i"), ("amoxicillin", "amox")], "name string, canonical string")
    raw = spark.createDataFrame([("Calcitonin (Salmon)",), ("povidone iodine",), ("Amoxicillin Sodium",), ("junk",), ("",)], "raw string")
    assert rows(L.normalize_ingredients(raw, known)) == [("", None), ("Amoxicillin Sodium", "amox"), ("Calcitonin (Salmon)", "s c"), ("junk", None), ("povidone iodine", "p-i")]
    lex = spark.createDataFrame([("p", 1, True), ("a", 5, False), ("b", 5, False), ("c", 9, False)], "key string, n_rows int, priority boolean")
    assert [r.key for r in L.capped(lex, "key", 3).orderBy("key").collect()] == ["a", "c", "p"]


def test_all_entries_are_resolved(spark, tmp_path):
    from rxweave.queries import queries

    names = [("Hybrafituxate", ["Ecosprin"]), ("ticliopecodríne", None)]
    spark.createDataFrame([(k, n, b, "c") for k, (n, b) in enumerate(names)], "drug_id int, drug_name string, brand_names array<string>, drug_class string").write.parquet(str(tmp_path / "drug_reference.parquet"))
    drugs = ["\tHybrafituxate", "Hybrafituxate\u00a020\u00a0mg", "ecosprin\u00a0tablets", "Ticliopecodríne 5mg", "éhybrafituxate", "hybra\u00adfituxate", "hybrafituxate 500mgBD", None]
    spark.createDataFrame([(drugs,)], "drugs array<string>").write.parquet(str(tmp_path / "keyword_smoke10.parquet"))
    want = [("\tHybrafituxate", "hybrafituxate", "raw"), ("Hybrafituxate\u00a020\u00a0mg", "hybrafituxate", "cleaned"), ("ecosprin\u00a0tablets", "hybrafituxate", "cleaned"), ("Ticliopecodríne 5mg", "ticliopecodríne", "cleaned")]
    want += [("éhybrafituxate", "éhybrafituxate", "itself"), ("hybra\u00adfituxate", "hybra\u00adfituxate", "itself"), ("hybrafituxate 500mgBD", "hybrafituxate", "cleaned")]
    assert rows(queries()["synonym_resolve_whole"](spark, str(tmp_path)).select("mention", "name", "step")) == sorted(want, key=repr)


def test_within_edits_finds_what_brute_force_finds(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
        return row[-1]

    want = sorted((a, b, distance(a, b)) for a, b in itertools.product(words[:30], words[30:]) if distance(a, b) <= 2)
    left = spark.createDataFrame([(w,) for w in words[:30]], "word string")
    right = spark.createDataFrame([(w,) for w in words[30:]], "name string")
    assert rows(X.within_edits(left, right)) == want


def test_block_loses_no_indel_match(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abcdefg") for _ in range(rng.randrange(8, 15))) for _ in range(40)})
    edited = set()
    for n in names:
        for _ in range(4):
            s = list(n)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(s))
                s[i : i + 1] = rng.choice([[], [rng.choice("abcdefg")], [s[i], rng.choice("abcdefg")]])
            if len(s) >= 8:
                edited.add("".join(s))
    want = {(a, b) for a in edited for b in names if similarity._indel(a, b) >= 85}
    got = {(r.l, r.r) for r in X.blocked(spark.createDataFrame([(x,) for x in edited], "l string"), spark.createDataFrame([(x,) for x in names], "r string"), 0.85).collect()}
    assert want <= got


def test_weighted_block_loses_no_match_of_mixed_lengths(spark):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))) for _ in range(50)} | {"salmon calcitonin", "vitamin d", "a b", ""})
    entries = {"sesokavir tablets", "calcitonin salmon", "calcitonin\u00a0salmon", "d vitamin forte", "b a", "salmon  salmon calcitonin", "", " "}
    for n in names:
        for _ in range(6):
            s = list(n)
            for _ in range(rng.randrange(0, 3)):
                i = rng.randrange(len(s) + 1)
                s[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice("abcdefgh")]])
            entries.add(rng.choice(["", "cap. ", "tab ", "inj.", "x "]) + "".join(s) + rng.choice(["", "50mg", " tablets", " 500 mg bd", " x"]))
    want = {(a, b) for a in entries for b in [*names, "sesokavir"] if similarity.weighted_ratio(a, b) >= 75}
    assert ("sesokavir tablets", "sesokavir") in want and len({(len(a) >= 1.5 * len(b), len(b) < 8) for a, b in want}) == 4
    got = X.blocked_weighted(spark.createDataFrame([(x,) for x in entries], "l string"), spark.createDataFrame([(x,) for x in [*names, "sesokavir"]], "r string")).collect()
    assert want <= {(r.l, r.r) for r in got} and len(got) == len(set(got)) < len(entries) * len(names) / 2


def test_resembling(spark):
    names = spark.createDataFrame([(1, "warfarin"), (1, "aspirin"), (2, "aspirin"), (2, None), (None, "warfarin")], "k int, name string")
    words = spark.createDataFrame([(1, "warfarn"), (1, "x"), (1, "aspergillus"), (2, "aspirin"), (2, "aspirin"), (None, "warfarin"), (2, None)], "k int, word string")
    assert rows(X.resembling(names, words, "k", 85.0)) == [(1, "warfarin"), (2, "aspirin")]
    assert X.resembling(names.limit(0), words, "k", 85.0).count() == 0


def test_segments(spark):
    words = spark.createDataFrame([("dolocrocin",), ("phenobarbital",), ("aaabbbccc",), ("short",), (None,)], "word string")
    names = spark.createDataFrame([(n,) for n in ("dolo", "crocin", "phe", "no", "barbital", "phenobarbital", "aaa", "bbb", "ccc")], "name string")
    assert rows(X.segment(words, names)) == [("aaabbbccc", ["aaa", "bbb", "ccc"]), ("dolocrocin", ["dolo", "crocin"])]


def test_top_cosine_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(k, v[k].tolist()) for k in range(60)] + [(99, None)], "id int, vec array<double>")
    got = {}
    for r in X.top_cosine(df.where("id % 20 = 0").withColumnRenamed("id", "q"), df, 3, block=2).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        assert [i for _, i in sorted(got[q])] == np.argsort(-(u @ u[q]))[:3].tolist()


def test_fusion_of_equal_scores_is_zero(spark):
    df = spark.createDataFrame([("q", "a", 0.5, None), ("q", "b", 0.5, 1.0)], "q string, concept string, dense double, sparse double")
    assert rows(X.fuse(df, {"dense": 0.6, "sparse": 0.4})) == [("q", "a", 0.0), ("q", "b", 0.4)]


def test_folds_and_splits(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b", "x") for k in range(90)], "id int, label string, fold_extra string")
    counts = Q.folds(df, "id", "label", 5, 1).groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in counts} == {("a", 12), ("b", 6)}
    parts = {r.part: r["count"] for r in Q.seeded_split(df, "id", 0.8, 4).groupBy("part").count().collect()}
    assert parts == {"train": 72, "val": 18}
    chunks = {r.chunk: r["count"] for r in Q.chunked(df, "id", 4).groupBy("chunk").count().collect()}
    assert chunks == {0: 22, 1: 22, 2: 22, 3: 24}


def test_usage(spark):
    calls = spark.createDataFrame([("a", False, 1_000_000, 0, 0, 2.0), ("a", True, 5, 5, 5, 9.0), ("b", True, 1, 1, 1, 1.0)], "context string, error boolean, input_tokens int, output_tokens int, thinking_tokens int, latency double")
    got = {r.context: (r.calls, r.errors, r.avg_latency, r.cost) for r in Q.usage(calls, 0.3, 2.5).collect()}
    assert got == {"a": (1, 1, 2.0, 0.3), "b": (0, 1, 0.0, 0.0), "total": (1, 2, 2.0, 0.3)}


def test_spearman_against_numpy(spark):
    rng = random.Random(8)
    data = [(rng.randrange(5), rng.random()) for _ in range(80)]
    rank = lambda v: np.array([sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v])
    want = np.corrcoef(rank([a for a, _ in data]), rank([b for _, b in data]))[0, 1]
    got = {(r.a, r.b): r.r for r in Q.spearman(spark.createDataFrame(data, "x int, y double"), ["x", "y"]).collect()}
    assert got[("x", "y")] == pytest.approx(want)


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('a\tb\n1\t2\textra\nonly\n"q\t3\n')
    assert rows(R.read_ragged_tsv(spark, str(tmp_path / "m.tsv"))) == [('"q', "3"), ("1", "2")]
    (tmp_path / "m.csv").write_text('name,note\nx,"two\nlines ""quoted"""\n,none\n')
    assert rows(R.read_csv(spark, str(tmp_path / "m.csv"), "name")) == [("x", 'two\nlines "quoted"')]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(R.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int")) == [(1,), (2,)]
    for k in (1, 2):
        (tmp_path / f"chunk_{k}_labeled.json").write_text('{"id": 1, "label": "l%d"}\n{"id": 1%d, "label": "x"}\n' % (k, k))
    assert rows(R.read_chunks_last_wins(spark, f"{tmp_path}/chunk_*_labeled.json", "id int, label string", "id")) == [(1, "l2"), (11, "x"), (12, "x")]
    (tmp_path / "kb.json").write_text('[{"name": "A", "id": ["1", "2"], "interactions": [{"name": "B", "description": "d", "id": "9"}]}, {"name": "C", "id": "3", "interactions": []}]')
    assert rows(R.read_knowledge_base(spark, str(tmp_path / "kb.json"))) == [("A", "1", "B", "9", "d", 0), ("A", "2", "B", "9", "d", 0)]
    assert R.read_knowledge_base(spark, str(tmp_path / "missing.json")).count() == 0


def test_content_hash_knows_content_not_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    digest = lambda x: R.content_hash(x, ["k", "v"]).first().digest
    assert digest(df) == digest(df.orderBy(F.desc("k"))) != digest(df.unionAll(df))
    assert len(digest(df.limit(0))) == 16
