from pyspark.sql import functions as F

from rxweave.functions import vectors as V
from rxweave.operators import pairs as P
from rxweave.plans import pipeline as L
from rxweave.sources import sinks
from rxweave.sources.config import Settings


def knowledge(spark):
    names = spark.createDataFrame([("warfarin",), ("aspirin",), ("amoxicillin",)], "name string")
    synonyms = spark.createDataFrame([("ecosprin", ["aspirin"]), ("combo", ["aspirin", "warfarin"])], "alias string, concepts array<string>")
    edges = spark.createDataFrame([("Warfarin", "W", "Aspirin", "A", "severe bleeding is major", 1)], "source string, source_id string, target string, target_id string, description string, pos int")
    return L.Knowledge(names, synonyms, P.flatten_index(edges))


def test_reports(spark):
    texts = [(1, "Ecosprin75mg OD and Warfarin 5 mg"), (2, "combo tablet"), (3, "warfarn 5mg daily"), (4, "nothing here"), (5, None), (6, ""), (7, "aspirin, Aspirin")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "rx_id int, text string, name string")
    got = {r.rx_id: r for r in L.analyze(df, knowledge(spark)).collect()}
    assert {k: sorted(r.medicines) for k, r in got.items()} == {1: ["aspirin", "warfarin"], 2: ["aspirin", "warfarin"], 3: ["warfarin"], 4: [], 5: [], 6: [], 7: ["aspirin"]}
    assert got[1].max_severity == "Severe" and got[1].has_severe and got[1].n_interactions == 1
    assert got[3].confidence == 0.92 and got[3].max_severity == "No Interaction" and not got[3].needs_review
    assert got[4].needs_review and got[4].confidence == 0 and got[5].risk == 0.05
    assert L.analyze(df.limit(0), knowledge(spark)).count() == 0


def test_second_opinion_only_raises(spark):
    df = spark.createDataFrame([(1, "aspirin warfarin")], "rx_id int, text string")
    assert L.analyze(df, knowledge(spark), F.lit("Mild")).first().max_severity == "Severe"


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("aspirin",), ("Aspirin",), ("warfarin",), ("",), (None,)], "t string").select(V.hashed_trigrams(F.col("t")).alias("v"))
    a, b, c, empty, null = [r.v for r in df.collect()]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert a == b and abs(dot(a, a) - 1) < 1e-9 and dot(a, c) < 0.9 and abs(dot(empty, empty) - 1) < 1e-9 and null is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}", ["n"]) for k in range(10)], "id int, text string, tags array<string>")
    sinks.write_chunks(df, str(tmp_path / "chunks"), "id", 4, ["id", "text"])
    counts = {r.chunk: r["count"] for r in spark.read.json(str(tmp_path / "chunks")).groupBy("chunk").count().collect()}
    assert counts == {0: 2, 1: 2, 2: 2, 3: 4}
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "text"]
    assert sinks.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json == '{"a":1,"b":null}'


def test_resume(spark, tmp_path):
    path, schema = str(tmp_path / "results"), "id int, out string, errors int"
    work = spark.range(6).select(F.col("id").cast("int").alias("id"))
    once = lambda todo: todo.select("id", F.lit("a").alias("out"), (F.col("id") % 3 == 0).cast("int").alias("errors"))
    again = lambda todo: todo.select("id", F.lit("b").alias("out"), F.lit(0).alias("errors"))
    assert sinks.append_pending(work, once, path, schema, ["id"]) == 6
    assert sinks.append_pending(work, again, path, schema, ["id"]) == 2
    assert sinks.append_pending(work, again, path, schema, ["id"]) == 0
    got = {r.id: r.out for r in sinks.latest(spark.read.parquet(path), ["id"]).collect()}
    assert got == {0: "b", 1: "a", 2: "a", 3: "b", 4: "a", 5: "a"}


def test_settings(tmp_path, monkeypatch):
    assert Settings().get("confidence.low") == 0.7 and Settings("missing.yaml").get("a.b", 3) == 3
    (tmp_path / "c.yaml").write_text("severity:\n  gate: none\nextra: [1]\n")
    s = Settings(str(tmp_path / "c.yaml"))
    assert s.gate() == "none" and s.get("extra") == [1] and s.get("extraction.most_candidates") == 600
    monkeypatch.setenv("SEVERITY_GATE", "odd")
    assert s.gate() == "regex"
