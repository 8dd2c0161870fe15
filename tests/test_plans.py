"""The shape of physical plans: pruning, pushed filters, joins without nested loops, limits before the shuffle."""

from rxweave.plans.session import ensure_checkpoint_dir
from rxweave.queries import queries

Q = queries()


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_read_only_what_is_used(spark, data):
    text = plan(Q["annotator_conflicts"](spark, data))
    schema = text.rpartition("ReadSchema:")[2]
    assert "agentA" in schema and "labelled_at" not in schema and "text" not in schema


def test_filters_reach_the_scan(spark, data):
    assert "EqualTo(event_type,error)" in plan(Q["error_counter"](spark, data))


def test_pairs_and_lookups_are_equi_joins(spark, data):
    for name in ("pair_enumeration", "kb_lookup_bidirectional", "edit_distance_correct", "grounding_semi", "wratio_match"):
        text = plan(Q[name](spark, data))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name


def test_top_k_is_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(Q["cosine_topk"](spark, data))


def test_checkpoint_folder_is_set(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_intermediate_tables_are_removed(spark):
    import os

    from rxweave.plans import session

    one, two = session.materialised(spark.range(5)), session.materialised(spark.range(7))
    paths = [df._written_to for df in (one, two)]
    session.discard(one)
    assert not os.path.exists(paths[0]) and two.count() == 7
    session.discard(spark.range(3))
    session.release()
    assert not os.path.exists(paths[1])
