import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from compare import assert_same, connect  # noqa: E402

from rxweave.llm.queries import oracle_sql, queries  # noqa: E402

COLUMNS = {"p1_found": ["text_id_a", "text_id_b"], "p2_found": ["id", "severity"], "p3_found": ["drug_a", "drug_b"], "p4_found": ["prescription_id", "entered", "drug_id"], "p5_found": ["text_id_a", "text_id_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert_same(spark, connect(data), data, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs_with_its_columns(spark, data, name):
    df = queries()[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = [tuple(map(repr, r)) for r in df.collect()]
    assert len(got) == len(set(got))


def test_tree_and_whole_texts_have_the_same_lengths(spark, data):
    whole = {r.doc_id: len(r.ids) for r in queries()["p6_ids"](spark, data).collect()}
    assert {r.doc_id: r.tokens for r in queries()["p6_lengths"](spark, data).collect()} == whole
