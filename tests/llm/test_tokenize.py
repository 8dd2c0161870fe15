import random

import pytest

pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from rxweave.llm import tokenize as T  # noqa: E402

FILE = T.tokenizer_file()
PARTS = st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'r", "e", "'l", "l", "1", "23", ".", "!!", "é", "क", "ी", "💊", " ", "\x1c", "don't", "x" * 30, "'", "'v", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=1, max_size=6))
def test_joined_leaves_are_the_whole(parts):
    enc = T.encoder(*FILE)
    nodes = [T.leaf(enc, p) for p in parts]
    while len(nodes) > 1:
        nodes = [T.join(enc, *nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    assert nodes[0].ids == enc.encode("".join(parts))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "-=_", "éक"])
def test_texts_without_any_boundary_join_by_merges(alphabet, monkeypatch):
    monkeypatch.setattr(T, "GIANT", 8)
    enc, rng = T.encoder(*FILE), random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 300)))
        cut = rng.randrange(1, len(text))
        assert T.join(enc, T.leaf(enc, text[:cut]), T.leaf(enc, text[cut:])).ids == enc.encode(text)


def test_corpus(spark):
    enc, rng = T.encoder(*FILE), random.Random(4)
    long = "".join(rng.choice(["word ", "Zahl 12 ", "\n\n", "x", "é ", "<|endoftext|>"]) for _ in range(900))
    rows = [(1, "Hello  world\n"), (2, ""), (3, None), (4, long), (5, long), (6, "y" * 5000), (4, long), (7, "<|endoftext|>"), (None, "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in T.encode_corpus(df, *FILE, leaf_chars=100).collect()), key=repr)
    want = sorted(((i, enc.encode(t) if t else []) for i, t in rows), key=repr)
    assert got == want
    assert T.encode_corpus(df.limit(0), *FILE).count() == 0
