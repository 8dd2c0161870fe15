"""Encoding a corpus with a public byte-level BPE tokenizer; long texts by tree concatenation.

Short texts are encoded whole. A long text is cut into leaves, which are encoded in parallel on any executor; then
neighbours are joined, level by level, until one node is left. A join re-encodes a window around the seam that grows
until both sides agree exactly:

* Left of the seam it starts at a boundary of the splitting pattern with at least three pieces behind it. What follows
  a text can change its last two pieces at most (a contraction in the making, a run of white space), never an earlier
  boundary.
* To the right it reaches the first boundary that the scan across the seam has in common with the right side's own
  scan. The pattern looks at nothing before its position, so from there on both scans are one.
* A piece without any boundary that runs across the seam is joined on the level of merges: a few tokens on either side
  are merged anew, and the window grows until the tokens at both its ends are compatible with their neighbours, that
  is, until each such pair, encoded alone, gives itself. A sequence of tokens is the encoding of its text exactly when
  all neighbours are compatible.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialised

#: Pieces of a text whose boundaries the following text may still change.
UNSETTLED = 3
#: Characters from which a piece across a seam is joined by merges instead of being encoded again.
GIANT = 2048


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the tokenizer's \s is Unicode White_Space; Python's takes four control signs more
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of one piece."""
        return self.bpe._encode_single_piece(raw) if raw else []

    def raw(self, ids: list[int]) -> bytes:
        return self.bpe.decode_bytes(ids)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@dataclass
class Node:
    text: str
    ids: list[int]
    tail: int  # characters from a settled boundary to the end; the whole text if there is none


def settled_tail(pieces: list[str]) -> int:
    if len(pieces) <= UNSETTLED:
        return sum(map(len, pieces))
    return sum(map(len, pieces[-UNSETTLED:]))


def leaf(enc: Encoder, text: str) -> Node:
    return Node(text, enc.encode(text), settled_tail(enc.pieces(text)))


def join_merged(enc: Encoder, left: list[int], right: list[int]) -> list[int]:
    """The tokens of one piece whose two parts have the tokens ``left`` and ``right``."""
    k = 4
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        middle = enc.merge(enc.raw(left[a:] + right[:b]))
        fits = not a or enc.merge(enc.raw([left[a - 1], middle[0]])) == [left[a - 1], middle[0]]
        if fits and b < len(right):
            fits = enc.merge(enc.raw([middle[-1], right[b]])) == [middle[-1], right[b]]
        if fits:
            return left[:a] + middle + right[b:]
        k *= 2


def _tokens_of(enc: Encoder, ids: list[int], size: int) -> int | None:
    """How many of the first ``ids`` make ``size`` bytes; none if no token ends there."""
    ends = np.cumsum(enc.length[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)
    if not size:
        return 0
    at = int(np.searchsorted(ends, size))
    return at + 1 if at < len(ends) and ends[at] == size else None


def join(enc: Encoder, left: Node, right: Node) -> Node:
    """The node of both texts, one after the other."""
    if not left.text or not right.text:
        return right if not left.text else left
    head = left.text[len(left.text) - left.tail :]
    width = 64
    while True:
        window, whole = right.text[:width], width >= len(right.text)
        across, own = enc.pieces(head + window), enc.pieces(window)
        ends = np.cumsum([len(p) for p in across]) - len(head)
        own_ends = np.concatenate([[0], np.cumsum([len(p) for p in own])])
        if not whole:
            ends, own_ends = ends[:-UNSETTLED], own_ends[:-UNSETTLED]
        common = np.intersect1d(ends, own_ends)
        if len(common):
            break
        width *= 4
    end = int(common[0])
    region = across[: int(np.searchsorted(ends, end)) + 1]
    start = -len(head)
    kept = _tokens_of(enc, left.ids[::-1], len(head.encode()))
    rest = _tokens_of(enc, right.ids, len(right.text[:end].encode()))
    assert kept is not None and rest is not None  # both are boundaries of pieces, so tokens end there
    ids = left.ids[: len(left.ids) - kept]
    for piece in region:
        stop = start + len(piece)
        made = None
        if start < 0 < stop and len(piece) > GIANT:
            own_left = _tokens_of(enc, left.ids[::-1], len(piece[:-start].encode()))
            own_right = _tokens_of(enc, right.ids, len(piece[-start:].encode()))
            one_each = enc.pieces(piece[:-start]) == [piece[:-start]] and enc.pieces(piece[-start:]) == [piece[-start:]]
            if own_left and own_right and one_each:
                made = join_merged(enc, left.ids[len(left.ids) - own_left :], right.ids[:own_right])
        ids += enc.merge(piece.encode()) if made is None else made
        start = stop
    ids += right.ids[rest:]
    if right.tail < len(right.text) and len(right.text) - right.tail >= end:
        tail = right.tail
    else:
        tail = settled_tail(region + enc.pieces(right.text[end:]))
    return Node(left.text + right.text, ids, tail)


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids = [enc.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _leaves(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            made = [leaf(enc, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("at"), batch.column("text"), pa.array([n.ids for n in made], pa.list_(pa.int32())), pa.array([n.tail for n in made], pa.int32())],
                names=["digest", "at", "text", "ids", "tail"],
            )

    return run


def _joined(path: str, pattern: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        nodes = [Node(r.text, list(r.ids), int(r.tail)) for r in pdf.itertuples()]
        node = nodes[0] if len(nodes) == 1 else join(encoder(path, pattern), *nodes)
        return pd.DataFrame({"digest": [pdf["digest"].iloc[0]], "at": [int(pdf["at"].iloc[0]) // 2], "text": [node.text], "ids": [np.asarray(node.ids, np.int32)], "tail": [node.tail]})

    return run


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> tuple[str, str]:
    """Path and splitting pattern of a vocabulary; ``path`` overrides the installed package's file."""
    import public_tokenizers

    return path or public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_corpus(docs: DataFrame, path: str, pattern: str, leaf_chars: int = 8192) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs`` (``doc_id, text``; extra columns are ignored), without special tokens.

    A null and an empty text both give an empty list; nothing is trimmed or normalised, and strings that look like
    special tokens are ordinary text. Texts longer than ``leaf_chars`` characters are encoded by tree concatenation,
    equal ones once. Repeated rows stay repeated; a null doc_id is kept. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    id_type = dict(docs.dtypes)["doc_id"]
    short = docs.where(~long).mapInArrow(_encoded(path, pattern), f"doc_id {id_type}, ids array<int>")
    hashed = docs.where(long).withColumn("digest", F.sha2("text", 256))
    most = hashed.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return short
    schema = "digest string, at int, text string, ids array<int>, tail int"
    nodes = (
        hashed.groupBy("digest")
        .agg(F.first("text").alias("text"))
        .select("digest", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / leaf_chars).cast("int"))).alias("at"))
        .select("digest", "at", F.substring(F.col("text"), F.col("at") * leaf_chars + 1, F.lit(leaf_chars)).alias("text"))
        .repartition("digest", "at")
        .mapInArrow(_leaves(path, pattern), schema)
    )
    leaves = -(-most // leaf_chars)
    while leaves > 1:
        nodes = nodes.groupBy("digest", F.floor(F.col("at") / 2)).applyInPandas(_joined(path, pattern), schema)
        leaves = -(-leaves // 2)
    whole = materialised(nodes.select("digest", "ids"))
    return short.unionByName(hashed.select("doc_id", "digest").join(whole, "digest").select("doc_id", "ids"))
