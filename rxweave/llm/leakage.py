"""Evaluation passages in training text: a generalised suffix automaton over words, streamed along every document."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialised

WORD = re.compile(r"[^\W_]+")
#: Words of items in one automaton: about a hundred bytes each in the driver and in every Python worker.
BLOCK_WORDS = 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """Words with their places in the original text; a sign that lower-cases to several words gives them one place."""
    return [(w, m.start(), m.end()) for m in WORD.finditer(text) for w in WORD.findall(m.group().lower())]


class Automaton:
    """All runs of words of all items; every state knows the items that contain its runs."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        runs = []
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if len(ids) >= least:
                runs.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        owners: list[set[int]] = [set() for _ in self.len]
        for item, ids in runs:
            state = 0
            for w in ids:
                state = self.next[state][w]
                up = state
                while up > 0 and item not in owners[up]:
                    owners[up].add(item)
                    up = self.link[up]
        self._pack(owners)

    def _pack(self, owners: list[set[int]]) -> None:
        """Flat arrays in place of a dictionary and a set per state: most states have one way on, and share their items."""
        self.only = array("i", (next(iter(m)) if len(m) == 1 else -1 for m in self.next))
        self.to = array("i", (next(iter(m.values())) if len(m) == 1 else -1 for m in self.next))
        self.ways = {state: m for state, m in enumerate(self.next) if len(m) > 1}
        self.link, self.len = array("i", self.link), array("i", self.len)
        groups: dict[tuple[int, ...], int] = {(): 0}
        self.group = array("i", (groups.setdefault(tuple(sorted(o)) if n >= self.least else (), len(groups)) for o, n in zip(owners, self.len)))
        self.groups = list(groups)
        del self.next

    def move(self, state: int, w: int) -> int:
        """The state that the word leads to, -1 if there is none."""
        if self.only[state] == w:
            return self.to[state]
        ways = self.ways.get(state)
        return -1 if ways is None else ways.get(w, -1)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the run is known from another item
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return state

    def matches(self, words: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Per item the longest run in common, if it has ``least`` words; and the spans of words covered by such runs."""
        found: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        number, move, link, lens, least = self.number, self.move, self.link, self.len, self.least
        state = length = 0
        for at, word in enumerate(words):
            w = number.get(word)
            if w is None:
                state = length = 0
                continue
            to = move(state, w)
            while to < 0 and state:
                state = link[state]
                length = lens[state]
                to = move(state, w)
            if to < 0:
                length = 0
                continue
            state = to
            length += 1
            if length >= least:
                up, run = state, length
                while up > 0 and lens[up] >= least:
                    run = min(run, lens[up])
                    for item in self.groups[self.group[up]]:
                        if found.get(item, 0) < run:
                            found[item] = run
                    up = link[up]
                start = at + 1 - length
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], start), at + 1)
                else:
                    spans.append((start, at + 1))
        return found, spans


def _automata(items: DataFrame, least: int, block_words: int) -> list[Automaton]:
    """One automaton for every ``block_words`` words of items, so that no broadcast grows with the test material."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    blocks, block, size = [], [], 0
    for row in rows.toLocalIterator():
        block.append((row.item_id, row.text))
        size += row.text.count(" ") + 1
        if size >= block_words:
            blocks.append(Automaton(block, least))
            block, size = [], 0
    return blocks + ([Automaton(block, least)] if block else [])


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for batch in batches:
            at, items, runs = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for item, length in automaton.matches(words_of(text))[0].items():
                    at.append(k)
                    items.append(item)
                    runs.append(length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, pa.int64()), pa.array(runs, pa.int32())], names=["doc_id", "item_id", "longest"]
            )

    return run


def leaked_items(docs: DataFrame, items: DataFrame, least: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, longest``: the documents that share a run of at least ``least`` words with an item.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``; extra columns are ignored. Words are lower-cased runs of
    letters and digits; whatever stands between them is disregarded. ``longest`` is the longest shared run.

    Null and empty texts on either side, items shorter than ``least`` words, and null item ids give nothing. Repeated
    documents, or items, count once. Very long texts are streamed whole. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("text is not null")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id bigint, longest int"
    out = spark.createDataFrame([], schema)
    for automaton in _automata(items, least, block_words):
        out = out.unionByName(texts.mapInArrow(_found(spark.sparkContext.broadcast(automaton)), schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def strip_spans(text: str, placed: list[tuple[str, int, int]], spans: list[tuple[int, int]], most_coverage: float) -> tuple[str, float, int, str | None]:
    """What to do with a text, the share of its words that leaked, the number of spans, and the text without them."""
    covered = sum(b - a for a, b in spans)
    coverage = covered / len(placed) if placed else 0.0
    if not spans:
        return "keep", 0.0, 0, text
    if coverage > most_coverage:
        return "drop", coverage, len(spans), None
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : placed[a][1]])
        at = placed[b - 1][2]
    return "strip", coverage, len(spans), "".join(kept) + text[at:]


def _spans(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for batch in batches:
            found = [automaton.matches(words_of(t))[1] for t in batch.column("text").to_pylist()]
            at = [k for k, spans in enumerate(found) for _ in spans]
            ends = [pa.array([s[side] for spans in found for s in spans], pa.int32()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), *ends], names=["row", "a", "b"])

    return run


def _cut(most_coverage: float, shared=None):
    """Documents without their spans: those of ``shared``'s automaton, or else those in the columns ``a`` and ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            texts = batch.column("text").to_pylist()
            given = [None] * len(texts) if shared else batch.column("spans").to_pylist()
            for text, spans in zip(texts, given):
                placed = [] if text is None else placed_words(text)
                spans = shared.value.matches([w for w, _, _ in placed])[1] if shared else [(s["a"], s["b"]) for s in spans or ()]
                made.append(strip_spans(text, placed, merged(spans), most_coverage))
            types = (pa.string(), pa.float64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([m[k] for m in made], t) for k, t in enumerate(types))], names=["doc_id", "action", "coverage", "spans", "text"]
            )

    return run


def decontaminate(docs: DataFrame, items: DataFrame, least: int = 10, most_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, action, coverage, spans, text`` for every document.

    Spans of at least ``least`` words in common with an item are cut out (``strip``); a document with more than
    ``most_coverage`` of its words in such spans is given up (``drop``, text null); all others stay (``keep``).
    Null texts are kept. Items beyond ``block_words`` words make several automata: the documents are streamed along each,
    and the spans of all are put together before anything is cut.
    """
    automata = _automata(items, least, block_words) or [Automaton([], least)]
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, action string, coverage double, spans int, text string"
    if len(automata) == 1:
        return docs.select("doc_id", "text").mapInArrow(_cut(most_coverage, spark.sparkContext.broadcast(automata[0])), schema)
    rows = materialised(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    found = None
    for automaton in automata:
        part = rows.where("text is not null").select("row", "text").mapInArrow(_spans(spark.sparkContext.broadcast(automaton)), "row bigint, a int, b int")
        found = part if found is None else found.unionByName(part)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(_cut(most_coverage), schema)
