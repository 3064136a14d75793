"""Held-out passages inside a corpus (problem 7).

A leak is a run of at least ``run`` consecutive words of an item that stands in the
document as consecutive words.  Each item's words are laid out in blocks of
``(run + 1) // 2`` words from its start; any run of that length holds a whole block, so
one Aho-Corasick automaton over the blocks, passed once over the normalised document,
meets every leak.  A hit is then grown to both sides word by word, and the word offsets
are mapped to characters of the original text.

Items of up to ``AUTOMATON_CHARS`` characters are one automaton on every executor.  More
items are dealt by the hashes of their blocks to parts, each with an automaton of its own
that a task builds; every document is still read once, and goes only to the parts whose
blocks its words may hold, by a bitmap of bounded size over all blocks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from treemill.llm.text import word_spans, words
from treemill.plans.session import spread

RUN = 13
#: Characters of item text up to which the items are one automaton, collected and broadcast; beyond, they are dealt to parts of about this size.
AUTOMATON_CHARS = 4_000_000
#: Bits of the bitmap over the blocks of dealt items: 16 a block, at most 16 MB.  A full bitmap sends documents to more parts, and loses none.
MOST_BITS = 1 << 27
#: Groups that the documents of one part are spread over.
SALTS = 16


def block_hash(found: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(found))


class LeakAutomaton:
    """Blocks of the items, and the items' words to grow a hit."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, part: int | None = None, parts: int = 1):
        self.run, self.block, self.part, self.parts = run, (run + 1) // 2, part, parts
        self.words: list[tuple[int, list[str]]] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            found = words(text)
            if len(found) < run:
                continue
            number = len(self.words)
            self.words.append((item_id, found))
            for at in range(0, len(found) - self.block + 1, self.block):
                if part is None or block_hash(found[at : at + self.block]) % parts == part:
                    places[" " + " ".join(found[at : at + self.block]) + " "].append((number, at))
        self.automaton = ahocorasick.Automaton() if places else None
        for block, where in places.items():
            self.automaton.add_word(block, (len(block), where))
        if places:
            self.automaton.make_automaton()

    def runs(self, found: list[str]) -> Iterator[tuple[int, int, int]]:
        """Item id, first word and end word of every maximal run in a document's words."""
        if self.automaton is None or len(found) < self.run:
            return
        line = " " + " ".join(found) + " "
        starts: list[int] = []
        grown: dict[tuple[int, int], int] = {}  # item and diagonal: end of the last run grown there
        for end, (size, where) in self.automaton.iter(line):
            if not starts:
                at = 1
                for word in found:
                    starts.append(at)
                    at += len(word) + 1
            first = bisect_right(starts, end - size + 2) - 1
            for number, offset in where:
                diagonal = (number, first - offset)
                if grown.get(diagonal, -1) > first:
                    continue
                item_id, own = self.words[number]
                low, high = first, first + self.block
                low_item, high_item = offset, offset + self.block
                while low and low_item and found[low - 1] == own[low_item - 1]:
                    low, low_item = low - 1, low_item - 1
                while high < len(found) and high_item < len(own) and found[high] == own[high_item]:
                    high, high_item = high + 1, high_item + 1
                grown[diagonal] = high
                if high - low >= self.run and self._owns(own, low_item):
                    yield item_id, low, high

    def _owns(self, own: list[str], low_item: int) -> bool:
        """Whether this part reports a run: the one with the run's first whole block does."""
        if self.part is None:
            return True
        first = -(-low_item // self.block) * self.block
        return block_hash(own[first : first + self.block]) % self.parts == self.part


#: The last automaton of this worker, with the items it was built from.
_built: list[tuple[object, int, LeakAutomaton]] = []


def _automaton(shared, run: int) -> LeakAutomaton:
    items = shared.value
    if not _built or _built[0][0] is not items or _built[0][1] != run:
        _built[:] = [(items, run, LeakAutomaton(items, run))]
    return _built[0][2]


def _hits(automaton: LeakAutomaton, doc, text: str | None, spans: bool) -> list[tuple]:
    """Rows of one document: its leaked items, or its leaked passages with their place in the original text."""
    hits = list(automaton.runs(words(text)))
    if not hits:
        return []
    if not spans:
        return [(doc, item) for item in dict.fromkeys(h[0] for h in hits)]
    place = word_spans(text)
    return [(doc, item, place[a][1], place[b - 1][2], b - a) for item, a, b in hits]


def find_leaks(
    docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN, spans: bool = False
) -> DataFrame:
    """Pairs of document and leaked item; with ``spans`` also where in the original text.

    Columns ``doc_id, item_id`` (distinct within a document row), or with ``spans``
    ``doc_id, item_id, start, end, n_words`` per maximal run.  Null and empty texts and
    items of fewer than ``run`` words leak nothing; repeated documents and items each
    count by themselves.  A map over the documents, unless the items are too many for
    one automaton; then documents that may hold a block are shuffled, once for each part
    that has one.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}" + (", start int, end int, n_words int" if spans else "")
    rows = spread(docs.select(docs[doc_id].alias("doc_id"), docs[text_col].alias("text")))
    held = items.select(items[item_id].alias("item_id"), items[item_text].alias("item_text")).filter("item_id is not null and item_text is not null")
    chars = held.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    if chars > AUTOMATON_CHARS:
        return _dealt_leaks(rows, held, kind, item_kind, schema, run, spans, -(-chars // AUTOMATON_CHARS))
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in held.collect()])  # at most AUTOMATON_CHARS characters

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared, run)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            found = [hit for doc, text in zip(batch["doc_id"], batch["text"]) for hit in _hits(automaton, doc, text, spans)]
            yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(scan, schema)


def _dealt_leaks(rows: DataFrame, held: DataFrame, kind: str, item_kind: str, schema: str, run: int, spans: bool, parts: int) -> DataFrame:
    """``find_leaks`` with the items dealt to ``parts`` by the hashes of their blocks."""
    block = (run + 1) // 2
    n_bits = min(MOST_BITS, max(1 << 16, 1 << (16 * parts * AUTOMATON_CHARS // 40).bit_length()))

    def blocks(text: str) -> Iterator[int]:
        found = words(text)
        if len(found) >= run:
            for at in range(0, len(found) - block + 1, block):
                yield block_hash(found[at : at + block])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(h % parts, key, text) for key, text in zip(batch["item_id"], batch["item_text"]) for h in {x % parts: x for x in blocks(text)}.values()]
            yield pd.DataFrame(out, columns=["part", "item_id", "item_text"])

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, int] = {}
        for batch in batches:
            for text in batch["item_text"]:
                for h in blocks(text):
                    bit = (h >> 8) % n_bits
                    have[bit // 32] = have.get(bit // 32, 0) | 1 << bit % 32
        yield pd.DataFrame({"word": list(have.keys()), "value": list(have.values())}, dtype="int64")

    filled = held.mapInPandas(bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()  # at most MOST_BITS / 32 rows
    bitmap = np.zeros(n_bits // 32, np.uint32)
    bitmap[filled["word"].to_numpy(np.int64)] = filled["value"].to_numpy(np.int64).astype(np.uint32)
    shared = held.sparkSession.sparkContext.broadcast(bitmap)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                found = words(text)
                wanted = set()
                for at in range(len(found) - block + 1 if len(found) >= run else 0):
                    h = block_hash(found[at : at + block])
                    bit = (h >> 8) % n_bits
                    if int(known[bit // 32]) >> bit % 32 & 1:
                        wanted.add(h % parts)
                out += [(part, int(row % SALTS), row, doc, text) for part in wanted]
            yield pd.DataFrame(out, columns=["part", "salt", "row", "doc_id", "text"])

    # the number of a row tells repeated documents apart
    sent = rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(send, f"part long, salt int, row long, doc_id {kind}, text string")
    dealt = held.mapInPandas(deal, f"part long, item_id {item_kind}, item_text string").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def scan(key: tuple, own_docs: pd.DataFrame, own_items: pd.DataFrame) -> pd.DataFrame:
        names = ["row", *(x.split()[0] for x in schema.split(", "))]
        if own_docs.empty or own_items.empty:
            return pd.DataFrame(columns=names)
        automaton = LeakAutomaton(list(zip(own_items["item_id"], own_items["item_text"])), run, int(key[0]), parts)
        found = [(row, *hit) for row, doc, text in zip(own_docs["row"], own_docs["doc_id"], own_docs["text"]) for hit in _hits(automaton, doc, text, spans)]
        return pd.DataFrame(found, columns=names)

    found = sent.groupBy("part", "salt").cogroup(dealt.groupBy("part", "salt")).applyInPandas(scan, f"row long, {schema}")
    # an item that leaks by runs of several parts is one pair; repeated items have rows of their own only where their ids differ
    return found.drop("row") if spans else found.dropDuplicates(["row", "doc_id", "item_id"]).drop("row")
