"""Byte-level BPE as a streaming transducer (problem 6).

A text is split into pieces by the vocabulary's own pattern, in chunks cut where a
piece is sure to end.  Within a piece the transducer keeps, for each prefix, the last
token of that prefix's encoding: it is the one token ending there that forms a valid
pair with the last token before it.  A token is *stable* once the chains of every prefix
that a longer input can still build on, those of the last ``longest - 1`` bytes, meet
behind it; then it is emitted and its bytes are forgotten, so memory does not grow with
the piece.  ``sufficient_lookahead`` bounds from the merge list how many bytes that
takes.  Decoding carries only the at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
import re
from pyspark.sql import DataFrame

from treemill.plans.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids are remembered in a worker, at most; only speed depends on it.
CACHED_PIECES = 300_000
CHUNK = 1 << 16
#: Rank of a merge that the list lacks.
NEVER = 1 << 60

# fixed values: white space of Unicode, and the pattern of pieces of the vocabulary
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ASCII_PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+")
_BREAK = regex.compile(rf"(?<=[^{_SPACE}])[{_SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a ``.tiktoken`` file or the ``vocab`` of a ``.json`` one."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back = {c: b for b, c in _byte_alphabet().items()}
        return {bytes(back[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in back for c in token)}
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies in JSON."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Transducer:
    """Encoder and decoder of one vocabulary; holds nothing of the texts but a bounded cache."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._edges: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self._prefixes: dict[bytes | None, int] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._lookahead: int | None = None

    # -- merge list ---------------------------------------------------------------
    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of a short string by the definition: the lowest-ranked adjacent pair merges first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @property
    def sufficient_lookahead(self) -> int:
        """Bytes after which no merge to the right can change a token any more.

        A merge (u, v) can disturb the merge (s, t) on its left only if it comes earlier
        and t is u or uv.  The longest chain of such merges, each weighted with the bytes
        it adds, ends the reach of the right context; one token more covers its last link.
        """
        if self._lookahead is None:
            reach: dict[bytes, int] = {}
            most = 1
            for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
                if len(token) < 2:
                    continue
                halves = self._halves(token)
                if halves is None:
                    continue
                left, right = halves
                weight = len(left) + max(len(right), reach.get(right, 0))
                for key in (left, token):
                    reach[key] = max(reach.get(key, 0), weight)
                most = max(most, weight)
            self._lookahead = most + self.longest
        return self._lookahead

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        own, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= own:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    # -- encoding -----------------------------------------------------------------
    def _fits(self, before: bytes | None, token: bytes) -> bool:
        """Whether ``token`` stays whole, and stays apart from ``before``, when merged together."""
        if before is None:
            known = self._whole.get(token)
            if known is None:
                known = self._whole[token] = len(self.merged(token)) == 1
            return known
        known = self._pairs.get((before, token))
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[before, token] = self._fits(None, token) and self._apart(before, token)
        return known

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """Subtokens at one edge of a token, from its byte up, each with the rank that absorbs it."""
        key = (token, right)
        known = self._edges.get(key)
        if known is None:
            halves = self._halves(token) if len(token) > 1 else None
            if halves is None:
                known = [(token, NEVER)]
            else:
                inner = self._edge(halves[right], right)
                known = [*inner[:-1], (inner[-1][0], self.ranks[token]), (token, NEVER)]
            self._edges[key] = known
        return known

    def _apart(self, before: bytes, token: bytes) -> bool:
        """Whether no merge ever joins the two: at each moment the pair at the border must come later than what absorbs either side."""
        ranks, left, right = self.ranks, self._edge(before, True), self._edge(token, False)
        i = j = 0
        while True:
            (a, end_a), (b, end_b) = left[i], right[j]
            rank = ranks.get(a + b, NEVER)
            if rank < end_a and rank <= end_b and rank != NEVER:
                return False
            if end_a == NEVER and end_b == NEVER:
                return True
            if end_a <= end_b:
                i += 1
            else:
                j += 1

    def _last_size(self, data: bytes, start: int, end: int, last: list[int], before: bytes | None) -> int:
        """Length of the last token of the encoding of ``data[:end]``; 0 inside a character no token ends in."""
        ranks = self.ranks
        for size in range(1, min(self.longest, end - start) + 1):
            token = data[end - size : end]
            if token in ranks:
                at = end - size - start
                if at == 0:
                    if self._fits(before, token):
                        return size
                elif last[at - 1] and self._fits(data[end - size - last[at - 1] : end - size], token):
                    return size
        return 0

    def piece_tokens(self, data: bytes) -> Iterator[int]:
        """Ids of one piece, each emitted once stable."""
        ranks, longest = self.ranks, self.longest
        if data in ranks and self._fits(None, data):
            yield ranks[data]
            return
        start = 0  # where the tokens not yet emitted begin
        before: bytes | None = None  # the last emitted token
        last: list[int] = []  # length of the last token of each prefix from start
        if len(self._prefixes) > 2 * CACHED_PIECES:
            self._prefixes.clear()
        hold = max(self.sufficient_lookahead if len(data) > 4096 else 4096, 2 * longest)
        for end in range(1, len(data) + 1):
            head = data[:end] if end <= 24 else None
            size = self._prefixes.get(head)
            if size is None:
                size = self._last_size(data, start, end, last, before)
                if head is not None:
                    self._prefixes[head] = size
            last.append(size)
            if end - start > hold and end < len(data):
                stable = self._meeting(last, longest)
                for token in self._chain(data, start, last, stable):
                    before = token
                    yield ranks[token]
                start, last = start + stable, last[stable:]
        for token in self._chain(data, start, last, len(last)):
            yield ranks[token]

    @staticmethod
    def _meeting(last: list[int], longest: int) -> int:
        """Where the chains of all prefixes that are still live meet."""
        live = {p for p in range(max(0, len(last) - longest + 1), len(last) + 1) if p == 0 or last[p - 1]}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - last[top - 1])
        return live.pop()

    @staticmethod
    def _chain(data: bytes, start: int, last: list[int], end: int) -> list[bytes]:
        out = []
        while end:
            out.append(data[start + end - last[end - 1] : start + end])
            end -= last[end - 1]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give an empty list, marks of special tokens are plain text."""
        out: list[int] = []
        if not text:
            return out
        known = self._pieces
        for chunk in _chunks(text):
            for piece in (_ASCII_PIECE if chunk.isascii() else _PIECE).findall(chunk):
                ids = known.get(piece)
                if ids is None:
                    ids = tuple(self.piece_tokens(piece.encode("utf-8", "surrogatepass")))
                    if len(piece) <= 64:
                        if len(known) >= CACHED_PIECES:
                            known.clear()
                        known[piece] = ids
                out += ids
        return out

    # -- decoding -----------------------------------------------------------------
    def decode_stream(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """Text of a stream of ids, a block at a time; between blocks only an unfinished character is kept."""
        carry, held = b"", []
        for number in ids:
            held.append(self.token[number])
            if len(held) == block:
                text, carry = utf8_step(carry, b"".join(held))
                held = []
                yield text
        text, carry = utf8_step(carry, b"".join(held))
        yield text
        if carry:
            yield carry.decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


def utf8_step(carry: bytes, data: bytes) -> tuple[str, bytes]:
    """One step of the byte-to-text machine: the finished characters, and the bytes of an unfinished one."""
    data = carry + data
    keep = 0
    for back in range(1, min(3, len(data)) + 1):
        byte = data[-back]
        if byte >= 0xC0:
            need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            keep = back if need > back else 0
            break
        if byte < 0x80:
            break
    done = data[: len(data) - keep]
    return done.decode("utf-8", "replace"), data[len(data) - keep :]


def _chunks(text: str) -> Iterator[str]:
    """Parts of about ``CHUNK`` characters, cut before white space that follows something else: there a piece ends."""
    start = 0
    while len(text) - start > CHUNK:
        cut = _BREAK.search(text, start + CHUNK)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


#: The last transducer of this worker, with the ranks it was built from.
_loaded: list[tuple[object, Transducer]] = []


def _transducer(shared) -> Transducer:
    ranks = shared.value
    if not _loaded or _loaded[0][0] is not ranks:
        _loaded[:] = [(ranks, Transducer(ranks))]
    return _loaded[0][1]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids`` for every row; a map without shuffle.

    Null and empty texts give an empty list, blank texts are encoded as they are, a
    null id stays null and repeated rows stay.  The vocabulary file is read on the
    driver and broadcast; its size does not depend on the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = _transducer(shared)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "ids": [transducer.encode(t) for t in batch["text"]]})

    rows = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    return rows.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def roundtrip(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Per row the number of ids and whether decoding them gives the text again (null counts as empty)."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = _transducer(shared)
        for batch in batches:
            ids = [transducer.encode(t) for t in batch["text"]]
            same = [transducer.decode(x) == (t or "") for x, t in zip(ids, batch["text"])]
            yield pd.DataFrame({"id": batch["id"], "n_ids": list(map(len, ids)), "restored": same})

    rows = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    return rows.mapInPandas(run, f"id {kind}, n_ids int, restored boolean").withColumnRenamed("id", id_col)
