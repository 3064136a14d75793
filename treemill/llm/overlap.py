"""Same or near-same records across splits (problem 1).

Two texts overlap if, written as their words without gaps, at most one character per
``per`` characters of the longer one must be inserted, deleted or replaced.  Equal
strings are first put into one class, so copies cost nothing.  The classes are joined by
an exact prefix filter on rare shingles: characters' q-grams are put into one global
order, rarest first, and a string keeps the shortest beginning of its own list that no
allowed number of edits can destroy.  If two strings overlap, these beginnings share a
q-gram at places that differ by no more than the allowed edits, so indexing the held-out
side and probing with the training side, by q-gram and block of places, misses nothing.
Filters by length, place and a sketch of 2-grams leave few pairs; only their texts are
fetched and compared, by a banded edit distance.

A batch of strings is hashed, ordered and cut in whole arrays, not string by string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from treemill.llm.text import words
from treemill.plans.session import cut, spread

Q = 5
#: One edit can destroy every 5-gram of 9 characters, so strings below ``SHORT`` are also joined on 2-grams.
SHORT_Q = 2
SHORT = 11
#: The global order of q-grams comes from counts in hash buckets, one for two strings, but no fewer or more than these; the order only
#: has to be the same everywhere, so buckets that share counts cost speed, never pairs.
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 17, 1 << 20
PLACES = 32
STRINGS_A_TASK = 20_000
#: Characters and strings worked on at once, about, and 64-bit words of a sketch.
CELLS, AT_ONCE, SKETCH = 1 << 19, 4_096, 4

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def most_edits(size: int, per: int) -> int:
    """Edits allowed between a string of this length and the longest one it can match."""
    return (size * per // (per - 1)) // per


class Strings:
    """Some strings as one array of characters."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.size)

    def grams(self, q: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, place and hash of every q-gram, by owner and place; ``only`` says which strings take part."""
        n = len(self.chars) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, q, np.uint64)
        for i in range(q):
            h = h * _STEP + self.chars[i : i + n] + np.uint64(1)
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(32)
        owner = self.owner[:n]
        place = np.arange(n) - self.start[owner]
        inside = place + q <= self.size[owner]
        if only is not None:
            inside &= only[owner]
        return owner[inside], place[inside], h[inside]

    def sketches(self) -> np.ndarray:
        """Which of ``64 * SKETCH`` hash buckets the 2-grams of each string fall into, as signed numbers.

        One edit removes at most two 2-grams and adds at most two, so it flips at most four bits.
        """
        out = np.zeros((len(self.size), SKETCH), np.uint64)
        owner, _, h = self.grams(2)
        bit = (h % np.uint64(64 * SKETCH)).astype(np.int64)
        np.bitwise_or.at(out, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return out.view(np.int64)


def prefixes(owner: np.ndarray, place: np.ndarray, hashes: np.ndarray, counts: np.ndarray, edits: np.ndarray, q: int) -> np.ndarray:
    """Which q-grams the shortest beginning, rarest first, of each string holds that its ``edits`` cannot destroy.

    One edit destroys at most the q-grams of ``q`` neighbouring places.  Every
    occurrence of the last q-gram is kept, so equal q-grams are never cut apart.  Where
    the whole list can be destroyed it is kept whole.  The length of the beginning is
    found for all strings at once by halving; what it takes to destroy one is counted
    from left to right.
    """
    if not len(owner):
        return np.zeros(0, bool)
    n = len(edits)
    order = np.lexsort((hashes, counts[(hashes % np.uint64(len(counts))).astype(np.int64)], owner))
    first = np.searchsorted(owner, np.arange(n))
    held = np.searchsorted(owner, np.arange(n), "right") - first
    sorted_hashes = hashes[order]
    # equal q-grams of a string share a rank
    new = np.concatenate([[True], (sorted_hashes[1:] != sorted_hashes[:-1]) | (owner[1:] != owner[:-1])])
    level = np.cumsum(new) - 1
    level -= level[np.minimum(first, len(level) - 1)][owner]
    rank = np.empty(len(owner), np.int64)
    rank[order] = level
    longest = int(held.max())
    grid = np.full((longest, n), np.iinfo(np.int32).max, np.int32)
    grid[place, owner] = rank

    def needed(upto: np.ndarray) -> np.ndarray:
        """Edits it takes to destroy the q-grams of a rank up to this."""
        need, reach = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at in range(longest):
            take = (grid[at] <= upto) & (reach <= at)
            need += take
            reach[take] = at + q
        return need

    low, high = np.zeros(n, np.int64), np.full(n, int(level.max()), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        enough = needed(middle) > edits
        high = np.where(enough, middle, high)
        low = np.where(enough, low, np.minimum(middle + 1, high))
    return rank <= low[owner]


def joined_words(df: DataFrame, key: str, text: str, least_words: int = 6) -> DataFrame:
    """``key, side, s``: texts of at least ``least_words`` words, as their words without gaps."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words(t) for t in batch["text"]]
            batch["s"] = ["".join(w) if len(w) >= least_words else None for w in found]
            yield batch.loc[batch["s"].notna(), ["key", "side", "s"]]

    rows = spread(df.select(df[key].alias("key"), df[text].alias("text"), df["side"]).filter("text is not null and side is not null"))
    return rows.mapInPandas(run, f"key {kind}, side int, s string")


def _parts(batch: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """A batch in parts of bounded number, strings of about one length together."""
    sizes = batch["s"].str.len().to_numpy()
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        fits = np.arange(1, len(order) - at + 1) * sizes[order[at:]] <= CELLS
        part = batch.iloc[order[at : at + max(1, min(AT_ONCE, int(fits.sum())))]]
        yield (Strings(list(part["s"])), *(part[c].to_numpy() for c in columns))
        at += len(part)


def _sizes(strings: Strings) -> list[tuple[int, np.ndarray | None]]:
    """Lengths of q-grams to join on, and the strings that take part."""
    short = strings.size < SHORT
    return [(Q, None), (SHORT_Q, short)] if short.any() else [(Q, None)]


def near_classes(strings: DataFrame, per: int = 10, n_strings: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of strings that overlap: ``a`` with ``left``, ``b`` with ``right``; equal ones included.

    ``strings`` has distinct ``s`` with the flags ``left`` and ``right``.
    """
    if per < 10:
        raise ValueError("5-grams are exact for at most one edit in ten characters")
    spark = strings.sparkSession
    wanted = (strings.count() if n_strings is None else n_strings) // 2
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << wanted.bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for (own,) in _parts(batch, []):
                for q, only in _sizes(own):
                    total += np.bincount((own.grams(q, only)[2] % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": total[used]})

    table = np.zeros(buckets, dtype=np.int64)
    rows = strings.select("s").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = rows.toPandas()  # at most MOST_BUCKETS rows, whatever the data
    table[counted["bucket"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(table)
    bits = [f"sketch_{n}" for n in range(SKETCH)]

    def posts(is_left: bool) -> DataFrame:
        """Kept q-grams of one side's strings; on the right also for the blocks that the allowed edits can reach."""

        def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = shared.value
            for batch in batches:
                for own, ids in _parts(batch, ["id"]):
                    edits, sketches = own.size * per // (per - 1) // per, own.sketches()
                    for q, only in _sizes(own):
                        owner, place, hashes = own.grams(q, only)
                        kept = prefixes(owner, place, hashes, counts, edits, q)
                        owner, place, hashes = owner[kept], place[kept], hashes[kept]
                        reach = 0 * owner if is_left else edits[owner]
                        low, high = (place - reach) // PLACES, (place + reach) // PLACES
                        again = np.repeat(np.arange(len(owner)), high - low + 1)
                        block = low[again] + np.arange(len(again)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                        o = owner[again]
                        out = {"gram": hashes[again].view(np.int64), "block": block.astype(np.int32), "place": place[again].astype(np.int32), "size": own.size[o].astype(np.int32), "id": ids[o]}
                        yield pd.DataFrame(out | {name: sketches[o, n] for n, name in enumerate(bits)})

        own = named.filter("left" if is_left else "right").select("id", "s")
        return own.mapInPandas(post, "gram long, block int, place int, size int, id long, " + ", ".join(f"{b} long" for b in bits))

    named = strings.withColumn("id", F.xxhash64("s"))
    fields = ("place", "size", "id", *bits)
    left = posts(True).select("gram", "block", *[F.col(c).alias(f"{c}_a") for c in fields])
    right = posts(False).select("gram", "block", *[F.col(c).alias(f"{c}_b") for c in fields])
    allowed = f"(greatest(size_a, size_b) div {per})"
    flipped = " + ".join(f"bit_count({b}_a ^ {b}_b)" for b in bits)
    # what was inserted before the q-gram and what behind it both count as edits
    near = F.expr(f"abs(place_a - place_b) + abs((size_a - place_a) - (size_b - place_b)) <= {allowed} and id_a <> id_b and {flipped} <= 4 * {allowed}")
    close = F.expr(f"a <> b and levenshtein(a, b, int(greatest(length(a), length(b)) div {per})) >= 0")
    ids = left.join(right, ["gram", "block"]).filter(near).select("id_a", "id_b").distinct()
    # the strings come back by id only for the few pairs that are left; an id shared by chance only adds a pair to verify
    pairs = ids.join(named.select(F.col("id").alias("id_a"), F.col("s").alias("a")), "id_a").join(named.select(F.col("id").alias("id_b"), F.col("s").alias("b")), "id_b")
    pairs = pairs.filter(close).select("a", "b")
    same = strings.filter("left and right").select(F.col("s").alias("a"), F.col("s").alias("b"))
    return pairs.unionByName(same)


def _sided_classes(df: DataFrame, key: str, text: str, side: Column, per: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``key, side, s``, and the overlapping pairs ``a, b`` of their distinct strings."""
    sided = df.select(df[key].alias("key"), df[text].alias("text"), side.alias("side"))
    rows = cut(joined_words(sided, "key", "text", least_words=least_words))
    # the work per string is large against its bytes, so partitions are set by number of rows
    n_rows = rows.count()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // STRINGS_A_TASK))
    strings = cut(rows.repartition(parts, "s").groupBy("s").agg(F.max(F.col("side") == 0).alias("left"), F.max(F.col("side") == 1).alias("right")))
    return rows, near_classes(strings, per, n_rows)


def cross_split_pairs(df: DataFrame, key: str, text: str, side: Column, per: int = 10, least_words: int = 6) -> DataFrame:
    """Pairs of a left row (``side`` 0) and a right row (``side`` 1) whose texts overlap: ``key_a < key_b``.

    Rows of another or null ``side``, null texts and texts of fewer than ``least_words``
    words pair with nothing.  Repeated rows count by themselves.  Hot classes only widen
    the last join, which adaptive execution splits; ``partners`` counts without it.
    """
    rows, pairs = _sided_classes(df, key, text, side, per, least_words)
    a = rows.filter("side = 0").select(F.col("key").alias("ka"), F.col("s").alias("a"))
    b = rows.filter("side = 1").select(F.col("key").alias("kb"), F.col("s").alias("b"))
    full = pairs.join(a, "a").join(b, "b")
    return full.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def partners(df: DataFrame, key: str, text: str, side: Column, per: int = 10, least_words: int = 6) -> DataFrame:
    """``key, class_id, n_partners``: every row that overlaps, with its class of equal strings and the number of rows of the other side that it overlaps.

    A class has the smallest key of its rows of either side as id.  Counted over classes;
    pairs of rows are never made.
    """
    rows, pairs = _sided_classes(df, key, text, side, per, least_words)
    sizes = rows.groupBy("side", "s").agg(F.count("*").alias("n"))
    left, right = (sizes.filter(F.col("side") == n).select(F.col("s").alias(name), F.col("n").alias(f"n_{name}")) for n, name in ((0, "a"), (1, "b")))
    sized = pairs.join(left, "a").join(right, "b")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("s"), F.col("n_b").alias("n")), F.struct(F.lit(1).alias("side"), F.col("b").alias("s"), F.col("n_a").alias("n"))))
    counted = sized.select(ends.alias("e")).groupBy("e.side", "e.s").agg(F.sum("e.n").alias("n_partners"))
    ids = rows.groupBy("s").agg(F.min("key").alias("class_id"))
    return rows.join(counted.join(ids, "s"), ["side", "s"]).select("key", "class_id", "n_partners")
