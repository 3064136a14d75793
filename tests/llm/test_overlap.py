"""Overlap across splits against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treemill.llm import overlap
from treemill.llm.text import words

SCHEMA = "sent_key long, split string, text string, key string, s string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    sides = ([], [])
    for key, split, text, *_ in rows:
        w = words(text)
        if split in ("train", "dev", "test") and len(w) >= 6:
            sides[split != "train"].append((key, "".join(w)))
    return sorted((min(k, m), max(k, m)) for k, a in sides[0] for m, b in sides[1] if distance(a, b) <= max(len(a), len(b)) // 10)


def run(spark, rows):
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("dev", "test"), 1)
    got = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA), "sent_key", "text", side)
    return sorted(tuple(r) for r in got.collect())


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcdefgh")
        elif kind < 0.7:
            out.insert(at, rng.choice("abcdefgh"))
        elif out[at] != " ":
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 1, 2, 4, 9)))) for _ in range(rng.randint(5, 14))) for _ in range(30)]
    rows = [(n, rng.choice(("train", "dev", "test", None, "other")), edited(rng, rng.choice(base), rng.randint(0, 9)), "k", "s") for n in range(160)]
    rows += [(200, "train", None, "k", "s"), (201, "dev", "", "k", "s"), (202, "train", base[0], "k", "s"), (202, "dev", base[0], "k", "s"), (203, "dev", base[0], "k", "s")]
    assert run(spark, rows) == brute(rows) and brute(rows)


def test_links_count_what_the_pairs_hold(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice(("oak", "elm", "ash", "fir", "yew")) + str(rng.randint(0, 9)) for _ in range(8)) for _ in range(12)]
    rows = [(n, rng.choice(("train", "dev", None)), edited(rng, rng.choice(base), rng.randint(0, 3)), "k", "s") for n in range(140)]
    side = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1)
    got = {r.key: (r.class_id, r.n_partners) for r in overlap.partners(spark.createDataFrame(rows, SCHEMA), "sent_key", "text", side).collect()}
    pairs = brute(rows)
    count = {k: sum(k in p for p in pairs) for k in {k for p in pairs for k in p}}
    string = {k: "".join(words(t)) for k, split, t, *_ in rows if split}
    assert {k: n for k, (_, n) in got.items()} == count and pairs
    assert all(c == min(k for k, s in string.items() if s == string[key]) for key, (c, _) in got.items())


def test_very_short_strings(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice(("train", "dev")), " ".join(rng.choice("ab") * rng.choice((1, 1, 1, 2, 3)) for _ in range(6)), None, None) for n in range(120)]
    assert run(spark, rows) == brute(rows)


def test_copies_and_empty(spark):
    rows = [(n, "train" if n % 2 else "test", "The  CAT sat on the mat, again!", None, None) for n in range(20)]
    assert len(run(spark, rows)) == 100
    assert run(spark, rows[:0]) == []
    with pytest.raises(ValueError):
        overlap.near_classes(spark.createDataFrame([("a", True, True)], "s string, left boolean, right boolean"), per=5)


def needed(places, q):
    need, reach = 0, -1
    for p in sorted(places):
        if p >= reach:
            need, reach = need + 1, p + q
    return need


def test_prefixes_are_the_shortest_that_cannot_be_destroyed():
    rng = random.Random(6)
    texts = ["abcdefghijklmnopqrstuvwxyz" * 2, "a" * 40, "ab", "zürich𝐖" * 9] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    own = overlap.Strings(texts)
    counts = np.array([rng.randrange(9) for _ in range(64)])
    for q, edits in ((5, 3), (2, 1), (5, 0), (5, 40)):
        owner, place, hashes = own.grams(q)
        assert [(int(o), int(p)) for o, p in zip(owner, place)] == [(o, p) for o, t in enumerate(texts) for p in range(len(t) - q + 1)]
        by_text = {}
        for o, p, h in zip(owner, place, hashes):
            assert by_text.setdefault(texts[o][p : p + q], h) == h
        kept = overlap.prefixes(owner, place, hashes, counts, np.full(len(texts), edits), q)
        for o in range(len(texts)):
            mine = [(counts[int(h % np.uint64(64))], h, p, k) for x, p, h, k in zip(owner, place, hashes, kept) if x == o]
            keys = sorted({(c, h) for c, h, *_ in mine})
            want = set()
            for key in keys:
                want |= {p for c, h, p, _ in mine if (c, h) == key}
                if needed(want, q) > edits:
                    break
            assert {p for *_, p, k in mine if k} == want


def test_sketches_bound_the_edits():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(50)) for _ in range(50)]
    moved = [edited(rng, t, 3) for t in texts]
    a, b = overlap.Strings(texts).sketches(), overlap.Strings(moved).sketches()
    assert max(sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(i, j)) for i, j in zip(a, b)) <= 12


def test_very_long_texts(spark):
    text = " ".join(f"w{n * 7919 % 10007}" for n in range(4_000))
    rows = [(1, "train", text, None, None), (2, "dev", text.replace("w1", "v1"), None, None), (3, "dev", text[:-9_000], None, None), (4, "test", "a b c d e f", None, None)]
    assert run(spark, rows) == [(1, 2)]
