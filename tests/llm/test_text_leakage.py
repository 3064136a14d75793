"""Words, and held-out passages against brute force."""

import random

from treemill.llm import leakage
from treemill.llm.text import word_spans, words


def test_words():
    assert words("It's ﬁne: Ⅷ² soft­hyphen, zero​width, ÉCOLE É x_y") == ["it", "s", "fine", "viii2", "softhyphen", "zerowidth", "ecole", "e", "x", "y"]
    assert words(None) == words("") == words(" \n…") == []


def test_spans_map_to_the_original():
    text = "“ÉCOLE” ﬁne İstanbul so­ft x"
    for word, a, b in word_spans(text):
        assert words(text[a:b]) == [word]
    assert [w for w, _, _ in word_spans(text)] == words(text) and word_spans("A b") == [("a", 0, 1), ("b", 2, 3)]


def brute(docs, items, run):
    out = set()
    for doc, text in docs:
        w = words(text)
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for item, own in items:
            v = words(own)
            if any(tuple(v[i : i + run]) in have for i in range(len(v) - run + 1)):
                out.add((doc, item))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Ça", "dé", "ee"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(n, text(rng.randint(0, 30))) for n in range(30)] + [(30, None), (31, "")]
    items += [(32, items[3][1]), (33, " ".join(items[4][1].split()[2:]))]
    docs = [(n, text(rng.randint(0, 120))) for n in range(60)] + [(60, None), (61, ""), (62, text(5) + "—" + "\n".join(items[5][1].split()) + "!"), (62, "x")]
    for run in (4, 5, 7):
        got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", run)
        assert {tuple(r) for r in got.collect()} == brute(docs, items, run) and brute(docs, items, run)


def test_spans_hold_the_passage(spark):
    passage = " ".join(f"w{n}" for n in range(20))
    docs = spark.createDataFrame([(1, "Before, “" + passage.upper().replace("W7 ", "W7\n") + "” after", "clash")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, passage), (8, "w1 w2")], "item_id long, text string")
    row = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text", spans=True).collect()[0]
    assert (row.item_id, row.n_words) == (9, 20) and words(docs.first().text[row.start : row.end]) == passage.split()


def test_many_items_are_dealt_to_parts(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["a", "b", "c", "Ça", "dé", "ee"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(n, text(rng.randint(0, 40))) for n in range(40)] + [(50, None), (51, ""), (3, text(20))]
    docs = [(n, text(rng.randint(0, 90)) + " " + rng.choice([t for _, t in items if t])) for n in range(50)] + [(60, None), (61, ""), (7, items[3][1]), (7, items[3][1])]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for spans in (False, True):
        monkeypatch.setattr(leakage, "AUTOMATON_CHARS", 4_000_000)
        whole = sorted(map(tuple, leakage.find_leaks(docs_df, "doc_id", "text", items_df, "item_id", "text", 7, spans).collect()))
        monkeypatch.setattr(leakage, "AUTOMATON_CHARS", 150)
        dealt = leakage.find_leaks(docs_df, "doc_id", "text", items_df, "item_id", "text", 7, spans)
        assert sorted(map(tuple, dealt.collect())) == whole and len(whole) > 40
    empty = leakage.find_leaks(docs_df.limit(0), "doc_id", "text", items_df, "item_id", "text", 7)
    assert empty.collect() == [] and leakage.find_leaks(docs_df, "doc_id", "text", items_df.limit(0), "item_id", "text", 7).collect() == []
