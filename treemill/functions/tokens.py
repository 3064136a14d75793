"""Expressions over arrays of tokens; all evaluate inside the JVM, without exploding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: length and arc bins, genres, target labels of demonstrations
LENGTH_BINS = (("1-10", 1, 10), ("11-20", 11, 20), ("21-30", 21, 30), ("31-50", 31, 50), ("51+", 51, 1_000_000_000))
ARC_BINS = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4", 4, 4), ("5", 5, 5), ("6-10", 6, 10), ("11+", 11, 1_000_000_000))
GENRES = ("email", "reviews", "answers", "newsgroup", "weblog")
TARGET_LABELS = ("nsubj", "obj", "obl", "det", "advmod", "amod", "compound", "case")


def slim(tokens: str) -> Column:
    """The five fields that scoring reads, taken so that the scan reads no others; a null element becomes one of nulls."""
    fields = ("id", "form", "upos", "head", "deprel")
    return F.arrays_zip(*[F.col(f"{tokens}.{f}") for f in fields]).cast("array<struct<id:int,form:string,upos:string,head:int,deprel:string>>")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def genre(sent_id: Column) -> Column:
    """Text before the first hyphen."""
    return F.split(sent_id, "-")[0]


def bin_label(value: Column, bins: tuple[tuple[str, int, int], ...]) -> Column:
    """Label of the closed range that holds ``value``; null outside all of them."""
    out = F.when(F.lit(False), F.lit(""))
    for label, low, high in bins:
        out = out.when(value.between(low, high), F.lit(label))
    return out


def scored(tokens: Column) -> Column:
    """Tokens that count: all but punctuation."""
    return F.filter(tokens, lambda t: t["upos"] != "PUNCT")


def predicted(tokens: Column, token_id: Column) -> Column:
    """The last predicted token with this id, or null."""
    return F.try_element_at(F.filter(tokens, lambda p: p["id"] == token_id), F.lit(-1))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; lambdas know no common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def label_equal(first: Column, second: Column) -> Column:
    """Labels are compared without case, subtypes included."""
    return F.lower(first) == F.lower(second)


def token_facts(gold: Column, parse: Column) -> Column:
    """Array of one fact per gold token: its fields, the prediction, and what was right.

    A missing or null prediction is wrong, never null.
    """

    def fact(g: Column) -> Column:
        return bound(predicted(parse, g["id"]), lambda p: compared(g, p))

    def compared(g: Column, p: Column) -> Column:
        head = F.coalesce(p["head"] == g["head"], F.lit(False))
        return F.struct(
            g["id"].alias("id"), g["form"].alias("form"), g["upos"].alias("upos"), g["head"].alias("head"), g["deprel"].alias("deprel"),
            p.isNotNull().alias("found"), p["head"].alias("p_head"), p["deprel"].alias("p_deprel"),
            head.alias("uas"), (head & F.coalesce(label_equal(p["deprel"], g["deprel"]), F.lit(False))).alias("las"),
        )

    return F.transform(gold, fact)


def error_type(fact: Column) -> Column:
    """``missing_token``, ``head_and_deprel``, ``head_only`` or ``deprel_only``; null for a right token."""
    label = F.coalesce(label_equal(fact["p_deprel"], fact["deprel"]), F.lit(False))
    return (
        F.when(~fact["found"], "missing_token").when(~fact["uas"] & ~label, "head_and_deprel").when(~fact["uas"], "head_only").when(~label, "deprel_only")
    )


def projective(tokens: Column) -> Column:
    """Whether no two arcs cross; arcs from the root are left out."""
    arcs = F.transform(F.filter(tokens, lambda t: t["head"] != 0), lambda t: F.struct(F.least(t["id"], t["head"]).alias("a"), F.greatest(t["id"], t["head"]).alias("b")))
    return ~F.exists(arcs, lambda x: F.exists(arcs, lambda y: (x["a"] < y["a"]) & (y["a"] < x["b"]) & (x["b"] < y["b"])))


def base_labels(tokens: Column) -> Column:
    """Distinct labels without subtype, sorted."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.split(t["deprel"], ":")[0])))


def reaches_root(tokens: Column) -> Column:
    """Whether every token comes to head 0 by following heads; ids are 1 to n.

    Pointer doubling: each round replaces a head by the head's head, so as many rounds
    as the logarithm of the length settle a sentence, however long.
    """
    ordered = F.array_sort(F.transform(tokens, lambda t: F.struct(t["id"].alias("id"), t["head"].alias("head"))))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(tokens), F.lit(1)))).cast("int"))
    heads = F.aggregate(rounds, F.transform(ordered, lambda t: t["head"]), lambda h, _: _doubled(h))
    return ~F.exists(heads, lambda h: h != 0)


def _doubled(h: Column) -> Column:
    return F.transform(h, lambda x: F.when(x == 0, F.lit(0)).otherwise(F.coalesce(F.get(h, x - 1), F.lit(-1))))
