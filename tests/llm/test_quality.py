"""Document classes on hand-made texts."""

import pytest

from treemill.llm import quality

PROSE = "We walked along the river for an hour before the rain began. Nobody had thought of an umbrella, so we ran to the mill, and there we waited until it stopped. In the end it was a good day."


def wrapped(text, width):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


PROSE_CASES = [
    PROSE, wrapped(PROSE, 60), wrapped(PROSE, 34), wrapped(PROSE, 26), PROSE.upper(), wrapped(PROSE.lower().replace(",", "").replace(".", ""), 60), PROSE.replace(". ", ".\n"), "> " + wrapped(PROSE, 50).replace("\n", "\n> "),
    "Hi Anna,\n\n" + PROSE + "\n\nCheers,\nBen", "Subject: Re: mill\n\nHi Anna,\n\n" + PROSE + "\n\nBest,\nBen\n", "Die Straße zeigt langsam die Werkstatt ohne Verspätung und das Fenster ersetzt danach das Schild bei der Arbeit.",
    "Q: " + PROSE + "\nA: " + PROSE, "今日は川沿いを一時間歩きました。雨が降り始める前に戻りました。", "Мы шли вдоль реки целый час, пока не начался дождь.", "One, two, three.\n" + PROSE + "\n- a point\n" + PROSE, PROSE + "\na,b,c\nd,e,f\n" + PROSE.replace(". ", ".\n"),
    None, "", "  \n\t\n", "Thanks!", PROSE * 400, "𝐖𝐞 𝐰𝐚𝐥𝐤𝐞𝐝 𝐚𝐥𝐨𝐧𝐠 𝐭𝐡𝐞 𝐫𝐢𝐯𝐞𝐫 𝐟𝐨𝐫 𝐚𝐧 𝐡𝐨𝐮𝐫.",
]
LISTS = [
    "\n".join(f"{m}{w} brush" for m, w in zip(("* ",) * 6, "red old wide thin new soft".split())), "\n".join(f"{n}. {w} brush (4)" for n, w in enumerate("red old wide thin new".split(), 1)), "\n".join(f"{c}) {w} brush" for c, w in zip("abcdef", "red old wide thin new soft".split())),
    "\n".join(f"Step {n}: {w} brush" for n, w in enumerate("red old wide thin new".split(), 1)), "\n".join(f"{w} brush for walls" for w in "Red Old Wide Thin New Soft".split()), "\n".join(f"[ ] {w} brush" for w in "red old wide thin new soft".split()),
    "\n".join(f"{r}. {w} brush" for r, w in zip("i ii iii iv v".split(), "red old wide thin new".split())), "We bought these things.\n" + "\n".join(f"- {w} brush" for w in "red old wide".split()), "\r\n".join(f"– {w} brush" for w in "red old wide thin".split()),
]
TABLES = [d.join(("name", "size", "price")) + "\n" + "\n".join(d.join((w, str(n), f"{n}.50")) for n, w in enumerate("red old wide thin".split())) for d in ("\t", ";", ",", " | ")]
TABLES += ["a | b\n--- | ---\n1 | 2\n3 | 4", "name      size    price\nred       12      1.50\nwide      7       n/a\nthin      300     2.25"]
JUNK = [
    "\n".join(["lol" * 30, "a" * 50, "!" * 40]), "\n".join("#@$%^&*{}[]|\\<>~ !@#$%&*"[n:] + "$%#@{}[]" for n in range(5)), "00000000:b9cfc5a402463d22b0e88a7d77d74a14\n00000018:77602988e68fbb7ff18ae222d74c9d34", "\n".join("âÂ™€œ ©Ã™�€œÂ â™ÃÂ€œ" for _ in range(3)),
    "6TMdgHGmHlQYdUG4NOKJHqHgCTKzsvQcrpO6C4EPfCM71X4ri5q15X\nshuXOTv3dygZVYGS5zcOrlgNOKQZo3UFPJlpkSZ4tem7NN", '<div class="c31"><span id=x7></span></div><script>var a78=[15,12];</script>\n<div class="c2"></div>', "Home Login X >> << [33] [x] (c) ~ ~ ~\nHome Login Y >> << [2] [x] (c) ~ ~ ~",
    "eghckcjgqaggfgxfcnmeenaxzynhxqlklr\njlzazvsaarlawjagtxztqaayvhdjysxjrnn", "🎉" * 60, "\n".join(["Buy it now at our shop."] * 12),
]


HANGING = "\n".join(f"- {w} brush from the shop,\n  it is what {p} uses for the walls." for w, p in zip("red old wide".split(), "Anna Ben Carl".split()))
UNEVEN = "* red brush\n    It is what we use for walls,\n    and for the old fence.\n* old brush\n    We keep it for the boat.\n* wide brush\n    Nobody uses it."
RECORDS = "\n".join(f"{w} brush of this size:\n{n} of them,\n{n}5" for n, w in enumerate("red old wide thin".split(), 1))


@pytest.mark.parametrize("text", [HANGING, UNEVEN, RECORDS])
def test_periodic_entries(text):
    assert quality.document_class(text) == "list"


def test_the_signals_decide():
    lines = HANGING.split("\n")
    assert quality.line_kinds(lines) == ["list"] * 6
    flat = [line.strip() for line in lines]  # the same lines without their indentation
    assert quality.line_kinds(flat).count("list") == 3 and quality.document_class("\n".join(flat)) is None
    sizes = [len(x) for x in RECORDS.split("\n")]
    assert quality._autocorrelation(sizes, 3) > 0.6 > quality._autocorrelation(sizes, 1)
    uneven = [x + " and so" * (n % 5) * (n % 2) for n, x in enumerate(RECORDS.split("\n"))]
    assert quality._autocorrelation([len(x) for x in uneven], 3) < 0.6 and quality.document_class("\n".join(uneven)) is None


@pytest.mark.parametrize("text", PROSE_CASES)
def test_prose(text):
    assert quality.document_class(text) is None


@pytest.mark.parametrize("text, kind", [(t, "list") for t in LISTS] + [(t, "table") for t in TABLES] + [(t, "junk") for t in JUNK])
def test_classes(text, kind):
    assert quality.document_class(text) == kind


def test_half_is_not_enough():
    assert quality.document_class("- red\n- old\n" + "We walked along the river for an hour.\n" * 1 + "Nobody had thought of it before, I am sure.") is None


def test_figures(spark):
    df = spark.createDataFrame([(1, "The cat sat. It ran!\nYes", "x"), (2, None, "x"), (2, "", "x"), (None, LISTS[0], "x")], "doc_id long, text string, doc_class string")
    got = {r.doc_id: r for r in quality.document_figures(df, "doc_id", "text").collect()}
    assert (got[1].n_words, got[1].n_lines, got[1].punct_line_share) == (6, 2, 0.5) and abs(got[1].mean_word_len - 17 / 6) < 1e-9
    assert got[2].n_words == 0 and got[2].doc_class is None and got[None].doc_class == "list"
    assert [(r.doc_id, r.doc_class) for r in quality.not_prose(df, "doc_id", "text").collect()] == [(None, "list")]
    assert quality.not_prose(df.limit(0), "doc_id", "text").collect() == []
    assert quality._autocorrelation([1, 5, 1, 5, 1, 5], 2) > 0.5 and quality._autocorrelation([3, 3, 3], 1) == 0.0
