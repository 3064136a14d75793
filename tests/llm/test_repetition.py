"""Endless repetition, whatever its period."""

import pytest

from treemill.llm import quality

LINES = ["The mill is open again.", "We sell what you need today.", "Come and see it yourself.", "Nobody else has it so cheap.", "Ask for it at the counter."]


@pytest.mark.parametrize(
    "text",
    [
        "Draedribraeth" * 30, "buy now cheap pills " * 9, "buy the pills and go to the shop now " * 3, "Welcome! " + "buy now cheap pills " * 9, "the longest pattern of all that is seen here " * 40 + "and then an end",
        "\n".join(LINES * 3), "\n".join(LINES[:4] * 20), "Dear all,\n" + "\n".join(LINES * 6) + "\nYours", "\n".join(["a b c d e f g", LINES[0], "a b c d e f g", LINES[1], LINES[1]] * 4),
    ],
)
def test_repetition_is_junk(text):
    assert quality.document_class(text) == "junk"


def test_what_repeats_less_is_not():
    assert quality.document_class("\n".join(LINES * 2)) is None and quality.document_class("buy now cheap pills and be glad, " * 2) is None
    assert quality.period("abcabcab") is None and quality.period("abcabcabca") == 3 and quality.period("xabcabc") is None
    assert quality.repeated_lines([]) == [] and quality.repeated_lines(["a", "b", "b", "b", "c"]) == [False, True, True, True, False]
