"""Figures of every document's text, and documents that are no natural prose (problem 8).

Each non-blank line gets a kind.  *Cells*: neighbouring lines share a delimiter and its
count, or the places where their columns start (vertical alignment).  *Entries*: lines
with marks of an enumeration; lines below a mark that belong to its entry, as the
indentation of the run returns with the entries (indentation periodicity); runs of short
unmarked lines that no text wrapping at one width explains; and records of several short
lines, whose line lengths return with the record (line-length autocorrelation).  *Junk*: lines of symbols, broken encoding, encoded bytes, markup,
remains of page frames, letters that form no words, or one pattern over and over, and
lines that a document keeps repeating.  A document is of a class if more than half of
its non-blank lines are of that kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from treemill.llm.text import words
from treemill.plans.session import spread

# fixed values: frequent function words of the languages of the corpus
COMMON = frozenset(
    "the a an and or but of to in on at for with from by as is are was were be been has have had it its he she they we you i his her their our your this that these those "
    "not no so if than then there which who what when will would can could may might must shall should do does did my me him them us about into over under after before "
    "der die das den dem des ein eine einen und oder aber nicht ist sind war mit von zu im am auf für bei nach vor über unter durch sich wir sie er es ich ihr als auch wie nur "
    "el la los las un una unos unas y o pero no es son fue con de del al en por para sobre bajo que se su sus lo le les nos más como entre sin "
    "le la les un une des et ou mais ne pas est sont était avec de du au aux en par pour sur sous que qui se sa son ses nous vous ils elles il elle on dans ce cette ces".split()
)
# fixed values: pronouns, which mark clauses rather than entries
PRONOUNS = frozenset("i you he she it we they who".split())
# fixed values: characters of text read in a wrong encoding
BROKEN = frozenset("ÃÂâ€™œ©�¤¬¢žŸ†‡‰‹›˜¨¦")

_MARK = regex.compile(
    r"^\s*(?:(?P<bullet>[*•‣▪▫◦●○■□–—+\-→»·✓✔☐☑]|\[[ xX✓]?\])\s+|(?P<num>[(\[]?\d{1,4}[.):\]]{1,2})\s+|(?P<alpha>[(\[]?\p{L}[.)\]]{1,2})\s+"
    r"|(?P<roman>[(\[]?[ivxlcIVXLC]{1,7}[.)\]]{1,2})\s+|(?P<word>(?:\p{L}{2,9}\.?|#|№)\s?\d{1,4}\s?[:.)\-–])\s)\s*\S"
)
_PERIOD = re.compile(r"^(.{1,12}?)\1{3,}.{0,12}$", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_CODE = re.compile(r"[{};]\s*$|\b(?:var|function|return|const|let)\b.*[=({]|\)\s*[{;]|=>|&\w+;")
_HEX = re.compile(r"^\W*(?:[0-9a-fA-F]{4,}[:\s]\s*)?(?:[0-9a-fA-F]{2,}[\s:]?){4,}.{0,20}$")
_BASE = re.compile(r"^[A-Za-z0-9+/=_\-]{16,}$")
_RUN = regex.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", regex.I)
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
#: Five or more tokens of letters and digits of usual length, with usual punctuation.
_PLAIN = re.compile(r"^[(\"'“‘>]{0,2}\s?[^\W_][\w'’\-,]{0,24}(?: +[(\"'“‘]?[\w'’\-/]{1,24}[,.!?;:%\")…”’]{0,3}){4,}$")
_SEPARATOR = re.compile(r"^[\s|+:=\-–—_]*$")
_END = regex.compile(r"[.!?…。！？؟।]['\"”’»)\]*_]*$")
_INNER = regex.compile(r"[.!?…。！？]['\"”’»)]?\s+\p{Lu}")

ENTRY_WORDS = 7
DELIMITERS = ("|", "\t", ";", ",")


#: Autocorrelation from which a series counts as returning; periods of records, in lines.
RETURNS, RECORD_LINES = 0.6, 8


def _autocorrelation(values: list[int], lag: int) -> float:
    """Of a series with itself moved by ``lag``, a mean over the places that have a partner; 0 for a constant or too short one."""
    n = len(values)
    if n <= lag + 1:
        return 0.0
    mean = sum(values) / n
    power = sum((v - mean) ** 2 for v in values) / n
    return sum((values[i] - mean) * (values[i + lag] - mean) for i in range(n - lag)) / (n - lag) / power if power else 0.0


def _indents(lines: list[str]) -> list[int]:
    return [len(line) - len(line.lstrip()) for line in lines]


def _hanging(lines: list[str], flags: list[bool], taken: list[bool]) -> None:
    """Flags the lines that continue marked entries: deeper than the marks, in a run whose indentation returns with the entries.

    Entries of one number of lines make the indentation periodic; where their numbers
    differ, all marks must stand at one depth and all lines between them deeper.
    """
    at, depth = [i for i, f in enumerate(flags) if f], _indents(lines)
    if len(at) < 2:
        return
    lag = Counter(b - a for a, b in zip(at, at[1:])).most_common(1)[0][0]
    stop = min(len(lines), at[-1] + lag)
    steady = lag > 1 and _autocorrelation(depth[at[0] : stop], lag) >= RETURNS
    steady = steady or len({depth[a] for a in at}) == 1 and all(depth[i] > depth[at[0]] for i in range(at[0], at[-1]) if not flags[i])
    if not steady:
        return
    for a, b in zip(at, [*at[1:], len(lines)]):
        for i in range(a + 1, b):
            if taken[i] or depth[i] <= depth[a]:
                break
            flags[i] = True


def _records(lines: list[str], flags: list[bool], taken: list[bool]) -> None:
    """Flags records of several short lines each: three or more in a row whose line lengths return with the record."""
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and not taken[j] and not flags[j] and len(lines[j].split()) <= ENTRY_WORDS and not _INNER.search(lines[j]) and not _END.search(lines[j].strip()):
            j += 1
        sizes = [len(line.strip()) for line in lines[i:j]]
        lag = next((k for k in range(2, min(RECORD_LINES, len(sizes) // 3) + 1) if _autocorrelation(sizes, k) >= RETURNS and _autocorrelation(sizes, 1) < RETURNS), 0)
        if lag and not _wrapped(lines[i:j]):
            for k in range(i, j):
                flags[k] = True
        i = max(j, i + 1)


def _shares(line: str) -> tuple[float, float]:
    """Of the visible characters: letters, and letters or digits."""
    visible = letters = alnum = 0
    for c in line:
        if not c.isspace():
            visible += 1
            if c.isalpha():
                letters += 1
                alnum += 1
            elif c.isalnum():
                alnum += 1
    return (letters / visible, alnum / visible) if visible else (0.0, 0.0)


def _borders(text) -> list[int]:
    """The prefix function: at each place the length of the longest proper border of what ends there."""
    out = [0] * len(text)
    k = 0
    for i in range(1, len(text)):
        while k and text[i] != text[k]:
            k = out[k - 1]
        k += text[i] == text[k]
        out[i] = k
    return out


def period(text: str) -> int | None:
    """Smallest period, of any length, that more than half of ``text`` repeats three times or more, from its start."""
    n = len(text)
    probe = max(1, n // 6)
    if text.find(text[:probe], 1, n // 3 + probe + 1) < 0:  # a start that does not return has no such period
        return None
    for k, border in enumerate(_borders(text), 1):
        if 2 * k > n and 3 * (k - border) <= k:
            return k - border
    return None


def _repeats(s: str, dense: str) -> bool:
    """Whether one pattern makes up the line; several whole sentences written again and again are no pattern of a line."""
    for text, turn in ((dense, 1), (dense[::-1], -1)):
        found = period(text)
        if found:
            size = round(len(s) * found / len(dense))
            if not _INNER.search(s[:size] if turn == 1 else s[-size:]):
                return True
    return False


def repeated_lines(lines: list[str]) -> list[bool]:
    """Lines within a run that goes three times or more through the same lines, however many."""
    flags = np.zeros(len(lines), bool)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(line.strip(), len(number)) for line in lines], int)
    longest = int((np.bincount(ids) // 3).sum()) if len(ids) else 0  # each line of a period comes three times
    for q in range(1, longest + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for start, stop in zip(edges[::2], edges[1::2]):
            if stop - start >= 2 * q:
                flags[start : stop + q] = True
    return flags.tolist()


def is_junk(line: str) -> bool:
    """A line that nobody could read as text, whatever its language."""
    s = line.strip()
    if len(s) >= 12 and not _SEPARATOR.match(s) and _repeats(s, s.replace(" ", "")):
        return True
    if _PLAIN.match(s) and not COMMON.isdisjoint(s.lower().split()):
        return False
    mark = _MARK.match(s)
    if mark:
        s = s[mark.end() - 1 :]
    size = len(s)
    dense = s.replace(" ", "")
    if size >= 12 and _PERIOD.match(dense) and not _SEPARATOR.match(s):
        return True
    broken = sum(c in BROKEN for c in s)
    if size >= 8 and broken > 0.25 * len(dense):
        return True
    letters, alnum = _shares(s)
    if size >= 8 and alnum < 0.5 and "|" not in s[1:-1].replace("||", "") and not _SEPARATOR.match(s):
        return True
    if size >= 8 and alnum < 0.35:
        return True
    tags = _TAG.findall(s)
    if tags and sum(map(len, tags)) > 0.4 * size:
        return True
    if _CODE.search(s) and alnum < 0.8:
        return True
    tokens = s.split()
    if len(tokens) >= 5 and sum(not any(c.isalnum() for c in t) or t[0] in "[(<{" for t in tokens) > 0.4 * len(tokens):
        return True
    if size >= 16 and _HEX.match(s) and sum(c.isdigit() for c in s) >= 0.25 * len(dense):
        return True
    if len(tokens) <= 2 and _BASE.match(tokens[0]) and len(tokens[0]) >= 16:
        t = tokens[0]
        kinds = any(c.islower() for c in t) + any(c.isupper() for c in t[1:]) + any(c.isdigit() for c in t)
        if kinds >= 2 and "-" not in t:
            return True
    odd = sum(len(t) for t in tokens if _odd_token(t))
    return odd > 0.5 * len(dense)


def _odd_token(token: str) -> bool:
    """A run of letters that no alphabetic language would write."""
    if len(token) < 9 or not token.isascii():
        return False
    vowels = sum(c in "aeiouyAEIOUY" for c in token)
    longest = max((len(m.group()) for m in _RUN.finditer(token)), default=0)
    if len(token) > 45 and "/" not in token:
        return True
    return longest >= 5 and vowels < 0.3 * len(token) or longest >= 7


def _cells(lines: list[str]) -> list[bool]:
    """Lines that share a layout of cells with the line before or after."""
    flags = [False] * len(lines)
    for mark in DELIMITERS:
        counts = [line.strip().count(mark) if mark == "|" else line.count(mark) for line in lines]
        for i in range(len(lines) - 1):
            n = counts[i]
            if n and n == counts[i + 1] and _cell_like(lines[i], mark, n) and _cell_like(lines[i + 1], mark, n):
                flags[i] = flags[i + 1] = True
    starts = [[m.end() for m in _GAP.finditer(line)] if "  " in line else [] for line in lines]
    for i in range(len(lines) - 1):
        a, b = set(starts[i]), set(starts[i + 1])
        if a and b and len(a & b) >= max(1, 0.6 * min(len(a), len(b))) and abs(len(a) - len(b)) <= 1:
            flags[i] = flags[i + 1] = True
    return flags


def _cell_like(line: str, mark: str, n: int) -> bool:
    if mark == ",":
        if n < 2:
            return False
        parts = line.strip().split(",")
        return max(len(p.split()) for p in parts) <= 3 and sum(len(p.split()) for p in parts) <= 1.7 * len(parts) and not _END.search(line.strip())
    if mark == ";":
        parts = line.strip().split(";")
        return (n >= 2 or len(parts[0].split()) <= 3) and max(len(p.split()) for p in parts) <= 4
    return True


def _wrapped(lines: list[str]) -> bool:
    """Whether breaking one running text at a fixed width would give these lines."""
    width = max(map(len, lines))
    fits = sum(len(a) + 1 + len((b.split() or [""])[0]) > width for a, b in zip(lines, lines[1:]))
    return fits >= 0.75 * (len(lines) - 1)


def _entries(lines: list[str], taken: list[bool]) -> list[bool]:
    """Lines that are entries of an enumeration, marked or not."""
    flags = [False] * len(lines)
    marks = [_MARK.match(line) for line in lines]
    family = Counter(m.lastgroup for m in marks if m)
    for i, m in enumerate(marks):
        if m and not taken[i] and family[m.lastgroup] >= 2:
            flags[i] = True
    _hanging(lines, flags, taken)
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and not taken[j] and not flags[j] and _entry_like(lines[j]):
            j += 1
        if j - i >= 3 and not (_wrapped(lines[i:j]) and max(map(len, lines[i:j])) > 24):
            for k in range(i, j):
                flags[k] = True
        i = max(j, i + 1)
    _records(lines, flags, taken)
    return flags


def _entry_like(line: str) -> bool:
    s = line.strip()
    found = s.split()
    if len(found) > ENTRY_WORDS or s[-1] in ",;:-" or _END.search(s) or _INNER.search(s) or s[0] == ">":
        return False
    low = [w.strip("()[]\"'“”.,").lower() for w in found]
    return not PRONOUNS & set(low) and sum(w in COMMON for w in low) <= 0.4 * len(low)


def line_kinds(lines: list[str]) -> list[str]:
    """``junk``, ``table``, ``list`` or ``text`` for each non-blank line."""
    cells = _cells(lines)
    junk = [is_junk(line) and not (cell and not _broken(line)) for line, cell in zip(lines, cells)]
    times = Counter(line.strip() for line in lines)
    if len(lines) >= 4:
        junk = [j or times[line.strip()] >= 3 and times[line.strip()] > 0.25 * len(lines) for j, line in zip(junk, lines)]
    junk = [j or again for j, again in zip(junk, repeated_lines(lines))]
    cells = [c and not j for c, j in zip(cells, junk)]
    entries = _entries(lines, [a or b for a, b in zip(cells, junk)])
    return ["junk" if j else "table" if c else "list" if e else "text" for j, c, e in zip(junk, cells, entries)]


def _broken(line: str) -> bool:
    s = line.strip()
    letters, alnum = _shares(s)
    return alnum < 0.35 and not _SEPARATOR.match(s) or sum(c in BROKEN for c in s) > 0.25 * len(s) or bool(_TAG.search(s)) or _patterned(s)


def _patterned(s: str) -> bool:
    dense = s.replace(" ", "")
    return not _SEPARATOR.match(s) and (bool(_PERIOD.match(dense)) or len(s) >= 12 and _repeats(s, dense))


def document_class(text: str | None) -> str | None:
    """``list``, ``table`` or ``junk`` if more than half of the non-blank lines are; else null."""
    if not text or text.isspace():
        return None
    lines = [line for line in _lines(text) if line.strip()]
    kinds = Counter(line_kinds(lines))
    kind, n = kinds.most_common(1)[0] if kinds else ("text", 0)
    return kind if kind != "text" and 2 * n > len(lines) else None


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


STATS = (
    "n_words int, mean_word_len double, symbol_ratio double, n_lines int, punct_line_share double, common_share double, "
    "table_share double, list_share double, junk_share double, indent_autocorr double, length_autocorr double, doc_class string"
)


def figures(text: str | None) -> tuple:
    """The values of ``STATS``; a text without words or lines has zeros and a null class."""
    found = words(text)
    lines = [line for line in _lines(text or "") if line.strip()]
    if not lines:
        return (0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
    kinds = line_kinds(lines)
    share = {k: kinds.count(k) / len(lines) for k in ("table", "list", "junk")}
    visible = [c for c in text if not c.isspace()]
    symbols = sum(not c.isalnum() for c in visible) / max(1, len(visible))
    indent = [len(line) - len(line.lstrip()) for line in lines]
    best = max(share, key=share.get)
    return (
        len(found), sum(map(len, found)) / max(1, len(found)), symbols, len(lines), sum(bool(_END.search(x.strip())) for x in lines) / len(lines),
        sum(w in COMMON for w in found) / max(1, len(found)), share["table"], share["list"], share["junk"],
        max(_autocorrelation(indent, lag) for lag in (1, 2, 3)), _autocorrelation(list(map(len, lines)), 1), best if share[best] > 0.5 else None,
    )


def document_figures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``STATS`` for every row, whole texts; a map without shuffle.  Null, empty and blank texts get zeros."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([figures(t) for t in batch["text"]], columns=names)
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    rows = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return rows.mapInPandas(run, f"id {kind}, {STATS}").withColumnRenamed("id", id_col)


def not_prose(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, doc_class`` of the documents that are lists, tables or junk."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [document_class(t) for t in batch["text"]]
            out = pd.DataFrame({"id": batch["id"], "doc_class": found})
            yield out[out["doc_class"].notna()]

    rows = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter(F.col("text").isNotNull()))
    return rows.mapInPandas(run, f"id {kind}, doc_class string").withColumnRenamed("id", id_col)
