"""Writers.  Only reports, which are small by nature, pass through the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from treemill.functions import text as tx
from treemill.operators import integrity

REPORT_ROWS = 100_000


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in parallel."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def _report(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write tables in parallel instead")
    return [r.asDict(recursive=True) for r in rows]


def write_document(df: DataFrame, path: str, keys: Iterable[str] = ()) -> None:
    """One indented JSON document: a list of rows, or nested objects by the values of ``keys``."""
    found: list | dict = _report(df)
    keys = list(keys)
    if keys:
        nested: dict = {}
        for row in found:
            at = nested
            for key in keys[:-1]:
                at = at.setdefault(str(row.pop(key)), {})
            at[str(row.pop(keys[-1]))] = row
        found = nested
    replace_file(path, json.dumps(found, ensure_ascii=False, indent=2) + "\n")


def replace_file(path: str, text: str) -> None:
    """Writes beside the target and renames, so that no reader sees half a file."""
    beside = f"{path}.tmp"
    with open(beside, "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(beside, path)


def write_table(df: DataFrame, folder: str, name: str, header: list[str], order: list[str]) -> None:
    """``name.csv`` and ``name.tex`` of a report."""
    import csv
    import io

    rows = df.orderBy(*order)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows([list(r.values()) for r in _report(rows)])
    os.makedirs(folder, exist_ok=True)
    replace_file(f"{folder}/{name}.csv", out.getvalue())
    line = F.concat(F.concat_ws(" & ", *[tx.latex(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]), F.lit(r" \\"))
    body = [r["line"] for r in _report(rows.select(line.alias("line")))]
    escaped = header
    for plain, safe in tx.LATEX:
        escaped = [h.replace(plain, safe) for h in escaped]
    top = [r"\begin{tabular}{" + "l" * len(header) + "}", r"\hline", " & ".join(escaped) + r" \\", r"\hline"]
    replace_file(f"{folder}/{name}.tex", "\n".join([*top, *body, r"\hline", r"\end{tabular}"]) + "\n")


def markdown(df: DataFrame, order: list[str]) -> str:
    """A report as a Markdown table."""
    rows = _report(df.orderBy(*order))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r.values()) + " |" for r in rows]) + "\n"


def flattened(df: DataFrame, keys: list[str]) -> DataFrame:
    """``path, value``: every other column of every row under its keys, joined by slashes."""
    values = [c for c in df.columns if c not in keys]
    texts = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in values])
    return texts.unpivot(keys, values, "metric", "value").select(F.concat_ws("/", *keys, "metric").alias("path"), "value")


def write_once(df: DataFrame, path: str) -> None:
    """A CSV folder that must not exist yet."""
    df.write.mode("errorifexists").csv(path, header=True)


def write_manifest(files: DataFrame, path: str) -> None:
    """``hash  path`` lines of files, sorted by path."""
    rows = _report(integrity.manifest(files).orderBy("path"))
    replace_file(path, "".join(f"{r['sha256']}  {r['path']}\n" for r in rows))


def digest(value) -> str:
    """SHA-256 of a result as JSON with sorted keys and no blanks."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
