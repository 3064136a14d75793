"""Reports for people: the seven tables, one Markdown document, the prompt manifest and snapshot, and console summaries.

Every table is small by nature (systems, labels, bins) and passes through the driver
only within the bound of ``writers``.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from treemill.functions import text as tx
from treemill.sinks import writers


@dataclass(frozen=True)
class Report:
    """A table with its title and the columns that order it."""

    name: str
    title: str
    rows: DataFrame
    order: tuple[str, ...]


def display(df: DataFrame) -> DataFrame:
    """Shares as percentages, p values with four places, other numbers and texts as they are."""
    out = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if name in ("p", "holm"):
            value = tx.p_value(value)
        elif kind == "double":
            value = tx.percent(value)
        out.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def export_tables(reports: list[Report], folder: str) -> list[str]:
    """``name.csv`` with all values and ``name.tex`` of every report; the names written."""
    for report in reports:
        writers.write_table(report.rows, folder, report.name, report.rows.columns, list(report.order))
    return [r.name for r in reports]


def markdown_report(reports: list[Report], title: str, notes: tuple[str, ...] = ()) -> str:
    """All reports as sections of one document."""
    parts = [f"# {title}", "", *(f"{note}\n" for note in notes)]
    for report in reports:
        ordered = report.rows.orderBy(*report.order).limit(writers.REPORT_ROWS)
        body = writers.markdown(display(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_at", F.col("_at").cast("long")), ["_at"])
        parts += [f"## {report.title}", "", "\n".join(_without_last_column(line) for line in body.splitlines()), ""]
    return "\n".join(parts)


def _without_last_column(line: str) -> str:
    cells = line.strip().strip("|").split("|")
    return "|" + "|".join(cells[:-1]) + "|"


def write_markdown(reports: list[Report], title: str, path: str, notes: tuple[str, ...] = ()) -> None:
    writers.replace_file(path, markdown_report(reports, title, notes))


def manifest(sources: DataFrame, audit: DataFrame, records: DataFrame, by: tuple[str, ...]) -> dict:
    """What the prompts come from: sources with their hashes, counters of each archive, and the records' digests by archive.

    ``sources`` has ``path, prompt, sha256``; ``records`` are grouped on the cluster, so one
    digest an archive and not one a call comes to the driver.
    """
    pairs = records.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("prompt_pair_sha256")), "\n"), 256).alias("records_sha256"))
    archives = writers._report(audit.join(pairs, list(by), "left").orderBy(*by))
    return {
        "schema_version": 1, "hash_algorithm": "SHA-256", "prompt_pair_hash_definition": "sha256(UTF8(system) || NUL || UTF8(user))",
        "source_prompts": writers._report(sources.select("path", F.length("prompt").alias("characters"), "sha256").orderBy("path")), "archives": archives,
        "all_archives_verified": all(a["system_verified"] and a["user_verified"] for a in archives),
    }


def snapshot(sources: DataFrame) -> str:
    """The source prompts as they are, with their sizes and hashes, as Markdown."""
    rows = writers._report(sources.select("path", "prompt", "sha256").orderBy("path"))
    lines = ["# Prompt sources", "", "| Path | Characters | Lines | SHA-256 |", "|---|---:|---:|---|"]
    lines += [f"| `{r['path']}` | {len(r['prompt'])} | {len(r['prompt'].splitlines())} | `{r['sha256']}` |" for r in rows]
    for r in rows:
        lines += ["", f"## `{r['path']}`", "", "````text", r["prompt"], "````"]
    return "\n".join(lines) + "\n"


def write_provenance(sources: DataFrame, audit: DataFrame, records: DataFrame, by: tuple[str, ...], folder: str, force: bool = False) -> dict:
    """``prompt_provenance.json`` and ``prompt_sources.md``; refused where an archive is not verified, unless forced."""
    found = manifest(sources, audit, records, by)
    if not found["all_archives_verified"] and not force:
        raise ValueError("some prompts cannot be built again; nothing was written")
    os.makedirs(folder, exist_ok=True)
    writers.replace_file(f"{folder}/prompt_provenance.json", json.dumps(found, ensure_ascii=False, indent=2) + "\n")
    writers.replace_file(f"{folder}/prompt_sources.md", snapshot(sources))
    return found


def console(df: DataFrame, title: str, order: tuple[str, ...], most: int = 200) -> str:
    """A summary for a terminal: aligned columns, at most ``most`` rows, saying how many there are besides."""
    rows = display(df.orderBy(*order)).limit(most + 1).collect()
    cells = [df.columns, *[[str(v) for v in r] for r in rows[:most]]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in cells]
    more = ["... and more rows"] if len(rows) > most else []
    return "\n".join([title, "-" * len(title), *lines, *more]) + "\n"
