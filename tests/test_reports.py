"""Reports, the command line, samples by counts and the older paired test."""

import csv
import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from treemill import __main__ as cli
from treemill.operators import stats
from treemill.plans import report_plans
from treemill.sinks import reports, writers
from treemill.sinks.reports import Report

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def small(spark):
    return Report("corpus", "Corpus scores", spark.createDataFrame([(2, "b_c", 0.5, 0.00001), (1, "a", None, 0.25)], "k int, name string, las double, p double"), ("k",))


def test_tables_and_report(spark, tmp_path):
    report = small(spark)
    assert reports.export_tables([report], str(tmp_path)) == ["corpus"]
    with open(tmp_path / "corpus.csv", encoding="utf-8") as file:
        assert list(csv.reader(file)) == [["k", "name", "las", "p"], ["1", "a", "", "0.25"], ["2", "b_c", "0.5", "1e-05"]]
    assert r"b\_c & 0.5" in (tmp_path / "corpus.tex").read_text(encoding="utf-8")
    text = reports.markdown_report([report], "Results", ("A note.",))
    assert "## Corpus scores" in text and "| 1 | a |  | 0.2500 |" in text and "| 2 | b_c | 50.00 | <0.0001 |" in text and text.index("| 1 |") < text.index("| 2 |")
    shown = reports.console(report.rows, "corpus", ("k",), most=1)
    assert shown.splitlines()[0] == "corpus" and "... and more rows" in shown and "b_c" not in shown


def test_digests(spark):
    report = small(spark)
    stored = report_plans.numeric_digest([report])
    assert report_plans.check_digests([report], stored) == {}
    changed = Report("corpus", "", report.rows.withColumn("las", F.lit(1.0)), ("k",))
    assert report_plans.check_digests([changed], stored | {"gone": "x"}) == {"corpus": "changed", "gone": "missing"}
    assert report_plans.check_digests([report], {}) == {"corpus": "not stored"}


def test_provenance_files(spark, tmp_path):
    sources = spark.createDataFrame([("a.txt", "Do it.\nNow.", "h1")], "path string, prompt string, sha256 string")
    records = spark.createDataFrame([("c", "p2"), ("c", "p1")], "condition string, prompt_pair_sha256 string")
    audit = spark.createDataFrame([("c", 2, True, True)], "condition string, record_count int, system_verified boolean, user_verified boolean")
    found = reports.write_provenance(sources, audit, records, ("condition",), str(tmp_path))
    assert found["all_archives_verified"] and found["archives"][0]["records_sha256"] == hashlib.sha256(b"p1\np2").hexdigest()
    assert json.loads((tmp_path / "prompt_provenance.json").read_text(encoding="utf-8")) == found
    assert "| `a.txt` | 11 | 2 | `h1` |" in (tmp_path / "prompt_sources.md").read_text(encoding="utf-8")
    with pytest.raises(ValueError):
        reports.write_provenance(sources, audit.withColumn("user_verified", F.lit(False)), records, ("condition",), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


@here
def test_seven_tables(spark, tmp_path):
    names = report_plans.write_report(spark, DATA, str(tmp_path), resamples=20)
    assert names == ["corpus", "pairwise", "reliability", "length", "relations", "token_usage", "critique_churn"]
    assert {p.suffix for p in tmp_path.iterdir()} == {".csv", ".tex", ".md"} and len(list(tmp_path.glob("*.csv"))) == 7
    assert "20 paired resamples" in (tmp_path / "report.md").read_text(encoding="utf-8")


@here
def test_commands(spark, tmp_path, capsys):
    assert cli.main(["analyze", "--data", DATA, "--modules", "corpus", "prf1", "traces", "--trace-n", "3", "--min-rel-count", "5"], spark) == 0
    out = capsys.readouterr().out
    assert "corpus" in out and "precision" in out and cli.main(["analyze", "--data", DATA, "--modules", "nothing"], spark) == 2
    tree = [{"id": 1, "form": "Go", "upos": "VERB", "head": 0, "deprel": "root"}]
    call = {"sent_id": "a", "text": "Go", "raw_response": json.dumps({"tokens": tree}), "gold": tree}
    (tmp_path / "calls.json").write_text(json.dumps([call, call | {"raw_response": None}, call | {"api_error": "late"}]), encoding="utf-8")
    assert cli.main(["evaluate", "--input", str(tmp_path / "calls.json"), "--output", str(tmp_path / "out")], spark) == 0
    records = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.status, r.las) for r in records.select("status", "las").collect() if r.las is not None) == [("parsed", 1.0)] and records.count() == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("x", encoding="utf-8")
    manifest = ["manifest", "--data", str(tmp_path / "in"), "--output", str(tmp_path / "sums.txt")]
    assert cli.main(manifest, spark) == 0 and cli.main([*manifest, "--check"], spark) == 0
    (tmp_path / "in" / "x.txt").write_text("y", encoding="utf-8")
    assert cli.main([*manifest, "--check"], spark) == 1 and "changed" in capsys.readouterr().out


def test_sample_by_counts_is_the_ranked_one(spark):
    rng = np.random.default_rng(3)
    rows = [(n, None if n % 50 == 0 else float(round(rng.choice([0.0, 0.0, 0.25, 0.5, 0.8123]), 4))) for n in range(700)]
    df = spark.createDataFrame(rows, "id long, las double")
    h = lambda n: hashlib.md5(f"42-{n}".encode()).hexdigest()
    pool = sorted(rows, key=lambda r: (-1.0 if r[1] is None else r[1], h(r[0])))[:350]
    want = sorted((r[0] for r in pool), key=h)[:20]
    assert [r.id for r in stats.harder_half_sample(df, "las", "id", 20, 42).collect()] == want
    assert len(stats.harder_half_sample(df.limit(5), "las", "id", 20, 42).collect()) == 5 and stats.harder_half_sample(df.limit(0), "las", "id", 20, 42).collect() == []


@pytest.mark.parametrize("bound", [500_000, 3])
def test_older_paired_test(spark, monkeypatch, bound):
    monkeypatch.setattr(stats, "MATRIX_ROWS", bound)
    rng = np.random.default_rng(1)
    rows = [(pair, f"s{k:02d}", 10, int(rng.integers(0, 11)), int(rng.integers(0, 11)) if pair == "x" else -1) for pair in ("x", "y") for k in range(30 if pair == "x" else 12)]
    rows = [(p, k, n, a, a if b < 0 else b) for p, k, n, a, b in rows]
    df = spark.createDataFrame(rows, "pair string, key string, n int, a int, b int")
    got = {r.pair: r for r in stats.paired_test(df, "key", 60, 42, "pair").collect()}
    assert (got["y"].difference, got["y"].p, got["y"].significant, got["y"].sentences) == (0.0, 1.0, False, 12)
    own = np.array([r[2:] for r in sorted(rows) if r[0] == "x"], float)
    at = [[int(hashlib.md5(f"42-{b}-{i}".encode()).hexdigest()[:8], 16) % 30 for i in range(30)] for b in range(60)]
    sums = np.array([own[i].sum(axis=0) for i in at])
    delta = (sums[:, 1] - sums[:, 2]) / sums[:, 0]
    assert abs(got["x"].p - min(1, 2 * min((delta <= 0).sum(), (delta >= 0).sum()) / 60)) < 1e-12 and abs(got["x"].difference - (own[:, 1].sum() - own[:, 2].sum()) / 300) < 1e-12
    with pytest.raises(Exception, match="same sentences"):
        stats.paired_test(df.withColumn("b", F.when(F.col("key") != "s01", F.col("b"))), "key", 5, 42, "pair").collect()


def test_reports_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(writers, "REPORT_ROWS", 1)
    with pytest.raises(ValueError):
        writers.markdown(small(spark).rows, ["k"])
