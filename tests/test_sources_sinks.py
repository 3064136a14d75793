"""Readers, writers and incremental ingestion."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from treemill.operators import integrity
from treemill.sinks import writers
from treemill.sources import archives, client, conllu
from treemill.streaming import ingest

SAMPLE = """# newdoc id = d
# sent_id = a-1
# text = It's here
1-2\tIt's\t_\t_\t_\t_\t_\t_\t_\t_
1\tIt\tit\tPRON\tPRP\t_\t3\tnsubj\t_\t_
2\t's\tbe\tAUX\tVBZ\t_\t3\tcop\t_\t_
2.1\tx\tx\tX\t_\t_\t_\t_\t_\t_
3\there\there\tADV\tRB\t_\t0\troot\t_\t_


# sent_id = a-2
# text = Go .
# text_en = Come .
1\tGo\tgo\tVERB\tVB\t_\t0\troot\t_\t_
2\t.\t.\tPUNCT\t.\t_\tx\tpunct\t_\t_"""


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(SAMPLE)
    rows = conllu.read(spark, str(tmp_path / "a.conllu")).orderBy("sent_id").collect()
    assert [(r.sent_id, r.text, len(r.tokens)) for r in rows] == [("a-1", "It's here", 3), ("a-2", "Go .", 2)]
    assert rows[0].tokens[0].lemma == "it" and rows[1].tokens[1].head is None
    short = conllu.read(spark, str(tmp_path / "a.conllu"), conllu.SHORT, require_text=True, text_prefix=True)
    assert short.orderBy("sent_id").collect()[1].text == "Come ." and set(short.first().tokens[0].asDict()) == set(conllu.SHORT)
    got = conllu.statistics(short).collect()[0]
    assert (got.sentences, got.words, got.punct, got.non_punct) == (2, 5, 1, 4)
    assert conllu.repeated_ids(short).count() == 0 and conllu.repeated_ids(short.union(short)).count() == 2
    assert sorted(r.sent_id for r in conllu.sentence_ids(spark, str(tmp_path / "a.conllu")).collect()) == ["a-1", "a-2"]
    assert conllu.tags(short).orderBy("sent_id").first().tags == ["PRON", "AUX", "ADV"]


def test_archives_plain_and_zipped(spark, tmp_path):
    rows = [{"sent_id": "a", "llm_parse": None, "uas": 0.5}, {"sent_id": "b", "llm_parse": [{"id": 1, "form": "x", "upos": "X", "head": 0, "deprel": "root"}]}]
    (tmp_path / "p.json").write_text(json.dumps(rows, indent=2))
    with gzip.open(tmp_path / "z.json.gz", "wt") as file:
        json.dump(rows, file)
    plain, zipped = (archives.read_array(spark, str(tmp_path / n), archives.EVALUATIONS).orderBy("sent_id").collect() for n in ("p.json", "z.json"))
    assert plain == zipped and plain[1].llm_parse[0].head == 0 and plain[0].validation_error is None


def test_manifest_finds_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.txt").write_text(name)
    files = archives.read_files(spark, str(tmp_path / "in"), "*.txt")
    expected = integrity.manifest(files).select("path", "sha256").collect()
    writers.write_manifest(files, str(tmp_path / "SUMS"))
    assert len((tmp_path / "SUMS").read_text().splitlines()) == 2
    (tmp_path / "in" / "a.txt").write_text("changed")
    (tmp_path / "in" / "b.txt").unlink()
    got = integrity.manifest_check(archives.read_files(spark, str(tmp_path / "in"), "*.txt"), spark.createDataFrame(expected))
    assert sorted(r.problem for r in got.collect()) == ["changed", "missing"]


def test_unzipped_files(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"hello"))
    assert bytes(archives.unzipped(archives.read_files(spark, str(tmp_path))).first().content) == b"hello"


def test_prompt_tracker_and_cache(spark, tmp_path):
    (tmp_path / "p.txt").write_text("\n base \n")
    assert archives.read_prompt(spark, str(tmp_path / "p.txt")).first().prompt == "base"
    ids = spark.createDataFrame([("a", "PENDING")], "sent_id string, experiment1_status string")
    writers.write_once(ids, str(tmp_path / "t"))
    assert archives.read_tracker(spark, str(tmp_path / "t")).collect() == ids.collect()
    with pytest.raises(Exception):
        writers.write_once(ids, str(tmp_path / "t"))
    built = []
    build = lambda: built.append(1) or ids
    for model in ("m", "m", "n"):
        assert archives.cached(spark, str(tmp_path / "c"), model, build).count() == 1
    assert len(built) == 2


def test_client_tries_again():
    waits, answers = [], iter([ValueError("x"), {"content": "ok", "usage": {"total_tokens": 3}}])

    def flaky(system, user):
        found = next(answers)
        if isinstance(found, Exception):
            raise found
        return found

    got = client.call(flaky, "s", "u", waits.append)
    assert got["raw_response"] == "ok" and got["api_success"] and waits == [1.0] and got["total_tokens"] == 3
    failed = client.call(lambda s, u: 1 / 0, "s", "u", waits.append)
    assert not failed["api_success"] and "ZeroDivisionError" in failed["api_error"] and waits == [1.0, 1.0, 2.0]


def test_client_as_a_source(spark):
    prompts = spark.createDataFrame([(1, "s", "u"), (2, "s", "v")], "k int, system string, user string")
    got = client.answered(prompts, "k", lambda: lambda s, u: {"content": s + u}, 2)
    assert sorted((r.k, r.raw_response) for r in got.collect()) == [(1, "su"), (2, "sv")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("m_1", "a", 1, None), ("m_1", "b", 2, 0.5)], "model string, cond string, n int, x double")
    writers.write_document(df, str(tmp_path / "d.json"), ["model", "cond"])
    assert json.loads((tmp_path / "d.json").read_text())["m_1"]["b"] == {"n": 2, "x": 0.5}
    writers.write_table(df, str(tmp_path), "t", ["Model", "Cond", "N (%)", "X"], ["n"])
    assert (tmp_path / "t.csv").read_text().splitlines() == ["Model,Cond,N (%),X", "m_1,a,1,", "m_1,b,2,0.5"]
    assert r"m\_1 & b & 2 & 0.5 \\" in (tmp_path / "t.tex").read_text() and r"N (\%)" in (tmp_path / "t.tex").read_text()
    assert writers.markdown(df, ["n"]).splitlines()[2] == "| m_1 | a | 1 |  |"
    assert sorted(r.path for r in writers.flattened(df, ["model", "cond"]).collect()) == ["m_1/a/n", "m_1/a/x", "m_1/b/n", "m_1/b/x"]
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert writers.digest({"b": 1, "a": [1.5]}) == writers.digest({"a": [1.5], "b": 1})


def test_ingestion_continues_without_repetition(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, "lab", i % 2 == 0) for i in ids], "response_id long, source string, api_success boolean").withColumn("ingested_at", F.timestamp_seconds(F.col("response_id")))
    schema = rows(1).schema

    def go():
        stream = ingest.once_each(ingest.arriving(spark, str(tmp_path / "in"), schema), "response_id", "ingested_at", "1 day")
        ingest.into_folder(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return sorted(r.response_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    rows(1, 2, 2).write.parquet(str(tmp_path / "in"))
    assert go() == [1, 2]
    rows(2, 3).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == [1, 2, 3] and go() == [1, 2, 3]
    windows = ingest.outcome_windows(spark.read.parquet(str(tmp_path / "in")), "ingested_at", "1 hour", "1 day").collect()
    assert [(w.calls, w.failed) for w in windows] == [(5, 2)]


def test_gold_has_unique_ids_and_unicode_breaks(spark, tmp_path):
    row = "1\tGo\tgo\tVERB\t_\t_\t0\troot\t_\t_"
    (tmp_path / "a.conllu").write_text(f"# sent_id = a\u2028# text = Go\n{row}\n\n# sent_id = b\n{row}", encoding="utf-8")
    assert [(r.sent_id, r.text, len(r.tokens)) for r in conllu.read_gold(spark, str(tmp_path / "a.conllu")).orderBy("sent_id").collect()] == [("a", "Go", 1), ("b", None, 1)]
    (tmp_path / "b.conllu").write_text(f"# sent_id = a\n{row}\n\n# sent_id = a\n{row}", encoding="utf-8")
    with pytest.raises(AssertionError, match="unique"):
        conllu.read_gold(spark, str(tmp_path / "b.conllu"))


def test_links_are_rejected(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x", encoding="utf-8")
    assert archives.read_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "y.txt").symlink_to(tmp_path / "x.txt")
    with pytest.raises(ValueError, match="symbolic"):
        archives.read_files(spark, str(tmp_path))


def test_clusters_need_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from treemill.plans import session

    made = []
    context = lambda master: SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    spark_of = lambda master, **conf: SimpleNamespace(sparkContext=context(master), conf=SimpleNamespace(get=lambda name, default: conf.get("folder", default)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark_of("spark://host:7077"))
    assert session.ensure_checkpoint_dir(spark_of("spark://host:7077", folder="/shared/cp")) == "/shared/cp"
    made.clear()
    assert "treemill-cp-" in session.ensure_checkpoint_dir(spark_of("local[4]"))
