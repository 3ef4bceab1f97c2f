"""Archives as a data source: members, broken files, partitions; a benchmark composed from its archive; manifest notes."""

import json
import zipfile

import pytest

from palisade.operators.prepare import compose_bipia
from palisade.sources import readers
from palisade.sources.archives import injection_parts, read_archives


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/rows.jsonl", "".join(json.dumps({"n": i, "t": "a b"}) + "\n" for i in range(2500)) + "\n")
        z.writestr("list.json", json.dumps({"examples": [{"n": 1}, 2]}))
        z.writestr("none.json", "{}")
        z.writestr("table.csv", '﻿n,t\n1,"two\nlines"\n')
        z.writestr("bad.json", "[1, ")
        z.writestr("bad.csv", b"n\n\xff\xfe\n")
        z.writestr("notes.txt", "left out")
        z.writestr("long.jsonl", "9" * 5000)
    (tmp_path / "b.zip").write_bytes(b"this is no archive")
    with zipfile.ZipFile(tmp_path / "c.zip", "w"):
        pass
    return tmp_path


def test_archives(spark, folder):
    for options in ({}, {"partitionBytes": "1"}):
        df = read_archives(spark, str(folder), "s", "train", maxMember="200000", **options)
        rows = df.collect()
        by = {}
        for r in rows:
            by.setdefault(r["file"], []).append(r)
        assert set(by) == {"x/rows.jsonl", "list.json", "table.csv", "bad.json", "bad.csv", "b.zip", "long.jsonl"}
        assert [r["ordinal"] for r in by["x/rows.jsonl"]] == list(range(2500)) and json.loads(by["x/rows.jsonl"][7]["row"]) == {"n": 7, "t": "a b"}
        assert [json.loads(r["row"]) for r in by["list.json"]] == [{"n": 1}, 2] and json.loads(by["table.csv"][0]["row"]) == {"n": "1", "t": "two\nlines"}
        assert [[r["row"] for r in by[x]] for x in ("bad.json", "b.zip")] == [[None], [None]] and by["bad.csv"][-1]["row"] is None
        assert {r["original_split"] for r in by["list.json"]} == {"train/list.json"} and {r["source"] for r in rows} == {"s"}
    assert df.rdd.getNumPartitions() >= 7
    small = read_archives(spark, f"file://{folder}/a.zip", "s", maxMember="4000")
    assert {r["file"] for r in small.select("file").distinct().collect()} == {"list.json", "table.csv", "bad.json", "bad.csv"}
    assert read_archives(spark, f"{folder}/c.zip", "s").count() == 0


def test_a_benchmark_from_its_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("r/benchmark/text_attack_test.json", json.dumps({"one": ["a1", 5, "a2"], "two": ["a3"]}))
        z.writestr("r/benchmark/email/test.jsonl", "".join(json.dumps(x) + "\n" for x in [{"context": "c0"}, {"context": None}, {"other": 1}, {"context": "c3"}]))
    attacks, contexts = injection_parts(spark, f"{tmp_path}/z.zip")
    rows = compose_bipia(attacks, contexts).orderBy("turn").collect()
    pairs = [(r["group_id"].rsplit(":", 1)[1], r["source"].rsplit(":", 1)[1], r["text"].split("<document>\n")[1].split("\n")[:2]) for r in rows]
    assert pairs == [("0", "one", ["c0", "a1"]), ("3", "one", ["c3", "a2"]), ("0", "two", ["c0", "a3"])]
    (tmp_path / "y.zip").write_bytes(b"PK no")
    with pytest.raises(Exception, match="unreadable archive"):
        injection_parts(spark, f"{tmp_path}/y.zip")[0].collect()


def test_manifest_notes(spark):
    whole = json.dumps({"status": "complete", "files": [{"path": "a"}]})
    rows = [("a", whole), ("b", None), ("c", json.dumps({"status": "partial", "files": []})), ("d", "{"), ("synthetic_client_policy", None), ("e", json.dumps({"files": []}))]
    notes = {r["source"]: (r["kind"], r["note"]) for r in readers.manifest_notes(spark.createDataFrame(rows, "source string, manifest string")).collect()}
    assert notes == {"b": ("error", "missing manifest"), "c": ("skipped", "download incomplete or gated"), "d": ("error", "unreadable manifest"), "e": ("skipped", "download incomplete or gated")}
