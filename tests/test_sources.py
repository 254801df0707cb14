import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F, types as T

from lexloom.operators import relational as R, similarity as S
from lexloom.sources import readers, writers
from lexloom.streaming import incremental


def test_many_files_with_a_legacy_shape(spark, tmp_path):
    for year, columns in ((2001, ["id", "text"]), (2002, ["id", "text", "score"])):
        df = spark.createDataFrame([(year, "x", 0.5)], "id long, text string, score double").select(*columns)
        df.write.parquet(f"{tmp_path}/year={year}")
    full = T.StructType().add("id", "long").add("text", "string").add("score", "double")
    out = {r["id"]: r for r in readers.read_many(spark, f"{tmp_path}/year=*", full, ["score"]).collect()}
    assert out[2001]["schema_shape"] == "legacy" and out[2002]["schema_shape"] == "full" and out[2001]["year_from_path"] == 2001


def test_aligned_lines_and_archives(spark, tmp_path):
    (tmp_path / "a.mk").write_text("﻿one\ntwo\r\nthree\n", newline="")
    (tmp_path / "a.sq").write_text("1\n2\n3", newline="")
    got = readers.aligned_lines(spark, str(tmp_path / "a.mk"), str(tmp_path / "a.sq")).orderBy("line_no").collect()
    assert [(r["mk"], r["sq"]) for r in got] == [("one", "1"), ("two\r", "2"), ("three", "3")]
    (tmp_path / "b.sq").write_text("1\n")
    with pytest.raises(ValueError):
        readers.aligned_lines(spark, str(tmp_path / "a.mk"), str(tmp_path / "b.sq"))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("c.mk", "one\ntwo\n")
        z.writestr("c.sq", "1\n2\n")
    assert [r["second"] for r in readers.aligned_archive(spark, str(tmp_path / "x.zip"), (".mk", ".sq")).orderBy("line_no").collect()] == ["1", "2"]


def test_logs(spark, tmp_path):
    (tmp_path / "run.log").write_text("2026-01-01 10:00:00 start\n more\n2026-01-01 10:00:01 a\n2026-01-02 10:00:00 start\n2026-01-02 10:00:05 b\n")
    records = readers.log_records(readers.numbered_lines(spark, str(tmp_path / "run.log")))
    assert [r["message"] for r in readers.last_invocation(records, "start").orderBy("record").collect()] == ["2026-01-02 10:00:00 start", "2026-01-02 10:00:05 b"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "train"), ("b", 2, "dev")], "t string, year int, split string").withColumn("year", F.col("year").cast("short"))
    writers.write_parquet(df, f"{tmp_path}/out", by=["split", "year"])
    writers.verify(spark, df, f"{tmp_path}/out")
    with pytest.raises(ValueError):
        writers.verify(spark, df.withColumn("t", F.lit("z")), f"{tmp_path}/out")
    with pytest.raises(ValueError):
        writers.gate(df, F.lit(1), "identifiers")
    with pytest.raises(ValueError):
        writers.refuse_placeholders("x <FILL_IN name>")
    assert "| train | 1 | 1-1 |" in writers.dataset_card(df, "split", "year", "Corpus")
    assert json.loads(writers.manifest({"b": 1, "a": 2})) == {"a": 2, "b": 1}
    assert readers.cached(spark, f"{tmp_path}/c", lambda: df).count() == 2 and readers.cached(spark, f"{tmp_path}/c", lambda: 1 / 0).count() == 2


def test_resumable_stream(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "id long, t string")
    one.write.parquet(f"{tmp_path}/in/a")
    for n in (1, 2):
        stream = incremental.file_stream(spark, f"{tmp_path}/in/*", one.schema)
        incremental.process_available(stream, lambda s: s.withColumn("n", F.length("t")), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
        one.write.parquet(f"{tmp_path}/in/b{n}")
    for t in ("z", "y"):
        incremental.keep_latest(incremental.file_stream(spark, f"{tmp_path}/in/*", one.schema), "id", "t", f"{tmp_path}/top", f"{tmp_path}/cp2")
        spark.createDataFrame([(1, t), (2, t)], "id long, t string").write.parquet(f"{tmp_path}/in/{t}")
    incremental.keep_latest(incremental.file_stream(spark, f"{tmp_path}/in/*", one.schema), "id", "t", f"{tmp_path}/top", f"{tmp_path}/cp2")
    assert sorted((r["id"], r["t"]) for r in incremental.read_latest(spark, f"{tmp_path}/top").collect()) == [(1, "z"), (2, "z")]


def test_an_unfinished_batch_leaves_the_last_one_in_force(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "id long, t string")
    one.write.parquet(f"{tmp_path}/in/a")
    go = lambda: incremental.keep_latest(incremental.file_stream(spark, f"{tmp_path}/in/*", one.schema), "id", "t", f"{tmp_path}/top", f"{tmp_path}/cp")
    go()
    spark.createDataFrame([(7, "half")], "id long, t string").write.parquet(f"{tmp_path}/top/v1/__part=3")  # without a manifest
    assert [r["t"] for r in incremental.read_latest(spark, f"{tmp_path}/top").collect()] == ["a"]
    spark.createDataFrame([(1, "b")], "id long, t string").write.parquet(f"{tmp_path}/in/b")
    go()
    assert [r["t"] for r in incremental.read_latest(spark, f"{tmp_path}/top").collect()] == ["b"]


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, t string")
    with pytest.raises(ValueError):
        R.unique_key(df, "k")
    with pytest.raises(ValueError):
        R.check_deletions(["a", "b"], ["a"], {})
    with pytest.raises(ValueError):
        R.conform(df, T.StructType().add("missing", "int"))
    with pytest.raises(ValueError):
        R.require(df, F.col("t") == "b", "bad rows", "k")
    assert R.upsert(df.where("t = 'a'"), df.where("t = 'b'"), "k").first()["t"] == "b"


def test_near_matches_find_every_close_pair(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly box " * 3
    train = spark.createDataFrame([(1, base), (2, "entirely different text about other things " * 5)], "k long, t string")
    probes = spark.createDataFrame([(10, base + "x"), (11, "nothing alike here, not one bit of it " * 4)], "k long, t string")
    assert [r["k"] for r in S.near_matches(train, probes, "k", "t").collect()] == [10]
    best = {r["k"]: r for r in S.best_match(train, probes, "k", "t").collect()}
    assert best[10]["match_key"] == 1 and best[10]["max_jaccard"] > 0.9 and best[11]["max_jaccard"] == 0.0


def test_texts_in_many_blocks(spark, tmp_path):
    """Numbers go on across the splits of a file; a byte order mark and a last line feed don't count."""
    rng = random.Random(1)
    lines = ["\ufeff" * (i == 0) + "".join(rng.choice("ab é\r") for _ in range(rng.randint(0, 40))) for i in range(3000)]
    (tmp_path / "x.txt").write_bytes("\n".join(lines).encode() + b"\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = sorted(map(tuple, readers.numbered_lines(spark, str(tmp_path / "x.txt")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == [(i, x.removeprefix("\ufeff")) for i, x in enumerate(lines)]


def test_plain_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n{"id": 2}\n')
    (tmp_path / "b.csv").write_text("id,v\n1,0.5\n2,\n")
    (tmp_path / "c.json").write_text('{"run": {"n": 3}}')
    assert [tuple(r) for r in readers.read_ndjson(spark, str(tmp_path / "a.jsonl"), "id long, text string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "b.csv"), "id int, v double").orderBy("id").collect()] == [(1, 0.5), (2, None)]
    assert readers.read_json_document(spark, str(tmp_path / "c.json")).first()["run"]["n"] == 3
    assert {r["size"] for r in readers.list_objects(spark, f"{tmp_path}/*.json").collect()} == {17}
    assert readers.find_column(spark.range(1), ["x", "id"]) == "id"
    with pytest.raises(ValueError):
        readers.find_column(spark.range(1), ["x"])


def test_configs_name_their_file(tmp_path):
    (tmp_path / "one.json").write_text('{"run_name": "one", "n": 2}')
    (tmp_path / "two.json").write_text('{"run_name": "one"}')
    assert readers.load_config(str(tmp_path / "one.json"))["n"] == 2
    with pytest.raises(ValueError):
        readers.load_config(str(tmp_path / "two.json"))


def test_harvest_tries_again_and_keeps_the_last(spark):
    pages, waits, failures = [[{"id": 1, "v": "a"}, {"id": 2, "v": "b"}], [{"id": 1, "v": "c"}], []], [], [1, 1, 0]

    def fetch(page):
        if failures and failures.pop(0):
            raise OSError("busy")
        return pages[page]

    assert readers.harvest(fetch, "id", wait=waits.append) == [{"id": 2, "v": "b"}, {"id": 1, "v": "c"}] and waits == [1.0, 2.0]
    failures[:] = [1] * 5
    with pytest.raises(OSError):
        readers.harvest(fetch, "id", wait=waits.append)


def test_named_files_classes_and_sidecars(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, "train", "x"), ("b", 0.25, "test", "y")], "t string, s double, split string, class string")
    names = writers.write_named(df, f"{tmp_path}/named", "split")
    assert sorted(n.rsplit("/", 1)[1] for n in names) == ["test-00000-of-00001.parquet", "train-00000-of-00001.parquet"]
    assert [tuple(r) for r in readers.read_splits(spark, {"train": names[1]}, ["t", "class"]).collect()] == [("a", "x", "train")]
    writers.write_by_class(df, f"{tmp_path}/classes", ["class", "split"], ["t", "s"], ["s"])
    out = spark.read.parquet(f"{tmp_path}/classes")
    assert dict(out.dtypes)["s"] == "float" and out.where("class = 'y' and split = 'test'").count() == 1
    assert writers.write_with_dropped(df.where("s > 0.3"), df.where("s <= 0.3"), f"{tmp_path}/kept", f"{tmp_path}/dropped") == {"kept": 1, "dropped": 1}
    facts = writers.with_provenance(df, {"run": "r1"})
    assert facts.first()["run"] == "r1"
    writers.write_report(facts.limit(1), f"{tmp_path}/report")
    writers.write_csv(facts, f"{tmp_path}/csv")
    assert spark.read.json(f"{tmp_path}/report").count() == 1 and spark.read.option("header", True).csv(f"{tmp_path}/csv").columns[-1] == "run"
    assert "| a | 1 |" in writers.markdown_table([{"x": "a", "n": 1}]) and r"a & 1 \\" in writers.latex_table([{"x": "a", "n": 1}])


def test_archives_are_checked(spark, tmp_path):
    for name, members in (("two", {"a.mk": "x\n", "b.mk": "x\n", "a.sq": "y\n"}), ("uneven", {"a.mk": "x\nz\n", "a.sq": "y\n"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m, text in members.items():
                z.writestr(m, text)
        with pytest.raises(Exception, match="members by side|line counts differ"):
            readers.aligned_archive(spark, str(tmp_path / f"{name}.zip"), (".mk", ".sq")).collect()
