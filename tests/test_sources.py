import json

from pyspark.sql import functions as F

from pairforge.operators.runs import best_run, results_table
from pairforge.sources import datasets, records, sinks
from pairforge.streaming import incremental

RECORD = {
    "config": {"method": "dpo", "batch_size": 4, "learning_rate": 3e-07, "num_epochs": 1, "beta": 0.1},
    "metrics": {"bleu_score": 0.5, "train_loss": 0.6, "eval_loss": None, "training_time": 90.0},
    "system": {"gpu": "x", "timestamp": "2025-01-01T00:00:00"},
}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_task_filter_reaches_the_scan(spark, sf, physical):
    df = datasets.of_task(datasets.load_split(spark, f"{sf}/documents.parquet"), "en", "lang").select("doc_id")
    assert "EqualTo(lang,en)" in physical(df)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in physical(df)


def test_split_is_a_partition(spark, tmp_path, physical):
    path = str(tmp_path / "d")
    spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("validation").alias("split")).write.partitionBy("split").parquet(path)
    train = datasets.load_split(spark, path, "train")
    assert train.count() == 7
    assert "PartitionFilters: [isnotnull(split" in physical(train)
    assert {r["split"]: r["n_rows"] for r in datasets.split_counts(datasets.load_split(spark, path), "split").collect()} == {
        "train": 7, "validation": 3
    }


def test_records_of_many_folders(spark, tmp_path):
    write(tmp_path / "dpo_a" / "results.json", json.dumps(RECORD, indent=2))
    write(tmp_path / "sft_b_bs4_lr1e-5" / "results.json", json.dumps({"metrics": {"bleu_score": 0.7}}, indent=2))
    write(tmp_path / "broken" / "results.json", "{")
    found = records.read_records(spark, f"{tmp_path}/*/results.json")
    good = records.good_records(found)
    assert good.count() == 2 and records.bad_records(found).count() == 1
    assert {r["experiment_name"] for r in good.collect()} == {"dpo_a", "sft_b_bs4_lr1e-5"}
    bad = records.bad_records(found).collect()
    assert [(r["experiment_name"], r["content"]) for r in bad] == [("broken", "{")]
    table = results_table(records.runs_of(good))
    best = best_run(table).first()
    assert best["experiment"] == "sft_b_bs4_lr1e-5"
    assert best["checkpoint_path"].endswith("/sft_b_bs4_lr1e-5")


def test_records_get_system_facts(spark, tmp_path):
    path = str(tmp_path / "r")
    one = spark.range(1).select(F.lit("a").alias("experiment_name"), F.struct(F.lit("sft").alias("method")).alias("config"), F.struct(F.lit(0.5).alias("bleu_score")).alias("metrics"))
    records.write_records(one, path)
    records.write_records(one, path)
    rows = records.read_records(spark, path, lines=True).collect()
    assert len(rows) == 2
    assert rows[0]["system"]["spark_version"] and rows[0]["system"]["timestamp"]


def test_logs_of_three_kinds(spark, tmp_path):
    log = [
        {"loss": 0.9, "rewards/chosen": 1.5, "epoch": 0.1, "step": 100},
        {"eval_loss": 0.8, "eval_rewards/margins": -0.1, "epoch": 0.1, "step": 100},
        {"train_runtime": 5.0, "train_loss": 0.7, "epoch": 1.0, "step": 172},
    ]
    write(tmp_path / "dpo_a" / "training_history.json", json.dumps(log, indent=2))
    rows = records.read_logs(spark, f"{tmp_path}/*/training_history.json").orderBy("step", "kind").collect()
    assert [(r["experiment_name"], r["kind"], r["step"]) for r in rows] == [
        ("dpo_a", "eval", 100), ("dpo_a", "train", 100), ("dpo_a", "final", 172)
    ]
    assert rows[0]["eval_rewards_margins"] == -0.1 and rows[1]["rewards_chosen"] == 1.5


def test_artifacts(spark, tmp_path):
    write(tmp_path / "a" / "results.json", "x" * 10)
    write(tmp_path / "a" / "weights.bin", "x" * 99)
    write(tmp_path / "a" / "final_model" / "config.json", "x" * 5)
    write(tmp_path / "a" / "final_model" / "model.bin", "x" * 99)
    write(tmp_path / "b" / "README.md", "x")
    listing = records.artifacts(spark, str(tmp_path))
    assert {r["run"]: (r["n_files"], r["total_bytes"]) for r in records.artifact_sizes(listing).collect()} == {
        "a": (2, 15), "b": (1, 1)
    }
    assert records.final_models(listing).collect() == [("a",)]


def test_results_csv_spells_out_unknowns(spark, tmp_path):
    runs = spark.createDataFrame(
        [("x", "p", None, None, None, None, 0.1, 0.2, None, 60.0), ("dpo_y_lr1e-7", "q", "dpo", 4, 1e-07, 1, 0.2, 0.2, 0.3, 60.0)],
        "experiment string, checkpoint_path string, cfg_method string, cfg_batch_size int, cfg_learning_rate double, "
        "cfg_num_epochs int, bleu_score double, train_loss double, eval_loss double, training_time double",
    )
    table, path = results_table(runs), str(tmp_path / "csv")
    sinks.write_results_csv(table, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert any(line.startswith("x,unknown,unknown,unknown,SFT,-,1,") for line in lines)
    assert lines[0].startswith("Experiment,Base Method,Batch Size,SFT LR,Final Method,Final LR,Epochs,BLEU Score")
    back = sinks.read_results_csv(spark, path, table.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))


def test_pointer(spark, tmp_path):
    path = str(tmp_path / "best")
    records.write_pointer(spark.createDataFrame([("a/b",)], "checkpoint_path string"), path)
    assert records.read_pointer(spark, path).first()["best_model_path"] == "a/b"


def test_sample_is_the_first_hundred(spark):
    pairs = spark.range(1000).select((F.col("id") * 2).alias("k"), *[F.lit("x").alias(c) for c in ("prompt", "chosen", "rejected")])
    rows = sinks.sample(pairs, "k").collect()
    assert [r["entry_number"] for r in rows] == list(range(100))


def candidate(spark, path, ids):
    spark.createDataFrame(
        [(i, "s", "target text", "target text", None if i % 3 == 0 else "quite different") for i in ids],
        "pair_id bigint, src string, tgt string, pred1 string, pred2 string",
    ).coalesce(1).write.mode("append").parquet(path)


def test_build_stops_and_goes_on(spark, tmp_path, physical):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "pair_id bigint, src string, tgt string, pred1 string, pred2 string"

    def run():
        stream = incremental.candidate_stream(spark, src, schema, 1)
        incremental.append_judged(stream, out, state, "pair_id").awaitTermination()
        kept = sorted(r["pair_id"] for r in incremental.pairs_so_far(spark, out, "pair_id").collect())
        return kept, {r["status"]: r["n"] for r in incremental.progress(spark, out).collect()}

    candidate(spark, src, range(0, 6))
    assert run() == ([1, 2, 4, 5], {"empty": 2, "kept": 4})
    candidate(spark, src, range(6, 9))
    candidate(spark, src, range(9, 12))
    assert run() == ([1, 2, 4, 5, 7, 8, 10, 11], {"empty": 4, "kept": 8})
    assert run() == ([1, 2, 4, 5, 7, 8, 10, 11], {"empty": 4, "kept": 8})
    assert "PartitionFilters: [isnotnull(status" in physical(incremental.pairs_so_far(spark, out))
    assert "chosen:string" not in physical(incremental.progress(spark, out))


def test_files_of_many_parts(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [("a/x.txt", i, f"{i},") for i in range(500)] + [("b/c/y.txt", 0, "é"), ("b/empty.txt", 0, None)]
    df = spark.createDataFrame(rows, "path string, at int, text string").repartition(7)
    made = {r["path"]: r["n_bytes"] for r in sinks.write_files(df, root, "at").collect()}
    assert (tmp_path / "out/a/x.txt").read_text() == "".join(f"{i}," for i in range(500))
    assert made == {"a/x.txt": 1890, "b/c/y.txt": 2, "b/empty.txt": 0}
    sinks.write_files(df.where("path = 'b/c/y.txt'"), root)
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["empty.txt", "x.txt", "y.txt"]


def test_logs_are_written_as_they_are_read(spark, tmp_path):
    rows = [("a", 0, 100, 0.5, None, 0.25), ("a", 1, 100, None, 0.75, None), ("b", 9, 200, 1.0, None, None)]
    schema = "experiment_name string, place int, step bigint, loss double, eval_loss double, `rewards/chosen` double"
    sinks.write_logs(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path), order="place")
    assert json.loads((tmp_path / "a" / "training_history.json").read_text()) == [
        {"step": 100, "loss": 0.5, "rewards/chosen": 0.25}, {"step": 100, "eval_loss": 0.75}
    ]
    write(tmp_path / "c" / "training_history.json", '[{"loss": 1.0}')
    write(tmp_path / "d" / "training_history.json", "[]")
    write(tmp_path / "e" / "training_history.json", " \n")
    documents = records.log_documents(spark, f"{tmp_path}/*/training_history.json")
    got = records.log_rows(documents).orderBy("experiment_name", "place").collect()
    assert [(r["experiment_name"], r["place"], r["kind"], r["rewards_chosen"]) for r in got] == [
        ("a", 0, "train", 0.25), ("a", 1, "eval", None), ("b", 0, "train", None)
    ]
    assert sorted(r["experiment_name"] for r in records.bad_logs(documents).collect()) == ["c", "e"]


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        write(tmp_path / f"run{i}" / "results.json", json.dumps(RECORD))
    found = records.read_records(spark, f"{tmp_path}/*/results.json")
    assert found.rdd.getNumPartitions() < 50 and found.count() == 200


def test_config_documents_keep_nulls(spark, tmp_path):
    plan = spark.createDataFrame([("r1", "a", None, 0.5), ("r2", "a", 3, None)], "f string, experiment_name string, beta int, bleu double")
    sinks.write_config_documents(plan, str(tmp_path), "f")
    assert json.loads((tmp_path / "r1" / "training_config.json").read_text()) == {"experiment_name": "a", "beta": None, "bleu": 0.5}
    got = records.read_configs(spark, f"{tmp_path}/*/training_config.json", "experiment_name string, beta int, bleu double")
    assert sorted(map(tuple, got.collect()), key=str) == [("r1", "a", None, 0.5), ("r2", "a", 3, None)]


def test_allow_list_is_a_table(spark, tmp_path):
    for name in ("results.json", "notes.txt", "final_model/config.json", "final_model/results.json", "config.json"):
        write(tmp_path / "top" / "run" / name, "12345")
    listing = records.files_below(spark, str(tmp_path))
    assert {(r["top"], r["run"]) for r in listing.collect()} == {("top", "run")}
    names = records.allow_list(spark)
    assert sorted(r["file"] for r in records.allowed(listing, names).collect()) == ["config.json", "results.json"]
    more = names.unionByName(spark.createDataFrame([(False, "notes.txt"), (False, "notes.txt")], names.schema))
    assert records.sizes_by(records.allowed(listing, more), "top").collect() == [("top", 3, 15)]


def _candidates(spark, path, first, n):
    rows = [(i, "s", "target text", "target texts" if i % 3 else "", "something else") for i in range(first, first + n)]
    schema = "pair_id bigint, src string, tgt string, pred1 string, pred2 string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_versions_are_read_while_the_build_goes_on(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def build():
        schema = spark.read.parquet(source).schema
        stream = incremental.candidate_stream(spark, source, schema, 1)
        incremental.build_by_batch(stream, out, state, "pair_id").awaitTermination()

    for k in range(2):
        _candidates(spark, source, 10 * k, 10)
    build()
    # A later batch that was not finished: rows without counts.
    spark.read.parquet(f"{out}/rows/batch=1").write.parquet(f"{out}/rows/batch=2")
    assert incremental.snapshot(spark, out, 5).count() == 20
    assert incremental.snapshot(spark, out, 0).count() == 10
    assert incremental.snapshot(spark, out, -1).count() == 0
    _candidates(spark, source, 20, 10)
    build()  # goes on with the third batch and overwrites what was unfinished
    progress = incremental.progress_by_batch(spark, out).orderBy("batch_id").collect()
    kept = [sum(i % 3 > 0 for i in range(10 * (k + 1))) for k in range(3)]
    assert [(r["batch_id"], r["processed"], r["successful"]) for r in progress] == [
        (k, 10 * (k + 1), kept[k]) for k in range(3)
    ]
    ids = {r["pair_id"] for r in incremental.snapshot(spark, out, 2).collect()}
    assert ids == set(range(30))
    assert [incremental.version_at(spark, out, n) for n in (9, 10, 29, 30, 99)] == [-1, 0, 1, 2, 2]
    # What was counted while it was written is what is there.
    for k in range(3):
        rows = spark.read.parquet(f"{out}/rows/batch={k}").groupBy("status").count().collect()
        seen = incremental.batch_counts(spark, out).where(f"batch = {k} AND n > 0").select("status", "n").collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, seen))


def test_written_files_are_read_without_listing(spark, tmp_path, physical):
    root = str(tmp_path / "out")
    rows = [(f"r{i}/results.json", json.dumps(RECORD) if i % 10 else "{") for i in range(300)] + [("e/results.json", " ")]
    rows += [("t/r1/final_model/config.json", "123"), ("t/r1/notes.txt", "")]
    written = sinks.write_files(spark.createDataFrame(rows, "path string, text string"), root)
    found = records.read_records(spark, root, written=written.where("path LIKE '%results.json'"))
    assert "MapInArrow" in physical(found) and "FileScan text" not in physical(found)
    assert records.good_records(found).count() == 270 and records.bad_records(found).count() == 30
    assert {r["experiment_dir"] for r in found.where("experiment_name = 'r7'").collect()} == {f"{root}/r7"}
    gone = spark.createDataFrame([("t/r1/lost.txt", 9)], "path string, n_bytes bigint")
    listing = records.files_below(spark, root, written.where("path LIKE 't/%'").unionByName(gone))
    assert "binaryFile" not in physical(listing)
    assert sorted(map(tuple, listing.collect())) == [("t", "r1", "config.json", True, 3), ("t", "r1", "notes.txt", False, 0)]


def test_queries_on_named_files_list_none(spark, sf, physical):
    from pairforge.queries.catalog import QUERIES

    for name in ("config_documents", "artifact_listing", "log_files", "log_files_bad", "record_folders"):
        plan = physical(QUERIES[name](spark, sf))
        assert "FileScan text" not in plan and "binaryFile" not in plan, name


def test_a_version_may_be_many_files(spark, sf):
    from pairforge.queries import catalog

    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        out = catalog._versions(spark, sf)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = spark.read.parquet(f"{out}/rows").select("batch", (F.col("pair_id") % 4).alias("k")).distinct().collect()
    assert sorted((int(r["batch"]), r["k"]) for r in rows) == [(k, k) for k in range(catalog.VERSIONS)]
