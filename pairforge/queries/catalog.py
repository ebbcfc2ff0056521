"""The registered queries. Each takes a session and a folder of tables."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairforge.functions import names, text
from pairforge.functions.words import words
from pairforge.operators import (
    bleu, generate, logs, packing, position, preference, rewards, runs, tokens,
)
from pairforge.plans import grid, outcomes
from pairforge.queries import views
from pairforge.sources import datasets, records, sinks
from pairforge.streaming import incremental
from pairforge.session import fresh_path, stored

# Sizes for the test tables, small enough that every step is reached.
BATCH = 8
LIMIT = 256
VERSIONS = 4
# Every new file belongs to one batch.
ALL_FILES = (1 << 31) - 1


def joined(ids: str | Column) -> Column:
    """An array as one string, which both engines hash alike."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- datasets and text -------------------------------------------------------

def task_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = datasets.load_split(spark, f"{sf}/documents.parquet")
    return datasets.of_task(docs, "en", "lang").select("doc_id", "lang", "text")


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.split_counts(views.table(spark, sf, "documents"), "lang", "source")


def format_train_text(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.pairs(spark, sf)
    return pairs.select("pair_id", text.training_text(F.col("src"), F.col("tgt")).alias("text"))


def format_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return views.pairs(spark, sf).select("pair_id", text.prompt_text(F.col("src")).alias("prompt"))


def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    return views.outputs(spark, sf).select("pair_id", text.answer(F.col("output")).alias("answer"))


def extract_answer_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return views.outputs(spark, sf).select(
        "pair_id", text.answer(F.col("output"), F.col("src")).alias("answer")
    )


# --- preference build --------------------------------------------------------

def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return preference.classify(views.candidates(views.pairs(spark, sf)), spread_by="pair_id")


def pref_status(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.pairs(spark, sf)
    stored_texts = views.candidates(pairs).select("pair_id", "pred1", "pred2")
    sources = pairs.withColumn("tgt", views.fold(F.col("tgt")))
    matched = generate.with_stored_candidates(sources, stored_texts, "pair_id")
    ratio = text.length_ratio(F.col("chosen"), F.col("rejected"))
    return preference.classify(matched, spread_by="pair_id").select(
        "pair_id", "status", F.col("chosen_dist").cast("bigint").alias("chosen_dist"),
        F.col("rejected_dist").cast("bigint").alias("rejected_dist"),
        F.round(ratio, 9).alias("length_ratio"),
    )


def pref_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return preference.outcome_counts(_judged(spark, sf))


def pref_report(spark: SparkSession, sf: str) -> DataFrame:
    report = preference.outcome_report(_judged(spark, sf))
    return rounded(report, "mean_chosen_dist", "mean_rejected_dist", "success_rate")


def pref_record(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "pref-record")
    began = time.perf_counter()
    report = stored(preference.outcome_report(_judged(spark, sf)), "pref-report")
    record = records.preference_record(
        report, time.perf_counter() - began, generate.SETTINGS, "final_model",
        "conversations", generate.BATCH, preference.MIN_GAP, preference.MAX_RATIO, preference.MIN_RATIO,
    )
    records.write_records(record, path)
    counters = "final_dataset_size bigint, total_processed bigint, successful bigint, total_chosen_dist bigint"
    setting = "struct<temperature:double,do_sample:boolean>"
    schema = (
        f"config struct<generation_configs:struct<config_2:{setting}>,filtering:struct<min_length_ratio:double>>, "
        f"metrics struct<{counters}>"
    )
    return spark.read.schema(schema).json(path).select(
        "config.generation_configs.config_2.temperature", "config.filtering.min_length_ratio", "metrics.*"
    )


def pref_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return preference.kept_pairs(_judged(spark, sf), "pair_id")


def pref_failed(spark: SparkSession, sf: str) -> DataFrame:
    judged = preference.classify(views.candidates(views.asked(spark, sf)), spread_by="pair_id")
    return preference.failed_rows(judged).select("pair_id", "src", "status")


def _saved_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "pairs")
    sinks.write_preferences(pref_pairs(spark, sf), path)
    return datasets.read_preferences(spark, path)


def pref_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.numbered(_saved_pairs(spark, sf), "pair_id")


def pref_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.sample(preference.kept_pairs(_judged(spark, sf), "pair_id"), "pair_id")


def pref_from_hook(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.pairs(spark, sf).select(
        "pair_id", views.fold(F.col("src")).alias("src"), views.fold(F.col("tgt")).alias("tgt")
    )
    made = generate.with_candidates(pairs, generate.letter_editor)
    return preference.classify(made, error="gen_error", spread_by="pair_id").select(
        "pair_id", "pred1", "pred2", "gen_error", "status"
    )


def running_success(spark: SparkSession, sf: str) -> DataFrame:
    candidates = views.candidates(views.pairs(spark, sf))
    rates = preference.running_success(candidates, "pair_id", BATCH, 4, spread_by="pair_id")
    return rounded(rates, "success_rate")


def _streamed(spark: SparkSession, sf: str) -> str:
    stream = _candidate_files(spark, sf)
    out, state = fresh_path(spark, "stream-judged"), fresh_path(spark, "stream-state")
    incremental.append_judged(stream, out, state, "pair_id").awaitTermination()
    return out


def pref_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.pairs_so_far(spark, _streamed(spark, sf), "pair_id")


def progress_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The running totals after the last batch of a build."""
    out, state = fresh_path(spark, "build"), fresh_path(spark, "build-state")
    incremental.build_by_batch(_candidate_files(spark, sf), out, state, "pair_id").awaitTermination()
    last = incremental.progress_by_batch(spark, out).orderBy(F.desc("batch_id")).limit(1)
    return rounded(last.select("processed", "successful", "success_rate"), "success_rate")


def progress_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.progress(spark, _streamed(spark, sf))


def _candidate_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "candidates")
    made = views.candidates(views.pairs(spark, sf))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.repartition(files, "pair_id").write.parquet(path)
    return incremental.candidate_stream(spark, path, made.schema, max(1, files // 4))


def _versions(spark: SparkSession, sf: str) -> str:
    """A build of four batches: the pairs by their id modulo 4, in that order.

    The build stops after each batch and goes on when the next files are
    there, so a version may be any number of files, read by as many tasks.
    """
    path, out, state = (fresh_path(spark, n) for n in ("candidates", "build", "build-state"))
    made = stored(views.candidates(views.pairs(spark, sf)), "candidates")
    for k in range(VERSIONS):
        made.where(F.col("pair_id") % VERSIONS == k).write.mode("append").parquet(path)
        stream = incremental.candidate_stream(spark, path, made.schema, ALL_FILES)
        incremental.build_by_batch(stream, out, state, "pair_id", spread_by="pair_id").awaitTermination()
    return out


def progress_series(spark: SparkSession, sf: str) -> DataFrame:
    """Progress after every batch, from the counts seen while each was written."""
    return rounded(incremental.progress_by_batch(spark, _versions(spark, sf)), "success_rate")


def pref_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs kept up to and with the second of four versions."""
    return preference.kept_pairs(incremental.snapshot(spark, _versions(spark, sf), 1), "pair_id")


def pref_snapshot_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts of the last version within 60 percent of the judged rows."""
    out = _versions(spark, sf)
    total = incremental.progress_by_batch(spark, out).agg(F.max("processed")).first()[0]
    version = incremental.version_at(spark, out, total * 6 // 10)
    counts = preference.outcome_counts(incremental.snapshot(spark, out, version))
    return counts.withColumn("version", F.lit(version).cast("bigint"))


def _refusing() -> generate.Generator:
    """The letter editor, but it refuses some prompts by their length."""
    edit = generate.letter_editor()

    def fn(prompts: list[str], setting: dict) -> list[str]:
        if any(len(p) % 5 == 0 for p in prompts):
            raise ValueError("refused")
        return edit(prompts, setting)

    return fn


def pref_hook_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the generator fails on keep its error and are judged so."""
    pairs = views.pairs(spark, sf).select(
        "pair_id", views.fold(F.col("src")).alias("src"), views.fold(F.col("tgt")).alias("tgt")
    )
    made = generate.with_candidates(pairs, lambda: _refusing())
    judged = preference.classify(made, error="gen_error", spread_by="pair_id")
    return judged.select("pair_id", "pred1", "gen_error", "status")


# --- positions ---------------------------------------------------------------

def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")


def split_90_10(spark: SparkSession, sf: str) -> DataFrame:
    return position.split_by_position(_documents(spark, sf), "doc_id")


def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return position.seeded_shuffle(_documents(spark, sf), "doc_id", 42)


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return position.with_batch(_documents(spark, sf), "doc_id", 128)


# --- BLEU --------------------------------------------------------------------

def bleu_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.document_words(spark, sf)
    return docs.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def bleu_words_unicode(spark: SparkSession, sf: str) -> DataFrame:
    """Words of texts whose plain spaces are others for each third document."""
    odd = F.element_at(F.array(F.lit("\u2003"), F.lit("\x1f"), F.lit("\u3000")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = views.documents(spark, sf).select("doc_id", F.replace("text", F.lit(" "), odd).alias("text"))
    found = tokens.add_words(docs, "text")
    return found.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.array_join(words(F.lit("a\x85b")), " ").alias("next_line"))


def bleu_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return bleu.row_counts(views.edited_documents(spark, sf), "doc_id", "pred", "text")


def bleu_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.edited_documents(spark, sf)
    return rounded(bleu.corpus_bleu(docs, "doc_id", "pred", "text", ["lang"]), "bleu")


def bleu_corpus(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.pairs(spark, sf)
    predictions = views.candidates(pairs).select("pair_id", "pred1")
    targets = pairs.select("pair_id", text.references(views.fold(F.col("tgt"))).alias("references"))
    matched = bleu.with_targets(predictions, targets, "pair_id")
    return rounded(bleu.corpus_bleu(matched, "pair_id", "pred1", "references"), "bleu")


def bleu_two_references(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.candidates(views.pairs(spark, sf)).select(
        "pair_id", "pred1", F.array("pred2", "tgt").alias("refs")
    )
    return rounded(bleu.corpus_bleu(refs, "pair_id", "pred1", "refs"), "bleu")


def bleu_running(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bleu.running_bleu(views.edited_documents(spark, sf), "doc_id", "pred", "text", 100), "bleu")


# --- tokens and packing ------------------------------------------------------

def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.with_specials(tokens.vocabulary(views.document_words(spark, sf)))


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return views.encoded_documents(spark, sf).select("doc_id", joined("ids").alias("ids"))


def _word_lengths(texts: list[str]) -> list[list[int]]:
    return [[len(w) for w in t.split(" ")] for t in texts]


def token_ids_hook(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    encoded = tokens.encode_with(docs, "text", lambda: _word_lengths)
    return encoded.select("doc_id", joined("ids").alias("ids"))


def truncate(spark: SparkSession, sf: str) -> DataFrame:
    encoded, vocabulary = views.encoded_pairs(spark, sf)
    sep = views.token_id(vocabulary, text.SEP)
    return encoded.withColumn("sep", sep).select(
        "pair_id", joined(tokens.truncate(F.col("ids"))).alias("ids"),
        tokens.separator_lost(F.col("ids"), F.col("sep")).alias("sep_lost"),
    )


def pref_truncate(spark: SparkSession, sf: str) -> DataFrame:
    encoded, vocabulary = views.encoded_pairs(spark, sf)
    placed = encoded.withColumn("sep", views.token_id(vocabulary, text.SEP)).withColumn(
        "at", tokens.last_place(F.col("ids"), F.col("sep"))
    )
    prompt = F.slice("ids", F.lit(1), F.col("at"))
    answer = F.slice("ids", F.col("at") + 1, F.size("ids"))
    cut, rest = tokens.truncate_pair(prompt, answer)
    return placed.select("pair_id", joined(cut).alias("prompt"), joined(rest).alias("completion"))


def _batched_pairs(spark: SparkSession, sf: str) -> DataFrame:
    encoded, vocabulary = views.encoded_pairs(spark, sf)
    return position.with_batch(encoded, "pair_id", BATCH).withColumns(
        {
            "pad": views.token_id(vocabulary, text.PAD),
            "sep": views.token_id(vocabulary, text.SEP),
        }
    )


def left_pad(spark: SparkSession, sf: str) -> DataFrame:
    return packing.left_pad(_batched_pairs(spark, sf), F.col("pad")).select(
        "pair_id", "batch_id", joined("input_ids").alias("input_ids"),
        joined("attention_mask").alias("attention_mask"),
    )


def completion_labels(spark: SparkSession, sf: str) -> DataFrame:
    padded = packing.left_pad(_batched_pairs(spark, sf), F.col("pad"))
    labels = packing.completion_labels(F.col("input_ids"), F.col("sep"), F.col("pad"))
    return padded.select("pair_id", joined(labels).alias("labels"))


def batch_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat = packing.flatten_batches(_batched_pairs(spark, sf), "pos")
    return flat.select(
        "batch_id",
        *[joined(c).alias(c) for c in ("input_ids", "position_ids", "labels", "cu_seqlens")],
    )


def pad_multiple(spark: SparkSession, sf: str) -> DataFrame:
    encoded, vocabulary = views.encoded_pairs(spark, sf)
    flat = packing.flatten_batches(position.with_batch(encoded, "pair_id", BATCH), "pos")
    padded = flat.withColumn("pad", views.token_id(vocabulary, text.PAD)).select(
        "batch_id", packing.pad_to_multiple(F.col("input_ids"), F.col("pad")).alias("ids")
    )
    return padded.select(
        "batch_id", F.size("ids").cast("bigint").alias("n"), joined("ids").alias("ids")
    )


def pack_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    encoded = stored(views.encoded_documents(spark, sf), "encoded")
    packed = packing.pack_wrapped(encoded, "doc_id", "ids", LIMIT)
    return packed.select(
        F.col("chunk").cast("bigint").alias("chunk"),
        *[joined(c).alias(c) for c in ("input_ids", "position_ids", "sequences", "lengths")],
    )


def pack_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    """All bins in one row: their tokens, the fullest, and whether they are few enough."""
    encoded = stored(views.encoded_documents(spark, sf), "encoded")
    packed = packing.pack_best_fit(encoded, "doc_id", "ids", LIMIT)
    tokens_ = F.sum(F.size("input_ids")).cast("bigint")
    return packed.agg(
        F.coalesce(tokens_, F.lit(0)).alias("n_tokens"),
        (F.max(F.size("input_ids")) <= LIMIT).alias("fits"),
        (F.count(F.lit(1)) <= F.floor(tokens_ * 1.05 / LIMIT) + 1).alias("near_the_bound"),
    )


def pack_best_fit_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Per document its ids put together from the bins again."""
    encoded = stored(views.encoded_documents(spark, sf), "encoded")
    packed = packing.pack_best_fit(encoded, "doc_id", "ids", LIMIT)
    ends = F.aggregate(
        "lengths", F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
    )
    cut = packed.withColumn("_ends", ends).select(
        F.explode(
            F.transform("lengths", lambda n, i: F.struct(
                F.get("sequences", i).alias("doc_id"), (n == LIMIT).alias("whole"), F.col("bin_id").alias("bin_id"),
                F.slice("input_ids", F.get("_ends", i) + 1, n).alias("ids"),
            ))
        ).alias("p")
    ).select("p.*")
    # Whole pieces are named after their place; what is left is the last piece.
    place = F.when(F.col("whole"), F.element_at(F.split("bin_id", "-"), -1).cast("int")).otherwise(F.lit((1 << 31) - 1))
    again = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "ids"))).alias("p"))
    return again.select("doc_id", joined(F.flatten("p.ids")).alias("ids"))


# --- runs --------------------------------------------------------------------

def _table(spark: SparkSession, sf: str) -> DataFrame:
    return runs.results_table(views.runs(spark, sf))


def run_names(spark: SparkSession, sf: str) -> DataFrame:
    experiments = views.runs(spark, sf).select("experiment")
    return experiments.select("experiment", names.parse_name(F.col("experiment")).alias("p")).select(
        "experiment", "p.*"
    )


def runs_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(runs.ranked_runs(_table(spark, sf)), "training_minutes")


def top5_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.display_row(runs.top_runs(_table(spark, sf)))


def best_run(spark: SparkSession, sf: str) -> DataFrame:
    return runs.best_run(_table(spark, sf)).select("experiment", "bleu_score", "checkpoint_path")


def best_run_by_phase(spark: SparkSession, sf: str) -> DataFrame:
    return runs.best_per_phase(_table(spark, sf))


def best_path_to_next_phase(spark: SparkSession, sf: str) -> DataFrame:
    table = _table(spark, sf)
    following = runs.in_phase(table, "dpo").select("experiment")
    return runs.with_best_path(following, table)


def summary_global(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        runs.summary(_table(spark, sf)), "mean_bleu", "std_bleu", "total_training_time"
    )


def summary_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(runs.summary_by_method(_table(spark, sf)), "mean_bleu")


def methods_in_order(spark: SparkSession, sf: str) -> DataFrame:
    table = _table(spark, sf)
    final = runs.in_order_of_appearance(table, "final_method").withColumn("kind", F.lit("final"))
    base = runs.in_order_of_appearance(table, "base_method").withColumn("kind", F.lit("base"))
    return final.unionByName(base)


def box_by_method(spark: SparkSession, sf: str) -> DataFrame:
    figures = runs.box_figures(_table(spark, sf))
    return rounded(figures, "low", "high", "q1", "median", "q3", "whisker_low", "whisker_high")


def box_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return runs.box_outliers(_table(spark, sf))


def score_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(runs.score_by_batch(_table(spark, sf)), "mean_bleu")


def score_by_lr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(runs.score_by_rate(_table(spark, sf)), "mean_bleu", "log10_lr")


def last_eval_loss(spark: SparkSession, sf: str) -> DataFrame:
    return logs.last_eval_loss(views.logs(spark, sf), "run_kind", "user_id", order="place")


def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        logs.learning_curve(views.logs(spark, sf), "run_kind", "user_id"), "train", "eval"
    )


def reward_metrics_dpo(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(views.logps(spark, sf), "sigmoid")


def reward_metrics_ipo(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(views.logps(spark, sf), "ipo")


def _metrics(pairs: DataFrame, loss: str) -> DataFrame:
    found = rewards.reward_metrics(pairs, "step", loss=loss)
    return rounded(found, *[c for c in found.columns if c not in ("step", "n_pairs")])


# --- plan --------------------------------------------------------------------

def _counted_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    return grid.step_counts(grid.grid(spark).withColumn("n_rows", rows.scalar()), F.col("n_rows"))


def step_plan(spark: SparkSession, sf: str) -> DataFrame:
    # Every tenth step, as the test tables are small.
    steps = grid.logged_steps(_counted_grid(spark, sf), every=10)
    return rounded(
        steps.select("experiment_name", "micro_batches", "steps", "step", "evaluates", "epoch"),
        "epoch",
    )


def grid_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid with the steps each run takes over the documents."""
    return _counted_grid(spark, sf)


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    found = stored(views.planned_runs(spark, sf), "runs")
    models = found.where(F.col("eval_loss").isNotNull()).select("run_id")
    # Folders with a model but no record, named after their planned run.
    planned = grid.grid(spark)
    unrecorded = planned.where(F.col("experiment_name").contains("bs64")).select(F.col("experiment_name").alias("run_id"))
    return outcomes.plan_outcomes(planned, found, models.unionByName(unrecorded))


def plan_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf)


def plan_missing(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.plan_missing(grid.grid(spark), views.planned_runs(spark, sf))


def plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.plan_counts(_outcomes(spark, sf))


def plan_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return grid.in_category_order(_outcomes(spark, sf), "run_id").select(
        "category_rank", "experiment_name", "run_id", "bleu_score"
    )


# --- sinks and readers -------------------------------------------------------

def pairs_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _saved_pairs(spark, sf).select("prompt", "chosen", "rejected")


def pairs_json(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "pairs-json")
    sinks.write_preferences_json(pref_pairs(spark, sf), path)
    return spark.read.schema("prompt string, chosen string, rejected string").json(path)


def numbered_json(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "numbered")
    sinks.write_numbered(pref_numbered(spark, sf), path)
    return spark.read.schema(
        "entry_number bigint, prompt string, chosen string, rejected string"
    ).json(path)


def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    table, path = _table(spark, sf), fresh_path(spark, "results")
    sinks.write_results_csv(table, path)
    return rounded(sinks.read_results_csv(spark, path, table.schema), "training_minutes")


def summary_json(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "summary")
    sinks.write_summary(_table(spark, sf), path)
    stats = "struct<count:bigint,best_bleu:double,mean_bleu:double,best_experiment:string>"
    schema = (
        "total_experiments bigint, best_experiment string, methods_tested array<string>, "
        f"base_methods_tested array<string>, method_stats map<string,{stats}>"
    )
    return spark.read.schema(schema).json(path).select(
        "total_experiments", "best_experiment",
        F.array_join("methods_tested", " ").alias("methods"),
        F.array_join("base_methods_tested", " ").alias("bases"),
        F.explode("method_stats").alias("method", "s"),
    ).select(
        "total_experiments", "best_experiment", "methods", "bases", "method",
        F.col("s.count").alias("n_runs"), F.col("s.best_bleu").alias("best_bleu"),
    )


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return views.runs(spark, sf).select(
        F.col("experiment").alias("experiment_name"),
        F.struct(
            F.col("cfg_method").alias("method"), F.col("cfg_batch_size").alias("batch_size"),
            F.col("cfg_learning_rate").alias("learning_rate"),
        ).alias("config"),
        F.struct("bleu_score", "train_loss", "eval_loss", "training_time").alias("metrics"),
    )


def run_records_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "records")
    records.write_records(_records(spark, sf), path)
    found = records.good_records(records.read_records(spark, path, lines=True))
    return records.runs_of(found).drop("checkpoint_path", "cfg_num_epochs")


def bad_records(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "records")
    written = _records(spark, sf)
    records.write_records(written, path)
    broken = F.concat(F.lit('{"experiment_name": "'), "experiment_name", F.lit('"'))
    written.where(F.col("metrics.eval_loss").isNull()).select(broken).write.mode("append").text(path)
    return records.bad_records(records.read_records(spark, path, lines=True)).select("content")


def best_pointer(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "pointer")
    records.write_pointer(runs.best_run(_table(spark, sf)), path)
    return records.read_pointer(spark, path)


def config_files(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_path(spark, "configs")
    planned = _outcomes(spark, sf).select(
        "experiment_name", "run_id", "training_type", "learning_rate", "effective_batch_size", "bleu_score"
    )
    sinks.write_configs(planned, root, "run_id")
    schema = (
        "experiment_name string, run_id string, training_type string, learning_rate double, "
        "effective_batch_size int, bleu_score double"
    )
    per_run = spark.read.schema(schema).json(f"{root}/runs").withColumn("file", F.lit("run"))
    whole = spark.read.schema(schema).json(f"{root}/all").withColumn("file", F.lit("all"))
    return per_run.unionByName(whole)


def artifact_sizes(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_path(spark, "configs")
    _outcomes(spark, sf).write.partitionBy("experiment_name").json(root)
    return records.artifact_sizes(records.artifacts(spark, root, run_files=None))


def _log_files(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """One log per run in a folder of its own, and a copy cut short for each tenth user.

    Returns their root and the table of the written files.
    """
    root = fresh_path(spark, "logs")
    name = F.concat("run_kind", F.lit("_u"), F.col("user_id").cast("string"))
    rows = views.logs(spark, sf).select(
        name.alias("experiment_name"), "place", "step", "loss", "eval_loss",
        F.when(F.col("kind") == "eval", F.col("eval_loss") / 2).alias("eval_rewards/margins"),
    )
    ends = rows.groupBy("experiment_name").agg(
        (F.max("place") + 1).alias("place"), F.max("step").alias("step"),
        F.count(F.lit(1)).cast("double").alias("train_runtime"), F.max("loss").alias("train_loss"),
    )
    whole = sinks.write_logs(rows.unionByName(ends, allowMissingColumns=True), root, order="place")
    broken = views.logs(spark, sf).where(F.col("user_id") % 10 == 0).select(name.alias("name")).distinct()
    path = F.concat("name", F.lit("_cut/training_history.json"))
    text_ = F.concat(F.lit('[{"loss": 1.0}, {"run": "'), "name")
    cut = sinks.write_files(broken.select(path.alias("path"), text_.alias("text")), root)
    return root, whole.unionByName(cut)


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of the logs, read back from their files."""
    rows = records.read_logs(spark, *_log_files(spark, sf))
    return rows.select(
        "experiment_name", F.col("place").cast("bigint").alias("place"), "kind", "step", "loss", "eval_loss",
        "eval_rewards_margins", "train_runtime", "train_loss",
    )


def log_files_bad(spark: SparkSession, sf: str) -> DataFrame:
    bad = records.bad_logs(records.log_documents(spark, *_log_files(spark, sf)))
    return bad.select("experiment_name", "content")


def log_files_last_eval(spark: SparkSession, sf: str) -> DataFrame:
    return logs.last_eval_loss(records.read_logs(spark, *_log_files(spark, sf)), "experiment_name", order="place")


def log_files_curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = records.read_logs(spark, *_log_files(spark, sf))
    return rounded(logs.learning_curve(rows, "experiment_name"), "train", "eval")


def _record_folders(spark: SparkSession, sf: str) -> DataFrame:
    """A folder per run with its record; those without ``eval_loss`` are broken."""
    root = fresh_path(spark, "folders")
    whole = F.to_json(F.struct("config", "metrics"))
    cut = F.concat(F.lit('{"config": {"method": "'), "config.method")
    rows = _records(spark, sf).select(
        F.concat("experiment_name", F.lit("/results.json")).alias("path"),
        F.when(F.col("metrics.eval_loss").isNull(), cut).otherwise(whole).alias("text"),
    )
    return records.read_records(spark, root, written=sinks.write_files(rows, root))


def record_folders(spark: SparkSession, sf: str) -> DataFrame:
    good = records.good_records(_record_folders(spark, sf))
    return records.runs_of(good).drop("checkpoint_path", "cfg_num_epochs")


def record_folders_bad(spark: SparkSession, sf: str) -> DataFrame:
    return records.bad_records(_record_folders(spark, sf)).select("experiment_name", "content")


def _artifact_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of every run, also some that are not to be published, as a listing."""
    root = fresh_path(spark, "artifacts")
    top = F.when(F.col("cfg_method").isin("dpo", "ipo"), "preference").otherwise("sft")
    trained = F.col("eval_loss").isNotNull()
    files = F.array(
        *[F.struct(F.lit(n).alias("file"), t.alias("text")) for n, t in (
            ("results.json", F.concat(F.lit("run "), "experiment")), ("notes.txt", F.col("experiment")),
            ("final_model/config.json", F.when(trained, F.concat(F.lit('{"method": "'), "cfg_method", F.lit('é"}')))),
            ("final_model/weights.bin", F.when(trained, F.repeat(F.lit("w"), 99))),
        )]
    )
    rows = views.runs(spark, sf).select(top.alias("top"), "experiment", F.inline(files)).where(F.col("text").isNotNull())
    path = F.concat_ws("/", "top", "experiment", "file")
    return records.files_below(spark, root, sinks.write_files(rows.select(path.alias("path"), "text"), root))


def artifact_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Published files and bytes of each run and of each top folder, by the allow-list."""
    published = records.allowed(_artifact_files(spark, sf), records.allow_list(spark))
    per_run = records.sizes_by(published, "top", "run")
    return per_run.unionByName(records.sizes_by(published, "top").withColumn("run", F.lit("all")))


def config_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of the written configs; the model flag comes from the listed files."""
    found = stored(views.planned_runs(spark, sf), "runs")
    models = records.final_models(_artifact_files(spark, sf)).withColumnRenamed("run", "run_id")
    planned = outcomes.plan_outcomes(grid.grid(spark), found, models)
    root = fresh_path(spark, "config-documents")
    folder = F.coalesce("run_id", "experiment_name")
    written = sinks.write_config_documents(planned.withColumn("folder", folder), root, "folder")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in planned.schema.fields)
    return records.read_configs(spark, root, schema, written)


def summary_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The means, deviation and total of the written summary."""
    path = fresh_path(spark, "summary")
    sinks.write_summary(_table(spark, sf), path)
    schema = (
        "best_bleu double, worst_bleu double, mean_bleu double, std_bleu double, total_training_time double, "
        "method_stats map<string,struct<mean_bleu:double,best_experiment:string>>"
    )
    rows = spark.read.schema(schema).json(path)
    flat = rows.select(
        "best_bleu", "worst_bleu", "mean_bleu", "std_bleu", "total_training_time",
        F.explode("method_stats").alias("method", "s"),
    ).select("*", F.col("s.mean_bleu").alias("method_mean"), "s.best_experiment").drop("s")
    return rounded(flat, "mean_bleu", "std_bleu", "total_training_time", "method_mean")


QUERIES = {
    f.__name__: f
    for f in (
        task_filter, split_counts, format_train_text, format_prompt, extract_answer,
        extract_answer_prompt, pref_status, pref_outcomes, pref_report, pref_record, pref_pairs, pref_failed,
        pref_numbered, pref_sample, pref_from_hook, running_success, pref_incremental,
        progress_incremental, progress_batches, split_90_10, seeded_shuffle, batches, bleu_words, bleu_ngrams,
        bleu_by_lang, bleu_corpus, bleu_two_references, bleu_running, vocab, token_ids,
        token_ids_hook, truncate, pref_truncate, left_pad, completion_labels, batch_flatten,
        pad_multiple, pack_wrapped, pack_best_fit, pack_best_fit_cover, run_names, runs_table,
        top5_runs, best_run, best_run_by_phase, best_path_to_next_phase, summary_global,
        summary_by_method, methods_in_order, box_by_method, box_outliers, score_by_batch,
        score_by_lr, last_eval_loss, learning_curve, reward_metrics_dpo, reward_metrics_ipo,
        step_plan, grid_steps, plan_outcomes, plan_missing, plan_counts, plan_ordered,
        pairs_parquet, pairs_json, numbered_json, csv_sink, summary_json, run_records_roundtrip,
        bad_records, best_pointer, config_files, artifact_sizes, progress_series, pref_snapshot,
        pref_snapshot_by_rows, pref_hook_failures, bleu_words_unicode, log_files, log_files_bad,
        log_files_last_eval, log_files_curve, record_folders, record_folders_bad, artifact_listing,
        config_documents, summary_figures,
    )
}
