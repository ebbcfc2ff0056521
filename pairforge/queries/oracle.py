"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from pairforge.functions.text import EOS, PAD, SEP, WHITESPACE
from pairforge.functions.words import UNESCAPE
from pairforge.plans.grid import CATEGORIES, FAMILIES
from pairforge.queries import views

BATCH = 8
LIMIT = 256
#: What Python's split() parts words at, by its own account.
SPACES = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]+"
BEST = "bleu_score DESC, experiment"

# The published 13a rules in RE2 form.
SPACING = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def words(x: str) -> str:
    t = f"replace(replace(replace({x}, '<skipped>', ''), concat('-', chr(10)), ''), chr(10), ' ')"
    for entity, char in UNESCAPE:
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"concat(' ', {t}, ' ')"
    for pattern, spaced in SPACING:
        t = f"regexp_replace({t}, '{pattern}', '{spaced}', 'g')"
    return rf"list_filter(regexp_split_to_array({t}, '{SPACES}'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def fold(x: str) -> str:
    return rf"regexp_replace({x}, '[^\x00-\x7F]', '?', 'g')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


# --- views -------------------------------------------------------------------

ASKED = "asked AS (" + views.ASKED_SQL.format(conversations="conversations") + ")"
PAIRS = ASKED + ",\npairs AS (SELECT * FROM asked WHERE tgt IS NOT NULL)"


def cands(source: str) -> str:
    spelt = "replace(g, 'e', 'a')"
    return f"""
cands AS (
  SELECT pair_id, src, g AS tgt,
    CASE pair_id % 7 WHEN 0 THEN '' WHEN 1 THEN g ELSE {spelt} END AS pred1,
    CASE pair_id % 7 WHEN 1 THEN g WHEN 2 THEN {spelt} WHEN 3 THEN concat({spelt}, 'x')
      WHEN 4 THEN regexp_replace(g, '[a-z ]', '', 'g')
      ELSE replace({spelt}, 'th', 'd') END AS pred2
  FROM (SELECT pair_id, src, {fold('tgt')} AS g FROM {source}) t)"""


def judged(source: str = "cands", error: str = "false") -> str:
    return f"""
early AS (
  SELECT *, CASE WHEN src IS NULL OR tgt IS NULL OR {error} THEN 'error'
    WHEN coalesce(pred1, '') = '' OR coalesce(pred2, '') = '' THEN 'empty'
    WHEN pred1 = pred2 THEN 'identical' END AS early
  FROM {source}),
measured AS (
  SELECT *, CASE WHEN early IS NULL THEN levenshtein(pred1, tgt) END AS d1,
    CASE WHEN early IS NULL THEN levenshtein(pred2, tgt) END AS d2 FROM early),
picked AS (
  SELECT *, CASE WHEN d1 < d2 THEN pred1 WHEN early IS NULL THEN pred2 END AS chosen,
    CASE WHEN d1 < d2 THEN pred2 WHEN early IS NULL THEN pred1 END AS rejected,
    least(d1, d2) AS chosen_dist, greatest(d1, d2) AS rejected_dist FROM measured),
rated AS (
  SELECT *, CAST(length(chosen) AS DOUBLE) / length(rejected) AS ratio FROM picked),
judged AS (
  SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN abs(d1 - d2) < 2 THEN 'small_diff'
    WHEN ratio > CAST(3.0 AS DOUBLE) OR ratio < CAST(0.33 AS DOUBLE) THEN 'length_ratio'
    ELSE 'kept' END AS status FROM rated)"""


JUDGED = f"WITH {PAIRS},{cands('pairs')},{judged()}\n"
KEPT = "SELECT src AS prompt, chosen, rejected FROM judged WHERE status = 'kept'"
OUTCOME_COUNTS = JUDGED + (
    "SELECT status, count(*) AS n, "
    "CAST(coalesce(sum(chosen_dist) FILTER (status = 'kept'), 0) AS BIGINT) AS chosen_dist, "
    "CAST(coalesce(sum(rejected_dist) FILTER (status = 'kept'), 0) AS BIGINT) AS rejected_dist "
    "FROM judged GROUP BY status"
)
NUMBERED = (
    "SELECT row_number() OVER (ORDER BY pair_id) - 1 AS entry_number, src AS prompt, chosen, "
    "rejected FROM judged WHERE status = 'kept'"
)

OUTPUTS = f"""WITH {PAIRS},
outputs AS (
  SELECT pair_id, src, concat(CASE WHEN pair_id % 2 = 1 THEN '{PAD}' ELSE '' END, src,
    CASE WHEN pair_id % 5 = 1 THEN '' ELSE '{SEP}' END,
    CASE WHEN pair_id % 5 = 0 THEN ' {SEP} ' ELSE ' ' END, tgt, chr(10), '{EOS}') AS output
  FROM pairs),
clean AS (
  SELECT *, {strip("replace(" + strip(f"replace(output, '{EOS}', '')") + f", '{PAD}', '')")} AS c
  FROM outputs)
"""


def answer(otherwise: str) -> str:
    after = strip(f"substr(c, strpos(c, '{SEP}') + {len(SEP)})")
    return (
        f"{OUTPUTS} SELECT pair_id, CASE WHEN contains(c, '{SEP}') THEN {after} "
        f"ELSE {otherwise} END AS answer FROM clean"
    )


# --- BLEU --------------------------------------------------------------------

def grams() -> str:
    """n-grams of all sides, as neighbours in word order."""
    parts = []
    for n in range(1, 5):
        run = " || chr(1) || ".join(["w", *[f"w{k}" for k in range(2, n + 1)]])
        last = "w" if n == 1 else f"w{n}"
        parts.append(f"SELECT id, {n} AS n, ref, {run} AS gram, ip, 1 - ip AS ir FROM runs_of_4 WHERE {last} IS NOT NULL")
    return " UNION ALL ".join(parts)


def counts(source: str, carry: str = "") -> str:
    """Row counts from ``id``, ``pred`` and ``refs`` (a list) of ``source``."""
    sums = ", ".join(
        [f"sum(CASE WHEN n = {n} THEN least(cp, cr) ELSE 0 END) AS match{n}" for n in range(1, 5)]
        + [f"sum(CASE WHEN n = {n} THEN cp ELSE 0 END) AS total{n}" for n in range(1, 5)]
    )
    names = [f"{k}{n}" for k in ("match", "total") for n in range(1, 5)]
    kept = ", ".join(f"CAST(coalesce(s.{c}, 0) AS BIGINT) AS {c}" for c in names)
    return f"""
flat AS (SELECT id, {carry} unnest(refs) AS r, unnest(range(len(refs))) AS ref, pred FROM {source}),
tok AS (SELECT id, {carry} ref, {words('pred')} AS p, {words('r')} AS r FROM flat),
listed AS (
  SELECT id, ref, 1 AS ip, unnest(p) AS w, unnest(range(len(p))) AS k FROM tok
  UNION ALL SELECT id, ref, 0, unnest(r), unnest(range(len(r))) FROM tok),
runs_of_4 AS (
  SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM listed WINDOW o AS (PARTITION BY id, ref, ip ORDER BY k)),
sides AS ({grams()}),
perref AS (SELECT id, n, gram, ref, sum(ip) AS cp, sum(ir) AS cr FROM sides GROUP BY ALL),
pergram AS (SELECT id, n, gram, max(cp) AS cp, max(cr) AS cr FROM perref GROUP BY ALL),
perid AS (SELECT id, {sums} FROM pergram GROUP BY id),
rowcounts AS (
  SELECT t.*, {kept} FROM (
    SELECT id, {carry} CAST(max(len(p)) AS BIGINT) AS pred_len, CAST(min(len(r)) AS BIGINT) AS ref_len
    FROM tok GROUP BY ALL) t LEFT JOIN perid s USING (id))"""


COUNTS = [f"{k}{n}" for k in ("match", "total") for n in range(1, 5)] + ["pred_len", "ref_len"]
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)
LOGS = " + ".join(f"ln(CAST(match{n} AS DOUBLE) / total{n})" for n in range(1, 5))
SCORE = f"""round(CASE WHEN pred_len = 0 OR match1 = 0 OR match2 = 0 OR match3 = 0 OR match4 = 0 THEN 0.0
  ELSE exp(({LOGS}) / 4) * CASE WHEN pred_len > ref_len THEN 1.0
    ELSE exp(1 - CAST(ref_len AS DOUBLE) / pred_len) END END, 9) AS bleu"""
EDITED = "edited AS (SELECT doc_id AS id, lang, replace(text, ' the ', ' a ') AS pred, [text] AS refs FROM documents)"

# --- tokens ------------------------------------------------------------------

DOC_WORDS = f"toks AS (SELECT doc_id AS id, {words('text')} AS tokens FROM documents)"
PAIR_WORDS = (
    f"{PAIRS},\ntoks AS (SELECT pair_id AS id, list_concat(list_concat({words('src')}, ['{SEP}']), "
    f"list_concat({words('tgt')}, ['{EOS}'])) AS tokens FROM pairs)"
)
VOCAB = """
counted AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token),
base AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id FROM counted)"""
ENCODED = """
spread AS (SELECT id, unnest(tokens) AS token, unnest(range(len(tokens))) AS k FROM toks),
enc AS (
  SELECT id, list(token_id ORDER BY k) AS ids FROM spread JOIN base USING (token) GROUP BY id)"""
DOC_IDS = f"WITH {DOC_WORDS},{VOCAB},{ENCODED}"
PAIR_IDS = f"""WITH {PAIR_WORDS},{VOCAB},{ENCODED},
special AS (
  SELECT (SELECT token_id FROM base WHERE token = '{SEP}') AS sep, (SELECT count(*) FROM base) AS pad),
batched AS (
  SELECT id, ids, pos, CAST(floor(pos / {BATCH}) AS BIGINT) AS batch_id, sep, pad
  FROM (SELECT id, ids, row_number() OVER (ORDER BY id) - 1 AS pos FROM enc), special),
placed AS (
  SELECT *, len(ids) - list_position(list_reverse(ids), sep) + 1 AS sep_at FROM batched),
padded AS (
  SELECT *, list_concat(list_transform(range(gap), lambda x: pad), ids) AS input_ids,
    list_concat(list_transform(range(gap), lambda x: 0), list_transform(ids, lambda x: 1)) AS mask
  FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS gap FROM placed))
"""


def flat(expression: str) -> str:
    return f"array_to_string(flatten(list({expression} ORDER BY pos)), ' ')"


# --- runs --------------------------------------------------------------------

def part(tag: str, place: int, of: str = "parts") -> str:
    hits = f"list_filter({of}, lambda p: starts_with(p, '{tag}'))"
    return f"substr(list_extract({hits}, {place}), {len(tag) + 1})"


RUNS = "runs AS (" + views.RUNS_SQL.format(events="events") + ")"
PARSED = f"""{RUNS},
split AS (SELECT *, string_split(experiment, '_') AS parts FROM runs),
told AS (SELECT *, starts_with(experiment, 'sft_') AND len(parts) >= 4 AS is_sft,
  starts_with(experiment, 'dpo_') OR starts_with(experiment, 'ipo_') AS is_pref,
  parts[3:] AS tail FROM split),
parsed AS (SELECT *,
  CASE WHEN is_sft THEN parts[2] WHEN is_pref
    THEN list_extract(list_filter(parts, lambda p: p = 'padding' OR p = 'packing'), -1) END AS n_base,
  TRY_CAST(CASE WHEN is_sft THEN {part('bs', -1, 'tail')} WHEN is_pref THEN {part('bs', 1)} END AS INT) AS n_batch,
  TRY_CAST(CASE WHEN is_sft THEN {part('lr', -1, 'tail')} WHEN is_pref THEN {part('lr', 1)} END AS DOUBLE) AS n_lr,
  TRY_CAST(CASE WHEN is_sft THEN {part('ep', -1, 'tail')} WHEN is_pref THEN {part('ep', 1)} END AS INT) AS n_ep,
  CASE WHEN is_sft THEN 'SFT' WHEN is_pref THEN upper(parts[1]) END AS n_final,
  TRY_CAST(CASE WHEN is_pref THEN {part('lr', 2)} END AS DOUBLE) AS n_final_lr
  FROM told)"""
TABLE = f"""WITH {PARSED},
methods AS (SELECT *, coalesce(n_final, CASE WHEN cfg_method IN ('dpo', 'ipo')
  THEN upper(cfg_method) ELSE 'SFT' END) AS final_method FROM parsed),
tab AS (SELECT experiment, coalesce(n_base, cfg_method) AS base_method,
  coalesce(n_batch, cfg_batch_size) AS batch_size, coalesce(n_lr, cfg_learning_rate) AS sft_lr,
  final_method, coalesce(n_final_lr,
    CASE WHEN final_method IN ('DPO', 'IPO') THEN cfg_learning_rate END) AS final_lr,
  coalesce(n_ep, cfg_num_epochs, 1) AS epochs, coalesce(bleu_score, 0.0) AS bleu_score,
  coalesce(train_loss, 0.0) AS train_loss, eval_loss, training_time / 60.0 AS minutes,
  round(training_time / 60.0, 9) AS training_minutes, checkpoint_path FROM methods)
"""
COLUMNS = (
    "experiment, base_method, batch_size, sft_lr, final_method, final_lr, epochs, bleu_score, "
    "train_loss, eval_loss, training_minutes, checkpoint_path"
)
PREF = "(starts_with(experiment, 'dpo_') OR starts_with(experiment, 'ipo_'))"


def appearance(column: str, kind: str) -> str:
    return f"""SELECT {column} AS value, row_number() OVER (ORDER BY top, first) AS place, '{kind}' AS kind
  FROM (SELECT {column}, -max(bleu_score) AS top, min(experiment) FILTER (bleu_score = best) AS first
    FROM (SELECT *, max(bleu_score) OVER (PARTITION BY {column}) AS best FROM tab) GROUP BY {column})"""


BOX = f"""{TABLE},
quart AS (SELECT final_method, count(*) AS n, min(bleu_score) AS low, max(bleu_score) AS high,
  quantile_cont(bleu_score, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(bleu_score, CAST(0.5 AS DOUBLE)) AS median,
  quantile_cont(bleu_score, CAST(0.75 AS DOUBLE)) AS q3 FROM tab GROUP BY final_method),
near AS (SELECT t.*, q.* EXCLUDE (final_method),
  bleu_score >= q1 - 1.5 * (q3 - q1) AND bleu_score <= q3 + 1.5 * (q3 - q1) AS is_near
  FROM tab t JOIN quart q USING (final_method)),
box AS (SELECT final_method, n, low, high, q1, median, q3,
  least(q1, min(bleu_score) FILTER (is_near)) AS whisker_low,
  greatest(q3, max(bleu_score) FILTER (is_near)) AS whisker_high,
  count(*) FILTER (NOT is_near) AS n_outliers FROM near GROUP BY final_method, n, low, high, q1, median, q3)
"""


def series(by: str, x: str, name: str, where: str) -> str:
    return f"""SELECT {by} AS series, {x} AS {name}, round(avg(bleu_score), 9) AS mean_bleu,
  max(bleu_score) AS best_bleu, count(*) AS n_runs FROM tab WHERE {where} GROUP BY {by}, {x}"""


# --- plan --------------------------------------------------------------------

def grid_rows() -> str:
    rows = []
    for f in FAMILIES:
        sft = f["type"] == "sft"
        for b, a in f["batches"]:
            for lr in f["rates"]:
                name = (
                    f"sft_{f['method']}_bs{b * a}_lr{lr}_ep1" if sft
                    else f"{f['method']}_final_model_lr{lr}_ep1"
                )
                beta = f"CAST({f['beta']} AS DOUBLE)" if "beta" in f else "NULL"
                rows.append(
                    f"('{name}', '{f['type']}', '{f['method']}', {b}, {a}, '{lr}', "
                    f"CAST('{lr}' AS DOUBLE), {b * a}, {beta})"
                )
    return ",\n  ".join(rows)


GRID = f"""plan AS (
  SELECT *, 1 AS num_epochs, 'HuggingFaceTB/SmolLM-135M' AS model_name, 'adamw_torch' AS optimizer,
    CAST(0.01 AS DOUBLE) AS weight_decay, CAST(0.1 AS DOUBLE) AS warmup_ratio,
    512 AS max_seq_length, 42 AS seed
  FROM (VALUES {grid_rows()})
  g(experiment_name, training_type, method, batch_size, gradient_accumulation_steps, lr_text,
    learning_rate, effective_batch_size, beta))"""
STEPS = f"""WITH {GRID},
micro AS (SELECT *, CAST(ceil(n_rows / batch_size) AS BIGINT) AS micro_batches
  FROM plan, (SELECT count(*) AS n_rows FROM documents)),
counted AS (SELECT *, CAST(ceil(micro_batches / gradient_accumulation_steps) AS BIGINT) AS steps FROM micro)
"""
RANK = "CASE " + " ".join(
    f"WHEN contains(experiment_name, '{c}') THEN {i}" for i, c in enumerate(CATEGORIES)
) + " END"
OUTCOMES = f"""WITH {RUNS},
found AS (SELECT regexp_replace(experiment, '_u[0-9]+$', '') AS experiment_name, experiment AS run_id,
  bleu_score, train_loss AS final_loss, eval_loss FROM runs),
{GRID},
outcomes AS (SELECT plan.*, run_id, bleu_score, final_loss, eval_loss,
  run_id IS NOT NULL AS training_completed, CASE WHEN run_id IS NULL THEN contains(experiment_name, 'bs64') ELSE eval_loss IS NOT NULL END AS has_final_model
  FROM plan LEFT JOIN found USING (experiment_name))
"""

LOG_FILES = f"""WITH logs AS (SELECT *, concat(run_kind, '_u', user_id) AS experiment_name
  FROM ({views.LOGS_SQL.format(events='events')})),
ends AS (SELECT experiment_name, max(place) + 1 AS place, 'final' AS kind, max(step) AS step, NULL AS loss, NULL AS eval_loss,
  CAST(count(*) AS DOUBLE) AS train_runtime, max(loss) AS train_loss FROM logs GROUP BY experiment_name),
whole AS (SELECT experiment_name, place, kind, step, loss, eval_loss, NULL AS train_runtime, NULL AS train_loss FROM logs
  UNION ALL SELECT * FROM ends)
"""


def _metrics(ipo: bool) -> str:
    def logp(who: str, side: str) -> str:
        return f"{who}_{side} / n_{side}" if ipo else f"{who}_{side}"

    loss = "pow(h - 5, 2)" if ipo else "ln(1 + exp(-0.1 * h))"
    return f"""WITH {PAIRS},
logps AS ({views.LOGPS_SQL.format(pairs='pairs')}),
gains AS (SELECT step, {logp('policy', 'chosen')} AS lc, {logp('policy', 'rejected')} AS lr,
  {logp('policy', 'chosen')} - {logp('ref', 'chosen')} AS gc,
  {logp('policy', 'rejected')} - {logp('ref', 'rejected')} AS gr FROM logps),
margins AS (SELECT *, gc - gr AS h FROM gains)
SELECT step, count(*) AS n_pairs, round(avg(0.1 * gc), 9) AS rewards_chosen,
  round(avg(0.1 * gr), 9) AS rewards_rejected, round(avg(0.1 * h), 9) AS rewards_margins,
  round(avg(CASE WHEN gc > gr THEN 1.0 ELSE 0.0 END), 9) AS rewards_accuracies,
  round(avg(lc), 9) AS logps_chosen, round(avg(lr), 9) AS logps_rejected,
  round(avg({loss}), 9) AS loss
FROM margins GROUP BY step"""


# Bins hold at most LIMIT tokens, and a document's tokens are all in bins.
_PACKED = f"""{DOC_IDS},
offs AS (SELECT id, ids, len(ids) AS n, CAST(sum(len(ids)) OVER (ORDER BY id) - len(ids) AS BIGINT) AS start FROM enc),
stream AS (SELECT id, unnest(ids) AS t, unnest(range(n)) AS p, start FROM offs),
cut AS (SELECT *, CAST(floor((start + p) / {LIMIT}) AS BIGINT) AS chunk, start + p AS place FROM stream),
seqs AS (SELECT chunk, id, count(*) AS n, min(place) AS first FROM cut GROUP BY chunk, id),
bounds AS (SELECT chunk, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY first) AS sequences,
  string_agg(CAST(n AS VARCHAR), ' ' ORDER BY first) AS lengths FROM seqs GROUP BY chunk)
SELECT c.chunk, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY place) AS input_ids,
  string_agg(CAST(p AS VARCHAR), ' ' ORDER BY place) AS position_ids, sequences, lengths
FROM cut c JOIN bounds b ON c.chunk = b.chunk GROUP BY c.chunk, sequences, lengths"""

ORACLE = {
    "task_filter": "SELECT doc_id, lang, text FROM documents WHERE lang = 'en'",
    "split_counts": "SELECT lang, source, count(*) AS n_rows FROM documents GROUP BY lang, source",
    "format_train_text": f"WITH {PAIRS} SELECT pair_id, concat(src, '{SEP}', tgt, '{EOS}') AS text FROM pairs",
    "format_prompt": f"WITH {PAIRS} SELECT pair_id, concat(src, '{SEP}') AS prompt FROM pairs",
    "extract_answer": answer("c"),
    "extract_answer_prompt": answer(strip("replace(c, src, '')")),
    "pref_status": JUDGED + "SELECT pair_id, status, CAST(chosen_dist AS BIGINT) AS chosen_dist, "
    "CAST(rejected_dist AS BIGINT) AS rejected_dist, round(ratio, 9) AS length_ratio FROM judged",
    "pref_outcomes": OUTCOME_COUNTS,
    "progress_incremental": OUTCOME_COUNTS,
    "progress_batches": JUDGED + """SELECT count(*) FILTER (status <> 'error') AS processed,
  count(*) FILTER (status = 'kept') AS successful,
  round(100.0 * count(*) FILTER (status = 'kept') / count(*) FILTER (status <> 'error'), 9) AS success_rate FROM judged""",
    "pref_report": JUDGED + """SELECT count(*) FILTER (status <> 'error') AS total_processed,
  count(*) FILTER (status = 'kept') AS successful,
  count(*) FILTER (status = 'identical') AS skipped_identical,
  count(*) FILTER (status = 'empty') AS skipped_empty,
  count(*) FILTER (status = 'small_diff') AS skipped_small_diff,
  count(*) FILTER (status = 'length_ratio') AS skipped_length_ratio,
  CAST(coalesce(sum(chosen_dist) FILTER (status = 'kept'), 0) AS BIGINT) AS total_chosen_dist,
  CAST(coalesce(sum(rejected_dist) FILTER (status = 'kept'), 0) AS BIGINT) AS total_rejected_dist,
  round(avg(chosen_dist) FILTER (status = 'kept'), 9) AS mean_chosen_dist,
  round(avg(rejected_dist) FILTER (status = 'kept'), 9) AS mean_rejected_dist,
  round(100.0 * count(*) FILTER (status = 'kept') / count(*) FILTER (status <> 'error'), 9) AS success_rate
FROM judged""",
    "pref_record": JUDGED + """SELECT CAST(0.7 AS DOUBLE) AS temperature, CAST(0.33 AS DOUBLE) AS min_length_ratio,
  count(*) FILTER (status = 'kept') AS final_dataset_size, count(*) FILTER (status <> 'error') AS total_processed,
  count(*) FILTER (status = 'kept') AS successful,
  CAST(coalesce(sum(chosen_dist) FILTER (status = 'kept'), 0) AS BIGINT) AS total_chosen_dist FROM judged""",
    "pref_pairs": JUDGED + "SELECT pair_id, src AS prompt, chosen, rejected FROM judged WHERE status = 'kept'",
    "pref_failed": f"WITH {ASKED},{cands('asked')},{judged()} "
    "SELECT pair_id, src, status FROM judged WHERE status = 'error'",
    "pref_numbered": JUDGED + NUMBERED,
    "pref_sample": JUDGED + NUMBERED + " QUALIFY entry_number < 100",
    "pref_from_hook": f"""WITH {PAIRS},
folded AS (SELECT pair_id, {fold('src')} AS src, {fold('tgt')} AS tgt FROM pairs),
made AS (SELECT pair_id, src, tgt, {strip("replace(src, 'e', 'a')")} AS pred1,
  {strip("replace(replace(src, 'e', 'a'), 'th', 'd')")} AS pred2 FROM folded),{judged('made')}
SELECT pair_id, pred1, pred2, CAST(NULL AS VARCHAR) AS gen_error, status FROM judged""",
    "running_success": JUDGED + f""", placed AS (
  SELECT status, CAST(floor((row_number() OVER (ORDER BY pair_id) - 1) / {BATCH}) AS BIGINT) AS batch_id FROM judged),
per AS (SELECT batch_id, count(*) FILTER (status <> 'error') AS n, count(*) FILTER (status = 'kept') AS k
  FROM placed GROUP BY batch_id),
run AS (SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS processed,
  CAST(sum(k) OVER (ORDER BY batch_id) AS BIGINT) AS successful FROM per)
SELECT batch_id, processed, successful, round(100.0 * successful / processed, 9) AS success_rate
FROM run WHERE batch_id % 4 = 0 AND batch_id > 0""",
    "pref_incremental": JUDGED + "SELECT pair_id, src AS prompt, chosen, rejected FROM judged WHERE status = 'kept'",
    "split_90_10": """WITH p AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT *, CASE WHEN pos < (SELECT floor(CAST(0.9 AS DOUBLE) * count(*)) FROM documents) THEN 'train' ELSE 'eval' END AS part FROM p""",
    "seeded_shuffle": """SELECT doc_id, lang, n_chars,
  row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|42')), doc_id) - 1 AS pos FROM documents""",
    "batches": """SELECT *, CAST(floor(pos / 128) AS BIGINT) AS batch_id FROM (
  SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)""",
    "bleu_words": f"WITH {DOC_WORDS} SELECT id AS doc_id, {joined('tokens')} AS tokens FROM toks",
    "bleu_ngrams": f"WITH {EDITED},{counts('edited')} SELECT * RENAME (id AS doc_id) FROM rowcounts",
    "bleu_by_lang": f"WITH {EDITED},{counts('edited', 'lang,')}, s AS (SELECT lang, {SUMS} FROM rowcounts GROUP BY lang) "
    f"SELECT *, {SCORE} FROM s",
    "bleu_corpus": f"WITH {PAIRS},{cands('pairs')}, src AS (SELECT pair_id AS id, pred1 AS pred, [{strip('tgt')}] AS refs FROM cands),"
    f"{counts('src')}, s AS (SELECT {SUMS} FROM rowcounts) SELECT *, {SCORE} FROM s",
    "bleu_two_references": f"WITH {PAIRS},{cands('pairs')}, src AS (SELECT pair_id AS id, pred1 AS pred, [pred2, tgt] AS refs FROM cands),"
    f"{counts('src')}, s AS (SELECT {SUMS} FROM rowcounts) SELECT *, {SCORE} FROM s",
    "bleu_running": f"WITH {EDITED},{counts('edited')}, "
    f"run AS (SELECT row_number() OVER w AS rows_done, {', '.join(f'CAST(sum({c}) OVER w AS BIGINT) AS {c}' for c in COUNTS)} "
    f"FROM rowcounts WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)) "
    f"SELECT *, {SCORE} FROM run WHERE rows_done % 100 = 0",
    "vocab": f"""WITH {DOC_WORDS},{VOCAB}
SELECT token, token_id FROM base UNION ALL
SELECT token, (SELECT count(*) FROM base) + k AS token_id
FROM (VALUES ('{EOS}', 0), ('{PAD}', 1), ('{SEP}', 2)) s(token, k)""",
    "token_ids": f"""{DOC_IDS} SELECT doc_id, coalesce({joined('ids')}, '') AS ids
FROM documents LEFT JOIN enc ON doc_id = id""",
    "pack_best_fit_cover": f"""{DOC_IDS} SELECT id AS doc_id, {joined('ids')} AS ids FROM enc WHERE len(ids) > 0""",
    "token_ids_hook": "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ' ') AS ids FROM documents",
    "truncate": PAIR_IDS + f"SELECT id AS pair_id, {joined(f'ids[1:{LIMIT}]')} AS ids, sep_at > {LIMIT} AS sep_lost FROM placed",
    "pref_truncate": PAIR_IDS + f""", cut AS (SELECT id, ids[greatest(sep_at - 128, 0) + 1 : sep_at] AS p, ids[sep_at + 1 :] AS c FROM placed)
SELECT id AS pair_id, {joined('p')} AS prompt, {joined(f'c[1 : {LIMIT} - len(p)]')} AS completion FROM cut""",
    "left_pad": PAIR_IDS + f"SELECT id AS pair_id, batch_id, {joined('input_ids')} AS input_ids, {joined('mask')} AS attention_mask FROM padded",
    "completion_labels": PAIR_IDS + f"""SELECT id AS pair_id, {joined(
        "list_transform(input_ids, lambda x, i: CASE WHEN i <= sep_at + gap OR x = pad THEN -100 ELSE x END)")} AS labels FROM padded""",
    "batch_flatten": PAIR_IDS + f"""SELECT batch_id, {flat('ids')} AS input_ids, {flat('range(len(ids))')} AS position_ids,
  {flat("list_transform(ids, lambda x, i: CASE WHEN i = 1 THEN -100 ELSE x END)")} AS labels,
  concat('0 ', string_agg(CAST(done AS VARCHAR), ' ' ORDER BY pos)) AS cu_seqlens
FROM (SELECT *, sum(len(ids)) OVER (PARTITION BY batch_id ORDER BY pos) AS done FROM batched) GROUP BY batch_id""",
    "pad_multiple": PAIR_IDS + f""", g AS (SELECT batch_id, max(pad) AS pad, flatten(list(ids ORDER BY pos)) AS ids FROM batched GROUP BY batch_id),
e AS (SELECT batch_id, list_concat(ids, list_transform(range((8 - len(ids) % 8) % 8), lambda x: pad)) AS ids FROM g)
SELECT batch_id, CAST(len(ids) AS BIGINT) AS n, {joined('ids')} AS ids FROM e""",
    "pack_wrapped": _PACKED,
    "pack_best_fit": f"WITH {DOC_WORDS} SELECT CAST(coalesce(sum(len(tokens)), 0) AS BIGINT) AS n_tokens, true AS fits, true AS near_the_bound FROM toks",
    "run_names": f"WITH {PARSED} SELECT experiment, n_base AS base_method, n_batch AS batch_size, n_lr AS learning_rate, "
    "n_ep AS epochs, n_final AS final_method, n_final_lr AS final_lr FROM parsed",
    "runs_table": TABLE + f"SELECT {COLUMNS}, row_number() OVER (ORDER BY {BEST}) AS rank FROM tab",
    "top5_runs": TABLE + f"""SELECT final_method, base_method, coalesce(CAST(batch_size AS VARCHAR), '-') AS batch_size,
  coalesce(printf('%.1e', sft_lr), '-') AS sft_lr, coalesce(CAST(final_lr AS VARCHAR), '-') AS final_lr,
  printf('%.4f', bleu_score) AS bleu FROM tab ORDER BY {BEST} LIMIT 5""",
    "best_run": TABLE + f"SELECT experiment, bleu_score, checkpoint_path FROM tab ORDER BY {BEST} LIMIT 1",
    "best_run_by_phase": TABLE + f"""SELECT CASE WHEN {PREF} THEN 'dpo' ELSE 'sft' END AS phase, bleu_score, experiment FROM tab
QUALIFY row_number() OVER (PARTITION BY {PREF} ORDER BY {BEST}) = 1""",
    "best_path_to_next_phase": TABLE + f"""SELECT experiment,
  (SELECT checkpoint_path FROM tab WHERE NOT {PREF} ORDER BY {BEST} LIMIT 1) AS start_path FROM tab WHERE {PREF}""",
    "summary_global": TABLE + f"""SELECT count(*) AS total_experiments, max(bleu_score) AS best_bleu, min(bleu_score) AS worst_bleu,
  round(avg(bleu_score), 9) AS mean_bleu, round(stddev_samp(bleu_score), 9) AS std_bleu,
  round(sum(minutes), 9) AS total_training_time,
  (SELECT experiment FROM tab ORDER BY {BEST} LIMIT 1) AS best_experiment FROM tab""",
    "summary_by_method": TABLE + f"""SELECT final_method, count(*) AS n_runs, max(bleu_score) AS best_bleu,
  round(avg(bleu_score), 9) AS mean_bleu, max(experiment) FILTER (r = 1) AS best_experiment
FROM (SELECT *, row_number() OVER (PARTITION BY final_method ORDER BY {BEST}) AS r FROM tab) GROUP BY final_method""",
    "methods_in_order": TABLE + appearance("final_method", "final") + "\nUNION ALL\n" + appearance("base_method", "base"),
    "box_by_method": BOX + "SELECT final_method, n, round(low, 9) AS low, round(high, 9) AS high, round(q1, 9) AS q1, "
    "round(median, 9) AS median, round(q3, 9) AS q3, round(whisker_low, 9) AS whisker_low, "
    "round(whisker_high, 9) AS whisker_high, n_outliers FROM box",
    "box_outliers": BOX + "SELECT final_method, experiment, bleu_score FROM near WHERE NOT is_near",
    "score_by_batch": TABLE + series("base_method", "batch_size", "batch_size", "final_method = 'SFT'"),
    "score_by_lr": TABLE + f"""SELECT *, round(log10(lr), 9) AS log10_lr FROM (
  SELECT *, 'SFT' AS kind FROM ({series('base_method', 'sft_lr', 'lr', "final_method = 'SFT'")})
  UNION ALL SELECT *, 'preference' FROM ({series('final_method', 'final_lr', 'lr', "final_method IN ('DPO', 'IPO') AND final_lr IS NOT NULL")}))""",
    "last_eval_loss": f"""WITH logs AS ({views.LOGS_SQL.format(events='events')})
SELECT run_kind, user_id, max_by(eval_loss, place) FILTER (eval_loss IS NOT NULL) AS eval_loss FROM logs GROUP BY run_kind, user_id""",
    "learning_curve": f"""WITH logs AS ({views.LOGS_SQL.format(events='events')})
SELECT run_kind, user_id, step, round(avg(loss) FILTER (kind = 'train'), 9) AS train,
  round(avg(eval_loss) FILTER (kind = 'eval'), 9) AS eval FROM logs GROUP BY run_kind, user_id, step""",
    "reward_metrics_dpo": _metrics(False),
    "reward_metrics_ipo": _metrics(True),
    "step_plan": STEPS + """, logged AS (
  SELECT *, unnest(list_distinct(list_concat([1], range(10, steps + 1, 10)))) AS step FROM counted)
SELECT experiment_name, micro_batches, steps, step, step % 10 = 0 AS evaluates,
  round(step * gradient_accumulation_steps / CAST(micro_batches AS DOUBLE), 9) AS epoch FROM logged""",
    "grid_steps": STEPS + "SELECT * FROM counted",
    "plan_outcomes": OUTCOMES + "SELECT * FROM outcomes",
    "plan_missing": OUTCOMES + "SELECT plan.* FROM plan WHERE experiment_name NOT IN (SELECT experiment_name FROM found)",
    "plan_counts": OUTCOMES + """SELECT count(*) AS total, count(*) FILTER (contains(experiment_name, 'sft')) AS sft,
  count(*) FILTER (contains(experiment_name, 'dpo')) AS dpo, count(*) FILTER (contains(experiment_name, 'ipo')) AS ipo,
  count(*) FILTER (training_completed) AS completed FROM outcomes""",
    "plan_ordered": OUTCOMES + f"SELECT {RANK} AS category_rank, experiment_name, run_id, bleu_score FROM outcomes",
    "pairs_parquet": JUDGED + KEPT,
    "pairs_json": JUDGED + KEPT,
    "numbered_json": JUDGED + NUMBERED,
    "csv_sink": TABLE + f"SELECT {COLUMNS} FROM tab",
    "summary_json": TABLE + f""", places AS ({appearance('final_method', 'final')} UNION ALL {appearance('base_method', 'base')})
SELECT (SELECT count(*) FROM tab) AS total_experiments,
  (SELECT experiment FROM tab ORDER BY {BEST} LIMIT 1) AS best_experiment,
  (SELECT string_agg(value, ' ' ORDER BY place) FROM places WHERE kind = 'final') AS methods,
  (SELECT string_agg(value, ' ' ORDER BY place) FROM places WHERE kind = 'base') AS bases,
  final_method AS method, count(*) AS n_runs, max(bleu_score) AS best_bleu FROM tab GROUP BY final_method""",
    "run_records_roundtrip": f"WITH {RUNS} SELECT experiment, cfg_method, cfg_batch_size, cfg_learning_rate, "
    "bleu_score, train_loss, eval_loss, training_time FROM runs",
    "bad_records": f"""WITH {RUNS} SELECT concat('{{"experiment_name": "', experiment, '"') AS content FROM runs WHERE eval_loss IS NULL""",
    "best_pointer": TABLE + f"SELECT checkpoint_path AS best_model_path FROM tab ORDER BY {BEST} LIMIT 1",
    "config_files": OUTCOMES + "SELECT experiment_name, run_id, training_type, learning_rate, effective_batch_size, bleu_score, file "
    "FROM outcomes, (VALUES ('run'), ('all')) f(file)",
    "summary_figures": TABLE + f"""SELECT best_bleu, worst_bleu, mean_bleu, std_bleu, total_training_time, method, method_mean, best_experiment
FROM (SELECT max(bleu_score) AS best_bleu, min(bleu_score) AS worst_bleu, round(avg(bleu_score), 9) AS mean_bleu,
    round(stddev_samp(bleu_score), 9) AS std_bleu, round(sum(minutes), 9) AS total_training_time FROM tab),
  (SELECT final_method AS method, round(avg(bleu_score), 9) AS method_mean, max(experiment) FILTER (r = 1) AS best_experiment
   FROM (SELECT *, row_number() OVER (PARTITION BY final_method ORDER BY {BEST}) AS r FROM tab) GROUP BY final_method)""",
    "record_folders": f"WITH {RUNS} SELECT experiment, cfg_method, cfg_batch_size, cfg_learning_rate, "
    "bleu_score, train_loss, eval_loss, training_time FROM runs WHERE eval_loss IS NOT NULL",
    "record_folders_bad": f"""WITH {RUNS} SELECT experiment AS experiment_name, concat('{{"config": {{"method": "', cfg_method) AS content
FROM runs WHERE eval_loss IS NULL""",
    "log_files": LOG_FILES + """SELECT experiment_name, row_number() OVER (PARTITION BY experiment_name ORDER BY place) - 1 AS place,
  kind, step, loss, eval_loss, eval_loss / 2 AS eval_rewards_margins, train_runtime, train_loss FROM whole""",
    "log_files_bad": LOG_FILES + """SELECT DISTINCT concat(experiment_name, '_cut') AS experiment_name,
  concat('[{"loss": 1.0}, {"run": "', experiment_name) AS content FROM logs WHERE user_id % 10 = 0""",
    "log_files_last_eval": LOG_FILES + """SELECT experiment_name, max_by(eval_loss, place) FILTER (eval_loss IS NOT NULL) AS eval_loss
FROM logs GROUP BY experiment_name""",
    "log_files_curve": LOG_FILES + """SELECT experiment_name, step, round(avg(loss) FILTER (kind = 'train'), 9) AS train,
  round(avg(eval_loss) FILTER (kind = 'eval'), 9) AS eval FROM logs GROUP BY experiment_name, step""",
    "artifact_listing": f"""WITH {RUNS},
named AS (SELECT *, CASE WHEN cfg_method IN ('dpo', 'ipo') THEN 'preference' ELSE 'sft' END AS top FROM runs),
files AS (SELECT top, experiment AS run, concat('run ', experiment) AS content FROM named UNION ALL
  SELECT top, experiment, concat('{{"method": "', cfg_method, 'é"}}') FROM named WHERE eval_loss IS NOT NULL)
SELECT top, run, count(*) AS n_files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS total_bytes FROM files GROUP BY top, run
UNION ALL SELECT top, 'all', count(*), CAST(sum(octet_length(encode(content))) AS BIGINT) FROM files GROUP BY top""",
    "config_documents": OUTCOMES + """SELECT * EXCLUDE (has_final_model), coalesce(run_id, experiment_name) AS folder,
  coalesce(eval_loss IS NOT NULL, false) AS has_final_model FROM outcomes""",
    "bleu_words_unicode": f"""WITH odd AS (SELECT doc_id AS id,
  replace(text, ' ', CASE doc_id % 3 WHEN 0 THEN chr(8195) WHEN 1 THEN chr(31) ELSE chr(12288) END) AS text FROM documents)
SELECT id AS doc_id, {joined('x')} AS tokens, 'a b' AS next_line FROM (SELECT id, {words('text')} AS x FROM odd)""",
    "pref_hook_failures": f"""WITH {PAIRS},
folded AS (SELECT pair_id, {fold('src')} AS src, {fold('tgt')} AS tgt FROM pairs),
tried AS (SELECT *, CASE WHEN (length(src) + {len(SEP)}) % 5 = 0 THEN 'ValueError: refused' END AS gen_error FROM folded),
made AS (SELECT *, CASE WHEN gen_error IS NULL THEN {strip("replace(src, 'e', 'a')")} END AS pred1,
  CASE WHEN gen_error IS NULL THEN {strip("replace(replace(src, 'e', 'a'), 'th', 'd')")} END AS pred2 FROM tried),
{judged('made', 'gen_error IS NOT NULL')}
SELECT pair_id, pred1, gen_error, status FROM judged""",
    "progress_series": JUDGED + """, per AS (SELECT pair_id % 4 AS batch_id, count(*) FILTER (status <> 'error') AS n,
  count(*) FILTER (status = 'kept') AS k FROM judged GROUP BY pair_id % 4),
run AS (SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS processed,
  CAST(sum(k) OVER (ORDER BY batch_id) AS BIGINT) AS successful FROM per)
SELECT batch_id, processed, successful, round(CASE WHEN processed > 0 THEN 100.0 * successful / processed ELSE 0.0 END, 9) AS success_rate FROM run""",
    "pref_snapshot": JUDGED + "SELECT pair_id, src AS prompt, chosen, rejected FROM judged WHERE status = 'kept' AND pair_id % 4 < 2",
    "pref_snapshot_by_rows": JUDGED + """, per AS (SELECT pair_id % 4 AS v, count(*) FILTER (status <> 'error') AS n FROM judged GROUP BY pair_id % 4),
run AS (SELECT v, sum(n) OVER (ORDER BY v) AS done, sum(n) OVER () AS total FROM per),
last AS (SELECT CAST(coalesce(max(v), -1) AS BIGINT) AS version FROM run WHERE done <= floor(total * 6 / 10))
SELECT status, count(*) AS n, CAST(coalesce(sum(chosen_dist) FILTER (status = 'kept'), 0) AS BIGINT) AS chosen_dist,
  CAST(coalesce(sum(rejected_dist) FILTER (status = 'kept'), 0) AS BIGINT) AS rejected_dist, version
FROM judged, last WHERE pair_id % 4 <= version GROUP BY status, version""",
}
