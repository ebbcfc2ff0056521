"""Queries over tables in which one text, one conversation and one user hold a
third of the rows, with very long, repeated and empty texts and far ids."""

import pytest

import oracle_check
from pairforge.queries.catalog import QUERIES
from pairforge.queries.oracle import ORACLE

NAMES = [
    "pref_outcomes", "pref_numbered", "running_success", "split_90_10", "seeded_shuffle",
    "bleu_by_lang", "bleu_running", "vocab", "token_ids", "left_pad", "pack_wrapped",
    "pack_best_fit_cover", "runs_table", "box_by_method", "plan_ordered", "learning_curve",
    "last_eval_loss",
]


@pytest.fixture(scope="module")
def skewed(sf, tmp_path_factory):
    out = tmp_path_factory.mktemp("skew")
    con = oracle_check.connect(sf)
    changed = {
        "documents": """
            SELECT * FROM documents
            UNION ALL SELECT 1000 + i, (SELECT text FROM documents WHERE doc_id = 5), 'en', 'hot', 1 FROM range(100) r(i)
            UNION ALL SELECT 100000, (SELECT string_agg(text, ' ') FROM documents), 'fr', 'long', 1
            UNION ALL SELECT 9000000000000000000, repeat('same same word. ', 5000), 'de', 'long', 1
            UNION ALL SELECT -5, '', 'es', 'empty', 0""",
        "conversations": """
            SELECT * FROM conversations
            UNION ALL SELECT 5000, i, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END,
              (SELECT text FROM conversations WHERE conv_id = (i // 2) % 20 AND turn = 0) || ' ' || (i // 4)
            FROM range(60) r(i)""",
        "events": """
            SELECT * FROM events
            UNION ALL SELECT 20000 + i, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND, 7, 'click',
              round((i % 977) * 0.37, 2), '{}' FROM range(600) r(i)""",
    }
    for name in oracle_check.TABLES:
        con.execute(f"COPY ({changed.get(name, f'SELECT * FROM {name}')}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_tables(spark, skewed, name):
    con = oracle_check.connect(skewed)
    assert oracle_check.differences(QUERIES[name](spark, skewed), con, ORACLE[name]) == []
