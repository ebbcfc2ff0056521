"""The pipeline's stages against plain versions, each on its own input."""

import public_tokenizers
import pytest

import corpus_pipeline
from pairforge.llm.common import Workspace
from test_repeats import groups, removed, shingles
from test_tokens import check_pieces


@pytest.fixture(scope="module")
def steps(spark, sf, docs):
    with Workspace(spark) as ws:
        found = [docs]
        for name, stage in corpus_pipeline.STAGES:
            found.append(ws.stored(stage(spark, found[-1], sf), name))
        yield found


def test_columns_stay(steps, docs):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == docs.columns for s in steps[1:-1])
    assert all(s.dtypes == docs.dtypes for s in steps[1:-1])


def test_language_keeps_clean_documents(steps):
    before, after = ({r.doc_id for r in s.collect()} for s in steps[:2])
    assert after <= before and len(after) >= 0.98 * len(before)


def test_one_of_each_group_stays(steps):
    sets = {r.doc_id: shingles(r.text, 5) for r in steps[2].collect()}
    wanted = {i for i, root in groups(sets, 80).items() if i == root}
    assert {r.doc_id for r in steps[3].collect()} == wanted


def test_repeated_strings_go(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    lost = dict(zip(before, removed(list(before.values()), 200)))
    after = {r.doc_id: r for r in steps[4].collect()}
    for i, text in before.items():
        n_bytes, gone, *_ = lost[i]
        left = len(after[i].text.encode()) if i in after else 0
        # Characters that a string cuts in two stay.
        assert n_bytes - gone <= left <= n_bytes - gone + 6 * lost[i][2]
        assert i not in after or after[i].n_chars == len(after[i].text)


def test_all_that_is_left_is_packed(steps, spark, sf):
    texts = [(r.doc_id, r.text) for r in steps[4].collect()]
    check_pieces(steps[5].collect(), texts)
    assert public_tokenizers.path(corpus_pipeline.VOCABULARY)
    assert corpus_pipeline.run(spark, sf).count() == steps[5].count()


def test_odd_rows_pass_all_stages(spark, sf, odd, no_docs):
    for rows in (odd, no_docs):
        with Workspace(spark) as ws:
            at = rows
            for name, stage in corpus_pipeline.STAGES[:-1]:
                at = ws.stored(stage(spark, at, sf), name)
                assert at.columns == rows.columns
            assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() >= 0
