"""The pipeline's stages, each against a plain version of what it does to its own input."""

import re
import zlib

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest

from driftline.llm import common, packing, pii, quality, queries
from tests.llm.test_operators import best_fit, brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's name with the rows that it was given and those that it returned."""
    docs = common.stored(queries.table(spark, SF, "documents"))
    out, columns = {}, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = common.stored(stage(spark, docs, SF))
        assert i == len(corpus_pipeline.STAGES) - 1 or made.columns == columns
        out[name] = sorted(docs.collect(), key=lambda r: r.doc_id), sorted(made.collect(), key=lambda r: r.doc_id)
        docs = made
    return out


def test_quality_rejects_what_scores_low(spark, stages):
    before, after = stages["quality"]
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    sample = quality.sample_texts(docs, labels, queries.MAX_LABELLED)
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in sample.collect()} <= {0, 1, 3}
    scores = quality.score_batch(quality.train(sample), pa.array([r.text or "" for r in before]))
    sure = [(r, s) for r, s in zip(before, scores, strict=True) if abs(s - queries.LEAST_QUALITY) > 1e-4]
    kept = set(after)
    assert len(sure) > 0.9 * len(before) and all((r in kept) == (s >= queries.LEAST_QUALITY) for r, s in sure)


def test_exact_keeps_the_smallest_id(stages):
    before, after = stages["exact"]
    first = {}
    for r in before:
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r)
    assert after == sorted(first.values(), key=lambda r: r.doc_id)


def test_near_keeps_one_of_each_group(stages):
    before, after = stages["near"]
    groups = brute_groups([r.text for r in before], 5, 80)
    assert after == [r for i, r in enumerate(before) if groups[i][2]]


def test_personal_data_is_masked(stages):
    before, after = stages["pii"]
    assert [(r.doc_id, r.text, r.n_chars) for r in after] == [(r.doc_id, pii.masked(r.text), len(pii.masked(r.text))) for r in before]
    assert not any(any(pii.base_spans(r.text).values()) for r in after)
    assert all((a.lang, a.source) == (b.lang, b.source) for a, b in zip(before, after, strict=True))


def test_packing_holds_all_tokens(stages):
    before, after = stages["packing"]
    ids = packing.Words(public_tokenizers.path("word_bpe_49k.json")).encode([r.text for r in before])
    for doc, own in zip(before, ids, strict=True):
        own += bytes(4)
        pieces = sorted((r for r in after if r.doc_id == doc.doc_id), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(own[at : at + 8192]) for at in range(0, len(own), 8192)]
    assert len({r.sequence_id for r in after}) == best_fit([r.length for r in after], queries.SEQUENCE_TOKENS)


def test_stages_of_nothing(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_stages_of_odd_rows(spark):
    """Nulls, repeated rows, rows without an id, a long text, and a column that clashes with the operators' own."""
    text = "one two three four five six seven eight nine ten"
    rows = [(None, None), (None, text), (1, None), (2, ""), (3, text), (3, text), (4, text + " mail jo@example.com"), (5, "word " * 60_000), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    made = {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = common.stored(stage(spark, docs, SF))
        made[name] = sorted(((r.doc_id, len(getattr(r, "text", None) or "")) for r in docs.collect()), key=str)
    n = len(text)
    # of the empty texts 1 stays, of the equal ones both rows of 3; rows without an id go where an equal row has one
    assert made["exact"] == sorted([(1, 0), (3, n), (3, n), (4, n + 20), (5, 300_000)], key=str)
    assert [i for i, _ in made["near"]] == [1, 3, 3, 4, 5]
    assert {i for i, _ in made["packing"]} == {i for i, _ in made["pii"]} == {i for i, _ in made["near"]}
