"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import public_tokenizers
import pytest
from llm_rows import pairs
from test_dedup import brute_near, normal
from test_scans_and_tokens import check_packing, plain_spans

from tallyscope.llm import secrets, toxicity
from tallyscope.llm.common import staged, table


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output of each stage."""
    folder = folder.replace("sf0.001", "sf0.01")
    out, docs = {}, table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        done = staged(stage(spark, docs, folder), name)
        out[name] = (docs, done)
        docs = done
    return out


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]


def test_columns_stay(stages):
    for name in ("toxicity", "exact_dedup", "near_dedup", "secrets"):
        assert stages[name][1].dtypes == stages[name][0].dtypes


def test_toxic_documents_go_and_others_stay(spark, folder, stages):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, kept = stages["toxicity"]
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    assert pairs(kept, "doc_id", "text") == pairs(scored.filter("score < 0.5").join(docs, scored["id"] == docs["doc_id"]), "doc_id", "text")
    labelled = docs.join(table(spark, folder, "labels"), "doc_id").filter("toxic = 0")
    assert labelled.join(kept, "doc_id", "left_anti").count() <= 0.01 * labelled.count()


def test_one_of_equal_documents_stays(stages):
    docs, kept = stages["exact_dedup"]
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r)
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in first.values())


def test_one_of_near_documents_stays(stages):
    docs, kept = stages["near_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert [i for (i,) in pairs(kept, "doc_id")] == sorted((i for i, _, c in brute_near(rows, 5, 80) if i == c), key=lambda i: repr((i,)))


def test_secrets_are_masked(stages):
    docs, masked = stages["secrets"]
    after, changed = {r.doc_id: r for r in masked.collect()}, 0
    for r in docs.collect():
        text = secrets.redacted(r.text, [(a, b) for _, a, b in plain_spans(r.text)])
        changed += text != r.text
        assert after[r.doc_id].text == text and after[r.doc_id].n_chars == (len(text) if text != r.text else r.n_chars)
    assert changed and len(after) == docs.count()


def test_all_tokens_are_packed(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, packed = stages["packing"]
    assert check_packing(packed.collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 2048) == 0


def test_odd_and_empty_tables_go_through(spark, folder, odd, none):
    for docs in (odd, none):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = staged(stage(spark, docs, folder), "odd")
            assert done.columns == odd.columns
            docs = done
        packed = corpus_pipeline.pack(spark, docs, folder)
        assert (packed.count() == 0) == (n == 0)
