"""The stages one by one, each against a plain computation over its own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablecraft.llm.registry import stored
from tests.llm.conftest import SF_DIR
from tests.llm.test_bytehash import split
from tests.llm.test_chunks import brute as brute_passages
from tests.llm.test_hamming import expected as brute_components
from tests.llm.test_mixing import fill

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and the result of every stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF_DIR)))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_are_in_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near", "passages", "mixture", "tokens"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_language_keeps_clear_documents(steps):
    before, after = rows(steps[0]), {r["doc_id"]: r for r in rows(steps[1])}
    for r in before:
        if r["doc_id"] in after:
            assert after[r["doc_id"]] == r
    assert len(after) >= 0.97 * len(before)


def test_near_keeps_one_of_each_component(steps):
    before, after = rows(steps[1]), rows(steps[2])
    kept = {i for i, _, _, k in brute_components([(r["doc_id"], r["text"]) for r in before]) if k}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] in kept) and len(after) < len(before)


def test_passages_go(steps):
    before = rows(steps[2])
    left = brute_passages([(r["doc_id"], r["text"]) for r in before])
    want = [r | {"text": left[r["doc_id"]][0], "n_chars": len(left[r["doc_id"]][0])} for r in before]
    assert sorted(map(str, rows(steps[3]))) == sorted(str(r) for r in want if split(r["text"]) or not split(r["text"]) and r["text"] == "")


def test_mixture_takes_the_budgets(steps):
    before, after = rows(steps[3]), rows(steps[4])
    sizes, taken = {}, {}
    for total, part in ((sizes, before), (taken, after)):
        for r in part:
            total[r["source"]] = total.get(r["source"], 0) + len(split(r["text"]))
    share = fill(sizes, (5, 2, 1))
    assert taken == {s: round(t) for s, t in share.items()}
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)


def test_tokens_are_those_of_the_library(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = rows(steps[4]), rows(steps[5])
    assert len(before) == len(after)
    for r in after:
        assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1].collect()))


def test_odd_rows_and_no_rows(spark, odd_documents, no_documents):
    wide = odd_documents.selectExpr("*", "1 AS ids2", "'a' AS lang_pred", "2 AS n_removed", "3 AS `odd.name`", "4 AS __row")
    docs, last = wide, None
    for name, stage in corpus_pipeline.STAGES:
        last, docs = docs, stored(stage(spark, docs, SF_DIR))
        if name != "tokens":
            assert docs.columns == wide.columns
    assert docs.count() == last.count() > 5 and docs.where("NOT round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, SF_DIR).count() == 0


def test_stages_on_odd_rows(spark, odd_documents):
    near = rows(STAGE["near"](spark, odd_documents, SF_DIR))
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 9, 11, 12, 13, 14]
    language = rows(STAGE["language"](spark, odd_documents, SF_DIR))
    assert not {4, 5, 6, 13, 14} & {r["doc_id"] for r in language}
    assert all(r["lang"] is not None for r in language)
    assert len(rows(STAGE["tokens"](spark, odd_documents, SF_DIR))) == 20
