"""The stages against brute force, each on its own input, and the whole on a small corpus."""

import re

import corpus_pipeline
import pytest
from helpers_llm import lowered
from test_near import brute
from test_suffixes import brute as windows

import __spark_entry__ as contract
from emberline.llm import nbsvm, pii
from emberline.llm.queries import QUALITY_THRESHOLD, held_out

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def staged(spark, sf):
    """Input and output of every stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        out[name] = (docs.collect(), made.columns, made.collect())
        docs = spark.createDataFrame(out[name][2], made.schema)
    return out


def test_order_and_columns(staged, many):
    assert list(STAGES) == ["quality", "near_dedup", "decontamination", "personal_data", "tokens"]
    assert all(staged[n][1] == many.columns for n in list(STAGES)[:-1])
    assert all(len(before) and len(after) for before, _, after in staged.values())


def test_quality_keeps_what_the_model_accepts(spark, sf, many, staged):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out("doc_id", 5, 0))
    scores = {r["doc_id"]: r["score"] for r in nbsvm.score(many, nbsvm.learn(many, labels)).collect()}
    before, _, after = staged["quality"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if scores[r["doc_id"]] >= QUALITY_THRESHOLD)


def test_one_document_of_each_group_stays(staged):
    before, _, after = staged["near_dedup"]
    kept = {i for i, _, component in brute([(r["doc_id"], r["text"]) for r in before], 5) if i == component}
    assert sorted(after) == sorted(r for r in before if r["doc_id"] in kept) and len(after) < len(before)


def test_leaks_go_and_others_stay(spark, sf, staged):
    before, _, after = staged["decontamination"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r, (_, hit, _) in zip(before, windows([r["text"] for r in before], items)) if not hit}
    assert sorted(after) == sorted(r for r in before if r["doc_id"] in clean)


def test_personal_data_is_masked(staged):
    before, _, after = staged["personal_data"]
    own = {r["doc_id"]: r for r in after}
    assert len(own) == len(before)
    for r in before:
        new = own[r["doc_id"]]
        assert not pii.base(new["text"]) and (new["text"] == r["text"] or re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", new["text"]))
        assert bool(pii.base(r["text"])) <= (new["text"] != r["text"]) and new["n_chars"] == len(new["text"])


def test_tokens_give_the_text_back(staged):
    before, columns, after = staged["tokens"]
    assert len(after) == len(before) and all(r["round_trip"] and len(r["ids"]) == 4 * r["n_tokens"] for r in after)
    assert set(columns) >= {"doc_id", "text", "ids", "n_tokens"}


def test_run_is_the_stages_in_turn(spark, sf, staged):
    rows = contract.queries()["pipeline"](spark, sf).select("doc_id", "text", "n_tokens").collect()
    assert sorted(rows) == sorted((r["doc_id"], r["text"], r["n_tokens"]) for r in staged["tokens"][2])


def test_odd_rows_and_empty_tables(spark, sf, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd_docs, sf)
        assert stage(spark, no_docs, sf).count() == 0
        if name != "tokens":
            assert rows.columns == odd_docs.columns
        found = rows.collect()
        if name == "near_dedup":  # of the repeated row one stays; null ids stay
            assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 8, 9]))
        elif name != "quality":
            assert len(found) == odd_docs.count()
        if name in ("near_dedup", "decontamination"):
            assert {r["score"] for r in found} == {"own"}


def test_two_texts_of_one_id(spark, sf):
    docs = spark.createDataFrame([(1, "b c d e f g"), (1, "a b c d e f"), (2, "x y z w v u")], "doc_id long, text string")
    rows = STAGES["near_dedup"](spark, docs, sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(1, "a b c d e f"), (2, "x y z w v u")]


def test_every_numbered_query_is_registered():
    numbered = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in contract.queries() if re.match(r"op\d+_", n))
    assert numbered == list(range(1, 14)) and "pipeline" in contract.queries()
    assert lowered("É A") == "É a"
