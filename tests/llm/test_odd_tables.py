"""Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables: each operator's defined results."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.llm import decontaminate, line_dedup, lm_score, minhash, mixing, quality_model, quality_rules, secret_scan, span_dedup, toxicity
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def operators(labelled, bench_items):
    return {
        "lines": line_dedup.remove_repeats,
        "toxicity": lambda d: toxicity.toxicity_scores(d, labelled, 3),
        "rules": quality_rules.quality_verdicts,
        "spans": span_dedup.remove_repeats,
        "near": minhash.near_duplicates,
        "secrets": secret_scan.scan,
        "lm": lambda d: lm_score.language_scores(d, F.col("doc_id") == 10),
        "leaks": lambda d: decontaminate.leaks(d, bench_items),
        "quality": lambda d: quality_model.quality_scores(d, labelled),
        "mix": mixing.mix_by_source,
    }


NAMES = ["lines", "toxicity", "rules", "spans", "near", "secrets", "lm", "quality", "mix"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_each(operators, odd, odd_rows, name):
    rows = operators[name](odd).collect()
    assert len(rows) == len(odd_rows)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", [*NAMES, "leaks"])
def test_empty_table(operators, odd, name):
    assert operators[name](odd.limit(0)).count() == 0


def test_leaks(operators, odd):
    assert sorted((r.doc_id, r.item_id) for r in operators["leaks"](odd).collect()) == [(6, 4), (7, 1)]
    left = decontaminate.without_leaks(odd, odd.sparkSession.createDataFrame([(4, "two words")], "item_id long, text string"))
    assert left.columns == odd.columns and left.count() == odd.count() - 1


def test_rows_part_by_text(spark, bench_items):
    """Several rows without doc_id, and one doc_id on two texts: each row is judged by its own text."""
    rng = random.Random(9)
    good = [" ".join(sentence(rng, 14) for _ in range(8)) for _ in range(3)]
    rows = [(None, good[0]), (None, "two words"), (None, None), (5, good[1]), (5, "two words"), (6, good[1]), (7, good[2]), (7, good[2]), (8, good[2]), (4, good[0])]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    left = decontaminate.without_leaks(docs, spark.createDataFrame([(4, "two words")], "item_id long, text string"))
    assert of(left) == sorted((r for r in rows if r[1] != "two words"), key=str)
    assert of(quality_rules.keep_good(docs)) == sorted((r for r in rows if r[1] in good), key=str)
    near = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert near == {(None, None), (5, 5), (6, 5), (7, 7), (8, 7), (4, 4)}
    want = [(None, good[0]), (None, "two words"), (None, None), (4, good[0]), (5, good[1]), (5, "two words"), (7, good[2])]
    assert of(minhash.keep_first(docs)) == sorted(want, key=str)


def test_near_groups(operators, odd):
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles > 0) for r in operators["near"](odd).collect()}
    assert {(1, 1, True, True), (2, 1, False, True), (3, 1, False, True), (4, 4, True, False), (5, 5, True, False), (None, None, True, True)} <= got
    assert minhash.keep_first(odd).where("doc_id in (2, 3)").count() == 0


def test_lines_kept_once(operators, odd, odd_rows):
    got = {r.doc_id: r for r in operators["lines"](odd).collect()}
    base = odd_rows[0][1]
    assert got[1].text == base and got[1].removed == [] and got[2].text == "" and got[2].removed == list(range(8))
    assert got[None].text == base and got[4].text == "" and got[8].text == "\n \n\t" and got[8].n_lines == 0
    assert got[3].text == ""  # all its lines equal those of 1, or are one inserted word of two characters away


def test_spans_kept_once(operators, odd, odd_rows):
    got = {r.doc_id: r for r in operators["spans"](odd).collect()}
    assert got[1].text == odd_rows[0][1] and got[2].text == "" and got[2].first_docs == [1] and got[7].text == odd_rows[7][1]
    assert got[3].text != odd_rows[2][1] and got[3].text


def test_rules_on_odd(operators, odd):
    got = {r.doc_id: r for r in operators["rules"](odd).collect()}
    assert got[4].n_words == got[5].n_words == got[8].n_words == 0 and got[4].base_failed and not got[6].kept
    assert got[9].n_repeat_words == got[9].n_words == 90 and got[9].base_failed
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_language_counts(operators, odd):
    got = {r.doc_id: r for r in operators["lm"](odd).collect()}
    assert got[4].n_tokens == 1 and got[4].n_known == 1 and got[10].held_out and got[6].n_tokens == 3
    assert all(r.score < 0 and r.base_score < 0 for r in got.values())
