"""Registered corpus queries against DuckDB where SQL can express them, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from notewise.llm import bpe, exact_dedup, oracle, queries, toxicity
from notewise.llm.common import read_table
from oracle_check import TABLES, compare
from test_whole_job import _groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(oracle.ORACLE_SQL))
def test_matches_oracle(spark, con, key):
    line = compare(spark, con, SF, key)
    assert " OK " in line, line


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "bpe"]


def test_pipeline_stage_by_stage(spark):
    """Each stage's decision against a plain computation over what the stage before kept."""
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    folder = spark.conf.get("spark.checkpoint.dir")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        path = f"{folder}/stage-test-{spark.sparkContext.applicationId}/{number}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        if name != "bpe":
            assert docs.columns == columns and all(before[r.doc_id] == r.text for r in rows)
        if name == "toxicity":
            lexicon = toxicity.learn(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
            machine = lexicon.automaton()
            assert sorted(ids) == sorted(i for i, t in before.items() if toxicity.probability(
                toxicity.strength(t, machine), lexicon) < toxicity.THRESHOLD)
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                key = (t or "").encode().lower()  # bytes.lower folds A-Z only
                best[key] = max(i, best.get(key, i))
            assert sorted(ids) == sorted(best.values())
        elif name == "near_dedup":
            texts = list(before.items())
            group = _groups(texts, corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.NEAR_PERCENT)
            keep = {g: min(i for (i, _), h in zip(texts, group, strict=True) if h == g) for g in set(group)}
            assert sorted(ids) == sorted(keep.values()) and len(ids) < len(before)
        elif name == "source_mix":
            assert set(ids) <= set(before) and max(ids.count(i) for i in set(ids)) <= 2
        else:
            model = bpe.load(queries.tokenizer_path())
            assert {(r.doc_id, r.n_tokens) for r in rows} == {(i, len(model.encode(t))) for i, t in before.items()}


def test_keep_one_keeps_columns(spark, make_docs):
    docs = make_docs([(1, "A b"), (2, "a B"), (3, "c"), (3, "c"), (None, None), (4, "")], extra="1 as n;2 as sha")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
