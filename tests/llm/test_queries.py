"""Registered queries: SQL twins, contracts of columns, and the pipeline stage by stage."""

import re

import duckdb
import pytest

import corpus_pipeline
from contactmill.llm.oracles import ORACLES
from contactmill.llm.queries import QUERIES
from contactmill.session import written

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_langid": "doc_id bigint, held_out boolean, lang_pred string, score double", "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int", "op5_urls": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_main_text": "page_id bigint, url string, text string, n_chars bigint", "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11_fim": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op12_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op13_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    df = QUERIES[name](spark, SMALL)
    got = sorted(map(tuple, df.collect()))
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})")
    assert got == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = dict(QUERIES[name](spark, SMALL).dtypes)
    assert {c.split()[0]: c.split()[1] for c in COLUMNS[name].split(", ")}.items() <= kinds.items()


def test_every_operator_is_registered_once():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


def test_pipeline_stages_keep_the_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    empty, names = docs.limit(0), docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SMALL).count() == 0
        docs = written(stage(spark, docs, SMALL))
        assert docs.columns[:len(names)] == names and docs.count() > 0
        assert docs.columns == names or i + 1 == len(corpus_pipeline.STAGES)
    assert docs.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.]'").count() == 0
