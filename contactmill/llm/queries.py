"""Registered queries of the training-data operators and their SQL twins (DuckDB)."""

from __future__ import annotations

from contactmill.llm import decontaminate, fim, langid, maintext, mixing, phrases, pii, quality, secret_spans, simhash, tokens, toxicity, urltree
from contactmill.llm.common import table
from contactmill.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_langid(spark, sf_dir):
    return langid.op1_langid(table(spark, sf_dir, "documents"))


def op2_tokens(spark, sf_dir):
    return tokens.op2_tokens(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.op3_pii(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.op4_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_urls(spark, sf_dir):
    return urltree.op5_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_simhash(spark, sf_dir):
    return simhash.op6_simhash(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.op7_quality(table(spark, sf_dir, "documents"))


def op8_main_text(spark, sf_dir):
    return maintext.op8_main_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.op9_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark, sf_dir):
    return mixing.op10_mixing(table(spark, sf_dir, "documents"))


def op11_fim(spark, sf_dir):
    return fim.op11_fim(table(spark, sf_dir, "documents"))


def op12_secrets(spark, sf_dir):
    return secret_spans.op12_secrets(table(spark, sf_dir, "documents"))


def op13_phrases(spark, sf_dir):
    return phrases.op13_phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_tokens, op3_pii, op4_toxicity, op5_urls, op6_simhash, op7_quality, op8_main_text, op9_decontaminate, op10_mixing, op11_fim, op12_secrets, op13_phrases)}
