"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents``, whatever they are. Nulls, empty texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from contactmill.llm import decontaminate, mixing, pii, simhash, toxicity
from contactmill.llm.common import forget, table, written


def drop_toxic(spark, docs, sf_dir):
    """Operator 4: documents that the classifier rejects go; it learns from ``labels`` on the documents given."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    """Operator 6: one document of every near-duplicate component stays."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Operator 9: documents with a passage of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark, docs, sf_dir):
    """Operator 3: personal data is masked in the text; all documents stay."""
    return pii.redacted(docs)


def mix_sources(spark, docs, sf_dir):
    """Operator 10: documents repeated or left out so that every source meets its share of the words."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("decontamination", drop_benchmark),
          ("personal_data", mask_personal_data), ("mixing", mix_sources)]

#: SQL can't express the trained models (stages 1 and 4), the fingerprints (2) and the alignment (3).
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
            if i:
                forget(spark, before)
    return docs
