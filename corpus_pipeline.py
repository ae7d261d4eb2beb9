"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination,
mixing to target weights, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all its predecessor kept, and returns a DataFrame. ``run`` applies
them to ``documents``, each stage written as Parquet into the shared folder and
read again by the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from courtside.llm import decontaminate, mixing, quality, sharding, simhash
from courtside.llm.common import documents, stored


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark, docs, sf_dir):
    """Documents are sampled towards the target shares of sources, languages
    and topics."""
    return mixing.sample(docs)


def shards(spark, docs, sf_dir):
    """Every document gets a shard and a slot, beside all its own columns."""
    return sharding.shard_documents(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

# SQL has no words for fitted models, hash fingerprints and iterative fits:
# tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
