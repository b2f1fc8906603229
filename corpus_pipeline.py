"""A training corpus from raw documents, in stages that are each written and read again."""

from __future__ import annotations

from rolemill.llm import stages
from rolemill.llm.common import read, written

STAGES = [
    ("language ID", stages.language_stage),
    ("line dedup", stages.line_stage),
    ("jaccard join", stages.jaccard_stage),
    ("mixing", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: Language ID and the bucket boundaries' dynamic program have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
