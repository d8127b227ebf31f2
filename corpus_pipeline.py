"""From raw documents to a training mix: five stages, each over all that the one before has kept.

1. quality rules: documents that fail the base test or that the learned list rejects go;
2. near duplicates: of each group of texts linked by a shingle Jaccard of 0.8 the first document stays;
3. decontamination: documents that overlap a benchmark item go;
4. personal data: spans give way to [KIND] marks;
5. mixing: documents are repeated or left out so that sources meet their target weights.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenq.llm import decontaminate, jaccard_join, mixing, pii, quality_rules
from lumenq.llm._common import release, stage, table

STAGES = [
    ("quality_rules", quality_rules.filter_documents),
    ("near_duplicates", jaccard_join.keep_first),
    ("decontamination", decontaminate.drop_contaminated),
    ("personal_data", pii.mask_documents),
    ("source_mixing", mixing.mix_documents),
]

#: Learned rules, iterated solvers and set joins have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
        release(spark)
    return docs
