"""The pipeline from documents to packed sequences.

Every stage takes (spark, docs, sf_dir), with docs as its predecessor left them; all but the last
return the columns of documents. Other tables are read from sf_dir.

Every stage takes null text as empty (masking leaves it null), judges or keeps rows without an id by their text alone, and gives no rows
for an empty table. Repeated rows share one fate but for near copies, where rows of one id and equal text are one document and all stay.
Long texts are read whole, and columns besides doc_id, text and n_chars pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, packing, pii, simhash, toxicity
from paperloom.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by their nearest labelled examples.

    A text without words scores as such examples do. Without any labels every score is one half, which is above the threshold: nothing
    is kept, as nothing is known to be clean.
    """
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked at a Jaccard similarity of 0.8 over five-word shingles.

    SimHash fingerprints within two bits, found by Golay keys, are verified first; banded minima find the pairs beyond their reach.
    Texts without words are one group; of a tie the smaller id stays; rows without an id always stay.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; an empty benchmark or a null item takes nothing away."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars brought up to date."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; an empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL states neither the nearest examples, fingerprints nor token ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
