"""From raw documents to encoded training text in five stages; each works on all that the one before it kept.

Toxic texts go, one document of each near-duplicate group stays, personal data is replaced, sources are mixed to their
target weights, and what is left is encoded to byte-level BPE ids. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from tesserae.llm import bpe, mixing, ngram_join, pii, toxicity
from tesserae.llm.common import Scratch, table


def toxicity_stage(spark, docs, sf_dir):
    """Documents that score 0.3 or more go; the classifier is fitted on the labelled rows of ``sf_dir``'s documents."""
    model = toxicity.fit_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each component of documents linked by five-word shingles (0.75 or more) the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def pii_stage(spark, docs, sf_dir):
    return pii.redact_documents(docs)


def mixing_stage(spark, docs, sf_dir):
    """Documents repeated by the copies that the mix takes of them (0, 1 or 2)."""
    return mixing.repeat_documents(docs)


def encoding_stage(spark, docs, sf_dir):
    """Ids, their digest and the decoded bytes' digest for every row."""
    return bpe.encode_texts(docs, ids=True).drop("decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing sources", mixing_stage),
    ("byte-level bpe", encoding_stage),
]

#: No SQL expresses the classifier, the trees or the encoder: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order on ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    last = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
