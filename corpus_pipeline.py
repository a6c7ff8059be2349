"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, leaked benchmark passages go, secrets
are masked, and what is left is segmented into pieces.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; ``run`` writes each stage's documents
to the shared folder and reads them back, so nothing is computed twice. All but the last return the columns of documents,
with their values; ``n_chars`` is counted anew where a text changes. The last one gives, for each document, its distinct sampled
segmentations: their pieces' ids, from which ``pieces.decoded`` gives back the cleaned text, with scores.

Defined results: null and empty texts are kept by every stage (all of them are one near-duplicate group, of which the smallest
doc_id stays) and have one segmentation without pieces; a document of any length is judged, cut, masked and segmented
whole; of repeated rows, as of all equal texts, one stays; of documents equally near, that of the smallest doc_id stays (null
last), then that of the least hash of its text; a row with a null doc_id is a document of its own text; an empty table gives no
rows; further columns, whatever their names, go through the filtering stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pixelbrook.llm import decontaminate, pieces, secrets, simhash, toxicity
from pixelbrook.llm.arrow import read
from pixelbrook.llm.components import written


def clean_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores ``toxicity.THRESHOLD`` or more go."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its group stays; one without a near duplicate always does."""
    return simhash.distinct_documents(docs)


def no_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth is the benchmark's go; of others the benchmark's words go."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def no_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds' marks; no document goes."""
    return secrets.redact(docs)


def segmented(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each sampled segmentation of each document, with its ids."""
    return pieces.report(docs)


STAGES = [
    ("toxicity", clean_language),
    ("simhash", one_of_each),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("pieces", segmented),
]

#: SQL can express neither the learned grammar nor the sampled segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
