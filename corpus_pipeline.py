"""Corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

1. quality: documents that the quality rules reject go.
2. near_duplicates: one document of each group of near duplicates stays (five-word
   shingles, Jaccard similarity of 0.8 or more).
3. repeated_strings: 50-byte strings that start in a document of a smaller id are cut.
   A document that is cut to nothing keeps its row, with an empty text.
4. decontaminate: documents contaminated by ``benchmark`` go.
5. pack: documents are tokenised and packed into sequences of 2,048 tokens.
"""

import uuid

from tidemill.llm import decontaminate, graph, jaccard, packing, quality, substrings


def quality_stage(spark, docs, sf_dir):
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark, docs, sf_dir):
    return jaccard.representatives(docs)


def repeated_string_stage(spark, docs, sf_dir):
    return substrings.dedup(docs)


def decontamination_stage(spark, docs, sf_dir):
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark, docs, sf_dir):
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("decontaminate", decontamination_stage),
    ("pack", packing_stage),
]
#: Packing and the likelihood ratio are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what each returns is written to the shared folder, and removed there when
    the next one's is. The last but one's stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{graph.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            graph.remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
