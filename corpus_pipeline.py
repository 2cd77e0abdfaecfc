"""Corpus pipeline: documents of a clear language, without repeated lines, near copies or benchmark passages, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

Null, empty and letterless texts have no language and go in the first stage, as do
those whose margin is narrow. Rows repeated with equal id and text are copies of each
other, of which one stays after the third stage; unlike texts under one id, or under
none, are documents of their own. Columns besides ``doc_id`` and ``text`` pass through
to the last stage but one whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontaminate, language, lines, minhash, packing
from stratalog.llm.common import checkpoint, discard, table
from stratalog.llm.queries import tokenizer_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(language.training_rows(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", identify), ("line dedup", dedup_lines), ("near-dedup", drop_near_copies), ("decontamination", decontaminated), ("packing", pack)]

#: Compression, SimHash and sampling have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
            discard(before)
    return docs
