"""Documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run``
writes every stage's result as Parquet in the shared folder and reads it again.  All
but the last return the columns of the documents, in their order.

1. language: documents whose language model rejects them go (see ``language_id``).
2. lines: lines of ten documents or more go; ``n_chars`` follows the new text.
3. near duplicates: one row of each group stays, the one of the smallest id (rows without
   id after all others; of rows of equal id and text the one whose other columns come first as JSON).
4. decontamination: documents that hold a benchmark window go.
5. mix: size, target, copies and taken words of every document that is left.

No ORACLE_SQL: SQL cannot express the first stage, nor the tilts of the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.llm.decontamination import decontaminate
from tracewright.llm.exchange import shared_folder
from tracewright.llm.language_id import held_out, identify, train
from tracewright.llm.line_dedup import line_dedup
from tracewright.llm.near_dedup import near_duplicates, row_key
from tracewright.llm.source_mixing import mix_sources

ORACLE_SQL = None


def _row(docs, *more):
    """The row without its text, as one column, and the text."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text"), *more).alias("row"), "text")


def _columns(docs):
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def language(spark, docs, sf_dir):
    models = train(docs, teach=~held_out("doc_id"))
    found = identify(_row(docs), models, "row", with_text=True)
    return found.filter(~F.col("rejected")).select(*_columns(docs))


def lines(spark, docs, sf_dir):
    found = line_dedup(_row(docs, F.col("text").isNull().alias("no_text")), "row", min_docs=10)
    text = F.when(~F.col("row.no_text"), F.col("kept"))
    found = found.select("row", "n_dropped", text.alias("text"))
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
    return found.select(*(changed.cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else column
                          for c, column in zip(docs.columns, _columns(docs))))


def near_copies(spark, docs, sf_dir):
    keepers = near_duplicates(docs).filter("row_key = keeper").select(F.col("row_key").alias("key"))
    others = F.to_json(F.struct(*(docs[c] for c in docs.columns if c != "text")))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("key"), others.alias("others"))
    kept = keyed.join(keepers, "key", "left_semi").groupBy("key").agg(F.min_by("row", "others").alias("row"))
    return kept.select("row.*")


def contaminated(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(_row(docs), items, "row", with_text=True)
    return found.filter("n_hit = 0").select(*_columns(docs))


def mix(spark, docs, sf_dir):
    return mix_sources(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near duplicates", near_copies),
    ("decontamination", contaminated),
    ("mix", mix),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
