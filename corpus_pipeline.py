"""From raw documents to training ids, in five stages. Each takes (spark, docs, sf_dir), works on all that the one before
it kept, and returns a DataFrame; run() writes each result as a table in the shared folder and reads it for the next.

1. quality: documents whose quality score is below 0.7 go.
2. language: documents without a letter, or whose best language has a mean posterior below MIN_OVER_CHANCE times that of
   chance (one over the number of languages learned), go.
3. near_duplicates: of each component of near copies, the document of the smallest id stays.
4. mix: MIX_SHARE of the tokens, dealt over domains, languages and sources by weight; a document is taken once at most.
5. pieces: ids of every document that is left, with merge-dropout.

Edge cases are those of the operators: null and empty texts are scored as empty and leave at stage 2; tables may be empty;
further columns of documents are carried along to stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import byte_gru, mixing, piece_dropout, quality_qda, simhash_segments
from evidentia.llm.common import materialise, table

MIN_OVER_CHANCE = 1.2
MIX_SHARE = (4, 5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_qda.train(docs, table(spark, sf_dir, "labels"))
    return quality_qda.score(docs, model).filter("predicted = 1").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = byte_gru.fit(byte_gru.sample(docs))
    least = min(1.0, MIN_OVER_CHANCE / max(1, len(model.langs))) if model else 1.0
    known = (F.col("lang_pred") != "und") & (F.col("score") >= least)
    return byte_gru.predict(docs, model).filter(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_segments.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaves = mixing.plan(mixing.narrow(docs), share=MIX_SHARE, max_epochs=1)
    own = {"_lang": F.col("lang"), "_source": F.col("source")}
    taken = mixing.select(mixing.with_tree(docs.withColumns(own)), leaves, max_epochs=1)
    return taken.withColumns({"lang": F.col("_lang"), "source": F.col("_source")}).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers of the other stages stay beside this one: it holds less than by itself
    coded = piece_dropout.encode(docs, piece_dropout.model_path(), hold=150_000)
    return coded.select("doc_id", "lang", "source", "n_pieces", "lossless", "ids")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pieces", pieces)]

#: The models and the hashes of these stages are beyond SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
