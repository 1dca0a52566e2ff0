"""Queries of the operators on language text over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.chunking import split_oversized
from turnwise.llm.language import UNKNOWN, LanguageFilters, identify_languages, language_filters
from turnwise.llm.lexicon import label_lang
from turnwise.llm.mixing import mix_sources
from turnwise.llm.packing import pack_items
from turnwise.llm.pairs import defective_pairs
from turnwise.llm.ranking import best_of, combined_ranking
from turnwise.llm.sentences import split_sentences
from turnwise.llm.turns import speaker_turns
from turnwise.llm.tokens import token_count
from turnwise.session import table

_LABELLED = {"transcript_chunks": ("chunk_id", "detected_language"), "documents": ("doc_id", "lang")}


def _filters(spark: SparkSession, sf_dir: str) -> LanguageFilters:
    return language_filters(table(spark, sf_dir, "transcript_chunks"), "detected_language", "text")


def _languages(spark: SparkSession, sf_dir: str, cases_only: bool) -> DataFrame:
    filters = _filters(spark, sf_dir)
    parts = [
        identify_languages(table(spark, sf_dir, name), key, label, "text", filters, cases_only).select(F.lit(name).alias("record_table"), "*")
        for name, (key, label) in _LABELLED.items()
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, True).filter(F.col("lang") != UNKNOWN).select("record_table", "record_id", "lang").distinct()


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, False).distinct()


def _ranked(spark: SparkSession, sf_dir: str, with_place: bool) -> DataFrame:
    candidates = table(spark, sf_dir, "qa_candidates").select("audio_source_id", "qa_candidate_id", "similarity_score", "retrieval_score").dropDuplicates(["qa_candidate_id"])
    scores = table(spark, sf_dir, "responsiveness_scores").select("qa_candidate_id", "score").dropDuplicates(["qa_candidate_id"])
    return combined_ranking(candidates.join(scores, "qa_candidate_id", "left"), "audio_source_id", "qa_candidate_id", {"score": 1, "retrieval_score": 1, "similarity_score": -1}, with_place)


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, True)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of(_ranked(spark, sf_dir, False), "audio_source_id", "qa_candidate_id", 3).select("audio_source_id", "qa_candidate_id")


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "rendered_groups"), "group_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_sentences(spark, sf_dir).select("group_id", "start_offset", "end_offset").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = defective_pairs(table(spark, sf_dir, "qa_candidates"), "qa_candidate_id", "question_text", "answer_text", _filters(spark, sf_dir))
    return found.withColumnRenamed("pair_id", "qa_candidate_id")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "transcript_chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = speaker_turns(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "transcript_chunks"), with_text=False)
    return turns.select("audio_source_id", "speaker_no", "start_ms", "end_ms").distinct()


def _limit(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "token_limits").filter(F.col("purpose") == purpose).select("max_tokens", "overlap_tokens").first()
    return row[0], row[1]


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", token_count(F.col("text")).alias("tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(_sized(spark, sf_dir), "doc_id", "tokens", _limit(spark, sf_dir, "pack")[0])


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, against the fewest that could hold all tokens."""
    capacity = _limit(spark, sf_dir, "pack")[0]
    bins = p8_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("size").alias("filled"), F.count(F.lit(1)).alias("items"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("filled") / capacity).alias("least"), (F.sum("filled") / F.count(F.lit(1)) / capacity).alias("fill"), F.max("filled").alias("fullest")
    )


#: Domains of the sources, the top level of the budget tree.
_DOMAINS = {"teaching": "lecture seminar tutorial audience_qa", "talk": "interview panel podcast", "notes": "field_notes"}


def _language_of(label: Column) -> Column:
    @F.pandas_udf("string")
    def resolved(labels: pd.Series) -> pd.Series:
        return labels.map({x: label_lang(x) for x in labels.unique()})

    return resolved(label)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = _sized(spark, sf_dir).withColumn("language", _language_of(F.col("lang")))
    areas = F.create_map(*[F.lit(x) for area, names in _DOMAINS.items() for name in names.split() for x in (name, area)])
    targets = table(spark, sf_dir, "mix_targets").withColumn("domain", F.coalesce(F.element_at(areas, F.col("source")), F.lit("other")))
    return mix_sources(sized, "doc_id", "tokens", "source", "language", targets, domain="domain")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", *_limit(spark, sf_dir, "split"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pieces(spark, sf_dir).filter("piece_no = 1").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_ranking": p1_ranking,
    "p2_found": p2_found,
    "p2_sentences": p2_sentences,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_turns": p6_turns,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}

SQL: dict[str, str] = {}
