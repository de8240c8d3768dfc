"""The registered queries of the corpus operators: each applies one, with production parameters, to its whole table.

Where SQL cannot say a query (no XXH64, no vocabulary, no model), tests compare it with brute force: the ids of op1 with the
library's (test_op1_equals_the_library), the counts of op2 with greedy matching (test_automaton_counts_greedy_pieces),
the spans of op5 with plain matching and an exhaustive segmentation (test_op5_base_spans,
test_long_values_are_costed_whole), the loss and the swaps of op6 and the scores of op7 with counts by hand
(test_minimised_weights_equal_a_plain_minimiser, test_language_scores_equal_brute_force), the probabilities of op8
over seeds (test_inclusion_probabilities_over_seeds), the splits and the decoding of op9 with all choices
(test_boosting_equals_a_plain_learner_of_one_split, test_decoding_equals_brute_force) and the groups of op10 with all
pairs (test_op10_equals_brute_force).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bpe, htmltext, langid, mixing, neighbours, quality, secrets, simhash, tokencount, toxicity
from folio.llm.common import table
from folio.sources.tables import spread


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """The file and the split pattern of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spread(table(spark, sf_dir, "documents")), *vocabulary())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(spread(table(spark, sf_dir, "documents")), vocabulary("piece_bpe_32k.model")[0])


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spread(table(spark, sf_dir, "documents")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.tiktoken")[0])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spread(table(spark, sf_dir, "documents")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(spread(table(spark, sf_dir, "pages")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_token_counts, op3_quality_cascade, op4_embedding_near_dedup, op5_secret_scan, op6_toxicity, op7_language_id, op8_source_mix, op9_html_main_text, op10_simhash_near_dedup)}
ORACLES: dict[str, str] = {"op3_quality_cascade": quality.SCORE_SQL, "op4_embedding_near_dedup": neighbours.LINKS_SQL}
