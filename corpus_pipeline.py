"""From raw documents to a training mix: five stages, each a table that the next one reads.

Every stage decides over all rows that its predecessor kept: toxic documents go, of equal texts and of near copies one
document stays, documents that hold a benchmark item go, and from the rest tokens are drawn by the target weights.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontaminate, exact_dedup, queries, similar, toxicity
from strandline.sources.shared import stored

#: Text of an Arrow batch; it lies outside the heap, once on the way to Python and several times in a worker.
ARROW_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """A stage may be run by itself, so each one sees to the setting."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lexicon is learned from the labelled rows among ``docs``."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, queries.table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one_of_similar(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def draw_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch, take_tokens): what a training run reads."""
    return queries.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing sources to target weights", draw_mix),
]
STAGES = [(name, _in_small_batches(stage)) for name, stage in STAGES]

#: Fingerprints and alignments have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return stored(STAGES[-1][1](spark, docs, sf_dir), "mix")
