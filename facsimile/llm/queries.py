"""One query per operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from facsimile.llm import exact, licenses, pii, secret_scan
from facsimile.llm.alignment import alignments
from facsimile.llm.mixing import mix
from facsimile.llm.neardup import near_duplicates
from facsimile.llm.packing import pack
from facsimile.llm.quality import judge
from facsimile.llm.store import read
from facsimile.llm.suffix import remove_repeats
from facsimile.llm.token_counts import token_counts
from facsimile.llm.topk import top_k
from facsimile.llm.trie import ORACLE as TRIE_ORACLE
from facsimile.llm.trie import prefix_trie

ROOT = str(Path(__file__).resolve().parents[2])
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Bytes of texts that a Python worker gets at once.
BATCH_BYTES = "8m"


def ready(spark: SparkSession) -> None:
    """Python workers on this machine find the package wherever the driver was started; on a cluster
    it is installed or sent with --py-files.  Batches of texts are bounded in bytes, not only in rows."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(read(spark, sf_dir, "documents")))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


ORACLES["op4_license_scan"] = licenses.oracle()


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


# the whole table of scaled components against the queries; whole-number sums of products
ORACLES["op5_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)) as x from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5"""


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan_personal(read(spark, sf_dir, "documents")))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = TRIE_ORACLE


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = exact.ORACLE


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(read(spark, sf_dir, "documents"))
