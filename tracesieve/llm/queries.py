"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracesieve.llm.chat import best_paths, conversations, linear_messages, read_back
from tracesieve.llm.decontaminate import contaminated
from tracesieve.llm.fingerprints import near_duplicates
from tracesieve.llm.html_text import extract
from tracesieve.llm.knn import top_k
from tracesieve.llm.licenses import scan_licenses
from tracesieve.llm.merkle import verified
from tracesieve.llm.packing import pack
from tracesieve.llm.quality import THRESHOLD, held_out, score, train
from tracesieve.llm.secrets import scan
from tracesieve.llm.token_counts import token_counts as count_tokens
from tracesieve.llm.token_files import read_token_files, write_token_files
from tracesieve.llm.whitening import whiten


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"))
    made = conversations(best_paths(linear_messages(rows)))
    turns, loss = read_back(F.col("formatted"), F.col("loss"))
    read = made.select("tree", "formatted", turns.alias("turns"), loss.alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(F.col("tree") != "-", F.substring("tree", 2, 30)).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return extract(_table(spark, sf, "pages"))


def benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it repeats."""
    return contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).select("doc_id", "item_id", "similarity", "start_word")


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The secrets in every document: base spans and linked parts of credentials."""
    return scan(_table(spark, sf, "documents"))


def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 best other vectors of each whose id is divisible by 50."""
    return top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The licence phrases and templates in every document."""
    return scan_licenses(_table(spark, sf, "documents"))


def quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality score, by a model fitted on labelled rows that are not held out."""
    docs = _table(spark, sf, "documents")
    found = score(docs, train(docs, _table(spark, sf, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's fingerprint over 3-word shingles and its group at 3 or fewer differing bits."""
    found = near_duplicates(_table(spark, sf, "documents"), shingle=3, radius=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's token pieces and their places in windows of 4096."""
    return pack(_table(spark, sf, "documents"))


def token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids, written as token-id files and read back."""
    return read_token_files(spark, write_token_files(_table(spark, sf, "documents")))


def embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector on the 8 leading components of the covariance of all, each scaled to unit variance."""
    return whiten(_table(spark, sf, "embeddings"), count=8).withColumn("deviation", F.col("deviation").cast("long"))


def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the dataset's Merkle tree, and whether a tampered copy of it still leads to the root."""
    return verified(_table(spark, sf, "documents"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many bytes and tokens every document has, and whether it has over 512 tokens."""
    return count_tokens(_table(spark, sf, "documents"))


QUERIES = {
    "op1_chat_format": chat_format,
    "op2_html_extraction": html_extraction,
    "op3_benchmark_decontamination": benchmark_decontamination,
    "op4_secret_scan": secret_scan,
    "op5_exact_top_k": exact_top_k,
    "op6_license_scan": license_scan,
    "op7_quality_classifier": quality_classifier,
    "op8_simhash_near_dedup": simhash_near_dedup,
    "op9_packing": packing,
    "op10_token_files": token_files,
    "op11_embedding_whitening": embedding_whitening,
    "op12_merkle_manifest": merkle_manifest,
    "op13_token_counts": token_counts,
}
