"""The registered queries of this package and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, table
from pagelog.llm.decontaminate import contaminated
from pagelog.llm.fingerprints import fingerprint_documents
from pagelog.llm.html import extract_pages
from pagelog.llm.line_dedup import LINE_DEDUP_SQL, dedup_lines
from pagelog.llm.packing import pack_documents
from pagelog.llm.pii import KINDS, scan_pii
from pagelog.llm.secrets import BASE_RULES, scan_secrets
from pagelog.llm.sharding import Tiers, shard_table
from pagelog.llm.simhash import near_duplicates
from pagelog.llm.toxicity import score_toxicity


def default_tokenizer() -> str:
    """Where the public vocabulary lies on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spans(where: str) -> Column:
    """kind:start:end of the spans that the condition holds for, comma-joined."""
    kept = F.filter(F.arrays_zip("kind", "start", "end", "base"), lambda s: F.expr("true") if where == "all" else s["base"])
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter(F.arrays_zip("kind", "base"), lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")


def _digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """n_* count the base spans by kind, n_spans all of them, those that the method adds included."""
    return found.select("doc_id", *[_count(k) for k in kinds], F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("all").alias("spans"), F.size("kind").cast("long").alias("n_spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in BASE_RULES]
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return _digest(found.withColumn("base", F.transform("kind", lambda k: k.isin(kinds))), kinds)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they come back from a store that took them in four arrivals and compacted them."""
    root = f"{Scratch(spark, 'shards').root}"
    store = shard_table(table(spark, sf_dir, "documents"), root, arrivals=4, key="doc_id", tiers=Tiers())
    return store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


OP2_SQL = "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(scan_pii(table(spark, sf_dir, "documents")), list(KINDS))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_secret_scan, op2_sharding, op3_pii, op4_html, op5_fingerprints, op6_line_dedup, op7_simhash, op8_packing, op9_decontamination, op10_toxicity)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op6_line_dedup": LINE_DEDUP_SQL}
