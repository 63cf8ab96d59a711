"""Queries of this subpackage over the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import dialogue, fingerprint, hostrules, idfiles, jaccard, language, mixing, oracles, packing, periodic, pii, quality, rollup, tokens, toxicity
from fleetlens.llm.tables import documents, fresh_path, held_out, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    found = language.predict(docs, language.fit(docs, train=~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to equal shares of the sources, but twice the share for src1 and half for src2."""
    return mixing.mix(documents(spark, sf_dir), MIX_WEIGHTS, seed=MIX_SEED).drop("shuffle_key")


#: Target weights of the registered mixture; every other source weighs 1.
MIX_WEIGHTS, MIX_SEED = {"src1": 2.0, "src2": 0.5}, 17


@query
def op4_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edits and of their successors."""
    return fingerprint.neighbours(documents(spark, sf_dir))


@query
def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files, read back."""
    docs = documents(spark, sf_dir)
    return idfiles.read_digest(idfiles.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), idfiles.ids_folder(docs)))


@query
def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and verdicts of all documents, with ``source`` as the host."""
    return hostrules.judge(documents(spark, sf_dir)).select("doc_id", *hostrules.MEASURES, "base_failed", "kept")


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document at a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_of", "n_links", "n_set_links")


@query
def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels, train_fold=~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those the boosted trees add."""
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


#: The tokenizer versions of the rollup and their files.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.json", "word_bpe_49k": "word_bpe_49k.json"}


@query
def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after four batches over all documents, one of them sent twice.

    All documents arrive counted by one tokenizer; those in English are revised to the other; documents whose
    text another document with a lower id has are deleted; the revision is sent again.
    """
    ledger = rollup.Ledger(spark, fresh_path(spark, "rollup"))
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"))
    counted = stored(tokens.with_counts(docs, {name: public_tokenizers.path(file) for name, file in VERSIONS.items()}), "token-counts")
    (old, old_tokens), (new, new_tokens) = ((F.lit(name), F.col(name)) for name in VERSIONS)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    first = counted.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    copies = counted.where(F.col("doc_id").isNotNull()).join(first, ["text_key", "doc_id"], "left_anti")
    revision = rollup.changes(counted.where(english), "revise", new, new_tokens, old, old_tokens)
    version, tokens_now = F.when(english, new).otherwise(old), F.when(english, new_tokens).otherwise(old_tokens)
    ledger.apply("load", rollup.changes(counted, "insert", old, old_tokens))
    ledger.apply("revise-en", revision)
    ledger.apply("drop-copies", rollup.changes(copies, "delete", version, tokens_now))
    ledger.apply("revise-en", revision)
    return ledger.totals()


@query
def op11_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, train_fold=~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after a damage that is decided by hashes."""
    turns = dialogue.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    gone = F.col("gone")
    return dialogue.digest(turns, dialogue.plan(turns, gone=gone), gone=gone)


def with_loop(text: Column, doc_id: Column) -> Column:
    """Texts in which one document in ten goes on periodically from some word to its end, by a hash of its id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    looped = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, loop(w)).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, looped).otherwise(text)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document, one in ten of them made periodic."""
    docs = documents(spark, sf_dir)
    found = periodic.find_runs(docs, text=with_loop(F.col("text"), F.col("doc_id")))
    best = periodic.longest()
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(periodic.listed(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
