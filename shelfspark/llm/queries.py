"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import ann, codes, decontaminate, dedup, fingerprints, langid, packing, periodic, pii, quality, toxicity, urls, warc
from shelfspark.llm.core import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every vector whose id is divisible by 100; unusable vectors take no part."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all `pages`, linked to their responses."""
    made = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    source = F.filter("headers", lambda h: h["name"] == "WARC-Source-Payload-Digest")[0]["value"]
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest",
        source.alias("source_digest"), F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of personal data in every document; a null text is an empty one."""
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; null and empty texts have the model's base rate."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, by 2-word shingles; documents without words are alone."""
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; null and odd urls have an empty host and path."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document and a test item; null and empty texts have none."""
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; a null text is the end token alone.

    As few sequences as can be leave no room for other bounds: documents and attention cost take part in
    the choice of a sequence, and their capacities are the most that 2048 tokens can have.
    """
    pieces = packing.tokenize(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces, max_docs=2048, max_attention=2048.0**2).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grade of every document, and whether it is more likely than not over the lowest."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, ratings(_table(spark, sf_dir, "labels")))
    least = quality.over(model, 0)
    return quality.grade(docs, model).select("doc_id", "expected_grade", least.alias("p_over_0"), quality.over(model, 1).alias("p_over_1"), (least >= 0.5).alias("kept"))


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of `labels`: 0 of low quality, 1 of good quality but toxic, 2 good and clean."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; `und` where the text is null or has no letter."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document; a tenth of the documents get a periodic tail first."""
    return periodic.digest(periodic.find(periodic.with_planted(_table(spark, sf_dir, "documents")), repeats=4, least=6))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors from 16 codebooks of 64 entries after two rounds over all vectors."""
    return codes.compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last half replaced, and how alike they are."""
    return fingerprints.edited(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nearest, op2_warc, op3_pii, op4_toxicity, op5_minhash, op6_urls, op7_decontaminate, op8_packing, op9_quality, op10_language, op11_periodic, op12_codes, op13_fingerprints)
}
