"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WARC_DATE = "2024-01-01T00:00:00Z"      # records carry a given date; nothing reads the clock


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Bytes of a public vocabulary file and the pattern that splits words for it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.bpe import decode_documents, encode_documents

    ranks, pattern = rank_file()
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    done = decode_documents(coded.drop("text"), ranks, digest="ids_sha256")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.html_text import extract_main_text

    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"),
                      F.length("main_text").cast("long").alias("n_chars"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.common import stored
    from glint.llm.warc import mark_revisits, read_bundles, write_bundles

    bundles = stored(write_bundles(mark_revisits(table(spark, sf_dir, "pages")), WARC_DATE), "warc")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.histogram_shard import shard_by_bytes

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")))
    return shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.toxicity import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_quality", "p_toxic", "toxic")


@query
def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.pii import KINDS, find_spans, joined, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, train(docs))
    kinds = F.transform("base", lambda x: x["kind"])
    count = [F.size(F.array_remove(kinds, k)).cast("long") for k in KINDS]
    count = [(F.size("base") - n).alias(f"n_{k}") for n, k in zip(count, KINDS, strict=True)]
    return found.select("doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("found").alias("spans"))


@query
def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.spotsigs import add_signatures, edited_text, fingerprint, likeness, with_next

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = with_next(docs, add_signatures, ["text", "sigs"])
    d = d.withColumn("edited", edited_text(F.col("text"), F.col("next.text")))
    d = add_signatures(d.select("doc_id", "text", "edited", "sigs", F.col("next.sigs").alias("next_sigs")),
                       "edited", "edited_sigs")
    return d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                    F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                    fingerprint(F.col("sigs")).alias("fingerprint"),
                    fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                    likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                    likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


@query
def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.suffix_dedup import find_repeats

    found = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.interpolation import DELETED, KEPT, TEST, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tenth = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))
    role = F.when(tenth == 0, TEST).when(tenth == 1, DELETED).otherwise(KEPT)
    return score_documents(docs, role)


def vocabulary_file(name: str) -> bytes:
    """Bytes of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"),
                 vocabulary_file("piece_bpe_32k.model"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glint.llm.hard_negatives import mine, usable

    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    label = F.when(F.col("item_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("item_id", label.alias("label"), F.transform("vec", lambda x: F.floor(256 * x)).alias("vec"))
    return mine(rows, F.col("item_id") % 100 == 0, item_id="item_id", vec="vec")


ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS item_id, a.label = c.label AS same,
         CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, item_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, item_id) <= 5),
n AS (
  SELECT p.*, s.item_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.item_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
