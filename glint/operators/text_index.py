"""BM25 index as tables, and scoring as joins.

The index is one row per document (``forward``: ``doc_id, dl, terms[], tfs[]`` and carried columns),
counted in place: a document is one row, so its terms are sorted and run-length counted inside the
row and nothing is shuffled. Only the statistics of a term (``terms``: ``term, df, idf, top_tf, least_dl``) are a
shuffle, after a partial aggregate. ``postings`` (``doc_id, term, tf, dl``) is the forward index exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glint.functions.snowball import stem_counts
from glint.functions.text import tokenize

K1 = 1.5
B = 0.75
EPSILON = 0.25
BROADCAST_BYTES = 32 << 20
RANK_PLACES = 9


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes, from its own values."""
    def of(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(t, T.ArrayType):
            fixed = not isinstance(t.elementType, (T.StringType, T.BinaryType))
            n = F.when(c.isNull(), 0).otherwise(F.size(c)) * 8 if fixed else F.aggregate(
                F.coalesce(c, F.array().cast(t)), F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
            return n + 16
        return F.lit(8)
    total = F.lit(16)
    for f in schema.fields:
        total = total + of(F.col(f"`{f.name}`"), f.dataType)
    return total


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` only when its rows take at most ``max_bytes`` (measured on its own values; the rows
    are kept for the join, so the input runs once)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    size = df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


@dataclass
class BM25Index:
    forward: DataFrame                   # doc_id, dl, terms[], tfs[], carried columns: one row per document
    terms: DataFrame                     # term, df, idf, top_tf, least_dl (bounds of a term's share of a score)
    n_docs: int
    avgdl: float
    variant: str = "okapi"

    @property
    def postings(self) -> DataFrame:
        return postings_of(self.forward)


def postings_of(forward: DataFrame, *more: str) -> DataFrame:
    """``doc_id, term, tf, dl`` (and columns ``more``) from the forward index."""
    return (forward.select("doc_id", "dl", *more, F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
            .select("doc_id", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"), "dl", *more))


def count_terms(tokens, known: bool = False) -> Column:
    """Struct ``dl, terms, tfs`` of an array of tokens: its size, its distinct tokens in order, and how often each
    occurs. Sorted once, then the places where a token differs from the one before it are taken. ``known``: no token
    is NULL, as from a text, and the sort needs no comparing function (``array_sort`` calls one per comparison)."""
    def counted(t: Column) -> Column:
        n = F.size(t)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                          lambda i: (n > 0) & ((i == 0) | (F.get(t, i) != F.get(t, F.greatest(i - 1, F.lit(0))))))

        def cut(s: Column) -> Column:
            tfs = F.transform(s, lambda at, i: (F.coalesce(F.get(s, i + 1), n) - at).cast("long"))
            return F.struct(n.alias("dl"), F.transform(s, lambda at: F.get(t, at)).alias("terms"), tfs.alias("tfs"))
        return F.get(F.transform(F.array(starts), cut), F.lit(0))
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    in_order = F.sort_array if known else F.array_sort
    return F.get(F.transform(F.array(in_order(F.coalesce(c, F.array().cast("array<string>")))), counted), F.lit(0))


def forward_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "content", tokens: str | None = None,
                 carry: tuple = ()) -> DataFrame:
    """Forward index of ``docs``; no shuffle. ``tokens`` names a column of tokens to use instead of the text."""
    counts = count_terms(F.col(tokens)) if tokens else count_terms(tokenize(text), known=True)
    return (docs.select(F.col(doc_id).alias("doc_id"), *carry, counts.alias("_c"))
            .select("doc_id", "_c.dl", "_c.terms", "_c.tfs", *carry))


def stem_forward(forward: DataFrame) -> DataFrame:
    """The forward index by Snowball stems: each distinct term is stemmed once and joined back. Lengths stay."""
    p = stem_counts(postings_of(forward), ["doc_id"], "tf", ("dl",), by=["doc_id"])
    rows = p.groupBy("doc_id").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("_p"))
    rows = rows.select("doc_id", "dl", F.col("_p.term").alias("terms"), F.col("_p.tf").alias("tfs"))
    return rows.unionByName(forward.filter(F.size("terms") == 0).select("doc_id", "dl", "terms", "tfs"))


def term_freq(docs: DataFrame, doc_id: str = "doc_id", text: str = "content") -> DataFrame:
    """Postings ``doc_id, term, tf, dl`` (A3). Documents without tokens have no
    postings but still count in ``n_docs`` and the average length."""
    return postings_of(forward_rows(docs, doc_id, text))


def with_idf(dfs: DataFrame, n: int, variant: str) -> DataFrame:
    """``dfs`` with ``idf``. Okapi: ``idf = ln(N - df + 0.5) - ln(df + 0.5)``, a negative idf replaced by
    ``0.25 * mean(idf)`` (mean over all terms, negatives included). ``plus1``:
    ``ln(1 + (N - df + 0.5) / (df + 0.5))``."""
    if variant == "plus1":
        return dfs.withColumn("idf", F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if variant != "okapi":
        raise ValueError(variant)
    raw = dfs.withColumn("raw", F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean_idf = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.withColumn("idf", F.when(F.col("raw") < 0, F.lit(EPSILON * mean_idf)).otherwise(F.col("raw"))).drop("raw")


def index_of(forward: DataFrame, variant: str = "okapi") -> BM25Index:
    """Corpus statistics (A4) of a forward index that is stored or kept."""
    n, total = forward.agg(F.count(F.lit(1)), F.sum("dl")).first()
    dfs = postings_of(forward).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("top_tf"),
                                                   F.min("dl").alias("least_dl")).persist(StorageLevel.MEMORY_AND_DISK)
    return BM25Index(forward, with_idf(dfs, n, variant), n, float(total or 0) / n if n else 0.0, variant)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "content", variant: str = "okapi",
                tokens: str | None = None, carry: tuple = (), stems: bool = False) -> BM25Index:
    """Index of ``docs`` (A3, A4), one pass over them. ``carry``: columns kept in the forward index, so that
    retrieval reads one table; ``stems``: index Snowball stems instead of terms (without ``carry``)."""
    forward = forward_rows(docs, doc_id, text, tokens, carry)
    forward = stem_forward(forward) if stems else forward
    return index_of(forward.persist(StorageLevel.MEMORY_AND_DISK), variant)


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query",
                tokens: str | None = None, stems: bool = False) -> DataFrame:
    """``query_id, term, qn``: repeated query terms count repeatedly (V7); ``stems``: by Snowball stem."""
    tok = F.col(tokens) if tokens else tokenize(text)
    q = (queries.select(F.col(query_id).alias("query_id"), F.explode(tok).alias("term"))
         .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn")))
    return stem_counts(q, ["query_id"], "qn") if stems else q


def top_by(df: DataFrame, k: int, score: str, part: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """Top ``k`` per ``part`` by ``score`` desc, ties by ``tie``; adds ``rank``.

    Scores are compared at 9 decimal places, so sums taken in another order (the
    same document twice, say) still tie and the id decides.
    """
    w = Window.partitionBy(part).orderBy(F.round(F.col(score), RANK_PLACES).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dedup_content(docs: DataFrame, doc_id: str = "doc_id", text: str = "content") -> DataFrame:
    """One document per distinct text, the lowest id.

    A partial ``min`` per text hash, then a semi join: a text repeated in a third
    of all rows is combined map-side, never gathered in one task.
    """
    h = docs.select(F.col(doc_id).alias("_id"), F.sha2(F.col(text), 256).alias("_h"))
    keep = h.groupBy("_h").agg(F.min("_id").alias(doc_id))
    return docs.join(keep.select(doc_id), doc_id, "left_semi")


def tokens_incremental(cache: DataFrame, docs: DataFrame, doc_id: str = "doc_id",
                       text: str = "content") -> DataFrame:
    """Tokens of every document, tokenising only texts not in the cache.

    ``cache``: ``content_sha string, tokens array<string>`` keyed by text hash.
    Returns ``doc_id, content_sha, tokens, from_cache``.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"),
                    F.sha2(F.col(text), 256).alias("content_sha"))
    j = d.join(cache.select("content_sha", F.col("tokens").alias("_known")), "content_sha", "left")
    return j.select("doc_id", "content_sha", F.when(F.col("_known").isNull(), tokenize("_text")).otherwise(F.col("_known"))
                    .alias("tokens"), F.col("_known").isNotNull().alias("from_cache"))


def token_cache(docs: DataFrame, text: str = "content") -> DataFrame:
    """``content_sha, tokens`` for the distinct texts of ``docs``."""
    return (docs.select(F.sha2(F.col(text), 256).alias("content_sha"), F.col(text).alias("_t"))
            .dropDuplicates(["content_sha"]).select("content_sha", tokenize("_t").alias("tokens")))


def refresh_documents(existing: DataFrame, incoming: DataFrame, doc_id: str = "doc_id",
                      ts: str = "timestamp") -> DataFrame:
    """Upsert by id, newest version wins (S6); ties keep the incoming row."""
    e = existing.withColumn("_src", F.lit(0))
    i = incoming.select(*existing.columns).withColumn("_src", F.lit(1))
    u = e.unionByName(i)
    return (u.groupBy(doc_id)
            .agg(F.max_by(F.struct(*[c for c in existing.columns if c != doc_id]),
                          F.struct(F.col(ts), F.col("_src"))).alias("s"))
            .select(doc_id, "s.*"))
