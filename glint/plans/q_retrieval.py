"""Text index and retrieval queries (V1, V9, A3, A4, A7, J4, J5, S6, V7, hybrid, rerank, F7, F8, V18, contextual)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glint.functions.text import enhance_query, tokenize, truncate_tokens
from glint.operators import retrieval as R
from glint.operators import text_index as T
from glint.operators.bm25 import bm25_join
from glint.operators.scoring import bm25_topk
from glint.plans import bindings as B
from glint.plans import sqlbind as S
from glint.plans.catalog import register, round_doubles
from glint.plans.standins import letter_counts
from glint.session import shared_dir, spread
from glint.sources.index_store import build_snapshot, load_index

TOK_DOCS = f"toks AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents)"

BM25_CORE = f"""{TOK_DOCS},
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
       FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2),
c AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(c.n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, c),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER () ELSE r END AS idf FROM raw)"""


def bm25_sql(qsrc: str) -> str:
    """``bm`` CTE: Okapi scores of the query terms in ``qsrc`` (query_id, term, qn)."""
    return f"""bm AS (SELECT qt.query_id, tf.doc_id,
    sum(qt.qn * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / c.avgdl))) AS bm25
  FROM {qsrc} qt JOIN idf USING (term) JOIN tf USING (term), c GROUP BY 1, 2)"""


QT_PLAIN = f"""qt AS (SELECT query_id, term, count(*) AS qn
  FROM (SELECT item_id AS query_id, unnest({S.tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2)"""


_SNAPSHOTS: dict = {}


def _index(spark, sf, variant="okapi"):
    """The corpus index, built once per session and input, stored as a snapshot in
    the shared folder (S7) and loaded from there (S8) by every retrieval query."""
    key = (id(spark), sf, variant)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = build_snapshot(B.documents(spark, sf), shared_dir(spark, "bm25"), variant,
                                         dt.datetime.fromisoformat(B.NOW), variant,
                                         carry=("content", "metadata", "timestamp", "embedding"))
    return load_index(spark, _SNAPSHOTS[key])


@register("term_freq", f"""WITH {TOK_DOCS}
SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY 1, 2""")
def term_freq(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return T.term_freq(d).select("doc_id", "term", "tf")


@register("corpus_stats", f"""WITH {BM25_CORE}
SELECT term, df::BIGINT AS df, round(idf, 9) AS idf FROM idf""")
def corpus_stats(spark, sf):
    return round_doubles(_index(spark, sf).terms.select("term", "df", "idf"))


@register("bm25_okapi", f"""WITH {BM25_CORE}, {QT_PLAIN}, {bm25_sql('qt')}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id)::INTEGER AS rank,
       doc_id, round(bm25, 9) AS bm25
FROM bm QUALIFY rank <= 10""")
def bm25_okapi(spark, sf):
    """Top 10 documents per benchmark query by Okapi BM25."""
    idx = _index(spark, sf)
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return round_doubles(bm25_topk(idx, q, 10))


@register("bm25_bounded", f"""WITH {BM25_CORE}, {QT_PLAIN}, {bm25_sql('qt')}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id)::INTEGER AS rank,
       doc_id, round(bm25, 9) AS bm25
FROM bm QUALIFY rank <= 10""")
def bm25_bounded(spark, sf):
    """The same by joins on the query vocabulary with score bounds."""
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return round_doubles(bm25_join(_index(spark, sf), q, 10))


@register("truncate_tokens", f"""WITH {TOK_DOCS}
SELECT doc_id, len(t)::INTEGER AS n_tokens, len(t[1:512])::INTEGER AS n_kept,
       CASE WHEN len(t) = 0 THEN NULL ELSE t[least(len(t), 512)] END AS last_kept FROM toks""")
def truncate_tokens_q(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", tokenize("text").alias("t"))
    kept = truncate_tokens("t", 512)
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(kept).alias("n_kept"),
                    F.element_at(kept, -1).alias("last_kept"))


@register("dedup_content", """SELECT doc_id, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))""")
def dedup_content(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "n_chars", F.col("text").alias("content"))
    return T.dedup_content(d).select("doc_id", "n_chars")


@register("tokens_incremental", f"""WITH cache AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'en')
SELECT doc_id, sha256(text) AS content_sha, len({S.tokens('text')})::INTEGER AS n_tokens,
       sha256(text) IN (SELECT h FROM cache) AS from_cache
FROM documents""")
def tokens_incremental(spark, sf):
    """Tokens for all documents, only texts not cached (the English ones) are tokenised."""
    d = B.table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    cache = T.token_cache(d.filter(F.col("lang") == "en"))
    out = T.tokens_incremental(cache, d)
    return out.select("doc_id", "content_sha", F.size("tokens").alias("n_tokens"), "from_cache")


@register("refresh_documents", """WITH existing AS (
  SELECT d.doc_id, d.text AS content, e.ts AS "timestamp" FROM documents d JOIN events e ON e.event_id = d.doc_id),
incoming AS (
  SELECT d.doc_id, d.text || ' (rev)' AS content, e.ts AS "timestamp"
  FROM documents d JOIN events e ON e.event_id = d.doc_id + 300 WHERE d.source IN ('src1', 'src2')),
u AS (SELECT *, 0 AS src FROM existing UNION ALL SELECT *, 1 AS src FROM incoming)
SELECT doc_id, "timestamp", sha256(content) AS content_sha FROM u
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "timestamp" DESC, src DESC) = 1""")
def refresh_documents(spark, sf):
    """Upsert republished documents (sources src1, src2, later versions) by id; newest wins."""
    d = B.table(spark, sf, "documents")
    ev = B.table(spark, sf, "events").select("event_id", "ts")
    existing = d.join(ev, d.doc_id == ev.event_id).select("doc_id", F.col("text").alias("content"),
                                                         F.col("ts").alias("timestamp"))
    incoming = (d.filter(F.col("source").isin("src1", "src2"))
                .join(ev, ev.event_id == d.doc_id + 300)
                .select("doc_id", F.concat("text", F.lit(" (rev)")).alias("content"), F.col("ts").alias("timestamp")))
    out = T.refresh_documents(existing, incoming)
    return out.select("doc_id", "timestamp", F.sha2("content", 256).alias("content_sha"))


HYBRID_TAIL = """,
pairs AS (SELECT q.query_id, d.doc_id, coalesce(bm.bm25, 0.0) AS bm25,
                 CASE WHEN d.embedding IS NULL OR q.embedding IS NULL THEN 0.0 ELSE
                 list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda t: t[1]*t[2])) END AS semantic
          FROM queries q CROSS JOIN docs d LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = d.doc_id
          {where}),
mx AS (SELECT query_id, max(bm25) AS mb, max(semantic) AS ms FROM pairs GROUP BY 1),
comb AS (SELECT p.*, 0.4::DOUBLE * CASE WHEN mb > 0 THEN bm25 / mb ELSE 0.0 END
                   + 0.6::DOUBLE * CASE WHEN ms > 0 THEN semantic / ms ELSE 0.0 END AS relevance_score
         FROM pairs p JOIN mx USING (query_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance_score, 9) DESC, doc_id)::INTEGER AS rank
        FROM comb QUALIFY rank <= 5),
hits AS (SELECT * FROM top WHERE relevance_score >= 0.5)"""

HYBRID_COLS = """query_id, rank, doc_id, round(relevance_score, 9) AS relevance_score,
       round(bm25, 9) AS bm25, round(semantic, 9) AS semantic"""

HYBRID_SQL = f"""WITH {S.DOCUMENTS}, {S.QUERIES}, {BM25_CORE}, {QT_PLAIN}, {bm25_sql('qt')}
{HYBRID_TAIL.format(where='')}
SELECT {HYBRID_COLS} FROM hits"""


def _hybrid(spark, sf, k=5, min_relevance=0.5):
    idx = _index(spark, sf)
    return R.hybrid_scores(idx, None, B.queries(spark, sf), k=k, min_relevance=min_relevance)


@register("hybrid_retrieve", HYBRID_SQL)
def hybrid_retrieve(spark, sf):
    """BM25 + dot product, normalised per query, 0.4 / 0.6, top 5, kept at >= 0.5."""
    return round_doubles(_hybrid(spark, sf))


RERANK_SQL = f"""WITH {S.DOCUMENTS}, {S.QUERIES}, {BM25_CORE}, {QT_PLAIN}, {bm25_sql('qt')}
{HYBRID_TAIL.format(where='')},
rr AS (SELECT h.*, CASE WHEN d.embedding IS NULL OR q.embedding IS NULL THEN 0.0
                  ELSE coalesce(list_cosine_similarity(q.embedding, d.embedding), 0.0) END AS reranking_score
       FROM hits h JOIN docs d USING (doc_id) JOIN queries q USING (query_id))
SELECT {HYBRID_COLS}, round(reranking_score, 9) AS reranking_score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(reranking_score, 9) DESC, rank)::INTEGER AS rerank_rank
FROM rr"""


def _reranked(spark, sf):
    hits = _hybrid(spark, sf)
    d = _index(spark, sf).forward.select("doc_id", "embedding")      # the snapshot holds the documents' columns
    return R.rerank(hits, d, B.queries(spark, sf).select("query_id", "embedding"))


@register("hybrid_rerank", RERANK_SQL)
def hybrid_rerank(spark, sf):
    """Kept rows re-scored by cosine of the (pluggable) encoder vectors and re-sorted."""
    return round_doubles(_reranked(spark, sf))


@register("high_relevance", f"""{RERANK_SQL.replace('FROM rr', 'FROM rr WHERE relevance_score >= 0.7 OR reranking_score >= 0.7')}""")
def high_relevance(spark, sf):
    """relevance or rerank score >= 0.7."""
    return round_doubles(R.high_relevance(_reranked(spark, sf)))


def letters_sql(text: str) -> str:
    """The same vector of the first 512 tokens of ``text``."""
    cut = f"array_to_string(({S.tokens(text)})[1:512], ' ')"
    return f"list_transform(range(26), lambda i: (length({cut}) - length(replace({cut}, chr((97 + i)::INTEGER), '')))::DOUBLE)"


def encoder_sql(hits: str) -> str:
    """CTE ``rr``: the rows of ``hits`` (query_id, doc_id, rank) with ``reranking_score`` by ``letter_counts``."""
    return f"""qv AS (SELECT query_id, {letters_sql('query')} AS qe FROM queries
        WHERE query_id IN (SELECT query_id FROM {hits})),
dv AS (SELECT doc_id, {letters_sql('content')} AS de FROM docs WHERE doc_id IN (SELECT doc_id FROM {hits})),
rr AS (SELECT h.*, CASE WHEN list_sum(qe) > 0 AND list_sum(de) > 0
                        THEN list_cosine_similarity(qe, de) ELSE 0.0 END AS reranking_score
       FROM {hits} h JOIN dv USING (doc_id) JOIN qv USING (query_id))"""


@register("rerank_encoder", f"""WITH {S.DOCUMENTS}, {S.QUERIES}, {BM25_CORE}, {QT_PLAIN}, {bm25_sql('qt')}
{HYBRID_TAIL.format(where='')}, {encoder_sql('hits')}
SELECT {HYBRID_COLS}, round(reranking_score, 9) AS reranking_score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(reranking_score, 9) DESC, rank)::INTEGER AS rerank_rank
FROM rr""")
def rerank_encoder(spark, sf):
    """T3 + V9: the hits of hybrid retrieval, cut to 512 tokens, re-ranked by a plugged second encoder; vectors are
    kept by content hash."""
    hits = _hybrid(spark, sf)
    docs = _index(spark, sf).forward.select("doc_id", "content")
    return round_doubles(R.rerank_by_encoder(hits, docs, B.queries(spark, sf).select("query_id", "query"), letter_counts, 26,
                                             shared_dir(spark, "encoder-vectors")))


WINDOW = ("2024-01-01 12:00:00", "2024-01-02 12:00:00")
ENH_SQL = f"""'Context: Market Context: - Current Time: ' || strftime(TIMESTAMP '{B.NOW}', '%Y-%m-%d %H:%M:%S')
  || ' - Trading Session: ' || CASE WHEN hour(TIMESTAMP '{B.NOW}') BETWEEN 9 AND 16
                                   THEN 'Normal Trading Hours' ELSE 'Extended Hours' END
  || chr(10) || 'Symbol: ' || coalesce(CAST(NULL AS VARCHAR), 'N/A') || chr(10) || 'Query: ' || {{q}}
  || chr(10) || 'Time period: ' || '{WINDOW[0]}' || ' to ' || '{WINDOW[1]}'"""


def _enhanced_queries(spark, sf):
    q = B.queries(spark, sf)
    return q.withColumn("query", enhance_query(F.col("query"), F.lit(None).cast("string"),
                                               F.lit(B.NOW).cast("timestamp_ntz"),
                                               F.lit(WINDOW[0]).cast("timestamp_ntz"),
                                               F.lit(WINDOW[1]).cast("timestamp_ntz")))


@register("enhance_query", f"""SELECT item_id AS query_id, {ENH_SQL.format(q='text')} AS enhanced_query FROM benchmark""")
def enhance_query_q(spark, sf):
    """Enriched query text (context at a given time, symbol or N/A, query, period)."""
    return _enhanced_queries(spark, sf).select("query_id", F.col("query").alias("enhanced_query"))


@register("time_window_retrieve", f"""WITH {S.DOCUMENTS}, {S.QUERIES.replace('b.text AS query', ENH_SQL.format(q='b.text') + ' AS query')},
{BM25_CORE},
qt AS (SELECT query_id, term, count(*) AS qn
       FROM (SELECT query_id, unnest({S.tokens('query')}) AS term FROM queries) GROUP BY 1, 2),
{bm25_sql('qt')}
{HYBRID_TAIL.format(where=f"WHERE d.timestamp BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'")}
SELECT {HYBRID_COLS} FROM hits""")
def time_window_retrieve(spark, sf):
    """F8: documents of a time window only, query text enriched with the period."""
    idx = _index(spark, sf)
    return round_doubles(R.hybrid_scores(idx, None, _enhanced_queries(spark, sf), k=5, min_relevance=0.5,
                                         start=WINDOW[0], end=WINDOW[1]))


@register("index_roundtrip", f"""WITH {BM25_CORE}, {QT_PLAIN}, {bm25_sql('qt')}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id)::INTEGER AS rank,
       doc_id, round(bm25, 9) AS bm25
FROM bm QUALIFY rank <= 10""")
def index_roundtrip(spark, sf):
    """Build, save two snapshots, load the newest by modified time, score; the
    scores equal those of the index before saving."""
    from glint.sources.index_store import load_latest
    docs = B.table(spark, sf, "documents")
    docs = spread(docs)
    d = docs.select("doc_id", F.col("text").alias("content"))
    base = shared_dir(spark, "snapshots")
    english = docs.filter(F.col("lang") == "en").select("doc_id", F.col("text").alias("content"))    # an older index
    build_snapshot(english, base, "old", dt.datetime(2024, 1, 1))
    build_snapshot(d, base, "new", dt.datetime(2024, 1, 2))
    idx = load_latest(spark, base)
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return round_doubles(bm25_topk(idx, q, 10))


def _contextual(spark, sf, stem):
    from glint.functions.stem import remove_stop_words

    docs = B.documents(spark, sf)
    idx = T.build_index(docs.withColumn("tokens", remove_stop_words(tokenize("content"))), variant="plus1",
                        tokens="tokens", stems=stem)
    q = B.queries(spark, sf)
    q = q.withColumn("tokens", remove_stop_words(tokenize("query")))
    return round_doubles(R.contextual_retrieve(idx, docs, q, k=3, stems=stem))


_SW = ", ".join("'" + w.replace("'", "''") + "'" for w in __import__("glint.functions.stem", fromlist=["x"]).STOP_WORDS)


def contextual_sql(stems: str) -> str:
    """Both retrievers and their fusion; ``stems`` is SQL for a table ``stems`` (term, stem)."""
    return f"""WITH {S.DOCUMENTS}, {S.QUERIES},
toks AS (SELECT doc_id, list_filter({S.tokens('content')}, lambda x: x NOT IN ({_SW})) AS t FROM docs),
plain AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
       FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2),
asked AS (SELECT query_id, term, count(*) AS qn FROM (
         SELECT query_id, unnest(list_filter({S.tokens('query')}, lambda x: x NOT IN ({_SW}))) AS term FROM queries)
       GROUP BY 1, 2),
{stems}
tf AS (SELECT doc_id, stem AS term, sum(tf) AS tf, any_value(dl) AS dl FROM plain JOIN stems USING (term) GROUP BY 1, 2),
c AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks),
idf AS (SELECT term, ln(1 + (c.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, c GROUP BY term, c.n),
qt AS (SELECT query_id, stem AS term, sum(qn) AS qn FROM asked JOIN stems USING (term) GROUP BY 1, 2),
bm AS (SELECT qt.query_id, tf.doc_id AS node_id,
              sum(qt.qn * idf.idf * tf.tf / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / c.avgdl))) AS score
       FROM qt JOIN idf USING (term) JOIN tf USING (term), c GROUP BY 1, 2),
bt AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) <= 3),
vs AS (SELECT q.query_id, d.doc_id AS node_id,
              CASE WHEN d.embedding IS NULL OR q.embedding IS NULL THEN 0.0
                   ELSE coalesce(list_cosine_similarity(q.embedding, d.embedding), 0.0) END AS score
       FROM queries q CROSS JOIN docs d),
vt AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) <= 3),
f AS (SELECT coalesce(vt.query_id, bt.query_id) AS query_id, coalesce(vt.node_id, bt.node_id) AS node_id,
             vt.score AS vector_score, bt.score AS bm25_score,
             CASE WHEN vt.score IS NOT NULL AND bt.score IS NOT NULL THEN 0.7::DOUBLE * vt.score + 0.3::DOUBLE * bt.score
                  ELSE coalesce(vt.score, bt.score) END AS score
      FROM vt FULL OUTER JOIN bt ON vt.query_id = bt.query_id AND vt.node_id = bt.node_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id)::INTEGER AS rank,
       node_id, round(score, 9) AS score, round(vector_score, 9) AS vector_score, round(bm25_score, 9) AS bm25_score
FROM f QUALIFY rank <= 3"""


TERMS_SQL = "all_terms AS (SELECT DISTINCT term FROM plain UNION SELECT DISTINCT term FROM asked),"


@register("contextual_retrieve", contextual_sql(f"{TERMS_SQL}\nstems AS (SELECT term, term AS stem FROM all_terms),"))
def contextual_retrieve(spark, sf):
    """J1/A6/T5 + V8: cosine top 3 and BM25 (ln(1 + ...) idf, stop words removed) top 3,
    fused 0.7 / 0.3, top 3, without stemming."""
    return _contextual(spark, sf, stem=False)


@register("bm25_stemmed", contextual_sql(f"{TERMS_SQL}\n{S.stems('all_terms')},"))
def bm25_stemmed(spark, sf):
    """V2 + V8: the same retrieval by Snowball English stems, each distinct term stemmed once and joined back."""
    return _contextual(spark, sf, stem=True)


@register("time_window_per_query", f"""WITH {S.DOCUMENTS}, {S.QUERIES},
win AS (SELECT b.item_id AS query_id, date_trunc('day', e.ts) AS w_start,
               date_trunc('day', e.ts) + INTERVAL 1 DAY AS w_end
        FROM benchmark b JOIN events e ON e.event_id = b.item_id),
{BM25_CORE}, {QT_PLAIN}, {bm25_sql('qt')}
{HYBRID_TAIL.format(where="JOIN win ON win.query_id = q.query_id WHERE d.timestamp BETWEEN win.w_start AND win.w_end")}
SELECT {HYBRID_COLS} FROM hits""")
def time_window_per_query(spark, sf):
    """F8 with a window per query: the day of the query's own event (start of day to the
    next midnight, both included); maxima and top 5 within each window."""
    ev = B.table(spark, sf, "events").select(F.col("event_id").alias("query_id"), "ts")
    q = (B.queries(spark, sf).join(ev, "query_id", "left")
         .withColumn("start", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))
         .withColumn("end", (F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz"))
         .drop("ts"))
    return round_doubles(R.hybrid_scores(_index(spark, sf), None, q, k=5, min_relevance=0.5))


@register("index_refresh", f"""WITH final AS (
  SELECT doc_id, text || CASE WHEN source IN ('src1', 'src2') THEN ' (rev)' ELSE '' END AS text FROM documents
  WHERE lang <> 'fr'),
{BM25_CORE.replace(TOK_DOCS, TOK_DOCS.replace('FROM documents', 'FROM final'))}
SELECT term, df::BIGINT AS df, round(idf, 9) AS idf, c.n::BIGINT AS n_docs, round(c.avgdl, 9) AS avgdl FROM idf, c""")
def index_refresh(spark, sf):
    """An index table built without the German documents, then refreshed twice by deltas: the German ones
    and a revision of two sources come in, the French ones go. Its statistics are those of a new index."""
    from glint.sources import index_table as IT

    docs = B.table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("text").alias("content"))
    base = shared_dir(spark, "index-table")
    IT.create(docs.filter(F.col("lang") != "de"), base)
    IT.refresh(spark, base, docs.filter(F.col("lang") == "de"))
    revised = docs.filter(F.col("source").isin("src1", "src2") & (F.col("lang") != "fr")).withColumn(
        "content", F.concat("content", F.lit(" (rev)")))
    IT.refresh(spark, base, revised, removed=docs.filter(F.col("lang") == "fr"))
    idx = IT.load(spark, base)
    return round_doubles(idx.terms.select("term", "df", "idf", F.lit(idx.n_docs).cast("long").alias("n_docs"),
                                          F.lit(idx.avgdl).alias("avgdl")))


_CELLS: dict = {}


@register("vector_cells", f"""WITH {S.QUERIES},
s AS (SELECT q.query_id, e.vec_id AS item_id,
             list_sum(list_transform(list_zip(q.embedding, e.embedding::DOUBLE[]),
                                     lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS score
      FROM queries q CROSS JOIN embeddings e WHERE q.embedding IS NOT NULL AND e.label >= 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), item_id)::INTEGER AS rank,
       item_id, round(score, 9) AS score
FROM s QUALIFY rank <= 10""")
def vector_cells(spark, sf):
    """Exact nearest vectors with a condition on a stored column, from cells around pivots; only the cells
    that can hold a result are read."""
    from glint.operators import vectors as V

    key = (id(spark), sf)
    if key not in _CELLS:
        _CELLS[key] = V.build_cells(B.table(spark, sf, "embeddings"), shared_dir(spark, "cells"), "l2sq",
                                    item_id="vec_id", carry=("label",))
    q = B.queries(spark, sf).filter(F.col("embedding").isNotNull())
    return round_doubles(V.search_cells(spark, _CELLS[key], q, 10, "l2sq", F.col("label") >= 2).drop("best"))
