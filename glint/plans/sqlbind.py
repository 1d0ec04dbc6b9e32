"""The bindings of ``glint.plans.bindings`` spelled as DuckDB CTEs (oracle side)."""

BARS_EVT = """bars AS (
  SELECT event_type AS symbol, ts AS "timestamp", value AS close,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume
  FROM events)"""

BARS_USR = """bars AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS "timestamp", value AS close,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume
  FROM events)"""

WATCHLIST = """watchlist AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol FROM events
  WHERE event_type = 'signup' AND value > 50)"""


def memories(scale: float = 100.0) -> str:
    return f"""memories AS (
  SELECT event_id AS memory_id,
         CASE event_type WHEN 'purchase' THEN 'trading_decision'
                         WHEN 'view' THEN 'market_event'
                         WHEN 'click' THEN 'research_insight'
                         WHEN 'signup' THEN 'performance_metric'
                         WHEN 'error' THEN 'market_event' END AS memory_type,
         event_type || ' ' || props AS content,
         ts AS "timestamp",
         least(1.0::DOUBLE, value / {scale}::DOUBLE) AS importance,
         CAST(user_id AS VARCHAR) AS symbol,
         json_extract_string(props, '$.k') AS k,
         props AS context,
         user_id
  FROM events)"""


DOCUMENTS = """docs AS (
  SELECT d.doc_id, d.text AS content, d.lang, d.source, e.ts AS "timestamp",
         v.embedding::DOUBLE[] AS embedding
  FROM documents d
  LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN embeddings v ON v.vec_id = d.doc_id)"""

QUERIES = """queries AS (
  SELECT b.item_id AS query_id, b.text AS query, v.embedding::DOUBLE[] AS embedding
  FROM benchmark b LEFT JOIN embeddings v ON v.vec_id = b.item_id)"""

TOKEN_RE = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {TOKEN_RE}, 0)"


def indicator_select(src: str) -> str:
    """Windows W1-W4 over ``src`` and the derived columns W5-W7."""
    return f"""calc AS (
  SELECT symbol, "timestamp", close, volume,
         avg(close) OVER w20 AS sma_20,
         avg(close) OVER w50 AS sma_50,
         stddev_samp(close) OVER w20 AS stddev_20,
         avg(volume) OVER w20 AS avg_volume_20
  FROM {src}
  WINDOW w20 AS (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
         w50 AS (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)),
ind AS (
  SELECT symbol, "timestamp", close, volume, sma_20, sma_50, stddev_20, avg_volume_20,
         (close - sma_20) / NULLIF(stddev_20, 0) AS z_score,
         volume / NULLIF(avg_volume_20, 0) AS volume_ratio,
         CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'STRONG_UPTREND'
              WHEN close > sma_20 THEN 'UPTREND'
              WHEN close < sma_20 AND sma_20 < sma_50 THEN 'STRONG_DOWNTREND'
              WHEN close < sma_20 THEN 'DOWNTREND'
              ELSE 'NEUTRAL' END AS trend
  FROM calc)"""


IND_COLS = """symbol, "timestamp", round(close, 9) AS close, round(volume, 9) AS volume,
  round(sma_20, 9) AS sma_20, round(sma_50, 9) AS sma_50, round(stddev_20, 9) AS stddev_20,
  round(avg_volume_20, 9) AS avg_volume_20, round(z_score, 9) AS z_score,
  round(volume_ratio, 9) AS volume_ratio, trend"""

CONTEXT_COLS = """CASE trend WHEN 'STRONG_UPTREND' THEN 1.0 WHEN 'UPTREND' THEN 0.5 WHEN 'NEUTRAL' THEN 0.0
       WHEN 'DOWNTREND' THEN -0.5 WHEN 'STRONG_DOWNTREND' THEN -1.0 END::DOUBLE AS trend_strength,
  CASE WHEN abs(z_score) > 2.0 THEN 'HIGH' WHEN abs(z_score) > 1.0 THEN 'MEDIUM' ELSE 'LOW' END
    AS volatility_level,
  CASE WHEN volume_ratio > 2.0 THEN 'VERY_HIGH' WHEN volume_ratio > 1.5 THEN 'HIGH'
       WHEN volume_ratio < 0.5 THEN 'LOW' ELSE 'NORMAL' END AS volume_signal,
  CASE WHEN close > sma_20 * 1.05 THEN 'STRONG_POSITIVE' WHEN close < sma_20 * 0.95 THEN 'STRONG_NEGATIVE'
       WHEN close > sma_20 THEN 'POSITIVE' WHEN close < sma_20 THEN 'NEGATIVE'
       ELSE 'NEUTRAL' END AS price_momentum"""


def stems(terms: str) -> str:
    """CTEs that end in ``stems`` (term, stem): Snowball English over the column ``term`` of ``terms``, step by step."""
    from glint.functions import snowball as P

    vowel = "[aeiouy]"
    short = "regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"

    def cut(n, more=""):
        return f"left(w, length(w) - {n}) || '{more}'" if more else f"left(w, length(w) - {n})"

    def longest(rules, allowed):
        lines = [f"WHEN ends_with(w, '{x}') THEN CASE WHEN {allowed(x)} THEN {cut(len(x), y)} ELSE w END"
                 for x, y in sorted(rules, key=lambda r: -len(r[0]))]
        return "CASE WHEN stop THEN w " + " ".join(lines) + " ELSE w END"

    def region(name):
        return lambda x: f"length(w) - {len(x)} >= {name}"
    r1, r2 = region("r1"), region("r2")
    prefixes = "|".join(P.R1_PREFIXES)
    first_region = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.EXCEPTIONS.items())
    done = ", ".join(f"'{x}'" for x in P.AFTER_1A)
    before = {"ogi": " AND ends_with(w, 'logi')", "li": f" AND regexp_matches(w, '[{P.LI_ENDING}]li$')"}
    step1b = longest([("eedly", "ee"), ("eed", "ee")], r1)
    step2 = longest(P.STEP2, lambda x: r1(x) + before.get(x, ""))
    step3 = longest(P.STEP3, lambda x: r1(x) + (" AND " + r2(x) if x == "ative" else ""))
    step4 = longest([(x, "") for x in P.STEP4],
                    lambda x: r2(x) + (" AND regexp_matches(w, '[st]ion$')" if x == "ion" else ""))
    keep = "term, r1, r2, stop"
    return f"""p0 AS (SELECT term, regexp_replace(regexp_replace(regexp_replace(term, '^''', ''), '^y', 'Y'),
                                   '({vowel})y', '\\1Y', 'g') AS w FROM {terms}),
p1 AS (SELECT *, CASE WHEN regexp_matches(w, '^({prefixes})') THEN length(regexp_extract(w, '^({prefixes})'))
                      WHEN regexp_matches(w, '{first_region}') THEN length(regexp_extract(w, '{first_region}'))
                      ELSE length(w) END AS r1 FROM p0),
p2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{first_region}')
                      THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{first_region}'))
                      ELSE length(w) END AS r2 FROM p1),
p3 AS (SELECT term, r1, r2, regexp_replace(w, '(''s''|''s|'')$', '') AS w FROM p2),
p4 AS (SELECT term, r1, r2, CASE WHEN ends_with(w, 'sses') THEN {cut(2)}
         WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END
         WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
         WHEN regexp_matches(w, '(?s){vowel}.+s$') THEN {cut(1)} ELSE w END AS w FROM p3),
p5 AS (SELECT *, w IN ({done}) AS stop FROM p4),
p6 AS (SELECT *, CASE WHEN stop OR regexp_matches(w, '(eedly|eed)$') THEN NULL
         WHEN regexp_matches(w, '(?s){vowel}.*ingly$') THEN {cut(5)} WHEN regexp_matches(w, '(?s){vowel}.*edly$') THEN {cut(4)}
         WHEN regexp_matches(w, '(?s){vowel}.*ing$') THEN {cut(3)} WHEN regexp_matches(w, '(?s){vowel}.*ed$') THEN {cut(2)}
         END AS rest FROM p5),
p7 AS (SELECT {keep}, CASE WHEN rest IS NULL THEN {step1b}
         WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
         WHEN regexp_matches(rest, '({"|".join(P.DOUBLES)})$') THEN left(rest, length(rest) - 1)
         WHEN length(rest) <= r1 AND {short.format('rest')} THEN rest || 'e' ELSE rest END AS w FROM p6),
p8 AS (SELECT {keep}, CASE WHEN NOT stop AND regexp_matches(w, '(?s).[^aeiouy][yY]$') THEN {cut(1, 'i')} ELSE w END AS w
       FROM p7),
p9 AS (SELECT {keep}, {step2} AS w FROM p8),
p10 AS (SELECT {keep}, {step3} AS w FROM p9),
p11 AS (SELECT {keep}, {step4} AS w FROM p10),
p12 AS (SELECT term, CASE WHEN stop THEN w
         WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {short.format(cut(1))})) THEN {cut(1)}
         WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN {cut(1)} ELSE w END AS w FROM p11),
stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term
         ELSE CASE term {known} ELSE replace(w, 'Y', 'y') END END AS stem FROM p12)"""
