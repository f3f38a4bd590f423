"""Named queries for text and retrieval (step 9) on documents, benchmark, embeddings, conversations, customer."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.catalog.base import register, with_bookings
from driftwise.functions.scalar import map_lookup, rnd
from driftwise.operators import retrieval as rt
from driftwise.operators import text as tx
from driftwise.plans.ordering import global_prefix_sum, grouped_rank
from driftwise.sources.tables import bookings, table

TOP_K = 3
EMB_K = 5
EMB_MIN_SIM = 0.05
# Query parameter: chunk priority for the documents proxy, by language (lower = preferred).
LANG_PRIORITY = {"en": 1, "de": 2, "fr": 3, "es": 4}
HIT_VALUE = 5.0  # retrieval-log proxy: an event "hits" when its value reaches this
TRIM_MAX = 4

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_NORM = (
    "regexp_replace(" + _STRIP.format(x=r"regexp_replace(text, '\r\n?', chr(10), 'g')") + r", '\n{3,}', chr(10) || chr(10), 'g')"
)
_CHUNK_CTES = f"""
nt AS (SELECT doc_id, {_NORM} AS t FROM documents),
st AS (SELECT doc_id, t, CASE WHEN length(t) = 0 THEN CAST([] AS BIGINT[])
         ELSE range(0, (CASE WHEN length(t) <= 900 THEN 0 ELSE CAST(ceil((length(t) - 900) / 800.0) AS BIGINT) END) * 800 + 1, 800)
       END AS starts FROM nt),
ar AS (SELECT doc_id, list_filter(list_transform(starts, lambda s: {{'start': s, 'chunk': {_STRIP.format(x='substring(t, s + 1, 900)')}}}),
                                  lambda w: length(w.chunk) > 0) AS arr FROM st),
ch AS (SELECT doc_id, len(arr) AS n_chunks, unnest(arr) AS c, unnest(range(1, len(arr) + 1)) AS chunk_index FROM ar)"""


@register(
    "chunk_text",
    f"""WITH {_CHUNK_CTES.strip()}
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(n_chunks AS INTEGER) AS n_chunks, CAST(c.start AS INTEGER) AS start,
       CAST(length(c.chunk) AS INTEGER) AS chunk_len, md5(c.chunk) AS chunk_md5
FROM ch""",
)
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document normalised and cut into 900-char windows with 100-char overlap (whole texts)."""
    docs = table(spark, sf_dir, "documents")
    ch = tx.chunk_text(docs, "text", keep=["doc_id"])
    return ch.select(
        "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("n_chunks").cast("int").alias("n_chunks"),
        F.col("start").cast("int").alias("start"), F.length("chunk").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"),
    )


INGEST_CTES = r"""base AS (SELECT doc_id, lang, source || '-' || CAST(doc_id AS VARCHAR) AS source_name,
                     regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents),
nt AS (SELECT doc_id, lang, source_name, length(s) AS n,
              regexp_replace(regexp_replace(s, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM base),
st AS (SELECT *, CASE WHEN length(t) = 0 THEN CAST([] AS BIGINT[])
         ELSE range(0, (CASE WHEN length(t) <= 900 THEN 0 ELSE CAST(ceil((length(t) - 900) / 800.0) AS BIGINT) END) * 800 + 1, 800)
       END AS starts FROM nt),
ar AS (SELECT *, list_filter(list_transform(starts, lambda s: regexp_replace(substring(t, s + 1, 900), '^\s+|\s+$', '', 'g')),
                             lambda c: length(c) > 0) AS arr FROM st),
g AS (SELECT *, CASE WHEN n < 20 THEN 'too_short' WHEN len(arr) = 0 THEN 'no_chunks' END AS reason FROM ar),
ok AS (SELECT doc_id, lang, source_name, len(arr) AS n_chunks, unnest(arr) AS content, unnest(range(1, len(arr) + 1)) AS idx
       FROM g WHERE reason IS NULL),
slugged AS (SELECT *, coalesce(nullif(substring(regexp_replace(regexp_replace(lower(source_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24), ''), 'kb') AS slug FROM ok),
chunks AS (SELECT doc_id, lang AS category, content, CAST(idx AS INTEGER) AS chunk_index,
                  slug || '-' || lpad(CAST(idx AS VARCHAR), 3, '0') || '-' || substring(sha1(source_name || ':' || CAST(idx AS VARCHAR)), 1, 8) AS chunk_id,
                  source_name || ' [' || CAST(idx AS VARCHAR) || '/' || CAST(n_chunks AS VARCHAR) || ']' AS title FROM slugged)"""


@register(
    "ingest_chunks",
    f"""WITH {INGEST_CTES}
SELECT doc_id, chunk_id, title, chunk_index, CAST(NULL AS VARCHAR) AS reason FROM chunks
UNION ALL SELECT doc_id, NULL, NULL, 0, reason FROM g WHERE reason IS NOT NULL""",
)
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least length (20 chars), chunking, ids slug-NNN-sha1 salt, titles
    'name [i/n]'; accepted chunk rows and rejected documents with their reason."""
    docs = table(spark, sf_dir, "documents")
    ok, rejects = tx.ingest_chunks(docs, "doc_id", "source", "text")
    a = ok.select("doc_id", "chunk_id", "title", F.col("chunk_index").cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("reason"))
    r = rejects.select(
        "doc_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("title"),
        F.lit(0).cast("int").alias("chunk_index"), "reason",
    )
    return a.unionByName(r)


_TOK = r"regexp_extract_all(lower(text), '[\pL\pN_]{2,}')"


def _terms_sql(src: str, key: str) -> str:
    return f"""
{src}_tk AS (SELECT {key}, {_TOK} AS toks FROM {src}),
{src}_tm AS (SELECT {key}, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS term FROM {src}_tk),
{src}_tf AS (SELECT {key}, term, count(*) AS tf FROM {src}_tm GROUP BY ALL)"""


_TFIDF_CTES = (
    _terms_sql("documents", "doc_id")
    + ","
    + _terms_sql("benchmark", "item_id")
    + """,
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM documents_tf GROUP BY term),
dw0 AS (SELECT doc_id, term, (1.0 + ln(tf)) * idf AS w FROM documents_tf JOIN idf USING (term)),
dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0),
qw0 AS (SELECT item_id, term, (1.0 + ln(tf)) * idf AS w FROM benchmark_tf JOIN idf USING (term)),
qw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qw0),
sc AS (SELECT item_id, doc_id, sum(q.w * d.w) AS sim FROM qw q JOIN dw d USING (term) GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 12) DESC, doc_id) AS rank FROM sc WHERE sim > 0)"""
)


def _lang_priority_sql(col: str = "lang") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_PRIORITY.items())
    return f"CASE {col} {cases} ELSE 5 END"


@register(
    "tfidf_topk",
    f"""WITH {_TFIDF_CTES.strip()},
hits AS (SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM tp WHERE rank <= {TOP_K}),
fb AS (SELECT doc_id, row_number() OVER (ORDER BY {_lang_priority_sql()}, doc_id) AS rank FROM documents
       ORDER BY {_lang_priority_sql()}, doc_id LIMIT {TOP_K})
SELECT * FROM hits
UNION ALL SELECT b.item_id, fb.doc_id, CAST(fb.rank AS INTEGER), NULL FROM benchmark b CROSS JOIN fb
WHERE b.item_id NOT IN (SELECT item_id FROM hits)""",
)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF (word 1–2-grams, sublinear tf, smoothed idf, L2) over whole documents; each benchmark
    text retrieves its top-3 documents by cosine (> 0); queries without a hit fall back to priority order."""
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark")
    hits = rt.tfidf_topk(docs, "doc_id", queries, "item_id", "text", TOP_K).select(
        "item_id", "doc_id", F.col("rank").cast("int").alias("rank"), rnd(F.col("similarity")).alias("similarity")
    ).persist(StorageLevel.MEMORY_AND_DISK)  # k rows a query; the fallback reads them too
    prio = docs.select("doc_id", map_lookup(LANG_PRIORITY, F.col("lang")).alias("_p")).select(
        "doc_id", F.coalesce("_p", F.lit(5)).alias("priority")
    )
    fb = rt.priority_fallback(queries, "item_id", hits, prio, "doc_id", "priority", TOP_K).select(
        "item_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.lit(None).cast("double").alias("similarity")
    )
    return hits.unionByName(fb)


@register(
    "tag_overlap",
    f"""WITH qt AS (SELECT DISTINCT item_id, tag FROM (SELECT item_id, unnest({_TOK}) AS tag FROM benchmark)),
dt AS (SELECT DISTINCT doc_id, tag, priority FROM (SELECT doc_id, unnest({_TOK}) AS tag, {_lang_priority_sql()} AS priority FROM documents)),
ov AS (SELECT item_id, doc_id, priority, count(*) AS overlap FROM dt JOIN qt USING (tag) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, overlap, CAST(overlap * (6 - greatest(1, least(5, priority))) AS DOUBLE) AS score FROM ov WHERE overlap > 0),
tp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, overlap, score FROM tp WHERE rank <= {TOP_K}""",
)
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5/F16: tag-overlap retrieval — query tags = distinct tokens of each benchmark text, chunk tags = distinct
    tokens of each document, score = overlap × (6 − clamp(priority)), top-3."""
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark")
    qt = queries.select("item_id", F.explode_outer(rt.tokens(F.col("text"))).alias("tag")).where(F.col("tag").isNotNull())
    dt = rt.dealt_by_key(docs.select("doc_id", "lang", "text"), "doc_id", "text").select(
        "doc_id", F.explode_outer(rt.tokens(F.col("text"))).alias("tag"),
        F.coalesce(map_lookup(LANG_PRIORITY, F.col("lang")), F.lit(5)).alias("priority"),
    ).where(F.col("tag").isNotNull())
    out = rt.tag_overlap_topk(qt, "item_id", dt, "doc_id", "priority", TOP_K)
    return out.select("item_id", "doc_id", F.col("rank").cast("int").alias("rank"), "overlap", "score")


def _centroid_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    emb = table(spark, sf_dir, "embeddings")
    return emb, rt.centroids(emb, "label", "embedding").select(F.col("label").alias("query_id"), F.col("centroid").alias("q"))


def _emb_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    emb, queries = _centroid_queries(spark, sf_dir)
    res = rt.embedding_topk(emb, "vec_id", "embedding", queries, EMB_K, EMB_MIN_SIM)
    return emb, res, queries


_EMB_CTES = f"""
d0 AS (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
cen AS (SELECT label, list(avg_v ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS avg_v FROM d0 GROUP BY ALL) GROUP BY label),
sims AS (SELECT cen.label AS query_id, e.vec_id, e.label AS vec_label,
           list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: cen.c[i] * CAST(e.embedding[i] AS DOUBLE)))
           / (sqrt(list_sum(list_transform(cen.c, lambda x: x * x)))
              * sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-10) AS similarity
         FROM embeddings e CROSS JOIN cen),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vec_id) AS rank FROM sims WHERE similarity > {EMB_MIN_SIM}),
res AS (SELECT * FROM tp WHERE rank <= {EMB_K})"""


@register(
    "embedding_topk",
    f"""WITH {_EMB_CTES.strip()}
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM res""",
)
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-5 (similarity > 0.05) of every stored embedding for each label-centroid query."""
    _, res, _ = _emb_results(spark, sf_dir)
    return res.select(
        F.col("query_id").cast("int").alias("query_id"), "vec_id", F.col("rank").cast("int").alias("rank"),
        rnd(F.col("similarity")).alias("similarity"),
    )


@register(
    "retrieval_quality",
    f"""WITH {_EMB_CTES.strip()},
q AS (SELECT DISTINCT label AS query_id FROM embeddings),
a AS (SELECT query_id, count(*) AS n, max(similarity) AS top, avg(similarity) AS mean FROM res GROUP BY query_id)
SELECT CAST(q.query_id AS INTEGER) AS query_id, coalesce(a.n, 0) AS result_count, round(coalesce(a.top, 0.0), 6) AS top_similarity,
       round(coalesce(a.mean, 0.0), 6) AS mean_similarity,
       CASE WHEN a.top IS NULL THEN 'no_similarity' WHEN a.top < 0.55 THEN 'low' WHEN a.top >= 0.80 THEN 'high' ELSE 'medium' END AS quality_bucket,
       coalesce(a.n, 0) > 0 AS hit
FROM q LEFT JOIN a USING (query_id)""",
)
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per centroid query — result count, top / mean similarity, quality bucket (0.55 / 0.80), hit flag."""
    emb, res, _ = _emb_results(spark, sf_dir)
    qs = emb.select(F.col("label").alias("query_id")).distinct()
    out = rt.retrieval_quality(res, qs, "query_id")
    return out.select(
        F.col("query_id").cast("int").alias("query_id"), "result_count", rnd(F.col("top_similarity")).alias("top_similarity"),
        rnd(F.col("mean_similarity")).alias("mean_similarity"), "quality_bucket", "hit",
    )


@register(
    "retrieval_eval",
    f"""WITH {_EMB_CTES.strip()},
fh AS (SELECT q.query_id, min(CASE WHEN vec_label = q.query_id THEN rank END) AS first_hit
       FROM (SELECT DISTINCT label AS query_id FROM embeddings) q LEFT JOIN res ON res.query_id = q.query_id GROUP BY q.query_id)
SELECT count(*) AS sample_count, round(avg(CASE WHEN first_hit IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k,
       round(avg(coalesce(1.0 / first_hit, 0.0)), 6) AS mrr_at_k
FROM fh""",
)
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit-rate@5 and MRR@5 of the centroid queries; relevant = same label as the query."""
    emb, res, _ = _emb_results(spark, sf_dir)
    labelled = res.join(emb.select("vec_id", F.col("label").alias("vec_label")), "vec_id")
    out = rt.retrieval_eval(labelled, "query_id", F.col("vec_label") == F.col("query_id"), EMB_K, emb.select(F.col("label").alias("query_id")))
    return out.select("sample_count", rnd(F.col("hit_rate_at_k")).alias("hit_rate_at_k"), rnd(F.col("mrr_at_k")).alias("mrr_at_k"))


def _intent_sql() -> str:
    scores = []
    for kws, _ in tx.INTENT_RULES:
        parts = " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN 1 ELSE 0 END" for k in kws)
        scores.append(f"CAST(({parts}) AS DOUBLE) / {float(len(kws))}")
    best = "0.0"
    intent = f"'{tx.DEFAULT_INTENT}'"
    for s, (_, name) in zip(scores, tx.INTENT_RULES):
        intent = f"CASE WHEN ({s}) > ({best}) THEN '{name}' ELSE {intent} END"
        best = f"CASE WHEN ({s}) > ({best}) THEN ({s}) ELSE ({best}) END"
    return f"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
sc AS (SELECT conv_id, turn, {intent} AS intent, {best} AS best FROM u)
SELECT conv_id, turn, intent, CASE WHEN best > 0 THEN round(least(1.0, 0.5 + best * 0.5), 2) ELSE 0.5 END AS confidence FROM sc"""


@register("intent_classify", _intent_sql())
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent of every user turn by keyword fraction (first strictly best rule wins), confidence in [0.5, 1]."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return tx.classify_intent(conv, "text").select("conv_id", "turn", "intent", "confidence")


def _quality_sql() -> str:
    hits = " + ".join(
        f"CASE WHEN regexp_matches(c, '(?i)(^|[^\\pL\\pN_]){p[2:-2]}([^\\pL\\pN_]|$)') THEN 1 ELSE 0 END" for p in tx.ENGLISH_PATTERNS
    )
    return rf"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS c FROM conversations WHERE role = 'assistant'),
h AS (SELECT conv_id, turn, c, {hits} AS english_hits FROM a)
SELECT conv_id, turn, english_hits,
       concat_ws(',', CASE WHEN length(c) < 20 THEN 'too_short' END, CASE WHEN english_hits >= 2 THEN 'mostly_english' END,
                 CASE WHEN length(c) = 0 THEN 'empty' END) AS issues,
       NOT (length(c) = 0 OR english_hits >= 2) AS is_valid
FROM h"""


@register("text_quality_gate", _quality_sql())
def text_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality gate of every assistant turn — too_short (< 20 chars), mostly_english (≥ 2 of 8 patterns), empty."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    out = tx.quality_gate(conv, "text")
    return out.select("conv_id", "turn", "english_hits", F.concat_ws(",", "issues").alias("issues"), "is_valid")


SEARCH_TERM = "12"


@register(
    "search_page",
    f"""WITH m AS (SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
           WHERE c_name ILIKE '%{SEARCH_TERM}%' OR c_mktsegment ILIKE '%{SEARCH_TERM}%' OR n_name ILIKE '%{SEARCH_TERM}%')
SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY c_custkey DESC LIMIT 20 OFFSET 5""",
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring search over name, segment and nation, newest key first,
    offset 5, limit 20, with the total match count."""
    cust = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cust = cust.select("c_custkey", "c_name", "c_mktsegment", "n_name")
    page, total = tx.search_page(cust, ["c_name", "c_mktsegment", "n_name"], SEARCH_TERM, "c_custkey", "c_custkey", 20, 5)
    n = total.first()["total"]
    return page.withColumn("total", F.lit(n).cast("long"))


_RISK_SQL = with_bookings(
    """
SELECT booking_id, round(p, 4) AS risk_score, round(p * 100.0, 1) AS risk_percent, lvl AS risk_level,
       concat_ws(' | ', CASE WHEN lead_time > 180 THEN printf('long lead time (%d days)', lead_time)
                             WHEN lead_time <= 7 THEN printf('short lead time (%d days)', lead_time) END,
                 'first visit', CASE WHEN coalesce(market_segment, '') <> '' THEN 'channel: ' || market_segment END) AS risk_factors,
       printf('%s booking made %d days ahead, %s, %d nights. Cancellation risk %s%% (%s).', coalesce(hotel, 'Hotel'), lead_time,
              CASE WHEN ch > 0 THEN printf('%d adults, %d children', ad, ch) ELSE printf('%d adults', ad) END,
              nights, CAST(round(p * 100.0, 1) AS VARCHAR), lvl) AS profile_summary
FROM (SELECT booking_id, market_segment, hotel, coalesce(lead_time, 0) AS lead_time, score AS p,
             CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS lvl,
             CASE WHEN coalesce(adults, 1) = 0 THEN 1 ELSE coalesce(adults, 1) END AS ad, coalesce(children, 0) AS ch,
             coalesce(stays_in_week_nights, 0) + coalesce(stays_in_weekend_nights, 0) AS nights FROM bookings)"""
)


@register("risk_factors", _RISK_SQL)
def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk band, rounded score / percent, ordered risk-factor list and profile summary for every booking."""
    b = bookings(spark, sf_dir).select(
        "booking_id", "score", "lead_time", "market_segment", "hotel", "adults", "children",
        "stays_in_week_nights", "stays_in_weekend_nights",
    )
    out = tx.risk_context(b, "score")
    return out.select(
        "booking_id", "risk_score", "risk_percent", "risk_level", F.concat_ws(" | ", "risk_factors").alias("risk_factors"),
        "profile_summary",
    )


@register(
    "rolling_hit_ratio",
    f"""SELECT event_id, event_type AS method,
       round(avg(CASE WHEN value >= {HIT_VALUE} THEN 1.0 ELSE 0.0 END)
             OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 6) AS rolling_hit_ratio
FROM events""",
)
def rolling_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling hit ratio over the last 200 retrievals per method (events as the retrieval log).

    Rank per method (grouped rank), running hit count (grouped prefix sum) and a
    self-join on rank − 200 give the window sum without a per-method window task.
    """
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("method"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (F.col("value") >= F.lit(HIT_VALUE)).cast("long").alias("hit"),
    )
    ranked = grouped_rank(ev, ["method"], "t_us", "event_id", out="r")
    cum = global_prefix_sum(ranked, "r", ["hit"], group_cols=["method"])
    back = cum.select("method", (F.col("r") + rt.ROLLING_WINDOW).alias("r"), F.col("cum_hit").alias("cum_back"))
    j = cum.join(back, ["method", "r"], "left")
    n = F.least(F.col("r") + 1, F.lit(rt.ROLLING_WINDOW)).cast("double")
    ratio = (F.col("cum_hit") - F.coalesce(F.col("cum_back"), F.lit(0))).cast("double") / n
    return j.select("event_id", "method", rnd(ratio).alias("rolling_hit_ratio"))


@register(
    "trim_history",
    f"""SELECT conv_id, turn, role FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
         count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
WHERE n <= {TRIM_MAX} OR rn <= 2 OR n - rn + 1 <= {TRIM_MAX} - 2""",
)
def trim_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the first two and the last (4 − 2) messages of every conversation."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return tx.trim_history(conv, "conv_id", "turn", TRIM_MAX).select("conv_id", "turn", "role")


@register(
    "hybrid_query_text",
    with_bookings(
        """
SELECT booking_id, concat_ws(' ', CASE WHEN score >= 0.6 THEN 'yüksek_risk' WHEN score < 0.35 THEN 'düşük_risk upsell' END,
                             CASE WHEN lead_time > 180 THEN 'lead_time uzun erken_rezervasyon' END,
                             CASE WHEN market_segment LIKE '%Online%' THEN 'online ota online_ta' END,
                             CASE WHEN coalesce(lead_time, 0) <> 0 THEN 'lead time ' || CAST(lead_time AS VARCHAR) END,
                             CASE WHEN coalesce(market_segment, '') <> '' THEN lower(market_segment) END) AS query_text
FROM bookings"""
    ),
)
def hybrid_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval tags and the hybrid query text built from each booking's attributes and score."""
    b = bookings(spark, sf_dir)
    return b.select("booking_id", rt.customer_query_text(b.columns, F.col("score")).alias("query_text"))


@register(
    "retrieval_eval_file",
    f"""WITH {_EMB_CTES.strip()},
fh AS (SELECT q.query_id, min(CASE WHEN vec_label = q.query_id THEN rank END) AS first_hit
       FROM (SELECT DISTINCT label AS query_id FROM embeddings) q LEFT JOIN res ON res.query_id = q.query_id GROUP BY q.query_id)
SELECT count(*) AS sample_count, round(avg(CASE WHEN first_hit IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k,
       round(avg(coalesce(1.0 / first_hit, 0.0)), 6) AS mrr_at_k
FROM fh""",
)
def retrieval_eval_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set is written as JSONL from the embeddings table (one line per label and
    expected id, as a list and as a single id), read back through the eval-set reader (array / object / JSONL), and
    hit-rate@5 / MRR@5 are computed by joining the retrieved with the expected ids."""
    from driftwise.sources.files import read_eval_set, scratch_path

    emb, res, _ = _emb_results(spark, sf_dir)
    one = F.col("vec_id").cast("string")
    samples = emb.select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query"),
                         F.array(one).alias("expected_chunk_ids"), one.alias("expected_chunk_id"))
    path = scratch_path(spark, "eval-set")
    samples.write.mode("overwrite").json(path)
    expected = read_eval_set(spark, path).select(
        F.regexp_extract("query", r"^label-(\d+)$", 1).cast("int").alias("query_id"), F.explode("expected_ids").alias("vec"))
    wanted = expected.select("query_id", F.col("vec").cast("long").alias("vec_id"), F.lit(True).alias("hit")).distinct()
    j = res.join(wanted, ["query_id", "vec_id"], "left")
    out = rt.retrieval_eval(j, "query_id", F.coalesce("hit", F.lit(False)), EMB_K, expected)
    return out.select("sample_count", rnd(F.col("hit_rate_at_k")).alias("hit_rate_at_k"), rnd(F.col("mrr_at_k")).alias("mrr_at_k"))


@register(
    "chunk_text_sql",
    f"""WITH {_CHUNK_CTES.strip()}
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(n_chunks AS INTEGER) AS n_chunks, CAST(c.start AS INTEGER) AS start,
       CAST(length(c.chunk) AS INTEGER) AS chunk_len, md5(c.chunk) AS chunk_md5
FROM ch""",
)
def chunk_text_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker for SQL users, as a SQL table expression over whole texts (built-in functions only)."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_for_chunking")
    tx.normalised_view(spark, "documents_for_chunking", "doc_id", "text", "normalised_for_chunking")
    return spark.sql(tx.chunk_sql("normalised_for_chunking", "doc_id", "t"))
