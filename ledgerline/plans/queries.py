"""Named queries over the driver's test tables (``queries()`` in
``__spark_entry__``).  Each builder reads the whole input tables.

Oracle SQL strings run in DuckDB over the same parquet files (views
``region nation customer ...`` are pre-registered by the checker).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..adapter import with_ctes
from ..operators import features as feat
from ..operators.master import MASTER_COLUMNS, master_from_sf
from ..session import stored
from ..sources import io as IO
from .artifacts import (curated_master, demand_artifact, forest_artifact, products_with_demand, segment_artifact,
                        shared_path, whole_master)
from . import sql_ctes as Q
from .registry import register

# --------------------------------------------------------------------------
# Master and feature tables


@register("master", with_ctes(f"SELECT {', '.join(MASTER_COLUMNS)} FROM master"))
def q_master(spark, sf_dir):
    """J1/J2 + P8-P10 + F1-F8: the master sales table."""
    return master_from_sf(spark, sf_dir).select(*MASTER_COLUMNS)


@register("demand_daily", with_ctes("SELECT * FROM daily", Q.DAILY))
def q_demand_daily(spark, sf_dir):
    """A1: daily demand per product."""
    return feat.demand_daily(master_from_sf(spark, sf_dir, by_product=True))


@register("demand_features", with_ctes("SELECT * FROM demand", Q.DAILY + "," + Q.DEMAND))
def q_demand_features(spark, sf_dir):
    """A1 + W1-W3: the demand dataset (flagship)."""
    return feat.demand_features(master_from_sf(spark, sf_dir, by_product=True))


@register("customer_features", with_ctes("SELECT * FROM cust", Q.CUSTOMERS))
def q_customer_features(spark, sf_dir):
    """A2 + A3 + F10: customer spend, orders, recency."""
    return feat.customer_features(master_from_sf(spark, sf_dir))


@register("anomaly_features", with_ctes("SELECT * FROM anom", Q.ANOMALY))
def q_anomaly_features(spark, sf_dir):
    """P11 + F9 + L4: anomaly inputs per order line."""
    return feat.anomaly_features(master_from_sf(spark, sf_dir))


@register("latest_by_product", with_ctes(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
    "(PARTITION BY product_id ORDER BY order_date DESC) AS rn FROM demand) WHERE rn = 1",
    Q.DAILY + "," + Q.DEMAND))
def q_latest_by_product(spark, sf_dir):
    """Last demand row per product."""
    return feat.latest_by_product(feat.demand_features(master_from_sf(spark, sf_dir, by_product=True)))


# --------------------------------------------------------------------------
# KPIs and model-quality metrics

from ..operators import kpis as K  # noqa: E402
from ..operators import reports as R  # noqa: E402
from .sql_ctes import r4  # noqa: E402


def _master(spark, sf_dir):
    """The curated master (S4): reports scan it instead of joining again."""
    return curated_master(spark, sf_dir)


def _demand(spark, sf_dir):
    return feat.demand_features(_master(spark, sf_dir))


_SUMDEC = "COALESCE(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE), 0.0)"


@register("kpis", with_ctes(f"""
SELECT count(DISTINCT order_id) AS total_orders, count(DISTINCT product_id) AS total_products,
  count(DISTINCT customer_id) AS total_customers,
  floor({_SUMDEC} * 1e2 + 5e-1) / 1e2 AS total_revenue,
  floor(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / count(total_amount) * 1e2 + 5e-1)
    / 1e2 AS average_order_value
FROM master"""))
def q_kpis(spark, sf_dir):
    """A4: dashboard KPIs."""
    return K.kpis(_master(spark, sf_dir))


@register("top_categories", with_ctes(f"""
SELECT category, floor(revenue * 1e2 + 5e-1) / 1e2 AS revenue FROM (
  SELECT category, {_SUMDEC} AS revenue FROM master WHERE category IS NOT NULL GROUP BY category
) ORDER BY revenue DESC, category LIMIT 5"""))
def q_top_categories(spark, sf_dir):
    """A5 + K2: top-5 categories by revenue."""
    return K.top_categories(_master(spark, sf_dir), 5)


@register("anomaly_label_rate", with_ctes(f"""
SELECT CAST(COALESCE(sum(anomaly_flag), 0) AS BIGINT) AS labeled_anomaly_count,
  {r4('avg(anomaly_flag)')} AS labeled_anomaly_rate FROM anom""", Q.ANOMALY))
def q_anomaly_label_rate(spark, sf_dir):
    """Labelled anomaly count and rate."""
    return K.anomaly_label_rate(feat.anomaly_features(_master(spark, sf_dir)))


_CLS_SQL = """
SELECT tp, fp, fn, tn,
  floor(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END * 1e4 + 5e-1) / 1e4 AS accuracy,
  floor(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END * 1e4 + 5e-1) / 1e4 AS precision,
  floor(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END * 1e4 + 5e-1) / 1e4 AS recall,
  floor(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END * 1e4 + 5e-1) / 1e4 AS f1_score
FROM (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn
      FROM (SELECT CAST(COALESCE(TRY_CAST(anomaly_flag AS DOUBLE), 0.0) AS INTEGER) AS y,
                   CAST(COALESCE(TRY_CAST(promotion_flag AS DOUBLE), 0.0) AS INTEGER) AS p FROM anom))"""


@register("classification_metrics", with_ctes(_CLS_SQL, Q.ANOMALY))
def q_classification_metrics(spark, sf_dir):
    """accuracy/precision/recall/F1 of a flag pair (label = anomaly_flag,
    naive prediction = promotion_flag)."""
    return K.classification_metrics(feat.anomaly_features(_master(spark, sf_dir)),
                                    "anomaly_flag", "promotion_flag")


@register("regression_metrics", with_ctes(f"""
SELECT n AS rows_test,
  floor(CASE WHEN syy - sy * sy / n > 0 THEN 1 - sse / (syy - sy * sy / n) END * 1e4 + 5e-1) / 1e4 AS r2_score,
  {r4('sae / n')} AS mae, {r4('sse / n')} AS mse, {r4('sqrt(sse / n)')} AS rmse
FROM (SELECT count(1) AS n, sum(y) AS sy, sum(y * y) AS syy, sum((y - p) * (y - p)) AS sse,
             sum(abs(y - p)) AS sae
      FROM (SELECT CAST(target_demand AS DOUBLE) AS y, CAST(lag_1_sales AS DOUBLE) AS p FROM demand))
""", Q.DAILY + "," + Q.DEMAND))
def q_regression_metrics(spark, sf_dir):
    """A10: R2/MAE/MSE/RMSE of the naive forecast (lag_1 vs target)."""
    return K.regression_metrics(_demand(spark, sf_dir), "target_demand", "lag_1_sales")


@register("row_counts", with_ctes("""
SELECT 'master' AS "table", count(1) AS rows FROM master
UNION ALL SELECT 'demand', count(1) FROM demand
UNION ALL SELECT 'anomaly', count(1) FROM anom
UNION ALL SELECT 'customers', count(1) FROM cust""",
                                  Q.DAILY + "," + Q.DEMAND + "," + Q.ANOMALY + "," + Q.CUSTOMERS))
def q_row_counts(spark, sf_dir):
    """Rows of master, demand, anomaly and customer tables."""
    m = _master(spark, sf_dir)
    return K.row_counts(master=m, demand=feat.demand_features(m),
                        anomaly=feat.anomaly_features(m), customers=feat.customer_features(m))


# --------------------------------------------------------------------------
# Report visuals


def _grp_sql(key):
    return with_ctes(f"""
SELECT {key}, {_SUMDEC} AS revenue, sum(quantity) AS total_quantity, count(1) AS order_lines
FROM master GROUP BY {key}""")


@register("revenue_by_category", _grp_sql("category"))
def q_revenue_by_category(spark, sf_dir):
    """B1: revenue by category."""
    return R.revenue_by_dimension(_master(spark, sf_dir), "category")


@register("revenue_by_region", _grp_sql("order_region"))
def q_revenue_by_region(spark, sf_dir):
    """B1: revenue by order region."""
    return R.revenue_by_dimension(_master(spark, sf_dir), "order_region")


@register("monthly_revenue", with_ctes(f"""
SELECT month_period, {_SUMDEC} AS revenue, count(DISTINCT order_id) AS orders
FROM master GROUP BY month_period"""))
def q_monthly_revenue(spark, sf_dir):
    """B2: monthly revenue trend."""
    return R.monthly_revenue(_master(spark, sf_dir))


@register("product_demand", with_ctes(f"""
SELECT product_id, sum(quantity) AS total_quantity, {r4('avg(price)')} AS avg_price,
  {_SUMDEC} AS revenue FROM master GROUP BY product_id"""))
def q_product_demand(spark, sf_dir):
    """Quantity and price per product."""
    return R.product_demand(_master(spark, sf_dir))


@register("anomaly_by_region", with_ctes(f"""
SELECT order_region, count(1) AS order_lines,
  CAST(sum(COALESCE(CAST(anomaly_flag AS INTEGER), 0)) AS BIGINT) AS anomaly_lines,
  {r4('avg(COALESCE(CAST(anomaly_flag AS INTEGER), 0))')} AS anomaly_rate,
  {_SUMDEC} AS revenue,
  COALESCE(CAST(sum(CAST(CASE WHEN COALESCE(CAST(anomaly_flag AS INTEGER), 0) = 1
    THEN total_amount END AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS flagged_revenue
FROM master GROUP BY order_region"""))
def q_anomaly_by_region(spark, sf_dir):
    """Anomaly lines, rate and revenue per region."""
    return R.anomaly_by_region(_master(spark, sf_dir))


@register("customers_by_flag_payment", with_ctes("""
SELECT anomaly_flag, payment_method, count(DISTINCT customer_id) AS customers
FROM master GROUP BY anomaly_flag, payment_method"""))
def q_customers_by_flag_payment(spark, sf_dir):
    """Customers by anomaly flag x payment method."""
    return R.customers_by_flag_payment(_master(spark, sf_dir))


@register("discount_by_category", with_ctes(f"""
SELECT category, {r4('avg(discount_pct)')} AS avg_discount_pct FROM master GROUP BY category"""))
def q_discount_by_category(spark, sf_dir):
    """Mean discount by category."""
    return R.discount_by_category(_master(spark, sf_dir))


@register("customers_by_segment_region", with_ctes("""
SELECT segment, customer_region, count(DISTINCT customer_id) AS customers
FROM master GROUP BY segment, customer_region"""))
def q_customers_by_segment_region(spark, sf_dir):
    """Customers by segment x region."""
    return R.customers_by_segment_region(_master(spark, sf_dir))


@register("revenue_by_segment_brand", with_ctes(f"""
SELECT segment, brand, {_SUMDEC} AS revenue FROM master GROUP BY segment, brand"""))
def q_revenue_by_segment_brand(spark, sf_dir):
    """Revenue by segment x brand."""
    return R.revenue_by_segment_brand(_master(spark, sf_dir))


@register("feature_summary", with_ctes(f"""
SELECT category, {r4('avg(lag_1_sales)')} AS avg_lag_1, {r4('avg(rolling_avg_7)')} AS avg_rolling_7,
  {r4('avg(margin_pct)')} AS avg_margin_pct, {r4('avg(discount_pct)')} AS avg_discount_pct,
  sum(lag_7_sales) AS sum_lag_7, count(1) AS product_days
FROM demand GROUP BY ROLLUP (category)""", Q.DAILY + "," + Q.DEMAND))
def q_feature_summary(spark, sf_dir):
    """Demand feature averages by category with a total row (rollup)."""
    return R.feature_summary(_demand(spark, sf_dir))


@register("revenue_ytd", with_ctes("""
SELECT year, order_date, CAST(rev AS DOUBLE) AS revenue,
  CAST(sum(rev) OVER (PARTITION BY year ORDER BY order_date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS revenue_ytd
FROM (SELECT year, order_date, sum(CAST(total_amount AS DECIMAL(18,2))) AS rev
      FROM master WHERE order_date IS NOT NULL GROUP BY year, order_date)"""))
def q_revenue_ytd(spark, sf_dir):
    """Daily revenue with year-to-date running total."""
    return R.revenue_ytd(_master(spark, sf_dir))


@register("category_distribution", with_ctes(f"""
SELECT category, order_lines, {r4('order_lines / sum(order_lines) OVER ()')} AS share
FROM (SELECT category, count(1) AS order_lines FROM master GROUP BY category)"""))
def q_category_distribution(spark, sf_dir):
    """Category distribution with share."""
    return R.category_distribution(_master(spark, sf_dir))


@register("lag_snapshot", with_ctes(f"""
SELECT product_id, sum(quantity) AS total_quantity, {r4('avg(lag_1_sales)')} AS avg_lag_1,
  {r4('avg(lag_7_sales)')} AS avg_lag_7, {r4('avg(rolling_avg_7)')} AS avg_rolling_7
FROM demand GROUP BY product_id""", Q.DAILY + "," + Q.DEMAND))
def q_lag_snapshot(spark, sf_dir):
    """Lags next to demand per product."""
    return R.lag_snapshot(_demand(spark, sf_dir))


@register("price_vs_quantity", with_ctes("""
SELECT category, price, sum(quantity) AS total_quantity, count(*) AS product_days
FROM demand GROUP BY category, price""", Q.DAILY + "," + Q.DEMAND))
def q_price_vs_quantity(spark, sf_dir):
    """Price and quantity points by category."""
    return R.price_vs_quantity(_demand(spark, sf_dir))


@register("flag_distribution", with_ctes(f"""
SELECT anomaly_flag, count(*) AS order_lines, {_SUMDEC} AS revenue FROM anom GROUP BY anomaly_flag""", Q.ANOMALY))
def q_flag_distribution(spark, sf_dir):
    """Lines and revenue per flag."""
    return R.flag_distribution(feat.anomaly_features(_master(spark, sf_dir)))


@register("flagged_orders", with_ctes("""
SELECT order_id, product_id, customer_id, quantity, price, total_amount, discount_pct
FROM anom WHERE anomaly_flag = 1""", Q.ANOMALY))
def q_flagged_orders(spark, sf_dir):
    """The flagged lines."""
    return R.flagged_orders(feat.anomaly_features(_master(spark, sf_dir)))


@register("spend_vs_frequency", with_ctes("""
SELECT purchase_frequency, count(*) AS customers,
  CAST(sum(CAST(customer_total_spend AS DECIMAL(18,2))) AS DOUBLE) AS spend,
  CAST(sum(customer_total_orders) AS BIGINT) AS orders
FROM cust GROUP BY purchase_frequency""", Q.CUSTOMERS))
def q_spend_vs_frequency(spark, sf_dir):
    """Spend per purchase frequency."""
    return R.spend_vs_frequency(feat.customer_features(_master(spark, sf_dir)))


@register("customer_table", with_ctes("""
SELECT customer_id, customer_total_spend, customer_total_orders, avg_order_value, recency_days, age,
  discount_sensitivity FROM cust""", Q.CUSTOMERS))
def q_customer_table(spark, sf_dir):
    """The detailed customer table."""
    return R.customer_table(feat.customer_features(_master(spark, sf_dir)))


# --------------------------------------------------------------------------
# Text, chunks, vectors, retrieval

from ..adapter import products_table, read  # noqa: E402
from ..functions import text as TX  # noqa: E402
from ..functions.scalars import round_half_up  # noqa: E402
from ..functions.vectors import DEFAULT_DIM, cosine  # noqa: E402
from ..operators import retrieval as RT  # noqa: E402

_KT_SQL = """
'Product ID: ' || coalesce(nullif(trim(CAST(p_partkey AS VARCHAR)), ''), 'unknown')
 || chr(10) || 'Product Name: ' || coalesce(nullif(trim(p_name), ''),
                                             nullif(trim(CAST(p_partkey AS VARCHAR)), ''), 'unknown')
 || chr(10) || 'Category: ' || coalesce(nullif(trim(p_type), ''), 'general')
 || chr(10) || 'Brand: ' || coalesce(nullif(trim(p_brand), ''), 'generic')
 || chr(10) || 'Description: ' || rtrim(repeat(p_name || ' ' || p_type || ' ' || p_brand || ' ', 12 + CAST(p_size AS INTEGER) % 9))
 || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Return Policy: ' || 'returns within ' || CAST(p_size AS VARCHAR) || ' days' ELSE '' END"""


@register("knowledge_text", f"SELECT p_partkey AS product_id, trim({_KT_SQL}) AS knowledge_text FROM part")
def q_knowledge_text(spark, sf_dir):
    """Compact knowledge text per product."""
    p = products_table(spark, sf_dir)
    return p.select("product_id", TX.knowledge_text(available=set(p.columns)).alias("knowledge_text"))


def _chunk_sql(table: str, id_col: str, text_col: str, size: int = 80, step: int = 70) -> str:
    return f"""
(SELECT {id_col}, {text_col} AS txt,
        list_filter(regexp_split_to_array(coalesce({text_col}, ''), '{TX.WS_RE2}'), lambda x: x <> '') AS w
 FROM {table})"""


def _chunks_cte(name: str, table: str, id_col: str, text_col: str, size=80, step=70) -> str:
    return f"""
{name} AS (
  SELECT {id_col}, CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_index,
         unnest(chunks) AS content
  FROM (SELECT {id_col},
          CASE WHEN len(w) = 0 THEN []::VARCHAR[]
               WHEN len(w) <= {size} THEN [txt]
               ELSE list_transform(range(0, 1 + CAST(ceil((len(w) - {size}) / {step}) AS INTEGER)),
                                   lambda i: array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' '))
          END AS chunks
        FROM {_chunk_sql(table, id_col, text_col, size, step)})
)"""


@register("chunk_documents", "WITH " + _chunks_cte("dc", "documents", "doc_id", "text")
          + "\nSELECT doc_id, chunk_index, content FROM dc")
def q_chunk_documents(spark, sf_dir):
    """80-word chunks with 10-word overlap over whole documents."""
    return RT.document_chunks(read(spark, sf_dir, "documents"))


@register("prepare_text", "WITH " + _chunks_cte("dc", "documents", "doc_id", "text") + f"""
SELECT doc_id, chunk_index, prepared FROM (
  SELECT doc_id, chunk_index,
    array_to_string(list_filter(regexp_split_to_array(content, '{TX.WS_RE2}'), lambda x: x <> ''), ' ')
      AS prepared FROM dc) WHERE prepared <> ''""")
def q_prepare_text(spark, sf_dir):
    """X4 + L7: white-space normalised chunk texts (whole chunks), blanks dropped."""
    ch = RT.document_chunks(read(spark, sf_dir, "documents"))
    out = ch.select("doc_id", "chunk_index",
                    TX.prepare_text("content", max_chars=None).alias("prepared"))
    return out.filter(F.col("prepared") != "")


_PRODUCT_CHUNKS = f"""
pk AS (SELECT p_partkey, coalesce(nullif(trim(CAST(p_partkey AS VARCHAR)), ''), 'unknown') AS product_id,
              coalesce(nullif(trim(p_name), ''), coalesce(nullif(trim(CAST(p_partkey AS VARCHAR)), ''), 'unknown')) AS product_name,
              coalesce(nullif(trim(p_type), ''), 'general') AS category,
              coalesce(nullif(trim(p_brand), ''), 'generic') AS brand,
              trim({_KT_SQL}) AS kt FROM part),
{_chunks_cte("pkc", "pk", "p_partkey", "kt")},
store AS (SELECT pk.product_id || '-' || CAST(pkc.chunk_index AS VARCHAR) AS id, pk.product_id,
                 pk.product_name, pk.category, pk.brand, pkc.content, pkc.chunk_index,
                 pk.p_partkey AS product_key
          FROM pkc JOIN pk ON pkc.p_partkey = pk.p_partkey)"""


@register("product_chunks", f"WITH {_PRODUCT_CHUNKS}\nSELECT * FROM store")
def q_product_chunks(spark, sf_dir):
    """Product knowledge chunks with ids "{product_id}-{index}"."""
    return RT.product_chunks(products_table(spark, sf_dir, spread=True))


def _bucket_sql(text_expr: str, dim: int = DEFAULT_DIM) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array(lower(coalesce({text_expr}, '')), "
            f"'[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), "
            f"lambda t: CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS INTEGER))")


_SEARCH = f"""
{_PRODUCT_CHUNKS},
qs AS (SELECT conv_id, turn, text AS question FROM conversations
       WHERE role = 'user'
         AND len(list_filter(regexp_split_to_array(coalesce(text, ''), '{TX.WS_RE2}'), lambda x: x <> '')) > 0),
qb AS (SELECT conv_id, turn, unnest({_bucket_sql("array_to_string(list_filter(regexp_split_to_array(question, '" + TX.WS_RE2 + "'), lambda x: x <> ''), ' ')")}) AS b FROM qs),
qv AS (SELECT conv_id, turn, b, count(*) AS c FROM qb GROUP BY ALL),
qn AS (SELECT conv_id, turn, sqrt(sum(c * c)) AS n FROM qv GROUP BY ALL),
sbk AS (SELECT id, unnest({_bucket_sql("array_to_string(list_filter(regexp_split_to_array(content, '" + TX.WS_RE2 + "'), lambda x: x <> ''), ' ')")}) AS b FROM store),
sv AS (SELECT id, b, count(*) AS c FROM sbk GROUP BY ALL),
sn AS (SELECT id, sqrt(sum(c * c)) AS n FROM sv GROUP BY ALL),
dots AS (SELECT qv.conv_id, qv.turn, sv.id, CAST(sum(qv.c * sv.c) AS DOUBLE) AS d
         FROM qv JOIN sv ON qv.b = sv.b GROUP BY ALL),
scored AS (
  SELECT qs.conv_id, qs.turn, s.*, 
    CASE WHEN coalesce(qn.n, 0) > 0 AND coalesce(sn.n, 0) > 0
         THEN coalesce(dots.d, 0.0) / (qn.n * sn.n) ELSE 0.0 END AS raw_score
  FROM qs CROSS JOIN store s
  LEFT JOIN qn ON qn.conv_id = qs.conv_id AND qn.turn = qs.turn
  LEFT JOIN sn ON sn.id = s.id
  LEFT JOIN dots ON dots.conv_id = qs.conv_id AND dots.turn = qs.turn AND dots.id = s.id),
ranked AS (
  SELECT *, floor(raw_score * 1e4 + 5e-1) / 1e4 AS score,
    row_number() OVER (PARTITION BY conv_id, turn
                       ORDER BY floor(raw_score * 1e4 + 5e-1) / 1e4 DESC, product_key, chunk_index) AS rank
  FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= 3),
hits AS (
  SELECT * EXCLUDE (anyp), raw_score < 0.35 AS below_min_score FROM (
    SELECT *, max(CAST(score >= 0.35 AS INTEGER)) OVER (PARTITION BY conv_id, turn) AS anyp FROM top)
  WHERE score >= 0.35 OR anyp = 0)"""


def _search_hits(spark, sf_dir):
    store = RT.bag_store(products_table(spark, sf_dir, spread=True))
    qs = RT.user_questions(read(spark, sf_dir, "conversations"))
    qs = RT.bag_column(qs, "question", "qvec")
    hits = RT.search_bags(qs, ["conv_id", "turn"], "qvec", store, s_order=["product_key", "chunk_index"])
    return qs, hits


@register("vector_search", f"WITH {_SEARCH}\nSELECT * FROM hits")
def q_vector_search(spark, sf_dir):
    """X5-X8 + J4 + W5: exact top-3 product chunks for every user question."""
    return _search_hits(spark, sf_dir)[1]


@register("support_context", f"""WITH {_SEARCH},
src AS (SELECT conv_id, turn,
          list(struct_pack(rank := rank, product_id := product_id, product_name := product_name,
                           content := content, score := score) ORDER BY rank) AS src
        FROM hits GROUP BY conv_id, turn)
SELECT qs.conv_id, qs.turn, qs.question,
  CASE WHEN src.src IS NULL THEN 'I could not retrieve verified product knowledge for this question right now. '
            || 'Please check whether the product knowledge JSON store exists and Azure embedding settings are correct.'
       WHEN trim(coalesce(src.src[1].content, '')) = '' THEN '{RT.EMPTY_CONTENT_ANSWER}'
       ELSE 'Based on the retrieved product knowledge for '
            || coalesce(nullif(src.src[1].product_name, ''), nullif(src.src[1].product_id, ''), 'the matched product')
            || ' (' || coalesce(nullif(src.src[1].product_id, ''), 'the matched product')
            || '), the available information is: ' || trim(coalesce(src.src[1].content, '')) END AS answer,
  coalesce(list_transform(src.src, lambda x: x.product_id), []) AS source_ids,
  coalesce(list_transform(src.src, lambda x: x.score), []) AS source_scores,
  coalesce(trim(array_to_string(list_transform(list_filter(src.src, lambda x: coalesce(x.content, '') <> ''),
            lambda x: 'Source ' || CAST(x.rank AS VARCHAR) || ':' || chr(10) || x.content), chr(10) || chr(10))), '')
    AS context,
  '{RT.RETRIEVAL_SOURCE}' AS retrieval_source,
  CASE WHEN src.src IS NULL THEN '{RT.NO_HITS_ERROR}' END AS retrieval_error,
  CASE WHEN src.src IS NULL THEN 'not_called' ELSE 'context_fallback' END AS llm_source,
  CAST(NULL AS VARCHAR) AS llm_error, 'support_agent' AS agent
FROM qs LEFT JOIN src ON qs.conv_id = src.conv_id AND qs.turn = src.turn""")
def q_support_context(spark, sf_dir):
    """Support answers built from the retrieved context (no model call)."""
    qs, hits = _search_hits(spark, sf_dir)
    out = RT.support_context(qs.drop("qvec"), hits, ["conv_id", "turn"])
    # flat arrays instead of array<struct> so results compare across engines
    return out.select(*[c for c in out.columns if c != "sources"],
                      F.transform("sources", lambda x: x["product_id"]).alias("source_ids"),
                      F.transform("sources", lambda x: x["score"]).alias("source_scores"))


@register("support_prompts", f"""WITH {_SEARCH},
src AS (SELECT conv_id, turn, list(struct_pack(rank := rank, content := content) ORDER BY rank) AS src
        FROM hits GROUP BY conv_id, turn)
SELECT qs.conv_id, qs.turn,
  'Customer Question:' || chr(10) || qs.question || chr(10) || chr(10) || 'Retrieved Context:' || chr(10)
  || coalesce(trim(array_to_string(list_transform(list_filter(src.src, lambda x: coalesce(x.content, '') <> ''),
       lambda x: 'Source ' || CAST(x.rank AS VARCHAR) || ':' || chr(10) || x.content), chr(10) || chr(10))), '')
  || chr(10) || chr(10) || 'Answer briefly using only the retrieved context.' || chr(10)
  || 'Mention product id if relevant.' AS user_prompt
FROM qs JOIN src ON qs.conv_id = src.conv_id AND qs.turn = src.turn""")
def q_support_prompts(spark, sf_dir):
    """X13 + X10: the support prompt of every question with its retrieved context."""
    from ..operators import dashboard as DB
    qs, hits = _search_hits(spark, sf_dir)
    return DB.support_prompts(RT.support_context(qs.drop("qvec"), hits, ["conv_id", "turn"]), ["conv_id", "turn"])


@register("cosine", """
WITH p AS (SELECT label, min(vec_id) AS proto_id, arg_min(embedding, vec_id) AS pe
           FROM embeddings GROUP BY label),
x AS (SELECT e.vec_id, e.label, p.proto_id, e.embedding AS a, p.pe AS b FROM embeddings e
      JOIN p ON e.label = p.label),
y AS (SELECT vec_id, label, proto_id, a, b,
        list_reduce(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)), lambda s, v: s + v) AS d,
        sqrt(list_reduce(list_transform(a, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda s, v: s + v)) AS na,
        sqrt(list_reduce(list_transform(b, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda s, v: s + v)) AS nb
      FROM x)
SELECT vec_id, label, proto_id,
  floor(CASE WHEN len(a) > 0 AND len(b) > 0 AND len(a) = len(b) AND na <> 0 AND nb <> 0
             THEN d / (na * nb) ELSE 0.0 END * 1e4 + 5e-1) / 1e4 AS cosine
FROM y""")
def q_cosine(spark, sf_dir):
    """Cosine of every stored vector with its label's prototype
    (the label's lowest vec_id); joined on label, no pairs."""
    e = read(spark, sf_dir, "embeddings")
    proto = e.groupBy("label").agg(F.min("vec_id").alias("proto_id"),
                                   F.min_by("embedding", "vec_id").alias("pe"))
    j = e.join(proto, "label")
    return j.select("vec_id", "label", "proto_id",
                    round_half_up(cosine("embedding", "pe"), 4).alias("cosine"))


# --------------------------------------------------------------------------
# Cleaning, validation, header repair

from ..adapter import customers_table, orders_table  # noqa: E402
from ..operators import cleaning as CL  # noqa: E402
from ..operators import quality as QL  # noqa: E402
from ..operators.master import build_master  # noqa: E402


# Dirty inputs derived from the given tables: every rule of the cleaning has
# rows that break it.  ``file_order`` is the row order of the file.
_DIRTY_PARTS_SQL = """
dirty AS (
  SELECT p_partkey AS "Product ID", CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS product_name,
         CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS category, p_brand AS brand,
         CASE WHEN p_partkey % 13 = 0 THEN 'n/a' WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS VARCHAR) END AS price,
         p_partkey * 2 AS file_order FROM part
  UNION ALL
  SELECT p_partkey, 'late copy', 'late', 'late', '1', p_partkey * 2 + 1 FROM part WHERE p_partkey % 3 = 0
  UNION ALL
  SELECT p_partkey, 'early copy', 'early', NULL, 'x', p_partkey * 2 - 1 FROM part WHERE p_partkey % 7 = 0)"""


def _dirty_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    price = F.when(key % 13 == 0, F.lit("n/a")).when(key % 17 != 0, F.col("p_size").cast("string"))
    whole = p.select(key.alias("Product ID"), F.when(key % 11 != 0, F.col("p_name")).alias(" Product-Name"),
                     F.when(key % 5 != 0, F.col("p_type")).alias("Category"), F.col("p_brand").alias("brand"),
                     price.alias("Unit Price"), (key * 2).alias("file_order"))
    late = p.where("p_partkey % 3 = 0").select(key, F.lit("late copy"), F.lit("late"), F.lit("late"), F.lit("1"), key * 2 + 1)
    early = p.where("p_partkey % 7 = 0").select(key, F.lit("early copy"), F.lit("early"), F.lit(None).cast("string"),
                                                F.lit("x"), key * 2 - 1)
    return whole.union(late).union(early)


@register("clean_products", f"""WITH {_DIRTY_PARTS_SQL}
SELECT CAST("Product ID" AS VARCHAR) AS product_id, COALESCE(product_name, 'unknown') AS product_name,
       COALESCE(category, 'unknown') AS category, COALESCE(brand, 'unknown') AS brand,
       COALESCE(TRY_CAST(price AS DOUBLE), 0.0) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY "Product ID" ORDER BY file_order) AS rn FROM dirty) WHERE rn = 1""")
def q_clean_products(spark, sf_dir):
    """A12 + F1/F4 + P2/P7: raw headers, bad prices, nulls and repeated keys;
    the first row per product_id in file order."""
    out = CL.clean_products(_dirty_parts(spark, sf_dir), order_key=F.col("file_order"))
    return out.select("product_id", "product_name", "category", "brand", "price")


@register("clean_customers", with_ctes("""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, COALESCE(region, 'unknown') AS region,
       COALESCE(segment, 'unknown') AS segment
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY file_order) AS rn FROM (
  SELECT customer_id, CASE WHEN customer_id % 4 <> 0 THEN region END AS region,
         CASE WHEN customer_id % 6 <> 0 THEN segment END AS segment, customer_id AS file_order FROM customers_c
  UNION ALL
  SELECT customer_id, 'moved', NULL, -1 - customer_id FROM customers_c WHERE customer_id % 5 = 0)) WHERE rn = 1"""))
def q_clean_customers(spark, sf_dir):
    """A12 + F4 + P7: cleaned customers, the first row per customer_id."""
    c = customers_table(spark, sf_dir)
    key = F.col("customer_id")
    whole = c.select(key.alias("CustomerID"), F.when(key % 4 != 0, F.col("region")).alias("Region"),
                     F.when(key % 6 != 0, F.col("segment")).alias("segment"), key.alias("file_order"))
    again = c.where("customer_id % 5 = 0").select(key, F.lit("moved"), F.lit(None).cast("string"), -1 - key)
    out = CL.clean_customers(whole.union(again), order_key=F.col("file_order"))
    return out.select("customer_id", "region", "segment")


from ..functions import repair as RP  # noqa: E402


_BY_FORM = """CASE {form} WHEN 'iso' THEN TRY_STRPTIME(written, '%Y-%m-%d')
  WHEN 'dmy' THEN TRY_STRPTIME(written, '%d/%m/%Y') WHEN 'mdy' THEN TRY_STRPTIME(written, '%m/%d/%Y') END"""


@register("orders_found_format", with_ctes(f"""
SELECT order_id, product_id, written, {_BY_FORM.format(form='coalesce(first, form)')} AS order_date,
  {_BY_FORM.format(form='coalesce((SELECT mode(form) FROM forms), form)')} AS by_majority
FROM (SELECT *, (SELECT nullif(arg_min(coalesce(form, 'none'), line_key), 'none') FROM forms WHERE written IS NOT NULL)
        AS first FROM forms)""", """
forms AS (
  SELECT *, CASE WHEN written LIKE '____-%' THEN 'iso'
      WHEN TRY_STRPTIME(written, '%m/%d/%Y') IS NOT NULL THEN 'mdy'
      WHEN TRY_STRPTIME(written, '%d/%m/%Y') IS NOT NULL THEN 'dmy' END AS form
  FROM (SELECT order_id, product_id, line_key, CASE WHEN (order_id + product_id) % 6 = 0 THEN NULL
                 WHEN (order_id + product_id) % 5 = 0 THEN strftime(order_date, '%Y-%m-%d')
                 WHEN (order_id + product_id) % 7 = 0 THEN '31/31/2025'
                 ELSE strftime(order_date, '%d/%m/%Y') END AS written
        FROM orders_c))"""))
def q_orders_found_format(spark, sf_dir):
    """dates written in mixed forms; the first value's form reads
    all (each its own where the first is no date), or the most frequent one."""
    o = orders_table(spark, sf_dir)
    k = F.col("order_id") + F.col("product_id")
    written = (F.when(k % 6 == 0, F.lit(None)).when(k % 5 == 0, F.date_format("order_date", "yyyy-MM-dd"))
               .when(k % 7 == 0, F.lit("31/31/2025")).otherwise(F.date_format("order_date", "dd/MM/yyyy")))
    raw = o.select("order_id", "product_id", "line_key", written.alias("written"))
    return raw.select("order_id", "product_id", "written", RP.as_date(raw, "written", order=F.col("line_key")).alias("order_date"),
                      RP.as_date(raw, "written").alias("by_majority"))


@register("clean_orders", with_ctes("""
SELECT order_id, product_id, customer_id, order_date, quantity, price, channel
FROM (SELECT CAST(order_id AS VARCHAR) AS order_id, COALESCE(product_id, 'unknown') AS product_id,
             CAST(customer_id AS VARCHAR) AS customer_id, order_date,
             COALESCE(TRY_CAST(quantity AS DOUBLE), 1.0) AS quantity, price, channel,
             row_number() OVER (PARTITION BY order_id ORDER BY line_key) AS rn
      FROM (SELECT order_id, CASE WHEN product_id % 19 <> 0 THEN CAST(product_id AS VARCHAR) END AS product_id,
                   customer_id, price, channel, line_key,
                   CASE WHEN (order_id + product_id) % 8 = 0 THEN '-3' WHEN (order_id + product_id) % 9 = 0 THEN 'bad'
                        WHEN (order_id + product_id) % 10 <> 0 THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) END AS quantity,
                   CASE WHEN (order_id + product_id) % 6 <> 0 THEN date_trunc('day', order_date)::TIMESTAMP END AS order_date
            FROM orders_c)
      WHERE COALESCE(TRY_CAST(quantity AS DOUBLE), 1.0) > 0 AND order_date IS NOT NULL)
WHERE rn = 1"""))
def q_clean_orders(spark, sf_dir):
    """A12 + L1 + L2 + F3: text quantities and day-first dates, some broken;
    the first valid line per order_id."""
    o = orders_table(spark, sf_dir)
    k = F.col("order_id") + F.col("product_id")
    quantity = (F.when(k % 8 == 0, F.lit("-3")).when(k % 9 == 0, F.lit("bad"))
                .when(k % 10 != 0, F.col("quantity").cast("long").cast("string")))
    date = F.when(k % 6 == 0, F.lit("31/31/2025")).otherwise(F.date_format("order_date", "dd/MM/yyyy"))
    raw = o.select(F.col("order_id"), F.when(F.col("product_id") % 19 != 0, F.col("product_id")).alias("ProductID"),
                   F.col("customer_id").alias("Customer-ID"), date.alias("OrderDate"), quantity.alias("Quantity"),
                   "price", "channel", "line_key")
    out = CL.clean_orders(raw, date_format="dd/MM/yyyy")
    return out.select("order_id", "product_id", "customer_id", "order_date", "quantity", "price", "channel")


@register("quarantine", with_ctes(f"""
SELECT order_id, product_id, customer_id, quantity, price, discount_pct, promotion_flag,
  errors, len(errors) = 0 AS is_valid
FROM (SELECT *, list_filter([
    CASE WHEN TRY_CAST(quantity AS DOUBLE) IS NULL OR TRY_CAST(quantity AS DOUBLE) <= 0 THEN '{QL.MSG_QUANTITY}' END,
    CASE WHEN TRY_CAST(price AS DOUBLE) IS NULL OR TRY_CAST(price AS DOUBLE) <= 0 THEN '{QL.MSG_PRICE}' END,
    CASE WHEN COALESCE(TRY_CAST(discount_pct AS DOUBLE), 0.0) < 0 THEN '{QL.MSG_DISCOUNT}' END,
    CASE WHEN COALESCE(TRY_CAST(promotion_flag AS DOUBLE), 0.0) NOT IN (0.0, 1.0) THEN '{QL.MSG_PROMOTION}' END
  ], lambda x: x IS NOT NULL) AS errors
  FROM (SELECT order_id, product_id, customer_id, price,
          CASE WHEN (order_id + product_id) % 8 = 0 THEN -quantity WHEN (order_id + product_id) % 9 <> 0 THEN quantity END AS quantity,
          CASE WHEN product_id % 7 = 0 THEN -5.0 ELSE discount_pct END AS discount_pct,
          CASE WHEN product_id % 9 = 0 THEN 3 ELSE promotion_flag END AS promotion_flag FROM master))"""))
def q_quarantine(spark, sf_dir):
    """Every order line with its validation errors and a valid flag."""
    k, p = F.col("order_id") + F.col("product_id"), F.col("product_id")
    m = _master(spark, sf_dir).select(
        "order_id", "product_id", "customer_id",
        F.when(k % 8 == 0, -F.col("quantity")).when(k % 9 != 0, F.col("quantity")).alias("quantity"), "price",
        F.when(p % 7 == 0, F.lit(-5.0)).otherwise(F.col("discount_pct")).alias("discount_pct"),
        F.when(p % 9 == 0, F.lit(3)).otherwise(F.col("promotion_flag")).alias("promotion_flag"))
    return QL.quarantine(m)


@register("normalize_columns", with_ctes(f"SELECT {', '.join(MASTER_COLUMNS)} FROM master"))
def q_normalize_columns(spark, sf_dir):
    """Master built from tables with messy headers (spaces, case,
    dashes, 'Qty', 'Unit Price', 'Date') must equal the clean master."""
    o = orders_table(spark, sf_dir)
    o = o.withColumnsRenamed({"order_id": " Order_ID ", "product_id": "Product-ID",
                              "customer_id": "CustomerID", "quantity": "Qty",
                              "price": "Unit Price", "order_date": "Date",
                              "total_amount": "Total_Amount"})
    p = products_table(spark, sf_dir).withColumnRenamed("product_id", "Product_ID ")
    c = customers_table(spark, sf_dir).withColumnRenamed("customer_id", "Customer ID")
    return build_master(p, c, o).select(*MASTER_COLUMNS)


# --------------------------------------------------------------------------
# Logs, sinks and sources

from ..sources import io as IO  # noqa: E402
from ..sources import logs as LG  # noqa: E402


@register("recent_logs", """
SELECT event_type, event_id, ts AS created_at, user_id, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events)
WHERE rn <= 20""")
def q_recent_logs(spark, sf_dir):
    """Newest 20 documents per collection (events as log)."""
    ev = read(spark, sf_dir, "events").withColumnRenamed("ts", "created_at")
    return LG.recent(ev, 20, "created_at", ["event_id"], per=["event_type"]).select(
        "event_type", "event_id", "created_at", "user_id", "value", "props")


@register("upsert", """
WITH ex AS (SELECT user_id, count(*) AS n_events, max(ts) AS last_ts FROM events
            WHERE event_type <> 'purchase' GROUP BY user_id),
u AS (SELECT user_id, n_events, last_ts, last_ts AS updated_at FROM (
        SELECT user_id, CAST(1 AS BIGINT) AS n_events, ts AS last_ts,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events WHERE event_type = 'purchase') WHERE rn = 1)
SELECT user_id, n_events, last_ts, CAST(NULL AS TIMESTAMP) AS updated_at FROM ex
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = ex.user_id)
UNION ALL SELECT * FROM u""")
def q_upsert(spark, sf_dir):
    """Upsert per-user activity docs with purchase events (last wins)."""
    ev = read(spark, sf_dir, "events")
    existing = ev.filter(F.col("event_type") != "purchase").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"))
    updates = ev.filter(F.col("event_type") == "purchase").select(
        "user_id", F.lit(1).cast("long").alias("n_events"), F.col("ts").alias("last_ts"),
        "event_id")
    out = LG.upsert(existing, updates, ["user_id"], ["last_ts", "event_id"],
                    updated_at=F.col("last_ts"))
    return out.select("user_id", "n_events", "last_ts", "updated_at")


@register("upsert_table", """
WITH ex AS (SELECT user_id, count(*) AS n_events, max(ts) AS last_ts FROM events
            WHERE event_type <> 'purchase' GROUP BY user_id),
u AS (SELECT user_id, n_events, last_ts, last_ts AS updated_at FROM (
        SELECT user_id, CAST(1 AS BIGINT) AS n_events, ts AS last_ts,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events WHERE event_type = 'purchase') WHERE rn = 1),
r AS (SELECT user_id, CAST(-1 AS BIGINT) AS n_events, max(ts) AS last_ts, max(ts) AS updated_at FROM events
      WHERE event_type = 'signup' OR user_id % 50 = 0 GROUP BY user_id),
one AS (SELECT user_id, n_events, last_ts, CAST(NULL AS TIMESTAMP) AS updated_at FROM ex
        WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = ex.user_id)
        UNION ALL SELECT * FROM u)
SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = one.user_id)
UNION ALL SELECT * FROM r""")
def q_upsert_table(spark, sf_dir):
    """S13 on a stored table: two batches of updates written back into a table
    keyed by user (all purchases, then a few users), and the table read."""
    ev = read(spark, sf_dir, "events")
    path = IO.unique_scratch(spark, "user-activity")
    existing = ev.filter(F.col("event_type") != "purchase").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"),
        F.lit(None).cast("timestamp_ntz" if dict(ev.dtypes)["ts"] == "timestamp_ntz" else "timestamp").alias("updated_at"))
    LG.write_keyed(existing, path, ["user_id"], parts=16)
    purchases = ev.filter(F.col("event_type") == "purchase").select(
        "user_id", F.lit(1).cast("long").alias("n_events"), F.col("ts").alias("last_ts"), "event_id")
    LG.upsert_table(spark, path, purchases, ["user_id"], ["last_ts", "event_id"], updated_at=F.col("last_ts"))
    late = ev.where("event_type = 'signup' or user_id % 50 = 0").select(
        "user_id", F.lit(-1).cast("long").alias("n_events"), F.col("ts").alias("last_ts"))
    LG.upsert_table(spark, path, late, ["user_id"], ["last_ts"], updated_at=F.col("last_ts"))
    return LG.read_keyed(spark, path).select("user_id", "n_events", "last_ts", "updated_at")


@register("preview_master", with_ctes(
    f"SELECT {', '.join(MASTER_COLUMNS)} FROM master ORDER BY line_key LIMIT 5"))
def q_preview_master(spark, sf_dir):
    """First five master rows in order-file order."""
    return LG.preview(_master(spark, sf_dir), 5, ["line_key"]).select(*MASTER_COLUMNS)


@register("curated_roundtrip", with_ctes(f"SELECT {', '.join(MASTER_COLUMNS)} FROM master"))
def q_curated_roundtrip(spark, sf_dir):
    """S3 + S4: master written partitioned by year, read back whole."""
    path = IO.unique_scratch(spark, "curated-master")
    # years are few: the joined lines, products' texts included, need not be dealt once more
    IO.write_curated(master_from_sf(spark, sf_dir), path, partition_by=["year"], compression="zstd", in_place=True)
    back = IO.read_curated(spark, path)
    return back.select(*MASTER_COLUMNS)


@register("report_export", with_ctes(f"SELECT {', '.join(MASTER_COLUMNS)} FROM master"))
def q_report_export(spark, sf_dir):
    """Master exported to a reporting CSV and read back with its schema."""
    src = whole_master(spark, sf_dir)
    out = IO.export_report_csv(spark, src, shared_path(spark, sf_dir, "report-csv"))
    text = T.StructType([T.StructField(f.name, f.dataType if f.name in MASTER_COLUMNS else T.StringType())
                         for f in IO.read_curated(spark, src).schema.fields])
    return IO.load_csv(spark, out, text).select(*MASTER_COLUMNS)


@register("log_append")
def q_log_append(spark, sf_dir):
    """S10 + G4: KPI rows appended to an analytics log collection, read back."""
    path = IO.unique_scratch(spark, "analytics-log")
    docs = LG.as_log_documents(K.kpis(_master(spark, sf_dir)), "analytics")
    LG.append_log(docs, path)
    return spark.read.parquet(path)


_LOG_KPIS = ["total_orders", "total_products", "total_customers", "total_revenue", "average_order_value"]


@register("log_documents", with_ctes(f"""
SELECT 'analytics' AS type, count(DISTINCT order_id) AS total_orders, count(DISTINCT product_id) AS total_products,
  count(DISTINCT customer_id) AS total_customers, floor({_SUMDEC} * 1e2 + 5e-1) / 1e2 AS total_revenue,
  floor(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / count(total_amount) * 1e2 + 5e-1) / 1e2
    AS average_order_value, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS DOUBLE) AS revenue
FROM master
UNION ALL
SELECT 'category_revenue', NULL, NULL, NULL, NULL, NULL, category, CAST({_SUMDEC} AS DOUBLE) FROM master
WHERE category IS NOT NULL GROUP BY category"""))
def q_log_documents(spark, sf_dir):
    """S10 + G4: two kinds of documents appended to one collection, their
    payloads read back."""
    path = IO.unique_scratch(spark, "log-documents")
    m = _master(spark, sf_dir)
    LG.append_log(LG.as_log_documents(K.kpis(m), "analytics"), path)
    LG.append_log(LG.as_log_documents(K.revenue_by(m, "category"), "category_revenue"), path)
    payload = ", ".join([f"{c} {'long' if i < 3 else 'double'}" for i, c in enumerate(_LOG_KPIS)]
                        + ["category string", "revenue double"])
    return spark.read.parquet(path).select("type", F.from_json("payload", payload).alias("p")).select("type", "p.*")


# --------------------------------------------------------------------------
# Models: demand forecast, isolation forest, customer segments

from ..models import clustering as CM  # noqa: E402
from ..models import demand as DM  # noqa: E402
from ..models import isoforest as IF  # noqa: E402


def _requests(spark, sf_dir):
    """Forecast requests: every catalogue product for the day after the last
    order, and one product outside the catalogue for every tenth of them."""
    last = read(spark, sf_dir, "orders").select(F.max("o_orderdate")).scalar()
    part = read(spark, sf_dir, "part").select("p_partkey")
    asked = part.union(part.where("p_partkey % 10 = 0").select(F.col("p_partkey") + 1_000_000_000))
    return asked.select(F.col("p_partkey").cast("string").alias("product_id"),
                        F.date_format(F.date_add(F.to_date(last), 1), "yyyy-MM-dd").alias("forecast_date"))


_REQ_SQL = """
req AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id,
               strftime(CAST((SELECT max(o_orderdate) FROM orders) AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d')
                 AS forecast_date
        FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey + 1000000000 FROM part WHERE p_partkey % 10 = 0)),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
           (PARTITION BY product_id ORDER BY order_date DESC) AS rn FROM demand) WHERE rn = 1)"""


@register("forecast_inputs", with_ctes("""
SELECT r.product_id, r.forecast_date, l.category, l.brand, l.order_region, l.customer_region,
  l.channel, l.segment, l.price, COALESCE(l.base_price, l.price, 0.0) AS base_price,
  CAST(month(CAST(r.forecast_date AS DATE)) AS INTEGER) AS order_month,
  CAST(isodow(CAST(r.forecast_date AS DATE)) - 1 AS INTEGER) AS order_weekday,
  CAST((isodow(CAST(r.forecast_date AS DATE)) - 1) IN (5, 6) AS INTEGER) AS is_weekend,
  l.quantity AS lag_1_sales, l.lag_7_sales, l.rolling_avg_7, l.discount_pct,
  CAST(l.promotion_flag AS INTEGER) AS promotion_flag, l.purchase_frequency, l.margin_pct,
  l.popularity_score
FROM req r JOIN latest l ON r.product_id = CAST(l.product_id AS VARCHAR)""",
                                       Q.DAILY + "," + Q.DEMAND + "," + _REQ_SQL))
def q_forecast_inputs(spark, sf_dir):
    """J5 + M12: forecast feature rows (latest demand row per requested product)."""
    # straight from the tables: the joined lines lie by product already
    latest = feat.latest_by_product(feat.demand_features(master_from_sf(spark, sf_dir, by_product=True)))
    return DM.forecast_inputs(_requests(spark, sf_dir), latest)


@register("unknown_products", with_ctes("""
SELECT r.product_id, r.forecast_date, 'Unknown product_id: ' || r.product_id AS error
FROM req r WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE CAST(l.product_id AS VARCHAR) = r.product_id)""",
                                        Q.DAILY + "," + Q.DEMAND + "," + _REQ_SQL))
def q_unknown_products(spark, sf_dir):
    """Forecast requests for products without any demand row."""
    return DM.unknown_products(_requests(spark, sf_dir), products_with_demand(spark, sf_dir))


_SPLIT_SQL = """CASE WHEN row_number() OVER (ORDER BY
       ('0x' || substr(md5(CAST(product_id AS VARCHAR) || '|' || strftime(order_date, '%Y-%m-%d %H:%M:%S')), 1, 13))::BIGINT,
       CAST(product_id AS VARCHAR) || '|' || strftime(order_date, '%Y-%m-%d %H:%M:%S'))
       <= (count(*) OVER () * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split"""


@register("split_demand", with_ctes(f"SELECT product_id, order_date, {_SPLIT_SQL} FROM demand",
                                    Q.DAILY + "," + Q.DEMAND))
def q_split_demand(spark, sf_dir):
    """M3: deterministic train/test split of the demand rows, exactly 20 % test."""
    d = stored(_demand(spark, sf_dir).select("product_id", "order_date"))
    return DM.split(d, ["product_id", "order_date"], 20)


@register("demand_train_rows", with_ctes(f"""
SELECT *, {_SPLIT_SQL}
FROM (SELECT order_date, """ + ", ".join(feat.DEMAND_FEATURES) + """, target_demand FROM demand)""",
                                         Q.DAILY + "," + Q.DEMAND))
def q_demand_train_rows(spark, sf_dir):
    """L3 + M3: complete demand rows with their split."""
    # straight from the tables: the joined lines lie by product already
    return DM.train_rows(feat.demand_features(master_from_sf(spark, sf_dir, by_product=True)))


@register("demand_model")
def q_demand_model(spark, sf_dir):
    """M1-M4: random-forest demand model; test-split metrics."""
    return demand_artifact(spark, sf_dir)[2]


@register("forecast")
def q_forecast(spark, sf_dir):
    """Predicted demand for every forecast request."""
    model, modes, _ = demand_artifact(spark, sf_dir)
    latest = feat.latest_by_product(_demand(spark, sf_dir))
    inputs = DM.forecast_inputs(_requests(spark, sf_dir), latest)
    return DM.predict(model, inputs, modes)


@register("anomaly_scores")
def q_anomaly_scores(spark, sf_dir):
    """M5-M7: isolation-forest score and flag of every order line."""
    return forest_artifact(spark, sf_dir)[1]


@register("anomaly_metrics")
def q_anomaly_metrics(spark, sf_dir):
    """A8 + A9 on the isolation-forest flags against the labels."""
    scored = forest_artifact(spark, sf_dir)[1]
    return K.anomaly_metrics(scored, "anomaly_flag", "anomaly_pred")


@register("score_transactions")
def q_score_transactions(spark, sf_dir):
    """M8 + L8: batch scoring of valid transactions (order lines as requests)."""
    model = forest_artifact(spark, sf_dir)[0]
    tx = _master(spark, sf_dir).select("order_id", "quantity", "price", "discount_pct", "promotion_flag")
    valid, _bad = QL.split_valid(tx)
    return IF.score_transactions(model, valid)


@register("customer_segments")
def q_customer_segments(spark, sf_dir):
    """Customers with their k-means cluster."""
    return segment_artifact(spark, sf_dir)[1]


@register("segment_customers")
def q_segment_customers(spark, sf_dir):
    """M13 + S7: labels of the loaded model, with the labels written at
    training time beside them (they must agree)."""
    model, segments = segment_artifact(spark, sf_dir)
    return model.predict(segments.withColumnRenamed("cluster", "trained_cluster")).select(
        "customer_id", "trained_cluster", "cluster")


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    """A7 + K3: customers per cluster."""
    return K.cluster_sizes(segment_artifact(spark, sf_dir)[1])


@register("cluster_quality")
def q_cluster_quality(spark, sf_dir):
    """Silhouette (squared Euclidean) of the segmentation."""
    model, segments = segment_artifact(spark, sf_dir)
    return CM.silhouette(model, segments.drop("cluster"))


@register("segment_overview")
def q_segment_overview(spark, sf_dir):
    """Total customers and the first ten segment rows."""
    seg = segment_artifact(spark, sf_dir)[1]
    total = seg.select(F.count(F.lit(1))).scalar()
    return seg.orderBy("customer_id").limit(10).withColumn("total_customers", total)


@register("segment_profile", with_ctes("""
SELECT *, (SELECT count(*) FROM cust) AS total_customers FROM cust ORDER BY customer_id LIMIT 10""", Q.CUSTOMERS))
def q_segment_profile(spark, sf_dir):
    """The segment overview without the model's labels."""
    return q_segment_overview(spark, sf_dir).drop("cluster")


# --------------------------------------------------------------------------
# Vector store sink/source, training run, dashboard, prompts, streaming

from ..operators import dashboard as DB  # noqa: E402
from ..plans.training import train_all  # noqa: E402
from ..streaming.scoring import SOURCE_GROUP, TRANSACTION_SCHEMA, StreamPaths, run_available_now  # noqa: E402


_EMB_SQL = ("list_transform(range(" + str(DEFAULT_DIM) + "), lambda i: CAST(len(list_filter(bk, "
            "lambda x: x = i)) AS DOUBLE))")


@register("build_store", f"""WITH {_PRODUCT_CHUNKS},
sb AS (SELECT *, {_bucket_sql("array_to_string(list_filter(regexp_split_to_array(content, '" + TX.WS_RE2 + "'), lambda x: x <> ''), ' ')")} AS bk
       FROM store WHERE len(list_filter(regexp_split_to_array(content, '{TX.WS_RE2}'), lambda x: x <> '')) > 0)
SELECT id, product_id, product_name, category, brand, content, chunk_index, product_key, {_EMB_SQL} AS embedding FROM sb""")
def q_build_store(spark, sf_dir):
    """X5 + X6 + S8: product knowledge store (chunks + embeddings) written
    as parquet and read back."""
    path = IO.unique_scratch(spark, "vector-store")
    IO.write_store(RT.build_store(products_table(spark, sf_dir, spread=True)), path)
    return IO.load_store(spark, path)


@register("load_store", f"""WITH {_PRODUCT_CHUNKS},
sb AS (SELECT *, {_bucket_sql("array_to_string(list_filter(regexp_split_to_array(content, '" + TX.WS_RE2 + "'), lambda x: x <> ''), ' ')")} AS bk
       FROM store WHERE len(list_filter(regexp_split_to_array(content, '{TX.WS_RE2}'), lambda x: x <> '')) > 0)
SELECT id, product_id, product_name, category, brand, content, {_EMB_SQL} AS embedding FROM sb""")
def q_load_store(spark, sf_dir):
    """The store written as JSON lines and loaded back with its schema."""
    path = IO.unique_scratch(spark, "vector-store-jsonl")
    st = RT.build_store(products_table(spark, sf_dir, spread=True)).select(*[f.name for f in IO.STORE_SCHEMA])
    st.write.mode("overwrite").json(path)
    return IO.load_store(spark, path, fmt="jsonl")


@register("training_summary")
def q_training_summary(spark, sf_dir):
    """M14 + S5 + S7 + G1: the whole training run; its summary record."""
    out = IO.unique_scratch(spark, "training")
    raw_p, raw_c, raw_o = products_table(spark, sf_dir), customers_table(spark, sf_dir), \
        orders_table(spark, sf_dir)
    return train_all(spark, raw_p, raw_c, raw_o, out, forest_trees=200, kmeans_restarts=20)


@register("dashboard")
def q_dashboard(spark, sf_dir):
    """KPIs, top categories, label rate, cluster sizes and the metrics of
    all three models in one row."""
    m = _master(spark, sf_dir)
    model, segments = segment_artifact(spark, sf_dir)
    clusters = CM.silhouette(model, segments.drop("cluster")).crossJoin(  # one row each
        segments.agg(F.count("*").alias("rows_total")))
    metrics = {"demand_forecasting": demand_artifact(spark, sf_dir)[2],
               "anomaly_detection": q_anomaly_metrics(spark, sf_dir), "customer_clustering": clusters}
    return DB.dashboard(m, feat.anomaly_features(m), segments, metrics)


@register("dashboard_record", with_ctes(f"""
SELECT k.*, a.*, t.*, (SELECT count(*) FROM cust) AS clustered_customers
FROM (SELECT count(DISTINCT order_id) AS total_orders, count(DISTINCT product_id) AS total_products,
        count(DISTINCT customer_id) AS total_customers, floor({_SUMDEC} * 1e2 + 5e-1) / 1e2 AS total_revenue,
        floor(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / count(total_amount) * 1e2 + 5e-1) / 1e2
          AS average_order_value FROM master) k,
     (SELECT CAST(COALESCE(sum(anomaly_flag), 0) AS BIGINT) AS labeled_anomaly_count,
        {r4('avg(anomaly_flag)')} AS labeled_anomaly_rate FROM anom) a,
     (SELECT list(category ORDER BY category) AS top_categories,
        list(floor(revenue * 1e2 + 5e-1) / 1e2 ORDER BY category) AS top_revenues
      FROM (SELECT category, {_SUMDEC} AS revenue FROM master WHERE category IS NOT NULL GROUP BY category
            ORDER BY revenue DESC, category LIMIT 5)) t""", Q.ANOMALY + "," + Q.CUSTOMERS))
def q_dashboard_record(spark, sf_dir):
    """G5 + G2: the dashboard without model metrics, its maps as arrays."""
    m = _master(spark, sf_dir)
    d = DB.dashboard(m, feat.anomaly_features(m), segment_artifact(spark, sf_dir)[1]).withColumnRenamed("top_categories", "top")
    names = F.array_sort(F.map_keys("top"))
    return d.select(*_LOG_KPIS, "labeled_anomaly_count", "labeled_anomaly_rate", names.alias("top_categories"),
                    F.transform(names, lambda c: F.col("top")[c]).alias("top_revenues"),
                    F.aggregate(F.map_values("customer_clusters"), F.lit(0).cast("long"), lambda x, y: x + y)
                    .alias("clustered_customers"))


@register("prompts")
def q_prompts(spark, sf_dir):
    """Sales prompts for every forecast (forecast record as JSON)."""
    return DB.sales_prompts(q_forecast(spark, sf_dir))


@register("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """R1 + R2: order lines streamed as transactions through validation
    and isolation-forest scoring into an append-only log table."""
    base = IO.unique_scratch(spark, "stream")
    paths = StreamPaths(f"{base}/source", f"{base}/scored", f"{base}/quarantine",
                        f"{base}/checkpoints")
    tx = _master(spark, sf_dir).select(
        F.col("order_id").cast("string").alias("order_id"), "quantity", "price",
        "discount_pct", F.col("promotion_flag").cast("int").alias("promotion_flag"))
    tx.write.mode("overwrite").option("parquet.block.size", SOURCE_GROUP).parquet(paths.source)
    run_available_now(spark, forest_artifact(spark, sf_dir)[0], paths)
    return spark.read.parquet(paths.scored)


@register("stream_sinks", with_ctes("""
SELECT order_id, quantity, price, discount_pct, promotion_flag, 'scored' AS sink, '' AS errors
FROM tx WHERE quantity > 0 AND price > 0 AND discount_pct >= 0 AND promotion_flag IN (0, 1)
UNION ALL
SELECT order_id, quantity, price, discount_pct, promotion_flag, 'quarantine',
  concat_ws('; ', CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'quantity must be > 0' END,
    CASE WHEN price IS NULL OR price <= 0 THEN 'price must be > 0' END,
    CASE WHEN discount_pct < 0 THEN 'discount_pct must be >= 0' END,
    CASE WHEN promotion_flag NOT IN (0, 1) THEN 'promotion_flag must be 0 or 1' END)
FROM tx WHERE NOT coalesce(quantity > 0 AND price > 0 AND discount_pct >= 0 AND promotion_flag IN (0, 1), false)""",
    Q.MASTER_TX))
def q_stream_sinks(spark, sf_dir):
    """R1 + R2 + L8: one stream, two sinks; the columns that need no model."""
    base = IO.unique_scratch(spark, "stream-sinks")
    paths = StreamPaths(f"{base}/source", f"{base}/scored", f"{base}/quarantine", f"{base}/checkpoints")
    k = F.col("order_id").cast("long") % 13
    tx = _master(spark, sf_dir).select(
        F.col("order_id").cast("string").alias("order_id"), F.when(k != 1, F.col("quantity")).alias("quantity"),
        F.when(k == 2, -F.col("price")).otherwise(F.col("price")).alias("price"),
        F.when(k == 3, F.lit(-1.0)).otherwise(F.col("discount_pct")).alias("discount_pct"),
        F.when(k.isin(3, 4), F.lit(7)).otherwise(F.col("promotion_flag").cast("int")).alias("promotion_flag"))
    tx.write.option("parquet.block.size", SOURCE_GROUP).parquet(paths.source)
    run_available_now(spark, forest_artifact(spark, sf_dir)[0], paths, max_files_per_trigger=4)
    columns = [f.name for f in TRANSACTION_SCHEMA]
    scored = spark.read.parquet(paths.scored).select(*columns, F.lit("scored").alias("sink"), F.lit("").alias("errors"))
    bad = spark.read.parquet(paths.quarantined)
    return scored.unionByName(bad.select(*columns, F.lit("quarantine").alias("sink"),
                                         F.array_join("errors", "; ").alias("errors")))


@register("analytics_prompt")
def q_analytics_prompt(spark, sf_dir):
    """The analytics prompt with the dashboard record as JSON."""
    return DB.analytics_prompt(q_dashboard(spark, sf_dir))


@register("embedding_search", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                  sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
           FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, s.vec_id,
            CASE WHEN len(q.v) > 0 AND len(q.v) = len(s.v) AND q.n > 0 AND s.n > 0
                 THEN list_dot_product(q.v, s.v) / (q.n * s.n) ELSE 0.0 END AS raw
          FROM e q JOIN (SELECT min(vec_id) AS proto FROM embeddings GROUP BY label) p ON q.vec_id = p.proto CROSS JOIN e s),
ranked AS (SELECT query_id, vec_id, floor(raw * 1e4 + 5e-1) / 1e4 AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY floor(raw * 1e4 + 5e-1) / 1e4 DESC, vec_id) AS rank
           FROM pairs),
top AS (SELECT * FROM ranked WHERE rank <= 3)
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, max(CAST(score >= 0.35 AS INTEGER)) OVER (PARTITION BY query_id) AS anyp FROM top)
WHERE score >= 0.35 OR anyp = 0""")
def q_embedding_search(spark, sf_dir):
    """X8 over the given vector table: exact top-3 neighbours of every label's
    prototype, its lowest vec_id (blocked search, no cross join)."""
    e = read(spark, sf_dir, "embeddings")
    proto = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    qs = e.join(proto.select("vec_id"), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    hits = RT.search(qs, ["query_id"], "qvec", e.select("vec_id", "embedding"),
                     s_order=["vec_id"], k=TX.TOP_K, min_score=TX.MIN_SCORE)
    return hits.select("query_id", "vec_id", "score", "rank")


_ONE_HOT_JOIN = "\n".join(f"JOIN idx i{i} ON i{i}.k = {i} AND i{i}.v = CAST(d.{c} AS VARCHAR)"
                          for i, c in enumerate(feat.DEMAND_CATEGORICAL))
_ONE_HOT_AT = ", ".join(f"i{i}.p" for i in range(len(feat.DEMAND_CATEGORICAL)))
_ONE_HOT_NUM = ", ".join(f"{{'i': w.n + {k}, 'v': CAST(d.{c} AS DOUBLE)}}" for k, c in enumerate(feat.DEMAND_NUMERIC))


@register("demand_features_matrix", with_ctes(f"""
SELECT product_id, order_date, n_features, list_concat(cat, list_transform(num, lambda x: x.i)) AS indices,
  list_concat(list_transform(cat, lambda x: 1.0::DOUBLE), list_transform(num, lambda x: x.v)) AS values
FROM (SELECT d.product_id, d.order_date, CAST(w.n + {len(feat.DEMAND_NUMERIC)} AS INTEGER) AS n_features,
        [{_ONE_HOT_AT}] AS cat, list_filter([{_ONE_HOT_NUM}], lambda x: x.v <> 0) AS num
      FROM demand d CROSS JOIN (SELECT count(*) AS n FROM idx) w
      {_ONE_HOT_JOIN})""", Q.DAILY + "," + Q.DEMAND + """,
idx AS (SELECT k, v, row_number() OVER (ORDER BY k, v) - 1 AS p
        FROM (SELECT DISTINCT k, v FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS k, CAST({c} AS VARCHAR) AS v FROM demand" for i, c in enumerate(feat.DEMAND_CATEGORICAL)) + """)))"""))
def q_demand_features_matrix(spark, sf_dir):
    """M1: imputed + one-hot encoded + assembled model inputs of every demand row."""
    # straight from the tables: the joined lines lie by product already
    return DM.feature_matrix(feat.demand_features(master_from_sf(spark, sf_dir, by_product=True)))
