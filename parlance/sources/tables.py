"""Input tables and the role views derived from them.

Each view is plain SQL over the base tables, in a dialect Spark and DuckDB
share, so the operators and their checks read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FILE_FACTOR = 10.0  # bytes in memory for a byte of a Parquet file, as the planner takes it

BATCH_BYTES = 8 << 20  # of a batch that goes to Python

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

VIEWS = {
    "fx_bot": """
SELECT conv_id AS sender_id, CAST(conv_id % 3 AS INT) AS retailer_id, 1704067200 + conv_id * 100000 + turn * 45 AS ts,
  turn % 4 AS next_response_time,
  CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN 'color_question' WHEN 1 THEN 'subvertical_selection'
    WHEN 2 THEN 'product_type_selection' WHEN 3 THEN 'fit_question' WHEN 4 THEN 'yes_no' END AS response_code,
  CASE WHEN (conv_id * 7 + turn) % 6 = 4 THEN 'yes,no' WHEN (conv_id + turn) % 5 <> 0
    THEN concat('a', CAST((conv_id + turn) % 4 AS VARCHAR(9)), ',b', CAST(turn % 3 AS VARCHAR(9))) END AS replies
FROM {conversations} WHERE role = 'assistant'""",
    "fx_user": """
SELECT conv_id AS sender_id, CAST(conv_id % 3 AS INT) AS retailer_id, 1704067200 + conv_id * 100000 + turn * 45 AS ts,
  concat(CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END, CAST((conv_id + turn) % 3 AS VARCHAR(9))) AS text, text AS message,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'color,fit' WHEN 2 THEN 'fit' END AS positive_aspects,
  CASE WHEN conv_id % 2 = 0 AND turn < 2 THEN NULL WHEN conv_id % 3 = 0 THEN 'clothing' ELSE 'footwear' END AS subvertical,
  CASE WHEN turn < 2 THEN NULL WHEN conv_id % 4 = 0 THEN 'shirt' WHEN conv_id % 4 = 1 THEN 'jeans' ELSE 'pants' END AS product_type
FROM {conversations} WHERE role = 'user'""",
    "fx_clicks": """
SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'click' ELSE 'add to cart' END AS action
FROM {events} WHERE event_type IN ('click', 'purchase')""",
    "fx_outcomes": """
SELECT c_custkey AS conversation_id, c_custkey % 100 AS user_id, CAST(c_nationkey % 3 AS INT) AS retailer_id, c_mktsegment AS customer_type,
  CASE WHEN c_nationkey % 7 = 0 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR(9)) END AS num_of_messages,
  CAST(c_custkey % 4 = 0 AS INT) AS add_to_cart, CAST(c_custkey % 11 = 0 AS INT) AS converted, c_acctbal AS transaction_value
FROM {customer}""",
    "fx_products": """
SELECT p_partkey AS product_id, p_name AS product_type, CASE p_partkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Unisex' END AS gender,
  CASE WHEN p_partkey % 10 = 0 THEN 'kids' WHEN p_partkey % 2 = 0 THEN 'Adult' ELSE 'adult' END AS age_group,
  CASE WHEN p_type = 'LARGE' THEN 'footwear' ELSE 'clothing' END AS subvertical
FROM {part}""",
    "fx_product_codes": """
SELECT p_partkey AS product_id, lower(p_type) AS code, CASE WHEN p_partkey % 4 = 0 THEN 80 ELSE 100 END AS score FROM {part}
UNION ALL SELECT p_partkey, 'festive', 100 FROM {part} WHERE p_partkey % 5 = 0""",
    "fx_product_occasions": """
SELECT p_partkey AS product_id, CASE p_size % 4 WHEN 0 THEN 'wedding' WHEN 1 THEN 'office' WHEN 2 THEN 'gym' ELSE 'beach' END AS occasion, 100 AS score
FROM {part} WHERE p_partkey % 4 = 0""",
    "fx_product_types": """
SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) AS direct_parent FROM {part}
WHERE p_name NOT LIKE 'old %' AND p_name NOT LIKE 'new %'""",
    "fx_product_types_uk": """
SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) AS direct_parent FROM {part} WHERE p_name LIKE 'old %'""",
    "fx_code_synonyms": """
SELECT DISTINCT lower(p_type) AS synonym, CASE lower(p_type) WHEN 'small' THEN 'medium' ELSE lower(p_type) END AS code
FROM {part} WHERE p_type <> 'PROMO' UNION ALL SELECT 'festive', 'festive'""",
    "fx_occasion_codes": """
SELECT 'wedding' AS occasion, 'festive' AS code UNION ALL SELECT 'office', 'standard'
UNION ALL SELECT 'office', 'medium' UNION ALL SELECT 'gym', 'economy'""",
    "fx_items": """
SELECT p_partkey AS basket_id, concat('brand-', lower(p_brand)) AS item FROM {part}
UNION ALL SELECT p_partkey, concat('type-', lower(p_type)) FROM {part}
UNION ALL SELECT p_partkey, concat('shape-', split_part(p_name, ' ', 2)) FROM {part}
UNION ALL SELECT p_partkey, concat('look-', split_part(p_name, ' ', 1)) FROM {part}
UNION ALL SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'size-small' WHEN p_size <= 35 THEN 'size-mid' ELSE 'size-large' END FROM {part}""",
    "fx_scores": """
SELECT doc_id, CAST(quality AS INT) AS label, CAST((doc_id * 37) % 101 AS DOUBLE) / 101 AS score, doc_id % 4 AS grp,
  CAST(doc_id % 9 <> 0 AS INT) AS weight FROM {labels}""",
    "fx_vectors": "SELECT vec_id, label AS intent, embedding FROM {embeddings}",
    "fx_texts": "SELECT doc_id, lang, source, text FROM {documents} WHERE n_chars > 1",
    # raw service logs: JSON in a string column, as the chat services write it
    "fx_nlu_raw": """
SELECT sender_id, CASE WHEN sender_id % 5 = 0 THEN 'NULL' WHEN sender_id % 5 = 1 THEN 'ab' ELSE concat('GA1.', CAST(sender_id % 1000 AS VARCHAR(9)), '.x') END AS ga_session_id,
  retailer_id, ts, text,
  concat('{"consumer_details":{"gender":"', CASE WHEN sender_id % 2 = 0 THEN 'Female' ELSE 'Male' END, '","age_group":"',
    CASE WHEN sender_id % 3 = 0 THEN 'Adult' ELSE 'Kids' END, '"},"intents":[{"intent":"', text, '"},{"intent":"find"}],',
    CASE WHEN subvertical IS NULL THEN '' ELSE concat('"subvertical":"', subvertical, '",') END,
    '"positive":{"aspects":[', CASE positive_aspects WHEN 'color' THEN '{"aspect":"color"}' WHEN 'fit' THEN '{"aspect":"fit"}' WHEN 'color,fit' THEN '{"aspect":"color"},{"aspect":"fit"}' ELSE '' END, ']',
    CASE WHEN product_type IS NULL THEN '' ELSE concat(',"product_type":{"parent_type":"', product_type, '"}') END,
    '},"product_search_result":[', CASE WHEN ts % 2 = 0 THEN '"x","y"' ELSE '' END, ']', CASE WHEN sender_id % 7 = 0 THEN ',"skus":["s1"]' ELSE '' END, '}') AS json_response
FROM (SELECT conv_id AS sender_id, CAST(conv_id % 3 AS INT) AS retailer_id, 1704067200 + conv_id * 100000 + turn * 45 AS ts,
  concat(CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END, CAST((conv_id + turn) % 3 AS VARCHAR(9))) AS text,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'color,fit' WHEN 2 THEN 'fit' END AS positive_aspects,
  CASE WHEN conv_id % 2 = 0 AND turn < 2 THEN NULL WHEN conv_id % 3 = 0 THEN 'clothing' ELSE 'footwear' END AS subvertical,
  CASE WHEN turn < 2 THEN NULL WHEN conv_id % 4 = 0 THEN 'shirt' WHEN conv_id % 4 = 1 THEN 'jeans' ELSE 'pants' END AS product_type
FROM {conversations} WHERE role = 'user') u""",
    "fx_nbr_raw": """
SELECT conv_id AS sender_id, CAST(conv_id % 3 AS INT) AS retailer_id, CAST(1704067200 + conv_id * 100000 + turn * 45 AS VARCHAR(20)) AS ts, CAST(turn % 4 AS VARCHAR(9)) AS next_response_time,
  concat('{"ack_text":"ok","next_response":{"text":"q', CAST(turn AS VARCHAR(9)), '","data":{"response_code":"', CASE WHEN (conv_id * 7 + turn) % 2 = 0 THEN 'color_question' ELSE 'fit_question' END, '"}',
    CASE WHEN turn % 3 = 0 THEN '' ELSE concat(',"possible_values":[["1","a', CAST(turn % 4 AS VARCHAR(9)), '"],["2","no"]]') END, '}}') AS json_response
FROM {conversations} WHERE role = 'assistant'""",
    "fx_conv_raw": """
SELECT c_custkey AS conversation_id, CAST(c_nationkey % 3 AS INT) AS retailer_id,
  CASE WHEN c_custkey % 13 = 0 THEN 'bad date' ELSE concat('2019-', CASE WHEN c_custkey % 12 < 9 THEN '0' ELSE '' END, CAST(c_custkey % 12 + 1 AS VARCHAR(9)), '-1', CAST(c_custkey % 9 AS VARCHAR(9)), ' 1', CAST(c_custkey % 10 AS VARCHAR(9)), ':30:00') END AS created_at,
  CASE WHEN c_nationkey % 7 = 0 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR(9)) END AS num_of_messages,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS VARCHAR(9)) END AS add_to_cart,
  CASE WHEN c_custkey % 4 = 0 THEN 'NULL' ELSE concat('GA', CAST(c_custkey % 500 AS VARCHAR(9))) END AS ga_session_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'Returning Visitor' ELSE 'New Visitor' END AS customer_type,
  CASE WHEN c_custkey % 8 = 0 THEN 'NULL' ELSE CAST(c_acctbal AS VARCHAR(20)) END AS transaction_value,
  concat('{"platform":"', CASE WHEN c_custkey % 2 = 0 THEN 'web' ELSE 'app' END, '","device":"', lower(c_mktsegment), '","os":"os', CAST(c_nationkey AS VARCHAR(9)), '"}') AS channel
FROM {customer}""",
    # master tags: one row per (message, intent); roles taken from documents
    "fx_tags": """
SELECT doc_id AS message_id, source AS intent, lang AS category, CASE WHEN doc_id % 4 = 0 THEN 'false' ELSE 'true' END AS tag
FROM {documents} WHERE doc_id % 3 <> 2
UNION ALL SELECT doc_id + 100000000, source, lang, 'true' FROM {documents} WHERE doc_id % 50 = 0""",
}


def spread(df: DataFrame) -> DataFrame:
    """Repartition only where the scan has too few splits to keep all cores busy
    (one small file); a large input has more splits than cores and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


class Tables:
    """Attribute access to base tables and role views of one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # repeated values take few bytes in a file and many in a task: by its file size alone, a
        # table of a million rows would be broadcast, and collected by the driver for it
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_FACTOR))
        # a batch of 10,000 whole texts would be held several times over by each Python worker
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    @property
    def texts(self) -> DataFrame:
        """The text view for jobs that spend long on each row."""
        return spread(self.fx_texts)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{self.path}/{m[1]}.parquet`", text))


def view_sql(name: str) -> str:
    """The view's SQL over table names, for a check in another engine."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).strip()
