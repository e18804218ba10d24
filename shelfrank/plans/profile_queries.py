"""Queries on sources, cleaning and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.operators import analytics as a
from shelfrank.operators import prepare, sampling
from shelfrank.plans.base import INTER, I, U, inter, region_customers, rounded, segments_of, sql_hash
from shelfrank.sources.catalog import DAMAGED, Orders, read_csv, write_csv
from shelfrank.sources.shared import new_folder

# Category values of the test tables' products.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BRANDS = [f"Brand#{n}" for n in range(1, 26)]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _onehot(column: str, prefix: str, values: list[str]) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS INT) AS \"{prefix}_{v}\"" for v in values)


def _describe(column: str, p: str = "") -> str:
    return (
        f"count({column}) AS {p}count, round(avg({column}), 6) AS {p}mean, round(stddev_samp({column}), 6) AS {p}std, min({column}) AS {p}min, "
        f"round(quantile_cont({column}, 0.25), 6) AS {p}p25, round(quantile_cont({column}, 0.5), 6) AS {p}p50, round(quantile_cont({column}, 0.75), 6) AS {p}p75, max({column}) AS {p}max"
    )


def _spread(key: str, p: str) -> str:
    return f"""{p} AS (SELECT count(*) AS n_{p}s, min(n) AS {p}_min, max(n) AS {p}_max, avg(n) AS {p}_mean, median(n) AS {p}_median, quantile_cont(n, 0.25) AS {p}_p25,
 quantile_cont(n, 0.75) AS {p}_p75, count(*) FILTER (n < 5) AS {p}s_under_5, 100.0 * count(*) FILTER (n < 5) / count(*) AS {p}s_under_5_pct
 FROM (SELECT {key}, count(*) AS n FROM inter GROUP BY {key}))"""


PER_KEY = "count(*) AS n, round(avg(rating), 6) AS rating_mean, round(stddev_samp(rating), 6) AS rating_std, count(rating) AS rating_count"
ACTIVITY = "CASE WHEN n > 50 THEN 'Very High' WHEN n > 20 THEN 'High' WHEN n > 5 THEN 'Medium' ELSE 'Low' END"
POPULARITY = "CASE WHEN n > 100 THEN 'Blockbuster' WHEN n > 20 THEN 'Popular' WHEN n > 5 THEN 'Moderate' ELSE 'Niche' END"
MATRIX = f"{INTER}, cells AS (SELECT customer_key, product_key, avg(rating) AS value FROM inter GROUP BY ALL)"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def thresholds(s, d):
    i = inter(s, d)
    return rounded(a.thresholds(i, U).withColumn("key", F.lit("user")).unionByName(a.thresholds(i, I).withColumn("key", F.lit("item"))))


def sampled_sales(s, d):
    o = Orders(s, d)
    keys = sampling.sample(o.raw_customers().select(U), U, 0.25)
    return rounded(o.interactions().join(keys, U, "left_semi"))


def id_map(s, d):
    """The dense number of each customer and product that has a sale."""
    rows = inter(s, d)
    own = [sampling.numbered(rows.select(F.col(k).alias("id")).distinct(), "id").select(F.lit(kind).alias("kind"), "id", "position") for k, kind in ((U, "user"), (I, "item"))]
    return own[0].unionByName(own[1])


def pivot(s, d):
    o = Orders(s, d)
    placed = o.interactions().join(o.raw_products().select(I, "category"), I)
    return rounded(a.pivoted(placed, U, "category", TYPES))


def csv_round_trip(s, d):
    """Customers as CSV files in another encoding, every 97th with a balance that is no number, read back by their schema."""
    rows = Orders(s, d).table("customer")
    broken = F.when(F.col("c_custkey") % 97 == 0, F.lit("not, a \"number\"")).otherwise(F.col("c_acctbal").cast("string"))
    write_csv(rows.withColumn("c_acctbal", broken), path := new_folder(s, "csv"), "ISO-8859-1")
    back = read_csv(s, path, "ISO-8859-1", rows.schema)
    return back.select(*rows.columns, F.col(DAMAGED).isNotNull().alias("damaged"))


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "interactions": lambda s, d: rounded(inter(s, d)),
    "product_prep": lambda s, d: rounded(prepare.products(Orders(s, d).raw_products())),
    "customer_prep": lambda s, d: prepare.customers(region_customers(s, d)),
    "user_features_join": lambda s, d: prepare.features(Orders(s, d).raw_customers(), Orders(s, d).customer_report(), U),
    "item_features_join": lambda s, d: prepare.features(Orders(s, d).raw_products(), Orders(s, d).product_report(), I),
    "null_counts": lambda s, d: prepare.null_counts(Orders(s, d).table("documents").select(*DOCUMENT_COLUMNS)),
    "sampled_interactions": sampled_sales,
    "id_map": id_map,
    "interaction_matrix": lambda s, d: rounded(a.interaction_matrix(inter(s, d))),
    "interaction_counts": lambda s, d: a.interaction_matrix(Orders(s, d).raw_sales(), value=None),
    "matrix_centered": lambda s, d: rounded(a.centred(a.interaction_matrix(inter(s, d)))),
    "matrix_pivot": pivot,
    "matrix_sparsity": lambda s, d: rounded(a.matrix_sparsity(a.interaction_matrix(inter(s, d)))),
    "sparsity_analysis": lambda s, d: rounded(a.sparsity(inter(s, d))),
    "user_behavior": lambda s, d: rounded(a.user_behaviour(inter(s, d))),
    "activity_bins": lambda s, d: a.bin_sizes(a.user_behaviour(inter(s, d)), "activity"),
    "activity_describe": lambda s, d: rounded(a.describe(a.per_key(inter(s, d), U), "n")),
    "activity_histogram": lambda s, d: rounded(a.histogram(a.per_key(inter(s, d), U), "n")),
    "events_hourly": lambda s, d: a.by_hour(Orders(s, d).table("events"), "ts"),
    "events_weekday": lambda s, d: a.by_weekday(Orders(s, d).table("events"), "ts"),
    "session_span": lambda s, d: rounded(a.spans(Orders(s, d).table("events"), "user_id", "ts")),
    "item_popularity": lambda s, d: rounded(a.item_popularity(inter(s, d))),
    "popularity_bins": lambda s, d: a.bin_sizes(a.item_popularity(inter(s, d)), "popularity"),
    "item_pareto": lambda s, d: rounded(a.pareto(inter(s, d))),
    "validate_dataset": lambda s, d: rounded(a.validation(inter(s, d))),
    "validate_raw_sales": lambda s, d: rounded(a.validation(Orders(s, d).raw_sales())),
    "dataset_stats": lambda s, d: rounded(a.dataset_stats(Orders(s, d).raw_customers(), Orders(s, d).raw_products(), inter(s, d))),
    "segment_members": segments_of,
    "segment_shares": lambda s, d: rounded(a.value_shares(Orders(s, d).customer_report(), "cust_segmentation")),
    "eda_thresholds": thresholds,
    "eda_totals": lambda s, d: rounded(a.eda_totals(Orders(s, d).raw_sales())),
}


def _validation(rows: str, rating: bool) -> str:
    value = "rating" if rating else "CAST(NULL AS DOUBLE)"

    def spread(key: str, p: str) -> str:
        return f"""{p} AS (SELECT count(*) AS n_{p}s, count(*) FILTER (n < 3) AS {p}s_under_3, count(*) FILTER (n > cut) AS power_{p}s
 FROM (SELECT n, (SELECT quantile_cont(n, 0.99) FROM {p}n) AS cut FROM {p}n))"""

    return f"""un AS (SELECT customer_key, count(*) AS n FROM {rows} WHERE customer_key IS NOT NULL GROUP BY 1), pn AS (SELECT product_key, count(*) AS n FROM {rows} WHERE product_key IS NOT NULL GROUP BY 1),
usern AS (SELECT n FROM un), itemn AS (SELECT n FROM pn), {spread('customer_key', 'user')}, {spread('product_key', 'item')},
totals AS (SELECT count(*) AS n_rows, count(*) FILTER (customer_key IS NULL) AS null_users, count(*) FILTER (product_key IS NULL) AS null_items,
 CAST({'count(*) FILTER (rating IS NULL)' if rating else '0'} AS BIGINT) AS null_ratings, round(min({value}), 6) AS rating_min, round(max({value}), 6) AS rating_max, round(avg({value}), 6) AS rating_mean FROM {rows}),
pairs AS (SELECT CAST(sum(c - 1) AS BIGINT) AS repeated_pairs FROM (SELECT count(*) AS c FROM {rows} GROUP BY customer_key, product_key)),
wide AS (SELECT * FROM totals, pairs, user, item),
graded AS (SELECT *, CAST(null_users > 0 AS INT) + CAST(null_items > 0 AS INT) AS n_errors,
 CAST(repeated_pairs > 0 AS INT) + CAST(null_ratings > 0 AS INT) + CAST(2 * users_under_3 > n_users AS INT) + CAST(2 * items_under_3 > n_items AS INT) AS n_warnings FROM wide)
SELECT *, CASE WHEN n_errors > 0 THEN 'POOR' WHEN n_warnings = 0 THEN 'EXCELLENT' WHEN n_warnings <= 2 THEN 'GOOD' ELSE 'FAIR' END AS quality FROM graded"""


RAW_SALES = "sold AS (SELECT o_custkey AS customer_key, l_partkey AS product_key, l_extendedprice AS sales FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
LEVELS = "(VALUES (3), (4), (5)) AS levels(level)"

ORACLES = {
    "csv_round_trip": """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 97 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment,
 c_custkey % 97 = 0 AS damaged FROM customer""",
    "interactions": f"WITH {INTER} SELECT customer_key, product_key, round(rating, 6) AS rating, timestamp FROM inter",
    "product_prep": f"""SELECT p_partkey AS product_key, p_name AS product_name, p_type AS category, p_brand AS sub_category,
 round(coalesce(p_retailprice, (SELECT median(p_retailprice) FROM part)), 6) AS cost, coalesce(p_name, '') || ' ' || coalesce(p_type, '') || ' ' || coalesce(p_brand, '') AS product_description,
 {_onehot('p_type', 'category', TYPES)}, {_onehot('p_brand', 'sub_category', BRANDS)} FROM part""",
    "customer_prep": f"""SELECT c_custkey AS customer_key, r_name AS country, {_onehot('r_name', 'country', REGIONS)}
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "user_features_join": """SELECT c_custkey AS customer_key, n_name AS country, r_name AS region, c_acctbal AS balance
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "item_features_join": "SELECT p_partkey AS product_key, p_name AS product_name, p_type AS category, p_brand AS sub_category, p_retailprice AS cost, p_size AS size FROM part",
    "null_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM documents" for c in DOCUMENT_COLUMNS),
    "sampled_interactions": f"""WITH {INTER}, hashed AS (SELECT c_custkey, row_number() OVER (ORDER BY {sql_hash(42, 'c_custkey')}, c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT customer_key, product_key, round(rating, 6) AS rating, timestamp FROM inter WHERE customer_key IN (SELECT c_custkey FROM hashed WHERE r <= round_even(n * 0.25, 0))""",
    "id_map": f"WITH {INTER} " + " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {k} AS id, row_number() OVER (ORDER BY {sql_hash(0, k)}, {k}) - 1 AS position FROM (SELECT DISTINCT {k} FROM inter)" for k, kind in ((U, "user"), (I, "item"))
    ),
    "interaction_matrix": f"WITH {MATRIX} SELECT customer_key, product_key, round(value, 6) AS value FROM cells",
    "interaction_counts": f"WITH {RAW_SALES} SELECT customer_key, product_key, CAST(count(*) AS DOUBLE) AS value FROM sold GROUP BY 1, 2",
    "matrix_centered": f"""WITH {MATRIX}, means AS (SELECT customer_key, sum(value) / (SELECT count(DISTINCT product_key) FROM cells) AS m FROM cells GROUP BY 1)
SELECT customer_key, product_key, round(value - m, 6) AS value, round(m, 6) AS user_mean FROM cells JOIN means USING (customer_key)""",
    "matrix_pivot": f"""WITH {INTER} SELECT customer_key, {', '.join(f"round(coalesce(avg(rating) FILTER (p_type = '{t}'), 0.0), 6) AS \"{t}\"" for t in TYPES)}
FROM inter JOIN part ON product_key = p_partkey GROUP BY 1""",
    "matrix_sparsity": f"""WITH {MATRIX} SELECT count(DISTINCT customer_key) AS n_users, count(DISTINCT product_key) AS n_items, count(*) FILTER (value <> 0) AS n_nonzero,
 round(100 - 100.0 * count(*) FILTER (value <> 0) / (count(DISTINCT customer_key) * count(DISTINCT product_key)), 6) AS sparsity_pct FROM cells""",
    "sparsity_analysis": f"""WITH {INTER}, {_spread('customer_key', 'user')}, {_spread('product_key', 'item')}, total AS (SELECT count(*) AS n_rows FROM inter),
wide AS (SELECT *, CAST(n_rows AS DOUBLE) / (n_users * n_items) AS density FROM total, user, item)
SELECT * REPLACE (round(user_mean, 6) AS user_mean, round(item_mean, 6) AS item_mean, round(users_under_5_pct, 6) AS users_under_5_pct, round(items_under_5_pct, 6) AS items_under_5_pct, round(density, 6) AS density),
 round(1 - density, 6) AS sparsity,
 CASE WHEN 1 - density > 0.995 THEN 'extremely sparse' WHEN 1 - density > 0.98 THEN 'very sparse' WHEN 1 - density > 0.95 THEN 'sparse' ELSE 'moderately sparse' END AS verdict FROM wide""",
    "user_behavior": f"WITH {INTER} SELECT *, {ACTIVITY} AS activity FROM (SELECT customer_key, {PER_KEY} FROM inter GROUP BY 1)",
    "activity_bins": f"WITH {INTER} SELECT {ACTIVITY} AS activity, count(*) AS n_keys FROM (SELECT count(*) AS n FROM inter GROUP BY customer_key) GROUP BY 1",
    "activity_describe": f"WITH {INTER} SELECT {_describe('n')} FROM (SELECT count(*) AS n FROM inter GROUP BY customer_key)",
    "activity_histogram": f"""WITH {INTER}, per AS (SELECT count(*) AS n FROM inter GROUP BY customer_key), e AS (SELECT min(n) AS lo, (max(n) - min(n)) / 50.0::DOUBLE AS w FROM per)
SELECT bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, n FROM
 (SELECT CAST(CASE WHEN w > 0 THEN least(floor((n - lo) / w), 49) ELSE 0 END AS INT) AS bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS n FROM per CROSS JOIN e GROUP BY 1)""",
    "events_hourly": "SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1",
    "events_weekday": "SELECT dayname(ts) AS weekday, count(*) AS n FROM events GROUP BY 1",
    "session_span": "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(ts) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours FROM events GROUP BY 1",
    "item_popularity": f"WITH {INTER} SELECT *, {POPULARITY} AS popularity FROM (SELECT product_key, {PER_KEY} FROM inter GROUP BY 1)",
    "popularity_bins": f"WITH {INTER} SELECT {POPULARITY} AS popularity, count(*) AS n_keys FROM (SELECT count(*) AS n FROM inter GROUP BY product_key) GROUP BY 1",
    "item_pareto": f"""WITH {INTER}, per AS (SELECT product_key, count(*) AS n FROM inter GROUP BY 1),
run AS (SELECT sum(n) OVER (ORDER BY n DESC, product_key ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS total FROM per)
SELECT count(*) FILTER (5 * c <= 4 * total) AS n_head, count(*) AS n_items, round(100.0 * count(*) FILTER (5 * c <= 4 * total) / count(*), 6) AS head_pct FROM run""",
    "validate_dataset": f"WITH {INTER}, {_validation('inter', True)}",
    "validate_raw_sales": f"WITH {RAW_SALES}, {_validation('sold', False)}",
    "dataset_stats": f"""WITH {MATRIX}, m AS (SELECT count(DISTINCT customer_key) AS matrix_users, count(DISTINCT product_key) AS matrix_items, count(*) FILTER (value <> 0) AS n_nonzero FROM cells),
wide AS (SELECT (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM part) AS n_products, (SELECT count(*) FROM inter) AS n_sales, * FROM m)
SELECT *, round(100 - 100.0 * n_nonzero / (matrix_users * matrix_items), 6) AS sparsity_pct, round(CAST(n_sales AS DOUBLE) / (n_customers * n_products), 6) AS density FROM wide""",
    "segment_members": "SELECT DISTINCT c_mktsegment AS segment, c_custkey AS customer_key FROM customer WHERE c_mktsegment <> ''",
    "segment_shares": "SELECT c_mktsegment AS cust_segmentation, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1",
    "eda_thresholds": f"""WITH {INTER}, per AS (SELECT 'user' AS key, count(*) AS n FROM inter GROUP BY customer_key UNION ALL SELECT 'item', count(*) FROM inter GROUP BY product_key)
SELECT key, CAST(level AS INT) AS level, count(*) FILTER (n < level) AS under, count(*) FILTER (n >= level) AS at_least, round(100.0 * count(*) FILTER (n < level) / count(*), 6) AS under_pct
FROM per CROSS JOIN {LEVELS} GROUP BY key, level""",
    "eda_totals": f"""WITH {RAW_SALES} SELECT count(*) AS n_rows, count(DISTINCT customer_key) AS n_users, count(DISTINCT product_key) AS n_items, CAST(sum(CAST(sales AS DECIMAL(28, 6))) AS DOUBLE) AS sales_sum, round(avg(sales), 6) AS sales_mean,
 round(CAST(count(*) AS DOUBLE) / count(DISTINCT customer_key), 6) AS purchases_mean FROM sold""",
}
