"""Purchase-history views over the given tables, in Spark and in SQL."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartwheel.functions.stage import cut, stage_path
from cartwheel.operators import features as X, prepare as P

TRAIN_START, VALID_START, VALID_END = "2001-07-19", "2001-07-26", "2001-08-01"
FORECAST_AFTER = "1995-06-01"

# fixed values: stand-ins for the article categories and the named index groups
CATEGORIES = ["product_type_name", "product_group_name", "perceived_colour_master_name",
              "department_name", "index_group_name", "section_name", "garment_group_name"]
GROUPS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENT_COLUMNS = ["FN", "Active", "club_member_status", "fashion_news_frequency", "age10", "customer_type"]


def r6(column) -> Column:
    """Six decimals by plain arithmetic, the same steps as in the SQL (library rounding differs at ties)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * 1e6 + 0.5) / 1e6


def q6(expression: str) -> str:
    return f"floor(({expression}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


# (application, folder) -> customers with their segment codes
_prepared: dict[tuple[str, str], DataFrame] = {}


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def transactions(self) -> DataFrame:
        """Spread by the join key before the row work: the file may be a single split."""
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_linestatus").repartition("l_orderkey")
        lines = lines.select(
            "l_orderkey", F.lpad(F.col("l_partkey").cast("string"), 10, "0").alias("article_id"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("sales_channel_id"))
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("t_dat"),
            F.col("o_custkey").cast("string").alias("customer_id"))
        return lines.join(orders, "l_orderkey").select(
            "t_dat", "customer_id", "article_id", "price", "sales_channel_id")

    @property
    def articles(self) -> DataFrame:
        word = lambda i: F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))
        return self.table("part").select(
            F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("article_id"), F.col("p_name").alias("prod_name"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("detail_desc"),
            F.col("p_type").alias("index_group_name"), F.col("p_type").alias("product_group_name"),
            F.col("p_brand").alias("department_name"), word(1).alias("perceived_colour_master_name"),
            word(2).alias("product_type_name"), F.col("p_size").cast("string").alias("section_name"),
            F.concat_ws("/", "p_brand", "p_type").alias("garment_group_name"))

    @property
    def raw_customers(self) -> DataFrame:
        nation, key = F.col("c_nationkey"), F.col("c_custkey")
        return self.table("customer").select(
            key.cast("string").alias("customer_id"),
            F.when(nation % 3 == 0, 1.0).alias("FN"), F.when(nation % 4 == 0, 1.0).alias("Active"),
            F.col("c_mktsegment").alias("club_member_status"),
            F.when(nation % 3 == 0, "Regularly").when(nation % 3 == 1, "NONE").otherwise("None").alias("fashion_news_frequency"),
            F.when(key % 37 != 0, 16.0 + key % 70).alias("age"), nation.cast("string").alias("postal_code"))

    @property
    def customers(self) -> DataFrame:
        """Prepared once a session, as the plans do, and kept as a table."""
        at = (self.spark.sparkContext.applicationId, self.folder)
        if at not in _prepared:
            clean = P.normalise_value(self.raw_customers, "fashion_news_frequency", "None", "NONE")
            _prepared[at] = cut(P.customer_segment(clean).drop("segment"))
        return _prepared[at]

    @property
    def wide(self) -> DataFrame:
        return P.denormalise(self.transactions, self.customers, self.articles)

    def wide_with(self, customer_cols=(), article_cols=()) -> DataFrame:
        rows = self.transactions
        if customer_cols:
            rows = P.denormalise(rows, self.customers, self.articles, list(customer_cols), [])
        if article_cols:
            rows = rows.join(self.articles.select("article_id", *article_cols), "article_id", "left")
        return rows

    @property
    def forecast(self) -> DataFrame:
        """First-week counts stand in for a forecast."""
        sales = X.first_week_sales(self.transactions, FORECAST_AFTER)
        return sales.select("article_id", "1st_week_sales_dat",
                            F.col("1st_week_sales").cast("double").alias("1st_week_sales_pred"))

    def history(self, frame: DataFrame | None = None, end: str = VALID_START) -> DataFrame:
        return P.holdout(self.transactions if frame is None else frame, end)[0]

    def target(self, frame: DataFrame | None = None) -> DataFrame:
        return P.holdout(self.transactions if frame is None else frame, VALID_START, VALID_END)[1]

    def scratch(self, name: str) -> str:
        """A new folder under the shared checkpoint folder."""
        return stage_path(self.spark, name)


# ---- the same views as SQL ------------------------------------------------------------

_CTES = {
    "tx": ([], """
        SELECT CAST(o_orderdate AS DATE) AS t_dat, CAST(o_custkey AS VARCHAR) AS customer_id,
               lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS article_id, l_extendedprice / l_quantity AS price,
               CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS sales_channel_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "art": ([], """
        SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS article_id, p_name AS prod_name,
               concat(p_name, ' ', p_brand, ' ', p_type) AS detail_desc,
               p_type AS index_group_name, p_type AS product_group_name, p_brand AS department_name,
               split_part(p_name, ' ', 1) AS perceived_colour_master_name,
               split_part(p_name, ' ', 2) AS product_type_name,
               CAST(p_size AS VARCHAR) AS section_name, concat(p_brand, '/', p_type) AS garment_group_name
        FROM part"""),
    "raw_cust": ([], """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
               CASE WHEN c_nationkey % 3 = 0 THEN 1.0::DOUBLE END AS "FN",
               CASE WHEN c_nationkey % 4 = 0 THEN 1.0::DOUBLE END AS "Active",
               c_mktsegment AS club_member_status,
               CASE c_nationkey % 3 WHEN 0 THEN 'Regularly' WHEN 1 THEN 'NONE' ELSE 'None' END AS fashion_news_frequency,
               CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE 16.0::DOUBLE + c_custkey % 70 END AS age,
               CAST(c_nationkey AS VARCHAR) AS postal_code
        FROM customer"""),
    "cust10": (["raw_cust"], """
        SELECT * REPLACE (replace(fashion_news_frequency, 'None', 'NONE') AS fashion_news_frequency),
               CAST(floor(age / 10) * 10 AS INTEGER) AS age10
        FROM raw_cust"""),
    "seg_text": (["cust10"], """
        SELECT c.*, concat(CAST(coalesce("FN", 0) AS INTEGER), CAST(coalesce("Active", 0) AS INTEGER),
               dense_rank() OVER (ORDER BY coalesce(club_member_status, '')) - 1,
               dense_rank() OVER (ORDER BY coalesce(fashion_news_frequency, '')) - 1,
               dense_rank() OVER (ORDER BY coalesce(CAST(age10 AS VARCHAR), '')) - 1) AS segment
        FROM cust10 c"""),
    "cust": (["seg_text"], """
        SELECT * EXCLUDE (segment), CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INTEGER) AS customer_type
        FROM seg_text"""),
    "wide": (["tx", "cust", "art"], """
        SELECT tx.*, cust.* EXCLUDE (customer_id), art.* EXCLUDE (article_id)
        FROM tx LEFT JOIN cust USING (customer_id) LEFT JOIN art USING (article_id)"""),
    "fws": (["tx"], f"""
        SELECT article_id, f AS "1st_week_sales_dat", count(*) AS "1st_week_sales"
        FROM (SELECT *, min(t_dat) OVER (PARTITION BY article_id) AS f FROM tx)
        WHERE f > DATE '{FORECAST_AFTER}' AND t_dat - f <= 7 GROUP BY 1, 2"""),
    "fc": (["fws"], """
        SELECT article_id, "1st_week_sales_dat", CAST("1st_week_sales" AS DOUBLE) AS "1st_week_sales_pred" FROM fws"""),
    "hist": (["tx"], f"SELECT * FROM tx WHERE t_dat < DATE '{VALID_START}'"),
    "hist_wide": (["wide"], f"SELECT * FROM wide WHERE t_dat < DATE '{VALID_START}'"),
    "targ": (["tx"], f"SELECT * FROM tx WHERE t_dat BETWEEN DATE '{VALID_START}' AND DATE '{VALID_END}'"),
    "truth": (["targ"], "SELECT DISTINCT customer_id, article_id FROM targ"),
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the named views, and any further CTEs, in front of it."""
    order: list[str] = []

    def need(name: str) -> None:
        for parent in _CTES[name][0]:
            need(parent)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


# fixed values: SQL of a window's first day before the last day of a relation
_SHIFT = {"1w": "INTERVAL 7 DAY", "1m": "INTERVAL 1 MONTH", "1y": "INTERVAL 12 MONTH"}


def since(window: str, relation: str) -> str:
    """WHERE condition of a trailing window."""
    if window == "all":
        return "TRUE"
    return f"t_dat >= CAST((SELECT max(t_dat) FROM {relation}) - {_SHIFT[window]} AS DATE)"
