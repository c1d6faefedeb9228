"""Schemas of the base tables.

Ids stay strings: article ids carry leading zeros that inference would drop.
"""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: categorical columns of the article table
ARTICLE_CATEGORIES = [
    "product_type_name", "product_group_name", "graphical_appearance_name",
    "colour_group_name", "perceived_colour_value_name", "perceived_colour_master_name",
    "department_name", "index_name", "index_group_name", "section_name", "garment_group_name",
]

# fixed values: customer columns that describe a customer segment
CUSTOMER_CATEGORIES = [
    "FN", "Active", "club_member_status", "fashion_news_frequency", "age10", "customer_type",
]

# text columns that models read as categories; other text is close to an id
MODEL_CATEGORIES = [*ARTICLE_CATEGORIES, "club_member_status", "fashion_news_frequency"]

TRANSACTIONS = T.StructType([
    T.StructField("t_dat", T.DateType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("sales_channel_id", T.IntegerType()),
])

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("FN", T.DoubleType()),
    T.StructField("Active", T.DoubleType()),
    T.StructField("club_member_status", T.StringType()),
    T.StructField("fashion_news_frequency", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("postal_code", T.StringType()),
])

FORECAST = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("1st_week_sales_dat", T.DateType()),
    T.StructField("1st_week_sales_pred", T.DoubleType()),
])

SUBMISSION = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("prediction", T.StringType()),
])

OOF = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("pred", T.DoubleType()),
])
