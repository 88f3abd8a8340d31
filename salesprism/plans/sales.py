"""The typed sales table, from the warehouse tables or from a tidy table with known roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.functions.cleaning import named, to_datetime, to_labels, to_numeric, to_text

DIMENSIONS = ("channel", "region", "category", "payment_method")


#: Columns of the view by the tables they need beside the lines.
FROM_ORDERS = ("date", "customer_id", "channel")
FROM_PARTS = ("product", "cost", "profit", "category")
FROM_CUSTOMERS, FROM_REGIONS = ("group_segment",), ("region",)
EVERY_COLUMN = ("date", "product", "revenue", "quantity", "unit_price", "discount", "cost", "profit", "order_id", "customer_id", "channel", "region", "category", "group_segment")


def sales_view(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = EVERY_COLUMN) -> DataFrame:
    """Sales of the star schema with the columns asked for; only tables that have one of them are joined, and keys are never without a match.

    Adaptive execution broadcasts dimension tables that are small. The view knows where its dates are found with the least to read.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wants = lambda group: bool(set(columns) & set(group))
    lines = t("lineitem")
    if wants((*FROM_ORDERS, *FROM_CUSTOMERS, *FROM_REGIONS)):
        orders = t("orders")
        if wants((*FROM_CUSTOMERS, *FROM_REGIONS)):
            customers = t("customer")
            if wants(FROM_REGIONS):
                geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
                customers = customers.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if wants(FROM_PARTS):
        lines = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    cost = F.col("l_quantity") * F.col("p_retailprice")
    values = {
        "date": F.to_date("o_orderdate"), "product": F.col("p_type"), "revenue": F.col("l_extendedprice"), "quantity": F.col("l_quantity"), "unit_price": F.try_divide("l_extendedprice", F.nullif("l_quantity", F.lit(0.0))),
        "discount": F.col("l_discount"), "cost": cost, "profit": F.col("l_extendedprice") - cost, "order_id": F.col("l_orderkey").cast("string"), "customer_id": F.col("o_custkey").cast("string"), "channel": F.col("o_orderpriority"),
        "region": F.col("r_name"), "category": F.col("p_brand"), "group_segment": F.col("c_mktsegment"),
    }
    out = lines.select(*[values[c].alias(c) for c in columns])
    out.dates = t("orders").join(t("lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.to_date("o_orderdate").alias("date"))
    return out


def build_sales(tidy: DataFrame, roles: dict[str, str], cost_basis: str = "per_unit") -> DataFrame:
    """The sales table of a tidy table of texts; roles: role -> column. Rows without date, product or revenue are left out."""
    if "revenue" not in roles and not {"quantity", "unit_price"} <= roles.keys():
        raise ValueError("revenue is neither a column nor quantity times unit price")
    df = to_datetime(tidy, roles["date"], "_date")
    df = to_labels(df, roles["product"], "_product")
    for role in ("revenue", "quantity", "unit_price", "cost", "discount"):
        if role in roles:
            df = to_numeric(df, roles[role], f"_{role}")
    for role in DIMENSIONS:
        if role in roles:
            df = to_labels(df, roles[role], f"_{role}")
    have = lambda r: F.col(f"_{r}") if r in roles else F.lit(None).cast("double")
    quantity = have("quantity")
    revenue = have("revenue") if "revenue" in roles else quantity * have("unit_price")
    price = have("unit_price") if "unit_price" in roles else F.try_divide(revenue, F.nullif(quantity, F.lit(0.0)))
    cost = have("cost") * quantity if cost_basis == "per_unit" and "quantity" in roles else have("cost")
    names = {c: F.col(f"_{c}") for c in DIMENSIONS if c in roles}
    ids = {c: to_text(named(roles[c])) for c in ("customer_id", "order_id") if c in roles}
    groups = {f"group_{v}": to_text(named(v)) for k, v in roles.items() if k.startswith("group_by")}
    out = df.select(F.col("_date").alias("date"), F.col("_product").alias("product"), revenue.alias("revenue"), quantity.alias("quantity"), price.alias("unit_price"), have("discount").alias("discount"), cost.alias("cost"), (revenue - cost).alias("profit"), *[c.alias(k) for k, c in (ids | names | groups).items()])
    return out.dropna(subset=["date", "product", "revenue"]).where(F.trim("product") != "")
