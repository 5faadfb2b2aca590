"""The retail pack: customers, products, orders and items that reconcile to the last unit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions import keyed, money
from facsimile.operators import domains, ordered, scale
from facsimile.plans.contract import Column, Contract, Relationship, Rule, Table
from facsimile.sources import locales

# Weights, ranges and first ids of the pack.
STATUS_WEIGHTS = {"delivered": .82, "cancelled": .08, "returned": .04, "pending": .06}
SEGMENT_WEIGHTS = {"regular": .70, "loyal": .25, "vip": .05}
CATEGORIES = ["Electronics", "Home", "Fashion", "Grocery", "Beauty", "Sports", "Books", "Toys", "Health", "Garden"]
DISCOUNTS = {"vip": "0.10", "loyal": "0.05"}
PRICE_LOG_MEAN, PRICE_LOG_SD, PRICE_LOW, PRICE_HIGH = 8.0, 0.9, 199, 500_000
FIRST_CUSTOMER, FIRST_ORDER, FIRST_ITEM = 10_001, 500_001, 9_000_001
POPULARITY = 0.8


def days_between(start: str, end: str) -> int:
    return max((domains.parse_day(end) - domains.parse_day(start)).days, 1)


def customers(spark: SparkSession, n: int, seed: int = 42, start: str = "2023-01-01", end: str = "2025-12-31",
              city_weights: Mapping[str, float] | None = None, locale: str = "pk", people: DataFrame | None = None) -> DataFrame:
    """``people`` (customer_id) may give the customers; else there are ``n`` new ones."""
    pack = locales.pack(locale)
    base = people.select("customer_id") if people is not None else \
        spark.range(n).select((F.col("id") + FIRST_CUSTOMER).alias("customer_id"))

    def u(path: str, lane: int = 0):
        return keyed.uniform(seed, "customers", path, key="customer_id", lane=lane)

    names = pack["names"]
    first = F.when(u("name") < 0.5, keyed.choice(u("name", 1), names["male"])).otherwise(
        keyed.choice(u("name", 1), names["female"]))
    base = base.select("customer_id", first.alias("first"), keyed.choice(u("name", 2), names["family"]).alias("last"),
                       keyed.weighted_choice(u("traits"), dict(city_weights or pack["cities"])).alias("city"),
                       F.date_add(F.lit(start).cast("date"),
                                  keyed.uniform_int(u("traits", 1), 0, days_between(start, end) + 1).cast("int"))
                       .alias("signup_date"),
                       keyed.weighted_choice(u("traits", 2), SEGMENT_WEIGHTS).alias("segment"))
    email = F.concat(F.lower(F.col("first")), F.lit("."), F.lower(F.regexp_replace("last", " ", "")),
                     F.col("customer_id").cast("string"), F.lit("@" + pack["email_domain"]))
    return base.select("customer_id", F.concat_ws(" ", "first", "last").alias("full_name"), email.alias("email"),
                       "city", "signup_date", "segment")


def products(spark: SparkSession, n: int = 60, seed: int = 42, goods: DataFrame | None = None) -> DataFrame:
    """``goods`` (product_no from the most popular on, unit_price) may give the products; else there
    are ``n`` new ones with drawn prices."""
    base = goods if goods is not None else spark.range(1, n + 1).withColumnRenamed("id", "product_no")

    def u(path: str, lane: int = 0):
        return keyed.uniform(seed, "products", path, key="product_no", lane=lane)

    return base.select(
        ordered.format_id("product_no", "SKU-", 4).alias("sku"),
        F.concat_ws(" ", keyed.choice(u("name"), domains.FIRST_WORDS), keyed.choice(u("name", 1), domains.SECOND_WORDS))
        .alias("name"),
        keyed.choice(u("name", 2), CATEGORIES).alias("category"),
        (F.col("unit_price").cast("bigint") if goods is not None else
         keyed.lognormal(u("price"), u("price", 1), PRICE_LOG_MEAN, PRICE_LOG_SD, PRICE_LOW, PRICE_HIGH))
        .alias("unit_price"), "product_no")


def order_heads(cust: DataFrame, n_customers: int | None, seed: int = 42, mean_orders: float = 3.2, dispersion: float = 1.4,
                end: str = "2025-12-31", status_weights: Mapping[str, float] | None = None, most: int | None = None) -> DataFrame:
    """One row per order (``most`` a customer, if given), dated between signup and the end of the period by construction."""
    cuts = keyed.negbin_cdf(mean_orders, dispersion, most)
    n = keyed.draw_count(keyed.uniform(seed, "orders", "count", key="customer_id"), cuts)
    counted = cust.select("customer_id", "signup_date", "segment", n.cast("bigint").alias("n"))
    placed = ordered.running(counted, ["customer_id"], sums={"upto": "n"}, rows=n_customers)
    rows = domains.fan_out(placed, F.col("n").cast("int"))
    rows = rows.withColumn("order_id", F.col("upto") - F.col("n") + F.col("seq") + F.lit(FIRST_ORDER - 1))

    def u(lane: int):
        return keyed.uniform(seed, "orders", key="order_id", lane=lane)

    room = F.greatest(F.datediff(F.lit(end).cast("date"), F.col("signup_date")), F.lit(0))
    return rows.select(
        "order_id", "customer_id", "segment",
        F.date_add("signup_date", F.floor(u(0) * (room + 1).cast("double")).cast("int")).alias("order_date"),
        keyed.weighted_choice(u(1), dict(status_weights or STATUS_WEIGHTS)).alias("status"))


def order_items(heads: DataFrame, prods: DataFrame, seed: int = 42) -> DataFrame:
    """One to five lines per order; popular products are picked more often."""
    count = keyed.uniform_int(keyed.uniform(seed, "items", "count", key="order_id"), 1, 6)
    placed = ordered.running(heads.select("order_id", count.alias("n")), ["order_id"], sums={"upto": "n"})
    rows = domains.fan_out(placed, F.col("n").cast("int"))
    rows = rows.select((F.col("upto") - F.col("n") + F.col("seq") + F.lit(FIRST_ITEM - 1)).alias("item_id"), "order_id")

    def u(lane: int):
        return keyed.uniform(seed, "items", key="item_id", lane=lane)

    price = prods.select("product_no", "sku", "unit_price")
    line = domains.spans(domains.zipf_domain(price, "product_no", POPULARITY), "weight", ["product_no"])
    rows = domains.draw_from_spans(rows, u(0), line, ["product_no", "sku", "unit_price"])
    qty = keyed.uniform_int(u(1), 1, 5)
    return rows.select("item_id", "order_id", "sku", qty.cast("int").alias("quantity"), "unit_price",
                       money.mul("unit_price", qty).alias("line_total"))


def price_orders(heads: DataFrame, items: DataFrame, tax_rate: str = "0.18") -> DataFrame:
    """Sub-totals, segment discount, tax on the net, all half-even in minor units."""
    sums = items.groupBy("order_id").agg(F.sum("line_total").alias("subtotal"))
    o = heads.join(sums, "order_id", "left").withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast("bigint")))
    disc = F.lit(0).cast("bigint")
    for segment, rate in DISCOUNTS.items():
        disc = F.when(F.col("segment") == segment, money.pct_of("subtotal", rate)).otherwise(disc)
    o = o.withColumn("discount", disc)
    o = o.withColumn("tax", money.pct_of(F.col("subtotal") - F.col("discount"), tax_rate))
    return o.select("order_id", "customer_id", "order_date", "status", "subtotal", "discount", "tax",
                    (F.col("subtotal") - F.col("discount") + F.col("tax")).alias("total"))


def generate_retail(spark: SparkSession, seed: int = 42, n_customers: int = 1000, n_products: int = 60,
                    mean_orders: float = 3.2, dispersion: float = 1.4, tax_rate: str = "0.18",
                    start: str = "2023-01-01", end: str = "2025-12-31",
                    status_weights: Mapping[str, float] | None = None,
                    city_weights: Mapping[str, float] | None = None, locale: str = "pk",
                    people: DataFrame | None = None, goods: DataFrame | None = None) -> dict[str, DataFrame]:
    """Four tables with full referential integrity; every total is computed, never drawn.  Customers
    and products may be given (see ``customers`` and ``products``)."""
    cust = customers(spark, n_customers, seed, start, end, city_weights, locale, people)
    prods = products(spark, n_products, seed, goods)
    # heads and items are read several times below: each is drawn once
    heads = scale.cut(order_heads(cust, None if people is not None else n_customers, seed, mean_orders, dispersion, end, status_weights))
    items = scale.cut(order_items(heads, prods, seed))
    return {"customers": cust, "products": prods.drop("product_no"),
            "orders": price_orders(heads, items, tax_rate), "order_items": items}


def retail_contract() -> Contract:
    def money_cols(*names: str) -> tuple[Column, ...]:
        return tuple(Column(n, "money", nullable=False) for n in names)

    return Contract("retail_demo", (
        Table("customers", (
            Column("customer_id", "id", start=FIRST_CUSTOMER),
            Column("full_name", "text", False, pii="direct", privacy_action="synthetic"),
            Column("email", "email", False, pii="direct", privacy_action="synthetic"),
            Column("city", "cat", weights=locales.CITIES["pk"]), Column("signup_date", "date", False),
            Column("segment", "cat", False, weights=SEGMENT_WEIGHTS)), 1000, "customer_id"),
        Table("products", (
            Column("sku", "id", text_key=True), Column("name", "text", False),
            Column("category", "cat", False, weights={c: 1.0 for c in CATEGORIES}),
            *money_cols("unit_price")), 60, "sku"),
        Table("orders", (
            Column("order_id", "id", start=FIRST_ORDER),
            Column("customer_id", "fk", False, ref="customers.customer_id"), Column("order_date", "date", False),
            Column("status", "cat", False, weights=STATUS_WEIGHTS),
            *money_cols("subtotal", "discount", "tax", "total")), primary_key="order_id"),
        Table("order_items", (
            Column("item_id", "id", start=FIRST_ITEM), Column("order_id", "fk", False, ref="orders.order_id"),
            Column("sku", "fk", False, ref="products.sku", text_key=True), Column("quantity", "int", False),
            *money_cols("unit_price", "line_total")), primary_key="item_id")),
        (Relationship("customers", "orders", mean_children=3.2, dispersion=1.4),
         Relationship("orders", "order_items", mean_children=2.5, dispersion=1.0, min_children=1, max_children=5),
         Relationship("products", "order_items")),
        (Rule("line_total_calc", "order_items.line_total == order_items.quantity * order_items.unit_price"),
         Rule("subtotal_rollup", "orders.subtotal == sum(order_items.line_total by order_id)"),
         Rule("total_formula", "orders.total == orders.subtotal - orders.discount + orders.tax"),
         Rule("total_positive", "orders.total >= 0", "warn")),
        locale="pk", currency="PKR", domain="retail")
