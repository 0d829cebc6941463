"""E-commerce order consolidation (W3).

customers ⟕ first geolocation per zip prefix ⟕ state names;
orders (parsed timestamps, period labels, delivery delay and its class)
⟕ per-order item totals; the two joined on the customer id into one wide
table.  Scans run in parallel; the per-order aggregate is hash-partitioned
by ``order_id`` and that partitioning serves the join with the orders
(adaptive execution broadcasts the totals instead when they are measured
small); the first geolocation per zip prefix is written once and, like the
state list, broadcast after a row-count check, so the customer table is not
shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessel.functions import dates
from tessel.operators import aggregate, dedup, joins
from tessel.session import materialize

TIMESTAMP_COLUMNS = ["order_purchase_timestamp", "order_approved_at",
                     "order_delivered_carrier_date", "order_delivered_customer_date",
                     "order_estimated_delivery_date"]


def item_totals(items: DataFrame) -> DataFrame:
    """AGG4 + PRJ3: per order, number of items and sum of their prices."""
    return aggregate.count_and_sum_by(items, "order_id", "order_item_id", "price",
                                      "total_products", "total_sales")


def order_dates(orders: DataFrame, fmt: str | None = None,
                columns=TIMESTAMP_COLUMNS) -> DataFrame:
    """SC2-SC5: parse the timestamp columns (bad -> NULL) and label the purchase period."""
    parsed = orders.withColumns({c: dates.parse_timestamp(c, fmt) for c in columns
                                 if c in orders.columns})
    p = "order_purchase_timestamp"
    return parsed.withColumns({
        "year": dates.year(p),
        "month": dates.month(p),
        "quarter": dates.quarter_label(p),
        "year_month": dates.month_label(p),
    })


def order_delay(orders: DataFrame, long_after: float = 3.0, on_time_upto: float = 0.0,
                missing_label: str | None = None) -> DataFrame:
    """SC6 + SC7: days delivered after the estimate, and the delay class.

    Orders never delivered have no delay and fall in ``short_delay`` unless
    ``missing_label`` is given (S2).
    """
    delta = dates.days_between("order_delivered_customer_date", "order_estimated_delivery_date")
    out = orders.withColumn("delta_days", delta)
    return out.withColumn("delay_status",
                          dates.delay_class("delta_days", long_after, on_time_upto, missing_label))


def unique_geolocations(geo: DataFrame, order="line_no",
                        key: str = "geolocation_zip_code_prefix") -> DataFrame:
    """SET3: the first geolocation row per zip prefix, in the order of ``order``."""
    return dedup.first_per_key(geo, key, order)


def customers_with_state(customers: DataFrame, geo_unique: DataFrame, states: DataFrame,
                         null_safe: bool = False) -> DataFrame:
    """JN3 + JN4: customers ⟕ geolocation (zip prefix, as text) ⟕ state names.

    ``null_safe`` lets a missing state match a missing abbreviation, as the
    pandas merge does (S4).
    """
    # one row per zip prefix: written once, then broadcast if its row count is within the
    # bound (a cheap check on the written table), so the customer table is not shuffled
    geo_unique = materialize(geo_unique, "geo-first")
    cg = joins.left_join(customers, geo_unique, left_on="customer_zip_code_prefix",
                         right_on="geolocation_zip_code_prefix")
    return joins.left_join(cg, states, left_on="geolocation_state", right_on="abbreviation",
                           null_safe=null_safe)


def consolidate_orders(orders: DataFrame, items: DataFrame, customers: DataFrame,
                       geolocations: DataFrame, states: DataFrame, geo_order="line_no",
                       timestamp_format: str | None = None,
                       missing_label: str | None = None) -> DataFrame:
    """W3: one wide table of orders with item totals, delay and customer location."""
    totals = item_totals(items)
    prepared = order_delay(order_dates(orders, timestamp_format), missing_label=missing_label)
    orders_totals = joins.left_join(prepared, totals, on="order_id", broadcast_max_rows=None)
    geo = unique_geolocations(geolocations, geo_order)
    if isinstance(geo_order, str):
        geo = geo.drop(geo_order)  # only told the first row per zip prefix
    cust = customers_with_state(customers, geo, states)
    return joins.left_join(orders_totals, cust, on="customer_id", broadcast_max_rows=None)
