"""Flight enrichment, global metrics and route analysis (W1, W2, W5).

Shape of the plan: scan -> prune -> lenient date parse -> two broadcast
left joins with the airport dimension (size-checked) -> not-null filter,
which turns both outer joins into inner ones.  The route analysis computes
the tables behind the route dashboard for *every* (year, month) at once,
keyed by ``Year, Month``; a single selection is a filter on those keys,
which prunes partitions when the enriched table is written partitioned by
them (:func:`write_enriched`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import dates, scalars
from tessel.operators import aggregate, clean, dedup, joins, ordering
from tessel.session import materialize

# Column names and labels of the dashboard tables.
FLIGHT_RENAMES = {"Origin": "IATA_ORIGIN", "Dest": "IATA_DEST",
                  "Reporting_Airline": "AIRLINE"}
DAILY_COUNT = "vuelos"
ROUTE_LABEL = "Ruta"
ROUTE_SEPARATOR = " → "
ROUTE_KEYS = ["IATA_ORIGIN", "OriginLat", "OriginLon", "IATA_DEST", "DestLat", "DestLon",
              "AIRLINE"]
MONTH = ["Year", "Month"]
ENRICHED_COLUMNS = ["FlightDate", "Year", "Month", "IATA_ORIGIN", "IATA_DEST", "AIRLINE",
                    "OriginLat", "OriginLon", "DestLat", "DestLon"]


def load_airports(raw: DataFrame) -> DataFrame:
    """PRJ2 + SC18 + FLT1: airport code and coordinates; rows without a code dropped."""
    out = clean.select_cast(raw, {"IATA": "string", "Latitude": "double",
                                  "Longitude": "double"})
    return clean.not_null(out, "IATA")


def enrich_flights(flights: DataFrame, airports: DataFrame, date_format: str | None = None,
                   broadcast_max_rows: int | None = joins.BROADCAST_MAX_ROWS) -> DataFrame:
    """W1: flights with parsed date, year, month and origin / destination coordinates.

    Flights whose date does not parse or whose airports lack coordinates are
    dropped.  ``airports`` must have ``IATA, Latitude, Longitude``.
    """
    df = clean.rename(flights.select("FlightDate", "Reporting_Airline", "Origin", "Dest"),
                      FLIGHT_RENAMES)
    df = df.withColumn("FlightDate", dates.parse_date("FlightDate", date_format))
    df = df.withColumns({"Year": dates.year("FlightDate"), "Month": dates.month("FlightDate")})
    dim = airports.select("IATA", "Latitude", "Longitude")
    if broadcast_max_rows:
        dim = joins.checked_broadcast(dim, broadcast_max_rows)
    origin = dim.select(F.col("IATA").alias("IATA_ORIGIN"), F.col("Latitude").alias("OriginLat"),
                        F.col("Longitude").alias("OriginLon"))
    dest = dim.select(F.col("IATA").alias("IATA_DEST"), F.col("Latitude").alias("DestLat"),
                      F.col("Longitude").alias("DestLon"))
    df = joins.left_join(df, origin, on="IATA_ORIGIN", broadcast_max_rows=None)
    df = joins.left_join(df, dest, on="IATA_DEST", broadcast_max_rows=None)
    df = clean.not_null(df, "OriginLat", "OriginLon", "DestLat", "DestLon", "FlightDate")
    return df.select(*ENRICHED_COLUMNS)


def write_enriched(enriched: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK6: keep the enriched table for reuse, partitioned by year and month for pruning."""
    enriched.write.mode(mode).partitionBy(*MONTH).parquet(path)


def flight_metrics(enriched: DataFrame) -> DataFrame:
    """W1 metrics: total flights, distinct days, mean flights per day (one aggregation pass)."""
    return aggregate.count_days_mean(enriched, "FlightDate")


def flight_metrics_text(enriched: DataFrame) -> DataFrame:
    """SC13: the metrics as display text (thousands separators, two decimals)."""
    m = flight_metrics(enriched)
    return m.select(scalars.thousands("total_flights").alias("total_flights"),
                    scalars.two_decimals("mean_per_day").alias("mean_per_day"),
                    scalars.thousands("num_days").alias("num_days"))


def select_month(enriched: DataFrame, year: int | None = None, month: int | None = None,
                 origin: str | None = None, dest: str | None = None) -> DataFrame:
    """FLT3 + FLT4: restrict to one year/month and optionally one origin / destination.

    ``None`` for a parameter means "all" (the dashboard's *Todos*).
    """
    return clean.where_all(enriched, Year=year, Month=month, IATA_ORIGIN=origin, IATA_DEST=dest)


def filter_options(enriched: DataFrame) -> DataFrame:
    """AGG23 + SET4: the years and months offered by the dashboard's selectors.

    Rows ``(kind, value)`` with ``kind`` = ``year`` or ``month``; sorted by kind, then
    number.  One pass: each row yields both (kind, number) pairs.
    """
    pairs = F.explode(F.array(
        F.struct(F.lit("year").alias("kind"), F.col("Year").alias("n")),
        F.struct(F.lit("month").alias("kind"), F.col("Month").alias("n")))).alias("p")
    return (enriched.select(pairs).select("p.*").distinct().orderBy("kind", "n")
            .select("kind", F.col("n").cast("string").alias("value")))


def route_options(enriched: DataFrame) -> DataFrame:
    """AGG23 + SET4: per month, the origins and destinations offered after choosing it.

    Rows ``(Year, Month, kind, value)`` with ``kind`` = ``origin`` or ``dest``; one pass.
    """
    pairs = F.explode(F.array(
        F.struct(F.lit("origin").alias("kind"), F.col("IATA_ORIGIN").alias("value")),
        F.struct(F.lit("dest").alias("kind"), F.col("IATA_DEST").alias("value")))).alias("p")
    return enriched.select(*MONTH, pairs).select(*MONTH, "p.*").distinct()


def route_counts(df: DataFrame, by_month: bool = True) -> DataFrame:
    """AGG1 + SC11: flights per route and carrier, with a colour per carrier.

    ``by_month``: also key by ``Year, Month`` (all selections at once).
    """
    keys = (MONTH if by_month else []) + ROUTE_KEYS
    counts = aggregate.count_rows_by(df, keys, "total")
    return counts.withColumn("color", scalars.hex_colour("AIRLINE"))


def route_layer(routes: DataFrame, by_month: bool = True) -> DataFrame:
    """LAY1 (AGG12 + SC15 + SC17): one line per route with weight and polyline.

    ``weight = clamp(total / max_total * 4, 0.5, 5)`` where ``max_total`` is the
    largest route count of the same month (of the whole table when not by month).
    """
    if by_month:
        # a row per month: partial maxima, then a join the planner broadcasts when small
        top = (routes.groupBy(*MONTH).agg(F.max("total").alias("_max_total"))
               .withColumnsRenamed({"Year": "_year", "Month": "_month"}))
        same = F.col("Year").eqNullSafe(F.col("_year")) & F.col("Month").eqNullSafe(F.col("_month"))
        df = routes.join(top, same).drop("_year", "_month")
    else:
        df = routes.withColumn("_max_total", routes.select(F.max("total")).scalar())
    weight = scalars.clamp(F.col("total") / F.col("_max_total") * 4.0, 0.5, 5.0)
    return (df.withColumn("weight", weight)
            .withColumn("path", scalars.segment("OriginLat", "OriginLon", "DestLat", "DestLon"))
            .drop("_max_total"))


def airport_markers(routes: DataFrame, by_month: bool = True) -> DataFrame:
    """LAY2 (SET1 + SET2 + SC17): each airport of the routes once, with its point."""
    m = MONTH if by_month else []
    # both ends of every route from one pass over the route table (SET1 as an unpivot)
    ends = F.explode(F.array(
        F.struct(F.col("IATA_ORIGIN").alias("IATA"), F.col("OriginLat").alias("lat"),
                 F.col("OriginLon").alias("lon")),
        F.struct(F.col("IATA_DEST").alias("IATA"), F.col("DestLat").alias("lat"),
                 F.col("DestLon").alias("lon")))).alias("e")
    markers = dedup.one_per_key(routes.select(*m, ends).select(*m, "e.*"), m + ["IATA"])
    return markers.withColumn("location", scalars.point("lat", "lon"))


def top_airport(df: DataFrame, role: str = "origin", by_month: bool = True) -> DataFrame:
    """ORD3: most frequent origin (or destination) airport; ties -> smallest code."""
    col = "IATA_ORIGIN" if role == "origin" else "IATA_DEST"
    m = MONTH if by_month else []
    counts = aggregate.count_rows_by(df, m + [col], "count")
    if not m:
        return ordering.top_k(counts, "count", 1, [col])
    return ordering.argmax_by_group(counts, m, col, "count")


def top_routes(routes: DataFrame, k: int = 10, by_month: bool = True) -> DataFrame:
    """AGG5 + ORD5 + SC12: the k origin-destination pairs with most flights.

    Second-stage aggregation over the route table (not the raw flights);
    ties keep the smaller (origin, destination).  Adds the label
    ``"ORIGIN → DEST"``.
    """
    m = MONTH if by_month else []
    pairs = aggregate.sum_by(routes, m + ["IATA_ORIGIN", "IATA_DEST"], "total")
    if m:
        top = ordering.top_k_per_group(pairs, m, ["-total", "IATA_ORIGIN", "IATA_DEST"], k)
    else:
        top = ordering.top_k(pairs, "total", k, ["IATA_ORIGIN", "IATA_DEST"])
    return top.withColumn(ROUTE_LABEL,
                          scalars.join_text("IATA_ORIGIN", "IATA_DEST", ROUTE_SEPARATOR))


def carrier_share(routes: DataFrame, by_month: bool = True) -> DataFrame:
    """AGG5 + AGG25: flights per carrier and its share of the month's flights.

    The month total is a window sum over the per-carrier table (a handful of
    rows per month), so the route table is read once.
    """
    m = MONTH if by_month else []
    per = aggregate.sum_by(routes, m + ["AIRLINE"], "total")
    if not m:
        return aggregate.share_of_total(per, "total", "share")
    month_total = F.sum("total").over(Window.partitionBy(*m))
    return per.withColumn("share", F.col("total") / month_total)


def daily_series(df: DataFrame) -> DataFrame:
    """AGG3 + ORD1: flights per day, in date order."""
    return aggregate.count_rows_by(df, "FlightDate", DAILY_COUNT).orderBy("FlightDate")


def count_top_k(df: DataFrame, keys=("FlightDate", "OriginStateName"), k: int = 30,
                name: str = "len") -> DataFrame:
    """W5 (PRJ1 + AGG2 + ORD4): row count per key combination, the k largest.

    Ties are broken by the keys ascending.
    """
    keys = list(keys)
    counts = aggregate.count_rows_by(df.select(*keys), keys, name)
    return ordering.top_k(counts, name, k, keys)


def route_analysis(enriched: DataFrame, year: int | None = None, month: int | None = None,
                   origin: str | None = None, dest: str | None = None, k: int = 10) -> dict:
    """W2: every table behind the route dashboard for one selection.

    With ``year`` and ``month`` given the tables cover that month (no month keys) and
    ``label`` is its ``yyyy-MM`` text; with both ``None`` they cover every month, keyed by
    ``Year, Month``.  One of the two alone raises: it would pool unlabelled months.
    Two passes over the flights: the route table (AGG1) is written once and every table but
    the daily series is derived from it.  ``filter_options`` offers every year and month,
    ``route_options`` every origin and destination of the chosen month (of each month).
    """
    if (year is None) != (month is None):
        raise ValueError("give both year and month, or neither")
    by_month = year is None
    every = materialize(route_counts(enriched, True), "routes")
    in_month = select_month(every, year, month)
    routes = select_month(in_month, None, None, origin, dest)
    shown = routes if by_month else routes.drop(*MONTH)
    keys = MONTH if by_month else []

    def busiest(role: str) -> DataFrame:
        col = "IATA_ORIGIN" if role == "origin" else "IATA_DEST"
        counts = aggregate.sum_by(shown, keys + [col], "total").withColumnRenamed("total", "count")
        return (ordering.argmax_by_group(counts, keys, col, "count") if keys
                else ordering.top_k(counts, "count", 1, [col]))

    total = F.coalesce(F.sum("total"), F.lit(0)).alias("total_flights")
    out = {
        "routes": route_layer(shown, by_month),
        "markers": airport_markers(shown, by_month),
        "top_origin": busiest("origin"),
        "top_dest": busiest("dest"),
        "top_routes": top_routes(shown, k, by_month),
        "carrier_share": carrier_share(shown, by_month),
        "daily": daily_series(select_month(enriched, year, month, origin, dest)),
        "total": shown.groupBy(*keys).agg(total) if keys else shown.agg(total),
        "filter_options": filter_options(every),
        "route_options": route_options(in_month),
    }
    if not by_month:
        out["label"] = out["total"].select(scalars.year_month_label(F.lit(year), F.lit(month)).alias("label"))
    return out
