"""Registered queries: one callable ``(spark, data_dir) -> DataFrame`` per operator group.

Each query reads whole test tables through the stand-ins of
:mod:`tessel.plans.standins` and runs a library job on them.  Computed
columns carry the same names as in :mod:`tessel.plans.oracle`.  Some queries
round floating results at the very end (sums, means, correlations) so the
independent SQL engine agrees to the last digit; the library functions
themselves return unrounded values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import aggregate as ag
from tessel.operators import clean
from tessel.operators import evaluate as ev
from tessel.operators import ml
from tessel.operators import ordering
from tessel.operators import profile as pf
from tessel.plans import classifier as cl
from tessel.plans import flights as fl
from tessel.plans import bucketed, profiling, rollup
from tessel.session import shared_dir
from tessel.operators import density
from tessel.operators import newton_cg as ncg
from tessel.operators import sketches as sk
from tessel.sources import archives, files, infer, manifest, sinks, workbook, zipped
from tessel.functions import scalars
from tessel.operators import quantiles as qt
from tessel.plans import staging
from tessel.plans import orders as od
from tessel.plans import standins as si


def _sig(c: str, digits: int = 10):
    """Round to ``digits`` significant digits with IEEE operations only (the SQL side uses
    the same formula): summation-order noise in the last bits of a mean cannot change the
    result, and neither can a value lying exactly on a decimal tie."""
    x = F.col(c)
    m = F.pow(F.lit(10.0), F.lit(digits) - F.ceil(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.floor(x * m + 0.5) / m)


def _enriched(spark, d):
    return fl.enrich_flights(si.flights(spark, d), fl.load_airports(si.airports(spark, d)))


def q_count_top_k(spark, d):
    return fl.count_top_k(si.flights(spark, d))


def q_enrich_flights(spark, d):
    return _enriched(spark, d)


def q_flight_metrics(spark, d):
    return fl.flight_metrics(_enriched(spark, d))


def q_flight_metrics_text(spark, d):
    return fl.flight_metrics_text(_enriched(spark, d))


def q_filter_options(spark, d):
    return fl.filter_options(_enriched(spark, d))


def q_route_options(spark, d):
    return fl.route_options(_enriched(spark, d))


def q_route_counts(spark, d):
    return fl.route_counts(_enriched(spark, d))


def q_route_layer(spark, d):
    # arrays travel as their JSON text, so both engines compare them
    return fl.route_layer(fl.route_counts(_enriched(spark, d))).withColumn("path", F.to_json("path"))


def q_airport_markers(spark, d):
    return fl.airport_markers(fl.route_counts(_enriched(spark, d))).withColumn("location", F.to_json("location"))


def q_top_origin(spark, d):
    return fl.top_airport(_enriched(spark, d), "origin")


def q_top_dest(spark, d):
    return fl.top_airport(_enriched(spark, d), "dest")


def q_top_routes(spark, d):
    return fl.top_routes(fl.route_counts(_enriched(spark, d)))


def q_carrier_share(spark, d):
    return fl.carrier_share(fl.route_counts(_enriched(spark, d)))


def q_daily_series(spark, d):
    return fl.daily_series(_enriched(spark, d))


def q_items_per_order(spark, d):
    t = od.item_totals(si.order_items(spark, d))
    return t.withColumn("total_sales", F.round("total_sales", 2))


def q_order_dates(spark, d):
    return od.order_dates(si.orders(spark, d))


def q_order_delay(spark, d):
    return od.order_delay(od.order_dates(si.orders(spark, d)))


def q_geo_first(spark, d):
    return od.unique_geolocations(si.geolocations(spark, d))


def q_consolidate_orders(spark, d):
    out = od.consolidate_orders(si.orders(spark, d), si.order_items(spark, d),
                                si.customers(spark, d), si.geolocations(spark, d),
                                si.states(spark, d))
    # integer columns a left join can leave NULL become floats, as after the pandas merge
    return out.withColumns({"total_products": F.col("total_products").cast("double"),
                            "total_sales": F.round("total_sales", 2)})


# --- W5 explorations -------------------------------------------------------------

def q_text_filter(spark, d):
    return clean.where_text(si.airports_wide(spark, d), "Country = 'NATION_7'")


def q_not_sentinel(spark, d):
    return clean.not_sentinel(si.airports_wide(spark, d), "IATA")


def q_count_by(spark, d):
    airports = clean.not_sentinel(si.airports_wide(spark, d), "IATA")
    return ag.count_non_null_by(airports, "Country", "AirportID")


def q_sum_by_date_text(spark, d):
    out = ag.sum_by(si.sales(spark, d), "Order Date", "Total Cost")
    return out.withColumn("Total Cost", F.round("Total Cost", 2))


def q_total_sum(spark, d):
    return ag.total(si.sales(spark, d), "Total Cost").withColumn("total", F.round("total", 2))


def q_sample_n(spark, d):
    return ordering.sample_n(si.customers(spark, d), 10, seed=42, key_cols=["customer_id"],
                             hash="md5")


# --- profiling ----------------------------------------------------------------------

NUMERIC_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_describe(spark, d):
    out = pf.describe(si.clinical(spark, d))
    return out.select("column", "count", *[_sig(c).alias(c) for c in
                                            ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_table_info(spark, d):
    return pf.table_info(si.clinical(spark, d))


def q_table_shape(spark, d):
    return pf.table_shape(si.clinical(spark, d))


def q_size_profile(spark, d):
    return pf.size_profile(si.airports_wide(spark, d))


def q_corr_matrix(spark, d):
    out = pf.corr_matrix(si.clinical(spark, d))
    return out.withColumn("corr", F.round("corr", 8))


def q_histogram_by_class(spark, d):
    return pf.histogram(si.clinical(spark, d), "l_extendedprice", 25, by="Outcome")


def q_prob_histogram(spark, d):
    return pf.histogram(si.scores(spark, d), "score", 20, by="label", common_range=False)


def q_kde(spark, d):
    out = pf.kde(si.clinical(spark, d), "l_quantity", by="Outcome")
    return out.withColumns({"x": F.round("x", 8), "density": F.round("density", 10)})


def q_pair_bins(spark, d):
    return pf.pair_bins(si.clinical(spark, d), NUMERIC_FEATURES, 10)


def q_column_profile_numeric(spark, d):
    out = pf.column_profile(si.airports_wide(spark, d))
    return out.where(F.col("dtype") != "string").select(
        "column", "dtype", "n_unique", "n_missing", "min", "max")


def q_column_profile_text(spark, d):
    out = pf.column_profile(si.airports_wide(spark, d))
    return out.where(F.col("dtype") == "string").select(
        "column", "dtype", "n_unique", "n_missing", "top1", "top1_count", "top2", "top2_count",
        "others_count")


def q_column_histograms(spark, d):
    return pf.column_histograms(si.airports_wide(spark, d), ["AirportID", "Altitude"], 10)


# --- classifier -----------------------------------------------------------------------

def q_impute_mean(spark, d):
    out = ml.impute_mean(si.clinical(spark, d), ["l_discount", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_discount", 10).alias("l_discount"),
                      F.round("l_tax", 10).alias("l_tax"))


def q_stratified_split_sizes(spark, d):
    orders = si.orders(spark, d)
    split = ml.stratified_split(orders, "order_status", 0.3, 42, key_cols=["order_id"])
    return ml.split_sizes(split, "order_status")


def q_confusion(spark, d):
    return ev.confusion(si.scores(spark, d))


def q_class_report(spark, d):
    return ev.class_report(si.scores(spark, d))


def q_roc_points(spark, d):
    return ev.roc_points(si.scores(spark, d))


def q_auc(spark, d):
    return ev.auc(si.scores(spark, d)).withColumn("auc", F.round("auc", 12))


def q_train_predict(spark, d):
    """W4 end to end: impute, stratified split, fit, predict the test part, top 20 table."""
    data = cl.load_clinical(si.clinical(spark, d), ["l_discount", "l_tax"])
    keys = ["l_orderkey", "l_linenumber"]
    trained = cl.train_classifier(data, "Outcome", NUMERIC_FEATURES, 0.3, 42, key_cols=keys)
    pred = cl.predict(trained, trained["test"])
    return cl.evaluate_classifier(pred, "Outcome", tie_keys=keys)["predictions"]


# --- sources and sinks: stage a stand-in table as files, read it back ---------------------

FLIGHTS_CSV_SCHEMA = ("FlightDate string, Reporting_Airline string, "
                      "Flight_Number_Reporting_Airline int, Origin string, OriginStateName string, "
                      "Dest string, Distance double")
CUSTOMERS_SCHEMA = "customer_id bigint, customer_zip_code_prefix string, customer_city string"
AIRPORTS_WIDE_NAMES = ["AirportID", "Name", "City", "Country", "IATA", "Altitude"]
AIRPORTS_WIDE_TYPES = ["bigint", "string", "string", "string", "string", "double"]


def q_csv_roundtrip(spark, d):
    """SNK1 + SRC1: flights written as CSV with a header, read back typed, then enriched."""
    path = shared_dir(spark, "flights-csv")
    sinks.write_csv(si.flights(spark, d), path)
    raw = files.read_csv(spark, path, FLIGHTS_CSV_SCHEMA)
    return fl.enrich_flights(raw, fl.load_airports(si.airports(spark, d)))


def q_headerless_csv(spark, d):
    """SRC2 + PRJ4: a headerless file with ``\\N`` for missing values, positional names."""
    path = shared_dir(spark, "airports-csv")
    sinks.write_csv(si.airports_wide(spark, d), path, header=False, null_value="\\N")
    raw = files.read_csv(spark, path, files.schema_of([f"_c{i}" for i in range(6)],
                                                      AIRPORTS_WIDE_TYPES),
                         header=False, null_value="\\N")
    return clean.rename_positional(raw, AIRPORTS_WIDE_NAMES)


def _with_large_ids(customers):
    """Customers with an integer column that holds NULLs and values above 2**53."""
    large = F.when(F.col("customer_id") % 7 != 0, F.col("customer_id") + F.lit(9007199254740993))
    return customers.withColumn("large_id", large)


def _ids_as_text(df):
    """The integer column read back, as text: pandas, which compares the engines, would turn an
    integer column with NULLs into floats."""
    return df.withColumn("large_id", F.col("large_id").cast("string"))


LARGE_SCHEMA = CUSTOMERS_SCHEMA + ", large_id bigint"


def q_json_source(spark, d):
    """SRC8: JSON arrays of records, NULL and large integers included."""
    path = shared_dir(spark, "customers-json")
    staging.write_json_records(_with_large_ids(si.customers(spark, d)), path)
    return _ids_as_text(files.read_json_records(spark, path, LARGE_SCHEMA))


def q_xlsx_source(spark, d):
    """SRC7: workbooks; the zip prefix column keeps its leading zeros as text."""
    path = shared_dir(spark, "customers-xlsx")
    staging.write_workbooks(_with_large_ids(si.customers(spark, d)), path)
    return _ids_as_text(workbook.read_workbooks(spark, path, LARGE_SCHEMA))


def q_zip_source(spark, d):
    """SRC10 + SRC4: CSV members of zip archives, six of their columns by header name, in another
    order; one holds quoted newlines, one NULLs and large integers."""
    path = shared_dir(spark, "customers-zip")
    note = F.concat(F.col("customer_city"), F.lit(',\n"'), F.col("customer_id").cast("string"), F.lit('"'))
    staging.write_zipped_csv(_with_large_ids(si.customers(spark, d)).withColumns({"note": note, "unused": F.lit("NaN")}), path)
    return _ids_as_text(zipped.read_zipped_csv(
        spark, path, "note string, large_id bigint, customer_zip_code_prefix string, customer_id bigint, unused double"))


def q_month_selection(spark, d):
    """FLT3 + FLT4: one month of one origin."""
    return fl.select_month(_enriched(spark, d), 1995, 3, origin="NATION_7")


def q_bad_cells_csv(spark, d):
    """SRC3 + SC20: a headerless file whose ``\\N`` stays text; bad numbers become NULL."""
    path = shared_dir(spark, "airports-bad")
    wide = si.airports_wide(spark, d)
    bad = F.when(F.col("AirportID") % 11 == 0, F.concat(F.lit("x"), F.col("AirportID").cast("string"))).otherwise(F.col("AirportID").cast("string"))
    sinks.write_csv(wide.withColumn("AirportID", bad), path, header=False)
    raw = files.read_csv(spark, path, files.schema_of(AIRPORTS_WIDE_NAMES, AIRPORTS_WIDE_TYPES), header=False)
    return raw.withColumn("AirportID", F.col("AirportID").cast("string"))  # see _ids_as_text


def q_glob_csv(spark, d):
    """SRC4 + SRC5 + SNK1: files of two folders with different column orders, read by a glob and by
    name; the zip prefix stays text."""
    path = shared_dir(spark, "customers-glob")
    c = si.customers(spark, d)
    even = F.col("customer_id") % 2 == 0
    sinks.write_csv(c.where(even), f"{path}/part=a")
    sinks.write_csv(c.where(~even).select(*reversed(c.columns)), f"{path}/part=b")
    return files.read_csv(spark, f"{path}/part=*/*.csv", CUSTOMERS_SCHEMA, by_name=True)


def q_head(spark, d):
    """ORD2: the first rows in a given order."""
    return ordering.head(si.customers(spark, d), 7, order=["-customer_city", "customer_id"])


def q_distinct_list(spark, d):
    """SNK5: distinct values handed to the caller (bounded by the caller), as rows again."""
    values = sinks.distinct_list(si.airports_wide(spark, d), "Country", 1000)
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "position int, value string")


def q_custom_colour(spark, d):
    """UDF1: a caller's own colour function over route keys."""
    import hashlib

    own = lambda key: "#" + hashlib.md5(key[::-1].encode()).hexdigest()[:6].upper()
    flights = si.flights(spark, d).select("Origin", "Reporting_Airline").distinct()
    return flights.withColumn("color", scalars.custom_colour("Origin", own))


def q_sample_n_large(spark, d):
    """ORD7 for a sample far above one bucket."""
    keys = ["l_orderkey", "l_linenumber"]
    return ordering.sample_n(si.clinical(spark, d), 12_345, seed=42, key_cols=keys, hash="md5").select(*keys)


def q_quantiles_bucketed(spark, d):
    """The distributed selection of exact quantiles (columns above the direct bound)."""
    out = qt.exact_quantiles(si.clinical(spark, d), ["l_extendedprice", "l_quantity"], [0.1, 0.5, 0.99], max_direct=40)
    return out.withColumn("quantile", F.round("quantile", 6))


FIXED_WEIGHTS = [0.02, -0.00001, 1.5, -2.0, -0.75]


def q_predict_fixed(spark, d):
    """ML4 + ML5 + ML10 (SC8, SC14, SC16, ORD6, PRJ11): given weights, the top 20 table."""
    keys = ["l_orderkey", "l_linenumber"]
    pred = ml.predict_with_weights(FIXED_WEIGHTS, si.clinical(spark, d), NUMERIC_FEATURES)
    return ml.prediction_table(pred, "Outcome", 20, tie_keys=keys)


def q_newton_gradient(spark, d):
    """ML3: the objective's gradient at the fitted weights, over the training rows: zero."""
    train = cl.load_clinical(si.clinical(spark, d), ["l_discount", "l_tax"]).withColumns(
        {"l_extendedprice": F.col("l_extendedprice") / 1000.0})
    w = ml.train_logistic_newton(train, NUMERIC_FEATURES, "Outcome")
    scored = ml.predict_with_weights(w, train, NUMERIC_FEATURES)
    r = F.col("probability_1") - F.col("Outcome")
    x = [*[F.col(c) for c in NUMERIC_FEATURES], F.lit(1.0)]
    g = scored.agg(*[(F.lit(float(w[j])) + F.sum(r * x[j])).alias(f"g{j}") for j in range(len(x))])
    rows = F.array(*[F.struct(F.lit(n).alias("weight"), F.abs(F.round(F.col(f"g{j}"), 4)).alias("gradient"))
                     for j, n in enumerate([*NUMERIC_FEATURES, "intercept"])])
    return g.select(F.explode(rows).alias("s")).select("s.*")


# --- wide, stored and incremental forms ---------------------------------------------------

WIDE = [*[f"w{k}" for k in range(20)], "l_quantity", "far", "flat", "empty"]


def _wide(spark, d):
    """Line items as 24 numeric columns: repeating residues with NULLs, a column far from zero, a
    constant and an empty one.

    One residue decides which columns are NULL, and the rest cannot be NULL: with a residue and NULL
    checks a column, the generated method passes 8000 bytes, which the JVM never compiles."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    c = si.clinical(spark, d).withColumns({"rest": F.when(line.isNotNull(), F.pmod(key, F.lit(13))),
                                           "key": F.coalesce(key, F.lit(0)), "line": F.coalesce(line, F.lit(0))})
    key, line = F.col("key"), F.col("line")
    ws = {f"w{k}": F.when(F.col("rest") != -k % 13, (key * (k + 3) + line * (k * k + 1)) % (11 + 2 * k)) for k in range(20)}
    return c.withColumns({**ws, "far": F.col("l_extendedprice") + 1e9, "flat": F.lit(7.25), "empty": F.lit(None).cast("double")}).select(*WIDE)


def q_corr_wide(spark, d):
    """AGG18 on many columns."""
    return pf.corr_matrix(_wide(spark, d)).withColumn("corr", F.round("corr", 8))


def q_zip_members(spark, d):
    """SRC10, a partition per member: archives of five CSV members each."""
    path = shared_dir(spark, "members-zip")
    note = F.concat(F.col("customer_city"), F.lit(',\n"'), F.col("customer_id").cast("string"), F.lit('"'))
    staging.write_zipped_csv(_with_large_ids(si.customers(spark, d)).withColumns({"note": note, "unused": F.lit("NaN")}), path, members=5)
    return _ids_as_text(archives.read_zip_members(
        spark, path, "note string, large_id bigint, customer_zip_code_prefix string, customer_id bigint, unused double"))


def q_xlsx_sheets(spark, d):
    """SRC7, a partition per sheet."""
    path = shared_dir(spark, "sheets-xlsx")
    staging.write_workbooks(_with_large_ids(si.customers(spark, d)), path)
    return _ids_as_text(archives.read_workbook_sheets(spark, path, LARGE_SCHEMA))


def q_route_rollup(spark, d):
    """AGG1 + SNK6: the monthly route table of all months but one, refreshed when that month's
    files arrive."""
    folder, out = shared_dir(spark, "monthly-csv"), shared_dir(spark, "route-table")
    month = F.substring("FlightDate", 1, 7)
    flights = si.flights(spark, d).select("FlightDate", "Reporting_Airline", "Origin", "Dest").withColumn("file", F.coalesce(month, F.lit("none")))
    airports = fl.load_airports(si.airports(spark, d))
    read = lambda paths: files.read_csv(spark, paths, "FlightDate string, Reporting_Airline string, Origin string, Dest string")
    for late, part in ((False, "early"), (True, "late")):
        rows = flights.where((F.col("file") == "1995-03") == late)
        rows.repartition("file").write.partitionBy("file").option("header", True).csv(f"{folder}/{part}")
        rollup.refresh(spark, folder, out, airports, read)
    return rollup.routes(spark, out)


def q_kept_for_inputs(spark, d):
    """SNK6: flights per day kept for the files they were computed from: asked twice, computed once;
    computed again when another file arrives."""
    folder, kept = shared_dir(spark, "daily-csv"), shared_dir(spark, "daily-kept")
    flights = si.flights(spark, d).select("FlightDate", "Reporting_Airline")
    built, out = [], []
    for step, part in enumerate(["A", None, "N", "R"]):
        if part:
            sinks.write_csv(flights.where(F.col("Reporting_Airline") == part), f"{folder}/{part}")
        inputs = manifest.list_inputs(spark, folder)
        build = lambda: built.append(1) or ag.count_rows_by(files.read_csv(spark, sorted(inputs), "FlightDate string, Reporting_Airline string"), "FlightDate", "n")  # noqa: B023, E731
        now = manifest.keep_for(spark, inputs, kept, build)
        row = now.agg(F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("flights")).first()
        out.append((step, len(built), row["days"], row["flights"]))
    return spark.createDataFrame(out, "step int, built int, days bigint, flights bigint")


def _month_sketches(spark, d):
    """The stored sketches of the enriched flights' months."""
    path = shared_dir(spark, "month-sketches")
    sinks.write_parquet(sk.partition_sketches(_enriched(spark, d), ["Year", "Month"], ["FlightDate"], ["OriginLat"]), path, partition_by=["Year", "Month"])
    return spark.read.parquet(path)


def q_stored_day_counts(spark, d):
    """AGG9-AGG11: flights, days and flights per day of every year, from the months' sketches."""
    out = sk.distinct_counts(_month_sketches(spark, d), "FlightDate", "Year")
    return out.select("Year", F.col("rows").alias("total_flights"), F.col("distinct").alias("num_days"), F.col("per_distinct").alias("mean_per_day"))


def q_stored_quantiles(spark, d):
    """AGG14: quartiles from sketches stored by return flag and status; each answer's true rank."""
    path = shared_dir(spark, "price-sketches")
    sinks.write_parquet(sk.partition_sketches(si.clinical(spark, d), "l_linenumber", numeric=["l_extendedprice"]), path)
    got = sk.quantiles(spark.read.parquet(path), "l_extendedprice", [0.1, 0.3, 0.5, 0.9])
    price = si.clinical(spark, d).select("l_extendedprice")
    answers = got.select("p", "n", "quantile")
    below = price.join(F.broadcast(answers), price.l_extendedprice <= answers.quantile)  # four answers
    return below.groupBy("p", "n").agg(F.round(F.count(F.lit(1)) / F.col("n"), 1).alias("rank"))


def q_heavy_hitters(spark, d):
    """AGG24: the three most frequent values of several columns without shuffling the values."""
    return sk.heavy_hitters(si.airports_wide(spark, d), ["Name", "City", "Country", "Altitude"], 3)


def q_column_profile_fast(spark, d):
    """AGG24 ``exact=False``: all but the sketched distinct counts."""
    out = pf.column_profile(si.airports_wide(spark, d), exact=False)
    return out.where(F.col("dtype") == "string").select("column", "dtype", "n_missing", "top1", "top1_count", "top2", "top2_count", "others_count")


def _many_classes(spark, d):
    """Line items of 60 classes, predicted by another residue."""
    c = si.clinical(spark, d)
    return c.select((F.col("l_orderkey") % 60).cast("int").alias("label"), F.when(F.col("l_linenumber") < 3, F.col("l_orderkey") % 60)
                    .otherwise((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 63).cast("int").alias("prediction"))


def q_confusion_many(spark, d):
    """ML6 with many classes."""
    return ev.confusion(_many_classes(spark, d))


def q_class_report_many(spark, d):
    """ML7 with many classes."""
    return ev.class_report(_many_classes(spark, d))


def q_kde_binned(spark, d):
    """AGG21 by linear binning."""
    out = density.kde_binned(si.clinical(spark, d), "l_extendedprice", by="Outcome", tolerance=1e-9)
    return out.withColumns({"x": F.round("x", 6), "density": F.round("density", 11)})


def q_orders_bucketed(spark, d):
    """JN5 on co-bucketed tables."""
    orders, items = bucketed.store_orders(si.orders(spark, d), si.order_items(spark, d), 8)
    return bucketed.orders_with_totals(orders, items).withColumns(
        {"total_products": F.col("total_products").cast("double"), "total_sales": F.round("total_sales", 2)})


def q_inferred_csv(spark, d):
    """SRC1 + SRC2: types from the first rows; a later value that does not fit becomes NULL."""
    path = shared_dir(spark, "customers-inferred")
    c = _with_large_ids(si.customers(spark, d)).withColumns({"half": F.col("customer_id") / 2, "even": F.col("customer_id") % 2 == 0})
    late = F.when(F.col("customer_id") > 120, F.concat(F.lit("n"), F.col("customer_id"))).otherwise(F.col("customer_id").cast("string"))
    sinks.write_csv(c.withColumn("late", late).orderBy("customer_id"), path, single_file=True)
    got = infer.read_csv_inferred(spark, path, text_columns=["customer_city"], prefix_rows=100)
    kinds = spark.createDataFrame([(",".join(t for _, t in got.dtypes),)], "types string")
    return _ids_as_text(got).withColumn("late", F.col("late").cast("string")).withColumn("types", kinds.select("types").scalar())


def q_newton_cg_gradient(spark, d):
    """ML3 on 21 features by Newton-CG: the objective's gradient at the weights: zero."""
    keys = [f"w{k}" for k in range(20)]
    wide = _wide(spark, d).select(*[(F.coalesce(c, F.lit(0)) / 10.0).alias(c) for c in keys], (F.col("l_quantity") / 50.0).alias("l_quantity"),
                                  F.coalesce((F.col("w3") * 2 + F.col("w5") > 20).cast("int"), F.lit(0)).alias("y"))
    names = [*keys, "l_quantity"]
    w = ncg.train_logistic_cg(wide, names, "y", C=0.01)
    scored = ml.predict_with_weights(w, wide, names)
    r = 0.01 * (F.col("probability_1") - F.col("y"))
    x = [*[F.col(c) for c in names], F.lit(1.0)]
    g = scored.agg(*[(F.lit(float(w[j])) + F.sum(r * x[j])).alias(f"g{j}") for j in range(len(x))])
    rows = F.array(*[F.struct(F.lit(n).alias("weight"), F.abs(F.round(F.col(f"g{j}"), 4)).alias("gradient")) for j, n in enumerate([*names, "intercept"])])
    return g.select(F.explode(rows).alias("s")).select("s.*")


# --- whole jobs ---------------------------------------------------------------------------

def q_route_analysis(spark, d):
    """W2 for one month: the dashboard's figures as (part, name, value)."""
    job = fl.route_analysis(_enriched(spark, d), 1995, 3)
    label = sinks.scalar(job["label"])  # SNK4
    parts = [
        job["total"].select(F.lit("total").alias("part"), F.lit(label).alias("name"), F.col("total_flights").cast("double").alias("value")),
        job["top_origin"].select(F.lit("top_origin"), "IATA_ORIGIN", F.col("count").cast("double")),
        job["top_dest"].select(F.lit("top_dest"), "IATA_DEST", F.col("count").cast("double")),
        job["top_routes"].select(F.lit("top_routes"), fl.ROUTE_LABEL, F.col("total").cast("double")),
        job["carrier_share"].select(F.lit("carrier_share"), "AIRLINE", F.round("share", 10)),
        job["daily"].select(F.lit("daily"), F.col("FlightDate").cast("string"), F.col(fl.DAILY_COUNT).cast("double")),
        job["routes"].groupBy("AIRLINE").agg(F.round(F.sum("weight"), 6).alias("w")).select(F.lit("weights"), "AIRLINE", "w"),
        job["markers"].select(F.lit("markers"), "IATA", F.col("lat")),
        job["filter_options"].select(F.concat(F.lit("option_"), "kind"), "value", F.lit(None).cast("double")),
        job["route_options"].groupBy("kind").agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("route_options"), "kind", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def q_profile_table(spark, d):
    """The profiling job on the clinical table, label dropped from the features (PRJ6), as (part, name,
    value)."""
    data = clean.drop_columns(si.clinical(spark, d), "l_orderkey", "l_linenumber")
    job = profiling.profile_table(data, label="Outcome", hist_cols=["l_quantity"], pair_cols=["l_discount", "l_tax"])
    num = lambda c: F.col(c).cast("double")
    cell = F.concat_ws("/", F.col("x_col"), "y_col", F.col("bx").cast("string"), F.col("by").cast("string"))
    parts = [
        job["info"].select(F.lit("info").alias("part"), F.col("column").alias("name"), num("non_null").alias("value")),
        job["shape"].select(F.lit("shape"), F.lit("rows"), num("rows")),
        job["size"].select(F.lit("size"), "column", num("bytes")),
        job["describe"].select(F.lit("p50"), "column", _sig("p50")),
        job["correlation"].select(F.lit("corr"), F.concat_ws("/", "col_a", "col_b"), F.round("corr", 8)),
        job["column_profile"].select(F.lit("n_unique"), "column", num("n_unique")),
        job["pair_bins"].select(F.lit("pair_bins"), cell, num("count")),
        job["density"]["l_quantity"].where("i % 50 = 0").select(F.lit("density"), F.concat_ws("/", F.col("Outcome").cast("string"), F.col("i").cast("string")), F.round("density", 10)),
        job["class_histograms"]["l_quantity"].select(F.lit("histogram"), F.concat_ws("/", F.col("Outcome").cast("string"), F.col("bin").cast("string")), num("count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def q_evaluate_classifier(spark, d):
    """W4's evaluation of fixed weights, as (part, name, value); an empty table has no report (FLT8)."""
    keys = ["l_orderkey", "l_linenumber"]
    pred = ml.predict_with_weights(FIXED_WEIGHTS, si.clinical(spark, d), NUMERIC_FEATURES)
    job = cl.evaluate_classifier(pred, "Outcome", tie_keys=keys)
    none = clean.is_empty(pred)
    text = lambda *cs: F.concat_ws("/", *[F.col(c).cast("string") for c in cs])
    parts = [job["confusion"].select(F.lit("confusion").alias("part"), text("label", "prediction").alias("name"), F.col("count").cast("double").alias("value"))]
    if not none:
        parts += [
            job["report"].select(F.lit("recall"), "name", "recall"),
            job["auc"].select(F.lit("auc"), F.lit(""), F.round("auc", 6)),
            job["probability_histogram"].select(F.lit("histogram"), text("label", "bin"), F.col("count").cast("double")),
            job["predictions"].select(F.lit("predictions"), text(*keys), F.col("probability (y=1)")),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def q_vector_element(spark, d):
    """SC16: the second element of a probability vector, thresholded."""
    from pyspark.ml.functions import array_to_vector

    p = F.col("l_discount") * 4 + F.col("l_tax")
    c = si.clinical(spark, d).select("l_orderkey", "l_linenumber", array_to_vector(F.array(1.0 - p, p)).alias("probability"))
    second = scalars.vector_element("probability", 1)
    return c.select("l_orderkey", "l_linenumber", F.round(second, 6).alias("probability_1"), (second > 0.25).cast("int").alias("predicted"))


def q_stream_enrichment(spark, d):
    """Structured Streaming: flight CSV files enriched incrementally (stream-static joins,
    several micro-batches, parquet sink with checkpoint), read back as a table."""
    from tessel.streaming import flights as sf

    lay = sf.stage_layout(shared_dir(spark, "flights-stream"))
    sinks.write_csv(si.flights(spark, d), lay["input"])
    stream = sf.read_flight_files(spark, lay["input"], FLIGHTS_CSV_SCHEMA, max_files_per_trigger=2)
    q = sf.run_enrichment(stream, fl.load_airports(si.airports(spark, d)), lay["output"],
                          lay["checkpoint"])
    q.awaitTermination()
    return sf.enriched_output(spark, lay["output"])


QUERIES = {
    "count_top_k": q_count_top_k,
    "enrich_flights": q_enrich_flights,
    "flight_metrics": q_flight_metrics,
    "flight_metrics_text": q_flight_metrics_text,
    "filter_options": q_filter_options,
    "route_options": q_route_options,
    "route_counts": q_route_counts,
    "route_layer": q_route_layer,
    "airport_markers": q_airport_markers,
    "top_origin": q_top_origin,
    "top_dest": q_top_dest,
    "top_routes": q_top_routes,
    "carrier_share": q_carrier_share,
    "daily_series": q_daily_series,
    "items_per_order": q_items_per_order,
    "order_dates": q_order_dates,
    "order_delay": q_order_delay,
    "geo_first": q_geo_first,
    "consolidate_orders": q_consolidate_orders,
    "text_filter": q_text_filter,
    "not_sentinel": q_not_sentinel,
    "count_by": q_count_by,
    "sum_by_date_text": q_sum_by_date_text,
    "total_sum": q_total_sum,
    "sample_n": q_sample_n,
    "describe": q_describe,
    "table_info": q_table_info,
    "table_shape": q_table_shape,
    "size_profile": q_size_profile,
    "corr_matrix": q_corr_matrix,
    "histogram_by_class": q_histogram_by_class,
    "prob_histogram": q_prob_histogram,
    "kde": q_kde,
    "pair_bins": q_pair_bins,
    "column_profile_numeric": q_column_profile_numeric,
    "column_profile_text": q_column_profile_text,
    "column_histograms": q_column_histograms,
    "impute_mean": q_impute_mean,
    "stratified_split_sizes": q_stratified_split_sizes,
    "confusion": q_confusion,
    "class_report": q_class_report,
    "roc_points": q_roc_points,
    "auc": q_auc,
    "train_predict": q_train_predict,
    "csv_roundtrip": q_csv_roundtrip,
    "headerless_csv": q_headerless_csv,
    "json_source": q_json_source,
    "xlsx_source": q_xlsx_source,
    "zip_source": q_zip_source,
    "stream_enrichment": q_stream_enrichment,
    "month_selection": q_month_selection,
    "bad_cells_csv": q_bad_cells_csv,
    "glob_csv": q_glob_csv,
    "head": q_head,
    "distinct_list": q_distinct_list,
    "custom_colour": q_custom_colour,
    "sample_n_large": q_sample_n_large,
    "quantiles_bucketed": q_quantiles_bucketed,
    "predict_fixed": q_predict_fixed,
    "newton_gradient": q_newton_gradient,
    "corr_wide": q_corr_wide,
    "zip_members": q_zip_members,
    "xlsx_sheets": q_xlsx_sheets,
    "route_rollup": q_route_rollup,
    "kept_for_inputs": q_kept_for_inputs,
    "stored_day_counts": q_stored_day_counts,
    "stored_quantiles": q_stored_quantiles,
    "heavy_hitters": q_heavy_hitters,
    "column_profile_fast": q_column_profile_fast,
    "confusion_many": q_confusion_many,
    "class_report_many": q_class_report_many,
    "kde_binned": q_kde_binned,
    "orders_bucketed": q_orders_bucketed,
    "inferred_csv": q_inferred_csv,
    "newton_cg_gradient": q_newton_cg_gradient,
    "route_analysis": q_route_analysis,
    "profile_table": q_profile_table,
    "evaluate_classifier": q_evaluate_classifier,
    "vector_element": q_vector_element,
}
