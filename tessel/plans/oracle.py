"""Independent SQL (DuckDB dialect) for each registered query.

The stand-in inputs are rebuilt here in SQL from the same test tables, and
each job is written from its specification, not from the Spark code.
Integer aggregates are cast to BIGINT and years / months to INT so types
agree with Spark's.
"""

from __future__ import annotations

NN = """nn AS (
  SELECT n_nationkey, n_name, n_regionkey, r_name
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

FLIGHTS = NN + """,
flights AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS FlightDate,
         l_returnflag AS Reporting_Airline,
         so.n_name AS Origin, so.r_name AS OriginStateName, cd.n_name AS Dest
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nn cd ON c_nationkey = cd.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nn so ON s_nationkey = so.n_nationkey),
airports AS (
  SELECT n_name AS IATA,
         CASE WHEN n_regionkey = 4 THEN NULL ELSE CAST(n_nationkey + 25 AS DOUBLE) END AS Latitude,
         CASE WHEN n_regionkey = 4 THEN NULL ELSE CAST(n_nationkey * 2 - 120 AS DOUBLE) END AS Longitude
  FROM nn),
parsed AS (
  SELECT TRY_CAST(FlightDate AS DATE) AS FlightDate, Reporting_Airline AS AIRLINE,
         Origin AS IATA_ORIGIN, Dest AS IATA_DEST
  FROM flights),
enriched AS (
  SELECT p.FlightDate, CAST(year(p.FlightDate) AS INT) AS Year,
         CAST(month(p.FlightDate) AS INT) AS Month,
         p.IATA_ORIGIN, p.IATA_DEST, p.AIRLINE,
         o.Latitude AS OriginLat, o.Longitude AS OriginLon,
         d.Latitude AS DestLat, d.Longitude AS DestLon
  FROM parsed p
  LEFT JOIN airports o ON p.IATA_ORIGIN = o.IATA
  LEFT JOIN airports d ON p.IATA_DEST = d.IATA
  WHERE o.Latitude IS NOT NULL AND o.Longitude IS NOT NULL
    AND d.Latitude IS NOT NULL AND d.Longitude IS NOT NULL
    AND p.FlightDate IS NOT NULL),
routes AS (
  SELECT Year, Month, IATA_ORIGIN, OriginLat, OriginLon, IATA_DEST, DestLat, DestLon, AIRLINE,
         CAST(count(*) AS BIGINT) AS total,
         '#' || substr(md5(AIRLINE), 1, 6) AS color
  FROM enriched
  GROUP BY ALL)"""


TS = "'%Y-%m-%d %H:%M:%S'"

SHOP = f"""ships AS (
  SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
  FROM lineitem GROUP BY l_orderkey),
orders_raw AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         strftime(o_orderdate, {TS}) AS order_purchase_timestamp,
         strftime(o_orderdate + INTERVAL 1 HOUR, {TS}) AS order_approved_at,
         strftime(first_ship, {TS}) AS order_delivered_carrier_date,
         strftime(last_ship, {TS}) AS order_delivered_customer_date,
         strftime(o_orderdate + INTERVAL 60 DAY, {TS}) AS order_estimated_delivery_date
  FROM orders LEFT JOIN ships ON o_orderkey = l_orderkey),
orders_ts AS (
  SELECT order_id, customer_id, order_status,
         TRY_CAST(order_purchase_timestamp AS TIMESTAMP) AS order_purchase_timestamp,
         TRY_CAST(order_approved_at AS TIMESTAMP) AS order_approved_at,
         TRY_CAST(order_delivered_carrier_date AS TIMESTAMP) AS order_delivered_carrier_date,
         TRY_CAST(order_delivered_customer_date AS TIMESTAMP) AS order_delivered_customer_date,
         TRY_CAST(order_estimated_delivery_date AS TIMESTAMP) AS order_estimated_delivery_date
  FROM orders_raw),
orders_dated AS (
  SELECT *, CAST(year(order_purchase_timestamp) AS INT) AS year,
         CAST(month(order_purchase_timestamp) AS INT) AS month,
         CAST(year(order_purchase_timestamp) AS VARCHAR) || 'Q'
           || CAST(quarter(order_purchase_timestamp) AS VARCHAR) AS quarter,
         strftime(order_purchase_timestamp, '%Y-%m') AS year_month
  FROM orders_ts),
orders_delay AS (
  SELECT *, CASE WHEN delta_days > 3 THEN 'long_delay'
                 WHEN delta_days <= 0 THEN 'on_time' ELSE 'short_delay' END AS delay_status
  FROM (SELECT *, (epoch_us(order_delivered_customer_date)
                   - epoch_us(order_estimated_delivery_date)) / 86400000000.0 AS delta_days
        FROM orders_dated)),
items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_extendedprice AS price
  FROM lineitem),
items_agg AS (
  SELECT order_id, CAST(count(order_item_id) AS BIGINT) AS total_products,
         coalesce(sum(price), 0.0) AS total_sales
  FROM items WHERE order_id IS NOT NULL GROUP BY order_id),
customers_s AS (
  SELECT c_custkey AS customer_id,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
         c_mktsegment AS customer_city
  FROM customer),
geo AS (
  SELECT s_suppkey AS line_no,
         lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
         s_acctbal AS geolocation_lat, -s_acctbal AS geolocation_lng,
         s_name AS geolocation_city, 'R' || CAST(n_regionkey AS VARCHAR) AS geolocation_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
geo_first AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY geolocation_zip_code_prefix ORDER BY line_no) AS rn
    FROM geo) WHERE rn = 1),
states AS (
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS abbreviation, r_name AS state FROM region)"""


AIRPORTS_WIDE = NN + r""",
airports_wide AS (
  SELECT c_custkey AS AirportID, c_name AS Name, c_mktsegment AS City, n_name AS Country,
         CASE WHEN c_acctbal < 0 THEN '\N' ELSE c_name END AS IATA, c_acctbal AS Altitude
  FROM customer JOIN nn ON c_nationkey = n_nationkey)"""

SALES = """sales AS (
  SELECT l_orderkey AS "Order ID", strftime(l_shipdate, '%-m/%-d/%Y') AS "Order Date",
         l_extendedprice AS "Total Cost", l_extendedprice * l_discount AS "Total Profit"
  FROM lineitem)"""

CLINICAL = """clinical AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         CAST(l_returnflag = 'R' AS INT) AS Outcome
  FROM lineitem)"""

SCORES = """scores AS (
  SELECT event_id, CAST(event_type = 'click' AS INT) AS label,
         floor(value / 5.0) / 100.0 AS score,
         CAST(floor(value / 5.0) / 100.0 >= 0.5 AS INT) AS prediction
  FROM events)"""

CLINICAL_NUMERIC = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                    "l_tax", "Outcome"]
CLINICAL_TYPES = ["bigint", "int", "double", "double", "double", "double", "int"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


#: An integer column with NULLs and values above 2**53.
LARGE_ID = "CAST(CASE WHEN customer_id % 7 <> 0 THEN customer_id + 9007199254740993 END AS VARCHAR) AS large_id"


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _sig(x: str, digits: int = 10) -> str:
    m = f"pow(CAST(10.0 AS DOUBLE), {digits} - ceil(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE floor({x} * {m} + CAST(0.5 AS DOUBLE)) / {m} END"


def _describe_sql() -> str:
    parts = []
    for c in CLINICAL_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({x}) AS BIGINT) AS count, avg({x}) AS mean, "
            f"stddev_samp({x}) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS p25, "
            f"quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, max({x}) AS max "
            f"FROM clinical")
    stats = ", ".join(f"{_sig(c)} AS {c}" for c in ("mean", "std", "min", "p25", "p50", "p75",
                                                      "max"))
    return _with(CLINICAL, f'SELECT "column", count, {stats} FROM (\n{_union(parts)})')


def _table_info_sql() -> str:
    parts = [f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, "
             f"CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) AS BIGINT) AS rows FROM clinical"
             for i, (c, t) in enumerate(zip(CLINICAL_NUMERIC, CLINICAL_TYPES))]
    return _with(CLINICAL, _union(parts))


def _size_sql() -> str:
    cols = [("AirportID", "bigint"), ("Name", "string"), ("City", "string"),
            ("Country", "string"), ("IATA", "string"), ("Altitude", "double")]
    parts = []
    for c, t in cols:
        e = f"sum(strlen({c}))" if t == "string" else f"count({c}) * 8"
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, "
                     f"CAST(coalesce({e}, 0) AS BIGINT) AS bytes FROM airports_wide")
    return _with(AIRPORTS_WIDE, _union(parts))


def _corr_sql() -> str:
    cols = CLINICAL_NUMERIC
    parts = []
    for a in cols:
        for b in cols:
            v = (f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END" if a == b
                 else f"corr({a}, {b})")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"round(CAST({v} AS DOUBLE), 8) AS corr FROM clinical")
    return _with(CLINICAL, _union(parts))


WIDE_NUMERIC = [*[f"w{k}" for k in range(20)], "l_quantity", "far", "flat", "empty"]


def _corr_wide_sql() -> str:
    ws = ", ".join(f"CASE WHEN (l_orderkey + {k}) % 13 <> 0 THEN (l_orderkey * {k + 3} + l_linenumber * {k * k + 1}) % {11 + 2 * k} END AS w{k}"
                   for k in range(20))
    ctes = CLINICAL + f""",
wide AS (SELECT {ws}, l_quantity, l_extendedprice + 1000000000.0 AS far, l_extendedprice AS near, CAST(7.25 AS DOUBLE) AS flat, CAST(NULL AS DOUBLE) AS empty
         FROM clinical)"""
    # the correlation does not depend on the offset: the SQL side uses the column without it
    use = lambda c: "near" if c == "far" else c
    cells = []
    for a in WIDE_NUMERIC:
        for b in WIDE_NUMERIC:
            v = "NULL" if {a, b} & {"flat", "empty"} else "1.0" if a == b else f"corr({use(a)}, {use(b)})"
            cells.append(f"{{'col_a': '{a}', 'col_b': '{b}', 'corr': round(CAST({v} AS DOUBLE), 8)}}")
    return _with(ctes, f"SELECT s.* FROM (SELECT unnest([{', '.join(cells)}]) AS s FROM wide)")


def _hist_sql(source_ctes: str, table: str, col: str, bins: int, by: str | None,
              common: bool) -> str:
    g = f"{by}, " if by else ""
    gsel = f"d.{by}, " if by else ""
    data = f"data AS (SELECT {g}CAST({col} AS DOUBLE) AS v FROM {table} WHERE {col} IS NOT NULL)"
    if common or not by:
        rng = "rng AS (SELECT min(v) AS lo, max(v) AS hi FROM data)"
        joined = "data d, rng r"
        groups = (f"grp AS (SELECT DISTINCT {by}, lo, hi FROM data, rng)" if by
                  else "grp AS (SELECT lo, hi FROM rng)")
    else:
        rng = f"rng AS (SELECT {by}, min(v) AS lo, max(v) AS hi FROM data GROUP BY {by})"
        joined = f"data d JOIN rng r ON d.{by} = r.{by}"
        groups = "grp AS (SELECT * FROM rng)"
    ab = ("CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS a, "
          "CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS b")
    counts = (f"counts AS (SELECT {gsel}CAST(least(floor((v - a) / (b - a) * {bins}), {bins - 1}) AS INT)"
              f" AS bin, count(*) AS c FROM (SELECT d.*, {ab} FROM {joined}) d GROUP BY ALL)")
    grid = (f"cells AS (SELECT {g}CAST(i AS INT) AS bin, a, b FROM "
            f"(SELECT *, {ab} FROM grp), range(0, {bins}) t(i))")
    using = f"{by}, bin" if by else "bin"
    body = (f"SELECT {g}bin, a + bin * ((b - a) / {bins}) AS bin_lo, "
            f"a + (bin + 1) * ((b - a) / {bins}) AS bin_hi, "
            f"CAST(coalesce(c, 0) AS BIGINT) AS count FROM cells LEFT JOIN counts USING ({using})")
    return _with(f"{source_ctes},\n{data},\n{rng},\n{groups},\n{counts},\n{grid}", body)


def _kde_sql(col: str = "l_quantity", x_digits: int = 8, digits: int = 10) -> str:
    ctes = CLINICAL + f""",
data AS (SELECT Outcome, CAST({col} AS DOUBLE) AS v FROM clinical WHERE {col} IS NOT NULL),
p1 AS (SELECT Outcome, count(*) AS n, stddev_samp(v) AS s, min(v) AS mn, max(v) AS mx
       FROM data GROUP BY Outcome),
p2 AS (SELECT *, s * pow(n, -0.2) AS h FROM p1),
p3 AS (SELECT *, mn - 3.0 * h AS lo, (mx - mn + 6.0 * h) / 199 AS step FROM p2 WHERE h > 0),
weights AS (SELECT Outcome, v, count(*) AS w FROM data GROUP BY ALL),
sums AS (
  SELECT Outcome, i,
         sum(w * exp(-0.5 * ((lo + i * step - v) / h) * ((lo + i * step - v) / h))) AS k
  FROM weights JOIN p3 USING (Outcome), range(0, 200) t(i) GROUP BY ALL)"""
    body = f"""SELECT Outcome, CAST(i AS INT) AS i, round(lo + i * step, {x_digits}) AS x,
       round(k / (n * h * sqrt(2 * pi())), {digits}) AS density, CAST(n AS BIGINT) AS n
FROM sums JOIN p3 USING (Outcome)"""
    return _with(ctes, body)


def _pair_bins_sql() -> str:
    rng = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES)

    def idx(c):
        a = f"CASE WHEN lo_{c} = hi_{c} THEN lo_{c} - 0.5 ELSE lo_{c} END"
        b = f"CASE WHEN lo_{c} = hi_{c} THEN hi_{c} + 0.5 ELSE hi_{c} END"
        return f"CAST(least(floor(({c} - {a}) / ({b} - {a}) * 10), 9) AS INT)"

    parts = []
    for a in FEATURES:
        for b in FEATURES:
            if a != b:
                parts.append(f"SELECT '{a}' AS x_col, '{b}' AS y_col, {idx(a)} AS bx, {idx(b)} AS \"by\" "
                             f"FROM clinical, rng WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    ctes = CLINICAL + f",\nrng AS (SELECT {rng} FROM clinical),\npairs AS ({_union(parts)})"
    return _with(ctes, "SELECT x_col, y_col, bx, \"by\", CAST(count(*) AS BIGINT) AS count "
                       "FROM pairs GROUP BY ALL")


def _profile_numeric_sql() -> str:
    parts = []
    for c, t in (("AirportID", "bigint"), ("Altitude", "double")):
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM airports_wide")
    return _with(AIRPORTS_WIDE, _union(parts))


def _profile_text_sql() -> str:
    cols = ["Name", "City", "Country", "IATA"]
    vc = _union([f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt FROM airports_wide "
                 f"WHERE {c} IS NOT NULL GROUP BY ALL" for c in cols])
    base = _union([f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null "
                   f"FROM airports_wide" for c in cols])
    ctes = AIRPORTS_WIDE + f""",
vc AS ({vc}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS r FROM vc),
tops AS (
  SELECT "column", count(*) AS n_unique,
         max(CASE WHEN r = 1 THEN value END) AS top1, max(CASE WHEN r = 1 THEN cnt END) AS top1_count,
         max(CASE WHEN r = 2 THEN value END) AS top2, max(CASE WHEN r = 2 THEN cnt END) AS top2_count
  FROM ranked GROUP BY "column"),
base AS ({base})"""
    body = """SELECT "column", 'string' AS dtype, CAST(n_unique AS BIGINT) AS n_unique,
       CAST(rows - non_null AS BIGINT) AS n_missing, top1, CAST(top1_count AS BIGINT) AS top1_count,
       top2, CAST(top2_count AS BIGINT) AS top2_count,
       CAST(non_null - coalesce(top1_count, 0) - coalesce(top2_count, 0) AS BIGINT) AS others_count
FROM base JOIN tops USING ("column")"""
    return _with(ctes, body)


def _column_hist_sql() -> str:
    parts = []
    for c in ("AirportID", "Altitude"):
        parts.append(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM airports_wide "
                     f"WHERE {c} IS NOT NULL")
    ctes = AIRPORTS_WIDE + f",\nlong AS ({_union(parts)})"
    return _hist_sql(ctes, "long", "v", 10, '"column"', False)


EVAL = SCORES + """,
per AS (
  SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS fp
  FROM scores WHERE score IS NOT NULL GROUP BY score),
cum AS (
  SELECT score, tp, fp,
         sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
         sum(fp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
         lead(tp) OVER (ORDER BY score DESC) AS next_tp,
         lead(fp) OVER (ORDER BY score DESC) AS next_fp,
         count(*) OVER () AS k, max(score) OVER () AS top
  FROM per),
tot AS (SELECT sum(tp) AS P, sum(fp) AS N FROM per),
cls AS (SELECT label AS c FROM scores UNION SELECT prediction FROM scores),
counts AS (SELECT label, prediction, count(*) AS cnt FROM scores GROUP BY ALL),
cm AS (
  SELECT a.c AS label, b.c AS prediction, CAST(coalesce(cnt, 0) AS BIGINT) AS count
  FROM cls a CROSS JOIN cls b
  LEFT JOIN counts ON counts.label = a.c AND counts.prediction = b.c),
pc AS (
  SELECT c AS cls,
         (SELECT coalesce(sum(count), 0) FROM cm WHERE label = c AND prediction = c) AS tp,
         (SELECT coalesce(sum(count), 0) FROM cm WHERE label = c) AS support,
         (SELECT coalesce(sum(count), 0) FROM cm WHERE prediction = c) AS pred
  FROM cls),
pm AS (
  SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
            CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM pc),
pf AS (
  SELECT *, CASE WHEN precision + recall > 0
                 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score
  FROM pm)"""


def _report_sql(ctes: str) -> str:
    """Report of ``per (cls, tp, support, pred)``."""
    return _with(ctes + """,
rates AS (SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
full_ AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM rates)""", """
SELECT CAST(cls AS VARCHAR) AS name, round_even(precision, 3) AS precision, round_even(recall, 3) AS recall,
       round_even(f1_score, 3) AS f1_score, round_even(CAST(support AS DOUBLE), 3) AS support FROM full_
UNION ALL
SELECT 'accuracy', round_even(acc, 3), round_even(acc, 3), round_even(acc, 3), round_even(acc, 3) FROM (SELECT sum(tp) / sum(support) AS acc FROM full_)
UNION ALL
SELECT 'macro avg', round_even(avg(precision), 3), round_even(avg(recall), 3), round_even(avg(f1_score), 3), round_even(CAST(sum(support) AS DOUBLE), 3) FROM full_
UNION ALL
SELECT 'weighted avg', round_even(sum(precision * support) / sum(support), 3), round_even(sum(recall * support) / sum(support), 3),
       round_even(sum(f1_score * support) / sum(support), 3), round_even(CAST(sum(support) AS DOUBLE), 3) FROM full_""")


MANY = CLINICAL + """,
many AS (
  SELECT CAST(l_orderkey % 60 AS INT) AS label,
         CAST(CASE WHEN l_linenumber < 3 THEN l_orderkey % 60 ELSE (l_orderkey * 7 + l_linenumber) % 63 END AS INT) AS prediction FROM clinical),
many_cls AS (SELECT label AS c FROM many UNION SELECT prediction FROM many)"""

MONTH_ROUTES = FLIGHTS + """,
m AS (SELECT * FROM routes WHERE Year = 1995 AND Month = 3),
e AS (SELECT * FROM enriched WHERE Year = 1995 AND Month = 3)"""

PREDICTED = CLINICAL + """,
pred AS (
  SELECT *, 1.0 / (1.0 + exp(-(0.02 * l_quantity - 0.00001 * l_extendedprice + 1.5 * l_discount - 2.0 * l_tax - 0.75))) AS p FROM clinical),
scored AS (SELECT *, CAST(p > 0.5 AS INT) AS q FROM pred),
pcls AS (SELECT Outcome AS c FROM scored UNION SELECT q FROM scored),
ranked AS (SELECT Outcome, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored),
rng AS (SELECT Outcome AS label, min(p) AS lo, max(p) AS hi FROM scored GROUP BY 1),
bins AS (
  SELECT label, CAST(least(floor((p - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM scored JOIN rng ON Outcome = label GROUP BY ALL)"""


def _profile_table_sql() -> str:
    cols = CLINICAL_NUMERIC[2:]
    parts = ["SELECT 'shape' AS part, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM clinical"]
    for c, t in zip(cols, CLINICAL_TYPES[2:]):
        parts += [f"SELECT 'info', '{c}', CAST(count({c}) AS DOUBLE) FROM clinical",
                  f"SELECT 'size', '{c}', CAST(count({c}) * {4 if t == 'int' else 8} AS DOUBLE) FROM clinical",
                  f"SELECT 'n_unique', '{c}', CAST(count(DISTINCT {c}) AS DOUBLE) FROM clinical"]
        q = f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"
        parts.append(f"SELECT 'p50', '{c}', {_sig('x')} FROM (SELECT {q} AS x FROM clinical)")
        for b in cols:
            v = f"CASE WHEN stddev_samp({c}) > 0 THEN 1.0 END" if c == b else f"corr({c}, {b})"
            parts.append(f"SELECT 'corr', '{c}/{b}', round(CAST({v} AS DOUBLE), 8) FROM clinical")
    kde, hist, pairs = _kde_sql(), _hist_sql(CLINICAL, "clinical", "l_quantity", 25, "Outcome", True), _pair_bins_sql()
    parts.append(f"SELECT 'density', Outcome || '/' || i, density FROM ({kde}) WHERE i % 50 = 0")
    parts.append(f"SELECT 'histogram', Outcome || '/' || bin, CAST(count AS DOUBLE) FROM ({hist})")
    parts.append(f"SELECT 'pair_bins', x_col || '/' || y_col || '/' || bx || '/' || \"by\", CAST(count AS DOUBLE) FROM ({pairs}) "
                 "WHERE x_col IN ('l_discount', 'l_tax') AND y_col IN ('l_discount', 'l_tax')")
    return _with(CLINICAL, _union(parts))


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


ORACLE = {
    "count_top_k": _with(FLIGHTS, """
SELECT FlightDate, OriginStateName, CAST(count(*) AS BIGINT) AS len
FROM flights GROUP BY FlightDate, OriginStateName
ORDER BY len DESC, FlightDate, OriginStateName LIMIT 30"""),

    "enrich_flights": _with(FLIGHTS, "SELECT * FROM enriched"),

    "flight_metrics": _with(FLIGHTS, """
SELECT CAST(count(*) AS BIGINT) AS total_flights,
       CAST(count(DISTINCT FlightDate) AS BIGINT) AS num_days,
       CASE WHEN count(DISTINCT FlightDate) > 0
            THEN count(*) / count(DISTINCT FlightDate) ELSE 0.0 END AS mean_per_day
FROM enriched"""),

    "flight_metrics_text": _with(FLIGHTS, """
SELECT format('{:,}', CAST(count(*) AS BIGINT)) AS total_flights,
       printf('%.2f', count(*) / count(DISTINCT FlightDate)) AS mean_per_day,
       format('{:,}', CAST(count(DISTINCT FlightDate) AS BIGINT)) AS num_days
FROM enriched"""),

    "filter_options": _with(FLIGHTS, """
SELECT DISTINCT 'year' AS kind, CAST(Year AS VARCHAR) AS value FROM enriched
UNION ALL
SELECT DISTINCT 'month', CAST(Month AS VARCHAR) FROM enriched"""),

    "route_options": _with(FLIGHTS, """
SELECT DISTINCT Year, Month, 'origin' AS kind, IATA_ORIGIN AS value FROM enriched
UNION
SELECT DISTINCT Year, Month, 'dest', IATA_DEST FROM enriched"""),

    "route_counts": _with(FLIGHTS, "SELECT * FROM routes"),

    "route_layer": _with(FLIGHTS, """
SELECT r.*, greatest(0.5, least(5.0, r.total / m.max_total * 4.0)) AS weight,
       replace(CAST([[OriginLat, OriginLon], [DestLat, DestLon]] AS VARCHAR), ' ', '') AS path
FROM routes r JOIN (SELECT Year, Month, max(total) AS max_total FROM routes GROUP BY ALL) m
  USING (Year, Month)"""),

    "airport_markers": _with(FLIGHTS, """
SELECT Year, Month, IATA, min_row.lat AS lat, min_row.lon AS lon,
       replace(CAST([min_row.lat, min_row.lon] AS VARCHAR), ' ', '') AS location FROM (
  SELECT Year, Month, IATA, min({'lat': lat, 'lon': lon}) AS min_row FROM (
    SELECT Year, Month, IATA_ORIGIN AS IATA, OriginLat AS lat, OriginLon AS lon FROM routes
    UNION ALL
    SELECT Year, Month, IATA_DEST, DestLat, DestLon FROM routes)
  GROUP BY ALL)"""),

    "top_origin": _with(FLIGHTS, """
SELECT Year, Month, IATA_ORIGIN, n AS count FROM (
  SELECT Year, Month, IATA_ORIGIN, CAST(count(*) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY Year, Month ORDER BY count(*) DESC, IATA_ORIGIN) AS rn
  FROM enriched GROUP BY Year, Month, IATA_ORIGIN)
WHERE rn = 1"""),

    "top_dest": _with(FLIGHTS, """
SELECT Year, Month, IATA_DEST, n AS count FROM (
  SELECT Year, Month, IATA_DEST, CAST(count(*) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY Year, Month ORDER BY count(*) DESC, IATA_DEST) AS rn
  FROM enriched GROUP BY Year, Month, IATA_DEST)
WHERE rn = 1"""),

    "top_routes": _with(FLIGHTS, """
SELECT Year, Month, IATA_ORIGIN, IATA_DEST, total, CAST(rank AS INT) AS rank,
       IATA_ORIGIN || ' → ' || IATA_DEST AS Ruta FROM (
  SELECT Year, Month, IATA_ORIGIN, IATA_DEST, CAST(sum(total) AS BIGINT) AS total,
         row_number() OVER (PARTITION BY Year, Month
                            ORDER BY sum(total) DESC, IATA_ORIGIN, IATA_DEST) AS rank
  FROM routes GROUP BY Year, Month, IATA_ORIGIN, IATA_DEST)
WHERE rank <= 10"""),

    "carrier_share": _with(FLIGHTS, """
SELECT Year, Month, AIRLINE, total,
       total / sum(total) OVER (PARTITION BY Year, Month) AS share FROM (
  SELECT Year, Month, AIRLINE, CAST(sum(total) AS BIGINT) AS total
  FROM routes GROUP BY ALL)"""),

    "daily_series": _with(FLIGHTS, """
SELECT FlightDate, CAST(count(*) AS BIGINT) AS vuelos FROM enriched GROUP BY FlightDate"""),

    "text_filter": _with(AIRPORTS_WIDE, "SELECT * FROM airports_wide WHERE Country = 'NATION_7'"),

    "not_sentinel": _with(AIRPORTS_WIDE, r"""
SELECT * FROM airports_wide WHERE IATA IS NOT NULL AND IATA <> '\N'"""),

    "count_by": _with(AIRPORTS_WIDE, r"""
SELECT Country, CAST(count(AirportID) AS BIGINT) AS AirportID FROM airports_wide
WHERE IATA IS NOT NULL AND IATA <> '\N' AND Country IS NOT NULL GROUP BY Country"""),

    "sum_by_date_text": _with(SALES, """
SELECT "Order Date", round(coalesce(sum("Total Cost"), 0), 2) AS "Total Cost"
FROM sales WHERE "Order Date" IS NOT NULL GROUP BY 1"""),

    "total_sum": _with(SALES, """
SELECT round(coalesce(sum("Total Cost"), 0), 2) AS total FROM sales"""),

    "sample_n": _with(SHOP, """
SELECT customer_id, customer_zip_code_prefix, customer_city FROM customers_s
ORDER BY md5('42|' || CAST(customer_id AS VARCHAR)), customer_id LIMIT 10"""),

    "describe": _describe_sql(),

    "table_info": _table_info_sql(),

    "table_shape": _with(CLINICAL, """
SELECT CAST(count(*) AS BIGINT) AS rows, 7 AS columns FROM clinical"""),

    "size_profile": _size_sql(),

    "corr_matrix": _corr_sql(),

    "histogram_by_class": _hist_sql(CLINICAL, "clinical", "l_extendedprice", 25, "Outcome", True),

    "prob_histogram": _hist_sql(SCORES, "scores", "score", 20, "label", False),

    "kde": _kde_sql(),

    "pair_bins": _pair_bins_sql(),

    "column_profile_numeric": _profile_numeric_sql(),

    "column_profile_text": _profile_text_sql(),

    "column_histograms": _column_hist_sql(),

    "impute_mean": _with(CLINICAL, """
SELECT l_orderkey, l_linenumber,
       round(coalesce(nullif(l_discount, 0),
                      (SELECT avg(nullif(l_discount, 0)) FROM clinical)), 10) AS l_discount,
       round(coalesce(nullif(l_tax, 0), (SELECT avg(nullif(l_tax, 0)) FROM clinical)), 10) AS l_tax
FROM clinical"""),

    "stratified_split_sizes": _with(SHOP, """
SELECT order_status, split, CAST(n AS BIGINT) AS n FROM (
  SELECT order_status, 'test' AS split, floor(n * 0.3 + 0.5) AS n FROM c
  UNION ALL
  SELECT order_status, 'train', n - floor(n * 0.3 + 0.5) FROM c)""".replace(
        "FROM c", "FROM (SELECT order_status, count(*) AS n FROM orders_raw GROUP BY 1) c")),

    "confusion": _with(EVAL, "SELECT * FROM cm"),

    "class_report": _with(EVAL, """
SELECT CAST(cls AS VARCHAR) AS name, round_even(precision, 3) AS precision,
       round_even(recall, 3) AS recall, round_even(f1_score, 3) AS f1_score,
       round_even(CAST(support AS DOUBLE), 3) AS support FROM pf
UNION ALL
SELECT 'accuracy', round_even(acc, 3), round_even(acc, 3), round_even(acc, 3), round_even(acc, 3)
FROM (SELECT sum(tp) / sum(support) AS acc FROM pf)
UNION ALL
SELECT 'macro avg', round_even(avg(precision), 3), round_even(avg(recall), 3),
       round_even(avg(f1_score), 3), round_even(CAST(sum(support) AS DOUBLE), 3) FROM pf
UNION ALL
SELECT 'weighted avg', round_even(sum(precision * support) / sum(support), 3),
       round_even(sum(recall * support) / sum(support), 3),
       round_even(sum(f1_score * support) / sum(support), 3),
       round_even(CAST(sum(support) AS DOUBLE), 3) FROM pf"""),

    "roc_points": _with(EVAL, """
SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr
UNION ALL
SELECT score, fps / N, tps / P FROM cum, tot
WHERE k <= 2 OR score = top OR next_tp IS NULL OR next_tp <> tp OR next_fp <> fp"""),

    "auc": _with(EVAL, """
SELECT round(sum(fp * (tps - tp / 2.0)) / (sum(tp) * sum(fp)), 12) AS auc FROM cum"""),

    "csv_roundtrip": _with(FLIGHTS, "SELECT * FROM enriched"),

    "stream_enrichment": _with(FLIGHTS, "SELECT * FROM enriched"),

    "headerless_csv": _with(AIRPORTS_WIDE, r"""
SELECT AirportID, Name, City, Country, CASE WHEN IATA = '\N' THEN NULL ELSE IATA END AS IATA,
       Altitude FROM airports_wide"""),

    "json_source": _with(SHOP, f"SELECT *, {LARGE_ID} FROM customers_s"),

    "xlsx_source": _with(SHOP, f"SELECT *, {LARGE_ID} FROM customers_s"),

    "zip_source": _with(SHOP, f"""
SELECT customer_city || ',' || chr(10) || '"' || customer_id || '"' AS note, {LARGE_ID},
       customer_zip_code_prefix, customer_id, CAST(NULL AS DOUBLE) AS unused FROM customers_s"""),

    "month_selection": _with(FLIGHTS, """
SELECT * FROM enriched WHERE Year = 1995 AND Month = 3 AND IATA_ORIGIN = 'NATION_7'"""),

    "bad_cells_csv": _with(AIRPORTS_WIDE, """
SELECT CAST(CASE WHEN AirportID % 11 <> 0 THEN AirportID END AS VARCHAR) AS AirportID, Name, City, Country, IATA,
       Altitude FROM airports_wide"""),

    "glob_csv": _with(SHOP, "SELECT * FROM customers_s"),

    "head": _with(SHOP, "SELECT * FROM customers_s ORDER BY customer_city DESC, customer_id LIMIT 7"),

    "distinct_list": _with(AIRPORTS_WIDE, """
SELECT CAST(row_number() OVER (ORDER BY Country) - 1 AS INT) AS position, Country AS value
FROM (SELECT DISTINCT Country FROM airports_wide)"""),

    "custom_colour": _with(FLIGHTS, """
SELECT DISTINCT Origin, Reporting_Airline, '#' || upper(substr(md5(reverse(Origin)), 1, 6)) AS color
FROM flights"""),

    "sample_n_large": _with(CLINICAL, """
SELECT l_orderkey, l_linenumber FROM clinical
ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 12345"""),

    "quantiles_bucketed": _with(CLINICAL, _union([
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS quantile FROM clinical"
        for c in ("l_extendedprice", "l_quantity") for p in (0.1, 0.5, 0.99)])),

    "predict_fixed": _with(CLINICAL, """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       Outcome AS "real_Outcome", CAST(p > 0.5 AS INT) AS predicted,
       round_even(p, 4) AS "probability (y=1)",
       CASE WHEN Outcome = CAST(p > 0.5 AS INT) THEN 'Correcto' ELSE 'Incorrecto' END AS "Error"
FROM (SELECT *, 1.0 / (1.0 + exp(-(0.02 * l_quantity - 0.00001 * l_extendedprice + 1.5 * l_discount
                                   - 2.0 * l_tax - 0.75))) AS p FROM clinical)
ORDER BY round_even(p, 4) DESC, l_orderkey, l_linenumber LIMIT 20"""),

    "newton_gradient": _union([f"SELECT '{c}' AS weight, CAST(0.0 AS DOUBLE) AS gradient"
                               for c in [*FEATURES, "intercept"]]),

    "corr_wide": _corr_wide_sql(),

    "zip_members": _with(SHOP, f"""
SELECT customer_city || ',' || chr(10) || '"' || customer_id || '"' AS note, {LARGE_ID},
       customer_zip_code_prefix, customer_id, CAST(NULL AS DOUBLE) AS unused FROM customers_s"""),

    "xlsx_sheets": _with(SHOP, f"SELECT *, {LARGE_ID} FROM customers_s"),

    "route_rollup": _with(FLIGHTS, "SELECT * FROM routes"),

    "kept_for_inputs": _with(FLIGHTS, """
SELECT CAST(step AS INT) AS step, CAST(built AS INT) AS built, CAST(count(DISTINCT FlightDate) AS BIGINT) AS days, CAST(count(FlightDate) AS BIGINT) AS flights
FROM (VALUES (0, 1, 'A'), (1, 1, 'A'), (2, 2, 'AN'), (3, 3, 'ANR')) t(step, built, parts)
LEFT JOIN flights ON contains(parts, Reporting_Airline) GROUP BY ALL"""),

    "stored_day_counts": _with(FLIGHTS, """
SELECT Year, CAST(count(*) AS BIGINT) AS total_flights, CAST(count(DISTINCT FlightDate) AS BIGINT) AS num_days,
       count(*) / count(DISTINCT FlightDate) AS mean_per_day
FROM enriched GROUP BY Year"""),

    "stored_quantiles": _with(CLINICAL, """
SELECT CAST(p AS DOUBLE) AS p, (SELECT CAST(count(*) AS BIGINT) FROM clinical) AS n, CAST(p AS DOUBLE) AS rank
FROM (VALUES (0.1), (0.3), (0.5), (0.9)) t(p)"""),

    "heavy_hitters": _with(AIRPORTS_WIDE, """
SELECT "column", value, CAST(cnt AS BIGINT) AS count, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS r FROM (
    SELECT 'Name' AS "column", Name AS value, count(*) AS cnt FROM airports_wide GROUP BY ALL
    UNION ALL SELECT 'City', City, count(*) FROM airports_wide GROUP BY ALL
    UNION ALL SELECT 'Country', Country, count(*) FROM airports_wide GROUP BY ALL
    UNION ALL SELECT 'Altitude', CAST(Altitude AS VARCHAR), count(*) FROM airports_wide GROUP BY ALL)
  WHERE value IS NOT NULL) WHERE r <= 3"""),

    "column_profile_fast": f"SELECT * EXCLUDE (n_unique) FROM ({_profile_text_sql()})",

    "confusion_many": _with(MANY, """
SELECT a.c AS label, b.c AS prediction, CAST(coalesce(n, 0) AS BIGINT) AS count FROM many_cls a CROSS JOIN many_cls b
LEFT JOIN (SELECT label, prediction, count(*) AS n FROM many GROUP BY ALL) x ON x.label = a.c AND x.prediction = b.c"""),

    "class_report_many": _report_sql(MANY + """,
per AS (SELECT c AS cls, (SELECT count(*) FROM many WHERE label = c AND prediction = c) AS tp,
               (SELECT count(*) FROM many WHERE label = c) AS support, (SELECT count(*) FROM many WHERE prediction = c) AS pred FROM many_cls)"""),

    "kde_binned": _kde_sql("l_extendedprice", 6, 11),

    "orders_bucketed": _with(SHOP, """
SELECT d.*, CAST(i.total_products AS DOUBLE) AS total_products, round(i.total_sales, 2) AS total_sales
FROM orders_delay d LEFT JOIN items_agg i USING (order_id)"""),

    "inferred_csv": _with(SHOP, f"""
SELECT customer_id, customer_zip_code_prefix, customer_city, {LARGE_ID}, customer_id / 2 AS half, customer_id % 2 = 0 AS even,
       CASE WHEN customer_id <= 120 THEN CAST(customer_id AS VARCHAR) END AS late,
       'bigint,string,string,bigint,double,boolean,bigint' AS types FROM customers_s"""),

    "newton_cg_gradient": _union([f"SELECT '{c}' AS weight, CAST(0.0 AS DOUBLE) AS gradient"
                                  for c in [*[f"w{k}" for k in range(20)], "l_quantity", "intercept"]]),

    "route_analysis": _with(MONTH_ROUTES, """
SELECT 'total' AS part, '1995-03' AS name, CAST(count(*) AS DOUBLE) AS value FROM e
UNION ALL SELECT * FROM (SELECT 'top_origin', IATA_ORIGIN, CAST(count(*) AS DOUBLE) FROM e GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'top_dest', IATA_DEST, CAST(count(*) AS DOUBLE) FROM e GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL SELECT 'top_routes', a || ' → ' || b, n FROM (
  SELECT IATA_ORIGIN AS a, IATA_DEST AS b, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10)
UNION ALL SELECT 'carrier_share', AIRLINE, round(count(*) / (SELECT count(*) FROM e), 10) FROM e GROUP BY AIRLINE
UNION ALL SELECT 'daily', CAST(FlightDate AS VARCHAR), CAST(count(*) AS DOUBLE) FROM e GROUP BY FlightDate
UNION ALL SELECT 'weights', AIRLINE, round(sum(greatest(0.5, least(5.0, total / (SELECT max(total) FROM m) * 4.0))), 6) FROM m GROUP BY AIRLINE
UNION ALL SELECT 'markers', IATA, lat FROM (
  SELECT DISTINCT IATA_ORIGIN AS IATA, OriginLat AS lat FROM m UNION SELECT DISTINCT IATA_DEST, DestLat FROM m)
UNION ALL SELECT 'option_year', CAST(Year AS VARCHAR), NULL FROM (SELECT DISTINCT Year FROM routes)
UNION ALL SELECT 'option_month', CAST(Month AS VARCHAR), NULL FROM (SELECT DISTINCT Month FROM routes)
UNION ALL SELECT 'route_options', 'origin', CAST(count(DISTINCT IATA_ORIGIN) AS DOUBLE) FROM m
UNION ALL SELECT 'route_options', 'dest', CAST(count(DISTINCT IATA_DEST) AS DOUBLE) FROM m"""),

    "profile_table": _profile_table_sql(),

    "evaluate_classifier": _with(PREDICTED, """
SELECT 'confusion' AS part, a.c || '/' || b.c AS name,
       CAST((SELECT count(*) FROM scored WHERE Outcome = a.c AND q = b.c) AS DOUBLE) AS value FROM pcls a CROSS JOIN pcls b
UNION ALL SELECT 'recall', CAST(c AS VARCHAR), round_even(coalesce((SELECT avg(CAST(q = c AS INT)) FROM scored WHERE Outcome = c), 0.0), 3) FROM pcls
UNION ALL SELECT 'recall', 'accuracy', round_even(avg(CAST(q = Outcome AS INT)), 3) FROM scored
UNION ALL SELECT 'recall', 'weighted avg', round_even(avg(CAST(q = Outcome AS INT)), 3) FROM scored
UNION ALL SELECT 'recall', 'macro avg', round_even(avg(r), 3) FROM (
  SELECT coalesce((SELECT avg(CAST(q = c AS INT)) FROM scored WHERE Outcome = c), 0.0) AS r FROM pcls)
UNION ALL SELECT 'auc', '', round((sum(r) FILTER (Outcome = 1) - count(*) FILTER (Outcome = 1) * (count(*) FILTER (Outcome = 1) + 1) / 2.0)
       / (count(*) FILTER (Outcome = 1) * count(*) FILTER (Outcome = 0)), 6) FROM ranked
UNION ALL SELECT 'histogram', rng.label || '/' || i, CAST(coalesce(n, 0) AS DOUBLE)
  FROM rng CROSS JOIN range(0, 20) t(i) LEFT JOIN bins ON bins.label = rng.label AND bins.bin = i
UNION ALL SELECT * FROM (SELECT 'predictions', l_orderkey || '/' || l_linenumber, round_even(p, 4) FROM scored
  ORDER BY round_even(p, 4) DESC, l_orderkey, l_linenumber LIMIT 20)"""),

    "vector_element": _with(CLINICAL, """
SELECT l_orderkey, l_linenumber, round(l_discount * 4 + l_tax, 6) AS probability_1, CAST(l_discount * 4 + l_tax > 0.25 AS INT) AS predicted
FROM clinical"""),

    "items_per_order": _with(SHOP, """
SELECT order_id, total_products, round(total_sales, 2) AS total_sales FROM items_agg"""),

    "order_dates": _with(SHOP, "SELECT * FROM orders_dated"),

    "order_delay": _with(SHOP, "SELECT * FROM orders_delay"),

    "geo_first": _with(SHOP, "SELECT * FROM geo_first"),

    "consolidate_orders": _with(SHOP, """
SELECT o.* EXCLUDE (total_products, total_sales),
       CAST(o.total_products AS DOUBLE) AS total_products,
       round(o.total_sales, 2) AS total_sales,
       c.* EXCLUDE (customer_id, line_no)
FROM (SELECT d.*, i.total_products, i.total_sales
      FROM orders_delay d LEFT JOIN items_agg i USING (order_id)) o
LEFT JOIN (
  SELECT cu.*, g.*, s.*
  FROM customers_s cu
  LEFT JOIN geo_first g ON cu.customer_zip_code_prefix = g.geolocation_zip_code_prefix
  LEFT JOIN states s ON g.geolocation_state = s.abbreviation) c
USING (customer_id)"""),
}
