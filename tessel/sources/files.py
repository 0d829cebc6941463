"""Delimited text, JSON and JDBC sources (SRC1-SRC6, SRC8, SRC9, SRC11).

Schemas are always given: inference is a second pass over the data (and
turns postal codes into numbers).  Malformed fields become NULL with the
row kept (``PERMISSIVE``), which is what ``ignore_errors`` / ``errors='coerce'``
did in the original code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The airport file's column names, in file order (the file has no header).
AIRPORT_COLUMNS = ["AirportID", "Name", "City", "Country", "IATA", "ICAO", "Latitude",
                   "Longitude", "Altitude", "Timezone", "DST", "TzDatabaseTimeZone", "Type",
                   "Source"]
AIRPORT_TYPES = ["bigint", "string", "string", "string", "string", "string", "double", "double",
                 "bigint", "string", "string", "string", "string", "string"]


def schema_of(names, types) -> T.StructType:
    """A struct schema from parallel lists of names and SQL type names."""
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def read_csv(spark: SparkSession, path, schema, header: bool = True, sep: str = ",",
             null_value: str | None = None, extra_null_tokens=(),
             timestamp_format: str | None = None, nan_as_null: bool = True,
             by_name: bool = False) -> DataFrame:
    """SRC1 / SRC4 / SRC5 / SRC6 / SRC11: CSV with an explicit schema.

    ``path`` may be a folder, a glob (parentheses are literal) or a list.
    ``null_value``: the one token Spark's reader maps to NULL (``\\N`` for the
    airport file).  ``extra_null_tokens``: further text tokens meaning missing
    (S16), applied to string columns as an expression after the read.
    ``nan_as_null``: a ``NaN`` read into a floating column becomes NULL (S1), so
    filters and aggregates treat it as missing, as the dataframe code did.
    ``by_name``: the schema names a subset of the header's columns, in any order
    (a wide file such as the monthly flight files); they are taken by name from
    each file's own header and cast leniently.  Otherwise the schema describes every column
    in file order (Spark maps a given schema to columns by position).
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if by_name and header:
        df = _read_by_name(spark, path, schema, sep, null_value, timestamp_format)
        return _missing_values(df, schema, nan_as_null, extra_null_tokens)
    # RFC 4180 quoting: a quote inside a quoted field is doubled ("")
    reader = (spark.read.schema(schema).option("header", header).option("sep", sep)
              .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    df = reader.csv(path)
    return _missing_values(df, schema, nan_as_null, extra_null_tokens)


def _header_lines(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by their first line, read through Hadoop (any file system, compressed or not)."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out: dict[str, list[str]] = {}
    for f in files:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        stream, codec = p.getFileSystem(conf).open(p), codecs.getCodec(p)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        out.setdefault(reader.readLine() or "", []).append(f)
        reader.close()
    return out


def _read_by_name(spark, path, schema, sep, null_value, timestamp_format) -> DataFrame:
    """Columns of ``schema`` by header name; files are read in groups of equal headers, since
    Spark applies one file's header to all files of a read by position."""
    reader = (spark.read.option("header", True).option("sep", sep).option("quote", '"')
              .option("escape", '"').option("mode", "PERMISSIVE"))
    if null_value is not None:
        reader = reader.option("nullValue", null_value)

    def typed(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType) and timestamp_format:
            return F.try_to_timestamp(c, F.lit(timestamp_format)).alias(f.name)
        return c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType).alias(f.name)

    parts = []
    for line, group in _header_lines(spark, spark.read.text(path).inputFiles()).items():
        if not line:
            continue  # an empty file
        raw = reader.csv(group)
        missing = [f.name for f in schema.fields if f.name not in raw.columns]
        if missing:
            raise ValueError(f"columns not in the header of {group[0]}: {missing}")
        parts.append(raw.select(*[typed(f) for f in schema.fields]))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _missing_values(df: DataFrame, schema: T.StructType, nan_as_null: bool,
                    extra_null_tokens) -> DataFrame:
    if nan_as_null:
        floats = [f.name for f in schema.fields
                  if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        if floats:
            df = df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))
                                 for c in floats})
    if extra_null_tokens:
        tokens = list(extra_null_tokens)
        df = df.withColumns({f.name: F.when(F.col(f.name).isin(tokens), F.lit(None))
                             .otherwise(F.col(f.name))
                             for f in schema.fields if isinstance(f.dataType, T.StringType)})
    return df


def read_airports(spark: SparkSession, path, null_value: str | None = "\\N") -> DataFrame:
    """SRC2 (``null_value='\\N'``) / SRC3 (``null_value=None``: ``\\N`` stays text):
    the headerless 14-column airport file with positional names."""
    return read_csv(spark, path, schema_of(AIRPORT_COLUMNS, AIRPORT_TYPES), header=False,
                    null_value=null_value)


def read_json_records(spark: SparkSession, path, schema, lines: bool = False) -> DataFrame:
    """SRC8: JSON file(s) holding an array of records (one file may span many lines).

    An array file is read by one task per file; ``lines=True`` reads JSON Lines
    (one record per line), which Spark splits across tasks - the layout to
    prefer for large inputs.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, properties: dict | None = None) -> DataFrame:
    """SRC9: a table or a projection query from a database.

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` range queries run in parallel (``table`` form only: Spark
    cannot partition a free ``query``); the projection in ``query`` or the
    columns later selected are pushed to the database.
    """
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if query is not None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 8)))
    return reader.load()
