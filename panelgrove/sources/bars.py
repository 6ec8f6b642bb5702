"""Price bars from order lines: one bar per supplier and day or month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("lineitem", "supplier", "nation", "region")


def _total(x: str) -> str:
    """Spark's sum of ``x`` whatever the order of rows: whole parts, and the 31 bits behind them, add up as integers, and
    what is left of each value has digits to spare."""
    whole = f"CASE WHEN abs({x}) < 2147483648 THEN CAST(rint({x}) AS BIGINT) ELSE 0 END"
    bits = f"CASE WHEN abs({x}) < 2147483648 THEN CAST(rint(({x} - {whole}) * 2147483648) AS BIGINT) ELSE 0 END"
    return f"(sum({whole}) + (sum({bits}) / 2147483648e0 + sum({x} - {whole} - {bits} / 2147483648e0)))"


def bars_sql(unit: str = "month", duck: bool = False) -> str:
    """Bars as SQL for Spark, or with ``duck`` for the checking engine. Opening and closing
    prices are those of the first and last line by its whole key."""
    first, last = ("arg_min", "arg_max") if duck else ("min_by", "max_by")
    pack = "row" if duck else "struct"
    volume, value = ("sum(q)", "sum(v)") if duck else (_total("q"), _total("v"))
    key = f"{pack}(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)"
    return f"""
SELECT b.*, row_number() OVER (PARTITION BY code ORDER BY date) AS seq, CAST(r_name AS VARCHAR(25)) AS sector,
       close * (1000 + 10 * (code % 97)) AS cap
FROM (
  SELECT l_suppkey AS code, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date,
         {first}(px, k) AS open, {last}(px, k) AS close, max(px) AS high, min(px) AS low,
         {volume} AS volume, {value} / {volume} AS vwap
  FROM (
    SELECT l_suppkey, l_shipdate, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS v,
           CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS px, {key} AS k
    FROM lineitem WHERE l_quantity > 0)
  GROUP BY 1, 2) b
JOIN supplier ON s_suppkey = code JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""


def bars(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The panel: code, date, open, high, low, close, volume, vwap, cap, sector, seq."""
    text = bars_sql(unit)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for t in TABLES:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


def read_csv_folder(spark: SparkSession, path: str, codes: list[str] | None = None) -> DataFrame:
    """Bars from a folder with one CSV a code; the file's stem is the code, kept as a string. Each file's header says which
    of the columns it has, in any order; the others are null, and further ones are not read. Lines are read where they lie
    and large files are split: only headers, a line a file, are shared. Values that are no numbers or times are null."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).withColumn("code", F.regexp_extract("file", r"(.*)\.csv", 1))
    if codes is not None:
        lines = lines.filter(F.col("code").isin(list(codes)))
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '[\\r"\ufeff]', "")))
    lines = lines.withColumn("cells", cells).where(F.trim("value") != "")
    header = F.array_contains("cells", "datetime")
    heads = lines.where(header).groupBy("file").agg(F.min("cells").alias("names"))
    rows = lines.where(~header).join(heads, "file")

    def cell(name: str, kind: str):
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, F.try_element_at("cells", F.when(at > 0, at))).try_cast(kind)

    out = rows.select("code", cell("datetime", "timestamp").alias("datetime"), *[cell(c, "double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    # A missing number is null, never NaN: sums and means would turn NaN.
    return out.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("open", "high", "low", "close", "volume")})


def write_split(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows with ``split`` and ``code``, one folder each."""
    rows.repartition("split", "code").write.partitionBy("split", "code").format(kind).option("header", True).mode("error").save(path)


def read_split(spark: SparkSession, path: str, split: str, code: str | None = None, kind: str = "parquet") -> DataFrame:
    """Back from :func:`write_split`; only the wanted folders are read. Codes are strings, with their leading zeros."""
    read = spark.read.format(kind).option("header", True)
    found = (read.option("inferSchema", True) if kind == "csv" else read).load(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("split", "code") else f for f in found])
    out = read.schema(schema).load(path).filter(F.col("split") == split)
    return out.filter(F.col("code") == code) if code is not None else out


def read_corpus(spark: SparkSession, *paths: str, version: str | None = None) -> DataFrame:
    """Formula rows of JSON files ``{meta, alphas: [...]}``; with ``version``, files of another
    version are refused."""
    out = None
    for p in paths:
        one = spark.read.json(p, multiLine=True)
        if version is not None and one.filter(F.coalesce(F.col("meta.version"), F.lit("")) != version).limit(1).count():
            raise ValueError(f"{p} is not of version {version}")
        rows = one.select(F.explode("alphas").alias("a")).select("a.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
