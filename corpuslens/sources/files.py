"""Reading and writing: CSV and JSON of any of the known shapes in, Parquet, CSV and JSON out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which text and rating columns come: fixed values, the first that is there counts.
TEXT_NAMES = ("comment", "comentarios", "comentario", "texto", "review_text", "text")
RATING_NAMES = ("rating", "estrellas", "cantidad de estrellas", "stars")

ENTITY = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
LINGUISTIC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("stars", T.DoubleType()),
        T.StructField("pos_tags", T.ArrayType(T.StringType())),
        T.StructField("noun_phrases", T.ArrayType(T.StringType())),
        T.StructField("entities", T.ArrayType(ENTITY)),
        T.StructField("entity_density", T.DoubleType()),
        T.StructField("clean", T.StringType()),
    ]
)


def keep(df: DataFrame) -> DataFrame:
    """df as files in the folder of spark.checkpoint.dir, which all executors share (a local one where it is unset and all
    executors are in this machine's one process)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/corpuslens-scratch"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def normalize_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-case, with underscores."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with a default for each column that it lacks."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def guess_encoding(spark: SparkSession, path: str, sample_bytes: int = 1 << 16) -> str:
    """utf-8 if the first bytes of the first file are, else windows-1252 or iso-8859-1 by whether bytes 0x80 to 0x9F
    occur. Spark reads the bytes, so any store will do; no more than the sample reaches the driver."""
    head = spark.read.format("binaryFile").load(path).orderBy("path").limit(1).select(F.substring("content", 1, sample_bytes).alias("head")).first()
    raw = bytes(head["head"]) if head else b""
    for cut in range(4):  # the sample may end within a character
        try:
            raw[: len(raw) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "windows-1252" if any(0x80 <= b <= 0x9F for b in raw) else "iso-8859-1"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None) -> DataFrame:
    """CSV with a header; quoted line ends belong to their field."""
    encoding = encoding or guess_encoding(spark, path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "iso-8859-1" if encoding == "windows-1252" else encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files that hold one list of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _first_of(names: tuple[str, ...], columns: list[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def normalize_reviews(df: DataFrame, source: Column | str | None = None, location: Column | str | None = None) -> DataFrame:
    """(text, stars, source, location) from a table under any of the known names. Unnamed columns go, ratings that are
    no numbers become null, rows without text go."""
    df = df.select([F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns if not c.lower().startswith("unnamed")])
    text, rating = _first_of(TEXT_NAMES, df.columns), _first_of(RATING_NAMES, df.columns)
    if text is None:
        raise ValueError(f"no text column among {df.columns}")

    def given(value: Column | str | None, name: str) -> Column:
        if value is not None:
            return value if isinstance(value, Column) else F.lit(value)
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    stars = F.expr(f"try_cast(`{rating}` AS double)") if rating else F.lit(None).cast("double")
    out = df.select(F.col(f"`{text}`").cast("string").alias("text"), stars.alias("stars"), given(source, "source").alias("source"), given(location, "location").alias("location"))
    return out.where("text IS NOT NULL")


def read_review_folders(spark: SparkSession, root: str) -> DataFrame:
    """<root>/<source>/<location>.csv: every folder with one schema is one scan; source and location come from the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+\.csv$", 1).alias("source")).collect()  # names of files
    out = None
    for path in sorted(r["path"] for r in parts):
        df = read_csv(spark, path)
        where = F.col("_metadata.file_path")
        name = F.url_decode(F.regexp_extract(where, r"([^/]+)\.csv$", 1))
        named = df.select("*", F.url_decode(F.regexp_extract(where, r"([^/]+)/[^/]+\.csv$", 1)).alias("source"), name.alias("location"))
        one = normalize_reviews(named)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "text string, stars double, source string, location string")
    return out


def with_ids(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A dense key in the order of the rows: counts of partitions first, then positions within each, so no task sees all
    rows. Written once at ingest and kept."""
    marked = keep(df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    at = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33) + F.col("_before")
    return marked.join(F.broadcast(before), "_p").withColumn(id_col, at).drop("_p", "_m", "_n", "_before")


def union_first(tables: list[DataFrame], key: str) -> DataFrame:
    """All rows, of equal keys the one of the first table (within a table of the least row)."""
    every = None
    for i, df in enumerate(tables):
        df = df.withColumn("_order", F.lit(i))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    others = [F.to_json(F.struct(F.col(c))) for c in every.columns if c not in (key, "_order")]
    order = Window.partitionBy(key).orderBy("_order", *others)
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_order", "_r")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize_if_absent(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at the path; build() makes it first where it is absent."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_by_language(df: DataFrame, path: str, lang_col: str = "lang") -> None:
    """Parquet with a folder a language: reading one language reads its folder only."""
    df.write.mode("overwrite").partitionBy(lang_col).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def texts_of_language(df: DataFrame, lang: str) -> DataFrame:
    """All rows for 'all', else those of one language; any other value than the known ones is an error."""
    if lang == "all":
        return df
    if lang not in ("es", "en", "fr", "mix", "mixed"):
        raise ValueError(f"unknown language {lang!r}")
    return df.where(F.col("lang") == lang)


def model_folder(key: str) -> str:
    """'kmeans|k=9' -> 'kmeans_k9': where a model's tables lie."""
    return key.replace("|", "_").replace("=", "").replace(",", "_")
