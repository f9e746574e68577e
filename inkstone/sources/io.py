"""Sources and sinks (S1-S8): pair CSVs, submission and audit files, dataset cache, summary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.session import checkpoint_dir

PAIRS_SCHEMA = T.StructType([T.StructField("id", T.StringType(), False),
                             T.StructField("prompt", T.StringType(), True),
                             T.StructField("svg", T.StringType(), True)])

# FIXED VALUES: texts a pandas CSV reader turns into missing values
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local temp dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def null_na_words(df: DataFrame, cols: list) -> DataFrame:
    """Trap: pandas reads NA words as missing; Spark keeps them.  Null them explicitly."""
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isin(*NA_WORDS), F.lit(None)).otherwise(F.col(c)))
    return df


def read_pairs(spark: SparkSession, path: str, schema: T.StructType = PAIRS_SCHEMA) -> DataFrame:
    """(id, prompt, svg) CSV with quoted multi-line fields; explicit schema, bad rows kept
    in ``_corrupt_record``.  Multi-line CSV files do not split: convert to Parquet once."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
    df = (spark.read.schema(full).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    return null_na_words(df, [f.name for f in schema.fields if f.name != "id"])


def write_pairs(df: DataFrame, path: str) -> str:
    """CSV writer matching :func:`read_pairs` (quotes doubled, header)."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def read_pruned(spark: SparkSession, path: str, cols: list) -> DataFrame:
    """Only the named columns (Parquet column pruning reaches the scan)."""
    return spark.read.parquet(path).select(*cols)


def write_submission(results: DataFrame, path: str) -> str:
    """S3: (id, svg) CSV without an index column."""
    results.select("id", "svg").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A CSV copy with header and doubled quotes (what CSV-reading tools expect)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_audit(audit: DataFrame, path: str) -> str:
    """Audit rows as CSV and JSON lines."""
    audit.write.mode("overwrite").option("header", True).option("escape", '"').csv(path + "/csv")
    audit.write.mode("overwrite").json(path + "/json")
    return path


def dataset_cache(spark: SparkSession, build, path: str, stage: str) -> DataFrame:
    """Materialise once, reuse on rerun.  Spark's ``_SUCCESS`` marker tells a finished
    write; ``split`` is a partition column and the stage names the folder."""
    target = f"{path.rstrip('/')}/{stage}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        build().write.mode("overwrite").partitionBy("split").parquet(target)
    return spark.read.parquet(target)


def holdout_export(eval_rows: DataFrame) -> DataFrame:
    """Eval columns with ``svg_norm`` renamed ``reference_svg``."""
    return eval_rows.select("id", "prompt", F.col("svg_norm").alias("reference_svg"))


def _versions() -> dict:
    import numpy
    import pandas
    import pyarrow
    import pyspark
    return {"pyspark": pyspark.__version__, "pandas": pandas.__version__, "numpy": numpy.__version__,
            "pyarrow": pyarrow.__version__}


def run_summary(rows: DataFrame, seed: int, stage: str, selected: str | None = None,
                skip_holdout_selection: bool = False, runtime_minutes: float | None = None) -> DataFrame:
    """One summary row (seed, stage, selection, counts, means, runtime, package
    versions) — a single aggregate row."""
    versions = F.create_map(*[x for k, v in _versions().items() for x in (F.lit(k), F.lit(v))])
    return rows.agg(
        F.lit(seed).alias("seed"), F.lit(stage).alias("training_stage"),
        F.lit(skip_holdout_selection).alias("skip_holdout_selection"),
        F.lit(selected).cast("string").alias("selected_checkpoint"),
        F.lit(runtime_minutes).cast("double").alias("audit_runtime_minutes"),
        versions.alias("package_versions"),
        F.count(F.lit(1)).alias("holdout_audit_rows"), F.count_if(~F.col("valid")).alias("invalid_generations"),
        F.avg("pdf_proxy_score").alias("mean_pdf_proxy_score"), F.avg("render_mae").alias("mean_render_mae"))


def write_summary(summary: DataFrame, path: str) -> str:
    """S8 sink: the one-row summary as JSON (one partition is safe: one row)."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path
