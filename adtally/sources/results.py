"""Run result tables kept as headered CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from adtally.operators.results import label_result_columns
from adtally.schemas import RESULT_COLUMNS, RESULT_FILE, RESULT_FILE_COLUMNS

# Name pattern of a run's file.
# A folder of that name with parts in it will do as well.
RUN_FILE_PATTERN = r"test_Nodes-(\d+)_System-([^_/]+)_Test-(\d+)\.csv(?:/[^/]+)?$"

_RUN_FIELDS = (("file_nodes", 1, IntegerType()), ("file_system", 2, StringType()), ("file_test", 3, IntegerType()))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files at ``path`` (a file, a folder or a pattern), positional names.

    Folders are not searched below the first level. What the file name says
    about the run is added. No such path gives no rows, with the same schema. A field
    that does not fit its column, or a row with too few, is an error.
    """
    extra = StructType([StructField("file_path", StringType()), *(StructField(n, t) for n, _, t in _RUN_FIELDS)])
    try:
        rows = spark.read.schema(RESULT_FILE).option("header", True).option("mode", "FAILFAST").csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType([*RESULT_FILE.fields, *extra.fields]))
    source = F.col("_metadata.file_path")
    return rows.select(
        *RESULT_FILE.fieldNames(),
        source.alias("file_path"),
        *(F.nullif(F.regexp_extract(source, RUN_FILE_PATTERN, group), F.lit("")).cast(dtype).alias(name)
          for name, group, dtype in _RUN_FIELDS),
    )


def write_results(results: DataFrame, folder: str) -> None:
    """Write labelled results, one folder per run, in the same file columns.

    Writing a run again replaces it and leaves the others. Rows are rebalanced by run before the write: small runs become one file,
    and a run with a third of the rows is split over several.
    """
    run = {"system": "System", "nodes": "NumberOfNodes", "test": "TestNumber"}
    keyed = results.select(*RESULT_COLUMNS, *(F.col(column).alias(key) for key, column in run.items()))
    (
        keyed.toDF(*RESULT_FILE_COLUMNS, *run)
        .hint("rebalance", *run)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy(*run)
        .csv(folder)
    )


def read_written_results(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled results of all runs :func:`write_results` put in ``folder``."""
    return label_result_columns(read_results(spark, f"{folder}/system=*/nodes=*/test=*"))
