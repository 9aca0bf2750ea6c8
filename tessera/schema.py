"""Tables that the operators share, and the checks at their doors.

Every table is keyed; there is no row order. Similarities and distances are edges(src, dst, weight), an absent edge
being 0; hard clusterings are labels(id, cluster), with res_id or rep where there are several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "id bigint, features array<double>"
EDGES = "src bigint, dst bigint, weight double"
LABELS = "id bigint, cluster int"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def require_choice(value: str, *choices: str) -> str:
    """value in lower case, if it is one of the choices."""
    if str(value).lower() not in choices:
        raise ValueError(f"{value!r} is none of {', '.join(choices)}")
    return str(value).lower()


def points_from(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """points(id, features) from a table with an array of numbers."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("features"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
