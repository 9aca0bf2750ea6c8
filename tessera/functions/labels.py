"""Small functions on labels and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that mean "no annotation", compared in lower case.
MISSING = ("unknown", "unassigned", "na", "nan", "")


def normalise_missing(c: Column) -> Column:
    """The label as a string; null if it stands for a missing annotation."""
    s = c.cast("string")
    return F.when(F.lower(s).isin(*MISSING), F.lit(None)).otherwise(s)


def one_hot(labels: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Indicator rows annot(id, class, p) of every known label; -1 and missing labels have none."""
    c = normalise_missing(F.col(label_col))
    return labels.select(F.col(id_col).alias("id"), c.alias("class"), F.lit(1.0).alias("p")).where("class is not null and class <> '-1'")


def wide(annot: DataFrame, classes: list[str]) -> DataFrame:
    """One column a class, missing entries 0."""
    return annot.groupBy("id").pivot("class", classes).agg(F.sum("p")).na.fill(0.0)


def level_name(level: Column, cluster: Column) -> Column:
    return F.format_string("L%s_C%s", level.cast("string"), cluster.cast("string"))


def resolution_name(res: Column, cluster: Column) -> Column:
    return F.format_string("R%s_C%s", res.cast("string"), cluster.cast("string"))


def numeric_suffix(c: Column) -> Column:
    """The number behind the last underscore; null if it is none."""
    return F.element_at(F.split(c, "_"), -1).try_cast("double")
