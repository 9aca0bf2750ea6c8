"""A named set of tables around one population of rows: observations, features, representations, graphs, counts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.resample import take_features
from tessera.schema import require_columns


class Dataset:
    """obs(id, ..), var(feature, ..), X points(id, features), obsm[name] points, obsp[name] edges, layers[name]
    counts(id, feature, count), raw counts, uns parameters. Nothing here holds rows; all are DataFrames."""

    def __init__(self, x: DataFrame | None = None, obs: DataFrame | None = None, var: DataFrame | None = None, raw: DataFrame | None = None):
        self.X, self.raw, self.var = x, raw, var
        self.obs = obs if obs is not None else x.select("id") if x is not None else None
        self.obsm: dict[str, DataFrame] = {}
        self.obsp: dict[str, DataFrame] = {}
        self.layers: dict[str, DataFrame] = {}
        self.uns: dict[str, dict] = {}

    def n_vars(self) -> int:
        return self.var.count() if self.var is not None else self.X.agg(F.max(F.size("features"))).first()[0] or 0

    def rep(self, name: str | None = None, highly_variable: bool = False) -> DataFrame:
        """Points by name: X, or a key of obsm. None takes X if it has fewer than 50 features, else X_pca if there is one,
        else X. highly_variable keeps the marked features of X."""
        if name is None:
            name = "X" if self.n_vars() < 50 or "X_pca" not in self.obsm else "X_pca"
        if name != "X":
            if name not in self.obsm:
                raise ValueError(f"no representation {name!r}; have X, {', '.join(self.obsm)}")
            return self.obsm[name]
        if highly_variable:
            if self.var is None or "highly_variable" not in self.var.columns:
                raise ValueError("var has no column highly_variable")
            keep = [r["feature"] for r in self.var.where("highly_variable").select(F.col("feature").cast("int").alias("feature")).orderBy("feature").collect()]
            return take_features(self.X, keep)
        return self.X

    def counts(self, layer: str | None = None, use_raw: bool = False) -> DataFrame:
        if use_raw:
            if self.raw is None:
                raise ValueError("no raw counts")
            return self.raw
        if layer is not None:
            if layer not in self.layers:
                raise ValueError(f"no layer {layer!r}")
            return self.layers[layer]
        return self.X.select("id", F.posexplode("features").alias("feature", "count")).where("count <> 0")

    def adjacency(self, key: str | None = None, adjacency: DataFrame | None = None) -> DataFrame:
        """A graph: the one given; else what the key's parameters hold (connectivities, then distances); else obsp under
        '<key>_connectivities', then '<key>_distances' (without prefix for the default key)."""
        if adjacency is not None:
            return require_columns(adjacency, "src", "dst", "weight")
        known = self.uns.get(key or "neighbors", {})
        for kind in ("connectivities", "distances"):
            if isinstance(known.get(kind), DataFrame):
                return known[kind]
        prefix = "" if key in (None, "neighbors") else f"{key}_"
        for kind in ("connectivities", "distances"):
            if f"{prefix}{kind}" in self.obsp:
                return self.obsp[f"{prefix}{kind}"]
        raise ValueError(f"no graph for {key or 'neighbors'!r}; compute neighbours first")

    def add_obs(self, column: str, labels: DataFrame, value: str = "cluster", as_string: bool = True) -> Dataset:
        """obs with labels(id, value) as a column; labels are kept as strings."""
        v = F.col(value).cast("string") if as_string else F.col(value)
        self.obs = self.obs.drop(column).join(labels.select("id", v.alias(column)), "id", "left")
        return self

    def copy(self) -> Dataset:
        out = Dataset(self.X, self.obs, self.var, self.raw)
        out.obsm, out.obsp, out.layers, out.uns = dict(self.obsm), dict(self.obsp), dict(self.layers), {k: dict(v) for k, v in self.uns.items()}
        return out

    # --- files ------------------------------------------------------------------------------------------------------

    def tables(self) -> dict[str, DataFrame]:
        out = {k: v for k, v in (("X", self.X), ("obs", self.obs), ("var", self.var), ("raw", self.raw)) if v is not None}
        for group in ("obsm", "obsp", "layers"):
            out |= {f"{group}/{k}": v for k, v in getattr(self, group).items()}
        return out

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Every table as Parquet below the path, with a list of their names and the plain parameters."""
        names = []
        for name, df in self.tables().items():
            df.write.mode(mode).parquet(f"{path}/{name}")
            names.append(name)
        spark = self.obs.sparkSession
        plain = {k: {a: b for a, b in v.items() if not isinstance(b, DataFrame)} for k, v in self.uns.items()}
        spark.createDataFrame([(json.dumps({"tables": names, "uns": plain}, default=str),)], "spec string").coalesce(1).write.mode(mode).parquet(f"{path}/_spec_table")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Dataset:
        spec = json.loads(spark.read.parquet(f"{path}/_spec_table").first()["spec"])
        out = Dataset()
        for name in spec["tables"]:
            df = spark.read.parquet(f"{path}/{name}")
            group, _, key = name.partition("/")
            if key:
                getattr(out, group)[key] = df
            else:
                setattr(out, name, df)
        out.uns = spec["uns"]
        return out


def from_parquet(spark: SparkSession, path: str, id_col: str, vector_col: str, obs_cols: list[str] | None = None) -> Dataset:
    """A dataset from one table with an array column; only the named columns are read."""
    df = spark.read.parquet(path)
    x = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("features"))
    return Dataset(x, df.select(F.col(id_col).cast("bigint").alias("id"), *(obs_cols or [])))


Representation = Callable[[Dataset], DataFrame]
