"""Shuffle splits of rows and columns, and what is built on them.

A row's place in a split is the rank of md5('seed:split:id'), so splits depend on nothing but seed and id. Ranks don't
gather a split in one task: hash prefixes are counted, and only the rows of the prefix at the border are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.durable import cut
from tessera.schema import require_columns

MAX_SPLITS = 63


def shuffle_splits(rows: DataFrame, n_splits: int = 10, train: float = 0.8, seed: int = 0, id_col: str = "id") -> DataFrame:
    """split_id, id, is_train: floor(train * n) rows without replacement in each split."""
    if not 0 < train <= 1 or n_splits < 1:
        raise ValueError("train is in (0, 1], n_splits at least 1")
    ids = cut(rows.select(F.col(id_col).alias("id")).distinct(), "ids")
    n = ids.count()
    size = int(train * n + 1e-9)
    digits = 1
    while 16 ** (digits + 2) < n and digits < 6:
        digits += 1
    tagged = ids.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    tagged = tagged.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("split_id").cast("string"), F.col("id").cast("string"))))
    tagged = tagged.withColumn("cell", F.substring("h", 1, digits))
    cells = tagged.groupBy("split_id", "cell").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("split_id").orderBy("cell")
    cells = cells.withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
    tagged = tagged.join(cells, ["split_id", "cell"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("split_id", "cell").orderBy("h", "id"))
    return tagged.withColumn("is_train", place <= size).select("split_id", "id", "is_train")


def split_masks(splits: DataFrame) -> DataFrame:
    """id, mask: bit s is set if the row is in the training part of split s. At most 63 splits."""
    bit = F.when(F.col("is_train"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("split_id"))).otherwise(F.lit(0).cast("bigint"))
    return splits.groupBy("id").agg(F.bit_or(bit).alias("mask"))


def feature_splits(spark: SparkSession, n_features: int, n_splits: int = 5, train: float = 0.8, seed: int = 1000) -> DataFrame:
    """split_id, feature, is_train."""
    out = shuffle_splits(spark.range(n_features), n_splits, train, seed)
    return out.select("split_id", F.col("id").cast("int").alias("feature"), "is_train")


def cross_splits(obs: DataFrame, feat: DataFrame | None) -> DataFrame:
    """partition_id, obs_split, feat_split: every pair of a row split and a column split (None: all columns)."""
    o = obs.select(F.col("split_id").alias("obs_split")).distinct()
    if feat is None:
        return o.select(F.col("obs_split").alias("partition_id"), "obs_split", F.lit(None).cast("int").alias("feat_split"))
    f = feat.select(F.col("split_id").alias("feat_split")).distinct()
    count = f.agg(F.count(F.lit(1)).alias("n"))
    pairs = o.join(f).join(count)  # numbers of splits, not of rows
    return pairs.select((F.col("obs_split") * F.col("n") + F.col("feat_split")).cast("int").alias("partition_id"), "obs_split", "feat_split")


def take_features(points: DataFrame, features: list[int]) -> DataFrame:
    """points with these elements of the feature array only."""
    return points.withColumn("features", F.transform(F.array(*[F.lit(i) for i in features]), lambda i: F.element_at("features", i + 1)))


def distribute_samples(n: int, pipelines: list[str]) -> dict[str, int]:
    """n // p samples for each pipeline, one more for the first n % p."""
    return {name: n // len(pipelines) + (i < n % len(pipelines)) for i, name in enumerate(pipelines)}


class Resampler:
    """Rows (and columns) split n_splits times; a step transforms or predicts per split.

    steps are functions (train points, split id) -> function(points) -> DataFrame, fitted on the training part."""

    def __init__(self, n_splits: int = 10, train: float = 0.8, seed: int = 0, feature_train: float | None = None, n_feature_splits: int = 5):
        if n_splits > MAX_SPLITS:
            raise ValueError(f"at most {MAX_SPLITS} splits")
        self.n_splits, self.train, self.seed = n_splits, train, seed
        self.feature_train, self.n_feature_splits = feature_train, n_feature_splits
        self._splits: DataFrame | None = None
        self._features: DataFrame | None = None

    def set_n_splits(self, n: int) -> Resampler:
        return Resampler(n, self.train, self.seed, self.feature_train, self.n_feature_splits)

    def split(self, points: DataFrame) -> DataFrame:
        self._splits = cut(shuffle_splits(points, self.n_splits, self.train, self.seed), "splits")
        if self.feature_train is not None:
            width = points.agg(F.max(F.size("features"))).first()[0] or 0
            self._features = cut(feature_splits(points.sparkSession, width, self.n_feature_splits, self.feature_train, self.seed + 1000), "features")
        return self._splits

    def partitions(self) -> DataFrame:
        if self._splits is None:
            raise ValueError("split() comes first")
        return cross_splits(self._splits, self._features)

    def columns(self, feat_split: int) -> list[int]:
        if self._features is None:
            raise ValueError("no feature splits")
        return [r["feature"] for r in self._features.where((F.col("split_id") == feat_split) & F.col("is_train")).orderBy("feature").collect()]

    def part(self, points: DataFrame, split_id: int, train: bool = True) -> DataFrame:
        if self._splits is None:
            raise ValueError("split() comes first")
        own = self._splits.where((F.col("split_id") == split_id) & (F.col("is_train") == train)).select("id")
        return points.join(own, "id", "left_semi")

    def fit_transform(self, points: DataFrame, fit: Callable) -> DataFrame:
        """The training part of each split, transformed by what fit made of it; split_id in front."""
        return self._each(points, fit, True)

    def fit_predict(self, points: DataFrame, fit: Callable) -> DataFrame:
        """The held-out rows of each split under the model of its training part."""
        return self._each(points, fit, False)

    def _each(self, points: DataFrame, fit: Callable, train: bool) -> DataFrame:
        self.split(points)
        out, self.models = None, []
        for s in range(self.n_splits):
            model = fit(self.part(points, s), s)
            self.models.append(model)
            got = model(self.part(points, s, train)).withColumn("split_id", F.lit(s))
            out = got if out is None else out.unionByName(got)
        return out


def sample_partitions(spark: SparkSession, counts: dict[str, int], n_splits: int, seed: int = 0) -> DataFrame:
    """pipeline, sample_idx, split_id: every sample takes one fitted split of its pipeline, chosen by a hash."""
    if not counts or n_splits < 1:
        raise ValueError("at least one pipeline and one split")
    out = None
    for i, (name, n) in enumerate(counts.items()):
        pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed + i)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(n_splits))
        part = spark.range(n).select(F.lit(name).alias("pipeline"), F.col("id").cast("int").alias("sample_idx"), pick.cast("int").alias("split_id"))
        out = part if out is None else out.unionByName(part)
    return out


class MultiResampler:
    """Samples drawn from several resampled steps, each given as (name, Resampler, fit). The samples are dealt evenly, and
    each takes one partition (a row split and, if there are any, a column split) of its step, chosen by a hash. Step i
    splits rows with seed + i and columns with 1,000 more. Only partitions that a sample takes are fitted."""

    def __init__(self, *steps: tuple[str, Resampler, Callable], n_samples: int = 100, seed: int = 0):
        if not steps:
            raise ValueError("at least one step")
        if len({name for name, _, _ in steps}) < len(steps):
            raise ValueError("steps need names of their own")
        self.steps, self.n_samples, self.seed = steps, n_samples, seed
        self.counts = distribute_samples(n_samples, [name for name, _, _ in steps])
        self._samples: DataFrame | None = None

    def fit(self, points: DataFrame) -> MultiResampler:
        spark, drawn, self._parts = points.sparkSession, [], []
        for i, (name, form, fit) in enumerate(self.steps):
            own = Resampler(form.n_splits, form.train, self.seed + i, form.feature_train, form.n_feature_splits)
            own.split(points)
            table = {r["partition_id"]: r for r in own.partitions().collect()}  # at most row splits x column splits
            taken = sample_partitions(spark, {name: self.counts[name]}, len(table), self.seed + i).collect()  # n_samples rows
            drawn += [(name, r["sample_idx"], r["split_id"], table[r["split_id"]]["obs_split"], table[r["split_id"]]["feat_split"]) for r in taken]
            for p in sorted({r["split_id"] for r in taken}):
                rows, feat = table[p]["obs_split"], table[p]["feat_split"]
                columns = None if feat is None else own.columns(feat)
                sample = self._columns(own.part(points, rows), columns)
                self._parts.append((name, p, columns, sample, fit(sample, rows)))
        self._samples = spark.createDataFrame(drawn, "pipeline string, sample_idx int, partition_id int, obs_split int, feat_split int")
        return self

    def samples(self) -> DataFrame:
        """pipeline, sample_idx, partition_id, obs_split, feat_split."""
        if self._samples is None:
            raise ValueError("fit() comes first")
        return self._samples

    def transform(self, apply: bool = True) -> DataFrame:
        """pipeline, sample_idx and the training part of the sample's partition, through its model unless apply is false."""
        return self._each(lambda sample, columns, model: model(sample) if apply else sample)

    def predict(self, points: DataFrame) -> DataFrame:
        """pipeline, sample_idx and the points through the sample's model, with the columns that it was fitted on."""
        return self._each(lambda sample, columns, model: model(self._columns(points, columns)))

    def summary(self) -> DataFrame:
        """pipeline, n_samples, n_partitions that they take."""
        return self.samples().groupBy("pipeline").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("partition_id").alias("n_partitions"))

    def _each(self, run: Callable) -> DataFrame:
        samples = F.broadcast(self.samples().select("pipeline", "sample_idx", "partition_id"))  # n_samples rows
        out = None
        for name, p, columns, sample, model in self._parts:
            got = run(sample, columns, model).withColumn("pipeline", F.lit(name)).withColumn("partition_id", F.lit(p))
            out = got if out is None else out.unionByName(got)
        if out is None:
            raise ValueError("no samples")
        return samples.join(out, ["pipeline", "partition_id"]).drop("partition_id")

    @staticmethod
    def _columns(points: DataFrame, columns: list[int] | None) -> DataFrame:
        return points if columns is None else take_features(points, columns)


def require_split(df: DataFrame) -> DataFrame:
    return require_columns(df, "split_id", "id", "is_train")
