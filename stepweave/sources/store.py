"""A sample store: samples, step features and kept tokens of episodes, built and committed as one.

Tables are bucketed by episode with the same number of buckets and sorted by step, so a history gather or a lookup of kept
tokens joins bucket with bucket, without an exchange, and a sample is read from one file. Episodes above the split limit
would make a bucket too large for a task: they lie in tables of their own (``*_hot``), dealt by ranges of (episode, step),
and are joined by a shuffle. A build writes a new version beside the old ones; naming it in ``current`` is the commit, so
readers see all tables of a build or none of them. Counts and key collisions are observed while the tables are written.

Layout: ``<path>/current`` and ``<path>/version=<id>/{samples,features,kept}[_hot]``, ``episodes`` (the manifest: first and
last sample of each episode) and ``about`` (one JSON record: buckets, schemas, counts).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.operators import ordered as o

EPISODE, STEP, SAMPLE = "epis_idx", "step_idx", "sample_id"
ROWS_PER_BUCKET = 1 << 16
MOST_BUCKETS = 1 << 14
KEYS = {"samples": [EPISODE, STEP], "features": [EPISODE, STEP], "kept": [EPISODE]}


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings in which joins accept tables that are bucketed by some of their keys."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = place.getFileSystem(conf)
    stream = files.create(staged, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    files.delete(place, False)
    if not files.rename(staged, place):
        raise OSError(f"cannot name the build in {path}")


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).head()["value"])


class Store:
    """One committed build, opened for reading."""

    def __init__(self, spark: SparkSession, path: str, version: str) -> None:
        self.spark = _own_session(spark)
        self.folder = f"{path}/version={version}"
        self.about = _read(self.spark, f"{self.folder}/about")
        self.tables = self.about["tables"]

    @staticmethod
    def open(spark: SparkSession, path: str) -> "Store":
        return Store(spark, path, _read(spark, f"{path}/current")["version"])

    def table(self, name: str, hot: bool = False) -> DataFrame:
        """The episodes of a table that are bucketed, or those above the split limit."""
        schema = T.StructType.fromJson(self.tables[name])
        if hot:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}_hot")
        known = f"store_{self.about['version']}_{name}"
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({fields}) USING parquet CLUSTERED BY ({EPISODE}) SORTED BY "
                       f"({', '.join(KEYS[name])}) INTO {self.about['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(known)

    def parts(self) -> list[bool]:
        return [False, True] if self.about["hot"] else [False]

    def whole(self, name: str) -> DataFrame:
        out = self.table(name)
        return out.unionByName(self.table(name, True)) if self.about["hot"] else out

    def n_samples(self) -> int:
        return self.about["execution_samples"]

    def sample(self, sample_id: int) -> DataFrame:
        """One sample, from the one bucket of its episode: the manifest says which episode holds the number."""
        manifest = self.spark.read.parquet(f"{self.folder}/episodes")
        found = manifest.where((F.col("first_sample") <= sample_id) & (F.col("last_sample") >= sample_id)).head()
        if found is None:
            raise IndexError(f"no sample {sample_id} out of {self.n_samples()}")
        return self.table("samples", found["hot"]).where((F.col(EPISODE) == found[EPISODE]) & (F.col(SAMPLE) == sample_id))

    def each(self, build: Callable[[Mapping[str, DataFrame]], DataFrame]) -> DataFrame:
        """Apply a join of the store's tables to its bucketed and its large episodes, and unite the results."""
        out = None
        for hot in self.parts():
            one = build({name: self.table(name, hot) for name in self.tables})
            out = one if out is None else out.unionByName(one)
        return out


def _checked(df: DataFrame, keys: Sequence[str], **counts) -> tuple[DataFrame, Observation]:
    """The rows, dealt already, with counts and repeated keys observed as they are written."""
    seen = Observation()
    repeated = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) > 1
    marked = df.withColumn("_again", repeated)
    found = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_again").alias("again"),
                           *[c.alias(n) for n, c in counts.items()])
    return found.drop("_again"), seen


def build(path: str, samples: DataFrame, features: DataFrame | None = None, kept: DataFrame | None = None,
          rows_per_bucket: int = ROWS_PER_BUCKET) -> Store:
    """Write samples (sample_id, epis_idx, step_idx, ..), features (epis_idx, step_idx, ..) and kept lists (epis_idx, ..)
    as a new version of the store at ``path`` and commit it.

    Repeated keys, or sample numbers with gaps, raise before the commit and leave the version before in place. Versions
    that are no longer named stay until the caller clears the folder.
    """
    spark = samples.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path}/version={version}"
    tables = {n: t.drop(o.BLOCK) for n, t in {"samples": samples, "features": features, "kept": kept}.items() if t is not None}
    sized = features if features is not None else samples
    n = sized.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // rows_per_bucket)))
    if o.BLOCK in sized.columns:
        large = sized.where(F.col(o.BLOCK).isNotNull()).select(EPISODE).distinct() if o.is_split(sized) else None
    else:
        large = o.oversized(sized, [EPISODE], STEP)
        large = None if large is None else large.select(EPISODE)
    counts = {}
    for name, table in tables.items():
        keys = KEYS[name]
        extra = {"first": F.min(SAMPLE), "last": F.max(SAMPLE)} if name == "samples" else {}
        split = {False: table} if large is None else {
            # at most MAX_SPLITS episodes are above the limit
            False: table.join(F.broadcast(large), EPISODE, "left_anti"), True: table.join(F.broadcast(large), EPISODE, "left_semi")}
        for hot, part in split.items():
            dealt = part.repartitionByRange(*keys) if hot else part.repartition(buckets, EPISODE)
            rows, seen = _checked(dealt, keys, **extra)
            rows = rows.select(*table.columns)
            if hot:
                rows.sortWithinPartitions(*keys).write.parquet(f"{folder}/{name}_hot")
            else:
                made = f"build_{version}_{name}"
                rows.write.bucketBy(buckets, EPISODE).sortBy(*keys).option("path", f"{folder}/{name}").saveAsTable(made)
                spark.sql(f"DROP TABLE {made}")  # forgets the name; the files stay
            counts[name, hot] = seen.get
    again = {name: c["again"] for (name, _), c in counts.items() if c["again"]}
    if again:
        raise ValueError(f"collision of keys in {', '.join(sorted(again))}")
    total = {name: sum(c["rows"] for (n, _), c in counts.items() if n == name) for name in tables}
    ends = [c for (name, _), c in counts.items() if name == "samples" and c["rows"]]
    if ends and (min(c["first"] for c in ends), max(c["last"] for c in ends)) != (0, total["samples"] - 1):
        raise ValueError("sample numbers are not 0 to n - 1")
    about = {"version": version, "buckets": buckets, "hot": large is not None, "execution_samples": total["samples"],
             "total_samples": total.get("features", total["samples"]), "rows": total,
             "tables": {name: T.StructType([T.StructField(f.name, f.dataType, True) for f in table.schema]).jsonValue()
                        for name, table in tables.items()}}
    _put(spark, f"{folder}/about", json.dumps(about))
    written = Store(spark, path, version)
    manifest = None
    for hot in written.parts():
        one = written.table("samples", hot).groupBy(EPISODE).agg(
            F.min(SAMPLE).alias("first_sample"), F.max(SAMPLE).alias("last_sample")).withColumn("hot", F.lit(hot))
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.repartitionByRange("first_sample").sortWithinPartitions("first_sample").write.parquet(f"{folder}/episodes")
    _put(spark, f"{path}/current", json.dumps({"version": version}))
    return written
