"""Exact dedup: a log-structured merge index, in DataFrame operations only.

Each scan task is a memtable: it sorts the digests of its slice and flushes them without a
shuffle (level 0, Parquet files with Bloom filters on the digest). A load's memtables are dealt
to RUNS runs. Compaction merges each run by digest, keeping one identifier and the number of
rows (level 1: every digest once in a run, sorted, with filters); runs of several loads pile up
until there are more than FAN_IN, which merges them all into one (level 2). Besides Parquet's
own filters, which serve lookups, each run has a bitmap of the hashes of its digests.

Hits between runs: a digest that no other run's bitmap holds, and that has one row in its own,
is unique and is not merged; only the others are. Bitmaps are built and broadcast up to a
checked size, beyond it all digests are merged (the same result by a larger shuffle).
Hits receive byte verification: the texts of a digest are the same if and only if the smallest
equals the largest, which needs no pairs and combines before the shuffle, so a digest with a
third of all rows costs no task more than its share. Digests whose texts differ (collisions)
are grouped by text. Rows take their group's figures from a table of hits: by broadcast up to
a checked size, else digests of very many rows by broadcast and the rest by shuffle.

Null text counts as empty; a null identifier is
kept only where its group has no other. Rows that repeat an
identifier with the same text each give a row, and exactly one of a group is kept. Other
columns of the input are left aside, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialise, new_folder, sized, text_or_empty

#: Runs of one load, and runs that make a compaction of all due.
RUNS, FAN_IN = 4, 16
#: Bits of a run's bitmap for each digest.
FILTER_BITS = 8
BITMAP = 32_768
#: Digests with more rows than this are joined by broadcast: at most one for so many rows.
HEAVY = 100_000


class LsmIndex:
    """Runs of (digest, id, rows) below one folder."""

    def __init__(self, spark: SparkSession, folder: str, keep: str = "min", id_type: str = "long"):
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.folder, self.keep = spark, folder, keep
        self.schema = f"digest binary, id {id_type}, rows long"
        self.loads: list[str] = []
        #: Path of each compacted load (or of the one run that all became), and its number of runs.
        self.levels: list[tuple[str, int]] = []
        self.bits = self.written = 0
        self.filters: list[str] = []

    def _write(self, df: DataFrame, path: str, *by: str) -> str:
        out = df.sortWithinPartitions(*by, "digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.max.bytes", str(256 << 10))
        (out.partitionBy(*by) if by else out).parquet(path)
        return path

    def insert(self, rows: DataFrame) -> None:
        """A load of rows (digest, id): flushed as memtables, then compacted run by run."""
        run = F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run")
        self.loads.append(self._write(rows.select("digest", "id", F.lit(1).cast("long").alias("rows"), run), f"{self.folder}/level0-{len(self.loads)}", "run"))
        flushed = self.spark.read.schema(f"{self.schema}, run int").parquet(self.loads[-1])
        self._level(self._merged(flushed, "run"), RUNS)
        if sum(n for _, n in self.levels) > FAN_IN:
            self.compact()

    def _merged(self, runs: DataFrame, *by: str) -> DataFrame:
        """One row per digest: partial sums per task, then runs in order of digest."""
        best = F.min("id") if self.keep == "min" else F.max("id")
        return runs.groupBy(*by, "digest").agg(best.alias("id"), F.sum("rows").alias("rows"))

    def _level(self, merged: DataFrame, runs: int) -> None:
        self.written += 1
        path = f"{self.folder}/{'level1' if runs > 1 else 'level2'}-{self.written}"
        self._write(merged if "run" in merged.columns else merged.withColumn("run", F.lit(0)), path, "run")
        self.levels.append((path, runs))
        self.filters = []  # sized by all digests, so built anew when next consulted

    def compact(self) -> None:
        """All runs into one."""
        merged = self._merged(self.runs())
        self.levels = []
        self._level(merged, 1)

    def level0(self) -> DataFrame:
        """(digest, id, rows) as flushed."""
        out = None
        for path in self.loads:
            one = self.spark.read.schema(f"{self.schema}, run int").parquet(path).drop("run")
            out = one if out is None else out.unionByName(one)
        return out

    def runs(self) -> DataFrame:
        """(digest, id, rows, run) of all runs, numbered over the levels."""
        out, first = None, 0
        for path, n in self.levels:
            one = self.spark.read.schema(f"{self.schema}, run int").parquet(path).withColumn("run", F.col("run") + first)
            out, first = one if out is None else out.unionByName(one), first + n
        return out

    def _filters(self) -> DataFrame | None:
        """(run, bucket, bits) of all runs, or None where they would be too large to broadcast."""
        if not self.filters:
            runs = self.runs()
            most = max((r[1] for r in runs.groupBy("run").count().collect()), default=0)  # a row per run
            self.bits = BITMAP
            while self.bits < FILTER_BITS * most:
                self.bits *= 2
            if sum(n for _, n in self.levels) * self.bits // 8 > BROADCAST_BYTES:
                return None
            made = runs.select("run", self.slot().alias("slot")).groupBy("run", F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
            self.filters = [new_folder(self.spark, "lsm-filters")]
            made.write.parquet(self.filters[0])
        return self.spark.read.schema("run int, bucket long, bits binary").parquet(self.filters[0])

    def slot(self, digest: str = "digest") -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.bits)) + 1

    @staticmethod
    def is_set(bits: Column, slot: Column) -> Column:
        """Whether a bitmap (null: empty) holds a slot."""
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce((F.floor(byte / F.pow(F.lit(2), at % 8)) % 2) == 1, F.lit(False))

    def candidates(self) -> DataFrame:
        """(digest, id, rows) that may have several rows: by their own run, or by another's bitmap."""
        runs, filters = self.runs(), self._filters() if len(self.levels) and sum(n for _, n in self.levels) > 1 else None
        if filters is None:
            return runs.drop("run") if sum(n for _, n in self.levels) > 1 else runs.filter("rows > 1").drop("run")
        numbers = filters.select(F.col("run").alias("mine")).distinct()
        others = filters.join(F.broadcast(numbers), F.col("run") != F.col("mine")).groupBy("mine", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        probed = runs.withColumn("slot", self.slot()).withColumn("at", F.bitmap_bucket_number("slot"))
        probed = probed.join(F.broadcast(others), (F.col("run") == F.col("mine")) & (F.col("at") == F.col("bucket")), "left")
        return probed.filter((F.col("rows") > 1) | self.is_set(F.col("bits"), F.col("slot"))).select("digest", "id", "rows")

    def hits(self) -> DataFrame:
        """(digest, id kept, rows) of digests with several rows."""
        return self._merged(self.candidates()).filter("rows > 1")

    def lookup(self, digest: bytes) -> DataFrame:
        """The index's row of one digest: runs whose bitmap lacks it are not read, and in the
        others Parquet's filters and the sorted order leave out most row groups."""
        filters = self._filters()
        runs = self.runs().filter(F.col("digest") == F.lit(digest))
        if filters is not None:
            slot = self.spark.range(1).select(self.slot_of(digest).alias("s")).first()[0]
            held = [r[0] for r in filters.filter(F.col("bucket") == F.bitmap_bucket_number(F.lit(slot))).filter(self.is_set(F.col("bits"), F.lit(slot))).select("run").collect()]
            runs = runs.filter(F.col("run").isin(held))
        return self._merged(runs)

    def slot_of(self, digest: bytes) -> Column:
        return F.pmod(F.xxhash64(F.lit(digest)), F.lit(self.bits)) + 1


def digest_of(text: Column, digest_bytes: int) -> Column:
    """The first digest_bytes bytes of SHA-256. Fewer than 32 are for tests of collisions."""
    digest = F.unhex(F.sha2(text, 256))
    return digest if digest_bytes == 32 else F.substring(digest, 1, digest_bytes)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest_bytes: int = 32) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    base = base.withColumn("digest", digest_of(F.col("body"), digest_bytes))
    index = LsmIndex(spark, new_folder(spark, "lsm"), keep, dict(base.dtypes)["id"])
    index.insert(base.select("digest", "id"))
    hits = materialise(index.hits().select("digest", F.col("id").alias("keep_id"), F.col("rows").alias("group_size")), "lsm-hits")
    n_hits = hits.count()
    dup = _with_hits(base, hits, n_hits, digest_bytes, "left_semi")
    # Byte verification; min and max combine before the shuffle.
    verified = materialise(dup.groupBy("digest").agg((F.min("body") == F.max("body")).alias("same")), "lsm-verified")
    bad = materialise(verified.filter("not same").select("digest"), "lsm-collisions")
    n_bad = bad.count()
    rows = _with_hits(index.level0().select("digest", "id"), hits, n_hits, digest_bytes, "left")
    if n_bad:
        rows = rows.join(sized(bad, n_bad, digest_bytes), "digest", "left_anti")
    # A digest without a hit has one row. An identifier that repeats within a group: counted, then given back row by row.
    single = rows.filter("group_size IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    copies = rows.filter("group_size IS NOT NULL").groupBy("digest", "id", "keep_id", "group_size").agg(F.count("*").alias("copies"))
    out = single.unionByName(_kept(copies, id_col))
    if n_bad:
        best = F.min("id") if keep == "min" else F.max("id")
        texts = base.join(sized(bad, n_bad, digest_bytes), "digest", "left_semi").groupBy("digest", "body", "id").agg(F.count("*").alias("copies"))
        groups = texts.groupBy("digest", "body").agg(best.alias("keep_id"), F.sum("copies").alias("group_size"))
        out = out.unionByName(_kept(texts.join(groups, ["digest", "body"]), id_col))
    return out


def _with_hits(rows: DataFrame, hits: DataFrame, n_hits: int, digest_bytes: int, how: str) -> DataFrame:
    """rows joined with hits ("left" or "left_semi"), no task holding all rows of one digest."""
    small = sized(hits, n_hits, digest_bytes + 24)
    if small is not hits:
        return rows.join(small, "digest", how)
    heavy, light = F.broadcast(hits.filter(F.col("group_size") > HEAVY)), hits.filter(F.col("group_size") <= HEAVY)
    if how == "left_semi":
        return rows.join(heavy, "digest", "left_semi").unionByName(rows.join(heavy, "digest", "left_anti").join(light, "digest", "left_semi"))
    return rows.join(heavy, "digest").unionByName(rows.join(heavy, "digest", "left_anti").join(light, "digest", "left"))


def _kept(rows: DataFrame, id_col: str) -> DataFrame:
    copies = F.explode(F.when(F.col("copies") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("id", "keep_id", "group_size", "digest", copies.alias("copy")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest"
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs with one row of each group of equal texts, all columns. The dropped rows are
    anti-joined by identifier and digest; their table is broadcast up to a checked size."""
    name = "_digest"
    while name in docs.columns:
        name += "_"
    judged = exact_dedup(docs, id_col=id_col, text_col=text_col, keep=keep)
    judged = materialise(judged.select(F.col(id_col).alias("_id"), "keep_id", "kept", F.col("digest").alias("_d")), "lsm-judged")
    rows = docs.withColumn(name, digest_of(text_or_empty(text_col), 32))
    match = rows[id_col].eqNullSafe(F.col("_id")) & (rows[name] == F.col("_d"))
    gone = judged.filter(~F.col("_id").eqNullSafe(F.col("keep_id"))).select("_id", "_d")
    repeated = judged.filter(~F.col("kept") & F.col("_id").eqNullSafe(F.col("keep_id"))).select("_id", "_d").distinct()
    out = rows.join(sized(gone, gone.count(), 40), match, "left_anti")
    if not repeated.isEmpty():  # rows that repeat identifier and text
        once = out.join(repeated, match, "left_semi").dropDuplicates([id_col, name])
        out = out.join(repeated, match, "left_anti").unionByName(once)
    return out.drop(name)
