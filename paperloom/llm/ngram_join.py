"""Similarity join on word n-grams: Jaccard of five-word shingle sets, at least 0.8.

1. Every text becomes the set of hashes of its shingles, a digest of that set and 128 MinHash
   values (16 bits each). Texts with equal sets are one class with one representative.
2. Candidates: representatives that agree on any of 32 bands of four values. A pair at the
   threshold is missed with chance (1 - 0.8**4)**32 < 5e-8.
3. Within a bucket, MinHash values are compared 16 at a time. After n comparisons with m
   agreements (uniform prior) the chance that the similarity reaches the threshold is
   P(Bin(n + 1, threshold) <= m); a pair is dropped when it falls below the tolerance (1e-7).
   Survivors leave a spanning forest, not pairs; its components are clusters.
4. Within a cluster, pairs are pruned in the same way and the rest verified exactly on the
   sets of 64-bit shingle hashes. Each member keeps its number of links; verified links leave
   a spanning forest again, whose components are the classes.

Buckets and clusters of more than BLOCK members (or SHINGLES shingles) are dealt out as pairs
of blocks, so no task or group grows with them and no pair is lost; pairs are only held
within a task, one block pair at a time. Nothing of a size that grows with the input comes
to the driver; tables are broadcast only up to a checked size in bytes.

Words are runs of characters other than white space, compared as they are. Texts of one to
four words have one shingle, the whole text; null texts and texts without words link to
nothing. Identifiers may be of any type that has an order. A row with a null identifier links
to nothing and has a null class. Rows that repeat an identifier are documents of their own,
whatever their texts: each row's class follows from its text, and equal texts count as
copies. An empty table gives no rows. Other columns are left aside.

Representatives are numbered in order of their least identifier (ties: by digest), so the least
number of a class stands for its least identifier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, sized, trimmed, write_table
from .components import connected_components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
BLOCK = 256
SHINGLES = 1 << 19
_rng = np.random.default_rng(0x5EED)
FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
FACTOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
    if k < n:
        out += np.uint64(k)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        low = np.minimum(low, ((short[i : i + 1024, None] ^ FLIP) * FACTOR).min(0))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def least_agreements(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... comparisons: fewer agreements than this drop the pair."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, 0
        while True:
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def prune(a: np.ndarray, b: np.ndarray, sigs: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of sigs that stay in reach of the threshold."""
    agreed = np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        if not len(a):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        keep = np.empty(len(a), bool)
        for i in range(0, len(a), 1 << 17):
            j = slice(i, i + (1 << 17))
            agreed[j] += (sigs[a[j], part] == sigs[b[j], part]).sum(1)
            keep[j] = agreed[j] >= m
        a, b, agreed = a[keep], b[keep], agreed[keep]
    return a, b


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows is connected to."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            break
    return label


def pairs_of(start: int, stop: int, own: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group's rows; of a group of two blocks, those between them."""
    if split:
        left, right = start + np.flatnonzero(own), start + np.flatnonzero(~own)
        return np.repeat(left, len(right)), np.tile(right, len(left))
    i, j = np.triu_indices(stop - start, 1)
    return start + i, start + j


def by_group(batches, keys: list[str], weight: int) -> Iterator[dict[str, pa.Array]]:
    """Tables of whole groups (consecutive rows with equal keys), some groups at a time: as
    many as come to `weight` pairs."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        n = table.num_rows
        if not n:
            return table, None
        changed = np.zeros(n - 1, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            changed |= x[1:] != x[:-1]
        edges = np.r_[0, 1 + np.flatnonzero(changed), n]
        done = len(edges) - 1 - (not last)
        return table, edges[: done + 1]

    for batch in batches:
        held.append(batch)
        table, edges = cut(pa.Table.from_batches(held), False)
        if edges is not None and len(edges) > 1:
            yield from _portions(table, edges, weight)
            held = table.slice(int(edges[-1])).combine_chunks().to_batches()
    if held:
        table, edges = cut(pa.Table.from_batches(held), True)
        if edges is not None and len(edges) > 1:
            yield from _portions(table, edges, weight)


def _portions(table: pa.Table, edges: np.ndarray, weight: int):
    sizes = np.diff(edges)
    load = np.cumsum(sizes * (sizes - 1) // 2 + sizes)
    i = 0
    while i < len(sizes):
        before = load[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(load, before + weight, side="right")))
        yield table.slice(int(edges[i]), int(edges[j] - edges[i])), edges[i : j + 1] - edges[i]
        i = j


def candidate_pairs(table: pa.Table, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = table.column("own").to_numpy()
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    got = [pairs_of(s, t, own[s:t] == lo[s], bool(lo[s] != hi[s])) for s, t in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if t - s > 1]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def common(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    # Many pairs of few sets: columns are hashes that occur more than once, multiplied in slices.
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], column[shared]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (8 << 20) // max(1, len(sets)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, t = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[s:t], column[s:t] - start] = 1
        total += part @ part.T
    return np.rint(total[a, b]).astype(np.int64)


def _dealt(df: DataFrame, keys: list[str], members: str, total: str) -> DataFrame:
    """Rows of each group dealt to pairs of blocks (lo, hi); own is the row's block. Ordered for by_group."""
    blocks = F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(total) / SHINGLES)).cast("int")
    df = df.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks", members, total)
    keys = [*keys, "lo", "hi"]
    # A number of its own: the work of a partition is far from its bytes, by which small ones would be joined.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def digest_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, digest, n, sig): sig holds the bands, four values in each."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                digests, sizes, sigs = [], [], []
                for text in part.column(1):
                    grams = shingles(text.as_py(), n)
                    digests.append(digest_of(grams))
                    sizes.append(len(grams))
                    sigs.append(signature(grams))
                flat = np.concatenate(sigs).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["id", "digest", "n", "sig"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(trimmed(run), f"id {kind}, digest binary, n long, sig array<long>")


def _sigs(table: pa.Table) -> np.ndarray:
    flat = table.column("sig").combine_chunks().flatten().to_numpy()
    return flat.view(np.uint16).reshape(table.num_rows, HASHES)


def _in_buckets(least: list[int]) -> Callable:
    @trimmed
    def run(batches):
        for table, edges in by_group(batches, ["band", "key", "lo", "hi"], 1 << 19):
            a, b = prune(*candidate_pairs(table, edges), _sigs(table), least)
            label = forest(a, b, table.num_rows)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                rep = table.column("rep").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], names=["u", "v"])

    return run


def _in_clusters(least: list[int], threshold: float) -> Callable:
    @trimmed
    def run(batches):
        for table, edges in by_group(batches, ["cluster", "lo", "hi"], 1 << 17):
            rep, copies, sigs = table.column("rep").to_numpy(), table.column("copies").to_numpy(), _sigs(table)
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("grams")]
            a, b = candidate_pairs(table, edges)
            differ = rep[a] != rep[b]
            a, b = prune(a[differ], b[differ], sigs, least)
            if not len(a):
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            both = common(a, b, sets)
            near = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
            a, b = a[near], b[near]
            links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
            label = forest(a, b, len(rep))
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[label[on]]), pa.array(links[on].astype(np.int64))], names=["u", "v", "links"])

    return run


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """One row per document: id, class_id (the least identifier of its class of linked
    documents) and n_links (other documents that are at least that similar)."""
    least = least_agreements(threshold, tolerance)
    spark = docs.sparkSession
    all_rows = materialise(sketch(docs, id_col, text_col, n), "ngram-sketch")
    reps = all_rows.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # Numbers grow with the partition and within it, so they follow the order of the sort.
    reps = materialise(reps.orderBy("least_id", "digest").withColumn("rep", F.monotonically_increasing_id()), "ngram-reps")
    banded = reps.select("rep", "n", F.posexplode("sig").alias("band", "key"))
    buckets = materialise(banded.groupBy("band", "key").agg(F.count("*").alias("members"), F.sum("n").alias("total")).filter("members > 1"), "ngram-buckets")
    members = banded.drop("n").join(sized(buckets, buckets.count(), 28), ["band", "key"])
    members_path, members = write_table(members.join(reps.select("rep", "sig"), "rep"), "ngram-members")
    dealt = _dealt(members.withColumn("total", F.lit(0)), ["band", "key"], "members", "total")
    clusters = connected_components(dealt.mapInArrow(_in_buckets(least), "u long, v long"), "ngram-near")
    remove(spark, members_path)
    clusters = clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).join(reps.select("rep", "least_id", "digest", "copies", "n"), "rep")
    clusters = materialise(clusters, "ngram-clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    wanted = clusters.drop("n").join(sizes, "cluster")

    @trimmed
    def with_sets(batches):
        """Sets of the texts whose identifier is a representative's, where it is the same text too."""
        names = ["rep", "cluster", "copies", "members", "total"]
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                grams = [shingles(t.as_py(), n) for t in part.column("body")]
                mine = [i for i, (g, d) in enumerate(zip(grams, part.column("digest"), strict=True)) if digest_of(g) == d.as_py()]
                if not mine:
                    continue
                part, grams = part.take(pa.array(mine)), [grams[i] for i in mine]
                flat = np.concatenate([signature(g) for g in grams]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, pa.array([g.tobytes() for g in grams], pa.binary())], names=[*names, "sig", "grams"])

    texts = docs.select(F.col(id_col).alias("least_id"), F.col(text_col).alias("body")).join(sized(wanted, clusters.count(), 72), "least_id")
    sets = texts.mapInArrow(with_sets, "rep long, cluster long, copies long, members long, total long, sig array<long>, grams binary").dropDuplicates(["rep"])
    links = _dealt(sets, ["cluster"], "members", "total").mapInArrow(_in_clusters(least, threshold), "u long, v long, links long")
    links = materialise(links, "ngram-links")
    classes = connected_components(links.select("u", "v"), "ngram-class")
    classes = classes.join(links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    classes = classes.join(reps.select(F.col("rep").alias("root"), F.col("least_id").alias("class_id")), "root")
    of_rep = reps.select("digest", "rep", "least_id", "copies").join(classes.select(F.col("node").alias("rep"), "class_id", "links"), "rep", "left")
    of_rep = of_rep.select("digest", F.coalesce("class_id", "least_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Only texts with company are looked up; a text of its own has its identifier for a class.
    company = materialise(of_rep.filter("n_links > 0"), "ngram-company")
    rows = all_rows.select("id", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = rows.join(sized(company, company.count(), 60), "digest", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with the documents of one identifier of each class, the least; all columns. (Rows that
    repeat that identifier stay; exact dedup is another operator's.)
    Dropped identifiers are anti-joined; their table is broadcast up to a checked size."""
    classes = ngram_join(docs, id_col=id_col, text_col=text_col, **settings)
    gone = materialise(classes.filter(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct(), "ngram-gone")
    return docs.join(sized(gone, gone.count(), 24), docs[id_col] == F.col("_gone"), "left_anti")
