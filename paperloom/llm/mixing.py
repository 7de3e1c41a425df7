"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sizes per document and source are counted in words. Targets share the wanted total by
   weight (the list of weights repeats over the sources in order); a source stops at
   max_repeats times its size and its excess is shared anew among the others by weight until
   none is above.
2. Each source is cut into blocks of MAX_BLOCK_WORDS, a tiny one into shorter blocks of its
   own. Sources with blocks of one length share what they are due together: whole numbers
   of blocks by highest quotients target / (2k - 1). Each source's blocks go on, by the same
   rule, to groups of FAN shards and from those to shards (its documents by hash of the
   identifier, about SHARD_WORDS each), so that no task holds all shards of a large source.
3. Within a shard, documents in seeded order form one stream of words, cut into blocks.
   Quota q of n blocks: with seeded offset u in [0, 1), block j is taken
   floor((j + 1) q / n + u) - floor(j q / n + u) times, which sums to q and never exceeds
   ceil(q / n). What a document contributes follows from prefix sums of its two ends.

Only (id, source, size) is shuffled, by (source, shard): a source with a third of all rows
is spread over its shards. The table of sources (name, words) is the only thing that reaches
the driver: a row for each source, however many documents it has. More than MAX_SOURCES of
them are an error, raised before any is fetched; the plan is joined by broadcast up to a
checked size and by shuffle beyond. Texts may be of any length: products are divided before
they are scaled. Null and empty texts have size 0 and are taken 0 times;
a null source is a source of its own, last in order. Reruns agree: order and offsets come
from hashes of identifiers and the seed; rows that repeat an identifier are told apart by
size and text hash, and rows that are wholly equal share what their places take in any order.
An empty table gives an empty plan.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, sized, trimmed, word_count

SHARD_WORDS = 1_000_000
#: Shards of a source that share a quota before it is dealt out to each.
FAN = 1024
MAX_SOURCES = 1_000_000
MAX_BLOCK_WORDS = 64
#: A source too small for so many blocks of that length (and no other) is cut into shorter ones.
BLOCKS_PER_SOURCE = 64
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: list[int], weights: list[float], share: float, max_repeats: float) -> list[float]:
    """share of all sizes by weight, each at most max_repeats times its size."""
    out = [0.0] * len(sizes)
    total, free = share * sum(sizes), {i for i, s in enumerate(sizes) if s > 0}
    while free:
        unit = total / sum(weights[i] for i in free)
        full = [i for i in sorted(free) if unit * weights[i] > max_repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
            total -= out[i]
            free.discard(i)
    return out


def sainte_lague(wanted: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients wanted / (2k - 1), k the next seat; i never above most[i].

    Starts from a count below which the rule cannot leave anyone and ends with a heap, so
    its cost follows the number of claimants, not of seats."""
    got = [0] * len(wanted)
    if not seats or not sum(wanted):
        return got
    divisor = sum(wanted) / seats
    for i, w in enumerate(wanted):
        got[i] = min(most[i], max(0, math.floor(w / divisor - 0.5)))
    quotients = [(-w / (2 * got[i] + 1), i) for i, w in enumerate(wanted) if w > 0 and got[i] < most[i]]
    heapq.heapify(quotients)
    left = seats - sum(got)
    while left > 0 and quotients:
        _, i = heapq.heappop(quotients)
        got[i] += 1
        left -= 1
        if got[i] < most[i]:
            heapq.heappush(quotients, (-wanted[i] / (2 * got[i] + 1), i))
    while left < 0:  # the floors gave too much: take back the lowest quotients
        i = min((i for i in range(len(got)) if got[i]), key=lambda i: (wanted[i] / (2 * got[i] - 1), -i))
        got[i] -= 1
        left += 1
    return got


def plan_sources(rows: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> list[dict]:
    """Targets, quotas of blocks and the length of a block for (source, words) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))  # str order is by code point
    sizes = [int(r[1]) for r in rows]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, max_repeats)
    words = [max(1, min(MAX_BLOCK_WORDS, s // BLOCKS_PER_SOURCE)) for s in sizes]
    quota = [0] * len(sizes)
    for block in set(words):
        group = [i for i, w in enumerate(words) if w == block]
        seats = sainte_lague([wanted[i] for i in group], round(sum(wanted[i] for i in group) / block), [max_repeats * -(-sizes[i] // block) for i in group])
        for i, q in zip(group, seats, strict=True):
            quota[i] = q
    return [
        {"source": r[0], "source_size": s, "target": t, "quota": q, "shards": max(1, s // SHARD_WORDS), "block_words": b}
        for r, s, t, q, b in zip(rows, sizes, wanted, quota, words, strict=True)
    ]


PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("quota", T.LongType()),
        T.StructField("shards", T.LongType()),
        T.StructField("block_words", T.LongType()),
    ]
)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: int = 20) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken; and where its words lie:
    first (of its shard's stream), blocks, quota, offset, block_words, for take_text()."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("turn"),
    )
    rows = materialise(rows, "mix-sizes")
    sums = materialise(rows.groupBy("source").agg(F.sum("size").alias("words")), "mix-sources")
    n_sources = sums.count()
    if n_sources > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources, {MAX_SOURCES} at most")
    plan = plan_sources([(r[0], r[1]) for r in sums.toLocalIterator()], weights, share, max_repeats)
    sources = spark.createDataFrame([tuple(p.values()) for p in plan], PLAN).withColumnRenamed("source", "s_source")
    longest = max((len((p["source"] or "").encode()) for p in plan), default=0)
    rows = rows.join(sized(sources, n_sources, longest + 40), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "turn"), F.col("shards")))
    # Quotas: a Sainte-Lague round within each source over groups of shards, then within each group.
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("quota", "source_size", "block_words")))
    shards = shard_quotas(shards, max_repeats)
    place = Window.partitionBy("source", "shard").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("last", F.sum("size").over(place)).withColumn("first", F.col("last") - F.col("size"))
    shards = shards.select(F.col("source").alias("h_source"), F.col("shard").alias("h_shard"), "blocks", F.col("quota").alias("shard_quota"), "offset")
    rows = rows.join(shards, rows.source.eqNullSafe(shards.h_source) & (rows.shard == shards.h_shard))
    taken = _prefix("last") - _prefix("first")
    return rows.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"),
        "turn", "first", "blocks", F.col("shard_quota").alias("quota"), "offset", "block_words",
    )


def _times(block: str) -> str:
    """How often the blocks before this one are taken in all: block * quota / blocks plus the
    offset (in millionths), in whole numbers; only the remainder is scaled."""
    made = f"(({block}) * shard_quota)"
    return f"({made} div blocks + ({made} % blocks * 1000000L + offset * blocks) div (blocks * 1000000L))"


def _prefix(at: str) -> Column:
    """Words taken of the first `at` words of the shard's stream."""
    block = f"{at} div block_words"
    whole = _times(block)
    return F.expr(f"CASE WHEN blocks = 0 THEN 0L ELSE block_words * {whole} + ({at} % block_words) * ({_times(f'{block} + 1')} - {whole}) END").cast("long")


def apportion(parts: DataFrame, parents: list[str], part: str) -> DataFrame:
    """(parents, part, words, most, quota, whole) with quota of the parent, of whole words, dealt
    to its parts: own_quota.

    Each part starts one seat below its share; what its parent has left goes by highest
    quotients over the next four seats of each, which is where the rule must end."""
    ideal = F.when(F.col("whole") > 0, F.col("quota") * (F.col("words") / F.col("whole"))).otherwise(0.0)
    base = parts.withColumn("least", F.least(F.greatest(F.floor(ideal) - 1, F.lit(0)), "most").cast("long"))
    base = base.withColumn("left", F.col("quota") - F.sum("least").over(Window.partitionBy(*parents)))
    seats = base.select(*parents, part, "left", "words", F.explode(F.expr("filter(sequence(least + 1, least + 4), k -> k <= most)")).alias("seat"))
    turn = Window.partitionBy(*parents).orderBy(F.desc(F.col("words") / (2 * F.col("seat") - 1)), part, "seat")
    won = seats.withColumn("rank", F.row_number().over(turn)).filter("rank <= left").groupBy(*parents, part).agg(F.count("*").alias("won"))
    won = won.select(*(F.col(c).alias(f"w_{c}") for c in (*parents, part)), "won")
    same = base[part] == F.col(f"w_{part}")
    for c in parents:
        same = same & base[c].eqNullSafe(F.col(f"w_{c}"))
    out = base.join(won, same, "left").withColumn("own_quota", F.col("least") + F.coalesce("won", F.lit(0)))
    return out.drop("least", "left", "won", *(f"w_{c}" for c in (*parents, part)))


def shard_quotas(shards: DataFrame, max_repeats: int) -> DataFrame:
    """(source, shard, words, quota, source_size, block_words) to source, shard, blocks, quota and offset."""
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / F.col("block_words")).cast("long")).withColumn("most", F.col("blocks") * max_repeats)
    shards = materialise(shards.withColumn("fan", F.expr(f"shard div {FAN}")), "mix-shards")
    groups = shards.groupBy("source", "fan").agg(F.sum("words").alias("words"), F.sum("most").alias("most"), F.first("quota").alias("quota"), F.first("source_size").alias("whole"))
    groups = apportion(groups, ["source"], "fan").select(F.col("source").alias("g_source"), F.col("fan").alias("g_fan"), F.col("own_quota").alias("g_quota"), F.col("words").alias("g_words"))
    inner = shards.drop("quota").join(groups, shards.source.eqNullSafe(groups.g_source) & (shards.fan == groups.g_fan))
    inner = inner.select("source", "fan", "shard", "blocks", "words", "most", F.col("g_quota").alias("quota"), F.col("g_words").alias("whole"))
    return apportion(inner, ["source", "fan"], "shard").select("source", "shard", "blocks", F.col("own_quota").alias("quota"), F.pmod(F.xxhash64(F.lit(7), "source", "shard"), F.lit(1_000_000)).alias("offset"))


def copies_of(text: str | None, first: int, blocks: int, quota: int, offset: int, block_words: int) -> list[str]:
    """The texts that the mix takes of one document: its words in blocks taken once, then in
    blocks taken twice and so on, each as one text with its own white space."""
    if not text or not blocks:
        return []
    times = lambda j: j * quota // blocks + (j * quota % blocks * 1_000_000 + offset * blocks) // (blocks * 1_000_000)
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    if not spans:
        return []
    runs: list[list[list[int]]] = []
    for j in range(first // block_words, (first + len(spans) - 1) // block_words + 1):
        a, b = max(0, j * block_words - first), min(len(spans), (j + 1) * block_words - first)
        for k in range(times(j + 1) - times(j)):
            while len(runs) <= k:
                runs.append([])
            if runs[k] and runs[k][-1][1] == a:
                runs[k][-1][1] = b
            else:
                runs[k].append([a, b])
    pieces = lambda run: [text[0 if a == 0 else spans[a][0] : len(text) if b == len(spans) else spans[b - 1][1]] for a, b in run]
    return [" ".join(pieces(run)) for run in runs if run]


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **settings) -> DataFrame:
    """The mix itself: docs' columns, one row for each text that copies_of() takes of a document
    (chars_col, where docs has it, tells its new length)."""
    seed = settings.setdefault("seed", 20)
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings).filter("taken > 0")
    plan = materialise(plan.select(F.col(id_col).alias("_id"), F.col("turn").alias("_turn"), "first", "blocks", "quota", "offset", "block_words"), "mix-plan")
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    held = held.withColumns({"_id": F.col(f"doc.`{id_col}`"), "_turn": F.xxhash64(F.lit(seed), f"doc.`{id_col}`", f"doc.`{text_col}`")})
    if plan.count() > plan.select("_id", "_turn").distinct().count():  # equal rows: each place once
        held = held.dropDuplicates(["_id", "_turn"])
    joined = held.join(plan.withColumnRenamed("_id", "_p").withColumnRenamed("_turn", "_t"), F.col("_id").eqNullSafe(F.col("_p")) & (F.col("_turn") == F.col("_t")))

    columns = docs.columns
    # Only what copies_of() reads goes to Python; it gives the texts back, some rows at a time.
    texts = joined.select("doc", F.struct(F.col(f"doc.`{text_col}`").alias("text"), "first", "blocks", "quota", "offset", "block_words").alias("cut"))
    out = texts.select("doc", F.explode(taken_texts()("cut")).alias("_taken"))
    value = {text_col: F.col("_taken")} | ({chars_col: F.length("_taken").cast(dict(docs.dtypes)[chars_col])} if chars_col in columns else {})
    return out.select(*(value.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns))


def taken_texts():
    """copies_of() as a function of struct columns, in Arrow batches."""

    @trimmed
    def run(batches):
        for cuts in batches:
            text, *numbers = (cuts.field(i) for i in range(6))
            rows = zip(*(x.to_pylist() for x in numbers), strict=True)
            yield pa.array([copies_of(t.as_py(), *row) for t, row in zip(text, rows, strict=True)], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def taken(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return taken
