"""Toxicity by maximum-scoring segments of token log-odds.

1. Token counts (documents that hold a token) over all documents give an informative
   Dirichlet prior; those of labelled documents give each token's log-odds between the two
   classes and its z-score. Copies of one text count once. Tokens in min_docs labelled documents
   (if toxic, in as many toxic ones) with |z| >= min_z and log-odds of at least min_weight form
   the lexicon; every other token scores -drift.
2. A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments. Runs of tokens
   outside the lexicon are one negative score, and a text without any toxic token needs no scan.
3. Karlin-Altschul statistics calibrate segments: lambda solves sum p exp(lambda s) = 1 with the
   frequencies of tokens in clean texts; the best segment of a clean text of m tokens then has
   the extreme-value law exp(-K m exp(-lambda S)), whose K is its maximum-likelihood value over
   the clean texts that the lexicon comes from. E = K m exp(-lambda S). Segments with E below
   max_e are significant passages; a document's evidence is the sum of their -ln E.
4. Evidence becomes a probability by isotonic regression on labelled documents that gave no
   token counts (another fold).

All terms that pass the tests are in the lexicon. Toxic ones and the CLEAN_TERMS clean-class ones
with the largest |z| are each worker's dictionary; further clean-class terms stay a table, which is
joined to the texts that hold a toxic term (no other text is scanned), so each counts with its
weight there too. Tokens are runs of letters and digits, each
in lower case by itself, so places are those of the text as it is. Null and empty texts have no
evidence and get the score of that. Without labels of both
classes every score is the base rate (0 where there is none). Rows that repeat are scored
each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized, text_or_empty, trimmed

#: Clean-class terms in the dictionary that each worker holds; the others are joined.
CLEAN_TERMS = 100_000
BINS = 400
TOKEN = re.compile(r"[^\W_]+")
#: Letters whose lower case depends on the text around them, or has more characters than they.
UNEVEN = re.compile("[\u03a3\u0130]")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.2
    decay: float = 1.0
    factor: float = 0.1
    max_e: float = 0.05
    curve: list[float] = field(default_factory=lambda: [0.0] * (BINS + 1))
    #: Terms beyond the dictionary (token, w), and how many.
    rest: DataFrame | None = None
    n_rest: int = 0

    def scan(self, text: str, more: Mapping[str, float] | None = None) -> tuple[int, float, list[tuple[int, int, float]]]:
        """Number of tokens, best score and all maximal segments (start, end, score). more: the
        weights of those terms of the rest that the text holds."""
        hits, before, tokens = [], 0, 0
        for tokens, m in enumerate(TOKEN.finditer(text), 1):
            token = m[0].lower()
            w = self.weights.get(token)
            if w is None and more:
                w = more.get(token)
            if w is not None:
                hits.append((w, (tokens - 1 - before) * -self.drift, m.start(), m.end()))
                before = tokens
        found = segments(hits)
        return tokens, max((x[2] for x in found), default=0.0), found

    def passages(self, text: str, more: Mapping[str, float] | None = None) -> list[tuple[int, int, float, float]]:
        """(start, end, score, E) of the significant maximal segments, in code points."""
        tokens, _, found = self.scan(text, more)
        return self.significant(tokens, found)

    def significant(self, tokens: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
        out = []
        for s, e, score in found:
            expect = self.factor * max(tokens, 1) * math.exp(-min(700.0, self.decay * score))
            if expect <= self.max_e:
                out.append((s, e, score, expect))
        return out


def segments(hits: list[tuple[float, float, int, int]]) -> list[tuple[int, int, float]]:
    """Ruzzo-Tompa over (weight, score of the gap before it, start, end): all maximal scoring
    segments as (start, end, score)."""
    found: list[list[float]] = []  # start, end, total before, total up to its end
    total = 0.0
    for weight, gap, start, end in hits:
        total += gap
        if weight <= 0:
            total += weight
            continue
        left, total = total, total + weight
        new = [start, end, left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(s), int(e), r - le) for s, e, le, r in found]


def tokens(text: Column) -> Column:
    """All tokens of a text, in order. Only texts with uneven letters need a pass over tokens."""
    cut = lambda t: F.array_remove(F.split(t, r"[^\p{L}\p{N}]+"), "")
    return F.when(text.rlike(UNEVEN.pattern), F.transform(cut(text), F.lower)).otherwise(cut(F.lower(text)))


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lexicon_folds=(1, 2, 3), curve_folds=(4,), prior_strength: float = 5_000.0, min_z: float = 2.0, min_weight: float = 1.0, min_docs: int = 5, drift: float = 0.2) -> Model:
    """Fold 0 is never looked at: the labels of a document count by crc32(id) mod 5."""
    spark = docs.sparkSession
    labels = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    labels = materialise(labels.withColumn("fold", fold(F.col("id"))).filter(F.col("fold").isin(*lexicon_folds, *curve_folds)), "toxic-labels")
    n_labels = labels.count()
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    learn = labels.filter(F.col("fold").isin(*lexicon_folds)).select("id", "toxic")
    # One row for each labelled text, whatever its copies.
    once = base.select("id", F.xxhash64("body").alias("h")).join(sized(learn, n_labels, 16), "id").groupBy("h").agg(F.min(F.struct("id", "toxic")).alias("x")).select("x.*")
    once = materialise(once.groupBy("id").agg(F.max("toxic").alias("toxic")), "toxic-learn")
    rows = base.join(sized(once, n_labels, 16), "id", "left").select("toxic", F.explode(F.array_distinct(tokens(F.col("body")))).alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("x"))
    # Tokens in fewer labelled documents than min_docs cannot enter; their sums still count.
    counts = materialise(counts.withColumn("rare", (F.col("y") + F.col("x")) < min_docs).groupBy("rare", F.when(~F.col("rare"), F.col("token")).alias("token")).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("x").alias("x")), "toxic-counts")
    n, y, x = counts.agg(F.sum("n"), F.sum("y"), F.sum("x")).first()
    model = Model(drift=drift)
    if y and x:
        a = F.col("n") * (prior_strength / n)
        odds = lambda c, total: F.log((F.col(c) + a) / (total + prior_strength - F.col(c) - a))
        scored = counts.filter("not rare").select("token", "y", "x", (odds("y", y) - odds("x", x)).alias("w"), (1 / (F.col("y") + a) + 1 / (F.col("x") + a)).alias("var"))
        scored = scored.withColumn("z", F.col("w") / F.sqrt("var")).filter((F.abs("z") >= min_z) & (F.abs("w") >= min_weight) & ((F.col("z") < 0) | (F.col("y") >= min_docs)))
        scored = materialise(scored.select("token", "z", F.greatest(F.lit(-6.0), F.least(F.lit(6.0), "w")).alias("w")), "toxic-terms")
        first = scored.filter("w < 0").orderBy("z", "token").limit(CLEAN_TERMS).collect()
        terms = [*scored.filter("w > 0").collect(), *first]
        model.weights = {t.token: t.w for t in terms}
        model.n_rest = scored.filter("w < 0").count() - len(first)
        if model.n_rest:
            z, token = (first[-1].z, first[-1].token) if first else (-math.inf, "")
            after = (F.col("z") > z) | ((F.col("z") == z) & (F.col("token") > token))
            model.rest = materialise(scored.filter("w < 0").filter(after).select("token", "w"), "toxic-rest")
        # Frequencies and best segments in the clean texts of the learning folds.
        clean = materialise(base.join(sized(once.filter("toxic = 0"), n_labels, 16), "id", "left_semi").select("body"), "toxic-clean")
        words = materialise(clean.select(F.explode(tokens(F.col("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "toxic-words")
        lexicon = spark.createDataFrame([(t,) for t in model.weights] or [("",)], "token string")
        often = {r.token: r.n for r in words.join(sized(lexicon, len(terms), 32), "token").collect()}  # a row per term
        all_words = words.agg(F.sum("n")).first()[0] or 1
        scores = [(w, (often.get(t, 0) + 0.5) / all_words) for t, w in model.weights.items()]
        if model.rest is not None:
            # A row for each weight, however many terms have it: terms with the same counts share one.
            shared = model.rest.join(words, "token", "left").groupBy("w").agg(F.sum(F.coalesce("n", F.lit(0)) + 0.5).alias("n"))
            scores += [(r.w, r.n / all_words) for r in shared.toLocalIterator()]
        model.decay = decay(scores, drift)
        best = measured(clean, model, F.col("body"), "m").select("m.*").filter("tokens > 0")
        reached, expected = best.agg(F.sum((F.col("top") > 0).cast("long")), F.sum(F.col("tokens") * F.exp(-model.decay * F.col("top")))).first()
        model.factor = factor_of(reached or 0, expected or 0.0)
    seen = base.join(sized(labels.filter(F.col("fold").isin(*curve_folds)).select("id", "toxic"), n_labels, 16), "id")
    bins = measured(seen, model, F.col("body"), "m").select("toxic", bin_of(F.col("m.evidence")).alias("bin")).groupBy("bin").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    model.curve = curve({r.bin: (r.p, r.n) for r in bins.collect()})  # BINS + 1 rows at most
    return model


def factor_of(reached: float, expected: float) -> float:
    """K, the maximum of the likelihood of best scores S of texts of m tokens under
    exp(-K m exp(-lambda S)): texts with a best segment over the sum of m exp(-lambda S)
    (S = 0 without one). Between 1e-4 and 1."""
    return min(1.0, max(1e-4, reached / expected)) if expected else 0.1


def tail_factor(tops: list[tuple[int, float]], rate: float) -> float:
    """K of (tokens, best score) rows."""
    return factor_of(sum(s > 0 for _, s in tops), sum(m * math.exp(-rate * s) for m, s in tops))


def decay(scores: list[tuple[float, float]], drift: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; tokens outside the lexicon score -drift."""
    s, p = np.array(scores, float).reshape(-1, 2).T
    rest = max(0.0, 1 - p.sum())
    excess = lambda v: rest * math.exp(-drift * v) + (p * np.exp(v * s)).sum() - 1
    low, high = 1e-6, 20.0
    if not (s > 0).any() or excess(low) >= 0:
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def bin_of(evidence: Column) -> Column:
    return F.least(F.ceil(evidence * 4), F.lit(BINS)).cast("int")


def curve(bins: dict[int, tuple[int, int]]) -> list[float]:
    """Probability at each bin: isotonic regression, each level smoothed by one row at the base rate."""
    n = sum(v[1] for v in bins.values())
    rate = sum(v[0] for v in bins.values()) / n if n else 0.0
    pools: list[list[float]] = []  # first bin, last bin, positives, rows
    for b in sorted(bins):
        pools.append([b, b, *bins[b]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, p, k = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + p, pools[-1][3] + k]
    out, at = [], 0
    for b in range(BINS + 1):
        # Bins between two levels that no document fell into are shared half and half.
        while at + 1 < len(pools) and 2 * b > pools[at][1] + pools[at + 1][0]:
            at += 1
        out.append((pools[at][2] + rate) / (pools[at][3] + 1) if pools else rate)
    return out


def measure(model: Model):
    """A function of a text column: struct<evidence, tokens, top, passages>. Texts without any toxic
    term count as tokens = length in characters over five, which is all that K needs of them. For a
    model with a rest, a function of the text, its terms of the rest and their weights (null: none)."""
    positive = [t for t, w in model.weights.items() if w > 0]
    kind, own = "evidence double, tokens long, top double, passages array<struct<start:int,end:int,score:double,e:double>>", replace(model, rest=None)

    def run(batches):
        search = toxic_search(positive)  # once per task
        for texts, names, weights in batches:
            evidence, sizes, tops, found = [], [], [], []
            for i, text in enumerate(texts):
                parts, size, top = [], len(text or "") // 5, 0.0
                if text and search(text):
                    more = None if names is None or names.iloc[i] is None else dict(zip(names.iloc[i], weights.iloc[i], strict=True))
                    size, top, spans = own.scan(text, more)
                    parts = own.significant(size, spans)
                evidence.append(float(sum(-math.log(max(e, 1e-300)) for *_, e in parts)))
                sizes.append(size)
                tops.append(top)
                found.append([{"start": s, "end": t, "score": v, "e": e} for s, t, v, e in parts])
            yield pd.DataFrame({"evidence": evidence, "tokens": sizes, "top": tops, "passages": found})

    run = trimmed(run)

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run((texts, None, None) for texts in batches)

    @F.pandas_udf(kind)
    def of_both(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    return of if model.rest is None else of_both


def toxic_search(positive: list[str]):
    """Whether a text may hold a toxic term: false only where it holds none."""
    import ahocorasick

    search = ahocorasick.Automaton()
    for term in positive:
        search.add_word(term, 1)
    if not positive:
        return lambda text: False
    search.make_automaton()
    return lambda text: bool(UNEVEN.search(text)) or next(search.iter(text.lower()), None) is not None


def holding(model: Model):
    """A function of a text column: may it hold a toxic term?"""
    positive = [t for t, w in model.weights.items() if w > 0]

    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = toxic_search(positive)
        for texts in batches:
            yield pd.Series([search(text) for text in texts], dtype=bool)

    return of


def measured(df: DataFrame, model: Model, text: Column, name: str) -> DataFrame:
    """df with a column `name`: what measure() has of its texts. Where the model has a rest, each
    text that may hold a toxic term gets its terms of the rest, joined by the text's digest."""
    body = F.coalesce(text, F.lit(""))
    if model.rest is None:
        return df.withColumn(name, measure(model)(body))
    key, names, weights = (f"{name}_{x}" for x in ("key", "names", "weights"))
    keyed = df.withColumn(key, F.sha2(body, 256))
    # Only digests and terms are shuffled here, and copies of one text give one row.
    held = df.select(body.alias("body")).filter(holding(model)(F.col("body"))).select(F.sha2("body", 256).alias(key), F.explode(F.array_distinct(tokens(F.col("body")))).alias("token"))
    held = held.join(sized(model.rest, model.n_rest, 40), "token").groupBy(key).agg(F.collect_set(F.struct("token", "w")).alias("terms"))
    held = materialise(held.select(key, F.col("terms.token").alias(names), F.col("terms.w").alias(weights)), "toxic-held")
    return keyed.join(held, key, "left").withColumn(name, measure(model)(body, F.col(names), F.col(weights))).drop(key, names, weights)


def score(model: Model, found: Column) -> Column:
    """struct<score, evidence, passages> of what measure() found."""
    levels = F.array(*map(F.lit, model.curve))
    return F.transform(F.array(found), lambda m: F.struct(F.get(levels, bin_of(m["evidence"])).alias("score"), m["evidence"].alias("evidence"), m["passages"].alias("passages")))[0]


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted, evidence, passages."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    out = measured(docs.select(F.col(id_col), F.col(text_col).alias("_body")), model, F.col("_body"), "_m")
    out = out.select(F.col(id_col), score(model, F.col("_m")).alias("s"))
    return out.select(id_col, (fold(F.col(id_col)) == 0).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"), F.col("s.passages").alias("passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents with a score below limit, all their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    name = "_toxic"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    out = measured(docs, model, F.col(text_col), name)
    return out.filter(score(model, F.col(name))["score"] < limit).drop(name)
