"""URL filter by the ratio of two character language models, in DataFrame operations only.

Hosts and paths are read from the URL; listed rules decide first (the longest that fits).
The rest is judged by two smoothed variable-order Markov models over the characters of the
whole URL after :// (host, path, query and fragment), one of accepted and one of rejected URLs: the chance of a character after its last three comes from
counts, smoothed with the chance after the last two, and so on (Dirichlet smoothing with a
fixed strength, so a context that was never seen falls back to the shorter one by itself).
The score is the log-likelihood difference (rejected minus accepted) per character.

Examples: rejected are URLs whose host holds one of two lists of words, accepted all others but
those that a rule blocks (rules block by language or zone, not by kind). Rejected examples of
the first list (SEEDS) are what the model learns from; hosts that hold only words of the second
(PROBES) are never learned from and stand for rejected hosts that no list names. The threshold is
calibrated on them and on a held-out fifth of the other examples: of 1,001 cuts, the one with the
least sum of the two error rates (unnamed and named hosts counting equally) among those that
reject at most max_false_rejects of the accepted ones, half way to the next score that occurs.
confusion() counts verdicts by what a host holds.

Characters are mapped to 32 symbols, so the models have 32**4 entries at most, whatever the
input; they travel as one array in a one-row table (4 MB), which every row is joined with by a
constant key: a broadcast of fixed size, as is that of the threshold. No URL or text is shuffled.

Null URLs and those without :// have an empty host and path; they score 0 and are allowed.
Rows that repeat are judged each; other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: (rule, verdict): host, then the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words in the hosts of URLs that serve as rejected examples, to learn from and to calibrate by.
SEEDS = ("spam", "pills", "casino", "porn", "viagra")
PROBES = ("bets", "adult", "ads-track", "poker", "loan")
ALPHABET = "abcdefghijklmnopqrstuvwxyz./-"
#: Symbols: letters, dot, slash, hyphen, 29 digit, 30 query and fragment marks, 31 others.
BITS, ORDER, STRENGTH = 5, 4, 4.0


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all that follows the host: path, query and fragment."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path, rest.substr(F.length(host) + 1, F.length(rest))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        zone, slash, start = text.partition("/")
        fits = ((host == zone) | host.endswith("." + zone)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return rule, verdict


def symbols(text: Column) -> Column:
    """The text's characters as numbers from 0 to 31."""
    folded = F.translate(F.lower(text), "0123456789?=&#_%~+:;,@!", "0" * 10 + "?" * 13)
    return F.transform(F.split(folded, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c) - 1, F.lit(-1)), F.when(c == "0", 29).when(c == "?", 30).otherwise(31)))


def codes(text: Column) -> Column:
    """The code of every run of four symbols of the text between marks of its start and end."""
    at = lambda s, i: F.get(s, i)
    code = lambda s, i: F.shiftleft(at(s, i), 15).bitwiseOR(F.shiftleft(at(s, i + 1), 10)).bitwiseOR(F.shiftleft(at(s, i + 2), 5)).bitwiseOR(at(s, i + 3))
    marked = symbols(F.concat(F.lit("   "), text, F.lit(" ")))
    return F.transform(F.array(marked), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - ORDER), lambda i: code(s, i)))[0]


def model(examples: DataFrame) -> DataFrame:
    """(rejected, codes) rows to 32**4 rows (code, weight): log chance of the fourth symbol
    after the three before it in the model of rejected URLs less that of accepted ones."""
    grams = examples.select("rejected", F.explode("codes").alias("code")).groupBy("code").agg(
        F.sum(F.when(F.col("rejected"), 1).otherwise(0)).alias("r"), F.sum(F.when(~F.col("rejected"), 1).otherwise(0)).alias("a")
    )
    grams = materialise(grams, "url-grams")  # 32**4 rows at most
    out = examples.sparkSession.range(1 << (BITS * ORDER)).select(F.col("id").cast("int").alias("code"))
    chance = {"r": F.lit(1 / 32), "a": F.lit(1 / 32)}
    joined = out
    for order in range(1, ORDER + 1):
        # Counts of the last `order` symbols, and of the context before the last of them.
        mask = (1 << (BITS * order)) - 1
        own = grams.groupBy(F.col("code").bitwiseAND(mask).alias(f"k{order}")).agg(F.sum("r").alias(f"r{order}"), F.sum("a").alias(f"a{order}"))
        context = own.groupBy(F.shiftright(f"k{order}", BITS).alias(f"c{order}")).agg(F.sum(f"r{order}").alias(f"rc{order}"), F.sum(f"a{order}").alias(f"ac{order}"))
        joined = joined.withColumn(f"k{order}", F.col("code").bitwiseAND(mask)).withColumn(f"c{order}", F.shiftright(f"k{order}", BITS))
        joined = joined.join(own, f"k{order}", "left").join(context, f"c{order}", "left")
        for m in "ra":
            seen, base = F.coalesce(f"{m}{order}", F.lit(0)), F.coalesce(f"{m}c{order}", F.lit(0))
            chance[m] = (seen + STRENGTH * chance[m]) / (base + STRENGTH)
    return joined.select("code", (F.log(chance["r"]) - F.log(chance["a"])).cast("float").alias("weight"))


def score(text_codes: Column, weights: Column) -> Column:
    """Sum of weights per symbol; 0 for an empty text."""
    total = F.aggregate(text_codes, F.lit(0.0), lambda acc, c: acc + F.get(weights, c))
    return total / F.greatest(F.size(text_codes), F.lit(1))


def threshold(scored: DataFrame, max_false_rejects: float) -> DataFrame:
    """One row (threshold) from held-out (rejected, unnamed, score) rows; null without rejected ones."""
    count = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    bins = scored.select("rejected", "unnamed", F.greatest(F.lit(-500), F.least(F.lit(500), F.ceil(F.col("score") * 100))).cast("int").alias("bin")).groupBy("bin").agg(
        count(F.col("rejected") & F.col("unnamed"), "u"), count(F.col("rejected") & ~F.col("unnamed"), "r"), count(~F.col("rejected"), "a")
    )
    up, all_rows = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda name: F.sum(name).over(up) / F.nullif(F.sum(name).over(all_rows), F.lit(0))
    rates = bins.select(  # 1,001 rows at most
        "bin",
        F.coalesce(F.lead("bin").over(Window.orderBy("bin")), F.col("bin")).alias("next_bin"),
        F.when(share("u").isNotNull() & share("r").isNotNull(), (share("u") + share("r")) / 2).otherwise(F.coalesce(share("u"), share("r"))).alias("missed"),
        (1 - share("a")).alias("false_rejects"),
    )
    best = rates.filter((F.col("false_rejects") <= max_false_rejects) & F.col("missed").isNotNull())
    return best.agg(F.min_by((F.col("bin") + F.col("next_bin")) / 200, F.struct(F.col("missed") + F.col("false_rejects"), -F.col("bin"))).alias("threshold"))


def holds(host: Column, words) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | host.contains(word)
    return test


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, seeds=SEEDS, probes=PROBES, max_false_rejects: float = 0.005) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score, threshold."""
    host, path, tail = parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), tail.alias("tail"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    named, probed = holds(F.col("host"), seeds), holds(F.col("host"), probes)
    base = base.withColumns({"rule": rule, "says": says, "rejected": named | probed, "unnamed": probed & ~named})
    # Schemes tell nothing of the page; very long URLs are read whole.
    base = base.withColumn("codes", F.when(F.col("host") == "", F.array().cast("array<int>")).otherwise(codes(F.concat("host", "tail")))).drop("tail")
    base = materialise(base, "url-codes")  # read three times below
    # By host and path: URLs that differ in their query alone fall on one side.
    held_out = (F.pmod(F.crc32(F.concat("host", "path")), F.lit(5)) == 0) | F.col("unnamed")
    example = (F.col("host") != "") & (F.col("rejected") | F.col("says").isNull() | (F.col("says") == "allow"))
    weights = model(base.filter(example & ~held_out))
    array = F.transform(F.array_sort(F.collect_list(F.struct("code", "weight"))), lambda x: x["weight"])
    one = F.broadcast(materialise(weights.agg(array.alias("weights")).withColumn("one", F.lit(0)), "url-model"))  # one row of 4 MB
    with_model = lambda df: df.withColumn("one", F.pmod(F.hash("host"), F.lit(1))).join(one, "one")
    scored = with_model(base.filter(example & held_out)).select("rejected", "unnamed", score(F.col("codes"), F.col("weights")).alias("score"))
    cut = F.broadcast(materialise(threshold(scored, max_false_rejects).withColumn("one", F.lit(0)), "url-threshold"))
    out = with_model(base).withColumn("score", score(F.col("codes"), F.col("weights"))).drop("weights").join(cut, "one")
    verdict = F.coalesce(F.col("says"), F.when((F.col("host") != "") & (F.col("score") > F.col("threshold")), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", "threshold")


def confusion(judged: DataFrame, *, seeds=SEEDS, probes=PROBES) -> DataFrame:
    """(holds, verdict, n) of filter_urls' rows that no rule decides: "seed", "probe" (a word that
    the models never saw in a rejected host) or "none"."""
    what = F.when(holds(F.col("host"), seeds), "seed").when(holds(F.col("host"), probes), "probe").otherwise("none")
    return judged.filter("rule IS NULL").groupBy(what.alias("holds"), "verdict").agg(F.count("*").alias("n"))
