"""Secrets: multipart credential linking, in DataFrame operations only.

Base spans (assignments, access identifiers, long hexadecimal runs) come from fixed patterns.
Parts of credentials are weak candidates: identifiers (runs of capitals and digits, values of
user or client fields), secrets (long mixed runs, signed tokens, private keys) and endpoints
(URLs, host names of services). By itself none is reported. A text is cut into scopes: blank
lines, headers of sections and braces of objects end one. A sweep over each document's parts
in order of place joins, within a scope, the intervals of window characters around them: it
carries the last end of each kind forwards and the next start backwards, so its cost follows
the number of parts, not of pairs, and no row leaves its task. An identifier with a secret in
its scope is reported, so is a secret with an identifier, and an endpoint with both. Base spans
act as parts too.

Null text counts as empty and gives no spans. Rows that repeat are judged each; other columns
are left aside. Spans that overlap a base span are not added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, text_or_empty
from .spans import find, holds, joined, let, none_of, related, scan

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?=[0-9a-f])(?<![0-9a-f])[0-9a-f]{32,}+"
#: Weak parts, of any length: a span reaches the end of its run.
IDENTIFIER = r"(?<![A-Za-z0-9])(?:[A-Z0-9]{16,}+(?![A-Za-z0-9])|(?i:client_?id|account_?id|user(?:name)?|login)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9._@-]{4,}+)"
SECRET = r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++|-----BEGIN [A-Z ]*+PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]*+PRIVATE KEY-----|[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_-]))"
ENDPOINT = r"(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/?&=%-]{4,}+|(?<![A-Za-z0-9.-])(?i:host|endpoint|server|region)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9.-]{4,}+"
#: What any secret and any identifier without a name holds.
LONG_RUN = r"(?=[A-Za-z0-9+/_-])(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}"
#: Ends of scopes: blank lines, the start of a section's header, braces of objects.
BREAK = r"\n[\x20\t\r]*+\n|\n(?=\[[A-Za-z0-9 ._:-]++\][\x20\t\r]*+(?:\n|$))|[{}]"
WINDOW = 400

PART = "struct<start:int,o:int,end:int,kind:string>"
LINKED = f"struct<p:{PART},i:boolean,s:boolean>"


def part(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("o"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: str) -> Column:
    assign = F.filter(find(text, ASSIGN, guard=holds(text, ":", "=")), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN_VALUE, 1)) >= 8)
    access = F.filter(find(text, ACCESS, guard=holds(text, "AKIA")), lambda s: F.length(s["m"]) >= 16)
    return F.array_sort(F.concat(part(assign, "assign", 0), part(access, "access", 1), part(find(text, HEX), "hex", 2)))


def weak_parts(text: str) -> Column:
    """Identifiers and secrets."""
    mixed = lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]")
    varied = lambda s: mixed(s) & s["m"].rlike("[a-z]") & (s["m"].rlike("[A-Z]") | s["m"].rlike("^[0-9a-z]+$"))
    named = lambda s: s["m"].rlike("[:=]")
    long = F.col(text).rlike(LONG_RUN)
    return F.concat(
        part(F.filter(find(text, IDENTIFIER, guard=long | holds(text, ":", "=")), lambda s: named(s) | mixed(s)), "identifier", 3),
        part(F.filter(find(text, SECRET, guard=long | holds(text, "eyJ")), varied), "credential", 4),
    )


def _class(kind: str) -> str:
    """0 identifier, 1 secret, 2 endpoint, 3 end of a scope."""
    return f"CASE WHEN {kind} IN ('access', 'identifier') THEN 0 WHEN {kind} = 'endpoint' THEN 2 WHEN {kind} = 'break' THEN 3 ELSE 1 END"


def link(parts: str, window: int) -> Column:
    """Of parts in order of place (ends of scopes among them), those whose complements lie
    within the window and the scope.

    One pass each way: the state holds, for identifiers and secrets, the end that reaches
    furthest (backwards, the start that lies nearest) since the last end of a scope. Distances
    are negative within a longer part, which is as near as can be."""
    state, unseen = "struct<i:int,s:int>", "named_struct('i', NULL, 's', NULL)"
    mine = _class("x.p.kind")

    def sweep(items: str, edge: str, distance: str) -> str:
        near = lambda k: f"(x.{k} OR coalesce({distance.format(f'a.s.{k}')} <= {window}, false))"
        keep = lambda k, c: f"CASE WHEN ({mine}) = {c} THEN {edge.format(f'a.s.{k}')} ELSE a.s.{k} END"
        step = f"CASE WHEN ({mine}) = 3 THEN CAST({unseen} AS {state}) ELSE named_struct('i', {keep('i', 0)}, 's', {keep('s', 1)}) END"
        return scan(items, unseen, step, f"named_struct('p', x.p, 'i', {near('i')}, 's', {near('s')})", state, LINKED)

    fresh = f"transform({parts}, p -> named_struct('p', p, 'i', false, 's', false))"
    ahead = sweep("fresh", "greatest(x.p.end, {})", "(x.p.start - {})")
    back = sweep("turned", "least(x.p.start, {})", "({} - x.p.end)")
    linked = f"filter(reverse(swept), x -> (({mine}) = 0 AND x.s) OR (({mine}) = 1 AND x.i) OR (({mine}) = 2 AND x.i AND x.s))"
    return F.expr(f"transform({let(fresh, 'fresh', let(f'reverse({ahead})', 'turned', let(back, 'swept', linked)))}, x -> x.p)")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, base (array of struct<start,o,end,kind>) and all, with linked weak parts."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    rows = rows.withColumns({"base": base_spans("body"), "weak": weak_parts("body")})
    # Endpoints and ends of scopes are looked for only where an identifier and a secret are there.
    has = lambda c: F.expr(f"exists(weak, p -> ({_class('p.kind')}) = {c}) OR exists(base, p -> ({_class('p.kind')}) = {c})")
    endpoints = part(find("body", ENDPOINT, guard=holds("body", ":", "=")), "endpoint", 5)
    rows = rows.withColumn("linkable", has(0) & has(1))
    rows = rows.withColumn("weak", F.when(F.col("linkable"), F.concat("weak", endpoints)).otherwise(none_of(PART)))
    free = F.filter(F.arrays_zip(F.col("weak").alias("p"), related("weak", "base").alias("r")), lambda x: ~x["r"]["overlaps"])
    rows = rows.withColumn("weak", F.transform(free, lambda x: x["p"]))
    parts = F.array_sort(F.concat("base", "weak", part(find("body", BREAK), "break", -1)))
    rows = rows.withColumn("parts", F.when(F.size("weak") > 0, parts).otherwise(none_of(PART)))
    linked = F.filter(link("parts", window), lambda p: p["o"] >= 3)
    return rows.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", linked)).alias("all"))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of base spans and the places of all; n_added counts what linking adds."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_all = F.size("all").cast("long")
    return found.select(id_col, *map(count, KINDS), sha256_hex(joined("base")).alias("base_sha256"), joined("all").alias("spans"), n_all.alias("n_spans"), (n_all - F.size("base")).alias("n_added"))
