"""Personal data: high-recall candidates, judged by boosted trees, in DataFrame operations only.

Base spans (e-mail, IP address, payment card, phone) come from fixed patterns and checks.
Generators propose further spans of any length, which may overlap each other: spelled-out or
spaced e-mail addresses, digit groups of any layout, cards in four groups, host addresses
with guarded dots. Each candidate gets format and context features, all of them
small classes, so all candidates of all documents come down to a table of feature cells with
counts (CELLS at most). Boosted trees are fitted to that table. A candidate counts as positive
if it covers a valid base span of its kind, or in a form that base patterns do not read: an
address with separators that only addresses have (or words for all of them, after a word like
"mail") that is valid once they are written plainly; a number whose digits make a valid card;
a phone's count of digits after a word like "call"; a host address that is valid with plain
dots. Each base address, host and phone is also counted in such forms (spelled out; with
guarded dots; without its country code, after such a word), so the trees
know them where texts hold few. Features leave out the checks that made base spans valid. A
fifth of the documents is held out to set the threshold: the least margin at which, by isotonic
regression, at least `precision` of held-out candidates are positive. Trees are applied as CASE
expressions to candidates that overlap no base span and are valid in one of those forms.

Each text is read once: spans and cells of all documents are written to a table (places and
small numbers, no text) from which the trees are fitted and to which they are applied.

Null text counts as empty and gives no spans. Rows that repeat are judged each; other columns
are left aside. Without any positive candidate nothing is added.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sha256_hex, text_or_empty
from .spans import find, holds, joined, none_of, related, tagged

KINDS = ("email", "ip", "card", "phone")
#: Possessive and anchored twins of the contract's patterns: the same matches, no recursion,
#: and no second scan of a run from its middle.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates, of any length. Addresses with spelled separators, numbers in any layout, cards
#: in four equal groups (these overlap the numbers), addresses of hosts with guarded dots.
MAIL_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)++"
NUMBER_LIKE = r"(?=[+(0-9])(?<![0-9A-Za-z+(.])[+(]?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9])"
CARD_LIKE = r"(?=[0-9])(?<![0-9])[0-9]{4}([./_*:\x20-]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
HOST_LIKE = r"(?=[0-9])(?<![0-9.])[0-9]{1,3}(?:(?:\.|\x20?[\[(]\x20?(?:\.|dot|DOT)\x20?[\])]\x20?|\x20(?:dot|DOT)\x20)[0-9]{1,3}){3}(?![0-9.])"
BEFORE, AFTER = 24, 4
#: Separators of spelled addresses, in brackets or as words.
AT, DOT = r"(?:\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?|\x20(?:at|AT)\x20)", r"(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?|\x20(?:dot|DOT)\x20)"
#: Words before an address or a phone number, in lower case; a number follows closely.
MAIL_WORD = r"(?:mail|contact|write|courriel|correo)[^.!?]*$"
CALL_WORD = r"(?<![a-z])(?:tel|tele[fp][a-zé]*+|phone|call|mobile|cell|fax|(?:an)?rufe?n?|ll[aá]m[a-z]*+|appele[rz])(?![a-z])\.?[^.!?0-9]{0,16}$"
#: Year, month and day, or the reverse: no candidate, whatever word comes before.
DATE = r"^(?:[12][0-9]{3}([.-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([.-])(?:0?[1-9]|[12][0-9]|3[01])\2[12][0-9]{3})$"
#: Feature: number of classes.
FEATURES = {"mail": 2, "digits": 8, "groups": 4, "opens": 3, "paren": 2, "dots": 3, "spelled": 4, "word": 5, "touches": 2}
CELLS = math.prod(FEATURES.values())
LEARNING_RATE, ROUNDS = 0.3, 40


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def ip_parts_fit(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def card_fits(m: Column) -> Column:
    return F.length(digits(m)).between(13, 19) & luhn(digits(m))


def has_digit(text: str) -> Column:
    return F.col(text).rlike("[0-9]")


def valid_matches(text: str, before: int = 0, after: int = 0) -> dict[str, Column]:
    return {
        "email": find(text, EMAIL, before, after, guard=holds(text, "@")),
        "ip": F.filter(find(text, IP, before, after, guard=has_digit(text)), lambda s: ip_parts_fit(s["m"])),
        "card": F.filter(find(text, CARD, before, after, guard=has_digit(text)), lambda s: card_fits(s["m"])),
        "phone": F.filter(find(text, PHONE, before, after, guard=holds(text, "+")), lambda s: F.length(digits(s["m"])).between(9, 15)),
    }


def spelling(m: Column) -> Column:
    """0 plain, 1 some separator that only addresses have, 2 words for all, 3 a word and a plain dot."""
    return F.when(m.contains("@"), F.when(m.rlike(DOT), 1).otherwise(0)).when(m.rlike(r"[\[(]"), 1).when(~F.substring_index(F.regexp_replace(m, AT, "@"), "@", -1).contains("."), 2).otherwise(3)


def plain_address(m: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, ".")


def features(s: Column) -> list[Column]:
    m, pre, mail = s["m"], F.lower(s["pre"]), s["kind"] == "email"
    n = F.length(digits(m))
    groups = F.size(F.split(F.trim(F.regexp_replace(m, "[^0-9]+", " ")), " "))
    word = (
        F.when(pre.rlike(MAIL_WORD), 1)
        .when(pre.rlike(CALL_WORD), 2)
        .when(pre.rlike("(?:card|visa|credit|carte|karte|tarjeta)[^.!?]*$"), 3)
        .when(pre.rlike(r"(?:version|page|isbn|date|no\.|nr\.|#)[^.!?]*$"), 4)
        .otherwise(0)
    )
    dots = F.when(~m.contains("."), 0).when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1).otherwise(2)
    number = lambda value: F.when(mail, 0).otherwise(value)
    return [
        mail.cast("int"),
        number(F.when(n < 7, 0).when(n < 9, 1).when(n < 10, 2).when(n < 12, 3).when(n < 13, 4).when(n < 16, 5).when(n < 17, 6).otherwise(7)),
        number(F.least(groups, F.lit(4)) - 1),
        number(F.when(m.startswith("+"), 1).when(m.startswith("("), 2).otherwise(0)),
        number(m.contains("(").cast("int")),
        number(dots),
        F.when(mail, spelling(m)).otherwise(m.rlike(r"[\[(]\x20?(?:\.|dot|DOT)|\x20(?:dot|DOT)\x20").cast("int")),
        word,
        (s["pre"].rlike("[A-Za-z]$") | s["post"].rlike("^[A-Za-z@]")).cast("int"),
    ]


def cell(s: Column) -> Column:
    """The features of a span (SHAPE) as one number below CELLS."""
    code = F.lit(0)
    for value, n in zip(features(s), FEATURES.values(), strict=True):
        code = code * n + F.greatest(F.lit(0), F.least(value.cast("int"), F.lit(n - 1)))
    return code


def plain_host(m: Column) -> Column:
    return F.regexp_replace(m, r"\x20?[\[(]\x20?(?:\.|dot|DOT)\x20?[\])]\x20?|\x20(?:dot|DOT)\x20", ".")


def fits(s: Column) -> Column:
    """Whether a candidate is valid in a form that base patterns do not read."""
    m, pre, kind = s["m"], F.lower(s["pre"]), s["kind"]
    named = plain_address(m).rlike(f"^{EMAIL}$") & m.rlike("[A-Za-z]{2}$")
    address = named & ((spelling(m) == 1) | ((spelling(m) == 2) & pre.rlike(MAIL_WORD)))
    touches = s["pre"].rlike("[A-Za-z]$") | s["post"].rlike("^[A-Za-z@]")
    called = F.length(digits(m)).between(7, 12) & pre.rlike(CALL_WORD) & ~touches
    host = m.rlike("[^0-9.]") & plain_host(m).rlike(f"^{IP}$") & ip_parts_fit(plain_host(m)) & ~touches
    return F.when(kind == "email", address).when(kind == "card", card_fits(m)).when(kind == "phone", called).when(kind == "ip", host).otherwise(False)


SHAPE = "struct<start:int,end:int,m:string,pre:string,post:string,kind:string>"
CANDIDATE = "struct<start:int,end:int,cell:int,kind:string,fits:boolean>"


def shaped(m: Column, pre: Column, post: Column, kind: str, start=None, end=None) -> Column:
    return F.struct((start if start is not None else F.lit(0)).alias("start"), (end if end is not None else F.lit(0)).alias("end"), m.alias("m"), pre.alias("pre"), post.alias("post"), F.lit(kind).alias("kind"))


def twins(kind: str, s: Column) -> Column:
    """A base span written in forms that base patterns do not read: array<SHAPE>, without places."""
    m = s["m"]
    if kind == "email":
        name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        spelled = F.replace(domain, F.lit("."), F.lit(" dot "))
        made = [(F.concat(name, F.lit(" [at] "), domain), s["pre"]), (F.concat(name, F.lit("@"), spelled), s["pre"]), (F.concat(name, F.lit(" [at] "), spelled), s["pre"]), (F.concat(name, F.lit(" at "), spelled), F.lit("mail "))]
    elif kind == "ip":
        made = [(F.replace(m, F.lit("."), F.lit(dot)), s["pre"]) for dot in ("[.]", "(.)", " dot ", " [dot] ")] + [(F.regexp_replace(m, r"\.([0-9]+)$", "[.]$1"), s["pre"])]
    elif kind == "card":
        made = [(F.concat_ws(by, *(F.substring(digits(m), i, 4) for i in (1, 5, 9, 13))), s["pre"]) for by in (".", " / ", "_", "--")]
    else:
        local = F.regexp_replace(m, r"^\+(?:[0-9]{1,3}(?:[\x20.-]+|(?=\()))?+", "")
        made = [(x, F.lit("call ")) for x in (local, F.concat(F.lit("0"), local), F.regexp_replace(local, r"^([0-9]{2,4})[\x20.-]+", r"($1) "))]
    out = F.array(*(shaped(x, pre, s["post"], kind) for x, pre in made)).cast(f"array<{SHAPE}>")
    if kind == "card":
        return F.filter(out, lambda x: F.length(digits(x["m"])) == 16)
    return F.filter(out, lambda x: F.length(digits(x["m"])).between(7, 12) & x["m"].rlike(f"^{NUMBER_LIKE}$")) if kind == "phone" else out


def candidates(text: str) -> Column:
    """array<SHAPE>, which may overlap."""

    def of(found: Column, kind: str) -> Column:
        return F.transform(found, lambda s: shaped(s["m"], s["pre"], s["post"], kind, s["start"], s["end"])).cast(f"array<{SHAPE}>")

    spelled = holds(text, "@", " at ", " AT ", "at)", "AT)", "at]", "AT]", "at ]", "AT ]", "at )", "AT )")
    numbers = F.filter(find(text, NUMBER_LIKE, BEFORE, AFTER, guard=has_digit(text)), lambda s: ~s["m"].rlike(DATE))
    numbers = F.transform(of(numbers, "phone"), lambda s: s.withField("kind", F.when(s["m"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip").when(F.length(digits(s["m"])) >= 13, "card").otherwise("phone")))
    guarded = has_digit(text) & holds(text, "[.]", "(.)", "[ .", "( .", "dot", "DOT")
    return F.concat(
        of(find(text, MAIL_LIKE, BEFORE, AFTER, guard=spelled), "email"),
        numbers,
        of(find(text, CARD_LIKE, BEFORE, AFTER, guard=has_digit(text)), "card"),
        of(F.filter(find(text, HOST_LIKE, BEFORE, AFTER, guard=guarded), lambda s: s["m"].rlike("[^0-9.]")), "ip"),
    )


def judged(shapes: str) -> Column:
    """array<CANDIDATE> of array<SHAPE>"""
    return F.transform(shapes, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), cell(s).alias("cell"), s["kind"].alias("kind"), fits(s).alias("fits"))).cast(f"array<{CANDIDATE}>")


def split_cell(code: int) -> tuple[int, ...]:
    out = []
    for n in reversed(FEATURES.values()):
        out.append(code % n)
        code //= n
    return tuple(reversed(out))


class Trees:
    """Gradient boosting with trees of depth two on cells with counts of positives and negatives."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.start, self.trees = 0.0, []
        rows = [(split_cell(c), p, n) for c, p, n in cells]
        pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not pos:
            return
        self.start = math.log(pos / max(neg, 0.5))
        margin = [self.start] * len(rows)
        tests = [(f, v) for f, n in enumerate(FEATURES.values()) for v in range(n)]
        for _ in range(ROUNDS):
            grad, hess = [], []
            for (_, p, n), m in zip(rows, margin, strict=True):
                q = 1 / (1 + math.exp(-m))
                grad.append(p - (p + n) * q)
                hess.append((p + n) * q * (1 - q))
            gain = lambda ids: sum(grad[i] for i in ids) ** 2 / (sum(hess[i] for i in ids) + 1.0)  # noqa: E731, B023

            def best(ids):
                found = (gain(ids) + 1e-9, None)  # noqa: B023
                for f, v in tests:
                    yes = [i for i in ids if rows[i][0][f] == v]
                    if yes and len(yes) < len(ids):
                        no = [i for i in ids if rows[i][0][f] != v]
                        found = max(found, (gain(yes) + gain(no), (f, v)), key=lambda x: x[0])  # noqa: B023
                return found[1]

            leaf = lambda ids: LEARNING_RATE * sum(grad[i] for i in ids) / (sum(hess[i] for i in ids) + 1.0)  # noqa: E731, B023

            def grow(ids, depth):
                test = best(ids) if depth else None
                if test is None:
                    value = leaf(ids)  # noqa: B023
                    for i in ids:
                        margin[i] += value
                    return value
                f, v = test
                return f, v, grow([i for i in ids if rows[i][0][f] == v], depth - 1), grow([i for i in ids if rows[i][0][f] != v], depth - 1)

            self.trees.append(grow(list(range(len(rows))), 2))

    def margin(self, code: int) -> float:
        x, total = split_cell(code), self.start
        for tree in self.trees:
            while isinstance(tree, tuple):
                f, v, yes, no = tree
                tree = yes if x[f] == v else no
            total += tree
        return total

    def column(self, code: Column) -> Column:
        """margin() as an expression."""
        sizes = list(FEATURES.values())
        at = [F.pmod(F.floor(code / math.prod(sizes[f + 1 :])), F.lit(sizes[f])) for f in range(len(sizes))]
        grow = lambda t: F.when(at[t[0]] == t[1], grow(t[2])).otherwise(grow(t[3])) if isinstance(t, tuple) else F.lit(t)
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + grow(tree)
        return total


FOUND = "struct<start:int,end:int,cell:int,kind:string,fits:boolean,overlaps:boolean,covers:boolean>"


def propose(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, base, found, twins), each text read once: base spans, candidates with their cells and
    how they lie to base spans, and cells of base spans rewritten in other forms."""

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    rows = rows.withColumns(valid_matches("body", BEFORE, AFTER))
    rows = rows.select(
        "id",
        F.concat(*(tagged(k, i, k) for i, k in enumerate(KINDS))).alias("base"),
        candidates("body").alias("seen"),
        F.concat(*(F.flatten(F.transform(k, partial(twins, k))) for k in KINDS)).alias("made"),
    )
    # Both kinds of shapes are judged by one expression, then parted again.
    rows = rows.select("id", "base", F.size("seen").alias("n"), F.concat("seen", "made").alias("both")).withColumn("both", judged("both"))
    rows = rows.select("id", "base", F.slice("both", F.lit(1), F.col("n")).alias("seen"), F.expr("transform(slice(both, n + 1, size(both)), c -> c.cell)").alias("twins"))
    found = F.expr("transform(arrays_zip(seen, how), x -> named_struct('start', x.seen.start, 'end', x.seen.end, 'cell', x.seen.cell, 'kind', x.seen.kind, 'fits', x.seen.fits, 'overlaps', x.how.overlaps, 'covers', x.how.covers))")
    return rows.withColumn("how", related("seen", "base")).select("id", "base", "twins", found.cast(f"array<{FOUND}>").alias("found"))


def fit(proposed: DataFrame, *, precision: float) -> tuple[Trees, float]:
    """Trees, and the margin from which on candidates are taken."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(5)) == 0
    seen = F.concat(
        F.transform("found", lambda c: F.struct(c["cell"].alias("cell"), (c["fits"] | c["covers"]).alias("positive"))),
        F.transform("twins", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("positive"))),
    )
    rows = proposed.filter((F.size("found") > 0) | (F.size("twins") > 0)).select(held_out.alias("held_out"), F.explode(seen).alias("c")).select("held_out", "c.*")
    cells = rows.groupBy("held_out", "cell").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count("*").alias("n"))
    seen = cells.collect()  # 2 * CELLS rows at most
    trees = Trees([(r.cell, r.p, r.n - r.p) for r in seen if not r.held_out])
    steps = sorted((-trees.margin(r.cell), r.p, r.n) for r in seen if r.held_out) if trees.trees else []
    return trees, calibrate([(-m, p, n) for m, p, n in steps], precision)


def calibrate(steps: list[tuple[float, int, int]], precision: float) -> float:
    """The least margin whose own share of positives, smoothed to fall with the margin, is at
    least precision. steps (margin, positives, all) come by falling margin."""
    pools: list[list[float]] = []
    for margin, p, n in steps:
        pools.append([margin, p, n])
        while len(pools) > 1 and pools[-1][1] * pools[-2][2] > pools[-2][1] * pools[-1][2]:
            margin, p, n = pools.pop()
            pools[-1] = [margin, pools[-1][1] + p, pools[-1][2] + n]
    return min((m for m, p, n in pools if p >= precision * n), default=math.inf)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """One row per document: id, base (array of struct<o,start,end,kind>) and all (with what the trees add)."""
    proposed = materialise(propose(docs, id_col=id_col, text_col=text_col), "pii-proposed")
    trees, cut = fit(proposed, precision=precision)
    order = lambda c: F.when(c["kind"] == "email", 0).when(c["kind"] == "ip", 1).when(c["kind"] == "card", 2).otherwise(3)
    fresh = F.filter("found", lambda c: ~c["overlaps"] & c["fits"] & (trees.column(c["cell"]) >= F.lit(cut - 1e-9)))
    extra = F.transform(fresh, lambda c: F.struct(order(c).alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    if math.isinf(cut):
        extra = none_of("struct<o:int,start:int,end:int,kind:string>")
    out = proposed.select("id", "base", F.array_sort(F.concat("base", extra)).alias("all"))
    # Two generators may propose one span; equal spans are neighbours.
    return out.select(F.col("id").alias(id_col), "base", F.expr("filter(all, (s, i) -> i = 0 OR s <> get(all, i - 1))").alias("all"))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of base spans and the places of all; n_added counts what the trees add."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_all = F.size("all").cast("long")
    return found.select(id_col, *map(count, KINDS), sha256_hex(joined("base")).alias("base_sha256"), joined("all").alias("spans"), n_all.alias("n_spans"), (n_all - F.size("base")).alias("n_added"))
