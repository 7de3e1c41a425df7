"""Spans of pattern matches as columns: positions in code points, without leaving the JVM.

Spark has no function that gives the places of all matches. One scan marks them in the text
(regexp_replace), a split at the marks gives gaps and matches in turn, and running sums of
their lengths give the places. Running values come from scan(), which works in blocks, so its
cost is in proportion to the number of items; a text may hold any number of matches.
Patterns must not match the empty string, and loops over groups should be possessive: those
run without recursion, so a match of any length is safe.

Expressions are put together as SQL text: parsing one is far quicker than building it node by
node from Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items per block of scan().
BLOCK = 64
SPAN = "struct<start:int,end:int,m:string,pre:string,post:string>"


def empty(kind: str) -> str:
    return f"CAST(array() AS array<{kind}>)"


def none_of(kind: str) -> Column:
    return F.expr(empty(kind))


def let(value: str, name: str, body: str) -> str:
    """body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(items: str, zero: str, step: str, out: str, state: str, kind: str) -> str:
    """array<kind> of `out` for each item, while a state moves on by `step`; both are in terms of
    a.s (the state before the item) and x (the item). items is a column or a lambda's variable.

    aggregate() copies what it has gathered at every step, so states are first carried from
    block to block, without outputs, and outputs are then gathered within each block."""
    part = f"slice({items}, at * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, CAST((size({items}) - 1) div {BLOCK} AS INT))"
    after = f"aggregate({part}, named_struct('s', b.s), (a, x) -> named_struct('s', CAST({step} AS {state})), a -> a.s)"
    states = f"aggregate({blocks}, named_struct('s', CAST({zero} AS {state}), 'all', {empty(state)}), (b, at) -> named_struct('s', {after}, 'all', array_append(b.all, b.s)), b -> b.all)"
    within = (
        f"aggregate({part}, named_struct('s', states[at], 'all', {empty(kind)}), "
        f"(a, x) -> named_struct('s', CAST({step} AS {state}), 'all', array_append(a.all, CAST({out} AS {kind}))), a -> a.all)"
    )
    outs = let(states, "states", f"flatten(transform({blocks}, at -> {within}))")
    return f"CASE WHEN size({items}) = 0 THEN {empty(kind)} ELSE {outs} END"


def find(text: str, pattern: str, before: int = 0, after: int = 0, guard: Column | None = None) -> Column:
    """array<SPAN> of leftmost non-overlapping matches in a column; pre and post are up to so many
    characters around each that belong to no other match. A text without a match costs one
    scan, or none where the guard (a cheap test that every text with a match passes) is false.

    Where a text holds the mark itself (U+0001), U+0002 takes its place: no pattern tells them apart."""
    quoted = pattern.replace("'", r"\x27")
    marked = f"regexp_replace(replace({text}, char(1), char(2)), r'{quoted}', concat(char(1), '$0', char(1)))"
    places = let(scan("pieces", "0", "a.s + length(x)", "a.s", "int", "int"), "places", (
        "transform(sequence(1, size(pieces) - 2, 2), i -> named_struct('start', places[i], 'end', places[i + 1], 'm', pieces[i], "
        f"'pre', {f'right(pieces[i - 1], {before})' if before else "''"}, 'post', {f'left(pieces[i + 1], {after})' if after else "''"}))"
    ))
    found = F.expr(let(marked, "marked", f"CASE WHEN contains(marked, char(1)) THEN {let('split(marked, char(1), -1)', 'pieces', places)} ELSE {empty(SPAN)} END"))
    return found if guard is None else F.when(guard, found).otherwise(none_of(SPAN))


def holds(text: str, *parts: str) -> Column:
    """Whether a column's text holds one of some short strings."""
    test = F.lit(False)
    for part in parts:
        test = test | F.col(text).contains(part)
    return test


def tagged(spans: str, order: int, kind: str) -> Column:
    """Spans as struct<o, start, end, kind>, which sorts by kind as listed."""
    return F.expr(f"transform({spans}, s -> named_struct('o', {order}, 'start', s.start, 'end', s.end, 'kind', '{kind}'))")


def joined(spans: str) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


PLACE = "struct<start:int,b:int,end:int,kind:string,nr:int,overlaps:boolean,covers:boolean>"


def related(spans: str, base: str) -> Column:
    """struct<overlaps, covers> for each of spans (with start, end and kind): whether it
    overlaps one of base, and whether it holds one of base of its own kind. Base spans of one
    kind must not overlap. Sorting and two sweeps, no pairs."""
    place = lambda array, b: f"transform({array}, (s, nr) -> named_struct('start', s.start, 'b', {b}, 'end', s.end, 'kind', s.kind, 'nr', nr, 'overlaps', false, 'covers', false))"
    keep = lambda overlaps, covers: f"named_struct('start', x.start, 'b', x.b, 'end', x.end, 'kind', x.kind, 'nr', x.nr, 'overlaps', {overlaps}, 'covers', {covers})"
    # Forwards: the greatest end of a base span that starts before this span does.
    ahead = scan("both_kinds", "-1", "CASE WHEN x.b = 1 THEN greatest(a.s, x.end) ELSE a.s END", keep("a.s > x.start", "false"), "int", PLACE)
    # Backwards: the next start of any, and the next end of each kind.
    back = scan(
        "turned", f"named_struct('start', {1 << 30}, 'ends', map())",
        "CASE WHEN x.b = 1 THEN named_struct('start', x.start, 'ends', map_concat(map_filter(a.s.ends, (k, e) -> k <> x.kind), map(x.kind, x.end))) ELSE a.s END",
        keep("x.overlaps OR a.s.start < x.end", "coalesce(try_element_at(a.s.ends, x.kind) <= x.end, false)"),
        "struct<start:int,ends:map<string,int>>", PLACE,
    )
    mine = "transform(array_sort(transform(filter(swept, x -> x.b = 0), x -> named_struct('nr', x.nr, 'overlaps', x.overlaps, 'covers', x.covers))), x -> named_struct('overlaps', x.overlaps, 'covers', x.covers))"
    # Spans before base spans of the same start: the backward sweep sees those.
    sweeps = let(f"array_sort(concat({place(spans, 0)}, {place(base, 1)}))", "both_kinds", let(f"reverse({ahead})", "turned", let(back, "swept", mine)))
    return F.expr(f"CASE WHEN size({spans}) = 0 OR size({base}) = 0 THEN transform({spans}, s -> named_struct('overlaps', false, 'covers', false)) ELSE {sweeps} END")
