"""Quality rules: repetition found with suffix arrays over words.

Many texts are laid end to end and their suffixes sorted by prefix doubling; a suffix ends
with its text, and only suffixes that are not yet alone in their group are sorted again.
Longest common prefixes of neighbours follow from the ranks of each doubling. From them:

* words in windows of three that occur twice or more (a base rule),
* LCP intervals of at least min_repeat words that are left-maximal: the maximal repeats,
* the union of their spans as a share of the words, and the longest repeat. The deepest interval
  that holds a suffix has the LCP of its nearer neighbour, and the spans of all other intervals
  lie within those of the deepest, so the union is read from there.

A document is kept if it passes the base rules, repeats cover at most max_covered of its
words, and no repeat is longer than max_longest (a share of its words, but at least
min_longest words). Null text counts as no words, and fails as every text under min_words
does. Rows that repeat are judged each; other columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed

BATCH_WORDS = 200_000
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_share: float = 0.5
    min_repeat: int = 8
    max_covered: float = 0.3
    max_longest: float = 0.2
    min_longest: int = 30


def suffix_array(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in order of their suffixes (ending at end[i], by document first), and the
    ranks at each doubling: equal ranks at level j mean equal first 2**j words, or equal
    suffixes where fewer are left."""
    n = len(words)
    first = doc * (int(words.max()) + 2) + words + 1
    at = np.arange(n)

    def following(rank: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        inside = p + k < end[p]
        out[inside] = rank[p[inside] + k] + 1
        return out

    def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first of each entry's group, and whether the group has others."""
        new = np.r_[True, keys[1:] != keys[:-1]]
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        return starts[which], (np.diff(np.r_[starts, len(keys)]) > 1)[which]

    order = np.argsort(first, kind="stable")
    start, _ = groups(first[order])
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, sa, slots, k = [rank.copy()], order, at, 1
    while len(slots):
        p = sa[slots]
        key = rank[p] * (n + 1) + following(rank, p, k)
        o = np.argsort(key, kind="stable")
        sa[slots] = p = p[o]
        start, many = groups(key[o])
        rank[p] = slots[start]
        levels.append(rank.copy())
        slots = slots[many]
        k *= 2
        # Equal suffixes cannot stay together: they end at different places of one text.
    return sa, levels


def neighbours_lcp(sa: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that suffix sa[i] has in common with sa[i - 1]; 0 for those that share no first word."""
    lcp = np.zeros(len(sa), np.int64)
    i = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[i - 1].copy(), sa[i].copy()
    got = np.zeros(len(i), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        step = 1 << j
        inside = (a + step <= end[np.minimum(a, len(end) - 1)]) & (b + step <= end[np.minimum(b, len(end) - 1)])
        inside &= (a < len(sa)) & (b < len(sa))
        ok = np.flatnonzero(inside)
        ok = ok[levels[j][a[ok]] == levels[j][b[ok]]]
        a[ok] += step
        b[ok] += step
        got[ok] += step
    lcp[i] = got
    return lcp


def count_maximal(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """Left-maximal LCP intervals of at least `least` words in each document."""
    out = np.zeros(n_docs, np.int64)
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return out
    changes = np.cumsum(np.r_[0, before[sa[1:]] != before[sa[:-1]]])
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        stack: list[tuple[int, int]] = []
        owner = doc[sa[run[0]]]
        for i, value in zip(range(run[0], run[-1] + 2), [*lcp[run].tolist(), 0], strict=True):
            left = i - 1
            while stack and stack[-1][0] > value:
                _, left = stack.pop()
                out[owner] += changes[i - 1] > changes[left]
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))
    return out


def covered(n: int, positions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, positions, 1)
    np.add.at(edge, positions + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], limits: Limits) -> dict[str, list]:
    """All measures of some texts."""
    cut = [t.encode().split() for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    n, ids = int(sizes.sum()), defaultdict(count().__next__)
    repeat_words = np.zeros(len(texts), np.int64)
    share, longest, maximal = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if n:
        words = np.fromiter(map(ids.__getitem__, chain.from_iterable(cut)), np.int64, n)
        doc = np.repeat(np.arange(len(texts)), sizes)
        end = np.cumsum(sizes)[doc]
        sa, levels = suffix_array(words, doc, end)
        lcp = neighbours_lcp(sa, levels, end)
        most = np.maximum(lcp, np.r_[lcp[1:], 0])  # of either neighbour
        windows = sa[most >= 3]
        repeat_words = np.bincount(doc[covered(n, windows, np.full(len(windows), 3))], minlength=len(texts))
        long = most >= limits.min_repeat
        share = np.bincount(doc[covered(n, sa[long], most[long])], minlength=len(texts)) / np.maximum(sizes, 1)
        np.maximum.at(longest, doc[sa[long]], most[long])
        before = np.r_[-1, words[:-1]]
        before[np.r_[0, np.cumsum(sizes)[:-1]][sizes > 0]] = -1 - np.arange(int((sizes > 0).sum()))
        maximal = count_maximal(sa, lcp, before, doc, len(texts), limits.min_repeat)
    dup_lines = []
    for text in texts:
        seen, dup = set(), 0
        if "\n" in text:
            for line in text.split("\n"):
                if line in seen:
                    dup += 1
                elif line.strip(SPACES):
                    seen.add(line)
        dup_lines.append(dup)
    failed = (sizes < limits.min_words) | (repeat_words > limits.max_repeat_share * sizes)
    kept = ~failed & (share <= limits.max_covered) & (longest <= np.maximum(limits.max_longest * sizes, limits.min_longest))
    return {
        "n_words": sizes.tolist(),
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words.tolist(),
        "base_failed": failed.tolist(),
        "kept": kept.tolist(),
        "covered": share.tolist(),
        "longest_repeat": longest.tolist(),
        "n_maximal_repeats": maximal.tolist(),
    }


TYPES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "covered": "double", "longest_repeat": "long", "n_maximal_repeats": "long"}
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per document: its id and the measures in TYPES."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{k} {v}" for k, v in TYPES.items())

    def run(batches):
        for batch in batches:
            at, texts = 0, []
            size = 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                texts.append(text)
                size += len(text)
                if size > 6 * BATCH_WORDS or i + 1 == batch.num_rows:
                    got = measure(texts, limits)
                    columns = [pa.array(got[k], ARROW[v]) for k, v in TYPES.items()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=[id_col, *TYPES])
                    at, texts, size = i + 1, [], 0

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)
