"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs.

A merge-type vocabulary is applied by keeping every adjacent pair of symbols that forms a
piece in an agenda, best score first and leftmost among equals. The vocabulary is inspected
once: where no piece crosses from letters to other characters or holds the space mark after
either, merges never cross there, and each chunk (space marks and a run of letters or of
others) can be encoded by itself and remembered. New chunks of one length are merged together: their agendas are the
rows of one matrix of pair costs, and each round takes every row's first best pair. Long
chunks and those with characters outside the vocabulary have a heap each. Every chunk that an Arrow batch brings anew is also encoded by the
sentencepiece library in one call, and so is every whole text whose identifier is a multiple of
check_every (by its hash, if it is no number); a difference stops the job. Decoding is the library's.
Without byte pieces, neighbouring unknown ids are one, across chunks too.

Null counts as the empty text, which has begin and end ids only. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed

MARK = "▁"
#: Chunks that a worker remembers before it starts afresh: bounds its memory.
CACHE_CHUNKS = 600_000
#: Longer chunks (texts without spaces) are not remembered.
CACHE_CHARS = 64
#: Chunks up to this length are merged in matrices.
MATRIX_CHARS = 64
#: Ways to cut a text, finest first; one serves if it leaves every piece of the model whole.
#: OTHER stands for characters that count as word characters but are no letters.
CUTS = (rf"{MARK}*(?:[^\W\d_OTHER]+|(?:[^\w{MARK}]|[\d_OTHER])+)|{MARK}+", rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Stands before a chunk without a mark when the library encodes it.
STANDS_BEFORE = ("a", ".")


class Agenda:
    """Encoder for one merge-type model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.cost: dict[str, float] = {}
        self.ids: dict[str, bytes] = {}
        self.byte_ids: list[bytes] = [b""] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = self.packed(i)
            elif lib.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.cost[piece] = -lib.get_score(i)
                self.ids[piece] = self.packed(i)
        self.unknown = self.packed(lib.unk_id())
        self.has_bytes = all(self.byte_ids)
        other = {c for p in self.cost for c in p if c.isalnum() and not c.isalpha()}
        cuts = (re.compile(c.replace("OTHER", re.escape("".join(sorted(other))))) for c in CUTS)
        self.cut = next((c.findall for c in cuts if all(c.fullmatch(p) and c.findall(p) == [p] for p in self.cost)), None)
        self.begin, self.end = self.packed(lib.bos_id()), self.packed(lib.eos_id())
        self.known: dict[str, bytes] = {}
        self.tabulate()

    def tabulate(self) -> None:
        """Sorted keys of all pairs of pieces that form a piece, their costs and results."""
        lib = self.library
        number = {p: int.from_bytes(b, "little") for p, b in self.ids.items()}
        self.base = lib.get_piece_size()
        self.of_char = np.full(0x110000, -1, np.int32)
        keys, made = [], []
        for piece, i in number.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.pair_made = np.append(np.array(made, np.int32)[order], np.int32(-1))
        costs = np.array([-lib.get_score(i) for i in range(self.base)], np.float64)
        self.pair_cost = np.append(costs[self.pair_made[:-1]], np.inf)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair in the table; the last entry for pairs that form no piece."""
        keys = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def merge_matrix(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols (chunks x length, ids of characters), merged: ids, and how many remain."""
        n, width = symbols.shape
        done, left = np.zeros_like(symbols), np.full(n, 1, np.int64)
        rows = np.arange(n)
        at = self.pairs(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width)
        while len(rows):
            cost = self.pair_cost[at]
            best = cost.argmin(1) if at.shape[1] else np.zeros(len(rows), np.int64)
            mine = np.arange(len(rows))
            go = cost[mine, best] < np.inf if at.shape[1] else np.zeros(len(rows), bool)
            if not go.all():
                stop = ~go
                done[rows[stop], : symbols.shape[1]] = symbols[stop]
                left[rows[stop]] = symbols.shape[1]
                rows, symbols, at, best = rows[go], symbols[go], at[go], best[go]
                if not len(rows):
                    break
                mine = np.arange(len(rows))
            made = self.pair_made[at[mine, best]]
            width -= 1
            keep = columns[:width] + (columns[:width] > best[:, None])
            symbols = np.take_along_axis(symbols, keep, 1)
            symbols[mine, best] = made
            at = np.take_along_axis(at, keep[:, : width - 1], 1) if width > 1 else at[:, :0]
            before, after = best > 0, best < width - 1
            r, c = mine[before], best[before]
            at[r, c - 1] = self.pairs(symbols[r, c - 1], made[before])
            r, c = mine[after], best[after]
            at[r, c] = self.pairs(made[after], symbols[r, c + 1])
        return done, left

    def encode_chunks(self, chunks: list[str]) -> None:
        """Remember the ids of new chunks."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        starts = np.cumsum(lengths) - lengths
        plain = (lengths <= MATRIX_CHARS) & (np.minimum.reduceat(codes, starts) >= 0)
        for i in np.flatnonzero(~plain).tolist():
            self.known[chunks[i]] = self.encode_chunk(chunks[i])
        for width in np.unique(lengths[plain]).tolist():
            which = np.flatnonzero(plain & (lengths == width))
            ids, left = self.merge_matrix(codes[starts[which][:, None] + np.arange(width)])
            packed, row = ids.astype("<u4").tobytes(), 4 * width
            for k, (i, n) in enumerate(zip(which.tolist(), (4 * left).tolist(), strict=True)):
                self.known[chunks[i]] = packed[k * row : k * row + n]

    @staticmethod
    def packed(i: int) -> bytes:
        return int(i).to_bytes(4, "little")

    def merge(self, chunk: str) -> list[str]:
        """Symbols that remain when no adjacent pair forms a piece any more."""
        symbols = list(chunk)
        n = len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        cost = self.cost
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in cost:
                agenda.append((cost[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = right[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                wider = pair + symbols[k]
                if wider in cost:
                    heapq.heappush(agenda, (cost[wider], i, wider))
            h = left[i]
            if h >= 0:
                wider = symbols[h] + pair
                if wider in cost:
                    heapq.heappush(agenda, (cost[wider], h, wider))
        return [s for s in symbols if s]

    def encode_chunk(self, chunk: str) -> bytes:
        out = []
        for symbol in self.merge(chunk):
            packed = self.ids.get(symbol)
            if packed is not None:
                out.append(packed)
            elif self.has_bytes:
                out += [self.byte_ids[b] for b in symbol.encode()]
            elif not out or out[-1] is not self.unknown:
                out.append(self.unknown)
        return b"".join(out)

    def chunks(self, text: str) -> list[str]:
        """The text with its leading space mark, cut where no piece can cross."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.cut(marked) if self.cut else [marked]

    def check(self, chunks: list[str]) -> None:
        """The library must encode each chunk alike (it adds the first mark itself)."""
        before = [MARK + c for c in STANDS_BEFORE]
        for chunk in before:
            self.known[chunk] = self.encode_chunk(chunk)
        # A lone mark would be the library's empty text, which it encodes as nothing.
        chunks = [c for c in chunks if c != MARK]
        stand = [None if c[0] == MARK else before[c[0].isalpha()] for c in chunks]
        theirs = self.library.encode([c[1:] if s is None else s[1:] + c for c, s in zip(chunks, stand, strict=True)], num_threads=1)
        known = self.known
        ours = [known[c] if s is None else known[s] + known[c] for c, s in zip(chunks, stand, strict=True)]
        if np.fromiter(itertools.chain.from_iterable(theirs), "<u4").tobytes() != b"".join(ours):
            wrong = next(c for c, ids, own in zip(chunks, theirs, ours, strict=True) if np.array(ids, "<u4").tobytes() != own)
            raise ValueError(f"differs from the library on {wrong!r}")

    def whole(self, parts):
        """Parts of a text; without byte pieces, an unknown id does not follow another."""
        if self.has_bytes:
            return parts
        ids = np.frombuffer(b"".join(parts), "<u4")
        unknown = ids == int.from_bytes(self.unknown, "little")
        return [ids[~(unknown & np.r_[False, unknown[:-1]])].tobytes()]

    def verify(self, text: str, packed: bytes) -> None:
        """The library must encode the whole text alike."""
        if np.array(self.library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes() != packed:
            raise ValueError(f"differs from the library on a text that starts with {text[:80]!r}")

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, little-endian unsigned 32-bit, with begin and end."""
        known = self.known
        for start in range(0, len(texts), 256):
            if len(known) > CACHE_CHUNKS:
                known.clear()
            cut = [self.chunks(t) for t in texts[start : start + 256]]
            found = [list(map(known.get, chunks)) for chunks in cut]
            fresh = list({c for chunks, got in zip(cut, found, strict=True) if None in got for c, ids in zip(chunks, got, strict=True) if ids is None})
            if fresh:
                self.encode_chunks(fresh)
                self.check(fresh)
            for chunks, got in zip(cut, found, strict=True):
                yield b"".join([self.begin, *self.whole(map(known.__getitem__, chunks) if None in got else got), self.end])
            for chunk in fresh:
                if len(chunk) > CACHE_CHARS:
                    del known[chunk]


_agendas: dict[str, Agenda] = {}


def agenda_of(model_file: str) -> Agenda:
    """One per worker process and file."""
    if model_file not in _agendas:
        _agendas[model_file] = Agenda(model_file)
    return _agendas[model_file]


def encode_decode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False, check_every: int = 50) -> DataFrame:
    """One row per document: id, n_tokens (all ids), ids_sha256, decoded_sha256; and, with_output,
    the ids themselves (array of int) and the decoded text. Rows that repeat are each encoded;
    other columns of docs are left aside."""
    schema = "{} {}, n_tokens long, ids_sha256 string, decoded_sha256 string".format(f"`{id_col}`", dict(docs.dtypes)[id_col])
    if with_output:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        agenda = agenda_of(model_file)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, ids_sha, decoded_sha, all_ids, decoded = [], [], [], [], []
                for i, text, packed in zip(part.column(0).to_pylist(), texts, agenda.encode_batch(texts), strict=True):
                    if (i if isinstance(i, int) else zlib.crc32(repr(i).encode())) % check_every == 0:
                        agenda.verify(text, packed)
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    text = agenda.library.decode(ids)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    decoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_output:
                        all_ids.append(ids)
                        decoded.append(text)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if with_output:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), schema)
