"""SentencePiece (BPE) encoding and decoding with a given model file.

Encoding matches by suffix array. No piece holds a space mark after another character, so a text falls apart into chunks (spaces and
the characters up to the next one) that are encoded alone. Batches are gathered until they hold some megabytes of text; their distinct
chunks that are new are concatenated, the suffixes of that text are sorted up to the longest piece by rank doubling, and every piece of
the vocabulary is binary-searched for its range of occurrences. The occurrences are edges; sorted by end position they are relaxed from left to right:
the encoding of a prefix ends with the one piece that is compatible with the piece before it, that is, no better merge crosses the seam
between the two. That is read from a table of all splits of pieces: the later of the two last merges is undone until both sides are
characters, and at each step the pair at the seam must not have a merge of its own that comes before the one just undone.

Runs of several spaces, whose pieces share one lowest score, are joined from the left after all else, as the model does.
Characters outside the vocabulary, U+0000 among them, fall back to byte pieces. Ids are those of the SentencePiece library for the same model.

Nothing is shuffled, and work stays within a task. Memory: some megabytes of text (or one text) at a time; chunks of up to ``SHORT``
characters are remembered by worker processes, a bounded number of them; longer ones are matched in windows of ``BLOCK`` characters,
between which only the place and id of the best piece for each end position are held.

Defined results: null and empty texts have no ids and decode to the empty text; a text with the space mark U+2581 itself decodes to one
with spaces, so its round trip is not exact; repeated rows are encoded alike; null ids are passed on; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanings.llm.common import GROUP_BYTES, grouped_batches, small_batches

MARK = "▁"
#: Chunks up to this length are relaxed together and remembered.
SHORT = 64
#: Characters that are matched at once.
BLOCK = 200_000
#: Separates chunks in the joined text; beyond all code points, so no text has it.
_SEPARATOR, _BEYOND = 0x110000, 0x110001
_ANY = 1 << 40
_UNKNOWN, _BEGIN = -2, -3


class Pieces:
    """The vocabulary: ids, merge ranks and splits of its pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", names[i]) for i in plain):
            raise ValueError("a piece goes over a space mark or a line end: chunks can't be encoded alone")
        if any(c not in self.ids for i in plain for c in names[i]):
            raise ValueError("a piece has a character that is no piece")
        self.scores = [sp.get_score(i) for i in range(n)]
        surface = {i: bytes([int(names[i][1:-1], 16)]) for i in range(n) if sp.is_byte(i)}
        self.byte_table = np.full(256, sp.unk_id())
        for i, b in surface.items():
            self.byte_table[b[0]] = i
        surfaces = [surface.get(i, b"" if sp.is_control(i) else names[i].replace(MARK, " ").encode()) for i in range(n)]
        surfaces[sp.unk_id()] = " ⁇ ".encode()
        self.surface_sizes = np.array([len(x) for x in surfaces], np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        # pieces of several space marks only are left to space_run()
        words = [i for i in plain if not (len(names[i]) > 1 and set(names[i]) == {MARK})]
        self._split(n, names, words)
        words = [i for i in words if self.left[i] >= 0 or len(names[i]) == 1]
        table = sorted((names[i], i) for i in words)
        self.longest = max(len(p) for p, _ in table)
        self.pieces = np.array([p for p, _ in table], f"U{self.longest + 1}")
        self.piece_ids = np.array([i for _, i in table], np.int64)
        self.piece_lengths = np.array([len(p) for p, _ in table], np.int64)
        # the first string after all that begin with the piece
        codes = self.pieces.view(np.uint32).reshape(len(table), -1).copy()
        codes[np.arange(len(table)), self.piece_lengths] = _BEYOND
        self.after = codes.view(f"U{self.longest + 1}")[:, 0]

    def _split(self, n: int, names: list[str], words: list[int]) -> None:
        """Rank of every piece's last merge (-1: a character), the two pieces it joins, and the ranks of all pairs that join to a piece."""
        self.n, self.rank, self.left, self.right = n, np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        order = {s: k for k, s in enumerate(sorted({-self.scores[i] for i in words}))}
        ids, made = {names[i]: i for i in words}, []
        for i in words:
            if len(names[i]) > 1:
                self.rank[i] = order[-self.scores[i]]
                made += [(len(names[i]), ids[names[i][:k]], ids[names[i][k:]], i) for k in range(1, len(names[i])) if names[i][:k] in ids and names[i][k:] in ids]
        size, a, b, piece = np.array(made, np.int64).reshape(-1, 4).T
        by = np.argsort(a * n + b)
        self.pair_codes, self.pair_ranks = (a * n + b)[by], self.rank[piece[by]]
        for length in np.unique(size):  # the splits of shorter pieces are known by then
            at = np.flatnonzero((size == length) & (self.rank[a] < self.rank[piece]) & (self.rank[b] < self.rank[piece]))
            at = at[self.apart(a[at], b[at], self.rank[piece[at]])]
            self.left[piece[at]], self.right[piece[at]] = a[at], b[at]

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each two pieces, side by side, stay apart (up to a rank): no better merge crosses the seam before each is complete."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _ANY) if limit is None else limit
        while len(at):
            code = a * self.n + b
            k = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            crossed = (self.pair_codes[k] == code) & (self.pair_ranks[k] < limit)
            out[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)  # of equal merges the left one comes first
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            # a piece that its own text is not encoded to never stands anywhere
            known = (a >= 0) & (b >= 0)
            out[at[~known]] = False
            at, a, b, limit = at[known], a[known], b[known], limit[known]
        return out


def _suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """Places of a text (code points) in the order of its suffixes, which count up to the longest piece."""
    symbols, code = np.unique(text, return_inverse=True)
    bits = max(1, int(len(symbols)).bit_length())
    reach = min(64 // bits, longest)
    rank = np.zeros(len(text) + reach, np.uint64)
    rank[: len(text)] = code + 1
    first = rank[: len(text)].copy()
    for i in range(1, reach):  # the first characters of a suffix in one number
        first = (first << np.uint64(bits)) | rank[i : i + len(text)]
    while reach < longest:
        rank = np.unique(first, return_inverse=True)[1].astype(np.int64) + 1
        ahead = np.zeros_like(rank)
        ahead[: max(0, len(text) - reach)] = rank[reach:]
        first = rank * (len(text) + 2) + ahead
        reach *= 2
    return np.argsort(first, kind="stable")


class Codec:
    """A vocabulary and the chunks met so far."""

    def __init__(self, model_file: str, remember: int = 400_000):
        self.p, self.remember = Pieces(model_file), remember
        self.runs: dict[int, list[int]] = {}
        self.known: dict[str, int] = {}
        self.pool, self.used, self.starts, self.sizes = np.zeros(1 << 16, np.int32), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every occurrence of every piece in a text; a character outside the vocabulary is an edge of its own."""
        p = self.p
        text = np.append(text, np.uint32(_SEPARATOR))  # so that the text's end sorts as a chunk's end does
        order = _suffixes(text, p.longest)
        padded = np.concatenate([text, np.full(p.longest, _SEPARATOR, text.dtype)])
        heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, p.longest)[order]).view(f"U{p.longest}")[:, 0]
        low, high = np.searchsorted(heads, p.pieces, "left"), np.searchsorted(heads, p.after, "left")
        n = high - low
        piece = np.repeat(np.arange(len(n)), n)
        start = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[piece]]
        alone = text != _SEPARATOR
        alone[start[p.piece_lengths[piece] == 1]] = False
        alone = np.flatnonzero(alone)
        end = np.concatenate([start + p.piece_lengths[piece], alone + 1])
        return np.concatenate([start, alone]), end, np.concatenate([p.piece_ids[piece], np.full(len(alone), _UNKNOWN)])

    def relax(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of chunks of up to SHORT characters and the number of ids of each; one end position of all chunks at a time."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        text = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le"), "<u4").copy()
        text[ends] = _SEPARATOR
        start, end, piece = self.edges(text)
        offset = np.repeat(begins, lengths + 1)
        step = end - offset[start]
        by = np.argsort(step.astype(np.int16), kind="stable")
        start, end, piece = start[by], end[by], piece[by]
        bounds = np.searchsorted(step[by], np.arange(1, int(lengths.max(initial=0)) + 2))
        last, before = np.full(len(text) + 1, _BEGIN), np.zeros(len(text) + 1, np.int64)
        for i, j in zip(bounds, bounds[1:], strict=False):
            a, b = last[start[i:j]], piece[i:j]
            fits = np.ones(j - i, bool)
            doubt = np.flatnonzero((a >= 0) & (b >= 0))
            fits[doubt] = self.p.apart(a[doubt], b[doubt])
            at = end[i:j][fits]
            last[at], before[at] = b[fits], start[i:j][fits]
        return self._read_back(text, begins, ends, last, before)

    def _read_back(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids, and the number of ids, of chunks from the last pieces of their prefixes."""
        chunk, at, places = np.arange(len(ends)), ends, []
        while len(chunk):
            on = at > begins[chunk]
            chunk, at = chunk[on], at[on]
            places.append(at)
            at = before[at]
        place = np.sort(np.concatenate([*places, np.zeros(0, np.int64)]))  # places are in the order of chunks
        ids, n = last[place], np.ones(len(place), np.int64)
        odd = np.flatnonzero(ids == _UNKNOWN)
        if len(odd):  # the bytes of a character outside the vocabulary
            codes = text[place[odd] - 1].astype("<u4")
            n[odd] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            ids = np.repeat(ids, n)
            ids[ids == _UNKNOWN] = self.p.byte_table[np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids, np.add.reduceat(np.append(n, 0), np.searchsorted(place, begins, "right")) * (ends > begins)

    def long_chunk(self, chunk: str) -> np.ndarray:
        """Ids of a chunk of any length, matched in windows that overlap by the longest piece."""
        text = np.frombuffer(chunk.encode("utf-32-le"), "<u4")
        n, reach, pairs = len(text), self.p.longest, {}
        last, before = np.full(n + 1, _BEGIN, np.int32), np.zeros(n + 1, np.int32)
        for s in range(0, n, BLOCK):
            from_, to = max(0, s - reach), min(n, s + BLOCK)
            start, end, piece = self.edges(text[from_:to])
            new = end + from_ > s
            start, end, piece = start[new], end[new], piece[new]
            by = np.argsort(end, kind="stable")
            mine, back = last[from_ : to + 1].tolist(), before[from_ : to + 1].tolist()
            for i, j, b in zip(start[by].tolist(), end[by].tolist(), piece[by].tolist(), strict=True):
                a = mine[i]
                if a >= 0 and b >= 0:
                    fits = pairs.get(a << 32 | b)
                    if fits is None:
                        if len(pairs) > 500_000:
                            pairs.clear()
                        fits = pairs[a << 32 | b] = bool(self.p.apart(np.array([a]), np.array([b]))[0])
                    if not fits:
                        continue
                mine[j], back[j] = b, i + from_
            last[from_ : to + 1], before[from_ : to + 1] = mine, back
        ends, at = np.zeros(n + 1, bool), n
        while at:
            ends[at] = True
            at = int(before[at])
        place = np.flatnonzero(ends)
        # every character is a chunk of its own in _read_back, which then only resolves unknown ones
        return self._read_back(text, place - 1, place, last, np.maximum(np.arange(n + 1) - 1, 0))[0]

    def space_run(self, n: int) -> list[int]:
        """Ids of n space marks alone: the best-scored neighbours join first, the leftmost of equals."""
        if n > 1_000:  # longer ones are not remembered
            return self._space_run(n)
        if n not in self.runs:
            self.runs[n] = self._space_run(n)
        return self.runs[n]

    def _space_run(self, n: int) -> list[int]:
        ids, scores = self.p.ids, self.p.scores
        size, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
        agenda: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (piece := ids.get(MARK * (size[i] + size[after[i]]))) is not None:
                heapq.heappush(agenda, (-scores[piece], i, size[i] + size[after[i]]))

        for i in range(n):
            offer(i)
        while agenda:
            _, i, total = heapq.heappop(agenda)
            if size[i] and after[i] >= 0 and size[i] + size[after[i]] == total:
                j = after[i]
                size[i], size[j], after[i] = total, 0, after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                offer(before[i])
                offer(i)
        return [ids[MARK * k] for k in size if k]

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of chunks."""
        first, n = len(self.known), len(chunks)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        if first + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x[:first], np.zeros(first + 2 * n, np.int64)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[first : first + n], self.sizes[first : first + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.known.update(zip(chunks, range(first, first + n), strict=True))

    def _forget(self) -> None:
        """What came first is what comes most often: the earlier half stays."""
        half = self.remember // 2
        self.known = dict(zip(list(self.known)[:half], range(half), strict=False))
        self.used = int(self.starts[len(self.known) - 1] + self.sizes[len(self.known) - 1]) if self.known else 0

    def learn(self, chunks: list[str]) -> None:
        """Encode short new chunks with one leading space or none, and keep them; in blocks of characters."""
        chunks, block, held = sorted(chunks), [], 0
        for c in chunks:
            block.append(c)
            held += len(c) + 1
            if held > BLOCK:
                self._keep(block, *self.relax([x.replace(" ", MARK) for x in block]))
                block, held = [], 0
        if block:
            self._keep(block, *self.relax([x.replace(" ", MARK) for x in block]))

    def _spaced(self, chunk: str) -> np.ndarray:
        """Ids of a chunk that begins with several spaces."""
        word = chunk.lstrip(" ")
        if not word:
            return np.array(self.space_run(len(chunk)))
        more, rest = len(chunk) - len(word) - 1, self._one(" " + word)
        if rest[0] == self.p.ids.get(MARK):
            return np.concatenate([self.space_run(more + 1), rest[1:]])
        return np.concatenate([self.space_run(more), rest])

    def _one(self, chunk: str) -> np.ndarray:
        k = self.known.get(chunk)
        if k is not None:
            return self.pool[self.starts[k] : self.starts[k] + self.sizes[k]]
        return self.relax([chunk.replace(" ", MARK)])[0] if len(chunk) <= SHORT else self.long_chunk(chunk.replace(" ", MARK))

    def encode_unique(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of distinct chunks and the number of ids of each."""
        if len(self.known) + len(chunks) > self.remember and len(self.known) > self.remember // 2:
            self._forget()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        odd = []
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [chunks[i] for i in new.tolist()]
            self.learn([c for c in fresh if len(c) <= SHORT and c[:2] != "  "])
            at[new] = np.fromiter(map(self.known.get, fresh, repeat(-1)), np.int64, len(fresh))
            odd = [(i, self._spaced(chunks[i]) if chunks[i][:2] == "  " else self._one(chunks[i])) for i in np.flatnonzero(at < 0).tolist()]
        k = np.maximum(at, 0)
        sizes, starts = np.where(at < 0, 0, self.sizes[k]), self.starts[k]
        for i, ids in odd:
            sizes[i] = len(ids)
        ends = np.cumsum(sizes)
        out = self.pool[np.minimum(_runs(starts, sizes), max(0, len(self.pool) - 1))]
        for i, ids in odd:
            out[ends[i] - sizes[i] : ends[i]] = ids
        return out, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of texts and the number of ids of each."""
        raw, bounds = _spaced_buffer(pc.replace_substring(texts, MARK, " "))
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        # a chunk begins with a text, with the first space of a run, and with and after a line end
        blank, line = raw == 32, raw == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        cut[bounds[:-1][bounds[:-1] < len(raw)]] = True
        begins = np.flatnonzero(cut)
        chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw)).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        which = chunks.indices.to_numpy()
        flat, sizes = self.encode_unique(chunks.dictionary.to_pylist())
        n = sizes[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[_runs((np.cumsum(sizes) - sizes)[which], n)]
        return ids, np.diff(total[np.searchsorted(begins, bounds)])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined surfaces of concatenated ids, as bytes, and the number of bytes of each of the texts of so many ids."""
        n = self.p.surface_sizes[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(int(total[-1]), np.uint8)
        for i in range(0, len(ids), 1_000_000):
            part = slice(i, i + 1_000_000)
            at = self.p.surface_starts[ids[part]]
            out[total[i] : total[min(i + 1_000_000, len(ids))]] = self.p.surface_bytes[_runs(at, n[part])]
        return out, np.diff(total[np.concatenate([[0], np.cumsum(sizes)])])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _spaced_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts that are not empty, each with a space in front, and the bounds of all texts in it."""
    texts = pc.fill_null(texts, "")
    joined = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
    bounds = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64) if len(joined) else np.zeros(1, np.int64)
    data = joined.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One for each model and worker process."""
    return Codec(model_file)


def _per_group(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to some megabytes of rows at a time, within the tasks that read df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, GROUP_BYTES // 2):
            yield function(group)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text and ids (array<int>) of every row of docs. The model file must be at the same path on every executor."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes = codec(model_file).encode(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids, sizes)], names=["doc_id", "text", "ids"])

    return _per_group(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id and text; the space that encoding put in front of a text is left out again."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out, n = codec(model_file).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        ends, raw = np.cumsum(n).tolist(), out.tobytes()
        found = [raw[b - k : b].removeprefix(b" ").decode("utf-8", "replace") for b, k in zip(ends, n.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return _per_group(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, n_tokens and exact: whether decoding the ids gives the text back, for every row of docs; one pass over the texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_file)
        ids, sizes = c.encode(batch.column(1))
        out, n = c.decode(ids, sizes)
        raw, bounds = _spaced_buffer(batch.column(1))
        ends = np.cumsum(n).tolist()
        out, raw = memoryview(out), memoryview(raw)
        exact = [out[b - k : b] == raw[c:d] for b, k, c, d in zip(ends, n.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, sizes), pa.array(sizes), pa.array(exact)], names=["doc_id", "ids", "n_tokens", "exact"])

    return _per_group(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, n_tokens long, exact boolean")


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
