"""Byte-level BPE under an existing vocabulary: ids of texts, and numbers of tokens.

A vocabulary is a file of base64 tokens with their ranks. It is read once on the driver, its merges are worked out
(some 50,000 pairs, a size fixed by the file) and broadcast as arrays, so that executors need no file.

``encode`` gives ids: within each pre-split piece a segment tree over the ranks of adjacent pairs yields the leftmost
pair of lowest rank at its root; a merge updates three leaves, each in logarithmic time, until no pair can be merged.

``merge`` gives numbers of tokens of distinct pieces: they are stored as one array of symbols; adjacent pairs are joined with
the merge ranks, the lowest-ranked pairs of every piece are merged at once, and this is repeated until nothing merges.
``piece_counts`` and ``piece_sizes`` do so for a whole table, with each distinct piece of it merged once: pieces are counted
per slice where the texts are read, a piece that is a token by itself only as one token, and all others are made distinct,
merged, written, and joined back to their counts. ``count_tokens`` counts texts one by one where the sum of each is wanted.

Texts, pieces and caches of any size give the same ids and numbers: a long piece is only not kept for a second use, a long
text is split as it is read, and a full cache is emptied.

Defined results: null and empty texts have no ids and no tokens; what looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies, unless a caller names another file.
VOCABULARY = os.environ.get("WEFT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pre-split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 30


@lru_cache(maxsize=4)
def merges(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the 256 bytes, left, right and merged ids in order of rank) of a vocabulary file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    left, right, merged = [], [], []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (r if (r := ranks.get(parts[i] + parts[i + 1], NONE)) < rank else NONE, i))
            if ranks.get(parts[best] + parts[best + 1], NONE) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            left.append(ranks[parts[0]])
            right.append(ranks[parts[1]])
            merged.append(rank)
    return tuple(np.array(x, dtype=np.int64) for x in ([ranks[bytes([b])] for b in range(256)], left, right, merged))


class Encoder:
    """Ids and numbers of tokens; one per Python worker, with bounded caches of pieces."""

    KEPT = 300_000  # pieces
    KEPT_CHARS = 8_000_000  # of whole texts that are counted again and again

    def __init__(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        self.tables = tables
        self.bytes, left, right, merged = tables
        self.wide = int(max(merged.max(initial=0), self.bytes.max())) + 1
        keys = left * self.wide + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.merged = keys[order], merged[order]
        self.pair = dict(zip(keys.tolist(), merged.tolist(), strict=True))
        self.byte_list = self.bytes.tolist()
        self.split = regex.compile(PATTERN)
        self._whole: frozenset[bytes] | None = None
        self.ids: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}
        self.texts: dict[str, int] = {}
        self.chars = 0

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, by a segment tree over the ranks of its adjacent pairs."""
        byte, pair, wide = self.byte_list, self.pair, self.wide
        ids = [byte[b] for b in text.encode("utf-8")]
        n = len(ids)
        if n < 2:
            return ids
        half = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * half)
        for i in range(n - 1):
            tree[half + i] = pair.get(ids[i] * wide + ids[i + 1], NONE)
        for i in range(half - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree[1]) < NONE:
            i = 1
            while i < half:
                i *= 2
                if tree[i] != low:
                    i += 1
            i -= half
            j = after[i]
            k = after[j]
            ids[i], after[i] = low, k
            ids[j] = -1
            changed = [(i, pair.get(low * wide + ids[k], NONE) if k < n else NONE)]
            if k < n:
                before[k] = i
            if j < n - 1:
                changed.append((j, NONE))
            p = before[i]
            if p >= 0:
                changed.append((p, pair.get(ids[p] * wide + low, NONE)))
            for leaf, rank in changed:
                x = half + leaf
                tree[x] = rank
                x >>= 1
                while x:
                    a, b = tree[2 * x], tree[2 * x + 1]
                    new = a if a <= b else b
                    if tree[x] == new:
                        break
                    tree[x] = new
                    x >>= 1
        return [t for t in ids if t >= 0]

    def whole(self, piece: str) -> bool:
        """Whether a piece is a token by itself: its own merges lead to it, and no other can come before them."""
        if self._whole is None:
            left, right, merged = self.tables[1:]
            texts = {int(i): bytes([b]) for b, i in enumerate(self.byte_list)}
            for a, b, m in zip(left.tolist(), right.tolist(), merged.tolist(), strict=True):  # in order of rank, so that the parts are known
                texts[m] = texts[a] + texts[b]
            self._whole = frozenset(texts.values())
        return piece.encode("utf-8") in self._whole

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.ids
        for m in self.split.finditer(text) if len(text) > 1_000_000 else self.split.findall(text):
            p = m if isinstance(m, str) else m.group()
            got = known.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) < 64:
                    if len(known) >= self.KEPT:
                        known.clear()
                    known[p] = got
            out += got
        return out

    def merge(self, pieces: list[str]) -> np.ndarray:
        """Numbers of tokens of distinct pieces, all merged side by side."""
        raw = [p.encode("utf-8") for p in pieces]
        out = np.zeros(len(raw), dtype=np.int64)
        symbol = self.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        last = len(self.keys) - 1
        while len(symbol):
            key = symbol[:-1] * self.wide + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), max(last, 0))
            rank = np.where((owner[:-1] == owner[1:]) & (self.keys[at] == key), self.merged[at], NONE) if last >= 0 else np.full(len(key), NONE)
            best = np.full(len(raw), NONE, dtype=np.int64)
            np.minimum.at(best, owner[:-1], rank)
            settled = best[owner] == NONE
            if settled.any():
                out += np.bincount(owner[settled], minlength=len(raw))
            hit = np.flatnonzero((rank < NONE) & (rank == best[owner[:-1]]))
            if not len(hit):
                break
            # equal pairs that overlap, as in a run of one symbol, merge from the left: every second one of a run
            start = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
            run = np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))
            hit = hit[run % 2 == 0]
            symbol[hit] = rank[hit]
            keep = ~settled
            keep[hit + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        return out

    def _learn(self, pieces: set[str]) -> None:
        fresh = sorted(pieces.difference(self.sizes), key=len)
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            self.sizes.update(zip(part, self.merge(part).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        """Numbers of tokens of whole texts."""
        out, todo, chars = [0] * len(texts), [], 0

        def flush() -> None:
            nonlocal todo, chars
            if len(self.sizes) >= self.KEPT:
                self.sizes.clear()
            lists = [(i, t, self.split.findall(t)) for i, t in todo]
            self._learn(set().union(*(x for _, _, x in lists)))
            for i, t, pieces in lists:
                out[i] = sum(map(self.sizes.__getitem__, pieces))
                self._keep(t, out[i])
            todo, chars = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            known = self.texts.get(t) if len(t) > 500 else None
            if known is not None:
                out[i] = known
            elif len(t) > 2_000_000:  # its pieces are counted as they come
                pieces = Counter(m.group() for m in self.split.finditer(t))
                self._learn(set(pieces))
                out[i] = sum(n * self.sizes[p] for p, n in pieces.items())
            else:
                todo.append((i, t))
                chars += len(t)
                if chars > 500_000:
                    flush()
        flush()
        return out

    def _keep(self, text: str, n: int) -> None:
        if 500 < len(text) < 100_000:
            if self.chars > self.KEPT_CHARS:
                self.texts.clear()
                self.chars = 0
            if text not in self.texts:
                self.texts[text] = n
                self.chars += len(text)


_WORKER: list[Encoder] = []


def worker_encoder(shared) -> Encoder:
    """The encoder of this Python worker; workers are reused from task to task, and so are its caches."""
    tables = shared.value
    if not _WORKER or not all(np.array_equal(x, y) for x, y in zip(_WORKER[0].tables, tables, strict=True)):
        _WORKER[:] = [Encoder(tables)]
    return _WORKER[0]


def _share(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(merges(path))


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens."""
    shared = _share(df, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                flat: list[np.ndarray] = []
                ends = [0]
                for t in part.column(1).to_pylist():
                    ids = np.array(encoder.encode(t), dtype=np.int32)
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, texts: str, path: str = VOCABULARY, name: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of its column ``texts``, a text or an array of texts, in place of that column."""
    shared = _share(df, path)
    rest = [c for c in df.columns if c != texts]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    nested = df.schema[texts].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            cells = batch.column(batch.num_columns - 1).to_pylist()
            if nested:
                flat = [t for cell in cells for t in cell or ()]
                counts = iter(encoder.count(flat))
                sums = [sum(next(counts) for _ in cell or ()) for cell in cells]
            else:
                sums = encoder.count(cells)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*rest, name])

    return df.select(*rest, texts).mapInArrow(run, f"{kinds}, `{name}` bigint" if kinds else f"`{name}` bigint")


def piece_counts(df: DataFrame, dims: list[str], texts: str, path: str = VOCABULARY) -> DataFrame:
    """(dims, piece, n): how often each distinct piece stands in the column ``texts`` (a text or an array of texts) of a slice.

    Pieces that are tokens by themselves are counted together under a null piece. Equal texts that come close together, such as
    shared system messages, are split once. Counts are summed up within a task before they are shuffled.
    """
    shared = _share(df, path)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in dims)
    schema = f"{kinds}, piece string, n bigint" if kinds else "piece string, n bigint"
    types = [pa.string() if df.schema[c].dataType.simpleString() == "string" else None for c in dims]
    nested = df.schema[texts].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        whole: dict[str, bool] = {}
        waiting: dict[str, Counter] = {}
        found: dict[tuple, Counter] = {}
        chars = entries = 0

        def split() -> None:
            nonlocal chars, entries
            for text, slices in waiting.items():
                pieces = (m.group() for m in encoder.split.finditer(text)) if len(text) > 2_000_000 else encoder.split.findall(text)
                if len(slices) > 1 or max(slices.values()) > 1:
                    pieces = Counter(pieces)
                for key, times in slices.items():
                    own = found.setdefault(key, Counter())
                    entries -= len(own)
                    if isinstance(pieces, Counter):
                        for p, n in pieces.items():
                            own[p] += n * times
                    else:
                        own.update(pieces)
                    entries += len(own)
            waiting.clear()
            chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal entries
            columns: list[list] = [[] for _ in range(len(dims) + 2)]
            for key, own in found.items():
                single, start = 0, len(columns[-1])
                for p, n in own.items():
                    known = whole.get(p)
                    if known is None:
                        known = encoder.whole(p)
                        if len(p) < 64:
                            whole[p] = known
                    if known:
                        single += n
                    else:
                        columns[-2].append(p)
                        columns[-1].append(n)
                columns[-2].append(None)
                columns[-1].append(single)
                for column, value in zip(columns, key, strict=False):
                    column += [value] * (len(columns[-1]) - start)
            found.clear()
            entries = 0
            if len(whole) > encoder.KEPT:
                whole.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string(), pa.int64()], strict=True)], names=[*dims, "piece", "n"])

        for batch in batches:
            cells = batch.column(len(dims)).to_pylist()
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(dims))), strict=True) if dims else (() for _ in cells)
            for key, cell in zip(keys, cells, strict=True):
                for text in (cell or ()) if nested else (cell,):
                    if text:
                        if text not in waiting:
                            waiting[text] = Counter()
                            chars += len(text)
                        waiting[text][key] += 1
                if chars > 1_000_000:
                    split()
                    if entries > 500_000:
                        yield flush()
        split()
        yield flush()

    counted = df.select(*dims, texts).mapInArrow(run, schema)
    return counted.groupBy(*dims, "piece").agg(F.sum("n").alias("n"))


def piece_sizes(pieces: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(piece, tokens) of ``pieces(piece)``, distinct pieces, all of a batch merged side by side."""
    shared = _share(pieces, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            found = batch.column(0).to_pylist()
            order = sorted(range(len(found)), key=lambda i: len(found[i]))  # pieces of like length are done after like many rounds
            sizes = np.zeros(len(found), dtype=np.int64)
            for start in range(0, len(order), 50_000):
                part = order[start : start + 50_000]
                sizes[part] = encoder.merge([found[i] for i in part])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=["piece", "tokens"])

    return pieces.select("piece").mapInArrow(run, "piece string, tokens bigint")
