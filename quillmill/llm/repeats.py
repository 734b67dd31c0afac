"""Suffix-array dedup: repeated byte windows by depth-limited radix sorting.

A byte goes if it lies in a string of `length` = 200 bytes that also starts at
another place, in the same document or in another one. That is the part of a
suffix array in which neighbours agree on `length` bytes, so suffixes need sorting
by their first `length` bytes only. Passes take one digit of that depth each,
coarse to fine, and a suffix leaves as soon as its group is settled:

1. The digit is the window's anchor, the 64-byte string of least hash in it. It
   depends on the window's content alone, so equal windows have equal anchors at
   equal places, and some 60 neighbouring suffixes share one anchor and travel as
   one row. Rows of anchors that occur once leave.
2. Suffixes that stand up to 8 places apart from each other before their anchor
   share the 193 bytes common to their windows as the next digit.
3. The last digit is the whole window.

In each pass a group (`core`) holds rows whose full content (`hull`, all bytes that
their suffixes compare) is known by hash: where a hull occurs twice, all suffixes
of the row are repeated and need no further pass. Only one row of each different
hull of a group goes on to the next pass, so a text in thousands of copies goes on
once, and pre-aggregation keeps a hot group out of any one task. Equality is taken
from two independent 64-bit hashes at once.

Rows whose digit occurs once are held back before they are shuffled by two-pass
Bloom filters of bounded size; a filter that is too full lets more rows pass and
changes no result.

Cases: a null text counts as empty; texts shorter than `length` keep everything;
repeated rows remove each other wholly; matches never cross documents; an empty
table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import RepeatFilter, Stash, repeat_filter, text_of

U = np.uint64
PIECE = 1 << 18
ROW = "core long, hull long, rep long, id long, off long, n long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    k = 1
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
            k += m
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    for _ in range(2):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Hasher:
    """Polynomial hashes of all substrings of a byte buffer, modulo 2**64, over random byte values."""

    def __init__(self, length: int, anchor: int, block: int, seed: int = 7):
        self.length, self.anchor, self.block = length, anchor, block
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=U) | U(1)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        n = 2 * PIECE + 2 * length + 2
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)

    def load(self, b: np.ndarray) -> None:
        self.sums = np.zeros(len(b) + 1, U)
        np.cumsum(self.values[b] * self.up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start..end, wherever in the buffer they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def segments(self, b: np.ndarray, valid: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor place, first suffix, last suffix) of runs of valid suffixes with one anchor; part: what a suffix belongs to."""
        k = self.anchor
        grams = mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(b) - k + 1])
        place = (1 << 21) - 1  # the low bits of the sort key hold the place, so that the first of equal anchors wins
        low = (grams & ~U(place)) | np.arange(len(grams), dtype=U)
        width, have = self.length - k + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        low = (low & U(place)).astype(np.int64)[: len(valid)]
        cut = np.concatenate([[True], (low[1:] != low[:-1]) | (part[1:] != part[:-1])])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(low)) - 1
        keep = valid[first]
        return low[first][keep], first[keep], last[keep]


_HASHERS: dict[tuple[int, int, int], Hasher] = {}


def _hasher(length: int, anchor: int, block: int) -> Hasher:
    key = (length, anchor, block)
    if key not in _HASHERS:
        _HASHERS[key] = Hasher(*key)
    return _HASHERS[key]


def _buffers(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start of each piece, its id, its offset in the document): whole texts, long ones in overlapping pieces."""
    own, ids, offs, n = [], [], [], 0
    for batch in batches:
        for i, t in zip(batch["id"], batch["text"], strict=True):
            for off in range(0, max(1, len(t) - length + 1), PIECE):
                piece = t[off : off + PIECE + length - 1]
                if len(piece) < length:
                    continue
                own.append(piece)
                ids.append(i)
                offs.append(off)
                n += len(piece)
                if n > PIECE:
                    yield np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), np.array(ids, np.int64), np.array(offs, np.int64)
                    own, ids, offs, n = [], [], [], 0
    if own:
        yield np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), np.array(ids, np.int64), np.array(offs, np.int64)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the run, value) for every value of the runs first..last."""
    n = last - first + 1
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run]


def _rows(level: int, length: int, anchor: int, block: int, chosen: tuple[RepeatFilter, ...], again: RepeatFilter | None = None):
    """The rows of one pass; chosen: by pass before, which rows go on; again: which cores may be repeated (all, if not given)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = _hasher(length, anchor, block)
        for b, starts, ids, offs in _buffers(batches, length):
            h.load(b)
            sizes = np.diff(starts)
            part = np.repeat(np.arange(len(sizes)), sizes)[: len(b) - length + 1]
            valid = np.arange(len(part)) <= starts[part + 1] - length
            at, first, last = h.segments(b, valid, part)
            last = np.minimum(last, starts[part[first] + 1] - length)

            def row(core: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
                piece = part[first]
                off = offs[piece] + first - starts[piece]
                hull = h.of(first, last + length) ^ mix((at - first).astype(U) * U(1 << 20) + (last - first).astype(U))
                rep = mix(core ^ mix(hull ^ mix(ids[piece].view(U) ^ mix(off.astype(U)))))
                return core, hull, rep, ids[piece], off, last - first + 1

            core = h.of(at, at + anchor)
            got = row(core, first, last, at)
            if level > 0:
                go = chosen[0].look(got[2].view(np.int64))
                core, first, last, at = core[go], first[go], last[go], at[go]
                # blocks of suffixes by their distance to the anchor, cut to what the run has
                run_of, k = _spread((at - last) // block, (at - first) // block)
                lo, hi = np.maximum(first[run_of], at[run_of] - k * block - block + 1), np.minimum(last[run_of], at[run_of] - k * block)
                at, shared = at[run_of], at[run_of] - k * block
                core = mix(h.of(shared, shared + length - block + 1) ^ mix(core[run_of] + k.astype(U)))
                first, last = lo, hi
                got = row(core, first, last, at)
            if level > 1:
                go = chosen[1].look(got[2].view(np.int64))
                core, first, last, at = core[go], first[go], last[go], at[go]
                run_of, s = _spread(first, last)
                got = row(core[run_of], s, s, at[run_of])
            if again is not None:
                met = again.look(got[0].view(np.int64))
                got = tuple(v[met] for v in got)
            if len(got[0]):
                yield pd.DataFrame({c: v.view(np.int64) for c, v in zip(("core", "hull", "rep", "id", "off", "n"), got, strict=True)})

    return run


def repeated_windows(docs: DataFrame, stash: Stash, length: int = 200, anchor: int = 64, block: int = 8, max_bits: int = 27) -> DataFrame:
    """docs (id long, text binary) -> (id, off, n): windows that start at off .. off + n - 1 are repeated."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, size // 64)
    found, chosen = [], ()
    for level in range(3):
        # the last digit is the hull itself; before, a group may still hold different hulls
        digit = "core" if level < 2 else "hull"
        make = _rows(level, length, anchor, block, chosen)
        if level:
            rows = stash.keep(docs.mapInPandas(make, ROW), f"rows{level}")
            rows = rows.filter(repeat_filter(rows, digit, rows.count(), max_bits).may_repeat(F.col(digit)))
        else:
            again = repeat_filter(docs, digit, expected, max_bits, through=make)
            rows = docs.mapInPandas(_rows(level, length, anchor, block, chosen, again), ROW)
        hulls = stash.keep(rows.groupBy("core", "hull").agg(F.count("*").alias("seen"), F.min("rep").alias("rep")), f"hulls{level}")
        twice = hulls.filter("seen > 1").select("core", "hull")
        found.append(stash.keep(rows.join(twice, ["core", "hull"], "left_semi").select("id", "off", "n"), f"found{level}"))
        if level:
            stash.drop(f"rows{level}")
        if level < 2:
            mixed = hulls.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core")
            reps = hulls.join(mixed, "core", "left_semi").select("rep")
            chosen = (*chosen, repeat_filter(reps, "rep", hulls.count(), max_bits, times=1))
        stash.drop(f"hulls{level}")
    return found[0].union(found[1]).union(found[2])


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, z, off, n in zip(batch["doc"], batch["z"], batch["off"], batch["n"], strict=True):
                text = unpack.decompress(z) if z else b""
                change = np.zeros(len(text) + 1, np.int64)
                if off is not None and len(off):
                    start = np.asarray(off, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + np.asarray(n, np.int64) + length - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = edge.reshape(-1, 2)
                out.append((doc, len(text), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), *((spans[:, 0], spans[:, 1], kept) if with_text else ())))
            yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["span_start", "span_end", "kept"] if with_text else [])])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, with_text: bool = True, max_bits: int = 27) -> DataFrame:
    """One row a document: (id, n_bytes, n_removed, n_spans, kept_sha256), with_text also span_start, span_end and kept (binary)."""
    stash = Stash(docs.sparkSession, "repeats")
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("id"), text_of(text_col).cast("binary").alias("text"))
    windows = repeated_windows(own.select("id", "text"), stash, length, max_bits=max_bits)
    # both lists are filled in the same order, row by row
    spans = windows.groupBy("id").agg(F.collect_list(F.struct("off", "n")).alias("s")).select("id", F.col("s.off").alias("off"), F.col("s.n").alias("n"))

    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        z = zstandard.ZstdCompressor(level=3)
        for s in texts:
            yield pd.Series([z.compress(bytes(t)) if t else b"" for t in s])

    # texts cross the one shuffle that they need compressed
    packed = own.select("doc", "id", F.pandas_udf(pack, "binary")("text").alias("z"))
    schema = f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", span_start array<long>, span_end array<long>, kept binary" if with_text else "")
    return packed.join(spans, "id", "left").select("doc", "z", "off", "n").mapInPandas(_cut(length, with_text), schema).withColumnRenamed("doc", id_col)
