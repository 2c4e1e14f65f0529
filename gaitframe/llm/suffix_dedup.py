"""Byte-level dedup by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import CROWD, apply_ranges, byte_tokens, keyed, ranges, resolve, summed
from .shared import Scratch

LENGTH, ANCHOR = 200, 64


@lru_cache
def difference_cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """Residues D mod v and, for each pair of residues, the least d with both moved by d in D.

    D is 0 .. r-1 and the multiples of r below v (r near the root of v), a difference cover by rule.
    """
    r = int(np.ceil(np.sqrt(v)))
    cover = np.zeros(v, dtype=bool)
    cover[:r] = cover[r::r] = True
    shift = np.full((v, v), -1, dtype=np.int64)
    i = np.arange(v)
    for d in range(v - 1, -1, -1):
        both = cover[(i[:, None] + d) % v] & cover[(i[None, :] + d) % v]
        shift[both] = d
    assert (shift >= 0).all()
    return cover, shift


def _strings(data: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The n bytes at each place as one fixed-length value that sorts by bytes."""
    view = np.lib.stride_tricks.sliding_window_view(data, n)
    return np.ascontiguousarray(view[place]).view(f"V{n}").ravel().view(f"S{n}")


def _ranks(s: np.ndarray) -> np.ndarray:
    """Dense ranks; bytes of fixed length compare as padded strings, so zero bytes do no harm."""
    order = np.argsort(s, kind="stable")
    new = np.ones(len(s), dtype=np.int64)
    if len(s):
        raw = s.view(f"V{s.dtype.itemsize}")[order]
        new[0] = 0
        new[1:] = raw[1:] != raw[:-1]
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_classes(data: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Labels of the suffixes at place, equal where their first n bytes are.

    The suffixes of a bucket are sorted by their first v bytes. Long ties go on as a three-way quicksort
    whose comparison needs no text up to byte n - v: for any two places a shift d < v takes both onto the
    cover sample, where ranks of n - v bytes are known. Only the last v bytes may be read again.
    """
    v = max(2, min(64, n // 3))
    cover, shift = difference_cover(v)
    label = _ranks(_strings(data, place, v))
    size = np.bincount(label)
    open_ = np.flatnonzero(size[label] > 1)
    if n == v or not len(open_):
        return label
    mid = n - v
    # Ranks of the cover sample, at the places the ties can be shifted to.
    need = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(need, place[open_], 1)
    np.subtract.at(need, np.minimum(place[open_] + v, len(data)), 1)
    sample = np.flatnonzero((np.cumsum(need)[:-1] > 0) & cover[np.arange(len(data)) % v])
    sample = sample[sample + mid <= len(data)]
    rank = np.full(len(data), -1, dtype=np.int64)
    rank[sample] = _ranks(_strings(data, sample, mid))
    group, fresh = label.copy(), int(label.max()) + 1
    rng = np.random.default_rng(1)
    while len(open_):
        order = open_[np.argsort(group[open_], kind="stable")]
        g = group[order]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        count = np.diff(np.append(head, len(g)))
        pivot = order[head + (rng.random(len(head)) * count).astype(np.int64)]
        other = np.repeat(pivot, count)
        i, j = place[order], place[other]
        d = shift[i % v, j % v]
        side = np.sign(rank[i + d] - rank[j + d])
        level = np.flatnonzero(side == 0)
        if len(level):
            a, b = (_strings(data, x[level] + mid, v) for x in (i, j))
            side[level] = np.where(a < b, -1, np.where(a > b, 1, 0))
        part = np.repeat(np.arange(len(head)), count)
        group[order] = fresh + part * 3 + side + 1
        fresh += 3 * len(head)
        todo = order[side != 0]
        n_in = np.bincount(group[todo] - (fresh - 3 * len(head)), minlength=1) if len(todo) else None
        open_ = todo[n_in[group[todo] - (fresh - 3 * len(head))] > 1] if len(todo) else todo
    return np.unique(group, return_inverse=True)[1]


def equal_strings(pieces: list[bytes], count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places whose next n bytes turn up again in the pieces of this block of buckets."""
    size = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    windows = np.maximum(size - n + 1, 0)
    seg = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.repeat(np.cumsum(size) - size, windows) + start
    if not len(place):
        return ranges(seg, start, n)
    label = suffix_classes(data, place, n)
    again = np.bincount(label, weights=count[seg])[label] > 1
    return ranges(seg[again], start[again], n)


def cut_bytes(text: bytes, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(first.tolist(), end.tolist())]


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR, crowd: int = CROWD, bits: int = 64
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) and spans of every row.

    Texts are UTF-8 bytes. A byte goes if any string of `length` bytes that covers it also starts anywhere
    else, in this document or another. Suffixes are dealt into buckets by the anchor of their first
    `length` bytes (see repeats), so a bucket never needs another; suffixes whose bucket holds one place
    are not repeated and are never written out. Each task sorts its buckets block by block.

    Null text is empty. Shorter texts lose nothing. Rows that repeat an id are separate documents, and
    identical rows lose every byte if long enough; null ids are allowed. Long texts are searched in blocks.
    Columns beyond id and text are ignored whatever their names. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "suffix")
    counts = summed(rows, byte_tokens, length, anchor, bits).groupBy("_h").agg(F.sum("_n").alias("_n"))
    again = scratch.write(counts.filter("_n > 1").select("_h"), "again")
    hits = resolve(rows, again, byte_tokens, cut_bytes, equal_strings, length, anchor, scratch, crowd, bits=bits)

    def kept(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple:
        left, at = [], 0
        for a, b in zip(first.tolist(), end.tolist()):
            left.append(text[at:a])
            at = b
        left.append(text[at:])
        return len(text), int((end - first).sum()), len(first), b"".join(left), (first * 2**32 + end).tolist()

    kind = docs.schema[id_col].dataType.simpleString()
    return apply_ranges(rows, hits, id_col, kind, kept, "n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], length: int) -> list[tuple]:
    """The contract itself, for tests: (id, n_bytes, n_removed, n_spans, sha256 of the rest)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = {}
    for _, t in texts:
        for a in range(len(t) - length + 1):
            seen[t[a : a + length]] = seen.get(t[a : a + length], 0) + 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        spans = bytes(gone).split(b"\0")
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for s in spans if s), hashlib.sha256(left).hexdigest()))
    return out
