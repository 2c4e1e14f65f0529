"""Whole-corpus search for repeated token runs, shared by the word and the byte operator.

A window is n consecutive tokens of one document. Its anchor is the run of k tokens with the smallest
hash inside it (the leftmost of equals), so equal windows have equal anchors at equal offsets. Windows
next to each other that share one anchor form a segment. Only segments whose anchor fingerprint turns up
again can hold a repeated window. Each of those is read back from its text and named by a 128-bit digest
of its content; segments of one digest are one, and a resolver compares the windows of one fingerprint
by content. The answer then goes back to every place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, Scratch, arrow, chunks, constants, joined, mix, row_keys, sliding_min, window_hash, words_of

TOKENS = 1 << 19
PLACE = U64(2**20 - 1)
#: A place is a segment's first token * 2^SIZE + its number of windows.
SIZE = 20
#: More distinct segments than this behind one fingerprint are spread over tasks, window by window.
CROWD = 4096
#: Segments a task adds up before it passes them on; segments read back at once.
HELD, SLICE = 1 << 20, 4096
_MIXERS = constants(4, 71)


def word_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each document's begin (one more for the end)."""
    data, at = joined(texts, "space")
    h, start, _ = words_of(data)
    return h, np.searchsorted(start, at)


def byte_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    from .shared import BYTE_CODE

    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or b"") for t in texts], out=at[1:])
    return BYTE_CODE[np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)], at


def checked(n: int, k: int) -> None:
    if not 0 < k <= n <= TOKENS:
        raise ValueError(f"an anchor of {k} tokens does not fit a window of {n}, or the window is longer than {TOKENS}")


def segments(x: np.ndarray, at: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Fingerprint, segment hash, document, first token and number of windows of every segment."""
    first = 0
    while first + n <= len(x):
        block = x[first : first + TOKENS + n - 1]
        grams = window_hash(block, k)
        place = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), n - k + 1) & PLACE
        doc = np.searchsorted(at, np.arange(first, first + len(place)), side="right") - 1 if len(at) > 2 else np.zeros(len(place), np.int64)
        ok = np.flatnonzero(np.arange(first, first + len(place)) + n <= at[doc + 1])
        if len(ok):
            p, d = place[ok], doc[ok]
            cut = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (np.diff(ok) != 1) | (d[1:] != d[:-1]))))
            size = np.diff(np.append(cut, len(ok)))
            head, whole = ok[cut], window_hash(block, n, 1)
            sid = mix(whole[head] * _MIXERS[0] + whole[head + size - 1] * _MIXERS[1] + size.astype(np.uint64))
            yield grams[p[cut]], sid, d[cut], head + first - at[d[cut]], size
        first += TOKENS


def _places(docs_columns: tuple[str, str], tokens: Callable, n: int, k: int, bits: int):
    """Batches of (_h, _s, _r, _q, _a) columns as numpy arrays."""
    mask = np.int64(-1) if bits >= 64 else np.int64((1 << bits) - 1)

    def run(batches):
        for b, first, texts in chunks(batches, "_t"):
            keys = [b.column(c).to_numpy()[first : first + len(texts)] for c in docs_columns]
            x, at = tokens(texts)
            for h, s, d, start, size in segments(x, at, n, k):
                yield h.view(np.int64), s.view(np.int64) & mask, *(key[d] for key in keys), (start << SIZE) + size

    return run


PLACED = "_h long, _s long, _r long, _q long, _a long"


def anchors(docs: DataFrame, tokens: Callable, n: int, k: int, bits: int = 64) -> DataFrame:
    """_h fingerprint, _s segment hash, _r and _q row key, _a place, of all segments of docs (_r, _q, _t).

    bits shortens the segment hash, for tests of its collisions.
    """
    checked(n, k)
    places = _places(("_r", "_q"), tokens, n, k, bits)

    def run(batches):
        for cols in places(batches):
            yield pa.record_batch([pa.array(c) for c in cols], names=["_h", "_s", "_r", "_q", "_a"])

    return arrow(docs.select("_r", "_q", "_t"), run, PLACED)


def summed(docs: DataFrame, tokens: Callable, n: int, k: int, bits: int = 64) -> DataFrame:
    """_h, _s, _n and one place (_r, _q, _a) of the segments of docs, added up within each task.

    So a passage found in very many documents sends a few rows a task.
    """
    checked(n, k)
    places = _places(("_r", "_q"), tokens, n, k, bits)

    def added(held):
        h, s, r, q, a = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1]))))
        one = order[head]
        cols = [h[head], s[head], np.diff(np.append(head, len(h))), r[one], q[one], a[one]]
        return pa.record_batch([pa.array(c) for c in cols], names=["_h", "_s", "_n", "_r", "_q", "_a"])

    def run(batches):
        held, size = [], 0
        for cols in places(batches):
            held.append(cols)
            size += len(cols[0])
            if size > HELD:
                yield added(held)
                held, size = [], 0
        if held:
            yield added(held)

    return arrow(docs.select("_r", "_q", "_t"), run, "_h long, _s long, _n long, _r long, _q long, _a long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    r, q = row_keys(id_col, text_col)
    return docs.select(r.alias("_r"), q.alias("_q"), F.col(id_col).alias("_id"), text.alias("_t"))


def one_place() -> list:
    """Any row's place: the three firsts of one aggregation come from the same row."""
    return [F.first(c).alias(c) for c in ("_r", "_q", "_a")]


def resolve(
    docs: DataFrame,
    hits: DataFrame,
    tokens: Callable,
    cut: Callable,
    solver: Callable,
    n: int,
    k: int,
    scratch: Scratch,
    crowd: int = CROWD,
    past: DataFrame | None = None,
    corpus: DataFrame | None = None,
    bits: int = 64,
) -> DataFrame:
    """_r and _q of every document with a repeated window and _x, its repeated token ranges (first * 2^32 + end).

    docs: (_r, _q, _t). hits: a written table of the fingerprints (_h) that turn up again. past: the segments
    (_h, _s, _n, _r, _q, _a) that an index holds of them, whose texts are in corpus. Every segment behind a hit
    is read back from its text, so the hashes that found it decide nothing.
    """
    every = scratch.write(anchors(docs, tokens, n, k, bits).join(hits, "_h"), "places")
    known = every.groupBy("_h", "_s").agg(*one_place())
    asked = every.select("_r", "_q", "_h", "_a", F.lit(1).alias("_w"), F.lit(False).alias("_f"))
    if past is not None:
        past = scratch.write(past, "past")
        known = known.unionByName(past.drop("_n"))
        asked = asked.union(past.select("_r", "_q", "_h", "_a", "_n", F.lit(False)))
    # Fingerprints of several segments: the content of one place of each is needed for comparison.
    several = known.groupBy("_h").agg(F.min("_s").alias("_s0"), F.max("_s").alias("_s1")).filter("_s0 != _s1").select("_h")
    asked = asked.union(known.join(several, "_h", "left_semi").select("_r", "_q", "_h", "_a", F.lit(0), F.lit(True)))
    source = docs if corpus is None or past is None else corpus
    found = scratch.write(_fetched(source, asked, cut, n), "content")
    scratch.drop(every)
    answer = _answered(found, tokens, cut, solver, n, scratch, crowd)
    # Segments of one hash and different contents: all contents of those fingerprints are fetched.
    again = answer.filter("_i < 0").select("_h").distinct()
    if not again.isEmpty():
        again = scratch.write(again, "again")
        part = found.join(again, "_h", "left_semi")
        more = _fetched(source, part.select("_r", "_q", "_h", "_a", F.lit(0).alias("_w"), F.lit(True).alias("_f")), cut, n)
        part = scratch.write(part.unionByName(more), "content")
        answer = answer.filter("_i >= 0").unionByName(_answered(part, tokens, cut, solver, n, scratch, crowd))
        answer = scratch.write(answer, "answers")
    first = F.shiftright("_a", SIZE)
    spans = answer.groupBy("_h", "_d", "_e").agg(F.collect_list(F.struct("_i", "_j")).alias("_l"))
    spans = scratch.write(spans, "spans")
    at = found.filter("_w > 0").select("_h", "_d", "_e", "_r", "_q", first.alias("_o")).join(spans, ["_h", "_d", "_e"])
    at = at.select("_r", "_q", F.explode(F.transform("_l", lambda x: (F.col("_o") + x["_i"]) * F.lit(2**32) + F.col("_o") + x["_j"])).alias("_x"))
    return at.groupBy("_r", "_q").agg(F.collect_set("_x").alias("_x"))


def _fetched(docs: DataFrame, asked: DataFrame, cut: Callable, n: int) -> DataFrame:
    """The places asked for (_r, _q, _h, _a, _w occurrences, _f content wanted) with digest (_d, _e), _z windows and _b content."""
    lists = asked.groupBy("_r", "_q").agg(F.collect_list(F.struct("_h", "_a", "_w", "_f")).alias("_l"))
    lists = lists.withColumnsRenamed({"_r": "_r2", "_q": "_q2"})
    rows = docs.select("_r", "_q", "_t").join(lists, (F.col("_r") == F.col("_r2")) & (F.col("_q") == F.col("_q2"))).select("_r", "_q", "_t", "_l")
    names = ["_h", "_d", "_e", "_r", "_q", "_a", "_w", "_b"]

    def run(batches):
        for b in batches:
            out, size = [], 0
            r, q, lists, texts = b.column("_r").to_numpy(), b.column("_q").to_numpy(), b.column("_l"), b.column("_t")
            for i in range(b.num_rows):
                items, text = lists[i].values, texts[i].as_py()
                for c in range(0, len(items), SLICE):
                    part = items.slice(c, SLICE)
                    h, a, w, f = (part.field(x).to_numpy(zero_copy_only=False) for x in ("_h", "_a", "_w", "_f"))
                    start, windows = a >> SIZE, a & ((1 << SIZE) - 1)
                    pieces = cut(text, start, start + windows + n - 1)
                    digest = np.frombuffer(b"".join([blake2b(p, digest_size=16).digest() for p in pieces]), dtype=np.int64).reshape(-1, 2)
                    content = [p if x else None for p, x in zip(pieces, f.tolist())]
                    out.append((h, digest[:, 0], digest[:, 1], np.full(len(h), r[i]), np.full(len(h), q[i]), a, w, content))
                    size += len(h) * 64 + sum(len(p) for p in content if p is not None)
                    if size > 2 << 20:
                        yield _batch(out, names)
                        out, size = [], 0
            if out:
                yield _batch(out, names)

    return arrow(rows, run, "_h long, _d long, _e long, _r long, _q long, _a long, _w long, _b binary")


def _batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    *numbers, content = zip(*out)
    cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in numbers]
    return pa.record_batch([*cols, pa.array([p for part in content for p in part], pa.binary())], names=names)


SPANS = "_h long, _d long, _e long, _i long, _j long"


def _answered(found: DataFrame, tokens: Callable, cut: Callable, solver: Callable, n: int, scratch: Scratch, crowd: int) -> DataFrame:
    """The repeated ranges (_i to _j, tokens of the segment) of every content; -1 where a content is missing."""
    size = F.max(F.col("_a").bitwiseAND(F.lit((1 << SIZE) - 1))).alias("_z")
    count = found.groupBy("_h", "_d", "_e").agg(F.sum("_w").alias("_c"), size)
    content = found.filter("_b IS NOT NULL").groupBy("_h", "_d", "_e", "_b").agg(F.count("*").alias("_k"))
    content = content.select(F.col("_h").alias("_h2"), F.col("_d").alias("_d2"), F.col("_e").alias("_e2"), "_b")
    same = (F.col("_h") == F.col("_h2")) & (F.col("_d") == F.col("_d2")) & (F.col("_e") == F.col("_e2"))
    pieces = scratch.write(count.join(content, same, "left").select("_h", "_d", "_e", "_c", "_z", "_b"), "segments")
    hot = scratch.write(pieces.groupBy("_h").count().filter(F.col("count") > crowd).select("_h"), "crowded")

    def solve(batches):
        held, size, last = [], 0, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("_h", "_d", "_e", "_c", "_z", "_b")]
            for row in zip(*cols):
                if size > TOKENS * 2 and row[0] != last:
                    yield from solved(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + 64 + len(row[5] or b""), row[0]
        if held:
            yield from solved(held)

    def solved(held):
        h = np.array([r[0] for r in held], dtype=np.int64)
        cut_ = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        alone = np.repeat(np.diff(np.append(cut_, len(h))) == 1, np.diff(np.append(cut_, len(h))))
        have = np.array([r[5] is not None for r in held])
        out = [(r[0], r[1], r[2], 0, r[4] + n - 1) for r, one in zip(held, alone.tolist()) if one and r[3] > 1]
        lacking = np.unique(h[~alone & ~have])
        open_ = np.flatnonzero(~alone & ~np.isin(h, lacking))
        out += [(x, 0, 0, -1, -1) for x in lacking.tolist()]
        cols = [np.array(c, dtype=np.int64) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 5
        if len(open_):
            which, a, b = solver([held[i][5] for i in open_], np.array([held[i][3] for i in open_]), n)
            key = np.array([held[i][:3] for i in open_], dtype=np.int64)[which]
            cols = [np.concatenate(c) for c in zip(cols, (key[:, 0], key[:, 1], key[:, 2], a.astype(np.int64), b.astype(np.int64)))]
        yield pa.record_batch([pa.array(c) for c in cols], names=["_h", "_d", "_e", "_i", "_j"])

    crowded = not hot.isEmpty()
    cold = pieces.join(hot, "_h", "left_anti") if crowded else pieces
    answer = arrow(cold.repartition("_h").sortWithinPartitions("_h"), solve, SPANS)
    if crowded:
        answer = answer.unionByName(_by_window(pieces.join(hot, "_h", "left_semi"), cut, n, scratch))
    return scratch.write(answer, "answer")


def _by_window(pieces: DataFrame, cut: Callable, n: int, scratch: Scratch) -> DataFrame:
    """Spans of crowded fingerprints: the content of each window is named by a 128-bit digest and counted by aggregation."""

    def run(batches):
        for b in batches:
            cols, out = [b.column(c).to_pylist() for c in ("_h", "_d", "_e", "_c", "_z", "_b")], []
            for h, d, e, c, z, content in zip(*cols):
                if content is None:
                    out.append([np.array([x], dtype=np.int64) for x in (h, d, e, c, -1, 0, 0)])
                else:
                    at = np.arange(z)
                    digest = np.frombuffer(b"".join([blake2b(w, digest_size=16).digest() for w in cut(content, at, at + n)]), dtype=np.int64).reshape(-1, 2)
                    out.append([*(np.full(z, x, dtype=np.int64) for x in (h, d, e, c)), at, digest[:, 0], digest[:, 1]])
                if len(out) == 256:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=WINDOW_NAMES)
                    out = []
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=WINDOW_NAMES)

    each = scratch.write(arrow(pieces, run, ", ".join(f"{c} long" for c in WINDOW_NAMES)), "windows")
    again = each.filter("_i >= 0").groupBy("_u", "_v").agg(F.sum("_c").alias("_n")).filter("_n > 1").select("_u", "_v")
    again = scratch.write(again, "repeated")
    hit = each.join(again, ["_u", "_v"]).select("_h", "_d", "_e", "_i", (F.col("_i") + n).alias("_j"))
    return hit.unionByName(each.filter("_i < 0").select("_h", F.lit(0).alias("_d"), F.lit(0).alias("_e"), "_i", F.lit(-1).alias("_j")))


WINDOW_NAMES = ["_h", "_d", "_e", "_c", "_i", "_u", "_v"]


def ranges(seg: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows (segment, first token) as segment, first and end token."""
    if not len(seg):
        return seg, start, start
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(seg) != 0) | (np.diff(start) != 1))))
    last = np.append(cut[1:], len(seg)) - 1
    return seg[cut], start[cut], start[last] + n


def merged(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, non-touching ranges of packed ones."""
    packed = np.sort(packed)
    a, b = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    cut = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return a[cut], b[np.append(cut[1:], len(a)) - 1]


def apply_ranges(docs: DataFrame, hits: DataFrame, id_col: str, id_type: str, kernel: Callable, schema: str) -> DataFrame:
    """One row per document: kernel(text, firsts, ends) gives the columns of schema."""
    hits = hits.withColumnsRenamed({"_r": "_r2", "_q": "_q2"})
    rows = docs.join(hits, (F.col("_r") == F.col("_r2")) & (F.col("_q") == F.col("_q2")), "left").select("_id", "_t", "_x")
    none = np.zeros(0, dtype=np.int64)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x, t = part.column("_x"), part.column("_t").to_pylist()
                out = [kernel(t[j] or b"", *(merged(x[j].values.to_numpy()) if x[j].is_valid else (none, none))) for j in range(len(t))]
                yield pa.record_batch([part.column("_id"), *(pa.array([o[c] for o in out], kinds[c]) for c in range(len(names)))], names=["_id", *names])

    return arrow(rows, run, f"_id {id_type}, {schema}").withColumnRenamed("_id", id_col)
