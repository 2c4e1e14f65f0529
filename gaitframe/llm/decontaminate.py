"""Benchmark decontamination: a block-max BM25 index of the items, queried by every passage."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, arrow, chunks, joined, window_hash, words_of

THETA, OVERLAP, SHINGLE = 0.5, 0.8, 5
K1, B = 1.2, 0.75
#: Items of one index; more are searched for in several passes of this many bytes each.
INDEX_BYTES = 32 << 20
SENTENCE = re.compile(rb"(?<=[.!?])[\s]+|\n+")


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (letters in lower case, ASCII punctuation separates) and each text's first word."""
    data, at = joined(texts, "alnum")
    h, start, _ = words_of(data)
    return h, np.searchsorted(start, at)


def parts(text: bytes) -> tuple[bytes, bytes]:
    """Question and answer of an item: the last sentence answers; of a lone sentence the last third of its words."""
    s = [x for x in SENTENCE.split(text) if x.strip()]
    if len(s) > 1:
        return b" ".join(s[:-1]), s[-1]
    w = text.split()
    cut = max(1, len(w) - max(1, len(w) // 3))
    return b" ".join(w[:cut]), b" ".join(w[cut:] or w[-1:])


def shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(window_hash(h, min(SHINGLE, len(h)), 5)) if len(h) else h


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first .. first+count-1 of each row, and the row of each."""
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row], row


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, same = np.unique(key, return_inverse=True)
    return u, np.bincount(same, weights=weight, minlength=len(u))


class Bm25Index:
    """BM25 weights of items as shares of the item's own score, searched by block-max WAND.

    A passage scores an item by the weights of the item's terms it holds, so 1 means all of them. Items lie
    in blocks; every term has the list of blocks it occurs in with its largest weight in each, and its largest
    weight of all. Terms found in many blocks are not followed: they add one constant per block, the most they
    can give any of its items.

    whole holds the number of all items, their mean and greatest number of words, and terms (sorted) with
    their document frequencies, where items are only a part of them.
    """

    def __init__(self, items: list[tuple[int, bytes]], theta: float = THETA, block: int = 16, whole: tuple | None = None):
        items = [(i, t) for i, t in items if t and len(hashed([t])[0])]
        self.theta, self.ids, self.block = theta, [i for i, _ in items], block
        n = len(items)
        words = [hashed([t])[0] for _, t in items]
        self.longest = max(map(len, words), default=1)
        self.qa = [tuple(shingles(hashed([p])[0]) for p in parts(t)) for _, t in items]
        self.lengths = [[min(SHINGLE, max(1, len(hashed([p])[0]))) for p in parts(t)] for _, t in items]
        self.terms = np.unique(np.concatenate(words)) if n else np.zeros(0, dtype=np.uint64)
        rows = []
        mean = np.mean([len(w) for w in words]) if n else 1.0
        if whole:
            mean, self.longest = whole[1], whole[2]
        for i, w in enumerate(words):
            t, tf = np.unique(w, return_counts=True)
            rows.append((np.searchsorted(self.terms, t), np.full(len(t), i), tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))))
        term, item, weight = (np.concatenate(x) for x in zip(*rows)) if n else (np.zeros(0, np.int64),) * 3
        df = np.bincount(term, minlength=len(self.terms))
        count, often = (whole[0], whole[4][np.searchsorted(whole[3], self.terms)]) if whole else (n, df)
        weight = weight * np.log1p((count - often + 0.5) / (often + 0.5))[term]
        weight = weight / np.bincount(item, weights=weight, minlength=n)[item]
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.first = np.concatenate(([0], np.cumsum(df)))
        self.blocks = max(1, -(-n // block))
        self.key, same = np.unique(term[order] * self.blocks + self.item // block, return_inverse=True)
        self.top = np.zeros(len(self.key))
        np.maximum.at(self.top, same, self.weight)
        spread = np.bincount(self.key // self.blocks, minlength=len(self.terms))
        dense = spread > max(4, self.blocks // 4)
        self.sparse = ~dense
        each = np.bincount(self.item, weights=np.where(dense[term[order]], self.weight, 0.0), minlength=n)
        self.constant = np.array([each[i * block : (i + 1) * block].max(initial=0.0) for i in range(self.blocks)])
        self.b_first = np.concatenate(([0], np.cumsum(spread)))
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, self.key // self.blocks, self.top)

    def _open(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Passage * blocks + block of every block that may hold an item of score theta; (q, t) passages and their sparse terms.

        All passages go through their lists in step. A passage's lists are put in the order of the block they
        stand at; the pivot is the first block at which the largest weights so far reach theta. Lists behind it
        skip to it, since no block before can reach theta. The block is opened if the block's own maxima reach
        theta too; then the lists move on. A passage without a pivot is done.
        """
        need, out = self.theta - self.constant.max(initial=0.0) - 1e-9, []
        at, stop = self.b_first[t], self.b_first[t + 1]
        while len(q):
            total = np.bincount(q, weights=self.most[t])
            q, t, at, stop = (x[total[q] >= need] for x in (q, t, at, stop))
            block = self.key[at] - t * self.blocks
            order = np.lexsort((block, q))
            q, t, at, stop, block = (x[order] for x in (q, t, at, stop, block))
            run = np.cumsum(self.most[t])
            head = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(head, len(q)))
            reach = np.flatnonzero(run - np.repeat(run[head] - self.most[t[head]], size) >= need - 1e-12)
            own, where = np.unique(q[reach], return_index=True)
            pivot = np.zeros(int(q[-1]) + 1 if len(q) else 0, dtype=np.int64)
            pivot[own] = block[reach[where]]
            mine = np.isin(q, own)
            q, t, at, stop = (x[mine] for x in (q, t, at, stop))
            at = np.maximum(at, np.searchsorted(self.key, t * self.blocks + pivot[q]))
            going = at < stop
            q, t, at, stop = (x[going] for x in (q, t, at, stop))
            here = self.key[at] - t * self.blocks == pivot[q]
            bound = np.bincount(q[here], weights=self.top[at[here]], minlength=len(pivot))
            good = own[bound[own] + self.constant[pivot[own]] >= self.theta - 1e-9]
            out.append(good * self.blocks + pivot[good])
            at = at + here
            going = at < stop
            q, t, at, stop = (x[going] for x in (q, t, at, stop))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def search(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text, item position, score, question and answer overlap) of every verified pair, best passage each."""
        if not len(self.terms) or not len(h):
            return []
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[place] == h)
        term = place[known]
        doc = np.searchsorted(at, known, side="right") - 1
        step = self.longest
        room = np.maximum(1, -(-np.diff(at) // step))  # passages begin every step words and are two steps long
        base = np.concatenate(([0], np.cumsum(room)))
        one = base[doc] + (known - at[doc]) // step
        back = (known - at[doc]) // step > 0
        q = np.concatenate((one, one[back] - 1))
        t = np.concatenate((term, term[back]))
        size = len(self.terms)
        pair = np.unique((q * size + t)[self.sparse[t]])
        alive = np.sort(self._open(pair // size, pair % size))
        for b in np.flatnonzero(self.constant >= self.theta - 1e-9):  # such blocks are always opened
            alive = np.union1d(alive, np.unique(q) * self.blocks + b)
        if not len(alive):
            return []
        mine = np.isin(q, alive // self.blocks)
        pair = np.unique(q[mine] * size + t[mine])
        pq, pt = pair // size, pair % size
        at_, row = _expand(self.first[pt], self.first[pt + 1] - self.first[pt])
        open_ = np.isin(pq[row] * self.blocks + self.item[at_] // self.block, alive)
        n = len(self.ids)
        key, score = _sums((pq[row] * n + self.item[at_])[open_], self.weight[at_][open_])
        best: dict[tuple[int, int], tuple] = {}
        for k, s in zip(key[score >= self.theta - 1e-9].tolist(), score[score >= self.theta - 1e-9].tolist()):
            p, i = divmod(k, n)
            d = int(np.searchsorted(base, p, side="right") - 1)
            a = int(at[d]) + (p - int(base[d])) * step
            over = self._overlap(h[a : min(a + 2 * step, int(at[d + 1]))], i)
            if min(over) >= OVERLAP and best.get((d, i), (0.0,))[0] < s:
                best[d, i] = (s, *over)
        return [(d, i, *v) for (d, i), v in best.items()]

    def _overlap(self, words: np.ndarray, i: int) -> tuple[float, float]:
        """Shares of the question's and the answer's word shingles that the passage holds."""
        held: dict[int, np.ndarray] = {}
        out = []
        for part, n in zip(self.qa[i], self.lengths[i]):
            if n not in held:
                held[n] = window_hash(words, n, 5)
            out.append(float(np.isin(part, held[n]).mean()) if len(part) else 1.0)
        return out[0], out[1]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    theta: float = THETA,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """id, item, score, question_overlap and answer_overlap of every document that holds a benchmark item.

    Every passage of every text is a query: passages begin every m words, m the words of the longest item,
    and are 2m words long, so each place an item fits in lies in one. Items scoring theta of their own
    BM25 score are retrieved without a limit on their number; a pair counts if at least 0.8 of the five-word
    shingles of both the item's question and its answer (its last sentence) are in the passage. Words are
    compared in lower case without ASCII punctuation.

    Items are gathered for the index at most index_bytes at a time; a larger benchmark takes several
    passes over docs, which share the term statistics and the longest item of all items. Null or empty texts
    and items without words match nothing. Of items that repeat an id each text counts; rows of docs that
    repeat an id are all answered; null ids are passed on. Of equally good passages of a text any one gives the
    overlaps. Long texts are searched in blocks. Other columns are ignored whatever their names. Empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("_i"), F.col(item_text_col).cast("binary").alias("_b")).filter("_b IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("_b"))).first()[0] or 0
    passes = max(1, -(-int(size) // index_bytes))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    out = None
    if passes > 1:
        items = items.withColumn("_p", F.pmod(F.xxhash64("_b"), F.lit(passes)).cast("int"))
        terms = Scratch(spark, "items").write(arrow(items, _terms, "_p int, _h long, _n long"), "terms")
        total = terms.filter("_h IS NULL").agg(F.count("_n"), F.avg("_n"), F.max("_n")).first()
        df = terms.filter("_h IS NOT NULL").groupBy("_h").agg(F.count("*").alias("_df"), F.collect_set("_p").alias("_ps"))
        df = Scratch(spark, "items").write(df, "df")
    for p in range(passes):
        mine = items if passes == 1 else items.filter(F.col("_p") == p)
        got = mine.orderBy("_i", "_b").collect()
        whole = None
        if passes > 1:  # no more terms than the pass's items have
            own = df.filter(F.array_contains("_ps", p)).select("_h", "_df").toArrow()
            h = own.column("_h").to_numpy().view(np.uint64)
            whole = (total[0], total[1] or 1.0, total[2] or 1, h[np.argsort(h)], own.column("_df").to_numpy()[np.argsort(h)])
        index = Bm25Index([(k, bytes(r["_b"])) for k, r in enumerate(got)], theta, whole=whole)
        sent = spark.sparkContext.broadcast((index, [got[k]["_i"] for k in index.ids]))
        part = arrow(rows, _search(sent), f"_id {kind}, _i {item_kind}, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"_id": id_col, "_i": item_col})


def _terms(batches):
    """Rows (pass, term, null) of each item's distinct terms, and (pass, null, words) of each item with words."""
    for b, first, texts in chunks(batches, "_b"):
        h, at = hashed(texts)
        for k, p in enumerate(b.column("_p").slice(first, len(texts)).to_pylist()):
            words = h[at[k] : at[k + 1]]
            if len(words):
                t = np.unique(words).view(np.int64)
                yield pa.record_batch(
                    [pa.array([p] * (len(t) + 1), pa.int32()), pa.array([*t.tolist(), None], pa.int64()), pa.array([*[None] * len(t), len(words)], pa.int64())], names=["_p", "_h", "_n"]
                )


def _search(sent):
    def run(batches):
        index, names = sent.value
        for b, first, texts in chunks(batches, "_t"):
            found = index.search(*hashed(texts))
            if found:
                ids = b.column("_id").take(pa.array([first + d for d, *_ in found]))
                yield pa.record_batch(
                    [ids, pa.array([names[i] for _, i, *_ in found]), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))],
                    names=["_id", "_i", "score", "question_overlap", "answer_overlap"],
                )

    return run


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """contaminated of all documents and all benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
