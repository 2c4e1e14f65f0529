"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import U64, Scratch, arrow, chunks, joined, mix, row_keys, unpersist, words_of

#: Bound of the labelled rows that are gathered to fit the model. Unlabelled rows have none: each round scores all.
MAX_LABELLED = 6000
#: Rounds of teaching; pseudo-labels a view gives per class and round at most, the surest ones; least probability of one.
ROUNDS, TEACH, SURE = 4, 300, 0.95
#: Slots of hashed words and of hashed pairs of neighbouring words, and of hashed sources and languages.
WORD_SLOTS, META_SLOTS = 256, 64
DENSE = 20


def text_view(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Character and word statistics of whole texts, one row each (DENSE columns), and word_shares."""
    data, at = joined(texts, None)
    n = len(texts)
    length = np.maximum(np.diff(at) - 1, 0)
    doc = np.repeat(np.arange(n), np.diff(at))
    share = lambda mask: np.bincount(doc, weights=mask, minlength=n) / np.maximum(length, 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, high = (data >= 48) & (data <= 57), data >= 128
    space, line = (data == 32) | ((data >= 9) & (data <= 13)), data == 10
    stop = (data == 46) | (data == 33) | (data == 63)
    comma = data == 44
    other = ~(upper | lower | digit | high | space | stop | comma)
    same = np.concatenate(([False], data[1:] == data[:-1]))
    folded, _ = joined(texts, "fold")
    h, start, end = words_of(folded)
    first = np.searchsorted(start, at)
    word_doc = np.repeat(np.arange(n), np.diff(first))
    words = np.maximum(np.diff(first), 1)
    key = mix(h ^ mix(word_doc.astype(np.uint64) + U64(1)))
    u, where, count = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(word_doc[where], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, word_doc[where], count)
    again = np.concatenate(([0.0], (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1]))) if len(h) else np.zeros(0)
    size = (end - start).astype(float)
    mean = np.bincount(word_doc, weights=size, minlength=n) / words
    var = np.bincount(word_doc, weights=size**2, minlength=n) / words - mean**2
    lines = np.array([_line_shares(t or b"") for t in texts]).reshape(n, 2)
    cols = [
        np.log1p(length), np.log1p(np.diff(first)), share(upper), share(lower), share(digit), share(high), share(space), share(line), share(stop),
        share(comma), share(other), share(same), distinct / words, top / words, np.bincount(word_doc, weights=again, minlength=n) / words,
        mean, np.sqrt(np.maximum(var, 0)), share(stop) * length / words, lines[:, 0], lines[:, 1],
    ]
    return np.column_stack(cols), word_shares(h, word_doc, n)


def word_shares(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Square roots, in 255 steps, of the shares of hashed words and of hashed pairs of words, one row a text."""
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    out = []
    for key, own in ((h, doc), (mix(h[pair] * U64(3) + h[pair + 1]), doc[pair])):
        slot = (key % U64(WORD_SLOTS)).astype(np.int64)
        count = np.bincount(own * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
        out.append(np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1)))
    return np.rint(np.hstack(out) * 255).astype(np.uint8)


def _line_shares(t: bytes) -> tuple[float, float]:
    """Share of repeated lines, and of lines that end like a sentence."""
    lines = [x.strip() for x in t.split(b"\n") if x.strip()]
    if not lines:
        return 0.0, 0.0
    return 1 - len(set(lines)) / len(lines), sum(x[-1:] in b".!?" for x in lines) / len(lines)


def _slots(values: pa.Array, salt: int) -> np.ndarray:
    """Slot of each value, hashed whole; null has one of its own. Distinct values are hashed once."""
    coded = values.dictionary_encode()
    own = [int.from_bytes(blake2b(str(v).encode(), digest_size=8, salt=bytes([salt])).digest(), "little") % (META_SLOTS - 1) + 1 for v in coded.dictionary.to_pylist()]
    at = coded.indices.fill_null(len(own)).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array([*own, 0])[at]


def meta_view(source: np.ndarray, lang: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Source, language (as slots) and length as recorded beside the text; unknown lengths are 0."""
    n = len(source)
    out = np.zeros((n, 2 * META_SLOTS + 3))
    out[np.arange(n), source] = 1
    out[np.arange(n), META_SLOTS + lang] = 1
    c = np.where(np.isfinite(n_chars) & (n_chars > 0), n_chars, 0.0)
    out[:, -3:] = np.column_stack([np.log1p(c), np.log1p(c) ** 2 / 10, c == 0])
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on scaled columns, fitted by Newton steps."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + ridge * self.w
            hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(hess, grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class CoTrained:
    """Two views that taught each other; calibrated margins add up to one score.

    report holds the held-out AUC of each view (0 text, 1 metadata) before and after the teaching, and the
    pseudo-labels given by round, view and class.
    """

    def __init__(self, prior: float):
        self.prior, self.views = prior, [None, None]
        self.scale = [(1.0, 0.0), (1.0, 0.0)]
        self.report: dict = {"auc_before": None, "auc_after": None, "taught": []}

    def margins(self, xs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        return [np.full(len(x), self.prior) if v is None else a * v.margin(x) + b for v, x, (a, b) in zip(self.views, xs, self.scale)]

    def score(self, xs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by text, by metadata, and of both (the views' evidence beyond the prior adds up)."""
        a, b = self.margins(xs)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def auc(score: np.ndarray, y: np.ndarray) -> float | None:
    """Share of (good, bad) pairs in the right order, ties half."""
    good = int(y.sum())
    if good in (0, len(y)):
        return None
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    return float((rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good)))


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, rounds: int = ROUNDS) -> CoTrained:
    """Each round either view labels the unlabelled rows it is surest of for the other.

    surest(views) gives, from all unlabelled rows not taught before, lists of (view, label, rows of both views).
    A fifth of the labelled rows is kept out of training and calibrates the margins. With labels of one
    class or none the prior is all there is.
    """
    good = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-6, 1 - 1e-6))
    model = CoTrained(float(np.log(good / (1 - good))))
    if len(y) < 10 or y.min() == y.max():
        return model
    held = np.arange(len(y)) % 5 == 4
    own = [[x[~held], y[~held], np.ones((~held).sum())] for x in xs]
    for r in range(rounds + 1):
        model.views = [Logistic().fit(*o) for o in own]
        model.report["auc_after"] = [auc(v.margin(x[held]), y[held]) for v, x in zip(model.views, xs)]
        model.report["auc_before"] = model.report["auc_before"] or model.report["auc_after"]
        if r == rounds:
            break
        given = [(v, label, rows) for v, label, rows in surest(model.views) if len(rows[0])]
        model.report["taught"].append({f"{'text' if v == 0 else 'meta'}:{label:.0f}": len(rows[0]) for v, label, rows in given})
        for v, label, rows in given:
            x, n = rows[1 - v], len(rows[0])
            own[1 - v] = [np.concatenate(c) for c in zip(own[1 - v], (x, np.full(n, label), np.full(n, 0.5)))]
        if not given:
            break
    for v in (0, 1):  # Platt scaling
        m = model.views[v].margin(xs[v][held])
        z = np.column_stack([m, np.ones(len(m))])
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = _sigmoid(np.clip(z @ w, -30, 30))
            w -= np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - y[held]) + 1e-3 * (w - np.array([1.0, 0.0])))
        model.scale[v] = (max(0.0, float(w[0])), float(w[1]))
    return model


FEATURES = "_k long, _dense binary, _words binary, _source short, _lang short, _n double"


def _features(batches):
    for b, first, texts in chunks(batches, "_t"):
        part = b.slice(first, len(texts))
        dense, words = text_view(texts)
        dense = dense.astype(np.float32)
        slots = [pa.array(_slots(part.column(c), s).astype(np.int16)) for s, c in ((1, "_source"), (2, "_lang"))]
        cols = [part.column("_id"), part.column("_k"), pa.array([x.tobytes() for x in dense], pa.binary()), pa.array([x.tobytes() for x in words], pa.binary()), *slots, part.column("_n")]
        yield pa.record_batch(cols, names=["_id", "_k", "_dense", "_words", "_source", "_lang", "_n"])


def views_of(b) -> tuple[np.ndarray, np.ndarray]:
    """Both views' matrices of a batch of feature rows."""
    raw = [b"".join(b.column(c).to_pylist()) for c in ("_dense", "_words")]
    dense = np.frombuffer(raw[0], dtype=np.float32).reshape(b.num_rows, DENSE)
    words = np.frombuffer(raw[1], dtype=np.uint8).reshape(b.num_rows, 2 * WORD_SLOTS)
    n = b.column("_n").to_numpy(zero_copy_only=False) if isinstance(b.column("_n"), pa.Array) else b.column("_n").to_numpy()
    source, lang = (b.column(c).to_numpy().astype(np.int64) for c in ("_source", "_lang"))
    return np.hstack([dense, words / 255.0]).astype(np.float64), meta_view(source, lang, n.astype(np.float64))


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"),
        row_keys(id_col, text_col)[0].alias("_k"),
        F.col(text_col).cast("binary").alias("_t"),
        F.col(source_col).cast("string").alias("_source"),
        F.col(lang_col).cast("string").alias("_lang"),
        F.col(chars_col).cast("double").alias("_n"),
    )


def _sure(sent, teach: int, least: float):
    """Of a task's rows the surest `teach` of each view and class: _v, _y, _m margin and _k key."""

    def run(batches):
        views, gone = sent.value
        none = (np.zeros(0), np.zeros(0, dtype=np.int64))
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        edge = float(np.log(least / (1 - least)))
        for b in batches:
            if not b.num_rows:
                continue
            xs, keys = views_of(b), b.column("_k").to_numpy()
            fresh = ~np.isin(keys, gone)
            for v in (0, 1):
                margin = views[v].margin(xs[v])
                for label, sure in ((1, margin), (0, -margin)):
                    rows = np.flatnonzero(fresh & (sure >= edge))
                    held = best.get((v, label), none)
                    m, k = np.concatenate((held[0], sure[rows])), np.concatenate((held[1], keys[rows]))
                    order = np.lexsort((k, -m))[:teach]
                    best[v, label] = m[order], k[order]
        for (v, label), (m, k) in best.items():
            n = len(m)
            yield pa.record_batch([pa.array([v] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array(m), pa.array(k)], names=["_v", "_y", "_m", "_k"])

    return run


def fit(feats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, teach: int = TEACH, sure: float = SURE) -> CoTrained:
    """Fit on at most about max_labelled labelled rows, those of smallest hashed id, and on all others.

    feats: written feature rows with _has, whether the id has a label; labels: (_id, _y), one row an id. In
    each round all rows without a label are scored, and the surest `teach` of each view and class are gathered.
    """
    spark = feats.sparkSession
    n = labels.count()
    place = F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    sample = labels.filter(place < max_labelled / max(n, 1)).withColumnRenamed("_id", "_i")  # bounded by max_labelled
    got = feats.filter("_has").join(F.broadcast(sample), F.col("_id") == F.col("_i")).drop("_id", "_i", "_has").toArrow()
    got = got.sort_by([("_k", "ascending")])  # rows come in any order
    xs = views_of(got) if len(got) else (np.zeros((0, DENSE + 2 * WORD_SLOTS)), np.zeros((0, 2 * META_SLOTS + 3)))
    free, gone = feats.filter("NOT _has").drop("_id", "_has"), np.zeros(0, dtype=np.int64)

    def surest(views):
        nonlocal gone
        sent = spark.sparkContext.broadcast((views, gone))
        best = arrow(free, _sure(sent, teach, sure), "_v int, _y int, _m double, _k long")
        order = F.row_number().over(Window.partitionBy("_v", "_y").orderBy(F.desc("_m"), "_k"))
        won = best.distinct().withColumn("_o", order).filter(F.col("_o") <= teach).select("_v", "_y", "_k").collect()  # 4 * teach rows
        unpersist(sent)
        keys = spark.createDataFrame([(k,) for k in sorted({r["_k"] for r in won})], "_w long")
        rows = free.join(F.broadcast(keys), F.col("_k") == F.col("_w")).drop("_w").toArrow().sort_by([("_k", "ascending")])
        if not len(rows):
            return []
        key, first = np.unique(rows.column("_k").to_numpy(), return_index=True)
        every = [x[first] for x in views_of(rows)]
        gone = np.union1d(gone, key)
        out = []
        for v, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
            own = np.searchsorted(key, np.array(sorted(r["_k"] for r in won if (r["_v"], r["_y"]) == (v, label)), dtype=np.int64))
            out.append((v, float(label), tuple(x[own] for x in every)))
        return out

    return co_train(xs, got.column("_y").to_numpy().astype(float), surest, rounds)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    chars_col: str = "n_chars", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, report: dict | None = None,
) -> DataFrame:
    """id, p_text, p_meta and score (probability of good quality, 0 to 1) of every row of docs.

    The text view holds statistics of characters, words and lines and hashed words and pairs of words of whole
    texts; the metadata view source, language and recorded length. Features are written once; every round of
    co-training scores all unlabelled rows from them. report, if given, receives the model's report.

    Null or empty text and null metadata are values like any other; a long text is one row. Null labels teach
    nothing; a document with several labels has the largest. Equally sure rows are taken in the order of their
    keys. Without labels, or with labels of one class, every score is the prior. Rows that repeat an id are all
    scored; null ids are passed on and have no label. Other columns are ignored whatever their names. An empty
    table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    rows = _columns(docs, id_col, text_col, source_col, lang_col, chars_col)
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    known = scratch.write(known.groupBy("_id").agg(F.max("_y").cast("double").alias("_y")), "labels")
    has = known.select(F.col("_id").alias("_i"), F.lit(True).alias("_l"))
    feats = arrow(rows, _features, f"_id {kind}, {FEATURES}").join(has, F.col("_id") == F.col("_i"), "left")
    feats = scratch.write(feats.withColumn("_has", F.col("_l").isNotNull()).drop("_i", "_l"), "features")
    model = fit(feats, known, max_labelled, rounds)
    if report is not None:
        report.update(model.report)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                yield pa.record_batch([part.column("_id"), *(pa.array(x) for x in sent.value.score(views_of(part)))], names=["_id", "p_text", "p_meta", "score"])

    return arrow(feats.drop("_has", "_k"), run, f"_id {kind}, p_text double, p_meta double, score double").withColumnRenamed("_id", id_col)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """classify of all documents by the labels of quality."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
