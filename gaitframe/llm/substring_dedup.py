"""Substring dedup of word windows over a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import apply_ranges, keyed, one_place, ranges, resolve, summed, word_tokens
from .shared import Scratch, shared_dir

WINDOW, ANCHOR, BATCHES, FANOUT = 35, 12, 2, 4
#: A window of words costs few rows, so fingerprints are spread sooner than those of bytes.
CROWD = 1000


class FingerprintLog:
    """An index of the word windows of all documents appended so far, kept in a folder that may be opened again.

    A run holds one row per distinct segment (neighbouring windows of one anchor, see repeats): _h fingerprint,
    _s segment hash, _n occurrences, one place (_r, _q row key, _a words). Runs are immutable, dealt into
    buckets by fingerprint and sorted in them, so a new batch's run is merge-joined with every older run
    without shuffling either. The manifest, a small table written anew after each change, names the runs; the
    newest complete one counts. More than `fanout` runs are compacted into one.

    `append` takes a batch and returns the removals it causes, in the batch and in earlier documents. Of the
    earlier documents only those are read again that hold a segment whose fingerprint the batch hits.
    Segments are told apart by both hashes, 128 bits; what is removed was compared by content.
    """

    COLUMNS = "_h BIGINT, _s BIGINT, _n BIGINT, _r BIGINT, _q BIGINT, _a BIGINT"

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT, crowd: int = CROWD, bits: int = 64):
        self.spark, self.window, self.anchor, self.fanout, self.crowd, self.bits = spark, window, anchor, fanout, crowd, bits
        self.root = root or f"{shared_dir(spark).rstrip('/')}/gaitframe-index-{uuid.uuid4().hex}"
        self.scratch = Scratch(spark, "substring")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.version = 0
        self._tables: dict[str, str] = {}
        self._open()

    def _open(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(path))
        names = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{n}/_SUCCESS"))]
        if not names:
            return
        rows = self.spark.read.parquet(f"{self.root}/manifest/{names[-1]}").orderBy("position").collect()  # a row a run
        for r in rows:
            if (r["window"], r["anchor"]) != (self.window, self.anchor):
                raise ValueError(f"the index holds windows of {r['window']} words with anchors of {r['anchor']}")
            self.buckets = r["buckets"]
        self.runs, self.version = [r["run"] for r in rows if r["run"]], int(names[-1])

    def _commit(self) -> None:
        self.version += 1
        rows = [(i, r, self.buckets, self.window, self.anchor) for i, r in enumerate(self.runs)]
        rows = self.spark.createDataFrame(rows, "position int, run string, buckets int, window int, anchor int")
        rows.coalesce(1).write.parquet(f"{self.root}/manifest/{self.version:08d}")

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table; the catalogue only knows it while the index is open."""
        if run not in self._tables:
            name = f"gaitframe_run_{uuid.uuid4().hex}"
            place = f"{self.root}/{run}"
            self.spark.sql(
                f"CREATE TABLE {name} ({self.COLUMNS}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (_h) SORTED BY (_h, _s) INTO {self.buckets} BUCKETS LOCATION '{place}'"
            )
            self._tables[run] = name
        return self.spark.table(self._tables[run])

    def _write(self, rows: DataFrame) -> str:
        """Write rows, one per segment and task or run, as a run of one row per segment."""
        run, name = f"run-{uuid.uuid4().hex}", f"gaitframe_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "_h").groupBy("_h", "_s").agg(F.sum("_n").alias("_n"), *one_place())
        out = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{run}")
        out.bucketBy(self.buckets, "_h").sortBy("_h", "_s").saveAsTable(name)
        self._tables[run] = name
        return run

    def close(self) -> None:
        """Forget the tables' names; the index stays where it is."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = {}

    def append(self, docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """Add documents (_r, _q, _t); the removals (_r, _q, _x) they cause, here and in earlier documents.

        corpus holds the texts of all documents up to and including the batch; without earlier runs it is not read.
        """
        run = self._write(summed(docs, word_tokens, self.window, self.anchor, self.bits))
        new, old = self._table(run), [self._table(r) for r in self.runs]
        hits = new.groupBy("_h").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_h")
        for t in old:
            hits = hits.union(new.select("_h").join(t.select("_h").hint("merge"), "_h", "left_semi"))
        hits = self.scratch.write(hits.distinct() if old else hits, "hits")
        past = None
        for t in old:
            part = t.join(hits, "_h", "left_semi")
            past = part if past is None else past.unionByName(part)
        if past is not None and len(old) > 1:
            past = past.groupBy("_h", "_s").agg(F.sum("_n").alias("_n"), *one_place())
        spans = resolve(docs, hits, word_tokens, cut_words, equal_windows, self.window, self.anchor, self.scratch, self.crowd, past, corpus, self.bits)
        spans = self.scratch.write(spans, "removals")
        self.runs.append(run)
        self._commit()
        if len(self.runs) > self.fanout:
            self.compact()
        return spans

    def compact(self) -> None:
        """Merge all runs into one; the old ones go once the manifest names the new one."""
        old = self.runs
        if len(old) < 2:
            return
        whole = None
        for r in old:
            whole = self._table(r) if whole is None else whole.unionByName(self._table(r))
        self.runs = [self._write(whole)]
        self._commit()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for r in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(r)}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{r}")
            path.getFileSystem(conf).delete(path, True)


def cut_words(text: bytes, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in zip(first.tolist(), end.tolist())]


def equal_windows(pieces: list[bytes], count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose words turn up again: words become numbers, equal runs double in length."""
    number: dict[bytes, int] = {}
    lists = [[number.setdefault(w, len(number)) for w in p.split()] for p in pieces]
    size = np.array([len(x) for x in lists])
    ids = np.concatenate([np.array(x, dtype=np.int64) for x in lists])
    windows = np.maximum(size - n + 1, 0)
    seg = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.repeat(np.cumsum(size) - size, windows) + start

    def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]

    s, rank = 1, ids
    while 2 * s <= n:
        rank, s = paired(rank[: len(rank) - s], rank[s:]), 2 * s
    label = rank[place] if s == n else paired(rank[place], rank[place + n - s])
    total = np.bincount(label, weights=count[seg])
    again = total[label] > 1
    return ranges(seg[again], start[again], n)


def repeated_words(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, fanout: int = FANOUT, crowd: int = CROWD, index: str | None = None, bits: int = 64
) -> DataFrame:
    """Ranges of words covered by repeated windows, for rows (_r, _q, _t); batches go through the index one by one.

    Rows are dealt to batches by their key, which stands for the order in which a corpus grows.
    """
    log, found = FingerprintLog(docs.sparkSession, index, window, anchor, fanout, crowd, bits), None
    for i in range(batches):
        part = docs.filter(F.pmod("_q", F.lit(batches)) == i) if batches > 1 else docs
        spans = log.append(part, docs)
        found = spans if found is None else found.unionByName(spans)
    log.compact()
    log.close()
    return found if batches == 1 else found.groupBy("_r", "_q").agg(F.flatten(F.collect_list("_x")).alias("_x"))


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, crowd: int = CROWD, anchor: int = ANCHOR,
    fanout: int = FANOUT, index: str | None = None, bits: int = 64,
) -> DataFrame:
    """id, n_words, n_removed, kept (binary: the kept words joined by a space) and spans of every row.

    Words are maximal runs without ASCII white space. A word goes if any window of `window` words that
    covers it has a word sequence that starts anywhere else too, in this document or another; both places
    lose it. spans lists the removed ranges as first * 2^32 + end.

    index is the folder of the fingerprint index (see FingerprintLog), a fresh one by default; the documents
    are appended to it in `batches` parts.

    Null text has no words. Texts shorter than a window lose nothing. Rows that repeat an id are separate
    documents, and identical rows lose all their windows; null ids are allowed. Long texts are searched in
    blocks. Columns beyond id and text are ignored whatever their names. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    hits = repeated_words(rows, window, anchor, batches, fanout, crowd, index, bits)

    def kept(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple:
        words = text.split()
        left, at, gone = [], 0, 0
        for a, b in zip(first.tolist(), end.tolist()):
            left += words[at:a]
            gone, at = gone + b - a, b
        left += words[at:]
        return len(words), gone, b" ".join(left), (first * 2**32 + end).tolist()

    kind = docs.schema[id_col].dataType.simpleString()
    return apply_ranges(rows, hits, id_col, kind, kept, "n_words long, n_removed long, kept binary, spans array<long>")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int) -> list[tuple]:
    """The contract itself, for tests: (id, n_words, n_removed, sha256 of the kept words)."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen: dict[tuple, int] = {}
    for _, w in texts:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, w in texts:
        gone = {p for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for p in range(a, a + window)}
        left = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


#: All windows of all documents by digest; every word that one of a digest seen again covers goes.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' '))) AS hs FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h),
d AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM k JOIN d USING (h)),
a AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
m AS (SELECT a.*, r.p IS NOT NULL AS gone FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.p = r.p)
SELECT w.doc_id, len(any_value(w.ws)) AS n_words, count(*) FILTER (WHERE m.gone) AS n_removed, sha256(coalesce(string_agg(m.x, ' ' ORDER BY m.p) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM w LEFT JOIN m ON w.doc_id = m.doc_id GROUP BY w.doc_id
"""
