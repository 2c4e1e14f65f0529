"""Language ID: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, arrow, constants, mix

GRAMS = (5, 4, 3, 2, 1)
LIMIT = 1 << 18
_CACHE: dict[str, np.ndarray] = {}


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case (one code point), and whether it is a letter."""
    if "lower" not in _CACHE:
        lower = np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, dtype=bool)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                if len(low) == 1:
                    lower[i] = ord(low)
        _CACHE.update(lower=lower, letter=letter, code=constants(1 << 16, 5), step=constants(64, 6))
    return _CACHE["lower"], _CACHE["letter"]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letters with a border before and after each word; first, end of each word; its document."""
    lower, letter = _code_tables()
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[code]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_letter, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    low = lower[code]
    x = _CACHE["code"][low & 0xFFFF] + (low >> 16).astype(np.uint64)
    x[~is_letter] = 0
    return x, start, end, np.searchsorted(at, start, side="right") - 1


def _word_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of whole words: letters times powers of an odd number, added up by word.

    The work grows with the letters, so a word of any length costs no more than as many short ones.
    """
    size = end - start
    if not len(size):
        return x[:0]
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    power = np.full(int(size.max()), 0x2545F4914F6CDD1D, dtype=np.uint64)
    power[0] = 1
    h = np.add.reduceat(x[np.repeat(start, size) + place] * np.cumprod(power)[place], at)
    return mix(h + size.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def _gram_hash(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram at each position of x (borders are 0), told apart by n."""
    h = np.zeros(len(x) - n + 1, dtype=np.uint64)
    for i in range(n):
        h += x[i : len(x) - n + 1 + i] * _CACHE["step"][i]
    return mix(h + _CACHE["step"][40 + n])


def _padded(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters, each word between borders, and where each begins (one more for the end)."""
    size = end - start + 2
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    src = np.repeat(start - 1 - at[:-1], size) + np.arange(at[-1])
    out = x[np.clip(src, 0, len(x) - 1)]
    out[at[:-1]] = 0
    out[at[1:] - 1] = 0
    return out, at


def _gram_places(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams that lie in one padded word, and the word of each."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    word = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(word)) - np.repeat(first, count) + at[:-1][word], word


class Model:
    """Hash tables of log frequencies by language: 0 for words, n for n-grams."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, {}
        for n, (key, count) in tables.items():
            order = np.argsort(key)
            total = count.sum(axis=0, keepdims=True)
            logs = np.log((count + 0.5) / (total + 0.5 * max(1, len(key)))).astype(np.float32)
            self.tables[n] = (key[order], logs[order])
        self.slots: dict[int, tuple[np.ndarray, int]] = {}

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Row of each hash in table n, or -1; an index over the leading bits shortens the search."""
        key = self.tables[n][0]
        if not len(key):
            return np.full(len(h), -1)
        at = np.searchsorted(key, h)
        at[at == len(key)] = 0
        return np.where(key[at] == h, at, -1)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log frequencies by document and language, and the number of words."""
        x, start, end, doc = _words(texts)
        total = np.zeros((len(texts), len(self.langs)))
        words = np.bincount(doc, minlength=len(texts))
        if not len(start):
            return total, words
        # Each distinct (document, word) once per chunk would need a sort; distinct words suffice.
        h, first, same = np.unique(_word_hash(x, start, end), return_index=True, return_inverse=True)
        value = np.zeros((len(h), len(self.langs)), dtype=np.float32)
        row = self.find(0, h)
        known = row >= 0
        value[known] = self.tables[0][1][row[known]]
        open_ = np.flatnonzero(~known)
        for n in GRAMS:
            if not len(open_):
                break
            letters, at = _padded(x, start[first[open_]], end[first[open_]])
            if len(letters) < n:
                continue
            place, word = _gram_places(at, n)
            row = self.find(n, _gram_hash(letters, n)[place])
            hit = row >= 0
            got = np.bincount(word[hit], minlength=len(open_))
            for k in range(len(self.langs)):
                part = np.bincount(word[hit], weights=self.tables[n][1][row[hit], k], minlength=len(open_))
                value[open_, k] = np.where(got > 0, part / np.maximum(got, 1), 0)
            open_ = open_[got == 0]
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(doc, weights=value[same, k], minlength=len(texts))
        return total, words

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text; `und` and 0 without a letter."""
        total, words = self.scores(texts)
        best = total.argmax(axis=1) if len(self.langs) else np.zeros(len(texts), dtype=int)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        share = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        return [self.langs[b] if w else "und" for b, w in zip(best, words)], np.where(words > 0, share, 0.0)


def _text_chunks(batches, limit: int = LIMIT, column: str = "_text"):
    for b in batches:
        texts = [t or "" for t in b.column(column).to_pylist()]
        first, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield b, first, texts[first:i]
                first, size = i, 0
            size += len(t)
        if texts:
            yield b, first, texts[first:]


def _word_counts(batches):
    """Rows (lang, hash, word, count) of one task, added up as far as memory is bounded; word is one spelling."""
    held: dict[str, dict[int, list]] = {}
    rows = 0

    def flush():
        for lang, words in held.items():
            word, count = zip(*words.values())
            key = np.fromiter(words, dtype=np.int64, count=len(words))
            yield pa.record_batch([pa.array([lang] * len(key)), pa.array(key), pa.array(word, pa.string()), pa.array(count, pa.int64())], names=["_lang", "_h", "_w", "_c"])

    for b, first, texts in _text_chunks(batches):
        langs = b.column("_lang").to_pylist()[first : first + len(texts)]
        x, start, end, doc = _words(texts)
        names, whole = np.array(langs), "\n".join(texts)
        for lang in sorted(set(langs)):
            mine = np.flatnonzero(names[doc] == lang)
            if not len(mine):
                continue
            h, at, count = np.unique(_word_hash(x, start[mine], end[mine]), return_index=True, return_counts=True)
            words = held.setdefault(lang, {})
            for k, s, e, c in zip(h.view(np.int64).tolist(), start[mine][at].tolist(), end[mine][at].tolist(), count.tolist()):
                if k in words:
                    words[k][1] += c
                else:
                    words[k] = [whole[s:e], c]
                    rows += 1
        if rows > 500_000:
            yield from flush()
            held, rows = {}, 0
    yield from flush()


def _gram_counts(batches):
    """Rows (lang, n, hash, count) of distinct words: 0 for the word, n for its n-grams, each as often as the word occurs."""
    for b, first, words in _text_chunks(batches, column="_w"):
        langs = np.array(b.column("_lang").to_pylist()[first : first + len(words)])
        times = b.column("_c").to_numpy()[first : first + len(words)]
        x, start, end, row = _words(words)
        h = _word_hash(x, start, end)
        for lang in sorted(set(langs.tolist())):
            mine = np.flatnonzero(langs[row] == lang)
            letters, bounds = _padded(x, start[mine], end[mine])
            often = times[row[mine]]
            out = [(0, h[mine], often)]
            for n in GRAMS:
                if len(letters) >= n:
                    place, word = _gram_places(bounds, n)
                    key, same = np.unique(_gram_hash(letters, n)[place], return_inverse=True)
                    out.append((n, key, np.bincount(same, weights=often[word], minlength=len(key)).astype(np.int64)))
            for n, key, count in out:
                yield pa.record_batch(
                    [pa.array([lang] * len(key)), pa.array(np.full(len(key), n, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(count)],
                    names=["_lang", "_n", "_h", "_c"],
                )


def fit(labelled: DataFrame, per_lang: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most about per_lang rows of each language, those whose hashed id is smallest.

    labelled: rows that may be learned from. Rows with null text or lang teach nothing. Words and n-grams
    seen once in the sample are left out. Words are added up over the whole sample before their n-grams are
    taken, and an n-gram counts as often as its words occur, so files and partitions do not matter. The bound on rows bounds the model, which goes to every task.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {n: (np.zeros(0, np.uint64), np.zeros((0, 0))) for n in (0, *GRAMS)})
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_lang / sizes[lang]))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(place < share).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    words = arrow(sample, _word_counts, "_lang string, _h long, _w string, _c long").groupBy("_lang", "_h").agg(F.min("_w").alias("_w"), F.sum("_c").alias("_c"))
    counts = arrow(words, _gram_counts, "_lang string, _n int, _h long, _c long").groupBy("_lang", "_n", "_h").agg(F.sum("_c").alias("_c"))
    # A row per word or n-gram of the bounded sample; those seen once are dropped before they travel.
    wide = counts.groupBy("_n", "_h").agg(
        *[F.sum(F.when(F.col("_lang") == lang, F.col("_c")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)], F.sum("_c").alias("_all")
    )
    got = wide.filter("_all > 1").toArrow()
    n, h = got.column("_n").to_numpy(), got.column("_h").to_numpy().view(np.uint64)
    c = np.column_stack([got.column(f"c{i}").to_numpy() for i in range(len(langs))]).astype(np.float64) if len(n) else np.zeros((0, len(langs)))
    return Model(langs, {k: (h[n == k], c[n == k]) for k in (0, *GRAMS)})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (probability of the language, 0 to 1) of every row of docs.

    A text that is null, empty or without a letter is `und` with score 0; so is every text when the model
    has seen no language. Of equally likely languages the first by name wins. Each row stands alone:
    rows that repeat an id are all answered, a null id is passed on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of fit

    def run(batches):
        for b, first, texts in _text_chunks(batches):
            lang, score = sent.value.predict(texts)
            yield pa.record_batch([b.column("_id").slice(first, len(texts)), pa.array(lang, pa.string()), pa.array(score)], names=["_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return arrow(rows, run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose language is `und` or less likely than `least`; no shuffle.

    Rows without text or without a letter go; each row stands alone, so repeated rows and null ids stay or go
    by their text, whatever its length. Of equally likely languages the first by name is asked.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for b, first, texts in _text_chunks(batches, column=text_col):
            lang, score = sent.value.predict(texts)
            keep = pa.array([g != "und" and s >= least for g, s in zip(lang, score)], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.slice(first, len(texts)).columns, names=names).filter(keep)

    return arrow(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents; the model learns from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
