"""SentencePiece encoding and decoding over a relational lattice of word pieces."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, arrow, chunks, unpersist

#: The model where neither an argument nor the setting spark.gaitframe.sentencepiece.model names one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: U+2581 stands for a space inside pieces.
GAP = "▁"
#: Words encoded once by the lattice and sent to every task; the rest are folded where they stand.
FREQUENT = 1 << 16
#: Bytes of text whose words are looked up at once.
SLICE = 1 << 20
#: Piece ids decoded at once.
IDS = 1 << 20


@dataclass
class PieceTable:
    """Pieces of a model: normal pieces by text, byte pieces, the unknown piece; kind is bpe or unigram."""

    ids: dict[str, int]
    scores: dict[str, float]
    texts: list[str]
    bytes_: list[int]
    unknown: int
    kind: str = "bpe"
    control: set[int] = field(default_factory=set)

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @property
    def pattern(self) -> str:
        """Stretches no piece reaches beyond: gaps open a word, and a newline stands alone unless a piece holds one."""
        whole = any(GAP in p[1:].lstrip(GAP) for p in self.ids)
        if whole:
            return r"(?s).+"
        return rf"{GAP}+[^{GAP}]*|[^{GAP}]+" if any("\n" in p and len(p) > 1 for p in self.ids) else rf"\n|{GAP}+[^{GAP}\n]*|[^{GAP}\n]+"


def load(path: str | None = None, kind: str = "bpe") -> PieceTable:
    import sentencepiece

    session = SparkSession.getActiveSession()
    path = path or (session.conf.get("spark.gaitframe.sentencepiece.model", MODEL) if session else MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    special = {i for i in range(len(texts)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    bytes_ = [-1] * 256
    normal = {}
    for i, t in enumerate(texts):
        if sp.is_byte(i):
            bytes_[int(t[3:5], 16)] = i
        elif i not in special:
            normal[t] = i
    return PieceTable(normal, {t: sp.get_score(i) for t, i in normal.items()}, texts, bytes_ if min(bytes_) >= 0 else [], sp.unk_id(), kind, special)


def marked(text: Column) -> Column:
    """Spaces as gaps, and one gap before a text that has any character."""
    return F.when(F.length(text) > 0, F.concat(F.lit(GAP), F.replace(text, F.lit(" "), F.lit(GAP)))).otherwise(F.lit(""))


# --- the relational lattice ------------------------------------------------------------------------


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """_w with _e, the edges (i, j, id, score) of all its substrings that are pieces, and _n characters."""
    n = F.char_length("_w")
    starts = words.select("_w", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    spans = starts.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("_n"), F.col("i") + longest))))
    spans = spans.withColumn("_p", F.expr("substring(_w, i + 1, j - i)"))
    edges = spans.join(F.broadcast(pieces), "_p")  # as many rows as the model has pieces
    lists = edges.groupBy("_w").agg(F.collect_list(F.struct("i", "j", "id", "score")).alias("_e"))
    return words.join(lists, "_w", "left").select("_w", n.alias("_n"), F.coalesce("_e", F.expr("cast(array() as array<struct<i:int,j:int,id:int,score:double>>)")).alias("_e"))


def merge_fold(words: DataFrame) -> DataFrame:
    """_b, the bounds that remain when neighbours are joined, best edge first and leftmost of equals (BPE)."""
    # An edge joins two neighbours when its ends are bounds with exactly one bound between them.
    step = """
      aggregate(sequence(1, _n), sequence(0, _n), (b, s) -> aggregate(
        array(array_max(transform(
          filter(_e, e -> array_contains(b, e.i) AND get(b, int(array_position(b, e.i)) + 1) = e.j),
          e -> struct(e.score AS sc, -e.i AS at)))),
        b, (y, best) -> if(best IS NULL, y, filter(y, (v, k) -> k != array_position(y, -best.at)))))
    """
    return words.withColumn("_b", F.expr(step))


def viterbi_fold(words: DataFrame, unknown_score: float) -> DataFrame:
    """_b, the bounds of the best-scoring path (unigram); a character without an edge costs unknown_score."""
    best = f"""
      aggregate(sequence(1, _n), array(struct(0D AS sc, 0 AS at)), (s, p) -> concat(s, array(array_max(concat(
        transform(filter(_e, e -> e.j = p), e -> struct(s[e.i].sc + e.score AS sc, e.i AS at)),
        if(exists(_e, e -> e.j = p AND e.i = p - 1), cast(array() as array<struct<sc:double,at:int>>), array(struct(s[p - 1].sc + {unknown_score}D AS sc, p - 1 AS at))))))))
    """
    back = "aggregate(sequence(1, _n), array(_n), (b, s) -> if(b[0] = 0, b, concat(array(_s[b[0]].at), b)))"
    return words.withColumn("_s", F.expr(best)).withColumn("_b", F.expr(back)).drop("_s")


def piece_ids(words: DataFrame, table: PieceTable) -> DataFrame:
    """_w with ids: the edge between neighbouring bounds, or the bytes of a character that is no piece."""
    lit = "array(" + ",".join(map(str, table.bytes_)) + ")" if table.bytes_ else None
    char = "substring(_w, _b[t - 1] + 1, _b[t] - _b[t - 1])"
    other = f"transform(sequence(1, octet_length({char})), k -> {lit}[cast(conv(substring(hex({char}), 2 * k - 1, 2), 16, 10) as int)])" if lit else f"array({table.unknown})"
    found = "filter(_e, e -> e.i = _b[t - 1] AND e.j = _b[t])"
    ids = f"flatten(transform(sequence(1, size(_b) - 1), t -> if(size({found}) > 0, array({found}[0].id), {other})))"
    return words.select("_w", F.expr(ids).alias("ids"))


def encode_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """_w and ids of distinct words (_w), each non-empty."""
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, i, float(table.scores[p])) for p, i in table.ids.items()], "_p string, id int, score double")
    words = words.repartition(2 * spark.sparkContext.defaultParallelism, "_w")  # few bytes, much work
    graph = lattice(words, pieces, table.longest)
    low = min(table.scores.values(), default=0.0) - 10.0
    return piece_ids(merge_fold(graph) if table.kind == "bpe" else viterbi_fold(graph, low), table)


# --- words outside the dictionary ------------------------------------------------------------------


def fold_word(word: str, table: PieceTable) -> list[int]:
    """The same folds for one word of any length."""
    if table.kind != "bpe":
        return _best_path(word, table)
    rank, n = table.scores, len(word)
    left, right, end, dead = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1)), bytearray(n)
    queue: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n:
            score = rank.get(word[i : end[j]])
            if score is not None:
                heapq.heappush(queue, (-score, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = right[i] if not dead[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], dead[j], right[i] = stop, 1, right[j]
        if right[j] < n:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    out: list[int] = []
    i = 0
    while i < n:
        _put(word[i : end[i]], table, out)
        i = right[i]
    return out


def _put(piece: str, table: PieceTable, out: list[int]) -> None:
    k = table.ids.get(piece)
    if k is not None:
        out.append(k)
    elif table.bytes_:
        out.extend(table.bytes_[b] for b in piece.encode())
    else:
        out.append(table.unknown)


def _best_path(word: str, table: PieceTable) -> list[int]:
    low = min(table.scores.values(), default=0.0) - 10.0
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + table.scores[word[i:j]], i) for i in range(max(0, j - table.longest), j) if word[i:j] in table.ids]
        if word[j - 1 : j] not in table.ids:
            options.append((best[j - 1][0] + low, j - 1))
        best.append(max(options))
    cuts, at = [], len(word)
    while at:
        cuts.append((best[at][1], at))
        at = best[at][1]
    out: list[int] = []
    for a, b in reversed(cuts):
        _put(word[a:b], table, out)
    return out


class Merges:
    """The same joining for many short words at once: symbols are numbers, words are rows of a matrix."""

    def __init__(self, table: PieceTable):
        self.table, self.texts = table, list(table.ids)
        self.number = {t: k for k, t in enumerate(self.texts)}
        for p in table.ids:  # characters that occur in pieces only
            for c in p:
                self._add(c)
        size = len(self.texts)
        pairs = {self.number[p[:i]] * size + self.number[p[i:]]: self.number[p] for p in table.ids for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number}
        self.size = size
        self.keys = np.array([*sorted(pairs), np.iinfo(np.int64).max])
        self.makes = np.array([*(pairs[k] for k in sorted(pairs)), -1])
        self.score = np.array([table.scores.get(t, -np.inf) for t in self.texts] + [-np.inf])
        self.ids = pa.array([], pa.list_(pa.int32()))
        self._outputs()

    def _add(self, char: str) -> None:
        if char not in self.number:
            self.number[char] = len(self.texts)
            self.texts.append(char)

    def _outputs(self) -> None:
        ids: list[list[int]] = []
        for t in self.texts[len(self.ids) :]:
            _put(t, self.table, out := [])
            ids.append(out)
        self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.list_(pa.int32()))])

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol two neighbours make, -1 for none."""
        inside = (a >= 0) & (b >= 0) & (a < self.size) & (b < self.size)
        key = np.where(inside, a * self.size + b, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.makes[at], -1)

    def fold(self, words: list[str]) -> pa.ListArray:
        """ids of each word."""
        if not words:
            return pa.array([], pa.list_(pa.int32()))
        known = len(self.texts)
        for c in set("".join(words)):
            self._add(c)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars, back = np.unique(codes, return_inverse=True)
        symbols = np.array([self.number[chr(c)] for c in chars.tolist()])[back]
        if len(self.texts) > known:
            self._outputs()
        first = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []  # word, its symbols with -1 at the end
        for k in range(0, len(order), 4096):
            rows = order[k : k + 4096]
            place = np.arange(lengths[rows[-1]])
            grid = np.where(place < lengths[rows][:, None], symbols[np.minimum(first[rows][:, None] + place, len(symbols) - 1)], -1)
            found += self._blocks(rows, grid)
        number = np.concatenate([np.repeat(w, (g >= 0).sum(1)) for w, g in found])
        flat = np.concatenate([g[g >= 0] for _, g in found])
        flat = flat[np.argsort(number, kind="stable")]
        count = np.bincount(number, minlength=len(words))
        lists = self.ids.take(pa.array(flat))
        ends = lists.offsets.to_numpy()[np.concatenate(([0], np.cumsum(count)))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values)

    def _blocks(self, rows: np.ndarray, grid: np.ndarray):
        pair = self.joined(grid[:, :-1], grid[:, 1:])
        while pair.shape[1]:
            score = self.score[pair]
            best = score.argmax(1)
            line = np.arange(len(rows))
            more = score[line, best] > -np.inf
            if not more.all():
                yield rows[~more], grid[~more]
                rows, grid, pair, best = rows[more], grid[more], pair[more], best[more]
                line = line[: len(rows)]
            if not len(rows):
                return
            made = pair[line, best]
            wide = np.arange(grid.shape[1] - 1)
            grid = np.take_along_axis(grid, wide + (wide > best[:, None]), 1)
            grid[line, best] = made
            wide = wide[:-1]
            pair = np.take_along_axis(pair, wide + (wide >= best[:, None]), 1)
            for shift in (0, -1):  # the two pairs the new symbol is in
                at = line[(best + shift >= 0) & (best + shift < pair.shape[1])]
                col = best[at] + shift
                pair[at, col] = self.joined(grid[at, col], grid[at, col + 1])
        yield rows, grid


class Ragged:
    """Lists of ids that grow by appending; arrays double, so what is there is not copied each time."""

    def __init__(self, lists: pa.ListArray):
        self.values, self.start, self.size = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.used = self.count = 0
        self.add(lists)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        if n <= len(x):
            return x
        out = np.zeros(max(n, 2 * len(x)), x.dtype)
        out[: len(x)] = x
        return out

    def add(self, lists: pa.ListArray) -> None:
        ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
        n, m = len(lists), len(flat)
        self.values = self._room(self.values, self.used + m)
        self.start, self.size = self._room(self.start, self.count + n), self._room(self.size, self.count + n)
        self.values[self.used : self.used + m] = flat
        self.start[self.count : self.count + n] = ends[:-1] - ends[0] + self.used
        self.size[self.count : self.count + n] = np.diff(ends)
        self.used, self.count = self.used + m, self.count + n

    def cut(self, count: int, used: int) -> None:
        self.count, self.used = count, used

    def take(self, at: np.ndarray) -> pa.ListArray:
        size = self.size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.start[at], size)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self.values[place]))


class Encoder:
    """ids of any words (bytes, gaps as spaces): the given ones are known, the others are folded in place and kept for a while."""

    HELD = 100_000

    def __init__(self, table: PieceTable, known: list[bytes], ids: pa.ListArray):
        self.table, self.merges = table, Merges(table) if table.kind == "bpe" else None
        self.known, self.ids = {w: k for k, w in enumerate(known)}, Ragged(ids)
        self.base, self.held = (self.ids.count, self.ids.used), dict(self.known)

    def __call__(self, words: list[bytes]) -> pa.ListArray:
        if len(self.held) > len(self.known) + self.HELD:
            self.held = dict(self.known)
            self.ids.cut(*self.base)
        new = [w for w in words if w not in self.held]
        texts = [w.decode("utf-8", "replace").replace(" ", GAP) for w in new]
        short = [k for k, t in enumerate(texts) if len(t) <= 64 and self.merges]
        rest = [k for k, t in enumerate(texts) if not (len(t) <= 64 and self.merges)]
        for place, k in enumerate([*rest, *short], self.ids.count):
            self.held[new[k]] = place
        self.ids.add(pa.array([fold_word(texts[k], self.table) for k in rest], pa.list_(pa.int32())))
        if self.merges:
            self.ids.add(plain(self.merges.fold([texts[k] for k in short])))
        out = self.ids.take(np.array([self.held[w] for w in words], dtype=np.int64))
        for k in rest:  # words without bound on their length are not kept
            if len(new[k]) > 256:
                del self.held[new[k]]
        return out


def plain(lists: pa.ListArray) -> pa.ListArray:
    """Lists of 32-bit numbers, the items' field without name or nullability of its own."""
    return lists.cast(pa.list_(pa.int32()))


def segments(texts: list[bytes | None], table: PieceTable) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, gaps as spaces, dictionary-encoded, and how many words each text has."""
    parts = [b" " + t.replace(GAP.encode(), b" ") if t else b"" for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    if not sizes.any():
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(parts), dtype=np.int64)
    if not table.pattern.startswith(r"\n|"):  # models whose pieces hold newlines or inner gaps
        find = re.compile(table.pattern).findall
        lists = [[w.replace(GAP, " ").encode() for w in find(p.decode("utf-8", "replace").replace(" ", GAP))] for p in parts]
        return pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode(), np.fromiter(map(len, lists), np.int64, len(lists))
    data = b"".join(parts)
    codes = np.frombuffer(data, dtype=np.uint8)
    line, gap = codes == 10, codes == 32
    start = line | gap
    start[1:] &= line[1:] | ~gap[:-1]
    start[1:] |= line[:-1]
    ends = np.cumsum(sizes)
    start[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(start)
    offsets = np.append(at, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    count = np.diff(np.searchsorted(at, np.concatenate(([0], ends))))
    return words.dictionary_encode(), count


# --- documents -------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, table: PieceTable, text_col: str, keep: int, scratch: Scratch) -> DataFrame:
    """At most keep words (_w): those of the counts at which, from the top, they still fit.

    Words seen once or longer than 64 characters are left to the fold in place; so is the rest. Null and empty
    texts have no words, repeated rows count again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for _, _, texts in chunks(batches, "_t", SLICE):
            words, _ = segments(texts, sent.value)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], names=["_w", "n"])

    words = arrow(docs.select(F.col(text_col).cast("binary").alias("_t")), run, "_w binary, n long")
    words = words.groupBy("_w").agg(F.sum("n").alias("count")).filter("count > 1")
    words = words.select(F.replace(F.col("_w").cast("string"), F.lit(" "), F.lit(GAP)).alias("_w"), "count")
    counts = scratch.write(words.filter("length(_w) <= 64"), "words")
    unpersist(sent)
    level = F.floor(F.log2("count") * 8).cast("int")
    left, floor_ = keep, None
    for r in sorted(counts.groupBy(level.alias("_l")).count().collect(), key=lambda r: -r["_l"]):  # at most 8 * 63 rows
        if r["count"] > left:
            break
        left, floor_ = left - r["count"], r["_l"]
    return counts.filter(F.lit(False) if floor_ is None else level >= floor_).select("_w")


def encode(docs: DataFrame, table: PieceTable, text_col: str = "text", ids_col: str = "ids", frequent: int = FREQUENT, check_col: str | None = None, drop_text: bool = False) -> DataFrame:
    """docs with ids_col, the piece ids of each text, as the sentencepiece library encodes it.

    The lattice is relational: all substrings of a word up to the longest piece are joined to the piece
    table, the edges are grouped by word, and a higher-order fold picks the path. The model at hand is a BPE
    model, whose path is not the best-scoring one (Viterbi) but the one left by joining neighbours best
    first; so its fold does that, and Viterbi is the fold of unigram models. Words that occur most over all
    documents (at most `frequent`) are encoded by the lattice and sent to every task; the same fold runs in
    place for the others, so documents are never shuffled.

    Null and empty texts have no ids. Any text comes back from `decode` but for U+2581, which the model reads
    as a space. An existing column of the name ids_col is replaced; others pass through. Repeated rows and
    null ids are as any other row. An empty table gives an empty result.

    check_col adds whether decoding gives the text again, in the same pass; drop_text leaves the text out.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    known = encode_words(frequent_words(docs, table, text_col, frequent, scratch), table).toArrow()
    keys = [w.replace(GAP, " ").encode() for w in known.column("_w").to_pylist()]
    sent = docs.sparkSession.sparkContext.broadcast((table, keys, plain(pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *map(plain, known.column("ids").chunks)]))))
    checks = [check_col] if check_col else []
    base = docs.drop(ids_col, *checks)
    passed = [f for f in base.schema.fields if not (drop_text and f.name == text_col)]
    schema = T.StructType([*passed, T.StructField(ids_col, T.ArrayType(T.IntegerType())), *[T.StructField(c, T.BooleanType()) for c in checks]])

    def run(batches):
        encoder, pieces = Encoder(*sent.value), piece_bytes(sent.value[0])
        for batch in batches:
            column = pa.RecordBatch.from_arrays([batch.column(text_col).cast(pa.binary())], names=["_t"])
            for _, first, texts in chunks([column], "_t", SLICE):
                words, count = segments(texts, sent.value[0])
                lists = encoder(words.dictionary.to_pylist()).take(words.indices)
                ends = lists.offsets.to_numpy()[np.concatenate(([0], np.cumsum(count)))]
                part = batch.slice(first, len(texts))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values)
                out = {f.name: part.column(f.name) for f in passed} | {ids_col: ids}
                for c in checks:
                    out[c] = pc.equal(texts_of(ids, pieces), pc.fill_null(part.column(text_col), ""))
                yield pa.RecordBatch.from_pydict(out)

    return arrow(base, run, schema)


def piece_bytes(table: PieceTable) -> pa.BinaryArray:
    raw = [b"" if i in table.control else t.replace(GAP, " ").encode() for i, t in enumerate(table.texts)]
    for v, i in enumerate(table.bytes_):
        raw[i] = bytes([v])
    return pa.array(raw, pa.binary())


def texts_of(lists: pa.ListArray, pieces: pa.BinaryArray) -> pa.Array:
    """Pieces of each list in one text, without the gap before it."""
    bytes_ = pieces.take(lists.flatten())
    count = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(False)
    cuts = np.concatenate(([0], np.cumsum(count)))
    at = np.frombuffer(bytes_.buffers()[1], dtype=np.int32)[cuts] if len(bytes_) else cuts
    data = np.frombuffer(bytes_.buffers()[2] or b"", dtype=np.uint8)[: at[-1]]
    begin = at[:-1][np.diff(at) > 0]
    begin = begin[data[begin] == 32]
    at = at - np.searchsorted(begin, at)
    data = np.delete(data, begin)
    gone = None if not lists.null_count else pa.py_buffer(np.packbits(lists.is_valid().to_numpy(False), bitorder="little"))
    out = pa.Array.from_buffers(pa.binary(), len(lists), [gone, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:  # bytes of some text are no UTF-8
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in out.to_pylist()], pa.string())


def decode(rows: DataFrame, table: PieceTable, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with text_col, the text of the piece ids; bytes that are no UTF-8 become U+FFFD, null ids null."""
    sent = rows.sparkSession.sparkContext.broadcast(table)
    base = rows.drop(text_col)

    def run(batches):
        table = sent.value
        pieces = piece_bytes(table)
        for b in batches:
            ends, i = b.column(ids_col).offsets.to_numpy(), 0
            while i < b.num_rows:  # rows of about IDS ids; a longer one comes alone
                n = max(1, int(np.searchsorted(ends, ends[i] + IDS, "right")) - 1 - i)
                part = b.slice(i, n)
                yield pa.RecordBatch.from_arrays([*part.columns, texts_of(part.column(ids_col), pieces)], names=[*part.schema.names, text_col])
                i += n

    return arrow(base, run, T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType())]))


def digest(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, ids_hash and round_trip (whether decoding gives the text again) of every row.

    Null and empty texts have 0 pieces; rows that repeat an id are all answered, null ids are passed on; other
    columns are ignored whatever their names; an empty table gives an empty result.
    """
    rows = encode(docs.select(id_col, text_col), table, text_col, check_col="round_trip", drop_text=True)
    return rows.select(id_col, F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """digest of all documents."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(model))
