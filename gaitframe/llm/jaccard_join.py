"""Set-similarity join of word n-grams: subsets for light sets, inverted lists for heavy ones."""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import U64, Scratch, arrow, chunks, constants, joined, mix, row_keys, unpersist, window_hash, words_of

#: Counters of the frequency sketch (2^bits), and the largest set size that may count as light.
SKETCH_BITS, LIGHT_MAX = 20, 40
_K = constants(64, 91)
HIGH44 = 20


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; with fewer words the whole sequence as one."""
    data, at = joined(texts, "fold")
    h, start, _ = words_of(data)
    first = np.searchsorted(start, at)
    grams = window_hash(h, n, 3)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _K[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(grams[:0])
    return out


def required(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of a and b elements that are linked."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(s: int, percent: int) -> int:
    """Elements of a set of size s that must hold one of any partner's, in a common order."""
    return s - -(-percent * s // 100) + 1


def parity(s: np.ndarray) -> bytes:
    """Parity bitmap of about half as many bits as elements; folds to any smaller power of two."""
    bits = max(64, 1 << int(max(1, len(s) // 2) - 1).bit_length())
    p = np.bincount((mix(s ^ _K[60]) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(p.astype(np.uint8), bitorder="little").tobytes()


def set_key(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Both halves of the 128-bit digest of a sorted set; bits shortens the first, for tests of its collisions."""
    a, b = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
    return (a if bits >= 64 else a & ((1 << bits) - 1)), b


def light_boundary(sizes: dict[int, tuple[int, int]], percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists.

    sizes: by size the number of sets and the summed length of the inverted lists they would scan.
    """

    def subsets(s: int) -> int:
        total = 0
        for p in range(-(-percent * s // 100), 100 * s // percent + 1):
            c, m = min(required(s, p, percent), s), 1
            for i in range(s - c):
                m = m * (s - i) // (i + 1)
            total += m
        return total

    best, cost, light = 0, None, 0
    heavy = sum(scanned for _, scanned in sizes.values())
    for x in range(max(sizes, default=0) + 1):
        count, scanned = sizes.get(x, (0, 0))
        light += count * (subsets(x) if x else 0)
        heavy -= scanned
        if cost is None or light + heavy <= cost:
            best, cost = x, light + heavy
    return best


def signatures(s: np.ndarray, light: int, percent: int) -> list[tuple[int, int]]:
    """(signature, 0/1/2) of each subset a linked light partner of any size must share: 1 the smaller
    size of the pair's two, 2 the larger, 0 both alike."""
    out, size = [], len(s)
    value = mix(s ^ _K[61])
    total = int(value.sum())
    each = value.tolist()
    for p in range(max(1, -(-percent * size // 100)), min(light, 100 * size // percent) + 1):
        c, side = required(size, p, percent), 0 if p == size else 1 if size < p else 2
        if c > min(size, p):
            continue
        salt = min(size, p) * 65_537 + max(size, p)
        for gone in combinations(each, size - c):
            x = ((total - sum(gone)) * 0x9E3779B97F4A7C15 + salt * 0xD6E8FEB86659FD93) & (2**64 - 1)
            out.append((x - 2**64 if x >= 2**63 else x, side))
    return out


DESCRIBED = ["_r", "_q", "_id", "_c", "_e", "_size", "_bits", "_small", "_block"]


def _describe(n: int, bits: int, light_max: int, key_bits: int):
    """One row a document, and per task the sketch of n-gram frequencies in blocks. Small sets travel whole."""

    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.uint32)
        kind = None
        for b, first, texts in chunks(batches, "_t"):
            sets = shingle_sets(texts, n)
            every = np.concatenate(sets)
            counts += np.bincount((every & U64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            kind = b.schema.field("_id").type
            keys = [set_key(s, key_bits) if len(s) else (0, 0) for s in sets]
            part = b.slice(first, len(texts))
            yield pa.record_batch(
                [
                    part.column("_r"), part.column("_q"), part.column("_id"), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() if 0 < len(s) <= light_max else None for s in sets], pa.binary()), pa.nulls(len(texts), pa.int32()),
                ],
                names=DESCRIBED,
            )
        if kind is not None:
            blocks = counts.reshape(-1, min(1 << bits, 1 << 16))
            k = len(blocks)
            null = pa.nulls(k, pa.int64())
            cols = [null, null, pa.nulls(k, kind), null, null, null, pa.array([x.tobytes() for x in blocks], pa.binary()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32())]
            yield pa.record_batch(cols, names=DESCRIBED)

    return run


def _added(batches):
    """Sums of sketch blocks, one block at a time in memory per block number."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("_block").to_pylist(), b.column("_bits").to_pylist()):
            new = np.frombuffer(x, dtype=np.uint32)
            held[k] = held[k] + new if k in held else new
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["_block", "_bits"])


def _sketch(described: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch: of one size whatever the input, so it may go to the driver and back."""
    part = arrow(described.filter("_block IS NOT NULL").select("_block", "_bits"), _added, "_block int, _bits binary")
    whole = arrow(part.repartition("_block"), _added, "_block int, _bits binary").toArrow()
    out = np.zeros((max(1, (1 << bits) >> 16), min(1 << bits, 1 << 16)), dtype=np.uint64)
    for k, x in zip(whole.column("_block").to_pylist(), whole.column("_bits").to_pylist()):
        out[k] += np.frombuffer(x, dtype=np.uint32)
    return out.ravel().astype(np.uint32)


def _rarest(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a set's prefix, rarest first by the sketch, and their counts."""
    count = counts[(s & U64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((s, count))[: prefix_size(len(s), percent)]
    return s[order], count[order]


def _scanned(percent: int, sent):
    """Per size the number of small sets and the summed counts of their prefixes: how long the lists would be."""

    def run(batches):
        held: dict[int, list[int]] = {}
        for b in batches:
            for x in b.column("_small").to_pylist():
                s = np.frombuffer(x, dtype=np.uint64)
                own = held.setdefault(len(s), [0, 0])
                own[0] += 1
                own[1] += int(_rarest(s, sent.value, percent)[1].sum())
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int64()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], names=["_size", "_n", "_cost"])

    return run


def _postings(n: int, percent: int, light: int, sent, clash: frozenset, key_bits: int):
    """_h list, _c class, _z size * 2^32 + position, _side -1 for prefix elements or the subset's side."""
    heavy_from = -(-percent * (light + 1) // 100)

    def run(batches):
        for b, first, texts in chunks(batches, "_t"):
            cols: list[list] = [[], [], [], []]
            for s in shingle_sets(texts, n):
                size = len(s)
                if not size:
                    continue
                key, other = set_key(s, key_bits)
                if key in clash:
                    key = other
                if size >= heavy_from:
                    rare, _ = _rarest(s, sent.value, percent)
                    m = len(rare)
                    cols[0].append(rare.view(np.int64))
                    cols[1].append(np.full(m, key, dtype=np.int64))
                    cols[2].append(size * 2**32 + np.arange(m))
                    cols[3].append(np.full(m, -1, dtype=np.int64))
                if size <= light:
                    sig = signatures(s, light, percent)
                    if sig:
                        cols[0].append(np.array([x for x, _ in sig], dtype=np.int64))
                        cols[1].append(np.full(len(sig), key, dtype=np.int64))
                        cols[2].append(np.full(len(sig), size * 2**32, dtype=np.int64))
                        cols[3].append(np.array([y for _, y in sig], dtype=np.int64))
            if cols[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["_h", "_c", "_z", "_side"])

    return run


def _size(z: Column) -> Column:
    return F.shiftright(z, 32)


def _pos(z: Column) -> Column:
    return z.bitwiseAND(F.lit(2**32 - 1))


def _may_link(a: Column, b: Column, percent: int, light: int) -> Column:
    """Length filter, and in lists of elements the bound on the intersection when this is the first common one."""
    small, large = F.least(_size(a), _size(b)), F.greatest(_size(a), _size(b))
    rest = F.least(_size(a) - _pos(a), _size(b) - _pos(b))
    near = 100 * small >= percent * large
    return near & (F.col("_sub") | (((100 + percent) * rest >= percent * (small + large)) & (large > light)))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("_u"), F.greatest(a, b).alias("_v")]


def _prune(percent: int):
    """Pairs whose parity bitmaps leave room for the intersection; never drops a link."""

    def run(batches):
        for b in batches:
            sizes = [b.column(c).to_numpy() for c in ("_su", "_sv")]
            bits = [b.column(c) for c in ("_bu", "_bv")]
            width = [pc.binary_length(x).to_numpy(zero_copy_only=False) for x in bits]
            odd = np.zeros(b.num_rows, dtype=np.int64)  # elements of odd parity in one of the two
            for m, k in {*zip(width[0].tolist(), width[1].tolist())}:
                rows = np.flatnonzero((width[0] == m) & (width[1] == k))
                x, y = (np.frombuffer(b"".join(c.take(pa.array(rows)).to_pylist()), dtype=np.uint64).reshape(len(rows), -1) for c in bits)
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                odd[rows] = np.bitwise_count(x ^ y).sum(axis=1)
            total = sizes[0] + sizes[1]
            keep = (total - odd) // 2 >= -(-percent * total // (100 + percent))
            yield pa.RecordBatch.from_arrays([b.column("_u"), b.column("_v")], names=["_u", "_v"]).filter(pa.array(keep))

    return run


def _exact(n: int, percent: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                a, c = (shingle_sets(part.column(x).to_pylist(), n) for x in ("_tu", "_tv"))
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, c)]
                keep = [100 * m >= percent * (len(x) + len(y) - m) for x, y, m in zip(a, c, both)]
                yield pa.RecordBatch.from_arrays([part.column("_u"), part.column("_v")], names=["_u", "_v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (_u, _v) of classes that are linked: bitmaps first, then the texts of what is left."""
    side = lambda x: classes.select(F.col("_c").alias(f"_{x}"), F.col("_size").alias(f"_s{x}"), F.col("_bits").alias(f"_b{x}"))
    left = arrow(pairs.join(side("u"), "_u").join(side("v"), "_v"), _prune(percent), "_u long, _v long")
    left = scratch.write(left, "candidates")
    need = left.select(F.col("_u").alias("_c")).union(left.select("_v")).distinct()
    rows = need.join(classes.select("_c", F.col("_r").alias("_r2"), F.col("_q").alias("_q2")), "_c")
    texts = rows.join(docs.select("_r", "_q", "_t"), (F.col("_r") == F.col("_r2")) & (F.col("_q") == F.col("_q2")))
    texts = scratch.write(texts.groupBy("_c", "_t").count().select("_c", "_t"), "texts")
    text = lambda x: texts.select(F.col("_c").alias(f"_{x}"), F.col("_t").alias(f"_t{x}"))
    both = left.join(text("u"), "_u").join(text("v"), "_v")
    out = arrow(both.select("_u", "_v", "_tu", "_tv"), _exact(n, percent), "_u long, _v long")
    out = scratch.write(out, "links")
    scratch.drop(texts)
    scratch.drop(left)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """_c and _m, the smallest node of its component, for all nodes of edges (_u, _v).

    Every round takes each node's smallest neighbour, points neighbours at it (large star, then small
    star), and goes on from the new edges until they no longer change. Minima are pre-aggregated, and
    written, so that a join with a node of very many edges can be split.
    """
    now = edges.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).filter("_u != _v").distinct()
    now = scratch.write(now, "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        low = scratch.write(both.groupBy("_u").agg(F.min(F.least("_u", "_v")).alias("_m")), "low")
        large = both.filter("_v > _u").join(low, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).union(
            low.filter("_m < _u").select("_u", F.col("_m").alias("_v"))
        )
        large = scratch.write(large.filter("_u != _v").distinct(), "large")
        least = scratch.write(large.groupBy("_u").agg(F.min("_v").alias("_m")), "least")
        small = large.join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).union(least.select("_u", F.col("_m").alias("_v")))
        new = scratch.write(small.filter("_u != _v").distinct(), "edges")
        mark = new.agg(F.count("*"), F.bit_xor(F.xxhash64("_u", "_v"))).first()
        for old in (now, low, large, least):
            scratch.drop(old)
        now = new
        if mark == before:
            return now.select(F.col("_u").alias("_c"), F.col("_v").alias("_m"))
        before = mark


def jaccard_components(
    docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS, light_max: int = LIGHT_MAX, key_bits: int = 64
) -> DataFrame:
    """id, n_shingles and component_id of every row.

    A document's set holds the distinct n-word shingles of its text, A-Z in lower case; of a text with
    fewer words the whole sequence is the only element. Two documents are linked when
    100 * intersection >= percent * union; component_id is the smallest id reachable by links. Equal sets,
    by a 128-bit digest, are one class from the start, so copies cost nothing further. A class is named by
    half of it; names that turn out to stand for several sets (about n^2 / 2^65 of n) become the other half.

    Light sets enumerate the subsets of the size any linked partner must share, heavy sets are found in
    inverted lists of their rarest elements, in the order of a frequency sketch over all documents; the
    boundary is the size up to which subsets cost less than the lists measured by that sketch. In a list
    everyone is compared with one member first (of a subset's list, one of the smaller size); only members
    that are still in different components afterwards are compared with each other. Bitmaps rule out
    pairs that cannot be linked, the texts decide all the rest, subsets included.

    Null or empty texts have no set and only themselves as component; so have texts without words. Rows
    that repeat an id are separate documents with one id; null ids never become a component_id unless all
    ids of the component are null. Long texts are read in blocks. Columns of docs beyond id and text are
    ignored whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    r, q = row_keys(id_col, text_col)
    rows = docs.select(r.alias("_r"), q.alias("_q"), F.col(id_col).alias("_id"), text.alias("_t"))
    schema = f"_r long, _q long, _id {kind}, _c long, _e long, _size long, _bits binary, _small binary, _block int"
    described = scratch.write(arrow(rows, _describe(n, bits, light_max, key_bits), schema), "sets")
    members = described.filter("_block IS NULL").select("_r", "_q", "_id", "_c", "_e", "_size", "_bits")
    classes = members.filter("_size > 0").groupBy("_c", "_e", "_size", "_bits").agg(F.min("_id").alias("_label"), F.first("_r").alias("_r"), F.first("_q").alias("_q"))
    classes = scratch.write(classes, "classes")
    clash = frozenset(x[0] for x in classes.groupBy("_c").count().filter("count > 1").select("_c").collect())  # about n^2 / 2^65 of n
    if clash:
        name = F.when(F.col("_c").isin(list(clash)) & (F.col("_size") > 0), F.col("_e")).otherwise(F.col("_c"))
        members, classes = members.withColumn("_c", name), classes.withColumn("_c", name)

    sent = spark.sparkContext.broadcast(_sketch(described, bits))
    small = arrow(described.filter("_small IS NOT NULL").select("_small"), _scanned(percent, sent), "_size long, _n long, _cost long")
    sizes = {x[0]: (x[1], x[2]) for x in small.groupBy("_size").agg(F.sum("_n"), F.sum("_cost")).collect()}  # a row a size
    light = light_boundary(sizes, percent)
    posts = arrow(rows.select("_t"), _postings(n, percent, light, sent, clash, key_bits), "_h long, _c long, _z long, _side long")
    rank = _pos(F.col("_z")) * F.lit(2**44) + F.shiftrightunsigned("_c", HIGH44)
    lists = posts.groupBy("_h", (F.col("_side") >= 0).alias("_sub")).agg(
        F.min(rank).alias("_k"), F.min("_c").alias("_c0"), F.max("_c").alias("_c1"), F.min("_side").alias("_s0"), F.max("_side").alias("_s1"),
        F.min(F.when(F.col("_side") <= 1, F.col("_c"))).alias("_hub"),
    )
    # Lists of one class link nothing; a subset for two different sizes needs a set of either.
    lists = lists.filter("_c0 != _c1 AND (NOT _sub OR _s0 != _s1 OR _s0 = 0)").select("_h", "_sub", "_k", "_hub")
    lists = scratch.write(lists, "heads")
    shared = posts.withColumn("_sub", F.col("_side") >= 0).join(lists, ["_h", "_sub"]).select("_h", "_c", "_z", "_sub", "_k", "_hub").distinct()
    shared = scratch.write(shared, "lists")
    unpersist(sent)

    subset = shared.filter("_sub AND _c != _hub").select(*_pair("_c", "_hub"))
    heavy = shared.filter("NOT _sub")
    hub = heavy.filter(F.shiftrightunsigned("_c", HIGH44) == F.col("_k").bitwiseAND(F.lit(2**44 - 1))).select(
        "_h", F.col("_c").alias("_hc"), F.col("_z").alias("_hz")
    )
    star = heavy.join(hub, "_h").filter((F.col("_c") != F.col("_hc")) & _may_link(F.col("_z"), F.col("_hz"), percent, light))
    star = scratch.write(star.select(*_pair("_c", "_hc")).union(subset).distinct(), "star")
    edges = _links(star, classes, rows, n, percent, scratch)
    first = components(edges, scratch)

    placed = shared.join(first, "_c", "left").select("_h", "_sub", "_c", "_z", F.coalesce("_m", "_c").alias("_m"))
    # Lists whose members are all in one component by now are done.
    split = placed.groupBy("_h", "_sub").agg(F.min("_m").alias("_m0"), F.max("_m").alias("_m1")).filter("_m0 != _m1").select("_h", "_sub")
    placed = scratch.write(placed.join(split, ["_h", "_sub"], "left_semi"), "open")
    other = placed.select("_h", "_sub", F.col("_c").alias("_oc"), F.col("_z").alias("_oz"), F.col("_m").alias("_om"))
    apart = (F.col("_c") < F.col("_oc")) & (F.col("_m") != F.col("_om")) & _may_link(F.col("_z"), F.col("_oz"), percent, light)
    rest = placed.join(other, ["_h", "_sub"]).filter(apart).select(*_pair("_c", "_oc")).distinct()
    rest = scratch.write(rest.join(star, ["_u", "_v"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _links(rest, classes, rows, n, percent, scratch)
        if not more.isEmpty():
            first = components(edges.union(more), scratch)

    named = classes.join(first, "_c", "left").select("_c", "_label", F.coalesce("_m", "_c").alias("_m"))
    label = named.groupBy("_m").agg(F.min("_label").alias("_l"))
    label = named.join(label, "_m").select(F.col("_c").alias("_q2"), F.col("_l"))
    out = members.select("_id", "_c", "_size").join(label, (F.col("_c") == F.col("_q2")) & (F.col("_size") > 0), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("n_shingles"), F.when(F.col("_q2").isNull(), F.col("_id")).otherwise(F.col("_l")).alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Candidates share a shingle; all pairs of equal or overlapping sets are counted and compared.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 90 * (x.k + y.k - m)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""
