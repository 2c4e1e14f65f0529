"""Forced collisions, contract sizes, index reopening, brute-force versions of the searches and models, awkward columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitframe.llm import decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, quality_classifier, sharding, shared, substring_dedup, suffix_dedup
from gaitframe.llm.repeats import keyed

from .test_llm import BASE, ROWS, brute_components, rows_of, words

rnd = random.Random(8)
SHARED = words(120)
PLANTED = [(i, f"{words(20)} {SHARED if i % 3 else SHARED[: 200 + i]} {words(30)}") for i in range(12)] + [(20, None), (21, ""), (None, words(50) + " " + SHARED), (3, SHARED)]


def table(spark, rows=PLANTED):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def op3(df, **kw):
    return rows_of(substring_dedup.substring_dedup(df, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)))


def op5(df, **kw):
    return rows_of(suffix_dedup.suffix_dedup(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)))


def test_contract_sizes_and_colliding_segment_hashes(spark):
    d = table(spark)
    assert op3(d) == sorted(substring_dedup.brute_force(PLANTED, 35), key=repr)
    assert op5(d) == sorted(suffix_dedup.brute_force(PLANTED, 200), key=repr)
    # Segments of different content share a hash of one bit: contents decide all the same.
    assert op3(d, window=9, anchor=3, bits=1, batches=1) == sorted(substring_dedup.brute_force(PLANTED, 9), key=repr)
    assert op5(d, length=40, anchor=12, bits=1) == sorted(suffix_dedup.brute_force(PLANTED, 40), key=repr)


def test_long_strings_with_short_anchors(spark):
    text = words(500)
    rows = [(1, text), (2, text), (3, text[:700])]
    assert op5(table(spark, rows), length=600, anchor=64) == sorted(suffix_dedup.brute_force(rows, 600), key=repr)
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(table(spark, rows), 40, anchor=64)


def test_index_is_reopened_and_compacted(spark, tmp_path):
    """Three batches through an index that is closed in between; each batch also takes from earlier documents."""
    rows, root = [(i, t) for i, t in PLANTED if i is not None], str(tmp_path / "index")
    every = keyed(table(spark, rows), "doc_id", "text").cache()
    found: dict = defaultdict(set)
    for k in range(3):
        log = substring_dedup.FingerprintLog(spark, root, 9, 3, fanout=2)
        assert len(log.runs) == k
        spans = log.append(every.filter(F.col("_id") % 3 == k), every.filter(F.col("_id") % 3 <= k))
        for r in spans.collect():
            found[r._r, r._q] |= set(r._x)
        assert len(log.runs) == (1 if k == 2 else k + 1)  # more than two runs are compacted
        plan = log._table(log.runs[0]).join(log._table(log.runs[-1]).select("_h").hint("merge"), "_h", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs are merge-joined where they lie
        log.close()
        want = {i: n for i, _, n, _ in substring_dedup.brute_force([r for r in rows if r[0] % 3 <= k], 9)} if k < 2 else {}
        got = {r._id: len({p for x in found[r._r, r._q] for p in range(x >> 32, x & 0xFFFFFFFF)}) for r in every.filter(F.col("_id") % 3 <= k).collect()}
        if k < 2:
            assert Counter(got.values()) == Counter(want.values())
    want = sorted(n for _, _, n, _ in substring_dedup.brute_force(rows, 9))
    got = sorted(len({p for x in found[r._r, r._q] for p in range(x >> 32, x & 0xFFFFFFFF)}) for r in every.collect())
    assert got == want
    with pytest.raises(ValueError):
        substring_dedup.FingerprintLog(spark, root, 35, 12)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        shared.shared_dir(session)


def test_sharding_size_and_crc(spark):
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.shard(spark.createDataFrame(ROWS[:19], "doc_id long, text string, lang string, source string, n_chars long, size string, slot long")).collect()}
    assert got == {r[0]: (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS[:19]}


def test_chunks_follow_content_in_any_script(spark):
    """A few words put in front move the cuts of a text in no more than its first chunks, whatever its letters."""
    for letters in ("абвгдежзиклмнопрстуфхцчшщыэюя", "日本語文字列漢字仮名交読書話聞", "abcdefghijklmnopqrstuvwxyz ", "აბგდევზთიკლმნოპჟრსტუფქღყშჩც"):
        t = "".join(rnd.choice(letters) for _ in range(6000))
        a, b = (r.c for r in spark.createDataFrame([(t,), (letters[:3] + t,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect())
        assert "".join(a).encode("latin-1").decode() == t and len(set(a) - set(b)) <= len(a) // 2 and len(a) > 10


def test_jaccard_with_clashing_names_and_columns(spark):
    r = random.Random(6)
    base = [[r.choice(BASE[0].split()) for _ in range(k)] for k in (6, 12, 25, 60)]
    rows = []
    for k in range(60):
        w = list(base[k % 4])
        if k % 3:
            w[r.randrange(len(w))] = f"x{k % 5}"
        rows.append((k if k % 9 else None, " ".join(w), "clash", 1, 2))
    d = spark.createDataFrame(rows, "doc_id long, text string, _t string, _c long, component_id long")
    want = brute_components([(i, t) for i, t, *_ in rows], 3, 70)
    for bits in (64, 2):  # two bits: classes of different sets share a name
        assert rows_of(jaccard_join.jaccard_components(d, 3, 70, key_bits=bits)) == want
    assert jaccard_join.jaccard_components(d.limit(0)).count() == 0


def brute_leaks(docs, items, theta=0.5, overlap=0.8):
    """Every passage against every item: BM25 share, then the overlap of question and answer."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    bag = {i: split(t) for i, t in items if t and split(t)}
    n, mean, most = len(bag), sum(map(len, bag.values())) / len(bag), max(map(len, bag.values()))
    df = Counter(w for b in bag.values() for w in set(b))
    weight = {i: {w: c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(b) / mean)) * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) for w, c in Counter(b).items()} for i, b in bag.items()}
    out = {}
    for d, t in docs:
        ws = split(t or "")
        for s in range(0, max(1, len(ws)), most):
            p = ws[s : s + 2 * most]
            have = set(p)
            for i, w in weight.items():
                score = sum(v for k, v in w.items() if k in have) / sum(w.values())
                if score < theta - 1e-9:
                    continue
                shares = []
                for part in decontaminate.parts(dict(items)[i].encode()):
                    q = split(part.decode())
                    k = min(5, max(1, len(q)))
                    mine = {tuple(q[a : a + k]) for a in range(len(q) - k + 1)}
                    held = {tuple(p[a : a + k]) for a in range(len(p) - k + 1)}
                    shares.append(len(mine & held) / len(mine) if mine else 1.0)
                if min(shares) >= overlap:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_decontaminate_equals_brute_force(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(150)]
    some = lambda n: [r.choice(vocab[: r.choice([30, 150])]) for _ in range(n)]
    items = [(k, " ".join(some(r.randint(3, 40))) + "? " + " ".join(some(r.randint(2, 15))) + ".") for k in range(90)]
    docs = []
    for d in range(120):
        w = some(r.choice([5, 60, 300]))
        for _ in range(r.randint(0, 2)):
            own = items[r.randrange(90)][1].split()
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(vocab)
            at = r.randint(0, len(w))
            w[at:at] = own
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "?!")]
    want = brute_leaks(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_t", F.lit(1))
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 20 and min(want.values()) < 1 and got == pytest.approx(want)


def test_pivoting_opens_every_block_that_can_reach_theta():
    r = np.random.default_rng(4)
    items = [(i, " ".join(f"t{x}" for x in r.integers(0, 400, r.integers(4, 30))).encode()) for i in range(300)]
    index = decontaminate.Bm25Index(items)
    term = np.sort(r.choice(len(index.terms), 250, replace=False))
    q = np.repeat(np.arange(50), 5)
    keep = index.sparse[term]
    opened = set(index._open(q[keep], term[keep]).tolist())
    bound = defaultdict(float)
    for p, t in zip(q[keep], term[keep]):
        for e in range(index.b_first[t], index.b_first[t + 1]):
            bound[int(p * index.blocks + index.key[e] - t * index.blocks)] += index.top[e]
    assert opened == {k for k, v in bound.items() if v + index.constant[k % index.blocks] >= index.theta - 1e-9}


def test_lines_of_a_long_text(spark):
    common = [f"line {i}" for i in range(3000)]
    rows = [(i, "\n".join([*common, f"own {i}"]), f"s{i}") for i in range(9)] + [(9, "\n".join(common), "s0")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].kept == "own 3" and got[3].n_removed == 3000 and got[9].kept == "" and got[9].n_lines == 3000


def brute_languages(train, texts):
    """Word log frequencies, then ever shorter n-grams of words with a border on each side, in plain Python."""
    langs = sorted({g for _, g in train})
    seen = defaultdict(Counter)
    tokens = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", t)]
    for t, g in train:
        seen[g].update(tokens(t))
    grams = lambda w, n: [f"\0{w}\0"[i : i + n] for i in range(len(w) + 3 - n)]
    tables = {0: {g: dict(c) for g, c in seen.items()}}
    for n in language_id.GRAMS:
        tables[n] = {g: Counter() for g in langs}
        for g in langs:
            for w, c in seen[g].items():
                for x in grams(w, n):
                    tables[n][g][x] += c
    logs = {}
    for n, t in tables.items():
        keys = {k for c in t.values() for k in c if sum(x.get(k, 0) for x in t.values()) > 1}
        total = {g: sum(t[g].get(k, 0) for k in keys) for g in langs}
        logs[n] = {k: np.array([math.log((t[g].get(k, 0) + 0.5) / (total[g] + 0.5 * len(keys))) for g in langs]) for k in keys}

    def value(w):
        if w in logs[0]:
            return logs[0][w]
        for n in language_id.GRAMS:
            hit = [logs[n][x] for x in grams(w, n) if x in logs[n]]
            if hit:
                return sum(hit) / len(hit)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        ws = tokens(t or "")
        s = sum((value(w) for w in ws), np.zeros(len(langs)))
        out.append((langs[int(s.argmax())], 1 / np.exp(s - s.max()).sum()) if ws else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    r = random.Random(3)
    vocab = {g: ["".join(r.choice(c) for _ in range(r.randint(1, 7))) for _ in range(60)] for g, c in (("x", "abcdé"), ("y", "bcdef"), ("z", "cdefgß"))}
    train = [(" ".join(r.choice(vocab[g]).capitalize() for _ in range(25)), g) for g in "xyz" for _ in range(12)]
    texts = [" ".join("".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4))) for _ in range(150)] + ["", None, "12 ?", "q", "Abc-DEF", "é" * 400]
    model = language_id.fit(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], "doc_id long, text string, lang string"))
    got = {x.doc_id: x for x in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (lang, score) in enumerate(brute_languages(train, texts)):
        assert got[i].score == pytest.approx(score, abs=1e-4)
        assert got[i].lang_pred == lang or abs(score - 0.5) < 1e-3 or score < 0.34


def test_words_of_any_length_take_time_in_proportion():
    import time

    t = time.time()
    x, start, end, _ = language_id._words(["a" * 3_000_000 + " b", "ab ba"])
    h = language_id._word_hash(x, start, end)
    assert len(set(h.tolist())) == 4 and time.time() - t < 5


def test_quality_views_teach_each_other(spark):
    """Sources go with quality and so do words; few rows have a label."""
    r = random.Random(2)
    good, bad = ["river", "stone", "quiet", "letter"], ["click", "prize", "cheap", "winner"]
    rows = []
    for i in range(600):
        y = i % 2
        rows.append((i, " ".join(r.choice(good if y else bad) for _ in range(30)), "en", ("s" * 80) + ("good" if y else "bad"), 100 + r.randint(0, 9), 1, "clash"))
    rows += [(None, None, None, None, None, 1, "c"), (7, "river " * 40_000, "en", None, -5, 1, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id long, score string").repartition(4)
    lab = spark.createDataFrame([(i, i % 2) for i in range(0, 80)] + [(None, 1), (900, None)], "doc_id long, quality int")
    report: dict = {}
    got = quality_classifier.classify(d, lab, report=report).collect()
    assert len(got) == 602 and all((x.score > 0.5) == bool(x.doc_id % 2) for x in got if x.doc_id is not None and x.doc_id < 600 and x.p_meta != x.p_text and x.doc_id != 7)
    assert min(report["auc_after"]) > 0.95  # sources that differ behind their 80th letter are told apart
    assert report["taught"] and any(k.startswith("meta") for t in report["taught"] for k in t) and any(k.startswith("text") for t in report["taught"] for k in t)
    again = quality_classifier.classify(d.coalesce(1), lab)
    key = lambda x: repr((x.doc_id, round(x.score, 6)))
    assert sorted(map(key, again.collect())) == sorted(map(key, got))  # whatever the partitions


def test_hashes_of_docs(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None), (2, "")], "doc_id long, text string")
    keys = [tuple(r.k) for r in one.select(shared.row_key("doc_id", "text").alias("k")).collect()]
    assert len(set(keys)) == 4 and hashlib.sha256(b"").hexdigest().startswith("e3b0")
