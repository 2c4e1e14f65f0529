"""The whole pipeline against a brute-force version of its five stages."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from gaitframe.llm import sentencepiece_codec

SPACE = r"[\x20\x09-\x0D]+"


def shingles(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_force(rows, items):
    """(doc_id, text) that stay; with two languages the likelier one always has a probability of 0.5 or more."""
    kept = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    first = {}
    for i, t in sorted(kept):
        first.setdefault(re.sub(SPACE, " ", t), i)
    kept = [(i, t) for i, t in sorted(kept) if first[re.sub(SPACE, " ", t)] == i]
    sets = [shingles([w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w], 5) for _, t in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    kept = [kept[k] for k in range(len(kept)) if group[k] == k]
    plain = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w]

    def holds(text, item):
        have = shingles(plain(text), 5)
        return all(len(have & (s := shingles(plain(p), 5))) >= 0.8 * len(s) for p in item)

    return [(i, t) for i, t in kept if not any(holds(t, item) for item in items)]


def test_pipeline(spark, tmp_path):
    import sentencepiece

    r = random.Random(11)
    vocab = [["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(200)] for letters in ("aeioukst", "bcdfgyzw")]
    text = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n))
    items = [(text(0, 14) + "?", text(0, 7) + "."), (text(1, 20) + "?", text(1, 8) + ".")]
    texts = [text(k % 2, 40 + k) for k in range(60)]
    texts += [texts[3], texts[3].replace(" ", "\n\t", 4), texts[8], texts[3]]
    for k in (10, 11, 12):
        w = texts[k].split()
        w[5] = "xx"
        texts += [" ".join(w), texts[k].upper()]
    texts += [text(0, 30) + " " + " ".join(items[0]) + " " + text(0, 30), text(1, 25) + " " + " ".join(items[1]).upper()]
    texts += [text(0, 30) + " " + items[0][0] + " " + text(0, 30)]  # the question alone is no leak
    texts += [None, "", " \n", "123 !?", "a", text(1, 3000)]
    rows = [(i, t, "pq"[i % 2] if i < 60 else None, f"s{i % 3}" if i % 7 else None, len(t) if t else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = brute_force(rows, items)
    ids = {i for i, _ in kept}
    assert not ids & {60, 61, 62, 63, 64, 65, 70, 71, 73, 74, 75, 76} and {3, 8, 10, 72, 78} <= ids
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    coded = spark.createDataFrame([(i, sp.encode(t)) for i, t in kept], "doc_id long, ids array<int>")
    want = coded.select("doc_id", F.size("ids").cast("long"), F.xxhash64("ids"), F.lit(True))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_pieces", "ids_hash", "round_trip")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = tmp_path / "empty"
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_stages_tell_rows_of_one_id_and_null_ids_apart(spark, tmp_path):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("aeioukst") for _ in range(r.randint(3, 7))) for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    item = (text(14) + "?", text(8) + ".")
    leak = text(20) + " " + " ".join(item) + " " + text(20)
    near_b = b.replace(b.split()[4], "xx")
    schema = "doc_id long, text string, source string"
    stage = lambda f, rows: sorted((x.doc_id, x.text) for x in f(spark, spark.createDataFrame(rows, schema).repartition(3), str(tmp_path)).collect())
    key = lambda rows: sorted(rows, key=repr)
    got = corpus_pipeline.exact(spark, spark.createDataFrame([(1, a, "s"), (2, a, "s"), (2, c, "s"), (3, d, "s"), (3, d, "s"), (4, a.replace(" ", "  "), "s"), (None, a, "s"), (None, e, "s"), (None, e, "s")], schema).repartition(3), "")
    assert key((x.doc_id, x.text) for x in got.collect()) == key([(1, a), (2, c), (3, d), (None, e)])
    assert got.columns == ["doc_id", "text", "source"]
    got = corpus_pipeline.near(spark, spark.createDataFrame([(1, b, "s"), (2, near_b, "s"), (2, c, "s"), (None, b + " yy", "s"), (None, d, "s"), (None, e, "s"), (None, e + " zz", "s")], schema), "")
    got = [(x.doc_id, x.text) for x in got.collect()]
    assert key(x for x in got if x[1] not in (e, e + " zz")) == key([(1, b), (2, c), (None, d)]) and len(got) == 4
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert stage(corpus_pipeline.clean, [(1, leak, "s"), (1, c, "s"), (2, d, "s")]) == [(1, c), (2, d)]
    assert stage(corpus_pipeline.clean, [(None, leak, "s"), (3, d, "s")]) == [(3, d)]


def test_stages_leave_other_columns_alone(spark, tmp_path):
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choice("aeioukst") for _ in range(r.randint(3, 7))) for _ in range(n))
    a, b = text(60), text(50)
    item = text(14) + "? " + text(8) + "."
    extra = "_row long, _gone long, _n long, _s string, _i long, _kept boolean, _r long, _q long, _t string, _c long, component_id long, keep_id long, lang_pred string"
    rest = (1, 2, 3, "s", 4, True, 5, 6, "t", 7, 8, 9, "l")
    rows = [(1, a, "en", *rest), (2, a, "en", *rest), (3, b, "en", *rest), (4, b + " zz", "en", *rest), (5, text(9) + " " + item, "en", *rest), (6, None, "en", *rest)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {"language_id": {1, 2, 3, 4, 5}, "exact_dedup": {1, 3, 4, 5, 6}, "jaccard_join": {1, 3, 5, 6} | {2}, "decontaminate": {1, 2, 3, 4, 6}}
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = docs.filter("doc_id != 2") if name == "jaccard_join" else docs
        got = stage(spark, rows, str(tmp_path))
        assert got.columns == docs.columns and got.schema["_kept"].dataType.simpleString() == "boolean"
        kept = got.collect()
        assert {x.doc_id for x in kept} == want[name] - ({2} if name == "jaccard_join" else set()) and all(tuple(x)[3:] == rest for x in kept), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == 6
