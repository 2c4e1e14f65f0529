"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitframe.llm import decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, quality_classifier, sentencepiece_codec, sharding, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, keep_id long"
rnd = random.Random(3)
VOCAB = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(300)]


def words(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


BASE = [words(60) for _ in range(6)]
SHARED = words(45)
TEXTS = [None, "", " \n\t", "a", "a b", BASE[0], BASE[0], BASE[0].replace(" ", " \n", 3), BASE[1], BASE[1] + " zz", BASE[2] + " " + SHARED, SHARED + " " + BASE[3],
         "x " * 400, "ab" * 700, words(4000), BASE[4].upper(), BASE[4], "日本 語 🙂 " * 50, "a\x00b " * 80]
ROWS = [(i, t, "en", f"s{i % 3}", 1, "clash", 5) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], None, None, None, None, None), (None, "null id", "en", "s", 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for r in ROWS:
        g = groups[norm(r[1])]
        ids = [x for x in g if x is not None]
        keep = min(ids) if ids else None
        want.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    assert rows_of(exact_dedup.exact_dedup(docs)) == sorted(want, key=repr)
    weak = exact_dedup.exact_dedup(docs, chunk_key=lambda c: F.length(c).cast("long"), least=8, most=16)  # keys that clash
    assert rows_of(weak) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_sharding(spark, docs):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"rows"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    a, b = sharding.domain(1000)
    x = spark.range(a * b).select(sharding.feistel(F.col("id"), a, b, sharding.round_keys(1)).alias("x"))
    assert x.distinct().count() == a * b and x.agg(F.max("x")).first()[0] == a * b - 1
    assert sharding.shard(docs.limit(0)).count() == 0


def test_sharding_sql(spark, tmp_path):
    import duckdb

    d = spark.createDataFrame([(i * 7, f"t{i}") for i in range(50)], "doc_id long, text string")
    got = sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(d).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i * 7 AS doc_id, 't' || i AS text FROM range(50) r(i)")
    rel = con.sql(sharding.OP2_SQL_WITHOUT_CRC)
    k = [rel.columns.index(c) for c in ("doc_id", "shard", "slot")]
    assert sorted(tuple(r[i] for i in k) for r in rel.fetchall()) == got


@pytest.mark.parametrize("crowd", [1, 4096])
def test_substring_and_suffix_dedup(docs, crowd):
    rows = [(r[0], r[1]) for r in ROWS]
    got = substring_dedup.substring_dedup(docs, 9, anchor=3, crowd=crowd).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert rows_of(got) == sorted(substring_dedup.brute_force(rows, 9), key=repr)
    got = suffix_dedup.suffix_dedup(docs, 40, anchor=12, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows_of(got) == sorted(suffix_dedup.brute_force(rows, 40), key=repr)


def test_substring_dedup_of_nothing(docs):
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_difference_cover_and_classes():
    for v in (2, 3, 16, 64):
        cover, shift = suffix_dedup.difference_cover(v)
        assert all(cover[(i + shift[i, j]) % v] and cover[(j + shift[i, j]) % v] for i in range(v) for j in range(v))
    data = np.frombuffer(bytes(rnd.choice(b"ab\0") for _ in range(3000)) * 2, dtype=np.uint8)
    place = np.arange(len(data) - 30)
    label = suffix_dedup.suffix_classes(data, place, 30)
    names = {}
    assert all(names.setdefault(data[p : p + 30].tobytes(), k) == k for p, k in zip(place, label)) and len(set(label)) == len(names)


def brute_components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[a : a + n]) for a in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    link = list(range(len(sets)))

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                link[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(sets):
        ids.setdefault(root(k), []).append(i)
    return sorted(((i, len(s), min([x for x in ids[root(k)] if x is not None], default=None)) for k, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("n,percent", [(3, 90), (2, 70)])
def test_jaccard_components(spark, n, percent):
    r = random.Random(n)
    base = [[r.choice(VOCAB) for _ in range(k)] for k in (3, 8, 12, 20, 30, 80, 200)]
    rows = [(i, r_[1]) for i, r_ in enumerate(ROWS)]
    for k in range(90):
        w = list(base[k % len(base)])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_join.jaccard_components(df, n, percent)) == brute_components(rows, n, percent)


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "Who was it then? It was the cat of my aunt."), (2, None), (3, ""), (4, SHARED), (5, "nowhere to be seen at all here")], "item_id long, text string")
    more = docs.union(spark.createDataFrame([(90, words(500) + " who was IT, then? it was the cat of my aunt " + words(300), *[None] * 5)], SCHEMA))
    got = decontaminate.contaminated(more, items, index_bytes=64)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(90, 1), (10, 4), (11, 4)}
    assert decontaminate.contaminated(more, items.limit(0)).count() == 0


def test_decontaminate_in_passes_scores_like_one_index(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(vocab[: 20 + 3 * k]) for _ in range(20 + 4 * k)) + "? " + " ".join(r.choice(vocab) for _ in range(30)) + ".") for k in range(12)]
    rows = []
    for k, t in items:
        w = t.split()
        w[-15] = "changed"
        rows.append((k, " ".join(r.choice(vocab) for _ in range(50 + 7 * k)) + " " + " ".join(w) + " " + " ".join(r.choice(vocab) for _ in range(40))))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "?!")], "item_id long, text string")
    one, many = ({(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(d, b, index_bytes=n).collect()} for n in (1 << 20, 700))
    assert len(one) >= 12 and min(one.values()) < 1 and many == pytest.approx(one)


def test_line_dedup(spark):
    rows = [(i, f"menu\n own {i}\n\nfooter {i % 2} \n", f"s{i}", 1) for i in range(12)] + [(None, None, None, None), (20, "", "s1", 1), (21, "menu", None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _gone long")
    got = {r.doc_id: r for r in line_dedup.line_dedup(d, 7).collect()}
    assert got[3].kept == " own 3\n\nfooter 1 \n" and (got[3].n_lines, got[3].n_removed) == (5, 1)
    assert got[None].kept is None and got[None].n_lines == 0 and got[20].kept == "" and got[21].kept == ""
    assert line_dedup.line_dedup(d.limit(0), 7).count() == 0


def test_language_id(spark):
    r = random.Random(1)
    a, b = ["kala", "mato", "suvi"], ["zwirn", "kraft", "schuh"]
    rows = [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(20)), "x" if i % 2 else "y") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d)
    new = spark.createDataFrame([(1, "kala suvi!", 0), (2, "Schuhkraft", 0), (3, "123 !?", 0), (4, None, 0), (5, "", 0), (None, "suvikala " * 5000, 0)], "doc_id long, text string, lang_pred int")
    got = {x.doc_id: x for x in language_id.identify(new, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None)] == ["x", "y", "und", "und", "und", "x"]
    assert got[3].score == 0 and 0.5 < got[1].score <= 1
    assert {x.doc_id for x in language_id.keep_identified(new, model).collect()} == {1, 2, None}
    none = language_id.fit(d.limit(0))
    assert language_id.identify(new, none).first().lang_pred == "und"


def test_language_model_ignores_layout(spark):
    r = random.Random(3)
    vocab = {g: ["".join(r.choice(c) for _ in range(r.randint(2, 9))) for _ in range(300)] for g, c in (("x", "aeikmnt"), ("y", "bdfgouz"))}
    rows = [(i, " ".join(r.choice(vocab["xy"[i % 2]]) for _ in range(40)), "xy"[i % 2]) for i in range(80)] + [(80, "Quellwasser quellwasser QUELLWASSER", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = language_id.fit(d.coalesce(1)), language_id.fit(d.repartition(7))
    for n in (0, *language_id.GRAMS):
        assert all((a == b).all() and len(a) for a, b in zip(one.tables[n], many.tables[n]))
    assert language_id.identify(spark.createDataFrame([(1, "quellwass")], "doc_id long, text string"), one).first().lang_pred == "x"
    # A word that occurs three times in one chunk leaves its n-grams, which nothing else has.
    x, start, end, _ = language_id._words(["quellwasser"])
    letters, at = language_id._padded(x, start, end)
    assert (one.find(5, language_id._gram_hash(letters, 5)[language_id._gram_places(at, 5)[0]]) >= 0).all()


def test_sentencepiece(spark, docs):
    import sentencepiece

    table = sentencepiece_codec.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for frequent in (50, 0):
        got = sentencepiece_codec.encode(docs, table, frequent=frequent)
        assert all(list(r.ids) == (sp.encode(r.text) if r.text else []) for r in got.collect())
    assert all(r.round_trip for r in sentencepiece_codec.digest(docs, table).collect())
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, table), table)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, table.bytes_[0xFF], table.ids["▁a"]])], "doc_id int, ids array<int>")
    assert [r.decoded for r in sentencepiece_codec.decode(odd, table).orderBy("doc_id").collect()] == [None, "", "\ufffd a"]
    assert sentencepiece_codec.encode(docs.limit(0), table).count() == 0


def test_unigram_lattice(spark):
    pieces = {"▁a": -1.0, "b": -2.0, "ab": -1.5, "▁ab": -4.0, "c": -3.0, "bc": -2.5}
    table = sentencepiece_codec.PieceTable({p: i + 1 for i, p in enumerate(pieces)}, pieces, ["?", *pieces], [], 0, "unigram")
    w = ["▁abc", "▁abab", "▁a", "abq", "▁abbc"]
    got = {r._w: list(r.ids) for r in sentencepiece_codec.encode_words(spark.createDataFrame([(x,) for x in w], "_w string"), table).collect()}
    assert got == {x: sentencepiece_codec.fold_word(x, table) for x in w}


def test_quality(spark):
    r = random.Random(2)
    rows = [(i, words(50).capitalize() + "." if i % 3 else "!!$$ " * r.randint(5, 60), "en", f"s{i % 4}", 9) for i in range(300)] + [(900, None, None, None, None), (None, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, 300, 2)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in quality_classifier.classify(d, lab).collect()}
    assert len(got) == 302 and all((got[i] > 0.5) == bool(i % 3) for i in range(300))
    assert quality_classifier.classify(d, lab.limit(0)).agg(F.count_distinct("score")).first()[0] == 1
