"""Operators 3, 5, 8 and 9 against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle_check import check, duck
from telespark.llm import language_id, near_dedup, order_minhash, substring_dedup
from telespark.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, row int, words int, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, None, None, None) for i, t in rows], SCHEMA)


def words(rng, n, alphabet="abcdefgh"):
    return [rng.choice(alphabet) + rng.choice(alphabet) + rng.choice("xyz") for _ in range(n)]


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_twin(spark, name):
    message, _ = check(spark, duck(SF), SF, name, llm_queries.QUERIES[name], llm_queries.ORACLES[name])
    assert message.startswith("ok"), message


def removed(rows, k=13):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - k + 1):
            g = tuple(w[j:j + k])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and least[tuple(w[j:j + k])] < i:
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return out


def test_substring_dedup(spark):
    rng = random.Random(1)
    passage = words(rng, 60)
    rows = [(0, None), (1, ""), (2, "short one"), (3, " ".join(passage)), (4, " ".join(words(rng, 9) + passage[5:50] + words(rng, 9))), (4, " ".join(passage[:30])), (None, " ".join(passage)),
            (7, "a b " * 300), (6, "a b " * 20), (8, " ".join(words(rng, 40000) + passage)), (9, " x y " * 20), (10, " x y " * 15), (8, " ".join(passage[:14])), (3, " ".join(passage))]
    rows += [(100 + i, " ".join(words(rng, 20) + passage + words(rng, 20))) for i in range(200)]
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs(spark, rows)).select("row.doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == sorted(removed(rows), key=repr)
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_buckets_in_pieces(seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    rng = random.Random(seed)
    rows = [(rng.randint(0, 6), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for _ in range(12)]
    unpack, marks, buckets = substring_dedup.zstandard.ZstdDecompressor().decompress, {n: set() for n in range(len(rows))}, {}
    for low in range(0, len(rows), 4):
        for number, a, b, packed in substring_dedup._cut([r[0] for r in rows[low:low + 4]], list(range(low, low + 4)), [r[1] for r in rows[low:low + 4]], 5, 3):
            if not packed:
                (_, keys), (begin, until) = substring_dedup._halves(unpack(a), "<i8", "<i4"), substring_dedup._halves(unpack(b), "<i4", "<i4")
                for k, x, y in zip(keys, begin, until):
                    marks[k].update(range(x, y))
                continue
            bucket = buckets.setdefault(number, substring_dedup.Bucket(5))
            bucket.add(unpack(a), unpack(b), unpack(packed))
            for m in bucket.go():
                for _, k, x, y in zip(*(c.to_pylist() for c in m.columns)):
                    marks[k].update(range(x, y))
    assert [len(marks[n]) for n in range(len(rows))] == [r[2] for r in removed(rows, 5)]


def test_order_minhash(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "ab"), (None, "without id"), (7, "again"), (90, " ".join(words(rng, 9000)))]
    got = {(r.doc_id, r.n_chars): r for r in order_minhash.compare_edits(docs(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        other, row = order_minhash.edited(text, after), got[i, len(text)]
        mark = order_minhash.fingerprint(text)
        assert row.edited_sha256 == hashlib.sha256(other.encode()).hexdigest() and row.fingerprint == order_minhash.as_text(mark)
        assert row.edited_fingerprint == order_minhash.as_text(order_minhash.fingerprint(other))
        assert row.near_edited == order_minhash.likeness(mark, order_minhash.fingerprint(other)) and row.near_next == order_minhash.likeness(mark, order_minhash.fingerprint(after))
    assert order_minhash.compare_edits(docs(spark, [])).count() == 0
    one = order_minhash.compare_edits(docs(spark, [(1, "only one text")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_order_minhash_follows_edit_distance():
    text = " ".join(words(random.Random(3), 300))
    half = len(text) // 2
    mark = order_minhash.fingerprint(text)
    small, moved = order_minhash.fingerprint(text[:half] + "!" + text[half:]), order_minhash.fingerprint(text[half:] + text[:half])
    assert order_minhash.likeness(mark, small) > 0.85 > order_minhash.likeness(mark, moved) + 0.2


def classes(rows, least=0.8):
    bags = [Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().split()) else Counter() for _, t in rows]

    def likeness(a, b):
        return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a | b) for x in a & b)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and ((rows[i][1] or "") == (rows[j][1] or "") or bags[i] and bags[j] and likeness(bags[i], bags[j]) >= least):
                group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            ids[g] = min(ids.get(g, i), i)
    return [(i, ids.get(g)) for g, (i, _) in zip(group, rows)]


def test_near_dedup(spark):
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [(0, None), (1, ""), (2, " "), (3, "three short words"), (4, "three short words"), (5, "three short word"), (None, "three short words"), (None, "alone without id"), (6, " ".join(words(rng, 8000)))]
    rows += [(7, " ".join(base)), (7, " ".join(words(rng, 30)))]
    for i in range(60):                     # copies with one to four changed words: alike to the base, not always to each other
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(120)] = "new" + str(rng.randrange(1000))
        rows.append((200 - i, " ".join(copy)))
    rows += [(300 + i, " ".join(words(rng, 50))) for i in range(30)] + [(400, "x y z " * 50), (401, "x y z " * 51), (402, "x y z " * 90)]
    got = [tuple(r) for r in near_dedup.classes(docs(spark, rows)).select("row.doc_id", "class_id").collect()]
    assert sorted(got, key=repr) == sorted(classes(rows), key=repr)
    kept = near_dedup.keep_first(docs(spark, [*rows, rows[3]]))
    assert kept.columns == docs(spark, []).columns
    assert kept.count() == len(set(classes(rows)) & {(c, c) for _, c in classes(rows)}) + 2 - 1       # doc 7 heads two classes; one class has no id
    assert near_dedup.classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [12, 80])
def test_blocks_of_a_family_lose_no_component(n):
    """Blocks of two sizes, met in pairs, give the components of all pairs."""
    rng = random.Random(n)
    base, texts = words(rng, 90), []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(90)] = "new" + str(rng.randrange(1000))
        texts.append(" ".join(copy))
    nodes = [b"%03d" % i for i in range(n)]
    block = [rng.randrange(3) for _ in range(n)]
    links = []
    for low in range(3):
        for high in range(low, 3):
            at = [i for i in range(n) if block[i] in (low, high)]
            links += near_dedup.settle([nodes[i] for i in at], [nodes[i] for i in at], np.array([block[i] != low for i in at]), [texts[i] for i in at], 0.8)
    bags = [near_dedup.shingles([t])[1:] for t in texts]
    close = [(nodes[i], nodes[j]) for i in range(n) for j in range(i) if near_dedup.probability_jaccard(bags[i], bags[j]) >= 0.8]
    assert set(links) <= {p for x, y in close for p in ((x, y), (y, x))} and len(close) > len(links) - 3

    def parts(edges):
        group = {x: x for x in nodes}
        for _ in range(n):
            for a, b in edges:
                group[a] = group[b] = min(group[a], group[b])
        return group
    assert parts(links) == parts(close)


def test_probability_jaccard_matches_registers():
    rng = random.Random(5)
    a = " ".join(words(rng, 200))
    b = a + " " + " ".join(words(rng, 60)) + " " + a[:200]
    exact = near_dedup.probability_jaccard(near_dedup.shingles([a])[1:], near_dedup.shingles([b])[1:])
    _, registers = near_dedup.signatures([a, b], size=4096)
    assert abs((registers[0] == registers[1]).mean() - exact) < 0.04
    assert near_dedup.probability_jaccard(near_dedup.shingles([a])[1:], near_dedup.shingles([a])[1:]) == pytest.approx(1)


def test_language_id(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(frame.where(~held))
    found = language_id.predict(frame.where(held), model).select("doc_id", "lang", "language.*").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    odd = language_id.predict(docs(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "é"), (4, "é"), (None, "the of and " * 30000)]), model).select("doc_id", "language.*").collect()
    assert sorted((r.lang_pred == "und", r.score == 0) for r in odd) == [(False, False)] * 3 + [(True, True)] * 3


def test_language_id_without_labels(spark):
    assert language_id.fit(docs(spark, [(1, "text")])) is None
    assert [r.lang_pred for r in language_id.predict(docs(spark, [(1, "text")]), None).select("language.*").collect()] == ["und"]
    assert language_id.predict(docs(spark, []), None).count() == 0


def invented(seed, n, least=8):
    """Texts of an invented language: a seed is a language."""
    rng = random.Random(seed)
    letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 16)
    syllables = [rng.choice(letters) + rng.choice("aeiou") + rng.choice(letters + [""] * 8) for _ in range(45)]
    known = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(600)]
    return [" ".join(known[min(int(rng.paretovariate(0.6)) - 1, 599)] for _ in range(rng.randint(least, 120))) for _ in range(n)]


@pytest.mark.parametrize("languages", [2, 4, 20])
def test_language_stage(spark, languages):
    rng = random.Random(9)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 90))) for _ in range(30)]
    texts = {seed: invented(seed, 70) for seed in range(1, languages + 1)}
    rows = [(seed * 1000 + i, t, f"m{seed}") for seed, all_of in texts.items() for i, t in enumerate(all_of)]
    # two thirds in one language, one third in another: a clear lead, but not the largest
    rows += [(100_000 + i, " ".join(a.split()[:40] + b.split()[:20]), None) for i, (a, b) in enumerate(zip(invented(1, 30, 60), invented(2, 30, 60)))]
    rows += [(200_000 + i, t, None) for i, t in enumerate(noise)] + [(300_000 + i, t, None) for i, t in enumerate(invented(77, 30) + invented(78, 30))]
    rows += [(400_000, "\u044d\u0442\u043e \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442 \u043e \u0432\u0435\u0449\u0430\u0445", None), (400_001, "12 !?", None), (400_002, None, None)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF).collect()
    assert {r.doc_id for r in kept} == {i for i, _, _ in rows if i < 200_000}


def test_known_share_of_one_row(spark):
    model = language_id.fit(docs(spark, [(1, "text")]).withColumn("lang", F.lit("a")))
    assert model.usual == [0] and model.predict(["text", "other", "1"])[2].tolist() == [1, 1, 0]


def test_all_languages_are_learned(spark):
    rows = [(seed * 100 + i, t, f"m{seed:02}") for seed in range(1, 71) for i, t in enumerate(invented(seed, 4 if seed > 66 else 6, 60))]
    rows = [(None if lang == "m67" else i, (t + " ") * (1 + 110_000 // len(t)) if lang == "m68" else t, lang) for i, t, lang in rows]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"m{seed:02}" for seed in range(1, 71)]
    texts = [(f"m{seed:02}", t) for seed in range(1, 71) for t in invented(seed, 7, 60)[-1:]]
    names = model.predict([t for _, t in texts])[0]
    assert np.mean([n == lang for n, (lang, _) in zip(names, texts)]) > 0.97 and names[66:68] == ["m67", "m68"]


def test_sparse_scores_are_the_product(monkeypatch):
    texts = [(f"m{seed}", t) for seed in range(5) for t in invented(seed, 60)]
    whole = language_id.Model([t for _, t in texts], [x for x, _ in texts])
    monkeypatch.setattr(language_id, "PRODUCT", 0)
    sparse = language_id.Model([t for _, t in texts], [x for x, _ in texts])
    new = [*invented(3, 9), *invented(99, 9), "x"]
    assert whole.weights is not None and sparse.weights is None
    assert np.allclose(whole.predict(new)[1], sparse.predict(new)[1], atol=1e-4) and whole.predict(new)[0] == sparse.predict(new)[0]
