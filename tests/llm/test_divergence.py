"""Operator 12."""

import random
import re
from collections import Counter

import pyarrow as pa
from oracle_check import check, duck
from telespark.llm import divergence, queries

SF = "/root/testdata/sf0.001"


def brute(rows, top=10):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w in df if df[w] >= 10)
        count = {s: Counter(w for d in mine if d[1] == s for w in d[2] if df[w] >= 10) for s in {d[1] for d in mine}}
        count[None] = Counter(w for d in mine for w in d[2] if df[w] >= 10)
        p = {s: {w: 1 + 10 ** 9 * (c[w] + 2) // (c.total() + 2 * len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count.keys() - {None}:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), "pair") for o in count.keys() - {None, s}]
            terms = [(-f(p[s][w], p[None][w]), w.encode(), "term") for w in kept if count[s][w] and p[s][w] > p[None][w]]
            for part in (sorted(pairs), sorted(terms)[:top]):
                out += [(lang, s, kind, item.decode(), -value, k + 1) for k, (value, item, kind) in enumerate(part)]
    return sorted(out)


def rows_of(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


def mixed_rows():
    rng = random.Random(12)
    vocabulary = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60)] + ["Ärger", "ärger", "don't", "日本", "x y", "A1b"]
    rows = [(" ".join(rng.choices(vocabulary[k % 7:], k=rng.randint(0, 40))).upper() if k % 3 else " ".join(rng.choices(vocabulary, k=30)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", "hot", "hot", "hot", None])) for k in range(400)]
    return [*rows, *rows[:20], (None, "en", "silent"), ("", "xx", "p"), ("one two", "xx", "q"), (None, None, None), ("word " * 30000, "en", "long")]


def test_audit_is_brute_force_in_one_shard_and_in_many(spark, monkeypatch):
    rows = mixed_rows()
    frame = spark.createDataFrame([(*r, 7, "clash") for r in rows], "text string, lang string, source string, id int, term string")
    want = brute(rows)
    assert rows_of(divergence.audit(frame)) == want
    monkeypatch.setattr(divergence, "PAIRS", 3)
    assert rows_of(divergence.audit(frame, most=40)) == want


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    few = spark.createDataFrame([("a b", "en", "s"), ("a", "en", "t"), (None, "de", "s")], "text string, lang string, source string")
    assert rows_of(divergence.audit(few)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_terms_reach_the_vectorizer_once_for_a_window(spark):
    text = "Ärger über " + "foo bar, foo baz! " * 200
    docs = spark.createDataFrame([(text, "en", "a")] * 30 + [(text, "en", "b")] * 4 + [("", "en", "a"), ("Bar", "en", "b"), ("foo", "de", None), (None, "de", None)], "text string, lang string, source string").coalesce(1)
    rows = divergence.words(docs).collect()
    of = sorted((r.lang, r.source, r.times, t) for r in rows if r.times for t in r.terms)
    want = [("en", s, n * k + (w == "bar" and s == "b"), f"{w} en") for s, n in (("a", 30), ("b", 4)) for w, k in (("foo", 400), ("bar", 200), ("baz", 200), ("Ärger", 1), ("über", 1))]
    assert of == sorted([*want, ("de", "", 1, "foo de")])
    fit = Counter(t for r in rows if not r.times for t in r.terms)
    assert fit == {**dict.fromkeys(["foo en", "bar en", "baz en", "Ärger en", "über en"], 10), "foo de": 1}
    assert all(len(set(r.terms)) == len(r.terms) for r in rows)


def test_vectorizer_is_fitted_on_a_term_ten_times_at_most_over_all_windows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "WINDOW", 300)
    monkeypatch.setattr(divergence, "LONGEST", 3)
    texts = ["foo bar"] * 40 + ["foo Foo baz"] * 20 + [f"w{chr(97 + k % 8)} foo " * 30 for k in range(60)] + [None, ""]
    docs = spark.createDataFrame([(t, "en" if k % 5 else None, f"s{k % 3}") for k, t in enumerate(texts)], "text string, lang string, source string").repartition(3)
    rows = divergence.words(docs).where("times = 0").collect()
    df = Counter(f"{w} {'en' if k % 5 else ''}" for k, t in enumerate(texts) for w in set((t or "").lower().split()))
    assert Counter(t for r in rows for t in r.terms) == {w: min(n, 10) for w, n in df.items()}
    assert all(0 < len(set(r.terms)) == len(r.terms) <= 3 for r in rows)


def test_windows_reach_across_batches(spark, monkeypatch):
    sizes = [5, 0, 300, 40, 7, 1000, 0, 0, 60]
    batches = [pa.RecordBatch.from_pylist([{"lang": "en", "source": str(k), "text": "x" * n}]) for k, n in enumerate(sizes)]
    windows = [w.column(1).to_pylist() for w in divergence._filled(iter(batches), 400)]
    assert windows == [["0", "1"], ["2"], ["3", "4"], ["5"], ["6", "7", "8"]]
    assert windows == [w.column(1).to_pylist() for w in divergence._filled(iter(pa.Table.from_batches(batches).combine_chunks().to_batches()), 400)]
    assert list(divergence._filled(iter([]), 400)) == []
    monkeypatch.setattr(divergence, "BATCH", 2)
    docs = spark.createDataFrame([("foo", "en", "a")] * 7, "text string, lang string, source string").coalesce(1)
    assert [(r.times, r.terms) for r in divergence.words(docs).collect() if r.times] == [(7, ["foo en"])]


def test_windows_and_long_rows_are_brute_force(spark, monkeypatch):
    rows = mixed_rows()
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "WINDOW", 300)
    monkeypatch.setattr(divergence, "LONGEST", 3)
    assert rows_of(divergence.audit(frame)) == brute(rows)


def test_query_equals_its_twin(spark):
    message, _ = check(spark, duck(SF), SF, "op12_source_divergence", queries.QUERIES["op12_source_divergence"], queries.ORACLES["op12_source_divergence"])
    assert message.startswith("ok"), message
