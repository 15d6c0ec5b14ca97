"""Operators 4, 6, 7 and 10, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle_check import check, duck
from telespark.llm import html_text, mixing, nearest, preference, queries
from telespark.llm.components import components

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------------ pages

@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_pages_give_their_article(spark, model):
    rows = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet"), model).collect()
    right = 0
    for r in rows:
        inside = r.html[r.html.index("<article>"):].split("</article>")[0]
        page = html_text.Page(inside)
        right += r.main_text == page.text([True] * len(page.tag))
    assert right / len(rows) > 0.98


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain text with no tags at all. It is fine.", "plain text with no tags at all. It is fine."),
    ("<article><p>a &lt;b&gt; &amp;amp; c&nbsp;d<script>x<p>y</script>e<br>f</p><ul><li>one of it<li>two of it</ul></article>", "a <b> &amp; c de f one of it two of it"),
    ("<article><p>" + "The first part of it, which is long enough. " * 3 + "<p>Unfinished <b>bold <a href=\"x", "The first part of it, which is long enough. " * 3 + "Unfinished bold"),
    ("<article><p class=it's>Hello there, this is one.</p><p>Don't do it now, wait for the second one.</p></article>", "Hello there, this is one. Don't do it now, wait for the second one."),
    ("<article><p title='a > b' data-x=\"it's\" hidden\">The first of them is here.</p><p class = \"x\" 'y>And the second, it's short.</p><p a=b/c='d>The third, isn't it.</p></article>",
     "The first of them is here. And the second, it's short. The third, isn't it."),
    ("<body><nav><a href=1>Home</a></nav><main><p>Text one. It is here to be read.</p><aside>Side note. Buy now.</aside><p>Text two. It is here too.</p></main><section id='comments'><p>I disagree, strongly. It is bad.</p></section><footer>&copy; us</footer>",
     "Text one. It is here to be read. Text two. It is here too."),
])
def test_page(model, page, text):
    assert model.extract(page) == text


def test_odd_pages(spark, model):
    rows = [(1, None, "clash"), (2, "", "x"), (None, "<div>" * 5000 + "deep. text here", None), (3, "<article><p>" + "word and word. " * 50000, "x"), (3, "<p <div> <<>> <!-- open", "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), model).collect()
    assert len(got) == 5 and sorted(len(r.main_text) for r in got)[-1] > 700000
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string"), model).count() == 0
    assert html_text.fit(spark.createDataFrame([], "page_id long, html string")) is not None


def test_marginals_are_exact(model):
    page = html_text.Page("<body><div class='menu'><p>one<p>two</div><article><p>three<div>four</div></article>")
    n, potential = len(page.tag), np.clip(page.features() @ model.weights, -20, 20)
    pair, total, each = model.pair[page.kinds()], 0.0, np.zeros(n)
    for code in range(2 ** n):
        label = [(code >> i) & 1 for i in range(n)]
        weight = np.exp(sum(potential[i] * label[i] for i in range(n)) + sum(pair[i][label[page.parent[i]]][label[i]] for i in range(1, n)))
        total += weight
        each += weight * np.array(label)
    assert np.allclose(model.marginals(page), each / total, atol=1e-6)


def test_written_pages_are_learned(model):
    wrong = blocks = 0
    for seed in range(9000, 9060):
        page = html_text.Page(html_text.labelled_page(seed))
        seen = {node for node, text in page.pieces if text.strip()}
        wrong += sum(a != b for i, (a, b) in enumerate(zip(page.inherited(), model.marginals(page) > 0.5)) if i in seen)
        blocks += len(seen)
    assert wrong / blocks < 0.08


# ------------------------------------------------------------------------------------------ vectors

def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(24).astype("float32").tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]               # copies of one vector
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23), (2004, [float("inf")] * 24), (2005, [1.0] * 5), (None, [1.0] * 24), rows[5]]
    frame = spark.createDataFrame([(i, v, 9) for i, v in rows + odd], "vec_id long, embedding array<float>, part int")
    got = {}
    for r in nearest.nearest(frame, lambda x: x % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    right = 0
    for q, found in got.items():
        score = (v * v[ids == q][0]).sum(axis=1)
        want = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - score[ids == i][0]) < 1e-9 for _, i, s in found)
        right += len(set(want) & {f[1] for f in found})
    assert right / len(got) / 20 >= 0.99


def test_nearest_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [3.0, 3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nearest.nearest(frame, lambda x: x % 20 == 0).collect())) == [(0, 1, 20, 9.0), (0, 2, 1, 4.0), (20, 1, 0, 9.0), (20, 2, 1, 9.0)]
    assert nearest.nearest(frame.limit(0), lambda x: x % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(7)
    v, mean, turn = rng.standard_normal((400, 32)), rng.standard_normal(32), nearest.rotation(32, nearest.BITS)
    estimate, width = nearest.bounds(*nearest.encode(v, mean, turn), v[:50], mean, turn)
    assert (np.abs(estimate - v[:50] @ v.T) <= width).mean() > 0.995


# ------------------------------------------------------------------------------------------ mixing

def skewed(spark, n=900):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 300), "big" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 7}", "clash", 1) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "w w w", "big", "x", 1), (0, rows[0][1], "big", "x", 1), (n, None, "big", "x", 1), (n + 1, "", "none", "x", 1)], "doc_id long, text string, source string, block string, epoch int")


def test_mixture_meets_weights(spark):
    docs = skewed(spark)
    for entropy, repetition, budget in ((0.95, 4.0, 1.0), (0.95, None, 2.5), (None, 1.5, 1.0), (0.9, 4.0, None)):
        rows = mixing.mix(docs, entropy, repetition, budget, block_words=300).select("row.doc_id", "source", "words", "block", "epoch", "position").collect()
        have, want = {}, {}
        for r in rows:
            have[r.source] = have.get(r.source, 0) + r.words
        for r in docs.select("source", mixing.n_words(F.col("text")).alias("w")).collect():
            want[r.source] = want.get(r.source, 0) + r.w
        want.pop("none")
        total, sizes = sum(want.values()), dict(want)
        alpha = mixing.exponent(spark.createDataFrame([(s or "", w) for s, w in sizes.items()], "source string, words long"), entropy, repetition, budget)
        z = sum((w / total) ** alpha for w in sizes.values())
        scale = budget * total if budget else max(w / (w / total) ** alpha for w in sizes.values()) * z
        for s, w in sizes.items():
            target = (w / total) ** alpha / z * scale
            assert abs(have[s] - target) <= 1200, (s, have[s], target)     # to the nearest block
        assert all(0 <= r.position < 1.1 for r in rows)
        if budget is None:
            assert {r.doc_id for r in rows} >= {r.doc_id for r in docs.where("source <> 'none'").collect()}


def test_sources_without_words_stay(spark):
    rows = [(i, "w " * (i % 50), "big") for i in range(60)] + [(100 + i, None if i % 2 else " ", None) for i in range(90)] + [(300, "", "none"), (300, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, 0.9, 4.0, None, block_words=20).select("row.*", "epoch", "position").collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert sorted((r.doc_id, r.epoch, r.position) for r in got if r.source != "big") == sorted((i, 0, 0.0) for i, _, s in rows if s != "big")
    assert mixing.mix(docs.where("doc_id >= 100"), 0.9, 4.0, None).count() == 92
    assert mixing.mix(docs.where("doc_id >= 100"), 0.9, 4.0, 1.0).count() == 0


def test_exponent(spark):
    frame = spark.createDataFrame([("a", 600), ("b", 300), ("c", 100)], "source string, words long")
    p = np.array([0.6, 0.3, 0.1])

    def entropy(a):
        w = p ** a / (p ** a).sum()
        return -(w * np.log(w)).sum() / np.log(3)
    a = mixing.exponent(frame, 0.95, None, 1.0)
    assert entropy(a) == pytest.approx(0.95, abs=1e-5)
    assert mixing.exponent(frame, 0.5, None, 1.0) == 1.0 and mixing.exponent(frame, 1.0, None, 1.0) == 0.0
    b = mixing.exponent(frame, None, 2.0, 1.0)
    assert (p ** b / (p ** b).sum() / p).max() == pytest.approx(2.0, abs=1e-4)


def test_mixture_of_nothing(spark):
    docs = skewed(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).count() == 0


def test_skewed_mixture_has_its_twin(spark, tmp_path):
    skewed(spark, 4000).select("doc_id", "text", "source").where("doc_id is not null").distinct().write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    message, _ = check(spark, con, str(tmp_path), "op7_source_mixing", queries.QUERIES["op7_source_mixing"], queries.ORACLES["op7_source_mixing"])
    assert message.startswith("ok"), message


# ------------------------------------------------------------------------------------------ conversations

def test_preference_pairs(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "hi"), turn("assistant", "yes"), turn("user", "more"), turn("assistant", "good")]
    b = [*a[:3], turn("assistant", "bad é🙂"), turn("user", "?")]
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = {r.pair_id: r for r in preference.format_pairs(spark.createDataFrame([(1, a, b), (2, a, a), (3, a, []), (4, a[:2], a)], schema)).collect()}
    assert rows[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n" and rows[1].prompt_turns == 3
    begin, end = map(int, rows[1].rejected_spans.split("-"))
    assert rows[1].rejected[begin:end] == "bad é🙂<|end|>\n" and rows[1].rejected.endswith("<|user|>\n?<|end|>\n")
    assert (rows[2].prompt_turns, rows[2].chosen, rows[2].rejected, rows[2].chosen_spans) == (4, "", "", "")
    assert (rows[3].prompt, rows[3].rejected, rows[3].rejected_spans) == ("", "", "") and rows[3].chosen_spans.count(",") == 1
    assert (rows[4].prompt_turns, rows[4].chosen) == (2, "")


def test_swapped_answers(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "late"), (2, 0, "user", None), (3, 0, None, "x"), (3, 1, "assistant", None), (3, 1, "assistant", None), (None, 0, "user", "lost"), (5, None, "assistant", "a5")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    got = {r.pair_id: ([(t.role, t.text) for t in r.chosen], [(t.role, t.text) for t in r.rejected]) for r in preference.swapped_answers(frame).collect()}
    assert got == {1: ([("user", "q1"), ("assistant", "a1")], [("user", "q1"), ("assistant", "")]), 3: ([("", "x"), ("assistant", "")], [("", "x"), ("assistant", "a5")]), 5: ([("assistant", "a5")], [("assistant", "a1")])}
    assert preference.format_pairs(preference.swapped_answers(frame.limit(0))).count() == 0


# ------------------------------------------------------------------------------------------ pipeline

def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    group = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: g for n, g in group.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        path = corpus_pipeline.shared.fresh_path(spark, name)
        after.write.parquet(path)
        before = spark.read.parquet(path)
    ids = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert ids.count() == before.count() >= before.select("doc_id").distinct().count() > 0.8 * docs.count()
    assert corpus_pipeline.run(spark, SF).count() == ids.count()
