import pytest
from pyspark.sql import functions as F

from telespark.functions.attrs import AttrFilter, attr, flatten_attributes
from telespark.functions.timeaxis import HOUR, MINUTE, TimeRange
from telespark.operators import dbcalls as D
from telespark.operators import traces as T
from telespark.operators import tree as R

T0 = 1_700_000_000_000
SCHEMA = ("ms long, trace_id string, span_id string, parent_span_id string, span_name string, span_kind string, service_name string, "
          "duration_ns long, status_code string")


def spans(spark, rows):
    full = [(T0 + r[3], r[0], r[1], r[2], r[1], "Server", "svc", r[4] if len(r) > 4 else 1_000_000, r[5] if len(r) > 5 else "Unset") for r in rows]
    empty = "array<struct<timestamp:timestamp,name:string,attributes:map<string,string>>>"
    link = "array<struct<trace_id:string,span_id:string,trace_state:string,attributes:map<string,string>>>"
    return (spark.createDataFrame(full, SCHEMA).withColumn("timestamp", F.timestamp_millis("ms")).drop("ms").withColumns({
        "trace_state": F.lit(""), "status_message": F.lit(""), "scope_name": F.lit(""), "scope_version": F.lit(""),
        "resource_attributes": F.create_map(F.lit("k"), F.lit("v")), "span_attributes": F.create_map(F.lit("a.b"), F.lit("1")),
        "events": F.array().cast(empty), "links": F.array().cast(link)}))


def test_ids(spark):
    df = spark.createDataFrame([(" ABC ",), ("xyz",), ("",), ("f" * 33,)], "x string")
    assert [r[0] for r in df.select(T.normalize_trace_id(F.col("x"))).collect()] == ["abc".zfill(32), None, None, None]
    kinds = spark.createDataFrame([("server",), (" CLIENT ",), ("other",)], "x string")
    assert [r[0] for r in kinds.select(T.normalize_kind(F.col("x"))).collect()] == ["Server", "Client", None]


def test_filter_guards(spark):
    df = spans(spark, [("t", "a", "", 0)])
    for f in (T.SpanFilter(), T.SpanFilter(TimeRange(T0, T0 + 7 * HOUR)),
              T.SpanFilter(TimeRange(T0, T0 + HOUR), min_duration_ns=5, max_duration_ns=4),
              T.SpanFilter(TimeRange(T0, T0 + HOUR), dims={"nope": ("x",)})):
        with pytest.raises(ValueError):
            f.apply(df)
    assert T.SpanFilter(TimeRange(T0, T0 + 7 * HOUR), service="svc").apply(df).count() == 1
    assert T.SpanFilter(TimeRange(T0, T0 + HOUR), attrs=(AttrFilter.parse("a.b=1"), AttrFilter.parse("a.b"))).apply(df).count() == 1
    assert T.SpanFilter(TimeRange(T0, T0 + HOUR), attrs=(AttrFilter.parse("missing"),)).apply(df).count() == 0


def test_variant_attributes(spark):
    df = spark.sql("""select parse_json('{"a": {"b": {"c": 1}, "d": "x"}, "e": [1, {"f": 2}], "g": null}') as v""")
    m = df.select(flatten_attributes(df, "v")).head()[0]
    assert m["a.b.c"] == "1" and m["a.d"] == "x" and m["e"] == '[1,{"f":2}]'
    assert tuple(df.select(attr(df, "v", "a.b.c"), attr(df, "v", "no.such"), attr(df, "v", "a.d")).head()) == ("1", "", "x")
    odd = spark.sql("""select parse_json('{"http.route": "/x", "braces": "{no json", "json": "{\\\\"a\\\\": 1}", "none": {}, "a.b": 1, "a": {"b": 2, "c": {"d": true}}}') as v""")
    assert odd.select(flatten_attributes(odd, "v")).head()[0] == {"http.route": "/x", "braces": "{no json", "json": '{"a": 1}', "none": "{}", "a.b": "1", "a.c.d": "true"}
    assert tuple(odd.select(attr(odd, "v", "http.route"), attr(odd, "v", "a.b"), attr(odd, "v", "a.c.d")).head()) == ("/x", "1", "true")
    deep = spark.sql("select parse_json('" + '{"k":' * 20 + "1" + "}" * 20 + "') as v")
    assert deep.select(flatten_attributes(deep, "v")).head()[0] == {".".join("k" * 20): "1"}


def test_parameters_of_both_storages(spark):
    from telespark.functions.attrs import flatten_attributes as flat
    from telespark.operators.dbcalls import _params, params_in_order
    for value in ("map('db.query.parameter.1', 'b', 'db.query.parameter.0', 'a', 'x', '1')",
                  """parse_json('{"db": {"query": {"parameter": {"1": "b", "0": "a"}}}}')""", """parse_json('{"db.query.parameter.0": "a", "db.query.parameter.1": "b"}')"""):
        df = spark.sql(f"select {value} as span_attributes")
        assert df.select(params_in_order(_params(df))).head()[0] == ["a", "b"], value
    assert "x" in spark.sql("select map('x', '1') as span_attributes").select(flat(spark.sql("select map('x', '1') as span_attributes"), "span_attributes")).head()[0]


def test_drill_down_on_variants_and_without_a_service(spark):
    from telespark.functions.timeaxis import Bucket, TimeRange
    from telespark.operators import dashboards as D
    rng = TimeRange(0, 3_600_000)
    bucket = Bucket.choose(rng, "UTC", 60)
    rows = spark.sql("""select timestamp_millis(1000) as timestamp, 't' as trace_id, 's' as span_id, 'svc' as service_name, 'op' as span_name, 'Error' as status_code, 5000000 as duration_ns,
        parse_json('{"http.route": "/x", "http.response.status_code": 500}') as span_attributes""")
    points = spark.createDataFrame([(0, ["/x"], 2.0), (0, ["/y"], 1.0)], "bucket long, keys array<string>, v double").withColumn("bucket", bucket.first(rng) + F.col("bucket"))
    for service, found in ((None, 1), ("svc", 1), ("other", 0)):
        spikes = D.spikes_from_series(points, bucket, ("http.route",), service=service)
        assert D.drill_to_traces(rows, spikes, bucket).count() == found
        assert D.drill_to_errors(rows, spikes, bucket).count() == 2 * found
    logs = spark.sql("select timestamp_millis(1000) as timestamp, 'svc' as service_name, p as pod, 'm' as message from values ('a'), ('b') as t(p)")
    pods = D.spikes_from_series(points.withColumn("keys", F.array(F.lit("a"))), bucket, ("res:k8s.pod.name",), service="svc").limit(1)
    assert [r.pod for r in D.drill_to_logs(logs, pods, bucket).collect()] == ["a"]


def test_trace_without_a_moment(spark):
    now = 1_704_067_200_000
    df = spans(spark, [("near", f"n{i}", "", i * 60_000) for i in range(3)])
    at = df.agg(F.min(F.unix_millis("timestamp"))).head()[0]
    anchors = spark.createDataFrame([("near", None)], "trace_id string, at_ms long")
    w = T.trace_windows(df, anchors, 5_000, now_ms=at + 60_000).head()
    assert (w.before_ms, w.after_ms, w.truncated) == (900_000, 900_000, False)
    w = T.trace_windows(df, anchors, 5_000, now_ms=at + 3 * 3_600_000 * 24 + now * 0).head()
    assert w.before_ms > 10 ** 12
    known = T.trace_windows(df, spark.createDataFrame([("near", at)], "trace_id string, at_ms long"), 5_000)
    assert known.collect() == T.trace_windows(df, spark.createDataFrame([("near", at)], "trace_id string, at_ms long"), 5_000, now_ms=at).collect()


def test_summary_falls_back_to_the_first_span(spark):
    df = spans(spark, [("t", "b", "x", 5, 9_000_000), ("t", "c", "b", 7, 1_000_000, "Error"), ("t", "c", "b", 7, 1_000_000, "Error"),
                       ("u", "r", "", 0, 4_000_000)])
    rows = {r.trace_id: r for r in T.trace_summaries(df).collect()}
    assert (rows["t"].root_missing, rows["t"].root_name, rows["t"].duration_ns, rows["t"].span_count, rows["t"].error_count) == (True, "b", 9_000_000, 2, 1)
    assert rows["t"].span_ns == 9_000_000 and not rows["u"].root_missing


def tree(spark, rows):
    return {(r.trace_id, r.span_id): r for r in R.span_tree(spans(spark, rows)).collect()}


def test_tree_shapes(spark):
    chain = [("deep", f"{i:04d}", f"{i - 1:04d}" if i else "", i) for i in range(70)]
    got = tree(spark, chain + [("t", "r", "", 0), ("t", "b", "r", 2), ("t", "a", "r", 1), ("t", "o", "gone", 3), ("t", "self", "self", 4),
                               ("loop", "x", "y", 0), ("loop", "y", "x", 1), ("loop", "z", "y", 2)])
    assert [got["deep", f"{i:04d}"].depth for i in range(70)] == list(range(70))
    assert (got["t", "a"].pos_in_set, got["t", "b"].pos_in_set, got["t", "a"].set_size) == (1, 2, 2)
    assert got["t", "o"].orphan and got["t", "o"].is_root and got["t", "self"].is_root and got["t", "r"].set_size == 3
    assert {got["loop", s].depth for s in "xyz"} == {0} and got["loop", "x"].cyclic
    assert got["loop", "x"].root_missing and not got["t", "r"].root_missing


def test_root_cause_and_window(spark):
    df = spans(spark, [("t", "r", "", 0, 100_000_000, "Error"), ("t", "a", "r", 10, 10_000_000, "Error"), ("t", "b", "a", 12, 1_000_000, "Error"),
                       ("t", "c", "r", 20, 200_000_000), ("t", "late", "r", 150, 5_000_000), ("t", "under", "late", 90, 900_000_000)])
    assert R.root_cause_span(R.span_tree(df)).head().span_id == "b"
    w = R.root_window(df).head()
    # "under" starts early but hangs on a span that does not belong
    assert (w.start_us, w.end_us) == (T0 * 1000, (T0 + 220) * 1000.0)


def test_worst_spans_survive(spark):
    df = spans(spark, [("t", f"s{i}", "", i, i * 1000, "Error" if i in (0, 1) else "Unset") for i in range(10)])
    assert {r.span_id for r in R.keep_errors_and_slowest(df, 4).collect()} == {"s0", "s1", "s8", "s9"}
    assert {r.span_id for r in R.keep_errors_and_slowest(df, 1).collect()} == {"s0", "s1"}
    assert R.keep_errors_and_slowest(df, 50).count() == 10


@pytest.mark.parametrize("offsets,cap,want", [
    ([0, 5], 10, (MINUTE, MINUTE, False, False)),                             # clear of both edges
    ([0, 10 * MINUTE], 10, (MINUTE, MINUTE, False, False)),                   # a far span without one near the edge is not looked for
    ([0, 55_000, 10 * MINUTE], 10, (15 * MINUTE, 15 * MINUTE, False, False)), # one near the edge asks for more
    ([2 * HOUR, 5 * HOUR], 10, (HOUR, 24 * HOUR, False, False)),
    ([0, 55_000, 14 * MINUTE, 40 * HOUR], 10, (T.EVER, T.EVER, False, False)),
    (list(range(20)), 10, (MINUTE, MINUTE, True, False)),                     # the narrowest is too full already
    ([0] + [50_000 + i for i in range(4)] + [MINUTE * 14 + i for i in range(20)], 10, (MINUTE, 5 * MINUTE, True, True)),
    ([-10 * MINUTE + i for i in range(20)] + [55_000, 56_000], 10, (MINUTE, 5 * MINUTE, True, True)),
])
def test_window_choice(spark, offsets, cap, want):
    df = spans(spark, [("t", f"s{i:03d}", "", o) for i, o in enumerate(offsets)])
    anchor = spark.createDataFrame([("t", T0)], "trace_id string, at_ms long")
    r = T.trace_windows(df, anchor, cap).head()
    assert (r.before_ms, r.after_ms, r.truncated, r.narrowed) == want
    shown = T.clip_traces(df, T.trace_windows(df, anchor, cap), cap)
    assert shown.count() <= cap
    pinned = T.pin_spans(shown, df, df.where(f"span_id = 's{len(offsets) - 1:03d}'").select("trace_id", "span_id"))
    assert f"s{len(offsets) - 1:03d}" in {x.span_id for x in pinned.collect()}


def test_heatmap_floor(spark):
    df = spans(spark, [("t", "a", "", 0, 0), ("t", "b", "", 0, 500), ("t", "c", "", 0, 1_000_000), ("t", "d", "", 0, 10_000_000)])
    cells = T.latency_heatmap(df, T.SpanFilter(TimeRange(T0, T0 + HOUR)))
    assert sorted((r.lvl, r["count"]) for r in cells.collect()) == [(-12, 2), (0, 1), (4, 1)]


@pytest.mark.parametrize("sql,params,want", [
    ("select ? , '?' from t where a = ?", '{"1":"b\'c","0":"1"}', "select '1' , '?' from t where a = 'b''c'"),
    ("a = ?", '{"0":"x","1":"y"}', None), ("a = ? and ?", '{"0":"x"}', None), ("no marks", "{}", "no marks"),
    ("`a?` = ? -- \\", '{"0":null}', "`a?` = 'NULL' -- \\"), ("? ? ?", '{"10":"k","2":"c","0":"a"}', "'a' 'c' 'k'"),
])
def test_fill_statement(spark, sql, params, want):
    df = spark.createDataFrame([(sql, params)], "statement string, params string")
    assert D.fill_statements(df).head().filled == want


def test_fill_statement_for_display(spark):
    df = spark.createDataFrame([("select ? /* ? */ , ? -- ?\n where x in (?, ?)", '{"0":"12","1":"007","2":"-1.5"}')], "statement string, params string")
    assert D.fill_statements(df, display=True).head().filled == "select 12 /* ? */ , '007' -- ?\n where x in (-1.5, ?)"


def test_match_source(spark):
    calls = spark.createDataFrame([("mysql", "10.0.0.1", "3306", "shop", "api"), ("mysql", "10.0.0.1", "3307", "", "other"),
                                   ("redis", "10.0.0.1", "", "shop", "api"), ("mariadb", "ALIAS", "", "", "")],
                                  "db_system string, db_server string, db_port string, db_name string, service_name string")
    sources = [D.Source("one", "mysql", "10.0.0.1", 3306, "shop"), D.Source("two", "mysql", "10.0.0.1", 3306, "shop", services=("api",)),
               D.Source("three", "mysql", "h", aliases=("alias:3306",))]
    got = [(r.source, r.source_score) for r in D.match_source(calls, sources).collect()]
    assert got == [("two", 7), (None, 0), (None, 0), ("three", 4)]


def test_digest(spark):
    df = spark.createDataFrame([("select 1 from t where a in (1, 2,3)", 5, False, 1, 1), ("SELECT  x", 1, True, 2, 2),
                                ("select 2 from t where a in ('x','y')", 7, False, 1, 3)],
                               "statement string, duration_ms long, error boolean, rows long, ts_ms long")
    top = D.statement_digest(df).head()
    assert (top.digest, top.calls, top.total_ms, top.max_ms, top.last_seen_ms) == ("select ? from t where a in (?, ...)", 2, 12, 7, 3)


@pytest.mark.parametrize("statement, digest", [
    ("select * from t where (a, b) in ((1,2), (3, 4) ,(5,6))", "select * from t where (a, b) in ((?, ...), ...)"),
    ("insert into t2 (a1) values (1), ( 'x' ),(3)", "insert into t2 (a1) values (?), ..."),
    ("select 'it''s', \"a 'b' (?, ?) 1\", `c 2` from t -- 'quote 1\nwhere x = 1.5e3", "select ?, \"a 'b' (?, ?) 1\", `c 2` from t where x = ?"),
    ("select /* 'one' */ a/**/ , -- two\n 'b -- no /* comment' from t_1 where n=$1 and h = 0xFF and .5 < d", "select a , ? from t_1 where n=? and h = ? and ? < d"),
    ("select 'a\\'b', 'c'", "select ?, ?"), ("select 'never closed", "select ?"), ("  ", ""), ("f(1)", "f(?)"), ("f( 1 ,2)", "f(?, ...)"), ("größe1 = 3", "größe1 = ?"),
])
def test_statements_are_evened_out(spark, statement, digest):
    assert spark.createDataFrame([(statement,)], "s string").select(D.normalize_statement(F.col("s"))).head()[0] == digest


def test_all_spans_by_default(spark):
    df = spans(spark, [("t", f"s{i:04d}", "", i) for i in range(5_200)])
    anchor = spark.createDataFrame([("t", T0)], "trace_id string, at_ms long")
    assert [(r.n, r.cut) for r in T.trace_spans(df, "t").groupBy(F.col("truncated").alias("cut")).agg(F.count("*").alias("n")).collect()] == [(5_200, False)]
    window = T.trace_windows(df, anchor)
    assert not window.head().truncated and T.clip_traces(df, window).count() == 5_200


def test_large_traces_get_the_same_shape(spark):
    """Traces within a task and traces across tasks: chains, cycles, lost parents, many siblings."""
    ms = lambda k: F.timestamp_millis(F.lit(1_700_000_000_000) + k)
    chain = spark.range(70).select(F.lit("chain").alias("trace_id"), F.col("id").cast("string").alias("span_id"),
                                   F.when(F.col("id") == 0, "").otherwise((F.col("id") - 1).cast("string")).alias("parent_span_id"), ms(F.col("id")).alias("timestamp"))
    star = spark.range(500).select(F.lit("star"), F.col("id").cast("string"), F.when(F.col("id") == 0, "").when(F.col("id") % 3 == 0, "lost").otherwise("0"), ms(F.col("id") % 5))
    ring = spark.range(9).select(F.lit("ring"), F.col("id").cast("string"), F.when(F.col("id") < 6, ((F.col("id") + 1) % 6).cast("string")).otherwise("0"), ms(F.col("id")))
    own = spark.range(3).select(F.lit("own"), F.col("id").cast("string"), F.col("id").cast("string"), ms(F.col("id")))
    df = chain.union(star).union(ring).union(own)
    columns = ["trace_id", "span_id", "parent", "depth", "cyclic", "is_root", "orphan", "root_missing", "pos_in_set", "set_size"]
    rows = [sorted(map(tuple, R.span_tree(df, large).select(columns).collect()), key=str) for large in (1_000_000, 50, 0)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 582
    by = {r[:2]: dict(zip(columns, r)) for r in rows[0]}
    assert by["chain", "69"]["depth"] == 69 and by["ring", "8"]["cyclic"] and by["ring", "8"]["depth"] == 0 and by["own", "1"]["orphan"]
    assert by["star", "1"]["set_size"] == 333 - 0 and by["star", "3"]["orphan"] and not by["star", "3"]["root_missing"] and by["own", "1"]["root_missing"]


def test_rounds_of_the_span_tree_stay_within_buckets(spark):
    ids = spark.range(3000).select((F.col("id") % 40).cast("string").alias("trace_id"), F.col("id").cast("string").alias("span_id"),
                                   F.when(F.col("id") < 40, "").otherwise((F.col("id") - 40).cast("string")).alias("parent_span_id"), F.timestamp_millis("id").alias("timestamp"))
    with R._by_trace(spark):
        table = R._bucketed(ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "trace_id"))
        up = table.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("timestamp").alias("up"))
        joined = table.hint("merge").join(up, ["trace_id", "parent_span_id"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2960
