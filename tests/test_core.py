"""Hand-computed results, invariants and edge cases of the core operators."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions.codec import decode_ints, decode_postings, encode_int, encode_postings
from sparkloom.functions.dates import date_after, date_prefix
from sparkloom.functions.text import lines, snippet, tokens
from sparkloom.operators import classify, graph, relational, retrieval, words
from sparkloom.plans import catalog
from sparkloom.sources import sinks, tables
from sparkloom.streaming import runs, trends, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def text_frame(spark, *rows):
    return frame(spark, [(r,) for r in rows], "line string")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_tokens(spark):
    got = text_frame(spark, "  Father's  (Day) -- 42 x9 ", "", None).select(tokens("line").alias("w")).collect()
    assert [r.w for r in got] == [["father's", "day", "x"], [], None]


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_tokens_in_one_pass(spark):
    """All word queries: no function of each word, which is not compiled; the words are those of stripping both ends."""
    texts = ["a1b'c-- (x) \u00e9a\u00e9b", "ab\u2028 cd1\u2029", "a\x0bb\x0cc\x1cd\u0085e f\u00a0g", "\u0130stanbul \u212a \U0001f600a\U0001f600b\U0001f600", "9" * 5000 + "a" + "9" * 5000, "..", " z"]
    df = text_frame(spark, *texts)
    old = F.filter(F.transform(F.split(F.lower("line"), r"\s+"), lambda w: F.regexp_replace(w, "^[^a-z]+|[^a-z]+$", "")), lambda w: w != "")
    assert all(r.a == r.b for r in df.select(tokens("line").alias("a"), old.alias("b")).collect())
    assert "lambda" not in plan(df.select(tokens("line").alias("a")))


def test_follow_count(spark):
    df = text_frame(spark, "perfect day", "a perfect perfect day", "perfect", "perfect night", None)
    assert rows(words.follow_count(df, "perfect")) == [("day", 2)]


def test_bigram_relfreq(spark):
    assert rows(words.bigram_relfreq(text_frame(spark, "a b a c", "z", ""))) == [("a", "*", 2.0), ("a", "b", 0.5), ("a", "c", 0.5), ("b", "*", 1.0), ("b", "a", 1.0)]


@pytest.mark.parametrize("threshold", [1, 2])
def test_pmi(spark, threshold):
    got = {(r.x, r.y): (r["count"], r.pmi) for r in words.pmi_pairs(text_frame(spark, "x y", "x y z", "z", ""), threshold).collect()}
    assert got[("x", "y")] == got[("y", "x")] and got[("x", "y")][0] == 2
    assert math.isclose(got[("x", "y")][1], math.log10(2))
    assert (("x", "z") in got) == (threshold == 1)


def test_pmi_in_batches(spark, monkeypatch):
    """p4, jn7, jn11, agg9: pairs are counted as numbers, a few at a time, before they are shuffled; rare words and repeats make none."""
    import collections
    import itertools
    import random

    r = random.Random(2)
    text = [" ".join(r.choices([f"w{a}" for a in "abcdefghijkl"] + ["rare" + x for x in "abcdefghijklmnop"], [9] * 12 + [1] * 16, k=r.randint(0, 9))) for _ in range(300)]
    want = collections.Counter(p for t in text for p in itertools.permutations(sorted(set(t.split()[:6])), 2))
    monkeypatch.setattr(words, "PAIRS", 16, raising=False)
    out = words.pmi_pairs(text_frame(spark, *text).repartition(2), 5, max_tokens=6)
    assert {(x.x, x.y): x["count"] for x in out.collect()} == {p: n for p, n in want.items() if n >= 5}
    assert "collect_list" not in plan(out) and "MapInArrow" in plan(out)


def test_first_words_without_pairs(spark):
    """agg7: the '*' rows alone, without the table of pairs."""
    df = text_frame(spark, "a b a c", "z", "b c", "")
    assert rows(words.first_count(df), "left", "n") == [("a", 2), ("b", 2)]
    assert plan(words.first_count(df)).count("Aggregate") == 1


def test_pmi_of_nothing(spark):
    assert words.pmi_pairs(text_frame(spark), 2).count() == 0


def index(spark):
    docs = frame(spark, [(1, "a b"), (2, "b c"), (5, "a a c")], "doc_id bigint, text string")
    return docs, retrieval.build_index(docs)


def test_index(spark):
    _, idx = index(spark)
    got = {r.term: (r.df, [tuple(p) for p in r.postings]) for r in idx.collect()}
    assert got["a"] == (2, [(1, 1, 1), (5, 4, 2)])
    coded = {r.term: decode_postings(bytes(r.data)) for r in retrieval.encode_index(idx).collect()}
    assert coded["a"] == ([1, 5], [1, 2])


def test_index_reads_texts_once(spark):
    """p5, agg11, p6, src11: df comes from the blocks, not from a second pass over the texts."""
    docs, idx = index(spark)
    assert plan(idx).count("Generate explode") == 1
    some = retrieval.build_index(docs, block_docs=2)
    assert rows(some.where("term = 'a'").select("block", "df", "postings.gap")) == [(0, 2, [1]), (2, 2, [5])]


def test_lists_are_coded_by_block(spark):
    """fn12, fn12_bytes: the arrays of a list are made once, not for each of its elements, and blocks of ids follow each other."""
    from sparkloom.functions.codec import encoded

    docs = frame(spark, [(i, "a " * (i % 5) + "b") for i in range(1, 900, 7)], "doc_id bigint, text string")
    out = sorted((r.block, r.before, bytes(r.data)) for r in retrieval.coded_postings(docs, ["a"], block_docs=100).collect())
    ids = [i for i in range(1, 900, 7) if i % 5]
    assert len(out) == 9 and [x[1] for x in out[:2]] == [0, max(i for i in ids if i < 100)]
    assert decode_postings(b"".join(x[2] for x in out)) == (ids, [i % 5 for i in ids])
    long = spark.createDataFrame([([(i, 1) for i in range(3)],)], "p array<struct<doc_id: bigint, tf: bigint>>").select(F.col("p.doc_id").alias("ids"), F.col("p.tf").alias("counts"))
    assert plan(long.select(encoded("ids", "counts").alias("data"))).count(".doc_id") <= 1


def test_sorted_postings_are_dealt_by_range(spark, sf_dir):
    """srt5: the rows of a frequent term are dealt too, and their number of tasks is not fixed."""
    df = catalog.ALL["srt5"][0](spark, sf_dir)
    assert "RepartitionByExpression [term" in plan(df) and "ASC NULLS FIRST], 4" not in plan(df)
    got = [(r.term, r.doc_id) for r in df.collect()]
    assert got == sorted(got)


@pytest.mark.parametrize(("query", "ids"), [("a c AND", {5}), ("a b OR c AND", {2, 5}), ("zzz a OR", {1, 5}), ("zzz a AND", set()), ("a", {1, 5})])
def test_boolean(spark, query, ids):
    docs, idx = index(spark)
    assert {r.doc_id for r in retrieval.boolean_query(idx, docs, query).collect()} == ids


@pytest.mark.parametrize("query", ["a b", "AND", "a AND", ""])
def test_malformed_query(query):
    with pytest.raises(ValueError):
        retrieval.parse_postfix(query)


def test_snippet(spark):
    got = [r.s for r in text_frame(spark, "x" * 81, "y" * 80).select(snippet("line").alias("s")).collect()]
    assert got == ["x" * 80 + "...", "y" * 80]


@given(st.integers(-(2**63), 2**63 - 1))
def test_int_codec(value):
    assert decode_ints(encode_int(value)) == [value]


@given(st.lists(st.integers(0, 10**12), unique=True).map(sorted))
def test_posting_codec(ids):
    counts = [i % 7 + 1 for i in ids]
    assert decode_postings(encode_postings(ids, counts)) == (ids, counts)


def adjacency(spark):
    return graph.edges_from_adjacency(text_frame(spark, "1 2 3", "2 3", "3 1", "4 99", "5"))


@pytest.mark.parametrize(
    ("source", "steps", "want"),
    [
        (1, 1, [0.15, 0.425, 0.425, 0, 0]),
        (1, 2, [0.51125, 0.06375, 0.425, 0, 0]),
        (1, 3, [0.51125, 0.217281, 0.271469, 0, 0]),
        (4, 2, [0, 0, 0, 1, 0]),
        (5, 6, [0, 0, 0, 0, 1]),
    ],
)
def test_pagerank(spark, source, steps, want):
    nodes, edges = adjacency(spark)
    got = rows(graph.personalized_pagerank(nodes, edges, [source], steps), "node", "rank")
    assert [round(r, 6) for _, r in got] == want
    assert math.isclose(sum(r for _, r in got), 1)


def test_graph_helpers(spark):
    nodes, edges = adjacency(spark)
    assert rows(graph.graph_stats(nodes, edges)) == [(5, 5, 4)]
    assert rows(graph.missing_targets(nodes, edges), "src", "dst") == [(4, 99)]
    assert {r.partition for r in graph.partition_graph(nodes, 3, 6).collect()} <= {0, 1, 2}
    assert graph.partition_graph(nodes, 3).count() == 5
    ranks = frame(spark, [(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.1)], "source bigint, node bigint, rank double")
    assert rows(graph.top_ppr(ranks, 2)) == [(1, 1, "0.50000", 1), (1, 2, "0.50000", 2)]


def samples(spark):
    return frame(spark, [(0, "spam", [1, 2]), (1, "ham", [2, 3]), (2, "spam", [1, 1]), (3, "ham", None)], "doc_id bigint, label string, features array<int>")


def test_sgd(spark):
    got = dict(rows(classify.train_sgd(samples(spark), "doc_id")))
    assert math.isclose(got[1], 0.0029980000, abs_tol=1e-9)
    assert math.isclose(got[2], -4.999999583e-7, abs_tol=1e-12)
    assert math.isclose(got[3], -0.00100049999958, abs_tol=1e-12)
    assert set(dict(rows(classify.train_sgd(samples(spark), "doc_id", shuffle_seed=3)))) == {1, 2, 3}


@pytest.mark.parametrize("seed", [None, 7])
def test_sgd_in_segments(spark, monkeypatch, seed):
    """c1, agg15, srt6: no task reads all samples; each segment goes on with the weights that the one before has left."""
    import random

    r = random.Random(5)
    df = frame(spark, [(i, r.choice(["spam", "ham"]), r.choices(range(40), k=r.randint(0, 12))) for i in range(200)], "doc_id bigint, label string, features array<int>")
    whole = dict(rows(classify.train_sgd(df, "doc_id", shuffle_seed=seed)))
    read = []
    monkeypatch.setattr(classify, "SEGMENT", 200, raising=False)
    monkeypatch.setattr(classify, "CHUNK", 7, raising=False)
    train = classify._train
    monkeypatch.setattr(classify, "_train", lambda delta: read.append(1) or train(delta))
    got = dict(rows(classify.train_sgd(df.repartition(3), "doc_id", shuffle_seed=seed)))
    assert got == whole and len(got) == 40 and len(read) >= 4


def test_models_in_one_pass(spark):
    """c3, c3_vote: the models of all thirds are one sum over the samples."""
    from sparkloom.plans.programs import fold_models

    df = frame(spark, [(0, "spam", [1, 1]), (1, "ham", [2]), (2, "spam", [1]), (3, "ham", [1])], "doc_id bigint, label string, features array<int>")
    assert rows(fold_models(df), "model", "feature", "weight") == [(0, 1, 0.001 - 0.0005 * 1 + 0.0005), (1, 2, -0.001), (2, 1, 0.001)] and "Union" not in plan(fold_models(df))


@pytest.mark.parametrize("name", ["c1", "agg15", "srt6"])
def test_training_sees_whole_texts(spark, tmp_path, name):
    text = " ".join(["plain"] * 60 + ["late"])
    frame(spark, [(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [(1, 1)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = dict(rows(catalog.ALL[name][0](spark, str(tmp_path))))
    assert math.isclose(got["late"], 0.001) and math.isclose(got["plain"], 0.06)


def test_classifier_and_ensemble(spark):
    one = frame(spark, [("d", "spam", [1])], "doc_id string, label string, features array<int>")
    models = frame(spark, [(0, 1, 0.4), (1, 1, -0.1), (2, 1, -0.1)], "model int, feature int, weight double")
    assert classify.apply_ensemble(one, models, "average").first().prediction == "spam"
    vote = classify.apply_ensemble(one, models, "vote").first()
    assert (vote.score, vote.prediction) == (-1.0, "ham")
    none = classify.apply_classifier(one, models.where("feature = 9")).first()
    assert (none.score, none.prediction) == (0.0, "ham")


def test_dates(spark):
    day = spark.sql("select timestamp_ntz'1996-01-05 00:00:00' as d")
    ok = lambda c: day.where(c).count() == 1
    assert ok(date_prefix("d", "1996")) and ok(date_prefix("d", "1996-01")) and ok(date_prefix("d", "1996-01-05")) and ok(date_prefix("d", "199"))
    assert not ok(date_prefix("d", "1996-02"))
    assert ok(date_after("d", "1996-01-04")) and ok(date_after("d", "1996-01")) and not ok(date_after("d", "1996-01-05")) and not ok(date_after("d", "1996-02"))


def test_date_filter_reaches_the_scan(spark, sf_dir):
    plan = relational.q6(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "1996-01")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan


def test_missing_lookups(spark):
    items = spark.sql("select 1L as l_orderkey, 7L as l_partkey, 7L as l_suppkey, timestamp_ntz'1996-01-01 00:00:00' as l_shipdate")
    orders = frame(spark, [(1, 1)], "o_orderkey bigint, o_custkey bigint")
    customer = frame(spark, [(1, 3)], "c_custkey bigint, c_nationkey int")
    nation = frame(spark, [(4, "N")], "n_nationkey int, n_name string")
    assert rows(relational.q4(items, orders, customer, nation, "1996")) == [(3, "", 1)]
    assert relational.q4(items, orders, customer.where("false"), nation, "1996").count() == 0
    part, supplier = frame(spark, [(7, "p")], "p_partkey bigint, p_name string"), frame(spark, [(8, "s")], "s_suppkey bigint, s_name string")
    assert relational.q3(items, part, supplier, "1996").count() == 0
    assert relational.q1(items.where("false"), "1996").first()[0] == 0


def test_regions(spark):
    boxes = {"goldman": (-74.0144, -74.013777, 40.7138356, 40.7152275), "citigroup": (-74.012083, -74.009867, 40.720053, 40.7217236)}
    lines_ = text_frame(spark, "yellow,,,,,,,,,,-74.0140,40.7145,", "green,,,,,,,,-74.0110,40.7210,,", "green,,,,,,,,-74.0000,40.7000,,", "yellow,x")
    got = tables.trips(lines_).select("kind", windows.region_of(F.col("x"), F.col("y"), boxes).alias("r")).collect()
    assert [r.r for r in got] == ["goldman", "citigroup", None, None]


def events(spark, counts):
    start = 1_700_000_400 - 1_700_000_400 % 600
    return frame(spark, [("k", start + 600 * i) for i, c in enumerate(counts) for _ in range(c)], "key string, s bigint").selectExpr("key", "timestamp_seconds(s) as ts")


def test_trends(spark):
    snap = windows.trend_snapshot(events(spark, [12, 5, 10, 0, 10]), "ts", "key")
    got = [(r.current, r.previous, r.time_text) for r in snap.orderBy("window_end").collect()]
    assert got == [(12, 0, "00600000"), (5, 12, "01200000"), (10, 5, "01800000"), (0, 10, "02400000"), (10, 0, "03000000")]
    alerts = windows.trend_alerts(snap).orderBy("window_end").collect()
    assert [r.current for r in alerts] == [12, 10, 10]
    assert alerts[1].message == "Number of arrivals to k has doubled from 5 to 10 at 1800000!"


def test_trend_stream(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    events(spark, [12, 5, 10, 0, 10, 1]).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("key string, ts timestamp").parquet(path)
    got = trends.run_available(trends.trending_stream(stream, "ts", "key", 10), "trend_test", checkpoint=str(tmp_path / "cp"))
    assert [(r.current, r.previous) for r in got.orderBy("window_end").collect()] == [(12, 0), (5, 12), (10, 5), (0, 10), (10, 0)]


def test_count_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    df = events(spark, [3, 0, 2])
    df.repartition(3).write.parquet(path)
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = trends.run_available(windows.event_count(stream, size="10 minutes"), "count_test", "complete")
    assert rows(got) == rows(windows.event_count(df, size="10 minutes"))


def test_stopped_stream_goes_on_where_it_ended(spark, tmp_path):
    """str12: batches that begin before the stop is noticed are neither an error nor lost to a restart."""
    folder = str(tmp_path / "events")
    for day in range(1, 9):
        frame(spark, [(f"2024-01-0{day} 10:00:00",)] * day, "ts string").select(F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    counts = windows.event_count(runs.file_stream(spark, folder, spark.read.parquet(folder).schema))
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda: sorted(r["count"] for r in runs.read_latest(spark, path, ["window_start", "key"], "count").collect())
    runs.run_some(counts, runs.latest_windows(path), checkpoint, 2, "update")
    assert run() == [1, 2]
    runs.run_batches(counts, runs.latest_windows(path), checkpoint, "update")
    assert run() == list(range(1, 9))


def test_tbl_equals_parquet(spark, tmp_path, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.selectExpr("concat_ws('|', n_nationkey, n_name, n_regionkey, 'no comment', '')").coalesce(1).write.text(str(tmp_path / "nation.tbl"))
    assert rows(tables.load_table(spark, str(tmp_path), "nation", "text").drop("n_comment")) == rows(nation)


def test_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("d1 spam 5 7\nd2 ham 5 5 9\n")
    got = [tuple(r) for r in tables.labelled_features(spark, str(tmp_path / "f.txt")).orderBy("doc_id").collect()]
    assert got == [("d1", "spam", [5, 7]), ("d2", "ham", [5, 5, 9])]
    weights = frame(spark, [(5, 0.5), (7, -1.0)], "feature int, weight double")
    sinks.write_tuples(weights, str(tmp_path / "m"))
    assert rows(tables.read_weights(spark, str(tmp_path / "m"), "m")) == [("m", 5, 0.5), ("m", 7, -1.0)]
    sinks.write_table(weights, str(tmp_path / "t"), ["feature"])
    sinks.write_table(weights, str(tmp_path / "t"), ["feature"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_text(weights, str(tmp_path / "x"))
    assert rows(spark.read.text(str(tmp_path / "x"))) == [("5\t0.5",), ("7\t-1.0",)]
    sinks.write_sorted(weights, str(tmp_path / "s"), "feature", 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.snapshots(str(tmp_path / "b"))(weights, 3)
    assert spark.read.parquet(str(tmp_path / "b/part-00000003")).count() == 2


def test_lines(spark):
    docs = frame(spark, [(1, "a\n\nb"), (2, None)], "doc_id bigint, text string")
    assert rows(lines(docs)) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b")]
