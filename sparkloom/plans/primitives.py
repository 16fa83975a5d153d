
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.codec import decoded_ids
from sparkloom.functions.dates import date_after, date_prefix, day, month
from sparkloom.functions.text import snippet, tokens
from sparkloom.operators import classify, graph, relational, retrieval, words
from sparkloom.plans.lineage import cut_lineage, own_path
from sparkloom.plans.programs import (
    BASE, BIGRAMS, BOXES, CELLS, DATE, EDGES, LINES, MONTH, NATIONS, SAMPLES, TF, TOKENIZED, TOKENS,
    _boxed, _lines, _rounded, _t, _time, event_graph, p9, samples, sgd_sql, stored_index,
)
from sparkloom.sources import sinks, tables
from sparkloom.sources.streams import text_stream
from sparkloom.sources.tables import load_table
from sparkloom.streaming import runs, trends, windows


def _docs(s, d):
    return load_table(s, d, "documents")


def _events(s, d):
    return load_table(s, d, "events")


def _item(s, d):
    return load_table(s, d, "lineitem")


def _unigrams(s, d):
    return _lines(s, d).select(F.explode(F.array_distinct(F.slice(tokens("line"), 1, 40))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


_UNI = f"{TOKENIZED}, t AS (SELECT DISTINCT doc_id, line_no, unnest(list_slice(w, 1, 40)) AS word FROM toks), u AS (SELECT word, count(*) AS c FROM t GROUP BY word)"


#: Days of the month at which the replayed events are cut into files.
_CUTS = [1, 7, 13, 19, 32]


def _replayed(s: SparkSession, d: str, days: list[int] = _CUTS) -> tuple[str, DataFrame]:
    """A folder with the events as files in the order of time, and the stream over it, one file a batch."""
    folder = own_path(s, "events")
    runs.replay(_events(s, d), "ts", folder, days)
    return folder, runs.file_stream(s, folder, _events(s, d).schema)


def _stream_counts(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the events as a stream of four batches; complete mode gives the batch result."""
    out = trends.run_available(windows.event_count(_replayed(s, d)[1]), "event_counts", "complete")
    return _time(out, "window_start")


def _stream_regions(s: SparkSession, d: str) -> DataFrame:
    stream = _replayed(s, d)[1].withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    out = trends.run_available(windows.region_event_count(stream, "ts", "value", "k", BOXES), "region_counts", "complete")
    return _time(out, "window_start")


def _stream_trends(s: SparkSession, d: str) -> DataFrame:
    """State by key over four batches; each batch writes a folder."""
    path, stream = own_path(s, "trends"), _replayed(s, d)[1]
    runs.run_batches(trends.trending_stream(stream, "ts", "event_type", 60), sinks.snapshots(path), own_path(s, "checkpoint"))
    return _time(s.read.parquet(f"{path}/part-*"), "window_end")


def _restarted_counts(s: SparkSession, d: str) -> DataFrame:
    """Half of the files come and the stream ends; the others come and it goes on from its checkpoint."""
    path, checkpoint = own_path(s, "windows"), own_path(s, "checkpoint")
    folder, stream = _replayed(s, d, _CUTS[:3])
    for cuts in ([], _CUTS[2:]):
        runs.replay(_events(s, d), "ts", folder, cuts)
        runs.run_batches(windows.event_count(stream), runs.latest_windows(path), checkpoint, "update")
    return _time(runs.read_latest(s, path, ["window_start", "key"], "count"), "window_start")


def _counted_batches(s: SparkSession, d: str) -> DataFrame:
    counter = runs.Counter()
    runs.run_batches(_replayed(s, d)[1], counter, own_path(s, "checkpoint"))
    return s.createDataFrame([(counter.batches, counter.rows)], "batches long, events long")


def _stopped(s: SparkSession, d: str) -> DataFrame:
    """The windows that two batches have written when the stream is stopped."""
    path = own_path(s, "windows")
    runs.run_some(windows.event_count(_replayed(s, d)[1]), runs.latest_windows(path), own_path(s, "checkpoint"), 2, "update")
    return _time(runs.read_latest(s, path, ["window_start", "key"], "count"), "window_start")


def _persisted(s: SparkSession, d: str) -> DataFrame:
    """Each batch is kept while it is counted and written."""
    path = own_path(s, "batches")
    runs.run_batches(_replayed(s, d)[1], runs.Counter(sinks.snapshots(path)), own_path(s, "checkpoint"))
    return s.read.parquet(f"{path}/part-*").groupBy("event_type").agg(F.count("*").alias("count"))


def _back(s: SparkSession, name: str, write, read):
    path = own_path(s, name)
    write(path)
    return read(path)


def _coded(s: SparkSession, d: str) -> DataFrame:
    return retrieval.coded_postings(_docs(s, d), ["the", "and", "la"])


def _tbl(s: SparkSession, d: str) -> str:
    """A folder with nation as delimited text."""
    folder = own_path(s, "tbl")
    load_table(s, d, "nation").selectExpr("concat_ws('|', n_nationkey, n_name, n_regionkey, 'none', '')").write.text(f"{folder}/nation.tbl")
    return folder


def _trips(s: SparkSession, d: str) -> DataFrame:
    """The events as ragged lines of trips: yellow ones have the place in fields 10 and 11, others in 8 and 9."""
    k = "get_json_object(props, '$.k')"
    line = f"concat(IF(event_id % 2 = 0, 'yellow,,,', 'green,'), ',,,,,,,', value, ',', {k}, ',')"
    return _back(s, "trips", lambda p: _events(s, d).selectExpr(line).write.text(p), lambda p: tables.text_lines(s, p))


def _features_file(s: SparkSession, d: str) -> DataFrame:
    line = "concat_ws(' ', o_orderkey, o_orderstatus, o_custkey, o_custkey % 10)"
    return _back(s, "features", lambda p: load_table(s, d, "orders").selectExpr(line).write.text(p), lambda p: tables.labelled_features(s, p))


def _weights(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "part").select(F.col("p_partkey").cast("int").alias("feature"), F.col("p_retailprice").alias("weight"))


def _adjacency(s: SparkSession, d: str) -> DataFrame:
    edges = event_graph(s, d)[1]
    lines = edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("n")).select(F.concat_ws(" ", "src", "n"))
    return _back(s, "graph", lambda p: lines.write.text(p), lambda p: graph.edges_from_adjacency(tables.adjacency(s, p))[1])


def _returned(s: SparkSession, d: str) -> DataFrame:
    """Edges from suppliers to the parts that came back."""
    return _item(s, d).where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def _bucketed(s: SparkSession, d: str) -> DataFrame:
    """Edges stored in buckets by their start; two reads of them meet without a shuffle."""
    name = "edges_" + uuid.uuid4().hex
    graph.store_edges(event_graph(s, d)[1], name, 4)
    try:
        one, two = s.table(name), s.table(name)
        return cut_lineage(one.join(two.groupBy("src").agg(F.count("*").alias("degree")), "src").select("src", "dst", "degree"))
    finally:
        s.sql(f"DROP TABLE {name}")


def _sliding(s, d):
    return _time(windows.event_count(_events(s, d), size="60 minutes", slide="30 minutes"), "window_start")


def _dense_regions(s, d):
    counts = windows.region_event_count(_boxed(s, d), "ts", "value", "k", BOXES)
    return _time(windows.densify(counts, "region", "60 minutes"), "window_start")


_BOXED = """box AS (SELECT ts, CASE WHEN value BETWEEN 10 AND 40 AND k BETWEEN 20 AND 60 THEN 'a' WHEN value BETWEEN 35 AND 80 AND k BETWEEN 50 AND 90 THEN 'b' END AS region
FROM (SELECT ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""
_H = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_HOURLY = f"SELECT {_H.format('time_bucket(INTERVAL 60 MINUTES, ts)')} AS window_start, 'all' AS key, count(*) AS count FROM events GROUP BY ALL"
_DISC = "l_extendedprice * (1 - l_discount)"
#: The bytes of a non-negative integer below 2**24, as hexadecimal digits.
_VINT = "CASE WHEN {0} < 128 THEN printf('%02X', {0}) WHEN {0} < 256 THEN '8F' || printf('%02X', {0}) WHEN {0} < 65536 THEN '8E' || printf('%04X', {0}) ELSE '8D' || printf('%06X', {0}) END"
_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_PLACES = "SELECT event_id % 2 = 0 AS yellow, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events"
_WEIGHTS = "CAST(p_partkey AS INTEGER) AS feature, p_retailprice AS weight FROM part"

_CLOSED = f"""WITH {CELLS} SELECT strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, key, current, previous
FROM trend JOIN (SELECT key, max(h) AS last FROM c0 GROUP BY key) USING (key) WHERE h < last"""

PRIMITIVES = {
    # sources
    "src1": (lambda s, d: _lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line"), f"WITH {LINES} SELECT doc_id, line_no, line FROM lines"),
    "src3": (lambda s, d: load_table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders"),
    "src10": (
        lambda s, d: words.word_count(_lines(s, d)).join(_unigrams(s, d), "word").select("word", "count", "c"),
        f"WITH {_UNI}, n AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM toks) GROUP BY word) SELECT word, count, c FROM n JOIN u USING (word)",
    ),
    "src11": (
        lambda s, d: stored_index(s, d, ["the", "la"]).groupBy("term").agg(F.max("df").alias("df")),
        f"WITH {TF} SELECT term, count(*) AS df FROM tf WHERE term IN ('the', 'la') GROUP BY term",
    ),
    "src12": (
        lambda s, d: _docs(s, d).select("doc_id", snippet("text").alias("snippet")),
        "SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS snippet FROM documents",
    ),
    "src13": (_stream_counts, _HOURLY),
    "src2": (lambda s, d: load_table(s, _tbl(s, d), "nation", "text").select("n_nationkey", "n_name", "n_regionkey"), _NATION),
    "src4": (
        lambda s, d: load_table(s, d, "nation").unionByName(load_table(s, _tbl(s, d), "nation", "text").drop("n_comment")),
        f"{_NATION} UNION ALL {_NATION}",
    ),
    "src5": (lambda s, d: tables.trips(_trips(s, d)).select((F.col("kind") == "yellow").alias("yellow"), "x", "y"), _PLACES),
    "src6": (
        lambda s, d: _features_file(s, d).select("doc_id", "label", F.array_join("features", ",").alias("features")),
        "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS label, o_custkey || ',' || o_custkey % 10 AS features FROM orders",
    ),
    "src7": (
        lambda s, d: _back(s, "model", lambda p: sinks.write_tuples(_weights(s, d), p), lambda p: tables.read_weights(s, p, "m")),
        f"SELECT 'm' AS model, {_WEIGHTS}",
    ),
    "src8": (_adjacency, f"WITH {EDGES} SELECT src, dst FROM edges"),
    "src9": (_bucketed, f"WITH {EDGES} SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM edges"),
    "src14": (
        lambda s, d: trends.run_available(tables.trips(text_stream(s, _back(s, "trips", lambda p: _trips(s, d).write.text(p), str))).groupBy("kind").agg(F.count("*").alias("count")), "trip_counts", "complete"),
        "SELECT CASE WHEN event_id % 2 = 0 THEN 'yellow' ELSE 'green' END AS kind, count(*) AS count FROM events GROUP BY 1",
    ),
    "prj5": (
        lambda s, d: tables.trips(_trips(s, d)).select(F.col("kind"), F.round(F.col("x") + F.col("y"), 6).alias("xy")),
        f"SELECT CASE WHEN yellow THEN 'yellow' ELSE 'green' END AS kind, round(x + y, 6) AS xy FROM ({_PLACES})",
    ),
    # sinks, read back
    "snk1": (
        lambda s, d: _back(s, "text", lambda p: sinks.write_text(load_table(s, d, "region"), p), lambda p: s.read.text(p)),
        "SELECT r_regionkey || chr(9) || r_name AS value FROM region",
    ),
    "snk2": (lambda s, d: _back(s, "table", lambda p: sinks.write_table(load_table(s, d, "nation"), p, ["n_regionkey"]), lambda p: s.read.parquet(p)), _NATION),
    "snk3": (
        lambda s, d: _back(s, "sorted", lambda p: sinks.write_sorted(_weights(s, d), p, "feature", 4), lambda p: s.read.parquet(p)),
        f"SELECT {_WEIGHTS}",
    ),
    "snk4": (
        lambda s, d: _back(s, "tuples", lambda p: sinks.write_tuples(_weights(s, d).select("feature"), p), lambda p: s.read.text(p)),
        "SELECT '(' || p_partkey || ')' AS value FROM part",
    ),
    "snk5": (_restarted_counts, _HOURLY),
    "snk6": (_stream_trends, _CLOSED),
    "snk8": (
        lambda s, d: _back(s, "twice", lambda p: [sinks.write_table(load_table(s, d, t), p) for t in ("region", "nation")], lambda p: s.read.parquet(p)),
        _NATION,
    ),
    # sinks that are relations here
    "snk9": (
        lambda s, d: _rounded(p9(s, d).groupBy("source").agg(F.sum("rank").alias("mass")), mass=6),
        f"SELECT source, round(sum(rank), 6) AS mass FROM ({BASE['p9'][1].replace('round(p, 6)', 'p')}) GROUP BY source",
    ),
    "snk10": (lambda s, d: BASE["p11"][0](s, d).select("source", "rn", "node"), f"SELECT source, rn, node FROM ({BASE['p11'][1]})"),
    # projections and filters
    "prj1": (lambda s, d: load_table(s, d, "part").select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part"),
    "prj2": (
        lambda s, d: _item(s, d).select("l_orderkey", F.round(relational.disc_price(), 6).alias("disc_price"), F.round(relational.disc_price() * (1 + F.col("l_tax")), 6).alias("charge")),
        f"SELECT l_orderkey, round({_DISC}, 6) AS disc_price, round({_DISC} * (1 + l_tax), 6) AS charge FROM lineitem",
    ),
    "prj3": (
        lambda s, d: load_table(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.concat_ws(",", "c_custkey", "c_name").alias("value")),
        "SELECT c_nationkey AS key, c_custkey || ',' || c_name AS value FROM customer",
    ),
    "prj4": (
        lambda s, d: _docs(s, d).select("doc_id", F.posexplode(tokens("text")).alias("pos", "word")).select("doc_id", F.col("pos").cast("long").alias("pos"), "word"),
        f"WITH a AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents) SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM a",
    ),
    "flt1": (
        lambda s, d: _item(s, d).where(date_prefix("l_shipdate", MONTH)).select("l_orderkey", day("l_shipdate").alias("shipdate")),
        f"SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS shipdate FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') LIKE '{MONTH}%'",
    ),
    "flt2": (
        lambda s, d: _item(s, d).where(date_after("l_shipdate", DATE)).agg(F.count("*").alias("count")),
        f"SELECT count(*) AS count FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') > '{DATE}'",
    ),
    "flt3": (
        lambda s, d: load_table(s, d, "nation").where(F.col("n_name").isin(NATIONS)).select("n_nationkey", "n_name"),
        f"SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('{NATIONS[0]}', '{NATIONS[1]}')",
    ),
    "flt4": (
        lambda s, d: load_table(s, d, "orders").join(load_table(s, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"),
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
    ),
    "flt5": (
        lambda s, d: words.word_count(_lines(s, d)).where("count <> 1"),
        f"WITH {TOKENIZED} SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM toks) GROUP BY word HAVING count(*) <> 1",
    ),
    "flt6": (
        lambda s, d: _boxed(s, d).select("event_id", windows.region_of(F.col("value"), F.col("k"), BOXES).alias("region")).where("region is not null"),
        f"WITH {_BOXED.replace('SELECT ts,', 'SELECT event_id,', 1).replace('SELECT ts, value', 'SELECT event_id, value')} SELECT event_id, region FROM box WHERE region IS NOT NULL",
    ),
    "flt7": (
        lambda s, d: _lines(s, d).where(F.size(tokens("line")) >= 2).agg(F.count("*").alias("count")),
        f"WITH {TOKENIZED} SELECT count(*) AS count FROM toks WHERE len(w) >= 2",
    ),
    "flt8": (
        lambda s, d: _lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join(F.slice(tokens("line"), 1, 40), " ").alias("words")),
        f"WITH {TOKENIZED} SELECT doc_id, line_no, array_to_string(list_slice(w, 1, 40), ' ') AS words FROM toks",
    ),
    # joins
    "jn1": (
        lambda s, d: load_table(s, d, "orders").join(_item(s, d), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("count")),
        "SELECT o_orderpriority, count(*) AS count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    ),
    "jn2": (
        lambda s, d: load_table(s, d, "orders").join(_item(s, d).where(date_prefix("l_shipdate", MONTH)), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey"),
        f"SELECT o_orderkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE strftime(l_shipdate, '%Y-%m') = '{MONTH}'",
    ),
    "jn3": (
        lambda s, d: relational.q2(*_t(s, d, "lineitem", "orders"), MONTH, limit=None),
        f"SELECT o_orderpriority AS payload, o_orderkey AS orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '{MONTH}')",
    ),
    "jn4": (
        lambda s, d: relational.q3(*_t(s, d, "lineitem", "part", "supplier"), MONTH, limit=None),
        f"SELECT l_orderkey AS orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE strftime(l_shipdate, '%Y-%m') = '{MONTH}'",
    ),
    "jn5": (
        lambda s, d: load_table(s, d, "customer").join(load_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("c_custkey", F.coalesce("n_name", F.lit("")).alias("n_name")),
        "SELECT c_custkey, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    ),
    "jn6": BASE["q4"],
    "jn7": BASE["p4"],
    "jn8": BASE["p9"],
    "jn9": (
        # Returned parts whose number is no supplier's.
        lambda s, d: graph.missing_targets(load_table(s, d, "supplier").select(F.col("s_suppkey").alias("node")), _returned(s, d)).select("src", "dst"),
        "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT s_suppkey FROM supplier)",
    ),
    "jn10": BASE["c2"],
    "jn11": (
        lambda s, d: words.pmi_pairs(_lines(s, d), 10).select("x", "y", "count"),
        f"SELECT x, y, count FROM ({BASE['p4'][1]})",
    ),
    # aggregates
    "agg1": BASE["q1"],
    "agg2": BASE["p1"],
    "agg3": BASE["p1"],
    "agg4": BASE["q5"],
    "agg5": BASE["q6"],
    "agg6": (
        lambda s, d: load_table(s, d, "orders").join(_item(s, d), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey", "o_orderpriority")
        .agg(F.round(F.sum(relational.disc_price()), 4).alias("revenue")),
        f"SELECT o_orderkey, o_custkey, o_orderpriority, round(sum({_DISC}), 4) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    ),
    "agg7": (
        lambda s, d: words.first_count(_lines(s, d)),
        f'WITH {BIGRAMS} SELECT l AS "left", count(*) AS n FROM big GROUP BY l',
    ),
    "agg8": (lambda s, d: _unigrams(s, d), f"WITH {_UNI} SELECT word, c FROM u"),
    "agg9": (lambda s, d: words.pmi_pairs(_lines(s, d), 20).select("x", "y", "count"), f"SELECT x, y, count FROM ({BASE['p4'][1]}) WHERE count >= 20"),
    "agg10": (lambda s, d: retrieval.term_frequencies(_docs(s, d)), f"WITH {TF} SELECT term, doc_id, tf FROM tf"),
    "agg11": BASE["p5"],
    "agg12": (
        lambda s, d: _rounded(graph.log_sum_exp(_item(s, d).select("l_returnflag", F.log("l_quantity").alias("x")), ["l_returnflag"], "x"), log_sum=6),
        "SELECT l_returnflag, round(ln(sum(l_quantity)), 6) AS log_sum FROM lineitem GROUP BY 1",
    ),
    "agg13": (
        lambda s, d: _rounded(p9(s, d).groupBy("source").agg(F.greatest(F.lit(0.0), 1 - F.sum("rank")).alias("missing")), missing=6),
        f"SELECT source, greatest(0, round(1 - sum(rank), 6)) AS missing FROM ({BASE['p9'][1].replace('round(p, 6)', 'p')}) GROUP BY source",
    ),
    "agg15": BASE["c1"],
    "agg16": BASE["p7"],
    # ordered context
    "win1": (lambda s, d: words.bigrams(_lines(s, d)).groupBy("left", "right").count(), f'WITH {BIGRAMS} SELECT l AS "left", r AS "right", count(*) AS count FROM big GROUP BY ALL'),
    "win2": BASE["p2"],
    "win3": (
        lambda s, d: retrieval.postings(_docs(s, d)),
        f"WITH {TF} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap, tf FROM tf",
    ),
    "win4": (
        lambda s, d: retrieval.decode_gaps(
            retrieval.postings(_docs(s, d)).withColumn("pos", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).drop("doc_id")
        ).select("term", "doc_id"),
        f"WITH {TF} SELECT term, doc_id FROM tf",
    ),
    "win5": BASE["t3"],
    "win6": BASE["p11"],
    # order and limits
    "srt1": BASE["q3"],
    "srt2": BASE["q4"],
    "srt3": BASE["q7"],
    "srt4": BASE["p11"],
    "srt5": (
        lambda s, d: retrieval.term_frequencies(_docs(s, d)).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"),
        f"WITH {TF} SELECT term, doc_id, tf FROM tf",
    ),
    "srt6": (lambda s, d: _rounded(classify.train_sgd(samples(s, d), "doc_id", shuffle_seed=7), weight=9), sgd_sql("md5(doc_id || ':7')")),
    "srt7": BASE["q5"],
    # sets
    "set1": (
        lambda s, d: retrieval.intersect_all([retrieval.term_frequencies(_docs(s, d)).where(F.col("term") == t).select("doc_id") for t in ("the", "and")]),
        f"WITH {TF} SELECT doc_id FROM tf WHERE term = 'the' INTERSECT SELECT doc_id FROM tf WHERE term = 'and'",
    ),
    "set2": (
        lambda s, d: retrieval.unite_all([retrieval.term_frequencies(_docs(s, d)).where(F.col("term") == t).select("doc_id") for t in ("the", "la")]),
        f"WITH {TF} SELECT doc_id FROM tf WHERE term = 'the' UNION SELECT doc_id FROM tf WHERE term = 'la'",
    ),
    "set3": (
        lambda s, d: _lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.explode(F.array_distinct(tokens("line"))).alias("word")),
        f"WITH {TOKENIZED} SELECT DISTINCT doc_id, line_no, unnest(w) AS word FROM toks",
    ),
    # scalar functions
    "fn1": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(tokens("text"), " ").alias("words")),
        f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS words FROM documents",
    ),
    "fn2": (
        lambda s, d: load_table(s, d, "pages").select("page_id", F.size(F.split("url", "/")).cast("long").alias("parts"), F.split("url", "/")[2].alias("host")),
        "SELECT page_id, len(string_split(url, '/')) AS parts, string_split(url, '/')[3] AS host FROM pages",
    ),
    "fn3": (lambda s, d: _item(s, d).select("l_orderkey", month("l_shipdate").alias("month")), "SELECT l_orderkey, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem"),
    "fn4": (
        lambda s, d: _item(s, d).select("l_orderkey", F.trim(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "))).cast("double").alias("q")),
        "SELECT l_orderkey, CAST(trim(' ' || CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) || ' ') AS DOUBLE) AS q FROM lineitem",
    ),
    "fn5": (
        lambda s, d: load_table(s, d, "customer").select("c_custkey", (F.col("c_name") > "Customer#5").alias("gt"), (F.col("c_mktsegment") == "BUILDING").alias("eq")),
        "SELECT c_custkey, c_name > 'Customer#5' AS gt, c_mktsegment = 'BUILDING' AS eq FROM customer",
    ),
    "fn6": (lambda s, d: _item(s, d).select("l_orderkey", F.round(F.log10("l_extendedprice"), 6).alias("x")), "SELECT l_orderkey, round(log10(l_extendedprice), 6) AS x FROM lineitem"),
    "fn7": (
        lambda s, d: _item(s, d).select("l_orderkey", F.round(F.log("l_quantity"), 6).alias("a"), F.round(F.exp("l_discount"), 6).alias("b"), F.round(F.log1p("l_tax"), 6).alias("c")),
        "SELECT l_orderkey, round(ln(l_quantity), 6) AS a, round(exp(l_discount), 6) AS b, round(ln(1 + l_tax), 6) AS c FROM lineitem",
    ),
    "fn8": (
        lambda s, d: _events(s, d).select("event_id", F.round(1 / (1 + F.exp(-F.col("value") / 50)), 6).alias("p")),
        "SELECT event_id, round(1 / (1 + exp(-value / 50)), 6) AS p FROM events",
    ),
    "fn9": (
        lambda s, d: _events(s, d).select("event_id", F.format_string("%08d", "event_id").alias("a"), F.format_string("%04d", "user_id").alias("b")),
        "SELECT event_id, printf('%08d', event_id) AS a, printf('%04d', user_id) AS b FROM events",
    ),
    "fn10": (
        lambda s, d: graph.partition_graph(event_graph(s, d)[0], 8).groupBy("node").agg(F.count_distinct("partition").alias("partitions")),
        f"WITH {EDGES} SELECT node, 1 AS partitions FROM nodes",
    ),
    "fn11": BASE["p8"],
    "fn12": (
        lambda s, d: _coded(s, d).select("term", "before", F.explode(decoded_ids("data")).alias("gaps")).select("term", (F.col("before") + F.col("gaps")).alias("doc_id")),
        f"WITH {TF} SELECT term, doc_id FROM tf WHERE term IN ('the', 'and', 'la')",
    ),
    "fn12_bytes": (
        lambda s, d: _coded(s, d).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("block", F.hex("data").alias("x")))).alias("p"))
        .select("term", F.array_join("p.x", "").alias("bytes")),
        f"""WITH {TF}, g AS (SELECT *, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM tf WHERE term IN ('the', 'and', 'la'))
SELECT term, string_agg({_VINT.format('gap')} || {_VINT.format('tf')}, '' ORDER BY doc_id) AS bytes FROM g GROUP BY term""",
    ),
    "fn13": (
        lambda s, d: samples(s, d).select(
            "doc_id", F.size("features").cast("long").alias("n"), F.array_join(F.slice("features", 2, 3), " ").alias("some"),
            F.array_contains("features", "the").alias("has"), F.get("features", F.lit(0)).alias("head"),
        ),
        f"WITH {SAMPLES} SELECT doc_id, len(f) AS n, array_to_string(f[2:4], ' ') AS some, list_contains(f, 'the') AS has, f[1] AS head FROM s0",
    ),
    "fn14": (
        lambda s, d: _docs(s, d).select("doc_id", F.coalesce(F.expr("try_element_at(map('en', 1, 'fr', 2), lang)"), F.lit(0)).alias("code")),
        "SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END AS code FROM documents",
    ),
    "fn15": (
        lambda s, d: _events(s, d).select("event_id", F.when(F.col("value") > 50, "spam").otherwise("ham").alias("label")),
        "SELECT event_id, CASE WHEN value > 50 THEN 'spam' ELSE 'ham' END AS label FROM events",
    ),
    "fn16": BASE["t3_alerts"],
    # windows and streams
    "str1": (_stream_counts, _HOURLY),
    "str2": BASE["t1"],
    "str3": (_stream_regions, BASE["t2"][1]),
    "str4": (
        lambda s, d: _time(windows.event_count(_events(s, d), size="10 minutes"), "window_start"),
        _HOURLY.replace("60 MINUTES", "10 MINUTES"),
    ),
    "str5": (
        _sliding,
        f"""SELECT {_H.format('w')} AS window_start, 'all' AS key, count(*) AS count FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events) GROUP BY ALL""",
    ),
    "str6": (
        _dense_regions,
        f"""WITH {_BOXED}, c0 AS (SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS h, region, count(*) AS c FROM box WHERE region IS NOT NULL GROUP BY ALL),
g AS (SELECT region, unnest(generate_series(min(h), (SELECT max(h) FROM c0), INTERVAL 1 HOUR)) AS h FROM c0 GROUP BY region)
SELECT {_H.format('h')} AS window_start, region, coalesce(c, 0) AS count FROM g LEFT JOIN c0 USING (region, h)""",
    ),
    "str7": (_stream_trends, _CLOSED),
    "str8": BASE["t3_alerts"],
    "str9": BASE["t3"],
    "str10": (_restarted_counts, _HOURLY),
    "str11": (_counted_batches, f"SELECT count(DISTINCT CASE {' '.join(f'WHEN day(ts) < {x} THEN {i}' for i, x in enumerate(_CUTS[1:]))} END) AS batches, count(*) AS events FROM events"),
    "str12": (_stopped, _HOURLY.replace("FROM events", f"FROM events WHERE day(ts) < {_CUTS[2]}")),
    "str13": (_persisted, "SELECT event_type, count(*) AS count FROM events GROUP BY 1"),
    "agg14": BASE["t1"],
}
