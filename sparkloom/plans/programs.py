"""The composite programs over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import lines as lines_of
from sparkloom.functions.text import tokens
from sparkloom.operators import classify, graph, relational, retrieval, words
from sparkloom.plans.lineage import cut_lineage, own_path
from sparkloom.sources.tables import load_table
from sparkloom.streaming import windows

DATE, MONTH, NATIONS = "1996-01-01", "1996-01", ["NATION_3", "NATION_24"]
TRIGGER, PMI_THRESHOLD, QUERY = "the", 10, "thou the AND la OR"
BOXES = {"a": (10.0, 40.0, 20.0, 60.0), "b": (35.0, 80.0, 50.0, 90.0)}
SOURCES, STEPS = [8, 46], 3

# --- SQL parts -------------------------------------------------------------

LINES = "lines AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"
#: Words of a text column, in order.
TOKENS = r"list_filter(list_transform(string_split_regex(lower({0}), '\s+'), lambda w: regexp_replace(w, '^[^a-z]+|[^a-z]+$', '', 'g')), lambda w: w <> '')"
TOKENIZED = f"{LINES}, toks AS (SELECT doc_id, line_no, {TOKENS.format('line')} AS w FROM lines)"
BIGRAMS = f"{TOKENIZED}, big AS (SELECT w[i] AS l, w[i + 1] AS r FROM (SELECT w, unnest(range(1, len(w))) AS i FROM toks))"
TF = f"tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL)"
EDGES = """e0 AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'error'),
edges AS (SELECT DISTINCT src, dst FROM e0 WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"""
SAMPLES = f"""s0 AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS label, {TOKENS.format('text')} AS f
  FROM documents d JOIN labels l USING (doc_id)),
occ AS (SELECT doc_id, label, unnest(f) AS feature FROM s0)"""
CELLS = """c0 AS (SELECT event_type AS key, time_bucket(INTERVAL 60 MINUTES, ts) AS h, count(*) AS c FROM events GROUP BY ALL),
span AS (SELECT key, min(h) AS lo, (SELECT max(h) FROM c0) AS hi FROM c0 GROUP BY key),
grid AS (SELECT key, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM span),
dense AS (SELECT key, h, coalesce(c, 0) AS c FROM grid LEFT JOIN c0 USING (key, h)),
trend AS (SELECT key, h, CAST(c AS BIGINT) AS current, CAST(lag(c, 1, 0) OVER (PARTITION BY key ORDER BY h) AS BIGINT) AS previous,
  epoch_ms(h + INTERVAL 1 HOUR) - epoch_ms((SELECT min(h) FROM c0)) AS ms FROM dense)"""


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [load_table(spark, sf, n) for n in names]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(load_table(spark, sf, "documents"))


def event_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges between the users of consecutive errors of a day."""
    from pyspark.sql import Window

    errors = load_table(spark, sf, "events").where("event_type = 'error'")
    nxt = F.lead("user_id").over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    edges = errors.select(F.col("user_id").alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst").distinct()
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents; features are all words of the text, repeats counted."""
    docs, labels = _t(spark, sf, "documents", "labels")
    label = F.when(F.col("toxic") == 1, "spam").otherwise("ham").alias("label")
    return docs.join(labels, "doc_id").select("doc_id", label, tokens("text").alias("features"))


def fold_models(rows: DataFrame) -> DataFrame:
    """model, feature, weight: one gradient step on each third of the samples."""
    return classify.batch_weights(rows.withColumn("model", (F.col("doc_id") % 3).cast("int")), keys=["model"])


def stored_index(spark: SparkSession, sf: str, terms: list[str]) -> DataFrame:
    """The rows of some terms in an index that is built, stored by term and looked up."""
    path = own_path(spark, "index")
    retrieval.store_index(retrieval.build_index(load_table(spark, sf, "documents")), path)
    return retrieval.look_up(spark, path, terms)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _time(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in names})


def _hour_trend(spark: SparkSession, sf: str) -> DataFrame:
    return windows.trend_snapshot(load_table(spark, sf, "events"), "ts", "event_type", "60 minutes")


def p9(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = event_graph(spark, sf)
    return graph.personalized_pagerank(nodes, edges, SOURCES, STEPS)


def _ppr_sql(sources: list[int] = SOURCES, steps: int = STEPS, alpha: float = 0.15) -> str:
    sql = f"WITH {EDGES}, src AS (SELECT unnest({sources}) AS source), deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src),\n"
    sql += "r0 AS (SELECT source, node, CASE WHEN source = node THEN 1.0::DOUBLE ELSE 0 END AS p FROM src, nodes)"
    for k in range(steps):
        sql += f""",
m{k} AS (SELECT r.source, e.dst AS node, sum(r.p / d) AS m FROM r{k} r JOIN edges e ON r.node = e.src JOIN deg USING (src) GROUP BY ALL),
x{k} AS (SELECT source, greatest(0, 1 - sum(m)) AS lost FROM m{k} GROUP BY source),
r{k + 1} AS (SELECT r.source, r.node, {1 - alpha} * coalesce(m, 0) + CASE WHEN r.source = r.node THEN {alpha} + {1 - alpha} * coalesce(lost, 1) ELSE 0 END AS p
  FROM r{k} r LEFT JOIN m{k} m USING (source, node) LEFT JOIN x{k} USING (source))"""
    return sql


def sgd_sql(order: str) -> str:
    """One pass of gradient steps: a score is the sum of all steps before, weighted by the words that two samples share."""
    return f"""WITH RECURSIVE {SAMPLES},
n0 AS MATERIALIZED (SELECT doc_id, label, row_number() OVER (ORDER BY {order}, doc_id) AS i FROM s0),
c AS MATERIALIZED (SELECT i, feature, count(*) AS n FROM occ JOIN n0 USING (doc_id) GROUP BY ALL),
pair AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.n * b.n) AS k FROM c a JOIN c b ON a.feature = b.feature AND a.i > b.i GROUP BY ALL),
row_ AS MATERIALIZED (SELECT x.i, x.label, list(coalesce(k, 0)::DOUBLE ORDER BY y.i) FILTER (y.i IS NOT NULL) AS ks
  FROM n0 x LEFT JOIN n0 y ON y.i < x.i LEFT JOIN pair ON pair.i = x.i AND pair.j = y.i GROUP BY ALL),
r(i, steps) AS (SELECT 0::BIGINT, []::DOUBLE[] UNION ALL
  SELECT x.i, list_append(steps, 0.002 * (CASE WHEN label = 'spam' THEN 1 ELSE 0 END - 1 / (1 + exp(-CASE WHEN x.i = 1 THEN 0 ELSE list_inner_product(steps, ks) END))))
  FROM r JOIN row_ x ON x.i = r.i + 1),
step AS (SELECT unnest(range(1, len(steps) + 1)) AS i, unnest(steps) AS step FROM (SELECT steps FROM r ORDER BY i DESC LIMIT 1))
SELECT feature, round(sum(n * step), 9) AS weight FROM c JOIN step USING (i) GROUP BY feature"""


BASE = {
    "p1": (
        lambda s, d: words.word_count(_lines(s, d)),
        f"WITH {TOKENIZED} SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM toks) GROUP BY word",
    ),
    "p2": (
        lambda s, d: words.follow_count(_lines(s, d), TRIGGER),
        f"WITH {BIGRAMS} SELECT r AS word, count(*) AS count FROM big WHERE l = '{TRIGGER}' AND r <> l GROUP BY r HAVING count(*) >= 2",
    ),
    "p3": (
        lambda s, d: _rounded(words.bigram_relfreq(_lines(s, d)), value=6),
        f"WITH {BIGRAMS}, m AS (SELECT l, count(*) AS n FROM big GROUP BY l) SELECT l AS left, r AS right, round(count(*) / any_value(n), 6) AS value "
        'FROM big JOIN m USING (l) GROUP BY l, r UNION ALL SELECT l, \'*\', CAST(n AS DOUBLE) FROM m'.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'),
    ),
    "p4": (
        lambda s, d: _rounded(words.pmi_pairs(_lines(s, d), PMI_THRESHOLD), pmi=6),
        f"""WITH {TOKENIZED}, t AS (SELECT DISTINCT doc_id, line_no, unnest(list_slice(w, 1, 40)) AS x FROM toks),
u AS (SELECT x, count(*) AS c FROM t GROUP BY x), n AS (SELECT count(*) AS n FROM lines), f AS (SELECT t.* FROM t JOIN u USING (x) WHERE c >= {PMI_THRESHOLD}),
p AS (SELECT a.x, b.x AS y, count(*) AS count FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.x <> b.x GROUP BY ALL HAVING count(*) >= {PMI_THRESHOLD})
SELECT p.x, p.y, round(log10((count / n) / ((ux.c / n) * (uy.c / n))), 6) AS pmi, count FROM p JOIN u ux ON p.x = ux.x JOIN u uy ON p.y = uy.x, n""",
    ),
    "p5": (
        lambda s, d: retrieval.build_index(load_table(s, d, "documents")).select(
            "term", "block", "df", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p.doc_id, p.gap, p.tf)), " ").alias("postings")
        ),
        f"""WITH {TF}, b AS (SELECT *, CAST(floor(doc_id / 65536) AS BIGINT) AS block FROM tf), n AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT *, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, block ORDER BY doc_id) AS gap FROM b)
SELECT term, block, any_value(df) AS df, string_agg(doc_id || ':' || gap || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM g JOIN n USING (term) GROUP BY term, block""",
    ),
    "p6": (
        lambda s, d: retrieval.boolean_query(stored_index(s, d, QUERY.split()), load_table(s, d, "documents"), QUERY),
        f"""WITH {TF}, hit AS (SELECT doc_id FROM tf GROUP BY doc_id
  HAVING bool_or(term = 'thou') AND bool_or(term = 'the') OR bool_or(term = 'la'))
SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS snippet FROM documents JOIN hit USING (doc_id)""",
    ),
    "p7": (
        lambda s, d: graph.graph_stats(*event_graph(s, d)),
        f"WITH {EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT src) FROM edges) AS active_nodes",
    ),
    "p8": (
        lambda s, d: graph.partition_graph(event_graph(s, d)[0], 4, 2000),
        f"WITH {EDGES} SELECT node, CAST(floor(node / 2000.0::DOUBLE * 4) % 4 AS INTEGER) AS partition FROM nodes",
    ),
    "p9": (lambda s, d: _rounded(p9(s, d), rank=6), _ppr_sql() + f"\nSELECT source, node, round(p, 6) AS rank FROM r{STEPS}"),
    "p10": (
        lambda s, d: _rounded(graph.personalized_pagerank(*event_graph(s, d), [8], 2, 0.2), rank=6),
        _ppr_sql([8], 2, 0.2) + "\nSELECT source, node, round(p, 6) AS rank FROM r2",
    ),
    "p11": (
        lambda s, d: graph.top_ppr(_rounded(p9(s, d), rank=9), 10).withColumn("rn", F.col("rn").cast("long")),
        _ppr_sql() + f""", t AS (SELECT source, node, round(p, 9) AS p, row_number() OVER (PARTITION BY source ORDER BY round(p, 9) DESC, node) AS rn FROM r{STEPS})
SELECT source, node, printf('%.5f', p) AS rank_text, rn FROM t WHERE rn <= 10""",
    ),
    "q1": (
        lambda s, d: relational.q1(load_table(s, d, "lineitem"), DATE),
        f"SELECT count(*) AS count FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') LIKE '{DATE}%'",
    ),
    "q2": (
        lambda s, d: relational.q2(*_t(s, d, "lineitem", "orders"), DATE),
        f"""SELECT o_orderpriority AS payload, o_orderkey AS orderkey FROM orders WHERE o_orderkey IN
(SELECT l_orderkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') = '{DATE}') ORDER BY o_orderkey, o_orderpriority LIMIT 20""",
    ),
    "q3": (
        lambda s, d: relational.q3(*_t(s, d, "lineitem", "part", "supplier"), DATE),
        f"""SELECT l_orderkey AS orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE strftime(l_shipdate, '%Y-%m-%d') = '{DATE}' ORDER BY 1, 2, 3 LIMIT 20""",
    ),
    "q4": (
        lambda s, d: relational.q4(*_t(s, d, "lineitem", "orders", "customer", "nation"), MONTH),
        f"""SELECT c_nationkey AS n_nationkey, coalesce(n_name, '') AS n_name, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE strftime(l_shipdate, '%Y-%m') = '{MONTH}' GROUP BY ALL""",
    ),
    "q5": (
        lambda s, d: relational.q5(*_t(s, d, "lineitem", "orders", "customer", "nation"), NATIONS),
        f"""SELECT n_name, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('{NATIONS[0]}', '{NATIONS[1]}') GROUP BY ALL""",
    ),
    "q6": (
        lambda s, d: _rounded(relational.q6(load_table(s, d, "lineitem"), MONTH), sum_qty=2, sum_base_price=2, sum_disc_price=2, sum_charge=2, avg_qty=6, avg_price=6, avg_disc=6),
        f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count
FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '{MONTH}' GROUP BY ALL""",
    ),
    "q7": (
        lambda s, d: _rounded(relational.q7(*_t(s, d, "lineitem", "orders", "customer"), DATE), revenue=4),
        f"""SELECT c_name, o_orderkey AS orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
o_orderpriority AS payload FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE strftime(l_shipdate, '%Y-%m-%d') > '{DATE}' AND strftime(o_orderdate, '%Y-%m-%d') > '{DATE}' GROUP BY ALL ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, 2 LIMIT 10""",
    ),
    "c1": (lambda s, d: _rounded(classify.train_sgd(samples(s, d), "doc_id"), weight=9), sgd_sql("doc_id")),
    "c2": (
        lambda s, d: _rounded(classify.apply_classifier(r := samples(s, d), classify.batch_weights(r)), score=9),
        f"""WITH {SAMPLES}, w AS (SELECT feature, sum(CASE WHEN label = 'spam' THEN 0.5::DOUBLE ELSE -0.5 END) * 0.002 AS weight FROM occ GROUP BY feature),
sc AS (SELECT doc_id, sum(weight) AS score FROM occ JOIN w USING (feature) GROUP BY doc_id)
SELECT doc_id, label, round(coalesce(score, 0), 9) AS score, CASE WHEN coalesce(score, 0) > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM s0 LEFT JOIN sc USING (doc_id)""",
    ),
}


def _ensemble_sql(score: str) -> str:
    return f"""WITH {SAMPLES}, m AS (SELECT doc_id % 3 AS model, feature, sum(CASE WHEN label = 'spam' THEN 0.5::DOUBLE ELSE -0.5 END) * 0.002 AS weight FROM occ GROUP BY ALL),
sc AS (SELECT doc_id, model, sum(weight) AS score FROM occ JOIN m USING (feature) GROUP BY ALL),
g AS (SELECT doc_id, label, model, coalesce(score, 0) AS score FROM (SELECT doc_id, label, k.model FROM s0, (SELECT DISTINCT model FROM m) k) LEFT JOIN sc USING (doc_id, model)),
a AS (SELECT doc_id, label, {score} AS score FROM g GROUP BY ALL)
SELECT doc_id, label, round(score, 9) AS score, CASE WHEN round(score, 9) > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM a"""


def _ensemble(method: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = samples(s, d)
        out = _rounded(classify.apply_ensemble(rows, cut_lineage(fold_models(rows)), method), score=9)
        return out.withColumn("prediction", F.when(F.col("score") > 0, "spam").otherwise("ham"))

    return run


def _boxed(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))


_BOX = "CASE WHEN value BETWEEN 10 AND 40 AND k BETWEEN 20 AND 60 THEN 'a' WHEN value BETWEEN 35 AND 80 AND k BETWEEN 50 AND 90 THEN 'b' END"

BASE |= {
    "c3": (_ensemble("average"), _ensemble_sql("avg(score)")),
    "c3_vote": (_ensemble("vote"), _ensemble_sql("sum(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE -1.0 END)")),
    "t1": (
        lambda s, d: _time(windows.event_count(load_table(s, d, "events")), "window_start"),
        "SELECT strftime(time_bucket(INTERVAL 60 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'all' AS key, count(*) AS count FROM events GROUP BY ALL",
    ),
    "t2": (
        lambda s, d: _time(windows.region_event_count(_boxed(s, d), "ts", "value", "k", BOXES), "window_start"),
        f"""SELECT strftime(time_bucket(INTERVAL 60 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS window_start, region, count(*) AS count
FROM (SELECT ts, {_BOX} AS region FROM (SELECT ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)) WHERE region IS NOT NULL GROUP BY ALL""",
    ),
    "t3": (
        lambda s, d: _time(_hour_trend(s, d), "window_end"),
        f"WITH {CELLS} SELECT strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, key, current, printf('%08d', ms) AS time_text, previous FROM trend",
    ),
    "t3_alerts": (
        lambda s, d: _time(windows.trend_alerts(_hour_trend(s, d), min_count=5), "window_end"),
        f"""WITH {CELLS} SELECT strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, key, current, printf('%08d', ms) AS time_text, previous,
printf('Number of arrivals to %s has doubled from %d to %d at %d!', key, previous, current, ms) AS message FROM trend WHERE current >= 5 AND current >= 2 * previous""",
    ),
}
