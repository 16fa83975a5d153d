"""Inverted index with gap-coded postings, and Boolean postfix retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import snippet, tokens
from sparkloom.sources.sinks import write_sorted

#: Document ids in one block of an index.
BLOCK_DOCS = 1 << 16


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, tf."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(text_col)).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, gap, tf: one row for each posting, gaps to the term's previous document."""
    w = Window.partitionBy("term").orderBy("doc_id")
    return term_frequencies(docs, id_col, text_col).select(
        "term", "doc_id", (F.col("doc_id") - F.lag("doc_id", 1, 0).over(w)).alias("gap"), "tf"
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """term, block, df, postings array<struct<doc_id, gap, tf>> by doc_id.

    A row has the postings of a term in one block of ``block_docs`` ids, so none
    grows with the collection; gaps start anew in each block.  df is that of the
    term in all documents.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(text_col)).alias("term"))
    # The postings of a block meet once, dealt by term and block; df is summed from blocks, not from the texts again.
    dealt = words.withColumn("block", F.floor(F.col("doc_id") / block_docs)).repartition("term", "block")
    rows = _blocks(dealt.groupBy("term", "block", "doc_id").agg(F.count("*").alias("tf")))
    gaps = F.expr("transform(p, (x, i) -> struct(x.doc_id AS doc_id, x.doc_id - IF(i = 0, 0, p[i - 1].doc_id) AS gap, x.tf AS tf))")
    df = F.sum(F.size("p")).over(Window.partitionBy("term")).alias("df")
    return rows.select("term", "block", df, gaps.alias("postings"))


def _blocks(tf: DataFrame) -> DataFrame:
    """term, block, p array<struct<doc_id, tf>> by doc_id."""
    return tf.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))


def coded_postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """term, block, before, data: the postings of some terms as variable-length integers.

    A row has one block of ids, but gaps run through: ``before`` is the term's last id in the blocks before, so the data of a term's blocks, one after
    the other, are those of its whole list.
    """
    from sparkloom.functions.codec import encoded

    tf = term_frequencies(docs, id_col, text_col).where(F.col("term").isin(list(terms)))
    rows = _blocks(tf.withColumn("block", F.floor(F.col("doc_id") / block_docs)))
    rows = rows.select("term", "block", F.col("p.doc_id").alias("ids"), F.col("p.tf").alias("counts"))
    before = F.lag(F.element_at("ids", -1), 1, 0).over(Window.partitionBy("term").orderBy("block")).alias("before")
    return rows.select("term", "block", before, "ids", "counts").select("term", "block", "before", encoded("ids", "counts", "before").alias("data"))


def encode_index(index: DataFrame) -> DataFrame:
    """term, block, df, data: postings as variable-length integers."""
    from sparkloom.functions.codec import encoded

    rows = index.select("term", "block", "df", F.col("postings.doc_id").alias("ids"), F.col("postings.tf").alias("counts"))
    return rows.select("term", "block", "df", encoded("ids", "counts").alias("data"))


def store_index(index: DataFrame, path: str, partitions: int = 16) -> None:
    """The index as files sorted by term, so that a look-up reads the row groups of its terms alone."""
    write_sorted(index, path, "term", partitions)


def look_up(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The rows of some terms in a stored index; the terms are a filter of the scan."""
    return spark.read.parquet(path).where(F.col("term").isin(list(terms)))


def decode_gaps(gapped: DataFrame) -> DataFrame:
    """doc_id made again from gaps by a running sum in posting order (term, pos, gap)."""
    w = Window.partitionBy("term").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return gapped.withColumn("doc_id", F.sum("gap").over(w))


def parse_postfix(query: str) -> tuple[list[str], object]:
    """The distinct terms and an expression tree of nested ('AND'|'OR', left, right) and terms."""
    stack: list = []
    terms: list[str] = []
    for t in query.split():
        if t in ("AND", "OR"):
            if len(stack) < 2:
                raise ValueError(f"operator without operands: {query!r}")
            right, left = stack.pop(), stack.pop()
            stack.append((t, left, right))
        else:
            stack.append(t)
            if t not in terms:
                terms.append(t)
    if len(stack) != 1:
        raise ValueError(f"not one expression: {query!r}")
    return terms, stack[0]


def boolean_query(index: DataFrame, docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, snippet of the documents that a postfix query of terms, AND and OR selects.

    The index is scanned once with a filter on its terms; the sets are made by
    one aggregate of flags for each document.
    """
    terms, tree = parse_postfix(query)

    def test(node) -> Column:
        if isinstance(node, tuple):
            left, right = test(node[1]), test(node[2])
            return left & right if node[0] == "AND" else left | right
        return F.col(f"t{terms.index(node)}")

    found = index.where(F.col("term").isin(terms)).select("term", F.explode("postings.doc_id").alias("doc_id"))
    flags = [F.bool_or(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(terms)]
    hits = found.groupBy("doc_id").agg(*flags).where(test(tree)).select("doc_id")
    return docs.select(F.col(id_col).alias("doc_id"), snippet(text_col).alias("snippet")).join(hits, "doc_id", "left_semi")


def intersect_all(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), sets)


def unite_all(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), sets).distinct()
