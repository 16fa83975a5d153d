"""Benchmark decontamination by winnowing (operator 4).

Words are lower-cased (A-Z) runs of letters and digits, everything beyond ASCII
included.  Of every window of ``window`` words the smallest k-gram hash is its
fingerprint, so equal windows have equal fingerprints and every shared span of
``window`` words is found.  The fingerprints of documents are joined with those
of the benchmark items; each hit is extended to the whole window and verified
by a 128-bit name.  An item of fewer words is a single window of its own length.

The benchmark is read in blocks of a checked size (``BLOCK_WORDS``), each
broadcast to one pass over the documents; spans of several blocks are merged
for equal ids and texts (by 128-bit names), whose rows are counted and given
back as often.  A usual benchmark is one block, and nothing is shuffled.

Null and empty texts have no words, are never hit, and as items never match.
Items without id count as hits but are not listed; several rows with one id are
one item.  Repeated rows are judged each by itself, also where they
have no doc_id or one doc_id has several texts.  Empty tables give empty or clean
results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.textkernel import NOT_ALNUM, Units, Words, chunks, row_bytes, window_argmin, word_units

#: Benchmark words in one broadcast block: names and item lists of 16 to 40 bytes each.
BLOCK_WORDS = 1_000_000
GRAM = 5

RESULT = "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, name string"


class _Names:
    """A sorted set of 64-bit names with a bitmap in front."""

    def __init__(self, names: np.ndarray) -> None:
        self.names = np.unique(names)
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.names >> np.uint64(44)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Indices into x of the values that are in the set."""
        some = np.flatnonzero(self.map[(x >> np.uint64(44)).astype(np.int64)])
        if len(self.names) == 0 or len(some) == 0:
            return some[:0]
        at = np.minimum(np.searchsorted(self.names, x[some]), len(self.names) - 1)
        return some[self.names[at] == x[some]]


class Fingerprints:
    """What a pass needs of one block of the benchmark."""

    def __init__(self, ids: list, texts: pa.Array, window: int) -> None:
        self.window, self.gram = window, min(GRAM, window)
        raw, offsets = row_bytes(texts)
        words = Words(raw, offsets, lower=True, blank=NOT_ALNUM)
        units = word_units(words)
        first, count = words.first, words.count
        long = np.flatnonzero(count >= window)
        starts = [np.arange(first[i], first[i + 1] - window + 1) for i in long]
        s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        owner = np.repeat(long, [len(x) for x in starts]) if starts else np.zeros(0, np.int64)
        self.ids = ids
        if len(s):
            g = units.grams(self.gram)
            self.prints = _Names(g[window_argmin(g, window - self.gram + 1)[s]])
        else:
            self.prints = _Names(np.zeros(0, np.uint64))
        self.tables = {}
        if len(s):
            self.tables[window] = self._table(units, s, s + window, owner)
        for size in np.unique(count[(count > 0) & (count < window)]):
            i = np.flatnonzero(count == size)
            self.tables[int(size)] = self._table(units, first[i], first[i] + size, i)

    @staticmethod
    def _table(units: Units, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[_Names, dict]:
        a, b = units.spans(start, end, 0), units.spans(start, end, 1)
        items: dict[tuple[int, int], set[int]] = {}
        for x, y, i in zip(a.tolist(), b.tolist(), owner.tolist(), strict=True):
            items.setdefault((x, y), set()).add(i)
        return _Names(a), items

    def hits(self, units: Units) -> list[tuple[int, int, set[int]]]:
        """(start, length, owners) of every window of the chunk that an item has, in any row."""
        out, n = [], len(units.values)
        for size, (names, items) in self.tables.items():
            if n < size:
                continue
            if size == self.window:
                g = units.grams(self.gram)
                at = window_argmin(g, self.window - self.gram + 1)
                found = np.zeros(len(g), bool)
                found[self.prints.find(g)] = True
                start = np.flatnonzero(found[at])
            else:
                start = np.arange(n - size + 1)
            a = units.spans(start, start + size, 0)
            some = names.find(a)
            b = units.spans(start[some], start[some] + size, 1)
            for s, x, y in zip(start[some].tolist(), a[some].tolist(), b.tolist(), strict=True):
                who = items.get((x, y))
                if who:
                    out.append((s, size, who))
        return out


def _judge(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: Fingerprints = shared.value
        for batch in batches:
            raw, offsets = row_bytes(batch.column("text"))
            n_words, n_hit, spans, items = [], [], [], []
            for lo, hi in chunks(offsets):
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True, blank=NOT_ALNUM)
                units = word_units(words)
                own: dict[int, list] = {}
                for s, size, who in prints.hits(units):
                    row = int(np.searchsorted(words.first, s, "right")) - 1
                    if s + size <= words.first[row + 1]:
                        own.setdefault(row, []).append((s - int(words.first[row]), size, who))
                n_words += words.count.tolist()
                for row in range(hi - lo):
                    hit = merge([(s, s + size) for s, size, _ in own.get(row, [])])
                    n_hit.append(sum(b - a for a, b in hit))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    ids = {prints.ids[i] for _, _, who in own.get(row, []) for i in who}
                    items.append(sorted(x for x in ids if x is not None))
            yield _result(batch, n_words, n_hit, spans, items)

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _result(batch, n_words, n_hit, spans, items) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(items, pa.list_(pa.string())),
            batch.column("name"),
        ],
        ["doc_id", "n_words", "n_hit", "spans", "items", "name"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        spans = [merge([(s["start"], s["end"]) for s in r["spans"]]) for r in rows]
        yield _result(
            batch,
            [r["n_words"] for r in rows],
            [sum(b - a for a, b in x) for x in spans],
            [[{"start": a, "end": b} for a, b in x] for x in spans],
            [sorted(set(r["items"])) for r in rows],
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of hit words), items (ids, sorted as strings) of every row of ``docs``.

    benchmark: columns item_id and text.
    """
    if window < 1:
        raise ValueError("window must be 1 at least")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * block_words)))
    # What tells rows of one doc_id apart when blocks are merged.
    docs = docs.withColumn("name", F.md5("text") if blocks > 1 else F.lit(None).cast("string"))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().combine_chunks()
        texts = block.column("text").combine_chunks() if block.num_rows else pa.array([], pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        prints = Fingerprints(block.column("item_id").to_pylist(), texts, window)
        one = docs.mapInArrow(_judge(spark.sparkContext.broadcast(prints)), RESULT)
        out = one if out is None else out.unionByName(one)
    if blocks > 1:
        # Rows of one id and text have the same result in each block; every block has all of them.
        out = out.groupBy("doc_id", "name").agg(
            F.max("n_words").alias("n_words"),
            F.max("n_hit").alias("n_hit"),
            F.flatten(F.collect_set("spans")).alias("spans"),
            F.flatten(F.collect_set("items")).alias("items"),
            F.expr(f"count(*) div {blocks}").alias("copies"),
        )
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy").mapInArrow(_merged, RESULT)
    return out.drop("name")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM b),
bk AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM b) s WHERE len(w) >= n),
dk AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp),
hit AS (SELECT doc_id, p, n, item_id FROM dk JOIN bk USING (n, k)),
place AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN place USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES = {"op4_decontamination": ORACLE}
