"""N-gram Jaccard join by vertical partitioning (operator 1).

A document's set is its distinct n-word shingles, as 64-bit names.  All names
have one global order: by value, with names that very many documents share
moved to the end.  The order is cut into fragments (ranges of the name); the
overlap of a pair of documents is counted in each fragment separately and the
partial counts are summed per pair.

1. Names that repeat within a batch of rows are counted over all batches; the
   most common ones are put last.  Which names these are decides about speed
   alone, never about links.
2. Documents with equal sets are one class; its smallest doc_id stands for it.
   Candidates: two sets that reach the threshold share a name among the first
   ``n - ceil(t * n) + 1`` of the order in each.  Only these names are dealt
   out; whole sets are made again for documents of pairs under verification.
3. Dense groups are linked as stars first: in every group of documents that
   share a name, each is verified against one hub; documents that are connected
   already need no further comparison.
4. What is left is complete: every pair of documents of different components
   that share a name within the prefix is enumerated, filtered by size,
   position and shared prefix names, and verified.  So components are exact.

Null, empty and blank texts have the empty set and are linked with nothing.
Rows without doc_id get a null component and link nothing.  Rows repeating a
doc_id are one document; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.scratch import Scratch
from sparkloom.llm.textkernel import Words, chunks, row_bytes, signed, word_units

#: Names counted more often than this come last in the global order.  The limit
#: rises with the sum of all counts, so that at most 2**21 names (16 MB) are
#: broadcast, whatever the size of the table.
COMMON = 16
COMMON_NAMES = 1 << 21
#: Documents whose texts are looked up by a broadcast of their ids (8 bytes each and overhead).
LOOKUP = 500_000
#: Fragments of the global order.
FRAGMENTS = 8
#: Documents of one group that one star holds.
STAR = 4096
STAR_ROUNDS = 1


def prefix_length(n, percent: int):
    """How many names of a set of n are dealt out (ints or arrays)."""
    return n - (percent * n + 99) // 100 + 1


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = row_bytes(batch.column("text"))
    for lo, hi in chunks(offsets):
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        units = word_units(words)
        g, first = units.grams(n), words.first
        short = units.spans(first[:-1], first[1:])
        for i in range(hi - lo):
            count = first[i + 1] - first[i]
            if count >= n:
                yield lo + i, np.unique(g[first[i] : first[i + 1] - n + 1])
            else:
                yield lo + i, short[i : i + 1] if count else short[:0]


def _repeated_names(n: int) -> Callable:
    """Names that several documents of a batch have, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _sets(batch, n)]
            names = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            del sets
            names.sort()  # in place: a batch has millions of names
            names, times = np.unique(names[np.r_[names[1:] == names[:-1], False] | np.r_[False, names[1:] == names[:-1]]] if len(names) else names, return_counts=True)
            yield from _slices([signed(names), times.astype(np.int64)], ["name", "c"])

    return run


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, whose results take less memory at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _slices(columns: list[np.ndarray], names: list[str], size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in columns], names)


def _summaries(n: int, percent: int, common) -> Callable:
    """Size, name of the whole set, and the first names under the order (common last, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in _parts(batches):
            size, sig, prefix, rare = [], [], [], []
            for _, s in _sets(batch, n):
                size.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                p = prefix_length(len(s), percent) if len(s) else 0
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                rare.append(min(p, len(s) - int(late.sum())))
                prefix.append(np.concatenate([s[~late], s[late]])[:p].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.binary()), pa.array(rare, pa.int32())],
                ["doc_id", "n", "sig", "prefix", "rare"],
            )

    return run


def _first_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = row_bytes(batch.column("prefix"))
        times = np.diff(offsets) // 8
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), times)
        size = np.repeat(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int32), times)
        rare = np.repeat(batch.column("rare").to_numpy(zero_copy_only=False), times)
        at = (np.arange(len(ids)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
        yield from _slices([np.frombuffer(raw.tobytes(), np.int64), ids, size, at, rare], ["name", "doc_id", "n", "at", "rare"])


def _fragments(n: int) -> Callable:
    """One row for each document and fragment of the global order that its set reaches."""
    shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            doc, part, seg = [], [], []
            for i, own in _sets(batch, n):
                cut = np.searchsorted(own >> shift, np.arange(FRAGMENTS + 1))
                for v in range(FRAGMENTS):
                    if cut[v] < cut[v + 1]:
                        doc.append(ids[i])
                        part.append(v)
                        seg.append(own[cut[v] : cut[v + 1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(seg, pa.binary())], ["doc_id", "part", "seg"]
            )

    return run


def _partial_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        (ra, oa), (rb, ob) = row_bytes(batch.column("seg_a")), row_bytes(batch.column("seg_b"))
        x, y = np.frombuffer(ra.tobytes(), np.uint64), np.frombuffer(rb.tobytes(), np.uint64)
        oa, ob = oa // 8, ob // 8
        common = [
            len(np.intersect1d(x[oa[i] : oa[i + 1]], y[ob[i] : ob[i + 1]], assume_unique=True)) for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"]
        )


class _Join:
    """One run of the operator; sets up the tables that the stages share."""

    def __init__(self, docs: DataFrame, n: int, percent: int) -> None:
        self.docs, self.n, self.percent = docs, n, percent
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "ngram")

    def needed(self, a: str, b: str) -> str:
        """SQL: the overlap that sets of sizes a and b need: 100 I >= p (a + b - I)."""
        p = self.percent
        return f"div({p} * ({a} + {b}) + {99 + p}, {100 + p})"

    def common_names(self) -> np.ndarray:
        """The names that come last, sorted; COMMON_NAMES at most."""
        counts = self.docs.mapInArrow(_repeated_names(self.n), "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))
        counts = self.scratch.cut(counts.where(F.col("c") > COMMON))
        total = counts.agg(F.sum("c")).first()[0] or 0
        often = counts.where(F.col("c") > max(COMMON, total // COMMON_NAMES)).select("name").toArrow().column(0).to_numpy()
        self.scratch.drop(counts)
        return np.sort(np.asarray(often, np.int64).view(np.uint64))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs a, b (sizes na, nb) that reach the threshold: partial overlaps summed over fragments."""
        ids = self.scratch.cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
        some = F.broadcast(ids) if ids.count() <= LOOKUP else ids
        texts = self.docs.join(some, "doc_id", "left_semi")
        parts = self.scratch.cut(texts.mapInArrow(_fragments(self.n), "doc_id long, part int, seg binary").dropDuplicates(["doc_id", "part"]), "none")
        left = parts.select(F.col("doc_id").alias("a"), "part", F.col("seg").alias("seg_a"))
        right = parts.select(F.col("doc_id").alias("b"), "part", F.col("seg").alias("seg_b"))
        overlaps = (
            pairs.select("a", "b").join(left, "a").join(right, ["b", "part"])
            .select("a", "b", "seg_a", "seg_b")
            .mapInArrow(_partial_overlaps, "a long, b long, common long")
            .groupBy("a", "b").agg(F.sum("common").alias("common"))
        )
        found = self.scratch.cut(
            pairs.join(overlaps, ["a", "b"]).where(f"common >= {self.needed('na', 'nb')}").select("a", "b")
        )
        self.scratch.drop(parts, ids)
        return found

    def labelled(self, dealt: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return dealt.withColumn("comp", F.col("doc_id"))
        return dealt.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
            *dealt.columns, F.coalesce("component", "doc_id").alias("comp")
        )

    def open_groups(self, dealt: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, int, int, list[DataFrame]]:
        """Rows of groups that hold several components, their number, pairs between components, and tables to drop after use."""
        rows = self.scratch.cut(self.labelled(dealt, labels))
        sizes = rows.groupBy("name", "comp").agg(F.count("*").alias("k"))
        groups = sizes.groupBy("name").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q")).where("s * s > q")
        groups = self.scratch.cut(groups)
        total = groups.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
        live = rows.join(groups.select("name"), "name", "left_semi")
        return live, int(total[0] or 0), int(total[1] or 0), [rows, groups]

    def star_pairs(self, live: DataFrame, k: int) -> DataFrame:
        """Each document with the hub of the groups it is in; one partner each."""
        salt = F.pmod(F.xxhash64("doc_id", "name", F.lit(k)), F.ceil(F.col("c") / STAR)).alias("salt")
        # First comes the set with the fewest rare names: what near copies are copies of, or close to it.
        order = [F.col("rare") / F.col("n"), F.col("doc_id")] if k == 0 else [F.xxhash64("comp", F.lit(k)), F.col("rare") / F.col("n"), F.col("doc_id")]
        w = Window.partitionBy("name", "salt").orderBy(*order)
        hub = F.first(F.struct("doc_id", "n", "comp")).over(w)
        met = live.select("name", "doc_id", "n", "rare", "c", "comp", salt).select("doc_id", "n", "comp", hub.alias("p"))
        met = met.where("p.comp <> comp").select(
            F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("p.doc_id").alias("y"), F.col("p.n").alias("ny")
        )
        met = met.where(f"{self.needed('nx', 'ny')} <= least(nx, ny)")
        best = met.groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("k"))
        # A pair that meets in few groups is not worth a comparison here; the last stage looks at all.
        best = best.where(f"4 * k >= nx - div({self.percent} * nx + 99, 100) + 1")
        best = best.groupBy("x", "nx").agg(F.max_by(F.struct("y", "ny"), F.struct("k", "y")).alias("t"))
        return best.select(
            F.least("x", "t.y").alias("a"),
            F.greatest("x", "t.y").alias("b"),
            F.when(F.col("x") < F.col("t.y"), F.col("nx")).otherwise(F.col("t.ny")).alias("na"),
            F.when(F.col("x") < F.col("t.y"), F.col("t.ny")).otherwise(F.col("nx")).alias("nb"),
        ).distinct()

    def all_pairs(self, live: DataFrame) -> DataFrame:
        """Every pair of different components that may reach the threshold.

        A set lacks at most n - need names of the other.  So the first shared
        name of a linked pair stands at n - need or before in both, and common
        names count only there: a set with more rare names than that never
        meets others by what all have.  Of the rare names in both prefixes, the
        set whose part ends first in the order lacks no more either.
        """
        a = live.select("name", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "at", "rare", "comp")])
        b = live.select("name", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "at", "rare", "comp")])
        need = self.needed("n_a", "n_b")
        early = f"at_a <= n_a - {need} and at_b <= n_b - {need}"
        met = a.join(b, "name").where(
            f"doc_id_a < doc_id_b and comp_a <> comp_b and {need} <= least(n_a, n_b) and (at_a < rare_a or {early})"
        )
        pairs = met.groupBy(*[f"{c}_{s}" for s in "ab" for c in ("doc_id", "n", "rare")]).agg(
            F.count_if(F.expr(early)).alias("early"), F.count_if(F.expr("at_a < rare_a")).alias("rare"), F.count_if(F.expr("at_a >= rare_a")).alias("common")
        )
        enough = f"rare >= least(rare_a - n_a, rare_b - n_b) + {need}"
        return pairs.where(f"early > 0 and (common > 0 or {enough})").select(
            F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")
        )

    def components(self, dealt: DataFrame) -> DataFrame:
        labels = None
        for k in range(STAR_ROUNDS + 1):
            live, rows, cross, used = self.open_groups(dealt, labels)
            if rows == 0:
                break
            last = k == STAR_ROUNDS or k > 0 and cross <= rows
            pairs = self.scratch.cut(self.all_pairs(live) if last else self.star_pairs(live, k))
            self.scratch.drop(*used)
            links = known = self.verify(pairs)
            if labels is not None:  # what is known is a star for each component
                links = links.union(labels.where("node <> component"))
            before, labels = labels, connected_components(links, self.scratch)
            self.scratch.drop(pairs, known, *([before] if before is not None else []))
            if last:
                break
        if labels is None:
            return self.spark.createDataFrame([], "node long, component long")
        return labels


def ngram_jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id of every row.

    Two documents link when 100 * intersection >= percent * union.
    """
    if n < 1 or not 50 <= percent <= 100:
        raise ValueError("n must be 1 at least and percent between 50 and 100")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _Join(docs, n, percent)
    cut = run.scratch.cut
    common = spark.sparkContext.broadcast(run.common_names())
    summary = cut(docs.mapInArrow(_summaries(n, percent, common), "doc_id long, n long, sig binary, prefix binary, rare int"))
    classes = summary.where("doc_id is not null and n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("head"), F.min_by(F.struct("n", "prefix", "rare"), "doc_id").alias("p")
    )
    first = cut(classes.select(F.col("head").alias("doc_id"), "p.n", "p.prefix", "p.rare").mapInArrow(_first_names, "name long, doc_id long, n int, at int, rare int"))
    shared = first.groupBy("name").agg(F.count("*").cast("int").alias("c")).where("c > 1")
    dealt = cut(first.join(shared, "name"))
    run.scratch.drop(first)
    labels = run.components(dealt)
    run.scratch.drop(dealt)
    return (
        summary.select("doc_id", F.col("n").alias("n_shingles"), "sig")
        .join(classes.select("sig", "head"), "sig", "left")
        .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")))
        .join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
