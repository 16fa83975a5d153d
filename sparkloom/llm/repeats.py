"""Repeated windows of a table of texts, found without comparing pairs.

Shared by the byte-level (op 3) and the word-level (op 6) operator.  A window
is W consecutive units (bytes or words) of one document.  The stages:

1. Documents with the same unit sequence are one class; only the document with
   the smallest id goes on.
2. Sampled positions: every window is represented by its smallest k-gram, so
   about 2 / (W - k + 2) of all positions are looked at.  A gram that occurs
   once is dropped together with all windows that it represents; equal windows
   have equal grams, so no repeated window is lost.
3. Runs: the windows with one and the same gram are neighbours.  The span that
   a run covers is ranked as a whole; a run that has been seen earlier is
   settled by one row.
4. Runs whose gram stands in several different spans are taken apart into cells
   of a few windows, aligned to the gram.  The core of a cell is what all its
   windows share: a core that stays single ends there, a span seen earlier is
   settled, and only cells whose core stands in several spans go on.
5. In these each window is named by its rank pair (name of the first half, name
   of the half that starts W/2 later), sorted and reranked; pairs that stay
   single are dropped.

Every step is a map-side combined aggregate or an equi-join whose one side has
one row for a key, so that a passage in a third of all documents costs a row
for each occurrence and never pairs of them.  No result is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.scratch import Scratch
from sparkloom.llm.textkernel import Units, Words, byte_units, chunks, row_bytes, signed, word_units

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Kind:
    """What a unit is, how long a window is, and which occurrences count.

    within: an earlier start in the same document counts too; cells: numbers of
    windows into which open runs are taken apart, down to 1.
    """

    words: bool
    window: int
    gram: int
    within: bool
    cells: tuple[int, ...]


def _parts(batch: pa.RecordBatch, kind: Kind) -> Iterator[tuple[int, int, Units, Words | None, np.ndarray, np.ndarray]]:
    raw, offsets = row_bytes(batch.column("text"))
    for lo, hi in chunks(offsets):
        own = raw[offsets[lo] : offsets[hi]]
        off = offsets[lo : hi + 1] - offsets[lo]
        if kind.words:
            words = Words(own, off)
            yield lo, hi, word_units(words), words, own, off
        else:
            yield lo, hi, byte_units(own, off), None, own, off


def _kept_bytes(words: Words | None, own: np.ndarray, off: np.ndarray, i: int, keep: np.ndarray | None) -> bytes:
    """The document's remaining bytes, or its remaining words joined by one space."""
    if words is None:
        part = own[off[i] : off[i + 1]]
        return (part if keep is None else part[keep]).tobytes()
    text = own[off[i] : off[i + 1]].tobytes().split()
    return b" ".join(text if keep is None else [w for w, k in zip(text, keep, strict=True) if k])


def _summaries(kind: Kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, units, words, own, off in _parts(batch, kind):
                _, _, row, gram, _ = units.runs(kind.window, kind.gram)
                border = np.searchsorted(row, np.arange(hi - lo + 1))
                sig, sha, found, own_twice = [], [], [], []
                for i in range(hi - lo):
                    kept = _kept_bytes(words, own, off, i, None)
                    sig.append(hashlib.blake2b(kept, digest_size=16).digest())
                    sha.append(hashlib.sha256(kept).hexdigest())
                    some, times = np.unique(gram[border[i] : border[i + 1]], return_counts=True)
                    found.append(some.tobytes())
                    own_twice.append((times > 1).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(units.offsets).astype(np.int64)),
                        pa.array(sig, pa.binary()),
                        pa.array(sha, pa.string()),
                        pa.array(found, pa.binary()),
                        pa.array(own_twice, pa.binary()),
                    ],
                    ["doc_id", "n_units", "sig", "sha", "grams", "twice"],
                )

    return run


def _explode_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = row_bytes(batch.column("grams"))
        gram = np.frombuffer(raw.tobytes(), np.int64)
        twice = row_bytes(batch.column("twice"))[0].astype(bool)
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.diff(offsets) // 8)
        for i in range(0, len(gram), 1 << 18):
            d = slice(i, i + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(gram[d]), pa.array(ids[d]), pa.array(twice[d])], ["gram", "doc_id", "twice"])


def _run_rows(kind: Kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            wanted = batch.column("wanted")
            for lo, hi, units, _, _, _ in _parts(batch, kind):
                first, last, row, gram, q = units.runs(kind.window, kind.gram)
                border = np.searchsorted(row, np.arange(hi - lo + 1))
                keep = np.zeros(len(row), bool)
                for i in range(hi - lo):
                    some = np.asarray(wanted[lo + i].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                    keep[border[i] : border[i + 1]] = np.isin(gram[border[i] : border[i + 1]], some)
                first, last, row, gram, q = first[keep], last[keep], row[keep], gram[keep], q[keep]
                yield _rows(ids[lo + row], units, row, first, last, q, gram, units.spans(first, last + kind.window, 1))

    return run


#: A run or cell of windows: first start and number of starts, how far behind
#: the first start its gram begins, what all its windows share, what it covers.
ROW = "doc_id long, at int, n int, off int, core long, span long"


def _rows(ids, units: Units, row, first, last, q, core, span) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids),
            pa.array((first - units.offsets[row]).astype(np.int32)),
            pa.array((last - first + 1).astype(np.int32)),
            pa.array((q - first).astype(np.int32)),
            pa.array(signed(core)),
            pa.array(signed(span)),
        ],
        ["doc_id", "at", "n", "off", "core", "span"],
    )


def _cell_rows(kind: Kind, size: int) -> Callable:
    """Open runs taken apart into cells of at most ``size`` windows, aligned to the gram."""
    half = kind.window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            runs = batch.column("runs")
            count = np.diff(runs.offsets.to_numpy()) if len(runs) else np.zeros(0, np.int64)
            flat = runs.flatten()
            at, n, off = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False), np.int64) for k in range(3))
            owner = np.repeat(np.arange(len(runs)), count)
            for lo, hi, units, _, _, _ in _parts(batch, kind):
                own = slice(*np.searchsorted(owner, [lo, hi]))
                if own.start == own.stop:
                    continue
                row = np.repeat(owner[own] - lo, n[own])
                step = np.arange(len(row)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                s = np.repeat(at[own], n[own]) + units.offsets[row] + step
                q = np.repeat(at[own] + off[own], n[own]) + units.offsets[row]
                cell = (q - s) // size
                cut = np.flatnonzero((q[1:] != q[:-1]) | (cell[1:] != cell[:-1]) | (s[1:] != s[:-1] + 1)) + 1
                a, b = np.r_[0, cut], np.r_[cut, len(s)] - 1
                first, last, row, q, cell = s[a], s[b], row[a], q[a], cell[a]
                if size == 1:
                    core, span = units.spans(first, first + half, 0), units.spans(first + half, first + kind.window, 1)
                else:  # windows of a full cell start from q - cell * size - size + 1 to q - cell * size
                    low = q - cell * size
                    core = units.spans(low, low - size + 1 + kind.window, 0)
                    span = units.spans(first, last + kind.window, 1)
                for c in range(0, len(a), 1 << 18):
                    d = slice(c, c + (1 << 18))
                    yield _rows(ids[lo + row[d]], units, row[d], first[d], last[d], q[d], core[d], span[d])

    return run


def span_masks(spans: list, window: int, n: int) -> np.ndarray:
    """Mask of the units covered by runs of windows (at: first start, n: starts)."""
    mark = np.zeros(n + 1, np.int64)
    for s in spans:
        mark[s["at"]] += 1
        mark[min(n, s["at"] + s["n"] - 1 + window)] -= 1
    return np.cumsum(mark[:-1]) > 0


def _verdicts(kind: Kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            removed, count, sha, total, edges = [], [], [], [], []
            for lo, hi, units, words, own, off in _parts(batch, kind):
                for i in range(hi - lo):
                    n = int(units.offsets[i + 1] - units.offsets[i])
                    gone = span_masks(spans[lo + i].as_py(), kind.window, n)
                    step = np.diff(np.r_[0, gone.astype(np.int8), 0])
                    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    removed.append(int(gone.sum()))
                    count.append(len(begin))
                    total.append(n)
                    edges.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)])
                    sha.append(hashlib.sha256(_kept_bytes(words, own, off, i, ~gone)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(removed, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array(edges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_removed", "n_spans", "kept_sha256", "removed_spans"],
            )

    return run


def remove_repeats(docs: DataFrame, kind: Kind, name: str) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256, removed_spans of every row.

    docs: columns doc_id (integer) and text; others are ignored.  A null text
    is empty.  A row without doc_id is judged alone: nothing of it is removed
    and it removes nothing.  Rows repeating a doc_id with the same text get the
    same verdict each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = scratch.cut(
        docs.mapInArrow(_summaries(kind), "doc_id long, n_units long, sig binary, sha string, grams binary, twice binary")
    )
    head = (
        summary.where(f"doc_id is not null and n_units >= {kind.window}")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("head"), F.min_by(F.struct("grams", "twice"), "doc_id").alias("g"))
    )
    grams = head.select(F.col("head").alias("doc_id"), "g.grams", "g.twice").mapInArrow(
        _explode_grams, "gram long, doc_id long, twice boolean"
    )
    repeated = F.min("doc_id") < F.max("doc_id")
    many = grams.groupBy("gram").agg((repeated | F.max("twice") if kind.within else repeated).alias("again"))
    wanted = (
        grams.select("gram", "doc_id")
        .join(many.where("again").select("gram"), "gram")
        .groupBy("doc_id")
        .agg(F.collect_list("gram").alias("wanted"))
    )
    # The texts that can hold a repeat at all; what follows reads only these.
    texts = scratch.cut(docs.join(wanted, "doc_id").dropDuplicates(["doc_id"]))
    later = "doc_id > f_doc or doc_id = f_doc and at > f_at" if kind.within else "doc_id > f_doc"
    rows = scratch.cut(texts.mapInArrow(_run_rows(kind), ROW))
    settled = []
    for size in (*kind.cells, 0):
        ranked = rows.groupBy("core", "span").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("times"))
        ranked = scratch.cut(ranked)
        several = ranked.groupBy("core").agg(F.count("*").alias("n_spans")).where("n_spans > 1").select("core", F.lit(True).alias("several"))
        ranks = ranked.join(several, "core", "left").where("times > 1 or several").select(
            "core", "span", F.col("first.doc_id").alias("f_doc"), F.col("first.at").alias("f_at"), F.coalesce("several", F.lit(False)).alias("several")
        )
        judged = scratch.cut(
            rows.join(ranks, ["core", "span"]).select("doc_id", "at", "n", "off", F.expr(later).alias("settled"), "several").where("settled or several")
        )
        scratch.drop(rows, ranked)
        settled.append(judged.where("settled").select("doc_id", "at", "n"))
        if not size:
            break
        open_runs = judged.where("not settled").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "off")).alias("runs"))
        rows = scratch.cut(texts.select("doc_id", "text").join(open_runs, "doc_id").mapInArrow(_cell_rows(kind, size), ROW))
    spans = reduce(DataFrame.unionByName, settled).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    verdict = scratch.cut(
        texts.select("doc_id", "text").join(spans, "doc_id").mapInArrow(
            _verdicts(kind),
            "doc_id long, n_removed long, n_spans long, kept_sha256 string, removed_spans array<struct<start:long,end:long>>",
        )
    )
    scratch.drop(texts)
    copy = F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_units").alias("end")))
    return (
        summary.select("doc_id", "n_units", "sig", "sha")
        .join(head.select("sig", "head"), "sig", "left")
        .join(verdict, "doc_id", "left")
        .select(
            "doc_id",
            "n_units",
            F.when(copy, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(copy, whole).otherwise(F.coalesce("removed_spans", F.expr("array()").cast("array<struct<start:long,end:long>>"))).alias("removed_spans"),
        )
    )
