"""HTML extraction by a recurrent block labeller (operator 5).

A page is cut into leaf blocks; each block is a vector of its tag path (names,
classes and ids of the elements above it, hashed), of its words (hashed) and of
a few measures.  A bidirectional LSTM in numpy reads the blocks of a page in
both directions, so every block is labelled with the whole document in view;
the main text is the blocks labelled so, joined by one space.

The model is trained here, on ``TRAIN_PAGES`` made-up pages of many layouts
(``html_blocks.PageMaker``), once for each driver process; seed and data are
fixed, so the weights are too.  They are small (under 1 MB) and broadcast.

Null and empty pages give an empty text.  Character references are decoded,
white space inside a block becomes one space, nothing else is dropped or cut.
Rows are judged each by itself, so repeated rows and ids and ties need no care;
an empty table gives an empty result; extra columns may have any name and are
ignored.  The time is proportional to the length of a page, whatever it holds;
a very long page is labelled in pieces, so beside its blocks it takes memory for
``STEPS`` vectors alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.html_blocks import PATH, Block, PageMaker, blocks_of
from sparkloom.llm.textkernel import Words, row_bytes

WORDS, MEASURES, HIDDEN = 32, 8, 24
INPUT = 2 * PATH + WORDS + MEASURES
TRAIN_PAGES, EPOCHS, BATCH = 1500, 8, 25
#: Blocks that one forward pass holds; a longer page is read in pieces of so many, with the state carried on.
STEPS = 20_000


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row for each block of all pages, in order."""
    place = np.concatenate([np.arange(len(p)) for p in pages]) if pages else np.zeros(0)
    total = np.concatenate([np.full(len(p), len(p)) for p in pages]) if pages else np.zeros(0)
    return _vectors([b for p in pages for b in p], place, total)


def _vectors(flat: list[Block], place: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows of blocks that stand at ``place`` in pages of ``total`` blocks."""
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    raw, offsets = row_bytes(pa.array([b.text for b in flat], pa.string()))
    words = Words(raw, offsets, lower=True)
    bucket = (words.hashes() % np.uint64(WORDS)).astype(np.int64)
    count = np.bincount(words.row_of() * WORDS + bucket, minlength=len(flat) * WORDS).reshape(-1, WORDS)
    n = np.maximum(words.count, 1)
    x[:, 2 * PATH : 2 * PATH + WORDS] = count / n[:, None]
    size = np.diff(offsets)
    x[:, -1] = np.log1p(size) / 5
    x[:, -2] = np.log1p(words.count) / 5
    x[:, -3] = [b.links for b in flat]
    x[:, -4], x[:, -5] = place / total, 1 / (1 + place)
    x[:, -6] = np.log1p(total) / 5
    x[:, -7] = np.add.reduceat(np.r_[(raw == 46) | (raw == 44), 0].astype(np.float32), np.minimum(offsets[:-1], len(raw))) / np.maximum(size, 1)
    x[:, -8] = 1
    masks = np.frombuffer(b"".join([b.masks() for b in flat]), np.uint8)
    x[:, : 2 * PATH] = np.unpackbits(masks, bitorder="little").reshape(len(flat), 2 * PATH)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM over blocks with a logistic output for each."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = (r.standard_normal((INPUT, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p["u" + d] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            self.p["c" + d] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        self.p["o"] = (r.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _run(self, z: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """z: (steps, pages, 4 * HIDDEN) inputs; returns hidden states by step."""
        steps, n = mask.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ self.p["u" + d]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            a = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * a
            s = np.tanh(c2)
            h2 = o * s
            if keep is not None:
                keep.append((t, h, c, i, f, o, a, s, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[t] = h
        return out

    def _pad(self, x: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps, n = max(lengths), len(lengths)
        at = np.concatenate([np.arange(k) * n + j for j, k in enumerate(lengths)])
        mask = np.zeros(steps * n, bool)
        mask[at] = True
        return at, mask.reshape(steps, n), np.zeros((steps * n, 4 * HIDDEN), np.float32)

    def forward(self, x: np.ndarray, lengths: list[int], keep: dict | None = None) -> np.ndarray:
        """Probability of main text for every block; ``lengths`` are the blocks of each page."""
        at, mask, room = self._pad(x, lengths)
        hidden = []
        for d in "fb":
            z = room.copy()
            z[at] = x @ self.p["w" + d] + self.p["c" + d]
            steps = None if keep is None else keep.setdefault(d, [])
            hidden.append(self._run(z.reshape(*mask.shape, -1), mask, d, steps).reshape(-1, HIDDEN)[at])
        hidden = np.concatenate(hidden, 1)
        if keep is not None:
            keep |= {"at": at, "mask": mask, "hidden": hidden}
        return _sigmoid(hidden @ self.p["o"] + self.p["ob"])

    def long_page(self, blocks: list[Block], steps: int) -> np.ndarray:
        """Probabilities for one page, read in pieces forward and then backward, with the state carried on."""
        total, logit = np.full(len(blocks), len(blocks)), np.full(len(blocks), self.p["ob"][0], np.float32)
        starts = range(0, len(blocks), steps)
        for k, d in enumerate("fb"):
            h = c = np.zeros(HIDDEN, np.float32)
            u, o = self.p["u" + d], self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            for lo in starts if d == "f" else reversed(starts):
                part = blocks[lo : lo + steps]
                z = _vectors(part, np.arange(lo, lo + len(part)), total[lo : lo + len(part)]) @ self.p["w" + d] + self.p["c" + d]
                for t in range(len(part)) if d == "f" else range(len(part) - 1, -1, -1):
                    g = z[t] + h @ u
                    gate = _sigmoid(g[: 3 * HIDDEN])
                    c = gate[HIDDEN : 2 * HIDDEN] * c + gate[:HIDDEN] * np.tanh(g[3 * HIDDEN :])
                    h = gate[2 * HIDDEN :] * np.tanh(c)
                    logit[lo + t] += h @ o
        return _sigmoid(logit)

    def gradients(self, x: np.ndarray, lengths: list[int], y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        e = (self.forward(x, lengths, keep) - y).astype(np.float32) / len(y)
        at, mask = keep["at"], keep["mask"]
        grad = {"o": keep["hidden"].T @ e, "ob": e.sum(keepdims=True)}
        for k, d in enumerate("fb"):
            into = np.zeros((mask.size, HIDDEN), np.float32)
            into[at] = np.outer(e, self.p["o"][k * HIDDEN : (k + 1) * HIDDEN])
            into = into.reshape(*mask.shape, HIDDEN)
            dz = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            u = self.p["u" + d]
            du = np.zeros_like(u)
            dh = dc = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, a, s, m in reversed(keep[d]):
                dh = dh + into[t]
                ds = dh * o * (1 - s * s) + dc
                g = np.concatenate([ds * a * i * (1 - i), ds * c * f * (1 - f), dh * s * o * (1 - o), ds * i * (1 - a * a)], 1) * m
                dz[t] = g
                du += h.T @ g
                dh = np.where(m, g @ u.T, dh)
                dc = np.where(m, ds * f, dc)
            rows = dz.reshape(-1, 4 * HIDDEN)[at]
            grad |= {"w" + d: x.T @ rows, "c" + d: rows.sum(0), "u" + d: du}
        return grad


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """The labeller, fitted with Adam to made-up pages."""
    maker = PageMaker(seed)
    data = [maker.labelled() for _ in range(pages)]
    data = sorted((d for d in data if d[0]), key=lambda d: len(d[0]))
    batches = []
    for k in range(0, len(data), BATCH):
        some = data[k : k + BATCH]
        batches.append((features([b for b, _ in some]), [len(b) for b, _ in some], np.float32([v for _, y in some for v in y])))
    model, r = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - 0.9 * epoch / max(1, epochs - 1))
        for k in r.permutation(len(batches)):
            step += 1
            for name, g in model.gradients(*batches[k]).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] = model.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def main_texts(model: Labeller, pages: list[list[Block]], steps: int = STEPS) -> list[str]:
    """The main text of each page."""
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    k = 0
    while k < len(order):
        some = [order[k]]
        while k + len(some) < len(order) and len(pages[order[k + len(some)]]) * (len(some) + 1) <= steps:
            some.append(order[k + len(some)])
        k += len(some)
        blocks = [pages[i] for i in some]
        if len(blocks[0]) > steps:
            chance = model.long_page(blocks[0], steps)
        else:
            chance = model.forward(features(blocks), [len(b) for b in blocks])
        at = 0
        for i, b in zip(some, blocks, strict=True):
            out[i] = " ".join(x.text for x, c in zip(b, chance[at : at + len(b)], strict=True) if c >= 0.5)
            at += len(b)
    return out


def _extract(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few long pages or many short ones at a time: about 8 MB of them.
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) >> 23
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                texts = main_texts(shared.value, [blocks_of(x) for x in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLES: dict[str, str] = {}
