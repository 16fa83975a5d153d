"""Near duplicates and repeated passages against brute force, and edge cases."""

import collections
import hashlib
import re

import pytest

from sparkloom.llm.components import connected_components
from sparkloom.llm.ngram_join import ngram_jaccard_join
from sparkloom.llm.scratch import Scratch
from sparkloom.llm.substring_dedup import substring_dedup
from sparkloom.llm.suffix_dedup import suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    g = Groups(sets)
    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                g.join(ids[x], ids[y])
    return {i: (len(s), g.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(table, texts, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(table(texts), n, percent).collect()}
    assert got == jaccard_groups(texts, n, percent)


def test_ngram_join_dense_group(table):
    """Many near copies and a common line, so that stars take several rounds and names are put last."""
    import random

    r = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    base, line = r.choices(vocab, k=90), " ".join(r.choices(vocab, k=12))
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(90)] = r.choice(vocab)
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, line + " " + " ".join(r.choices(vocab, k=40))) for i in range(60)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard_join(table(rows)).collect()}
    assert got == jaccard_groups(rows, 4, 85)


def test_ngram_join_edges(table):
    assert ngram_jaccard_join(table([])).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b C d e"), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(table(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3)], key=str)
    with pytest.raises(ValueError):
        ngram_jaccard_join(table([]), 0)


def removed(rows, window, units, join, within):
    """Brute force: (units, removed, spans, hash of the rest) by doc_id."""
    out, seen = {}, {}
    for i, t in sorted(rows):
        u = units(t or "")
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            k = tuple(u[p : p + window])
            first = seen.setdefault(k, (i, p))
            if first < (i, p) if within else first[0] < i:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(u), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(u, gone, strict=True) if not g])).hexdigest())
    return out


def as_rows(df, first):
    return {r.doc_id: (r[first], r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("length", [100, 24])
def test_suffix_dedup(table, texts, length):
    want = removed(texts, length, lambda t: list(t.encode()), bytes, True)
    assert as_rows(suffix_dedup(table(texts), length), "n_bytes") == want


@pytest.mark.parametrize("window", [50, 6])
def test_substring_dedup(table, texts, window):
    want = removed(texts, window, lambda t: WORD.findall(t), lambda w: " ".join(w).encode(), False)
    assert as_rows(substring_dedup(table(texts), window), "n_words") == want


@pytest.mark.parametrize("f", [suffix_dedup, substring_dedup])
def test_repeats_edges(table, f):
    assert f(table([])).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    got = collections.Counter((r.doc_id, r.n_removed > 0) for r in f(table([(1, long), (1, long), (None, long), (2, long), (3, None)])).collect())
    assert got == {(1, False): 2, (None, False): 1, (2, True): 1, (3, False): 1}
    spans = {r.doc_id: r.removed_spans for r in f(table([(1, long), (2, "head " + long)])).collect()}
    assert spans[1] == [] and len(spans[2]) == 1
    with pytest.raises(ValueError):
        f(table([]), 3)


def test_components(spark):
    import random

    r = random.Random(2)
    path = list(range(40))
    r.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(100 + i, 100) for i in range(20)] + [(7, 7), (200, 201), (201, 200)]
    g = Groups({x for p in links for x in p})
    for a, b in links:
        g.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {n: g.find(n) for n in g.up}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0
