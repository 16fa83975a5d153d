"""HTML extraction, mixing and the pipeline."""

import collections

import numpy as np
import pytest

from sparkloom.llm.html_blocks import PageMaker, blocks_of
from sparkloom.llm.html_extraction import BATCH, Labeller, extract_main_text, features, main_texts, trained
from sparkloom.llm.mixing import dealt_rows, mix_sources, source_targets
from sparkloom.llm.scratch import Scratch


def test_blocks():
    page = (
        "<html><head><title>no</title></head><body><script>var t='</p>'</script><nav><ul><li><a href=x>Home</a><li>Two</ul></nav>"
        "<article class='Post main'><h1>T&amp;x</h1><p>a <b>b</b>c<br>d\n e<p>f&nbsp;g<!-- no --></article>tail"
    )
    got = [(b.text, b.path[-1], b.links) for b in blocks_of(page)]
    assert [g[0] for g in got] == ["Home", "Two", "T&x", "a bc d e", "f g", "tail"]
    assert got[0][2] == 1 and got[1][2] == 0
    assert ".post" in blocks_of(page)[3].path and "nav" not in blocks_of(page)[3].path
    assert blocks_of(None) == blocks_of("") == blocks_of("<p></p>") == []
    assert [b.text for b in blocks_of("a < b <p x='1>2'>c <unclosed")] == ["a < b", "c <unclosed"]


def test_blocks_take_linear_time():
    """Hostile pages of about 1 MB, and twice as much takes about twice as long."""
    import time

    pieces = ["<a ", "<div>x", "<svg>", "<! ", "<a \"", "<a '>'", "<select>", "</select", "<x><td>y", "<li>x", "&#" + "9" * 50 + ";", "<p>x</q>", "<div class=\"a b\">x", "<", "<!--", "<ul><li>x"]
    for x in pieces:
        took = []
        for n in (500_000, 1_000_000):
            began = time.thread_time()
            blocks_of(x * (n // len(x)) + ">")
            took.append(time.thread_time() - began)
        assert took[1] < 10 and took[1] < 4 * took[0] + 0.5, x


def test_text_inside_formulas_and_fallbacks_stays():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><title>t</title><text>drawn</text></svg>.</p><noscript><p>plain</p></noscript><object>other</object></article>"
    assert [b.text for b in blocks_of(page)] == ["Let x=2 be drawn.", "plain", "other"]
    assert "noscript" in blocks_of(page)[1].path
    assert [b.text for b in blocks_of("&#0000000065; &#" + "1" * 5000 + ";")] == ["A \ufffd"]


def test_long_pages_in_pieces():
    """A page read in pieces gets the labels of one read whole."""
    maker = PageMaker(9)
    blocks = [b for _ in range(12) for b in maker.labelled()[0]]
    whole = trained().forward(features([blocks]), [len(blocks)])
    assert np.allclose(trained().long_page(blocks, 7), whole, atol=1e-4)
    assert main_texts(trained(), [blocks, blocks[:3]], 7)[0] == " ".join(b.text for b, c in zip(blocks, whole, strict=True) if c >= 0.5)


def test_gradients():
    """Analytic against numeric derivatives."""
    r = np.random.default_rng(0)
    model = Labeller(1)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    x, lengths, y = r.standard_normal((9, model.p["wf"].shape[0])) * 0.3, [4, 3, 2], r.integers(0, 2, 9).astype(float)

    def loss():
        c = model.forward(x, lengths)
        return -np.mean(y * np.log(c) + (1 - y) * np.log(1 - c))

    grad = model.gradients(x, lengths, y)
    for name in ("wf", "ub", "cf", "o"):
        at = tuple(r.integers(0, n) for n in model.p[name].shape)
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-4
        up = loss()
        model.p[name][at] = keep - 1e-4
        down = loss()
        model.p[name][at] = keep
        assert abs((up - down) / 2e-4 - grad[name][at]) < 1e-4


def test_held_out_accuracy():
    pages = [p for p in (PageMaker(77).labelled() for _ in range(BATCH)) if p[0]]
    maker = PageMaker(78)
    pages += [p for p in (maker.labelled() for _ in range(200)) if p[0]]
    chance = trained().forward(features([b for b, _ in pages]), [len(b) for b, _ in pages])
    assert np.mean((chance >= 0.5) == np.array([v for _, y in pages for v in y])) > 0.98


def test_extraction(spark):
    page = (
        '<body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
        "<article><h1>Head</h1><p>First   part &amp; more.</p><p>Second part of the text.</p></article>"
        '<section id="comments"><div class="comment"><p>I disagree with it.</p></div></section><aside class="sidebar"><p>Side</p></aside><footer>&copy; us</footer></body>'
    )
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", "")], "page_id bigint, url string, html string").selectExpr("*", "'x' as text")
    got = sorted((r.page_id, r.text) for r in extract_main_text(rows).collect())
    assert got == [(1, "Head First part & more. Second part of the text."), (2, ""), (3, ""), (3, "")]
    assert extract_main_text(rows.where("false")).count() == 0
    assert main_texts(trained(), [[], blocks_of(page)])[0] == ""


def plain_targets(sizes, share, weights, most):
    """The rule in plain Python: targets above their limit stop there, the rest is shared again."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not above:
            return target | {s: unit * weight[s] for s in free}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def test_targets(spark):
    def targets(sizes):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
        return {r.source: r.target for r in source_targets(df, Scratch(spark, "t"), 1.5, (3, 1, 2), 2).collect()}

    # a, b, é, null get 3, 1, 2, 3; a stops at 20 and é at 0; the rest is shared 1 to 3, null stops at 100.
    got = targets({"b": 100, None: 50, "a": 10, "é": 0})
    assert got == pytest.approx({"a": 20.0, "é": 0.0, None: 100.0, "b": 120.0}) and sum(got.values()) == pytest.approx(1.5 * 160)
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0.0}
    many = {f"s{i * 7919 % 997}": i * i % 1013 for i in range(400)} | {None: 3}
    assert targets(many) == pytest.approx(plain_targets(many, 1.5, (3, 1, 2), 2))


def plain_rounding(rows):
    """Pivotal rounding of (size, part, chance) in order, with exact fractions of a document passed on."""
    part, held = [p for _, p, _ in rows], None
    for j, (size, p, chance) in enumerate(rows):
        if size == 0 or not 1e-12 < p < 1 - 1e-12:
            part[j] = round(p)
            continue
        if held is None:
            held = j
            continue
        up, down = min(rows[held][0] * (1 - part[held]), size * part[j]), min(rows[held][0] * part[held], size * (1 - part[j]))
        mass = up if chance * (up + down) < down else -down
        part[held], part[j] = part[held] + mass / rows[held][0], part[j] - mass / size
        between = [k for k in (held, j) if 1e-12 < part[k] < 1 - 1e-12]
        held = between[0] if between else None
    return part, held


def test_mixing_against_plain_rounding(spark, table):
    """Every document's copies, with one chunk a source, equal those of plain rounding by the same random numbers."""
    rows = [(i, "w " * (1 + i * i % 41), "xyz"[i % 3]) for i in range(150)] + [(None, "a b c", "x")] * 40
    got = mix_sources(table(rows)).collect()
    copies = collections.Counter((r.doc_id, r.copies) for r in got)
    rate = {r.source: r.target / r.source_size for r in got}
    sized = spark.createDataFrame([(i, s, len(t.split())) for i, t, s in rows], "doc_id long, source string, size long")
    plan = spark.createDataFrame([(s, x, 1) for s, x in rate.items()], "p_source string, rate double, chunks long")
    dealt = dealt_rows(sized, plan, 1).collect()
    want = collections.Counter()
    for s in "xyz":
        own = sorted((r for r in dealt if r.source == s), key=lambda r: (-r["size"], r.doc_id is None, r.doc_id or 0, r.nr))
        part, held = plain_rounding([(r["size"], r.part, r.chance) for r in own])
        for k, r in enumerate(own):
            if k != held:
                want[r.doc_id, int(rate[s]) + round(part[k])] += 1
    assert sum(want.values()) >= len(rows) - 3 and not want - copies


@pytest.mark.parametrize("chunk", [5, 10_000])
def test_mixing(table, chunk):
    rows = [(i, "w " * (i % 37), ["x", "y", None, "z"][min(i % 7, 3)]) for i in range(600)] + [(None, "a b", "x"), (None, "a b", "x"), (7, None, "y")]
    got = mix_sources(table(rows), chunk=chunk).collect()
    again = mix_sources(table(rows).repartition(7), chunk=chunk).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert len(got) == len(rows)
    sums = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        s = sums[r.source]
        s[0] += r["size"]
        s[1], s[2] = r.source_size, r.target
        s[3] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    for size, source_size, target, taken in sums.values():
        assert size == source_size and abs(taken - target) <= 40
    assert abs(sum(s[2] for s in sums.values()) - 1.5 * sum(s[0] for s in sums.values())) < 1e-6


def test_mixing_is_unbiased(table):
    """Over many seeds a document's copies average its source's rate."""
    rows = [(i, "w " * (5 + i % 3), "ab"[i % 2]) for i in range(30)]
    total, rate = collections.Counter(), {}
    for seed in range(12):
        for r in mix_sources(table(rows), chunk=4, seed=seed).collect():
            total[r.source] += r.copies
            rate[r.source] = r.target / r.source_size
    for s in "ab":
        assert abs(total[s] / (12 * 15) - rate[s]) < 0.08


def test_mixing_edges(table):
    assert mix_sources(table([])).count() == 0
    got = mix_sources(table([(1, None, None), (2, "", "s")])).collect()
    assert [r.taken for r in got] == [0, 0]


def test_pipeline(spark, tmp_path, table):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import random

    r = random.Random(5)
    vocab = [f"word{i}" for i in range(3000)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    text = [f"{prose(40)}\n{prose(60)}\n{prose(50)}" for _ in range(30)]
    bench = prose(30)
    near = text[0].split(" ")
    near[20], near[75], near[120] = "other", "changed", "again"
    one_line = text[1].replace("\n", " ").split(" ")
    swapped = list(one_line)
    swapped[3] = "swapped"
    rows = [(i, t) for i, t in enumerate(text)]
    rows += [(40, text[2]), (41, " ".join(one_line)), (42, " ".join(swapped)), (43, f"{prose(30)} {bench} {prose(30)}"), (44, "few words"), (45, "a b c " * 20), (46, None), (None, text[3])]
    docs = table([(i, t, "s" + str((i or 0) % 3)) for i, t in rows], extra=False).selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = {x.doc_id for x in now.collect()}
        assert k == 4 or now.columns == docs.columns
    clean = set(range(30))
    assert kept["quality_rules"] == clean | {40, 41, 42, 43}
    assert 40 not in kept["line_dedup"] and kept["line_dedup"] >= clean | {43}
    assert kept["ngram_jaccard_join"] >= clean and not {41, 42} <= kept["ngram_jaccard_join"]
    assert kept["decontamination"] == kept["ngram_jaccard_join"] - {43}
    assert kept["mixing"] <= kept["decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {(x.doc_id, x.copies) for x in final.collect()} == {(x.doc_id, x.copies) for x in now.collect()}


def test_pipeline_stages_on_odd_tables(spark, tmp_path, table):
    """Every stage on an empty table, with clashing names, nulls and repeated rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "nothing of these documents")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (2, other, "b"), (2, f"{other} more", "b"), (3, None, None), (4, "", "a")]
    docs = table(rows).selectExpr("*", "'en' as lang", "cast(length(text) as bigint) as n_chars", "'x' as target", "'y' as taken", "'z' as _n_removed_lines")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), str(tmp_path))
        out = stage(spark, docs, str(tmp_path))
        assert empty.count() == 0 and len(set(out.columns)) == len(out.columns)
        got[name] = sorted((r.doc_id, r.text or "") for r in out.collect())
        if name != "mixing":
            assert empty.columns == out.columns == docs.columns and {r.t for r in out.collect()} <= {"x"}
    assert got["quality_rules"] == [(1, long), (1, long), (2, other), (2, f"{other} more")]
    assert [r for r in got["line_dedup"] if r[0] == 1] == [(1, long)] * 2
    assert got["ngram_jaccard_join"] == [(1, long), (2, other), (3, ""), (4, "")]
    assert got["decontamination"] == sorted((i, t or "") for i, t, _ in rows)
    taken = collections.Counter(r[0] for r in got["mixing"])
    assert set(taken) <= {1, 2, 4} and taken[1] <= 2 and taken[2] <= 2 and taken[4] <= 1
