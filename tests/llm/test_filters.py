"""Quality rules, line dedup, URL filters, PII and decontamination: brute force and edge cases."""

import collections
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm.decontamination import decontaminate
from sparkloom.llm.line_dedup import duplicate_lines, line_blocks, line_dedup
from sparkloom.llm.pii import KINDS, depseudonymize, pseudonymize
from sparkloom.llm.quality import quality_filter, quality_rules
from sparkloom.llm.url_filter import url_filter, url_host

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    hit = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts(table, texts):
    rows = [*texts, (90, "a b c d e a b c d e f"), (91, "# x\n# x\n\n|<>"), (92, "aaé bb\ncc\vdd\fee")]
    got = {r.doc_id: r for r in quality_rules(table(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_boilerplate(table):
    line, own = "all rights are reserved by us and so on every day", "unique words of this very document number {} are a few more"
    rows = [(i, f"{line}\n{own.format(i)} {i} {i + 1}", "a") for i in range(8)] + [(20, f"{line}\nshort", "a"), (21, line, "b"), (22, line, None), (23, line, "a")]
    rows += [(50 + i, f"{line}\n{own.format('copied')} and more", "a") for i in range(4)]
    rows += [(30 + i, f"copied text of some ten or more words in it\n{line}", "c") for i in range(9)]
    got = {r.doc_id: r for r in quality_rules(table(rows), min_docs=5, max_share=0.1).collect()}
    assert all(got[50 + i].kept and got[50 + i].n_boilerplate == 11 for i in range(4))
    assert all(got[i].kept and got[i].n_boilerplate == 11 for i in range(8))
    assert not got[20].kept and not got[23].kept and got[21].kept and got[22].kept
    assert all(got[30 + i].n_boilerplate == 21 and not got[30 + i].kept for i in range(9))  # nine documents hold both lines
    assert all(r.n_boilerplate == 0 for r in quality_rules(table(rows), min_docs=12, max_share=0.1).collect() if 30 <= r.doc_id < 50)
    kept = quality_filter(table(rows), min_docs=5, max_share=0.1)
    assert kept.columns == table(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_boilerplate_lines_are_removed(spark, table, monkeypatch):
    import corpus_pipeline
    from sparkloom.llm import quality

    line, own = "All rights  are reserved by us", "{0} unique words of this very document number {0} are a few more"
    rows = [(i, f"{line if i % 2 else line.lower()} \n\n{own.format(i)}\nthe end {i}", "a") for i in range(60)] + [(70, f"{line}\n{own.format(70)}", "b")]
    want = {i: f"\n{own.format(i)}\nthe end {i}" for i in range(60)} | {70: rows[-1][1]}
    assert {r.doc_id: r.text for r in quality_filter(table(rows)).collect()} == want
    docs = table(rows).withColumn("n_chars", F.length("text").cast("bigint"))
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in want.items()}
    monkeypatch.setattr(quality, "LOOKUP", 0)
    assert {r.doc_id: r.text for r in quality_filter(table(rows)).collect()} == want


def test_quality_edges(table):
    assert quality_rules(table([])).count() == 0 and quality_filter(table([])).count() == 0
    got = quality_rules(table([(None, None, None), (1, "", "s"), (1, "", "s")])).collect()
    assert len(got) == 3 and not any(r.kept for r in got)


def chained(*parts):
    """The 64-bit hash of a row of words, small ints and long arrays."""
    seed = 42
    for x in parts:
        for y in x if isinstance(x, list) else [x]:
            raw = y.encode() if isinstance(y, str) else y.to_bytes(8 if isinstance(x, list) else 4, "little", signed=True)
            seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (seed >> 63 << 64)


def line_features(norm):
    """Blocks and SimHash of a normalised line."""
    w = norm.split(" ")
    h, n = [(chained(x) % 2**64 >> 2) | (0 if len(x) >= 5 else 1 << 62) for x in w], len(w)
    at = [h.index(x) for x in sorted(set(h))[:8]]
    keys = {chained([h[i], [*h, 0][i + 1]], [*w, "", ""][i + 2][:1]) for i in at}
    if n < 8:
        keys |= {chained(3, h[:i] + h[i + 1 :]) for i in range(n + 1)}
    g = [x for x in h if x < 1 << 62]
    g = g if len(g) >= 5 else h
    return keys, sum((2 * sum(x >> b & 1 for x in g) > len(g)) << b for b in range(64))


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_line_dedup(table, texts):
    occurrences, nodes = [], {}
    for i, t in texts:
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            norm = re.sub("[\x20\x09-\x0d]+", " ", line).strip(" ").lower()
            if norm:
                occurrences.append((i, no, norm))
                nodes.setdefault(norm, line_features(norm) if norm.count(" ") >= 4 else (set(), 0))
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = list(nodes)
    for x in range(len(names)):
        for y in range(x):
            a, b = names[x], names[y]
            most = 0.1 * max(len(a), len(b))
            (ka, sa), (kb, sb) = nodes[a], nodes[b]
            if ka & kb and (sa ^ sb).bit_count() <= 26 and abs(len(a) - len(b)) <= most and distance(a, b) <= int(most + 1e-9):
                up[find(a)] = find(b)
    first, want = {}, collections.defaultdict(list)
    for i, no, n in sorted(occurrences):
        if first.setdefault(find(n), (i, no)) != (i, no):
            want[i].append(no)
    assert {r.doc_id: r.nos for r in duplicate_lines(table(texts)).collect()} == dict(want)


def test_line_dedup_edges(table):
    assert line_dedup(table([])).count() == 0
    line = "one two three four five six"
    rows = [(2, f"{line}\nkeep\n\n{line}"), (1, f"x\n{line.upper()}"), (None, line), (3, None), (4, "")]
    got = {r.doc_id: (r.text, r._n_removed_lines) for r in line_dedup(table(rows)).collect()}
    assert got == {1: (f"x\n{line.upper()}", 0), 2: ("keep\n", 2), None: (line, 0), 3: (None, 0), 4: ("", 0)}
    assert line_dedup(table(rows)).columns[:-1] == table(rows).columns
    short = [(5, "the end\nThe  END"), (6, "the end \nan end"), (6, "the end \nan end")]
    assert sorted((r.doc_id, r.text) for r in line_dedup(table(short)).collect()) == [(5, "the end"), (6, "an end"), (6, "an end")]
    odd = table(rows).selectExpr("*", "1 as nos", "'a' as _n_removed_lines", "'b' as _made", "'c' as keys")
    assert sorted((str(r.doc_id), r.nos, r.d, r._n_removed_lines) for r in line_dedup(odd).collect()) == sorted((str(i), 1, "x", n) for i, (_, n) in got.items())


def test_line_dedup_recall(table):
    """Lines with edits within similarity 0.9, whatever blocks and SimHashes they have."""
    import random

    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    rows, similar = [], 0
    for i in range(300):
        words = r.choices(vocab, k=r.choice([6, 9, 12, 20, 40, 90]))
        line = list(" ".join(words))
        if i % 2:  # one word is another one
            words[r.randrange(len(words))] = "xyz"
            other = " ".join(words)
        else:  # letters all over the line
            for _ in range(r.randint(1, len(line) // 12)):
                line[r.randrange(len(line))] = r.choice("klmn")
            other = "".join(line)
            line = " ".join(words)
        line = "".join(line)
        most = max(len(line), len(other))
        if distance(line, other) <= 0.1 * most:
            rows += [(2 * i, line), (2 * i + 1, other)]
            similar += 1
    got = {x.doc_id for x in duplicate_lines(table(rows)).collect()}
    assert all(i % 2 for i in got) and similar > 200
    assert len(got) >= 0.97 * similar
    assert sum(x._n_removed_lines for x in line_dedup(table(rows)).collect()) == len(got)


def test_line_pairs_in_slices(table, monkeypatch):
    """op8: pairs travel with their texts in slices of a bounded number, and every pair is in one; texts that only share letters are told apart."""
    from sparkloom.llm import line_dedup as op8

    monkeypatch.setattr(op8, "SLICE", 1)
    norms = [f"some words of a line that number {i} is the only other thing in" for i in range(12)] + [" ".join("abcdefgh"[i:] + "abcdefgh"[:i]) for i in range(4)]
    spark = table([]).sparkSession
    texts = spark.createDataFrame(list(enumerate(norms)), "id long, norm string")
    pairs = [(a, b) for a in range(len(norms)) for b in range(a + 1, len(norms))]
    run = op8._Lines(table([]), 5, 0.9)
    slices = run.linked(spark.createDataFrame(pairs, "a long, b long"), texts)
    want = [(a, b) for a, b in pairs if distance(norms[a], norms[b]) <= 0.1 * max(len(norms[a]), len(norms[b]))]
    assert len(slices) == 8 and sorted((r.a, r.b) for s in slices for r in s.collect()) == want and 0 < len(want) < len(pairs)


def test_line_pairs_by_their_rare_letters(table, monkeypatch):
    """op8: pairs are told apart by their rare letters before whole texts travel, and none that is similar is lost; long texts are compared in pieces."""
    import random

    from sparkloom.llm import line_dedup as op8

    r = random.Random(4)
    monkeypatch.setattr(op8, "LONG_LINE", 100)
    prose = lambda n: " ".join("".join(r.choices("etanorhisdlu", k=r.randint(1, 9))) for _ in range(n))
    norms = []
    for words in (8, 30, 90, 300):
        base = prose(words)
        for edits in (0, 20, 11, 10, 9):
            line = list(base)
            for _ in range(len(base) // edits if edits else 0):
                at = r.randrange(len(line))
                line[at : at + r.randrange(2)] = r.choice(["", "x", "e"])
            norms.append("".join(line))
        norms += [prose(words) for _ in range(3)] + [base[len(base) // 15 :], base + base[: len(base) // 8]]
    spark = table([]).sparkSession
    texts = spark.createDataFrame(list(enumerate(norms)), "id long, norm string")
    close = [(a, b) for b in range(len(norms)) for a in range(b) if abs(len(norms[a]) - len(norms[b])) <= 0.1 * max(len(norms[a]), len(norms[b]))]
    run = op8._Lines(table([]), 5, 0.9)
    pairs = spark.createDataFrame(close, "a long, b long")
    possible = {tuple(x) for x in run.possible(pairs, texts).collect()}
    want = {(a, b) for a, b in close if distance(norms[a], norms[b]) <= int(0.1 * max(len(norms[a]), len(norms[b])) + 1e-9)}
    assert want <= possible < set(close) and want
    assert {tuple(x) for s in run.linked(pairs, texts) for x in s.collect()} == want


def test_line_pairs_make_no_rows(table, monkeypatch):
    """op8, pipeline: copies of one line that are too far from each other make no table of their pairs, and no link is lost, in parts of blocks and classes of length."""
    import random

    from sparkloom.llm import line_dedup as op8

    r = random.Random(6)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(500)]
    base, lines = r.choices(vocab, k=24), []
    for i in range(70):
        words = list(base)
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(vocab)
        lines.append(" ".join(words + r.choices(vocab, k=i % 3)))
    lines += [x[: -(i % 3) - 1] for i, x in enumerate(lines[:15])]
    nodes = {x: line_features(x) for x in lines}
    links = {i: {i} for i in range(len(lines))}
    for i, x in enumerate(lines):
        for j in range(i):
            y, most = lines[j], int(0.1 * max(len(x), len(lines[j])) + 1e-9)
            (ka, sa), (kb, sb) = nodes[x], nodes[y]
            if ka & kb and (sa ^ sb).bit_count() <= 26 and abs(len(x) - len(y)) <= most and distance(x, y) <= most and links[i] is not links[j]:
                links[j] |= links[i]
                for k in links[i]:
                    links[k] = links[j]
    monkeypatch.setattr(op8, "PART", 16, raising=False)
    monkeypatch.setattr(op8, "LARGE", 16, raising=False)
    tables, cut = [], op8.Scratch.cut
    monkeypatch.setattr(op8.Scratch, "cut", lambda self, df, *more: tables.append(cut(self, df, *more).count()) or cut(self, df, *more))
    got = {x.doc_id for x in duplicate_lines(table(list(enumerate(lines)))).collect()}
    assert got == {i for i in links if i != min(links[i])} and 15 <= len(got) < 80
    assert max(tables) <= 12 * len(lines)


def test_lines_travel_in_slices(table, texts, monkeypatch):
    """op8, pipeline: nodes are made slice by slice and blocks meet cell by cell, so no step has the shuffle files of all; what goes is the same."""
    from sparkloom.llm import line_dedup as op8

    rows = texts + [(100 + i, f"many lines begin as this one does and end in their own way {'abcdefghijklm'[i % 13] * (3 + i // 3)} here {i}") for i in range(30)]
    want = sorted((x.doc_id, x.nos) for x in duplicate_lines(table(rows)).collect())
    monkeypatch.setattr(op8, "FEW", 10)
    monkeypatch.setattr(op8, "LARGE", 8)
    monkeypatch.setattr(op8, "SHORT", 1000)
    monkeypatch.setattr(op8, "TEXTS", 1000)
    written, cut = [], op8.Scratch.cut_parts

    def spy(self, parts, *more):
        n = [0]
        out = cut(self, (n.__setitem__(0, n[0] + 1) or p for p in parts), *more)
        written.append(n[0])
        return out

    monkeypatch.setattr(op8.Scratch, "cut_parts", spy)
    assert sorted((x.doc_id, x.nos) for x in duplicate_lines(table(rows)).collect()) == want
    assert op8.SLICES in written and sum(n > 1 for n in written) == 3, "nodes, large blocks, other blocks"


def test_line_dedup_long_lines(table):
    """All words count at any length, and a line of one word value is a node like others."""
    import random

    r = random.Random(5)
    words = ["".join(r.choices("abcd", k=2)) for _ in range(30_000)]
    line, longer, same = " ".join(words), " ".join([*words, "ab"]), " ".join(["x"] * 60_000)
    rows = [(1, line), (2, longer), (3, same), (4, f"some\n{same}"), (5, " ".join(["yz"] * 60_000)), (6, " ".join(["yz"] * 60_000))]
    got = {x.no + 10 * x.doc_id: x for x in line_blocks(table(rows), 5).collect()}
    for at, text in ((10, line), (20, longer), (30, same), (41, same), (50, rows[4][1])):
        keys, sim = line_features(text)
        assert (set(got[at]["keys"]), got[at].sim % 2**64) == (keys, sim)
    assert got[40]["keys"] is None
    assert {x.doc_id: x.nos for x in duplicate_lines(table(rows[2:])).collect()} == {4: [1], 6: [0]}


def test_url_filter(spark):
    cap = spark.createDataFrame(
        [(1, "http://www.A.b.com:80/x/y?q#f", 10), (2, "https://a.b.com/x/", 5), (3, "http://a.b.com/x/y", 20), (4, None, 1), (5, "junk", 1), (6, "http://c.org", None), (7, "http://u@c.org/", 7), (7, "http://u@c.org/", 7)],
        "page_id bigint, url string, fetch_at bigint",
    )
    log = spark.createDataFrame(
        [("domain", "b.com", "add", 10), ("domain", "b.com", "remove", 15), ("prefix", "a.b.com/x/", "add", 0), ("prefix", "a.b.com/x/", "remove", 5),
         ("prefix", "a.b.com/x/", "add", 5), ("prefix", "a.b.com/x/y", "add", 20), ("domain", "c.org", "add", 7), ("domain", None, "add", 0), ("domain", "c.org", "add", None)],
        "kind string, pattern string, action string, at bigint",
    )
    got = [(r.page_id, r._active, r._blocked) for r in url_filter(cap, log).orderBy("page_id").collect()]
    assert got == [(1, ["domain:b.com"], True), (2, [], False), (3, ["prefix:a.b.com/x/y"], True), (4, [], False), (5, [], False), (6, [], False), (7, ["domain:c.org"], True), (7, ["domain:c.org"], True)]
    assert url_filter(cap, log.where("false")).where("_blocked").count() == 0 and url_filter(cap.where("false"), log).count() == 0
    assert cap.select(url_host("url").alias("h")).first().h == "a.b.com"


def test_url_filter_against_every_entry(spark):
    """Many entries and captures of few patterns against the whole log of each, in all ranges of time."""
    import random

    r = random.Random(4)
    hosts = ["a.b.com", "b.com", "x.b.com", "c.org"]
    log = [("domain", r.choice(hosts), r.choice(["add", "remove"]), r.choice([0, 3, r.randint(0, 5000)])) for _ in range(300)]
    caps = [(i, f"http://{r.choice(hosts)}/p", r.choice([-5, 0, 3, 9000, r.randint(0, 5200)])) for i in range(600)]
    last = collections.defaultdict(dict)
    for _, p, action, at in log:
        last[p][at] = max(action, last[p].get(at, ""))
    want = {}
    for i, u, t in caps:
        labels = u.split("/")[2].split(".")
        keys = {".".join(labels[k:]) for k in range(max(1, len(labels) - 1))}
        want[i] = sorted(f"domain:{p}" for p in keys if (past := [a for a in last[p] if a <= t]) and last[p][max(past)] == "add")
    df = spark.createDataFrame(caps, "page_id bigint, url string, fetch_at bigint").selectExpr("*", "1 as u", "2 as t", "3 as d", "4 as active", "5 as _active", "6 as host")
    out = url_filter(df, spark.createDataFrame(log, "kind string, pattern string, action string, at bigint"))
    assert out.columns == ["page_id", "url", "fetch_at", "u", "t", "d", "active", "host", "_active", "_blocked"]
    assert {x.page_id: x._active for x in out.collect()} == want and any(want.values()) and not all(want.values())


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def stream(key, kind, r, half):
    return hashlib.sha256(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()


def shift(x, k):
    out = []
    for j, c in enumerate(x):
        by = int(k[j * 2 % 62 : j * 2 % 62 + 2], 16)
        for lo, n in (("0", 10), ("a", 26), ("A", 26)):
            if ord(lo) <= ord(c) < ord(lo) + n:
                c = chr(ord(lo) + (ord(c) - ord(lo) + by) % n)
                break
        out.append(c)
    return "".join(out)


def feistel(v, kind, key):
    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    for r in range(1, 9):
        if r % 2:
            a = shift(a, stream(key, kind, r, b))
        else:
            b = shift(b, stream(key, kind, r, a))
    return a + b


def test_pii(table):
    rows = [
        (1, "pay 4111 1111 1111 1111, not 4111111111111112; +1 (017) 555-7713"),
        (2, "mail Éol.90@mail7.example.com ip 144.137.247.239. and 999.1.1.1"),
        (3, "on 1999-12-31 or 31.12.1999 or 2001/02/30 ssn 123-45-6789 000-11-2222"),
        (4, None), (5, ""), (6, "nothing here"), (7, "4111111111111111 144.137.247.239"), (7, "4111111111111111 144.137.247.239"),
    ]
    got = collections.defaultdict(list)
    for r in pseudonymize(table(rows), "k").collect():
        got[r.doc_id].append(r)
    t = {i: x[0].text for i, x in got.items()}
    card = re.search(r"pay ([\d ]+),", t[1])[1]
    assert luhn(card) and card.replace(" ", "")[:-1] == feistel("411111111111111", "card", "k") and [len(x) for x in card.split(" ")] == [4] * 4
    phone = feistel("0175557713", "phone", "k")
    assert "4111111111111112" in t[1] and f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}" in t[1]
    assert t[2].startswith(f"mail É{feistel('Éol.90', 'mail', 'k')[1:]}@mail7.example.com") and t[2].endswith("and 999.1.1.1")
    assert card.replace(" ", "") in t[7]
    ip = re.search(r"ip ((\d+\.){3}\d+)", t[2])[1]
    assert ip != "144.137.247.239" and t[7].endswith(ip)
    days = re.search(r"on (\S+) or (\S+) or 2001/02/30 ssn (\S+) 000-11-2222", t[3])
    assert days[1] == "-".join(reversed(days[2].split("."))) != "1999-12-31" and re.fullmatch(r"123-\d\d-\d{4}", days[3])
    assert t[4] is None and t[5] == "" and t[6] == "nothing here" and len(got[7]) == 2
    assert got[3][0].n_pii == {**dict.fromkeys(KINDS, 0), "date": 2, "ssn": 1}
    assert pseudonymize(table([]), "k").count() == 0


def test_pii_links_and_inverse(table):
    """One number has one pseudonym in all layouts, and the key turns all kinds back."""
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"]
    phones = ["+1 (212) 555-0123", "+1.212.555.0123", "+12125550123", "+1 212 555 0123"]
    mails, rest = ["Jane.Doe_7@a.example.org", "jane.doe_7@a.example.org"], ["10.0.200.3", "1987-06-05", "1987/06/05", "05.06.1987", "219-09-9999", "378282246310005", "3782 822463 10005"]
    odd = ["éé@a.example.org", "4111 1111 1111 1112", "1999-13-01", "000-11-2222"]
    values = cards + phones + mails + rest + odd
    df = table([(i, f"x {v} y") for i, v in enumerate(values)]).selectExpr("*", "3 as s", "4 as m")
    out = pseudonymize(df, "secret").persist()
    got = {r.doc_id: r.text[2:-2] for r in out.collect()}
    digits = [re.sub(r"\D", "", got[i]) for i in range(len(values))]
    assert len(set(digits[:3])) == 1 and len(set(digits[3:7])) == 1 and got[7].lower() == got[8] and got[7][0].isupper()
    assert digits[14] == digits[15] and luhn(digits[14]) and luhn(digits[0])
    assert all((got[i] == v) == (v in odd) for i, v in enumerate(values))
    assert all(re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", v) for i, v in enumerate(values) if "@" not in v and v != "10.0.200.3")
    back = depseudonymize(out, "secret")
    assert {r.doc_id: r.text[2:-2] for r in back.collect()} == dict(enumerate(values)) and back.columns == out.columns
    assert {r.doc_id: r.text[2:-2] for r in depseudonymize(out, "other").collect()} != dict(enumerate(values))


def test_date_pseudonyms_are_a_permutation(spark):
    days = spark.range(73049).selectExpr("id as doc_id", "cast(date_add(date'1900-01-01', cast(id as int)) as string) as text")
    out = pseudonymize(days.where("doc_id < 4000"), "k")
    assert out.select("text").distinct().count() == 4000
    assert out.where("text < '1900-01-01' or text > '2099-12-31'").count() == 0


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs, items, window):
    low = lambda t: ALNUM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = {}
    for i, t in docs:
        w, hit, ids = low(t), set(), set()
        for item, x in items:
            b = low(x)
            n = min(window, len(b))
            have = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in have:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block_words", [10**6, 10])
def test_decontamination(spark, table, texts, block_words):
    items = [(1, texts[30][1]), (2, texts[25][1][:200]), (3, "two words"), (4, None), (5, ""), (10, "ab ab ab"), (11, texts[3][1]), (11, texts[4][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(table(texts), bench, 10, block_words).collect()}
    assert got == contamination(texts, items, 10)


def test_decontamination_blocks_keep_rows(spark, table):
    """Several blocks of the benchmark give the rows of one, without ids and with repeated ones."""
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    items = spark.createDataFrame([(1, a), (2, b)], "item_id bigint, text string")
    rows = [(None, f"one {a}"), (None, f"{b} two three"), (None, "clean"), (None, None), (None, "clean"), (5, a), (5, a), (5, f"x {b}"), (6, "clean")]
    got = [sorted(map(str, decontaminate(table(rows), items, 10, n).collect())) for n in (1_000_000, 2)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_decontamination_edges(spark, table):
    bench = spark.createDataFrame([("a", "x y z")], "item_id string, text string")
    assert decontaminate(table([]), bench).count() == 0
    got = [(r.n_hit, r.spans) for r in decontaminate(table([(None, "q X-Y z"), (1, None)]), bench.union(bench)).collect()]
    assert sorted(x[0] for x in got) == [0, 3] and max(got)[1] == [(1, 4)]
    assert decontaminate(table([(1, "x y z")]), bench.where("false")).first().n_hit == 0
