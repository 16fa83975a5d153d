import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A DataFrame of documents with columns that clash with the operators' own names."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, s) for i, t, *s_ in rows for s in [s_[0] if s_ else "s"]], "doc_id bigint, text string, source string")
        if extra:
            for c in ("n", "sig", "name", "head", "n_words", "copies", "size", "spans", "row", "t", "h", "w", "component", "class_id", "u", "b_t", "b_host", "_nos", "_id", "_s", "_words", "d", "id", "no", "at", "words", "nr", "key"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, repeats, blanks, nulls and one long document."""
    import random

    r = random.Random(3)
    vocab = ["".join(r.choices("abcdeéfghij", k=r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    passage, base, line = prose(70), prose(160), prose(12)
    out = [prose(r.randint(1, 120)) for _ in range(25)]
    out += [base, base, base.upper(), " ".join(w if i % 60 else "edited" for i, w in enumerate(base.split()))]
    out += [f"{prose(20)} {passage} {prose(20)}" for _ in range(6)] + [f"{passage} {prose(5)} {passage}"]
    out += [f"{line}\n{prose(30)}\n{line}x\n{prose(8)}" for _ in range(8)]
    out += [None, "", " \t\n", "one", "two words", "one", prose(4000), "ab " * 300, passage]
    return list(enumerate(out))
