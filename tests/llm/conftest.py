import pytest

WORDS = "the of river stone and light over winter house garden is to walking quiet morning paper in music silver forest".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + (str(x % 97) if x % 5 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves)."""
    base = sentence(1, 120)
    texts = [
        None, "", "  \n\t ", "one", base, base, base.upper(), base + " tail words", base.replace("river", "lake", 1), sentence(2, 200),
        "Ünïcödé ΣΑΣ İstanbul 日本語 é é 😀 ½ <|endoftext|> it's we'll", sentence(3, 20_000), "12345 !!! ??? ---", "the the the the", "a\x00b\x1c c",
    ]
    rows = [(i, t, None if i % 4 == 3 else ("en" if i % 2 else "de"), None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t), "x", "y", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[9]]  # repeated rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spots string, n int, uid int"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
