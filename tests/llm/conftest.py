import pytest

DATA = "/root/testdata/sf0.001"

# Columns whose names operators use inside.
CLASH = ("key", "id", "rep", "unit", "label", "n", "score", "lang_pred", "ids", "component", "a", "b", "place", "path", "copies", "own")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, extra columns with clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [(1, base * 20, "en", "s"), (2, base * 20, "en", "s"), (2, base * 20, "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, "   \n\t ", "fr", None),
            (6, long, "en", "s"), (7, long + " tail", "en", "s"), (None, base, "en", "s"), (None, None, None, None), (8, "1234 5678 !!", "de", "t"), (9, "a", None, "t"),
            (10, "x", "xx", "t"), (11, "password = hunter2hunter2 and pwd is x9$Kq2!vLpZ", "en", "t"), (12, "the " * 3000, "en", "t")]
    rows = [(i, t, l, s, len(t) if t else None) for i, t, l, s in rows]
    extra = "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame([r + ("?",) * len(CLASH) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
