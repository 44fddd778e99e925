import pytest

EXTRA = ", size long, target double, n_lines long, hits long, key string, pos int, n long, line string, kept boolean, own_0 string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns of clashing names; each is (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, 0.5, 7, 3, "k", 1, 2, "l", True, "o") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + EXTRA)

    return make


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
#: Null, empty, blank, one word, a repeated row, a very long text, wide characters.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here\nand there"), (5, "same text here\nand there"), (6, LONG), (7, "ümläut 😀 ñandú\r\n\x0bend"), (None, "no id at all")]


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([]).where("false")
