import pytest

WORDS = "amber birch cedar delta ember frost grove haven islet jetty knoll larch maple north ocean pearl quart ridge stone thorn".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 2**32 + 1
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + ("" if (x >> 9) % 3 else str((x >> 20) % 50)))
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, salt string, label int"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties and repeated rows; extra columns named like the operators' own."""
    rows = [(i, prose(i % 23, 12 + i % 40), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, "", None, ""), (103, prose(5, 6000), "en", "s1"), (104, "x", "de", None)]
    rows += [(105, "ÀÉ Mixed CASE", "fr", "s2"), (106, "ÀÉ mixed case", "fr", "s2"), (107, "àé mixed case", "fr", "s2"), (108, " \t\n", "en", "s0"), (109, "two words", "en", "s1")]
    rows += [(110, "repeated row", "en", "s1")] * 3 + [(None, "no id", "en", "s0"), (None, None, None, None)]
    rows += [(200 + i, "the same long copy of one text for many rows", "en", "hot") for i in range(70)]
    return [(*r, len(r[1] or ""), 7, "salt", 1) for r in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
