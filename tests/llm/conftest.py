import random

import pytest

#: Columns beside doc_id and text whose names the operators use inside.
EXTRA = "dk string, row int, h int, score string, root string, c long, n long, part int, mask string, k string, th int, number int, length long"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Nulls, blanks, ties, repeated rows, copies, near copies, shared passages, one very long text."""
    r = random.Random(5)
    shared = passage(900, 60)
    out = [(i, passage(i, r.randint(1, 120))) for i in range(40)]
    out += [(100 + i, passage(7, 90) + f" tail{i}") for i in range(12)]  # near copies
    out += [(200 + i, passage(8, 70)) for i in range(15)]  # copies
    out += [(300 + i, passage(300 + i, 50) + " " + shared + " " + passage(400 + i, 40)) for i in range(10)]
    out += [(500, None), (501, ""), (502, " \t\n "), (503, "One"), (504, "one"), (505, "!!! 12 34"), (506, "é" * 300), (507, "日本語のテキスト"), (508, "a" * 5000)]
    out += [(600, passage(600, 80)), (600, passage(600, 80)), (600, passage(601, 80))]  # repeated id, with equal and other text
    out += [(None, passage(602, 50)), (None, None), (None, passage(8, 70))]
    out += [(700, " ".join(["ab cd ef"] * 30)), (701, passage(701, 30_000)), (702, passage(3, 4).upper()), (703, passage(3, 4))]
    out += [(-5, passage(20, 100).upper())]
    return out


def frame(spark, rows, parts: int = 3):
    full = [(d, t, "x", 1, 2, "s", "r", 3, 4, 5, "m", "k", 6, 7, 8) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
