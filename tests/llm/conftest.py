import random

import pytest


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """(doc_id, text): prose, copies, near copies, shared passages, repeated rows, nulls, empty and very long texts."""
    rnd = random.Random(9)
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = prose(40), prose(120)
    out = [(i, prose(rnd.randint(1, 80))) for i in range(30)]
    out += [(100 + i, f"{prose(20)}\n\n{passage}  {prose(10)}") for i in range(8)]
    for i in range(25):
        text = base.split()
        for _ in range(rnd.randint(0, 14)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        out.append((200 + i, " ".join(text)))
    out += [(300 + i, base) for i in range(6)]
    out += [(400, None), (401, ""), (402, " \t\n "), (403, "one"), (404, "ONE"), (405, "two words"), (406, "Two words")]
    out += [(500, prose(3000)), (501, "x" * 50_000), (502, " ".join([passage] * 3)), (503, passage.replace(" ", "\x0b"))]
    out += [(None, passage), (None, None), (-7, base + " tail"), (7, "again and again"), (7, "again and again"), (8, "second text of eight")]
    return out


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as documents with further columns whose names clash with inner ones."""

    def build(rows):
        more = "doc_id long, text string, lang string, source string, n_chars long, id string, chunk string, bucket string, a string, b string, c0 string, v string"
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *"uvwxyzq") for i, t in rows], more).repartition(5)

    return build
