import random

import pytest

VOCABULARY = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("", "n", "r", "st")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): copies, near copies, nulls, empty and long texts, ties, odd signs."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    shared = prose(rng, 40)
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(100 + k, t) for k, t in enumerate(texts[:10])]  # copies
    for k, t in enumerate(texts[10:30]):  # one word differs
        words = t.split()
        words[len(words) // 2] = "changed"
        out.append((200 + k, " ".join(words)))
    out += [(300 + k, f"{prose(rng, 20)}\n{shared} {prose(rng, 20)}") for k in range(12)]
    out += [
        (400, None), (401, ""), (402, " \t\n"), (None, texts[0]), (None, None), (403, "one"), (404, "two words"),
        (405, prose(rng, 20_000)), (406, "a " * 3000), (407, "x" * 5000), (408, "Ünïcode ÄÖÜ ß 漢字 🙂 don't it's 12345  double   blanks \r\n end "),
        (409, "MIT License. Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3."),
    ]
    return out + [out[0], out[0], out[75]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def wide_docs(spark, rows):
    """Documents with columns named like those that operators use inside."""
    names = ["id", "row", "grp", "ids", "data", "__key", "words", "start", "digest", "part", "edited", "term"]
    kinds = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *names) for r in rows[:90]], f"doc_id long, text string, {kinds}")
