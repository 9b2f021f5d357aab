import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from askgrid.llm import divergence
from tests.llm.conftest import prose

KINDS = "doc_id long, text string, lang string, source string"


def terms_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, least=30, top=50):
    docs = [((lang or "", source or ""), terms_of(text)) for _, text, lang, source in rows]
    in_docs, out = Counter(), []
    for (lang, _), words in docs:
        in_docs.update((lang, w) for w in set(words))
    kept = defaultdict(list)
    for (lang, w), n in in_docs.items():
        if n >= least:
            kept[lang].append(w)
    groups, langs = defaultdict(Counter), defaultdict(Counter)
    for g, words in docs:
        some = [w for w in words if in_docs[g[0], w] >= least]
        groups[g].update(some)
        langs[g[0]].update(some)

    def price(counts, w, lang):
        return 1 + 10**9 * (counts[w] + 5) // (sum(counts.values()) + 5 * len(kept[lang]))

    p = {g: {w: price(c, w, g[0]) for w in kept[g[0]]} for g, c in groups.items()}
    q = {lang: {w: price(c, w, lang) for w in kept[lang]} for lang, c in langs.items()}
    for g, own in p.items():
        pairs = [(h[1], sum(abs(own[w] - p[h][w]) for w in own)) for h in p if h[0] == g[0] and h != g]
        above = [(w, own[w] - q[g[0]][w]) for w in own if groups[g][w] and own[w] > q[g[0]][w]]
        for part, items, most in (("pair", pairs, None), ("term", above, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(*g, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def result(df, **settings):
    return sorted(tuple(r) for r in divergence.audit(df, **settings).collect())


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    rows = []
    for k in range(700):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = "hot" if k % 3 == 0 else rng.choice([f"s{n}" for n in range(9)] + [None, ""])
        text = prose(rng, rng.randint(0, 60)) + rng.choice(["", " Über-ÜBER don't", " X9x Naïve 漢字", " the The THE"])
        rows.append((k, text, lang, source))
    rows += [(k, None, "fr", "s1") for k in range(3)] + [(9, "", "fr", "s2"), (10, "...", "xx", "only"), (11, "word " * 5000, "en", "s1")]
    return rows + [rows[0], rows[0]]


def test_equals_brute_force(spark, made):
    df = spark.createDataFrame(made, KINDS).repartition(7)
    assert result(df) == brute(made)
    assert result(df, least=1, top=3) == brute(made, 1, 3)


def test_small_blocks_give_the_same(spark, made, monkeypatch):
    df = spark.createDataFrame(made[:300], KINDS)
    monkeypatch.setattr(divergence, "COLUMNS", 7)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert result(df, least=5) == brute(made[:300], 5)
    kept = divergence.kept_terms(df, 5)
    assert kept.where("first").count() == kept.select("lang", "term").distinct().count()


def test_several_blocks_of_sources(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 30), "en", f"source{rng.randint(0, 70)}") for k in range(500)]
    assert result(spark.createDataFrame(rows, KINDS)) == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], KINDS)
    assert result(empty) == []
    rows = [(1, None, None, None), (None, "", "", "a"), (None, None, "en", None)]
    names = ["term", "n", "p", "side", "low", "value", "rank", "part", "item", "total"]
    wide = spark.createDataFrame([(*r, *names) for r in rows], KINDS + "".join(f", `{n}` string" for n in names))
    assert result(wide) == brute(rows) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_joint_tables_count_every_term():
    """The product of one-hot blocks against counting by hand."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 4, (50, 6))
    term, source = np.nonzero(counts)
    entries = [np.concatenate([x, y]) for x, y in ((term, np.full(6, -1)), (source, np.arange(6)), (counts[term, source], np.zeros(6, int)))]
    cells, column, of_source = divergence.block_product(*entries, np.zeros(len(entries[0]), dtype=np.int64), True)
    level = np.zeros(len(of_source), dtype=int)
    level[column] = entries[2]
    got = {}
    for x, y, some in cells:
        got |= {(of_source[a], of_source[b], level[a], level[b]): int(n) for a, b, n in zip(x, y, some)}
    want = Counter((a, b, counts[t, a], counts[t, b]) for t in range(50) for a in range(6) for b in range(a + 1, 6))
    assert got == want
