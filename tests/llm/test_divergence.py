"""Source divergence against plain Python, in many tiles, and odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n string, value string, rank string, total string, kept string, block string"
CLASH = ("x",) * 7


def plain(rows, least, best):
    """(lang, source, part, item) -> (value, rank), with Python's whole numbers."""
    groups, df = {}, {}
    for _, text, lang, source, _ in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        df.setdefault(lang, Counter()).update(set(terms))
    out = {}

    def ranked(lang, source, part, found, most):
        for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
            out[lang, source, part, item] = (v, k + 1)

    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        each, whole = {s: p(c) for s, c in sources.items()}, p(sum(sources.values(), Counter()))
        for s in sources:
            ranked(lang, s, "pair", [(sum(abs(each[s][t] - each[o][t]) for t in kept), o) for o in sources if o != s], None)
            ranked(lang, s, "term", [(each[s][t] - whole[t], t) for t in kept if sources[s][t] and each[s][t] > whole[t]], best)
    return out


@pytest.mark.parametrize("cells", [1 << 18, 12])
def test_divergence_by_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(dv, "TILE_CELLS", cells)
    monkeypatch.setattr(dv, "MOST_HELD", 50 if cells == 12 else 400_000)
    r = random.Random(9)
    spelt = ["the", "The", "ÉTÉ", "été", "中文字", "a1b", "x_y", "z", "Z", "naïve", "it's"]
    rows = [(i, " ".join(r.choice(spelt[: 4 + i % 8]) for _ in range(r.randrange(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s", "t", "ü", "z9", None]), None) for i in range(300)]
    rows += [rows[5]] * 40 + [(1, None, "fr", None, 0), (2, "", None, "b", 0), (None, "word " * 200_000, "en", "long", 1), (3, "1 2 3", "xx", "only", 5), (3, "rare", "yy", "p", 5), (4, "terms", "yy", "q", 5)]
    docs = spark.createDataFrame([(*x, *CLASH) for x in rows], SCHEMA).repartition(3)
    got = dv.divergence(docs).collect()
    found = {(x.lang, x.source, x.part, x.item): (x.value, x["rank"]) for x in got}
    assert len(found) == len(got) and found == plain(rows, dv.LEAST_DOCS, dv.BEST)
    assert found["yy", "p", "pair", "q"] == (0, 1) and not any(k[0] == "xx" for k in found)


def test_heaps_keep_the_best(spark, monkeypatch):
    monkeypatch.setattr(dv, "TILE_CELLS", 40)
    monkeypatch.setattr(dv, "LEAST_DOCS", 2)
    spelt = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    rows = [(i, " ".join(spelt[(i % 2) * 100 :][:200]), "en", f"s{i % 4}", None) for i in range(8)]
    got = dv.divergence(spark.createDataFrame([(*x, *CLASH) for x in rows], SCHEMA)).collect()
    assert {(x.lang, x.source, x.part, x.item): (x.value, x["rank"]) for x in got} == plain(rows, 2, dv.BEST)


def test_empty_table(spark):
    assert dv.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(500):
        total, kept = r.randrange(0, 10 ** r.randrange(1, 16)), r.randrange(1, 10**6)
        n = r.randrange(0, total + 1)
        assert int(dv.shares(np.array([n]), np.array([total]), kept)[0]) == 1 + 10**9 * (n + 5) // (total + 5 * kept)
