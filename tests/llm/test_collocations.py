import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import lower

from panelspark.llm import collocations


def plain(rows, longest=3, least=10, covered=50, top=2000):
    """(text, lang) rows -> sorted result rows."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            cuts = [(10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            hidden = any(
                len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            if not hidden:
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    words = ["a", "b", "C", "Dé", "e-e", "漢", "\x0e", "zz"]
    out = [
        ("".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(draw.randrange(60))), draw.choice(["x", "y", None]))
        for _ in range(120)
    ]
    # One pair begins a third of all places, with many words behind it.
    out += [(" ".join(f"hot pair w{draw.randrange(40)}" for _ in range(30)), "x") for _ in range(25)]
    return out + [(None, "x"), ("", None), ("?!;:", "y"), (out[0][0], out[0][1])] + [(" the same text again " * 3, "und")] * 5


def found(spark, rows, **more):
    df = spark.createDataFrame([(t, g, "x", "x", "x", 1) for t, g in rows], "text string, lang string, phrase string, words string, n string, a int")
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


@pytest.mark.parametrize(
    "more", [{}, {"block_bytes": 700, "group_bytes": 300, "hot_share": 0.2}, {"block_bytes": 500, "group_bytes": 100, "fan": 3, "hot_share": 0.05}]
)
def test_phrases_as_by_counting(spark, texts, more):
    assert found(spark, texts, **more) == plain(texts)


@pytest.mark.parametrize("longest,least,covered,top", [(2, 3, 50, 5), (4, 2, 80, 2000), (5, 10, 10, 7)])
def test_other_lengths_and_limits(spark, texts, longest, least, covered, top):
    more = dict(longest=longest, least=least, covered=covered, top=top)
    assert found(spark, texts, **more, block_bytes=2000, group_bytes=500, hot_share=0.1) == plain(texts, **more)


def test_edge_rows(spark, edge, nothing):
    rows = [(r.text, r.lang) for r in edge.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(edge, least=2).collect()) == plain(rows, least=2)
    assert collocations.collocations(nothing).collect() == []


@pytest.mark.parametrize("size,least", [(0, 1), (100, 1), (5000, 1), (5000, 7), (300_000, 10)])
def test_three_way_sort_counts_equal_prefixes(size, least):
    draw = np.random.default_rng(size)
    keys = [draw.integers(0, 1 + draw.integers(1, 60), size) ** 2 for _ in range(3)]
    weight = draw.integers(1, 4, size)
    got = collocations.equal_partitions(keys, weight, least)
    for depth, (at, total) in enumerate(got, 1):
        want = Counter()
        for row, w in zip(zip(*[k.tolist() for k in keys[:depth]]), weight.tolist()):
            want[row] += w
        named = list(zip(*[k[at].tolist() for k in keys[:depth]]))
        assert dict(zip(named, total.tolist())) == {k: v for k, v in want.items() if v >= least} and len(set(named)) == len(named)
