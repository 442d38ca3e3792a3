import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions.prefixes import carry_down, prefix_chains, prefixes_of
from tallyweave.operators import lookups as lk


def made_up(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice("abé") for _ in range(rng.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("rows", [7, 40, 1 << 20])
def test_found_prefixes_equal_all_pairs(spark, rows):
    texts = [(g, t, i) for g in (1, 2) for i, t in enumerate(made_up(g, 150, 7))] + [(1, None, 900), (None, "ab", 901), (1, "", 902)]
    asked = [(g, p) for g in (1, 2, 3) for p in made_up(10 + g, 60, 5)] + [(1, ""), (1, None), (None, "a")]
    got = prefixes_of(
        spark.createDataFrame(texts, "g int, t string, n int"), spark.createDataFrame(asked, "g int, p string"), ["g"], "t", "p", rows=rows
    )
    want = {
        (g, t, n): sorted({p for h, p in asked if h == g and p and t.startswith(p)}, key=len)
        for g, t, n in texts if g is not None and t
    }
    assert {(r.g, r.t, r.n): r.found for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_chains_and_the_mark_before(spark):
    asked = spark.createDataFrame([(1, p) for p in ["a", "ab", "abcd", "abd", "b", "b", "ba"]], "g int, p string")
    chains = {r.p: r.chain for r in prefix_chains(asked, ["g"], "p", rows=2).collect()}
    assert chains == {"a": ["a"], "ab": ["a", "ab"], "abcd": ["a", "ab", "abcd"], "abd": ["a", "ab", "abd"], "b": ["b"], "ba": ["b", "ba"]}
    rows = spark.range(50).select(F.lit(0).alias("g"), "id")
    got = carry_down(rows, ["g"], ["id"], F.when(F.col("id") % 10 == 0, F.col("id")), "m", own=False, rows=6)
    assert {r.id: r.m for r in got.collect()} == {i: (None if i == 0 else (i - 1) // 10 * 10) for i in range(50)}


def test_nothing_to_ask_or_to_find(spark):
    texts = spark.createDataFrame([(1, "ab")], "g int, t string")
    asked = spark.createDataFrame([(1, "a")], "g int, p string")
    assert prefixes_of(texts, asked.limit(0), ["g"], "t", "p").count() == 0
    assert prefixes_of(texts.limit(0), asked, ["g"], "t", "p").count() == 0


def test_suffix_matches_equal_all_pairs(spark):
    sources = [(s, i, f"x/{n}") for s in (1, 2) for i, n in enumerate(made_up(s, 80, 4))] + [(1, 500, "x/"), (1, 501, None)]
    bases = [(s, i, f"y/z{s}/{n}") for s in (1, 2, 3) for i, n in enumerate(made_up(20 + s, 200, 6) + ["ab"] * 5)] + [(1, 999, None)]
    frame = lambda rows: spark.createDataFrame(rows, "scope int, image_id long, image_path string")
    got = {(r.scope, r.image_id): (r.matches, r.base_image_id) for r in lk.match_by_filename(frame(sources), frame(bases), "scope", "suffix").collect()}
    for s, i, path in sources:
        name = path.split("/")[-1] if path else None
        ids = [b for t, b, p in bases if t == s and name and p and p.split("/")[-1].endswith(name)]
        assert got[(s, i)] == (len(ids), min(ids, default=None))
    assert len(got) == len(sources)
