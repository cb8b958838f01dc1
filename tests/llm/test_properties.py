"""Properties over generated inputs: the word rule on both sides, packing plans, shingle sets."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronorel.llm.common import ascii_lower, words
from chronorel.llm.packing import _ranges, plan
from chronorel.llm.shingles import WordHashes, shingle_hashes, split_words, word_hashes


def test_word_rule_agrees(spark):
    """JVM expressions and numpy split and lower-case alike, on white space of any kind and beyond ASCII."""
    rnd = random.Random(11)
    pieces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "A", "É", "İ", "ß", "K", "zZ", "😀", "\x00", "-"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w"), ascii_lower(F.col("t")).alias("l")).collect()
    for r in rows:
        assert [w.encode() for w in r["w"]] == split_words(r["t"])
        assert r["l"].encode() == r["t"].encode().lower()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 96), st.integers(1, 200)), max_size=40))
def test_plans_place_every_rank_once(bins):
    hist = np.zeros(97, np.int64)
    for k, n in bins:
        hist[k] += n
    planned = plan(hist, 96, 300)
    used = np.zeros(97, np.int64)
    for parts, n in planned:
        assert sum(parts) <= 96
        for p in parts:
            used[p] += n
    assert (used == hist).all()
    for k, (first, _, offset) in _ranges(planned).items():
        assert first[0] == 0 and (np.diff(first) > 0).all() and (offset + k <= 96).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=30), st.integers(1, 6))
def test_shingle_sets(w, k):
    n = min(k, len(w))
    expected = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    assert len(shingle_hashes(word_hashes(" ".join(w), WordHashes()), k)) == len(expected)
