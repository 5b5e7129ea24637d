"""Hashes of words that are made to collide, and what operators 4 and 8 do with such words."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import near_dedup, substrings, words

DOCS = "doc_id long, text string"


def _morse(n: int) -> tuple[str, str]:
    """The Thue-Morse word of 2^n letters and its complement: sums weighted by powers of an odd base are equal."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_have_two_hashes():
    for n in (3, 5, 6, 7, 10, 12):
        w = next(words.words_of(pa.array([" ".join(_morse(n))])))
        assert w.hashes[0] != w.hashes[1] and list(w.spelled()) == [0, 1]


def test_equal_words_and_shingles_have_one_hash_wherever_they_stand():
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcé") for _ in range(r.randint(1, 90))) for _ in range(40)]
    rows = [[r.choice(vocabulary) for _ in range(r.randint(0, 30))] for _ in range(60)]
    seen: dict = {}
    for w in words.words_of(pa.array([" ".join(x) for x in rows])):
        grams = {k: w.grams(k) for k in (1, 2, 3, 5, 7, 13)}
        for i, row in enumerate(rows):
            for k, found in grams.items():
                for j in range(len(row) - k + 1):
                    assert seen.setdefault(tuple(row[j : j + k]), found[w.rows[i] + j]) == found[w.rows[i] + j]
    assert len(set(seen.values())) == len(seen)


def test_substrings_keep_and_near_dedup_parts_such_words(spark):
    a, b = _morse(10)
    df = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13))], DOCS)
    assert [r.n_removed for r in substrings.cut_repeats(df).orderBy("doc_id").collect()] == [0, 0]
    assert [r.component_id for r in near_dedup.near_duplicates(df).orderBy("doc_id").collect()] == [1, 2]


def _brute(rows):
    """doc_id -> (n_words, n_removed, n_runs, kept) for distinct ids."""
    split = {i: re.findall(r"[^ \t-\r]+", t or "") for i, t in rows}
    first: dict = {}
    for i in sorted(split):
        for j in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][j : j + 13]), i)
    out = {}
    for i, w in split.items():
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        out[i] = len(w), len(gone), sum(k - 1 not in gone for k in gone), " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


@pytest.mark.parametrize("group", [1024, 6, 1])
def test_repeats_equal_brute_force_whatever_fits_a_group(spark, group):
    r = random.Random(7)
    passages = [[r.choice("abc") for _ in range(r.randint(10, 30))] for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [r.choice(passages)[r.randint(0, 6) :] if r.random() < 0.5 else [r.choice("abcdefgh") for _ in range(r.randint(0, 20))] for _ in range(r.randint(0, 5))]
        rows.append((1000 - i, r.choice([" ", "\n", " \t "]).join(x for p in parts for x in p)))
    rows += [(2000, "x " * 60), (2001, "x " * 40 + "y"), (2002, None), (2003, "z " * 12)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.n_runs, x.kept) for x in substrings.cut_repeats(spark.createDataFrame(rows, DOCS), group).collect()}
    assert got == _brute(rows)


def test_a_subtree_marks_all_but_the_smallest_holder():
    r = np.random.default_rng(0)
    spelt, sample, doc = r.integers(0, 2, (400, substrings.DEPTH)), r.integers(0, 2, 400), r.integers(0, 9, 400)
    spelt[:, 4:] = 0
    least: dict = {}
    for x, s, d in zip(spelt.tolist(), sample.tolist(), doc.tolist()):
        least[(*x, s)] = min(d, least.get((*x, s), d))
    assert substrings.repeats(spelt, sample, doc).tolist() == [d > least[(*x, s)] for x, s, d in zip(spelt.tolist(), sample.tolist(), doc.tolist())]
