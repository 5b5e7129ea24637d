"""Odd rows and clashing names for every operator and stage, and plain loops beside those that have no SQL."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, fingerprint, near_dedup, pii, quality, substrings, toxicity
from plumbline.llm.tables import labelled_sample

DOCS = "doc_id long, text string"
ODD = [(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (2, ""), (4, "x " * 3000), (4, "x " * 3000), (5, "a b c d e f"), (5, "y"), (6, "é😀 mail a@b.co " * 7)]
CLASHES = ["label", "_id", "_gone", "_was_null", "_hit_email", "_whole", "pii", "id", "digest", "node", "rep", "n", "c0", "c1", "ids", "fingerprint", "held_out"]


@pytest.fixture(scope="module")
def tables(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("own") for c in CLASHES})
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int").withColumns({"label": F.lit("own"), "_id": F.lit(1), "id": F.lit(2)})
    return odd, labels, spark.createDataFrame([(1, "a b c d e f"), (2, None), (None, "q"), (3, "y")], "item_id long, text string")


OPERATORS = {
    "leaks": lambda d, l, i: decontaminate.find_leaks(d, i), "clean": lambda d, l, i: decontaminate.decontaminate(d, i), "pii": lambda d, l, i: pii.find(d), "redact": lambda d, l, i: pii.redact(d),
    "cut": lambda d, l, i: substrings.cut_repeats(d), "sketch": lambda d, l, i: fingerprint.fingerprints(d), "next": lambda d, l, i: fingerprint.compare_with_next(d), "toxic": lambda d, l, i: toxicity.score(d, toxicity.train(d, l)),
    "near": lambda d, l, i: near_dedup.near_duplicates(d), "one": lambda d, l, i: near_dedup.keep_one(d), "digests": lambda d, l, i: bpe.round_trip(d), "ids": lambda d, l, i: bpe.decode(bpe.encode(d)), "tokens": lambda d, l, i: bpe.tokenized(d),
    "quality": lambda d, l, i: quality.score(d, quality.train(d, l)), "good": lambda d, l, i: quality.keep_good(d, quality.train(d, l)),
}
FEWER = {"leaks", "clean", "one", "good"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_names(tables, name):
    odd, labels, items = tables
    assert OPERATORS[name](odd.limit(0), labels, items).count() == 0
    out = OPERATORS[name](odd, labels, items)
    n = out.count()
    assert n < len(ODD) + 5 if name in FEWER else n == len(ODD)
    if name in ("clean", "one", "good", "redact"):
        assert out.columns == odd.columns and {r.label for r in out.collect()} <= {"own"}


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (2, "A b c  d e f", 4), (None, "q r s t u v", 5), (None, "q r s t u v", 6), (None, "Q r s t u v", 7), (3, "z", 8), (4, "", 9), (4, "", 10)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, DOCS + ", nth int")).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(0, "q r s t u v"), (1, "a b c d e f"), (3, "z"), (4, "")]


def test_samples_are_bounded_by_ids_not_rows(spark):
    docs = spark.range(200).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 50).count() == 1


def test_redaction_replaces_what_is_found(spark):
    texts = ["mail a@1.2.3.4, card 4111 1111 1111 1111 and +49 (30) 1234567 1.2.3.4", "account DE89 3704 0044 0532 0130 00", "serial DE89370400440532013000", "é😀 a@b.co" * 300, "", "none", "a@b.c.d 9 1.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r.doc_id: r.pii for r in pii.find(df).collect()}
    assert [x.kind for x in found[1]] == ["iban"] and not found[2] and len(found[3]) == 300
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for x in sorted(found[i], key=lambda x: (x.start, x.end)):
            if x.start >= at:
                out += text[at : x.start] + f"[{x.kind.upper()}]"
            at = max(at, x.end)
        assert clean[i] == out + text[at:]


def _sketch(text):
    w = [x.lower() for x in re.findall(r"[^ \t-\r]+", text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("ids", ["dense", "sparse", "outlier", "repeated"])
def test_fingerprints_beside_a_plain_loop(spark, ids, monkeypatch):
    monkeypatch.setattr(fingerprint, "PIECE_ROWS", 7)
    r = random.Random(3)
    number = {"dense": lambda i: i, "sparse": lambda i: r.randrange(-(1 << 62), 1 << 62), "outlier": lambda i: i if i else 1 << 61, "repeated": lambda i: i // 40}[ids]
    rows = [(number(i), " ".join(f"é{r.randrange(90)}" for _ in range(r.randint(0, 60)))) for i in range(120)]
    got = sorted((x.doc_id, x.n_chars, x.edited_sha256, x.near_edited, x.near_next) for x in fingerprint.compare_with_next(spark.createDataFrame(rows, DOCS)).collect())
    rows.sort()
    want = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = map(_sketch, (text, edited, after))
        alike = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)  # noqa: E731  (all sets fit a sketch)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(a, b), alike(a, c)))
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in sorted(want)])


def test_sketches_of_parts_merge_to_that_of_the_whole(spark):
    r = random.Random(8)
    rows = [(i, " ".join(str(r.randrange(400)) for _ in range(40)), "ab"[i % 2] if i % 9 else None) for i in range(150)]
    df = fingerprint.fingerprints(spark.createDataFrame(rows, DOCS + ", part string").repartition(6))
    got = {x.part: x.fingerprint for x in fingerprint.merged(df, "part").collect()}
    for part in ("a", "b", None):
        own = np.unique(np.concatenate(fingerprint.sketches(pa.array([t for _, t, p in rows if p == part]), 10**6)))
        assert got[part] == fingerprint.spelled(own[: fingerprint.K])


def test_the_risk_falls_along_its_gradient():
    r = np.random.default_rng(1)
    sample = lambda n, p: (np.concatenate([[0], 1 + np.flatnonzero(r.random(8) < p)]).astype(np.int32) for _ in range(n))
    packed = lambda rows: (np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
    positive, unlabelled = packed(list(sample(40, 0.8))), packed(list(sample(200, 0.3)))
    features = np.arange(9)
    xp, xu = (toxicity._dense(s, features).astype(float) for s in (positive, unlabelled))
    for prior in (0.1, 0.9):
        for _ in range(5):
            w = r.normal(size=10)
            value, grad = toxicity.risk(w, xp, xu, prior, 0.0)
            for i in range(10):
                step = np.eye(10)[i] * 1e-6
                up, down = toxicity.risk(w + step, xp, xu, prior, 0.0)[0], toxicity.risk(w - step, xp, xu, prior, 0.0)[0]
                assert abs((up - down) / 2e-6 - grad[i]) < 1e-5
            assert value > -1e9


def test_leaks_beside_all_pairs(spark):
    r = random.Random(11)
    word = lambda: "w" + str(r.randrange(10**5))
    items = [(i, " ".join(word() for _ in range(r.choice([2, 3, 12, 30])))) for i in range(15)]
    rows = []
    for k in range(80):
        text = [word() for _ in range(r.randint(0, 80))]
        if k % 2:
            copy = [w if r.random() > k % 5 * 0.15 else word() for w in r.choice(items)[1].split()]
            at = r.randint(0, len(text))
            text[at:at] = copy
        rows.append((k, " ".join(text)))
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, text in rows:
        t = text.split()
        for i, item in items:
            w = item.split()
            n = min(4, len(w))
            if not {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} & {tuple(t[j : j + n]) for j in range(len(t) - n + 1)}:
                continue
            h = np.zeros((len(w) + 1, len(t) + 1), int)
            for a in range(len(w)):
                for b in range(len(t)):
                    h[a + 1, b + 1] = max(0, h[a, b] + (1 if w[a] == t[b] else -1), h[a, b + 1] - 1, h[a + 1, b] - 1)
            if h.max() >= 0.4 * len(w):
                want[k, i] = h.max()
    assert got == want and any(len(items[i][1].split()) < 4 for _, i in got)


def _components(sets):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}, links


def test_large_regions_are_parted_and_joined_exactly(spark, monkeypatch):
    """Families that share most of their words without being alike, pairs in them that are, and blocks that hold next to nothing."""
    r = random.Random(5)
    rows = []
    for family in range(3):
        common = [f"f{family}w{i}" for i in range(60)]
        for k in range(40):
            own = [f"x{r.randrange(10**6)}" for _ in range(r.choice([12, 25, 40]))]
            rows.append((len(rows), " ".join(common + own)))
            if k % 4 == 0:
                rows.append((len(rows), " ".join(common + own[:-2] + ["q", "r"])))
    sets = {i: _sketch(t) for i, t in rows}
    want, links = _components(sets)
    assert links >= 30
    df = spark.createDataFrame(rows, DOCS)
    for block, depths in ((256, near_dedup.DEPTHS), (3, (4, 6, 8, 12, 16))):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "DEPTHS", depths)
        assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()} == want


def test_recall_on_pairs_around_the_border(spark):
    r = random.Random(6)
    rows, true = [], 0
    for p in range(400):
        base = [f"b{r.randrange(10**7)}" for _ in range(104)]
        edit = list(base)
        for at in r.sample(range(0, 100, 5), r.choice([2, 3, 4])):
            edit[at + 4] = f"e{r.randrange(10**7)}"
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(edit))]
    sets = {i: _sketch(t) for i, t in rows}
    alike = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 800, 2)}
    assert min(alike.values()) < 0.75 < max(alike.values()) and sum(0.7 <= x <= 0.8 for x in alike.values()) > 100
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    true = [i for i, x in alike.items() if x >= 0.75]
    assert all(got[i + 1] == i for i in true) and all(got[i + 1] == i + 1 for i in alike if i not in true)
