"""Each operator against brute force on small tables, and on the rows that are easily forgotten."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, decontaminate, fingerprint, near_dedup, pii, quality, queries, substrings, toxicity, warc

from ..oracle import check

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 30000), (4, "x " * 30000), (5, "a b c d e f"), (5, "y"), (6, "é😀 " * 7)]


def docs(spark, rows):
    return spark.createDataFrame(rows, f"{DOCS}, label string").withColumn("set", F.lit(1)) if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, DOCS).withColumns({"sign": F.lit("own"), "prefix": F.lit(1)})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert check(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


def test_every_operator_stands_odd_and_empty_tables(spark):
    odd, labels = docs(spark, ODD), spark.createDataFrame([(5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (None, "q")], "item_id long, text string")
    made = {
        "leaks": lambda d: decontaminate.find_leaks(d, items), "clean": lambda d: decontaminate.decontaminate(d, items), "pii": lambda d: pii.find(d), "redact": lambda d: pii.redact(d), "cut": substrings.cut_repeats,
        "sketch": fingerprint.fingerprints, "next": fingerprint.compare_with_next, "toxic": lambda d: toxicity.score(d, toxicity.train(d, labels)), "near": near_dedup.near_duplicates, "one": near_dedup.keep_one,
        "bpe": bpe.round_trip, "ids": lambda d: bpe.decode(bpe.encode(d)), "quality": lambda d: quality.score(d, quality.train(d, labels)), "good": lambda d: quality.keep_good(d, quality.train(d, labels)),
    }
    per_row = {"pii", "redact", "cut", "sketch", "next", "toxic", "near", "bpe", "ids", "quality"}
    for name, run in made.items():
        assert run(odd.limit(0)).count() == 0, name
        n = run(odd).count()
        assert n == len(ODD) if name in per_row else n <= len(ODD), name


def test_decontamination_finds_edited_copies_only(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    rows, leaked = [], set()
    for k in range(60):
        text = [word() for _ in range(200)]
        if k % 3 == 0:
            copy = items[k % 20][1].upper().split()
            for j in range(5, 30, 8):
                copy[j] = word()
            text[50:50] = [w + "," for w in copy] if k % 2 else copy
            leaked.add((k, k % 20))
        rows.append((k, " ".join(text)))
    found = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaked
    assert all(0.5 < r.similarity <= 1 and 48 <= r.first_word <= 52 and 76 <= r.last_word <= 82 for r in found)
    blocks = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=100)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == leaked


@pytest.mark.parametrize("copies", [5, 50, 500])
def test_half_an_item_is_found_however_often_it_repeats(spark, copies):
    word = iter(random.Random(3).sample(range(10**6), 60 * copies + 60))
    item = [f"w{next(word)}" for _ in range(30)]
    texts = [[f"w{next(word)}" for _ in range(20)] for _ in range(copies)]
    whole = {-1: " ".join(item), -2: " ".join(item)} if copies == 50 else {}
    rows = [*whole.items(), *((k, " ".join(t + item[:15] + t)) for k, t in enumerate(texts)), (10**6, " ".join(texts[0] + item[:5])), (None, " ".join(item[:15]))]
    df, items = docs(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.score, r.first_word, r.last_word) for r in decontaminate.find_leaks(df, items).collect()}
    assert found == {k: (30, 0, 29) for k in whole} | {k: (15, 20, 34) for k in range(copies)} | {None: (15, 0, 14)}
    assert [r.doc_id for r in decontaminate.decontaminate(df, items).collect()] == [10**6]


def test_shared_words_bound_every_alignment():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(300):
        a, b = r.integers(0, 9, r.integers(1, 12)), r.integers(0, 9, r.integers(1, 15))
        assert decontaminate.align(a, b)[0] <= decontaminate.shared(a, b) == sum(min((a == x).sum(), (b == x).sum()) for x in set(a.tolist()))


def test_alignment_equals_the_full_table():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(1, 12)), r.integers(0, 5, r.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def _base(text):
    def spans(kind, pattern, good=lambda m: True):
        return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, re.A) if good(m.group())]

    def luhn(m):
        d = [int(c) for c in m if c.isdigit()][::-1]
        return 16 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    return [
        *spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), *spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        *spans("card", r"[0-9]([\x20-]?[0-9])+", luhn), *spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    ]


def test_personal_data_equals_brute_force(spark):
    r = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", " ", "é", "😀", "\n", ".", "9", "00", "a", "-", "_", "DE89370400440532013000", "+"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(400)]
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.pii if x.kind != "iban"] for r in pii.find(docs(spark, rows)).collect()}
    assert got == {i: _base(t) for i, t in rows}


def test_long_texts_don_t_recurse_or_square(spark):
    long = "1.1." * 30000 + "9" * 100000 + "a" * 100000 + "@" + "b." * 50000
    got = pii.find(docs(spark, [(1, long)])).first().pii
    assert [(x.start, x.end) for x in got if x.kind == "ip"] == [(x[1], x[2]) for x in _base(long[:120010]) if x[0] == "ip"]


def test_checksums_and_redaction(spark):
    row = (1, "card 4111 1111 1111 1111, iban DE89 3704 0044 0532 0130 00. mail a@b.co ip 10.0.0.1 call +49 30 1234567")
    assert pii.redact(docs(spark, [row, (2, None)])).orderBy("doc_id").collect()[0].text == "card [CARD], iban [IBAN]. mail [EMAIL] ip [IP] call [PHONE]"


def test_archives_put_segments_together(spark, tmp_path):
    pages = [(1, "a b", "x" * 500 + "\r\n\r\nWARC/1.1\r\nfoo" + "é😀" * 200 + "\r\n"), (2, None, None), (3, "u", ""), (None, "u", ""), (4, "q", "WARC/1.1\r\n" * 30), (4, "q", "WARC/1.1\r\n" * 30), (5, "r", "\r\n\r\n" * 90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for segment in (100, 7, 10**6):
        path = f"{tmp_path}/w{segment}"
        warc.write_archives(df, path, segment=segment)
        got = warc.read_archives(spark, path).collect()
        assert sorted(bytes(r.payload) for r in got if r.payload) == sorted(p[2].encode() for p in pages if p[2])
        assert not any(r.error for r in got) and sorted(r.record_type for r in got) == ["response"] * 5 + ["revisit"] * 2
        kinds = [r.kind for r in warc.records_of(spark, path).collect()]
        assert (kinds.count("continuation") >= 20) == (segment <= 100)
        uids = {r.uid: r.page_id for r in got if r.record_type == "response"}
        for r in warc.records_of(spark, path).where("kind = 'revisit'").collect():
            assert uids[r.refers_to] == 3
    warc.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_the_query_writes_continuations(spark, tmp_path):
    from plumbline.llm.tables import read

    warc.write_archives(read(spark, SMALL, "pages"), f"{tmp_path}/w")
    parts = {r.kind: r["count"] for r in warc.records_of(spark, f"{tmp_path}/w").groupBy("kind").count().collect()}
    long = sum(len(r.html or "") > 9000 for r in read(spark, SMALL, "pages").collect())
    assert parts.get("continuation", 0) >= long > 0


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(spark, tmp_path, packed):
    import gzip

    def record(kind, block, *more, version=b"WARC/1.0"):
        return b"\r\n".join([version, b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:" + str(len(block)).encode() + b">", *more, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"

    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n caf\xe9 \r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    info = b"software: x\r\n"
    data = record(b"warcinfo", info) + record(b"response", latin) + record(b"response", b"HTTP/1.1 200 OK\r\n\r\nab", b"WARC-Payload-Digest: sha1:WRONG") + record(b"metadata", b"") + record(b"resource", b"x" * 99)[:-40]
    with (gzip.open(f"{tmp_path}/a.warc.gz", "wb") if packed else open(f"{tmp_path}/a.warc", "wb")) as out:
        out.write(data)
    got = {r.uid: (r.record_type, bytes(r.payload), r.error) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    body = latin.partition(b"\r\n\r\n")[2]
    assert got == {
        f"urn:uuid:{len(info)}": ("warcinfo", info, None), f"urn:uuid:{len(latin)}": ("response", body, None), "urn:uuid:21": ("response", b"ab", "the digest differs"),
        "urn:uuid:0": ("metadata", b"", None), "urn:uuid:99": ("resource", b"x" * 63, "the record is cut off"),
    }


def test_broken_framing_is_told():
    assert warc.dechunk(warc.chunked("ab" * 10, 3).encode()) == b"ab" * 10
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab\r\n0\r\n\r\n")


def test_control_strings_survive(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]\\\\", "<", "/s>", ""]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\n{t}\n" for i, t in enumerate(texts)).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest() and got[2].n_turns == 1
    for p in chat.prompts(df).collect():
        assert chat.unescape(p.target) == texts[p.turn] and p.context.count("[INST]") == p.turn
    whole = "".join(r.segment for r in chat.formatted(df).where("conv_id = 1").orderBy("starts").collect())
    spans = chat.examples(df).orderBy("turn").collect()
    assert [chat.unescape(whole[r.target_from : r.target_to]) for r in spans] == texts[1::2]
    assert [whole[: r.context_chars] for r in spans] == [p.context for p in chat.prompts(df).orderBy("turn").collect()]


def test_the_reader_takes_pieces_of_any_length_and_refuses_wrong_spans():
    whole = "[INST]user[/INST]a[\\INST]b</s>[INST]assistant[/INST]<\\/s> é\\\\</s>"
    for size in (1, 3, 50):
        reader = chat._Reader(1)
        for at in range(0, len(whole), size):
            reader.text(whole[at : at + size])
        begin, opens = whole.index("<\\/s>"), whole.index("[INST]assistant")
        reader.example(opens, begin, whole.rindex("</s>"))
        assert reader.row() == (1, 2, hashlib.sha256("user\na[INST]b\nassistant\n</s> é\\\n".encode()).hexdigest(), 7, hashlib.sha256("</s> é\\".encode()).hexdigest(), len(whole), 1)
        for context, at in ((opens, begin + 1), (opens - 1, begin), (0, begin), (opens + 1, begin)):
            with pytest.raises(ValueError):
                reader.example(context, at, whole.rindex("</s>"))
    reader = chat._Reader(1)
    reader.text(whole)
    with pytest.raises(ValueError):  # a target without its example
        reader.row()


def test_sketches_merge_and_estimate():
    import pyarrow as pa

    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    one, two, both = fingerprint.sketches(pa.array([a, b, " ".join(words)]))
    assert abs(fingerprint.resemblance(one, two) - 1 / 3) < 0.12 and abs(fingerprint.containment(one, two) - 0.5) < 0.15
    assert abs(fingerprint.distinct(one) / 1996 - 1) < 0.25
    assert (fingerprint.parsed(fingerprint.spelled(one)) == one).all()
    assert len(set(fingerprint.merge(one, two)) & set(both)) >= fingerprint.K - 8


def _shingles(text):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"{r.randrange(10**6)}" for _ in range(60)]
        for k in range(25):
            text = list(base)
            for _ in range(k // 3):
                text[r.randrange(60)] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    sets = {i: _shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: root(i) for i in sets}
    small, near_dedup.BLOCK = near_dedup.BLOCK, 8
    try:
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()} == got
    finally:
        near_dedup.BLOCK = small


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    model = bpe.bpe(bpe.vocabulary())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("abcdetheing éß中\U0001f600\n\t0123!! 　 \x1c\x85²½'sABt_") for _ in range(r.randint(0, 60)))
        assert model.encode(text) == own.encode_ordinary(text)
    for text in ("a" * 20000, " " * 20000, "ab" * 9000):
        assert model.encode(text) == own.encode_ordinary(text)
    df = bpe.decode(bpe.encode(docs(spark, ODD)))
    assert all(bytes(x.bytes).decode() == (x.text or "") for x in df.collect())


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")
    for query, label, fold, least in ((queries.QUERIES["op10_quality"], "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1, 0.97), (queries.QUERIES["op7_toxicity"], "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0, 0.95)):
        rows = query(spark, d).join(labels, "doc_id").collect()
        held = [r for r in rows if r.held_out]
        assert all(r.held_out == fold(r.doc_id) for r in rows)
        assert sum(r.predicted == r[label] for r in held) / len(held) >= least


def test_chain_marginals_equal_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    chain = quality.Chain(r.normal(size=quality.WIDTH * 3 + 1), r.normal(size=(2, 2)))
    x, rows = r.normal(size=(7, quality.WIDTH * 3 + 1)), np.array([0, 3, 3, 7])
    unary = x @ chain.weights
    got = chain.marginals(x, rows)
    for a, b in ((0, 3), (3, 7)):
        total, good = 0.0, np.zeros(b - a)
        for ys in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(unary[a + i] * y for i, y in enumerate(ys)) + sum(chain.move[u, v] for u, v in zip(ys, ys[1:])))
            total += p
            good += p * np.array(ys)
        assert np.allclose(got[a:b], good / total)


def test_pipeline_beside_plain_loops(spark):
    import corpus_pipeline
    import numpy as np
    import pyarrow as pa
    import public_tokenizers
    import tiktoken

    from plumbline.llm.tables import read

    docs, labels, items = (read(spark, SMALL, name) for name in ("documents", "labels", "benchmark"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    scores = quality.scores(pa.array(list(texts.values())), quality.train(docs, labels))
    texts = {i: t for (i, t), s in zip(texts.items(), scores) if s >= 0.5}
    sets, up = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    texts = {i: t for i, t in texts.items() if root(i) == i}
    loose = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    split = lambda t: re.findall(r"[^ \t-\r]+", loose(t))
    known: dict = {}
    number = lambda words: np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    tests = [split(r.text or "") for r in items.collect()]
    clean = {}
    for i, t in texts.items():
        w = split(t)
        if not any(x and grams(x, min(4, len(x))) & grams(w, min(4, len(x))) and decontaminate.align(number(x), number(w))[0] >= 0.4 * len(x) for x in tests):
            clean[i] = t
    assert set(out) == set(clean) and len(clean) < docs.count()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.bpe(bpe.vocabulary()).ranks, special_tokens={})
    redacted = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(clean.items()), DOCS)).collect()}
    for i, text in redacted.items():
        assert out[i].text == text and out[i].ids == own.encode_ordinary(text) and out[i].n_tokens == len(out[i].ids)
        assert out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
