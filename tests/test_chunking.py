import random

from pyspark.sql import functions as F

from plumbline.operators import chunking


def _split(text, most, overlap):
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while True:
        end = min(start + most, len(text))
        if end < len(text):
            at = text.rfind("\n", start + most - min(2000, most // 3), end)
            end = at if at > start else end
        out.append(text[start:end])
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def test_split_long_equals_a_plain_loop(spark):
    r = random.Random(3)
    texts = ["", "ab", "x" * 10, *["".join(r.choice("abc\né") for _ in range(r.randint(5, 200))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", chunking.split_long(F.col("t"), 30, 4).alias("p"))
    assert {x.n: x.p for x in df.collect()} == {n: _split(t, 30, 4) for n, t in enumerate(texts)}


def test_pages_are_packed(spark):
    text = "".join(f"--- 第 {i} 页 / 共 9 页 ---\n{'y' * n}\n" for i, n in enumerate([5, 5, 80, 5, 20, 1], 1))
    df = chunking.chunks(spark.createDataFrame([(1, text)], "report_id long, raw_text string"), 60)
    got = [x.text for x in df.orderBy("chunk_no").collect()]
    assert [len(x) <= 60 for x in got] == [True] * len(got) and got[0].count("---") == 4 and got[-1].count("第 6 页") == 1


def _pieces(text, most, overlap):
    """Pieces of a text one after the other, as said."""
    window, start, out = min(2000, most // 3), 0, []
    if len(text) <= most:
        return [text]
    while True:
        end = min(start + most, len(text))
        cut = text.rfind("\n", start + most - window, end) if end < len(text) else -1
        end = cut if cut > start else end
        out.append(text[start:end])
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def test_pieces_and_packs_equal_a_plain_loop(spark):
    import random

    r = random.Random(1)
    texts = ["".join(r.choice("abé😀 \n") if k % 3 else r.choice("xyz") for _ in range(r.randrange(400))) for k in range(60)] + ["", "é" * 50, "é" * 51]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most, overlap in ((50, 7), (9, 2)):
        got = {x.i: x.p for x in df.select("i", chunking.split_long(F.col("t"), most, overlap).alias("p")).collect()}
        assert got == {i: _pieces(t, most, overlap) for i, t in enumerate(texts)}
    rows = [(k, ["s" * r.randrange(1, 30) for _ in range(r.randrange(12))]) for k in range(80)]
    want = {}
    for k, segments in rows:
        out, now = [], ""
        for s in segments:
            if len(s) > 20:
                out += ([now] if now else []) + _pieces(s, 20, chunking.OVERLAP)
                now = ""
            elif now and len(now) + len(s) > 20:
                out, now = [*out, now], s
            else:
                now += s
        want[k] = out + ([now] if now else [])
    assert {x.k: x.p for x in spark.createDataFrame(rows, "k int, s array<string>").select("k", chunking.pack(F.col("s"), 20).alias("p")).collect()} == want


def test_ten_million_characters_are_cut_in_linear_time(spark):
    import time

    took = []
    for lines in (50_000, 500_000):  # 1 and 10 million characters
        df = spark.range(1, 2, 1, 1).select(F.repeat(F.lit("é2345678901234567 9\n"), F.col("id").cast("int") * lines).alias("t"))
        begin = time.time()
        n, chars = df.select(F.explode(chunking.split_long(F.col("t"))).alias("p")).agg(F.count("*"), F.sum(F.length("p"))).first()
        took.append(time.time() - begin)
        assert n > lines * 20 // chunking.MAX_CHARS and chars > lines * 20
        packed = df.select(F.explode(chunking.pack(F.split("t", "\n"))).alias("p")).agg(F.max(F.length("p")), F.sum(F.length("p"))).first()
        assert tuple(packed) == (chunking.MAX_CHARS // 19 * 19, lines * 19)
    assert took[1] < 25 * took[0] + 5
