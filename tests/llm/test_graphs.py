"""Url filters, prefix tries and source audits beside plain loops, and what round 2 found in other operators."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, divergence, pii, quality, trie, url_filter, warc

PAGES, TURNS = "page_id long, url string, html string", "conv_id long, turn int, role string, text string"


def _host(url):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    lower = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    return (lower(m[1]), m[2]) if m else ("", "")


def _rule(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(str(r)), default=None)


def _judged(rows):
    """Rule, verdict, trust and distrust of every page, hop by hop over a dictionary."""
    seeds, links = defaultdict(Counter), set()
    for _, url, _ in rows:
        host, path = _host(url)
        if host:
            rule = _rule(host, path)
            seeds[host][rule.verdict if rule else None] += 1
    for _, url, html in rows:
        host, html = _host(url)[0], "".join(c.lower() if c.isascii() else c for c in html or "")
        names = {y for x in re.split("[^a-z0-9.-]+", html) if "." in (y := x.strip(".-"))} | set(re.findall(r"//([^/?#\"'\x20\x09-\x0D<>&]+)", html))
        links |= {(host, x) for x in names if host and x != host and x in seeds}
    got = {}
    for kind, verdict, ways in (("trust", "allow", links), ("distrust", "block", {(b, a) for a, b in links})):
        start = {h: 1000 * c[verdict] // max(1, c["allow"] + c["block"]) * 1_000_000 for h, c in seeds.items()}
        fan, now = Counter(a for a, _ in ways), dict(start)
        for _ in range(url_filter.ROUNDS):
            then = dict(start)
            for a, b in ways:
                then[b] += now[a] * 85 // 100 // fan[a]
            now = then
        got[kind] = now
    out = []
    for page, url, _ in rows:
        host, path = _host(url)
        rule, t, d = _rule(host, path), got["trust"].get(host, 0), got["distrust"].get(host, 0)
        out.append((page, host, path, str(rule) if rule else None, rule.verdict if rule else "block" if d >= 50_000_000 and d > t else "allow", t, d))
    return out


@pytest.mark.parametrize("piece", [url_filter.PIECE, 3])
def test_urls_beside_a_plain_loop(spark, piece, monkeypatch):
    monkeypatch.setattr(url_filter, "PIECE", piece)
    r = random.Random(4)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "m.") for b in ("example", "x", "EXAMPLE") for c in ("com", "net", "org", "com:80")] + ["com", "net", "notcom", "é.org"]
    rows = [(None, None, None), (None, "no scheme", "x.com"), (1, "http://", "//x.org"), (2, "http://www.example.com?/en/", ""), (2, "http://www.example.com?/en/", "")]
    for k in range(160):
        path = r.choice(["", "/", "/en/", "/en", "/es/1", "/fr/#a", "?q=/en/", "/de/a?x://y/"])
        links = "".join(r.choice([" see {}. ", '<a href="https://{}/a">', "<img src=//{}>", "a@{}", "{}x"]).format(r.choice(hosts)) for _ in range(r.randrange(6) if k % 9 else 0))
        rows.append((k, f"{r.choice(['http', 'HTTPS', 'a://b'])}://{r.choice(hosts)}{path}", links if k % 7 else None))
    rows += [(500 + i, "http://hub.org/", f"//{h}/") for i, h in enumerate(hosts)]
    df = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("own"), "rule": F.lit(1), "_host": F.lit("x"), "c0": F.lit(2)})
    got = url_filter.filter_urls(df)
    assert {"_host", "c0"} < set(got.columns)
    key = lambda x: tuple(str(v) for v in x)
    want = _judged(rows)
    assert sorted((tuple(x) for x in got.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()), key=key) == sorted(want, key=key)
    assert {"block"} == {x[4] for x in want if x[3] is None and x[6] > x[5] + 10**8} and any(x[3] is None and x[4] == "block" and x[5] for x in want)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def _trie(sequences):
    """Nodes of {conversation: turns} by a dictionary of prefixes."""
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for v in members:
        children[v[:-1]] += bool(v)
    for v, m in members.items():
        for d in range(len(v) + 1):
            leaves[v[:d]] += not children[v]
            saved[v[:d]] += (len(m) - 1) * len(v[-1][1].encode()) if v else 0
    ends = lambda v: ",".join(map(str, sorted(c for c in members[v] if len(sequences[c]) == len(v))))
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), children[v], leaves[v], saved[v], hashlib.sha256(ends(v).encode()).hexdigest()) for v, m in members.items())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_tries_beside_a_dictionary(spark, parts):
    """Copies, chains, conversations that end inside others, many under one first turn, over any number of partitions."""
    r = random.Random(parts)
    told = lambda k: ("user" if k % 2 else "assistant", "é" * (k % 5) + str(k))
    sequences = {}
    for c in range(-20, 200):
        s = [told(7)] * (c % 3 > 0) + [told(r.randrange(3)) for _ in range(r.randrange(6))]
        sequences[c] = tuple(s if c % 4 else [told(i) for i in range(c % 30)] if c % 8 else [told(1), told(2)])
    sequences[1000] = ()
    digest = lambda t: hashlib.sha256(repr(t).encode()).digest()[: trie.WIDTH]
    rows = [(c, [(digest(t), len(t[1].encode())) for t in s]) for c, s in sequences.items()]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turns array<struct<digest:binary,bytes:int>>")
        got = sorted(tuple(-1 if x is None else x for x in row) for row in trie.nodes(df).collect())
        empty = trie.nodes(df.limit(0)).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == _trie(sequences) and not empty


def test_range_minima_and_extents_beside_scans():
    r = np.random.default_rng(2)
    values = r.integers(0, 6, 83)
    table = trie.Minima(values)
    left = r.integers(0, 83, 200)
    right = np.minimum(82, left + r.integers(0, 83, 200))
    assert table.over(left, right).tolist() == [values[a : b + 1].min() for a, b in zip(left, right)]
    least = r.integers(0, 7, 200)
    for at, d, a, b in zip(left, least, table.leftmost(left, least), table.rightmost(left, least)):
        assert a == next(x for x in range(at + 1) if (values[x + 1 : at + 1] >= d).all()) and b == max(x for x in range(at, 83) if (values[at + 1 : x + 1] >= d).all())


def test_conversations_are_rebuilt_as_said(spark, tmp_path):
    rows = [(c, t if t else None, "user" if t % 2 else None, None if t == 3 else f"é{(c // 9, t)}") for c in range(60) if c % 7 for t in range(c % 13)]
    rows += [(None, 1, "user", "nobody"), (10, 2, "user", "again"), (10, 2, "user", "again"), (11, 1, "b", "x"), (11, 1, "a", "y")]
    spark.createDataFrame(rows, TURNS).withColumn("base", F.lit("own")).write.parquet(f"{tmp_path}/conversations.parquet")
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((-1 if t is None else t, role or "", text or ""))
    for c in own:
        told = lambda x: hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest()
        own[c] = [x[1:] for x in sorted(own[c], key=lambda x: (x[0], x[1], told(x)))]
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    rebuilt = {c: tuple(own.get(c - c % 5, [])[: h[c]] + s[h[c] :]) for c, s in own.items()}
    got = sorted(tuple(-1 if x is None else x for x in row) for row in trie.op12_prefix_trie(spark, str(tmp_path)).collect())
    assert got == _trie(rebuilt)


def _audit(rows):
    counts, holders = defaultdict(Counter), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        counts[lang, source] += Counter()
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            term = "".join(c.lower() if c.isascii() else c for c in term)
            counts[lang, source][term] += 1
            holders[lang, term].add(i)
    out = []
    for lang, source in counts:
        kept = [t for (x, t), h in holders.items() if x == lang and len(h) >= 3]
        of = lambda s: counts[lang, s]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, others = share(of(source)), [s for x, s in counts if x == lang and s != source]
        apart = lambda q, t: (p[t] - q[t]) ** 2 // q[t]
        pairs = sorted(((-sum(apart(q, t) for t in kept), s.encode()) for s in others for q in [share(of(s))]))
        q = share(sum((counts[x, s] for x, s in counts if x == lang), Counter()))
        terms = sorted((-apart(q, t), t.encode()) for t in kept if of(source)[t] and p[t] > q[t])[: divergence.TOP]
        out += [(lang, source, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, page, cells", [(divergence.BLOCK, divergence.PAGE, divergence.CELLS), (40, 3, 1)])
def test_audits_beside_counters(spark, block, page, cells, monkeypatch):
    monkeypatch.setattr(divergence, "PAGE", page)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "PART", divergence.PART if cells > 1 else 70)
    r = random.Random(9)
    rows = [(None, None, None), ("", "en", "empty"), ("ONE two", "once", "s1"), ("one", "once", "s2"), ("x1y2Ünder ünder", "en", None)]
    for _ in range(150):
        text = "".join(r.choice(["The", "the", "É", "é", f"w{chr(97 + r.randrange(26))}", "z" * r.randrange(1, 40), "日本"]) + r.choice([" ", "1", "_", "\x00", ". "]) for _ in range(r.randrange(40)))
        rows.append((text, r.choice(["en", "de", None]), f"s{r.randrange(5)}"))
    rows += [("hot " * 500, "en", "s0")] * 9
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"part": F.lit("own"), "shard": F.lit(1), "n": F.lit(2)})
    got = divergence.audit(df.repartition(5), block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(x) for x in got.collect()) == _audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_don_t_overflow():
    counts, totals = [0, 5, 10**15, 9 * 10**15 - 2], [1, 7, 10**15 + 9, 9 * 10**15]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals)]


def test_a_template_is_no_leak_and_costs_little(spark):
    """Items that share their wording: a text that holds it meets none of them, and one that holds an item's own words meets that one."""
    r = random.Random(2)
    word = lambda: f"w{r.randrange(10**6)}"
    template = [f"t{i}" for i in range(8)]
    items = [(i, " ".join(template + [word() for _ in range(5)])) for i in range(8000)]
    rows = [(0, " ".join([word() for _ in range(40)] + template + [word() for _ in range(40)])), (1, f"{' '.join(template)} x y {items[77][1]}")]
    block = decontaminate.Items(items, 4)
    held = decontaminate.Items([(i, " ".join(template)) for i in range(50)] + items[:100], 4)
    assert len(held.words) == 101 and [len(x) for x in held.ids][:2] == [50, 1]
    begin = time.time()
    for w in decontaminate.words_of(pa.array([rows[0][1]] * 50), decontaminate.LOOSE):
        assert not list(decontaminate._leaks(block, 0.4)(w))
    assert time.time() - begin < 5
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items + [(9000, items[77][1])], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.score) for x in found) == [(1, 77, 13), (1, 9000, 13)]


def test_ibans_end_where_their_country_says(spark):
    texts = ["account DE89370400440532013000 IBAN", "account DE89 3704 0044 0532 0130 00 OK", "account DE89 3704 0044 0532 0130 00, ok", "account DE89 3704 0044 0532 0130 0", "iban NO93 8601 1117 947 GB", "account ZZ89370400440532013000", "card 4111111111111111 card"]
    found = [r.pii for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [[(x.kind, x.hit) for x in own if x.kind == "iban"] for own in found] == [[("iban", "DE89370400440532013000")], [("iban", "DE89 3704 0044 0532 0130 00")], [("iban", "DE89 3704 0044 0532 0130 00")], [], [("iban", "NO93 8601 1117 947")], [], []]
    assert max(x.score for own in found for x in own) == 1.0


def test_the_field_s_loss_falls_along_its_gradient():
    r = np.random.default_rng(3)
    rows = np.array([0, 3, 3, 7, 8])
    x, good, weight = r.normal(size=(8, quality.WIDTH * 3 + 1)), np.array([True, False, False, True]), r.random(4)
    flat = r.normal(size=quality.WIDTH * 3 + 1 + 4) * 0.3
    chain = lambda f: quality.Chain(f[:-4], f[-4:].reshape(2, 2))
    value, grad = quality.loss(chain(flat), x, rows, good, weight, 0.01)
    for i in range(len(flat)):
        step = np.eye(len(flat))[i] * 1e-6
        up, down = (quality.loss(chain(flat + s * step), x, rows, good, weight, 0.01)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-5
    assert value > 0


def test_records_have_ids_of_their_own_and_headers_any_blanks(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, "http://c/", "x" * 20000), (3, "http://c/", "x" * 20000), (None, "http://d/", "n"), (None, "http://d/", "n"), (4, None, None)], PAGES)
    warc.write_archives(pages, f"{tmp_path}/a")
    ids = [r.uid for r in warc.records_of(spark, f"{tmp_path}/a").where("uid is not null").collect()]
    assert len(ids) == len(set(ids)) > 8
    got = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [(0, "response", None, 1), (0, "response", None, 1), (1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "response", None, 20000), (3, "response", None, 20000), (4, "response", None, 0)]
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding:chunked\r\n\r\n"
    assert warc._decode("response", head + b"2\r\nab\r\n0\r\n\r\n", None) == (b"ab", 2, None)
    assert warc._decode("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", None) == (None, None, None)
