"""The ten operators against brute force, round trips and held-out accuracy, and their behaviour at the edges."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark.llm import decontaminate, html_extract, language, neardup, packing, pii, quality, queries, toolcalls, topk, warc
from roadspark.llm.common import cut, hash_runs, table, text_buffers
from roadspark.plans import lineage
from tests.oracle import same

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **more):
    return spark.createDataFrame([(k, t, more.get("lang"), None, None) for k, t in texts], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, spark, small):
    same(queries.queries()[name], queries.oracle_sql()[name], spark, small)


def test_words_and_hashes():
    import pyarrow as pa

    rows = ["a bb  ccc", "", None, "dddddddddddddddddd x", " ", "é a"]
    data, offsets = text_buffers(pa.array(rows, pa.string()))
    starts, ends, first = cut(data, offsets, ~table(b" "))
    got = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [(r or "").encode().split(b" ") if False else [w for w in (r or "").encode().split(b" ") if w] for r in rows]
    h = hash_runs(data, starts, ends)
    words = [w for r in got for w in r]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    base = ["Hello, world.", "don't <|endoftext|>", "Ünï ßx 12.5", "", None, " \n ", "x" * 3000]
    texts = [(k, base[k % 7] if k < 14 else " ".join(rnd.choice(["alpha", "Beta,", "gam.ma", "né"]) for _ in range(rnd.randint(1, 3000)))) for k in range(60)] + [(None, "no id"), (3, "again")]
    path = queries.tokenizer_path()
    rows = packing.pack(docs(spark, texts), "doc_id", "text", path, capacity=512, window=4096).collect()
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for k, t in texts:
        want[k, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id, r.doc_tokens].append(r)
        bins[r.sequence_id].append(r)
    for (k, raw), n in want.items():
        if n == 1 and sum(1 for (a, b) in want if a == k and len(b) == len(raw)) == 1:
            assert b"".join(bytes(r.ids) for r in sorted(by[k, len(raw) // 4], key=lambda r: r.start)) == raw
    assert sum(r.length for r in rows) == sum(len(raw) // 4 * n for (_, raw), n in want.items())
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 512 or at & (at - 1) == 0
    assert packing.pack(docs(spark, []), "doc_id", "text", path).count() == 0


def test_fill_is_optimal():
    rnd = random.Random(7)
    for _ in range(60):
        counts = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(6)}
        room = rnd.randint(1, 120)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.fill(dict(counts), room)
        assert all(got[n] <= counts[n] for n in got) and sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)


def test_warc(spark, tmp_path):
    big = "<p>" + "a" * 2000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "http://c \n x", "é" * 600), (5, "u", ""), (None, "n", big), (2, "http://b", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    out = warc.read(warc.write(pages, f"file://{tmp_path}/w", roll_bytes=300), f"file://{tmp_path}/w").collect()
    assert sorted(str((r.page_id, bytes(r.payload).decode())) for r in out if r.record_type == "response") == sorted(str(x) for x in [(2, big), (3, ""), (4, "é" * 600), (5, "")])
    assert sorted(str((r.page_id, r.refers_to)) for r in out if r.record_type == "revisit") == sorted(["(1, 2)", "(None, 2)", "(2, 2)"])
    assert {r.payload_digest for r in out if r.page_id == 1} == {hashlib.sha1(big.encode()).hexdigest()}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_is_deterministic(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k % 5}" + "z" * 1200) for k in range(50)] + [(None, f"n{k}", "<p>" + "y" * (900 + k)) for k in range(60)] + [(7, "same", "x" * 5000)] * 30, "page_id bigint, url string, html string")
    names = lambda d: sorted((r.path.rsplit("/", 1)[1], r.sha1) for r in warc.write(pages.repartition(3 + len(d)).withColumn("part", F.lit(1)), f"file://{tmp_path}/{d}", 500).collect())
    assert names("a") == names("bb") and len(names("c")) > 20
    assert sorted(x.name for x in (tmp_path / "a").iterdir() if not x.name.endswith(".gz")) == ["_manifest"]  # no temporary names are left
    monkeypatch.setattr(warc, "HOT", 1)  # next to no digest is hot
    monkeypatch.setattr(warc, "RANGES", 8)
    rest = {(r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(pages, f"file://{tmp_path}/r", 500), f"file://{tmp_path}/r").collect()}
    assert rest == {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages, 500).collect()}
    assert {x for x in rest if x[0] is not None and x[0] < 50 and x[0] != 7} == {(k, "response" if k >= 45 else "revisit", None if k >= 45 else 45 + k % 5) for k in range(50) if k != 7}
    long = spark.createDataFrame([(-(2**63), "u", "é" * 3_000_000), (2**63 - 1, "v", "é" * 3_000_000), (0, None, None)], "page_id bigint, url string, html string")
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(long).collect()} == {(-(2**63), 6_000_000, "revisit", 2**63 - 1), (2**63 - 1, 6_000_000, "response", None), (0, 0, "response", None)}


PAGE = """<html><head><title>x</title><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="sidebar"><p>Side, by, side text that is long enough.</p></div><main><article><h1>Title &amp; more</h1><p>First paragraph, with   commas,
and lines.<p>Second one &lt;b&gt; <b>bold</b><br>next</p><div class="ad"><p>Buy</p></div><ul><li>one<li>two</ul></article></main>
<form><p>Name</p></form><section id="comments"><p>Nice, very nice, so nice.</p></section><footer>End</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst paragraph, with commas, and lines.\nSecond one <b> bold next\none\ntwo"
    cases = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text"), (5, "u", "<<>&am &#65; <p"), (6, "u", "<div>" * 3000 + "deep"), (1, "u", PAGE)]
    pages = spark.createDataFrame(cases, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = {(r.page_id): r.text for r in html_extract.main_text(pages).collect()}
    assert out[1] == want and out[2] == out[3] == "" and out[4] == "unclosed text" and out[6] == "deep"
    plain = "<body><div id=content><p>" + "Real text, long, and good. " * 9 + "</p><p>Short end.</p></div><div class=menu><a href=1>a</a></div></body>"
    assert html_extract.extract(plain).endswith("Short end.")


def brute_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    words, hit, names = find(text), set(), set()
    for name, t in items:
        w = find(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    names |= {str(name)} if name is not None else set()
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("top, part", [("article", "section"), ("main", "div")])
def test_html_keeps_short_parts_of_an_article(top, part):
    long = [f"Paragraph {k}, with words, and more words, that go on for some time about one thing, {'and another ' * 12}end." for k in range(15)]
    rest = "<h3>Small heading</h3><pre>x = 1</pre><figure><figcaption>A caption</figcaption></figure><p>No comma here</p>"
    links = f"<{part}>" + "".join(f"<p><a href='/{k}'>Another page {k}</a></p>" for k in range(5)) + f"</{part}>"
    body = f"<h1>Title</h1><{part}>{''.join(f'<p>{t}</p>' for t in long)}</{part}><{part}><p>One short paragraph.</p></{part}>{rest}{links}"
    want = ["Title", *long, "One short paragraph.", "Small heading", "x = 1", "A caption", "No comma here"]
    page = f"<html><body><div><p>Outside, of it</p></div><{top}>{body}</{top}><div>Below</div></body></html>"
    assert html_extract.extract(page).split("\n") == want


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(9)
    vocab = [f"w{k}" for k in range(12)] + ["É1", "x_y"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, say(rnd.choice([3, 5, 20, 30]))) for k in range(12)] + [(50, None), (51, ""), (None, say(6)), (1, say(14))]
    texts = [(k, say(rnd.randint(0, 200)) + " " + (rnd.choice(items)[1] or "")) for k in range(40)] + [(90, None), (91, ""), (92, " ".join(["w1"] * 400)), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs(spark, texts).withColumns({"n_hit": F.lit(7), "Items": F.lit("x"), "c0": F.lit(1), "block": F.lit(2)})
    want = sorted(str(brute_hits(t, items)) for _, t in texts)
    for words, block, held in ((1 << 19, 4 << 20, 16 << 20), (64, 100, 1000)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
        monkeypatch.setattr(decontaminate, "PATTERN_CHARS", block)
        monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
        out = decontaminate.scan(frame, bench)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "c0", "block", "n_words", "spans", "n_hit", "items"]
        assert sorted(str((r.n_words, r.n_hit, list(r["items"]))) for r in out.collect()) == want
        assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1  # one pass, whatever the blocks
    assert decontaminate.scan(docs(spark, texts), bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.scan(frame.where("false"), bench).count() == 0
    long = docs(spark, [(1, "w1 " * 300_000 + items[4][1] + " w2" * 300_000)])
    assert decontaminate.scan(long, spark.createDataFrame([(1, "zz " + items[4][1])], "item_id bigint, text string")).head().n_hit == 0


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "add", '{"y": 2, "x": 1}', None), (1, "b", 2, "add", '{"x": "1"}', ["a"]), (1, "c", 3, "add", "not json", ["b", "z"]), (1, "c", 4, "add", "{}", None),
        (2, "p", 1, "fly", "{}", ["q"]), (2, "q", 2, "add", '{"x": 1, "y": 2, "w": 3}', ["p"]), (2, "r", 3, "add", '{"x":1,"y":1.5}', ["q"]), (None, None, 1, "add", None, None),
    ]
    calls += [(3, "d", 5, "add", '{"x": 1, "y": 1}', None)] * 3 + [(None, "n", 1, "add", "{}", ["a"]), (4, None, 1, "add", "{}", None), (5, "u", 1, "add", '{"x": 1, "y": 1, "z": "%s"}' % ("long " * 200_000), None)]
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "number", True)], "name string, param string, kind string, required boolean")
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 5, "three"), (9, "a", 1, "lost")], "conv_id bigint, call_id string, seq bigint, content string")
    frame = spark.createDataFrame(calls, "conv_id bigint, call_id string, seq bigint, name string, arguments string, after array<string>").withColumns({"row": F.lit(1), "first": F.lit(2), "level": F.lit(3), "args": F.lit(4)})
    out = toolcalls.link(frame, results.withColumn("n_results", F.lit("x")), schemas)
    got = {(r.conv_id, r.call_id, r.seq): r for r in out.collect()}
    assert out.count() == len(calls) and sorted(r.status for r in out.collect() if r.call_id == "d") == ["duplicate", "duplicate", "unanswered"]
    assert {r.status for r in out.collect() if r.conv_id is None or r.call_id is None} == {"unanswered"} and got[5, "u", 1].violations == ["unknown:z"] and len(got[5, "u", 1].json) > 10**6
    assert toolcalls.link(frame.where("false"), results, schemas).count() == 0 and toolcalls.link(frame, results.where("false"), schemas.where("false")).count() == len(calls)
    assert got[1, "a", 1].status == "linked" and got[1, "a", 1].result == "three" and got[1, "a", 1].n_results == 2
    assert [got[1, x, n].level for x, n in (("a", 1), ("b", 2), ("c", 3))] == [0, 1, 2] and got[1, "c", 4].status == "duplicate"
    assert got[1, "b", 2].violations == ["missing:y", "type:x"] and got[1, "c", 3].violations == ["not an object", "after:z"]
    assert got[2, "p", 1].status == "cyclic" and got[2, "p", 1].violations == ["unknown tool"] and got[2, "q", 2].violations == ["unknown:w"] and got[2, "r", 3].violations == []
    assert got[1, "a", 1].json == '{"arguments":{"x":1,"y":2},"call_id":"a","level":0,"name":"add","result":"three","status":"linked"}'
    assert "MapIn" not in out._jdf.queryExecution().toString() and "Python" not in out._jdf.queryExecution().toString()


def test_quality(spark, small):
    rows = queries.op6_quality(spark, "/root/testdata/sf0.01").join(queries.read(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(x >= 0.3 for x in good) / len(good) > 0.95
    edge = docs(spark, [(1, None), (2, ""), (None, "some text"), (3, "z" * 200_000), (3, "again")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality.classify(edge, none).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5}
    assert {r.held_out for r in out if r.doc_id == 3} == {zlib.crc32(b"3") % 5 == 0}
    assert quality.classify(docs(spark, []), none).count() == 0


def plain_scores(texts, label):
    """Scores of texts {id: text} learnt from label {id: 0 or 1}, with numpy's own covariance, determinant and solver."""
    import pyarrow as pa

    stats = {i: quality.statistics(*text_buffers(pa.array([t or ""], pa.string())))[0] for i, t in texts.items()}
    learn = {i: label[i] for i in stats if label.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    x, y = np.array([stats[i] for i in learn]), np.array(list(learn.values()))
    centre, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-12))
    z = (x - centre) / scale
    n, d = [int((y == c).sum()) for c in (0, 1)], quality.FEATURES
    assert min(n) >= 2
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    spread = []
    for c in (0, 1):
        lean = max(quality.POOL, d / (n[c] + d))
        mixed = (1 - lean) * own[c] + lean * pooled
        spread.append((1 - quality.DIAGONAL) * mixed + quality.DIAGONAL * np.diag(np.diag(pooled)) + quality.RIDGE * np.eye(d))
    out = {}
    for i in stats:
        v = (stats[i] - centre) / scale
        logs = [-0.5 * ((v - z[y == c].mean(axis=0)) @ np.linalg.solve(spread[c], v - z[y == c].mean(axis=0)) + np.linalg.slogdet(spread[c])[1]) + np.log(n[c] / sum(n)) for c in (0, 1)]
        out[i] = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return out


def test_quality_against_plain_formula(spark):
    source = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.read(spark, source, "documents").collect()}
    want = plain_scores(texts, {r.doc_id: r.quality for r in queries.read(spark, source, "labels").collect()})
    for r in quality.classify(queries.read(spark, source, "documents"), queries.read(spark, source, "labels")).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-5
    model = quality.learnt(queries.read(spark, source, "documents"), queries.read(spark, source, "labels"))
    clash = queries.read(spark, source, "documents").withColumn("score", F.lit("x")).withColumn("c0", F.lit(1))
    out = quality.score_texts(clash, model)
    assert sorted(out.columns) == sorted(clash.columns) and out.schema["score"].dataType.simpleString() == "double" and out.count() == len(texts)
    assert quality.score_texts(clash.where("false"), model).count() == 0


def test_quality_tells_whole_lines_apart():
    import pyarrow as pa

    rnd = random.Random(5)
    same_start, texts = "junk word " * 40, ["", "one line"]
    for _ in range(40):
        pool = [same_start[: rnd.choice([127, 128, 129, 200, 256, 400])] + rnd.choice(["", "a", "b", "ab" * 64, "ba" * 64]) for _ in range(4)]
        texts.append("\n".join(rnd.choice(pool) for _ in range(9)))
    texts.append("x" * 300 + "y" * 128 + "z" * 128 + "\n" + "x" * 300 + "z" * 128 + "y" * 128)
    got = quality.statistics(*text_buffers(pa.array(texts, pa.string())))[:, 21]
    for text, share in zip(texts, got):
        lines = [line for line in text.split("\n") if line]
        assert share == len(set(lines)) / max(len(lines), 1)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]"]


def plain_spans(text):
    """(kind, start, end) of the patterns' matches that keep their rules."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            n = re.sub(r"\D", "", m.group())
            if [True, k == 1 and len(n) < 200 and all(int(x) <= 255 for x in m.group().split(".")), k == 2 and 13 <= len(n) <= 19 and pii.luhn(n), 9 <= len(n) <= 15][k]:
                out.append((k, m.start(), m.end()))
    return out


def test_pii(spark):
    texts = [
        (1, "mail a.b+c@x-y.co.uk, or é@x.y @x.y a@b.c@d.e now"), (2, "ip 1.2.3.4 256.1.1.1 001.2.3.4.5.6.7.8 and 1.2.3"), (3, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 378282246310005"),
        (4, "call +1 (988) 555-2485 or +12 34 or +123456789012345678"), (5, None), (6, ""), (7, "call me at (988) 555-2485 tomorrow"), (8, "ééé 10.0.0.1"), (None, "nothing"), (9, "7" * 50_000 + " a@b.cd"),
    ]
    got = {r.doc_id: r for r in pii.scan(docs(spark, texts)).collect()}
    for k, t in texts:
        if k != 9:
            assert got[k].base == pii.written(plain_spans(t or "")), t
    assert got[9].base == "email:50001:50007" and got[7].spans == "phone:11:25" and got[7].n_phone == 0 and got[7].redacted == "call me at <PHONE> tomorrow"
    assert got[5].redacted is None and got[8].redacted == "ééé <IP>"


#: Phrases that are not in the labelled table; personal data stands in {kind|...}.
HELD_OUT = """
Office: {phone|415-555-2671}
mail {email|joe[at]x.org} today
seen at {ip|2001:0db8:85a3::8a2e:0370:7334} last week
order 555-123-4567 shipped
Invoice number 020 7946 0958
Give us a call on {phone|020 7946 0958} before six.
Phone number: {phone|(212) 555-0147}
Her mobile is {phone|07700 900123} I think
Ring the helpline, {phone|0800 555 1234}, at once
telephone {phone|212.555.0199} for a table
Please text {phone|617 555 0102} when there
Fax {phone|030/1234567}
write {email|mary.ann (at) corp.example.com} about it
contact: {email|sales [at] shop.example.de}
send mail to {email|root@localhost}
the host {ip|fe80::1ff:fe23:4567:890a} replied
server at {ip|2001:db8::ff00:42:8329}
tracking number 123-456-7890 was scanned
your account 5551234567 has been charged
pages 100-200 and 300-400
the year 1984 and 2001 were good
about 3 000 000 people live here
isbn 978-3-16-148410-0
built between 1066 and 1485
version 10.4.2 build 20190412
it was 12:30:45 when he came
device 00:1B:44:11:3A:B7 was lost
thanks @someone for the help
at 5 pm on 12 May 2020
serial 0800 123 4567
ticket 415-555-2671 is closed
score 21-14 and 7-3
sum of 1 234 567 euro
https://example.com/a/2019/05/12345678
ratio 16:9 or 4:3
item 0555 123456 is out
price 1,234,567.89 dollars
call in 2015 or 2016
he was born 12.05.1978
room 415 in building 7
Reception desk: {phone|(020) 7946-0123}
If lost, call {phone|555 0148 221} now
Our fax is {phone|01632 960 983}
cell {phone|404.555.0163} works best
mi teléfono es {phone|0612 345 678} gracias
Sie erreichen mich am Telefon {phone|089/1234567} immer
Phone {phone|4045550163} or visit
contact us: {email|info(at)firm.example.org}
E-mail: {email|jo [at] example.com}
mail me, {email|x.y@intranet} works
dns {ip|2606:4700:4700::1111} is fast
ip {ip|fe80::1} answered
Order no 404-555-0163 cancelled
Invoice 0612 345 678 paid
batch 4045550163 tested
the years 1914-1918 were hard
lot 12 34 56 78 90 sold
a total of 404 555 016 units
ran 10:15:30 in all
Psalm 23:4 and 5:6
Follow @nasa today
the @ sign alone
version 2001.12.5 of it
the code 123 456 7890 expired
flight 555 0148 221 is late
temperature -5.5 to 12.75
from 1 234 567 to 7 654 321 people
chapter 4 page 1234567
model 404.555.0163 weighs 5 kg
"""


def test_pii_field_on_held_out_phrases():
    finder = pii.Finder(pii.field())
    hits = wrong = missed = 0
    for line in HELD_OUT.strip().split("\n"):
        parts, text, gold = re.split(r"\{(\w+)\|([^}]*)\}", line), "", set()
        for k in range(0, len(parts), 3):
            text += parts[k]
            if k + 1 < len(parts):
                gold.add((pii.KINDS.index(parts[k + 1]), len(text), len(text) + len(parts[k + 2])))
                text += parts[k + 2]
        got = set(finder.find([text])[0][1])
        hits, wrong, missed = hits + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hits / (hits + wrong) >= 0.9 and hits / (hits + missed) >= 0.9, (hits, wrong, missed)
    trained = {" ".join(w) for w, _ in pii.labelled_table()}
    assert not trained & set(re.sub(r"\{\w+\|([^}]*)\}", r"\1", HELD_OUT).split("\n"))


def test_pii_viterbi_against_all_paths():
    """Of all label sequences of short sentences the decoded one scores best, with words far from signals left out or not."""
    import itertools

    model = pii.field()
    score = lambda node, path: sum(node[i][y] for i, y in enumerate(path)) + sum(model.moves[a, b] for a, b in zip((0, *path), (*path, 0)))
    for text in ("call 555 0148", "we met", "mail a (at) b", "order 555-0148 now"):
        node = [model.emission(text.split(), i) for i in range(len(text.split()))]
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(node)), key=lambda path: score(node, path))
        assert abs(score(node, model.decode([node])[0]) - score(node, best)) < 1e-9
    words = "we said call me at (988) 555-2485 and then wrote many words in a row before 2019 came by and ended".split()
    full = model.decode([[model.emission(words, i) for i in range(len(words))]])[0]
    marks = [i for i, w in enumerate(words) if not pii.plain(w)]
    a, b = max(0, marks[0] - pii.CONTEXT), min(len(words), marks[-1] + pii.CONTEXT + 1)
    assert model.decode([[model.emission(words, i) for i in range(a, b)]])[0] == full[a:b] and not any(full[:a]) and not any(full[b:])


def test_pii_edges(spark):
    rows = [(1, None), (2, ""), (3, "call me at (988) 555-2485"), (3, "call me at (988) 555-2485"), (None, "a@b.cd"), (4, "words " * 300_000 + "mail x@y.zz now"), (5, "x [AT] é.org bob[AT]mail.org")]
    frame = docs(spark, rows).withColumns({"n_email": F.lit("x"), "Spans": F.lit(1), "c0": F.lit(2)})
    out = pii.scan(frame)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "c0", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted"]
    got = sorted(str((r.doc_id, r.n_email, r.spans)) for r in out.collect())
    end = len("words " * 300_000)
    assert got[:4] == sorted(str(x) for x in [(1, 0, ""), (2, 0, ""), (3, 0, "phone:11:25"), (3, 0, "phone:11:25")])
    assert str((4, 1, f"email:{end + 5}:{end + 11}")) in got and str((None, 1, "email:0:6")) in got
    assert pii.scan(frame.where("false")).count() == 0


def test_topk_edges(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rnd.normal(size=20)]) for k in range(150)] + [(100, [0.0] * 20), (300, [1.0] * 20), (301, None), (302, [float("nan")] * 20), (303, [None] + [1.0] * 19), (304, [1.0, 2.0]), (None, [1.0] * 20), (305, [0.5] * 20), (306, [0.5] * 20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = topk.search(df, df.where("vec_id % 100 = 0"), 10).collect()
    ints = [(i, np.floor(np.float32(v).astype(float) * 1024)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    ints = [(i, np.pad(v, (0, 20 - len(v)))) for i, v in ints]
    want = set()
    for n, (q, v) in enumerate(ints):
        if q % 100 == 0:
            top = sorted((-int(v @ w), i) for i, w in ints if i != q)[:10]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(top)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out} == want
    assert topk.search(df, df.where("false"), 10).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0])], "vec_id bigint, embedding array<double>")
    assert topk.search(huge, huge, 10).count() == 2
    assert topk.search(df.where("false"), df, 10).count() == 0 and topk.search(df.withColumn("score", F.lit("x")).withColumn("id", F.lit(1)), df.where("vec_id = 100"), 3).count() == 6


def test_topk_waves_and_large_rows(spark, monkeypatch):
    import time

    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=12) * rng.choice([0.1, 1, 5])]) for k in range(900)] + [(1000 + k, [1e6 + k, *[0.5] * 11]) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    want = {tuple(r) for r in topk.search(df, asked, 7).collect()}
    ints = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows}
    brute = set()
    for q in (i for i in ints if i % 100 == 0):
        top = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        brute |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(top)}
    assert want == brute
    monkeypatch.setattr(topk, "SEED_ROWS", 20)
    monkeypatch.setattr(topk, "STEP", 4)
    monkeypatch.setattr(topk, "CHUNK", 64)
    assert {tuple(r) for r in topk.search(df, asked, 7).collect()} == brute
    x = rng.integers(-1000, 1000, (16384, 64)).astype(float)
    x[7, 3] = 1e15
    began = time.time()
    topk.survivors(x[:128], x, np.full(128, 1e7))
    assert time.time() - began < 10  # one large component does not slow the others


def components_by_hand(texts, k, percent, raw=False):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    if raw:
        return label
    ids = collections.defaultdict(list)
    for x, (i, _) in zip(label, texts):
        ids[x].append(i)
    return sorted(str((i, len(s), min((y for y in ids[x] if y is not None), default=None))) for x, (i, _), s in zip(label, texts, sets))


@pytest.mark.parametrize("k,percent,hot", [(3, 85, 1000), (5, 80, 1)])
def test_near_duplicates(spark, k, percent, hot, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    monkeypatch.setattr(lineage, "HOT", hot)  # 1000: all keys are hot, 1: next to none
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 10**6 if hot > 1 else 0)
    rnd = random.Random(k)
    word = lambda: "w" + str(rnd.randint(0, 400))
    base = [[word() for _ in range(120)] for _ in range(4)]
    texts = []
    for n in range(110):
        w = list(base[n % 4])
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
            w[rnd.randrange(120)] = word()
        texts.append((n, " ".join(w)))
    texts += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "two one"), (None, texts[5][1]), (7, "x y z a b c"), (7, "x y z a b c"), (205, "lonely " * 50)]
    texts += [(None, "no id but twice here"), (None, "no id but twice here"), (None, ""), (300, "p q r s t u v"), (206, "p q r s t u v"), (300, "another text of one id"), (None, "alone without any id"), (207, "long " * 200_000 + "end")]
    frame = docs(spark, texts).withColumns({"gone": F.lit(1), "doc": F.lit(2), "key1": F.lit(3), "n_shingles": F.lit("x"), "c1": F.lit(4)})
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in neardup.grouped(frame, k=k, percent=percent).collect())
    labels = components_by_hand(texts, k, percent, raw=True)
    assert got == components_by_hand(texts, k, percent)
    kept = neardup.deduplicated(frame, k=k, percent=percent)
    assert kept.columns == frame.columns
    best = {}
    for x, (i, t) in zip(labels, texts):
        if (t or "").split():
            best[x] = min(best.get(x, (True, 0)), (i is None, i or 0))
    stay = collections.Counter(None if none else i for none, i in best.values()) + collections.Counter(i for i, t in texts if not (t or "").split())
    assert collections.Counter(r.doc_id for r in kept.collect()) == stay
    by = {(r.doc_id, r.text) for r in kept.collect()}
    assert (300, "another text of one id") in by and (300, "p q r s t u v") not in by and (206, "p q r s t u v") in by
    assert neardup.deduplicated(frame.where("false")).count() == 0


def test_near_duplicates_in_a_large_cluster(spark, monkeypatch):
    """A chain of texts, each much like the next only: a cluster of many tiles whose buckets are small, so that these are compared instead."""
    monkeypatch.setattr(neardup, "TILE", 8)
    rnd = random.Random(2)
    stream = [f"w{rnd.randint(0, 10**6)}" for _ in range(2000)]
    texts = [(n, " ".join(stream[n * step : n * step + 150])) for step in (4, 12) for n in range(120)]
    texts = list(enumerate(t for _, t in texts))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in neardup.grouped(docs(spark, texts), k=3, percent=85).collect())
    assert got == components_by_hand(texts, 3, 85)


@pytest.mark.parametrize("hot,few", [(1, 0), (1000, 0), (1000, 10**6)])
def test_components_against_a_walk(spark, hot, few, monkeypatch):
    monkeypatch.setattr(lineage, "HOT", hot)
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", few)
    monkeypatch.setattr(lineage, "FILE_ROWS", 20)
    rnd = random.Random(hot)
    edges = [(k, k + 1) for k in range(1000, 1040)] + [(2000 + rnd.randrange(60), 2000 + rnd.randrange(60)) for _ in range(45)] + [(3000 - k, 3000) for k in range(1, 30)] + [(3100, 3100 + k) for k in range(1, 30)] + [(2999, 3105), (9, 9)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {k: v for k, v in label.items() if k != 9}
    assert neardup.components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_near_duplicates_of_nothing(spark):
    assert neardup.grouped(docs(spark, [])).count() == 0


def test_language_against_plain_expectation_maximisation():
    """infer() against the same model written word by word: every token counted, languages in plain loops."""
    import math

    import pyarrow as pa

    rnd = random.Random(3)
    words = {0: "the and of cat dog house there".split(), 1: "der und die Katze Hund Haus dort".split(), 2: "le et de chat chien maison".split()}
    texts = [" ".join(rnd.choice(words[rnd.choice(mix)]) for _ in range(rnd.randint(1, 60))) for mix in ([0], [1], [2], [0, 0, 0, 1], [1, 2], [0, 1, 2]) for _ in range(12)] + ["", "12 €"]
    tables = np.random.default_rng(1).normal(-8, 2, (3, language.BUCKETS)).astype(np.float32)
    best, score = language.infer(*text_buffers(pa.array(texts, pa.string())), tables)
    for text, got, share in zip(texts, best, score):
        tokens = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
        if not tokens:
            assert got == -1 and share == 0
            continue
        like = []
        for w in tokens:
            _, _, codes, at = language.block_words(*text_buffers(pa.array([w], pa.string())))
            logs = [sum(float(t[c]) for c in codes) for t in tables]
            like.append([math.exp(max(x - max(logs), -40)) for x in logs])

        def em(allowed, steps):
            p = [1 / len(allowed) if k in allowed else 0.0 for k in range(3)]
            for _ in range(steps):
                post = [[a * b / max(sum(x * y for x, y in zip(row, p)), 1e-300) for a, b in zip(row, p)] for row in like]
                p = [sum(row[k] for row in post) / len(like) for k in range(3)]
            return p, sum(math.log(max(sum(a * b for a, b in zip(row, p)), 1e-300)) for row in like)

        first = em({0, 1, 2}, language.STEPS)[0]
        order = sorted(range(3), key=lambda k: (-first[k], k))
        chosen, value = em(set(order[:1]), 0)
        value -= language.PENALTY * math.log(len(tokens) + 1)
        for size in (2, 3):
            p, v = em(set(order[:size]), language.STEPS)
            v -= language.PENALTY * size * math.log(len(tokens) + 1)
            if v <= value:
                break
            chosen, value = p, v
        assert got == max(range(3), key=lambda k: chosen[k]) and abs(share - max(chosen)) < 1e-6


def test_language(spark):
    rows = language.identify(queries.read(spark, "/root/testdata/sf0.01", "documents")).where("held_out").join(queries.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    learn = [(k, "the cat and the dog run over there", "en", None, None) for k in range(40)] + [(100 + k, "die Katze und der Hund laufen dort", "de", None, None) for k in range(40)]
    edge = [(500, None, "en", None, None), (501, "", None, None, None), (502, "12 + 34 € …", "en", None, None), (503, "the cat und der Hund", None, None, None), (None, "the dog", None, None, None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(learn + edge, DOCS)).collect()}
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[0].lang_pred == "en" and got[100].lang_pred == "de" and got[None].lang_pred == "en"
    assert {r.lang_pred for r in language.identify(docs(spark, [(1, "some words")])).collect()} == {"und"}
    assert language.identify(docs(spark, [])).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    now = queries.read(spark, small, "documents")
    left = [now.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small).cache()
        assert now.columns == corpus_pipeline.COLUMNS
        left.append(now.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0.5 * left[0]
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == {r.doc_id for r in now.collect()}
    assert json.dumps(left)


def test_pipeline_against_plain_stages(spark, small):
    """The whole pipeline against each stage written out: plain formula, all pairs, all windows, plain patterns, the tokenizer itself."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in queries.read(spark, small, "documents").collect()}
    score = plain_scores(texts, {r.doc_id: r.quality for r in queries.read(spark, small, "labels").collect()})
    assert min(abs(x - queries.PREDICTED) for x in score.values()) > 1e-6
    texts = {i: t for i, t in texts.items() if score[i] >= queries.PREDICTED}
    line = sorted(texts.items())
    labels, best = components_by_hand(line, 5, 80, raw=True), {}
    for x, (i, t) in zip(labels, line):
        best.setdefault((x, None if (t or "").split() else i), i)
    texts = {i: texts[i] for i in best.values()}
    items = [(r.item_id, r.text) for r in queries.read(spark, small, "benchmark").collect()]
    windows = {}
    for name, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(name)
    sizes = {len(w) for w in windows}
    for i, t in list(texts.items()):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        hit = {x for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for x in range(k, k + n)}
        if hit and 20 * len(hit) >= len(w):
            del texts[i]
    finder = pii.Finder(pii.field())
    for i, t in texts.items():
        spans = plain_spans(t or "") + finder.find([t or ""])[0][1]
        for k, s, e in sorted(spans, key=lambda x: -x[1]):
            if not any(o != (k, s, e) and o[1] < e and s < o[2] for o in spans):
                t = f"{t[:s]}<{pii.KINDS[k].upper()}>{t[e:]}"
            else:
                t = None  # overlapping spans merge; those texts are only counted
                break
        texts[i] = t
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got, bins = collections.defaultdict(list), collections.Counter()
    for r in corpus_pipeline.run(spark, small).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id] += r.length
    assert set(got) == set(texts) and all(n == 4096 or n & (n - 1) == 0 for n in bins.values())
    for i, t in texts.items():
        if t is None:
            continue
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_pipeline_stages_at_the_edges(spark, small):
    import corpus_pipeline

    rows = [(1, None), (2, ""), (None, "some words of a text without an id"), (None, "some words of a text without an id"), (3, "word " * 100_000), (3, "word " * 100_000), (4, "mail a@b.cd and the rest of a text")]
    frame = docs(spark, rows).withColumns({"score": F.lit("x"), "spans": F.lit(1), "n_hit": F.lit(2), "key1": F.lit(3), "ids": F.lit("y"), "c0": F.lit(4)})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, small)
        kept[name] = sorted(str(r.doc_id) for r in out.select("doc_id").distinct().collect())
        assert stage(spark, frame.where("false"), small).count() == 0
    assert kept["near_duplicates"] == ["1", "2", "3", "4", "None"] == kept["decontamination"] == kept["personal_data"] == kept["packing"]
    assert corpus_pipeline.neardup_stage(spark, frame, small).count() == 5


def test_more_edges(spark):
    """Clashing columns, ties and repeated rows of the operators that read only what they name."""
    path = queries.tokenizer_path()
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "long " * 200_000)]
    frame = docs(spark, rows).withColumns({"start": F.lit("x"), "ids": F.lit("y"), "id": F.lit(1), "held_out": F.lit(2), "score": F.lit("z"), "c1": F.lit(3), "n": F.lit(4)})
    assert sum(r.length for r in packing.pack(frame, "doc_id", "text", path, capacity=64).collect()) == 2 * 3 + 1 + 200_001 or packing.pack(frame, "doc_id", "text", path, capacity=64).where("doc_id = 1").agg(F.sum("length")).head()[0] == 2 * packing.pack(frame.dropDuplicates(["text"]), "doc_id", "text", path, capacity=64).where("doc_id = 1").agg(F.sum("length")).head()[0]
    out = language.identify(frame.withColumn("lang", F.lit("en")))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and sorted(r.lang_pred for r in out.collect()) == ["en", "en", "en", "und"]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit(1))
    assert quality.classify(frame, none).count() == 4
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id bigint, url string, html string").withColumns({"payload": F.lit(1), "part": F.lit(2), "is_page": F.lit(3), "range": F.lit(4)})
    assert warc.round_trip(pages).count() == 3 and html_extract.main_text(pages).count() == 3


BODY = "<h1>Title</h1>" + "".join(f"<p>Paragraph {k}, with words, and more of them, to be long enough.</p>" for k in range(4))


@pytest.mark.parametrize("name", "main-menu main-nav post-comments article-comments content-sidebar post-footer text-ad content-ad story-related entry-share article-newsletter mainMenu topnav site-notice".split() + ["comment content"])
def test_html_names_of_what_is_no_content(name):
    assert "LEAK" not in html_extract.extract(f"<body><article>{BODY}<div class='{name}'><p>LEAK, leak, and more leaking text of some length.</p></div></article></body>")


@pytest.mark.parametrize("part", ['<p class="search-results">KEEP</p>', '<section id="share"><p>KEEP</p></section>', '<div class="has-sidebar"><p>KEEP</p></div>', '<div class="post category-social tag-ads">KEEP</div>', "<div class=entry-header><h2>KEEP</h2></div>"])
def test_html_names_of_content(part):
    assert html_extract.extract(f"<body><article>{BODY}{part}</article></body>").endswith("\nKEEP")


def test_html_sibling_articles_quotes_and_ties():
    two = html_extract.extract(f"<body><div class=menu>M</div><article>{BODY}</article><article><p>Second one.</p></article></body>")
    assert two.startswith("Title\n") and two.endswith("\nSecond one.")
    assert html_extract.extract(f"<main><h1>Head</h1><article>{BODY}</article><p>After, it</p></main>").startswith("Head\nTitle\n")
    assert html_extract.extract('<p>Before</p><a href="foo>text</a> more <p>end') == "Before"
    assert html_extract.extract('<p>Before</p><a href="foo>text</a> <b class="x">bold</b> end') == "Before\nbold end"
    assert html_extract.extract("<p>a<!-->b<!--->c<!-- d --!>e</ x>f</3>g") == "abcefg"
    equal = "<div id=l>{0}</div>".format("<p>Left side, as long, as the right one is.</p>" * 3) + "<hr><div><div><p>x</p></div></div>"
    assert html_extract.extract(f"<body>{equal}</body>").startswith("Left side")


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</x>" * 100_000, "<div>" * 100_000 + "<li></li>" * 50_000 + "x", "<p>" + "<span>" * 100_000 + "<hr>" * 100_000, "<header>" * 100_000 + "x", "<" * 500_000, '<a ="' * 150_000, "x" * 1_000_000])
def test_html_long_and_nested_pages_take_linear_time(page):
    import time

    began = time.time()
    html_extract.extract(page)
    assert time.time() - began < 20


def simplest(page):
    """The visible text of the article by plain regular expressions, for pages whose article is flat."""
    import html as entities

    article = re.search(r"<article>(.*)</article>", re.sub(r"(?s)<!--.*?-->|<(script|style|aside|form|footer|nav)\b.*?</\1>|<div class=\"(?:ad|menu|comments?|sidebar|notice)\">.*?</div>", "", page), re.S)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|blockquote|div|section|pre|table|tr|td)\b[^>]*>", article.group(1)) if article else []
    lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br ?/?>", " ", x))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_html_against_plain_expressions_on_all_pages(spark, small):
    pages = queries.read(spark, small, "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op3_html(spark, small).collect()}
    want = {r.page_id: simplest(r.html or "") for r in pages.collect()}
    assert {k: t for k, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values())
    assert html_extract.main_text(pages.where("false").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))).count() == 0


def test_pii_reads_batches_in_blocks(spark, monkeypatch):
    """A worker looks at a large batch block by block, and drops what another operator's task kept."""
    import tracemalloc

    import pyarrow as pa

    from roadspark.llm import common

    frame, taken = docs(spark, [(0, "a")]).select("doc_id", "text"), []
    real = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, *a, **b: taken.append(f) or real(self, f, *a, **b))
    pii.scan(frame)
    texts = [None if k == 3 else ("plain words here " * 500 + ("call me at 555-678-9955 tomorrow " if k % 100 == 0 else "")) for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["c0", "c1"])
    common.kept("other", lambda: 1)
    tracemalloc.start()
    try:
        (out,) = taken[0]([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    redacted = out.column(out.num_columns - 1).to_pylist()
    assert redacted == [t and t.replace("555-678-9955", "<PHONE>") for t in texts]
    assert common.kept("other", lambda: 2) == 2
    common.forgotten()
    assert peak < 60e6, peak  # 8.5 MB of text
