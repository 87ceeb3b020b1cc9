"""BPE, language identification, HTML, WARC and sharding, on hand-made cases and against plain versions."""

import base64
import hashlib
import html
import math
import random
import re
import time
from collections import Counter
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellsift.llm import bpe, density, langid, markup, shards, warc

TEXTS = ["", None, " ", "it's  we'll 'store\n\n x", "é漢字 ½ 123 4", "a" * 300, "word " * 2000, "'", "don't\t\r\n!!?? 's", "x  ", "same", "same"]


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.vocabulary(), "rb") as f:
        return f.read()


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "other", k) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string, offsets long")


def test_bpe_equals_tiktoken(spark, ranks):
    import public_tokenizers
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    rng = random.Random(0)
    alphabet = ["a", "b", "'s", "'ll", "'", " ", "  ", "\n", "1", "é", "漢", "!", "\t", "re", " "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)] + ["ab" * 200 + "!" * 99]
    encoder = bpe.ByteBPE(ranks)
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == other.encode_ordinary(text)
        assert encoder.decode(ids).decode() == text
        assert encoder.offsets(ids).tolist() == np.cumsum([0, *(len(encoder.tokens[i]) for i in ids[:-1])]).tolist()[: len(ids)]
    rows = bpe.digests(frame(spark), bpe.vocabulary()).collect()
    for r, text in zip(sorted(rows), TEXTS, strict=True):
        ids = np.array(other.encode_ordinary(text or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_every_code_point_is_split_as_tiktoken_splits_it():
    """Beside a letter, a digit, a sign and a space: with single bytes as the only tokens but the neighbour joined to a first byte, ids tell the pieces."""
    import public_tokenizers
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    leads = sorted({chr(k).encode()[0] for k in points})
    for beside in "a1! ":
        vocabulary = single | {beside.encode() + bytes([b]): 256 + k for k, b in enumerate(leads)}
        other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        own = bpe.ByteBPE(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in vocabulary.items()))
        # Each between line breaks, which belong to no piece with it but where it is white space itself.
        for a in range(0, len(points), 1 << 16):
            text = "".join(f"{beside}{chr(k)}{beside}\n" for k in points[a : a + (1 << 16)])
            assert np.frombuffer(next(own.encode(pa.array([text]))), "<u4").tolist() == other.encode_ordinary(text), (beside, hex(points[a]))


def test_bpe_round_trip_keeps_columns(spark):
    df = frame(spark)
    coded = bpe.encode(df, bpe.vocabulary())
    assert coded.columns == [*df.columns, "token_ids", "token_offsets"]
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(coded, bpe.vocabulary()).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    assert bpe.digests(df.where("false"), bpe.vocabulary()).count() == 0


def test_white_space_scan_is_associative():
    function, compose, every, _ = bpe.automaton()
    rng = np.random.default_rng(0)
    for _ in range(200):
        f, g, h = rng.integers(0, len(every), 3)
        assert compose[compose[f, g], h] == compose[f, compose[g, h]]
        assert (every[compose[f, g]] == every[g][every[f]]).all()


def slow_profile(text):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", low):
        marked = w + "\1"
        for n in langid.ORDERS:
            for k in range(len(marked) - n + 1):
                if marked[k : k + n] != "\1":
                    counts[marked[k : k + n]] += 1
    return counts


def test_language_profiles_count_what_a_loop_counts():
    texts = ["The cat, the hat", "", "éa b", "x", "12 !", "Cat\nCAT"]
    data = "".join(texts).encode()
    begin = np.cumsum([0, *(len(t.encode()) for t in texts)])[:-1]
    of, _, n = langid.counted(*langid.grams(np.frombuffer(data, np.uint8), begin))
    for d, t in enumerate(texts):
        assert sorted(n[of == d].tolist()) == sorted(slow_profile(t).values())


def test_language_identification(spark):
    rng = random.Random(1)
    words = {"aa": ["baba", "bobo", "abab", "obba"], "zz": ["zuzu", "ztzt", "tutz", "uzut"], "mm": ["mnim", "nimi", "mimn", "inni"]}
    rows = [(k, " ".join(rng.choices(words[lang := rng.choice(list(words))], k=20)), lang) for k in range(90)]
    df = spark.createDataFrame([*rows, (90, None, "aa"), (91, "12 ?!", None), (92, "", "zz"), (93, "baba bobo " * 9000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.learn(df.where("doc_id < 45"), "text", "lang")).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows)
    assert [got[k].lang_pred for k in (90, 91, 92, 93)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df, langid.learn(df.where("false"), "text", "lang")).collect()} == {"und"}


def test_out_of_place_distances_are_those_of_a_loop(spark):
    """Profiles, ranks and distances, with ties, repeated rows and clashing columns."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("abc d", k=rng.randint(0, 60))), rng.choice(["x", "y", "z", None])) for k in range(60)]
    rows += [rows[5], rows[5], (None, "abc abd", "x"), (77, None, "x")]
    df = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, lang string, lang_pred string, n int").repartition(3)
    code = lambda g: int(langid.mix(np.array([reduce(lambda key, c: (key << 21 ^ key >> 43 ^ ord(c)) & (1 << 64) - 1, g, len(g))], np.uint64))[0] >> np.uint64(20))
    totals = {}
    for _, text, lang in rows:
        if lang and text:
            totals.setdefault(lang, Counter()).update(slow_profile(text))
    order = lambda counts, n: [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[:n]]
    own = {lang: order(c, langid.OF_LANGUAGE) for lang, c in totals.items()}
    learned = langid.learn(df, "text", "lang")
    assert {name: profile.tolist() for name, profile in learned} == own
    expected = []
    for doc, text, _ in rows:
        profile = order(slow_profile(text or ""), langid.OF_DOCUMENT)
        far = {lang: sum(abs(p.index(g) - k) if g in p else langid.OF_LANGUAGE for k, g in enumerate(profile)) for lang, p in own.items()}
        best = min(sorted(far), key=lambda lang: far[lang])
        expected.append((doc, best, 1 - far[best] / (len(profile) * langid.OF_LANGUAGE)) if profile else (doc, "und", 0.0))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, learned).collect()]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert [(a, b, round(c, 9)) for a, b, c in sorted(got, key=key)] == [(a, b, round(c, 9)) for a, b, c in sorted(expected, key=key)]


def test_labels_without_number_are_not_all_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    df = spark.createDataFrame([(k, "abc " * (9 - k), f"l{k}") for k in range(8)], "doc_id long, text string, lang string")
    assert [name for name, _ in langid.learn(df, "text", "lang")] == ["l0", "l1"]


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/x>Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="post-content"><h2>Title &amp; more</h2><p>First  para with <a href=x>link</a> text and enough words to be dense.<p>Second
para is <b>bold</b>, and long enough to count as text too.<ul><li>one item<li>two item</ul></div><div class="comments"><p>A reader says something long that must not stay in the text.</p></div></div>
<div class="sidebar"><p>Side text side text side text</p></div><form><input name=q>search</form><footer>foot</footer></body>"""


def test_main_text(spark):
    expected = "Title & more\n\nFirst para with link text and enough words to be dense.\n\nSecond para is bold, and long enough to count as text too.\n\none item\n\ntwo item"
    assert density.main_text(PAGE) == expected
    assert density.main_text(None) == density.main_text("") == density.main_text("<html><body></body>") == ""
    assert density.main_text("plain &lt;text") == "plain <text"
    assert density.main_text("<article><p><b>open<br><p>next</article>") == "open\n\nnext"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = density.extract(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, len(expected)), (1, len(expected)), (2, 0)]
    assert density.extract(pages.where("false")).count() == 0


def test_main_text_in_several_sections():
    para = lambda c, n=300: f"<p>{(c + 'xyz ') * (n // 5)}</p>"
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Link number {k}</a>" for k in range(8)) + "</ul>"
    part = lambda c, n=300: para(c + "1", n) + para(c + "2", n) + para(c + "3", n)
    wrappers = [("<div id=content>", "</div>"), ("<article>", "</article>"), ("<main><article>", "</article></main>")]
    for begin, end in wrappers:
        page = f"<body>{menu}{begin}<h1>Heading</h1><div class=part>{part('a')}</div><p>Short.</p>{menu}<section>{part('b')}</section><section>{part('c', 50)}</section>{end}</body>"
        text = density.main_text(page)
        for word in ("Heading", "Short.", *(f"{c}{k}xyz" for c in "abc" for k in (1, 2, 3))):
            assert word in text, (begin, word)
        assert "Link" not in text
    text = density.main_text(f"<body>{menu}<article>{part('a')}</article><div>{part('b')}</div><div><p>{menu}</div></body>")
    assert "a1xyz" in text and "b1xyz" in text and "Link" not in text


def test_names_are_evidence_only():
    para = lambda c: f"<p>{(c + 'xyz ') * 50}</p>"
    article = "<h1>Heading</h1>" + para("a1") + para("a2") + para("a3")
    away = '<div class="comments"><p>Readers wrote this.</p></div><div class=related><a href=x>Read another one</a></div>'
    for names in ('class="content has-sidebar"', 'class="post-body overflow-hidden"', 'class="md:hidden"', "class=article-with-comments", "class=sidebar", "id=comments", "class=legal", "data-id='side'"):
        text = density.main_text(f"<body><div {names}>{article}</div>{away}</body>")
        assert all(w in text for w in ("Heading", "a1xyz", "a2xyz", "a3xyz")), names
        assert "Readers" not in text and "another" not in text, names
    for names in ("class=legal", "class=rating", "class=tags", "class=related-research", "class=side", "data-id='ad'", "title='a class=ad here'", "class='no-comments x'"):
        text = density.main_text(f"<body><article>{article}<section {names}>{para('b1')}</section></article>{away}</body>")
        assert "b1xyz" in text and "a1xyz" in text and "Readers" not in text, names


class Reader(HTMLParser):
    """Another reader of pages: text, tags and raw content in order."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found = []

    def add(self, text):
        if self.found and self.found[-1][0] == markup.TEXT:
            self.found[-1][2] += text
        else:
            self.found.append([markup.TEXT, "", text])

    def handle_starttag(self, tag, attrs):
        self.found.append([markup.OPEN, tag, [(k, v) for k, v in attrs]])
        if tag in ("script", "style"):
            self.found.append([markup.INNER, tag, ""])

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.found.append([markup.CLOSE, tag, ""])

    def handle_data(self, data):
        if self.found and self.found[-1][0] == markup.INNER:
            self.found[-1][2] += data
        else:
            self.add(data)

    def handle_entityref(self, name):
        self.add(f"&{name};")

    def handle_charref(self, name):
        self.add(f"&#{name};")


def test_pages_are_read_as_another_parser_reads_them():
    rng = random.Random(5)
    parts = ["<p>", "</p>", "<DIV class='a b' id=x>", "</div >", "text &amp; more ", "<!-- <p> -->", "<script>if (a<b) x='</p>';</script>", "<a href=\"/q?a=1&b=2\" title='1 > 0'>", "</a>", "<br/>", "İ a < b ", "<style>p > a {}</style>", "<!doctype html>", "<img alt='' src=u>", "\n", "<input disabled value>"]
    for _ in range(400):
        page = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        reader = Reader()
        reader.feed(page)
        reader.close()
        got = []
        for kind, tag, value in markup.scan(page, frozenset(("script", "style"))):
            if kind == markup.TEXT and got and got[-1][0] == markup.TEXT:
                got[-1][2] += value
            else:
                got.append([kind, tag, [(k, None if v is None else html.unescape(v)) for k, v in markup.attributes(value)] if kind == markup.OPEN else value])
        assert got == reader.found, page


def plain_densities(page):
    """Density and sum of every element, by recursion and the formulas, on a well-formed page."""
    from xml.etree import ElementTree

    def size(text):
        return len(" ".join((text or "").split()))

    def count(e, linked):
        linked = linked or e.tag == "a"
        c = size(e.text) + sum(size(x.tail) for x in e)
        lc, t, lt = (c if linked else 0), 0, 0
        for x in e:
            own = count(x, linked)
            c, lc, t, lt = c + own[0], lc + own[1], t + own[2] + 1, lt + own[3] + (x.tag == "a")
        seen[e] = c, lc, t, lt
        return seen[e]

    seen = {}
    root = ElementTree.fromstring(page)
    count(root, False)
    share = seen[root][1] / seen[root][0]
    density = {}
    for e, (c, lc, t, lt) in seen.items():
        t, lt = max(t, 1), max(lt, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e) if c else 0
        density[e] = 0.0 if not c else max(0.0, c / t * math.log(c / max(lc, 1) * t / lt) / math.log(base)) if base > 1 else c / t
    return [(e.tag, density[e], sum(density[x] for x in e)) for e in root.iter()]


def test_densities_are_the_formulas():
    rng = random.Random(6)

    def made(depth):
        if not depth or rng.random() < 0.2:
            return "words " * rng.randint(0, 9)
        tag = rng.choice(["div", "section", "a", "b", "article"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(60):
        page = "<body>x y" + made(5) + made(4) + "</body>"
        nodes = [n for n, _ in density.measure(density.parse(page)) if n.tag != "#page"]
        for n, (tag, d, total) in zip(nodes, plain_densities(page), strict=True):
            assert n.tag == tag and math.isclose(n.density, d, abs_tol=1e-9) and math.isclose(n.sum, total, abs_tol=1e-9), page


@pytest.mark.parametrize("part", ["<b>", '<a "', '<a x="', "<div>x", "<!-- ", "< ", "<title>", "<ul><li>", "<b><table></b>", "<p>x", "<p><button><b><div></div>", "&", "<meta "])
def test_hostile_pages_take_time_in_proportion(part):
    def seconds(n):
        begun = time.process_time()
        density.main_text("<body>" + part * (n // len(part)))
        warc.derive("i", "u", None, None, part * (n // len(part)))
        return time.process_time() - begun

    seconds(1000)
    assert seconds(200_000) < 8 * max(seconds(50_000), 0.1)


def test_case_of_letters_moves_nothing():
    text = density.main_text("<body>" + "İ" * 50 + "<SCRIPT>var a = '</p>'</Script><div><p>the lazy dog and more of the article</p></div></body>")
    assert text == "İ" * 50 + "\n\nthe lazy dog and more of the article"


def test_a_page_within_a_form():
    para = "<p>" + "long words of an article " * 12 + "</p>"
    text = density.main_text(f"<body><form id=all><div><h1>Heading</h1>{para * 3}</div><div><form action=/s><p>Search here</p><input></form></div></form></body>")
    assert text.startswith("Heading") and text.count("article") == 36
    assert density.main_text(f"<body><div>{para * 3}</div><form><p>Your name and address</p></form></body>").count("Your") == 0


def test_two_captures_of_an_address_have_ids_of_their_own(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<p>a", 5), (1, "http://h/", "<p>b", 6), (1, "http://h/", "<p>b", 6), (None, None, None, None)], "page_id long, url string, html string, header int")
    rows = warc.derivatives(warc.responses_of(pages)).collect()
    assert len(rows) == 8 and len({r.refers_to for r in rows}) == 3 and len({r.record_id for r in rows}) == 6
    for r in rows:
        assert f"WARC-Refers-To-Payload-Digest: {r.source_payload_digest}" in r.header and f"WARC-Refers-To-Block-Digest: {r.source_block_digest}" in r.header
        assert "WARC-Refers-To-HTTP-Header: Content-Type: text/html; charset=utf-8" in r.header


def test_warc_text_and_links_by_another_parser():
    rng = random.Random(8)
    parts = ["<p>", "</p>", "<div>", "</div>", "some words ", "<b>bold</b> ", "&eacute; &lt;", "<script>x<y</script>", "<a href='/l%d'>link</a>", "<img src=i%d.png>", "<br>", "\n", "<!-- c -->", "<title>T</title>"]
    for _ in range(200):
        page = "".join(x % k if "%d" in x else x for k, x in enumerate(rng.choices(parts, k=rng.randint(0, 25))))
        lines, links, inside = [""], [], None

        class Own(HTMLParser):
            def handle_starttag(self, tag, attrs):
                nonlocal inside
                if tag in warc.BREAKS:
                    lines.append("")
                if tag in ("script", "title"):
                    inside = tag
                for k, v in attrs:
                    if (tag, k) in (("a", "href"), ("img", "src")):
                        links.append(f"http://h/{v.strip('/')} {'L' if tag == 'a' else 'E'} {tag}/@{k}")

            def handle_endtag(self, tag):
                nonlocal inside
                if tag in warc.BREAKS:
                    lines.append("")
                if tag == inside:
                    inside = None

            def handle_data(self, data):
                if not inside:
                    lines[-1] += data

        Own().feed(page + " ")
        read = warc.Page(page, "http://h/")
        assert read.text == "\n".join(x for x in (" ".join(line.split()) for line in lines) if x) and read.links == list(dict.fromkeys(links)), page


def test_warc_records(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title><meta charset=UTF-8></head><body><p>One<p>Two &eacute;<script>x</script><a href='/a?b'>l</a></body></html>"
    df = spark.createDataFrame([(1, "urn:uuid:1", "http://h/x", None, "HTTP/1.1 200 OK\r\nX-A: b", page), (2, None, None, None, None, None)], "key long, record_id string, target_uri string, warc_date string, http_headers string, payload string")
    rows = {(r.key, r.warc_type): r for r in warc.derivatives(df).collect()}
    assert len(rows) == 4
    meta, text = rows[1, "metadata"], rows[1, "conversion"]
    assert text.block == "One\nTwo él" and "title: A & B" in meta.block and "outlink: http://h/a?b L a/@href" in meta.block and "http-header: X-A: b" in meta.block
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert meta.source_payload_digest == text.source_payload_digest == sha(page.encode()) and text.block_digest == sha(text.block.encode())
    assert f"WARC-Refers-To: <{text.refers_to}>" in text.header and text.refers_to == "urn:uuid:1" and f"<{text.record_id}>" in meta.header
    assert rows[2, "conversion"].block == "" and rows[2, "conversion"].target_uri is None
    warc.write(warc.derivatives(df).coalesce(1), str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part*"))
    at, seen = 0, 0
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        at += len(head) + 4 + length + 4
        assert raw[at - 4 : at] == b"\r\n\r\n"
        seen += 1
    assert seen == 4 and warc.derivatives(df.where("false")).count() == 0


def test_shards(spark):
    df = spark.createDataFrame([(k, "é" * (k % 5) if k % 7 else None, 1) for k in range(900)] + [(5, "dup", 1), (5, "dup", 1), (None, "x", 1)], "doc_id long, text string, slot int").repartition(5)
    rows = shards.shard_rows(df, shards.EIGHT, shards.NINE).collect()
    assert len(rows) == 903
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert 60 < sum(r.grown_shard == 8 for r in rows) < 150
    plain = {r.doc_id: r for r in rows}
    assert plain[6].size == 2 * 1 + 1 and plain[7].size == 1 and plain[7].text_crc32 == 0
    assert shards.shard_rows(df.where("false"), shards.EIGHT, shards.NINE).count() == 0


def test_weights_move_rows_only_into_what_grew(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    tree = {"a": {"r": {"0": 1.0, "1": 1.0}}, "b": {"r": {"2": 1.0}, "s": {"3": 3.0}}}
    heavier = {"a": tree["a"], "b": {"r": {"2": 1.0}, "s": {"3": 9.0}}}
    both = shards.assign(shards.assign(df, ["k"], tree), ["k"], heavier, "later")
    moved = both.where("path != later").select(F.col("path")[0], F.col("later")[0], F.col("later")[2]).distinct().collect()
    assert {tuple(r)[1:] for r in moved} <= {("b", "3"), ("b", "2")} and all(r[0] == "a" or r[2] == "3" for r in moved)
    share = both.groupBy(F.col("path")[2].alias("s")).count().collect()
    assert abs({r.s: r["count"] for r in share}["3"] - 2000) < 150
