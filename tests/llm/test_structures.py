import gzip
import math
import random
import time
from collections import Counter

import pytest

from tapeline.llm import licence, warc, wrapper


def test_tree_matching_aligns_lists():
    a = wrapper.parse("<div><h1>t</h1><p>one</p><ul><li>x</ul></div>")
    b = wrapper.parse("<div><p>one</p><p>two</p><ul><li>x<li>y</ul></div>")
    pairs = [(x.tag, x.text(), y.text()) for x, y in wrapper.align(a, b)]
    assert ("ul", "", "") in pairs and ("li", "x", "x") in pairs and len([p for p in pairs if p[0] == "p"]) == 1 and not [p for p in pairs if p[0] == "h1"]


def weight(x, y):
    """Simple tree matching by its plain recursion."""
    xs, ys = x.children(), y.children()
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, u in enumerate(xs):
        for j, v in enumerate(ys):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (weight(u, v) if u.label == v.label else 0))
    return 1 + table[-1][-1]


def test_tree_matching_is_the_largest():
    rng = random.Random(7)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["b", "i", "u"], k=rng.randrange(5)))

    for _ in range(150):
        a, b = wrapper.parse(tree(3)), wrapper.parse(tree(3))
        pairs = wrapper.align(a, b)
        assert len(pairs) == weight(a, b) and len({id(y) for _, y in pairs}) == len({id(x) for x, _ in pairs}) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)


def test_large_deep_and_broken_pages(monkeypatch):
    assert wrapper.extract("<div>" * 100_000 + "x") == "x"
    assert len(wrapper.align(wrapper.parse("<b>" * 3000 + "x"), wrapper.parse("<b>" * 3000 + "<i>x</i>"))) == 3001
    rng = random.Random(3)
    items = lambda: wrapper.parse("<ul>" + "".join(f"<li>{'<b>x</b>' * rng.randrange(4)}</li>" for _ in range(2000)) + "</ul>")
    a, b = items(), items()
    start = time.time()
    pairs = wrapper.align(a, b)
    assert time.time() - start < 5 and len(pairs) > 2000 and all(x.label == y.label for x, y in pairs)
    for broken, text in (('<a title="x ' * 20_000, None), ("<b" * 20_000 + ">y", "y"), ("<a 'x> z" * 20_001, None), ("a < b <3 c<", "a < b <3 c<"), ("<p title='a>b'>c</p>d", "c\nd"), ("<script>x", "")):
        start = time.time()
        got = wrapper.extract(broken)
        assert time.time() - start < 5 and (text is None or got == text), broken[:20]


@pytest.mark.parametrize("limit", [wrapper.WRAPPERS_BYTES, 0])
def test_wrapper_finds_the_region_without_names(spark, monkeypatch, limit):
    """Menus and footers that vary, with no telling tag or name: only the wrapper sets them apart from the text."""
    monkeypatch.setattr(wrapper, "WRAPPERS_BYTES", limit)
    story = "<h2>Head {0}</h2><p>first part {0} of a long story</p><p>second part {0} of it, long too</p><p>Read on at our shop</p>"
    page = "<body><div><a href=x>menu {0}</a></div><div><span><b>" + story + "</b></span></div><div>printed {0}</div></body>"
    rows = [(k, "http://h.example/x", page.format(k * 7)) for k in range(9)] + [(50, "http://other.example/", page.format(1))]
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert got[k] == f"Head {k * 7}\nfirst part {k * 7} of a long story\nsecond part {k * 7} of it, long too" != wrapper.extract(page.format(k * 7))
    assert got[50] == wrapper.extract(page.format(1))


def test_extract_article():
    page = (
        "<html><body><nav><li>Menu</nav><!-- c --><div class='ad'>Buy</div><div class='cookie-x notice'>Cookies</div><article><header><h1>A &amp; B</h1></header>"
        "<p><b>one\n two<br>x<p>three &eacute; &#233;<script>var t='</p>';</script><form>f</form><section class='comments'><p>reader</p></section></article><aside>s</aside><footer>f</footer>"
    )
    assert wrapper.extract(page) == "A & B\none two x\nthree é é"
    assert wrapper.extract(None) == "" == wrapper.extract("") and wrapper.extract("plain <b>text") == "plain text"
    assert wrapper.extract("<p>" + "w " * 100000).count("w") == 100000


def test_wrapper_of_pages_without_article(spark):
    page = "<body><div><p>Site name</p><p>text {0} of page</p><p>All rights reserved</p></div></body>"
    rows = [(k, f"http://H.example/{k}", page.format(k), "r") for k in range(12)]
    rows += [(20, "http://one.example/", page.format("x"), "r"), (21, None, None, "r"), (22, "no url", "", "r"), (1, "http://h.example/1", page.format(1), "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, reference string")
    got = wrapper.extract_pages(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 12:
            assert r.text == f"text {r.page_id} of page" and r.n_chars == len(r.text)
        if r.page_id == 20:
            assert r.text == "Site name\ntext x of page\nAll rights reserved"
        if r.page_id > 20:
            assert (r.text, r.n_chars) == ("", 0)
    assert wrapper.extract_pages(df.limit(0)).count() == 0


def test_wrapper_decides_over_article(spark):
    line = "<body><article><p>Subscribe to our letter</p><p>story {0}</p></article></body>"
    promo = "<body><article><p>Our offer</p></article><section><p>Site</p><p>text {0}</p></section></body>"
    other = "<body><div><p>Old site</p><p>note {0}</p></div></body>"
    copy = "<body><article><p>same one</p><p>same two</p></article></body>"
    rows = [(k, "http://a.example/", line.format(k)) for k in range(8)] + [(10 + k, "http://b.example/", promo.format(k)) for k in range(8)]
    rows += [(30 + k, "http://a.example/", other.format(k)) for k in range(8)] + [(50 + k, "http://c.example/", copy) for k in range(8)]
    rows += [(60 + k, "http://d.example/", copy.replace("two", f"two {k}")) for k in range(2)]
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"story {k}" for k in range(8)} | {10 + k: f"text {k}" for k in range(8)} | {30 + k: f"note {k}" for k in range(8)}
    assert got == want | {50 + k: "same one\nsame two" for k in range(8)} | {60 + k: f"same one\nsame two {k}" for k in range(2)}


def test_canonical_url(spark):
    urls = {
        "HTTP://www.Ex.com:80/a/?utm_source=x&b=2&a=1#f": "https://ex.com/a?a=1&b=2", "https://ex.com": "https://ex.com", "https://ex.com/?ref=q": "https://ex.com",
        "nothing": "nothing", "https://ex.com/a/b?refs=1": "https://ex.com/a/b?refs=1",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", warc.canonical_url(df.u).alias("c")).collect()} == urls


def test_resolve_revisits(spark):
    from pyspark.sql import functions as F

    rows = [
        ("r1", "response", "http://a/x", 10, {"etag": '"1"', "content-type": "t", "server": "s"}, "d1"),
        ("r2", "response", "http://a/x#z", 20, {"etag": '"2"', "last-modified": "m"}, "d2"),
        ("v1", "revisit", "https://a/x", 15, {"etag": 'W/"1"', "date": "now", "content-type": "no"}, None),
        ("v2", "revisit", "https://a/x", 20, {"etag": '"1"'}, "d1"),
        ("v3", "revisit", "https://a/x", 900, {"last-modified": "m"}, None),
        ("v4", "revisit", "https://a/x", 900, {"etag": '"1"'}, None),
        ("v5", "revisit", "https://a/x", 5, {}, None),
        ("v6", "revisit", "https://b/", 50, None, None),
        ("v7", "revisit", None, 50, {}, None),
        ("v8", "revisit", "https://a/x", None, {}, None),
        ("v9", "revisit", "https://a/x", 901, {"etag": '"2"'}, "other"),
        ("m1", "metadata", "https://a/x", 60, {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, s long, headers map<string,string>, digest string").withColumn("ts", F.timestamp_seconds("s"))
    df = df.withColumn("verdict", F.lit("clash"))
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.refers_to, r.verdict) for k, r in got.items()} == {
        "v1": ("r1", "resolved"), "v2": ("r1", "resolved"), "v3": ("r2", "resolved"), "v4": (None, "validators differ"), "v5": (None, "no response"),
        "v6": (None, "no response"), "v7": (None, "no response"), "v8": (None, "no response"), "v9": (None, "validators differ"),
    }
    assert got["v1"].headers == {"etag": 'W/"1"', "date": "now", "content-type": "t", "server": "s"} and got["v1"].digest == "d1"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_parse_warc(spark, tmp_path):
    def record(kind, payload, extra=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-02T03:04:05Z\r\n{extra}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\n<p>WARC/ body</p>"
    data = gzip.compress(record("warcinfo", b"x: y")) + gzip.compress(record("response", http, "Content-Type: application/http; msgtype=response\r\n"))
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("kind").collect()
    assert [(r.kind, r.status, r.headers.get("etag"), bytes(r.payload)) for r in got] == [("response", 200, '"1"', b"<p>WARC/ body</p>"), ("warcinfo", None, None, b"x: y")]
    assert str(got[0].ts) == "2024-01-02 03:04:05"


def test_licences(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/f.py", "code"), (3, "r/a/b/LICENSE.txt", "x\nLicensed under the Apache License, Version 2.0.\ny"), (4, "r/a/b/c/d.py", None),
        (5, "r/a/b/g.py", "some words\nThis work is licensed under the GNU General Public License, version 3."), (6, "s/f.py", ""), (7, None, mit), (8, "r/a/COPYING", "no known licence here"),
        (9, "top.py", "Licensed under CC BY-NC 4.0."), (9, "top.py", "Licensed under CC BY-NC 4.0."), (10, "r/z.py", "w " * 90000), (11, "s/NOLICENSE", mit + " but in a long line of quite other words that have little to do with it"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, path string, text string, own string")
    got = licence.scan(df).collect()
    assert len(got) == len(rows)
    assert {r.file_id: (r.own, r.licence, r.inherited_from) for r in got} == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "r"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "r/a/b"), 5: ("GPL-3.0", "GPL-3.0", None),
        6: (None, None, None), 7: ("MIT", "MIT", None), 8: (None, "MIT", "r"), 9: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 10: (None, "MIT", "r"), 11: (None, None, None),
    }
    assert licence.scan(df.limit(0)).count() == 0


def test_licences_match_plain_tf_idf(spark):
    fill = [" ".join(f"w{(k * 7 + n) % 90}" for n in range(12)) + " by and the of it that is" * (k % 3 > 0) for k in range(300)]
    telling = ["CC BY-NC 4.0", "Dedicated under CC0 1.0 Universal", "Released under the MIT License and that is it for w1", "Released under the MIT License unseen words follow here", "free software in the public domain", "version 3 of it"]
    texts = [*fill, *(f"{fill[k]}\n{t}" for k, t in enumerate(telling)), "\n".join(telling), None, ""]
    df, n = Counter(w for t in texts for w in set(licence.words(t or ""))), len(texts)

    def vector(t):
        return {w: c * math.log((1 + n) / (1 + df[w])) for w, c in Counter(licence.words(t)).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / (math.hypot(*a.values()) * math.hypot(*b.values()) or 1)

    templates = [(name, vector(t)) for name, t in licence.TEMPLATES]
    want = []
    for t in texts:
        score, name = max(((cosine(vector(x), v), name) for x in (t or "").splitlines() for name, v in templates), default=(0, None), key=lambda x: x[0])
        want.append((name, round(score, 6)) if score >= licence.THRESHOLD else (None, 0))
    rows = [(k, f"s/{k}.txt", t) for k, t in enumerate(texts)]
    got = {r.file_id: (r.own, round(r.score, 6)) for r in licence.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert [got[k] for k in range(n)] == want and {w[0] for w in want} >= {"CC-BY-NC-4.0", "CC0-1.0", "MIT"}


def test_damaged_warc_files():
    def record(name, body, length=None):
        return f"WARC/1.0\r\nWARC-Record-ID: {name}\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n{body}\r\n\r\n".encode()

    read = lambda data: [(r["record_id"], bytes(r["payload"])) for r in warc.parse_records(data)]
    assert read(record("a", "one", "x3") + record("b", "two")) == [("a", b"one"), ("b", b"two")]
    assert read(record("a", "one", "") + b"junk") == [("a", b"one\r\n\r\njunk")]
    assert read(record("a", "", "-5") + record("b", "two"))[-1] == ("b", b"two")
    whole = b"".join(gzip.compress(record(str(k), "body " * 50)) for k in range(2000))
    assert len(read(whole)) == 2000
    assert [n for n, _ in read(whole[:-30])][:1999] == [str(k) for k in range(1999)]
    assert len(read(whole[:5000] + b"broken" + whole[5006:])) >= 1
    assert read(b"") == read(b"nothing") == read(b"WARC/1.0 no end") == []


def _paragraphs(rng, n):
    return [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12)) for _ in range(n)]


@pytest.mark.parametrize("frame", ["<body><article>{}</article></body>", "<body><div class=story>{}</div></body>", "<body><div><p>Site</p></div><div><section>{}</section></div></body>"])
@pytest.mark.parametrize("copies", [8, 40])
@pytest.mark.parametrize("place", ["one", "any"])
def test_near_copies_keep_their_text(spark, frame, copies, place):
    """Copies of one article that differ in a paragraph, the only articles of their host: none of their paragraphs is template."""
    rng = random.Random(copies)
    base, rows, want = _paragraphs(rng, 6), [], {}
    for k in range(copies):
        parts = ["Title here", *base]
        parts[3 if place == "one" else 1 + k % 6] = f"edited {k} " + _paragraphs(rng, 1)[0]
        rows.append((k, "http://h.example/", frame.format(f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:]))))
        want[k] = "\n".join(parts)
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: t.removeprefix("Site\n") for k, t in got.items()} == want


def _brute(pages):
    """The wrapper's rules over the known articles of one host: a block of the article is template if it is the same in nine of ten different articles, five at least besides the first."""
    articles = {a: blocks for a, blocks in pages.values()}
    template = set()
    others = [b for a, b in articles.items() if a != min(articles)]
    for block in articles[min(articles)]:
        if len(others) >= 5 and sum(block in b for b in others) >= 0.9 * len(others):
            template.add(block)
    return {k: "\n".join(b for b in blocks if b not in template) for k, (_, blocks) in pages.items()}


@pytest.mark.parametrize("copies", [1, 60])
@pytest.mark.parametrize("articles", [4, 9])
def test_boilerplate_goes_and_copies_stay(spark, copies, articles):
    """Many near copies of one article beside different ones: what all articles share is template, what copies share is text."""
    rng = random.Random(10 * copies + articles)
    pages, rows = {}, []
    for a in range(articles):
        base = [f"Title {a} {_paragraphs(rng, 1)[0]}", *_paragraphs(rng, 6)]
        for c in range(copies if a == 1 else 2 if a == 0 else 1):
            blocks = list(base)
            if c:
                blocks[1 + c % 6] = _paragraphs(rng, 1)[0]
            pages[len(pages)] = (a, [blocks[0], "Share this story", *blocks[1:], "More at our shop"])
    for k, (_, blocks) in pages.items():
        rows.append((k, "http://h.example/", "<body><div>Top</div><article><h1>{}</h1><p>{}</p>".format(*blocks) + "".join(f"<p>{p}</p>" for p in blocks[2:]) + "</article><div>End</div></body>"))
    first = {a: next(b for x, b in pages.values() if x == a) for a in range(articles)}
    want = _brute({k: (a, b) for k, (a, b) in pages.items()} | {-1 - a: (a, b) for a, b in first.items()})
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want[k] for k in pages}
    assert ("Share this story" in got[0]) == (articles == 4)


def test_trees_as_bytes():
    page = "<div class='b a'>x<p>one<br>two &amp; <i></i></p></div>" + "<b>" * 5000 + "deep"
    a = wrapper.parse(page)
    b = wrapper.load(wrapper.dump(a))
    assert [(n.tag, n.names, n.label, [p for p in n.parts if isinstance(p, str)]) for n in wrapper.numbered(a)] == [(n.tag, n.names, n.label, [p for p in n.parts if isinstance(p, str)]) for n in wrapper.numbered(b)]


def test_error_pages_are_no_full_response(spark):
    rows = [("r1", "response", "http://a.example/x", 1, {"etag": '"t"'}, "d", 200), ("r2", "response", "http://a.example/x", 2, {"etag": '"t"'}, "e", 503), ("r3", "response", "http://a.example/x", 3, {"etag": '"t"'}, "f", 206), ("v", "revisit", "http://a.example/x", 9, {"etag": '"t"'}, None, 304), ("w", "revisit", "http://b.example/", 9, {}, None, None), ("r4", "response", "http://b.example/", 2, {"etag": '"u"'}, "g", 404)]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, s long, headers map<string,string>, digest string, status int").selectExpr("*", "timestamp_seconds(s) as ts")
    got = {r.record_id: (r.refers_to, r.verdict) for r in warc.resolve_revisits(df).collect()}
    assert got == {"v": ("r1", "resolved"), "w": (None, "no response")}
    assert {r.refers_to for r in warc.resolve_revisits(df.withColumn("status", df.status * None)).where("record_id = 'v'").select("refers_to").collect()} == {"r3"}


@pytest.mark.parametrize("line,want", [
    ("SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), ("Licensed under CC BY 3.0", "CC-BY-3.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY 2.0", None),
    ("This work is licensed under the GNU General Public License, version 3 or later", "GPL-3.0"), ("licensed under the GNU General Public License, version 2", "GPL-2.0"), ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("Licensed under the Apache License, Version 2.0 (the License)", "Apache-2.0"), ("Licensed under the Apache License, Version 1.1", None), (licence._BSD + licence._BSD_END, "BSD-2-Clause"), (licence._BSD + licence._BSD_THREE + licence._BSD_END, "BSD-3-Clause"), (licence._MIT, "MIT"), (licence._ISC, "ISC"),
    ("The public library has a version 3 of the general work", None),
])
def test_versions_and_families_are_kept_apart(line, want):
    df = Counter({w: 3 for _, t in licence.TEMPLATES for w in set(licence.words(t))} | dict.fromkeys(("the", "of", "to", "and", "in", "this", "license", "licensed", "under"), 400))
    found = licence.Scanner(df, 1000).passage(line)
    assert (found and found[0]) == want
