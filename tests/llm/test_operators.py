"""Operators against brute force on small tables with nulls, empty, long and repeated rows."""

import hashlib
import json
import re

import numpy as np
import pytest

from seamark.llm import decontaminate, langid, licenses, mixing, nearcopies, quality, repeats, token_files, urls, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string"
WORDS = [f"w{i}" for i in range(400)]


def rows(seed=1, n=60):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = " ".join(r.choice(WORDS, int(r.integers(1, 120))))
        out.append((i, t, "en", f"s{i % 3}"))
    base = " ".join(r.choice(WORDS, 200))
    out += [(n + k, base, "en", "hot") for k in range(5)]
    out += [(n + 5 + k, base.replace(base.split()[10 * k], "zz", 1) + " tail", "en", "hot") for k in range(5)]
    out += [(n + 10, None, None, None), (n + 11, "", "en", "s1"), (n + 12, " \n\t ", "en", "s1"), (n + 13, "one two", "de", None), (n + 14, "x" * 300, "en", "s0"), (n + 15, "é" * 120, "fr", "s0")]
    out += [out[0], (None, "no id here at all", "en", "s1")]
    return [(*x, len(x[1] or ""), "clash", "clash") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_repeats(docs, none, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 4000)
    monkeypatch.setattr(repeats, "BUCKET", 500)
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    seen, want = set(), []
    for i, t, *_ in sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p:p + 100]
            if s in seen:
                m[p:p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1]))
        want.append((i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert repeats.remove_repeats(none).count() == 0


def test_difference_cover():
    d = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert d == set(range(repeats.PERIOD))


@pytest.mark.parametrize("rows_a_block", [1000, 2])
def test_near_copies(docs, none, monkeypatch, rows_a_block):
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", rows_a_block)
    got = {(r.doc_id, r.class_id) for r in nearcopies.near_classes(docs).collect()}
    data = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    k, s = nearcopies.elements([t for _, t in data])
    sets = [set(k[a:b].tolist()) for a, b in zip(s[:-1], s[1:])]
    cls = {i: i for i, _ in data}
    for _ in range(len(data)):
        changed = False
        for i in range(len(data)):
            for j in range(i):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    m = min(cls[data[i][0]], cls[data[j][0]])
                    changed |= (cls[data[i][0]], cls[data[j][0]]) != (m, m)
                    cls[data[i][0]] = cls[data[j][0]] = m
        if not changed:
            break
    assert got == set(cls.items()) | {(None, None)}
    assert nearcopies.near_classes(none).count() == 0
    left = nearcopies.one_of_each(docs)
    assert left.columns == docs.columns and left.filter("source = 'hot'").count() == 1


def test_dart_signatures_estimate():
    r = np.random.default_rng(5)
    a = r.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:450], r.integers(0, 2**63, 50).astype(np.uint64)])
    sig = nearcopies.signatures(np.concatenate([a, b]), np.array([0, 500, 1000]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 450 / 550) < 0.04 and np.isfinite(sig).all()


def test_decontaminate(spark, docs, none):
    item = " ".join(f"q{i}" for i in range(30))
    swapped = item.split()
    swapped[7] = swapped[15] = "other"
    texts = ["before " + item + " after", " ".join(swapped), "q1 q2 q3 q4 q5", None, "", item.upper().replace(" ", ", ")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate.flag(d, b).collect()}
    assert got == {0: (True, [1]), 1: (True, [1]), 2: (False, []), 3: (False, []), 4: (False, []), 5: (True, [1]), None: (True, [1])}
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {2, 3, 4}
    assert decontaminate.clean(docs, b).count() == docs.count() and decontaminate.flag(none, b).count() == 0
    assert not decontaminate.flag(d, b.limit(0)).filter("contaminated").count()


def brute_counts(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines, dup, seen = (t or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = {}
    for i in range(len(ws) - 4):
        grams.setdefault(tuple(ws[i:i + 5]), []).append(i)
    hit = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_quality(spark, docs, none):
    more = [(900, "a b c d e f a b c d e f a b", 1), (901, "l1 x\nl1 x\n\n\nl1 x\n## $a", 0), (902, "a a a a a a a", 0), (903, "é ü x \x1c y", 1)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t, _ in more], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(900, 0, 0), (12345, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(d, labels).collect()
    texts = sorted(((r.doc_id, r.text) for r in d.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for (i, t), g in zip(texts, got):
        c = brute_counts(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == c, (i, t)
        assert g.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0]) and (not g.kept or not g.base_failed)
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == docs.count()


def test_mixing(docs, none):
    got = mixing.mix(docs).select("doc_id", "size", "source", "source_size", "target", "taken").collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size
    for v in by.values():
        assert sum(r.taken for r in v) == int(v[0].target) and v[0].target <= 3 * v[0].source_size + 1e-9
    assert abs(sum(v[0].target for v in by.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).select("doc_id", "size", "source", "source_size", "target", "taken").collect()))


def test_water_filling(spark):
    s = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.source_targets(s).collect()}
    assert t["a"] == 30 and t["b"] == 300 and t["c"] == pytest.approx(780) and t[None] == 0


def greedy(text, train):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in train:
            k += 1
        n, i = n + 1, i + k
    return n


def test_language_letters_and_long_texts():
    r = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 10_000)] + list("abcdefgh")
    train = {"han": " ".join("".join(letters[i:i + 5]) for i in range(0, 10_000, 5)), "lat": " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(800))}
    m = langid.Model(train)
    assert m.alphabet > 10_000
    long = " ".join("".join(r.choice(letters[:40] + list("abcdefgh"), int(r.integers(1, 9)))) for _ in range(20_000))
    texts = [long[:100_000], long[:4096], long[:4097], "".join(letters[500:9500]), "abc" * 3000, "Ω≈ç abcd"]
    got = m.phrases([m.codes(t) for t in texts])
    clean = [re.sub(r"[\W\d_]+", " ", t.lower()) for t in texts]
    assert got.tolist() == [[greedy(t, train["han"]), greedy(t, train["lat"])] for t in clean]
    lang, score = m.predict(["² ½ ³", "ⅷ", "١٢٣", None, "", letters[7], "ª"])
    assert lang == ["und"] * 5 + ["han", "han"] and all(0 <= x <= 1 for x in score)


def test_languages(spark, none):
    m = langid.Model({"aa": "abab abba baab abab", "zz": "zyzy xyzx zzyx yxzy"})
    lang, score = m.predict(["abba", "zyx", None, "", "123 !", "ABBA " * 3000])
    assert lang == ["aa", "zz", "und", "und", "und", "aa"] and all(0 <= s <= 1 for s in score)

    for t in ("abba baab", "zyx ab", "qq abq", "xyzx zyzy"):
        assert m.phrases([m.codes(t)])[0].tolist() == [greedy(t, "abab abba baab abab"), greedy(t, "zyzy xyzx zzyx yxzy")]
    assert langid.identify(none).count() == 0
    d = spark.createDataFrame([(i, t, x, "clash") for i, (t, x) in enumerate([("abab", "aa"), ("zyzy", "zz"), (None, "aa"), ("baab", None)] * 5)], "doc_id long, text string, lang string, score string")
    assert {(r.text, r.lang_pred) for r in langid.identify(d).collect()} == {("abab", "aa"), ("zyzy", "zz"), (None, "und"), ("baab", "aa")}


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_token_files(spark, docs, none, tmp_path, block):
    enc = token_files.encoder()
    want = sorted(len(enc.encode_ordinary(r.text or "")) for r in docs.collect())
    if block >= 7:
        assert sorted(r.n_tokens for r in token_files.count_tokens(docs, block_tokens=block).collect()) == want
        assert token_files.count_tokens(none).count() == 0
    ids = np.array([5, 9, 9, 1, 2, 3, 4, 9, 7], "<u2")
    (tmp_path / "f.bin").write_bytes(ids.tobytes())
    (tmp_path / "g.bin").write_bytes(b"")
    got = sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in token_files.scan_token_files(spark, f"file://{tmp_path}", end=9, block_tokens=block).collect())
    assert got == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 4, True), (3, 8, 1, False)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>
<!-- x --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>First  {0}<br><p>Second\n para</p><div class="comments"><p>Nice</p></div></article><aside>Side</aside><form>Name</form><footer>Foot</footer></body></html>"""


def test_wrappers(spark):
    pages = [(i, f"http://h.org/{i}", PAGE.format(i), "clash") for i in range(4)] + [(10, "http://h.org/x", None, ""), (11, None, "", ""), (12, "nonsense", "<p>Only &eacute; text", "")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.main_text(d).collect()}
    assert got[2] == ("Head & more First 2 Second para", 31) and got[10] == got[11] == ("", 0) and got[12] == ("Only é text", 11)
    assert wrappers.main_text(d.limit(0)).count() == 0


def one(*pages):
    """Texts of pages of one host, without what recurs, and its wrapper."""
    w = wrappers.Wrapper()
    for p in pages:
        w.add(wrappers.Page(p))
    w = wrappers.Wrapper.load(w.dump())
    return [" ".join(wrappers.main_blocks(wrappers.Page(p), w)) for p in pages], w.regex


def test_alignment():
    slot = ["#", []]
    li = ["+", [["li", [slot]]]]
    _, w = one("<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>a</li></ul><h2>t</h2><p>y</p>")
    assert w == [["ul", [li]], ["?", [["h2", [slot]]]], ["p", [slot]]]
    _, w = one("<div class=top-1>a</div><div class=x><h2>t</h2><p>a</p><p>b</p><h2>u</h2><p>c</p><p>d</p></div>", "<div class=x><p>e</p></div>")
    group = ["+", [["h2", [slot]], ["+", [["p", [slot]]]]]]
    assert w == [["?", [["div.top-", [slot]]]], ["div.x", [["?", [group]], ["?", [["p", [slot]]]]]]]
    many = "".join(f"<h{i % 5 + 1}>t</h{i % 5 + 1}><section class=c{chr(97 + i % 26)}>{'<p>x' * (i % 3)}y</section>" for i in range(200))
    _, w = one(many, "<h1>z</h1>")
    assert w[0][0] == "*" and {x[0] for x in w[0][1]} == {f"h{i}" for i in range(1, 6)} | {f"section.c{chr(97 + i)}" for i in range(26)}
    assert wrappers.match(w, wrappers.Page("<h1>z</h1><h3>q</h3>").folded) == [0, 2]
    page = wrappers.Page("<ul><li>a</li><li>b</li></ul><p>x</p>").folded
    w = json.loads(json.dumps([["ul", [li]], ["?", [["h2", [slot]]]], ["p", [slot]]]))
    assert wrappers.match(w, page) == [0, 2]


@pytest.mark.parametrize("page,text", [
    ("<body class='has-sidebar'><p>Text</p></body>", "Text"),
    ("<article data-id='share-9'><p>Text</p></article>", "Text"),
    ("<article id=share-9><p>Text</p></article>", "Text"),
    ("<article><p>One <span class='ad'>Buy <span>now</span></span> two</p><p>Three</p></article>", "One two Three"),
    ("<article><p data-x=\"unbalanced>Text</p><p class=\"z\">More</p></article>", "Text More"),
    ("<article><p>Text</p><div class='user-feedback'><p>Nice</p></div><div id=remarks>Bad</div><section class='comment-list'>No</section></article>", "Text"),
    ("<div class=bar><a href=/>Home</a></div><p>Text</p><p>Copyright 0</p><div>&copy; me</div>", "Text"),
    ("<article><h2>Ad astra</h2><p class='article-header'>Kept</p><p class=lead>a &lt; b <b>c</b>d</p></article>", "Ad astra Kept a < b cd"),
    ("<main><article><p>A</p><article class=comment>Nice</article></article></main>", "A"),
    ("<p title='a>b'>Text</p><!-- <p>no --><p>5 < 6", "Text 5 < 6"),
    ("<article><p>x</article></div></p><script>if (a<b) '</p>'", "x"),
    ("", ""), (None, ""), ("   ", ""), ("<article></article>", ""),
])
def test_pages(page, text):
    assert one(page)[0] == [text]


def test_pages_of_any_length():
    import time

    for page in ("<b " * 350_000, "<b \"" * 250_000, "<p data-x=\"a>T</p>" * 50_000, "<div>" * 200_000 + "x", "</x>" * 250_000, "<svg " * 200_000, "<a href='" * 110_000):
        start = time.process_time()
        wrappers.Page(page)
        assert time.process_time() - start < 5, page[:20]
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(20_000)) + "</article>"
    assert one(long)[0][0] == " ".join(f"word {i}" for i in range(20_000))


def test_wrappers_whole_pages(spark):
    art = "<html><body><article><p>Article {0}</p></article></body></html>"
    div = "<html><body class='single no-sidebar'><div><p>Plain {0}</p></div></body></html>"
    marked = "<html><body><main class=has-comments><article id=related-1><p>Marked {0}</p><article class=comment><p>Nice</p></article></article></main></body></html>"
    pages = [(i, "http://two.org/", (art, div, marked)[i % 3].format(i)) for i in range(9)]
    pages += [(9, None, art.format(9)), *((i, None, "<p>The same") for i in (10, 11, 12)), (13, "nonsense", "<p>Other")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{('Article', 'Plain', 'Marked')[i % 3]} {i}" for i in range(9)} | {9: "Article 9", 10: "The same", 11: "The same", 12: "The same", 13: "Other"}


def test_wrappers_template_texts(spark):
    note = "We tell you what this site is for. " * 6
    page = "<html><body><div><p>Welcome</p><p>" + note + "</p><p>Body {0}</p><p>More {0}</p></div></body></html>"
    pages = [(i, "http://plain.org/", page.format(i)) for i in range(6)] + [(6 + i, "http://copies.org/", page.format(0)) for i in range(4)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Body {i} More {i}" for i in range(6)} | {i: f"Welcome {note.strip()} Body 0 More 0" for i in range(6, 10)}


def test_urls(spark):
    u = ["http://A.Example.COM/en/1?x", "https://example.com/en/7", "http://m.example.net/de/1", "http://example.net/de/8#t", "http://x.org/fr/1", None, "no scheme", "http://x.org", "http://notcom/en/"]
    d = spark.createDataFrame([(i, x, None) for i, x in enumerate(u)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(d).collect()}
    assert got == {0: ("a.example.com", "/en/1", "com/en/", "block"), 1: ("example.com", "/en/7", "example.com/en/7", "allow"), 2: ("m.example.net", "/de/1", "net/de/", "allow"),
                   3: ("example.net", "/de/8", "example.net/de/8", "block"), 4: ("x.org", "/fr/1", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("x.org", "", None, "allow"),
                   8: ("notcom", "/en/", None, "allow")}
    links = spark.createDataFrame([(1, "http://bad.com/en/1", None), (2, "http://near.org/a", '<a href="http://bad.com/x">x</a><a href=//bad.com/y>'), (3, "http://good.net/de/1", '<a href="http://fine.org/">'), (4, "http://fine.org/b", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(links).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert urls.judge(d.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    mit = licenses.KNOWN["MIT"].replace("<year> <holder>", "2020 Someone").upper().replace(",", " ;")
    d = spark.createDataFrame([(1, mit), (2, "Text.\nReleased under the MIT Licence.\nMore"), (3, None), (4, "Licensed under the Apache License, Version 2.0."), (4, "other")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license_id or "", r.notices or "") for r in licenses.scan_licenses(d).collect())
    assert got == [(1, "MIT", ""), (2, "", "notice:MIT"), (3, "", ""), (4, "", "notice:Apache-2.0"), (4, "notice:Apache-2.0", "notice:Apache-2.0")]
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0


def test_license_notice_after_all_rights_reserved(spark):
    import duckdb

    texts = ["All rights reserved. Released under the MIT License.", "x\n\tALL RIGHTS RESERVED Released under the MIT Licence\ny", "All rights reserved.", "all of it", None]
    got = sorted((r.doc_id, r.license_id, r.notices) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(0, "notice:MIT", "notice:MIT"), (1, None, "notice:MIT"), (2, None, None), (3, None, None), (4, None, None)]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert got == sorted((i, x, n) for i, _, x, n in c.execute(licenses.sql()).fetchall())


