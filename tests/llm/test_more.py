"""Operators against brute force: leaks, link graphs, repeated strings, and what rows and columns may hold."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.llm import common, decontaminate, licenses, mixing, nearcopies, quality, repeats, token_files, urls, wrappers


def words_of(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_leaks(docs, items, verify=16, equal=13):
    """Items found by laying every text over every item at every offset."""
    out = {}
    for i, t in docs:
        h = words_of(t)
        for j, u in items:
            g = words_of(u)
            n = len(g)
            if n < decontaminate.SHORTEST:
                continue
            need = n if n < 14 else min(equal, -(-n * 4 // 5))
            for off in range(-n + 1, len(h)):
                same = [0 <= off + k < len(h) and h[off + k] == g[k] for k in range(n)]
                if max(sum(same[k:k + verify]) for k in range(max(1, n - verify + 1))) >= need:
                    out.setdefault(i, set()).add(j)
                    break
    return out


def test_masks_are_sensitive():
    """Shares of the ways of changing words that leave a hit, for all lengths that the rule accepts."""
    def found(n, k):
        ways = list(itertools.combinations(range(n), k))
        return sum(any(not {s + p for p, c in enumerate(m) if c == "1"} & set(w) for m in decontaminate.MASKS for s in range(n - len(m) + 1)) for w in ways) / len(ways)
    assert found(16, 1) == found(16, 2) == 1 and found(16, 3) > 0.98 and found(14, 2) == 1 and found(15, 3) > 0.9


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_leaks(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    r = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary, n))) for i, n in enumerate([16, 16, 20, 30, 14, 9, 7, 5, 4, 1])] + [(20, None), (21, "")]
    docs = [(100, None), (101, ""), (None, items[3][1]), (102, items[0][1]), (102, "more of the same id")]
    for k in range(60):
        own = list(r.choice(vocabulary, int(r.integers(0, 60))))
        t = items[k % 10][1].split()
        for at in r.choice(len(t), min(len(t), k % 4), replace=False):
            t[at] = "changed"
        lo = int(r.integers(0, len(own) + 1))
        docs.append((k, " ".join([*own[:lo], *t, *own[lo:]])))
    docs.append((103, " ".join(r.choice(vocabulary, 30_000)) + " " + items[2][1]))
    docs.append((None, "clean words of no item"))
    want = brute_leaks([d for d in docs if d[0] not in (103, None)], [i for i in items if i[1]])
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_ids string, _id int")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, h string")
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.leaks(d, b).collect()}
    assert 2 in got[103] and 3 in got[None]
    pairs = {(i, j) for i, s in want.items() for j in s}
    mine = {(i, j) for i, s in got.items() if i not in (103, None) for j in s}
    assert mine <= pairs and len(pairs - mine) <= 0.05 * len(pairs)
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.select("doc_id").collect()} == {i for i, _ in docs} - set(got) | {None}
    got = decontaminate.flag(spark.createDataFrame([(None, items[3][1]), (None, "clean words of no item"), (None, None)], "doc_id long, text string"), b)
    assert sorted(r.contaminated for r in got.collect()) == [False, False, True]
    assert decontaminate.flag(d, b).count() == len(docs)


def brute_rank(edges, seeds, damping=0.85):
    hosts = sorted({x for e in edges for x in e[:2]} | set(seeds))
    n = len(hosts)
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[at[b], at[a]] += w
    out = m.sum(axis=0)
    s = np.array([seeds.get(h, 0.0) for h in hosts])
    s /= s.sum()
    x = s.copy()
    for _ in range(400):
        y = m @ np.divide(x, out, out=np.zeros(n), where=out > 0)
        x = damping * (y + x[out == 0].sum() * s) + (1 - damping) * s
    return dict(zip(hosts, x))


def test_ranks(spark):
    chain = [(f"c{i}", f"c{i + 1}", 1.0) for i in range(18)]
    edges = [*chain, ("c3", "x", 2.0), ("x", "y", 1.0), ("y", "x", 3.0), ("y", "end", 1.0), ("lone", "c18", 1.0)]
    for seeds in ({"c0": 1.0, "y": 2.0}, {"c0": 1.0}):
        e = spark.createDataFrame(edges, "src string, dst string, n double")
        s = spark.createDataFrame(list(seeds.items()), "host string, mass double")
        got = {r.host: r["rank"] for r in urls.spread(e, s, rest=1e-3).collect()}
        want = brute_rank(edges, seeds)
        assert set(got) <= set(want) and got["c18"] > 0
        assert max(abs(got.get(h, 0.0) - x) for h, x in want.items()) < 2e-3
    assert urls.spread(e, s.filter("mass > 5")).count() == 0


def test_verdicts_along_chains(spark):
    """A host twenty links before a blocked one, one linked by a trusted host, and pages as they come."""
    link = '<p>x</p><A class="b" HREF=//{}/p?q>y</a><a href="/local">z</a>'
    pages = [(i, f"http://n{i}.org/a", link.format(f"n{i + 1}.org")) for i in range(20)]
    pages += [(20, "http://n20.org/a", link.format("bad.com")), (21, "http://bad.com/en/1", None), (22, "http://good.net/de/1", link.format("fine.org")), (23, "http://fine.org/", link.format("bad.com"))]
    pages += [pages[21], pages[0], (None, None, None), (24, "", "<a " * 100_000)]
    d = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, verdict string")
    got = sorted((r.page_id is None, r.page_id, r.verdict) for r in urls.judge(d).collect())
    assert len(got) == len(pages)
    assert {i: v for _, i, v in got} == {**{i: "block" for i in range(22)}, 22: "allow", 23: "allow", 24: "allow", None: "allow"}


def test_later_strings(monkeypatch):
    monkeypatch.setattr(repeats, "SORTED", 7)
    r = np.random.default_rng(2)
    pieces = []
    for b in range(5):
        keys = np.unique(r.integers(0, 60, 25).astype(np.uint64) << np.uint64(57))
        ids = np.sort(r.integers(0, 9, 4))
        pieces.append((b, keys, r.integers(0, 4, len(keys)).astype(np.uint16), ids))
    first = {}
    for b, keys, code, ids in pieces:
        for k, c in zip(keys.tolist(), code):
            first[k] = min(first.get(k, (99, 99)), (int(ids[c]), b))
    for (b, keys, code, ids), late in zip(pieces, repeats.later_strings(pieces)):
        assert late.tolist() == [first[k] != (int(ids[c]), b) for k, c in zip(keys.tolist(), code)]


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p:p + 100]
            if s in seen:
                m[p:p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1]))
        out.append((i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_of_odd_texts(spark, monkeypatch):
    """Texts that repeat themselves, passages at block and text ends, long texts, copies, and rows that share an id."""
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    monkeypatch.setattr(repeats, "BUCKET", 300)
    r = np.random.default_rng(8)
    noise = lambda n: "".join(r.choice(list("abcdefgh \n"), n))
    passage = noise(100)
    turn = "01"
    while len(turn) < 1024:
        turn += turn.translate(str.maketrans("01", "10"))
    rows = [(1, "a" * 1000), (2, "a" * 99), (3, "a" * 100), (4, "ab" * 400), (5, "b" + "ab" * 60), (6, turn), (7, turn[::-1]), (8, turn.translate(str.maketrans("01", "10")))]
    rows += [(9, passage), (10, noise(200) + passage), (11, passage + noise(200)), (12, noise(57) + passage[:99]), (13, passage[1:] + "zz"), (14, noise(50) + passage + noise(3) + passage)]
    long = noise(30_000)
    rows += [(15, long), (16, long), (17, long[5000:12_000] + noise(90) + long[4000:5000]), (18, "é" * 200), (19, "xé" + "é" * 70)]
    rows += [(20, None), (21, ""), (22, " "), (None, passage), (None, passage), (1, "a" * 1000), (3, "other"), (-5, long[100:400])]
    d = spark.createDataFrame([(i, t, "c", 7, "d") for i, t in rows], "doc_id long, text string, kept string, n_bytes int, _x string").repartition(5)
    got = repeats.remove_repeats(d, keep_text=True, carry=True)
    assert set(got.columns) >= {"doc_id", "kept", "_x"}
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()), key=str) == brute_repeats(rows)


def test_near_copies_of_shared_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (1, t), (2, t + " x"), (3, "other words that are here"), (3, "other words that are here"), (None, t), (None, t), (4, None), (5, ""), (6, " ".join(f"v{i % 977}" for i in range(40_000)))]
    d = spark.createDataFrame([(i, x, "c", "k") for i, x in rows], "doc_id long, text string, class_id string, c string")
    left = nearcopies.one_of_each(d)
    assert left.columns == d.columns
    assert sorted((str(r.doc_id) for r in left.collect())) == ["1", "3", "4", "5", "6", "None", "None"]


def test_classes_write_no_more_tables_than_needed(spark, monkeypatch):
    names = []
    real = nearcopies.stored
    monkeypatch.setattr(nearcopies, "stored", lambda df, name: (names.append(name), real(df, name))[1])
    r = np.random.default_rng(8)
    chain = [int(x) for x in r.permutation(20)]
    nodes = spark.createDataFrame([(i,) for i in range(30)], "id long")
    edges = spark.createDataFrame([*zip(chain[1:], chain[:-1]), (25, 22), (25, 27)], "a long, b long")
    want = {i: 0 if i < 20 else 22 if i in (22, 25, 27) else i for i in range(30)}
    assert {x.id: x.cls for x in nearcopies.classes(nodes, edges).collect()} == want
    star = spark.createDataFrame([(i, 0) for i in range(1, 30)], "a long, b long")
    names.clear()
    assert {x.cls for x in nearcopies.classes(nodes, star).collect()} == {0} and names == ["edges", "labels", "labels"]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, cls long")
    names.clear()
    assert sorted(tuple(x) for x in nearcopies._merged(labels, spark.createDataFrame([(2, 1)], "a long, b long")).select("id", "cls").collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert names == ["joined"]
    assert sorted(tuple(x) for x in nearcopies._merged(labels, spark.createDataFrame([(2, 1), (4, 2)], "a long, b long")).select("id", "cls").collect()) == [(1, 1), (2, 1), (3, 3), (4, 1)]


def test_mixing_of_any_columns(spark):
    text = "one two three"
    rows = [(i, text, "ab"[i % 2], "t", "s", "k", 1) for i in range(40)] + [(None, f"{text} {i}", None, "t", "s", "k", 1) for i in range(9)] + [(99, " ".join(["w"] * 50_000), "c", "t", "s", "k", 1), (98, None, "a", "", "", "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, source_size string, _key string, n int")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(r._key in ("k", "") and r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert all(sum(r.taken for r in v) == int(v[0].target) for v in by.values())
    slices = {r[0] for r in d.filter("doc_id is null").select(F.md5(F.concat(F.lit("mix-1:"), "text"))).collect()}
    assert len(slices) == 9


def test_any_rows_and_columns(spark):
    """Null ids and texts, repeated rows, very long texts and clashing columns through the other operators."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, long), (2, None), (3, ""), (None, "no id"), (None, "no id"), (4, licenses.KNOWN["MIT"]), (4, licenses.KNOWN["MIT"]), (5, "x\n" * 20_000)]
    d = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, n_tokens string, digest string, score string, file string")
    enc = token_files.encoder()
    got = token_files.count_tokens(d).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((i, len(enc.encode_ordinary(t or "")))) for i, t in rows)
    got = licenses.scan_licenses(d).collect()
    assert sum(r.license_id == "MIT" for r in got) == 2 and {r.doc_id for r in got} == {1, 2, 3, 4, 5, None}
    got = quality.judge(d, spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and {r.n_words for r in got if r.doc_id == 1} == {60_000}
    pages = spark.createDataFrame([(1, "http://a.org/", "<article><p>x</p></article>", "h", "t")] * 2 + [(2, None, None, "", "")], "page_id long, url string, html string, host string, text string")
    assert sorted((r.page_id, r.text) for r in wrappers.main_text(pages).collect()) == [(1, "x"), (1, "x"), (2, "")]
    assert common.fresh(pages, "text", "_x", "html") == ["_text", "_x", "_html"]


def test_steady(spark, tmp_path):
    spark.range(10).selectExpr("id doc_id", "string(id) text").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    assert common.steady(d.filter("doc_id > 3").select("doc_id"), "x").columns == ["doc_id"]
    plain = d.filter("doc_id > 3")
    assert common.steady(plain, "x") is plain
    for moved in (d.repartition(3), d.withColumn("r", F.rand()), d.groupBy("text").count(), spark.range(3), d.join(d.select("doc_id"), "doc_id")):
        assert common.steady(moved, "x") is not moved


def test_quality_on_held_out_documents(spark):
    """Judged on documents whose labels the target didn't learn from: the good stay, junk goes. The score is
    that of a plain computation."""
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents").filter("doc_id < 4000"), common.table(spark, sf, "labels")
    seen = labels.filter("doc_id % 2 = 0")
    got = quality.judge(docs, seen).persist()
    r = got.filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id").agg(
        F.avg(F.when(F.expr("quality = 1 and toxic = 0"), F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.expr("quality = 0"), F.col("kept").cast("int"))).alias("bad")).first()
    assert r["good"] > 0.95 and r["bad"] < 0.2, r
    ratios = quality.log_ratios(docs, seen)
    some = docs.filter("doc_id < 30").select("doc_id", quality.ngram_buckets(common.words(F.col("text"))).alias("g")).collect()
    want = {r.doc_id: sum(ratios[b] for b in r.g) / len(r.g) if r.g else 0.0 for r in some}
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got.filter("doc_id < 30").collect())


def test_quality_splits_a_text_once(spark):
    """One regular-expression split a row; counts and scores of short and self-repeating texts as computed plainly."""
    from .test_operators import brute_counts
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab" if n % 2 else "abcdefgh") for _ in range(n)) for n in range(24) for _ in range(3)] + [None, " \n "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, len(texts), 3)], "doc_id long, quality int")
    got = quality.judge(d, labels)
    assert got._jdf.queryExecution().optimizedPlan().toString().count(r"[\x20\x09-\x0D]+, -1") == 1
    ratios = quality.log_ratios(d, labels)
    grams = {r.doc_id: r.g for r in d.select("doc_id", quality.ngram_buckets(common.words(F.col("text"))).alias("g")).collect()}
    for r in got.collect():
        n, g = len((texts[r.doc_id] or "").split()), grams[r.doc_id]
        assert len(g) == max(0, 2 * n - 1) and abs(r.score - (sum(ratios[b] for b in g) / len(g) if g else 0)) < 1e-9
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id]), texts[r.doc_id]
