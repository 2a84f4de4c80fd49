"""Trained operators: held-out accuracy, degenerate inputs; searches against plain versions."""

import html as entities
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stradale.llm import decontam, grade, html, language, urls
from stradale.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(0, None, "en"), (1, "", "en"), (2, "123 456 !!", None), (3, "x", "en"), (4, "the and of " * 20000, "en"), (4, "the and of " * 20000, "en"), (5, "été", "fr")]
    return spark.createDataFrame([(*r, "s", 0, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")


# --- language --------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = QUERIES["op6_language_id"](spark, BIG).toPandas()
    docs = pd.read_parquet(f"{BIG}/documents.parquet")
    x = got.merge(docs[["doc_id", "lang"]], on="doc_id")
    held = x[x.held_out]
    assert len(x) == len(docs) and (held.lang == held.lang_pred).mean() > 0.97 and x.score.between(0, 1).all()


def test_code_lengths_match_plain_escapes():
    texts = {"a": ["banana band", "bandana"], "b": ["cicada", "decade cad"]}
    m = language.Model(["a", "b"], {k: language.windows(t) for k, t in texts.items()})

    def bits(lang, t):
        """The escape recursion written out, with contexts as byte strings; unseen bytes count as text starts."""
        known = {c for ts in texts.values() for x in ts for c in x.encode()}
        tables = {}
        for x in texts[lang]:
            raw = b"\0\0\0" + x.encode()
            for i in range(3, len(raw)):
                for n in range(4):
                    tables.setdefault(raw[i - n : i], {}).setdefault(raw[i], 0)
                    tables[raw[i - n : i]][raw[i]] += 1

        def p(ctx, c):
            low = p(ctx[1:], c) if ctx else 1 / 256
            f = tables.get(ctx)
            if not f:
                return low
            n, u = sum(f.values()), len(f)
            return f.get(c, 0) / (n + u) + u / (n + u) * low

        raw = bytes(c if c in known else 0 for c in b"\0\0\0" + t.encode())
        return -sum(math.log2(p(raw[i - 3 : i], raw[i])) for i in range(3, len(raw)))

    for t in ("band", "cade", "xyz band", "b"):
        got = m.lengths([t.encode(), b"decade"])
        assert got[0] == pytest.approx([bits("a", t), bits("b", t)], rel=1e-5)
        assert got[1] == pytest.approx([bits("a", "decade"), bits("b", "decade")], rel=1e-5)


def test_lengths_do_not_depend_on_batches(monkeypatch):
    m = language.Model(["a"], {"a": language.windows(["the quick brown fox", "jumps"])})
    texts = [b"the fox", b"", b"quick " * 50, b"x"]
    whole = m.lengths(texts)
    monkeypatch.setattr(language, "STEP", 7)
    assert np.allclose(m.lengths(texts), whole) and np.allclose(np.vstack([m.lengths([t]) for t in texts]), whole)


def test_language_odd_rows(spark, odd):
    model = language.fit(odd)
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0
    assert [k == "und" for k, _, _ in model.predict(["½ ² ", "12 ½", "Ⅷ", "½ a", "ª"])] == [True, True, True, False, False]
    assert len(language.identify(odd, model).collect()) == 7
    none = language.fit(odd.where("false"))
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}


# --- grades ----------------------------------------------------------------------------------------


def test_grades_separate_the_sample(spark):
    got = QUERIES["op1_quality_grade"](spark, BIG).toPandas()
    labels = pd.read_parquet(f"{BIG}/labels.parquet")
    x = got.merge(labels, on="doc_id")
    assert x[(x.quality == 1) & (x.toxic == 0)].kept.mean() > 0.97
    assert x[x.quality == 0].kept.mean() < 0.2  # some 400 ratings only
    assert x.expected_grade.between(0, 2).all() and (x.p_above_low >= x.p_top).all()


def test_grades_held_out():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, y = [], []
    for i in range(900):
        g = i % 3
        t = [rng.choice(words) for _ in range(60)] + [["bad", "awful"], ["so", "meh"], ["fine", "great"]][g]
        rows.append(" ".join(t))
        y.append(g)
    m = grade.train([grade.feature_places(t) for t in rows[:600]], y[:600])
    assert m.theta[0] < m.theta[1]
    got = [round(r[0]) for r in m.grades(rows[600:])]
    assert np.mean(np.array(got) == np.array(y[600:])) > 0.9


def test_grades_held_out_of_the_table(spark):
    """Fitted on half of the rated documents, the other half is graded."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    m = grade.fit(docs, grade.graded(labels.where(half == 0)))
    rest = labels.where(half == 1).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    x = grade.rate(docs.join(rest, "doc_id", "left_semi"), m).toPandas().merge(rest.toPandas(), on="doc_id")
    assert len(x) > 1000
    good = (x.quality == 1) & (x.toxic == 0)
    assert x[good].kept.mean() > 0.97 and x[x.quality == 0].kept.mean() < 0.15
    assert x[good].expected_grade.mean() > x[(x.quality == 1) & (x.toxic == 1)].expected_grade.mean() > x[x.quality == 0].expected_grade.mean()


def test_grades_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (99, 1, 1), (4, None, 0), (4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["grade"] for r in grade.graded(labels).collect()] == [2, 0, 1, None, None, 2]
    m = grade.fit(odd, grade.graded(labels))
    assert grade.rate(odd, m).count() == 7
    none = grade.rate(odd, grade.fit(odd, grade.graded(labels.where("false")))).collect()
    assert all(r["kept"] and r["p_top"] == pytest.approx(1 / 3) and r["p_above_low"] == pytest.approx(2 / 3) for r in none)
    wide = grade.train([[1], [2]] * 20, [-3, 9] * 20)
    assert wide.theta[0] < wide.theta[1]


# --- pages -------------------------------------------------------------------------------------------


def test_main_text_parts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header>
    <nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p>First  <b>bold</b>
    text<br>more.<p>Second &lt;one&gt;</p><form><input><p>mail us</p></form><aside>side</aside><ul><li>Item</li></ul>
    <section class="comments"><p>I disagree</p></section><script>var a="</p>";</script></article><footer>&copy; x</footer></body></html>"""
    assert html.main_text(page) == "Head & line\n\nFirst bold text more.\n\nSecond <one>\n\nItem"


def test_main_text_without_article():
    long = ["This is a paragraph of the main text, long enough to count as such. " * 2] * 4
    page = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>" + "".join(f"<p>{t}</p>" for t in long) + "</div><div><a href=3>More</a></div><div class='footer'>c</div>"
    assert html.main_text(page) == "\n\n".join(" ".join(t.split()) for t in long)


def test_main_text_degenerate():
    assert [html.main_text(x) for x in (None, "", "<p></p>", "<!-- a", "<nav>x", "plain")] == ["", "", "", "", "", "plain"]
    assert html.main_text("<article><p>cut <b>off") == "cut off"


def test_main_text_of_the_sample(spark):
    """Exactly the heading and the document's lines, on every page, with and without the article's element."""
    got = QUERIES["op2_main_text"](spark, BIG).toPandas()
    pages = pd.read_parquet(f"{BIG}/pages.parquet").set_index("page_id")
    docs = pd.read_parquet(f"{BIG}/documents.parquet").set_index("doc_id").text
    flat = lambda t: " ".join(t.split())
    assert (got.n_chars == got.text.str.len()).all() and len(got) == len(pages)
    for i, u, t in zip(got.page_id, got.url, got.text):
        page = pages.html[i]
        head = entities.unescape(re.search("<h1>(.*?)</h1>", page, re.S)[1])
        doc = docs[int(re.search(r"/(\d+)", u.split("://")[1])[1])]
        assert t == "\n\n".join(flat(x) for x in [head, *doc.split("\n")] if x.strip())
        assert html.main_text(re.sub(r"(</?)article\b", r"\1div", page)) == t


def plain_surges(size):
    """The lines between two dives (windows of nothing) around a window that reaches the threshold."""
    n = len(size)
    sums = {i: sum(size[j] for j in range(n) if abs(i - j) <= html.WINDOW // 2) for i in range(n)}
    full = [x for x in sums.values() if x]
    limit = min(html.SURGE, max(html.QUIET, 0.4 * sum(full) / len(full))) if full else 0
    joined = lambda i, j: all(sums[k] for k in range(min(i, j), max(i, j) + 1))
    peaks = [i for i in sums if sums[i] >= limit]
    if not any(sums[i] for i in peaks):
        return [i for i in range(n) if size[i]]
    return [i for i in range(n) if size[i] and any(joined(i, j) for j in peaks)]


def test_surges_against_a_plain_version():
    rng = random.Random(3)
    for _ in range(400):
        size = [rng.choice([0, 0, 0, 1, 9, 30, 60, 200]) for _ in range(rng.randrange(25))]
        assert html.surges(size) == plain_surges(size)
    long = "Words of the main text that go on and on in one block. " * 3
    page = f"<div>Share this</div><nav>a</nav><nav>b</nav><nav>c</nav><h2>Head</h2><p>{long}</p><p>Yes.</p><nav>x</nav><nav>y</nav><nav>z</nav><p>short</p>"
    assert html.main_text(page) == f"Head\n\n{long.strip()}\n\nYes."


def test_main_text_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "x"), (1, "u", "<p>a b</p>", "y"), (2, None, None, None), (3, "v", "", None)], "page_id long, url string, html string, text string").withColumn("n_chars", F.lit(-1))
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract(df).collect()]
    assert got == [(1, "u", "a b", 3), (1, "u", "a b", 3), (2, None, "", 0), (3, "v", "", 0)]
    assert html.extract(df.where("false")).count() == 0


# --- urls ---------------------------------------------------------------------------------------------


def test_rules_and_parts():
    r = lambda u: urls.rule_of(*urls.split_url(u))
    assert urls.split_url("HTTP://A.Com:80/X?y#z") == ("a.com:80", "/X") and urls.split_url(None) == ("", "") and urls.split_url("a.com/x") == ("", "")
    assert r("http://x.example.com/en/1") == ("example.com/en/", "block") and r("http://www.example.com/en/1") == ("www.example.com/en/", "allow")
    assert r("http://a.b.www.example.com/en/") == ("www.example.com/en/", "allow") and r("http://notexample.com/en/") == ("com/", "allow")
    assert r("http://x.net/es/1") == ("net/es/", "block") and r("http://x.net/de/") is None and r("http://com/") == ("com/", "allow") and r("http://x.com") is None


def test_labels_of_the_rules():
    label = lambda u: urls.label_of(*urls.split_url(u))
    assert label("http://a.com/x") is False and label("http://x.example.com/en/1") is True and label("http://www.example.com/en/1") is False
    assert label("http://a.net/es/1") is True and label("http://a.net/de/1") is False and label("http://a.org/es/") is None and label(None) is None


@pytest.fixture(scope="module")
def labelled(spark):
    rows = urls.ruled(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).toPandas().sort_values("url")
    return rows.url.tolist(), rows.bad.to_numpy(bool)


def test_trees_on_unseen_hosts(labelled):
    u, bad = labelled
    hosts = [urls.split_url(x)[0] for x in u]
    out = np.isin(hosts, sorted(set(hosts))[::3])
    m = urls.train([x for x, o in zip(u, out) if not o], bad[~out].tolist())
    assert out.sum() > 300 and ((m.scores([x for x, o in zip(u, out) if o]) >= 0.5) == bad[out]).mean() > 0.95


def test_url_query_against_plain_trees(spark, labelled):
    """The registered query on all pages: rules by trying each, scores by walking each tree by hand."""
    sf = "/root/testdata/sf0.1"
    u, bad = labelled
    m = urls.train(u, bad.tolist())  # all of them, fewer than the sample's bound
    pages = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id")
    got = QUERIES["op4_url_filter"](spark, sf).toPandas()
    assert len(got) == len(pages) and got.page_id.is_unique

    def walk(t, x):
        f, cut, left, right, v = t
        at = 0
        while f[at] >= 0:
            value = sum(c < x[f[at]] for c in m.cuts[f[at]])  # its bin
            at = left[at] if value <= cut[at] else right[at]
        return v[at]

    for r in got.iloc[::5].itertuples():
        url = pages.url[r.page_id]
        host, _, rest = url.split("://", 1)[1].partition("/")
        path = ("/" + rest).split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host.lower(), path)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        z = m.start + sum(walk(t, m.features(url)) for t in m.trees)
        assert r.p_block == pytest.approx(1 / (1 + math.exp(-z)))
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "block" if r.p_block >= urls.BLOCK_AT else "allow"))


def test_urls_odd_rows(spark, labelled):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "x"), (3, "http://a.org/" + "q" * 5000), (3, "http://a.org/")], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("r"))
    got = urls.judge(df, urls.train(labelled[0][:200], labelled[1][:200].tolist())).collect()
    assert len(got) == 5 and all(r["verdict"] in ("allow", "block") for r in got) and got[0]["host"] == got[0]["path"] == ""
    m = urls.fit(df.withColumn("bad", F.lit(True)), "bad")
    assert {r["verdict"] for r in urls.judge(df, m).collect()} == {"block"}
    none = urls.fit(urls.ruled(df.where("false")), "bad")
    assert urls.judge(df.where("false"), none).count() == 0 and {r["verdict"] for r in urls.judge(df, none).collect()} == {"allow"}


# --- decontamination ------------------------------------------------------------------------------------


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max() / (2 * len(a))


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 25))
        assert decontam.align(a, b) == pytest.approx(plain_align(a, b))


def test_edited_copies_are_found_and_quotes_are_not():
    rng = random.Random(4)
    w = lambda n: [f"t{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, w(40)) for i in range(50)] + [(50, w(3)), (51, [])]
    index = decontam.Index([(k, " ".join(x)) for k, x in items] + [(52, None)])
    for k, x in items[:50]:
        edited = list(x)
        for p in rng.sample(range(40), 6):
            edited[p] = "other"
        del edited[20]
        n, best, score = index.verdict(" ".join(w(100) + edited + w(100)).upper())
        assert n == 1 and best == k and score > 0.6
        assert index.verdict(" ".join(w(50) + x[:7] + w(50)))[0] == 0
    assert index.verdict("And, " + ", ".join(items[50][1]) + "!")[1] == 50
    assert index.verdict(None) == index.verdict("") == (0, None, 0.0)


def test_evenly_edited_copies_are_found():
    rng = random.Random(7)
    w = lambda n: [f"t{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, w(14 + i % 30)) for i in range(40)]
    index = decontam.Index([(k, " ".join(x)) for k, x in items])
    for k, x in items:
        for every in (5, 4, 3):  # no run of five words is left
            copy = ["other" if p % every == every - 1 else y for p, y in enumerate(x)]
            n, best, score = index.verdict(" ".join(w(80) + copy + w(80)))
            whole = plain_align(x, copy)
            assert (n, best, score) == (1, k, pytest.approx(whole)) if whole >= 0.5 else n == 0
        fuller = [z for p, y in enumerate(x) for z in ((y, "and") if p % 2 else (y,))]  # two words, then a new one
        assert index.verdict(" ".join(w(80) + fuller + w(80)))[:2] == (1, k)


def test_no_alignment_over_the_threshold_is_missed():
    rng = np.random.default_rng(2)
    for _ in range(60):
        word = lambda n: [f"t{x}" for x in rng.integers(0, 25, n)]
        items = [(k, word(rng.integers(1, 15))) for k in range(8)]
        text = word(60)
        want = {k for k, x in items if plain_align(x, text) >= 0.5}
        got = {k for k, s in decontam.Index([(k, " ".join(x)) for k, x in items]).matches(" ".join(text)) if s >= 0.5}
        assert got == want


def test_recall_of_edited_copies():
    """At 10, 20 and 30 % of the words replaced, left out or added, against alignment of all pairs."""
    rng = random.Random(11)
    bench = pd.read_parquet(f"{BIG}/benchmark.parquet")
    items = list(zip(bench.item_id.tolist(), bench.text.tolist()))
    index = decontam.Index(items)
    docs = [decontam.words_of(t) for t in pd.read_parquet(f"{BIG}/documents.parquet").text[:60]]
    words = {k: decontam.words_of(t) for k, t in items}
    for share in (0.1, 0.2, 0.3):
        found = want = 0
        for n, (k, w) in enumerate(words.items()):
            copy = []
            for x in w:
                what = rng.random()
                copy += [x] if what > share else rng.choice([["other"], [], [x, "more"]])
            text = docs[n][:40] + copy + docs[n][40:80]
            all_pairs = {i for i, x in words.items() if plain_align(x, text) >= 0.5}
            got = {i for i, s in index.matches(" ".join(text)) if s >= 0.5}
            assert got == all_pairs
            want += 1
            found += k in got
        assert found >= 0.9 * want


def test_decontamination_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (1, "a b c d e f g", 2), (None, "x y z q r s", 3), (4, None, 4), (5, "", 5)], "doc_id long, text string, n_items int").withColumn("best_item", F.lit("?")).withColumn("_text", F.lit(0))
    items = spark.createDataFrame([(None, "a b c d e f g"), ("k", "a b c d e f g"), ("j", None), (None, "x y z q r s"), ("l", "")], "item_id string, text string").withColumn("doc_id", F.lit(9))
    got = sorted(tuple(r) for r in decontam.decontaminate(docs, items).fillna(-1, ["doc_id"]).collect())
    assert got == [(-1, 1, None, 1.0, True), (1, 2, "k", 1.0, True), (1, 2, "k", 1.0, True), (4, 0, None, 0.0, False), (5, 0, None, 0.0, False)]
    assert decontam.clean(docs, items).columns == docs.columns and decontam.clean(docs, items).count() == 2
    assert decontam.decontaminate(docs, items.where("false")).where("contaminated").count() == 0
    assert decontam.decontaminate(docs.where("false"), items).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.union(docs.where("doc_id < 50"))  # repeated rows stay
    order = ["doc_id", "n_items", "best_score"]
    one = decontam.decontaminate(docs, bench).toPandas().sort_values(order).reset_index(drop=True)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 4000)
    assert len(list(decontam.blocks(bench, "item_id", "text"))) > 1
    many = decontam.decontaminate(docs, bench).toPandas().sort_values(order).reset_index(drop=True)
    assert one.contaminated.sum() > 5 and one.equals(many)
    assert decontam.clean(docs, bench).count() == (~one.contaminated).sum()
    texts = docs.toPandas().drop_duplicates("doc_id").set_index("doc_id").text
    flat = lambda t: " " + " ".join(x for x in (decontam.NOT_WORD.sub("", y) for y in t.lower().split()) if x) + " "
    items = [flat(t) for t in bench.toPandas().text]
    holds = {i for i, t in texts.items() if any(b in flat(t) for b in items)}
    assert holds <= set(one[one.contaminated].doc_id)
    monkeypatch.undo()
    # the registered query: every passage's verdict by all items one by one
    got = QUERIES["op3_decontamination"](spark, BIG).toPandas().set_index("doc_id")
    alone = [decontam.Index([(k, t)]) for k, t in zip(bench.toPandas().item_id, bench.toPandas().text)]
    for i in list(texts.index)[::25] + list(got.index[got.contaminated])[:20]:
        n = sum(x.verdict(texts[i])[0] for x in alone)
        assert got.n_items[i] == n
