import hashlib
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from barloom.llm import fingerprints as fp
from barloom.llm.decontaminate import align, contamination, op7_decontamination
from barloom.llm.html_text import extract, main_text, op6_html_extraction
from barloom.llm.toxicity import fit, op9_toxicity, score_documents


def test_fingerprints_against_a_plain_loop(spark, sf):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in fp.op5_multiset_fingerprint(spark, sf).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = fp.edited(t, following)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.fingerprint(t), fp.fingerprint(changed))
        assert 0 <= r["near_next"] <= 1 and (r["near_next"] == 1.0) == (r["fingerprint"] == fp.fingerprint(following))


def test_fingerprints_add_up():
    a, b = "one line\nsecond line of words", "third paragraph here"
    whole = fp.fingerprint(a + "\n" + b)
    assert fp.combined(fp.fingerprint(a), fp.fingerprint(b)) == whole == fp.fingerprint(b + "\n" + a)
    assert fp.combined(whole, fp.fingerprint(b), -1) == fp.fingerprint(a)
    assert fp.fingerprint("x\nx") != fp.fingerprint("x") and fp.fingerprint(None) == fp.fingerprint("")


def test_fingerprints_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "n"), (2, None), (2, "b"), (2, "b"), (1, "é😀" * 5000)], "doc_id long, text string").selectExpr("*", "1 as k", "'x' as bucket", "0 as tail")
    got = fp.fingerprint_edits(docs).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 1, 1, 1, 10_000]
    assert fp.fingerprint_edits(docs.limit(0)).count() == 0
    assert fp.fingerprint_edits(docs.filter("doc_id = 1")).first()["near_next"] == 1.0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies and more cookies here.</div>
<article><h1>Big &amp; bold</h1><p>First   paragraph with <b>several</b> words,&nbsp;and a <a href=x>link</a> in it.</p><p>Second one &#233; &lt;tag&gt;.<br>After break.</p><script>var a = "<p>no</p>";</script><div class="ad">Buy now</div></article>
<aside>Related things</aside><section class="comments"><p>A reader says a lot of words here, many of them indeed.</p></section><form><input><button>Go</button></form><footer>Copyright words</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == "Big & bold\nFirst paragraph with several words, and a link in it.\nSecond one é <tag>. After break."


@pytest.mark.parametrize("wrap", ['<div class="content-sidebar-wrap">', '<div class="with-sidebar">', '<section id="page-with-header">', "<form>"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_a_wrapper_with_a_doubtful_name_keeps_its_article(wrap, tag):
    text = "Words of the article that go on for quite some time, with more words after them."
    article = f"<{tag}>" + f"<p>{text}</p>" * 5 + f"</{tag}>"
    boxes = '<div class="sidebar"><p>A box beside it.</p></div><div class="related"><article><p>Another story.</p></article></div>'
    page = f"<html><body><p>Top</p>{wrap}{boxes}{article}</{wrap[1:].split()[0].rstrip('>')}></body></html>"
    got = main_text(page)
    assert got.count(text) == 5 and "beside" not in got
    assert tag == "div" or "Another" not in got


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></div>", "<div>" * 3000, "plain words only", "<!-- open", "<p>a<p>b<li>c", "<script>x", "<a href='\"'>q</a>", "\x00�<p>x</p>"])
def test_broken_pages_dont_fail(page):
    assert isinstance(main_text(page), str)


class Plain(HTMLParser):
    """The article of pages that mark it, by the standard library's parser: what stands in it, without boxes of class ad."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.off, self.blocks = 0, 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if self.off or tag in ("script", "style") or ("class", "ad") in attrs and tag == "div":
            self.off += tag not in ("br", "img")
        elif tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "a", "i", "em", "strong", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        if self.off:
            self.off -= 1
        elif tag not in ("b", "a", "i", "em", "strong", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.off:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)


def test_pages_hold_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) > 200 and all("<article>" in r["html"] for r in rows)
    assert {r["page_id"]: main_text(r["html"]) for r in rows} == {r["page_id"]: Plain(r["html"]).text() for r in rows}


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_density_finds_the_article_under_any_tag(spark, tag):
    """Without article or main the density alone has to find it."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = r["html"].replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
        want = Plain(r["html"]).text()
        if tag != "div" or len(want) >= 100:  # of two short boxes without a sign the longer one is the article
            assert main_text(page) == want


@pytest.mark.parametrize("start", ['<p title="a hidden gem">', '<p data-widget-id="related-1">', '<p class="side-effect">', '<p id="legal-history">', '<p data-x="display:none">', "<p class='shared-values'>", '<p class="header-image-caption-story">', "<p title=hidden/>"])
def test_paragraphs_with_innocent_attributes_stay(start):
    page = "<body><nav><a href=/>x</a></nav><article><h1>Title</h1>" + "<p>Some words of the article, more of them.</p>" * 3 + start + "Kept words of this one.</p></article><footer>f</footer></body>"
    assert main_text(page).split("\n")[-1] == "Kept words of this one."


@pytest.mark.parametrize("start", ["<div hidden>", '<div style="color: red; display : none">', '<div aria-hidden="true">', '<div class="related-posts">', '<div id="comments">', '<div class="shareButtons">', '<section class="newsletter-signup box">', '<div role="navigation">', '<div class="cookie_notice">', '<ol class="commentlist">'])
def test_boxes_go(start):
    tag = start[1:].split()[0].rstrip(">")
    page = "<body><article><h1>Title</h1>" + "<p>Some words of the article, more of them.</p>" * 3 + f"{start}<p>Words that aren't its own.</p></{tag}><p>Last.</p></article></body>"
    assert main_text(page).split("\n")[-1] == "Last." and "own" not in main_text(page)


@pytest.mark.parametrize("page", ['<p a="' * 200_000, "<b>" * 100_000 + "</p>" * 200_000, "<div>" * 200_000, "<b>" * 100_000 + "<hr>" * 100_000, "<div>" + "<b>" * 50_000 + "<div></i>" * 50_000, "<" * 1_000_000, "<!--" * 200_000, "<p a='\">" * 100_000, "<script>" * 100_000, "<p>" + "x" * 2_000_000, "<a =" * 200_000, "<p " + " " * 500_000, "<li><ul>" * 60_000])
def test_bad_pages_take_time_in_proportion(page):
    began = time.process_time()
    assert isinstance(main_text(page), str)
    assert time.process_time() - began < 15


def test_pages_query(spark, sf):
    got = op6_html_extraction(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and "<p>" not in r["text"] for r in got)
    assert sum(r["n_chars"] > 0 for r in got) > 0.9 * len(got)
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", PAGE, "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in extract(odd).collect())[0] == 0
    assert extract(odd.limit(0)).count() == 0


def slow_align(a, b):
    best = 0.0
    score = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
            best = max(best, score[i, j])
    return best / (2 * len(a))


def test_alignment_matches_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 20))
        assert align(a, b) == pytest.approx(slow_align(a, b))


def test_planted_items_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(40)]
    rows = []
    for k in range(120):
        words = rng.choices(vocabulary, k=300)
        if k < 60:
            part = items[k % 40][1].split()
            for _ in range(k // 20 * 2):
                part[rng.randrange(30)] = rng.choice(vocabulary)
            if k % 2:
                part.insert(10, "extra")
            words[100:100] = part
        rows.append((k, " ".join(words).upper() if k % 3 else ", ".join(words), "z"))
    docs = spark.createDataFrame(rows + [(500, None, "z"), (None, "", "z")], "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame(items + [(None, "x"), (99, None), (98, "too short")], "item_id long, text string")
    for blocks in (1_000_000, 300):
        got = {r["row"]["doc_id"]: r["item_ids"] for r in contamination(docs, bench, block_words=blocks).collect()}
        assert {d: v for d, v in got.items() if v} == {k: [k % 40] for k in range(60)}
        assert len(got) == 122
    assert contamination(docs, bench.limit(0)).filter("size(item_ids) > 0").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0


def test_edited_and_cut_items_are_found_by_alignment_alone(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(40, 101))]) for i in range(20)]
    rows = []
    for k in range(100):
        part, kind = list(items[k % 20][1]), k // 20
        if kind < 2:
            for at in rng.sample(range(len(part)), len(part) * (10 + 10 * kind) // 100):
                part[at] = rng.choice(vocabulary)
        elif kind < 4:
            part = part[len(part) // 3 :] if kind == 2 else part[: -(len(part) // 3)]
        else:
            part = [x for j, w in enumerate(part) for x in ([w, "new"] if j % 2 else [w])]
        rows.append((k, rng.choices(vocabulary, k=60) + part + rng.choices(vocabulary, k=60)))
    want = {k: {i for i, w in items if align(np.array(w), np.array(t)) >= 0.65} for k, t in rows}
    assert sum(k % 20 in w for k, w in want.items()) > 75
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {r["row"]["doc_id"]: set(r["item_ids"]) for r in contamination(docs, bench).collect()} == want


def test_short_items_and_scripts_without_spaces(spark):
    zh = "机器学习是人工智能的一个分支，它研究如何让计算机从数据中学习规律并做出预测"
    docs = [(1, "He said: What is the capital of France? Paris."), (2, "what is the big capital of france"), (3, "前文。" + zh + "。后文"), (4, "另一段关于天气的文字，今天天气很好，我们去公园散步吧，明天可能会下雨"), (5, "yes no"), (6, "前" + zh.replace("计算机", "电脑") + "后"), (7, "yes")]
    items = [(10, "what is the capital of france"), (11, zh), (12, "no"), (13, "..."), (14, "ab")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["item_ids"] for r in contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [10], 2: [], 3: [11], 4: [], 5: [12], 6: [11], 7: []}


def test_decontamination_query(spark, sf):
    got = op7_decontamination(spark, sf)
    texts = {r["doc_id"]: " ".join((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {r["doc_id"]: set(r["item_ids"]) for r in got.collect()}
    for d, t in texts.items():
        assert {i for i, x in items.items() if len(x.split()) >= 8 and x in t} <= found[d]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in op9_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(got[d]["score"], y) for d, y in labels.items() if d in got and got[d]["held_out"]]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.9, (auc, len(yes), len(no))


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "a b", 9), (2, "", 9), (2, "", 9), (3, "w " * 10_000, 9)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score_documents(docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(1, 0, 1), (3, None, None), (77, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, some).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert score_documents(docs.limit(0), some).count() == 0


def test_learning_separates_planted_words():
    rng = np.random.default_rng(4)
    bad = rng.integers(0, 1 << 50, 5).astype(np.uint64)
    text = lambda toxic: np.unique(np.concatenate([rng.integers(1 << 51, (1 << 51) + 300, 30).astype(np.uint64), bad[:3] if toxic else bad[:0]]))
    model = fit([text(True) for _ in range(100)], [text(k % 10 == 0) for k in range(500)], 0.1)
    t, c = text(True), text(False)
    assert model.scores(t, np.array([len(t)]))[0] > 0.5 > 0.3 > model.scores(c, np.array([len(c)]))[0]
