"""Operators that learn or infer: held-out accuracy, properties, odd inputs."""

from __future__ import annotations

import functools
import html
import itertools
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from skyraster.llm import html_main, language, quality_model, queries

SF = "/root/testdata/sf0.01"


# --- main text --------------------------------------------------------------------------------


def article(page):
    inner = page[page.index("<article>") + 9 :].split("</article>")[0]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|div)[^>]*>", inner)]
    return " ".join(x for x in parts if x)


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(5)
    html_of = {r.page_id: r.html for r in pages.collect()}
    got = queries.op1_main_text(spark, SF).collect()
    assert len(got) == len(html_of)
    for r in got:
        assert r.text == article(html_of[r.page_id]) and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><div class="top-nav"><a href=1>Home</a></div>
<div id="wrap"><div class="content"><h2>{title}</h2><p>{a} &amp; b<p>second <b>bold</b>, <i>part</i><br>line</p><ul><li>one<li>two</ul><div class="ad-box">Buy now</div><table><tr><td>cell<td>next</table></div>
<aside>Side</aside><div class="comments"><p>First!</p></div></div><form><input name=q><label>Search</label></form><div class="cookie-notice">We use cookies</div><footer>end</footer><script>var a="<p>no</p>"</script></body>"""


def test_other_layouts(spark):
    rows = [(k, f"https://h.example/{k}", PAGE.format(title=f"T{k}", a="x" * (k + 1))) for k in range(8)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "just words &lt;here&gt;"), (103, "https://h.example/x", "<p>only <a href=x>a</a> page"), (103, "https://h.example/x", "<p>only <a href=x>a</a> page"),
             (104, "http://bad", "<div><p>open <b>tags<p>go on"), (105, "http://q", "<p class='a>b\" x>quote</p><p>after"), (106, "http://long", "<article>" + "<p>word</p>" * 20_000 + "</article>"),
             (107, "http://deep", "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after"), (108, "http://odd", "".join(f"<p class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>{k}" for k in range(6000))),
             (109, "http://odd", "".join(f"<p class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>{k}" for k in range(6000, 0, -1)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit(1))
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert got[3] == "T3 xxxx & b second bold, part line one two cell next"
    assert got[100] == got[101] == "" and got[102] == "just words <here>" and got[103] == "only a page" and got[104] == "open tags go on"
    assert got[106] == " ".join(["word"] * 20_000)
    assert got[107] == "deep after" and len(got[108].split()) == 6000 and len(got[109].split()) == 6000
    assert html_main.extract(df).count() == len(rows) and html_main.extract(df.limit(0)).count() == 0


def expression(page):
    return html_main.parse(page)[0]


def wrapper(pages):
    """As the operator infers it: different expressions in their order."""
    return functools.reduce(html_main.merge, sorted(map(expression, pages), key=html_main.stream))


def told(w, page):
    return html_main.Extractor().text("h", page, (html_main.stream(w), html_main.counts(w)))


def test_wrappers_generalise():
    w = html_main.merge(expression("<ul><li>1</li><li>2</li></ul><p>same</p>"), expression("<ul><li>3</li></ul><div>extra</div><p>same</p>"))
    assert html_main.stream(w) == "<html <ul <li+ # > > <div? # > <p # > >"
    slot, extra, same = html_main.leaves(w)
    assert slot.low != slot.high and same.low == same.high and (slot.n, extra.n, same.n) == (2, 1, 2)
    assert html_main.stream(expression("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>")) == "<html <()+ <h2 # > <p # > > >"
    back = html_main.build(html_main.stream(w), np.frombuffer(html_main.counts(w), np.int64))
    assert html_main.stream(back) == html_main.stream(w) and html_main.counts(back) == html_main.counts(w) and [x.shape for x in back.kids] == [x.shape for x in w.kids]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_common_subsequence_is_longest(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    pairs = html_main.common(list(x), list(y))
    assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(pairs))


def neutral(page):
    """The page without telling tags and attributes; its headings are divisions too."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|section|h[1-6])\b[^>]*>", r"<\1div>", page))


def test_neutral_names_inference_and_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").toPandas()
    want = {r.page_id: article(r.html) for r in pages.itertuples()}
    pages["html"] = pages["html"].map(neutral)
    df = spark.createDataFrame(pages)
    got = {r.page_id: r.text for r in html_main.extract(df.repartition(3)).collect()}
    assert got == want
    assert {r.page_id: r.text for r in html_main.extract(df.repartition(7, "url")).collect()} == got
    alone = {r.page_id: r.text for r in html_main.extract(df, infer=False).collect()}
    assert sum(alone[k] != got[k] for k in got) > 20  # what single pages cannot tell


def test_wrappers_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(html_main, "FAN", 3)  # several levels
    kinds = ["<p>{0} words of the text {0}</p>", "<h2>{0}</h2>", "<ul><li>{0}<li>b{0}</ul>", "<blockquote>{0}</blockquote>", "<pre>{0}</pre>"]
    rows = [(f"h{k % 2}", "<div><a href=1>Home</a></div><div>" + "".join(kinds[(k >> s) % 5].format(k + s) for s in range(k % 6 + 1)) + "</div><div>All rights</div>") for k in range(120)]
    df = spark.createDataFrame(rows, "host string, html string")
    found = [sorted(map(tuple, html_main.wrappers(df.repartition(n), f"{tmp_path}/{n}").collect())) for n in (1, 4, 9)]
    assert len(found[0]) == 2 and found[0] == found[1] == found[2]


STORY = "".join(f"<p>{{0}} paragraph {k} of the story, told at some length on page {{0}}.</p>" for k in range(4))


@pytest.mark.parametrize("side", [
    "<div><p>We and our partners store cookies on this device, to show adverts and to count visits. Read more, accept or refuse.</p></div>",
    "<div><a href=1>Other story {0}</a> <a href=2>And one more {0}</a></div>", "<div><p>reader {0}: yes</p><p>other {0}: no</p></div>",
    "<aside><p>{0} is the number of the day, and more about it is told in this box beside the story of page {0}</p></aside>"])
def test_side_parts_go(side):
    pages = [f"<div><ul><li><a href=1>Home</a><li>Search</ul></div>{side.format(k)}<div><h1>Title {k}</h1>{STORY.format(k)}</div><div>All rights reserved</div>" for k in range(6)]
    w = wrapper(pages)
    for k, page in enumerate(pages):
        assert told(w, page) == " ".join([f"Title {k}", *re.findall("<p>(.*?)</p>", STORY.format(k))])


def test_a_varying_heading_leads(spark):
    talk = "".join("<div><b>reader {0}</b><p>opinion " + f"{k}" + " about page {0}, and quite a long one at that, as such opinions are</p></div>" for k in range(6))
    pages = [f"<div>Menu</div><div><div><h1>T{k}</h1><p>{k} is a short story about the weather</p></div><div><h3>Said</h3>{talk.format(k)}</div></div><div>All rights</div>" for k in range(6)]
    w = wrapper(pages)
    assert all(told(w, page) == f"T{k} {k} is a short story about the weather" for k, page in enumerate(pages))


def test_names_only_break_ties():
    talk = "".join(f"<div class=comment><b>reader {{0}}</b><p>opinion {k} about page {{0}}, and quite a long one</p></div>" for k in range(3))
    pages = [f"<article><h1>T{k}</h1><p>{k} is a short story about a page of a site that has readers</p></article><div class=comments>{talk.format(k)}</div>" for k in range(6)]
    assert told(wrapper(pages), pages[3]) == "T3 3 is a short story about a page of a site that has readers"  # a third of the weight, but the name
    inside = [f"<div class=menu><div class=sidebar><h1>T{k}</h1>{STORY.format(k)}</div></div><div class=content>Call us {k}</div>" for k in range(6)]
    assert told(wrapper(inside), inside[2]).startswith("T2 2 paragraph 0")  # whatever it is called, the weight is there


@pytest.mark.parametrize("bodies", [
    ["<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>x</h2><p>y</p>"], ["<h1>t</h1><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>", "<h1>u</h1><p>x</p><h2>y</h2><p>z</p>"],
    ["<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>", "<dl><dt>x</dt><dd>y</dd></dl>"], ["<h2>a</h2><p>b</p><hr><h2>c</h2><p>d</p><hr>", "<h2>v</h2><p>w</p><h2>x</h2><p>y</p>", "<p>z</p>"],
    ["<h2>a</h2><p>b</p><h2>c</h2><p>d</p><hr>" * 2, "<h2>x</h2><p>y</p>"]])
def test_runs_held_once_and_repeated(bodies):
    pages = [f"<nav>menu</nav><article>{b}</article><footer>end</footer>" for b in bodies]
    for order in itertools.permutations(pages):
        known = functools.reduce(html_main.merge, map(expression, order))
        for page, body in zip(pages, bodies, strict=True):
            assert told(known, page) == " ".join(re.sub("<[^>]*>", " ", body).split())


@pytest.mark.parametrize("article", ["<article><h2>{h}</h2><p>{p}</p>{c}</article>", "<article><h2>{h}</h2><p>{p}</p></article>{c}", "<div><h3>{h}</h3><p>{p}</p></div>{c}", "<div class='post'><p>{h}</p><p>{p}</p></div>{c}"])
def test_comments_of_any_weight_go(spark, article):
    talk = "<section class='comments'>" + "".join(f"<p>reader {k} said {{n}} words on and on, and then some more of the same kind</p>" for k in range(60)) + "</section>"
    pages = [(k, "https://a.example/x", "<body><nav><a href='/'>Home</a></nav>" + article.format(h=f"Head {k}", p=f"A short text number {k}.", c=talk.format(n=k)) + "</body>") for k in range(6)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {k} A short text number {k}." for k in range(6)}


def test_nesting_takes_time_in_proportion():
    html_main._deep()
    took = []
    for n in (2_000, 20_000):
        page = "<body>" + "<div>" * n + "<h2>Some head</h2><p>Some text.</p>" + "</div>" * n + "</body>"
        began = time.perf_counter()
        assert html_main.Extractor().text("h", page, None) == "Some head Some text."
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_inference_tells_template_from_text_despite_names(spark):
    """Which of two boxes without a telling name is the text, only the host's other pages show."""
    page = "<body><article><h1>Head {k}</h1><p>Copy only with a written permission of the house.</p><p>Text {k} of its own.</p></article><div><p>All about us, and where to write to.</p></div></body>"
    side = "<body><div><p>All about us, and where to write to.</p><p>And the terms of the house, at length, for all who would read them.</p></div><section><p>Text {k} alone.</p></section></body>"
    rows = [(k, "https://a.example/x", page.format(k=k)) for k in range(5)] + [(k, "https://b.example/x", side.format(k=k)) for k in range(5, 10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    told, alone = ({r.page_id: r.text for r in html_main.extract(df, infer=how).collect()} for how in (True, False))
    assert [told[k] for k in range(5, 10)] == [f"Text {k} alone." for k in range(5, 10)]
    assert all(told[k] != alone[k] for k in range(5, 10))
    assert all(told[k].startswith(f"Head {k}") and told[k].endswith(f"Text {k} of its own.") for k in range(5))


def test_page_without_container_keeps_a_folded_run():
    many = "<p>Welcome to the site</p>" + "".join(f"<h2>h{k}</h2><p>text {{0}} {k}</p>" for k in range(3))
    pages = [many.format(k) for k in range(6)] + ["<p>Welcome to the site</p><h2>once</h2><p>told</p>"]
    known = functools.reduce(html_main.merge, map(expression, pages))
    assert told(known, pages[-1]).endswith("once told")


# --- quality classifier -----------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, documents, nothing):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    odd = quality_model.classify(documents.withColumn("quality", F.lit("clash")).withColumn("vector", F.lit(1)), labels)
    assert odd.count() == documents.count() and odd.where("score is null").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.classify(documents, none).collect()} == {0.5}
    assert quality_model.classify(nothing, labels).count() == 0


def test_context_sums_by_brute_force():
    texts = pa.array(["one two, three!! ONE two", None, "", "x"])
    words = {}
    for w, at, _ in quality_model.word_ids(texts):
        for a, b in zip(w.tolist(), at.tolist(), strict=True):
            words.setdefault(b, []).append(a)
    want = np.zeros((quality_model.VOCAB, quality_model.DIMS), np.int64)
    for seq in words.values():
        for i, a in enumerate(seq):
            for j in range(max(0, i - quality_model.REACH), min(len(seq), i + quality_model.REACH + 1)):
                if i != j:
                    want[a] += quality_model.INDEX[seq[j]]
    assert (quality_model.context_sums(texts) == want).all()


def test_network_gradient_step_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 6))
    y = (x[:, 0] + 0.5 * rng.normal(0, 1, 400) > 0).astype(float)
    net = quality_model.Network(x, y, np.arange(400) % 10 != 0)
    assert ((net.score(x) > 0.5) == y).mean() > 0.8 and net.temperature > 0
    z, t = rng.normal(0, 1, (30, 6)), rng.integers(0, 2, 30).astype(float)
    for part, g in zip(net.w, quality_model.gradients(net.w, z, t), strict=True):
        flat, slopes = part.reshape(-1), g.reshape(-1)
        for k in rng.choice(len(flat), min(5, len(flat)), replace=False):
            old = flat[k]
            flat[k] = old + 1e-5
            up = quality_model.loss(net.w, z, t)
            flat[k] = old - 1e-5
            down = quality_model.loss(net.w, z, t)
            flat[k] = old
            assert slopes[k] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)
    rest, logit = y[np.arange(400) % 10 == 0], net.logits(x[np.arange(400) % 10 == 0])
    calibrated = lambda g: np.mean(np.logaddexp(0, logit / g) - rest * logit / g)
    assert all(calibrated(net.temperature) <= calibrated(net.temperature * f) for f in (0.8, 0.9, 1.1, 1.25))


def test_pooling_by_brute_force():
    rng = np.random.default_rng(3)
    table = rng.normal(0, 1, (quality_model.VOCAB, 8)).astype(np.float32)
    texts = pa.array(["one two, three!! ONE two", None, "", "x", "a b c d a b c a b c", *["w%d" % k for k in range(300)]])
    got = quality_model.pool(texts, table)
    words: dict[int, list[int]] = {}
    for w, at, again in quality_model.word_ids(texts):
        for a, b in zip(w.tolist(), at.tolist(), strict=True):
            words.setdefault(b, []).append(a)
        for b, n in enumerate(again.tolist()):
            words[b] = words.get(b, []) + [quality_model.REPEAT] * n
    assert words[4].count(quality_model.REPEAT) == 2  # a b c comes twice more
    for k in range(len(texts)):
        mean = table[words[k]].mean(0) if words[k] else np.zeros(8)
        assert np.allclose(got[k], [*mean, np.log1p(len(words[k]))], atol=1e-5)


def test_pooling_does_not_depend_on_neighbours():
    rng = np.random.default_rng(6)
    table = quality_model.vectors(rng.integers(-50, 50, (quality_model.VOCAB, quality_model.DIMS)))
    texts = pa.array([" ".join("w%d" % k for k in rng.integers(0, 900, n)) for n in rng.integers(0, 600, 150)])
    alone = np.concatenate([quality_model.pool(texts.slice(k, 7), table) for k in range(0, 150, 7)])
    assert np.array_equal(quality_model.pool(texts, table), alone)


def test_quality_does_not_depend_on_partitions(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one, two = ({r.doc_id: round(r.score, 9) for r in quality_model.classify(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two


# --- language ---------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark, documents, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op10_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = language.identify(documents.withColumn("lang_pred", F.lit("clash")), 2000)
    rows = {r.doc_id: r for r in odd.collect()}
    assert odd.count() == documents.count() and all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (100_001, 100_002, 100_003))
    assert language.identify(nothing).count() == 0
    unknown = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(unknown).first().lang_pred == "und"
    again = language.identify(documents.repartition(9), 2000).collect()
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in again) == sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in odd.collect())
    signs = spark.createDataFrame([(-1, "½ ² ① Ⅷ 12 --"), (-2, "½ a")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = language.identify(documents.select("doc_id", "text", "lang").unionByName(signs), 2000).where("doc_id < 0").collect()
    assert {r.doc_id: r.lang_pred == "und" for r in got} == {-1: True, -2: False}


def test_texts_without_ids_are_sampled_one_by_one(spark):
    rows = [(None, f"text number {k} of some length " * 20, "en" if k % 2 else "de") for k in range(4000)]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4000)
    assert 300 < len(got) < 1500 and {r.lang for r in got} == {"en", "de"}


def test_gradients_by_differences():
    model = language.Model(["a", "b", "c"])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    data, label = rng.integers(97, 103, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        prob, _ = model.positions(data)
        return -np.log(prob[:, np.arange(4), label]).mean()

    g = model.gradients(data, label)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(g[name].reshape(-1)), 5):
            old, h = flat[k], 1e-2
            flat[k] = old + h
            up = loss()
            flat[k] = old - h
            down = loss()
            flat[k] = old
            assert g[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-4), name


def test_texts_of_two_thousand_bytes_are_read_once(monkeypatch):
    """No state has to be worked out twice for texts of usual lengths."""
    steps, run = [0], language.Model._pass

    def counted(self, way, data, active, *rest):
        steps[0] += sum(active)
        return run(self, way, data, active, *rest)

    monkeypatch.setattr(language.Model, "_pass", counted)
    raw, sizes = np.random.default_rng(2).integers(97, 123, 6_000, dtype=np.uint8), np.array([2_000, 2_000, 2_000])
    language.Model(["a", "b"]).texts(raw, np.cumsum(sizes) - sizes, sizes)
    assert steps[0] == 2 * len(raw)


def test_texts_of_eight_thousand_bytes_are_read_once(monkeypatch):
    """Documents of 2 to 8 KB hold 42 % of the text of check_l: no state of theirs is worked out twice."""
    steps, run = [0], language.Model._pass

    def counted(self, way, data, active, *rest):
        steps[0] += sum(active)
        return run(self, way, data, active, *rest)

    monkeypatch.setattr(language.Model, "_pass", counted)
    sizes = np.array([8_000, 3, 5_000, 0, 8_192])
    raw = np.random.default_rng(2).integers(97, 123, sizes.sum(), dtype=np.uint8)
    language.Model(["a", "b"]).texts(raw, np.cumsum(sizes) - sizes, sizes)
    assert steps[0] == 2 * len(raw)


@pytest.mark.parametrize(("names", "factor"), [(2, 1), (3, 200), (20, 1), (20, 200)])
def test_probabilities_in_blocks_of_steps(names, factor):
    """With few and many languages, logits beyond the range of exp, gates shut, and lengths that are no multiple of a block."""
    model, rng = language.Model([str(k) for k in range(names)]), np.random.default_rng(4)
    model.p = {k: v * np.float32(factor if k == "o" else 40 if factor > 1 and k == "xf" else 1) for k, v in model.p.items()}
    sizes = np.array([1, 15, 16, 17, 0, 40, 333, 40])
    raw = rng.integers(32, 250, sizes.sum(), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    with np.errstate(invalid="raise", divide="raise"):
        got = model.texts(raw, starts, sizes)
    for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        want = model.positions(raw[a : a + n][None])[0].sum((0, 1)) if n else np.zeros(names)
        assert got[k] == pytest.approx(want, abs=2e-2 if factor > 1 else 2e-3)


@pytest.mark.parametrize(("chunk", "back", "lanes"), [(7, 2, 3), (50, 64, 4), (1024, 64, 2048)])
def test_whole_texts_are_read(chunk, back, lanes, monkeypatch):
    """Chunks give what one run over each whole text gives, and words are not read by themselves."""
    monkeypatch.setattr(language, "CHUNK", chunk)
    monkeypatch.setattr(language, "BACK", back)
    monkeypatch.setattr(language, "LANES", lanes)
    monkeypatch.setattr(language, "SAME", 1e-7)
    model, rng = language.Model(["a", "b", "c"]), np.random.default_rng(1)
    texts = [b"", b"x", b"one two three", bytes(rng.integers(32, 250, 333, dtype=np.uint8)), b"ab " * 90, b"three two one"]
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    got = model.texts(raw, np.cumsum(sizes) - sizes, sizes)
    for k, t in enumerate(texts):
        want = model.positions(np.frombuffer(t, np.uint8)[None])[0].sum((0, 1)) if t else np.zeros(3)
        assert got[k] == pytest.approx(want, abs=2e-3)
    assert not np.allclose(got[2], got[5], atol=1e-3)


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_keeps_columns_and_clean_rows(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == documents.columns, name
        assert name == "mixing sources" or out.exceptAll(docs).count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.count() == docs.count() > 50


def test_pipeline_from_empty(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


def test_pipeline_by_sql_and_library(spark):
    """Four stages by their operators' SQL, each on its predecessor's rows, and the ids by the tokenizers library."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    con.sql(f"create table documents as select * from '{sf}/documents.parquet'")

    def step(query, keep):
        con.sql(f"create or replace table found as {query}")
        con.sql(f"create or replace table documents as select d.* from documents d join found f on f.doc_id is not distinct from d.doc_id {keep}")

    step(queries.ORACLES["op3_quality_rules"], "where f.kept")
    step(queries.ORACLES["op4_jaccard_join"], "where f.class_id = d.doc_id")
    step(queries.ORACLES["op2_decontaminate"], "where not f.contaminated")
    step(queries.ORACLES["op6_mix"], "join (select unnest([1, 2]) as n) c on f.size > 0 and c.n * f.size <= f.taken")
    tool, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for doc_id, text in con.sql("select doc_id, text from documents order by doc_id").fetchall():
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 50
