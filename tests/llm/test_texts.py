"""Repeat removal, page extraction and toxicity, against plain versions and held-out rows."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeguard.llm import extract, queries, repeats, toxicity

SF = "/root/testdata/sf0.001"


def plain_repeats(texts, length=200):
    seen = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((i, p))
    marks = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                marks[i][p : p + length] = b"\1" * length
    out = []
    for b, m in zip(data, marks):
        kept = bytes(x for x, gone in zip(b, m) if not gone)
        out.append((len(b), len(b) - len(kept), sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 8, 2])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(3)
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 9)))
    passage = "".join(word() for _ in range(90))
    odd = [None, "", "short", "a" * 1000, "ab" * 400, passage[:199], passage[:200], passage[:200]]
    odd += ["".join(word() for _ in range(rng.randint(0, 60))) + passage[rng.randint(0, 80) :][: rng.randint(150, 330)] + word() * 30 for _ in range(40)]
    odd += [passage[:i] + "#" + passage[i:] for i in range(5, len(passage), 37)]
    texts = real + odd
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])], "doc_id long, text string")
    docs = docs.withColumn("trigger", F.lit(1)).withColumn("spans", F.lit("x")).repartition(3)
    got = repeats.remove_repeats(docs, hot=hot).collect()
    want = plain_repeats([*texts, texts[0], texts[3]])
    key = lambda r: (r[0] is None, r[0], r[4])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted([(i, *w) for i, w in zip([*range(len(texts)), None, 3], want)], key=key)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_equal_rows_in_great_number(spark):
    rng = random.Random(8)
    page = "".join(rng.choices("abcdefgh ", k=900))
    other = "".join(rng.choices("abcdefgh ", k=500)) + page[300:700]
    docs = spark.createDataFrame([(7, page)], "doc_id long, text string").crossJoin(spark.range(20_000).select()).repartition(4)
    docs = docs.unionByName(spark.createDataFrame([(8, other), (None, page)], "doc_id long, text string"))
    own = repeats.keyed(docs)
    copies = own.groupBy("d", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spans = repeats.repeated_ranges(own, copies, True).collect()
    assert len(spans) == 3 and max(len(r.spans) for r in spans) < 50  # not once for each copy
    got = repeats.remove_repeats(docs, texts=False).groupBy("doc_id", "n_removed").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.doc_id, r.n_removed, r.n) for r in got} == {(7, 900, 20_000), (8, 400, 1), (None, 900, 1)}


def test_order_of_the_corpus_finds_what_windows_share():
    rng = random.Random(1)
    trigger = bytes(rng.choices(range(256), k=48))
    heads, tails = [bytes(rng.choices(range(2), k=152)) for _ in range(4)], [bytes(rng.choices(range(2), k=152)) for _ in range(4)]
    texts, before, back, groups = [], [], [], []
    for _ in range(300):
        a, b = rng.choice(heads)[-(n := rng.randint(0, 152)) or 152 :][: n if n else 0], rng.choice(tails)
        l = rng.randint(0, n)
        texts.append(a + trigger + b[: 152 - l])
        before.append(n)
        back.append(l)
        groups.append(rng.randint(0, 1))
    got = repeats.shared_windows(np.array(groups), texts, np.array(before), np.array(back), np.zeros(300, int), np.full(300, 152))
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for l in range(back[i], before[i] + 1):
            seen[groups[i], t[before[i] - l : before[i] - l + 200]].append((i, l))
    want = np.zeros((300, 153), bool)
    for places in seen.values():
        for i, l in places:
            want[i, l] = len(places) > 1
    assert (got == want).all() and want.any() and not want.all()


def test_triggers_are_chosen_by_content():
    rng = np.random.default_rng(0)
    common = rng.integers(97, 110, 400).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 110, n).astype(np.uint8), common]) for n in (10, 777)]
    places = []
    for t in texts:
        _, at, first, last = repeats.phrases(t, np.array([len(t)]), repeats.Rolling())
        assert first[0] == 0 and last[-1] == len(t) - 200 and (first[1:] == last[:-1] + 1).all()
        places.append({int(a) - len(t) for a, l in zip(at, last) if l >= len(t) - 400})
    assert places[0] & places[1] and {p for p in places[0] if p >= -248} == {p for p in places[1] if p >= -248}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/a">A</a><li><a>B</a></ul></nav><div class="ad">buy</div>
<main><article><header><h1>Head&amp;line</h1><p class="byline">By someone</p></header><p>First  <b>bold</b>\n text<br>more<p>Second &lt;p&gt;
<div class="cookie-notice">We use cookies</div><ul><li>one<li>two</ul><aside>side</aside><form>Name <input></form>
<section id="comments"><p>nice post</p></section></article></main><div id="sidebar">links</div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    tree = extract.parse(PAGE)
    assert extract.main_text(tree, extract.wrapper(tree)) == "Head&line\n\nFirst bold text more\n\nSecond <p>\n\none\n\ntwo"


def test_wrapper_finds_the_text_without_an_article(spark):
    rng = random.Random(0)
    prose = lambda: " ".join(rng.choices("alpha beta gamma delta".split(), k=40))
    rows, want = [], {}
    for i in range(30):
        own = [prose() for _ in range(1 + i % 4)]
        body = "".join(f"<p>{p}</p>" for p in own)
        extra = "<div class='box'>Our fixed slogan</div>" if i % 3 else ""
        rows.append((i, f"http://plain.example/{i}", f"<html><body><div class=top>Welcome to our site</div><div class=text>{extra}{body}</div><div class=end>Contact us</div></body></html>"))
        want[i] = "\n\n".join(own)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    assert got == want


def inferred(*pages):
    host = []
    for page in pages:
        host = extract.align(host, extract.stream(extract.parse(page)))
    return host


def shown(items):
    """A wrapper as text: ? optional, + repeated, # a variable slot, others by their length."""
    out = []
    for item in items:
        mark = "" if item[0] == ">" else "?" * bool((m := item[2 if item[0] == "<" else 1]) & 1) + "+" * bool(m & 2)
        out.append(f"<{item[1]}{mark}>" if item[0] == "<" else "/" if item[0] == ">" else f"{'=' if item[2] else '#'}{mark}")
    return "".join(out)


def test_mismatches_become_slots_options_and_groups():
    assert shown(inferred("<div>same</div>", "<div>same</div>")) == "<div>=/"
    assert shown(inferred("<div>one</div>", "<div>two</div>")) == "<div>#/"
    assert shown(inferred("<div>a</div><ul>b</ul>", "<ul>b</ul>")) == "<div?>=/<ul>=/"
    assert shown(inferred("<ul>b</ul>", "<div>a</div><ul>b</ul><table>c</table>")) == "<div?>=/<ul>=/<table?>=/"
    assert shown(inferred("<p>a<p>b<p>c")) == "<p+>#/"
    assert shown(inferred("<p>a", "<p>a<p>b")) == "<p+>#/"
    assert shown(inferred("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "<dl><dt+>#/<dd+>#//"
    assert shown(inferred("<dl><dt>a<dd>b<dt>c<dd>d<dd>e</dl>", "<dl><dt>f</dl>")) == "<dl><dt+>#/<dd?+>#//"
    assert shown(inferred("<div><h1>one</h1><p>y</p><p>x</p></div>", "<div><h1>two</h1><table>t</table><p>x</p></div>")) == "<div><h1>#/<table?>=/<p+>#//"
    # The wrapper of a wrapper and a page is that of all pages, whatever the order of two that differ by one part.
    a, b, c = "<div><h1>1</h1><p>x</div>", "<div><h1>2</h1><i></i><p>y<p>z</div>", "<div><h1>3</h1><p>x</div>"
    assert shown(extract.align(inferred(a, b), inferred(c))) == shown(inferred(a, c, b)) == "<div><h1>#/<p+>#//"


def test_alignment_takes_every_page_whole():
    """Whatever the pages, their tokens all meet an item of their kind in the wrapper of them all."""
    rng = random.Random(12)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["text", "other", "words"])
        t = rng.choice(["div", "section", "p", "div class=a", "div class=b", "table"])
        return f"<{t}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{t.split()[0]}>"

    for _ in range(150):
        pages = ["".join(tree(4) for _ in range(3)) for _ in range(rng.randint(1, 4))]
        host = inferred(*pages)
        assert extract.ends(host) and sum(i[0] == "<" for i in host) == sum(i[0] == ">" for i in host)
        for page in pages:
            own, met = extract.stream(extract.parse(page)), {}
            extract.align(host, own, met)
            assert all(extract.kind(own[j]) == extract.kind(item) for j, item in met.items())
            assert len(met) == sum(i[0] != ">" for i in own)
        parts = extract.align(inferred(*pages[: len(pages) // 2]), inferred(*pages[len(pages) // 2 :]))
        assert sum(i[4] for i in parts if i[0] == "#") == sum(i[4] for i in host if i[0] == "#")  # no text is lost or counted twice


def test_results_need_the_wrapper_of_the_host(spark):
    """No tag or name tells anything here: what stands alike on the host's pages does."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(n))
    top, end, note = prose(12), prose(15), prose(9)
    menu = "".join(f"<div class=q><a href=/{i}>{prose(1)}</a></div>" for i in range(6))
    rows, parts = [], {}
    for i in range(40):
        own = [prose(25) for _ in range(1 + i % 5)]
        body = "<h2 id=related-work>" + prose(3) + "</h2>" + "".join(f"<p class=notice-period>{p}</p>" for p in own)
        extra = f"<div class=r>{note}</div>" if i % 2 else ""
        page = f"<body><div class=k><div class=m>{top}</div><div class=t>{menu}</div><div class=v>{extra}{body}</div><div class=w>{end}</div></div></body>"
        rows.append((i, f"http://plain.example/{i}", page))
        parts[i] = re.sub("<[^>]*>", "\n", page).split("\n")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    # By brute force: the texts of a page that don't stand on all pages that have their place.
    often = Counter(t for p in parts.values() for t in {x.strip() for x in p if x.strip()})
    want = {i: "\n\n".join(t.strip() for t in p if t.strip() and often[t.strip()] < 3) for i, p in parts.items()}
    assert got == want
    assert all(alone(page) != got[i] for i, _, page in rows if i % 2)


def test_class_words_count_for_containers_and_as_whole_names():
    prose = "<p>" + "plain words of the story " * 20 + "</p>"
    kept = "<h2 id=related-work>Related</h2><div class=share-prices>Prices</div><p class=notice-period>Period</p><ul class=no-comment><li class=ad>One</ul>"
    gone = "<div class=share-buttons>Share</div><div class='x site-footer'>Foot</div><section id=comments>Said</section><ul class=breadcrumbs><li>Home</ul>"
    text = alone(f"<body><article>{prose}{kept}{gone}</article></body>")
    assert text.split("\n\n")[1:] == ["Related", "Prices", "Period", "One"]


def test_wide_and_deep_pages_take_no_square_of_time():
    wide = "<body>" + "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>text {i}</div>" for i in range(20_000)) + "</body>"
    deep = "<body>" + "<div>" * 30_000 + "deep" + "</body>"
    began = time.time()
    host = inferred(wide, deep, wide)
    assert extract.main_text(extract.parse(deep), host).endswith("deep") and "text 19999" in extract.main_text(extract.parse(wide), host)
    assert time.time() - began < 60


def test_extraction_of_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no host", "just text &nbsp; here"), (4, "http://h/1", "<p>a<p>b"), (4, "http://h/1", "<p>a<p>b"), (None, "http://h/2", "<div>" * 3000 + "deep"), (6, "http://h/3", "<article>cut <b>off &am"), (7, "http://h/4", "<script>never ends"), (8, "http://H/5", "a < b <3 <article><p>x</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("wrapper", F.lit(2))
    got = extract.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == texts[7] == "" and texts[3] == "just text here" and texts[6] == "cut off &am" and texts[8] == "x"
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(pages.limit(0)).count() == 0


def test_extraction_of_the_given_pages(spark):
    """Every page's text is its article's, also where neither that tag nor the adverts' class is there to tell."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want[r.page_id] = "\n\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))
    assert {r.page_id: r.text for r in extract.extract(pages).collect()} == want
    plain = F.regexp_replace(F.regexp_replace("html", "<(/?)article>", "<$1section>"), 'class="ad"', 'class="z"')
    got = {r.page_id: r.text for r in extract.extract(pages.withColumn("html", plain)).collect()}
    assert sum(got[i] == want[i] for i in want) > 0.9 * len(want)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").collect()
    own = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    hit = sum(r.predicted and r.toxic for r in own)
    assert hit / max(1, sum(r.predicted for r in own)) > 0.9 and hit / max(1, sum(r.toxic for r in own)) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_scores_do_not_depend_on_neighbours_or_pieces(spark):
    docs = [(i, t) for i, t in enumerate([None, "", "!!!", "one", "one two", "a stupid idiot clown", "word " * 300, "x"])] + [(3, "one"), (None, "one two")]
    labels = [(i, None, y) for i, y in [(1, 0), (2, 0), (3, 0), (5, 1), (7, 0), (4, 0), (6, 0), (0, 1)]] + [(9, 1, 1), (5, 0, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1))
    model = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.table is not None
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(docs)
    scorer = toxicity.Scorer(model)
    alone = {t: float(scorer.scores([t or ""])[0]) for _, t in docs}
    assert all(abs(r.score - alone[dict(docs)[r.doc_id]]) < 1e-6 for r in got)
    words = [f"w{i}" for i in range(300)] + ["a", "stupid", "idiot", "clown", "x"] + [f"w{i}" for i in range(40)]
    whole = scorer.features([words])[0]
    for chunk in range(2, 60):  # every text boundary falls at every place of a window
        scorer.CHUNK = chunk
        assert np.abs(scorer.long_text(words) - whole).max() < 1e-5
        assert abs(scorer.scores(["word " * 300])[0] - alone["word " * 300]) < 1e-6
    nothing = toxicity.learn(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score(frame, nothing).collect()} == {0.0}
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_training_and_scoring_see_the_same_features(spark):
    rng = random.Random(9)
    texts = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 50]))] for _ in range(60)]
    cfg = toxicity.Training(buckets=1 << 10)
    net = toxicity.Net(cfg, np.random.default_rng(0).normal(0, 1, cfg.buckets).astype(np.float32))
    ids = [toxicity.keys_of(np.array([toxicity.buckets(w, cfg.buckets) for w in t], np.int64).reshape(-1, 3)) for t in texts]
    model = toxicity.Model(net.table, net.kernels, net.bias, net.out)
    features, at, _ = net.pooled(ids)
    assert np.abs(features - toxicity.Scorer(model).features(texts)).max() < 1e-4
    before = features @ net.out
    y = np.array([i % 2 for i in range(60)], np.float32)
    loss = lambda: float(np.log1p(np.exp(-(2 * y - 1) * net.logits(ids))).mean())
    first = loss()
    table, kernels = net.table.copy(), [k.copy() for k in net.kernels]
    for _ in range(30):
        net.step(ids, y, np.ones(60))
    assert loss() < first and (net.table != table).any() and all((a != b).any() for a, b in zip(net.kernels, kernels)) and len(before) == 60


def test_labels_and_rows_that_repeat(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text") for i in range(40)] * 3 + [(None, "word1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    again = toxicity.score(docs, toxicity.learn(docs.repartition(5), labels.repartition(2))).collect()
    assert len(got) == 121 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in again}


def alone(page):
    tree = extract.parse(page)
    return extract.main_text(tree, extract.wrapper(tree))


@pytest.mark.parametrize(
    "around",
    [
        "<div class='layout has-sidebar'><article>{}</article></div>",
        "<article class='post sponsored'>{}</article><p>Contact</p>",
        "<form action=/><div><main>{}</main></div></form>",
        "<main><div class='content no-sidebar'>{}</div></main>",
        "<div class='content no-sidebar'><div class=text>{}</div></div>",
        "<form>{}</form>",
    ],
)
def test_furniture_words_do_not_lose_the_main_text(around):
    prose = "<p>" + "plain words of the story " * 20 + "<p>" + "and another paragraph " * 20
    page = "<html><body><nav>Menu</nav>" + around.format(prose + "<div class=ad>buy</div>") + "<div class=sidebar>links</div></body></html>"
    assert alone(page) == "\n\n".join(("plain words of the story " * 20 + "\n\n" + "and another paragraph " * 20).strip().split(" \n\n"))


def test_comments_and_teasers_stay_out():
    prose, said = "<p>" + "story " * 30, "<p>" + "I say so " * 90
    assert alone(f"<article>{prose}</article><section id=comments><article class=comment>{said}</article><article class=comment>{said}</article></section>") == ("story " * 30).strip()
    assert alone(f"<div class=text>{prose}</div><div class=comments>{said}</div>") == ("story " * 30).strip()


def test_copies_of_a_page_are_no_template(spark):
    one = "<html><body><div class=text><h1>Title</h1><p>Only paragraph of this page</div></body></html>"
    two = "<html><body><div class=text><h1>Title</h1><p>First paragraph<p>Second paragraph</div></body></html>"
    rows = [(i, "http://one.example/", one) for i in range(5)] + [(10 + i, "http://two.example/", two) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    assert all(got[i] == "Title\n\nOnly paragraph of this page" and got[10 + i] == "Title\n\nFirst paragraph\n\nSecond paragraph" for i in range(5))


def test_fixed_text_goes_at_its_own_place_only():
    page = "<body><div class=text><div class=box>Same words</div><p>{}</p><p>{}</p></div></body>"
    pages = [page.format(f"Prose number {i} of this host", "Same words" if i == 3 else f"More prose {i}") for i in range(6)]
    host, trees = inferred(*pages), list(map(extract.parse, pages))
    assert extract.main_text(trees[3], host) == "Prose number 3 of this host\n\nSame words"
    assert extract.main_text(trees[1], host) == "Prose number 1 of this host\n\nMore prose 1"


@pytest.mark.parametrize("deep", [100, 200, 5000])
def test_deep_nesting_closes_its_own_elements(deep):
    inner = "<div>" * deep + "deep<nav>menu</nav><div class=ad>buy</div>" + "</div>" * deep
    assert alone(f"<body><div><article><p>before</p>{inner}<p>after</p></article></div><p>Contact</p></body>") == "before\n\ndeep\n\nafter"
    assert alone("<body><p>Contact</p>" + "<div>" * deep + "<article><p>deep</p></article>" + "</div>" * deep + "<p>end</p></body>") == "deep"
