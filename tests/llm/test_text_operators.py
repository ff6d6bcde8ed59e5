"""Quality, I-Match, toxicity and page text: small cases against plain Python."""

import hashlib
import random
import re

from firnlake.llm import html_text, imatch, quality, toxicity

LINES = ["the quick brown fox jumps over a dog", "short", "### $$$ %%%", "", "\u00e9t\u00e9 \u00fcber stra\u00dfe"]


def some_texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = [None, "", " \t\n", "a", "a b c d e f g h", "x " * 300]
    for _ in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        out.append("\n".join(lines + rng.choices(LINES + lines, k=rng.randint(0, 6))))
    return out


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines, dup = set(), text.split("\n"), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_quality_figures_and_verdicts(spark):
    texts = some_texts(40) * 2
    rows = [(i, t, None if i % 7 == 0 else "en", "s", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = {r.doc_id: r for r in quality.judge(docs, min_rows=10).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        n, chars, symbols, dup, repeat = plain_figures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), text
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs.limit(0)).count() == 0


def plain_quantile(values, q):
    values = sorted(values)
    return values[max(0, min(len(values) - 1, -int(-q * len(values) // 1) - 1))]


def test_quality_limits_against_plain_quantiles(spark):
    """Groups of their own habits: small enough that the sketches hold every value (that of all texts does not)."""
    rng = random.Random(8)
    rows = []
    for lang, source, mean, sign, n in [("en", "a", 5, 0.02, 180), ("en", "b", 9, 0.3, 150), ("de", None, 7, 0.0, 120), (None, "c", 4, 0.1, 30), ("fr", "d", 6, 0.5, 9)]:
        for _ in range(n):
            count = rng.randint(20, 60)
            w = ["".join(rng.choice("abcdefgh") for _ in range(max(1, round(rng.gauss(mean, 1.5))))) for _ in range(count)]
            w = [x + ("#" * rng.randint(1, 3) if rng.random() < sign else "") for x in w]
            lines = [" ".join(w[i : i + 8]) for i in range(0, count, 8)]
            lines += [rng.choice(lines)] * rng.choice([0, 0, 0, 0, 1, 4])
            rows.append((len(rows), "\n".join(lines), lang, source))
    rows += [(9000, "# " * 300, "en", "a"), (9001, None, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in quality.judge(docs, min_rows=50).collect()}
    figures = {}
    for i, text, lang, source in rows:
        n, chars, symbols, dup, _ = plain_figures(text)
        if n:
            lines = [x for x in text.split("\n") if x.strip()]
            figures[i] = ((lang, source), (chars / n, symbols / n, dup / len(lines)))
    limits = set()
    for i, ((lang, source), mine) in figures.items():
        group = [f for k, f in figures.values() if k == (lang, source)]
        if len(group) < 50:
            group = [f for k, f in figures.values() if k[0] == lang]
        exact = len(group) >= 50
        if not exact:
            group = [f for _, f in figures.values()]
        kept, his = not got[i].base_failed, []
        for c, f in enumerate(quality.FIGURES):
            values = [x[c] for x in group]
            q25, q75 = plain_quantile(values, 0.25), plain_quantile(values, 0.75)
            spread = f.reach * max(q75 - q25, f.floor)
            high, low = q75 + spread, q25 - spread if f.level is None else float("-inf")
            above = [x for x in values if x > 0]
            if f.level is not None and above:
                high = max(high, plain_quantile(above, f.level))
            kept = kept and low <= mine[c] <= high
            his.append(high)
        near = 1e-9 if exact else 0.5
        assert [abs(got[i][f"hi_{f.name}"] - h) < near for f, h in zip(quality.FIGURES, his, strict=True)] == [True] * 3
        assert got[i].kept == kept or not exact
        limits.add(tuple(round(got[i][f"hi_{f.name}"], 6) for f in quality.FIGURES))
    assert len(limits) == 4 and 0 < sum(not r.kept for r in got.values()) < len(rows) // 4


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(5)
    plain = " ".join
    rows = [(i, plain(f"word{rng.randint(0, 999)}" for _ in range(60)), "en", "s") for i in range(300)]
    rows += [(1000, plain(f"w{i}###" for i in range(60)), "en", "s"), (1001, plain("x" * 40 + str(i) for i in range(60)), "en", "s")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {1000, 1001}


def test_imatch_contract(spark):
    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(3 * i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (1002, texts[0], "x"), (1003, texts[0], "x"), (None, "lost", "x")]
    docs = spark.createDataFrame(rows + rows[-2:-1], "doc_id long, text string, fingerprint string").repartition(4)
    got = imatch.compare_edited(docs, band=(0.001, 0.2)).collect()
    assert len(got) == len(rows) + 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    prints = {}
    for k, (i, text, _) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        for r in by_id[i]:
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    long = [r for r in got if r.n_chars > 300 and r.doc_id is not None and r.doc_id < 170]
    assert sum(r.near_edited for r in long) > 3 * sum(r.near_next for r in long)
    assert imatch.compare_edited(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    words, rude = [f"w{i}" for i in range(500)], ["idiot", "trash", "moron"]

    def text(toxic):
        out = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(4 if toxic else 0):
            out[rng.randrange(len(out))] = rng.choice(rude)
        return " ".join(out)

    truth = {i: int(i % 5 == 0) for i in range(800)}
    rows = [(i, text(t), "c") for i, t in truth.items()] + [(9000, None, "c"), (9001, "", "c"), (None, "w1 w2", "c"), (5, "w3 w4", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([*truth.items(), (9000, 0), (None, 1), (7777, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score_texts(docs, model).withColumn("out", toxicity.held_out(docs["doc_id"])).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.out and r.doc_id in truth and r.doc_id != 5]
    assert len(held) > 100
    assert sum((r.score >= 0.3) == truth[r.doc_id] for r in held) > 0.97 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 600 < kept.count() < 680
    # no labels, one class, no rows
    none = labels.limit(0)
    assert toxicity.without_toxic(docs, none).count() == len(rows)
    assert {r.score for r in toxicity.score_texts(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h2>Site</h2></header><nav><ul><li><a href="/x">x</a></ul></nav><div class="cookie-notice">cookies</div>
<div id="sidebar">side</div><aside>aside</aside><!-- c --><div class="ad">buy</div>
<article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>bold</b> wo<i>rd</i><p>Two&nbsp;x<br>y
<div class="share">share</div><form><input><button>Go</button></form><table><tr><td>c1<td>c2</table>
<section class="comments"><p>first!</p></section></article>
<footer>&copy; me</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE, set()) == "Head & line One bold word Two x y c1 c2"
    assert html_text.main_text("", set()) == ""
    assert html_text.main_text("plain <b>text</b> &lt;ok&gt;", set()) == "plain text <ok>"
    assert html_text.main_text("<body><div><p>kept</p><div role='navigation'>n</div></div>", set()) == "kept"
    assert html_text.main_text("<p>a<p>b</p></div></p>c<a href='x", set()) == "a b c"
    deep = "<div>" * 3000 + "in" + "</div>" * 3000
    assert html_text.main_text(deep, set()) == "in"


def test_templates_per_host(spark):
    def page(i):
        return f"<body><div class='top'><p>Welcome to our site</p></div><div><p>story {i}</p></div></body>"

    rows = [(i, f"http://a.com/{i}", page(i), "x") for i in range(30)]
    rows += [(100 + i, f"http://b.com/{i}", page(i), "x") for i in range(3)] + [(200, None, None, "x"), (201, "http://a.com/0", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    for bound in (1000, 0):
        got = {r.page_id: r for r in html_text.extract(pages, min_pages=10, broadcast_rows=bound).collect()}
        assert len(got) == len(rows)
        assert got[4].text == "story 4" and got[4].n_chars == 7
        assert got[101].text == "Welcome to our site story 1"  # too few pages to be sure
        assert got[200].text == got[201].text == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def test_names_do_not_cost_an_article():
    def text(page):
        return html_text.main_text(f"<body>{page}</body>", set())

    article = "<article><h1>Title</h1><p>story</p></article>"
    for name in ("class='has-sidebar'", "class='content no-sidebar'", "id='header-fixed'", "class='widget'", "role='dialog'"):
        assert text(f"<div {name}><p>x</p>{article}</div>") == "Title story"
    assert text(f"<form>{article}</form>") == "Title story"
    assert text("<div class='sidebar'><main><p>story</p></main></div>") == "story"
    assert text(f"{article}<div class='comments'><article>first!</article></div>") == "Title story"
    for name in ("article-header", "header"):
        assert text(f"<article><div class='{name}'><h1>Title</h1></div><p>story</p></article>") == "Title story"
    assert text("<article><p>a</p><section class='related-work'><p>b</p></section></article>") == "a b"
    assert text("<article><p>a</p><div class='cookie-notice'>c</div><div class='ad-3'>d</div><div class='related'><h2>r</h2></div></article>") == "a"


def test_copies_are_no_template(spark):
    one = "<body><div id='wrap'><p>by line</p><article><p>same story</p></article></div></body>"
    two = "<body><div><p>same text</p></div></body>"
    near = [f"<body><div id='wrap'><article><p>same story</p></article></div><p>{i}</p></body>" for i in range(20)]
    rows = [(i, "http://a.com/x", one) for i in range(30)] + [(100 + i, "http://b.com/x", two) for i in range(30)]
    rows += [(200 + i, f"http://c.com/{i}", h) for i, h in enumerate(near)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {i: "same text" if 100 <= i < 200 else "same story" for i, _, _ in rows}


def test_template_blocks_inside_articles(spark):
    box = "<div class='x7f'><h3>Our letter</h3><p>Write to us</p></div>"

    def page(i, story, block=box):
        return f"<body><article><h1>Head {i}</h1><p>{story}</p>{block}<p>quoted</p></article></body>"

    rows = [(i, f"http://a.com/{i}", page(i, f"story {i}").replace("<p>quoted</p>", "<p>quoted</p>" * (i % 3 == 0))) for i in range(40)]
    # edited copies of one article: a host's only recurring paragraphs are its own text
    rows += [(100 + i, f"http://b.com/{i}", page(0, "same", f"<p>edit {i}</p>")) for i in range(40)]
    rows += [(200 + i, f"http://c.com/{i}", page(i, f"story {i}")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = {i: f"Head {i} story {i}" + " quoted" * (i % 3 == 0) for i in range(40)}
    want |= {100 + i: f"Head 0 same edit {i} quoted" for i in range(40)}
    want |= {200 + i: f"Head {i} story {i} Our letter Write to us quoted" for i in range(5)}
    for bound in (1000, 0):
        assert {r.page_id: r.text for r in html_text.extract(pages, broadcast_rows=bound).collect()} == want


def test_long_malformed_pages_are_read_in_proportion():
    import time

    for page in ("<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<i>" + "<div>" * 100_000 + "</i>" * 100_000):
        begun = time.process_time()
        html_text.parse("<article>text</article>" + page)
        assert time.process_time() - begun < 20
