"""Conversations, pages and vectors, and the pipeline."""

import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from loomtext.llm import chat, decontaminate, html, materialise, mixing, quality, topk
from loomtext.llm._frames import table
from loomtext.llm.queries import op5_chat_template, op7_html_density, op8_exact_topk
from loomtext.sources import stored

SF = "/root/testdata/sf0.001"


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a: b", ""]), st.text("\\#<:/turn> aż\n", max_size=30)), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_chat_round_trip(turns):
    out = chat.compile_template(chat.DEFAULT_TEMPLATE)([{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(out.text) == turns
    assert "".join(chat.unescape(out.text[a:b]) for a, b in out.loss) == "".join(t for r, t in turns if r == "assistant")


def test_template_language():
    render = chat.compile_template("{% set x = 'a' ~ 'b' %}{% for m in messages %}{% if loop.first and not false %}{{ x }}{% elif 1 == 2 %}never{% else %}{{ m['text'] | upper }}{% endif %}{% endfor %}")
    assert render([{"text": "q"}, {"text": "r"}]).text == "abR"
    assert chat.fold(chat.parse("a{{ 'b' | upper }}c{% if 1 == 1 %}d{% endif %}")) == ("block", ("text", "aBcd"))
    assert chat.compile_template("{{ messages.__class__ }}")([]).text == ""
    for bad in ("{% for x %}", "{{ a | nope }}", "{% if x %}", "{{ 1 + }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_conversation_digests(spark):
    got = {r.conv_id: r for r in op5_chat_template(spark, SF).collect()}
    rows = table(spark, SF, "conversations").orderBy("conv_id", "turn").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    by[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert set(got) == set(by)
    for i, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[i].n_turns, got[i].loss_chars, got[i].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_conversation_edges(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "x"), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert got == {1: 3, None: 1} and chat.format_conversations(rows.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- note --><div class="ad">Buy now</div>
<aside>More stories that are quite long and would win by length alone, were they not beside the article itself.</aside>
<article><h1>Head &amp; title</h1><p>First <b>bold</b>
 paragraph&nbsp;here.<br>Next line <a href=x>link</a><p>Second &lt;one&gt;<form><input>Sign up</form><ul><li>x<li>y</ul></article>
<section id="comments"><p>A reader's comment</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & title\nFirst bold paragraph here.\nNext line link\nSecond <one>\nx\ny"


def test_main_text_without_article_tags():
    links = "".join(f'<li><a href="{i}">link {i}</a></li>' for i in range(20))
    prose = "".join(f"<p>{'Prose of the page goes on and on here. ' * 5}</p>" for _ in range(4))
    text = html.main_text(f"<body><div><ul>{links}</ul></div><div><div>{prose}</div></div></body>")
    assert text.count("\n") == 3 and "link" not in text


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="Hidden gems"', 'data-url="/hidden-x"', 'data-href="?id=related"', 'data-grid="ads"', "data-x='class=menu' lang=en", 'class="text" class="menu"', "title='hidden", "title=a=hidden"])
def test_values_and_longer_names_do_not_cut(attributes):
    assert html.main_text(f"<body><div><p>One text</p><div {attributes}><p>Other text</p></div></div></body>") == "One text\nOther text"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "lang=en hidden", 'aria-hidden="true"', "aria-hidden=TRUE", 'class="x menu"', "id=related", 'role = "navigation"', "title='x'class=ads"])
def test_hidden_and_unwanted_elements_are_cut(attributes):
    assert html.main_text(f"<body><div><p>One text</p><div {attributes}><p>Other text</p></div></div></body>") == "One text"


@pytest.mark.parametrize("tag", ["html", "body", "article", "main"])
def test_no_attribute_cuts_the_page(tag):
    for attributes in ('style="overflow-x:hidden"', "hidden", 'aria-hidden="true"', 'class="menu"'):
        assert html.main_text(f"<{tag} {attributes}><p>Text of the page</p></{tag}>") == "Text of the page"


def test_page_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "<<<>>>"), (5, "<p>a" * 3000), (6, "<a" * 5000), (7, "<!-- open"), (8, PAGE), (9, PAGE)], "page_id long, html string")
    got = {r.page_id: r.text for r in html.extract_pages(rows).collect()}
    assert got[1] == got[2] == "" and got[3] == "plain" and got[5].count("\n") == 2999 and got[8] == got[9] and len(got) == 9
    assert html.extract_pages(rows.where("false")).count() == 0


def test_every_page_has_text(spark):
    assert op7_html_density(spark, SF).where("n_chars = 0 or n_chars <> length(text)").count() == 0


LONG = "<p>" + "A long answer of a reader that goes on and on. " * 40 + "</p>"
ARTICLE = "<article><h1>Title</h1><p>First text of the article.</p><p>Second text.</p></article>"
SHORT = "<p>Nice.</p>"


@pytest.mark.parametrize("beside", [
    f'<section class="comments"><article class="comment">{LONG}</article></section>', f'<section id="reader-responses"><article>{LONG}</article><article>{LONG}</article></section>', f'<div class="comments"><h1>Comments</h1>{LONG}</div>',
    f'<ol class="commentlist"><li>{LONG}</li></ol>', f'<div class="discussion">{LONG}</div>', f'<div id="respond">{LONG}</div>', f'<div class="dropdown">{SHORT}</div>', f'<div role=alert>{LONG}</div>', f'<div class="gdpr-bar">{LONG}</div>',
    f'<div class="cta">{LONG}</div>', f'<section class="recommended">{LONG}</section>', f'<div class="author-bio">{LONG}</div>', '<p class="share-count">12 shares</p>', '<p><span class="share-links">Mail</span></p>', f'<div class="thread">{LONG}</div>',
    f'<div class=x><article class=y><header>Ann <time>1 May</time></header>{LONG}</article><article class=y><header>Bob <time>2 May</time></header>{LONG}</article></div>', f'<div id="comments-42"><ul><li class="comment2">{LONG}</li></ul></div>',
    f'<div itemprop="comment">{LONG}</div>', f'<section id="replies"><article>{LONG}<article>{SHORT}</article></article></section>',
])
def test_what_readers_write_is_cut(beside):
    expected = "Title\nFirst text of the article.\nSecond text."
    assert html.main_text(f"<body><div>{ARTICLE}{beside}</div></body>") == expected
    assert html.main_text(f"<body><main>{ARTICLE}</main>{beside}</body>") == expected
    inside = ARTICLE.replace("</article>", beside + "</article>")
    if not any(x in beside for x in ("discussion", "thread", "class=x", "responses")):
        assert html.main_text(f"<body>{inside}</body>") == expected


@pytest.mark.parametrize(("page", "text"), [
    ("<body><div class='comments'><article><h1>T</h1><p>Only article here.</p></article></div></body>", "T\nOnly article here."), ("<body><article><h1>T</h1><section class='discussion'><p>Part of the paper.</p></section></article></body>", "T\nPart of the paper."),
    ("<body><div class='commentary'><p>An essay.</p></div></body>", "An essay."), ("<body><div class='has-comments'><p>Text here.</p></div></body>", "Text here."), ("<body><article><p>One.</p><article><p>Quoted.</p></article></article></body>", "One.\nQuoted."),
    ("<body><div><article><time>1</time><p>Post one of the blog.</p></article><article><time>2</time><p>Post two of the blog.</p></article></div></body>", "1\nPost one of the blog.\n2\nPost two of the blog."),
])
def test_what_only_looks_like_comments_stays(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("unit", ["<b></i>", "<b>", "</b>", "</div>", "<p><b>", "<li><x>", "<x><li></li>", "<td><tr>", "</body>", "<header></header>", "<div><time></time>", "<article><time>", "<x></b>"])
def test_pages_cost_time_in_proportion(unit):
    began = time.time()
    html.main_text("<body><p>text</p>" + "<x>" * 20_000 + unit * (400_000 // len(unit)))
    assert time.time() - began < 12


def brute_top(rows, queries, k):
    ok = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q in ok:
            best = sorted((-int(np.dot(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(frame, lambda i: i % 50 == 0).collect()}
    assert got == brute_top(rows, range(0, 450, 50), 5)
    assert topk.top_k(frame.where("vec_id < 3"), lambda i: i % 50 == 0).count() == 2 and topk.top_k(frame.where("false"), lambda i: i % 50 == 0).count() == 0


def test_top_k_of_dimensions_of_different_ranges():
    index = topk.ImpactIndex(np.array([1, 2, 3]), np.array([[250, 0], [100, 20], [24, 0]]))
    assert index.top(np.array([0]), np.array([[1, 10]]), 1) == [(0, 2, 300)]
    rng = np.random.default_rng(1)
    for n, k in ((700, 5), (60, 1)):
        span = np.r_[rng.integers(1, 24, 24), rng.integers(24, 300, 8)]
        vectors = rng.integers(-span, span + 1, (n, len(span)))
        queries = rng.integers(-200, 201, (20, len(span)))
        for block in (vectors, np.where(np.arange(len(span)) % 3 == 0, vectors * 50, vectors // 8)):
            got = topk.ImpactIndex(np.arange(n), block).top(np.arange(n, n + 20), queries, k)
            scores = queries @ block.T
            assert sorted(got) == sorted((n + q, int(i), int(scores[q, i])) for q in range(20) for i in np.lexsort((np.arange(n), -scores[q]))[:k])


def test_a_repeated_query_id_asks_with_its_smallest_vector(spark):
    rng = np.random.default_rng(9)
    others = [(k, rng.normal(0, 1, 4).round(2).tolist()) for k in range(1, 40)]
    twice = [(50, [0.5, 2.0, 0.0, 0.0]), (50, [0.5, -2.0, 0.0, 0.0]), (50, [3.0, 0.0, 0.0, 0.0])]
    expected = brute_top([*others, twice[1]], [50], 5)
    for rows in ([*others, *twice], [*twice[::-1], *others], [twice[2], *others, twice[0], twice[1]]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
        assert {tuple(r) for r in topk.top_k(frame, lambda i: i == 50).collect()} == expected


def test_top_k_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert {tuple(r) for r in op8_exact_topk(spark, SF).collect()} == brute_top(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored.written(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.agg({"n_docs": "sum"}).first()[0] >= n


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in quality.classify(docs, table(spark, SF, "labels")).collect()}
    good = stage("quality")(spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {k for k, x in scores.items() if x >= 0.7}

    sets = {k: five(r.text) for k, r in rows.items()}
    up = {k: k for k in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if j < i and up[i] != up[j] and (both := len(sets[i] & sets[j])) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((up[i], up[j]))
                up = {k: low if x == high else x for k, x in up.items()}
    assert sorted(r.doc_id for r in stage("near_duplicates")(spark, docs, SF).collect()) == sorted(k for k, x in up.items() if k == x)

    found = {r.doc_id for r in decontaminate.contaminated(docs, table(spark, SF, "benchmark")).collect()}
    clean = stage("decontamination")(spark, docs, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(rows) - found)

    mixed = stored.written(stage("mixing")(spark, docs, SF))
    order = [r.doc_id for r in mixing.mix_sources(docs).orderBy("mix.order").collect()]
    got = [r.doc_id for r in materialise.in_file_order(mixed).orderBy("file", "row").collect()]
    assert got == order

    tokens = stage("tokens")(spark, mixed, SF).orderBy("sequence").toPandas()
    tok = materialise.Tokenizer(materialise.read_vocabulary(materialise.DEFAULT_VOCABULARY))
    ids = np.concatenate([np.frombuffer(x, tok.dtype)[:n] for x, n in zip(tokens.tokens, tokens.n_tokens, strict=True)])
    assert ids.tobytes() == b"".join(tok.encode(rows[k].text or "") + np.array([tok.end], tok.dtype).tobytes() for k in order)


def test_each_window_of_the_tokens_keeps_the_mix(spark, monkeypatch):
    """Of a hot source and two small ones, every window of slots has the shares of the
    mix for as long as no source has run out."""
    rows = [(k, f"{s} " + f"word{k} " * 200, s) for k, s in enumerate(["hot"] * 1600 + ["b"] * 100 + ["c"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = stored.written(stage("mixing")(spark, docs, SF))
    monkeypatch.setattr(corpus_pipeline, "WINDOW", 256)
    out = stage("tokens")(spark, mixed, SF).toPandas()
    of = {k: s for k, _, s in rows}
    weights = {r.source: r.weight for r in mixing.target_weights(spark.createDataFrame([("hot", 1600), ("b", 100), ("c", 100)], "source string, n long")).collect()}
    whole = min(n * sum(weights.values()) // weights[s] for s, n in (("hot", 1600), ("b", 100), ("c", 100)))
    sources = out.assign(window=out.slot // 256, source=out.first_doc_id.map(of)).groupby("window").source.value_counts(normalize=True)
    windows = int(whole * len(out) / len(rows)) // 256
    assert windows >= 2
    for w in range(windows):
        assert all(abs(sources[w].get(s, 0) - x / sum(weights.values())) < 0.2 for s, x in weights.items())


def test_stages_on_odd_tables(spark, tmp_path):
    odd = [(1, None), (2, ""), (3, "one"), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (4, "a b c d e f g h"), (4, "other words of the same id here now"), (5, "x" * 60_000), (6, "word " * 20_000), (6, "word " * 20_000)]
    frame = spark.createDataFrame([(i, t, None if k % 3 else "s", "extra", 0.5, 1) for k, (i, t) in enumerate(odd)], "doc_id long, text string, source string, score string, mix double, _class int")
    for name, run in corpus_pipeline.STAGES:
        for docs in (frame, frame.where("false")):
            path = str(tmp_path / f"{name}{docs is frame}")
            docs.write.parquet(path)
            got = run(spark, spark.read.schema(docs.schema).parquet(path), SF)
            rows = got.collect()
            assert (docs is frame) or not rows
            if name != "tokens":
                assert got.columns == frame.columns
    kept = corpus_pipeline.near_duplicate_stage(spark, frame, SF).collect()
    texts = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in kept)
    assert texts == [(False, 1, 0), (False, 2, 0), (False, 3, 3), (False, 4, 15), (False, 4, 35), (False, 5, 60_000), (False, 6, 100_000)]
    assert corpus_pipeline.mixing_stage(spark, frame, SF).count() == len(odd)


NOISE = [
    "<nav><ul><li><a href=/a>{0}</a><li><a href=/b>{0}</a></ul></nav>", "<div class='ad'>{0}</div>", "<div id=sidebar><p>{0}</p></div>", "<aside><p>{0}</aside>",
    "<div class='cookie-notice'>{0}</div>", "<p class=notice>{0}", "<form><label>{0}</label><input name=q></form>", "<script>if (a < b) {{ '{0}' }}</script>", "<style>p {{ {0} }}</style>",
    "<div class='x-{1}'><ul><li><a href=/c>{0}</a></li><li><a href=/d>{0}</a></li></ul></div>", "<svg class='i'/>", "<select><option>{0}<option>{0}</select>", "<!-- {0} -->", "<div hidden>{0}</div>", "<div role=search>{0}</div>",
]
LAST = ["<section class=comments><p>{0}</p><p>{0}</p></section>", "<footer><p>&copy; {0}</p></footer>", "<div class='share-bar'><span>{0}</span></div>"]
NAMES = ["", " id=social-impact", " id=related-work", " style='overflow:hidden'", " aria-hidden=false", " data-id=related", " class='lead search'", " title='Hidden gems'"]


def generated_page(rng: random.Random) -> tuple[str, str]:
    """A page and, written beside it, the blocks of its article."""
    words = lambda low, high: " ".join("".join(rng.choices("abcdeiourst", k=rng.randint(2, 8))) for _ in range(rng.randint(low, high)))
    noise = lambda kinds: rng.choice(kinds).format(words(3, 12), rng.randint(0, 99))
    blocks, body = [words(3, 8)], []
    title = f"<h1{rng.choice(NAMES)}>{blocks[0]}</h1>"
    own = rng.random() < 0.3  # a header of the article, not of the page
    body.append(f"<header>{title}</header>" if own else title)
    for _ in range(rng.randint(3, 12)):
        kind, one, two = rng.random(), words(25, 60), words(25, 60)
        if kind < 0.5:
            blocks.append(f"{one} & bold {two}")
            body.append(f"<p{rng.choice(NAMES)}>{one} &amp; <b>bold</b>\n  {two}" + rng.choice(["</p>", "", " "]))
        elif kind < 0.65:
            blocks.append(short := words(2, 5))
            body.append(f"<h2{rng.choice(NAMES)}>{short}</h2>")
        elif kind < 0.75:
            blocks += [one, two]
            body.append(f"<ul><li>{one}<li>{two}</ul>")
        elif kind < 0.85:
            blocks += [one, two]
            body.append(f"<p>{one}<br>{two}</p>")
        else:
            body.append(noise(NOISE[:9] + NOISE[10:]))
    inner = "\n".join(body)
    around = rng.choice(["<article>{}</article>", "<div class='page-with-comments'><article>{}</article></div>", "<main><div>{}</div></main>", "<div class='has-sidebar'><div class='b{}'>".replace("{}", "7") + "{}</div></div>"][: 3 if own else 4])
    page = "<!DOCTYPE html><html><head><title>" + words(2, 4) + "</title></head><body>" + "".join(noise(NOISE) for _ in range(rng.randint(0, 4))) + around.format(inner) + "".join(noise(LAST + NOISE) for _ in range(rng.randint(0, 4))) + rng.choice(["</body></html>", ""])
    return page, "\n".join(blocks)


def test_main_text_of_generated_pages():
    rng = random.Random(7)
    pages = [generated_page(rng) for _ in range(500)]
    assert [html.main_text(p) for p, _ in pages] == [t for _, t in pages]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h2 id='social-impact'>A b</h2><p>One.</p><h2 id='related-work'>C</h2><p class='lead search'>Two.</p></article>", "A b\nOne.\nC\nTwo."),
        ("<div><svg class='i'/><p>Text after it.</p></div>", "Text after it."),
        ("<body><p class='notice'>Note.<p>The text that stays.", "The text that stays."),
        ("<article><header><h1>Title</h1></header><p>Text of it.</p></article>", "Title\nText of it."),
        ("<article><h1>A</h1><p>First of two articles here.</p></article><article><h1>B</h1><p>Second of two articles here.</p></article>", "A\nFirst of two articles here.\nB\nSecond of two articles here."),
        ("<div class='main-content-with-sidebar'><p>One text of it.</p></div><div class='main-sidebar'><p>Two</p></div>", "One text of it."),
        ("<div class='story'><div class='entry-header'><h2>Title</h2></div><p>Text of it.</p></div><div class='site-header'><p>Site</p></div>", "Title\nText of it."),
        ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
    ],
)
def test_what_is_no_boilerplate_stays(page, text):
    assert html.main_text(page) == text


def test_very_long_page_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {i} of a very long page.</p>" for i in range(30_000)) + "</article>"
    rows = spark.createDataFrame([(1, long, "old", 5), (2, "<p>b", None, None)], "page_id long, html string, text string, n_chars int")
    got = {r.page_id: r for r in html.extract_pages(rows).collect()}
    assert got[1].text.count("\n") == 29_999 and got[1].n_chars == len(got[1].text) and (got[2].text, got[2].n_chars) == ("b", 1)
