import random
import time

from pyspark.sql import functions as F

from statloom.llm import html_extract as h

PAGE = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href="/x">Menu one</a></li></ul></nav><div class="ad">Buy now today</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>word&nbsp;here.<p>Second   para</p><aside>Also read this</aside><p>Third &lt;x&gt;.</p></article><section class="comments"><p>Great post!</p></section><footer>&copy; me</footer></body></html>'
WANT = "Head & line First boldword here. Second para Third <x>."


def weights(pages):
    total = sum(map(h.counts, pages), h.Counter())
    keys = {(k, key) for k, key, _ in total}
    return h.Weights([(k, key, float(total[k, key, True]), float(total[k, key, False])) for k, key in sorted(keys)])


def test_article_without_boilerplate():
    w = weights([PAGE] * 20)
    assert h.extract(PAGE, w) == WANT
    assert h.extract(PAGE[: PAGE.index("<p>Third")] + "<p>Third &am", w) == "Head & line First boldword here. Second para Third &am"


def test_defined_results():
    w = weights([PAGE] * 20)
    assert [h.extract(x, w) for x in (None, "", "<nav>a b</nav>", "<", "<p", "&amp;")][:3] == ["", "", ""]
    assert h.extract("<form>name<input></form><p>Some plain words of text here and more</p>", w) == "Some plain words of text here and more"


def test_extract_is_the_best_of_all_regions():
    w, rng, chosen = weights([PAGE] * 20), random.Random(8), 0
    for _ in range(150):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "<article>", "</article>", "<b>", "<br>", "words here ", "one ", "a b c d "]) for _ in range(rng.randint(0, 25)))
        own = h.items(page, w)
        regions = {(i, j): sum(score for score, _, _ in own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
        top = max(regions.values(), default=0)
        texts = {" ".join("".join(s for _, x, s in own[i:j] if x is None or x > 0).split()) for (i, j), v in regions.items() if v > top - 1e-9} if top > 1e-9 else {""}
        assert h.extract(page, w) in texts
        chosen += top > 0
    assert chosen > 50


def test_ties_go_to_the_first_and_shortest():
    assert h.best_region([1.0, -1.0, 1.0]) == (0, 1) and h.best_region([0.0, 2.0, 0.0]) == (1, 2) and h.best_region([-1.0]) == (0, 0)


def test_deep_pages_take_linear_time():
    w = weights([PAGE] * 20)
    for page in ("<b>" * 300_000 + "word", "<div class=a><p>x" * 60_000, "<i>" * 100_000 + "</u>" * 100_000 + "</i>" * 100_000):
        began = time.process_time()
        h.extract(page, w)
        h.counts(page)
        assert time.process_time() - began < 20


LEAD = "<html><body><nav><ul>" + "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(6)) + "</ul></nav>"
TAIL = '<div class="ad">Buy now today</div><footer>All rights reserved</footer></body></html>'
SITE = [LEAD + f"<article><h1>Title {i}</h1><p>First words of page {i} stand here.</p><p>And more of them follow in this one.</p></article>" + TAIL for i in range(60)]
RICH = "<h1>Head</h1><p>See <a href='/a'>the first link</a> here.</p><p>And <a href='/b'>the second link</a> there.</p><ul><li>Point one of the list</li><li>Point two of the list</li></ul><blockquote>A quote</blockquote><table><tr><td>cell one</td><td>cell two</td></tr></table><p>The last paragraph closes it.</p>"
RICH_TEXT = "Head See the first link here. And the second link there. Point one of the list Point two of the list A quote cell one cell two The last paragraph closes it."


def test_learned_weights_keep_links_lists_tables_and_tails(spark):
    """Menus are the only lists and links that the site's pages have."""
    pages = spark.createDataFrame(list(enumerate(SITE)), "page_id long, html string")
    w = h.Weights(h.learn(pages))
    assert h.extract(SITE[7], w) == "Title 7 First words of page 7 stand here. And more of them follow in this one."
    assert h.extract(f"{LEAD}<article>{RICH}</article>{TAIL}", w) == RICH_TEXT
    assert h.extract(f"{LEAD}<div>{RICH}</div>{TAIL}", w) == RICH_TEXT  # no element of content at all
    assert h.extract(f"{LEAD}<div id=post>{RICH}</div><div class=sidebar><p>Not this one, please.</p></div>{TAIL}", w) == RICH_TEXT
    assert h.extract(f"{LEAD}<div class=sidebar><p>Short note.</p></div><main>{RICH}</main>{TAIL}", w) == RICH_TEXT
    assert h.extract(f"{LEAD}<article><header><h1>Head</h1></header><p>Body text stands here.</p><footer>Filed under x</footer></article>{TAIL}", w) == "Head Body text stands here."
    inner = "<aside>Also read this</aside><form>Your mail <input></form><div class='share'>Share it</div><section class='comments'><article>Great post!</article></section>"
    assert h.extract(f"{LEAD}<article><p>Some words before it.</p>{inner}<p>Some words after it.</p></article>{TAIL}", w) == "Some words before it. Some words after it."


def test_labels_outweigh_names(spark):
    """Articles whose text stands in a boilerplate-named element are read as what they are."""
    pages = spark.createDataFrame([(i, f"{LEAD}<article><div class=\"share\"><p>Words of article {i} that everybody reads.</p></div></article>{TAIL}") for i in range(60)], "page_id long, html string")
    w = h.Weights(h.learn(pages))
    assert w.of("div.share") > 0 and w.of("article") > 0 > w.of("nav")
    assert h.extract(pages.first().html, w) == "Words of article 0 that everybody reads."
    wrapped = [f"{LEAD}<div class='widget'><article><p>Words of article {i} that everybody reads.</p></article></div>{TAIL}" for i in range(60)]
    w = weights(wrapped)
    assert h.extract(wrapped[3], w) == "Words of article 3 that everybody reads."
    apart = [f"{LEAD}<article><p>Words of article {i} that everybody reads.</p></article><section class='comments'><article><p>I was first here.</p></article></section>{TAIL}" for i in range(60)]
    w = weights(apart)
    assert w.of("section.comments") < 0 and h.extract(apart[3], w) == "Words of article 3 that everybody reads."


def test_counts_in_context():
    got = h.counts('<body class=page><div class="sidebar"><p>junk words</p></div><article><p>one two three four</p><ul><li>five</li></ul><div class="related"><p>six seven</p></div></article></body>')
    assert got["word", "body.page", True] == 0 and got["word", "div.page", True] == 5 and got["word", "div.page", False] == 0  # the wrapper of an article
    assert got["word", "p@article", True] == 4 and got["word", "p@div.related", False] == 2 and got["word", "li@article", True] == 1
    assert got["word", "div.related", True] == 0 and got["word", "div.sidebar", False] == 2
    assert got["tag", "li@article", True] == 2 and ("word", "li", True) not in got
    w = h.Weights([("word", "x.y", 30.0, 3.0), ("word", "p@nav", 0.0, 9.0), ("tag", "p@nav", 1.0, 2.0)])
    assert abs(w.of("x.y") - h.math.log(32 / 4)) < 1e-12 and abs(w.of("p@nav") - h.math.log(1 / 10)) < 1e-12 and w.of("p@other") is None
    assert w.of_tag("p", "nav") == -0.1 - 2 / 4 and w.of_tag("b", "nav") == h.UNSEEN_INLINE and w.of_tag("p", "") == h.UNSEEN_BLOCK


def test_sample_is_of_labelled_pages(spark):
    plain = [(i, f"<p>plain page {i}</p>") for i in range(300)]
    pages = spark.createDataFrame(plain + [(1000 + i, PAGE) for i in range(5)], "page_id long, html string")
    rows = h.learn(pages, sample=50)
    assert sum(a + b for kind, key, a, b in rows if (kind, key) == ("tag", "article@article")) == 5
    assert not any("plain" in r[1] for r in rows)


def test_table(spark):
    pages = spark.createDataFrame([(i, "u", PAGE, "z") for i in range(8)] + [(9, None, None, "z"), (9, None, None, "z")], "page_id long, url string, html string, n_chars string")
    got = h.main_text(pages, h.learn(pages)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(i, WANT, len(WANT)) for i in range(8)] + [(9, "", 0)] * 2
    assert h.learn(pages.limit(0)) == [] and h.main_text(pages.limit(0), []).count() == 0
