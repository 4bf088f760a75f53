"""Cases that earlier versions left out."""

import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest

from cairnspark.llm import html_extraction, quote_linking, toxicity

PLAIN = "the quiet river ran past houses and people walked there in summer shade worth most stews".split()


@pytest.fixture(scope="module")
def toxicity_model(spark):
    """A model from texts that spell every term right: 60 toxic ones and 300 others."""
    terms = ["worthless", "disgusting", "stupid", "trash", "scum"]
    texts = [(i, " ".join(PLAIN[(i * 5 + k * k) % len(PLAIN)] for k in range(12))) for i in range(360)]
    docs = spark.createDataFrame([(i, f"{t} you {terms[i // 6 % 5] if i % 6 == 0 else 'good'} man") for i, t in texts], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in texts], "doc_id bigint, toxic int")
    return toxicity.fit(docs, labels)


def test_toxicity_counts_spellings_never_seen(toxicity_model):
    said = ["so worthles it was", "quite disgustng", "a stuppid plan", "you worthles disgustng stuppid man"]
    assert (toxicity_model.score(said) >= 0.7).all()
    assert (toxicity_model.score(["the quiet river", "people walked in summer shade", ""]) < 0.3).all()


def test_toxicity_lets_labels_decide_on_spellings_seen():
    seen = {(2, ""): [0.0, 50.0], (1, "stupor"): [40.0, 0.0], (1, "stupif"): [0.0, 9.0]}
    weight, known = toxicity.weights(["stupid"], seen, 60, 300)
    assert 0.8 * weight[2] < weight[1] < weight[2] and known[1, "stupor"] < 0.05 * weight[2] < weight[1] / 2 < known[1, "stupif"]


def test_toxicity_of_short_and_masked_words(toxicity_model):
    said = ["just trsh", "real scvm here", "a stup1d plan", "a st*pid plan", "w0rthless", "tr@sh", "so disgu$ting", "you idea_stup!d"]
    assert (toxicity_model.score(said) >= 0.7).all()
    assert (toxicity_model.score(["st**id", "a1b2c3", "1234 the qu1et r*ver", "the_quiet_river"]) < 0.3).all()


def test_toxic_stems_of_any_length(spark):
    """Stems beyond the letters that are tried one by one: a word of 20 letters, and one that three long words begin with."""
    ends = ["", "ernde", "erisch", "t"]
    texts = [(i, f"{PLAIN[i % len(PLAIN)]} {'you volksverhetzerischer' if i % 6 == 0 else ''} {'abgrundtiefhassend' + ends[i // 6 % 4] if i % 6 == 1 else ''}") for i in range(360)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 6 < 2)) for i, _ in texts], "doc_id bigint, toxic int"))
    assert {"volksverhetzerischer", "abgrundtiefhassend"} <= {*model.automaton.terms}
    assert (model.score(["volksverhetzerischer", "volksverhetzerischre", "abgrundtiefhassenddd", "abgrundtiefhasend"]) >= 0.7).all()
    assert (model.score(["volksverein", "abgrundtief", "x" * 1_000_000]) < 0.3).all()


def test_no_cap_on_terms_or_hits(toxicity_model):
    assert not [n for n in vars(toxicity) if n.startswith("MOST_") or n == "LONGEST"]
    few, many = ("you stupid man " * n for n in (40, 1000))
    x = [toxicity._inputs([t], toxicity_model.automaton, toxicity_model.weight, toxicity_model.known)[0, 2] for t in (few, many)]
    assert x[0] < x[1]


def test_toxic_terms_of_three_letters(spark):
    texts = [(i, f"{PLAIN[i % len(PLAIN)]} walked {'fyx' if i % 6 == 0 else ''}") for i in range(360)]
    docs, labels = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in texts], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score(["fyx"])[0] >= 0.7 > 0.3 > model.score(["fix"])[0]


@pytest.mark.parametrize("most", [0, 500_000])
def test_pages_lose_what_recurs_inside_articles(spark, monkeypatch, most):
    monkeypatch.setattr(html_extraction, "MOST_BROADCAST", most)
    note = "<div>Read our daily letter</div><table><tr><td>Ask</td><td>us</td></tr></table>"
    own = "<p>Story number {0} tells of {0} things</p><table><tr><td>Name</td></tr><tr><td>n{0}</td></tr></table>"
    pages = [(i, f"http://h.example/{i}", f"<body><article><h1>Title {i}</h1>{own.format(i)}{'<p>A saying</p>' if i < 6 else ''}{note}<p>By the desk</p></article></body>") for i in range(20)]
    # copies of one text in other furniture are one text, not a template
    pages += [(i, f"http://copy.example/{i}", f"<body><nav>{i}</nav><article><p>The only story</p></article></body>") for i in range(30, 40)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i in range(20):
        assert got[i].split("\n") == [f"Title {i}", f"Story number {i} tells of {i} things", "Name", f"n{i}"] + ["A saying"] * (i < 6)
    assert {got[i] for i in range(30, 40)} == {"The only story"}


def said(page):
    return html_extraction.blocks(page)[0]


@pytest.mark.parametrize("name", ["ad-hoc", "notice-of-death", "comments-on-law", "advert-history", "banner-year", "x pager-story-of-1990"])
def test_names_that_hold_other_words_stay(name):
    assert said(f"<body><article><p>One</p><p class='{name}'>Two</p><section class='{name}'>Three</section></article></body>") == ["One", "Two", "Three"]


@pytest.mark.parametrize("name", ["ad", "ad-slot", "ad-300x250", "left sidebar-right", "comment-list", "newsletter-signup", "cookie-notice", "ad_box_top", "reader-comments", "Advert"])
def test_names_of_furniture_inside_an_article_go(name):
    assert said(f"<body><article><p>One of the story's words</p><div class='{name}'>Two</div></article></body>") == ["One of the story's words"]


def test_links_under_a_partial_name_go():
    assert said("<body><article><p>One</p><div class='related-reading'><a href=x>More</a> <a href=y>of it</a></div></article></body>") == ["One"]


def test_teasers_are_not_the_story():
    story = "".join(f"<p>Paragraph {i} of the long story goes on and on.</p>" for i in range(6))
    teasers = "<article><p>Teaser one</p></article><article><p>Teaser two</p></article>"
    whole = [f"Paragraph {i} of the long story goes on and on." for i in range(6)]
    assert said(f"<body><h1>Head</h1><div id=content><div>{story}</div></div><div>{teasers}</div></body>") == ["Head", *whole]
    assert said(f"<body><div id=content><h1>Head</h1>{story}</div><div>{teasers}</div></body>") == ["Head", *whole]
    # several articles that hold most of the text are the text, and so is a single one
    assert said(f"<body><p>Short</p><article>{story}</article><article><p>Next</p></article></body>") == [*whole, "Next"]
    assert said(f"<body><div>{story}</div><article><p>Only</p></article></body>") == ["Only"]
    deep = "<div>" * 20_000 + story + teasers
    assert said(f"<body>{deep}</body>")[:6] == whole


@pytest.mark.parametrize("attribute", ["id='page' class='has-sidebar'", "class=with-menu", "class='no-comments'", "class='page has-header'"])
def test_names_of_furniture_do_not_cut_the_article(attribute):
    rest = "<div class=sidebar>Links</div><div id=comments><article>Reader</article></div>"
    assert said(f"<body><div {attribute}><article><p>Story text</p></article>{rest}</div></body>") == ["Story text"]
    assert said(f"<body><div {attribute}><p>Story text of some length</p></div><p>Short</p></body>") == ["Story text of some length", "Short"]
    assert said(f"<body><article><h1>Head</h1><div {attribute}><p>Story text</p></div></article></body>")[0] == "Head"


def test_furniture_still_goes_beside_an_article():
    page = "<body><div class=ad>An advert much longer than the story</div><article>Tale<section id=comments><p>Readers say a lot more here</p></section></article></body>"
    assert said(page) == ["Tale"]


def test_pages_with_an_open_head():
    assert said("<html><head><title>T</title><body><p>Text</p></body></html>") == ["Text"]
    assert said("<head><meta charset=utf-8><script>x</script><p>Text") == ["Text"]
    assert said("<head><style>p{}</style></head><body>Text") == ["Text"]


def test_all_articles_and_the_headline_stay():
    assert said("<body><h1>Head</h1><article>One, the longest</article><article>Two</article></body>") == ["Head", "One, the longest", "Two"]
    assert said("<body><p>x</p><main><h1>Head</h1><p>Lead</p><article>One</article></main></body>") == ["Head", "Lead", "One"]


def test_conversations_in_reply_order(spark):
    talk = [(1, 0, "user", "First question"), (1, 1, "user", "Second question"), (1, 2, "assistant", "> First question\nAn answer"), (1, 3, None, "> Second question\nAnother"), (2, 0, "user", "> First question\nelse")]
    got = quote_linking.conversations(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(r["conv_id"], r["turn"], r["reply_to"]) for r in got] == [(1, 0, None), (1, 2, 0), (1, 1, None), (1, 3, 1), (2, 0, None)]
    assert [r["formatted"] for r in got[1:4]] == ["<|user|>\nSecond question\n" if r["turn"] == 1 else f"<|{r['role'] or 'unknown'}|>\n{r['text']}\n" for r in got[1:4]]
    assert got[1]["formatted"] == "<|assistant|>\nAn answer\n"


LONG_PAGES = {
    "open tags": "<a " * 350_000, "deep": "<div>" * 100_000 + "x" + "</div>" * 100_000, "deep text": "<div>x" * 20_000, "open quotes": "<a b='" * 100_000,
    "inline": "<b>" * 50_000 + "<p>y" * 20_000, "closing": "<b>" * 1000 + "<li>" + "<i>" * 50_000 + "</b></u>" * 50_000, "comments": "<!" * 300_000, "names": "<p " + "a" * 500_000 + " x>z",
    "spaces": "<p a" + " " * 500_000 + ">z", "equals": "<p " + "a=" * 300_000 + ">z", "entities": "&amp" * 250_000,
}


@pytest.mark.parametrize("name", LONG_PAGES)
def test_long_broken_pages_take_time_and_memory_in_proportion(name):
    tracemalloc.start()
    start = time.time()
    made, marks = html_extraction.blocks(LONG_PAGES[name])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - start < 40 and peak < 400e6
    if name == "deep":
        assert made == ["x"] and len(marks) == 100_000 and {m[1:] for m in marks} == {(0, 1)}
    if name == "deep text":
        assert made == ["x"] * 20_000 and sorted({m[1:] for m in marks}) == [(i, 20_000) for i in range(20_000)]
    if name == "inline":
        assert made == ["y"] * 20_000


def test_broken_tags_end_at_the_next_one():
    assert said("<p <b>bold</b> text<p class='a<b'>more</p>") == ["bold text", "more"]
    assert said("<p title=it's>one</p><p>it's two</p>") == ["one", "it's two"]
    assert said("<table><tr><td>a<td>b<tr><td>c</table>") == ["a b", "c"]


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_templates_go_by_counts_alone(spark, monkeypatch, most):
    """A host whose furniture bears no name that tells: only the counts can show it."""
    monkeypatch.setattr(html_extraction, "MOST_BROADCAST", most)
    r = random.Random(7)
    top = "<div class=k1><ul><li><a href=/a>Start</a></li><li><a href=/b>About</a></li></ul></div><div class=k2><table><tr><td>Tel 12</td><td>Mail</td></tr></table></div>"
    end = "<div class=k3><p>All rights with us</p><div>Read <i>our</i> daily letter</div></div>"
    story = {i: [" ".join(r.choice("red green blue black white".split()) + str(r.randint(0, 99)) for _ in range(12)) for _ in range(3)] for i in range(30)}
    bare = [(i, f"http://bare.example/{i}", f"<body>{top}<div class=k4>{''.join(f'<p>{t}</p>' for t in story[i])}</div>{end}</body>") for i in range(30)]
    framed = [(100 + i, f"http://framed.example/{i}", f"<body>{top}<article>{''.join(f'<p>{t}</p>' for t in story[i])}{end}</article><div>{i}</div></body>") for i in range(30)]
    alone = [(200, "http://alone.example/", f"<body>{top}<div class=k4><p>My own words</p></div></body>")]
    pages = spark.createDataFrame([(*p, 1, "h") for p in bare + framed + alone], "page_id bigint, url string, html string, gone int, host string").repartition(5)
    got = {r["page_id"]: r for r in html_extraction.extract(pages).collect()}
    for i in range(30):
        assert got[i]["text"] == "\n".join(story[i]) == got[100 + i]["text"]
        assert got[i]["n_templates"] > 5 and got[100 + i]["n_templates"] > 5
    assert got[200]["text"] == "Start\nAbout\nTel 12 Mail\nMy own words" and got[200]["n_templates"] == 0
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_counts_match_brute_force(spark):
    r = random.Random(11)
    pieces = [f"<div><p>part {i}</p><p>more {i % 3}</p></div>" for i in range(6)]
    pages = []
    for i in range(120):
        host = r.choice("abc")
        own = [r.choice(pieces) for _ in range(r.randint(0, 3))] + [f"<div><p>own {r.randint(0, 60)}</p></div>"]
        r.shuffle(own)
        pages.append((i, f"https://u:p@{host}.example:80/x", f"<body>{'<article>' if r.random() < 0.3 else '<div>'}{''.join(own)}</body>"))
    texts = defaultdict(dict)
    for _, url, page in pages:
        made, marks = html_extraction.blocks(page)
        host = url.split("@")[1].split(":")[0]
        old = texts[host].get(tuple(made))
        new = sorted({m for m, _, _ in marks})
        texts[host][tuple(made)] = max(old, new) if old else new
    want = set()
    for host, by in texts.items():
        for m, n in Counter(m for marks in by.values() for m in marks).items():
            if n >= 5 and n >= (0.5 if m % 2 else 0.05) * len(by):
                want.add((host, m))
    parsed = html_extraction._parsed(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    hosts = {r["host"]: re.search("@([^:]*)", r["url"]).group(1) for r in parsed.select("host", "url").distinct().collect()}
    assert {(hosts[r["host"]], r["mark"]) for r in html_extraction.templates(parsed).collect()} == want and len(want) > 6
    texts = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i, url, page in pages:
        made, marks = html_extraction.blocks(page)
        host = url.split("@")[1].split(":")[0]
        covered = {k for m, a, b in marks if (host, m) in want for k in range(a, b)}
        assert texts[i] == "\n".join(t for k, t in enumerate(made) if k not in covered)


def test_vague_names_leave_the_decision_to_counts(spark):
    story = "<article><h1>T{0}</h1><p class='related work'>Related work {0} of others</p><div class=search>What we searched {0}</div><div class=share><a href=x>Post</a> <a href=y>Mail</a></div>{1}</article>"
    pages = spark.createDataFrame([(i, "http://h.example/", story.format(i, "<div class=related>Our best of the week</div>" if i % 3 == 0 else "")) for i in range(30)], "page_id bigint, url string, html string")
    for r in html_extraction.extract(pages).collect():
        i = r["page_id"]
        assert r["text"].split("\n") == [f"T{i}", f"Related work {i} of others", f"What we searched {i}"]
