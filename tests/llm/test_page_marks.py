"""Which names take words away, and which don't."""

import pytest

from dialoom.llm import pagetext

DATA = "/root/testdata/sf0.001"
WORDS = "First words of the text here are several more of them."
OTHER = "Other words that somebody left here below it all."


@pytest.fixture(scope="module")
def weights(spark):
    return pagetext.train(spark.read.parquet(f"{DATA}/pages.parquet"))


GONE = [
    '<div class="comments list">{}</div>', '<div class="sidebar left">{}</div>', '<div class="post-comments"><p>{}</p></div>', '<section id="comment_list">{}</section>', '<div class="left-sidebar">{}</div>',
    '<article class="comment"><p>{}</p></article>', '<div class="ad">{}</div>', '<div class="cookie-consent wide">{}</div>', '<p class="ad">{}</p>', '<nav>{}</nav>', '<form>{}</form>',
]
BESIDE = ['<div class="site-header">{}</div>', '<div class="page social">{}</div>', '<div class="share-bar"><p>{}</p></div>', '<div id="page-footer">{}</div>']
KEPT = ['<p class="related-work">{}</p>', '<p class="social">{}</p>', '<p class="search-results">{}</p>', '<h2 class="header">{}</h2>', '<div class="market share">{}</div>', '<div class="notice-period"><p>{}</p></div>', '<p class="no-comment">{}</p>']


@pytest.mark.parametrize("inner", GONE)
def test_furniture_goes_within_and_beside(weights, inner):
    page = f"<html><body><article><p>{WORDS}</p>{inner.format(OTHER)}</article></body></html>"
    assert pagetext.extract(page, weights) == WORDS
    page = f"<html><body><article><p>{WORDS}</p></article>{inner.format(OTHER)}</body></html>"
    assert pagetext.extract(page, weights) == WORDS


@pytest.mark.parametrize("inner", BESIDE)
def test_containers_beside_an_article_go(weights, inner):
    page = f"<html><body>{inner.format(OTHER)}<article><p>{WORDS}</p></article></body></html>"
    assert pagetext.extract(page, weights) == WORDS


@pytest.mark.parametrize("inner", KEPT)
def test_parts_of_an_article_stay(weights, inner):
    page = f"<html><body><article><p>{WORDS}</p>{inner.format(OTHER)}</article></body></html>"
    assert pagetext.extract(page, weights) == f"{WORDS}\n\n{OTHER}"


def test_a_small_article_does_not_outdo_the_page(weights):
    page = "<html><body>" + f"<p>{WORDS}</p>" * 50 + "<article>One</article><nav><a>Menu of it</a></nav></body></html>"
    text = pagetext.extract(page, weights)
    assert text.count(WORDS) == 50 and "Menu" not in text


def test_the_scan_and_the_learned_weights_decide(spark, weights, monkeypatch):
    html = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    texts = [pagetext.extract(h, weights) for h in html]
    flat = {k: 1.0 if k[0] == pagetext.WORD else 0.0 if k[0] == pagetext.SHAPE else -0.05 for k in weights}
    assert sum(pagetext.extract(h, flat) != t for h, t in zip(html, texts, strict=True)) > len(html) / 2
    monkeypatch.setattr(pagetext, "best_run", lambda values: (0, len(values)))
    assert sum(pagetext.extract(h, weights) != t for h, t in zip(html, texts, strict=True)) > len(html) / 2


def test_a_menu_without_a_name_goes_and_links_of_a_text_stay(weights):
    menu = "<div><ul>" + "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(8)) + "</ul></div>"
    text = f"<p>{WORDS}</p><p><a href='/x'>Read on</a></p><p>{OTHER} And <a href='/y'>see this</a> too.</p>"
    want = f"{WORDS}\n\nRead on\n\n{OTHER} And see this too."
    assert pagetext.extract(f"<html><body>{menu}<div>{text}</div>{menu}</body></html>", weights) == want
    assert pagetext.extract("<html><body><p><a href='/x'>Only a link</a></p></body></html>", weights) == "Only a link"
