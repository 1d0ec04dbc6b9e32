"""Which regions of a page are taken: clustered content lines decide, elements only help."""

import random

import pytest

from glint.llm import html_text as H

LONG = "A long sentence with many words about one thing that goes on and on until the paragraph is full of text. " * 3


def para(n=1, tag="p"):
    return "".join(f"<{tag}>{i} {LONG}</{tag}>" for i in range(n))


def kept(n=1, first=0):
    return [f"{i} {LONG}".strip() for i in range(first, n)]


def test_long_main_beside_a_short_teaser_article():
    page = f"<body><main><h1>Title</h1>{para(4)}<article><a href=x>Teaser headline</a></article></main></body>"
    assert H.main_text(page).split("\n\n")[:5] == ["Title", *kept(4)]
    page = f"<body><article><a href=x>Teaser headline</a></article><main><h1>Title</h1>{para(4)}</main></body>"
    assert H.main_text(page) == "\n\n".join(["Title", *kept(4)])


def test_sibling_articles_are_kept_together():
    page = f"<body><article><h2>One</h2>{para(3)}</article><article><h2>Two</h2>{para(1)}</article></body>"
    assert H.main_text(page) == "\n\n".join(["One", *kept(3), "Two", *kept(1)])


def test_link_lists_inside_an_article_go_and_single_links_stay():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Further reading {i}</a></li>" for i in range(4)) + "</ul>"
    page = f"<article><h1>T</h1>{para(2)}<p><a href=s>The source</a></p>{para(1)}{links}</article>"
    assert H.main_text(page) == "\n\n".join(["T", *kept(2), "The source", *kept(1)])


def test_a_class_name_alone_does_not_lose_a_paragraph():
    page = f'<article><h1>T</h1>{para(1)}<div class="search-results"><p>What the search found. {LONG}</p></div></article>'
    assert H.main_text(page) == "\n\n".join(["T", *kept(1), f"What the search found. {LONG}".strip()])
    page = f'<article>{para(1)}<div class="search"><p>query</p></div><div class=comments>{para(3)}</div></article>'
    assert H.main_text(page) == "\n\n".join(kept(1))


def test_text_in_containers_beside_an_unmarked_teaser():
    page = f"<body><div id=text>{para(5)}</div><article>Short news.</article></body>"
    assert H.main_text(page) == "\n\n".join(kept(5))


def smoothed_page():
    links = "".join(f"<p><a href={i}>link {i}</a></p>" for i in range(12))
    return f"<body><div>{para(4)}</div><div><p>Yes.</p><p>{LONG}</p><p>No.</p><p>{LONG}</p><p>Maybe.</p></div><div>{links}</div></body>"


def test_smoothing_keeps_short_lines_between_long_ones(monkeypatch):
    assert H.main_text(smoothed_page()) == "\n\n".join([*kept(4), "Yes.", LONG.strip(), "No.", LONG.strip(), "Maybe."])
    monkeypatch.setattr(H, "SIGMA", 0.01)                     # no neighbour counts
    assert H.main_text(smoothed_page()) == "\n\n".join(kept(4))


def test_clusters_and_not_the_element_decide(monkeypatch):
    page = f"<body><main>{para(3)}</main><article><p>Tiny.</p></article></body>"
    assert H.main_text(page) == "\n\n".join(kept(3))
    monkeypatch.setattr(H, "content_lines", lambda lines: [len(t) < 20 for t, *_ in lines])
    monkeypatch.setattr(H, "REST", 0.0)
    assert H.main_text(page) == "Tiny."


@pytest.mark.parametrize("n", [1, 2000])
def test_very_long_pages_ties_and_repeated_pages(spark, n):
    half = para(n)
    page = f"<body><article>{half}</article><article>{half}</article></body>"
    rows = spark.createDataFrame([(1, page), (2, page), (2, page), (3, None)], "page_id long, html string")
    out = [(r["page_id"], r["main_text"]) for r in H.extract_main_text(rows).collect()]
    want = "\n\n".join(kept(n) * 2)
    assert sorted(out) == [(1, want), (2, want), (2, want), (3, "")]


def test_any_cut_off_page_gives_a_text():
    rng = random.Random(1)
    page = f"<body><nav><a>m</a></nav><main><article><h1>T</h1>{para(2)}<ul><li>a<li>b</ul></article></main><footer>f</footer></body>"
    for _ in range(200):
        assert isinstance(H.main_text(page[:rng.randint(0, len(page))]), str)
