"""Texts of pages: where a description stands, and whole pages against a plain reading."""

import hashlib
import html
import json
import re

import pytest

from postsieve.plans.queries import QUERIES
from postsieve.sources.html import LEAST, MOST, NOISE, html_to_text, page_text

LONG = "Build the thing and keep it running, with care and with others. " * 2
OTHER = "Something else that stands on the page and is no description at all."


def structured(text):
    return f"<script type='application/ld+json'>{json.dumps({'description': text})}</script>"


def test_order_of_places():
    page = f"<p>{OTHER}</p><div class='job-description'>{LONG}</div>"
    assert page_text(page) == LONG.strip()
    assert page_text(structured(f"<p>{OTHER}</p>") + page) == OTHER
    assert page_text(structured("short") + page) == LONG.strip()
    assert page_text(structured("<b></b>" * 20) + page) == LONG.strip()  # long enough before its tags are taken out, not after
    assert page_text("<script type='application/ld+json'>{no json</script><script type='application/ld+json'>[1]</script>" + page) == LONG.strip()
    assert page_text(structured("short") + structured(OTHER) + page) == OTHER
    assert page_text(f"<p>{OTHER}</p><p>{LONG}</p>") == f"{OTHER}\n{LONG.strip()}"


def test_site_selectors_need_the_address():
    page = f"<div class='job-description'>{OTHER}</div><section class='a show-more-less-html__markup'>{LONG}</section>"
    assert page_text(page, url="https://www.linkedin.com/jobs/view/1") == LONG.strip()
    assert page_text(page, url="https://jobs.example.org/1") == page_text(page) == OTHER
    shown = f"<i data-testid='job-details-about-the-job-container'>{LONG}</i><i class='description__text'>short</i>"
    assert page_text(shown, url="https://linkedin.com/x") == LONG.strip()


@pytest.mark.parametrize("tag", ["p class='x job-description y'", "a id='job-details'", "section class=description", "p class='the-jobDescription-x'", "p id=jobDescriptionText"])
def test_selectors(tag):
    assert page_text(f"<p>{OTHER}</p><{tag}>{LONG}</{tag.split()[0]}><p>{OTHER}</p>") == LONG.strip()


def test_only_the_first_element_of_a_selector():
    page = f"<p class='job-description'>short</p><p class='job-description'>{LONG}</p>"
    assert page_text(page) == f"short\n{LONG.strip()}"
    assert page_text(f"<article>{OTHER}</article>" + page) == f"{OTHER}\nshort\n{LONG.strip()}"
    with pytest.raises(ValueError):
        page_text("<p>", selectors=("a b",))


def test_texts_between_tags():
    page = f"<div id='job-details'><nav>Menu</nav><h2> A &amp; B </h2>{LONG}<b>bold</b><!-- no --><br/>end<script>no</script><style>no</style></div>out"
    assert page_text(page) == f"Menu\nA & B\n{LONG.strip()}\nbold\nend"
    assert page_text(f"<nav>{OTHER}</nav><footer>{OTHER}</footer><iframe>{OTHER}</iframe><div>{LONG}</p></div>end") == f"{LONG.strip()}\nend"


def test_lengths_and_nulls(spark):
    assert page_text("x" * LEAST) == "x" * LEAST and page_text("x" * (LEAST - 1)) is None
    assert page_text("y" * (MOST + 1)) == "y" * MOST
    rows = [(1, None, None, 0), (2, " \n", "u", 0), (2, f"<p>{LONG}</p>", None, 0), (3, "<p>" * 20_000 + LONG, "u", 0), (None, LONG, "u", 0)]
    found = html_to_text(spark.createDataFrame(rows, "page_id long, html string, url string, text int"))
    assert found.columns == ["page_id", "text"]
    assert sorted(((r.page_id or 0), r.text or "") for r in found.collect()) == [(0, LONG.strip()), (1, ""), (2, ""), (2, LONG.strip()), (3, LONG.strip())]
    assert html_to_text(spark.createDataFrame([], "page_id string, html string, url string")).schema.simpleString() == "struct<page_id:string,text:string>"


def plain(page):
    """A whole page without noise, by patterns; right where elements of noise are closed and not nested."""
    page = re.sub(r"(?s)<!--.*?-->", "<>", page)
    page = re.sub(rf"(?s)<({'|'.join(NOISE)})\b[^>]*>.*?</\1>", "<>", page)
    return "\n".join(s for t in re.split(r"<[^>]*>", page) if (s := html.unescape(t).strip()))[:MOST]


def test_query_against_plain_reading(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.page_id: plain(r.html or "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    want = {i: (len(t), hashlib.md5(t.encode()).hexdigest()) if len(t) >= LEAST else (None, None) for i, t in texts.items()}
    assert {r.page_id: (r.n, r.digest) for r in QUERIES["page_text"](spark, sf_dir).collect()} == want
