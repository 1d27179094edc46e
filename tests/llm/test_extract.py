"""Extraction: what containers are called, and blocks between or beside good ones."""
import html
import random
import re

import pytest

from skelgraph.llm import extract

SF = "/root/testdata/sf0.001"
GOOD = "The long story of that and this is for it. " * 4
G = f"<p>{GOOD}</p>"
WORDLESS = "12 345 678 90 " * 8
TAGS = "keyword tag cloud item " * 8


@pytest.mark.parametrize("shell", ["<div class='content-sidebar-wrap'><main>{}</main></div>", "<article class='post comments-open'>{}</article>", "<div class='page has-sidebar'><article>{}</article></div>",
                                   "<div id='main' class='no-banner'>{}</div>", "<section class='social-science'>{}</section>"])
def test_everyday_class_names_hide_nothing(shell):
    assert extract.main_text(f"<body><nav>Menu</nav>{shell.format(G)}</body>") == GOOD.strip()


@pytest.mark.parametrize("name", ["ad", "site-header", "page-footer", "main-nav", "nav", "sidebar", "left-sidebar", "cookie-notice", "newsletter", "related-posts", "share-buttons", "comments", "comment-list", "user-comments", "social-links"])
def test_boilerplate_by_whole_names(name):
    assert extract.main_text(f"<body>{G}<div class='box {name}'>{G}</div><p>{GOOD}x</p>{G}</body>").count("long story") == 3 * 4


def test_a_container_is_not_taken_at_its_name_if_it_holds_the_text():
    assert extract.main_text(f"<body><div class='widget'>{G * 4}<div class='ad'>{G}</div></div><p>x</p></body>").count("long story") == 4 * 4
    assert extract.main_text(f"<body>{G}<div class='comments'>{G * 9}</div></body>") == GOOD.strip()


def test_what_stands_between_good_blocks_is_text():
    assert extract.main_text(f"<body>{G}<p>{WORDLESS}</p><p>See <a>long reference title</a></p>{G}</body>") == "\n".join([GOOD.strip(), WORDLESS.strip(), "See long reference title", GOOD.strip()])
    assert extract.main_text(f"<body>{G}<p>{TAGS}</p></body>").endswith("item")  # no link near it
    assert "keyword" not in extract.main_text(f"<body>{G}<p>{TAGS}</p><p><a>A link</a></p></body>")


def test_menus_go_inside_articles_too():
    menu = "".join(f"<li><a href=x>Other story {k}</a></li>" for k in range(4))
    page = f"<article>{G}<ul>{menu}</ul>{G}<li><a>Reference one</a></li><li><a>Reference two</a></li></article>"
    assert extract.main_text(page) == "\n".join([GOOD.strip(), GOOD.strip(), "Reference one", "Reference two"])


def test_articles_without_their_tag_and_with_other_labels(spark):
    rng, changed = random.Random(1), 0
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert extract.main_text(page.html.replace("<article>", "<div>").replace("</article>", "</div>")) == "\n".join(x for x in want if x)
        lang, found = extract.blocks(page.html)
        labels = extract.first_pass(lang, found)
        other = [rng.choice([True, None, False]) if b[3] else x for b, x in zip(found, labels)]
        changed += extract.second_pass(found, labels) != extract.second_pass(found, other)
    assert changed > 5  # labels inside articles count
