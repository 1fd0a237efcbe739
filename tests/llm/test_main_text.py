import html
import math
import random
import re
import time

import pytest
from odd import rows_of
from pyspark.sql import functions as F

from tollway.llm import main_text, queries
from tollway.llm.main_text import main_text as text_of

LONG = "A paragraph of some length, so that its density is that of running text and not of a menu, whatever else is there."
ARTICLE = f"<h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p><p>Also {LONG}"
WANTED = f"Title & more {LONG} Short. Also {LONG}"


def plain(page):
    """What stands in the article element: tags out, references decoded, white space made one space."""

    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not found:
        return ""
    inner = found[1] if found[2] else re.sub(r"<[^>]*$", "", found[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_whole_table_equals_a_plain_run(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = rows_of(queries.QUERIES["op13_text_density"](spark, sf_dir))
    assert found == sorted(((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in rows), key=repr)


NOISE = [
    "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>", "<div class='ad'>Buy these things now, they are cheap and they are good, and they are here.</div>",
    f"<footer>&copy; Someone. {LONG}</footer>", f"<aside><p>{LONG}</p><p>{LONG}</p></aside>", f"<header><div class=logo>Site name</div><p>{LONG}</p></header>",
    f"<div id='cookie-notice'><p>{LONG}</p></div>", f"<form action=/x><label>Your name</label><input name=n><p>{LONG}</p><button>Send</button></form>",
    "<script>var t = '<p>no text</p>'; if (a < b && c > d) {}</script>", "<style>p > b { margin: 0 }</style>", f"<!-- <p>{LONG}</p> -->", f"<section class='comments'>{''.join(f'<article><p>Reader {k}: {LONG}</p></article>' for k in range(9))}</section>",
    f"<div class=\"sidebar\"><h3>Other news</h3><p>{LONG}</p></div>", f"<div role=banner><p>{LONG}</p></div>", f"<div hidden><p>{LONG}</p></div>", "<noscript>Turn scripts on</noscript>",
    f"<ul class=breadcrumbs><li>{LONG}</ul>", f"<div class='relatedPosts related'><p>{LONG}</p></div>", "<textarea><p>not markup</p></textarea>", "<svg><text>drawing</text></svg>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div role='main'>{}</div>", "<main><article class='post hentry'>{}</article></main>", "<form id=page><div>{}</div></form>"])
def test_what_is_not_the_article_stays_out(wrap):
    inner = wrap.format(ARTICLE)
    for k, noise in enumerate(NOISE):
        other = NOISE[(k + 5) % len(NOISE)]
        assert text_of(f"<!DOCTYPE html><html><head><title>T</title></head><body>{noise}{inner}{other}</body></html>") == WANTED, noise
    assert text_of(f"<body>{''.join(NOISE)}{inner}{''.join(NOISE)}</body>") == WANTED
    inside = wrap.format(ARTICLE + "</p>" + "".join(n for n in NOISE if "<header" not in n))
    assert text_of(f"<body>{inside}</body>") == WANTED


@pytest.mark.parametrize("page,wanted", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain words only", "plain words only"), ("<p>a<p>b", "a b"), ("<p>a<br>b<b>c</b>d</p>", "a bcd"),
    ("<article><p>x &lt;b&gt; &#233;&eacute; &nbsp; y&am", "x <b> éé y&am"), ("<article><p>one</p><p", "one"), ("<article><p>one</p><a href='x", "one"), ("<article>a < b and c<d", "a < b and c"),
    ("<article><p>one <!-- never closed", "one"), ("<p title='a > b'>t</p>", "t"), ("<p class=\"x\"title='y'z>t</p>", "t"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"), ("<nav>only a menu</nav>", ""), ("<body></b></div></p>x</body>y", "xy"), ("<article><p>a\n\t b c</p>\n<p>d</p></article>", "a b c d"),
    ("<article><script>1</script>", ""), ("</", ""), ("<", "<"), ("<article><p>a</p></article><footer>b", "a"), ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k v l w"),
])
def test_odd_pages(page, wanted):
    assert text_of(page) == wanted


def test_densities_equal_a_walk_down_the_tree():
    rng = random.Random(7)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a>", "</a>", "<b>", "</b>", "<nav>", "</nav>", "<ul><li>", "</ul>", "words " * rng.randrange(1, 9)]))
        page = main_text.Page("<body>" + "".join(parts))
        d = main_text.Densities(page)
        children = {k: [c for c in range(len(page.tag)) if page.parent[c] == k] for k in range(len(page.tag))}

        def count(k, linked=False):
            if d.noise[k]:
                return 0, 0, 0, 0
            linked = linked or page.tag[k] == "a"
            own = sum(len("".join(t.split())) for node, t in page.text if node == k)
            total = [own, 0, own if linked else 0, 0]
            for c in children[k]:
                found = count(c, linked)
                out = d.noise[c]
                for x in range(4):
                    total[x] += found[x]
                total[1] += not out
                total[3] += page.tag[c] == "a" and not out
            return tuple(total)

        body = count(d.body)
        for k in range(len(page.tag)):
            if d.noise[k]:
                assert d.density[k] == 0
                continue
            linked = any(page.tag[x] == "a" for x in up(page, k))
            chars, tags, link_chars, link_tags = count(k, linked)
            if chars:
                base = math.log(chars / max(1, chars - link_chars) * max(1, link_chars) + body[2] / max(1, body[0]) * chars + math.e)
                wanted = chars / max(1, tags) * math.log(max(1, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / math.log(base)
                assert d.density[k] == pytest.approx(wanted)
            assert d.sum[k] == pytest.approx(sum(d.density[c] for c in children[k]))


def up(page, k):
    while k >= 0:
        yield k
        k = page.parent[k]


def test_threshold_takes_other_dense_parts():
    links = "<div><a href=1>x</a><a href=2>y</a></div>"
    page = f"<body><div>{f'<p>{LONG}</p>' * 6}</div>{links}<div><p>{LONG}</p></div>{links}</body>"
    assert text_of(page) == " ".join([LONG] * 7)


def test_long_and_deep_pages():
    start = time.perf_counter()
    assert len(text_of("<article>" + f"<p>{LONG}</p>" * 20_000)) == 20_000 * (len(LONG) + 1) - 1
    assert text_of("<div>" * 20_000 + "deep") == "deep"
    assert text_of("<p " * 100_000) == ""
    assert text_of("<!--" * 100_000) == ""
    assert text_of("<a href='" * 50_000 + "x") == ""
    assert time.perf_counter() - start < 30


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>a</p>"), (2, "u", ARTICLE), (2, "u", ARTICLE), (3, "v", "\x00<p>\x1f x😀</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    found = main_text.extract(clashing)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert rows_of(found) == sorted(((i, u, text_of(h), len(text_of(h))) for i, u, h in rows), key=repr)
    assert main_text.extract(pages.limit(0)).count() == 0
