import random
import re
import time
from math import e, log

from convspark.llm import html

LONG = "It was a long day and the words went on and on, without a link among them, until evening came."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style>{head}</head><body>{body}</body></html>"


def test_cases(spark):
    around = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy &amp; save.</div>'
    cases = [
        (page(f"{around}<article><h1>T &amp; t</h1><p><b>Bold.<br><p>{LONG}</p><p>a  b\n c &lt;d&gt; &eacute;</p></article><footer>&copy; x</footer>"), f"T & t\nBold.\n{LONG}\na b c <d> é"),
        (page(f"{around}<div id=content><p>{LONG}</p><p>{LONG} <a href=x>more</a></p><p>{LONG}</p></div><div class='sidebar widget'><p>{LONG}</p></div>"), f"{LONG}\n{LONG} more\n{LONG}"),
        (page(f"<header><h1>Site</h1></header><main><article class='post comments-open'><h2>Head</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></article><section id='comments'><article class='comment'><p>{LONG}{LONG}</p></article></section><aside>{LONG}</aside></main>"), f"Head\n{LONG}\none\ntwo\na\nb"),
        (page(f"<div class='cookie-notice'><p>{LONG}</p></div><div class='has-sidebar'><article><p>{LONG}<script>var t='</p>';</script> end</p><form><p>{LONG}</p></form><div style='display:none'>no</div></article></div>"), f"{LONG} end"),
        (page("<nav><a href=a>only</a> <a href=b>menus</a></nav>"), ""),
        (f"<article><p>{LONG}<p>unclosed <b>tags<i> and <!-- comment --> more", f"{LONG}\nunclosed tags and more"),
        ("plain text &amp; no tags", "plain text & no tags"),
        (page("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"), "\n".join([LONG] * 3000)),
        ("<div>" * 3000 + LONG, LONG),
        (None, ""),
        ("", ""),
        ("<<>> <p", "<<>>"),
    ]
    df = spark.createDataFrame([(i, "u", h, "x", 3) for i, (h, _) in enumerate(cases)] + [(0, "u", cases[0][0], "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    rows = html.extract(df).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert r.text == cases[r.page_id][1], (r.page_id, r.text[:300])
        assert r.n_chars == len(r.text)
    assert html.extract(df.limit(0)).count() == 0


def test_densities_against_brute():
    """Counts, densities and sums of random trees by their definitions, from the text of each element."""
    rng = random.Random(3)

    def build(depth):
        tag = rng.choice(["div", "p", "span", "a", "section", "b"] if depth else ["div"])
        inner = [build(depth + 1) if rng.random() < 0.5 and depth < 4 else ("", [rng.choice(["word", "some more words ", "x"])]) for _ in range(rng.randrange(1, 4))]
        return tag, inner

    def markup(t):
        return "".join(p if isinstance(p, str) else markup(p) if p[0] else p[1][0] for p in t[1]) if not t[0] else f"<{t[0]}>{''.join(markup(p) if p[0] else p[1][0] for p in t[1])}</{t[0]}>"

    def chars(t, linked=False, inside=False):
        inside = inside or t[0] == "a"
        return sum(chars(p, linked, inside) if p[0] else (len(p[1][0].replace(" ", "")) if inside or not linked else 0) for p in t[1])

    def tags(t, only=None):
        return sum((only in (None, p[0])) + tags(p, only) for p in t[1] if p[0])

    def has_nested(t, outer=()):
        return any(p[0] and (p[0] == "p" and "p" in outer or p[0] in ("div", "section") and "p" in (*outer, t[0]) or p[0] == "p" and t[0] == "p" or has_nested(p, (*outer, t[0]))) for p in t[1])

    seen = 0
    while seen < 60:
        tree = build(0)
        if has_nested(tree) or not chars(tree):
            continue  # a paragraph would end early
        seen += 1
        root = html.parse(markup(tree))
        html.measure(root)
        share = chars(tree, True) / chars(tree)
        todo = [(root.parts[0], tree, False)]
        while todo:
            node, t, inside = todo.pop()
            c, n, lc, ln = chars(t), max(1, tags(t)), chars(t, True, inside and t[0] == "a"), max(1, tags(t, "a"))
            assert (node.tag, node.chars, node.link_chars) == (t[0], c, lc)
            if c:
                links = max(1, lc)
                assert abs(node.density - c / n * log(max(1.0, c / links * n / ln)) / log(log(c / max(1, c - lc) * links + share * c + e))) < 1e-9
            kids = [p for p in node.parts if isinstance(p, html.Node)]
            assert abs(node.sum - sum(k.density if k.tag in html.BLOCK else k.sum for k in kids)) < 1e-9
            todo += [(k, p, inside) for k, p in zip(kids, [p for p in t[1] if p[0]], strict=True)]


def test_no_tag_decides(sf):
    """The same texts where article and main are called div."""
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{sf}/pages.parquet", columns=["html"]).column("html").to_pylist():
        assert html.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "")) == html.main_text(page)
    parts = "".join(f"<section><h2>H{i}</h2>{''.join(f'<p>{LONG}</p>' for _ in range(3 + i))}</section>" for i in range(3))
    want = "\n".join(x for i in range(3) for x in [f"H{i}", *[LONG] * (3 + i)])
    assert html.main_text(page_of := page_with(parts)) == want, page_of


def page_with(parts):
    return f"<html><body><div class='menu'><a href=a>{LONG}</a></div><div><h1></h1>{parts}</div><div>Powered by x</div></body></html>"


def test_names_that_begin_like_furniture():
    """Such names remove nothing that holds the text, and furniture of those names goes where it doesn't."""
    menu, aside = "<div class='menu'><a href=a>x</a></div>", f"<div class='{{}}'><p>{LONG}</p></div>"
    names = "content no-sidebar|search-results|article-with-comments|post tags-news|social-history|main-content has-rail|related-work|share-prices"
    for name in names.split("|"):
        body = f"{menu}<div class='{name}'>{f'<p>{LONG}</p>' * 3}</div>"
        assert html.main_text(page(body)) == "\n".join([LONG] * 3), name
    for name in ("sidebar", "left-sidebar", "sidebar-left", "share-buttons", "related-posts", "comment-list"):
        body = f"{menu}<div id=text>{f'<p>{LONG}</p>' * 3}</div>{aside.format(name)}"
        assert html.main_text(page(body)) == "\n".join([LONG] * 3), name
    # readers may write more than the author
    body = f"{menu}<div id=text>{f'<p>{LONG}</p>' * 3}</div><div class='comment-list'>{f'<p>{LONG}</p>' * 9}</div>"
    assert html.main_text(page(body)) == "\n".join([LONG] * 3)


def test_choice_against_brute():
    """The chosen texts of small pages whose blocks are dense or not: the paragraphs of the block of the largest sum."""
    rng = random.Random(6)
    for _ in range(60):
        blocks = [(rng.randrange(1, 6), rng.random() < 0.4) for _ in range(rng.randrange(1, 5))]
        if not any(not linked for _, linked in blocks):
            continue
        parts = []
        for n, linked in blocks:
            line = f"<p><a href=x>{LONG}</a> <a href=y>more</a></p>" if linked else f"<p>{LONG}</p>"
            parts.append(f"<div>{line * n}</div>")
        best = max(n for n, linked in blocks if not linked)
        got = html.main_text(page("<div>" + "".join(f"<div class=wrap>{p}</div>" for p in parts) + "</div>")).split("\n")
        assert set(got) == {LONG} and len(got) >= best
        assert len(got) <= sum(n for n, linked in blocks if not linked)


def test_hostile_nesting():
    n = 100_000
    for hostile in ("<b>" * n + "</i>" * n, "<span>" * n + "<p>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<span>" * n + "<p>x" * n):
        began = time.perf_counter()
        html.main_text(hostile)
        assert time.perf_counter() - began < 20
