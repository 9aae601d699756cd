"""Quality rules, license scans, url filters and main text on small inputs."""

import random
import re
import time

import pytest

from plumbline.llm import html, quality, urls
from plumbline.llm.licenses import TEMPLATES, license_hits

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "\n".join(
    f"Line {k} tells {k * 7} of {k * 11} things, then {k * 13} more; at {k * 17} it ends."
    for k in range(12)
)


def brute_counts(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, run in enumerate(runs) if runs.count(run) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(inside),
    )


TEXTS = [
    GOOD,
    None,
    "",
    " \n\t\x0b\x0c\r ",
    "a b c d e f g h " * 5,
    "x " * 40,
    "one two\x1cthree\x85four\xa0five é日本 \U0001f600 end",
    "line\nline\n line\nline\n\n\nother",
    " ".join(f"{w}### {w}$$$" for w in "abcdefghijklmnop"),
    " ".join(str(k % 23) for k in range(400)) + "\n" + " ".join(str(k % 23) for k in range(100)),
    GOOD + "\nHome | News | Sport | About | Contact\nWe use cookies on this site to help you.\nMenu",
    "LOUD!! WORDS!! ALL!! OVER!! THE!! PLACE!! " * 10,
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, t, "q", 1) for i, t in enumerate(TEXTS)] + [(None, GOOD, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cleaned string, counts int")
    return quality.judged(df, name="verdict").collect()


def test_counts(judged):
    for row in judged[: len(TEXTS)]:
        q = row["verdict"]
        found = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"])
        assert found == brute_counts(row["text"]), row["doc_id"]
        failed = found[0] < 20 or 100 * found[4] > 30 * found[0]
        assert q["base_failed"] == failed and not (failed and q["kept"])


def test_verdicts(judged):
    kept = {r["doc_id"] for r in judged if r["verdict"]["kept"]}
    assert kept == {0, 10, None}
    # Lines that fail are removed, the others stay as they are.
    assert judged[10]["verdict"]["cleaned"] == GOOD
    assert judged[0]["verdict"]["cleaned"] is None


@pytest.mark.parametrize("phrase", ["privacy policy", "Terms of Use", "lorem ipsum", "all rights reserved"])
def test_a_clean_line_may_mention_boilerplate(phrase):
    mention = f"The council published its {phrase} in May. {' '.join(GOOD.split())}"
    bare = f"{phrase}, {phrase}, and so on."
    assert quality.cleaned(mention) == (0, len(mention), 0, None)
    both = f"{mention}\n{bare}"
    assert quality.cleaned(both) == (0, len(both) - 1, len(bare), mention)


def test_long_texts_are_read_to_the_end(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    df = spark.createDataFrame([(1, long + " tail " * 9), (2, long)], "doc_id bigint, text string")
    found = quality.judged(df).collect()
    assert [r["quality"]["n_words"] for r in found] == [400_009, 400_000]
    assert [r["quality"]["n_repeat_words"] for r in found] == [9, 0]


def test_kept_documents_keep_their_columns(spark):
    rows = [(i, t, len(t or ""), "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, quality string")
    found = quality.keep_good(df)
    assert found.schema == df.schema
    assert [tuple(r) for r in found.collect()] == [(0, GOOD, len(GOOD), "x"), (10, GOOD, len(GOOD), "x")]
    assert quality.keep_good(df.limit(0)).collect() == []


def test_license_hits(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    header = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this\n"
        "software and associated documentation files, to deal in the Software without restriction,\n"
        "including without limitation the rights to use, copy, modify, merge, publish, distribute,\n"
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the\n"
        "Software is furnished to do so, subject to the following conditions"
    )
    rows = [
        (1, f"Some text that goes on for a while.\n{apache}\nand more of the text, which is not a license"),
        (1, f"Some text that goes on for a while.\n{apache}\nand more of the text, which is not a license"),
        (2, f"intro\n\n{header}\n\nLICENSED under CC BY-NC 4.0"),
        (3, "the license is not the matter here, nor is version 2 of it, or so they say"),
        (4, None),
        (5, ""),
        (6, "MIT"),
        (None, "All rights reserved."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ["words", "u", "best", "t", "plain", "grams", "shared", "places", "windows", "begin"]
    hits = license_hits(df.selectExpr("*", *[f"1 AS {n}" for n in names]))
    found = hits.where("unit <> 'passage'").collect()
    got = sorted(((r["doc_id"], r["unit"], r["unit_no"], r["license"]) for r in found), key=str)
    assert got == sorted(
        [
            (1, "line", 1, "Apache-2.0"),
            (1, "line", 1, "Apache-2.0"),
            (2, "block", 1, "MIT header"),
            (2, "line", 8, "CC-BY-NC-4.0"),
            (None, "line", 0, "Proprietary"),
        ],
        key=str,
    )
    assert license_hits(df.limit(0)).collect() == []
    # What fills a line or block is a passage too; so is the short notice in a longer line.
    passages = [(r["doc_id"], r["license"]) for r in hits.where("unit = 'passage'").collect()]
    assert sorted(passages, key=str) == sorted(
        [(1, "Apache-2.0"), (1, "Apache-2.0"), (2, "MIT header"), (2, "CC-BY-NC-4.0"), (None, "Proprietary")],
        key=str,
    )


def _passages(text, templates, threshold):
    """(first word, license, dice, bigrams) by trying every window of the text."""
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
    grams = list(zip(words, words[1:]))
    found = []
    for name, template in templates.items():
        held = [w for w in re.split("[^a-z0-9]+", template.lower()) if w]
        want = set(zip(held, held[1:]))
        similar = []
        for i in range(len(grams) if want else 0):
            window = set(grams[i : i + len(held) - 1])
            dice = 2.0 * len(window & want) / (len(window) + len(want))
            if grams[i] in want and dice >= threshold:
                similar.append((i, dice, len(window)))
        groups = []
        for one in similar:
            if groups and one[0] - groups[-1][-1][0] <= len(held) - 1:
                groups[-1].append(one)
            else:
                groups.append([one])
        for group in groups:
            i, dice, n = max(group, key=lambda w: (w[1], -w[0]))
            found.append((i, name, dice, n))
    return sorted(found)


def test_license_passages_against_all_windows(spark):
    rng = random.Random(4)
    short = {"a": "x y z y x", "b": "p q", "c": "x y p q z", "d": "y", "e": "p p p p"}
    texts = [" ".join(rng.choices("xyzpq", k=rng.randrange(0, 40))) for _ in range(300)]
    apache = TEMPLATES["Apache-2.0 header"]
    commented = "\n#\n".join("# " + part for part in apache.split(". "))
    real = [
        "Copyright 2020 Foo Inc. All rights reserved.",
        "This article is licensed under CC BY 4.0.",
        "Released under the MIT License by its authors in 2020.",
        f"First a sentence. {apache} Then another, and more of the text.",
        commented + "\nimport os\nimport sys\n" + "value = value + 1\n" * 200,
        apache.replace(". ", ".\n\n"),
        "All rights reserved. " * 50,
        "all rights were not reserved",
        None,
        "",
    ]
    for templates, threshold, held in ((short, 0.8, texts), (short, 0.6, texts), (TEMPLATES, 0.8, real)):
        df = spark.createDataFrame(list(enumerate(held)), "doc_id bigint, text string")
        hits = license_hits(df, templates=templates, threshold=threshold).where("unit = 'passage'")
        got = sorted((r["doc_id"], r["unit_no"], r["license"], r["dice"], r["n_bigrams"]) for r in hits.collect())
        want = [(k, *p) for k, text in enumerate(held) for p in _passages(text, templates, threshold)]
        assert got == want and got
    licenses = {k: {r[2] for r in got if r[0] == k} for k in {r[0] for r in got}}
    assert licenses[0] == {"Proprietary"} and licenses[1] == {"CC-BY-4.0"} and licenses[2] == {"MIT"}
    assert all("Apache-2.0 header" in licenses[k] for k in (3, 4, 5))
    assert set(licenses) == set(range(7))


def test_license_passages_in_a_very_long_text(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    text = " ".join(["word and the license of it"] * 100_000 + [notice] + ["under the sun"] * 100_000)
    often = "All rights reserved. " * 50_000
    df = spark.createDataFrame([(1, text), (2, often)], "doc_id bigint, text string")
    hits = license_hits(df).where("unit = 'passage'").collect()
    assert [(r["unit_no"], r["license"]) for r in hits if r["doc_id"] == 1] == [(600_000, "Apache-2.0")]
    # No two of these windows share a word.
    assert sum(r["doc_id"] == 2 for r in hits) == 50_000


def test_license_threshold(spark):
    # Five bigrams, of which the template has four: 2 * 4 / (5 + 6) is below 0.8.
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0")], "doc_id bigint, text string")
    only = {"NC": "Licensed under CC BY-NC 4.0."}
    assert license_hits(df, templates=only).collect() == []
    assert license_hits(df, templates=only, threshold=0.7).first()["dice"] == pytest.approx(8 / 11)


URLS = {
    "http://example.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
    "https://WWW.Example.com/en/1?q=/de/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://example.com/en": ("example.com", "/en", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://example.com#/en/": ("example.com", "", None, "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "ftp://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"),
    "ftp://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "ftp://x.net/de/a": ("x.net", "/de/a", None, "allow"),
    "x.net/es/a": ("", "", None, "allow"),
    "a://b://c.com/x": ("b:", "//c.com/x", None, "allow"),
    "://": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_url_verdicts(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, "http://x.org/", "h", "v")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    found = urls.judged(df).collect()
    assert [tuple(r)[1:] for r in found[: len(URLS)]] == list(URLS.values())
    assert found[-1]["page_id"] is None and found[-1]["verdict"] == "allow"
    assert urls.judged(df.limit(0)).collect() == []


def test_url_rules_in_general():
    rules = [
        urls.Rule("block", "a.com"),
        urls.Rule("allow", "a.com", "/x"),
        urls.Rule("block", "a.com", "/x/y/"),
        urls.Rule("allow", "b.com", "/"),
        urls.Rule("block", "b.com", "/"),
    ]

    def brute(host, path):
        fits = [
            r for r in rules
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        ]
        return max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)

    trie = urls.build_trie(rules)
    for host in ("a.com", "z.a.com", "b.com", "com", "aa.com", ""):
        for path in ("", "/", "/x", "/xy", "/x/", "/x/y", "/x/y/", "/x/y/z", "/q/x"):
            assert urls.longest_match(trie, host, path) == brute(host, path)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style>
<script>var a = "<p>no</p>";</script></head><body class="home has-sidebar">
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">B, c, d, e, f</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, and more, and more, and more, as you know.</p></div>
<div class="ad">Buy, buy, buy now, really, it is cheap, so cheap, cheap.</div>
{body}
<aside><p>Aside, aside, aside, aside, aside, aside, aside, aside.</p></aside>
<div class="comments"><p>Great text, really, I liked it, very much, thanks, thanks.</p></div>
<form><p>Name, and mail, and more</p></form>
<footer>&copy; Someone, somewhere</footer></body></html>"""

BODIES = [
    ("<article><h1>Head</h1><p>One, two &amp; three.<p><b>Bold</b> te<i>x</i>t\n\n here<br>and.</article>",
     "Head One, two & three. Bold text here and."),
    ("<div class='post'><p>First part, long enough, with words.</p><!-- <p>no</p> -->"
     "<div class='share'>Share this</div><p>Second &#8212; part, long enough.</p></div>",
     "First part, long enough, with words. Second \u2014 part, long enough."),
    ("<main><section><h2>A</h2><p>Some words, here.</p></section><section><p>More words, there.</p></section></main>",
     "A Some words, here. More words, there."),
    ("<article><p>Unclosed <b>bold<p>next, one</article>", "Unclosed bold next, one"),
    ("<article><p hidden>secret</p><p>Seen, here.</p><table><tr><td>Cell<td>two</table></article>",
     "Seen, here. Cell two"),
]


@pytest.mark.parametrize("body, text", BODIES)
def test_main_text(body, text):
    assert html.main_text(PAGE.format(body=body)) == text


WORDS = "The first words, and more of them, stand here. They go on, and then they end."
KEPT = [
    '<article data-title="The hidden cost of war"><p>{}</p></article>',
    '<main title=" hidden "><p>{}</p></main>',
    "<div title='a hidden gem'><article><p>{}</p></article></div>",
    '<div class="layout has-sidebar"><article><p>{}</p></article></div>',
    '<div class="site-content sticky-header"><p>{}</p></div>',
    '<div class="content with-comments"><p>{}</p></div>',
    '<div class="sidebar-layout"><article><p>{}</p></article></div>',
    '<div id="search"><main><p>{}</p></main></div>',
    '<div class="header-wide"><p>{}</p><p>And more, and more, and more, and more of them, and more, to be sure.</p></div>',
    '<article><h2 class="section-header">{}</h2><p>Then, more.</p></article>',
    '<article><section class="legal"><p>{}</p></section><p>Then, more.</p></article>',
    '<form id="page"><article><p>{}</p></article></form>',
]


@pytest.mark.parametrize("body", KEPT)
def test_the_text_is_not_dropped_with_what_it_is_in(body):
    found = html.main_text(PAGE.format(body=body.format(WORDS)))
    assert found.startswith(WORDS) and "cookies" not in found and "Great text" not in found
    assert html.main_text(f"<html><body>{body.format(WORDS)}</body></html>") == found


LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Entry {k}</a></li>' for k in range(9)) + "</ul>"
LONG = "A first part, with words, and words, and words, goes on, and on, and on, and on. " * 3
SEVERAL = [
    # One long block sets no bar for the others.
    (f"<div><p>{LONG}</p></div><div><p>Second, short.</p></div><div><p>Third part.</p></div><div>Fourth one.</div>",
     f"{LONG}Second, short. Third part. Fourth one."),
    ("<div><p>Short.</p></div><div><p>Also short.</p></div>", "Short. Also short."),
    (f"<div><p>{LONG}</p></div><ul><li>One</li><li>Two</li></ul><ol><li>Three</li></ol>"
     "<table><tr><th>Four</th><td>Five</td></tr></table><dl><dt>Six</dt><dd>Seven</dd></dl>"
     "<figure><img src='x'><figcaption>Eight</figcaption></figure>",
     f"{LONG}One Two Three Four Five Six Seven Eight"),
    (f"<div>{LINKS}</div><h1>Head</h1><div><p>{LONG}</p></div><h2>More</h2><div><p>Last.</p></div>{LINKS}",
     f"Head {LONG}More Last."),
    # At every level; of a list of links only the prose.
    (f"<div><div><p>{LONG}</p></div><div><p>Near.</p></div></div><div><div>{LINKS}<p>Far.</p></div></div>"
     "Bare <b>text</b>.<br><a href='/'>Up</a>",
     f"{LONG}Near. Far. Bare text. Up"),
]


@pytest.mark.parametrize("body, text", SEVERAL)
def test_main_text_in_several_parts(body, text):
    found = html.main_text(f"<html><body><nav>No.</nav>{body}<footer>No.</footer></body></html>")
    assert found == text


def test_body_is_not_hidden_by_a_value():
    assert html.main_text(f'<body data-a="all hidden here"><p>{WORDS}</p></body>') == WORDS
    assert html.main_text(f"<article><p>{WORDS}</p><p hidden=''>No.</p><p HIDDEN>No.</p></article>") == WORDS


def test_comments_longer_than_the_article_are_dropped():
    comments = "".join(f"<p>Comment {k}, long, and longer, said somebody, again.</p>" for k in range(30))
    for name in ("comments", "related", "sidebar"):
        page = f'<body><article><p>{WORDS}</p></article><div class="{name}">{comments}</div></body>'
        assert html.main_text(page) == WORDS
    page = f'<body><article><p>{WORDS}</p><div class="related"><article><p>{WORDS}</p></article></div></article>'
    assert html.main_text(page) == WORDS


def test_broken_pages():
    for page in ("", None, "<", "<p", "a < b", "</p></div>", "<script>x", "<!-- x", "<p a='", "&am", "<a>" * 2000):
        assert isinstance(html.main_text(page), str)
    assert html.main_text("just text &lt;here&gt;") == "just text <here>"
    assert html.main_text("<article><p>cut off in the mid") == "cut off in the mid"


def test_main_text_rows(spark):
    page = PAGE.format(body=BODIES[0][0])
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (None, None, None, None), (3, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = sorted(map(tuple, html.extracted(df).collect()), key=str)
    one = (1, "u", BODIES[0][1], len(BODIES[0][1]))
    assert found == sorted([one, one, (None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html.extracted(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "part, text",
    [
        ("<article><p>Second short.</p></article>", "Second short."),
        ("<ul><li>one<li>two</ul>", "one two"),
        ("<table><tr><td>cell<td>other</table>", "cell other"),
        ("<section><h2>End</h2><p>So be it.</p></section>", "End So be it."),
        ("<h1>Title above</h1>", "Title above"),
        ("<p><a href='x'>A reference to it</a></p>", "A reference to it"),
        ("<ul><li><a href='1'>link</a><li><a href='2'>more</a></ul>", ""),
        ("<div class='ad'>Buy.</div>", ""),
        ("<nav><p>Go home.</p></nav>", ""),
    ],
)
@pytest.mark.parametrize("frame", ["<main>{}</main><div>x</div>", "<body>{}</body>"])
def test_parts_beside_the_article(frame, part, text):
    story = "A long story, with commas, that goes on for a while and then ends."
    page = frame.format(part + f"<article><p>{story}</p></article>" + part)
    left = "" if "<main>" in frame else " x"
    assert html.main_text(page).removesuffix(left) == " ".join(x for x in (text, story, text) if x)


def test_main_text_in_linear_time():
    for page in ("<div><p>" * 130_000 + "x", "<i>" * 300_000 + "x", "<div>" * 5000 + "</b>" * 100_000):
        start = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - start < 20


def brute_points(page):
    """Points of each container, from the definition, over a tree of tuples (tag, children)."""
    sums = {}

    def below(node):
        text = "".join(x if isinstance(x, str) else below(x) for x in node[1])
        return text

    def visit(node, ups):
        if node[0] == "p":
            text = below(node)
            points = 1 + text.count(",") + min(sum(map(len, text.split())) / 100, 3)
            for level, up in enumerate(u for u in reversed(ups) if u[0] in ("div", "html")):
                share = 1 if level == 0 else 2 if level == 1 else 3 * level
                sums[id(up)] = sums.get(id(up), 0.0) + points / share
        for child in node[1]:
            if not isinstance(child, str):
                visit(child, [*ups, node])

    visit(page, [])
    return sums


def test_points_against_the_definition():
    pick = random.Random(4)

    def tree(depth):
        kind = pick.choice(["div", "p", "span"]) if depth else "p"
        if kind == "p":
            return "p", ["word, " * pick.randrange(1, 60)]
        return kind, [tree(depth - 1) for _ in range(pick.randrange(1, 4))]

    def markup(node):
        inner = "".join(x if isinstance(x, str) else markup(x) for x in node[1])
        return f"<{node[0]}>{inner}</{node[0]}>"

    def containers(node):
        if not isinstance(node, str):
            if (node.tag if hasattr(node, "tag") else node[0]) in ("div", "html"):
                yield node
            for child in node.children if hasattr(node, "tag") else node[1]:
                yield from containers(child)

    for _ in range(60):
        page = ("html", [("div", [tree(4) for _ in range(pick.randrange(1, 4))])])
        points = brute_points(page)
        root = html.parse(markup(page))
        html._scored(root)
        found = [round(n.score, 6) for n in containers(root)]
        assert found == [round(points.get(id(n), 0.0), 6) for n in containers(page)]
