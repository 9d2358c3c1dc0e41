import re

import pytest

from silvatrack.llm import html_extract as H
from silvatrack.llm import license_scan as L
from silvatrack.llm import secret_scan as S

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=top><a href="/">Site</a> <ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></header>
<div class="cookie-notice"><p>We use cookies to make this site better for everybody. Accept</p></div>
<!-- no text --><div id=content>%s<h1>Big news</h1><p>First  para of <b>bo</b>ld text &amp; more&nbsp;words
to come here now.</p><div class="ad-slot">Buy now a car</div><p>Second paragraph with<br>enough words to count as content.
<p>Third, not closed, <a href=x>with a link</a> in it<form><input name=q> Your name please</form>%s
<div id="comments"><p>Great article! I like it very much indeed thanks.</p></div></div>
<footer>&copy; 2020 all rights</footer></body></html>"""
WANT = "Big news\nFirst para of bold text & more words to come here now.\nSecond paragraph with enough words to count as content.\nThird, not closed, with a link in it"


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("", ""), ("<div itemprop='articleBody'>", "</div>")])
def test_pages_with_and_without_marks(marks):
    for weights in (H.learn({}), H.learn({"w||p|": (5000, 10), "w|nav 0 links|li|a": (0, 3000), "t||p": (400, 20), "t|ad 0|div": (0, 900)})):
        assert H.main_text(PAGE % marks, weights)[0] == WANT


def test_best_region_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 12))]
        a, b = H.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(0, best)


def page_of(rng, depth=0):
    tags = ["div", "p", "ul", "li", "a", "b", "nav", "form", "h2", "section", "td", "aside"]
    attrs = ["", " class=ad", " id='comments'", " class=\"social-history\"", " hidden", " role=main", " title='a > b'"]
    out = []
    for _ in range(rng.randrange(1, 5)):
        out.append(" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(0, 9))))
        if depth < 4 and rng.random() < 0.7:
            tag = rng.choice(tags)
            out.append(f"<{tag}{rng.choice(attrs)}>{page_of(rng, depth + 1)}" + f"</{tag}>" * (rng.random() < 0.8))
    return "".join(out)


def test_region_of_whole_pages_against_brute_force():
    import random

    rng = random.Random(4)
    found_some = 0
    for _ in range(150):
        page = page_of(rng)
        found, elements, _ = H.tokens(page)
        scores, left = H.scored(found, elements, {})
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
        start, end = H.best_region(scores)
        assert sum(scores[start:end]) == pytest.approx(max(0.0, best), abs=1e-9)
        # Whole blocks of the region, word by word.
        blocks = {found[i].block for i in (start, end - 1)} if end > start else set()
        inside = [t for i, t in enumerate(found) if t.text and not left[i] and (start <= i < end or t.block in blocks)]
        assert "".join(H.main_text(page, {}, whole=False)[0].split()) == "".join("".join(t.text for t in inside).split())
        # An element is left out exactly where what is not left out in it comes to no positive sum.
        plain = [s / H.OUT_SHARE if o else s for s, o in zip(scores, left)]
        within = lambda w, i: w == i or (w >= 0 and within(elements[w].up, i))
        out = {}
        for i in range(len(elements) - 1, -1, -1):
            gone = lambda w: w != i and (out.get(w) or gone(elements[w].up))  # noqa: E731, B023
            out[i] = sum(s for t, s in zip(found, plain) if within(t.where, i) and not gone(t.where)) <= 1e-12
        assert all(left[k] == (t.where >= 0 and any(out[i] for i in out if within(t.where, i))) for k, t in enumerate(found))
        found_some += end > start
    assert found_some > 75


ARTICLE = "<h1>A title of some words</h1><p>" + "some words of running text in here " * 4 + "</p><p>and a second one ends it</p>"
TEXT = "A title of some words\n" + " ".join(["some words of running text in here"] * 4) + "\nand a second one ends it"


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm>{ARTICLE}</form></body>", f"<section class='tags-guide'>{ARTICLE}</section>", f"<div id=promo-code-review>{ARTICLE}</div>",
    f"<div class=search><form><input>Find a page <button>Go</button></form></div><dialog>Stay with us for more news</dialog><div>{ARTICLE}</div><aside>See this too</aside>",
])
def test_names_and_elements_are_no_veto(page):
    assert H.main_text(page, {})[0] == TEXT


FIRST = "<h1>A title</h1><p>" + "words of running text that make a paragraph " * 3 + "</p>"
LAST = "<p>" + "more words of running text that make another " * 3 + "</p>"
#: Parts that an article may begin or end with, and their text.
PARTS = {
    "list": ("<ul><li>one</li><li>two words</li></ul>", "one\ntwo words"),
    "table": ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "a\nb\n1\n2"),
    "links": ("<ul><li><a href=x>one link</a></li><li><a href=y>two</a></li></ul>", "one link\ntwo"),
    "caption": ("<figure><img src=x><figcaption>A short caption</figcaption></figure>", "A short caption"),
    "definitions": ("<dl><dt>Term</dt><dd>what it is</dd></dl>", "Term\nwhat it is"),
    "details": ("<details><summary>More</summary>hidden words</details>", "More\nhidden words"),
    "quote": ("<blockquote>said they</blockquote>", "said they"),
}
LEARNED = {"w||p|": (5000, 10), "w||h1|": (500, 1), "w|nav 0 links|li|a": (0, 3000), "t||p": (400, 20), "t||h1": (50, 1), "t|ad 0|div": (0, 900), "w|footer 0|footer|": (0, 800)}
AROUND = "<body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><div class=ad>Buy a car now</div>{}<div id=comments><p>I like this article very much indeed, thanks for it</p></div><footer>&copy; all rights</footer></body>"


@pytest.mark.parametrize("weights", [{}, H.learn(LEARNED)], ids=["prior", "learned"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "<main><div class=story>{}</div></main>", "{}"])
@pytest.mark.parametrize("part", PARTS)
def test_articles_keep_what_stands_at_their_ends(part, around, weights):
    markup, text = PARTS[part]
    clean = lambda h: "\n".join(" ".join(x.split()) for x in re.sub("<[^>]*>", "\n", h).split("\n") if x.split())
    body = [clean(x) for x in (FIRST, LAST)]
    at_end = H.main_text(AROUND.format(around.format(FIRST + LAST + markup)), weights)[0]
    assert at_end == "\n".join([*body, text])
    title, rest = FIRST.split("</h1>")
    after_title = H.main_text(AROUND.format(around.format(f"{title}</h1>{markup}{rest}{LAST}")), weights)[0]
    assert after_title == "\n".join(["A title", text, clean(rest), body[1]])
    if part != "links" or "article" in around or "main" in around:
        before = H.main_text(AROUND.format(around.format(markup + FIRST + LAST)), weights)[0]
        assert before == "\n".join([text, *body])
    between = H.main_text(AROUND.format(around.format(FIRST + markup + LAST)), weights)[0]
    assert between == "\n".join([body[0], text, body[1]])


@pytest.mark.parametrize("weights", [{}, H.learn(LEARNED)], ids=["prior", "learned"])
def test_headers_and_asides_of_an_article(weights):
    page = AROUND.format(f"<header><h2>Site name</h2></header><article><header><h1>Title</h1><p>by me</p></header>{LAST}<aside>A note aside</aside><aside class=sidebar>Other news</aside><nav><a href=x>next</a></nav></article><aside>Elsewhere today</aside>")
    got = H.main_text(page, weights)[0].split("\n")
    assert got[0] == "Title" and got[1] == "by me" and got[-1] == "A note aside" and len(got) == 4
    page = AROUND.format(f"<div id=wrap><header><a href=/>Site</a> <a href=/x>Menu</a></header><div>{FIRST}{LAST}</div><div><a href=1>more</a> <a href=2>of it</a></div></div>")
    assert H.main_text(page, weights)[0].split("\n")[0] == "A title" and len(H.main_text(page, weights)[0].split("\n")) == 3


def test_menus_without_names_stay_out():
    page = f"<body><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>{FIRST}{LAST}<footer><p>All rights</p></footer></body>"
    assert H.main_text(page, {})[0].startswith("A title") and "rights" not in H.main_text(page, {})[0]


def test_names_learn_from_pages():
    page = f"<div class=widget>{ARTICLE}</div>"
    assert H.labelled_counts(f"<article>{page}</article>") == {}  # inside the mark the name proves nothing
    counts = {f: (50 * a, 50 * b) for f, (a, b) in H.labelled_counts(f"<div class=widget><article>{ARTICLE}</article></div><p>not this</p>").items()}
    assert H.learn(counts)["w|side 2|p|"] > 0 and H.main_text(page, H.learn(counts))[0] == TEXT
    assert [H.name_kind(n) for n in ("ad-slot", "noAds", "social-history", "siteHeader", "entry-header", "comment-list", "load", "tags")] == ["ad", "", "partly", "header", "", "comment", "", "share"]


def test_time_grows_with_the_length_alone():
    import time

    units = ['<a "', "<script ", "<b>x ", "</b>x ", '<a ">"', "<", "<div>", "<!--", "<p><b>x", "<object>", "&#9999", "<td>x", "<div class=ad><p>x", '<a \'"', "<x y='"]
    for unit in units:
        took = []
        for n in (50_000, 100_000, 200_000):
            page = unit * (n // len(unit))
            start = time.process_time()
            H.main_text(page, {})
            took.append(time.process_time() - start)
        assert took[2] < 2 and took[2] < 3.2 * took[1] + 0.1, (unit, took)
    assert H.main_text("<p>x &#" + "9" * 6000 + "; and &#" + "0" * 6000 + "65; y", {})[0] == "x � and A y"


def test_extract_odd_rows(spark):
    long = "<article>" + "".join(f"<p>word{i} and more words</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", PAGE % ("<article>", "</article>"), 0), (1, "u", PAGE % ("<article>", "</article>"), 0), (2, None, None, 1), (3, "v", "", 2), (None, "w", "<p>", 3), (4, "x", "no tags at all & <3 <b", 4), (5, "y", "<nav>menu</nav><script>never closed", 5), (6, "z", long, 6)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == WANT and by[1].n_chars == len(WANT)
    assert (by[2].text, by[3].text, by[None].text, by[5].text) == ("", "", "", "") and by[4].text == "no tags at all & <3 <b"
    assert by[6].text.count("\n") == 19_999 and by[6].text.endswith("word19999 and more words")
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_phrases_against_brute_force(spark, documents, rows):
    extra = [(500, "MIT License, mit-license; the Apache License and GNU general\npublic LICENSE mit licenses"), (501, "license mit"), (502, "mit"), (502, "mit"), (None, "mit license"), (503, None)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((tuple(r)[:6] for r in L.scan(docs).collect()), key=str)
    want = []
    for doc_id, text in [(r[0], r[1]) for r in rows] + extra:
        w = words(text)
        places = [(i, v) for p, v in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        want.append((doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in places}))))
    assert got == sorted(want, key=str)


def test_diagonals(spark):
    mit = next(t for label, t in L.TEMPLATES if label == "mit" and len(t) > 200)
    w = mit.split()
    edited = " ".join(w[:30] + ["really"] + w[31:50] + ["two", "more"] + w[50:])
    docs = [(1, "before " * 50 + edited + " after"), (2, " ".join(w[:12])), (3, " ".join(sorted(w))), (4, "x " * 9 + "Licensed under CC BY-NC 4.0. y"), (5, edited + " z" * 20 + " " + mit)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(df).collect()}
    assert got[1][0] == "mit" and 0.8 < got[1][1] < 1
    assert got[2] == ("", 0.0) and got[3] == ("", 0.0) and got[4] == ("cc-by-nc-4.0", 1.0)
    found = [(r.doc_id, r["first"], r.past) for r in L.spans(df).filter("label = 'mit'").collect()]
    n = len(words(mit))
    assert (1, 50, 50 + n + 2) in found and len([f for f in found if f[0] == 5]) == 2
    few, L.MAX_BROADCAST_GRAMS = L.MAX_BROADCAST_GRAMS, 10
    assert {r.doc_id: (r.labels, r.score) for r in L.scan(df).collect()} == got
    L.MAX_BROADCAST_GRAMS = few
    assert L.scan(df.limit(0)).collect() == [] and L.scan(df, templates=[]).filter("labels <> ''").count() == 0


def secret(i):
    import hashlib

    return hashlib.sha1(str(i).encode()).hexdigest()


def test_secrets_and_look_alikes(spark):
    docs = []
    for i in range(120):
        kind = i % 4
        body = {
            0: f'config token = "{secret(i)}" end',
            1: f"see commit {secret(i)} for more",
            2: f"a verylongordinaryword{'abcdefghij'[i % 10]}ness here",
            3: f"card 4{i:015d} was used",
        }[kind]
        docs.append((i, f"the words of document stand here {body} and the words go on", f"src{i % 3}"))
    docs += [(200, None, "s"), (201, "", None), (None, f'api_key: "{secret(1000)}"', "s"), (3, docs[3][1], "src0"), (202, "password = 'xxxxxxxxxxxxxxxxxxxxxxxx'", "s"), (203, "A" * 5000 + " key", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    df = df.selectExpr("*", "1 AS value", "'a' AS label", "2 AS pos", "3 AS c", "4 AS before", "5 AS features", "6 AS near")
    got = S.scan(df).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_secrets == (1 if i % 4 == 0 else 0) for i in range(120))
    assert by[None].n_secrets == 1 and by[200].n_candidates == by[201].n_candidates == 0 and by[202].n_secrets == by[203].n_secrets == 0
    assert by[0].first_secret == docs[0][1].index(secret(0)) + 1
    labelled = spark.createDataFrame([(secret(i), 0.0 if i % 4 == 1 else 1.0) for i in range(100)] + [(f"verylongordinaryword{c}ness", 0.0) for c in "abcdefghij"], "value string, label double")
    given = {r.doc_id: r.n_secrets for r in S.scan(df, labelled).collect()}
    assert all(given[i] == (1 if i % 4 == 0 else 0) for i in range(0, 120) if i % 4 != 3)
    assert S.scan(df.limit(0)).collect() == []
    assert {r.n_secrets for r in S.scan(df.filter("doc_id = 0")).collect()} == {1}


def test_every_place_of_a_value_counts(spark):
    key, other = secret(1), secret(2)
    text = f"é sha256: {key} then xx{other}yy and\n{'w ' * 90} api_key = \"{key}\" or {other}"
    docs = [(1, text, "s"), (1, text, "s")] + [(10 + i, f"see commit {secret(50 + i)} or token = '{secret(90 + i)}'", "s") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted((r.pos, r.value, r.before, r.after) for r in S.candidates(df, 32).filter("doc_id = 1").collect())
    want = [(m.start() + 1, m[0], text[max(0, m.start() - 32) : m.start()], text[m.end() : m.end() + 32]) for m in re.finditer("[A-Za-z0-9+/=_-]{16,}", text)]
    assert got == want and [v for _, v, _, _ in got].count(key) == 2
    row = S.scan(df).filter("doc_id = 1").first()
    assert row.n_candidates == 3 and row.n_secrets >= 1 and row.first_secret is not None


def test_long_runs_and_their_parts_are_judged(spark):
    import hashlib

    block = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20))
    path = "/".join(["longpathsegment"] * 60) + "/token=" + secret(7)
    docs = [(1, f'private_key = "{block}"', "s"), (2, f"go to {path} now", "s"), (3, "-_" * 20_000, "s")]
    docs += [(10 + i, f"see commit {secret(50 + i)} or token = '{secret(90 + i)}'", "s") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {(r.doc_id, r.value): r.pos for r in S.candidates(df).filter("doc_id < 10").collect()}
    assert got == {(1, block): 16, (2, secret(7)): docs[1][1].index(secret(7)) + 1, (3, "-_" * 20_000): 1}
    by = {r.doc_id: r for r in S.scan(df).collect()}
    assert by[1].n_candidates == 1 and by[1].n_secrets == 1 and by[2].n_candidates == by[2].n_secrets == 1 and by[3].n_secrets == 0


def chars(i, n, alphabet="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    import random

    rng = random.Random(f"{i}:{n}:{alphabet}")
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_the_same_at_every_length(spark):
    """An = or a / parts a run wherever it stands, and padding belongs to its value."""
    docs = []
    for i, n in enumerate((16, 40, 300, 600, 4000)):
        key = chars(i, n)
        docs.append((i, f"x NAME_OF={key} y /usr/{chars(i + 50, 10)}/{key}/b and 'a+{key}==' z", "s"))
    got = {}
    for r in S.candidates(spark.createDataFrame(docs, "doc_id long, text string, source string"), 16).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.value, r.before[-3:], r.after[:1]))
    for i, text, _ in docs:
        key = text.split("=")[1].split()[0]
        second = text.index(f"/{key}/") + 1
        assert sorted(got[i]) == [(11, key, "OF=", " "), (second + 1, key, text[second - 3 : second], "/"), (text.index("a+") + 1, f"a+{key}==", "d '", "'")]


HEX = "0123456789abcdef"
#: Lines with a secret (in brackets) and lines without, that no document the forest learns from has.
SECRET_LINES = [
    "export AWS_ACCESS_KEY_ID=[AKIA{ABCDEFGHIJKLMNOP234567:16}]", "GITHUB_TOKEN=[ghp_{:36}]", "DB_PASSWORD=[Sup3rS3cret{0123456789:2}]", "api_key=[{hex:32}]", "aws_secret_access_key = [{:18}/{:8}/{:12}]",
    "Authorization: Bearer [{:40}]", "https://x.org/?api_key=[{hex:40}]", "client-secret: '[{:30}]'", '"auth_token": "[{:26}]",',
]
PLAIN_LINES = [
    "https://cdn.site.com/a/{hex:32}.js", "blob {hex:64}", "commit {hex:40}", '<img src="data:image/png;base64,{:50}/{:900}/{:700}+{:2000}==">', "see /usr/lib/longpathsegment1/another-long-segment/a-third-long-one there",
    "id: 550e8400-e29b-41d4-a716-44665544{hex:4}", "password = your_password_here", "etag: {hex:32}", "2024-01-01T00:00:00-some-file-name-here",
]


def filled(line, i):
    return re.sub(r"\{(\w*):(\d+)\}", lambda m: chars(f"{i}{line}{m.start()}", int(m[2]), *([HEX] if m[1] == "hex" else [m[1]] if m[1] else [])), line)


def test_names_values_and_their_look_alikes(spark):
    """Lines of known kinds among documents of others; verdicts are held against the truth."""
    docs = [(10_000 + i, f"see commit {secret(50 + i)} or token = '{secret(90 + i)}' and password = 'Qx{i}7!kd' in words", "s") for i in range(60)]
    truth = {}
    for kind, lines in ((True, SECRET_LINES), (False, PLAIN_LINES)):
        for n, line in enumerate(lines):
            for i in range(3):
                text, doc_id = filled(line, i), len(truth)
                truth[doc_id] = re.findall(r"\[(.*)\]", text) if kind else []
                docs.append((doc_id, f"some words\n{re.sub(r'[][]', '', text) if kind else text}\nand more", "src"))
    block = "-----BEGIN {0}-----\n" + "\n".join(chars(i, 64) for i in range(12)) + "\n-----END {0}-----"
    for name in ("RSA PRIVATE KEY", "CERTIFICATE"):
        truth[len(truth)] = [block.format(name)] if "PRIVATE" in name else []
        docs.append((len(truth) - 1, f"a\n{block.format(name)}\nb", "src"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found: dict = {}
    for r in S.judge(df).filter("doc_id < 10000 AND secret").collect():
        found.setdefault(r.doc_id, set()).add(r.value)
    missed = [truth[i] for i in truth if truth[i] and not any(v in t for t in truth[i] for v in found.get(i, ()))]
    wrong = [(docs[60 + i][1], found[i]) for i in found if not truth[i]]
    assert not missed and not wrong
    exact = [i for i in truth if truth[i] and "PRIVATE" not in truth[i][0]]
    assert sum(found[i] == set(truth[i]) for i in exact) >= 0.9 * len(exact)  # the bare value


def test_short_values_behind_key_words(spark):
    docs = [(1, 'set password = "hunter2pw!x", or pwd: s3cr3t.Va1ue. Then\n{"api_key": "zz91"} token=ab12cd34ef', "s"), (2, "the secret is out; password: nothing", "s")]
    docs += [(10 + i, f"see commit {secret(50 + i)} or token = '{secret(90 + i)}' and password = 'Qx{i}7!kd'", "s") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = {(r.doc_id, r.value): (r.pos, r.before[-4:], r.after[:1]) for r in S.candidates(df).filter("doc_id < 10").collect()}
    text = docs[0][1]
    want = {(1, v): (text.index(v) + 1, text[: text.index(v)][-4:], text[text.index(v) + len(v)] if text.index(v) + len(v) < len(text) else "") for v in ("hunter2pw!x", "s3cr3t.Va1ue", "ab12cd34ef")}
    assert found == want | {(2, "nothing"): (docs[1][1].index("nothing") + 1, "rd: ", "")}
    assert S.scan(df).filter("doc_id = 1").first().n_secrets >= 1


def test_forest_judges_what_no_rule_is_sure_of(spark):
    """Findings of a known kind, most of them without a label; the forest is held against the truth."""
    import random

    rng = random.Random(7)
    base = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: rng.choice(["window", "garden", "station", "morning", "letter", "number", "river", "yellow"])
    made = lambda: "".join(rng.choice(["win", "gar", "sta", "mor", "let", "num", "riv", "yel", "den", "ter", "ing"]) for _ in range(3))
    docs, truth = [], {}
    for i in range(500):
        key = "".join(rng.choice(base) for _ in range(rng.randrange(20, 44)))
        kind = i % 5
        body = {
            0: f'token = "{key}"', 1: f"use {key} for it", 2: f"at {word()}_{word()}_{word()}{rng.randrange(10)} of it",
            3: f"{word()}{made().title()}{made().title()}{rng.randrange(9)}", 4: f"commit {secret(i)}",
        }[kind]
        value = re.findall("[A-Za-z0-9_]{16,}", body)
        truth[i] = bool(value) and kind < 2
        docs.append((i, f"{word()} {word()} and {word()} stand here {body} and {word()} goes on with {word()}", f"src/{word()}{i % 3}.txt"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = S.labelled_findings(df).cache()
    free = found.filter("label IS NULL")
    assert free.filter("doc_id % 5 IN (1, 3)").count() > 150
    judged = [(r.doc_id, r.secret) for r in S.judge(df).filter("label IS NULL").collect()]
    hit = sum(s and truth[i] for i, s in judged)
    precision, recall = hit / max(1, sum(s for _, s in judged)), hit / max(1, sum(truth[i] for i, _ in judged))
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)
    seen = S.quality(found)
    assert seen["n"] >= 20 and seen["precision"] >= 0.95 and seen["recall"] >= 0.95
    assert S.quality(found, mask=True)["recall"] >= 0.8
