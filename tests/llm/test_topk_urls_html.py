import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from sparkvoice.llm import html, topk, urls


def brute(rows, is_query, k=10):
    """As the query's SQL: every row is a candidate for every query row of another id."""
    held, by = [], {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    for q, v in held:
        if is_query(q):
            by.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q)
    return sorted((q, r + 1, i, -x) for q, s in by.items() for r, (x, i) in enumerate(sorted(s)[:k]))


@pytest.mark.parametrize("block", [64, 8192])
def test_topk_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROW_BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.standard_normal(8) * rng.integers(1, 4)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.5, 0.25]), (None, [1.0] * 8), rows[0], (10, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, query_id int")
    got = topk.top_k(spark, df, lambda c: c % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_topk_few_rows_and_huge_values(spark):
    df = spark.createDataFrame([(0, [1e12, 2e12]), (1, [3e12, -1e12]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(spark, df, lambda c: c == 0).collect()))
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 3 * 1024 * 1024 * 10**12)]
    assert topk.top_k(spark, df.limit(0), lambda c: c == 0).count() == 0


def test_bounds_skip_candidates():
    rng = np.random.default_rng(1)
    rows = np.floor(np.vstack([rng.normal(0, 0.05, (50, 4)) + c for c in rng.normal(0, 5, (80, 4))]) * 1024)
    longest = float((rows * rows).sum(1).max())
    lift = np.hstack([rows, np.sqrt(longest - (rows * rows).sum(1))[:, None]])
    pivots = topk.choose_pivots(lift[::10], 32)
    d = np.sqrt(((lift[:, None] - pivots) ** 2).sum(2))
    q = np.append(rows[7], 0.0)
    best, seen = topk.search_block(np.arange(len(rows)), rows, d, 7, rows[7], np.sqrt(((q - pivots) ** 2).sum(1)), float((q * q).sum()) + longest, None, 5)
    assert seen < len(rows)
    want = sorted((-int(rows[i] @ rows[7]), i) for i in range(len(rows)) if i != 7)[:5]
    assert best == [(-s, i) for s, i in want]


URLS = [
    (1, "http://A.Example.com/en/7/x?q=1#z", "a.example.com", "/en/7/x", "example.com/en/7", "allow"),
    (2, "https://www.foo.com/en/1", "www.foo.com", "/en/1", "com/en/", "block"),
    (3, "https://com/en/", "com", "/en/", "com/en/", "block"),
    (4, "https://xcom/en/", "xcom", "/en/", None, None),
    (5, "https://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
    (6, "https://b.net/de/81", "b.net", "/de/81", "net/de/", "block"),
    (7, "HTTP://B.org?x/es/", "b.org", "", None, None),
    (8, None, "", "", None, None),
    (9, "no scheme/en/", "", "", None, None),
    (10, "", "", "", None, None),
    (11, "x://y.org/es/#://z", "y.org", "/es/", "org/es/", "block"),
    (12, "ftp://\u00c4.org/es/a", "\u00c4.org", "/es/a", "org/es/", "block"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u, *_ in URLS] + [(2, URLS[1][1], "x", "y")], "page_id long, url string, host string, rule string")
    out = urls.judge(spark, df).collect()
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in out)
    want = Counter((i, h, p, r) for i, _, h, p, r, _ in URLS) + Counter([(2, *URLS[1][2:5])])
    assert got == want
    ruled = {i: v for i, *_, v in URLS}
    for r in out:
        assert r["verdict"] in ("allow", "block") and ruled[r["page_id"]] in (None, r["verdict"])
    assert urls.judge(spark, df.limit(0)).count() == 0


def test_url_rules_say_the_words_of_the_contract(spark):
    assert Counter(urls.RULES) == Counter([("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")])
    said = {"http://a.com/en/1": "block", "http://www.example.com/en/71": "allow", "http://b.net/de/81": "allow", "http://example.net/de/7": "allow", "http://example.net/de/81": "block", "http://c.org/es/1": "block"}
    out = urls.judge(spark, spark.createDataFrame(list(enumerate(said)), "page_id long, url string")).collect()
    assert {list(said)[r["page_id"]]: r["verdict"] for r in out} == said


def test_url_models_block_what_looks_like_rejected_urls(spark):
    rows = [(i, f"http://casino{i}.spam.test/win/{i}") for i in range(300)] + [(1000 + i, f"http://news{i}.good.test/story/{i}") for i in range(300)]
    rows += [(5000, "http://casino77.other.test/win/7"), (5001, "http://news77.other.test/story/7")]
    out = urls.judge(spark, spark.createDataFrame(rows, "page_id long, url string"), rules=[("block", "spam.test", "/")], wrong=0.02)
    said = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert said[5000] == "block" and said[5001] == "allow"
    assert sum(said[1000 + i] == "block" for i in range(300)) <= 12


def test_url_scores_match_the_models_definition(spark):
    """delta of a window against counts taken by hand."""
    windows = [("abcde", 3, 1), ("bbcde", 2, 0), ("abcdf", 0, 4), ("xxxxe", 5, 5)]
    got = {r["w"]: r["delta"] for r in urls.window_weights(spark.createDataFrame(windows, "w string, a long, r long")).collect()}
    for w, *_ in windows:
        p = {}
        for m in (1, 2):
            x = 1 / urls.ALPHABET
            for k in range(urls.ORDER + 1):
                gram = sum(c[m] for c in windows if c[0].endswith(w[urls.ORDER - k :]))
                seen = sum(c[m] for c in windows if c[0][urls.ORDER - k : urls.ORDER] == w[urls.ORDER - k : urls.ORDER]) if k else sum(c[m] for c in windows)
                pull = urls.PULL if k else urls.ALPHABET
                x = (gram + pull * x) / (seen + pull)
            p[m] = x
        assert got[w] == pytest.approx(math.log10(p[1] / p[2]))


ARTICLE = "<p>First paragraph, with commas, and enough words to count as text.</p><p>Short.</p><h2>Part</h2><p>Second &amp; last&nbsp;one,\n  with <b>bold</b> and <a href=x>a link</a> in it.</p>"
TEXT = "First paragraph, with commas, and enough words to count as text.\nShort.\nPart\nSecond & last one, with bold and a link in it."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title></head><body><nav><a href=a>A</a></nav><article>{ARTICLE}</article><footer>foot, foot, foot</footer></body></html>",
        f"<div class=sidebar><p>Side text, with commas, and quite a lot of words in it too.</p></div><div id=content>{ARTICLE}</div><div id='comments'><p>A reader, says, a great many words about this article here.</p></div>",
        f"<script>var x='<p>no, no, no, no</p>';</script><style>p{{}}</style><main>{ARTICLE}<form><p>Sign up, now, please, for our long letter of news.</p></form></main>",
        f"<body><header><h1>Site</h1></header><div role=navigation><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><!-- <p>no</p> --><section>{ARTICLE}</section><aside>more</aside>",
        f"<body><div class='cookie-notice'><p>We use cookies, and more cookies, in many ways, so agree please.</p></div><article>{ARTICLE.replace('</p>', '')}",
    ],
)
def test_main_text(page):
    assert html.extract(page) == TEXT


def test_html_odd_input(spark):
    assert html.extract(None) == "" == html.extract("") == html.extract("<nav>x</nav>")
    assert html.extract("plain words") == "plain words"
    assert html.extract("<p>a<p>b<br>c</div></b>") == "a\nb c"
    assert html.extract("<div>" * 20_000 + "deep words, that are long enough to count") == "deep words, that are long enough to count"
    long = "word, " * 200_000
    assert html.extract(f"<article><p>{long}</p></article>") == long.strip()
    df = spark.createDataFrame([(1, None, None, "a"), (2, "u", f"<p>{'x' * 30}</p>", "b"), (2, "u", f"<p>{'x' * 30}</p>", "b")], "page_id long, url string, html string, text string")
    assert Counter(map(tuple, html.main_text(df).collect())) == Counter([(1, None, "", 0), (2, "u", "x" * 30, 30), (2, "u", "x" * 30, 30)])
    assert html.main_text(df.limit(0)).count() == 0


def test_html_scores_choose_the_container():
    """The text lies outside the only article element, which is a short teaser."""
    decoy = "<article><h3>Read next</h3><p>A teaser, short as it is, of another page.</p></article>"
    prose = "".join(f"<p>Paragraph {i} of the text, with commas, with clauses, and with more than enough words to score well.</p>" for i in range(6))
    out = html.extract(f"<html><body><div class=x>{prose}</div><div class=y>{decoy}</div></body></html>")
    assert out == "\n".join(f"Paragraph {i} of the text, with commas, with clauses, and with more than enough words to score well." for i in range(6))
    links = "".join(f"<li><a href={i}>A long link, with commas, to another page of this site, number {i}</a></li>" for i in range(30))
    assert html.extract(f"<div><ul>{links}</ul></div><div>{prose}</div>") == out


def test_html_container_against_brute_force():
    rng = random.Random(12)
    for _ in range(200):
        divs = []
        for d in range(rng.randint(1, 5)):
            ps = []
            for k in range(rng.randint(1, 5)):
                words_ = " ".join(f"w{d}x{k}y{j}" + rng.choice(["", "", ","]) for j in range(rng.randint(1, 40)))
                ps.append((words_, rng.random() < 0.2))
            divs.append(ps)
        page = "<html><body>" + "".join("<div>" + "".join(f"<p><a href=x>{t}</a></p>" if a else f"<p>{t}</p>" for t, a in ps) + "</div>" for ps in divs) + "</body></html>"
        points = [sum(1 + t.count(",") + min(len(t) / 100, 3.0) for t, _ in ps if len(t) >= 25) for ps in divs]
        whole, linked = [sum(len(t) for t, _ in ps) for ps in divs], [sum(len(t) for t, a in ps if a) for ps in divs]
        if not any(points):
            continue
        menu = [len(ps) >= 2 and k > 0.66 * n for ps, n, k in zip(divs, whole, linked)]
        rate = [p * (1 - k / n) for p, n, k in zip(points, whole, linked)]
        body = 0.5 * sum(points) * (1 - sum(linked) / sum(whole))
        if any(abs(a - b) < 1e-9 for a, b in itertools.combinations([*[r for r, p in zip(rate, points) if p], body], 2)):
            continue
        if body > max(rate):
            kept = [not m for m in menu]
        else:
            least = max(10.0, 0.2 * max(rate))
            kept = [r == max(rate) or bool(p) and r >= least for r, p in zip(rate, points)]
        assert html.extract(page) == "\n".join(t for ps, k in zip(divs, kept) if k for t, _ in ps)


@pytest.mark.parametrize("part", ["<a x='", "<a ", "<a '>' ", "<p class=\"x' ", "<a x=\">", "<!--", "</p", "<script>", "<p>"])
def test_html_broken_markup_takes_linear_time(part):
    start = time.perf_counter()
    html.extract(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 6


def test_url_verdicts_against_brute_force(spark):
    """Whole verdicts: halves, models of the other half, threshold; a very long, a null and repeated URLs among them."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    us = [f"http://{word()}.{rng.choice(['spam', 'good'])}.test/{word()}/{word()}" for _ in range(250)]
    us += [us[3], us[3], None, "", "http://long.test/" + "ab" * 3000]
    df = spark.createDataFrame(list(enumerate(us)), "page_id long, url string")
    rules = [("block", "spam.test", "/")]
    out = urls.judge(spark, df, rules=rules, wrong=0.05).collect()
    halves = {(r["host"], r["path"]): r["h"] for r in spark.createDataFrame([(r["host"], r["path"]) for r in out], "host string, path string").selectExpr("host", "path", "pmod(xxhash64(host, path), 2) AS h").collect()}
    counts = Counter((r["host"], r["path"]) for r in out)
    bad = {(r["host"], r["path"]) for r in out if r["rule"]}
    grams = {}
    for (h, p), n in counts.items():
        text = "\x02" * urls.ORDER + h + p + "\x03"
        for i in range(urls.ORDER, len(text)):
            for k in range(urls.ORDER + 2):
                c = grams.setdefault((halves[h, p], (h, p) in bad), Counter())
                c[text[i - k + 1 : i + 1] if k else ""] += n
                if k:
                    c["before", text[i - k + 1 : i]] += n
    def score(h, p):
        text, out_ = "\x02" * urls.ORDER + h + p + "\x03", 0.0
        for i in range(urls.ORDER, len(text)):
            for sign, b in ((1, False), (-1, True)):
                c, x = grams.get((1 - halves[h, p], b), Counter()), 1 / urls.ALPHABET
                for k in range(urls.ORDER + 1):
                    pull = urls.PULL if k else urls.ALPHABET
                    x = (c[text[i - k : i + 1]] + pull * x) / (c["before", text[i - k : i]] + pull)
                out_ += sign * math.log10(x)
        return out_ / (len(h) + len(p) + 1)
    want = {u: score(*u) for u in counts}
    for r in out:
        assert r["score"] == pytest.approx(want[r["host"], r["path"]], abs=1e-9)
    fine = sorted(math.floor(want[u] * urls.BIN) for u, n in counts.items() if u not in bad for _ in range(n))
    limit = next(b for b in dict.fromkeys(fine) if sum(x <= b for x in fine) > 0.05 * len(fine)) / urls.BIN
    for r in out:
        u = (r["host"], r["path"])
        assert r["verdict"] == ("block" if u in bad or want[u] < limit else "allow")
    said = [r["verdict"] == "block" for r in out if not r["rule"]]
    assert 0 < sum(said) <= 0.05 * len(said)
