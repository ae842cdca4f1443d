"""Operators on documents and pages against plain Python."""

import hashlib
import html
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartograph.llm import html_text, mixing, pii, quality, syncmers, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("which", ["tricky", "docs", "nothing"])
def test_quality_statistics(which, request):
    df = request.getfixturevalue(which)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect()), key=str)
    want = []
    for r in df.collect():
        s = brute_stats(r.text)
        want.append((r.doc_id, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(want, key=str)


def test_outliers_go_and_good_documents_stay(spark):
    rnd = random.Random(4)
    good = [(i, " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(rnd.randint(60, 400))), "en", f"s{i % 2}") for i in range(300)]
    bad = [(1000 + i, " ".join("x#*$%&|" for _ in range(100 + i)) + " " + " ".join(map(str, range(200))), "en", "s0") for i in range(30)]
    few = [(2000 + i, good[i][1], "xx", "rare") for i in range(3)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[k] for k, *_ in bad) and all(got[k] for k, *_ in few)
    assert sum(got[k] for k, *_ in good) >= 297
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 5) - 0.75) < 1e-9 and abs(quality.chi2_quantile(0.5, 2) - 1.3862943611) < 1e-6


# personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(BASE):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
            if name == "email" or (name == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (name == "card" and 12 <= len(d) <= 19 and luhn) or (name == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


TEXTS = [
    None, "", "a@b.c_d@e.f x@y.z.", "@@ a@ @b.c a@b", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.01 1.2.3", "4111-1111 1111 1111 4111 1111 1111 1111 22 4111111111111112",
    "+1 (743) 555-3824 +12 3 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 é +49 30 1234567.", "ünï a.b+c@x-y.example.com\n😀 10.0.0.1 4111111111111111", "1 2 " * 3000 + "9" * 5000,
]


def test_base_spans(spark, docs):
    rnd = random.Random(6)
    noise = ["".join(rnd.choices("1234567890 -.@+(ab", k=rnd.randint(5, 60))) for _ in range(1500)]
    noise += ["4111111111111111"[: rnd.randint(10, 16)] + "".join(rnd.choices("- .@+a", k=3)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(TEXTS + noise)), "doc_id long, text string").union(docs.select(docs.doc_id + 10_000, "text"))
    got = {r.doc_id: r.b for r in pii.find(df).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()}
    bad = [(r.text[:80], got[r.doc_id], brute_spans(r.text)) for r in df.collect() if got[r.doc_id] != brute_spans(r.text)]
    assert not bad, bad[:3]


def test_secrets_and_redaction(spark):
    rnd = random.Random(8)
    hexes = ["".join(rnd.choices("0123456789abcdef", k=40)) for _ in range(40)]
    rows = [(i, f'see a@b.example.com token = "{h}" end') for i, h in enumerate(hexes)] + [(100 + i, f"the order number {10**12 + i * 7919} came") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t for r in pii.find(df, keep=("text",)).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert all(got[i] == 'see [EMAIL] token = "[SECRET]" end' for i in range(40))
    assert sum("[SECRET]" in got[100 + i] for i in range(40)) == 0
    share, rel = pii.reliabilities({0b10101: 50, 0: 50, 0b00010: 20})
    assert rel[0][0] > 0.7 and rel[0][1] < 0.2 and 0.2 < share < 0.7


def test_pii_edges(tricky, nothing):
    assert pii.find(tricky).count() == tricky.count() and pii.find(nothing).count() == 0


# syncmers


@pytest.mark.parametrize("which", ["tricky", "docs", "nothing"])
def test_edited_texts(which, request):
    df = request.getfixturevalue(which)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in syncmers.fingerprint_edits(df).collect()), key=str)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = []
    for i, (d, t) in enumerate(rows):
        h = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - h] + rows[(i + 1) % len(rows)][1][:h]).encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("bucket", [1, 7, 5000])
def test_next_document_for_any_bucket(spark, bucket):
    ids = random.Random(bucket).sample(range(10**9), 60)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    ids.sort(reverse=True)
    want = {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    assert {r.doc_id: r.next_text for r in syncmers.with_next(df, F.length, bucket).collect()} == want


def test_likeness(spark):
    rnd = random.Random(3)
    w = [f"w{rnd.randint(0, 5000)}" for _ in range(600)]
    other = [f"v{i}" for i in range(600)]
    pairs = [(w, w), (w, other), (w, w[:300] + other[:300]), (w, ["new"] * 4 + w), (w, w[400:] + w[:400]), ([], []), ([], w), (["a"], ["a"])]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.select("i", syncmers.anchors(F.col("a")).alias("x"), syncmers.anchors(F.col("b")).alias("y"))
    got = {r.i: r.s for r in df.select("i", syncmers.likeness(F.col("x"), F.col("y")).alias("s")).collect()}
    assert got[0] == 1 and got[1] == 0 and 0.15 < got[2] < 0.55 and got[3] > 0.9 and 0.4 < got[4] < 0.9 and got[5] == 1 and got[6] == 0 and got[7] == 1


# mixing


@pytest.mark.parametrize("which", ["tricky", "docs", "nothing"])
def test_mix(which, request):
    df = request.getfixturevalue(which)
    rows = df.collect()
    got = mixing.mix(df).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows), key=str)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target, open_ = {}, {s: 1 + i % 3 for i, s in enumerate(names)}
    total = float(sum(size.values()))
    while open_:
        level = (total - sum(target.values())) / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > 3 * size[s]]
        if not full:
            target |= {s: w * level for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            del open_[s]
    by = {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        key = None if r._key == "t" else r._key[1:]
        assert r.source_size == size[key] and abs(r.target - target[key]) < 1e-6 * max(1, target[key])
        by[key] = by.get(key, 0) + r.taken
    if which == "docs":
        assert all(abs(by[s] - target[s]) < 0.1 * target[s] + 60 for s in by)


# URLs

RULES = [url_rules.Rule("com", "/en/", "block"), url_rules.Rule("example.com", "/en/7", "allow"), url_rules.Rule("net", "/de/", "allow"), url_rules.Rule("example.net", "/de/8", "block"), url_rules.Rule("org", "/es/", "block")]


def brute_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = max((r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: r.length, default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


def test_url_rules(spark, sf):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/71?x#y", "http://example.com/en/", "http://notexample.com/en/7", "x://example.net/de/8", "x://a.b.example.net/de/9", "x://com/en/", "x://com", "x://.com/en/", "x://é.org/es/ü", "x://org/es/" + "z" * 50_000, "a://b://com/en/", "x://com\x02/en/", "x://net/de/\x01"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").union(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id") + 1000, "url", "url"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, RULES).collect()}
    assert got == {r.page_id: brute_judge(r.url) for r in pages.collect()}
    assert url_rules.judge(pages.limit(0), RULES).count() == 0


def test_wildcards_over_words():
    globs = [("ex*le.org", "/a*b"), ("com", "/x?z"), *((f"h{i}.net", f"/p{i}") for i in range(40))]
    urls = [("www.example.org", "/aXXb1"), ("exle.org", "/ab"), ("com", "/xyz"), ("com", "/xz"), ("a.h39.net", "/p39/q"), ("ah39.net", "/p39")]
    m = url_rules.Automaton(globs).match(urls)
    assert [set(m[i].nonzero()[0]) for i in range(6)] == [{0}, {0}, {1}, set(), {41}, set()]


# pages


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class='menu-open'><header>Site</header><nav><ul><li>a</ul></nav>"
        "<!-- <p>no</p> --><div class=\"ad\">buy</div><article><header><h1>Head  &amp;\n line</h1></header><p>One <b>two<br>three<p>four &lt;x&gt; &eacute;"
        "<script>var a='</p>';</script><aside>side</aside><form>f<input></form><div id='comments'><p>reader</p></div></article><div title='a>b'>tail</div><footer>f</footer></body></html>"
    )
    assert html_text.blocks(page) == [
        ("Site", 2), ("a", 2), ("buy", 2), ("Head & line", 0), ("One two three", 0), ("four <x> é", 0), ("side", 2), ("f", 2), ("reader", 2), ("tail", 1), ("f", 2),
    ]
    assert html_text.blocks(None) == [] and html_text.blocks("plain < text") == [("plain < text", 1)] and html_text.blocks("<!-- open") == []


def test_common_lines():
    rnd = random.Random(3)
    for _ in range(3000):
        a, b = (rnd.choices("abcde", k=rnd.randint(0, 9)) for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        kept = [x for x, k in zip(a, html_text.common_lines(a, b)) if k]
        it = iter(b)
        assert len(kept) == d[-1][-1] and all(x in it for x in kept)


def test_template_goes_and_articles_stay(spark, sf):
    frame = ["Welcome to the site", "All rights reserved"]
    plain = [(i, f"http://h.org/a/{i}", "<body>" + "".join(f"<div>{x}</div>" for x in [frame[0], *(f"story {i} line {k} " * 5 for k in range(4)), frame[1]])) for i in range(5)]
    df = spark.createDataFrame([*plain, (9, None, None), (10, "http://z.org/", ""), (11, "http://h.org/b", "<article><p>Welcome to the site</article>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(frame[0] not in got[i] and got[i].count("\n") == 3 for i in range(5)) and got[9] == got[10] == "" and got[11] == frame[0]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        art = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x).replace("<br>", " "))).strip() for x in re.split(r"</?(?:p|h1)>", art)]
        assert got[r.page_id] == ("\n".join(x for x in lines if x), len("\n".join(x for x in lines if x)))
    assert html_text.extract(df.limit(0)).count() == 0
