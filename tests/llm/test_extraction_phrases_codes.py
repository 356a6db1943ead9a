"""HTML extraction, phrase collocations and vector codes against plain versions and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberlog.llm import codes, phrases, templates
from emberlog.llm.markup import Page


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- HTML


def main_text(html):
    page = Page(html)
    return page.text([False] * len(page.hashes))[0]


@pytest.mark.parametrize("html, want", [
    ("", ""),
    ("no markup at all", "no markup at all"),
    ("<article><h1>A &amp; B</h1><p><b>one <i>two</i>\n\t three<br>four<br><p>five</article><p>outside", "A & B\none two three four\nfive"),
    ("<p>a<p>b</p>c<div>d</p>e</div>", "a\nb\nc\nd\ne"),
    ("<body><nav>menu<ul><li>x</ul></nav><div class='ad top'>buy</div><p>text</p><footer>f</footer>", "text"),
    ("<main><p>a</p><aside>b</aside><form>c<p>d</form><section id=comments><article>e</article></section><p>f", "a\nf"),
    ("<div class='has sidebar'><article>kept</article>dropped</div>", "kept"),
    ("<div role=main>kept</div><div role='navigation'>dropped</div>", "kept"),
    ("<p>a<script>var t='</p>';</script>b<style>p{}</style><!-- <p>no</p> -->c", "abc"),
    ("<p>a</p><script>never closed <p>b", "a"),
    ("<p>a <!-- never closed <p>b", "a"),
    ("<article><p>&lt;p&gt; &#233;&#xe9;&nbsp;&eacute; &am &amp &unknown; &#0;</p></article>", "<p> éé é &am & &unknown; �"),
    ("<p>1 < 2 and 3 > 2 <3</p>", "1 < 2 and 3 > 2 <3"),
    ("<p title='a > b' data-x=\"</p>\">kept</p>", "kept"),
    ("<p title='never closed>a</p><p>b", "a\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</div></table><ul><li>x<li>y</ul>", "a\nb\nc\nx\ny"),
    ("<P>UPPER</P><ARTICLE>In</ARTICLE>", "In"),
    ("<article> </article><p>only the rest has text", "only the rest has text"),
    ("<article><header>dropped</header><p>kept</p><span class=advert>dropped</span> too</article>", "kept\ntoo"),
    ("<div>a<span class=ad>b<p>c</p>d</span>e</div>", "a\ne"),
    ("a" * 300_000 + "<p>" * 50_000, "a" * 300_000),
])
def test_main_text(html, want):
    assert main_text(html) == want


def site_of(spark):
    """A host whose unmarked parts recur, and articles that share a paragraph."""
    rows = []
    for i in range(40):
        body = f"<div>Our site</div><p>story {i}</p><p>said often</p><div><p>Contact <b>us</b></p><p>{i}</p></div>"
        rows.append((i, "http://a.example/x", f"<html><body>{body}</body></html>"))
        rows.append((100 + i, "http://b.example/x", f"<html><body><div>Our site</div><article><p>story {i}</p><p>said often</p></article></body></html>"))
    rows += [(200 + i, "http://c.example/x", "<body><p>one page, many copies</p></body>") for i in range(30)]
    rows += [(300, "http://d.example/x", "<body><div>Our site</div><p>story</p></body>")]
    rows += [(None, None, None), (400, "no host", ""), (400, None, "<p>x"), (400, None, "<p>x")]
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id long, url string, html string, host string, page int")


def test_recurring_subtrees_go_and_articles_stay(spark):
    pages = site_of(spark)
    rule = templates.Rule(pages=10, share=0.01)
    got = templates.extract(pages, rule).collect()
    assert len(got) == pages.count()
    by = {r.page_id: r.text for r in got}
    for i in range(40):
        assert by[i] == f"story {i}\n{i}"          # what all pages of the host have is gone, with or without marks
        assert by[100 + i] == f"story {i}\nsaid often"  # repeated inside articles: kept
    assert by[200] == "one page, many copies" and by[300] == "Our site\nstory" and by[None] == "" and by[400] in ("", "x")
    assert all(r.n_chars == len(r.text) for r in got)
    found = {(r.host, r.n) for r in templates.templates(pages, rule).collect()}
    assert found == {("a.example", 40), ("b.example", 40)}


def test_joined_templates_equal_sent_ones(spark):
    pages = site_of(spark)
    assert plain(templates.extract(pages)) == plain(templates.extract(pages, bound=0))
    assert templates.extract(pages.limit(0)).collect() == [] and templates.extract(pages.limit(0), bound=0).collect() == []


def test_share_of_a_large_host(spark):
    pages = site_of(spark)
    assert templates.templates(pages, templates.Rule(pages=10, share=1.0)).count() > 0
    assert templates.templates(pages, templates.Rule(pages=41)).count() == 0


# --- phrases


def slow_phrases(rows, rule):
    """Counts of all word sequences, as the definition says it."""
    count, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", folded):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= rule.least}
        scored = []
        for p, a in wanted.items():
            if any(100 * b >= rule.cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in wanted.items() if len(q) > len(p)):
                continue
            score, _, l, r = min((rule.unit * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:rule.top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -s))
    return sorted(out, key=repr)


def random_texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "a", "new", "york", "City", "é", "ü", "x" * 40, "b\x0bc", " "]
    ends = [" ", "  ", "\t", ", ", ". ", "\n", "!?", "\r"]
    rows = []
    for _ in range(n):
        text = "".join(str(w) + str(e) for w, e in zip(rng.choice(words, 60, p=np.arange(12, 0, -1) / 78), rng.choice(ends, 60, p=[0.7, 0.1, 0.05, 0.05, 0.025, 0.025, 0.025, 0.025])))
        rows.append((None if rng.random() < 0.1 else str(rng.choice(["en", "de", "und"])), text))
    return rows


@pytest.mark.parametrize("heavy, top", [(1000, 2000), (0, 7)])
def test_phrases_equal_plain_counts(spark, monkeypatch, heavy, top):
    monkeypatch.setattr(phrases, "LEAST_HEAVY", heavy)  # 0: every prefix is dealt out over several groups
    monkeypatch.setattr(phrases, "BUDGET", 1000)
    rows = random_texts(3, 300) + [("en", "new york city hall, " * 3000), ("en", None), (None, ""), ("fr", " ,. "), ("en", "z" * 100_000)]
    rule = phrases.Rule(least=12, top=top)
    docs = spark.createDataFrame([(lang, t, "clash", 5) for lang, t in rows], "lang string, text string, word string, n long").repartition(5)
    assert plain(phrases.collocations(docs, rule)) == slow_phrases(rows, rule)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b c")], "lang string, text string")).collect() == []


def test_product_passes_64_bits(spark):
    rule = phrases.Rule(least=1, unit=10**15)
    docs = spark.createDataFrame([("en", "a b. " * 20000)], "lang string, text string")
    (row,) = phrases.collocations(docs, rule).collect()
    assert (row.phrase, row.a, row.score) == ("a b", 20000, 20000 * 10**15 // 40000)


# --- codes


def slow_codes(rows, code):
    """One vector and entry at a time."""
    kept = [(i, lab, [int(np.floor(np.float64(x) * code.scale)) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = max((len(v) for *_, v in kept), default=0)
    width = -(-size // code.parts)
    kept = [(i, lab, v + [0] * (width * code.parts - len(v)), len(v)) for i, lab, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2][:r[3]]))[:code.entries]
    books = [[v[p * width:(p + 1) * width] for _, _, v, _ in first] for p in range(code.parts)]

    def assign():
        out = []
        for _, _, v, _ in kept:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e)), k) for k, e in enumerate(books[p])) for p in range(code.parts)]
            out.append(best)
        return out

    for _ in range(code.rounds if kept else 0):
        chosen = assign()
        for p in range(code.parts):
            for k in range(len(books[p])):
                mine = [v[p * width:(p + 1) * width] for (_, _, v, _), c in zip(kept, chosen) if c[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    rows = [(i, lab, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for (i, lab, *_), c in zip(kept, assign())]
    return sorted(rows, key=repr), books


SCHEMA = "vec_id long, label int, embedding array<float>, code string, ints int"


@pytest.mark.parametrize("parts, entries, dims", [(4, 8, 12), (16, 64, 64), (4, 3, 10)])
def test_codes_equal_plain_version(spark, parts, entries, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(0, 1, (90, dims)).round(2)
    rows = [(i, int(rng.integers(3)), base[i % 70].tolist()) for i in range(90)]
    rows += [(5, None, base[1].tolist()), (None, 1, base[2].tolist()), (91, 1, None), (92, 1, [float("nan")] * dims), (93, None, [float("inf")] * dims),
             (94, None, [None] * dims), (95, 2, base[3].tolist()[:5]), (96, 2, [])]
    code = codes.Code(parts, entries)
    got, books = codes.compress(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4), code)
    want, slow = slow_codes(rows, code)
    assert plain(got) == want and books.tolist() == slow
    assert codes.fingerprint(books) == hashlib.sha256(",".join(str(x) for part in slow for e in part for x in e).encode()).hexdigest()
    back = {r.vec_id: r.vector for r in codes.decode(got, books, code).collect()}
    width = -(-dims // parts) * parts
    error = {r.vec_id: r.error for r in got.collect()}
    ints = np.zeros(width)
    ints[:dims] = np.floor(np.float32(base[10]).astype(float) * code.scale)
    assert np.isclose(((np.array(back[10]) * code.scale - ints) ** 2).sum(), error[10])


def test_codes_of_few_and_large(spark):
    none, books = codes.compress(spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>"))
    assert none.collect() == [] and books.size == 0
    rows = [(1, 1, [1e30, -1e30]), (2, 1, [0.0, 0.0])]
    got, _ = codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), codes.Code(2, 1, 0))
    assert {r.vec_id: r.error for r in got.collect()} == {1: 0, 2: 2 * codes.LIMIT ** 2}
