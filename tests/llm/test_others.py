import hashlib
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpalith.llm import flac, html_text, langid, quality, suffix_lm, url_filter
from corpalith.llm.common import fold

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")]


# URL filter


def test_url_rules_and_list(spark):
    urls = ["https://EXAMPLE.org/es/x?a#b", "http://a.example.org/en", "http://bad.com/p/?utm_source=1&b=2&a=1", "ftp://www.bad.com:80/p?a=1&b=2#z", "http://x.com/de/1", "http://fine.net", "nothing", None, "", "a://", "http://y.com?de/"]
    pages = spark.createDataFrame([(i, u, "w", 1) for i, u in enumerate(urls)], "page_id long, url string, h string, block long")
    listed = spark.createDataFrame([("https://bad.com/p?b=2&a=1",), (None,), ("",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, RULES).collect()}
    assert got == {
        0: ("example.org", "/es/x", "example.org/es/", "block"), 1: ("a.example.org", "/en", "org/", "allow"), 2: ("bad.com", "/p/", None, "block"), 3: ("www.bad.com:80", "/p", None, "block"),
        4: ("x.com", "/de/1", "com/de/", "block"), 5: ("fine.net", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("y.com", "", None, "allow"),
    }
    assert url_filter.filter_urls(pages.limit(0), listed, RULES).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    urls = spark.range(3000).select(F.concat(F.lit("http://h.com/"), "id").alias("url"), F.col("id").alias("page_id"))
    got = url_filter.filter_urls(urls, urls.where("page_id % 3 = 0"), [])
    assert got.where("page_id % 3 = 0 and not possible").count() == 0
    assert got.where("verdict = 'block'").count() == 1000
    assert got.where("page_id % 3 <> 0 and possible").count() < 100


# FLAC


def decoded(streams):
    out = [b""] * len(streams)
    for s, _, first, x, fits in flac.decode(streams):
        assert fits and first == len(out[s])
        out[s] += (x + 128).astype(np.uint8).tobytes()
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=5000), min_size=1, max_size=4))
def test_round_trip(payloads):
    assert decoded(flac.encode(payloads)) == payloads


def test_signals_and_damage():
    t = np.arange(6000)
    payloads = [bytes((128 + 100 * np.sin(t / 9)).astype(np.uint8)), bytes(5000), b"\x00\xff" * 3000, bytes([0] * 63 + [255]) * 50, b"a" * 1024 + b"b"]
    streams = flac.encode(payloads)
    assert decoded(streams) == payloads and len(streams[0]) < 3000 and len(streams[1]) < 400
    broken = bytearray(streams[0])
    broken[-40] ^= 4
    assert not all(fits for *_, fits in flac.decode([bytes(broken)]))
    frames, _, md5 = flac.frames_of(streams[0])
    assert md5 == hashlib.md5((np.frombuffer(payloads[0], np.uint8) ^ 0x80).tobytes()).digest()
    plain = streams[0][:4] + b"\x80" + streams[0][5:42] + streams[0][frames[0].start :]  # no seek table
    assert decoded([plain]) == [payloads[0]]


def test_media_columns(odd, none):
    media = flac.encode_texts(odd)
    rows = flac.digests(flac.pcm_blocks(media, keep=("n_bytes",))).collect()
    texts = sorted((flac.padded((r.text or "").encode()) for r in odd.select("text").collect()))
    assert sorted(r.payload_sha256 for r in rows) == sorted(hashlib.sha256(t).hexdigest() for t in texts)
    assert sorted(r.tail_crc32 for r in rows) == sorted(zlib.crc32(t[-64:]) for t in texts)
    blocks = flac.pcm_blocks(media).where("doc_id = 6").orderBy("block_no").collect()
    assert b"".join(b.pcm for b in blocks).startswith(b"word0 thing word1") and all(b.crc_ok and b.sample_offset == i * flac.BLOCK for i, b in enumerate(blocks))
    assert flac.digests(flac.pcm_blocks(flac.encode_texts(none), keep=("n_bytes",))).count() == 0


# Quality


def junk(rng, kind):
    words = ["".join(rng.choice(list("aeioust"), rng.integers(2, 9))) for _ in range(rng.integers(5, 120))]
    return " ".join(words) if kind else [" ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words), " ".join([words[0]] * len(words))][rng.integers(0, 3)]


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    kinds = [int(x) for x in rng.integers(0, 2, 400)]
    docs = spark.createDataFrame([(i, junk(rng, k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "doc_id long, quality int")
    model = quality.fit(docs, labels, learn=fold("id", 4) != 2)
    scored = quality.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 4) == 2).collect()
    assert len(scored) > 50 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in scored]) > 0.95
    again = quality.fit(docs.repartition(5), labels.repartition(3), learn=fold("id", 4) != 2)
    assert again == model and 0 < len(model.rules) < 100


def test_counts_match_counting_by_hand():
    import unicodedata

    texts = ["", " \t\n", "One TWO three three\nÄpfel 12,5 % #!", "ß x💡 a\u00a0b\u2028c", "w" * 70 + "\n\n"]
    for text, row in zip(texts, quality.count_texts([t.encode() for t in texts]).tolist(), strict=True):
        words = text.encode().split()
        space = [c for c in text if c in " \t\n\v\f\r"]
        symbols = [c for c in text if c not in space and unicodedata.category(c)[0] not in "LNZ" and c not in ".,;:'’()-"]
        upper = [c for c in text if "A" <= c <= "Z" or c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŸ"]
        assert row == [len(words), len(set(words)), max((len(w.decode()) for w in words), default=0), len(text), len(space), len(upper), sum("0" <= c <= "9" for c in text), len(symbols), text.count("\n") + 1]


def test_compiled_rules_match_the_model(spark):
    """The column expression against the rules applied one by one; and the lasso against its own conditions."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, len(quality.STATS)))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5) | (x[:, 5] > 1)).astype(float)
    model = quality.fit_rules(x, y)
    assert 0 < len(model.rules) < 60
    want = []
    for row in x:
        total = model.bias
        for parts, weight in model.rules:
            if all((row[quality.STATS.index(n)] > c) == above for n, above, c in parts):
                total += weight
        want.append(1 / (1 + math.exp(-total)))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in quality.STATS))
    got = [r.s for r in rows.select("id", model.score().alias("s")).orderBy("id").collect()]
    assert got == pytest.approx(want)
    assert np.mean((np.array(want) > 0.5) == (y == 1)) > 0.95
    assert len(quality.fit_rules(x, y, lasso=0.05).rules) < len(model.rules)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (None, 1), (3, None), (5, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(none, labels.limit(0)).rules == () and quality.score(none, model).count() == 0


# Languages


def test_languages(spark, odd, none):
    rng = np.random.default_rng(1)
    sounds = {"aa": list("abc"), "bb": list("xyz"), "cc": list("cde")}
    text = lambda k, n: " ".join("".join(rng.choice(sounds[k], 5)) for _ in range(n))
    rows = [(i, text(k, 20), k) for i in range(60) for k in [("aa", "bb", "cc")[i % 3]]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = model.predict([text("aa", 30).encode(), (text("aa", 60) + " " + text("bb", 30)).encode(), b"123 !", b"", text("cc", 1).encode()])
    assert [g[0] for g in got] == ["aa", "aa", "und", "und", "cc"]
    assert [x for x, _ in got[0][2]] == ["aa"] and [x for x, _ in got[1][2]] == ["aa", "bb"]
    assert got[1][2][0][1] == pytest.approx(2 / 3, abs=0.1)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}


def test_wasted_bits():
    """A frame by hand: verbatim samples that all end in two zero bits."""
    x = np.arange(-64, 64, 2) // 4 * 4
    data = flac.encode([(x + 128).astype(np.uint8).tobytes()])[0]
    frame = flac.frames_of(data)[0][0]
    bits = "0" + f"{1:06b}" + "1" + "01" + "".join(f"{v // 4 & 63:06b}" for v in x.tolist())
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    whole = np.frombuffer(data[frame.start : frame.body] + body, np.uint8)
    sums = int(flac.crc16(whole, np.array([0]), np.array([len(whole)]))[0])
    (_, _, _, got, fits), = flac.decode([data[: frame.start] + whole.tobytes() + sums.to_bytes(2, "big")])
    assert fits and got.tolist() == x.tolist()


def test_language_sets_match_brute_force():
    """Shares and sets by plain loops: each set grown by the best single language first, then by the shares of all."""
    rng = np.random.default_rng(11)
    langs = ["aa", "bb", "cc", "dd"]
    logp = np.log(rng.dirichlet(np.full(64, 0.3), 4).T + 1e-4)
    logp -= np.log(np.exp(logp).sum(0))
    model = langid.Model(langs, logp.astype(np.float32))

    def em(p, count, share):
        for _ in range(langid.ROUNDS):
            joint = p * share
            joint *= (count / joint.sum(1))[:, None]
            new = np.maximum(joint.sum(0) / count.sum(), 1e-12)
            moved, share = np.abs(new - share).max(), new
            if moved < langid.SETTLED:
                break
        return share, float((count * np.log((p * share).sum(1))).sum())

    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, n)) for n in (3, 20, 80, 200)]
    for text in texts:
        _, bucket, count = langid.trigrams([text.encode()], 64)
        p, count = np.exp(model.logp[bucket].astype(float)), count.astype(float)
        share, _ = em(p, count, np.full(4, 0.25))
        single = (np.log(p) * count[:, None]).sum(0)
        first, fee = int(single.argmax()), langid.PENALTY * math.log(count.sum() + 1)
        order = [first, *(j for j in np.argsort(-share, kind="stable").tolist() if j != first)]
        best, value = {first: 1.0}, single[first] - fee
        for m in range(2, 5):
            mixed, likelihood = em(p, count, np.where(np.isin(np.arange(4), order[:m]), 1 / m, 1e-12))
            if likelihood - m * fee <= value:
                break
            best, value = {j: mixed[j] for j in order[:m]}, likelihood - m * fee
        (lang, score, mixture), = model.predict([text.encode()])
        assert lang == langs[max(best, key=lambda j: best[j])] and score == pytest.approx(max(best.values()), abs=0.02)
        assert {x for x, s in mixture if s > 1e-3} == {langs[j] for j, s in best.items() if s > 1e-3}


# HTML


def test_main_text():
    page = """<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; more</h1><p>One <b>two</b>
      three&nbsp;four<p>To.<aside>Aside</aside><ul><li>Item</li><li><a href='y>z'>Linked</a></li></ul><script>var t="</p>";</script><p>&lt;p&gt; last<form>name <input></form></article>
    <section id=comments><p>First!</p></section><footer>Foot</footer></body></html>"""
    assert html_text.main_text(page) == "Head & more\nOne two three four\nTo.\nItem\nLinked\n<p> last"
    held = "<div class='page has-sidebar'><main><p>Kept</p><div class=share>Share</div></main><div id=comments><article class=comment-body><p>Mine</p></article></div></div>"
    assert html_text.main_text(held) == "Kept"
    assert html_text.main_text("") == "" and html_text.main_text("<p>unclosed <b>text") == "unclosed text"
    assert html_text.main_text("<div><p>" + "plain words of a page " * 9 + "</p></div><div class=menu><a>x</a></div>").startswith("plain words")


def test_names_and_headers_inside_an_article():
    """Only whole names mark furniture; a header in an article is its own; unclosed markup costs its block at most, but for scripts."""
    page = """<article><header><h1>Title</h1></header><div class='social-science'><p>Of society.</p></div><figure class=widget><figcaption>A caption of six words here</figcaption></figure>
    <section id=discussion><p>What this means.</p></section><div class="ad-banner">Buy</div><p><svg>Kept<p><math><mi>x</mi></math></article>"""
    assert html_text.main_text(page) == "Title\nOf society.\nA caption of six words here\nWhat this means.\nKept\nx"
    assert html_text.main_text("<article><p>one</p><script>var x = 1;<p>two</p></article>") == "one"


class Plain(HTMLParser):
    """An extraction by itself: the text inside ``article`` that is in no furniture, a line for each block."""

    FURNITURE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u", "img", "mark", "q", "cite", "br"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.held, self.depth, self.skipped = [], [], 0, []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        line = " ".join("".join(self.held).split())
        self.lines += [line] * bool(line)
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.held += [" "] * (tag == "br")
        if tag not in self.INLINE:
            self.cut()
        self.depth += tag == "article"
        named = {w for k, v in attrs if k in ("class", "id") for w in (v or "").split()}
        if self.skipped and tag == self.skipped[0]:
            self.skipped.append(tag)
        elif not self.skipped and (tag in self.FURNITURE or named & {"ad", "comments", "comment", "notice", "cookie"}):
            self.skipped = [tag]

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
        self.depth -= tag == "article"
        if self.skipped and tag == self.skipped[0]:
            self.skipped.pop()

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.held.append(data)


def given_pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def test_every_block_of_the_given_pages_is_decided_by_the_tree(spark):
    """The result is that of an independent extraction, and stays it where no article is declared."""
    pages = given_pages(spark)
    want = ["\n".join(Plain(p).lines) for p in pages]
    assert sum(map(bool, want)) > 200
    assert [html_text.main_text(p) for p in pages] == want
    renamed = [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    assert [html_text.main_text(p) for p in renamed] == want


def test_words_and_links_alone(spark):
    """With nothing declared at all, the tree still finds the articles, and little besides."""
    kept = right = total = 0
    for page in given_pages(spark):
        want = Counter(Plain(page).lines)
        bare = re.sub(r"<(/?)(?:article|nav|header|footer|aside|form|main)\b", r"<\1div", re.sub(r'\s(?:class|id|role)="[^"]*"', "", page))
        got = Counter(html_text.main_text(bare).split("\n"))
        kept, right, total = kept + got.total(), right + (got & want).total(), total + want.total()
    assert right >= 0.98 * total and right >= 0.85 * kept


def test_tree_without_declared_articles():
    """Neighbours and link density decide where no article is declared."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(["plain", "words", "of", "a", "page"], n)) + "."
    right = total = 0
    for _ in range(60):
        body = [say(int(n)) for n in rng.integers(12, 90, 8)]
        links = [f"<li><a href=/{i}>link {i}</a></li>" for i in range(6)]
        page = f"<body><ul>{''.join(links)}</ul><div id=content><h1>{say(8)}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><ul>{''.join(links)}</ul><div>{say(5)}</div></body>"
        got = html_text.main_text(page).split("\n")
        assert not any(g.startswith("link") for g in got)
        right, total = right + sum(b in got for b in body), total + len(body)
    assert right == total
    used = set()
    nodes = [html_text.tree()]
    while nodes:
        node = nodes.pop()
        if len(node) > 1:
            used.add(html_text.FEATURES[node[0]])
            nodes += node[2:]
    assert {"links", "words_before", "words_after"} <= used


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "<article><p>x</article>", "t"), (2, "u", None, "t"), (None, "u", "", "t"), (1, None, "<article><p>x</article>", "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("1", "x", 1), ("1", "x", 1), ("2", "", 0), ("None", "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


# Suffix tree


def brute_tree(train, texts, depth, least, gain, smoothing):
    """Natural log of each text's probability, by counting every run of words in dictionaries."""
    runs = [Counter(t[i : i + k + 1] for t in train for i in range(len(t) - k)) for k in range(depth + 1)]
    total, distinct = sum(runs[0].values()), len(runs[0])
    states = {(): None}

    def p(ctx, s):
        if not ctx:
            return (runs[0][(s,)] + 1) / (total + distinct + 1)
        if ctx not in states:
            return p(ctx[1:], s)
        own, rest, n = states[ctx]
        return (own[s] + smoothing * p(ctx[1:], s)) / (n + smoothing) if s in own else p(ctx[1:], s) * rest

    for k in range(1, depth + 1):
        after = {}
        for run, n in runs[k].items():
            if n >= least and (k == 1 or run[1:-1] in states and run[-1] in states[run[1:-1]][0]):
                after.setdefault(run[:-1], {})[run[-1]] = n
        for ctx, own in after.items():
            n = runs[k - 1][ctx]
            q = {s: (m + smoothing * p(ctx[1:], s)) / (n + smoothing) for s, m in own.items()}
            rest = max(1 - sum(q.values()), 1e-9) / max(1 - sum(p(ctx[1:], s) for s in own), 1e-9)
            if sum(m * math.log(q[s] / p(ctx[1:], s)) for s, m in own.items()) + (n - sum(own.values())) * math.log(rest) >= gain:
                states[ctx] = (own, rest, n)

    def longest(text, i):
        return next(text[i - k : i] for k in range(min(i, depth), -1, -1) if text[i - k : i] in states)

    return [sum(math.log(p(longest(t, i), t[i])) for i in range(len(t))) for t in texts], [sum(len(c) == k for c in states) for k in range(1, depth + 1)]


@pytest.mark.parametrize(("hot", "bits"), [(1_000_000, 1 << 21), (20, 1)])
def test_suffix_tree(spark, odd, none, hot, bits):
    """Against dictionaries, with all runs broadcast, and with few of them and a bit table that is full."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        words = ["a", "A"][i % 4 == 1 :][:1] if i % 2 else ["x"]
        for _ in range(rng.integers(5, 40)):  # what follows depends on the last two words
            last = words[-1].lower()
            words.append(("c" if words[-2:] == ["a", "b"] else {"a": "b", "b": "x", "c": "a", "x": "y", "y": "z", "z": "x"}[last]) if rng.random() < 0.8 else str(rng.choice(list("abcxyz"))))
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, " \t "), (302, "never seen words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = suffix_lm.tokenise(docs, learn=fold("doc_id", 7) != 2)
    lm = suffix_lm.fit(tokens, depth=4, most=bits)
    texts = {i: (*(t or "").lower().split(), "") for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    total, distinct = sum(counts.values()), len(counts)
    assert (lm.total, lm.distinct) == (total, distinct)
    want, states = brute_tree(train, list(texts.values()), 4, suffix_lm.LEAST, suffix_lm.GAIN, suffix_lm.SMOOTHING)
    assert [*lm.states, 0, 0, 0, 0][:4] == states and states[1] > 0
    got = {r.doc_id: r for r in suffix_lm.score(tokens, lm, hot, bits).collect()}
    assert len(got) == 303
    for (i, words), natural in zip(texts.items(), want, strict=True):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(words) and got[i].n_known == sum(counts[w] > 0 for w in words)
        assert got[i].score == pytest.approx(natural / math.log(10))
    rows = suffix_lm.score(suffix_lm.tokenise(odd), lm, hot, bits).collect()
    assert len(rows) == odd.count() and all(r.score < 0 for r in rows)
    nothing = suffix_lm.tokenise(none)
    empty = suffix_lm.fit(nothing)
    assert (empty.total, empty.distinct, empty.states) == (0, 0, [0]) and suffix_lm.score(nothing, lm).count() == 0
    assert {r.n_known for r in suffix_lm.score(tokens, empty).collect()} == {0}
