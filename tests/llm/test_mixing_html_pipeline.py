"""The mix against brute force, page text, and the pipeline's stages."""

import html
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from bookflow.llm import html_text, mixing, wordhash

SF = "/root/testdata/sf0.001"


def highest_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def level_targets(sizes, weights, total):
    capped, out = set(), {}
    while True:
        left = total - sum(2 * sizes[i] for i in capped)
        rest = [i for i in range(len(sizes)) if i not in capped]
        share = sum(weights[i] for i in rest)
        out = {i: 2.0 * sizes[i] for i in capped} | {i: left * weights[i] / share for i in rest}
        over = [i for i in rest if out[i] > 2 * sizes[i]]
        if not over:
            return [out[i] for i in range(len(sizes))]
        capped |= set(over)


def mix_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for source, n, longest in (("a", 900, 60), ("b", 30, 20), (None, 200, 90), ("Z", 5, 4), ("é", 60, 200), ("", 10, 0)):
        rows += [(len(rows) + k, source, "w " * int(rng.integers(0, longest + 1))) for k in range(n)]
    rows += [(7, "a", None), (7, "a", "x y"), (7, "a", "x y"), (None, "b", "x")]
    return rows, spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, target int").repartition(4)


def test_apportion_is_highest_quotients(spark):
    rng = np.random.default_rng(9)
    for n, seats in ((1, 5), (3, 0), (7, 100), (40, 33), (60, 5000)):
        weights = [float(x) for x in rng.integers(0, 1000, n)] if n > 3 else [5.0, 5.0, 0.0][:n]
        frame = spark.createDataFrame([(0, i, w, seats) for i, w in enumerate(weights)], "g int, i int, w double, seats long")
        got = {r.i: r.won for r in mixing.apportion(frame, ["g"], "w", "seats", "i", "won").collect()}
        assert [got[i] for i in range(n)] == highest_quotients(weights, seats if any(weights) else 0)


def test_mix_follows_its_targets(spark):
    rows, frame = mix_rows(spark)
    got = mixing.mix(frame, shard_rows=100).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level_targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[order.index(r.source)])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, target in zip(order, want, strict=True):
        assert abs(taken[source] - target) <= mixing.BLOCK_TOKENS
    again = mixing.mix(frame.repartition(2), shard_rows=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_copies_hold_the_words_taken(spark):
    rows, frame = mix_rows(spark)
    mixed = mixing.mix(frame, keep=frame.columns, shard_rows=100)
    out = mixing.copies(mixed)
    assert out.columns == frame.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in mixed.collect())
    assert mixing.mix(frame.limit(0)).collect() == []


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><header><a href=/>Site</a></header>
    <nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
    <article><header><h1>Head &amp; tail</h1><p>by me</p></header><p><b>One&nbsp;two
    three<br>four<p data-x="a > b">Five &lt;six&gt; &#233;<ul><li>a<li>b</ul><form><p>x</p></form><aside>side</aside><section class="comments"><p>nice</p></section><p hidden>no</p></article>
    <p>outside</p><footer>f</footer></body></html>"""
    assert main_text(page) == "Head & tail\nOne two three four\nFive <six> é\na\nb"
    for bad in (None, "", "<", "<p", "<!-- x", "<p>a < b</p>", "<script>x", "</p></div>", "<a b='" * 200, "<" * 5000):
        html_text.blocks(bad)
    assert main_text("<p>a < b</p>") == "a < b"


def main_text(page):
    return html_text.main_text(html_text.blocks(page))


def test_odd_markup_loses_no_text():
    assert main_text("<p>İİ</p><script>x</script><p>hello</p>") == "İİ\nhello"
    assert main_text("<article>" + "İ" * 40 + "<STYLE>p{}</Style ><p>one two three</p></article>") == "İ" * 40 + "\none two three"
    assert main_text("<article><a title=don't>link</a><p>keep 'me'</p></article>") == "link\nkeep 'me'"
    assert main_text("<article><img alt='" + "x>" * 3000 + "'><p>kept</p></article>") == "kept"
    assert main_text('<article><p class="legal-history">law<p class=share-price>9<div class="related">r</div><div class="ad-box">buy</div><div id=comments>c</div></article>') == "law\n9\nr"
    assert main_text("<article>" + "<b>" * 50 + "<p>one" + "<i>" * 50 + "<p>two</article>") == "one\ntwo"
    for odd in ("<b>" * 20_000 + "<p></p>" * 20_000, "<div>" * 20_000 + "</x>" * 20_000, "<a b='" * 50_000, '<a "' * 50_000, "<p a" * 50_000, "<script>" * 20_000, "<a " + " /" * 50_000):
        began = time.perf_counter()
        html_text.blocks(odd)
        assert time.perf_counter() - began < 5


def test_boilerplate_by_hand(spark):
    """The middle of every substring of 15 words on enough pages of a host is covered, and nothing that isn't in or between runs on such pages."""
    rng = np.random.default_rng(10)
    shared = [[f"s{k}x{i}" for i in range(n)] for k, n in enumerate((12, 13, 20, 40))]
    pages = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 30)]
        for part in shared:
            if rng.random() < 0.4:
                at = int(rng.integers(0, len(words)))
                words[at:at] = part
        pages.append(words)
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k}", "<p>" + " ".join(w)) for k, w in enumerate(pages)]
    found = html_text.boilerplate(spark.createDataFrame([(k, k % 2, h) for k, _, h in rows], "page long, host long, html string"))
    known = {r.page: np.array(r.outside, np.int64).view(np.uint64) for r in found.collect()}
    where = defaultdict(set)
    for k, words in enumerate(pages):
        for length in (2 * html_text.WINDOW - 1, html_text.RUN):
            for i in range(len(words) - length + 1):
                where[k % 2, tuple(words[i : i + length])].add(k)
    for k, words in enumerate(pages):
        mask = html_text.covered(wordhash.word_hashes(" ".join(words).encode()), k % 2, known.get(k, np.zeros(0, np.uint64)))
        often = lambda length: [i for i in range(len(words) - length + 1) if len(where[k % 2, tuple(words[i : i + length])]) >= 3]  # noqa: B023, E731
        assert all(mask[i + html_text.WINDOW - 1] for i in often(2 * html_text.WINDOW - 1))
        near = {i + j for i in often(html_text.RUN) for j in range(html_text.WINDOW)}
        assert set(np.flatnonzero(mask).tolist()) <= near


def test_pages_without_article_lose_what_their_host_repeats(spark):
    shared = "all rights reserved by the owner of this very site since the year two"
    rows = [(k, f"http://h.example/{k}", f"<div>{shared}</div><p>own words {k} alpha{k} beta{k}</p><div><a href=/>link one</a></div>") for k in range(12)]
    rows += [(50, None, None), (50, None, None), (51, "no url", "<p>x</p>")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract(frame).collect()), key=str)
    want = [(k, f"own words {k} alpha{k} beta{k}") for k in range(12)] + [(50, ""), (50, ""), (51, "x")]
    assert got == sorted(((k, t, len(t)) for k, t in want), key=str)
    assert html_text.extract(frame.limit(0)).collect() == []


def test_notices_in_articles_go_and_copied_articles_stay(spark):
    shared = "all rights reserved by the owner of this very site since the year two"
    own = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(12)]
    copied = " ".join(f"copied{i}" for i in range(40))
    rows = [(k, f"http://h.example/{k}", f"<article><p>{own[k]}</p><div>{shared}</div></article>") for k in range(12)]
    rows += [(20 + k, f"http://h.example/{20 + k}", f"<article><p>{copied} end{k}</p></article>") for k in range(6)]
    rows += [(30, "http://h.example/30", "<main><header><h1>Title of it</h1></header><p>long text</p><article>teaser</article></main>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(12)] == own
    assert [got[20 + k] for k in range(6)] == [f"{copied} end{k}" for k in range(6)]
    assert got[30] == "Title of it\nlong text\nteaser"


def test_the_host_s_repeats_decide_where_markup_says_nothing(spark, monkeypatch):
    shared = "this little paragraph stands on each page of the host and says nothing at all about it"
    rows = [(k, f"http://h.example/{k}", f"<div>{shared}</div><p>own words {k} alpha{k} beta{k}</p>") for k in range(200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert {r.text for r in html_text.extract(frame).collect()} == {f"own words {k} alpha{k} beta{k}" for k in range(200)}
    monkeypatch.setattr(html_text, "boilerplate", lambda rows: spark.createDataFrame([], "page long, outside array<long>, inside array<long>"))
    assert all(r.text.startswith(shared) for r in html_text.extract(frame).collect())


def test_articles_of_the_test_pages_are_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.collect()
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.written(docs, "test")
        steps.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(steps[0]) == sum(any(c.isalpha() for c in r.text or "") for r in first)
    assert len(steps[1]) < len(steps[0]) and len(steps[2]) == len(steps[1])
    assert not any("@mail" in r.text for r in steps[2]) and all(r.n_chars == len(r.text) for r in steps[3])
    counts = defaultdict(int)
    for r in steps[3]:
        counts[r.doc_id] += 1
    assert max(counts.values()) == 2 and len(steps[4]) == len(steps[3]) and all(r.complete for r in steps[4])


def test_pipeline_on_odd_rows_is_the_plain_one(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing columns; each stage against a plain version of it."""
    from sentencepiece import SentencePieceProcessor

    from bookflow.llm import language_id, pii, sentencepiece_lattice
    from test_dedup_and_join import linked_by_hand

    rng = random.Random(12)
    words = {"x": "alpha beta gamma delta kappa", "y": "epsilon zeta eta theta lambda"}
    rows = []
    for i in range(80):
        lang = "xy"[i % 2]
        text = " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, lang if i % 7 else None, "ab"[i % 3 == 0], None if i % 5 == 0 else len(text), "k", i, "z"))
    rows += [(90 + k, rows[3][1] + f" mail me at a{k}@b.org or call +4915123456789 and 4915123456789", "y", None, 1, "k", None, "z") for k in range(6)]
    rows += [(100, None, "x", "a", None, None, None, None), (None, "alpha beta gamma", "x", None, None, None, None, None), (101, "", None, None, 0, None, 0, ""), (102, "12 34", "x", "a", 5, "k", 1, "z"), (103, "alpha " * 30_000, "x", "b", 1, "k", 1, "z")]
    rows += [rows[5]] * 3 + [rows[-5]] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, ids string"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    model = language_id.train(docs)
    plain = [r for r in rows for lang, score in [model.predict(r[1])] if lang != "und" and score >= language_id.LEAST_SCORE]
    state = {}

    def after(k):
        nonlocal docs
        docs = corpus_pipeline.written(corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)), "odd")
        if k < 4:
            assert docs.dtypes == spark.createDataFrame([], schema).dtypes
        state[k] = sorted(map(tuple, docs.collect()), key=str)
        return state[k]

    assert after(0) == sorted(plain, key=str)
    keyed = {r[0] if r[0] is not None else 1 << 62: r for r in sorted(plain, key=str)}
    groups = {c for _, _, c in linked_by_hand([(i, r[1]) for i, r in keyed.items()], 5, 80)}
    assert after(1) == sorted((keyed[c] for c in groups), key=str)
    field = pii.train(spark.createDataFrame(state[1], schema))

    def hidden(text):
        base, added = pii.spans(text, field)
        for s, e, k in sorted(((s, e, k) for k, s, e in base + added), reverse=True):
            text = text[:s] + f"<{pii.KINDS[k].upper()}>" + text[e:]
        return text

    assert after(2) == sorted(((r[0], hidden(r[1]), *r[2:4], len(hidden(r[1])), *r[5:]) for r in state[1]), key=str)
    assert any("<PHONE>" in r[1] for r in state[2])
    mixed = mixing.mix(spark.createDataFrame(state[2], schema))
    assert sum(len(r[1].split()) for r in after(3)) == sum(r.taken for r in mixed.collect())
    library = SentencePieceProcessor(model_file=sentencepiece_lattice.default_model())
    docs_before = {}
    for r in state[3]:
        docs_before.setdefault(r[0], []).append(library.encode(r[1]))
    coded = {}
    for r in corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect():
        assert r.complete
        coded.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in coded.items()} == {k: sorted(v) for k, v in docs_before.items()}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


REAL = "<p>Real article text that goes on and on, with many words in it.</p><p>And more of it in a second paragraph here.</p>"
READ = "Real article text that goes on and on, with many words in it.\nAnd more of it in a second paragraph here."


@pytest.mark.parametrize("part", ['class="footer-text">Copyright', 'id="related-content">More stories', 'class="newsletter-text">Sign up', 'class="teaser-body">Teaser'])
def test_a_body_word_never_outranks_a_dropping_one(part):
    assert main_text(f"{REAL}<div {part}</div>") == READ


@pytest.mark.parametrize("name", ['class="reader-comments"', 'class="user-comments"', 'class="fb-comments"', 'class="cookie_notice_v2"', 'id="respond"'])
def test_comments_and_notices_go_wherever_their_word_stands(name):
    assert main_text(f"<article>{REAL}<div {name}>Not the article</div></article>") == READ


def test_nothing_else_goes():
    page = f'<body class="with-sidebar">{REAL}<dialog>Said</dialog><p>x = <math><mi>a</mi><mo>+</mo><mn>1</mn></math></p><p><a href=x>all of it links</a></p><ul><li><a href=y>Home</a></li></ul></body>'
    assert main_text(page) == f"{READ}\nSaid\nx = a+1\nall of it links"
    assert main_text(f'<div class="content">short</div>{REAL}') == f"short\n{READ}"
    assert main_text(f'<div class="content">{REAL}</div><p>short</p>') == READ
