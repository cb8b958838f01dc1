"""Packing, language-model scores, toxicity, HTML extraction and personal data."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from chronorel.llm import html_extract as E
from chronorel.llm import lm_score as S
from chronorel.llm import packing as K
from chronorel.llm import pii as I
from chronorel.llm import toxicity as X
from chronorel.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


# packing


def check_packing(rows, got, window=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    expected = Counter()
    for i, x in ids:
        for s in range(0, len(x), window):
            piece = np.asarray(x[s : s + window], "<u4")
            expected[i, s, len(piece), zlib.crc32(piece.tobytes()), len(x)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= window
    return len(by), sum(len(x) for _, x in ids)


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, tokens = check_packing([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], QUERIES["op1_packing"](spark, SF).collect())
    assert n <= math.ceil(tokens / 2048) + 3


def test_packing_of_odd_rows(docs_of, odd):
    rows = odd + [(50, "with <|endoftext|> inside"), (51, "it's  we'll 12345 ——")]
    check_packing(rows, K.pack(docs_of(rows), tokenizer_path()).collect())
    assert K.pack(docs_of([]), tokenizer_path()).count() == 0
    with_ids = K.pack(docs_of(rows), tokenizer_path(), window=64, with_ids=True).collect()
    assert all(len(r["input_ids"]) == r["length"] for r in with_ids)


def test_plan_uses_every_piece():
    rnd = np.random.default_rng(0)
    for hist in (rnd.integers(0, 50, 65), np.eye(65, dtype=int)[64] * 9, np.eye(65, dtype=int)[33] * 9, np.zeros(65, int)):
        hist = hist.copy()
        hist[0] = 0
        used = np.zeros(65, int)
        for parts, n in K.plan(hist, 64, 500):
            assert sum(parts) <= 64 and n > 0
            for p in parts:
                used[p] += n
        assert (used == hist).all()


# language model


def brute_base(rows):
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(rows)}
    train = Counter(x for k, (i, _) in enumerate(rows) if i is None or zlib.crc32(str(i).encode()) % 10 for x in tokens[k])
    n, v = sum(train.values()), len(train)
    return n, [(rows[k][0], len(x), sum(train[w] > 0 for w in x), sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for k, x in tokens.items()]


def test_scores(spark, docs_of, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(1000 + (i or 0), t) for i, t in odd]
    frame = docs_of(rows)
    got = S.score_texts(frame).collect()
    n, base = brute_base(rows)
    ours = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    for a, b in zip(ours, sorted(base), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    assert all(r["train_tokens"] == n and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in got)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_chunked_scores_equal_broadcast(spark, docs_of, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(S, "BLOCK_KEYS", 4000)
    monkeypatch.setattr(S, "CHUNK_TOKENS", 3000)
    one = sorted((r["doc_id"], round(r["base_score"], 6), round(r["score"], 6)) for r in S.score_texts(docs).collect())
    two = sorted((r["doc_id"], round(r["base_score"], 6), round(r["score"], 6)) for r in S.score_texts(docs, broadcast_bytes=0).collect())
    assert one == two


def test_a_chunk_asks_once_a_block(spark):
    """Keys are made from whole chunks: from rows as they come, each row of a batch asked nearly every block by itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = S.score_texts(docs, broadcast_bytes=0)._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert [" Sort [chunk#" in after for line, after in zip(plan, plan[1:]) if "MapInArrow" in line] == [True]


def test_base_scores_alone(docs_of, odd):
    rows = [(i, f"a b{i % 7} A c{i}") for i in range(60)] + [(1000 + (i or 0), t) for i, t in odd]
    one = S.score_texts(docs_of(rows)).drop("score")
    for limit in (S.BROADCAST_BYTES, 0):
        two = S.score_texts(docs_of(rows), base_only=True, broadcast_bytes=limit)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def read_filter(filt, keys):
    n = len(keys)
    return S.probe_filter(filt, keys, np.full(n, 8 * len(filt), np.uint64), np.zeros(n, np.uint64))


def test_filter_levels():
    keys = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.random.default_rng(0).geometric(0.05, len(keys))
    filt = S.build_filter(keys, counts)
    read = read_filter(filt, keys)
    assert (read >= counts / S.BASE_LOG - 1).all()  # never below its own level
    assert np.mean(np.abs(read - counts) <= counts * 0.5 + 1) > 0.97
    assert (read_filter(filt, keys + np.uint64(12345)) > 0).mean() < 0.03


def brute_scores(rows):
    """Scores of the same model with exact sets in place of the filter: counts of pairs are those of their levels."""
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if i is None or zlib.crc32(str(i).encode()) % 10]
    words = Counter(x for k in train for x in tokens[k])
    pairs = Counter(p for k in train for p in zip([None, *tokens[k][:-1]], tokens[k], strict=True))
    n, once = sum(words.values()), sum(c == 1 for c in words.values())
    unknown = max(once, 0.5) / (n + 1)
    level = lambda c: S.level_count(1 + math.floor(math.log(c) / math.log(S.BASE_LOG) + 1e-9)) if c else 0.0
    out = []
    for k, x in tokens.items():
        total = 0.0
        for v, w in zip([None, *x[:-1]], x, strict=True):
            p = (1 - unknown) * words[w] / max(n, 1) if words[w] else unknown
            if words[v]:
                p = S.INTERPOLATION * min(level(pairs[v, w]), words[v]) / words[v] + (1 - S.INTERPOLATION) * p
            total += math.log10(p)
        out.append((rows[k][0], total, len(x)))
    return sorted(out)


def test_scores_equal_exact_counts(spark, docs_of):
    """The filter only ever errs upwards, and for few tokens."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["score"]) for r in S.score_texts(docs_of(rows)).collect())
    over = tokens = 0.0
    for (i, exact, n), (j, score) in zip(brute_scores(rows), got, strict=True):
        assert i == j and score >= exact - 1e-6 * abs(exact)
        over, tokens = over + score - exact, tokens + n
    assert over / tokens < 0.02


def test_pairs_seen_once_count(docs_of):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10]
    rows = [(train[k], f"a{k} b{k}") for k in range(200)]
    rows += [(held[k], f"a{k} b{k}") for k in range(40)] + [(held[40 + k], f"a{k} b{k + 100}") for k in range(40)]
    for limit in (S.BROADCAST_BYTES, 0):
        got = {r["doc_id"]: r for r in S.score_texts(docs_of(rows), broadcast_bytes=limit).collect()}
        higher = [got[held[k]]["score"] - got[held[40 + k]]["score"] for k in range(40)]
        assert min(higher) >= 0 and np.mean([x > 1 for x in higher]) > 0.8  # the rest: false positives of the filter
        assert all(got[held[k]]["base_score"] == pytest.approx(got[held[40 + k]]["base_score"]) for k in range(40))


def test_empty_model(docs_of):
    assert S.score_texts(docs_of([])).count() == 0
    only_held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = S.score_texts(docs_of([(only_held, "a b")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"])


# toxicity


def toxic_rows(n=1500):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 200))]
        bad = rnd.random() < 0.15
        if bad:
            for _ in range(rnd.randrange(2, 6)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["nasty", "Vile!", "gruesome", "hatezen", "hateful"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs_of, odd):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    everything = rows + [(10_000 + k, t) for k, (_, t) in enumerate(odd)]
    got = {r["doc_id"]: r for r in X.score_toxicity(docs_of(everything), table).collect()}
    assert len(got) == len(everything) and all(0 <= r["score"] <= 1 for r in got.values())
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    tp = sum(got[i]["predicted"] and truth[i] for i in held)
    assert tp / sum(truth[i] for i in held) > 0.9 and sum(got[i]["predicted"] and not truth[i] for i in held) <= 3
    kept = {r["doc_id"] for r in X.drop_toxic(docs_of(everything), table).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_ignores_held_out_labels(spark, docs_of):
    rows, labels = toxic_rows(600)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (sorted(map(tuple, X.score_toxicity(docs_of(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark, docs_of, odd):
    got = X.score_toxicity(docs_of(odd), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == len(odd) and not any(r["predicted"] for r in got)


def test_labels_of_one_class(spark, docs_of):
    rows = [(n, f"text {n}") for n in range(60)]
    table = spark.createDataFrame([(n, 1) for n in range(60)], "doc_id long, toxic int")
    assert all(r["score"] > 0.99 and r["predicted"] for r in X.score_toxicity(docs_of(rows), table).collect())


def test_risk_gradient_by_differences():
    """The direction of descent against differences of the risk, written out row by row."""
    rnd = np.random.default_rng(5)
    for shift in (-2.0, 0.0, 3.0):
        samples, rows = [], []
        for n in (7, 11):
            dense = rnd.integers(0, 3, (n, 4))
            row, col = np.nonzero(dense)
            times = dense[row, col]
            samples.append(X.Sample(np.repeat(row, times), np.repeat(col, times), n))
            rows.append(dense)
        w, prior = rnd.normal(size=4), 0.4

        def risk(theta):
            gp, gu = (d @ theta[:4] + theta[4] for d in rows)
            plus, minus = prior * np.mean(np.log1p(np.exp(-gp))), np.mean(np.log1p(np.exp(gu))) - prior * np.mean(np.log1p(np.exp(gp)))
            return plus, minus

        theta = np.append(w, shift)
        assert X.pu_risk(w, shift, *samples, prior) == pytest.approx(risk(theta))
        goal = (lambda t: sum(risk(t))) if risk(theta)[1] >= 0 else (lambda t: -risk(t)[1])
        slope = [(goal(theta + 1e-6 * e) - goal(theta - 1e-6 * e)) / 2e-6 for e in np.eye(5)]
        assert X.pu_gradient(w, shift, *samples, prior) == pytest.approx(slope, abs=1e-5)


def test_toxicity_scores_by_hand(docs_of):
    weights = {f: 0.25 * k for k, f in enumerate(X.word_features(b"nasty") + X.word_features(b"vile"))}
    model = X.Model(weights, -1.0, 0.1)
    texts = ["Nasty, vile!", "nasty nasty", "", None, "fine words", "nastier"]
    got = {r["doc_id"]: r["score"] for r in X.score(docs_of(list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        words = set(re.sub(r"[^a-z ]", " ", (t or "").lower()).split())
        total = -1.0 + sum(weights.get(f, 0.0) for w in words for f in X.word_features(w.encode()))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)))


# HTML


def test_min_cut_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        source, sink = [rnd.random() for _ in range(n)], [rnd.random() for _ in range(n)]
        chain = [(i - 1, i, rnd.random()) for i in range(1, n)] + [(0, n - 1, rnd.random())] * (n > 2)
        edges = chain if rnd.random() < 0.5 else [(i, j, rnd.random() * 0.5) for i in range(n) for j in range(i) if rnd.random() < 0.5]

        def cost(side):
            return sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(w for i, j, w in edges if side[i] != side[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(E.min_cut(source, sink, edges)) == pytest.approx(best, abs=1e-6)


def article_text(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op8_html_extraction"](spark, SF).collect()}
    assert {i: got[i]["text"] for i in pages} == {i: article_text(p) for i, p in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, accept them all please.</p></div>
<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><main><h1>Big &amp; news</h1><p>First long sentence of the story, with words.</p><!-- no -->
<div class="ad-box"><p>Buy now. Great things for little money.</p></div><p>Second&nbsp;sentence<br>goes <a href=x>on</a> here &lt;ok&gt;.</p><script>if (a<b) {"</p>"}</script>
<form><label>Mail</label><input><button>Send</button></form></main><aside class=sidebar><p>Related story about other things.</p></aside>
<section class="comments"><p>I think this is a great comment, thanks.</p></section><footer>&copy; 2020</footer></body></html>"""


def fitted(pages):
    rows = [r for k, p in enumerate(pages) for r in E.training_rows(p, bool(k & 1))]
    label, gap, same, x = zip(*rows, strict=True)
    return E.fit_costs(np.array(x), *(np.array(c, float) for c in (label, gap, same)))


@pytest.fixture(scope="module")
def page_costs():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    return pages, fitted(pages)


def test_page_parts(spark):
    costs = E.train_costs(spark.read.parquet(f"{SF}/pages.parquet"))
    assert E.main_text(PAGE, costs) == "Big & news\nFirst long sentence of the story, with words.\nSecond sentence goes on here <ok>."
    plain = "<p>Nothing tells what this is, but it reads like a text. It has sentences.</p><p>And a second paragraph follows it, as one would expect.</p>"
    assert E.main_text(plain, costs).count("\n") == 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>Text is good and long here.</p><p class="advert">Buy it now, it is good for you.</p><p id="cookie-notice">We use cookies for all.</p><p>Last text here.</p></article>', "Text is good and long here.\nLast text here."),
        ("<article><p>Seen text stands here.</p><p hidden>Not seen at all.</p><p>More <span hidden>unseen</span> text <span style='display: none'>gone</span> follows.</p></article>", "Seen text stands here.\nMore text follows."),
        ('<body class="sidebar-right has-banner"><article><p>Good text of the body.</p></article></body>', "Good text of the body."),
        ('<div class="wrap menu-open"><main><p>Good text of the main part.</p></main></div>', "Good text of the main part."),
        ('<article id="related-rates"><p>Rates are related.</p></article>', "Rates are related."),
        ('<div class="social-history"><p>A social history of the town.</p></div>', "A social history of the town."),
        ("<article><p>A<svg><svg><text>in</text></svg><text>leak</text></svg> b.</p></article>", "A b."),
        ("<article><script/>var a;</script><p>Seen.</p></article>", "Seen."),
        ("<article><p>One <script>if (a<b) x()</script>text.<p>Two &amp; &#233;.</article>", "One text.\nTwo & é."),
        ('<article><p>The story is told.</p></article><section class="comments"><p>I think this is a great comment, thanks.</p></section>', "The story is told."),
    ],
)
def test_elements_and_names(page_costs, page, text):
    assert E.main_text(page, page_costs[1]) == text


def without_roles(page):
    return re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", page).replace(' class="ad"', "")


def test_cut_decides_where_roles_are_missing(page_costs):
    """The fixture without containers and names: single blocks mislead the classifier, the cut restores the article."""
    pages, costs = page_costs
    alone = cut = 0
    for page in pages:
        blocks = E.parse_blocks(without_roles(page))
        want = set(article_text(page).split("\n"))
        alone += sum((z > 0) != (b.text in want) for z, b in zip(E.block_logits(blocks, costs), blocks, strict=True))
        cut += sum(c != (b.text in want) for c, b in zip(E.label_blocks(blocks, costs), blocks, strict=True))
        assert E.main_text(without_roles(page), costs) == article_text(page)
    assert cut <= 5 and alone > 100


def free_page(rnd):
    """A page without roles: short, linked and headed paragraphs in the text, sentences among the links."""
    vocabulary = "the of a and in it was with on time house river people story night water summer garden".split()
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    parts, body = [], ""
    for _ in range(rnd.randrange(6, 20)):
        long, u = rnd.random() < 0.7, rnd.random()
        t = say(rnd.randrange(15, 60)) + "." if long else say(rnd.randrange(1, 4))
        parts.append(t)
        body += f"<p>{t}</p>" if long or u < 0.4 else f"<p><a href=x>{t}</a></p>" if u < 0.6 else f"<h2>{t}</h2>"
    links = lambda: "<div><ul>" + "".join(f"<li><a href=x>{say(rnd.randrange(1, 4))}</a></li>" for _ in range(rnd.randrange(3, 9))) + (f"<li>{say(12)}.</li>" if rnd.random() < 0.5 else "") + "</ul></div>"
    return f"<body><div>{links()}</div><div>{body}</div><div>{links()}<div>© {say(3)}</div></div></body>", set(parts)


def test_cut_beats_threshold(page_costs):
    rnd = random.Random(3)
    alone = cut = 0
    for _ in range(100):
        page, want = free_page(rnd)
        blocks = E.parse_blocks(page)
        alone += sum((z > 0) != (b.text in want) for z, b in zip(E.block_logits(blocks, page_costs[1]), blocks, strict=True))
        cut += sum(c != (b.text in want) for c, b in zip(E.label_blocks(blocks, page_costs[1]), blocks, strict=True))
    assert cut < 0.85 * alone


def test_long_pages_take_linear_time(page_costs):
    import time

    page = "".join(f"<div><p>Long words here are many and say something {k}.</p></div><ul><li><a href=x>Go {k}</a></li></ul>" for k in range(5000))
    blocks = E.parse_blocks(page)
    at = time.perf_counter()
    assert len(E.label_blocks(blocks, page_costs[1])) == 10_000
    assert time.perf_counter() - at < 3  # under 1 s on an idle machine


def test_training_reads_whole_pages(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(E, "fit_costs", lambda x, label, gap, same: seen.update(label=sorted(label), gap=sorted(gap)))
    E.train_costs(spark.createDataFrame([("<article><p>" + "word " * 50_000 + "</p></article><footer>end</footer>",), ("<p>a</p>",), (None,)], "html string"))
    assert seen == {"label": [0, 1], "gap": [-1, 2]}


def test_samples_are_of_distinct_texts(spark):
    from chronorel.llm.common import distinct_sample

    frame = spark.createDataFrame([(t,) for t in [*["copy"] * 500, *map(str, range(20))]], "t string")
    assert len({r[0] for r in distinct_sample(frame, "t", 50).collect()}) == 21 == distinct_sample(frame, "t", 50).count()
    assert len({r[0] for r in distinct_sample(frame, "t", 8).collect()}) == 8 == distinct_sample(frame, "t", 8).count()


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<"), (4, "u", "<p>" * 3000 + "text"), (5, "u", "<script>never closed"), (6, "u", "a < b <c d='>'>e"), (None, "u", "<article><p>" + "long words. " * 20_000), (2, "u", "")]
    got = E.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and all(r["text"] is not None for r in got)
    assert E.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# personal data


def luhn(d):
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_personal_data(spark, docs_of, odd):
    rnd = random.Random(7)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (253) 555-3368", "+12", "1 2 3", "é😀", "w@x.y+z@q.r", "12345678901234567890", "--", ". ", "\n", "", "v1.2.3", "+1--..()  9999999", "word"]
    rows = odd + [(100 + n, "".join(rnd.choice(bits) + rnd.choice(["", " ", "-", "."]) for _ in range(rnd.randrange(1, 60)))) for n in range(150)]
    rows += [(400, "1 " * 30_000), (401, "a@b" + ".c" * 20_000), (402, "9" * 30_000), (403, "a.b_" * 20_000)]
    models = I.train_trees(docs_of(rows))
    got = I.span_report(I.find_personal_data(docs_of(rows), models)).collect()
    assert len(got) == len(rows)
    expected = Counter((i, hashlib.sha256(",".join(brute_pii(t or "")).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == expected
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        assert any(set(brute_pii(t)) <= set(r["spans"].split(",")) | {""} for t in texts[r["doc_id"]])
    assert I.find_personal_data(docs_of([])).count() == 0


def test_trees_add_what_looks_alike(spark, docs_of):
    rnd = random.Random(9)
    num = lambda: f"({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    rows = [(n, f"please call +1 {num()} or ask {rnd.randrange(10**6, 10**9)} of {rnd.randrange(100)}") for n in range(800)]
    models = I.train_trees(docs_of(rows))
    assert models["phone"].threshold < math.inf
    found = I.find_personal_data(docs_of([(1, "please call (253) 555-1234 now"), (2, "the year 2020 had 365 days"), (3, "mail a@b.cd")]), models)
    spans = {r["doc_id"]: r["spans"] for r in I.span_report(found).collect()}
    assert spans == {1: "phone:12:26", 2: "", 3: "email:5:11"}
    assert {r["doc_id"]: r["text"] for r in I.redact(found).collect()}[3] == "mail [email]"


def test_trees_add_hidden_forms(spark, docs_of):
    rnd = random.Random(11)

    def card():
        d = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        return d + next(str(c) for c in range(10) if luhn(d + str(c)))

    num = lambda: f"({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    rows = [(n, f"mail u{n}.x@host{n}.com or host 10.{n % 256}.7.{n % 99} or card {card()} or call +1 {num()} today") for n in range(400)]
    rows += [(1000 + n, f"please call {num()} or write to n{n} (at) mail (dot) org or see 10[.]1[.]{n}[.]9 soon") for n in range(200)]
    models = I.train_trees(docs_of(rows))
    hidden = {"email": ["jo.doe (at) site (dot) com", "jo.doe @ site.com"], "ip": ["10[.]20[.]30[.]40"], "card": ["3782.8224.6310.005", "4111.1111.1111.1111"], "phone": ["(253) 555-1234"]}
    others = ["meet me @ home. Then go", "buy 10 @ 3.50 now", "1,200,300,400", "3[.]1[.]999[.]4", "4111.1111.1111.1112", "item id=12345678901", "on 2024-01-15 we"]
    asked = [(kind, f"so take {m} please") for kind, forms in hidden.items() for m in forms] + [(None, t) for t in others]
    found = {r["doc_id"]: r["spans"] for r in I.span_report(I.find_personal_data(docs_of([(n, t) for n, (_, t) in enumerate(asked)]), models)).collect()}
    for n, (kind, t) in enumerate(asked):
        assert found[n] == (f"{kind}:8:{len(t) - 7}" if kind else ""), t


def test_rare_kinds_keep_their_trees(spark, docs_of):
    """A corpus without any personal data: what training makes up still tells hidden forms from decoys."""
    models = I.train_trees(docs_of([(n, f"plain text number {n} of 2024-01-{n % 28 + 1:02d}") for n in range(50)]))
    assert all(m.threshold < math.inf for m in models.values())
    planted = [("email", "ann.b (at) post (dot) net"), ("ip", "192[.]168[.]7[.]20"), ("card", "5105.1051.0510.5100"), ("phone", "(253) 555-1234")]
    rows = [(n, f"now {m} there") for n, (_, m) in enumerate(planted)] + [(9, "on 2024-01-15 at 3 @ 4"), (10, "555-7672 170.106.47.218")]
    spans = {r["doc_id"]: r["spans"] for r in I.span_report(I.find_personal_data(docs_of(rows), models)).collect()}
    assert spans == {**{n: f"{k}:4:{4 + len(m)}" for n, (k, m) in enumerate(planted)}, 9: "", 10: "ip:9:23"}


def test_many_spans_in_one_text(docs_of):
    text = " ".join(f"10.{i % 256}.7.{i % 99} a{i} (at) b{i}.de x@y{i}.com" for i in range(3_000))
    found = I.find_personal_data(docs_of([(1, text)]), I.train_trees(docs_of([(1, text[:2000])])))
    row = found.first()
    assert hashlib.sha256(",".join(brute_pii(text)).encode()).hexdigest() == I.span_report(found).first()["base_sha256"]
    spans = [(x["s"], x["e"], x["m"]) for k in I.KINDS for part in (k, f"{k}_added") for x in row[part]]
    assert len(row["email_added"]) == 3_000 and all(text[a:b] == m for a, b, m in spans)


# pipeline


def brute_stage(name, rows, docs, spark):
    """doc_ids that a stage should keep, from its input rows."""
    from test_dedup import brute_contained, brute_exact, brute_near

    if name == "toxicity":
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        return {r["doc_id"] for r in X.score_toxicity(docs, labels).collect() if r["score"] < 0.7}
    if name == "exact_dedup":
        return {i for i, _, _, kept, _ in brute_exact(rows) if kept}
    if name == "near_dedup":
        return {i for i, _, _, kept in brute_near(rows, 5) if kept}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    return {i for i, _ in rows} - {i for i, *_ in brute_contained(rows, items)}


def test_pipeline(spark, tmp_path, monkeypatch):
    """Each stage against brute force on its own input; all columns stay; run() packs what the stages keep."""
    monkeypatch.syspath_prepend(str(Path(__file__).parent))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
        assert {r[0] for r in out.select("doc_id").collect()} == brute_stage(name, rows, docs, spark)
        docs = out
    final = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_packing(final, corpus_pipeline.run(spark, SF).collect())


def test_stages_pass_odd_rows(spark, docs_of, odd):
    docs = docs_of(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == "packing"
        assert out.count() >= 8
        assert stage(spark, docs_of([]), SF).count() == 0
