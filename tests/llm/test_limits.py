"""Large numbers and long texts: top-k scores beyond 2**53, a long text with many hits."""

import random

import numpy as np
import pytest


def test_top_k_beyond_doubles(spark):
    from millrace.llm.topk import exact_top_k

    rnd = random.Random(7)
    rows = [(i, [float(rnd.randint(900_000, 1_100_000)) + rnd.randrange(64) / 64 for _ in range(8)]) for i in range(60)]
    rows += [(60 + i, [float(rnd.randint(-(10**6), 10**6)) for _ in range(8)]) for i in range(60)]
    got = {}
    for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    for q in range(0, 120, 20):
        scores = sorted(((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q))[:20]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert max(s for v in got.values() for _, _, s in v) > 2**53


def test_top_k_past_a_long(spark):
    from millrace.llm.topk import exact_top_k

    rows = [(i, [3e8 + i, 1.0]) for i in range(30)]
    with pytest.raises(Exception, match="64-bit"):
        exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_long_text_of_few_words(spark):
    """20,000 words out of eight, against 100 items of 30 of them: tens of thousands of hits in one document."""
    from millrace.llm.decontaminate import contaminated_pairs

    rnd = random.Random(3)
    eight = [f"w{k}" for k in range(8)]
    text = [rnd.choice(eight) for _ in range(20_000)]
    items = [[rnd.choice(eight) for _ in range(30)] for _ in range(100)]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["item_id"]): r["first_word"] for r in contaminated_pairs(docs, bench).collect()}
    words = np.array([eight.index(w) for w in text])
    for k, item in enumerate(items):
        item = np.array([eight.index(w) for w in item])
        first = None
        for a in range(len(item) - 12):
            agree = sum((words[j : len(words) - 12 + j] == item[a + j]).astype(int) for j in range(13))
            at = np.flatnonzero(agree >= 10)
            if len(at):
                first = int(at[0]) if first is None else min(first, int(at[0]))
        assert got.get(k) == first


def test_html_names_and_page_forms():
    """Comments, forms and adverts by names made of such a word and container words; a form around the page keeps its article."""
    from millrace.llm.html import page_blocks, proposed

    kept = lambda inner: proposed(page_blocks(inner))
    marks = ['class="reader-comments"', 'id="user-comments"', 'class="comment-thread"', 'class="newsletter-signup-form"', 'class="google-ad"', 'class="related-articles"', 'class="you-may-also-like-promo"']
    for mark in marks:
        assert kept(f"<article><p>Text.</p><div {mark}><p>Unique words of somebody.</p></div><p>More.</p></article>") == (["Text.", "More."], [False, False])
    # names that say more stay open
    assert kept('<article><p>Text.</p><section class="related-work"><p>Smith.</p></section></article>') == (["Text.", "Smith."], [False, True])
    page = '<body><form id="aspnet"><input type="hidden"><div><article><p>Text.</p><form><p>Your name</p><input></form><p>More.</p></article></div></form><div>Elsewhere</div></body>'
    assert kept(page)[0] == ["Text.", "More."]
    assert kept("<form action=x><MAIN><p>Text.</p></MAIN></form>")[0] == ["Text."]
    assert kept("<form><p>Ask</p></form><main><p>Text.</p></main>")[0] == ["Text."]


def test_toxicity_words_stay_on_the_executors(spark, monkeypatch):
    """Of the sample's words the driver gets those that a model chooses, not each row's whole set; an id with two texts is used once."""
    from millrace.llm.toxicity import train_toxicity

    rnd = random.Random(8)
    rows = [(i, " ".join([f"w{rnd.randrange(10**6)}" for _ in range(300)] + [f"c{rnd.randrange(200)}" for _ in range(100)] + ["vile"] * (i % 5 == 0))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (5, "another text of this id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    sent, plain = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: (sent.append((out := plain(df)).nbytes), out)[1])
    chain = train_toxicity(docs, labels)
    assert 0 < sum(sent) < 8 * sum(len(set(t.split())) for _, t in rows) / 4, sent
    again = train_toxicity(docs.repartition(3), labels)
    for one, other in zip(chain.models, again.models, strict=True):
        assert (one.words == other.words).all() and (one.weights == other.weights).all()
    assert chain.threshold == again.threshold
