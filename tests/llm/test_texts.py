"""Operators that judge single texts: language, quality, rules, extraction, licences, tokens."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrade.llm import bpe, extract, flat, langid, licenses, perplexity, quality, wordmodel
from pairgrade.llm.constants import let
from pairgrade.llm.license_texts import KNOWN
from pairgrade.llm.queries import byte_bpe
from pairgrade.llm.registry import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "x", "é", "a\nb", "Ünï cödé 漢字 🙂", "1234 !!!", "same same same same same same same same same " * 5, "line one\nline one\n\nline one"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "n", 1) for i, t in enumerate(ODD)] + [(4, ODD[4], None, "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, predicted int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_flat_spans_and_hashes():
    import pyarrow as pa

    texts = [t or "" for t in ODD]
    data, off = flat.utf8(pa.array(ODD))
    start, end, at = flat.words(data, off)
    raw = bytes(data)
    for i, t in enumerate(texts):
        assert [raw[s:e].decode() for s, e in zip(start[at[i]:at[i + 1]], end[at[i]:at[i + 1]], strict=True)] == brute.words(t)
    h = flat.hashes(data, start, end)
    w = [raw[s:e] for s, e in zip(start, end, strict=True)]
    assert len(set(h.tolist())) == len(set(w)) and len(set(zip(h.tolist(), w, strict=True))) == len(set(w))
    assert [(lo, hi) for lo, hi, _, _ in flat.chunks(pa.array(texts), 4)][0][0] == 0
    assert sum(len(d) for _, _, d, _ in flat.chunks(pa.array(texts), 4)) == len(raw)


def test_ppm_code_length_by_hand():
    text = b"abab"
    data, off = np.frombuffer(text, np.uint8), np.array([0, 4])
    key, n = np.unique(langid.grams(data, off, 1), return_counts=True)
    m = langid.build([("x", key, n)], 1)
    # order 0: a and b twice each, q = 2, n = 4: 2/6 each, escape 2/6; contexts: start -> a once, a -> b twice, b -> a once
    bits = m.code(langid.grams(np.frombuffer(b"abz", np.uint8), np.array([0, 3]), 1))[:, 0]
    assert np.allclose(bits, [-np.log2(1 / 2), -np.log2(2 / 3), -np.log2(1 / 2) - np.log2(2 / 6) + 8], atol=1e-4)


def test_language_held_out(spark, docs):
    got = QUERIES["op1_ppm_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(got) == docs.count() and (out.lang == out.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark, docs, odd):
    model = langid.fit(docs)
    got = langid.predict(odd, model, keep=("doc_id", "predicted")).collect()
    assert len(got) == len(ODD) + 1 and [r.lang_pred for r in got if r.doc_id in (0, 1, 2, 7)] == ["und"] * 4
    none = langid.fit(odd.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, none).collect()} == {("und", 0.0)}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_learning_sample_is_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    got = dict(langid.learning_sample(rows, "label", "key", 50).groupBy("label").count().collect())
    assert got == {"a": 50, "b": 50}


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op2_subword_quality"](spark, SF).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert ((out.score >= 0.3).astype(int) == out.predicted).all() and (out.predicted == out.quality).mean() > 0.85


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1), (5, 1), (8, 0), (8, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert model.labels == 3
    got = quality.predict(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    empty = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.predict(odd.select("doc_id", "text"), empty).collect()} == {0.0}


def test_quality_features_stay_in_their_text():
    import pyarrow as pa

    texts = ["ab", "abcdef gh", "", "x", "hello hello hello", "abcd"]
    data, off = flat.utf8(pa.array(texts))
    whole = quality.features(data, off)
    for i, t in enumerate(texts):
        d, o = flat.utf8(pa.array([t]))
        alone = np.sort(np.concatenate([x for x, _ in quality.features(d, o)]))
        assert (np.sort(np.concatenate([x[a[i]:a[i + 1]] for x, a in whole])) == alone).all()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abc d", np.uint8), 3000)
    key, n = np.unique(perplexity.grams(data, np.array([0, 3000])), return_counts=True)
    m = perplexity.build(key, n)
    for ctx in (key[:5] >> 6).tolist() + [0o77777, 12345]:
        every = (ctx << 6 | np.arange(64)).astype(np.int32) & 0xFFFFFF
        assert abs(np.exp2(-m.cost(every).astype(float)).sum() - 1) < 1e-3


def test_rules_statistics(spark, odd, docs):
    rows = odd.select("doc_id", "text", "lang").union(docs.limit(40).select("doc_id", "text", "lang"))
    got = perplexity.verdict(rows, key="text").collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.text_stats(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert perplexity.verdict(rows.limit(0)).count() == 0


def test_rules_reject_noise_and_keep_prose(spark):
    got = QUERIES["op3_perplexity_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.995 and bad.kept.mean() < 0.3


def test_rules_reject_words_out_of_order(spark):
    rng = random.Random(5)
    stock = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(400)]
    after = {w: rng.sample(stock, 2) for w in stock}

    def walk(n):
        out = [rng.choice(stock)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    prose = [" ".join(walk(100)) for _ in range(300)]
    mixed = [" ".join(rng.sample(words, len(words))) for words in (walk(100) for _ in range(10))]
    spelt = [" ".join("".join(rng.sample(w, 6)) for w in walk(100)) for _ in range(10)]
    rows = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(prose + mixed + spelt)], "doc_id long, text string, lang string")
    got = perplexity.verdict(rows).collect()
    kept = {r.doc_id: r.kept or r.base_failed for r in got}
    assert sum(r.base_failed for r in got) < 20
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 320))


def plain_word_bits(texts, own, low):
    """Mean bits of each text's words by dicts of the other half's counts, one bucket."""
    runs = [re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[0-9]", "0", brute.lower(t))) for t in texts]
    pairs = [list(zip([None, *w], w)) for w in runs]
    out = {}
    every = sorted({p for ps in pairs for p in ps}, key=str)
    models = []
    for m in (0, 1):
        c = {p: 0 for p in every}
        for k, ps in zip(own, pairs):
            if k & 1 == m:
                for p in ps:
                    c[p] += 1
        cut = wordmodel.discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4)))
        off = lambda n: [0, *cut][min(n, 3)]  # noqa: E731, B023
        total, free = Counter(), Counter()
        for (v, _), n in c.items():
            total[v] += n
            free[v] += off(n)
        models.append({(v, w): (n - off(n) + free[v] * 2 ** -low[w]) / total[v] if total[v] else 2 ** -low[w] for (v, w), n in c.items()})
    for k, ps in zip(own, pairs):
        if ps:
            out[k] = sum(-math.log2(models[1 - (k & 1)][p]) for p in ps) / len(ps)
    return out


def test_word_bits_equal_dicts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "Ab", "c1", "c2", "é", "漢", "d,d", "x"]) for _ in range(rng.randrange(1, 60))) for _ in range(100)]
    texts += [texts[0]] * 3 + [None, "", "...", "long " * 300_000 + "end"]
    rows = spark.createDataFrame([(t, 1) for t in texts], "text string, own int")
    own = [r[0] for r in rows.select(F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    model = perplexity.fit(rows)
    spelt = sorted({w for t in texts for w in re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[0-9]", "0", brute.lower(t)))})
    raw = [w.encode() for w in spelt]
    end = np.cumsum([len(w) for w in raw])
    bits = perplexity.spelling(model, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, end[:-1]], end)
    low = {w: min(round(4 * b), 255) / 4 for w, b in zip(spelt, bits.tolist())}
    want = plain_word_bits(texts, own, low)
    for part in (1, 5):
        got = {r["own"]: r["mean_bits"] for r in wordmodel.word_bits(rows.repartition(part), model, perplexity.spelling).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    # Frequent words in shards and small buckets: the same texts, about the same bits.
    monkeypatch.setattr(wordmodel, "HOT", 4)
    many = {r["own"]: r["mean_bits"] for r in wordmodel.word_bits(rows, model, perplexity.spelling, bucket=200).collect()}
    assert many.keys() == want.keys() and all(abs(many[k] - want[k]) < 2 for k in want)
    assert wordmodel.word_bits(rows.limit(0), model, perplexity.spelling).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x:1}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, really. Accept?</div><div id="content"><h1>Title &amp; more</h1>
<p>First <b>paragraph</b>, with   text &lt;3.<br>And a line.<p>Short one</p><script>var x = "<p>no</p>"</script>
<ul><li>item one, of the list<li>item two</ul></div><div class="comments"><p>Great post, I liked it. A lot.</p></div>
<aside>More, from us.</aside><form><p>Your name, please.</p></form><footer>(c) us, all of us.</footer></body>"""


def test_extraction(spark):
    text = "Title & more\n\nFirst paragraph, with text <3. And a line.\n\nShort one\n\nitem one, of the list\n\nitem two"
    assert extract.main_text(PAGE) == text
    for page, want in ((None, ""), ("", ""), ("<p", ""), ("<!-- x", ""), ("just text", "just text"), ("<div " * 50_000, ""), ("a < b", "a < b"), ("<article><h1>T</h1></article>", "T")):
        assert extract.main_text(page) == want
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = extract.extract(rows).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, text, len(text)), (1, text, len(text))]
    assert extract.extract(rows.limit(0)).count() == 0


def test_extraction_keeps_the_whole_article():
    body = "".join(f"<p>Paragraph {i}, which is long enough, tells a story; and it goes on, as stories do.</p>" for i in range(6))
    deep = "<table><tbody><tr><td>cell</td></tr></tbody></table><ol><li>one<ul><li><p>inner</p></li></ul></li></ol>"
    got = extract.main_text(f"<body><div class=top><ul><li><a href=/>Start</a></li></ul></div><div class=text>{body}{deep}{body}</div></body>")
    assert {"cell", "one", "inner"} <= set(got.split("\n\n")) and "Start" not in got
    linked = "<h1><a href=/t>Title</a></h1>", "<ul><li><a href=/x>Linked item</a></li></ul>"
    got = extract.main_text(f"<body><article>{linked[0]}{body}{linked[1]}</article></body>")
    assert got.startswith("Title\n\n") and got.endswith("\n\nLinked item")
    assert extract.main_text(f"<body><div>{linked[0]}{body}</div></body>").startswith("Title\n\n")
    side = "<div class=sidebar><p>Aside, here.</p></div>"
    for name in ("has-sidebar", "notice-text", "social-share-page"):
        got = extract.main_text(f"<body><div class={name}>{body}{side}</div></body>")
        assert "Paragraph 5" in got and "Aside" not in got
    assert "Paragraph" not in extract.main_text(f"<body><article><p>A short story, told.</p></article><div class=comments>{body}</div></body>")


def test_licences(spark):
    mit = KNOWN[0][1]
    texts = [mit, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;"), mit + " x", "prose\nReleased under the MIT licence!\nmore", None, "", "(c) 2019 me", "licence licence"]
    rows = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, license_id string")
    got = {r.doc_id: (r.license_id, list(r.notices), r.digest is None) for r in licenses.scan(rows, licenses.known(spark)).collect()}
    assert got == {0: ("MIT", [], False), 1: ("MIT", [], False), 2: (None, [], False), 3: (None, ["MIT"], False), 4: (None, [], True), 5: (None, [], True), 6: (None, [], True), 7: (None, [], False)}
    assert licenses.scan(rows.limit(0), licenses.known(spark)).count() == 0
    words = rows.where("doc_id = 7").select(licenses.lines(F.col("text"))[0]).first()[0]
    assert words == "license license"


def test_whole_licence_texts_and_holders(spark):
    full = dict((a, b) for a, b in reversed(KNOWN) if len(b) > 6000)  # the first variant of each, as it stands
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(full)
    mit = KNOWN[0][1]
    terms = full["Apache-2.0"].split("END OF TERMS")[0]
    heads = ["Copyright The Foo Authors", "Copyright Foo Inc. 2019", "Copyright <YEAR> <HOLDER>", "Copyright Foo Contributors", "Copyright Foo Bar, Inc. All rights reserved."]
    prose = ["copyright notice that is included in", "Copyright holders and contributors", "copyright license to reproduce,", "copyright law: that is to say,"]
    wanted = [(t, a) for a, t in full.items()] + [(" ".join(t.split("\n")), a) for a, t in full.items() if "copyright (c)" not in t.lower() and "yyyy" not in t]
    wanted += [(terms, "Apache-2.0"), (full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Foo"), "Apache-2.0")]
    wanted += [(f"{h}\n\n{mit}", "MIT") for h in heads] + [(f"{h}\n\n{mit}", None) for h in prose]
    wanted.append(("Copyright (c) 2021 Foo\n\n" + mit.replace("The above copyright", "The above\ncopyright"), "MIT"))
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(wanted)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows, licenses.known(spark)).collect()}
    assert [got[i].license_id for i in range(len(wanted))] == [x for _, x in wanted]
    import duckdb

    db = duckdb.connect()
    db.register("documents", rows.toArrow())
    assert {(i, d, x) for i, d, x, _ in db.execute(licenses.sql()).fetchall()} == {(r.doc_id, r.digest, r.license_id) for r in got.values()}


def test_bpe_like_the_library(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [*ODD, "Hello world's  \n\n x", "a" * 2000, "ab" * 700 + " " * 300 + "=" * 500, "<|endoftext|>", "日本語 한국어 ٣٤ \x85 \x1c", "".join(rng.choice("aeiou tn'sé1 \n") for _ in range(3000))]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    tok = byte_bpe()
    for r in tok.decode(tok.encode(rows, "text", "ids"), "ids", "back").collect():
        assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode() and r.n_tokens == 7
    words = rows.select(F.explode(tok.words(F.col("text"))).alias("w")).distinct().withColumn("_t", tok.tables(spark))
    for r in words.select("w", let(F.col("_t"), lambda t: tok.fold(t, F.col("w"))).alias("ids")).collect():
        assert list(r.ids) == enc.encode_ordinary(r.w)
    assert tok.encode(rows.limit(0), "text", "ids").count() == 0
    held = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op9_byte_bpe"](spark, SF).collect():
        ids = enc.encode_ordinary(held[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(held[r.doc_id].encode()).hexdigest()


def test_word_bits_do_not_depend_on_buckets(spark, monkeypatch):
    rng = random.Random(8)
    words = [a + b for a in "abcdefgh" for b in "klmnop"]
    texts = [" ".join("the" if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts + texts[:5] + [None, ""]], "text string")
    model = perplexity.fit(rows)
    bits = lambda df, **how: {r["own"]: r["mean_bits"] for r in wordmodel.word_bits(df, model, perplexity.spelling, **how).collect()}
    want = bits(rows)
    assert len(want) == len(set(texts))
    monkeypatch.setattr(wordmodel, "SEND", 500)
    for bucket in (3000, 400):  # "the" lies in several shards
        assert bits(rows.repartition(5), bucket=bucket) == want
    plan = wordmodel.word_bits(rows, model, perplexity.spelling, bucket=400)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
