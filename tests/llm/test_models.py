"""The classifier, language identification, SentencePiece, licences, archives, pages and the pipeline."""

import itertools
import random
import textwrap
import time
import zlib
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from hushframe.llm import html_text, language_gru, quality_crf, sentence_pieces, warc
from hushframe.llm.html_pages import MARKED, made_pages
from hushframe.llm.licence_scan import KNOWN, scan_licences
from hushframe.llm.licence_texts import TEXTS
from hushframe.llm.sentence_pieces import MODEL, Decoder, Encoder, Model, compile_bytes, compile_model, decode, encode, encode_and_decode, merges, round_trips

DOCS = "doc_id long, text string, score double, lang string"
GOOD = "the quick brown fox jumps over the lazy dog. and then it sleeps near the river.\nanother plain line of prose follows here."
BAD = "foo*** bar### baz$$$ qux%%% foo*** bar###\nBUY!! NOW!! BUY!! NOW!! BUY!! NOW!!"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "xx") for i, t in enumerate(texts)], DOCS)


# quality


def brute_marginals(field, x):
    """Marginals by summing over all labellings."""
    logit, total, good = x @ field.weights, 0.0, np.zeros(len(x))
    for labels in itertools.product((0, 1), repeat=len(x)):
        w = np.exp(sum(logit[i] * y for i, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        good += w * np.array(labels)
    return good / total


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    field = quality_crf.Field(rng.normal(size=3 * quality_crf.N_FEATURES), rng.normal(size=(2, 2)))
    texts = [b"one line", b"", b"A\nb\n\nccc ddd ddd\n*** !!!", b"x\ny", None]
    x, _, n_lines = quality_crf.line_features(texts)
    full = quality_crf.with_neighbours(x, *quality_crf.places(n_lines))
    assert n_lines.tolist() == [1, 1, 5, 2, 1]
    (got, length, counts), at = field.lines(texts), 0
    assert counts.tolist() == n_lines.tolist()
    scores = field.quality(texts)
    for k, n in enumerate(n_lines):
        brute = brute_marginals(field, full[at : at + n])
        assert np.allclose(got[at : at + n], brute)
        weight = np.maximum(length[at : at + n], 1e-3)
        assert scores[k] == pytest.approx(1 / (1 + np.exp(-field.slope * ((brute * weight).sum() / weight.sum() - field.middle))))
        at += n


def test_blocks_change_no_score(monkeypatch):
    rng = random.Random(3)
    field = quality_crf.Field(np.random.default_rng(2).normal(size=3 * quality_crf.N_FEATURES), np.array([[1.0, -1.0], [-0.5, 0.7]]))
    texts = ["\n".join(rng.choice(["", "a", "some words here.", "*** !!!", "x " * 40]) for _ in range(rng.choice([1, 3, 200, 900]))).encode() for _ in range(30)] + [None, b"", b"\n" * 500]
    want = field.quality(texts)
    monkeypatch.setattr(quality_crf, "BLOCK_LINES", 37)
    monkeypatch.setattr(quality_crf, "BLOCK_BYTES", 300)
    assert np.allclose(field.quality(texts), want)
    assert np.allclose([field.quality([t])[0] for t in texts], want)


def test_quality_is_learnt_and_applied(spark):
    rng = random.Random(2)
    shuffled = lambda t: "\n".join(" ".join(rng.sample(line.split(), len(line.split()))) for line in t.split("\n"))
    texts = [shuffled(GOOD if i % 3 else BAD) for i in range(120)] + [None, "", "x\n" * 3000]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    field = quality_crf.fit_on(docs, labels)
    got = {r["doc_id"]: r for r in quality_crf.score_quality(docs, field).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(120))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    kept = quality_crf.drop_low_quality(docs, field)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert quality_crf.score_quality(frame(spark, [])[["doc_id", "text"]], field).count() == 0


def test_quality_without_labels():
    assert quality_crf.fit([], []).quality([b"x", None]).tolist() == [0.5, 0.5]
    assert (quality_crf.fit([b"x"], [1]).quality([b"y"]) > 0.5).all() and (quality_crf.fit([b"x"], [0]).quality([b"y"]) < 0.5).all()


def test_quality_on_held_out_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_crf.score_quality(docs, quality_crf.fit_on(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) >= 0.9


# language


def test_gradients_match_differences():
    net = language_gru.train([b"hello world " * 8, b"und die der " * 8], ["en", "de"], steps=1)
    for part in (net.inputs, net.states, net.out):
        part[:] = [w.astype(np.float64) for w in part]
    rows, truth = np.frombuffer((b"hello und world der die das " * 4)[:96], np.uint8).reshape(2, -1), np.array([0, 1])
    _, slopes = net.slopes(rows, truth)
    for w, d in zip(net.weights()[:-1], slopes):
        at, step = np.unravel_index(np.abs(d).argmax(), d.shape), 1e-4
        kept, two = w[at], []
        for sign in (1, -1):
            w[at] = kept + sign * step
            two.append(net.slopes(rows, truth)[0])
        w[at] = kept
        assert abs(d[at] - (two[0] - two[1]) / (2 * step)) < 1e-3 * max(1e-2, abs(d[at]))


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = language_gru.train_on(docs)
    found = language_gru.identify(docs, net).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert found and np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.9
    odd = {r["doc_id"]: r for r in language_gru.identify(frame(spark, [None, "", "12 !?", "é", "x" * 200_000]), net).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and odd[0]["score"] == 0
    assert all(odd[i]["lang_pred"] in net.langs and 0 < odd[i]["score"] <= 1 for i in (3, 4))
    assert len(net.labels("où est".encode())) == 7
    none = language_gru.train_on(docs.limit(0))
    assert language_gru.identify(frame(spark, ["text"]), none).first()["lang_pred"] == "und"
    assert language_gru.identify(frame(spark, []), net).count() == 0


def test_languages_without_letters_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "12 34 !?", "ab"[i % 2]) for i in range(1, 30)] + [(None, "text", "a")], "doc_id long, text string, lang string")
    found = language_gru.identify(docs, language_gru.train_on(docs)).collect()
    assert len(found) == 30 and {r["lang_pred"] for r in found if r["doc_id"] is not None} == {"und"}


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return compile_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(spark, sf, pieces):
    model, library = pieces
    rng = random.Random(1)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice("ab cdé\n\t  龘😀▁.,1 ́the ing") for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", " ", "  ", "a" * 3000, " " * 40, "\n\n", "ſ"]
    texts += [" " * n + tail for n in (*range(2, 40), 5000) for tail in ("", "the", "x.")]
    ids = Encoder(model).encode_all([None, *texts])
    assert len(ids.pop(0)) == 0
    for text, own, back in zip(texts, ids, Decoder(model).decode_all(ids)):
        assert own.tolist() == library.encode(text)
        assert "▁" in text or back == text


def test_small_memory_and_long_texts_change_nothing(spark, sf, pieces, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ["  a   " * 999, " " * 7000, "x" * 9000 + " b"]
    want = [x.tolist() for x in Encoder(pieces[0]).encode_all(texts)]
    monkeypatch.setattr(sentence_pieces, "MEMORY", 50)
    monkeypatch.setattr(sentence_pieces, "SEGMENT", 1000)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 6)
    assert [x.tolist() for x in Encoder(pieces[0]).encode_all(texts)] == want


def test_pairs_settle_like_merges(pieces):
    model, _ = pieces
    rng, encoder, known = random.Random(4), Encoder(model), [i for i, p in enumerate(model.pieces) if p in model.when]
    number = {model.pieces[i]: i for i in known}
    for _ in range(4000):
        text = model.pieces[rng.choice(known)] + model.pieces[rng.choice(known)].lstrip("▁")
        cut = rng.randrange(1, len(text)) if len(text) > 1 else 1
        left, right = text[:cut], text[cut:]
        if left in number and right in number:
            assert encoder._barred(number[left], number[right]) == (merges(text, model.rank) != [left, right])


def unigram(cost):
    model = Model("u", "unigram", list(cost), list(cost.values()), [len(cost)] * 256, [p.encode() for p in cost] + [b"?"])
    model.build(list(range(len(cost))))
    return model


def test_unigram_takes_the_cheapest_path():
    cost = {"a": 3.0, "b": 3.0, "ab": 5.0, "▁": 1.0, "▁a": 3.5, "abb": 7.0, "bb": 1.0}
    names = list(cost)
    every = lambda w: [[w[:i], *rest] for i in range(1, len(w) + 1) if w[:i] in cost for rest in every(w[i:])] if w else [[]]
    words = ["▁" + "".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)]
    for word, ids in zip(words, Encoder(unigram(cost)).shortest_paths(words)):
        assert "".join(names[i] for i in ids) == word
        assert sum(cost[names[i]] for i in ids) == min(sum(cost[p] for p in path) for path in every(word))
    assert Encoder(unigram(cost)).shortest_paths(["aéb"])[0].tolist() == [0, 7, 7, 1]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("trims", [True, False])
def test_normaliser_maps_equal_the_library(rule, trims):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    if rule != "identity":
        made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        other = sentencepiece_model_pb2.ModelProto()
        other.ParseFromString(made.serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = trims
    data = proto.SerializeToString()
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=data), Encoder(compile_bytes(data))
    rng = random.Random(8)
    texts = ["ﬁne ①½ ｶﾞ Ａ\u3000Ｂ  e\u0301 ẛ̣ \t x\n\ny ", "", "   ", " a  b "] + ["".join(rng.choice("aB \t\n ﬁ①ｶﾞ가각e\u0301\u0323Ⅷ\u200b\u00a0™x") for _ in range(rng.randrange(25))) for _ in range(600)]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert ids.tolist() == library.encode(text), text


def test_round_trips(spark, pieces):
    texts = [None, "", "plain text", "two  blanks\n\ttab 😀", "has ▁ mark", "long " * 20_000]
    got = {r["doc_id"]: r for r in round_trips(frame(spark, texts)).collect()}
    assert [got[i]["round_trip"] for i in range(6)] == [True, True, True, True, False, True]
    assert got[0]["ids_sha256"] is None and got[1]["n_pieces"] == 0 and got[3]["n_fallback"] > 0
    assert got[2]["ids_sha256"] == sha256(" ".join(map(str, pieces[1].encode("plain text"))).encode()).hexdigest()
    assert encode(frame(spark, [])).count() == 0 and encode_and_decode(frame(spark, [])).count() == 0
    two = {r["doc_id"]: r for r in decode(encode(frame(spark, texts))).collect()}
    one = {r["doc_id"]: r for r in encode_and_decode(frame(spark, texts)).collect()}
    assert all(two[i]["decoded"] == one[i]["decoded"] and two[i]["ids"] == one[i]["ids"] and two[i]["n_fallback"] == one[i]["n_fallback"] for i in one)
    assert one[0]["ids"] is None and one[0]["decoded"] is None and two[4]["text"] == "has ▁ mark"
    odd = spark.createDataFrame([(None, "a b", 1, [2], "z")] * 2 + [(7, None, 1, None, "z")], "doc_id long, text string, n_pieces int, ids array<int>, decoded string")
    assert sorted((r["doc_id"] is None, r["n_pieces"], r["round_trip"]) for r in round_trips(odd).collect()) == [(False, 0, True), (True, 2, True), (True, 2, True)]


# licences


def test_licences(spark):
    mit = next(t for n, t in KNOWN if n == "MIT" and len(t) > 200)
    texts = [None, "", "nothing here", "prose\nreleased under the mit LICENCE\nmore", "Copyright (c) 2020 Somebody\n\n" + mit.replace(". ", ".\n\n").upper(), "Licensed under CC BY-NC 4.0.\nLicensed under CC  by-nc, 4.0", "It is Licensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: (r["licences"], r["n_lines"], r["whole"]) for r in scan_licences(frame(spark, texts)).collect()}
    assert got == {0: ("", 0, False), 1: ("", 0, False), 2: ("", 0, False), 3: ("MIT", 1, False), 4: ("MIT", 0, True), 5: ("CC-BY-NC-4.0", 2, False), 6: ("", 0, False)}
    assert scan_licences(frame(spark, [])).count() == 0


def test_whole_licences_with_titles_comment_marks_and_copyright_on_one_line(spark):
    mit = next(t for n, t in KNOWN if n == "MIT" and len(t) > 200)
    bsd3 = next(t for n, t in TEXTS if n == "BSD-3-Clause" and "copyright holder" in t)
    texts = [t for _, t in TEXTS] + ["MIT License\n\nCopyright (c) 2020 J. Smith\n\n" + "\n\n".join(textwrap.wrap(mit, 78))]
    texts += ["\n".join("# " + x for x in ["Copyright (c) 2020 J. Smith", *textwrap.wrap(mit, 70)]), "/*\n * Copyright 2020 X.\n * All rights reserved.\n *\n * " + mit + "\n */"]
    texts += ["Copyright (c) 2020 X. " + mit, "© 2020 X. Licensed under CC BY 4.0.", "BSD 3-Clause License\n\nCopyright (c) 2020, X\n\n" + bsd3, "Copyright (c) 2020 somebody else"]
    got = {r["doc_id"]: (r["licences"], r["whole"]) for r in scan_licences(frame(spark, texts)).collect()}
    want = [n for n, _ in TEXTS] + ["MIT", "MIT", "MIT", "MIT", "CC-BY-4.0", "BSD-3-Clause", ""]
    assert got == {i: (n, n != "") for i, n in enumerate(want)}


# archives

PAGES = "page_id long, url string, html string, digest string, offset int"


def test_archives(spark):
    same, small = "<p>" + "same é " * 50, "tiny"
    html = [same, None, small, same, "", small, "other " * 40, same]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i} é\r\nX: y", h, "clash", 1) for i, h in enumerate(html)] + [(None, "u", same, "clash", 1)], PAGES)
    index = warc.write_archives(pages, file_bytes=300)
    assert index.select("file").distinct().count() > 1
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert len(got) == 9
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = html.index(h) if h and len(data) >= 100 else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
        assert r["payload"] == (data if first == i else None)
    assert got[None]["record_type"] == "response"
    assert [r["page_id"] for r in warc.read_records(index.filter("page_id = 6"), payloads=False).collect()] == [6]
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_ranges_and_damage():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (500, 5)], gap=90, most=200) == [(0, 3, 105), (3, 4, 5)]
    assert warc.ranges([(0, 10), (10, 10)], gap=0, most=15) == [(0, 1, 10), (1, 2, 10)]
    good = warc.record(1, "u", b"data" * 30, sha256(b"data" * 30).hexdigest(), None)
    assert warc.parse(good)["payload"] == b"data" * 30
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"data" * 30, "0" * 64, None))


# pages


def test_minimum_cut_matches_enumeration():
    rng = random.Random(6)
    for _ in range(120):
        n = rng.randrange(1, 9)
        source, sink = ([rng.randrange(8) for _ in range(n)] for _ in "ab")
        edges = [(*rng.sample(range(n), 2), rng.randrange(1, 6)) for _ in range(2 * n if n > 1 else 0)]
        price = lambda side: sum((sink if s else source)[i] for i, s in enumerate(side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731, B023
        assert price(html_text.minimum_cut(source, sink, edges)) == min(price(x) for x in itertools.product((False, True), repeat=n))


def energy(gains, edges, side):
    return sum(abs(g) for g, keep in zip(gains, side) if (g > 0) != keep) + sum(w for a, b, w in edges if side[a] != side[b])


def test_labels_of_small_pages_match_enumeration():
    weights, checked, flows = html_text.fitted(), 0, 0
    for html in made_pages(41, 250):
        page = html_text.Page(html)
        if not 1 <= len(page.blocks) <= 11:
            continue
        gains = np.clip(np.array(page.features()) @ weights, -8, 8)
        labels, edges = html_text.label(page, gains), page.edges()
        least = min(energy(gains, edges, x) for x in itertools.product((False, True), repeat=len(gains)))
        assert energy(gains, edges, labels) == pytest.approx(least)
        checked += 1
        flows += labels != [g > 0 for g in gains]
    assert checked > 60 and flows > 2


def test_the_cut_betters_the_classifier_on_pages_it_was_not_fitted_on():
    weights, changed, better, right, n = html_text.fitted(), 0, 0, 0, 0
    for html in made_pages(77, 250):
        page = html_text.Page(html)
        truth = [b.text.startswith(MARKED) for b in page.blocks]
        for b in page.blocks:
            b.text = b.text.lstrip(MARKED) or b.text
        gains = np.array(page.features()) @ weights
        for own, cut, true in zip((gains > 0).tolist(), html_text.label(page, gains), truth):
            changed += own != cut
            better += (cut == true) - (own == true)
            right += cut == true
            n += 1
    assert changed > 20 and better > 5 and right / n > 0.96


def test_names_alone_decide_nothing():
    article = "<article><h1>The title</h1><p>A first line of the article.</p><p>And a second one, which is longer than the first, says more.</p></article>"
    whole, prose = "The title\nA first line of the article.\nAnd a second one, which is longer than the first, says more.", "A long line of prose goes on and on. " * 8
    assert html_text.main_text(f'{article}<div class="reactions"><p>Nice piece, thanks a lot!</p><p>I do not agree.</p></div><div id="bottom">All rights reserved</div>') == whole
    assert html_text.main_text(f"<div class='social-history'>{article}</div>") == whole
    assert html_text.main_text(f"<article><h1>T</h1><section class='search-for-meaning'><p>{prose}</p><p>Second.</p></section></article>") == f"T\n{prose.strip()}\nSecond."
    assert html_text.main_text("<p>All of it.</p>") == "All of it."


def test_deep_nesting_takes_linear_time():
    began = time.perf_counter()
    assert html_text.main_text("<div>" * 30_000 + "x") in ("x", "")
    html_text.main_text("<div>x" * 20_000)
    html_text.main_text("<b>" * 20_000 + "<p>x</i>" * 20_000)
    assert time.perf_counter() - began < 30


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies. Please accept them all now.</div>
<article><h1>A &amp; B</h1><p><b>First &eacute;  line<br>goes on.<p>Second&nbsp;line.</p><div class=ad>Buy this very good thing today.</div><p>x</p><ul><li>One point</li></ul></article>
<aside>Side text that is long enough to count.</aside><form><label>Name</label><input></form><section id="comments"><p>A reader says something quite long here.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "A & B\nFirst é line goes on.\nSecond line.\nx\nOne point"
    assert [html_text.main_text(x) for x in (None, "", "<nav><a href=x>y</a></nav>", "<article><p>cut off &am")] == ["", "", "", "cut off &am"]
    long = "<article>" + "".join(f"<p>Paragraph number {i} of a long page.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999
    pages = spark.createDataFrame([(1, "u", PAGE, "x", 3), (1, "u", PAGE, "x", 3), (2, None, None, "x", 3), (None, None, "<p>some text</p>", None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages).collect()
    assert [(r["page_id"], r["n_chars"], len(r["text"])) for r in got] == [(1, len(got[0]["text"]), len(got[0]["text"]))] * 2 + [(2, 0, 0), (None, 9, 9)]
    assert html_text.extract(pages.limit(0)).count() == 0


ARTICLE = "<article><header><h1>The title</h1></header><p>A first line of the article.</p><section id='related-work'><h2 id='sharing-data'>Data</h2><p>A second line of it.</p></section></article>"
WRAPPERS = ["<div class='site has-sidebar'>{}</div>", "<div id=page class='with-sidebar'>{}</div>", "<form id=aspnetForm>{}</form>", "<div class='no-sidebar widget-area'>{}</div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_do_not_hide_an_article(wrapper):
    whole = "The title\nA first line of the article.\nData\nA second line of it."
    around = "<nav><a href=/a>A</a></nav>{}<aside>Side text that is long enough to count.</aside><div class=sidebar><p>More side text that is long enough.</p></div>"
    assert html_text.main_text(wrapper.format(around.format(ARTICLE))) == whole


def test_layout_words_and_titles_made_ids():
    prose = "<p>" + "A long line of prose goes on and on. " * 8 + "</p>"
    assert html_text.main_text(f"<div class='page has-sidebar'>{prose}</div>") != ""
    assert html_text.main_text(f"<main><section id='search-algorithms'>{prose}</section></main>") != ""
    assert html_text.main_text(f"<form><nav><a href=/a>A</a></nav><div><h1>T</h1>{prose}</div></form>").startswith("T\nA long line")
    # boilerplate inside an article, and what a page hides, stay out
    assert html_text.main_text(f"<article><p>Text of it.</p><div class='related'>{prose}</div><section class=comments>{prose}</section></article>") == "Text of it."
    assert html_text.main_text(f"<div hidden><article>{prose}</article></div>") == ""


# pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
    assert out.count() == docs.count() > 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in out.collect():
        assert r["text"] == texts[r["doc_id"]] and list(r["ids"]) == library.encode(r["text"])
