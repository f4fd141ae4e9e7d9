"""Operators that look at one text at a time, against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageforge.llm import bpe_trie, htmltext, langid, licenses, pii
from pageforge.llm.wordcodes import library_codes

VOCABULARY = path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "a" * 3000, "é" * 2000, "!" * 999, "don't 'tis 's's ''s", "中文 Ω İ ſ ²", "<|endoftext|> x <|", "1234.5", "a\x85b c", "éé", "x" * 5 + "‍"]


def frame(spark, texts):
    """Texts with clashing extra columns."""
    rows = [(i, t, 1.0, "en", "s", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n double, lang string, ids string, piece string")


def fuzz(pieces, n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, size))) for _ in range(n)]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("codes", [lambda: library_codes(VOCABULARY), lambda: bpe_trie.trie_codes(VOCABULARY)[0]])
def test_ids_are_the_library_s(codes):
    texts = ODD + fuzz(["a", "b", "'s", "'re", "'", "''", "É", "×", " ", "\n", "1", "ß", "Ω", "<|endoftext|>", "<|", "the", "ing", "!!", "²", "中", "\x1c", "don't", "Σς"], 1500, 25, 1)
    ids, off = codes()(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == library(texts)


def test_trie_query_rows(spark):
    out = {r["doc_id"]: r for r in bpe_trie.digests(frame(spark, ODD), VOCABULARY).collect()}
    own = Tokenizer.from_file(VOCABULARY)
    for i, ids in enumerate(library(ODD)):
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe_trie.decode(bpe_trie.encode(frame(spark, ODD), VOCABULARY), VOCABULARY)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: own.decode(ids, skip_special_tokens=False) for i, ids in enumerate(library(ODD))}


def plain_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_the_patterns():
    for x in fuzz(["a", "@", ".", "b.c", "1", "255", "256", "..", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "x@y.z", "é", "_", "%", "007", "1.2.3.4", "+1 555 0123 45"], 4000, 14, 2):
        assert pii.base_spans(x) == plain_spans(x)


def test_field_adds_and_base_stays(spark):
    texts = ["é call me at (415) 555-0132 today", "mail a.b@c.org or +1 (212) 555-0199", "on 12 March 2021 at 10:30 we paid $ 1,299.00", *ODD]
    out = {r["doc_id"]: r for r in pii.spans(frame(spark, texts)).collect()}
    assert [(s["kind"], texts[0][s["start"] : s["end"]]) for s in out[0]["added"]] == [("phone", "(415) 555-0132")]
    assert [(s["kind"], s["start"], s["end"]) for s in out[1]["base"]] == plain_spans(texts[1])
    assert out[2]["base"] == [] and out[2]["added"] == []
    assert pii.masked(texts[1], plain_spans(texts[1])) == "mail <email> or <phone>"
    masked = {r["doc_id"]: r["text"] for r in pii.mask(frame(spark, texts), text="text").collect()}
    assert masked[0] == "é call me at <phone> today" and masked[3] is None and masked[2] == texts[2]


def test_field_learns_its_table():
    field, good = pii.train(), 0
    for row in pii.LABELLED:
        text, spans = pii._parse(row)
        data = np.frombuffer(text.encode(), np.uint8)
        good += [(s, e, k) for _, s, e, k in pii.field_spans(field, data, np.array([0, len(data)]))] == spans
    assert good >= 0.9 * len(pii.LABELLED)


def tiny_field(seed, places=4):
    """A field with random weights over random features, its sequences and all their labellings."""
    rng = np.random.default_rng(seed)
    field = pii.Field()
    field.emission = rng.normal(0, 2, field.emission.shape)
    field.step = np.where(field.step < -1e3, field.step, rng.normal(0, 2, field.step.shape))
    field.start = np.where(field.start < -1e3, field.start, rng.normal(0, 2, field.start.shape))
    feats = rng.integers(0, pii.N_FEATURES, (3, places, 4))
    mask = np.arange(places) < np.array([places, 2, 1])[:, None]
    return field, feats, mask


def score_of(field, e, labels):
    return field.start[labels[0]] + sum(e[k, y] for k, y in enumerate(labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_is_the_best_of_all_labellings(seed):
    field, feats, mask = tiny_field(seed)
    found, e = field.decode(feats, mask), field.scores(feats)
    for i, n in enumerate(mask.sum(1)):
        every = itertools.product(range(len(pii.LABELS)), repeat=int(n))
        assert found[i, :n].tolist() == list(max(every, key=lambda y: score_of(field, e[i], y)))


def test_training_climbs_the_likelihood():
    field, feats, mask = tiny_field(7, places=3)
    gold = np.array([[0, 1, 2], [1, 2, 0], [3, 0, 0]])
    kept = (field.emission.copy(), field.step.copy(), field.start.copy())

    def likelihood(f):
        e, total = f.scores(feats), 0.0
        for i, n in enumerate(mask.sum(1)):
            every = [score_of(f, e[i], y) for y in itertools.product(range(len(pii.LABELS)), repeat=int(n))]
            total += score_of(f, e[i], gold[i, :n]) - np.logaddexp.reduce(every)
        return total

    # the first AdaGrad step is rate * sign(gradient): compare the signs with differences of the enumerated likelihood
    field.train(feats, mask, gold, rounds=1, rate=1e-3, ridge=0.0)
    moved = [field.emission - kept[0], field.step - kept[1], field.start - kept[2]]
    before = pii.Field()
    for k, name in enumerate(("emission", "step", "start")):
        spots = np.argwhere(np.abs(moved[k]) > 5e-4)
        for spot in spots[:: max(1, len(spots) // 12)]:
            values = []
            for d in (1e-4, -1e-4):
                before.emission, before.step, before.start = (x.copy() for x in kept)
                getattr(before, name)[tuple(spot)] += d
                values.append(likelihood(before))
            gradient = (values[0] - values[1]) / 2e-4
            if abs(gradient) > 1e-3:
                assert np.sign(gradient) == np.sign(moved[k][tuple(spot)])


def test_secrets_and_many_spans(spark):
    token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    texts = [f'then token = "{token}" here', "mail a.b@c.org or +1 (212) 555-0199 now. " * 3000, 'a "b2b" firm and "R2D2"']
    out = {r["doc_id"]: r for r in pii.spans(frame(spark, texts)).collect()}
    assert [(s["kind"], texts[0][s["start"] : s["end"]]) for s in out[0]["added"]] == [("secret", token)]
    assert len(out[1]["base"]) == 6000 and out[1]["added"] == [] and out[2]["added"] == []
    digest = {r["doc_id"]: r for r in pii.digest(pii.spans(frame(spark, texts))).collect()}
    assert digest[0]["n_spans"] == 1 and digest[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and digest[0]["spans"].startswith("secret:14:")
    repeated = pii.spans(frame(spark, texts[:1]).union(frame(spark, texts[:1])))
    assert repeated.count() == 2


def brute_apart(added, base):
    return [x for x in added if not any(x[1] < e and s < x[2] for _, s, e in base)]


def test_added_spans_keep_off_base_spans():
    rng = random.Random(6)
    for _ in range(2000):
        some = lambda n: [("k", s, s + rng.randint(1, 6)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, n)))]
        added, base = some(5), some(6)
        assert pii._apart(added, base) == brute_apart(added, base)


def test_license_places(spark):
    pieces = ["gnu ", "General-", "PUBLIC ", "license", " License", "apache ", "MIT ", "cc", "-by", " by ", "é", "x ", ". ", "version 3", "SPDX-License-Identifier: MIT\n"]
    texts = [*ODD, *fuzz(pieces, 300, 12, 3)]
    out = {r["doc_id"]: r for r in licenses.digest(licenses.scan(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        assert (out[i]["n_words"], out[i]["n_base"], out[i]["first_word"], out[i]["last_word"]) == (len(words), len(places), first, last)
        assert out[i]["base_labels"] == ",".join(sorted({label for _, label in places})) and 0 <= out[i]["score"] <= 1


@pytest.mark.parametrize("gap", [" ", "\n * ", "-"])
def test_every_license_name_is_found_alone(gap):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "isc": "Permission to use, copy, modify and or distribute this software for any purpose with or without fee",
        "bsd-3-clause": "Neither the name of the owner may be used to endorse or promote products",
        "bsd-2-clause": "Redistribution and use in source and binary forms with or without modification are permitted",
        "gpl": "you can redistribute it and or modify it under the terms of the GNU General Public License",
        "unlicense": "This is free and unencumbered software released into the public domain",
        "public-domain": "Placed in the public domain",
        "proprietary": "All rights reserved worldwide",
        "cc-by-sa": "licensed under the Creative Commons Attribution Share Alike",
        "gpl-or-later": "GNU General Public License version 2 or at your option any later version",
    }
    assert set(notices) <= {n[0] for n in licenses.NOTICES}
    plain = [(label, text) for label, text, *_ in licenses.NOTICES if not re.search(r"[^a-z0-9 ]", text)]
    fits = lambda text: re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)\??", r"\1", text.replace("(?:e?ment)", "ment").replace("[^.]{1,120}", "the owner")).replace("?", "").replace("[0-9]", "4").replace("[cs]", "c").replace("[123]", "2")
    plain += [(label, fits(text)) for label, text, *_ in licenses.NOTICES if re.search(r"[^a-z0-9 ]", text)]
    cases = [*notices.items(), *plain, *((label, name) for label, names, *_ in licenses.LICENSES for name in names), ("lgpl-2.1", "Licensed under LGPL v2.1"), ("mpl-2.0", "MPL-2.0")]
    texts = ["Notes. " + text.replace(" ", gap) + " end" for _, text in cases]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = [row for part in licenses._scan(iter([batch])) for row in part.column("found").to_pylist()]
    assert [case for case, row in zip(cases, found) if case[0] not in {d["label"] for d in row}] == []


def test_license_suppression():
    found = licenses.detect(b"licensed under the apache license, version 2.0. spdx-license-identifier: gpl-3.0-or-later")
    assert [(label, rule.split(":")[0]) for _, _, label, rule, _ in found] == [("apache-2.0", "name1"), ("gpl-3.0", "spdx")]
    assert licenses.detect(b"the rail commits to the smit licenses") == [] and len(licenses.RULES) > 200


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.is_held_out(F.col("doc_id"))).toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97
    odd = {r["doc_id"]: r for r in langid.predict(frame(spark, [*ODD, "123 !!"]), model).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[len(ODD)]["lang_pred"] == "und" and odd[7]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in langid.predict(frame(spark, ["words"]), None).collect()} == {"und"}


def article_of(page):
    body = re.sub(r"\{\{.*?\}\}", " ", page.partition("[[")[2].partition("]]")[0])
    return " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|a)\b[^>]*>", "", body)).split())


def without_signs(page):
    return re.sub(r"\[\[|\]\]|\{\{|\}\}", "", page)


def plain_grams(text):
    low = "".join(c if c.isalpha() and ord(c) < 0x250 and c not in "×÷ªº" else " " for c in text.lower())
    raw = low.encode()
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_kernel_and_regression_by_definition():
    texts = ["the cat sat on the mat", "le chat est sur la table", "der hund ist im haus", "the dog ran to the house", "la maison est grande", "das haus ist alt"]
    langs = ["en", "fr", "de", "en", "fr", "de"]
    seen, has = langid.presence(pa.array(texts))
    grams = [plain_grams(t) for t in texts]
    for i in range(6):
        for j in range(6):  # hashed n-grams may meet, rarely
            assert abs(int((seen[i] & seen[j]).sum()) - len(grams[i] & grams[j])) <= 2
    assert has.all()
    model = langid.fit(texts, langs, landmarks=6)
    unit = seen / np.sqrt(seen.sum(1, keepdims=True))
    kernel = unit @ unit.T
    target = np.array([[x == n for n in ("de", "en", "fr")] for x in langs], float)
    weight = np.full((6, 1), 0.5)
    alpha = np.linalg.solve(kernel.T @ (kernel * weight) + langid.RIDGE * kernel + 1e-9 * np.eye(6), kernel.T @ (target * weight))
    assert np.allclose(model.scores(seen), kernel @ alpha, atol=1e-3)
    assert [model.langs[k] for k in model.scores(langid.presence(pa.array(["the house", "la table", "das ist der"]))[0]).argmax(1)] == ["en", "fr", "de"]


def test_what_counts_as_a_letter():
    texts = ["²", "½ 12", "① ②", "١٢٣", "_-", "", None, "ª", "中", "Ω", "é", "×", "ʰ", "x"]
    assert langid.presence(pa.array(texts, pa.string()))[1].tolist() == [False] * 7 + [True, True, True, True, False, True, True]


def test_many_short_texts_take_little_memory(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "'abcde' as text", "1.0 as score")
    assert langid.predict(rows, None).count() == 20000


def test_page_text():
    learned = htmltext.weights()
    for page in htmltext.LABELLED:
        assert htmltext.main_text(without_signs(page), learned) == article_of(page)
    assert htmltext.main_text("<article><p>a&nbsp;&amp; b<br>c</p><div class='comments'><p>nice one</p></div></article>", learned) == "a & b c"
    assert htmltext.main_text("", learned) == "" and htmltext.main_text("<p", learned) == ""


def test_pages_that_were_not_learned_from():
    shares = []
    for k, page in enumerate(htmltext.LABELLED):
        rest = htmltext.LABELLED[:k] + htmltext.LABELLED[k + 1 :]
        got, want = htmltext.main_text(without_signs(page), htmltext.weights(rest)).split(), article_of(page).split()
        both = sum((Counter(got) & Counter(want)).values())
        shares.append(2 * both / (len(got) + len(want)))
    # most pages name their furniture in words that no other page has, so some of it stays with the article next to it
    assert min(shares) > 0.6 and np.mean(shares) > 0.8


def test_weights_of_names_are_counts_of_words():
    pages = ("<div class='a'>x y</div>[[<p class='b'>one two three</p>{{<p class='a c'>ad</p>}}<p class='c'>four</p>]]<b>z</b>",)
    names, score = htmltext.weights(pages)
    odds = lambda i, o: math.log(i + 0.5) - math.log(o + 0.5)
    want = {"<div>": odds(0, 2), "a": odds(0, 3), "<p>": odds(4, 1), "b": odds(3, 0), "c": odds(1, 1)}
    assert names.keys() == want.keys() and all(abs(names[k] - want[k]) < 1e-12 for k in want)
    score = htmltext.weights()[1]
    assert score["text"] > 0 > score["link"] > score["furniture"] and all(x < 0 for k, x in score.items() if k != "text")


def test_best_stretch_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(500):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        low, high = htmltext.best_stretch(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[low:high]) == max([0, *every]) and (low < high) == any(x > 0 for x in scores)


def test_long_and_empty_pages(spark):
    long = "<div class='menu'>" + "<a>x</a>" * 20000 + "</div><article>" + "<p>some words of it</p>" * 20000 + "</article>"
    rows = spark.createDataFrame([(1, "u", long, 1), (2, "u", "", 2), (3, "u", "<div>" * 30000 + "deep", 3)], "page_id long, url string, html string, text long")
    out = {r["page_id"]: r for r in htmltext.extract(rows).collect()}
    assert out[1]["text"] == " ".join(["some words of it"] * 20000) and out[2]["n_chars"] == 0 and out[3]["text"] == "deep"
    assert htmltext.extract(rows.where("false")).count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", None, 1), (2, None, "<p>hello there", 2), (2, None, "<p>hello there", 2)], "page_id long, url string, html string, text long")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(rows).collect()) == [(1, "", 0), (2, "hello there", 11), (2, "hello there", 11)]


def test_repeated_rows_and_long_texts(spark):
    long = "licensed under the mit license to a.b@c.org. " * 20000
    texts = ["the words of a text", "the words of a text", long, None, ""]
    rows = frame(spark, texts).withColumn("doc_id", F.col("doc_id") % 3)
    model = langid.fit(["the words of it", "die worte davon"], ["en", "de"])
    for f in (lambda d: bpe_trie.digests(d, VOCABULARY), lambda d: licenses.digest(licenses.scan(d)), lambda d: langid.predict(d, model), lambda d: pii.digest(pii.spans(d))):
        assert sorted(r["doc_id"] for r in f(rows).collect()) == [0, 0, 1, 1, 2]
    found = {r["n_words"]: r for r in licenses.digest(licenses.scan(rows)).collect()}[10 * 20000]
    assert (found["n_base"], found["first_word"], found["last_word"], found["labels"]) == (20000, 3, 10 * 19999 + 3, "mit")
    assert {r["n_email"] for r in pii.digest(pii.spans(rows)).collect()} == {0, 20000}


def test_empty_tables(spark):
    none = frame(spark, ["x"]).where("false")
    for f in (lambda d: bpe_trie.digests(d, VOCABULARY), pii.spans, licenses.scan, lambda d: langid.predict(d, langid.train(d))):
        assert f(none).count() == 0
