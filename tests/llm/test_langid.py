import random
import zlib

import numpy as np

from readsieve.llm import langid
from tests.llm.fixtures import TEXTS, documents, rows_of

ALPHABETS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqéèç", "dd": "漢字仮名文"}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(ALPHABETS))
        letters = ALPHABETS[lang] + "xyz"
        words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang, f"src{i % 3}"))
    return rows


def slow_counts(text):
    codes, last = [32], " "
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1] != 32:
            codes.append(32)
    counts = np.zeros(langid.BUCKETS, int)
    mask = (1 << 32) - 1
    factor = 0x9E3779B1
    for order in (1, 2, 3):
        for end in range(1, len(codes)):
            if end - order + 1 < 0:
                continue
            h = order
            for c in codes[end - order + 1 : end + 1]:
                h = (h ^ c) * factor & mask
            h ^= h >> 15
            counts[(h * factor & mask) >> (32 - langid.BITS)] += 1
    return counts


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ein  Text, mit Wörtern.\n\nUnd 漢字 -- 12 more"
    expected = slow_counts(text)
    for block in (1, 2, 3, 7, 1 << 19):
        monkeypatch.setattr(langid, "BLOCK_CHARS", block)
        at, counts = langid.ngram_counts(text)
        found = np.zeros(langid.BUCKETS, int)
        found[at] = counts
        assert (found == expected).all()


def test_texts_without_letters():
    for text in (None, "", "  \n", "12 + 34 = 46 !?", "½²"):
        assert langid.ngram_counts(text) is None


def test_held_out_accuracy(spark):
    docs = documents(spark, corpus(600))
    model = langid.train(docs)
    assert model.languages == sorted(ALPHABETS)
    assert (model.weights == 0).mean() > 0.5  # sparse
    found = langid.predict(docs, model).collect()
    truth = {i: lang for i, _, lang, _ in corpus(600)}
    out = [r for r in found if r["held_out"]]
    assert len(found) == 600 and 100 < len(out) < 300
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(300)
    changed = [
        (i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows
    ]
    a, b = langid.train(documents(spark, rows)), langid.train(documents(spark, changed))
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_source_and_order_are_no_inputs(spark):
    rows = corpus(200)
    model = langid.train(documents(spark, rows))
    other = langid.train(documents(spark, [(i, t, lang, None) for i, t, lang, _ in rows]).repartition(5))
    assert np.allclose(model.weights, other.weights)


def test_repeated_doc_ids_are_learnt_once(spark, monkeypatch):
    taught = []

    def note(model, rows, answers):
        taught.extend((int(a), at.tobytes(), n.tobytes()) for (at, n), a in zip(rows, answers))

    monkeypatch.setattr(langid, "fit_ftrl", note)
    monkeypatch.setattr(langid, "fit_temperature", note)
    rows = corpus(600)
    langid.train(documents(spark, rows), sample=100)
    once, taught[:] = sorted(taught), []
    hot = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1][0]
    longer = [(i, t + " zzzz", lang, s) for i, t, lang, s in rows]
    langid.train(documents(spark, rows * 3 + longer + [hot] * 500).repartition(5), sample=100)
    assert sorted(taught) == once and len(once) == 4 * langid.LEAST_PER_LANG


def test_documents_are_all_counted(spark):
    docs = documents(spark, corpus(150)).repartition(4)
    n, df = langid.document_frequencies(docs)
    assert n == 150
    assert (df == sum((slow_counts(t) > 0).astype(int) for _, t, _, _ in corpus(150))).all()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["a", "b"], np.ones(langid.BUCKETS), np.zeros((langid.BUCKETS, 2)), np.zeros(2))
    model.weights[:2] = [[40.0, 0], [0, 40.0]]  # far too sure
    rows = [(np.array([int(x)]), np.array([1])) for x in rng.integers(0, 2, 400)]
    answers = np.array([r[0][0] if rng.random() < 0.8 else 1 - r[0][0] for r in rows])
    langid.fit_temperature(model, rows, answers)
    p = langid.softmax(model.scores(*rows[0]) / model.temperature).max()
    assert abs(p - 0.8) < 0.06


def test_odd_rows(spark):
    docs = documents(spark)
    model = langid.train(docs)
    found = langid.predict(docs, model)
    assert found.count() == len(TEXTS)
    by_id = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    for i in (3, 4, 5, 12):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[1]["lang_pred"] in ("en", "fr")
    assert [r["held_out"] for r in found.where("doc_id is null").collect()] == [False, False]
    none = documents(spark, [])
    empty = langid.train(none)
    assert langid.predict(none, empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert rows_of(langid.predict(docs, model)) == rows_of(found)
