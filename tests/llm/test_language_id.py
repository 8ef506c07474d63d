import zlib

import numpy as np
import pytest

from shredline.llm import language_id as I


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = I.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [g for g in got if g.held_out]
    assert held and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    assert sum(g.lang_pred == g.lang for g in held) >= 0.95 * len(held)
    assert all(0 <= g.score <= 1 for g in got)


def brute(model, text):
    words = I.words_of(text)
    if not words or not model.langs:
        return "und"
    total = np.zeros(len(model.langs))
    for w in words:
        if w in model.tables[0]:
            total += model.logs[0][model.tables[0][w]]
            continue
        for n in range(I.LONGEST, 0, -1):
            own = [g for g in I.grams(w, n) if g in model.tables[n]]
            if own:
                total += sum(model.logs[n][model.tables[n][g]] for g in own) / len(own)
                break
    return model.langs[int(np.argmax(total))], total


def rows_of(spark):
    rows = [(i, "the cat and the dog sat there", "en") for i in range(20)] + [(40 + i, "der hund und die katze", "de") for i in range(20)]
    rows += [(80, None, "en"), (81, "", "de"), (82, "12 --", "en"), (83, "katzen", None), (84, "日本", None), (85, "dogs " * 9000, "en"),
             (None, "der die", "de"), (86, "catty hunden", None), (86, "catty hunden", None)]
    return rows, spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, source string")


def test_prediction_equals_brute_force(spark):
    rows, docs = rows_of(spark)
    model = I.fit(docs)
    got = sorted(I.predict(docs, model, keep=5).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for g in got:
        want = brute(model, text[g.doc_id])
        if want == "und":
            assert (g.lang_pred, g.score) == ("und", 0.0)
        else:
            lang, total = want
            assert g.lang_pred == lang or total[model.langs.index(g.lang_pred)] == pytest.approx(total.max())
            assert g.score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in I.identify(docs).collect()} == {("und", 0.0)}
    assert I.identify(docs.limit(0)).count() == 0


def test_backs_off_to_shorter_grams():
    model = I.BackoffModel(["a", "b"], [("a", 0, "xyz", 5), ("b", 0, "uvw", 5), ("a", 4, " xyz", 5), ("b", 2, "uv", 5), ("a", 1, "x", 9)])
    assert model.word("xyz")[0] > model.word("xyz")[1]
    assert model.word("xyzz").tolist() == model.logs[4][0].tolist()
    assert model.word("quvq").tolist() == model.logs[2][0].tolist()
    assert model.word("qx").tolist() == model.logs[1][0].tolist()
    assert model.word("q").tolist() == [0.0, 0.0]


def test_numerals_are_no_letters(spark):
    rows, docs = rows_of(spark)
    odd = [(1, "½ ² 12"), (2, "Ⅷ"), (3, "_ ፩"), (4, "½hund² katze"), (5, "日本")]
    got = {r.doc_id: r for r in I.predict(spark.createDataFrame(odd, "doc_id long, text string"), I.fit(docs)).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4].lang_pred == "de" and got[5].lang_pred != "und"
    assert I.words_of("½hund² katze Ⅷ") == ["hund", "katze"]


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, "the cat and the dog sat there", "en") for i in range(30)]
    rows += [(100 + i, "le chat est une bete rouge " * 4000, "fr") for i in range(3)]
    docs = spark.createDataFrame([*rows, (900, "chat rouge", None), (901, "le chat", "fr"), (901, "le chat", "fr")],
                                 "doc_id long, text string, lang string")
    model = I.fit(docs)
    assert model.langs == ["en", "fr"] and model.best(sum(model.word(w) for w in ("chat", "rouge")))[0] == "fr"
    few = I.fit(docs.where("doc_id < 900"), train_rows=2, train_bytes=1)       # one document each, whole
    assert few.langs == ["en", "fr"] and few.prior.tolist() == [2.0, 24000.0]     # words seen twice
    once = I.fit(spark.createDataFrame([(901, "le chat", "fr")] * 50, "doc_id long, text string, lang string"))
    assert once.prior.tolist() == [0.0] or once.prior.tolist() == []           # equal rows count once: nothing was seen twice
