import numpy as np

from driftloom.llm.langid import Model, codewords, fit, has_letter, predicted


def test_codewords_differ_and_divide():
    for n in (1, 2, 4, 9, 60):
        words = codewords(n)
        assert len({tuple(w) for w in words}) == n
        assert n == 1 or (words.any(0) & ~words.all(0)).all()
    four = codewords(4)
    assert min((four[i] != four[j]).sum() for i in range(4) for j in range(i)) >= 8


def test_bits_may_fail():
    """Decoding takes the nearest codeword although several bits are wrong."""
    words = codewords(4)
    for i in range(4):
        margin = np.where(words[i], 3.0, -3.0)
        margin[:3] *= -1
        model = Model(list("abcd"), words, np.zeros((words.shape[1], 1 << 14)), margin, np.ones(words.shape[1]))
        assert model.predict(b"x")[0] == "abcd"[i]


def test_learns_languages(spark):
    draw = np.random.default_rng(4)
    bits = {"en": "th ing and er".split(), "de": "sch ung ein ß".split(), "es": "ción que los ñ".split()}
    rows = [(i, "".join(bits[k][j] + (" " if j % 2 else "") for j in draw.integers(0, 4, 30)), k) for i in range(240) for k in bits]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = fit(docs.where("doc_id % 4 <> 2"))
    held = docs.where("doc_id % 4 = 2").collect()
    assert np.mean([model.predict(r.text.encode())[0] == r.lang for r in held]) > 0.98
    other = fit(docs.where("doc_id % 4 <> 2").coalesce(1))
    assert np.allclose(model.weights, other.weights)


def test_ambiguous_texts_are_flagged():
    words = codewords(2)
    model = Model(["a", "b"], words, np.zeros((words.shape[1], 1 << 14)), np.zeros(words.shape[1]), np.ones(words.shape[1]))
    assert model.predict(b"x")[2] is True


def test_awkward_rows(docs, no_docs):
    model = fit(docs)
    found = predicted(docs, model).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    for i in (3, 4, 5):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[6].lang_pred == "de" and {r.lang_pred for r in found} <= {"en", "de", "fr", "und"} and all(0 <= r.score <= 1 for r in found)
    assert predicted(no_docs, model).count() == 0
    assert {r.lang_pred for r in predicted(docs, fit(no_docs)).collect()} == {"und"}


def test_letters():
    assert has_letter(b"1a") and has_letter("你".encode()) and not has_letter(b"12 .!") and not has_letter("€ 😀".encode()) and not has_letter(b"")
