"""Language evidence: held-out accuracy, priors that decide short texts, and awkward rows."""

import random

from quire.llm import language_id

WORDS = {"en": "the river and stone with quiet bridge thing other", "de": "der fluss und stein mit ruhig brücke ding andere", "fr": "la rivière et pierre avec calme pont chose autre"}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_fusion(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(text(rng, x, 60), x) for x in WORDS for _ in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language_id.train_text_model(docs)
    assert model.languages == ["de", "en", "fr"]
    rows = []
    for k in range(90):
        lang = "de" if k % 3 else "fr"
        rows.append((k, f"https://www.site{k % 3}.example/{k}", f'<html lang="{lang}-XX"><script>the river and</script><p>{text(rng, lang, 40)}</p>', "x"))
    rows += [
        (100, "https://www.site1.example/short", "<p>12345</p>", "x"), (101, "https://www.site0.example/short", None, "x"), (102, None, '<html lang=fr>', "x"),
        (103, "https://new.example/", f"<html lang=de><p>{text(rng, 'en', 60)}</p>", "x"), (None, "%%", "", None), (None, "%%", "", None),
    ]
    got = language_id.page_languages(spark.createDataFrame(rows, "page_id long, url string, html string, lang string"), model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k].lang == by[k].text_lang == ("de" if k % 3 else "fr") for k in range(90))
    assert (by[100].text_lang, by[100].lang, by[101].lang, by[102].lang) == (None, "de", "fr", "fr")
    assert by[103].lang == "en" and by[103].declared == "de"
    assert all(0 < r.confidence <= 1 + 1e-9 for r in got)


def test_languages_beyond_the_bounds_are_other(spark):
    rng = random.Random(2)
    docs = [(text(rng, x, 60), x) for x, n in (("de", 20), ("en", 20), ("fr", 8)) for _ in range(n)] + [("αβγ δεζ ηθι κλμ νξο " * 20, "el")]
    model = language_id.train_text_model(spark.createDataFrame(docs, "text string, lang string"), max_languages=2)
    assert model.languages == ["de", "en", "other"]
    rows = [(k, f"https://s{k}.example/", f"<html lang={x}><p>{t}</p>") for k, (x, t) in enumerate([("fr", text(rng, "fr", 40)), ("el", "αβγ δεζ κλμ " * 10), ("en", text(rng, "en", 40)), ("de", text(rng, "de", 40))])]
    got = {r.page_id: r for r in language_id.page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert [got[k].lang for k in range(4)] == ["other", "other", "en", "de"] and got[0].declared == "other"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = language_id.train_text_model(spark.createDataFrame([], "text string, lang string"))
    assert language_id.page_languages(none, model).count() == 0
    one = language_id.page_languages(spark.createDataFrame([(1, "http://a.b/", "<p>x")], none.schema), model).collect()
    assert one[0].lang == "und"
