"""Operators on single texts: language, encoding, abuse, mixing."""

import random

import numpy as np
import pytest

from corpusloom.llm import abuse, encoding_repair, language_id, mixing
from tests.conftest import rows

PHRASES = {
    "en": "the house is near the river and we will walk there with the children in the morning because it is warm",
    "de": "das haus liegt am fluss und wir gehen morgen mit den kindern dorthin weil es warm ist und nicht regnet",
    "fr": "la maison est près de la rivière et nous irons demain avec les enfants parce que le temps est très beau",
    "es": "la casa está cerca del río y mañana iremos allí con los niños porque hace calor y no llueve nunca aquí",
    "pt": "a casa fica perto do rio e amanhã vamos lá com as crianças porque está calor e não chove nunca aqui",
    "tr": "ev nehrin yanında ve yarın sabah çocuklarla oraya gideceğiz çünkü hava çok sıcak ve yağmur yağmıyor",
    "ru": "дом стоит у реки и завтра утром мы пойдём туда с детьми потому что там тепло и совсем нет дождя",
    "hi": "घर नदी के पास है और कल सुबह हम बच्चों के साथ वहाँ जाएंगे क्योंकि वहाँ गर्मी है और बारिश नहीं होती",
}


def sentence(r, lang, n=9):
    w = PHRASES[lang].split()
    return " ".join(r.choice(w) for _ in range(n)).capitalize() + "."


def label(lang):
    return "text" if lang == "en" else f"text_{lang}"


def messages(spark, n=25):
    r = random.Random(4)
    data = [(k * 10 + j, label(lang), " ".join(sentence(r, lang) for _ in range(3))) for k in range(n) for j, lang in enumerate(PHRASES)]
    data += [(9000, None, sentence(r, "de")), (9001, " TEXT_FR ", sentence(r, "fr")), (9002, "text_es", sentence(r, "es") + " " + sentence(r, "ru")), (9003, "text", sentence(r, "en") + " Hola amigo!"), (9004, "unknown", None), (9005, "text", ""), (9006, "text_de", sentence(r, "tr", 4000))]
    return spark.createDataFrame([(*d, "clash", 0) for d in data], "row_index bigint, language_column string, raw_text string, lang string, k int")


def test_languages(spark):
    df = messages(spark)
    m = language_id.learn(df)
    assert rows(language_id.foreign_languages(df, m)) == [(9000, "de"), (9002, "ru"), (9006, "tr")]
    docs = {r[0]: r for r in rows(language_id.documents(df, m))}
    assert docs[9004][1:] == ("und", 0.0, 0) and docs[9005][1:] == ("und", 0.0, 0) and docs[9002][3] == 2
    right = [docs[k * 10 + j][1] == lang for k in range(25) for j, lang in enumerate(PHRASES)]
    assert np.mean(right) > 0.98 and all(0 <= d[2] <= 1 for d in docs.values())
    assert language_id.segments(df.limit(0), m).count() == 0


def test_language_models_are_distributions():
    m = language_id.fit([["ab ab ba "], ["bb bb aab "]], 3)
    for k in range(3):
        for j in range(2):
            by_context = {}
            for key, p in zip(m.keys[k] >> np.uint64(language_id.BITS), np.exp(m.logp[k][:, j])):
                by_context[int(key)] = by_context.get(int(key), 0) + p
            assert all(x <= 1 + 1e-5 for x in by_context.values())
    assert language_id.train([]) is not None


def test_noise_in_labels_is_dropped():
    r = random.Random(6)
    data = [(lang, sentence(r, lang)) for _ in range(60) for lang in PHRASES] + [("en", sentence(r, "fr")) for _ in range(6)]
    m = language_id.train(data)
    lang, _ = language_id.classify(m, [t for t, _ in language_id.sentences(sentence(r, "fr"))])
    assert language_id.LANGUAGES[lang[0]] == "fr"


def garbled_table(spark):
    r = random.Random(8)
    clean = [sentence(r, lang, 12) for _ in range(60) for lang in ("fr", "tr", "ru", "de")]
    data, want = [], set()
    for k, t in enumerate(clean):
        lang = ("fr", "tr", "ru", "de")[k % 4]
        if k % 6 == 0 and any(ord(c) > 127 for c in t):
            t = t.encode("utf-8").decode("latin-1" if lang != "tr" else "cp437")
            want.add(k)
        data.append((k, lang, t))
    n = len(data)
    data += [(n, "fr", "caf� noir"), (n + 1, "fr", None), (n + 2, "fr", "plain"), (n + 3, "fr", ""), (n + 4, "fr", "ÉCOLE À NICE"), (n + 5, None, "été " * 20_000)]
    want.add(n)
    return spark.createDataFrame([(*d, "clash") for d in data], "record_id bigint, dataset string, raw_text string, restored_text string"), spark.createDataFrame(list(enumerate(clean)), "key int, text string"), want, clean


def test_garbled_records(spark):
    df, clean, want, original = garbled_table(spark)
    m = encoding_repair.fit(df, clean)
    got = {r[0]: r[1] for r in encoding_repair.garbled(df, m).collect()}
    assert set(got) == want
    back = [got[k] == original[k] for k in want if k < len(original)]
    assert np.mean(back) > 0.9
    empty = df.limit(0)
    assert encoding_repair.garbled(empty, encoding_repair.fit(empty, clean.limit(0))).count() == 0


def test_a_page_of_no_library_is_learnt_and_restored(spark):
    r = random.Random(21)
    clean = [sentence(r, lang, 12) for _ in range(200) for lang in ("tr", "fr")]
    letters = sorted({c for t in clean for c in t if ord(c) > 127})
    signs = [chr(0x2200 + k) for k in range(len(letters))]
    r.shuffle(signs)
    page = str.maketrans(dict(zip(letters, signs)))
    data = [(k, ("tr", "fr")[k % 2], t.translate(page) if k % 3 == 0 else t) for k, t in enumerate(clean)]
    df = spark.createDataFrame(data, "record_id bigint, dataset string, raw_text string")
    m = encoding_repair.fit(df, spark.createDataFrame([(t,) for t in clean], "text string"))
    got = {x[0]: x[1] for x in encoding_repair.garbled(df, m).collect()}
    want = {k for k, _, t in data if any(c in signs for c in t)}
    assert set(got) == want
    assert np.mean([got[k] == clean[k] for k in want]) > 0.9


def test_texts_garbled_many_times_come_back(spark):
    r = random.Random(22)
    clean = [sentence(r, "fr", 12) for _ in range(80)]
    data = [(k, "fr", t) for k, t in enumerate(clean)] + [(100 + n, "fr", "la rivi\u00e8re est tr\u00e8s belle") for n in range(6)]
    for n in range(6):
        t = data[80 + n][2]
        for _ in range(n):
            t = t.encode("utf-8").decode("latin-1")
        data[80 + n] = (100 + n, "fr", t)
    df = spark.createDataFrame(data, "record_id bigint, dataset string, raw_text string")
    got = {x[0]: x[1] for x in encoding_repair.garbled(df, encoding_repair.fit(df, spark.createDataFrame([(t,) for t in clean], "text string"))).collect()}
    assert got == {100 + n: "la rivi\u00e8re est tr\u00e8s belle" for n in range(1, 6)}


def test_round_trip_of_every_swap():
    for name, page, true in encoding_repair.SWAPS:
        for text in ("öçşğı", "привет", "é€"):
            try:
                bad = text.encode(true).decode(page)
            except UnicodeError:
                continue
            if bad != text:
                assert encoding_repair.decipher(bad, (name, page, true)) == text


def documents(spark, n=400):
    r = random.Random(12)
    fine = ["the meeting with {} is moved to monday", "please send the report to {}", "we watched the game with {} in town", "the price of the flat is too high says {}"]
    bad = ["you are a worthless idiot {} and everybody knows", "go away {} you disgusting liar"]
    name = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)).capitalize()
    data, truth, reviews = [], set(), []
    for k in range(n):
        parts = [r.choice(fine).format(name()) for _ in range(4)]
        if k % 8 == 0:
            truth.add(k)
            x = r.choice(bad).format(name())
            parts.insert(r.randint(0, 4), x.upper() if k % 3 == 0 else x.replace("idiot", "i d i o t").replace("liar", "li4r"))
        data.append((k, ". ".join(parts) + ".", "s1" if k % 3 else "s2"))
        if k < 160:
            reviews.append((k, int(k in truth)))
    data += [(n, None, "s1"), (n + 1, "", None), (n + 2, "the meeting " * 20_000, "s1")]
    return spark.createDataFrame([(*d, 0.5) for d in data], "doc_id bigint, text string, source string, score double"), spark.createDataFrame([*reviews, (0, None), (1, 0), (1, 1)], "doc_id bigint, abusive int"), truth


def test_abuse(spark):
    docs, reviews, truth = documents(spark)
    c = abuse.learn(docs, reviews)
    s = {r[0]: r[1] for r in abuse.scores(docs, c).collect()}
    found = {k for k, v in s.items() if v >= 0.5}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.05 * len(truth)
    assert s[400] < 0.5 and s[401] < 0.5 and len(s) == 403
    rate = {r["source"]: r for r in abuse.rates(docs, c).collect()}
    assert rate["s1"]["n_documents"] + rate["s2"]["n_documents"] == 402 and rate[None]["n_flagged"] == 0
    assert abuse.learn(docs, reviews.limit(0)) is None
    assert {r[1] for r in abuse.scores(docs, None).collect()} == {0.0} and abuse.scores(docs.limit(0), c).count() == 0


def test_disguises_are_undone():
    assert abuse.words("you S H I T, i.d.i.o.t loooser 1d10t") == ["you", "^shit", "idiot", "loser", "idiot"]


def test_van_der_corput(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(6).orderBy("id").select(mixing.van_der_corput(F.col("id"))).collect()]
    assert got == [0.0, 0.5, 0.25, 0.75, 0.125, 0.625]


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 64)
    r = random.Random(3)
    data = [(k, " ".join(["word"] * r.randint(5, 40)), ("big", "mid", "tiny", "stray")[min(k // 150, 3)] if k < 470 else "tiny") for k in range(480)]
    data += [(900, None, "big"), (901, "x y", None), (902, "", "big")]
    docs = spark.createDataFrame([(*d, 1) for d in data], "doc_id bigint, text string, source string, tokens int")
    weights = spark.createDataFrame([("big", 0.2, 1), ("mid", 0.3, 2), ("tiny", 0.4, 2), ("none", 0.1, 5), (None, 0.5, 1), ("bad", None, None)], "source string, target_share double, max_repeats int")
    rep = {x["source"]: x for x in mixing.report(docs, weights).collect()}
    assert set(rep) == {"big", "mid", "tiny", "none", "bad"} and rep["none"]["mixed_tokens"] == 0 and rep["bad"]["wanted"] == 0
    for s in ("big", "mid"):
        assert 0 <= rep[s]["mixed_tokens"] - rep[s]["wanted"] <= 60
    assert all(x["repeats"] <= (x["max_repeats"] or 0) for x in rep.values())
    assert abs(rep["big"]["reached_share"] - 0.2) < 0.02 and rep["none"]["short"] and abs(sum(x["mixture_share"] for x in rep.values()) - 1) < 1e-4
    mix = mixing.mixture(docs, weights).toPandas()
    assert (mix.groupby(["doc_id", "copy"]).size() == 1).all() and set(mix.source) <= {"big", "mid", "tiny"}
    blocks = mix.drop_duplicates(["source", "block"]).sort_values("slot")
    assert (blocks.groupby("source").block.apply(lambda b: list(b) == list(range(len(b))))).all()
    half = blocks.head(len(blocks) // 2).source.value_counts() / (len(blocks) // 2)
    whole = blocks.source.value_counts() / len(blocks)
    assert (half - whole).abs().max() < 0.1
    assert mixing.mixture(docs.limit(0), weights).count() == 0 and mixing.mixture(docs, weights.limit(0)).count() == 0


def test_every_query_builds(spark):
    from corpusloom.llm import queries

    assert {f"p{k}_found" for k in (1, 2, 3, 5, 6, 7, 8, 10)} <= set(queries.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())
