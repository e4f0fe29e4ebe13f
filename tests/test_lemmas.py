"""Learned lemmas on hand-made lists of four languages, and in a model."""

from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import lemmas
from paperloom.plans import catalogue, jobs
from paperloom.operators.topics import TopicPipeline

ENGLISH = "walk talk jump paint clean cook play order answer visit open listen gather cover water"
ENGLISH_Y = "study carry worry hurry marry bury"
GERMAN = "spiel lern koch frag sag mach kauf brauch wohn hör"
SPANISH = "habl cant camin trabaj estudi mir cocin compr bail escuch"
FRENCH = "parl chant march travaill montr port regard cherch trouv donn"


def families():
    """(lang, lemma, form)."""
    out = [("en", w, w + e) for w in ENGLISH.split() for e in ("", "s", "ed", "ing")]
    out += [("en", w, w[:-1] + e) for w in ENGLISH_Y.split() for e in ("y", "ies", "ied")]
    out += [("de", w + "e", w + e) for w in GERMAN.split() for e in ("e", "en", "st", "t", "te")]
    out += [("es", w + "a", w + e) for w in SPANISH.split() for e in ("a", "ar", "an", "as", "ado", "ando")]
    out += [("fr", w + "e", w + e) for w in FRENCH.split() for e in ("e", "er", "ons", "ent", "ait")]
    odd = {"en": "table window mother string bring this glass", "de": "kind tisch himmel", "es": "perro gato libro", "fr": "maison jardin livre"}
    return out + [(lang, w, w) for lang, ws in odd.items() for w in ws.split()]


def test_learned_lemmas_beat_the_rules(spark):
    rows = families()
    docs = spark.createDataFrame([(lang, [form]) for lang, _, form in rows] + [("en", ["to", None]), (None, ["walks"]), ("en", None)], "lang string, words array<string>")
    terms = lemmas.term_table(docs, lang_col="lang")
    dictionary = lemmas.learn(terms).cache()
    named = {(r["lang"], r["term"]): r["lemma"] for r in lemmas.applied(terms, dictionary).collect()}
    ruled = {r["w"]: r["l"] for r in spark.createDataFrame([(f,) for _, _, f in rows], "w string").select("w", F.element_at(text.lemmatize(F.array("w"), "rules"), 1).alias("l")).collect()}
    score = lambda lang, of: sum(of(lang_, form) == lemma for lang_, lemma, form in rows if lang_ == lang) / sum(r[0] == lang for r in rows)
    for lang in ("en", "de", "es", "fr"):
        mine, theirs = score(lang, lambda a, f: named[a, f]), score(lang, lambda a, f: ruled[f])
        assert mine >= 0.9 and mine >= theirs, (lang, mine, theirs)
    assert sum(named[a, f] == w for a, w, f in rows) > sum(ruled[f] == w for _, w, f in rows)
    assert named["", "walks"] == "walks" and named["en", "to"] == "to"
    assert all(named.get((r["lang"], r["lemma"])) == r["lemma"] for r in dictionary.collect())  # a lemma is its own
    assert lemmas.learn(terms.limit(0)).count() == 0


def test_models_keep_their_dictionary(spark, tmp_path):
    english = [(i, " ".join(f for lang, w, f in families() if lang == "en" and (hash_ := sum(map(ord, w))) % 3 == i % 3)) for i in range(12)]
    docs = spark.createDataFrame(english, "_id long, text string")
    path = str(tmp_path / "model")
    jobs.train(docs, path, (2,), id_col="_id", iterations=3, lemmas="learned")
    loaded = TopicPipeline.load(spark, path)
    assert {"walk", "jump", "paint"} <= set(loaded.counter.vocabulary) and "walking" not in loaded.counter.vocabulary
    asked = spark.createDataFrame([(1, "walking walked WALKS"), (2, "walk walk walk")], "_id long, text string")
    (a, b) = [r["words"] for r in loaded.words(asked).orderBy("_id").collect()]
    assert a == b == ["walk"] * 3


def test_documents_are_read_once_for_the_terms(spark, tmp_path):
    texts = [(lang, form) for lang, _, form in families()] + [(None, "walks"), ("en", None)]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.learned_lemmas(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if "documents.parquet" in f]
    named = {(r["lang"], r["term"]): (r["lemma"], r["n"]) for r in found.collect()}
    assert named["en", "walking"] == ("walk", 1) and named["", "walks"] == ("walks", 1)
