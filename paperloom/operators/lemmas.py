"""Lemmas learned from a term table: suffix paradigms chosen by description length, and the dictionary they give.

Terms of one language are cut into stem and ending. Two endings that stems share are a rule, from the longer one (the greater one
among equals) to the other, so that rules can't run in circles. A rule gains what pointing from a term to its base saves over spelling
the stem again, less what writing the rule down costs; it holds if it gains, if enough stems show it, and if they show it at
least as often as chance would. A term takes the rule of greatest gain whose base is a term too, and its lemma is the end of that chain.

Only the ``ENDINGS`` endings that spell the most letters are looked at in a language, which bounds the pairs of a stem. A term of no rule is its
own lemma and isn't in the dictionary. Nulls and terms shorter than a stem are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.session import kept

#: Letters of the shortest stem and of the longest ending, endings a language, bits a letter, stems that show a rule at least.
STEM, LONGEST, ENDINGS, LETTER, LEAST = 3, 4, 60, 5, 3
#: Entries that a model's own dictionary has at most, the most frequent terms first.
MODEL_ENTRIES = 262_144


def term_table(docs: DataFrame, words_col: str = "words", lang_col: str | None = None) -> DataFrame:
    """(lang, term, n): how often each language has a term; without ``lang_col`` all is one language."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    rows = docs.select(lang.alias("lang"), F.explode(words_col).alias("term"))
    return rows.where("term is not null").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))


def splits(terms: DataFrame) -> DataFrame:
    """(lang, term, stem, ending) of the endings that are looked at."""
    n = F.length("term")
    cuts = F.sequence(F.lit(0), F.least(F.lit(LONGEST), n - STEM))
    rows = terms.where(n >= STEM).select("lang", "term", F.explode(cuts).alias("k"))
    rows = rows.select("lang", "term", F.substring("term", F.lit(1), F.length("term") - F.col("k")).alias("stem"), F.right("term", F.col("k")).alias("ending"))
    spelt = rows.groupBy("lang", "ending").agg((F.count(F.lit(1)) * (1 + F.length("ending"))).alias("letters"))
    order = Window.partitionBy("lang").orderBy(F.desc("letters"), "ending")
    looked_at = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ENDINGS).select("lang", "ending")
    return rows.join(F.broadcast(looked_at), ["lang", "ending"])


def rules(terms: DataFrame, cut: DataFrame) -> DataFrame:
    """(lang, ending, base, stems, gain) of the rules that hold."""
    bits = terms.groupBy("lang").agg(F.ceil(F.log2(F.count(F.lit(1)))).alias("bits"))
    stems = cut.groupBy("lang").agg(F.count_distinct("stem").alias("all"))
    shown = cut.groupBy("lang", "ending").agg(F.count(F.lit(1)).alias("shown"))
    own = cut.select("lang", "stem", "ending")
    pairs = own.join(own.toDF("lang", "stem", "base"), ["lang", "stem"])
    longer = (F.length("ending") > F.length("base")) | ((F.length("ending") == F.length("base")) & (F.col("ending") > F.col("base")))
    pairs = pairs.where(longer & ((F.col("base") == "") | (F.left("ending", F.lit(1)) != F.left("base", F.lit(1)))))
    found = pairs.groupBy("lang", "ending", "base").agg(F.count(F.lit(1)).alias("stems"), F.sum(F.length("stem")).alias("letters")).join(bits, "lang")  # few rows by now
    found = found.withColumn("gain", LETTER * F.col("letters") - F.col("stems") * F.col("bits") - LETTER * (F.length("ending") + F.length("base") + 2))
    found = found.join(shown, ["lang", "ending"]).join(shown.select("lang", F.col("ending").alias("base"), F.col("shown").alias("base_shown")), ["lang", "base"]).join(stems, "lang")
    often = F.col("stems") * F.col("all") >= F.col("shown") * F.col("base_shown")
    return found.where((F.col("gain") > 0) & (F.col("stems") >= LEAST) & often).select("lang", "ending", "base", "stems", "gain")


def learn(terms: DataFrame) -> DataFrame:
    """(lang, term, lemma, n), written: the dictionary of (lang, term, n), which is written first unless it is so already."""
    terms = terms if hasattr(terms, "written_to") else kept(terms)
    cut = kept(splits(terms))
    bases = cut.join(F.broadcast(rules(terms, cut)), ["lang", "ending"]).select("lang", "term", F.concat("stem", "base").alias("lemma"), "gain", "base")
    bases = bases.join(terms.select("lang", F.col("term").alias("lemma")), ["lang", "lemma"])
    order = Window.partitionBy("lang", "term").orderBy(F.desc("gain"), "base")
    now = kept(bases.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("lang", "term", "lemma"))
    while True:  # chains by doubling
        ends = now.toDF("lang", "lemma", "further")
        moved = kept(now.join(ends, ["lang", "lemma"], "left").select("lang", "term", F.coalesce("further", "lemma").alias("lemma"), F.col("further").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return kept(now.join(terms, ["lang", "term"]))


def applied(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``terms`` (lang, term, ...) with ``lemma``."""
    return terms.join(dictionary.select("lang", "term", "lemma"), ["lang", "term"], "left").withColumn("lemma", F.coalesce("lemma", "term"))


class Dictionary:
    """A dictionary as a function of words: what a model takes along from training to search."""

    def __init__(self, entries: dict[str, str]):
        self.entries = entries

    def __call__(self, word: str) -> str:
        return self.entries.get(word, word)

    @staticmethod
    def of(dictionary: DataFrame, entries: int = MODEL_ENTRIES) -> Dictionary:
        """The most frequent ``entries`` of (lang, term, lemma, n); of several languages the one that has a term most counts."""
        order = Window.partitionBy("term").orderBy(F.desc("n"), "lang")
        first = dictionary.withColumn("rank", F.row_number().over(order)).where("rank = 1").orderBy(F.desc("n"), "term").limit(entries)
        return Dictionary({r["term"]: r["lemma"] for r in first.select("term", "lemma").collect()})

    def save(self, path: str) -> None:
        rows = sorted(self.entries.items())
        SparkSession.active().createDataFrame(rows, "term string, lemma string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dictionary:
        return Dictionary({r["term"]: r["lemma"] for r in spark.read.parquet(path).collect()})
