"""Tokens, stop words, lemmas and text pieces as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of Spark ML, and those of the publication domain.
ENGLISH = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more
    most other some such no nor not only own same so than too very s t can will just don should now i'll
    you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
""".split()
DOMAIN = ["abstract", "keyword", "introduction", "conclusion", "acknowledgement", "cid"]

#: Suffix rewrites of the rule lemmatiser, tried in order on words of more than four letters.
SUFFIXES = [("sses$", "ss"), ("ies$", "y"), ("([^aeiou])ing$", "$1"), ("([^aeiou])ed$", "$1"), ("([^su])s$", "$1")]


def regex_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 1)


def letter_tokens(text: Column, longer_than: int = 2) -> Column:
    """Runs of letters of any script with more than ``longer_than`` of them, then lower-cased."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}]+"), lambda w: F.length(w) > longer_than)
    return F.transform(words, F.lower)


def is_only_letters(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def without_stop_words(words: Column, stop: list[str] = ENGLISH) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*stop))


def without_domain_words(words: Column, stop: list[str] = DOMAIN) -> Column:
    """Words of more than one letter that aren't on the domain's list."""
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def lemmatize(words: Column, mode: str | Callable[[str], str] = "none") -> Column:
    """``none``: as they are; ``rules``: suffix rewrites; a function: applied word by word, in Arrow batches.

    The rules don't give the lemmas of a statistical lemmatiser; pass one as a function to have them. Training and
    search take either, and search needs the one that its model was trained with.
    """
    if callable(mode):

        @F.pandas_udf("array<string>")
        def by_function(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda ws: None if ws is None else [mode(w) for w in ws])

        return by_function(words)
    if mode == "none":
        return words
    if mode != "rules":
        raise ValueError(f"unknown lemmatiser {mode!r}")

    def rewritten(word: Column) -> Column:
        out = word
        for pattern, to in reversed(SUFFIXES):
            out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, to)).otherwise(out)
        return F.when(F.length(word) > 4, out).otherwise(word)

    return F.transform(words, rewritten)


def clean_tokens(text: Column, mode: str = "regex", lemmas: str | Callable[[str], str] = "none") -> Column:
    """Tokens without English and domain stop words: the text side of training and of search alike."""
    if mode == "regex" and lemmas == "none":  # tokens are in lower case already, so one look at each word does
        words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
        return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*ENGLISH, *DOMAIN))
    words = regex_tokens(text) if mode == "regex" else letter_tokens(text)
    return without_domain_words(without_stop_words(lemmatize(words, lemmas)))


def document_key(title: Column) -> Column:
    """The SHA-256 of the title as a number, modulo 10**8."""
    digest, key = F.sha2(title.cast("binary"), 256), F.lit(0).cast("bigint")
    for i in range(0, 64, 8):  # eight digits at a time
        part = F.conv(F.substring(digest, i + 1, 8), 16, 10).cast("bigint")
        key = (key * F.lit(4294967296 % 100_000_000) + part) % 100_000_000
    return key


def between_markers(text: Column, start: str = "abstract", stop: str = "[abs]") -> Column:
    """What stands between two markers, found in any case, on one line; null if one is missing."""
    low = F.lower(text)
    a, b = F.locate(start, low), F.instr(low, stop)
    inside = F.substr(text, a + len(start), F.greatest(b - a - len(start), F.lit(0)))
    return F.when((a > 0) & (b > 0), F.trim(F.replace(inside, F.lit("\n"), F.lit(" "))))


def sections(text: Column, names: tuple[str, ...] = ("abstract", "keywords", "1. introduction")) -> Column:
    """A struct of the text from each name to the next one; null for a name that is missing."""
    low = F.lower(text)
    at = [F.locate(n, low) for n in names]
    out = []
    for i, name in enumerate(names):
        end = F.least(*[F.when(p > at[i], p) for p in at if p is not at[i]], F.length(text) + 1)
        out.append(F.when(at[i] > 0, F.substr(text, at[i], end - at[i])).alias(name.split()[-1]))
    return F.struct(*out)


# The kinds of layout objects that carry text.
TEXT_OBJECTS = ["LTTextBox", "LTTextLine", "LTText"]


def text_of_layout(objects: Column, kinds: list[str] = TEXT_OBJECTS) -> Column:
    """The joined texts of a page's layout objects (structs of kind and text) that are of a text kind."""
    return joined_boxes(F.transform(F.filter(objects, lambda o: o["kind"].isin(*kinds)), lambda o: o["text"]))


def joined_boxes(boxes: Column) -> Column:
    """The text boxes of a laid-out page, each on a new line, with one pass over double line ends."""
    flat = F.aggregate(boxes, F.lit(""), lambda a, b: F.concat(a, F.lit("\n"), b))
    return F.replace(flat, F.lit("\n\n"), F.lit("\n"))
