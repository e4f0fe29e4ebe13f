"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its lines that hold a word. Lines get ids in an order of their hashes, and
suffixes get ranks by their first 1, 2, 4, ... lines: a round pairs the rank of a suffix with that of the suffix a
prefix further on, and ranks the distinct pairs in order. A suffix whose pair occurs once has no partner in any
longer prefix either, so it leaves the array; rounds go on until none is left, so their number is the logarithm
of the longest repeated run. Suffixes of one rank after 2 ** k lines are an interval of the suffix array whose
longest common prefix is at least 2 ** k.

Intervals of the lengths between are found by going down the rounds again: an interval is split by the ranks
of what follows its common prefix, half as many lines further each time. At a shorter length an interval is looked at
again only with the later copies that end before the longer one and the first of each interval that was split off, so
that rounds hold about a row a suffix. So each suffix gets the most lines that
it shares with an earlier one, in order of (doc_id, text hash, position).

These are the repeated runs; those that lie in no other are the maximal ones, and all their lines are deleted if a run
has at least ``least`` lines. With ``long_words``, a line of at least that many words is a run by itself, whatever
stands around it. Blank lines inside a deleted run go with it, others stay.

Only built-in functions are used. Hot lines are counted map-side; joins to ranks have one row a rank on one
side, and adaptive execution splits the other. Windows hold one document.

Defined cases: null text has no line and stays null; an empty text is one blank line; one-line documents have
no run of two lines and stay, unless ``long_words`` is given and the line is that long; rows repeated under one id
with equal text are the same place, so neither removes the other; rows of one id with different texts follow the
hash of the text; an empty table gives an empty result; names of further columns can't clash, as they are
carried as one struct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, discard, written

#: Lines a repeated run has at least.
LEAST = 2
#: Words from which one line is a passage of its own: more than 50.
LONG_WORDS = 51
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Joins are shuffled at every size: tables of the shared folder are read compressed, so that their sizes say little about what a broadcast would hold.
MERGE = "merge"
SPANS = "array<struct<from_line:int,to_line:int>>"


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def lines_of(docs: DataFrame, id_col: str, text_col: str, long_words: int | None = None) -> DataFrame:
    """(doc, seq, line_no, long, a, b): lines with a word, numbered by seq; a and b are two hashes of a line."""
    text = F.col(text_col)
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("x")))
    worded = F.filter(numbered, lambda s: s["x"].rlike(HAS_WORD))
    long = lambda x: F.when(F.length(x) >= 2 * long_words - 1, F.regexp_count(x, F.lit(WORD)) >= long_words).otherwise(False) if long_words else F.lit(False)
    hashed = F.transform(worded, lambda s: F.struct(s["line_no"].alias("line_no"), long(s["x"]).alias("long"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit(1), s["x"]).alias("b")))
    doc = F.struct(F.col(id_col).alias("id"), _text_hash(text).alias("text_hash"))
    spread = docs.where(text.isNotNull()).select(doc.alias("doc"), F.posexplode(hashed).alias("seq", "line"))
    return spread.select("doc", "seq", "line.*")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first): keys that stand in two places or more, and the earliest (doc, seq)."""
    place = F.struct("doc", "seq")
    ends = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return ends.where("first <> last").drop("last")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The shared ``keys`` of ``rows`` with ``rank``, which ascends along them; written, so that ranks never change."""
    return written(_shared(rows, keys).orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def later() -> Column:
    """Whether a row isn't the first place of its interval."""
    return F.struct("doc", "seq") != F.col("first")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: (doc, seq, rank, first[, line_no, long]) of the suffixes that share 2 ** k lines; written."""
    ids = _ranked(lines, ["a", "b"])
    known = lines.join(ids.hint(MERGE), ["a", "b"]).select("doc", "seq", "rank", "first", "line_no", "long")
    found = [written(known.repartition("doc").dropDuplicates(["doc", "seq"]))]
    discard(ids)
    while not found[-1].isEmpty():
        step = 1 << (len(found) - 1)
        ahead = Window.partitionBy("doc").orderBy("seq").rangeBetween(step, step)
        paired = found[-1].select("doc", "seq", F.col("rank").alias("head"), F.max("rank").over(ahead).alias("next"))
        paired = written(paired.where("next is not null"))
        pairs = _ranked(paired, ["head", "next"])
        found.append(written(paired.join(pairs.hint(MERGE), ["head", "next"]).select("doc", "seq", "rank", "first")))
        discard(paired, pairs)
    discard(found.pop())
    return found


def longest_copies(ranks: list[DataFrame]) -> DataFrame:
    """(doc, seq, length): the most lines that an earlier suffix begins with as well; ``ranks`` has a level or more."""
    place, same = ["doc", "seq"], ["length", "interval"]
    level = lambda k: ranks[k].select(*place, F.lit(1 << k).alias("length"), F.col("rank").alias("interval"), "first")
    open_ = written(level(len(ranks) - 1))
    lengths = [level(k).where(later()).select(*place, "length") for k in range(len(ranks))]
    used = []
    for j in reversed(range(len(ranks) - 1)):
        behind = ranks[j].select("doc", F.col("seq").alias("at"), F.col("rank").alias("next"))
        longer = open_.withColumn("at", F.col("seq") + F.col("length")).join(behind.hint(MERGE), ["doc", "at"])
        # An interval is named by what it was split from; lengths tell the names of different rounds apart.
        longer = written(longer.select(*place, (F.col("length") + (1 << j)).alias("length"), F.xxhash64("interval", "next").alias("interval")))
        grown = written(longer.join(_shared(longer, same).hint(MERGE), same).select(*place, *same, "first"))
        discard(longer)
        used.append(grown)
        lengths.append(grown.where(later()).select(*place, "length"))
        if not j:
            break
        # What is left at the shorter lengths are later copies that end before the greater one, and the first of each interval
        # and of those that were split off, which has what the others in it have.
        reached = grown.where(later()).select(*place, (F.col("length") - (1 << j)).alias("length"))
        left = open_.join(reached.hint(MERGE), [*place, "length"], "left_anti")
        fresh = level(j).join(level(j + 1).where(later()).select(*place).hint(MERGE), place, "left_anti")
        kept = left.unionByName(fresh).unionByName(grown)
        before, open_ = open_, written(kept)
        discard(before)
    most = written(reduce(DataFrame.unionByName, lengths).groupBy(*place).agg(F.max("length").alias("length")))
    discard(open_, *used)
    return most


def repeated_runs(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, from_line, to_line, cut_from, cut_to), written: maximal runs that are later copies, and what is cut with them, by line number."""
    ranks = suffix_ranks(lines)
    if not ranks:
        copies = lines.where("false").select("doc", F.col("line_no").alias("from_line"), F.col("line_no").alias("to_line"))
        return written(copies.withColumns({"cut_from": F.col("from_line"), "cut_to": F.col("to_line")}))
    most = longest_copies(ranks)
    at = ranks[0].select("doc", "seq", "line_no", "long")
    runs = most.join(at.hint(MERGE), ["doc", "seq"]).where((F.col("length") >= least) | F.col("long")).withColumn("stop", F.col("seq") + F.when(F.col("length") >= least, F.col("length")).otherwise(1))
    by_seq = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.max("stop").over(by_seq)).where(F.coalesce(F.col("stop") > F.col("before"), F.lit(True)))
    ends = at.select("doc", (F.col("seq") + 1).alias("stop"), F.col("line_no").alias("to_line"))
    runs = runs.select("doc", "stop", F.col("line_no").alias("from_line")).join(ends.hint(MERGE), ["doc", "stop"]).drop("stop")
    by_line = Window.partitionBy("doc").orderBy("from_line")
    opens = F.coalesce(F.col("from_line") > F.lag("to_line").over(by_line) + 1, F.lit(True)).cast("int")
    islands = runs.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_line))
    island = Window.partitionBy("doc", "island")
    found = written(islands.select("doc", "from_line", "to_line", F.min("from_line").over(island).alias("cut_from"), F.max("to_line").over(island).alias("cut_to")))
    discard(most, *ranks)
    return found


def dedup(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """(row, n_lines, runs, cuts, kept): the row as it was, its maximal repeated runs, what they cover, and the text without it."""
    lines = written(lines_of(docs, id_col, text_col, long_words))
    found = repeated_runs(lines, least)
    discard(lines)
    cut = F.struct(F.col("cut_from").alias("from_line"), F.col("cut_to").alias("to_line"))
    per_doc = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("from_line", "to_line"))).alias("runs"), F.sort_array(F.collect_set(cut)).alias("cuts"))
    per_doc = per_doc.select(F.col("doc.id").alias("run_id"), F.col("doc.text_hash").alias("run_hash"), "runs", "cuts")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), _text_hash(F.col(text_col)).alias("text_hash"))
    joined = rows.join(per_doc.hint(MERGE), F.col("row")[id_col].eqNullSafe(F.col("run_id")) & (F.col("text_hash") == F.col("run_hash")), "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    # What lies before the first cut, between two cuts, and after the last one.
    stops = F.concat(F.col("cuts.from_line"), F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts.to_line", lambda x: x + 1))
    gaps = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))
    kept = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(F.flatten(gaps), "\n"))
    none = lambda c: F.coalesce(c, F.array().cast(SPANS)).alias(c)
    return joined.select("row", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), none("runs"), none("cuts"), kept.alias("kept"))


def deduped(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", long_words: int | None = None) -> DataFrame:
    """``docs`` without later copies of runs; documents that had a word and have none left go."""
    found = dedup(docs, least, id_col, text_col, long_words).where(~(F.size("runs") > 0) | F.col("kept").rlike(HAS_WORD))
    changed = F.size("runs") > 0
    columns = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("kept")}
    if size_col in columns:
        columns[size_col] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row")[size_col])
    return found.select(*[c.alias(name) for name, c in columns.items()])
