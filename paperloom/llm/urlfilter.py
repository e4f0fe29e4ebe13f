"""URL filter: rules first, else a character language-model ratio.

URLs that a rule judges train two smoothed variable-order Markov models over characters, one for
accepted and one for rejected URLs. A URL without a rule is accepted if its length-normalised
log-likelihood difference passes a threshold that is calibrated on a fold of the judged URLs.

Contexts of 0 to ``ORDER`` characters are counted exactly, each with the symbol behind it, over every judged
URL: a gram's key is its order and its symbols. The counts are a shuffled, written table that grows with the
URLs. What is scored are the distinct windows (ORDER characters and the next one) of all distinct URLs. Orders
up to ``SHALLOW`` have at most SYMBOLS ** (SHALLOW + 1) grams, which the alphabet bounds, and are broadcast;
the windows meet the deeper ones in groups that share their last SHALLOW + 1 context characters, as all deeper
contexts of a window do. Then each URL's positions are joined to the windows' values and added up, in
whole numbers, so that the order of adding makes no difference. The groups are dealt to buckets whose number
follows the size of both tables; a task holds a bucket.

Defined cases: a null or empty url has an empty host and path, no rule, and is scored on the end mark
alone; without accepted or without rejected training URLs the method allows; an empty table gives an
empty result; repeated rows get equal verdicts; further columns are passed by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, discard, written

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 5
#: Contexts of up to so many characters are broadcast.
SHALLOW = 2
#: Bits a symbol, and URLs taken at once.
BITS, STEP = 7, 4096
#: Grams and windows a bucket on average.
BUCKET_ROWS = 500_000
#: A position's value is stored in units of 2 ** -UNIT.
UNIT = 32
#: 0 ends a URL, 1-95 are printable ASCII, 96 is any other byte, 97 stands before a URL.
SYMBOLS = 98
END, OTHER, START = 0, 96, 97
#: Scores are histogrammed in these bins for the calibration.
EDGE, BINS = 4.0, 4000
#: URLs whose fold is 0 are left out of training and calibrate the threshold.
FOLDS = 5

_SYMBOL = np.full(256, OTHER, np.int64)
_SYMBOL[32:127] = np.arange(1, 96)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a string; null if none does."""
    found = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        found = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)).otherwise(found)
    return found


def fold_of(url: Column) -> Column:
    return F.conv(F.substring(F.md5(url.cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS


def _positions(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all URLs, each preceded by ORDER start marks; the scored positions; their URL."""
    coded = [np.frombuffer((u or "").encode("utf-8", "replace"), np.uint8) for u in urls]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded)) + ORDER + 1
    ends = np.cumsum(lengths)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, START, np.int64)
    scored = np.ones(len(symbols), bool)
    starts = ends - lengths
    for j in range(ORDER):
        scored[starts + j] = False
    scored_at = np.flatnonzero(scored)
    symbols[scored_at] = END
    symbols[np.setdiff1d(scored_at, ends - 1, assume_unique=True)] = _SYMBOL[np.concatenate(coded)] if coded else 0
    return symbols, scored_at, np.repeat(np.arange(len(urls)), lengths - ORDER)


def _contexts(symbols: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The context of each position as 7 bits a character, the nearest lowest, for orders 0 to ORDER."""
    context = np.zeros(len(at), np.int64)
    yield context
    for k in range(1, ORDER + 1):
        context = context | (symbols[at - k] << BITS * (k - 1))
        yield context


def _grams(k: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Keys of contexts of ``k`` characters with the symbol behind them: order, context, symbol."""
    return ((np.int64(k) << BITS * ORDER | context) << BITS) | symbol


def _keys(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([_grams(k, c, symbols[at]) for k, c in enumerate(_contexts(symbols, at))])


def _windows(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The context of ORDER characters and the symbol of each position."""
    *_, context = _contexts(symbols, at)
    return context << BITS | symbols[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, accepted, rejected): counts of some thousand URLs at a time, from columns url and ok."""
    for batch in batches:
        urls, ok = batch.column("url").to_pylist(), np.array(batch.column("ok").to_pylist(), bool)
        for i in range(0, len(urls), STEP):
            symbols, at, owner = _positions(urls[i : i + STEP])
            keys, place = np.unique(_keys(symbols, at), return_inverse=True)
            accepted = np.tile(ok[i : i + STEP][owner], ORDER + 1)
            total, taken = np.bincount(place, minlength=len(keys)), np.bincount(place[accepted], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(taken), pa.array(total - taken)], ["key", "accepted", "rejected"])


class Shares:
    """Counted symbols' shares in the rows of contexts; all others are 0."""

    def __init__(self, row: np.ndarray, symbol: np.ndarray, share: np.ndarray, rows: int):
        cell = row * SYMBOLS + symbol
        order = np.argsort(cell)
        self.cell, self.share, self.rows = cell[order], share[order], rows

    def at(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        cell = row * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
        return np.where(self.cell[at] == cell, self.share[at], 0)

    def sum(self, axis: int) -> np.ndarray:
        return np.bincount(self.cell // SYMBOLS if axis else self.cell % SYMBOLS, self.share, self.rows if axis else SYMBOLS)


class CharacterModels:
    """Witten-Bell interpolated models of accepted and rejected URLs over exact contexts.

    Of grams of some orders only, the others' contexts count as unseen.
    """

    def __init__(self, key: np.ndarray, accepted: np.ndarray, rejected: np.ndarray):
        self.trained = bool(accepted.sum() and rejected.sum())
        order, context, symbol = key >> BITS * (ORDER + 1), (key >> BITS) & ((1 << BITS * ORDER) - 1), key & ((1 << BITS) - 1)
        self.contexts, self.share, self.rest = [], ([], []), ([], [])
        for k in range(ORDER + 1):
            own = order == k
            contexts, row = np.unique(context[own], return_inverse=True)
            self.contexts.append(contexts)
            for side, n in enumerate((accepted, rejected)):
                n = n[own]
                total, kinds = np.bincount(row, n, len(contexts)), np.bincount(row, n > 0, len(contexts))
                below = np.maximum(total + kinds, 1)
                self.share[side].append(Shares(row, symbol[own], n / below[row], len(contexts)))
                self.rest[side].append(np.where(total > 0, kinds / below, 1))

    def _chances(self, window: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The two models' probabilities of the symbols of ``window``, from those of the orders that are not held."""
        symbol, context = window & ((1 << BITS) - 1), window >> BITS
        for k, known in enumerate(self.contexts):
            if not len(known):
                continue
            own = context & ((1 << BITS * k) - 1)
            row = np.minimum(np.searchsorted(known, own), len(known) - 1)
            seen = known[row] == own
            for side in (0, 1):
                p[side] = np.where(seen, self.share[side][k].at(row, symbol) + self.rest[side][k][row] * p[side], p[side])
        return p

    def chances(self, window: np.ndarray, below: CharacterModels | None = None) -> np.ndarray:
        """The two models' probabilities of each window's symbol; ``below`` holds the lower orders."""
        p = np.full((2, len(window)), 1 / SYMBOLS)
        return self._chances(window, below._chances(window, p) if below else p)

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Mean log-likelihood difference a character; 0 for all if a side has no training URL."""
        if not self.trained or not urls:
            return np.zeros(len(urls))
        symbols, at, owner = _positions(urls)
        p = self.chances(_windows(symbols, at))
        per_url = np.bincount(owner, np.log(p[0]) - np.log(p[1]), len(urls))
        return per_url / np.bincount(owner, minlength=len(urls))


def threshold_of(ok: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the bins where false accepts and false rejects, as rates, sum to least."""
    if not ok.sum() or not bad.sum():
        return 0.0
    lost = np.concatenate([[0], np.cumsum(ok)]) / ok.sum()
    let_in = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(np.isclose(lost + let_in, (lost + let_in).min(), rtol=0, atol=1e-12))
    return float(best[len(best) // 2] / BINS * 2 * EDGE - EDGE)


def count(labelled: DataFrame) -> DataFrame:
    """(key, accepted, rejected): the grams of (url, ok), counted; written."""
    counts = labelled.mapInArrow(_count, "key long, accepted long, rejected long")
    return written(counts.groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))


def _models(grams: pa.Table) -> CharacterModels:
    return CharacterModels(*(grams.column(c).to_numpy().astype(np.int64) for c in ("key", "accepted", "rejected")))


def values(grams: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, value): the log-likelihood difference of each of the written, distinct ``windows``, times 2 ** UNIT."""
    spark: SparkSession = grams.sparkSession
    deep = F.col("key") >= (SHALLOW + 1) << BITS * (ORDER + 1)
    shallow = spark.sparkContext.broadcast(_models(grams.where(~deep).toArrow()))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(grams.count() + windows.count()) // BUCKET_ROWS))
    # The last SHALLOW + 1 characters of the context, which all deeper contexts of a window share.
    dealt = lambda c: F.pmod(F.xxhash64(F.shiftright(c, BITS).bitwiseAND((1 << BITS * (SHALLOW + 1)) - 1)), F.lit(buckets)).alias("bucket")

    def run(known: pa.Table, wanted: pa.Table) -> pa.Table:
        window = wanted.column("window").to_numpy()
        p = np.log(_models(known).chances(window, shallow.value))
        return pa.table({"window": window, "value": np.rint((p[0] - p[1]) * 2.0**UNIT).astype(np.int64)})

    left = grams.where(deep).select("*", dealt("key")).groupBy("bucket")
    return left.cogroup(windows.select("window", dealt("window")).groupBy("bucket")).applyInArrow(run, "window long, value long")


def scores(grams: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, score): mean log-likelihood difference a character of each distinct url; written."""
    numbered = written(urls.distinct().withColumn("n", F.monotonically_increasing_id()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), STEP):
                part = batch.slice(i, STEP)
                symbols, at, owner = _positions(part.column("url").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("n").take(pa.array(owner)), pa.array(_windows(symbols, at))], ["n", "window"])

    positions = numbered.mapInArrow(spread, "n long, window long")
    windows = written(positions.select("window").distinct())
    summed = positions.join(values(grams, windows), "window").groupBy("n").agg((F.sum("value") / 2.0**UNIT / F.count(F.lit(1))).alias("score"))
    scored = written(numbered.join(summed, "n").select("url", "score"))
    discard(numbered, windows)
    return scored


def calibrated(scored: DataFrame) -> float:
    """The threshold from (ok, score)."""
    place = F.floor((F.col("score") + EDGE) / (2 * EDGE) * BINS)
    place = F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("long").alias("bin")
    bins = scored.groupBy(place).agg(F.sum(F.col("ok").cast("long")).alias("ok"), F.sum((~F.col("ok")).cast("long")).alias("bad")).toPandas()
    sums = np.zeros((2, BINS), np.int64)
    sums[:, bins["bin"].to_numpy(np.int64)] = [bins["ok"], bins["bad"]]
    return threshold_of(*sums)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``."""
    url = F.col(url_col)
    parts = pages.select(id_col, F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for h, p, v in rules for x in (h + p, v)]) if rules else None
    ruled = ruled.withColumn("ruling", verdicts[F.col("rule")] if rules else F.lit(None).cast("string"))
    labelled = ruled.where("rule is not null").select("url", (F.col("ruling") == "allow").alias("ok"))
    fold = fold_of(F.col("url"))
    grams = count(labelled.where(fold != 0))
    seen = grams.agg(F.sum("accepted"), F.sum("rejected")).first()
    if seen[0] and seen[1]:
        known = scores(grams, parts.select("url"))
        discard(grams)
        threshold = calibrated(labelled.where(fold == 0).join(known, "url"))
        scored = ruled.join(known, "url")
    else:
        threshold, scored = 0.0, ruled.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("ruling", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
