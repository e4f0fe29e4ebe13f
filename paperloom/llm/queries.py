"""The training-data queries, each a thin use of its operator, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import ann, audio, jaccard, linededup, mixing, packing, returns, spelling, substrings, suffixes, toxicity, urlfilter, warc


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("score", F.round("score", 6))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.score(docs, toxicity.fit(docs, labels)).drop("clauses")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs).select(
        "row.doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), long_words=linededup.LONG_WORDS)
    removed = F.aggregate("cuts", F.lit(0), lambda n, r: n + r["to_line"] - r["from_line"] + 1)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("runs").cast("long").alias("n_runs"),
        removed.cast("long").alias("n_removed"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_id")


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.stored_features(audio.store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    feature = F.format_string("frames=%d;active=%d;tensors=%d:%s", "n_frames", F.size("segments"), "n_tensors", F.hex(F.xxhash64("tensors", "segments")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), noise=True)


def op12_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.match(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), spark.read.parquet(f"{sf_dir}/sales.parquet"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_audio": op8_audio,
    "op9_ann": op9_ann,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling": op11_spelling,
    "op12_returns": op12_returns,
    "op13_suffix_dedup": op13_suffix_dedup,
}

# For each order k: the symbol's count, and the context's total and number of symbols, for accepted (a) and rejected (r) URLs.
_ORDERS = range(urlfilter.ORDER + 1)
_COUNTS = ", ".join(f"coalesce(max(CASE WHEN k = {k} THEN {c} END), 0) AS {c}{k}" for k in _ORDERS for c in ("na", "ta", "ka", "nr", "tr", "kr"))
_STEP = "CASE WHEN t{s}{k} > 0 THEN n{s}{k} / (t{s}{k} + k{s}{k})::DOUBLE + (k{s}{k} / (t{s}{k} + k{s}{k})::DOUBLE) * p{s} ELSE p{s} END AS p{s}"
_CHANCES = f"(SELECT *, 1::DOUBLE / {urlfilter.SYMBOLS} AS pa, 1::DOUBLE / {urlfilter.SYMBOLS} AS pr FROM counts)"
for _k in _ORDERS:
    _CHANCES = f"(SELECT * EXCLUDE (pa, pr), {_STEP.format(s='a', k=_k)}, {_STEP.format(s='r', k=_k)} FROM {_CHANCES})"

#: The CRC-32 table, then checksums of strings by a fold over their bytes.
_CRC = """table_steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_steps WHERE k < 8),
crc AS (
  SELECT list(c ORDER BY i) AS t FROM table_steps WHERE k = 8)"""
_BYTES = "list_transform(range(length(hex({0})) // 2), lambda k: ('0x' || substr(hex({0}), 2 * k + 1, 2))::BIGINT)"
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, " + _BYTES + "), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"

ORACLES: dict[str, str] = {
    "op1_url_filter": f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, ('0x' || substr(md5(url), 1, 8))::BIGINT % {urlfilter.FOLDS} AS fold,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
labelled AS (
  SELECT url, fold, rule IN ('com/', 'www.example.com/en/') AS ok FROM ruled WHERE rule IS NOT NULL),
coded AS (
  SELECT url, list_concat(['^', '^', '^', '^', '^'], list_transform(generate_series(1, octet_length(encode(url))), lambda i:
         CASE WHEN substr(hex(encode(url)), 2 * i - 1, 2) BETWEEN '20' AND '7E' THEN substr(hex(encode(url)), 2 * i - 1, 2) ELSE 'other' END), ['$']) AS c
  FROM (SELECT DISTINCT url FROM parts)),
grams AS (
  SELECT url, i, k, c[i] AS symbol, array_to_string(list_slice(c, i - k, i - 1), ' ') AS context
  FROM (SELECT url, c, unnest(generate_series(6, len(c))) AS i FROM coded), generate_series(0, {urlfilter.ORDER}) AS orders(k)),
counted AS (
  SELECT k, context, symbol, coalesce(sum(w) FILTER (ok), 0)::BIGINT AS na, coalesce(sum(w) FILTER (NOT ok), 0)::BIGINT AS nr
  FROM grams JOIN (SELECT url, ok, count(*) AS w FROM labelled WHERE fold <> 0 GROUP BY ALL) USING (url) GROUP BY ALL),
totals AS (
  SELECT k, context, sum(na)::BIGINT AS ta, count(*) FILTER (na > 0) AS ka, sum(nr)::BIGINT AS tr, count(*) FILTER (nr > 0) AS kr FROM counted GROUP BY ALL),
counts AS (
  SELECT url, i, {_COUNTS} FROM grams LEFT JOIN totals USING (k, context) LEFT JOIN counted USING (k, context, symbol) GROUP BY url, i),
scores AS (
  SELECT url, sum(round_even((ln(pa) - ln(pr)) * 2::DOUBLE ** {urlfilter.UNIT}, 0)::BIGINT)::DOUBLE / 2::DOUBLE ** {urlfilter.UNIT} / count(*) AS score FROM {_CHANCES} GROUP BY url),
bins AS (
  SELECT least(greatest(floor((score + {urlfilter.EDGE}) / {2 * urlfilter.EDGE} * {urlfilter.BINS}), 0), {urlfilter.BINS - 1})::BIGINT AS bin, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad
  FROM labelled JOIN scores USING (url) WHERE fold = 0 GROUP BY 1),
sums AS (
  SELECT sum(good) AS goods, sum(bad) AS bads FROM bins),
edges AS (
  SELECT e, coalesce(sum(good) FILTER (bin < e), 0) / any_value(goods)::DOUBLE + (1 - coalesce(sum(bad) FILTER (bin < e), 0) / any_value(bads)::DOUBLE) AS lost
  FROM generate_series(0, {urlfilter.BINS}) AS s(e), bins, sums WHERE goods > 0 AND bads > 0 GROUP BY e),
best AS (
  SELECT list(e ORDER BY e) AS es FROM edges WHERE lost <= (SELECT min(lost) FROM edges) + 1e-12),
chosen AS (
  SELECT coalesce(es[len(es) // 2 + 1] / {urlfilter.BINS}::DOUBLE * {2 * urlfilter.EDGE} - {urlfilter.EDGE}, 0) AS threshold FROM best)
SELECT page_id, host, path, rule, round(score, 6) AS score,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN score >= threshold THEN 'allow' ELSE 'block' END AS verdict
FROM ruled JOIN scores USING (url), chosen
""",
    "op4_warc": """
WITH heads AS (
  SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
tops AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM heads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to
FROM tops
""",
    "op3_mixing": """
WITH docs AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         source_size * 3 / weight AS full_at
  FROM weighed),
goals AS (
  SELECT source, source_size, least((SELECT max(level) FROM levels WHERE level <= full_at) * weight, (source_size * 3)::DOUBLE) AS target,
         ('0x' || substr(md5('0|' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 4))::INT / 65536.0::DOUBLE AS u
  FROM levels),
placed AS (
  SELECT d.*, g.source_size, g.target, g.u, target / source_size AS each,
         (row_number() OVER (PARTITION BY d.source ORDER BY down, CASE WHEN down THEN -size ELSE size END, substr(digest, 1, 3), doc_id))::DOUBLE AS place
  FROM (SELECT *, substr(digest, 4, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS down FROM docs) d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * least(3, floor(place * each + u) - floor((place - 1) * each + u))::BIGINT END AS taken
FROM placed
""",
    # Every line is matched with every earlier place of it; matches on one diagonal join to runs.
    "op6_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
         length(line) >= 101 AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 51 AS long
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
matches AS (
  SELECT a.doc_id, a.seq, b.doc_id AS other, a.seq - b.seq AS diagonal
  FROM worded a JOIN worded b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.seq < a.seq))),
islands AS (
  SELECT *, seq - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY seq) AS island FROM matches),
longest AS (
  SELECT doc_id, seq, max(stop) AS stop FROM (
    SELECT doc_id, seq, max(seq) OVER (PARTITION BY doc_id, other, diagonal, island) + 1 AS stop FROM islands)
  GROUP BY doc_id, seq),
copies AS (
  SELECT l.doc_id, l.seq, line_no, CASE WHEN stop - l.seq >= 2 THEN stop ELSE l.seq + 1 END AS stop
  FROM longest l JOIN worded w ON l.doc_id = w.doc_id AND l.seq = w.seq WHERE stop - l.seq >= 2 OR long),
runs AS (
  SELECT c.doc_id, c.line_no AS from_line, w.line_no AS to_line FROM (
    SELECT * FROM copies QUALIFY stop > coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) c
  JOIN worded w ON c.doc_id = w.doc_id AND c.stop - 1 = w.seq),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(from_line, to_line)) AS line_no FROM runs),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
         string_agg(CASE WHEN g.line_no IS NULL THEN line END, chr(10) ORDER BY l.line_no) AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_runs, 0)::BIGINT AS n_runs,
       coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_runs FROM runs GROUP BY doc_id) r ON d.doc_id = r.doc_id
""",
    "op7_ngram_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS class FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a),
components AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       CASE WHEN class IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY class) END AS class_id
FROM components LEFT JOIN sizes USING (doc_id)
""",
    "op10_substring_dedup": """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (
  SELECT win, min(doc_id) AS least FROM (SELECT md5(array_to_string(win, ' ')) AS win, doc_id FROM windows) GROUP BY win HAVING min(doc_id) < max(doc_id)),
copies AS (
  SELECT doc_id, i FROM windows JOIN firsts ON md5(array_to_string(windows.win, ' ')) = firsts.win WHERE least < doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM copies),
spread AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (
  SELECT s.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY s.i) AS kept
  FROM spread s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op11_spelling": f"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT run, n, {_CRC_OF.format("encode(doc_id || ':' || run)")} AS h FROM runs, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word),
near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN near ON w.word = near.word),
chains AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms
  UNION ALL SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chains c JOIN forms f ON c.root = f.word WHERE NOT c.done)
SELECT f.word, n, n_near::BIGINT AS n_near, form, form_n, root FROM forms f JOIN chains c ON f.word = c.word AND c.done
""",
    "op12_returns": f"""
WITH RECURSIVE {_CRC},
sold AS (
  SELECT client_id, item_id, date_diff('day', DATE '1970-01-01', shipped_at::DATE) AS day, l.sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS q,
         floor(100 * amount + 0.5)::BIGINT AS c, floor(100 * coalesce(discount, 0) + 0.5)::BIGINT AS d, flag, row_number() OVER () AS tie
  FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id
  WHERE client_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND shipped_at IS NOT NULL AND quantity >= 1),
hashed AS (
  SELECT *, {_CRC_OF.format("encode(sale_id || ':' || coalesce(line_no::VARCHAR, ''))")} AS h FROM sold, crc WHERE flag = 'returned'),
events AS (
  SELECT client_id, item_id, day, 1 AS kind, sale_id, line_no, q, c, d, q AS units, tie FROM sold
  UNION ALL SELECT client_id, item_id, day + 1 + h % 7, 0, sale_id, line_no, q, c, d, (1 + h % (q + 1))::BIGINT, tie FROM hashed),
sums AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 1 THEN units END) OVER w, 0) AS shipped, coalesce(sum(CASE WHEN kind = 0 THEN units END) OVER w, 0) AS asked,
         count(CASE WHEN kind = 0 THEN 1 END) OVER w AS return_no
  FROM events WINDOW w AS (PARTITION BY client_id, item_id ORDER BY day, kind, sale_id, line_no NULLS FIRST, q, c, d, tie)),
axis AS (
  SELECT *, asked - greatest(0, coalesce(max(CASE WHEN kind = 0 THEN asked - shipped END) OVER w, 0)) AS found
  FROM sums WINDOW w AS (PARTITION BY client_id, item_id ORDER BY day, kind, sale_id, line_no NULLS FIRST, q, c, d, tie)),
back AS (
  SELECT *, coalesce(lag(found) OVER (PARTITION BY client_id, item_id ORDER BY return_no), 0) AS a, found AS b FROM axis WHERE kind = 0),
pieces AS (
  SELECT r.client_id, r.item_id, r.return_no, r.day AS return_day, r.sale_id AS return_sale_id, l.sale_id AS lot_sale_id, l.line_no AS lot_line_no, l.shipped,
         least(r.b, l.shipped) - greatest(r.a, l.shipped - l.q) AS units, l.shipped - least(r.b, l.shipped) AS lot_left,
         greatest(r.a, l.shipped - l.q) - r.a AS given, greatest(r.a, l.shipped - l.q) - (l.shipped - l.q) AS taken,
         r.q, r.c, r.d, l.q AS lot_q, l.c AS lot_c
  FROM back r JOIN axis l ON r.client_id = l.client_id AND r.item_id = l.item_id AND l.kind = 1 AND l.shipped > r.a AND l.shipped - l.q < r.b
  WHERE r.a < r.b
  UNION ALL SELECT client_id, item_id, return_no, day, sale_id, NULL, NULL, NULL, units - (b - a), NULL, b - a, NULL, q, c, d, NULL, NULL FROM back WHERE units > b - a),
priced AS (
  SELECT *, ((given + units) * c * (100 - d)) // (100 * q) - (given * c * (100 - d)) // (100 * q) AS refund,
         ((taken + units) * lot_c) // lot_q - (taken * lot_c) // lot_q AS cost FROM pieces)
SELECT client_id, item_id, return_no::BIGINT AS return_no, row_number() OVER (PARTITION BY client_id, item_id, return_no ORDER BY shipped NULLS LAST)::BIGINT AS piece_no,
       return_day::BIGINT AS return_day, return_sale_id, lot_sale_id, lot_line_no, units::BIGINT AS units, lot_left::BIGINT AS lot_left, refund::BIGINT AS refund_cents, (refund - cost)::BIGINT AS margin_cents
FROM priced
""",
    "op13_suffix_dedup": """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS win
  FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS i FROM bytes WHERE length(h) >= 100)),
firsts AS (
  SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
copies AS (
  SELECT windows.doc_id, i FROM windows JOIN firsts ON windows.win = firsts.win WHERE least < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM copies),
numbered AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
cut AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps g JOIN bytes d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes d LEFT JOIN cut c ON d.doc_id = c.doc_id
""",
}
