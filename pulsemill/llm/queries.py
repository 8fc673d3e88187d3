"""The operators as named queries over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pulsemill.llm import (
    decontam, extract, jaccard, merkle, mixing, neardup, quality, search, secrets, substrings, tokenids, toxicity, warc,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_mixing", r"""
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS text, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS total,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
step AS (
  SELECT source, total, w, 3 * total AS filled,
         coalesce(sum(3 * total) OVER (ORDER BY 3 * total / w, source IS NULL, source
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
         sum(w) OVER (ORDER BY 3 * total / w, source IS NULL, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(total) OVER () AS budget
  FROM per),
level AS (
  SELECT max(greatest(budget - taken, 0) / open) AS level FROM step
  WHERE greatest(budget - taken, 0) / open * w <= filled),
aims AS (
  SELECT source, total, least(level * w, filled) AS target,
         CASE WHEN total > 0 THEN least(level * w, filled) / total ELSE 0 END AS rate
  FROM step CROSS JOIN level),
drawn AS (
  SELECT s.*, a.total, a.target, a.rate, coalesce('s' || s.source, 'n') AS key, (a.rate - floor(a.rate)) * a.total AS wanted,
         CAST('0x' || substr(md5('0' || chr(1) || coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(1) || md5(text)), 1, 12)
              AS BIGINT) / 281474976710656.0 AS u
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
sums AS (
  SELECT key, u, max(wanted) AS wanted, sum(size) AS words, count(*) AS n,
         sum(sum(size)) OVER (PARTITION BY key ORDER BY u) AS upto FROM drawn GROUP BY key, u),
ends AS (
  SELECT key, u, n, words / n AS each, wanted - (upto - words) AS open FROM sums WHERE upto > wanted
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY u) = 1),
bounds AS (
  SELECT key, u AS bound, floor(open / each) + CASE WHEN each - (open - floor(open / each) * each) < open - floor(open / each) * each
                                                    THEN 1 ELSE 0 END AS taking FROM ends),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, u ORDER BY doc_id) AS place FROM drawn)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size,
       round(target, 6) AS target,
       size * CAST(floor(rate) + CASE WHEN rate > floor(rate) AND (u < bound OR u = bound AND place <= taking) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM ranked LEFT JOIN bounds USING (key)""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"),
    )


@query("op10_quality", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i : i + 2], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT r, unnest(range(i, i + 3)) AS p
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
word AS (
  SELECT r, x, len(regexp_extract_all(x, '[A-Z]')) AS caps,
         strlen(regexp_replace(x, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters
  FROM (SELECT r, unnest(w) AS x FROM d)),
per AS (
  SELECT r, sum(len(x)) AS word_chars, count(*) FILTER (caps > 1 AND 2 * caps > letters) AS loud,
         count(*) FILTER (letters > 0) AS lettered, count(*) FILTER (regexp_matches(x, '[0-9]')) AS digits
  FROM word GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, loud, lettered, digits
  FROM d LEFT JOIN again USING (r) LEFT JOIN per USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 40 * n_lines OR 100 * loud > 60 * n_words OR 100 * lettered < 60 * n_words
            OR 100 * digits > 50 * n_words) AS kept
FROM base""")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


@query("op3_decontamination", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
hits AS (SELECT DISTINCT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN items USING (r)""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op1_token_ids")
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, folder = tokenids.write(table(spark, sf_dir, "documents"))
    return tokenids.read(catalog, folder)


@query("op7_warc", r"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f.payload_digest IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(catalog, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """(doc, start, rank, kind, stop) of a pattern: positions from the lengths of what stands between matches."""
    whole = f"(?i)({pattern[4:]})" if pattern.startswith("(?i)") else f"({pattern})"
    key = group + 1 if group else 1
    return f"""
SELECT r, s - n AS start, {rank} AS rank, '{kind}' AS kind, s AS stop FROM (
  SELECT r, i, len(m[i]) AS n, len(k[i]) AS key,
         sum(len(g[i]) + len(m[i])) OVER (PARTITION BY r ORDER BY i) AS s
  FROM (SELECT r, m, k, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(text, {_quote(whole)}, 1) AS m, regexp_extract_all(text, {_quote(whole)}, {key}) AS k,
           string_split_regex(text, {_quote(pattern)}) AS g FROM d)))
WHERE key >= {least}"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SECRETS = "\nUNION ALL".join(
    _spans_sql(r.name, i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES)
)


@query("op2_secrets", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_SECRETS}),
per AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)""")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), secrets.new_ledger(spark))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = tuple(r.name for r in secrets.BASE)
    return out.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(secrets.as_text(F.col("spans"), base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"),
    )


@query("op5_html")
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages.select("page_id", "url", "html"), extract.train(pages))


@query("op6_substrings", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, list(DISTINCT p) AS ps FROM (
  SELECT r, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (g)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x)), lambda x: w[x]), ' ') END) AS kept_sha256
FROM d LEFT JOIN hit USING (r)""")
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


@query("op4_jaccard", r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, md5(g) AS g FROM (
    SELECT r, array_to_string(w[i : i + 2], ' ') AS g
    FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(r, t) AS (
  SELECT r, r FROM d UNION SELECT reach.r, b.y FROM reach JOIN both_ways b ON reach.t = b.x),
low AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) JOIN low USING (r)""")
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


@query("op11_merkle", r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, CAST(doc_id AS VARCHAR) AS id FROM documents),
bits AS (
  SELECT r, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * len(id)),
           lambda i: (CAST(ord(id[CAST(i // 8 AS INT) + 1]) AS BIGINT) >> (i % 8)) & 1)),
           lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))) AS c FROM d WHERE id IS NOT NULL),
own AS (
  SELECT d.r, doc_id, lang, prefix, suffix,
         sha256(prefix || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || suffix) AS leaf,
         CASE WHEN xor(c, 4294967295) % 7 = 0
              THEN sha256(prefix || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || suffix)
              ELSE sha256(prefix || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || suffix) END AS forged
  FROM (SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') AS prefix, coalesce(strlen(text) || ':' || text, '-') AS suffix FROM d) d
  LEFT JOIN bits USING (r)),
leaves AS (
  SELECT r, doc_id, leaf, forged, coalesce('=' || lang, '') AS g, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY lang) AS n
  FROM own WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
low(g, l, p, n, h) AS (
  SELECT g, 0, p, n, leaf FROM leaves
  UNION ALL
  SELECT g, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY g, l, n, p // 2),
tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1),
high(l, p, n, h) AS (
  SELECT 0, p, n, h FROM tops
  UNION ALL
  SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM high WHERE n > 1 GROUP BY l, n, p // 2),
steps AS (
  SELECT r, x.l AS s, (leaves.p >> x.l) % 2 AS right_slot, coalesce(y.h, '') AS sibling
  FROM leaves JOIN (SELECT DISTINCT g, l FROM low WHERE n > 1) x USING (g)
  LEFT JOIN low y ON y.g = leaves.g AND y.l = x.l AND y.p = xor(leaves.p >> x.l, 1)
  UNION ALL
  SELECT r, 1000 + x.l, (tops.p >> x.l) % 2, coalesce(y.h, '')
  FROM leaves JOIN tops USING (g) CROSS JOIN (SELECT DISTINCT l FROM high WHERE n > 1) x
  LEFT JOIN high y ON y.l = x.l AND y.p = xor(tops.p >> x.l, 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s) AS k FROM steps),
folds(r, k, h) AS (
  SELECT r, 1, forged FROM leaves
  UNION ALL
  SELECT f.r, f.k + 1, sha256(CASE WHEN right_slot = 1 THEN sibling || f.h ELSE f.h || sibling END) FROM folds f JOIN ranked x ON x.r = f.r AND x.k = f.k),
ends AS (SELECT r, max_by(h, k) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT r, string_agg(sibling, '' ORDER BY s) AS proof FROM steps GROUP BY r)
SELECT doc_id, leaf, tops.h AS subroot, high.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = high.h AS verified
FROM leaves JOIN tops USING (g) JOIN high ON high.n = 1 JOIN ends USING (r) LEFT JOIN proofs USING (r)""")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: F.col(c) for c in merkle.FIELDS}
    changed = merkle.leaf([*({**fields, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}).values()])
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    forged = F.when(picked, changed).otherwise(merkle.leaf([*fields.values()]))
    tree = merkle.manifest(table(spark, sf_dir, "documents"), keep={"forged": forged})
    folded = tree.withColumn("folded_root", merkle.fold(F.col("forged"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op12_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
q AS (
  SELECT DISTINCT i, item_id, term FROM (
    SELECT i, item_id, unnest(t) AS term FROM (
      SELECT row_number() OVER () AS i, item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark))),
whole AS (SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, big_n),
gains AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS gain
  FROM tf JOIN w USING (term), whole),
scores AS (SELECT i, item_id, r, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN gains USING (term) GROUP BY i, item_id, r, doc_id),
ranks AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50""")
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query("op13_near_vectors", r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS x, b.r AS y FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) >= 0.98 * a.norm * b.norm),
reach(r, t) AS (SELECT r, r FROM v UNION SELECT reach.r, y FROM reach JOIN links ON t = x),
low AS (SELECT reach.r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = t GROUP BY reach.r),
counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN low USING (r) LEFT JOIN counts USING (r)""")
def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
