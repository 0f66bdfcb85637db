"""Thin queries of the document operators: op<N>_<name>, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Tokens from which a document is over the context limit.
TOKEN_LIMIT = 4096


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY h) AS c,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(c AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]', '', 'g')), 0) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
c AS (SELECT *, CAST(source_size AS DOUBLE) * 3 AS cap, CAST(source_size AS DOUBLE) * 3 / weight AS meets FROM w),
l AS (
  SELECT *, ((SELECT sum(CAST(source_size AS DOUBLE)) FROM s)
      - coalesce((SELECT sum(b.cap) FROM c b WHERE (b.meets, b.source IS NULL, coalesce(b.source, '')) < (a.meets, a.source IS NULL, coalesce(a.source, ''))), 0))
    / (SELECT sum(b.weight) FROM c b WHERE (b.meets, b.source IS NULL, coalesce(b.source, '')) >= (a.meets, a.source IS NULL, coalesce(a.source, ''))) AS level
  FROM c a),
t AS (
  SELECT source, source_size, CASE WHEN meets <= f THEN cap ELSE weight * f END AS target,
         CAST(('0x' || substr(sha256('7:' || coalesce('s' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM l, (SELECT max(level) AS f FROM l)),
p AS (
  SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(least(floor((pos + 1) * rate + u) - floor(pos * rate + u), 3) * size AS BIGINT) AS taken
FROM p
"""


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .simple8b import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, fold, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.drop("lang"), fit(docs))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a
  FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(a), 10) AS size, array_to_string(list_slice(a, s, s + least(len(a), 10) - 1), ' ') AS w
  FROM (SELECT *, unnest(range(1, len(a) - least(len(a), 10) + 2)) AS s FROM i WHERE len(a) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS a
  FROM documents),
dw AS (
  SELECT doc_id, s, size, array_to_string(list_slice(a, s, s + size - 1), ' ') AS w
  FROM (SELECT doc_id, a, size, unnest(range(1, len(a) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw) WHERE len(a) >= size)),
h AS (SELECT DISTINCT doc_id, s, dw.size, item_id FROM dw JOIN iw USING (w, size)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM h)) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import kept_digest, repeats

    return kept_digest(repeats(table(spark, sf_dir, "documents")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.to_json("matches").alias("matches"))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that labels calls good and not toxic. Returns every document; selected marks the draw."""
    from .common import among
    from .quality import resample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return resample(docs, among(docs, good, "doc_id"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS a FROM p),
f AS (
  SELECT lang, size, array_to_string(list_slice(a, s, s + size - 1), ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, a, size, unnest(range(1, len(a) - size + 2)) AS s FROM w, (SELECT unnest(range(1, 5)) AS size) WHERE len(a) >= size)
  GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= 30),
inside AS (
  SELECT lang, sub AS phrase, max(a) AS most
  FROM (SELECT lang, a, array_to_string(list_slice(w, s, s + k - 1), ' ') AS sub
        FROM (SELECT *, unnest(range(1, size - k + 2)) AS s FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < size))
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase)
  WHERE c.size > 1 AND NOT coalesce(CAST(most AS HUGEINT) * 100 >= CAST(c.a AS HUGEINT) * 80, FALSE)),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, size), ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, CAST(CAST(cut.a AS HUGEINT) * 2000000 // (x.a + y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.head JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private import KINDS, personal_spans, written_spans

    found = personal_spans(table(spark, sf_dir, "documents"))
    base = F.sha2(written_spans(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], base.alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) AS k(kind, name, pattern)),
m AS (
  SELECT r, kind, name, g, v, unnest(range(1, len(v) + 1)) AS i
  FROM (
    SELECT r, kind, name, string_split_regex(t, pattern) AS g, regexp_extract_all(t, pattern) AS v
    FROM (SELECT d.*, 0 AS kind FROM d WHERE t LIKE '%@%' UNION ALL SELECT d.*, unnest([1, 2, 3]) FROM d) JOIN k USING (kind))
  WHERE len(v) > 0),
s AS (
  SELECT r, kind, name, v[i] AS value, g[i] AS before, g[i + 1] AS after,
         CAST(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(v, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS start
  FROM m),
e AS (
  SELECT *, start + length(value) AS stop, regexp_replace(value, '[^0-9]', '', 'g') AS dig
  FROM s),
b AS (
  SELECT r, kind, name, start, stop, before, after, name || ':' || CASE WHEN kind < 2 THEN translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE dig END AS entity
  FROM e
  WHERE CASE kind WHEN 0 THEN TRUE
    WHEN 1 THEN list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) <= 255))
    WHEN 2 THEN length(dig) BETWEEN 14 AND 19 AND CAST(list_sum(list_transform(range(1, length(dig) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(substr(dig, length(dig) + 1 - i, 1) AS INTEGER)
             ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(dig, length(dig) + 1 - i, 1) AS INTEGER) + 1] END)) AS BIGINT) % 10 = 0
    ELSE length(dig) BETWEEN 10 AND 15 END),
sides AS (
  SELECT r, entity, right(before, 61) AS c, start - length(right(before, 61)) AS origin, TRUE AS head FROM b
  UNION ALL SELECT r, entity, left(after, 61), stop, FALSE FROM b),
pieces AS (
  SELECT r, entity, c, origin, head, g, v, unnest(range(1, len(v) + 1)) AS i
  FROM (SELECT *, string_split_regex(c, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS g, regexp_extract_all(c, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS v FROM sides)
  WHERE len(v) > 0),
near AS (
  SELECT r, entity, term, origin + p AS start, origin + p + length(term) AS stop
  FROM (
    SELECT *, translate(v[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term,
           CAST(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(v, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS p
    FROM pieces)
  WHERE length(c) <= 60 OR CASE WHEN head THEN p > 0 ELSE p + length(term) <= 60 END),
co AS (SELECT entity, term, count(DISTINCT r) AS co FROM near GROUP BY ALL HAVING count(DISTINCT r) >= 3),
ed AS (SELECT entity, count(DISTINCT r) AS edf FROM near GROUP BY entity),
td AS (
  SELECT term, count(*) AS df
  FROM (SELECT DISTINCT r, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
  GROUP BY term),
shown AS (
  SELECT entity, term FROM co JOIN ed USING (entity) JOIN td USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d)
  WHERE CAST(co AS DOUBLE) * CAST(co AS DOUBLE) * CAST(co AS DOUBLE) * CAST(co AS DOUBLE) * n
     >= CAST(df AS DOUBLE) * CAST(df AS DOUBLE) * CAST(df AS DOUBLE) * CAST(df AS DOUBLE) * CAST(edf AS DOUBLE)),
terms AS (
  SELECT DISTINCT r, 4 AS kind, 'term' AS name, start, stop FROM near JOIN shown USING (entity, term)
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = near.r AND b.start < near.stop AND b.stop > near.start)),
every AS (SELECT r, kind, name, start, stop FROM b UNION ALL SELECT * FROM terms),
a AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 4) AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, run, length(run) AS size, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (
  SELECT u.*, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) - 64 AS BIGINT)] END)) AS bytes
  FROM u),
h AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, crc),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b USING (i, less, size) WHERE a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
k AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN k USING (word)),
way AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN way USING (word) JOIN f e ON e.word = way.at AND e.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op8_decontamination": OP8_SQL, "op11_collocations": OP11_SQL, "op12_personal_data": OP12_SQL, "op13_spelling_variants": OP13_SQL}
