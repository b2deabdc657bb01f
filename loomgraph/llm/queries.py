"""The registered queries of the corpus operators, with production parameters on whole tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import binrecords, common, crf, decontam, divergence, langid, linededup, minhash, mixing, periodic, pii, rpforest, sharding, tokencount


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(common.table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binrecords.round_trip(spark, common.table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), end_id=0)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(common.table(spark, sf_dir, "documents").select("doc_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = common.table(spark, sf_dir, "documents"), langid.held_out(parts=3, part=1)
    model = crf.train(docs, common.table(spark, sf_dir, "labels").where(~held))
    return crf.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.profiles(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(common.table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "n_first")


def with_loops(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the words of the rows that the contract of op12 chooses changed to repeat; rows without an id or words stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i))), " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    changed = F.get(F.transform(F.array(words), looped), F.lit(0))  # the words are cut once, not for each of them
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_loops(common.table(spark, sf_dir, "documents"))).withColumn("best", periodic.longest())
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    text = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_minhash, op4_binary_records, op5_sharding, op6_mixing, op7_quality_crf, op8_language_id, op9_personal_data, op10_vector_forest, op11_line_dedup, op12_periodic_runs, op13_source_divergence)}

ORACLE_SQL = {
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id""",
    "op5_sharding": f"""
WITH t AS (SELECT string_split('{",".join(map(str, sharding.lookup(sharding.names(sharding.SHARDS))))}', ',') AS cells)
SELECT doc_id, slot, cells[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents), t""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
o AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS pos FROM s),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM s) - (SELECT coalesce(sum(cap), 0) FROM o p WHERE p.pos < o.pos)) / ((SELECT sum(weight) FROM s) - (SELECT coalesce(sum(weight), 0) FROM o p WHERE p.pos < o.pos)) AS level FROM o),
w AS (SELECT min(pos) AS open_at, arg_min(level, pos) AS water FROM l WHERE cap > weight * level),
g AS (SELECT source, source_size, CASE WHEN l.pos < coalesce(w.open_at, 1000000000) THEN cap ELSE weight * w.water END AS target,
      ('0x' || substr(md5('loomgraph:' || coalesce('s' || source, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM l, w),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS k FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * (floor((k + 1) * rate + u) - floor(k * rate + u))::BIGINT AS taken FROM r""",
    "op10_vector_forest": r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e WHERE len(v) > 0 AND list_sum(list_transform(v, lambda y: y * y)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_dot_product(x.v, y.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = e.vec_id""",
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(struct_pack(d := doc_id, i := i)) AS lead FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256,
       count(*) FILTER (WHERE f.lead.d = k.doc_id AND f.lead.i = k.i) AS n_first
FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.doc_id""",
    "op12_periodic_runs": r"""
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
o AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents, t),
p AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM o),
d AS (SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
e AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.q < s.q AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
f AS (SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': q}, {'l': -length, 's': start, 'p': q}) AS b, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (v.n + 5 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, coalesce(y.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM x
UNION ALL
SELECT lang, source, 'term', term, (p - q)::BIGINT, rank::INTEGER FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q) WHERE rank <= 50""",
}
