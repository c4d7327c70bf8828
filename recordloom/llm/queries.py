"""Thin queries opN_<name> over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import contamination, licenses, lines, mixing, neardup, neighbours, packing, prefixes, quality, repeats, runs, toxicity, warc
from recordloom.llm.work import materialize, new_path, spread_join

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_cascade(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_pages(_read(spark, sf_dir, "pages"), path)
    return warc.captured_pages(warc.assemble(warc.read_records(spark, path)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), relax=1.0)  # exact, at the cost of 1.1


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def _planted(doc_id: Column, text: Column) -> Column:
    """The text; for ids whose crc32 ends in 0, its words from word a on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # as an element of an array, the words are a lambda's variable and so are extracted once
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), 0)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = runs.periodic_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumns({"best": best, "n_runs": F.size("runs").cast("long")})
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    hit = contamination.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefixes.numbered_turns(_read(spark, sf_dir, "conversations")), "numbered")
    convs = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    # conversation c begins with the first h turns of conversation c - c % 20 in place of its own
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(base, "base", "left")
    taken = materialize(taken.select("conv_id", "base", F.least(h, F.coalesce("base_n", F.lit(0))).alias("taken")), "rebuilt")
    own = spread_join(turns.where(F.col("nth") >= h), taken.select("conv_id", "taken"), "conv_id", "nth", counted=turns)
    own = own.select("conv_id", (F.col("taken") + F.col("nth") - h + 1).alias("depth"), "digest", "n_words")
    heads = turns.where((F.col("conv_id") % 20 == 0) & (F.col("nth") < 3)).withColumnRenamed("conv_id", "base")
    heads = heads.join(taken, "base").where("nth < taken").select("conv_id", (F.col("nth") + 1).alias("depth"), "digest", "n_words")
    nodes, ends = prefixes.prefix_trie(materialize(own.unionByName(heads), "rebuilt-turns"), convs.select("conv_id"))
    key = ["depth", "fp", "split"]
    told = nodes.join(prefixes.ends_digests(ends), key, "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_mix_sources": op6_mix_sources,
    "op7_warc": op7_warc,
    "op8_license_scan": op8_license_scan,
    "op9_neighbours": op9_neighbours,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_contamination": op12_contamination,
    "op13_prefix_trie": op13_prefix_trie,
}

OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT byte, byte AS c, 0 AS n FROM (SELECT unnest(range(256)) AS byte)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE n = 8),
hashed AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                       lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS h
  FROM documents, crc),
worded AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM hashed),
shaped AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM worded),
docs AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1])
                    ELSE w END AS w FROM shaped),
grams AS (SELECT doc_id, pos, w[pos + 1:pos + 6] AS gram FROM (SELECT doc_id, w, unnest(range(greatest(n - 5, 0))) AS pos FROM docs)),
again AS (SELECT * FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
pairs AS (SELECT x.doc_id, x.pos, y.pos - x.pos AS period FROM again x JOIN again y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.pos < y.pos),
islands AS (
  SELECT doc_id, period, min(pos) AS start, count(*) + 5 + period AS length
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, period ORDER BY pos) AS island FROM pairs) GROUP BY doc_id, period, island),
found AS (
  SELECT doc_id, start, length, min(period) AS period FROM islands WHERE length >= 12 AND length >= 2 * period GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, max((length, -start, -period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM found GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM found),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS collapsed
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS pos FROM docs) p
  LEFT JOIN dropped d ON d.doc_id = p.doc_id AND d.pos = p.pos WHERE d.pos IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best[2])::BIGINT AS start, best[1]::BIGINT AS length, (-best[3])::BIGINT AS period,
       (1000 * best[1] // -best[3])::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM docs d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_id, false) AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS draw
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, source_size * 3 AS cap FROM sizes),
ranked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::DOUBLE AS own_level
  FROM weighed
  WINDOW below AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source IS NOT NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (
  SELECT *, max(own_level) OVER () AS level FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN least(cap::DOUBLE, level * weight) ELSE 0.0 END AS target
  FROM levelled),
plan AS (SELECT *, round_even(target, 0)::BIGINT AS words FROM targets),
weighted AS (
  SELECT d.*, length(bin(d.size))::BIGINT AS weight, p.source_size, p.target, p.words
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
classes AS (SELECT source, weight, sum(size)::BIGINT AS size, any_value(words) AS words FROM weighted GROUP BY source, weight),
levels AS (
  SELECT source, max(level) AS level FROM (
    SELECT source, (words - 3 * coalesce(sum(size) OVER heavier, 0))::DOUBLE
                   / (sum(size * weight) OVER (PARTITION BY source) - coalesce(sum(size * weight) OVER heavier, 0))::DOUBLE AS level
    FROM classes WHERE size > 0
    WINDOW heavier AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  GROUP BY source),
expected AS (
  SELECT w.*, least(3.0::DOUBLE, coalesce(l.level, 0.0::DOUBLE) * w.weight) AS copies
  FROM weighted w LEFT JOIN levels l ON w.source IS NOT DISTINCT FROM l.source),
parted AS (
  SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS share,
         words - sum(floor(copies)::BIGINT * size) OVER (PARTITION BY source) AS rest FROM expected),
ordered AS (
  SELECT *, share > 0 AND size > 0 AS drawn, coalesce(sum(size) OVER (
    PARTITION BY source, share > 0 AND size > 0
    ORDER BY CASE WHEN share > 0 AND size > 0 THEN (draw / (1 - draw)) / (share / (1 - share)) END, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM parted)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN drawn THEN greatest(0, least(size, rest - before)) ELSE 0 END)::BIGINT AS taken
FROM ordered
"""

OP1_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, words[pos:pos + 3] AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS pos FROM worded WHERE len(words) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingled x JOIN shingled y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT c.a, c.b FROM common c JOIN sized x ON x.doc_id = c.a JOIN sized y ON y.doc_id = c.b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT p.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, p.component_id, p.component_id = p.doc_id AS kept
FROM parts p LEFT JOIN sized s ON s.doc_id = p.doc_id
"""

OP2_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
windows AS (
  SELECT doc_id, pos, words[pos:pos + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM worded)),
again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT pos + step) AS n FROM again, (SELECT unnest([0, 1, 2]) AS step) GROUP BY doc_id),
full_lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, w.text, len(words)::BIGINT AS n_words,
         length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM worded w LEFT JOIN dup_lines d ON d.doc_id = w.doc_id LEFT JOIN repeats r ON r.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_dup_lines > 3 * (length(text) - length(replace(text, chr(10), '')) + 1)
            OR 10 * len(regexp_extract_all(text, '!!')) > n_words
            OR length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(text) / 2
            OR 5 * length(regexp_replace(text, '[0-9.,;:\-+/()\[\]{}=_]+', '', 'g')) < 2 * length(text)
            OR regexp_matches(text, '[^\x20\x09-\x0D]{1000}')) AS kept
FROM judged
"""

OP7_SQL = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
placed AS (SELECT *, min(page_id) OVER (PARTITION BY hexed) AS first_id FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hexed, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM placed
"""


OP9_SQL = r"""
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, s.vec_id, list_inner_product(q.v, s.v) AS score
  FROM usable q JOIN usable s ON q.vec_id % 20 = 0 AND s.vec_id <> q.vec_id AND len(s.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, w[pos + 1:pos + 10] AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS pos FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(win) AS m FROM wanted),
placed AS (
  SELECT doc_id, pos, m, w[pos + 1:pos + m] AS win
  FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS pos FROM docs, lengths WHERE len(w) >= m)),
found AS (SELECT p.doc_id, p.pos, p.m, k.item_id FROM placed p JOIN wanted k ON p.win = k.win),
hit AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS word FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN named i ON i.doc_id = d.doc_id
"""

OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT byte, byte AS c, 0 AS n FROM (SELECT unnest(range(256)) AS byte)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE n = 8),
told AS (
  SELECT conv_id, list({role: coalesce(role, ''), text: coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                                         lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 4 AS h
  FROM told, crc),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
  FROM hashed c LEFT JOIN told b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixed AS (
  SELECT conv_id, len(turns) AS n, d, turns[1:d] AS prefix
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN d > 0 THEN len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS n_words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixed GROUP BY prefix, d),
children AS (SELECT p.prefix, count(*) AS n FROM nodes c JOIN nodes p ON c.d = p.d + 1 AND c.prefix[1:p.d] = p.prefix GROUP BY p.prefix),
subtrees AS (
  SELECT v.prefix, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.n_words) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS above FROM nodes) u
  JOIN nodes v ON v.d = u.above AND v.prefix = u.prefix[1:u.above]
  LEFT JOIN children c ON c.prefix = u.prefix GROUP BY v.prefix)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes p ON p.d = v.d - 1 AND p.prefix = v.prefix[1:v.d - 1]
LEFT JOIN children c ON c.prefix = v.prefix JOIN subtrees s ON s.prefix = v.prefix
"""


def _op8_sql() -> str:
    """The SQL with the fixed tables of licences and spellings written into it."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    meant = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in sorted(licenses.SPELLINGS.items()))
    told = f"array_to_string(list_transform(string_split(spaced, ' '), lambda w: coalesce(MAP {{{meant}}}[w], w)), ' ')"
    head = r"(?im)^[ \t#/*;-]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.LICENSES.items()))
    return rf"""
WITH texts AS (
  SELECT doc_id, NULL AS license, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT NULL, license, text FROM (VALUES {known}) AS t(license, text)),
plain AS (
  SELECT doc_id, license, trim(regexp_replace(
    translate(regexp_replace(text, {quoted(head)}, ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS spaced FROM texts),
told AS (SELECT doc_id, license, sha256(trim({told})) AS digest FROM plain),
known AS (SELECT digest, min(license) AS license FROM told WHERE license IS NOT NULL GROUP BY digest)
SELECT t.doc_id, t.digest, k.license FROM told t LEFT JOIN known k ON t.digest = k.digest AND t.digest <> sha256('')
WHERE t.license IS NULL
"""


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op7_warc": OP7_SQL,
    "op8_license_scan": _op8_sql(),
    "op3_line_dedup": OP3_SQL,
    "op9_neighbours": OP9_SQL,
    "op6_mix_sources": OP6_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_contamination": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
