"""The thin queries opN_<name> over the operators of this package, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), found AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: (verdict, host, path), as the contract gives them.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS q,
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS canonical,
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\bcontent\s*=\s*["'']?\s*0*\s*;\s*url\s*=\s*[''"]?([^"''\s>]+)', 1) AS refresh
  FROM pages
), rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || q END AS node FROM p),
l AS (SELECT node, host, path, canonical AS link FROM n WHERE canonical <> '' UNION ALL SELECT node, host, path, refresh FROM n WHERE refresh <> ''),
t AS (SELECT node, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN 'http:' || link WHEN link LIKE '/%' THEN 'http://' || host || link
  WHEN link LIKE '#%' OR link LIKE '?%' THEN 'http://' || host || path || link ELSE 'http://' || host || CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || link END AS url FROM l),
e AS (SELECT node AS u, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS q FROM t),
edge AS (SELECT u, host || CASE WHEN path = '' THEN '/' ELSE path END || q AS v, host, path FROM e WHERE host <> '' AND u IS NOT NULL),
urls AS (SELECT node, host, path FROM n WHERE node IS NOT NULL UNION SELECT v, host, path FROM edge),
both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach AS (SELECT node AS a, node AS b FROM urls UNION SELECT reach.a, w.v FROM reach JOIN both_ways w ON reach.b = w.u),
said AS (SELECT node, arg_max(verdict, length(h || pre)) AS own, arg_max(h || pre, length(h || pre)) AS rule FROM urls JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, pre) GROUP BY node),
fate AS (SELECT a, bool_or(own = 'block') AND NOT bool_or(own = 'allow') AS blocked FROM reach JOIN said ON said.node = reach.b GROUP BY a)
SELECT page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, said.rule, coalesce(said.own, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN said ON n.node = said.node LEFT JOIN fate ON n.node = fate.a
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import remove_boilerplate

    found = remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos FROM s),
y AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM x),
b AS (SELECT t, min(struct_pack(d := doc_id, p := pos)) AS f FROM y WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
k AS (SELECT y.doc_id, y.pos, y.line, b.t IS NOT NULL AND NOT (b.f.d = y.doc_id AND b.f.p = y.pos) AS gone FROM y LEFT JOIN b ON y.t = b.t),
g AS (SELECT doc_id, count(*) AS n, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)
"""


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op6_sql() -> str:
    from .quality_rules import CLASS_CHARS, CLASS_LIMIT, COMMON, LEAST_WORDS, WORD_LIMIT, WORD_WORDS

    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({', '.join(map(repr, COMMON))}) THEN lang ELSE '*' END AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT tri.doc_id, unnest(range(i, i + 3)) AS k FROM tri JOIN (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1) m ON tri.doc_id = m.doc_id AND tri.g = m.g) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, length(t) AS chars, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS low, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS dig, length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) AS high,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l, coalesce(rep.n, 0) AS n_repeat_words,
    list_transform(CASE lang {lists} ELSE [] END, lambda c: len(list_filter(w, lambda x: x = c))) AS common FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
h AS (SELECT doc_id, lang, 'class' AS kind, chars AS total, chars >= {CLASS_CHARS} AS held, {CLASS_LIMIT} AS most, unnest([up, low, dig, high, n_symbols, word_chars - up - low - dig - high - n_symbols, chars - word_chars, 0]) AS v, unnest(range(8)) AS i FROM f
  UNION ALL SELECT doc_id, lang, 'word', n_words, n_words >= {WORD_WORDS} AND lang <> '*', {WORD_LIMIT}, unnest(list_append(common, n_words - coalesce(list_sum(common), 0))), unnest(range(len(common) + 1)) FROM f),
r AS (SELECT lang, kind, i, sum(v) / sum(sum(v)) OVER (PARTITION BY lang, kind) AS q FROM h GROUP BY lang, kind, i),
j AS (SELECT doc_id, kind, held, most, v / greatest(total, 1) AS p, q FROM h JOIN r USING (lang, kind, i)),
dist AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) <= most OR NOT held AS near FROM j GROUP BY doc_id, kind, held, most),
verdict AS (SELECT doc_id, bool_and(near) AS near FROM dist GROUP BY doc_id)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND near AS kept
FROM f JOIN verdict USING (doc_id)
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import fresh_dir, read_token_files, write_token_files

    docs, to = table(spark, sf_dir, "documents"), fresh_dir(spark, "token-files")
    files = write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), to)
    return read_token_files(spark, files, to, id_type=docs.schema["doc_id"].dataType.simpleString())


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import id_remainder
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 3) != 1)
    held = (id_remainder("doc_id", 3) == 1).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, id_remainder, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    held = (id_remainder("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM dw WHERE len(w) >= 35)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win SEMI JOIN rep ON win.g = rep.g),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(len(w), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""

def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP11_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
o AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM o
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import interactions

    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least_id THEN 'E' ELSE '' END AS s
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
st AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
c AS (SELECT part, filter_order, step, f, count(*) FILTER (translate(s, before || f, '') = s) AS kept, count(*) FILTER (contains(s, f) AND translate(s, before, '') = s) AS removed,
  count(*) FILTER (contains(s, f) AND translate(s, before, '') <> s) AS redundant, count(*) FILTER (s = st.f) AS unique_fails, count(*) FILTER (good AND contains(s, f) AND translate(s, before, '') = s) AS good_lost,
  count(*) FILTER (toxic AND contains(s, f) AND translate(s, before, '') = s) AS toxic_lost FROM f, st GROUP BY part, filter_order, step, st.f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack_best_fit, op2_decontaminate, op3_url_filter, op4_line_dedup, op5_near_duplicates, op6_quality_rules, op7_token_files, op8_remove_repeats, op9_toxicity, op10_quality_classifier, op11_nearest_vectors, op12_fill_in_middle, op13_filter_audit)
}
ORACLE: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_line_dedup": OP4_SQL, "op6_quality_rules": _op6_sql(), "op8_remove_repeats": OP8_SQL, "op11_nearest_vectors": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_filter_audit": OP13_SQL}
