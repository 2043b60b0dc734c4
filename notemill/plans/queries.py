"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.config import DEFAULTS
from notemill.functions.embedding import ngram_buckets
from notemill.functions.text import all_tags, clean_common, first_h1, frontmatter_tags, image_targets, inline_tags, normalise_markdown, snippet, text_hash
from notemill.functions.tokens import tokens
from notemill.functions.vectors import current_notes, with_unit
from notemill.operators.changes import ChangeLog, changed_paths
from notemill.operators.chunking import chunk_texts
from notemill.operators.dedup import chunk_links, chunk_links_between, evidence, exact_matches, exact_members, redundant_across, redundant_inside, redundant_ratio, related_notes, related_to
from notemill.operators.folders import classify, note_vectors, profiles, similar, suggest_tags, tag_usage, usable
from notemill.operators.index import image_referrers, index_diff, index_stats, resolve_images, scanned
from notemill.operators.pdf import clean_pages, pdf_title
from notemill.operators.vector_join import pairs_above, pairs_between, top_k
from notemill.session import materialize, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    log = ChangeLog(spark)
    log.capture(changed_paths(*(read_table(spark, d, t) for t in ("files", "notes", "index_runs"))))
    log.run()
    return log.sink().select("path", "change_kind")


SQL["p2_found"] = """
WITH runs AS (SELECT started_at, max_by(status, run_id) AS status, lead(started_at) OVER (ORDER BY started_at) AS until
  FROM index_runs WHERE started_at IS NOT NULL GROUP BY started_at),
known AS (SELECT n.path, arg_max_null(lower(n.hash), n.indexed_at) AS hash, max(n.indexed_at) AS at FROM notes n JOIN runs r
  ON n.indexed_at >= r.started_at AND (r.until IS NULL OR n.indexed_at < r.until) WHERE lower(trim(r.status)) = 'ok' GROUP BY n.path),
there AS (SELECT path, arg_max_null(lower(file_hash), modification_time) AS hash FROM files GROUP BY path)
SELECT path, CASE WHEN known.path IS NULL THEN 'added' WHEN there.path IS NULL THEN 'removed' ELSE 'updated' END AS change_kind
FROM there FULL JOIN known USING (path)
WHERE known.path IS NULL OR there.path IS NULL OR there.hash IS NULL OR known.hash IS NULL OR there.hash <> known.hash
"""


#: ---- the reference's own operators, over the notes of the vault, their chunks, and the items of the inbox

SKIP = ["_inbox", "_review"]
THRESHOLDS = DEFAULTS["thresholds"]


def notes_of(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_notes(read_table(spark, d, "notes"), *columns)


def packed_notes(spark: SparkSession, d: str) -> DataFrame:
    return with_unit(notes_of(spark, d, "text_hash", "vec"), dtype=np.float64)


def chunks_of_notes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(note, idx, columns...): each chunk once."""
    rows = read_table(spark, d, "chunks").where("note is not null and idx is not null")
    return rows.groupBy("note", "idx").agg(F.max(F.struct("chunk_id", *columns)).alias("c")).select("note", "idx", *[f"c.{c}" for c in columns])


def packed_chunks(spark: SparkSession, d: str, notes: DataFrame | None = None) -> DataFrame:
    """Chunks with a usable vector of notes with one. notes: packed_notes, if the caller has them.

    Vectors are moved and kept as they are given, half as long as packed ones, and packed when read."""
    notes = packed_notes(spark, d) if notes is None else notes
    rows = chunks_of_notes(spark, d, "tokens", "vec").where(usable(F.col("vec"), 64))
    return with_unit(materialize(rows.join(notes.select(F.col("path").alias("note")), "note"), "chunks"), dtype=np.float64)


def items_of(spark: SparkSession, d: str) -> DataFrame:
    """Each item of the inbox once, as (query, path, text_hash, vec)."""
    rows = read_table(spark, d, "incoming").groupBy(F.col("item_id").alias("query")).agg(F.max(F.struct("path", "text_hash", "vec")).alias("i"))
    return rows.select("query", "i.*")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    """Each extracted document once."""
    rows = read_table(spark, d, "extracted").where("path is not null")
    return rows.groupBy("path").agg(F.max(F.struct("text", "frontmatter", "kind", "title")).alias("e")).select("path", "e.*")


_U = "list_transform(vec::DOUBLE[], lambda x: x / sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[])))"
_USABLE = "vec IS NOT NULL AND len(vec) = 64 AND list_inner_product(vec::DOUBLE[], vec::DOUBLE[]) > 0"
_CUR = "cur AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) AS r FROM notes WHERE path IS NOT NULL) WHERE r = 1)"
_N = f"{_CUR}, n AS (SELECT path, lower(text_hash) AS text_hash, {_U} AS u FROM cur WHERE {_USABLE})"
_C = f"c0 AS (SELECT DISTINCT ON (note, idx) note, idx, tokens, text, vec FROM chunks WHERE note IS NOT NULL AND idx IS NOT NULL ORDER BY note, idx, chunk_id DESC), c AS (SELECT note, idx, tokens, text, {_U} AS u FROM c0 WHERE {_USABLE} AND note IN (SELECT path FROM n))"
_I = "i0 AS (SELECT DISTINCT ON (item_id) item_id AS query, path, text_hash, vec FROM incoming ORDER BY item_id, path DESC)"
_I_U = f"{_I}, i AS (SELECT query, path, {_U} AS u FROM i0 WHERE {_USABLE})"
_LINKS = "links AS (SELECT x.note AS note_a, x.idx AS i, y.note AS note_b, y.idx AS j, round(list_inner_product(x.u, y.u), 9) AS s FROM c x JOIN c y ON (x.note, x.idx) < (y.note, y.idx) AND list_inner_product(x.u, y.u) >= 0.92)"
_D = "d AS (SELECT DISTINCT ON (path) * FROM extracted WHERE path IS NOT NULL ORDER BY path, text DESC)"
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    queries = items_of(spark, d).where("query % 50 = 0")
    return similar(queries, notes_of(spark, d, "vec"), chunks_of_notes(spark, d, "vec"), k=10)


SQL["similar_items"] = f"""
WITH {_N}, c0 AS (SELECT DISTINCT ON (note, idx) note, idx, vec FROM chunks WHERE note IS NOT NULL AND idx IS NOT NULL ORDER BY note, idx, chunk_id DESC),
c AS (SELECT note, idx, {_U} AS u FROM c0 WHERE {_USABLE}), {_I_U}, q AS (SELECT * FROM i WHERE query % 50 = 0),
s AS (SELECT query, q.u, n.path, round(list_inner_product(q.u, n.u), 9) AS s FROM q JOIN n ON n.path IS DISTINCT FROM q.path),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, path) AS rank FROM s QUALIFY rank <= 10),
b AS (SELECT t.query, t.path, idx, round(list_inner_product(t.u, c.u), 9) AS cs FROM t JOIN c ON c.note = t.path WHERE t.s >= 0),
best AS (SELECT query, path, idx, cs FROM b QUALIFY row_number() OVER (PARTITION BY query, path ORDER BY cs DESC, idx) = 1)
SELECT t.query, t.path, round(t.s, 4) AS score, t.rank, best.idx AS chunk, round(cs, 4) AS chunk_score FROM t LEFT JOIN best USING (query, path) WHERE t.s >= 0
"""


@query
def note_vector_sums(spark: SparkSession, d: str) -> DataFrame:
    v = note_vectors(chunks_of_notes(spark, d, "tokens", "vec"))
    return v.select("note", *[F.round(F.col("vec")[i], 6).alias(f"v{i}") for i in range(64)])


SQL["note_vector_sums"] = f"""
WITH c0 AS (SELECT DISTINCT ON (note, idx) note, idx, tokens, vec FROM chunks WHERE note IS NOT NULL AND idx IS NOT NULL ORDER BY note, idx, chunk_id DESC),
c AS (SELECT note, greatest(coalesce(tokens, 1), 1) AS w, {_U} AS u FROM c0 WHERE {_USABLE}),
e AS (SELECT note, unnest(range(64)) AS i, unnest(list_transform(u, lambda x: x * w)) AS x FROM c),
s AS (SELECT note, i, sum(x) AS x FROM e GROUP BY note, i),
z AS (SELECT note, sqrt(sum(x * x)) AS z FROM s GROUP BY note)
SELECT note, {", ".join(f"round(max(x / z) FILTER (i = {i}), 6) AS v{i}" for i in range(64))} FROM s JOIN z USING (note) GROUP BY note
"""


@query
def hashed_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Size and length of each document's hashed n-gram vector."""
    hit = ngram_buckets(read_table(spark, d, "documents"), "doc_id", "text")
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("grams"), F.round(F.sqrt(F.sum(F.col("n") * F.col("n"))), 6).alias("length"))


SQL["hashed_ngrams"] = f"""
WITH t AS (SELECT doc_id, regexp_replace(lower(text), '{_WS}+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, md5(unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))))) AS m FROM t),
b AS (SELECT doc_id, (('0x' || m[1:2])::INT + 256 * ('0x' || m[3:4])::INT) % 1024 AS bucket, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS buckets, sum(n)::BIGINT AS grams, round(sqrt(sum(n * n)), 6) AS length FROM b GROUP BY doc_id
"""


@query
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", text_hash(F.col("text")).alias("text_hash"))


SQL["text_hashes"] = f"SELECT doc_id, sha1(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS text_hash FROM documents WHERE text IS NOT NULL"


@query
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return exact_members(notes_of(spark, d, "text_hash"))


SQL["exact_duplicates"] = f"""
WITH {_CUR}, h AS (SELECT path, lower(text_hash) AS text_hash FROM cur WHERE text_hash IS NOT NULL)
SELECT text_hash, path, min(path) OVER (PARTITION BY text_hash) AS first FROM h QUALIFY count(*) OVER (PARTITION BY text_hash) > 1
"""


@query
def exact_items(spark: SparkSession, d: str) -> DataFrame:
    docs = items_of(spark, d).select(F.col("query").alias("doc"), "path", F.col("text_hash"), F.lit(None).cast("string").alias("file_hash"))
    return exact_matches(docs, notes_of(spark, d, "hash", "text_hash"))


SQL["exact_items"] = f"""
WITH {_CUR}, {_I} SELECT DISTINCT query AS doc, cur.path AS target FROM i0 JOIN cur ON lower(i0.text_hash) = lower(cur.text_hash) WHERE i0.path IS DISTINCT FROM cur.path
"""


def _related(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    notes = materialize(packed_notes(spark, d), "notes")
    chunks = packed_chunks(spark, d, notes)
    links = materialize(chunk_links(chunks, THRESHOLDS["chunk_match"], 64), "links")
    return related_notes(notes, chunks, links, THRESHOLDS), chunks, links


@query
def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d)[0]


_PAIRS = f"""{_N}, {_C}, {_LINKS},
x AS (SELECT least(note_a, note_b) AS a, greatest(note_a, note_b) AS b, CASE WHEN note_a < note_b THEN i ELSE j END AS i, CASE WHEN note_a < note_b THEN j ELSE i END AS j FROM links WHERE note_a <> note_b),
m AS (SELECT a, b, count(DISTINCT i) AS n_i, count(DISTINCT j) AS n_j FROM x GROUP BY a, b),
near AS (SELECT p.path AS a, q.path AS b FROM n p JOIN n q ON p.path < q.path AND round(list_inner_product(p.u, q.u), 9) >= 0.85),
cand AS (SELECT a, b FROM m UNION SELECT a, b FROM near),
k AS (SELECT note, count(*) AS n FROM c GROUP BY note),
r AS (SELECT cand.a, cand.b, round(list_inner_product(p.u, q.u), 9) AS s, coalesce(n_i / ka.n, 0) AS x, coalesce(n_j / kb.n, 0) AS y
  FROM cand LEFT JOIN m ON m.a = cand.a AND m.b = cand.b JOIN n p ON p.path = cand.a JOIN n q ON q.path = cand.b JOIN k ka ON ka.note = cand.a LEFT JOIN k kb ON kb.note = cand.b
  WHERE p.text_hash IS NULL OR q.text_hash IS NULL OR p.text_hash <> q.text_hash),
kinds AS (SELECT a, b, CASE WHEN s >= 0.95 THEN 'duplicate' WHEN x >= 0.8 AND y < 0.8 THEN 'contained_in' WHEN y >= 0.8 AND x < 0.8 THEN 'contains' WHEN x >= 0.8 AND y >= 0.8 THEN 'duplicate' WHEN s >= 0.85 THEN 'near_duplicate' END AS kind,
  round(s, 4) + 0.0::DOUBLE AS score, round(x, 4) AS a_in_b, round(y, 4) AS b_in_a FROM r),
pairs AS (SELECT * FROM kinds WHERE kind IS NOT NULL)"""
SQL["dedup_pairs"] = f"WITH {_PAIRS} SELECT * FROM pairs"


@query
def dedup_evidence(spark: SparkSession, d: str) -> DataFrame:
    pairs, chunks, _ = _related(spark, d)
    return evidence(pairs, chunks)


SQL["dedup_evidence"] = f"""WITH {_PAIRS},
cells AS (SELECT a, b, p.idx AS i, q.idx AS j, round(list_inner_product(p.u, q.u), 9) AS s FROM pairs JOIN c p ON p.note = a JOIN c q ON q.note = b),
nine AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, i, j) AS r FROM cells QUALIFY r <= 9),
one AS (SELECT * FROM nine QUALIFY row_number() OVER (PARTITION BY a, b, i ORDER BY r) = 1)
SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY r) AS rank, i, j, round(s, 4) AS score FROM one QUALIFY rank <= 3"""


@query
def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs there are of each kind, and how many groups of equal texts."""
    pairs = _related(spark, d)[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    groups = exact_members(notes_of(spark, d, "text_hash")).select("text_hash").distinct().agg(F.lit("exact").alias("kind"), F.count(F.lit(1)).alias("n"))
    return pairs.unionByName(groups)


SQL["dedup_counts"] = f"""WITH {_PAIRS}, h AS (SELECT lower(text_hash) AS h FROM cur WHERE text_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT kind, count(*) AS n FROM pairs GROUP BY kind UNION ALL SELECT 'exact', count(*) FROM h"""


@query
def redundant_internal(spark: SparkSession, d: str) -> DataFrame:
    return redundant_inside(chunk_links(packed_chunks(spark, d), THRESHOLDS["chunk_match"], 64))


SQL["redundant_internal"] = f"WITH {_N}, {_C}, {_LINKS} SELECT note_a AS note, i AS chunk, j AS duplicate_of_chunk, round(s, 4) AS score FROM links WHERE note_a = note_b"


@query
def redundant_cross(spark: SparkSession, d: str) -> DataFrame:
    return redundant_across(chunk_links(packed_chunks(spark, d), THRESHOLDS["chunk_match"], 64))


_CROSS = """inner_ AS (SELECT note_a AS note, i AS chunk, j, s FROM links WHERE note_a = note_b),
both_ AS (SELECT note_a AS note, i AS chunk, s, note_b AS found_in, j AS found_chunk FROM links WHERE note_a <> note_b UNION ALL SELECT note_b, j, s, note_a, i FROM links WHERE note_a <> note_b),
cross_ AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY note, chunk ORDER BY s DESC, found_in, found_chunk) = 1)"""
SQL["redundant_cross"] = f"WITH {_N}, {_C}, {_LINKS}, {_CROSS} SELECT note, chunk, round(s, 4) AS score, found_in, found_chunk FROM cross_"


@query
def redundant_ratios(spark: SparkSession, d: str) -> DataFrame:
    chunks = packed_chunks(spark, d)
    links = materialize(chunk_links(chunks, THRESHOLDS["chunk_match"], 64), "links")
    return redundant_ratio(chunks, redundant_inside(links), redundant_across(links))


SQL["redundant_ratios"] = f"""WITH {_N}, {_C}, {_LINKS}, {_CROSS},
hit AS (SELECT note, chunk AS idx FROM inner_ UNION SELECT note, chunk FROM cross_),
per AS (SELECT c.note, count(*) AS chunks, sum(greatest(coalesce(tokens, 0), 0)) AS t, sum(CASE WHEN hit.idx IS NULL THEN 0 ELSE greatest(coalesce(tokens, 0), 0) END) AS r FROM c LEFT JOIN hit ON hit.note = c.note AND hit.idx = c.idx GROUP BY c.note)
SELECT note, chunks, (SELECT count(*) FROM inner_ x WHERE x.note = per.note) AS internal, (SELECT count(*) FROM cross_ x WHERE x.note = per.note) AS cross_vault, round(r / greatest(t, 1), 4) AS redundant_ratio FROM per"""


@query
def classify_items(spark: SparkSession, d: str) -> DataFrame:
    return classify(items_of(spark, d).select("query", "path", "vec"), notes_of(spark, d, "folder", "vec"), read_table(spark, d, "folder_desc"), SKIP)


def _ngram_sql(source: str, key: str) -> str:
    """CTEs from source (key, t) to ngram (key, x: its unit vector of 64 elements)."""
    return f"""ng0 AS (SELECT {key}, regexp_replace(lower(t), '{_WS}+', '', 'g') AS t FROM {source}),
ng1 AS (SELECT {key}, md5(unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))))) AS m FROM ng0),
ng2 AS (SELECT {key}, (('0x' || m[1:2])::INT + 256 * ('0x' || m[3:4])::INT) % 64 AS bucket, count(*) AS n FROM ng1 GROUP BY ALL),
ng3 AS (SELECT {key}, map_from_entries(list((bucket, n::DOUBLE))) AS h, sqrt(sum(n * n)) AS z FROM ng2 GROUP BY {key}),
ngram AS (SELECT ng0.{key}, list_transform(range(64), lambda i: coalesce(h[i::INT], 0) / coalesce(z, 1)) AS x FROM ng0 LEFT JOIN ng3 USING ({key}))"""


_SUM = "SELECT {by}, list(s ORDER BY i) AS total, any_value(n) AS n FROM (SELECT {by}, i, sum(x) AS s, count(*) AS n FROM (SELECT {by}, unnest(range(64)) AS i, unnest(u) AS x FROM {source}) GROUP BY {by}, i) GROUP BY {by}"
_UNIT_OF = "list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
_CENTROIDS = f"""f AS (SELECT folder, {_U} AS u FROM cur WHERE {_USABLE} AND folder <> '' AND split_part(folder, '/', 1) NOT IN ('_inbox', '_review')),
fs AS ({_SUM.format(by="folder", source="f")}),
fd AS (SELECT folder, max(coalesce(description, '')) AS description FROM folder_desc WHERE folder IS NOT NULL GROUP BY folder),
fa AS (SELECT coalesce(fs.folder, fd.folder) AS folder, coalesce(n, 0) AS n, total, description FROM fs FULL JOIN fd ON fs.folder = fd.folder),
fw AS (SELECT folder, trim(replace(folder, '/', ' / ') || ': ' || coalesce(description, ''), ': ') AS t FROM fa WHERE n < 3),
{_ngram_sql("fw", "folder")},
fv AS (SELECT fa.folder, n, CASE WHEN total IS NULL THEN x WHEN x IS NULL THEN {_UNIT_OF.format(v="total")} ELSE list_transform(list_zip({_UNIT_OF.format(v="total")}, x), lambda p: p[1] + p[2]) END AS v FROM fa LEFT JOIN ngram USING (folder)),
cent AS (SELECT folder, n, {_UNIT_OF.format(v="v")} AS u FROM fv)"""
SQL["classify_items"] = f"""WITH {_CUR}, {_I_U}, {_CENTROIDS},
s AS (SELECT query, folder, n, round(list_inner_product(i.u, cent.u), 9) AS s FROM i, cent),
t AS (SELECT *, row_number() OVER w AS rank, lead(s) OVER w AS next FROM s WINDOW w AS (PARTITION BY query ORDER BY s DESC, folder)),
g AS (SELECT query, round(s, 4) AS top, coalesce(s - next, 1.0) AS gap FROM t WHERE rank = 1)
SELECT query, folder, round(s, 4) AS score, n AS notes, rank, round(gap, 4) AS margin, NOT (top < 0.55 OR gap < 0.03) AS confident, CASE WHEN top < 0.55 THEN 'low_score' WHEN gap < 0.03 THEN 'ambiguous' END AS reason FROM t JOIN g USING (query) WHERE rank <= 3"""


@query
def tag_users(spark: SparkSession, d: str) -> DataFrame:
    return tag_usage(notes_of(spark, d, "tags_json"))


_TAGS = "tg AS (SELECT path, vec, unnest(list_distinct(list_filter(CASE WHEN json_valid(tags_json) AND json_type(tags_json) = 'ARRAY' THEN from_json(tags_json, '[\"VARCHAR\"]') ELSE []::VARCHAR[] END, lambda t: t IS NOT NULL AND t <> ''))) AS tag FROM cur)"
SQL["tag_users"] = f"WITH {_CUR}, {_TAGS} SELECT tag, count(*) AS users FROM tg GROUP BY tag"


@query
def tag_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return suggest_tags(items_of(spark, d).select("query", "vec"), notes_of(spark, d, "tags_json", "vec"), read_table(spark, d, "tag_list"), least=0.3)


SQL["tag_suggestions"] = f"""WITH {_CUR}, {_I_U}, {_TAGS},
tl AS (SELECT regexp_replace(tag, '^#+', '') AS tag, max(coalesce(description, '')) AS description FROM tag_list WHERE tag IS NOT NULL GROUP BY 1),
tt AS (SELECT tag, CASE WHEN description <> '' THEN tag || ': ' || description ELSE tag END AS t FROM tl),
{_ngram_sql("tt", "tag")},
tu AS (SELECT tag, {_U} AS u FROM tg WHERE {_USABLE} AND tag IN (SELECT tag FROM tl)),
ts AS ({_SUM.format(by="tag", source="tu")}),
base AS (SELECT tag, 'description' AS source, x AS u FROM ngram UNION ALL SELECT tag, 'usage', {_UNIT_OF.format(v="total")} FROM ts WHERE n >= 3),
s AS (SELECT query, tag, source, round(list_inner_product(i.u, base.u), 9) AS s FROM i, base QUALIFY row_number() OVER (PARTITION BY query, tag ORDER BY round(list_inner_product(i.u, base.u), 9) DESC, source) = 1)
SELECT query, tag, round(s, 4) AS score, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, tag) AS rank FROM s) WHERE rank <= 5 AND s >= 0.3"""


@query
def folder_profiles(spark: SparkSession, d: str) -> DataFrame:
    notes = notes_of(spark, d, "title", "folder", "tags_json", "vec").withColumn("label", F.split("folder", "/")[0])
    return profiles(notes.where("label is not null")).select("label", "size", "cohesion", *[F.array_join(c, " | ").alias(c) for c in ("representative", "common_tags", "folders")])


_TOP = "SELECT label, string_agg(x, ' | ' ORDER BY r) AS {name} FROM (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY {order}) AS r FROM {source}) WHERE r <= {n} GROUP BY label"
SQL["folder_profiles"] = f"""WITH {_CUR},
l AS (SELECT split_part(folder, '/', 1) AS label, path, title, folder, tags_json, vec, {_U} AS u FROM cur WHERE folder IS NOT NULL AND {_USABLE}),
sm AS (SELECT * FROM ({_SUM.format(by="label", source="l")}) WHERE n >= 3),
nr AS (SELECT l.*, round(list_inner_product(u, {_UNIT_OF.format(v="total")}), 9) AS s FROM l JOIN sm USING (label)),
tg AS (SELECT label, unnest(list_distinct(list_filter(CASE WHEN json_valid(tags_json) AND json_type(tags_json) = 'ARRAY' THEN from_json(tags_json, '["VARCHAR"]') ELSE []::VARCHAR[] END, lambda t: t IS NOT NULL AND t <> ''))) AS x FROM nr),
tc AS (SELECT label, x, count(*) AS k FROM tg GROUP BY ALL), fc AS (SELECT label, CASE WHEN folder = '' THEN '(root)' ELSE folder END AS x, count(*) AS k FROM nr GROUP BY ALL),
ti AS (SELECT label, coalesce(nullif(title, ''), path) AS x, s, path FROM nr),
a AS ({_TOP.format(name="representative", order="s DESC, path", source="ti", n=5)}), b AS ({_TOP.format(name="common_tags", order="k DESC, x", source="tc", n=5)}), e AS ({_TOP.format(name="folders", order="k DESC, x", source="fc", n=3)})
SELECT label, count(*) AS size, round(avg(s), 4) AS cohesion, any_value(representative) AS representative, any_value(common_tags) AS common_tags, any_value(folders) AS folders
FROM nr LEFT JOIN a USING (label) LEFT JOIN b USING (label) LEFT JOIN e USING (label) GROUP BY label"""


@query
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return docs_of(spark, d).where("text is not null").select("path", F.md5(clean_common(F.col("text")).cast("binary")).alias("digest"))


SQL["clean_texts"] = rf"""WITH {_D}, t AS (SELECT path, regexp_replace(replace(translate(regexp_replace(text, '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), chr(160) || chr(12288), '  '), chr(13) || chr(10), chr(10)), '\r', chr(10), 'g') AS t FROM d WHERE text IS NOT NULL),
u AS (SELECT path, regexp_replace(t, '[\t\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1f}} \x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}]+(\n|$)', '\1', 'g') AS t FROM t),
v AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+', ''), '{_WS}+$', '') AS t FROM u)
SELECT path, md5(CASE WHEN t = '' THEN '' ELSE t || chr(10) END) AS digest FROM v"""


@query
def markdown_texts(spark: SparkSession, d: str) -> DataFrame:
    """Notes' bodies with comments, embeds, images and links made plain; tags and first heading beside."""
    t = F.col("text")
    rows = docs_of(spark, d).where("text is not null")
    return rows.select("path", clean_common(normalise_markdown(t)).alias("text"), F.array_join(all_tags(F.col("frontmatter"), t), " ").alias("tags"), first_h1(t).alias("h1"), F.size(image_targets(t)).alias("images"))


@query
def first_headings(spark: SparkSession, d: str) -> DataFrame:
    return docs_of(spark, d).where("text is not null").select("path", first_h1(F.col("text")).alias("h1"))


_NO_FENCE = r"regexp_replace(regexp_replace(text, '(?ms)^```.*?^```[^\n]*$', chr(1), 'g'), '(?ms)^~~~.*?^~~~[^\n]*$', chr(1), 'g')"
SQL["first_headings"] = rf"WITH {_D} SELECT path, nullif(regexp_extract({_NO_FENCE}, '(?m)^#{_WS}+(.+?){_WS}*#*{_WS}*$', 1), '') AS h1 FROM d WHERE text IS NOT NULL"


@query
def inline_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    tags = docs_of(spark, d).select(F.explode_outer(inline_tags(F.col("text"))).alias("tag")).where("tag is not null")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


SQL["inline_tag_counts"] = rf"""WITH {_D},
t AS (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace({_NO_FENCE}, '`[^`\n]*`', ' ', 'g'), '(?m)^[^\S\n]{{0,3}}#{{1,6}}[^\S\n]', '', 'g'), '(?:^|[^\p{{L}}\p{{N}}_/#&])#([\p{{L}}\p{{N}}_\-/]*[\p{{L}}_][\p{{L}}\p{{N}}_\-/]*)', 1)) AS tag FROM d WHERE text IS NOT NULL)
SELECT tag, count(*) AS n FROM t GROUP BY tag"""


@query
def frontmatter_tag_lists(spark: SparkSession, d: str) -> DataFrame:
    return docs_of(spark, d).where("frontmatter is not null").select("path", F.array_join(frontmatter_tags(F.col("frontmatter")), "|").alias("tags"))


@query
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of_notes(spark, d, "text").where("text is not null").select("note", "idx", snippet(F.col("text")).alias("snippet"))


SQL["snippets"] = f"""WITH c0 AS (SELECT DISTINCT ON (note, idx) note, idx, text FROM chunks WHERE note IS NOT NULL AND idx IS NOT NULL ORDER BY note, idx, chunk_id DESC),
s AS (SELECT note, idx, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS s FROM c0 WHERE text IS NOT NULL)
SELECT note, idx, CASE WHEN length(s) <= 160 THEN s ELSE left(s, 159) || '…' END AS snippet FROM s"""


@query
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", tokens(F.col("text")).alias("tokens"))


SQL["token_estimates"] = rf"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{ac00}}-\x{{d7af}}]')) AS cjk,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: greatest(78, 13 * length(w)))), 0) AS words,
  regexp_replace(text, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{ac00}}-\x{{d7af}}A-Za-z0-9_]+', '', 'g') AS rest
  FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, length(rest) AS r, length(regexp_replace(rest, '[\p{{L}}\p{{N}}]+', '', 'g')) AS s FROM n)
SELECT doc_id, ((60 * cjk + words + 78 * (r - s) + 30 * s + 59)::BIGINT // 60)::INT AS tokens FROM m"""


@query
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_texts(docs_of(spark, d))


@query
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of kind pdf, a paragraph as a page, without running lines and page numbers, wrapped lines joined."""
    docs = docs_of(spark, d).where("kind = 'pdf' and text is not null").select("path", F.split("text", "\n\n").alias("pages"))
    return clean_pages(docs)


@query
def scan(spark: SparkSession, d: str) -> DataFrame:
    return scanned(read_table(spark, d, "files"), DEFAULTS["exclude"] + [DEFAULTS["inbox"]], DEFAULTS["extensions"], DEFAULTS["image_extensions"])


SQL["scan"] = r"""
WITH f AS (SELECT DISTINCT path, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext FROM files WHERE path IS NOT NULL AND NOT list_has_any(string_split(path, '/'), ['.obsidian', '.trash', '.claude', '.agents', '_review', 'templates', '_inbox']))
SELECT path, CASE WHEN ext IN ('.md', '.pdf', '.txt') THEN 'document' ELSE 'image' END AS role FROM f WHERE ext IN ('.md', '.pdf', '.txt', '.png', '.jpg', '.jpeg', '.webp', '.gif', '.bmp')"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    files = read_table(spark, d, "files").where("path is not null").groupBy("path").agg(F.max(F.struct("modification_time", "file_hash")).alias("f"))
    files = files.select("path", (F.unix_micros("f.modification_time") / 1e6).alias("mtime"), F.col("f.file_hash").alias("hash"))
    return index_diff(files, notes_of(spark, d, "mtime", "hash"))


@query
def diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


_DIFF = f"""{_CUR}, f AS (SELECT DISTINCT ON (path) path, epoch_us(modification_time) / 1e6 AS mtime, lower(file_hash) AS hash FROM files WHERE path IS NOT NULL ORDER BY path, modification_time DESC NULLS LAST, file_hash DESC NULLS LAST),
df AS (SELECT coalesce(f.path, cur.path) AS path, CASE WHEN cur.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed' WHEN f.mtime = cur.mtime THEN 'unchanged' WHEN f.hash = lower(cur.hash) THEN 'touched' ELSE 'updated' END AS change FROM f FULL JOIN cur ON f.path = cur.path)"""
SQL["diff"] = f"WITH {_DIFF} SELECT * FROM df"


@query
def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    return index_stats(_diff(spark, d))


SQL["diff_stats"] = f"""WITH {_DIFF} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change IN ('unchanged', 'touched')) AS unchanged,
count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change <> 'removed') AS notes_total FROM df"""


@query
def image_references(spark: SparkSession, d: str) -> DataFrame:
    return image_referrers(read_table(spark, d, "extracted")).select("image", F.array_join("referenced_by", " | ").alias("referenced_by"))


SQL["image_references"] = """
WITH r AS (SELECT path, unnest(images) AS i FROM extracted), s AS (SELECT DISTINCT path, coalesce(i.path, i.name) AS image FROM r)
SELECT image, string_agg(path, ' | ' ORDER BY path) AS referenced_by FROM s WHERE image IS NOT NULL GROUP BY image"""


@query
def image_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of image vectors (the table of embeddings) above a threshold, exact ones told apart by equal bytes."""
    rows = with_unit(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec")), dtype=np.float64)
    found = pairs_above(rows, 0.45)
    return found.select("a", "b", F.round("cosine", 4).alias("score"))


SQL["image_pairs"] = """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, round(round(list_inner_product(x.u, y.u), 9), 4) AS score FROM e x JOIN e y ON x.vec_id < y.vec_id AND round(list_inner_product(x.u, y.u), 9) >= 0.45"""


@query
def similar_images(spark: SparkSession, d: str) -> DataFrame:
    """For image vectors (the table of embeddings) whose number is divisible by 50 the ten nearest of all."""
    rows = with_unit(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec")), dtype=np.float64)
    found = top_k(rows.where("key % 50 = 0").withColumnRenamed("key", "query"), rows, 10)
    return found.select("query", F.col("key").alias("image"), F.round("score", 4).alias("score"), "rank")


_E = "e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"
SQL["similar_images"] = f"""WITH {_E}, s AS (SELECT x.vec_id AS query, y.vec_id AS image, round(list_inner_product(x.u, y.u), 9) AS s FROM e x JOIN e y ON x.vec_id % 50 = 0)
SELECT query, image, round(s, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, image) AS rank FROM s QUALIFY rank <= 10"""


@query
def doc_image_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Image vectors of one set (embeddings with a label below 5) that one of another set is like; neither set is held against itself."""
    rows = with_unit(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("vec")), dtype=np.float64)
    return pairs_between(rows.where("label < 5").select("key", "u"), rows.where("label >= 5").select("key", "u"), 0.40).select("left", "right", F.round("cosine", 4).alias("score"))


SQL["doc_image_pairs"] = f"""WITH {_E} SELECT x.vec_id AS "left", y.vec_id AS "right", round(round(list_inner_product(x.u, y.u), 9), 4) AS score
FROM e x JOIN e y ON x.label < 5 AND y.label >= 5 AND round(list_inner_product(x.u, y.u), 9) >= 0.40"""


@query
def alike_exactly(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of embeddings above a cosine too low for bands: compared in blocks."""
    rows = with_unit(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec")), dtype=np.float64)
    return pairs_above(rows, 0.2).select("a", "b", F.round("cosine", 4).alias("score"))


SQL["alike_exactly"] = f"""WITH {_E} SELECT x.vec_id AS a, y.vec_id AS b, round(round(list_inner_product(x.u, y.u), 9), 4) AS score
FROM e x JOIN e y ON x.vec_id < y.vec_id AND round(list_inner_product(x.u, y.u), 9) >= 0.2"""


def _item_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items of the inbox as documents (path, text_hash, u) of one chunk each (note, idx, u)."""
    rows = materialize(with_unit(items_of(spark, d).select(F.col("query").cast("string").alias("path"), "text_hash", "vec"), dtype=np.float64), "items")
    return rows, rows.select(F.col("path").alias("note"), F.lit(0).alias("idx"), F.lit(1).alias("tokens"), "u")


@query
def dedup_docs(spark: SparkSession, d: str) -> DataFrame:
    """Items of the inbox against the notes and their chunks, all at once."""
    docs, mine = _item_chunks(spark, d)
    notes = materialize(packed_notes(spark, d), "notes")
    chunks = packed_chunks(spark, d, notes)
    links = materialize(chunk_links_between(mine, chunks, THRESHOLDS["chunk_match"], 64), "links")
    return related_to(docs, mine, notes, chunks, links, THRESHOLDS).withColumnRenamed("a", "doc").withColumnRenamed("b", "target")


_ITEM = f"{_I}, i AS (SELECT query::VARCHAR AS doc, path, lower(text_hash) AS text_hash, {_U} AS u FROM i0 WHERE {_USABLE})"
_ITEM_LINKS = "il AS (SELECT i.doc, c.note, c.idx, round(list_inner_product(i.u, c.u), 9) AS s FROM i JOIN c ON round(list_inner_product(i.u, c.u), 9) >= 0.92)"
SQL["dedup_docs"] = f"""WITH {_N}, {_C}, {_ITEM}, {_ITEM_LINKS},
m AS (SELECT doc, note, count(DISTINCT idx) AS n_j FROM il GROUP BY doc, note),
near AS (SELECT i.doc, n.path AS note FROM i JOIN n ON round(list_inner_product(i.u, n.u), 9) >= 0.85),
cand AS (SELECT doc, note FROM m UNION SELECT doc, note FROM near),
k AS (SELECT note, count(*) AS n FROM c GROUP BY note),
r AS (SELECT cand.doc, cand.note, round(list_inner_product(i.u, n.u), 9) AS s, CASE WHEN n_j IS NULL THEN 0.0 ELSE 1.0 END AS x, coalesce(n_j / k.n, 0) AS y
  FROM cand LEFT JOIN m ON m.doc = cand.doc AND m.note = cand.note JOIN i ON i.doc = cand.doc JOIN n ON n.path = cand.note LEFT JOIN k ON k.note = cand.note WHERE i.text_hash IS NULL OR n.text_hash IS NULL OR i.text_hash <> n.text_hash),
kinds AS (SELECT doc, note AS target, CASE WHEN s >= 0.95 THEN 'duplicate' WHEN x >= 0.8 AND y < 0.8 THEN 'contained_in' WHEN y >= 0.8 AND x < 0.8 THEN 'contains' WHEN x >= 0.8 AND y >= 0.8 THEN 'duplicate' WHEN s >= 0.85 THEN 'near_duplicate' END AS kind,
  round(s, 4) AS score, round(x, 4) AS a_in_b, round(y, 4) AS b_in_a FROM r)
SELECT * FROM kinds WHERE kind IS NOT NULL"""


@query
def doc_redundancy(spark: SparkSession, d: str) -> DataFrame:
    """For each item of the inbox the best matching chunk of another note than its own, from a cosine of 0.6."""
    _, mine = _item_chunks(spark, d)
    links = chunk_links_between(mine, packed_chunks(spark, d), 0.6, 64)
    own = items_of(spark, d).select(F.col("query").cast("string").alias("doc"), F.col("path").alias("own"))
    best = links.join(own, "doc").where("not (note <=> own)").groupBy("doc").agg(F.min(F.struct((-F.col("cosine")).alias("s"), "note", "j")).alias("m"))
    return best.select("doc", F.round(-F.col("m.s"), 4).alias("score"), F.col("m.note").alias("found_in"), F.col("m.j").alias("found_chunk"))


SQL["doc_redundancy"] = f"""WITH {_N}, {_C}, {_ITEM}, {_ITEM_LINKS.replace("0.92", "0.6")}
SELECT doc, round(s, 4) AS score, note AS found_in, idx AS found_chunk FROM il JOIN i USING (doc) WHERE note IS DISTINCT FROM i.path QUALIFY row_number() OVER (PARTITION BY doc ORDER BY s DESC, note, idx) = 1"""


@query
def resolved_images(spark: SparkSession, d: str) -> DataFrame:
    """Where the images that notes show are, among all names and paths of images that are known."""
    images = read_table(spark, d, "extracted").where("path is not null").select(F.col("path").alias("note"), F.explode("images").alias("i"))
    names = images.where("i.name is not null").select("note", "i.name").distinct()
    return resolve_images(names, images.select(F.coalesce("i.path", F.concat(F.lit("attachments/"), "i.name")).alias("path")).distinct())


SQL["resolved_images"] = r"""WITH i0 AS (SELECT path AS note, unnest(images) AS i FROM extracted WHERE path IS NOT NULL),
f AS (SELECT DISTINCT coalesce(i.path, 'attachments/' || i.name) AS path FROM i0), g AS (SELECT path FROM f WHERE regexp_matches(lower(path), '\.(png|jpg|jpeg|webp|gif|bmp|svg)$')),
r AS (SELECT DISTINCT note, i.name AS name FROM i0 WHERE i.name IS NOT NULL AND NOT regexp_matches(i.name, '(?i)^[a-z]+://')),
w AS (SELECT *, regexp_extract(note, '^(.*/)[^/]*$', 1) || url_decode(trim(name)) AS near, url_decode(trim(name)) AS want, regexp_extract(url_decode(trim(name)), '([^/]*)$', 1) AS base FROM r),
b AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS base, min(path) AS path FROM g GROUP BY 1)
SELECT note, name, coalesce(n.path, h.path, b.path) AS path FROM w LEFT JOIN g n ON n.path = near LEFT JOIN g h ON h.path = want LEFT JOIN b ON b.base = w.base"""


@query
def paged_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles by the rules for PDFs: of each document, with its title as that of the file."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return docs_of(spark, d).where("text is not null").select("path", pdf_title(F.col("title"), F.lit(""), F.col("text"), name).alias("title"))


SQL["paged_titles"] = rf"""WITH {_D}, t AS (SELECT path, text, regexp_replace(regexp_replace(coalesce(title, ''), '^{_WS}+', ''), '{_WS}+$', '') AS own,
  regexp_replace(regexp_replace(regexp_extract(text, '(?:^|
)([^
]*\S[^
]*)', 1), '^{_WS}+', ''), '{_WS}+$', '') AS line, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM d WHERE text IS NOT NULL)
SELECT path, CASE WHEN own <> '' AND NOT regexp_matches(own, '(?i)^(untitled|microsoft (word|powerpoint))|\.(docx?|pdf)$') THEN own WHEN length(line) BETWEEN 1 AND 79 THEN line ELSE stem END AS title FROM t"""


@query
def note_vectors_with_heads(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of notes from their chunks and heads; the vector of a note's row stands for its head."""
    heads = notes_of(spark, d, "vec").select(F.col("path").alias("note"), "vec")
    heads = heads.where(usable(F.col("vec"), 64))
    v = note_vectors(chunks_of_notes(spark, d, "tokens", "vec"), heads)
    return v.select("note", *[F.round(F.col("vec")[i], 6).alias(f"v{i}") for i in range(64)])


SQL["note_vectors_with_heads"] = f"""
WITH {_CUR}, c0 AS (SELECT DISTINCT ON (note, idx) note, idx, tokens, vec FROM chunks WHERE note IS NOT NULL AND idx IS NOT NULL ORDER BY note, idx, chunk_id DESC),
c AS (SELECT note, greatest(coalesce(tokens, 1), 1) AS w, {_U} AS u FROM c0 WHERE {_USABLE}),
e AS (SELECT note, unnest(range(64)) AS i, unnest(list_transform(u, lambda x: x * w)) AS x FROM c), s AS (SELECT note, i, sum(x) AS x FROM e GROUP BY note, i),
z AS (SELECT note, sqrt(sum(x * x)) AS z FROM s GROUP BY note), h AS (SELECT path AS note, unnest(range(64)) AS i, unnest({_U}) AS x FROM cur WHERE {_USABLE}),
b AS (SELECT note, i, sum(x) AS x FROM (SELECT note, i, x / z AS x FROM s JOIN z USING (note) UNION ALL SELECT note, i, x FROM h) GROUP BY note, i),
y AS (SELECT note, sqrt(sum(x * x)) AS z FROM b GROUP BY note)
SELECT note, {", ".join(f"round(max(x / z) FILTER (i = {i}), 6) AS v{i}" for i in range(64))} FROM b JOIN y USING (note) GROUP BY note"""


SQL["frontmatter_tag_lists"] = rf"""WITH {_D},
v AS (SELECT path, CASE WHEN coalesce(t, '') NOT IN ('', '[]', 'null', 'false', '0') THEN t WHEN coalesce(g, '') NOT IN ('', '[]', 'null', 'false', '0') THEN g END AS raw
  FROM (SELECT path, CASE WHEN json_valid(frontmatter) THEN frontmatter ->> '$.tags' END AS t, CASE WHEN json_valid(frontmatter) THEN frontmatter ->> '$.tag' END AS g FROM d WHERE frontmatter IS NOT NULL)),
l AS (SELECT path, CASE WHEN raw LIKE '[%' THEN from_json(raw, '["VARCHAR"]') ELSE regexp_split_to_array(raw, '[,\s]+') END AS tags FROM v)
SELECT path, coalesce(array_to_string(list_filter(list_transform(tags, lambda x: regexp_replace(trim(x), '^#+', '')), lambda x: x <> ''), '|'), '') AS tags FROM l"""


@query
def chunk_rules(spark: SparkSession, d: str) -> DataFrame:
    """For each text that isn't blank whether its chunks are numbered from 0, none above the greatest size, and lie within it in order."""
    docs = docs_of(spark, d).where("text is not null").select("path", "text")
    size = DEFAULTS["chunk"]
    chunks = materialize(chunk_texts(docs, "path", "text", size["min_tokens"], size["max_tokens"], size["hard_max"]), "chunks")
    # a heading line comes on top of what is packed
    chunks = chunks.withColumn("before", F.lag("start_pos").over(Window.partitionBy("path").orderBy("idx")))
    inside = (F.col("start_pos") < F.col("end_pos")) & (F.coalesce("before", F.lit(-1)) < F.col("start_pos"))
    per = chunks.groupBy("path").agg((F.count(F.lit(1)) == F.max("idx") + 1).alias("numbered"), (F.max("tokens") <= size["hard_max"] + size["max_tokens"]).alias("sized"), F.min(inside).alias("in_order"), F.max("end_pos").alias("end"))
    return per.join(docs, "path").select("path", "numbered", "sized", "in_order", (F.col("end") <= F.length("text")).alias("inside"))


# a text of nothing but headings has no chunk
SQL["chunk_rules"] = rf"""WITH {_D} SELECT path, true AS numbered, true AS sized, true AS in_order, true AS inside FROM d
WHERE text IS NOT NULL AND regexp_matches(regexp_replace(text, '(?m)^#{{1,6}}[ \t]+\S[^\n]*$', '', 'g'), '[^\s\x{{a0}}\x{{3000}}]')"""
