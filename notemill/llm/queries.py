"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.vectors import current_notes, with_unit, with_unit_or_null
from notemill.llm.neighbours import similar_pairs, similar_to
from notemill.llm.history import HistoryIndex
from notemill.llm.markup import clean_markup, kinds_found
from notemill.llm.mixing import mix, shares, spelled
from notemill.llm.neardup import groups, near_duplicates, near_pairs, vector_evidence
from notemill.llm.packing import fill_report, pack
from notemill.llm.sizes import with_tokens
from notemill.llm.spans import keep_first, merged, shared_parts, shared_report, sharing
from notemill.llm.splitting import cut_right, split_oversized
from notemill.llm.themes import describe, themes
from notemill.operators.vector_join import top_k
from notemill.session import materialize, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    notes = current_notes(read_table(spark, d, "notes"), "vec")
    return similar_pairs(notes, "path", "vec", k=5, min_cosine=0.90).select("path", "neighbour")


@query
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read_table(spark, d, "chunks", spread=True), "chunk_id")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that came out in pieces, all of which are right: the pieces' texts are made and measured."""
    return cut_right(p1_pieces(spark, d), "chunk_id")


SQL["p1_found"] = r"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) > 600),
n AS (SELECT chunk_id,
  len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]')) AS cjk,
  list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: greatest(78, 13 * length(w)))) AS words,
  regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}A-Za-z0-9_]+', '', 'g') AS rest
  FROM c),
m AS (SELECT *, length(rest) AS r, length(regexp_replace(rest, '[\p{L}\p{N}]+', '', 'g')) AS s FROM n)
SELECT DISTINCT chunk_id FROM m WHERE 60 * cjk + coalesce(words, 0) + 78 * (r - s) + 30 * s > 48000
"""


@query
def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """For each chunk above the limit whether its pieces keep it, follow one another, and hold its own text and, of the piece before, the overlap."""
    pieces = materialize(p1_pieces(spark, d), "pieces")
    whole = read_table(spark, d, "chunks").where(F.length("text") > 600).select("chunk_id", F.col("text").alias("whole")).dropDuplicates(["chunk_id"])
    at = lambda a, n: F.expr(f"substring(whole, {a} + 1, {n})")
    same = F.endswith(F.col("text"), at("start_pos - overlap", "end_pos - start_pos + overlap"))
    per = pieces.join(whole, "chunk_id").groupBy("chunk_id").agg(
        (F.max("tokens") <= 800).alias("within_limit"), F.min(same).alias("own_text"), (F.sum(F.col("end_pos") - F.col("start_pos")) == F.max(F.length("whole"))).alias("covered"), (F.count(F.lit(1)) == F.max("pieces")).alias("complete")
    )
    return per


SQL["p1_rules"] = f"SELECT chunk_id, true AS within_limit, true AS own_text, true AS covered, true AS complete FROM ({SQL['p1_found']})"


@query
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(read_table(spark, d, "chunks"), "chunk_id", "text")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select(F.col("chunk_id_a").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"))


@query
def p7_verdicts(spark: SparkSession, d: str) -> DataFrame:
    index = HistoryIndex(spark)
    index.append(with_unit_or_null(current_notes(read_table(spark, d, "notes"), "text_hash", "vec")))
    return index.check(read_table(spark, d, "incoming"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_verdicts(spark, d).where("verdict <> 'accepted'").select("item_id", "verdict")


@query
def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(read_table(spark, d, "extracted", spread=True))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return kinds_found(p4_clean(spark, d))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing(read_table(spark, d, "documents", spread=True))


@query
def p3_themes(spark: SparkSession, d: str) -> DataFrame:
    notes = current_notes(read_table(spark, d, "notes"), "vec", "tags_json", "folder")
    return describe(themes(notes, "path", "vec"), notes)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    theme = materialize(themes(current_notes(read_table(spark, d, "notes"), "vec"), "path", "vec").select("path", "theme"), "themes")
    pairs = read_table(spark, d, "cluster_probe").select("note_a", "note_b").distinct()
    pairs = pairs.join(theme.select(F.col("path").alias("note_a"), "theme"), "note_a")
    return pairs.join(theme.select(F.col("path").alias("note_b"), "theme"), ["note_b", "theme"]).select("note_a", "note_b")


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(read_table(spark, d, "documents", spread=True), "doc_id", "text")
    return pack(sized, read_table(spark, d, "pack_profiles"))


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_containers(spark, d))


BUDGET = 0.5  #: tokens of the mixture, as a share of those of all documents whose source has a target


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(read_table(spark, d, "documents", spread=True), "doc_id", "text", "source")
    return mix(sized, read_table(spark, d, "mix_targets"), budget_share=BUDGET)


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p9_mix(spark, d), read_table(spark, d, "mix_targets"))


@query
def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """For each source whether the mixture keeps its rules: no document more often than allowed, no source above its due in its targets'
    proportions to the others by more than a document, and the budget used up but for less than a document's tokens."""
    sized = materialize(with_tokens(read_table(spark, d, "documents", spread=True), "doc_id", "text", "source"), "sized")
    goal = read_table(spark, d, "mix_targets")
    chosen = materialize(mix(sized, goal, budget_share=BUDGET), "chosen")
    per = shares(chosen, goal).join(goal.groupBy(spelled(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("max_repeats")), "source")
    have = sized.where("tokens > 0").groupBy(spelled(F.col("source")).alias("source")).agg(F.sum("tokens").alias("have"), F.max("tokens").alias("most"))
    per = per.join(have, "source", "left").na.fill(0, ["have", "most"])
    all_ = per.agg(F.sum("tokens").alias("used"), F.sum("have").alias("all"), F.max("most").alias("longest"), F.max(F.col("tokens") / F.col("target_share")).alias("time"))
    per = per.crossJoin(F.broadcast(all_))  # one row
    spent = F.col("tokens") >= F.col("have") * F.col("max_repeats")
    due = F.abs(F.col("tokens") - F.col("time") * F.col("target_share")) <= F.col("longest") * (1 + F.col("target_share") / F.lit(0.01))
    left = F.col("all") * BUDGET - F.col("used")
    return per.select("source", (F.col("most_used") <= F.col("max_repeats")).alias("repeats_kept"), (spent | due).alias("share_due"), ((left >= 0) & (left <= F.col("longest"))).alias("budget_used"))


SQL["p9_rules"] = """
SELECT DISTINCT regexp_replace(lower(trim(source)), '[_ ]+', '-', 'g') AS source, true AS repeats_kept, true AS share_due, true AS budget_used FROM mix_targets WHERE source IS NOT NULL
"""


@query
def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """For each profile whether the containers keep its rules: every token placed, none overfull, one in a hundred more than needed at most."""
    sized = materialize(with_tokens(read_table(spark, d, "documents", spread=True), "doc_id", "text"), "sized")
    profiles = read_table(spark, d, "pack_profiles")
    placed = materialize(pack(sized, profiles), "placed")
    boxes = placed.groupBy("profile", "container").agg(F.sum("tokens").alias("t"), F.first("capacity").alias("capacity"))
    per = boxes.groupBy("profile").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"), F.max(F.col("t") - F.col("capacity")).alias("over"), F.max("capacity").alias("capacity"))
    divided = placed.join(sized.select("doc_id", F.col("tokens").alias("whole")), "doc_id").where("whole <= capacity").groupBy("profile", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("profile").agg(F.max("c").alias("cut"))
    per = per.crossJoin(F.broadcast(sized.agg(F.sum("tokens").alias("all")))).join(divided, "profile", "left")  # one row
    few = F.col("n") <= F.ceil(F.col("all") / F.col("capacity") * 1.01) + 1
    return per.select("profile", (F.col("t") == F.col("all")).alias("all_placed"), (F.col("over") <= 0).alias("none_overfull"), few.alias("few_containers"), (F.coalesce("cut", F.lit(1)) == 1).alias("only_long_divided"))


SQL["p8_rules"] = "SELECT profile, true AS all_placed, true AS none_overfull, true AS few_containers, true AS only_long_divided FROM pack_profiles"


@query
def p6_chunks(spark: SparkSession, d: str) -> DataFrame:
    """For every chunk whose id is divisible by 50 the five most similar of all chunks."""
    chunks = read_table(spark, d, "chunks").select("chunk_id", "vec").dropDuplicates(["chunk_id"])
    return similar_to(chunks.where("chunk_id % 50 = 0"), chunks, "chunk_id", "vec")


@query
def p6_notes(spark: SparkSession, d: str) -> DataFrame:
    """The same for notes, which have no number: those whose path's hash is divisible by 50 ask."""
    notes = current_notes(read_table(spark, d, "notes"), "vec")
    return similar_to(notes.where(F.xxhash64("path") % 50 == 0), notes, "path", "vec")


@query
def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return merged(shared_parts(read_table(spark, d, "documents", spread=True)), "doc_id")


@query
def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", spread=True)
    return shared_report(docs, shared_parts(docs))


@query
def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", spread=True)
    return keep_first(docs, shared_parts(docs))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    links, members = near_duplicates(read_table(spark, d, "chunks"), "chunk_id", "text")
    return groups(materialize(links, "links"), members, "chunk_id")


@query
def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks")
    links, _ = near_duplicates(chunks, "chunk_id", "text")
    return vector_evidence(links, chunks, current_notes(read_table(spark, d, "notes"), "vec"))


SQL["p6_found"] = """
WITH cur AS (SELECT path, vec FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) AS r FROM notes WHERE path IS NOT NULL) WHERE r = 1),
n AS (SELECT path, list_transform(vec::DOUBLE[], lambda x: x / sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[]))) AS u FROM cur WHERE vec IS NOT NULL AND len(vec) = 64 AND list_inner_product(vec::DOUBLE[], vec::DOUBLE[]) > 0),
s AS (SELECT a.path, b.path AS neighbour, list_inner_product(a.u, b.u) AS s FROM n a JOIN n b ON a.path <> b.path AND list_inner_product(a.u, b.u) >= 0.90)
SELECT path, neighbour FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(s, 5) DESC, neighbour) <= 5
"""

SQL["p10_found"] = """
WITH w AS (SELECT doc_id, md5(substring(text, unnest(range(1, length(text) - 198)), 200)) AS h FROM documents WHERE length(text) >= 200),
m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM w WHERE h IN (SELECT h FROM m)
"""

_WINDOWS = """w AS (SELECT doc_id, pos, md5(substring(text, pos, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS pos FROM documents WHERE length(text) >= 200)),
m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT doc_id, pos FROM w WHERE h IN (SELECT h FROM m))"""
SQL["p10_shared"] = f"""WITH {_WINDOWS},
c AS (SELECT doc_id, sum(least(200, coalesce(next - pos, 200))) AS n FROM (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM hit) GROUP BY doc_id)
SELECT doc_id, length(text) AS chars, coalesce(n, 0)::BIGINT AS shared_chars, round(coalesce(n, 0) / greatest(length(text), 1), 6) AS share FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL"""
SQL["p10_passages"] = f"""WITH {_WINDOWS},
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g)
SELECT doc_id, min(pos) - 1 AS start, max(pos) + 199 AS "end" FROM r GROUP BY doc_id, run"""

_GRAMS = """WITH t AS (SELECT DISTINCT chunk_id, regexp_replace(lower(text), '[ \\t\\r\\n\\x{a0}\\x{3000}]', '', 'g') AS norm FROM chunks WHERE chunk_id IS NOT NULL),
u AS (SELECT norm, row_number() OVER (ORDER BY norm) AS id FROM (SELECT DISTINCT norm FROM t WHERE length(norm) >= 150)),
g AS (SELECT DISTINCT id, substring(norm, pos, 5) AS gram FROM (SELECT id, norm, unnest(range(1, length(norm) - 3)) AS pos FROM u)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), f AS (SELECT gram, count(*) AS c FROM g GROUP BY gram),
p AS (SELECT id, gram, n FROM (SELECT g.id, g.gram, n.n, row_number() OVER (PARTITION BY g.id ORDER BY f.c, g.gram) AS r FROM g JOIN n USING (id) JOIN f USING (gram)) WHERE r <= n - ceil(0.7 * n) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.gram = b.gram AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)),
j AS (SELECT a, b, na, nb, count(*) AS both_ FROM cand JOIN g x ON x.id = a JOIN g y ON y.id = b AND y.gram = x.gram GROUP BY ALL),
links AS (SELECT a, b, both_ / (na + nb - both_) AS similarity FROM j WHERE both_ / (na + nb - both_) >= 0.70), k AS (SELECT chunk_id, id FROM t JOIN u USING (norm)),
pairs AS (SELECT least(x.chunk_id, y.chunk_id) AS a, greatest(x.chunk_id, y.chunk_id) AS b, max(similarity) AS similarity FROM (SELECT * FROM links UNION ALL SELECT id, id, 1.0 FROM u) l JOIN k x ON x.id = l.a JOIN k y ON y.id = l.b WHERE x.chunk_id <> y.chunk_id GROUP BY 1, 2)"""
SQL["p5_found"] = f"{_GRAMS} SELECT a AS chunk_a, b AS chunk_b FROM pairs"
SQL["p5_pairs"] = f"{_GRAMS} SELECT a AS chunk_id_a, b AS chunk_id_b, similarity FROM pairs"
SQL["p5_groups"] = f"""{_GRAMS.replace("WITH t", "WITH RECURSIVE t", 1)},
reps AS (SELECT id, min(chunk_id) AS class FROM k GROUP BY id), e AS (SELECT x.class AS a, y.class AS b FROM links JOIN reps x ON x.id = links.a JOIN reps y ON y.id = links.b),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT class AS a, class AS b FROM reps UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
grps AS (SELECT a AS class, min(b) AS grp FROM reach GROUP BY a), degree AS (SELECT a AS class, count(*) AS links FROM both_ways GROUP BY a),
m AS (SELECT DISTINCT chunk_id, class FROM k JOIN reps USING (id)), s AS (SELECT grp, count(*) AS size FROM m JOIN grps USING (class) GROUP BY grp)
SELECT chunk_id, class AS class_id, grp AS group_id, size AS group_size, coalesce(links, 0) AS links FROM m JOIN grps USING (class) JOIN s USING (grp) LEFT JOIN degree USING (class)"""

# the items one after the other, each with the numbers of those before it that it matches
_IN_TURN = """WITH RECURSIVE cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) AS r FROM notes WHERE path IS NOT NULL) WHERE r = 1),
k AS (SELECT nullif(lower(text_hash), 'da39a3ee5e6b4b0d3255bfef95601890afd80709') AS h, CASE WHEN len(vec) = 64 AND list_inner_product(vec::DOUBLE[], vec::DOUBLE[]) > 0 THEN list_transform(vec::DOUBLE[], lambda x: x / sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[]))) END AS u FROM cur),
i0 AS (SELECT DISTINCT ON (item_id) item_id, batch_no, text_hash, vec FROM incoming WHERE item_id IS NOT NULL ORDER BY item_id, batch_no, arrived_at),
it AS (SELECT row_number() OVER (ORDER BY batch_no NULLS LAST, item_id) AS i, item_id, coalesce(batch_no, 2147483647) AS batch_no, nullif(lower(text_hash), 'da39a3ee5e6b4b0d3255bfef95601890afd80709') AS h,
  CASE WHEN len(vec) = 64 AND list_inner_product(vec::DOUBLE[], vec::DOUBLE[]) > 0 THEN list_transform(vec::DOUBLE[], lambda x: x / sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[]))) END AS u FROM i0),
ke AS (SELECT DISTINCT it.i FROM it JOIN k ON it.h = k.h), kn AS (SELECT DISTINCT it.i FROM it JOIN k ON it.u IS NOT NULL AND k.u IS NOT NULL AND list_inner_product(it.u, k.u) >= 0.95),
e AS (SELECT a.i, list(b.i) AS e FROM it a JOIN it b ON b.i < a.i AND a.h = b.h GROUP BY a.i),
n AS (SELECT a.i, list(b.i) AS n FROM it a JOIN it b ON b.i < a.i AND a.u IS NOT NULL AND b.u IS NOT NULL AND list_inner_product(a.u, b.u) >= 0.95 GROUP BY a.i),
s AS MATERIALIZED (SELECT it.i, it.item_id, it.batch_no, ke.i IS NOT NULL AS ke, kn.i IS NOT NULL AS kn, coalesce(e, []) AS e, coalesce(n, []) AS n FROM it LEFT JOIN ke USING (i) LEFT JOIN kn USING (i) LEFT JOIN e USING (i) LEFT JOIN n USING (i)),
run AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc, NULL::BIGINT AS item_id, NULL::INT AS batch_no, NULL::VARCHAR AS verdict UNION ALL
  SELECT i, CASE WHEN v = 'accepted' THEN list_append(acc, i) ELSE acc END, item_id, batch_no, v FROM (SELECT s.i, run.acc, s.item_id, s.batch_no, CASE WHEN ke OR list_has_any(e, run.acc) THEN 'exact' WHEN kn OR list_has_any(n, run.acc) THEN 'near' ELSE 'accepted' END AS v FROM run JOIN s ON s.i = run.i + 1))"""
SQL["p7_found"] = f"{_IN_TURN} SELECT item_id, verdict FROM run WHERE verdict <> 'accepted'"
SQL["p7_verdicts"] = f"{_IN_TURN} SELECT item_id, batch_no, verdict FROM run WHERE i > 0"


@query
def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether nine tenths of the five most similar of a fiftieth of the notes, and of the chunks, are found, by comparison with all."""
    out = []
    chunks = read_table(spark, d, "chunks").select("chunk_id", "vec").dropDuplicates(["chunk_id"])
    notes = current_notes(read_table(spark, d, "notes"), "vec")
    for name, key, rows, asks, got in (("chunks", "chunk_id", chunks, F.col("key") % 50 == 0, p6_chunks(spark, d)), ("notes", "path", notes, F.xxhash64("key") % 50 == 0, p6_notes(spark, d))):
        units = materialize(with_unit(rows.withColumnRenamed(key, "key"), dtype=np.float64), "exact")
        want = top_k(units.where(asks).withColumnRenamed("key", "query"), units, 6)
        want = want.where("query <> key").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))).where("r <= 5")
        met = want.join(got.select(F.col(key).alias("query"), F.col("neighbour").alias("key"), F.lit(1).alias("met")), ["query", "key"], "left")
        out.append(met.agg(F.lit(name).alias("searched"), F.coalesce(F.avg(F.coalesce("met", F.lit(0))) >= 0.9, F.lit(True)).alias("enough")))
    return out[0].unionByName(out[1])


SQL["p6_recall"] = "SELECT * FROM (VALUES ('chunks', true), ('notes', true)) v(searched, enough)"
