"""The engine: a vault's index and the commands on it. Every command takes and gives DataFrames, many query documents at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.config import Config
from notemill.functions.embedding import image_vectors, ngram_vectors
from notemill.functions.text import text_hash
from notemill.functions.vectors import with_unit
from notemill.operators.chunking import chunk_texts
from notemill.operators.dedup import chunk_links, chunk_links_between, evidence, exact_matches, exact_members, redundant_inside, redundant_ratio, related_notes, related_to
from notemill.operators.folders import classify, note_vectors, profiles, similar, suggest_tags
from notemill.operators.index import image_referrers, index_diff, index_stats, resolve_images
from notemill.operators.linkage import average_linkage
from notemill.operators.vector_join import cosines, pairs_above, pairs_between, top_k
from notemill.session import materialize
from notemill.sources import vault as sources
from notemill.sources.snapshots import Snapshots

NAMED = 20_000  #: changed files that are read by name; if more have changed, the whole vault is read
HEAD_CHARS = 500  #: of a text that its head vector covers, after the title
PROBES = ["The quick brown fox jumps over the lazy dog.", "向量檢索與語意搜尋", "def f(x): return x + 1"]


class EngineError(Exception):
    """code: index_empty, not_found, bad_args, backend_incompatible."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class NgramEmbedder:
    """The back-end without a model. Any other needs embed(df, key, text) -> (key, vec), and a dim; for images, embed_images(df, key,
    content) -> (key, vec)."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return ngram_vectors(df, key, text, self.dim)

    def embed_images(self, df: DataFrame, key: str, content: str) -> DataFrame:
        return image_vectors(df, key, content, self.dim)


#: back-ends by the name in the setting backend; each is made of the settings. Add others here, or give the engine an object
EMBEDDERS: dict[str, Callable[[Config], Any]] = {"ngrams": lambda config: NgramEmbedder(config["dim"])}


def embedder_of(config: Config) -> Any:
    """The back-end that the settings name."""
    if config["backend"] not in EMBEDDERS:
        raise EngineError("bad_args", f"there is no back-end {config['backend']!r}, but {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[config["backend"]](config)


class Engine:
    def __init__(self, spark: SparkSession, config: Config, index: str, embedder: Any = None, pdf: Any = None, auto: bool = False) -> None:
        """embedder: the back-end of vectors; pdf: that of PDFs' pages (see sources.vault); auto: an empty index is built when first asked."""
        self.pdf, self.auto = pdf, auto
        self.spark, self.config, self.index = spark, config, Snapshots(spark, index)
        self.embedder = embedder or embedder_of(config)
        self.t = config["thresholds"]

    # building

    def embedded(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """notes (path, title, kind, folder, tags_json, text_hash, hash, mtime, vec, images) and chunks of documents."""
        docs = materialize(docs, "docs")
        c = self.config["chunk"]
        chunks = materialize(chunk_texts(docs, "path", "text", c["min_tokens"], c["max_tokens"], c["hard_max"]), "chunks")
        key = F.concat_ws("\x01", "path", F.col("idx").cast("string")).alias("key")
        head = docs.select(F.concat("path", F.lit("\x01")).alias("key"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.left("text", F.lit(HEAD_CHARS))).alias("text"))
        vectors = materialize(self.embedder.embed(head.unionByName(chunks.select(key, "text")), "key", "text"), "vectors")
        part = F.split("key", "\x01")
        heads = vectors.where(part[1] == "").select(part[0].alias("note"), "vec")
        chunks = chunks.join(vectors.where(part[1] != "").select(part[0].alias("path"), part[1].cast("int").alias("idx"), "vec"), ["path", "idx"]).withColumnRenamed("path", "note")
        vecs = note_vectors(chunks, heads, self.embedder.dim).withColumnRenamed("note", "path")
        folder = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
        notes = docs.select("path", "title", "kind", folder.alias("folder"), F.to_json("tags").alias("tags_json"), text_hash(F.col("text")).alias("text_hash"), F.col("file_hash").alias("hash"), "mtime", "images", "needs_ocr")
        return notes.join(vecs, "path", "left"), chunks

    def probe(self) -> DataFrame:
        rows = self.spark.createDataFrame([(str(i), p) for i, p in enumerate(PROBES)], "key string, text string")
        return self.embedder.embed(rows, "key", "text")

    def check_probe(self) -> float:
        """The least cosine of the probes' vectors with those stored; an index made by another model is refused."""
        stored = self.index.read("probes")
        if stored is None:
            return 1.0
        unit = lambda df, out: with_unit(df, out=out, dim=self.embedder.dim, dtype=np.float64)
        least = cosines(unit(self.probe(), "u").join(unit(stored, "v"), "key"), self.embedder.dim, "key").agg(F.min("cosine")).head()[0]
        if least is None or least < self.t["probe_min"]:
            raise EngineError("backend_incompatible", f"the index was made by another model (cosine {least})")
        return float(least)

    def _files(self, listed: DataFrame, known: DataFrame | None) -> DataFrame:
        """The files of a listing (path, mtime) with their content: all if nothing is known, else those with another time than in known
        (path, mtime). Few are read by name; Spark's file sources keep the names of what they read on the driver anyway."""
        vault = self.config.vault
        if known is None:
            return sources.scan_vault(self.spark, vault, self.config)
        new = listed.join(known.select("path", F.col("mtime").alias("m")), "path", "left").where("m is null or m <> mtime").select("path")
        names = [r[0] for r in new.limit(NAMED + 1).collect()]
        if len(names) > NAMED:
            return sources.scan_vault(self.spark, vault, self.config).join(new, "path", "left_semi")
        return sources.scan_vault(self.spark, vault, self.config, names) if names else listed.limit(0)

    def refresh(self, rebuild: bool = False) -> dict[str, Any]:
        """Brings the index up to date with the vault: only files whose time has changed are opened, only those whose content has changed
        are chunked and embedded.

        A file that can't be made a document fails alone: it is in the table failed (path, error), its old row stays, and it is
        tried again by every refresh."""
        began = time.monotonic()
        listed = materialize(sources.scan_vault(self.spark, self.config.vault, self.config, content=False), "listed")
        old = None if rebuild else self.index.read("notes")
        if old is not None:
            self.check_probe()
        files = self._files(listed.where("role = 'document'"), old)
        hashes = files.where("role = 'document'").select("path", F.sha1("content").alias("hash"))
        now = listed.where("role = 'document'").select("path", "mtime").join(hashes, "path", "left")
        known = old if old is not None else now.limit(0)
        diff = materialize(index_diff(materialize(now, "now"), known.select("path", "mtime", "hash")), "diff")
        fresh = diff.where("change in ('added', 'updated')").select("path")
        docs = sources.documents(files.join(fresh, "path", "left_semi").unionByName(listed.join(fresh, "path", "left_anti").withColumn("role", F.lit(None).cast("string"))), self.pdf)
        docs = materialize(docs, "docs")
        good = docs.where("error is null")
        failed = fresh.join(good.select("path"), "path", "left_anti").join(docs.select("path", "error"), "path", "left").select("path", F.coalesce("error", F.lit("unreadable")).alias("error"))
        failed = materialize(failed, "failed")
        stats = index_stats(diff.join(failed, "path", "left_anti")).head().asDict()
        notes, chunks = self.embedded(good)
        if old is not None:
            same = diff.where("change in ('unchanged', 'touched')").select("path")
            times = listed.select("path", "mtime")
            kept = old.join(same, "path").drop("mtime").join(times, "path").unionByName(old.join(failed.select("path"), "path", "left_semi"))
            held = same.unionByName(failed.select("path")).withColumnRenamed("path", "note")
            notes = kept.unionByName(notes)
            chunks = self.index.read("chunks").join(held, "note", "left_semi").unionByName(chunks)
        notes = materialize(notes, "notes")
        self.index.write(notes=notes, chunks=chunks, images=self._images(listed, notes, rebuild), probes=self.probe(), failed=failed)
        counts = {n: self.index.read(n).count() for n in ("notes", "images", "failed")}
        return {**stats, "notes_total": counts["notes"], "images": counts["images"], "failed": counts["failed"], "needs_ocr": docs.where("needs_ocr").count(), "seconds": round(time.monotonic() - began, 3)}

    def _images(self, listed: DataFrame, notes: DataFrame, rebuild: bool) -> DataFrame:
        """(path, file_hash, mtime, vec, referenced_by) of the vault's images; only those with a new time are opened and embedded."""
        there = listed.where("role = 'image'")
        old = None if rebuild else self.index.read("images")
        files = sources.images(self._files(there, old))
        embed = getattr(self.embedder, "embed_images", None)
        vectors = embed(files, "path", "content") if embed else files.select("path", F.lit(None).cast("array<double>").alias("vec"))
        pictures = files.drop("content").join(vectors, "path", "left").select("path", "file_hash", "mtime", F.col("vec").cast("array<double>").alias("vec"))
        if old is not None:
            pictures = materialize(pictures, "pictures")
            pictures = pictures.unionByName(old.join(there.select("path", "mtime"), ["path", "mtime"], "left_semi").select(*pictures.columns))
        names = notes.select(F.col("path").alias("note"), F.explode("images").alias("i")).select("note", "i.name")
        refs = resolve_images(names.distinct(), listed.select("path")).where("path is not null")
        return pictures.join(refs.groupBy("path").agg(F.sort_array(F.collect_set("note")).alias("referenced_by")), "path", "left")

    def table(self, name: str) -> DataFrame:
        df = self.index.read(name)
        if df is None and self.auto:
            self.refresh()
            df = self.index.read(name)
        if df is None:
            raise EngineError("index_empty", "the index is empty; call refresh() first")
        return df

    def listed_tags(self) -> DataFrame | None:
        """(tag, description) of the file that the setting tag_list names; None without it."""
        return sources.tag_list(self.spark, self.config["tag_list"]) if self.config["tag_list"] else None

    def status(self) -> dict[str, Any]:
        return {"vault": self.config.data["vault"], "index": self.index.path, **{n: (df.count() if (df := self.index.read(n)) is not None else 0) for n in ("notes", "chunks", "images")}}

    # commands

    def _packed(self) -> tuple[DataFrame, DataFrame]:
        d = self.embedder.dim
        notes = materialize(with_unit(self.table("notes").select("path", "text_hash", "vec"), dim=d, dtype=np.float64), "notes")
        return notes, materialize(with_unit(self.table("chunks").select("note", "idx", "tokens", "vec"), dim=d, dtype=np.float64), "chunks")

    def dedup_all(self) -> dict[str, DataFrame]:
        """exact_members (a row per note whose text another has), pairs and evidence of the whole index."""
        notes, chunks = self._packed()
        links = materialize(chunk_links(chunks, self.t["chunk_match"], self.embedder.dim), "links")
        pairs = materialize(related_notes(notes, chunks, links, self.t, self.embedder.dim), "pairs")
        return {"exact_members": exact_members(notes), "pairs": pairs, "evidence": evidence(pairs, chunks, self.embedder.dim), "image_pairs": self.image_pairs()}

    def queries(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query, path, file_hash, text_hash, vec, title, tags_json) and chunks of documents that are not (yet) in the index."""
        notes, chunks = self.embedded(docs)
        return notes.select(F.col("path").alias("query"), "path", F.col("hash").alias("file_hash"), "text_hash", "vec", "title", "tags_json"), chunks

    def pictures_of(self, docs: DataFrame) -> DataFrame:
        """(image, file_hash, vec, own) of the images of the vault that documents (path, images) show; own: those of the same document,
        which it isn't held against."""
        names = docs.select(F.col("path").alias("note"), F.explode("images").alias("i")).select("note", "i.name").distinct()
        refs = resolve_images(names, self.table("images").select("path")).where("path is not null").select("note", "path").distinct()
        own = refs.groupBy("note").agg(F.collect_set("path").alias("own"))
        pictures = self.table("images").select("path", "file_hash", "vec")
        return refs.join(own, "note").join(pictures, "path").groupBy(F.col("path").alias("image")).agg(F.first("file_hash").alias("file_hash"), F.first("vec").alias("vec"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))

    def similar(self, queries: DataFrame | None = None, text: str | None = None, k: int = 10, image: DataFrame | None = None) -> DataFrame:
        """The nearest of the index: of images (query, content) if given, else of a text, else of documents."""
        if image is not None:
            if not hasattr(self.embedder, "embed_images"):
                raise EngineError("bad_args", "the back-end has no vectors of images")
            return self.similar_images(self.embedder.embed_images(image, "query", "content"), k=k)
        if text is not None:
            one = self.spark.createDataFrame([("text", text)], "query string, text string")
            queries = self.embedder.embed(one, "query", "text").withColumn("path", F.lit(None).cast("string"))
        if queries is None:
            raise EngineError("bad_args", "similar needs documents, a text or an image")
        return similar(queries.select("query", "path", "vec"), self.table("notes"), self.table("chunks"), k, self.embedder.dim)

    def classify(self, queries: DataFrame) -> DataFrame:
        folders = self.spark.createDataFrame(list(self.config["folders"].items()), "folder string, description string")
        skip = [self.config["inbox"], self.config["review_dir"]]
        return classify(queries.select("query", "path", "vec"), self.table("notes").select("path", "folder", "vec"), folders, skip, self.embedder.dim, self.t["classify_min"], self.t["classify_margin"])

    def tags(self, queries: DataFrame, listed: DataFrame | None = None, k: int = 5) -> DataFrame:
        own = queries.select("query", "path", "vec")
        listed = self.listed_tags() if listed is None else listed
        return suggest_tags(own, self.table("notes"), listed, self.embedder.dim, k, self.t["tag_min"])

    def dedup(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        """(doc, target, kind, score, doc_in_target, target_in_doc) of documents against the index: exact ones by hash, others by vectors.

        Each document is held against all notes but its own; documents aren't held against each other, nor notes."""
        d = self.embedder.dim
        exact = exact_matches(queries.select(F.col("query").alias("doc"), "path", "file_hash", "text_hash"), self.table("notes").select("path", "hash", "text_hash"))
        notes, old = self._packed()
        q = materialize(with_unit(queries.select(F.col("query").alias("path"), F.lit(None).cast("string").alias("text_hash"), "vec"), dim=d, dtype=np.float64), "docs")
        c = materialize(with_unit(chunks.select("note", "idx", "vec"), dim=d, dtype=np.float64), "doc_chunks")
        links = materialize(chunk_links_between(c, old, self.t["chunk_match"], d), "links")
        pairs = related_to(q, c, notes, old, links, self.t, d).withColumnRenamed("a", "doc")
        own = queries.select(F.col("query").alias("doc"), F.col("path").alias("own"))
        rest = pairs.join(own, "doc").where("not (b <=> own)").join(exact.withColumnRenamed("target", "b"), ["doc", "b"], "left_anti")
        out = rest.select("doc", F.col("b").alias("target"), "kind", "score", F.col("a_in_b").alias("doc_in_target"), F.col("b_in_a").alias("target_in_doc"))
        none = F.lit(None).cast("double")
        return exact.select("doc", "target", F.lit("exact").alias("kind"), F.lit(1.0).alias("score"), none.alias("doc_in_target"), none.alias("target_in_doc")).unionByName(out)

    def redundant(self, queries: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
        """Passages of documents that recur within them or stand in another note of the index, and their share.

        Only a document's own note is left out, so what is reported of it is the same whichever others are asked with it."""
        d = self.embedder.dim
        old = materialize(with_unit(self.table("chunks").select("note", "idx", "vec"), dim=d, dtype=np.float64), "chunks")
        mine = materialize(with_unit(chunks.select("note", "idx", "tokens", "vec"), dim=d, dtype=np.float64), "mine")
        inside = redundant_inside(chunk_links(mine, self.t["chunk_match"], d))
        links = chunk_links_between(mine, old, self.t["chunk_match"], d)
        own = queries.select(F.col("query").alias("doc"), F.col("path").alias("own"))
        links = links.join(own, "doc").where("not (note <=> own)")
        best = links.groupBy("doc", "i").agg(F.min(F.struct((-F.col("cosine")).alias("s"), "note", "j")).alias("m"))
        across = materialize(best.select(F.col("doc").alias("note"), F.col("i").alias("chunk"), F.round(-F.col("m.s"), 4).alias("score"), F.col("m.note").alias("found_in"), F.col("m.j").alias("found_chunk")), "across")
        inside = materialize(inside, "inside")
        return {"internal": inside, "cross_vault": across, "ratio": redundant_ratio(mine, inside, across)}

    def _pictures(self, vectors: DataFrame | None) -> DataFrame:
        return vectors if vectors is not None else self.table("images").select("path", "vec")

    def image_pairs(self, vectors: DataFrame | None = None) -> DataFrame:
        """(a, b, kind, score) of image vectors (path, vec), the index's own unless given: above the threshold, exact where the bytes are equal."""
        rows = with_unit(self._pictures(vectors).select(F.col("path").alias("key"), "vec"), dim=self.embedder.dim, dtype=np.float64)
        hashes = self.table("images").select("path", "file_hash")
        found = pairs_above(rows, self.t["image_dup"], self.embedder.dim)
        found = found.join(hashes.select(F.col("path").alias("a"), F.col("file_hash").alias("ha")), "a", "left").join(hashes.select(F.col("path").alias("b"), F.col("file_hash").alias("hb")), "b", "left")
        exact = F.coalesce(F.col("ha") == F.col("hb"), F.lit(False))
        return found.select("a", "b", F.when(exact, "image_exact").otherwise("image_duplicate").alias("kind"), F.when(exact, 1.0).otherwise(F.round("cosine", 4)).alias("score"))

    def dedup_images(self, queries: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """(image, target, kind, score, referenced_by): images (image, file_hash, vec, own: of the document) against those of the index
        (path, vec). Equal bytes make a pair exact, but the vectors must be alike too; a document's own images are left out."""
        d = self.embedder.dim
        u = lambda df, key: with_unit(df.select(F.col(key).alias("key"), "vec"), dim=d, dtype=np.float64)
        found = pairs_between(u(queries, "image"), u(self._pictures(vectors), "path"), self.t["image_dup"], d)
        of = queries.select(F.col("image").alias("left"), F.col("file_hash").alias("mine"), "own")
        at = self.table("images").select(F.col("path").alias("right"), F.col("file_hash").alias("theirs"), "referenced_by")
        rows = found.join(of, "left").join(at, "right", "left").where(~F.coalesce(F.array_contains("own", F.col("right")), F.lit(False)))
        exact = F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False))
        return rows.select(F.col("left").alias("image"), F.col("right").alias("target"), F.when(exact, "image_exact").otherwise("image_duplicate").alias("kind"), F.when(exact, 1.0).otherwise(F.round("cosine", 4)).alias("score"), "referenced_by")

    def similar_images(self, queries: DataFrame, vectors: DataFrame | None = None, k: int = 10) -> DataFrame:
        """(query, path, score, rank, referenced_by) for image vectors (query, vec) against those of the index (path, vec)."""
        d = self.embedder.dim
        found = top_k(with_unit(queries.select("query", "vec"), dim=d, dtype=np.float64), with_unit(self._pictures(vectors).select(F.col("path").alias("key"), "vec"), dim=d, dtype=np.float64), k, d)
        refs = self.table("images").select("path", "referenced_by")
        return found.select("query", F.col("key").alias("path"), F.round("score", 4).alias("score"), "rank").join(refs, "path", "left")

    def propose_tags(self, k: int | None = None, distance: float = 0.35) -> DataFrame:
        """Profiles of the average-linkage clusters of the notes, the largest first. For a bounded number of notes (see linkage)."""
        notes = self.table("notes")
        if k is not None and k < 1:
            raise EngineError("bad_args", "k must be at least 1")
        rows = with_unit(notes.select(F.col("path").alias("key"), "vec"), dim=self.embedder.dim, dtype=np.float64)
        labels = average_linkage(rows, None if k else distance, k, self.embedder.dim).withColumnRenamed("key", "path")
        return profiles(notes.join(labels, "path"), self.embedder.dim).orderBy(F.col("size").desc(), "label")

    def referrers(self) -> DataFrame:
        return image_referrers(self.table("notes").select("path", "images"))

    def ingest(self, docs: DataFrame, listed: DataFrame | None = None, k: int = 5) -> dict[str, DataFrame]:
        """Everything there is to say about new documents, all of them in one go."""
        queries, chunks = self.queries(docs)
        queries, chunks = materialize(queries, "queries"), materialize(chunks, "query_chunks")
        return {"images": self.dedup_images(self.pictures_of(docs)), "dedup": self.dedup(queries, chunks), **self.redundant(queries, chunks), "classify": self.classify(queries), "tags": self.tags(queries, listed, k), "similar": self.similar(queries, k=k)}
