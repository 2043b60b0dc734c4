import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemill.functions.vectors import with_unit
from notemill.operators import chunking, linkage
from notemill.operators.changes import ChangeLog, changed_paths
from notemill.operators.dedup import chunk_links, evidence, exact_members, redundant_across, redundant_inside, redundant_ratio, related_notes
from notemill.operators.folders import classify, note_vectors, profiles, similar, suggest_tags
from notemill.operators.index import image_referrers, index_diff, index_stats, resolve_images, scanned
from notemill.operators.pdf import clean_pages
from notemill.operators.vector_join import pairs_above, top_k


def unit_df(spark, x, key="key"):
    df = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)], f"{key} string, vec array<double>")
    return with_unit(df, dim=x.shape[1], dtype=np.float64)


def test_top_k_and_pairs_match_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((120, 16))
    x[60:90] = x[:30] + 0.2 * r.standard_normal((30, 16))
    x[90:95] = x[0]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = unit_df(spark, x)
    s = np.round(u @ u.T, 9)
    got = {(p.a, p.b) for p in pairs_above(df, 0.9, 16).collect()}
    assert got == {(f"k{i:03d}", f"k{j:03d}") for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.9}
    found = top_k(df.withColumnRenamed("key", "query"), df, 4, 16, exclude_same=True).collect()
    for i in (0, 7, 119):
        mine = [p.key for p in sorted((p for p in found if p.query == f"k{i:03d}"), key=lambda p: p.rank)]
        order = sorted((j for j in range(120) if j != i), key=lambda j: (-s[i, j], j))[:4]
        assert mine == [f"k{j:03d}" for j in order]
    assert top_k(df.limit(0).withColumnRenamed("key", "query"), df, 4, 16).count() == 0
    assert pairs_above(df.limit(0), 0.9, 16).count() == 0


def test_exact_and_two_sided_joins(spark, monkeypatch):
    from notemill.operators import vector_join
    from notemill.operators.vector_join import linked, pairs_between, plan_bands

    r = np.random.default_rng(3)
    x = r.standard_normal((150, 16))
    x[100:120] = x[0]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    df = unit_df(spark, x)
    monkeypatch.setattr(vector_join, "PAIRED", 40)
    assert plan_bands(0.1) is None and plan_bands(0.9)
    for least, exact in ((0.1, False), (0.6, True), (0.9, True)):
        want = {(f"k{i:03d}", f"k{j:03d}") for i in range(150) for j in range(i + 1, 150) if s[i, j] >= least}
        got = [(p.a, p.b) for p in pairs_above(df, least, 16, exact).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left, right = df.where("key < 'k070'"), df.where("key >= 'k050'")
    for least, exact in ((0.1, False), (0.9, False), (0.9, True)):
        want = {(f"k{i:03d}", f"k{j:03d}") for i in range(70) for j in range(50, 150) if s[i, j] >= least}
        got = [(p.left, p.right) for p in pairs_between(left, right, least, 16, exact).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    links, members = linked(df, 0.9, 16)
    assert members.count() == 150 and members.select("rep").distinct().count() == 130 and links.count() < 200
    assert pairs_between(left.limit(0), right, 0.9, 16).count() == pairs_between(left, right.limit(0), 0.1, 16).count() == 0


def shuffled(spark, run):
    """Bytes that run() writes to shuffles."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("least", [0.92, 0.6])
def test_joins_move_less_than_their_vectors(spark, least):
    from notemill.operators.vector_join import pairs_between
    from notemill.session import materialize

    r = np.random.default_rng(8)
    x = r.standard_normal((1500, 64))
    x[1000:1300] = x[:300] + 0.02 * r.standard_normal((300, 64))
    x[1300:1500] = x[:200] + 1.0 * r.standard_normal((200, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = materialize(with_unit(spark.createDataFrame([(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<double>"), dtype=np.float64), "rows")
    left, right = df.where("key < 'k1000'"), df.where("key >= 'k1000'")
    found = []
    assert shuffled(spark, lambda: found.extend(pairs_above(df, least).collect())) < 1500 * 512
    s = np.round(u @ u.T, 9)
    want = {(f"k{i:04d}", f"k{j:04d}") for i, j in np.argwhere(np.triu(s >= least, 1))}
    assert {(p.a, p.b) for p in found} == want and len(found) == len(want) >= 300
    found.clear()
    assert shuffled(spark, lambda: found.extend(pairs_between(left, right, least).collect())) < 1500 * 512
    want = {(f"k{i:04d}", f"k{j + 1000:04d}") for i, j in np.argwhere(s[:1000, 1000:] >= least)}
    assert {(p.left, p.right) for p in found} == want and len(found) == len(want) >= 300


T = {"dup": 0.95, "near_dup": 0.85, "contained_ratio": 0.8, "chunk_match": 0.92}


def test_dedup_kinds_evidence_and_redundancy(spark):
    e = np.eye(8)
    notes = [("a", "h1", e[0] + e[1]), ("b", "h2", e[0] + e[1] + 0.1 * e[2]), ("c", "h3", e[3]), ("d", "H1", e[0] + e[1]), ("e", None, e[5])]
    chunks = [("a", 0, 3, e[0]), ("a", 1, 1, e[1]), ("b", 0, 2, e[0]), ("b", 1, 2, e[1]), ("c", 0, 5, e[3]), ("c", 1, 5, e[3]), ("e", 0, 1, e[3]), ("e", 1, 9, e[4]), ("e", 2, 1, e[6])]
    n = with_unit(spark.createDataFrame([(p, h, v.tolist()) for p, h, v in notes], "path string, text_hash string, vec array<double>"), dim=8, dtype=np.float64)
    c = with_unit(spark.createDataFrame([(p, i, t, v.tolist()) for p, i, t, v in chunks], "note string, idx int, tokens int, vec array<double>"), dim=8, dtype=np.float64)
    assert sorted((r.path, r.first) for r in exact_members(n).collect()) == [("a", "a"), ("d", "a")]
    links = chunk_links(c, T["chunk_match"], 8)
    got = {(r.a, r.b): (r.kind, r.a_in_b, r.b_in_a) for r in related_notes(n, c, links, T, 8).collect()}
    assert got == {("a", "b"): ("duplicate", 1.0, 1.0), ("b", "d"): ("duplicate", 0.0, 0.0), ("c", "e"): ("contained_in", 1.0, 0.3333)}
    cells = [tuple(r) for r in evidence(spark.createDataFrame([("c", "e")], "a string, b string"), c, 8).orderBy("rank").collect()]
    assert cells == [("c", "e", 1, 0, 0, 1.0), ("c", "e", 2, 1, 0, 1.0)]
    inside, across = redundant_inside(links), redundant_across(links)
    assert [tuple(r) for r in inside.collect()] == [("c", 0, 1, 1.0)]
    assert {(r.note, r.chunk, r.found_in, r.found_chunk) for r in across.collect()} >= {("c", 0, "e", 0), ("e", 0, "c", 0)}
    ratio = {r.note: r.redundant_ratio for r in redundant_ratio(c, inside, across).collect()}
    assert ratio == {"a": 1.0, "b": 1.0, "c": 1.0, "e": round(1 / 11, 4)}


def test_folders_tags_similar(spark):
    e = np.eye(64)
    rows = [(f"ml/{i}", "ml", f"t{i}", '["ml", "x"]', (e[0] + 0.1 * e[i + 1]).tolist()) for i in range(4)] + [(f"py/{i}", "py", None, '["py"]', (e[9] + 0.1 * e[i + 10]).tolist()) for i in range(3)] + [("root", "", "r", "oops", e[20].tolist())]
    notes = spark.createDataFrame(rows, "path string, folder string, title string, tags_json string, vec array<double>")
    q = spark.createDataFrame([("q1", None, e[0].tolist()), ("ml/0", "ml/0", rows[0][4]), ("none", None, None), ("zero", None, [0.0] * 64)], "query string, path string, vec array<double>")
    desc = spark.createDataFrame([("empty", "about nothing"), (None, "x")], "folder string, description string")
    got = {(r["query"], r["rank"]): r for r in classify(q, notes, desc, ["_inbox"]).collect()}
    assert {k[0] for k in got} == {"q1", "ml/0"} and got["q1", 1].folder == "ml" and got["q1", 1].confident
    assert got["ml/0", 1].folder == "ml" and got["ml/0", 1].notes == 3
    tags = {r["query"]: (r.tag, r.source) for r in suggest_tags(q.select("query", "vec"), notes, None, k=1).collect()}
    assert tags["q1"] == ("ml", "usage")
    assert suggest_tags(q.select("query", "vec"), notes.limit(1), None).count() == 0
    chunks = spark.createDataFrame([("ml/1", 0, e[5].tolist()), ("ml/1", 1, e[0].tolist())], "note string, idx int, vec array<double>")
    near = similar(q, notes, chunks, k=2).where("query = 'ml/0'").orderBy("rank").collect()
    assert [r.path for r in near] == ["ml/1", "ml/2"] and near[0].chunk == 1 and near[1].chunk is None
    p = {r.label: r for r in profiles(notes.withColumn("label", F.col("folder"))).collect()}
    assert set(p) == {"ml", "py"} and p["ml"]["size"] == 4 and p["py"].representative[0].startswith("py/")
    v = note_vectors(chunks.withColumn("tokens", F.lit(None).cast("int"))).head().vec
    assert abs(v[0] - v[5]) < 1e-9 and abs(v[0] - 0.5**0.5) < 1e-9


def test_linkage_matches_naive():
    r = np.random.default_rng(2)
    x = r.standard_normal((40, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sets = [{i} for i in range(40)]
    d = 1 - x @ x.T
    while True:
        best = min((np.mean([d[i, j] for i in a for j in b]), p, q) for p, a in enumerate(sets) for q, b in enumerate(sets) if p < q)
        if best[0] >= 0.7:
            break
        sets[best[1]] |= sets.pop(best[2])
    got = linkage.labels(x, 0.7)
    assert {frozenset(np.flatnonzero(got == v).tolist()) for v in set(got)} == {frozenset(s) for s in sets}
    assert len(set(linkage.labels(x, None, 7))) == 7
    with pytest.raises(ValueError):
        linkage.labels(x, None, 0)


CJK = "這是一段很長的文字。" * 60


def test_chunks(spark):
    text = f"intro\n\n# A\n\n{CJK}\n\n## B\n\n```python\n# not a heading\n\nx = 1\n```\n\nend\n\n# C\n\nshort"
    got = chunking.chunks_of(text, 20, 200, 300)
    assert all(chunking.tokens(c.units) <= 300 and chunking.tokens(chunking.units(c.text)) == chunking.tokens(c.units) for c in got)
    assert got[-1].path == ("C",) or got[-1].path == ()
    assert any("# not a heading" in c.text for c in got)
    assert chunking.chunks_of(" \n ", 20, 200, 300) == []
    assert len(chunking.chunks_of("字" * 3000, 300, 800, 1024)) >= 4
    df = spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, text string")
    rows = chunking.chunk_texts(df, least=20, most=200, hard=300).collect()
    assert {r.path for r in rows} == {"p"} and sorted(r.idx for r in rows) == list(range(len(rows)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# h\n", "## sub\n", "word " * 30, "字。" * 40, "\n\n", "```\n", "- item\n", "x" * 300, "\n"]), max_size=25))
def test_chunk_invariants(parts):
    text = "".join(parts)
    got = chunking.chunks_of(text, 20, 60, 80)
    for c in got:
        assert 0 <= c.start <= c.end <= len(text)
        assert chunking.tokens(c.units) <= 80 + 10  # a heading line comes on top of a block of the hard limit
    assert [c.start for c in got] == sorted(c.start for c in got)


def test_scan_diff_images(spark):
    files = spark.createDataFrame([("a.MD", ), ("x/.obsidian/b.md",), ("c.svg",), ("d.png",), ("_inbox/e.md",), (None,)], "path string")
    assert {tuple(r) for r in scanned(files, [".obsidian", "_inbox"], [".md"], [".png"]).collect()} == {("a.MD", "document"), ("d.png", "image")}
    f = spark.createDataFrame([("same", 1.0, "A"), ("touch", 2.0, "B"), ("upd", 3.0, None), ("new", 1.0, "n")], "path string, mtime double, hash string")
    n = spark.createDataFrame([("same", 1.0, "x"), ("touch", 1.0, "b"), ("upd", 1.0, "u"), ("gone", 1.0, "g")], "path string, mtime double, hash string")
    d = index_diff(f, n)
    assert {tuple(r) for r in d.collect()} == {("same", "unchanged"), ("touch", "touched"), ("upd", "updated"), ("new", "added"), ("gone", "removed")}
    assert tuple(index_stats(d).head()) == (1, 1, 2, 1, 4)
    docs = spark.createDataFrame([("n2", [("i.png", None, None)]), ("n1", [("i.png", None, None), ("i.png", None, None)]), ("n3", None)], "path string, images array<struct<name:string,path:string,page:int>>")
    assert [tuple(r) for r in image_referrers(docs).collect()] == [("i.png", ["n1", "n2"])]
    refs = spark.createDataFrame([("x/n.md", "p.png"), ("x/n.md", "att/q%20r.png"), ("x/n.md", "deep.png"), ("x/n.md", "http://e/p.png")], "note string, name string")
    at = spark.createDataFrame([("x/p.png",), ("p.png",), ("att/q r.png",), ("z/deep.png",), ("b/deep.png",)], "path string")
    assert {r.name: r.path for r in resolve_images(refs, at).collect()} == {"p.png": "x/p.png", "att/q%20r.png": "att/q r.png", "deep.png": "b/deep.png"}


def test_pdf_pages(spark):
    names = ["", "one", "two", "three", "four"]
    pages = [f"Running Title\nLine of page {names[i]} is wrap-\nped here\nand {names[i]} ends.\n- {i} -" for i in range(1, 5)]
    docs = spark.createDataFrame([("p", pages), ("q", ["one page", ""]), ("r", [])], "path string, pages array<string>")
    got = {r.path: r for r in clean_pages(docs).collect()}
    assert got["p"].header_footer == 8 and got["p"].hyphen_joins == 4 and got["p"].page_numbers == 0
    assert got["p"].text.split("\n\n")[0] == "Line of page one is wrapped here and one ends."
    assert got["q"].text == "one page"


def test_changes(spark):
    ts = "timestamp'2025-01-0{} 00:00:00'"
    runs = spark.sql(f"select * from values (1, {ts.format(1)}, ' OK '), (2, {ts.format(3)}, 'failed'), (3, {ts.format(5)}, 'ok'), (4, null, null) as t(run_id, started_at, status)")
    notes = spark.sql(f"select * from values ('a', 'H1', {ts.format(2)}), ('a', 'h9', {ts.format(4)}), ('b', 'h2', {ts.format(6)}), ('c', null, {ts.format(6)}), ('gone', 'g', {ts.format(5)}), ('early', 'e', timestamp'2024-12-31 00:00:00'), ('nul', 'x', null), (null, 'x', null) as t(path, hash, indexed_at)")
    files = spark.sql(f"select * from values ('a', {ts.format(1)}, 'h1'), ('b', {ts.format(1)}, 'h2'), ('b', {ts.format(2)}, 'h3'), ('c', {ts.format(1)}, 'c'), ('early', {ts.format(1)}, 'e'), ('nul', null, null), ('nul', null, null) as t(path, modification_time, file_hash)")
    want = {("b", "updated"), ("c", "updated"), ("gone", "removed"), ("early", "added"), ("nul", "added")}
    found = changed_paths(files, notes, runs)
    assert {(r.path, r.change_kind) for r in found.collect()} == want
    assert changed_paths(files.limit(0), notes.limit(0), runs.limit(0)).count() == 0

    log = ChangeLog(spark, partitions=3)
    log.capture(found)
    log.capture(found)  # nothing new waits
    assert log.events().count() == 5
    number, start, end = log.plan()
    calls = []

    def fail(rows):
        calls.append(1)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.run(fail)
    log.capture(spark.createDataFrame([("late", "added", "z", None)], "path string, change_kind string, file_hash string, seen timestamp"))
    assert log.plan()[0] == number  # the same plan again, without what came later
    log.run()
    assert {(r.path, r.change_kind) for r in log.sink().collect()} == want
    log.run()
    assert {r.path for r in log.sink().collect()} == {p for p, _ in want} | {"late"} and log.sink().count() == 6
    log.run()
    assert log.sink().count() == 6
    # a change that was committed doesn't come again, though the index wasn't refreshed
    log.capture(found)
    log.run()
    assert log.sink().count() == 6
    # but another change of its path does, and then the first one again
    row = "path string, change_kind string, file_hash string, seen timestamp"
    for h in ("h4", "h3", "h3"):
        log.capture(spark.createDataFrame([("b", "updated", h, None)], row))
        log.run()
    assert [r.file_hash for r in log.sink().where("path = 'b'").orderBy("offset").collect()] == ["h3", "h4", "h3"]
    # a plan that another run wrote first holds, also without its commit
    assert log._write("plans/99", {"from": {}, "to": {}}) and not log._write("plans/99", {"from": {}, "to": {"1": 2}})


def test_what_a_run_reads_does_not_grow_with_the_log(spark):
    row = "path string, change_kind string, file_hash string, seen timestamp"
    read = []

    class Watched(ChangeLog):
        def _events(self, epochs):
            read.append(list(epochs))
            return super()._events(epochs)

    log = Watched(spark, partitions=2)
    for e in range(20):
        log.capture(spark.createDataFrame([(f"p{e}", "added", str(e), None), ("again", "updated", str(e % 2), None)], row))
        if e < 17:
            log.run()
    assert max(map(len, read)) <= 9
    read.clear()
    number, start, end = log.plan()
    assert {r.path for r in log.batch(start, end).collect()} == {"p17", "p18", "p19", "again"} and read == [[17, 18, 19]]
    log.run()
    assert log.sink().count() == 40 and log.last_changes().count() == 21
    log.capture(log.last_changes())  # nothing is new
    log.run()
    assert log.sink().count() == 40
