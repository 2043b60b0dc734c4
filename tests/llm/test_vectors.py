import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import history, neighbours, themes
from notemill.llm.components import components
from notemill.llm.hierarchy import LEVELS, condensed, spanning
from notemill.llm.history import EMPTY_TEXT, HistoryIndex
from notemill.llm.neighbours import footrule, similar_pairs, similar_to
from notemill.functions.vectors import with_unit
from notemill.llm.pivots import distinct_entries, fit_pivots, lists_of, permute, pivot_at

SCHEMA = "path string, vec array<float>, u int, key string, cell int, rep string"


def table(spark, x, extra=()):
    rows = [(f"p{i:04d}", v.tolist(), 1, "x", None, "y") for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


ODD = [("null", None, 1, "", 1, ""), ("zero", [0.0] * 64, 1, "", 1, ""), ("short", [1.0, 2.0], 1, "", 1, ""), ("nan", [float("nan")] * 64, 1, "", 1, ""), (None, [1.0] * 64, 1, "", 1, "")]


def vectors(seed=0, n=900):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 64)).astype(np.float32)
    m = n // 3
    x[m : 2 * m] = x[:m] + 0.35 * r.standard_normal((m, 64))
    x[-40:] = x[0]  # many copies of one vector
    x[-60:-50] *= 20
    return x


def brute(x, least, k):
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    out = set()
    for i in range(len(x)):
        c = [(-round(s[i, j], 5), j) for j in np.flatnonzero(s[i] >= least) if j != i]
        out |= {(f"p{i:04d}", f"p{j:04d}") for _, j in sorted(c)[:k]}
    return out


def test_footrule_is_the_footrule():
    r = np.random.default_rng(1)
    q, o = (np.array([r.permutation(20)[:5] for _ in range(6)], np.uint16) for _ in range(2))

    def plain(a, b):
        pa, pb = {v: i for i, v in enumerate(a)}, {v: i for i, v in enumerate(b)}
        return sum(abs(pa.get(v, 5) - pb.get(v, 5)) for v in set(a) | set(b))

    assert footrule(q, o, 20).tolist() == [[plain(a, b) for b in o] for a in q]


@pytest.mark.parametrize("block", [6000, 150])
def test_similar_pairs(spark, block):
    x = vectors()
    got = similar_pairs(table(spark, x, ODD), "path", "vec", 5, 0.9, pivots=48, block=block)
    found = {(r.path, r.neighbour) for r in got.collect()}
    want = brute(x, 0.9, 5)
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(want)
    assert ("p0860", "p0000") in found  # copies know each other, the least first
    assert all(r.cosine >= 0.9 for r in got.collect())


def test_pivots_are_distinct_however_many_copies(spark):
    x = vectors(5)
    near = x[0] + 0.2 * np.random.default_rng(6).standard_normal((60, 64)).astype(np.float32)
    x[840:] = near * np.linalg.norm(x[0]) / np.linalg.norm(near, axis=1)[:, None]
    x[300:600] = x[0]  # a third of the rows
    df = table(spark, x, ODD).where("path is not null")
    rows, members, entries = distinct_entries(df, "path", "vec", 64)
    base = fit_pivots(entries, 64, 48)
    assert len(base) == 48 and len(np.unique(base, axis=0)) == 48
    assert (rows.count(), members.count(), entries.count()) == (900, 301, 600)
    assert len(fit_pivots(entries, 64, 5000)) == 600
    found = {(r.path, r.neighbour) for r in similar_pairs(df, "path", "vec", 5, 0.9, pivots=48).collect()}
    want = brute(x, 0.9, 5)
    close = {w for w in want if w[0] >= "p0840"}
    assert len(close) == 300 and len(found & close) >= 0.97 * len(close)
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(want)


def test_long_lists_are_divided_by_pivots_of_their_own(spark):
    """A clump of rows that are all alike, longer than lists are meant to be: told apart by pivots among them, in bounded lists."""
    r = np.random.default_rng(1)
    v = r.standard_normal(64)
    clump = np.repeat(v / np.linalg.norm(v) + 0.05 * r.standard_normal((1500, 64)), 5, axis=0) + 0.02 * r.standard_normal((7500, 64))
    x = np.concatenate([r.standard_normal((2500, 64)), clump]).astype(np.float32)
    _, _, entries = distinct_entries(table(spark, x).select(F.col("path").alias("key"), "vec"), "key", "vec", 64)
    base = fit_pivots(entries, 64, 6)
    rows = permute(entries, base, 64, 6)
    plain = rows.withColumn("cell", F.explode(F.array(*[pivot_at(i) for i in range(4)]))).groupBy("cell").count().agg(F.max("count")).head()[0]
    posted = lists_of(rows, 4, 64)
    longest = posted.groupBy("cell").count().agg(F.max("count")).head()[0]
    assert plain > 6000 and longest < 4000
    assert posted.select("rep").distinct().count() == 10_000
    got = {}
    for p in similar_pairs(table(spark, x), "path", "vec", k=5, min_cosine=0.8, pivots=6).collect():
        got.setdefault(p.path, set()).add(p.neighbour)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = total = 0
    for i in range(2500, 10_000, 75):
        s = u @ u[i]
        s[i] = -2
        want = {f"p{j:04d}" for j in np.argsort(-s)[:4] if s[j] >= 0.8}
        hit, total = hit + len(want & got.get(f"p{i:04d}", set())), total + len(want)
    assert total > 390 and hit / total >= 0.9


@pytest.mark.parametrize("n", [5500, 7500])
def test_similar_pairs_are_all_found_at_any_size(spark, n):
    """Rows that are alike in fives, all near one direction: fewer and more of them than a pivot's list may have before it is divided."""
    r = np.random.default_rng(2)
    v = r.standard_normal(64)
    x = np.repeat(v / np.linalg.norm(v) + 0.05 * r.standard_normal((n // 5, 64)), 5, axis=0) + 0.02 * r.standard_normal((n, 64))
    x = x.astype(np.float32)
    got = similar_pairs(table(spark, x, ODD), "path", "vec", k=5, min_cosine=0.9, pivots=6)
    assert {(p.path, p.neighbour) for p in got.collect()} == brute(x.astype(float), 0.9, 5)


@pytest.mark.parametrize("block", [6000, 170])
def test_similar_pairs_of_any_cosine_and_ties(spark, block):
    """All pairs count, a third of the rows are so near each other that most of their cosines are equal in 5 decimals."""
    x = vectors(7)
    x[300:600] = x[300] + 2e-3 * np.random.default_rng(8).standard_normal((300, 64))
    got = similar_pairs(table(spark, x, ODD), "path", "vec", k=5, block=block).collect()
    assert {(p.path, p.neighbour) for p in got} == brute(x.astype(float), -2, 5) and len(got) == 5 * 900


def test_a_cosine_at_the_threshold_counts(spark):
    x = np.zeros((2, 64))
    x[0, 0], x[1, :4] = 1, (9, 3, 3, 1)
    assert {(p.path, p.neighbour) for p in similar_pairs(table(spark, x), "path", "vec", min_cosine=0.9).collect()} == {("p0000", "p0001"), ("p0001", "p0000")}


def test_compared_rows_stay_the_same_as_the_table_grows(spark):
    """Rows of a list that one row meets, by the lists' lengths, over synthetic rows and few pivots (as beyond MAX_PIVOTS)."""
    met = []
    for n in (10_000, 40_000, 160_000):
        rows = spark.range(n).select(F.col("id").alias("rep"), F.randn(1).alias("x"), F.randn(2).alias("y"), F.randn(3).alias("z"), F.randn(4).alias("w"))
        entries = with_unit(rows.select("rep", F.array(*[F.col(c).cast("float") for c in "xyzw"]).alias("vec")), dim=4)
        base = np.eye(4, dtype=np.float32)
        c = lists_of(permute(entries, base, 4, 2), 2, 4).groupBy("cell").count()
        met.append(c.agg(F.sum(F.col("count") * F.col("count"))).head()[0] / n)
    assert met[2] < 1.5 * met[0]


def test_similar_to_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "ASK_BLOCK", 5)
    x = vectors(2, 1200)
    df = table(spark, x, ODD)
    ask = df.where(F.expr("try_cast(substring(path, 2, 4) as int) % 50 = 0"))
    rows = similar_to(ask, df, "path", "vec", 5, pivots=48).collect()
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    hit = total = 0
    for i in range(0, 1200, 50):
        s = u @ u[i]
        s[i] = -2
        mine = [r for r in rows if r.path == f"p{i:04d}"]
        assert len(mine) == 5 and all(abs(r.cosine - s[int(r.neighbour[1:])]) < 1e-5 for r in mine)
        hit += sum(s[int(r.neighbour[1:])] >= np.sort(s)[-5] - 1e-9 for r in mine)
        total += 5
    assert hit >= 0.9 * total


def test_empty_vector_tables(spark):
    none = table(spark, np.zeros((0, 64)), ODD)
    assert similar_pairs(none, "path", "vec").count() == 0
    assert similar_to(none, none, "path", "vec").count() == 0
    assert themes.themes(none, "path", "vec").count() == 0
    one = table(spark, np.ones((1, 64)), ODD)
    assert similar_pairs(one, "path", "vec").count() == 0
    assert themes.themes(one, "path", "vec").count() == 0


def test_spanning_is_minimal():
    r = np.random.default_rng(0)
    for _ in range(20):
        n, m = 12, 40
        i, j, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(0, 6, m).astype(float)
        keep = spanning(n, i, j, w)
        top = list(range(n))

        def root(x):
            while top[x] != x:
                x = top[x]
            return x

        cost = count = 0
        for e in np.argsort(w, kind="stable"):
            a, b = root(i[e]), root(j[e])
            if a != b:
                top[a] = b
                cost += w[e]
                count += 1
        assert (w[keep].sum(), len(keep)) == (cost, count)


def groups_by_hand(edges, least):
    """Chosen clusters of a graph as sets of nodes, by following every component from level to level."""
    nodes = {n for a, b, _ in edges for n in (a, b)}
    comp = {n: frozenset([n]) for n in nodes}
    state = {}  # a component that is a cluster: [name, stability, below, since]
    tree, joined = {}, {}
    for l in sorted({e[2] for e in edges}):
        before = set(comp.values())
        for a, b, w in edges:
            if w == l and comp[a] != comp[b]:
                both = comp[a] | comp[b]
                comp.update((n, both) for n in both)
        for c in set(comp.values()) - before:
            parts = [p for p in before if p <= c]
            big = [p for p in parts if p in state]
            now = {p: state[p][1] + len(p) * (l - state[p][3]) for p in big}
            if len(big) == 1:
                state[c] = [state[big[0]][0], now[big[0]], state[big[0]][2], l]
            elif len(c) >= least:
                state[c] = [(l, c), 0.0, sum(max(now[p], state[p][2]) for p in big), l]
                for p in big:
                    tree[state[p][0]] = ((l, c), now[p] >= state[p][2])
            if c in state:
                for p in parts:
                    if p not in state:
                        joined.update((n, state[c][0]) for n in p)
    live = [c for c in set(comp.values()) if c in state]
    for c in live:
        name, stable, below, since = state[c]
        tree[name] = (None, stable + len(c) * (LEVELS - since) >= below and not (len(live) == 1 and below > 0))
    out = {}
    for n, name in joined.items():
        best = None
        while name is not None:
            up, ok = tree[name]
            best = name if ok else best
            name = up
        if best is not None:
            out.setdefault(best, set()).add(n)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy_is_the_same_in_one_task_and_by_joins(spark, seed):
    r = np.random.default_rng(seed)
    n = 90
    at = np.concatenate([r.normal(c, s, n // 3) for c, s in ((0, 1), (12, 2), (40, 1))])
    pairs = [(int(a) * 7 - 50, int(b) * 7 - 50, int(min(LEVELS, abs(at[a] - at[b]) * 6 + r.integers(0, 5))) // 8 * 8) for a in range(n) for b in range(a + 1, n) if abs(at[a] - at[b]) < 9]
    edges = spark.createDataFrame(pairs, "a long, b long, level int")
    want = groups_by_hand(pairs, 6)
    assert len(want) >= 2
    for at_once in (2_000_000, 40, 0):
        got = {}
        for x in condensed(edges, 6, at_once).collect():
            got.setdefault(x.theme, set()).add(x.node)
        assert {frozenset(v) for v in got.values()} == want, at_once


def planted(seed, sizes, noise):
    r = np.random.default_rng(seed)
    mean = np.linalg.qr(r.standard_normal((64, len(sizes))))[0].T
    x = [0.62 * m + 0.78 * v / np.linalg.norm(v) for m, n in zip(mean, sizes) for v in r.standard_normal((n, 64))]
    y = r.standard_normal((noise, 64))
    return np.array([*x, *y], np.float32), np.array([*np.repeat(np.arange(len(sizes)), sizes), *[-1] * noise])


@pytest.mark.parametrize("at_once", [2_000_000, 450])
def test_themes_found(spark, at_once):
    x, truth = planted(3, [260, 180, 120], 20)
    got = {r.path: r.theme for r in themes.themes(table(spark, x, ODD), "path", "vec", at_once=at_once).collect()}
    assert set(got) <= {f"p{i:04d}" for i in range(len(x))}
    label = [got.get(f"p{i:04d}") for i in range(len(x))]
    of = [{label[i] for i in np.flatnonzero(truth == t)} for t in range(3)]
    assert all(len(v - {None}) == 1 for v in of) and len({v for v in label if v}) == 3
    assert sum(label[i] is not None for i in np.flatnonzero(truth >= 0)) >= 0.98 * 560
    assert sum(label[i] is not None for i in np.flatnonzero(truth == -1)) <= 1


def test_a_small_theme_beside_large_ones(spark):
    x, truth = planted(5, [1500, 1400, 45], 40)
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0)])  # many copies of one vector are one node
    got = {r.path: r.theme for r in themes.themes(table(spark, x), "path", "vec").collect()}
    small = [got.get(f"p{i:04d}") for i in np.flatnonzero(truth == 2)]
    assert len(set(small) - {None}) == 1 and small.count(None) <= 15  # its fringe joins later than the rest of the collection
    assert not set(small) & {got.get(f"p{i:04d}") for i in np.flatnonzero((truth == 0) | (truth == 1))} - {None} and len(set(got.values())) == 3
    assert {got[f"p{i:04d}"] for i in range(len(truth), len(x))} == {got["p0000"]}


def test_theme_descriptions(spark):
    members = spark.createDataFrame([("a", 0, 0.9, 2.0), ("b", 0, 0.8, 2.0), ("c", 0, 0.95, 1.0)], "path string, theme int, cosine double, persistence double")
    notes = spark.createDataFrame([("a", '["#X", "y"]', "f"), ("b", "x, z", "f"), ("c", None, None)], "path string, tags_json string, folder string")
    r = themes.describe(members, notes).head()
    assert (r["size"], r.exemplars, r.tags[0], r.folder) == (3, ["a", "b", "c"], "x", "f")


def test_components(spark):
    r = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    assert got == {n: root(n) for n in top}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "item_id long, batch_no int, arrived_at timestamp, text_hash string, vec array<float>, bucket int, o string"


def verdicts(known, items):
    hashes = {h.lower() for h, _ in known if h and h.lower() != EMPTY_TEXT}
    vecs = [v for _, v in known if v is not None]
    out = {}
    for i, b, h, v in sorted({x[0]: x for x in items}.values(), key=lambda x: (x[1] if x[1] is not None else 1 << 40, x[0])):
        h = h.lower() if h and h.lower() != EMPTY_TEXT else None
        u = None if v is None or not np.any(v) else np.array(v) / np.linalg.norm(v)
        if h in hashes and h:
            out[i] = "exact"
        elif u is not None and any(u @ w >= 0.95 for w in vecs):
            out[i] = "near"
        else:
            out[i] = "accepted"
            hashes |= {h} if h else set()
            vecs += [u] if u is not None else []
    return out


def test_batches_against_history(spark, monkeypatch):
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v)
    base = [unit(v) for v in r.standard_normal((60, 64))]
    known = [(f"H{i}", v) for i, v in enumerate(base[:30])] + [(None, None), (EMPTY_TEXT.upper(), base[40])]
    items = []
    for i in range(160):
        kind = r.integers(0, 6)
        v = base[r.integers(0, 60)]
        v = [v, unit(v + 0.03 * r.standard_normal(64)), unit(r.standard_normal(64)), np.zeros(64), None, v * 7][kind]
        h = [None, f"h{r.integers(0, 40)}", f"new{r.integers(0, 20)}", EMPTY_TEXT, f"own{i}", f"OWN{i}"][r.integers(0, 6)]
        items.append((i, int(r.integers(1, 5)) if i % 17 else None, h, None if v is None else v.tolist()))
    want = verdicts(known, items)
    assert len(set(want.values())) == 3
    df = spark.createDataFrame([(i, b, None, h, v, 1, "x") for i, b, h, v in items + items[:9]], ITEM)
    first = spark.createDataFrame([(h, None if v is None else bytearray(np.asarray(v, np.float32).tobytes())) for h, v in known], "text_hash string, u binary")

    whole = HistoryIndex(spark)
    whole.append(first)
    assert {r.item_id: r.verdict for r in whole.check(df).collect()} == want

    steps = HistoryIndex(spark)  # the same, batch by batch
    steps.append(first)
    got = {}
    for b in (1, 2, 3, 4, None):
        steps = HistoryIndex(spark, steps.path)  # opened anew, as by another session
        got |= {r.item_id: r.verdict for r in steps.check(df.where(F.col("batch_no").eqNullSafe(F.lit(b)))).collect()}
    assert got == want

    assert len(steps.parts()) == 6
    monkeypatch.setattr(history, "SENT", 0)  # joined by shuffles
    monkeypatch.setattr(history, "AT_ONCE", 0)  # decided in rounds
    monkeypatch.setattr(history, "FAN", 2)  # parts merged at once
    rounds = HistoryIndex(spark)
    rounds.append(first)
    assert {r.item_id: r.verdict for r in rounds.check(df).collect()} == want
    assert len(rounds.parts()) < 6 and rounds.parts()[-1][1] == 5
    assert rounds.vectors().count() == rounds.vectors().select("ref").distinct().count() == len(known) - 1 + sum(v == "accepted" and items[i][3] is not None and any(items[i][3]) for i, v in want.items())

    assert HistoryIndex(spark).check(df.limit(0)).count() == 0
    assert HistoryIndex(spark).check(df, append=False).where("verdict = 'accepted'").count() > 0


def test_what_a_batch_reads_goes_by_the_batch(spark):
    """The rows of history that a batch of two reads, with history ten times as long: as many, since it has ten times the buckets."""
    count = {}
    for n in (800, 8000):
        read = []

        class Watched(HistoryIndex):
            def _read(self, name, *rest):
                read.append((name, super()._read(name, *rest)))
                return read[-1][1]

        x = np.random.default_rng(8).standard_normal((n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1)[:, None]
        index = Watched(spark, bucket_keys=100)
        index.append(spark.createDataFrame([(f"h{i}", bytearray(v.tobytes())) for i, v in enumerate(x)], "text_hash string, u binary"))
        items = spark.createDataFrame([(1, 1, None, "H7", None, 1, "x"), (2, 1, None, None, x[9].tolist(), 1, "x")], ITEM)
        assert {r.item_id: r.verdict for r in index.check(items).collect()} == {1: "exact", 2: "near"}
        count[n] = {name: df.count() for name, df in read}
        assert set(count[n]) == {"keys", "vectors"}
    assert all(count[8000][t] < 2 * count[800][t] + 60 for t in count[800]) and count[8000]["keys"] < 0.05 * 8000 * 16


def test_long_chains_and_one_hash_for_all(spark):
    e = np.eye(64)
    step = np.arccos(0.97)
    chain = [(i, 1, f"c{i}", (np.cos(i * step) * e[0] + np.sin(i * step) * e[1]).tolist()) for i in range(12)]
    same = [(100 + i, 2, "Same", None) for i in range(40)]
    rows = chain + same
    df = spark.createDataFrame([(i, b, None, h, v, 1, "x") for i, b, h, v in rows], ITEM)
    assert {r.item_id: r.verdict for r in HistoryIndex(spark).check(df).collect()} == verdicts([], rows)
