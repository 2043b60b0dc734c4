import os
import time

import pytest

from notemill.api import Engine, EngineError
from notemill.config import Config
from notemill.sources import vault as sources
from notemill.streaming.inbox import watch

ML = "機器學習模型從資料中學習規律，損失函數衡量誤差。" * 6
PY = "Python functions return values and modules group code together. " * 8
COOK = "把番茄切塊，和雞蛋一起炒，加鹽調味。" * 8


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for folder, text, tag in (("學習/機器學習", ML, "---\ntags: [ml]\n---\n"), ("程式/Python", PY, ""), ("生活/料理", COOK, "")):
        os.makedirs(root / folder)
        for i in range(3):
            (root / folder / f"n{i}.md").write_text(f"{tag}# N{i}\n\n{text}\n\n補充心得 {i} " + "範例。" * (i + 1) + (" #python" if "Py" in folder else ""), encoding="utf-8")
    os.makedirs(root / ".obsidian")
    (root / ".obsidian" / "app.json").write_text("{}")
    os.makedirs(root / "attachments")
    (root / "attachments" / "red.png").write_bytes(b"png")
    (root / "學習/機器學習/with_img.md").write_text("![[red.png]]\n" + ML, encoding="utf-8")
    os.makedirs(root / "tool/scripts")
    (root / "tool/SKILL.md").write_text("---\nname: my tool\n---\nDoes things.")
    (root / "tool/scripts/run.py").write_text("x")
    (root / "big5.txt").write_bytes("繁體中文的文字檔案內容，測試編碼。".encode("big5"))
    cfg = Config(overrides={"vault": str(root), "dim": 256, "chunk": {"min_tokens": 20, "max_tokens": 200, "hard_max": 300}, "thresholds": {"classify_min": 0.3, "tag_min": 0.2, "chunk_match": 0.85}})
    return Engine(spark, cfg, str(tmp_path_factory.mktemp("index"))), root


def test_lifecycle(engine, spark):
    e, root = engine
    with pytest.raises(EngineError) as x:
        e.dedup_all()
    assert x.value.code == "index_empty"
    first = e.refresh()
    assert (first["added"], first["notes_total"], first["images"]) == (12, 12, 1)
    notes = {r.path: r for r in e.table("notes").collect()}
    assert notes["tool/SKILL.md"].kind == "skill" and notes["tool/SKILL.md"].title == "my tool"
    assert notes["學習/機器學習/n0.md"].folder == "學習/機器學習" and '"ml"' in notes["學習/機器學習/n0.md"].tags_json
    assert e.table("images").head().referenced_by == ["學習/機器學習/with_img.md"]
    again = e.refresh()
    assert (again["added"], again["updated"], again["unchanged"]) == (0, 0, 12)
    os.remove(root / "生活/料理/n0.md")
    time.sleep(0.05)
    (root / "生活/料理/n1.md").write_text("# 新\n\n" + COOK + "完全改寫。", encoding="utf-8")
    third = e.refresh()
    assert (third["removed"], third["updated"], third["notes_total"]) == (1, 1, 11)
    assert e.status()["notes"] == 11


def test_ingest(engine, spark):
    e, root = engine
    os.makedirs(root / "_inbox", exist_ok=True)
    (root / "_inbox/new.md").write_text("# new\n\n" + ML + "另外一句話。", encoding="utf-8")
    (root / "_inbox/copy.md").write_bytes((root / "程式/Python/n0.md").read_bytes())
    cfg = {**e.config.data, "inbox": "nothing"}
    docs = sources.documents(sources.scan_vault(spark, str(root), cfg, ["_inbox"]))
    got = e.ingest(docs)
    kinds = {(r.doc, r.target): r.kind for r in got["dedup"].collect()}
    assert kinds.get(("_inbox/copy.md", "程式/Python/n0.md")) == "exact", kinds
    assert any(d == "_inbox/new.md" and t.startswith("學習") for d, t in kinds)
    top = {r["query"]: r.folder for r in got["classify"].where("rank = 1").collect()}
    assert top["_inbox/new.md"] == "學習/機器學習"
    assert {r.tag for r in got["tags"].where("query = '_inbox/new.md'").collect()} >= {"ml"}
    assert got["similar"].where("query = '_inbox/new.md' and rank = 1").head().path.startswith("學習")
    assert got["ratio"].where("note = '_inbox/copy.md'").head().redundant_ratio > 0
    assert e.similar(text="番茄炒雞蛋").where("rank = 1").head().path.startswith("生活")
    pairs = e.dedup_all()
    assert pairs["pairs"].count() > 0
    with pytest.raises(EngineError):
        e.similar()


def test_text_decoding_and_extract(engine, spark):
    e, root = engine
    files = sources.scan_vault(spark, str(root))
    docs = {r.path: r for r in sources.extract(sources.documents(files), 5).collect()}
    assert docs["big5.txt"].kind == "txt" and len(docs["big5.txt"].text) == 5 and docs["big5.txt"].truncated
    assert docs["tool/SKILL.md"].meta.files == ["scripts/run.py"]


def pages_of(pdfs):
    """A back-end for tests: pages are divided by form feeds; a file that begins with ! can't be read."""
    from pyspark.sql import functions as F

    text = F.decode("content", "UTF-8")
    return pdfs.select("path", "content", "mtime", F.when(~text.startswith("!"), F.split(text, "\f")).alias("pages"), F.when(text.startswith("!"), "broken").alias("error"))


def test_pdfs_failures_and_images(spark, tmp_path):
    root = tmp_path / "v"
    os.makedirs(root)
    (root / "a.md").write_text("# A\n\n![[p.png]] " + PY)
    (root / "b.pdf").write_text("\f".join(f"Course Notes\nThe page number {w} has some text of its own that goes on for a while." for w in ("one", "two", "three")))
    (root / "bad.pdf").write_text("!")
    (root / "p.png").write_bytes(b"abc" * 99)
    (root / "q.png").write_bytes(b"abc" * 99)
    (root / "z[1] {x}.md").write_text("# Z\n\n" + COOK)
    (root / "tags.yaml").write_text("python: about code\ncooking: ''\n")
    over = {"vault": str(root), "dim": 256, "tag_list": str(root / "tags.yaml"), "thresholds": {"tag_min": 0.0}}
    e = Engine(spark, Config(overrides=over), str(tmp_path / "i"), pdf=pages_of, auto=True)
    notes = {r.path: r for r in e.table("notes").collect()}  # built when first asked
    assert set(notes) == {"a.md", "b.pdf", "z[1] {x}.md"} and notes["b.pdf"].title == "Course Notes" and notes["b.pdf"].kind == "pdf"
    assert [tuple(r) for r in e.table("failed").collect()] == [("bad.pdf", "broken")]
    pictures = {r.path: r for r in e.table("images").collect()}
    assert set(pictures) == {"p.png", "q.png"} and pictures["p.png"].referenced_by == ["a.md"] and len(pictures["q.png"].vec) == 256
    assert [(r.a, r.b, r.kind) for r in e.image_pairs().collect()] == [("p.png", "q.png", "image_exact")]
    assert e.similar(image=spark.createDataFrame([("x", bytearray(b"abc" * 99))], "query string, content binary"), text="t").count() == 2
    again = e.refresh()
    assert (again["added"], again["updated"], again["unchanged"], again["failed"], again["notes_total"]) == (0, 0, 3, 1, 3) and again["seconds"] > 0
    time.sleep(0.05)
    (root / "b.pdf").write_text("!now broken")  # its old row stays, and it is tried again
    (root / "bad.pdf").write_text("mended" * 30)
    (root / "z[1] {x}.md").write_text("# Z\n\n" + COOK + "x")
    third = e.refresh()
    assert (third["added"], third["updated"], third["failed"], third["notes_total"]) == (1, 1, 1, 4)
    assert e.table("notes").where("path = 'b.pdf'").head().title == "Course Notes" and e.table("chunks").where("note = 'b.pdf'").count() > 0
    assert e.refresh()["failed"] == 1
    docs = sources.documents(sources.scan_vault(spark, str(root), e.config, ["a.md"]))
    queries, chunks = e.queries(docs)
    assert {r.tag for r in e.tags(queries).collect()} == {"python", "cooking"}
    assert [(r.image, r.target, r.kind) for r in e.dedup_images(e.pictures_of(docs)).collect()] == [("p.png", "q.png", "image_exact")]
    assert Engine(spark, Config(overrides=over), str(tmp_path / "j")).refresh()["failed"] == 2  # no back-end for PDFs


def test_documents_asked_together_answer_as_alone(engine, spark):
    e, root = engine
    both = sources.documents(sources.scan_vault(spark, str(root), e.config, ["程式/Python/n0.md", "程式/Python/n1.md"]))
    alone = []
    for i in (0, 1):
        q, c = e.queries(both.where(f"path = '程式/Python/n{i}.md'"))
        alone.append([e.dedup(q, c), e.redundant(q, c)["cross_vault"], e.redundant(q, c)["ratio"], e.tags(q)])
    q, c = e.queries(both)
    together = [e.dedup(q, c), e.redundant(q, c)["cross_vault"], e.redundant(q, c)["ratio"], e.tags(q)]
    for n, df in enumerate(together):
        rows = sorted(map(tuple, df.collect()), key=repr)
        assert rows == sorted((tuple(r) for a in alone for r in a[n].collect()), key=repr)
        assert rows or n == 3


def test_settings_and_back_ends(tmp_path, monkeypatch):
    from notemill.api import EMBEDDERS, embedder_of
    from notemill.config import DEFAULTS, overlaid

    base = {"a": {"b": 1, "c": {"d": [1]}}, "e": 2, "g": {"h": 1}}
    assert overlaid(base, {"a": {"c": {"x": 3}, "b": {"y": 1}}, "g": 5}, None, {"e": {}}) == {"a": {"b": {"y": 1}, "c": {"d": [1], "x": 3}}, "e": {}, "g": 5}
    over = overlaid(base, {"a": {"c": {}}})
    assert over == base and over["a"]["c"]["d"] is not base["a"]["c"]["d"]
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("NOTEMILL_CONFIG", raising=False)
    assert Config().data == DEFAULTS
    (tmp_path / "notemill.json").write_text('{"dim": 32, "thresholds": {"dup": 0.9}}')
    assert Config()["dim"] == 32 and Config().threshold("dup") == 0.9 and Config().threshold("near_dup") == 0.85
    (tmp_path / "other.yaml").write_text("dim: 16")
    assert Config(overrides={"dim": 8})["dim"] == 8 and Config("other.yaml")["dim"] == 16
    monkeypatch.setenv("NOTEMILL_CONFIG", "other.yaml")
    assert Config()["dim"] == 16 and embedder_of(Config()).dim == 16
    with pytest.raises(FileNotFoundError):
        Config("missing.yaml")
    with pytest.raises(ValueError):
        Config().vault
    with pytest.raises(EngineError):
        embedder_of(Config(overrides={"backend": "other"}))
    monkeypatch.setitem(EMBEDDERS, "other", lambda config: config["dim"])
    assert embedder_of(Config(overrides={"backend": "other"})) == 16


def test_inbox_stream(spark, tmp_path):
    for d in ("in", "out", "cp"):
        os.makedirs(tmp_path / d)
    (tmp_path / "in/a.md").write_text("# A\n\ntext")
    run = lambda: watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/b.txt").write_text("plain")
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.title for r in rows) == ["A", "b"]


def test_images_tags_and_command_line(engine, spark, tmp_path, capsys):
    e, root = engine
    v = spark.createDataFrame([("attachments/red.png", [1.0] + [0.0] * 255), ("b.png", [0.99, 0.1] + [0.0] * 254)], "path string, vec array<double>")
    assert [(r.a, r.b, r.kind) for r in e.image_pairs(v).collect()] == [("attachments/red.png", "b.png", "image_duplicate")]
    q = spark.createDataFrame([("new.png", "x", [1.0] + [0.0] * 255, ["b.png"])], "image string, file_hash string, vec array<double>, own array<string>")
    got = e.dedup_images(q, v).collect()
    assert [(r.target, r.kind) for r in got] == [("attachments/red.png", "image_duplicate")] and got[0].referenced_by
    near = e.similar_images(q.selectExpr("image as query", "vec"), v, 1).head()
    assert near.path == "attachments/red.png" and near.score == 1.0
    top = e.propose_tags(distance=0.6).head()
    assert top["size"] >= 3
    with pytest.raises(EngineError):
        e.propose_tags(0)

    import json

    from notemill.__main__ import main, plain

    assert main(["--index", str(tmp_path / "none"), "--vault", str(root), "status"]) == 0
    assert json.loads(capsys.readouterr().out)["result"]["notes"] == 0
    assert main(["--index", str(tmp_path / "none"), "--vault", str(root), "dedup"]) == 1
    assert main(["--index", str(tmp_path / "none"), "extract", "x"]) == 2
    capsys.readouterr()
    assert main(["--index", str(tmp_path / "none"), "--vault", str(root), "extract", "tool", "--max-chars", "4"]) == 0
    assert json.loads(capsys.readouterr().out)["result"][0]["text"] == "Does"
    assert plain({"a": spark.range(1)}) == {"a": [{"id": 0}]}
