import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from seamark import config
from seamark.api import Engine
from seamark.functions.embedding import HttpEmbedder
from seamark.operators import store
from seamark.sources import repo_files
from seamark.sources.repo_files import read_repo
from seamark.streaming.ingest import ingest


def put(root, rel, body):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(body)


def test_scan(spark, tmp_path):
    root = str(tmp_path / "repo")
    for rel in ("src/main.java", "test.txt", "node_modules/a.js", ".git/x.js", "_own/y.ts", "a/b/c/deep.java"):
        put(root, rel, "class A { void run() { } }")
    put(root, "large.java", "x" * (2 << 20))
    got = {r.rel_path: r.disposition for r in read_repo(spark, root).collect()}
    assert got == {"src/main.java": "kept", "test.txt": "unsupported", "_own/y.ts": "kept", "a/b/c/deep.java": "kept", "large.java": "too_large"}


def test_index_search_status(spark, tmp_path):
    root = str(tmp_path / "repo")
    put(root, "src/Log.java", "public class Log {\n  public void writeLogger(String s) {\n    out(s);\n  }\n}\n")
    put(root, "src/user.go", "func user() {\n  return 1\n}\n")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.status(root)["status"] == "not_indexed"
    assert e.index(root).files == 2
    first = {r.id for r in e.vectors.read(root).collect()}
    assert e.index(root).files == 0 and {r.id for r in e.vectors.read(root).collect()} == first
    s = e.status(root)
    assert s["status"] == "completed" and s["total_files"] == 2 and s["languages"] == {"java": 1, "go": 1}
    put(root, "src/user.go", "func user() {\n  return 2\n}\n")
    os.remove(os.path.join(root, "src/Log.java"))
    put(root, "src/Auth.java", "public class Auth {\n  public void logger() {\n    x();\n  }\n}\n")
    e.index(root)
    assert {r.file_path for r in e.vectors.read(root).select("file_path").collect()} == {"src/user.go", "src/Auth.java"}
    out = e.format(e.search("logger", root))
    assert "EXACT MATCH" in out and "src/Auth.java" in out
    e.clear_cache(root)
    assert e.index(root).files == 2 and e.vectors.read(root).count() == len({r.id for r in e.vectors.read(root).collect()})
    assert "error" in e.call("semantic_search", {"query": "", "repo_path": root})
    schema = "repo_path string, rel_path string, language string, content string"
    spark.createDataFrame([(root, "new.go", "go", "func fresh() {\n  return 3\n}")], schema).write.parquet(str(tmp_path / "in"))
    ingest(e, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.file_path for r in e.vectors.read(root).select("file_path").collect()} == {"src/user.go", "src/Auth.java", "new.go"}


def listing(path):
    return {os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_scan_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repo_files, "PART_FILES", 7)
    root = str(tmp_path / "repo")
    for i in range(30):
        put(root, f"src/deep/f{i}.go", "x" * i)
    reader = repo_files._Reader({"path": root})
    parts = reader.partitions()
    assert len(parts) == 5 and sorted(r[2] for p in parts for r in reader.read(p)) == sorted(f"src/deep/f{i}.go" for i in range(30))
    with pytest.raises(FileNotFoundError):
        repo_files._Reader({"path": root + "/no"})
    put(root, "file", "")
    with pytest.raises(NotADirectoryError):
        repo_files._Reader({"path": root + "/file"})
    os.makedirs(str(tmp_path / ".hidden/a"))
    reader = repo_files._Reader({"path": str(tmp_path / ".hidden")})
    assert not [r for p in reader.partitions() for r in reader.read(p)]


def test_a_write_leaves_other_repositories_alone(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    schema = "rel_path string, language string, content string"
    for k in "ab":
        e.index(k, files=spark.createDataFrame([(f"{k}{i}.go", "go", f"func f{i}() {{\n  return {i}\n}}") for i in range(3)], schema))
    of_b = {p for p in listing(tmp_path / "store") if store.paths_key("b") in p}
    before = {p: os.stat(p).st_mtime_ns for p in of_b}
    e.index_some("a", spark.createDataFrame([("a9.go", "go", "func nine() {\n  return 9\n}")], schema))
    e.clear_cache("a")
    now = listing(tmp_path / "store")
    assert of_b and {p: os.stat(p).st_mtime_ns for p in of_b} == before and {p for p in now if store.paths_key("b") in p} == of_b
    assert e.vectors.read("a").select("file_path").distinct().count() == 4 and e.vectors.read().select("repo_path").distinct().count() == 2
    e.delete_repo("a")
    assert e.vectors.read("a").count() == 0 and e.vectors.read("b").count() == 3 and e.status("a")["status"] == "not_indexed"
    for i in range(3):  # data that no manifest names goes
        e.index("b", force=True, files=spark.createDataFrame([("b.go", "go", f"func f() {{\n  return {i}\n}}")], schema))
    assert len([p for p in listing(tmp_path / "store/chunks") if store.paths_key("b") in p]) <= 3 and len(e.vectors.versions()) == 2


def test_two_writers(spark, tmp_path):
    row = lambda repo, path: spark.createDataFrame([(repo, path, "h", None, 1, None)], store.HASHES)
    a, b = (store.Table(spark, str(tmp_path / "t"), store.HASHES) for _ in range(2))
    a.replace(row("r0", "x"), ["r0"])
    # b begins, a commits another repository in between: both stay.
    base, before = b.current()
    a.replace(row("r1", "y"), ["r1"])
    b._commit(base, before, {store.paths_key("r0"): None})
    assert [r.repo_path for r in a.read().collect()] == ["r1"] and a.read("r0").count() == 0
    # The same one: the second fails.
    base, before = b.current()
    a.replace(row("r1", "z"), ["r1"])
    with pytest.raises(store.Conflict):
        b._commit(base, before, {store.paths_key("r1"): None})
    assert [r.path for r in b.read("r1").collect()] == ["z"]
    with pytest.raises(ValueError):
        a.replace(row("r2", "z"), ["r1"])
    threads = [threading.Thread(target=lambda k=k: store.Table(spark, str(tmp_path / "t"), store.HASHES).replace(row(f"t{k}", "p"), [f"t{k}"])) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r.repo_path for r in a.read().collect()} == {"r1", "t0", "t1", "t2", "t3"}


def test_index_knows_its_vectors(spark, tmp_path):
    schema = "rel_path string, language string, content string"
    Engine(spark, str(tmp_path / "s")).index("r", files=spark.createDataFrame([("a.go", "go", "func f() {\n  return 1\n}")], schema))
    with pytest.raises(ValueError, match="dimension"):
        Engine(spark, str(tmp_path / "s"), config.Config(dimensions=128)).search("f", "r")
    with pytest.raises(ValueError, match="metric"):
        Engine(spark, str(tmp_path / "s"), config.Config(metric="dot")).search("f", "r")
    for bad in ({"metric": "manhattan"}, {"embedder": "none"}, {"embed_in_flight": 0}):
        with pytest.raises(ValueError):
            config.Config(**bad)


def test_settings_decide(spark, tmp_path):
    schema = "rel_path string, language string, content string"
    lines = "\n".join(f"word{i} one two three" for i in range(100))
    big = "class B {\n" + "".join(f"  void m{i}() {{\n    int a = {i};\n  }}\n" for i in range(200)) + "}\n"
    files = spark.createDataFrame([("a.go", "go", lines), ("B.java", "java", big)], schema)
    n = {}
    for name, c in (("plain", config.Config()), ("small", config.Config(small_max_tokens=60, hierarchy=False))):
        e = Engine(spark, str(tmp_path / name), c)
        e.index("r", files=files)
        got = e.vectors.read("r").collect()
        n[name] = sum(r.file_path == "a.go" for r in got), {r.chunk_type for r in got if r.file_path == "B.java"}, [r for r in got if r.parent_chunk_id]
    assert n["plain"][0] < n["small"][0] and n["plain"][1] == {"class", "method"} and "class" in n["small"][1] and not n["small"][2]
    by_id = {r.id: r for r in Engine(spark, str(tmp_path / "plain")).vectors.read("r").collect()}
    assert len(n["plain"][2]) == 200 and all(by_id[r.parent_chunk_id].class_name == "B" and by_id[r.parent_chunk_id].chunk_type == "class" and r.indexed_at for r in n["plain"][2])
    c = config.load(None, {"SEAMARK_CONFIG": str(tmp_path / "no"), "OLLAMA_URL": "http://x:1"})
    assert c.embedder == "http" and c.embedding_url == "http://x:1" and isinstance(c.make_embedder()(), HttpEmbedder)
    (tmp_path / "c.json").write_text(json.dumps({"search": {"max_results": 9}, "chunking": {"hierarchy": False}, "ignore": ["x/**"]}))
    c = config.load(str(tmp_path / "c.json"), {})
    assert (c.max_results, c.hierarchy, c.ignore, c.embedder) == (9, False, ("x/**",), "hash")


class _Server(BaseHTTPRequestHandler):
    now, most, seen, lock = 0, 0, [], threading.Lock()

    def do_POST(self):
        q = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with self.lock:
            _Server.now += 1
            _Server.most = max(_Server.most, _Server.now)
            _Server.seen.append((self.path, q["model"], len(q["prompt"])))
        time.sleep(0.02)
        with self.lock:
            _Server.now -= 1
        n = 3 if q["prompt"] == "short" else 8
        self.send_response(500 if q["prompt"] == "fail" else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"embedding": [float(len(q["prompt"])), 3.0, 4.0, *[1.0] * (n - 3)]}).encode())

    def log_message(self, *a):
        pass


def test_model_server(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        e = HttpEmbedder(url, "m", 8, 8, in_flight=3, normalise=False)
        assert [int(v[0]) for v in e.embed(["x" * n for n in range(1, 40)])] == list(range(1, 40)) and 1 < _Server.most <= 3 and e.check()
        assert e.embed([]) == [] and len(HttpEmbedder(url, "m", 8, 4, truncate=False).embed(["a"])[0]) == 8
        e.embed(["y" * 9000])
        assert _Server.seen[-1] == ("/api/embeddings", "m", 4000)
        for bad, error in (("fail", Exception), ("short", ValueError)):
            with pytest.raises(error):
                e.embed(["ok", bad])
        c = config.Config(embedder="http", embedding_url=url, embedding_model="m", full_dimension=8, dimensions=8)
        engine = Engine(spark, str(tmp_path / "s"), c)
        engine.index("r", files=spark.createDataFrame([("a.go", "go", "func f() {\n  return 1\n}")], "rel_path string, language string, content string"))
        v = engine.vectors.read("r").first().embedding
        assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-6
    finally:
        server.shutdown()


def test_background_job(spark, tmp_path):
    class Slow:
        dimension = 4

        def embed(self, texts):
            time.sleep(1)
            return [[1.0, 0.0, 0.0, 0.0] for _ in texts]

    e = Engine(spark, str(tmp_path / "s"), embedder=Slow)
    put(str(tmp_path / "repo"), "a.go", "func f() {\n  return 1\n}")
    got = e.call("index_codebase", {"repo_path": str(tmp_path / "repo"), "background": True})["content"]
    assert got["status"] == "running" and e.status(str(tmp_path / "repo"))["status"] == "running"
    seen = set()
    for _ in range(600):
        job = e.job(got["id"])
        seen.add(job.progress)
        if job.status != "running":
            break
        time.sleep(0.1)
    assert job.status == "completed" and job.progress == 1.0 and job.files == 1 and job.chunks_per_second > 0 and len(seen) > 2 and seen == set(sorted(seen))
    assert e.call("get_job", {"job_id": got["id"]})["content"]["chunks"] == 1 and e.call("get_index_status", {"repo_path": str(tmp_path / "repo")})["content"]["status"] == "completed"
    out = []
    e.serve(['{"id": 1, "tool": "semantic_search", "arguments": {"query": "f", "repo_path": "%s"}}' % (tmp_path / "repo"), "", '{"id": 2, "tool": "none"}'], type("O", (), {"write": lambda self, x: out.append(x), "flush": lambda self: None})())
    rows = [json.loads(x) for x in "".join(out).strip().split("\n")]
    assert rows[0]["id"] == 1 and "a.go" in rows[0]["content"] and "unknown tool" in rows[1]["error"]
    failed = e.start(str(tmp_path / "missing"))
    for _ in range(100):
        if failed.status != "running":
            break
        time.sleep(0.1)
    assert failed.status == "failed" and "no such folder" in failed.error


def test_stream_of_many_repositories(spark, tmp_path):
    schema = "repo_path string, rel_path string, language string, content string"
    rows = [(f"r{i % 5}", f"f{i}.go", "go", f"func f{i}() {{\n  return {i}\n}}") for i in range(20)]
    spark.createDataFrame([*rows, ("r0", "f0.go", "go", rows[0][3])], schema).write.parquet(str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "s"))
    for _ in range(2):  # the second run finds nothing new
        ingest(e, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / f"cp{_}")).awaitTermination(60)
        assert e.vectors.read().groupBy("repo_path").agg(F.count("*").alias("n")).filter("n = 4").count() == 5
    assert len(e.vectors.versions()) == 1
