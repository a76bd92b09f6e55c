import pytest
from pyspark.sql import functions as F

from seamark.functions import chunking, paths, text, vectors
from seamark.operators import search


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col).first()[0]


@pytest.mark.parametrize("path, want", [("node_modules/package.json", True), ("src/main.java", False), ("debug.log", True), ("build/output.js", True), ("test.java", False), ("src/node_modules/lib.js", True)])
def test_ignore(spark, path, want):
    assert one(spark, paths.ignored(F.col("p"), ("node_modules/**", "*.log", "build/**")), p=path) is want


@pytest.mark.parametrize("path, depth_one, true_glob", [("x.min.js", False, True), ("a/x.min.js", True, True), ("a/b/x.min.js", False, True)])
def test_deep_globs(spark, path, depth_one, true_glob):
    assert one(spark, paths.ignored(F.col("p"), ("**/*.min.js",)), p=path) is depth_one
    assert one(spark, paths.ignored(F.col("p"), ("**/*.min.js",), "gitignore"), p=path) is true_glob


@pytest.mark.parametrize("path, factor", [("/r/src/test/A.java", 0.05), ("/r/latest.java", 0.05), ("/r/src/main/A.java", 1.3), ("/r/cmd/x.go", 1.3), ("/r/cmd/test_x/x.go", 1.0),
                                          ("/r/vendor/x/lib/y.js", 1.3), ("/r/vendor/y.js", 0.2), ("/r/web/y.js", 1.0), ("/r/a.generated.ts", 0.2)])
def test_path_factor(spark, path, factor):
    assert one(spark, paths.path_factor(F.col("p")), p=path) == factor


@pytest.mark.parametrize("query, content, at", [("logger", "This code uses logger.info()", [15]), ("user", "user.getName() and user.getEmail()", [0, 19]), ("Logger", "LOGGER is a constant", [0]),
                                                ("database", "This is about users", []), ("log", "logger is here", [0])])
def test_positions(spark, query, content, at):
    assert one(spark, text.match_positions(F.col("c"), query), c=content) == at


def test_hybrid(spark):
    d = spark.createDataFrame([("a", "This is a test", "test1.java", 0.8), ("b", "Code with logger.info() call", "test2.java", 0.6)], "id string, content string, file_path string, semantic_score double")
    got = {r.id: (round(r.hybrid_score, 6), r.exact_match) for r in search.hybrid(d, "logger").collect()}
    assert got == {"a": (0.56, False), "b": (1.92, True)}
    with pytest.raises(ValueError):
        search.hybrid(d, " ")


def test_knn_many_takes_any_number_of_queries(spark):
    d = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "id long, embedding array<double>")
    q = d.select(F.col("id").alias("query_id"), "embedding")
    for metric in ("cosine", "dot", "euclid"):
        whole, blocks = ([tuple(r) for r in search.knn_many(d, q, 3, metric, most_queries=n).orderBy("query_id", "rank").collect()] for n in (10_000, 7))
        assert [r[:3] for r in whole] == [r[:3] for r in blocks] and len(blocks) == 120
    assert search.knn_many(d, q.limit(0), 3).count() == 0


def test_vectors(spark):
    for v, n in (([3.0, 4.0], 1), ([0.0, 0.0, 0.0], 0), ([-3.0, -4.0], 1)):
        u = one(spark, vectors.normalise(F.col("v")), v=v)
        assert abs(sum(x * x for x in u) - n) < 1e-9 and len(u) == len(v)
    assert [vectors.snap_dimension(d, 10**6) for d in (0, 64, 96, 95, 300, 400, 640, 900)] == [64, 64, 128, 64, 256, 512, 768, 768]


def test_limits():
    for a, b in ((0, 20), (200, -1), (200, 200), (200, 250)):
        with pytest.raises(ValueError):
            chunking.Limits(a, b)
    assert [chunking.limits_for(n) for n in (10, 2000, 9000)] == [chunking.Limits(300, 20), chunking.Limits(200, 20), chunking.Limits(150, 21)]


@pytest.mark.parametrize("n, budget, overlap", [(1, 10, 2), (50, 12, 4), (200, 40, 0)])
def test_token_chunks_cover(n, budget, overlap):
    lines = [f"w{i} is here" if i % 7 else "" for i in range(n)]
    got = chunking.token_chunks("\n".join(lines), "go", chunking.Limits(budget, overlap))
    seen = set()
    for c in got:
        assert c.content == "\n".join(lines[c.start - 1:c.end])
        seen |= set(range(c.start, c.end + 1))
    assert {i + 1 for i, x in enumerate(lines) if x} <= seen
    assert chunking.token_chunks(" \n ", "go") == []


def test_token_chunks_keep_long_lines_whole():
    long = "".join(f"w{i}é€ " for i in range(3000))
    lines = ["a short one", long, "", *["x" * 900 + f" {i}" for i in range(9)], "the end"]
    got = chunking.token_chunks("\n".join(lines), "go")
    assert "".join(c.content for c in got if (c.start, c.end) == (2, 2)) == long
    assert all(len(c.content.encode()) <= chunking.CHUNK_BYTES for c in got)
    assert {i + 1 for i, x in enumerate(lines) if x and any(c.start <= i + 1 <= c.end and x in c.content for c in got)} == {1, *range(4, 14)}
    assert max(len(c.content) for c in chunking.token_chunks("\n".join(lines), "go", compat=True)) == chunking.CHUNK_BYTES
    assert [t for *_, t in chunking.split_large(["é€é"], 1, 1)] == ["é", "€", "é"]


JAVA = """package x;
// class Fake { }
public class Greeter<T> {
    private String s = "class Not {";
    @Override
    public Greeter<T> greet(String who) throws Exception {
        if (who == null) { return null; }
        return this;
    }
    void other() { run(() -> { x(); }); }
}
interface Small { void a(); }
"""


def test_structure():
    got = [(u.kind, u.name, u.parent) for u in chunking.units(JAVA, "java")]
    assert got == [("class", "Greeter", None), ("method", "greet", 0), ("method", "other", 0), ("class", "Small", None), ("method", "a", 3)]
    js = "export class A {\n  go(x) {\n    return 1;\n  }\n}\nconst f = async (a) => {\n  return a;\n};\nfunction g() { return 2; }\n"
    assert [(u.kind, u.name) for u in chunking.units(js, "javascript")] == [("class", "A"), ("method", "go"), ("function", "f"), ("function", "g")]
    big = "class B {\n" + "".join(f"  void m{i}() {{\n    int a = {i};\n  }}\n" for i in range(200)) + "}\n"
    chunks = chunking.structural_chunks(big, "java")
    assert chunks[0].kind == "class" and "and 180 more methods" in chunks[0].content
    assert all(c.parent == 0 and c.kind == "method" and c.cls == "B" for c in chunks[1:]) and len(chunks) == 201
    assert max(len(c.content) for c in chunking.structural_chunks("class C {\n void m() {\n" + "  x();\n" * 2000 + " }\n}", "java")) <= 4000


def test_split_keeps_all_lines():
    lines = [f"line {i}" for i in range(500)]
    got = chunking.split_large(lines, 1, 300)
    assert set(lines) == {x for _, _, t in got for x in t.split("\n")} and all(len(t) <= 300 for *_, t in got)
