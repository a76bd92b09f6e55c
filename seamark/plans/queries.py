"""Registered queries over the driver's tables, each with its SQL.

The corpus is the table documents with a synthetic path: folder, source and extension
follow from doc_id, the same way in both engines, so that every path class and
every kind of extension occurs. Vectors are those of the table embeddings.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, embedding, paths, text, vectors
from ..operators import reconcile, scan, search, status, store
from . import fixtures

FOLDERS = ("src/main", "app/test", "node_modules/x", "docs", "cmd", "build", "internal", "web")
TREE = ("src/main", ".git/hooks", "a/node_modules/lib", "docs", "cmd", "app/build", "vendor/x", "web/.cache")
ENDINGS = (".go", ".java", ".ts", ".py", ".js")
TEXT, VECTOR = "the and", 7
REPO = "/corpus"


def _pick(values, n):
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark, sf, folders=FOLDERS) -> DataFrame:
    d = _table(spark, sf, "documents")
    rel = F.concat(_pick(folders, F.col("doc_id")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/d"), F.col("doc_id").cast("string"), _pick(ENDINGS, F.col("doc_id")))
    return d.select("doc_id", F.col("text").alias("content"), "lang", "source", rel.alias("rel_path"), F.concat(F.lit(REPO + "/"), rel).alias("file_path"),
                    F.octet_length("text").cast("long").alias("size"), F.lit(REPO).alias("repo_path"))


def _corpus_sql(folders=FOLDERS) -> str:
    rel = f"{_sql_list(folders)}[doc_id % {len(folders)} + 1] || '/' || coalesce(source, '') || '/d' || doc_id || {_sql_list(ENDINGS)}[doc_id % {len(ENDINGS)} + 1]"
    return f"corpus as (select doc_id, text as content, lang, source, {rel} rel_path, '{REPO}/' || {rel} file_path, strlen(text)::bigint size from documents)"


LANG_SQL = "case lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in paths.LANGUAGES.items()) + " end"


def vector_chunks(spark, sf) -> DataFrame:
    """corpus with a vector each; chunk_type by doc_id."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    c = corpus(spark, sf).join(e, F.col("doc_id") == F.col("vec_id"))
    return c.withColumn("chunk_type", _pick(("function", "class", "method"), F.col("doc_id"))).withColumn("id", F.col("doc_id"))


def _search(spark, sf, r: search.Ranking | None = None, **kw) -> DataFrame:
    """Hybrid search: vectors are ranked first, texts fetched for the candidates."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.lit(REPO).alias("repo_path"))
    e = e.withColumn("chunk_type", _pick(("function", "class", "method"), F.col("doc_id")))
    e = e.join(_table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    texts = corpus(spark, sf).select("doc_id", "content", "lang", "file_path")
    return search.search(e, TEXT, _query_vector(spark, sf), r or search.Ranking(), repo=REPO, id_col="doc_id", texts=texts, **kw)


def _query_vector(spark, sf) -> list[float]:
    r = _table(spark, sf, "embeddings").filter(F.col("vec_id") == VECTOR).select("embedding").first()
    return list(r[0]) if r else [0.0]


_CHUNKS_SQL = _corpus_sql() + ", chunks as (select c.*, ['function', 'class', 'method'][doc_id % 3 + 1] chunk_type, embedding::double[] v from corpus c join embeddings e on c.doc_id = e.vec_id), q as (select embedding::double[] qv from embeddings where vec_id = 7)"


def _like(column: str, values, kind: str) -> str:
    f = {"in": "contains", "end": "ends_with", "start": "starts_with"}[kind]
    return "(" + " or ".join(f"{f}({column}, '{v}')" for v in values) + ")"


_P = "lower(file_path)"
TEST_SQL = f"({_like(_P, paths.TEST_DIRS, 'in')} or {_like(_P, paths.TEST_ENDS, 'end')})"
MAIN_SQL = f"({_like(_P, paths.MAIN_DIRS, 'in')} or (contains({_P}, '/cmd/') and not contains({_P}, '/test')))"
GENERATED_SQL = _like(_P, paths.GENERATED, "in")
FACTOR_SQL = f"case when {TEST_SQL} then 0.05::double when {MAIN_SQL} then 1.3::double when {GENERATED_SQL} then 0.2::double else 1.0::double end"
_W = [w for w in TEXT.split() if len(w) > 2]
_MATCHED = " + ".join(f"contains(lower(content), '{w}')::int" for w in _W)
HYBRID_SQL = f"(s * 0.7::double + case when contains(lower(content), '{TEXT}') then 1.5::double when ({_MATCHED}) > 0 then 0.3::double * ({_MATCHED}) / {len(TEXT.split())} else 0.0::double end) * {FACTOR_SQL}"
_COS = "list_cosine_similarity(v, (select qv from q))"


def _search_sql(where: str = "true", n: int = 5, minimum: str = "true") -> str:
    return f"""with {_CHUNKS_SQL},
near as (select *, {_COS} s from chunks where {where} order by s desc, doc_id limit {3 * n}),
best as (select doc_id, file_path, chunk_type, s, contains(lower(content), '{TEXT}') exact_match, {HYBRID_SQL} h, content, lang from near)
select doc_id, file_path, round(s, 6) semantic_score, exact_match, round(h, 6) hybrid_score from best where {minimum} order by h desc, s desc, doc_id limit {n}"""


def _result(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "file_path", F.round("semantic_score", 6).alias("semantic_score"), "exact_match", F.round("hybrid_score", 6).alias("hybrid_score"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


# Scan and filters

@query(f"with {_corpus_sql()} select doc_id, file_path, {LANG_SQL} as language from corpus")
def lang_detect(spark, sf):
    c = corpus(spark, sf)
    return c.select("doc_id", "file_path", paths.language(F.col("file_path")).alias("language"))


@query(f"with {_corpus_sql()} select doc_id from corpus where ({LANG_SQL}) is not null")
def supported_filter(spark, sf):
    return corpus(spark, sf).filter(paths.language(F.col("file_path")).isNotNull()).select("doc_id")


@query(f"with {_corpus_sql()} select doc_id, coalesce(({LANG_SQL}) in ('java', 'javascript', 'typescript'), false) as has_parser from corpus")
def parser_available(spark, sf):
    return corpus(spark, sf).select("doc_id", paths.has_parser(paths.language(F.col("file_path"))).alias("has_parser"))


@query("select * from (values " + ", ".join(f"('{k}', '{v}', {str(v in paths.STRUCTURAL).lower()})" for k, v in paths.LANGUAGES.items()) + ") t(extension, language, structural)")
def languages(spark, sf):
    return scan.languages(spark)


@query(f"with {_corpus_sql()} select ({LANG_SQL}) as language, count(*) n_files from corpus where ({LANG_SQL}) is not null group by 1")
def files_per_language(spark, sf):
    return scan.files_per_language(corpus(spark, sf).withColumn("language", paths.language(F.col("file_path"))))


_IGN = "(" + " or ".join(
    [f"(rel_path = '{p}' or starts_with(rel_path, '{p}/') or contains(rel_path, '/{p}/') or ends_with(rel_path, '/{p}') or list_contains(string_split(rel_path, '/')[:-2], '{p}'))"
     for p in ("target", "build", "dist", "out", "node_modules", ".pnp", ".git", ".idea", ".vscode")]
    + ["regexp_matches(rel_path, '^[^/]*[^/]*/[^/]*\\.min\\.js$')", "contains(rel_path, '/*.min.js/')", "contains(rel_path, '/*.bundle.js/')", "regexp_matches(rel_path, '^[^/]*[^/]*/[^/]*\\.bundle\\.js$')", "regexp_matches(list_last(string_split(rel_path, '/')), '^[^/]*\\.iml$')"]) + ")"


@query(f"with {_corpus_sql(TREE)} select doc_id, rel_path, {_IGN} as ignored from corpus")
def ignore_filter(spark, sf):
    return corpus(spark, sf, TREE).select("doc_id", "rel_path", paths.ignored(F.col("rel_path")).alias("ignored"))


@query(f"with {_corpus_sql(TREE)} select doc_id, regexp_matches(rel_path, '(^|/)\\.[^/]+/') as hidden from corpus")
def hidden_dir_filter(spark, sf):
    return corpus(spark, sf, TREE).select("doc_id", paths.hidden_folder(F.col("rel_path")).alias("hidden"))


@query(f"with {_corpus_sql()} select doc_id, size from corpus where size <= 4000")
def size_filter(spark, sf):
    return corpus(spark, sf).filter(F.col("size") <= 4000).select("doc_id", "size")


@query(f"""with {_corpus_sql(TREE)}, d as (select case when regexp_matches(rel_path, '(^|/)\\.[^/]+/') then 'pruned' when {_IGN} then 'ignored'
when ({LANG_SQL}) is null then 'unsupported' when size > 4000 then 'too_large' else 'kept' end disposition from corpus)
select count(*) filter (disposition not in ('pruned', 'ignored')) total_files, count(*) filter (disposition in ('ignored', 'unsupported', 'too_large')) skipped_files,
count(*) filter (disposition = 'kept') kept_files from d""")
def scan_counters(spark, sf):
    return scan.counters(scan.disposition(corpus(spark, sf, TREE), limit_bytes=4000))


@query(f"with {_corpus_sql()} select doc_id, {TEST_SQL} is_test, {MAIN_SQL} is_main, {GENERATED_SQL} is_generated, {FACTOR_SQL} path_factor from corpus")
def path_class_score(spark, sf):
    p = F.col("file_path")
    return corpus(spark, sf).select("doc_id", paths.is_test(p).alias("is_test"), paths.is_main(p).alias("is_main"), paths.is_generated(p).alias("is_generated"), paths.path_factor(p).alias("path_factor"))


@query(f"with {_corpus_sql()} select doc_id, substr(file_path, {len(REPO) + 2}) rel_path from corpus")
def relative_path(spark, sf):
    return corpus(spark, sf).select("doc_id", paths.relative(F.col("file_path"), F.col("repo_path")).alias("rel_path"))


@query("select doc_id from documents where regexp_matches(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]')")
def blank_filter(spark, sf):
    return _table(spark, sf, "documents").filter(~text.is_blank(F.col("text"))).select("doc_id")


# Digests and reconciliation

@query("select doc_id, sha256(text) digest from documents")
def content_hash(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.digest(F.col("text")).alias("digest"))


@query("select distinct source, substr(sha256(source), 1, 16) repo_key from documents where source is not null")
def repo_key(spark, sf):
    return _table(spark, sf, "documents").filter("source is not null").select("source", paths.repo_key(F.col("source")).alias("repo_key")).distinct()


@query("select doc_id, sha256(concat_ws(chr(1), '/corpus', doc_id::varchar, 'function', '1', text)) chunk_id from documents")
def chunk_ids(spark, sf):
    d = _table(spark, sf, "documents")
    return d.select("doc_id", text.chunk_id(F.lit(REPO), F.col("doc_id"), F.lit("function"), F.lit(1), F.col("text")).alias("chunk_id"))


def _previous(c: DataFrame) -> DataFrame:
    """An earlier state: a fifth wasn't there, a seventh differed, some are gone now."""
    old = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("old"), 256)).otherwise(text.digest(F.col("content")))
    kept = c.filter(F.col("doc_id") % 5 != 0).select("repo_path", F.col("rel_path").alias("path"), old.alias("hash"), F.lit(1).alias("chunk_count"))
    gone = c.filter(F.col("doc_id") % 11 == 0).select("repo_path", F.concat(F.lit("gone/"), "rel_path").alias("path"), F.sha2(F.lit("x"), 256).alias("hash"), F.lit(2).alias("chunk_count"))
    return kept.unionByName(gone)


_PREV = "prev as (select rel_path path, case when doc_id % 7 = 0 then sha256('old') else sha256(content) end hash, 1 chunk_count from corpus where doc_id % 5 <> 0 union all select 'gone/' || rel_path, sha256('x'), 2 from corpus where doc_id % 11 = 0)"


@query(f"""with {_corpus_sql()}, {_PREV}, cur as (select rel_path path, sha256(content) hash from corpus)
select coalesce(c.path, p.path) path, case when p.path is null then 'new' when c.path is null then 'deleted' when c.hash <> p.hash then 'changed' else 'unchanged' end state
from cur c full join prev p on c.path = p.path""")
def incremental_diff(spark, sf):
    c = corpus(spark, sf)
    current = c.select("repo_path", F.col("rel_path").alias("path"), text.digest(F.col("content")).alias("hash"))
    return reconcile.diff(current, _previous(c)).select("path", "state")


@query(f"with {_corpus_sql()}, {_PREV} select c.doc_id from corpus c left join prev p on c.rel_path = p.path where p.hash is null or p.hash <> sha256(c.content)")
def needs_reindex(spark, sf):
    c = corpus(spark, sf).withColumn("path", F.col("rel_path")).withColumn("hash", text.digest(F.col("content")))
    return reconcile.needs_index(c, _previous(corpus(spark, sf))).select("doc_id")


@query(f"with {_corpus_sql()}, {_PREV} select count(*) total_files, sum(chunk_count)::bigint total_chunks from prev")
def cache_stats(spark, sf):
    return status.cache_totals(_previous(corpus(spark, sf))).select("total_files", "total_chunks")


# Vectors

@query("select vec_id, i::int i, round(case when n = 0 then x else x / n end, 6) x from (select vec_id, sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))) n, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) - 1 i from embeddings)")
def vector_normalise(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.normalise(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", "i", F.round("x", 6).alias("x"))


@query("select vec_id, len(embedding[:32])::int n, round(list_sum(list_transform(embedding[:32]::double[], lambda y: y * y)), 6) sum_squares from embeddings")
def mrl_truncate_32(spark, sf):
    v = vectors.truncate(F.col("embedding"), 32)
    return _table(spark, sf, "embeddings").select("vec_id", F.size(v).alias("n"), F.round(vectors.sum_squares(v), 6).alias("sum_squares"))


@query("select vec_id, len(embedding)::int n from embeddings")
def dim_check(spark, sf):
    return _table(spark, sf, "embeddings").select("vec_id", F.size(vectors.checked(F.col("embedding"), 64)).alias("n"))


def _knn(metric):
    def run(spark, sf):
        e = _table(spark, sf, "embeddings")
        got = search.knn(e, _query_vector(spark, sf), 15, metric, id_col="vec_id")
        return got.select("vec_id", F.round("semantic_score", 6).alias("semantic_score"))
    return run


for _m, _e in (("cosine", "list_cosine_similarity(embedding::double[], qv)"), ("dot", "list_inner_product(embedding::double[], qv)"), ("euclid", "1 / (1 + list_distance(embedding::double[], qv))")):
    QUERIES[f"knn_{_m}"] = _knn(_m)
    SQL[f"knn_{_m}"] = f"with q as (select embedding::double[] qv from embeddings where vec_id = 7) select vec_id, round(s, 6) semantic_score from (select vec_id, {_e} s from embeddings, q) order by s desc, vec_id limit 15"


@query("""select query_id, rank::int as "rank", id, round(s, 6) semantic_score from (select q.vec_id query_id, e.vec_id id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) s,
row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as "rank" from embeddings e, (from embeddings where vec_id % 100 = 0) q) where "rank" <= 5""")
def knn_batch(spark, sf):
    e = _table(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.knn_many(e, q, 5, id_col="vec_id").withColumn("semantic_score", F.round("semantic_score", 6))


# Ranking

@query(f"""with p as (select doc_id, string_split(lower(text), '{TEXT}') s from documents where contains(lower(text), '{TEXT}')),
n as (select doc_id, len(s) - 1 m, list_transform(range(1, len(s)), lambda k: list_sum(list_transform(s[:k], lambda z: strlen(z))) + (k - 1) * {len(TEXT)}) a from p)
select doc_id, m::bigint n_matches, array_to_string(list_transform(a, lambda z: z::bigint::varchar), ',') positions from n""")
def exact_match_positions(spark, sf):
    d = _table(spark, sf, "documents").filter(text.contains_text(F.col("text"), TEXT))
    at = text.match_positions(F.col("text"), TEXT)
    return d.select("doc_id", F.size(at).cast("long").alias("n_matches"), F.array_join(at.cast("array<string>"), ",").alias("positions"))


@query("select doc_id, (contains(lower(text), 'the')::int + contains(lower(text), 'and')::int + contains(lower(text), 'the')::int) matched from documents")
def partial_word_match(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.matched_words(F.col("text"), "the of and The").alias("matched"))


@query(_search_sql())
def hybrid_search(spark, sf):
    return _result(_search(spark, sf))


@query(_search_sql(n=10))
def hybrid_search_rerank_limit(spark, sf):
    return _result(_search(spark, sf, search.Ranking(max_results=10)))


@query(_search_sql("chunk_type = 'method'"))
def chunk_type_filter(spark, sf):
    return _result(_search(spark, sf, chunk_type="method"))


@query(_search_sql(minimum="h >= 0.5"))
def min_score_filter(spark, sf):
    return _result(_search(spark, sf, search.Ranking(min_score=0.5)))


@query(_search_sql().replace("select doc_id, file_path, round(s, 6) semantic_score, exact_match, round(h, 6) hybrid_score from best where true order by h desc, s desc, doc_id limit 5", """,
top as (select *, row_number() over (order by h desc, s desc, doc_id) r, string_split(content, chr(10)) l from best order by h desc, s desc, doc_id limit 5)
select doc_id, r || '. ' || file_path || ':1-' || len(l) || printf(' (score: %.3f)', h) || case when exact_match then ' [EXACT MATCH]' else '' end || chr(10) || '   Language: ' || lang || ' | Type: ' || chunk_type || chr(10)
|| array_to_string(list_transform(l[:3], lambda x: '    ' || case when len(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 80 then substr(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 1, 80) || '...' else regexp_replace(x, '^\\s+|\\s+$', '', 'g') end), chr(10))
|| case when len(l) > 3 then chr(10) || '    ... (' || (len(l) - 3) || ' more lines)' else '' end as line from top"""))
def format_results(spark, sf):
    from pyspark.sql import Window as W

    d = _search(spark, sf)
    d = d.withColumn("r", F.row_number().over(W.orderBy(F.desc("hybrid_score"), F.desc("semantic_score"), "doc_id")))
    return d.select("doc_id", text.format_result(F.col("r"), F.col("file_path"), F.lit(1), F.size(text.lines(F.col("content"))), F.col("hybrid_score"), F.col("exact_match"), F.col("lang"), F.col("chunk_type"), F.col("content")).alias("line"))


# Lines, tokens, chunks

@query("select doc_id, (i - 1)::int line_no, l as line from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from documents)")
def line_explode(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))


@query("select doc_id, len(string_split(text, chr(10)))::bigint n_lines from documents")
def line_count(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@query("select doc_id, (case when n < 1000 then 300 when n < 5000 then 200 else 150 end)::int max_tokens, (case when n < 1000 then 20 when n < 5000 then 20 else 21 end)::int overlap from (select doc_id, len(string_split(text, chr(10))) * 100 n from documents)")
def adaptive_limits(spark, sf):
    d = _table(spark, sf, "documents")
    return d.select("doc_id", text.chunk_limits(text.line_count(F.col("text")) * 100).alias("l")).select("doc_id", "l.max_tokens", "l.overlap")


@query("select doc_id, len(regexp_extract_all(text, '\\w+|[^\\w\\s]'))::bigint n_tokens from documents")
def token_count(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


_BOUND = {k: text.boundary_pattern(k, compat=True) for k in text.BOUNDARY}


@query("select doc_id, " + ", ".join(f"count(*) filter (regexp_matches(l, '{p}')) n_{k or 'fallback'}" for k, p in _BOUND.items())
       + " from (select doc_id, unnest(string_split(regexp_replace(text, '\\b[Tt]he \\w+', 'class the', 'g'), chr(10))) l from documents) group by doc_id")
def boundary_lines(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.explode(text.lines(F.regexp_replace("text", r"\b[Tt]he \w+", "class the"))).alias("l"))
    return d.groupBy("doc_id").agg(*[F.count_if(text.is_boundary(F.col("l"), k, compat=True)).alias(f"n_{k or 'fallback'}") for k in _BOUND])


def _fixture_chunks(spark) -> DataFrame:
    files = spark.createDataFrame([(REPO, path, language, code) for path, (language, code) in fixtures.FILES.items()], "repo_path string, file_path string, language string, content string")
    return chunking.chunk_files(files)


#: What the fixtures hold, written by hand: file, chunk type, function, class, first line, last line, in order.
_UNITS = """
('Cart.java', 0, 'class', '', 'Cart', 5, 22), ('Cart.java', 1, 'function', 'Cart', 'Cart', 8, 8), ('Cart.java', 2, 'function', 'group', 'Cart', 10, 15), ('Cart.java', 3, 'function', 'run', '', 13, 13),
('Cart.java', 4, 'function', 'checkout', 'Cart', 17, 17), ('Cart.java', 5, 'class', '', 'Listener', 19, 19), ('Cart.java', 6, 'function', 'changed', 'Listener', 19, 19), ('Cart.java', 7, 'function', 'weight', 'Listener', 19, 19),
('Cart.java', 8, 'class', '', 'Color', 21, 21), ('Cart.java', 9, 'function', 'shade', 'Color', 21, 21), ('Cart.java', 10, 'function', 'Color', 'Color', 21, 21),
('shapes.ts', 0, 'function', 'first', '', 3, 3), ('shapes.ts', 1, 'function', 'load', '', 4, 6), ('shapes.ts', 2, 'function', 'add', '', 7, 7), ('shapes.ts', 3, 'class', '', 'Handler', 8, 8), ('shapes.ts', 4, 'class', '', 'Box', 9, 9),
('shapes.ts', 5, 'class', '', 'Shape', 11, 13), ('shapes.ts', 6, 'class', '', 'Circle', 15, 21), ('shapes.ts', 7, 'function', 'constructor', 'Circle', 16, 16), ('shapes.ts', 8, 'function', 'build', 'Circle', 17, 17),
('shapes.ts', 9, 'function', 'size', 'Circle', 18, 18), ('shapes.ts', 10, 'function', 'onClick', 'Circle', 19, 19),
('util.js', 0, 'function', 'pick', '', 1, 3), ('util.js', 1, 'function', 'square', '', 4, 4), ('util.js', 2, 'function', 'cube', '', 5, 5), ('util.js', 3, 'function', 'parse', '', 7, 7), ('util.js', 4, 'function', 'run', '', 8, 8),
('util.js', 5, 'function', '', '', 10, 10), ('util.js', 6, 'class', '', 'Queue', 11, 11), ('util.js', 7, 'function', 'push', 'Queue', 11, 11), ('util.js', 8, 'function', 'drain', 'Queue', 11, 11)"""
_LARGE = f"select i::int i from generate_series(0, {fixtures.LARGE_METHODS - 1}) t(i)"


@query(f"""select file_path, ordinal::int ordinal, chunk_type, function_name, class_name, start_line::int start_line, end_line::int end_line
from (values {_UNITS}) t(file_path, ordinal, chunk_type, function_name, class_name, start_line, end_line)
union all select 'Large.java', 0, 'class', '', 'Large', 1, {3 * fixtures.LARGE_METHODS + 2}
union all select 'Large.java', i + 1, 'method', 'method' || i, 'Large', 3 * i + 2, 3 * i + 4 from ({_LARGE})""")
def structural_chunks(spark, sf):
    """Units of code fixtures; a class over the byte limit is a summary and its methods."""
    return _fixture_chunks(spark).select("file_path", "ordinal", "chunk_type", "function_name", "class_name", "start_line", "end_line")


@query(f"select 'Large.java' file_path, 'method' || i function_name, 'Large' parent_class, (3 * i + 2)::int start_line from ({_LARGE})")
def method_parents(spark, sf):
    """Methods of a large class with the class that their parent id leads to."""
    c = _fixture_chunks(spark)
    p = c.filter("chunk_type = 'class'").select(F.col("file_path").alias("p"), F.col("ordinal").alias("o"), F.col("class_name").alias("parent_class"))
    return c.join(p, (F.col("file_path") == F.col("p")) & (F.col("parent_ordinal") == F.col("o"))).select("file_path", "function_name", "parent_class", "start_line")


@query(f"""with m as (select i, '  public int method' || i || '(int value) {{' s from ({_LARGE}))
select 'Large.java' file_path, 'public class Large {{' || chr(10) || 'Methods:' || chr(10) || string_agg(s, chr(10) order by i) || chr(10) || '  ... and {fixtures.LARGE_METHODS - 20} more methods' as content from m where i < 20""")
def class_summaries(spark, sf):
    """The summary of a large class: its head, twenty signatures, and how many more."""
    return _fixture_chunks(spark).filter("file_path = 'Large.java' and chunk_type = 'class'").select("file_path", "content")


def _boundary_sql(column: str) -> str:
    """Boundary lines by language; the lookahead of the pattern as a condition of its own."""
    whens = " ".join(f"when '{k}' then regexp_matches({column}, '^\\s*(?:{'|'.join(v)})')" for k, v in text.BOUNDARY.items() if k in paths.LANGUAGES.values())
    words = text.NOT_A_TYPE.removeprefix("(?!").removesuffix(")")
    return f"(case language {whens} else regexp_matches({column}, '^\\s*(?:{'|'.join(text.BOUNDARY[''])})') end and not regexp_matches({column}, '^\\s*{words}'))"


def _ends(rows: str) -> str:
    """For chunks that begin at line a, whose fresh lines begin at f: the line e that ends them, and how many lines go over into the next."""
    return f"""select file_path, a, f, e, e >= n or full_at >= n last, case when h = e - a then h else h + (h = 0 or p[e + 1] - p[e - h] <= {chunking.STRETCH} * ov)::bigint end back
from (select *, len(list_filter(range(1, e - a + 1), lambda k: p[e + 1] - p[e - k + 1] <= ov)) h
from (select *, case when full_at >= n then n else full_at + coalesce(list_position(b[full_at + 1:least(full_at + {chunking.LOOK_AHEAD}, n)], true), 0) end e
from (select d.*, a, f, greatest(f + 1, len(list_filter(p, lambda x: x <= p[a + 1] + most)) - 1) full_at from ({rows}) t join doc d using (file_path))))"""


#: Chunks by token budget: each ends at the line that breaks it, or at a boundary soon after, and goes on from an overlap. Those
#: of more characters than a chunk may have are split by bytes. Prose has no structure, so that all files go this way.
_CHUNKED = f"""with recursive {_corpus_sql()},
src as (select file_path, ({LANG_SQL}) as language, content from corpus where regexp_matches(content, '[^ \\t\\n\\x0B\\f\\r]')),
line as (select *, sum(tok) over w p, sum(strlen(l) + 1) over w s, {_boundary_sql('l')} b from (select *, len(regexp_extract_all(l, '\\w+|[^\\w\\s]')) tok
  from (select file_path, language, unnest(string_split(content, chr(10))) l, generate_subscripts(string_split(content, chr(10)), 1) i from src)) window w as (partition by file_path order by i)),
doc as (select file_path, list(l order by i) l, [0] || list(p::bigint order by i) p, [0] || list(s::bigint order by i) s, list(b order by i) b, count(*) n,
  case when count(*) < 1000 then 300 when count(*) < 5000 then 200 else 150 end most, case when count(*) < 5000 then 20 else 21 end ov from line group by 1),
c as ({_ends('select file_path, 0::bigint a, 0::bigint f from doc')}
  union all ({_ends('select file_path, e - back a, e f from c where not last')})),
body as (select c.*, array_to_string(l[a + 1:e], chr(10)) t from c join doc using (file_path)),
big as (select file_path, a, f, e, least(10, greatest(1, (e - a) // 10)) over_ from body where length(t) > {chunking.CHUNK_BYTES}),
r as (select file_path, a, e, f, over_, a lo, least(e, greatest(a + 1, len(list_filter(s, lambda x: x <= s[a + 1] + {chunking.CHUNK_BYTES})) - 1)) hi from big join doc using (file_path)
  union all select file_path, a, e, f, over_, lo, least(e, greatest(lo + 1, len(list_filter(s, lambda x: x <= s[lo + 1] + {chunking.CHUNK_BYTES})) - 1)) hi
  from (select file_path, a, e, f, over_, greatest(hi - over_, lo + 1) lo from r where hi < e) join doc using (file_path)),
piece as (select r.*, array_to_string(l[lo + 1:hi], chr(10)) t from r join doc using (file_path)),
long as (select file_path, a, f, lo, hi, t, [0] || list(upto::bigint order by i) s, count(*) n from (select file_path, a, f, lo, hi, t, i, sum(strlen(ch)) over (partition by file_path, a, f, lo order by i) upto
  from (select file_path, a, f, lo, hi, t, unnest(string_split(t, '')) ch, generate_subscripts(string_split(t, ''), 1) i from piece where strlen(t) > {chunking.CHUNK_BYTES})) group by all),
q as (select file_path, a, f, lo, 0::bigint x, len(list_filter(s, lambda y: y <= {chunking.CHUNK_BYTES})) - 1 z from long
  union all select file_path, a, f, lo, z, len(list_filter(s, lambda y: y <= s[z + 1] + {chunking.CHUNK_BYTES})) - 1 from (select file_path, a, f, lo, z from q) join long using (file_path, a, f, lo) where z < n),
found as (select file_path, a + 1 start_line, e end_line, t from body where length(t) <= {chunking.CHUNK_BYTES}
  union all select file_path, lo + 1, hi, t from piece where strlen(t) <= {chunking.CHUNK_BYTES} and hi > f
  union all select file_path, lo + 1, hi, t[x + 1:z] from q join long using (file_path, a, f, lo) where hi > f)
select file_path, 'function' chunk_type, start_line::int start_line, end_line::int end_line, length(t)::int n_chars from found where regexp_matches(t, '[^ \\t\\n\\x0B\\f\\r]')"""


@query(_CHUNKED)
def token_chunks(spark, sf):
    c = corpus(spark, sf).withColumn("language", paths.language(F.col("file_path")))
    return chunking.chunk_files(c).select("file_path", "chunk_type", "start_line", "end_line", F.length("content").alias("n_chars"))


#: Lines by greedy byte budget, each piece from the overlap of the one before; a longer line by its characters.
_SPLIT = f"""with recursive {_corpus_sql()},
line as (select file_path, i, l, sum(strlen(l) + 1) over (partition by file_path order by i) upto from (select file_path, unnest(string_split(coalesce(content, ''), chr(10))) l, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) i from corpus)),
doc as (select file_path, list(l order by i) l, [0] || list(upto::bigint order by i) s, count(*) n, least(10, greatest(1, count(*) // 10)) back from line group by 1),
r as (select file_path, 0::bigint lo, greatest(1, len(list_filter(s, lambda x: x <= 1000)) - 1) hi from doc
  union all select d.file_path, t.lo, greatest(t.lo + 1, len(list_filter(d.s, lambda x: x <= d.s[t.lo + 1] + 1000)) - 1) from (select file_path, greatest(hi - back, lo + 1) lo from r join doc using (file_path) where hi < n) t join doc d using (file_path)),
piece as (select file_path, lo, hi, array_to_string(l[lo + 1:hi], chr(10)) t from r join doc using (file_path)),
long as (select file_path, lo, hi, [0] || list(upto::bigint order by i) s, count(*) n from (select file_path, lo, hi, i, sum(strlen(c)) over (partition by file_path, lo order by i) upto
  from (select file_path, lo, hi, unnest(string_split(t, '')) c, generate_subscripts(string_split(t, ''), 1) i from piece where strlen(t) > 1000)) group by all),
q as (select file_path, lo, 0::bigint a, len(list_filter(s, lambda x: x <= 1000)) - 1 b from long
  union all select g.file_path, g.lo, t.b, len(list_filter(g.s, lambda x: x <= g.s[t.b + 1] + 1000)) - 1 from q t join long g using (file_path, lo) where t.b < g.n)
select file_path, (lo + 1)::int start_line, hi::int end_line, length(t)::int n_chars from piece where strlen(t) <= 1000
union all select file_path, (lo + 1)::int, hi::int, (b - a)::int from q join long using (file_path, lo)"""


@query(_SPLIT)
def split_large(spark, sf):
    return chunking.split_texts(corpus(spark, sf), 1000).select("file_path", "start_line", "end_line", F.length("content").alias("n_chars"))


@query("select doc_id, ((row_number() over (order by doc_id) - 1) // 16)::bigint batch from documents")
def batching(spark, sf):
    return scan.batches(_table(spark, sf, "documents").select("doc_id"), "doc_id", 16)


# Stores and status

@query("""with old as (select doc_id, 'v1' as version from documents where doc_id % 3 <> 0), new as (select doc_id, 'v2' as version from documents where doc_id % 2 = 0)
select doc_id, version from new union all select doc_id, version from old where doc_id not in (select doc_id from new)""")
def upsert_merge(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id")
    return store.merged(d.filter("doc_id % 3 <> 0").withColumn("version", F.lit("v1")), d.filter("doc_id % 2 = 0").withColumn("version", F.lit("v2")), ["doc_id"])


@query("select doc_id, source from documents where source is distinct from 'src0'")
def delete_repo(spark, sf):
    return store.without_repo(_table(spark, sf, "documents").select("doc_id", "source"), "src0", "source")


@query("select source repo, count(*) n_chunks from documents group by source")
def count_by_repo(spark, sf):
    return status.chunks_per_repo(_table(spark, sf, "documents").withColumnRenamed("source", "repo"), "repo")


@query(f"with {_CHUNKS_SQL} select chunk_type, count(*) n_chunks from chunks group by 1")
def chunk_type_stats(spark, sf):
    return status.chunk_types(vector_chunks(spark, sf))


@query("""with v as (select source repo, count(*) total_chunks from documents where doc_id % 3 = 0 and source < 'src15' group by 1),
h as (select source repo, count(*) total_files, sum(2)::bigint cached_chunks from documents where doc_id % 4 = 0 and source > 'src12' group by 1)
select coalesce(v.repo, h.repo) repo_path, coalesce(total_files, 0) total_files, coalesce(total_chunks, 0) total_chunks,
case when coalesce(total_files, 0) = 0 and coalesce(total_chunks, 0) = 0 then 'not_indexed' else 'completed' end status, coalesce(total_files, 0) > 0 and coalesce(total_chunks, 0) = 0 needs_force
from v full join h on v.repo = h.repo""")
def repo_status(spark, sf):
    d = _table(spark, sf, "documents").withColumn("repo_path", F.col("source"))
    v = d.filter("doc_id % 3 = 0 and source < 'src15'")
    h = d.filter("doc_id % 4 = 0 and source > 'src12'").select("repo_path", F.col("doc_id").cast("string").alias("path"), F.lit(2).alias("chunk_count"))
    return status.repo_status(v, h)


@query("select doc_id, round(count(*) / 600.0::double, 6) as seconds from (select doc_id, unnest(string_split(text, chr(10))) from documents) group by 1")
def embed_time_estimate(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.round(embedding.estimate_seconds(text.line_count(F.col("text"))), 6).alias("seconds"))


_HASHED = """with t as (select doc_id, md5(unnest(regexp_extract_all(lower(substr(text, 1, 4000)), '\\w+'))) h from documents),
s as (select doc_id, ('0x' || substr(h, 1, 6))::int % 64 dim, sum(case when ('0x' || substr(h, 7, 1))::int % 2 = 0 then 1 else -1 end)::double x from t group by 1, 2),
n as (select doc_id, sqrt(sum(x * x)) n from s group by 1)"""


@query(_HASHED + " select doc_id, dim::int dim, round(x / n, 6) x from s join n using (doc_id) where x <> 0")
def embed_hash(spark, sf):
    return embedding.hashed_components(_table(spark, sf, "documents"), "doc_id", "text", 64)


@query(_HASHED + " select doc_id, dim::int dim, sign(x)::int sign from s join n using (doc_id) where x <> 0")
def embed_documents(spark, sf):
    """The engine's own embedder on every document: which components it sets, and their sign."""
    v = embedding.embed_column(partial(embedding.HashEmbedder, 64), F.col("text"))
    d = _table(spark, sf, "documents").select("doc_id", F.posexplode(v).alias("dim", "x")).filter("x <> 0")
    return d.select("doc_id", "dim", F.signum("x").cast("int").alias("sign"))
