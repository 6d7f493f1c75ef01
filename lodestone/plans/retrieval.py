"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluation as ev
from lodestone.operators import retrieval as rt
from lodestone.operators import similarity as sim
from lodestone.plans.catalog import query
from lodestone.sources.tables import Tables

_DENSE = """q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id AS id, ql, label, round(list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings)"""
_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


def asked(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0")


def keyword_docs(t: Tables) -> DataFrame:
    return t.docs_v.select(F.col("doc_id").alias("id"), "text", "title", "external_id")


@query(f"WITH {_DENSE}, r AS (SELECT *, {_RANKED} AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def retrieval_dense_topk(t: Tables) -> DataFrame:
    """JN-02, TOP-01."""
    return rt.exact_topk(t.embeddings, asked(t), 10)


@query(f"WITH {_DENSE}, r AS (SELECT *, {_RANKED} AS rank FROM s WHERE score >= 0.3) SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def retrieval_dense_threshold(t: Tables) -> DataFrame:
    """FLT-11, DOM-02: the threshold comes before the cut."""
    return rt.exact_topk(t.embeddings, asked(t), 10, min_score=0.3)


@query(f"""WITH {_DENSE}, v AS (SELECT s.query_id, s.id, s.score FROM s JOIN documents d ON d.doc_id = s.id LEFT JOIN labels l ON l.doc_id = d.doc_id
        WHERE coalesce(l.toxic, 0) = 0 AND d.lang = 'en'), r AS (SELECT *, {_RANKED} AS rank FROM v) SELECT query_id, id, score, rank FROM r WHERE rank <= 10""")
def retrieval_dense_visible(t: Tables) -> DataFrame:
    """FLT-12, FLT-14, JN-06, TOP-02: what must not be seen goes before the search, not after it."""
    docs = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("library_id"), F.lit(1).alias("revision"), (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"))
    points = t.embeddings.select("*", F.col("vec_id").alias("document_id"), F.lit("en").alias("library_id"), F.lit(1).alias("revision"))
    return rt.exact_topk(rt.visible(points, docs).where("visible"), asked(t), 10)


@query(
    """WITH cur AS (SELECT user_id, max(revision) AS current FROM jobs_v GROUP BY user_id)
    SELECT j.event_id, j.user_id, j.revision, (j.revision = c.current AND j.status = 'done') AS visible FROM jobs_v j JOIN cur c USING (user_id)""",
    views="jobs_v",
)
def retrieval_revision_id_visible(t: Tables) -> DataFrame:
    """FLT-13: a hit's revision is the current one and ready."""
    current = t.jobs_v.groupBy("user_id").agg(F.max("revision").alias("current"))
    return t.jobs_v.join(current, "user_id").select("event_id", "user_id", "revision", ((F.col("revision") == F.col("current")) & (F.col("status") == "done")).alias("visible"))


@query(f"""WITH {_DENSE}, r AS (SELECT query_id, query_id // 60 AS family, id, score, {_RANKED} AS rank FROM s), h AS (SELECT * FROM r WHERE rank <= 20)
    SELECT family AS query_id, id, round(sum(score), 9) AS score, max(score) AS best, list(query_id ORDER BY query_id) AS variants FROM h GROUP BY family, id""")
def retrieval_multi_query_combsum(t: Tables) -> DataFrame:
    """AGG-07, TOP-04: three neighbouring queries are phrasings of one."""
    hits = rt.exact_topk(t.embeddings, asked(t), 20).select(F.expr("query_id div 60").alias("query_id"), F.col("query_id").alias("variant"), "id", "score", "rank")
    return rt.combined_sum(hits).drop("first_seen")


_TOKENS = "list_distinct_ordered"
_WORDS = "SELECT item_id AS query_id, [w FOR w, i IN f IF list_position(f, w) = i][1:8] AS words FROM (SELECT item_id, [x FOR x IN regexp_extract_all(lower(text), '[a-z0-9\\x{00df}-\\x{024f}\\x{4e00}-\\x{9fff}]+') IF length(x) >= 2] AS f FROM benchmark WHERE item_id % 20 = 0)"
_KEYWORD = f"""w AS ({_WORDS}), k AS (SELECT query_id, doc_id AS id, (len([x FOR x IN words IF contains(lower(text), x)]) + 1.5::DOUBLE * len([x FOR x IN words IF contains(lower(title), x)]) + 2.0::DOUBLE * len([x FOR x IN words IF contains(lower(external_id), x)]))::DOUBLE AS score FROM docs_v, w),
    kr AS (SELECT query_id, id, score, {_RANKED} AS rank FROM k WHERE score > 0)"""


def keyword_queries(t: Tables) -> DataFrame:
    return t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_KEYWORD} SELECT query_id, id, score, rank FROM kr WHERE rank <= 50", views="docs_v")
def retrieval_keyword_tokens(t: Tables) -> DataFrame:
    """JN-01, STR-09, STR-10, FLT-23, TOP-03, DOM-03."""
    return rt.keyword_recall(keyword_docs(t), keyword_queries(t), 50)


@query()
def retrieval_word_similarity(t: Tables) -> DataFrame:
    """STR-11, FLT-22: the first path of keyword recall, over chunks with the title and external id of their document."""
    return sim.similar_words(t.chunks_of(t.docs_v, "title", "external_id").select(F.col("chunk_id").alias("id"), "text", "title", "external_id"), keyword_queries(t), 50)


_HYBRID = f"""{_KEYWORD}, {_DENSE}, dr AS (SELECT *, {_RANKED} AS rank FROM s), d AS (SELECT * FROM dr WHERE rank <= 50), kk AS (SELECT * FROM kr WHERE rank <= 50)"""
_FUSE = """f AS (SELECT coalesce(d.query_id, kk.query_id) AS query_id, coalesce(d.id, kk.id) AS id, d.rank AS dense_rank, d.score AS dense_score, kk.rank AS keyword_rank,
        round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + kk.rank), 0), 12) AS score FROM d FULL JOIN kk ON d.query_id = kk.query_id AND d.id = kk.id),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, keyword_rank NULLS LAST, id) AS rank FROM f)"""


@query(f"WITH {_HYBRID}, {_FUSE} SELECT query_id, id, dense_rank, dense_score, keyword_rank, score, rank FROM fr WHERE rank <= 20", views="docs_v")
def retrieval_hybrid_rrf(t: Tables) -> DataFrame:
    """JN-03, AGG-08, WIN-01, SET-02: the embedding of a query's number stands for its text."""
    dense = rt.exact_topk(t.embeddings, asked(t), 50)
    return rt.reciprocal_rank_fusion(dense, rt.keyword_recall(keyword_docs(t), keyword_queries(t), 50)).where("rank <= 20")


@query(
    f"WITH {_HYBRID.replace('kk AS (SELECT * FROM kr WHERE rank <= 50)', 'ks AS (SELECT query_id, id, score FROM kr WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = kr.id AND e.label IN (1, 2, 3))), kq AS (SELECT *, ' + _RANKED + ' AS rank FROM ks), kk AS (SELECT * FROM kq WHERE rank <= 50)').replace('AS rank FROM s)', 'AS rank FROM s WHERE label IN (1, 2, 3))')}, {_FUSE} SELECT query_id, id, dense_rank, dense_score, keyword_rank, score, rank FROM fr WHERE rank <= 20",
    views="docs_v",
)
def retrieval_hybrid_filtered(t: Tables) -> DataFrame:
    """JN-04, FLT-10: with a filter, keyword hits must pass it too and are ranked after it."""
    where = rt.Where((rt.Condition(("label",), "in", [1, 2, 3]),))
    points = t.embeddings.where(rt.predicate(where))
    allowed = points.select(F.col("vec_id").alias("id"))
    keyword = rt.keyword_recall(keyword_docs(t).join(allowed, "id", "left_semi"), keyword_queries(t), 50)
    return rt.reciprocal_rank_fusion(rt.exact_topk(points, asked(t), 50), keyword).where("rank <= 20")


@query(
    f"""WITH {_HYBRID}, {_FUSE}, u AS (SELECT 'dense' AS run, query_id, id, rank FROM d WHERE rank <= 20 UNION ALL SELECT 'hybrid', query_id, id, rank FROM fr WHERE rank <= 20), g AS (SELECT u.*, a.label = b.label AND u.query_id <> u.id AS hit FROM u JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id),
    h AS (SELECT run, query_id, min(rank) FILTER (hit) AS first_hit FROM g GROUP BY ALL) SELECT run, count(*) AS queries, round(avg((coalesce(first_hit <= 1, false))::INT), 9) AS hit_at_1, round(avg((coalesce(first_hit <= 3, false))::INT), 9) AS hit_at_3, round(avg((coalesce(first_hit <= 5, false))::INT), 9) AS hit_at_5, round(sum(coalesce(1.0::DOUBLE / first_hit, 0)) / count(*), 9) AS mrr FROM h GROUP BY run""",
    views="docs_v",
)
def eval_control_runs(t: Tables) -> DataFrame:
    """DOM-50: dense and hybrid retrieval over the same cases; a hit has the query's label and is not the query itself."""
    dense = rt.exact_topk(t.embeddings, asked(t), 50)
    hybrid = rt.reciprocal_rank_fusion(dense, rt.keyword_recall(keyword_docs(t), keyword_queries(t), 50))
    runs = dense.select(F.lit("dense").alias("run"), "query_id", "id", "rank").unionByName(hybrid.select(F.lit("hybrid").alias("run"), "query_id", "id", "rank")).where("rank <= 20")
    labels = t.embeddings.select("vec_id", "label")
    told = runs.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    first = told.groupBy("run", "query_id").agg(F.min(F.when((F.col("label") == F.col("wanted")) & (F.col("query_id") != F.col("id")), F.col("rank"))).alias("first_hit"))
    return ev.hit_rates(first, by=["run"])


_FILTERS = {
    "eq": ("=", "p_brand", "Brand#2", "p_brand = 'Brand#2'"),
    "ne": ("!=", "p_brand", "Brand#2", "p_brand IS DISTINCT FROM 'Brand#2'"),
    "contains": ("contains", "p_name", "ring", "contains(p_name, 'ring')"),
    "not_contains": ("not contains", "p_name", "ring", "NOT coalesce(contains(p_name, 'ring'), false)"),
    "in": ("in", "p_size", [1, 5, 9], "p_size IN (1, 5, 9)"),
    "not_in": ("not in", "p_size", [1, 5, 9], "NOT coalesce(p_size IN (1, 5, 9), false)"),
    "is_null": ("is null", "p_type", None, "(p_type IS NULL OR p_type = '')"),
    "not_null": ("is not null", "p_type", None, "(p_type IS NOT NULL AND p_type <> '')"),
}


def _register_filters() -> None:
    for name, (operator, column, value, condition) in _FILTERS.items():

        def run(t: Tables, operator: str = operator, column: str = column, value: object = value) -> DataFrame:
            """One comparison operator of FLT-01 to FLT-08."""
            return t.part.where(rt.predicate(rt.Where((rt.Condition((column,), operator, value),)))).select("p_partkey", column)

        run.__name__ = f"retrieval_filter_{name}"
        query(f"SELECT p_partkey, {column} FROM part WHERE {condition}")(run)


_register_filters()


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE (contains(p_name, 'ring') OR contains(p_type, 'ring')) OR p_brand = 'Brand#7'")
def retrieval_filter_group(t: Tables) -> DataFrame:
    """FLT-10: anything but "and" is "or"; a condition over several names holds if one does."""
    where = rt.Where((rt.Condition(("p_name", "p_type"), "contains", "ring"), rt.Condition(("p_brand",), "eq", "Brand#7")), "or")
    return t.part.where(rt.predicate(where)).select("p_partkey", "p_name", "p_brand", "p_type")


@query(
    f"""WITH {_DENSE}, r AS (SELECT *, {_RANKED} AS rank FROM s) SELECT r.query_id, r.id, r.rank, coalesce(d.title, r.label::VARCHAR, '') AS text, l.quality, coalesce(l.quality::DOUBLE, r.score) AS final_score
    FROM r LEFT JOIN docs_v d ON d.doc_id = r.id LEFT JOIN labels l ON l.doc_id = r.id WHERE r.rank <= 10""",
    views="docs_v",
)
def retrieval_enrich_left_join(t: Tables) -> DataFrame:
    """JN-05, SRC-13, MTH-04, MTH-08: text by key from another table, else the hit's own; a rerank score before the embedding's."""
    hits = rt.exact_topk(t.embeddings, asked(t), 10).join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label")), "id")
    source = t.docs_v.select(F.col("doc_id").alias("key"), F.col("title").alias("text"))
    found = rt.enriched(hits.withColumn("key", F.col("id").cast("string")), source, "key", "text", "label")
    return found.join(t.labels.select(F.col("doc_id").alias("id"), "quality"), "id", "left").select("query_id", "id", "rank", "text", "quality", F.coalesce(F.col("quality").cast("double"), "score").alias("final_score"))


@query(f"""WITH {_DENSE}, r AS (SELECT *, {_RANKED} AS rank FROM s), h AS (SELECT query_id, id, rank - 1 AS pos FROM r WHERE rank <= 20),
    b AS (SELECT query_id, id, pos, CASE WHEN id % 3 = 0 THEN (id % 7)::DOUBLE END AS relevance FROM h),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, pos) AS rank FROM b) SELECT query_id, id, pos, relevance, rank FROM o WHERE rank <= 10""")
def retrieval_rerank_fill(t: Tables) -> DataFrame:
    """TOP-05, TOP-06, DOM-04: a scorer that answers for some indices only (and for one twice, and for one that is none)."""
    hits = rt.exact_topk(t.embeddings, asked(t), 20).select("query_id", "id", (F.col("rank") - 1).alias("pos"))
    scored = hits.where("id % 3 = 0").select("query_id", F.col("pos").alias("index"), (F.col("id") % 7).cast("double").alias("relevance"))
    worse, outside = scored.withColumn("relevance", F.col("relevance") - 1), scored.withColumn("index", F.lit(999).cast("long"))
    return rt.reranked(hits, scored.unionByName(worse).unionByName(outside), 10)


_ASCII, _FULL = "".join(map(chr, range(0x21, 0x7F))).replace("'", "").replace("\\", ""), "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F) if chr(c) not in "'\\")
_SURFACES = f"""SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN '《' || translate(left(text, 60), '{_ASCII} ', '{_FULL}　') || '》' || substr(text, 61) WHEN 2 THEN '第 ' || item_id || '  条 〔 2020 〕' || item_id || ' 号,第 五 章 ' || text
    WHEN 3 THEN '【' || left(text, 40) || '】  「' || substr(text, 41) || '」 ' ELSE '第　十二　款［　１９９９　］　７　号' END AS query FROM benchmark"""
_SYNONYMS = [(0, "the", "a"), (1, "and", "plus"), (2, "and", "also"), (3, "号", "号文"), (4, "of", "from")]


@query(
    f"""WITH q AS ({_SURFACES}), a AS (SELECT *, translate(translate(query, '{_FULL}＇＼　', '{_ASCII}''\\ '), '【】〔〕［］《》〈〉「」『』', '[][][]') AS x FROM q),
    b AS (SELECT *, regexp_replace(regexp_replace(x, '第\\s*([0-9一二三四五六七八九十百千零两]+)\\s*(条|款|项|号|章|节)', '第\\1\\2', 'g'), '\\[\\s*(\\d+)\\s*\\]', '[\\1]', 'g') AS y FROM a), n AS (SELECT query_id, query, trim(regexp_replace(regexp_replace(y, '(\\d+)\\s*号', '\\1号', 'g'), '\\s+', ' ', 'g')) AS form FROM b),
    u AS (SELECT query_id, 0 AS src, 'original' AS source, 0 AS ord, query AS phrasing FROM n UNION ALL SELECT query_id, 1, 'normalised', 0, form FROM n UNION ALL SELECT query_id, 2, 'synonym', s.ord, replace(form, s.term, s.synonym) FROM n JOIN (VALUES {", ".join(map(str, _SYNONYMS))}) s(ord, term, synonym) ON contains(form, s.term)),
    f AS (SELECT query_id, phrasing, min({{'src': src, 'ord': ord, 'source': source}}) AS seen FROM u WHERE trim(phrasing) <> '' GROUP BY ALL),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seen.src, seen.ord, phrasing) AS ordinal, phrasing, seen.source AS source FROM f) SELECT query_id, ordinal, phrasing, source FROM r WHERE ordinal <= 4"""
)
def query_plan_expand(t: Tables) -> DataFrame:
    """STR-01 to STR-04, SET-03: passages as queries, some in full-width forms, with marks, clauses and document numbers."""
    text, item = F.col("text"), F.col("item_id").cast("string")
    kind = F.col("item_id") % 5
    query_text = (
        F.when(kind == 0, text).when(kind == 1, F.concat(F.lit("《"), F.translate(F.left(text, F.lit(60)), f"{_ASCII} ", f"{_FULL}　"), F.lit("》"), F.expr("substring(text, 61)")))
        .when(kind == 2, F.concat(F.lit("第 "), item, F.lit("  条 〔 2020 〕"), item, F.lit(" 号,第 五 章 "), text))
        .when(kind == 3, F.concat(F.lit("【"), F.left(text, F.lit(40)), F.lit("】  「"), F.expr("substring(text, 41)"), F.lit("」 "))).otherwise(F.lit("第　十二　款［　１９９９　］　７　号"))
    )
    synonyms = F.broadcast(t.spark.createDataFrame(_SYNONYMS, "ordinal int, term string, synonym string"))
    return rt.query_plan(t.benchmark.select(F.col("item_id").alias("query_id"), query_text.alias("query")), synonyms)


@query("SELECT conv_id, CASE WHEN x = '' THEN 'New conversation' WHEN length(x) > 28 THEN left(x, 28) || '…' ELSE x END AS title FROM (SELECT conv_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS x FROM conversations WHERE turn = 0)")
def text_title(t: Tables) -> DataFrame:
    """STR-16."""
    return t.conversations.where("turn = 0").select("conv_id", tx.short_title(F.col("text")).alias("title"))


@query("SELECT doc_id, substr(text, s0 + 1, least(s0 + 120, length(text)) - s0) AS around, substr(text, b0 + 1, least(300, length(text) - b0)) AS budgeted FROM (SELECT *, greatest(n_chars // 3 - 50, 0) AS s0, greatest(n_chars // 3 - 140, 0) AS b0 FROM documents)")
def text_window(t: Tables) -> DataFrame:
    """STR-17, STR-18: 50 characters around a span of 20, and 300 in all."""
    at = F.expr("n_chars div 3")
    around = F.expr("substring(text, cast(greatest(n_chars div 3 - 50, 0) + 1 as int), cast(least(greatest(n_chars div 3 - 50, 0) + 120, length(text)) - greatest(n_chars div 3 - 50, 0) as int))")
    return t.documents.select("doc_id", around.alias("around"), tx.budget_window(F.col("text"), at, at + 20, 300).alias("budgeted"))


@query("SELECT doc_id, length(h) - length(replace(h, chr(10), '')) + 1 AS line FROM (SELECT doc_id, left(text, n_chars // 2) AS h FROM documents)")
def text_line_location(t: Tables) -> DataFrame:
    """STR-19."""
    return t.documents.select("doc_id", tx.line_number(F.col("text"), F.expr("n_chars div 2")).alias("line"))


@query(
    """WITH p AS (SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    g AS (SELECT *, [substr(x, i, 2) FOR i IN range(1, length(x))] AS bx, [substr(y, i, 2) FOR i IN range(1, length(y))] AS by_, list_distinct(string_split(x, ' ')) AS wx, list_distinct(string_split(y, ' ')) AS wy FROM p),
    m AS (SELECT *, list_sum([least(len(list_filter(bx, lambda c: c = q)), len(list_filter(by_, lambda c: c = q))) FOR q IN list_distinct(bx)])::BIGINT AS common FROM g),
    s AS (SELECT left_key, right_key, CASE WHEN x = y THEN 1000000 ELSE (2 * (2 * common) * 1000000 + (len(bx) + len(by_))) // (2 * (len(bx) + len(by_))) END AS dice,
        (2 * len(list_intersect(wx, wy)) * 1000000 + len(list_distinct(list_concat(wx, wy)))) // (2 * len(list_distinct(list_concat(wx, wy)))) AS jaccard,
        CASE WHEN contains(x, y) OR contains(y, x) THEN (2 * least(length(x), length(y)) * 1000000 + greatest(length(x), length(y))) // (2 * greatest(length(x), length(y))) ELSE 0 END AS containment FROM m)
    SELECT left_key, right_key, dice::BIGINT AS dice, jaccard::BIGINT AS jaccard, containment::BIGINT AS containment, greatest(dice, jaccard, containment)::BIGINT AS score FROM s"""
)
def text_lexical_scores(t: Tables) -> DataFrame:
    """STR-12 to STR-15, MTH-01: each part's name against the next one's."""
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not to be put together, nor left as the file lies
    a = t.part.select(F.col("p_partkey").alias("left_key"), F.col("p_name").alias("x"))
    b = t.part.select(F.col("p_partkey").alias("right_key"), F.col("p_name").alias("y"), (F.col("p_partkey") - 1).alias("left_key"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "left_key").repartition(parts, "left_key", "right_key").select("left_key", "right_key", tx.dice_micros(x, y).alias("dice"), tx.jaccard_micros(x, y).alias("jaccard"), tx.containment_micros(x, y).alias("containment"), tx.pair_score(x, y).alias("score"))


@query("""WITH f AS (SELECT page_id, array_to_string([s FOR s IN string_split(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/') IF trim(s) <> '' AND s <> '.'], '/') AS path FROM pages)
    SELECT page_id, path, (path = 'fr' OR starts_with(path, 'fr/')) AS inside, CASE WHEN path = 'fr' OR starts_with(path, 'fr/') THEN 'archive/fr' || substr(path, 3) ELSE path END AS renamed FROM f""")
def text_folder_rename(t: Tables) -> DataFrame:
    """STR-24, STR-25, FLT-21."""
    path = F.col("path")
    pages = t.pages.select("page_id", tx.folder(F.regexp_extract("url", "^https?://[^/]+/([^?]*)", 1)).alias("path"))
    return pages.select("page_id", "path", tx.below(path, F.lit("fr")).alias("inside"), tx.moved(path, F.lit("fr"), F.lit("archive/fr")).alias("renamed"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS x FROM documents), f AS (SELECT *, trim(regexp_extract(x, '^([^.!?]*[.!?]?)', 1)) AS first FROM c)
    SELECT doc_id, CASE WHEN length(first) BETWEEN 8 AND 120 THEN first ELSE left(x, 80) END AS query, substr(x, length(x) // 3 + 1, 30) AS fragment FROM f""")
def text_pseudo_query(t: Tables) -> DataFrame:
    """STR-21."""
    return t.documents.select("doc_id", tx.pseudo_query(F.col("text")).alias("query"), tx.fragment(F.col("text")).alias("fragment"))


@query("SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS chars FROM documents")
def text_nonblank_chars(t: Tables) -> DataFrame:
    """STR-20."""
    return t.documents.select("doc_id", tx.nonblank_chars(F.col("text")).alias("chars"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[ \\t\\n\\r]+', ' ', 'g')) AS name, left(c_name, 12) AS short, replace(lower(c_mktsegment), ' ', '_') AS slug FROM customer")
def text_normalize_graph(t: Tables) -> DataFrame:
    """STR-06, STR-26, STR-29."""
    return t.customer.select("c_custkey", tx.graph_name(F.col("c_name")).alias("name"), F.left("c_name", F.lit(12)).alias("short"), F.replace(F.lower("c_mktsegment"), F.lit(" "), F.lit("_")).alias("slug"))


@query("SELECT item_id, b.norm AS norm, count(d.doc_id) AS documents FROM (SELECT item_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS norm FROM benchmark WHERE item_id % 20 = 0) b LEFT JOIN (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS norm FROM documents) d ON contains(d.norm, b.norm) GROUP BY ALL")
def text_normalize_eval(t: Tables) -> DataFrame:
    """STR-07, STR-08: in how many documents a passage lies, both in normal form."""
    items = t.benchmark.where("item_id % 20 = 0").select("item_id", tx.collapsed(F.lower("text")).alias("norm"))
    return rt.documents_holding(t.documents.select(tx.collapsed(F.lower("text")).alias("doc")), items)


@query("SELECT l_orderkey, l_linenumber, array_to_string([x FOR x, i IN c IF i = 1 OR x <> c[i - 1]], ' | ') AS row FROM (SELECT l_orderkey, l_linenumber, [l_returnflag, l_returnflag, l_linestatus, l_partkey::VARCHAR, l_suppkey::VARCHAR] AS c FROM lineitem)")
def text_row_render(t: Tables) -> DataFrame:
    """STR-28."""
    cells = F.array("l_returnflag", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return t.lineitem.withColumn("cells", cells).select("l_orderkey", "l_linenumber", tx.row_text(F.col("cells")).alias("row"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN value < 10 THEN ['a', 'b'] ELSE [] END AS items FROM events""")
def text_json_array(t: Tables) -> DataFrame:
    """STR-22, STR-23: JSON in a code fence, and a list of strings in prose."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    prose = F.when(F.col("value") < 10, 'Here: ["a", "b", " "] done').otherwise("none [not json]")
    return t.events.select("event_id", F.get_json_object(tx.unfenced(fenced), "$.k").alias("k"), tx.strings_in(prose, 4).alias("items"))
