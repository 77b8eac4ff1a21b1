"""The queries over the driver's tables, each over whole tables, and the SQL that gives the same rows.

Drift is made from the documents: those whose id ends in 1 are no longer in the corpus, in 0 are not yet indexed, in 2 were indexed with another text, in 3
under another configuration; all others are indexed as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.identity import content_hash
from .functions.vector import norm, unit
from .operators import evaluation, explore, graph, search, segment, sync
from .operators.embed import FunctionEmbedder, HashingEmbedder, MultiEmbedder, cached, embedded
from .plans.config import Step
from .plans.manager import Manager, ingest, recipe_key
from .sources.corpora import collapse, documents
from .streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# identity and sources


def _norm(x: str) -> str:
    return f"regexp_replace(replace(nfc_normalize({x}), chr(65279), ''), '\\r\\n?', chr(10), 'g')"


def _hash(x: str) -> str:
    return f"sha256({_norm(x)})"


def _tokens(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length({x}) / 4.0, 0) AS INTEGER)) END"


LINES = f"""
lines_ AS (
  SELECT doc_id, text AS whole, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS idx, line, begin_
  FROM (
    SELECT doc_id, text, no, trim(part, chr(32) || chr(9)) AS line, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(part) - 1 + length(part) - length(ltrim(part, chr(32) || chr(9))) AS begin_
    FROM (SELECT doc_id, text, unnest(range(len(parts))) AS no, unnest(parts) AS part FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents))
  ) WHERE line <> ''
)"""


@query(f"SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id AS ord, {_hash('text')} AS source_hash, '{{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}}' AS metadata FROM documents")
def corpus_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select("source_id", "ord", "source_hash", "metadata")


@query(f"SELECT {_hash('text')} AS source_hash, min(doc_id) AS ord, arg_max(text, doc_id) AS text, count(*) AS copies FROM documents GROUP BY 1")
def dedup_sources(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("source_id", F.col("source_hash"))
    return collapse(rows).select("source_hash", "ord", "text").join(rows.groupBy("source_hash").agg(F.count("*").alias("copies")), "source_hash")


@query(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def approx_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


# segments

_SEGMENT_ID = "sha256({norm} || '{{\"tokenizer\":\"char-approx\"}}')"


@query(f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS source_id, idx, line AS text, {_tokens('line')} AS tokens, {_SEGMENT_ID.format(norm=_norm('line'))} AS segment_id FROM lines_")
def segment_lines(spark, sf_dir):
    return segment.Lines().texts(documents(spark, sf_dir))


@query(f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS source_id, idx, line AS text, CAST(begin_ AS INTEGER) AS start, CAST(begin_ + length(line) AS INTEGER) AS "end" FROM lines_""")
def segment_line_offsets(spark, sf_dir):
    return segment.Lines().segments(documents(spark, sf_dir)).select("source_id", "idx", "text", "start", "end")


@query(f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS source_id, idx, substr(whole, CAST(begin_ + 1 AS BIGINT), length(line) + 20) AS text, CAST(least(length(whole), begin_ + length(line) + 20) AS INTEGER) AS "end", {_tokens("substr(whole, CAST(begin_ + 1 AS BIGINT), length(line) + 20)")} AS tokens FROM lines_""")
def line_overlap(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return segment.with_overlap(segment.Lines().segments(docs), docs, 20).select("source_id", "idx", "text", "end", "tokens")


@query()
def segment_recursive(spark, sf_dir):
    return segment.Recursive().segments(documents(spark, sf_dir)).select("source_id", "idx", "start", "end", "text", "tokens", "segment_id")


@query()
def segment_hierarchical(spark, sf_dir):
    levels = [segment.Recursive(512, 0), segment.Recursive(128, 16)]
    return segment.hierarchical(levels, documents(spark, sf_dir)).select("source_id", "level", "idx", "start", "end", "text", "parent_id", "segment_id")


def _sentences(text: str) -> list[str]:
    return [s for s in text.split(". ") if s]


@query("""WITH s AS (SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents))
SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS idx, text FROM s WHERE text <> ''""")
def segment_function(spark, sf_dir):
    return segment.Function(_sentences, "sentences").segments(documents(spark, sf_dir)).select("source_id", "idx", "text")


# embeddings


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) AS gram FROM w)
SELECT doc_id, gram, count(*) AS times, round(1 + ln(count(*)), 9) AS weight FROM g GROUP BY doc_id, gram""")
def term_weights(spark, sf_dir):
    """Grams are counted in their document's row. Only documents that share an id, if there are any, are brought together."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda rows: T.counted(rows.select("doc_id", T.ngrams(T.words(F.col("text"))).alias("grams")), "doc_id", "grams").withColumnRenamed("item", "gram")
    shared = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("shared"))
    if shared.isEmpty():
        grams = count(docs)
    else:
        same = F.col("doc_id").eqNullSafe(F.col("shared"))
        few = shared.hint("shuffle_hash")
        grams = count(docs.join(few, same, "left_anti")).unionByName(count(docs.join(few, same, "left_semi")).groupBy("doc_id", "gram").agg(F.sum("times").alias("times")))
    return grams.withColumn("weight", F.round(1 + F.log("times"), 9))


@query()
def hashing_embed(spark, sf_dir):
    return embedded(documents(spark, sf_dir).select("source_id", "text"), HashingEmbedder(256)).drop("text")


def _letters(texts):
    return np.array([[len(t), *map(t.count, "eao")] for t in texts], np.float32)


def _halves(texts):
    return _letters(texts) / 2


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(length(text) / f AS FLOAT) AS n, CAST((length(text) - length(replace(text, 'e', ''))) / f AS FLOAT) AS e
FROM (SELECT doc_id, text, CASE WHEN length(text) < 1000 THEN 1.0 ELSE 2.0 END AS f FROM documents)""")
def multi_route(spark, sf_dir):
    router = MultiEmbedder({"short": FunctionEmbedder(_letters, "letters", 4)}, lambda t: "short" if len(t) < 1000 else "long", FunctionEmbedder(_halves, "halves", 4))
    rows = embedded(documents(spark, sf_dir).select("source_id", "text"), router)
    return rows.select("source_id", F.col("vector")[0].alias("n"), F.col("vector")[1].alias("e"))


@query("""SELECT vec_id, size, i - 1 AS i, round(embedding[i] / sqrt(s), 6) AS x
FROM (SELECT *, round(sqrt(s), 6) AS size, unnest(range(1, len(embedding) + 1)) AS i FROM (SELECT *, list_sum([CAST(x AS DOUBLE) * x for x in embedding]) AS s FROM embeddings))""")
def normalize_vectors(spark, sf_dir):
    """Every coordinate of the normalised vectors."""
    rows = read(spark, sf_dir, "embeddings")
    rows = rows.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("size"), F.posexplode(unit(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", "size", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""WITH t AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)
SELECT CASE WHEN first % 3 = 0 THEN 'hit' ELSE 'miss' END AS found, count(*) AS texts, CAST(sum(length(text)) AS DOUBLE) AS total FROM t GROUP BY 1""")
def cache_lookup(spark, sf_dir):
    """A third of the distinct texts have cached vectors (their length, negated, to tell them apart); the rest are embedded."""
    docs = documents(spark, sf_dir).select("source_id", "text", "ord")
    model = FunctionEmbedder(_letters, "letters", 4)
    texts = docs.groupBy("text").agg(F.min("ord").alias("first"))
    from .functions.identity import cache_key

    known = texts.where("first % 3 = 0").select(cache_key("letters", False, "document", F.col("text")).alias("key"), F.array(*[(-F.length("text")).cast("float")] * 4).alias("vector"))
    rows, _ = cached(texts, model, known)
    size = F.col("vector")[0].cast("double")
    return rows.groupBy(F.when(size < 0, "hit").otherwise("miss").alias("found")).agg(F.count("*").alias("texts"), F.sum(F.abs(size)).alias("total"))


# search


def vector_index(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("segment_id"), F.col("vec_id").alias("ord"), F.lit(0).alias("idx"), F.col("embedding").alias("vector"), "label", F.to_json(F.struct("label")).alias("metadata"))


def _query_vector(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


_COSINE = "round(coalesce(list_sum([CAST(a.embedding[i] AS DOUBLE) * b.embedding[i] for i in range(1, len(a.embedding) + 1)]) / nullif(sqrt(list_sum([CAST(x AS DOUBLE) * x for x in a.embedding])) * sqrt(list_sum([CAST(x AS DOUBLE) * x for x in b.embedding])), 0), 0), 9)"


def _search_sql(where: str = "true", limit: int = 10) -> str:
    return f"""WITH a AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT b.vec_id, b.label, {_COSINE} AS score FROM a, embeddings b WHERE {where}),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT vec_id, label, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {limit}"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select(F.col("segment_id").cast("long").alias("vec_id"), "label", F.round("score", 6).alias("score"), "rank")


@query(_search_sql())
def search_top_k(spark, sf_dir):
    return _hits(search.top_k(vector_index(spark, sf_dir), _query_vector(spark, sf_dir), 10))


@query(_search_sql("label = 3"))
def search_filtered(spark, sf_dir):
    return _hits(search.top_k(vector_index(spark, sf_dir), _query_vector(spark, sf_dir), 10, {"label": 3}))


@query(_search_sql("label IN (1, 2, 5) OR label > 7", 20))
def search_filter_grammar(spark, sf_dir):
    return _hits(search.top_k(vector_index(spark, sf_dir), _query_vector(spark, sf_dir), 20, {"$or": [{"label": {"$in": [1, 2, 5]}}, {"$not": {"label": {"$lte": 7}}}]}))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source <> 'src0' OR n_chars > 20000")
def metadata_filter(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("n", F.length("text").cast("long"))
    spec = {"$or": [{"lang": {"$in": ["de", "fr"]}, "source": {"$ne": "src0"}}, {"n": {"$gt": 20000}}]}
    kept = search.filtered(docs, spec)
    return kept.select(F.col("source_id").cast("long").alias("doc_id"), F.get_json_object("metadata", "$.lang").alias("lang"), F.get_json_object("metadata", "$.source").alias("source"))


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COSINE} AS score FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS VARCHAR) AS query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def batch_top_k(spark, sf_dir):
    """Every vector is a query."""
    index = vector_index(spark, sf_dir)
    asked = index.select(F.col("segment_id").alias("query_id"), "vector")
    return search.batch_top_k(index, asked, 5).select("query_id", F.col("key").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(_search_sql("true", 50).replace("SELECT vec_id, label, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50",
       "SELECT * FROM (SELECT vec_id, CAST(row_number() OVER (ORDER BY label DESC, rank) AS INTEGER) AS rank, CAST(label AS DOUBLE) AS rerank_score FROM r WHERE rank <= 50) WHERE rank <= 10"))
def rerank_top_k(spark, sf_dir):
    """The best 50 by cosine, then the best 10 by label."""
    hits = search.top_k(vector_index(spark, sf_dir), _query_vector(spark, sf_dir), 50)
    return search.rerank(hits, F.col("label"), limit=10).select(F.col("segment_id").cast("long").alias("vec_id"), "rank", "rerank_score")


@query()
def retrieve_segments(spark, sf_dir):
    """The text of the first benchmark item looked up in all documents."""
    asked = read(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    found = ingest(spark, documents(spark, sf_dir), segment.Recursive(), HashingEmbedder(256)).retrieve(asked, 10)
    return found.select("source_id", "segment_id", "text", "metadata", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best segments of the documents for the first benchmark item's text."""
    asked = read(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    return ingest(spark, documents(spark, sf_dir), segment.Recursive(), HashingEmbedder(256)).search(asked, 10).select("source_id", "idx", "start", "end", "text", "score", "rank")


# index maintenance

_KINDS = f"""
corpus_ AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, {_hash('text')} AS source_hash FROM documents WHERE doc_id % 10 <> 1),
index_ AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id AS ord, CASE WHEN doc_id % 10 = 2 THEN {_hash("text || ' (old)'")} ELSE {_hash('text')} END AS source_hash,
         CASE WHEN doc_id % 10 = 3 THEN 'other' ELSE 'config' END AS config_hash, {_hash('text')} AS segment_id
  FROM documents WHERE doc_id % 10 <> 0
),
flags_ AS (
  SELECT coalesce(c.source_id, i.source_id) AS source_id, c.source_id IS NULL AS is_orphan, i.source_id IS NULL AS is_missing,
         coalesce(c.source_hash <> i.source_hash, false) AS is_stale, coalesce(c.source_id IS NOT NULL AND i.config_hash <> 'config', false) AS is_misconfigured,
         coalesce(c.source_hash = i.source_hash AND i.config_hash = 'config', false) AS is_fresh
  FROM corpus_ c FULL JOIN index_ i ON c.source_id = i.source_id
)"""


def drift(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(corpus, index) with every kind of drift."""
    docs = documents(spark, sf_dir)
    n = F.col("ord") % 10
    old = content_hash(F.concat("text", F.lit(" (old)")))
    index = docs.where(n != 0).select(
        "source_id", "ord", F.lit(0).alias("idx"), F.when(n == 2, old).otherwise(F.col("source_hash")).alias("source_hash"), F.when(n == 3, "other").otherwise("config").alias("config_hash"), F.col("source_hash").alias("segment_id")
    )
    return docs.where(n != 1), index


@query(f"""WITH {_KINDS}
SELECT coalesce(i.source_id, c.source_id) AS source_id, CASE WHEN i.source_id IS NULL THEN 'added' WHEN c.source_id IS NULL THEN 'deleted' WHEN i.source_hash = c.source_hash THEN 'unchanged' ELSE 'modified' END AS status,
       i.source_hash AS old_hash, c.source_hash AS new_hash
FROM index_ i FULL JOIN corpus_ c ON i.source_id = c.source_id""")
def corpus_diff(spark, sf_dir):
    corpus, index = drift(spark, sf_dir)
    return sync.corpus_diff(index, corpus)


@query(f"WITH {_KINDS} SELECT source_id, array_to_string(list_sort(list(segment_id)), ',') AS doc_ids, array_to_string(list_sort(list_distinct(list(source_hash))), ',') AS source_hashes, array_to_string(list_sort(list_distinct(list(config_hash))), ',') AS config_hashes FROM index_ GROUP BY source_id")
def indexed_state(spark, sf_dir):
    found = sync.indexed_state(drift(spark, sf_dir)[1])
    return found.select("source_id", *[F.array_join(c, ",").alias(c) for c in ("doc_ids", "source_hashes", "config_hashes")])


@query(f"WITH {_KINDS} SELECT * FROM flags_")
def diagnose(spark, sf_dir):
    corpus, index = drift(spark, sf_dir)
    return sync.diagnose(corpus, index, "config")


def _plan_sql(drop: str, scope: str = "true") -> str:
    return f"""WITH {_KINDS}, p AS (SELECT source_id, {drop} AS to_delete, is_missing OR is_stale OR is_misconfigured AS to_materialize FROM flags_ WHERE {scope}) SELECT * FROM p WHERE to_delete OR to_materialize"""


def _plan(mode: str, drop: str, scoped: bool = False):
    @query(_plan_sql(drop, "CAST(source_id AS BIGINT) % 4 = 0" if scoped else "true"), f"plan_refresh_{mode}")
    def run(spark, sf_dir):
        corpus, index = drift(spark, sf_dir)
        scope = read(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("source_id")) if scoped else None
        return sync.plan_refresh(sync.diagnose(corpus, index, "config"), mode, scope)


_plan("none", "false")
_plan("incremental", "(is_stale OR is_misconfigured)")
_plan("full", "(is_stale OR is_misconfigured OR is_orphan)")
_plan("scoped_full", "(is_stale OR is_misconfigured OR is_orphan)", True)


@query(f"WITH {_KINDS} SELECT source_id, source_hash, config_hash FROM index_ WHERE source_id IN (SELECT source_id FROM corpus_)")
def gc_orphans(spark, sf_dir):
    corpus, index = drift(spark, sf_dir)
    return sync.gc_orphans(index, corpus).select("source_id", "source_hash", "config_hash")


@query(f"WITH {_KINDS} SELECT source_id, source_hash, 'config' AS config_hash FROM corpus_")
def refresh_result(spark, sf_dir):
    corpus, index = drift(spark, sf_dir)
    plan = sync.plan_refresh(sync.diagnose(corpus, index, "config"), "full")
    fresh = corpus.join(plan.where("to_materialize"), "source_id", "left_semi").select("source_id", "ord", F.lit(0).alias("idx"), "source_hash", F.lit("config").alias("config_hash"), F.col("source_hash").alias("segment_id"))
    return sync.refresh(index, plan, fresh).select("source_id", "source_hash", "config_hash")


@query(f"WITH {_KINDS} SELECT source_id, CASE WHEN is_missing THEN 'added' WHEN is_orphan THEN 'deleted' ELSE 'updated' END AS action FROM flags_ WHERE NOT is_fresh")
def refresh_report(spark, sf_dir):
    corpus, index = drift(spark, sf_dir)
    report = sync.diagnose(corpus, index, "config")
    return sync.refresh_report(sync.plan_refresh(report, "full"), report)


@query(f"WITH {_KINDS} SELECT segment_id, arg_max(source_id, ord) AS source_id, max(ord) AS ord FROM index_ GROUP BY segment_id")
def last_writer(spark, sf_dir):
    return sync.last_writer(drift(spark, sf_dir)[1]).select("segment_id", "source_id", "ord")


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'updated' END AS action
FROM documents WHERE doc_id % 10 < 3""")
def manager_refresh(spark, sf_dir):
    """A manager indexes the documents as they were, then refreshes to what they are: after it all are fresh."""
    corpus, index = drift(spark, sf_dir)
    docs = documents(spark, sf_dir)
    old = index.select("source_id", F.col("source_hash").alias("h")).join(docs, "source_id").withColumn("text", F.when(F.col("h") == F.col("source_hash"), F.col("text")).otherwise(F.concat("text", F.lit(" (old)")))).drop("h")
    manager = Manager(spark, old.drop("source_hash"), segment.Recursive(), HashingEmbedder(64))
    manager.materialize()
    manager.set_corpus(corpus)
    return manager.refresh().actions


# lineage

_STEPS = (Step("segment:line-segmenter"), Step("embed:hashing:v1@64", "1", {"input_type": "document"}))


def lineage_edges(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).select("source_hash").distinct()
    first, _ = recipe_key(_STEPS[0], F.col("source_hash"))
    edges = rows.select(F.col("source_hash").alias("src"), first.alias("dst"))
    second, _ = recipe_key(_STEPS[1], F.col("dst"))
    return edges.union(edges.select(F.col("dst").alias("src"), second.alias("dst")))


_EDGES = f"""
leaf_ AS (SELECT DISTINCT {_hash('text')} AS h FROM documents),
seg_ AS (SELECT h, sha256('{{"inputs":["' || h || '"],"op":"segment:line-segmenter","op_version":"1","params":{{}}}}') AS s FROM leaf_),
vec_ AS (SELECT h, s, sha256('{{"inputs":["' || s || '"],"op":"embed:hashing:v1@64","op_version":"1","params":{{"input_type":"document"}}}}') AS v FROM seg_),
edges_ AS (SELECT h AS src, s AS dst FROM vec_ UNION ALL SELECT s, v FROM vec_)"""


@query(f"WITH RECURSIVE {_EDGES}, reach(seed, node) AS (SELECT src, dst FROM edges_ WHERE src IN (SELECT h FROM leaf_) UNION SELECT r.seed, e.dst FROM reach r JOIN edges_ e ON e.src = r.node) SELECT seed, node FROM reach")
def lineage_descendants(spark, sf_dir):
    return graph.descendants(lineage_edges(spark, sf_dir), documents(spark, sf_dir).select(F.col("source_hash").alias("seed")))


@query(f"WITH RECURSIVE {_EDGES}, reach(seed, node) AS (SELECT dst, src FROM edges_ UNION SELECT r.seed, e.src FROM reach r JOIN edges_ e ON e.dst = r.node) SELECT seed, node FROM reach")
def lineage_ancestors(spark, sf_dir):
    edges = lineage_edges(spark, sf_dir)
    return graph.ancestors(edges, edges.select(F.col("dst").alias("seed")))


@query(f"WITH {_EDGES}, dead AS (SELECT {_hash('text')} AS h FROM documents GROUP BY 1 HAVING min(doc_id) % 10 = 1) SELECT src, dst FROM edges_ WHERE src NOT IN (SELECT h FROM dead) AND src NOT IN (SELECT s FROM vec_ WHERE h IN (SELECT h FROM dead))")
def prune_dead_leaves(spark, sf_dir):
    """Leaves of the drifted corpus' orphans go (those whose text no other document has first), and what was made of them."""
    edges = lineage_edges(spark, sf_dir)
    leaves = documents(spark, sf_dir).groupBy(F.col("source_hash").alias("artifact_id")).agg(F.min("ord").alias("ord"))
    rows = leaves.select("artifact_id", F.lit(None).cast("string").alias("op")).union(edges.select("dst", F.lit("step"))).distinct()
    return graph.prune_dead_leaves(rows, edges, leaves.where("ord % 10 <> 1").select("artifact_id"))[1]


# evaluation


def label_qrels(spark, sf_dir) -> evaluation.Classes:
    """Vectors of one label are relevant to each other."""
    return evaluation.Classes(read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "label"))


def label_runs(spark, sf_dir) -> DataFrame:
    index = vector_index(spark, sf_dir)
    found = search.batch_top_k(index, index.select(F.col("segment_id").alias("query_id"), "vector"), 11)
    others = found.where("key <> query_id").select("query_id", F.col("key").alias("doc_id"), "rank")
    return others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


_RUNS = f"""
s AS (SELECT a.vec_id AS q, b.vec_id AS d, (a.label = b.label)::INT AS rel, {_COSINE} AS score FROM embeddings a, embeddings b),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM s),
r AS (SELECT q, d, rel, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM t WHERE rank <= 11 AND q <> d),
f AS (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rank) AS found FROM r),
n AS (SELECT a.vec_id AS q, count(*) AS pos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1),
k AS (SELECT unnest([1, 5, 10]) AS k),
g AS (SELECT k.k, n.q, n.pos, coalesce(sum(rel / log2(rank + 1)), 0) AS dcg, coalesce(sum(rel), 0) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, coalesce(sum(CASE WHEN rel = 1 THEN found / rank END), 0) AS ap
      FROM n CROSS JOIN k LEFT JOIN f ON f.q = n.q AND f.rank <= k.k GROUP BY ALL),
i AS (SELECT g.k, g.q, sum(1 / log2(x + 1)) AS idcg FROM g, (SELECT unnest(range(1, 11)) AS x) WHERE x <= least(g.k, g.pos) GROUP BY ALL),
m AS (
  SELECT q, 'ndcg' AS metric, k, dcg / idcg AS value FROM g JOIN i USING (k, q)
  UNION ALL SELECT q, 'recall', k, hits / pos FROM g UNION ALL SELECT q, 'precision', k, hits / k FROM g
  UNION ALL SELECT q, 'mrr', k, coalesce(1 / first, 0) FROM g UNION ALL SELECT q, 'map', k, ap / pos FROM g
)"""


@query(f"WITH {_RUNS} SELECT CAST(q AS VARCHAR) AS query_id, metric, CAST(k AS INTEGER) AS k, round(value, 6) AS value FROM m")
def retrieval_metrics(spark, sf_dir):
    found = evaluation.query_metrics(evaluation.deduplicated(label_runs(spark, sf_dir)), label_qrels(spark, sf_dir), (1, 5, 10))
    return found.withColumn("value", F.round("value", 6))


@query(f"WITH {_RUNS} SELECT metric, CAST(k AS INTEGER) AS k, round(avg(value), 6) AS value FROM m GROUP BY metric, k")
def retrieval_means(spark, sf_dir):
    index = vector_index(spark, sf_dir)
    means, _ = evaluation.evaluate_retrieval(label_runs(spark, sf_dir), label_qrels(spark, sf_dir), index.select(F.col("segment_id").alias("query_id"), "vector"), (1, 5, 10))
    return means.withColumn("value", F.round("value", 6))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_qrels(spark, sf_dir):
    """Which documents hold which benchmark item. The benchmark is the small side, and is broadcast only as Spark's own size check allows."""
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    return docs.join(items, F.contains("whole", "text")).select("item_id", "doc_id")


def rag_samples(spark, sf_dir) -> DataFrame:
    """Every turn with the next as response, the one before as reference, and the turns two away as contexts."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    near = F.array_compact(F.array(F.lag("text", 2).over(order), F.lead("text", 2).over(order)))
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.col("text").alias("user_input"), F.lead("text").over(order).alias("response"), F.lag("text").over(order).alias("reference"), near.alias("retrieved_contexts"))


def _words_sql(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"[w for w in regexp_split_to_array({bare}, '\\s+') if w not in ('', 'a', 'an', 'the')]"


_RAG = f"""
t AS (SELECT conv_id, turn, lead(text) OVER o AS response, lag(text) OVER o AS reference, lag(text, 2) OVER o AS c1, lead(text, 2) OVER o AS c2 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
w AS (SELECT *, {_words_sql("coalesce(response, '')")} AS a, {_words_sql("reference")} AS b, {_words_sql("c1")} AS w1, {_words_sql("c2")} AS w2 FROM t),
ca AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS x FROM w) GROUP BY ALL),
cb AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS x FROM w) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS both_ FROM ca JOIN cb USING (conv_id, turn, x) GROUP BY ALL),
m AS (
  SELECT conv_id, turn,
    CASE WHEN reference IS NOT NULL THEN CAST(array_to_string(a, ' ') = array_to_string(b, ' ') AS DOUBLE) END AS exact_match,
    CASE WHEN reference IS NULL THEN NULL WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2 * coalesce(both_, 0) / (len(a) + len(b)) END AS token_f1,
    CASE WHEN reference IS NOT NULL THEN coalesce(len(list_intersect(list_distinct(b), list_concat(coalesce(w1, []), coalesce(w2, [])))) / nullif(len(list_distinct(b)), 0), 0) END AS context_recall,
    CASE WHEN reference IS NOT NULL THEN coalesce(((c1 IS NOT NULL AND list_has_any(w1, b))::INT + (c2 IS NOT NULL AND list_has_any(w2, b))::INT) / nullif((c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT, 0), 0) END AS context_precision,
    CAST(trim(coalesce(response, '')) <> '' AS DOUBLE) AS non_empty_rate
  FROM w LEFT JOIN o USING (conv_id, turn)
)"""


@query(f"WITH {_RAG} SELECT conv_id, turn, exact_match, round(token_f1, 6) AS token_f1, round(context_recall, 6) AS context_recall, context_precision, non_empty_rate FROM m")
def rag_metrics(spark, sf_dir):
    m = evaluation.rag_metrics(rag_samples(spark, sf_dir))
    return m.select("conv_id", "turn", "exact_match", F.round("token_f1", 6).alias("token_f1"), F.round("context_recall", 6).alias("context_recall"), "context_precision", "non_empty_rate")


@query(f"WITH {_RAG} " + " UNION ALL ".join(f"SELECT '{x}' AS metric, round(coalesce(avg({x}), 0), 6) AS value, count({x}) AS coverage FROM m" for x in evaluation.RAG_METRICS))
def rag_means(spark, sf_dir):
    return evaluation.evaluate_rag(rag_samples(spark, sf_dir)).withColumn("value", F.round("value", 6))


# exploration


def _points(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query()
def pca(spark, sf_dir):
    return explore.pca(_points(spark, sf_dir), 2)


@query()
def kmeans(spark, sf_dir):
    return explore.cluster(_points(spark, sf_dir), n_clusters=8)


@query("""WITH c AS (SELECT label, [CAST(avg(x) AS DOUBLE) for x in [1]] AS dummy FROM (SELECT label, 1 AS x FROM embeddings) GROUP BY label),
u AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
d AS (SELECT e.vec_id AS id, u.label, round(sum((CAST(e.embedding[u.i] AS DOUBLE) - u.x) ** 2), 9) AS d FROM embeddings e, u GROUP BY ALL),
r AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY d, label) AS k FROM d)
SELECT id, label FROM r WHERE k = 1""".replace("c AS (SELECT label, [CAST(avg(x) AS DOUBLE) for x in [1]] AS dummy FROM (SELECT label, 1 AS x FROM embeddings) GROUP BY label),\n", ""))
def nearest_centre(spark, sf_dir):
    """One step of Lloyd's iteration: every vector goes to the nearest mean of the labels."""
    e = read(spark, sf_dir, "embeddings")
    size = len(e.first().embedding)
    means = e.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(size)]).alias("centre"))
    return explore.assign(_points(spark, sf_dir), means)


# changes


def event_feed(spark, sf_dir) -> DataFrame:
    """User events as versions of a source: errors delete it, else the type is its content."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.sha2("event_type", 256)).alias("source_hash"), "ts")


_FEED = """v AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS seq, CASE WHEN event_type <> 'error' THEN sha256(event_type) END AS new_hash FROM events),
l AS (SELECT *, lag(new_hash) OVER (PARTITION BY source_id ORDER BY seq) AS old_hash FROM v),
e AS (SELECT source_id, seq, CASE WHEN old_hash IS NULL AND new_hash IS NOT NULL THEN 'added' WHEN old_hash IS NOT NULL AND new_hash IS NULL THEN 'deleted' WHEN old_hash <> new_hash THEN 'modified' END AS kind, old_hash, new_hash FROM l)"""


@query(f"WITH {_FEED} SELECT * FROM e WHERE kind IS NOT NULL")
def change_events(spark, sf_dir):
    return changes.change_events(event_feed(spark, sf_dir))


@query(f"WITH {_FEED} SELECT source_id, arg_max_null(new_hash, seq) AS source_hash, max(seq) AS seq FROM v GROUP BY source_id")
def latest_versions(spark, sf_dir):
    return changes.latest(event_feed(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries"]
