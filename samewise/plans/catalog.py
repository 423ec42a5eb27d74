"""Every query of the core by name, over the whole test tables, and SQL that gives the same rows.

Records are the distinct ids of ``records`` with their contents, and the distinct ids of ``docs`` with their texts; nulls
are no records. Queries on containment, similarity and the pipeline compare normalised contents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A
from ..operators import blocks as B
from ..operators import containment as C
from ..operators import exact as E
from ..operators import follow_up as U
from ..operators import merge3 as M
from ..operators import similarity as S
from ..operators import text_pairs as T
from ..operators import triage as G
from ..session import materialise
from ..sources.tables import as_records, table
from . import files_plan as P

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# --- what the queries start from --------------------------------------------------------------------------------------


def _source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records").select("id", "content")


def _records(spark: SparkSession, folder: str, normalized: bool = False) -> DataFrame:
    return E.prepared(_source(spark, folder), normalized)


def _ids(spark: SparkSession, folder: str, normalized: bool = False) -> DataFrame:
    return E.identified(_source(spark, folder), normalized)


def _docs_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "docs").select("id", F.col("text").alias("content"))


def _docs(spark: SparkSession, folder: str, normalized: bool = False) -> DataFrame:
    return E.prepared(_docs_source(spark, folder), normalized)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """``id, text`` of docs."""
    return _docs(spark, folder).select("id", F.col("content").alias("text"))


def _unique(spark: SparkSession, folder: str, of=_source) -> DataFrame:
    records = of(spark, folder)
    return E.unique_records(records, E.identified(records, True), True)


def _left(spark: SparkSession, folder: str) -> DataFrame:
    unique = _unique(spark, folder)
    return C.survivors(unique, C.contained(unique))


_BOM, _LF, _CR = "chr(65279)", "chr(10)", "chr(13)"
_UNIFIED = f"regexp_replace(regexp_replace({{0}}, '^\\x{{{{FEFF}}}}', ''), '\\r\\n?', {_LF}, 'g')"
_NORMAL = f"regexp_replace({_UNIFIED}, '[ \\t]+(\\n|$)', '\\1', 'g')"
_SPACES = "[\\t-\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _sql_records(source: str = "records", column: str = "content") -> str:
    normal = _NORMAL.format("raw")
    return (
        f"rec AS (SELECT id, min({column}) AS raw FROM {source} WHERE id IS NOT NULL AND {column} IS NOT NULL GROUP BY id), "
        f"norm AS (SELECT id, raw, {normal} AS content FROM rec), "
        "uniq AS (SELECT min(id) AS id, content FROM norm GROUP BY content)"
    )


def _sql_lines(source: str) -> str:
    return f"ls AS (SELECT id, string_split(content, {_LF}) AS l, len(list_filter(string_split(content, {_LF}), lambda x: x <> '')) AS nb FROM {source})"


def _sql_pairs(guard: str = "a.nb >= 5 AND b.nb <= 20 * a.nb AND ") -> str:
    greedy = "list_reduce(b.l, lambda i, v: CASE WHEN a.l[i + 1] = v THEN i + 1 ELSE i END, 0) = len(a.l)"
    return f"pairs AS (SELECT a.id AS subset, b.id AS superset, a.l AS sub, b.l AS full_ FROM ls a JOIN ls b ON a.id <> b.id AND {guard}a.nb <= b.nb AND list_contains(b.l, a.l[1]) AND {greedy})"


_WITH_PAIRS = f"WITH RECURSIVE {_sql_records()}, {_sql_lines('uniq')}, {_sql_pairs()}"
_WITH_LEFT = f"{_WITH_PAIRS}, surv AS (SELECT id, content FROM uniq WHERE id NOT IN (SELECT subset FROM pairs))"
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOPWORDS) + "]"


def _sql_vectors(source: str) -> str:
    return (
        f"tok AS (SELECT id, list_filter(regexp_extract_all(lower(content), '[a-z0-9]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS ts FROM {source}), "
        "tf AS (SELECT id, n, t, count(*) AS c FROM (SELECT id, len(ts) AS n, unnest(ts) AS t FROM tok) GROUP BY id, n, t), "
        "df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), "
        f"vec AS (SELECT id, tf.t, c / n * (ln((SELECT count(*) + 1.0 FROM {source}) / (df + 1)) + 1) AS w FROM tf JOIN df ON tf.t = df.t), "
        "nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM vec GROUP BY id)"
    )


_EDGES = (
    "edges AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)) AS score FROM vec a JOIN vec b ON a.t = b.t AND a.id < b.id "
    "JOIN nrm x ON a.id = x.id JOIN nrm y ON b.id = y.id GROUP BY a.id, b.id HAVING score >= 0.65)"
)
_REACH = (
    "near AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), "
    "reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x), "
    "mem AS (SELECT least(x, min(y)) AS component, x AS id FROM reach GROUP BY x)"
)
_WITH_EDGES = f"{_WITH_LEFT}, {_sql_vectors('surv')}, {_EDGES}"
_WITH_CLUSTERS = f"{_WITH_EDGES}, {_REACH}"


# --- exact duplicates -------------------------------------------------------------------------------------------------


@query(f"WITH {_sql_records()} SELECT id, sha256(raw) AS hash FROM rec")
def exact_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder).select("id", "hash")


@query(f"WITH {_sql_records()}, g AS (SELECT raw, min(id) AS rep, count(*) AS n FROM rec GROUP BY raw HAVING count(*) > 1) SELECT sha256(rec.raw) AS hash, id, rep, n FROM rec JOIN g ON rec.raw = g.raw")
def exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return E.duplicate_groups(_ids(spark, folder)).select("hash", "id", "rep", "n")


@query(f"WITH {_sql_records()} SELECT min(id) AS id, sha256(raw) AS hash FROM rec GROUP BY raw")
def exact_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return E.group_stats(_ids(spark, folder)).select(F.col("rep").alias("id"), "hash")


@query(f"WITH {_sql_records()} SELECT count(*) AS records, count(DISTINCT raw) AS contents, count(DISTINCT content) AS normalized_contents FROM norm")
def exact_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder, True).agg(F.count("*").alias("records"), F.countDistinct("hash", "raw").alias("contents"), F.countDistinct("hash").alias("normalized_contents"))


@query(f"WITH {_sql_records()}, g AS (SELECT content, min(id) AS rep, count(*) AS n, count(DISTINCT raw) > 1 AS m FROM norm GROUP BY content HAVING count(*) > 1) SELECT sha256(norm.content) AS hash, id, rep, n, m AS normalized_match FROM norm JOIN g ON norm.content = g.content")
def normalized_groups(spark: SparkSession, folder: str) -> DataFrame:
    return E.duplicate_groups(_ids(spark, folder, True)).select("hash", "id", "rep", "n", "normalized_match")


@query(f"WITH {_sql_records()} SELECT id, sha256(content) AS hash, content <> raw AS changed FROM norm")
def normalized_text(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder, True).select("id", X.content_hash(F.col("content")).alias("hash"), (F.col("content") != F.col("raw")).alias("changed"))


def _group_sql(source: str, key: str) -> str:
    return f"WITH t AS (SELECT CAST({key} AS VARCHAR) AS id, coalesce(text, '') AS c FROM {source} WHERE {key} IS NOT NULL), g AS (SELECT c, min(id) AS rep, count(*) AS n FROM t GROUP BY c HAVING count(*) > 1) SELECT sha256(t.c) AS hash, id, rep, n FROM t JOIN g ON t.c = g.c"


@query(_group_sql("documents", "doc_id"))
def exact_groups_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.identified(as_records(table(spark, folder, "documents"), "doc_id", "text"))
    return E.duplicate_groups(rows).select("hash", "id", "rep", "n")


@query(_group_sql("benchmark", "item_id"))
def exact_groups_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.identified(as_records(table(spark, folder, "benchmark"), "item_id", "text"))
    return E.duplicate_groups(rows).select("hash", "id", "rep", "n")


# --- containment ------------------------------------------------------------------------------------------------------


@query(f"WITH {_sql_records()}, {_sql_lines('norm')} SELECT id, len(l) AS n_lines, nb AS n_nonblank FROM ls")
def line_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.with_lines(_records(spark, folder, True))
    return rows.select("id", F.size("ls").cast("long").alias("n_lines"), F.col("nb").cast("long").alias("n_nonblank"))


@query(f"{_WITH_PAIRS} SELECT subset, superset, len(full_) - len(sub) AS extra_lines FROM pairs")
def containment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return C.containment_pairs(_unique(spark, folder)).select("subset", "superset", F.size("extra").cast("long").alias("extra_lines"))


_DOC_PAIRS = f"WITH {_sql_records('docs', 'text')}, {_sql_lines('uniq')}, {_sql_pairs()}"


@query(f"{_DOC_PAIRS} SELECT subset, superset, len(full_) - len(sub) AS extra_lines FROM pairs")
def containment_pairs_docs(spark: SparkSession, folder: str) -> DataFrame:
    return C.containment_pairs(_unique(spark, folder, _docs_source)).select("subset", "superset", F.size("extra").cast("long").alias("extra_lines"))


@query(f"WITH {_sql_records()}, {_sql_lines('uniq')}, {_sql_pairs('a.nb > 0 AND ')} SELECT subset, superset FROM pairs")
def containment_guards_off(spark: SparkSession, folder: str) -> DataFrame:
    return C.containment_pairs(_unique(spark, folder), 0, float("inf")).select("subset", "superset")


_IN = "list_reduce({1}, lambda i, v: CASE WHEN {0}[i + 1] = v THEN i + 1 ELSE i END, 0) = len({0})"
_STEP = (
    "{'i': CASE WHEN s.i < len(sub) AND sub[s.i + 1] = v.out[1].text THEN s.i + 1 ELSE s.i END, 'at': s.at + 1, "
    "'out': CASE WHEN s.i < len(sub) AND sub[s.i + 1] = v.out[1].text THEN s.out ELSE list_append(s.out, {'line': s.at, 'text': v.out[1].text}) END}"
)


@query(
    f"{_WITH_PAIRS}, folded AS (SELECT subset, superset, list_reduce(list_transform(full_, lambda x: {{'i': 0, 'at': 0, 'out': [{{'line': 0, 'text': x}}]}}), lambda s, v: {_STEP}, "
    "{'i': 0, 'at': 0, 'out': list_filter([{'line': 0, 'text': ''}], lambda x: false)}) AS r FROM pairs) "
    "SELECT subset, superset, CAST(e.line AS INTEGER) AS line, e.text AS text FROM (SELECT subset, superset, unnest(r.out) AS e FROM folded)"
)
def containment_extra_lines(spark: SparkSession, folder: str) -> DataFrame:
    return C.containment_pairs(_unique(spark, folder)).select("subset", "superset", F.explode("extra").alias("e")).select("subset", "superset", "e.line", "e.text")


@query(
    f"{_WITH_PAIRS}, up AS (SELECT superset AS start, superset AS x FROM pairs UNION SELECT u.start, p.superset FROM up u JOIN pairs p ON u.x = p.subset) "
    "SELECT DISTINCT p.subset, p.superset, u.x AS final_superset FROM pairs p JOIN up u ON u.start = p.superset WHERE u.x NOT IN (SELECT subset FROM pairs)"
)
def containment_final_supersets(spark: SparkSession, folder: str) -> DataFrame:
    return C.final_supersets(C.containment_pairs(_unique(spark, folder)))


@query(f"{_WITH_LEFT} SELECT id FROM surv")
def containment_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return _left(spark, folder).select("id")


_CLAIMED = (
    f"WITH {_sql_records()}, cl AS (SELECT DISTINCT subset AS i, superset AS j FROM containment_pairs WHERE subset IS NOT NULL AND superset IS NOT NULL), "
    f"k AS (SELECT i, j, a.raw AS p, b.raw AS q, string_split(a.raw, {_LF}) AS x, string_split(b.raw, {_LF}) AS y FROM cl JOIN rec a ON i = a.id JOIN rec b ON j = b.id), "
    "m AS (SELECT *, len(list_filter(x, lambda v: v <> '')) AS nx, len(list_filter(y, lambda v: v <> '')) AS ny FROM k)"
)


def _class_sql(least: int, ratio: str) -> str:
    fits = f"{{0}} <= {{1}} AND {{0}} >= {least} AND {ratio}"
    return (
        f"{_CLAIMED} SELECT i, j, CASE WHEN p = q THEN 'identical' WHEN {fits.format('nx', 'ny')} AND {_IN.format('x', 'y')} THEN 'a_subset_of_b' "
        f"WHEN {fits.format('ny', 'nx')} AND {_IN.format('y', 'x')} THEN 'b_subset_of_a' ELSE 'neither' END AS cls FROM m"
    )


def _claimed_texts(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder).select("id", "content")
    pairs = table(spark, folder, "containment_pairs").select(F.col("subset").alias("i"), F.col("superset").alias("j")).dropna().distinct()
    return pairs.join(records.select(F.col("id").alias("i"), F.col("content").alias("p")), "i").join(records.select(F.col("id").alias("j"), F.col("content").alias("q")), "j")


@query(_class_sql(5, "{1} <= {0} * 20"))
def pair_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every reported pair of known records, classified anew with the guards of the pipeline."""
    return _claimed_texts(spark, folder).select("i", "j", C.classified(F.col("p"), F.col("q"), C.MIN_LINES, C.MAX_RATIO).alias("cls"))


# --- similarity -------------------------------------------------------------------------------------------------------


@query(f"{_WITH_LEFT}, {_sql_vectors('surv')} SELECT t AS term, df FROM df")
def token_df(spark: SparkSession, folder: str) -> DataFrame:
    return S.Embedder(_left(spark, folder)).df


@query(f"{_WITH_LEFT}, {_sql_vectors('surv')} SELECT id, t AS term, round(w, 9) AS w FROM vec")
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    left = _left(spark, folder)
    return S.Embedder(left).transform(left).select("id", "term", F.round("w", 9).alias("w"))


@query(f"{_WITH_LEFT}, {_sql_vectors('surv')} SELECT id, round(norm, 8) AS norm FROM nrm")
def tfidf_norms(spark: SparkSession, folder: str) -> DataFrame:
    left = _left(spark, folder)
    return S.norms(S.Embedder(left).transform(left)).select("id", F.round("norm", 8).alias("norm"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return T.text_edges(_left(spark, folder))


@query(f"{_WITH_EDGES} SELECT a, b, round(score, 4) AS score FROM edges")
def cosine_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).select("a", "b", F.round("score", 4).alias("score"))


@query(f"{_WITH_EDGES} SELECT a, b, round(score, 4) AS score FROM edges ORDER BY round(score, 4) DESC, a, b LIMIT 20")
def cosine_top20(spark: SparkSession, folder: str) -> DataFrame:
    return S.top_pairs(_edges(spark, folder))


@query(f"{_WITH_CLUSTERS} SELECT component, id FROM mem")
def similarity_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return S.clusters(_edges(spark, folder))


@query(f"{_WITH_CLUSTERS}, sz AS (SELECT component, count(*) AS n FROM mem GROUP BY component) SELECT mem.component, any_value(n) AS size, count(*) AS links, round(min(score), 4) AS weakest, round(count(*) * 2.0 / (any_value(n) * (any_value(n) - 1)), 6) AS density FROM edges JOIN mem ON edges.a = mem.id JOIN sz ON mem.component = sz.component GROUP BY mem.component")
def cluster_quality(spark: SparkSession, folder: str) -> DataFrame:
    edges = materialise(_edges(spark, folder))
    found = S.cluster_quality(S.clusters(edges), edges)
    return found.select("component", "size", "links", F.round("weakest", 4).alias("weakest"), F.round("density", 6).alias("density"))


@query(f"{_WITH_CLUSTERS} SELECT component, a, b, round(score, 4) AS score FROM edges JOIN mem ON a = id")
def cluster_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    edges = materialise(_edges(spark, folder))
    return edges.join(S.clusters(edges).withColumnRenamed("id", "a"), "a").select("component", "a", "b", F.round("score", 4).alias("score"))


@query(
    f"{_WITH_CLUSTERS}, dot AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM vec x JOIN vec y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id) "
    "SELECT p.component, p.id AS a, q.id AS b, round(coalesce(dot / (x.norm * y.norm), 0), 4) AS score FROM mem p JOIN mem q ON p.component = q.component AND p.id < q.id JOIN nrm x ON p.id = x.id JOIN nrm y ON q.id = y.id LEFT JOIN dot ON dot.a = p.id AND dot.b = q.id"
)
def cluster_member_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of each cluster's members, whether linked or not."""
    left = _left(spark, folder)
    known = T.weighed(left)
    found = T.member_scores(left, materialise(S.clusters(T.text_edges(left, known=known))), known=known)
    return found.select("component", "a", "b", F.round("score", 4).alias("score"))


@query(
    f"{_WITH_CLUSTERS}, n AS (SELECT (SELECT count(*) FROM norm) AS n, (SELECT count(*) FROM uniq) AS u, (SELECT count(*) FROM surv) AS s, (SELECT count(*) FROM mem) AS m, (SELECT count(DISTINCT component) FROM mem) AS c) "
    "SELECT 'load' AS stage, 0::BIGINT AS records_in, n AS records_out, 0::BIGINT AS comparisons FROM n UNION ALL SELECT 'exact_hash', n, u, 0 FROM n "
    "UNION ALL SELECT 'containment', u, s, u * (u - 1) // 2 FROM n UNION ALL SELECT 'similarity_cluster', s, s - m + c, s * (s - 1) // 2 FROM n"
)
def pipeline_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """The funnel with 0 for what a stage doesn't have."""
    return P.funnel(P.run_files(table(spark, folder, "records").select("id", "content"), normalize=True)).fillna(0)


# --- branches: a family of docs is a file, its docs are branches, its base doc is the common ancestor -------------------

_ENTRIES_SQL = (
    "ent AS (SELECT regexp_extract(id, '^([a-z]+[0-9]+)-', 1) AS path, id AS branch, CASE WHEN any_value(text) IS NULL THEN 'deleted' ELSE 'modified' END AS status, "
    "CASE WHEN any_value(render) = 'plain' THEN sha1(any_value(text)) END AS blob, any_value(text) AS content FROM docs WHERE id IS NOT NULL GROUP BY id)"
)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "docs").where("id is not null").groupBy("id").agg(F.max("text").alias("content"), F.max("render").alias("render"))
    return rows.select(
        F.regexp_extract("id", "^([a-z]+[0-9]+)-", 1).alias("path"), F.col("id").alias("branch"), F.when(F.col("content").isNull(), "deleted").otherwise("modified").alias("status"),
        F.when((F.col("render") == "plain") & F.col("content").isNotNull(), F.sha1("content")).alias("blob"), "content", F.lit(0).alias("seq"),
    )


def _bases(entries: DataFrame) -> DataFrame:
    base = entries.where("branch like '%-base%'").groupBy("path").agg(F.min("content").alias("base_content"))
    return G.entry_pairs(entries).select("path", "a", "b").join(base, "path")


def _pair_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    return G.pair_verdicts(entries, _bases(entries))


@query(f"WITH {_ENTRIES_SQL} SELECT path, count(*) AS branches FROM ent GROUP BY path HAVING count(*) > 1")
def branch_contended(spark: SparkSession, folder: str) -> DataFrame:
    return G.contended(_entries(spark, folder))


_SUB = "list_reduce({1}, lambda i, v: CASE WHEN {0}[i + 1] = v THEN i + 1 ELSE i END, 0) = len({0})"
_BRANCH_SQL = (
    f"WITH {_ENTRIES_SQL}, l AS (SELECT *, string_split(content, {_LF}) AS l, len(list_filter(string_split(content, {_LF}), lambda x: x <> '')) AS nb FROM ent WHERE status <> 'deleted'), "
    f"pv AS (SELECT x.path, x.branch AS a, y.branch AS b, CASE WHEN x.blob = y.blob OR x.content = y.content THEN 'identical' WHEN x.nb > 0 AND x.nb <= y.nb AND {_SUB.format('x.l', 'y.l')} THEN 'a_subset_of_b' "
    f"WHEN y.nb > 0 AND y.nb <= x.nb AND {_SUB.format('y.l', 'x.l')} THEN 'b_subset_of_a' ELSE 'divergent' END AS verdict, CASE WHEN x.blob = y.blob THEN 'blob' WHEN x.content = y.content THEN 'content' END AS via FROM l x JOIN l y ON x.path = y.path AND x.branch < y.branch)"
)


@query(f"{_BRANCH_SQL} SELECT path, a, b, verdict, via FROM pv")
def branch_pair_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Pair verdicts as far as SQL can tell: what merging would settle is divergent."""
    v = F.when(F.col("verdict").isin("auto_mergeable", "conflict"), "divergent").otherwise(F.col("verdict"))
    return _pair_verdicts(spark, folder).select("path", "a", "b", v.alias("verdict"), "via")


@query()
def branch_pair_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_verdicts(spark, folder)


@query(
    f"{_BRANCH_SQL}, e AS (SELECT path, count(*) AS branches, count(*) FILTER (status <> 'deleted') AS live FROM ent GROUP BY path HAVING count(*) > 1), p AS (SELECT path, bool_and(verdict <> 'divergent') AS same FROM pv GROUP BY path) "
    "SELECT e.path, branches, live, live < 2 OR coalesce(same, false) AS redundant FROM e LEFT JOIN p ON e.path = p.path"
)
def branch_file_redundant(spark: SparkSession, folder: str) -> DataFrame:
    files = G.file_verdicts(_entries(spark, folder), _pair_verdicts(spark, folder))
    return files.select("path", "branches", "live", (F.col("verdict") == "redundant").alias("redundant"))


@query()
def branch_file_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return G.file_verdicts(_entries(spark, folder), _pair_verdicts(spark, folder))


@query()
def branch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return G.summary(branch_file_verdicts(spark, folder))


@query()
def merge3_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a family's docs merged with the base doc as the ancestor."""
    entries = _entries(spark, folder)
    triples = G.entry_pairs(entries).join(_bases(entries), ["path", "a", "b"]).select("path", "a", "b", "base_content", "a_content", "b_content")
    return M.merge_table(triples, ["path", "a", "b"]).select("path", "a", "b", "clean", F.sha2("merged", 256).alias("merged_hash"))


@query(
    f"WITH {_ENTRIES_SQL}, base AS (SELECT path, min(content) AS o FROM ent WHERE branch LIKE '%-base%' GROUP BY path), live AS (SELECT * FROM ent WHERE status <> 'deleted') "
    "SELECT x.path, x.branch AS a, y.branch AS b, true AS clean, sha256(CASE WHEN x.content = o THEN y.content ELSE x.content END) AS merged_hash FROM live x JOIN live y ON x.path = y.path AND x.branch < y.branch JOIN base ON x.path = base.path WHERE x.content = o OR y.content = o OR x.content = y.content"
)
def merge3_one_sided(spark: SparkSession, folder: str) -> DataFrame:
    """The merges of which only one side changed anything, or both changed it alike."""
    entries = _entries(spark, folder)
    triples = G.entry_pairs(entries).join(_bases(entries), ["path", "a", "b"]).select("path", "a", "b", "base_content", "a_content", "b_content")
    kept = triples.where("a_content = base_content or b_content = base_content or a_content = b_content")
    return M.merge_table(kept, ["path", "a", "b"]).select("path", "a", "b", "clean", F.sha2("merged", 256).alias("merged_hash"))


# --- units, blocks, truth ---------------------------------------------------------------------------------------------


def _sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACES}+', ' ', 'g'), ' ')"


def _sql_units(pieces: str) -> str:
    return f"list_filter(list_transform({pieces}, lambda x: {_sql_clean('x')}), lambda x: x <> '')"


_U = _UNIFIED.format("content")
_PARAGRAPHS = _sql_units(f"regexp_split_to_array({_U}, '\\n[ \\t]*\\n')")
_LINES = _sql_units(f"string_split({_U}, {_LF})")
_SENTENCES = f"list_filter(string_split(regexp_replace({_sql_clean(_U)}, '([.!?]){_SPACES}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_DOC = "d AS (SELECT id, min(text) AS content FROM docs WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)"
_SEG = f"{_DOC}, seg0 AS (SELECT id, {_PARAGRAPHS} AS paragraph, {_LINES} AS by_line, {_SENTENCES} AS sentence FROM d), seg AS (SELECT id, paragraph, CASE WHEN len(paragraph) > 1 THEN paragraph WHEN len(by_line) > 1 THEN by_line ELSE paragraph END AS line_fallback, sentence FROM seg0)"


def _segment_sql(name: str) -> str:
    return f"WITH {_SEG} SELECT id, CAST(i AS INTEGER) AS pos, sha256({name}[i + 1]) AS unit FROM (SELECT id, {name}, unnest(range(len({name}))) AS i FROM seg)"


def _segments(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        units = _texts(spark, folder).select("id", F.posexplode(X.STRATEGIES[name](F.col("text"))).alias("pos", "u"))
        return units.select("id", "pos", F.sha2("u", 256).alias("unit"))

    run.__name__ = f"segments_{name}"
    return run


for _name in X.STRATEGIES:
    query(_segment_sql(_name))(_segments(_name))


_JACCARD = "(SELECT len(list_intersect(p, q)) * 1.0 / (len(p) + len(q) - len(list_intersect(p, q))) FROM (SELECT list_distinct(regexp_split_to_array(lower({0}), '[^A-Za-z0-9_]+')) AS p, list_distinct(regexp_split_to_array(lower({1}), '[^A-Za-z0-9_]+')) AS q))"


def _sql_classified(name: str, source: str, min_words: int, out: str) -> str:
    """CTEs ending in ``out``: a, b, v, subset, type, shared of the candidate pairs ``source``."""
    overlap = "list_sum(list_transform(list_intersect(x, y), lambda u: least(len(list_filter(x, lambda z: z = u)), len(list_filter(y, lambda z: z = u)))))"
    tiny = f"(len(CASE WHEN ab THEN x ELSE y END) < 3 OR len(string_split(array_to_string(CASE WHEN ab THEN x ELSE y END, ' '), ' ')) < {min_words})"
    j = f"{out}_"
    return (
        f"{j}p AS (SELECT c.a, c.b, p.{name} AS x, q.{name} AS y, len(p.{name}) < len(q.{name}) AND {_SUB.format(f'p.{name}', f'q.{name}')} AS ab, len(q.{name}) < len(p.{name}) AND {_SUB.format(f'q.{name}', f'p.{name}')} AS ba FROM {source} c JOIN seg p ON c.a = p.id JOIN seg q ON c.b = q.id), "
        f"{j}s AS (SELECT *, coalesce({overlap}, 0) * 1.0 / nullif(least(len(x), len(y)), 0) AS part, list_filter(x, lambda u: NOT list_contains(y, u)) AS ox, list_filter(y, lambda u: NOT list_contains(x, u)) AS oy FROM {j}p), "
        f"{j}near AS (SELECT DISTINCT a, b FROM (SELECT a, b, list_distinct(regexp_split_to_array(lower(u), '[^A-Za-z0-9_]+')) AS p, list_distinct(regexp_split_to_array(lower(w), '[^A-Za-z0-9_]+')) AS q FROM (SELECT a, b, u, unnest(oy) AS w FROM (SELECT a, b, unnest(ox) AS u, oy FROM {j}s WHERE part >= 0.3))) WHERE len(list_intersect(p, q)) >= 0.8 * (len(p) + len(q) - len(list_intersect(p, q))) - 1e-9), "
        f"{j}k AS (SELECT s.*, n.a IS NOT NULL AS contested, CASE WHEN x = y THEN 'same' WHEN (ab OR ba) AND {tiny} THEN 'tiny' WHEN ab THEN 'ab' WHEN ba THEN 'ba' WHEN list_sort(x) = list_sort(y) THEN 'reorder' WHEN coalesce(part, 0) < 0.3 THEN 'apart' ELSE 'near' END AS k FROM {j}s s LEFT JOIN {j}near n ON s.a = n.a AND s.b = n.b), "
        f"{out} AS (SELECT a, b, CASE WHEN k IN ('same', 'ab', 'ba') THEN 'collapse' WHEN k IN ('tiny', 'apart') THEN 'separate' ELSE 'review' END AS v, CASE k WHEN 'ab' THEN a WHEN 'ba' THEN b END AS subset, CASE WHEN k = 'reorder' THEN k WHEN k = 'near' AND contested THEN 'conflict' WHEN k = 'near' THEN 'additive' END AS type, CASE WHEN k = 'reorder' THEN 1.0 WHEN k = 'near' THEN part END AS shared FROM {j}k)"
    )


_CAND_P = "cp AS (SELECT DISTINCT p.id AS a, q.id AS b FROM (SELECT DISTINCT id, unnest(paragraph) AS u FROM seg) p JOIN (SELECT DISTINCT id, unnest(paragraph) AS u FROM seg) q ON p.u = q.u AND p.id < q.id)"
_ALL_U = "(SELECT DISTINCT id, unnest(list_concat(list_concat(paragraph, line_fallback), sentence)) AS u FROM seg)"
_CAND_ALL = f"ca AS (SELECT DISTINCT p.id AS a, q.id AS b FROM {_ALL_U} p JOIN {_ALL_U} q ON p.u = q.u AND p.id < q.id)"
_BLOCKS_SQL = f"WITH {_SEG}, {_CAND_P}, {_sql_classified('paragraph', 'cp', 0, 'bv')}"
_MULTI_SQL = (
    f"WITH {_SEG}, {_CAND_ALL}, {_sql_classified('paragraph', 'ca', 60, 'v1')}, {_sql_classified('line_fallback', 'ca', 60, 'v2')}, {_sql_classified('sentence', 'ca', 60, 'v3')}, "
    "vs AS (SELECT 1 AS o, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3), "
    "mv0 AS (SELECT a, b, count(*) FILTER (v = 'collapse') AS n, count(DISTINCT subset) FILTER (v = 'collapse') AS ways, min(subset) FILTER (v = 'collapse') AS one, count(*) FILTER (v = 'review') AS m, arg_max(type, shared * 1e6 - o * 1e-3) FILTER (v = 'review') AS type FROM vs GROUP BY a, b), "
    "mv AS (SELECT a, b, CASE WHEN n > 0 AND ways < 2 THEN 'collapse' ELSE 'review' END AS v, CASE WHEN n > 0 AND ways = 1 THEN one END AS subset, CASE WHEN n = 0 THEN type END AS type FROM mv0 WHERE n > 0 OR m >= 2)"
)


@query(
    f"WITH {_SEG}, u AS (SELECT id, u, count(*) AS n FROM (SELECT id, unnest(sentence) AS u FROM seg) GROUP BY id, u), k AS (SELECT id, len(sentence) AS k FROM seg), "
    "o AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS o FROM u x JOIN u y ON x.u = y.u AND x.id < y.id GROUP BY x.id, y.id) "
    "SELECT a, b, round(CAST(o / least(p.k, q.k) AS DOUBLE), 6) AS shared FROM o JOIN k p ON a = p.id JOIN k q ON b = q.id WHERE o / least(p.k, q.k) >= 0.3"
)
def block_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return B.related(_texts(spark, folder)).select("a", "b", F.round("shared", 6).alias("shared"))


@query(f"{_BLOCKS_SQL} SELECT a, b, v, subset, type, round(CAST(shared AS DOUBLE), 6) AS shared FROM bv WHERE v <> 'separate'")
def block_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return B.block_verdicts(_texts(spark, folder)).withColumn("shared", F.round("shared", 6))


@query(f"{_MULTI_SQL} SELECT a, b, v, subset, type FROM mv")
def multi_segment_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return B.multi_verdicts(_texts(spark, folder))


_SHINGLES = (
    f"WITH {_DOC}, w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM d), "
    "sh AS (SELECT id, s, count(*) AS n FROM (SELECT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)) GROUP BY id, s), tot AS (SELECT id, sum(n) AS t FROM sh GROUP BY id), "
    "x AS (SELECT p.id AS a, q.id AS b, sum(least(p.n, q.n)) AS x FROM sh p JOIN sh q ON p.s = q.s AND p.id < q.id GROUP BY p.id, q.id), "
    "sc AS (SELECT a, b, x / ta.t AS c_ab, x / tb.t AS c_ba, x / (ta.t + tb.t - x) AS jaccard FROM x JOIN tot ta ON a = ta.id JOIN tot tb ON b = tb.id WHERE x >= 0.3 * least(ta.t, tb.t))"
)


@query(f"{_SHINGLES} SELECT a, b, round(c_ab, 6) AS c_ab, round(c_ba, 6) AS c_ba, round(jaccard, 6) AS jaccard FROM sc")
def shingle_containment(spark: SparkSession, folder: str) -> DataFrame:
    return B.shingle_containment(_texts(spark, folder)).select("a", "b", *(F.round(c, 6).alias(c) for c in ("c_ab", "c_ba", "jaccard")))


@query(f"{_SHINGLES} SELECT a, b, CASE WHEN c_ab >= 0.95 OR c_ba >= 0.95 THEN 'collapse' WHEN jaccard >= 0.5 THEN 'review' ELSE 'separate' END AS v, CASE WHEN c_ab >= 0.95 AND c_ba >= 0.95 THEN NULL WHEN c_ab >= 0.95 THEN a WHEN c_ba >= 0.95 THEN b END AS subset FROM sc")
def shingle_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return B.shingle_verdicts(B.shingle_containment(_texts(spark, folder))).select("a", "b", "v", "subset")


_TRUTH = (
    "da AS (SELECT id, list_filter(min(atoms), lambda x: x IS NOT NULL) AS ats FROM docs WHERE id IS NOT NULL AND atoms IS NOT NULL GROUP BY id), "
    "ka AS (SELECT id, min(root) AS root, max(boiler) AS boiler FROM atoms WHERE id IS NOT NULL GROUP BY id), "
    "ea AS (SELECT d.id, d.i, d.atom, coalesce(ka.root, d.atom) AS root, coalesce(boiler, false) AS boiler FROM (SELECT id, unnest(ats) AS atom, generate_subscripts(ats, 1) AS i FROM da) d LEFT JOIN ka ON d.atom = ka.id), "
    "rs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT DISTINCT id, atom FROM ea WHERE NOT boiler) x JOIN (SELECT DISTINCT id, atom FROM ea WHERE NOT boiler) y ON x.atom = y.atom AND x.id < y.id), "
    "pt AS (SELECT a, b FROM rs<also>), "
    "ct AS (SELECT DISTINCT pt.a, pt.b FROM pt JOIN da p ON pt.a = p.id JOIN da q ON pt.b = q.id JOIN ea x ON x.id = pt.a JOIN ea y ON y.id = pt.b AND x.root = y.root WHERE NOT list_contains(q.ats, x.atom) AND NOT list_contains(p.ats, y.atom)), "
    f"tk AS (SELECT pt.a, pt.b, p.ats AS x, q.ats AS y, len(p.ats) < len(q.ats) AND {_SUB.format('p.ats', 'q.ats')} AS ab, len(q.ats) < len(p.ats) AND {_SUB.format('q.ats', 'p.ats')} AS ba, rs.a IS NOT NULL AS real_, ct.a IS NOT NULL AS contested FROM pt JOIN da p ON pt.a = p.id JOIN da q ON pt.b = q.id LEFT JOIN rs ON rs.a = pt.a AND rs.b = pt.b LEFT JOIN ct ON ct.a = pt.a AND ct.b = pt.b), "
    "truth AS (SELECT a, b, CASE WHEN x = y THEN 'identical' WHEN (ab OR ba) AND least(len(x), len(y)) < 5 THEN 'trivial' WHEN ab OR ba THEN 'subset' WHEN list_sort(x) = list_sort(y) THEN 'reorder' WHEN NOT real_ THEN 'unrelated' WHEN contested THEN 'conflict' ELSE 'additive' END AS cls, "
    "CASE WHEN x <> y AND (ab OR ba) AND least(len(x), len(y)) >= 5 THEN CASE WHEN ab THEN a ELSE b END END AS subset FROM tk)"
)


_TRUTH_SHARED, _TRUTH_JUDGED = _TRUTH.replace("<also>", ""), _TRUTH.replace("<also>", " UNION SELECT a, b FROM mv WHERE a IN (SELECT id FROM da) AND b IN (SELECT id FROM da)")


def _truth(spark: SparkSession, folder: str, also: DataFrame | None = None) -> DataFrame:
    return B.truth(table(spark, folder, "docs").select("id", "atoms"), table(spark, folder, "atoms"), also)


@query(f"WITH {_TRUTH_SHARED} SELECT a, b, cls, subset FROM truth")
def truth_classes(spark: SparkSession, folder: str) -> DataFrame:
    return _truth(spark, folder)


_SCORED = "scored AS (SELECT truth.a, truth.b, cls, coalesce(mv.v, 'separate') AS v, CASE cls WHEN 'identical' THEN true WHEN 'subset' THEN coalesce(mv.subset = truth.subset, false) ELSE false END AS safe, type IS NOT NULL AS typed, coalesce(type = cls, false) AS right_ FROM truth LEFT JOIN mv ON truth.a = mv.a AND truth.b = mv.b)"
_COUNTS = (
    "count(*) FILTER (v = 'collapse' AND NOT safe) AS unsafe_merges, count(*) FILTER (cls IN ('identical', 'subset')) AS collapse_required, count(*) FILTER (cls IN ('identical', 'subset') AND v = 'collapse' AND safe) AS collapsed_safely, "
    "count(*) FILTER (cls IN ('reorder', 'additive', 'conflict')) AS needs_review, count(*) FILTER (cls IN ('reorder', 'additive', 'conflict') AND v = 'review') AS surfaced, count(*) FILTER (cls IN ('reorder', 'additive', 'conflict') AND v = 'collapse') AS hidden_by_collapse, count(*) FILTER (cls IN ('unrelated', 'trivial') AND v = 'review') AS false_review, "
    "count(*) FILTER (v = 'review') AS review_band, count(*) FILTER (cls IN ('reorder', 'additive', 'conflict') AND v = 'review' AND typed) AS typed_count, count(*) FILTER (cls IN ('reorder', 'additive', 'conflict') AND v = 'review' AND right_) AS typed_correct"
)


def _score_sql(verdicts: str) -> str:
    """Counts of the verdicts ``mv`` that the CTEs end in."""
    return f"{verdicts}, {_TRUTH_JUDGED}, {_SCORED} SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM da) AS pairs, {_COUNTS} FROM scored"


def _score(spark: SparkSession, folder: str, verdicts: DataFrame) -> DataFrame:
    return B.score(_truth(spark, folder, verdicts), verdicts, table(spark, folder, "docs").select("id", "atoms"))


@query(_score_sql(_MULTI_SQL))
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _score(spark, folder, materialise(B.multi_verdicts(_texts(spark, folder))))


@query(f"{_MULTI_SQL}, {_TRUTH_JUDGED}, {_SCORED} SELECT cls, count(*) FILTER (v = 'collapse') AS collapse, count(*) FILTER (v = 'review') AS review, count(*) FILTER (v = 'separate') AS separate FROM scored GROUP BY cls")
def score_matrix(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = materialise(B.multi_verdicts(_texts(spark, folder)))
    return B.score_matrix(_truth(spark, folder, verdicts), verdicts)


def _family(c: str) -> str:
    return f"regexp_extract({c}, '^([a-z]+[0-9]+)-', 1)"


_FAMILY_SQL = f"{_MULTI_SQL}, {_TRUTH_JUDGED}, {_SCORED}, fam AS (SELECT {_family('a')} AS family, count(*) AS pairs, {_COUNTS} FROM scored WHERE {_family('a')} = {_family('b')} GROUP BY 1)"
_SUMS = "pairs unsafe_merges collapse_required collapsed_safely needs_review surfaced hidden_by_collapse false_review review_band typed_count typed_correct".split()


@query(f"{_FAMILY_SQL} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)} FROM fam")
def score_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of each family of docs apart, merged: as if each were a run of its own."""
    verdicts = materialise(B.multi_verdicts(_texts(spark, folder)))
    truths = materialise(_truth(spark, folder, verdicts))
    family = lambda c: F.regexp_extract(c, "^([a-z]+[0-9]+)-", 1)
    same = truths.where(family("a") == family("b"))
    return B.merged(B.score(same, verdicts))


def _pipeline_sql(normalized: bool) -> str:
    """CTEs ending in ``mv``: the pipeline over docs as verdicts on pairs."""
    records = _sql_records("docs", "text")
    if not normalized:
        records = f"{records.split(', norm AS')[0]}, norm AS (SELECT id, raw, raw AS content FROM rec), uniq AS (SELECT min(id) AS id, content FROM norm GROUP BY content)"
    return (
        f"WITH RECURSIVE {records}, {_sql_lines('uniq')}, {_sql_pairs()}, surv AS (SELECT id, content FROM uniq WHERE id NOT IN (SELECT subset FROM pairs)), {_sql_vectors('surv')}, {_EDGES}, {_REACH}, "
        "cls AS (SELECT n.id, u.id AS rep FROM norm n JOIN uniq u ON n.content = u.content), "
        "v0 AS (SELECT x.id AS x, y.id AS y, 'collapse' AS v, NULL AS subset, 1 AS o FROM cls x JOIN cls y ON x.rep = y.rep AND x.id < y.id "
        "UNION ALL SELECT x.id, y.id, 'collapse', x.id, 2 FROM pairs p JOIN cls x ON x.rep = p.subset JOIN cls y ON y.rep = p.superset "
        "UNION ALL SELECT x.id, y.id, 'review', NULL, 3 FROM mem p JOIN mem q ON p.component = q.component AND p.id < q.id JOIN cls x ON x.rep = p.id JOIN cls y ON y.rep = q.id), "
        "mv AS (SELECT least(x, y) AS a, greatest(x, y) AS b, v, subset, CAST(NULL AS VARCHAR) AS type FROM v0 QUALIFY row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY o) = 1)"
    )


def _shipped(spark: SparkSession, folder: str, normalized: bool) -> DataFrame:
    return P.pair_verdicts(P.run_files(_docs_source(spark, folder), normalized))


@query(f"{_pipeline_sql(False)} SELECT a, b, v, subset FROM mv")
def pipeline_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The files pipeline over docs as verdicts on pairs, copies standing in for their representatives."""
    return _shipped(spark, folder, False).select("a", "b", "v", "subset")


@query(f"{_pipeline_sql(True)} SELECT a, b, v, subset FROM mv")
def pipeline_verdicts_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return _shipped(spark, folder, True).select("a", "b", "v", "subset")


def _block_sql(name: str) -> str:
    own = f"cc AS (SELECT DISTINCT p.id AS a, q.id AS b FROM (SELECT DISTINCT id, unnest({name}) AS u FROM seg) p JOIN (SELECT DISTINCT id, unnest({name}) AS u FROM seg) q ON p.u = q.u AND p.id < q.id)"
    return f"WITH {_SEG}, {own}, {_sql_classified(name, 'cc', 60, 'bv')}, mv AS (SELECT a, b, v, subset, type FROM bv WHERE v <> 'separate')"


_SHINGLE_SQL = (
    f"{_SHINGLES}, mv AS (SELECT a, b, CASE WHEN c_ab >= 0.95 OR c_ba >= 0.95 THEN 'collapse' WHEN jaccard >= 0.5 THEN 'review' ELSE 'separate' END AS v, "
    "CASE WHEN c_ab >= 0.95 AND c_ba >= 0.95 THEN NULL WHEN c_ab >= 0.95 THEN a WHEN c_ba >= 0.95 THEN b END AS subset, CAST(NULL AS VARCHAR) AS type FROM sc)"
)
_TOOL_SQL = {
    "shipped": _pipeline_sql(False), "shipped_normalized": _pipeline_sql(True), "similarity_decides": _SHINGLE_SQL,
    **{f"block_{k}": _block_sql(k) for k in X.STRATEGIES}, "multi_segmentation": _MULTI_SQL,
}


def tools(records: DataFrame, texts: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Seven ways to judge pairs of documents, given as ``records`` (id, content) and ``texts`` (id, text), by name."""
    return {
        "shipped": lambda: P.pair_verdicts(P.run_files(records, False)),
        "shipped_normalized": lambda: P.pair_verdicts(P.run_files(records, True)),
        "similarity_decides": lambda: B.shingle_verdicts(B.shingle_containment(texts)),
        **{f"block_{k}": lambda k=k: B.block_verdicts(texts, k, 60).drop("shared") for k in X.STRATEGIES},
        "multi_segmentation": lambda: B.multi_verdicts(texts),
    }


@query(" UNION ALL ".join(f"SELECT '{name}' AS tool, * FROM ({_score_sql(sql)})" for name, sql in _TOOL_SQL.items()))
def tool_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Seven ways to judge pairs of docs, each scored against the truth that atoms give."""
    runs = tools(_docs_source(spark, folder), _texts(spark, folder))
    return reduce(DataFrame.union, [_score(spark, folder, materialise(run())).select(F.lit(name).alias("tool"), "*") for name, run in runs.items()])


# --- audit of the reported pairs, and of groups that are claimed of other contents -------------------------------------

_PATH = "regexp_replace(replace(regexp_replace({0}, '^[\\t-\\r \\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\t-\\r \\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g'), '\\', '/'), '^(\\./)+', '')"
_CLAIMS = (
    f"cl AS (SELECT DISTINCT {_PATH.format('subset')} AS subset, {_PATH.format('superset')} AS superset, coalesce(extra, []) AS extra, list_transform(coalesce(final_supersets, []), lambda f: {_PATH.format('f')}) AS fs FROM containment_pairs WHERE subset IS NOT NULL AND superset IS NOT NULL)"
)
_CLAIM_PAIRS = (
    f"WITH {_sql_records()}, {_CLAIMS}, k AS (SELECT cl.*, string_split(a.raw, {_LF}) AS x, string_split(b.raw, {_LF}) AS y FROM cl JOIN rec a ON cl.subset = a.id JOIN rec b ON cl.superset = b.id), "
    f"t AS (SELECT *, {_SUB.format('x', 'y')} AS ok FROM k)"
)


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "containment_pairs").where("subset is not null and superset is not null")
    path = lambda c: X.path_id(F.col(c)).alias(c)
    return rows.select(path("subset"), path("superset"), "extra", F.transform("final_supersets", X.path_id).alias("final_supersets")).distinct()


def _audited_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(A.audit_pairs(_claims(spark, folder), _records(spark, folder).select("id", "content")))


@query(f"{_CLAIM_PAIRS} SELECT DISTINCT 'containment_pair' AS type, subset AS a, superset AS b FROM t WHERE NOT ok")
def audit_containment(spark: SparkSession, folder: str) -> DataFrame:
    return _audited_pairs(spark, folder).where("type = 'containment_pair'")


@query(
    f"{_CLAIM_PAIRS} SELECT DISTINCT 'containment_extra_mismatch' AS type, subset AS a, superset AS b FROM t WHERE ok AND NOT (list_filter(y, lambda v, i: NOT list_contains(list_transform(extra, lambda e: e.line + 1), i - 1)) = x "
    "AND len(list_filter(extra, lambda e: coalesce(y[e.line + 2] = e.text AND e.line >= -1, false))) = len(extra))"
)
def audit_extra(spark: SparkSession, folder: str) -> DataFrame:
    """The reported pairs with each recorded line moved by one: those whose difference no longer adds up."""
    moved = F.transform("extra", lambda e: F.struct((e["line"] + 1).alias("line"), e["text"].alias("text")))
    claims = _claims(spark, folder).withColumn("extra", moved)
    return A.audit_pairs(claims, _records(spark, folder).select("id", "content")).where("type = 'containment_extra_mismatch'")


@query(
    f"{_CLAIM_PAIRS}, u AS (SELECT DISTINCT subset, x, (SELECT min(id) FROM rec) AS f FROM t WHERE ok) SELECT DISTINCT 'containment_final_superset' AS type, subset AS a, f AS b FROM (SELECT u.*, string_split(r.raw, {_LF}) AS z FROM u JOIN rec r ON u.f = r.id) WHERE NOT ({_SUB.format('x', 'z')})"
)
def audit_final_supersets(spark: SparkSession, folder: str) -> DataFrame:
    """The reported pairs with the smallest record as their only final superset: those that it doesn't contain."""
    records = _records(spark, folder).select("id", "content")
    first = records.agg(F.min("id")).first()[0]
    claims = _claims(spark, folder).withColumn("final_supersets", F.array(F.lit(first)))
    return A.audit_pairs(claims, records).where("type = 'containment_final_superset'")


@query(
    f"{_CLAIM_PAIRS} SELECT DISTINCT 'containment_extra_mismatch' AS type, subset AS a, superset AS b FROM t WHERE ok AND NOT (list_filter(y, lambda v, i: NOT list_contains(list_transform(extra, lambda e: e.line), i - 1)) = x "
    "AND len(list_filter(extra, lambda e: coalesce(y[e.line + 1] = e.text AND e.line >= 0, false))) = len(extra))"
)
def audit_extra_reported(spark: SparkSession, folder: str) -> DataFrame:
    """The reported pairs as they stand whose recorded difference doesn't add up."""
    return _audited_pairs(spark, folder).where("type = 'containment_extra_mismatch'")


@query(
    f"{_CLAIM_PAIRS}, u AS (SELECT DISTINCT subset, x, unnest(fs) AS f FROM t WHERE ok) SELECT DISTINCT 'containment_final_superset' AS type, subset AS a, f AS b FROM (SELECT u.*, string_split(r.raw, {_LF}) AS z FROM u JOIN rec r ON u.f = r.id) WHERE NOT ({_SUB.format('x', 'z')})"
)
def audit_final_supersets_reported(spark: SparkSession, folder: str) -> DataFrame:
    """The reported final supersets as they stand that don't contain their subset."""
    return _audited_pairs(spark, folder).where("type = 'containment_final_superset'")


@query(f"WITH {_sql_records()}, {_CLAIMS}, ids AS (SELECT subset AS id FROM cl UNION SELECT superset FROM cl UNION SELECT unnest(fs) FROM cl) SELECT 'missing_record' AS type, id AS a, id AS b FROM ids WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM rec)")
def audit_missing(spark: SparkSession, folder: str) -> DataFrame:
    return _audited_pairs(spark, folder).where("type = 'missing_record'")


def _normal_groups(spark: SparkSession, folder: str) -> DataFrame:
    return E.duplicate_groups(_ids(spark, folder, True)).select("hash", "id")


@query(f"WITH {_sql_records()}, g AS (SELECT content, min(id) AS id, min(raw) AS lo, max(raw) AS hi FROM norm GROUP BY content HAVING count(*) > 1) SELECT 'exact_duplicate_group' AS type, id AS a, sha256(content) AS b FROM g WHERE lo <> hi OR lo <> content")
def audit_tampered(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that are equal after normalisation, claimed of the raw contents: those that aren't fail."""
    return A.audit_groups(_normal_groups(spark, folder), _records(spark, folder).select("id", "content"))


@query(f"WITH {_sql_records()} SELECT sha256(content) AS hash, count(*) AS members, true AS holds FROM norm GROUP BY content HAVING count(*) > 1")
def audit_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The engine's own groups, each with whether it holds when audited with normalisation written anew."""
    again = _records(spark, folder).select("id", A.normalized_again(F.col("raw")).alias("content"))
    claims = materialise(_normal_groups(spark, folder))
    failed = A.audit_groups(claims, again).select(F.col("b").alias("hash")).distinct().withColumn("failed", F.lit(True))
    return claims.groupBy("hash").agg(F.count("*").alias("members")).join(failed, "hash", "left").select("hash", "members", F.col("failed").isNull().alias("holds"))


@query(" UNION ALL ".join(f"SELECT '{name}' AS query, type, count(*) AS failures FROM ({_SQL[name]}) GROUP BY type" for name in ("audit_containment", "audit_missing", "audit_tampered")))
def audit_failures(spark: SparkSession, folder: str) -> DataFrame:
    """How many failures of each type audits find, in the reported pairs and in tampered groups."""
    found = [_audited_pairs(spark, folder).where(f"type = '{t}'").select(F.lit(n).alias("query"), "type") for n, t in (("audit_containment", "containment_pair"), ("audit_missing", "missing_record"))]
    return reduce(DataFrame.union, [*found, audit_tampered(spark, folder).select(F.lit("audit_tampered"), "type")]).groupBy("query", "type").agg(F.count("*").alias("failures"))


@query(
    f"WITH {_sql_records()}, {_CLAIMS} SELECT (SELECT count(*) FROM (SELECT content FROM norm GROUP BY content HAVING count(*) > 1)) + (SELECT count(*) FROM cl) + (SELECT coalesce(sum(len(fs)), 0) FROM cl) + (SELECT count(*) FROM rec) AS claims"
)
def audit_claims(spark: SparkSession, folder: str) -> DataFrame:
    """How many claims an audit of the groups and the reported pairs re-derives."""
    n = A.claims_checked(_normal_groups(spark, folder), _claims(spark, folder), _records(spark, folder))
    return spark.range(1).select(F.lit(n).cast("long").alias("claims"))


@query(
    f"WITH {_sql_records()}, g AS (SELECT id, raw, content, CASE WHEN count(*) OVER (PARTITION BY raw) > 1 THEN raw END AS claimed FROM norm), bad AS (SELECT content FROM g GROUP BY content HAVING count(*) > 1 AND (count(claimed) < count(*) OR min(claimed) <> max(claimed))) "
    "SELECT 'missed_exact_duplicate' AS type, id AS a FROM g WHERE content IN (SELECT content FROM bad)"
)
def audit_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of raw contents, held against normalised ones: duplicates that the former miss."""
    claims = E.duplicate_groups(_ids(spark, folder)).select("hash", "id")
    again = _records(spark, folder).select("id", A.normalized_again(F.col("raw")).alias("content"))
    return A.audit_completeness(claims, again).select("type", "a")


# --- what follows a report --------------------------------------------------------------------------------------------


@query(
    f"{_WITH_PAIRS}, up AS (SELECT superset AS start, superset AS x FROM pairs UNION SELECT u.start, p.superset FROM up u JOIN pairs p ON u.x = p.subset), "
    "reps AS (SELECT norm.id, uniq.id AS rep FROM norm JOIN uniq ON norm.content = uniq.content) "
    "SELECT id, 'exact_duplicate' AS reason, rep AS keep FROM reps WHERE id <> rep UNION ALL "
    "SELECT p.subset, 'contained', min(u.x) FROM pairs p JOIN up u ON u.start = p.superset WHERE u.x NOT IN (SELECT subset FROM pairs) GROUP BY p.subset"
)
def action_plan(spark: SparkSession, folder: str) -> DataFrame:
    groups = E.duplicate_groups(_ids(spark, folder, True)).select("id", "rep")
    pairs = materialise(C.containment_pairs(_unique(spark, folder)))
    return U.actions(groups, pairs, C.final_supersets(pairs))


@query(
    f"{_MULTI_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, edges AS (SELECT a, b FROM mv WHERE v = 'collapse'), {_REACH}, f AS (SELECT id, regexp_extract(id, '^([a-z]+[0-9]+)-', 1) AS family FROM d), b AS (SELECT f.id, family, coalesce(component, f.id) AS component FROM f LEFT JOIN mem ON f.id = mem.id), "
    "cell AS (SELECT family, component, count(*) AS n FROM b GROUP BY family, component), fam AS (SELECT family, sum(n) AS f FROM cell GROUP BY family), com AS (SELECT component, sum(n) AS c FROM cell GROUP BY component) "
    "SELECT CAST(sum(n) AS BIGINT) AS items, round(sum(n * n / c) / sum(n), 6) AS precision, round(sum(n * n / f) / sum(n), 6) AS recall FROM cell JOIN fam ON cell.family = fam.family JOIN com ON cell.component = com.component"
)
def bcubed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """How well groups of collapsible docs agree with the families that they come from."""
    docs = _texts(spark, folder)
    edges = B.multi_verdicts(docs).where("v = 'collapse'").select("a", "b")
    known = docs.select("id", F.regexp_extract("id", "^([a-z]+[0-9]+)-", 1).alias("family"))
    found = U.b_cubed(S.clusters(edges), known)
    return found.select("items", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_ENTRIES_SQL} SELECT branch AS id, base.id AS base_id, true AS intact FROM ent JOIN (SELECT path, min(branch) AS id FROM ent WHERE branch LIKE '%-base%' AND content IS NOT NULL GROUP BY path) base ON ent.path = base.path WHERE content IS NOT NULL")
def delta_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every doc as a difference from its family's base doc, and whether it comes back intact."""
    live = _entries(spark, folder).where("content is not null").select("path", F.col("branch").alias("id"), "content")
    base = live.where("id like '%-base%'").groupBy("path").agg(F.min(F.struct("id", "content")).alias("b"))
    texts = live.join(base, "path").select("id", "content", F.col("b.id").alias("base_id"), F.col("b.content").alias("base"))
    return U.variants(texts).select("id", "base_id", "intact")


# --- scope and manifest -----------------------------------------------------------------------------------------------


@query(f"WITH {_sql_records()} SELECT coalesce(regexp_extract(id, '[^/](\\.[^./]*)$', 1), '') AS extension, count(*) AS files, CAST(sum(strlen(raw)) AS BIGINT) AS bytes FROM rec GROUP BY 1")
def scan_by_extension(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).groupBy(X.extension(F.col("id")).alias("extension")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


@query("SELECT lower(trim(source)) AS source, count(*) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def scan_by_source(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    return rows.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("texts"), F.sum("n_chars").alias("chars"))


@query("SELECT * FROM (VALUES ('scope', '0'), ('exact_hash', '1'), ('containment', '2'), ('merge3', '2b'), ('similarity', '3'), ('cluster', '4')) t(id, depth)")
def passes_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return P.passes(spark).select("id", "depth")


def queries() -> dict[str, Query]:
    from . import source_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
