"""Registered queries over texts, vectors, logs and files, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortvox.operators import evaluate as E, intensity as I, retrieval as R, vectorindex
from cohortvox.plans import exports as X, report as P, step_texts as ST, summary as S
from cohortvox.plans.cohort_queries import COMP, GRID, MEAN, rounded
from cohortvox.plans.report_queries import masked, validated
from cohortvox.sources import manifest as M
from cohortvox.sources.voxels import grid
from cohortvox.sources.workspace import Workspace, stored
from cohortvox.streaming import stages as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


TOKENS = "unnest(regexp_extract_all(lower(text), '[a-z]+'))"
INDEX = f"""tf AS (SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, {TOKENS} AS token FROM documents) GROUP BY 1, 2),
ix AS (SELECT id, token, tf, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM tf)"""
QUERYV = f"""q0 AS (SELECT query, token, count(*) AS n FROM (SELECT item_id AS query, {TOKENS} AS token FROM benchmark) WHERE token IN (SELECT token FROM ix) GROUP BY 1, 2),
qv AS (SELECT query, token, n / sqrt(sum(n * n) OVER (PARTITION BY query)) AS wq FROM q0)"""


@query("v01_d28_term_counts", f"WITH {INDEX} SELECT token, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS uses FROM ix GROUP BY 1")
def v01(spark, sf):
    ix = R.term_index(table(spark, sf, "documents"), "doc_id", "text")
    return ix.groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("uses"))


@query("v02_d29_term_index", f"WITH {INDEX} SELECT id, count(*) AS terms, round(max(w), 6) AS top, round(sum(w * w), 6) AS unit FROM ix GROUP BY 1")
def v02(spark, sf):
    ix = R.term_index(table(spark, sf, "documents"), "doc_id", "text")
    return rounded(ix.groupBy("id").agg(F.count("*").alias("terms"), F.max("w").alias("top"), F.sum(F.col("w") * F.col("w")).alias("unit")))


@query("v03_query_vectors", f"WITH {INDEX}, {QUERYV} SELECT query, token, round(wq, 6) AS wq FROM qv")
def v03(spark, sf):
    ix = R.term_index(table(spark, sf, "documents"), "doc_id", "text")
    return rounded(R.query_vectors(ix, table(spark, sf, "benchmark"), "item_id", "text"))


@query("v04_term_top2", f"WITH {INDEX}, {QUERYV} SELECT query, id, round(score, 6) AS score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS k FROM (SELECT query, id, sum(wq * w) AS score FROM qv JOIN ix USING (token) GROUP BY 1, 2)) WHERE k <= 2")
def v04(spark, sf):
    docs = table(spark, sf, "documents")
    ix = R.term_index(docs, "doc_id", "text")
    return rounded(R.term_top_k(ix, docs, table(spark, sf, "benchmark"), "doc_id", "item_id", "text").select("query", "id", "score", "rank"))


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").withColumn("d", F.col("embedding").cast("array<double>"))


def vector_store(spark, sf):
    """The folder of the index over all vectors, built once for each state of the table."""
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("d").alias("v"), "label")
    return stored(spark, "vector-index", [f"{sf}/embeddings.parquet"], lambda folder: vectorindex.build(rows, folder), "/done")


def _questions(spark, sf):
    return _embeddings(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("d").alias("q"))


def _dense(spark, sf, where=None):
    return vectorindex.VectorIndex(spark, vector_store(spark, sf)).search(_questions(spark, sf), 3, where)


def _dense_sql(cond):
    return f"""SELECT query, id, round(distance, 5) AS distance, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS k FROM
 (SELECT q.vec_id AS query, e.vec_id AS id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS distance
 FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE {cond})) WHERE k <= 3"""


@query("v05_t02_dense_top3", _dense_sql("true"))
def v05(spark, sf):
    return rounded(_dense(spark, sf), 5)


@query("v06_dense_or_terms", _dense_sql("true").replace("SELECT query, id, round(distance, 5) AS distance, CAST(k AS INT) AS rank", "SELECT query, id, CAST(k AS INT) AS rank", 1))
def v06(spark, sf):
    return R.nearest_or_terms(spark, vector_store(spark, sf), _questions(spark, sf), lambda: v04(spark, sf), 3)


@query("v06_terms_without_store", f"WITH {INDEX}, {QUERYV} SELECT query, id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS k FROM (SELECT query, id, sum(wq * w) AS score FROM qv JOIN ix USING (token) GROUP BY 1, 2)) WHERE k <= 2")
def v06_terms(spark, sf):
    return R.nearest_or_terms(spark, f"{Workspace(spark, 'no-store').root}/index", _questions(spark, sf), lambda: v04(spark, sf))


@query("v07_filtered_dense_top3", _dense_sql("e.label = 3"))
def v07(spark, sf):
    return rounded(_dense(spark, sf, F.col("label") == 3), 5)


GATE = ("license", "copyright", "error", "confirmed")


@query("b25_keyword_gate", "SELECT doc_id, " + "coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in GATE) + ", 'none') AS hit FROM documents")
def b25(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(R.gate(F.col("text"), GATE), F.lit("none")).alias("hit"))


@query("b26_service_gate", "SELECT conv_id, turn, coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in R.SERVICE_GATE) + ", 'none') AS hit FROM conversations WHERE role = 'user'")
def b26(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user'")
    return q.select("conv_id", "turn", F.coalesce(R.gate(F.col("text"), R.SERVICE_GATE), F.lit("none")).alias("hit"))


@query("b27_upload_check", "SELECT page_id, regexp_matches(lower(split_part(split_part(url, '?', 1), '#', 1)), '\\.(html|htm)$') AS accepted FROM pages")
def b27(spark, sf):
    name = F.element_at(F.split(F.element_at(F.split("url", r"\?"), 1), "#"), 1)
    return table(spark, sf, "pages").select("page_id", M.accepted_upload(name, F.col("page_id").cast("string"), ("html", "htm")).alias("accepted"))


_DEFS = [f"- {t}:\n{x}" for t, x in R.DEFINITIONS]
_BLOCKS = "[" + ", ".join("'" + "\n\n".join(_DEFS[:k]).replace("'", "''") + "'" for k in range(1, len(_DEFS) + 1)) + "]"


@query("r23_prompts", f"SELECT conv_id, turn, 'REPORT:' || chr(10) || 'none' || chr(10) || chr(10) || 'DEFINITIONS:' || chr(10) || CASE WHEN turn % 4 = 0 THEN 'No definitions retrieved.' ELSE {_BLOCKS}[turn % 4] END || chr(10) || chr(10) || 'QUESTION:' || chr(10) || trim(text) AS prompt FROM conversations WHERE role = 'user'")
def r23(spark, sf):
    """The turn decides how many of the built-in definitions a prompt holds."""
    q = table(spark, sf, "conversations").where("role = 'user'")
    known = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(x).alias("text")) for t, x in R.DEFINITIONS])
    some = F.slice(known, F.lit(1), (F.col("turn") % 4).cast("int"))
    return q.select("conv_id", "turn", R.prompt(F.lit("none"), some, F.col("text")).alias("prompt"))


@query("r24_answer_routing", f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license|copyright|error|confirmed') THEN 'refused' WHEN doc_id % 3 = 0 THEN 'no_data' ELSE 'ready' END AS status, CASE WHEN regexp_matches(lower(text), 'license|copyright|error|confirmed') THEN '{R.REFUSAL}' WHEN doc_id % 3 = 0 THEN '{R.NO_DATA}' END AS answer FROM documents")
def r24(spark, sf):
    d = table(spark, sf, "documents").withColumn("context", F.when(F.col("doc_id") % 3 != 0, F.lit("a definition")))
    return R.route(d, "text", "context", GATE).select("doc_id", "status", "answer")


STAGE_NAMES = ("segmenting", "extracting", "generating", "exporting", "error")


def stage_lines(events: DataFrame) -> DataFrame:
    """Events as log lines: a user is a job, the event's type picks a marker, its place is (time, id)."""
    k = F.pmod(F.col("event_id"), F.lit(len(STAGE_NAMES) + 2)).cast("int")
    mark = F.element_at(F.array(*[F.lit(f"STAGE:{s}") for s in (*STAGE_NAMES, "done")], F.lit("note")), k + 1)
    return events.select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("pos"), F.concat(F.col("event_type"), F.lit(" "), mark).alias("line"))


@query("st01_job_status", """WITH e AS (SELECT *, event_id % 7 AS k FROM events), m AS (SELECT user_id AS job_id,
 arg_max(k, (ts, event_id)) FILTER (WHERE k < 6) AS k, max(CASE k WHEN 0 THEN 10 WHEN 1 THEN 40 WHEN 2 THEN 70 WHEN 3 THEN 90 WHEN 5 THEN 100 END) AS most,
 arg_max(event_type || ' ' || CASE WHEN k < 6 THEN 'STAGE:' || ['segmenting', 'extracting', 'generating', 'exporting', 'error', 'done'][k + 1] ELSE 'note' END, (ts, event_id)) AS last FROM e GROUP BY 1)
SELECT job_id, CASE WHEN k = 4 THEN 'error' WHEN k = 5 THEN 'done' ELSE 'running' END AS status, coalesce(['segmenting', 'extracting', 'generating', 'exporting', 'error', 'done'][k + 1], 'segmenting') AS stage,
 CAST(CASE WHEN k = 4 THEN coalesce(most, 10) ELSE coalesce([10, 40, 70, 90, 0, 100][k + 1], 10) END AS INT) AS progress_pct, CASE WHEN k = 4 THEN last END AS error_message FROM m""")
def st01(spark, sf):
    return T.fold_status(stage_lines(table(spark, sf, "events")))


@query("st03_known_jobs", "SELECT c_custkey AS job_id, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS logged FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey")
def st03(spark, sf):
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))
    return T.known_jobs(jobs, st01(spark, sf)).select("job_id", F.when((F.col("progress_pct") == 0) & (F.col("status") == "running"), 0).otherwise(1).alias("logged"))


def order_files(spark, sf) -> DataFrame:
    """Orders as volume files: eight orders make a folder, their status and priority pick sequence and naming."""
    o = table(spark, sf, "orders")
    seq = F.element_at(F.array(*[F.lit(s) for s in ("t1n", "t1c", "t2w", "t2f", "seg")]), (F.substring("o_orderpriority", 1, 1).cast("int") - 1) % 5 + 1)
    n = F.floor(F.col("o_orderkey") / 8)
    over = F.when(n >= 100000, F.floor(n / 100000).cast("string")).otherwise("")  # a name has five digits; the rest is in its prefix
    case = F.format_string("C%s-%05d-000", over, n % 100000)
    ext = F.when(F.col("o_orderstatus") == "F", ".nii").otherwise(".nii.gz")
    return o.select(F.concat(F.lit("/cohort/"), case, F.lit("/"), case, F.lit("-"), seq, ext).alias("path")).distinct()


FILES = """f AS (SELECT DISTINCT c, s, x FROM (SELECT printf('C%s-%05d-000', CASE WHEN o_orderkey >= 800000 THEN CAST(o_orderkey // 800000 AS VARCHAR) ELSE '' END, (o_orderkey // 8) % 100000) AS c, ['t1n', 't1c', 't2w', 't2f', 'seg'][(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) % 5 + 1] AS s, CASE WHEN o_orderstatus = 'F' THEN '.nii' ELSE '.nii.gz' END AS x FROM orders))"""


@query("a03_a08_case_completeness", f"WITH {FILES} SELECT c AS case_id, count(DISTINCT s) FILTER (WHERE s <> 'seg') = 4 AS complete, count(*) AS files, bool_or(s = 'seg') AS has_ground_truth FROM f GROUP BY 1")
def a08(spark, sf):
    m = M.manifest(order_files(spark, sf))
    return M.sequence_paths(m).select("case_id", "complete").join(M.inventory(m), "case_id")


@query("a05_a06_rename_plan", f"WITH {FILES}, t AS (SELECT *, count(*) OVER (PARTITION BY c, s) AS n FROM f) SELECT '/cohort/' || c || '/' || c || '-' || s || x AS path, '/cohort/' || c || '/' || c || '_' || CASE s WHEN 't1n' THEN 't1' WHEN 't1c' THEN 't1ce' WHEN 't2w' THEN 't2' WHEN 't2f' THEN 'flair' ELSE s END || '.nii.gz' AS target, CASE WHEN n > 1 THEN 'error' ELSE 'rename' END AS action FROM t")
def a06(spark, sf):
    return M.rename_plan(M.manifest(order_files(spark, sf))).select("path", "target", "action")


@query("a07_folders", f"WITH {FILES} SELECT DISTINCT '/cohort/' || c AS dir FROM f")
def a07(spark, sf):
    return M.folders(M.manifest(order_files(spark, sf)))


@query("a10_availability", f"WITH {FILES} SELECT c AS case_id, concat_ws(',', CASE WHEN bool_or(s = 't1n') THEN 'T1' END, CASE WHEN bool_or(s = 't1c') THEN 'T1ce' END, CASE WHEN bool_or(s = 't2w') THEN 'T2' END, CASE WHEN bool_or(s = 't2f') THEN 'FLAIR' END) AS performed, concat_ws(',', CASE WHEN NOT bool_or(s = 't1n') THEN 'T1' END, CASE WHEN NOT bool_or(s = 't1c') THEN 'T1ce' END, CASE WHEN NOT bool_or(s = 't2w') THEN 'T2' END, CASE WHEN NOT bool_or(s = 't2f') THEN 'FLAIR' END, 'DWI,ADC,MRS,Perfusion') AS not_available, bool_or(s = 't1c') AS contrast FROM f GROUP BY 1")
def a10(spark, sf):
    return M.availability(M.manifest(order_files(spark, sf)))


def _quoted(words):
    return "[" + ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words) + "]"


#: Every line of every document, numbered from 0; a null text is one null line.
LINES = "li AS (SELECT doc_id, unnest(range(len(c))) AS line, replace(unnest(c), chr(9), ' ') AS content FROM (SELECT doc_id, coalesce(string_split(text, chr(10)), [NULL]) AS c FROM documents))"


def all_lines(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "content"))
    return d.select("doc_id", F.coalesce("line", F.lit(0)).cast("long").alias("line"), F.replace("content", F.lit("\t"), F.lit(" ")).alias("content"))


@query("r12_r25_banned_words", f"SELECT doc_id, array_to_string(list_transform(list_filter({_quoted(P.BANNED)}, lambda w: contains(safe, w)), lambda w: lower(w)), ',') AS banned FROM (SELECT doc_id, {masked('lower(text)')} AS safe FROM documents)")
def r12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(",", F.transform(P.banned_words(F.col("text")), lambda w: F.lower(w))).alias("banned"))


@query("r13_section_terms", f"WITH b AS (SELECT doc_id, list_filter({_quoted(P.SECTION_TERMS['FINDINGS'])}, lambda w: contains(lower(text), w)) AS hit FROM documents) SELECT doc_id, array_to_string(hit, ',') AS terms FROM b")
def r13(spark, sf):
    terms = F.array(*[F.lit(t) for t in P.SECTION_TERMS["FINDINGS"]])
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(",", P.held(terms, F.col("text"))).alias("terms"))


RULED = [k for k, v in P.SLOTS.items() if v]
_BY_DOC = "SELECT struct_pack(case_id := doc_id // {n}, line := line) AS case_id, {slots}[doc_id % {n} + 1] AS slot, content FROM li".format(n=len(RULED), slots=_quoted(RULED))


@query("r15_r17_validated_slots", f"WITH {LINES},\n{validated(_BY_DOC)} SELECT case_id.case_id AS case_id, case_id.line AS line, slot, original, sanitized, array_to_string(violations, '; ') AS violations FROM chk")
def r17(spark, sf):
    """Line k of as many documents as there are slots is a case."""
    pick = F.element_at(F.array(*[F.lit(s) for s in RULED]), (F.pmod("doc_id", F.lit(len(RULED))) + 1).cast("int"))
    case = F.struct(F.floor(F.col("doc_id") / len(RULED)).alias("case_id"), "line")
    c = P.validate(all_lines(spark, sf).select(case.alias("case_id"), pick.alias("slot"), "content"), P.slot_specs(spark))
    return c.select("case_id.case_id", "case_id.line", "slot", "original", "sanitized", F.array_join("violations", "; ").alias("violations"))


_VENTRICLES = "SELECT struct_pack(doc_id := doc_id, line := line) AS case_id, 'ventricles_sentence' AS slot, content FROM li"


@query("r15_length_limit", f"WITH {LINES},\n{validated(_VENTRICLES)} SELECT case_id.doc_id AS doc_id, case_id.line AS line, sanitized FROM chk")
def r15(spark, sf):
    v = all_lines(spark, sf).select(F.struct("doc_id", "line").alias("case_id"), F.lit("ventricles_sentence").alias("slot"), "content")
    return P.validate(v, P.slot_specs(spark)).select("case_id.doc_id", "case_id.line", "sanitized")


@query("r18_allowed_values", "SELECT doc_id, lang IN ('left', 'right', 'bilateral') OR lang = '' AS valid FROM documents")
def r18(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", F.lit("impression_summary").alias("slot"), F.lit("hemisphere").alias("field"), F.col("lang").alias("value"))
    return P.allowed_value(P.slot_specs(spark), v).select("doc_id", "valid")


@query("r21_sentence_integrity", f"WITH {LINES} SELECT doc_id, line, CAST(regexp_matches(content, '^[a-z]') AS INT) + CAST(regexp_matches(content, ',\\s*$') AS INT) + CAST(regexp_matches(content, '^\\s*and\\s') AS INT) + CAST(regexp_matches(content, '^\\s*with\\s') AS INT) + CAST(regexp_matches(content, ',\\s*,') AS INT) + CAST(regexp_matches(content, '\\s{{2,}}') AS INT) + CAST(length(content) > 0 AND NOT regexp_matches(trim(content), '[.?!]$') AND NOT regexp_matches(trim(content), '^(1\\.|2\\.|-|\\*)') AS INT) AS signs FROM li")
def r21(spark, sf):
    return all_lines(spark, sf).select("doc_id", "line", F.size(P.integrity(F.col("content"))).alias("signs"))


@query("d30_concept_mentions", "SELECT conv_id, turn, concept, len(regexp_extract_all(lower(text), concept)) AS mentions FROM conversations, (VALUES " + ", ".join(f"('{k.replace('_', ' ')}')" for k in P.OWNERS) + ") t(concept)")
def d30(spark, sf):
    return P.concept_mentions(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "concept", "mentions")


_HEAD = "CASE WHEN contains(text, '---') THEN split_part(text, '---', 1) ELSE '' END"


@query("a14_front_matter", f"SELECT CAST(doc_id AS VARCHAR) AS id, trim(regexp_extract({_HEAD}, '(?m)^TITLE:(.*)$', 1)) AS title, trim(regexp_extract({_HEAD}, '(?m)^KEYWORDS:(.*)$', 1)) AS keywords, trim(CASE WHEN contains(text, '---') THEN substr(text, strpos(text, '---') + 3) ELSE text END, ' ' || chr(10) || chr(13) || chr(9)) AS body FROM documents")
def a14(spark, sf):
    files = table(spark, sf, "documents").select(F.concat(F.lit("/kb/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("value"))
    return X.articles(files).select("id", "title", "keywords", "body")


def found(spark, sf):
    """The findings of every derived case, run once for each state of the input."""

    def build(folder):
        S.findings(grid(spark, sf), Workspace(spark, "findings"), ventricle_voxels=5).write.parquet(folder)

    return spark.read.parquet(stored(spark, "findings", [f"{sf}/lineitem.parquet"], build))


def summary(spark, sf):
    return S.compile_summary(found(spark, sf))


@query("e36_a11_summary_json")
def e36(spark, sf):
    s = summary(spark, sf)
    return s.select("case_id", F.to_json(F.struct(*s.columns)).alias("summary"))


@query("e39_step_texts")
def e39(spark, sf):
    return ST.step_texts(found(spark, sf))


@query("e40_comprehensive_report")
def e40(spark, sf):
    return ST.comprehensive_report(found(spark, sf), "2024-01-31")


@query("r11_r20_reports")
def r20(spark, sf):
    reports = P.report_bundle(summary(spark, sf), "2024-01-31")[0]
    return reports.select("case_id", "report", F.array_join("notes", "; ").alias("notes"))


def _printed(count: str) -> str:
    """A volume as printed: the shortest digits of the double, rounded half up."""
    return f"lpad(CAST(round(CAST(CAST({count} * 0.0015::DOUBLE AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DECIMAL(20, 2))::VARCHAR, 10, ' ')"


_VOLUME_LINES = " || chr(10) || ".join(
    f"'  {name:<29}' || {_printed(f'count(*) FILTER (WHERE {mask})')} || ' cm³'" for name, mask in
    (("Necrotic Core (NCR):", "seg = 1"), ("Peritumoral Edema (ED):", "seg = 2"), ("Enhancing Tumor (ET):", "seg IN (3, 4)"), ("Tumor Core (TC = NCR + ET):", "seg IN (1, 3, 4)"), ("Whole Tumor (WT = all):", "seg > 0"))
)


@query("a13_volume_text", f"WITH {GRID} SELECT case_id, 'Tumor Regions:' || chr(10) || {_VOLUME_LINES} AS text FROM g GROUP BY 1")
def a13(spark, sf):
    return X.volume_text(I.volumes_cm3(grid(spark, sf)))


@query("a20_parsed_mean_dice", "WITH RECURSIVE " + ",\n".join((GRID, COMP, MEAN)) + " SELECT case_id, round(100 * mean_dice, 2) AS mean_dice_percent FROM m")
def a20(spark, sf):
    g = grid(spark, sf)
    text = X.score_text(E.label_scores(g, "seg_pred", "seg"), E.compound_scores(g, "seg_pred", "seg"), E.mean_dice(g, "seg_pred", "seg"))
    return text.select("case_id", X.parse_mean_dice(F.col("text")).alias("mean_dice_percent"))


@query("a19_run_record", "WITH RECURSIVE " + ",\n".join((GRID, COMP, MEAN)) + """ SELECT case_id, '{"case_id":' || case_id || ',"output_folder":"/cohort/results/' || case_id || '","feature_extraction_folder":"/cohort/results/' || case_id || '/feature_extraction","metrics":{"mean_dice":' || round(mean_dice, 4) || '}}' AS record FROM m""")
def a19(spark, sf):
    g = grid(spark, sf)
    return X.run_record(g.select("case_id").distinct(), rounded(E.mean_dice(g, "seg_pred", "seg"), 4), "/cohort")


@query("a21_cases_without_summary", "SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def a21(spark, sf):
    o = table(spark, sf, "orders").withColumn("case_id", F.col("o_custkey"))
    return X.without_summary(o, o.where("o_orderstatus = 'F'"))


@query("a23_job_reports", "SELECT c_custkey AS job_id, c_nationkey AS case_id, n_name AS report FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def a23(spark, sf):
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("case_id"))
    return X.report_of_job(jobs, table(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"), F.col("n_name").alias("report")))


@query("a14_articles", "SELECT CAST(page_id AS VARCHAR) AS id, 'Page ' || page_id AS title, 'Title: Page ' || page_id || chr(10) || chr(10) || 'Keywords: web' || chr(10) || chr(10) || trim(url, ' ' || chr(10) || chr(13) || chr(9)) AS document_text FROM pages")
def a14b(spark, sf):
    head = F.concat(F.lit("TITLE: Page "), F.col("page_id").cast("string"), F.lit("\nKEYWORDS: web\n---\n"), F.col("url"))
    files = table(spark, sf, "pages").select(F.concat(F.lit("/kb/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), head.alias("value"))
    return X.articles(files).select("id", "title", "document_text")


@query("r22_fallback_values", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_totalprice / 10000 < 5 THEN 'Minimal' WHEN o_totalprice / 10000 < 15 THEN 'Moderate' WHEN o_totalprice / 10000 < 30 THEN 'Significant' ELSE 'Extensive' END WHEN 1 THEN CASE WHEN o_custkey % 4 > 1 THEN 'multifocal' ELSE 'focal' END ELSE 'a' END AS value FROM orders")
def r22(spark, sf):
    field = F.element_at(F.array(F.lit("edema_degree"), F.lit("distribution"), F.lit("shape")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    v = X.fallback_value(field, F.array(F.lit("a"), F.lit("b")), F.col("o_totalprice") / 10000, F.lit(None).cast("string"), F.col("o_custkey") % 4)
    return table(spark, sf, "orders").select("o_orderkey", v.alias("value"))


TURN_SLOTS = ("enhancement_sentence", "necrosis_sentence", "edema_sentence", "ventricles_sentence")
_TURNS = f"SELECT struct_pack(conv_id := conv_id, block := turn // {len(TURN_SLOTS)}) AS case_id, {_quoted(TURN_SLOTS)}[turn % {len(TURN_SLOTS)} + 1] AS slot, text AS content FROM conversations"


@query("r16_concept_ownership", f"WITH {validated(_TURNS)} SELECT case_id.conv_id AS conv_id, case_id.block AS block, slot, len(list_filter(violations, lambda x: starts_with(x, 'Concept'))) AS repeats FROM chk")
def r16(spark, sf):
    """Four turns in a row are a case with a slot each; no turn is left out."""
    k = F.pmod("turn", F.lit(len(TURN_SLOTS)))
    pick = F.element_at(F.array(*[F.lit(s) for s in TURN_SLOTS]), (k + 1).cast("int"))
    block = F.struct("conv_id", ((F.col("turn") - k) / len(TURN_SLOTS)).cast("long").alias("block"))
    c = table(spark, sf, "conversations").select(block.alias("case_id"), pick.alias("slot"), F.col("text").alias("content"))
    v = P.validate(c, P.slot_specs(spark))
    repeats = F.size(F.filter("violations", lambda x: F.startswith(x, F.lit("Concept"))))
    return v.select("case_id.conv_id", "case_id.block", "slot", repeats.alias("repeats"))
