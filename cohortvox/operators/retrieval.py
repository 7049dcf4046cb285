"""Top-k retrieval over term and vector indexes, keyword gates and prompt assembly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortvox.operators import vectorindex

#: Words that gate a question in the assistant and in the service, answers, and the built-in definitions (term, text).
ASSISTANT_GATE = ("treatment", "therapy", "surgery", "medication", "drug", "prognosis", "survival", "outcome", "chemotherapy", "radiation")
SERVICE_GATE = (
    "treatment", "prognosis", "diagnose", "diagnosis", "should i", "will the patient", "survival", "chemotherapy", "radiation", "surgery",
    "grade", "malignant", "benign", "cancer",
)
REFUSAL = "This question requires clinical judgment. Please consult a qualified radiologist."
NO_DATA = "The requested information is not available in the provided data."
DEFINITIONS = (
    ("Midline shift", "Midline shift refers to the displacement of brain structures from their normal central position to one side. It is measured in millimeters on axial MRI or CT images and indicates asymmetric mass effect within the cranial cavity."),
    ("Peritumoral edema", "Peritumoral edema is the accumulation of excess fluid in the brain tissue surrounding a tumor. On T2-weighted and FLAIR MRI sequences it appears as a region of high signal intensity around the tumor margin."),
    ("Enhancing tumor", "An enhancing tumor is a region that shows increased signal intensity on post-contrast T1-weighted MRI images after gadolinium administration. Enhancement indicates areas where the blood-brain barrier is disrupted, allowing contrast agent to accumulate."),
)
#: Query vectors and their bytes up to which a dense search broadcasts them.
BROADCAST_QUERIES = 100_000
BROADCAST_BYTES = 64 << 20
#: Terms of all queries up to which their vectors are broadcast (about 40 bytes each).
BROADCAST_TERMS = 1_000_000
#: Bytes of text whose terms a task counts.
TASK_BYTES = 8 << 20
#: Documents whose upper bounds are taken together, and queries scored at once.
BLOCK_DOCS = 128
BLOCK_QUERIES = 128


def definitions(spark: SparkSession) -> DataFrame:
    """``(id, text)``: the built-in definitions as documents of an index, by term."""
    return spark.createDataFrame(DEFINITIONS, "id string, text string")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def term_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, token, tf, w)``: term counts and weights of unit length per document.

    Texts are dealt by id once, into more parts the longer they are in all;
    counts, norms and what follows by id stay there.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = (src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK_BYTES + 1
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartition(parts, "id") if parts > usual else src.repartition("id")
    tf = src.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("id")))
    return tf.select("id", "token", "tf", (F.col("tf") / norm).alias("w"))


def query_vectors(index: DataFrame, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Unit vectors of the queries over the index's vocabulary (unknown tokens are dropped first)."""
    q = queries.select(F.col(id_col).alias("query"), F.explode(tokens(F.col(text_col))).alias("token"))
    q = q.join(index.select("token").distinct(), "token", "left_semi").groupBy("query", "token").agg(F.count("*").alias("tf"))
    norm = q.groupBy("query").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return q.join(norm, "query").select("query", "token", (F.col("tf") / F.col("norm")).alias("wq"))


class TermVectors:
    """Query vectors by term: of each term the queries that hold it and their weights."""

    def __init__(self, term: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, terms: int):
        order = np.argsort(term, kind="stable")
        self.query, self.weight, self.queries = query[order], weight[order], queries
        self.off = np.searchsorted(term[order], np.arange(terms + 1))

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in terms, query, weight)`` of all queries of some terms."""
        n = self.off[terms + 1] - self.off[terms]
        at = np.repeat(self.off[terms], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(terms)), n), self.query[at], self.weight[at]


class TopTerms:
    """The k best documents per query of those shown, by (score rounded to 9 digits, id)."""

    def __init__(self, vectors: TermVectors, k: int):
        self.vectors, self.k = vectors, k
        self.best: dict[int, list] = {}
        self.least = np.full(vectors.queries, -np.inf)  # the k-th score so far
        self.scored = 0

    def add(self, ids: list, off: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        """A block of documents in the order of their ids: scores the queries whose upper bound can reach rank k."""
        present, at = np.unique(term, return_inverse=True)
        most = np.zeros(len(present))
        np.maximum.at(most, at, w)
        place, query, weight = self.vectors.postings(present)
        bound = np.bincount(query, weight * most[place], self.vectors.queries)
        live = np.flatnonzero((bound > 0) & (bound + 1e-8 >= self.least))
        rows = np.zeros((len(ids), len(present)))
        rows[np.repeat(np.arange(len(ids)), np.diff(off)), at] = w
        for a in range(0, len(live), BLOCK_QUERIES):
            part = live[a : a + BLOCK_QUERIES]
            column = np.full(self.vectors.queries, -1)
            column[part] = np.arange(len(part))
            mine = column[query] >= 0
            wq = np.zeros((len(present), len(part)))
            wq[place[mine], column[query[mine]]] = weight[mine]
            score = np.round(rows @ wq, 9)
            self.scored += score.size
            order = np.argsort(-score, axis=0, kind="stable")[: self.k]
            for x in np.flatnonzero(score.max(0) >= np.maximum(self.least[part], 1e-9)):
                q = int(part[x])
                new = [(-score[d, x], ids[d]) for d in order[:, x] if score[d, x] > 0]
                self.best[q] = sorted(self.best.get(q, []) + new)[: self.k]
                if len(self.best[q]) == self.k:
                    self.least[q] = -self.best[q][-1][0]


def _best_by_block(index: DataFrame, qv: DataFrame, k: int) -> DataFrame:
    """``(query, id, score)``: each task's k best documents per query, from the query vectors in its memory."""
    spark = index.sparkSession
    got = qv.toArrow()  # BROADCAST_TERMS rows at most
    token, query = (got.column(c).combine_chunks().dictionary_encode() for c in ("token", "query"))
    vectors = TermVectors(token.indices.to_numpy(), query.indices.to_numpy(), got.column("wq").to_numpy(), len(query.dictionary), len(token.dictionary))
    shared = spark.sparkContext.broadcast(vectors)
    names = spark.createDataFrame(list(enumerate(query.dictionary.to_pylist())), f"q bigint, query {qv.schema['query'].dataType.simpleString()}")
    words = spark.createDataFrame([(t, j) for j, t in enumerate(token.dictionary.to_pylist())], "token string, term int")

    def run(batches):
        top, kind = TopTerms(shared.value, k), None
        for batch in batches:
            kind = batch.column("id").type
            for a in range(0, batch.num_rows, BLOCK_DOCS):
                b = batch.slice(a, BLOCK_DOCS)
                ids = b.column("id").to_pylist()
                order = sorted(range(len(ids)), key=ids.__getitem__)
                lists = b.column("terms").take(pa.array(order))
                off = lists.offsets.to_numpy()
                flat = lists.values.slice(off[0], off[-1] - off[0])
                top.add([ids[j] for j in order], off - off[0], flat.field("term").to_numpy().astype(np.int64), flat.field("w").to_numpy())
        if top.best:
            rows = [(q, i, -s) for q, held in top.best.items() for s, i in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([float(r[2]) for r in rows])], ["q", "id", "score"])

    terms = index.where(F.col("id").isNotNull()).join(F.broadcast(words), "token").groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    best = terms.mapInArrow(run, f"q bigint, id {index.schema['id'].dataType.simpleString()}, score double")
    return best.join(F.broadcast(names), "q").select("query", "id", "score")


def term_top_k(index: DataFrame, docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text_col: str, k: int = 2) -> DataFrame:
    """``(query, id, score, rank)`` by cosine, ties by id.

    Documents stay where the index dealt them.  A task takes them in blocks; of
    each block and query an upper bound (the query's weights times the block's
    largest ones) tells whether any of its documents can reach rank k, and only
    then they are scored.  What leaves a task is k documents a query.  Queries
    with more terms than BROADCAST_TERMS in all meet the index by a join instead.
    Documents that share no token have score 0 and stay eligible: they fill
    ranks from the k smallest ids and the matched documents' neighbours in id
    order.  Null ids are not retrieved.
    """
    qv = query_vectors(index, queries, query_id, text_col)
    terms = queries.agg(F.sum(F.size(F.array_distinct(tokens(F.col(text_col)))))).first()[0] or 0
    if terms <= BROADCAST_TERMS:
        hits = _best_by_block(index, qv, k)
    else:
        hits = index.join(qv, "token").groupBy("query", "id").agg(F.sum(F.col("wq") * F.col("w")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    have = best.groupBy("query").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    short = queries.select(F.col(query_id).alias("query")).distinct().join(have, "query", "left").where(F.coalesce("n", F.lit(0)) < k)
    first = docs.select(F.col(doc_id).alias("id")).distinct().orderBy("id").limit(2 * k)
    fill = short.join(first, F.lit(True)).where(F.col("ids").isNull() | ~F.array_contains("ids", F.col("id"))).select("query", "id", F.lit(0.0).alias("score"))
    out = best.select("query", "id", "score").unionByName(fill)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 2, where: Column | None = None, most: int = BROADCAST_QUERIES) -> DataFrame:
    """``(query, id, distance, rank)`` of the k nearest vectors (squared distance, ties by id), without an index.

    ``vectors`` has (id, v), ``queries`` (query, q).  The stated queries meet all
    vectors block by block: at most ``most`` of them, and BROADCAST_BYTES, are
    broadcast at a time, and
    each task keeps k rows per query before the shuffle.
    """
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("q")), F.lit(0))).first()
    most = max(1, min(most, n * BROADCAST_BYTES // max(size, 1)))
    v = vectors if where is None else vectors.where(where)
    w = Window.partitionBy("query").orderBy("distance", "id")
    parts = []
    blocks = max(1, -(-n // most))
    for b in range(blocks):
        q = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        d = v.join(F.broadcast(q), F.lit(True)).select("query", "id", squared_distance(F.col("v"), F.col("q")).alias("distance"))
        parts.append(d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_or_terms(spark: SparkSession, folder: str | None, queries: DataFrame, terms: Callable[[], DataFrame], k: int = 2, where: Column | None = None) -> DataFrame:
    """``(query, id, rank)`` from the vector store in ``folder`` where one was built, else from the term store.

    The store's existence decides; the branch not taken is never planned.
    """
    if folder is not None and vectorindex.exists(spark, folder):
        return vectorindex.VectorIndex(spark, folder).search(queries, k, where).select("query", "id", "rank")
    return terms().select("query", "id", "rank")


def gate(text: Column, words: tuple[str, ...]) -> Column:
    """The first gating word that a text holds, or null."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)) for w in words])


PROMPT = "REPORT:\n{report}\n\nDEFINITIONS:\n{definitions}\n\nQUESTION:\n{question}"


def prompt(report: Column, definitions: Column, question: Column) -> Column:
    """The prompt's text; ``definitions`` is an array of structs (title, text)."""
    block = F.array_join(F.transform(definitions, lambda d: F.concat(F.lit("- "), d["title"], F.lit(":\n"), d["text"])), "\n\n")
    block = F.when(F.size(definitions) > 0, block).otherwise("No definitions retrieved.")
    out = F.replace(F.lit(PROMPT), F.lit("{report}"), F.trim(report))
    return F.replace(F.replace(out, F.lit("{definitions}"), block), F.lit("{question}"), F.trim(question))


def route(questions: DataFrame, text: str, context: str, words: tuple[str, ...] = ASSISTANT_GATE) -> DataFrame:
    """Adds ``status`` and ``answer``: refused, without data, or ready for a model."""
    hit = gate(F.col(text), words)
    empty = F.coalesce(F.trim(F.col(context)), F.lit("")) == ""
    return questions.withColumn("status", F.when(hit.isNotNull(), "refused").when(empty, "no_data").otherwise("ready")).withColumn(
        "answer", F.when(hit.isNotNull(), REFUSAL).when(empty, NO_DATA)
    )
