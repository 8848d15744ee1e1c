"""Retrieval from chunks: expanded BM25, vectors with feedback, fusion, and the composites on top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line, tokens
from ..sources.workspace import Workspace
from . import bm25, dense, fusion, grounding, intent, vectors

DEPTH, FIRST, FEEDBACK, EXPAND = 200, 50, 10, 0.4
WEIGHTS = {"words": 0.25, "vectors": 1.0}
#: A query whose best score is below this is asked again with corrected words.
LEAST_SCORE = 0.3


class Engine:
    """Relations of a corpus (doc_id, text; each row one chunk) and, where there are some, its vectors (doc_id, v).

    The vocabulary, word memory and what searches use more than once are tables in the engine's workspace, so that every
    plan is short and starts from tables; each ranking reads the texts once. close() removes the tables."""

    def __init__(self, docs: DataFrame, embeddings: DataFrame | None = None):
        self.docs, self.embeddings = docs, embeddings
        self.tables = Workspace(docs.sparkSession, "engine")
        self.stats = self.tables.save(docs.agg(F.count(F.lit(1)).alias("n_docs")))
        self.terms = self.tables.save(bm25.vocabulary(docs))
        self.memory = vectors.learn(docs)

    def close(self) -> None:
        self.tables.close()

    def idf(self) -> DataFrame:
        n = self.stats.select("n_docs")
        return self.terms.crossJoin(F.broadcast(n)).select("term", bm25.idf(F.col("n_docs").cast("double"), F.col("df").cast("double")).alias("idf"))

    def words(self, queries: DataFrame, depth: int) -> DataFrame:
        return self.tables.save(bm25.best(self.docs, queries, {"words": depth}).drop("run"))

    def first_pass(self, queries: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
        """qid, doc_id, rank: the best FIRST by words, fused with those by vectors where queries have vectors (qid, q)."""
        runs = self.words(queries, FIRST).select(F.lit("words").alias("run"), "qid", "doc_id", "rank")
        if self.embeddings is None or embedded is None:
            return runs.drop("run")
        runs = runs.unionByName(dense.search(self.embeddings, embedded, FIRST).select(F.lit("vectors").alias("run"), "qid", "doc_id", "rank"))
        return bm25.top(fusion.fuse(runs, {"words": 0.5, "vectors": 0.5}), FIRST).select("qid", "doc_id", "rank")

    def expanded(self, queries: DataFrame, first: DataFrame) -> DataFrame:
        """corpus, qid, doc_id, score: BM25 of the query and, at EXPAND, of the query with its expansion terms."""
        near = self.docs.select("doc_id", "text").join(bm25.small(first.filter(F.col("rank") <= FEEDBACK)), "doc_id").select("qid", tokens("text").alias("toks"))
        asked = queries.select("qid", tokens("text").alias("toks"))
        terms = vectors.expansion_terms(self.tables.save(asked), self.tables.save(near), self.memory, self.idf()).groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("more"))
        wider = queries.join(self.tables.save(terms), "qid").select("qid", F.concat_ws(" ", "text", "more").alias("text"))
        keep = ["corpus", "qid", "doc_id", "score"]
        return bm25.expanded(self.words(queries, DEPTH).select(*keep), self.words(wider, DEPTH).select(*keep), EXPAND)

    def search(self, queries: DataFrame, k: int = 10, embedded: DataFrame | None = None) -> DataFrame:
        """qid, doc_id, rank, score."""
        first = self.tables.save(self.first_pass(queries, embedded))
        runs = bm25.top(self.expanded(queries, first), DEPTH).select(F.lit("words").alias("run"), "qid", "doc_id", "rank")
        if self.embeddings is not None and embedded is not None:
            centre = first.filter(F.col("rank") <= 3).join(self.embeddings, "doc_id").select("qid", F.posexplode("v").alias("i", "x")).groupBy("qid", "i").agg(F.avg("x").alias("x"))
            mean = centre.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
            moved = embedded.join(mean, "qid", "left").select("qid", dense.unit(F.coalesce(F.zip_with("q", "c", lambda a, b: a + 0.5 * b), F.col("q"))).alias("q"))
            runs = runs.unionByName(dense.search(self.embeddings, moved, DEPTH).select(F.lit("vectors").alias("run"), "qid", "doc_id", "rank"))
        return self.tables.save(bm25.top(fusion.fuse(runs, WEIGHTS), k).select("qid", "doc_id", "rank", "score"))

    def plain(self, embedded: DataFrame, k: int = 10) -> DataFrame:
        """Vectors alone."""
        if self.embeddings is None:
            raise ValueError("the corpus has no vectors")
        return dense.search(self.embeddings, embedded, k)

    def compare(self, queries: DataFrame, embedded: DataFrame, k: int = 10) -> DataFrame:
        both = self.search(queries, k, embedded).withColumn("system", F.lit("fused"))
        return both.unionByName(self.plain(embedded, k).select("qid", "doc_id", "rank", "score").withColumn("system", F.lit("vectors")))

    def with_text(self, hits: DataFrame, size: int | None = None) -> DataFrame:
        """hits with their snippet; texts are joined after ranking."""
        return self.docs.select("doc_id", one_line("text", size).alias("snippet")).join(bm25.small(hits), "doc_id")

    def best_possible(self, embedded: DataFrame | None) -> float:
        """The fused score of a hit that is first in every run."""
        runs = ["words", *(["vectors"] if self.embeddings is not None and embedded is not None else [])]
        return sum(WEIGHTS[r] for r in runs) / fusion.RRF_K

    def smart(self, queries: DataFrame, max_keep: int = intent.MAX_KEEP, embedded: DataFrame | None = None) -> DataFrame:
        """qid, doc_id, rank, snippet, adj_score of the subject's hits after re-scoring and cut-off.

        A query without hits, or with a best score under LEAST_SCORE, is asked again with each subject word replaced by
        the closest word of the corpus, and keeps the better answer. A query whose best hit is first in every run
        cannot get a better one and is not asked again."""
        parsed = self.tables.save(intent.decompose(queries))
        base = parsed.select("qid", F.when(F.col("has_intent_marker") | F.col("has_acronym"), F.col("subject")).otherwise(F.col("text")).alias("text"))
        hits = self.search(base, max_keep, embedded)
        reached = hits.groupBy("qid").agg(F.max("score").alias("best"))
        weak = min(LEAST_SCORE, self.best_possible(embedded) * (1 - 1e-6))
        lost = self.tables.save(base.join(reached, "qid", "left").filter(F.coalesce("best", F.lit(0.0)) < weak))
        subject = parsed
        if not lost.isEmpty():
            asked = lost.select("qid", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit(r"(\b\w+\b)"), F.lit(1)), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*intent.FILLERS))).alias("i", "term"))
            fixes = intent.corrections(asked, self.terms.select("term"))
            fixed = asked.withColumn("key", F.lower("term")).join(fixes.select(F.col("term").alias("key"), "fixed"), "key", "left")
            again = fixed.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("fixed", "term").alias("w")))), lambda s: s["w"]), " ").alias("text"))
            changed = again.join(lost.select("qid", F.lower("text").alias("before"), "best"), "qid").filter(F.lower("text") != F.col("before"))
            changed = self.tables.save(changed)
            rescued = self.search(changed.select("qid", "text"), max_keep, embedded)
            better = rescued.groupBy("qid").agg(F.max("score").alias("now")).join(changed, "qid").filter(F.col("best").isNull() | (F.col("now") > F.col("best"))).select("qid", F.col("text").alias("again"))
            better = self.tables.save(better)
            hits = hits.join(better, "qid", "left_anti").unionByName(rescued.join(better, "qid", "left_semi"))
            subject = parsed.join(better, "qid", "left").withColumn("subject", F.coalesce("again", "subject"))
        found = self.tables.save(self.with_text(hits))
        return intent.adaptive_cutoff(intent.rescore(found, intent.subject_terms(subject)), max_keep=max_keep).select("qid", "doc_id", F.col("adj_rank").alias("rank"), "snippet", "adj_score")

    def retrieve(self, queries: DataFrame, k: int = 5, category: str | None = None, lift_from: float = 0.1) -> tuple[DataFrame, DataFrame]:
        """Hits, and qid, confidence; with a category five times as many are searched and then filtered."""
        found = self.smart(queries, k * 5 if category else max(k, intent.MAX_KEEP))
        if category:
            found = found.join(self.docs.filter(F.coalesce(F.col("category"), F.lit("General")) == category).select("doc_id"), "doc_id", "left_semi")
            found = bm25.top(found.drop("rank"), k, score="adj_score")
        found = self.tables.save(found.filter(F.col("rank") <= k))
        parsed = self.tables.save(intent.decompose(queries))
        cover = intent.subject_coverage(parsed, found)
        sure = grounding.confidence(queries, found, self.memory).join(cover, "qid", "left")
        lifted = F.when(F.col("coverage") >= lift_from, F.greatest("confidence", 0.4 + 0.5 * F.col("coverage"))).otherwise(F.col("confidence"))
        has = found.select("qid").distinct().withColumn("has", F.lit(True))
        return found, sure.join(has, "qid", "left").select("qid", F.round(F.when(F.col("has"), lifted).otherwise(0.0), 9).alias("confidence"))

    def ask(self, queries: DataFrame, answer: Callable[[str], str], threshold: float = grounding.ABSTAIN, k: int = 5) -> DataFrame:
        """qid, confidence, abstained, prompt, answer, grounded, badge; answer is called once for each query that is not
        abstained from, and the sentences that cite are held against the cited hits. Without an answer, grounded and
        badge are null."""
        hits, sure = self.retrieve(queries, k)
        lines = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] "), h["snippet"])), "\n").alias("context"))
        asked = queries.select("qid", "text").join(sure, "qid").join(lines, "qid", "left").withColumn("abstained", F.col("confidence") < threshold)
        asked = asked.withColumn("prompt", F.when(~F.col("abstained"), F.concat(F.lit("Answer from the numbered passages only and cite them.\n"), "context", F.lit("\nQuestion: "), "text")))

        @F.pandas_udf("string")
        def run(prompts):
            return prompts.map(lambda p: answer(p) if isinstance(p, str) else None)

        # written, so that the model is asked once
        said = self.tables.save(asked.select("qid", "confidence", "abstained", "prompt", run("prompt").alias("answer")))
        _, checked = grounding.verify(said.filter("answer is not null").select(F.col("qid").alias("aid"), "answer"), hits.withColumnRenamed("qid", "aid"))
        checked = checked.select(F.col("aid").alias("qid"), "grounded", grounding.badge(F.col("grounded")).alias("badge"))
        return said.join(checked, "qid", "left")
