"""How sure a retrieval is, and whether an answer's citations support it."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import CONTEXT_NNZ, NNZ, PAIR_NNZ, PAIR_SPACE, STEM_NNZ, STEM_SPACE, vector
from ..functions.text import MIN_STEM, SHORT_PAIR, SUFFIXES, citation_only, citations, light_stem, sentences, token_list, tokens, with_stems
from . import vectors
from .bm25 import small

ABSTAIN, SUPPORT = 0.3, 0.25
# Fixed words that carry no topic in a query.
QUERY_STOP = "what which whose where when who whom why how the and for but are was were have has had you your yours this that these those with from about into over under between such than then they them their there any all some more most many much very just also can could should would shall will may might must does did doing done tell give show explain describe list outline summarise summarize summary details detail please kindly define single word line sentence briefly brief short shortly long longer longest in one few couple meaning matlab".split()


def content(text: Column | str) -> Column:
    stop = F.array(*[F.lit(w) for w in QUERY_STOP])
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def prefix(term: Column) -> Column:
    """All but the last three letters, at least five; null for shorter words."""
    need = F.greatest(F.lit(5), F.length(term) - 3)
    return F.when(F.length(term) >= need, F.left(term, need))


def known_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct term, known: the word, its stem, or a word with its prefix is in vocabulary (term).

    Words meet by equality: each word of the vocabulary gives its prefixes of the lengths asked for."""
    asked = terms.select("term").distinct().withColumn("stem", light_stem("term")).withColumn("prefix", prefix(F.col("term")))
    vocab = vocabulary.select("term").distinct()
    lengths = small(asked.filter("prefix is not null").select(F.length("prefix").alias("n")).distinct())
    # the vocabulary is the large side: it is met by what is asked, and only what they share goes on
    starts = vocab.join(lengths, F.length("term") >= F.col("n")).select(F.left("term", F.col("n")).alias("prefix"))
    met = lambda words, on: words.join(small(asked.select(on).filter(F.col(on).isNotNull()).distinct()), on, "left_semi").distinct()
    hit = lambda words, on: asked.join(small(met(words, on)), on, "left_semi").select("term")
    found = hit(vocab, "term").union(hit(vocab.withColumnRenamed("term", "stem"), "stem")).union(hit(starts, "prefix")).distinct()
    return asked.select("term").join(found.withColumn("known", F.lit(True)), "term", "left").select("term", F.coalesce("known", F.lit(False)).alias("known"))


def coverage(queries: DataFrame, hits: DataFrame, frequency: DataFrame) -> DataFrame:
    """qid, coverage: share of the query's content words, weighed by rarity, that the three best snippets have as they
    are, by stem or by prefix; a fifth of it when a word of five letters or more is unknown to the corpus; 0.5 without
    content words."""
    asked = queries.select("qid", F.explode(F.array_distinct(content("text"))).alias("term"))
    own = frequency.join(small(asked.select("term").distinct()), "term", "left_semi")
    weighed = asked.join(own, "term", "left").withColumn("idf", F.log(1.0 + 1.0 / (1.0 + F.coalesce("cf", F.lit(0)))))
    top = hits.filter("rank <= 3").select("qid", F.explode(tokens("snippet")).alias("w")).groupBy("qid").agg(F.collect_set("w").alias("seen"))
    both = weighed.join(top, "qid", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    stem = F.coalesce(light_stem("term"), F.col("term"))
    met = F.array_contains("seen", F.col("term")) | F.array_contains(with_stems(F.col("seen")), stem) | F.coalesce(F.exists("seen", lambda w: w.startswith(prefix(F.col("term")))), F.lit(False))
    known = known_terms(asked, frequency)
    each = both.withColumn("met", met).join(known, "term")
    out = each.groupBy("qid").agg((F.sum(F.when(F.col("met"), F.col("idf")).otherwise(0.0)) / F.sum("idf")).alias("c"), F.max((F.length("term") >= 5) & ~F.col("known")).alias("strange"))
    return queries.select("qid").join(out, "qid", "left").select("qid", F.coalesce(F.when(F.col("strange"), F.col("c") * 0.2).otherwise(F.col("c")), F.lit(0.5)).alias("coverage"))


def alignment(queries: DataFrame, hits: DataFrame, memory: vectors.Memory) -> DataFrame:
    """qid, sim: the largest cosine of the query's vector and those of the three best snippets."""
    asked = vectors.encode_queries(queries.select("qid", content("text").alias("toks")), memory)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    longer = F.filter(tokens("snippet"), lambda t: F.length(t) > 2)
    chunks = vectors.encode_queries(hits.filter("rank <= 3").select(F.struct("qid", "rank").alias("qid"), longer.alias("toks")), memory)
    both = chunks.select(F.col("qid.qid").alias("qid"), F.col("v").alias("c")).join(small(asked), "qid")
    return both.groupBy("qid").agg(F.max(dot("v", "c") / F.sqrt(dot("v", "v") * dot("c", "c"))).alias("sim"))


def confidence(queries: DataFrame, hits: DataFrame, memory: vectors.Memory) -> DataFrame:
    """qid, confidence of hits (qid, rank, snippet, and a score where there is one); 0 for a query without hits."""
    clip = lambda c, f: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c * f))
    out = coverage(queries, hits, memory.frequency).join(alignment(queries, hits, memory), "qid", "left")
    gap = F.lit(0.0)
    if "score" in hits.columns:
        scores = hits.groupBy("qid").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 3, F.col("score"))), F.lit(0.0))).alias("gap"))
        out, gap = out.join(scores, "qid", "left"), F.coalesce("gap", F.lit(0.0))
    value = 0.5 * F.col("coverage") + 0.4 * clip(F.coalesce("sim", F.lit(0.0)), 3.0) + 0.1 * clip(gap, 5.0)
    has = hits.select("qid").distinct().withColumn("has", F.lit(True))
    return out.join(has, "qid", "left").select("qid", F.when(F.col("has"), value).otherwise(0.0).alias("confidence"))


def lexical_overlap(claim: Column | str, chunk: Column | str) -> Column:
    """Share of the claim's longer words that the chunk has, each counted ln(1 + its length)."""

    @F.arrow_udf("double")
    def share(claim: pa.Array, chunk: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(claim.to_pylist(), chunk.to_pylist(), strict=True):
            own, seen = [t for t in token_list(a or "") if len(t) > 2], set(token_list(b or ""))
            total = sum(math.log1p(len(t)) for t in own)
            out.append(sum(math.log1p(len(t)) for t in own if t in seen) / total if own else 0.0)
        return pa.array(out, pa.float64())

    return share(claim, chunk)


_WORD = re.compile("[a-zA-Z0-9]+|[ऀ-ॿ]+")


def _tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(re.sub(SHORT_PAIR, r"\1-\2 \1\2", text, flags=re.ASCII))]


def _stem(word: str) -> str | None:
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= MIN_STEM), None)


def pair_similarity(claim: str, chunk: str) -> float:
    """Cosine of the vectors of two texts in a word memory that has read just these two."""
    texts = [_tokens(chunk or ""), _tokens(claim or "")]
    frequency, near, seen = Counter(w for t in texts for w in t), {}, Counter()
    for t in texts:
        for i, w in enumerate(t):
            if seen[w] < vectors.OBSERVED:
                seen[w] += 1
                near.setdefault(w, Counter()).update(t[max(0, i - vectors.WINDOW) : i] + t[i + 1 : i + vectors.WINDOW + 1])
    known: dict[str, list[tuple[int, float]]] = {}

    def entries(word: str) -> list[tuple[int, float]]:
        if word not in known:
            context: Counter = Counter()
            for other, n in near.get(word, {}).items():
                for p, s in vector(other, 0, CONTEXT_NNZ):
                    context[p] += s * n
            best = sorted(context.items(), key=lambda e: -abs(e[1]))[: vectors.MAX_CONTEXT]
            size = math.sqrt(sum(v * v for _, v in best))
            known[word] = [(p, float(s)) for p, s in vector(word)] + [(p, v * vectors.CONTEXT_WEIGHT * math.sqrt(NNZ) / size) for p, v in best if size]
        return known[word]

    def encode(words: list[str]) -> Counter:
        out: Counter = Counter()
        for i, w in enumerate(words):
            weight = 1 / (1 + math.log1p(frequency[w]))
            for p, v in entries(w):
                out[p] += v * weight
            if s := _stem(w):
                for p, v in vector(s, STEM_SPACE, STEM_NNZ):
                    out[p] += v * weight * vectors.STEM_WEIGHT
            if i:
                for p, v in vector(words[i - 1] + "\x1f" + w, PAIR_SPACE, PAIR_NNZ):
                    out[p] += vectors.PAIR_WEIGHT * v
        return out

    a, b = (encode([w for w in t if len(w) > 2]) for t in (texts[1], texts[0]))
    size = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return sum(v * b.get(p, 0.0) for p, v in a.items()) / size if size else 0.0


def text_similarity(claim: Column | str, chunk: Column | str) -> Column:
    @F.arrow_udf("double")
    def run(claim: pa.Array, chunk: pa.Array) -> pa.Array:
        return pa.array([pair_similarity(a, b) for a, b in zip(claim.to_pylist(), chunk.to_pylist(), strict=True)], pa.float64())

    return run(claim, chunk)


def cited_sentences(answers: DataFrame) -> DataFrame:
    """aid, n, sentence, cites of answers (aid, answer): sentences with citations that say something."""
    each = answers.select("aid", F.posexplode(sentences("answer")).alias("n", "sentence")).withColumn("cites", citations("sentence"))
    return each.filter((F.size("cites") > 0) & ~citation_only("sentence"))


def verify(answers: DataFrame, hits: DataFrame, threshold: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Sentences (aid, n, sentence, cites, support, supported), and aid, grounded of answers; hits have aid, rank, snippet.

    Citations without a hit support nothing; an answer without cited sentences is grounded."""
    cited = cited_sentences(answers)
    pairs = cited.select("aid", "n", "sentence", F.explode(F.array_distinct("cites")).alias("rank")).join(hits.select("aid", "rank", "snippet"), ["aid", "rank"])
    score = 0.6 * lexical_overlap("sentence", "snippet") + 0.4 * F.greatest(F.lit(0.0), text_similarity("sentence", "snippet"))
    best = pairs.groupBy("aid", "n").agg(F.max(score).alias("support"))
    out = cited.join(best, ["aid", "n"], "left").withColumn("support", F.round(F.coalesce("support", F.lit(0.0)), 3)).withColumn("supported", F.col("support") >= threshold)
    share = out.groupBy("aid").agg(F.avg(F.col("supported").cast("double")).alias("grounded"))
    return out, answers.select("aid").join(share, "aid", "left").select("aid", F.coalesce("grounded", F.lit(1.0)).alias("grounded"))


def badge(grounded: Column) -> Column:
    return F.when(grounded >= 0.8, "OK").when(grounded >= 0.5, "WARN").otherwise("UNGROUNDED")
