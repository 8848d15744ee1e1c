"""What a query asks for: intent, subject, fillers; re-scoring by subject, adaptive cut-off, spelling rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .bm25 import small

# Intent patterns in order of precedence, each with its intent; group 1 is the subject.
_SHORT = r"(?:\s+in\s+(?:single|one|few|short)?\s*(?:word|line|sentence)s?)?\s*[?.]?$"
PATTERNS = (
    (r"^(?:please\s+)?define\s+(.+?)" + _SHORT, "define"),
    (r"^(?:please\s+)?what\s+(?:is|are|does)\s+(?:a\s+|an\s+|the\s+)?(.+?)" + _SHORT, "define"),
    (r"^(?:full\s+form|meaning|definition)\s+of\s+(.+?)\s*[?.]?$", "define"),
    (r"^(.+?)\s+(?:ka\s+matlab|matlab|meaning)(?:\s+(?:kya\s+hai|kya\s+hota\s+hai))?\s*[?.]?$", "define"),
    (r"^(.+?)\s+(?:kya\s+hai|kya\s+hota\s+hai|kya\s+matlab\s+hai)\s*[?.]?$", "define"),
    (r"^list(?:\s+all)?\s+(?:the\s+)?(.+?)\s*[?.]?$", "list"),
    (r"^(?:what\s+are\s+(?:the\s+)?(?:all\s+)?|name\s+(?:the\s+|all\s+)?)(.+?)\s*[?.]?$", "list"),
    (r"^how\s+(?:do|does|can|to)\s+(?:i\s+|you\s+|one\s+)?(.+?)\s*[?.]?$", "procedure"),
    (r"^(?:procedure|steps?|process)\s+(?:for|to|of)\s+(.+?)\s*[?.]?$", "procedure"),
    (r"^how\s+(?:many|much|long|often)\s+(.+?)\s*[?.]?$", "quantity"),
    (r"^(?:is|are|can|does|do|will|should|may|must|has|have)\s+(.+?)\s*[?.]?$", "yesno"),
    (r"^(?:tell\s+me|explain|describe|summari[sz]e|brief\s+me)\s+(?:about\s+)?(.+?)\s*[?.]?$", "explain"),
)
# Marks anywhere in a query that no pattern matches.
MARKS = (
    (r"\b(define|meaning|definition|explain|describe|matlab|kya\s+hai|kya\s+hota\s+hai|stand\s+for|full\s+form)\b", "define"),
    (r"\b(list|enumerate|all\s+the|name\s+all)\b", "list"),
    (r"\b(how\s+(to|do|does|can)|procedure|steps?|process)\b", "procedure"),
    (r"\b(tell|brief|about)\b", "explain"),
)
# Fixed words: how an answer should look, small talk, its Hindi counterpart in Latin letters, and stop words.
STYLE = "in single one few short brief long detailed quickly briefly please kindly word words line lines sentence sentences paragraph".split()
TALK = "yo hey hi hello hai hii bro bhai bhaiya bhaiyya didi sir madam ma'am yaar dost dude guys folks please plz pls kindly thanks thank kindly just simply only actually basically really exactly um uh hmm okay ok i me my mine you your we us they them he she it this that know dont don't can't cant could would should will shall may might tell me explain define describe define brief briefly show give about regarding concerning anything something nothing somebody anybody quick quickly fast slow slowly clearly properly thoroughly help me out here there now then today briefly what's whats whatis what's wassup wsup sup".split()
HINDI = "kya hai hota hai matlab ka ke ki ko se me main mein bata batao batayiye samjhao samjha samjhe samjhna samajh nahi aaya aaya nahi chahiye chahta jaanna jaana jaan kar karo karta karte karna ham hum hamko mujhe mujhko apko aapko apna apni aap tum tumko aur kuch sab thoda thodi zyada bahut bilkul accha theek matlab hota hai hain hai bhai bhaiya".split()
STOP = "a an the of to in on at by for and or but with from into about as is are was were be been being it its this that these those i you he she they we my your his her their our what which who whom whose when where why how do does did have has had can could should would may might must".split()
FILLERS = sorted({*STYLE, *TALK, *HINDI, *STOP})

SUBJECT_WEIGHT, MAX_KEEP, DROP = 3.0, 12, 0.4


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def acronyms(query: Column) -> Column:
    """Hyphenated and plain capitals, and spaced single letters joined, in this order."""
    pairs = F.regexp_extract_all(query, F.lit(r"(\b[A-Z][A-Z0-9]{1,5}-[A-Z][A-Z0-9]{1,5}\b)"), F.lit(1))
    plain = F.regexp_extract_all(query, F.lit(r"(\b[A-Z][A-Z0-9]{1,7}\b)"), F.lit(1))
    spaced = F.regexp_extract_all(query, F.lit(r"(\b(?:[a-zA-Z]\s+){2,}[a-zA-Z]\b)"), F.lit(1))
    return F.concat(pairs, plain, F.transform(spaced, lambda s: F.upper(F.regexp_replace(s, r"\s+", ""))))


def without_fillers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\b[A-Za-z0-9'\-]+\b)"), F.lit(1))
    return F.array_join(F.filter(found, lambda w: ~F.array_contains(_strings(FILLERS), F.lower(w))), " ")


def intent(query: Column) -> Column:
    q, out = F.trim(query), F.lit("general")
    for pattern, name in reversed(MARKS):
        out = F.when(F.lower(q).rlike(pattern), name).otherwise(out)
    for pattern, name in reversed(PATTERNS):
        out = F.when(q.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def decompose(queries: DataFrame) -> DataFrame:
    """queries (qid, text) with intent, subject, fillers, has_intent_marker, has_acronym."""
    q = F.trim("text")
    captured = F.lit(None).cast("string")
    for pattern, _ in reversed(PATTERNS):
        captured = F.when(q.rlike("(?i)" + pattern), F.regexp_extract(q, "(?i)" + pattern, 1)).otherwise(captured)
    out = queries.withColumn("acro", acronyms(q)).withColumn("captured", F.regexp_replace(F.trim(captured), r"[,.?!]+$", "")).withColumn("intent", intent(F.col("text")))
    bare = without_fillers(F.coalesce("captured", q))
    plain = F.when((bare != "") & (F.col("captured").isNotNull() | (F.size(F.split(bare, " ")) <= 6)), bare).otherwise(F.coalesce("captured", q))
    out = out.withColumn("subject", F.when(F.size("acro") > 0, F.array_join(F.slice("acro", 1, 2), " ")).otherwise(plain))
    own = F.transform(F.regexp_extract_all("subject", F.lit(r"(\b\w+\b)"), F.lit(1)), F.lower)
    left = F.array_except(tokens("text"), own)
    fillers = F.array_sort(F.filter(F.array_distinct(left), lambda t: F.array_contains(_strings(FILLERS), t) | (F.col("intent") != "general")))
    return out.select("qid", "text", "intent", "subject", fillers.alias("fillers"), (F.col("intent") != "general").alias("has_intent_marker"), (F.size("acro") > 0).alias("has_acronym"))


def subject_terms(parsed: DataFrame, weight: float = SUBJECT_WEIGHT) -> DataFrame:
    """qid, term, weight: weight for each time the subject has the term, 1 for each other content word of the query."""
    stop = _strings(STOP)
    own = parsed.select("qid", "text", "fillers", F.explode_outer(F.filter(tokens("subject"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))).alias("term"))
    subject = own.filter("term is not null").groupBy("qid", "term").agg((F.count(F.lit(1)) * weight).alias("weight"))
    rest = parsed.select("qid", F.explode(F.filter(F.array_except(tokens("text"), F.col("fillers")), lambda t: ~F.array_contains(_strings([*STOP, *STYLE]), t))).alias("term"))
    each = parsed.select("qid", F.explode(tokens("text")).alias("term")).join(rest, ["qid", "term"], "left_semi").join(subject, ["qid", "term"], "left_anti")
    return subject.unionByName(each.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def rescore(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """hits (qid, rank, doc_id, snippet) with adj_score, the sum of weight * ln(1 + tf), and adj_rank; ties keep rank."""
    tf = hits.select("qid", "rank", F.explode(tokens(F.lower("snippet"))).alias("term")).join(small(terms), ["qid", "term"]).groupBy("qid", "rank", "term", "weight").count()
    gain = tf.groupBy("qid", "rank").agg(F.round(F.sum(F.col("weight") * F.log1p(F.col("count").cast("double"))), 9).alias("adj_score"))
    w = Window.partitionBy("qid").orderBy(F.col("adj_score").desc(), "rank")
    return hits.join(gain, ["qid", "rank"], "left").withColumn("adj_score", F.coalesce("adj_score", F.lit(0.0))).withColumn("adj_rank", F.row_number().over(w))


def adaptive_cutoff(hits: DataFrame, score: str = "adj_score", rank: str = "adj_rank", max_keep: int = MAX_KEEP, drop: float = DROP) -> DataFrame:
    """Hits before the first cliff: a score under (1 - drop) of the one before, or under drop of the best."""
    w = Window.partitionBy("qid").orderBy(rank)
    solid = lambda c: F.when(c == 0, 1e-9).otherwise(c)
    cur = F.col(score)
    cliff = (cur < solid(F.lag(score).over(w)) * (1.0 - drop)) | (cur < solid(F.first(score).over(w)) * drop)
    marked = hits.withColumn("stop", F.when((F.col(rank) > 1) & (cliff | (F.col(rank) > max_keep)), 1).otherwise(0))
    return marked.withColumn("stopped", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("stopped = 0").drop("stop", "stopped")


def corrections(asked: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """term, fixed, distance: the closest word of vocabulary (term) for each asked term of three letters or more.

    An equi-join on length (each asked term goes to the lengths within ``most``) keeps the comparison to words of
    near lengths; ties go to the shorter word, then to the first in order."""
    q = asked.select(F.lower("term").alias("asked")).distinct().filter(F.length("asked") >= 3)
    q = q.withColumn("len", F.explode(F.sequence(F.length("asked") - most, F.length("asked") + most)))
    v = vocabulary.select(F.col("term").alias("word"), F.length("term").alias("len")).distinct()
    near = v.join(small(q), "len").withColumn("d", F.levenshtein("asked", F.lower("word"), most)).filter("d >= 0")
    best = near.groupBy("asked").agg(F.min(F.struct("d", "len", "word")).alias("b"))
    return best.select(F.col("asked").alias("term"), F.col("b.word").alias("fixed"), F.col("b.d").alias("distance"))


def subject_coverage(parsed: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, coverage: share of subject terms that equal, or stand inside, a word of the hits' snippets; 1 without terms."""
    stop = _strings(STOP)
    subject = parsed.select("qid", F.filter(tokens("subject"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)).alias("terms"))
    seen = hits.select("qid", F.explode(tokens(F.lower("snippet"))).alias("w")).distinct().groupBy("qid").agg(F.collect_set("w").alias("seen"))
    both = subject.join(seen, "qid", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    met = F.size(F.filter("terms", lambda t: F.exists("seen", lambda w: F.contains(w, t))))
    return both.select("qid", F.when(F.size("terms") == 0, 1.0).otherwise(met / F.size("terms")).alias("coverage"))


