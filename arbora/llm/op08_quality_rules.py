"""Quality rules by distribution divergence, in Spark expressions only.

A document's character classes and common words are two histograms. Each is
compared with the reference of its language, the pooled histogram of all
documents in that language that pass the plain rules, by the Jensen-Shannon
distance (base 2, 0 to 1; 0 where there is no reference).
Documents under ``min_words`` have too little mass to be judged by distance
and pass that part. Before it stand two plain rules: too few words, and too
many words inside three-word windows that recur in the same text.

Defined results: a null or empty text has no words and fails the word minimum;
a null language is a language of its own; repeated rows are judged alike each
time; an empty table gives an empty result; extra columns are carried along
(columns of the names added here are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import SPACE, quoted, shielded, staged, table

# Frequent function words of the reference languages.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "as", "be",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "ist", "nicht", "ein",
    "de", "la", "que", "el", "en", "los", "se", "del", "las", "por", "con", "su",
    "le", "les", "des", "et", "un", "une", "du", "dans", "qui", "au", "pour", "est",
)
# The class patterns; what none of them matches is a letter or other character.
CLASS_PATTERNS = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "punct": r"[.,;:!?'\"()\-]"}
SYMBOLS = r"[#*$%&|<>]"
#: A broadcast of references is only asked for up to so many languages.
MAX_BROADCAST_LANGS = 4096


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.25
    max_common_distance: float = 0.30


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("_w", F.array_remove(F.split(_text(), SPACE + "+"), ""))


def _histograms(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols and the two histograms of counts."""
    df = _words(df)
    df = (
        df.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(_text(), F.lit(SYMBOLS)).cast("long"))
        .withColumn("_chars", F.length(_text()).cast("long"))
    )
    for name, pattern in CLASS_PATTERNS.items():
        df = df.withColumn(f"_{name}", F.regexp_count(_text(), F.lit(pattern)).cast("long"))
    space = F.col("_chars") - F.col("word_chars")
    known = [F.col(f"_{k}") for k in CLASS_PATTERNS] + [F.col("n_symbols"), space]
    rest = F.col("_chars") - sum(known[1:], known[0])
    df = df.withColumn("_classes", F.array(*known, rest))
    # Two blanks between words keep neighbouring hits from sharing a blank.
    listed = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    df = df.withColumn("_common", F.concat(F.lit(" "), F.array_join(F.expr(f"transform(filter(_w, x -> lower(x) in ({listed})), x -> lower(x))"), "  "), F.lit(" ")))
    hits = [
        ((F.length("_common") - F.length(F.replace(F.col("_common"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("long")
        for w in COMMON_WORDS
    ]
    df = df.withColumn("_hits", F.array(*hits))
    others = F.col("n_words") - F.expr("aggregate(_hits, 0L, (a, x) -> a + x)")
    return df.withColumn("_hits", F.array_append("_hits", others)).drop("_common", *[f"_{k}" for k in CLASS_PATTERNS])


def language_references(histograms: DataFrame) -> DataFrame:
    """(_lang, _ref_classes, _ref_hits): pooled counts of the documents of a language."""
    n_classes, n_hits = len(CLASS_PATTERNS) + 3, len(COMMON_WORDS) + 1
    sums = [F.sum(F.get("_classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)]
    sums += [F.sum(F.get("_hits", F.lit(i))).alias(f"h{i}") for i in range(n_hits)]
    return (
        histograms.groupBy(F.col("lang").alias("_lang")).agg(*sums)
        .select(
            "_lang", F.array(*[f"c{i}" for i in range(n_classes)]).alias("_ref_classes"),
            F.array(*[f"h{i}" for i in range(n_hits)]).alias("_ref_hits"),
        )
    )


def _js_distance(counts: str, ref: str) -> Column:
    """Jensen-Shannon distance of two count arrays; 0 where either has no mass."""
    share = lambda a: f"transform({a}, x -> x / (aggregate({a}, 0D, (s, y) -> s + y)))"
    term = "if(p > 0, p * log2(2 * p / (p + q)), 0D) + if(q > 0, q * log2(2 * q / (p + q)), 0D)"
    parts = f"zip_with({share(counts)}, {share(ref)}, (p, q) -> {term})"
    return F.expr(
        f"if({ref} is null or aggregate({counts}, 0L, (s, y) -> s + y) = 0 or aggregate({ref}, 0L, (s, y) -> s + y) = 0, 0D, "
        f"sqrt(greatest(0D, aggregate({parts}, 0D, (s, t) -> s + t) / 2)))"
    )


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_dup_lines and n_repeat_words."""
    df = df.withColumn("_lines", F.filter(F.split(_text(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Windows of three words as 64-bit hashes; sorting (hash, place) brings recurring windows together.
    df = df.withColumn("_h", F.expr(
        "if(n_words < 4, array(), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))))"
    ))
    df = df.withColumn("_s", F.expr(
        "if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (x, i) -> struct(x as x, i as i))), null)"
    ))
    df = df.withColumn("_p", F.expr(
        "sort_array(filter(transform(_s, (e, k) -> if(e.x = get(_s, k - 1).x or e.x = get(_s, k + 1).x, e.i, null)), x -> x is not null))"
    ))
    # A recurring window adds three words, or fewer where the window before it reaches in.
    df = df.withColumn("n_repeat_words", F.expr(
        "cast(coalesce(if(size(_p) > 0, 3 + aggregate(transform(_p, (x, k) -> if(k = 0, 0, least(3, x - get(_p, k - 1)))), 0, (a, g) -> a + g), 0), 0) as long)"
    ))
    return df.drop("_lines", "_h", "_s", "_p")


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", "base_failed", "kept"]


def _base_failed(rules: QualityRules) -> str:
    return f"(n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)"


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """All columns of ``docs`` with the counts, distances and verdicts named in ``ADDED``.

    Rows and counts are staged, so the texts are read and counted once.
    """
    docs, back = shielded(docs.drop(*ADDED), ("text", "lang"), tuple(ADDED))
    return back(_verdicts(staged(_repeats(_histograms(docs)).drop("_w"), "quality-counts"), rules))


def judge_ids(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(doc_id and the columns in ``ADDED``): as ``judge``, but no text is staged."""
    counts = _repeats(_histograms(docs.select("doc_id", "text", "lang"))).drop("text", "_w")
    return _verdicts(staged(counts, "quality-counts"), rules).select("doc_id", *ADDED)


def _verdicts(df: DataFrame, rules: QualityRules) -> DataFrame:
    refs = staged(language_references(df.where(f"not {_base_failed(rules)}")), "quality-refs")
    if refs.count() <= MAX_BROADCAST_LANGS:
        refs = F.broadcast(refs)
    df = df.join(refs, df["lang"].eqNullSafe(refs["_lang"]), "left")
    df = df.withColumn("class_distance", _js_distance("_classes", "_ref_classes"))
    df = df.withColumn("common_distance", _js_distance("_hits", "_ref_hits"))
    df = df.withColumn("base_failed", F.expr(_base_failed(rules)))
    odd = (F.col("n_words") >= rules.min_words) & (
        (F.col("class_distance") > rules.max_class_distance) | (F.col("common_distance") > rules.max_common_distance)
    )
    return df.withColumn("kept", ~F.col("base_failed") & ~odd)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_ids(table(spark, sf_dir, "documents")).drop("class_distance", "common_distance")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    return judge(docs).where("kept").select(*quoted(docs.columns))
