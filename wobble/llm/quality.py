"""Quality rules: base counts, and divergence from language references. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, words
from .decontaminate import maybe_broadcast

# Frequent function words of English, French, German and Spanish; a parameter of divergence().
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "by",
    "de", "la", "le", "les", "des", "et", "un", "une", "que", "du", "en", "pour",
    "der", "die", "und", "das", "den", "von", "mit", "ist", "nicht", "zu", "ein", "dem",
    "el", "y", "los", "del", "las", "por", "con", "se", "una", "como", "no", "su",
)
#: Character classes, in the order in which they are taken out of a text.
CLASSES = (("lower", "[a-z]+"), ("gap", r"[\x20\x09-\x0D]+"), ("other", r"[^\x00-\x7F]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_counts and common_counts (array<long>).

    Null texts count as empty and give zeros. A window is compared by its words themselves.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_ws", words(text))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.withColumns({"n_words": F.size("_ws").cast("long"), "_joined": F.array_join("_ws", ""), "_lines": lines})
    triples = F.when(F.size("_ws") >= 3, F.transform(F.slice("_ws", 3, F.greatest(F.size("_ws") - 2, F.lit(1))), lambda w, i: F.concat_ws(" ", F.get("_ws", i), F.get("_ws", i + 1), w))).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_triples", triples)
    # triples in order, equal ones side by side; places of those that have a twin
    ranked = F.sort_array(F.transform("_triples", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    d = d.withColumn("_ranked", F.when(F.size(F.array_distinct("_triples")) < F.size("_triples"), ranked))
    twins = F.filter(F.transform("_ranked", lambda r, k: F.when((F.get("_ranked", k - 1)["w"] == r["w"]) | (F.get("_ranked", k + 1)["w"] == r["w"]), r["i"])), lambda i: i.isNotNull())
    d = d.withColumn("_twins", twins)
    covered = F.array_distinct(F.concat("_twins", F.transform("_twins", lambda i: i + 1), F.transform("_twins", lambda i: i + 2)))
    common = F.filter("_ws", lambda w: w.isin(*COMMON_WORDS))
    d = d.withColumns({
        "word_chars": F.length("_joined").cast("long"), "n_symbols": (F.length("_joined") - F.length(F.regexp_replace("_joined", "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"), "_common": common, "_left0": text,
    })
    counts = []
    for k, (_, pattern) in enumerate(CLASSES):
        d = d.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", pattern, ""))
        counts.append((F.length(f"_left{k}") - F.length(f"_left{k + 1}")).cast("long"))
    d = d.withColumn("class_counts", F.array(*counts, F.length(f"_left{len(CLASSES)}").cast("long")))
    each = [F.size("_common") - F.size(F.array_remove("_common", w)) for w in COMMON_WORDS]
    d = d.withColumn("common_counts", F.transform(F.array(*each, F.size("_ws") - F.size("_common")), lambda n: n.cast("long")))
    return d.drop("_ws", "_joined", "_lines", "_triples", "_ranked", "_twins", "_common", *[f"_left{k}" for k in range(len(CLASSES) + 1)])


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms of counts; 0 where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n, m = total(counts), total(reference)
    half = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    # the totals are bound as a lambda's argument: named as columns, they would be summed again for each bin
    terms = lambda t: total(F.zip_with(counts, reference, lambda c, r: half(c / t["n"], r / t["m"]) + half(r / t["m"], c / t["n"])))
    js = F.get(F.transform(F.array(F.struct(n.alias("n"), m.alias("m"))), lambda t: F.when((t["n"] > 0) & (t["m"] > 0), F.sqrt(F.greatest(terms(t) / 2, F.lit(0.0)))).otherwise(0.0)), F.lit(0))
    return js


def quality(docs: DataFrame, class_limit: float = 0.32, common_limit: float = 0.29, least_chars: int = 200, least_words: int = 100, text_out: bool = True) -> DataFrame:
    """docs with the counts of base_counts and base_failed, class_js, common_js, kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. References are the summed
    histograms of all documents of a language that don't fail the base rules. Divergence is judged only above the guards: the classes from
    least_chars characters, the common words (all other words being one bin) from least_words words. kept: neither failed nor divergent.
    Null languages, and those without documents that pass the base rules, are held against the pooled reference. Columns of docs named like those added are replaced.
    With text_out=False, the text isn't carried along.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts", "common_counts", "base_failed", "class_js", "common_js", "kept")
    own = [c for c in docs.columns if c.lower() not in added]
    f = base_counts(docs.select(*own)).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    if not text_out:
        own.remove("text")
        f = f.drop("text")
    f = scratch.keep(f)  # one pass over the texts, for the references and for the verdicts
    kinds = {"class_counts": len(CLASSES) + 1, "common_counts": len(COMMON_WORDS) + 1}
    fit = f.where(~F.col("base_failed"))
    sums = fit.where("lang is not null").groupBy(F.col("lang").alias("_lang")).agg(*[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(k)]).alias(f"{c}_ref") for c, k in kinds.items()])
    refs = scratch.keep(sums)
    pooled = scratch.keep(fit.agg(*[F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) for i in range(k)]).alias(f"{c}_ref") for c, k in kinds.items()]))
    whole = pooled.first()
    # both sides are written, so that Spark can split a hot language where the references are too many to be broadcast
    j = f.join(maybe_broadcast(refs, F.octet_length("_lang") + 8 * sum(kinds.values())), F.col("lang") == F.col("_lang"), "left")
    ref = lambda c: F.coalesce(F.col(f"{c}_ref"), F.array(*[F.lit(int(x)).cast("long") for x in whole[f"{c}_ref"]]))
    j = j.withColumns({"class_js": js_distance(F.col("class_counts"), ref("class_counts")), "common_js": js_distance(F.col("common_counts"), ref("common_counts"))})
    chars = F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    odd = ((chars >= least_chars) & (F.col("class_js") > class_limit)) | ((F.col("n_words") >= least_words) & (F.col("common_js") > common_limit))
    return j.withColumn("kept", ~F.col("base_failed") & ~odd).select(*own, *added)
