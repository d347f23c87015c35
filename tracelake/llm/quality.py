"""Line-first cleaning; DataFrame functions only.

Each line of a text is judged on its own: a line is removed if it is navigation (several separators,
or a list entry, that doesn't end as a sentence does), boilerplate (fewer than PHRASE_LINE words with a phrase of
the lists below, one for each of four languages; in a longer line such a phrase is prose), or fewer than
SHORT_LINE words that don't end as a sentence does.  A document that loses too large a share of its word characters is rejected.  A few
counts of the whole text reject a document before that.

Cases: a null text has no words and no lines, so it fails the base rules; so does an empty one; very
long texts are judged whole; null and repeated doc_ids are judged row by row; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import SPACE, WORD

SYMBOLS = r"[#*$%&|<>]"
# Phrases of boilerplate, in lower case.
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "javascript",
    "lorem ipsum", "subscribe to our", "click here", "copyright",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "newsletter abonnieren",
    "politique de confidentialité", "conditions d.utilisation", "tous droits réservés", "cliquez ici", "mentions légales",
    "política de privacidad", "condiciones de uso", "todos los derechos reservados", "haga clic", "aviso legal",
)
NAVIGATION = r"(\|.*\||»|›|^\s*[-*•]\s)"
SENTENCE_END = r"[.!?:;\x{2026}\"'\x{201D}\x{00BB})][\x20\x09-\x0D]*$"
SHORT_LINE = 5
PHRASE_LINE = 15
LEAST_WORDS = 50
MOST_REPEATED = 50
LEAST_KEPT = 50


def _removed(line: Column) -> Column:
    """Whether a line goes."""
    open_end, words = ~line.rlike(SENTENCE_END), F.regexp_count(line, F.lit(WORD))
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE)) & (words < PHRASE_LINE)
    return (open_end & (line.rlike(NAVIGATION) | (words < SHORT_LINE))) | boilerplate


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and clean_text: the lines that stay."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("words", F.array_remove(F.split("t", SPACE + "+"), "")).withColumn("lines", F.split("t", "\n"))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("t", F.lit(SYMBOLS)).cast("long"))
    d = d.withColumn("full", F.expr(f"filter(lines, x -> x rlike r'{WORD}')"))
    d = d.withColumn("n_dup_lines", (F.size("full") - F.size(F.array_distinct("full"))).cast("long"))
    tri = "slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, cast(greatest(n_words - 2, 0) as int))"
    d = d.withColumn("tri", F.expr(tri))
    again = (
        "transform(array(array_sort(transform(tri, (x, i) -> named_struct('x', x, 'i', i)))), s -> "
        "size(array_distinct(flatten(transform(filter(s, (e, j) -> "
        "(j > 0 and s[greatest(j - 1, 0)].x = e.x) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].x = e.x)), "
        "e -> array(e.i, e.i + 1, e.i + 2))))))[0]"
    )
    d = d.withColumn("n_repeat_words", F.expr(f"if(size(array_distinct(tri)) = size(tri), 0, {again})").cast("long"))
    d = d.withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )
    d = d.withColumn("stay", F.filter("full", lambda x: ~_removed(x)))
    kept = F.expr(rf"aggregate(stay, 0L, (a, x) -> a + length(regexp_replace(x, r'{SPACE}+', '')))")
    d = d.withColumn("kept_chars", F.when(F.size("stay") == F.size("full"), F.col("word_chars")).otherwise(kept))
    d = d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= LEAST_KEPT * F.col("word_chars")))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "kept_chars", F.array_join("stay", "\n").alias("clean_text"),
    )
