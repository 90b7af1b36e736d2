"""Quality rules: simple counts, and divergence from a language's reference, with DataFrame operations only.

Every text gives two histograms: of character classes, and of its language's most common words. The references are
the same histograms summed over all documents of the language, so they cover the whole table. A document fails where the
Jensen-Shannon distance (base 2, 0 to 1) of either histogram from its reference exceeds a limit; texts under
``CLASS_CHARS`` characters or ``WORD_WORDS`` words aren't held to it, as short ones vary by chance. A document
also fails with fewer than ``LEAST_WORDS`` words, or when over half of its words repeat in three-word windows.

Languages without a word list share one reference of character classes and aren't held to the words'. Null and
empty texts have no words and fail. Repeated ids stay separate rows, an empty table gives none, other columns
are not read. The references are at most five rows.

Per-document figures are written to the shared folder once, and both the references and the verdicts
are made from them. Arrays used more than once are bound by a one-element ``transform``, which the optimizer
can't copy into inner expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

LEAST_WORDS = 50
CLASS_CHARS, WORD_WORDS = 200, 80
CLASS_LIMIT, WORD_LIMIT = 0.27, 0.30
# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are at from or have an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se elle avec".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er aus bei".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus".split(),
}
N_COMMON = 25
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more. ``words`` is bound already.

    Window hashes, cut to make room for their place, are sorted as plain numbers; places with an equal neighbour
    are the only ones whose full hashes are compared.
    """
    n = F.size(words)
    mask = F.when(n < 1 << 20, F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")

    def from_hashes(hashes: Column) -> Column:
        def from_packed(packed: Column) -> Column:
            head = lambda x: x.bitwiseAND(F.bitwise_not(mask))
            like = lambda x, i: (head(x) == head(F.get(packed, i - 1))) | (head(x) == head(F.get(packed, i + 1)))
            maybe = F.transform(F.filter(packed, lambda x, i: F.coalesce(like(x, i), F.lit(False))), lambda x: x.bitwiseAND(mask).cast("int"))

            def from_pairs(pairs: Column) -> Column:
                same = lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"])
                at = F.transform(F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"])
                return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

            pair = lambda p: F.struct(F.get(hashes, p).alias("h"), p.alias("p"))
            return let(maybe, lambda m: F.when(F.size(m) == 0, 0).otherwise(let(F.sort_array(F.transform(m, pair)), from_pairs)))

        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        return let(packed, from_packed)

    triples = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, 0).otherwise(let(triples, from_hashes))


def figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang (with a word list, or null), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.when(F.col(lang_col).isin(list(COMMON)), F.col(lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), text.alias("t"))
    # each class is cut out of what the classes before it left, so only the first two cuts go over the whole text
    texts = [F.col("t")]
    for cut in (SPACE, "[a-z]+", "[A-Z]+", "[0-9]+", r"[^\x00-\x7F]+", "[#*$%&|<>]+"):
        texts.append(F.regexp_replace(texts[-1], cut, ""))
    size, wordy, *left = [F.char_length(t).cast("long") for t in texts]
    lower, upper, digit, high, symbols = [a - b for a, b in zip([wordy, *left], left)]
    lists = F.coalesce(*[F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()], F.array().cast("array<string>"))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        common = let(F.filter(words, lambda w: F.char_length(w) <= 5), lambda short: F.transform(lists, lambda c: (F.size(short) - F.size(F.array_remove(short, c))).cast("long")))
        return F.struct(n.cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"), common.alias("common"))

    words = let(F.array_remove(F.split("t", SPACE), ""), of_words)
    lines = let(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    rows = rows.select("doc_id", "lang", size.alias("chars"), wordy.alias("word_chars"), upper.alias("up"), lower.alias("low"), digit.alias("dig"), high.alias("high"), symbols.alias("n_symbols"), left[-1].alias("rest"), lines.alias("n_dup_lines"), words.alias("w"))
    classes = F.array("up", "low", "dig", "high", "n_symbols", "rest", F.col("chars") - F.col("word_chars"))
    return rows.select("doc_id", "lang", "chars", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").alias("n_repeat_words"), classes.alias("classes"), F.col("w.common").alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    both = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(both / 2, F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    """Counts and what is left of the total, as shares."""
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.concat(counts, F.array(rest)), lambda x: x.cast("double") / F.greatest(total, F.lit(1)))


def judge(docs: DataFrame, *, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, class_chars: int = CLASS_CHARS, word_words: int = WORD_WORDS, least_words: int = LEAST_WORDS, **cols) -> DataFrame:
    """Figures, class_distance, word_distance, base_failed and kept for each row of ``docs``."""
    rows = stash(figures(docs, **cols), "quality-figures")
    key = F.coalesce("lang", F.lit("*"))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(7)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON)]
    ref = rows.groupBy(key.alias("ref")).agg(F.sum("chars").alias("ref_chars"), F.sum("n_words").alias("ref_words"), *sums)
    ref = ref.select("ref", _shares(F.array(*[f"c{i}" for i in range(7)]), F.col("ref_chars")).alias("ref_classes"), _shares(F.array(*[f"w{i}" for i in range(N_COMMON)]), F.col("ref_words")).alias("ref_common"))
    # one row for each word list and one more: five at most
    out = rows.join(F.broadcast(ref), key == F.col("ref"))
    by_class = F.when(F.col("chars") >= class_chars, distance(_shares(F.col("classes"), F.col("chars")), F.col("ref_classes")))
    by_word = F.when((F.col("n_words") >= word_words) & F.col("lang").isNotNull(), distance(_shares(F.col("common"), F.col("n_words")), F.col("ref_common")))
    out = out.select(*rows.columns, by_class.alias("class_distance"), by_word.alias("word_distance"))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return out.withColumns({"base_failed": base, "kept": ~base & near})
