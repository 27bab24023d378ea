"""Rule-based quality filtering as one Spark projection.

A threshold table names a ratio and the range that it may have; it is compiled into a single native expression over
the word array of each text, so that the scan, the ratios and the verdict run in one stage without a shuffle.

Defined results: a null text counts as no words (so it fails the base rule); an empty text likewise; texts of any
length are judged whole; repeated rows are judged one by one; an empty table gives an empty result. Only the columns
asked for are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespring.llm.common import free_name, let, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it of on or that the this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "als auch auf aus bei das dem den der des die ein eine er es ist im mit nicht sich sie und von zu zum "
    "al como con del el ella es la las lo los más no para pero por que se su sus un una y"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """The least and the greatest value that a ratio may have; None leaves that end open."""

    ratio: str
    least: float | None = None
    most: float | None = None


#: Bounds far from what prose of any language has. Grammar words are the stop words above, or what is said again: prose of
#: other languages repeats its own function words, salad of words doesn't. Where most letters aren't Latin all words count.
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("grammar_words_per_word", 0.03, None),
    Rule("duplicate_lines_per_line", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their three words. Texts without a repeated window, the usual case, need
    only the hash set; the others sort (hash, position) and add up how far each repeated window reaches.
    """

    def of_windows(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            hit = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])),
            )

            def reach(p: Column) -> Column:
                gaps = F.zip_with(
                    F.slice(p, F.lit(1), F.size(p) - 1),
                    F.slice(p, F.lit(2), F.size(p) - 1),
                    lambda a, b: F.least(F.lit(3), b - a),
                )
                return F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)

            return let(F.array_sort(F.transform(hit, lambda x: x["i"])), reach)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(marked, of_sorted))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, of_windows)).cast("long")


def _grammar(c: Column, per_word: Column) -> Column:
    """The share of grammar words; 1 where most letters are of other scripts than Latin."""
    share = F.greatest(c["n_stop_words"], c["n_said_again"]) / per_word
    latin = F.length(F.regexp_replace(c["joined"], r"\P{IsLatin}+", ""))
    others = F.length(F.regexp_replace(c["joined"], r"\P{L}+", "")) - latin
    # Letters are only counted where too few words tell.
    return F.when(share >= 0.03, share).when(others > latin, F.lit(1.0)).otherwise(share)


def _lines(text: Column) -> Column:
    """The \\n-separated lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")


def quality_metrics(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """A struct with the counts, ratios and verdicts of one text."""
    text = F.coalesce(text, F.lit(""))

    def measured(w: Column) -> Column:
        def counted(c: Column) -> Column:
            per_word = F.greatest(c["n_words"], F.lit(1)).cast("double")
            ratios = {
                "mean_word_length": c["word_chars"] / per_word,
                "symbols_per_word": c["n_symbols"] / per_word,
                "grammar_words_per_word": _grammar(c, per_word),
                "duplicate_lines_per_line": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
            }
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            verdict = F.lit(True)
            for rule in rules:
                if rule.least is not None:
                    verdict &= ratios[rule.ratio] >= rule.least
                if rule.most is not None:
                    verdict &= ratios[rule.ratio] <= rule.most
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")
            return F.struct(
                *(c[n].cast("long").alias(n) for n in names),
                failed.alias("base_failed"),
                (~failed & verdict).alias("kept"),
            )

        def of_joined(joined: Column) -> Column:
            return F.struct(
                F.length(joined).alias("chars"),
                (F.length(joined) - F.length(F.regexp_replace(joined, f"[{SYMBOLS}]+", ""))).alias("symbols"),
            )

        def of_lower(lower: Column) -> Column:
            stop = F.size(F.filter(lower, lambda x: x.isin(STOP_WORDS)))
            return F.struct(stop.alias("stop"), (F.size(lower) - F.size(F.array_distinct(lower))).alias("again"))

        def of_lines(lines: Column) -> Column:
            return F.struct(
                F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup")
            )

        return let(
            F.struct(
                F.size(w).alias("n"),
                let(F.array_join(w, ""), of_joined).alias("j"),
                let(_lines(text), of_lines).alias("l"),
                _repeat_words(w).alias("r"),
                let(F.transform(w, F.lower), of_lower).alias("s"),
                F.array_join(w, "").alias("t"),
            ),
            lambda m: let(
                F.struct(
                    m["n"].alias("n_words"),
                    m["j"]["chars"].alias("word_chars"),
                    m["j"]["symbols"].alias("n_symbols"),
                    m["l"]["dup"].alias("n_dup_lines"),
                    m["r"].alias("n_repeat_words"),
                    m["s"]["stop"].alias("n_stop_words"),
                    m["s"]["again"].alias("n_said_again"),
                    m["t"].alias("joined"),
                    m["l"]["n"].alias("n_lines"),
                ),
                counted,
            ),
        )

    return let(words(text), measured)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id with every count and the verdict, one row for each row of ``docs``."""
    return docs.select("doc_id", quality_metrics(docs["text"], rules).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that pass the base rule and every threshold."""
    name = free_name("quality", docs)
    scored = docs.withColumn(name, quality_metrics(docs["text"], rules))
    return scored.where(F.col(name)["kept"]).drop(name)
