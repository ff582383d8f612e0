"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from handful.functions.vectors import let


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slugify(value) -> Column:
    return F.lower(F.translate(_col(value), "/_", "--"))


def fill(template: str, name) -> Column:
    """Put ``name`` where the template has ``{}``."""
    return F.replace(F.lit(template), F.lit("{}"), _col(name).cast("string"))


def nth_occurrence(text, needle, k, overlapping: bool) -> Column:
    """Zero-based char position of the k-th (from 0) match of needle, NULL if there are too few.

    The next search starts one char after the last match (overlapping) or past
    its end (not overlapping).
    """
    text, needle, k = _col(text), _col(needle), _col(k)
    step = F.lit(1) if overlapping else F.length(needle)
    first = F.call_function("locate", needle, text, F.lit(1))
    position = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
        first,
        lambda at, _: F.when(at > 0, F.call_function("locate", needle, text, at + step)).otherwise(F.lit(0)),
    )
    return F.when((F.length(needle) > 0) & (position > 0), position - 1)


# Punctuation removed and articles dropped when answers are compared.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"\b(a|an|the)\b"


def answer_words(answer) -> Column:
    """Lower-case words of an answer, without punctuation and articles."""
    bare = F.translate(F.lower(F.coalesce(_col(answer), F.lit(""))), PUNCTUATION, "")
    plain = F.regexp_replace(bare, "(?U)" + ARTICLES, " ")
    return F.filter(F.split(plain, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def token_f1(prediction, gold) -> Column:
    """F1 of the two bags of answer words; 0 when nothing is shared.

    The words of both sides are sorted together, and one walk pairs those that agree.
    """

    def tagged(words: Column, side: int) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(side).alias("s")))

    def walk(state: Column, e: Column) -> Column:
        # How many predicted words of the current kind are still without a partner.
        spare = F.when(state["w"] == e["w"], state["spare"]).otherwise(F.lit(0))
        paired = (e["s"] == 1) & (spare > 0)
        return F.struct(
            e["w"].alias("w"),
            F.when(e["s"] == 0, spare + 1).when(paired, spare - 1).otherwise(spare).alias("spare"),
            F.when(paired, state["shared"] + 1).otherwise(state["shared"]).alias("shared"),
        )

    def score(words: Column) -> Column:
        both = F.array_sort(F.concat(tagged(words["p"], 0), tagged(words["g"], 1)))
        start = F.struct(F.lit("").alias("w"), F.lit(0).alias("spare"), F.lit(0).alias("shared"))
        shared = F.aggregate(both, start, walk, lambda s: s["shared"])
        total = F.size(words["p"]) + F.size(words["g"])
        return F.coalesce(F.try_divide(F.lit(2.0) * shared, total), F.lit(0.0))

    return let(F.struct(answer_words(prediction).alias("p"), answer_words(gold).alias("g")), score)


def format_score(value) -> Column:
    """Three decimals; blank when missing."""
    number = _col(value).cast("double")
    return F.when(number.isNull(), F.lit("")).otherwise(F.format_string("%.3f", number))


def unique_join(values, limit: int = 30) -> Column:
    """Sorted distinct non-blank values of an array joined by ';', with a count of what is left out."""

    def joined(kept: Column) -> Column:
        head = F.array_join(F.slice(kept, 1, limit), ";")
        rest = F.size(kept) - limit
        return F.when(rest > 0, F.concat(head, F.lit(";...(+"), rest.cast("string"), F.lit(")"))).otherwise(head)

    return let(F.array_sort(F.array_distinct(F.filter(_col(values), lambda v: v.isNotNull() & (v != "")))), joined)
