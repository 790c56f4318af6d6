"""What a file's text and name say about it, and what a question says about time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and signatures of generated files, and limits of what counts as written by hand.
GENERATED_NAMES = (".min.js", ".min.css", ".bundle.js", ".map")
GENERATED_HEADER = r"(?im)^(?:\s*(?://|#|/\*+|\*)\s*)?(?:<auto-generated>|code generated by\b|@generated\b)"
LICENSE_BANNER = r"(?im)^\s*/\*![^\n]*for license information please see[^\n]*$"
BUNDLED = r"(?i)sourceMappingURL=|webpackJsonp"
LONGEST, FEWEST_BLANKS, AVERAGE, SYMBOLS = 500, 0.05, 200, 1.5
# Phrases, the days of their unit (the number before them counts, if there is one), and the tolerance in days.
PHRASES = (
    (r"(\d+)\s+days?\s+ago", 1, 2),
    (r"a\s+couple\s+(?:of\s+)?days?\s+ago", 2, 2),
    (r"yesterday", 1, 1),
    (r"a\s+week\s+ago", 7, 3),
    (r"(\d+)\s+weeks?\s+ago", 7, 5),
    (r"last\s+week", 7, 3),
    (r"a\s+month\s+ago", 30, 7),
    (r"(\d+)\s+months?\s+ago", 30, 10),
    (r"last\s+month", 30, 7),
    (r"last\s+year", 365, 30),
    (r"a\s+year\s+ago", 365, 30),
    (r"recently", 14, 14),
)


def file_rejection(text: Column, path: Column) -> Column:
    """Why a file looks generated, minified or dense; null if it doesn't, or for a null text. The first reason counts.

    JSON files are not judged by their blanks, lines and symbols.
    """
    name, lines = F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    size = F.length(text)
    sizes = F.transform(lines, F.length)
    head = F.array_join(F.slice(lines, 1, 3), "\n")
    ends = F.when(size > 2000, F.concat(F.substring(text, 1, 1000), F.substring(text, -1000, 1000))).otherwise(text)
    blanks = size - F.length(F.regexp_replace(text, r"(?U)\s", ""))
    alphanumeric = size - F.length(F.regexp_replace(text, r"[\p{L}\p{N}]", ""))
    symbols = size - blanks - alphanumeric
    prose = ~name.endswith(".json")
    return (
        F.when(F.array_max(sizes) > LONGEST, "long_line")
        .when(name.rlike("(" + "|".join(n.replace(".", r"\.") for n in GENERATED_NAMES) + ")$"), "minified_name")
        .when(head.rlike(GENERATED_HEADER), "generated_header")
        .when(head.rlike(LICENSE_BANNER), "license_banner")
        .when(ends.rlike(BUNDLED), "bundled")
        .when(prose & (size > 0) & (blanks < FEWEST_BLANKS * size), "few_blanks")
        .when(prose & (F.aggregate(sizes, F.lit(0), lambda a, n: a + n) > AVERAGE * F.size(lines)), "long_average")
        .when(prose & (symbols > SYMBOLS * alphanumeric), "many_symbols")
    )


def relative_time(question: Column) -> Column:
    """Struct (days, tolerance) of the first phrase, in the order listed, that the question has; null without one."""
    low = F.lower(question)

    def found(pattern: str, days: int, tolerance: int) -> Column:
        n = F.regexp_extract(low, pattern, 1).cast("int") if "(\\d" in pattern else F.lit(1)
        return F.when(low.rlike(pattern), F.struct((n * days).alias("days"), F.lit(tolerance).alias("tolerance")))

    return F.coalesce(*(found(*p) for p in PHRASES))


def temporal_distance(distance: Column, asked: Column, said: Column, when: Column, most: float = 0.4) -> Column:
    """``distance`` less up to ``most`` of it: in full where ``said`` is within the tolerance of the day asked for, then
    falling to nothing at three times that. ``when`` is what ``relative_time`` gives."""
    off = F.abs(F.datediff(F.date_sub(asked, when["days"]), said))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (3 * when["tolerance"] - off) / (2 * when["tolerance"])))
    # Least and greatest skip nulls: without a phrase or a day nothing is taken off.
    return distance * (1 - most * F.when(off.isNotNull(), share).otherwise(0.0))


def timings(seconds: str) -> list[Column]:
    """Count, extremes, mean, median and sample deviation (0 for a single one) of a column."""
    return [
        F.count(seconds).alias("n"),
        F.min(seconds).alias("min"),
        F.max(seconds).alias("max"),
        F.avg(seconds).alias("mean"),
        F.median(seconds).alias("median"),
        F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("stdev"),
    ]
