"""Comparing texts as multisets of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import strip_space

TOKEN = r"[\p{L}\p{Nd}_]+|(?U:\S)"


def strip_comments(source: Column) -> Column:
    """The trimmed lines left when comments and blank lines go. Per line: the first // outside quotes cuts it, then one
    block comment is removed; an open block swallows lines up to its end."""

    def step(s: Column, raw: Column) -> Column:
        rest = F.when(s["open"], F.when(F.contains(raw, F.lit("*/")), F.regexp_replace(raw, r"^[\s\S]*?\*/", "")).otherwise(F.lit(""))).otherwise(raw)
        still = s["open"] & ~F.contains(raw, F.lit("*/"))
        before = F.substring_index(rest, "//", 1)
        quotes = F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))
        line = F.when(F.contains(rest, F.lit("//")) & (quotes % 2 == 0), before).otherwise(rest)
        closed = line.rlike(r"/\*[\s\S]*?\*/")
        opens = ~closed & F.contains(line, F.lit("/*"))
        # regexp_replace would take every block comment of the line, the fold takes the first only
        first = F.concat(F.substring_index(line, "/*", 1), F.regexp_replace(line, r"^[\s\S]*?/\*[\s\S]*?\*/", ""))
        text = strip_space(F.when(closed, first).when(opens, F.substring_index(line, "/*", 1)).otherwise(line))
        return F.struct((still | opens).alias("open"), F.when(text == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(text))).alias("lines"))

    return F.aggregate(F.split(source, "\n"), F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("lines")), step, lambda s: s["lines"])


def stripped(source: Column) -> Column:
    """The text that is compared. Without a comment's mark its tokens are those of the source, so the fold is left out."""
    marked = F.contains(source, F.lit("//")) | F.contains(source, F.lit("/*"))
    return F.when(marked, F.array_join(strip_comments(source), "\n")).otherwise(source)


def tokens(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0))


def token_counts(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    return df.select(*keys, F.explode(tokens(text)).alias("tok")).groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("n"))


def compare(pairs: DataFrame, key: str = "pair_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``carry``, golden_tokens, output_tokens, precision, recall, f1) of pairs (key, golden, output), both without
    their comments; 0 where empty. The pairs are dealt by key once, and both counts stay where they are."""
    one = lambda side, g, o: F.transform(tokens(stripped(F.coalesce(side, F.lit("")))), lambda t: F.struct(t.alias("tok"), F.lit(g).alias("g"), F.lit(o).alias("o")))
    both = F.concat(one(F.col("golden"), 1, 0), one(F.col("output"), 0, 1))
    each = pairs.repartition(key).select(key, *carry, F.explode_outer(both).alias("t")).select(key, *carry, F.col("t.tok").alias("tok"), F.coalesce("t.g", F.lit(0)).alias("g"), F.coalesce("t.o", F.lit(0)).alias("o"))
    counted = each.groupBy(key, *carry, "tok").agg(F.sum("g").alias("g"), F.sum("o").alias("o"))
    scored = counted.groupBy(key, *carry).agg(F.sum("g").alias("golden_tokens"), F.sum("o").alias("output_tokens"), F.sum(F.least("g", "o")).alias("matched"))
    p, r = (F.when(F.col(c) > 0, F.col("matched") / F.col(c)).otherwise(0.0) for c in ("output_tokens", "golden_tokens"))
    return scored.select(key, *carry, "golden_tokens", "output_tokens", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
