"""Row-local allele encodings on arrays; no shuffle, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the codes of the alleles
ALLELES = ("A", "T", "C", "G", "-")
SYMBOLS = "".join(ALLELES)


def encode_alleles(alleles: Column) -> Column:
    """A T C G - as 0..4; any other symbol fails with its name."""
    return F.transform(alleles, lambda a: F.when(F.length(a) != 1, F.raise_error(F.concat(F.lit("not one symbol: "), a))).when(F.instr(F.lit(SYMBOLS), a) > 0, F.instr(F.lit(SYMBOLS), a) - 1).otherwise(F.raise_error(F.concat(F.lit("unknown allele: "), F.coalesce(a, F.lit("null"))))).cast("tinyint"))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def major_allele(alleles: Column) -> Column:
    """The most frequent symbol, whatever the symbols are; on a tie the one that occurs first. The gap competes like any other."""
    def most(a: Column) -> Column:
        seen = F.transform(F.array_distinct(a), lambda s: F.struct(F.size(F.filter(a, lambda x: x == s)).alias("n"), (-F.array_position(a, s)).alias("at"), s.alias("s")))
        return F.array_max(seen)["s"]

    return _bind(alleles, most)


def major_indicator(alleles: Column) -> Column:
    """1 where the major allele stands."""
    def mark(a: Column) -> Column:
        return _bind(major_allele(a), lambda m: F.transform(a, lambda x: (x == m).cast("tinyint")))

    return _bind(alleles, mark)


def one_symbol_each(alleles: Column) -> Column:
    """The alleles, or an error where one of them is missing or isn't one character."""
    bad = F.exists(alleles, lambda a: F.coalesce(F.length(a) != 1, F.lit(True)))
    return F.when(bad, F.raise_error(F.concat(F.lit("alleles that aren't one symbol: "), F.substring(F.to_json(alleles), 1, 80)))).otherwise(alleles)


def numeric_codes(values: Column) -> Column:
    """Numbers from 0 to 255 as codes; others, also null and NaN, are an error."""
    return F.transform(values, lambda v: F.when((v >= 0) & (v <= 255) & (v == F.floor(v)), v.cast("smallint")).otherwise(F.raise_error(F.concat(F.lit("not a code from 0 to 255: "), F.coalesce(v.cast("string"), F.lit("null"))))))


def is_binary(x: Column) -> Column:
    return F.forall(x, lambda v: v.isin(0, 1))


def ones(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v)


def weighted_ones(x: Column, w: Column) -> Column:
    """Sum of weights where x is 1; x and w are arrays in sample order."""
    return F.aggregate(F.zip_with(x, w, lambda v, u: v * u), F.lit(0.0), lambda a, v: a + v)


def keep_samples(x: Column, mask: Column, state: int) -> Column:
    """Entries of x at samples where the background's row has this state."""
    return F.filter(F.zip_with(x, mask, lambda v, m: F.when(m == state, v)), lambda v: v.isNotNull())
