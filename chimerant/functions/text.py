"""Column expressions over text, sequences and set-valued cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chimerant.config import MISSING, NULL_TOKENS


def nulls(c: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    return F.when(~c.isin(tokens), c)


def present(c: Column) -> Column:
    """Neither null nor the placeholder nor empty."""
    return c.isNotNull() & (c != MISSING) & (F.length(c) > 0)


def or_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))


def unversioned(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def residues(c: Column) -> Column:
    """A peptide with stops as X and quotes as the placeholder."""
    return F.translate(c, '*"', f"X{MISSING}")


def prefix(c: Column, i: Column) -> Column:
    """Elements 0..i."""
    return F.substring(c, F.lit(1), (i + 1).cast("int"))


def suffix(c: Column, i: Column) -> Column:
    """Elements from i + 1 on."""
    return F.substring(c, (i + 2).cast("int"), F.length(c))


def codon(x: Column) -> Column:
    """Floor division by three, for any sign."""
    return F.floor(x / 3)


def tokens(c: Column, separator: str = r"[|,]") -> Column:
    """Trimmed parts of a cell, without placeholders, first occurrence of each."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != MISSING)))


def accessions(c: Column) -> Column:
    return F.filter(tokens(c), lambda x: x.rlike(r"^IPR\d{6}$"))


def joined(a: Column, separator: str = "|", sort: bool = True) -> Column:
    """The cell of an array; the placeholder if it is empty."""
    return F.when(F.size(a) > 0, F.array_join(F.sort_array(a) if sort else a, separator)).otherwise(MISSING)


def canonical(c: Column) -> Column:
    """A cell with one separator; empty for a missing one."""
    return F.when(present(F.trim(c)), F.array_join(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != ""), " | ")).otherwise("")


def count_tokens(c: Column) -> Column:
    return F.when(present(F.trim(c)), F.size(F.filter(F.split(c, r"\|"), lambda x: F.trim(x) != ""))).otherwise(0)


def side_tokens(cells: dict[str, Column], parity: bool = True) -> Column:
    """Tokens `side:domains` of an event: the whole cell as one token, or one token per domain without parity."""
    found = []
    for side, c in cells.items():
        clean = canonical(c)
        if parity:
            found.append(F.when(clean != "", F.array(F.concat(F.lit(f"{side}:"), F.replace(clean, F.lit(" "), F.lit("_"))))).otherwise(F.array().cast("array<string>")))
        else:
            found.append(F.transform(F.filter(F.split(clean, r" \| "), lambda x: x != ""), _tagged(side)))
    return F.concat(*found)


def _tagged(side: str):
    return lambda x: F.concat(F.lit(f"{side}:"), F.replace(x, F.lit(" "), F.lit("_")))


def symbol(c: Column) -> Column:
    """A gene symbol without spaces, in upper case."""
    return F.upper(F.replace(F.trim(c), F.lit(" "), F.lit("")))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def sliding(c: Column, size: int, step: int, longer_than: int) -> Column:
    """Windows of a sequence that is longer than a cut; else the sequence alone."""
    last = F.ceil((F.length(c) - size) / F.lit(step)).cast("int")
    return F.when(F.length(c) > longer_than, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array(c))


def context(c: Column, start: Column, end: Column, left: int, right: int) -> tuple[Column, Column, Column]:
    """1-based bounds of start..end with context inside the sequence, and the slice."""
    low, high = F.greatest(F.lit(1), start - left).cast("int"), F.least(F.length(c), end + right).cast("int")
    return low, high, F.substring(c, low, high - low + 1)


def any_pattern(c: Column, patterns: list[str]) -> Column:
    """Whether any of several regular expressions is found: one alternation, one pass."""
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / F.nullif(b.cast("double"), F.lit(0.0))).otherwise(0.0)
