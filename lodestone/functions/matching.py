"""How an entity's names relate to a target: symbol paths, tiers, qualifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of files, which are no symbols.
EXTENSIONS = (
    "py", "js", "jsx", "ts", "tsx", "go", "rb", "java", "c", "h", "cpp", "hpp", "cc", "cs", "rs", "php", "swift", "kt",
    "scala", "m", "mm", "sh", "pl", "lua", "json", "yaml", "yml", "toml", "md", "txt", "html", "css", "sql", "cfg", "ini",
)


def symbol_path(q: Column) -> Column:
    """After the last `::`; else, of a path that holds `#` or ends in a dot, after the last slash; else all."""
    return F.when(q.contains("::"), F.substring_index(q, "::", -1)).when(q.contains("/") & (q.contains("#") | q.endswith(".")), F.substring_index(q, "/", -1)).otherwise(q)


def bare(symbol: Column) -> Column:
    """Without one closing mark of a class, method or term."""
    return F.regexp_replace(symbol, r"(#|\(\)\.|\.)$", "")


def segments(q: Column) -> Column:
    """Lower-case parts of a qualified name, whatever separates them."""
    plain = F.regexp_replace(F.replace(q, F.lit("`"), F.lit("")), "::|/|#", ".")
    return F.filter(F.transform(F.split(plain, r"\."), lambda x: F.lower(F.regexp_replace(x, r"\(\)$", ""))), lambda x: x != "")


def at_boundary(text: Column, target: Column) -> Column:
    """Whether the target occurs at the start or after anything but a letter or digit."""
    return F.rlike(text, F.concat(F.lit(r"(?iU)(^|[^\p{L}\p{N}])\Q"), target, F.lit(r"\E")))


def tier(name: Column, qualified_name: Column, target: Column) -> Column:
    """0: name or symbol path is the (lower-case) target, as it is or bare; 1: at a boundary of one of them; 2: buried or only in the path."""
    n, s = F.lower(name), F.lower(symbol_path(qualified_name))
    exact = (n == target) | (s == target) | (bare(n) == target) | (bare(s) == target)
    return F.when(exact, 0).when(at_boundary(name, target) | at_boundary(symbol_path(qualified_name), target), 1).otherwise(2)


def qualifier_tier(qualified_name: Column, qualifier: Column) -> Column:
    """0: all parts of the qualifier are segments of the symbol path; 1: of the whole name; else null."""
    wanted = segments(qualifier)
    inside = lambda q: F.size(F.array_except(wanted, segments(q))) == 0
    return F.when(inside(symbol_path(qualified_name)), 0).when(inside(qualified_name), 1)
