"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as "no answer" and as false; every other text is true.
NO_ANSWER = ["", "null", "empty"]
FALSE_WORDS = ["0", "false", "no", "not"]


def clean_flag(text: Column, default: bool | None = None) -> Column:
    """Free-text flag to boolean. Blanks are not trimmed, so ``' no'`` is true."""
    low = F.lower(text)
    return (
        F.when(low.isNull() | low.isin(NO_ANSWER), F.lit(default).cast("boolean"))
        .when(low.isin(FALSE_WORDS), False)
        .otherwise(True)
    )


def vat_key(vat_id: Column) -> Column:
    """Search form of a VAT id: punctuation removed, lower case."""
    return F.lower(F.regexp_replace(vat_id, r"[,.;/\-+*~]+", ""))


def camel_label(lexlabel: Column) -> Column:
    """``sao.paulo`` to ``SaoPaulo``: dots vanish, every run of letters and digits gets a capital."""
    runs = F.regexp_extract_all(lexlabel, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}.]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def split_uri(uri: Column, prefix: list[str] | None = None) -> Column:
    """Path parts of a request, lower case, outer slashes gone, after an optional prefix.

    Null when the prefix does not match. The prefix itself must be given in lower case.
    """
    parts = F.split(F.trim(F.lower(uri), F.lit("/")), "/")
    if not prefix:
        return parts
    n = len(prefix)
    head = F.slice(parts, 1, n) == F.array(*[F.lit(p) for p in prefix])
    return F.when((F.size(parts) >= n) & head, F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))))
