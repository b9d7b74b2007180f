"""Column expressions: recodes, keys, safe casts, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions import registry


def col_of(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def fixed(column: Column | str, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(col_of(column), digits) + F.lit(0.0)


def missing_if_not_finite(column: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing value used past the sources."""
    c = col_of(column).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def zero_if_not_finite(column: Column | str) -> Column:
    return F.coalesce(missing_if_not_finite(column), F.lit(0.0))


def recode(column: Column | str, mapping: Mapping[object, object]) -> Column:
    """Replace listed values; unlisted ones pass through."""
    c = col_of(column)
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[c], c)


def lookup(column: Column | str, mapping: Mapping[object, object]) -> Column:
    """Listed value or NULL."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs)[col_of(column)]


def any_label_flag(column: Column | str, none_label: str = "None") -> Column:
    """0 for the 'none' label, 1 for every other value."""
    return F.when(col_of(column) == none_label, 0).otherwise(1)


def session_key(days: Column | str, prefix: str = "d", width: int = 4) -> Column:
    """Zero-padded day key; longer day counts stay whole (a bare lpad would cut them)."""
    text = col_of(days).cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.concat(F.lit(prefix), padded)


def after_first_dash(column: Column | str) -> Column:
    return F.get(F.split(col_of(column), "-"), 1)


def last_part(column: Column | str, separator: str = "-") -> Column:
    return F.element_at(F.split(col_of(column), separator), -1)


def number_or_missing(column: Column | str) -> Column:
    return missing_if_not_finite(col_of(column).try_cast("double"))


def extract_or_missing(column: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col_of(column), pattern, group), F.lit(""))


def namespaced(dataset: Column | str, subject: Column | str) -> Column:
    return F.concat_ws("_", col_of(dataset), col_of(subject).cast("string"))


def seeded_key(seed: int, *columns: Column | str) -> Column:
    """Order key that looks random, depends only on the seed and the ids, and is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col_of(c).cast("string") for c in columns]))


def order_of(column: Column | str, ordered: Sequence[str]) -> Column:
    """Position of a value in an ordered category list; unlisted values sort last."""
    return F.coalesce(lookup(column, {v: i for i, v in enumerate(ordered)}), F.lit(len(ordered)))


def counted_label(name: Column | str, subjects: Column | str, scans: Column | str) -> Column:
    """Three-line cohort label with its counts."""
    return F.format_string("%s\n%5s = %d\n%5s = %d", col_of(name), F.lit("n"), col_of(subjects),
                           F.lit("scans"), col_of(scans))


def display_diagnosis(label: Column | str) -> Column:
    """Diagnosis label as shown in figures."""
    return F.coalesce(lookup(label, registry.DIAGNOSIS_SHOWN), col_of(label))


def display_model(label: Column | str) -> Column:
    """Model label as shown to readers; a trailing star marks the harmonized run."""
    c = col_of(label)
    base = F.regexp_replace(c, r" ?\((original|harmonization)\)$", "")
    shown = F.when(base == "VecCorrRidge", "CorrVec").when(base == "Ridge", "TS Ridge").otherwise(base)
    return F.when(c.endswith("(harmonization)"), F.concat(shown, F.lit("$^{*}$"))).otherwise(shown)
