"""Label normalisation and naming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell import constants as K


def lookup(table: Mapping) -> Column:
    """A small fixed table as a map literal."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*entries)


def integer_label(raw: Column, labels: Sequence[int] = K.GRADES) -> Column:
    """The label as an integer of the allowed set, else NULL. Fractions are cut off: 2.7 is 2."""
    number = raw.try_cast("double")
    whole = F.when(~F.isnan(number), F.when(F.abs(number) < 2**31, number)).cast("int")
    return F.when(whole.isin(*labels), whole)


def normalise_text(raw: Column) -> Column:
    """Trimmed, lower case, separators as underscores, one pass that halves double underscores."""
    return F.replace(F.translate(F.lower(F.trim(raw)), "-/ ", "___"), F.lit("__"), F.lit("_"))


def text_label(raw: Column, synonyms: Mapping[str, int] = K.LABEL_SYNONYMS, labels: Sequence[int] = K.GRADES) -> Column:
    """Label from a known name, else from an integer written as text, else NULL."""
    number = F.trim(raw).try_cast("int")
    return F.coalesce(F.try_element_at(lookup(synonyms), normalise_text(raw)), F.when(number.isin(*labels), number))


def grade_name(grade: Column, names: Mapping[int, str] = K.GRADE_NAMES) -> Column:
    return F.when(grade.isNotNull(), F.try_element_at(lookup(names), grade))


def binary_label(grade: Column, min_grade: int = K.POSITIVE_MIN_GRADE, labels: Sequence[int] = K.GRADES) -> Column:
    """1 from the cut upwards; a grade outside the domain raises."""
    checked = F.when(grade.isNull() | grade.isin(*labels), grade).otherwise(
        F.raise_error(F.concat(F.lit("label outside the domain: "), grade.cast("string"))))
    return (checked >= min_grade).cast("int")
