"""Small aggregate helpers whose result does not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(value: Column) -> Column:
    """Average of exact decimals: one exact sum, one division at the end."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("double")


def tax_rate_percent(tax: Column, taxable: Column) -> Column:
    """Effective rate in percent at six decimals, so that means of it add up exactly."""
    return F.try_divide(tax.cast("double") * 100, taxable.cast("double")).cast("decimal(18,6)")
