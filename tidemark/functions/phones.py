"""Column expressions for international phone numbers in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators allowed between the digits, and the zero in brackets that is not dialled from abroad.
SEPARATORS = r"[\(\)\- ]*"
BRACKET_ZERO = rf"(?:{SEPARATORS}\( *?0 *?\))"


def phone_pattern(country: str = "31", digits: int = 9) -> str:
    """``00`` (after a non-digit) or ``+``, the country code, ``(0)`` perhaps, then so many digits."""
    code = SEPARATORS.join(country)
    return (
        rf"(?:(?<=\P{{Nd}})00{SEPARATORS}{code}|\+{SEPARATORS}{code})"
        rf"{BRACKET_ZERO}?(?:{SEPARATORS}[0-9]){{{digits}}}"
    )


def canonical_phone(number: Column) -> Column:
    """``+`` and digits only."""
    bare = F.regexp_replace(number, rf"{BRACKET_ZERO}|[\(\)\- ]+", "")
    return F.regexp_replace(bare, "^00", "+")


def phone_numbers(text: Column | str, country: str = "31", digits: int = 9) -> Column:
    """Distinct canonical numbers of the text."""
    found = F.regexp_extract_all(text, F.lit(phone_pattern(country, digits)), F.lit(0))
    return F.array_distinct(F.transform(found, canonical_phone))
