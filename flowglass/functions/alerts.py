"""Alert text and grading."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Classes and their severities (all others are MEDIUM).
CRITICAL = ["DDOS"]
HIGH = ["ENCRYPTED_MALWARE", "DATA_EXFILTRATION", "BOTNET_C2"]


def severity(threat) -> Column:
    return F.when(col(threat).isin(CRITICAL), "CRITICAL").when(col(threat).isin(HIGH), "HIGH").otherwise("MEDIUM")


def number_text(c) -> Column:
    """A double as Python prints it after rounding to four places (1.0, 0.25, 12.3457)."""
    r = F.round(col(c), 4)
    plain = (r == 0) | F.abs(r).between(0.001, 9_999_999)
    text = F.regexp_replace(F.format_string("%.4f", r), "0+$", "")
    padded = F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    return F.when(plain, r.cast("string")).when(r.isNotNull(), padded)


def narrative(fields: list) -> Column:
    """`k=v; ...` in the given order; `fields` holds (name, column, kind) with kind float, bool, int or text."""
    parts = []
    for name, c, kind in fields:
        v = col(c)
        if kind == "float":
            text = number_text(v)
        elif kind == "bool":
            text = F.when(v, "True").otherwise("False")
        else:
            text = v.cast("string")
        parts.append(F.concat(F.lit(name + "="), F.coalesce(text, F.lit("None"))))
    return F.concat_ws("; ", *parts)


def confidence3(c) -> Column:
    """Three digits, ties to even on the decimal text."""
    return F.bround(col(c), 3)


def training_weight(label, actual, boost=3.0) -> Column:
    c = col(label)
    return F.when((col(actual) == 0) & (F.length(c) >= 12) & c.rlike("^\\p{L}+$"), F.lit(boost)).otherwise(F.lit(1.0))


def excluded_family(name, roots, aliases) -> Column:
    """Name reduced to [a-z0-9]: starts with a listed root or equals a listed alias."""
    flat = F.regexp_replace(F.lower(col(name)), "[^a-z0-9]", "")
    test = flat.isin(list(aliases))
    for r in roots:
        test = test | flat.startswith(r)
    return test
