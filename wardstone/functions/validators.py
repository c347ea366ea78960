"""Value validators as Column expressions, looked up by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# fixed values
DISPOSABLE_DOMAINS = [
    "tempmail.com", "throwaway.email", "guerrillamail.com",
    "mailinator.com", "10minutemail.com", "yopmail.com",
]
PLACEHOLDER_SSNS = ["123456789"] + [str(d) * 9 for d in range(1, 10)]
THROWAWAY_DOMAINS = ["tempmail.com", "throwaway.email", "guerrillamail.com"]
PRIVATE_IPV4_SHORT = r"^(10\.|192\.168\.|127\.|172\.1[67]\.)"
PRIVATE_IPV4 = r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def ssn(value: Column) -> Column:
    d = digits(value)
    return (
        (F.length(d) == 9)
        & ~F.substring(d, 1, 3).isin("000", "666")
        & (F.substring(d, 1, 1) != "9")
        & (F.substring(d, 4, 2) != "00")
        & (F.substring(d, 6, 4) != "0000")
    )


def ssn_listed(value: Column) -> Column:
    return ~digits(value).isin(PLACEHOLDER_SSNS)


def routing(value: Column) -> Column:
    d = digits(value)
    weights = [3, 7, 1] * 3
    total = sum(
        (F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0)
    )
    return (F.length(d) == 9) & F.coalesce(total % 10 == 0, F.lit(False))


def phone(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def iban(value: Column) -> Column:
    return F.length(value).between(15, 34)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    size = F.length(value).cast("double")
    chars = F.array_distinct(F.split(value, ""))

    def part(c: Column) -> Column:
        share = (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / size
        return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)

    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + part(c))


def high_entropy(value: Column) -> Column:
    return entropy(value) > 3.5


def not_private_ip(value: Column) -> Column:
    return ~value.rlike(PRIVATE_IPV4)


def not_private_ip_short(value: Column) -> Column:
    return ~value.rlike(PRIVATE_IPV4_SHORT)


def _no_suffix(value: Column, suffixes: list[str]) -> Column:
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | value.endswith(suffix)
    return ~hit


def not_disposable(value: Column) -> Column:
    return _no_suffix(F.lower(F.element_at(F.split(value, "@"), 2)), DISPOSABLE_DOMAINS)


def not_throwaway(value: Column) -> Column:
    return _no_suffix(value, THROWAWAY_DOMAINS)


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn,
    "ssn": ssn,
    "ssn_listed": ssn_listed,
    "routing": routing,
    "phone": phone,
    "iban": iban,
    "entropy": high_entropy,
    "not_private_ip": not_private_ip,
    "not_private_ip_short": not_private_ip_short,
    "not_disposable": not_disposable,
    "not_throwaway": not_throwaway,
}


def register_validator(name: str, rule: Callable[[Column], Column]) -> None:
    from .spans import forget

    VALIDATORS[name] = rule
    forget()


def valid(value: Column, validator: Column, names: set[str] | None = None) -> Column:
    """True when the named rule accepts the value; no rule accepts everything."""
    out = F.lit(True)
    for name in sorted(names if names is not None else VALIDATORS):
        out = F.when(validator == name, VALIDATORS[name](value)).otherwise(out)
    return out
