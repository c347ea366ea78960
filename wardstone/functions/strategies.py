"""Replacement strategies as Column expressions over (value, type)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .spans import constants

# ---- fixed values -----------------------------------------------------------------------
NAMES = ["John Doe", "Jane Smith", "Alex Johnson", "Sam Wilson", "Morgan Lee", "Taylor Brown"]
FIRST_NAMES = ["John", "Jane", "Alex", "Sam", "Chris", "Pat", "Morgan", "Taylor"]
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis"]
MAIL_DOMAINS = ["example.com", "test.org", "sample.net"]
STREET_NUMBERS = [123, 456, 789, 100, 200, 300, 500]
STREETS = ["Main St", "Oak Ave", "Elm Blvd", "Park Ln", "First St", "Second Ave"]
LABELS = {
    "email": "[EMAIL_REDACTED]", "phone_number": "[PHONE_REDACTED]", "ssn": "[SSN_REDACTED]",
    "credit_card": "[CARD_REDACTED]", "person_name": "[NAME_REDACTED]",
    "ip_address": "[IP_REDACTED]", "api_key": "[KEY_REDACTED]",
    "full_address": "[ADDRESS_REDACTED]", "street_address": "[ADDRESS_REDACTED]",
    "date_of_birth": "[DOB_REDACTED]", "passport_number": "[PASSPORT_REDACTED]",
    "drivers_license": "[LICENSE_REDACTED]", "medical_record_number": "[MRN_REDACTED]",
    "health_insurance_number": "[INSURANCE_REDACTED]", "bank_account": "[BANK_REDACTED]",
    "iban": "[IBAN_REDACTED]", "password": "[PASSWORD_REDACTED]", "auth_token": "[TOKEN_REDACTED]",
    "private_key": "[KEY_REDACTED]", "secret_key": "[SECRET_REDACTED]",
}
AGE_BANDS = [(17, "0-17"), (24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (74, "65-74")]
OLDEST_BAND = "75+"


def pick(options: list, index: Column) -> Column:
    return F.element_at(constants(options), (index % len(options) + 1).cast("int"))


def hex_number(hex_text: Column, start: int, size: int) -> Column:
    """An integer from ``size`` hex digits (at most 13, so that it also fits a double)."""
    return F.conv(F.substring(hex_text, start, size), 16, 10).cast("bigint")


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


# ---- masks and redactions -----------------------------------------------------------------
def mask(value: Column, pii_type: Column) -> Column:
    """Layout-preserving mask: last four of cards and SSNs, e-mail ends, phone ends."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    card = F.regexp_replace(value, "[0-9](?=(?:[^0-9]*[0-9]){4})", "*")
    shape = "^((?:[^0-9]*[0-9]){3})(.*?)((?:[0-9][^0-9]*){2})$"
    phone = F.concat(
        F.regexp_extract(value, shape, 1),
        F.regexp_replace(F.regexp_extract(value, shape, 2), "[0-9]", "*"),
        F.regexp_extract(value, shape, 3),
    )
    at = F.locate("@", value)
    local = F.substring(value, 1, at - 1)
    ends = F.concat(
        F.substring(local, 1, 1), stars(F.length(local) - 2), F.substring(local, F.length(local), F.lit(1))
    )
    email = F.concat(
        F.when(F.length(local) <= 2, stars(F.length(local))).otherwise(ends),
        F.substring(value, at, F.length(value)),
    )
    return (
        F.when((pii_type == "credit_card") & (n >= 4), card)
        .when((pii_type == "ssn") & (n >= 4), F.concat(F.lit("***-**-"), F.substring(digits, n - 3, F.lit(4))))
        .when((pii_type == "email") & (at > 0), email)
        .when(pii_type.isin("phone", "phone_number") & (n >= 6), phone)
        .otherwise(stars(F.length(value)))
    )


def mask_label(value: Column, pii_type: Column) -> Column:
    """A typed label; types without one keep their length in stars."""
    labels = F.map_from_arrays(constants(list(LABELS)), constants(list(LABELS.values())))
    return F.coalesce(F.try_element_at(labels, pii_type), stars(F.length(value)))


def mask_partial(value: Column, keep: int = 4, preserve_length: bool = True) -> Column:
    n = F.length(value)
    ends = F.concat(
        F.substring(value, 1, keep), stars(n - 2 * keep), F.substring(value, n - keep + 1, F.lit(keep))
    )
    rest = stars(n) if preserve_length else F.lit("*" * 8)
    return F.when(n > 2 * keep, ends).otherwise(rest)


def mask_cli(value: Column, pii_type: Column) -> Column:
    """Command-line variant: first letter of an e-mail, last four digits of numbers."""
    local, domain = F.substring_index(value, "@", 1), F.element_at(F.split(value, "@"), 2)
    email = F.when(
        F.length(local) > 0,
        F.concat(F.substring(local, 1, 1), stars(F.length(local) - 1), F.lit("@"), domain),
    ).otherwise(F.concat(F.lit("***@"), domain))
    return (
        F.when(pii_type == "email", email)
        .when(pii_type.isin("phone", "ssn", "credit_card"), F.regexp_replace(value, r"\d(?=\d{4})", "*"))
        .otherwise(stars(F.length(value)))
    )


def redact(pii_type: Column, style: str = "plain") -> Column:
    if style == "typed":
        return F.concat(F.lit("["), F.upper(pii_type), F.lit("_REDACTED]"))
    if style == "removed":
        return F.concat(F.lit("["), F.replace(F.upper(pii_type), F.lit("_"), F.lit(" ")), F.lit(" REMOVED]"))
    return F.lit("[REDACTED]")


def truncate(value: Column, n: int = 3) -> Column:
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit("..."))).otherwise(value)


# ---- deterministic stand-ins ----------------------------------------------------------------
def substitute(value: Column, pii_type: Column) -> Column:
    h = F.sha2(value, 256)
    d = F.regexp_replace(h, "[^0-9]", "")
    phone = F.when(
        F.length(d) >= 7,
        F.concat(F.lit("555-"), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4)),
    ).otherwise(F.concat(F.lit("555-000-"), F.lpad((hex_number(h, 1, 4) % 10000).cast("string"), 4, "0")))
    address = F.concat((hex_number(h, 1, 3) % 900 + 100).cast("string"), F.lit(" Main St, Anytown, ST 00000"))
    return (
        F.when(pii_type == "email", F.concat(F.lit("user"), F.substring(h, 1, 8), F.lit("@example.com")))
        .when(pii_type.isin("phone", "phone_number"), phone)
        .when(pii_type == "name", pick(NAMES, hex_number(h, 1, 2)))
        .when(pii_type == "address", address)
        .otherwise(F.lit("[REDACTED]"))
    )


def synthesize(value: Column, pii_type: Column, seed: str = "", keep_format: bool = True) -> Column:
    """Fakes of nine types in their usual layout, drawn from a hash of value and seed."""
    h = F.sha2(F.concat(value, F.lit(seed)), 256)
    a, b, c, d = (hex_number(h, 1 + 8 * i, 8) for i in range(4))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    text = lambda n: n.cast("string")
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    twelve = F.lpad(text(hex_number(h, 1, 12) % 10**12), 12, "0")
    quad = [F.substring(twelve, i, 4) for i in (1, 5, 9)]
    year, month, day = text(1950 + a % 50), two(b % 12 + 1), two(c % 28 + 1)
    area, group = F.lpad(text(a % 899 + 100), 3, "0"), two(b % 99 + 1)
    serial = F.lpad(text(c % 9999 + 1), 4, "0")
    exchange, subscriber = text(a % 900 + 100), text(b % 9000 + 1000)
    if keep_format:
        phone, card = join("(555) ", exchange, "-", subscriber), join("4111-", quad[0], "-", quad[1], "-", quad[2])
        ssn, dob = join(area, "-", group, "-", serial), join(month, "/", day, "/", year)
    else:
        phone, card = join("555", exchange, subscriber), join("4111", twelve)
        ssn, dob = join(area, group, serial), join(year, "-", month, "-", day)
    return (
        F.when(pii_type == "email", join("user_", F.substring(h, 1, 7), "@", pick(MAIL_DOMAINS, a)))
        .when(pii_type.isin("phone", "phone_number"), phone)
        .when(pii_type.isin("name", "person_name"), join(pick(FIRST_NAMES, a), " ", pick(LAST_NAMES, b)))
        .when(pii_type == "credit_card", card)
        .when(pii_type == "ssn", ssn)
        .when(pii_type == "ip_address",
              join(text(a % 223 + 1), ".", text(b % 256), ".", text(c % 256), ".", text(d % 256)))
        .when(pii_type == "date_of_birth", dob)
        .when(pii_type == "zip_code", text(10000 + a % 90000))
        .when(pii_type == "street_address", join(text(pick(STREET_NUMBERS, a)), " ", pick(STREETS, b)))
        .otherwise(join("SYNTH_", F.upper(F.substring(h, 1, 8))))
    )


def tokenize(value: Column, prefix: str = "TOK_", pii_type: Column | None = None) -> Column:
    head = F.lit(prefix) if pii_type is None else F.concat(F.upper(pii_type), F.lit("_TOKEN_"))
    return F.concat(head, F.substring(F.sha2(value, 256), 1, 16))


def random_token(prefix: str = "TOK_") -> Column:
    return F.concat(F.lit(prefix), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))


def hash_value(value: Column, bits: int = 256, salt: str = "", pepper: str = "", truncate_to: int = 0,
               salt_first: bool = False) -> Column:
    if salt_first:
        return F.concat(F.lit("HASH_"), F.substring(F.sha2(F.concat(F.lit(salt), value), bits), 1, truncate_to or 128))
    h = F.sha2(F.concat(value, F.lit(pepper + salt)), bits)
    return F.substring(h, 1, truncate_to) if truncate_to else h


def hmac_sha256(value: Column, key: bytes | str) -> Column:
    """HMAC-SHA256 in hex, composed from two digests with constant pads."""
    import hashlib

    raw = key.encode() if isinstance(key, str) else key
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner_pad = bytearray(b ^ 0x36 for b in raw)
    outer_pad = bytearray(b ^ 0x5C for b in raw)
    inner = F.unhex(F.sha2(F.concat(F.lit(inner_pad), value.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer_pad), inner), 256)


def unit_noise(key: Column) -> Column:
    """A repeatable uniform number in [0, 1) from a key."""
    return hex_number(F.sha2(key.cast("string"), 256), 1, 13) / F.lit(float(2**52))


def add_noise(value: Column, key: Column, level: float = 0.1) -> Column:
    """value x (1 + U(-level, level)), two decimals; null when the value is no number."""
    shift = unit_noise(key) * (2 * level) - level
    return F.round(value.try_cast("double") * (1 + shift), 2)


def encrypt(value: Column, key: bytes, aad: str = "") -> Column:
    """``ENC:`` + base64 of AES-GCM; the nonce is an HMAC of the value, so runs repeat."""
    nonce = F.substring(F.unhex(hmac_sha256(value, key)), 1, 12)
    sealed = F.aes_encrypt(value.cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), nonce, F.lit(bytearray(aad.encode())))
    return F.concat(F.lit("ENC:"), F.base64(sealed))


def decrypt(sealed: Column, key: bytes, aad: str = "") -> Column:
    """Null when the key, the data or the associated data do not fit."""
    raw = F.unbase64(F.substring(sealed, 5, F.length(sealed)))
    return F.try_aes_decrypt(raw, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray(aad.encode()))).cast("string")


# ---- generalisation -----------------------------------------------------------------------
def age_band(value: Column) -> Column:
    age = value.try_cast("int")
    out = F.when(age < 0, F.lit(None).cast("string"))
    for top, label in AGE_BANDS:
        out = out.when(age <= top, label)
    return out.when(age.isNotNull(), OLDEST_BAND)


def number_range(value: Column, step: float = 10.0) -> Column:
    lower = F.floor(value.try_cast("double") / step) * step
    return F.concat(lower.cast("bigint").cast("string"), F.lit("-"), (lower + step).cast("bigint").cast("string"))


def year_of(value: Column) -> Column:
    return F.regexp_extract(value, r"(\d{4})", 1)


def generalize(value: Column, pii_type: Column, level: int = 1) -> Column:
    """Hierarchies per type; a level beyond the last clamps to it; otherwise a typed label."""
    label = F.concat(F.lit("["), F.upper(pii_type), F.lit(" GENERALIZED]"))
    age = value.try_cast("int")
    year = F.nullif(year_of(value), F.lit("")).cast("int")
    parts = F.split(value, "\\.")
    octets = lambda n: F.array_join(F.slice(parts, 1, n), ".")
    is_ip = F.size(parts) == 4
    str_ = lambda c: c.cast("string")
    ladders: dict[str, list[Column]] = {
        "age": [
            F.concat(str_(F.floor(age / 5) * 5), F.lit("-"), str_(F.floor(age / 5) * 5 + 4)),
            F.concat(str_(F.floor(age / 10) * 10), F.lit("s")),
            F.when(age < 18, "Minor").when(age >= 18, "Adult"),
        ],
        "zip_code": [
            F.when(F.length(value) >= 3, F.concat(F.substring(value, 1, 3), F.lit("**"))),
            F.when(F.length(value) >= 2, F.concat(F.substring(value, 1, 2), F.lit("***"))),
            F.lit("USA"),
        ],
        "date_of_birth": [
            F.concat(F.lit("Year: "), str_(year)),
            F.concat(str_(F.floor(year / 10) * 10), F.lit("s")),
            F.lit("[DATE GENERALIZED]"),
        ],
        "city": [F.lit("[CITY]"), F.lit("[REGION]"), F.lit("[LOCATION]")],
        "state": [F.lit("[STATE]"), F.lit("[REGION]")],
        "ip_address": [
            F.when(is_ip, F.concat(octets(3), F.lit(".*"))),
            F.when(is_ip, F.concat(octets(2), F.lit(".*.*"))),
            F.lit("[IP GENERALIZED]"),
        ],
    }
    out = None
    for kind, steps in ladders.items():
        expr = F.coalesce(steps[min(level, len(steps) - 1)], label)
        out = F.when(pii_type == kind, expr) if out is None else out.when(pii_type == kind, expr)
    return out.otherwise(label)


def generalize_or_redact(value: Column, pii_type: Column) -> Column:
    """Policy intent: dates of birth become their year; types without a rule are redacted."""
    year = F.regexp_extract(value, r"((?:19|20)\d{2})", 1)
    return F.when((pii_type == "date_of_birth") & (year != ""), year).otherwise(F.lit("[REDACTED]"))


# ---- registry -----------------------------------------------------------------------------
STRATEGIES: dict[str, Callable[[Column, Column], Column]] = {
    "mask": mask,
    "label": mask_label,
    "partial": lambda v, t: mask_partial(v),
    "redact": lambda v, t: redact(t),
    "redact_typed": lambda v, t: redact(t, "typed"),
    "redact_removed": lambda v, t: redact(t, "removed"),
    "substitute": substitute,
    "synthesize": synthesize,
    "tokenize": lambda v, t: tokenize(v),
    "hash": lambda v, t: hash_value(v),
    "remove": lambda v, t: F.lit(""),
    "generalize": generalize_or_redact,
    "truncate": lambda v, t: truncate(v),
    "none": lambda v, t: v,
}


def register_strategy(name: str, rule: Callable[[Column, Column], Column]) -> None:
    from .spans import forget

    STRATEGIES[name] = rule
    forget()


def apply_strategy(value: Column, pii_type: Column, strategy: Column, names: set[str]) -> Column:
    out = redact(pii_type)  # an unknown strategy never passes the value through
    for name in sorted(names):
        out = F.when(strategy == name, STRATEGIES[name](value, pii_type)).otherwise(out)
    return out
