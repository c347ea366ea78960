"""Detection pattern profiles and lookup tables (plain data).

A profile is an ordered list of patterns; the order breaks ties between matches that
start at the same offset with the same confidence. ``gate`` names a cheap test that must
hold for a text before the regex is run on it (see ``functions.spans``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

RISK_LEVELS = ["low", "medium", "high", "critical"]
LOW, MEDIUM, HIGH, CRITICAL = range(4)


@dataclass(frozen=True)
class Pattern:
    name: str
    pii_type: str
    regex: str
    confidence: float = 0.8
    risk: int = MEDIUM
    validator: str | None = None
    gate: str | None = None
    ascii_words: bool = False  # \\b sees only ASCII letters, digits and _ as word characters
    cuttable: bool = False  # in a match, white space stands only behind a digit, one of ),=: or white space

    @property
    def java(self) -> str:
        """The regex for Java. Where it begins with a word's edge and a known first character, that character is
        looked for first: it is rarer and cheaper to test than the edge, and the matches are the same."""
        if not self.ascii_words:
            return self.regex
        first = FIRST.match(self.regex)
        if not first:
            return self.regex.replace(r"\b", ASCII_EDGE)
        flags, char, rest = first[1] or "", first[2], self.regex[first.end():]
        return f"{flags}(?={char}){ASCII_START}{char}{rest.replace(chr(92) + 'b', ASCII_EDGE)}"


ASCII_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
ASCII_START = "(?<![0-9A-Za-z_])"  # the edge before a word character
#: A word's edge before a digit, a letter of a range or a letter of its own that is not optional.
FIRST = re.compile(r"(\(\?i\))?\\b(\\d|\[A-Z\](?:\[a-z\])?|[A-Za-z0-9])(?![*?]|\{0)")


# ---- fixed values: the canonical profile ---------------------------------------------
IPV4 = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b"
CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"

CANONICAL = [
    Pattern("email", "email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.95, MEDIUM, gate="at"),
    Pattern("phone_us", "phone", r"(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", 0.85, MEDIUM, gate="digit"),
    Pattern("phone_intl", "phone", r"\+[1-9]\d{1,14}", 0.80, MEDIUM, gate="plus"),
    Pattern("ssn", "ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", 0.90, CRITICAL, "ssn", gate="digit"),
    Pattern("credit_card_visa", "credit_card", r"\b4[0-9]{12}(?:[0-9]{3})?\b", 0.90, CRITICAL, "luhn", gate="digit"),
    Pattern("credit_card_mc", "credit_card", r"\b(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}\b", 0.90, CRITICAL, "luhn", gate="digit"),
    Pattern("credit_card_amex", "credit_card", r"\b3[47][0-9]{13}\b", 0.90, CRITICAL, "luhn", gate="digit"),
    Pattern("credit_card_generic", "credit_card", CARD, 0.75, CRITICAL, "luhn", gate="digit"),
    Pattern("ipv4", "ip_address", IPV4, 0.95, LOW, gate="digit"),
    Pattern("ipv6", "ip_address", IPV6, 0.95, LOW, gate="colon"),
    Pattern("mac_address", "ip_address", MAC, 0.95, LOW, gate="colon_dash"),
    Pattern("dob_us", "date_of_birth", r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}\b", 0.70, MEDIUM, gate="digit"),
    Pattern("dob_iso", "date_of_birth", r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])\b", 0.70, MEDIUM, gate="digit"),
    Pattern("drivers_license", "drivers_license", r"\b[A-Z]{1,2}\d{5,8}\b", 0.50, HIGH, gate="digit"),
    Pattern("passport_us", "passport_number", r"\b[A-Z]\d{8}\b", 0.60, HIGH, gate="digit"),
    Pattern("bank_account_iban", "bank_account", IBAN, 0.85, HIGH, gate="digit"),
    Pattern("bank_routing_us", "bank_account", r"\b\d{9}\b", 0.40, HIGH, "routing", gate="digit"),
    Pattern("api_key_generic", "api_key", r"""\b(?:api[_-]?key|apikey|api_secret)[=:]\s*['"]?([a-zA-Z0-9_-]{20,})['"]?""", 0.80, CRITICAL, gate="api"),
    Pattern("aws_key", "api_key", r"\b(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b", 0.95, CRITICAL, gate="aws"),
    Pattern("password_field", "password", r"""(?i)(?:password|passwd|pwd)[=:]\s*['"]?([^'"\s]{4,})['"]?""", 0.85, CRITICAL, gate="assign"),
    Pattern("gps_coords", "coordinates", r"\b[-+]?(?:[1-8]?\d(?:\.\d+)?|90(?:\.0+)?),\s*[-+]?(?:180(?:\.0+)?|(?:(?:1[0-7]\d)|(?:[1-9]?\d))(?:\.\d+)?)\b", 0.70, MEDIUM, gate="digit"),
]

# ---- fixed values: the engine profile ------------------------------------------------
_SSN_DASHED = (  # area not 000, 666 or 9xx; group not 00; serial not 0000
    r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6[0-57-9]\d|66[0-57-9])"
    r"-(?:0[1-9]|[1-9]\d)-(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"
)
_PHONE_WIDE = r"(?:\+\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
_KEY_32 = r"""(?i)(?:api[_-]?key|apikey|access[_-]?token)[\s=:]+['"]?([a-z0-9_\-]{32,})['"]?"""
_DOB_LOOSE = r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}\b"

ENGINE = [
    Pattern("email", "email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95, MEDIUM, "not_throwaway", gate="at"),
    Pattern("ssn", "ssn", _SSN_DASHED, 0.98, CRITICAL, "ssn_listed", gate="digit"),
    Pattern("credit_card", "credit_card", CARD, 0.97, CRITICAL, "luhn", gate="digit"),
    Pattern("phone", "phone_number", _PHONE_WIDE, 0.90, MEDIUM, "phone", gate="digit"),
    Pattern("ipv4", "ip_address", IPV4, 0.92, LOW, "not_private_ip_short", gate="digit"),
    Pattern("ipv6", "ipv6_address", r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b", 0.95, LOW, gate="colon"),
    Pattern("api_key", "api_key", _KEY_32, 0.93, CRITICAL, "entropy"),
    Pattern("aws_key", "api_key", r"\b(AKIA[0-9A-Z]{16})\b", 0.99, CRITICAL, gate="aws"),
    Pattern("dob", "date_of_birth", _DOB_LOOSE, 0.75, MEDIUM, gate="digit"),
    Pattern("mac", "mac_address", MAC, 0.94, LOW, gate="colon_dash"),
    Pattern("iban", "iban", IBAN, 0.96, HIGH, "iban", gate="digit"),
    Pattern("passport", "passport_number", r"\b[A-Z]{1,2}\d{6,9}\b", 0.70, HIGH, gate="digit"),
]

# ---- fixed values: the detector-agent profile (adds postal code, street and titled name)
AGENT = [
    Pattern("email", "email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95, MEDIUM, "not_disposable", gate="at"),
    Pattern("ssn", "ssn", _SSN_DASHED, 0.98, CRITICAL, "ssn_listed", gate="digit"),
    Pattern("credit_card", "credit_card", CARD, 0.97, CRITICAL, "luhn", gate="digit"),
    Pattern("phone", "phone_number", _PHONE_WIDE, 0.90, MEDIUM, "phone", gate="digit"),
    Pattern("ipv4", "ip_address", IPV4, 0.92, LOW, "not_private_ip", gate="digit"),
    Pattern("ipv6", "ipv6_address", r"(?i)\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.95, LOW, gate="colon"),
    Pattern("api_key", "api_key", _KEY_32, 0.93, CRITICAL, "entropy"),
    Pattern("aws_key", "api_key", r"\b(AKIA[0-9A-Z]{16})\b", 0.99, CRITICAL, gate="aws"),
    Pattern("dob", "date_of_birth", _DOB_LOOSE, 0.75, MEDIUM, gate="digit"),
    Pattern("mac", "mac_address", MAC, 0.94, LOW, gate="colon_dash"),
    Pattern("iban", "iban", IBAN, 0.96, HIGH, "iban", gate="digit"),
    Pattern("passport", "passport_number", r"\b[A-Z]{1,2}\d{6,9}\b", 0.70, HIGH, gate="digit"),
    Pattern("zip", "zip_code", r"\b\d{5}(?:-\d{4})?\b", 0.70, MEDIUM, gate="digit"),
    Pattern("street", "street_address", r"(?i)\b\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|way|court|ct|place|pl)\b", 0.80, MEDIUM, gate="digit"),
    Pattern("titled_name", "person_name", r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 0.85, MEDIUM),
]

# ---- fixed values: the command-line profile ------------------------------------------
CLI = [
    Pattern("email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.9, MEDIUM, gate="at"),
    Pattern("phone", "phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", 0.9, MEDIUM, gate="digit"),
    Pattern("ssn", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.9, CRITICAL, gate="digit"),
    Pattern("credit_card", "credit_card", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", 0.9, CRITICAL, gate="digit"),
    Pattern("ip_address", "ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.9, LOW, gate="digit"),
    Pattern("date_of_birth", "date_of_birth", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0.9, MEDIUM, gate="digit"),
    Pattern("address", "address", r"(?i)\b\d{1,5}\s+\w+\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl)\b", 0.9, MEDIUM, gate="digit"),
    Pattern("name", "name", r"\b[A-Z][a-z]{1,15}\s+[A-Z][a-z]{1,15}\b", 0.9, MEDIUM),
    Pattern("medical_record", "medical_record", r"(?i)\bMRN[:\s-]?\d{6,12}\b", 0.9, HIGH, gate="digit"),
    Pattern("financial_account", "financial_account", r"(?i)\bAcct?[:\s#-]?\d{8,17}\b", 0.9, HIGH, gate="digit"),
    Pattern("passport", "passport", r"\b[A-Z]{1,2}\d{6,9}\b", 0.9, HIGH, gate="digit"),
    Pattern("driver_license", "driver_license", r"\b[A-Z]{1,2}\d{5,8}\b", 0.9, HIGH, gate="digit"),
    Pattern("biometric", "biometric", r"(?i)\bfingerprint[:\s-]?[A-Fa-f0-9]{32}\b", 0.9, CRITICAL),
    Pattern("genetic", "genetic", r"(?i)\bDNA[:\s-]?[A-Za-z0-9]{10,50}\b", 0.9, CRITICAL),
]

# ---- fixed values: the service profile -----------------------------------------------
SERVICE = [
    Pattern("email", "email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9, MEDIUM, gate="at"),
    Pattern("phone", "phone_number", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", 0.9, MEDIUM, gate="digit"),
    Pattern("phone_intl", "phone_number", r"\+\d{1,3}[-.\s]?\d{1,14}\b", 0.9, MEDIUM, gate="plus"),
    Pattern("ssn", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.9, CRITICAL, gate="digit"),
    Pattern("credit_card", "credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 0.9, CRITICAL, gate="digit"),
    Pattern("ip_address", "ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.9, LOW, gate="digit"),
    Pattern("date_of_birth", "date_of_birth", r"\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b", 0.9, MEDIUM, gate="digit"),
    Pattern("api_key", "api_key", r"(?i)\b(sk|pk|api)[_-][a-zA-Z0-9]{20,}\b", 0.9, CRITICAL),
    Pattern("password", "password", r"""(?i)password\s*[:=]\s*['"]?[^\s'"]+['"]?""", 0.9, CRITICAL, gate="assign"),
]

# ---- fixed values: the catalogue profile (types without a regex have no row) -----------
CATALOGUE = [
    Pattern("email", "email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.8, MEDIUM, gate="at"),
    Pattern("phone", "phone", r"(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", 0.8, MEDIUM, gate="digit"),
    Pattern("phone_intl", "phone", r"\+\d{1,3}[-.\s]?\d{4,14}", 0.8, MEDIUM, gate="plus"),
    Pattern("ssn", "ssn", r"\d{3}-\d{2}-\d{4}", 0.8, CRITICAL, gate="digit"),
    Pattern("ssn_plain", "ssn", r"\d{9}", 0.8, CRITICAL, gate="digit"),
    Pattern("credit_card", "credit_card", r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", 0.8, CRITICAL, gate="digit"),
    Pattern("credit_card_plain", "credit_card", r"\d{15,16}", 0.8, CRITICAL, gate="digit"),
    Pattern("ipv4", "ip_address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 0.8, LOW, gate="digit"),
    Pattern("ipv6", "ip_address", r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", 0.8, LOW, gate="colon"),
    Pattern("vin", "vin", r"[A-HJ-NPR-Z0-9]{17}", 0.8, LOW),
    Pattern("api_key", "api_key", r"""(api[_-]?key|secret|token)["\s:=]+[a-zA-Z0-9_-]{20,}""", 0.8, CRITICAL),
]

def _ascii(patterns: list[Pattern]) -> list[Pattern]:
    return [replace(p, ascii_words=True) for p in patterns]


def _cuttable(patterns: list[Pattern]) -> list[Pattern]:
    return [replace(p, cuttable=True) for p in patterns]


PROFILES = {
    "canonical": _cuttable(CANONICAL),
    "engine": ENGINE,
    "agent": _ascii(AGENT),
    "service": _ascii(SERVICE),
    "cli": _ascii(CLI),
    "catalogue": CATALOGUE,
}

# ---- fixed values: type -> category -> default risk ----------------------------------
CATEGORY_OF_TYPE = {
    "email": "contact_info",
    "phone": "contact_info",
    "phone_number": "contact_info",
    "address": "contact_info",
    "name": "direct_identifier",
    "ssn": "government_id",
    "drivers_license": "government_id",
    "passport_number": "government_id",
    "national_id": "government_id",
    "credit_card": "financial",
    "bank_account": "financial",
    "date_of_birth": "direct_identifier",
    "ip_address": "online_identifier",
    "location": "location",
    "coordinates": "location",
    "biometric": "biometric",
    "medical_record_number": "health",
    "medical_record": "health",
    "health_info": "health",
    "password": "credentials",
    "api_key": "credentials",
    "credentials": "credentials",
    "person_name": "direct_identifier",
    "vin": "direct_identifier",
    "street_address": "contact_info",
    "driver_license": "government_id",
    "passport": "government_id",
    "financial_account": "financial",
    "iban": "financial",
    "mac_address": "online_identifier",
    "ipv6_address": "online_identifier",
    "zip_code": "location",
    "genetic": "biometric",
    "custom": "other",
}
RISK_OF_CATEGORY = {
    "direct_identifier": CRITICAL,
    "government_id": CRITICAL,
    "biometric": CRITICAL,
    "financial": HIGH,
    "health": HIGH,
    "credentials": HIGH,
    "contact_info": MEDIUM,
    "location": MEDIUM,
    "online_identifier": LOW,
    "other": LOW,
}

# ---- fixed values: context keywords (keyword, type, boost, position, max distance) ---
KEYWORDS = [
    ("email", "email", 0.15, "before", 50),
    ("e-mail", "email", 0.15, "before", 50),
    ("phone", "phone", 0.2, "before", 50),
    ("tel", "phone", 0.15, "before", 30),
    ("mobile", "phone", 0.2, "before", 50),
    ("call", "phone", 0.1, "before", 30),
    ("ssn", "ssn", 0.3, "before", 30),
    ("social security", "ssn", 0.3, "before", 50),
    ("card", "credit_card", 0.15, "before", 50),
    ("credit", "credit_card", 0.2, "before", 50),
    ("payment", "credit_card", 0.15, "before", 50),
    ("name", "name", 0.15, "before", 30),
    ("mr.", "name", 0.2, "before", 10),
    ("ms.", "name", 0.2, "before", 10),
    ("dr.", "name", 0.2, "before", 10),
    ("address", "address", 0.2, "before", 50),
    ("street", "address", 0.15, "around", 100),
    ("dob", "date_of_birth", 0.3, "before", 30),
    ("birth", "date_of_birth", 0.25, "before", 50),
    ("born", "date_of_birth", 0.2, "before", 50),
    ("password", "password", 0.4, "before", 30),
    ("pwd", "password", 0.3, "before", 20),
    ("api_key", "api_key", 0.4, "before", 30),
    ("secret", "api_key", 0.25, "before", 30),
]

# ---- fixed values: column-name hints -------------------------------------------------
NAME_HINTS = {
    "email": "email", "email_address": "email", "user_email": "email",
    "phone": "phone", "phone_number": "phone", "mobile": "phone", "tel": "phone",
    "ssn": "ssn", "social_security": "ssn", "social_security_number": "ssn",
    "name": "name", "full_name": "name", "first_name": "name", "last_name": "name",
    "address": "address", "street_address": "address", "home_address": "address",
    "credit_card": "credit_card", "card_number": "credit_card", "cc_number": "credit_card",
    "dob": "date_of_birth", "date_of_birth": "date_of_birth", "birthdate": "date_of_birth",
    "ip": "ip_address", "ip_address": "ip_address", "client_ip": "ip_address",
    "password": "password", "passwd": "password", "pwd": "password",
    "api_key": "api_key", "apikey": "api_key", "secret_key": "api_key",
}
