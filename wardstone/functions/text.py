"""Text hygiene: sanitising, injection flags, format checks, path and network tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: attack patterns --------------------------------------------------------
SQL_INJECTION = [
    r"(?i)\b(union\s+select|select\s+.*\s+from|insert\s+into|update\s+.*\s+set|delete\s+from)",
    r"(?i)\b(drop\s+table|alter\s+table|create\s+table|truncate\s+table)",
    r"(?i)\b(or\s+1\s*=\s*1|and\s+1\s*=\s*1|'\s*or\s*')",
    r"(?i)\b(exec|execute|xp_|sp_)",
    r"(?i)--\s*$|/\*.*\*/",
    r"(?i)\b(waitfor\s+delay|benchmark\s*\(|sleep\s*\()",
    r"(?i)'\s*(;|--)",
]
XSS = [
    r"(?i)<script[^>]*>", r"(?i)</script>", r"(?i)javascript\s*:", r"(?i)on\w+\s*=", r"(?i)<iframe[^>]*>",
    r"(?i)<object[^>]*>", r"(?i)<embed[^>]*>", r"(?i)<link[^>]*>", r"(?i)<meta[^>]*>", r"(?i)expression\s*\(",
    r"""(?i)url\s*\(\s*['"]?\s*javascript:""", r"(?i)data\s*:\s*text/html", r"(?i)vbscript\s*:",
]
PATH_TRAVERSAL = [
    r"(?i)\.\.\/", r"(?i)\.\.\\", r"(?i)%2e%2e/", r"(?i)%2e%2e\\", r"(?i)\.\.%2f", r"(?i)\.\.%5c",
    r"(?i)%252e%252e/", r"(?i)\.%00\.",
]
FILE_FORBIDDEN = r'[/\\:*?"<>|\x00]'
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@dataclass(frozen=True)
class SanitizeRules:
    strip_nulls: bool = False
    strip_tags: bool = False
    collapse_space: bool = False
    trim: bool = False
    lower: bool = False
    max_length: int | None = None
    allowed: str | None = None


#: Presets cut nothing; a caller who wants a length limit says so (``replace(STRICT, max_length=...)``).
STRICT = SanitizeRules(strip_nulls=True, strip_tags=True, collapse_space=True, trim=True)
MINIMAL = SanitizeRules(strip_nulls=True, trim=True)


def sanitize(text: Column, rules: SanitizeRules = STRICT) -> Column:
    out = text
    if rules.strip_nulls:
        out = F.replace(out, F.lit("\0"), F.lit(""))
    if rules.strip_tags:
        out = F.regexp_replace(out, "<[^>]*>", "")
    if rules.collapse_space:
        out = F.regexp_replace(out, r"\s+", " ")
    if rules.trim:
        out = F.regexp_replace(out, r"^\s+|\s+$", "")
    if rules.lower:
        out = F.lower(out)
    if rules.max_length is not None:
        out = F.substring(out, 1, rules.max_length)
    if rules.allowed:
        out = F.array_join(F.regexp_extract_all(out, F.lit(rules.allowed), F.lit(0)), "")
    return out


def matches_any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def threats(text: Column, blocked: list[str] = (), blocked_words: list[str] = (), max_length: int = 1_000_000) -> Column:
    """Failed rules with their level, as an array of structs."""
    def rule(name: str, level: str, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level")))

    words = F.array(*[F.lit(w) for w in blocked_words]) if blocked_words else F.array().cast("array<string>")
    return F.array_compact(F.array(
        rule("max_length", "low", F.octet_length(text) > max_length),
        rule("null_bytes", "medium", text.contains("\0")),
        rule("sql_injection", "critical", matches_any(text, SQL_INJECTION)),
        rule("xss", "high", matches_any(text, XSS)),
        rule("path_traversal", "high", matches_any(text, PATH_TRAVERSAL)),
        rule("blocked_pattern", "medium", matches_any(text, list(blocked))),
        rule("blocked_agent", "medium", F.exists(words, lambda w: F.lower(text).contains(F.lower(w)))),
    ))


def validate_email(text: Column) -> Column:
    """Name of the first failed rule, or null."""
    return (F.when(~text.rlike(EMAIL_FORMAT), "email_format").when(F.size(threats(text)) > 0, "content")
            .when(F.length(text) > 254, "email_length"))


def validate_url(text: Column) -> Column:
    scheme = F.try_parse_url(text, F.lit("PROTOCOL"))
    return (F.when(scheme.isNull(), "url_format").when(~F.lower(scheme).isin("http", "https"), "url_scheme")
            .when(F.size(threats(text)) > 0, "content"))


def validate_filename(text: Column) -> Column:
    return (F.when(matches_any(text, PATH_TRAVERSAL), "path_traversal").when(text.rlike(FILE_FORBIDDEN), "dangerous_char")
            .when(F.length(text) > 255, "filename_length").when(text.startswith("."), "hidden_file"))


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, UUID, "{id}"), r"/[0-9]+(/|$)", "/{id}$1")


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, "\\.")
    n = F.lit(0).cast("bigint")
    for i in range(4):
        n = n * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return n


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = "^" + r"\.".join([OCTET] * 4) + "$"


def address_digits(ip: Column) -> Column:
    """An address as hexadecimal digits, 8 of IPv4 and 32 of IPv6 (any short form; a dotted end
    counts as its two groups); null if it can't be read."""
    octets = F.transform(F.split(ip, "\\."), lambda o: F.lower(F.lpad(F.hex(o.try_cast("bigint")), 2, "0")))
    v4 = F.array_join(octets, "")
    tail = F.substring_index(ip, ":", -1)
    tail_octets = F.transform(F.split(tail, "\\."), lambda o: F.lower(F.lpad(F.hex(o.try_cast("bigint")), 2, "0")))
    tail_hex = F.array_join(tail_octets, "")
    plain = F.when(tail.rlike(IPV4), F.concat(F.substring(ip, F.lit(1), F.length(ip) - F.length(tail)), F.substring(tail_hex, 1, 4), F.lit(":"), F.substring(tail_hex, 5, 4))).otherwise(ip)
    halves = F.split(plain, "::", -1)

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    left, right = groups(F.get(halves, 0)), F.when(F.size(halves) == 2, groups(F.get(halves, 1))).otherwise(F.array().cast("array<string>"))
    both, n = F.concat(left, right), F.size(left) + F.size(right)
    sound = F.forall(both, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")) & (((F.size(halves) == 1) & (n == 8)) | ((F.size(halves) == 2) & (n <= 7)))
    wide = lambda part: F.array_join(F.transform(part, lambda g: F.lower(F.lpad(g, 4, "0"))), "")
    v6 = F.concat(wide(left), F.repeat(F.lit("0000"), 8 - n), wide(right))
    return F.when(ip.rlike(IPV4), v4).when(ip.contains(":") & sound, v6)


def prefix_key(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of hexadecimal digits; the digit that they end in is masked."""
    whole = F.floor(bits / 4).cast("int")
    digit, rest = F.substring(digits, whole + 1, F.lit(1)), bits % 4
    hexes = "0123456789abcdef"
    masked = [F.translate(digit, hexes, "".join(hexes[k & m] for k in range(16))) for m in (0b1000, 0b1100, 0b1110)]
    last = F.when(rest == 1, masked[0]).when(rest == 2, masked[1]).when(rest == 3, masked[2]).otherwise("")
    return F.concat(F.substring(digits, F.lit(1), whole), last)


def ip_filter(df: DataFrame, ip_col: str, networks: DataFrame) -> DataFrame:
    """Add ``allowed``: an allow-listed network beats a block-listed one, an address in no network
    is allowed, and one that can't be read (null too) is not, whatever the lists say.

    ``networks``: (network 'address/n' or a bare address, of IPv4 or IPv6; list 'allow'|'block').
    A network that can't be read, or whose prefix is longer than its addresses, is an error. The
    families are apart: an IPv6 form of an IPv4 address lies in IPv6 networks. Containment is an
    equality on (digits, prefix length, masked prefix), so the network table may be of any size;
    the driver only learns which prefix lengths occur."""
    base, length = F.substring_index("network", "/", 1), F.substring_index("network", "/", -1)
    nets = networks.select("network", "list", address_digits(base).alias("digits"), F.when(F.contains("network", F.lit("/")), length.try_cast("int")).otherwise(999).alias("n"))
    most = F.length("digits") * 4
    nets = nets.withColumn("bits", F.when(F.col("n") == 999, most).otherwise(F.col("n")))
    bad = nets.filter(F.col("digits").isNull() | F.col("bits").isNull() | (F.col("bits") < 0) | (F.col("bits") > most)).limit(5).collect()
    if bad:
        raise ValueError(f"unreadable networks: {[r['network'] for r in bad]}")
    nets = nets.select("list", F.length("digits").alias("family"), "bits", prefix_key(F.col("digits"), F.col("bits")).alias("prefix"))
    lengths = sorted(tuple(r) for r in nets.select("family", "bits").distinct().collect())  # at most 33 and 129
    ips = df.select(ip_col).distinct().select(ip_col, address_digits(F.col(ip_col)).alias("digits"))
    per_net = nets.groupBy("family", "bits", "prefix").agg(F.bool_or(F.col("list") == "allow").alias("a"), F.bool_or(F.col("list") == "block").alias("b"))
    wanted = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("bits")) for f, n in lengths]) if lengths else F.array().cast("array<struct<family:int,bits:int>>")
    own = F.filter(wanted, lambda w: w["family"] == F.length("digits"))
    keyed = ips.select(ip_col, "digits", F.explode(own).alias("w")).select(ip_col, "w.family", "w.bits", prefix_key(F.col("digits"), F.col("w.bits")).alias("prefix"))
    hits = keyed.join(per_net, ["family", "bits", "prefix"])
    verdict = hits.groupBy(F.col(ip_col).alias("__ip")).agg((F.bool_or("a") | ~F.bool_or("b")).alias("__ok"))
    known = ips.select(F.col(ip_col).alias("__ip"), F.col("digits").isNotNull().alias("__read")).join(verdict, "__ip", "left")
    known = known.select("__ip", (F.col("__read") & F.coalesce("__ok", F.lit(True))).alias("__ok"))
    joined = df.join(known, F.col(ip_col) == F.col("__ip"), "left")
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("__ok", F.lit(False)).alias("allowed"))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def search_names(df: DataFrame, name: str, query: str, threshold: float = 0.3) -> DataFrame:
    a, b = trigrams(F.col(name)), trigrams(F.lit(query))
    common = F.size(F.array_intersect(a, b))
    score = common / (F.size(a) + F.size(b) - common)
    found = df.withColumn("score", F.round(score, 6))
    return found.filter((F.col("score") >= threshold) | F.col(name).ilike(f"%{query}%"))
