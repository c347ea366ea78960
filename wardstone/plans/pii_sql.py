"""SQL text that finds the same matches, for comparison runs."""

from __future__ import annotations

from ..functions.patterns import PROFILES, Pattern
from ..functions.validators import DISPOSABLE_DOMAINS, PLACEHOLDER_SSNS, PRIVATE_IPV4, PRIVATE_IPV4_SHORT, THROWAWAY_DOMAINS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_D = "regexp_replace(value,'[^0-9]','','g')"
_LUHN_SUM = (
    f"list_sum(list_transform(range(length({_D})), lambda i: CASE WHEN i % 2 = 1 THEN "
    f"(2*CAST(substr({_D}, length({_D})-i, 1) AS INT)) - CASE WHEN CAST(substr({_D}, length({_D})-i, 1) AS INT) > 4 THEN 9 ELSE 0 END "
    f"ELSE CAST(substr({_D}, length({_D})-i, 1) AS INT) END))"
)
_ROUTING = " + ".join(f"{w}*TRY_CAST(substr({_D},{i + 1},1) AS INT)" for i, w in enumerate([3, 7, 1] * 3))
_ENTROPY = (
    "list_sum(list_transform(list_distinct(regexp_extract_all(value,'.')), lambda c: "
    "-((length(value)-length(replace(value,c,'')))/CAST(length(value) AS DOUBLE))"
    "*log2((length(value)-length(replace(value,c,'')))/CAST(length(value) AS DOUBLE))))"
)


def _suffixes(expr: str, names) -> str:
    return "NOT (" + " OR ".join(f"ends_with({expr},{q(n)})" for n in names) + ")"


VALID_SQL = {
    "luhn": f"(length({_D}) BETWEEN 13 AND 19 AND {_LUHN_SUM} % 10 = 0)",
    "ssn": f"(length({_D}) = 9 AND substr({_D},1,3) NOT IN ('000','666') AND substr({_D},1,1) <> '9' "
           f"AND substr({_D},4,2) <> '00' AND substr({_D},6,4) <> '0000')",
    "ssn_listed": f"({_D} NOT IN ({','.join(map(q, PLACEHOLDER_SSNS))}))",
    "routing": f"(length({_D}) = 9 AND coalesce(({_ROUTING}) % 10 = 0, false))",
    "phone": f"(length({_D}) BETWEEN 10 AND 15)",
    "iban": "(length(value) BETWEEN 15 AND 34)",
    "entropy": f"({_ENTROPY} > 3.5)",
    "not_private_ip": f"(NOT regexp_matches(value,{q(PRIVATE_IPV4)}))",
    "not_private_ip_short": f"(NOT regexp_matches(value,{q(PRIVATE_IPV4_SHORT)}))",
    "not_disposable": "(" + _suffixes("lower(split_part(value,'@',2))", DISPOSABLE_DOMAINS) + ")",
    "not_throwaway": "(" + _suffixes("value", THROWAWAY_DOMAINS) + ")",
}


def valid_case(patterns: list[Pattern], ord_col: str = "ord") -> str:
    whens = " ".join(f"WHEN {ord_col} = {i} THEN {VALID_SQL[p.validator]}" for i, p in enumerate(patterns) if p.validator)
    return f"(CASE {whens} ELSE true END)" if whens else "true"


def cand_ctes(source: str, key: str, text: str, patterns: list[Pattern]) -> str:
    """CTEs ``pat`` and ``cand`` (key columns, ord, start_pos, end_pos, value, ...)."""
    rows = ",".join(
        f"({i},{q(p.name)},{q(p.pii_type)},CAST({p.confidence} AS DOUBLE),{p.risk})" for i, p in enumerate(patterns))
    scans = " UNION ALL ".join(
        f"SELECT {key}, {i} AS ord, string_split_regex({text},{q(p.regex)}) AS s, regexp_extract_all({text},{q(p.regex)}) AS m "
        f"FROM {source} WHERE regexp_matches({text},{q(p.regex)})" for i, p in enumerate(patterns))
    return (
        f"pat(ord,pattern,pii_type,confidence,risk) AS (VALUES {rows}), "
        f"hits AS ({scans}), "
        f"flat AS (SELECT {key}, ord, s, m, unnest(range(1, len(m)+1)) AS i FROM hits), "
        f"placed AS (SELECT {key}, ord, m[i] AS value, "
        f"CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))),0) AS INTEGER) AS start_pos FROM flat), "
        f"cand AS (SELECT {key}, p.ord, p.value, p.start_pos, CAST(p.start_pos + length(p.value) AS INTEGER) AS end_pos, "
        f"pat.pattern, pat.pii_type, pat.confidence, pat.risk FROM placed p JOIN pat USING (ord))"
    )


def det_ctes(source: str, key: str, text: str, patterns: list[Pattern], mode: str = "earliest",
             where: str = "confidence >= 0.5", validate_first: bool = False, cands: str | None = None) -> str:
    """CTEs up to ``det``: overlap removal, validators, filter."""
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"r.{k} = s.{k}" for k in keys)
    skeys = ", ".join(f"s.{k}" for k in keys)
    pre = f"WHERE {valid_case(patterns)}" if validate_first else ""
    better = "false" if mode == "earliest" else "r.confidence > s.conf"
    return (
        (cands or cand_ctes(source, key, text, patterns))
        + f", ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_pos, confidence DESC, ord, end_pos) AS rn FROM cand {pre}), "
        f"scan AS (SELECT {key}, rn, end_pos AS last_end, confidence AS conf, 1 AS slot, true AS taken FROM ranked WHERE rn = 1 "
        f"UNION ALL SELECT {skeys}, r.rn, "
        f"CASE WHEN r.start_pos >= s.last_end OR {better} THEN r.end_pos ELSE s.last_end END, "
        f"CASE WHEN r.start_pos >= s.last_end OR {better} THEN r.confidence ELSE s.conf END, "
        f"CASE WHEN r.start_pos >= s.last_end THEN s.slot + 1 ELSE s.slot END, "
        f"r.start_pos >= s.last_end OR {better} FROM scan s JOIN ranked r ON {on} AND r.rn = s.rn + 1), "
        f"kept AS (SELECT {key}, slot, max(rn) AS rn FROM scan WHERE taken GROUP BY ALL), "
        f"det AS (SELECT ranked.* FROM ranked JOIN kept USING ({key}, rn) WHERE {valid_case(patterns)} AND {where})"
    )


CANON = PROFILES["canonical"]
DOC_CAND = "WITH RECURSIVE " + cand_ctes("documents", "doc_id", "text", CANON)
DOC_DET = "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", CANON)
DOC_DET_RAW = "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", CANON, where="true")
