"""Detection queries over documents, pages and customer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.patterns import CATEGORY_OF_TYPE, KEYWORDS, NAME_HINTS, PROFILES, RISK_LEVELS, RISK_OF_CATEGORY, CRITICAL, Pattern
from ..operators import detect as D
from ..session import spread, table
from .pii_sql import CANON, DOC_CAND, DOC_DET, VALID_SQL, det_ctes, q
from .registry import query

COLS = "doc_id, pii_type, pattern, start_pos, end_pos, value, confidence, risk"


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def found(spark, sf, config=D.DetectConfig()):
    return D.detect(docs(spark, sf), "text", ["doc_id"], config)


@query("d01_detect_candidates", f"{DOC_CAND} SELECT {COLS} FROM cand")
def _(spark, sf):
    return D.detect_candidates(docs(spark, sf), "text", ["doc_id"], CANON)


for _mode in ("earliest", "replace_last", "cluster_best"):
    @query(f"d02_resolve_overlaps_{_mode}",
           "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", CANON, mode=_mode, where="true") + f" SELECT {COLS} FROM det")
    def _(spark, sf, mode=_mode):
        return found(spark, sf, D.DetectConfig(overlap=mode, min_confidence=0.0))


@query("d02_validate_first",
       "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", CANON, where="true", validate_first=True) + f" SELECT {COLS} FROM det")
def _(spark, sf):
    return found(spark, sf, D.DetectConfig(validate_first=True, min_confidence=0.0))


_RULES = ["luhn", "ssn", "ssn_listed", "routing", "phone", "iban", "entropy", "not_private_ip"]


@query("d03_validate", f"{DOC_CAND} SELECT doc_id, pattern, start_pos, value, "
       + ", ".join(f"{VALID_SQL[r]} AS {r}" for r in _RULES) + " FROM cand")
def _(spark, sf):
    c = D.detect_candidates(docs(spark, sf), "text", ["doc_id"], CANON)
    return c.select("doc_id", "pattern", "start_pos", "value", *[V.VALIDATORS[r](F.col("value")).alias(r) for r in _RULES])


_PRESET_SQL = []
for _n, _w in (("default", "confidence >= 0.5"), ("strict", "confidence >= 0.9 AND risk >= 2"), ("permissive", "confidence >= 0.3"),
               ("cards_only", "confidence >= 0.5 AND pii_type IN ('credit_card')"),
               ("no_network", "confidence >= 0.5 AND pii_type NOT IN ('ip_address')")):
    _PRESET_SQL.append(f"SELECT '{_n}' AS preset, {COLS} FROM det WHERE {_w}")


@query("d04_filter_detections", "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", CANON, where="true") + " "
       + " UNION ALL ".join(_PRESET_SQL))
def _(spark, sf):
    presets = {
        "default": D.DetectConfig(), "strict": D.STRICT, "permissive": D.PERMISSIVE,
        "cards_only": D.DetectConfig(include_types=("credit_card",)),
        "no_network": D.DetectConfig(exclude_types=("ip_address",)),
    }
    spans = D.with_candidates(docs(spark, sf).select("doc_id", "text"), "text", CANON).drop("text").filter(F.size("spans") > 0)
    out = None
    for name, config in presets.items():
        part = D.explode_spans(D.resolve(spans, config), ["doc_id"], CANON).withColumn("preset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("d05_with_context", f"""{DOC_DET} SELECT doc_id, pii_type, start_pos, end_pos,
  (CASE WHEN start_pos > 100 THEN '...' ELSE '' END) ||
  substr(text, greatest(start_pos-100,0)+1, least(end_pos+100, length(text)) - greatest(start_pos-100,0)) ||
  (CASE WHEN end_pos + 100 < length(text) THEN '...' ELSE '' END) AS context
  FROM det JOIN documents USING (doc_id)""")
def _(spark, sf):
    return D.with_context(docs(spark, sf), "text", ["doc_id"])


def _kw_sql():
    boost, sugg, hits = [], [], []
    for w, t, g, pos, reach in KEYWORDS:
        b = f"contains(right(lft,{reach}),{q(w)})"
        a = f"contains(left(rgt,{reach}),{q(w)})"
        f = {"before": b, "after": a, "around": f"({b} OR {a})"}[pos]
        boost.append(f"(CASE WHEN {f} AND pii_type={q(t)} THEN {g} ELSE 0 END)")
        sugg.append(f"CASE WHEN {f} AND pii_type<>{q(t)} THEN {q(t)} END")
        hits.append(f"CASE WHEN {f} THEN {q(w)} END")
    return f"""{DOC_DET}, near AS (SELECT det.*, lower(substr(text, greatest(start_pos-100,0)+1, least(start_pos,100))) AS lft,
      lower(substr(text, end_pos+1, 100)) AS rgt FROM det JOIN documents USING (doc_id))
      SELECT doc_id, pii_type, pattern, start_pos, end_pos,
      round(least(confidence + least({'+'.join(boost)}, 0.4), 1.0), 6)::DOUBLE AS confidence,
      coalesce({','.join(sugg)}) AS suggested_type,
      array_to_string(list_filter([{','.join(hits)}], lambda x: x IS NOT NULL), ',') AS keywords FROM near"""


@query("d06_adjust_confidence", _kw_sql())
def _(spark, sf):
    return D.adjust_confidence(docs(spark, sf), "text", ["doc_id"])


def _by_kw_sql():
    parts = []
    for w, t, g, _, reach in KEYWORDS:
        parts.append(
            f"SELECT doc_id, {q(w)} AS keyword, {q(t)} AS pii_type, {round(0.5 + g, 6)}::DOUBLE AS confidence, {reach} AS reach, {len(w)} AS n, "
            f"string_split(lower(text), {q(w)}) AS s, text FROM documents WHERE contains(lower(text), {q(w)})")
    return (
        "WITH hits AS (" + " UNION ALL ".join(parts) + "), flat AS (SELECT *, unnest(range(1, len(s))) AS i FROM hits), "
        "pos AS (SELECT *, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + i*n AS INTEGER) AS start_at FROM flat), "
        "win AS (SELECT *, substr(text, start_at+1, reach) AS w FROM pos), "
        "val AS (SELECT *, length(regexp_extract(w, '^[:= \\t\"'']*')) AS skip, regexp_extract(w, '^[:= \\t\"'']*([^\\s,\"'']*)', 1) AS value FROM win) "
        "SELECT doc_id, keyword, pii_type, CAST(start_at+skip AS INTEGER) AS start_pos, CAST(start_at+skip+length(value) AS INTEGER) AS end_pos, value, confidence, 1 AS risk "
        "FROM val WHERE length(value) > 0")


@query("d07_detect_by_keyword", _by_kw_sql())
def _(spark, sf):
    return D.detect_by_keyword(docs(spark, sf), "text", ["doc_id"])


def _classify_sql():
    hints = ",".join(f"({q(k)},{q(v)})" for k, v in NAME_HINTS.items())
    long = ("long AS (SELECT 'text' AS column_name, doc_id, text AS v FROM documents UNION ALL SELECT 'lang', doc_id, lang FROM documents "
            "UNION ALL SELECT 'source', doc_id, source FROM documents)")
    return (f"WITH RECURSIVE {long}, " + det_ctes("long", "column_name, doc_id", "v", CANON)
            + f", hints(h, t) AS (VALUES {hints}), tot AS (SELECT column_name, count(*) AS n FROM long GROUP BY ALL), "
            "hit AS (SELECT column_name, pii_type, count(DISTINCT doc_id) AS c FROM det GROUP BY ALL) "
            "SELECT tot.column_name, coalesce(pii_type,'none') AS pii_type, coalesce(t,'none') AS name_hint, "
            "round(coalesce(c,0)/n, 6)::DOUBLE AS hit_rate FROM tot LEFT JOIN hit USING (column_name) "
            "LEFT JOIN hints ON h = regexp_replace(lower(tot.column_name),'[- ]','_','g')")


@query("d08_classify_columns", _classify_sql())
def _(spark, sf):
    return D.classify_columns(docs(spark, sf))


def doc_json(spark, sf):
    """A nested document per record: the text inside an object and again inside an array."""
    return docs(spark, sf).select("doc_id", F.to_json(F.struct(
        F.struct(F.col("lang"), F.col("text").alias("content")).alias("body"),
        F.array(F.struct(F.col("source").alias("name"), F.col("text").alias("copy"))).alias("parts"),
        F.col("n_chars"),
    )).alias("json"))


_JSON_LEAVES = """leaves AS (SELECT doc_id, 'body.lang' AS path, lang AS leaf FROM documents
  UNION ALL SELECT doc_id, 'body.content', text FROM documents
  UNION ALL SELECT doc_id, 'parts.[0].name', source FROM documents
  UNION ALL SELECT doc_id, 'parts.[0].copy', text FROM documents)"""


@query("d09_detect_json", f"WITH RECURSIVE {_JSON_LEAVES}, " + det_ctes("leaves", "doc_id, path", "leaf", CANON)
       + " SELECT doc_id, path, pii_type, pattern, start_pos, end_pos, value FROM det")
def _(spark, sf):
    return D.detect_json(doc_json(spark, sf), "json", ["doc_id"]).select(
        "doc_id", "path", "pii_type", "pattern", "start_pos", "end_pos", "value")


_TOKEN = Pattern("quoted_token", "credentials", r'token = "[0-9a-f]{16,}', 0.88, CRITICAL)
_WITH_TOKEN = [*CANON, _TOKEN]


@query("d10_register_pattern", "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", _WITH_TOKEN) + f" SELECT {COLS} FROM det")
def _(spark, sf):
    return found(spark, sf, D.DetectConfig(extra_patterns=(_TOKEN,)))


@query("d11_detection_stats", f"""{DOC_DET}, cats(pii_type, category) AS (VALUES {','.join(f"({q(k)},{q(v)})" for k, v in CATEGORY_OF_TYPE.items())}),
  v AS (SELECT pii_type, {'CASE ' + ' '.join(f"WHEN risk={i} THEN {q(r)}" for i, r in enumerate(RISK_LEVELS)) + ' END'} AS risk_label, category, confidence
        FROM det JOIN cats USING (pii_type))
  SELECT coalesce(pii_type,'*') AS pii_type, coalesce(risk_label,'*') AS risk_label, coalesce(category,'*') AS category, count(*) AS n,
  round(avg(confidence),6) AS avg_confidence FROM v GROUP BY GROUPING SETS ((pii_type),(risk_label),(category),())""")
def _(spark, sf):
    return D.detection_stats(found(spark, sf))


@query("d12_detect_chunked", f"{DOC_CAND} SELECT {COLS} FROM cand")
def _(spark, sf):
    return D.detect_chunked(docs(spark, sf), "text", ["doc_id"], size=4000, overlap=1000)


@query("d13_categorise", f"""{DOC_DET}, cats(pii_type, category) AS (VALUES {','.join(f"({q(k)},{q(v)})" for k, v in CATEGORY_OF_TYPE.items())}),
  risks(category, default_risk) AS (VALUES {','.join(f"({q(k)},{v})" for k, v in RISK_OF_CATEGORY.items())})
  SELECT doc_id, start_pos, pii_type, category, default_risk FROM det JOIN cats USING (pii_type) JOIN risks USING (category)""")
def _(spark, sf):
    return D.categorise(found(spark, sf)).select("doc_id", "start_pos", "pii_type", "category", "default_risk")


def allowlist(spark, sf):
    """Entries derived from the data: the most common address of each mail domain exactly,
    one /8 network by regex; one entry is inactive and one has expired."""
    mails = found(spark, sf).filter("pii_type = 'email'").groupBy(F.substring_index("value", "@", -1).alias("dom")).agg(F.min("value").alias("pattern"))
    exact = mails.select(F.lit("exact").alias("kind"), "pattern", F.lit("email").alias("pii_type"),
                         (~F.col("dom").startswith("mail1.")).alias("active"), F.lit(None).cast("timestamp").alias("expires_at"))
    rules = spark.sql("""SELECT * FROM VALUES
      ('regex', '^2[0-9]{2}[.]', 'ip_address', true, CAST(NULL AS TIMESTAMP)),
      ('regex', '^1[0-9]{2}[.]', 'ip_address', true, TIMESTAMP '2020-01-01 00:00:00'),
      ('regex', '555-1', CAST(NULL AS STRING), true, TIMESTAMP '2099-01-01 00:00:00')
      AS t(kind, pattern, pii_type, active, expires_at)""")
    return exact.unionByName(rules)


@query("d14_suppress_allowlist", f"""{DOC_DET}, ex AS (SELECT min(value) AS pattern, split_part(value,'@',2) AS dom FROM det WHERE pii_type='email' GROUP BY dom)
  SELECT {COLS} FROM det WHERE NOT (pii_type='email' AND value IN (SELECT pattern FROM ex WHERE NOT starts_with(dom,'mail1.')))
  AND NOT (pii_type='ip_address' AND regexp_matches(value,'^2[0-9]{{2}}[.]')) AND NOT regexp_matches(value,'555-1')""")
def _(spark, sf):
    return D.suppress_allowlist(found(spark, sf), allowlist(spark, sf), F.lit("2025-01-01").cast("timestamp"))


_STATUS = """, cnt AS (SELECT doc_id, count(*) AS c FROM det GROUP BY doc_id), st AS (SELECT doc_id, source,
  CASE WHEN text IS NULL THEN 'failed' WHEN coalesce(c,0) > 0 THEN 'detected' ELSE 'clean' END AS pii_status, coalesce(c,0) AS entities
  FROM documents LEFT JOIN cnt USING (doc_id))"""


@query("d15_record_pii_status", f"{DOC_DET}{_STATUS} SELECT doc_id, pii_status, entities FROM st")
def _(spark, sf):
    return D.record_status(docs(spark, sf), "text", ["doc_id"])


@query("d15_dataset_counters", f"{DOC_DET}{_STATUS} SELECT source, count(*) AS records, count(*) FILTER (pii_status='detected') AS with_pii, CAST(sum(entities) AS BIGINT) AS entities FROM st GROUP BY source")
def _(spark, sf):
    return D.dataset_counters(D.record_status(docs(spark, sf), "text", ["doc_id", "source"]), "source")


@query("d16_route_by_pii", f"""{DOC_DET}, m AS (SELECT doc_id, max(CASE WHEN risk >= 3 AND pii_type NOT IN ('password','api_key') THEN 3
   WHEN pii_type IN ('password','api_key') THEN 2 WHEN risk >= 1 THEN 1 ELSE 0 END) AS lvl FROM det GROUP BY doc_id)
   SELECT doc_id, CASE WHEN lvl IS NULL THEN 'passed' WHEN lvl=3 THEN 'rejected' WHEN lvl=2 THEN 'quarantined' WHEN lvl=1 THEN 'flagged' ELSE 'anonymised' END AS route
   FROM documents LEFT JOIN m USING (doc_id)""")
def _(spark, sf):
    spans = D.with_spans(docs(spark, sf).select("doc_id", "text"), "text")
    return spans.select("doc_id", D.route(spans, CANON).alias("route"))


_INV = "SELECT source, 'text' AS field, doc_id, text FROM documents UNION ALL SELECT 'pages', 'html', page_id, html FROM pages"


@query("d17_pii_inventory", f"WITH RECURSIVE src AS ({_INV}), " + det_ctes("src", "source, field, doc_id", "text", CANON) + """,
   vals AS (SELECT DISTINCT source, field, pii_type, value FROM det),
   top AS (SELECT *, row_number() OVER (PARTITION BY source, field, pii_type ORDER BY value) AS r FROM vals),
   shown AS (SELECT source, field, pii_type, string_agg(value, '|' ORDER BY value) AS samples FROM top WHERE r <= 3 GROUP BY ALL)
   SELECT source, field, pii_type, count(*) AS hits, count(DISTINCT doc_id) AS records, max(risk) AS max_risk,
   round(sum((risk+1)*confidence),6) AS score, any_value(samples) AS samples FROM det JOIN shown USING (source, field, pii_type) GROUP BY ALL""")
def _(spark, sf):
    a = docs(spark, sf).select("source", F.lit("text").alias("field"), "doc_id", "text")
    b = spread(table(spark, sf, "pages")).select(F.lit("pages").alias("source"), F.lit("html").alias("field"), F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    hits = D.detect(a.unionByName(b), "text", ["source", "field", "doc_id"])
    return D.pii_inventory(hits, "source", "field", "doc_id")


for _p in ("engine", "agent", "service", "cli", "catalogue"):
    @query(f"d18_profile_{_p}", "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", PROFILES[_p], where="true") + f" SELECT {COLS} FROM det")
    def _(spark, sf, name=_p):
        return found(spark, sf, D.DetectConfig(profile=name, min_confidence=0.0))


@query("d19_merge_detectors", "WITH RECURSIVE " + det_ctes("documents", "doc_id", "text", CANON).replace("pat(", "pat1(", 1).replace("JOIN pat USING", "JOIN pat1 USING").replace("pat.", "pat1.")
       + ", kw AS (" + _by_kw_sql().replace("WITH hits", "WITH khits").replace("FROM hits", "FROM khits") + """),
   both_rows AS (SELECT doc_id, start_pos, end_pos, pii_type, pattern, value, confidence, risk FROM det
     UNION ALL SELECT doc_id, start_pos, end_pos, pii_type, 'keyword:'||keyword, value, confidence, risk FROM kw),
   rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, confidence DESC, end_pos, pii_type, pattern) AS rn FROM both_rows),
   sc AS (SELECT doc_id, rn, end_pos AS last_end, confidence AS conf, 1 AS slot, true AS taken FROM rk WHERE rn=1
     UNION ALL SELECT s.doc_id, r.rn, CASE WHEN r.start_pos >= s.last_end OR r.confidence > s.conf THEN r.end_pos ELSE s.last_end END,
     CASE WHEN r.start_pos >= s.last_end OR r.confidence > s.conf THEN r.confidence ELSE s.conf END,
     CASE WHEN r.start_pos >= s.last_end THEN s.slot+1 ELSE s.slot END, r.start_pos >= s.last_end OR r.confidence > s.conf
     FROM sc s JOIN rk r ON r.doc_id = s.doc_id AND r.rn = s.rn+1)
   SELECT """ + COLS + " FROM rk JOIN (SELECT doc_id, slot, max(rn) AS rn FROM sc WHERE taken GROUP BY ALL) k USING (doc_id, rn)")
def _(spark, sf):
    def by_keyword(df):
        hits = D.detect_by_keyword(df, "text", ["doc_id"])
        return hits.withColumn("pattern", F.concat(F.lit("keyword:"), "keyword")).select(*COLS.split(", "))

    return D.detect(docs(spark, sf), "text", ["doc_id"], detectors=(by_keyword,)).select(*COLS.split(", "))
