"""Anonymization queries: strategies on detected values, whole-text rewriting, tokens, fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strategies as R
from ..functions.strategies import LABELS, NAMES, FIRST_NAMES, LAST_NAMES, MAIL_DOMAINS
from ..operators import anonymize as A, detect as D
from ..session import table
from .detection import docs, found
from .pii_sql import DOC_DET, DOC_DET_RAW, q
from .registry import query

DG = "regexp_replace(value,'[^0-9]','','g')"
MASK = f"""(CASE WHEN pii_type='credit_card' AND length({DG})>=4 THEN array_to_string(list_transform(range(1, length(value)+1),
  lambda i: CASE WHEN regexp_matches(substr(value,i,1),'[0-9]') AND length(regexp_replace(substr(value,i+1),'[^0-9]','','g'))>=4 THEN '*' ELSE substr(value,i,1) END),'')
 WHEN pii_type='ssn' AND length({DG})>=4 THEN '***-**-'||right({DG},4)
 WHEN pii_type='email' AND strpos(value,'@')>0 THEN (CASE WHEN strpos(value,'@')-1<=2 THEN repeat('*',strpos(value,'@')-1)
   ELSE left(value,1)||repeat('*',strpos(value,'@')-3)||substr(value,strpos(value,'@')-1,1) END)||substr(value,strpos(value,'@'))
 WHEN pii_type='phone' AND length({DG})>=6 THEN array_to_string(list_transform(range(1, length(value)+1),
  lambda i: CASE WHEN regexp_matches(substr(value,i,1),'[0-9]') AND length(regexp_replace(substr(value,1,i-1),'[^0-9]','','g'))>=3
     AND length(regexp_replace(substr(value,i+1),'[^0-9]','','g'))>=2 THEN '*' ELSE substr(value,i,1) END),'')
 ELSE repeat('*', length(value)) END)"""
H = "sha256(value)"


def hexn(h, start, n):
    return f"(('0x'||substr({h},{start},{n}))::UBIGINT::BIGINT)"


HD = f"regexp_replace({H},'[^0-9]','','g')"


def pick_sql(options, idx):
    return f"([{','.join(q(o) for o in options)}])[({idx}) % {len(options)} + 1]"


SUBST = f"""(CASE WHEN pii_type='email' THEN 'user'||left({H},8)||'@example.com'
 WHEN pii_type='phone' THEN (CASE WHEN length({HD})>=7 THEN '555-'||substr({HD},1,3)||'-'||substr({HD},4,4)
    ELSE '555-000-'||lpad(({hexn(H, 1, 4)} % 10000)::VARCHAR,4,'0') END)
 WHEN pii_type='name' THEN {pick_sql(NAMES, hexn(H, 1, 2))}
 WHEN pii_type='address' THEN ({hexn(H, 1, 3)} % 900 + 100)::VARCHAR||' Main St, Anytown, ST 00000' ELSE '[REDACTED]' END)"""
TOKEN = f"('TOK_'||left({H},16))"
GEN_DOB = "(CASE WHEN pii_type='date_of_birth' AND regexp_matches(value,'(19|20)[0-9]{2}') THEN regexp_extract(value,'((?:19|20)[0-9]{2})',1) ELSE '[REDACTED]' END)"
REPL = {"mask": MASK, "substitute": SUBST, "redact": "'[REDACTED]'", "tokenize": TOKEN, "hash": H, "remove": "''",
        "generalize": GEN_DOB, "none": "value"}


def vals(spark, sf):
    return found(spark, sf).select("doc_id", "start_pos", "pii_type", "value")


def per_value(name, expr_sql, expr):
    @query(name, f"{DOC_DET} SELECT doc_id, start_pos, pii_type, {expr_sql} AS replacement FROM det")
    def _(spark, sf):
        return vals(spark, sf).select("doc_id", "start_pos", "pii_type", expr(F.col("value"), F.col("pii_type")).alias("replacement"))


LABEL_SQL = "(CASE " + " ".join(f"WHEN pii_type={q(k)} THEN {q(v)}" for k, v in LABELS.items()) + " ELSE repeat('*',length(value)) END)"
per_value("a01_mask", MASK, R.mask)
per_value("a02_mask_label", LABEL_SQL, R.mask_label)
per_value("a02_mask_partial", "(CASE WHEN length(value)>8 THEN left(value,4)||repeat('*',length(value)-8)||right(value,4) ELSE repeat('*',length(value)) END)", lambda v, t: R.mask_partial(v))
per_value("a02_mask_cli", """(CASE WHEN pii_type='email' THEN left(value,1)||repeat('*',strpos(value,'@')-2)||'@'||split_part(value,'@',2)
  WHEN pii_type IN ('phone','ssn','credit_card') THEN array_to_string(list_transform(range(1,length(value)+1), lambda i:
    CASE WHEN regexp_matches(substr(value,i,5),'^[0-9]{5}$') THEN '*' ELSE substr(value,i,1) END),'')
  ELSE repeat('*',length(value)) END)""", R.mask_cli)
per_value("a03_redact", "'[REDACTED]'||'|'||'['||upper(pii_type)||'_REDACTED]'||'|'||'['||replace(upper(pii_type),'_',' ')||' REMOVED]'",
          lambda v, t: F.concat_ws("|", R.redact(t), R.redact(t, "typed"), R.redact(t, "removed")))
per_value("a04_substitute", SUBST, R.substitute)


def _synth_sql():
    h = "sha256(value||'s1')"
    a, b, c, d = (hexn(h, 1 + 8 * i, 8) for i in range(4))
    t12 = f"lpad(({hexn(h, 1, 12)} % 1000000000000)::VARCHAR,12,'0')"
    return f"""(CASE WHEN pii_type='email' THEN 'user_'||left({h},7)||'@'||{pick_sql(MAIL_DOMAINS, a)}
      WHEN pii_type='phone' THEN '(555) '||({a}%900+100)::VARCHAR||'-'||({b}%9000+1000)::VARCHAR
      WHEN pii_type='name' THEN {pick_sql(FIRST_NAMES, a)}||' '||{pick_sql(LAST_NAMES, b)}
      WHEN pii_type='credit_card' THEN '4111-'||substr({t12},1,4)||'-'||substr({t12},5,4)||'-'||substr({t12},9,4)
      WHEN pii_type='ip_address' THEN ({a}%223+1)::VARCHAR||'.'||({b}%256)::VARCHAR||'.'||({c}%256)::VARCHAR||'.'||({d}%256)::VARCHAR
      ELSE 'SYNTH_'||upper(left({h},8)) END)"""


per_value("a05_synthesize", _synth_sql(), lambda v, t: R.synthesize(v, t, "s1"))
per_value("a06_tokenize", f"{TOKEN}||' '||upper(pii_type)||'_TOKEN_'||left({H},16)", lambda v, t: F.concat_ws(" ", R.tokenize(v), R.tokenize(v, pii_type=t)))
per_value("a09_hash_value", "sha256(value)||' '||sha256(value||'pepper'||'salt')||' '||'HASH_'||left(sha256('salt'||value),16)",
          lambda v, t: F.concat_ws(" ", R.hash_value(v), R.hash_value(v, salt="salt", pepper="pepper"),
                                   R.hash_value(v, salt="salt", salt_first=True, truncate_to=16)))
per_value("a11_remove", "''", lambda v, t: R.STRATEGIES["remove"](v, t))
per_value("a13_truncate", "(CASE WHEN length(value)>3 THEN left(value,3)||'...' ELSE value END)", lambda v, t: R.truncate(v))

KEY = b"0123456789abcdef"
def now():
    return F.lit("2025-06-01").cast("timestamp")



def vault(spark, sf):
    return A.build_token_vault(vals(spark, sf), KEY, F.lit("2025-01-01").cast("timestamp"))


@query("a06_build_token_vault", f"{DOC_DET} SELECT {TOKEN} AS token, min(pii_type) AS pii_type, DATE '2026-01-01' AS expires_at, value AS opened, 0::BIGINT AS access_count FROM det GROUP BY value")
def _(spark, sf):
    return vault(spark, sf).select("token", "pii_type", "expires_at", R.decrypt(F.col("sealed"), KEY).alias("opened"), "access_count")


TOKENIZED = A.Config(default_strategy="tokenize")


def spliced(pick_sql_expr, extra="", det=DOC_DET, key="doc_id"):
    """Documents with every detection replaced by an expression, as SQL."""
    return f"""{det}{extra}, rep AS (SELECT {key}, start_pos, end_pos, {pick_sql_expr} AS replacement, lag(end_pos,1,0) OVER (PARTITION BY {key} ORDER BY start_pos) AS prev FROM det),
      cut AS (SELECT {key}, string_agg(substr(text, prev+1, start_pos-prev)||replacement, '' ORDER BY start_pos) AS head, max(end_pos) AS last_end FROM rep JOIN documents USING ({key}) GROUP BY {key})"""


@query("a07_detokenize", "SELECT doc_id, text, coalesce(n,0) AS restored, 0::BIGINT AS errors FROM documents LEFT JOIN ("
       + f"{DOC_DET} SELECT doc_id, count(*) AS n FROM det GROUP BY doc_id) USING (doc_id)")
def _(spark, sf):
    hidden = A.anonymize(docs(spark, sf).select("doc_id", "text"), "text", TOKENIZED).select("doc_id", "text")
    return A.detokenize(hidden, "text", ["doc_id"], vault(spark, sf), KEY, now())


@query("a08_vault_cleanup", f"{DOC_DET} SELECT {TOKEN} AS token FROM det WHERE pii_type <> 'ip_address' GROUP BY value")
def _(spark, sf):
    v = vault(spark, sf)
    gone = v.filter("pii_type = 'ip_address'").select("token")
    return A.vault_cleanup(v, now(), gone).select("token")


_PAD = b"pseudonym-key".ljust(64, b"\0")
_INNER, _OUTER = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()


def hmac_sql(expr, inner=_INNER, outer=_OUTER):
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({expr}))))"


@query("a10_pseudonymise", f"SELECT c_custkey, {hmac_sql('c_name')} AS pseudonym FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.hmac_sha256(F.col("c_name"), "pseudonym-key").alias("pseudonym"))


@query("a12_generalize", f"""{DOC_DET} SELECT doc_id, start_pos,
   CASE WHEN pii_type='ip_address' AND len(string_split(value,'.'))=4 THEN split_part(value,'.',1)||'.'||split_part(value,'.',2)||'.'||split_part(value,'.',3)||'.*' ELSE '['||upper(pii_type)||' GENERALIZED]' END AS level0,
   CASE WHEN pii_type='ip_address' AND len(string_split(value,'.'))=4 THEN split_part(value,'.',1)||'.'||split_part(value,'.',2)||'.*.*' ELSE '['||upper(pii_type)||' GENERALIZED]' END AS level1,
   CASE WHEN pii_type='ip_address' THEN '[IP GENERALIZED]' ELSE '['||upper(pii_type)||' GENERALIZED]' END AS level9 FROM det""")
def _(spark, sf):
    v, t = F.col("value"), F.col("pii_type")
    return vals(spark, sf).select("doc_id", "start_pos", *[R.generalize(v, t, n).alias(f"level{n}") for n in (0, 1, 9)])


@query("a12_generalize_tables", """SELECT o_orderkey, strftime(o_orderdate,'%Y') AS year, 'Year: '||strftime(o_orderdate,'%Y') AS dob0,
   (floor(year(o_orderdate)/10)*10)::INT::VARCHAR||'s' AS dob1,
   (floor(o_totalprice/1000)*1000)::BIGINT::VARCHAR||'-'||(floor(o_totalprice/1000)*1000+1000)::BIGINT::VARCHAR AS price_range,
   CASE WHEN o_custkey%100<=17 THEN '0-17' WHEN o_custkey%100<=24 THEN '18-24' WHEN o_custkey%100<=34 THEN '25-34' WHEN o_custkey%100<=44 THEN '35-44'
        WHEN o_custkey%100<=54 THEN '45-54' WHEN o_custkey%100<=64 THEN '55-64' WHEN o_custkey%100<=74 THEN '65-74' ELSE '75+' END AS band,
   (floor((o_custkey%100)/5)*5)::INT::VARCHAR||'-'||(floor((o_custkey%100)/5)*5+4)::INT::VARCHAR AS age0,
   CASE WHEN o_custkey%100<18 THEN 'Minor' ELSE 'Adult' END AS age2,
   left(lpad(o_orderkey::VARCHAR,5,'0'),3)||'**' AS zip0 FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    age = (F.col("o_custkey") % 100).cast("string")
    zip_ = F.lpad(F.col("o_orderkey").cast("string"), 5, "0")
    kind = F.lit
    return o.select(
        "o_orderkey", R.year_of(date).alias("year"),
        R.generalize(date, kind("date_of_birth"), 0).alias("dob0"), R.generalize(date, kind("date_of_birth"), 1).alias("dob1"),
        R.number_range(F.col("o_totalprice"), 1000.0).alias("price_range"), R.age_band(age).alias("band"),
        R.generalize(age, kind("age"), 0).alias("age0"), R.generalize(age, kind("age"), 2).alias("age2"),
        R.generalize(zip_, kind("zip_code"), 0).alias("zip0"))


def strat_sql(mapping, default):
    return "(CASE pii_type " + " ".join(f"WHEN {q(t)} THEN {q(s)}" for t, s in mapping) + f" ELSE {q(default)} END)"


def repl_sql(mapping, default):
    return "(CASE pii_type " + " ".join(f"WHEN {q(t)} THEN {REPL[s]}" for t, s in mapping) + f" ELSE {REPL[default]} END)"


OUT_TEXT = "coalesce(head||substr(text,last_end+1), text)"


DEFAULT_SQL_TEXT = spliced(repl_sql(A.DEFAULT_STRATEGIES, "mask")) + f" SELECT doc_id, {OUT_TEXT} AS text FROM documents LEFT JOIN cut USING (doc_id)"


@query("a14_rewrite", spliced("'[REDACTED]'") + f" SELECT doc_id, {OUT_TEXT} AS text FROM documents LEFT JOIN cut USING (doc_id)")
def _(spark, sf):
    spans = D.with_spans(docs(spark, sf).select("doc_id", "text"), "text")
    reps = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[REDACTED]").alias("replacement")))
    return spans.select("doc_id", A.rewrite(F.col("text"), reps).alias("text"))


@query("a15_anonymize_json", spliced(repl_sql(A.DEFAULT_STRATEGIES, "mask"))
       + f" SELECT doc_id, to_json(struct_pack(body := struct_pack(lang := lang, content := {OUT_TEXT}), parts := [struct_pack(name := source, n := n_chars)]))::VARCHAR AS json FROM documents LEFT JOIN cut USING (doc_id)")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", F.to_json(F.struct(
        F.struct("lang", F.col("text").alias("content")).alias("body"),
        F.array(F.struct(F.col("source").alias("name"), F.col("n_chars").alias("n"))).alias("parts"))).alias("json"))
    return A.anonymize_json(d, "json")


@query("a16_shuffle", """WITH a AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('0|to|'||c_custkey), c_custkey) AS p FROM customer),
   b AS (SELECT c_acctbal, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('0|from|'||c_custkey), c_custkey) AS p FROM customer)
   SELECT c_custkey, c_nationkey, c_acctbal FROM a JOIN b USING (c_nationkey, p)""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return A.shuffle_column(c, "c_acctbal", "c_custkey", ["c_nationkey"])


@query("a17_add_noise", f"SELECT c_custkey, round(c_acctbal*(1+({hexn('sha256(c_custkey::VARCHAR)', 1, 13)}/4503599627370496.0::DOUBLE)*0.2-0.1),2) AS noisy FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.add_noise(F.col("c_acctbal"), F.col("c_custkey")).alias("noisy"))


LAYERED = A.Config(
    default_strategy="redact",
    per_type=(("phone", "mask"),),
    policies=(
        A.Policy("base", rules=(A.Rule(("email",), "hash", 0.9), A.Rule(("credit_card",), "mask", 0.99),
                                A.Rule(("ip_address",), "remove", 0.9, context_rules=(("^src1", "tokenize"),), exceptions=("^22",)))),
        A.Policy("fields", priority=5, field_rules=(A.FieldRule("src0*", "none"), A.FieldRule("^src[34]$", "substitute", True))),
        A.Policy("off", enabled=False, priority=9, rules=(A.Rule(("email",), "none"),)),
    ),
)
_LAYER = """(CASE WHEN regexp_matches(source,'^src0.*$') THEN 'none' WHEN regexp_matches(source,'^src[34]$') THEN 'substitute'
  WHEN pii_type='ip_address' AND regexp_matches(source,'^src1') THEN 'tokenize' WHEN pii_type='email' AND confidence>=0.9 THEN 'hash'
  WHEN pii_type='credit_card' AND confidence>=0.99 THEN 'mask' WHEN pii_type='ip_address' AND confidence>=0.9 THEN 'remove'
  WHEN pii_type='phone' THEN 'mask' ELSE 'redact' END)"""


@query("a18_resolve_strategy", f"{DOC_DET} SELECT doc_id, start_pos, pii_type, {_LAYER} AS strategy FROM det JOIN documents USING (doc_id)")
def _(spark, sf):
    hits = D.detect(docs(spark, sf), "text", ["doc_id", "source"])
    return hits.select("doc_id", "start_pos", "pii_type",
                       A.strategy_for(LAYERED, F.col("pii_type"), F.col("confidence"), F.col("source"), F.col("source")).alias("strategy"))


@query("a19_policy_exceptions", f"{DOC_DET} SELECT doc_id, start_pos, pii_type, value FROM det WHERE NOT (pii_type='ip_address' AND regexp_matches(value,'^22'))")
def _(spark, sf):
    v = vals(spark, sf)
    return v.filter(~A.is_exception(LAYERED, F.col("pii_type"), F.col("value")))


def _preset_sql(name):
    c = A.PRESETS[name]
    where = {"hipaa": "confidence >= 0.3", "pci_dss": "confidence >= 0.5 AND risk >= 2"}.get(name, "confidence >= 0.5")
    det = DOC_DET_RAW.replace("AND true)", f"AND {where})")
    return spliced(repl_sql(c.per_type, c.default_strategy), det=det) + f" SELECT doc_id, {OUT_TEXT} AS text FROM documents LEFT JOIN cut USING (doc_id)"


for _preset in ("gdpr", "hipaa", "pci_dss"):
    @query(f"a20_preset_{_preset}", _preset_sql(_preset))
    def _(spark, sf, name=_preset):
        return A.anonymize(docs(spark, sf).select("doc_id", "text"), "text", A.PRESETS[name]).select("doc_id", "text")


def anonymized(spark, sf, **kw):
    return A.anonymize(docs(spark, sf).select("doc_id", "text"), "text", A.DEFAULT, **kw)


@query("a21_anonymize", spliced(repl_sql(A.DEFAULT_STRATEGIES, "mask"), extra=", n AS (SELECT doc_id, count(*) AS c FROM det GROUP BY doc_id)")
       + f" SELECT doc_id, text AS original_text, {OUT_TEXT} AS text, coalesce(c,0) AS replaced FROM documents LEFT JOIN cut USING (doc_id) LEFT JOIN n USING (doc_id)")
def _(spark, sf):
    return anonymized(spark, sf, keep_original=True).select("doc_id", "original_text", "text", F.size("annotations").alias("replaced"))


@query("a21_annotations", f"{DOC_DET} SELECT doc_id, start_pos, end_pos, pii_type, confidence, {strat_sql(A.DEFAULT_STRATEGIES, 'mask')} AS strategy, {repl_sql(A.DEFAULT_STRATEGIES, 'mask')} AS replacement FROM det")
def _(spark, sf):
    return A.annotations(anonymized(spark, sf), ["doc_id"])


@query("a22_anonymization_stats", spliced(repl_sql(A.DEFAULT_STRATEGIES, "mask")) + f""", o AS (SELECT sum(length(text))::BIGINT AS input_length, sum(length({OUT_TEXT}))::BIGINT AS output_length FROM documents LEFT JOIN cut USING (doc_id)),
   z AS (SELECT pii_type, {strat_sql(A.DEFAULT_STRATEGIES, 'mask')} AS strategy, confidence FROM det)
   SELECT coalesce(pii_type,'*') AS pii_type, coalesce(strategy,'*') AS strategy, count(*) AS found, count(*) AS replaced, round(avg(confidence),6) AS avg_confidence,
   any_value(input_length) AS input_length, any_value(output_length) AS output_length FROM z, o GROUP BY GROUPING SETS ((pii_type),(strategy),())""")
def _(spark, sf):
    return A.anonymization_stats(anonymized(spark, sf), "text")


NEW_KEY = b"fedcba9876543210"


def accounts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.struct("c_name", "c_mktsegment").alias("person"))


@query("a23_encrypt_fields", "SELECT c_custkey, c_name AS opened, c_mktsegment AS untouched, true AS sealed, true AS wrong_key_fails FROM customer")
def _(spark, sf):
    sealed = A.encrypt_fields(accounts(spark, sf), ["person.c_name"], KEY, "customer")
    return sealed.select(
        "c_custkey", R.decrypt(F.col("person.c_name"), KEY, "customer").alias("opened"), F.col("person.c_mktsegment").alias("untouched"),
        F.col("person.c_name").startswith("ENC:").alias("sealed"), R.decrypt(F.col("person.c_name"), NEW_KEY, "customer").isNull().alias("wrong_key_fails"))


@query("a24_rotate_key", "SELECT c_custkey, c_name AS opened, true AS old_key_fails FROM customer")
def _(spark, sf):
    sealed = A.encrypt_fields(accounts(spark, sf), ["person.c_name"], KEY)
    turned = A.rotate_key(sealed, ["person.c_name"], KEY, NEW_KEY)
    return turned.select("c_custkey", R.decrypt(F.col("person.c_name"), NEW_KEY).alias("opened"), R.decrypt(F.col("person.c_name"), KEY).isNull().alias("old_key_fails"))


_REDACT_ALL = A.Config(default_strategy="redact")


@query("a25_residual_scan", f"{DOC_DET} SELECT doc_id, count(det.doc_id)::INT AS replaced, 0 AS left_over, 0 AS verbatim, false AS second_pass_changes FROM documents LEFT JOIN det USING (doc_id) GROUP BY documents.doc_id, doc_id")
def _(spark, sf):
    hidden = A.anonymize(docs(spark, sf).select("doc_id", "text"), "text", _REDACT_ALL, keep_value=True)
    return A.residual_scan(hidden, "text", ["doc_id"], _REDACT_ALL)
