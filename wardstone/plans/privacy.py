"""Privacy-model queries over customers, orders, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy as K
from ..session import table
from .anonymization import hexn
from .registry import query

QI = ["c_nationkey", "c_mktsegment", "band"]
CUST = "cust AS (SELECT *, floor(c_acctbal/2500)::INT AS band FROM customer)"
CLS = CUST + ", cls AS (SELECT c_nationkey, c_mktsegment, band, count(*) AS class_size FROM cust GROUP BY ALL)"


def cust(spark, sf):
    return table(spark, sf, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 2500).cast("int"))


@query("k01_equivalence_classes", f"WITH {CLS} SELECT * FROM cls")
def _(spark, sf):
    return K.equivalence_classes(cust(spark, sf), QI)


@query("k02_k_anonymity", f"WITH {CLS} SELECT c_custkey, class_size, class_size >= 5 AS safe FROM cust JOIN cls USING (c_nationkey, c_mktsegment, band)")
def _(spark, sf):
    return K.k_anonymity(cust(spark, sf), QI, 5).select("c_custkey", "class_size", "safe")


@query("k02_achieved_k", f"WITH {CLS} SELECT min(class_size) AS achieved_k, count(*) AS classes, coalesce(sum(class_size) FILTER (class_size>=5),0)::BIGINT AS safe_rows, coalesce(sum(class_size) FILTER (class_size<5),0)::BIGINT AS unsafe_rows FROM cls")
def _(spark, sf):
    return K.achieved_k(cust(spark, sf), QI, 5)


HIER = {
    "c_nationkey": [lambda c: c, lambda c: F.floor(c / 5).cast("int"), lambda c: F.lit(0)],
    "c_mktsegment": [lambda c: c, lambda c: F.lit("*")],
    "band": [lambda c: c, lambda c: F.floor(c / 2).cast("int"), lambda c: F.lit(0)],
}
_GEN = {
    "c_nationkey": ["c_nationkey", "floor(c_nationkey/5)::INT", "0"],
    "c_mktsegment": ["c_mktsegment", "'*'"],
    "band": ["band", "floor(band/2)::INT", "0"],
}


def _k03_sql(k=10, share=0.02):
    parts = []
    for i, n in enumerate(K.lattice(HIER)):
        cols = ", ".join(f"{_GEN[c][lvl]} AS {c}" for (c, _), lvl in zip(HIER.items(), n))
        parts.append(f"SELECT {i} AS node, c_custkey, {cols} FROM cust")
    return (f"WITH {CUST}, g AS ({' UNION ALL '.join(parts)}), "
            "s AS (SELECT *, count(*) OVER (PARTITION BY node, c_nationkey, c_mktsegment, band) AS class_size FROM g), "
            f"best AS (SELECT min(node) AS node FROM (SELECT node FROM s GROUP BY node HAVING count(*) FILTER (class_size < {k}) <= {share}*count(*))) "
            f"SELECT c_custkey, c_nationkey, c_mktsegment, band, class_size FROM s WHERE node = (SELECT node FROM best) AND class_size >= {k}")


@query("k03_k_anonymise", _k03_sql())
def _(spark, sf):
    out = K.k_anonymise(cust(spark, sf), HIER, 10, 0.02)
    return out.select("c_custkey", *HIER, "class_size")


PRIO = """sens AS (SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(mode_p,'none') AS prio FROM customer LEFT JOIN (
   SELECT o_custkey, arg_max(o_orderpriority, (n, o_orderpriority)) AS mode_p FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey) m ON m.o_custkey = c_custkey)"""


def sens(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    mode = n.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("m"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return c.join(mode, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", F.coalesce("m", F.lit("none")).alias("prio"))


QI2 = ["c_nationkey", "c_mktsegment"]


@query("k04_l_diversity", f"""WITH {PRIO}, per AS (SELECT c_nationkey, c_mktsegment, prio, count(*) AS c FROM sens GROUP BY ALL),
   a AS (SELECT c_nationkey, c_mktsegment, sum(c)::BIGINT AS class_size, count(*) AS distinct_values, ln(sum(c)) - sum(c*ln(c))/sum(c) AS e FROM per GROUP BY ALL)
   SELECT c_nationkey, c_mktsegment, class_size, distinct_values, round(exp(e),6) AS entropy_diversity, distinct_values >= 3 AS distinct_ok, exp(e) >= 3-1e-9 AS entropy_ok FROM a""")
def _(spark, sf):
    return K.l_diversity(sens(spark, sf), QI2, "prio", 3)


@query("k05_t_closeness", f"""WITH {PRIO}, cls AS (SELECT c_nationkey, c_mktsegment, count(*) AS class_size FROM sens GROUP BY ALL),
   w AS (SELECT prio, count(*)/(SELECT count(*) FROM sens)::DOUBLE AS p FROM sens GROUP BY prio),
   grid AS (SELECT c_nationkey, c_mktsegment, class_size, w.prio, p FROM cls, w),
   per AS (SELECT c_nationkey, c_mktsegment, prio, count(*) AS c FROM sens GROUP BY ALL),
   d AS (SELECT c_nationkey, c_mktsegment, any_value(class_size) AS class_size, sum(abs(coalesce(c,0)/class_size - p))/2 AS dist FROM grid LEFT JOIN per USING (c_nationkey, c_mktsegment, prio) GROUP BY ALL)
   SELECT c_nationkey, c_mktsegment, class_size, round(dist,6) AS distance, dist <= 0.2+1e-9 AS close FROM d""")
def _(spark, sf):
    return K.t_closeness(sens(spark, sf), QI2, "prio", 0.2)


@query("k05_t_closeness_ordered", """WITH c AS (SELECT c_nationkey, c_mktsegment, least(greatest(floor((c_acctbal+1000)/1100)::INT,0),9) AS b FROM customer),
   cls AS (SELECT c_nationkey, c_mktsegment, count(*) AS class_size FROM c GROUP BY ALL), w AS (SELECT r.b, count(c.b)/(SELECT count(*) FROM c)::DOUBLE AS p FROM (SELECT unnest(range(10)) AS b) r LEFT JOIN c USING (b) GROUP BY r.b),
   grid AS (SELECT * FROM cls, w), per AS (SELECT c_nationkey, c_mktsegment, b, count(*) AS n FROM c GROUP BY ALL),
   g AS (SELECT grid.c_nationkey, grid.c_mktsegment, class_size, grid.b, sum(coalesce(n,0)/class_size - p) OVER (PARTITION BY grid.c_nationkey, grid.c_mktsegment ORDER BY grid.b) AS cum FROM grid LEFT JOIN per ON per.c_nationkey=grid.c_nationkey AND per.c_mktsegment=grid.c_mktsegment AND per.b=grid.b),
   d AS (SELECT c_nationkey, c_mktsegment, any_value(class_size) AS class_size, sum(abs(cum))/9 AS dist FROM g GROUP BY c_nationkey, c_mktsegment)
   SELECT c_nationkey, c_mktsegment, class_size, round(dist,6) AS distance, dist <= 0.1+1e-9 AS close FROM d""")
def _(spark, sf):
    b = F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 1100).cast("int"), F.lit(0)), F.lit(9))
    return K.t_closeness_ordered(table(spark, sf, "customer"), QI2, b, 10, 0.1)


@query("k06_information_loss", f"WITH {CLS}, n AS (SELECT count(*) AS n FROM customer) SELECT (coalesce(sum(class_size*class_size) FILTER (class_size>=3),0) + coalesce(sum(class_size) FILTER (class_size<3),0)*any_value(n))::BIGINT AS discernibility, coalesce(sum(class_size) FILTER (class_size<3),0)::BIGINT AS suppressed, 0.833333::DOUBLE AS precision FROM cls, n")
def _(spark, sf):
    c = cust(spark, sf)
    kept = K.k_anonymity(c, QI, 3).filter("safe")
    return K.information_loss(kept, QI, c.agg(F.count("*").alias("n")), {"c_nationkey": (0, 2), "c_mktsegment": (0, 1), "band": (1, 2)})


@query("k07_reid_risk", f"WITH {CLS} SELECT round(sum(1.0/class_size)::DOUBLE/sum(class_size),9) AS prosecutor, round(count(*) FILTER (class_size=1)/sum(class_size)::DOUBLE,9) AS journalist, round(sum(1.0/class_size)::DOUBLE/count(*),9) AS marketer FROM cls")
def _(spark, sf):
    return K.reid_risk(cust(spark, sf), QI)


def _u(key):
    return f"({hexn(f'sha256({key})', 1, 13)}/4503599627370496.0::DOUBLE)"


def _lap(key, scale):
    return f"(-sign({_u(key)}-0.5)*ln(1-2*abs({_u(key)}-0.5))*{scale})"


def _gau(key, sigma):
    a, b = _u(key + "||'|a'"), _u(key + "||'|b'")
    return f"(sqrt(-2*ln(1-{a}))*cos(2*3.141592653589793::DOUBLE*{b})*{sigma})"


def _dp_sql(noise_c, noise_s):
    c, s = f"(c + {noise_c})", f"(s + {noise_s})"
    return (f"WITH a AS (SELECT o_orderpriority, count(*) AS c, sum(greatest(least(o_totalprice,400000.0),0.0))::DOUBLE AS s, 'r1|'||o_orderpriority AS k FROM orders GROUP BY o_orderpriority) "
            f"SELECT o_orderpriority, round({c},4) AS noisy_count, round({s},2) AS noisy_sum, round(greatest(least({s}/greatest({c},1.0),400000.0),0.0),4) AS noisy_mean FROM a")


@query("k08_dp_aggregate_laplace", _dp_sql(_lap("k||'|count'", "(1.0::DOUBLE/0.5)"), _lap("k||'|sum'", "(400000.0::DOUBLE/0.5)")))
def _(spark, sf):
    return K.dp_aggregate(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", 1.0, (0.0, 400000.0), "r1")


@query("k08_dp_aggregate_gaussian", _dp_sql(_gau("k||'|count'", repr(K.gaussian_sigma(1.0, 0.5, 5e-6)) + "::DOUBLE"),
                                            _gau("k||'|sum'", repr(K.gaussian_sigma(400000.0, 0.5, 5e-6)) + "::DOUBLE")))
def _(spark, sf):
    return K.dp_aggregate(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", 1.0, (0.0, 400000.0), "r1", "gaussian")


@query("k09_dp_values", f"""WITH a AS (SELECT p_partkey, p_size + {_lap("p_partkey::VARCHAR", "2.0::DOUBLE")} AS x, 10000 + p_partkey + {_lap("p_partkey::VARCHAR", "2.0::DOUBLE")} AS z FROM part)
   SELECT p_partkey, printf('%.0f', greatest(x,0.0::DOUBLE)) AS age, lpad(greatest(trunc(z),0)::BIGINT::VARCHAR,5,'0') AS zip, '[DP_PROTECTED]' AS other FROM a""")
def _(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", K.dp_value(F.col("p_size").cast("string"), F.lit("age"), k, 0.5).alias("age"),
        K.dp_value((k + 10000).cast("string"), F.lit("zip_code"), k, 0.5).alias("zip"),
        K.dp_value(F.col("p_brand"), F.lit("name"), k, 0.5).alias("other"))


def _ledger_sql(cost, budget):
    return f"""WITH RECURSIVE r AS (SELECT event_id, event_type, (1 + user_id % 4)/10.0::DOUBLE AS eps, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
      s AS (SELECT event_type, 0::BIGINT AS rn, 0::BIGINT AS event_id, 0::BIGINT AS total, 0::BIGINT AS k, false AS accepted, 0::BIGINT AS charged_micro FROM r GROUP BY event_type
        UNION ALL SELECT s.event_type, r.rn, r.event_id, CASE WHEN s.total + {cost} <= {budget} THEN s.total + {cost} ELSE s.total END,
          CASE WHEN s.total + {cost} <= {budget} THEN s.k + 1 ELSE s.k END, s.total + {cost} <= {budget}, CASE WHEN s.total + {cost} <= {budget} THEN {cost} ELSE 0 END
        FROM s JOIN r ON r.event_type = s.event_type AND r.rn = s.rn + 1)
      SELECT event_id, accepted, charged_micro FROM s WHERE rn > 0"""


def _requests(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "event_type", ((1 + F.col("user_id") % 4) / 10.0).alias("eps"))


@query("k10_privacy_ledger_basic", _ledger_sql("round(r.eps*1e6)::BIGINT", 40000000))
def _(spark, sf):
    out = K.privacy_ledger(_requests(spark, sf), "event_type", ["ts", "event_id"], "eps", None, 40.0)
    return out.select("event_id", "accepted", "charged_micro")


@query("k10_privacy_ledger_advanced", _ledger_sql("round(r.eps*sqrt(2*(s.k+1)*11.512925464970229::DOUBLE)*1e6)::BIGINT", 900000000))
def _(spark, sf):
    out = K.privacy_ledger(_requests(spark, sf), "event_type", ["ts", "event_id"], "eps", None, 900.0, "advanced")
    return out.select("event_id", "accepted", "charged_micro")


@query("k10_privacy_ledger_zero_concentrated", _ledger_sql("round(r.eps*1e6)::BIGINT", 25000000))
def _(spark, sf):
    out = K.privacy_ledger(_requests(spark, sf), "event_type", ["ts", "event_id"], "eps", None, 25.0, "zero_concentrated")
    return out.select("event_id", "accepted", "charged_micro")
