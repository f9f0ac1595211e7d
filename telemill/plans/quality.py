"""Contracts, data quality, fingerprints and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import bit_distance, on_days, round_half
from telemill.functions.canonical import MODULUS, hash_sql
from telemill.operators import contracts as dq
from telemill.operators import profile, reconcile
from telemill.plans.registry import ORDER, Lake, query, r, tel_sql
from telemill.plans.relational import DAYS_SQL, HOLES_SQL, joi_10
from telemill.plans.timeseries import SILVER_SQL, all_segments, silver
from telemill.sources.sinks import read_version, write_sample, write_version
from telemill.sources.scratch import scratch

col, lit = F.col, F.lit
AGREED = ["timestamp", "day", "readings", "measured", "doubtful", "pressure", "oil", "dv", "lps"]


def old_contract() -> list[dq.Promise]:
    return [("agreed columns are there", dq.has_columns(AGREED)), ("one row per slot", dq.unique("timestamp")), ("counts are not negative", dq.never(col("readings") < 0))]


def new_contract() -> list[dq.Promise]:
    return old_contract() + [
        ("no other columns", dq.no_other_columns(AGREED)),
        ("oil is in its unit", dq.aggregate_in(F.avg("oil"), 1.0, 50.0)),
        ("digital signals are 0 or 1", dq.accepted("dv", [0.0, 1.0])),
        ("day belongs to the time", dq.never(col("day") != F.to_date("timestamp"))),
        ("holes have no signals", dq.never(~col("measured") & col("oil").isNotNull())),
    ]


@query("dq_01_contract", tel_sql(f"""{SILVER_SQL}, c AS (
 SELECT 'agreed columns are there' AS promise, 0 AS offenders UNION ALL SELECT 'one row per slot', count(*) FROM (SELECT timestamp FROM silver GROUP BY timestamp HAVING count(*) > 1)
 UNION ALL SELECT 'counts are not negative', count(*) FROM silver WHERE readings < 0 UNION ALL SELECT 'no other columns', 0
 UNION ALL SELECT 'oil is in its unit', count(*) FROM (SELECT avg(oil) AS v FROM silver) WHERE v NOT BETWEEN 1 AND 50
 UNION ALL SELECT 'digital signals are 0 or 1', count(*) FROM silver WHERE dv NOT IN (0, 1)
 UNION ALL SELECT 'day belongs to the time', count(*) FROM silver WHERE day <> CAST(timestamp AS DATE)
 UNION ALL SELECT 'holes have no signals', count(*) FROM silver WHERE NOT measured AND oil IS NOT NULL)
 SELECT promise, CAST(offenders AS BIGINT) AS offenders, offenders > 0 AS broken FROM c"""))
def dq_01(k: Lake) -> DataFrame:
    return dq.check(silver(k), new_contract())


@query("dq_02_columns", "SELECT column_name AS \"column\", column_name IN ('event_id', 'ts', 'user_id', 'event_type', 'value') AS agreed FROM (DESCRIBE SELECT * FROM events)")
def dq_02(k: Lake) -> DataFrame:
    t, agreed = k.table("events"), ["event_id", "ts", "user_id", "event_type", "value"]
    extra = dq.no_other_columns(agreed)(t)
    here = dq.column_names(k.spark, t.columns)
    return here.join(extra.withColumn("_x", lit(True)), "column", "left").select("column", col("_x").isNull().alias("agreed"))


@query("dq_03_uniqueness", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1")
def dq_03(k: Lake) -> DataFrame:
    return dq.unique("o_custkey", "d")(k.table("orders").withColumn("d", F.to_date("o_orderdate")))


@query("dq_04_unit_check", tel_sql(f"SELECT {r('avg(pressure)')} AS v FROM tel HAVING avg(pressure) NOT BETWEEN 0 AND 10"))
def dq_04(k: Lake) -> DataFrame:
    return dq.aggregate_in(F.avg("pressure"), 0.0, 10.0)(k.tel).select(round_half("v", 3).alias("v"))


@query("dq_05_domain", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def dq_05(k: Lake) -> DataFrame:
    return dq.accepted("event_type", ["view", "click", "purchase"])(k.table("events")).select("event_id", "event_type")


@query("dq_06_not_negative", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def dq_06(k: Lake) -> DataFrame:
    return dq.never(col("c_acctbal") < 0)(k.table("customer")).select("c_custkey")


@query("dq_07_cross_column", tel_sql(f"{SILVER_SQL} SELECT timestamp FROM silver WHERE day <> CAST(timestamp + INTERVAL 6 HOUR AS DATE) OR (NOT measured AND oil IS NOT NULL)"))
def dq_07(k: Lake) -> DataFrame:
    shifted = F.to_date(col("timestamp") + F.expr("interval 6 hours"))
    return dq.never((col("day") != shifted) | (~col("measured") & col("oil").isNotNull()))(silver(k)).select("timestamp")


@query("dq_08_not_null", tel_sql(f"{SILVER_SQL} SELECT count(*) FILTER (WHERE timestamp IS NULL) AS timestamp, count(*) FILTER (WHERE oil IS NULL) AS oil, count(*) FILTER (WHERE dv IS NULL) AS dv FROM silver"))
def dq_08(k: Lake) -> DataFrame:
    return silver(k).agg(*[F.count_if(col(c).isNull()).alias(c) for c in ("timestamp", "oil", "dv")])


CHANGES = {
    "renamed": lambda df: df.withColumnRenamed("oil", "oil_temperature"),
    "unit": lambda df: df.withColumn("oil", col("oil") * 1000),
    "extra column": lambda df: df.withColumn("note", lit("x")),
    "twice": lambda df: df.unionByName(df),
    "negative": lambda df: df.withColumn("readings", F.when(col("measured"), -col("readings")).otherwise(col("readings"))),
}


def _broken_sql(change: str, rows: str, columns: tuple[int, int], oil: str | None = "oil") -> str:
    """Promises that a change breaks, counted on its rows; ``columns``: those on names, and those that cannot run without one, of the old contract and the new."""
    old = ["(SELECT count(*) > count(DISTINCT timestamp) FROM x)", "(SELECT count(*) > 0 FROM x WHERE readings < 0)"]
    new = [*old, "(SELECT count(*) > 0 FROM x WHERE dv NOT IN (0, 1))", "(SELECT count(*) > 0 FROM x WHERE day <> CAST(timestamp AS DATE))"]
    if oil:
        new += [f"(SELECT avg({oil}) NOT BETWEEN 1 AND 50 FROM x)", f"(SELECT count(*) > 0 FROM x WHERE NOT measured AND {oil} IS NOT NULL)"]
    total = lambda n, promises: " + ".join([f"{n}::BIGINT", *[f"CAST(coalesce({q}, TRUE) AS BIGINT)" for q in promises]])
    head = f"WITH x AS ({rows}) SELECT '{change}' AS change"
    return f"SELECT * FROM ({head}, 'old' AS contract, {total(columns[0], old)} AS noticed) UNION ALL SELECT * FROM ({head}, 'new', {total(columns[1], new)})"


BREAKAGE_SQL = " UNION ALL ".join([
    _broken_sql("renamed", "SELECT * FROM silver", (1, 4), None),
    _broken_sql("unit", "SELECT * REPLACE (oil * 1000 AS oil) FROM silver", (0, 0)),
    _broken_sql("extra column", "SELECT *, 'x' AS note FROM silver", (0, 1)),
    _broken_sql("twice", "SELECT * FROM silver UNION ALL SELECT * FROM silver", (0, 0)),
    _broken_sql("negative", "SELECT * REPLACE (CASE WHEN measured THEN -readings ELSE readings END AS readings) FROM silver", (0, 0)),
])


@query("dq_09_breakage", tel_sql(f"{SILVER_SQL} {BREAKAGE_SQL}"))
def dq_09(k: Lake) -> DataFrame:
    return dq.breakage(silver(k), CHANGES, {"old": old_contract(), "new": new_contract()})


@query("dq_10_false_promise", tel_sql("SELECT nr, count(*) AS n, CAST(sum(c) AS BIGINT) AS readings FROM (SELECT nr, began, (SELECT count(*) FROM tel WHERE day = CAST(began AS DATE)) AS c FROM rep) GROUP BY nr HAVING count(*) > 1", rep=True))
def dq_10(k: Lake) -> DataFrame:
    """The promise that report numbers are unique must fail: who breaks it, with the readings of the reports' first days."""
    n = k.tel.groupBy("day").agg(F.count("*").alias("c"))
    counted = k.reports.withColumn("day", F.to_date("began")).join(n, "day", "left")
    offenders = dq.unique("nr")(k.reports)
    return offenders.join(counted.groupBy("nr").agg(F.sum("c").alias("readings")), "nr")


RULES_TEXT = ["time is known", "pressure in range", "signals agree", "oil is known"]


def rules() -> dict[str, Column]:
    return dict(zip(RULES_TEXT, (col("timestamp").isNotNull(), col("pressure").between(0, 500), col("dv") != col("comp"), col("oil").isNotNull()), strict=True))


@query("dq_11_quarantine", tel_sql("SELECT event_id, CASE WHEN pressure > 500 AND dv = comp THEN 'pressure in range,signals agree' WHEN pressure > 500 THEN 'pressure in range' ELSE 'signals agree' END AS rules FROM tel WHERE pressure > 500 OR dv = comp"))
def dq_11(k: Lake) -> DataFrame:
    _, quarantine = dq.split(k.tel, rules())
    return quarantine.select("event_id", F.array_join("broken", ",").alias("rules"))


@query("dq_11_keys", "SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)) AS orphans, (SELECT count(*) FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE n > 1) AS repeated_keys")
def dq_11_keys(k: Lake) -> DataFrame:
    parents = k.table("customer").where("c_custkey % 10 <> 0")
    lost = dq.orphans(k.table("orders"), parents.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").agg(F.count("*").alias("orphans"))
    twice = dq.key_violations(k.table("lineitem"), ["l_orderkey"]).agg(F.count_distinct("l_orderkey").alias("repeated_keys"))
    return lost.crossJoin(twice)


@query("dq_12_who_breaks", tel_sql(f"SELECT count(*) FILTER (WHERE dv = comp) AS breakers, count(*) AS readings, {r('100.0 * count(*) FILTER (WHERE dv = comp) / count(*)')} AS percent FROM tel"))
def dq_12(k: Lake) -> DataFrame:
    bad = F.count_if(col("dv") == col("comp"))
    return k.tel.agg(bad.alias("breakers"), F.count("*").alias("readings"), round_half(lit(100.0) * bad / F.count("*"), 3).alias("percent"))


@query("dq_13_errata", tel_sql("SELECT (SELECT count(*) FROM (SELECT nr FROM rep GROUP BY nr HAVING count(*) > 1)) AS repeated_numbers, count(DISTINCT failure) AS spellings, count(DISTINCT lower(failure)) AS kinds, count(*) FILTER (WHERE ended < began) AS backwards, (SELECT count(*) FROM tel WHERE day = DATE '2024-01-05') AS readings_of_first FROM rep", rep=True))
def dq_13(k: Lake) -> DataFrame:
    a = k.reports.agg(F.count_distinct("failure").alias("spellings"), F.count_distinct(F.lower("failure")).alias("kinds"), F.count_if(col("ended") < col("began")).alias("backwards"))
    twice = dq_10(k).agg(F.count("*").alias("repeated_numbers"))
    return twice.crossJoin(a).crossJoin(on_days(k.tel, "2024-01-05", "2024-01-05").agg(F.count("*").alias("readings_of_first")))


LISTED = [("timestamp", "not null"), ("pressure", "range"), ("dv", "cross"), ("comp", "cross"), ("oil", "not null")]


@query("dq_14_rules_by_column", tel_sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", 1::BIGINT AS rules, '{kind}' AS kinds, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_distinct FROM tel" for c, kind in LISTED)))
def dq_14(k: Lake) -> DataFrame:
    """Rules by column, beside what the column holds."""
    listing = dq.rule_listing(k.spark, [(c, kind, text) for (c, kind), text in zip(LISTED, [*RULES_TEXT[:3], RULES_TEXT[2], RULES_TEXT[3]], strict=True)])
    held = F.array(*[F.struct(lit(c).alias("column"), col(c).cast("string").alias("_v")) for c, _ in LISTED])
    values = k.tel.select(F.inline(held)).groupBy("column", "_v").agg(F.count_if(col("_v").isNull()).alias("_nulls"))
    return listing.join(values.groupBy("column").agg(F.sum("_nulls").alias("nulls"), F.count("_v").alias("n_distinct")), "column")


@query("dq_15_missing_days", tel_sql(f"{DAYS_SQL}, {HOLES_SQL} SELECT day FROM cal WHERE day NOT IN (SELECT day FROM held)"))
def dq_15(k: Lake) -> DataFrame:
    return joi_10(k)


# ---- fingerprints


TEL_KINDS = {"event_id": "plain", "user_id": "plain", "event_type": "plain", "timestamp": "time", "day": "date", "pressure": "number", "oil": "number", "current": "number", "dv": "number", "comp": "number", "lps": "number"}


@query("fpr_02_table_fingerprint", tel_sql(f"SELECT count(*) AS rows, CAST(sum(CAST({hash_sql(TEL_KINDS)} AS HUGEINT)) % {MODULUS} AS BIGINT) AS hash_sum FROM tel"))
def fpr_02(k: Lake) -> DataFrame:
    return reconcile.portable_fingerprint(k.tel.select(*TEL_KINDS))


@query("fpr_03_semantic", tel_sql(f"SELECT count(*) AS rows, count(*) FILTER (WHERE dv = 1) AS filtered, {r('sum(pressure)', 2)} AS sum_pressure, {r('sum(oil)', 2)} AS sum_oil, count(DISTINCT day) AS days FROM tel"))
def fpr_03(k: Lake) -> DataFrame:
    f = reconcile.semantic_fingerprint(k.tel, ["pressure", "oil"], col("dv") == 1)
    return f.withColumns({c: round_half(c, 2) for c in ("sum_pressure", "sum_oil")})


FPR_04_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", (SELECT count(*) FROM (SELECT * FROM {before} EXCEPT ALL SELECT * FROM {after})) + (SELECT count(*) FROM (SELECT * FROM {after} EXCEPT ALL SELECT * FROM {before})) = 0 AS same"
    for name, before, after in (("silver", "silver", "silver"), ("events", "events", "(SELECT * FROM events WHERE event_id > 0)"), ("orders", "orders", "(SELECT * FROM orders ORDER BY o_orderkey)"))
)


@query("fpr_04_before_after", tel_sql(f"{SILVER_SQL} {FPR_04_SQL}"))
def fpr_04(k: Lake) -> DataFrame:
    """Fingerprints before and after: one table rebuilt, one changed, one left."""

    def prints(tables: dict[str, DataFrame]) -> DataFrame:
        parts = [reconcile.fingerprint(df).select(lit(n).alias("table"), "rows", "hash_sum") for n, df in tables.items()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    before = prints({"silver": silver(k), "events": k.table("events"), "orders": k.table("orders")})
    after = prints({"silver": silver(k).repartition(7), "events": k.table("events").where("event_id > 0"), "orders": k.table("orders")})
    return reconcile.compare_fingerprints(before, after)


@query("fpr_05_hash_distance", "SELECT event_id, CAST(list_sum(list_transform(range(0, 64), lambda i: bit_count(xor(instr('0123456789abcdef', substring(sha256(CAST(event_id AS VARCHAR)), i + 1, 1)) - 1, instr('0123456789abcdef', substring(sha256(CAST(event_id + 1 AS VARCHAR)), i + 1, 1)) - 1)))) AS BIGINT) AS bits FROM events")
def fpr_05(k: Lake) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("string"), 256)
    return k.table("events").select("event_id", bit_distance(sha(col("event_id")), sha(col("event_id") + 1)).cast("bigint").alias("bits"))


# ---- reconciliation


@query("rec_01_same_rows", "SELECT (SELECT count(*) FROM (SELECT event_id, value FROM events WHERE event_id > 0 EXCEPT ALL SELECT event_id, value FROM events)) AS only_left, (SELECT count(*) FROM (SELECT event_id, value FROM events EXCEPT ALL SELECT event_id, value FROM events WHERE event_id > 0)) AS only_right")
def rec_01(k: Lake) -> DataFrame:
    e = k.table("events").select("event_id", "value")
    return reconcile.same_rows(e.where("event_id > 0"), e.repartition(3))


REC_07_SQL = "a AS (SELECT user_id, event_type, dv FROM tel), b AS (SELECT user_id, CASE WHEN event_id % 97 = 5 THEN NULL ELSE event_type END AS event_type, dv FROM tel WHERE event_id % 50 <> 7), l AS (SELECT user_id, event_type, dv, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT user_id, event_type, dv, count(*) AS n FROM b GROUP BY ALL)"


@query("rec_07_differing_rows", tel_sql(f"{REC_07_SQL}, j AS (SELECT coalesce(l.user_id, m.user_id) AS user_id, coalesce(l.event_type, m.event_type) AS event_type, coalesce(l.dv, m.dv) AS dv, coalesce(l.n, 0) - coalesce(m.n, 0) AS more FROM l FULL JOIN m ON l.user_id = m.user_id AND l.event_type IS NOT DISTINCT FROM m.event_type AND l.dv = m.dv) SELECT user_id, event_type, dv, greatest(more, 0) AS only_left, greatest(-more, 0) AS only_right FROM j WHERE more <> 0"))
def rec_07(k: Lake) -> DataFrame:
    """Two tables with repeated rows and nulls: only buckets of keys whose fingerprints differ are compared row by row."""
    a = k.tel.select("user_id", "event_type", "dv")
    b = k.tel.where("event_id % 50 <> 7").select("user_id", F.when(col("event_id") % 97 != 5, col("event_type")).alias("event_type"), "dv")
    return reconcile.differing_rows(a, b, ["user_id"], buckets=64)


DRAWN = ("2024-01-05", "2024-01-20")


def sample(k: Lake, columns: list[str], where: Column) -> DataFrame:
    """A written extract, read back."""
    path = scratch(k.spark, "sample")
    write_sample(k.tel, path, columns, where, [c for c in columns if c in ("timestamp", "event_id")])
    return k.spark.read.parquet(path)


@query("rec_02_sample_vs_lake", tel_sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'sum({c})', 2)} AS lake, {r(f'sum({c})', 2)} AS sample, count(DISTINCT {c}) AS distinct_in_sample, TRUE AS same FROM tel WHERE day BETWEEN DATE '{DRAWN[0]}' AND DATE '{DRAWN[1]}'" for c in ("pressure", "oil", "dv"))))
def rec_02(k: Lake) -> DataFrame:
    """The extract of some days, as written, against the same days of the lake."""
    of = col("day").between(*[lit(d).cast("date") for d in DRAWN])
    found = reconcile.compare_aggregates(on_days(k.tel, *DRAWN), sample(k, ["event_id", "pressure", "oil", "dv"], of), ["pressure", "oil", "dv"])
    return found.select("column", round_half("sum_a", 2).alias("lake"), round_half("sum_b", 2).alias("sample"), col("distinct_b").alias("distinct_in_sample"), "same")


@query("rec_03_headline", tel_sql(f"n AS (SELECT {r('avg(dv)', 6)} AS lake, {r('avg(dv) FILTER (WHERE event_id % 3 = 1)', 6)} AS sample FROM tel) SELECT lake, sample, abs(lake - sample) <= 0.005 AS same FROM n"))
def rec_03(k: Lake) -> DataFrame:
    """The mean load of the lake against that of a written extract of every third reading."""
    a = k.tel.agg(round_half(F.avg("dv"), 6).alias("lake"))
    b = sample(k, ["event_id", "dv"], col("event_id") % 3 == 1).agg(round_half(F.avg("dv"), 6).alias("sample"))
    return a.crossJoin(b).withColumn("same", F.abs(col("lake") - col("sample")) <= 0.005)


@query("rec_05_results_agree", tel_sql("s AS (SELECT day, dv, lag(dv) OVER (ORDER BY timestamp, event_id) AS was FROM tel), d AS (SELECT DISTINCT day FROM tel), n AS (SELECT day, count(*) AS n FROM s WHERE was = 0 AND dv = 1 GROUP BY day) SELECT d.day, coalesce(n, 0) AS by_change, coalesce(n, 0) AS by_segment, TRUE AS agree FROM d LEFT JOIN n USING (day)"))
def rec_05(k: Lake) -> DataFrame:
    """Starts of a day by two routes: changes of the state, and loaded segments that begin in it (not the record's first)."""
    change = profile.starts(k.tel, "dv", ORDER, ["day"]).select("day", col("starts").alias("starts"))
    begun = all_segments(k).where("state = 1 and segment > 1").groupBy(F.to_date("from_ts").alias("day")).agg(F.count("*").alias("starts"))
    segment = change.select("day").join(begun, "day", "left").fillna(0, ["starts"])
    off = reconcile.disagreements(change, segment, ["day"], ["starts"]).withColumn("_off", lit(True))
    j = change.withColumnRenamed("starts", "by_change").join(segment.withColumnRenamed("starts", "by_segment"), "day").join(off, "day", "left")
    return j.select("day", "by_change", "by_segment", col("_off").isNull().alias("agree"))


@query("rec_06_version_diff", tel_sql("old AS (SELECT day, CAST(sum(dv) AS BIGINT) AS v FROM tel WHERE event_id % 10 < 9 GROUP BY day), new AS (SELECT day, CAST(sum(dv) AS BIGINT) AS v FROM tel GROUP BY day) SELECT new.day, old.v AS old, new.v AS new, new.v - old.v AS change FROM old JOIN new ON old.day = new.day ORDER BY abs(new.v - old.v) DESC, new.day LIMIT 5"))
def rec_06(k: Lake) -> DataFrame:
    """Two versions of the daily cycle, the first built by a faulty filter; the days that moved most."""
    root = scratch(k.spark, "versions")
    daily = lambda t: t.groupBy("day").agg(F.sum("dv").cast("bigint").alias("v"))
    write_version(daily(k.tel.where("event_id % 10 < 9")), root)
    write_version(daily(k.tel), root)
    return reconcile.version_diff(read_version(k.spark, root, 0), read_version(k.spark, root), "day", "v", 5)
