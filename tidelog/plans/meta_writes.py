"""Registered queries: writes that bring their metadata, locks, touches, kept expiry, whole-document edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import attributes, scalars, subdoc
from tidelog.model import AS_OF, mutations, spread
from tidelog.operators import reads, sessions, with_meta, writes
from tidelog.plans.registry import query

#: An operation for every event: its own metadata, moved a little, against the newest version of its document.
_OPS_SQL = """, o AS (SELECT event_id AS op_id, cid, key, cas - (event_id % 3 - 1) * 65536 * 1000000 AS cas, rev + event_id % 3 AS rev, exptime, event_id % 5 AS flags,
        event_id % 2 = 0 AS has_xattr, event_id % 7 <> 0 AS check_conflicts, event_id % 11 <> 0 AS forced, event_id % 13 = 0 AS regenerate_cas, us * 1000 AS new_cas FROM m),
    s AS (SELECT cid, key, cas AS e_cas, rev AS e_rev, exptime AS e_exptime, flags AS e_flags, seqno % 2 = 0 AS e_xattr, deleted AS e_deleted,
        NOT deleted AND NOT (exptime <> 0 AND exptime < 1706000000) AS alive FROM newest)"""


def _ops(spark: SparkSession, d: str, strategy: str) -> tuple[DataFrame, DataFrame]:
    log, e = mutations(spark, d), F.col("event_id")
    forced = e % 11 != 0
    ops = log.select(e.alias("op_id"), "cid", "key", (F.col("cas") - (e % 3 - 1) * 65536 * 1000000).alias("cas"), (F.col("rev") + e % 3).alias("rev"), "exptime", (e % 5).alias("flags"), (e % 2 == 0).alias("has_xattr"), (e % 7 != 0).alias("check_conflicts"), (forced if strategy == "lww" else ~forced).alias("force_accept"), (e % 13 == 0).alias("regenerate_cas"), (F.col("us") * 1000).alias("new_cas"))
    return ops, reads.latest(log).withColumn("has_xattr", F.col("seqno") % 2 == 0)


def _outcome_sql(fields: str, delete: bool, existing: str = "FALSE") -> str:
    names = fields.split()[: 2 if delete else 4]
    mine, theirs = ", ".join(names), ", ".join(f"e_{n}" for n in names)
    xattr = "" if delete else " OR (has_xattr AND NOT e_xattr AND row(" + mine + ") = row(" + theirs + "))"
    return f"""{_OPS_SQL}, v AS (SELECT *, CASE WHEN regenerate_cas AND check_conflicts OR NOT forced THEN 'invalid_arguments' WHEN coalesce({existing}, FALSE) THEN 'key_already_exists'
            WHEN NOT check_conflicts OR e_{names[0]} IS NULL OR row({mine}) > row({theirs}){xattr} THEN 'success' ELSE 'key_already_exists' END AS status FROM o LEFT JOIN s USING (cid, key))
    SELECT op_id, cid, key, status, CASE WHEN status = 'success' THEN CASE WHEN regenerate_cas THEN new_cas ELSE cas END ELSE e_cas END AS cas, CASE WHEN status = 'success' THEN rev ELSE e_rev END AS rev,
        CASE WHEN status = 'success' THEN exptime ELSE e_exptime END AS exptime, CASE WHEN status = 'success' THEN flags ELSE e_flags END AS flags, CASE WHEN status = 'success' THEN {str(delete).upper()} ELSE e_deleted END AS deleted FROM v"""


@query("meta_set_lww", _outcome_sql("cas rev exptime flags", False))
def meta_set_lww(spark, d):
    ops, state = _ops(spark, d, "lww")
    return with_meta.write(ops, state, "lww", AS_OF)


@query("meta_set_rev", _outcome_sql("rev cas exptime flags", False))
def meta_set_rev(spark, d):
    ops, state = _ops(spark, d, "rev")
    return with_meta.write(ops, state, "rev", AS_OF)


@query("meta_add", _outcome_sql("cas rev exptime flags", False, "alive"))
def meta_add(spark, d):
    ops, state = _ops(spark, d, "lww")
    return with_meta.write(ops, state, "lww", AS_OF, allow_existing=False)


@query("meta_delete", _outcome_sql("rev cas exptime flags", True))
def meta_delete(spark, d):
    ops, state = _ops(spark, d, "rev")
    return with_meta.write(ops, state, "rev", AS_OF, delete=True)


@query(
    "meta_mutate",
    """, b AS (SELECT event_id, cas, seqno, '{"c":"' || repeat('x', 18) || '","s":"' || repeat('y', 18) || '"}' AS value, event_id % 10 <> 0 AS fits FROM m)
    SELECT event_id, CASE WHEN fits THEN 'success' ELSE 'invalid_arguments' END AS status,
        CASE WHEN fits THEN '{"c":"0x' || lpad(to_hex(cas), 16, '0') || '","s":"0x' || lpad(to_hex(seqno), 16, '0') || '"}' ELSE value END AS value FROM (SELECT event_id, cas, seqno, value, fits FROM b)""".replace("lpad(to_hex(cas), 16, '0')", "lower(lpad(to_hex(cas), 16, '0'))").replace("lpad(to_hex(seqno), 16, '0')", "lower(lpad(to_hex(seqno), 16, '0'))"),
)
def meta_mutate(spark, d):
    body = '{"c":"' + "x" * 18 + '","s":"' + "y" * 18 + '"}'
    ops = mutations(spark, d).select("event_id", "cas", "seqno", F.lit(body).alias("value"), F.array(F.lit(6)).alias("cas_offsets"), F.array(F.when(F.col("event_id") % 10 == 0, 40).otherwise(31)).alias("seqno_offsets"))
    return with_meta.mutate(ops).select("event_id", "status", "value")


@query("write_prepend", "SELECT cid, key, string_agg(event_type, '' ORDER BY seqno DESC) AS value FROM m GROUP BY cid, key")
def write_prepend(spark, d):
    return writes.appended(mutations(spark, d).select("cid", "key", "seqno", F.col("event_type").alias("value")), before=True)


@query(
    "write_unlock",
    """, o AS (SELECT event_id AS op_id, cid, key, cas AS op_cas FROM m), s AS (SELECT cid, key, cas AS have, NOT deleted AND NOT (exptime <> 0 AND exptime < 1706000000) AS alive,
        CASE WHEN seqno % 3 <> 0 AND 1706000000 + seqno % 5 - 2 > 1706000000 THEN cas END AS locked_cas FROM newest)
    SELECT op_id, cid, key, CASE WHEN have IS NULL OR NOT alive THEN 'no_such_key' WHEN locked_cas IS NULL THEN 'not_locked' WHEN op_cas <> locked_cas THEN 'locked_temporary_failure' ELSE 'success' END AS status FROM o LEFT JOIN s USING (cid, key)""",
)
def write_unlock(spark, d):
    log = mutations(spark, d)
    state = reads.latest(log).withColumn("locked_cas", F.when(F.col("seqno") % 3 != 0, F.col("cas"))).withColumn("locked_until", F.lit(AS_OF) + F.col("seqno") % 5 - 2)
    return writes.unlock(log.select(F.col("event_id").alias("op_id"), "cid", "key", F.col("cas").alias("op_cas")), state, AS_OF).select("op_id", "cid", "key", "status")


@query(
    "write_get_and_touch",
    """, o AS (SELECT event_id AS op_id, cid, key, CASE WHEN event_id % 2 = 0 THEN 1706000000 + event_id % 1000 ELSE exptime END AS to_exptime FROM m)
    SELECT op_id, cid, key, CASE WHEN rev IS NULL THEN 'no_such_key' ELSE 'success' END AS status, value, CASE WHEN rev IS NOT NULL THEN to_exptime END AS exptime, rev + CASE WHEN to_exptime <> exptime THEN 1 ELSE 0 END AS rev
    FROM o LEFT JOIN (SELECT cid, key, value, rev, exptime FROM cur) c USING (cid, key)""",
)
def write_get_and_touch(spark, d):
    log = mutations(spark, d)
    ops = log.select(F.col("event_id").alias("op_id"), "cid", "key", F.when(F.col("event_id") % 2 == 0, F.lit(AS_OF) + F.col("event_id") % 1000).otherwise(F.col("exptime")).alias("exptime"))
    return writes.get_and_touch(ops, reads.latest(log), AS_OF)


@query(
    "write_kept_expiry",
    """, f AS (SELECT *, coalesce(lag(deleted) OVER w, TRUE) AS fresh FROM m WINDOW w AS (PARTITION BY vb, cid, key ORDER BY seqno)),
    l AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY vb, cid, key ORDER BY seqno) AS life FROM f)
    SELECT event_id, last_value(CASE WHEN event_type <> 'click' OR fresh THEN exptime END IGNORE NULLS) OVER (PARTITION BY vb, cid, key, life ORDER BY seqno) AS exptime FROM l""",
)
def write_kept_expiry(spark, d):
    return writes.kept_expiry(mutations(spark, d), F.col("event_type") == "click").select("event_id", "exptime")


@query("write_seeded_revisions")
def write_seeded_revisions(spark, d):
    return sessions.seeded_revisions(mutations(spark, d)).select("vb", "seqno", "key", "rev")


@query(
    "subdoc_document_flags",
    """, s AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS doc, event_id % 3 = 0 AS dead, event_id % 32 AS f FROM m),
    t AS (SELECT *, f & 1 <> 0 AS mk, f & 2 <> 0 AS ad, f & 4 <> 0 AS see, f & 8 <> 0 AS mkdel, f & 16 <> 0 AS rv FROM s),
    u AS (SELECT *, doc IS NOT NULL AND (NOT dead OR see) AS seen FROM t)
    SELECT event_id, CASE WHEN mk AND ad OR mkdel AND NOT (mk OR ad) OR rv AND mkdel THEN 'invalid_arguments' WHEN rv AND doc IS NOT NULL AND NOT dead THEN 'cannot_revive_living'
        WHEN seen AND ad THEN 'key_already_exists' WHEN NOT seen AND NOT (mk OR ad) THEN 'no_such_key' WHEN NOT seen THEN 'made' ELSE 'success' END AS status FROM u""",
)
def subdoc_document_flags(spark, d):
    e = F.col("event_id")
    rows = mutations(spark, d).select("event_id", F.when(e % 4 != 0, F.col("value")).alias("doc"), (e % 3 == 0).alias("dead"), (e % 32).cast("int").alias("f"))
    return rows.select("event_id", subdoc.document_status(F.col("doc"), F.col("dead"), F.col("f")).alias("status"))


@query(
    "subdoc_whole_document",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"new":1}' WHEN 2 THEN '{"a":' || event_id::VARCHAR || '}' END AS doc, event_id % 3 = 1 AS deleted FROM m""",
)
def subdoc_whole_document(spark, d):
    e = F.col("event_id")
    rows = spread(mutations(spark, d).select("event_id"), "event_id").select("event_id", F.concat(F.lit('{"a":'), e.cast("string"), F.lit("}")).alias("doc"))
    ops = F.when(e % 3 == 0, F.array(subdoc.operation("set_doc", "", '{"new":1}'))).when(e % 3 == 1, F.array(subdoc.operation("delete_doc", ""))).otherwise(F.array(subdoc.operation("exists", "a")))
    return rows.select("event_id", subdoc.edit_document(F.col("doc"), F.lit(False), F.lit(0), ops).alias("r")).select("event_id", "r.doc", "r.deleted")


@query("subdoc_add_delete", """SELECT event_id, '{"a":' || event_id::VARCHAR || ',"c":{"d":[0,1]}}' AS doc FROM m""")
def subdoc_add_delete(spark, d):
    """add, delete, push_first, insert and replace in one list, all or nothing."""
    rows = spread(mutations(spark, d).select("event_id"), "event_id").select("event_id", F.concat(F.lit('{"a":0,"b":'), F.col("event_id").cast("string"), F.lit("}")).alias("doc"))
    ops = F.array(subdoc.operation("replace", "a", F.get_json_object("doc", "$.b")), subdoc.operation("delete", "b"), subdoc.operation("add", "c.d", "[1]", subdoc.MAKE_PARENTS), subdoc.operation("push_first", "c.d", "7"), subdoc.operation("insert", "c.d[0]", "0"), subdoc.operation("delete", "c.d[1]"))
    return rows.select("event_id", subdoc.fold(F.col("doc"), ops)["doc"].alias("doc"))


@query("xattr_replace_body", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'path_missing' END AS status, CASE WHEN event_id % 2 = 0 THEN event_type ELSE value END AS value FROM m")
def xattr_replace_body(spark, d):
    kept = F.create_map(F.when(F.col("event_id") % 2 == 0, "draft").otherwise("other"), F.col("event_type"))
    status, body = attributes.body_from(F.col("value"), kept, "draft")
    return mutations(spark, d).select("event_id", status.alias("status"), body.alias("value"))


@query("xattr_document_macros", """SELECT event_id, '{"was":"' || cas::VARCHAR || '","rev":"' || rev::VARCHAR || '"}' AS value FROM m""")
def xattr_document_macros(spark, d):
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    value = attributes.expand_document(F.lit('{"was":"${$document.CAS}","rev":"${$document.revid}"}'), {"CAS": quoted("cas"), "revid": quoted("rev")})
    return mutations(spark, d).select("event_id", value.alias("value"))


@query("fn_leb128", """, p AS (SELECT event_id, event_id * 37 AS number FROM m)
    SELECT event_id, number, lower(CASE WHEN number < 128 THEN printf('%02x', number) WHEN number < 16384 THEN printf('%02x%02x', number % 128 + 128, number // 128)
        WHEN number < 2097152 THEN printf('%02x%02x%02x', number % 128 + 128, number // 128 % 128 + 128, number // 16384)
        ELSE printf('%02x%02x%02x%02x', number % 128 + 128, number // 128 % 128 + 128, number // 16384 % 128 + 128, number // 2097152) END) AS encoded, number AS decoded FROM p""")
def fn_leb128(spark, d):
    rows = mutations(spark, d).select("event_id", (F.col("event_id") * 37).alias("number")).withColumn("encoded", scalars.leb128(F.col("number")))
    return rows.withColumn("decoded", scalars.from_leb128(F.col("encoded")))
