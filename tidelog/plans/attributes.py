"""Registered queries: extended attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import attributes
from tidelog.model import mutations
from tidelog.plans.registry import query


def _attributes():
    return F.create_map(F.lit("_sync"), F.col("value"), F.lit("user"), F.col("event_type"), F.lit("_x"), F.col("key"))


@query("xattr_key_rules", "SELECT path, length(k) BETWEEN 1 AND 15 AND NOT regexp_matches(k, '^[^A-Za-z0-9_$]') AND k NOT IN ('_', '$') AS valid FROM (SELECT *, regexp_extract(path, '^([^.\\[]*)', 1) AS k FROM (SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN '_' WHEN 1 THEN '$doc.x' WHEN 2 THEN '#a' WHEN 3 THEN event_type || '[0]' WHEN 4 THEN '.a' ELSE 'a_very_long_key_name' || key END AS path FROM m))")
def xattr_key_rules(spark, d):
    r = F.pmod("event_id", F.lit(6))
    path = F.when(r == 0, "_").when(r == 1, "$doc.x").when(r == 2, "#a").when(r == 3, F.concat("event_type", F.lit("[0]"))).when(r == 4, ".a").otherwise(F.concat(F.lit("a_very_long_key_name"), "key"))
    return mutations(spark, d).select(path.alias("path")).distinct().select("path", attributes.valid_key(F.col("path")).alias("valid"))


@query("xattr_macros", """SELECT event_id, '{"c":"0x' || array_to_string(list_transform(range(8), lambda k: substr(h, 15 - 2 * k::INTEGER, 2)), '') || '","s":"0x' || lpad(lower(to_hex(seqno)), 16, '0') || '"}' AS value FROM (SELECT *, lpad(lower(to_hex(cas)), 16, '0') AS h FROM m)""")
def xattr_macros(spark, d):
    value = F.lit('{"c":"${Mutation.CAS}","s":"${Mutation.seqno}"}')
    return mutations(spark, d).select("event_id", attributes.expand(value, F.col("cas"), F.col("seqno")).alias("value"))


@query("xattr_sizes", "SELECT event_id, (7 + strlen(value) + strlen(key))::BIGINT AS system, (4 + strlen(event_type))::BIGINT AS user_bytes FROM m")
def xattr_sizes(spark, d):
    return mutations(spark, d).select("event_id", attributes.sizes(_attributes()).alias("s")).select("event_id", "s.system", F.col("s.user").alias("user_bytes"))


@query("xattr_contents", "SELECT event_id, '_sync,_x,user' AS every, 'user' AS visible, 'b64:' || to_base64(encode(value)) AS body FROM m")
def xattr_contents(spark, d):
    a = _attributes()
    return mutations(spark, d).select("event_id", F.array_join(attributes.contents(a), ",").alias("every"), F.array_join(attributes.contents(a, system=False), ",").alias("visible"), attributes.as_text(F.col("value").cast("binary"), "b64:").alias("body"))
