from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.operators import features as feat
from panelwright.operators import graph as graph_op
from panelwright.operators import monthly as mo
from panelwright.operators import panel as panel_op
from panelwright.operators import quality as op
from panelwright.operators import revisions as rev
from panelwright.plans.flows import edges
from panelwright.plans.monthly import CHANGE, LATEST
from panelwright.plans.registry import query

KEYS = ["key", "mid"]
AS_OF = "2001-08-16 09:00:00"


def versions(inp):
    rows = inp.obs_versions
    return rows.filter("version = 1"), rows.filter("version = 2")


@query("duplicate_keys", """
SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INT) AS year, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(inp):
    rows = inp.orders.select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"))
    return rev.duplicate_keys(rows, ["customer", "year"])


@query("nonfinite_values", """
SELECT indicator_code, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE isnan(v)) AS nans,
  count(*) FILTER (WHERE isinf(v)) AS infinite, count(*) FILTER (WHERE isfinite(v)) AS valid
FROM (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN year % 4 = 0 THEN 'nan'::DOUBLE WHEN year % 4 = 1 AND country_code < 'N05' THEN 'inf'::DOUBLE ELSE value END AS v FROM macro_long) GROUP BY ALL""")
def nonfinite_values(inp):
    bad = F.when(F.col("value").isNull(), None).when(F.col("year") % 4 == 0, float("nan")).when(
        (F.col("year") % 4 == 1) & (F.col("country_code") < "N05"), float("inf")).otherwise(F.col("value"))
    return rev.value_defects(inp.macro_long.withColumn("value", bad), ["indicator_code"])


@query("revision_upsert", """
SELECT key, mid, CASE WHEN b.version IS NULL THEN 'kept' WHEN a.version IS NULL THEN 'inserted' WHEN a.value IS DISTINCT FROM b.value THEN 'value_revision'
  WHEN a.source_url IS DISTINCT FROM b.source_url THEN 'source_update' ELSE 'unchanged' END AS change_type,
  CASE WHEN b.version IS NOT NULL THEN a.value END AS old_value, CASE WHEN b.version IS NOT NULL THEN a.source_url END AS old_url,
  CASE WHEN b.version IS NOT NULL THEN b.value ELSE a.value END AS value, CASE WHEN b.version IS NOT NULL THEN b.source_url ELSE a.source_url END AS source_url
FROM (SELECT * FROM obs_versions WHERE version = 1) a FULL JOIN (SELECT * FROM obs_versions WHERE version = 2) b USING (key, mid)""")
def revision_upsert(inp):
    old, new = versions(inp)
    return rev.upsert(old, new, KEYS)


@query("definition_rekey", """
WITH o AS (SELECT key, mid, value, 'observation' AS kind FROM monthly_obs UNION ALL SELECT 'p5_legacy', mid, value + 1, 'observation' FROM monthly_obs WHERE key = 'p5' AND mid % 5 = 0
  UNION ALL SELECT a.key, a.mid, b.value, 'log' FROM obs_versions a JOIN obs_versions b ON a.key = b.key AND a.mid = b.mid AND a.version = 1 AND b.version = 2 WHERE a.value IS DISTINCT FROM b.value)
SELECT CASE WHEN key = 'p5' AND mid < 24000 THEN 'p5_legacy' ELSE key END AS key, mid, value, kind FROM o
WHERE NOT (kind = 'observation' AND key = 'p5' AND mid < 24000 AND EXISTS (SELECT 1 FROM o x WHERE x.key = 'p5_legacy' AND x.mid = o.mid))""")
def definition_rekey(inp):
    old, new = versions(inp)
    rows = inp.monthly_obs.select("key", "mid", "value")
    legacy = rows.filter("key = 'p5' AND mid % 5 = 0").withColumns(
        {"key": F.lit("p5_legacy"), "value": F.col("value") + 1})
    log = rev.upsert(old, new, KEYS).filter("change_type = 'value_revision'").select("key", "mid", "value")
    observations = rev.rekey(rows.unionByName(legacy), "p5", "p5_legacy", 24000).withColumn("kind", F.lit("observation"))
    return observations.unionByName(rev.rekey(log, "p5", "p5_legacy", 24000).withColumn("kind", F.lit("log")))


@query("active_versions", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ts DESC, event_id DESC) AS n FROM release_events WHERE status IN ('published', 'restored'))
SELECT a.stem, a.batch_id AS active_batch, a.status AS active_status, a.event_id, b.batch_id AS previous_batch FROM e a LEFT JOIN e b ON a.stem = b.stem AND b.n = 2 WHERE a.n = 1""")
def active_versions(inp):
    return rev.active_batches(inp.release_events)


@query("rollback_eligibility", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ts DESC, event_id DESC) AS n FROM release_events WHERE status IN ('published', 'restored')),
p AS (SELECT DISTINCT batch_id, stem FROM release_events WHERE status = 'published')
SELECT p.batch_id, count(*) AS stems, count(*) FILTER (WHERE e.batch_id = p.batch_id) AS active_stems, bool_and(e.batch_id = p.batch_id) AS eligible
FROM p JOIN e ON e.stem = p.stem AND e.n = 1 GROUP BY p.batch_id""")
def rollback_eligibility(inp):
    return rev.rollback_eligibility(inp.release_events)


@query("recent_changes", """
(SELECT 'change' AS kind, event_id, batch_id, stem, status FROM release_events WHERE status = 'published' ORDER BY event_id DESC LIMIT 20)
UNION ALL (SELECT 'run', event_id, batch_id, stem, status FROM release_events WHERE status <> 'published' ORDER BY event_id DESC LIMIT 10)""")
def recent_changes(inp):
    events = inp.release_events.select("event_id", "batch_id", "stem", "status")
    changes = events.filter("status = 'published'").orderBy(F.desc("event_id")).limit(20)
    runs = events.filter("status <> 'published'").orderBy(F.desc("event_id")).limit(10)
    return changes.withColumn("kind", F.lit("change")).unionByName(runs.withColumn("kind", F.lit("run")))


OUTER = """ov AS (SELECT key, mid, a.value AS old_value, b.value AS new_value, CASE WHEN b.version IS NULL THEN 'old only' WHEN a.version IS NULL THEN 'new only' ELSE 'both' END AS membership
  FROM (SELECT * FROM obs_versions WHERE version = 1) a FULL JOIN (SELECT * FROM obs_versions WHERE version = 2) b USING (key, mid)),
st AS (SELECT *, CASE WHEN membership = 'old only' THEN 'removed' WHEN membership = 'new only' THEN 'added' WHEN old_value IS NULL AND new_value IS NULL THEN 'unchanged'
  WHEN old_value IS NULL THEN 'new value' WHEN new_value IS NULL THEN 'became null' WHEN old_value = new_value THEN 'unchanged' ELSE 'revised' END AS status FROM ov),
sc AS (SELECT key, mid, membership, CASE WHEN mid % 13 = 0 AND membership = 'both' THEN 'scope changed' ELSE status END AS status,
  CASE WHEN status = 'revised' AND NOT (mid % 13 = 0 AND membership = 'both') THEN new_value - old_value END AS delta FROM st)"""


def outer(inp):
    old, new = versions(inp)
    return rev.version_outer(old, new, KEYS)


def scoped(inp):
    old, new = versions(inp)
    before = old.select(*KEYS, F.lit("%").alias("scope"))
    after = new.select(*KEYS, F.when(F.col("mid") % 13 == 0, "index").otherwise("%").alias("scope"))
    return rev.scope_override(rev.change_status(outer(inp)), before, after, KEYS)


@query("version_full_outer", f"WITH {OUTER} SELECT * FROM ov")
def version_full_outer(inp):
    return outer(inp)


@query("value_change_status", f"""
WITH {OUTER} SELECT key, mid, status, round(CASE WHEN status = 'revised' THEN new_value - old_value END, 6) + 0.0 AS delta FROM st""")
def value_change_status(inp):
    return rev.change_status(outer(inp)).select(*KEYS, "status", rounded("delta", 6).alias("delta"))


@query("scope_change_override", f"WITH {OUTER} SELECT key, mid, status, round(delta, 6) + 0.0 AS delta FROM sc")
def scope_change_override(inp):
    return scoped(inp).select(*KEYS, "status", rounded("delta", 6).alias("delta"))


@query("diff_summary", f"""
WITH {OUTER} SELECT key, count(*) AS rows, count(*) FILTER (WHERE status IN ('added', 'removed')) AS membership_changes,
  count(*) FILTER (WHERE status IN ('revised', 'new value', 'became null', 'scope changed')) AS value_changes, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM sc GROUP BY key""")
def diff_summary(inp):
    return rev.diff_summary(scoped(inp), ["key"])


def cell(sql):
    """A value as the fingerprint writes it: its length and itself, ``N`` for a missing one."""
    return f"coalesce(length(CAST({sql} AS VARCHAR)) || ':' || CAST({sql} AS VARCHAR), 'N')"


FP = """fp AS (SELECT {keys}, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) || ':' ||
  CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 25, 12) AS BIGINT)) AS VARCHAR) || ':' ||
  CAST(sum(CAST('0x' || substr(h, 37, 12) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 49, 12) AS BIGINT)) AS VARCHAR)) AS fingerprint FROM hr GROUP BY {keys})"""


@query("table_fingerprint", f"""
WITH hr AS (SELECT lang, source, sha256({cell('doc_id')} || {cell('text')} || {cell('n_chars')}) AS h FROM documents),
{FP.format(keys="lang, source")} SELECT * FROM fp""")
def table_fingerprint(inp):
    return rev.fingerprint(inp.documents, ["doc_id", "text", "n_chars"], ["lang", "source"])


@query("source_identity_diff", f"""
WITH hr AS (SELECT key, version, sha256({cell('mid')} || {cell('CAST(value AS DECIMAL(18, 3))')}) AS h FROM obs_versions WHERE version = 1 OR key <> 'p2'),
{FP.format(keys="key, version")}
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL THEN '1' END AS old_vintage, CASE WHEN b.key IS NOT NULL THEN '2' END AS new_vintage, a.fingerprint AS old_hash, b.fingerprint AS new_hash,
  a.fingerprint IS DISTINCT FROM b.fingerprint OR b.key IS NULL OR a.key IS NULL AS changed FROM (SELECT * FROM fp WHERE version = 1) a FULL JOIN (SELECT * FROM fp WHERE version = 2) b ON a.key = b.key""")
def source_identity_diff(inp):
    rows = inp.obs_versions.filter("version = 1 OR key <> 'p2'")
    hashes = rev.fingerprint(rows, ["mid", F.col("value").cast("decimal(18,3)")], ["key", "version"])

    def side(version, name):
        return hashes.filter(F.col("version") == version).select(
            "key", F.lit(str(version)).alias(f"{name}_vintage"), F.col("fingerprint").alias(f"{name}_hash"))

    return side(1, "old").join(side(2, "new"), "key", "full").withColumn("changed", rev.differs("old_hash", "new_hash"))


@query("peer_position_shift", """
WITH x AS (SELECT version, mid, key, value FROM obs_versions),
p AS (SELECT a.version, a.mid, a.key, a.value, count(*) AS n, count(b.value) AS observed, CASE WHEN a.value IS NOT NULL THEN 1 + count(*) FILTER (WHERE b.value > a.value) END AS rk,
  CASE WHEN a.value IS NOT NULL THEN 100.0 * (count(*) FILTER (WHERE b.value < a.value) + 0.5 * count(*) FILTER (WHERE b.value = a.value)) / count(b.value) END AS pc
  FROM x a JOIN x b ON a.version = b.version AND a.mid = b.mid GROUP BY a.version, a.mid, a.key, a.value)
SELECT key, mid, a.n AS old_n, b.n AS new_n, a.observed AS old_observed, b.observed AS new_observed, a.value AS old_value, b.value AS new_value, CAST(a.rk AS INT) AS old_rank, CAST(b.rk AS INT) AS new_rank,
  round(a.pc, 6) + 0.0 AS old_percentile, round(b.pc, 6) + 0.0 AS new_percentile FROM (SELECT * FROM p WHERE version = 1) a JOIN (SELECT * FROM p WHERE version = 2) b USING (key, mid)""")
def peer_position_shift(inp):
    from pyspark.sql import Window

    group = ["version", "mid"]
    placed = inp.obs_versions.withColumns({
        "n": F.count("*").over(Window.partitionBy(*group)), "observed": F.count("value").over(Window.partitionBy(*group)),
        "rank": panel_op.rank_desc("value", group), "percentile": rounded(panel_op.midrank("value", group), 6)})

    def side(version, name):
        return placed.filter(F.col("version") == version).select(
            *KEYS, *[F.col(c).alias(f"{name}_{c}") for c in ("n", "observed", "value", "rank", "percentile")])

    return side(1, "old").join(side(2, "new"), KEYS)


@query("line_diff", r"""
WITH o AS (SELECT doc_id, md5(unnest(string_split(text, chr(10)))) AS h FROM documents), n AS (SELECT doc_id, md5(unnest(string_split(regexp_replace(text, 'the', 'THE'), chr(10)))) AS h FROM documents),
c AS (SELECT doc_id, h, sum(b) AS b, sum(a) AS a FROM (SELECT doc_id, h, 1 AS b, 0 AS a FROM o UNION ALL SELECT doc_id, h, 0, 1 FROM n) GROUP BY ALL)
SELECT doc_id, h AS line_hash, CAST(greatest(0, b - a) AS BIGINT) AS removed, CAST(greatest(0, a - b) AS BIGINT) AS added FROM c WHERE a <> b""")
def line_diff(inp):
    # the second version capitalises the first "the" of the document
    first = F.instr("text", "the")
    edited = F.when(first > 0, F.concat(F.substring(F.col("text"), F.lit(1), first - 1), F.lit("THE"),
                                        F.substring(F.col("text"), first + 3, F.length("text")))).otherwise(F.col("text"))
    old = inp.documents.select("doc_id", "text")
    return rev.line_diff(old, old.withColumn("text", edited), "doc_id")


def _edited_documents(inp):
    """Two versions of every document: the later loses every seventh line, gains lines and has others rewritten."""
    old = inp.documents.groupBy("doc_id").agg(F.max("text").alias("text"))
    edited = F.flatten(F.transform(F.split("text", "\n"), lambda l, i: F.when((i + 1) % 7 == 4, F.array().cast("array<string>"))
                       .when((i + 1) % 5 == 2, F.array(l, F.concat(F.lit("added "), (i + 1).cast("string"))))
                       .when((i + 1) % 11 == 3, F.array(F.replace(l, F.lit("the"), F.lit("THE")))).otherwise(F.array(l))))
    return old, old.withColumn("text", F.array_join(edited, "\n"))


LATER = """
SELECT doc_id, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 7 = 4 THEN [] WHEN i % 5 = 2 THEN [l, 'added ' || i]
  WHEN i % 11 = 3 THEN [replace(l, 'the', 'THE')] ELSE [l] END)), chr(10)) AS text FROM (SELECT doc_id, max(text) AS text FROM documents GROUP BY 1)"""


@query("line_diff_script")
def line_diff_script(inp):
    # no SQL: the alignment is checked by its replay (line_diff_replay) and against brute force in the tests
    return rev.line_script(*_edited_documents(inp), "doc_id")


@query("line_diff_replay", f"SELECT doc_id, md5(text) AS text_md5, CAST(len(string_split(text, chr(10))) AS INT) AS lines FROM ({LATER})")
def line_diff_replay(inp):
    old, new = _edited_documents(inp)
    rebuilt = rev.apply_script(old, rev.line_script(old, new, "doc_id"), "doc_id")
    return rebuilt.select("doc_id", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n")).alias("lines"))


@query("partner_evidence_check", """
SELECT year, country_code, hs2, abs(export_usd - 2 * export_usd * (CASE WHEN hs2 = '09' THEN 1 ELSE 0.5 END)) <= 1e-10 * export_usd AS amount_ok,
  partner_gdp_coverage > 0 AS coverage_ok, partner_gdp IS NOT NULL AS growth_ok FROM sector_base""")
def partner_evidence_check(inp):
    stored = feat.sector_base(edges(inp), inp.macro_long).withColumn(
        "export_usd", F.when(F.col("hs2") == "09", 2 * F.col("export_usd")).otherwise(F.col("export_usd")))
    values = inp.macro_long.filter("indicator_code = 'GROWTH'").select(
        F.col("country_code").alias("partner_code"), "year", F.col("value").alias("g"))
    known = F.when(F.col("g").isNotNull(), F.col("trade_usd"))
    again = edges(inp).join(values, ["partner_code", "year"], "left").groupBy(*feat.KEYS).agg(
        F.sum("trade_usd").alias("amount"), F.sum(known).alias("k"), F.sum(F.col("trade_usd") * F.col("g")).alias("s"))
    joined = stored.join(again, feat.KEYS)
    coverage = F.coalesce(F.col("k"), F.lit(0.0)) / F.col("amount")
    return joined.select(
        *feat.KEYS, (F.abs(F.col("amount") - F.col("export_usd")) <= 1e-10 * F.col("amount")).alias("amount_ok"),
        ((coverage > 0) & (F.abs(coverage - F.col("partner_gdp_coverage")) <= 1e-10)).alias("coverage_ok"),
        F.coalesce(F.abs(F.col("s") / F.col("k") - F.col("partner_gdp")) <= 1e-9, F.lit(False)).alias("growth_ok"))


@query("typed_cell_diff", """
WITH c AS (SELECT version, key, mid, 'value' AS field, 'double' AS t, CAST(CAST(value AS DECIMAL(24, 6)) AS VARCHAR) AS x FROM obs_versions
  UNION ALL SELECT version, key, mid, 'source_url', 'string', source_url FROM obs_versions),
j AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.mid, b.mid) AS mid, coalesce(a.field, b.field) AS field, a.t AS old_type, b.t AS new_type, a.x AS old_text, b.x AS new_text
  FROM (SELECT * FROM c WHERE version = 1) a FULL JOIN (SELECT * FROM c WHERE version = 2) b ON (a.key, a.mid, a.field) = (b.key, b.mid, b.field))
SELECT *, CASE WHEN old_type IS NULL OR new_type IS NULL THEN 'missing row' ELSE 'value' END AS kind,
  CASE WHEN old_type = 'double' AND new_type = 'double' THEN round(CAST(new_text AS DOUBLE) - CAST(old_text AS DOUBLE), 6) + 0.0 END AS numeric_delta
FROM j WHERE old_type IS NULL OR new_type IS NULL OR old_text IS DISTINCT FROM new_text""")
def typed_cell_diff(inp):
    old, new = versions(inp)
    return rev.cell_diff(old, new, KEYS, ["value", "source_url"]).withColumn("numeric_delta", rounded("numeric_delta", 6))


@query("tolerance_compare", """
SELECT country_code, year, indicator_code, value IS NULL OR (year + CAST(substr(country_code, 2) AS INT)) % 3 <> 0 AS equal FROM macro_long""")
def tolerance_compare(inp):
    from pyspark.sql import functions as F

    third = (F.col("year") + F.substring("country_code", 2, 2).cast("int")) % 3
    other = F.when(third == 0, F.col("value") * (1 + 1e-6)).when(third == 1, F.col("value") * (1 + 1e-12)).otherwise(F.col("value"))
    rows = inp.macro_long.select("country_code", "year", "indicator_code", "value", other.alias("other"))
    return rows.select("country_code", "year", "indicator_code", rev.close(F.col("value"), F.col("other")).alias("equal"))


@query("normalized_fingerprint", f"""
WITH hr AS (SELECT indicator_code, sha256({cell('country_code')} || {cell('year')} || {cell('CAST(round(value, 3) + 0.0 AS DECIMAL(24, 3))')}) AS h FROM macro_long),
{FP.format(keys="indicator_code")} SELECT * FROM fp""")
def normalized_fingerprint(inp):
    grid = rounded("value", 3).cast("decimal(24,3)")
    return rev.fingerprint(inp.macro_long, ["country_code", "year", grid], ["indicator_code"])


@query("latest_revision", """
SELECT key, mid, split_part(source_url, '?', 1) AS source, max(version) AS version, arg_max(value, version) FILTER (WHERE version = (SELECT max(o.version) FROM obs_versions o WHERE o.key = v.key AND o.mid = v.mid)) AS value
FROM obs_versions v GROUP BY key, mid, split_part(source_url, '?', 1)""")
def latest_revision(inp):
    rows = inp.obs_versions.withColumn("source", F.substring_index("source_url", "?", 1))
    newest = rows.groupBy("key", "mid", "source").agg(F.max_by(F.struct("version", "value"), "version").alias("w"))
    return newest.select("key", "mid", "source", "w.version", "w.value")


@query("dedupe_last", """
SELECT key, mid, version, value, source_url FROM obs_versions v WHERE version = (SELECT max(version) FROM obs_versions o WHERE o.key = v.key AND o.mid = v.mid)""")
def dedupe_last(inp):
    rows = inp.obs_versions
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("version", "value", "source_url"), "version").alias("w"))
    return last.select(*KEYS, "w.*")


@query("stored_vs_replayed", """
WITH s AS (SELECT key, mid, CASE WHEN mid % 31 = 0 THEN value + 2 ELSE value END AS value FROM obs_versions WHERE version = 2 AND mid % 37 <> 0),
r AS (SELECT key, mid, value FROM obs_versions v WHERE version = (SELECT max(version) FROM obs_versions o WHERE o.key = v.key AND o.mid = v.mid))
SELECT coalesce(s.key, r.key) AS key, coalesce(s.mid, r.mid) AS mid, s.value AS stored, r.value AS replayed,
  CASE WHEN s.key IS NULL THEN 'missing in store' WHEN r.key IS NULL THEN 'missing in replay' WHEN s.value IS NOT DISTINCT FROM r.value THEN 'match' ELSE 'differs' END AS status
FROM s FULL JOIN r ON s.key = r.key AND s.mid = r.mid""")
def stored_vs_replayed(inp):
    _, new = versions(inp)
    stored = new.filter("mid % 37 <> 0").select(*KEYS, F.when(F.col("mid") % 31 == 0, F.col("value") + 2).otherwise(F.col("value")).alias("value"))
    joined = rev.version_outer(stored, dedupe_last(inp), KEYS)
    status = F.when(F.col("membership") == "new only", "missing in store").when(
        F.col("membership") == "old only", "missing in replay").when(
        F.col("old_value").eqNullSafe(F.col("new_value")), "match").otherwise("differs")
    return joined.select(*KEYS, F.col("old_value").alias("stored"), F.col("new_value").alias("replayed"), status.alias("status"))


@query("split_overlap", "SELECT count(DISTINCT country_code) AS groups, CAST(0 AS BIGINT) AS shared FROM macro_long")
def split_overlap(inp):
    held = inp.macro_long.select("country_code").withColumn("held", panel_op.hash_holdout(F.col("country_code")))
    train, test = held.filter("NOT held").select("country_code"), held.filter("held").select("country_code")
    one, none = F.lit(1), F.lit(0)
    return held.select("country_code").distinct().select(one.alias("g"), none.alias("s")).unionByName(
        train.intersect(test).select(none.alias("g"), one.alias("s"))).agg(
        F.sum("g").alias("groups"), F.sum("s").alias("shared"))


@query("set_contract", """
WITH e AS (SELECT y AS year, lpad(CAST(h AS VARCHAR), 2, '0') AS hs2 FROM (SELECT CAST(unnest(generate_series(1994, 2001)) AS INT) AS y) CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h)),
a AS (SELECT DISTINCT year, hs2 FROM flow_edges)
(SELECT year, hs2, 'missing' AS problem FROM e EXCEPT SELECT year, hs2, 'missing' FROM a) UNION ALL (SELECT year, hs2, 'unexpected' FROM a EXCEPT SELECT year, hs2, 'unexpected' FROM e)""")
def set_contract(inp):
    expected = inp.spark.range(1994, 2002).select(
        F.col("id").cast("int").alias("year"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda h: F.lpad(
            h.cast("string"), 2, "0"))).alias("hs2"))
    return rev.partition_contract(expected, edges(inp).select("year", "hs2").distinct())


@query("token_cost_rollup", """
WITH t AS (SELECT conv_id, count(*) AS turns, CAST(sum(len(string_split(text, ' '))) FILTER (WHERE role = 'user') AS BIGINT) AS p, CAST(sum(len(string_split(text, ' '))) FILTER (WHERE role <> 'user') AS BIGINT) AS c FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, turns, coalesce(p, 0) AS prompt_tokens, coalesce(c, 0) AS completion_tokens FROM t)
SELECT *, prompt_tokens + completion_tokens AS total_tokens, CAST(CAST((prompt_tokens * CAST(0.27 AS DECIMAL(10, 2)) + completion_tokens * CAST(1.10 AS DECIMAL(10, 2))) AS DECIMAL(24, 2)) AS VARCHAR) AS cost_per_million,
  prompt_tokens * CAST(0.27 AS DECIMAL(10, 2)) + completion_tokens * CAST(1.10 AS DECIMAL(10, 2)) > 300 AS over_cap FROM u""")
def token_cost_rollup(inp):
    words = F.size(F.split("text", " "))
    user = F.col("role") == "user"
    runs = inp.conversations.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.coalesce(F.sum(F.when(user, words)), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(~user, words)), F.lit(0)).alias("completion_tokens"))

    def rate(text):
        return F.lit(text).cast("decimal(10,2)")

    # exact decimals: USD per million tokens
    cost = F.col("prompt_tokens").cast("decimal(12,0)") * rate("0.27") + F.col("completion_tokens").cast("decimal(12,0)") * rate("1.10")
    return runs.select("*", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
                       cost.cast("decimal(24,2)").cast("string").alias("cost_per_million"), (cost > 300).alias("over_cap"))


@query("union_sources", """
WITH c AS (SELECT key, mid, value, source_title, 'overview' AS collector, 0 AS p FROM monthly_obs UNION ALL SELECT key, mid, value + 0.1, source_title, 'price', 1 FROM monthly_obs WHERE key = 'p2'
  UNION ALL SELECT key, mid, value + 0.2, NULL, 'profit', 2 FROM monthly_obs WHERE key = 'p3' AND mid % 2 = 0 UNION ALL SELECT key, mid, value + 0.3, source_title, 'survey', 3 FROM monthly_obs WHERE key IN ('p1', 'p2') AND mid % 3 = 0
  UNION ALL SELECT 'x_' || key, mid, value, NULL, 'finance', 4 FROM monthly_obs WHERE key = 'p5')
SELECT key, mid, round(value, 3) + 0.0 AS value, source_title, collector FROM c WHERE p = (SELECT max(p) FROM c d WHERE d.key = c.key AND d.mid = c.mid)""")
def union_sources(inp):
    rows = inp.monthly_obs.select("key", "mid", "value", "source_title")

    def shifted(frame, by):
        return frame.withColumn("value", F.col("value") + by)

    collectors = [
        ("overview", rows), ("price", shifted(rows.filter("key = 'p2'"), 0.1)),
        ("profit", shifted(rows.filter("key = 'p3' AND mid % 2 = 0"), 0.2).drop("source_title")),
        ("survey", shifted(rows.filter("key IN ('p1', 'p2') AND mid % 3 = 0"), 0.3)),
        ("finance", rows.filter("key = 'p5'").withColumn("key", F.concat(F.lit("x_"), "key")).drop("source_title")),
    ]
    return rev.union_by_priority(collectors, KEYS).withColumn("value", rounded("value", 3))


@query("export_observations", """
SELECT m.key, c.name, c.topic, c.basis, period, value, CASE WHEN mid % 6 = 0 THEN 'reposting office' ELSE 'statistics office' END AS source, source_title, source_url,
  CASE WHEN mid % 7 = 0 THEN NULL ELSE CAST(published AS VARCHAR) END AS published,
  CASE WHEN mid % 7 = 0 THEN 'not verified' WHEN mid % 6 = 0 THEN 'repost date' ELSE 'publication date' END AS date_kind FROM pub m JOIN catalog c ON m.key = c.key""")
def export_observations(inp):
    rows = mo.with_published(inp.monthly_obs)
    url = F.when(F.col("mid") % 6 == 0, F.replace("source_url", F.lit("stats."), F.lit("repost."))).otherwise(F.col("source_url"))
    dated = rows.withColumns({"_url": url, "published": F.when(F.col("mid") % 7 != 0, F.col("published").cast("string"))})
    repost = F.parse_url(F.col("_url"), F.lit("HOST")) == "repost.example.org"
    return dated.join(mo.catalogue(inp.monthly_obs), "key").select(
        "key", "name", "topic", "basis", "period", "value",
        F.when(repost, "reposting office").otherwise("statistics office").alias("source"), "source_title", "source_url",
        "published", F.when(F.col("published").isNull(), "not verified").when(repost, "repost date")
        .otherwise("publication date").alias("date_kind"))


@query("flatten_backtest_records", """
SELECT CASE WHEN a.mid < 24000 THEN 'development' ELSE 'audit' END AS split, a.key AS indicator, a.period, a.value AS actual, l.value AS persistence, s.value AS seasonal,
  CASE WHEN a.mid >= 24000 THEN l.value - 10 END AS p10, CASE WHEN a.mid >= 24000 THEN l.value END AS p50, CASE WHEN a.mid >= 24000 THEN l.value + 10 END AS p90
FROM monthly_obs a JOIN monthly_obs l ON l.key = a.key AND l.mid = a.mid - 1 JOIN monthly_obs s ON s.key = a.key AND s.mid = a.mid - 12""")
def flatten_backtest_records(inp):
    base = mo.simple_baselines(inp.monthly_obs).dropna(subset=["persistence", "seasonal"]).join(
        inp.monthly_obs.select(*KEYS, "period"), KEYS)
    audit = F.col("mid") >= 24000
    bands = F.when(audit, F.struct((F.col("persistence") - 10).alias("p10"), F.col("persistence").alias("p50"),
                                   (F.col("persistence") + 10).alias("p90")))
    record = F.struct(F.col("period"), F.col("value").alias("actual"), F.struct("persistence", "seasonal").alias("predictions"),
                      bands.alias("quantiles"))
    # nested reports per indicator, split and year, as a back-test would be stored
    reports = base.withColumn("split", F.when(audit, "audit").otherwise("development")).groupBy(
        "split", "key", F.floor(F.col("mid") / 12).alias("y")).agg(F.collect_list(record).alias("records"))
    return reports.select("split", F.col("key").alias("indicator"), F.explode("records").alias("r")).select(
        "split", "indicator", "r.period", "r.actual", "r.predictions.persistence", "r.predictions.seasonal",
        "r.quantiles.p10", "r.quantiles.p50", "r.quantiles.p90")


@query("csv_injection_guard", """
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '=' || text WHEN 1 THEN '  +' || text WHEN 2 THEN '-' || text ELSE text END AS text, role FROM conversations)
SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '^\\s*[=+\\-@]') THEN '''' || text ELSE text END AS text FROM t""")
def csv_injection_guard(inp):
    turn = F.col("turn") % 4
    risky = F.when(turn == 0, F.concat(F.lit("="), "text")).when(turn == 1, F.concat(F.lit("  +"), "text")).when(
        turn == 2, F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    return rev.guard_frame(inp.conversations.withColumn("text", risky).select("conv_id", "turn", "role", "text"))


DAYS = ", ".join(f"('{c}', {m}, {d})" for c, row in op.RELEASE_DAYS.items() for m, d in enumerate(row, 1) if d)
STATUS = f"""cal AS (SELECT c AS category, CAST(2001 * 12 + m - 1 - (c <> 'pmi')::INT AS INT) AS mid, make_timestamp(2001, m, d, CASE WHEN c = 'overview' THEN CASE WHEN m = 8 THEN 15 ELSE 10 END ELSE 9 END,
    CASE WHEN c = 'overview' THEN 0 ELSE 30 END, 0) AS scheduled FROM (VALUES {DAYS}) t(c, m, d) UNION ALL SELECT 'pmi', 2001 * 12 + 1, TIMESTAMP '2001-03-04 09:30:00'),
cells AS (SELECT k.key, CAST(unnest(generate_series({LATEST} - 59, {LATEST})) AS INT) AS mid FROM (SELECT DISTINCT key FROM monthly_obs) k),
cat AS (SELECT *, CASE key WHEN 'p1' THEN 'pmi' WHEN 'p2' THEN 'price' WHEN 'p3' THEN 'profit' WHEN 'p4' THEN 'overview' END AS category FROM cells),
ps AS (SELECT cat.key, cat.mid, cat.category, scheduled, CASE WHEN EXISTS (SELECT 1 FROM monthly_obs m WHERE m.key = cat.key AND m.mid = cat.mid) THEN 'recorded'
  WHEN (key = 'p4' AND cat.mid < 1996 * 12 + 5) OR (key = 'p5' AND cat.mid > 2000 * 12 + 11) THEN 'inactive'
  WHEN (key = 'p3' AND cat.mid % 12 = 0) OR (key = 'p2' AND cat.mid % 12 <= 1) THEN 'not_separate'
  WHEN TIMESTAMP '{AS_OF}' < scheduled THEN 'pending' WHEN scheduled IS NULL AND cat.mid >= 2001 * 12 + 6 THEN 'unconfirmed' ELSE 'missing' END AS status
  FROM cat LEFT JOIN cal ON cal.category = cat.category AND cal.mid = cat.mid)"""


def statuses(inp, months):
    cells = mo.trailing_spine(inp.monthly_obs, LATEST, months)
    return op.period_status(cells, inp.monthly_obs, op.release_calendar(inp.spark, 2001), AS_OF)


@query("planned_release", f"WITH {STATUS} SELECT key, mid, category, CAST(scheduled AS VARCHAR) AS scheduled FROM ps")
def planned_release(inp):
    return statuses(inp, 60).select("key", "mid", "category", F.date_format("scheduled", "yyyy-MM-dd HH:mm:ss").alias("scheduled"))


@query("period_status", f"WITH {STATUS} SELECT key, mid, status FROM ps")
def period_status(inp):
    return statuses(inp, 60).select("key", "mid", "status")


COVER = """SELECT {w} AS window_months, key, count(*) FILTER (WHERE status = 'recorded') AS observed, count(*) FILTER (WHERE status IN ('recorded', 'missing')) AS expected,
  coalesce(string_agg(lab, ',' ORDER BY lab) FILTER (WHERE status = 'missing'), '') AS missing, coalesce(string_agg(lab, ',' ORDER BY lab) FILTER (WHERE status = 'pending'), '') AS pending,
  coalesce(string_agg(lab, ',' ORDER BY lab) FILTER (WHERE status = 'unconfirmed'), '') AS unconfirmed, (SELECT {end} - max(mid) FROM monthly_obs m WHERE m.key = lb.key) AS lag_months FROM lb WHERE mid > {end} - {w} GROUP BY key
UNION ALL SELECT {w}, 'ALL', count(*) FILTER (WHERE status = 'recorded'), count(*) FILTER (WHERE status IN ('recorded', 'missing')), NULL, NULL, NULL, NULL FROM lb WHERE mid > {end} - {w}"""


@query("coverage_window", f"""
WITH {STATUS}, lb AS (SELECT *, CAST(CAST(floor(mid / 12) AS INT) AS VARCHAR) || '-' || lpad(CAST(mid % 12 + 1 AS VARCHAR), 2, '0') AS lab FROM ps),
cw AS ({COVER.format(w=24, end=LATEST)} UNION ALL {COVER.format(w=60, end=LATEST)})
SELECT CAST(window_months AS INT) AS window_months, key, observed, expected, missing, pending, unconfirmed, CAST(lag_months AS INT) AS lag_months,
  CASE WHEN expected > 0 THEN round(100.0 * observed / expected, 1) ELSE 0 END AS coverage_pct FROM cw""")
def coverage_window(inp):
    def window(months):
        return op.coverage(statuses(inp, months), inp.monthly_obs, LATEST).withColumn("window_months", F.lit(months))

    return window(24).unionByName(window(60))


@query("known_gap_reasons", f"""
WITH {STATUS}, l AS (SELECT key, mid FROM ps WHERE mid % 4 = 1)
SELECT ps.key, ps.mid, CASE WHEN ps.key IN ('p3', 'p4') AND ps.mid % 12 < 2 THEN 'only a combined January-February figure exists' WHEN ps.mid % 4 = 1 THEN 'report lists the month without a value' END AS reason
FROM ps WHERE status = 'missing'""")
def known_gap_reasons(inp):
    listed = mo.trailing_spine(inp.monthly_obs, LATEST, 60).filter("mid % 4 = 1").withColumn(
        "listed_reason", F.lit("report lists the month without a value"))
    missing = statuses(inp, 60).filter("status = 'missing'").select("key", "mid")
    return op.documented_gaps(missing, listed)


@query("observation_audit", """
WITH b AS (SELECT key || '-' || CAST(mid AS VARCHAR) AS row_id, mid, CASE WHEN mid % 41 = 0 THEN 'zz' ELSE key END AS key, CASE WHEN mid % 17 = 0 THEN substr(period, 1, 4) || '-13' ELSE period END AS period,
  CASE WHEN mid % 19 = 0 THEN 'http://stats.example.org/x' WHEN mid % 29 = 0 THEN 'https://other.example.org/x' ELSE source_url END AS url, CASE WHEN mid % 23 = 0 THEN ' ' ELSE source_title END AS title,
  CASE WHEN mid % 31 = 0 THEN 'nan'::DOUBLE WHEN mid % 37 = 0 THEN NULL ELSE value END AS value, CASE WHEN mid % 13 = 0 THEN '2001-02-30' WHEN mid % 11 = 0 THEN CAST(published + 200 AS VARCHAR) ELSE CAST(published AS VARCHAR) END AS published FROM pub)
SELECT row_id, 'error: unknown indicator' AS defect FROM b WHERE key = 'zz' UNION ALL SELECT row_id, 'error: invalid period' FROM b WHERE mid % 17 = 0
UNION ALL SELECT row_id, 'error: source host' FROM b WHERE url LIKE 'http://%' OR url LIKE '%other.example%' UNION ALL SELECT row_id, 'error: empty title' FROM b WHERE trim(title) = ''
UNION ALL SELECT row_id, 'error: not finite' FROM b WHERE value IS NULL OR isnan(value) UNION ALL SELECT row_id, 'error: outside limits' FROM b WHERE NOT isnan(value) AND (value < 200 OR value > 300)
UNION ALL SELECT row_id, 'error: publication date' FROM b WHERE mid % 13 = 0
UNION ALL SELECT row_id, 'warning: publication lag' FROM b WHERE mid % 13 <> 0 AND mid % 17 <> 0 AND year(TRY_CAST(published AS DATE)) * 12 + month(TRY_CAST(published AS DATE)) - 1 - mid NOT BETWEEN 0 AND 3""")
def observation_audit(inp):
    mid = F.col("mid")
    rows = mo.with_published(inp.monthly_obs)
    published = F.when(mid % 13 == 0, "2001-02-30").when(mid % 11 == 0, F.date_add("published", 200).cast("string")).otherwise(
        F.col("published").cast("string"))
    broken = rows.select(
        F.concat("key", F.lit("-"), mid.cast("string")).alias("row_id"),
        F.when(mid % 41 == 0, "zz").otherwise(F.col("key")).alias("key"),
        F.when(mid % 17 == 0, F.concat(F.substring("period", 1, 4), F.lit("-13"))).otherwise(F.col("period")).alias("period"),
        F.when(mid % 19 == 0, "http://stats.example.org/x").when(mid % 29 == 0, "https://other.example.org/x").otherwise(
            F.col("source_url")).alias("source_url"),
        F.when(mid % 23 == 0, " ").otherwise(F.col("source_title")).alias("source_title"),
        F.when(mid % 31 == 0, float("nan")).when(mid % 37 == 0, None).otherwise(F.col("value")).alias("value"),
        published.alias("published"))
    return op.audit_observations(broken, mo.catalogue(inp.monthly_obs), ["stats.example.org"], 200.0, 300.0)


@query("chart_detail_rows", f"""
WITH {STATUS} SELECT ps.key, ps.mid, ps.status, m.value, coalesce(m.source_url, 'status:' || ps.status) AS evidence FROM ps LEFT JOIN monthly_obs m ON m.key = ps.key AND m.mid = ps.mid WHERE ps.mid > {LATEST} - 24""")
def chart_detail_rows(inp):
    spine = mo.trailing_spine(inp.monthly_obs, LATEST, 24)
    return op.detail_rows(spine, statuses(inp, 24), inp.monthly_obs)


@query("latest_table", f"""
WITH {CHANGE}, lg AS (SELECT a.key, count(*) AS n FROM obs_versions a JOIN obs_versions b ON a.key = b.key AND a.mid = b.mid AND a.version = 1 AND b.version = 2
  WHERE a.value IS DISTINCT FROM b.value OR a.source_url IS DISTINCT FROM b.source_url GROUP BY a.key)
SELECT chx.key, name, mid, value, delta, direction, reason, coalesce(n, 0) AS revisions FROM chx LEFT JOIN lg ON lg.key = chx.key WHERE mid = (SELECT max(mid) FROM monthly_obs m WHERE m.key = chx.key)""")
def latest_table(inp):
    old, new = versions(inp)
    changes = mo.month_change(inp.monthly_obs, mo.catalogue(inp.monthly_obs))
    return op.latest_table(inp.monthly_obs, changes, rev.revision_log(old, new, KEYS))


@query("claim_evidence_orphans", """
WITH c AS (SELECT key || ':' || CAST(mid AS VARCHAR) AS claim_id, unnest(['obs:' || key || ':' || CAST(mid AS VARCHAR), 'obs:' || key || ':' || CAST(mid - 1 AS VARCHAR)]) AS evidence_id FROM monthly_obs)
SELECT claim_id, evidence_id FROM c WHERE evidence_id NOT IN (SELECT 'obs:' || key || ':' || CAST(mid AS VARCHAR) FROM monthly_obs)""")
def claim_evidence_orphans(inp):
    def evidence(mid):
        return F.concat_ws(":", F.lit("obs"), "key", mid.cast("string"))

    claims = inp.monthly_obs.select(
        F.concat_ws(":", "key", F.col("mid").cast("string")).alias("claim_id"),
        F.explode(F.array(evidence(F.col("mid")), evidence(F.col("mid") - 1))).alias("evidence_id"))
    known = inp.monthly_obs.select(evidence(F.col("mid")).alias("evidence_id"))
    return claims.join(known, "evidence_id", "left_anti").select("claim_id", "evidence_id")


@query("issue_first_order", f"""
WITH {STATUS}, c AS (SELECT key, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'unconfirmed') AS unconfirmed, count(*) FILTER (WHERE status = 'pending') AS pending FROM ps GROUP BY key)
SELECT *, CAST(row_number() OVER (ORDER BY missing DESC, unconfirmed DESC, pending DESC, key) AS INT) AS place FROM c WHERE missing + unconfirmed + pending > 0""")
def issue_first_order(inp):
    from pyspark.sql import Window

    status = F.col("status")
    counts = statuses(inp, 60).groupBy("key").agg(*[F.count_if(status == s).alias(s) for s in ("missing", "unconfirmed", "pending")])
    # one row per indicator of the catalogue
    order = Window.orderBy(F.desc("missing"), F.desc("unconfirmed"), F.desc("pending"), "key")
    return counts.filter("missing + unconfirmed + pending > 0").withColumn("place", F.row_number().over(order))


@query("catalog_search", """
SELECT key, name, basis, topic FROM catalog WHERE contains(lower(name || ' ' || basis || ' statistics office ' || key), 'year to') AND topic = 'normal'""")
def catalog_search(inp):
    hay = F.lower(F.concat_ws(" ", "name", "basis", F.lit("statistics office"), "key"))
    return mo.catalogue(inp.monthly_obs).filter(F.contains(hay, F.lit("year to")) & (F.col("topic") == "normal"))
