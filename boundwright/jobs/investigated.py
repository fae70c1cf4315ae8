"""Queries over investigations in order: cursors over paths, and verdicts that answer for equal alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.jobs.catalogue import query
from boundwright.operators import cursors as C
from boundwright.sources.projections import view


@query(
    """_e AS (SELECT *, lower(trim(CASE WHEN coalesce(direction, '') = '' THEN 'next' ELSE direction END)) AS word, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS rn FROM session_events),
    _t AS (SELECT *, CASE WHEN tool <> 'move_window' THEN 'open' WHEN coalesce(step, 0) <> 0 THEN 'step' WHEN word IN ('next', 'forward', 'toward_alarm', 'callee') THEN 'on' WHEN word IN ('prev', 'previous', 'back', 'caller') THEN 'back' ELSE 'error' END AS act FROM _e),
    _f AS (SELECT DISTINCT order_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS pos, 0 AS moves, 0 AS errors, CAST([] AS BIGINT[]) AS opened FROM _t
      UNION ALL SELECT t.order_id, t.rn, CASE act WHEN 'step' THEN least(greatest(step, 1), n_steps) - 1 WHEN 'on' THEN least(pos + 1, n_steps - 1) WHEN 'back' THEN greatest(pos - 1, 0) ELSE pos END,
        moves + CASE WHEN act IN ('step', 'on', 'back') THEN 1 ELSE 0 END, errors + CASE WHEN act = 'error' THEN 1 ELSE 0 END, CASE WHEN act = 'open' THEN list_append(opened, pos + 1) ELSE opened END
        FROM _f f JOIN _t t ON t.order_id = f.order_id AND t.rn = f.rn + 1)
    SELECT order_id, arg_max(pos, rn) + 1 AS at_step, arg_max(moves, rn) AS n_moves, arg_max(errors, rn) AS n_errors, array_to_string(list_sort(list_distinct(arg_max(opened, rn))), ',') AS opened FROM _f GROUP BY order_id""",
    "session_events",
)
def session_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each session's moves lead on its path, and which steps it opened."""
    return C.cursors(view(spark, sf_dir, "session_events")).withColumn("opened", F.array_join("opened", ","))


@query(
    """_c AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY finished, order_id) AS rn FROM sibling_cases),
    _f AS (SELECT fingerprint, rn, order_id, CAST(NULL AS BIGINT) AS derived_from, classification AS answer, order_id AS source, classification AS known, tag AS known_tag FROM _c WHERE rn = 1
      UNION ALL SELECT c.fingerprint, c.rn, c.order_id, CASE WHEN own THEN NULL ELSE source END, CASE WHEN own THEN c.classification ELSE known END, CASE WHEN own THEN c.order_id ELSE source END, CASE WHEN own THEN c.classification ELSE known END, CASE WHEN own THEN c.tag ELSE known_tag END
        FROM (SELECT f.source, f.known, f.known_tag, c.*, f.known = 'false' OR (c.tag <> '' AND c.tag <> f.known_tag) AS own FROM _f f JOIN _c c ON c.fingerprint = f.fingerprint AND c.rn = f.rn + 1) c)
    SELECT order_id, fingerprint, derived_from, answer AS classification FROM _f""",
    "sibling_cases",
)
def sibling_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which alarms an equal one's verdict answers, in the order in which investigations end."""
    return C.answers(view(spark, sf_dir, "sibling_cases"))
