"""The engine in SQL: its results as temporary views, and table functions over them.

``register`` names the views of one log; every view is a plan that Spark optimises together with the query that reads it, so
filters and columns of the query reach its scans. The functions are SQL table functions, whose argument is a filter of such
a plan:

    SELECT * FROM neighbours_of('t', 'subject-1');
    SELECT tier, count(*) FROM verdicts GROUP BY tier;
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import links, replay, subjects
from ..operators.features import features
from ..sources.shared import written
from .risk import risk_of_points

_FUNCTIONS = {
    "features_of": ("tenant_name STRING, subject_name STRING", "features", "tenant = tenant_name AND subject = subject_name"),
    "neighbours_of": ("tenant_name STRING, subject_name STRING", "neighbours", "tenant = tenant_name AND subject = subject_name"),
    "verdict_of": ("tenant_name STRING, subject_name STRING", "verdicts", "tenant = tenant_name AND subject = subject_name"),
    "subjects_of_key": ("kind_name STRING, hash_value STRING", "links", "kind = kind_name AND hash = hash_value"),
}


def register(events: DataFrame, prefix: str = "") -> list[str]:
    """Views of a log, by name: events, subjects, links (the summary of touches), neighbours (now), points (decision points),
    features (of every point, with evidence) and verdicts (of every point); and the functions features_of, neighbours_of,
    verdict_of and subjects_of_key over them. ``prefix`` comes before all names, so that several logs may stand side by side.
    Features and verdicts read evidence that is stored once, when this is called."""
    spark = events.sparkSession
    spine = replay.points_from_activity(events)
    summary = links.link_summary(links.link_touches(events))
    own = events.select("tenant", "subject").distinct()
    evidence = written(links.evidence_as_of(spine, events), "evidence")
    views = {
        "events": events,
        "subjects": subjects.roll_up(events),
        "links": summary,
        "neighbours": links.neighbours(own, summary),
        "points": spine,
        "features": features(spine, events, evidence),
        "verdicts": risk_of_points(spine, events, evidence=evidence).withColumn("signals", F.to_json("signals")),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    for name, (arguments, view, where) in _FUNCTIONS.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(prefix + view).schema)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE({columns}) RETURN SELECT * FROM {prefix}{view} WHERE {where}")
    return [prefix + name for name in (*views, *_FUNCTIONS)]
