"""Compositions of whole stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from flowspark.functions import alerts as A
from flowspark.operators import alerts as O
from flowspark.session import stored


def alert_chain(
    detections: DataFrame,
    cidr_dim: DataFrame | None = None,
    domain_dim: DataFrame | None = None,
    window_s: int = 300,
    idle_s: int = 3600,
    as_of_us: Column | None = None,
    tie: str = "alert_id",
) -> DataFrame:
    """Detections to routed alerts: prepare, drop duplicates, correlate, enrich.

    Enrichment follows de-duplication: it does not touch the keys, so only alerts that are
    emitted are looked up.
    """
    alerts = O.prepare_alerts(detections)
    # what can be told from a detection is made again of the alerts that are left, instead of being moved along
    bare = alerts.select(*dict.fromkeys([*detections.columns, "ts_us", "dedup_key"]))
    # first alerts are found once; counting and scoring their groups reads them several times
    fresh = stored(O.dedup_alerts(bare, window_s, tie=tie), "fresh")
    out = O.group_scores(fresh, idle_s, tie=tie)
    names = [*alerts.columns, *[c for c in out.columns if c not in alerts.columns], "stix_indicator"]
    if cidr_dim is not None:
        out = O.enrich_ips(out, cidr_dim, domain_dim, seen_in=fresh)
        ends = ["dst_ip", "src_ip"]
        names = [*ends, *[c for c in names if c not in ends], *[c for c in out.columns if c.endswith("_enrichment")]]
    return O.prepare_alerts(out).withColumn("stix_indicator", A.stix_indicator(as_of_us)).select(*names)
