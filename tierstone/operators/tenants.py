"""Tenants: certificates by server name, and requests that name another host than their connection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.functions.http import normalize_host


def select_certificate(connections: DataFrame, certificates: DataFrame) -> DataFrame:
    """connections (sni) with certificate, by certificates (host in lower case, distinct; certificate). Null refuses the handshake: no name, or one that is unknown."""
    known = certificates.select(F.col("host").alias("host_"), "certificate")
    return connections.join(known, F.lower("sni") == F.col("host_"), "left").drop("host_")


def misdirected(requests: DataFrame) -> DataFrame:
    """requests with host_ok: their host is their connection's server name; without one, every host is."""
    none = F.coalesce(F.col("sni"), F.lit("")) == ""
    return requests.withColumn("host_ok", none | (normalize_host(F.coalesce("host", F.lit(""))) == F.lower("sni")))
