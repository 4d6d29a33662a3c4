"""Tag based access: who may read what, and whether the audit log agrees."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parse_timestamp
from tidemark.model import GRANTS, LAYERS, ZONE_SENSITIVITY, ZONES, Grant, database_name

DENIED = "DENIED"


class AccessDenied(PermissionError):
    """The persona has no right on the table. Raised before anything is read."""


def standard_databases(spark: SparkSession) -> DataFrame:
    """The six layer-by-zone databases with their tags: `resource`, `tags` map.

    Built from literals, so that Spark knows how small it is and broadcasts it where it is joined.
    """
    rows = [
        F.struct(
            F.lit(database_name(layer, zone)).alias("resource"),
            F.create_map(
                F.lit("sensitivity"), F.lit(ZONE_SENSITIVITY[zone]), F.lit("layer"), F.lit(layer)
            ).alias("tags"),
        )
        for layer in LAYERS
        for zone in ZONES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def inherit_tags(tables: DataFrame, databases: DataFrame) -> DataFrame:
    """Tables (`table`, `database`) take the tags of their database."""
    tags = databases.select(F.col("resource").alias("database"), "tags")
    return tables.join(tags, "database").select(F.col("table").alias("resource"), "tags")


def _satisfied(grant: Grant) -> Column:
    """Every tag key of the grant holds one of its allowed values; a missing tag fails."""
    matches = F.lit(True)
    for key, values in grant.expressions.items():
        matches = matches & F.coalesce(F.col("tags")[key].isin(*values), F.lit(False))
    return matches


def satisfied_grants(resources: DataFrame, grants: Iterable[Grant] = GRANTS) -> DataFrame:
    """(resource, principal, permission) for every grant all of whose tag keys match.

    Grants are configuration, so each becomes a condition on the tag map: no join, and no shuffle on
    the few tag values, which would each hold a large share of all resources.
    """
    held = [
        F.when(_satisfied(g), F.struct(F.lit(g.principal).alias("principal"), F.lit(g.permission).alias("permission")))
        for g in grants
    ]
    exploded = resources.select("resource", F.explode(F.array(*held)).alias("grant")).where(F.col("grant").isNotNull())
    return exploded.select("resource", "grant.principal", "grant.permission").distinct()


def access_matrix(resources: DataFrame, grants: Iterable[Grant] = GRANTS) -> DataFrame:
    """One row per resource and principal: ALL, SELECT or DENIED. Narrow: resources never shuffle."""
    grants = tuple(grants)
    cells = []
    for principal in sorted({g.principal for g in grants}):
        own = [g for g in grants if g.principal == principal]
        right = F.lit(DENIED)
        for level in ("SELECT", "ALL"):
            for grant in (g for g in own if g.permission == level):
                right = F.when(_satisfied(grant), F.lit(level)).otherwise(right)
        cells.append(F.struct(F.lit(principal).alias("principal"), right.alias("permission")))
    return resources.select("resource", F.inline(F.array(*cells)))


def permission(principal: str, tags: Mapping[str, str], grants: Iterable[Grant] = GRANTS) -> str:
    """The matrix cell of one resource, decided on the driver from configuration alone."""
    granted = {
        g.permission
        for g in grants
        if g.principal == principal and all(tags.get(k) in values for k, values in g.expressions.items())
    }
    return "ALL" if "ALL" in granted else "SELECT" if granted else DENIED


def read_as(spark: SparkSession, principal: str, layer: str, zone: str, table: str, grants: Iterable[Grant] = GRANTS):
    """Read a catalog table for a persona; a missing right is an error, never an empty result.

    This is a guard in the library. Real enforcement belongs to the catalog and the storage.
    """
    tags = {"sensitivity": ZONE_SENSITIVITY[zone], "layer": layer}
    if permission(principal, tags, grants) == DENIED:
        raise AccessDenied(f"{principal} may not read {database_name(layer, zone)}.{table}")
    return spark.table(f"{database_name(layer, zone)}.{table}")


def audited_accesses(records: DataFrame) -> DataFrame:
    """Audit records (see `AUDIT_RECORD`) to one row per touched resource; without resources one row of resource NULL."""
    return records.select(
        F.col("useridentity.username").alias("principal"),
        F.col("eventname").alias("action"),
        parse_timestamp("eventtime").alias("accessed_at"),
        F.explode_outer("resources").alias("r"),
    ).select("principal", "action", "accessed_at", F.col("r.arn").alias("resource"))


def audit_report(records: DataFrame, matrix: DataFrame) -> DataFrame:
    """Accesses per principal, resource, action and hour, with the right the policy gives.

    Counting comes before the join with the matrix, so one busy principal or resource costs one row
    per hour in the join. Resources outside the matrix count as DENIED.
    """
    counted = (
        audited_accesses(records)
        .groupBy("principal", "resource", "action", F.date_trunc("hour", "accessed_at").alias("access_hour"))
        .agg(
            F.count(F.lit(1)).alias("accesses"),
            F.min("accessed_at").alias("first_access"),
            F.max("accessed_at").alias("last_access"),
        )
    )
    judged = counted.join(matrix, ["principal", "resource"], "left")
    right = F.coalesce("permission", F.lit(DENIED))
    return judged.withColumn("permission", right).withColumn("outside_policy", F.col("permission") == DENIED)
