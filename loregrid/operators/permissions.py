"""Who may read what: memberships that nest, closed once, and grants of modules to their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(members: DataFrame, most_rounds: int = 64) -> DataFrame:
    """member, team: every team that a member belongs to, itself or through teams; members (member, team) may go in circles. Null ends don't count.

    Each round joins only the pairs that the last one found, and ends when it finds none: as many rounds as teams are nested. Rounds are checkpointed, where a folder is set for that.
    """
    edges = members.select("member", "team").where("member IS NOT NULL AND team IS NOT NULL").distinct()
    spark = members.sparkSession
    kept = lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()
    if not spark.sparkContext.getCheckpointDir() and (top := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(top)
    found = last = kept(edges)
    up = edges.select(F.col("member").alias("team"), F.col("team").alias("above"))
    for _ in range(most_rounds):
        last = kept(last.join(up, "team").select("member", F.col("above").alias("team")).distinct().join(found, ["member", "team"], "left_anti"))
        if last.isEmpty():
            return found
        found = kept(found.unionByName(last))
    raise RuntimeError(f"memberships are nested more than {most_rounds} deep")


def allowed(users: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """query_id, module: what the users of queries (query_id, user) may read by grants (team, module), to themselves or to any team that they belong to."""
    own = users.select("query_id", F.col("user").alias("team"))
    through = users.join(closure(members), users["user"] == F.col("member")).select("query_id", "team")
    return own.unionByName(through).join(grants.select("team", "module"), "team").select("query_id", "module").distinct()
