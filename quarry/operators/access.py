"""Row-level access: four rules that look alike and differ, each under its own name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Who asks: id, role and department; ``isolated`` is off where departments see each other."""

    user_id: str
    role: str = "viewer"
    department_id: str | None = None
    isolated: bool = True

    @property
    def is_admin(self) -> bool:
        return self.role == "admin"

    @property
    def departments(self) -> list[str] | None:
        """The departments to filter by; None for no filter."""
        return None if self.is_admin or not self.isolated else [self.department_id]


def search_filter(
    sources: list[str] | None = None, section: str | None = None, departments: list[str] | None = None,
    universe: str | None = None, user_id: str | None = None, is_admin: bool = True,
) -> Column:
    """For chunks: source, section and universe, if given; unless admin, of a visible department or one's own private ones."""
    out = F.lit(True)
    if sources:
        out = out & F.col("source").isin(sources)
    if section:
        out = out & (F.col("section") == section)
    if universe:
        out = out & (F.col("universe_id") == universe)
    if is_admin:
        return out
    shared = F.col("visibility") == "department"
    if departments:
        shared = shared & F.col("department").isin(departments)
    own = (F.col("visibility") == "private") & (F.col("uploaded_by") == user_id) if user_id else F.lit(False)
    return out & (shared | own)


def registry_filter(policy: Policy | None) -> Column:
    """For registered documents: those of one's department, and one's own private ones."""
    if policy is None or policy.is_admin:
        return F.lit(True)
    own = (F.col("visibility") == "private") & (F.col("uploaded_by") == policy.user_id)
    return ((F.col("visibility") == "department") & (F.col("department_id") == policy.department_id)) | own


def facts_filter(policy: Policy) -> Column:
    """For facts: as the registry's rule, but only private ones where no department list applies."""
    if policy.is_admin:
        return F.lit(True)
    own = (F.col("visibility") == "private") & (F.col("uploaded_by") == policy.user_id)
    if not policy.departments:
        return own
    return own | ((F.col("visibility") == "department") & F.col("department_id").isin(policy.departments))


def can_view(policy: Policy) -> Column:
    """For one document: private ones only by their owner, all others within the department."""
    if policy.is_admin:
        return F.lit(True)
    return F.when(F.col("visibility") == "private", F.col("uploaded_by") == policy.user_id).otherwise(F.col("department_id") == policy.department_id)


def can_delete(policy: Policy) -> Column:
    return F.lit(policy.role in ("admin", "manager")) | (F.col("uploaded_by") == policy.user_id)


def can_change_visibility(policy: Policy) -> Column:
    return F.lit(policy.is_admin) | (F.col("uploaded_by") == policy.user_id)


def has_role(policy: Policy, *roles: str) -> bool:
    return policy.role in roles


def can_upload(policy: Policy) -> bool:
    return has_role(policy, "admin", "manager", "analyst")


def can_manage_users(policy: Policy) -> bool:
    return policy.is_admin


def can_access_universe(policy: Policy) -> Column:
    return F.lit(policy.is_admin) | (F.col("department_id") == policy.department_id)


def visible(documents: DataFrame, policy: Policy | None, universe: str | None = None) -> DataFrame:
    """The documents a user sees, newest first."""
    rows = documents.where(registry_filter(policy))
    if universe is not None:
        rows = rows.where(F.col("universe_id") == universe)
    return rows.orderBy(F.col("created_at").desc(), "id")


def count_visible(documents: DataFrame, policy: Policy | None, universe: str | None = None) -> DataFrame:
    rows = documents.where(registry_filter(policy))
    if universe is not None:
        rows = rows.where(F.col("universe_id") == universe)
    return rows.agg(F.count("id").alias("n"))


def latest_by_source(documents: DataFrame, policy: Policy, universe: str | None = None) -> DataFrame:
    """For each file name the newest indexed document that the facts' rule lets through."""
    rows = documents.where((F.col("status") == "indexed") & F.col("universe_id").eqNullSafe(F.lit(universe)) & facts_filter(policy))
    newest = rows.groupBy("filename").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))
    return newest


def universe_counts(universes: DataFrame, documents: DataFrame, conversations: DataFrame, policy: Policy | None) -> DataFrame:
    """Visible documents and conversations of each universe."""
    docs = documents.where(registry_filter(policy)).groupBy("universe_id").agg(F.count("*").alias("documents"))
    talks = conversations.groupBy("universe_id").agg(F.count("*").alias("conversations"))
    joined = universes.join(docs, universes["id"] == docs["universe_id"], "left").drop(docs["universe_id"])
    joined = joined.join(talks, joined["id"] == talks["universe_id"], "left").drop(talks["universe_id"])
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "conversations")})


def visible_duplicates(uploads: DataFrame, documents: DataFrame, policy: Policy) -> DataFrame:
    """Uploads whose content hash a document has that the user may view."""
    return uploads.join(documents.where(can_view(policy)).select("file_hash"), "file_hash", "left_semi")
