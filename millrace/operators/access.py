"""Access rules as boolean columns, so that they are filters of the plan and not calls per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ALL_USERS, ANONYMOUS, AUTHENTICATED_USERS

#: Operations for which grants of a single object add to those of its bucket.
OBJECT_OPERATIONS = ("READ", "READ_ACP", "WRITE_ACP")


def is_anonymous(principal: Column) -> Column:
    return principal == ANONYMOUS


def granted(grants: Column, principal: Column, operation: Column) -> Column:
    """Whether any entry of array<struct<grantee, ops>> matches the principal and holds the operation."""

    def fits(g: Column) -> Column:
        who = (g["grantee"] == ALL_USERS) | ((g["grantee"] == AUTHENTICATED_USERS) & ~is_anonymous(principal)) | (g["grantee"] == principal)
        return who & F.array_contains(g["ops"], operation)

    return F.coalesce(F.exists(grants, fits), F.lit(False))


def permits(owner: Column, grants: Column, principal: Column, operation: Column) -> Column:
    return F.coalesce(owner == principal, F.lit(False)) | granted(grants, principal, operation)


def is_super(principal: Column, super_users: list[str]) -> Column:
    """An exact name, or Type:* for all of a type."""
    kind = F.concat(F.substring_index(principal, ":", 1), F.lit(":*"))
    return F.lit(False) if not super_users else principal.isin(super_users) | kind.isin(super_users)


def authorized(owner: Column, grants: Column, principal: Column, operation: Column, super_users: list[str] | None = None, object_grants: Column | None = None) -> Column:
    """Super-users; then, without rules (null owner), any authenticated principal; else owner or grants of the bucket,
    and for single objects those of the object."""
    out = is_super(principal, super_users or []) | F.when(owner.isNull(), ~is_anonymous(principal)).otherwise(permits(owner, grants, principal, operation))
    if object_grants is not None:
        out |= operation.isin(*OBJECT_OPERATIONS) & granted(object_grants, principal, operation)
    return out


def visible_buckets(buckets: DataFrame, principal: str, super_users: list[str] | None = None) -> DataFrame:
    """Buckets the principal may read, by name."""
    return buckets.where(authorized(F.col("owner"), F.col("grants"), F.lit(principal), F.lit("READ"), super_users)).orderBy("bucket")


def owned_buckets(buckets: DataFrame, principal: str) -> DataFrame:
    return buckets.where(F.col("owner") == principal).orderBy("bucket")
