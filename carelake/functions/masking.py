"""Column masking policies (G1-G6) and role inheritance.

A policy is a plain function ``(Column, roles) -> Column``: the role set is
known on the driver when the plan is built, so each policy folds to a single
branch of built-in expressions (no UDF, no per-row role lookup).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six roles and the hierarchy (admin inherits the others).
ADMIN, ENGINEER, ANALYST, CLINICIAN, FINANCE, EXEC = (
    "ADMIN", "ENGINEER", "ANALYST", "CLINICIAN", "FINANCE", "EXEC")
ROLES = [ADMIN, ENGINEER, ANALYST, CLINICIAN, FINANCE, EXEC]
ROLE_GRANTS = {ADMIN: [ENGINEER, ANALYST, CLINICIAN, FINANCE, EXEC]}


def roles_in_session(role: str) -> frozenset[str]:
    """Transitive closure of granted roles: ``IS_ROLE_IN_SESSION(r)`` is true
    for the session role and everything it inherits."""
    seen, stack = set(), [role]
    while stack:
        r = stack.pop()
        if r in seen:
            continue
        seen.add(r)
        stack.extend(ROLE_GRANTS.get(r, []))
    return frozenset(seen)


def _any(roles: Iterable[str], *wanted: str) -> bool:
    rs = set(roles)
    return any(w in rs for w in wanted)


_FULL = (ADMIN, CLINICIAN, ENGINEER)


def mask_ssn(val: Column, roles) -> Column:
    if _any(roles, ADMIN):
        return val
    if _any(roles, CLINICIAN, ENGINEER):
        return F.concat(F.lit("XXX-XX-"), F.right(val, F.lit(4)))
    return F.lit("***-**-****")


def mask_dob(val: Column, roles) -> Column:
    if _any(roles, *_FULL):
        return val
    return F.make_date(F.year(val), F.lit(1), F.lit(1))


def mask_name(val: Column, roles) -> Column:
    if _any(roles, *_FULL):
        return val
    return F.concat(F.lit("PATIENT_"), F.left(F.sha2(val, 256), F.lit(8)))


def mask_mrn(val: Column, roles) -> Column:
    if _any(roles, *_FULL):
        return val
    return F.lit("***MRN***")


def mask_phone(val: Column, roles) -> Column:
    if _any(roles, *_FULL):
        return val
    if _any(roles, ANALYST):
        return F.concat(F.lit("(***) ***-"), F.right(val, F.lit(4)))
    return F.lit("**********")


def mask_email(val: Column, roles) -> Column:
    if _any(roles, *_FULL):
        return val
    return F.concat(F.lit("****@"), F.split_part(val, F.lit("@"), F.lit(2)))


# Masks attached to patient columns (and, per SURVEY §8 item 8, to the
# same data where the marts copy it).
COLUMN_MASKS = {
    "SSN": mask_ssn,
    "DOB": mask_dob,
    "FIRST_NAME": mask_name,
    "LAST_NAME": mask_name,
    "PATIENT_NAME": mask_name,
    "MRN": mask_mrn,
    "PHONE": mask_phone,
    "EMAIL": mask_email,
}
