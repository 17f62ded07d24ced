"""Identifier columns: phone, EIN, SSN, client keys, manager keys, role tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import _c, blank

# Reverse role of a relation edge; other roles reverse to themselves.
INVERSE_ROLES = {"child": "parent", "parent": "child", "owner": "business", "business": "owner"}


def digits(x: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[^0-9]", "")


def phone10(x: str | Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).otherwise(d)


def ein9(x: str | Column) -> Column:
    return F.right(digits(x), F.lit(9))


ssn9 = ein9


def is_individual(entity_type: str | Column, flag: Column | None = None) -> Column:
    by_type = F.lower(blank(entity_type)) == "individual"
    return by_type if flag is None else F.coalesce(flag, F.lit(False)) | by_type


def client_uid(cid: Column, individual: Column, ein: Column, ssn: Column) -> Column:
    """Stored id first, else `ssn:`/`ein:` with the digits, else empty."""
    person = F.coalesce(F.nullif(digits(ssn), F.lit("")), F.nullif(digits(ein), F.lit("")))
    firm = F.nullif(digits(ein), F.lit(""))
    made = F.when(individual, F.concat(F.lit("ssn:"), person)).otherwise(F.concat(F.lit("ein:"), firm))
    return F.coalesce(F.nullif(blank(cid), F.lit("")), made, F.lit(""))


def canonical_key(individual: Column, ein: Column, ssn: Column) -> Column:
    return client_uid(F.lit(""), individual, ein, ssn)


def manager_key(name: Column, email: Column, phone: Column) -> Column:
    n = F.lower(F.regexp_replace(blank(name), r"\s+", " "))
    return F.concat(n, F.lit("|"), F.lower(blank(email)), F.lit("|"), phone10(phone))


def manager_id(key: Column) -> Column:
    return F.concat(F.lit("am_"), F.substring(F.sha1(key), 1, 12))


def inverse_role(role: str | Column) -> Column:
    r = F.lower(blank(role))
    out = r
    for a, b in INVERSE_ROLES.items():
        out = F.when(r == a, b).otherwise(out)
    return out


def link_roles(a_individual: Column, b_individual: Column, role: str | Column) -> tuple[Column, Column]:
    """Roles written on both ends of a new link, by the kinds of the two clients."""
    r = F.lower(blank(role))
    staff = F.regexp_replace(r, "^businessowner$", "businessowner")
    forward = (
        F.when(
            ~a_individual & b_individual,
            F.when(r.isin("business owner", "businessowner", "employee", "officer"), staff).otherwise("business owner"),
        )
        .when(a_individual & ~b_individual, "business")
        .when(
            a_individual & b_individual,
            F.when(r.isin("parent", "child", "spouse", "relative"), r).otherwise("relative"),
        )
        .otherwise(F.when(r == "", "business").otherwise(r))
    )
    backward = (
        F.when(~a_individual & b_individual, "business")
        .when(a_individual & ~b_individual, "owner")
        .when(a_individual & b_individual, inverse_role(forward))
        .otherwise(forward)
    )
    return forward, backward
