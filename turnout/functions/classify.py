"""Classification expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnout.functions.text import as_col, strip_all

# Occupations that make a registrant a student or a professional.
STUDENT_OCCUPATIONS = ("college_student", "student")
PROFESSIONAL_OCCUPATIONS = ("professional", "startup", "freelance", "freelancer")

SEGMENTS = ("student", "professional", "other", "unknown")


def segment_case(occupation: Column | str, linked: Column | str) -> Column:
    """student / professional / other, or unknown when no registration is linked."""
    key = F.lower(F.trim(as_col(occupation)))
    return (
        F.when(as_col(linked).isNull(), "unknown")
        .when(key.isin(*STUDENT_OCCUPATIONS), "student")
        .when(key.isin(*PROFESSIONAL_OCCUPATIONS), "professional")
        .otherwise("other")
    )


def attempt_bucket(attempts: Column | str) -> Column:
    attempts = as_col(attempts)
    return F.when(attempts.isNull() | (attempts < 1), 0).otherwise(attempts.cast("int"))


def valid_email(c: Column | str) -> Column:
    """Normalised address when it looks like one, else NULL."""
    address = F.lower(strip_all(c))
    at = F.instr(address, "@")
    domain = address.substr(at + F.lit(1), F.length(address))
    shaped = (
        (at > 1)
        & ~F.endswith(address, F.lit("@"))
        & (F.instr(address, " ") == 0)
        & (F.instr(domain, ".") > 0)
        & (F.length(domain) >= 3)
    )
    return F.when(shaped & ~address.isin("nan", "none"), address)


def sql_kind(statement: Column | str) -> Column:
    """Kind of an SQL statement: what its first word says once the comments before it are gone."""
    bare = F.regexp_replace(as_col(statement), r"\A(?:\s|--.*(?:\n|\z)|/\*[\s\S]*?\*/)+", "")
    word = F.upper(F.regexp_extract(bare, r"\A[A-Za-z]+", 0))
    # Statement words by kind.
    return (
        F.when(word.isNull() | (word == ""), "OTHER")
        .when(word == "WITH", "SELECT")
        .when(word.isin("CREATE", "ALTER", "DROP", "GRANT", "REVOKE", "COMMENT"), "DDL")
        .when(word.isin("BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE"), "TXN")
        .otherwise(word)
    )


def module_of_path(path: Column | str) -> Column:
    """Module a request path belongs to."""
    path = F.coalesce(as_col(path), F.lit(""))
    # Path prefixes by module.
    return (
        F.when(path.startswith("/in-person") | path.contains("/in-person/"), "in_person")
        .when(path.startswith("/virtual"), "virtual")
        .when(path.startswith("/admin"), "admin")
        .when(path.startswith("/api/"), "api")
        .when(path.startswith("/static/"), "static")
        .otherwise("overview")
    )


def activity_source(path: Column | str) -> Column:
    return F.when(as_col(path).startswith("/api/"), "api").otherwise("ui")


# RSVP buckets from strongest to weakest, with the payload key of each.
RSVP_BUCKETS = (
    ("checked_in", "checkedInParticipants"),
    ("accepted_not_attended", "rsvpAccepted"),
    ("pending", "rsvpPending"),
    ("invite_sent", "rsvpInviteSent"),
)


def rsvp_bucket_of(email: Column | str, lists: Column | str) -> Column:
    """Strongest bucket whose list holds the address; ``lists`` is a map of key to addresses."""
    address = F.lower(strip_all(email))
    lists = as_col(lists)
    chosen = F.lit(None).cast("string")
    for bucket, key in reversed(RSVP_BUCKETS):
        members = F.transform(F.try_element_at(lists, F.lit(key)), lambda e: F.lower(strip_all(e)))
        chosen = F.when(F.array_contains(members, address), bucket).otherwise(chosen)
    return F.when(address != "", chosen)
