"""Header matching: canonical names, required columns, explicit mappings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.sources.files import ORDINAL

_CARRIED = (ORDINAL, "_file")

# File headers and the columns they fill.
REGISTRATION_HEADERS = {
    "timestamp": "form_timestamp",
    "utm source": "utm_source",
    "utm medium": "utm_medium",
    "utm campaign": "utm_campaign",
    "utm term": "utm_term",
    "utm content": "utm_content",
    "college/school/company/startup name": "org_name",
    "college/school state": "org_state",
    "college/school city": "org_city",
    "class/stream": "class_stream",
    "portfolio": "portfolio",
    "domain": "domain",
    "designation (year of exp.)": "designation",
    "founded in (startup size)": "founded_info",
    "degree (passout year)": "degree",
    "profile name": "profile_name",
    "full name": "full_name",
    "email": "email",
    "mobile number": "mobile",
    "whatsapp": "whatsapp",
    "country": "country",
    "state": "state",
    "city": "city",
    "date of birth": "dob",
    "gender": "gender",
    "occupation": "occupation",
    "github url": "github_url",
    "linkedin url": "linkedin_url",
    "pw date": "session_on",
    "pw session label": "session_label",
    "pw session": "session_label",
}

# Fixed value: the attendance question ends with the programme's name, so only its start is matched.
ATTENDANCE_QUESTION = "in which city, would you like to attend"

_SUBMISSION_HEADERS = {
    "team name": "team_name",
    "leader name": "leader_name",
    "leader email": "leader_email",
    "leader phone": "leader_phone",
    "team size": "team_size",
    "attempts completed": "attempts_completed",
    "problem statements": "problem_statements",
    "total score (latest attempt)": "total_score",
    "deployed link - (cloud run url)": "deployed_link",
    "deployed link (cloud run url)": "deployed_link",
    "public github repository link": "github_repository_link",
    "created at": "export_created_at",
    "created by name": "export_created_by_name",
    "created by email": "export_created_by_email",
    "updated at": "export_updated_at",
    "updated by name": "export_updated_by_name",
    "updated by email": "export_updated_by_email",
}
ROUND_HEADERS = {**_SUBMISSION_HEADERS, "linkedin post": "linkedin_post"}
SESSION_HEADERS = {
    **_SUBMISSION_HEADERS,
    "describe the changes/updates made in the deployed version": "deployed_changes_notes",
}

BOOTCAMP_HEADERS = {
    "city": "city",
    "bootcamp_on": "bootcamp_on",
    "bootcamp on": "bootcamp_on",
    "date": "bootcamp_on",
    "slot": "slot",
    "venue_status": "venue_status",
    "venue status": "venue_status",
    "speaker_status": "speaker_status",
    "speaker status": "speaker_status",
    "topic": "topic",
    "speaker_details": "speaker_details",
    "speaker details": "speaker_details",
    "speakers": "speaker_details",
    "audience_size": "audience_size",
    "audience size": "audience_size",
    "audience_type": "audience_type",
    "audience type": "audience_type",
    "location": "location",
    "complete_address": "complete_address",
    "complete address": "complete_address",
    "address": "complete_address",
    "fnb": "food_beverage",
    "f&b": "food_beverage",
    "f & b": "food_beverage",
    "food_beverage": "food_beverage",
    "food beverage": "food_beverage",
    "printables": "printables",
    "design_link": "design_link",
    "design link": "design_link",
    "deck": "deck_link",
    "deck_link": "deck_link",
    "capacity": "capacity",
    "attendees": "attendees",
    "activation": "activations",
    "activations": "activations",
    "students": "students",
    "professionals": "professionals",
}


def header_key(header: str) -> str:
    return " ".join(header.replace("﻿", "").split()).lower()


def canonical_name(header: str, names: Mapping[str, str], programmes: Iterable[str] = ()) -> str | None:
    """Column a header fills.  ``programmes`` are names that may lead the session columns
    (``<name> date``, ``<name> session label``)."""
    key = header_key(header.split("\t")[0])
    if key in names:
        return names[key]
    if "form_timestamp" in names.values() and key.startswith(ATTENDANCE_QUESTION):
        return "attendance_city"
    for p in programmes:
        if key in (f"{header_key(p)} date", f"{header_key(p)} date (yyyy-mm-dd)"):
            return "session_on"
        if key in (f"{header_key(p)} session label", f"{header_key(p)} session"):
            return "session_label"
    return None


def canonical_columns(
    df: DataFrame, names: Mapping[str, str], required: Sequence[str] = (), programmes: Iterable[str] = (),
    also: Sequence[str] = (),
) -> DataFrame:
    """Rename headers to canonical columns, drop unknown ones, add missing ones as NULL.

    Of several headers for one column the last wins.
    """
    source: dict[str, str] = {}
    for header in df.columns:
        name = canonical_name(header, names, programmes)
        if name:
            source[name] = header
    require_columns(source, required)
    wanted = list(dict.fromkeys([*names.values(), *also]))
    cells = [
        (F.col(f"`{source[n]}`") if n in source else F.lit(None)).cast("string").alias(n) for n in wanted
    ]
    return df.select(*cells, *[c for c in _CARRIED if c in df.columns])


def require_columns(present: Iterable[str], required: Sequence[str]) -> None:
    """Fail naming the required columns that are absent."""
    have = set(present)
    missing = [r for r in required if r not in have]
    if missing:
        raise ValueError("Missing required column(s): " + ", ".join(missing))


def apply_mapping(df: DataFrame, mapping: Mapping[str, str | None], required: Sequence[str]) -> DataFrame:
    """User-supplied mapping of target to header; required targets must be mapped to existing headers."""
    chosen = {t: (h or "").strip() for t, h in mapping.items()}
    chosen = {t: h for t, h in chosen.items() if h}
    for r in required:
        if r not in chosen:
            raise ValueError(f"Column mapping must include {r}")
    for t, h in chosen.items():
        if h not in df.columns:
            raise ValueError(f"Mapped {t} column {h!r} not found in file")
    return df.select(*[F.col(f"`{h}`").alias(t) for t, h in chosen.items()], *[c for c in _CARRIED if c in df.columns])
