"""Requests to expose referenced sensitive material, even without values in the text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column

# Any of these overrides the policy, whatever else the text says.
OVERRIDES = [
    r"\b(?:treat|interpret)\b.{0,100}\b(?:instructions?|content)\b.{0,100}\b(?:higher priority|trusted system)\b",
    r"\b(?:administrator|admin)\b.{0,80}\bauthori[sz]\w*\b.{0,70}\bunrestricted\b",
    r"\bignore\b.{0,50}\b(?:existing|current)\b.{0,40}\bsecurity restrictions?\b",
    r"\b(?:pretend|assume)\b.{0,60}\b(?:policy|rules?|restrictions?)\b.{0,40}\b(?:suspended|disabled|inactive)\b",
    r"\bobey\b.{0,40}\b(?:embedded|hidden|new)\b.{0,30}\bsystem instructions?\b",
    r"\b(?:suspend|switch off|turn off)\b.{0,40}\b(?:safety checks?|security checks?|polic(?:y|ies)|guardrails?)\b",
    r"\b(?:safety|security)\s+polic(?:y|ies)\b.{0,30}\b(?:disabled|inactive|suspended)\b",
]

# A request needs a verb that acts and a cue that refers to given material.
ACTION = r"\b(?:create|review|extract|prepare|identify|analy[sz]e|summari[sz]e|convert|turn|determine|explain|preserv\w*|provide|disclose|reveal|expose|compile|build|assemble|list|pull|collect|generate|write|draft|make|document|map|retain\w*|copy|tabulate|catalog(?:ue)?|enumerate|surface|output)\b"
REFERENCE = r"\b(?:this|these|our|provided|following|containing|contained|based on|from this|person.s|attached|supplied|uploaded|shared|enclosed|given|embedded|retrieved|client.s|customer.s|company.s)\b"

# With an identity cue, whose identity it is tells the policy.
IDENTITY = r"\b(?:full names?|legal names?|residential locations?|home (?:addresses|locations?)|birth dates?|dates? of birth|dob|government identification|identit\w*|identifiers?|identifying details|private contacts?|contact details|family information|personal information|private details|phone numbers?|employee numbers?|staff roster|employee director(?:y|ies))\b"
IDENTITY_CODES = {
    "EMPLOYEE_ID": r"\b(?:employee|staff|worker|personnel)\b",
    "CUSTOMER_ID": r"\b(?:customer|client|crm|person|profile)\b",
    "ADDRESS": r"\b(?:home address|residential location)\b",
    "DOB": r"\b(?:birth date|date of birth|dob)\b",
    "PASSPORT": r"\bgovernment identification\b",
    "PHONE": r"\bphone numbers?\b",
}

# A topic and a kind of material that must both be there.
PAIRS = {
    "HEALTH": (
        r"\b(?:patient|clinical|medical|health)\b",
        r"\b(?:history|diagnos(?:is|es)|treatment(?: plans?)?|medications?|notes|profile|information|details|identity|charts?|records?)\b",
    ),
    "TOKEN": (
        r"\b(?:authentication information|authenticate against|access to (?:our )?internal (?:services|systems)|access our internal systems|access (?:details|information|data)|production database|credentials?|secrets?|connection (?:configuration|values?|details?|strings?)|log in)\b",
        r"\b(?:configuration|settings|notes|database|server|access|values|information|deployment|file|manifest|connection|credentials?|secrets?)\b",
    ),
    "FINANCE": (
        r"\b(?:revenue|profit margins?|financial plans?|pricing decisions?|sales forecasts?|unpublished pricing)\b",
        r"\b(?:unreleased|future|confidential|company|management|internal|board|unpublished|next.quarter)\b",
    ),
    "INFRASTRUCTURE": (
        r"\b(?:internal application architecture|internal system details|internal infrastructure|internal authentication system|internal services|production database|private network|service endpoints?|architecture diagrams?)\b",
        r"\b(?:notes|document|discussion|deployment|engineering|developer|configuration|provided|settings|architecture|system|diagrams?|network|endpoints?)\b",
    ),
    "INTERNAL_REPORT": (
        r"\b(?:confidential information|internal strategy|non.public business information|unreleased (?:products?|plans?)|upcoming products?|sensitive company information|product roadmap|pricing plans?|board deck|unpublished pricing)\b",
        r"\b(?:company|management|strategy|business|document|conversation|meeting|notes|competitors|products?|roadmap|pricing|board|deck|sales forecasts?)\b",
    ),
    "CUSTOMER_DATA": (
        r"\b(?:customer|crm|sales profile|customer.support)\b",
        r"\b(?:purchasing history|preferences|account (?:information|history)|private details|commercially sensitive|confidential information|customer conversation|vendor.facing)\b",
    ),
    "EXFILTRATION": (
        r"\b(?:third.party ai provider|external systems|public logs)\b",
        r"\b(?:information|data|details|document|message|conversation)\b",
    ),
}

CODES = sorted({"POLICY_OVERRIDE", *IDENTITY_CODES, *PAIRS})


def intent(has: Callable[..., Column], code: str) -> Column | None:
    """Whether a normalised text shows the intent of a code; None if no intent belongs to it.

    has(pattern, on=...): whether a pattern matches, asked for only where the pattern `on` does.
    """
    if code == "POLICY_OVERRIDE":
        return reduce(or_, [has(pattern) for pattern in OVERRIDES])
    if code in IDENTITY_CODES:
        first, second = IDENTITY_CODES[code], IDENTITY
    elif code in PAIRS:
        first, second = PAIRS[code]
    else:
        return None
    # something is to be done with referenced material of this kind
    return reduce(and_, [has(first), *(has(pattern, on=first) for pattern in (second, REFERENCE, ACTION))])
