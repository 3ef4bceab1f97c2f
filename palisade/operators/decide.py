"""Decisions: every enabled policy over every variant of a text, as one projection.

The plan has no join and no shuffle. One scan of each variant (functions.scan) finds which of all policies' patterns are
in it, within a budget; policies are column expressions over the numbers of what was found, and each is an exists()
over the variants, which stops at the first that hits. Checks that a pattern can't make run only on variants in
which the scan found that they may succeed. Whatever can't be evaluated makes the decision fail closed.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intent as intents
from ..functions import validators
from ..functions.normalize import normal_form, variants
from ..functions.scan import Patterns, scan
from ..policies import PATTERNS, REASONS, SEVERITIES, TOPIC_CODES, UNAVAILABLE, InvalidPolicy, Policy, built_in_policies
from ..session import small_batches
from ..settings import Settings

logger = logging.getLogger("palisade")

RESULT = "struct<decision:string,highest_severity:string,matched_policy_codes:array<string>,safe_detection_summary:array<string>>"

# Phrases that count with digits read as letters and everything else dropped.
COMPACT_PHRASES = {
    "IGNORE_INSTRUCTIONS": ["ignorepreviousinstructions", "ignoreallpreviousinstructions", "disregardpreviousinstructions"],
    "PROMPT_EXTRACTION": ["revealyoursystemprompt", "showyoursystemprompt", "printthesystemprompt", "revealdevelopermessage", "showhiddeninstructions"],
    "POLICY_OVERRIDE": ["overridepolicy", "bypasssafety"],
    "JAILBREAK": ["doanythingnow", "enabledevelopermode", "actasdan", "youaredan"],
}

# What makes a text more than a general question, and how a general question reads.
_OWNED = r"\b(?:our|my|company|client|this|these|attached|below|following|specific|actual)\b"
_QUESTION = (
    r"(?:what (?:is|are)(?: the basics of)?|can you explain|tell me about|teach me about|give (?:me )?(?:a )?(?:general )?overview of|"
    r"how (?:do|does)|why (?:do|does)|explain|define|describe)"
)


_TOPIC_QUESTION = rf"^{_QUESTION}\s+(?:(?:an?|the)\s+)?[a-z][a-z -]{{2,100}}[?.]?$"


def is_topic_question(value: Column) -> Column:
    """A short question about a topic in general, without identifiers, content or ownership."""
    return value.rlike("(?U)" + _TOPIC_QUESTION) & ~value.rlike("(?U)" + _OWNED)


def unavailable() -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(F.lit("BLOCKED").alias("decision"), F.lit("critical").alias("highest_severity"), empty.alias("matched_policy_codes"), F.array(F.lit(UNAVAILABLE)).alias("safe_detection_summary")).cast(RESULT)


def _special(code: str, value: Column, settings: Settings) -> Column | None:
    if code == "CREDIT_CARD":
        return validators.has_card(value)
    if code == "IP_ADDRESS":
        return validators.has_ip(value)
    if code == "INTERNAL_KEYWORD":
        found = F.lit(False)
        for word in settings.internal_keywords:
            found = found | value.contains(normal_form(word))
        return found
    if code == "INTERNAL_DOMAIN":
        return validators.has_internal_host(value, [normal_form(d) for d in settings.internal_domains])
    if code == "CONNECTION_STRING":
        return validators.has_url_user(value)
    if code == "ENTROPY":
        return validators.has_random_token(value)
    return None


def _hit(policy: Policy, v: Column, sought: Patterns, settings: Settings) -> Column:
    """Whether one variant (t, its text, and ids, the numbers of what was found in it) triggers a policy."""
    value, built_in, parts = v["t"], PATTERNS.get(policy.code), []

    def found(number: int) -> Column:
        return F.array_contains(v["ids"], F.lit(number))

    def has(pattern: str, on: str | None = None) -> Column:
        return found(sought.pattern(pattern, on))

    for pattern in policy.regex_patterns:
        if pattern != built_in:
            parts.append(found(sought.own(pattern)))
        elif policy.code in TOPIC_CODES:
            parts.append(has(pattern) & ~(has(_TOPIC_QUESTION, on=pattern) & ~has(_OWNED, on=pattern)))
        else:
            parts.append(has(pattern))
    parts += [value.contains(normal_form(word)) for word in policy.keywords]
    special, possible = _special(policy.code, value, settings), validators.POSSIBLE.get(policy.code)
    if special is not None and policy.code == "INTERNAL_DOMAIN":
        parts.append(special)  # a configured domain may stand outside URLs
    elif special is not None:
        parts.append(has(possible, on=validators.BESIDES.get(policy.code)) & special if possible else special)
    by_intent = intents.intent(has, policy.code)
    if by_intent is not None:
        parts.append(by_intent)
    if policy.category in ("prompt_injection", "jailbreak"):
        parts += [found(sought.phrase(phrase)) for phrase in COMPACT_PHRASES.get(policy.code, [])]
    return reduce(or_, parts, F.lit(False))


def _tester(policy: Policy, sought: Patterns, settings: Settings) -> Callable[[Column], Column]:
    return lambda v: _hit(policy, v, sought, settings)


def matched_codes(policies: list[Policy], texts: Column, settings: Settings) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Column]:
    """What the scan has to be asked and what follows from it.

    Returns functions from the bound variants to the sorted codes of the policies that hit and to whether the text can't be
    judged, and the bound variants: an array of structs of a text and the numbers of what was found in it.
    """
    sought = Patterns()
    for pattern in validators.BESIDES.values():
        sought.pattern(pattern)
    ordered = sorted(policies, key=lambda p: p.code)
    probe = F.struct(F.lit("").alias("t"), F.array().cast("array<int>").alias("ids"))
    for policy in ordered:  # numbers everything that the policies look for
        _hit(policy, probe, sought, settings)
    urls = sought.pattern(validators.URL) if {p.code for p in policies} & {"INTERNAL_DOMAIN", "CONNECTION_STRING"} else None
    bound = F.transform(F.arrays_zip(texts.alias("t"), scan(texts, sought, settings.regex_timeout_seconds).alias("ids")), lambda z: F.struct(z["t"].alias("t"), z["ids"].alias("ids")))

    def codes(v: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.exists(v, _tester(p, sought, settings)), F.lit(p.code)) for p in ordered]))

    def failed(v: Column) -> Column:
        late = F.exists(v, lambda x: x["ids"].isNull())
        return late if urls is None else late | F.exists(v, lambda x: F.array_contains(x["ids"], F.lit(urls)) & validators.has_broken_url(x["t"]))

    return codes, failed, bound


def _result(codes: Column, policies: list[Policy]) -> Column:
    severity = F.create_map(*[F.lit(x) for p in policies for x in (p.code, SEVERITIES.index(p.severity))])
    reason = F.create_map(*[F.lit(x) for p in policies for x in (p.code, REASONS[p.category])])
    highest = F.array_max(F.transform(codes, lambda c: F.element_at(severity, c)))
    return F.struct(
        F.when(F.size(codes) > 0, "BLOCKED").otherwise("ALLOWED").alias("decision"),
        F.when(F.size(codes) > 0, F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), highest + 1)).alias("highest_severity"),
        codes.alias("matched_policy_codes"),
        F.sort_array(F.array_distinct(F.transform(codes, lambda c: F.element_at(reason, c)))).alias("safe_detection_summary"),
    ).cast(RESULT)


def enabled_policies(policies: list[Policy]) -> list[Policy] | None:
    """The enabled policies, or None if there is none or one is invalid: then every decision fails closed."""
    chosen = [p for p in policies if p.enabled]
    try:
        for p in chosen:
            p.validate()
    except InvalidPolicy:
        logger.warning("invalid_policy")
        return None
    return chosen or None


Scorer = Callable[[DataFrame, str], DataFrame]


def analyze(df: DataFrame, text: str = "text", *, policies: list[Policy] | None = None, settings: Settings | None = None, out: str = "analysis", scorers: list | None = None) -> DataFrame:
    """Append the decision struct of each row's text. A null text can't be judged and is blocked as unavailable.

    scorers are optional model stages (see operators.scoring); each adds categories for texts without a rule hit.
    """
    settings = settings or Settings()
    small_batches(df.sparkSession)
    chosen = enabled_policies(built_in_policies() if policies is None else policies)
    if chosen is None:
        return df.withColumn(out, unavailable())
    columns = [F.col(f"`{c}`") for c in df.columns if c != out]
    # one-element explodes keep the optimiser from copying these columns into filters that it pushes down
    varied = df.select(*columns, F.explode(F.array(variants(F.col(text)))).alias("__t"))
    codes, failed, bound_variants = matched_codes(chosen, F.col("__t"), settings)
    bound = varied.select(*columns, F.explode(F.array(bound_variants)).alias("__v"))
    both = F.struct(codes(F.col("__v")).alias("codes"), F.coalesce(F.col("__v").isNull() | failed(F.col("__v")), F.lit(True)).alias("failed"))
    judged = bound.select(*columns, F.explode(F.array(both)).alias("__j")).select(*columns, F.col("__j.codes").alias("__codes"), F.col("__j.failed").alias("__failed"))
    for scorer in scorers or []:
        judged = scorer.extend(judged, text, chosen)
    return judged.select(*columns, F.when(F.col("__failed"), unavailable()).otherwise(_result(F.col("__codes"), chosen)).alias(out))


def analyze_distinct(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Like analyze, but each distinct text is judged once and joined to its rows by hash."""
    hashed = df.withColumn("__sha", F.sha2(F.col(text), 256))
    once = analyze(hashed.select("__sha", text).dropDuplicates(["__sha"]), text, **options).drop(text)
    out = options.get("out", "analysis")
    return hashed.join(once.withColumnRenamed("__sha", "__one"), F.col("__sha").eqNullSafe(F.col("__one"))).drop("__sha", "__one").select(*df.columns, out)


def forward(df: DataFrame, analysis: str = "analysis") -> DataFrame:
    """The integration boundary: nothing is ever sent. Rows that aren't ALLOWED are refused."""
    refused = F.when(F.col(f"{analysis}.decision") != "ALLOWED", F.raise_error(F.lit("Forwarding denied")).cast("boolean"))
    return df.withColumn("forwarded", F.coalesce(refused, F.lit(False)))
