"""What is looked for: fields, rules, prompts and word lists, as data.

A ``Catalog`` is a parameter of every operator that matches rules, so other vocabularies run through the
same plans. ``RECORDS`` is the catalog of the school-record answer key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    field_name: str
    positive: tuple[str, ...]
    negative: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    labels: dict[str, str]  # in field order
    rules: dict[str, Rule]
    coverage: dict[str, tuple[str, ...]] = field(default_factory=dict)
    prompt_labels: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    abstention: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if set(self.labels) != set(self.rules):
            raise ValueError(f"fields without rules or labels: {sorted(set(self.labels) ^ set(self.rules))}")
        for prompt, fields in self.coverage.items():
            if unknown := set(fields) - set(self.labels):
                raise ValueError(f"{prompt} covers unknown fields: {sorted(unknown)}")
        for rule in self.rules.values():
            for pattern in (*rule.positive, *rule.negative):
                re.compile(pattern)

    @property
    def fields(self) -> list[str]:
        return list(self.labels)

    def scored(self, prompt_id: str) -> tuple[str, ...]:
        if prompt_id not in self.coverage:
            raise ValueError(f"no fields are scored for prompt {prompt_id!r}")
        return self.coverage[prompt_id]


def required_literal(pattern: str) -> str:
    """The longest text that every match of the pattern must hold, or the empty text. Cheap to test before the pattern.

    Groups of one branch are looked into; those of several, classes, and what may stand zero times break a text off.
    """
    runs, run, i = [], "", 0
    if pattern.startswith("(?") and "i" in pattern[2 : pattern.index(")")]:
        return ""  # in any case of letters
    while i < len(pattern):
        char, inside, width = pattern[i], "", 1
        literal = char if char not in ".^$|" else ""
        if char == "\\":
            width = 2
            literal = pattern[i + 1] if not pattern[i + 1].isalnum() else ""
        elif char in "([":
            width = _closed(pattern, i) - i
            literal, inside = "", pattern[i + 1 : i + width - 1] if char == "(" else ""
        elif char == "|":
            return ""
        i += width
        rest = pattern[i:]
        maybe = rest[:1] in ("?", "*") or rest[:3] in ("{0,", "{0}")
        quantified = rest[:1] in ("?", "*", "+", "{")
        if quantified:
            i = pattern.index("}", i) + 1 if rest[0] == "{" else i + 1
            i += pattern[i : i + 1] == "?"
        if literal and not maybe:
            run += literal
        if inside and not maybe and not inside.startswith("?"):
            runs.append(required_literal(inside))
        takes_none = char in "^$" or pattern[i - width : i] in (r"\b", r"\B")
        if quantified or not (literal or takes_none):
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def _closed(pattern: str, start: int) -> int:
    """The place after the bracket that closes the one at ``start``."""
    if pattern[start] == "[":
        i = start + 1 + (pattern[start + 1] == "^")
        i += pattern[i] == "]"
        while pattern[i] != "]":
            i += 2 if pattern[i] == "\\" else 1
        return i + 1
    i = start + 1
    while pattern[i] != ")":
        i = i + 2 if pattern[i] == "\\" else _closed(pattern, i) if pattern[i] in "([" else i + 1
    return i + 1


RESULT_TYPES = ("correct_present", "correct_absent", "omission", "unsupported_addition", "wrong_negative", "unscored")

# --- fixed values: fields and labels, in order -----------------------------------------------------

LABELS = {
    "aggression_present": "Aggression present",
    "self_injury_present": "Self-injury present",
    "property_destruction_present": "Property destruction present",
    "elopement_present": "Elopement present",
    "task_refusal_present": "Task refusal present",
    "verbal_disruption_present": "Verbal disruption present",
    "behavior_frequency_numeric_present": "Behavior frequency data present",
    "behavior_duration_numeric_present": "Behavior duration data present",
    "baseline_data_present": "Baseline data present",
    "function_escape_stated": "Escape function stated",
    "function_attention_stated": "Attention function stated",
    "function_tangible_stated": "Tangible function stated",
    "function_sensory_stated": "Sensory function stated",
    "bip_exists": "BIP exists",
    "fba_completed_stated": "FBA completed stated",
    "speech_services_present": "Speech services present",
    "ot_services_present": "OT services present",
    "visual_schedule_accommodation": "Visual schedule accommodation",
    "break_access_accommodation": "Break access accommodation",
    "reduced_workload_accommodation": "Reduced workload accommodation",
    "safety_plan_present": "Safety plan present",
    "restraint_or_isolation_flagged": "Restraint or isolation flagged",
    "ratio_1to1_explicitly_stated": "1:1 ratio explicitly stated",
    "ratio_2to1_explicitly_stated": "2:1 ratio explicitly stated",
}
#: Groups of the answer key: behavior, measurement, function, services, accommodations, safety, ratio.
GROUPS = {
    "A": (
        "aggression_present",
        "self_injury_present",
        "property_destruction_present",
        "elopement_present",
        "task_refusal_present",
        "verbal_disruption_present",
    ),
    "B": (
        "behavior_frequency_numeric_present",
        "behavior_duration_numeric_present",
        "baseline_data_present",
    ),
    "C": (
        "function_escape_stated",
        "function_attention_stated",
        "function_tangible_stated",
        "function_sensory_stated",
    ),
    "D": (
        "bip_exists",
        "fba_completed_stated",
        "speech_services_present",
        "ot_services_present",
    ),
    "E": (
        "visual_schedule_accommodation",
        "break_access_accommodation",
        "reduced_workload_accommodation",
    ),
    "F": (
        "safety_plan_present",
        "restraint_or_isolation_flagged",
    ),
    "G": (
        "ratio_1to1_explicitly_stated",
        "ratio_2to1_explicitly_stated",
    ),
}
COVERAGE = {
    "prompt_1": tuple(LABELS),
    "prompt_2": (*GROUPS["A"], *GROUPS["C"], *GROUPS["D"], *GROUPS["E"], *GROUPS["F"]),
    "prompt_3": GROUPS["G"],
}
PROMPT_FILES = {"prompt_1": "PROMPT 1.md", "prompt_2": "PROMPT 2.md", "prompt_3": "PROMPT 3.md"}
PROMPT_LABELS = {"prompt_1": "Broad teacher summary", "prompt_2": "Behavior and supports summary", "prompt_3": "Support level recommendation"}
NOTES = {
    "prompt_1": "Scores all 24 fields.",
    "prompt_2": "Scores behavior, function, services, accommodations, and safety fields only.",
    "prompt_3": "Scores staffing-ratio fields only.",
}

# --- fixed values: wording that says a response abstains -----------------------------------------

ABSTENTION = {
    "not_specified": r"\bnot specified\b",
    "not_stated": r"\bnot stated\b",
    "not_documented": r"\bnot documented\b",
    "not_provided": r"\bnot provided\b",
    "not_mentioned": r"\bnot mentioned\b",
    "not_included": r"\bnot included\b",
    "cannot_determine": r"\bcannot determine\b",
    "unable_to_determine": r"\bunable to determine\b",
    "insufficient_information": r"\binsufficient information\b",
    "not_enough_information": r"\bnot enough information\b",
    "unclear": r"\bunclear\b",
    "unknown": r"\bunknown\b",
    "unable_to_tell": r"\bunable to tell\b",
}

# --- fixed values: patterns of each field, what states it and what takes it back -------------------

RULES = {
    "aggression_present": Rule(
        "aggression_present",
        (
            r"\baggression\b",
            r"\baggressive\b",
            r"\bhitting\b",
            r"\bkicking\b",
            r"\bbiting\b",
            r"\bphysical aggression\b",
        ),
        (
            r"\bno aggression\b",
            r"\bnot aggressive\b",
        ),
    ),
    "self_injury_present": Rule(
        "self_injury_present",
        (
            r"\bself[- ]injur",
            r"\bself harm\b",
            r"\bhead banging\b",
            r"\bscratching self\b",
            r"\bhurting (himself|herself)\b",
        ),
        (
            r"\bno self[- ]injur",
            r"\bno self harm\b",
        ),
    ),
    "property_destruction_present": Rule(
        "property_destruction_present",
        (
            r"\bproperty destruction\b",
            r"\bbreaking items\b",
            r"\bdamaging materials\b",
            r"\bproperty damage\b",
            r"\bthrowing materials\b",
            r"\bthrowing furniture\b",
            r"\bdestroying objects\b",
        ),
        (
            r"\bno property destruction\b",
        ),
    ),
    "elopement_present": Rule(
        "elopement_present",
        (
            r"\belopement\b",
            r"\bruns away\b",
            r"\bleaves the classroom\b",
            r"\bwanders off\b",
            r"\bfleeing\b",
        ),
        (
            r"\bno elopement\b",
            r"\bno [^.]{0,20}\belopement\b",
        ),
    ),
    "task_refusal_present": Rule(
        "task_refusal_present",
        (
            r"\btask refusal\b",
            r"\bwork refusal\b",
            r"\brefuses tasks?\b",
            r"\brefusal to\b",
            r"\brefusing\b",
            r"\bavoids tasks?\b",
            r"\bnoncompliance\b",
        ),
        (
            r"\bno task refusal\b",
            r"\bno work refusal\b",
        ),
    ),
    "verbal_disruption_present": Rule(
        "verbal_disruption_present",
        (
            r"\bverbal disruption\b",
            r"\byelling\b",
            r"\bscreaming\b",
            r"\bcalling out\b",
            r"\bverbal outburst\b",
            r"\bdisruptive vocalizations\b",
            r"\bloud vocalizations\b",
        ),
        (
            r"\bno verbal disruption\b",
        ),
    ),
    "behavior_frequency_numeric_present": Rule(
        "behavior_frequency_numeric_present",
        (
            r"\b\d+\s*(times?|x|incidents?)\s*(per|a)?\s*(day|week|class|hour)\b",
            r"\b\d+\s*-\s*\d+\s*(times?|x|incidents?)\s*(per|a)?\s*(day|week|class|hour)?\b",
            r"\bfrequency\s*:\s*\d+",
            r"\boccurs?\b[^.]{0,40}\b\d+\b",
        ),
        (),
    ),
    "behavior_duration_numeric_present": Rule(
        "behavior_duration_numeric_present",
        (
            r"\bbehaviors?\b[^.]{0,60}\b(lasts?|lasting|duration)\b[^.]{0,40}\b\d+\s*(minutes?|min|hours?|hrs?)\b",
            r"\bepisodes?\b[^.]{0,80}\b\d+\s*(minutes?|min|hours?|hrs?)\b",
            r"\bduration\s*:\s*\d+",
            r"\bduration\b[^.]{0,40}\b\d+\s*(minutes?|min|hours?|hrs?)\b",
            r"\blasts?\b[^.]{0,40}\b\d+\s*(minutes?|min|hours?|hrs?)\b",
        ),
        (),
    ),
    "baseline_data_present": Rule(
        "baseline_data_present",
        (
            r"\bbaseline\b",
            r"\bcurrent level\b",
            r"\bpresent level\b",
            r"\bdata collected\b",
            r"\bdata shows\b",
        ),
        (),
    ),
    "function_escape_stated": Rule(
        "function_escape_stated",
        (
            r"\bescape\b",
            r"\bavoid(ance|ing)?\b",
            r"\bto get out of\b",
            r"\btask avoidance\b",
        ),
        (),
    ),
    "function_attention_stated": Rule(
        "function_attention_stated",
        (
            r"\badult attention\b",
            r"\bpeer attention\b",
            r"\bseeking attention\b",
            r"\battention[- ]seeking\b",
            r"\bmaintained by\b[^.]{0,80}\battention\b",
            r"\battention\b[^.]{0,30}\bfunction\b",
            r"\bto get attention\b",
        ),
        (
            r"\bnot\b[^.]{0,30}\battention\b",
            r"\bno attention[- ]seeking\b",
        ),
    ),
    "function_tangible_stated": Rule(
        "function_tangible_stated",
        (
            r"\btangible\b",
            r"\baccess to (items|preferred items|objects|activities|preferred activities)\b",
        ),
        (),
    ),
    "function_sensory_stated": Rule(
        "function_sensory_stated",
        (
            r"\bsensory function\b",
            r"\bmaintained by\b[^.]{0,80}\bsensory\b",
            r"\bsensory[- ]seeking\b",
            r"\bsensory avoidance\b",
            r"\bautomatic reinforcement\b",
            r"\bself-stimulation\b",
        ),
        (
            r"\bnot\b[^.]{0,30}\bsensory\b",
            r"\bno sensory function\b",
        ),
    ),
    "bip_exists": Rule(
        "bip_exists",
        (
            r"\bbip\b",
            r"\bbehavior intervention plan\b",
        ),
        (
            r"\bno bip\b",
            r"\bdoes not have a bip\b",
            r"\bbip\b[^.]{0,40}\bnot (provided|included|specified|documented|available)\b",
            r"\bnot (provided|included|specified|documented|available)\b[^.]{0,40}\bbip\b",
        ),
    ),
    "fba_completed_stated": Rule(
        "fba_completed_stated",
        (
            r"\bfba\b[^.]{0,40}\b(completed|conducted|done|finished)\b",
            r"\b(completed|conducted|done|finished)\b[^.]{0,40}\bfba\b",
            r"\bfba data\b",
            r"\bantecedent fba data\b",
            r"\bfunctional behavioral assessment\b[^.]{0,40}\b(completed|conducted|done|finished)\b",
            r"\bfunctional behavior assessment\b[^.]{0,40}\b(completed|conducted|done|finished)\b",
        ),
        (
            r"\bno fba\b",
            r"\bfba\b[^.]{0,40}\bnot (completed|provided|included|specified|documented)\b",
            r"\bnot (completed|provided|included|specified|documented)\b[^.]{0,40}\bfba\b",
        ),
    ),
    "speech_services_present": Rule(
        "speech_services_present",
        (
            r"\bspeech services\b",
            r"\bspeech therapy\b",
            r"\bslp\b",
            r"\bspeech-language\b",
        ),
        (
            r"\bno speech services\b",
        ),
    ),
    "ot_services_present": Rule(
        "ot_services_present",
        (
            r"\bot services\b",
            r"\boccupational therapy\b",
            r"\bot sessions?\b",
        ),
        (
            r"\bno ot services\b",
            r"\bno occupational therapy\b",
        ),
    ),
    "visual_schedule_accommodation": Rule(
        "visual_schedule_accommodation",
        (
            r"\bvisual schedule\b",
            r"\bvisual supports?\b",
            r"\bvisual routine\b",
            r"\bvisual timer\b",
            r"\bvisual choice board\b",
        ),
        (),
    ),
    "break_access_accommodation": Rule(
        "break_access_accommodation",
        (
            r"\bbreak access\b",
            r"\baccess to breaks?\b",
            r"\bmovement breaks?\b",
            r"\bsensory breaks?\b",
            r"\brequesting a break\b",
            r"\bbreak request\b",
            r"\bbreak system\b",
            r"\bbreak card\b",
            r"\bbreak button\b",
            r"\bcalm-down break\b",
        ),
        (),
    ),
    "reduced_workload_accommodation": Rule(
        "reduced_workload_accommodation",
        (
            r"\breduced workload\b",
            r"\bshortened assignments?\b",
            r"\breduced assignment\b",
            r"\bmodified workload\b",
        ),
        (),
    ),
    "safety_plan_present": Rule(
        "safety_plan_present",
        (
            r"\bsafety plan\b",
            r"\bcrisis plan\b",
            r"\bemergency response protocol\b",
        ),
        (),
    ),
    "restraint_or_isolation_flagged": Rule(
        "restraint_or_isolation_flagged",
        (
            r"\b(restraint|isolation|seclusion)\b[^.]{0,50}\b(flagged|required|used|planned|protocol)\b",
            r"\b(emergency response protocol|crisis protocol)\b",
            r"\buses? (restraint|isolation|seclusion)\b",
            r"\brequires? (restraint|isolation|seclusion)\b",
        ),
        (
            r"\bno restraint\b",
            r"\bno isolation\b",
            r"\bno seclusion\b",
            r"\bnot using restraint\b",
            r"\b(restraint|isolation|seclusion)\b[^.]{0,60}\b(not specified|not stated|not documented|not included|not indicated|not mentioned|not used|cannot determine)\b",
            r"\b(not specified|not stated|not documented|not included|not indicated|not mentioned|not used|cannot determine)\b[^.]{0,60}\b(restraint|isolation|seclusion)\b",
        ),
    ),
    "ratio_1to1_explicitly_stated": Rule(
        "ratio_1to1_explicitly_stated",
        (
            r"\b1:1\b[^.]{0,40}\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b",
            r"\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b[^.]{0,40}\b1:1\b",
            r"\bone-to-one\b[^.]{0,40}\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b",
            r"\b1 to 1\b[^.]{0,40}\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b",
        ),
        (
            r"\bnot 1:1\b",
            r"\b1:1\b[^.]{0,40}\bnot (specified|stated|documented|included|recommended)\b",
            r"\b1 to 1\b[^.]{0,40}\bnot (specified|stated|documented|included|recommended)\b",
            r"\bone-to-one\b[^.]{0,40}\bnot (specified|stated|documented|included|recommended)\b",
            r"\bnot specified\b[^.]{0,40}\b1:1\b",
            r"\bnot stated\b[^.]{0,40}\b1:1\b",
            r"\bnot documented\b[^.]{0,40}\b1:1\b",
            r"\bcannot determine\b[^.]{0,40}\b1:1\b",
            r"\bunable to determine\b[^.]{0,40}\b1:1\b",
        ),
    ),
    "ratio_2to1_explicitly_stated": Rule(
        "ratio_2to1_explicitly_stated",
        (
            r"\b2:1\b[^.]{0,40}\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b",
            r"\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b[^.]{0,40}\b2:1\b",
            r"\btwo-to-one\b[^.]{0,40}\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b",
            r"\b2 to 1\b[^.]{0,40}\b(ratio|support|supervision|staff|adult|paraeducator|aide)\b",
        ),
        (
            r"\bnot 2:1\b",
            r"\b2:1\b[^.]{0,40}\bnot (specified|stated|documented|included|recommended)\b",
            r"\b2 to 1\b[^.]{0,40}\bnot (specified|stated|documented|included|recommended)\b",
            r"\btwo-to-one\b[^.]{0,40}\bnot (specified|stated|documented|included|recommended)\b",
            r"\bnot specified\b[^.]{0,40}\b2:1\b",
            r"\bnot stated\b[^.]{0,40}\b2:1\b",
            r"\bnot documented\b[^.]{0,40}\b2:1\b",
            r"\bcannot determine\b[^.]{0,40}\b2:1\b",
            r"\bunable to determine\b[^.]{0,40}\b2:1\b",
        ),
    ),
}

RECORDS = Catalog(
    labels=LABELS,
    rules=RULES,
    coverage=COVERAGE,
    prompt_labels=PROMPT_LABELS,
    notes=NOTES,
    abstention=ABSTENTION,
)

# --- fixed values: claims ------------------------------------------------------------------------

CLAIM_SIGNALS = (
    r"\b(student|iep|bip|fba|documentation|documents)\b",
    r"\b(aggression|behavior|transition|elopement|self[- ]injury|task refusal|yelling|screaming)\b",
    r"\b(ot|speech|service|services|accommodation|schedule|break card|support|supervision|ratio)\b",
    r"\b(escape|attention|tangible|sensory|safety|restraint|isolation)\b",
    r"\b(receives?|shows?|exhibits?|uses?|includes?|requires?|needs?|occurs?|lasts?|appears?|recommended?|recommend)\b",
    r"\b(cannot determine|not specified|not stated|not documented|not included|insufficient information)\b",
    r"\b\d+\s*(times?|minutes?|hours?|x|:1)\b",
)
NO_CLAIM = (r"^here (are|is)\b", r"^overall\b", r"^in summary\b", r"^please\b", r"^thank you\b", r"^this is important to remember\b")
CLAIM_TYPES = {
    "function": r"\b(escape|attention|tangible|sensory|function|maintained by)\b",
    "service": r"\b(ot|speech|service|services|bip|fba)\b",
    "accommodation": r"\b(visual schedule|break card|accommodation|timer|visual support|graphic organizer)\b",
    "safety": r"\b(safety|restraint|isolation|crisis|unsafe)\b",
    "staffing_or_support": r"\b(1:1|2:1|supervision|support level|staffing|closer supervision)\b",
    "recommendation": r"\b(recommend|should|would be appropriate|would be needed|may need)\b",
    "behavior": r"\b(aggression|aggressive|yelling|screaming|elopement|task refusal|self[- ]injury|behavior)\b",
}
STOP_WORDS = (
    "a",
    "an",
    "and",
    "are",
    "as",
    "at",
    "based",
    "be",
    "by",
    "can",
    "does",
    "for",
    "from",
    "has",
    "have",
    "in",
    "is",
    "it",
    "of",
    "on",
    "or",
    "student",
    "the",
    "this",
    "to",
    "with",
)
UNSUPPORTABLE = r"\b(cannot determine|not specified|not stated|not documented|not included|unclear|unknown)\b"

# --- fixed values: form text ---------------------------------------------------------------------

MARKERS = ("POINTS TO CONSIDER", "POINTS THAT MUST BE CONSIDERED")
TEMPLATE_LINES = (
    r"^the parent and the school district have agreed that this student requires advanced educational planning",
    r"^the district has procedures for notifying parents regarding the use of restraint or isolation",
    r"^form 6[dh]\b",
    r"^behavioral intervention plan \(bip\) by office of superintendent",
    r"^(a \|\| )?use large print\b",
    r"^audio digital books\b",
    r"^(a \|\| )?alter format of materials\b",
    r"^provide study outlines/guides/graphic organizers\b",
    r"^cloze reading strategy\b",
    r"^read class materials orally\b",
    r"^low-vision devices\b",
    r"^sign language\b",
    r"^shortened assignments\b",
    r"^limited multiple choice\b",
    r"^modify/repeat/model directions\b",
    r"^(a \|\| )?rephrase test questions\b",
    r"^provide test/assessment study guide\b",
    r"^provide extra credit options\b",
    r"^(a \|\| )?simplify text wording/language\b",
    r"^assign peer tutor/note taker\b",
    r"^prior notice of assignments/assessments\b",
    r"^modify student.?s schedule\b",
)
INLINE_GUIDANCE = (
    r"If yes, consider the student.?s need for positive behavioral supports/ interventions, a Functional Behavioral Assessment \(FBA\), "
    r"and/or a Behavioral Intervention Plan \(BIP\)\."
)
DOCX_NOISE = (
    r"^authorization for release of records by office of superintendent of public instruction",
    r"^licensed under a ?creative commons attribution",
    r"^\*note: before providing initial special education services",
    r"^purpose: the iep is designed to clearly communicate",
)
#: Broken encodings and what they stand for, applied in this order.
MOJIBAKE = {
    "â€™": "'",
    "â€˜": "'",
    "â€œ": '"',
    "â€\x9d": '"',
    "â€“": "-",
    "â€”": "-",
    "â€¢": "- ",
    "Â ": " ",
    "Â": "",
    "â€": '"',
    "â‰¤": "<=",
}
MOJIBAKE_LEADS = ("â", "Ã", "Â")
CELL_SEPARATOR, ROW_SEPARATOR = " | ", " || "
