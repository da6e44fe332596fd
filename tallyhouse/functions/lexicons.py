"""Presence lexicons by family, and what marks awakening and threat."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of the axes, in the order they are reported
FAMILIES: dict[str, dict[str, str]] = {
    "explicit": {
        "explicit_pandemic": r"covid|corona[ -]?virus|\bcorona\b|pandemic|quarantin\w*|lock[ -]?down|social[ -]distanc\w*|self[ -]isolat\w*|\bppe\b|shelter[ -]in[ -]place",
    },
    "latent": {
        "contagion": r"\bvirus(?:es)?\b|\bviral\b|infect\w*|contagio\w*|epidemic|\bplagued?s?\b|outbreak|\bgerms?\b|bacteri\w*",
        "illness": r"\bsick(?:ness)?\b|\bill(?:ness)?(?:es)?\b|\bdiseased?s?\b|fever|cough\w*|\bsymptoms?\b|\bhospitals?\b|\bdoctors?\b|\bnurses?\b|medicine|medication|\bventilators?\b|\bicu\b|ambulance|surgery|cancer|diagnos\w*",
        "contamination": r"\bdirty\b|\bfilthy?\b|unclean|poison\w*|\btoxic\b|pollut\w*|\brot(?:ten|ting)?\b|decay\w*|sewage|\bmou?ldy?\b|putrid|\bvomit\w*|\bgrime\b|\bstench\b",
        "death": r"\bdied?s?\b|\bdying\b|\bdead\b|\bdeaths?\b|\bcorpses?\b|cadaver|\bfunerals?\b|\bgrave(?:yard)?s?\b|cemeter\w*|\bcoffins?\b|\bcaskets?\b|\bburied\b|\bburial\b|mourn\w*|morgue|\bkill(?:ed|ing|s)?\b|murder\w*",
        "mask": r"\bmasks?\b|\bmasked\b|face[ -]cover\w*",
    },
    "comparator": {
        "anxiety": r"anxious|anxiety|\bscared\b|afraid|terrif\w*|\bpanic\w*|\bchased?s?\b|\bchasing\b|\btrapped\b|frightened|\bdread\w*",
    },
    "neutral": {
        "food": r"\bfood\b|\beat(?:ing|s)?\b|\bate\b|\bmeals?\b|hungry|restaurant|kitchen",
        "family": r"\bmother\b|\bfather\b|\bmom\b|\bmum\b|\bdad\b|\bsisters?\b|\bbrothers?\b|\bfamily\b",
        "animal": r"\bdogs?\b|\bcats?\b|\banimals?\b|\bbirds?\b|\bhorses?\b|\bsnakes?\b|\bspiders?\b",
        "flying": r"\bfly(?:ing)?\b|\bflew\b|airplane|\bplanes?\b|\baircraft\b",
        "vehicle": r"\bcars?\b|\bdriv(?:e|ing|er)\b|\bdrove\b|\bbus\b|\btrains?\b",
        "school": r"\bschool\b|\bclass(?:room)?\b|\bteachers?\b|\bexams?\b|\bhomework\b",
        "water": r"\bwater\b|\bocean\b|\bsea\b|\briver\b|\bswim(?:ming)?\b|\blake\b|\bflood\w*",
    },
}
# fixed values: what marks an awakening, in English and Russian
AWAKENING = r"(\bwoke\b|\bawoke\b|\bawaken(ed|ing)?\b|\bwoken\b|\bwake up\b|\bwaking up\b|\bopened my eyes\b|\balarm went off\b|просну|пробуди|разбуди|просыпа|очнул|пробужден|открыл[а]? глаза)"
# fixed values: words of threat
THREAT = r"\b(chas(e|ed|ing)|attack|kill(ed|ing)?|murder|death|dead|die[ds]?|dying|fall(ing)?|fell|monster|demon|ghost|zombie|scream(ed|ing)?|blood(y)?|afraid|fear(ful)?|terror|terrified|panic|trapp?ed|escap(e|ing)|drown(ed|ing)?|war|gun|knife|weapon|snake|spider|threat|danger|nightmare|lost|paralyz(ed|e)|suffocat|hunt(ed|ing)?|explos|fire|flee(ing)?|fled)\b"
# fixed values: the report axes
EMOTIONS = ("fear", "anger", "sadness", "disgust", "joy", "trust", "anticipation", "surprise")
TAGS = ("danger", "weapon", "family", "flying", "animal", "health", "swimming", "place_house", "place_nature", "indoors", "outdoors", "romantic", "social", "friend", "stranger", "situation_childhood", "game", "music", "food", "object_inanimate", "object_animate")

ALL = {axis: pattern for family in FAMILIES.values() for axis, pattern in family.items()}


def family_of(axis: str) -> str:
    return next(name for name, axes in FAMILIES.items() if axis in axes)


def version(lexicon: dict[str, str] | None = None) -> str:
    """Twelve hex digits that change with any pattern."""
    return hashlib.sha256(json.dumps(ALL if lexicon is None else lexicon, sort_keys=True).encode()).hexdigest()[:12]


def presence(text: Column, axes: tuple[str, ...] = tuple(ALL)) -> dict[str, Column]:
    """0/1 for each axis; NULL texts have none."""
    return {a: F.coalesce(text.rlike(f"(?iU){ALL[a]}"), F.lit(False)).cast("int") for a in axes}


def without_explicit(text: Column) -> Column:
    """Condition: no explicit axis fires."""
    return F.greatest(*presence(text, tuple(FAMILIES["explicit"])).values(), F.lit(0)) == 0


def threat_marked(text: Column) -> Column:
    """1 where anxiety or death fires."""
    return F.greatest(*presence(text, ("anxiety", "death")).values())


def awakening(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?iU){AWAKENING}"), F.lit(False))


def threat_rate(text: Column) -> Column:
    """Matches of threat words for each [A-Za-z']+ token; 0 without tokens."""
    tokens = F.regexp_count(text, F.lit("[A-Za-z']+"))
    return F.when(tokens > 0, F.regexp_count(text, F.lit(f"(?i){THREAT}")) / F.greatest(tokens, F.lit(1))).otherwise(0.0)
