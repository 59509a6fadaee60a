"""Flags text that reads as instructions to a model, in English and Turkish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts shorter than this are not looked at.
LEAST_CHARS = 24
# The markers in their order, each with what folded text it is seen in.
MARKERS = (
    ("instruction_override", r"\b(?:ignore|disregard|forget)\b.{0,40}\b(?:previous|prior|earlier|above)\b.{0,30}\b(?:instruction|prompt|rule|message)|\b(?:onceki|yukaridaki)\b.{0,30}\b(?:talimat|kural|komut)\w*.{0,30}\b(?:unut|yok say|dikkate alma)"),
    ("role_reassignment", r"\byou are (?:now|no longer)\b|\bact as (?:an?|the)\b.{0,30}\b(?:admin|root|developer|system)|\b(?:artik|bundan sonra) sen\b"),
    ("system_impersonation", r"(?:^|\n)\s*+(?:\[|<\|?)?(?:system|sistem)(?:\]|\|?>|:)\s*\S|<system[ _-](?:prompt|reminder)>"),
    ("secrecy_request", r"\b(?:do not|don't|never) (?:tell|mention|reveal|show)\b.{0,30}\b(?:user|anyone|human)|\bkullanici\w*.{0,20}\b(?:soyleme|gosterme|belli etme)"),
    ("hidden_text", "[\u200b\u200c\u2060\ufeff]{3}|[\U000e0020-\U000e007e]{3}|<[a-z]+[^>]{0,80}(?:display\\s*:\\s*none|font-size\\s*:\\s*0)"),
)


#: Any match of a marker holds one of these; finding a word is far cheaper than trying a pattern at each place.
NEEDLES = {
    "instruction_override": ("ignore", "disregard", "forget", "onceki", "yukaridaki"),
    "role_reassignment": ("you are no", "act as a", "act as the", "artik sen", "bundan sonra sen"),
    "system_impersonation": ("system", "sistem"),
    "secrecy_request": ("do not ", "don't ", "never ", "kullanici"),
    "hidden_text": ("\u200b", "\u200c", "\u2060", "\ufeff", "display", "font-size"),
}
#: Characters that no needle stands for.
TAGS = "[\U000e0020-\U000e007e]"


def fold(text: Column) -> Column:
    """Lower case with Turkish letters as their plain forms."""
    folded = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    for letter, plain in zip("ışğüöç", "isguoc", strict=True):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def _seen(folded: Column, name: str, pattern: str) -> Column:
    may = F.lit(False)
    for needle in NEEDLES[name]:
        may |= F.contains(folded, F.lit(needle))
    if name == "hidden_text":
        may |= folded.rlike(TAGS)
    return may & folded.rlike(pattern)


def detect_injection(text: Column) -> Column:
    """The markers seen in a text, in their fixed order."""
    # Within the lambda the folded text is one value, whatever number of patterns looks at it.
    look = lambda folded: F.array_compact(F.array(*[F.when(_seen(folded, name, pattern), name) for name, pattern in MARKERS]))
    seen = F.element_at(F.transform(F.array(fold(text)), look), 1)
    return F.when(F.coalesce(F.length(text), F.lit(0)) >= LEAST_CHARS, seen).otherwise(F.expr("cast(array() as array<string>)"))
