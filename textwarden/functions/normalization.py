"""Text as detectors should see it, with the way back to where each character came from."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

from textwarden.functions.detectors import Hit, ScanConfig, find

#: Marks after one character beyond which the rest are dropped: normalizing long runs is slow.
MOST_MARKS = 30
ENCODED = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")


@dataclass(frozen=True)
class Normalized:
    """``text`` with, for each of its characters, the span of the source it stands for."""

    text: str
    starts: list[int]
    ends: list[int]

    def to_source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span that is not empty."""
        return min(self.starts[start:end]), max(self.ends[start:end])


def _decoded(text: str) -> list[tuple[str, int, int]]:
    """Characters with source spans, percent-encoded runs of UTF-8 read as what they stand for."""
    out, at = [], 0
    for m in ENCODED.finditer(text):
        out += [(c, i, i + 1) for i, c in enumerate(text[at : m.start()], at)]
        raw = unquote_to_bytes(m.group())
        try:
            place = m.start()
            for c in raw.decode("utf-8"):
                width = 3 * len(c.encode("utf-8"))
                out.append((c, place, place + width))
                place += width
        except UnicodeDecodeError:
            out += [(c, i, i + 1) for i, c in enumerate(m.group(), m.start())]
        at = m.end()
    return out + [(c, i, i + 1) for i, c in enumerate(text[at:], at)]


def normalize(text: str) -> Normalized:
    """Percent-decoded, without invisible characters, in compatible composed form."""
    if text.isascii() and "%" not in text:
        return Normalized(text, list(range(len(text))), list(range(1, len(text) + 1)))
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    run: list[str] = []
    lo = hi = marks = 0

    def close() -> None:
        composed = unicodedata.normalize("NFC", "".join(run))
        out.extend(composed)
        starts.extend([lo] * len(composed))
        ends.extend([hi] * len(composed))
        run.clear()

    for c, a, b in _decoded(text):
        if INVISIBLE.match(c):
            continue
        for d in unicodedata.normalize("NFKD", c):
            if unicodedata.combining(d) and run:
                marks += 1
                if marks <= MOST_MARKS:
                    run.append(d)
                hi = max(hi, b)
            else:
                close()
                run.append(d)
                lo, hi, marks = a, b, 0
    close()
    return Normalized("".join(out), starts, ends)


def find_all(text: str, config: ScanConfig) -> list[Hit]:
    """Hits in the normalized text, at their places in the source; e-mail addresses and database URIs also as written."""
    if text.isascii() and "%" not in text or not ENCODED.search(text) and not INVISIBLE.search(text) and unicodedata.is_normalized("NFKC", text):
        return find(text, config)
    n = normalize(text)
    mapped = [(entity, *n.to_source(a, b), score, label) for entity, a, b, score, label in find(n.text, config)]
    return mapped + [h for h in find(text, config) if h[0] in ("EMAIL", "DB_URI")]
