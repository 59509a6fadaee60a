"""Licences that a text names or quotes: ordered signature rules over its words, as Spark expressions.

A text becomes its words, A-Z in lower case, one space around each. A rule is a pattern over
whole words with the keywords that any match holds, a priority and a score; a text meets only
the rules whose keywords are among its words. Places are counted in words: matches are
marked in the text, which is then split once, so long texts take time in proportion. Of
detections that overlap, one that lies inside another of the same or a higher priority is
suppressed; a running maximum over the detections in order of start decides it.

Rules are the licences below, each in the wordings of ``WORDINGS``, and the sentences of
``SENTENCES``. The phrases of ``BASE`` are found at every place and are never suppressed.

Defined cases: a null text is empty; a text without words or rules has score 0 and empty
labels; equal detections are one, the first in the order of the rules; repeated rows are
scanned each; an empty table gives an empty result; other columns stay, and columns named
``licenses``, ``base_places`` or ``n_words`` give way.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.scans import let, scan

# What counts as a word, and the phrases of the base with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.95

_V = r"(?:v |v|version )?"
#: Label, how the name is written in words, and words of which every writing holds one.
LICENSES = [
    ("mit", r"mit", "mit"),
    ("mit-0", r"mit (?:0|no attribution)", "mit"),
    ("apache-1.1", rf"apache (?:software )?{_V}1 1", "apache"),
    ("apache-2", rf"apache (?:software )?{_V}2(?: 0)?", "apache"),
    ("bsd-2-clause", r"(?:bsd (?:2|two) clause|simplified bsd|freebsd)", "bsd freebsd"),
    ("bsd-3-clause", r"(?:bsd (?:3|three) clause|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", r"(?:bsd (?:4|four) clause|original bsd|old bsd)", "bsd"),
    ("0bsd", r"(?:0bsd|zero clause bsd)", "0bsd bsd"),
    ("gpl-2.0", rf"(?:gnu )?(?:gpl|general public license) ?{_V}2(?: 0)?", "gpl general"),
    ("gpl-3.0", rf"(?:gnu )?(?:gpl|general public license) ?{_V}3(?: 0)?", "gpl general"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lgpl|lesser general public license) ?{_V}2 1", "lgpl lesser"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lgpl|lesser general public license) ?{_V}3(?: 0)?", "lgpl lesser"),
    ("agpl-3.0", rf"(?:gnu )?(?:agpl|affero general public license) ?{_V}3(?: 0)?", "agpl affero"),
    ("gfdl-1.3", rf"(?:gnu )?(?:gfdl|free documentation license) ?{_V}1 3", "gfdl documentation"),
    ("mpl-1.1", rf"(?:mpl|mozilla public license) ?{_V}1 1", "mpl mozilla"),
    ("mpl-2.0", rf"(?:mpl|mozilla public license) ?{_V}2(?: 0)?", "mpl mozilla"),
    ("epl-1.0", rf"(?:epl|eclipse public license) ?{_V}1(?: 0)?", "epl eclipse"),
    ("epl-2.0", rf"(?:epl|eclipse public license) ?{_V}2(?: 0)?", "epl eclipse"),
    ("edl-1.0", r"eclipse distribution license(?: v?1 0)?", "eclipse"),
    ("eupl-1.2", rf"(?:eupl|european union public license) ?{_V}1 2", "eupl european"),
    ("cddl-1.0", rf"(?:cddl|common development and distribution license) ?{_V}1 0", "cddl distribution"),
    ("cpl-1.0", rf"common public license ?{_V}1 0", "common"),
    ("osl-3.0", rf"(?:osl|open software license) ?{_V}3 0", "osl open"),
    ("afl-3.0", rf"(?:afl|academic free license) ?{_V}3 0", "afl academic"),
    ("artistic-2.0", rf"artistic (?:license )?{_V}2(?: 0)?", "artistic"),
    ("isc", r"isc", "isc"),
    ("zlib", r"(?:zlib|zlib libpng)", "zlib"),
    ("libpng", r"(?:libpng|png reference library)", "libpng png"),
    ("bsl-1.0", rf"(?:boost (?:software )?|bsl ){_V}1 0", "boost bsl"),
    ("busl-1.1", r"(?:busl 1 1|business source)", "busl business"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl fuck"),
    ("cc0-1.0", r"(?:cc0(?: 1 0)?|creative commons zero)", "cc0 zero"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4] 0)?(?! (?:nc|sa|nd|non|share|no))", "cc commons"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?", "cc commons"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] 0)?", "cc commons"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?(?! (?:sa|nd|share|no))", "cc commons"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?", "cc commons"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] 0)?", "cc commons"),
    ("odbl-1.0", rf"(?:odbl|open database license) ?{_V}1 0", "odbl database"),
    ("pddl-1.0", r"(?:pddl(?: 1 0)?|public domain dedication and license)", "pddl domain"),
    ("ofl-1.1", rf"(?:ofl|sil open font license) ?{_V}1 1", "ofl font"),
    ("psf-2.0", r"(?:psf(?: 2 0)?|python software foundation)", "psf python"),
    ("php-3.01", r"php (?:license )?(?:version )?3 0?1", "php"),
    ("postgresql", r"postgresql", "postgresql"),
    ("openssl", r"openssl", "openssl"),
    ("ms-pl", r"(?:ms pl|microsoft public)", "ms microsoft"),
    ("ms-rl", r"(?:ms rl|microsoft reciprocal)", "ms microsoft"),
    ("upl-1.0", rf"(?:upl|universal permissive license) ?{_V}1 0", "upl universal"),
    ("ncsa", r"(?:ncsa|university of illinois ncsa)", "ncsa"),
    ("json", r"json", "json"),
    ("vim", r"vim", "vim"),
    ("beerware", r"beer ?ware", "beerware beer"),
]
_TERMS = r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
#: Kind, wording with NAME in it, words that it holds, priority (1 is the highest) and score.
WORDINGS = [
    ("tag", r"spdx license identifier NAME", "spdx license identifier", 1, 1.0),
    ("grant", rf"(?:licensed|released|distributed|available|provided|published|offered|dual licensed) under {_TERMS}NAME(?: license)?", "under", 1, 0.95),
    ("under", rf"under {_TERMS}NAME license", "under license", 1, 0.9),
    ("field", r"license (?:is |type |name )?(?:the )?NAME", "license", 2, 0.8),
    ("named", r"NAME (?:public |software |open source )?license", "license", 2, 0.7),
    ("page", r"(?:opensource|spdx|choosealicense|creativecommons) (?:org|com) licenses (?:by )?NAME", "licenses", 2, 0.85),
]
#: Sentences of licence texts: label, pattern, words that it holds, priority and score.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission hereby granted obtaining", 1, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice copies", 1, 0.8),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission distribute purpose fee", 1, 0.9),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary forms permitted", 1, 0.85),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse", "neither contributors endorse", 1, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials mentioning", 1, 0.95),
    ("apache-2", r"licensed under the apache license version 2 0 the license you may not use this file", "apache license version file", 1, 1.0),
    ("apache-2", r"www apache org licenses license 2 0", "apache org licenses", 1, 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "program free redistribute gnu", 1, 0.9),
    ("gpl", r"www gnu org licenses(?: gpl)?", "gnu org licenses", 2, 0.7),
    ("gpl-2.0-or-later", r"general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:of the license )?or at your option any later version", "general option later", 1, 0.95),
    ("gpl-3.0-or-later", r"general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or at your option any later version", "general option later", 1, 0.95),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "library free redistribute gnu", 1, 0.9),
    ("agpl", r"gnu affero general public license", "affero", 2, 0.7),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source form mozilla", 1, 1.0),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse", "accompanying materials eclipse", 1, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 1, 1.0),
    ("public-domain", r"(?:released into|dedicated to|placed in|is in) the public domain", "public domain", 2, 0.7),
    ("cc0-1.0", r"creativecommons org publicdomain zero", "creativecommons publicdomain", 1, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express implied authors", 1, 0.8),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "permission organization accompanying", 1, 1.0),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "everyone verbatim changing", 1, 0.95),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font sil", 1, 1.0),
    ("artistic", r"the artistic license", "artistic license", 3, 0.5),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "beer stuff", 1, 1.0),
    ("json", r"the software shall be used for good not evil", "good evil", 1, 1.0),
    ("all-rights-reserved", r"all rights reserved", "rights reserved", 3, 0.5),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary confidential", 2, 0.7),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution) (?:of this (?:file|software) )?(?:[^ ]+ ){0,4}(?:is )?(?:strictly )?prohibited", "prohibited", 2, 0.7),
    ("non-commercial", r"(?:for )?non ?commercial use only", "use only", 2, 0.6),
    ("gpl", r"gnu general public license", "gnu general license", 3, 0.5),
    ("lgpl", r"gnu lesser general public license", "gnu lesser license", 3, 0.5),
    ("mpl", r"mozilla public license", "mozilla license", 3, 0.5),
    ("apache", r"apache license", "apache license", 3, 0.5),
    ("creative-commons", r"creative commons(?: license)?", "creative commons", 3, 0.5),
]
LEVELS = 3


def rules() -> list[dict]:
    """All rules in their order: those of sentences first, then each wording with each licence."""
    made = [(label, pattern, words, words, priority, score, "sentence") for label, pattern, words, priority, score in SENTENCES]
    for kind, wording, words, priority, score in WORDINGS:
        made += [(label, wording.replace("NAME", name), words, one_of, priority, score, kind) for label, name, one_of in LICENSES]
    return [
        {"rule": i, "label": label, "pattern": rf"(?<= )(?:{pattern})(?= )", "words": words.split(), "one_of": one_of.split(), "priority": priority, "score": score, "kind": kind}
        for i, (label, pattern, words, one_of, priority, score, kind) in enumerate(made)
    ]


_RULE = "array<struct<rule:int,label:string,pattern:string,words:array<string>,one_of:array<string>,priority:int,score:double,kind:string>>"
_HITS = "array<struct<start:int,end:int,priority:int,rule:int,label:string,score:double>>"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Words hold no control characters, so these can mark the first and last word of a match.
_OPEN, _CLOSE = "\x01", "\x02"


def _places(marked: Column, found) -> Column:
    """Numbers, from 0, of the words that ``found`` accepts; before the first word there is an empty piece."""
    return F.filter(F.transform(marked, lambda word, i: F.when(found(word), i - 1)), lambda place: place.isNotNull())


def _marked_words(norm: Column, pattern: Column, by: str) -> Column:
    return F.split(F.regexp_replace(norm, pattern, F.lit(by)), " ")


def _phrase_places(norm: Column, phrase: str) -> Column:
    """Where the words of a phrase stand in a row, overlaps included."""
    places = _places(_marked_words(norm, F.lit(f"(?<= )(?={phrase} )"), _OPEN), lambda w: F.startswith(w, F.lit(_OPEN)))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), places).otherwise(F.expr("cast(array() as array<int>)"))


def _base_places(norm: Column, phrase: str, label: str) -> Column:
    return F.transform(_phrase_places(norm, phrase), lambda start: F.struct(F.lit(label).alias("label"), start.alias("start")))


def _rule_hits(norm: Column, rule: Column) -> Column:
    def spans(marked: Column) -> Column:
        starts = _places(marked, lambda w: F.startswith(w, F.lit(_OPEN)))
        ends = F.transform(_places(marked, lambda w: F.endswith(w, F.lit(_CLOSE))), lambda last: last + 1)
        return F.zip_with(
            starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["score"].alias("score"))
        )

    return let(_marked_words(norm, rule["pattern"], f"{_OPEN}$0{_CLOSE}"), spans)


def outermost(hits: Column) -> Column:
    """Detections, in order of start, that lie inside no other of the same or a higher priority; of equal ones the first by rule."""
    # Longer before shorter at one start, so whatever contains a detection stands before it.
    keyed = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["priority"].alias("priority"), x["rule"].alias("rule"), x.alias("hit")))

    def kept(ordered: Column) -> Column:
        reach = F.transform(ordered, lambda x: F.struct(*[F.when(x["priority"] == p, -x["minus_end"]).otherwise(-1).alias(f"p{p}") for p in range(1, LEVELS + 1)]))
        zero = F.struct(*[F.lit(-1).alias(f"p{p}") for p in range(1, LEVELS + 1)])
        further = lambda a, b: F.struct(*[F.greatest(a[f"p{p}"], b[f"p{p}"]).alias(f"p{p}") for p in range(1, LEVELS + 1)])
        before = scan(reach, zero, further)

        def covered(x: Column, r: Column) -> Column:
            upper = F.when(x["priority"] == 1, r["p1"]).when(x["priority"] == 2, F.greatest(r["p1"], r["p2"])).otherwise(F.greatest(r["p1"], r["p2"], r["p3"]))
            return upper >= -x["minus_end"]

        pairs = F.zip_with(ordered, before, lambda x, r: F.struct(x["hit"].alias("hit"), covered(x, r).alias("covered")))
        return F.transform(F.filter(pairs, lambda x: ~x["covered"]), lambda x: x["hit"])

    return let(F.array_sort(keyed), kept)


def find_licenses(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``n_words``, ``base_places`` (label and word place of each base phrase) and ``licenses``.

    ``licenses`` holds the detections that are left: start and end in words,
    priority, number of the rule, label and score, in order of start.
    """
    made = rules()
    keywords = sorted({w for rule in made for w in rule["words"] + rule["one_of"]})
    table = F.from_json(F.lit(json.dumps(made)), _RULE)
    none = F.expr(f"cast(array() as {_HITS})")
    norm, present = F.col("__norm"), F.col("__present")
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), *_LOWER)
    found = documents.drop("licenses", "base_places", "n_words").withColumn("__plain", F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, BETWEEN, " ")), F.lit(" ")))
    # One space before each word and one after the last; for the rules, the other spelling of license is read as this one.
    found = found.withColumns(
        {
            "n_words": F.when(F.col("__plain") == "  ", F.lit(0)).otherwise(F.length("__plain") - F.length(F.replace("__plain", F.lit(" "), F.lit(""))) - 1).cast("long"),
            "__norm": F.replace(F.replace("__plain", F.lit(" licence"), F.lit(" license")), F.lit("  "), F.lit(" ")),
        }
    )
    found = found.withColumn("__present", F.array_intersect(F.split("__norm", " "), F.array(*[F.lit(w) for w in keywords])))
    meets = F.filter(table, lambda r: F.forall(r["words"], lambda w: F.array_contains(present, w)) & F.arrays_overlap(r["one_of"], present) & F.rlike(norm, r["pattern"]))
    hits = F.when(F.size(present) > 0, F.flatten(F.transform(meets, lambda r: _rule_hits(norm, r)))).otherwise(none)
    base = F.concat(*[_base_places(F.col("__plain"), phrase, label) for phrase, label in BASE.items()])
    found = found.withColumns({"base_places": base, "__hits": hits}).drop("__plain", "__norm", "__present")
    return found.withColumn("licenses", F.when(F.size("__hits") > 0, outermost(F.col("__hits"))).otherwise(none)).drop("__hits")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(documents: DataFrame) -> DataFrame:
    """One row a document: words, places of the base phrases, labels of the base and of all rules, and the best score."""
    found = find_licenses(documents.select("doc_id", "text"))
    base, starts = F.transform("base_places", lambda x: x["label"]), F.transform("base_places", lambda x: x["start"])
    of_rules = F.transform("licenses", lambda x: x["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["score"])), F.lit(0.0)), F.when(F.size("base_places") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, of_rules)).alias("labels"),
        best.alias("score"),
    )
