"""Signature rules for license texts, over words in lower case with one space between them.

A rule has a pattern, the words that may start it (triggers), and keywords of which one has
to stand in the window before the pattern is tried. Its gates are patterns of which one has to
occur in the text before any window is opened; few of them serve all rules. Rules are ordered: by priority, then by
place in the list. Most are made from ``LICENSES`` and five forms in which a license is
named; the sentences and the base phrases are written out. Patterns use only what all common
engines know, and end with the space after their last word.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the contract: phrases whose places are counted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label; identifier; titles, which tell the license by themselves; names, which do so only next to a word such as "license".
LICENSES = [
    ("mit", "mit", "mit license|mit licence|expat license", "mit|expat"),
    ("mit-0", "mit 0", "mit no attribution|mit no attribution license", "mit 0|mit zero"),
    ("apache-1", "apache 1 [01]", "apache license version 1 [01]|apache software license version 1 [01]", "apache 1 [01]|asl 1 [01]"),
    ("apache-2", "apache 2 0", "apache license version 2 0|apache license version 2|apache license 2 0|apache software license 2 0|apache 2 0 license", "apache 2 0|apache 2|asl 2 0|apache v2"),
    ("bsd-2", "bsd 2 clause", "bsd 2 clause license|simplified bsd license|freebsd license|2 clause bsd license", "bsd 2 clause|simplified bsd|bsd 2|2 clause bsd"),
    ("bsd-3", "bsd 3 clause", "bsd 3 clause license|modified bsd license|revised bsd license|new bsd license|3 clause bsd license", "bsd 3 clause|new bsd|bsd 3|3 clause bsd|modified bsd"),
    ("bsd-4", "bsd 4 clause", "bsd 4 clause license|original bsd license|4 clause bsd license", "bsd 4 clause|original bsd"),
    ("bsd-0", "0bsd", "zero clause bsd license|bsd zero clause license|0bsd license", "0bsd|zero clause bsd"),
    ("bsd", "bsd", "bsd license|bsd licence|bsd style license", "bsd|bsd style"),
    ("gpl-1", "gpl 1 0", "gnu general public license version 1|gnu gpl version 1", "gpl 1 0|gplv1|gpl v1"),
    ("gpl-2", "gpl 2 0", "gnu general public license version 2|gnu general public license v2|gnu gpl version 2|gnu gpl v2|gplv2", "gpl 2 0|gpl 2|gpl v2|gpl version 2"),
    ("gpl-3", "gpl 3 0", "gnu general public license version 3|gnu general public license v3|gnu gpl version 3|gnu gpl v3|gplv3", "gpl 3 0|gpl 3|gpl v3|gpl version 3"),
    ("gpl", "gpl", "gnu general public license|gnu general public licence|gnu gpl", "gpl|general public license"),
    ("lgpl-2", "lgpl 2 0", "gnu library general public license version 2|gnu library general public license", "lgpl 2 0|lgpl 2|lgplv2"),
    ("lgpl-2.1", "lgpl 2 1", "gnu lesser general public license version 2 1|gnu lesser general public license v2 1|gnu lgpl version 2 1", "lgpl 2 1|lgplv2 1|lgpl v2 1"),
    ("lgpl-3", "lgpl 3 0", "gnu lesser general public license version 3|gnu lesser general public license v3|gnu lgpl version 3|lgplv3", "lgpl 3 0|lgpl 3|lgpl v3"),
    ("lgpl", "lgpl", "gnu lesser general public license|lesser general public license|gnu lgpl", "lgpl"),
    ("agpl-3", "agpl 3 0", "gnu affero general public license version 3|gnu affero general public license v3|gnu agpl version 3|agplv3", "agpl 3 0|agpl 3|agpl v3"),
    ("agpl", "agpl", "gnu affero general public license|affero general public license|gnu agpl", "agpl"),
    ("gfdl", "gfdl 1 [0-3]", "gnu free documentation license|gnu free documentation licence|gnu fdl", "gfdl|fdl"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license version 1 1|mozilla public license 1 1|mozilla public license v 1 1", "mpl 1 1|mplv1 1"),
    ("mpl-2", "mpl 2 0", "mozilla public license version 2 0|mozilla public license 2 0|mozilla public license v 2 0", "mpl 2 0|mpl 2|mplv2"),
    ("epl-1", "epl 1 0", "eclipse public license version 1 0|eclipse public license v 1 0|eclipse public license 1 0", "epl 1 0|epl v1"),
    ("epl-2", "epl 2 0", "eclipse public license version 2 0|eclipse public license v 2 0|eclipse public license 2 0", "epl 2 0|epl v2"),
    ("cddl", "cddl 1 [01]", "common development and distribution license", "cddl|cddl 1 0"),
    ("eupl", "eupl 1 [0-2]", "european union public licence|european union public license", "eupl|eupl 1 2"),
    ("cecill", "cecill 2 [01]", "cecill free software license agreement|cecill license", "cecill|cecill b|cecill c"),
    ("isc", "isc", "isc license|isc licence", "isc"),
    ("zlib", "zlib", "zlib license|zlib libpng license", "zlib|zlib libpng"),
    ("bsl", "bsl 1 0", "boost software license version 1 0|boost software license", "bsl 1 0|boost"),
    ("busl", "busl 1 1", "business source license 1 1|business source license", "busl|busl 1 1"),
    ("artistic-1", "artistic 1 0", "artistic license 1 0|artistic license version 1 0", "artistic 1 0"),
    ("artistic-2", "artistic 2 0", "artistic license 2 0|artistic license version 2 0", "artistic 2 0|artistic 2"),
    ("python", "psf 2 0", "python software foundation license|psf license", "psf|psf 2 0|psfl"),
    ("php", "php 3 01", "php license version 3 01|php license", "php 3 01"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("w3c", "w3c", "w3c software notice and license|w3c software and document notice and license|w3c license", "w3c"),
    ("ofl", "ofl 1 1", "sil open font license version 1 1|sil open font license|open font license", "ofl|ofl 1 1"),
    ("ncsa", "ncsa", "university of illinois ncsa open source license|ncsa open source license", "ncsa"),
    ("ms-pl", "ms pl", "microsoft public license", "ms pl"),
    ("ms-rl", "ms rl", "microsoft reciprocal license", "ms rl"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license|wtfpl license", "wtfpl"),
    ("unlicense", "unlicense", "the unlicense|unlicense license", "unlicense"),
    ("odbl", "odbl 1 0", "open database license|open data commons open database license", "odbl|odbl 1 0"),
    ("pddl", "pddl 1 0", "open data commons public domain dedication and license|public domain dedication and license", "pddl"),
    ("sspl", "sspl 1 0", "server side public license", "sspl|sspl 1 0"),
    ("cc0", "cc0 1 0", "creative commons zero|cc0 1 0 universal|creative commons cc0", "cc0|cc0 1 0|cc zero"),
    ("cc-by", "cc by [1-4] [05]", "creative commons attribution [1-4] [05]|creative commons attribution license", "cc by|cc by [1-4] [05]"),
    ("cc-by-sa", "cc by sa [1-4] [05]", "creative commons attribution sharealike|creative commons attribution share alike|cc by sa", "cc by sa|cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]", "creative commons attribution noderivs|creative commons attribution noderivatives|cc by nd", "cc by nd|cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc [1-4] [05]", "creative commons attribution noncommercial|creative commons attribution non commercial|cc by nc [1-4] [05]", "cc by nc|cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", "creative commons attribution noncommercial sharealike|creative commons attribution non commercial share alike|cc by nc sa", "cc by nc sa|cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]", "creative commons attribution noncommercial noderivs|creative commons attribution noncommercial noderivatives|cc by nc nd", "cc by nc nd|cc by nc nd [1-4] [05]"),
]

#: label; start of a sentence of the license's own text; a keyword of it.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising materials"),
    ("bsd-3", "neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse", "endorse"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public"),
    ("gpl", "either version [1-3] of the license or at your option any later version", "at your option"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser", "gnu lesser"),
    ("agpl", "if your software can interact with users remotely through a computer network", "interact with users"),
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license", "agreed to in writing"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", "mozilla public"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy", "person or organization"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", "will the authors"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc0", "to the extent possible under law [^ ]+(?: [^ ]+){0,6} has waived all copyright", "waived all copyright"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free", "gnu free"),
    ("ofl", "this font software is licensed under the sil open font license", "font software"),
    ("proprietary", "all rights reserved(?: [^ ]+){0,4} unauthorized copying", "unauthorized copying"),
    ("public-domain", "(?:released|placed|dedicated) (?:into|in|to) the public domain", "public domain"),
    ("public-domain", "this (?:work|file|document|software|code) is in the public domain", "public domain"),
]

VERBS = ("licensed", "licenced", "released", "distributed", "redistributed", "available", "published", "provided", "covered", "shared", "offered")


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    triggers: tuple[str, ...]
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    gates: tuple[str, ...]


def _first_words(alternatives: str) -> tuple[str, ...]:
    return tuple(sorted({a.split(" ")[0] for a in alternatives.split("|")}))


def _keywords(*alternatives: str) -> tuple[str, ...]:
    """Plain starts of the alternatives, the shortest that cover all of them."""
    starts = {" " + a.split("[")[0].strip() for part in alternatives for a in part.split("|")}
    return tuple(sorted(s for s in starts if not any(s != o and s.startswith(o) for o in starts)))


#: In every text that names a license with this word; and what the form "... under" needs.
LICEN = " licen"
UNDER = f" (?:{'|'.join(VERBS)})(?: [a-z]+){{0,2}} under "


def _gates(alternatives: str) -> tuple[str, ...]:
    """``LICEN``, or the plain start of an alternative without that word."""
    return tuple(LICEN if LICEN in f" {a}" else f" {a.split('[')[0].strip()}" for a in alternatives.split("|"))


def _rules() -> list[Rule]:
    out = [Rule(f"base {label}", label, (phrase.split(" ")[0],), phrase, (f" {phrase} ",), 0, 0.95, _gates(phrase)) for phrase, label in BASE.items()]
    forms: list[list[Rule]] = [[] for _ in range(5)]
    for label, code, titles, names in LICENSES:
        every = f"(?:{titles}|{names})"
        forms[0].append(Rule(f"identifier {label}", label, ("spdx",), f"spdx license identifier {code}(?: only| or later)?", _keywords(code), 1, 1.0, (LICEN,)))
        forms[1].append(Rule(f"address {label}", label, ("opensource", "spdx", "choosealicense"), f"(?:opensource org|spdx org|choosealicense com) licenses {code}(?: html| php)?", _keywords(code), 2, 0.95, (LICEN,)))
        notice = rf"(?:{'|'.join(VERBS)})(?: [a-z]+){{0,2}} under(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? {every}(?: licen[cs]e)?"
        forms[2].append(Rule(f"notice {label}", label, VERBS, notice, _keywords(titles, names), 3, 0.9, (UNDER,)))
        forms[3].append(Rule(f"field {label}", label, ("license", "licence", "licenses"), f"licen[cs]es?(?: type| name)?(?: is)?(?: the)? {every}", _keywords(titles, names), 4, 0.8, (LICEN,)))
        title = f"(?:{titles}|(?:{names}) licen[cs]ed?)"
        forms[4].append(Rule(f"title {label}", label, _first_words(f"{titles}|{names}"), title, _keywords(titles, names), 5, 0.7, (LICEN, *_gates(titles))))
    for rules in forms:
        out += rules
    for number, (label, sentence, keyword) in enumerate(SENTENCES):
        triggers = ("released", "placed", "dedicated") if sentence.startswith("(?:") else (sentence.split(" ")[0],)
        out.append(Rule(f"sentence {number} {label}", label, triggers, sentence, (f" {keyword}",), 1, 1.0, (f" {keyword}",)))
    return out


RULES = _rules()
