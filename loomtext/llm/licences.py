"""License scan: ordered signature rules over whole texts.

A text is lower-cased (A-Z only) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``;
the words joined by one space are what the rules read, so punctuation and
line breaks never hide a phrase. Rules are the hand-written signatures of licence
bodies and notices, and one for each form of each family in the tables below:
several hundred regexes. A rule runs only if one of its keywords occurs in the
text (each of its matches holds one) and one of the words of its form ("licen", the
verbs that open a notice). Detections are ordered by priority,
then length; one whose interval lies inside the interval of an accepted,
better one is suppressed. The base phrases are rules like the others, but
every place of theirs counts and their labels are never suppressed.

Defined results: null and empty texts have no words and no detections (empty
labels, null first and last word, score 0); repeated rows give equal rows; an empty
table gives an empty one; very long texts are read whole; columns that have a
result's name are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._frames import with_arrow_columns

#: phrase of words -> label; fixed by the contract of the scan.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | keywords of the name (any of them) | name as words (regex) | short ids as
#: words (regex). "license" also stands for "licence".
FAMILIES = r"""
apache-1.0 | apache | apache (?:software )?license (?:version )?1 0 | apache 1 0
apache-1.1 | apache | apache (?:software )?license (?:version )?1 1 | apache 1 1
apache-2.0 | apache | apache (?:software )?license (?:version |v ?)?2(?: 0)? | (?:apache 2 0|apache v?2|apachev2)
mit | mit licen / mit x11 licen | mit (?:x11 )?license | mit
mit-0 | mit | mit no attribution license | mit 0
x11 | x11 licen | x11 license | x11
isc | isc | isc license | isc
bsd-1-clause | bsd / 1 clause bsd | (?:bsd 1 clause|1 clause bsd) license | bsd 1 clause
bsd-2-clause | bsd / 2 clause bsd / simplified bsd / freebsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license | bsd 2 clause
bsd-3-clause | bsd / 3 clause bsd / new bsd / modified bsd / revised bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license | bsd 3 clause
bsd-4-clause | bsd / 4 clause bsd / original bsd | (?:bsd 4 clause|4 clause bsd|original bsd) license | bsd 4 clause
bsd | bsd | bsd(?: style)? license | bsd
0bsd | bsd | (?:zero clause bsd|bsd zero clause) license | 0bsd
gpl-1.0 | general public | gnu general public license (?:version |v ?)1(?: 0)? | (?:gpl 1 0(?: only| or later)?|gplv1|gpl v1)
gpl-2.0 | general public | gnu general public license (?:version |v ?)2(?: 0)? | (?:gpl 2 0(?: only| or later)?|gplv2|gpl v2)
gpl-3.0 | general public | gnu general public license (?:version |v ?)3(?: 0)? | (?:gpl 3 0(?: only| or later)?|gplv3|gpl v3)
gpl-any | general public | gnu general public license | gpl(?: or later)?
lgpl-2.0 | library general / lesser general | gnu (?:library|lesser) general public license (?:version |v ?)2(?: 0)? | lgpl 2 0(?: only| or later)?
lgpl-2.1 | lesser general | gnu lesser general public license (?:version |v ?)2 1 | (?:lgpl 2 1(?: only| or later)?|lgplv2 1|lgpl v2 1)
lgpl-3.0 | lesser general | gnu lesser general public license (?:version |v ?)3(?: 0)? | (?:lgpl 3 0(?: only| or later)?|lgplv3|lgpl v3)
lgpl-any | lesser general | gnu lesser general public license | lgpl
agpl-1.0 | affero | affero general public license (?:version |v ?)1(?: 0)? | agpl 1 0
agpl-3.0 | affero | (?:gnu )?affero general public license (?:version |v ?)3(?: 0)? | (?:agpl 3 0(?: only| or later)?|agplv3|agpl v3)
agpl-any | affero | (?:gnu )?affero general public license | agpl
gfdl-1.1 | documentation | gnu free documentation license (?:version |v ?)1 1 | gfdl 1 1
gfdl-1.2 | documentation | gnu free documentation license (?:version |v ?)1 2 | gfdl 1 2
gfdl-1.3 | documentation | gnu free documentation license (?:version |v ?)1 3 | gfdl 1 3
gfdl | documentation | gnu free documentation license | gfdl
mpl-1.0 | mozilla | mozilla public license (?:version |v ?)?1 0 | mpl 1 0
mpl-1.1 | mozilla | mozilla public license (?:version |v ?)?1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public license (?:version |v ?)?2(?: 0)? | mpl 2 0
epl-1.0 | eclipse | eclipse public license (?:version |v ?)?1(?: 0)? | epl 1 0
epl-2.0 | eclipse | eclipse public license (?:version |v ?)?2(?: 0)? | epl 2 0
edl-1.0 | eclipse | eclipse distribution license (?:version |v ?)?1(?: 0)? | edl 1 0
eupl-1.1 | european union | european union public license (?:version |v ?)?1 1 | eupl 1 1
eupl-1.2 | european union | european union public license (?:version |v ?)?1 2 | eupl 1 2
cddl-1.0 | common development | common development and distribution license(?: cddl)?(?: version| v)? 1 0 | cddl 1 0
cddl-1.1 | common development | common development and distribution license(?: cddl)?(?: version| v)? 1 1 | cddl 1 1
cpl-1.0 | common public | common public license (?:version |v ?)?1 0 | cpl 1 0
cpal-1.0 | common public | common public attribution license (?:version |v ?)?1 0 | cpal 1 0
ipl-1.0 | ibm | ibm public license (?:version |v ?)?1 0 | ipl 1 0
ms-pl | microsoft | microsoft public license | ms pl
ms-rl | microsoft | microsoft reciprocal license | ms rl
boost-1.0 | boost | boost software license(?: version 1 0)? | bsl 1 0
busl-1.1 | business source | business source license(?: version)? 1 1 | busl 1 1
sspl-1.0 | server side | server side public license(?: version 1)? | sspl 1 0
elastic-2.0 | elastic | elastic license (?:version |v ?)?2(?: 0)? | elastic 2 0
zlib | zlib | (?:zlib|zlib libpng) license | zlib
libpng | libpng | libpng license | libpng(?: 2 0)?
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | want to public | do what the f\w+ you want to public license | wtfpl
artistic-1.0 | artistic | artistic license (?:version )?1 0 | artistic 1 0
artistic-2.0 | artistic | artistic license (?:version )?2(?: 0)? | artistic 2 0
python-2.0 | python | python software foundation license(?: version 2)? | (?:psf|python) 2 0
php-3.01 | php | php license(?: version)? 3 01 | php 3 01
ruby | ruby | ruby license | ruby
openssl | openssl | openssl license | openssl
postgresql | postgresql | postgresql license | postgresql
ncsa | ncsa | university of illinois ncsa open source license | ncsa
ofl-1.1 | open font | (?:sil )?open font license(?: version)?(?: 1 1)? | ofl 1 1
odbl-1.0 | open database / open data commons | open (?:data commons open )?database license(?: v?1 0)? | odbl 1 0
odc-by-1.0 | open data | open data commons attribution license(?: v?1 0)? | odc by 1 0
pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication and license | pddl 1 0
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0
public-domain | public domain | (?:released|dedicated|placed|put|is) (?:in|into|to) the public domain | public domain
academic-free-3.0 | academic free | academic free license(?: version)?(?: 3 0)? | afl 3 0
osl-3.0 | open software | open software license(?: version)?(?: 3 0)? | osl 3 0
qpl-1.0 | q public | q public license(?: version)?(?: 1 0)? | qpl 1 0
vim | vim | vim license | vim
fair | fair | fair license | fair
beerware | beer | beer ?ware license | beerware
curl | curl | curl license | curl
ntp | ntp | ntp license | ntp
blueoak-1.0.0 | blue oak | blue oak model license(?: 1 0 0)? | blueoak 1 0 0
upl-1.0 | universal permissive | universal permissive license(?: v?1 0)? | upl 1 0
mulan-2.0 | mulan | mulan (?:permissive software|psl) license(?: v?2)? | mulanpsl 2 0
cecill-2.1 | cecill | cecill(?: free software)? license(?: agreement)?(?: v?2 1)? | cecill 2 1
llama-community | llama | llama \d?(?: \d )?community license | llama community
openrail | openrail | (?:creativeml )?openrail(?: m)?(?: license)? | openrail
""".strip()

#: Creative Commons variants and versions, from a rule.
_CC_PARTS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Verbs that open a notice; rules of that form wait for one of them.
_VERBS = "licensed|released|distributed|redistributed|available|provided|published|covered"

#: form: pattern around a name (N) or a short id (I), priority, confidence, words of
#: which each match holds one
_FORMS = (
    (r"spdx license identifier (?:I)", 50, 1.0, ("spdx licen",)),
    (rf"(?:made )?(?:{_VERBS}) (?:under|by|with|subject to) (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?(?:N|(?:I)(?: license)?)", 40, 0.95, ("licenced ", *(f"{v} " for v in _VERBS.split("|")))),
    (r"(?:opensource org licenses?|choosealicense com licenses|spdx org licenses) (?:I)", 30, 0.9, ("org licen", "com licen")),
    (r"(?:license (?:I)|(?:I) license[ds]?)", 25, 0.8, ("licen",)),
    (r"(?:see|under) (?:the )?(?:N)", 20, 0.8, ("see ", "under ")),
    (r"(?:N)", 10, 0.6, ()),
    (r"(?:I)", 8, 0.5, ()),
)

#: label | priority | confidence | keywords (any of them) | words of a licence's body
#: or of a notice (regex)
BODIES = r"""
mit | 60 | 1.0 | hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 58 | 0.9 | merge publish distribute | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 56 | 0.8 | above copyright notice and this permission | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software
mit-0 | 59 | 0.9 | without restriction including without limitation | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
boost-1.0 | 60 | 1.0 | any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsd | 60 | 0.95 | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | 57 | 0.7 | in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
bsd | 56 | 0.7 | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd-3-clause | 58 | 0.9 | neither the name | neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 58 | 0.9 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | 60 | 1.0 | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
ntp | 57 | 0.9 | with or without fee | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
historical-permission | 57 | 0.8 | without fee is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
apache-2.0 | 60 | 0.95 | required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 58 | 0.95 | except in compliance | you may not use this file except in compliance with the license
apache-1.1 | 57 | 0.8 | developed by the apache | this product includes software developed by the apache (?:software foundation|group)
gpl-any | 60 | 0.9 | is free software | this (?:program|software|library|file|package|code) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0 | 61 | 1.0 | version 2 of the license | gnu general public license as published by the free software foundation (?:either )?version 2 of the license
gpl-3.0 | 61 | 1.0 | version 3 of the license | gnu general public license as published by the free software foundation (?:either )?version 3 of the license
gpl-any | 56 | 0.8 | without any warranty | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl-any | 55 | 0.8 | a copy of the gnu general | you should have received a copy of the gnu general public license along with this (?:program|software|library|file|package)
lgpl-any | 60 | 0.9 | is free software | this (?:program|software|library|file|package|code) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1 | 61 | 1.0 | version 2 1 of the license | gnu lesser general public license as published by the free software foundation (?:either )?version 2 1 of the license
lgpl-3.0 | 61 | 1.0 | version 3 of the license | gnu lesser general public license as published by the free software foundation (?:either )?version 3 of the license
lgpl-any | 55 | 0.8 | copy of the gnu lesser / copy of the gnu library | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|file|package)
agpl-any | 60 | 0.9 | is free software | this (?:program|software|library|file|package|code) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3.0 | 61 | 1.0 | version 3 of the license | gnu affero general public license as published by the free software foundation (?:either )?version 3 of the license
agpl-any | 55 | 0.8 | a copy of the gnu affero | you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file|package)
gfdl | 60 | 0.9 | this document under the terms | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | 60 | 1.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 60 | 0.9 | contents of this file are subject | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | 60 | 0.9 | eclipse public license | the accompanying program is provided under the terms of this eclipse public license
epl-1.0 | 60 | 0.9 | eclipse public license | accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | 60 | 0.9 | eclipse public license | made available under the terms of the eclipse public license (?:v ?)?2 0
cddl-1.0 | 60 | 0.9 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | 60 | 0.9 | common public license | the accompanying program is provided under the terms of this common public license
ipl-1.0 | 60 | 0.9 | ibm public license | the accompanying program is provided under the terms of this ibm public license
ms-pl | 60 | 0.9 | governs use of the accompanying software | this license governs use of the accompanying software if you use the software you accept this license
zlib | 60 | 1.0 | authors be held liable | in no event will the authors be held liable for any damages arising from the use of this software
zlib | 57 | 0.8 | must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | 60 | 1.0 | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | 58 | 0.9 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | 60 | 0.9 | possible under law | to the extent possible under law (?:\S+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights
wtfpl | 60 | 1.0 | verbatim or modified copies | everyone is permitted to copy and distribute verbatim or modified copies of this license document
gpl-text | 60 | 0.9 | verbatim copies of this license | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
beerware | 60 | 1.0 | buy me a beer | if we meet some day and you think this stuff is worth it you can buy me a beer
artistic-1.0 | 60 | 0.8 | same terms as perl | you can redistribute it and or modify it under the same terms as perl itself
artistic-2.0 | 60 | 0.8 | copyright holder of a given | the copyright holder of a given free software package to maintain some measure of artistic control
ofl-1.1 | 60 | 1.0 | this font software | this font software is licensed under the sil open font license version 1 1
python-2.0 | 60 | 0.9 | making python available | psf is making python available to licensee on an as is basis
php-3.01 | 60 | 0.8 | php software freely available | this product includes php software freely available from
openssl | 60 | 0.9 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
vim | 60 | 0.9 | copies of vim | there are no restrictions on distributing unmodified copies of vim except that they must include this license text
postgresql | 60 | 0.9 | without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | 60 | 0.9 | deal with the software | files the software to deal with the software without restriction
fair | 60 | 0.9 | usage of the works | usage of the works is permitted provided that this instrument is retained with the works
upl-1.0 | 60 | 0.9 | each a larger work | a copy of the software each a larger work to which the software is contributed by such licensors
sspl-1.0 | 60 | 0.9 | third parties as a service | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | 60 | 0.9 | non production use | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2.0 | 60 | 0.9 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
odbl-1.0 | 60 | 0.9 | open database license | this database is made available under the open database license
pddl-1.0 | 60 | 0.9 | waiver and relinquishment | waiver and relinquishment of rights in the work
public-domain | 55 | 0.7 | no copyright | no copyright (?:is )?(?:claimed|reserved)
public-domain | 55 | 0.8 | work of the united states government / u s government work / us government work | (?:a work of the united states government|u s government work|us government work)
reserved-some | 5 | 0.5 | some rights | some rights reserved
copyright-notice | 5 | 0.4 | copyright | copyright (?:c )?\d{4}(?: \d{4})*
proprietary | 5 | 0.7 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 6 | 0.7 | unauthorized copying / unauthorised copying | unauthori[sz]ed copying of this (?:file|software|document)
proprietary | 6 | 0.7 | contains confidential / contains proprietary | contains (?:confidential|proprietary) (?:information|and trade secrets|trade secrets)
no-redistribution | 5 | 0.7 | redistribution | (?:no redistribution|redistribution (?:is )?(?:prohibited|not permitted))
non-commercial | 6 | 0.6 | commercial use / commercial purposes / noncommercial | (?:not for commercial use|non ?commercial use only|for non ?commercial (?:use|purposes)|no commercial use)
educational | 6 | 0.5 | educational | for (?:personal|research) and educational (?:use|purposes) only
dual | 6 | 0.6 | dual licen | dual license[ds]? under
with-permission | 6 | 0.5 | permission | (?:reprinted|reproduced|used) (?:by|with) permission
as-is | 4 | 0.3 | as is without | provided as is without (?:any )?(?:express or implied )?warranty
""".strip()

_SPACES = bytes(32 if c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Rule:
    """One signature: runs where one of the keywords and, if there are any, one of
    the words of its form occurs; higher priority wins."""

    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    confidence: float
    base: bool = False
    around: tuple[bytes, ...] = ()


@dataclass(frozen=True)
class Detection:
    """Words start to end (exclusive) of a text that a rule has matched."""

    start: int
    end: int
    rule: Rule


def _spelled(words: str) -> str:
    """Both spellings of "license", but for where a group chooses the ending."""
    return re.sub(r"\blicense", "licen[cs]e", words)


def _compiled(words: str) -> re.Pattern:
    return re.compile(rb"(?<![^ ])(?:" + words.encode() + rb")(?![^ ])")


def _leads(short: str) -> list[str]:
    """What a short id's pattern must begin with, for each of its alternatives."""
    if short.startswith("(?:"):
        depth, parts, now = 0, [], ""
        for k, c in enumerate(short):
            depth += (c == "(") - (c == ")")
            if depth == 1 and c == "|" or depth == 0:
                parts.append(now)
                now = ""
                if depth == 0:
                    break
            elif k > 2:
                now += c
        return [x for p in parts for x in _leads(p)]
    lead = re.match(r"[a-z0-9 ]*", short)[0]
    return [(lead[:-1] if short[len(lead) : len(lead) + 1] == "?" else lead).rstrip()]


def _keywords(text: str) -> tuple[bytes, ...]:
    """Keywords with both spellings, each as short as its "licen"."""
    return tuple(dict.fromkeys(re.sub(r"\blicen[cs]es?\b", "licen", x.strip()).encode() for x in text.split(" / ")))


def _families() -> list[list[str]]:
    """label, keywords, name and short ids of all families."""
    table = [[x.strip() for x in re.split(r" \| ", line)] for line in FAMILIES.splitlines()]
    for part, name in _CC_PARTS.items():
        words = part.replace("-", " ")
        for v in _CC_VERSIONS:
            table.append([f"cc-{part}-{v.replace(' ', '.')}", "cc by / creative commons", f"(?:cc {words}(?: license)?|creative commons {name}(?: license)?) {v}", f"cc {words} {v}"])
        table.append([f"cc-{part}-any", "creative commons", f"creative commons {name}", f"cc {words}"])
        table.append([f"cc-{part}-url", "creativecommons org", f"creativecommons org licenses {words}(?: \\d \\d)?", f"cc {words}"])
    return table


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, best priority first."""
    out = [Rule(label, (phrase.encode(),), _compiled(phrase), 0, 0.5, True) for phrase, label in BASE_PHRASES.items()]
    for label, keywords, name, short in _families():
        names, ids = _keywords(keywords), tuple(x.encode() for x in _leads(short))
        for form, priority, confidence, around in _FORMS:
            if form == "(?:I)" and not re.search(r"\d", short):
                continue  # a word like "mit" alone says nothing
            has = {k: re.search(rf"\b{k}\b", form) for k in "NI"}
            pattern = re.sub(r"\b([NI])\b", lambda m, n=name, i=short: n if m[1] == "N" else i, form)
            out.append(Rule(label, (names if has["N"] else ()) + (ids if has["I"] else ()), _compiled(_spelled(pattern)), priority, confidence, around=tuple(x.encode() for x in around)))
    for line in BODIES.splitlines():
        label, priority, confidence, keywords, words = (x.strip() for x in re.split(r" \| ", line))
        out.append(Rule(label, _keywords(keywords), _compiled(_spelled(words)), int(priority), float(confidence)))
    return tuple(sorted(out, key=lambda r: -r.priority))


_ONE_SPACE = re.compile(rb" ")


def normalised(text: str | bytes | None) -> bytes:
    """The words of a text, joined by one space."""
    raw = text.encode() if isinstance(text, str) else (text or b"")
    return b" ".join(raw.translate(_SPACES).split())


@lru_cache(maxsize=1)
def _by_keyword() -> dict[bytes, list[tuple[bytes, list[int]]]]:
    """Keywords with the numbers of the rules that wait for them, by the beginning
    of their first word (a keyword begins where a word of the text does)."""
    waiting: dict[bytes, list[int]] = {}
    for k, rule in enumerate(rules()):
        for word in rule.keywords:
            waiting.setdefault(word, []).append(k)
    out: dict[bytes, list[tuple[bytes, list[int]]]] = {}
    for word, wait in waiting.items():
        out.setdefault(word.split(b" ")[0][:3], []).append((word, wait))
    return out


def gated(words: bytes) -> list[Rule]:
    """The rules that may match, in their order."""
    by_keyword = _by_keyword()
    begun = {w[:3] for w in set(words.split(b" "))} & by_keyword.keys()
    open_ = {k for beginning in begun for word, wait in by_keyword[beginning] if word in words for k in wait}
    if not open_:
        return []
    every, form = rules(), {(): True}
    for k in open_:
        if (around := every[k].around) not in form:
            form[around] = any(x in words for x in around)
    return [every[k] for k in sorted(open_) if form[every[k].around]]


def detections(words: bytes, candidates: Sequence[Rule] | None = None) -> tuple[list[Detection], list[Detection]]:
    """All base detections, and those of all rules (of the candidates; those
    that pass the gate, if None) that survive suppression."""
    if not words:
        return [], []
    found = [(m.start(), m.end(), rule) for rule in (gated(words) if candidates is None else candidates) for m in rule.pattern.finditer(words)]
    spaces = [m.start() for m in _ONE_SPACE.finditer(words)] if found else []
    found = [Detection(bisect_left(spaces, a), bisect_left(spaces, b) + 1, rule) for a, b, rule in found]
    base = [x for x in found if x.rule.base]
    kept: list[Detection] = []
    for _, group in groupby(sorted(found, key=lambda x: (-x.rule.priority, x.start, -x.end, x.rule.label)), lambda x: x.rule.priority):
        better = sorted((k.start, k.end) for k in kept)
        starts = [a for a, _ in better]
        reach = list(accumulate((b for _, b in better), max))
        last = -1
        for x in group:
            before = bisect_right(starts, x.start)
            if x.end > last and not (before and x.end <= reach[before - 1]):
                kept.append(x)
            last = max(last, x.end)
    return base, sorted(kept, key=lambda x: (x.start, x.end))


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, with n_words, the base detections (n_base, first_word,
    last_word, base_labels), all labels, the score (the best confidence) and the
    surviving detections as spans of words."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())])
    fields = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("detections", T.ArrayType(span)))]

    def make(batch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns: list[list] = [[] for _ in fields]
            for value in part.column(text):
                words = normalised(value.as_py())
                base, kept = detections(words)
                mine = sorted({x.rule.label for x in base})
                every = sorted({x.rule.label for x in kept} | set(mine))
                starts = [x.start for x in base]
                score = max((x.rule.confidence for x in [*base, *kept]), default=0.0)
                row = (words.count(b" ") + 1 if words else 0, len(base), min(starts, default=None), max(starts, default=None), ",".join(mine), ",".join(every), score, [{"start": x.start, "end": x.end, "label": x.rule.label} for x in kept])
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
            yield part, [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    return with_arrow_columns(docs, fields, make)
