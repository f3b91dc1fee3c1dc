"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regex with a label, a priority, a confidence and the keywords without which it cannot
match.  Texts without any keyword are never given to a regex.  Detections are resolved in order of
priority: one whose interval lies inside the interval of a detection of a higher priority (or of the
same priority and longer) is suppressed.

The rules come from one table of licence families, each with hand-written patterns for its name, its
SPDX identifiers and its addresses, put into four contexts (grant, SPDX tag, address, title), and from
a list of single rules for phrases of licence texts and notices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: bytes of words in UTF-8: digits, lower-case letters and everything beyond ASCII
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TO_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
W, NW = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"

#: phrase and label; a place is where the phrase's words stand consecutively
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: label | name | SPDX identifiers | address | keywords, any of which the name holds.
#: In a name a space stands for any run of spaces, commas, hyphens and line ends.
FAMILIES = r"""
mit | (?:the )?mit(?:/x11| x11)? licen[cs]e | mit | opensource\.org/licenses?/mit | mit
mit-0 | mit no attribution(?: licen[cs]e)? | mit-0 | opensource\.org/licenses?/mit-0 | no attribution
apache-2.0 | apache(?: software)? licen[cs]e(?: version| v\.?)? 2(?:\.0)? | apache-2\.0 | apache\.org/licenses/license-2\.0 | apache
apache-1.1 | apache(?: software)? licen[cs]e(?: version| v\.?)? 1\.1 | apache-1\.1 | apache\.org/licenses/license-1\.1 | apache
apache-1.0 | apache(?: software)? licen[cs]e(?: version| v\.?)? 1\.0 | apache-1\.0 | apache\.org/licenses/license-1\.0 | apache
gpl-3.0 | (?:gnu )?general public licen[cs]e(?: version| v\.?)? 3(?:\.0)?|gnu gpl ?v?3(?:\.0)?|gpl ?v3 | gpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/gpl-3\.0 | general public,gpl
gpl-2.0 | (?:gnu )?general public licen[cs]e(?: version| v\.?)? 2(?:\.0)?|gnu gpl ?v?2(?:\.0)?|gpl ?v2 | gpl-2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0 | general public,gpl
gpl-1.0 | (?:gnu )?general public licen[cs]e(?: version| v\.?)? 1(?:\.0)?|gpl ?v1 | gpl-1\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0 | general public,gpl
lgpl-3.0 | (?:gnu )?lesser general public licen[cs]e(?: version| v\.?)? 3(?:\.0)?|lgpl ?v?3(?:\.0)? | lgpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/lgpl-3\.0 | lesser general,lgpl
lgpl-2.1 | (?:gnu )?lesser general public licen[cs]e(?: version| v\.?)? 2\.1|lgpl ?v?2\.1 | lgpl-2\.1(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1 | lesser general,lgpl
lgpl-2.0 | (?:gnu )?library general public licen[cs]e(?: version| v\.?)? 2(?:\.0)?|lgpl ?v?2\.0 | lgpl-2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0 | library general,lgpl
agpl-3.0 | (?:gnu )?affero general public licen[cs]e(?: version| v\.?)? 3(?:\.0)?|agpl ?v?3(?:\.0)? | agpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/agpl-3\.0 | affero,agpl
gfdl-1.3 | (?:gnu )?free documentation licen[cs]e(?: version| v\.?)? 1\.3 | gfdl-1\.3(?:-only|-or-later)? | gnu\.org/licenses/fdl-1\.3 | free documentation
gfdl-1.2 | (?:gnu )?free documentation licen[cs]e(?: version| v\.?)? 1\.2 | gfdl-1\.2(?:-only|-or-later)? | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2 | free documentation
gfdl | (?:gnu )?free documentation licen[cs]e | gfdl | gnu\.org/copyleft/fdl | free documentation
bsd-2-clause | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)? | bsd-2-clause | opensource\.org/licenses?/bsd-2-clause | bsd
bsd-3-clause | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)? | bsd-3-clause | opensource\.org/licenses?/bsd-3-clause | bsd
bsd-4-clause | (?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)? | bsd-4-clause | spdx\.org/licenses/bsd-4-clause | bsd
0bsd | (?:zero clause bsd|bsd zero clause|bsd 0 clause)(?: licen[cs]e)? | 0bsd | opensource\.org/licenses?/0bsd | bsd
bsd | (?:the )?bsd(?: style)? licen[cs]e | bsd | opensource\.org/licenses?/bsd-license | bsd
isc | (?:the )?isc licen[cs]e | isc | opensource\.org/licenses?/isc | isc
zlib | (?:the )?zlib(?:/libpng)? licen[cs]e | zlib | opensource\.org/licenses?/zlib | zlib
libpng | (?:the )?libpng licen[cs]e(?: version 2)? | libpng(?:-2\.0)? | libpng\.org/pub/png/src/libpng-license | libpng
mpl-2.0 | mozilla public licen[cs]e(?: version| v\.?)? 2(?:\.0)?|mpl ?v?2(?:\.0)? | mpl-2\.0 | mozilla\.org/(?:en-us/)?mpl/2\.0 | mozilla,mpl
mpl-1.1 | mozilla public licen[cs]e(?: version| v\.?)? 1\.1|mpl ?v?1\.1 | mpl-1\.1 | mozilla\.org/(?:en-us/)?mpl/1\.1 | mozilla,mpl
mpl-1.0 | mozilla public licen[cs]e(?: version| v\.?)? 1\.0|mpl ?v?1\.0 | mpl-1\.0 | mozilla\.org/(?:en-us/)?mpl/1\.0 | mozilla,mpl
epl-2.0 | eclipse public licen[cs]e(?: version| v\.?)? 2(?:\.0)?|epl ?v?2(?:\.0)? | epl-2\.0 | eclipse\.org/legal/epl-2\.0 | eclipse,epl
epl-1.0 | eclipse public licen[cs]e(?: version| v\.?)? 1(?:\.0)?|epl ?v?1(?:\.0)? | epl-1\.0 | eclipse\.org/legal/epl-v10 | eclipse,epl
cddl-1.0 | common development and distribution licen[cs]e(?: version| v\.?)? 1\.0|cddl ?v?1\.0 | cddl-1\.0 | opensource\.org/licenses?/cddl-1\.0 | common development,cddl
cddl-1.1 | common development and distribution licen[cs]e(?: version| v\.?)? 1\.1|cddl ?v?1\.1 | cddl-1\.1 | oss\.oracle\.com/licenses/cddl | common development,cddl
cpl-1.0 | common public licen[cs]e(?: version| v\.?)? 1(?:\.0)? | cpl-1\.0 | opensource\.org/licenses?/cpl1\.0 | common public
ipl-1.0 | ibm public licen[cs]e(?: version| v\.?)? 1(?:\.0)? | ipl-1\.0 | opensource\.org/licenses?/ipl-1\.0 | ibm public
osl-3.0 | open software licen[cs]e(?: version| v\.?)? 3(?:\.0)? | osl-3\.0 | opensource\.org/licenses?/osl-3\.0 | open software
afl-3.0 | academic free licen[cs]e(?: version| v\.?)? 3(?:\.0)? | afl-3\.0 | opensource\.org/licenses?/afl-3\.0 | academic free
artistic-2.0 | artistic licen[cs]e(?: version| v\.?)? 2(?:\.0)? | artistic-2\.0 | perlfoundation\.org/artistic-license-2-0 | artistic
artistic-1.0 | artistic licen[cs]e(?: version| v\.?)? 1(?:\.0)? | artistic-1\.0(?:-perl|-cl8)? | opensource\.org/licenses?/artistic-1\.0 | artistic
artistic | (?:the )?artistic licen[cs]e | artistic | dev\.perl\.org/licenses/artistic | artistic
ms-pl | microsoft public licen[cs]e | ms-pl | opensource\.org/licenses?/ms-pl | microsoft public
ms-rl | microsoft reciprocal licen[cs]e | ms-rl | opensource\.org/licenses?/ms-rl | microsoft reciprocal
bsl-1.0 | boost software licen[cs]e(?: version| v\.?)?(?: 1\.0)? | bsl-1\.0 | boost\.org/license_1_0 | boost
busl-1.1 | business source licen[cs]e(?: version| v\.?)?(?: 1\.1)? | busl-1\.1 | mariadb\.com/bsl11 | business source
sspl-1.0 | server side public licen[cs]e(?: version| v\.?)?(?: 1)? | sspl-1\.0 | mongodb\.com/licensing/server-side-public-license | server side
elastic-2.0 | elastic licen[cs]e(?: version| v\.?)?(?: 2(?:\.0)?)? | elastic-2\.0 | elastic\.co/licensing/elastic-license | elastic
eupl-1.2 | european union public licen[cs]e(?: version| v\.?)? 1\.2|eupl ?v?1\.2 | eupl-1\.2 | joinup\.ec\.europa\.eu/[^\s]*eupl | european union,eupl
eupl-1.1 | european union public licen[cs]e(?: version| v\.?)? 1\.1|eupl ?v?1\.1 | eupl-1\.1 | ec\.europa\.eu/idabc/eupl | european union,eupl
cecill-2.1 | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v\.?)? 2\.1 | cecill-2\.1 | cecill\.info/licences/licence_cecill_v2\.1 | cecill
cecill-b | cecill b(?: licen[cs]e)? | cecill-b | cecill\.info/licences/licence_cecill-b | cecill
cecill-c | cecill c(?: licen[cs]e)? | cecill-c | cecill\.info/licences/licence_cecill-c | cecill
unlicense | (?:the )?unlicense | unlicense | unlicense\.org | unlicense
wtfpl | do what the fuck you want to public licen[cs]e|wtfpl | wtfpl | wtfpl\.net | what the,wtfpl
cc0-1.0 | cc0(?: 1\.0)?(?: universal)?|creative commons zero(?: v1\.0)? | cc0-1\.0 | creativecommons\.org/publicdomain/zero/1\.0 | cc0,commons zero
cc-by-4.0 | (?:cc|creative commons)(?: by| attribution)(?: international)? 4\.0 | cc-by-4\.0 | creativecommons\.org/licenses/by/4\.0 | cc by,cc attribution,commons
cc-by-3.0 | (?:cc|creative commons)(?: by| attribution)(?: unported)? 3\.0 | cc-by-3\.0 | creativecommons\.org/licenses/by/3\.0 | cc by,cc attribution,commons
cc-by-2.0 | (?:cc|creative commons)(?: by| attribution)(?: generic)? 2\.0 | cc-by-2\.0 | creativecommons\.org/licenses/by/2\.0 | cc by,cc attribution,commons
cc-by-sa-4.0 | (?:cc|creative commons)(?: by sa| attribution share ?alike)(?: international)? 4\.0 | cc-by-sa-4\.0 | creativecommons\.org/licenses/by-sa/4\.0 | cc by,cc attribution,commons
cc-by-sa-3.0 | (?:cc|creative commons)(?: by sa| attribution share ?alike)(?: unported)? 3\.0 | cc-by-sa-3\.0 | creativecommons\.org/licenses/by-sa/3\.0 | cc by,cc attribution,commons
cc-by-nc-4.0 | (?:cc|creative commons)(?: by nc| attribution non ?commercial)(?: international)? 4\.0 | cc-by-nc-4\.0 | creativecommons\.org/licenses/by-nc/4\.0 | cc by,cc attribution,commons
cc-by-nc-3.0 | (?:cc|creative commons)(?: by nc| attribution non ?commercial)(?: unported)? 3\.0 | cc-by-nc-3\.0 | creativecommons\.org/licenses/by-nc/3\.0 | cc by,cc attribution,commons
cc-by-nd-4.0 | (?:cc|creative commons)(?: by nd| attribution no ?deriv(?:ative)?s)(?: international)? 4\.0 | cc-by-nd-4\.0 | creativecommons\.org/licenses/by-nd/4\.0 | cc by,cc attribution,commons
cc-by-nc-sa-4.0 | (?:cc|creative commons)(?: by nc sa| attribution non ?commercial share ?alike)(?: international)? 4\.0 | cc-by-nc-sa-4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0 | cc by,cc attribution,commons
cc-by-nc-sa-3.0 | (?:cc|creative commons)(?: by nc sa| attribution non ?commercial share ?alike)(?: unported)? 3\.0 | cc-by-nc-sa-3\.0 | creativecommons\.org/licenses/by-nc-sa/3\.0 | cc by,cc attribution,commons
cc-by-nc-nd-4.0 | (?:cc|creative commons)(?: by nc nd| attribution non ?commercial no ?deriv(?:ative)?s)(?: international)? 4\.0 | cc-by-nc-nd-4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0 | cc by,cc attribution,commons
cc-by-nc-nd-3.0 | (?:cc|creative commons)(?: by nc nd| attribution non ?commercial no ?deriv(?:ative)?s)(?: unported)? 3\.0 | cc-by-nc-nd-3\.0 | creativecommons\.org/licenses/by-nc-nd/3\.0 | cc by,cc attribution,commons
odbl-1.0 | open (?:data commons open )?database licen[cs]e(?: v?1\.0)?|odbl | odbl-1\.0 | opendatacommons\.org/licenses/odbl | database,odbl
odc-by-1.0 | open data commons attribution(?: licen[cs]e)?(?: v?1\.0)? | odc-by-1\.0 | opendatacommons\.org/licenses/by | open data
pddl-1.0 | public domain dedication and licen[cs]e | pddl-1\.0 | opendatacommons\.org/licenses/pddl | domain dedication
ogl-uk-3.0 | open government licen[cs]e(?: v(?:ersion)?\.? ?3(?:\.0)?)? | ogl-uk-3\.0 | nationalarchives\.gov\.uk/doc/open-government-licence | open government
psf-2.0 | python software foundation licen[cs]e(?: version 2)?|psf licen[cs]e | (?:psf|python)-2\.0 | python\.org/psf/license | python software,psf
php-3.01 | php licen[cs]e(?: version| v\.?)? 3(?:\.0)?1? | php-3\.01 | php\.net/license/3_01 | php
ruby | ruby licen[cs]e|same terms as ruby | ruby | ruby-lang\.org/en/about/license | ruby
w3c | w3c software(?: notice)?(?: and)? licen[cs]e | w3c | w3\.org/consortium/legal/copyright-software | w3c
ofl-1.1 | (?:sil )?open font licen[cs]e(?: version| v\.?)?(?: 1\.1)? | ofl-1\.1 | scripts\.sil\.org/ofl | open font
lppl-1.3c | (?:latex project public licen[cs]e|lppl)(?: version| v\.?)?(?: 1\.3c?)? | lppl-1\.3c | latex-project\.org/lppl | latex,lppl
openssl | openssl licen[cs]e | openssl | openssl\.org/source/license | openssl
postgresql | postgresql licen[cs]e | postgresql | opensource\.org/licenses?/postgresql | postgresql
ncsa | (?:university of illinois|uiuc)(?:/ncsa| ncsa)? open source licen[cs]e|ncsa licen[cs]e | ncsa | opensource\.org/licenses?/ncsa | illinois,uiuc,ncsa
upl-1.0 | universal permissive licen[cs]e(?: version| v\.?)?(?: 1\.0)? | upl-1\.0 | oss\.oracle\.com/licenses/upl | universal permissive
vim | vim licen[cs]e | vim | vimdoc\.sourceforge\.net/htmldoc/uganda | vim
x11 | x11 licen[cs]e|x consortium licen[cs]e | x11 | xfree86\.org/3\.3\.6/copyright | x11,consortium
zpl-2.1 | zope public licen[cs]e(?: version| v\.?)?(?: 2\.1)? | zpl-2\.1 | old\.zope\.dev/resources/license/zpl-2\.1 | zope
mulan-2.0 | mulan (?:psl|permissive software licen[cs]e)(?: v(?:ersion)?\.? ?2)? | mulanpsl-2\.0 | license\.coscl\.org\.cn/mulanpsl2 | mulan
polyform-nc | polyform noncommercial licen[cs]e(?: 1\.0\.0)? | polyform-noncommercial-1\.0\.0 | polyformproject\.org/licenses/noncommercial | polyform
bigscience-rail | bigscience (?:open)?rail(?: m)?(?: licen[cs]e)? | bigscience-rail-1\.0 | bigscience\.huggingface\.co/blog/the-bigscience-rail-license | bigscience
gpl | (?:gnu )?general public licen[cs]e|gnu gpl | gpl | gnu\.org/(?:copyleft|licenses)/gpl | general public,gnu gpl
lgpl | (?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl | lgpl | gnu\.org/(?:copyleft|licenses)/lgpl | general public,lgpl
agpl | (?:gnu )?affero general public licen[cs]e|gnu agpl | agpl | gnu\.org/licenses/agpl | affero,agpl
apache | apache(?: software)? licen[cs]e | apache | apache\.org/licenses | apache
creative-commons | creative commons(?: licen[cs]e)? | cc | creativecommons\.org | creative
"""

#: label | priority | confidence | keywords | pattern: phrases of licence texts and of notices
SINGLE = r"""
mit | 6 | 0.95 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | 6 | 0.9 | permission to use | permission to use copy modify and or distribute this software for any purpose
bsd | 6 | 0.85 | redistribution and use | redistribution and use in source and binary forms with or without modification
zlib | 6 | 0.9 | implied warranty | this software is provided as is without any express or implied warranty in no event
gpl | 6 | 0.9 | free software | this program is free software you can redistribute it and or modify
lgpl | 6 | 0.9 | free software | this library is free software you can redistribute it and or modify
apache-2.0 | 6 | 0.9 | in compliance | you may not use this file except in compliance with the licen[cs]e
mpl-2.0 | 6 | 0.9 | source code form | this source code form is subject to the terms of the mozilla public licen[cs]e
unlicense | 6 | 0.9 | unencumbered | this is free and unencumbered software released into the public domain
bsl-1.0 | 6 | 0.9 | machine executable | solely in the form of machine executable object code
public-domain | 4 | 0.7 | public domain | (?:released|placed|dedicated|dedication) (?:in ?to|in|to) the public domain
public-domain | 2 | 0.4 | public domain | public domain
proprietary | 4 | 0.7 | rights reserved | all rights reserved
proprietary | 4 | 0.8 | proprietary | proprietary(?: and confidential)?(?: licen[cs]e)?
proprietary | 4 | 0.8 | internal use | for internal use only
proprietary | 4 | 0.8 | written permission | without (?:the )?(?:prior |express )*written permission
non-commercial | 4 | 0.7 | commercial | (?:for )?non ?commercial use only
research-only | 4 | 0.7 | research,academic | (?:for )?(?:academic|research)(?: and (?:academic|research))? (?:use|purposes) only
copyright-notice | 1 | 0.3 | copyright | copyright (?:\(c\) |\xc2\xa9 )?(?:1[89]|20)[0-9][0-9]
dual | 3 | 0.6 | dual | dual licen[cs]ed(?: under)?
unknown-license | 1 | 0.3 | licen | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |an? )?[0-9a-z.\-]+(?: [0-9a-z.\-]+){0,3} licen[cs]e
see-license-file | 1 | 0.3 | licen | see (?:the )?(?:accompanying |enclosed |attached )?licen[cs]e(?: file|\.txt|\.md)?
"""

GRANT = (
    r"(?:licen[cs]ed|released|distributed|available|provided|published|redistribut(?:e|ed)|covered|governed|offered|shared)"
    r"(?: and [a-z]+)? (?:under|by|per|according to|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? (?:%s)"
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    #: the flattened text must hold one of these ...
    keywords: tuple[bytes, ...]
    #: ... and, where the pattern cannot do without, this stem of license and licence
    stem: bool
    regex: re.Pattern = field(repr=False)


def _compiled(pattern: str) -> re.Pattern:
    spaced = pattern.replace(" ?", r"[\s,\-]*").replace(" ", r"[\s,\-]+")
    return re.compile(rb"(?<!" + W + rb")(?:" + spaced.encode("latin-1") + rb")(?!" + W + rb")")


def _needs_stem(name: str) -> bool:
    """Whether every alternative of a name holds ``licen`` outside its optional parts."""
    while (bare := re.sub(r"\((?:\?:)?[^()]*\)\?", "", name)) != name:
        name = bare
    depth, parts = 0, [""]
    for c in name:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return all("licen" in re.sub(r"\([^()]*\)", "", x) for x in parts)


def _flat(text: bytes) -> bytes:
    """The form in which keywords are sought: a run of spaces, commas and hyphens is one space."""
    return re.sub(rb"[\s,\-]+", b" ", text)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, name, ids, address, keys = (x.strip() for x in line.split(" | "))
        words, stem = tuple(k.strip().encode() for k in keys.split(",")), _needs_stem(name)
        # a family with a version goes before one without
        own = 1 if re.search(r"\d", label) else 0
        out += [
            Rule(label, 8 + own, 0.98, (b"spdx",), True, _compiled(rf"spdx license identifier:? ?(?:{ids})")),
            Rule(label, 6 + own, 0.95, words, stem, _compiled(GRANT % name)),
            Rule(label, 6 + own, 0.9, (_flat(address.split("/")[0].replace("\\", "").encode()),), False, _compiled(rf"(?:https?://|www\.)+{address}(?:[./\-][^\s]*)?")),
            Rule(label, 4 + own, 0.7, words, stem, _compiled(name)),
        ]
    for line in SINGLE.strip().splitlines():
        label, priority, confidence, keys, pattern = (x.strip() for x in line.split(" | "))
        keywords = tuple(k.strip().encode() for k in keys.split(","))
        out.append(Rule(label, int(priority), float(confidence), keywords, _needs_stem(pattern), _compiled(pattern)))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def gate() -> tuple[bytes, ...]:
    """Longest words of all keywords, without those that ``licen`` stands for: no rule matches a text with none."""
    words = {b"licen"}
    for r in rules():
        if not r.stem:
            words |= {max(k.split(b" "), key=len) for k in r.keywords}
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


def detections(text: bytes) -> list[tuple[int, int, Rule]]:
    """Detections that stand, as (start, end, rule) in a lower-cased text, in order of priority."""
    if not any(k in text for k in gate()):
        return []
    flat = _flat(text)
    stem, found = b"licen" in flat, []
    for rule in rules():
        if (stem or not rule.stem) and any(k in flat for k in rule.keywords):
            found += [(m.start(), m.end(), rule) for m in rule.regex.finditer(text)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in found:
        if not any(s <= start and end <= e for s, e, _ in kept):
            kept.append((start, end, rule))
    return kept


@lru_cache(maxsize=1)
def _phrases() -> tuple[tuple[bytes, re.Pattern, str], ...]:
    out = []
    for phrase, label in BASE:
        words = [w.encode() for w in phrase.split()]
        # a look-ahead, so that places may overlap
        out.append((max(words, key=len), re.compile(rb"(?<!" + W + rb")(?=" + (NW + rb"+").join(words) + rb"(?!" + W + rb"))"), label))
    return tuple(out)


def word_counts(texts: list[bytes]) -> np.ndarray:
    """Words of each lower-cased text."""
    out = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        # some 8 MB at a time, or a single text
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) < 8_000_000):
            size += len(texts[end]) + 1
            end += 1
        flat = np.frombuffer(b"\n".join(texts[at:end]) + b"\n", np.uint8)
        word = WORD_BYTE[flat]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        sizes = np.array([len(t) + 1 for t in texts[at:end]])
        out[at:end] = np.add.reduceat(begins, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
        at = end
    return out


def scan(text: bytes) -> dict:
    """Base places and detections of one lower-cased text."""
    places, labels = [], set()
    for keyword, regex, label in _phrases():
        if keyword in text:
            found = [m.start() for m in regex.finditer(text)]
            places += found
            if found:
                labels.add(label)
    first = last = None
    if places:
        begins = [m.start() for m in re.finditer(W + rb"+", text)]
        index = np.searchsorted(begins, [min(places), max(places)])
        first, last = int(index[0]), int(index[1])
    kept = detections(text)
    best: dict[str, float] = {}
    for _, _, rule in kept:
        best[rule.label] = max(best.get(rule.label, 0.0), rule.confidence)
    for label in labels:
        best.setdefault(label, 0.6)
    return {
        "n_base": len(places),
        "first_word": first,
        "last_word": last,
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(best)),
        "score": 1.0 - float(np.prod([1.0 - c for c in best.values()])),
        "spans": [(s, e, r.label, r.priority) for s, e, r in sorted(kept, key=lambda d: (d[0], d[1], d[2].label))],
    }


NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, base places, labels, score and the detections that stand.

    Words are runs of digits, letters a-z (A-Z count as these) and characters beyond ASCII.  n_base
    counts all places of the base phrases; first_word and last_word are the smallest and largest
    word index of a place, null where there is none.  labels holds the base labels and those of the
    rules; score is the noisy-or of the best confidence of each label, 0 without any.  spans holds
    byte offsets into the UTF-8 text with label and priority.  Null texts are empty: no words, no
    labels, score 0.  Repeated rows each get a row; other columns of docs are not read.
    """

    @F.pandas_udf(
        "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double,"
        " spans: array<struct<begin: long, end: long, label: string, priority: int>>>"
    )
    def scanned(texts: pd.Series) -> pd.DataFrame:
        low = [t.encode("utf-8", "replace").translate(TO_LOWER) for t in texts]
        coarse = (*gate(), *(k for k, _, _ in _phrases()))
        out = pd.DataFrame([scan(t) if any(k in t for k in coarse) else NOTHING for t in low], columns=list(NOTHING))
        out.insert(0, "n_words", word_counts(low))
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(docs).select(F.col(id_col), scanned(text).alias("_s")).select(id_col, "_s.*")
