"""Rules of the licence scan: regexes over lower-case words with single spaces between.

``NAMES`` lists licences by hand (label | identifier | regex of the name, without a trailing "license"); each
gives rules for an identifier tag, a grant ("licensed under ..."), a named licence and the short identifier.
``CLAUSES`` lists single sentences and addresses by hand (label | priority | keyword | regex).
"""
from __future__ import annotations

import re
from dataclasses import dataclass

NAMES = r"""
gpl-1.0 | gpl 1 0 | gnu general public (?:licen[sc]e )?(?:version |v )?1(?: 0)?
gpl-2.0 | gpl 2 0 | gnu general public (?:licen[sc]e )?(?:version |v )?2(?: 0)?
gpl-3.0 | gpl 3 0 | gnu general public (?:licen[sc]e )?(?:version |v )?3(?: 0)?
gpl | gpl | gnu general public
lgpl-2.0 | lgpl 2 0 | gnu (?:library|lesser) general public (?:licen[sc]e )?(?:version )?2(?: 0)?
lgpl-2.1 | lgpl 2 1 | gnu lesser general public (?:licen[sc]e )?(?:version )?2 1
lgpl-3.0 | lgpl 3 0 | gnu lesser general public (?:licen[sc]e )?(?:version )?3(?: 0)?
lgpl | lgpl | gnu (?:library|lesser) general public
agpl-3.0 | agpl 3 0 | gnu affero general public (?:licen[sc]e )?(?:version )?3(?: 0)?
agpl | agpl | gnu affero general public
gfdl-1.3 | gfdl 1 3 | gnu free documentation (?:licen[sc]e )?(?:version )?1 3
gfdl | gfdl | gnu free documentation
apache-1.1 | apache 1 1 | apache (?:software )?(?:licen[sc]e )?(?:version )?1 1
apache-2.0 | apache 2 0 | apache (?:software )?(?:licen[sc]e )?(?:version )?2(?: 0)?
apache | apache | apache(?: software)?
mit | mit | mit|expat|x11
mit-0 | mit 0 | mit (?:no attribution|0)
bsd-1-clause | bsd 1 clause | (?:bsd )?(?:1|one) clause(?: bsd)?
bsd-2-clause | bsd 2 clause | (?:bsd )?(?:2|two) clause(?: bsd)?|simplified bsd|freebsd
bsd-3-clause | bsd 3 clause | (?:bsd )?(?:3|three) clause(?: bsd)?|(?:new|revised|modified) bsd
bsd-4-clause | bsd 4 clause | (?:bsd )?(?:4|four) clause(?: bsd)?|original bsd
bsd | bsd | bsd
0bsd | 0bsd | zero clause bsd|bsd zero clause
isc | isc | isc
mpl-1.1 | mpl 1 1 | mozilla public (?:licen[sc]e )?(?:version )?1 1
mpl-2.0 | mpl 2 0 | mozilla public (?:licen[sc]e )?(?:version )?2(?: 0)?
mpl | mpl | mozilla public
epl-1.0 | epl 1 0 | eclipse public (?:licen[sc]e )?(?:version |v )?1(?: 0)?
epl-2.0 | epl 2 0 | eclipse public (?:licen[sc]e )?(?:version |v )?2(?: 0)?
epl | epl | eclipse public
cddl-1.0 | cddl 1 0 | common development and distribution
cpl-1.0 | cpl 1 0 | common public
eupl-1.2 | eupl 1 2 | european union public
artistic-2.0 | artistic 2 0 | artistic (?:licen[sc]e )?(?:version )?2(?: 0)?
artistic | artistic | (?:perl )?artistic
zlib | zlib | zlib(?: libpng)?
bsl-1.0 | bsl 1 0 | boost software
busl-1.1 | busl 1 1 | business source
unlicense | unlicense | the unlicense
wtfpl | wtfpl | do what the f\w+ you want to public
cc0-1.0 | cc0 1 0 | cc0(?: 1 0)?|cc zero|creative commons (?:cc0|zero)
cc-by-1.0 | cc by 1 0 | (?:cc by|creative commons attribution)(?: licen[sc]e)? 1 0
cc-by-2.0 | cc by 2 0 | (?:cc by|creative commons attribution)(?: licen[sc]e)? 2 0
cc-by-2.5 | cc by 2 5 | (?:cc by|creative commons attribution)(?: licen[sc]e)? 2 5
cc-by-3.0 | cc by 3 0 | (?:cc by|creative commons attribution)(?: licen[sc]e)? 3 0
cc-by-4.0 | cc by 4 0 | (?:cc by|creative commons attribution)(?: licen[sc]e)? 4 0
cc-by-sa-3.0 | cc by sa 3 0 | (?:cc by sa|creative commons attribution share ?alike) 3 0
cc-by-sa-4.0 | cc by sa 4 0 | (?:cc by sa|creative commons attribution share ?alike) 4 0
cc-by-sa | cc by sa | cc by sa|creative commons attribution share ?alike
cc-by-nd-4.0 | cc by nd 4 0 | (?:cc by nd|creative commons attribution no ?deriv\w+) 4 0
cc-by-nd | cc by nd | cc by nd|creative commons attribution no ?deriv\w+
cc-by-nc-3.0 | cc by nc 3 0 | (?:cc by nc|creative commons attribution non ?commercial) 3 0
cc-by-nc-4.0 | cc by nc 4 0 | (?:cc by nc|creative commons attribution non ?commercial) 4 0
cc-by-nc | cc by nc | cc by nc|creative commons attribution non ?commercial
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0
cc-by-nc-sa | cc by nc sa | cc by nc sa|creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w+) 4 0
cc-by-nc-nd | cc by nc nd | cc by nc nd|creative commons attribution non ?commercial no ?deriv\w+
ofl-1.1 | ofl 1 1 | sil open font
odbl-1.0 | odbl 1 0 | open (?:data commons open )?database
odc-by-1.0 | odc by 1 0 | open data commons attribution
pddl-1.0 | pddl 1 0 | open data commons public domain dedication and
psf-2.0 | psf 2 0 | python software foundation
php-3.01 | php 3 01 | php
postgresql | postgresql | postgresql
ms-pl | ms pl | microsoft public
ms-rl | ms rl | microsoft reciprocal
ncsa | ncsa | university of illinois (?:ncsa )?open source
afl-3.0 | afl 3 0 | academic free
osl-3.0 | osl 3 0 | open software
qpl-1.0 | qpl 1 0 | q public
ecl-2.0 | ecl 2 0 | educational community
ruby | ruby | ruby
vim | vim | vim
openssl | openssl | openssl
w3c | w3c | w3c(?: software)?
upl-1.0 | upl 1 0 | universal permissive
mulanpsl-2.0 | mulanpsl 2 0 | mulan (?:permissive software|psl)
sspl-1.0 | sspl 1 0 | server side public
elastic-2.0 | elastic 2 0 | elastic
openrail | openrail | (?:bigscience |creativeml )?open ?rail(?: m)?
"""

CLAUSES = r"""
mit | 90 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 85 | notice | the above copyright notice and this permission notice shall be included
isc | 90 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
bsd | 85 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 88 | endorse | may be used to endorse or promote products derived from this software
bsd-4-clause | 88 | advertising | all advertising materials mentioning features or use of this software must display
apache-2.0 | 95 | apache | (?:www )?apache org licenses license 2 0
apache | 85 | compliance | you may not use this file except in compliance with the license
gpl | 88 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl-3.0 | 92 | gnu | (?:www )?gnu org licenses gpl(?: 3 0)?
gpl-2.0 | 92 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
lgpl | 92 | gnu | (?:www )?gnu org licenses lgpl
agpl | 92 | gnu | (?:www )?gnu org licenses agpl
gfdl | 92 | gnu | (?:www )?gnu org licenses fdl
cc-by-4.0 | 95 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-4.0 | 95 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | 95 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 95 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 95 | creativecommons | creativecommons org licenses by nc nd 4 0
cc0-1.0 | 95 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 70 | domain | (?:released|dedicated|placed) (?:in)?to the public domain
public-domain | 60 | domain | (?:is|are) in the public domain
unlicense | 90 | unencumbered | free and unencumbered software released into the public domain
mpl-2.0 | 92 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
mit | 92 | opensource | (?:www )?opensource org licenses? mit
bsd-3-clause | 92 | opensource | (?:www )?opensource org licenses? bsd 3 clause
zlib | 88 | warranty | this software is provided as is without any express or implied warranty
wtfpl | 88 | wtfpl | (?:www )?wtfpl net
bsl-1.0 | 92 | boost | (?:www )?boost org license 1 0
all-rights-reserved | 50 | reserved | all rights reserved
proprietary | 60 | proprietary | proprietary and confidential
no-commercial-use | 55 | commercial | (?:no|not for) commercial use
copyright-notice | 30 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
"""


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int
    keyword: bytes
    regex: re.Pattern


def _keyword(pattern: str) -> str:
    """The longest word that every match of the pattern holds, if it is a plain one; else none."""
    if "|" in re.sub(r"\(\?:[^()]*\)\??", "", pattern):
        return ""
    plain = re.sub(r"\(\?:[^()]*\)\??|\S*\\w\S*|\S*[?+]\S*", " ", pattern)
    return max(plain.split(), key=len, default="")


def build() -> list[Rule]:
    found: list[tuple[str, int, str, str]] = []
    for line in NAMES.strip().splitlines():
        label, tag, name = (x.strip() for x in line.split(" | ", 2))
        key = _keyword(name)
        found += [
            (label, 100, "spdx", rf"spdx licen[sc]e identifier {tag}(?: only| or later)?"),
            (label, 80 + min(9, len(label)), key or "under", rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?"
             rf"(?:terms of )?(?:the )?(?:{name})(?: (?:public )?licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?"),
            (label, 60 + min(9, len(label)), key or "licen", rf"(?:{name}) licen[sc]e(?: version [0-9]+(?: [0-9]+)?)?"),
        ]
        if " " in tag:
            found.append((label, 50 + min(9, len(label)), max(tag.split(), key=len), rf"{tag}"))
    for line in CLAUSES.strip().splitlines():
        label, priority, key, pattern = (x.strip() for x in line.split(" | ", 3))
        found.append((label, int(priority), key, pattern))
    return [Rule(i, label, p, k.encode(), re.compile(rb" (?:%b)(?= )" % r.encode())) for i, (label, p, k, r) in enumerate(found)]
