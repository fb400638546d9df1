"""License scans by ordered signature rules, with Spark expressions only.

Rules are regular expressions over lower-cased text, gated by a keyword that stands in
each of their matches: identifiers, sentences of license texts, addresses and names. A detection inside another one of better priority, or inside a
larger one of the same priority, is suppressed; base rules are never suppressed.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import let, match_spans, states_before

#: What is not a letter, digit or non-ASCII character parts words. The characters are
#: listed one by one, which the regular expression engine looks up in a table.
_GAPS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
GAP, WORD = f"[{_GAPS}]", f"[^{_GAPS}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and labels; fixed values.
BASE = (("under the mit license", "mit", "license"), ("apache license version 2", "apache-2", "apache"), ("cc by nc", "cc-by-nc", "cc"))

#: Identifiers of the SPDX list as words, with their labels; each makes a rule. Those with a
#: version that may be followed by "only" or "or later" are marked by +.
SPDX = """
mit: mit | mit-0: mit 0 | x11: x11 | isc: isc | zlib: zlib | libpng: libpng 2 0 | apache-1.1: apache 1 1 | apache-2: apache 2 0 | bsd-1-clause: bsd 1 clause
bsd-2-clause: bsd 2 clause | bsd-3-clause: bsd 3 clause | bsd-4-clause: bsd 4 clause | 0bsd: 0bsd | bsd-3-clause-clear: bsd 3 clause clear | bsd-2-clause-patent: bsd 2 clause patent
gpl-1+: gpl 1 0 | gpl-2+: gpl 2 0 | gpl-3+: gpl 3 0 | lgpl-2+: lgpl 2 0 | lgpl-2.1+: lgpl 2 1 | lgpl-3+: lgpl 3 0 | agpl-1+: agpl 1 0 | agpl-3+: agpl 3 0
gfdl-1.1+: gfdl 1 1 | gfdl-1.2+: gfdl 1 2 | gfdl-1.3+: gfdl 1 3 | mpl-1: mpl 1 0 | mpl-1.1: mpl 1 1 | mpl-2: mpl 2 0 | epl-1: epl 1 0 | epl-2: epl 2 0 | eupl-1.1: eupl 1 1
eupl-1.2: eupl 1 2 | cddl-1: cddl 1 0 | cddl-1.1: cddl 1 1 | cpl-1: cpl 1 0 | cecill-2.1: cecill 2 1 | cecill-b: cecill b | cecill-c: cecill c | artistic-1: artistic 1 0
artistic-2: artistic 2 0 | bsl-1: bsl 1 0 | busl-1.1: busl 1 1 | sspl-1: sspl 1 0 | unlicense: unlicense | wtfpl: wtfpl | postgresql: postgresql | python-2: python 2 0 | psf-2: psf 2 0
ofl-1.1: ofl 1 1 | ncsa: ncsa | ms-pl: ms pl | ms-rl: ms rl | osl-3: osl 3 0 | afl-3: afl 3 0 | upl-1: upl 1 0 | mulan-2: mulanpsl 2 0 | blueoak-1: blueoak 1 0 0 | curl: curl | openssl: openssl
ruby: ruby | php-3.01: php 3 01 | w3c: w3c | zpl-2.1: zpl 2 1 | vim: vim | json: json | ijg: ijg | hpnd: hpnd | ftl: ftl | icu: icu | beerware: beerware | unicode-3: unicode 3 0
odbl-1: odbl 1 0 | odc-by-1: odc by 1 0 | pddl-1: pddl 1 0 | cdla-permissive-2: cdla permissive 2 0 | cc0-1: cc0 1 0 | cc-by: cc by 4 0 | cc-by-sa: cc by sa 4 0 | cc-by-nc: cc by nc 4 0
cc-by-nd: cc by nd 4 0 | cc-by-nc-sa: cc by nc sa 4 0 | cc-by-nc-nd: cc by nc nd 4 0 | cc-by: cc by 3 0 | cc-by-sa: cc by sa 3 0 | cc-by-nc: cc by nc 3 0 | cc-by-nc-sa: cc by nc sa 3 0
"""

#: Hand-written signatures: priority, then label, keyword and regular expression over words. A
#: blank stands for what parts words, ~ for that or nothing. The keyword stands in every match.
SIGNATURES = {
    # sentences of the licenses' own texts and notices
    2: r"""
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | redistributions? and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | misrepresented | the origin of this software must not be misrepresented
apache-2 | apache | licensed under the apache licen[cs]e version 2(?: 0)?
apache-2 | apache | you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at(?: https?)? www apache org
apache-2 | licen | you may not use this file except in compliance with the licen[cs]e
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-2-or-later | gnu | gnu general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)? or at your option any later version
gpl-3-or-later | gnu | gnu general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)? or at your option any later version
gpl-2 | gnu | gnu general public licen[cs]e as published by the free software foundation version 2
gpl-3 | gnu | gnu general public licen[cs]e as published by the free software foundation version 3
gpl-2 | gnu | gnu general public licen[cs]e version 2 june 1991
gpl-3 | gnu | gnu general public licen[cs]e version 3 29 june 2007
gpl-1 | gnu | gnu general public licen[cs]e version 1 february 1989
lgpl-2.1-or-later | gnu | gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1(?: of the licen[cs]e)? or at your option any later version
lgpl-3-or-later | gnu | gnu lesser general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)? or at your option any later version
lgpl-2-or-later | gnu | gnu library general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)? or at your option any later version
lgpl-2.1 | gnu | gnu lesser general public licen[cs]e version 2 1 february 1999
lgpl-3 | gnu | gnu lesser general public licen[cs]e version 3 29 june 2007
agpl-3-or-later | gnu | gnu affero general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)? or at your option any later version
agpl-3 | gnu | gnu affero general public licen[cs]e version 3 19 november 2007
gfdl | gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)?~2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-2 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1 | eclipse | made available under the terms of the eclipse public licen[cs]e v(?:ersion)?~1 0
epl-2 | eclipse | made available under the terms of the eclipse public licen[cs]e v(?:ersion)?~2 0
cpl-1 | licen | made available under the terms of the common public licen[cs]e v(?:ersion)?~1 0
cddl-1 | licen | subject to the terms of the common development and distribution licen[cs]e
eupl-1.2 | eupl | licensed under the eupl version 1 2
eupl-1.2 | eupl | licensed under the eupl v1 2
artistic-2 | licen | redistribute it and or modify it under the (?:terms of the )?artistic licen[cs]e 2 0
perl | perl | you can redistribute it and or modify it under the same terms as perl itself
bsl-1 | boost | distributed under the boost software licen[cs]e version 1 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | compile | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | fuck | do what the fuck you want to public licen[cs]e
wtfpl | fuck | you just do what the fuck you want to
hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
ofl-1.1 | licen | this font software is licensed under the sil open font licen[cs]e version 1 1
ncsa | licen | university of illinois ncsa open source licen[cs]e
openssl | openssl | this product includes software developed by the openssl project
ssleay | eric | this product includes cryptographic software written by eric young
python-2 | licen | this licen[cs]e agreement is between the python software foundation psf and the individual or organization
php-3.01 | licen | this source file is subject to version 3 0?1 of the php licen[cs]e
zpl-2.1 | licen | this software is subject to the provisions of the zope public licen[cs]e version 2 1
vim | licen | this file is distributed under the same licen[cs]e as vim
json | evil | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
sspl-1 | licen | subject to the terms of the server side public licen[cs]e version 1
busl-1.1 | licen | use of this software is governed by the business source licen[cs]e
elastic-2 | licen | licensed under the elastic licen[cs]e 2 0
upl-1 | licen | the universal permissive licen[cs]e upl version 1 0
cc0-1 | waived | has waived all copyright and related or neighboring rights to this work
cc0-1 | domain | dedicated to the public domain (?:by waiving|under cc0)
cc-by | creative | this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international |unported )?licen[cs]e
cc-by-sa | creative | this work is licensed under a creative commons attribution share~alike (?:[1-4] [05] )?(?:international |unported )?licen[cs]e
cc-by-nc | creative | this work is licensed under a creative commons attribution non~commercial (?:[1-4] [05] )?(?:international |unported )?licen[cs]e
cc-by-nd | creative | this work is licensed under a creative commons attribution no~derivat(?:iv)?es (?:[1-4] [05] )?(?:international |unported )?licen[cs]e
cc-by-nc-sa | creative | this work is licensed under a creative commons attribution non~commercial share~alike (?:[1-4] [05] )?(?:international |unported )?licen[cs]e
cc-by-nc-nd | creative | this work is licensed under a creative commons attribution non~commercial no~derivat(?:iv)?es (?:[1-4] [05] )?(?:international |unported )?licen[cs]e
odbl-1 | licen | made available under the open database licen[cs]e
public-domain | domain | (?:is|are|been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | domain | this (?:software|code|file|work) is in the public domain
proprietary | confidential | unauthori[sz]ed copying of this (?:file|software) via any medium is strictly prohibited proprietary and confidential
""",
    # addresses of license texts
    3: r"""
mit | opensource | opensource org licen[cs]es? mit
bsd-2-clause | opensource | opensource org licen[cs]es? bsd 2 clause
bsd-3-clause | opensource | opensource org licen[cs]es? bsd 3 clause
bsd | opensource | opensource org licen[cs]es? bsd licen[cs]e
isc | opensource | opensource org licen[cs]es? isc
zlib | opensource | opensource org licen[cs]es? zlib
artistic-2 | opensource | opensource org licen[cs]es? artistic 2 0
apache-2 | opensource | opensource org licen[cs]es? apache 2 0
apache-2 | apache | apache org licen[cs]es licen[cs]e 2 0
apache-1.1 | apache | apache org licen[cs]es licen[cs]e 1 1
gpl | gnu | gnu org (?:licen[cs]es|copyleft) gpl(?: html| txt)?
gpl-2 | gnu | gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0
gpl-3 | gnu | gnu org licen[cs]es gpl 3 0
lgpl | gnu | gnu org (?:licen[cs]es|copyleft) (?:lgpl|lesser)(?: html| txt)?
lgpl-2.1 | gnu | gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1
lgpl-3 | gnu | gnu org licen[cs]es lgpl 3 0
agpl-3 | gnu | gnu org licen[cs]es agpl 3 0
gfdl-1.3 | gnu | gnu org licen[cs]es fdl 1 3
mpl-2 | mozilla | mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla | mozilla org mpl(?: mpl)? 1 1
epl-1 | eclipse | eclipse org(?: legal| org documents) epl v10
epl-2 | eclipse | eclipse org legal epl (?:2 0|v20)
bsl-1 | boost | boost org licen[cs]e 1 0
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
ofl-1.1 | sil | scripts sil org ofl
cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
cc-by | creativecommons | creativecommons org licen[cs]es by [1-4] [05]
cc-by-sa | creativecommons | creativecommons org licen[cs]es by sa [1-4] [05]
cc-by-nc | creativecommons | creativecommons org licen[cs]es by nc [1-4] [05]
cc-by-nd | creativecommons | creativecommons org licen[cs]es by nd [1-4] [05]
cc-by-nc-sa | creativecommons | creativecommons org licen[cs]es by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | creativecommons org licen[cs]es by nc nd [1-4] [05]
odbl-1 | opendatacommons | opendatacommons org licen[cs]es odbl
odc-by-1 | opendatacommons | opendatacommons org licen[cs]es by
pddl-1 | opendatacommons | opendatacommons org licen[cs]es pddl
""",
    # names and short forms, in running text and in fields of package files
    4: r"""
mit | licen | (?:the )?mit(?: x11| expat)? licen[cs]e
mit | licen | licen[cs]e mit
mit | licen | licen[cs]ed under (?:the )?mit
x11 | licen | x11 licen[cs]e
isc | licen | isc licen[cs]e
isc | licen | licen[cs]e isc
zlib | licen | zlib(?: libpng)? licen[cs]e
apache-2 | apache | apache(?: software)? licen[cs]e(?: version| v)?~2(?: 0)?
apache-2 | apache | licen[cs]e apache 2 0
apache-2 | apache | apache 2 0 licen[cs]e
apache-2 | apache | apache~v2(?: 0)?
apache | apache | licen[cs]ed under (?:the )?apache
apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version| v)?~1 1
bsd-2-clause | bsd | (?:bsd 2|2|two) clause (?:bsd )?licen[cs]e
bsd-2-clause | bsd | simplified bsd(?: licen[cs]e)?
bsd-2-clause | bsd | freebsd licen[cs]e
bsd-3-clause | bsd | bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd(?: licen[cs]e)?
bsd | bsd | bsd(?: style)? licen[cs]e
0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
gpl | gnu | gnu general public licen[cs]e
gpl-1 | gnu | gnu general public licen[cs]e (?:version |v)?1(?: 0)?
gpl-2 | gnu | gnu general public licen[cs]e (?:version |v)?2(?: 0)?
gpl-3 | gnu | gnu general public licen[cs]e (?:version |v)?3(?: 0)?
gpl-2-or-later | gnu | gnu general public licen[cs]e (?:version |v)?2(?: 0)? or (?:any )?later
gpl-3-or-later | gnu | gnu general public licen[cs]e (?:version |v)?3(?: 0)? or (?:any )?later
gpl | gpl | gnu gpl
gpl-2 | gpl | (?:gnu )?gpl~v?(?:ersion)?~2(?: 0)?(?: only)?
gpl-3 | gpl | (?:gnu )?gpl~v?(?:ersion)?~3(?: 0)?(?: only)?
gpl-2-or-later | gpl | (?:gnu )?gpl~v?(?:ersion)?~2(?: 0)? or later
gpl-3-or-later | gpl | (?:gnu )?gpl~v?(?:ersion)?~3(?: 0)? or later
gpl | gpl | licen[cs]ed under (?:the )?(?:gnu )?gpl
lgpl | gnu | gnu (?:lesser|library) general public licen[cs]e
lgpl-2.1 | gnu | gnu lesser general public licen[cs]e (?:version |v)?2 1
lgpl-3 | gnu | gnu lesser general public licen[cs]e (?:version |v)?3(?: 0)?
lgpl-2 | lgpl | (?:gnu )?lgpl~v?(?:ersion)?~2(?: 0)?(?: only)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl~v?(?:ersion)?~2 1(?: only)?
lgpl-3 | lgpl | (?:gnu )?lgpl~v?(?:ersion)?~3(?: 0)?(?: only)?
lgpl-2.1-or-later | lgpl | (?:gnu )?lgpl~v?(?:ersion)?~2 1 or later
lgpl-3-or-later | lgpl | (?:gnu )?lgpl~v?(?:ersion)?~3(?: 0)? or later
agpl | gnu | gnu affero general public licen[cs]e
agpl-3 | gnu | gnu affero general public licen[cs]e (?:version |v)?3(?: 0)?
agpl-3 | agpl | (?:gnu )?agpl~v?(?:ersion)?~3(?: 0)?(?: only)?
agpl-3-or-later | agpl | (?:gnu )?agpl~v?(?:ersion)?~3(?: 0)? or later
gfdl | gnu | gnu free documentation licen[cs]e
gfdl-1.3 | gnu | gnu free documentation licen[cs]e (?:version |v)?1 3
mpl-2 | mozilla | mozilla public licen[cs]e (?:version |v)?2(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version |v)?1 1
mpl-2 | mpl | mpl~v?2(?: 0)?
mpl-1.1 | mpl | mpl~v?1 1
epl-1 | eclipse | eclipse public licen[cs]e (?:version |v)?1(?: 0)?
epl-2 | eclipse | eclipse public licen[cs]e (?:version |v)?2(?: 0)?
edl-1 | eclipse | eclipse distribution licen[cs]e(?: version| v)?~1 0
eupl-1.2 | licen | european union public licen[cs]e (?:version |v)?1 2
eupl-1.1 | licen | european union public licen[cs]e (?:version |v)?1 1
cddl-1 | licen | common development and distribution licen[cs]e(?: cddl)?(?: version)? 1 0
cecill | cecill | cecill(?: [bc])? licen[cs]e
artistic-1 | licen | artistic licen[cs]e(?: version)? 1 0
artistic-2 | licen | artistic licen[cs]e(?: version)? 2 0
artistic | licen | (?:the )?artistic licen[cs]e
bsl-1 | boost | boost software licen[cs]e(?: version)?(?: 1 0)?
busl-1.1 | licen | business source licen[cs]e(?: version)? 1 1
sspl-1 | licen | server side public licen[cs]e
elastic-2 | licen | elastic licen[cs]e(?: version)? 2 0
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
postgresql | postgresql | postgresql licen[cs]e
python-2 | licen | python software foundation licen[cs]e(?: version 2)?
ofl-1.1 | licen | (?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
ms-pl | licen | microsoft public licen[cs]e
ms-rl | licen | microsoft reciprocal licen[cs]e
osl-3 | licen | open software licen[cs]e(?: version| v)?~3 0
afl-3 | licen | academic free licen[cs]e(?: version| v)?~3 0
ncsa | ncsa | ncsa open source licen[cs]e
vim | licen | vim licen[cs]e
ruby | licen | ruby licen[cs]e
php | licen | php licen[cs]e
zpl | licen | zope public licen[cs]e
openssl | openssl | openssl licen[cs]e
mulan-2 | mulan | mulan permissive software licen[cs]e(?: version| v)?~2
blueoak-1 | licen | blue oak model licen[cs]e
odbl-1 | licen | open database licen[cs]e
odc-by-1 | licen | open data commons attribution licen[cs]e
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by | cc | cc by(?: [1-4] [05])?
cc-by-sa | cc | cc by sa(?: [1-4] [05])?
cc-by-nc | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | cc | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa | creative | creative commons attribution share~alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc | creative | creative commons attribution non~commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
""",
}
WEIGHTS = {0: 1.0, 1: 1.0, 2: 0.95, 3: 0.9, 4: 0.6}
_FOUND = "array<struct<start:bigint,back:bigint,priority:int,label:string,weight:double>>"


def phrase(words: str) -> str:
    """A regular expression for whole words that stand one after another.

    The first word comes before the look behind it, so the engine can search for it as a plain string.
    """
    first, *rest = words.split()
    return f"{first}(?<!{WORD}{first})" + "".join(f"{GAP}+{w}" for w in rest) + f"(?!{WORD})"


def count_words(text: Column) -> Column:
    """Words of a text before lower-casing: each word with the gaps around it becomes one character."""
    marks = F.regexp_replace(text, f"{GAP}*{WORD}+{GAP}*", "x")
    return F.when(F.rlike(text, F.lit(WORD)), F.length(marks)).otherwise(F.lit(0)).cast("long")


def signature(written: str) -> str:
    """The regular expression of a hand-written signature, for whole words."""
    return f"(?<!{WORD})(?:{written.replace(' ', GAP + '+').replace('~', GAP + '*')})(?!{WORD})"


@lru_cache
def rules() -> tuple[tuple[str, str, str, int, float], ...]:
    """keyword, pattern, label, priority (lower is better), weight of every rule; base rules have priority 0."""
    out = [(k, phrase(p), label, 0, WEIGHTS[0]) for p, label, k in BASE]
    for entry in SPDX.replace("\n", "|").split("|"):
        if entry.strip():
            label, words = entry.strip().split(": ")
            known = [(label.removesuffix("+"), "(?: only)?"), (f"{label.removesuffix('+')}-or-later", " or later")] if label.endswith("+") else [(label, "")]
            out += [("spdx", signature(f"spdx licen[cs]e identifier {words}{end}"), name, 1, WEIGHTS[1]) for name, end in known]
    for priority, lines in SIGNATURES.items():
        for line in lines.strip().split("\n"):
            label, keyword, written = line.split(" | ", 2)
            out.append((keyword, signature(written), label, priority, WEIGHTS[priority]))
    return tuple(out)


def gate(text: Column) -> Column:
    """Whether the text, in either case, holds a keyword; "cc" only where "by" follows."""
    keywords = sorted({k for k, *_ in rules()} - {"cc"})
    return F.rlike(text, F.lit(rf"(?i)cc{GAP}+by|{'|'.join(keywords)}"))


def detections(lowered: Column) -> Column:
    """Every match of every rule whose keyword is there: array<struct<start, back, priority, label, weight>>, sorted; ``back`` is the negative end."""
    by: dict[str, list] = {}
    for k, pattern, label, priority, weight in rules():
        by.setdefault(k, []).append(F.struct(F.lit(pattern).alias("pattern"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(weight).alias("weight")))
    none = F.array().cast(_FOUND)

    def of(found: list[Column]) -> Column:
        there = F.filter(F.array(*found), lambda r: F.rlike(lowered, r["pattern"]))
        spans = lambda r: F.transform(match_spans(lowered, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))
        return F.flatten(F.transform(there, spans))

    return F.array_sort(F.concat(*(F.when(F.contains(lowered, F.lit(k)), of(found)).otherwise(none) for k, found in by.items())))


def unsuppressed(found: Column) -> Column:
    """Drop what lies inside a detection of better priority, or inside a larger one of the same; base detections stay.

    In the order of starts, longer ones first, all that can hold a detection stand before
    it. For each priority the largest end so far, and where the first span that reaches
    it starts, say whether one does.
    """
    zero = F.array(*(F.struct(F.lit(-1).cast("long").alias("stop"), F.lit(-1).cast("long").alias("start")) for _ in WEIGHTS))
    step = lambda state, d: F.transform(state, lambda s, p: F.when((p == d["priority"]) & (-d["back"] > s["stop"]), F.struct((-d["back"]).alias("stop"), d["start"].alias("start"))).otherwise(s))
    merge = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(y["stop"] > x["stop"], y).otherwise(x))

    def beaten(state: Column, d: Column) -> Column:
        holds = lambda s, p: F.when(p < d["priority"], s["stop"] >= -d["back"]).otherwise((p == d["priority"]) & ((s["stop"] > -d["back"]) | ((s["stop"] == -d["back"]) & (s["start"] < d["start"]))))
        return (d["priority"] > 0) & F.exists(F.transform(state, holds), lambda x: x)

    def of(ds: Column) -> Column:
        before = states_before(ds, "array<struct<stop:bigint,start:bigint>>", zero, step, merge)
        marked = F.zip_with(ds, before, lambda d, s: F.struct(d.alias("d"), beaten(s, d).alias("gone")))
        return F.transform(F.filter(marked, lambda m: ~m["gone"]), lambda m: m["d"])

    return let(found, of)


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, found (the detections kept), lowered (where gated).

    Input columns doc_id and text; others are ignored. A null text counts as empty;
    a null doc_id keeps its row; repeated rows stay; an empty table gives no rows.
    Matches of any number and
    texts of any length take time in proportion. The plan is one scan without a shuffle.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gated = docs.select(
        "doc_id",
        count_words(F.col("text")).alias("n_words"),
        F.when(gate(F.col("text")), F.translate("text", UPPER, LOWER)).alias("lowered"),
    )
    none = F.array().cast(_FOUND)
    found = F.when(F.col("lowered").isNotNull(), unsuppressed(detections(F.col("lowered")))).otherwise(none)
    span = lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("stop"), d["label"].alias("label"), d["priority"].alias("priority"), d["weight"].alias("weight"))
    return gated.select("doc_id", "n_words", "lowered", F.transform(found, span).alias("found"))


def license_digest(scanned: DataFrame) -> DataFrame:
    """Base counts, labels and score of each document."""
    base = F.filter("found", lambda d: d["priority"] == 0)
    place = lambda c: F.regexp_count(F.substring(F.col("lowered"), F.lit(1), c.cast("int")), F.lit(f"{WORD}+")).cast("long")
    rows = scanned.select("doc_id", "n_words", "lowered", "found", base.alias("base"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        place(F.array_min(F.transform("base", lambda d: d["start"]))).alias("first_word"),
        place(F.array_max(F.transform("base", lambda d: d["start"]))).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda d: d["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
