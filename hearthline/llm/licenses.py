"""License detection by ordered signature rules.

A text becomes its words: A-Z lowered, everything in ASCII but 0-9 and a-z parting them. A rule is a regular
expression over words, behind a keyword that must occur first, with a weight. Rules stand in order of
priority. Detections are taken by weight, then length, then place in the table. One is dropped if its words lie
within those of one taken before, or overlap with one of the same label or of a version of it ("gpl", "gpl-3");
others that overlap in part are both kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.tables import mapped, table, texts

#: Phrases that always count, whatever the rules say, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Rules by hand, in order of priority: label | keyword | alternatives, each an expression of its own, from ids and
#: full names (weight 1.0) over sentences that grant (0.8) to bare mentions (0.5), parted by " ; " and " / ".
#: An alternative without its line's keyword goes by the longest text that it can't do without.
#: Expressions see lower-case words with single blanks; a blank between words is a blank.
TABLE = r"""
agpl-3-or-later | agpl | spdx license identifier agpl 3 0 or later ; agpl 3 0 or later ; agplv3 or later ; agpl v3 / agplv3
agpl-3-or-later | affero | gnu affero general public license version 3 or (any later|later) ; affero general public license as published by the free software foundation either version 3 ; gnu affero general public license v3 or later
agpl-3 | agpl | spdx license identifier agpl 3 0( only)? ; agpl 3 0( only)? ; agpl version 3 / agpl
agpl-3 | affero | gnu affero general public license( v3| version 3( 0)?)? ; affero gpl( v3| version 3)? / terms of the (gnu )?affero general public license / affero general public license
lgpl-3-or-later | lgpl | spdx license identifier lgpl 3 0 or later ; lgpl 3 0 or later ; lgplv3 or later
lgpl-2-1-or-later | lgpl | spdx license identifier lgpl 2 1 or later ; lgpl 2 1 or later ; lgplv2 1 or later
lgpl-3 | lgpl | spdx license identifier lgpl 3 0( only)? ; lgpl 3 0( only)? ; lgpl ?v3( 0)? ; lgpl version 3
lgpl-2-1 | lgpl | spdx license identifier lgpl 2 1( only)? ; lgpl 2 1( only)? ; lgpl ?v2 1 ; lgpl version 2 1
lgpl-3 | lesser general | gnu lesser general public license version 3( 0)? ; gnu lesser general public license v3 ; lesser general public license as published by the free software foundation either version 3
lgpl-2-1 | lesser general | gnu lesser general public license version 2 1 ; gnu lesser general public license v2 1 ; lesser general public license as published by the free software foundation either version 2 1
lgpl-2 | library general | gnu library general public license( version 2( 0)?)? / terms of the gnu library general public license
lgpl | lgpl | under the lgpl ; licensed under lgpl / released under (the )?lgpl / lgpl licen[sc]e
lgpl | lesser general | gnu lesser general public license / terms of the gnu lesser general public license / lesser general public license
gpl-3-or-later | gpl | spdx license identifier gpl 3 0 or later ; gpl 3 0 or later ; gplv3 or later ; gpl v3 or later
gpl-2-or-later | gpl | spdx license identifier gpl 2 0 or later ; gpl 2 0 or later ; gplv2 or later ; gpl v2 or later
gpl-3-or-later | general public license | gnu general public license version 3 or (any later|later) ; gnu general public license as published by the free software foundation either version 3( of the license)? or ; gnu general public license v3 or later
gpl-2-or-later | general public license | gnu general public license version 2 or (any later|later) ; gnu general public license as published by the free software foundation either version 2( of the license)? or ; gnu general public license v2 or later
gpl-3 | gpl | spdx license identifier gpl 3 0( only)? ; gpl 3 0( only)? ; gplv3 ; gpl v3( 0)? ; gpl version 3( 0)? ; gnu gpl 3( 0)?
gpl-2 | gpl | spdx license identifier gpl 2 0( only)? ; gpl 2 0( only)? ; gplv2 ; gpl v2( 0)? ; gpl version 2( 0)? ; gnu gpl 2( 0)?
gpl-3 | general public license | gnu general public license( version| v)? 3( 0)? ; general public license version 3( 0)? ; gnu general public license v3
gpl-2 | general public license | gnu general public license( version| v)? 2( 0)? ; general public license version 2( 0)? ; gnu general public license v2
gpl-1 | general public license | gnu general public license version 1( 0)? ; general public license version 1( 0)?
gpl | gpl | under the gpl ; licensed under (the )?gpl ; released under (the )?(gnu )?gpl / gpl licen[sc]ed? / gnu gpl
gpl | general public license | terms of the gnu general public license / under the gnu general public license / gnu general public license
gfdl-1-3 | free documentation | gnu free documentation license version 1 3 ; gfdl 1 3 / terms of the gnu free documentation license version 1 3
gfdl-1-2 | free documentation | gnu free documentation license version 1 2 ; gfdl 1 2 / terms of the gnu free documentation license version 1 2
gfdl | free documentation | gnu free documentation license / under the gfdl
gfdl | gfdl | licensed under (the )?gfdl ; gfdl 1 [123] / under the gfdl
apache-2 | apache | spdx license identifier apache 2 0 ; apache license version 2( 0)? ; apache licen[sc]e 2( 0)? ; apache 2 0 licen[sc]e ; apache 2 licen[sc]e ; apache software licen[sc]e version 2( 0)? ; apache software licen[sc]e 2 0 ; asl 2 0 ; www apache org licenses license 2 0( html| txt)? / licensed under (the )?apache licen[sc]e v2( 0)? / under the apache 2( 0)? license / apache 2 0
apache-1-1 | apache | spdx license identifier apache 1 1 ; apache software licen[sc]e version 1 1 ; apache licen[sc]e 1 1 ; apache 1 1
apache-1 | apache | spdx license identifier apache 1 0 ; apache software licen[sc]e version 1 0 ; apache licen[sc]e 1 0
apache | apache | licensed under the apache licen[sc]e ; apache software licen[sc]e / under the apache licen[sc]e / apache licen[sc]ed?
mit-0 | mit | spdx license identifier mit 0 ; mit no attribution ; mit 0 license
mit | mit | spdx license identifier mit ; the mit licen[sc]e( mit)? ; mit expat licen[sc]e ; opensource org licenses mit( license)?( php)? / under the mit licen[sc]e ; under (an|a|the) mit style licen[sc]e ; released under mit ; licensed under mit ; distributed under the mit / mit licen[sc]ed? ; license mit
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files / permission is hereby granted free of charge to any person obtaining a copy
x11 | x11 | spdx license identifier x11 ; x11 licen[sc]e ; mit x11 licen[sc]e / under the x11 licen[sc]e
expat | expat | expat licen[sc]e / under the expat licen[sc]e
bsd-4-clause | bsd | spdx license identifier bsd 4 clause ; bsd 4 clause( licen[sc]e)? ; original bsd licen[sc]e / four clause bsd
bsd-3-clause | bsd | spdx license identifier bsd 3 clause ; bsd 3 clause( licen[sc]e)? ; (new|modified|revised) bsd licen[sc]e ; 3 clause bsd( licen[sc]e)? ; three clause bsd / opensource org licenses bsd 3 clause
bsd-2-clause | bsd | spdx license identifier bsd 2 clause ; bsd 2 clause( licen[sc]e)? ; (simplified|freebsd) (bsd )?licen[sc]e ; 2 clause bsd( licen[sc]e)? ; two clause bsd / opensource org licenses bsd 2 clause
0bsd | 0bsd | spdx license identifier 0bsd ; 0bsd licen[sc]e ; zero clause bsd / under 0bsd
bsd | bsd | bsd style licen[sc]e ; licensed under (the |a )?bsd / under (the |a )?bsd( style)? licen[sc]e ; released under (the )?bsd / bsd licen[sc]ed?
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted / redistribution and use in source and binary forms
bsd-3-clause | endorse or promote | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
mpl-2 | mpl | spdx license identifier mpl 2 0 ; mpl 2 0 ; mplv2 ; mpl version 2( 0)? / licensed under (the )?mpl / under the mpl
mpl-2 | mozilla | mozilla public licen[sc]e( version| v)? 2( 0)? ; mozilla org mpl 2 0 / terms of the mozilla public license v 2 0 / subject to the terms of the mozilla public license
mpl-1-1 | mozilla | mozilla public licen[sc]e( version| v)? 1 1 ; mpl 1 1 / contents of this file are subject to the mozilla public license version 1 1
mpl-1 | mozilla | mozilla public licen[sc]e( version| v)? 1 0
mpl | mozilla | under the mozilla public licen[sc]e / mozilla public licen[sc]e
epl-2 | eclipse | spdx license identifier epl 2 0 ; eclipse public licen[sc]e( version| v)? 2( 0)? / eclipse org legal epl 2 0
epl-1 | eclipse | spdx license identifier epl 1 0 ; eclipse public licen[sc]e( version| v)? 1( 0)? / eclipse org legal epl v10
epl | eclipse | under the eclipse public licen[sc]e / eclipse public licen[sc]e
edl-1 | eclipse | eclipse distribution licen[sc]e( version| v)?( 1( 0)?)?
epl-2 | epl | spdx license identifier epl 2 0 ; epl 2 0 ; epl v2 0
cddl-1-1 | cddl | spdx license identifier cddl 1 1 ; cddl 1 1 ; cddl version 1 1
cddl-1 | cddl | spdx license identifier cddl 1 0 ; cddl 1 0 ; cddl version 1 0 / under the cddl ; cddl licen[sc]ed?
cddl-1 | common development and distribution | common development and distribution licen[sc]e( version)? 1 0 / common development and distribution licen[sc]e
cpl-1 | common public | common public licen[sc]e( version| v)?( 1( 0)?)? / under the common public licen[sc]e
ipl-1 | ibm public | ibm public licen[sc]e( version| v)?( 1( 0)?)?
eupl-1-2 | european union public | european union public licen[sc]e( version| v)? 1 2 ; eupl 1 2
eupl-1-1 | european union public | european union public licen[sc]e( version| v)? 1 1 ; eupl 1 1
eupl | eupl | spdx license identifier eupl 1 [012] ; eupl( v)? 1 [012] / licensed under the eupl / under the eupl
osl-3 | open software | open software licen[sc]e( version| v)? 3( 0)? ; osl 3 0 / under the open software licen[sc]e
afl-3 | academic free | academic free licen[sc]e( version| v)? 3( 0)? ; afl 3 0 / under the academic free licen[sc]e
ms-pl | microsoft public | microsoft public licen[sc]e( ms pl)? ; ms pl / under the microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e( ms rl)? ; ms rl
isc | isc license | spdx license identifier isc ; the isc licen[sc]e ; isc licen[sc]e / under the isc licen[sc]e
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted / permission to use copy modify and distribute this software
zlib | zlib | spdx license identifier zlib ; zlib licen[sc]e ; zlib libpng licen[sc]e / under the zlib licen[sc]e
zlib | altered source versions | altered source versions must be plainly marked as such
libpng | libpng | spdx license identifier libpng( 2 0)? ; libpng licen[sc]e / png reference library licen[sc]e
bsl-1 | boost | spdx license identifier bsl 1 0 ; boost software licen[sc]e( version)?( 1( 0)?)? / under the boost software licen[sc]e ; boost org license 1 0 txt
busl-1-1 | business source | spdx license identifier busl 1 1 ; business source licen[sc]e( version)?( 1 1)? / under the business source licen[sc]e
sspl-1 | server side public | spdx license identifier sspl 1 0 ; server side public licen[sc]e( version| v)?( 1)? / under the server side public licen[sc]e
elastic-2 | elastic license | spdx license identifier elastic 2 0 ; elastic license( version)?( 2( 0)?)? / under the elastic license
artistic-2 | artistic | spdx license identifier artistic 2 0 ; (the )?artistic licen[sc]e( version)? 2( 0)? / same terms as perl 5 artistic 2
artistic-1 | artistic | spdx license identifier artistic 1 0( perl)? ; artistic licen[sc]e( version)? 1( 0)? ; clarified artistic licen[sc]e / under the artistic licen[sc]e
perl | same terms as perl | under the same terms as perl( itself)? / same terms as perl
python-2 | python software foundation | spdx license identifier psf 2 0 ; python software foundation licen[sc]e( version)?( 2( 0)?)? / under the python software foundation licen[sc]e
ruby | ruby licen | spdx license identifier ruby ; ruby licen[sc]e / under the ruby licen[sc]e
php-3 | php license | spdx license identifier php 3 0?1? ; php license( version)? 3( 0| 01)? / under the php license
postgresql | postgresql licen | spdx license identifier postgresql ; postgresql licen[sc]e / under the postgresql licen[sc]e
openssl | openssl licen | spdx license identifier openssl ; openssl licen[sc]e / openssl and ssleay licen[sc]es?
w3c | w3c | spdx license identifier w3c ; w3c software (notice and )?licen[sc]e / w3c document licen[sc]e
unicode | unicode | spdx license identifier unicode (dfs 2016|tou|3 0) ; unicode licen[sc]e( v3| agreement)? / unicode terms of use
icu | icu license | spdx license identifier icu ; icu license
ofl-1-1 | open font | spdx license identifier ofl 1 1 ; sil open font licen[sc]e( version| v)?( 1 1)? ; ofl 1 1 / under the open font licen[sc]e
ofl-1-1 | ofl | scripts sil org ofl / licensed under (the )?ofl
wtfpl | wtfpl | spdx license identifier wtfpl ; wtfpl( version| v)?( 2)? / under the wtfpl
wtfpl | do what the | do what the fuck you want to public licen[sc]e
beerware | beer | spdx license identifier beerware ; beerware licen[sc]e ; beer ware licen[sc]e / buy me a beer in return
unlicense | unlicense | spdx license identifier unlicense ; the unlicense ; unlicense org / under the unlicense
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
vim | vim licen | spdx license identifier vim ; vim licen[sc]e
curl | curl licen | spdx license identifier curl ; curl licen[sc]e
ncsa | ncsa | spdx license identifier ncsa ; university of illinois ncsa open source licen[sc]e ; ncsa licen[sc]e
upl-1 | universal permissive | spdx license identifier upl 1 0 ; universal permissive licen[sc]e( version| v)?( 1( 0)?)?
blueoak-1 | blue oak | spdx license identifier blueoak 1 0 0 ; blue oak model licen[sc]e( 1 0 0)?
mulan-2 | mulan | spdx license identifier mulanpsl 2 0 ; mulan psl v?2 ; mulan permissive software licen[sc]e( v)?( 2)?
cecill-2 | cecill | spdx license identifier cecill 2 [01] ; cecill( version| v)? 2( [01])? / licence cecill ; cecill licen[sc]e
cecill-b | cecill | spdx license identifier cecill b ; cecill b( licen[sc]e)?
cecill-c | cecill | spdx license identifier cecill c ; cecill c( licen[sc]e)?
odbl-1 | database | spdx license identifier odbl 1 0 ; open database licen[sc]e( odbl)?( v)?( 1( 0)?)? / under the open database licen[sc]e
odc-by-1 | open data commons | spdx license identifier odc by 1 0 ; open data commons attribution licen[sc]e( v)?( 1( 0)?)? / odc by
pddl-1 | public domain dedication | spdx license identifier pddl 1 0 ; public domain dedication and licen[sc]e( pddl)?( v)?( 1( 0)?)?
cdla-permissive-2 | community data license | spdx license identifier cdla permissive 2 0 ; community data license agreement permissive( version)?( 2( 0)?)?
cdla-sharing-1 | community data license | spdx license identifier cdla sharing 1 0 ; community data license agreement sharing( version)?( 1( 0)?)?
ogl-3 | open government | spdx license identifier ogl uk 3 0 ; open government licen[sc]e( v| version)? ?3( 0)? / under the open government licen[sc]e
ogl | open government | open government licen[sc]e
openrail-m | openrail | (creativeml |bigscience |bigcode )?open ?rail m( licen[sc]e)? / under (the )?openrail( m)?
rail | responsible ai | responsible ai licen[sc]e / under (a|the) responsible ai licen[sc]e
llama-community | community license | llama [234]( [123])? community license( agreement)?
gemma-terms | gemma terms | gemma terms of use
cc0-1 | cc0 | spdx license identifier cc0 1 0 ; cc0 1 0( universal)? ; cc0 licen[sc]e / licensed under cc0 ; under cc0 / cc0
cc0-1 | creative commons zero | creative commons zero( v1 0 universal)? / creative commons zero licen[sc]e
cc-by-nc-nd | cc by nc nd | spdx license identifier cc by nc nd [1234] [05] ; cc by nc nd( [1234] [05])? / under (a |the )?cc by nc nd
cc-by-nc-sa | cc by nc sa | spdx license identifier cc by nc sa [1234] [05] ; cc by nc sa( [1234] [05])? / under (a |the )?cc by nc sa
cc-by-nc-4 | cc by nc | spdx license identifier cc by nc 4 0 ; cc by nc 4 0( international)? / under (a |the )?cc by nc 4 0
cc-by-nc-3 | cc by nc | spdx license identifier cc by nc 3 0 ; cc by nc 3 0( unported)? / under (a |the )?cc by nc 3 0
cc-by-nc | cc by nc | cc by nc( [12] [05])? ; cc by nc licen[sc]e / under (a |the )?cc by nc
cc-by-nd | cc by nd | spdx license identifier cc by nd [1234] [05] ; cc by nd( [1234] [05])? / under (a |the )?cc by nd
cc-by-sa-4 | cc by sa | spdx license identifier cc by sa 4 0 ; cc by sa 4 0( international)? / under (a |the )?cc by sa 4 0
cc-by-sa-3 | cc by sa | spdx license identifier cc by sa 3 0 ; cc by sa 3 0( unported)? / under (a |the )?cc by sa 3 0
cc-by-sa | cc by sa | cc by sa( [12] [05])? ; cc by sa licen[sc]e / under (a |the )?cc by sa
cc-by-4 | cc by | spdx license identifier cc by 4 0 ; cc by 4 0( international)? / under (a |the )?cc by 4 0
cc-by-3 | cc by | spdx license identifier cc by 3 0 ; cc by 3 0( unported)? / under (a |the )?cc by 3 0
cc-by | cc by | cc by licen[sc]e ; licensed (under )?cc by / under (a |the )?cc by
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(ative)?s( works)?( [1234] [05])? ; creativecommons org licenses by nc nd [1234] [05]
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike( [1234] [05])? ; creativecommons org licenses by nc sa [1234] [05]
cc-by-nc | creative commons | creative commons attribution non ?commercial( [1234] [05])?( international)? ; creativecommons org licenses by nc [1234] [05]
cc-by-nd | creative commons | creative commons attribution no ?deriv(ative)?s( works)?( [1234] [05])? ; creativecommons org licenses by nd [1234] [05]
cc-by-sa | creative commons | creative commons attribution share ?alike( [1234] [05])?( international)? ; creativecommons org licenses by sa [1234] [05]
cc-by | creative commons | creative commons attribution( [1234] [05])?( international| unported| generic)? ; creativecommons org licenses by [1234] [05] / under (a |the )?creative commons attribution
cc | creative commons | under (a |the )?creative commons licen[sc]e ; creative commons licen[sc]e / creative commons
cc-by | creativecommons | creativecommons org licenses by [1234] [05]( legalcode| deed)?
cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0( legalcode)?
public-domain-mark | creativecommons | creativecommons org publicdomain mark 1 0
public-domain | public domain | released into the public domain ; dedicated to the public domain ; placed in the public domain / in the public domain ; is public domain / public domain
all-rights-reserved | all rights reserved | copyright( c)? [0-9]{4}( [0-9]{4})? .{1,60}? all rights reserved / all rights reserved
proprietary | proprietary | proprietary and confidential ; confidential and proprietary ; proprietary licen[sc]e / unauthorized copying of this file via any medium is strictly prohibited / proprietary software
no-derivatives | derivative works | no derivative works (are )?(allowed|permitted) / may not (create|make|distribute) derivative works
non-commercial | commercial | for non ?commercial (use|purposes) only ; non ?commercial use only / not for commercial use / free for non ?commercial use ; free for personal use
no-ai-training | training | may not be used (to train|for training( of)?) (ai|machine learning|language) models / no ai training ; not for ai training
spdx-other | spdx license identifier | spdx license identifier [a-z0-9]+( [0-9]+)*
custom-license | license agreement | end user license agreement ; software license agreement / subject to the terms of (the|this) license agreement
copyright-notice | copyright | copyright( c)? [0-9]{4}( [0-9]{4})? / copyright c
"""

_GRADES = (1.0, 0.8, 0.5)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: bytes
    weight: float
    pattern: re.Pattern


def keyword_of(expression: str, keyword: str) -> str:
    """The line's keyword if each match holds it, else the longest text that each match holds.

    Of the parsed expression only the characters outside groups, classes and repeats stand in every match.
    """
    fixed = "".join(chr(value) if kind is _constants.LITERAL else "\0" for kind, value in _parser.parse(expression))
    return keyword if keyword in fixed else max(fixed.split("\0"), key=len).strip()


def rules(text: str = TABLE) -> list[Rule]:
    """One rule per alternative. In a line " / " starts the next lower weight."""
    out = []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        label, keyword, alternatives = (x.strip() for x in line.split(" | ", 2))
        for grade, part in enumerate(alternatives.split(" / ")):
            for one in part.split(" ; "):
                made = re.compile(rb"(?<= )(?:" + one.strip().encode() + rb")(?= )", re.DOTALL)
                first = keyword_of(one.strip(), keyword).encode()
                out.append(Rule(f"{label}:{len(out)}", label, first, _GRADES[min(grade, 2)], made))
    families = {"-".join(r.label.split("-")[:k]) for r in out for k in range(1, r.label.count("-") + 1)}
    return [replace(r, weight=r.weight * 0.9) if r.label in families else r for r in out]


RULES = rules()
_BY_KEYWORD: dict[bytes, list[int]] = {}
for _i, _rule in enumerate(RULES):
    _BY_KEYWORD.setdefault(_rule.keyword, []).append(_i)

#: Words end where ASCII has neither a digit nor a letter; A-Z are lowered.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = [(f" {phrase} ".encode(), label) for phrase, label in BASE.items()]


@dataclass(frozen=True)
class Detection:
    """Words first..last (from 0, both included)."""

    label: str
    rule: int
    first: int
    last: int
    weight: float


def resolve(found: list[Detection]) -> list[Detection]:
    """The detections that stay, by place."""
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.weight, d.first - d.last, d.rule, d.first)):
        for k in kept:
            if k.first <= d.first and d.last <= k.last:
                break
            if k.first <= d.last and d.first <= k.last and f"{k.label}-".startswith(f"{d.label}-"):
                break
        else:
            kept.append(d)
    return sorted(kept, key=lambda d: (d.first, d.last))


def _resolved_apart(found: list[Detection]) -> list[Detection]:
    """resolve() on each stretch of detections that touch each other: long texts have many of them."""
    out: list[Detection] = []
    group: list[Detection] = []
    end = -1
    for d in sorted(found, key=lambda d: (d.first, d.last)):
        if d.first > end and group:
            out += resolve(group)
            group = []
        group.append(d)
        end = max(end, d.last)
    return out + (resolve(group) if group else [])


def scan(text: str) -> tuple[int, list[tuple[str, int]], list[Detection]]:
    """Number of words, base places (label, first word), and the detections that stay."""
    words = text.encode().translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # the k-th stands before word k

    def word(at: int) -> int:
        return int(np.searchsorted(blanks, at))

    base = []
    for phrase, label in _BASE:
        at = line.find(phrase)
        while at >= 0:
            base.append((label, word(at)))
            at = line.find(phrase, at + 1)
    wanted = sorted(i for keyword, own in _BY_KEYWORD.items() if keyword in line for i in own)
    found = []
    for i in wanted:
        rule = RULES[i]
        for m in rule.pattern.finditer(line):
            first = word(m.start()) - 1
            found.append(Detection(rule.label, i, first, first + m[0].count(b" "), rule.weight))
    return len(words), sorted(base, key=lambda x: x[1]), _resolved_apart(found)


_PLACES = "array<struct<label:string,word:long>>"
_FOUND = "array<struct<label:string,rule:string,first:long,last:long,weight:double>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places), found (detections that stay) per row. A missing text is empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [scan(x) for x in texts(batch)]
        place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("weight", pa.float64())]))
        columns = [
            batch.column("doc_id"),
            pa.array([x[0] for x in each], pa.int64()),
            pa.array([[{"label": a, "word": b} for a, b in x[1]] for x in each], place),
            pa.array([[{"label": d.label, "rule": RULES[d.rule].name, "first": d.first, "last": d.last, "weight": d.weight} for d in x[2]] for x in each], span),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "found"])

    return mapped(docs.select("doc_id", "text"), work, f"doc_id long, n_words long, base {_PLACES}, found {_FOUND}")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license labels. The score is the best detection's weight, 1 for a base phrase, else 0."""
    rows = scanned(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.array_sort(F.array_distinct("base.label"))
    every = F.array_sort(F.array_distinct(F.concat("base.label", "found.label")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.weight"), F.lit(0.0))).alias("score"),
    )
