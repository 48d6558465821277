"""License scan: ordered signature rules with a keyword prefilter, priorities and interval containment.

A text becomes its words (runs of 0-9, a-z and non-ASCII characters, A-Z in lower case), one space apart. A rule
is a hand-written regular expression over words; it is tried only where the text holds its keyword, at the start of a word; one expression of all keywords lets most texts pass by. Of the
detections, one that lies inside another of a higher priority (or of the same priority, if longer or, at equal
spans, of an earlier rule) is suppressed. All of it is expressions over one row: nothing is shuffled.

Defined cases: a null or empty text has no words and no detections; repeated rows are scanned alike; an empty
table gives an empty table; the columns that are added replace input columns of the same name.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Phrases whose places are counted whatever the rules find.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Priorities: a notice's whole wording beats a named version, that a bare name, that a clue.
TEXT, NAMED, NAME, CLUE = 4, 3, 2, 1


@dataclass(frozen=True)
class Rule:
    keyword: str
    regex: str
    label: str
    priority: int


def _versions(name: str, keyword: str, label: str, versions: dict[str, str]) -> list[Rule]:
    """A rule for each version of a license: ``version 2``, ``v2``, ``2 0`` and the like behind its name."""
    return [Rule(keyword, rf"{name}(?: license)?(?: version| v)? ?{number}(?: only| or later| or any later version)?", f"{label}-{version}", NAMED) for version, number in versions.items()]


#: Sentences of licenses and notices, as words.
WORDINGS = (
    ("above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("without limitation the rights", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", "mit"),
    ("in no event shall", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "mit"),
    ("provided as is", "the software is provided as is without warranty of any kind express or implied", "mit"),
    ("x consortium", "in no event shall the x consortium be liable", "x11"),
    ("advertising", r"except as contained in this notice the name of (?:\S+ ){1,10}?shall not be used in advertising or otherwise to promote", "x11"),
    ("advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause"),
    ("source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("freebsd project", "should not be interpreted as representing official policies either expressed or implied of the freebsd project", "bsd-2-clause"),
    ("consequential damages", "liable for any direct indirect incidental special exemplary or consequential damages", "bsd"),
    ("fitness for a particular", "(?:implied )?warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("with or without fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("author disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software", "isc"),
    ("loss of use", "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits", "isc"),
    ("0bsd", "(?:bsd zero clause|0bsd) license", "0bsd"),
    ("origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib"),
    ("held liable", "in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("removed or altered", "this notice may not be removed or altered from any source distribution", "zlib"),
    ("png reference library", "the png reference library is supplied as is", "libpng"),
    ("except in compliance", "you may not use this file except in compliance with the license", "apache-2.0"),
    ("required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("you may obtain a copy", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("contributor license", "one or more contributor license agreements", "apache-2.0"),
    ("apache software foundation", "this product includes software developed by the apache software foundation", "apache"),
    ("redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2.0-or-later"),
    ("redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3.0-or-later"),
    ("general public license version", "it under the terms of the gnu general public license version 2 as published by the free software foundation", "gpl-2.0-only"),
    ("redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("useful but without", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("received a copy", "you should have received a copy of the gnu (?:lesser |affero |library )?general public license along with this (?:program|library|file)", "gpl"),
    ("everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl"),
    ("take away your freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", "gpl"),
    ("linking this library", "linking this (?:library|program) statically or dynamically with other modules is making a combined work", "gpl-classpath-exception"),
    ("special exception", "as a special exception the copyright holders (?:of this library )?give you permission to link", "gpl-classpath-exception"),
    ("bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "gpl-bison-exception"),
    ("runtime library exception", "gcc runtime library exception", "gpl-gcc-exception"),
    ("work that uses the library", "a work that uses the library", "lgpl"),
    ("remote network interaction", "remote network interaction use with the gnu general public license", "agpl-3"),
    ("invariant sections", "with no invariant sections no front cover texts and no back cover texts", "gfdl"),
    ("permission is granted to copy", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl"),
    ("covered software", "covered software is provided under this license on an as is basis", "mpl-2.0"),
    ("copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0"),
    ("mozilla public", "the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1"),
    ("incompatible with secondary", "this source code form is incompatible with secondary licenses", "mpl-2.0-no-copyleft"),
    ("netscape public", "the contents of this file are subject to the netscape public license", "npl"),
    ("accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("common public", "this program and the accompanying materials are made available under the terms of the common public license", "cpl-1.0"),
    ("common development", "the contents of this file are subject to the terms of the common development and distribution license", "cddl"),
    ("boost org license", "(?:see accompanying file license 1 0 txt )?or copy at http www boost org license 1 0 txt", "bsl-1.0"),
    ("machine executable object", "machine executable object code generated by a source language processor", "bsl-1.0"),
    ("for the benefit of the public", "for the benefit of the public at large and to the detriment of our heirs and successors", "unlicense"),
    ("anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("associated a work", "the person who associated a work with this deed has dedicated the work to the public domain", "cc0-1.0"),
    ("copyright and related", r"to the extent possible under law (?:\S+ ){0,12}?waived all copyright and related or neighboring rights", "cc0-1.0"),
    ("you just do what", "you just do what the fuck you want to", "wtfpl"),
    ("buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", "beerware"),
    ("good not evil", "the software shall be used for good not evil", "json"),
    ("reserved font name", "with reserved font name", "ofl"),
    ("sil open font", "this font software is licensed under the sil open font license", "ofl"),
    ("font software may not", "the font software may not be sold by itself", "ofl"),
    ("bitstream vera", r"permission is hereby granted (?:\S+ ){1,12}?bitstream vera", "bitstream-vera"),
    ("a package may be copied", "the intent of this document is to state the conditions under which a package may be copied", "artistic-1.0"),
    ("same terms as perl", "(?:redistribute it and or modify it )?under the same terms as perl itself", "artistic-or-gpl"),
    ("same terms as ruby", "under the same terms as ruby", "ruby"),
    ("beopen", "beopen python open source license agreement", "python"),
    ("python software foundation", "this license agreement is between the python software foundation", "psf-2"),
    ("php software", "this product includes php software freely available from", "php"),
    ("openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("eric young", "this product includes cryptographic software written by eric young", "openssl"),
    ("independent jpeg", "this software is based in part on the work of the independent jpeg group", "ijg"),
    ("freetype", r"portions of this software are copyright (?:\S+ ){0,4}?the freetype project", "freetype"),
    ("info zip", r"this software is provided as is without warranty of any kind (?:\S+ ){0,6}?info zip", "info-zip"),
    ("daniel stenberg", r"copyright (?:c )?(?:\S+ ){1,8}?daniel stenberg", "curl"),
    ("regents of the university", "this software is copyrighted by the regents of the university of california sun microsystems", "tcl"),
    ("without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "postgresql"),
    ("university of illinois", "university of illinois ncsa open source license", "ncsa"),
    ("w3c", "w3c software (?:and document )?notice and license", "w3c"),
    ("unicode license", "unicode license agreement data files and software", "unicode"),
    ("icu license", "icu license icu 1 8 1 and later", "icu"),
    ("latex project", "this work may be distributed and or modified under the conditions of the latex project public license", "lppl"),
    ("as a service", "making the functionality of the program or modified version available to third parties as a service", "sspl-1"),
    ("right to sell the software", "the license does not grant to you the right to sell the software", "commons-clause"),
    ("change date", "effective on the change date or the fourth anniversary of the first publicly available distribution", "busl-1.1"),
    ("hosted or managed", "you may not provide the software to third parties as a hosted or managed service", "elastic-2.0"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict) license", "polyform"),
    ("open database", r"this (?:\S+ ){0,4}?database is made available under the open database license", "odbl"),
    ("openstreetmap", "(?:copyright )?openstreetmap contributors", "odbl-1.0"),
    ("open government", "contains public sector information licensed under the open government licence", "ogl-uk"),
    ("open government", r"open government licen[cs]e(?: v(?:ersion)? ?\d(?: 0)?)?", "ogl"),
    ("licence ouverte", "licence ouverte(?: open licence)?", "etalab"),
    ("datenlizenz", "datenlizenz deutschland(?: namensnennung| zero)?", "dl-de"),
    ("attribution", r"this work is licensed under a creative commons attribution (?:\d \d )?(?:international|unported|generic) license", "cc-by"),
    ("creative commons attribution share", r"this work is licensed under (?:a|the) creative commons attribution share ?alike (?:\d \d )?(?:international|unported|generic)? ?license", "cc-by-sa"),
    ("creative commons attribution non", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:\d \d )?(?:international|unported|generic)? ?license", "cc-by-nc"),
    ("creativecommons", r"creativecommons org licenses by \d \d", "cc-by"),
    ("creativecommons", r"creativecommons org licenses by sa \d \d", "cc-by-sa"),
    ("creativecommons", r"creativecommons org licenses by nd \d \d", "cc-by-nd"),
    ("creativecommons", r"creativecommons org licenses by nc \d \d", "cc-by-nc"),
    ("creativecommons", r"creativecommons org licenses by nc sa \d \d", "cc-by-nc-sa"),
    ("creativecommons", r"creativecommons org licenses by nc nd \d \d", "cc-by-nc-nd"),
    ("creativecommons", "creativecommons org publicdomain zero 1 0", "cc0-1.0"),
    ("creativecommons", "creativecommons org publicdomain mark 1 0", "public-domain"),
    ("united states government", "works? of the united states government", "public-domain"),
    ("project gutenberg", "under the terms of the project gutenberg license", "gutenberg"),
    ("no known copyright", "no known copyright restrictions", "public-domain"),
    ("text is available under", "text is available under the creative commons attribution share ?alike license", "cc-by-sa"),
)
#: Licenses by name alone.
NAMES = (
    ("mit x11", "mit x11 license", "x11"), ("expat", "expat license", "mit"), ("bsd", "bsd style license", "bsd"), ("bsd", "original bsd license", "bsd-4-clause"), ("bsd", "4 clause bsd", "bsd-4-clause"),
    ("gpl", "gpl compatible", "gpl"), ("gpl", "gplv2", "gpl-2"), ("gpl", "gplv3", "gpl-3"), ("lgplv3", "lgplv3", "lgpl-3"), ("agplv3", "agplv3", "agpl-3"), ("gpl", "(?:gnu )?gpl", "gpl"),
    ("copyleft", "copyleft license", "copyleft"), ("ncsa", "ncsa license", "ncsa"), ("w3c", "w3c license", "w3c"), ("postgresql", "postgresql license", "postgresql"), ("ruby license", "ruby license", "ruby"),
    ("python license", "python license", "python"), ("perl license", "perl license", "artistic-or-gpl"), ("vim license", "vim license", "vim"), ("tcl tk", "tcl tk license", "tcl"), ("curl license", "curl license", "curl"),
    ("unicode license", "unicode license", "unicode"), ("libpng", "libpng license", "libpng"), ("freetype", "freetype license", "freetype"), ("icu license", "icu license", "icu"), ("json license", "json license", "json"),
    ("latex project", "latex project public license", "lppl"), ("microsoft reciprocal", "microsoft reciprocal license", "ms-rl"), ("universal permissive", "universal permissive license", "upl"),
    ("open software license", "open software license", "osl"), ("academic free", "academic free license", "afl"), ("educational community", "educational community license", "ecl"), ("blue oak", "blue oak model license", "blueoak"), ("hippocratic", "hippocratic license", "hippocratic"), ("parity", "parity public license", "parity"), ("cern", "cern open hardware licen[cs]e", "cern-ohl"),
    ("solderpad", "solderpad hardware license", "solderpad"), ("tapr", "tapr open hardware license", "tapr-ohl"), ("free art", "free art license", "lal"), ("open publication", "open publication license", "opl"),
    ("game license", "open game license", "ogl-game"), ("community data", "community data license agreement", "cdla"), ("open data commons", "open data commons attribution license", "odc-by"), ("domain dedication", "public domain dedication and license", "pddl"),
    ("bigscience", "bigscience (?:open)?rail license", "openrail"), ("openrail", "openrail(?: m)?", "openrail"), ("community license", "(?:model )?community license agreement", "community-license"), ("end user", "end user licen[cs]e agreement", "eula"),
)
#: Words that speak of rights without naming a license.
CLUES = (
    ("tous droits", "tous droits réservés", "reserved"), ("alle rechte", "alle rechte vorbehalten", "reserved"), ("todos los derechos", "todos los derechos reservados", "reserved"), ("tutti i diritti", "tutti i diritti riservati", "reserved"),
    ("copr", r"copr (?:19|20)\d\d", "copyright"), ("urheberrecht", "urheberrechtlich geschützt", "copyright"), ("droit d auteur", "droit d auteur", "copyright"), ("derechos de autor", "derechos de autor", "copyright"),
    ("trademark", "registered trademarks? of", "trademark"), ("patent", "patents? pending", "patent"), ("no part of this", "no part of this (?:publication|book|work) may be reproduced", "reserved"), ("unauthori", "unauthori[sz]ed (?:copying|reproduction|use)", "reserved"),
    ("for personal", "for personal(?: and)? non ?commercial use only", "non-commercial"), ("non commercial", "non commercial use only", "non-commercial"), ("noncommercial", "noncommercial (?:use|purposes) only", "non-commercial"), ("research purposes", "for research purposes only", "research-only"),
    ("educational", "for educational purposes only", "education-only"), ("evaluation", "for evaluation purposes only", "evaluation-only"), ("trade secret", "trade secrets? of", "proprietary"), ("internal use", "for internal use only", "proprietary"),
    ("fair use", "fair use", "fair-use"), ("royalty free", "royalty free", "royalty-free"), ("open source", "open source license", "license-reference"), ("dual licensed", "dual licensed", "license-reference"), ("licensor", "the licensor", "license-reference"),
    ("public domain", "public domain", "public-domain"), ("copyrighted", "copyrighted material", "copyright"), ("used with permission", "used with permission", "permission"), ("by permission", "by permission of", "permission"), ("some rights", "some rights reserved", "some-rights-reserved"),
)


def default_rules() -> list[Rule]:
    """Signatures of common licenses, in order."""
    n = lambda *parts: {p: " ".join(p.split(".")) + (r"(?! \d)" if p.endswith(".0") else "(?: 0)?" if "." not in p else "") for p in parts}
    gnu = n("1", "2", "3", "2.1")
    out: list[Rule] = []
    for name, keyword, label, versions in (
        ("gnu general public", "general public", "gpl", gnu), ("gpl", "gpl", "gpl", gnu), ("general public", "general public", "gpl", gnu),
        ("(?:gnu )?lesser general public", "lesser", "lgpl", gnu), ("(?:gnu )?library general public", "library general", "lgpl", gnu), ("lgpl", "lgpl", "lgpl", gnu),
        ("(?:gnu )?affero general public", "affero", "agpl", n("1", "3")), ("agpl", "agpl", "agpl", n("1", "3")), ("gnu free documentation", "free documentation", "gfdl", n("1.1", "1.2", "1.3")),
        ("apache(?: software)?", "apache", "apache", n("1.0", "1.1", "2.0")), ("mozilla public", "mozilla", "mpl", n("1.0", "1.1", "2.0")), ("mpl", "mpl", "mpl", n("1.0", "1.1", "2.0")),
        ("eclipse public", "eclipse", "epl", n("1.0", "2.0")), ("epl", "epl", "epl", n("1.0", "2.0")), ("common development and distribution", "common development", "cddl", n("1.0", "1.1")),
        ("cddl", "cddl", "cddl", n("1.0", "1.1")), ("academic free", "academic free", "afl", n("1.1", "1.2", "2.0", "2.1", "3.0")), ("open software", "open software", "osl", n("1.0", "2.0", "2.1", "3.0")),
        ("artistic", "artistic", "artistic", n("1.0", "2.0")), ("boost software", "boost", "bsl", n("1.0")), ("european union public", "european union", "eupl", n("1.0", "1.1", "1.2")),
        ("eupl", "eupl", "eupl", n("1.0", "1.1", "1.2")), ("common public", "common public", "cpl", n("1.0")), ("ibm public", "ibm public", "ipl", n("1.0")), ("php", "php", "php", n("3.0", "3.01")),
        ("zope public", "zope", "zpl", n("1.1", "2.0", "2.1")), ("python software foundation", "python software", "psf", n("2")), ("sil open font", "open font", "ofl", n("1.0", "1.1")),
        ("open data commons open database", "open database", "odbl", n("1.0")), ("lucent public", "lucent", "lpl", n("1.0", "1.02")), ("nasa open source agreement", "nasa", "nasa", n("1.3")),
        ("reciprocal public", "reciprocal public", "rpl", n("1.1", "1.5")), ("server side public", "server side", "sspl", n("1")), ("business source", "business source", "busl", n("1.1")),
        ("elastic", "elastic", "elastic", n("2.0")), ("mulan permissive software", "mulan", "mulan-psl", n("1", "2")), ("cecill", "cecill", "cecill", n("1.0", "1.1", "2.0", "2.1")),
        ("qt public", "qt public", "qpl", n("1.0")), ("sun public", "sun public", "spl", n("1.0")), ("nokia open source", "nokia", "nokos", n("1.0")), ("microsoft public", "microsoft public", "ms-pl", n("1")),
    ):
        out += _versions(name, keyword, label, versions)
    # Creative Commons: each kind with each version, by its long and its short name.
    kinds = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    for kind, long in kinds.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Rule("cc by", rf"cc {kind.replace('-', ' ')}(?: version| v)? ?{version.replace('.', ' ')}", f"cc-{kind}-{version}", NAMED))
            out.append(Rule("creative commons", rf"creative commons {long}(?: international| unported| generic)?(?: license)?(?: version| v)? ?{version.replace('.', ' ')}", f"cc-{kind}-{version}", NAMED))
        out.append(Rule("cc by", f"cc {kind.replace('-', ' ')}", f"cc-{kind}", NAME))
        out.append(Rule("creative commons", f"creative commons {long}", f"cc-{kind}", NAME))
    # The wording of notices and of license texts.
    for keyword, regex, label in (
        ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font)", "mit"),
        ("permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
        ("redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
        ("neither the name", r"neither the names? of (?:\S+ ){1,12}?nor the names of its contributors may be used", "bsd-3-clause"),
        ("as is", "provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)(?: of any kind)?", "warranty-disclaimer"),
        ("apache", "licensed under the apache license version 2 0", "apache-2.0"),
        ("free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
        ("free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
        ("mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
        ("unencumbered", "this is free and unencumbered software released into the public domain", "unlicense"),
        ("what the fuck", "do what the fuck you want to public license", "wtfpl"),
        ("dedicated", r"(?:has )?dedicated (?:\S+ ){0,8}?to the public domain", "public-domain"),
        ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0-1.0"),
        ("altered source", "altered source versions must be plainly marked as such", "zlib"),
        ("boost", "distributed under the boost software license", "bsl-1.0"),
    ):
        out.append(Rule(keyword, regex, label, TEXT))
    for keyword, regex, label in (
        ("mit license", "(?:the )?mit license", "mit"), ("licensed under", "licensed under (?:the )?mit", "mit"), ("isc license", "isc license", "isc"), ("bsd", "(?:new|modified|3 clause|three clause) bsd license", "bsd-3-clause"), ("bsd", "(?:simplified|freebsd|2 clause|two clause) bsd license", "bsd-2-clause"),
        ("bsd", "bsd 3 clause", "bsd-3-clause"), ("bsd", "bsd 2 clause", "bsd-2-clause"), ("bsd", "bsd license", "bsd"), ("apache", "apache(?: software)? license", "apache"), ("zlib", "zlib license", "zlib"), ("unlicense", "the unlicense", "unlicense"),
        ("artistic", "artistic license", "artistic"), ("mozilla", "mozilla public license", "mpl"), ("eclipse", "eclipse public license", "epl"), ("public domain", "(?:in|into|to) the public domain", "public-domain"), ("openssl", "openssl license", "openssl"),
        ("wtfpl", "wtfpl", "wtfpl"), ("beerware", "beerware license", "beerware"), ("lesser", "lesser general public license", "lgpl"), ("affero", "affero general public license", "agpl"), ("free documentation", "free documentation license", "gfdl"),
        ("general public license", "(?:gnu )?general public license", "gpl"), ("creative commons", "creative commons(?: license)?", "cc"),
    ):
        out.append(Rule(keyword, regex, label, NAME))
    for spdx in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"):
        out.append(Rule("spdx", f"spdx license identifier {spdx.lower().replace('-', ' ').replace('.', ' ')}", spdx.lower(), TEXT))
    out += [Rule(keyword, regex, label, TEXT) for keyword, regex, label in WORDINGS]
    out += [Rule(keyword, regex, label, NAME) for keyword, regex, label in NAMES]
    out += [Rule(keyword, regex, label, CLUE) for keyword, regex, label in CLUES]
    for keyword, regex, label in (
        ("all rights reserved", "all rights reserved", "reserved"), ("copyright", r"copyright(?: c)? (?:19|20)\d\d", "copyright"), ("licensed under", "licensed under", "license-reference"), ("see the license", "see the license(?: file)?", "license-reference"), ("see license", "see license(?: file)?", "license-reference"),
        ("terms of use", "terms of use", "terms"), ("reproduced", "reproduced (?:with|by) permission", "permission"), ("may not be reproduced", "may not be reproduced", "reserved"), ("confidential", "confidential and proprietary", "proprietary"), ("proprietary", "proprietary license", "proprietary"),
    ):
        out.append(Rule(keyword, regex, label, CLUE))
    return out


def words(text: Column) -> Column:
    """Every word behind one space: `` w1 w2 ... wn``; empty without words."""
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(flat == "", "").otherwise(F.concat(F.lit(" "), flat))


def _spaces(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _places(flat: Column, regex: Column) -> Column:
    """Where the regular expression stands, from left to right: structs of ``start`` and ``end`` (words, from 0, end excluded)."""
    pattern = F.concat(F.lit(" (?:"), regex, F.lit(")(?= |$)"))
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def spans(found: Column) -> Column:
        between = F.call_function("split", flat, pattern, F.lit(-1))
        sizes = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")), lambda z: F.struct(_spaces(z["b"]).alias("b"), _spaces(z["m"]).alias("m")))
        return F.aggregate(
            sizes, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
            lambda s, x: F.struct((s["at"] + x["b"] + x["m"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["b"]).alias("start"), (s["at"] + x["b"] + x["m"]).alias("end")))).alias("out")),
            lambda s: s["out"],
        )

    # most rules find nothing: one pass over the text tells
    found = F.array(F.call_function("regexp_extract_all", flat, pattern, F.lit(0)))
    return F.transform(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(spans(m)))[0]


def any_of(words: list[str]) -> str:
    """A regular expression for any of some plain texts that shares their beginnings, so that it is dropped at the first letter that none has."""
    if "" in words:
        return ""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(h) + any_of(rest) for h, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def scan(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Adds what a scan of each whole text finds.

    ``n_words``; of the base phrases ``n_base`` (places, overlapping ones too), ``first_word``, ``last_word`` and
    ``base_labels`` (distinct, sorted); of the rules ``detections`` (structs ``start, end, priority, rank, label``
    that no other suppresses) and ``labels`` (with the base's); ``score``: the share that the best detection's
    priority has of the highest, scaled down for a text that is mostly other words.
    """
    rules = default_rules() if rules is None else rules
    by_keyword: dict[str, list[tuple[int, Rule]]] = {}
    for rank, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append((rank, r))
    # one constant that the optimiser folds
    held = [{"keyword": k, "rules": [{"regex": r.regex, "label": r.label, "priority": r.priority, "rank": i} for i, r in rs]} for k, rs in by_keyword.items()]
    table = F.from_json(F.lit(json.dumps(held)), "array<struct<keyword:string,rules:array<struct<regex:string,label:string,priority:int,rank:int>>>>")
    out = df.withColumn("_flat", words(F.col(text_col)))
    flat = F.col("_flat")
    base = {label: F.split(flat, f"(?= {phrase}(?: |$))", -1) for phrase, label in BASE.items()}
    out = out.withColumns({f"_b{i}": F.when(flat.contains(" " + phrase), pieces) for i, (phrase, pieces) in enumerate(zip(BASE, base.values(), strict=True))})
    cuts = {label: F.col(f"_b{i}") for i, label in enumerate(base)}
    # A text that begins with the phrase gives no empty first piece: such a split at 0 isn't made by the engine.
    at_start = {label: F.startswith(flat, F.lit(f" {phrase} ")) | (flat == f" {phrase}") for phrase, label in BASE.items()}
    count = {k: F.when(c.isNull(), F.lit(0)).otherwise(F.size(c) - 1 + at_start[k].cast("int")).cast("long") for k, c in cuts.items()}
    n_words = _spaces(flat)
    first = {k: F.when(count[k] > 0, F.when(at_start[k], F.lit(0).cast("long")).otherwise(_spaces(c[0]))) for k, c in cuts.items()}
    last = {k: F.when(count[k] > 0, n_words - _spaces(F.element_at(c, -1))) for k, c in cuts.items()}
    gate = flat.rlike(" " + any_of(list(by_keyword))) if by_keyword else F.lit(False)
    hits = F.flatten(F.transform(
        F.filter(table, lambda g: F.contains(flat, F.concat(F.lit(" "), g["keyword"]))),
        lambda g: F.flatten(F.transform(g["rules"], lambda r: F.transform(_places(flat, r["regex"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), (-r["priority"]).alias("order"), r["rank"].alias("rank"), p["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"))))),
    ))
    none = F.array().cast("array<struct<start:long,end:long,priority:int,rank:int,label:string>>")
    found = F.when(gate, F.array_sort(hits))
    # Sorted by start, then longest first: one lies inside an earlier one if that one's end isn't before its own.
    levels = F.array(*[F.lit(-1).cast("long")] * TEXT)
    swept = F.aggregate(
        found, F.struct(levels.alias("reach"), none.alias("out")),
        lambda s, d: F.struct(
            F.transform(s["reach"], lambda e, i: F.when(i + 1 <= d["priority"], F.greatest(e, d["end"])).otherwise(e)).alias("reach"),
            F.when(F.element_at(s["reach"], d["priority"]) >= d["end"], s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(d["start"].alias("start"), d["end"].alias("end"), d["priority"].alias("priority"), d["rank"].alias("rank"), d["label"].alias("label"))))).alias("out"),
        ),
        lambda s: s["out"],
    )
    out = out.withColumn("_found", swept)
    # A later, longer one of a higher priority can hold an earlier one with the same start only: those sort first.
    base_set = F.array_sort(F.array_compact(F.array(*(F.when(count[k] > 0, F.lit(k)) for k in sorted(count)))))
    made = {
        "n_words": n_words, "n_base": sum(count.values(), F.lit(0).cast("long")), "first_word": F.least(*first.values()), "last_word": F.greatest(*last.values()), "_base": base_set,
        "detections": F.coalesce("_found", none),
    }
    out = out.withColumns(made)
    seen = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0))
    covered = F.aggregate("detections", F.lit(0).cast("long"), lambda s, d: s + d["end"] - d["start"])
    score = best / F.lit(float(TEXT)) * (0.5 + 0.5 * F.least(F.lit(1.0), 10.0 * covered / F.greatest("n_words", F.lit(1))))
    out = out.withColumns({"base_labels": F.concat_ws(",", "_base"), "labels": F.concat_ws(",", seen), "score": score})
    return out.drop("_flat", "_b0", "_b1", "_b2", "_base", "_found")
