"""Ordered license signature rules over normalised words (lower case, one blank between words).

A rule is a label, a regex over the words, the keywords that must all occur before the regex is tried, a priority and
a confidence. Families with many members (versions, ports, ids) are built from a few hand-written sentence forms; the
rest are written out. Earlier rules win over later ones of the same priority and extent.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern[bytes]
    keywords: frozenset[bytes]
    priority: int
    confidence: float


#: Name in running text -> (short id, versions). Versions are said as "version 2 0", "v2 0" or "2 0".
VERSIONED = {
    "gnu general public license": ("gpl", ("1", "2", "3")),
    "gnu lesser general public license": ("lgpl", ("2 1", "3")),
    "gnu library general public license": ("lgpl", ("2",)),
    "gnu affero general public license": ("agpl", ("1", "3")),
    "gnu free documentation license": ("gfdl", ("1 1", "1 2", "1 3")),
    "apache license": ("apache", ("1 0", "1 1", "2 0")),
    "mozilla public license": ("mpl", ("1 0", "1 1", "2 0")),
    "eclipse public license": ("epl", ("1 0", "2 0")),
    "common development and distribution license": ("cddl", ("1 0", "1 1")),
    "european union public licence": ("eupl", ("1 0", "1 1", "1 2")),
    "boost software license": ("bsl", ("1 0",)),
    "academic free license": ("afl", ("2 1", "3 0")),
    "open software license": ("osl", ("2 1", "3 0")),
    "artistic license": ("artistic", ("1 0", "2 0")),
    "common public license": ("cpl", ("1 0",)),
    "server side public license": ("sspl", ("1",)),
    "business source license": ("busl", ("1 1",)),
    "elastic license": ("elastic", ("1", "2 0")),
    "open database license": ("odbl", ("1 0",)),
    "sil open font license": ("ofl", ("1 0", "1 1")),
    "microsoft public license": ("ms-pl", ()),
    "microsoft reciprocal license": ("ms-rl", ()),
    "do what the fuck you want to public license": ("wtfpl", ("2",)),
    "python software foundation license": ("psf", ("2",)),
    "zope public license": ("zpl", ("2 0", "2 1")),
    "lucent public license": ("lpl", ("1 02",)),
    "educational community license": ("ecl", ("2 0",)),
    "cecill free software license agreement": ("cecill", ("2 0", "2 1")),
    "mulan permissive software license": ("mulan-psl", ("1", "2")),
    "creative commons attribution": ("cc-by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "creative commons attribution sharealike": ("cc-by-sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "creative commons attribution share alike": ("cc-by-sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "creative commons attribution noncommercial": ("cc-by-nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "creative commons attribution non commercial": ("cc-by-nc", ("2 0", "3 0", "4 0")),
    "creative commons attribution noderivatives": ("cc-by-nd", ("2 0", "3 0", "4 0")),
    "creative commons attribution no derivatives": ("cc-by-nd", ("2 0", "3 0", "4 0")),
    "creative commons attribution noncommercial sharealike": ("cc-by-nc-sa", ("2 0", "2 5", "3 0", "4 0")),
    "creative commons attribution noncommercial noderivatives": ("cc-by-nc-nd", ("2 0", "2 5", "3 0", "4 0")),
    "creative commons zero": ("cc0", ("1 0",)),
}

#: Licenses without versions in running text -> short id.
PLAIN = {
    "mit license": "mit", "expat license": "mit", "x11 license": "x11", "isc license": "isc", "zlib license": "zlib", "libpng license": "libpng",
    "bsd license": "bsd", "new bsd license": "bsd-3-clause", "modified bsd license": "bsd-3-clause", "simplified bsd license": "bsd-2-clause", "freebsd license": "bsd-2-clause", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "bsd 4 clause": "bsd-4-clause",
    "revised bsd license": "bsd-3-clause", "zero clause bsd": "0bsd", "unlicense": "unlicense", "openssl license": "openssl", "ruby license": "ruby", "php license": "php", "vim license": "vim", "curl license": "curl", "beerware license": "beerware", "postgresql license": "postgresql", "universal permissive license": "upl", "json license": "json", "unicode license": "unicode", "w3c license": "w3c", "sleepycat license": "sleepycat", "qt public license": "qpl", "sun public license": "spl", "ibm public license": "ipl", "nasa open source agreement": "nasa", "apple public source license": "apsl", "sybase open watcom public license": "watcom", "reciprocal public license": "rpl", "blue oak model license": "blueoak", "polyform noncommercial license": "polyform-nc", "commons clause": "commons-clause", "open government licence": "ogl", "etalab open license": "etalab", "community data license agreement": "cdla", "open data commons attribution license": "odc-by", "public domain dedication and license": "pddl", "responsible ai license": "rail",
}

#: Ids as package metadata writes them (punctuation is gone) -> label.
IDS = {
    "mit": "mit", "mit 0": "mit-0", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "0bsd": "0bsd", "wtfpl": "wtfpl", "postgresql": "postgresql", "python 2 0": "psf-2.0",
    "apache 1 0": "apache-1.0", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0",
    "gpl 1 0": "gpl-1", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 0": "lgpl-2", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 1 0": "agpl-1", "agpl 3 0": "agpl-3",
    "mpl 1 0": "mpl-1.0", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0",
    "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "bsd 4 clause": "bsd-4-clause", "bsl 1 0": "bsl-1.0",
    "cc0 1 0": "cc0-1.0", "cc by 2 0": "cc-by-2.0", "cc by 3 0": "cc-by-3.0", "cc by 4 0": "cc-by-4.0", "cc by sa 3 0": "cc-by-sa-3.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nc 4 0": "cc-by-nc-4.0", "cc by nd 4 0": "cc-by-nd-4.0", "cc by nc sa 4 0": "cc-by-nc-sa-4.0", "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "ofl 1 1": "ofl-1.1", "odbl 1 0": "odbl-1.0", "sspl 1 0": "sspl-1", "busl 1 1": "busl-1.1", "elastic 2 0": "elastic-2.0", "afl 3 0": "afl-3.0", "osl 3 0": "osl-3.0", "ecl 2 0": "ecl-2.0", "ms pl": "ms-pl", "ms rl": "ms-rl", "ncsa": "ncsa", "upl 1 0": "upl", "blueoak 1 0 0": "blueoak",
}

#: Addresses of license texts -> short id. Punctuation is gone, so an address is a row of words.
ADDRESSES = {
    "apache org licenses license 2 0": "apache", "www gnu org licenses gpl": "gpl", "www gnu org licenses lgpl": "lgpl", "www gnu org licenses agpl": "agpl", "www gnu org licenses fdl": "gfdl", "opensource org licenses mit": "mit", "opensource org licenses bsd": "bsd", "opensource org licenses isc": "isc", "opensource org licenses apache": "apache", "mozilla org mpl": "mpl", "eclipse org legal epl": "epl", "boost org license 1 0": "bsl", "unlicense org": "unlicense", "scripts sil org ofl": "ofl", "opendatacommons org licenses odbl": "odbl", "opendatacommons org licenses by": "odc-by", "creativecommons org publicdomain zero": "cc0", "creativecommons org publicdomain mark": "public-domain",
    "creativecommons org licenses by": "cc-by", "creativecommons org licenses by sa": "cc-by-sa", "creativecommons org licenses by nc": "cc-by-nc", "creativecommons org licenses by nd": "cc-by-nd", "creativecommons org licenses by nc sa": "cc-by-nc-sa", "creativecommons org licenses by nc nd": "cc-by-nc-nd",
}

#: Sentences of license texts and notices, written out: label, regex, confidence.
CLAUSES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.97),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 0.97),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used", 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", 0.95),
    ("apache", r"licensed under the apache license", 0.97),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license", 0.85),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu", 0.95),
    ("gpl", r"gnu gpl", 0.85),
    ("gpl", r"gpl v?[123](?: 0)?(?: or later)?", 0.8),
    ("lgpl", r"lgpl v?[23](?: [01])?", 0.8),
    ("agpl", r"agpl v?3(?: 0)?", 0.8),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", 0.98),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 0.98),
    ("wtfpl", r"you just do what the fuck you want to", 0.9),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.97),
    ("warranty", r"without warranties or conditions of any kind", 0.5),
    ("warranty", r"without even the implied warranty of merchantability", 0.5),
    ("warranty", r"the software is provided as is without warranty of any kind", 0.5),
    ("public-domain", r"(?:is|are|been) (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8),
    ("public-domain", r"public domain mark", 0.8),
    ("public-domain", r"no rights reserved", 0.7),
    ("reserved", r"all rights are reserved", 0.6),
    ("reserved", r"alle rechte vorbehalten", 0.6),
    ("reserved", r"tous droits réservés", 0.6),
    ("reserved", r"todos los derechos reservados", 0.6),
    ("reserved", r"some rights reserved", 0.5),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.4),
    ("copyright", r"(?:19|20)[0-9]{2} (?:[^ ]+ ){1,5}all rights reserved", 0.5),
    ("proprietary", r"proprietary and confidential", 0.7),
    ("proprietary", r"unauthorized (?:copying|reproduction|use|distribution)", 0.6),
    ("proprietary", r"may not be (?:reproduced|redistributed|copied)(?: [^ ]+){0,8} without (?:the )?(?:prior |express |written )*(?:permission|consent)", 0.7),
    ("no-commercial", r"for (?:non ?commercial|personal) (?:use|purposes) only", 0.6),
    ("no-commercial", r"not (?:be used )?for commercial (?:use|purposes)", 0.6),
    ("cc", r"this work is licensed under a creative commons", 0.8),
    ("cc", r"licensed under (?:the )?creative commons", 0.8),
    ("cc-by", r"used under cc by", 0.8),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?", 0.9),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?", 0.9),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?", 0.9),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?", 0.92),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?", 0.92),
    ("cc-by", r"cc by [1-4] [05]", 0.9),
    ("cc0", r"cc0", 0.8),
    ("dual", r"dual licensed under", 0.6),
    ("dual", r"at your option any later version", 0.5),
    ("notice", r"released under the terms of the", 0.3),
    ("notice", r"see the (?:accompanying )?license file", 0.5),
    ("notice", r"subject to the (?:following )?license terms", 0.3),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute", 0.98),
    ("mit", r"sublicense and or sell copies of the software", 0.9),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.85),
    ("mit", r"mit x11 licen[sc]e", 0.85),
    ("mit", r"(?:the )?mit licen[sc]ed?", 0.8),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("isc", r"the author disclaims all warranties with regard to this software", 0.85),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 0.95),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 0.95),
    ("bsd", r"this software is provided by the (?:copyright holders|author|regents)(?: [^ ]+){0,4} as is and any express or implied warranties", 0.9),
    ("bsd-2-clause", r"bsd 2 clause(?: licen[sc]e)?", 0.9),
    ("bsd-3-clause", r"bsd 3 clause(?: licen[sc]e)?", 0.9),
    ("bsd-4-clause", r"this product includes software developed by (?:[^ ]+ ){1,12}and its contributors", 0.9),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0.8),
    ("apache", r"you may not use this file except in compliance with the license", 0.95),
    ("apache", r"you may obtain a copy of the license at", 0.85),
    ("apache", r"see the license for the specific language governing permissions and limitations", 0.9),
    ("apache", r"licensed to the apache software foundation", 0.95),
    ("apache", r"this product includes software developed (?:at|by) the apache software foundation", 0.9),
    ("apache-2.0", r"apache licen[sc]e v?2(?: 0)?", 0.9),
    ("apache-2.0", r"asl ?2 0", 0.85),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl", r"you should have received a copy of the gnu general public license along with this (?:program|library|package)", 0.95),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", 0.95),
    ("gpl", r"if not write to the free software foundation", 0.85),
    ("gpl-2", r"(?:gnu )?gplv2", 0.9),
    ("gpl-3", r"(?:gnu )?gplv3", 0.9),
    ("gpl-2", r"under the terms of version 2 of the gnu general public license", 0.95),
    ("gpl-2", r"either version 2 of the license or (?:at your option )?any later version", 0.9),
    ("gpl-3", r"either version 3 of the license or (?:at your option )?any later version", 0.9),
    ("gpl-3", r"under the terms of version 3 of the gnu general public license", 0.95),
    ("lgpl-2.1", r"(?:gnu )?lgplv2 1", 0.9),
    ("lgpl-2", r"(?:gnu )?lgplv2", 0.85),
    ("lgpl-3", r"(?:gnu )?lgplv3", 0.9),
    ("lgpl", r"gnu lgpl", 0.85),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license", 0.95),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", 0.9),
    ("agpl-3", r"(?:gnu )?agplv3", 0.9),
    ("agpl", r"gnu agpl", 0.85),
    ("agpl", r"users interacting with it remotely through a computer network", 0.9),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.98),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("gpl-exception", r"as a special exception (?:the copyright holders|you may)", 0.8),
    ("classpath-exception", r"linking this library statically or dynamically with other modules", 0.9),
    ("mpl", r"the contents of this file are subject to the (?:mozilla|netscape) public license", 0.95),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one", 0.98),
    ("mpl-2.0", r"mpl ?v?2(?: 0)?", 0.85),
    ("mpl", r"incompatible with secondary licenses", 0.85),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.98),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 0.98),
    ("cpl", r"the accompanying program is provided under the terms of this common public license", 0.98),
    ("eupl", r"licensed under the eupl", 0.95),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic", r"same terms as perl itself", 0.85),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.97),
    ("zlib", r"altered source versions must be plainly marked as such", 0.95),
    ("libpng", r"the png reference library is supplied as is", 0.95),
    ("openssl", r"this product includes software developed by the openssl project", 0.95),
    ("php", r"this product includes php software", 0.95),
    ("psf", r"psf is making python available to licensee on an as is basis", 0.97),
    ("python", r"this license agreement is between the python software foundation", 0.97),
    ("ncsa", r"university of illinois ncsa open source license", 0.97),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 0.97),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 0.95),
    ("json", r"the software shall be used for good not evil", 0.97),
    ("ofl", r"this font software is licensed under the sil open font license", 0.98),
    ("ofl", r"reserved font name", 0.8),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.97),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", 0.97),
    ("cc0", r"to the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright and related or neighboring rights", 0.97),
    ("cc", r"creative commons is not a party to (?:its|this) (?:public )?licenses?", 0.9),
    ("cc", r"you are free to share copy and redistribute the material in any medium or format", 0.9),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 0.85),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original", 0.9),
    ("cc-by-nc", r"you may not use the material for commercial purposes", 0.9),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", 0.9),
    ("cc-by-sa", r"attribution share ?alike", 0.7),
    ("cc-by-nc", r"attribution non ?commercial", 0.7),
    ("cc-by-nd", r"attribution no ?deriv(?:ative)?s", 0.7),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license", 0.95),
    ("sspl", r"making the functionality of the program or modified version available to third parties as a service", 0.95),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 0.97),
    ("busl", r"change date (?:[^ ]+ ){1,12}change license", 0.85),
    ("elastic", r"elastic licen[sc]e v?[12](?: 0)?", 0.9),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", 0.95),
    ("commons-clause", r"commons clause license condition", 0.97),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 0.97),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license", 0.95),
    ("hippocratic", r"hippocratic license", 0.9),
    ("openrail", r"(?:creativeml )?open ?rail(?: [ms])?", 0.85),
    ("openrail", r"use based restrictions as referenced in paragraph", 0.9),
    ("llama", r"llama [234](?: [0-9])? community license", 0.95),
    ("patent", r"patent license to make have made use offer to sell sell import and otherwise transfer", 0.6),
    ("patent", r"grant of patent license", 0.5),
    ("warranty", r"there is no warranty for the program to the extent permitted by applicable law", 0.6),
    ("warranty", r"provided on an as is basis without warranties", 0.5),
    ("warranty", r"no warranty (?:is )?(?:expressed|express) or implied", 0.5),
    ("liability", r"in no event (?:shall|will) (?:the |any )?(?:[^ ]+ ){1,8}be liable", 0.5),
    ("notice", r"licensed under the terms of", 0.4),
    ("notice", r"under the same (?:license|terms) as", 0.4),
    ("notice", r"see (?:the )?(?:file )?(?:copying|licen[sc]e|notice)(?: txt| md)? (?:file )?for (?:more )?(?:details|information)", 0.6),
    ("notice", r"unter der lizenz", 0.4),
    ("notice", r"sous licence", 0.4),
    ("notice", r"bajo (?:la )?licencia", 0.4),
    ("proprietary", r"(?:strictly )?confidential and proprietary", 0.7),
    ("proprietary", r"no part of this (?:publication|document|work|book) may be reproduced", 0.8),
    ("proprietary", r"for internal use only", 0.5),
    ("proprietary", r"end user license agreement", 0.6),
    ("proprietary", r"all other rights (?:are )?reserved", 0.6),
    ("reserved", r"alle rechte sind vorbehalten", 0.6),
    ("reserved", r"tutti i diritti riservati", 0.6),
    ("reserved", r"todos os direitos reservados", 0.6),
    ("public-domain", r"(?:this (?:work|file|code|software) is )?in the public domain", 0.6),
    ("public-domain", r"gemeinfrei", 0.6),
    ("public-domain", r"domaine public", 0.5),
    ("public-domain", r"dominio público", 0.5),
    ("no-commercial", r"non ?commercial (?:use|purposes) only", 0.6),
    ("no-commercial", r"free for (?:personal|academic|educational|research) use", 0.6),
    ("no-training", r"may not be used (?:to train|for training)(?: [^ ]+){0,6} (?:models?|ai|intelligence)", 0.8),
    ("attribution", r"attribution (?:is )?required", 0.5),
)

#: Contract phrases; their detections are never suppressed.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

_GROUP = re.compile(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?")
_SPECIAL = re.compile(r"[^ ]*[\[\](){}|?*+\\^][^ ]*")


def _gap(group: re.Match) -> str:
    """What a group leaves behind: a gap between words if it brings its blanks along, else a mark on the words it touches."""
    inner = group[0].rsplit(")", 1)[0].removeprefix("(").removeprefix("?:").split("|")
    return " . " if all(x.endswith(" ") for x in inner) or all(x.startswith(" ") for x in inner) else "?"


def _keywords(pattern: str) -> frozenset[bytes]:
    """Up to three words that every match has: whole words of the pattern outside its groups and classes, the longest."""
    while (less := _GROUP.sub(_gap, pattern)) != pattern:
        pattern = less
    plain = [w for w in _SPECIAL.sub(" . ", pattern).split() if w.isalnum()]
    return frozenset(w.encode() for w in sorted(plain, key=lambda w: (-len(w), w))[:3])


def rule(label: str, pattern: str, priority: int, confidence: float) -> Rule:
    return Rule(label, re.compile(b"(?<![^ ])" + pattern.encode() + b"(?![^ ])"), _keywords(pattern), priority, confidence)


def rules() -> list[Rule]:
    """All rules in order. Priorities: ids and addresses 5, versioned names 4, sentences 3, bare names 2, notices 1."""
    out = [rule(label, rf"spdx license identifier {ids}(?: only| or later)?", 5, 0.99) for ids, label in IDS.items()]
    out += [rule(label, rf"(?:https? )?(?:www )?{re.sub('^www ', '', address)}(?: [0-9] [0-9])?(?: legalcode)?", 5, 0.95) for address, label in ADDRESSES.items()]
    for name, (label, versions) in VERSIONED.items():
        out += [rule(f"{label}-{v.replace(' ', '.')}", rf"(?:the )?{name}(?: international| unported)? (?:version |v ?)?{v}(?: 0)?(?: international| unported| generic)?(?: or (?:any )?later(?: version)?)?", 4, 0.97) for v in versions]
    out += [rule(label, pattern, 1 if confidence < 0.45 else 3, confidence) for label, pattern, confidence in CLAUSES]
    for name, (label, _) in VERSIONED.items():
        out.append(rule(label, rf"(?:licensed|distributed|released|available|published) under (?:the |a )?(?:terms of the )?{name}", 3, 0.95))
        out.append(rule(label, rf"(?:the )?{name}", 2, 0.85))
    for name, label in PLAIN.items():
        out.append(rule(label, rf"(?:licensed|distributed|released|available|published) under (?:the |a )?(?:terms of the )?{name}", 3, 0.95))
        out.append(rule(label, rf"(?:the )?{name}", 2, 0.8))
    return out
