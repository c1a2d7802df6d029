"""License scans by ordered signature rules with a keyword prefilter."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels: fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, keyword, expression for the name in lower-case words, known versions.
FAMILIES = [
    ("gpl", "gpl", r"(?:gnu )?gpl", "1 2 3"),
    ("gpl", "gnu", r"gnu general public licen[sc]e", "1 2 3"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2 2.1 3"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", "2.1 3"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[sc]e", "2"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1 3"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "1 3"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)?", "1.0 1.1 2.0"),
    ("mit", "mit", r"mit(?: x11)?", ""),
    ("mit-0", "mit", r"mit (?:0|no attribution)", ""),
    ("bsd", "bsd", r"bsd", ""),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd licen[sc]e)", ""),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:modified|revised|new) bsd)", ""),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)", ""),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)", ""),
    ("isc", "isc", r"isc", ""),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "1.0 2.0"),
    ("epl", "epl", r"epl", "1.0 2.0"),
    ("cpl", "common", r"common public licen[sc]e", "1.0"),
    ("cddl", "cddl", r"cddl", "1.0 1.1"),
    ("cddl", "distribution", r"common development and distribution licen[sc]e", "1.0 1.1"),
    ("cc0", "cc0", r"cc0", "1.0"),
    ("cc0", "creative", r"creative commons (?:zero|public domain dedication)", "1.0"),
    ("cc-by", "cc", r"cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc", r"cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc", r"cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc", r"cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "creative", r"creative commons attribution", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s", "1.0 2.0 2.5 3.0 4.0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "2"),
    ("zlib", "zlib", r"zlib(?: libpng)?", ""),
    ("bsl", "boost", r"boost software licen[sc]e", "1.0"),
    ("busl", "business", r"business source licen[sc]e", "1.1"),
    ("sspl", "side", r"server side public licen[sc]e", "1"),
    ("elastic", "elastic", r"elastic licen[sc]e", "2.0"),
    ("artistic", "artistic", r"artistic licen[sc]e", "1.0 2.0"),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e", "1.0 1.1"),
    ("eupl", "eupl", r"eupl", "1.0 1.1 1.2"),
    ("eupl", "european", r"european union public licen[sc]e", "1.0 1.1 1.2"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ""),
    ("psf", "python", r"python (?:software foundation )?licen[sc]e", "2"),
    ("php", "php", r"php licen[sc]e", "3.0 3.01"),
    ("ruby", "ruby", r"ruby licen[sc]e", ""),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ""),
    ("openssl", "openssl", r"openssl licen[sc]e", ""),
    ("x11", "x11", r"x11 licen[sc]e", ""),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ""),
    ("afl", "academic", r"academic free licen[sc]e", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open", r"open software licen[sc]e", "1.0 1.1 2.0 2.1 3.0"),
    ("cecill", "cecill", r"cecill", "1.0 1.1 2.0 2.1"),
    ("odbl", "database", r"open database licen[sc]e", "1.0"),
    ("pddl", "dedication", r"public domain dedication and licen[sc]e", "1.0"),
    ("lppl", "latex", r"latex project public licen[sc]e", "1.0 1.2 1.3"),
    ("qpl", "q", r"q public licen[sc]e", "1.0"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", ""),
    ("vim", "vim", r"vim licen[sc]e", ""),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e", ""),
    ("json", "json", r"json licen[sc]e", ""),
    ("beerware", "beer", r"beer ?ware licen[sc]e", ""),
    ("ecl", "educational", r"educational community licen[sc]e", "1.0 2.0"),
    ("ipl", "ibm", r"ibm public licen[sc]e", "1.0"),
    ("unicode", "unicode", r"unicode (?:data files and software )?licen[sc]e", ""),
    ("curl", "curl", r"curl licen[sc]e", ""),
    ("tcl", "tcl", r"tcl(?: tk)? licen[sc]e", ""),
    ("nasa", "nasa", r"nasa open source agreement", "1.3"),
    ("rail", "rail", r"(?:bigscience |creativeml )?open ?rail(?: m)?", ""),
]

#: Keywords of names that mean a license without that word beside them ("mit" and the like are words of some language).
UNMISTAKABLE = {"gpl", "lgpl", "agpl", "cddl", "cc0", "cc", "creative", "eupl", "wtfpl", "unlicense", "cecill", "rail"}

# Sentences and names that stand in license texts and notices, each an expression of its own: label, keyword, expression. Fixed values.
SENTENCES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", r"(?:the above|this) copyright notice and this permission notice(?: \w+ the next paragraph)? shall be included in all copies or substantial portions"),
    ("mit", "furnished", r"to permit persons to whom the software is furnished to do so"),
    ("mit", "sublicense", r"rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("isc", "consortium", r"copyright \w+(?: \w+)? by internet systems consortium"),
    ("hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms(?: with or without modification)?"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "consequential", r"in no event shall the (?:copyright (?:holders?|owner)|regents|authors?)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "neither", r"neither the names? of (?:the )?(?:\w+ ){1,8}nor the names of (?:its|any|their) contributors"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause plus patent"),
    ("bsd-source-code", "attribution", r"bsd source code attribution"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "program", r"you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability"),
    ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("gpl", "absolutely", r"comes with absolutely no warranty"),
    ("gpl-2.0", "franklin", r"51 franklin st(?:reet)? fifth floor boston"),
    ("gpl-3.0", "tivoization", r"protecting users legal rights from anti circumvention law"),
    ("gpl-exception", "classpath", r"(?:with )?(?:the )?classpath exception"),
    ("gpl-exception", "runtime", r"gcc runtime library exception"),
    ("gpl-exception", "autoconf", r"autoconf (?:configure script )?exception"),
    ("gpl-exception", "bison", r"bison exception"),
    ("gpl-exception", "linking", r"gpl linking exception"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", "library", r"you should have received a copy of the gnu library general public licen[sc]e"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl", "remotely", r"users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("apache", "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "apache", r"you may obtain a copy of the licen[sc]e at https? www apache org licenses"),
    ("apache", "conditions", r"without warranties or conditions of any kind either express or implied"),
    ("apache", "asf", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-1.1", "jakarta", r"this product includes software developed by the apache software foundation"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0-no-copyleft", "incompatible", r"this source code form is incompatible with secondary licenses"),
    ("npl", "netscape", r"netscape public licen[sc]e"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) licen[sc]e"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cpl", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "sun", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "provided", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "libpng", r"(?:png reference library|libpng) licen[sc]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "cc0", r"to the extent possible under law"),
    ("cc-by", "attribution", r"this work is licensed under a creative commons attribution"),
    ("cc-by-sa", "sharealike", r"attribution sharealike"),
    ("cc-by-nc", "noncommercial", r"attribution noncommercial"),
    ("cc-by-nd", "noderivatives", r"attribution noderivatives"),
    ("cc-by-nc-sa", "noncommercial", r"attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "noncommercial", r"attribution noncommercial noderivatives"),
    ("cc", "creativecommons", r"creativecommons org (?:licenses|publicdomain)(?: \w+){0,5}"),
    ("cc", "creative", r"creative commons licen[sc]e"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|put|is) (?:in|into|to) the public domain"),
    ("public-domain", "disclaims", r"the author disclaims copyright to this source code"),
    ("public-domain", "blessing", r"may you do good and not evil"),
    ("public-domain", "domain", r"public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("bsl", "furnished", r"to whom the software is furnished to do so all subject to the following"),
    ("bsl", "obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("busl", "change", r"(?:change date|change licen[sc]e) (?:means|the date)"),
    ("busl", "production", r"the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl", "service", r"making the functionality of the program or modified version available to third parties as a service"),
    ("elastic", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "clause", r"commons clause licen[sc]e condition"),
    ("commons-clause", "clause", r"the right to sell the software"),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|strict|small business|free trial|internal use|perimeter)(?: licen[sc]e)?"),
    ("prosperity", "prosperity", r"prosperity public licen[sc]e"),
    ("parity", "parity", r"parity public licen[sc]e"),
    ("blueoak", "blue", r"blue oak model licen[sc]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e"),
    ("artistic", "artistic", r"under the (?:same )?terms (?:of|as) (?:the artistic licen[sc]e|perl itself)"),
    ("artistic", "perl", r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("perl", "perl", r"same terms as perl(?: 5| itself)?"),
    ("ofl", "font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", "font", r"reserved font names?"),
    ("bitstream-vera", "vera", r"bitstream vera(?: fonts)? (?:copyright|licen[sc]e)"),
    ("ubuntu-font", "ubuntu", r"ubuntu font licen[sc]e"),
    ("gust", "gust", r"gust font (?:nosource )?licen[sc]e"),
    ("psf", "psf", r"psf is making python available to licensee on an as is basis"),
    ("python-cnri", "cnri", r"cnri open source licen[sc]e agreement"),
    ("php", "php", r"this product includes php software freely available from"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by"),
    ("boringssl", "boringssl", r"boringssl licen[sc]e"),
    ("curl", "curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"buy me a beer in return"),
    ("postgresql", "postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ncsa", "ncsa", r"neither the names of (?:\w+ ){1,8}may be used to endorse or promote products derived from this software"),
    ("w3c", "w3c", r"w3c (?:software notice|document licen[sc]e|document notice)"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("x11", "x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("xfree86", "xfree86", r"xfree86 licen[sc]e"),
    ("ftl", "freetype", r"freetype (?:project )?licen[sc]e"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("libtiff", "libtiff", r"libtiff licen[sc]e"),
    ("bzip2", "bzip2", r"bzip2(?: libbzip2)? licen[sc]e"),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"),
    ("info-zip", "zip", r"info zip licen[sc]e"),
    ("snia", "snia", r"snia public licen[sc]e"),
    ("rpl", "reciprocal", r"reciprocal public licen[sc]e"),
    ("cpal", "attribution", r"common public attribution licen[sc]e"),
    ("apsl", "apple", r"apple public source licen[sc]e"),
    ("spl", "sun", r"sun public licen[sc]e"),
    ("sissl", "sun", r"sun industry standards source licen[sc]e"),
    ("intel", "intel", r"intel (?:open source|simplified software) licen[sc]e"),
    ("nvidia", "nvidia", r"nvidia (?:source code|open model|software) licen[sc]e"),
    ("rpsl", "realnetworks", r"realnetworks public source licen[sc]e"),
    ("nokia", "nokia", r"nokia open source licen[sc]e"),
    ("lucent", "lucent", r"lucent public licen[sc]e"),
    ("motosoto", "motosoto", r"motosoto open source licen[sc]e"),
    ("vsl", "vovida", r"vovida software licen[sc]e"),
    ("watcom", "watcom", r"sybase open watcom public licen[sc]e"),
    ("zpl", "zope", r"zope public licen[sc]e"),
    ("fair", "fair", r"fair licen[sc]e"),
    ("simpl", "simple", r"simple public licen[sc]e"),
    ("miros", "miros", r"miros licen[sc]e"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e|public licen[sc]e)"),
    ("oset", "oset", r"oset public licen[sc]e"),
    ("upl", "universal", r"universal permissive licen[sc]e"),
    ("entessa", "entessa", r"entessa public licen[sc]e"),
    ("frameworx", "frameworx", r"frameworx open licen[sc]e"),
    ("jabber", "jabber", r"jabber open source licen[sc]e"),
    ("wxwindows", "wxwindows", r"wxwindows library licen[sc]e"),
    ("ldp", "linux", r"linux documentation project licen[sc]e"),
    ("opl", "publication", r"open publication licen[sc]e"),
    ("ogl", "government", r"open government licen[sc]e"),
    ("oasis", "oasis", r"oasis (?:open )?ipr policy"),
    ("odc-by", "attribution", r"open data commons attribution licen[sc]e"),
    ("odbl", "commons", r"open data commons open database licen[sc]e"),
    ("pddl", "commons", r"open data commons public domain dedication"),
    ("cdla", "community", r"community data licen[sc]e agreement (?:permissive|sharing)"),
    ("llama", "llama", r"llama \d+(?: \d)? community licen[sc]e"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("openmdw", "openmdw", r"openmdw licen[sc]e"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:of this file )?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "trade", r"contains (?:valuable )?trade secrets"),
    ("proprietary", "written", r"without (?:the )?(?:express |prior )+written (?:permission|consent)"),
    ("proprietary", "evaluation", r"for evaluation purposes only"),
    ("proprietary", "internal", r"for internal use only"),
    ("eula", "user", r"end user licen[sc]e agreement"),
    ("eula", "eula", r"by (?:installing|using|downloading) (?:this|the) software you (?:agree|accept)"),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("non-commercial", "research", r"for (?:academic|research|educational)(?: and \w+)? (?:use|purposes) only"),
    ("non-commercial", "personal", r"for personal use only"),
    ("no-derivatives", "derivative", r"no derivative works"),
    ("share-alike", "alike", r"share ?alike"),
    ("freeware", "freeware", r"this (?:software|program) is freeware"),
    ("shareware", "shareware", r"this (?:software|program) is shareware"),
    ("cla", "contributor", r"contributor licen[sc]e agreement"),
    ("dco", "origin", r"developer certificate of origin"),
]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """The rules by falling priority: tags, notices with a version, names with a version, sentences, notices, names."""
    out: list[Rule] = []

    def add(label: str, keyword: str, expression: str, priority: int) -> None:
        out.append(Rule(f"{label}/{len(out)}", label, keyword, re.compile(rf"(?<= ){expression}(?= )".encode()), priority))

    for label, keyword, name, versions in FAMILIES:
        notice = r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:conditions of the )?"
        many = [(v, v.replace(".", " ").removesuffix(" 0")) for v in versions.split()]
        for version, spoken in many:
            number = rf"(?: licen[sc]e)?(?: version| ver| v)? ?v?{spoken}(?: 0)?(?: only| or later| or any later version)?"
            full = f"{label}-{version}"
            add(full, "spdx", rf"spdx licen[sc]e identifier {name}{number}", 100)
            add(full, keyword, rf"{notice}{name}{number}", 90)
            add(full, keyword, rf"{name}{number}", 80)
        add(label, "spdx", rf"spdx licen[sc]e identifier {name}", 95)
        add(label, keyword, rf"{notice}{name}(?: licen[sc]e)?", 60)
        add(label, keyword, rf"(?:the )?{name}(?: style)? licen[sc]ed?", 50)
        if "licen" in name or keyword in UNMISTAKABLE:
            add(label, keyword, name, 40)
    for label, keyword, expression in SENTENCES:
        add(label, keyword, expression, 70)
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(maxsize=1)
def _by_keyword() -> tuple[dict[bytes, list[Rule]], list[tuple[list[bytes], str]]]:
    index: dict[bytes, list[Rule]] = {}
    for rule in rules():
        index.setdefault(rule.keyword.encode(), []).append(rule)
    return index, [(p.encode().split(), label) for p, label in BASE.items()]


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8: all but the ASCII that isn't a digit or letter


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Finds all rules' keywords in one pass; octets stand as the characters of their number."""
    out = ahocorasick.Automaton()
    for key in _by_keyword()[0]:
        out.add_word(key.decode("latin-1"), key)
    out.make_automaton()
    return out


def _standing(found: list[tuple[int, int, str, str, int]], n: int) -> list[tuple[int, int, str, str, int]]:
    """The detections that lie within no other of greater rank (priority, then length, then place); those that overlap in part all stand.

    A detection lies within one taken before if, of these, those that start no later reach its end: the furthest ends by start are kept in a tree of running maxima.
    """
    furthest, taken = [0] * (n + 2), []
    for d in sorted(set(found), key=lambda d: (-d[4], d[0] - d[1], d[0], d[2], d[3])):
        k, reach = d[0] + 1, 0
        while k > 0:
            reach = max(reach, furthest[k])
            k -= k & -k
        if reach < d[1]:
            taken.append(d)
            k = d[0] + 1
            while k <= n + 1:
                furthest[k] = max(furthest[k], d[1])
                k += k & -k
    return taken


def scan(text: str | bytes | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, str, int]]]:
    """Words of the text; base places (first word, end, label); detections that stand (first word, end, label, rule, priority).

    A rule runs only on texts that hold its keyword, alone or within a word ("gplv3", "freebsd"). Detections are taken by falling priority, longer and earlier ones first among equals; one that lies within
    a detection already taken is suppressed, one that overlaps it in part stands beside it. Base places are never suppressed.
    """
    octets = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = _WORD.findall(octets.lower())
    index, phrases = _by_keyword()
    present = set(words)
    base = []
    for phrase, label in phrases:
        if present.issuperset(phrase):
            size = len(phrase)
            base += [(k, k + size, label) for k, w in enumerate(words) if w == phrase[0] and words[k : k + size] == phrase]
    joined = b" " + b" ".join(words) + b" "
    keys = {key for _, key in _automaton().iter(joined.decode("latin-1"))}
    chosen = [r for k, mine in index.items() if k in keys for r in mine]
    if not chosen:
        return len(words), sorted(base), []
    hits = [(rule, *m.span()) for rule in chosen for m in rule.pattern.finditer(joined)]
    if not hits:
        return len(words), sorted(base), []
    # Matches begin behind a space and end before one, so their word numbers are the spaces before these places.
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    firsts, ends = (np.searchsorted(spaces, [h[k] for h in hits]).tolist() for k in (1, 2))
    found = [(a - 1, b, rule.label, rule.name, rule.priority) for (rule, _, _), a, b in zip(hits, firsts, ends, strict=True)]
    return len(words), sorted(base), sorted(_standing(found, len(words)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...), repeated rows included.

    n_words; n_base, first_word, last_word, base_labels: number, smallest and largest start and labels of the base phrases' places; labels: those and the labels of the detections that stand;
    score: the largest priority among these in hundredths (0.5 for base places alone), 0 without any; matches: the detections. Null and
    empty texts have no words and empty labels; very long texts are scanned whole. Equal detections of two rules count for the first of them, and of
    nested ones of equal priority the outer stands, of those that overlap in part all. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, base, found = scan(text)
                labels = {b[2] for b in base}
                score = max([0.5 * bool(base), *(d[4] / 100 for d in found)])
                matches = [{"label": d[2], "rule": d[3], "first": d[0], "end": d[1]} for d in found]
                rows.append((n, len(base), base[0][0] if base else None, max(b[0] for b in base) if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {d[2] for d in found})), score, matches))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, rule: string, first: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, schema)
