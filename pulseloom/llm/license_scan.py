"""License scan: ordered signature rules with a keyword prefilter, priorities and interval-containment suppression.

Two kinds of rules: signatures of licence texts, notices, clauses and disclaimers, written by hand one by one, and
the ways in which each of the families is named, identified or linked.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

#: The base phrases and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Fixed values: (label, keywords of which any will do, name as a regex over lower-case words, identifier as words, address as words).
FAMILIES = [
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd) licen[cs]e", "0bsd", "opensource org licenses 0bsd"),
    ("afl-3", "academic", "academic free licen[cs]e(?: v| version)? 3(?: 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licen[cs]e(?: v| version)? ?3", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl"),
    ("apache-1", "apache", "apache(?: software)? licen[cs]e(?: v| version)? ?1(?: [01])?", "apache 1 [01]", "apache org licenses license 1"),
    ("apache-2", "apache", "apache(?: software)? licen[cs]e(?: v| version)? ?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("artistic-1", "artistic", "artistic licen[cs]e(?: v| version)? ?1(?: 0)?", "artistic 1 0", "opensource org licenses artistic 1"),
    ("artistic-2", "artistic", "artistic licen[cs]e(?: v| version)? ?2(?: 0)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("beerware", "beer", "beer ?ware licen[cs]e", "beerware", "people freebsd org phk"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[cs]e", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[cs]e", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("bsl-1", "boost", "boost software licen[cs]e(?: v| version)?(?: 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", "business", "business source licen[cs]e(?: v| version)?(?: 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("cc-by", "cc by|creative", "(?:cc by|creative commons attribution)(?: international| licen[cs]e)?(?: [1-4] 0)?(?! (?:nc|nd|sa|non ?commercial|no ?deriv|share))", "cc by [1-4] 0", "creativecommons org licenses by [1-4]"),
    ("cc-by-nc", "cc by|creative", "(?:cc by nc|creative commons attribution non ?commercial)(?: international| licen[cs]e)?(?: [1-4] 0)?(?! (?:nd|sa|no ?deriv|share))", "cc by nc [1-4] 0", "creativecommons org licenses by nc [1-4]"),
    ("cc-by-nc-nd", "cc by|creative", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: works)?(?: [1-4] 0)?", "cc by nc nd [1-4] 0", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "cc by|creative", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?", "cc by nc sa [1-4] 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nd", "cc by|creative", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: works)?(?: [1-4] 0)?", "cc by nd [1-4] 0", "creativecommons org licenses by nd"),
    ("cc-by-sa", "cc by|creative", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?", "cc by sa [1-4] 0", "creativecommons org licenses by sa"),
    ("cc0-1", "cc0|creative", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?(?: public domain dedication| licen[cs]e)", "cc0 1 0", "creativecommons org publicdomain zero"),
    ("cddl-1", "common", "common development and distribution licen[cs]e(?: v| version)?(?: 1 [01])?", "cddl 1 [01]", "opensource org licenses cddl"),
    ("cecill-2", "cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", "cecill 2 [01]", "cecill info licences"),
    ("cpl-1", "common", "common public licen[cs]e(?: v| version)?(?: 1 0)?", "cpl 1 0", "opensource org licenses cpl1"),
    ("ecl-2", "educational", "educational community licen[cs]e(?: v| version)?(?: 2 0)?", "ecl 2 0", "opensource org licenses ecl 2 0"),
    ("epl-1", "eclipse", "eclipse public licen[cs]e(?: v| version)? ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e(?: v| version)? ?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: v| version)?(?: 1 [012])?", "eupl 1 [012]", "joinup ec europa eu"),
    ("gfdl-1", "documentation", "(?:gnu )?free documentation licen[cs]e(?: v| version)?(?: 1 [123])?", "gfdl 1 [123]", "gnu org licenses fdl"),
    ("gpl-1", "gnu", "gnu general public licen[cs]e(?: v| version)? ?1", "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2", "gnu", "gnu general public licen[cs]e(?: v| version)? ?2", "gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3", "gnu", "gnu general public licen[cs]e(?: v| version)? ?3", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu", "gnu general public licen[cs]e", "gpl", "gnu org licenses gpl"),
    ("isc", "isc", "isc licen[cs]e", "isc", "opensource org licenses isc"),
    ("lgpl-2", "gnu", "gnu (?:lesser|library) general public licen[cs]e(?: v| version)? ?2(?: [01])?", "lgpl 2 [01](?: only| or later)?", "gnu org licenses lgpl 2"),
    ("lgpl-3", "gnu", "gnu lesser general public licen[cs]e(?: v| version)? ?3", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3"),
    ("lppl-1.3", "latex", "latex project public licen[cs]e(?: v| version)?(?: 1 [0-3])?", "lppl 1 3", "latex project org lppl"),
    ("mit", "mit", "mit licen[cs]e", "mit", "opensource org licenses mit"),
    ("mit-0", "attribution", "mit no attribution licen[cs]e", "mit 0", "github com aws mit 0"),
    ("mpl-1", "mozilla", "mozilla public licen[cs]e(?: v| version)? ?1(?: [01])?", "mpl 1 [01]", "mozilla org mpl 1"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl", "opensource org licenses ms rl"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source licen[cs]e", "ncsa", "opensource org licenses ncsa"),
    ("odbl-1", "database", "open (?:data commons open )?database licen[cs]e(?: v| version)?(?: 1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1", "data", "open data commons attribution licen[cs]e", "odc by 1 0", "opendatacommons org licenses by"),
    ("ofl-1.1", "font", "(?:sil )?open font licen[cs]e(?: v| version)?(?: 1 [01])?", "ofl 1 [01]", "scripts sil org ofl"),
    ("osl-3", "open", "open software licen[cs]e(?: v| version)?(?: 3 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql"),
    ("psf-2", "python", "python software foundation licen[cs]e(?: v| version)?(?: 2)?", "psf 2 0", "docs python org 3 license"),
    ("sspl-1", "server", "server side public licen[cs]e(?: v| version)?(?: 1)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense org"),
    ("upl-1", "universal", "universal permissive licen[cs]e(?: v| version)?(?: 1 0)?", "upl 1 0", "opensource org licenses upl"),
    ("vim", "vim", "vim licen[cs]e", "vim", "vimhelp org uganda txt"),
    ("wtfpl", "want", "do what the (?:fuck|f) you want to public licen[cs]e", "wtfpl", "wtfpl net"),
    ("x11", "x11", "x11 licen[cs]e", "x11", "spdx org licenses x11"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "opensource org licenses zlib"),
    ("zpl-2", "zope", "zope public licen[cs]e(?: v| version)?(?: 2 [01])?", "zpl 2 [01]", "opensource org licenses zpl"),
]
#: Fixed values: (kind, regex around a name N, identifier I or address A, priority, certainty).
SHAPES = [
    ("identifier", r"\bspdx licen[cs]e identifier (?:I)\b", 5, 1.0),
    ("grant", r"\b(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:N)\b", 4, 0.95),
    ("terms", r"\b(?:subject to|governed by|under) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:N)\b", 3, 0.9),
    ("address", r"\b(?:A)\b", 2, 0.85),
    ("name", r"\b(?:N)\b", 1, 0.6),
]
#: Hand-written signatures, in words: (label, keywords of which any will do, regex), by priority and certainty.
SIGNATURES = {
    # The sentence that grants a whole licence.
    (6, 0.97): [
        ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("ncsa", "deal with the software", r"to deal with the software without restriction"),
        ("bsl-1", "person or organization", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
        ("unicode", "unicode", r"obtaining a copy of (?:the )?unicode data files"),
        ("0bsd", "without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
        ("isc", "without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided"),
        ("ntp", "without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
        ("hpnd", "without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
        ("postgresql", "without fee", r"for any purpose without fee and without a written agreement is hereby granted"),
        ("tcl", "hereby grant permission", r"the authors hereby grant permission to use copy modify distribute and license this software"),
        ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
        ("zlib", "alter it and redistribute", r"including commercial applications and to alter it and redistribute it freely"),
        ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
        ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff"),
        ("wtfpl", "you just do what", r"0 you just do what the (?:fuck|f) you want to"),
        ("psf-2", "psf hereby", r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
        ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
        ("artistic-1", "intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
        ("artistic-2", "given free software package", r"this license establishes the terms under which a given free software package may be copied modified distributed"),
        ("gfdl-1", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
        ("w3c", "obtaining using and or copying", r"by obtaining using and or copying this work you the licensee agree"),
    ],
    # The notice that stands in a file and names a licence with its version.
    (5, 0.95): [
        ("apache-2", "apache", r"licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance"),
        ("gpl-2-or-later", "gnu general", r"gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or (?:at your option )?any later version"),
        ("gpl-3-or-later", "gnu general", r"gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (?:at your option )?any later version"),
        ("gpl-2-only", "gnu general", r"gnu general public licen[cs]e version 2 (?:only )?as published by the free software foundation"),
        ("gpl-3-only", "gnu general", r"gnu general public licen[cs]e version 3 (?:only )?as published by the free software foundation"),
        ("lgpl-2-or-later", "gnu library", r"gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or (?:at your option )?any later version"),
        ("lgpl-2.1-or-later", "gnu lesser", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or (?:at your option )?any later version"),
        ("lgpl-3-or-later", "gnu lesser", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (?:at your option )?any later version"),
        ("lgpl-2.1-only", "gnu lesser", r"gnu lesser general public licen[cs]e version 2 1 (?:only )?as published by the free software foundation"),
        ("agpl-3-or-later", "affero", r"gnu affero general public licen[cs]e as published by the free software foundation either version 3"),
        ("agpl-3-only", "affero", r"gnu affero general public licen[cs]e version 3 (?:only )?as published by the free software foundation"),
        ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v ?2 0"),
        ("mpl-1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]"),
        ("npl", "netscape", r"the contents of this file are subject to the netscape public licen[cs]e"),
        ("cddl-1", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
        ("epl-1", "eclipse", r"made available under the terms of the eclipse public licen[cs]e v ?1 0"),
        ("epl-2", "eclipse", r"made available under the terms of the eclipse public licen[cs]e (?:v )?2 0"),
        ("edl-1", "eclipse distribution", r"eclipse distribution licen[cs]e (?:v ?)?1 0"),
        ("cpl-1", "common public", r"made available under the terms of the common public licen[cs]e v ?1 0"),
        ("ipl-1", "ibm public", r"ibm public licen[cs]e version 1 0"),
        ("ofl-1.1", "font software", r"this font software is licensed under the sil open font licen[cs]e"),
        ("lppl-1.3", "latex", r"may be distributed and or modified under the conditions of the latex project public licen[cs]e"),
        ("cecill-2", "cecill", r"this software is governed by the cecill(?: [abc])? licen[cs]e under french law"),
        ("eupl-1.2", "eupl", r"licensed under the eupl (?:version |v ?)?1 [012]"),
        ("bsl-1", "boost", r"distributed under the boost software licen[cs]e version 1 0"),
        ("afl-3", "academic", r"licensed under the academic free licen[cs]e version 3 0"),
        ("osl-3", "open software", r"licensed under the open software licen[cs]e version 3 0"),
        ("php-3", "php", r"this source file is subject to version 3 0 ?1? of the php licen[cs]e"),
        ("perl-5", "perl itself", r"under the same terms as (?:the )?perl itself"),
        ("ruby", "as ruby", r"(?:distributed|redistribute it|licensed) (?:and or modify it )?under the same (?:terms|licen[cs]e) as ruby"),
        ("mulanpsl-2", "mulan", r"licensed under mulan psl v2"),
        ("cc-by-nc-nd", "creative", r"licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
        ("cc-by-nc-sa", "creative", r"licensed under (?:a|the) creative commons attribution non ?commercial share ?alike"),
        ("cc-by-nc", "creative", r"licensed under (?:a|the) creative commons attribution non ?commercial(?! (?:no ?deriv|share))"),
        ("cc-by-sa", "creative", r"licensed under (?:a|the) creative commons attribution share ?alike"),
        ("cc-by-nd", "creative", r"licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s"),
        ("cc-by", "creative", r"licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e"),
        ("cc0-1", "has waived all", r"has waived all copyright and related or neighbou?ring rights"),
        ("odbl-1", "open database", r"made available (?:here )?under the open database licen[cs]e"),
        ("ogl-uk", "public sector information", r"contains public sector information licensed under the open government licen[cs]e"),
        ("openldap", "openldap", r"openldap public licen[cs]e version 2 [0-8]"),
    ],
    # A clause that only one licence, or one family, has.
    (4, 0.9): [
        ("mit", "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
        ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions"),
        ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
        ("bsd-3", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        ("bsd-4-uc", "university of california", r"this product includes software developed by the university of california(?: berkeley)? and its contributors"),
        ("x11", "except as contained", r"except as contained in this notice the names? of (?:\S+ ){1,8}shall not be used in advertising or otherwise to promote the sale"),
        ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
        ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
        ("apache-1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
        ("apache-1", "end user documentation", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
        ("apache-2", "each contributor hereby", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
        ("apache-2", "carry prominent notices", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
        ("gpl", "gnu general", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
        ("gpl", "copy of the gnu general", r"you should have received a copy of the gnu general public licen[cs]e along with"),
        ("lgpl", "copy of the gnu l", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with"),
        ("agpl-3", "copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[cs]e along with"),
        ("gpl-2", "take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
        ("gpl-3", "copyleft license for", r"the gnu general public licen[cs]e is a free copyleft license for software and other kinds of works"),
        ("agpl-3", "network server software", r"cooperation with the community in the case of network server software"),
        ("lgpl-3", "incorporates the terms", r"gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e"),
        ("lgpl-2.1", "released version of the lesser", r"this is the first released version of the lesser gpl"),
        ("gfdl-1", "invariant sections", r"with (?:no invariant sections|the invariant sections being)"),
        ("classpath-exception", "independent modules", r"permission to link this library with independent modules to produce an executable"),
        ("gcc-exception", "runtime library exception", r"gcc runtime library exception"),
        ("font-exception", "uses this font", r"as a special exception if you create a document which uses this font"),
        ("autoconf-exception", "autoconf", r"as part of a program that contains a configuration script generated by autoconf"),
        ("bison-exception", "parser skeleton", r"a larger work that contains part or all of the bison parser skeleton"),
        ("openssl-exception", "openssl", r"permission to link (?:the code of )?(?:\S+ ){1,8}with the openssl"),
        ("linking-exception", "linking exception", r"(?:static|dynamic) linking exception"),
        ("mpl-2", "copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
        ("mpl-1", "alternatively the contents", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e"),
        ("ofl-1.1", "fonts including any derivative", r"the fonts including any derivative works can be bundled embedded redistributed and or sold"),
        ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font names?"),
        ("lppl-1.3", "lppl", r"this work has the lppl maintenance status"),
        ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
        ("libpng", "png reference library", r"the png reference library is supplied as is"),
        ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group"),
        ("ftl", "freetype", r"(?:the freetype project|under the freetype) licen[cs]e"),
        ("bsl-1", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
        ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
        ("json", "good not evil", r"the software shall be used for good not evil"),
        ("blessing", "find forgiveness", r"may you find forgiveness for yourself and forgive others"),
        ("vim", "charityware", r"vim is charityware"),
        ("sleepycat", "redistributions in any form", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
        ("cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
        ("cc-sa", "under the same license as the original", r"you must distribute your contributions under the same license as the original"),
        ("cc-nc", "use the material", r"you may not use the material for commercial purposes"),
        ("cc-nd", "remix transform", r"if you remix transform or build upon the material you may not distribute the modified material"),
        ("cc", "redistribute the material", r"copy and redistribute the material in any medium or format"),
        ("sspl-1", "functionality of the program", r"make the functionality of the program or a modified version available to third parties as a service"),
        ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
        ("commons-clause", "right to sell", r"the licen[cs]e does not grant to you the right to sell the software"),
        ("busl-1.1", "not an open source", r"business source licen[cs]e is not an open source licen[cs]e"),
        ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in ?to|to|in) the public domain"),
        ("public-domain", "public domain", r"this (?:work|file|code|program|software) is (?:hereby )?(?:in|a part of) the public domain"),
        ("us-government-work", "government", r"work of the (?:u s|united states) government (?:and )?(?:is )?not subject to copyright"),
    ],
    # A title that is all there is, for licences beyond the families.
    (3, 0.8): [
        ("apsl", "apple public", r"apple public source licen[cs]e"),
        ("blueoak", "blue oak", r"blue oak model licen[cs]e"),
        ("cern-ohl", "cern open", r"cern open hardware licen[cs]e"),
        ("cpal-1", "common public attribution", r"common public attribution licen[cs]e"),
        ("fal", "free art", r"free art licen[cs]e"),
        ("hippocratic", "hippocratic", r"hippocratic licen[cs]e"),
        ("icu", "icu", r"icu licen[cs]e icu 1 8 1 and later"),
        ("nasa-1.3", "nasa open", r"nasa open source agreement"),
        ("openrail", "rail", r"(?:creativeml|bigscience|bigcode) (?:open ?)?rail(?: [ms])?"),
        ("llama", "community license", r"llama [234](?: \d)? community license"),
        ("opl-1", "open publication", r"open publication licen[cs]e"),
        ("parity", "parity public", r"parity public licen[cs]e"),
        ("pddl-1", "domain dedication and", r"public domain dedication and licen[cs]e"),
        ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[cs]e"),
        ("qpl-1", "q public", r"q public licen[cs]e"),
        ("rpl-1.5", "reciprocal public", r"reciprocal public licen[cs]e"),
        ("watcom-1", "watcom", r"sybase open watcom public licen[cs]e"),
        ("w3c", "w3c", r"w3c (?:software|document) (?:and document )?(?:notice and )?licen[cs]e"),
        ("zend", "zend", r"zend (?:engine )?licen[cs]e"),
        ("oracle-bcl", "binary code", r"(?:oracle|sun microsystems inc) binary code licen[cs]e"),
        ("eula", "user license agreement", r"end user license agreement"),
    ],
    # Disclaimers and reservations: they tell that a licence speaks, and hardly which.
    (1, 0.5): [
        ("mit", "warranty of any kind express", r"the software is provided as is without warranty of any kind express or implied"),
        ("bsd", "any express or implied warranties", r"as is and any express or implied warranties"),
        ("bsd", "be liable for any direct", r"in no event shall (?:the )?(?:\S+ ){1,8}be liable for any direct indirect incidental special exemplary or consequential damages"),
        ("isc", "disclaims all warranties", r"the authors? disclaims all warranties with regard to this software"),
        ("gpl", "in the hope that", r"distributed in the hope that it will be useful but without any warranty"),
        ("apache-2", "on an as is basis", r"software distributed under the licen[cs]e is distributed on an as is basis"),
        ("proprietary", "strictly prohibited", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) of this (?:file|software|material|document)(?: via any medium)? is strictly prohibited"),
        ("proprietary", "confidential", r"proprietary and confidential|confidential and proprietary"),
        ("all-rights-reserved", "reserved", r"copyright (?:c )?(?:\d{4} )?(?:\S+ ){1,6}all rights reserved"),
    ],
}
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAPS = re.compile(rb" {2,}")


class Rule(NamedTuple):
    label: str
    keywords: tuple[bytes, ...]
    regex: re.Pattern
    priority: int
    certainty: float


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: the highest priority first, then as written; the first wins ties."""
    out = []
    for (priority, sure), group in SIGNATURES.items():
        out += [Rule(label, tuple(w.encode() for w in words.split("|")), re.compile(rf"\b(?:{text})\b"), priority, sure) for label, words, text in group]
    for label, word, name, identifier, address in FAMILIES:
        for kind, shape, priority, sure in SHAPES:
            text = re.sub(r"\(\?:([NIA])\)", lambda m, f={"N": name, "I": identifier, "A": address}: f"(?:{f[m[1]]})", shape)
            need = {"identifier": "spdx", "address": re.match(r"[a-z0-9]+(?: [a-z0-9]+)*", address)[0]}.get(kind, word)
            out.append(Rule(label, tuple(w.encode() for w in need.split("|")), re.compile(text), priority, sure))
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.cache
def _all_keywords() -> tuple[bytes, ...]:
    return tuple(sorted({w for r in rules() for w in r.keywords}))


def resolve(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of those of found(start, end, order, rule) that lie in no match kept before.

    Matches go by falling priority, then falling length. A tree over the starts holds the furthest end of what is
    kept, so each match is placed in logarithmic time.
    """
    starts = sorted({f[0] for f in found})
    furthest = [0] * (len(starts) + 1)
    kept = []
    for start, end, _, rule in sorted(found, key=lambda f: (-f[3].priority, f[0] - f[1], f[0], f[2])):
        at = k = bisect_left(starts, start) + 1
        reach = 0
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach >= end:
            continue
        kept.append((start, end, rule))
        while at < len(furthest):
            furthest[at] = max(furthest[at], end)
            at += at & -at
    return kept


def detections(line: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the rules' matches in words joined by one space, overlaps resolved."""
    there = {w for w in _all_keywords() if w in line}
    if not there:
        return []
    text = line.decode("utf-8", "replace")
    return resolve([(m.start(), m.end(), k, r) for k, r in enumerate(rules()) if not there.isdisjoint(r.keywords) for m in r.regex.finditer(text)])


def plain_words(text: str) -> bytes:
    """The words of a text, A-Z lower-cased, joined by one space."""
    return _GAPS.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_WORDS)).strip(b" ")


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(start word, label) of all places of the base phrases in words joined by one space."""
    out, spaced = [], b" " + line + b" "
    for phrase, label in BASE:
        needle, last, word = f" {phrase} ".encode(), 0, 0
        at = spaced.find(needle)
        while at >= 0:
            word += spaced.count(b" ", last, at)
            last = at
            out.append((word, label))
            at = spaced.find(needle, at + 1)
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. score is the certainty of the
    surest kept rule, at least 0.9 with a base phrase and 0 without any. Null and empty texts have no words,
    empty labels and the score 0; rows that repeat a doc_id and null doc_ids are scanned each; other columns
    are ignored; an empty table gives an empty result. Memory is a few times a text's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                line = plain_words(text)
                base, found = base_places(line), detections(line)
                named = {label for _, label in base}
                score = max([0.9 if base else 0.0, *(r.certainty for _, _, r in found)])
                starts = [i for i, _ in base]
                count = line.count(b" ") + 1 if line else 0
                rows.append((count, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(named | {r.label for _, _, r in found})), score))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
