"""Licence detection by ordered signature rules: regexes behind a keyword prefilter, with priority and interval containment.

A rule has a label, a priority, a regex over the lower-cased words of a text joined by single blanks, and keywords of which one must
occur before the regex is tried. Of overlapping detections, one whose interval lies inside that of a rule of no lower priority is
suppressed. The base rules (three phrases whose words stand consecutively) are never suppressed.

Defined cases: null and empty text have no words and score 0; an empty table gives no rows; repeated rows give repeated results; a
null doc_id stays null; whole texts are read, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import id_and_text, text_slices

#: Bytes that belong to words keep their place (A-Z in lower case), all others become blanks: the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: The base phrases and their labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Licence families as (label, names as they are written out in words, short identifiers in words, versions).
FAMILIES = [
    ("mit", ["mit license", "expat license"], ["mit"], []),
    ("apache", ["apache license", "apache software license"], ["apache"], ["1 0", "1 1", "2 0"]),
    ("gpl", ["general public license", "gnu gpl"], ["gpl"], ["1 0", "2 0", "3 0"]),
    ("lgpl", ["lesser general public license", "library general public license", "gnu lgpl"], ["lgpl"], ["2 0", "2 1", "3 0"]),
    ("agpl", ["affero general public license", "gnu agpl"], ["agpl"], ["1 0", "3 0"]),
    ("gfdl", ["free documentation license"], ["gfdl"], ["1 1", "1 2", "1 3"]),
    ("bsd", ["bsd license", "bsd style license", "berkeley software distribution license"], ["bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"], []),
    ("isc", ["isc license", "internet systems consortium license"], ["isc"], []),
    ("mpl", ["mozilla public license"], ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public license"], ["epl"], ["1 0", "2 0"]),
    ("edl", ["eclipse distribution license"], ["edl"], ["1 0"]),
    ("cddl", ["common development and distribution license"], ["cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public license"], ["cpl"], ["1 0"]),
    ("eupl", ["european union public licence", "european union public license"], ["eupl"], ["1 0", "1 1", "1 2"]),
    ("cecill", ["cecill license", "cecill free software license"], ["cecill"], ["1 0", "2 0", "2 1"]),
    ("artistic", ["artistic license", "perl artistic license"], ["artistic"], ["1 0", "2 0"]),
    ("zlib", ["zlib license", "zlib libpng license"], ["zlib"], []),
    ("boost", ["boost software license"], ["bsl"], ["1 0"]),
    ("unlicense", ["the unlicense"], ["unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public license"], ["wtfpl"], ["2 0"]),
    ("python", ["python software foundation license", "psf license"], ["psf", "python"], ["2 0"]),
    ("php", ["php license"], ["php"], ["3 0", "3 01"]),
    ("ruby", ["ruby license"], ["ruby"], []),
    ("ofl", ["sil open font license", "open font license"], ["ofl"], ["1 0", "1 1"]),
    ("odbl", ["open database license"], ["odbl"], ["1 0"]),
    ("pddl", ["public domain dedication and license"], ["pddl"], ["1 0"]),
    ("ms-pl", ["microsoft public license"], ["ms pl"], []),
    ("ms-rl", ["microsoft reciprocal license"], ["ms rl"], []),
    ("osl", ["open software license"], ["osl"], ["1 0", "2 0", "3 0"]),
    ("afl", ["academic free license"], ["afl"], ["1 1", "2 0", "3 0"]),
    ("ncsa", ["university of illinois ncsa open source license"], ["ncsa"], []),
    ("upl", ["universal permissive license"], ["upl"], ["1 0"]),
    ("postgresql", ["postgresql license"], ["postgresql"], []),
    ("openssl", ["openssl license"], ["openssl"], []),
    ("x11", ["x11 license", "x consortium license"], ["x11"], []),
    ("bsl", ["business source license"], ["busl"], ["1 1"]),
    ("sspl", ["server side public license"], ["sspl"], ["1 0"]),
    ("elastic", ["elastic license"], ["elastic"], ["2 0"]),
    ("commons-clause", ["commons clause"], ["commons clause"], ["1 0"]),
    ("polyform", ["polyform noncommercial license", "polyform small business license", "polyform shield license"], ["polyform"], ["1 0"]),
    ("rail", ["responsible ai license", "open rail m license"], ["openrail", "bigscience bloom rail"], ["1 0"]),
    ("llama", ["llama community license", "llama 2 community license", "llama 3 community license"], ["llama2", "llama3"], []),
]
#: Creative Commons clauses, written out and short.
CC_CLAUSES = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative|s|atives)"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|s|atives)")]
#: Label, priority, regex, keywords. Grants and disclaimers as their texts have them, in lower-cased words.
TEXTS = [
    ("mit", 90, r"permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted"]),
    ("mit", 60, r"the above copyright notice and this permission notice shall be included in all copies", ["permission notice"]),
    ("isc", 90, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["hereby granted"]),
    ("isc", 80, r"permission to use copy modify and distribute this software for any purpose with or without fee", ["without fee"]),
    ("bsd", 90, r"redistributions? and use in source and binary forms with or without modification are permitted", ["binary form"]),
    ("bsd", 70, r"redistributions in binary form must reproduce the above copyright notice", ["binary form"]),
    ("bsd", 70, r"redistributions of source code must retain the above copyright notice", ["source code"]),
    ("bsd", 60, r"neither the name of \S+(?: \S+){0,8}? nor the names of its contributors may be used to endorse", ["endorse"]),
    ("bsd", 60, r"all advertising materials mentioning features or use of this software must display", ["advertising"]),
    ("apache", 90, r"you may not use this file except in compliance with the license", ["compliance with"]),
    ("apache", 70, r"unless required by applicable law or agreed to in writing software distributed under the license", ["applicable law"]),
    ("gpl", 90, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software"]),
    ("gpl", 70, r"you should have received a copy of the gnu general public license", ["received a copy"]),
    ("lgpl", 95, r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", ["redistribute"]),
    ("lgpl", 80, r"you should have received a copy of the gnu (?:lesser|library) general public license", ["received a copy"]),
    ("agpl", 95, r"redistribute it and or modify it under the terms of the gnu affero general public license", ["redistribute"]),
    ("agpl", 80, r"you should have received a copy of the gnu affero general public license", ["received a copy"]),
    ("mpl", 90, r"this source code form is subject to the terms of the mozilla public license", ["source code form"]),
    ("mpl", 70, r"if a copy of the mpl was not distributed with this file you can obtain one at", ["mpl"]),
    ("epl", 90, r"this program and the accompanying materials are made available under the terms of the eclipse public license", ["accompanying materials"]),
    ("cddl", 90, r"the contents of this file are subject to the terms of the common development and distribution license", ["contents of this file"]),
    ("zlib", 90, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["held liable"]),
    ("zlib", 80, r"the origin of this software must not be misrepresented", ["misrepresented"]),
    ("zlib", 70, r"altered source versions must be plainly marked as such", ["altered source"]),
    ("boost", 90, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ["hereby granted"]),
    ("unlicense", 90, r"this is free and unencumbered software released into the public domain", ["unencumbered"]),
    ("unlicense", 70, r"anyone is free to copy modify publish use compile sell or distribute this software", ["anyone is free"]),
    ("wtfpl", 90, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", ["verbatim"]),
    ("artistic", 80, r"the intent of this document is to state the conditions under which a package may be copied", ["package"]),
    ("ofl", 80, r"this font software is licensed under the sil open font license", ["font software"]),
    ("openssl", 80, r"this product includes software developed by the openssl project", ["openssl"]),
    ("postgresql", 80, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", ["written agreement"]),
    ("ncsa", 80, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .{0,80}to deal with the software", ["to deal with"]),
    ("public-domain", 60, r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", ["public domain"]),
    ("public-domain", 50, r"this work is in the public domain", ["public domain"]),
    ("cc0", 90, r"(?:waived|dedicated) all copyright and related or neighboring rights", ["neighboring"]),
    ("cc0", 80, r"(?:cc0|creative commons zero|cc zero)(?: 1 0)?(?: universal)?", ["cc0", "creative commons", "cc zero"]),
    ("proprietary", 50, r"all rights reserved", ["rights reserved"]),
    ("proprietary", 60, r"proprietary and confidential", ["proprietary"]),
    ("proprietary", 60, r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|work|document)", ["unauthori"]),
    ("copyright", 20, r"copyright (?:c )?(?:19|20)\d\d", ["copyright"]),
    ("spdx", 10, r"spdx license identifier", ["spdx"]),
]
#: Further signatures, as label, priority, regex, keywords between bars: what licence texts, notices and headers say.
SIGNATURES = [
    ("mit", 70, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute", "without restriction"),
    ("mit", 55, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders"),
    ("mit", 50, r"the software is provided as is without warranty of any kind express or implied", "provided as is"),
    ("mit", 62, r"dual licensed under (?:the )?mit", "dual licensed"),
    ("mit-0", 85, r"mit no attribution(?: license)?", "no attribution"),
    ("mit-advertising", 80, r"all copies of the software or substantial portions must display acknowledg(?:e)?ment", "acknowledg"),
    ("x11", 82, r"except as contained in this notice the name of the x consortium shall not be used in advertising", "x consortium"),
    ("x11", 60, r"except as contained in this notice the names? of .{1,60} shall not be used in advertising or otherwise to promote", "shall not be used"),
    ("isc", 70, r"the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software", "disclaims"),
    ("0bsd", 88, r"bsd zero clause license", "zero clause"),
    ("0bsd", 78, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "without fee"),
    ("bsd-2-clause", 72, r"(?:the )?(?:simplified|freebsd|two clause|2 clause) bsd licen[sc]e", "bsd"),
    ("bsd-3-clause", 72, r"(?:the )?(?:modified|revised|new|three clause|3 clause) bsd licen[sc]e", "bsd"),
    ("bsd-4-clause", 72, r"(?:the )?(?:original|old|four clause|4 clause) bsd licen[sc]e", "bsd"),
    ("bsd-3-clause-clear", 84, r"no express or implied licenses to any partys? patent rights are granted by this license", "patent rights"),
    ("bsd-protection", 84, r"bsd protection license", "bsd protection"),
    ("bsd", 58, r"this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties", "provided by the"),
    ("bsd", 57, r"in no event shall the (?:copyright (?:holder|owner)|regents|author) or contributors be liable for any direct indirect incidental special", "contributors be liable"),
    ("bsd", 56, r"the regents of the university of california", "regents"),
    ("apache-1.0", 82, r"redistributions of any form whatsoever must retain the following acknowledg(?:e)?ment", "any form whatsoever"),
    ("apache-1.1", 82, r"products derived from this software may not be called apache", "may not be called"),
    ("apache-1.1", 76, r"this product includes software developed by the apache software foundation", "apache software foundation"),
    ("apache-2.0", 84, r"licensed under the apache license version 2 0 the license", "apache license"),
    ("apache-2.0", 80, r"licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements"),
    ("apache-2.0", 70, r"see the notice file distributed with this work for additional information regarding copyright ownership", "notice file"),
    ("apache-2.0", 72, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "irrevocable copyright license"),
    ("apache-2.0", 66, r"without warranties or conditions of any kind either express or implied", "warranties or conditions"),
    ("gpl", 78, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies"),
    ("gpl", 68, r"this program is distributed in the hope that it will be useful but without any warranty", "in the hope"),
    ("gpl", 66, r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "general public license"),
    ("gpl", 64, r"write to the free software foundation inc", "free software foundation"),
    ("gpl-2.0-only", 86, r"under the terms of the gnu general public license version 2 as published by the free software foundation", "version 2 as published"),
    ("gpl-2.0-only", 80, r"(?:licensed|released) under (?:the )?gpl ?v?2 only", "only"),
    ("gpl-2.0-or-later", 86, r"either version 2 of the license or at your option any later version", "either version 2"),
    ("gpl-3.0-or-later", 86, r"either version 3 of the license or at your option any later version", "either version 3"),
    ("gpl-3.0-only", 84, r"under the terms of the gnu general public license version 3 as published by the free software foundation", "version 3 as published"),
    ("gpl-with-classpath-exception", 92, r"as a special exception the copyright holders of this library give you permission to link this library", "special exception"),
    ("gpl-with-classpath-exception", 80, r"classpath exception", "classpath exception"),
    ("gpl-with-gcc-exception", 84, r"gcc runtime library exception", "runtime library exception"),
    ("gpl-with-autoconf-exception", 84, r"autoconf (?:configure )?(?:script )?exception", "autoconf"),
    ("gpl-with-bison-exception", 84, r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser"),
    ("gpl-with-font-exception", 84, r"if you create a document which uses this font and embed this font", "embed this font"),
    ("gpl-with-openssl-exception", 84, r"permission to link (?:the code of portions of )?this program with the openssl library", "openssl library"),
    ("linux-syscall-note", 84, r"this copyright does not cover user programs that use kernel services by normal system calls", "system calls"),
    ("lgpl-2.1-or-later", 86, r"either version 2 1 of the license or at your option any later version", "either version 2 1"),
    ("lgpl", 72, r"this library is free software you can redistribute it and or modify it", "this library is free"),
    ("lgpl", 70, r"a program that contains no derivative of any portion of the library but is designed to work with the library", "derivative of any portion"),
    ("agpl", 84, r"if you modify the program your modified version must prominently offer all users interacting with it remotely", "interacting with it remotely"),
    ("agpl", 70, r"gnu affero general public license(?: version 3)?", "affero"),
    ("gfdl", 88, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation license"),
    ("gfdl", 76, r"with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("gfdl", 70, r"with no invariant sections(?: and)? no front cover texts", "front cover"),
    ("mpl-1.1", 86, r"the contents of this file are subject to the mozilla public license version 1 1", "mozilla public license"),
    ("mpl-1.1", 76, r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied", "as is basis"),
    ("mpl-2.0", 86, r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", "secondary licenses"),
    ("mpl-2.0", 70, r"mozilla org mpl 2 0", "mozilla"),
    ("npl", 84, r"netscape public license", "netscape"),
    ("epl-1.0", 82, r"made available under the terms of the eclipse public license v1 0", "eclipse public license"),
    ("epl-2.0", 82, r"made available under the terms of the eclipse public license (?:v )?2 0", "eclipse public license"),
    ("epl", 66, r"this source code may also be made available under the following secondary licenses", "secondary licenses"),
    ("cpl", 84, r"made available under the terms of the common public license v1 0", "common public license"),
    ("ipl", 84, r"ibm public license(?: version)?(?: 1 0)?", "ibm public license"),
    ("cddl", 78, r"you can obtain a copy of the license at (?:usr src )?opensolaris license", "opensolaris"),
    ("cddl", 76, r"cddl header start", "cddl header"),
    ("spl", 82, r"sun public license(?: version)?(?: 1 0)?", "sun public license"),
    ("sissl", 82, r"sun industry standards source license", "sun industry standards"),
    ("apsl", 84, r"apple public source license(?: version)?(?: \d \d)?", "apple public source"),
    ("rpsl", 82, r"realnetworks public source license", "realnetworks"),
    ("qpl", 82, r"q public license(?: version)?(?: 1 0)?", "q public license"),
    ("lppl", 84, r"latex project public license", "latex project"),
    ("lppl", 80, r"this work may be distributed and or modified under the conditions of the latex project public license", "latex project"),
    ("opl", 80, r"open publication license(?: v)?(?: ?1 0)?", "open publication"),
    ("oclc", 80, r"oclc research public license", "oclc"),
    ("ecl", 82, r"educational community license(?: version)?(?: \d \d)?", "educational community"),
    ("naumen", 82, r"naumen public license", "naumen"),
    ("nosa", 82, r"nasa open source agreement", "nasa open source"),
    ("nokia", 82, r"nokia open source license", "nokia open source"),
    ("lucent", 82, r"lucent public license", "lucent public"),
    ("motosoto", 82, r"motosoto open source license", "motosoto"),
    ("intel", 78, r"intel open source license", "intel open source"),
    ("sybase", 80, r"sybase open watcom public license", "open watcom"),
    ("vovida", 80, r"vovida software license", "vovida"),
    ("w3c", 84, r"w3c software (?:and document )?(?:notice and )?license", "w3c"),
    ("w3c", 76, r"permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted", "fee or royalty"),
    ("zpl", 84, r"zope public license(?: version)?(?: \d \d)?", "zope public"),
    ("zlib", 78, r"permission is granted to anyone to use this software for any purpose including commercial applications", "commercial applications"),
    ("libpng", 84, r"the png reference library is supplied as is", "png reference library"),
    ("libpng", 78, r"libpng license", "libpng"),
    ("ijg", 84, r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("freetype", 84, r"(?:the )?freetype (?:project )?license", "freetype"),
    ("freetype", 80, r"portions of this software are copyright .{0,30}the freetype project", "freetype project"),
    ("imagemagick", 82, r"imagemagick (?:studio )?license", "imagemagick"),
    ("curl", 80, r"curl license", "curl license"),
    ("bzip2", 80, r"(?:this program )?bzip2 (?:and associated library libbzip2|license)", "bzip2"),
    ("info-zip", 82, r"info zip license", "info zip"),
    ("info-zip", 76, r"for the purposes of this copyright and license info zip is defined as", "info zip"),
    ("tcl", 82, r"tcl tk license", "tcl tk"),
    ("tcl", 74, r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "authors hereby grant"),
    ("ntp", 80, r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "with or without fee"),
    ("hpnd", 80, r"historical permission notice and disclaimer", "historical permission"),
    ("sleepycat", 84, r"redistributions in any form must be accompanied by information on how to obtain complete source code", "complete source code"),
    ("sleepycat", 80, r"sleepycat (?:public )?license", "sleepycat"),
    ("sgi-b", 82, r"sgi free software license b", "sgi free"),
    ("unicode", 84, r"unicode inc license agreement data files and software", "unicode inc"),
    ("unicode", 80, r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files"),
    ("icu", 82, r"icu license", "icu license"),
    ("json", 90, r"the software shall be used for good not evil", "good not evil"),
    ("beerware", 88, r"the beer ?ware license", "beer"),
    ("beerware", 82, r"if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer"),
    ("wtfpl", 80, r"you just do what the fuck you want to", "what the fuck"),
    ("unlicense", 74, r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "copyright interest"),
    ("unlicense", 66, r"for more information please refer to (?:http|https)? ?unlicense org", "unlicense"),
    ("cc0", 86, r"the person who associated a work with this deed has dedicated the work to the public domain", "this deed"),
    ("cc0", 82, r"to the extent possible under law .{1,80}(?:has|have) waived all copyright", "to the extent possible"),
    ("cc0", 76, r"creativecommons org publicdomain zero 1 0", "publicdomain zero"),
    ("cc-by", 78, r"this (?:work|document|article) is licensed under (?:a|the) creative commons attribution", "creative commons attribution"),
    ("cc", 60, r"some rights reserved", "some rights reserved"),
    ("cc", 58, r"licensed under (?:a |the )?creative commons", "creative commons"),
    ("cc-sampling", 80, r"creative commons (?:noncommercial )?sampling plus", "sampling plus"),
    ("cc-developing-nations", 80, r"creative commons developing nations", "developing nations"),
    ("free-art", 84, r"free art license(?: 1 \d)?", "free art"),
    ("against-drm", 82, r"against drm license", "against drm"),
    ("odc-by", 82, r"open data commons attribution license", "open data commons"),
    ("odbl", 78, r"this .{1,40}is made available under the open database license", "open database license"),
    ("ogl-uk", 84, r"contains public sector information licensed under the open government licence(?: v\d 0)?", "open government"),
    ("ogl-uk", 78, r"open government licen[sc]e(?: v\d 0)?", "open government"),
    ("etalab", 82, r"licence ouverte(?: open licence)?(?: version \d \d)?", "licence ouverte"),
    ("dl-de", 82, r"datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?", "datenlizenz"),
    ("cdla", 84, r"community data license agreement (?:permissive|sharing)", "community data license"),
    ("cdla", 76, r"cdla (?:permissive|sharing)(?: \d \d)?", "cdla"),
    ("ofl", 86, r"copyright .{1,80}with reserved font name", "reserved font name"),
    ("ofl", 78, r"this license is copied below and is also available with a faq at", "available with a faq"),
    ("bitstream-vera", 84, r"bitstream vera is a trademark of bitstream", "bitstream vera"),
    ("ubuntu-font", 84, r"ubuntu font licen[sc]e(?: version)?(?: 1 0)?", "ubuntu font"),
    ("arphic", 82, r"arphic public license", "arphic"),
    ("ipa-font", 82, r"ipa font license agreement", "ipa font"),
    ("artistic-2.0", 84, r"the artistic license 2 0", "artistic license"),
    ("artistic", 76, r"same terms as perl(?: itself)?", "same terms as perl"),
    ("perl", 74, r"this (?:library|module|program) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl", "same terms as perl"),
    ("ruby", 80, r"you may redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", "either the terms"),
    ("php-3.01", 82, r"this product includes php software freely available from", "php software"),
    ("php", 78, r"this source file is subject to version 3 0?1? of the php license", "php license"),
    ("python", 82, r"psf hereby grants licensee a nonexclusive royalty free world wide license", "psf hereby"),
    ("python", 74, r"beopen python open source license agreement", "beopen"),
    ("cnri-python", 82, r"cnri (?:open source )?(?:python )?license agreement", "cnri"),
    ("postgresql", 74, r"in no event shall the university of california be liable to any party for direct indirect special incidental", "university of california"),
    ("openssl", 84, r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment this product includes software developed by the openssl project", "openssl project"),
    ("ssleay", 82, r"this product includes cryptographic software written by eric young", "cryptographic software"),
    ("boost", 80, r"distributed under the boost software license version 1 0", "boost software"),
    ("boost", 74, r"unless such copies or derivative works are solely in the form of machine executable object code", "machine executable"),
    ("ms-pl", 80, r"this license governs use of the accompanying software if you use the software you accept this license", "license governs use"),
    ("ms-limited", 80, r"microsoft limited (?:public|reciprocal) license", "microsoft limited"),
    ("ms-eula", 70, r"microsoft software license terms", "microsoft software license"),
    ("eupl", 84, r"licensed under the eupl(?: version)?(?: ?1 [012])?", "eupl"),
    ("cecill-b", 84, r"cecill b(?: free software license agreement)?", "cecill b"),
    ("cecill-c", 84, r"cecill c(?: free software license agreement)?", "cecill c"),
    ("cecill", 80, r"this software is governed by the cecill(?: [bc])? license under french law", "french law"),
    ("mulan", 84, r"mulan (?:psl|permissive software license) ?v?[12]?", "mulan"),
    ("upl", 82, r"the universal permissive license upl version 1 0", "universal permissive"),
    ("blueoak", 86, r"blue oak model license(?: 1 0 0)?", "blue oak"),
    ("parity", 82, r"parity public license", "parity public"),
    ("cpal", 82, r"common public attribution license", "public attribution"),
    ("osl", 80, r"licensed under the open software license version \d 0", "open software license"),
    ("rpl", 82, r"reciprocal public license(?: \d \d)?", "reciprocal public"),
    ("simpl", 80, r"simple public license", "simple public license"),
    ("sspl", 86, r"server side public license version 1 as published by mongodb", "server side public"),
    ("bsl", 84, r"business source license 1 1", "business source"),
    ("bsl", 78, r"change date .{0,40}change license", "change license"),
    ("elastic-2.0", 84, r"you may not provide the software to third parties as a hosted or managed service", "managed service"),
    ("confluent", 82, r"confluent community license", "confluent community"),
    ("redis-sal", 82, r"redis source available license", "source available"),
    ("timescale", 80, r"timescale license", "timescale"),
    ("prosperity", 82, r"prosperity public license", "prosperity"),
    ("polyform", 80, r"polyform (?:noncommercial|strict|shield|small business|perimeter|internal use|free trial) license 1 0 0", "polyform"),
    ("hippocratic", 84, r"hippocratic license(?: \d \d)?", "hippocratic"),
    ("anti-996", 84, r"anti 996 license", "anti 996"),
    ("llama", 82, r"llama (?:\d )?community license agreement", "llama"),
    ("gemma", 80, r"gemma terms of use", "gemma"),
    ("openrail", 84, r"creativeml open rail m license", "open rail"),
    ("openrail", 78, r"use based restrictions as referenced in paragraph 5", "use based restrictions"),
    ("nvidia", 76, r"nvidia (?:source code|software) license", "nvidia"),
    ("research-only", 66, r"for (?:non commercial )?research purposes only", "research purposes"),
    ("non-commercial", 64, r"for (?:personal and )?non ?commercial use only", "commercial use only"),
    ("non-commercial", 62, r"may not be used for commercial purposes", "commercial purposes"),
    ("no-derivatives", 60, r"no derivative works", "derivative works"),
    ("freeware", 60, r"this (?:software|program) is freeware", "freeware"),
    ("shareware", 60, r"this (?:software|program) is shareware", "shareware"),
    ("evaluation", 60, r"for evaluation purposes only", "evaluation purposes"),
    ("commercial", 62, r"this is commercial software", "commercial software"),
    ("proprietary", 64, r"this (?:software|document|file) contains (?:confidential|proprietary) (?:and proprietary )?information", "confidential|proprietary"),
    ("proprietary", 62, r"trade secrets? of", "trade secret"),
    ("proprietary", 62, r"no part of this (?:publication|work|document|book) may be reproduced", "may be reproduced"),
    ("proprietary", 60, r"do not (?:copy|distribute|redistribute) without (?:prior )?(?:written )?permission", "without prior|without permission|without written"),
    ("eula", 62, r"end user license agreement", "end user license"),
    ("public-domain", 66, r"(?:the )?authors? (?:hereby )?disclaims? copyright to this source code", "disclaim"),
    ("public-domain", 62, r"no copyright is claimed", "no copyright"),
    ("public-domain", 60, r"works? of the united states government", "united states government"),
    ("attribution", 50, r"must (?:give|retain) (?:appropriate )?(?:credit|attribution)", "credit|attribution"),
    ("copyright", 22, r"all (?:other )?trademarks are the property of their respective owners", "respective owners"),
    ("copyright", 21, r"\d{4} by the (?:author|authors|contributors)", "by the author|by the contributors"),
    ("license-file", 30, r"see (?:the )?(?:accompanying )?licen[sc]e(?: txt| md)?(?: file)? for (?:details|more information|the full)", "see license|see licence|the license|the licence|accompanying licen"),
    ("license-file", 28, r"use of this source code is governed by an? .{0,20}license that can be found in the license file", "governed by"),
]
#: What stands before a licence's name in a grant.
GRANTS = ["licensed under", "released under", "distributed under", "available under", "covered by", "published under", "subject to", "provided under", "under the terms of", "governed by"]
URLS = [("apache", "apache org licenses"), ("gpl", "gnu org licenses gpl"), ("lgpl", "gnu org licenses lgpl"), ("agpl", "gnu org licenses agpl"), ("mpl", "mozilla org mpl"), ("mit", "opensource org licenses mit"), ("bsd", "opensource org licenses bsd"), ("isc", "opensource org licenses isc"), ("cc", "creativecommons org licenses"), ("cc0", "creativecommons org publicdomain"), ("epl", "eclipse org legal epl"), ("boost", "boost org license"), ("unlicense", "unlicense org"), ("zlib", "zlib net zlib license")]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str
    keywords: tuple[str, ...]


def rules() -> list[Rule]:
    """All rules, by falling priority: texts first, then grants, names with versions, identifiers and addresses of each family."""
    out = [Rule(label, p, regex, tuple(keys)) for label, p, regex, keys in TEXTS] + [Rule(label, p, regex, tuple(keys.split("|"))) for label, p, regex, keys in SIGNATURES]
    grant = "(?:" + "|".join(GRANTS) + ")"
    for label, names, short, versions in FAMILIES:
        version = f"(?: (?:version|v))? ?v?(?:{'|'.join(v + '|' + v.removesuffix(' 0') for v in versions)})" if versions else None
        for name in names:
            out.append(Rule(label, 75, rf"{grant} (?:the |an? )?(?:gnu )?{name}", (name,)))
            out.append(Rule(label, 45, name, (name,)))
            if version:
                out.append(Rule(f"{label}-versioned", 55, rf"{name}{version}(?: or (?:any )?later)?(?: only)?", (name,)))
        for word in short:
            out.append(Rule(label, 65, rf"spdx license identifier {word}", ("spdx",)))
            out.append(Rule(label, 64, rf"{grant} (?:the |an? )?{word}(?: licen[sc]e)?", (word,)))
            if version:
                out.append(Rule(f"{label}-versioned", 66, rf"{grant} (?:the |an? )?{word}{version}(?: only| or later)?", (word,)))
    for label, words in CC_CLAUSES:
        short = label.replace("-", " ")
        out.append(Rule(f"cc-{label}", 70, rf"cc {short}(?: \d \d)?(?: international| unported)?", ("cc by",)))
        out.append(Rule(f"cc-{label}", 72, rf"creative commons {words}(?: \d \d)?(?: international| unported)?(?: licen[sc]e)?", ("creative commons",)))
        out.append(Rule(f"cc-{label}", 74, rf"creativecommons org licenses {short}", ("creativecommons",)))
    out += [Rule(label, 58, url, (url.split(" ")[0],)) for label, url in URLS]
    return sorted(out, key=lambda r: (-r.priority, -len(r.pattern), r.label))


class Scanner:
    def __init__(self, ordered: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if ordered is None else ordered
        self.regexes = [re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])") for r in self.rules]
        self.gate = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                of.setdefault(k, []).append(i)
        for k, v in of.items():
            self.gate.add_word(k, v)
        self.gate.make_automaton()

    def detect(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, priority) in a text of words joined by single blanks, suppressed ones left out, by place."""
        tried = sorted({i for _, v in self.gate.iter(text) for i in v})
        kept: list[tuple[int, int, str, int]] = []
        inside = Outermost()
        for i in tried:  # by falling priority
            for m in self.regexes[i].finditer(text):
                if inside.add(*m.span()):
                    kept.append((*m.span(), self.rules[i].label, self.rules[i].priority))
        return sorted(kept)


class Outermost:
    """Intervals of which none contains another, by starts and so by ends."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """False if one contains the new interval; else it is added, and those that it contains go."""
        i = bisect_right(self.starts, start)
        if i and self.ends[i - 1] >= end:
            return False
        lo = i - 1 if i and self.starts[i - 1] == start else i
        hi = bisect_right(self.ends, end, lo)
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]
        return True


def base_places(words: bytes) -> list[tuple[int, str]]:
    """The byte offsets of all places where a base phrase's words stand consecutively, in words joined by single blanks."""
    out = []
    for phrase, label in BASE.items():
        at = words.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
                out.append((at, label))
            at = words.find(phrase, at + 1)
    return sorted(out)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first_word:long,last_word:long,label:string,priority:int>>"
_DETECTION = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", _DETECTION)])


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: its words, base places and labels, all labels, score and detections in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()

        def row(key: int, text: str) -> tuple:
            split = text.encode().translate(WORD_BYTES).split()
            words = b" ".join(split)
            base = base_places(words)
            line = words.decode()
            spans = scanner.detect(line)
            starts, found = [], []
            if base:
                places = [0, *accumulate(len(w) + 1 for w in split)]  # where words start, in bytes
                starts = [bisect_left(places, a) for a, _ in base]
            if spans:
                places = [0, *accumulate(len(w) + 1 for w in line.split(" "))]
                found = [(bisect_right(places, a) - 1, bisect_right(places, e - 1) - 1, label, p) for a, e, label, p in spans]
            base_labels = sorted({x for _, x in base})
            labels = sorted({*base_labels, *(x[2] for x in found)})
            score = max([0.0, *(min(0.99, x[3] / 100) for x in found), *(0.9 for _ in base[:1])])
            return key, len(split), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), score, [dict(zip(("first_word", "last_word", "label", "priority"), x, strict=True)) for x in found]

        for keys, texts in text_slices(batches):
            rows = [row(k, t) for k, t in zip(keys, texts, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
