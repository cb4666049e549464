"""Signature rules for license scans, written by hand: (label, keyword, pattern, priority, confidence), in order.

Patterns run over words in lower case with single spaces between them, so "GPL-3.0+" reads `gpl 3 0`, and match whole
words. A rule is tried only if its keyword begins a word of the text. Priorities: 0 identifiers, 1 names with a version and notices,
2 sentences of license texts, 3 bare names.
"""

from __future__ import annotations

HAND = [
    # identifiers
    ("apache-2.0", "spdx", "spdx license identifier apache 2 0", 0, 1.0),
    ("apache-1.1", "spdx", "spdx license identifier apache 1 1", 0, 1.0),
    ("apache-1.0", "spdx", "spdx license identifier apache 1 0", 0, 1.0),
    ("mit", "spdx", "spdx license identifier mit", 0, 1.0),
    ("mit-0", "spdx", "spdx license identifier mit 0", 0, 1.0),
    ("x11", "spdx", "spdx license identifier x11", 0, 1.0),
    ("isc", "spdx", "spdx license identifier isc", 0, 1.0),
    ("0bsd", "spdx", "spdx license identifier 0bsd", 0, 1.0),
    ("bsd-2-clause", "spdx", "spdx license identifier bsd 2 clause(?: patent| views)?", 0, 1.0),
    ("bsd-3-clause", "spdx", "spdx license identifier bsd 3 clause(?: clear| lbnl)?", 0, 1.0),
    ("bsd-4-clause", "spdx", "spdx license identifier bsd 4 clause(?: uc)?", 0, 1.0),
    ("gpl-1.0", "spdx", "spdx license identifier gpl 1 0(?: only| or later)?", 0, 1.0),
    ("gpl-2.0", "spdx", "spdx license identifier gpl 2 0(?: only| or later)?", 0, 1.0),
    ("gpl-3.0", "spdx", "spdx license identifier gpl 3 0(?: only| or later)?", 0, 1.0),
    ("lgpl-2.0", "spdx", "spdx license identifier lgpl 2 0(?: only| or later)?", 0, 1.0),
    ("lgpl-2.1", "spdx", "spdx license identifier lgpl 2 1(?: only| or later)?", 0, 1.0),
    ("lgpl-3.0", "spdx", "spdx license identifier lgpl 3 0(?: only| or later)?", 0, 1.0),
    ("agpl-3.0", "spdx", "spdx license identifier agpl 3 0(?: only| or later)?", 0, 1.0),
    ("gfdl-1.3", "spdx", "spdx license identifier gfdl 1 3(?: no invariants)?(?: only| or later)?", 0, 1.0),
    ("mpl-2.0", "spdx", "spdx license identifier mpl 2 0(?: no copyleft exception)?", 0, 1.0),
    ("mpl-1.1", "spdx", "spdx license identifier mpl 1 1", 0, 1.0),
    ("epl-1.0", "spdx", "spdx license identifier epl 1 0", 0, 1.0),
    ("epl-2.0", "spdx", "spdx license identifier epl 2 0", 0, 1.0),
    ("cddl-1.0", "spdx", "spdx license identifier cddl 1 0", 0, 1.0),
    ("cddl-1.1", "spdx", "spdx license identifier cddl 1 1", 0, 1.0),
    ("eupl-1.2", "spdx", "spdx license identifier eupl 1 2", 0, 1.0),
    ("bsl-1.0", "spdx", "spdx license identifier bsl 1 0", 0, 1.0),
    ("busl-1.1", "spdx", "spdx license identifier busl 1 1", 0, 1.0),
    ("artistic-2.0", "spdx", "spdx license identifier artistic 2 0", 0, 1.0),
    ("zlib", "spdx", "spdx license identifier zlib(?: acknowledgement)?", 0, 1.0),
    ("unlicense", "spdx", "spdx license identifier unlicense", 0, 1.0),
    ("cc0-1.0", "spdx", "spdx license identifier cc0 1 0", 0, 1.0),
    ("cc-by-4.0", "spdx", "spdx license identifier cc by 4 0", 0, 1.0),
    ("cc-by-sa-4.0", "spdx", "spdx license identifier cc by sa 4 0", 0, 1.0),
    ("ofl-1.1", "spdx", "spdx license identifier ofl 1 1(?: no)?(?: rfn)?", 0, 1.0),
    ("wtfpl", "spdx", "spdx license identifier wtfpl", 0, 1.0),
    ("postgresql", "spdx", "spdx license identifier postgresql", 0, 1.0),
    ("python-2.0", "spdx", "spdx license identifier (?:python|psf) 2 0", 0, 1.0),
    ("odbl-1.0", "spdx", "spdx license identifier odbl 1 0", 0, 1.0),
    ("mulanpsl-2.0", "spdx", "spdx license identifier mulanpsl 2 0", 0, 1.0),
    # apache
    ("apache-2.0", "apache", "(?:the )?apache (?:software )?licen[sc]e(?: v| version)? ?2(?: 0)?", 1, 0.95),
    ("apache-2.0", "apache", "(?:the )?apache 2(?: 0)? licen[sc]ed?", 1, 0.92),
    ("apache-2.0", "licensed under the apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1, 0.99),
    ("apache-2.0", "www apache org", "www apache org licenses license 2 0", 1, 0.95),
    ("apache-1.1", "apache", "(?:the )?apache software license(?: v| version)? ?1 1", 1, 0.95),
    ("apache-1.0", "apache", "(?:the )?apache (?:group )?license(?: v| version)? ?1 0", 1, 0.95),
    ("apache-1.1", "this product includes", "this product includes software developed by the apache software foundation", 2, 0.8),
    ("apache-2.0", "each contributor hereby", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 2, 0.85),
    ("apache", "apache", "(?:the )?apache (?:software )?licen[sc]es?", 3, 0.8),
    ("apache", "asl", "asl 2(?: 0)? licen[sc]e", 3, 0.7),
    # mit and its kin
    ("mit", "mit", "(?:released|distributed|available|published|licen[sc]ed)(?: [^ ]+){0,3} under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e", 1, 0.98),
    ("mit", "mit", "(?:the )?mit licen[sc]ed?", 3, 0.8),
    ("mit", "mit", "mit style licen[sc]e", 3, 0.7),
    ("mit", "expat", "(?:the )?expat licen[sc]e", 3, 0.75),
    ("mit", "opensource org", "opensource org licenses mit(?: license)?", 1, 0.95),
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 2, 0.85),
    ("mit", "the above copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.85),
    ("mit", "the software is", "the software is provided as is without warranty of any kind", 2, 0.85),
    ("mit-0", "mit", "mit no attribution licen[sc]e", 1, 0.95),
    ("x11", "x11", "(?:the )?x11 licen[sc]e", 3, 0.8),
    ("x11", "except as contained", "except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising", 2, 0.85),
    ("jpnic", "japan network", "japan network information center license", 3, 0.7),
    ("icu", "icu", "icu license(?: 1 8 1)?", 3, 0.75),
    # isc, zlib, boost and other short ones
    ("isc", "isc", "(?:released|distributed|available|published|licen[sc]ed)(?: [^ ]+){0,3} under (?:the )?isc licen[sc]e", 1, 0.98),
    ("isc", "isc", "(?:the )?isc licen[sc]ed?", 3, 0.8),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 2, 0.85),
    ("0bsd", "bsd", "bsd zero clause licen[sc]e", 1, 0.95),
    ("0bsd", "zero clause", "zero clause bsd licen[sc]e", 1, 0.95),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[sc]e", 3, 0.8),
    ("zlib", "altered source", "altered source versions must be plainly marked as such", 2, 0.85),
    ("zlib", "the origin of this", "the origin of this software must not be misrepresented", 2, 0.85),
    ("libpng", "libpng", "(?:the )?(?:png reference library|libpng) licen[sc]e", 3, 0.8),
    ("bsl-1.0", "boost", "(?:the )?boost software licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.95),
    ("bsl-1.0", "www boost org", "www boost org license 1 0 txt", 1, 0.95),
    ("curl", "curl", "(?:the )?curl licen[sc]e", 3, 0.75),
    ("openssl", "openssl", "(?:the )?openssl(?: and ssleay)? licen[sc]e", 3, 0.8),
    ("openssl", "this product includes", "this product includes software developed by the openssl project", 2, 0.85),
    ("ssleay", "this product includes", "this product includes cryptographic software written by eric young", 2, 0.85),
    ("ssleay", "ssleay", "(?:the )?original ssleay licen[sc]e", 3, 0.8),
    ("ncsa", "university of illinois", "(?:the )?university of illinois ncsa open source licen[sc]e", 1, 0.95),
    ("ncsa", "ncsa", "ncsa (?:open source )?licen[sc]e", 3, 0.8),
    ("postgresql", "postgresql", "(?:the )?postgresql licen[sc]e", 3, 0.8),
    ("unicode", "unicode", "unicode (?:inc )?licen[sc]e(?: agreement)?", 3, 0.75),
    ("beerware", "beer", "beer ?ware licen[sc]e", 3, 0.8),
    ("beerware", "the beer", "the beer ?ware license revision 42", 1, 0.95),
    ("wtfpl", "do what the", "do what the f[^ ]+ you want to public licen[sc]e", 1, 0.95),
    ("wtfpl", "wtfpl", "wtfpl licen[sc]e", 3, 0.8),
    ("json", "the software shall", "the software shall be used for good not evil", 2, 0.85),
    ("fair", "fair", "(?:the )?fair license", 3, 0.6),
    ("vim", "vim", "(?:the )?vim licen[sc]e", 3, 0.75),
    ("tcl", "tcl", "(?:the )?tcl tk licen[sc]e", 3, 0.75),
    ("ijg", "this software is based", "this software is based in part on the work of the independent jpeg group", 2, 0.8),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?licen[sc]e", 3, 0.8),
    ("info-zip", "info zip", "(?:the )?info zip licen[sc]e", 3, 0.8),
    ("bzip2", "bzip2", "bzip2 (?:and libbzip2 )?licen[sc]e", 3, 0.75),
    ("mulanpsl-2.0", "mulan", "mulan (?:permissive software )?licen[sc]e(?: v| version)? ?2", 1, 0.9),
    ("afl-3.0", "academic free", "academic free licen[sc]e(?: v| version)?(?: 3 0)?", 1, 0.95),
    ("osl-3.0", "open software", "open software licen[sc]e(?: v| version)?(?: 3 0)?", 1, 0.95),
    ("ecl-2.0", "educational community", "educational community licen[sc]e(?: v| version)?(?: 2 0)?", 1, 0.95),
    ("upl-1.0", "universal permissive", "universal permissive licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.95),
    # bsd
    ("bsd-2-clause", "bsd", "(?:the )?(?:simplified|freebsd|bsd 2 clause|2 clause bsd) licen[sc]e", 3, 0.8),
    ("bsd-2-clause", "simplified bsd", "simplified bsd licen[sc]e", 1, 0.95),
    ("bsd-2-clause", "two clause", "two clause bsd licen[sc]e", 1, 0.95),
    ("bsd-2-clause", "2 clause", "2 clause bsd licen[sc]e", 1, 0.95),
    ("bsd-3-clause", "bsd", "(?:the )?bsd 3 clause(?: new| revised)? licen[sc]e", 1, 0.95),
    ("bsd-3-clause", "3 clause", "3 clause bsd licen[sc]e", 1, 0.95),
    ("bsd-3-clause", "three clause", "three clause bsd licen[sc]e", 1, 0.95),
    ("bsd-3-clause", "new bsd", "new bsd licen[sc]e", 1, 0.95),
    ("bsd-3-clause", "modified bsd", "modified bsd licen[sc]e", 1, 0.9),
    ("bsd-3-clause", "revised bsd", "revised bsd licen[sc]e", 1, 0.9),
    ("bsd-3-clause", "neither the name", "neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse", 2, 0.85),
    ("bsd-4-clause", "bsd", "(?:the )?bsd 4 clause licen[sc]e", 1, 0.95),
    ("bsd-4-clause", "original bsd", "original bsd licen[sc]e", 1, 0.9),
    ("bsd-4-clause", "all advertising", "all advertising materials mentioning features or use of this software must display", 2, 0.85),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 2, 0.85),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.85),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 2, 0.85),
    ("bsd", "bsd", "(?:the )?bsd(?: style)? licen[sc]ed?", 3, 0.75),
    ("bsd", "berkeley", "berkeley software distribution licen[sc]e", 3, 0.8),
    # gnu
    ("gpl-3.0", "gnu general", "(?:the )?gnu general public licen[sc]e(?: gpl)?(?: v| version)? ?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?", 1, 0.95),
    ("gpl-2.0", "gnu general", "(?:the )?gnu general public licen[sc]e(?: gpl)?(?: v| version)? ?2(?: 0)?(?: only| or (?:any )?later(?: version)?)?", 1, 0.95),
    ("gpl-1.0", "gnu general", "(?:the )?gnu general public licen[sc]e(?: gpl)?(?: v| version)? ?1(?: 0)?(?: only| or (?:any )?later(?: version)?)?", 1, 0.95),
    ("gpl-3.0", "gnu gpl", "(?:the )?gnu gpl(?: v| version)? ?3(?: 0)? licen[sc]e", 1, 0.92),
    ("gpl-2.0", "gnu gpl", "(?:the )?gnu gpl(?: v| version)? ?2(?: 0)? licen[sc]e", 1, 0.92),
    ("gpl-3.0", "gplv3", "gplv3(?: only| or later)? licen[sc]e", 1, 0.9),
    ("gpl-2.0", "gplv2", "gplv2(?: only| or later)? licen[sc]e", 1, 0.9),
    ("gpl-3.0", "licens", "licens(?:e|ed) (?:under )?(?:the )?(?:gpl ?v?3(?: 0)?|gplv3)(?: only| or later)?", 1, 0.9),
    ("gpl-2.0", "licens", "licens(?:e|ed) (?:under )?(?:the )?(?:gpl ?v?2(?: 0)?|gplv2)(?: only| or later)?", 1, 0.9),
    ("gpl", "under the terms", "under the terms of the gnu general public licen[sc]e as published by the free software foundation", 2, 0.85),
    ("gpl-2.0", "under the terms", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 1, 0.98),
    ("gpl-3.0", "under the terms", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1, 0.98),
    ("gpl", "version", "version [123] of the licen[sc]e or at your option any later version", 2, 0.8),
    ("gpl", "you should have received", "you should have received a copy of the gnu general public licen[sc]e along with this program", 2, 0.85),
    ("gpl", "gnu org", "gnu org licenses gpl(?: [123] 0)?(?: html| txt)?", 1, 0.9),
    ("gpl", "gnu general", "(?:the )?gnu general public licen[sc]es?", 3, 0.8),
    ("gpl", "general public", "general public licen[sc]e", 3, 0.7),
    ("gpl", "gpl", "gpl licen[sc]ed?", 3, 0.75),
    ("gpl-classpath", "classpath", "(?:gnu )?classpath exception(?: to the gpl)? licen[sc]e", 1, 0.9),
    ("gpl-classpath", "as a special exception", "as a special exception the copyright holders of this library give you permission to link this library", 2, 0.85),
    ("lgpl-3.0", "gnu lesser", "(?:the )?gnu lesser general public licen[sc]e(?: lgpl)?(?: v| version)? ?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?", 1, 0.95),
    ("lgpl-2.1", "gnu lesser", "(?:the )?gnu lesser general public licen[sc]e(?: lgpl)?(?: v| version)? ?2 1(?: only| or (?:any )?later(?: version)?)?", 1, 0.95),
    ("lgpl-2.0", "gnu library", "(?:the )?gnu library general public licen[sc]e(?: lgpl)?(?: v| version)? ?2(?: 0)?(?: only| or (?:any )?later(?: version)?)?", 1, 0.95),
    ("lgpl", "under the terms", "under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation", 2, 0.85),
    ("lgpl", "gnu lesser", "(?:the )?gnu lesser general public licen[sc]es?", 3, 0.8),
    ("lgpl", "gnu library", "(?:the )?gnu library general public licen[sc]es?", 3, 0.8),
    ("lgpl", "lesser general", "lesser general public licen[sc]e", 3, 0.7),
    ("lgpl", "lgpl", "lgpl(?: ?v?[23](?: [01])?)? licen[sc]ed?", 3, 0.75),
    ("lgpl", "you should have received", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library", 2, 0.85),
    ("agpl-3.0", "gnu affero", "(?:the )?gnu affero general public licen[sc]e(?: agpl)?(?: v| version)? ?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?", 1, 0.95),
    ("agpl-1.0", "affero", "(?:the )?affero general public licen[sc]e(?: v| version)? ?1(?: 0)?", 1, 0.95),
    ("agpl", "gnu affero", "(?:the )?gnu affero general public licen[sc]es?", 3, 0.8),
    ("agpl", "agpl", "agpl(?: ?v?3(?: 0)?)? licen[sc]ed?", 3, 0.75),
    ("gfdl-1.3", "gnu free", "(?:the )?gnu free documentation licen[sc]e(?: v| version)? ?1 3(?: or any later version)?", 1, 0.95),
    ("gfdl-1.2", "gnu free", "(?:the )?gnu free documentation licen[sc]e(?: v| version)? ?1 2(?: or any later version)?", 1, 0.95),
    ("gfdl", "gnu free", "(?:the )?gnu free documentation licen[sc]es?", 3, 0.8),
    ("gfdl", "with no invariant", "with no invariant sections no front cover texts and no back cover texts", 2, 0.85),
    # mozilla, eclipse and other copyleft by file or library
    ("mpl-2.0", "mozilla", "(?:the )?mozilla public licen[sc]e(?: mpl)?(?: v| version)? ?2 0", 1, 0.95),
    ("mpl-2.0", "this source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1, 0.99),
    ("mpl-1.1", "mozilla", "(?:the )?mozilla public licen[sc]e(?: mpl)?(?: v| version)? ?1 1", 1, 0.95),
    ("mpl-1.0", "mozilla", "(?:the )?mozilla public licen[sc]e(?: mpl)?(?: v| version)? ?1 0", 1, 0.95),
    ("mpl-2.0", "available under", "available under (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e(?: v| version)? ?2 0", 1, 0.98),
    ("mpl", "mozilla", "(?:the )?mozilla public licen[sc]es?", 3, 0.8),
    ("mpl", "mozilla org", "mozilla org mpl 2 0 licen[sc]e", 1, 0.9),
    ("epl-2.0", "eclipse", "(?:the )?eclipse public licen[sc]e(?: v| version)? ?2 0", 1, 0.95),
    ("epl-1.0", "eclipse", "(?:the )?eclipse public licen[sc]e(?: v| version)? ?1 0", 1, 0.95),
    ("edl-1.0", "eclipse", "(?:the )?eclipse distribution licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.95),
    ("epl", "eclipse", "(?:the )?eclipse public licen[sc]es?", 3, 0.8),
    ("cddl-1.0", "common development", "(?:the )?common development and distribution licen[sc]e(?: cddl)?(?: v| version)? ?1 0", 1, 0.95),
    ("cddl-1.1", "common development", "(?:the )?common development and distribution licen[sc]e(?: cddl)?(?: v| version)? ?1 1", 1, 0.95),
    ("cddl", "common development", "(?:the )?common development and distribution licen[sc]es?", 3, 0.8),
    ("cpl-1.0", "common public", "(?:the )?common public licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.95),
    ("ipl-1.0", "ibm", "(?:the )?ibm public licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.95),
    ("eupl-1.2", "european union", "(?:the )?european union public licen[sc]e(?: eupl)?(?: v| version)? ?1 2", 1, 0.95),
    ("eupl-1.1", "european union", "(?:the )?european union public licen[sc]e(?: eupl)?(?: v| version)? ?1 1", 1, 0.95),
    ("eupl", "european union", "(?:the )?european union public licen[sc]es?", 3, 0.8),
    ("apsl-2.0", "apple public", "(?:the )?apple public source licen[sc]e(?: v| version)?(?: 2 0)?", 1, 0.95),
    ("artistic-2.0", "artistic", "(?:the )?artistic licen[sc]e(?: v| version)? ?2 0", 1, 0.95),
    ("artistic-1.0", "artistic", "(?:the )?artistic licen[sc]e(?: v| version)? ?1 0", 1, 0.95),
    ("artistic", "artistic", "(?:the )?artistic licen[sc]es?", 3, 0.8),
    ("lppl-1.3", "latex", "(?:the )?latex project public licen[sc]e(?: v| version)?(?: 1 3c?)?", 1, 0.95),
    ("php-3.0", "php", "(?:the )?php licen[sc]e(?: v| version)?(?: 3 01?)?", 1, 0.9),
    ("python-2.0", "python", "(?:the )?python(?: software foundation)? licen[sc]e(?: v| version)?(?: 2(?: 0)?)?", 1, 0.9),
    ("ruby", "ruby", "(?:the )?ruby licen[sc]e", 3, 0.75),
    ("zpl-2.1", "zope", "(?:the )?zope public licen[sc]e(?: zpl)?(?: v| version)?(?: 2 1)?", 1, 0.95),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e", 1, 0.9),
    ("qpl-1.0", "q public", "(?:the )?q public licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.9),
    ("sleepycat", "sleepycat", "(?:the )?sleepycat licen[sc]e", 3, 0.8),
    ("cecill-2.1", "cecill", "cecill(?: free software)? licen[sc]e(?: agreement)?(?: v| version)?(?: 2 1)?", 1, 0.9),
    ("ofl-1.1", "sil", "(?:the )?sil open font licen[sc]e(?: v| version)?(?: 1 1)?", 1, 0.95),
    ("ofl-1.1", "this font software", "this font software is licensed under the sil open font licen[sc]e", 1, 0.98),
    ("ms-pl", "microsoft", "(?:the )?microsoft public licen[sc]e(?: ms pl)?", 1, 0.95),
    ("ms-rl", "microsoft", "(?:the )?microsoft reciprocal licen[sc]e(?: ms rl)?", 1, 0.95),
    ("odbl-1.0", "open data", "(?:the )?open (?:data commons open )?database licen[sc]e(?: odbl)?(?: v| version)?(?: 1 0)?", 1, 0.9),
    ("odc-by-1.0", "open data", "open data commons attribution licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.95),
    ("pddl-1.0", "open data", "open data commons public domain dedication and licen[sc]e", 1, 0.95),
    ("opl-1.0", "open publication", "(?:the )?open publication licen[sc]e(?: v| version)?(?: 1 0)?", 1, 0.9),
    # public domain and commons
    ("unlicense", "unlicense", "(?:the )?unlicense(?: org)?", 3, 0.8),
    ("unlicense", "free and unencumbered", "(?:this is )?free and unencumbered software released into the public domain", 2, 0.9),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software", 2, 0.85),
    ("public-domain", "released", "released (?:in|into|to) the public domain", 2, 0.85),
    ("public-domain", "placed", "placed (?:in|into) the public domain", 2, 0.85),
    ("public-domain", "dedicated", "dedicated to the public domain", 2, 0.85),
    ("public-domain", "is in the public", "is in the public domain", 2, 0.75),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 2, 0.85),
    ("cc0-1.0", "creative commons zero", "creative commons zero(?: v?1 0)?(?: universal)?", 2, 0.85),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 1, 0.95),
    ("cc-by", "creativecommons", "creativecommons org licenses by(?: [1-4] [05])?", 1, 0.9),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa(?: [1-4] [05])?", 1, 0.92),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?: [1-4] [05])?", 1, 0.92),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd(?: [1-4] [05])?", 1, 0.92),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa(?: [1-4] [05])?", 1, 0.94),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd(?: [1-4] [05])?", 1, 0.94),
    # closed and source-available
    ("busl-1.1", "business source", "(?:the )?business source licen[sc]e(?: v| version)?(?: 1 1)?", 1, 0.95),
    ("sspl-1.0", "server side", "(?:the )?server side public licen[sc]e(?: sspl)?(?: v| version)?(?: 1(?: 0)?)?", 1, 0.95),
    ("elastic-2.0", "elastic", "(?:the )?elastic licen[sc]e(?: v| version)?(?: 2 0)?", 1, 0.95),
    ("commons-clause", "commons clause", "commons clause(?: license condition)?(?: v| version)?(?: 1 0)?", 1, 0.9),
    ("polyform", "polyform", "polyform (?:noncommercial|shield|strict|small business) licen[sc]e", 1, 0.9),
    ("proprietary", "all rights reserved", "all rights reserved", 2, 0.85),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 2, 0.85),
    ("proprietary", "confidential and proprietary", "confidential and proprietary", 2, 0.85),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution|reproduction)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited", 2, 0.85),
    ("proprietary", "end user", "end user licen[sc]e agreement", 2, 0.8),
    ("proprietary", "may not be reproduced", "may not be reproduced(?: [^ ]+){0,8} without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 2, 0.85),
    ("proprietary", "no part of this", "no part of this (?:work|publication|software|document) may be reproduced(?: [^ ]+){0,12} permission", 2, 0.85),
    ("proprietary", "proprietary", "proprietary licen[sc]e", 3, 0.75),
    ("proprietary", "commercial", "commercial licen[sc]e(?: agreement| required)", 3, 0.7),
    ("evaluation", "evaluation", "(?:for )?evaluation (?:purposes )?(?:only )?licen[sc]e", 3, 0.6),
    ("freeware", "freeware", "freeware licen[sc]e(?: agreement)?", 3, 0.7),
    ("shareware", "shareware", "shareware licen[sc]e(?: agreement)?", 3, 0.7),
]

#: Creative Commons come in versions; these alone are made from parts: label part, its words, its long name.
COMMONS = [("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s")]


def commons() -> list[tuple]:
    """Four rules for each part and version, two for each part without a version."""
    out = []
    for part, short, long in COMMONS:
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{part}-{version.replace(' ', '.')}"
            out.append((label, "cc", f"(?:licensed under )?cc {short} {version}(?: international| unported)?", 1, 0.95))
            out.append((label, "creative commons", f"creative commons {long}(?: {version}| (?:[^ ]+ ){{0,2}}licen[sc]e {version})(?: international| unported)?", 1, 0.95))
        out.append((f"cc-{part}", "creative commons", f"creative commons {long}(?: licen[sc]e)?", 3, 0.75))
        out.append((f"cc-{part}", "cc", f"cc {short} licen[sc]e", 3, 0.75))
    return out
