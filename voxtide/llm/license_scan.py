"""License notices found by ordered signature rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A-Z is lower-cased; all ASCII but letters and digits separates words
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

#: Phrases that always count, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

V = r"(?:v(?:ersion)? ?|version )?"
LIC = r"licen[sc]e"

#: Families: label, name (a pattern over words joined by one space), the words one
#: of which must stand in a text before the family's rules are tried, and the
#: address a notice links to, if there is one. Names that are ordinary words carry "license".
FAMILIES: list[tuple[str, str, str, str]] = [
    ("apache-1.1", rf"apache (?:software )?{LIC} {V}1 1", "apache", r"apache org licenses license 1 1"),
    ("apache-2.0", rf"apache (?:software )?(?:{LIC} )?{V}2(?: 0)?", "apache", r"apache org licenses license 2 0"),
    ("mit", rf"(?:the )?(?:mit|expat|x11) {LIC}", "mit expat x11", r"opensource org licen[sc]es? mit"),
    ("bsd-2-clause", rf"(?:bsd 2 clause|simplified bsd|2 clause bsd|freebsd)(?: {LIC})?", "bsd freebsd", r"opensource org licen[sc]es? bsd 2 clause"),
    ("bsd-3-clause", rf"(?:bsd 3 clause|new bsd|revised bsd|modified bsd|3 clause bsd)(?: {LIC})?", "bsd", r"opensource org licen[sc]es? bsd 3 clause"),
    ("bsd-4-clause", rf"(?:bsd 4 clause|original bsd|4 clause bsd)(?: {LIC})?", "bsd", r"spdx org licenses bsd 4 clause"),
    ("0bsd", rf"(?:0bsd|zero clause bsd)(?: {LIC})?", "0bsd zero", r"opensource org licen[sc]es? 0bsd"),
    ("isc", rf"isc {LIC}", "isc", r"opensource org licen[sc]es? isc"),
    ("gpl-1.0", rf"(?:gnu )?(?:gpl|general public {LIC}) {V}1(?: 0)?", "gpl general", r"gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", rf"(?:gnu )?(?:gpl|general public {LIC}) {V}2(?: 0)?", "gpl gplv2 general", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", rf"(?:gnu )?(?:gpl|general public {LIC}) {V}3(?: 0)?", "gpl gplv3 general", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", r"gplv2", "gplv2", r"gnu org licenses gpl2"),
    ("gpl-3.0", r"gplv3", "gplv3", r"gnu org licenses gpl3"),
    ("lgpl-2.0", rf"(?:gnu )?(?:lgpl|library general public {LIC}) {V}2(?: 0)?", "lgpl library", r"gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lgpl|lesser general public {LIC}) {V}2 1", "lgpl lesser", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lgpl|lesser general public {LIC}) {V}3(?: 0)?", "lgpl lesser", r"gnu org licenses lgpl 3 0"),
    ("lgpl", rf"(?:gnu )?(?:lgpl|lesser general public {LIC})", "lgpl lesser", r"gnu org (?:copyleft|licenses) lesser"),
    ("agpl-3.0", rf"(?:gnu )?(?:agpl|affero general public {LIC})(?: {V}3(?: 0)?)?", "agpl agplv3 affero", r"gnu org licenses agpl 3 0"),
    ("gfdl-1.3", rf"(?:gnu )?(?:gfdl|free documentation {LIC})(?: {V}1 [123])?", "gfdl documentation", r"gnu org (?:copyleft|licenses) fdl"),
    ("gpl", rf"(?:gnu )?(?:gpl|general public {LIC})", "gpl general", r"gnu org (?:copyleft|licenses) gpl"),
    ("mpl-1.1", rf"(?:mpl|mozilla public {LIC}) {V}1 1", "mpl mozilla", r"mozilla org mpl 1 1"),
    ("mpl-2.0", rf"(?:mpl|mozilla public {LIC}) {V}2(?: 0)?", "mpl mozilla", r"mozilla org mpl 2 0"),
    ("epl-1.0", rf"(?:epl|eclipse public {LIC}) {V}1(?: 0)?", "epl eclipse", r"eclipse org legal epl v10"),
    ("epl-2.0", rf"(?:epl|eclipse public {LIC}) {V}2(?: 0)?", "epl eclipse", r"eclipse org legal epl (?:v20|2 0)"),
    ("cddl-1.0", rf"(?:cddl|common development and distribution {LIC})(?: {V}1 [01])?", "cddl distribution", r"opensource org licen[sc]es? cddl"),
    ("eupl-1.2", rf"(?:eupl|european union public licen[sc]e)(?: {V}1 [012])?", "eupl european", r"joinup ec europa eu collection eupl"),
    ("artistic-2.0", rf"artistic {LIC}(?: {V}2(?: 0)?)?", "artistic", r"opensource org licen[sc]es? artistic"),
    ("zlib", rf"zlib(?: libpng)? {LIC}", "zlib", r"opensource org licen[sc]es? zlib"),
    ("bsl-1.0", rf"boost software {LIC}(?: {V}1 0)?", "boost", r"boost org license 1 0"),
    ("wtfpl", rf"(?:wtfpl|do what the fuck you want to public {LIC})", "wtfpl fuck", r"wtfpl net"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense org"),
    ("ofl-1.1", rf"(?:sil )?open font {LIC}(?: {V}1 1)?", "font", r"scripts sil org ofl"),
    ("python-2.0", rf"(?:python software foundation|psf) {LIC}(?: {V}2)?", "python psf", r"python org psf license"),
    ("ms-pl", rf"(?:ms pl|microsoft public {LIC})", "microsoft ms", r"opensource org licen[sc]es? ms pl"),
    ("postgresql", rf"postgresql {LIC}", "postgresql", r"opensource org licen[sc]es? postgresql"),
    ("odbl-1.0", rf"(?:odbl|open database {LIC})(?: {V}1 0)?", "odbl database", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", rf"(?:odc by|open data commons attribution {LIC})(?: {V}1 0)?", "odc commons", r"opendatacommons org licenses by"),
    ("pddl-1.0", rf"(?:pddl|public domain dedication and {LIC})(?: {V}1 0)?", "pddl dedication", r"opendatacommons org licenses pddl"),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 zero", r"creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc commons creativecommons", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc commons creativecommons", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1-4] [05])?", "cc commons creativecommons", r"creativecommons org licenses by nc(?! (?:nd|sa))"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc commons creativecommons", r"creativecommons org licenses by nd"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1-4] [05])?", "cc commons creativecommons", r"creativecommons org licenses by sa"),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?", "cc commons creativecommons", r"creativecommons org licenses by(?! (?:nc|nd|sa))"),
    ("public-domain", r"(?:in|to|into) the public domain", "domain", r"creativecommons org publicdomain mark"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary|trade secret)", "proprietary secret", ""),
    ("reserved", r"(?:all|some) rights reserved", "reserved", ""),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)?", "copyright", ""),
]

#: Kinds of notice: name, priority, confidence, pattern around a family's name.
NOTICES: list[tuple[str, int, float, str]] = [
    ("identifier", 5, 1.0, r"spdx license identifier (?:{name}|{spdx}(?: only| or later)?)"),
    ("grant", 4, 0.95, r"(?:licen[sc]ed|released|distributed|provided|available|published|covered)(?: to you)? (?:under|by|with) (?:the |a |an )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?(?:{name})(?: {lic})?(?: {version})?"),
    ("address", 4, 0.9, r"(?:https? )?(?:www )?(?:{address})"),
    ("terms", 3, 0.85, r"(?:subject to|see|under|accept|agree to|terms of) (?:the )?(?:terms of (?:the )?)?(?:{name})(?: {lic})?(?: {version})?"),
    ("or later", 3, 0.85, r"(?:{name})(?: {lic})? (?:or|and) (?:any |at your option any )*later(?: version)?"),
    ("name", 1, 0.6, r"(?:{name})(?: {lic})?(?: {version})?"),
]


#: Sentences of license texts: label, the word that must stand in a text before the
#: sentence is looked for, confidence, and the sentence as a pattern over words
#: joined by one space; * stands for up to 15 words. The wording of the licenses.
SENTENCES: list[tuple[str, str, float, str]] = [
    ("mit", "hereby", 1.0, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", 0.95, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "substantial", 0.9, r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("ncsa", "deal", 1.0, r"to deal with the software without restriction including without limitation the rights"),
    ("ncsa", "disclaimers", 0.9, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("isc", "hereby", 1.0, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby", 1.0, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", "disclaims", 0.9, r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("hpnd", "hereby", 1.0, r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: with or)? ?(?:without fee )?is hereby granted(?: without fee)?"),
    ("postgresql", "agreement", 1.0, r"for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution", 1.0, r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions", 0.9, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer(?! s)"),
    ("bsd", "redistributions", 0.9, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", 1.0, r"neither the names? of * (?:nor|or) the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", 0.9, r"the names? of the (?:author|authors|copyright holders?|contributors) may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", "patent", 1.0, r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "advertising", 1.0, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "misrepresented", 1.0, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 0.95, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "liable", 0.85, r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("libpng", "png", 0.9, r"the png reference library is supplied as is"),
    ("apache-2.0", "compliance", 1.0, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "perpetual", 0.95, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable * license"),
    ("apache-2.0", "applicable", 0.9, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "reproduction", 0.9, r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-1.1", "apache", 1.0, r"this product includes software developed by the apache (?:software foundation|group)"),
    ("openssl", "openssl", 1.0, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", 1.0, r"this product includes cryptographic software written by eric young"),
    ("gpl", "redistribute", 1.0, r"(?:this program|this file|it|\S+) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2.0", "freedom", 1.0, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "verbatim", 0.95, r"you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-2.0", "guarantee", 0.9, r"by contrast the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-3.0", "copyleft", 1.0, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "convey propagate", 0.9, r"you may (?:make run and propagate covered works|convey verbatim copies of the program s source code)"),
    ("gpl-3.0", "tivoization", 0.6, r"tivoization"),
    ("gpl", "verbatim", 0.9, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "received", 0.95, r"you should have received a copy of the gnu general public licen[sc]e along with"),
    ("lgpl", "received", 0.95, r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with"),
    ("agpl-3.0", "received", 0.95, r"you should have received a copy of the gnu affero general public licen[sc]e along with"),
    ("lgpl", "redistribute", 1.0, r"(?:this library|this program|it|\S+) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl-2.0", "library", 0.95, r"this license the library general public license applies to some specially designated free software foundation software"),
    ("lgpl-2.1", "lesser", 0.95, r"this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-3.0", "lesser", 0.95, r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "affero", 1.0, r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "network", 0.95, r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl-3.0", "remotely", 0.9, r"all users interacting with it remotely through a computer network"),
    ("agpl-3.0", "redistribute", 1.0, r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gfdl-1.3", "documentation", 1.0, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1.3", "invariant", 0.9, r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("gfdl-1.3", "manual", 0.9, r"the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("gpl-classpath-exception", "linking", 1.0, r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", "runtime", 0.9, r"under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("mpl-1.1", "mozilla", 1.0, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", 1.0, r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2.0", "mozilla", 1.0, r"this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)? ?2 0)?"),
    ("mpl-2.0", "mpl", 1.0, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-1.0", "eclipse", 0.95, r"the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl", "eclipse", 0.95, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl-1.0", "common", 0.95, r"the accompanying program is provided under the terms of this common public license agreement"),
    ("ibmpl-1.0", "ibm", 0.95, r"the accompanying program is provided under the terms of this ibm public license agreement"),
    ("cddl-1.0", "development", 1.0, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cecill", "cecill", 1.0, r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("bsl-1.0", "hereby", 1.0, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", 1.0, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "verbatim", 1.0, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", "fuck", 0.95, r"you just do what the fuck you want to"),
    ("beerware", "beer", 1.0, r"you can buy me a beer in return"),
    ("ofl-1.1", "font", 1.0, r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "fonts", 0.9, r"the fonts and derivatives however cannot be released under any other type of license"),
    ("ofl-1.1", "font", 0.7, r"with reserved font names?"),
    ("artistic-1.0", "artistic", 0.9, r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "establishes", 0.95, r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ruby", "verbatim", 0.8, r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("perl", "perl", 0.95, r"you can redistribute it and or modify it under the same terms as perl(?: 5 programming language system)? itself"),
    ("python-2.0", "psf", 1.0, r"psf is making python available to licensee on an as is basis"),
    ("python-2.0", "psf", 0.95, r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("php-3.01", "php", 0.95, r"this product includes php software freely available from"),
    ("vim", "charityware", 0.9, r"vim is charityware"),
    ("json", "evil", 0.95, r"the software shall be used for good not evil"),
    ("ms-pl", "accept", 0.95, r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("sleepycat", "db", 0.95, r"complete source code for the db software and any accompanying software that uses the db software"),
    ("unicode", "unicode", 0.95, r"any person obtaining a copy of (?:the unicode )?data files and any associated documentation"),
    ("w3c", "holders", 0.9, r"this (?:work|software|document) * is being provided by the copyright holders under the following license"),
    ("afl-3.0", "academic", 0.95, r"licensed under the academic free license version 3 0"),
    ("osl-3.0", "licensed", 0.95, r"licensed under the open software license version 3 0"),
    ("upl-1.0", "permissive", 0.9, r"the universal permissive license upl version 1 0"),
    ("blueoak-1.0.0", "protecting", 0.95, r"this license gives everyone as much permission to work with this software as possible while protecting contributors from liability"),
    ("cc0-1.0", "neighboring", 1.0, r"to the extent possible under law * waived all copyright and related or neighboring rights to"),
    ("cc0-1.0", "dedicated", 0.95, r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc", "exercising", 0.95, r"by exercising (?:the licensed rights defined below|any rights to the work provided here) you accept and agree to be bound by the terms"),
    ("cc", "redistribute", 0.8, r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "credit", 0.9, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "commercial", 0.85, r"you may not use the material for commercial purposes"),
    ("cc-by-sa", "remix", 0.95, r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "remix", 0.95, r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "sharealike", 0.9, r"attribution sharealike [234] [05] (?:international|unported|generic)"),
    ("cc-by", "attribution", 0.9, r"creative commons attribution [234] [05] (?:international|unported|generic)"),
    ("odbl-1.0", "database", 0.95, r"is a license agreement intended to allow users to freely share modify and use this database"),
    ("ogl-uk-3.0", "contains", 0.95, r"contains public sector information licensed under the open government licen[sc]e"),
    ("ogl-uk-3.0", "crown", 0.7, r"crown copyright"),
    ("us-government", "government", 0.7, r"this (?:work|software) (?:was|is) * (?:by|of) (?:officers or employees|an? (?:officer or )?employee) of the (?:u s|united states) government"),
    ("llama-community", "llama", 0.95, r"llama \S+ is licensed under the llama \S+ community license"),
    ("openrail", "rail", 0.8, r"(?:creativeml open|open|bigscience|bigcode) rail(?: \S)? m?"),
    ("busl-1.1", "business", 0.95, r"business source license (?:v(?:ersion)? ?)?1 1"),
    ("sspl-1.0", "server", 0.95, r"server side public license"),
    ("elastic-2.0", "elastic", 0.95, r"elastic license (?:v(?:ersion)? ?)?2 0"),
    ("commons-clause", "commons", 0.95, r"commons clause license condition"),
    ("as-is", "warranty", 0.7, r"the software is provided as is without warranty of any kind"),
    ("as-is", "warranties", 0.7, r"is provided by * as is and any express or implied warranties"),
    ("as-is", "warranty", 0.7, r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("as-is", "warranty", 0.7, r"without any express or implied warranty"),
    ("as-is", "liable", 0.6, r"in no event shall (?:the )?(?:authors?|copyright (?:holders?|owners?)|contributors|regents|foundation) * be liable for any"),
    ("proprietary", "unauthorized unauthorised", 0.95, r"unauthori[sz]ed (?:copying|reproduction|use|distribution|duplication)(?: or (?:copying|reproduction|use|distribution|duplication))? of this * (?:is|are) (?:strictly )?prohibited"),
    ("proprietary", "confidential", 0.85, r"contains (?:proprietary and confidential|confidential and proprietary) information"),
    ("proprietary", "disclose", 0.8, r"you (?:may|shall) not (?:copy )?(?:disclose|reverse engineer decompile or disassemble)"),
    ("reserved", "reproduced", 0.9, r"no part of this (?:publication|book|document|work|site|website|material) may be (?:reproduced|copied)"),
    ("reserved", "reproduced", 0.9, r"may not be (?:reproduced|copied|republished)(?: \S+){0,8}? without(?: the)?(?: express)?(?: prior)?(?: written)? (?:permission|consent)"),
    ("reserved", "prohibited", 0.9, r"reproduction in whole or in part(?: \S+){0,4}? without(?: the)?(?: express)?(?: prior)?(?: written)? (?:permission|consent) is (?:strictly )?prohibited"),
    ("reserved", "rewritten", 0.95, r"this material may not be published broadcast rewritten or redistributed"),
    ("reserved", "reprinted", 0.7, r"reprinted (?:with|by)(?: the)?(?: kind)? permission"),
    ("non-commercial", "personal", 0.7, r"for (?:your )?personal (?:and )?non ?commercial use only"),
    ("non-commercial", "academic research educational", 0.7, r"for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) only"),
]

#: Short forms: label and the names that are used without "license".
SHORT_NAMES: list[tuple[str, str]] = [
    ("mit", "mit"), ("isc", "isc"), ("bsd", "bsd"), ("apache-2.0", "apache"), ("zlib", "zlib"), ("gpl", "gpl"), ("gpl-2.0", "gplv2"), ("gpl-3.0", "gplv3"), ("lgpl", "lgpl"),
    ("lgpl-2.1", "lgplv2"), ("lgpl-3.0", "lgplv3"), ("agpl-3.0", "agpl"), ("agpl-3.0", "agplv3"), ("mpl-2.0", "mpl"), ("epl", "epl"), ("cddl-1.0", "cddl"), ("eupl", "eupl"), ("cc0-1.0", "cc0"),
    ("ofl-1.1", "ofl"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
]
SHORT_FORMS = [
    r"{name} licen[sc]ed",
    r"(?:released|licen[sc]ed|available|distributed|published|provided|shared|dual licen[sc]ed) (?:to you )?under (?:the |a |an )?{name}",
    r"licen[sc]e {name}(?= )(?! licen)",
]


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    confidence: float
    pattern: re.Pattern
    order: int


@lru_cache(maxsize=1)
def rules() -> tuple[list[Rule], dict[bytes, list[Rule]]]:
    """All rules in order, and by the keyword that lets them be tried."""
    out, by_word = [], {}
    for label, name, words, address in FAMILIES:
        for kind, priority, confidence, around in NOTICES:
            if kind == "address" and not address:
                continue
            body = around.format(name=name, address=address, lic=LIC, spdx=re.sub(r"[-.]", " ", label), version=rf"{V}\d(?: \d)?")
            rule = Rule(label, kind, priority, confidence, re.compile(rf"(?<= )(?:{body})(?= )".encode()), len(out))
            out.append(rule)
            keys = ["spdx"] if kind == "identifier" else [re.match(r"[a-z]+", re.sub(r"\(\?:.*?\)\??", "", address).strip())[0]] if kind == "address" else words.split()
            for word in keys:
                by_word.setdefault(word.encode(), []).append(rule)
    short = [(label, name, 0.8, form.format(name=name)) for label, name in SHORT_NAMES for form in SHORT_FORMS]
    for kind, priority, rows in (("sentence", 4, SENTENCES), ("short", 2, short)):
        for label, words, confidence, body in rows:
            body = body.replace(" * ", r"(?: \S+){0,15}? ")
            rule = Rule(label, kind, priority, confidence, re.compile(rf"(?<= )(?:{body})(?= )".encode()), len(out))
            out.append(rule)
            for word in words.split():
                by_word.setdefault(word.encode(), []).append(rule)
    return out, by_word


def detect(words: list[bytes], norm: bytes) -> list[tuple[int, int, Rule]]:
    """Places (first byte, end) of the rules that hold after overlaps are resolved:
    higher priority first, then longer, then earlier, then the order of the rules;
    what lies within a place already taken is suppressed."""
    _, by_word = rules()
    tried = {r.order: r for w in by_word.keys() & set(words) for r in by_word[w]}
    found = [(m.start(), m.end(), r) for r in tried.values() for m in r.pattern.finditer(norm)]
    kept: list[tuple[int, int, Rule]] = []
    taken: dict[int, int] = {}  # start -> furthest end
    longest = 0
    for a, b, r in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].order)):
        if not any(taken.get(x, -1) >= b for x in range(a - longest, a + 1)):
            kept.append((a, b, r))
            taken[a] = max(b, taken.get(a, -1))
            longest = max(longest, b - a)
    return sorted(kept, key=lambda x: x[:2])


_PHRASES = [(p, f" {p} ".encode()) for p in BASE]


def _spaces(norm: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)


def scan(text: str | None) -> dict:
    """Result of one text, as license_scan describes it."""
    words = (text or "").encode().translate(_TABLE).split()
    norm = b" " + b" ".join(words) + b" "
    places, labels, spaces = [], set(), None
    for phrase, padded in _PHRASES:
        at = norm.find(padded)
        while at >= 0:
            spaces = _spaces(norm) if spaces is None else spaces
            places.append(int(np.searchsorted(spaces, at)))
            labels.add(BASE[phrase])
            at = norm.find(padded, at + 1)
    found = detect(words, norm)
    own = {r.label for _, _, r in found}
    spaces = _spaces(norm) if found and spaces is None else spaces
    score = max([r.confidence for _, _, r in found] + [0.5] * bool(places), default=0.0)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | own)), "score": score,
        "detections": [{"label": r.label, "kind": r.kind, "start": int(np.searchsorted(spaces, a)) - 1, "length": int(np.searchsorted(spaces, b) - np.searchsorted(spaces, a)) + 1} for a, b, r in found],
    }


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "detections array<struct<label: string, kind: string, start: bigint, length: bigint>>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices of every document.

    Rules are families of licenses in each kind of notice (identifier, grant,
    address, terms, "or later", bare name), sentences of the license texts, and
    short forms ("MIT-licensed", "under ISC"). A rule is tried only on texts that hold
    one of its keywords. Of overlapping detections the one of higher priority
    stands, and what lies inside it is suppressed; detections that overlap in part
    both stand. The phrases of BASE count wherever their words stand together.

    Words are runs of letters and digits, all characters beyond ASCII included,
    with A-Z lower-cased. A null or empty text has no words, no labels ("") and
    score 0. Whole texts; one pass; no shuffle. Each row gives one row, whatever
    its id; other columns are not read.

    Returns id, n_words, n_base (places of base phrases), first_word, last_word
    (word numbers of their smallest and largest start, or null), base_labels,
    labels (base ones and those of the rules; distinct, sorted, by commas), score
    (confidence of the surest finding), detections (label, kind, start, length in words).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
             "labels": pa.string(), "score": pa.float64(), "detections": pa.list_(struct)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py()) for x in batch["text"]]
            yield pa.record_batch({"id": batch["id"], **{k: pa.array([r[k] for r in rows], t) for k, t in types.items()}})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)
