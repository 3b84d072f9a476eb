"""Signature rules of the license scan, one a line: label, priority, keyword, pattern.

A rule is tried on texts that hold its keyword anywhere, within words too; every match of its pattern holds the keyword. A
blank in a pattern stands for any run of blanks, comment signs and quotes; patterns match lower-case text. Priority 4: wording of a notice or of the license itself; 3: its name with a
version or in full; 2: an identifier or abbreviation; 1: a mention that names a family only.
"""

from __future__ import annotations

_BLANK = r"[\s*#/;\"']"

RULES_TEXT = r"""
mit 4 permission permission is hereby granted, free of charge, to any person obtaining a copy
mit 4 sublicense to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
mit 4 substantial copyright notice and this permission notice shall be included in all copies or substantial portions
mit 4 mit (?:released|licensed|distributed|available|provided) under the (?:terms of the )?mit licen[sc]e
mit 3 mit \bmit licen[sc]e\b
mit 3 expat \bexpat licen[sc]e\b
mit 2 mit spdx-license-identifier: mit\b
mit 2 mit licen[sc]e:? \(?mit\)?(?![a-z0-9-])
mit 2 opensource opensource\.org/licenses/mit
mit 1 mit \bmit[- ]style licen[sc]e
mit-0 3 mit \bmit no attribution
mit-0 2 mit spdx-license-identifier: mit-0\b
apache-2.0 4 apache (?:licensed|released|distributed) under the apache licen[sc]e,? version 2\.0
apache-2.0 4 limitations see the license for the specific language governing permissions and limitations under the license
apache-2.0 4 compliance you may not use this file except in compliance with the license
apache-2.0 4 writing unless required by applicable law or agreed to in writing, software
apache-2.0 3 apache \bapache licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b
apache-2.0 3 apache \bapache software licen[sc]e,? (?:version |v)?2(?:\.0)?\b
apache-2.0 2 apache \bapache-2\.0\b
apache-2.0 2 apache \bapache 2\.0\b
apache-2.0 2 apache apache\.org/licenses/license-2\.0
apache-2.0 2 asl \basl 2\.0\b
apache-1.1 3 apache \bapache (?:software )?licen[sc]e,? (?:version |v)?1\.1
apache-1.1 2 apache \bapache-1\.1\b
apache-1.0 3 apache \bapache (?:software )?licen[sc]e,? (?:version |v)?1\.0
apache-1.0 2 apache \bapache-1\.0\b
apache 1 apache \bapache(?: software)? licen[sc]e\b
gpl-1.0 3 general \bgnu general public licen[sc]e,? (?:version |v)1\b
gpl-1.0 2 gpl \bgpl-?v?1(?:\.0)?\b
gpl-2.0 4 general general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 2
gpl-2.0 4 version (?:licensed|released|distributed) under (?:the )?(?:gnu )?(?:gpl|general public licen[sc]e),? version 2\b
gpl-2.0 3 general \bgeneral public licen[sc]e,? (?:version |v)2(?:\.0)?\b
gpl-2.0 2 gpl \bgpl-?v?2(?:\.0)?\b
gpl-2.0 2 gpl \bgpl,? version 2\b
gpl-2.0 2 gpl spdx-license-identifier: gpl-2\.0(?:-only|-or-later|\+)?
gpl-2.0-classpath 3 classpath \bclasspath exception\b
gpl-2.0-classpath 4 linking linking this library statically or dynamically with other modules
gpl-3.0 4 general general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 3
gpl-3.0 4 general licensed under the (?:gnu )?general public licen[sc]e,? version 3
gpl-3.0 3 general \bgeneral public licen[sc]e,? (?:version |v)3(?:\.0)?\b
gpl-3.0 2 gpl \bgpl-?v?3(?:\.0)?\b
gpl-3.0 2 gpl \bgpl,? version 3\b
gpl-3.0 2 gpl spdx-license-identifier: gpl-3\.0(?:-only|-or-later|\+)?
gpl 4 merchantability without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public
gpl 4 received you should have received a copy of the gnu general public licen[sc]e
gpl 2 gnu gnu\.org/licenses/gpl
gpl 1 general \b(?:gnu )?general public licen[sc]e\b
gpl 1 gpl \bgnu gpl\b
gpl 1 gpl \bgpl licen[sc]e[d]?\b
lgpl-2.0 3 library \bgnu library general public licen[sc]e
lgpl-2.0 2 lgpl \blgpl-?v?2(?:\.0)?(?![.0-9])
lgpl-2.1 4 lesser lesser general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 2\.1
lgpl-2.1 3 lesser \blesser general public licen[sc]e,? (?:version |v)2\.1
lgpl-2.1 2 lgpl \blgpl-?v?2\.1\b
lgpl-3.0 4 lesser lesser general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 3
lgpl-3.0 3 lesser \blesser general public licen[sc]e,? (?:version |v)3
lgpl-3.0 2 lgpl \blgpl-?v?3(?:\.0)?\b
lgpl 4 lesser you should have received a copy of the gnu lesser general public licen[sc]e
lgpl 1 lesser \blesser general public licen[sc]e\b
lgpl 1 lgpl \blgpl\b
agpl-1.0 3 affero \baffero general public licen[sc]e,? (?:version |v)1
agpl-3.0 4 affero affero general public licen[sc]e as published by the free software foundation
agpl-3.0 4 affero you should have received a copy of the gnu affero general public licen[sc]e
agpl-3.0 3 affero \baffero general public licen[sc]e,? (?:version |v)3
agpl-3.0 2 agpl \bagpl-?v?3(?:\.0)?\b
agpl 1 affero \baffero general public licen[sc]e\b
agpl 1 agpl \bagpl\b
gfdl-1.1 3 documentation \bfree documentation licen[sc]e,? (?:version |v)1\.1
gfdl-1.2 3 documentation \bfree documentation licen[sc]e,? (?:version |v)1\.2
gfdl-1.3 3 documentation \bfree documentation licen[sc]e,? (?:version |v)1\.3
gfdl 4 invariant with no invariant sections, no front-cover texts,? and no back-cover texts
gfdl 2 gfdl \bgfdl(?:-1\.[123])?\b
gfdl 1 documentation \bfree documentation licen[sc]e\b
bsd-2-clause 3 bsd \b(?:bsd 2-clause|2-clause bsd|simplified bsd|freebsd) licen[sc]e
bsd-2-clause 2 bsd \bbsd-2-clause\b
bsd-3-clause 4 endorse may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause 3 bsd \b(?:bsd 3-clause|3-clause bsd|new bsd|revised bsd|modified bsd) licen[sc]e
bsd-3-clause 2 bsd \bbsd-3-clause\b
bsd-3-clause-clear 3 bsd \bclear bsd licen[sc]e
bsd-3-clause-clear 2 bsd \bbsd-3-clause-clear\b
bsd-4-clause 4 advertising all advertising materials mentioning features or use of this software must display
bsd-4-clause 3 bsd \b(?:original|4-clause|old) bsd licen[sc]e
bsd-4-clause 2 bsd \bbsd-4-clause\b
bsd 4 redistribution redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd 4 redistributions redistributions of source code must retain the above copyright notice
bsd 4 redistributions redistributions in binary form must reproduce the above copyright notice
bsd 1 bsd \bbsd(?:[- ]style)? licen[sc]e
0bsd 3 bsd \b(?:zero[- ]clause bsd|bsd zero clause licen[sc]e)
0bsd 2 0bsd \b0bsd\b
isc 4 permission permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted
isc 3 isc \bisc licen[sc]e\b
isc 2 isc spdx-license-identifier: isc\b
mpl-1.0 3 mozilla \bmozilla public licen[sc]e,? (?:version |v)?1\.0
mpl-1.1 3 mozilla \bmozilla public licen[sc]e,? (?:version |v)?1\.1
mpl-1.1 2 mpl \bmpl[- ]?1\.1\b
mpl-2.0 4 mozilla this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-2.0 3 mozilla \bmozilla public licen[sc]e,? (?:version |v\. ?)?2\.0
mpl-2.0 2 mpl \bmpl[- ]?2\.0\b
mpl-2.0 2 mozilla mozilla\.org/mpl/2\.0
mpl 1 mozilla \bmozilla public licen[sc]e\b
epl-1.0 3 eclipse \beclipse public licen[sc]e,? (?:- |version |v)?1\.0
epl-1.0 2 epl \bepl[- ]?1\.0\b
epl-2.0 3 eclipse \beclipse public licen[sc]e,? (?:- |version |v)?2\.0
epl-2.0 2 epl \bepl[- ]?2\.0\b
epl-2.0 4 eclipse this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl 1 eclipse \beclipse public licen[sc]e\b
edl-1.0 3 eclipse \beclipse distribution licen[sc]e
cddl-1.0 3 cddl \bcddl,? (?:version |v)?1\.0
cddl-1.1 3 cddl \bcddl,? (?:version |v)?1\.1
cddl-1.0 3 distribution \bcommon development and distribution licen[sc]e
cpl-1.0 3 common \bcommon public licen[sc]e,? (?:version |v)?1\.0
cpl-1.0 1 common \bcommon public licen[sc]e\b
cpal-1.0 3 attribution \bcommon public attribution licen[sc]e
ipl-1.0 3 ibm \bibm public licen[sc]e
eupl-1.1 2 eupl \beupl[,-]? ?(?:version |v)?\.? ?1\.1
eupl-1.2 2 eupl \beupl[,-]? ?(?:version |v)?\.? ?1\.2
eupl 3 european \beuropean union public licen[sc]e
osl-3.0 3 open \bopen software licen[sc]e,? (?:version |v)?\.? ?3\.0
osl-3.0 2 osl \bosl-3\.0\b
afl-3.0 3 academic \bacademic free licen[sc]e,? (?:version |v)?\.? ?3\.0
afl-3.0 2 afl \bafl-3\.0\b
afl 1 academic \bacademic free licen[sc]e\b
artistic-1.0 3 artistic \bartistic licen[sc]e,? (?:version )?1\.0
artistic-2.0 3 artistic \bartistic licen[sc]e,? (?:version )?2\.0
artistic-2.0 2 artistic \bartistic-2\.0\b
artistic 1 artistic \bartistic licen[sc]e\b
perl 4 perl same terms as perl itself
ruby 3 ruby \bruby licen[sc]e\b
php-3.01 3 php \bphp licen[sc]e,? (?:version )?3\.01
php-3.0 3 php \bphp licen[sc]e,? (?:version )?3\.0\b
php 1 php \bphp licen[sc]e\b
psf-2.0 3 python \bpython software foundation licen[sc]e
psf-2.0 2 psf \bpsf[- ]2\.0\b
python-2.0 3 python \bpython licen[sc]e,? (?:version )?2\.0
zpl-2.1 3 zope \bzope public licen[sc]e
zlib 4 altered altered source versions must be plainly marked as such
zlib 4 misrepresented the origin of this software must not be misrepresented
zlib 3 zlib \bzlib(?:/libpng)? licen[sc]e\b
zlib 2 zlib spdx-license-identifier: zlib\b
libpng 3 libpng \blibpng licen[sc]e\b
bsl-1.0 4 boost distributed under the boost software licen[sc]e
bsl-1.0 3 boost \bboost software licen[sc]e\b
bsl-1.0 2 bsl \bbsl-1\.0\b
busl-1.1 3 business \bbusiness source licen[sc]e
busl-1.1 2 busl \bbusl-1\.1\b
sspl-1.0 3 side \bserver side public licen[sc]e
sspl-1.0 2 sspl \bsspl(?:-1\.0)?\b
elastic-2.0 3 elastic \belastic licen[sc]e\b
unlicense 4 unencumbered this is free and unencumbered software released into the public domain
unlicense 3 unlicense \bthe unlicense\b
unlicense 2 unlicense unlicense\.org
wtfpl 4 fuck \bdo what the fuck you want to public licen[sc]e
wtfpl 2 wtfpl \bwtfpl\b
cc0-1.0 4 deed the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 3 cc0 \bcc0(?: 1\.0)? universal
cc0-1.0 2 cc0 \bcc0(?:[- ]1\.0)?\b
cc0-1.0 2 publicdomain creativecommons\.org/publicdomain/zero
cc-pdm-1.0 3 mark \bpublic domain mark\b
cc-by-1.0 2 cc \bcc[- ]by[- ]1\.0\b
cc-by-2.0 2 cc \bcc[- ]by[- ]2\.0\b
cc-by-2.5 2 cc \bcc[- ]by[- ]2\.5\b
cc-by-3.0 2 cc \bcc[- ]by[- ]3\.0\b
cc-by-4.0 2 cc \bcc[- ]by[- ]4\.0\b
cc-by-4.0 3 creative \bcreative commons attribution 4\.0
cc-by-4.0 2 creativecommons creativecommons\.org/licenses/by/4\.0
cc-by-3.0 3 creative \bcreative commons attribution 3\.0
cc-by-3.0 2 creativecommons creativecommons\.org/licenses/by/3\.0
cc-by-sa-2.0 2 cc \bcc[- ]by[- ]sa[- ]2\.0\b
cc-by-sa-3.0 2 cc \bcc[- ]by[- ]sa[- ]3\.0\b
cc-by-sa-3.0 3 sharealike \battribution[- ]sharealike 3\.0
cc-by-sa-4.0 2 cc \bcc[- ]by[- ]sa[- ]4\.0\b
cc-by-sa-4.0 3 sharealike \battribution[- ]sharealike 4\.0
cc-by-sa-4.0 2 creativecommons creativecommons\.org/licenses/by-sa/4\.0
cc-by-nd-3.0 2 cc \bcc[- ]by[- ]nd[- ]3\.0\b
cc-by-nd-4.0 2 cc \bcc[- ]by[- ]nd[- ]4\.0\b
cc-by-nd-4.0 3 noderivatives \battribution[- ]noderivatives 4\.0
cc-by-nc-2.0 2 cc \bcc[- ]by[- ]nc[- ]2\.0\b
cc-by-nc-3.0 2 cc \bcc[- ]by[- ]nc[- ]3\.0\b
cc-by-nc-4.0 4 cc (?:licensed|released) under cc by-nc 4\.0
cc-by-nc-4.0 2 cc \bcc[- ]by[- ]nc[- ]4\.0\b
cc-by-nc-4.0 3 noncommercial \battribution[- ]noncommercial 4\.0
cc-by-nc-4.0 2 creativecommons creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-3.0 2 cc \bcc[- ]by[- ]nc[- ]sa[- ]3\.0\b
cc-by-nc-sa-4.0 2 cc \bcc[- ]by[- ]nc[- ]sa[- ]4\.0\b
cc-by-nc-sa-4.0 3 noncommercial \battribution[- ]noncommercial[- ]sharealike 4\.0
cc-by-nc-nd-3.0 2 cc \bcc[- ]by[- ]nc[- ]nd[- ]3\.0\b
cc-by-nc-nd-4.0 2 cc \bcc[- ]by[- ]nc[- ]nd[- ]4\.0\b
cc-by-nc-nd-4.0 3 noncommercial \battribution[- ]noncommercial[- ]noderivatives 4\.0
cc 1 creative \bcreative commons licen[sc]e
cc 1 creativecommons creativecommons\.org/licenses
odbl-1.0 3 database \bopen database licen[sc]e
odbl-1.0 2 odbl \bodbl(?:-1\.0)?\b
odc-by-1.0 3 data \bopen data commons attribution
pddl-1.0 3 dedication \bpublic domain dedication and licen[sc]e
cdla-permissive-2.0 2 cdla \bcdla-permissive-2\.0\b
cdla-sharing-1.0 2 cdla \bcdla-sharing-1\.0\b
ofl-1.1 4 sil licensed under the sil open font licen[sc]e
ofl-1.1 3 sil \bsil open font licen[sc]e
ofl-1.1 2 ofl \bofl[- ]1\.1\b
ubuntu-font-1.0 3 ubuntu \bubuntu font licen[sc]e
ms-pl 3 microsoft \bmicrosoft public licen[sc]e
ms-pl 2 ms \bms-pl\b
ms-rl 3 microsoft \bmicrosoft reciprocal licen[sc]e
ms-rl 2 ms \bms-rl\b
ncsa 3 ncsa \b(?:university of illinois/)?ncsa open source licen[sc]e
llvm-exception 3 llvm \bllvm[- ]exceptions?\b
openssl 3 openssl \bopenssl licen[sc]e
openssl 4 openssl this product includes software developed by the openssl project
ssleay 4 cryptographic this product includes cryptographic software written by eric young
w3c 3 w3c \bw3c software (?:notice and )?(?:document )?licen[sc]e
x11 3 x11 \bx11 licen[sc]e\b
icu 3 icu \bicu licen[sc]e\b
unicode-dfs 3 unicode \bunicode,? inc\. licen[sc]e agreement
curl 3 curl \bcurl licen[sc]e\b
postgresql 3 postgresql \bpostgresql licen[sc]e\b
sleepycat 3 sleepycat \bsleepycat licen[sc]e
qpl-1.0 3 public \bq public licen[sc]e
ecl-2.0 3 educational \beducational community licen[sc]e
upl-1.0 3 universal \buniversal permissive licen[sc]e
blueoak-1.0.0 3 blue \bblue oak model licen[sc]e
cecill-2.1 2 cecill \bcecill(?:[- ]v?2\.1)?\b
mulan-psl-2.0 3 mulan \bmulan (?:permissive software|psl)
hippocratic 3 hippocratic \bhippocratic licen[sc]e
anti-996 2 996 \banti-?996 licen[sc]e
openrail 2 rail \b(?:bigscience |creativeml )?open ?rail(?:-m|\+\+-m)?\b
rail 3 responsible \bresponsible ai licen[sc]e
llama-community 3 llama \bllama [0-9.]* ?community licen[sc]e
gemma-terms 3 gemma \bgemma terms of use
beerware 2 beer \bbeer-?ware licen[sc]e\b
vim 3 vim \bvim licen[sc]e\b
tcl 3 tcl \btcl/tk licen[sc]e\b
nasa-1.3 3 nasa \bnasa open source agreement
intel-acpi 3 intel \bintel open source licen[sc]e
json 4 evil the software shall be used for good, not evil
public-domain 3 domain (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain 1 domain \bpublic domain\b
proprietary 4 reproduced no part of this (?:publication|work|document) may be reproduced
proprietary 3 reserved \ball rights reserved\b
proprietary 3 proprietary \bproprietary and confidential\b
commercial 1 commercial \bcommercial licen[sc]e\b
noncommercial 1 commercial \bnon-?commercial (?:use )?only\b
spdx 1 spdx spdx-license-identifier: [a-z0-9.+-]+
copyright 1 copyright \bcopyright (?:\(c\)|©)? ?[0-9]{4}
licensed 1 licensed \blicensed under\b
licensed 1 licence \bunder (?:the|this) licence\b
licensed 1 license \bunder (?:the|this) license\b
"""


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regular expression) in order."""
    rows = [line.split(" ", 3) for line in RULES_TEXT.strip().split("\n")]
    return [(label, int(priority), keyword, pattern.replace(" ?", f"{_BLANK}*").replace(" ", f"{_BLANK}+")) for label, priority, keyword, pattern in rows]
