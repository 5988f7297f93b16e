"""Licence signature rules, in order of priority.

A rule is (label, kind, confidence, keywords, pattern). Patterns run over a text's words joined by single spaces:
lower case, punctuation gone, so "GPL-2.0-only" reads "gpl 2 0 only". All keywords of a rule are literal parts
of anything that its pattern can match; a text without them never meets the pattern. Of overlapping detections
one that lies inside another of the same or a higher rank is suppressed. Ranks: identifier tags, then names with
versions, then grant sentences, then bare names.
"""

from __future__ import annotations

# Families with versions: (label stem, keyword, name pattern, versions). One rule for each version, with the
# suffixes "only" and "or later" as labels of their own where a family has them.
_VERSIONED = [
    ("gpl", "general public license", r"(?:gnu )?general public license", ("1.0", "2.0", "3.0"), True),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1.0", "2.0", "3.0"), True),
    ("lgpl", "lesser general public license", r"(?:gnu )?lesser general public license", ("2.1", "3.0"), True),
    ("lgpl", "library general public license", r"(?:gnu )?library general public license", ("2.0",), True),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2.0", "2.1", "3.0"), True),
    ("agpl", "affero general public license", r"(?:gnu )?affero general public license", ("1.0", "3.0"), True),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1.0", "3.0"), True),
    ("gfdl", "free documentation license", r"(?:gnu )?free documentation license", ("1.1", "1.2", "1.3"), True),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ("1.0", "1.1", "2.0"), False),
    ("mpl", "mozilla public license", r"mozilla public license", ("1.0", "1.1", "2.0"), False),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0"), False),
    ("epl", "eclipse public license", r"eclipse public license", ("1.0", "2.0"), False),
    ("eupl", "european union public licen", r"european union public licen[cs]e", ("1.0", "1.1", "1.2"), False),
    ("cddl", "common development and distribution license", r"common development and distribution license", ("1.0", "1.1"), False),
    ("cpl", "common public license", r"common public license", ("1.0",), False),
    ("osl", "open software license", r"open software license", ("1.0", "2.0", "2.1", "3.0"), False),
    ("afl", "academic free license", r"academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0"), False),
    ("artistic", "artistic license", r"(?:the )?artistic license", ("1.0", "2.0"), False),
    ("apsl", "apple public source license", r"apple public source license", ("1.0", "1.1", "1.2", "2.0"), False),
    ("bsl", "boost software license", r"boost software license", ("1.0",), False),
    ("busl", "business source license", r"business source license", ("1.0", "1.1"), False),
    ("sspl", "server side public license", r"server side public license", ("1.0",), False),
    ("ofl", "open font license", r"(?:sil )?open font license", ("1.0", "1.1"), False),
    ("zpl", "zope public license", r"zope public license", ("1.1", "2.0", "2.1"), False),
    ("lppl", "latex project public license", r"latex project public license", ("1.0", "1.1", "1.2", "1.3"), False),
    ("php", "php license", r"php license", ("3.0", "3.01"), False),
    ("python", "python software foundation license", r"python software foundation license", ("2.0",), False),
    ("cecill", "cecill", r"cecill(?: license)?", ("1.0", "1.1", "2.0", "2.1"), False),
    ("mulan-psl", "mulan", r"mulan (?:psl|permissive software license)", ("1.0", "2.0"), False),
    ("odc-by", "open data commons attribution", r"open data commons attribution(?: license)?", ("1.0",), False),
    ("odbl", "open database license", r"open database license", ("1.0",), False),
    ("cc0", "cc0", r"cc0", ("1.0",), False),
]

# Grant, condition and notice sentences, one by one: label | keyword | pattern.
_SENTENCES = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | without restriction | deal in the software without restriction including without limitation
mit | copyright notice and this permission | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included
mit | to whom the software is furnished | permit persons to whom the software is furnished to do so
mit | under the mit license | (?:released|distributed|licensed|available|published|provided|licenced) under the mit license
mit | under the terms of the mit | under the terms of the mit licen[sc]e
mit-0 | mit no attribution | mit no attribution(?: license)?
mit-modern | without written agreement | without written agreement and without license or royalty fees
x11 | shall not be used in advertising | name of (?:the )?[a-z0-9 ]{1,60}? shall not be used in advertising or otherwise to promote
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose
isc | with or without fee is hereby granted | with or without fee is hereby granted provided that the above copyright notice
isc | resulting from loss of use | damages whatsoever resulting from loss of use data or profits
isc | under the isc license | (?:released|distributed|licensed|available) under the isc license
0bsd | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
hpnd | appear in all copies | that the above copyright notice appear in all copies and that both that copyright notice
hpnd | makes no representations | makes no representations about the suitability of this software
hpnd | without specific written prior permission | without specific written prior permission
bsd | redistribution and use in source | redistribution and use in source and binary forms(?: with or without modification)?
bsd | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd | under the bsd license | (?:released|distributed|licensed|available) under the bsd license
bsd | bsd style license | (?:under|has|with) a bsd style license
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license)?
bsd-2-clause | simplified bsd | simplified bsd(?: license)?
bsd-2-clause | freebsd license | freebsd license
bsd-2-clause | two clause bsd | two clause bsd(?: license)?
bsd-2-clause | 2 clause bsd | 2 clause bsd(?: license)?
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived
bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license)?
bsd-3-clause | 3 clause bsd | 3 clause bsd(?: license)?
bsd-3-clause | three clause bsd | three clause bsd(?: license)?
bsd-3-clause | new bsd license | new bsd license
bsd-3-clause | modified bsd license | modified bsd license
bsd-3-clause | revised bsd license | revised bsd license
bsd-3-clause-clear | no express or implied licenses | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | advertising materials | all advertising materials mentioning features
bsd-4-clause | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4-clause | original bsd license | original bsd license
bsd-1-clause | bsd 1 clause | bsd 1 clause(?: license)?
apache-2.0 | apache license | licensed under the apache license version 2 0 the license
apache-2.0 | apache org licenses | (?:www )?apache org licenses license 2 0
apache-2.0 | compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | apache 2 0 | apache 2 0(?: licen[sc]e)?
apache-2.0 | apache v2 | apache v2(?: 0)?(?: licen[sc]e)?
apache-2.0 | apachev2 | apachev2
apache-2.0 | asl 2 0 | asl 2 0
apache-2.0 | agreed to in writing software | unless required by applicable law or agreed to in writing software
apache-2.0 | contributor license agreements | licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1 | developed by the apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | apache group | this product includes software developed by the apache group
gpl | free software you can redistribute | is free software you can redistribute it and or modify it under the terms of the gnu
gpl | will be useful but without | will be useful but without any warranty
gpl | gnu org licenses | (?:www )?gnu org licenses(?: gpl)?
gpl | copy of the gnu general public license | received a copy of the gnu general public license
gpl | under the gpl | (?:released|distributed|licensed|available|covered) under the gpl
gpl-1.0-or-later | any later version | gnu general public license as published by the free software foundation either version 1 (?:of the license )?or (?:at your option )?any later version
gpl-2.0-or-later | any later version | gnu general public license as published by the free software foundation either version 2 (?:of the license )?or (?:at your option )?any later version
gpl-3.0-or-later | any later version | gnu general public license as published by the free software foundation either version 3 (?:of the license )?or (?:at your option )?any later version
gpl-2.0-only | free software foundation version 2 | gnu general public license(?: version 2)? as published by the free software foundation version 2(?: of the license)?(?! or)
gpl-3.0-only | free software foundation version 3 | gnu general public license(?: version 3)? as published by the free software foundation version 3(?: of the license)?(?! or)
gpl-2.0 | general public license version 2 as | gnu general public license version 2 as published by the free software foundation
gpl-3.0 | general public license version 3 as | gnu general public license version 3 as published by the free software foundation
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?! or)
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?! or)
gpl-1.0 | gplv1 | (?:gnu )?gplv1(?! or)
gpl-2.0-or-later | gplv2 or | (?:gnu )?gplv2 or (?:any )?later(?: version)?
gpl-3.0-or-later | gplv3 or | (?:gnu )?gplv3 or (?:any )?later(?: version)?
gpl-2.0 | gpl2 | (?:gnu )?gpl2
gpl-3.0 | gpl3 | (?:gnu )?gpl3
gpl-classpath-exception | classpath exception | (?:gpl |gnu )?classpath exception
gpl-classpath-exception | as a special exception | as a special exception the copyright holders of this library give you permission to link
gpl-gcc-exception | gcc runtime library exception | gcc runtime library exception
gpl-font-exception | embed this font | create a document which uses this font and embed this font
gpl-openssl-exception | openssl | permission to link the code of (?:portions of )?this program with the openssl library
lgpl | terms of the gnu lesser general public | under the terms of the gnu lesser general public licen[sc]e
lgpl | terms of the gnu library general public | under the terms of the gnu library general public licen[sc]e
lgpl | under the lgpl | (?:released|distributed|licensed|available|covered) under the lgpl
lgpl-2.0-or-later | any later version | gnu library general public license as published by the free software foundation either version 2 (?:of the license )?or (?:at your option )?any later version
lgpl-2.1-or-later | any later version | gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or (?:at your option )?any later version
lgpl-3.0-or-later | any later version | gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or (?:at your option )?any later version
lgpl-2.0 | lgplv2 | (?:gnu )?lgplv2(?! 1| or)
lgpl-2.1 | lgplv2 1 | (?:gnu )?lgplv2 1(?! or)
lgpl-2.1-or-later | lgplv2 1 or | (?:gnu )?lgplv2 1 or (?:any )?later(?: version)?
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3(?! or)
lgpl-3.0-or-later | lgplv3 or | (?:gnu )?lgplv3 or (?:any )?later(?: version)?
agpl | terms of the gnu affero general public | under the terms of the gnu affero general public licen[sc]e
agpl-3.0-or-later | any later version | gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or (?:at your option )?any later version
agpl-3.0 | agplv3 | (?:gnu )?agplv3(?! or)
agpl-3.0-or-later | agplv3 or | (?:gnu )?agplv3 or (?:any )?later(?: version)?
agpl | remote network interaction | remote network interaction use with the gnu general public license
gfdl | copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl | subject to the mozilla public license | the contents of this file are subject to the mozilla public license
mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-2.0 | mozilla org mpl | (?:http|https) (?:www )?mozilla org mpl 2 0
mpl-2.0 | mplv2 | mplv2(?: 0)?
mpl-1.1 | tri license | mpl 1 1 gpl 2 0 lgpl 2 1 tri license
npl | netscape public license | netscape public license(?: version 1 [01])?
epl-1.0 | eclipse org legal epl v10 | eclipse org legal epl v10(?: html)?
epl-2.0 | eclipse org legal epl 2 0 | (?:www )?eclipse org legal epl 2 0
epl | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the eclipse public license
edl-1.0 | eclipse distribution license | eclipse distribution license(?: v(?:ersion)? ?1 0)?
cddl | subject to the terms of the common development | the contents of this file are subject to the terms of the common development and distribution license
cddl | cddl license | cddl license txt
eupl | licensed under the eupl | licensed under the eupl(?: version 1 [012])?
ipl-1.0 | ibm public license | ibm public license(?: version 1 0)?
spl-1.0 | sun public license | sun public license(?: version 1 0)?
sissl | sun industry standards source license | sun industry standards source license(?: version 1 [12])?
qpl-1.0 | q public license | q public license(?: version 1 0)?
osl | academic free license and open software license | academic free license and open software license
ms-pl | microsoft public license ms pl | microsoft public license ms pl
ms-rl | microsoft reciprocal license ms rl | microsoft reciprocal license ms rl
ms-eula | microsoft software license terms | microsoft software license terms
zlib | provided as is without any express | this software is provided as is without any express or implied warranty
zlib | altered source versions | altered source versions must be plainly marked
zlib | origin of this software must not be | the origin of this software must not be misrepresented
zlib | removed or altered from any source | this notice may not be removed or altered from any source distribution
libpng | png reference library | the png reference library is supplied as is
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
bsl-1.0 | boost software license | distributed under the boost software license version 1 0
bsl-1.0 | boost org license 1 0 | (?:www )?boost org license 1 0 txt
unlicense | unencumbered software | free and unencumbered software released into the public domain
unlicense | dedicate any and all copyright interest | dedicate any and all copyright interest in the software to the public domain
unlicense | unlicense org | (?:www )?unlicense org
wtfpl | what the fuck you want | do what the fuck you want to(?: public license)?
wtfpl | wtfpl version 2 | wtfpl version 2
beerware | buy me a beer | you can buy me a beer in return
beerware | beer ware license revision | the beer ware license revision 42
cc0-1.0 | cc0 1 0 universal | cc0 1 0 universal(?: public domain dedication)?
cc0-1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | waived all copyright | has waived all copyright and related or neighboring rights
cc-by-4.0 | attribution 4 0 international | (?:creative commons )?attribution 4 0 international
cc-by-sa-4.0 | sharealike 4 0 international | (?:creative commons )?attribution sharealike 4 0 international
cc-by-nc-4.0 | noncommercial 4 0 international | (?:creative commons )?attribution noncommercial 4 0 international
cc-by-nd-4.0 | noderivatives 4 0 international | (?:creative commons )?attribution noderivatives 4 0 international
cc-by-nc-sa-4.0 | noncommercial sharealike 4 0 | (?:creative commons )?attribution noncommercial sharealike 4 0 international
cc-by-nc-nd-4.0 | noncommercial noderivatives 4 0 | (?:creative commons )?attribution noncommercial noderivatives 4 0 international
cc-by-sa-3.0 | sharealike 3 0 unported | (?:creative commons )?attribution sharealike 3 0 unported
cc-by-3.0 | attribution 3 0 unported | (?:creative commons )?attribution 3 0 unported
cc | creativecommons org licenses | creativecommons org licenses
cc | under a creative commons | (?:is |are )?licensed under a creative commons
public-domain | public domain | (?:released into|dedicated to|placed in|is in|belongs to|entered) the public domain
public-domain | public domain mark | public domain mark(?: 1 0)?
public-domain | no copyright reserved | no copyright reserved
public-domain | works of the united states government | works of the united states government are not subject to copyright
openssl | openssl toolkit | developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software written by eric young | includes cryptographic software written by eric young
php-3.01 | php software freely available | this product includes php software freely available from
python-2.0 | psf license agreement | psf license agreement for python
python-2.0 | python software foundation license version 2 | python software foundation license version 2
artistic | same terms as perl itself | (?:redistribute|distribute|modify) it (?:and or modify it )?under the same terms as perl itself
artistic-2.0 | artistic license 2 0 | the artistic license 2 0
ruby | same terms as ruby | under the same terms as ruby(?: itself)?
tcl | tcl tk license | tcl tk license(?: terms)?
vim | vim license | under the (?:terms of the )?vim license
ofl-1.1 | sil open font license version 1 1 | licensed under the sil open font license version 1 1
ofl | reserved font name | with reserved font name
ofl-1.1 | scripts sil org ofl | scripts sil org ofl
postgresql | in no event shall the university of california | in no event shall the university of california be liable to any party
ncsa | university of illinois | university of illinois ncsa open source license
w3c | w3c software notice | w3c software notice and (?:document )?license
unicode | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
icu | icu license icu | icu license icu 1 8 1 and later
json | good not evil | the software shall be used for good not evil
curl | permission to use copy modify and distribute this software for any purpose with or without fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above
upl-1.0 | universal permissive license | (?:the )?universal permissive license(?: upl)?(?: version 1 0)?
ecl-2.0 | educational community license | educational community license(?: version 2 0)?
mulanpsl-2.0 | licensed under mulan psl v2 | licensed under mulan psl v2
sspl-1.0 | mongodb | server side public license version 1 as published by mongodb
elastic-2.0 | elastic license 2 0 | elastic license 2 0
busl-1.1 | change license | on the change date (?:or the fourth anniversary )?[a-z0-9 ]{0,80}?change license
commons-clause | commons clause | commons clause(?: license)? condition
polyform | polyform noncommercial license | polyform noncommercial license(?: 1 0 0)?
odbl-1.0 | opendatacommons org licenses odbl | opendatacommons org licenses odbl
odc-by-1.0 | opendatacommons org licenses by | opendatacommons org licenses by 1 0
pddl-1.0 | public domain dedication and license | public domain dedication and license(?: pddl)?
ogl-uk | open government licence | open government licence(?: v(?:ersion)? ?[123](?: 0)?)?
etalab | licence ouverte | licence ouverte(?: open licence)?
cecill | régi par la licence cecill | régi par la licence cecill
eupl | europäische union | open source lizenz für die europäische union
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized copying | unauthorized copying of this file
proprietary | not be reproduced | may not be reproduced(?: or distributed)?
proprietary | prior written permission | without (?:the )?(?:express |specific )?prior written permission
proprietary | prior written consent | without (?:the )?(?:express )?prior written consent
proprietary | internal use only | (?:for )?internal use only
proprietary | trade secrets | contains (?:the )?(?:confidential|proprietary)[a-z ]{0,40} trade secrets
proprietary | strictly prohibited | (?:reproduction|copying|distribution|redistribution|use|reprinting) [a-z ]{0,60}is strictly prohibited
proprietary | end user license agreement | end user license agreement
proprietary | commercial license | (?:under|requires|obtain|purchase) a (?:separate )?commercial license
proprietary | not for redistribution | not for redistribution
non-commercial | non commercial use only | (?:for )?non commercial use only
non-commercial | noncommercial purposes | for noncommercial purposes(?: only)?
non-commercial | personal use only | for (?:your )?personal use only
non-commercial | research purposes only | for (?:academic |scientific )?research purposes only
non-commercial | educational purposes only | for educational purposes only
warranty-disclaimer | warranties or conditions | without warranties or conditions of any kind
warranty-disclaimer | without warranty of any kind | as is without warranty of any kind
warranty-disclaimer | liable for any claim | be liable for any claim damages or other liability
warranty-disclaimer | merchantability | (?:implied )?warrant(?:y|ies) of merchantability
warranty-disclaimer | fitness for a particular purpose | fitness for a particular purpose
warranty-disclaimer | disclaims all warranties | disclaims all warranties
warranty-disclaimer | liable for any direct indirect | in no event shall [a-z0-9 ]{1,80}?be liable for any direct indirect
patent | patent license | perpetual worldwide non exclusive no charge royalty free irrevocable [a-z ]{0,40}?patent license
copyright | copyright | copyright (?:c |© |by )?(?:19|20)[0-9][0-9]
copyright | copyright | copyright (?:c |© )?[a-z0-9]+ (?:19|20)[0-9][0-9]
copyright | © | © (?:copyright )?(?:19|20)[0-9][0-9]
copyright | copyright holder | copyright holders? and contributors
licensed | licensed under | (?:is |are )?licensed under the(?: terms of the)?
licensed | see the license | see the license (?:file )?for
licensed | license file | see (?:the )?(?:accompanying |included )?license file
licensed | subject to the terms | subject to the terms (?:and conditions )?of
licensed | distributed under | (?:is |are )?distributed under the(?: terms of the)?
licensed | released under | (?:is |are )?released under the(?: terms of the)?
licensed | dual licensed | (?:is |are )?dual licensed(?: under)?
licensed | license agreement | license agreement
reserved | some rights reserved | some rights reserved
reserved | rights not expressly granted | all rights not expressly granted (?:herein )?are reserved
"""

# Bare names: (label, name pattern); the whole name without its optional parts is the keyword.
_NAMES = [
    ("gpl", "general public license"), ("gpl", "gnu gpl"), ("lgpl", "gnu lgpl"), ("agpl", "gnu agpl"), ("mit", "mit license"),
    ("isc", "isc license"), ("bsd", "bsd license"), ("bsd", "bsd style license"), ("apache", "apache license"), ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"), ("zlib", "zlib license"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("ofl", "open font license"),
    ("artistic", "artistic license"), ("cc", "creative commons"), ("cc0", "cc0"), ("openssl", "openssl license"), ("x11", "x11 license"),
    ("curl", "curl license"), ("ncsa", "university of illinois ncsa open source license"), ("postgresql", "postgresql license"),
    ("ruby", "ruby license"), ("perl", "same terms as perl itself"), ("json", "shall be used for good not evil"), ("beerware", "beer ware license"),
    ("ms-pl", "microsoft public license"), ("ms-rl", "microsoft reciprocal license"), ("ijg", "independent jpeg group"),
    ("libpng", "libpng license"), ("icu", "icu license"), ("vim", "vim license"), ("unicode", "unicode license agreement"), ("w3c", "w3c software notice"),
    ("reserved", "all rights reserved"), ("reserved", "alle rechte vorbehalten"), ("reserved", "tous droits réservés"),
    ("reserved", "todos los derechos reservados"),
]

# Identifiers as they stand after an SPDX tag.
_SPDX = (
    "0bsd aal afl-3.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 "
    "beerware bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 "
    "epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.2-only gfdl-1.3-only gpl-1.0-only gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later "
    "hpnd icu ijg ipl-1.0 isc jasper-2.0 json lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later libpng "
    "lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby "
    "sleepycat sspl-1.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1"
).split()

RANK_TAG, RANK_VERSION, RANK_SENTENCE, RANK_NAME = range(4)


def _spoken(version: str) -> str:
    """A version as words: "2.0" stands as "2", "v2", "v 2 0", "2 0" or "version 2 0"."""
    major, _, minor = version.partition(".")
    tail = "(?: 0)?" if minor == "0" else f" {minor}"
    return rf"(?: version| ver| v)? v?{major}{tail}(?! [0-9](?: |$))"


def rules() -> list[tuple[str, int, float, tuple[str, ...], str]]:
    """All rules, in order: (label, rank, confidence, keywords, pattern)."""
    out = []
    for name in _SPDX:
        words = name.replace("-", " ").replace(".", " ")
        # A tag has an expression of identifiers; each of them is a detection.
        out.append((name, RANK_TAG, 1.0, ("spdx license identifier",), rf"spdx license identifier (?:(?:(?!(?:or|and|with) )[a-z0-9]+ ){{1,6}}(?:or|and|with) )*?({words})(?! [0-9]| only| or later| clause)"))
    for stem, keyword, name, versions, later in _VERSIONED:
        for v in versions:
            said = name + _spoken(v)
            if later:
                out.append((f"{stem}-{v}-or-later", RANK_VERSION, 0.95, (keyword, "later"), rf"{said} or (?:at your option )?(?:any )?later(?: version)?"))
                out.append((f"{stem}-{v}-only", RANK_VERSION, 0.95, (keyword, "only"), rf"{said} only"))
            out.append((f"{stem}-{v}", RANK_VERSION, 0.9, (keyword,), said))
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        dashed = parts.replace(" ", "-")
        for prefix in ("cc", "creative commons"):
            out.append((f"cc-{dashed}", RANK_NAME, 0.8, (f"{prefix} {parts}",), f"{prefix} {parts}"))
            for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
                said = f"{prefix} {parts}" + _spoken(v).replace("(?: version| ver| v)? v?", " ")
                out.append((f"cc-{dashed}-{v}", RANK_VERSION, 0.95, (f"{prefix} {parts}",), said))
        spelt = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}
        out.append((f"cc-{dashed}", RANK_NAME, 0.8, ("creative commons attribution",), "creative commons " + " ".join(spelt[p] for p in parts.split())))
    for line in _SENTENCES.strip().splitlines():
        label, keyword, p = line.split(" | ")
        out.append((label, RANK_SENTENCE, 0.7 if label not in ("copyright", "licensed", "reserved") else 0.3, (keyword,), p))
    for label, p in _NAMES:
        out.append((label, RANK_NAME, 0.6 if label != "reserved" else 0.5, (p,), p))
    return sorted(out, key=lambda r: r[1])
