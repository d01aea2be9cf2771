"""Signature rules for licences, written by hand, over words in lower case that one space separates.

A line is ``label | keyword | pattern``; a pattern is only tried on texts that hold its keyword. Rules are in order: an earlier one has
priority. ``{2}`` and ``{2.1}`` stand for a version with or without "version", "v" or a closing zero, ``{+}`` for "or any later version",
``{w5}`` for up to five words, ``{the}`` for an article or none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases that always count as places of their label (fixed by contract).
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

#: Kinds of rules from strongest to weakest, with what a finding is worth.
KINDS = {"text": 1.0, "notice": 0.95, "tag": 0.9, "name": 0.8, "phrase": 0.6}

#: Sentences that only the licence's own text has.
TEXT = """
agpl-3.0 | remote network interaction | remote network interaction use with the gnu general public license
agpl-3.0 | interacting with it remotely | all users interacting with it remotely through a computer network
apache-2.0 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants
apache-2.0 | grant of copyright license | grant of copyright license subject to the terms and conditions of this license each contributor
apache-2.0 | terms and conditions for use reproduction | terms and conditions for use reproduction and distribution
apache-1.1 | this product includes software developed | this product includes software developed by the apache software foundation
artistic-2.0 | everyone is permitted to copy | artistic license 2 0 {w12}everyone is permitted to copy and distribute verbatim copies
artistic-1.0 | reasonable copying fee | reasonable copying fee is whatever you can justify
afl-3.0 | academic free license | this academic free license the license applies to any original work of authorship
beerware | buy me a beer | you can buy me a beer in return
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-2-clause | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions
bsd-3-clause | endorse or promote products | neither the names? of {w16}(?:may|nor) {w12}be used to endorse or promote products
bsd-3-clause | endorse or promote products | names? of (?:the )?(?:author|copyright holder|authors|university) {w8}may not be used to endorse or promote products
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display
bsd-3-clause-clear | no express or implied licenses to any | no express or implied licenses to any party s patent rights are granted
0bsd | with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
isc | with or without fee is hereby granted | permission to use copy modify (?:and or |and )?distribute this software {w8}for any purpose with or without fee is hereby granted provided
bsl-1.0 | the software and accompanying documentation | obtaining a copy of the software and accompanying documentation covered by this license
busl-1.1 | change license | effective on the change date {w24}the licensor hereby grants you rights under the terms of the change license
cc0-1.0 | statement of purpose | statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright
cc0-1.0 | waived all copyright | waived all copyright and related or neighboring rights
cc-by-4.0 | creative commons attribution 4 0 international public license | creative commons attribution 4 0 international public license
cc-by-sa-4.0 | creative commons attribution sharealike 4 0 international public license | creative commons attribution sharealike 4 0 international public license
cc-by-nc-4.0 | creative commons attribution noncommercial 4 0 international public license | creative commons attribution noncommercial 4 0 international public license
cddl-1.0 | common development and distribution license cddl | common development and distribution license cddl {1}
cecill-2.1 | contrat de licence | contrat de licence de logiciel libre cecill
cpal-1.0 | common public attribution license | common public attribution license version 1 0 cpal
ecl-2.0 | educational community license | educational community license version 2 0 {w12}grant of copyright license
epl-2.0 | accompanying program is provided | the accompanying program is provided under the terms of this eclipse public license
eupl-1.2 | european union public licence | this european union public licence the eupl applies to the work
gfdl-1.3 | invariant sections | with no invariant sections no front cover texts and no back cover texts
gpl-2.0 | the licenses for most software | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | is a free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
lgpl-2.1 | first released version of the lesser | this is the first released version of the lesser gpl
lgpl-3.0 | additional permissions listed below | supplemented by the additional permissions listed below
hpnd | disclaims all warranties with regard | disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
libpng | png reference library | the png reference library is supplied as is
mit | permission is hereby granted free | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | without restriction including without limitation the rights | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit | the above copyright notice and this permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
mpl-2.0 | covered software is provided | covered software is provided under this license on an as is basis
mpl-1.1 | the contents of this file are subject | the contents of this file are subject to the mozilla public license version 1 1
ms-pl | this license governs use of the accompanying | this license governs use of the accompanying software if you use the software you accept this license
mulanps-2.0 | mulan psl | mulan psl v2 {w24}you can use this software according to the terms
ncsa | deal with the software without | to deal with the software without restriction including without limitation
npl-1.1 | netscape public license | subject to the netscape public license version 1 1
ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font names?
odbl-1.0 | open database license | this database is made available under the open database license
openssl | openssl project for use | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | the name php must not | the name php must not be used to endorse or promote products
postgresql | university of california be liable | in no event shall the university of california be liable to any party for direct indirect special incidental
psf-2.0 | psf is making python | psf is making python available to licensee on an as is basis
python-2.0 | stichting mathematisch centrum | stichting mathematisch centrum {w12}amsterdam
ruby | you may redistribute it and or | you may redistribute it and or modify it under either the terms of the {w8}or the conditions below
sleepycat | redistributions in any form must | redistributions in any form must be accompanied by information on how to obtain complete source code
sspl-1.0 | service source code | making the functionality of the program {w16}available to third parties as a service {w40}service source code
unicode | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
upl-1.0 | universal permissive license | subject to the condition set forth below permission is hereby granted to any person {w40}universal permissive license
vim | no restrictions on distributing | there are no restrictions on distributing unmodified copies of vim
w3c | w3c software | w3c software notice and license
wtfpl | do what the fuck | you just do what the fuck you want to
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented
zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zpl-2.1 | zope public license | zope public license zpl {2.1}
"""

#: Notices that put a work under a licence.
NOTICE = """
agpl-3.0-or-later | affero | under the terms of {the}gnu affero general public license {w14}{3} {+}
agpl-3.0 | affero | (?:licensed|released|distributed|available) under {the}gnu affero general public license {w3}{3}
apache-2.0 | apache | (?:licensed|released|distributed|available|published) under {the}apache license {2}
apache-2.0 | apache | (?:licensed|released|distributed|available|published) under {the}apache {2}(?: license)?
apache-1.1 | apache | (?:licensed|released|distributed|available) under {the}apache (?:software )?license {1.1}
artistic-2.0 | artistic | (?:licensed|released|distributed|available) under {the}artistic license {2}
bsd-2-clause | bsd | (?:licensed|released|distributed|available) under {the}(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) license
bsd-3-clause | bsd | (?:licensed|released|distributed|available) under {the}(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd) license
bsd | bsd | (?:licensed|released|distributed|available) under {the}bsd(?: style)? licen[sc]e
bsl-1.0 | boost | distributed under {the}boost software license {1}
busl-1.1 | business source license | (?:licensed|released|governed) (?:under|by) {the}business source license
cc0-1.0 | cc0 | (?:licensed|released|dedicated|available|published) (?:under|using|with) {the}(?:creative commons )?cc0
cc-by-nc-nd-4.0 | nc nd | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by nc nd {4}
cc-by-nc-sa-4.0 | nc sa | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by nc sa {4}
cc-by-nc-4.0 | cc by nc | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by nc {4}
cc-by-nd-4.0 | cc by nd | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by nd {4}
cc-by-sa-4.0 | cc by sa | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by sa {4}
cc-by-sa-3.0 | cc by sa | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by sa {3}
cc-by-4.0 | cc by | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by {4}
cc-by-3.0 | cc by | (?:licensed|released|distributed|available|published) under {the}(?:a )?cc by {3}
cc-by-4.0 | creative commons | licensed under {the}(?:a )?creative commons attribution {4} international
cc-by-sa-4.0 | creative commons | licensed under {the}(?:a )?creative commons attribution share ?alike {4} international
cc-by-nc-4.0 | creative commons | licensed under {the}(?:a )?creative commons attribution non ?commercial {4} international
cc-by-nc-sa-4.0 | creative commons | licensed under {the}(?:a )?creative commons attribution non ?commercial share ?alike {4} international
cc-by-nd-4.0 | creative commons | licensed under {the}(?:a )?creative commons attribution no ?derivatives {4} international
cc-by-nc-nd-4.0 | creative commons | licensed under {the}(?:a )?creative commons attribution non ?commercial no ?derivatives {4} international
cc-by-sa-3.0 | creative commons | (?:licensed|available) under {the}(?:a )?creative commons attribution share ?alike {3}(?: unported)?(?: license)?
cc-by-3.0 | creative commons | (?:licensed|available) under {the}(?:a )?creative commons attribution {3}(?: unported)?(?: license)?
cddl-1.0 | common development | subject to the terms of {the}common development and distribution license
cpl-1.0 | common public license | under the terms of {the}common public license {1}
cecill | cecill | governed by the cecill(?: [bc])? license
epl-1.0 | eclipse | under the terms of {the}eclipse public license {1}
epl-2.0 | eclipse | under the terms of {the}eclipse public license {2}
epl | eclipse | (?:licensed|released|available) under {the}eclipse public license
eupl-1.2 | eupl | licensed under {the}eupl
gfdl | free documentation license | under the terms of {the}gnu free documentation license
gpl-3.0-or-later | general public license | under the terms of {the}gnu general public license {w14}{3} {w8}{+}
gpl-2.0-or-later | general public license | under the terms of {the}gnu general public license {w14}{2} {w8}{+}
gpl-3.0 | general public license | (?:licensed|released|distributed|available|published) under {the}gnu general public license {3}
gpl-2.0 | general public license | (?:licensed|released|distributed|available|published) under {the}gnu general public license {2}
gpl | general public license | (?:it under the terms of|licensed under|released under|distributed under) {the}gnu general public license
lgpl-3.0-or-later | lesser general | under the terms of {the}gnu lesser general public license {w14}{3} {w8}{+}
lgpl-2.1-or-later | lesser general | under the terms of {the}gnu lesser general public license {w14}{2.1} {w8}{+}
lgpl-3.0 | lesser general | under {the}gnu lesser general public license {3}
lgpl-2.1 | lesser general | under {the}gnu lesser general public license {2.1}
lgpl-2.0 | library general | under {the}gnu library general public license {2}
lgpl | lesser general | (?:under the terms of|licensed under|released under) {the}gnu lesser general public license
isc | isc | (?:licensed|released|distributed|available) under {the}isc license
mit | mit license | (?:licensed|released|distributed|available|published) under {the}(?:terms of the )?mit license
mit | under mit | (?:licensed|released|distributed|available|published) under mit
mit | expat | (?:licensed|released|distributed|available) under {the}expat license
mpl-2.0 | mozilla | subject to the terms of {the}mozilla public license {2}
mpl-2.0 | mozilla | (?:licensed|released|distributed|available) under {the}mozilla public license {2}
mpl-1.1 | mozilla | (?:licensed|released|distributed|available) under {the}mozilla public license {1.1}
ms-pl | microsoft public license | (?:licensed|released|available) under {the}microsoft public license
ms-rl | microsoft reciprocal license | (?:licensed|released|available) under {the}microsoft reciprocal license
ofl-1.1 | open font license | licensed under {the}sil open font license {1.1}
odbl-1.0 | odbl | (?:licensed|available) under {the}(?:open data commons )?(?:open database license )?odbl
osl-3.0 | open software license | licensed under {the}open software license {3}
php-3.01 | php license | subject to version 3 01 of {the}php license
postgresql | postgresql license | (?:licensed|released|available) under {the}postgresql license
proprietary | all rights reserved | (?:proprietary and confidential|unauthorized copying of this file) {w24}all rights reserved
proprietary | proprietary | (?:is|are) proprietary (?:and confidential )?(?:software|information) (?:of|belonging to)
public-domain | public domain | (?:released|placed|dedicated|put) (?:in|into|to) {the}public domain
public-domain | public domain | (?:this|the) (?:work|file|code|text|software|document) is (?:in|part of) {the}public domain
python-2.0 | python license | (?:licensed|released|available) under {the}python license
sspl-1.0 | server side public license | (?:licensed|released|available) under {the}server side public license
elastic-2.0 | elastic license | (?:licensed|released|available) under {the}elastic license {2}
unlicense | unlicense | (?:licensed|released|available) under {the}unlicense
upl-1.0 | universal permissive license | (?:licensed|released|available) under {the}universal permissive license
vim | vim license | (?:licensed|released|distributed) under {the}(?:terms of the )?vim license
wtfpl | wtfpl | (?:licensed|released|available) under {the}wtfpl
zlib | zlib | (?:licensed|released|available) under {the}zlib(?: libpng)? license
"""

#: Machine-readable tags and addresses.
TAG = """
0bsd | spdx | spdx license identifier 0bsd
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only)?
apache-1.1 | spdx | spdx license identifier apache 1 1
apache-2.0 | spdx | spdx license identifier apache 2 0
artistic-2.0 | spdx | spdx license identifier artistic 2 0
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsl-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
eupl-1.2 | spdx | spdx license identifier eupl 1 2
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only)?
isc | spdx | spdx license identifier isc
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only)?
mit-0 | spdx | spdx license identifier mit 0
mit | spdx | spdx license identifier mit
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
ms-pl | spdx | spdx license identifier ms pl
ofl-1.1 | spdx | spdx license identifier ofl 1 1
osl-3.0 | spdx | spdx license identifier osl 3 0
postgresql | spdx | spdx license identifier postgresql
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
zlib | spdx | spdx license identifier zlib
apache-2.0 | apache org | (?:www )?apache org licenses license 2 0
bsl-1.0 | boost org | (?:www )?boost org license 1 0
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-2.0 | creativecommons | creativecommons org licenses by 2 0
epl-1.0 | eclipse org | (?:www )?eclipse org (?:legal|org documents) epl v(?:10| ?1 0)
epl-2.0 | eclipse org | (?:www )?eclipse org legal epl (?:2 0|v20)
agpl-3.0 | gnu org | (?:www )?gnu org licenses agpl 3 0
gpl-2.0 | gnu org | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu org | (?:www )?gnu org licenses gpl 3 0
lgpl-2.1 | gnu org | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | gnu org | (?:www )?gnu org licenses lgpl 3 0
mpl-2.0 | mozilla org | mozilla org (?:en us )?mpl 2 0
mit | opensource org | opensource org licenses? mit(?: license)?
isc | opensource org | opensource org licenses? isc(?: license)?
bsd-2-clause | opensource org | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource org | opensource org licenses? bsd 3 clause
ofl-1.1 | scripts sil org | scripts sil org ofl
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | (?:www )?wtfpl net
"""

#: Names with a version.
NAME = """
agpl-3.0-or-later | affero | gnu affero general public license {w4}{3} {+}
agpl-3.0 | affero | gnu affero general public license {w4}{3}
agpl-3.0 | agpl | (?:gnu )?agpl(?: |v| v)?3(?: 0)?
apache-2.0 | apache | apache license {2}
apache-2.0 | apache | apache (?:software )?licen[sc]e {2}
apache-1.1 | apache | apache (?:software )?licen[sc]e {1.1}
artistic-2.0 | artistic | artistic license {2}
artistic-1.0 | artistic | artistic license {1}
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[sc]e
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd) licen[sc]e
0bsd | bsd | (?:zero clause bsd|bsd zero clause|0bsd) licen[sc]e
bsl-1.0 | boost | boost software license {1}
busl-1.1 | business source license | business source license {1.1}
cc0-1.0 | cc0 | cc0 {1}
cc-by-nc-nd-4.0 | nc nd | cc by nc nd {4}
cc-by-nc-nd-3.0 | nc nd | cc by nc nd {3}
cc-by-nc-sa-4.0 | nc sa | cc by nc sa {4}
cc-by-nc-sa-3.0 | nc sa | cc by nc sa {3}
cc-by-nc-4.0 | cc by nc | cc by nc {4}
cc-by-nc-3.0 | cc by nc | cc by nc {3}
cc-by-nd-4.0 | cc by nd | cc by nd {4}
cc-by-nd-3.0 | cc by nd | cc by nd {3}
cc-by-sa-4.0 | cc by sa | cc by sa {4}
cc-by-sa-3.0 | cc by sa | cc by sa {3}
cc-by-4.0 | cc by | cc by {4}
cc-by-3.0 | cc by | cc by {3}
cc-by-2.0 | cc by | cc by {2}
cddl-1.0 | cddl | cddl {1}
cddl-1.1 | cddl | cddl {1.1}
epl-1.0 | eclipse | eclipse public license {w2}{1}
epl-2.0 | eclipse | eclipse public license {w2}{2}
eupl-1.2 | eupl | eupl {1.2}
gpl-3.0-or-later | general public license | gnu general public license {w4}{3} {+}
gpl-2.0-or-later | general public license | gnu general public license {w4}{2} {+}
gpl-3.0 | general public license | gnu general public license {w2}{3}
gpl-2.0 | general public license | gnu general public license {w2}{2}
gpl-1.0 | general public license | gnu general public license {w2}{1}
gpl-3.0 | gpl | (?:gnu )?gpl(?: |v| v)3(?: 0)?
gpl-2.0 | gpl | (?:gnu )?gpl(?: |v| v)2(?: 0)?
gpl-3.0 | gplv3 | gplv3
gpl-2.0 | gplv2 | gplv2
lgpl-2.1 | lesser general | gnu lesser general public license {w2}{2.1}
lgpl-3.0 | lesser general | gnu lesser general public license {w2}{3}
lgpl-2.0 | library general | gnu library general public license {w2}{2}
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: |v| v)2 1
lgpl-3.0 | lgpl | (?:gnu )?lgpl(?: |v| v)3(?: 0)?
mpl-2.0 | mozilla | mozilla public license {w2}{2}
mpl-1.1 | mozilla | mozilla public license {w2}{1.1}
mpl-2.0 | mpl | mpl {2}
ofl-1.1 | open font license | sil open font license {1.1}
osl-3.0 | open software license | open software license {3}
php-3.01 | php license | php license {3.01}
psf-2.0 | python software foundation | python software foundation license {2}
zpl-2.1 | zope | zope public license {2.1}
"""

#: Names alone.
PHRASE = """
agpl | affero | gnu affero general public license
bsd | bsd | bsd licen[sc]e
bsl-1.0 | boost | boost software license
cc-by-nc-nd | nc nd | cc by nc nd
cc-by-nc-sa | nc sa | cc by nc sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-sa | cc by sa | cc by sa
cc-by | creative commons attribution | creative commons attribution licen[sc]e
cc-by-sa | creative commons attribution | creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial(?: licen[sc]e)?
cddl | common development | common development and distribution license
cecill | cecill | cecill(?: [bc])? licen[sc]e
epl | eclipse | eclipse public license
eupl | european union public licence | european union public licence
gfdl | free documentation license | gnu free documentation license
isc | isc | isc licen[sc]e
lgpl | lesser general | gnu lesser general public license
lgpl | library general | gnu library general public license
mpl | mozilla | mozilla public license
ms-pl | microsoft public license | microsoft public license
ofl-1.1 | open font license | (?:sil )?open font license
odbl | open database license | open database license
sspl-1.0 | server side public license | server side public license
unlicense | unlicense | {the}unlicense
zlib | zlib | zlib(?: libpng)? licen[sc]e
"""


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    kind: int
    base: bool = False


def _pattern(written: str) -> str:
    def opened(found: re.Match) -> str:
        what = found[1]
        if what == "+":
            return "(?:or (?:at your option )?(?:any )?(?:later|newer)(?: version)?)"
        if what == "the":
            return "(?:the |an? )?"
        if what[0] == "w":
            return f"(?:\\S+ ){{0,{what[1:]}}}?"
        major, _, minor = what.partition(".")
        return f"(?:version |ver |v ?)?{major}" + (f" {minor}" if minor else "(?: 0)?")

    return re.sub(r"\{(\+|the|w\d+|\d+(?:\.\d+)?)\}", opened, written)


def rules() -> list[Rule]:
    """All rules in order of priority; the base phrases come last of all."""
    out = []
    for kind, table in enumerate((TEXT, NOTICE, TAG, NAME, PHRASE)):
        for line in table.strip().splitlines():
            label, keyword, pattern = (part.strip() for part in line.split(" | "))
            out.append(Rule(label, keyword, _pattern(pattern), kind))
    return out + [Rule(label, phrase, phrase, len(KINDS) - 1, base=True) for label, phrase in BASE]
