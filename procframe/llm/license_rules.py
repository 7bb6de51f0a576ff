"""Signatures of licences, written by hand: regexes over lower-case words with one blank between.

A line is: label; keywords that a match always holds (with a version joined on, too); regex. Sections have a priority,
0 first, and a confidence. Regexes have no capturing groups and match whole words.
"""

from __future__ import annotations

SECTIONS: list[tuple[int, float, str]] = [
    # identifiers
    (0, 0.99, """
mit; spdx mit; spdx license identifier mit
mit-0; spdx mit; spdx license identifier mit 0
apache-2.0; spdx apache; spdx license identifier apache 2 0
apache-2.0-llvm; spdx apache llvm; spdx license identifier apache 2 0 with llvm exception
apache-1.1; spdx apache; spdx license identifier apache 1 1
bsd-2; spdx bsd; spdx license identifier bsd 2 clause
bsd-2-patent; spdx bsd patent; spdx license identifier bsd 2 clause patent
bsd-3; spdx bsd; spdx license identifier bsd 3 clause
bsd-3-clear; spdx bsd clear; spdx license identifier bsd 3 clause clear
bsd-4; spdx bsd; spdx license identifier bsd 4 clause
bsd-0; spdx 0bsd; spdx license identifier 0bsd
isc; spdx isc; spdx license identifier isc
zlib; spdx zlib; spdx license identifier zlib
gpl-1; spdx gpl; spdx license identifier gpl ?v? ?1(?: 0)?(?: only| or later)?
gpl-2; spdx gpl; spdx license identifier (?:gnu )?gpl(?: version)? ?v? ?2(?: 0)?(?: only| or later)?
gpl-2-classpath; spdx gpl classpath; spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2-syscall; spdx gpl syscall; spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note
gpl-3; spdx gpl; spdx license identifier (?:gnu )?gpl(?: version)? ?v? ?3(?: 0)?(?: only| or later)?
gpl-3-gcc; spdx gpl gcc; spdx license identifier gpl 3 0(?: only| or later)? with gcc exception 3 1
lgpl; spdx lgpl; spdx license identifier (?:gnu )?lgpl ?v? ?[23](?: [01])?(?: only| or later)?
agpl; spdx agpl; spdx license identifier (?:gnu )?agpl ?v? ?3(?: 0)?(?: only| or later)?
mpl-1.1; spdx mpl; spdx license identifier mpl 1 1
mpl-2.0; spdx mpl; spdx license identifier mpl 2 0(?: no copyleft exception)?
epl; spdx epl; spdx license identifier epl [12] 0
cddl; spdx cddl; spdx license identifier cddl 1 [01]
cpl; spdx cpl; spdx license identifier cpl 1 0
eupl; spdx eupl; spdx license identifier eupl 1 [12]
boost; spdx bsl; spdx license identifier bsl 1 0
busl; spdx busl; spdx license identifier busl 1 1
artistic; spdx artistic; spdx license identifier artistic [12] 0
python; spdx psf; spdx license identifier psf 2 0
python; spdx python; spdx license identifier python 2 0
php; spdx php; spdx license identifier php 3 01
postgresql; spdx postgresql; spdx license identifier postgresql
openssl; spdx openssl; spdx license identifier openssl
unlicense; spdx unlicense; spdx license identifier unlicense
wtfpl; spdx wtfpl; spdx license identifier wtfpl
cc0; spdx cc0; spdx license identifier cc0 1 0
cc-by; spdx cc; spdx license identifier cc by [1-4] [05]
cc-by-sa; spdx cc; spdx license identifier cc by sa [1-4] [05]
cc-by-nd; spdx cc; spdx license identifier cc by nd [1-4] [05]
cc-by-nc; spdx cc; spdx license identifier cc by nc [1-4] [05]
cc-by-nc-sa; spdx cc; spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd; spdx cc; spdx license identifier cc by nc nd [1-4] [05]
ofl; spdx ofl; spdx license identifier ofl 1 [01]
odbl; spdx odbl; spdx license identifier odbl 1 0
odc-by; spdx odc; spdx license identifier odc by 1 0
ncsa; spdx ncsa; spdx license identifier ncsa
ms-pl; spdx ms; spdx license identifier ms pl
ms-rl; spdx ms; spdx license identifier ms rl
upl; spdx upl; spdx license identifier upl 1 0
vim; spdx vim; spdx license identifier vim
gfdl; spdx gfdl; spdx license identifier gfdl 1 [1-3](?: only| or later)?
sspl; spdx sspl; spdx license identifier sspl 1 0
blueoak; spdx blueoak; spdx license identifier blueoak 1 0 0
mulan; spdx mulanpsl; spdx license identifier mulanpsl [12] 0
"""),
    # sentences of the licences themselves
    (1, 0.97, """
mit; permission charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; restriction sublicense; without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit; substantial portions; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0; permit furnished; to permit persons to whom the software is furnished to do so the software is provided as is
isc; permission purpose; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd; redistribution binary; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3; endorse promote; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4; advertising acknowledgement; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd; redistributions retain; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd; redistributions reproduce; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
apache-2.0; apache compliance; you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0; perpetual royalty; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0; apache license; apache license version 2 0 january 2004
apache-1.1; apache foundation; this product includes software developed by the apache software foundation
gpl; free redistribute; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2; gnu either; gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2; gnu june; gnu general public license version 2 june 1991
gpl-3; gnu either; gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3; gnu june; gnu general public license version 3 29 june 2007
lgpl; lesser gnu; gnu lesser general public license as published by the free software foundation
lgpl; library gnu; gnu library general public license as published by the free software foundation
lgpl; lesser february; gnu lesser general public license version 2 1 february 1999
agpl; affero gnu; gnu affero general public license as published by the free software foundation
agpl; affero november; gnu affero general public license version 3 19 november 2007
gpl; warranty merchantability; without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
mpl-1.1; mozilla contents; the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0; mozilla source; this source code form is subject to the terms of the mozilla public license v 2 0
epl; eclipse accompanying; this program and the accompanying materials are made available under the terms of the eclipse public license
cpl; common accompanying; this program and the accompanying materials are made available under the terms of the common public license
cddl; common development; subject to the terms of the common development and distribution license
boost; boost august; boost software license version 1 0 august 17th 2003
zlib; misrepresented origin; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; altered plainly; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense; unencumbered domain; this is free and unencumbered software released into the public domain
wtfpl; fuck want; do what the fuck you want to public license
artistic; artistic preamble; the artistic license preamble
ofl; reserved font; with reserved font name
ofl; sil font; this font software is licensed under the sil open font license
cc0; dedicated domain; dedicated the work to the public domain by waiving all of his or her rights to the work
cc-by; share transmit; you are free to share copy distribute and transmit the work
python; python foundation; python software foundation license version 2
php; php freely; this product includes php software freely available from
openssl; openssl toolkit; this product includes software developed by the openssl project for use in the openssl toolkit
ncsa; illinois ncsa; university of illinois ncsa open source license
postgresql; paragraph paragraphs; provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
x11; x consortium; except as contained in this notice the name of the x consortium shall not be used in advertising
curl; daniel stenberg; copyright and permission notice copyright c [0-9 ]{4,16}daniel stenberg
beerware; beer worth; if we meet some day and you think this stuff is worth it you can buy me a beer
json; good evil; the software shall be used for good not evil
gfdl; invariant cover; with no invariant sections no front cover texts and no back cover texts
gfdl; documentation gnu; under the terms of the gnu free documentation license
busl; business source; business source license 1 1
sspl; server side; server side public license version 1
"""),
    # notices in prose
    (1, 0.95, """
mit; licensed mit; (?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of the )?mit(?: x11| expat)?(?: license)?
mit; released mit; released under (?:the )?mit(?: license)?
mit; under mit; (?:distributed|available|provided|published) under (?:the )?(?:terms of the )?mit(?: license)?
apache-2.0; licensed apache; (?:is |are )?licensed under (?:the )?(?:terms of the )?apache (?:software )?(?:license )?(?:version |v ?)?2(?: 0)?
apache; licensed apache; (?:is |are )?licensed under (?:the )?(?:terms of the )?apache(?: software)?(?: license)?
apache-2.0; released apache; released under (?:the )?apache (?:license )?(?:version |v ?)?2(?: 0)?
apache; under apache; (?:distributed|available|provided|published) under (?:the )?(?:terms of the )?apache(?: license)?
bsd-2; licensed bsd; (?:is |are )?licensed under (?:the |a )?(?:terms of the )?bsd 2 clause(?: license)?
bsd-3; licensed bsd; (?:is |are )?licensed under (?:the |a )?(?:terms of the )?bsd 3 clause(?: license)?
bsd-2; licensed bsd clause; (?:is |are )?licensed under (?:the |a )?(?:2|two) clause bsd(?: license)?
bsd-3; licensed bsd clause; (?:is |are )?licensed under (?:the |a )?(?:3|three) clause bsd(?: license)?
bsd; licensed bsd; (?:is |are )?licensed under (?:the |a )?(?:modified |new |revised |simplified )?bsd(?: style)?(?: license)?
bsd; released bsd; released under (?:the |a )?(?:modified |new |revised |simplified )?bsd(?: style)?(?: license)?
bsd; under bsd; (?:distributed|available|provided|published) under (?:the |a )?(?:modified |new |revised |simplified )?bsd(?: style)?(?: license)?
gpl-2; licensed gpl; (?:is |are )?licensed under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: version| ?v)? ?2(?: 0)?
gpl-3; licensed gpl; (?:is |are )?licensed under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: version| ?v)? ?3(?: 0)?
gpl; licensed gpl; (?:is |are )?licensed under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl-2; released gpl; released under (?:the )?(?:gnu )?gpl(?: version| ?v)? ?2(?: 0)?
gpl-3; released gpl; released under (?:the )?(?:gnu )?gpl(?: version| ?v)? ?3(?: 0)?
gpl; released gpl; released under (?:the )?(?:gnu )?gpl
gpl-2; under gpl; (?:distributed|available|provided|published) under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: version| ?v)? ?2(?: 0)?
gpl-3; under gpl; (?:distributed|available|provided|published) under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: version| ?v)? ?3(?: 0)?
gpl-2; licensed gnu; licensed under (?:the )?(?:terms of the )?gnu general public license(?: version| v)? ?2
gpl-3; licensed gnu; licensed under (?:the )?(?:terms of the )?gnu general public license(?: version| v)? ?3
lgpl; licensed lgpl; (?:is |are )?licensed under (?:the )?(?:terms of the )?(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
lgpl; released lgpl; released under (?:the )?(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
lgpl; under lgpl; (?:distributed|available|provided|published) under (?:the )?(?:terms of the )?(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
lgpl; lesser licensed; licensed under (?:the )?(?:terms of the )?gnu lesser general public license
agpl; licensed agpl; (?:is |are )?licensed under (?:the )?(?:terms of the )?(?:gnu )?agpl(?: ?v?3)?
agpl; released agpl; released under (?:the )?(?:gnu )?agpl(?: ?v?3)?
agpl; under agpl; (?:distributed|available|provided|published) under (?:the )?(?:terms of the )?(?:gnu )?agpl(?: ?v?3)?
agpl; affero licensed; licensed under (?:the )?(?:terms of the )?gnu affero general public license
mpl-2.0; licensed mozilla; licensed under (?:the )?(?:terms of the )?mozilla public license(?: version)?(?: 2 0)?
mpl-2.0; licensed mpl; licensed under (?:the )?mpl(?: ?v? ?2(?: 0)?)?
epl; licensed eclipse; licensed under (?:the )?(?:terms of the )?eclipse public license(?: v?[12](?: 0)?)?
epl; licensed epl; licensed under (?:the )?epl(?: ?v? ?[12](?: 0)?)?
cddl; licensed cddl; licensed under (?:the )?cddl(?: 1 [01])?
eupl; licensed eupl; licensed under (?:the )?eupl(?: 1 [12])?
isc; licensed isc; licensed under (?:the )?isc(?: license)?
zlib; licensed zlib; licensed under (?:the )?zlib(?: libpng)?(?: license)?
boost; licensed boost; licensed under (?:the )?boost software license(?: 1 0)?
boost; distributed boost; distributed under the boost software license version 1 0
artistic; licensed artistic; licensed under (?:the )?artistic(?: license)?(?: 2 0)?
perl; same perl; under the same terms as perl(?: itself)?
python; licensed psf; licensed under (?:the )?psf(?: license)?
postgresql; licensed postgresql; licensed under (?:the )?postgresql license
unlicense; released unlicense; released under (?:the )?unlicense
wtfpl; licensed wtfpl; licensed under (?:the )?wtfpl
cc0; licensed cc0; licensed under (?:the )?cc0(?: 1 0)?
cc0; released cc0; released under (?:the )?cc0(?: 1 0)?
cc-by; licensed cc; licensed under (?:a |the )?cc by(?: [1-4] [05])?
cc-by-sa; licensed cc sa; licensed under (?:a |the )?cc by sa(?: [1-4] [05])?
cc-by-nd; licensed cc nd; licensed under (?:a |the )?cc by nd(?: [1-4] [05])?
cc-by-nc; licensed cc nc; licensed under (?:a |the )?cc by nc(?: [1-4] [05])?
cc-by-nc-sa; licensed cc nc sa; licensed under (?:a |the )?cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd; licensed cc nc nd; licensed under (?:a |the )?cc by nc nd(?: [1-4] [05])?
cc-by; licensed creative; licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?
cc-by-sa; creative sharealike; creative commons attribution(?: noncommercial)? sharealike
cc-by-sa; creative share; creative commons attribution share alike
cc-by-nc; creative noncommercial; creative commons attribution noncommercial
cc-by-nc; creative commercial; creative commons attribution non commercial
cc-by-nd; creative noderivatives; creative commons attribution noderivatives
cc-by-nd; creative derivatives; creative commons attribution no derivatives
ofl; licensed ofl; licensed under (?:the )?(?:sil )?ofl
odbl; licensed odbl; licensed under (?:the )?odbl
odbl; open database; open data commons open database license
dual; dual licensed; dual licensed under
not-free; not licensed; not licensed under
not-free; no license; no license (?:express or implied )?is granted
proprietary; proprietary confidential; proprietary and confidential
proprietary; unauthorized copying; unauthorized copying of this file via any medium is strictly prohibited
"""),
    # names next to the word
    (2, 0.85, """
mit; mit license; (?:the )?mit(?: x11| expat)? license
apache-2.0; apache license; apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache; apache license; apache(?: software)? license
bsd-2; bsd clause license; bsd 2 clause license
bsd-3; bsd clause license; bsd 3 clause license
bsd; bsd license; (?:modified |new |simplified )?bsd(?: style)? license
gpl-2; gpl license; (?:gnu )?gpl(?: version| ?v)? ?2(?: 0)? license
gpl-3; gpl license; (?:gnu )?gpl(?: version| ?v)? ?3(?: 0)? license
gpl-2; gpl license; license (?:gnu )?gpl(?: version| ?v)? ?2
gpl-3; gpl license; license (?:gnu )?gpl(?: version| ?v)? ?3
gpl-2; gpl terms; under (?:the )?terms of (?:the )?(?:gnu )?gpl(?: version| ?v)? ?2
gpl-3; gpl terms; under (?:the )?terms of (?:the )?(?:gnu )?gpl(?: version| ?v)? ?3
lgpl; lgpl license; (?:gnu )?lgpl(?: ?v?[23](?: [01])?)? license
lgpl; lgpl terms; under (?:the )?terms of (?:the )?(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
lgpl; lesser license; gnu lesser general public license
agpl; agpl license; (?:gnu )?agpl(?: ?v?3)? license
agpl; agpl terms; under (?:the )?terms of (?:the )?(?:gnu )?agpl(?: ?v?3)?
agpl; affero license; gnu affero general public license
mpl-2.0; mozilla license; mozilla public license(?: version)?(?: 2 0)?
epl; eclipse license; eclipse public license(?: v?[12](?: 0)?)?
cpl; common license; common public license
eupl; european union license; european union public license
isc; isc license; isc license
zlib; zlib license; zlib(?: libpng)? license
boost; boost license; boost software license
artistic; artistic license; artistic license(?: 2 0)?
python; psf license; psf license
php; php license; php license
postgresql; postgresql license; postgresql license
cc0; cc0 license; cc0(?: 1 0)? license
cc-by; creative attribution; creative commons attribution
cc-by-nc; cc nc; cc by nc(?: [1-4] [05])?
cc-by-sa; cc sa; cc by sa(?: [1-4] [05])?
cc-by-nd; cc nd; cc by nd(?: [1-4] [05])?
ofl; sil font license; sil open font license
ms-pl; microsoft license; microsoft public license
gfdl; documentation license; gnu free documentation license
busl; business license; business source license
"""),
    # addresses
    (2, 0.9, """
mit; opensource mit; opensource org licenses mit(?: license)?
apache-2.0; apache org; apache org licenses license 2 0
apache-2.0; opensource apache; opensource org licenses apache 2 0
bsd-2; opensource bsd; opensource org licenses bsd 2 clause
bsd-3; opensource bsd; opensource org licenses bsd 3 clause
bsd; opensource bsd; opensource org licenses bsd license
isc; opensource isc; opensource org licenses isc
gpl-2; gnu old; gnu org licenses old licenses gpl 2 0
gpl-3; gnu gpl; gnu org licenses gpl 3 0
gpl; gnu copyleft; gnu org copyleft gpl
gpl; gnu gpl; gnu org licenses gpl
lgpl; gnu lgpl; gnu org licenses (?:old licenses )?lgpl
agpl; gnu agpl; gnu org licenses agpl
mpl-2.0; mozilla mpl; mozilla org (?:en us )?mpl 2 0
mpl-1.1; mozilla mpl; mozilla org mpl 1 1
epl; eclipse epl; eclipse org legal epl
cddl; opensource cddl; opensource org licenses cddl
boost; boost license; boost org license 1 0
unlicense; unlicense org; unlicense org
wtfpl; wtfpl net; wtfpl net
cc-by; creativecommons by; creativecommons org licenses by [1-4] [05]
cc-by-sa; creativecommons sa; creativecommons org licenses by sa [1-4] [05]
cc-by-nd; creativecommons nd; creativecommons org licenses by nd [1-4] [05]
cc-by-nc; creativecommons nc; creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa; creativecommons nc sa; creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd; creativecommons nc nd; creativecommons org licenses by nc nd [1-4] [05]
cc0; creativecommons zero; creativecommons org publicdomain zero 1 0
public-domain; creativecommons mark; creativecommons org publicdomain mark 1 0
ofl; sil ofl; scripts sil org ofl
odbl; opendatacommons odbl; opendatacommons org licenses odbl
postgresql; postgresql licence; postgresql org about licence
python; docs python; docs python org 3 license
"""),
    # weak words
    (3, 0.6, """
cc-by; cc by; cc by
gpl; general public license; general public license
reserved; all rights reserved; all rights reserved
"""),
    (3, 0.5, """
copyright; copyright; copyright (?:c )?(?:19|20)[0-9]{2}
copyright; copr; copr (?:19|20)[0-9]{2}
public-domain; public domain; (?:in|to|into) the public domain
reserved; some rights reserved; some rights reserved
"""),
]

#: Words that too many texts hold for a rule to wait for them alone.
COMMON = {"license", "licensed", "under", "released", "terms", "copyright", "public", "software", "org", "no", "not", "by", "open", "in", "all", "rights", "same", "good", "free"}

#: priority, confidence, label, keywords, regex
RULES: list[tuple[int, float, str, str, str]] = [(priority, confidence, *(part.strip() for part in line.split(";"))) for priority, confidence, lines in SECTIONS for line in lines.strip().splitlines()]
