"""The signature rules of operator 6: `label | keyword | pattern`, one a line.

Text is in ASCII lower case. A blank in a pattern stands for any run of characters other than letters and digits;
`<16>` for up to sixteen words of a kind that the signature leaves open, such as a name.
Every match of a pattern holds its keyword. Groups are ordered: a former one has priority over a later one.
"""

#: Sentences of the licences themselves.
GRANTS = r"""
mit | free of charge | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation
mit-0 | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction <40> to permit persons to whom the software is furnished to do so (?=the software is provided)
isc | with or without fee | permission to use copy modify (?:and or|and/or|and) distribute this software for any purpose with or without fee is hereby granted provided
0bsd | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted (?!provided)
bsd-3-clause | endorse or promote | neither the names? of <24> nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-2-clause | in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg
bsd-3-clause-clear | patent rights | no express or implied licenses to any party s patent rights are granted by this license
apache-2.0 | you may not use this file | you may not use this file except in compliance with the license
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl | free software foundation | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2.0-or-later | any later version | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | any later version | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | free software foundation | gnu general public license (?:version 2 )?as published by the free software foundation version 2(?! of the license or)
lgpl-2.1-or-later | any later version | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | any later version | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later | any later version | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later | any later version | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gfdl | invariant sections | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license <40> invariant sections
mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 0
epl-1.0 | eclipse public license | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse public license | made available under the terms of the eclipse public license (?:v )?2 0
cddl-1.0 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
zlib | origin of this software | the origin of this software must not be misrepresented
bsl-1.0 | boost software license | distributed under the boost software license version 1 0
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
wtfpl | what the fuck | you just do what the fuck you want to
cc0-1.0 | copyright | to the extent possible under law <32> has (?:waived|dedicated) all copyright and related
cc0-1.0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by | creative commons | (?:you are free to|this work is) <16> creative commons attribution (?:\d 0 )?(?:international|unported|generic)
ofl-1.1 | font software | this font software is licensed under the sil open font license
artistic-2.0 | artistic license | this (?:library|program|package) is free software you (?:can|may) redistribute it <16> artistic license 2 0
python-2.0 | licensee | psf is making python available to licensee on an as is basis
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php software | this product includes php software freely available from
ms-pl | microsoft public license | this license governs use of the accompanying software <60> microsoft public license
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
curl | copyright notice and this permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
ncsa | university of illinois | university of illinois ncsa open source license
postgresql | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
unicode | unicode inc | unicode inc license agreement data files and software
w3c | w3c | w3c software (?:notice and )?license
afl-3.0 | academic free license | licensed under the academic free license version 3 0
osl-3.0 | open software license | licensed under the open software license version 3 0
eupl-1.2 | licensed | licensed under the (?:eupl version 1 2|european union public licen[cs]e 1 2)
cecill-2.1 | cecill | governed by the cecill license <16> 2 1
qpl-1.0 | q public license | may be distributed under the terms of the q public license
sleepycat | sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code <40> sleepycat
beerware | beer | as long as you retain this notice you can do whatever you want with this stuff <24> beer
jsonlic | for good | the software shall be used for good not evil
proprietary | all rights reserved | (?:confidential and proprietary|proprietary and confidential) <16> all rights reserved
proprietary | without the express | (?:reproduction|redistribution|copying|use) <16> without the express (?:written )?(?:consent|permission) <8> is (?:strictly )?(?:prohibited|forbidden)
"""

#: Identifiers that machines read.
IDENTIFIERS = r"""
mit | spdx | spdx license identifier mit(?![a-z0-9-])
mit-0 | spdx | spdx license identifier mit-0
apache-2.0 | spdx | spdx license identifier apache-2\.0
apache-1.1 | spdx | spdx license identifier apache-1\.1
apache-1.0 | spdx | spdx license identifier apache-1\.0
bsd-2-clause | spdx | spdx license identifier bsd-2-clause
bsd-3-clause | spdx | spdx license identifier bsd-3-clause(?!-)
bsd-3-clause-clear | spdx | spdx license identifier bsd-3-clause-clear
bsd-4-clause | spdx | spdx license identifier bsd-4-clause
0bsd | spdx | spdx license identifier 0bsd
gpl-1.0-only | spdx | spdx license identifier gpl-1\.0(?:-only)?(?![+-])
gpl-2.0-only | spdx | spdx license identifier gpl-2\.0(?:-only)?(?![+-])
gpl-2.0-or-later | spdx | spdx license identifier gpl-2\.0(?:\+|-or-later)
gpl-3.0-only | spdx | spdx license identifier gpl-3\.0(?:-only)?(?![+-])
gpl-3.0-or-later | spdx | spdx license identifier gpl-3\.0(?:\+|-or-later)
lgpl-2.0-only | spdx | spdx license identifier lgpl-2\.0(?:-only)?(?![+-])
lgpl-2.0-or-later | spdx | spdx license identifier lgpl-2\.0(?:\+|-or-later)
lgpl-2.1-only | spdx | spdx license identifier lgpl-2\.1(?:-only)?(?![+-])
lgpl-2.1-or-later | spdx | spdx license identifier lgpl-2\.1(?:\+|-or-later)
lgpl-3.0-only | spdx | spdx license identifier lgpl-3\.0(?:-only)?(?![+-])
lgpl-3.0-or-later | spdx | spdx license identifier lgpl-3\.0(?:\+|-or-later)
agpl-3.0-only | spdx | spdx license identifier agpl-3\.0(?:-only)?(?![+-])
agpl-3.0-or-later | spdx | spdx license identifier agpl-3\.0(?:\+|-or-later)
gfdl | spdx | spdx license identifier gfdl-1\.[123]
mpl-1.0 | spdx | spdx license identifier mpl-1\.0
mpl-1.1 | spdx | spdx license identifier mpl-1\.1
mpl-2.0 | spdx | spdx license identifier mpl-2\.0
epl-1.0 | spdx | spdx license identifier epl-1\.0
epl-2.0 | spdx | spdx license identifier epl-2\.0
cddl-1.0 | spdx | spdx license identifier cddl-1\.0
cddl-1.1 | spdx | spdx license identifier cddl-1\.1
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
bsl-1.0 | spdx | spdx license identifier bsl-1\.0
busl-1.1 | spdx | spdx license identifier busl-1\.1
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
cc0-1.0 | spdx | spdx license identifier cc0-1\.0
cc-by-3.0 | spdx | spdx license identifier cc-by-3\.0
cc-by-4.0 | spdx | spdx license identifier cc-by-4\.0
cc-by-sa-3.0 | spdx | spdx license identifier cc-by-sa-3\.0
cc-by-sa-4.0 | spdx | spdx license identifier cc-by-sa-4\.0
cc-by-nc-4.0 | spdx | spdx license identifier cc-by-nc-4\.0
cc-by-nd-4.0 | spdx | spdx license identifier cc-by-nd-4\.0
cc-by-nc-sa-4.0 | spdx | spdx license identifier cc-by-nc-sa-4\.0
cc-by-nc-nd-4.0 | spdx | spdx license identifier cc-by-nc-nd-4\.0
ofl-1.1 | spdx | spdx license identifier ofl-1\.1
artistic-1.0 | spdx | spdx license identifier artistic-1\.0
artistic-2.0 | spdx | spdx license identifier artistic-2\.0
python-2.0 | spdx | spdx license identifier (?:python|psf)-2\.0
openssl | spdx | spdx license identifier openssl
php-3.01 | spdx | spdx license identifier php-3\.01
ms-pl | spdx | spdx license identifier ms-pl
ms-rl | spdx | spdx license identifier ms-rl
x11 | spdx | spdx license identifier x11
curl | spdx | spdx license identifier curl
ncsa | spdx | spdx license identifier ncsa
postgresql | spdx | spdx license identifier postgresql
unicode | spdx | spdx license identifier unicode-(?:dfs-201[56]|3\.0)
w3c | spdx | spdx license identifier w3c
afl-3.0 | spdx | spdx license identifier afl-3\.0
osl-3.0 | spdx | spdx license identifier osl-3\.0
eupl-1.1 | spdx | spdx license identifier eupl-1\.1
eupl-1.2 | spdx | spdx license identifier eupl-1\.2
cecill-2.1 | spdx | spdx license identifier cecill-2\.1
odbl-1.0 | spdx | spdx license identifier odbl-1\.0
blueoak-1.0.0 | spdx | spdx license identifier blueoak-1\.0\.0
upl-1.0 | spdx | spdx license identifier upl-1\.0
vim | spdx | spdx license identifier vim
ruby | spdx | spdx license identifier ruby
cc-by-4.0 | creativecommons.org | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | creativecommons.org | creativecommons\.org/licenses/by/3\.0
cc-by-2.0 | creativecommons.org | creativecommons\.org/licenses/by/2\.[05]
cc-by-sa-4.0 | creativecommons.org | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | creativecommons.org | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nd-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/3\.0
cc0-1.0 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
public-domain | creativecommons.org | creativecommons\.org/publicdomain/mark/1\.0
apache-2.0 | apache.org/licenses | apache\.org/licenses/license-2\.0
gpl-3.0 | gnu.org/licenses | gnu\.org/licenses/gpl-3\.0
gpl-2.0 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
agpl-3.0 | gnu.org/licenses | gnu\.org/licenses/agpl-3\.0
lgpl-3.0 | gnu.org/licenses | gnu\.org/licenses/lgpl-3\.0
lgpl-2.1 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
gfdl | gnu.org/licenses | gnu\.org/licenses/fdl
mpl-2.0 | mozilla.org/mpl | mozilla\.org/mpl/2\.0
mpl-1.1 | mozilla.org/mpl | mozilla\.org/mpl/(?:mpl-)?1\.1
mit | opensource.org/licenses | opensource\.org/licenses/mit(?![a-z0-9-])
bsd-3-clause | opensource.org/licenses | opensource\.org/licenses/bsd-3-clause
bsd-2-clause | opensource.org/licenses | opensource\.org/licenses/bsd-2-clause
isc | opensource.org/licenses | opensource\.org/licenses/isc
epl-2.0 | eclipse.org/legal | eclipse\.org/legal/epl-(?:v20|2\.0)
epl-1.0 | eclipse.org/legal | eclipse\.org/legal/epl-v10
bsl-1.0 | boost.org/license | boost\.org/license_1_0
ofl-1.1 | scripts.sil.org/ofl | scripts\.sil\.org/ofl
unlicense | unlicense.org | unlicense\.org
wtfpl | wtfpl.net | wtfpl\.net
odbl-1.0 | opendatacommons.org | opendatacommons\.org/licenses/odbl
odc-by-1.0 | opendatacommons.org | opendatacommons\.org/licenses/by
pddl-1.0 | opendatacommons.org | opendatacommons\.org/licenses/pddl
"""

#: Sentences that put a work under a licence.
NOTICES = r"""
apache-2.0 | apache license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache license,? version 2 0
apache | apache license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache license
mit | mit license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit license
gpl-3.0 | gnu general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license,? version 3
gpl-2.0 | gnu general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license,? version 2
gpl | gnu general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public license
lgpl | gnu lesser general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu lesser general public license
agpl | gnu affero general public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu affero general public license
cc-by-nc-nd-4.0 | by-nc-nd | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by-nc-nd 4 0
cc-by-nc-sa-4.0 | by-nc-sa | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by-nc-sa 4 0
cc-by-nc-4.0 | by-nc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by-nc 4 0
cc-by-nd-4.0 | by-nd | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by-nd 4 0
cc-by-sa-4.0 | by-sa | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by-sa 4 0
cc-by-sa-3.0 | by-sa | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by-sa 3 0
cc-by-4.0 | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by 4 0
cc-by-3.0 | cc | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by 3 0
cc0-1.0 | cc0 | (?:licensed|released|distributed|available|published) under (?:a |the )?cc0
cc-by-nc-sa | noncommercial | creative commons attribution noncommercial sharealike
cc-by-nc-nd | noncommercial | creative commons attribution noncommercial noderiv
cc-by-nc | noncommercial | creative commons attribution noncommercial(?! sharealike| noderiv)
cc-by-nc | non-commercial | creative commons attribution non commercial
cc-by-sa | sharealike | creative commons attribution sharealike
cc-by-sa | share alike | creative commons attribution share alike
cc-by-nd | noderiv | creative commons attribution noderiv
cc-by-nd | no derivative | creative commons attribution no derivative
bsd | bsd | (?:licensed|released|distributed|available|published) under (?:a |the )?(?:terms of the )?(?:modified |new |simplified |revised )?bsd (?:style )?license
bsd-3-clause | 3-clause bsd | 3-clause bsd license
bsd-2-clause | 2-clause bsd | 2-clause bsd license
isc | isc license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?isc license
mpl | mozilla public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mozilla public license
epl | eclipse public license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?eclipse public license
cddl-1.0 | cddl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?cddl
zlib | zlib license | (?:licensed|released|distributed|available|published) under (?:the )?zlib license
bsl-1.0 | boost software license | (?:licensed|released|distributed|available|published) under (?:the )?boost software license
busl-1.1 | business source license | (?:licensed|released|distributed|available|published) under (?:the )?business source license
elastic-2.0 | elastic license | (?:licensed|released|distributed|available|published) under (?:the )?elastic license
sspl-1.0 | server side public license | (?:licensed|released|distributed|available|published) under (?:the )?server side public license
ofl-1.1 | open font license | (?:licensed|released|distributed|available|published) under (?:the )?(?:sil )?open font license
artistic | artistic license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?artistic license
perl | same terms as perl | under the same terms as perl itself
python-2.0 | python software foundation license | (?:licensed|released|distributed|available|published) under (?:the )?python software foundation license
ms-pl | microsoft public license | (?:licensed|released|distributed|available|published) under (?:the )?microsoft public license
odbl-1.0 | open database license | (?:licensed|released|distributed|available|published) under (?:the )?open database license
public-domain | public domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | public domain | this (?:work|file|document|software|text) is in the public domain
proprietary | proprietary | this (?:software|document|work|file) is proprietary
proprietary | all rights reserved | all rights reserved
dual | dual | dual licensed under
copyright | copyright | copyright (?:c |© |\(c\) )?(?:19|20)\d\d
no-license | no license | no license is granted
lgpl-2.1 | lgpl | (?:licensed|released|distributed|available|published) under (?:the )?lgpl ?v?2 1
lgpl-3.0 | lgpl | (?:licensed|released|distributed|available|published) under (?:the )?lgpl ?v?3
gpl-2.0 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?gpl ?v?2
gpl-3.0 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?gpl ?v?3
agpl-3.0 | agpl | (?:licensed|released|distributed|available|published) under (?:the )?agpl ?v?3
"""

#: Names of licences.
NAMES = r"""
gpl-3.0 | general public license | gnu general public license,? (?:version |v )?3
gpl-2.0 | general public license | gnu general public license,? (?:version |v )?2
gpl | general public license | gnu general public license
lgpl-2.1 | lesser general public license | gnu lesser general public license,? (?:version |v )?2 1
lgpl-3.0 | lesser general public license | gnu lesser general public license,? (?:version |v )?3
lgpl | lesser general public license | gnu lesser general public license
lgpl | library general public license | gnu library general public license
agpl-3.0 | affero general public license | gnu affero general public license,? (?:version |v )?3
agpl | affero general public license | (?:gnu )?affero general public license
gfdl | free documentation license | (?:gnu )?free documentation license
apache-2.0 | apache license | apache license,? (?:version |v )?2 0
apache | apache license | apache license
apache | apache software license | apache software license
mit | mit license | (?:the )?mit license
mit | expat license | expat license
bsd | bsd license | bsd license
bsd-3-clause | bsd-3-clause | bsd-3-clause
bsd-2-clause | bsd-2-clause | bsd-2-clause
isc | isc license | isc license
mpl-2.0 | mozilla public license | mozilla public license,? (?:version |v )?2
mpl | mozilla public license | mozilla public license
epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2
epl | eclipse public license | eclipse public license
cddl | common development and distribution license | common development and distribution license
cpl-1.0 | common public license | common public license
ipl-1.0 | ibm public license | ibm public license
zlib | zlib license | zlib license
bsl-1.0 | boost software license | boost software license
busl-1.1 | business source license | business source license
sspl-1.0 | server side public license | server side public license
elastic-2.0 | elastic license | elastic license 2
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
cc0-1.0 | cc0 | cc0 (?:1 0)?
cc-by-nc-nd | by-nc-nd | cc by-nc-nd
cc-by-nc-sa | by-nc-sa | cc by-nc-sa
cc-by-nc | by-nc | cc by-nc(?!-)
cc-by-nd | by-nd | cc by-nd
cc-by-sa | by-sa | cc by-sa
creative-commons | creative commons | creative commons
ofl | open font license | (?:sil )?open font license
artistic | artistic license | artistic license
python | python software foundation license | python software foundation license
ruby | ruby license | ruby license
php | php license | php license
openssl | openssl license | openssl license
vim | vim license | vim license
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
eupl | european union public licen | european union public licen[cs]e
cecill | cecill | cecill(?: b| c)? licen[cs]e
afl | academic free license | academic free license
osl | open software license | open software license
odbl | open database license | open database license
odc-by | open data commons attribution | open data commons attribution license
ogl-uk | open government licence | open government licence
etalab | licence ouverte | licence ouverte
ecl-2.0 | educational community license | educational community license
lppl | latex project public license | latex project public license
postgresql | postgresql license | postgresql license
ncsa | ncsa open source license | ncsa open source license
qpl | q public license | q public license
rpl | reciprocal public license | reciprocal public license
apsl | apple public source license | apple public source license
npl | netscape public license | netscape public license
bittorrent | bittorrent open source license | bittorrent open source license
intel | intel open source license | intel open source license
nasa | nasa open source agreement | nasa open source agreement
openrail | openrail | (?:creativeml |bigscience )?openrail(?:-m)?
llama | llama | llama (?:\d (?:\d )?)?community license
hippocratic | hippocratic license | hippocratic license
blueoak | blue oak model license | blue oak model license
polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter)
upl | universal permissive license | universal permissive license
"""

#: Name, weight and rules of each group, the one with the highest priority first.
GROUPS = (("grant", 0.98, GRANTS), ("identifier", 0.95, IDENTIFIERS), ("notice", 0.9, NOTICES), ("name", 0.6, NAMES))
