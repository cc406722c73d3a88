"""The signature rules of the licence scan, as text.

A rule is a line ``label | confidence | expression`` over normalised words: ASCII
letters lower-cased, everything but letters and digits one space, so that
"Apache-2.0" reads ``apache 2 0``. An expression stands between word boundaries. The
sections are in order of priority. No rule rests on the name of a product alone: it
asks for the words of a grant, a licence's title with its version, or its own text.
"""

#: SPDX identifiers and the labels they stand for.
IDENTIFIERS = """
0BSD bsd-0-clause
AFL-3.0 afl-3.0
AGPL-3.0 agpl-3.0
Apache-1.0 apache-1.0
Apache-1.1 apache-1.1
Apache-2.0 apache-2
APSL-2.0 apsl-2.0
Artistic-1.0 artistic-1.0
Artistic-2.0 artistic-2.0
BlueOak-1.0.0 blueoak-1.0.0
BSD-2-Clause bsd-2-clause
BSD-3-Clause bsd-3-clause
BSD-4-Clause bsd-4-clause
BSL-1.0 bsl-1.0
BUSL-1.1 busl-1.1
CC-BY-3.0 cc-by
CC-BY-4.0 cc-by
CC-BY-NC-4.0 cc-by-nc
CC-BY-NC-ND-4.0 cc-by-nc-nd
CC-BY-NC-SA-4.0 cc-by-nc-sa
CC-BY-ND-4.0 cc-by-nd
CC-BY-SA-3.0 cc-by-sa
CC-BY-SA-4.0 cc-by-sa
CC0-1.0 cc0
CDDL-1.0 cddl-1.0
CDDL-1.1 cddl-1.1
CECILL-2.1 cecill-2.1
CPL-1.0 cpl-1.0
ECL-2.0 ecl-2.0
Elastic-2.0 elastic-2.0
EPL-1.0 epl-1.0
EPL-2.0 epl-2.0
EUPL-1.1 eupl-1.1
EUPL-1.2 eupl-1.2
GFDL-1.2 gfdl-1.2
GFDL-1.3 gfdl-1.3
GPL-1.0 gpl-1.0
GPL-2.0 gpl-2.0
GPL-3.0 gpl-3.0
ISC isc
LGPL-2.0 lgpl-2.0
LGPL-2.1 lgpl-2.1
LGPL-3.0 lgpl-3.0
MIT mit
MIT-0 mit-0
MPL-1.1 mpl-1.1
MPL-2.0 mpl-2.0
MS-PL ms-pl
MS-RL ms-rl
MulanPSL-2.0 mulan-psl-2.0
NCSA ncsa
ODbL-1.0 odbl-1.0
OFL-1.1 ofl-1.1
OpenSSL openssl
OSL-3.0 osl-3.0
PostgreSQL postgresql
Python-2.0 python-2.0
SSPL-1.0 sspl-1.0
Unlicense unlicense
UPL-1.0 upl-1.0
Vim vim
WTFPL wtfpl
X11 x11
Zlib zlib
ZPL-2.1 zpl-2.1
"""

RULES = r"""
[notice]
mit | 0.98 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat|mit x11|x11 mit)(?: open source)? licen[cs]e
mit | 0.95 | (?:mit|expat) licensed
mit | 0.9 | dual licensed under (?:the )?mit and
mit-0 | 0.95 | mit no attribution licen[cs]e
x11 | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?x11 licen[cs]e
apache-2 | 0.98 | licensed under the apache licen[cs]e version 2 0
apache-2 | 0.98 | licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements
apache-2 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:asl|apl|apache)(?: software)?(?: licen[cs]e)?(?: version| v)? ?(?:v2|2)(?: 0)?
apache-2 | 0.85 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?apache licen[cs]e(?! (?:version |v )?1)
apache-1.1 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e (?:version |v )?1 1
apache-1.0 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e (?:version |v )?1 0
bsd | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the |a )?(?:terms of (?:the |a )?)?bsd(?: style| like| type)? licen[cs]e
bsd | 0.9 | use of this source code is governed by a bsd style licen[cs]e
bsd-2-clause | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[cs]e
bsd-3-clause | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e
bsd-4-clause | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:bsd 4 clause|4 clause bsd|original bsd|old bsd) licen[cs]e
bsd-0-clause | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:bsd 0 clause|0bsd|zero clause bsd|bsd zero clause) licen[cs]e
gpl-2.0 | 0.98 | under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e
gpl-2.0 | 0.98 | under the terms of the gnu general public licen[cs]e version 2(?! \d)
gpl-2.0 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?2(?: 0)?(?! [1-9])
gpl-3.0 | 0.98 | under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
gpl-3.0 | 0.98 | under the terms of the gnu general public licen[cs]e version 3(?! [1-9])
gpl-3.0 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?(?! [1-9])
gpl | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[cs]e)
lgpl-2.0 | 0.98 | under the terms of the gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e
lgpl-2.1 | 0.98 | under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e
lgpl-3.0 | 0.98 | under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
lgpl-2.1 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?(?:version |v )?v?2 1
lgpl-3.0 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?(?:version |v )?v?3(?: 0)?(?! [1-9])
lgpl | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lgpl|lesser general public licen[cs]e|library general public licen[cs]e)
agpl-3.0 | 0.98 | under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
agpl-3.0 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:agpl|affero general public licen[cs]e|affero gpl) ?(?:version |v )?v?3(?: 0)?
agpl | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:agpl|affero general public licen[cs]e|affero gpl)
gfdl | 0.97 | under the terms of the gnu free documentation licen[cs]e
gfdl | 0.9 | (?:licensed|released|available|published) under (?:the )?(?:gnu )?(?:gfdl|fdl)
mpl-1.1 | 0.97 | subject to the mozilla public licen[cs]e version 1 1
mpl-2.0 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:mpl|mozilla public licen[cs]e) ?(?:version |v )?v?2(?: 0)?
mpl | 0.85 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:mpl|mozilla public licen[cs]e)
epl-1.0 | 0.97 | made available under the terms of the eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?
epl-2.0 | 0.97 | made available under the terms of the eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?
epl | 0.85 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:epl|eclipse public licen[cs]e)
eupl-1.2 | 0.97 | licensed under the eupl(?: version| v)? 1 2
eupl-1.1 | 0.97 | licensed under the eupl(?: version| v)? 1 1
eupl | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:eupl|european union public licen[cs]e)
cddl | 0.95 | subject to the terms of the common development and distribution licen[cs]e
cddl | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:cddl|common development and distribution licen[cs]e)
cpl-1.0 | 0.95 | (?:made available|licensed|released|distributed) under the terms of the common public licen[cs]e
isc | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?isc licen[cs]e
zlib | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?zlib(?: libpng)? licen[cs]e
bsl-1.0 | 0.97 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?boost software licen[cs]e
bsl-1.0 | 0.95 | use modification and distribution (?:are|is) subject to the boost software licen[cs]e
unlicense | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?unlicense
wtfpl | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?wtfpl
artistic-2.0 | 0.97 | under (?:the )?(?:terms of (?:the )?)?artistic licen[cs]e (?:version |v )?2(?: 0)?
artistic-1.0 | 0.9 | under (?:the )?(?:terms of (?:the )?)?(?:perl )?artistic licen[cs]e(?: (?:version |v )?1(?: 0)?)?
perl | 0.9 | under the same terms as perl itself
ruby | 0.9 | under (?:the )?(?:same )?terms (?:of|as) (?:the )?ruby(?: s)? licen[cs]e
ruby | 0.85 | under the same terms as ruby
python-2.0 | 0.9 | under (?:the )?(?:terms of (?:the )?)?(?:psf|python software foundation) licen[cs]e
php-3.01 | 0.95 | subject to version 3 0?1 of the php licen[cs]e
ofl-1.1 | 0.97 | licensed under the sil open font licen[cs]e
ofl-1.1 | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:ofl|open font licen[cs]e)
odbl-1.0 | 0.97 | made available under the open database licen[cs]e
odbl-1.0 | 0.9 | (?:licensed|released|available|published) under (?:the )?(?:odbl|open data commons open database licen[cs]e)
odc-by | 0.95 | (?:licensed|released|available) under (?:the )?(?:odc by|open data commons attribution licen[cs]e)
pddl | 0.95 | (?:licensed|released|available) under (?:the )?(?:pddl|open data commons public domain dedication)
cc0 | 0.97 | (?:licensed|released|available|published|dedicated) under (?:the |a )?(?:terms of (?:the )?)?(?:creative commons )?(?:cc0|cc zero|zero)(?: 1 0)?
cc-by-nc-nd | 0.97 | (?:licensed|released|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?(?:cc|creative commons) (?:attribution non ?commercial no ?deriv(?:ative)?s?|by nc nd)
cc-by-nc-sa | 0.97 | (?:licensed|released|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?(?:cc|creative commons) (?:attribution non ?commercial share ?alike|by nc sa)
cc-by-nc | 0.97 | (?:licensed|released|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?(?:cc|creative commons) (?:attribution non ?commercial|by nc)(?! (?:nd|sa|no ?deriv|share ?alike))
cc-by-nd | 0.97 | (?:licensed|released|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?(?:cc|creative commons) (?:attribution no ?deriv(?:ative)?s?|by nd)
cc-by-sa | 0.97 | (?:licensed|released|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?(?:cc|creative commons) (?:attribution share ?alike|by sa)
cc-by | 0.97 | (?:licensed|released|available|published|shared) under (?:a |the )?(?:terms of (?:the )?)?(?:cc|creative commons) (?:attribution|by)(?! (?:nc|nd|sa|non ?commercial|no ?deriv|share ?alike))
creative-commons | 0.8 | (?:licensed|released|available|published|shared) under a creative commons licen[cs]e
ms-pl | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:ms pl|microsoft public licen[cs]e)
ms-rl | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:ms rl|microsoft reciprocal licen[cs]e)
afl-3.0 | 0.95 | licensed under the academic free licen[cs]e version 3 0
afl | 0.85 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?academic free licen[cs]e
osl-3.0 | 0.95 | licensed under the open software licen[cs]e version 3 0
osl | 0.85 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?open software licen[cs]e
upl-1.0 | 0.95 | licensed under the universal permissive licen[cs]e
ncsa | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under the (?:university of illinois ncsa|ncsa)(?: open source)? licen[cs]e
postgresql | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?postgresql licen[cs]e
openssl | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?openssl licen[cs]e
vim | 0.9 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?vim licen[cs]e
busl-1.1 | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?business source licen[cs]e
sspl-1.0 | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?(?:sspl|server side public licen[cs]e)
elastic-2.0 | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?elastic licen[cs]e
openrail-m | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the |a )?(?:terms of (?:the )?)?(?:bigscience |creativeml )?open ?rail(?: m| \+\+ m)?
llama-community | 0.95 | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:meta )?llama (?:[234](?: [0-9])? )?community licen[cs]e
cecill | 0.95 | governed by the cecill(?: b| c)? licen[cs]e
mulan-psl-2.0 | 0.95 | licensed under (?:the )?mulan psl v2
zpl-2.1 | 0.9 | subject to the provisions of the zope public licen[cs]e
w3c | 0.9 | (?:distributed|licensed|made available) under the w3c software(?: and document)?(?: notice and)? licen[cs]e
apsl-2.0 | 0.9 | subject to the apple public source licen[cs]e
ecl-2.0 | 0.9 | licensed under the educational community licen[cs]e
ogl-uk | 0.95 | (?:licensed|available|published|released) under the open government licen[cs]e
etalab | 0.9 | (?:licence ouverte|open licence) (?:etalab|version 2 0)
blueoak-1.0.0 | 0.9 | licensed under the blue oak model licen[cs]e
jpl-image | 0.7 | courtesy nasa jpl caltech
[text]
mit | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 0.85 | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | 0.8 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
apache-2 | 0.95 | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache-2 | 0.85 | you may not use this file except in compliance with the licen[cs]e
apache-2 | 0.9 | you may obtain a copy of the licen[cs]e at https? www apache org licenses licen[cs]e 2 0
apache-2 | 0.8 | grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants
apache-1.1 | 0.9 | this product includes software developed by the apache software foundation
bsd | 0.9 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 0.8 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 0.8 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 0.9 | neither the name of (?:the |its )?(?:\S+ ){0,12}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | 0.9 | neither the name of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software without
bsd-3-clause | 0.8 | names? of (?:\S+ ){1,8}may not be used to endorse or promote products derived from this software without
bsd-4-clause | 0.9 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
gpl | 0.9 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | 0.85 | this program is distributed in the hope that it will be useful but without any warranty
gpl | 0.9 | you should have received a copy of the gnu general public licen[cs]e along with
gpl | 0.8 | the licenses for most software are designed to take away your freedom to share and change it
gpl | 0.8 | gnu general public licen[cs]e terms and conditions for copying distribution and modification
gpl-3.0 | 0.85 | the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gpl-2.0 | 0.8 | this general public licen[cs]e does not permit incorporating your program into proprietary programs
lgpl | 0.9 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl | 0.85 | this library is distributed in the hope that it will be useful but without any warranty
lgpl | 0.9 | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with
agpl | 0.9 | you should have received a copy of the gnu affero general public licen[cs]e along with
gpl-family | 0.7 | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gfdl | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl | 0.8 | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | 0.95 | this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0
mpl-1.1 | 0.9 | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl | 0.8 | if a copy of the mpl was not distributed with this file you can obtain one at
cddl | 0.9 | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
isc | 0.95 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
hpnd | 0.85 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
zlib | 0.9 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | 0.9 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 0.85 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | 0.97 | this is free and unencumbered software released into the public domain
unlicense | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
bsl-1.0 | 0.95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
wtfpl | 0.9 | you just do what the fuck you want to
wtfpl | 0.95 | do what the fuck you want to public licen[cs]e
cc0 | 0.95 | to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights
cc0 | 0.9 | the person who associated a work with this deed has dedicated the work to the public domain
cc-by-sa | 0.8 | if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e
cc-by-nc | 0.7 | you may not use the material for commercial purposes
cc-by-nd | 0.8 | if you remix transform or build upon the material you may not distribute the modified material
cc-by | 0.7 | you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
ofl-1.1 | 0.9 | the fonts and derivatives however cannot be released under any other type of licen[cs]e
ofl-1.1 | 0.85 | neither the font software nor any of its individual components in original or modified versions may be sold by itself
odbl-1.0 | 0.85 | any rights in individual contents of the database are licensed under the database contents licen[cs]e
artistic | 0.85 | the intent of this document is to state the conditions under which a package may be copied
postgresql | 0.85 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl | 0.85 | this product includes software developed by the openssl project for use in the openssl toolkit
vim | 0.85 | there are no restrictions on distributing unmodified copies of vim except that they must include this licen[cs]e text
ncsa | 0.85 | to deal with the software without restriction including without limitation the rights to use copy
php-3.01 | 0.85 | this product includes php software freely available from
python-2.0 | 0.85 | psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e
eupl | 0.85 | you may not use this work except in compliance with the licen[cs]e
sspl-1.0 | 0.85 | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | 0.85 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
beerware | 0.95 | as long as you retain this notice you can do whatever you want with this stuff
json | 0.9 | the software shall be used for good not evil
ms-pl | 0.8 | each contributor grants you a non exclusive worldwide royalty free copyright licen[cs]e to reproduce its contribution
curl | 0.85 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
libpng | 0.8 | the png reference library is supplied as is
ijg | 0.85 | this software is based in part on the work of the independent jpeg group
unicode | 0.85 | copyright c? ?(?:\d{4} )*unicode inc all rights reserved
icu | 0.8 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
opl | 0.85 | may be distributed only subject to the terms and conditions set forth in the open publication licen[cs]e
ldp | 0.8 | subject to the terms of the linux documentation project licen[cs]e
public-domain | 0.9 | (?:has been|is hereby|are hereby|was) (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | 0.85 | (?:dedicated to|released into|placed in|placed into) the public domain
public-domain | 0.85 | this (?:work|file|code|document|software|text|image) is in the public domain
public-domain | 0.8 | no copyright is claimed
public-domain | 0.8 | a work of the united states government (?:and|and is) not subject to copyright
[title]
mit | 0.9 | the mit licen[cs]e mit
mit | 0.8 | mit licen[cs]e copyright c
apache-2 | 0.9 | apache licen[cs]e version 2 0 january 2004
apache-2 | 0.85 | apache(?: software)? licen[cs]e (?:version |v )?(?:v2|2)(?: 0)?
apache-1.1 | 0.85 | apache(?: software)? licen[cs]e (?:version |v )?1 1
apache-1.0 | 0.85 | apache(?: software)? licen[cs]e (?:version |v )?1 0
bsd-0-clause | 0.8 | (?:bsd 0 clause|zero clause bsd|bsd zero clause) licen[cs]e
bsd-2-clause | 0.85 | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd) licen[cs]e
bsd-3-clause | 0.85 | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e
bsd-4-clause | 0.85 | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd) licen[cs]e
gpl-1.0 | 0.85 | gnu general public licen[cs]e (?:version |v )?v?1(?: 0)?(?! [1-9])
gpl-1.0 | 0.8 | (?:gplv1|gpl v1|gpl version 1|gpl 1 0)(?! [1-9])
gpl-2.0 | 0.85 | gnu (?:gpl|general public licen[cs]e) (?:version |v )?v?2(?: 0)?(?! [1-9])
gpl-2.0 | 0.8 | (?:gplv2|gpl v2|gpl version 2|gpl 2 0)(?! [1-9])
gpl-3.0 | 0.85 | gnu (?:gpl|general public licen[cs]e) (?:version |v )?v?3(?: 0)?(?! [1-9])
gpl-3.0 | 0.8 | (?:gplv3|gpl v3|gpl version 3|gpl 3 0)(?! [1-9])
lgpl-2.0 | 0.85 | gnu (?:lgpl|library general public licen[cs]e) (?:version |v )?v?2(?: 0)?(?! [1-9])
lgpl-2.1 | 0.85 | gnu (?:lgpl|lesser general public licen[cs]e|library general public licen[cs]e) (?:version |v )?v?2 1
lgpl-2.1 | 0.8 | (?:lgplv2 1|lgpl v2 1|lgpl version 2 1|lgpl 2 1)
lgpl-3.0 | 0.85 | gnu (?:lgpl|lesser general public licen[cs]e) (?:version |v )?v?3(?: 0)?(?! [1-9])
lgpl-3.0 | 0.8 | (?:lgplv3|lgpl v3|lgpl version 3|lgpl 3 0)(?! [1-9])
agpl-3.0 | 0.85 | gnu (?:agpl|affero general public licen[cs]e) (?:version |v )?v?3(?: 0)?
agpl-3.0 | 0.8 | (?:agplv3|agpl v3|agpl version 3|agpl 3 0)
gfdl-1.1 | 0.85 | gnu free documentation licen[cs]e version 1 1
gfdl-1.2 | 0.85 | gnu free documentation licen[cs]e version 1 2
gfdl-1.3 | 0.85 | gnu free documentation licen[cs]e version 1 3
mpl-1.0 | 0.85 | mozilla public licen[cs]e (?:version |v )?1 0
mpl-1.1 | 0.85 | mozilla public licen[cs]e (?:version |v )?1 1
mpl-2.0 | 0.85 | mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?
epl-1.0 | 0.85 | eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?
epl-2.0 | 0.85 | eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?
edl-1.0 | 0.85 | eclipse distribution licen[cs]e (?:version |v )?v?1(?: 0)?
eupl-1.1 | 0.85 | european union public licen[cs]e (?:version |v )?(?:v )?1 1
eupl-1.2 | 0.85 | european union public licen[cs]e (?:version |v )?(?:v )?1 2
cddl-1.0 | 0.85 | common development and distribution licen[cs]e cddl version 1 0
cddl-1.1 | 0.85 | common development and distribution licen[cs]e cddl version 1 1
cpl-1.0 | 0.8 | common public licen[cs]e (?:version |v )?1(?: 0)?
bsl-1.0 | 0.85 | boost software licen[cs]e version 1 0
artistic-1.0 | 0.8 | artistic licen[cs]e (?:version |v )?1(?: 0)?
artistic-2.0 | 0.8 | artistic licen[cs]e (?:version |v )?2(?: 0)?
ofl-1.1 | 0.85 | sil open font licen[cs]e version 1 1
odbl-1.0 | 0.8 | open database licen[cs]e odbl(?: v1 0)?
odc-by | 0.8 | open data commons attribution licen[cs]e
pddl | 0.8 | public domain dedication and licen[cs]e pddl
cc0 | 0.85 | cc0 1 0(?: universal)?
cc-by-nc-nd | 0.85 | creative commons attribution non ?commercial no ?deriv(?:ative)?s? [1-4] [05]
cc-by-nc-sa | 0.85 | creative commons attribution non ?commercial share ?alike [1-4] [05]
cc-by-nc | 0.85 | creative commons attribution non ?commercial [1-4] [05]
cc-by-nd | 0.85 | creative commons attribution no ?deriv(?:ative)?s? [1-4] [05]
cc-by-sa | 0.85 | creative commons attribution share ?alike [1-4] [05]
cc-by | 0.85 | creative commons attribution [1-4] [05]
cc-by-nc-nd | 0.8 | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.8 | cc by nc sa(?: [1-4] [05])?
cc-by-nc | 0.8 | cc by nc(?: [1-4] [05])?(?! (?:nd|sa))
cc-by-nd | 0.8 | cc by nd(?: [1-4] [05])?
cc-by-sa | 0.8 | cc by sa(?: [1-4] [05])?
cc-by | 0.8 | cc by [1-4] [05]
ms-pl | 0.85 | microsoft public licen[cs]e ms pl
ms-rl | 0.85 | microsoft reciprocal licen[cs]e ms rl
afl-3.0 | 0.8 | academic free licen[cs]e (?:version |v )?3 0
osl-3.0 | 0.8 | open software licen[cs]e (?:version |v )?3 0
upl-1.0 | 0.85 | universal permissive licen[cs]e (?:upl )?(?:version |v )?1 0
ncsa | 0.85 | university of illinois ncsa open source licen[cs]e
php-3.0 | 0.8 | the php licen[cs]e version 3 0(?! 1)
php-3.01 | 0.8 | the php licen[cs]e version 3 01
zpl-2.1 | 0.8 | zope public licen[cs]e zpl version 2 1
python-2.0 | 0.8 | python software foundation licen[cs]e version 2
busl-1.1 | 0.85 | business source licen[cs]e 1 1
sspl-1.0 | 0.85 | server side public licen[cs]e version 1
elastic-2.0 | 0.85 | elastic licen[cs]e 2 0
w3c | 0.8 | w3c software notice and licen[cs]e
qpl-1.0 | 0.8 | the q public licen[cs]e version 1 0
ipl-1.0 | 0.8 | ibm public licen[cs]e version 1 0
spl-1.0 | 0.8 | sun public licen[cs]e version 1 0
npl-1.1 | 0.8 | netscape public licen[cs]e version 1 1
cpal-1.0 | 0.8 | common public attribution licen[cs]e version 1 0
rpl-1.5 | 0.8 | reciprocal public licen[cs]e 1 5
lppl-1.3 | 0.85 | latex project public licen[cs]e
cecill-2.1 | 0.8 | cecill free software licen[cs]e agreement
mulan-psl-2.0 | 0.8 | mulan permissive software licen[cs]e version 2
openrail-m | 0.8 | creativeml open rail m
openrail-m | 0.8 | bigscience (?:rail|open rail m) licen[cs]e
llama-community | 0.85 | llama (?:[234](?: [0-9])? )?community licen[cs]e agreement
gemma | 0.8 | gemma terms of use
ogl-uk | 0.8 | open government licen[cs]e v?[123](?: 0)?
datalicence-de | 0.8 | datenlizenz deutschland namensnennung version 2 0
[reference]
mit | 0.75 | (?:this|the) (?:project|code|software|library|program|package|repository) is (?:under|covered by) (?:the )?mit licen[cs]e
mit | 0.7 | licen[cs]e (?:is )?mit
mit | 0.7 | see (?:the )?mit licen[cs]e
apache-2 | 0.7 | licen[cs]e (?:is )?apache(?: 2(?: 0)?| v2)
bsd | 0.6 | licen[cs]e (?:is )?bsd
gpl | 0.75 | gnu general public licen[cs]e
lgpl | 0.75 | gnu (?:lesser|library) general public licen[cs]e
agpl | 0.75 | gnu affero general public licen[cs]e
gfdl | 0.75 | gnu free documentation licen[cs]e
gpl | 0.6 | licen[cs]e (?:is )?gpl
mpl | 0.7 | mozilla public licen[cs]e
epl | 0.7 | eclipse public licen[cs]e
eupl | 0.7 | european union public licen[cs]e
cddl | 0.7 | common development and distribution licen[cs]e
creative-commons | 0.7 | creative commons (?:licen[cs]e|licensed|attribution|zero)
creative-commons | 0.7 | some rights reserved
copyleft | 0.5 | (?:strong |weak )?copyleft licen[cs]e
open-source | 0.4 | released as open source
open-source | 0.4 | osi approved (?:open source )?licen[cs]e
public-domain | 0.6 | public domain mark 1 0
proprietary | 0.9 | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 0.85 | no part of this (?:publication|book|document|work) may be reproduced
proprietary | 0.8 | (?:may|must) not be (?:reproduced|copied|distributed|redistributed) without (?:the )?(?:prior |express |written )*permission
proprietary | 0.75 | proprietary and confidential
proprietary | 0.7 | for internal use only
proprietary | 0.8 | this software is the confidential and proprietary information of
proprietary | 0.8 | you may not (?:copy|modify|reproduce|distribute|redistribute|resell|sublicense) (?:\S+ ){0,6}without (?:our |the )?(?:prior |express |written )*(?:consent|permission)
proprietary | 0.8 | end user licen[cs]e agreement
proprietary | 0.7 | subject to the terms of (?:your|the) licen[cs]e agreement
proprietary | 0.7 | reproduction in whole or in part (?:\S+ ){0,4}is (?:strictly )?prohibited
proprietary | 0.6 | trade secrets? of
proprietary | 0.5 | all rights reserved
non-commercial | 0.7 | for non ?commercial (?:use|purposes) only
non-commercial | 0.7 | free for (?:personal|academic|educational)(?: and (?:personal|academic|educational))? use
non-commercial | 0.7 | not for commercial use
research-only | 0.75 | for research (?:use|purposes) only
no-derivatives | 0.6 | no derivative works
attribution | 0.5 | attribution required
warranty-disclaimer | 0.5 | without warranties or conditions of any kind either express or implied
warranty-disclaimer | 0.5 | without warranty of any kind(?: either)? express(?:ed)? or implied
warranty-disclaimer | 0.5 | warranties of merchantability (?:and )?fitness for a particular purpose
warranty-disclaimer | 0.4 | provided as is without
"""
