"""The signature rules of the license scan, in order of priority (first is strongest).

Expressions run over normalized text: lower case, words parted by one blank, all ASCII punctuation gone. Each
line: label | weight | keyword that must stand in the text | expression.
"""

RULES_TEXT = r"""
gpl-3.0-or-later | 1.0 | spdx license identifier | spdx license identifier gpl 3 0 or later
gpl-3.0-only | 1.0 | spdx license identifier | spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later | 1.0 | spdx license identifier | spdx license identifier gpl 2 0 or later
gpl-2.0-only | 1.0 | spdx license identifier | spdx license identifier gpl 2 0(?: only)?
gpl-1.0 | 1.0 | spdx license identifier | spdx license identifier gpl 1 0(?: only| or later)?
lgpl-3.0-or-later | 1.0 | spdx license identifier | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | 1.0 | spdx license identifier | spdx license identifier lgpl 3 0(?: only)?
lgpl-2.1-or-later | 1.0 | spdx license identifier | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | 1.0 | spdx license identifier | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.0 | 1.0 | spdx license identifier | spdx license identifier lgpl 2 0(?: only| or later)?
agpl-3.0-or-later | 1.0 | spdx license identifier | spdx license identifier agpl 3 0 or later
agpl-3.0-only | 1.0 | spdx license identifier | spdx license identifier agpl 3 0(?: only)?
gfdl-1.3 | 1.0 | spdx license identifier | spdx license identifier gfdl 1 3(?: only| or later)?
apache-2.0 | 1.0 | spdx license identifier | spdx license identifier apache 2 0
apache-1.1 | 1.0 | spdx license identifier | spdx license identifier apache 1 1
mit | 1.0 | spdx license identifier | spdx license identifier mit(?! 0)
mit-0 | 1.0 | spdx license identifier | spdx license identifier mit 0
bsd-2-clause | 1.0 | spdx license identifier | spdx license identifier bsd 2 clause
bsd-3-clause | 1.0 | spdx license identifier | spdx license identifier bsd 3 clause
bsd-4-clause | 1.0 | spdx license identifier | spdx license identifier bsd 4 clause
0bsd | 1.0 | spdx license identifier | spdx license identifier 0bsd
isc | 1.0 | spdx license identifier | spdx license identifier isc
mpl-2.0 | 1.0 | spdx license identifier | spdx license identifier mpl 2 0
mpl-1.1 | 1.0 | spdx license identifier | spdx license identifier mpl 1 1
epl-2.0 | 1.0 | spdx license identifier | spdx license identifier epl 2 0
epl-1.0 | 1.0 | spdx license identifier | spdx license identifier epl 1 0
cddl-1.0 | 1.0 | spdx license identifier | spdx license identifier cddl 1 0
cddl-1.1 | 1.0 | spdx license identifier | spdx license identifier cddl 1 1
eupl-1.2 | 1.0 | spdx license identifier | spdx license identifier eupl 1 2
eupl-1.1 | 1.0 | spdx license identifier | spdx license identifier eupl 1 1
bsl-1.0 | 1.0 | spdx license identifier | spdx license identifier bsl 1 0
busl-1.1 | 1.0 | spdx license identifier | spdx license identifier busl 1 1
unlicense | 1.0 | spdx license identifier | spdx license identifier unlicense
wtfpl | 1.0 | spdx license identifier | spdx license identifier wtfpl
zlib | 1.0 | spdx license identifier | spdx license identifier zlib
libpng | 1.0 | spdx license identifier | spdx license identifier libpng(?: 2 0)?
artistic-2.0 | 1.0 | spdx license identifier | spdx license identifier artistic 2 0
artistic-1.0 | 1.0 | spdx license identifier | spdx license identifier artistic 1 0(?: perl)?
ms-pl | 1.0 | spdx license identifier | spdx license identifier ms pl
ms-rl | 1.0 | spdx license identifier | spdx license identifier ms rl
osl-3.0 | 1.0 | spdx license identifier | spdx license identifier osl 3 0
afl-3.0 | 1.0 | spdx license identifier | spdx license identifier afl 3 0
ofl-1.1 | 1.0 | spdx license identifier | spdx license identifier ofl 1 1
python-2.0 | 1.0 | spdx license identifier | spdx license identifier (?:python|psf) 2 0
php-3.01 | 1.0 | spdx license identifier | spdx license identifier php 3 01
ruby | 1.0 | spdx license identifier | spdx license identifier ruby
postgresql | 1.0 | spdx license identifier | spdx license identifier postgresql
openssl | 1.0 | spdx license identifier | spdx license identifier openssl
ncsa | 1.0 | spdx license identifier | spdx license identifier ncsa
x11 | 1.0 | spdx license identifier | spdx license identifier x11
vim | 1.0 | spdx license identifier | spdx license identifier vim
w3c | 1.0 | spdx license identifier | spdx license identifier w3c
cecill-2.1 | 1.0 | spdx license identifier | spdx license identifier cecill 2 1
odbl-1.0 | 1.0 | spdx license identifier | spdx license identifier odbl 1 0
cc0-1.0 | 1.0 | spdx license identifier | spdx license identifier cc0 1 0
cc-by-nc-nd | 1.0 | spdx license identifier | spdx license identifier cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 1.0 | spdx license identifier | spdx license identifier cc by nc sa(?: [1-4] [05])?
cc-by-nc | 1.0 | spdx license identifier | spdx license identifier cc by nc(?: [1-4] [05])?
cc-by-nd | 1.0 | spdx license identifier | spdx license identifier cc by nd(?: [1-4] [05])?
cc-by-sa | 1.0 | spdx license identifier | spdx license identifier cc by sa(?: [1-4] [05])?
cc-by | 1.0 | spdx license identifier | spdx license identifier cc by(?: [1-4] [05])?
agpl-3.0-or-later | 0.98 | gnu affero general public license | gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)? or (?:at your option )?any later version
agpl-3.0 | 0.95 | gnu affero general public license | gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?
agpl | 0.9 | gnu affero general public license | (?:the )?gnu affero general public license
lgpl-3.0-or-later | 0.98 | gnu lesser general public license | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)? or (?:at your option )?any later version
lgpl-2.1-or-later | 0.98 | gnu lesser general public license | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1(?: of the license)? or (?:at your option )?any later version
lgpl-3.0 | 0.95 | gnu lesser general public license | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?
lgpl-2.1 | 0.95 | gnu lesser general public license | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?2 1
lgpl-2.0 | 0.95 | gnu library general public license | gnu library general public license(?: (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?)?
lgpl | 0.9 | gnu lesser general public license | (?:the )?gnu lesser general public license
gpl-3.0-or-later | 0.98 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)? or (?:at your option )?any later version
gpl-2.0-or-later | 0.98 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: of the license)? or (?:at your option )?any later version
gpl-3.0 | 0.95 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?
gpl-2.0 | 0.95 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?2(?: 0)?
gpl-classpath | 0.95 | gnu general public license | gnu general public license (?:version 2 )?with (?:the )?classpath exception
gpl | 0.9 | gnu general public license | (?:the )?gnu general public license
gpl | 0.85 | gnu gpl | gnu gpl(?: v?[123](?: 0)?)?
gpl | 0.8 | general public licen | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?general public licen[cs]e
gfdl | 0.95 | gnu free documentation license | gnu free documentation license(?: version 1 [123])?
gpl-3.0 | 0.8 | gnu org licen | gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-2.0 | 0.8 | gnu org licen | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
lgpl-3.0 | 0.8 | gnu org licen | gnu org licenses lgpl 3 0(?: html| txt| en html)?
lgpl-2.1 | 0.8 | gnu org licen | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?
agpl-3.0 | 0.8 | gnu org licen | gnu org licenses agpl 3 0(?: html| txt| en html)?
gfdl | 0.8 | gnu org licen | gnu org licenses fdl(?: 1 [123])?(?: html| txt| en html)?
gpl | 0.6 | gnu org licen | gnu org licenses
apache-2.0 | 0.98 | apache license | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | 0.95 | apache license | apache license (?:version |v )?2(?: 0)?
apache-1.1 | 0.95 | apache license | apache license version 1 1
apache-1.0 | 0.95 | apache license | apache license version 1 0
apache | 0.9 | apache license | (?:the )?apache license
apache | 0.85 | apache software license | (?:the )?apache software license(?: version [12] [01])?
apache-2.0 | 0.8 | apache org licen | apache org licenses license 2 0(?: html| txt)?
apache-1.1 | 0.8 | apache org licen | apache org licenses license 1 1(?: html| txt)?
apache | 0.7 | asl 2 0 licen | asl 2 0 licen[cs]ed?
mit | 0.98 | mit license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
mit-0 | 0.95 | mit no attribution | mit no attribution licen[cs]e
mit | 0.9 | mit license | (?:the )?mit license(?: mit)?
mit | 0.85 | mit licence | (?:the )?mit licence
mit | 0.8 | opensource org licen | opensource org licenses mit(?: license)?(?: php| html)?
mit | 0.95 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.6 | without restriction including without limitation the rights | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
expat | 0.85 | expat licen | expat licen[cs]e
x11 | 0.85 | x11 licen | x11 licen[cs]e
bsd-4-clause | 0.95 | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
bsd-3-clause | 0.9 | neither the name of | neither the name of (?:the )?(?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software
bsd-2-clause | 0.8 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | 0.95 | bsd licen | (?:the )?(?:4 clause|four clause|original|old) bsd licen[cs]e
bsd-3-clause | 0.95 | bsd licen | (?:the )?(?:3 clause|three clause|new|modified|revised) bsd licen[cs]e
bsd-2-clause | 0.95 | bsd licen | (?:the )?(?:2 clause|two clause|simplified|freebsd) bsd licen[cs]e
0bsd | 0.95 | bsd licen | (?:the )?(?:zero clause|0 clause|free public) bsd licen[cs]e
bsd | 0.85 | bsd licen | (?:the )?bsd licen[cs]e
bsd | 0.85 | bsd style licen | bsd style licen[cs]e
bsd-3-clause | 0.8 | opensource org licen | opensource org licenses bsd 3 clause
bsd-2-clause | 0.8 | opensource org licen | opensource org licenses bsd 2 clause
bsd | 0.7 | opensource org licen | opensource org licenses bsd license(?: php)?
isc | 0.95 | permission to use copy modify and | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | isc licen | (?:the )?isc licen[cs]e
isc | 0.8 | opensource org licen | opensource org licenses isc(?: license)?
mpl-2.0 | 0.95 | mozilla public license | mozilla public license (?:version |v )?2(?: 0)?
mpl-1.1 | 0.95 | mozilla public license | mozilla public license (?:version |v )?1 1
mpl-1.0 | 0.95 | mozilla public license | mozilla public license (?:version |v )?1 0
mpl | 0.9 | mozilla public license | (?:the )?mozilla public license
mpl-2.0 | 0.8 | mozilla org mpl | mozilla org mpl 2 0
mpl-1.1 | 0.8 | mozilla org mpl | mozilla org mpl(?: mpl)? 1 1(?: html)?
epl-2.0 | 0.95 | eclipse public license | eclipse public license (?:version |v )?2(?: 0)?
epl-1.0 | 0.95 | eclipse public license | eclipse public license (?:version |v )?1(?: 0)?
epl | 0.9 | eclipse public license | (?:the )?eclipse public license
edl-1.0 | 0.9 | eclipse distribution license | eclipse distribution license(?: (?:version |v )?1 0)?
epl | 0.8 | eclipse org legal epl | eclipse org legal epl (?:2 0|v10|v20|1 0)(?: html)?
cddl-1.1 | 0.95 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v )?1 1
cddl-1.0 | 0.95 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v )?1 0
cddl | 0.9 | common development and distribution license | common development and distribution license
cpl-1.0 | 0.9 | common public license | common public license(?: (?:version |v )?1 0)?
cpal-1.0 | 0.9 | common public attribution license | common public attribution license(?: (?:version |v )?1 0)?
ipl-1.0 | 0.9 | ibm public license | ibm public license(?: (?:version |v )?1 0)?
eupl-1.2 | 0.95 | european union public licen | european union public licen[cs]e (?:eupl )?(?:version |v )?1 2
eupl-1.1 | 0.95 | european union public licen | european union public licen[cs]e (?:eupl )?(?:version |v )?1 1
eupl | 0.9 | european union public licen | european union public licen[cs]e
bsl-1.0 | 0.95 | boost software license | (?:the )?boost software license(?: (?:version |v )?1 0)?
busl-1.1 | 0.95 | business source license | (?:the )?business source license(?: (?:version |v )?1 1)?
sspl-1.0 | 0.95 | server side public license | (?:the )?server side public license(?: (?:version |v )?1(?: 0)?)?
elastic-2.0 | 0.95 | elastic license | (?:the )?elastic license(?: (?:version |v )?2(?: 0)?)?
commons-clause | 0.9 | commons clause licen | commons clause licen[cs]e(?: condition)?(?: v?1 0)?
polyform-nc | 0.95 | polyform noncommercial license | polyform noncommercial license(?: 1 0 0)?
polyform-sb | 0.95 | polyform small business license | polyform small business license(?: 1 0 0)?
unlicense | 0.95 | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 0.9 | the unlicense | the unlicense
unlicense | 0.8 | unlicense org | unlicense org
wtfpl | 0.95 | do what the fuck you want to public license | do what the fuck you want to public license(?: version 2)?
beerware | 0.95 | beer ware license | the beer ware license(?: revision 42)?
json | 0.9 | shall be used for good not evil | the software shall be used for good not evil
zlib | 0.95 | zlib licen | (?:the )?zlib (?:libpng )?licen[cs]e
zlib | 0.85 | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented
libpng | 0.9 | libpng licen | (?:the )?libpng licen[cs]e(?: version 2)?
artistic-2.0 | 0.95 | artistic license | (?:the )?artistic license (?:version |v )?2(?: 0)?
artistic-1.0 | 0.95 | artistic license | (?:the )?artistic license (?:version |v )?1(?: 0)?
artistic | 0.9 | artistic license | (?:the )?artistic license
perl | 0.85 | same terms as perl | under the same terms as perl itself
ms-pl | 0.95 | microsoft public license | (?:the )?microsoft public license(?: ms pl)?
ms-rl | 0.95 | microsoft reciprocal license | (?:the )?microsoft reciprocal license(?: ms rl)?
osl-3.0 | 0.95 | open software license | (?:the )?open software license(?: (?:version |v )?3 0)?
afl-3.0 | 0.95 | academic free license | (?:the )?academic free license(?: (?:version |v )?3 0)?
ecl-2.0 | 0.95 | educational community license | educational community license(?: (?:version |v )?2 0)?
ofl-1.1 | 0.95 | sil open font license | (?:the )?sil open font license(?: (?:version |v )?1 1)?
ofl | 0.85 | open font license | (?:the )?open font license
ubuntu-font | 0.9 | ubuntu font licen | ubuntu font licen[cs]e(?: 1 0)?
python-2.0 | 0.95 | python software foundation license | python software foundation license(?: (?:version |v )?2)?
php | 0.95 | php license | (?:the )?php license(?: (?:version |v )?3 0?1)?
ruby | 0.9 | ruby licen | (?:the )?ruby licen[cs]e
postgresql | 0.95 | postgresql licen | (?:the )?postgresql licen[cs]e
openssl | 0.95 | openssl licen | (?:the )?openssl licen[cs]e
openldap | 0.95 | openldap public license | (?:the )?openldap public license(?: (?:version |v )?2 8)?
curl | 0.9 | curl licen | (?:the )?curl licen[cs]e
icu | 0.9 | icu licen | (?:the )?icu licen[cs]e
unicode | 0.9 | unicode licen | (?:the )?unicode licen[cs]e(?: agreement)?(?: v3)?
ncsa | 0.95 | university of illinois | university of illinois (?:ncsa )?open source license
w3c | 0.9 | w3c software | w3c software (?:and document )?(?:notice and )?license
vim | 0.9 | vim license | (?:the )?vim license
tcl | 0.9 | tcl licen | tcl (?:tk )?licen[cs]e
sleepycat | 0.9 | sleepycat licen | (?:the )?sleepycat (?:public )?licen[cs]e
qpl-1.0 | 0.9 | q public license | (?:the )?q public license(?: (?:version |v )?1 0)?
cecill-2.1 | 0.95 | cecill licen | cecill licen[cs]e(?: (?:version |v )?2 1)?
naumen | 0.9 | naumen public license | naumen public license
nokia | 0.9 | nokia open source license | nokia open source license
sun-spl | 0.9 | sun public license | sun public license(?: (?:version |v )?1 0)?
zope-2.1 | 0.9 | zope public license | zope public license(?: (?:version |v )?2 [01])?
upl-1.0 | 0.95 | universal permissive license | (?:the )?universal permissive license(?: (?:version |v )?1 0)?
blueoak-1.0.0 | 0.95 | blue oak model license | blue oak model license(?: 1 0 0)?
mulan-2.0 | 0.95 | mulan permissive software license | mulan permissive software license(?: (?:version |v )?[12])?
openrail-m | 0.9 | openrail m licen | (?:creativeml |bigscience )?openrail m licen[cs]e
llama-community | 0.9 | community license agreement | llama (?:[23] (?:[123] )?)?community license agreement
odbl-1.0 | 0.95 | open database license | open (?:data commons )?(?:open )?database license(?: (?:odbl )?(?:version |v )?1 0)?
odc-by | 0.95 | open data commons attribution license | open data commons attribution license(?: (?:version |v )?1 0)?
pddl-1.0 | 0.95 | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive | 0.9 | community data license agreement | community data license agreement permissive(?: (?:version |v )?[12] 0)?
cdla-sharing | 0.9 | community data license agreement | community data license agreement sharing(?: (?:version |v )?1 0)?
ogl-uk | 0.9 | open government licen | open government licen[cs]e(?: (?:version |v )?[123](?: 0)?)?
cc0-1.0 | 0.95 | cc0 1 0 | (?:creative commons )?(?:zero )?cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0 | 0.9 | creative commons zero | creative commons zero(?: (?:v|version )?1 0)?
cc0-1.0 | 0.8 | creativecommons org | creativecommons org publicdomain zero 1 0
cc-by-nc-nd | 0.95 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-sa | 0.95 | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc | 0.95 | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nd | 0.95 | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-sa | 0.95 | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by | 0.95 | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc | 0.7 | creative commons | creative commons(?: public)?(?: licen[cs]e)?
cc-by-nc-nd | 0.85 | creativecommons org | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.85 | creativecommons org | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | 0.85 | creativecommons org | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 0.85 | creativecommons org | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa | 0.85 | creativecommons org | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by | 0.85 | creativecommons org | creativecommons org licenses by(?: [1-4] [05])?
cc-by-nc-nd | 0.9 | cc by | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.9 | cc by | cc by nc sa(?: [1-4] [05])?
cc-by-nc | 0.9 | cc by | cc by nc(?: [1-4] [05])?
cc-by-nd | 0.9 | cc by | cc by nd(?: [1-4] [05])?
cc-by-sa | 0.9 | cc by | cc by sa(?: [1-4] [05])?
cc-by | 0.85 | cc by | cc by(?: [1-4] [05])?
public-domain | 0.8 | public domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | 0.6 | public domain | (?:is|are) (?:hereby )?in the public domain
proprietary | 0.7 | all rights reserved | copyright (?:c )?(?:[12][0-9]{3} )+(?:[^ ]+ ){1,10}all rights reserved
proprietary | 0.5 | all rights reserved | all rights reserved
proprietary | 0.8 | proprietary and confidential | (?:this (?:file|software|document|source code) is )?proprietary and confidential
proprietary | 0.7 | unauthorized copying | unauthorized copying of this (?:file|software|document|work)
eula | 0.8 | end user licen | end user licen[cs]e agreement
source-available | 0.6 | source available licen | source available licen[cs]e
see-license | 0.4 | see the licen | see the licen[cs]e (?:file|text)? ?(?:for|in)
copyright | 0.3 | copyright c | copyright c (?:[12][0-9]{3})(?: [12][0-9]{3})*
warranty | 0.3 | as is without warranty | (?:provided|distributed) as is without warrant(?:y|ies) of any kind
"""

#: Every match of a rule holds one of these words; texts with none of them skip all rules.
GATE = (
    "license licence licenses licences licensed licenced unlicense gnu spdx apache copyright domain creative creativecommons cc cc0 mozilla eclipse "
    "rights proprietary unauthorized charge restriction advertising neither redistribution permission unencumbered evil plainly perl illinois w3c warranty warranties"
).split()


def rules() -> list[dict]:
    rows = [[x.strip() for x in line.split(" | ")] for line in RULES_TEXT.strip().splitlines()]
    return [{"p": i, "label": label, "weight": float(weight), "keyword": keyword, "pattern": f"((?<= ){pattern}(?= ))"} for i, (label, weight, keyword, pattern) in enumerate(rows)]
