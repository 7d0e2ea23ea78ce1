"""Signature rules of licences, in order: label | tier | keywords that must all occur (a/b: one of them) | pattern.

Patterns run over a text's words in lower case joined by single spaces, where "GPL-2.0-only" is ``gpl 2 0 only``.
A rule's first keyword is its rare one: a text without the first keyword of any rule is never searched. Every string
that a pattern matches holds the rule's keywords as whole words; the tests generate such strings for all rules.
Tiers: 5 licence text, 4 machine-readable tag, 3 notice, 2 name with version, 1 bare name.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Confidence by tier.
CONFIDENCE = {5: 1.0, 4: 0.99, 3: 0.95, 2: 0.8, 1: 0.6}

_V = r"(?:v|version|ver)? ?"
_UNDER = r"(?:licensed|released|distributed|published|available|provided|covered|governed|redistributed) (?:\w+ ){0,4}?under (?:the )?(?:terms of )?(?:the )?"

_RULES = r"""
apache-2.0|5|apache|apache license version 2 0 january 2004
apache-2.0|5|contributor,perpetual|subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
apache-2.0|3|apache|UNDER apache (?:software )?licen[sc]e,? ?VER2(?: 0)?
apache-2.0|3|apache,license|licensed under the apache license version 2 0 the license
apache-2.0|3|www,apache|(?:you may obtain a copy of the license at )?https? www apache org licenses license 2 0(?: txt| html)?
apache-2.0|3|dual,apache|dual licensed under (?:the )?(?:mit(?: license)?(?: and| or) (?:the )?apache|apache(?: license)?(?: and| or) (?:the )?(?:mit|apache))(?: license)?(?: VER2 0)?
apache-2.0|2|apache|apache (?:software |public )?licen[sc]e VER2(?: 0)?
apache-2.0|2|apache|apache 2(?: 0)? licen[sc]e
apache-2.0|2|asl|asl 2(?: 0)?
apache-1.1|5|apache|apache software license version 1 1
apache-1.1|2|apache|apache (?:software )?licen[sc]e VER1 1
apache-1.0|2|apache|apache (?:software )?licen[sc]e VER1(?: 0)?
apache-1.0|5|apache|this product includes software developed by the apache group for use in the apache http server
apache|1|apache|apache licen[sc]e
apache|1|apache|apache style licen[sc]e
mit|5|obtaining,associated|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|5|noninfringement|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit|3|license/licence,mit|UNDER mit licen[sc]e
mit|3|license,mit|this (?:project|software|work|code|package|library) is (?:licensed|released|distributed) under the mit license
mit|3|opensource,mit|https? (?:www )?opensource org licenses? mit(?: license)?(?: php| html)?
mit|2|license/licence,mit|(?:the )?mit licen[sc]e mit
mit|2|licence,mit|(?:the )?mit licence
mit|1|license,mit|mit (?:style |x11 |expat )?license
mit|1|expat|expat licen[sc]e
mit|1|licensed,mit|mit licensed
mit-0|2|attribution,mit|mit no attribution(?: licen[sc]e)?
x11|1|x11|x11 licen[sc]e
x11|5|consortium|x consortium be liable for any claim damages or other liability
bsd-2-clause|5|redistribution,permitted|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause|5|endorse,neither|neither the name of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause|5|advertising|all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause|3|bsd|UNDER (?:new |modified |revised |3 clause |three clause )bsd licen[sc]e
bsd-2-clause|3|bsd|UNDER (?:simplified |freebsd |2 clause |two clause )bsd licen[sc]e
bsd|3|bsd|UNDER (?:a )?bsd(?: style)? licen[sc]e
bsd-2-clause|2|bsd|bsd 2 clause(?: licen[sc]e)?
bsd-3-clause|2|bsd|bsd 3 clause(?: licen[sc]e)?
bsd-4-clause|2|bsd|bsd 4 clause(?: licen[sc]e)?
bsd-2-clause|2|bsd|(?:2|two) clause bsd(?: licen[sc]e)?
bsd-3-clause|2|bsd|(?:3|three) clause bsd(?: licen[sc]e)?
bsd-4-clause|2|bsd|(?:4|four) clause bsd(?: licen[sc]e)?
bsd-2-clause|2|bsd|simplified bsd licen[sc]e
bsd-3-clause|2|bsd|(?:new|modified|revised) bsd licen[sc]e
bsd-4-clause|2|bsd|original bsd licen[sc]e
0bsd|2|0bsd|0bsd
0bsd|2|bsd|(?:zero|0) clause bsd(?: licen[sc]e)?
bsd|1|bsd|bsd(?: style)? licen[sc]ed?
bsd|3|opensource,bsd|https? (?:www )?opensource org licenses? bsd license(?: php)?
isc|5|hereby,fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|2|isc|isc licen[sc]e
isc|3|isc|UNDER isc licen[sc]e
gpl-1.0|2|general|gnu general public licen[sc]e,? ?VER1(?: 0)?
gpl-2.0|2|general|gnu general public licen[sc]e VER2(?: 0)?
gpl-3.0|2|general|gnu general public licen[sc]e VER3(?: 0)?
gpl-2.0|3|general|UNDER gnu general public licen[sc]e VER2(?: 0)?(?: only)?
gpl-3.0|3|general|UNDER gnu general public licen[sc]e VER3(?: 0)?(?: only)?
gpl-2.0-or-later|3|general|gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later|3|general|gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later|3|general|UNDER gnu general public licen[sc]e VER2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later|3|general|UNDER gnu general public licen[sc]e VER3(?: 0)? or (?:any )?later(?: version)?
gpl-2.0|5|general|gnu general public license version 2 june 1991
gpl-3.0|5|general|gnu general public license version 3 29 june 2007
gpl-1.0|5|general|gnu general public license version 1 february 1989
gpl|3|general|UNDER gnu general public licen[sc]e
gpl|3|general|you should have received a copy of the gnu general public license along with
gpl|1|general|gnu general public licen[sc]e
gpl-2.0|2|gpl|gpl VER2(?: 0)?(?: only)?
gpl-3.0|2|gpl|gpl VER3(?: 0)?(?: only)?
gpl-2.0-or-later|2|gpl|gpl VER2(?: 0)? or later
gpl-3.0-or-later|2|gpl|gpl VER3(?: 0)? or later
gpl-2.0|2|gplv2|gplv2
gpl-3.0|2|gplv3|gplv3
gpl-2.0|2|gpl2|gpl2
gpl-3.0|2|gpl3|gpl3
gpl|3|gnu|https? www gnu org (?:licenses|copyleft) gpl(?: 2 0| 3 0)?(?: html| txt)?
gpl|1|gpl|gnu gpl
gpl|1|gpl|gpl licen[sc]ed?
gpl-classpath|2|classpath|classpath exception
gpl-gcc-exception|2|gcc|gcc runtime library exception
gpl-linking-exception|2|linking|linking exception
gpl-font-exception|2|font,embed|as a special exception if you create a document which uses this font and embed
lgpl-2.0|2|library,general|gnu library general public licen[sc]e VER2(?: 0)?
lgpl-2.1|2|lesser|gnu lesser general public licen[sc]e VER2 1
lgpl-3.0|2|lesser|gnu lesser general public licen[sc]e VER3(?: 0)?
lgpl-2.1|3|lesser|UNDER gnu lesser general public licen[sc]e VER2 1
lgpl-3.0|3|lesser|UNDER gnu lesser general public licen[sc]e VER3(?: 0)?
lgpl-2.1-or-later|3|lesser|gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later|3|lesser|gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1|5|lesser|gnu lesser general public license version 2 1 february 1999
lgpl-3.0|5|lesser|gnu lesser general public license version 3 29 june 2007
lgpl|3|lesser|UNDER gnu lesser general public licen[sc]e
lgpl|1|lesser|(?:gnu )?lesser general public licen[sc]e
lgpl|1|library,general|gnu library general public licen[sc]e
lgpl-2.1|2|lgpl|lgpl VER2 1
lgpl-3.0|2|lgpl|lgpl VER3(?: 0)?
lgpl-2.1|2|lgplv2|lgplv2(?: 1)?
lgpl-3.0|2|lgplv3|lgplv3
lgpl|1|lgpl|(?:gnu )?lgpl
lgpl|3|gnu|https? www gnu org (?:licenses|copyleft) lgpl(?: 2 1| 3 0)?(?: html| txt)?
agpl-3.0|2|affero|gnu affero general public licen[sc]e VER3(?: 0)?
agpl-3.0|3|affero|UNDER gnu affero general public licen[sc]e VER3(?: 0)?
agpl-3.0|5|affero|gnu affero general public license version 3 19 november 2007
agpl-3.0-or-later|3|affero|gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl|3|affero|UNDER (?:gnu )?affero general public licen[sc]e
agpl|1|affero|(?:gnu )?affero general public licen[sc]e
agpl-1.0|2|affero|affero general public licen[sc]e VER1(?: 0)?
agpl-3.0|2|agpl|agpl VER3(?: 0)?
agpl-3.0|2|agplv3|agplv3
agpl|1|agpl|(?:gnu )?agpl
gfdl-1.1|2|documentation,free|gnu free documentation licen[sc]e VER1 1
gfdl-1.2|2|documentation,free|gnu free documentation licen[sc]e VER1 2
gfdl-1.3|2|documentation,free|gnu free documentation licen[sc]e VER1 3
gfdl|1|documentation,free|(?:gnu )?free documentation licen[sc]e
gfdl|1|gfdl|gfdl
gfdl|3|invariant|with no invariant sections no front cover texts and no back cover texts
mpl-1.0|2|mozilla|mozilla public licen[sc]e VER1(?: 0)?
mpl-1.1|2|mozilla|mozilla public licen[sc]e VER1 1
mpl-2.0|2|mozilla|mozilla public licen[sc]e VER2(?: 0)?
mpl-2.0|3|mozilla|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1|3|mozilla|the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0|3|mozilla|UNDER mozilla public licen[sc]e VER2(?: 0)?
mpl-2.0|3|mozilla|https? (?:www )?mozilla org mpl 2 0
mpl|1|mozilla|mozilla public licen[sc]e
mpl-1.1|2|mpl|mpl VER1 1
mpl-2.0|2|mpl|mpl VER2(?: 0)?
epl-1.0|2|eclipse|eclipse public licen[sc]e VER1(?: 0)?
epl-2.0|2|eclipse|eclipse public licen[sc]e VER2(?: 0)?
epl-1.0|3|eclipse|this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0|3|eclipse|this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
epl|1|eclipse|eclipse public licen[sc]e
edl-1.0|2|eclipse|eclipse distribution licen[sc]e VER1(?: 0)?
cpl-1.0|2|common|common public licen[sc]e VER1(?: 0)?
cddl-1.0|2|cddl|cddl VER1(?: 0)?
cddl-1.1|2|cddl|cddl VER1 1
cddl|1|cddl|cddl
cddl-1.0|2|development,distribution|common development and distribution licen[sc]e VER1(?: 0)?
cddl-1.1|2|development,distribution|common development and distribution licen[sc]e VER1 1
cddl|1|development,distribution|common development and distribution licen[sc]e
cpal-1.0|1|attribution,common|common public attribution licen[sc]e
apsl-2.0|2|apple|apple public source licen[sc]e VER2(?: 0)?
apsl|1|apple|apple public source licen[sc]e
ms-pl|1|microsoft|microsoft public licen[sc]e
ms-rl|1|microsoft|microsoft reciprocal licen[sc]e
ms-pl|1|ms,pl|ms pl
artistic-1.0|2|artistic|artistic licen[sc]e VER1(?: 0)?
artistic-2.0|2|artistic|artistic licen[sc]e VER2(?: 0)?
artistic|1|artistic|artistic licen[sc]e
artistic-perl|3|perl|under the same terms as perl itself
python-2.0|2|psf|psf licen[sc]e(?: VER2(?: 0)?)?
python-2.0|1|python|python software foundation licen[sc]e(?: VER2(?: 0)?)?
php-3.0|2|php|php licen[sc]e VER3(?: 0)?
php-3.01|2|php|php licen[sc]e VER3 01
ruby|1|ruby|ruby licen[sc]e
ruby|3|ruby|under the same terms as ruby
zlib|5|misrepresented|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|1|zlib|zlib(?: libpng)? licen[sc]e
libpng|1|libpng|libpng licen[sc]e
boost-1.0|2|boost|boost software licen[sc]e VER1(?: 0)?
boost-1.0|3|boost|distributed under the boost software license version 1 0
boost-1.0|1|boost|boost software licen[sc]e
unlicense|5|unencumbered|this is free and unencumbered software released into the public domain
unlicense|1|unlicense|(?:the )?unlicense
unlicense|3|unlicense|https? unlicense org
wtfpl|5|fuck|do what the fuck you want to(?: public license)?
wtfpl|1|wtfpl|wtfpl
beerware|5|beer|if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware|1|beerware|beerware(?: licen[sc]e)?
public-domain|3|domain|(?:released|placed|dedicated|donated|put) (?:in|into|to) the public domain
public-domain|3|domain|(?:is|are) (?:hereby )?in the public domain
public-domain|2|domain|public domain (?:dedication|mark|work|notice)
cc0-1.0|2|cc0|cc0 1 0(?: universal)?
cc0-1.0|1|cc0|cc0
cc0-1.0|5|waives,affirmer|affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0|3|publicdomain|https? creativecommons org publicdomain zero 1 0
pdm-1.0|3|publicdomain|https? creativecommons org publicdomain mark 1 0
cc-by-1.0|2|cc|cc by 1 0
cc-by-2.0|2|cc|cc by 2 0
cc-by-2.5|2|cc|cc by 2 5
cc-by-3.0|2|cc|cc by 3 0
cc-by-4.0|2|cc|cc by 4 0
cc-by-sa-1.0|2|cc|cc by sa 1 0
cc-by-sa-2.0|2|cc|cc by sa 2 0
cc-by-sa-2.5|2|cc|cc by sa 2 5
cc-by-sa-3.0|2|cc|cc by sa 3 0
cc-by-sa-4.0|2|cc|cc by sa 4 0
cc-by-nd-2.0|2|cc|cc by nd 2 0
cc-by-nd-3.0|2|cc|cc by nd 3 0
cc-by-nd-4.0|2|cc|cc by nd 4 0
cc-by-nc-2.0|2|cc|cc by nc 2 0
cc-by-nc-2.5|2|cc|cc by nc 2 5
cc-by-nc-3.0|2|cc|cc by nc 3 0
cc-by-nc-4.0|2|cc|cc by nc 4 0
cc-by-nc-sa-2.0|2|cc|cc by nc sa 2 0
cc-by-nc-sa-2.5|2|cc|cc by nc sa 2 5
cc-by-nc-sa-3.0|2|cc|cc by nc sa 3 0
cc-by-nc-sa-4.0|2|cc|cc by nc sa 4 0
cc-by-nc-nd-2.0|2|cc|cc by nc nd 2 0
cc-by-nc-nd-3.0|2|cc|cc by nc nd 3 0
cc-by-nc-nd-4.0|2|cc|cc by nc nd 4 0
cc-by-nc-4.0|3|cc|UNDER cc by nc 4 0
cc-by-4.0|3|cc|UNDER cc by 4 0
cc-by-sa-4.0|3|cc|UNDER cc by sa 4 0
cc-by-nc-sa-4.0|3|cc|UNDER cc by nc sa 4 0
cc-by-nc-nd-4.0|3|cc|UNDER cc by nc nd 4 0
cc-by-nc-nd|1|cc|cc by nc nd
cc-by-nc-sa|1|cc|cc by nc sa
cc-by-nc|1|cc|cc by nc
cc-by-nd|1|cc|cc by nd
cc-by-sa|1|cc|cc by sa
cc-by-1.0|3|creativecommons|https? creativecommons org licenses by 1 0
cc-by-2.0|3|creativecommons|https? creativecommons org licenses by 2 0
cc-by-2.5|3|creativecommons|https? creativecommons org licenses by 2 5
cc-by-3.0|3|creativecommons|https? creativecommons org licenses by 3 0
cc-by-4.0|3|creativecommons|https? creativecommons org licenses by 4 0
cc-by-sa-2.0|3|creativecommons|https? creativecommons org licenses by sa 2 0
cc-by-sa-2.5|3|creativecommons|https? creativecommons org licenses by sa 2 5
cc-by-sa-3.0|3|creativecommons|https? creativecommons org licenses by sa 3 0
cc-by-sa-4.0|3|creativecommons|https? creativecommons org licenses by sa 4 0
cc-by-nd-4.0|3|creativecommons|https? creativecommons org licenses by nd 4 0
cc-by-nd-3.0|3|creativecommons|https? creativecommons org licenses by nd 3 0
cc-by-nc-3.0|3|creativecommons|https? creativecommons org licenses by nc 3 0
cc-by-nc-4.0|3|creativecommons|https? creativecommons org licenses by nc 4 0
cc-by-nc-sa-3.0|3|creativecommons|https? creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0|3|creativecommons|https? creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0|3|creativecommons|https? creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0|3|creativecommons|https? creativecommons org licenses by nc nd 4 0
cc-by-4.0|2|creative|creative commons attribution 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-3.0|2|creative|creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-2.0|2|creative|creative commons attribution 2 0(?: generic)?(?: licen[sc]e)?
cc-by-sa-4.0|2|creative|creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-sa-3.0|2|creative|creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-4.0|2|creative|creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-3.0|2|creative|creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-sa-4.0|2|creative|creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-sa-3.0|2|creative|creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-nd-4.0|2|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nd-4.0|2|creative|creative commons attribution no ?deriv(?:ative)?s? 4 0(?: international)?(?: public)?(?: licen[sc]e)?
cc-by-nc-nd|1|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: licen[sc]e)?
cc-by-nc-sa|1|creative|creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc|1|creative|creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-sa|1|creative|creative commons attribution share ?alike(?: licen[sc]e)?
cc|1|creative|creative commons(?: attribution)? licen[sc]e
odbl-1.0|2|odbl|odbl(?: VER1(?: 0)?)?
odbl-1.0|1|database,open|open database licen[sc]e(?: VER1(?: 0)?)?
odc-by-1.0|1|attribution,data|open data commons attribution licen[sc]e(?: VER1(?: 0)?)?
pddl-1.0|1|pddl|pddl
pddl-1.0|1|domain,dedication|public domain dedication and licen[sc]e
cdla-permissive|1|community,permissive|community data license agreement permissive
cdla-sharing|1|community,sharing|community data license agreement sharing
ogl-uk-3.0|2|government|open government licen[sc]e VER3(?: 0)?
ogl-uk|1|government|open government licen[sc]e
ofl-1.1|2|sil|sil open font licen[sc]e(?: VER1 1)?
ofl-1.1|2|ofl|ofl(?: VER1 1)?
ofl-1.1|3|sil|this font software is licensed under the sil open font license version 1 1
eupl-1.1|2|eupl|eupl VER1 1
eupl-1.2|2|eupl|eupl VER1 2
eupl|1|eupl|eupl
eupl|1|european|european union public licen[sc]e(?: VER1 [12])?
cecill-2.1|2|cecill|cecill(?: free software licen[sc]e)?(?: VER2 [01])?
osl-3.0|1|open,software|open software licen[sc]e(?: VER3(?: 0)?)?
afl-3.0|1|academic|academic free licen[sc]e(?: VER3(?: 0)?)?
ecl-2.0|1|educational|educational community licen[sc]e(?: VER2(?: 0)?)?
upl-1.0|1|universal,permissive|universal permissive licen[sc]e(?: VER1(?: 0)?)?
ncsa|1|ncsa|(?:university of illinois )?ncsa open source licen[sc]e
w3c|1|w3c|w3c software(?: notice and)?(?: and document)? licen[sc]e
openssl|1|openssl|openssl licen[sc]e
ssleay|5|cryptographic,young|this product includes cryptographic software written by eric young
postgresql|1|postgresql|postgresql licen[sc]e
vim|1|vim|vim licen[sc]e
json|5|evil|the software shall be used for good not evil
lppl-1.3c|2|latex|latex project public licen[sc]e(?: VER1 3c?)?
lppl|1|lppl|lppl
qpl-1.0|1|q,public|q public licen[sc]e(?: VER1(?: 0)?)?
sleepycat|1|sleepycat|sleepycat licen[sc]e
blueoak-1.0.0|1|oak|blue oak model licen[sc]e(?: VER1 0 0)?
mulan-2.0|1|mulan|mulan permissive software licen[sc]e(?: VER2)?
bsl-1.1|2|business|business source licen[sc]e(?: VER1 1)?
sspl-1.0|1|sspl|sspl(?: VER1)?
sspl-1.0|1|side,server|server side public licen[sc]e(?: VER1)?
elastic-2.0|1|elastic|elastic licen[sc]e(?: VER2(?: 0)?)?
commons-clause|1|clause,commons|commons clause(?: licen[sc]e condition)?(?: VER1 0)?
polyform-nc-1.0|1|polyform|polyform noncommercial licen[sc]e(?: 1 0 0)?
openrail|1|openrail|(?:creativeml )?openrail(?: m)?(?: licen[sc]e)?
openrail|1|responsible,ai|responsible ai licen[sc]e
llama-community|1|llama|llama (?:\d )?(?:\d )?community licen[sc]e(?: agreement)?
proprietary|3|proprietary|proprietary and confidential
proprietary|3|unauthorized/unauthorised|unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|work|document|material)
proprietary|3|reproduced|no part of this (?:\w+ )?(?:may|can) be reproduced
proprietary|2|commercial,license/licence|commercial licen[sc]e(?: agreement)? (?:is )?required
proprietary|1|eula|(?:end user licen[sc]e agreement )?eula
proprietary|1|agreement,user|end user licen[sc]e agreement
noncommercial|2|commercial/noncommercial,only|(?:for )?non ?commercial (?:use|purposes|research) only
noncommercial|2|commercial,not|not for commercial use
research-only|2|research,only|(?:for )?research (?:use|purposes) only
copyright|2|copyright|(?:c )?copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright|1|copyrighted|copyrighted (?:material|work|content)
reserved|2|reserved|(?:all|some|no) rights reserved
reserved|2|vorbehalten|alle rechte vorbehalten
reserved|2|reservados|todos los derechos reservados
reserved|2|réservés|tous droits réservés
apache-2.0|4|spdx|spdx license identifier apache 2 0
mit|4|spdx|spdx license identifier mit
mit-0|4|spdx|spdx license identifier mit 0
bsd-2-clause|4|spdx|spdx license identifier bsd 2 clause
bsd-3-clause|4|spdx|spdx license identifier bsd 3 clause
0bsd|4|spdx|spdx license identifier 0bsd
isc|4|spdx|spdx license identifier isc
gpl-1.0|4|spdx|spdx license identifier gpl 1 0(?: only)?
gpl-2.0|4|spdx|spdx license identifier gpl 2 0(?: only)?
gpl-3.0|4|spdx|spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later|4|spdx|spdx license identifier gpl 2 0 or later
gpl-3.0-or-later|4|spdx|spdx license identifier gpl 3 0 or later
lgpl-2.0|4|spdx|spdx license identifier lgpl 2 0(?: only)?
lgpl-2.1|4|spdx|spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0|4|spdx|spdx license identifier lgpl 3 0(?: only)?
lgpl-2.1-or-later|4|spdx|spdx license identifier lgpl 2 1 or later
lgpl-3.0-or-later|4|spdx|spdx license identifier lgpl 3 0 or later
agpl-3.0|4|spdx|spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later|4|spdx|spdx license identifier agpl 3 0 or later
mpl-1.1|4|spdx|spdx license identifier mpl 1 1
mpl-2.0|4|spdx|spdx license identifier mpl 2 0
epl-1.0|4|spdx|spdx license identifier epl 1 0
epl-2.0|4|spdx|spdx license identifier epl 2 0
cddl-1.0|4|spdx|spdx license identifier cddl 1 0
artistic-2.0|4|spdx|spdx license identifier artistic 2 0
boost-1.0|4|spdx|spdx license identifier bsl 1 0
bsl-1.1|4|spdx|spdx license identifier busl 1 1
zlib|4|spdx|spdx license identifier zlib
unlicense|4|spdx|spdx license identifier unlicense
wtfpl|4|spdx|spdx license identifier wtfpl
cc0-1.0|4|spdx|spdx license identifier cc0 1 0
cc-by-3.0|4|spdx|spdx license identifier cc by 3 0
cc-by-4.0|4|spdx|spdx license identifier cc by 4 0
cc-by-sa-3.0|4|spdx|spdx license identifier cc by sa 3 0
cc-by-sa-4.0|4|spdx|spdx license identifier cc by sa 4 0
cc-by-nc-4.0|4|spdx|spdx license identifier cc by nc 4 0
cc-by-nd-4.0|4|spdx|spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0|4|spdx|spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0|4|spdx|spdx license identifier cc by nc nd 4 0
odbl-1.0|4|spdx|spdx license identifier odbl 1 0
ofl-1.1|4|spdx|spdx license identifier ofl 1 1
eupl-1.2|4|spdx|spdx license identifier eupl 1 2
upl-1.0|4|spdx|spdx license identifier upl 1 0
other|4|spdx|spdx license identifier [a-z]+(?: \w+)?
"""


class Rule(NamedTuple):
    label: str
    tier: int
    gate: tuple[frozenset[bytes], ...]
    pattern: re.Pattern

    @property
    def keywords(self) -> tuple[bytes, ...]:
        return tuple(k for choice in self.gate for k in sorted(choice))

    def may_match(self, words: set[bytes]) -> bool:
        return not any(words.isdisjoint(choice) for choice in self.gate)


def load() -> list[Rule]:
    rules = []
    for line in _RULES.strip().splitlines():
        label, tier, keywords, pattern = line.split("|", 3)
        pattern = pattern.replace("VER", _V).replace("UNDER ", _UNDER)
        gate = tuple(frozenset(k.encode().split(b"/")) for k in keywords.split(","))
        rules.append(Rule(label, int(tier), gate, re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )")))
    return rules
