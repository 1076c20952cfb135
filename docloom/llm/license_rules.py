"""License signatures, in order. Patterns are over words in lower case with one space between them.

A line is: label | keyword | pattern. The keyword is a piece of every match, from the beginning of a word on. Sections set the priority; earlier rules
win ties.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases that are always reported, as base labels.
BASE = (("mit", "license", "mit license"), ("apache", "license", "apache license"), ("gpl", "license", "general public license"))

#: Whole notices and unmistakable sentences of license texts.
NOTICES = """
apache-2.0 | apache | licensed under the apache license version 2 0( the license)?
apache-2.0 | apache | apache license version 2 0 january 2004
apache-2.0 | apache | www apache org licenses license 2 0( txt| html)?
apache-1.1 | apache | (the )?apache software license version 1 1
apache-1.0 | apache | (the )?apache software license version 1 0
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-3-clause | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-source-code | redistributions | redistributions of source code must retain the above copyright notice
bsd-source-code | redistributions | redistributions in binary form must reproduce the above copyright notice
gpl-3.0-or-later | gnu | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | gnu | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-only | gnu | gnu general public license version 2 as published by the free software foundation
gpl-3.0-only | gnu | gnu general public license version 3 as published by the free software foundation
lgpl-3.0-or-later | gnu | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | gnu | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.0-or-later | gnu | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later | gnu | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0 | gnu | gnu general public license version 3 29 june 2007
gpl-2.0 | gnu | gnu general public license version 2 june 1991
gpl-1.0 | gnu | gnu general public license version 1 february 1989
lgpl-2.1 | gnu | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | gnu | gnu lesser general public license version 3 29 june 2007
agpl-3.0 | gnu | gnu affero general public license version 3 19 november 2007
gfdl-1.3 | gnu | gnu free documentation license version 1 3( or any later version)?
gfdl-1.2 | gnu | gnu free documentation license version 1 2( or any later version)?
gfdl-1.1 | gnu | gnu free documentation license version 1 1( or any later version)?
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla | the contents of this file are subject to the mozilla public license version 1 0
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license( v| version)? 2 0
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license( v| version)? 1 0
cddl-1.0 | development | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.1 | cddl | common development and distribution license cddl version 1 1
cddl-1.0 | cddl | common development and distribution license cddl version 1 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | want to public | do what the [a-z]{2,8} you want to public license
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | boost | boost software license version 1 0( 17th august 2003| august 17th 2003)?
artistic-2.0 | artistic | the artistic license 2 0
artistic-1.0 | artistic | the artistic license( version)? 1 0
perl | perl | (this|it) is free software you can redistribute it and or modify it under the same terms as perl itself
python-2.0 | python | python software foundation license version 2
psf-2.0 | python | psf license agreement for python
ofl-1.1 | sil open | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | sil open | sil open font license version 1 1
cc0-1.0 | all copyright and related | has (waived|dedicated) all copyright and related or neighboring rights to this work
cc0-1.0 | dedicated | the person who associated a work with this deed has dedicated the work to the public domain
cc-by-4.0 | creative | licensed under a creative commons attribution 4 0 international( public)? license
cc-by-sa-4.0 | creative | licensed under a creative commons attribution share ?alike 4 0 international( public)? license
cc-by-nc-4.0 | creative | licensed under a creative commons attribution non ?commercial 4 0 international( public)? license
cc-by-nd-4.0 | creative | licensed under a creative commons attribution no ?derivatives 4 0 international( public)? license
cc-by-nc-sa-4.0 | creative | licensed under a creative commons attribution non ?commercial share ?alike 4 0 international( public)? license
cc-by-nc-nd-4.0 | creative | licensed under a creative commons attribution non ?commercial no ?derivatives 4 0 international( public)? license
cc-by-3.0 | creative | licensed under a creative commons attribution 3 0 unported license
cc-by-sa-3.0 | creative | licensed under a creative commons attribution share ?alike 3 0 unported license
cc-by-nc-sa-3.0 | creative | licensed under a creative commons attribution non ?commercial share ?alike 3 0 unported license
postgresql | the university of california | in no event shall the university of california be liable to any party
ncsa | ncsa | university of illinois ncsa open source license
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php | the php license version 3 01
zpl-2.1 | zope | zope public license zpl version 2 1
w3c | w3c | w3c software( notice and)?( document)? license
unicode-dfs-2016 | unicode | unicode inc license agreement data files and software
ms-pl | microsoft | microsoft public license( ms pl)?
ms-rl | microsoft | microsoft reciprocal license( ms rl)?
cpl-1.0 | common public | common public license version 1 0
ipl-1.0 | ibm | ibm public license version 1 0
osl-3.0 | open software | licensed under the open software license version 3 0
afl-3.0 | academic | licensed under the academic free license version 3 0
eupl-1.2 | licensed under | licensed under the( terms of the)? (eupl|european union public licen[cs]e)( v| version)? 1 2
eupl-1.1 | licensed under | licensed under the( terms of the)? (eupl|european union public licen[cs]e)( v| version)? 1 1
beerware | a beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
json | not evil | the software shall be used for good not evil
sspl-1.0 | server side | server side public license( version 1)?
busl-1.1 | business source | business source license( version)? 1 1
elastic-2.0 | elastic license | elastic license( version)? 2 0
commons-clause | commons clause | commons clause license condition v1 0
odbl-1.0 | database | open( data commons open)? database license( odbl)?( v1 0)?
odc-by-1.0 | attribution | open data commons attribution license( v1 0)?
pddl-1.0 | dedication | open data commons public domain dedication and license( pddl)?
ogl-uk-3.0 | government | open government licence( for public sector information)?( v| version)? ?3 0
ogl-uk-2.0 | government | open government licence( for public sector information)?( v| version)? ?2 0
etalab-2.0 | ouverte | licence ouverte( open licence)?( version)? 2 0
cecill-2.1 | cecill | cecill( free software license agreement)?( version| v)? 2 1
cecill-b | cecill | cecill b( free software license agreement)?
cecill-c | cecill | cecill c( free software license agreement)?
llama-2 | llama | llama 2 community license agreement
llama-3 | llama | (meta )?llama 3( [0-9])? community license agreement
openrail | license | (creativeml |bigscience )?open ?rail( m| [+]{0,2}m)? license
gemma | gemma | gemma terms of use
all-rights-reserved | rights reserved | copyright( c)?( [0-9]{4})?( [a-z0-9]+){1,8} all rights reserved
all-rights-reserved | rights reserved | all rights reserved no part of this (publication|work|book|document) may be reproduced
proprietary | confidential | this (document|file|software|material) (is|contains) (proprietary (and|or) confidential|confidential (and|or) proprietary)
proprietary | unauthorized | unauthorized copying of this (file|software|document) via any medium is strictly prohibited
"""

#: Names with a version, and sentences that name a license.
NAMES = """
apache-2.0 | apache | (the )?apache( software)? license( version| v)? ?2( 0)?
apache-2.0 | apache | (the )?apache 2( 0)? licen[cs]e
apache-1.1 | apache | (the )?apache( software)? license( version| v)? ?1 1
mit | license | released under the mit license
mit | license | (licensed|available|distributed|published) under( the terms of)?( the)? mit license
mit | expat | (the )?expat license
x11 | x11 | (the )?x11 license
mit-0 | attribution | mit no attribution license
gpl-3.0 | gnu | gnu general public license( gpl)?( version| v)? ?3( 0)?
gpl-2.0 | gnu | gnu general public license( gpl)?( version| v)? ?2( 0)?
gpl-1.0 | gnu | gnu general public license( gpl)?( version| v)? ?1( 0)?
gpl-3.0 | gpl | gpl ?v? ?3( 0)?( only| or later)?
gpl-2.0 | gpl | gpl ?v? ?2( 0)?( only| or later)?
gpl-3.0 | gplv3 | gplv3( or later)?
gpl-2.0 | gplv2 | gplv2( or later)?
lgpl-3.0 | lesser | gnu lesser general public license( lgpl)?( version| v)? ?3( 0)?
lgpl-2.1 | lesser | gnu lesser general public license( lgpl)?( version| v)? ?2 1
lgpl-2.0 | library | gnu library general public license( lgpl)?( version| v)? ?2( 0)?
lgpl-3.0 | lgplv3 | lgplv3( or later)?
lgpl-2.1 | lgpl | lgpl ?v? ?2 1( only| or later)?
lgpl-3.0 | lgpl | lgpl ?v? ?3( 0)?( only| or later)?
agpl-3.0 | affero | gnu affero general public license( agpl)?( version| v)? ?3( 0)?
agpl-3.0 | agplv3 | agplv3( or later)?
agpl-3.0 | agpl | agpl ?v? ?3( 0)?( only| or later)?
mpl-2.0 | mozilla | mozilla public license( mpl)?( version| v)? ?2( 0)?
mpl-1.1 | mozilla | mozilla public license( mpl)?( version| v)? ?1 1
mpl-2.0 | mpl | mpl ?v? ?2( 0)?
epl-2.0 | eclipse | eclipse public license( epl)?( version| v)? ?2( 0)?
epl-1.0 | eclipse | eclipse public license( epl)?( version| v)? ?1( 0)?
edl-1.0 | eclipse | eclipse distribution license( edl)?( version| v)? ?1( 0)?
bsd-3-clause | bsd | (the )?(3|three) clause bsd licen[cs]e
bsd-2-clause | bsd | (the )?(2|two) clause bsd licen[cs]e
bsd-3-clause | bsd | (the )?(new|modified|revised) bsd licen[cs]e
bsd-2-clause | bsd | (the )?(simplified|freebsd) bsd licen[cs]e
bsd-3-clause | bsd | bsd 3 clause( licen[cs]e)?
bsd-2-clause | bsd | bsd 2 clause( licen[cs]e)?
bsd-4-clause | bsd | (the )?(original|old|4 clause|four clause) bsd licen[cs]e
0bsd | bsd | (the )?(zero|0) clause bsd licen[cs]e
bsl-1.0 | boost | boost software license( version| v)? ?1( 0)?
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-4.0 | cc by | cc by sa 4 0
cc-by-nc-4.0 | cc by | cc by nc 4 0
cc-by-nd-4.0 | cc by | cc by nd 4 0
cc-by-nc-sa-4.0 | cc by | cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc by | cc by nc nd 4 0
cc-by-3.0 | cc by | cc by 3 0
cc-by-sa-3.0 | cc by | cc by sa 3 0
cc-by-nc-3.0 | cc by | cc by nc 3 0
cc-by-nc-sa-3.0 | cc by | cc by nc sa 3 0
cc-by-nc-nd-3.0 | cc by | cc by nc nd 3 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-sa-2.0 | cc by | cc by sa 2 0
cc-by-nc-2.0 | cc by | cc by nc 2 0
cc0-1.0 | cc0 | cc0( 1 0)?( universal)?
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-by-4.0 | creative | creative commons attribution 4 0
cc-by-sa-4.0 | creative | creative commons attribution share ?alike 4 0
cc-by-nc-4.0 | creative | creative commons attribution non ?commercial 4 0
cc-by-nd-4.0 | creative | creative commons attribution no ?deriv(ative)?s 4 0
cc-by-3.0 | creative | creative commons attribution 3 0
cc-by-sa-3.0 | creative | creative commons attribution share ?alike 3 0
gpl-3.0 | gnu | www gnu org licenses gpl 3 0( html| txt)?
gpl-2.0 | gnu | www gnu org licenses( old licenses)? gpl 2 0( html| txt)?
lgpl-3.0 | gnu | www gnu org licenses lgpl 3 0( html| txt)?
lgpl-2.1 | gnu | www gnu org licenses( old licenses)? lgpl 2 1( html| txt)?
agpl-3.0 | gnu | www gnu org licenses agpl 3 0( html| txt)?
mit | opensource | opensource org licenses mit( license php)?
bsd-3-clause | opensource | opensource org licenses bsd 3 clause
bsd-2-clause | opensource | opensource org licenses bsd 2 clause
apache-2.0 | opensource | opensource org licenses apache 2 0
isc | opensource | opensource org licenses isc( license txt)?
mpl-2.0 | mozilla | (www )?mozilla org mpl 2 0
epl-2.0 | eclipse | www eclipse org legal epl 2 0
epl-1.0 | eclipse | www eclipse org legal epl v10 html
bsl-1.0 | boost | www boost org license 1 0 txt
unlicense | unlicense | (the )?unlicense
wtfpl | wtfpl | wtfpl( version| v)?( ?2)?
zlib | zlib | zlib( libpng)? licen[cs]e
libpng | libpng | libpng licen[cs]e( version 2)?
isc | isc licen | isc licen[cs]e
ftl | freetype | (the )?freetype( project)? licen[cs]e
ijg | jpeg group | independent jpeg group
curl | curl licen | curl licen[cs]e
artistic-2.0 | artistic | artistic license( version| v)? ?2( 0)?
python-2.0 | python | python( software foundation)? licen[cs]e
ruby | ruby licen | ruby licen[cs]e
vim | vim licen | vim licen[cs]e
ecl-2.0 | educational | educational community license( version| v)? ?2( 0)?
afl-3.0 | academic | academic free license( version| v)? ?3( 0)?
osl-3.0 | open software | open software license( version| v)? ?3( 0)?
upl-1.0 | universal permissive | universal permissive license( version| v)?( ?1 0)?
eupl-1.2 | eupl | eupl( v| version)? ?1 2
ofl-1.1 | ofl | ofl ?1 1
odbl-1.0 | odbl | odbl( v)?( ?1 0)?
mulan-psl-2.0 | mulan | mulan p(ermissive software )?(sl|license)( v| version)? ?2
"""

#: Mentions that name a family or a status only.
MENTIONS = """
lgpl | lesser | (gnu )?lesser general public license
lgpl | library | (gnu )?library general public license
agpl | affero | (gnu )?affero general public license
gpl-family | gnu | gnu gpl
mpl | mozilla | mozilla public license
epl | eclipse | eclipse public license
bsd | bsd | bsd (style )?licen[cs]ed?
mit | mit licen | mit licen[cs]ed
apache-family | apache | apache licen[cs]ed
cc-family | creative | creative commons( licen[cs]e)?
artistic | artistic | artistic licen[cs]e
public-domain | public domain | (in|into|to) the public domain
public-domain | public domain | public domain( mark| dedication)
copyright | copyright | copyright (c )?(19|20)[0-9]{2}
copyright | rights reserved | all rights reserved
free-software | is free software | (this|it) is free software
open-source | open source | open source licen[cs]ed?
see-license | licen | see( the)? licen[cs]e( file| txt| md)?( for( more)? (details|information))?
see-license | licen | licen[cs]e that can be found in the licen[cs]e file
shareware | shareware | (this is )?shareware
freeware | freeware | (this is )?freeware
trial | evaluation purposes | for evaluation purposes only
non-commercial | commercial | (for )?non commercial (use|purposes) only
non-commercial | noncommercial | (for )?noncommercial (use|purposes) only
no-derivatives | no derivative | no derivative works
dual | dual licensed | dual licensed under
"""

#: Identifiers that tags and short sentences name; rules for each are made from its words.
IDENTIFIERS = """
0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0
cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0
cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpal-1.0 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2
gfdl-1.2 gfdl-1.3 gpl-1.0-only gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later hpnd ipl-1.0 isc lgpl-2.0-only
lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa
nposl-3.0 odbl-1.0 ofl-1.1 osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.5 sspl-1.0 unlicense upl-1.0 w3c wtfpl zlib zpl-2.1
"""


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str  # a piece of every match
    pattern: str
    priority: int
    base: bool = False


def _section(text: str, priority: int) -> list[Rule]:
    return [Rule(*(x.strip() for x in line.split("|", 2)), priority) for line in text.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules in order: base phrases, notices, tags and names of identifiers, names, mentions."""
    tags = []
    for name in IDENTIFIERS.split():
        words = name.replace("-", " ").replace(".", " ")
        tags.append(Rule(name, "spdx", f"spdx license identifier( [a-z0-9]+){{0,8}}? {words}", 4))
        tags.append(Rule(name, "license", f"license {words}", 2))
        tags.append(Rule(name, "licensed", f"licensed under( the)?( terms of the)? {words}( licen[cs]e)?", 3))
    return [*(Rule(*b, 1, True) for b in BASE), *_section(NOTICES, 5), *tags, *_section(NAMES, 3), *_section(MENTIONS, 1)]
