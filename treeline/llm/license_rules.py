"""Signatures of licences, by hand, in the order of their rank among equals.

A paragraph begins with a label and the keyword that each of its signatures holds; a line is a
priority (4: a whole notice or identifier, 3: a name with its version, 2: a name, 1: a mere mention)
and words, each a regular expression over one lower-case word. `?x` is a word that may be absent,
`*n` up to n words of any kind.
"""

from __future__ import annotations

import re

SIGNATURES = """
mit mit
4 licen[cs]ed under the mit licen[cs]e
4 released under the mit licen[cs]e
4 distributed under the mit licen[cs]e
4 available under the mit licen[cs]e
4 spdx licen[cs]e identifier mit
4 licen[cs]e mit
3 mit expat licen[cs]e
3 mit x11 licen[cs]e
2 ?the mit licen[cs]e
2 mit licen[cs]ed
2 mit style licen[cs]e
1 mit licen[cs]e terms

mit permission
4 permission is hereby granted free of charge to any person obtaining a copy *6
4 permission is hereby granted free of charge
3 the above copyright notice and this permission notice shall be included

mit-0 mit
4 spdx licen[cs]e identifier mit 0
3 mit no attribution ?licen[cs]e
3 mit 0 licen[cs]e

isc permission
4 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 permission to use copy modify and ?or distribute this software

isc isc
4 spdx licen[cs]e identifier isc
4 licen[cs]ed under the isc licen[cs]e
2 isc licen[cs]e

apache-2.0 apache
4 licen[cs]ed under the apache licen[cs]e version 2 0
4 licen[cs]ed under ?the apache ?licen[cs]e v?2 ?0
4 released under the apache licen[cs]e ?version v?2 ?0
4 distributed under the apache licen[cs]e ?version v?2 ?0
4 spdx licen[cs]e identifier apache 2 0
4 www apache org licenses licen[cs]e 2 0
3 apache licen[cs]e version 2 ?0
3 apache licen[cs]e v?2 ?0
3 apache software licen[cs]e ?version v?2 ?0
3 apache v?2 ?0 ?licen[cs]e

apache-1.1 apache
4 spdx licen[cs]e identifier apache 1 1
3 apache ?software licen[cs]e ?version v?1 1

apache-1.0 apache
4 spdx licen[cs]e identifier apache 1 0
3 apache ?software licen[cs]e ?version v?1 0

apache apache
4 licen[cs]ed under the apache licen[cs]e
4 licen[cs]ed to the apache software foundation
2 ?the apache ?software licen[cs]e
2 apache style licen[cs]e
1 apache licen[cs]ed

gpl-3.0 general
4 licen[cs]ed under the gnu general public licen[cs]e version 3
4 under the terms of the gnu general public licen[cs]e *12 version 3
4 gnu general public licen[cs]e version 3 ?of ?the ?licen[cs]e or ?at ?your ?option ?any later ?version
3 gnu general public licen[cs]e ?as ?published *6 version 3 ?0
3 ?gnu general public licen[cs]e v3|3 ?0

gpl-3.0 gpl
4 spdx licen[cs]e identifier gpl 3 0 ?only|or ?later
3 ?gnu gpl version 3 ?0
3 ?gnu gpl v3|3 ?0
3 gplv3|gpl3

gpl-2.0 general
4 licen[cs]ed under the gnu general public licen[cs]e version 2
4 under the terms of the gnu general public licen[cs]e *12 version 2
4 gnu general public licen[cs]e version 2 ?of ?the ?licen[cs]e or ?at ?your ?option ?any later ?version
3 gnu general public licen[cs]e ?as ?published *6 version 2 ?0
3 ?gnu general public licen[cs]e v2|2 ?0

gpl-2.0 gpl
4 spdx licen[cs]e identifier gpl 2 0 ?only|or ?later
3 ?gnu gpl version 2 ?0
3 ?gnu gpl v2|2 ?0
3 gplv2|gpl2

gpl-1.0 general
3 gnu general public licen[cs]e version 1 ?0

gpl general
4 under the terms of the gnu general public licen[cs]e
4 you should have received a copy of the gnu general public licen[cs]e
2 gnu general public licen[cs]e
2 general public licen[cs]e

gpl gpl
4 licen[cs]ed under the gpl
4 released under the gpl
2 gnu gpl
1 gpl
1 gpl compatible

lgpl-3.0 lesser
4 under the terms of the gnu lesser general public licen[cs]e *12 version 3
3 gnu lesser general public licen[cs]e ?version v?3 ?0

lgpl-2.1 lesser
4 under the terms of the gnu lesser general public licen[cs]e *12 version 2 ?1
3 gnu lesser general public licen[cs]e ?version v?2 1

lgpl lesser
4 you should have received a copy of the gnu lesser general public licen[cs]e
2 ?gnu lesser general public licen[cs]e

lgpl-2.0 library
3 gnu library general public licen[cs]e ?version v?2 ?0
2 ?gnu library general public licen[cs]e

lgpl lgpl
4 spdx licen[cs]e identifier lgpl *4
3 lgpl ?version v?2|v?3 ?0|1
3 lgplv2|lgplv3|lgpl3
2 gnu lgpl
1 lgpl

agpl-3.0 affero
4 under the terms of the gnu affero general public licen[cs]e *12 version 3
3 gnu affero general public licen[cs]e ?version v?3 ?0

agpl affero
4 you should have received a copy of the gnu affero general public licen[cs]e
2 ?gnu affero general public licen[cs]e

agpl-3.0 agpl
4 spdx licen[cs]e identifier agpl 3 0 ?only|or ?later
3 ?gnu agpl ?version v?3 ?0
3 agplv3|agpl3

agpl agpl
1 agpl

gfdl free
3 gnu free documentation licen[cs]e ?version v?1 0|1|2|3
2 gnu free documentation licen[cs]e

gfdl gfdl
1 gfdl

bsd-2-clause bsd
4 spdx licen[cs]e identifier bsd 2 clause
3 bsd 2 clause ?simplified ?licen[cs]e
3 2 clause bsd ?licen[cs]e
3 simplified bsd licen[cs]e
3 two clause bsd ?licen[cs]e
3 freebsd licen[cs]e

bsd-3-clause bsd
4 spdx licen[cs]e identifier bsd 3 clause
3 bsd 3 clause ?new|revised ?or ?revised ?licen[cs]e
3 3 clause bsd ?licen[cs]e
3 three clause bsd ?licen[cs]e
3 new bsd licen[cs]e
3 modified bsd licen[cs]e
3 revised bsd licen[cs]e

bsd-4-clause bsd
4 spdx licen[cs]e identifier bsd 4 clause
3 bsd 4 clause ?licen[cs]e
3 4 clause bsd ?licen[cs]e
3 original bsd licen[cs]e

bsd bsd
4 licen[cs]ed under the bsd licen[cs]e
4 released under the bsd licen[cs]e
4 governed by a bsd style licen[cs]e
2 ?the bsd licen[cs]e
2 bsd style licen[cs]e
1 bsd licen[cs]ed

0bsd 0bsd
4 spdx licen[cs]e identifier 0bsd
2 0bsd

0bsd bsd
3 zero clause bsd ?licen[cs]e

bsd redistribution
4 redistribution and use in source and binary forms with or without modification are permitted
3 redistributions of source code must retain the above copyright notice
3 redistributions in binary form must reproduce the above copyright notice
2 redistribution and use in source and binary forms

bsd-3-clause endorse
3 may be used to endorse or promote products derived from this software

bsd-4-clause advertising
4 all advertising materials mentioning features or use of this software must display

mpl-2.0 mozilla
4 subject to the terms of the mozilla public licen[cs]e v 2 0
4 licen[cs]ed under the mozilla public licen[cs]e ?version v?2 ?0
3 mozilla public licen[cs]e ?version ?v v?2 ?0

mpl-1.1 mozilla
3 mozilla public licen[cs]e ?version ?v v?1 1
4 subject to the mozilla public licen[cs]e version 1 1

mpl-1.0 mozilla
3 mozilla public licen[cs]e ?version ?v v?1 0

mpl mozilla
4 subject to the terms of the mozilla public licen[cs]e
2 mozilla public licen[cs]e

mpl-2.0 mpl
4 spdx licen[cs]e identifier mpl 2 0
3 mpl ?version ?v v?2 ?0

mpl mpl
4 spdx licen[cs]e identifier mpl *2
1 mpl licen[cs]ed?

epl-2.0 eclipse
4 made available under the terms of the eclipse public licen[cs]e ?version ?v v?2 ?0
3 eclipse public licen[cs]e ?version ?v v?2 ?0

epl-1.0 eclipse
4 made available under the terms of the eclipse public licen[cs]e ?version ?v v?1 ?0
3 eclipse public licen[cs]e ?version ?v v?1 ?0

epl eclipse
2 eclipse public licen[cs]e

edl-1.0 eclipse
2 eclipse distribution licen[cs]e ?version ?v ?v?1 ?0

cddl-1.0 distribution
3 common development and distribution licen[cs]e ?version ?v v?1 0
2 common development and distribution licen[cs]e

cddl cddl
4 spdx licen[cs]e identifier cddl *2
2 cddl

cpl-1.0 common
3 common public licen[cs]e ?version v?1 0
2 common public licen[cs]e

ibm-pl ibm
2 ibm public licen[cs]e

eupl-1.2 european
4 licen[cs]ed under the european union public licen[cs]e
3 european union public licen[cs]e ?version ?v v?1 2
2 european union public licen[cs]e

eupl eupl
4 licen[cs]ed under the eupl
2 eupl

cc0-1.0 cc0
4 spdx licen[cs]e identifier cc0 1 0
3 cc0 ?1 ?0 universal
3 cc0 1 0
2 cc0

cc0-1.0 creative
4 creative commons zero ?v?1 ?0 ?universal
3 creative commons public domain dedication

cc-by-4.0 creative
4 creative commons attribution 4 0 international ?public ?licen[cs]e
3 creative commons attribution ?licen[cs]e ?version 4 0

cc-by-3.0 creative
3 creative commons attribution ?licen[cs]e ?version 3 0 ?unported

cc-by-sa creative
4 creative commons attribution share ?alike *2 ?4|3 ?0 ?international|unported ?licen[cs]e
4 creative commons attribution sharealike *2 ?licen[cs]e

cc-by-nd creative
4 creative commons attribution no derivs|derivatives *2 ?licen[cs]e
4 creative commons attribution noderivs|noderivatives *2 ?licen[cs]e

cc-by-nc creative
4 creative commons attribution non ?commercial *2 ?licen[cs]e
4 creative commons attribution noncommercial *2 ?licen[cs]e

cc-by-nc-sa creative
4 creative commons attribution noncommercial share ?alike *3 ?licen[cs]e
4 creative commons attribution noncommercial sharealike *3 ?licen[cs]e
4 creative commons attribution non commercial share alike *3 ?licen[cs]e

cc-by-nc-nd creative
4 creative commons attribution noncommercial noderivs|noderivatives *3 ?licen[cs]e
4 creative commons attribution non commercial no derivs|derivatives *3 ?licen[cs]e

cc-by creative
2 creative commons attribution ?licen[cs]e

cc creative
4 licen[cs]ed under a creative commons licen[cs]e
2 creative commons licen[cs]e
1 creative commons

cc-by-4.0 cc
4 licen[cs]ed under cc by 4 0
3 cc by 4 0

cc-by-3.0 cc
4 licen[cs]ed under cc by 3 0
3 cc by 3 0

cc-by-sa cc
4 licen[cs]ed under cc by sa ?1|2|3|4 ?0|5
3 cc by sa 4 0
3 cc by sa 3 0
2 cc by sa

cc-by-nc cc
4 licen[cs]ed under cc by nc ?1|2|3|4 ?0|5
3 cc by nc 4 0
3 cc by nc 3 0
2 cc by nc

cc-by-nd cc
4 licen[cs]ed under cc by nd ?1|2|3|4 ?0|5
3 cc by nd 4 0
2 cc by nd

cc-by-nc-sa cc
4 licen[cs]ed under cc by nc sa ?1|2|3|4 ?0|5
3 cc by nc sa 4 0
2 cc by nc sa

cc-by-nc-nd cc
4 licen[cs]ed under cc by nc nd ?1|2|3|4 ?0|5
3 cc by nc nd 4 0
2 cc by nc nd

cc-by commons
3 creativecommons org licenses by ?1|2|3|4 ?0|5

cc-by-sa commons
4 creativecommons org licenses by sa ?1|2|3|4 ?0|5

cc-by-nc commons
4 creativecommons org licenses by nc ?1|2|3|4 ?0|5

cc-by-nc-sa commons
4 creativecommons org licenses by nc sa ?1|2|3|4 ?0|5

cc-by-nc-nd commons
4 creativecommons org licenses by nc nd ?1|2|3|4 ?0|5

cc0-1.0 commons
4 creativecommons org publicdomain zero 1 0

public-domain domain
4 released into the public domain
4 dedicated to the public domain
4 placed in the public domain
3 is in the public domain
2 public domain software|dedication|work
1 public domain

unlicense unlicen
4 this is free and unencumbered software released into the public domain *40 unlicense
4 spdx licen[cs]e identifier unlicense
2 the unlicense
2 unlicense org

unlicense unencumbered
4 this is free and unencumbered software released into the public domain

wtfpl wtfpl
4 licen[cs]ed under the wtfpl
2 wtfpl

zlib zlib
4 spdx licen[cs]e identifier zlib
4 licen[cs]ed under the zlib licen[cs]e
2 zlib licen[cs]e
2 zlib libpng licen[cs]e

zlib warranty
4 this software is provided as is without any express or implied warranty in no event will the authors be held liable

bsl-1.0 boost
4 distributed under the boost software licen[cs]e ?version ?1 ?0
3 boost software licen[cs]e ?version v?1 ?0
2 boost ?software licen[cs]e

artistic-2.0 artistic
3 artistic licen[cs]e ?version v?2 ?0
4 spdx licen[cs]e identifier artistic 2 0

artistic-1.0 artistic
3 artistic licen[cs]e ?version v?1 0
3 same terms as perl *4 artistic licen[cs]e

artistic artistic
2 artistic licen[cs]e

perl perl
4 under the same terms as perl itself
3 same terms as perl

python-2.0 python
3 python software foundation licen[cs]e ?version ?2 ?0
2 python licen[cs]e
2 python ?software ?foundation licen[cs]e agreement

php-3.01 php
3 php licen[cs]e ?version v?3 ?0|01
2 php licen[cs]e

ruby ruby
3 same terms as ruby
2 ruby licen[cs]e

openssl openssl
3 openssl licen[cs]e
2 openssl and ssleay licen[cs]e

postgresql postgresql
2 postgresql licen[cs]e

ncsa ncsa
4 university of illinois ncsa open source licen[cs]e
2 ncsa ?open ?source licen[cs]e

ofl-1.1 font
4 licen[cs]ed under the sil open font licen[cs]e ?version ?1 ?1
3 sil open font licen[cs]e ?version v?1 1
2 ?sil open font licen[cs]e

odbl-1.0 database
4 made available under the open database licen[cs]e
2 open ?data database licen[cs]e

pddl-1.0 dedication
2 public domain dedication and licen[cs]e

ms-pl microsoft
3 microsoft public licen[cs]e
3 microsoft reciprocal licen[cs]e

apsl-2.0 apple
3 apple public source licen[cs]e ?version ?2 ?0

nasa-1.3 nasa
3 nasa open source agreement

afl-3.0 academic
3 academic free licen[cs]e ?version v?3 ?0
2 academic free licen[cs]e

osl-3.0 open
3 open software licen[cs]e ?version v?3 ?0
2 open software licen[cs]e

ecl-2.0 educational
3 educational community licen[cs]e ?version v?2 ?0
2 educational community licen[cs]e

upl-1.0 universal
3 universal permissive licen[cs]e ?version v?1 ?0

w3c w3c
3 w3c software ?notice ?and ?document licen[cs]e

x11 x11
2 x11 licen[cs]e

vim vim
2 vim licen[cs]e

curl curl
2 curl licen[cs]e

bsl-1.1 business
4 licen[cs]ed under the business source licen[cs]e ?version ?1 ?1
3 business source licen[cs]e ?version ?1 ?1

elastic-2.0 elastic
4 licen[cs]ed under the elastic licen[cs]e
3 elastic licen[cs]e ?version v?2 ?0

sspl-1.0 server
4 licen[cs]ed under the server side public licen[cs]e
3 server side public licen[cs]e ?version v?1 ?0

sspl-1.0 sspl
2 sspl

commons-clause commons
3 commons clause licen[cs]e condition
2 commons clause

openrail rail
3 responsible ai licen[cs]es? openrail *2
2 open rail ?m licen[cs]e
2 openrail ?m

llama-community llama
4 llama 2|3 community licen[cs]e ?agreement
3 llama *2 community licen[cs]e

proprietary reserved
4 copyright *8 all rights reserved
3 all rights reserved
2 rights reserved

proprietary confidential
4 proprietary and confidential
4 confidential and proprietary
3 unauthori[sz]ed copying of this file *8 confidential

proprietary eula
2 end user licen[cs]e agreement eula
1 eula

proprietary user
3 end user licen[cs]e agreement

commercial commercial
3 commercial licen[cs]e
3 non commercial use only
3 for noncommercial use only

source-available licen
1 open source licen[cs]e
1 free software licen[cs]e
1 dual licen[cs]ed
1 see ?the licen[cs]e ?file|txt|md ?for ?details
1 licen[cs]ed under *4
1 licen[cs]e agreement
1 spdx licen[cs]e identifier *3
"""

#: How words for a licence begin.
STEM = "licen"
#: How sure a signature of each priority is.
CONFIDENCE = {1: 0.25, 2: 0.6, 3: 0.85, 4: 1.0}


def compiled(words: str) -> str:
    """A regular expression over numbered words, ` 0:this  1:licence `, of what Java and RE2 read alike."""
    out = []
    for w in words.split():
        if w[0] == "*":
            out.append(f"(?: [0-9]+:[^ ]+ ){{0,{int(w[1:])}}}")
        elif w[0] == "?":
            out.append(f"(?: [0-9]+:(?:{w[1:]}) )?")
        else:
            out.append(f" [0-9]+:(?:{w}) ")
    return "".join(out)


def rules(text: str = SIGNATURES) -> list[tuple[int, str, int, str, str, list[str]]]:
    """(rank, label, priority, keyword, expression, needs) of each signature; each holds its keyword in words that must be there."""
    out = []
    for paragraph in text.strip().split("\n\n"):
        head, *lines = paragraph.splitlines()
        label, keyword = head.split()
        for line in lines:
            priority, words = line.split(" ", 1)
            if not any(all(keyword in x for x in w.split("|")) for w in words.split() if w[0] not in "*?"):
                raise ValueError(f"{words!r} does not need {keyword!r}")
            re.compile(compiled(words))
            out.append((len(out), label, int(priority), keyword, compiled(words), needs(words)))
    return out


def roots(of: list[tuple]) -> list[str]:
    """Strings of which a text holds one if any of the rules can match it."""
    return sorted({STEM if STEM in r[5] else max([r[3], *r[5]], key=len) for r in of})


def needs(words: str) -> list[str]:
    """The plain words that a signature cannot do without; STEM stands for one that begins with it."""
    must = [w for w in words.split() if w[0] not in "*?" and "|" not in w]
    return sorted({STEM if w.startswith(STEM) else w for w in must if w.startswith(STEM) or w.isalnum()})
