"""Signature rules of license texts, written by hand, in the order in which they count.

A rule is a regular expression over a text's words: lower case, one space apart, without punctuation.
Exactly one of its words has an ``@`` before it: its keyword, at whose places alone it is tried.
A head line ``[label level needs]`` gives the label of the rules below it, their level (3: a license
with its version, or a sentence of its text; 2: a license by name; 1: a mention of some license) and a word that must be near the keyword
(``-``: none). ``<L>`` is the keyword license or licence, ``<v>`` a space and the word version, if any, ``<+>`` what says that later versions do.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Keywords by kind; a rule's kind is that of its keyword.
KEYWORDS = {
    "licence": "license licence licenses licences licensed licenced licensing sublicense",
    "gpl": "gpl lgpl agpl gplv1 gplv2 gplv3 lgplv2 lgplv3 agplv1 agplv3 gpl1 gpl2 gpl3 lgpl2 lgpl3 agpl3 gfdl",
    "spdx": "spdx",
    "cc": "cc cc0 commons creativecommons",
    "domain": "domain unlicense wtfpl copyleft",
    "grant": "permission redistribution redistributions",
}
SHORT = {
    "<L>": "@licen[cs]es?", "<v>": "(?: version| ver| v)? v?", "<+>": "(?: only)?(?: or)?(?: at your option)?(?: any)? (?:later|newer|higher)(?: versions?)?",
}

TEXT = """
[mit 3 hereby]
@permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
[mit 3 opensource]
opensource org @licenses? mit(?: license)?
[mit 3 mit]
released under the (?:terms of the )?mit <L>
[mit 2 mit]
mit(?: x11| expat| style)? <L>
@licensed under (?:the )?mit
@licensed under (?:the )?terms of the mit
<L> mit
[mit-0 3 mit]
mit no attribution <L>
mit no attribution(?: [^ ]+){0,3} <L>
mit 0 <L>
[x11 3 x11]
x11 <L>
x consortium <L>
[expat 2 expat]
expat <L>
@licensed under (?:the )?expat
[apache-2.0 3 apache]
apache(?: software)? <L><v>2(?: 0)?
apache org @licenses license 2 0
apache(?: software)?<v>2(?: 0)? <L>
@licensed under (?:the )?apache(?: version)? v?2(?: 0)?
asl 2 0 <L>
@licensed to the apache software foundation
[apache-2.0 3 compliance]
you may not use this file except in compliance with the <L>
[apache-2.0 3 governing]
see the <L> for the specific language governing permissions and limitations under the license
[apache-2.0 3 opensource]
opensource org @licenses? apache 2 0
[apache-1.1 3 apache]
apache(?: software)? <L><v>1 1
apache org @licenses license 1 1
[apache-1.0 3 apache]
apache(?: software)? <L><v>1(?: 0)?
apache org @licenses license 1 0
[apache 2 apache]
apache(?: software)?(?: foundation)? <L>
apache org @licenses
@licensed under (?:the )?apache
[gpl-1.0 3 gnu]
gnu general public <L><v>1(?: 0)?
[gpl-2.0 3 gnu]
gnu general public <L><v>2(?: 0)?
gnu gpl @licen[cs]e<v>2(?: 0)?
gnu org @licenses gpl 2 0(?: html| txt)?
gnu org @licenses old licenses gpl 2 0(?: html| txt)?
gnu general public <L> as published by the free software foundation version 2
gnu general public <L> as published by the free software foundation either version 2
[gpl-2.0-or-later 3 gnu]
gnu general public <L><v>2(?: 0)?<+>
gnu general public <L> as published by the free software foundation either version 2 of the license or at your option any later version
[gpl-2.0-only 3 gnu]
gnu general public <L><v>2(?: 0)? only
gnu general public <L> version 2 as published by the free software foundation
[gpl-3.0 3 gnu]
gnu general public <L><v>3(?: 0)?
gnu gpl @licen[cs]e<v>3(?: 0)?
gnu org @licenses gpl 3 0(?: html| txt)?
gnu general public <L> as published by the free software foundation version 3
gnu general public <L> as published by the free software foundation either version 3
[gpl-3.0-or-later 3 gnu]
gnu general public <L><v>3(?: 0)?<+>
gnu general public <L> as published by the free software foundation either version 3 of the license or at your option any later version
[gpl-3.0-only 3 gnu]
gnu general public <L><v>3(?: 0)? only
[gpl 3 warranty]
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public <L>
[gpl 2 general]
(?:gnu )?general public <L>
[gpl 2 gnu]
gnu gpl <L>
gnu public <L>
gnu org @licenses gpl(?: html)?
gnu org @licenses
[lgpl-2.0 3 library]
(?:gnu )?library general public <L><v>2(?: 0)?
gnu library (?:general public )?<L>
[lgpl-2.1 3 lesser]
(?:gnu )?lesser general public <L><v>2 1
(?:gnu )?lesser general public <L> as published by the free software foundation (?:either )?version 2 1
[lgpl-2.1 3 lgpl]
gnu org @licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
[lgpl-2.1-or-later 3 lesser]
(?:gnu )?lesser general public <L><v>2 1<+>
(?:gnu )?lesser general public <L> as published by the free software foundation either version 2 1 of the license or at your option any later version
[lgpl-3.0 3 lesser]
(?:gnu )?lesser general public <L><v>3(?: 0)?
(?:gnu )?lesser general public <L> as published by the free software foundation (?:either )?version 3
[lgpl-3.0 3 lgpl]
gnu org @licenses lgpl 3 0(?: html| txt)?
[lgpl-3.0-or-later 3 lesser]
(?:gnu )?lesser general public <L><v>3(?: 0)?<+>
[lgpl 2 lesser]
(?:gnu )?lesser (?:general )?public <L>
[lgpl 2 lgpl]
lgpl <L>
gnu org @licenses lgpl(?: html)?
[agpl-1.0 3 affero]
affero general public <L><v>1(?: 0)?
[agpl-3.0 3 affero]
(?:gnu )?affero general public <L><v>3(?: 0)?
(?:gnu )?affero general public <L> as published by the free software foundation (?:either )?version 3
[agpl-3.0 3 agpl]
gnu org @licenses agpl 3 0(?: html| txt)?
[agpl-3.0-or-later 3 affero]
(?:gnu )?affero general public <L><v>3(?: 0)?<+>
[agpl 2 affero]
(?:gnu )?affero (?:general )?public <L>
[agpl 2 agpl]
agpl <L>
gnu org @licenses agpl(?: html)?
[gfdl-1.1 3 documentation]
(?:gnu )?free documentation <L><v>1 1
[gfdl-1.2 3 documentation]
(?:gnu )?free documentation <L><v>1 2
[gfdl-1.3 3 documentation]
(?:gnu )?free documentation <L><v>1 3
[gfdl 2 documentation]
(?:gnu )?free documentation <L>
[gfdl 2 fdl]
gnu org @licenses fdl(?: 1 3)?(?: html)?
[gpl-2.0-classpath 3 classpath]
gnu general public <L>(?: version)?(?: v?2)?(?: only)? with (?:the )?classpath exception
[gpl-1.0 3 -]
@gpl<v>1(?: 0)?
@gplv1
@gpl1
[gpl-2.0 3 -]
(?:gnu )?@gpl<v>2(?: 0)?
(?:gnu )?@gplv2(?: 0)?
@gpl2
[gpl-2.0-or-later 3 -]
(?:gnu )?@gpl<v>2(?: 0)?<+>
(?:gnu )?@gplv2<+>
[gpl-3.0 3 -]
(?:gnu )?@gpl<v>3(?: 0)?
(?:gnu )?@gplv3(?: 0)?
@gpl3
[gpl-3.0-or-later 3 -]
(?:gnu )?@gpl<v>3(?: 0)?<+>
(?:gnu )?@gplv3<+>
[gpl 2 gnu]
gnu @gpl
[gpl 2 -]
@gpl(?: licen[cs]ed?)
(?:under|by) (?:the )?@gpl
[lgpl-2.0 3 -]
@lgpl<v>2(?: 0)?
@lgpl2
[lgpl-2.1 3 -]
(?:gnu )?@lgpl<v>2 1
@lgplv2 1
[lgpl-2.1-or-later 3 -]
(?:gnu )?@lgpl<v>2 1<+>
@lgplv2 1<+>
[lgpl-3.0 3 -]
(?:gnu )?@lgpl<v>3(?: 0)?
@lgplv3(?: 0)?
@lgpl3
[lgpl 2 -]
gnu @lgpl
@lgpl(?: licen[cs]ed?)
(?:under|by) (?:the )?@lgpl
[agpl-3.0 3 -]
(?:gnu )?@agpl<v>3(?: 0)?
@agplv3(?: 0)?
@agpl3
[agpl-1.0 3 -]
@agplv1
[agpl 2 -]
gnu @agpl
@agpl(?: licen[cs]ed?)
(?:under|by) (?:the )?@agpl
[gfdl 2 -]
gnu @gfdl
@gfdl(?: licen[cs]ed?)
(?:under|by) (?:the )?@gfdl
[bsd-4-clause 3 bsd]
(?:4|four) clause bsd <L>
bsd 4 clause <L>
original bsd <L>
[bsd-3-clause 3 bsd]
(?:3|three) clause bsd <L>
bsd 3 clause(?: new(?: or revised)?)? <L>
(?:new|modified|revised) bsd <L>
opensource org @licenses? bsd 3 clause
[bsd-2-clause 3 bsd]
(?:2|two) clause bsd <L>
bsd 2 clause(?: simplified)? <L>
(?:simplified|freebsd) (?:bsd )?<L>
opensource org @licenses? bsd 2 clause
[bsd-1-clause 3 bsd]
(?:1|one) clause bsd <L>
bsd 1 clause <L>
[0bsd 3 bsd]
(?:0|zero) clause bsd <L>
bsd zero clause <L>
[0bsd 3 0bsd]
0bsd <L>
[bsd-3-clause-clear 3 clear]
bsd 3 clause clear <L>
clear bsd <L>
[bsd-source 3 source]
@redistribution and use in source and binary forms with or without modification are permitted
@redistributions of source code must retain the above copyright notice
@redistributions in binary form must reproduce the above copyright notice
[bsd 2 bsd]
bsd(?: style| type| like)? <L>
@licensed under (?:the )?bsd
berkeley software distribution <L>
opensource org @licenses? bsd(?: license)?
[isc 3 fee]
@permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
@permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
[isc 3 isc]
isc <L>
opensource org @licenses? isc
@licensed under (?:the )?isc
[isc 2 consortium]
internet (?:software|systems) consortium <L>
[hpnd 3 documentation]
@permission to use copy modify and distribute this software and its documentation for any purpose
[hpnd 3 historical]
historical permission notice and disclaimer(?: [^ ]+){0,2} <L>
[zlib 3 anyone]
@permission is granted to anyone to use this software for any purpose including commercial applications
[zlib 3 zlib]
zlib(?: libpng)? <L>
opensource org @licenses? zlib
@licensed under (?:the )?zlib
[libpng 3 png]
png reference library <L>
[libpng 3 libpng]
libpng <L>
[mpl-1.0 3 mozilla]
mozilla public <L><v>1 0
[mpl-1.1 3 mozilla]
mozilla public <L><v>1 1
[mpl-2.0 3 mozilla]
mozilla public <L><v>2(?: 0)?
this source code form is subject to the terms of the mozilla public <L> v 2 0
[mpl-2.0 3 mpl]
mpl 2 0 <L>
mozilla org mpl 2 0(?: [^ ]+){0,2} <L>
@licensed under (?:the )?mpl 2 0
[mpl 2 mozilla]
mozilla public <L>
[epl-1.0 3 eclipse]
eclipse public <L><v>1(?: 0)?
[epl-2.0 3 eclipse]
eclipse public <L><v>2(?: 0)?
eclipse org legal epl 2 0(?: [^ ]+){0,2} <L>
[epl 2 eclipse]
eclipse public <L>
[edl-1.0 3 eclipse]
eclipse distribution <L>(?:<v>1(?: 0)?)?
[cddl-1.0 3 cddl]
cddl<v>1(?: 0)? <L>
cddl <L><v>1(?: 0)?
[cddl-1.0 3 distribution]
common development and distribution <L><v>1(?: 0)?
[cddl-1.1 3 distribution]
common development and distribution <L><v>1 1
[cddl 2 distribution]
common development and distribution <L>
[cpl-1.0 3 common]
common public <L>(?:<v>1(?: 0)?)?
[cpal-1.0 3 attribution]
common public attribution <L>(?:<v>1(?: 0)?)?
[cecill-2.1 3 cecill]
cecill(?: free software)? <L>(?: agreement)?<v>2 1
[cecill-b 3 cecill]
cecill b <L>
[cecill-c 3 cecill]
cecill c <L>
[cecill 2 cecill]
cecill(?: free software)? <L>
[eupl-1.1 3 european]
european union public <L><v>1 1
[eupl-1.2 3 european]
european union public <L><v>1 2
[eupl 2 european]
european union public <L>
[eupl 2 eupl]
eupl <L>
[artistic-1.0 3 artistic]
artistic <L><v>1(?: 0)?
[artistic-2.0 3 artistic]
artistic <L><v>2(?: 0)?
[artistic 2 artistic]
(?:perl )?artistic <L>
same terms as perl itself(?: [^ ]+){0,6} <L>
[bsl-1.0 3 boost]
boost software <L>(?: version| v)?(?: 1(?: 0)?)?
boost org license 1 0(?: [^ ]+){0,2} <L>
[bsl-1.0 3 organization]
@permission is hereby granted free of charge to any person or organization obtaining a copy of the software
[busl-1.1 3 business]
business source <L>(?:<v>1(?: 1)?)?
[sspl-1.0 3 server]
server side public <L>(?:<v>1(?: 0)?)?
[elastic-2.0 3 elastic]
elastic <L>(?:<v>2(?: 0)?)?
[commons-clause 3 clause]
commons clause <L>(?: condition)?
@commons clause (?:license )?(?:condition)
[psf-2.0 3 python]
python software foundation <L>(?:<v>2(?: 0)?)?
psf <L> (?:agreement )?for python
[psf 2 python]
python <L>
[php-3.01 3 php]
php <L><v>3 01
[php-3.0 3 php]
php <L><v>3 0
[php 2 php]
php <L>
[ruby 3 ruby]
ruby <L>
[perl 3 perl]
perl <L>
[openssl 3 openssl]
openssl(?: ssleay)? <L>
[openldap 3 openldap]
openldap public <L>(?:<v>2 8)?
[postgresql 3 postgresql]
postgresql <L>
[sleepycat 3 sleepycat]
sleepycat <L>
[curl 3 curl]
curl <L>
[ncsa 3 ncsa]
(?:university of illinois )?ncsa(?: open source)? <L>
[ncsa 3 illinois]
university of illinois(?: [^ ]+){0,3} open source <L>
[w3c 3 w3c]
w3c(?: software)?(?: notice and)? <L>
[unicode 3 unicode]
unicode(?: inc)? <L>(?: agreement)?
[icu 3 icu]
icu <L>
[upl-1.0 3 universal]
universal permissive <L>(?:<v>1(?: 0)?)?
[ms-pl 3 microsoft]
microsoft public <L>
[ms-rl 3 microsoft]
microsoft reciprocal <L>
[ms-eula 3 microsoft]
microsoft software <L> terms
[apsl-2.0 3 apple]
apple public source <L>(?:<v>2(?: 0)?)?
[ipl-1.0 3 ibm]
ibm public <L>(?:<v>1(?: 0)?)?
[lpl-1.02 3 lucent]
lucent public <L>(?:<v>1 02)?
[osl-3.0 3 open]
open software <L>(?:<v>3(?: 0)?)
[osl 2 open]
open software <L>
[afl-3.0 3 academic]
academic free <L>(?:<v>3(?: 0)?)
[afl 2 academic]
academic free <L>
[ecl-2.0 3 educational]
educational community <L>(?:<v>2(?: 0)?)?
[qpl-1.0 3 public]
q public <L>(?:<v>1(?: 0)?)?
[sissl 3 standards]
sun industry standards source <L>
[spl-1.0 3 sun]
sun public <L>(?:<v>1(?: 0)?)?
[netscape 3 netscape]
netscape public <L>(?:<v>1 [01])?
[realnetworks 3 realnetworks]
realnetworks public source <L>
[nasa-1.3 3 nasa]
nasa open source agreement(?: [^ ]+){0,3} <L>
[mulan-psl-2.0 3 mulan]
mulan psl(?:<v>2)? <L>
mulan permissive software <L>(?:<v>2)?
[vim 3 vim]
vim <L>
[tcl 3 tcl]
tcl(?: tk)? <L>
[ofl-1.1 3 font]
(?:sil )?open font <L>(?:<v>1 1)
[ofl 2 font]
(?:sil )?open font <L>
[bitstream-vera 3 bitstream]
bitstream vera(?: font)? <L>
[ijg 3 jpeg]
independent jpeg group(?: [^ ]+){0,2} <L>
[freetype 3 freetype]
freetype(?: project)? <L>
[imagemagick 3 imagemagick]
imagemagick <L>
[json 3 evil]
the software shall be used for good not evil(?: [^ ]+){0,8} <L>
[json 3 json]
json <L>
[beerware 3 beer]
beer ?ware <L>
[beerware 3 beerware]
beerware <L>
[odbl-1.0 3 database]
open (?:data commons open )?database <L>(?:<v>1(?: 0)?)?
[odc-by-1.0 3 data]
open data commons attribution <L>(?:<v>1(?: 0)?)?
odc by <L>
[odc-pddl-1.0 3 dedication]
public domain dedication and <L>
[ogl-3.0 3 government]
open government <L><v>3(?: 0)?
[ogl 2 government]
open government <L>
[cdla-permissive-2.0 3 community]
community data <L>(?: agreement)? permissive(?: version| v)?(?: 2(?: 0)?)?
[cdla-sharing-1.0 3 community]
community data <L>(?: agreement)? sharing(?: version| v)?(?: 1(?: 0)?)?
[openrail 3 rail]
(?:open |bigscience )*rail(?: m)? <L>
[openrail 3 openrail]
(?:creativeml )?openrail(?: m)? <L>
[hippocratic 3 hippocratic]
hippocratic <L>(?:<v>[23](?: [01])?)?
[parity 3 parity]
parity public <L>
[prosperity 3 prosperity]
prosperity public <L>
[polyform 3 polyform]
polyform (?:noncommercial|small business|strict|shield|internal use|free trial|perimeter) <L>
[oracle-otn 3 oracle]
oracle technology network <L>(?: agreement)?
[oracle-bcl 3 oracle]
oracle binary code <L>(?: agreement)?
[nvidia-eula 3 nvidia]
nvidia software <L> agreement
[intel 3 intel]
intel (?:simplified |open source |sample source code )?(?:software )?<L>
[unlicense 3 unencumbered]
this is free and unencumbered software released into the public @domain
[unlicense 3 -]
(?:the )?@unlicense
unlicense org(?: [^ ]+){0,3} public @domain
[wtfpl 3 -]
@wtfpl
[wtfpl 3 fuck]
do what the fuck you want to public <L>
[public-domain 2 -]
(?:in|into|to|is|are) the public @domain
dedicated (?:[^ ]+ ){0,6}public @domain
public @domain (?:dedication|software|work|mark|notice)
[copyleft 1 -]
@copyleft (?:licen[cs]e|licen[cs]ed|notice|all (?:rights|wrongs) reversed)
[cc0-1.0 3 -]
(?:cc )?@cc0(?: 1(?: 0)?)?(?: universal)?
@cc zero(?: 1(?: 0)?)?
@creativecommons org publicdomain zero 1 0
[cc0-1.0 3 creative]
creative @commons zero(?: v?1(?: 0)?)?(?: universal)?
creative @commons cc0(?: 1(?: 0)?)?(?: universal)?
[cc-pdm-1.0 3 -]
@creativecommons org publicdomain mark 1 0
[cc-by-1.0 3 -]
@cc by 1 0
[cc-by-2.0 3 -]
@cc by 2 0
@creativecommons org licenses by 2 0
[cc-by-2.5 3 -]
@cc by 2 5
@creativecommons org licenses by 2 5
[cc-by-3.0 3 -]
@cc by 3 0
@creativecommons org licenses by 3 0
[cc-by-4.0 3 -]
@cc by 4(?: 0)?
@creativecommons org licenses by 4 0
[cc-by-4.0 3 creative]
creative @commons attribution (?:international )?4 0(?: international)?
creative @commons by 4 0
[cc-by-3.0 3 creative]
creative @commons attribution 3 0(?: unported)?
[cc-by-sa-2.0 3 -]
@cc by sa 2 0
@creativecommons org licenses by sa 2 0
[cc-by-sa-2.5 3 -]
@cc by sa 2 5
@creativecommons org licenses by sa 2 5
[cc-by-sa-3.0 3 -]
@cc by sa 3 0
@creativecommons org licenses by sa 3 0
[cc-by-sa-3.0 3 creative]
creative @commons attribution share ?alike 3 0(?: unported)?
[cc-by-sa-4.0 3 -]
@cc by sa 4(?: 0)?
@creativecommons org licenses by sa 4 0
[cc-by-sa-4.0 3 creative]
creative @commons attribution share ?alike 4 0(?: international)?
[cc-by-sa 2 -]
@cc by sa
@creativecommons org licenses by sa
[cc-by-sa 2 creative]
creative @commons attribution share ?alike
[cc-by-nc-2.0 3 -]
@cc by nc 2 0
[cc-by-nc-3.0 3 -]
@cc by nc 3 0
@creativecommons org licenses by nc 3 0
[cc-by-nc-4.0 3 -]
@cc by nc 4(?: 0)?
@creativecommons org licenses by nc 4 0
[cc-by-nc-4.0 3 creative]
creative @commons attribution non ?commercial 4 0(?: international)?
[cc-by-nc 2 -]
@cc by nc
@creativecommons org licenses by nc
[cc-by-nc 2 creative]
creative @commons attribution non ?commercial
[cc-by-nc-sa-3.0 3 -]
@cc by nc sa 3 0
@creativecommons org licenses by nc sa 3 0
[cc-by-nc-sa-4.0 3 -]
@cc by nc sa 4(?: 0)?
@creativecommons org licenses by nc sa 4 0
[cc-by-nc-sa-4.0 3 creative]
creative @commons attribution non ?commercial share ?alike 4 0(?: international)?
[cc-by-nc-sa 2 -]
@cc by nc sa
@creativecommons org licenses by nc sa
[cc-by-nc-sa 2 creative]
creative @commons attribution non ?commercial share ?alike
[cc-by-nd-3.0 3 -]
@cc by nd 3 0
@creativecommons org licenses by nd 3 0
[cc-by-nd-4.0 3 -]
@cc by nd 4(?: 0)?
@creativecommons org licenses by nd 4 0
[cc-by-nd-4.0 3 creative]
creative @commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
[cc-by-nd 2 -]
@cc by nd
@creativecommons org licenses by nd
[cc-by-nd 2 creative]
creative @commons attribution no ?deriv(?:ative)?s
[cc-by-nc-nd-3.0 3 -]
@cc by nc nd 3 0
@creativecommons org licenses by nc nd 3 0
[cc-by-nc-nd-4.0 3 -]
@cc by nc nd 4(?: 0)?
@creativecommons org licenses by nc nd 4 0
[cc-by-nc-nd-4.0 3 creative]
creative @commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
[cc-by-nc-nd 2 -]
@cc by nc nd
@creativecommons org licenses by nc nd
[cc-by-nc-nd 2 creative]
creative @commons attribution non ?commercial no ?deriv(?:ative)?s
[cc-by 2 -]
@cc by
@creativecommons org licenses by
[cc-by 2 creative]
creative @commons attribution
[cc 1 creative]
creative @commons (?:public )?licen[cs]e
creative @commons
@licensed under (?:a |the )?creative commons
[proprietary 2 proprietary]
proprietary (?:and confidential )?(?:software )?<L>
[commercial 2 commercial]
commercial (?:software )?<L>(?: agreement)?
[eula 2 user]
end user <L> agreement
[dual 1 dual]
dual @licen[cs]ed
dual @licen[cs]e
[dual 1 under]
@licen[cs]ed under (?:either|both) (?:the )?(?:[^ ]+ ){0,8}(?:or|and) (?:the )?(?:[^ ]+ ){0,4}licen[cs]e
[unstated 1 under]
@licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:[^ ]+ ){1,6}licen[cs]e
@licen[cs]ed under the same terms as
[unstated 1 permissive]
permissive(?: open source| free software)? <L>
[unstated 1 open]
open source <L>
free and open source <L>
[unstated 1 file]
see (?:the )?<L> file
@licen[cs]e (?:file|text) for (?:the )?(?:full )?(?:details|terms|text|license)
"""


class Rule(NamedTuple):
    number: int
    kind: str
    level: int
    label: str
    needs: str
    pattern: str


def _made() -> list[Rule]:
    kinds = {word: kind for kind, words in KEYWORDS.items() for word in words.split()}
    found: list[tuple[str, int, str, str, str]] = []
    head = ("", 0, "")
    for line in TEXT.strip().splitlines():
        if m := re.fullmatch(r"\[(\S+) (\d) (\S+)\]", line):
            head = (m[1], int(m[2]), "" if m[3] == "-" else m[3])
            continue
        for short, full in SHORT.items():
            line = line.replace(short, full)
        anchor = re.search(r"@([a-z0-9]+(?:\[cs\][a-z]*)?)", line)[1].replace("[cs]", "c")
        kind = kinds[anchor]
        found.append((kind, head[1], head[0], head[2], line))
    # A tag names a license by its label, word for word; the text's own rules come first.
    tags = dict.fromkeys(x[2] for x in found if x[1] > 1)
    found += [("spdx", 3, label, "identifier", "@spdx license identifier " + re.sub("[-.]", " ", label)) for label in tags]
    return [Rule(i, *x) for i, x in enumerate(found)]


RULES = _made()
