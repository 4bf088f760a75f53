"""Signatures of licenses, by hand: one expression a line over lower-cased words, which single spaces part.

The digit before an expression is its level: 1 a notice or a clause of the license's own text, 2 a name, a tag or an
address, 3 a loose mention. Levels suppress those behind them where detections overlap. Groups are the only place for
alternatives and optional words; words outside of groups are mandatory, and the longest of them gate the rule.
"""

SIGNATURES = """
mit
 1 permission is hereby granted free of charge to any person obtaining a copy of this software
 1 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
 1 the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
 1 (released|licensed|distributed|available|published) under the (terms of the )?mit (license|licence)
 2 the mit (license|licence)
 2 mit (license|licence)
 2 mit expat (license|licence)
 2 (license|licence) mit
 2 opensource org licenses mit
 3 mit style license
mit-0
 1 mit no attribution
 2 mit 0
isc
 1 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
 2 isc (license|licence)
 2 opensource org licenses isc
 3 isc style license
0bsd
 2 bsd zero clause (license|licence)
 2 zero clause bsd
 2 0bsd
bsd-2-clause
 1 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
 2 bsd 2 clause
 2 2 clause bsd
 2 (simplified|freebsd) bsd (license|licence)
 2 freebsd (license|licence)
 2 opensource org licenses bsd 2 clause
bsd-3-clause
 1 neither the name of( the)? [^ ]+( [^ ]+)? nor the names of its contributors may be used to endorse or promote products
 1 neither the name of the copyright holder nor the names of its contributors
 2 bsd 3 clause
 2 3 clause bsd
 2 (new|modified|revised) bsd (license|licence)
 2 opensource org licenses bsd 3 clause
bsd-3-clause-clear
 1 no express or implied licenses to any party s patent rights are granted by this license
 2 clear bsd (license|licence)
 2 bsd 3 clause clear
bsd-4-clause
 1 all advertising materials mentioning features or use of this software must display the following acknowledgement
 2 bsd 4 clause
 2 4 clause bsd
 2 original bsd (license|licence)
bsd
 1 redistribution and use in source and binary forms with or without modification are permitted
 2 bsd (license|licence)
 3 bsd style license
apache-1.1
 1 this product includes software developed by the apache software foundation
 2 apache software license version 1 1
 2 apache license version 1 1
 2 apache 1 1
apache-2
 1 licensed under the apache license version 2( 0)?
 1 you may not use this file except in compliance with the license
 1 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
 2 apache license( version| v)? 2( 0)?
 2 apache software license( version)? 2( 0)?
 2 apache org licenses license 2 0
 2 apache 2( 0)? license
 2 apache 2 0
 2 asl 2 0
 3 apache (license|licence)
gpl-1
 2 gnu general public license version 1( 0)?
 2 gpl (v |version )?1( 0)?( only| or later)?
gpl-2
 1 under the terms of the gnu general public license as published by the free software foundation either version 2 of the license
 2 gnu general public (license|licence) (version |v )?2( 0)?
 2 gnu general public (license|licence) v2( 0)?
 2 gnu gpl (version )?v?2( 0)?
 2 gpl (v |version )?2( 0)?( only| or later)?
 2 gplv2
 2 gnu org licenses old licenses gpl 2 0
gpl-3
 1 under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
 2 gnu general public (license|licence) (version |v )?3( 0)?
 2 gnu general public (license|licence) v3( 0)?
 2 gnu gpl (version )?v?3( 0)?
 2 gpl (v |version )?3( 0)?( only| or later)?
 2 gplv3
 2 gnu org licenses gpl 3 0
gpl
 1 you should have received a copy of the gnu general public license along with this program
 1 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
 2 gnu general public (license|licence)
 2 gnu org licenses gpl
 3 gnu gpl
 3 gpl (license|licence|licensed)
lgpl-2
 2 gnu library general public (license|licence)
 2 lgpl (v |version )?2 0
 2 lgplv2( 0)?
lgpl-2.1
 1 under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
 2 gnu lesser general public (license|licence) (version |v )?v?2 1
 2 lgpl (v |version )?2 1( only| or later)?
 2 lgplv2 1
 2 gnu org licenses old licenses lgpl 2 1
lgpl-3
 1 under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
 2 gnu lesser general public (license|licence) (version |v )?v?3( 0)?
 2 lgpl (v |version )?3( 0)?( only| or later)?
 2 lgplv3
lgpl
 1 you should have received a copy of the gnu lesser general public license
 2 gnu lesser general public (license|licence)
 3 lgpl (license|licence|licensed)
agpl-3
 1 under the terms of the gnu affero general public license as published by the free software foundation
 1 notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users
 2 gnu affero general public (license|licence)( version 3| v3)?( 0)?
 2 affero general public (license|licence)
 2 agpl (v |version )?3( 0)?( only| or later)?
 2 agplv3
 2 gnu org licenses agpl 3 0
 3 agpl (license|licence|licensed)
gfdl
 1 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
 2 gnu free documentation (license|licence)
 2 gfdl 1 [0-9]
 2 gnu org (copyleft|licenses) fdl
mpl-1.1
 1 the contents of this file are subject to the mozilla public license version 1 1
 2 mozilla public (license|licence) (version )?1 1
 2 mpl 1 1
mpl-2
 1 this source code form is subject to the terms of the mozilla public license
 2 mozilla public (license|licence) (version |v )?2( 0)?
 2 mozilla org mpl 2 0
 2 mpl 2 0
mpl
 2 mozilla public (license|licence)
 3 mpl licensed
epl-1
 1 this program and the accompanying materials are made available under the terms of the eclipse public license v1( 0)?
 2 eclipse public (license|licence) (version |v )?v?1( 0)?
 2 epl 1 0
epl-2
 1 this program and the accompanying materials are made available under the terms of the eclipse public license 2( 0)?
 2 eclipse public (license|licence) (version |v )?v?2( 0)?
 2 eclipse org legal epl 2 0
 2 epl 2 0
epl
 2 eclipse public (license|licence)
cddl
 1 the contents of this file are subject to the terms of the common development and distribution license
 2 common development and distribution (license|licence)( version)?( 1)?( 0| 1)?
 2 cddl 1 [01]
cpl-1
 2 common public (license|licence)( version)?( 1 0)?
cpal-1
 2 common public attribution (license|licence)
 2 cpal 1 0
eupl
 1 licensed under the eupl
 2 european union public (license|licence)( version| v)?( 1)?( 1| 2)?
 2 eupl 1 [012]
osl-3
 1 licensed under the open software license version 3( 0)?
 2 open software (license|licence)( version| v)? 3( 0)?
 2 osl 3 0
afl-3
 1 licensed under the academic free license version 3( 0)?
 2 academic free (license|licence)( version| v)? (2 1|3 0)
 2 afl 3 0
artistic-1
 2 (the )?artistic (license|licence) 1( 0)?
artistic-2
 1 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
 2 (the )?artistic (license|licence) 2( 0)?
 2 perlfoundation org artistic license 2 0
artistic
 2 (the )?artistic (license|licence)
 3 under the same terms as perl itself
zlib
 1 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software
 2 zlib libpng (license|licence)
 2 zlib (license|licence)
boost-1
 1 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
 1 distributed under the boost software license( version 1)?( 0)?
 2 boost software (license|licence)( version)?( 1 0)?
 2 boost org license 1 0
 2 bsl 1 0
unlicense
 1 this is free and unencumbered software released into the public domain
 2 the unlicense
 2 unlicense org
wtfpl
 1 you just do what the f[^ ]* you want to
 2 do what the f[^ ]* you want to public (license|licence)
 2 wtfpl
beerware
 1 if we meet some day and you think this stuff is worth it you can buy me a beer
 2 beerware (license|licence)
 2 beer ware
postgresql
 1 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
 2 postgresql (license|licence)
python-2
 1 python software foundation license version 2
 2 psf (license|licence)( agreement)?
 2 python software foundation (license|licence)
 3 python license
ruby
 2 ruby s (license|licence)
 2 ruby (license|licence)
php-3
 1 this product includes php software freely available from
 2 php (license|licence)( version| v)?( 3)?( 0 1| 01| 0)?
openssl
 1 this product includes software developed by the openssl project
 2 openssl (license|licence)
x11
 1 except as contained in this notice the name of the x consortium shall not be used in advertising
 2 x11 (license|licence)
ncsa
 2 university of illinois ncsa open source (license|licence)
 2 ncsa open source (license|licence)
curl
 2 curl (license|licence)
icu
 2 icu (license|licence)
 2 unicode (license|licence)
vim
 1 vim is charityware
 2 vim (license|licence)
sissl
 2 sun industry standards source (license|licence)
ofl-1.1
 1 this font software is licensed under the sil open font license( version)?( 1)?( 1)?
 2 sil open font (license|licence)
 2 scripts sil org ofl
 2 ofl 1 1
lppl
 1 this work may be distributed and or modified under the conditions of the latex project public license
 2 latex project public (license|licence)
 2 lppl 1 [0-9]
ms-pl
 2 microsoft public (license|licence)
 2 ms pl
ms-rl
 2 microsoft reciprocal (license|licence)
 2 ms rl
json
 1 the software shall be used for good not evil
 2 json (license|licence)
sspl-1
 1 making the functionality of the program or modified version available to third parties as a service
 2 server side public (license|licence)
 2 sspl( v?1)?
busl-1.1
 1 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
 2 business source (license|licence)( version)?( 1 1)?
 2 busl 1 1
elastic-2
 1 you may not provide the software to third parties as a hosted or managed service
 2 elastic (license|licence)( version)?( 2 0| 2)?
commons-clause
 1 the grant of rights under the license will not include and the license does not grant to you the right to sell the software
 2 commons clause
polyform
 2 polyform (noncommercial|shield|strict|small business|perimeter) (license|licence)
cc0-1
 1 the person who associated a work with this deed has dedicated the work to the public domain
 1 to the extent possible under law [^ ]+( [^ ]+)? has waived all copyright
 2 cc0( 1 0)?
 2 creative commons zero
 2 creativecommons org publicdomain zero
cc-by-nc-nd
 1 creative commons attribution non ?commercial no ?deriv(ative|ative works|atives|s)
 2 cc by nc nd( [1-4] [05])?
 2 creativecommons org licenses by nc nd
cc-by-nc-sa
 1 creative commons attribution non ?commercial share ?alike
 2 cc by nc sa( [1-4] [05])?
 2 creativecommons org licenses by nc sa
cc-by-nc
 1 creative commons attribution non ?commercial
 2 cc by nc( [1-4] [05])?
 2 creativecommons org licenses by nc
cc-by-nd
 1 creative commons attribution no ?deriv(ative|ative works|atives|s)
 2 cc by nd( [1-4] [05])?
 2 creativecommons org licenses by nd
cc-by-sa
 1 creative commons attribution share ?alike
 2 cc by sa( [1-4] [05])?
 2 creativecommons org licenses by sa
 3 cc by sa licensed
cc-by
 1 (licensed|released|available|published) under (a|the) creative commons attribution
 2 creative commons attribution( [1-4] [05])?( international| generic| unported)?
 2 cc by( [1-4] [05])?
 2 creativecommons org licenses by
cc
 3 creative commons (license|licence)
 3 creative commons
odbl-1
 2 open database (license|licence)
 2 opendatacommons org licenses odbl
 2 odbl( 1 0)?
odc-by-1
 2 open data commons attribution (license|licence)
 2 opendatacommons org licenses by
pddl-1
 2 public domain dedication and (license|licence)
cdla
 2 community data license agreement (permissive|sharing)
 2 cdla (permissive|sharing)
ogl
 2 open government (license|licence)
 2 nationalarchives gov uk doc open government licence
etalab
 2 licence ouverte
dl-de
 2 datenlizenz deutschland
open-rail
 2 (creativeml )?open rail m
 2 bigscience rail (license|licence)
 2 openrail( m)? (license|licence)
 2 openrailm
llama
 2 llama [23]( [0-9])? community (license|licence)( agreement)?
public-domain
 1 (released|dedicated|placed|donated) (in|into|to) the public domain
 2 (is|are) in the public domain
 3 public domain
proprietary
 1 this software is proprietary and confidential
 1 unauthorized copying of this file via any medium is strictly prohibited
 1 all rights reserved unauthorized (copying|reproduction|use|distribution)
 2 proprietary (license|licence)
 2 end user license agreement
 3 proprietary software
no-commercial
 1 (for|only for) non ?commercial use only
 1 may not be used for commercial purposes
 2 free for personal use
 3 commercial use prohibited
no-ai
 1 may not be used (to|for) train(ing)? (of )?(artificial intelligence|machine learning|language models?|ai)
 2 no ai training
"""
