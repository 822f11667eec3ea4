"""Signature rules of licence texts: priority | licence | keyword | pattern, in order.

A blank in a pattern stands for any white space. Patterns ignore case. Every text that the pattern matches holds the
keyword, or one of those that ";" parts, once it is in lower case and its runs of white space are single blanks.
"""

RULES = r"""
100|*SPDX|spdx-license|SPDX-License-Identifier ?: ?\(?(?P<id>[A-Za-z0-9][A-Za-z0-9.+-]*)
100|*SPDX-EXPRESSION|spdx-license|SPDX-License-Identifier ?: ?\(?[A-Za-z0-9.+-]+ (?:AND|OR|WITH) [A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*\)?
95|GPL-3.0-or-later|general public|GNU General Public License as published by the Free Software Foundation[,;]? (?:either )?version 3(?: of the License)?,? or \(?at your option\)? any later version
95|GPL-2.0-or-later|general public|GNU General Public License as published by the Free Software Foundation[,;]? (?:either )?version 2(?: of the License)?,? or \(?at your option\)? any later version
95|GPL-1.0-or-later|general public|GNU General Public License as published by the Free Software Foundation[,;]? (?:either )?version 1(?: of the License)?,? or \(?at your option\)? any later version
95|AGPL-3.0-or-later|affero|GNU Affero General Public License as published by the Free Software Foundation[,;]? (?:either )?version 3(?: of the License)?,? or \(?at your option\)? any later version
95|LGPL-3.0-or-later|lesser|GNU Lesser General Public License as published by the Free Software Foundation[,;]? (?:either )?version 3(?: of the License)?,? or \(?at your option\)? any later version
95|LGPL-2.1-or-later|lesser|GNU Lesser General Public License as published by the Free Software Foundation[,;]? (?:either )?version 2\.1(?: of the License)?,? or \(?at your option\)? any later version
95|LGPL-2.0-or-later|library general|GNU Library General Public License as published by the Free Software Foundation[,;]? (?:either )?version 2(?: of the License)?,? or \(?at your option\)? any later version
92|GPL-3.0-only|general public|GNU General Public License version 3 only
92|GPL-2.0-only|general public|GNU General Public License version 2 only
92|GPL-2.0-only|general public|GNU General Public License,? version 2,? as published by the Free Software Foundation
92|GPL-3.0-only|general public|GNU General Public License,? version 3,? as published by the Free Software Foundation
92|LGPL-2.1-only|lesser|GNU Lesser General Public License,? version 2\.1,? as published by the Free Software Foundation
90|MIT|permission is hereby|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
90|MIT-0|permission is hereby|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "?Software"?\), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so\.
90|ISC|permission to use, copy|Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that
90|0BSD|permission to use, copy|Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.
90|HPND|permission to use, copy|Permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
90|BSD-3-Clause|redistribution|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met[\s\S]{0,1500}?Neither the name of
90|BSD-4-Clause|redistribution|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met[\s\S]{0,1200}?All advertising materials mentioning
88|BSD-2-Clause|redistribution|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
88|Zlib|as-is|This software is provided 'as-is', without any express or implied warranty\. In no event will the authors be held liable
88|BSL-1.0|boost|Boost Software License ?- ?Version 1\.0 ?- ?August 17th,? 2003
88|Unlicense|public domain|This is free and unencumbered software released into the public domain
88|WTFPL|want to|DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
88|Beerware|beer|"?THE BEER-?WARE LICENSE"? \(Revision 42\)
88|Apache-2.0|apache license|Licensed under the Apache License, Version 2\.0(?: \(the "?License"?\))?(?:; you may not use this file except in compliance with the License)?
88|Apache-1.1|apache|The end-user documentation included with the redistribution, if any, must include[\s\S]{0,120}?Apache Software Foundation
88|MPL-2.0|mozilla public|This Source Code Form is subject to the terms of the Mozilla Public License, v\. ?2\.0
88|MPL-1.1|mozilla public|The contents of this file are subject to the Mozilla Public License Version 1\.1
88|MPL-1.0|mozilla public|The contents of this file are subject to the Mozilla Public License Version 1\.0
88|NPL-1.1|netscape public|The contents of this file are subject to the Netscape Public License Version 1\.1
88|EPL-2.0|eclipse public|made available under the terms of the Eclipse Public License (?:v ?|version )?2\.0
88|EPL-1.0|eclipse public|made available under the terms of the Eclipse Public License (?:v ?|version )?1\.0
88|CDDL-1.0|common development|The contents of this file are subject to the terms of the Common Development and Distribution License(?:, version 1\.0)?
88|CDDL-1.1|common development|Common Development and Distribution License \(?"?CDDL"?\)? version 1\.1
88|CPL-1.0|common public|made available under the terms of the Common Public License(?: v(?:ersion)? ?1\.0)?
88|Artistic-2.0|perl foundation|Copyright \(c\) 2000-2006, The Perl Foundation
88|Python-2.0|python software|PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2
88|PHP-3.01|php license|This source file is subject to version 3\.01 of the PHP license
88|PHP-3.0|php license|This source file is subject to version 3\.0 of the PHP license
88|OpenSSL|openssl|This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit
88|ICU|unicode|COPYRIGHT AND PERMISSION NOTICE Copyright \(c\) [\d-]+ Unicode, Inc
88|Unicode-DFS-2016|unicode|Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files
88|OFL-1.1|open font|This Font Software is licensed under the SIL Open Font License, Version 1\.1
88|OFL-1.0|open font|This Font Software is licensed under the SIL Open Font License, Version 1\.0
88|NCSA|illinois|University of Illinois/NCSA Open Source License
88|PostgreSQL|postgresql|PostgreSQL is released under the PostgreSQL License
88|CECILL-2.1|cecill|governed by the CeCILL license version 2\.1
88|CECILL-2.0|cecill|governed by the CeCILL license under French law
88|CECILL-B|cecill|governed by the CeCILL-B license
88|CECILL-C|cecill|governed by the CeCILL-C license
88|EUPL-1.2|european union public;the eupl|Licensed under the EUPL,? Version 1\.2|European Union Public Licen[cs]e,? (?:v\.? ?|version )1\.2
88|EUPL-1.1|european union public|European Union Public Licen[cs]e,? (?:v\.? ?|version )1\.1
85|CC0-1.0|cc0|(?:waived all copyright|has dedicated the work to the public domain)[\s\S]{0,80}?CC0
85|CC-BY-SA-4.0|attribution|Creative Commons Attribution[- ]Share ?Alike 4\.0(?: International)?(?: Public)?(?: License)?
85|CC-BY-SA-3.0|attribution|Creative Commons Attribution[- ]Share ?Alike 3\.0(?: Unported| United States)?(?: License)?
85|CC-BY-SA-2.5|attribution|Creative Commons Attribution[- ]Share ?Alike 2\.5(?: Generic)?(?: License)?
85|CC-BY-SA-2.0|attribution|Creative Commons Attribution[- ]Share ?Alike 2\.0(?: Generic)?(?: License)?
85|CC-BY-NC-4.0|attribution|Creative Commons Attribution[- ]Non-?Commercial 4\.0(?: International)?(?: Public)?(?: License)?
85|CC-BY-NC-3.0|attribution|Creative Commons Attribution[- ]Non-?Commercial 3\.0(?: Unported| United States)?(?: License)?
85|CC-BY-NC-2.0|attribution|Creative Commons Attribution[- ]Non-?Commercial 2\.0(?: Generic)?(?: License)?
85|CC-BY-ND-4.0|attribution|Creative Commons Attribution[- ]No ?Deriv(?:ative)?s? 4\.0(?: International)?(?: License)?
85|CC-BY-ND-3.0|attribution|Creative Commons Attribution[- ]No ?Deriv(?:ative)?s? 3\.0(?: Unported)?(?: License)?
85|CC-BY-NC-SA-4.0|attribution|Creative Commons Attribution[- ]Non-?Commercial[- ]Share ?Alike 4\.0(?: International)?(?: Public)?(?: License)?
85|CC-BY-NC-SA-3.0|attribution|Creative Commons Attribution[- ]Non-?Commercial[- ]Share ?Alike 3\.0(?: Unported| United States)?(?: License)?
85|CC-BY-NC-SA-2.5|attribution|Creative Commons Attribution[- ]Non-?Commercial[- ]Share ?Alike 2\.5(?: Generic)?(?: License)?
85|CC-BY-NC-ND-4.0|attribution|Creative Commons Attribution[- ]Non-?Commercial[- ]No ?Deriv(?:ative)?s? 4\.0(?: International)?(?: License)?
85|CC-BY-NC-ND-3.0|attribution|Creative Commons Attribution[- ]Non-?Commercial[- ]No ?Deriv(?:ative)?s? 3\.0(?: Unported)?(?: License)?
84|CC-BY-4.0|attribution|Creative Commons Attribution 4\.0(?: International)?(?: Public)?(?: License)?
84|CC-BY-3.0|attribution|Creative Commons Attribution 3\.0(?: Unported| United States)?(?: License)?
84|CC-BY-2.5|attribution|Creative Commons Attribution 2\.5(?: Generic)?(?: License)?
84|CC-BY-2.0|attribution|Creative Commons Attribution 2\.0(?: Generic)?(?: License)?
84|CC-BY-1.0|attribution|Creative Commons Attribution 1\.0(?: Generic)?(?: License)?
84|CC-BY-4.0|cc by;cc-by|\bCC[ -]BY[ -]4\.0\b
84|CC-BY-3.0|cc by;cc-by|\bCC[ -]BY[ -]3\.0\b
84|CC-BY-SA-4.0|cc by;cc-by|\bCC[ -]BY[ -]SA[ -]4\.0\b
84|CC-BY-SA-3.0|cc by;cc-by|\bCC[ -]BY[ -]SA[ -]3\.0\b
84|CC-BY-NC-4.0|cc by;cc-by|\bCC[ -]BY[ -]NC[ -]4\.0\b
84|CC-BY-NC-SA-4.0|cc by;cc-by|\bCC[ -]BY[ -]NC[ -]SA[ -]4\.0\b
84|CC-BY-NC-ND-4.0|cc by;cc-by|\bCC[ -]BY[ -]NC[ -]ND[ -]4\.0\b
84|CC-BY-4.0|cc-by|\bCC-BY-4\.0\b
84|CC-BY-SA-4.0|cc-by|\bCC-BY-SA-4\.0\b
84|CC-BY-SA-3.0|cc-by|\bCC-BY-SA-3\.0\b
84|CC-BY-NC-4.0|cc-by|\bCC-BY-NC-4\.0\b
84|CC-BY-NC-SA-4.0|cc-by|\bCC-BY-NC-SA-4\.0\b
84|CC-BY-NC-ND-4.0|cc-by|\bCC-BY-NC-ND-4\.0\b
84|CC0-1.0|cc0|\bCC0[- ]1\.0(?: Universal)?(?: Public Domain Dedication)?
82|CC-BY-4.0|creativecommons.org|https?://creativecommons\.org/licenses/by/4\.0/?
82|CC-BY-3.0|creativecommons.org|https?://creativecommons\.org/licenses/by/3\.0/?
82|CC-BY-2.5|creativecommons.org|https?://creativecommons\.org/licenses/by/2\.5/?
82|CC-BY-2.0|creativecommons.org|https?://creativecommons\.org/licenses/by/2\.0/?
82|CC-BY-SA-4.0|creativecommons.org|https?://creativecommons\.org/licenses/by-sa/4\.0/?
82|CC-BY-SA-3.0|creativecommons.org|https?://creativecommons\.org/licenses/by-sa/3\.0/?
82|CC-BY-SA-2.0|creativecommons.org|https?://creativecommons\.org/licenses/by-sa/2\.0/?
82|CC-BY-NC-4.0|creativecommons.org|https?://creativecommons\.org/licenses/by-nc/4\.0/?
82|CC-BY-NC-3.0|creativecommons.org|https?://creativecommons\.org/licenses/by-nc/3\.0/?
82|CC-BY-ND-4.0|creativecommons.org|https?://creativecommons\.org/licenses/by-nd/4\.0/?
82|CC-BY-NC-SA-4.0|creativecommons.org|https?://creativecommons\.org/licenses/by-nc-sa/4\.0/?
82|CC-BY-NC-SA-3.0|creativecommons.org|https?://creativecommons\.org/licenses/by-nc-sa/3\.0/?
82|CC-BY-NC-ND-4.0|creativecommons.org|https?://creativecommons\.org/licenses/by-nc-nd/4\.0/?
82|CC-BY-NC-ND-3.0|creativecommons.org|https?://creativecommons\.org/licenses/by-nc-nd/3\.0/?
82|CC0-1.0|creativecommons.org|https?://creativecommons\.org/publicdomain/zero/1\.0/?
82|CC-PDDC|creativecommons.org|https?://creativecommons\.org/licenses/publicdomain/?
80|AGPL-3.0|affero|(?:GNU )?Affero General Public Licen[cs]e,? \(?(?:v\.? ?|version )?3(?:\.0)?\)?
80|AGPL-1.0|affero|Affero General Public Licen[cs]e,? (?:v\.? ?|version )?1(?:\.0)?
80|LGPL-3.0|lesser|(?:GNU )?Lesser General Public Licen[cs]e,? \(?(?:v\.? ?|version )?3(?:\.0)?\)?
80|LGPL-2.1|lesser|(?:GNU )?Lesser General Public Licen[cs]e,? \(?(?:v\.? ?|version )?2\.1\)?
80|LGPL-2.0|library general|(?:GNU )?Library General Public Licen[cs]e,? \(?(?:v\.? ?|version )?2(?:\.0)?\)?
80|GPL-3.0|general public|(?:GNU )?General Public Licen[cs]e,? \(?(?:v\.? ?|version )?3(?:\.0)?\)?
80|GPL-2.0|general public|(?:GNU )?General Public Licen[cs]e,? \(?(?:v\.? ?|version )?2(?:\.0)?\)?
80|GPL-1.0|general public|(?:GNU )?General Public Licen[cs]e,? \(?(?:v\.? ?|version )?1(?:\.0)?\)?
80|GFDL-1.3|free documentation|(?:GNU )?Free Documentation Licen[cs]e,? \(?(?:v\.? ?|version )?1\.3\)?
80|GFDL-1.2|free documentation|(?:GNU )?Free Documentation Licen[cs]e,? \(?(?:v\.? ?|version )?1\.2\)?
80|GFDL-1.1|free documentation|(?:GNU )?Free Documentation Licen[cs]e,? \(?(?:v\.? ?|version )?1\.1\)?
78|GPL-3.0|gpl|\bGPL[- ]?(?:v\.? ?|version )?3(?:\.0)?\b
78|GPL-2.0|gpl|\bGPL[- ]?(?:v\.? ?|version )?2(?:\.0)?\b
78|LGPL-3.0|lgpl|\bLGPL[- ]?(?:v\.? ?|version )?3(?:\.0)?\b
78|LGPL-2.1|lgpl|\bLGPL[- ]?(?:v\.? ?|version )?2\.1\b
78|AGPL-3.0|agpl|\bAGPL[- ]?(?:v\.? ?|version )?3(?:\.0)?\b
76|AGPL-3.0|gnu.org|https?://(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.(?:html|txt))?
76|GPL-3.0|gnu.org|https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.(?:html|txt))?
76|GPL-2.0|gnu.org|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.(?:html|txt))?
76|LGPL-3.0|gnu.org|https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.(?:html|txt))?
76|LGPL-2.1|gnu.org|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.(?:html|txt))?
76|GFDL-1.3|gnu.org|https?://(?:www\.)?gnu\.org/licenses/fdl(?:-1\.3)?(?:\.(?:html|txt))?
76|Apache-2.0|apache.org|https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.(?:html|txt))?
76|Apache-1.1|apache.org|https?://(?:www\.)?apache\.org/licenses/LICENSE-1\.1
76|MPL-2.0|mozilla.org|https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0/?
76|MPL-1.1|mozilla.org|https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/1\.1/?
76|EPL-2.0|eclipse.org|https?://(?:www\.)?eclipse\.org/legal/epl-(?:2\.0|v20)(?:/|\.html)?
76|EPL-1.0|eclipse.org|https?://(?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?
76|MIT|opensource.org|https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license(?:\.php)?)?
76|BSD-3-Clause|opensource.org|https?://(?:www\.)?opensource\.org/licenses?/BSD-3-Clause
76|BSD-2-Clause|opensource.org|https?://(?:www\.)?opensource\.org/licenses?/BSD-2-Clause
76|ISC|opensource.org|https?://(?:www\.)?opensource\.org/licenses?/ISC
76|Apache-2.0|opensource.org|https?://(?:www\.)?opensource\.org/licenses?/Apache-2\.0
76|Artistic-2.0|opensource.org|https?://(?:www\.)?opensource\.org/licenses?/Artistic-2\.0
76|Unlicense|unlicense.org|https?://(?:www\.)?unlicense\.org/?
76|WTFPL|wtfpl.net|https?://(?:www\.)?wtfpl\.net/?
76|BSL-1.0|boost.org|https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
76|OFL-1.1|scripts.sil|https?://scripts\.sil\.org/OFL
76|CDDL-1.0|opensource.org|https?://(?:www\.)?opensource\.org/licenses?/CDDL-1\.0
76|ODbL-1.0|opendatacommons|https?://(?:www\.)?opendatacommons\.org/licenses/odbl(?:/1[.-]0)?/?
76|ODC-By-1.0|opendatacommons|https?://(?:www\.)?opendatacommons\.org/licenses/by(?:/1[.-]0)?/?
76|PDDL-1.0|opendatacommons|https?://(?:www\.)?opendatacommons\.org/licenses/pddl(?:/1[.-]0)?/?
72|Apache-2.0|apache|Apache(?: Software)? Licen[cs]e,? (?:v\.? ?|version )?2(?:\.0)?
72|Apache-2.0|apache|\bApache[- ]2\.0\b(?: Licen[cs]e)?
72|Apache-1.1|apache|Apache(?: Software)? Licen[cs]e,? (?:v\.? ?|version )?1\.1
72|Apache-1.0|apache|Apache(?: Software)? Licen[cs]e,? (?:v\.? ?|version )?1\.0
72|MIT|mit|(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?MIT(?: \(?X11\)?)? Licen[cs]e
72|MIT-0|mit|MIT No Attribution
72|X11|x11|\bX11 Licen[cs]e\b
72|MIT|expat|\bExpat Licen[cs]e\b
72|BSD-3-Clause|bsd|(?:new|modified|revised|3-clause|three-clause) BSD Licen[cs]e
72|BSD-3-Clause|bsd|\bBSD[- ]3[- ]clause\b(?: Licen[cs]e)?
72|BSD-2-Clause|bsd|(?:simplified|freebsd|2-clause|two-clause) BSD Licen[cs]e
72|BSD-2-Clause|bsd|\bBSD[- ]2[- ]clause\b(?: Licen[cs]e)?
72|BSD-4-Clause|bsd|(?:original|4-clause|four-clause) BSD Licen[cs]e
72|0BSD|bsd|(?:zero-clause|0-clause) BSD(?: Licen[cs]e)?
72|0BSD|0bsd|\b0BSD\b
72|BSD-3-Clause-Clear|bsd|Clear BSD Licen[cs]e
72|ISC|isc|\bISC Licen[cs]e\b
72|MPL-2.0|mozilla public|Mozilla Public Licen[cs]e,? (?:v\.? ?|version )?2(?:\.0)?
72|MPL-1.1|mozilla public|Mozilla Public Licen[cs]e,? (?:v\.? ?|version )?1\.1
72|MPL-1.0|mozilla public|Mozilla Public Licen[cs]e,? (?:v\.? ?|version )?1\.0
72|MPL-2.0|mpl|\bMPL[- ]?(?:v\.? ?)?2(?:\.0)?\b
72|EPL-2.0|eclipse public|Eclipse Public Licen[cs]e,? (?:- )?(?:v\.? ?|version )?2(?:\.0)?
72|EPL-1.0|eclipse public|Eclipse Public Licen[cs]e,? (?:- )?(?:v\.? ?|version )?1(?:\.0)?
72|EDL-1.0|eclipse distribution|Eclipse Distribution Licen[cs]e,? (?:- )?(?:v\.? ?|version )?1(?:\.0)?
72|CDDL-1.0|cddl|\bCDDL[- ]?(?:v\.? ?)?1\.0\b
72|CDDL-1.1|cddl|\bCDDL[- ]?(?:v\.? ?)?1\.1\b
72|BSL-1.0|boost|Boost Software Licen[cs]e(?:,? (?:v\.? ?|version )?1(?:\.0)?)?
72|BUSL-1.1|business source|Business Source Licen[cs]e(?:,? (?:v\.? ?|version )?1\.1)?
72|SSPL-1.0|server side public|Server Side Public Licen[cs]e(?:,? (?:v\.? ?|version )?1(?:\.0)?)?
72|Elastic-2.0|elastic|Elastic Licen[cs]e(?:,? (?:v\.? ?|version )?2(?:\.0)?)
72|PolyForm-Noncommercial-1.0.0|polyform|PolyForm Noncommercial Licen[cs]e(?: 1\.0\.0)?
72|PolyForm-Small-Business-1.0.0|polyform|PolyForm Small Business Licen[cs]e(?: 1\.0\.0)?
72|Artistic-1.0|artistic|Artistic Licen[cs]e,? (?:v\.? ?|version )?1(?:\.0)?
72|Artistic-2.0|artistic|Artistic Licen[cs]e,? (?:v\.? ?|version )?2(?:\.0)?
72|Zlib|zlib|\bzlib(?:/libpng)? Licen[cs]e\b
72|Libpng|libpng|\blibpng Licen[cs]e\b
72|PSF-2.0|python software|Python Software Foundation Licen[cs]e(?:,? (?:v\.? ?|version )?2(?:\.0)?)?
72|Ruby|ruby|\bRuby(?:'s)? Licen[cs]e\b
72|Vim|vim|\bVim Licen[cs]e\b
72|TCL|tcl|\bTcl/Tk Licen[cs]e\b
72|curl|curl|\bcurl Licen[cs]e\b
72|NCSA|ncsa|\bNCSA(?: Open Source)? Licen[cs]e\b
72|OpenSSL|openssl|\bOpenSSL Licen[cs]e\b
72|SSLeay|ssleay|\bSSLeay Licen[cs]e\b
72|PostgreSQL|postgresql|\bPostgreSQL Licen[cs]e\b
72|W3C|w3c|\bW3C Software(?: Notice and)? Licen[cs]e\b
72|OFL-1.1|open font|(?:SIL )?Open Font Licen[cs]e,? (?:v\.? ?|version )?1\.1
72|IPL-1.0|ibm public|IBM Public Licen[cs]e(?:,? (?:v\.? ?|version )?1(?:\.0)?)?
72|QPL-1.0|q public|\bQ Public Licen[cs]e(?:,? (?:v\.? ?|version )?1(?:\.0)?)?
72|LPPL-1.3c|latex project|LaTeX Project Public Licen[cs]e,? (?:v\.? ?|version )?1\.3c
72|LPPL-1.3a|latex project|LaTeX Project Public Licen[cs]e,? (?:v\.? ?|version )?1\.3a
72|LPPL-1.2|latex project|LaTeX Project Public Licen[cs]e,? (?:v\.? ?|version )?1\.2
72|OSL-3.0|open software|Open Software Licen[cs]e,? (?:v\.? ?|version )?3(?:\.0)?
72|AFL-3.0|academic free|Academic Free Licen[cs]e,? (?:v\.? ?|version )?3(?:\.0)?
72|AFL-2.1|academic free|Academic Free Licen[cs]e,? (?:v\.? ?|version )?2\.1
72|MS-PL|microsoft public|Microsoft Public Licen[cs]e
72|MS-RL|microsoft reciprocal|Microsoft Reciprocal Licen[cs]e
72|APSL-2.0|apple public|Apple Public Source Licen[cs]e,? (?:v\.? ?|version )?2(?:\.0)?
72|Sleepycat|sleepycat|\bSleepycat Licen[cs]e\b
72|UPL-1.0|universal permissive|Universal Permissive Licen[cs]e(?:,? (?:v\.? ?|version )?1(?:\.0)?)?
72|MulanPSL-2.0|mulan|Mulan (?:PSL|Permissive Software Licen[cs]e),? (?:v\.? ?|version )?2
72|ODbL-1.0|open database|Open (?:Data Commons )?Open Database Licen[cs]e|Open Database Licen[cs]e
72|ODC-By-1.0|open data commons|Open Data Commons Attribution Licen[cs]e
72|PDDL-1.0|open data commons|Open Data Commons Public Domain Dedication
72|CDLA-Permissive-2.0|community data|Community Data Licen[cs]e Agreement ?(?:-|–) ?Permissive(?:,? (?:version )?2(?:\.0)?)?
72|CDLA-Sharing-1.0|community data|Community Data Licen[cs]e Agreement ?(?:-|–) ?Sharing(?:,? (?:version )?1(?:\.0)?)?
72|OGL-UK-3.0|open government|Open Government Licen[cs]e,? (?:v\.? ?|version )?3(?:\.0)?
72|OGL-UK-2.0|open government|Open Government Licen[cs]e,? (?:v\.? ?|version )?2(?:\.0)?
72|BigScience-OpenRAIL-M|openrail|\bOpenRAIL(?:\+\+)?-M\b(?: Licen[cs]e)?
72|BlueOak-1.0.0|blue oak|Blue Oak Model Licen[cs]e(?: 1\.0\.0)?
72|Hippocratic-2.1|hippocratic|Hippocratic Licen[cs]e(?:,? (?:version )?2\.1)?
72|JSON|good, not evil|The Software shall be used for Good, not Evil
72|WTFPL|wtfpl|\bWTFPL\b
72|Beerware|beerware|\bBeerware(?: Licen[cs]e)?\b
72|CC0-1.0|cc0|\bCC0\b
60|AGPL|affero|(?:GNU )?Affero General Public Licen[cs]e
60|LGPL|lesser|(?:GNU )?Lesser General Public Licen[cs]e
60|LGPL|library general|(?:GNU )?Library General Public Licen[cs]e
60|GFDL|free documentation|(?:GNU )?Free Documentation Licen[cs]e
58|GPL|general public|(?:GNU )?General Public Licen[cs]e
58|GPL|gpl|\bGNU GPL\b
55|MIT|mit|\bMIT Licen[cs]e\b
55|MIT|mit|\bMIT-licensed\b
55|BSD|bsd|\bBSD(?:-style)? Licen[cs]e\b
55|Apache|apache|\bApache(?: Software)? Licen[cs]e\b
55|MPL|mozilla public|Mozilla Public Licen[cs]e
55|EPL|eclipse public|Eclipse Public Licen[cs]e
55|CDDL|common development|Common Development and Distribution Licen[cs]e
55|Artistic|artistic|\bArtistic Licen[cs]e\b
55|EUPL|european union public|European Union Public Licen[cs]e
55|OFL|open font|(?:SIL )?Open Font Licen[cs]e
55|CC-BY-NC-SA|noncommercial;non-commercial|Attribution[- ]Non-?Commercial[- ]Share ?Alike
55|CC-BY-NC-ND|noncommercial;non-commercial|Attribution[- ]Non-?Commercial[- ]No ?Deriv(?:ative)?s?
55|CC-BY-SA|alike|Creative Commons Attribution[- ]Share ?Alike
55|CC-BY-NC|noncommercial;non-commercial|Creative Commons Attribution[- ]Non-?Commercial
55|CC-BY|attribution|Creative Commons Attribution(?: Licen[cs]e)?
50|CC|creative commons|Creative Commons(?: Licen[cs]e)?
50|LicenseRef-PublicDomain|public domain|(?:released|placed|dedicated|put) (?:in)?to the public domain
50|LicenseRef-PublicDomain|public domain|(?:is|are) in the public domain
45|LicenseRef-Proprietary|rights reserved|(?:proprietary|confidential)[\s\S]{0,80}?all rights reserved
40|LicenseRef-AllRightsReserved|rights reserved|\ball rights reserved\b
40|LicenseRef-NonCommercial|non-commercial|for non-commercial (?:use|purposes) only
40|LicenseRef-ResearchOnly|research|for research (?:use|purposes) only
40|LicenseRef-NoRedistribution|may not be|may not be (?:copied|reproduced|redistributed)(?:,? (?:copied|reproduced|or|redistributed))* without
35|LicenseRef-OpenSource|open source|(?:released|licensed|distributed) under an? open source licen[cs]e
30|LicenseRef-SeeFile|license;copying|see (?:the )?(?:accompanying )?(?:file )?(?:LICENSE|COPYING)(?:\.(?:txt|md))?(?: file)? for (?:the )?(?:full )?(?:licen[cs]e|details|terms)
"""
