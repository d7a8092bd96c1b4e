"""License scans: ordered signature rules, gated by keywords, with overlaps resolved.

Every rule is a regular expression with a place in the order: words of the licence's own
text first, then tags, notices ("licensed under ..."), addresses, and bare names. A rule
runs on a text only if the text holds the rule's keywords, the literals that each of its
matches must contain; one pass of a keyword automaton finds all keywords of a text.
Of the detections that remain, one within a longer one goes (of equal ones the later
rule's), and where two others overlap the earlier rule's stays.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import arrow_map

#: In the expressions below a space stands for white space and what comment blocks put around it.
GAP = r"[ \t\r\n*#/]+"
_V = "(?:,? (?:version |v\\.? ?|ver\\. ?)?|-|v)"  # before a version number

#: Identifier, and expressions of the licence's names.
NAMES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", r"(?:GNU )?(?:Affero General Public Licen[sc]e" + _V + r"3(?:\.0)?|AGPL" + _V + r"?3(?:\.0)?)\b"),
    ("AGPL-1.0", r"Affero General Public Licen[sc]e" + _V + r"1(?:\.0)?\b"),
    ("AGPL", r"(?:GNU )?Affero General Public Licen[sc]e\b"),
    ("LGPL-3.0", r"(?:GNU )?(?:Lesser General Public Licen[sc]e" + _V + r"3(?:\.0)?|LGPL" + _V + r"?3(?:\.0)?)\b"),
    ("LGPL-2.1", r"(?:GNU )?(?:Lesser General Public Licen[sc]e" + _V + r"2\.1|LGPL" + _V + r"?2\.1)\b"),
    ("LGPL-2.0", r"(?:GNU )?(?:Library General Public Licen[sc]e" + _V + r"2(?:\.0)?|LGPL" + _V + r"?2(?:\.0)?)\b"),
    ("LGPL", r"(?:GNU )?(?:Lesser|Library) General Public Licen[sc]e\b"),
    ("GPL-3.0", r"(?:GNU )?(?:General Public Licen[sc]e" + _V + r"3(?:\.0)?|GPL" + _V + r"?3(?:\.0)?)\b"),
    ("GPL-2.0", r"(?:GNU )?(?:General Public Licen[sc]e" + _V + r"2(?:\.0)?|GPL" + _V + r"?2(?:\.0)?)\b"),
    ("GPL-1.0", r"(?:GNU )?(?:General Public Licen[sc]e" + _V + r"1(?:\.0)?|GPL" + _V + r"?1(?:\.0)?)\b"),
    ("GPL", r"(?:GNU General Public Licen[sc]e|GNU GPL)\b"),
    ("GFDL-1.3", r"(?:GNU )?Free Documentation Licen[sc]e" + _V + r"1\.3\b"),
    ("GFDL-1.2", r"(?:GNU )?Free Documentation Licen[sc]e" + _V + r"1\.2\b"),
    ("GFDL-1.1", r"(?:GNU )?Free Documentation Licen[sc]e" + _V + r"1\.1\b"),
    ("GFDL", r"GNU Free Documentation Licen[sc]e\b"),
    ("Apache-2.0", r"Apache(?: Software)?(?: Licen[sc]e)?" + _V + r"2(?:\.0)?\b"),
    ("Apache-1.1", r"Apache(?: Software)? Licen[sc]e" + _V + r"1\.1\b"),
    ("Apache-1.0", r"Apache(?: Software)? Licen[sc]e" + _V + r"1\.0\b"),
    ("Apache", r"Apache(?: Software)? Licen[sc]e\b"),
    ("MIT-0", r"MIT No Attribution(?: Licen[sc]e)?\b"),
    ("MIT-Modern", r"MIT Licen[sc]e Modern Variant\b"),
    ("MIT", r"(?:MIT|Expat|MIT/X11|X11/MIT) Licen[sc]e\b"),
    ("X11", r"X11 Licen[sc]e\b"),
    ("BSD-4-Clause", r"(?:BSD-4-Clause|4-clause BSD|four-clause BSD|original BSD) Licen[sc]e\b"),
    ("BSD-3-Clause", r"(?:BSD-3-Clause|3-clause BSD|three-clause BSD|new BSD|modified BSD|revised BSD) Licen[sc]e\b"),
    ("BSD-2-Clause", r"(?:BSD-2-Clause|2-clause BSD|two-clause BSD|simplified BSD|FreeBSD) Licen[sc]e\b"),
    ("BSD-1-Clause", r"(?:BSD-1-Clause|1-clause BSD) Licen[sc]e\b"),
    ("0BSD", r"(?:Zero-Clause BSD|0BSD|BSD Zero Clause)(?: Licen[sc]e)?\b"),
    ("BSD-Protection", r"BSD Protection Licen[sc]e\b"),
    ("BSD", r"BSD(?:-style)? Licen[sc]e\b"),
    ("ISC", r"ISC Licen[sc]e\b"),
    ("MPL-2.0", r"(?:Mozilla Public Licen[sc]e" + _V + r"2(?:\.0)?|MPL" + _V + r"?2(?:\.0)?)\b"),
    ("MPL-1.1", r"(?:Mozilla Public Licen[sc]e" + _V + r"1\.1|MPL" + _V + r"?1\.1)\b"),
    ("MPL-1.0", r"(?:Mozilla Public Licen[sc]e" + _V + r"1\.0|MPL" + _V + r"?1\.0)\b"),
    ("MPL", r"Mozilla Public Licen[sc]e\b"),
    ("EPL-2.0", r"(?:Eclipse Public Licen[sc]e" + _V + r"2(?:\.0)?|EPL" + _V + r"?2(?:\.0)?)\b"),
    ("EPL-1.0", r"(?:Eclipse Public Licen[sc]e" + _V + r"1(?:\.0)?|EPL" + _V + r"?1(?:\.0)?)\b"),
    ("EPL", r"Eclipse Public Licen[sc]e\b"),
    ("EDL-1.0", r"Eclipse Distribution Licen[sc]e\b"),
    ("CDDL-1.1", r"(?:Common Development and Distribution Licen[sc]e|CDDL)" + _V + r"1\.1\b"),
    ("CDDL-1.0", r"(?:Common Development and Distribution Licen[sc]e|CDDL)(?:" + _V + r"1\.0)?\b"),
    ("CPL-1.0", r"Common Public Licen[sc]e(?:" + _V + r"1\.0)?\b"),
    ("IPL-1.0", r"IBM Public Licen[sc]e\b"),
    ("EUPL-1.2", r"(?:European Union Public Licen[sc]e|EUPL)" + _V + r"1\.2\b"),
    ("EUPL-1.1", r"(?:European Union Public Licen[sc]e|EUPL)" + _V + r"1\.1\b"),
    ("EUPL", r"European Union Public Licen[sc]e\b"),
    ("CC-BY-NC-ND-4.0", r"(?:CC|Creative Commons)[ -](?:BY-NC-ND|Attribution-NonCommercial-NoDerivatives)[ -]4\.0\b"),
    ("CC-BY-NC-ND-3.0", r"(?:CC|Creative Commons)[ -](?:BY-NC-ND|Attribution-NonCommercial-NoDeriv(?:ative)?s)[ -]3\.0\b"),
    ("CC-BY-NC-ND", r"(?:CC|Creative Commons)[ -](?:BY-NC-ND|Attribution-NonCommercial-NoDeriv(?:ative)?s)\b"),
    ("CC-BY-NC-SA-4.0", r"(?:CC|Creative Commons)[ -](?:BY-NC-SA|Attribution-NonCommercial-ShareAlike)[ -]4\.0\b"),
    ("CC-BY-NC-SA-3.0", r"(?:CC|Creative Commons)[ -](?:BY-NC-SA|Attribution-NonCommercial-ShareAlike)[ -]3\.0\b"),
    ("CC-BY-NC-SA", r"(?:CC|Creative Commons)[ -](?:BY-NC-SA|Attribution-NonCommercial-ShareAlike)\b"),
    ("CC-BY-NC-4.0", r"(?:CC|Creative Commons)[ -](?:BY-NC|Attribution-NonCommercial)[ -]4\.0\b"),
    ("CC-BY-NC-3.0", r"(?:CC|Creative Commons)[ -](?:BY-NC|Attribution-NonCommercial)[ -]3\.0\b"),
    ("CC-BY-NC", r"(?:CC|Creative Commons)[ -](?:BY-NC|Attribution-NonCommercial)\b"),
    ("CC-BY-ND-4.0", r"(?:CC|Creative Commons)[ -](?:BY-ND|Attribution-NoDerivatives)[ -]4\.0\b"),
    ("CC-BY-ND", r"(?:CC|Creative Commons)[ -](?:BY-ND|Attribution-NoDeriv(?:ative)?s)\b"),
    ("CC-BY-SA-4.0", r"(?:CC|Creative Commons)[ -](?:BY-SA|Attribution-ShareAlike)[ -]4\.0\b"),
    ("CC-BY-SA-3.0", r"(?:CC|Creative Commons)[ -](?:BY-SA|Attribution-ShareAlike)[ -]3\.0\b"),
    ("CC-BY-SA-2.5", r"(?:CC|Creative Commons)[ -](?:BY-SA|Attribution-ShareAlike)[ -]2\.5\b"),
    ("CC-BY-SA", r"(?:CC|Creative Commons)[ -](?:BY-SA|Attribution-ShareAlike)\b"),
    ("CC-BY-4.0", r"(?:CC|Creative Commons)[ -](?:BY|Attribution)[ -]4\.0\b"),
    ("CC-BY-3.0", r"(?:CC|Creative Commons)[ -](?:BY|Attribution)[ -]3\.0\b"),
    ("CC-BY-2.5", r"(?:CC|Creative Commons)[ -](?:BY|Attribution)[ -]2\.5\b"),
    ("CC-BY-2.0", r"(?:CC|Creative Commons)[ -](?:BY|Attribution)[ -]2\.0\b"),
    ("CC-BY", r"(?:CC-BY|Creative Commons Attribution)\b"),
    ("CC0-1.0", r"(?:CC0|Creative Commons Zero)(?:[ -]1\.0)?\b"),
    ("CC-PDDC", r"Creative Commons Public Domain Dedication\b"),
    ("CC", r"Creative Commons Licen[sc]e\b"),
    ("Unlicense", r"\bThe Unlicense\b"),
    ("WTFPL", r"(?:WTFPL|Do What The F\*?u?\*?c?k You Want To Public Licen[sc]e)\b"),
    ("Zlib", r"zlib(?:/libpng)? Licen[sc]e\b"),
    ("Libpng", r"(?:libpng|PNG Reference Library) Licen[sc]e\b"),
    ("BSL-1.0", r"Boost Software Licen[sc]e(?:" + _V + r"1\.0)?\b"),
    ("BUSL-1.1", r"Business Source Licen[sc]e(?:" + _V + r"1\.1)?\b"),
    ("SSPL-1.0", r"(?:Server Side Public Licen[sc]e|SSPL)(?:" + _V + r"1(?:\.0)?)?\b"),
    ("Elastic-2.0", r"Elastic Licen[sc]e" + _V + r"2(?:\.0)?\b"),
    ("Artistic-2.0", r"Artistic Licen[sc]e" + _V + r"2(?:\.0)?\b"),
    ("Artistic-1.0", r"Artistic Licen[sc]e" + _V + r"1(?:\.0)?\b"),
    ("Artistic", r"Artistic Licen[sc]e\b"),
    ("PSF-2.0", r"(?:Python Software Foundation|PSF) Licen[sc]e\b"),
    ("Python-2.0", r"Python Licen[sc]e(?:" + _V + r"2(?:\.0)?)?\b"),
    ("PHP-3.01", r"PHP Licen[sc]e" + _V + r"3\.01\b"),
    ("PHP-3.0", r"PHP Licen[sc]e(?:" + _V + r"3\.0)?\b"),
    ("Ruby", r"Ruby Licen[sc]e\b"),
    ("Zend-2.0", r"Zend(?: Engine)? Licen[sc]e\b"),
    ("OpenSSL", r"OpenSSL Licen[sc]e\b"),
    ("SSLeay", r"SSLeay Licen[sc]e\b"),
    ("PostgreSQL", r"PostgreSQL Licen[sc]e\b"),
    ("NCSA", r"(?:University of Illinois/NCSA Open Source|NCSA Open Source|UIUC) Licen[sc]e\b"),
    ("UPL-1.0", r"Universal Permissive Licen[sc]e\b"),
    ("AFL-3.0", r"Academic Free Licen[sc]e" + _V + r"3(?:\.0)?\b"),
    ("AFL", r"Academic Free Licen[sc]e\b"),
    ("OSL-3.0", r"Open Software Licen[sc]e" + _V + r"3(?:\.0)?\b"),
    ("OSL", r"Open Software Licen[sc]e\b"),
    ("MS-PL", r"Microsoft Public Licen[sc]e\b"),
    ("MS-RL", r"Microsoft Reciprocal Licen[sc]e\b"),
    ("OFL-1.1", r"(?:SIL )?Open Font Licen[sc]e(?:" + _V + r"1\.1)?\b"),
    ("ODbL-1.0", r"(?:Open Data Commons )?Open Database Licen[sc]e\b"),
    ("ODC-By-1.0", r"Open Data Commons Attribution Licen[sc]e\b"),
    ("PDDL-1.0", r"(?:Open Data Commons )?Public Domain Dedication and Licen[sc]e\b"),
    ("CDLA-Permissive-2.0", r"Community Data Licen[sc]e Agreement[ -]+Permissive\b"),
    ("CDLA-Sharing-1.0", r"Community Data Licen[sc]e Agreement[ -]+Sharing\b"),
    ("OGL-UK-3.0", r"Open Government Licen[sc]e" + _V + r"3(?:\.0)?\b"),
    ("OGL-UK", r"Open Government Licen[sc]e\b"),
    ("CeCILL-2.1", r"CeCILL" + _V + r"2\.1\b"),
    ("CeCILL-B", r"CeCILL-B\b"),
    ("CeCILL-C", r"CeCILL-C\b"),
    ("CeCILL", r"CeCILL(?: Licen[sc]e| free software licen[sc]e)\b"),
    ("LPPL-1.3c", r"(?:LaTeX Project Public Licen[sc]e|LPPL)" + _V + r"1\.3c?\b"),
    ("LPPL", r"LaTeX Project Public Licen[sc]e\b"),
    ("QPL-1.0", r"Q Public Licen[sc]e\b"),
    ("Sleepycat", r"Sleepycat Licen[sc]e\b"),
    ("APSL-2.0", r"Apple Public Source Licen[sc]e\b"),
    ("NPL-1.1", r"Netscape Public Licen[sc]e\b"),
    ("SPL-1.0", r"Sun Public Licen[sc]e\b"),
    ("SISSL", r"Sun Industry Standards Source Licen[sc]e\b"),
    ("RPL-1.5", r"Reciprocal Public Licen[sc]e\b"),
    ("CPAL-1.0", r"Common Public Attribution Licen[sc]e\b"),
    ("Vim", r"Vim Licen[sc]e\b"),
    ("ICU", r"ICU Licen[sc]e\b"),
    ("Unicode-DFS", r"Unicode (?:Licen[sc]e Agreement|Terms of Use)\b"),
    ("W3C", r"W3C Software(?: Notice and| and Document)? Licen[sc]e\b"),
    ("curl", r"curl Licen[sc]e\b"),
    ("FTL", r"FreeType (?:Project )?Licen[sc]e\b"),
    ("IJG", r"Independent JPEG Group Licen[sc]e\b"),
    ("ImageMagick", r"ImageMagick Licen[sc]e\b"),
    ("JSON", r"JSON Licen[sc]e\b"),
    ("Beerware", r"Beer-?ware Licen[sc]e\b"),
    ("BlueOak-1.0.0", r"Blue Oak Model Licen[sc]e\b"),
    ("MulanPSL-2.0", r"Mulan (?:PSL|Permissive Software Licen[sc]e)" + _V + r"2\b"),
    ("ECL-2.0", r"Educational Community Licen[sc]e\b"),
    ("HPND", r"Historical Permission Notice and Disclaimer\b"),
    ("NAIST-2003", r"NAIST Licen[sc]e\b"),
    ("Intel", r"Intel (?:Open Source|Simplified Software) Licen[sc]e\b"),
    ("OpenRAIL-M", r"(?:Creative ML |BigScience )?Open ?RAIL[ -]?(?:\+\+)?M?(?: Licen[sc]e)?\b"),
    ("Llama-Community", r"Llama (?:2 |3 |3\.1 )?Community Licen[sc]e(?: Agreement)?\b"),
    ("Proprietary-EULA", r"End[ -]User Licen[sc]e Agreement\b"),
)

#: Identifier, and expressions of the licence's own words, which no mention of its name has.
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", r"Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", r"The above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("ISC", r"Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-3-Clause", r"Neither the name of [^\n]{1,80} nor the names of its contributors may be used to endorse or promote"),
    ("BSD-4-Clause", r"All advertising materials mentioning features or use of this software must display"),
    ("BSD", r"Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD", r"Redistributions of source code must retain the above copyright notice"),
    ("Apache-2.0", r"Unless required by applicable law or agreed to in writing, software distributed under the Licen[sc]e is distributed on an \"?AS IS\"? BASIS"),
    ("Apache-2.0", r"TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL", r"This program is free software[:;] you can redistribute it and/or modify it under the terms of the GNU General Public Licen[sc]e"),
    ("GPL", r"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GPL-3.0", r"GNU GENERAL PUBLIC LICEN[SC]E Version 3, 29 June 2007"),
    ("GPL-2.0", r"GNU GENERAL PUBLIC LICEN[SC]E Version 2, June 1991"),
    ("AGPL-3.0", r"GNU AFFERO GENERAL PUBLIC LICEN[SC]E Version 3, 19 November 2007"),
    ("LGPL-3.0", r"GNU LESSER GENERAL PUBLIC LICEN[SC]E Version 3, 29 June 2007"),
    ("LGPL-2.1", r"GNU LESSER GENERAL PUBLIC LICEN[SC]E Version 2\.1, February 1999"),
    ("LGPL", r"This library is free software[:;] you can redistribute it and/or modify it under the terms of the GNU (?:Lesser|Library) General Public Licen[sc]e"),
    ("MPL-2.0", r"This Source Code Form is subject to the terms of the Mozilla Public Licen[sc]e, v\. 2\.0"),
    ("MPL-1.1", r"The contents of this file are subject to the Mozilla Public Licen[sc]e Version 1\.1"),
    ("EPL-2.0", r"This program and the accompanying materials are made available under the terms of the Eclipse Public Licen[sc]e 2\.0"),
    ("EPL-1.0", r"THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICEN[SC]E"),
    ("CDDL-1.0", r"The contents of this file are subject to the terms of the Common Development and Distribution Licen[sc]e"),
    ("Unlicense", r"This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", r"has waived all copyright and related or neighbou?ring rights"),
    ("CC0-1.0", r"To the extent possible under law, [^\n]{1,100} waived all copyright"),
    ("Zlib", r"This software is provided 'as-is', without any express or implied warranty\. In no event will the authors be held liable"),
    ("Zlib", r"Altered source versions must be plainly marked as such"),
    ("BSL-1.0", r"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("WTFPL", r"You just DO WHAT THE FUCK YOU WANT TO"),
    ("Beerware", r"If we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("OFL-1.1", r"This Font Software is licensed under the SIL Open Font Licen[sc]e"),
    ("PostgreSQL", r"Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("JSON", r"The Software shall be used for Good, not Evil"),
    ("NCSA", r"Developed by: [^\n]{1,100} University of Illinois"),
    ("HPND", r"Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("GFDL", r"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation Licen[sc]e"),
    ("Artistic-2.0", r"This Licen[sc]e establishes the terms under which a given free software Package may be copied"),
    ("Public-Domain", r"(?:has been |is hereby |is )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("Public-Domain", r"This (?:work|file|code|software|document) is in the public domain"),
    ("Proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("Proprietary", r"Unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|material|document)[^.\n]{0,80} is (?:strictly )?prohibited"),
    ("All-Rights-Reserved", r"All rights reserved\b"),
)

#: Identifier, and expressions of addresses.
ADDRESSES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", r"www\.apache\.org/licenses/LICENSE-2\.0"),
    ("MIT", r"opensource\.org/licenses?/MIT\b"),
    ("BSD-3-Clause", r"opensource\.org/licenses?/BSD-3-Clause\b"),
    ("BSD-2-Clause", r"opensource\.org/licenses?/BSD-2-Clause\b"),
    ("ISC", r"opensource\.org/licenses?/ISC\b"),
    ("GPL-3.0", r"gnu\.org/licenses/gpl-3\.0"),
    ("GPL-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("GPL", r"gnu\.org/(?:licenses|copyleft)/gpl\b"),
    ("LGPL-3.0", r"gnu\.org/licenses/lgpl-3\.0"),
    ("LGPL-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("LGPL", r"gnu\.org/(?:licenses|copyleft)/lgpl\b"),
    ("AGPL-3.0", r"gnu\.org/licenses/agpl-3\.0"),
    ("GFDL", r"gnu\.org/licenses/fdl\b"),
    ("MPL-2.0", r"mozilla\.org/(?:en-US/)?MPL/2\.0"),
    ("MPL-1.1", r"mozilla\.org/(?:en-US/)?MPL/1\.1"),
    ("EPL-2.0", r"eclipse\.org/legal/epl-2\.0|eclipse\.org/legal/epl-v20"),
    ("EPL-1.0", r"eclipse\.org/legal/epl-v10"),
    ("CC-BY-NC-ND", r"creativecommons\.org/licenses/by-nc-nd/[0-9.]+"),
    ("CC-BY-NC-SA", r"creativecommons\.org/licenses/by-nc-sa/[0-9.]+"),
    ("CC-BY-NC", r"creativecommons\.org/licenses/by-nc/[0-9.]+"),
    ("CC-BY-ND", r"creativecommons\.org/licenses/by-nd/[0-9.]+"),
    ("CC-BY-SA", r"creativecommons\.org/licenses/by-sa/[0-9.]+"),
    ("CC-BY", r"creativecommons\.org/licenses/by/[0-9.]+"),
    ("CC0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("CC-PDM-1.0", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("Unlicense", r"unlicense\.org\b"),
    ("WTFPL", r"(?:sam\.zoy\.org/wtfpl|wtfpl\.net)\b"),
    ("BSL-1.0", r"boost\.org/LICENSE_1_0\.txt"),
    ("OFL-1.1", r"scripts\.sil\.org/OFL\b"),
    ("EUPL-1.2", r"joinup\.ec\.europa\.eu/[a-z0-9/_-]{0,60}eupl\b"),
    ("ODbL-1.0", r"opendatacommons\.org/licenses/odbl\b"),
    ("PDDL-1.0", r"opendatacommons\.org/licenses/pddl\b"),
    ("OGL-UK", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("UPL-1.0", r"oss\.oracle\.com/licenses/upl\b"),
    ("SSPL-1.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("Elastic-2.0", r"elastic\.co/licensing/elastic-license"),
    ("PHP-3.01", r"php\.net/license/3_01"),
)

#: Identifiers that a tag may name, the longer before those that begin alike.
TAGS: tuple[str, ...] = tuple(
    "AGPL-3.0-or-later AGPL-3.0-only AGPL-3.0 AGPL-1.0 LGPL-3.0-or-later LGPL-3.0-only LGPL-3.0 LGPL-2.1-or-later LGPL-2.1-only LGPL-2.1 LGPL-2.0 GPL-3.0-or-later GPL-3.0-only GPL-3.0 GPL-2.0-or-later GPL-2.0-only GPL-2.0 GPL-1.0 GFDL-1.3 GFDL-1.2 "
    "Apache-2.0 Apache-1.1 Apache-1.0 MIT-0 MIT BSD-4-Clause BSD-3-Clause-Clear BSD-3-Clause BSD-2-Clause-Patent BSD-2-Clause BSD-1-Clause 0BSD ISC MPL-2.0 MPL-1.1 MPL-1.0 EPL-2.0 EPL-1.0 CDDL-1.1 CDDL-1.0 CPL-1.0 IPL-1.0 EUPL-1.2 EUPL-1.1 "
    "CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC-BY-SA-3.0 CC-BY-4.0 CC-BY-3.0 CC0-1.0 Unlicense WTFPL Zlib Libpng BSL-1.0 BUSL-1.1 SSPL-1.0 Elastic-2.0 Artistic-2.0 Artistic-1.0 PSF-2.0 Python-2.0 PHP-3.01 PHP-3.0 Ruby Zend-2.0 "
    "OpenSSL PostgreSQL NCSA UPL-1.0 AFL-3.0 OSL-3.0 MS-PL MS-RL OFL-1.1 ODbL-1.0 ODC-By-1.0 PDDL-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 OGL-UK-3.0 CECILL-2.1 CECILL-B CECILL-C LPPL-1.3c QPL-1.0 Sleepycat APSL-2.0 SISSL RPL-1.5 CPAL-1.0 Vim ICU curl FTL IJG "
    "ImageMagick JSON Beerware BlueOak-1.0.0 MulanPSL-2.0 ECL-2.0 HPND Intel".split()
)

_UNDER = r"\b(?:(?:dual-)?licen[sc]ed|released|distributed|published|provided|(?:made )?available|covered|redistributed)(?: for use)? (?:under|by|according to|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? "


def _rules() -> tuple[tuple[str, str, str], ...]:
    """(rule, licence, expression) in order."""
    out = []
    seen: dict[str, int] = {}

    def add(kind: str, licence: str, expression: str) -> None:
        name = f"{kind}:{licence}"
        seen[name] = seen.get(name, 0) + 1
        out.append((name if seen[name] == 1 else f"{name}#{seen[name]}", licence, expression))

    for licence, e in TEXTS[:-1]:
        add("text", licence, e)
    for licence in TAGS:
        add("tag", licence, r"SPDX-License-Identifier: ?" + licence.replace(".", r"\.") + r"\b")
    for licence, e in NAMES:
        add("notice", licence, _UNDER + e)
    for licence, e in ADDRESSES:
        add("address", licence, e)
    for licence, e in NAMES:
        add("name", licence, e if e.startswith(r"\b") else r"\b" + e)
    add("text", *TEXTS[-1])
    return tuple((n, x, _spaced(e)) for n, x, e in out)


def _spaced(expression: str) -> str:
    """With GAP for the spaces that are not within a class; an optional space becomes an optional gap."""
    out, inside = [], False
    for k, c in enumerate(expression):
        if c == "[" and expression[k - 1 : k] != "\\":
            inside = True
        elif c == "]":
            inside = False
        out.append("(?:" + GAP + ")" if c == " " and not inside else c)
    return "".join(out)


RULES: tuple[tuple[str, str, str], ...] = _rules()


def keywords(expression: str) -> list[tuple[str, ...]]:
    """What every match of the expression contains, in lower case: of each tuple one literal. The longest first."""
    found: list[tuple[str, ...]] = []

    def longest(items) -> str:
        """The longest literal that these items must have, going down one way only."""
        best = run = ""
        for kind, value in items:
            if kind is parser.LITERAL and value < 128:
                run += chr(value).lower()
            elif kind is parser.SUBPATTERN:
                run = max(run, longest(value[3]), key=len)
                best, run = max(best, run, key=len), ""
            elif kind is not parser.AT:
                best, run = max(best, run, key=len), ""
        return max(best, run, key=len)

    runs = [""]

    def walk(items) -> None:
        for kind, value in items:
            if kind is parser.LITERAL and value < 128:
                runs[-1] += chr(value).lower()
                continue
            if kind is parser.SUBPATTERN:
                walk(value[3])
            elif kind is parser.BRANCH:
                each = {longest(x) for x in value[1]}
                if min(map(len, each)) > 1:
                    found.append(tuple(sorted(each)))
            if kind is not parser.AT and kind is not parser.SUBPATTERN:
                runs.append("")

    walk(parser.parse(expression, re.I | re.A))
    found += [(r,) for r in runs if len(r) > 2]
    return sorted(set(found), key=lambda c: (-min(map(len, c)), len(c), c))


class Scanner:
    """Compiled rules and their keywords in one automaton."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        import ahocorasick

        self.rules = rules
        self.expressions = [re.compile(e, re.I | re.A) for _, _, e in rules]
        needs = [keywords(e) for _, _, e in rules]
        self.needs = [len(own) for own in needs]
        gate: dict[str, list[tuple[int, int]]] = {}
        for k, own in enumerate(needs):
            for c, clause in enumerate(own):
                for word in clause:
                    gate.setdefault(word, []).append((k, c))
        self.gate = ahocorasick.Automaton()
        for word, own in gate.items():
            self.gate.add_word(word, (word, own))
        self.gate.make_automaton()
        self.gated = bool(gate)
        self.always = [k for k, n in enumerate(self.needs) if not n]

    def raw(self, text: str) -> list[tuple[int, int, int]]:
        """All matches (start, end, rule) of the rules whose keywords the text holds."""
        run = list(self.always)
        if self.gated:
            met = {word: own for _, (word, own) in self.gate.iter(text.lower())}
            have: dict[int, set[int]] = {}
            for own in met.values():
                for k, c in own:
                    have.setdefault(k, set()).add(c)
            run += [k for k, clauses in have.items() if len(clauses) == self.needs[k]]
        return [(m.start(), m.end(), k) for k in sorted(run) for m in self.expressions[k].finditer(text) if m.end() > m.start()]

    def detect(self, text: str) -> list[tuple[int, int, int]]:
        return resolve(self.raw(text))


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections (start, end, rule) that no longer one contains, nor an equal one of an earlier rule; of those that overlap the earlier rule's, then the earlier ones. By place."""
    left: list[tuple[int, int, int]] = []
    reach = -1
    for s, e, k in sorted(set(found), key=lambda d: (d[0], -d[1], d[2])):
        if e > reach:  # else one that begins no later reaches as far
            left.append((s, e, k))
            reach = e
    kept: list[tuple[int, int, int]] = []
    for d in sorted(left, key=lambda d: (d[2], d[0])):
        if all(d[0] >= e or d[1] <= s for s, e, _ in kept):
            kept.append(d)
    return sorted(kept)


@lru_cache(4)
def scanner(rules: tuple[tuple[str, str, str], ...] = RULES) -> Scanner:
    return Scanner(rules)


def _scan(rules: tuple[tuple[str, str, str], ...]):
    def fn(part: pa.RecordBatch) -> pa.RecordBatch | None:
        own = scanner(rules)
        rows, doc = [], []
        for i, text in enumerate(part.column(1).to_pylist()):
            for s, e, k in own.detect(text):
                doc.append(i)
                rows.append((own.rules[k][1], own.rules[k][0], s, e))
        if not rows:
            return None
        licence, rule, start, end = zip(*rows)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.array(doc))), pa.array(licence), pa.array(rule), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "license", "rule", "start_at", "end_at"])

    return arrow_map(fn)


def scan(docs: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row (doc_id, license, rule, start_at, end_at) for every detection that remains; places are in characters, from 0.

    Within a rule matches don't overlap, and are found from left to right. A detection within
    a longer one goes; of equal ones the earlier rule's stays; of others that overlap the
    earlier rule's stays, and where a detection has gone so, it no longer stands against
    others. A doc_id may be null; null and empty texts have none; repeated rows are scanned
    each by itself; texts are scanned whole, however long; other columns are ignored. An
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(_scan(rules), "doc_id bigint, license string, rule string, start_at bigint, end_at bigint")


def _sql() -> str:
    def one(k: int, rule: tuple[str, str, str]) -> str:
        name, licence, e = rule
        gate = " OR ".join("contains(low, '{}')".format(w.replace("'", "''")) for w in keywords(e)[0])
        e = "(?i)" + e.replace("'", "''")
        return f"SELECT row, {k} AS k, '{name}' AS rule, '{licence}' AS license, regexp_extract_all(text, '{e}') AS m, string_split_regex(text, '{e}') AS gaps FROM docs WHERE {gate}"

    each = "\n  UNION ALL ".join(one(k, r) for k, r in enumerate(RULES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL),
matched AS (
  {each}),
spans AS (
  SELECT row, k, rule, license, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matched)),
places AS (SELECT row, k, rule, license, s, s + n AS e FROM spans),
apart AS (
  SELECT * FROM places a WHERE NOT EXISTS (
    SELECT 1 FROM places b WHERE b.row = a.row AND b.s <= a.s AND b.e >= a.e AND (b.e - b.s > a.e - a.s OR b.k < a.k))),
folded AS (
  SELECT row, list_reduce(
    list([{{'s': s, 'e': e, 'rule': rule, 'license': license}}] ORDER BY k, s),
    lambda kept, d: CASE WHEN len(list_filter(kept, lambda x: x.s < d[1].e AND d[1].s < x.e)) > 0 THEN kept ELSE list_concat(kept, d) END) AS kept
  FROM apart GROUP BY row)
SELECT doc_id, d.license AS license, d.rule AS rule, CAST(d.s AS BIGINT) AS start_at, CAST(d.e AS BIGINT) AS end_at
FROM (SELECT row, unnest(kept) AS d FROM folded) JOIN docs USING (row)
"""


SQL = _sql()
