"""License scans: ordered signature rules over word strings, native throughout.

A document passes a keyword prefilter (plain substring tests) before any rule is tried; each rule
then has a keyword of its own before its regex runs. Both are tested on the same words as the rules
and are part of all that a rule can match, so they lose nothing. A rule's matches are intervals of words. A
detection inside the interval of one with equal or better priority is suppressed, so "GNU Lesser
General Public License" doesn't also report the shorter title inside it. The four base phrases are
rules too; their places are counted and their labels always stay.

Everything happens within the row by higher-order functions, in time linear in the text: no
shuffle, no Python. Defined cases: null text is empty (0 words, no labels, score 0); rows with null
or repeated doc_id are each returned; texts of any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and labels of the base.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: One of these is in all words that any rule can match.
ANCHORS = ("licen", "copyright", "cc", "public domain", "permission", "warrant", "spdx", "gpl", "redistribution", "creative", "all rights", "released under", "distributed under", "available under", "mit no attribution", "zero clause", "openrail")

#: Hand-written signatures: label, priority (lower wins), weight, keyword, regex over words parted by one space.
SIGNATURES = (
    ("gpl-1.0", 20, 0.9, "general", "gnu general public license(?: as published by the free software foundation)? (?:version |v)?1(?: 0)?"),
    ("gpl-2.0", 20, 0.95, "general", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?2(?: 0)?(?: of the license)?"),
    ("gpl-2.0-or-later", 10, 0.95, "general", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?2(?: 0)?(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-3.0", 20, 0.95, "general", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?3(?: 0)?(?: of the license)?"),
    ("gpl-3.0-or-later", 10, 0.95, "general", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?3(?: 0)?(?: of the license)? or (?:at your option )?any later version"),
    ("gpl", 60, 0.5, "gpl", "(?:under|of) the gpl"),
    ("gpl-2.0", 40, 0.8, "gpl", "gpl ?v? ?2(?: 0)?(?: only)?"),
    ("gpl-3.0", 40, 0.8, "gpl", "gpl ?v? ?3(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", 30, 0.85, "gpl", "gpl ?v? ?2(?: 0)? or later"),
    ("gpl-3.0-or-later", 30, 0.85, "gpl", "gpl ?v? ?3(?: 0)? or later"),
    ("gpl", 50, 0.6, "gnu.org", "gnu org licenses gpl(?: html| txt)?"),
    ("lgpl", 30, 0.9, "lesser", "gnu lesser general public license"),
    ("lgpl", 30, 0.9, "library", "gnu library general public license"),
    ("lgpl-2.0", 20, 0.95, "library", "gnu library general public license (?:version |v)?2(?: 0)?"),
    ("lgpl-2.1", 20, 0.95, "lesser", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?2 1(?: of the license)?"),
    ("lgpl-2.1-or-later", 10, 0.95, "lesser", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?2 1(?: of the license)? or (?:at your option )?any later version"),
    ("lgpl-3.0", 20, 0.95, "lesser", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?3(?: 0)?(?: of the license)?"),
    ("lgpl", 50, 0.6, "lgpl", "(?:under|of) the lgpl"),
    ("lgpl-2.1", 40, 0.8, "lgpl", "lgpl ?v? ?2 1"),
    ("lgpl-3.0", 40, 0.8, "lgpl", "lgpl ?v? ?3(?: 0)?"),
    ("agpl", 30, 0.9, "affero", "gnu affero general public license"),
    ("agpl-3.0", 20, 0.95, "affero", "gnu affero general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?3(?: 0)?(?: of the license)?"),
    ("agpl-3.0", 40, 0.8, "agpl", "agpl ?v? ?3(?: 0)?"),
    ("agpl", 50, 0.6, "agpl", "(?:under|of) the agpl"),
    ("gfdl", 30, 0.9, "documentation", "gnu free documentation license"),
    ("gfdl-1.3", 20, 0.95, "documentation", "gnu free documentation license (?:version |v)?1 3"),
    ("gfdl-1.2", 20, 0.95, "documentation", "gnu free documentation license (?:version |v)?1 2"),
    ("apache-1.1", 20, 0.95, "apache", "apache (?:software )?license (?:version |v)?1 1"),
    ("apache-2.0", 20, 0.95, "apache", "apache (?:software )?license (?:version |v)?2(?: 0)?(?: january 2004)?"),
    ("apache-2.0", 40, 0.85, "apache", "licensed under apache 2(?: 0)?"),
    ("apache", 50, 0.6, "apache", "apache software license"),
    ("apache-2.0", 40, 0.8, "apache.org", "apache org licenses license 2 0(?: txt| html)?"),
    ("mit", 30, 0.9, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 40, 0.85, "mit", "(?:released|distributed|licensed|available) under (?:the )?(?:terms of the )?mit(?: license)?"),
    ("mit-0", 20, 0.9, "mit", "mit no attribution(?: license)?"),
    ("mit", 40, 0.8, "opensource.org", "opensource org licenses mit(?: license)?(?: php)?"),
    ("x11", 30, 0.85, "x11", "x11 license"),
    ("expat", 30, 0.85, "expat", "expat license"),
    ("isc", 30, 0.9, "isc", "isc license"),
    ("isc", 30, 0.9, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", 40, 0.8, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("0bsd", 20, 0.9, "bsd", "(?:bsd zero clause|zero clause bsd)(?: license)?"),
    ("bsd", 50, 0.6, "bsd", "bsd(?: style)? license"),
    ("bsd-2-clause", 20, 0.9, "bsd", "(?:2|two) clause bsd license"),
    ("bsd-2-clause", 20, 0.9, "license", "(?:simplified|freebsd) (?:bsd )?license"),
    ("bsd-3-clause", 20, 0.9, "bsd", "(?:3|three) clause bsd license"),
    ("bsd-3-clause", 20, 0.9, "bsd", "(?:new|revised|modified) bsd license"),
    ("bsd-4-clause", 20, 0.9, "bsd", "(?:original|old|4 clause|four clause) bsd license"),
    ("bsd", 40, 0.8, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 30, 0.85, "redistribution", "redistribution and use in source and binary forms .{0,900}neither the name of"),
    ("mpl-1.1", 20, 0.95, "mozilla", "mozilla public license (?:version |v)?1 1"),
    ("mpl-2.0", 20, 0.95, "mozilla", "mozilla public license (?:version |v)?2(?: 0)?"),
    ("mpl", 50, 0.7, "mozilla", "mozilla public license"),
    ("epl-1.0", 20, 0.95, "eclipse", "eclipse public license (?:version |v)?1(?: 0)?"),
    ("epl-2.0", 20, 0.95, "eclipse", "eclipse public license (?:version |v)?2(?: 0)?"),
    ("epl", 50, 0.7, "eclipse", "eclipse public license"),
    ("cddl-1.0", 20, 0.95, "common development", "common development and distribution license (?:version |v)?1(?: 0)?"),
    ("cddl", 50, 0.7, "common development", "common development and distribution license"),
    ("cpl-1.0", 40, 0.8, "common public", "common public license(?: version 1 0)?"),
    ("eupl", 50, 0.7, "european union", "european union public licence"),
    ("eupl-1.2", 20, 0.95, "european union", "european union public licence (?:version |v)?1 2"),
    ("osl-3.0", 20, 0.9, "open software", "open software license (?:version |v)?3(?: 0)?"),
    ("afl-3.0", 20, 0.9, "academic", "academic free license (?:version |v)?3(?: 0)?"),
    ("artistic-2.0", 20, 0.9, "artistic", "artistic license (?:version |v)?2(?: 0)?"),
    ("artistic", 50, 0.7, "artistic", "artistic license"),
    ("zlib", 40, 0.8, "zlib", "zlib(?: libpng)? license"),
    ("bsl-1.0", 20, 0.95, "boost", "boost software license(?: version 1 0)?"),
    ("python-2.0", 30, 0.8, "python", "python software foundation license(?: version 2)?"),
    ("ruby", 50, 0.7, "ruby", "ruby license"),
    ("php-3.01", 30, 0.8, "php", "php license (?:version |v)?3(?: 01)?"),
    ("wtfpl", 30, 0.9, "do what the", "do what the \\S+ you want to public license"),
    ("unlicense", 30, 0.9, "unlicense", "(?:the )?unlicense"),
    ("unlicense", 30, 0.9, "public domain", "free and unencumbered software released into the public domain"),
    ("public-domain", 50, 0.7, "public domain", "(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain"),
    ("cc0-1.0", 20, 0.9, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", 20, 0.95, "creative", "creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?"),
    ("cc", 60, 0.5, "creative", "creative commons(?: licen[cs]e)?"),
    ("ccl", 60, 0.5, "creative", "creativecommons org licenses"),
    ("ofl-1.1", 20, 0.95, "sil open", "sil open font license(?: version 1 1)?"),
    ("odbl-1.0", 30, 0.9, "database license", "open (?:data commons )?database license"),
    ("odc-by-1.0", 30, 0.9, "open data", "open data commons attribution license"),
    ("pddl-1.0", 30, 0.9, "public domain", "public domain dedication and license"),
    ("ncsa", 30, 0.85, "illinois", "university of illinois ncsa open source license"),
    ("postgresql", 30, 0.85, "postgresql", "postgresql licen[cs]e"),
    ("openssl", 30, 0.85, "openssl", "openssl license"),
    ("ms-pl", 30, 0.85, "microsoft", "microsoft public license"),
    ("ms-rl", 30, 0.85, "microsoft", "microsoft reciprocal license"),
    ("busl-1.1", 30, 0.85, "business source", "business source license(?: 1 1)?"),
    ("sspl-1.0", 30, 0.85, "server side", "server side public license(?: version 1)?"),
    ("elastic-2.0", 30, 0.85, "elastic", "elastic license(?: 2 0)?"),
    ("polyform", 40, 0.8, "polyform", "polyform \\S+ license"),
    ("openrail", 40, 0.8, "openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: license)?"),
    ("upl-1.0", 30, 0.85, "universal permissive", "universal permissive license"),
    ("afl-1.1", 20, 0.9, "academic", "academic free license (?:version |v)?1 1"),
    ("afl-1.2", 20, 0.9, "academic", "academic free license (?:version |v)?1 2"),
    ("afl-2.0", 20, 0.9, "academic", "academic free license (?:version |v)?2 0"),
    ("afl-2.1", 20, 0.9, "academic", "academic free license (?:version |v)?2 1"),
    ("afl", 50, 0.7, "academic", "academic free license"),
    ("aal", 30, 0.85, "attribution assurance", "attribution assurance license"),
    ("adsl", 30, 0.85, "amazon digital", "amazon digital services license"),
    ("afmparse", 30, 0.8, "afmparse", "afmparse license"),
    ("aladdin", 30, 0.85, "aladdin", "aladdin free public license"),
    ("aml", 30, 0.85, "apple mit", "apple mit license"),
    ("anti-996", 40, 0.8, "996", "anti 996 license"),
    ("apl-1.0", 30, 0.85, "adaptive", "adaptive public license"),
    ("apsl-1.0", 20, 0.95, "apple public", "apple public source license (?:version |v)?1 0"),
    ("apsl-1.2", 20, 0.95, "apple public", "apple public source license (?:version |v)?1 2"),
    ("apsl-2.0", 20, 0.95, "apple public", "apple public source license (?:version |v)?2(?: 0)?"),
    ("apsl", 50, 0.7, "apple public", "apple public source license"),
    ("artistic-1.0", 20, 0.9, "artistic", "artistic license (?:version |v)?1(?: 0)?"),
    ("clartistic", 30, 0.85, "clarified", "clarified artistic license"),
    ("beerware", 30, 0.85, "beer", "beer ?ware license"),
    ("bittorrent-1.1", 30, 0.85, "bittorrent", "bittorrent open source license(?: version 1 1)?"),
    ("blueoak-1.0.0", 30, 0.85, "blue oak", "blue oak model license(?: (?:version )?1 0 0)?"),
    ("bsd-1-clause", 20, 0.9, "bsd", "(?:1|one) clause bsd license"),
    ("bsd-2-clause-patent", 20, 0.9, "bsd", "bsd 2 clause plus patent license"),
    ("bsd-3-clause-clear", 20, 0.9, "bsd", "(?:bsd 3 clause clear|clear bsd) license"),
    ("bsd-3-clause", 25, 0.85, "neither the name", "neither the name of .{1,120} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-protection", 30, 0.85, "bsd protection", "bsd protection license"),
    ("busl-1.1", 45, 0.7, "change license", "change date .{1,40} change license"),
    ("cal-1.0", 30, 0.85, "cryptographic", "cryptographic autonomy license"),
    ("catosl-1.1", 30, 0.85, "trusted open", "computer associates trusted open source license(?: version 1 1)?"),
    ("cdla-permissive-1.0", 20, 0.9, "community data", "community data license agreement permissive(?: version 1 0)?"),
    ("cdla-permissive-2.0", 10, 0.95, "community data", "community data license agreement permissive version 2 0"),
    ("cdla-sharing-1.0", 20, 0.9, "community data", "community data license agreement sharing(?: version 1 0)?"),
    ("cecill-2.0", 20, 0.9, "cecill", "cecill (?:free software )?license(?: agreement)? (?:version |v)?2 0"),
    ("cecill-2.1", 20, 0.9, "cecill", "cecill (?:free software )?license(?: agreement)? (?:version |v)?2 1"),
    ("cecill-b", 20, 0.9, "cecill", "cecill b (?:free software )?license"),
    ("cecill-c", 20, 0.9, "cecill", "cecill c (?:free software )?license"),
    ("cecill", 50, 0.7, "cecill", "cecill (?:free software )?license"),
    ("cern-ohl-1.2", 20, 0.9, "cern open", "cern open hardware licen[cs]e (?:version |v)?1 2"),
    ("cern-ohl-p-2.0", 20, 0.9, "cern open", "cern open hardware licen[cs]e version 2 permissive"),
    ("cern-ohl-s-2.0", 20, 0.9, "cern open", "cern open hardware licen[cs]e version 2 strongly reciprocal"),
    ("cern-ohl-w-2.0", 20, 0.9, "cern open", "cern open hardware licen[cs]e version 2 weakly reciprocal"),
    ("cern-ohl", 50, 0.7, "cern open", "cern open hardware licen[cs]e"),
    ("cnri-python", 30, 0.85, "cnri", "cnri (?:open source )?(?:python )?license"),
    ("commons-clause", 30, 0.85, "commons clause", "commons clause license condition"),
    ("condor-1.1", 30, 0.85, "condor", "condor public license"),
    ("confluent-community-1.0", 30, 0.85, "confluent", "confluent community license"),
    ("cpal-1.0", 30, 0.85, "public attribution", "common public attribution license"),
    ("cua-opl-1.0", 30, 0.85, "cua office", "cua office public license"),
    ("curl", 30, 0.8, "curl", "curl license"),
    ("d-fsl-1.0", 30, 0.85, "free software", "(?:german|deutsche) free software license"),
    ("dbcl-1.0", 30, 0.85, "contents license", "database contents license"),
    ("dsl", 40, 0.8, "design science", "design science license"),
    ("ecl-1.0", 20, 0.9, "educational", "educational community license (?:version |v)?1(?: 0)?"),
    ("ecl-2.0", 20, 0.9, "educational", "educational community license (?:version |v)?2(?: 0)?"),
    ("ecl", 50, 0.7, "educational", "educational community license"),
    ("efl-1.0", 20, 0.9, "eiffel", "eiffel forum license (?:version |v)?1(?: 0)?"),
    ("efl-2.0", 20, 0.9, "eiffel", "eiffel forum license (?:version |v)?2(?: 0)?"),
    ("entessa", 30, 0.85, "entessa", "entessa public license"),
    ("epl-1.0", 45, 0.7, "eclipse", "made available under the terms of the eclipse public license"),
    ("erlpl-1.1", 30, 0.85, "erlang", "erlang public license"),
    ("etalab-2.0", 30, 0.85, "etalab", "etalab open licen[cs]e"),
    ("eudatagrid", 30, 0.85, "datagrid", "eu datagrid software license"),
    ("eupl-1.1", 20, 0.95, "european union", "european union public licence (?:version |v)?1 1"),
    ("fair", 40, 0.6, "fair license", "fair license"),
    ("fair-source", 30, 0.8, "fair source", "fair source license"),
    ("fal-1.3", 30, 0.85, "art", "(?:free art license|licence art libre)"),
    ("frameworx-1.0", 30, 0.85, "frameworx", "frameworx open license"),
    ("fsfap", 30, 0.85, "copying and", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice"),
    ("fsl", 30, 0.8, "functional source", "functional source license"),
    ("ftl", 30, 0.85, "freetype", "freetype (?:project )?license"),
    ("gl2ps", 30, 0.85, "gl2ps", "gl2ps license"),
    ("glwtpl", 30, 0.85, "good luck", "good luck with that public license"),
    ("gpl", 45, 0.7, "redistribute it", "(?:free software )?you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 55, 0.6, "should have received", "you should have received a copy of the gnu general public license"),
    ("lgpl", 25, 0.85, "redistribute it", "(?:free software )?you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", 25, 0.8, "should have received", "you should have received a copy of the gnu lesser general public license"),
    ("agpl", 25, 0.8, "should have received", "you should have received a copy of the gnu affero general public license"),
    ("gpl-with-classpath-exception", 20, 0.9, "exception", "gnu general public license .{0,80}classpath exception"),
    ("gpl-with-gcc-exception", 20, 0.9, "exception", "gcc runtime library exception .{0,120}general public license"),
    ("gust-font", 30, 0.85, "gust font", "gust font (?:source |nosource )?license"),
    ("hippocratic-2.1", 30, 0.85, "hippocratic", "hippocratic license(?: (?:version )?2 1)?"),
    ("ibm-pl-1.0", 30, 0.85, "ibm", "ibm public license(?: version 1 0)?"),
    ("icu", 30, 0.8, "icu", "icu license"),
    ("ijg", 30, 0.85, "jpeg", "independent jpeg group license"),
    ("imagemagick", 30, 0.85, "imagemagick", "imagemagick license"),
    ("intel", 30, 0.8, "intel", "intel open source license"),
    ("interbase-1.0", 30, 0.85, "interbase", "interbase public license"),
    ("ipa", 30, 0.85, "ipa font", "ipa font license"),
    ("jasper-2.0", 30, 0.8, "jasper", "jasper license(?: version 2 0)?"),
    ("json", 30, 0.85, "json", "json license"),
    ("leptonica", 30, 0.8, "leptonica", "leptonica license"),
    ("libpng", 30, 0.8, "png", "(?:libpng|png reference library) license(?: version 2)?"),
    ("libtiff", 30, 0.8, "libtiff", "libtiff license"),
    ("liliq", 40, 0.8, "libre du", "licence libre du qu[eé]bec"),
    ("linux-man-pages", 40, 0.8, "verbatim copies", "permission is granted to make and distribute verbatim copies of this manual"),
    ("llama-2", 30, 0.85, "llama", "llama 2 community license"),
    ("llama-3", 30, 0.85, "llama", "(?:meta )?llama 3(?: [123])? community license"),
    ("lpl-1.02", 20, 0.9, "lucent", "lucent public license (?:version |v)?1 02"),
    ("lpl-1.0", 30, 0.85, "lucent", "lucent public license"),
    ("lppl-1.2", 20, 0.9, "latex project", "latex project public license (?:version |v)?1 2"),
    ("lppl-1.3c", 20, 0.9, "latex project", "latex project public license (?:version |v)?1 3c?"),
    ("lppl", 50, 0.7, "latex project", "latex project public license"),
    ("miros", 30, 0.85, "miros", "miros licen[cs]e"),
    ("mit", 45, 0.7, "above copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 45, 0.7, "deal in", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit-modern-variant", 35, 0.8, "royalty fees", "permission is hereby granted without written agreement and without license or royalty fees"),
    ("motosoto", 30, 0.85, "motosoto", "motosoto open source license"),
    ("mpl-1.0", 20, 0.95, "mozilla", "mozilla public license (?:version |v)?1 0"),
    ("mpl-2.0", 15, 0.95, "source code form", "this source code form is subject to the terms of the mozilla public license (?:version |v)?2 0"),
    ("mpl", 45, 0.7, "contents of this", "the contents of this file are subject to the mozilla public license"),
    ("ms-lpl", 30, 0.85, "microsoft", "microsoft limited public license"),
    ("ms-rsl", 30, 0.85, "microsoft", "microsoft reference source license"),
    ("mulanpsl-1.0", 20, 0.9, "mulan", "mulan (?:permissive software|psl) license (?:version |v)?1(?: 0)?"),
    ("mulanpsl-2.0", 20, 0.9, "mulan", "mulan (?:permissive software|psl) license (?:version |v)?2(?: 0)?"),
    ("multics", 30, 0.8, "multics", "multics license"),
    ("nasa-1.3", 30, 0.85, "nasa", "nasa open source (?:software )?license(?: version 1 3)?"),
    ("naumen", 30, 0.85, "naumen", "naumen public license"),
    ("ngpl", 30, 0.85, "nethack", "nethack general public license"),
    ("nlod-1.0", 30, 0.85, "norwegian", "norwegian licen[cs]e for open government data"),
    ("nokia", 30, 0.85, "nokia", "nokia open source license"),
    ("nosl-1.0", 30, 0.85, "netizen", "netizen open source license"),
    ("npl-1.0", 20, 0.9, "netscape", "netscape public license (?:version |v)?1 0"),
    ("npl-1.1", 20, 0.9, "netscape", "netscape public license (?:version |v)?1 1"),
    ("nposl-3.0", 20, 0.9, "non profit", "non profit open software license(?: (?:version )?3 0)?"),
    ("ntp", 30, 0.8, "ntp", "ntp license"),
    ("oclc-2.0", 30, 0.85, "oclc", "oclc research public license"),
    ("odbl-1.0", 25, 0.9, "open database", "open database license(?: (?:version |v)?1 0)?"),
    ("ofl-1.0", 20, 0.95, "sil open", "sil open font license (?:version |v)?1 0"),
    ("ogc-1.0", 30, 0.8, "ogc", "ogc software license"),
    ("ogl-uk-1.0", 20, 0.9, "open government", "open government licen[cs]e (?:version |v)?1 0"),
    ("ogl-uk-2.0", 20, 0.9, "open government", "open government licen[cs]e (?:version |v)?2 0"),
    ("ogl-uk-3.0", 20, 0.9, "open government", "open government licen[cs]e (?:version |v)?3 0"),
    ("ogl", 50, 0.7, "open government", "open government licen[cs]e"),
    ("ogtsl", 30, 0.85, "test suite", "open group test suite license"),
    ("oldap-2.8", 20, 0.9, "openldap", "openldap public license (?:version |v)?2 8"),
    ("oldap", 50, 0.7, "openldap", "openldap public license"),
    ("opl-1.0", 40, 0.8, "open publication", "open publication license"),
    ("osl-1.0", 20, 0.9, "open software", "open software license (?:version |v)?1 0"),
    ("osl-2.0", 20, 0.9, "open software", "open software license (?:version |v)?2 0"),
    ("osl-2.1", 20, 0.9, "open software", "open software license (?:version |v)?2 1"),
    ("osl", 50, 0.7, "open software", "open software license"),
    ("oset-pl-2.1", 30, 0.85, "oset", "oset public license"),
    ("parity-7.0.0", 30, 0.85, "parity", "parity public license"),
    ("peer-production", 40, 0.8, "peer production", "peer production license"),
    ("php-3.0", 20, 0.9, "php", "php license (?:version |v)?3 0"),
    ("polyform-noncommercial-1.0.0", 30, 0.85, "polyform", "polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-small-business-1.0.0", 30, 0.85, "polyform", "polyform small business license(?: 1 0 0)?"),
    ("prosperity-3.0.0", 30, 0.85, "prosperity", "prosperity public license"),
    ("python-2.0", 30, 0.8, "psf license", "psf license agreement"),
    ("qpl-1.0", 30, 0.8, "q public", "q public license(?: version 1 0)?"),
    ("rail", 40, 0.8, "responsible ai", "responsible ai licen[cs]e"),
    ("rpl-1.1", 20, 0.9, "reciprocal public", "reciprocal public license (?:version |v)?1 1"),
    ("rpl-1.5", 20, 0.9, "reciprocal public", "reciprocal public license (?:version |v)?1 5"),
    ("rpsl-1.0", 30, 0.85, "realnetworks", "realnetworks public source license"),
    ("rscpl", 30, 0.85, "ricoh", "ricoh source code public license"),
    ("rsal", 30, 0.85, "redis", "redis source available license"),
    ("scea", 30, 0.85, "scea", "scea shared source license"),
    ("sgi-b-2.0", 30, 0.85, "sgi", "sgi free software license b(?: version 2 0)?"),
    ("shl-0.51", 30, 0.85, "solderpad", "solderpad hardware licen[cs]e"),
    ("simpl-2.0", 30, 0.8, "simple public", "simple public license(?: 2 0)?"),
    ("sissl", 30, 0.85, "sun industry", "sun industry standards source license"),
    ("sleepycat", 30, 0.85, "sleepycat", "sleepycat (?:public |software )?license"),
    ("spl-1.0", 30, 0.85, "sun public", "sun public license(?: version 1 0)?"),
    ("sugarcrm-1.1.3", 30, 0.85, "sugarcrm", "sugarcrm public license"),
    ("sul-1.0", 30, 0.8, "sustainable use", "sustainable use license"),
    ("tapr-ohl-1.0", 30, 0.85, "tapr", "tapr open hardware license"),
    ("tcl", 30, 0.8, "tcl", "tcl(?: tk)? license"),
    ("tosl", 30, 0.85, "trusster", "trusster open source license"),
    ("unicode-dfs", 30, 0.85, "unicode", "unicode(?: inc)? license agreement data files and software"),
    ("unicode-3.0", 20, 0.9, "unicode", "unicode license (?:version |v)?3(?: 0)?"),
    ("vim", 30, 0.8, "vim", "vim license"),
    ("vsl-1.0", 30, 0.85, "vovida", "vovida software license"),
    ("w3c", 30, 0.85, "w3c", "w3c (?:software notice and|software and document|software) license"),
    ("watcom-1.0", 30, 0.85, "watcom", "(?:sybase )?open watcom public license"),
    ("wol", 40, 0.7, "wide open", "wide open license"),
    ("xfree86-1.1", 30, 0.85, "xfree86", "xfree86 license"),
    ("xnet", 30, 0.8, "x net", "x net license"),
    ("ypl-1.1", 30, 0.85, "yahoo", "yahoo public license"),
    ("zend-2.0", 30, 0.85, "zend", "zend (?:engine )?license"),
    ("zimbra-1.4", 30, 0.85, "zimbra", "zimbra public license"),
    ("zlib", 35, 0.8, "held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zpl-1.1", 20, 0.9, "zope", "zope public license (?:version |v)?1 1"),
    ("zpl-2.0", 20, 0.9, "zope", "zope public license (?:version |v)?2 0"),
    ("zpl-2.1", 20, 0.9, "zope", "zope public license (?:version |v)?2 1"),
    ("apache-2.0", 35, 0.8, "in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", 35, 0.8, "applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("cddl", 45, 0.7, "contents of this", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc0-1.0", 25, 0.9, "extent possible", "to the extent possible under law .{1,120} has waived all copyright and related or neighboring rights"),
    ("bsl-1.0", 25, 0.85, "boost", "distributed under the boost software license"),
    ("public-domain", 45, 0.7, "public domain", "(?:this (?:work|file|code|software)|the author) (?:has been|is hereby|hereby) (?:placed|dedicated|released|places it|releases it) (?:in|into|to) the public domain"),
    ("warranty-disclaimer", 80, 0.3, "as is", "provided as is without (?:express or implied )?warranty"),
    ("copyright-notice", 85, 0.3, "copyright", "copyright (?:c )?(?:by )?the \\S+ (?:authors|contributors|foundation|project)"),
    ("proprietary", 70, 0.4, "all rights", "all rights reserved"),
    ("copyright-notice", 80, 0.3, "copyright", "copyright(?: c)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?"),
    ("license-reference", 90, 0.2, "licen", "see (?:the )?(?:file )?licen[cs]e(?: file| txt| md)?(?: for (?:more )?details)?"),
    ("license-reference", 90, 0.2, "under the", "(?:licensed|released|distributed) under the(?: terms of the)?"),
    ("warranty-disclaimer", 80, 0.3, "warrant", "without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", 80, 0.3, "warrant", "without any warranty(?: without even the implied warranty of merchantability)?"),
)

#: Rights of Creative Commons licences, each combined with its versions.
CC_RIGHTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s(?: works)?", "nc": "non ?commercial"}
#: Identifiers of an SPDX line; the scan sees their parts as words.
SPDX = ("0bsd", "afl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apache-1.1", "apache-2.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "bsl-1.0", "cc0-1.0", "cddl-1.0", "cddl-1.1", "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "gfdl-1.3-only", "gpl-1.0-only", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "isc", "lgpl-2.0-only", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "lppl-1.3c", "mit", "mit-0", "mpl-1.1", "mpl-2.0", "ms-pl", "ms-rl", "ncsa", "odbl-1.0", "ofl-1.1", "osl-3.0", "php-3.01", "postgresql", "python-2.0", "ruby", "unlicense", "upl-1.0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl-2.1")


def rules() -> list[dict]:
    """All rules in order: base phrases, signatures, Creative Commons forms, SPDX lines."""
    found = [{"label": label, "priority": 100, "weight": 0.5, "keyword": phrase.split()[0], "regex": phrase, "base": True} for phrase, label in BASE]
    found += [{"label": a, "priority": p, "weight": w, "keyword": k.replace(".", " "), "regex": r, "base": False} for a, p, w, k, r in SIGNATURES]
    for rights in CC_RIGHTS:
        label = "cc-" + rights.replace(" ", "-")
        long = "(?:creative commons )?" + " ".join(CC_NAMES[x] for x in rights.split())
        found.append({"label": label, "priority": 40, "weight": 0.7, "keyword": "cc", "regex": f"cc {rights}", "base": False})
        found.append({"label": label, "priority": 40, "weight": 0.7, "keyword": "creative", "regex": "creative commons " + long.removeprefix("(?:creative commons )?"), "base": False})
        for v in CC_VERSIONS:
            one = f"{label}-{v.replace(' ', '.')}"
            found.append({"label": one, "priority": 20, "weight": 0.95, "keyword": "cc", "regex": f"cc {rights} (?:v|version )?{v}(?: (?:international|unported|generic|license|licence))*", "base": False})
            found.append({"label": one, "priority": 20, "weight": 0.95, "keyword": "creative", "regex": "creative commons " + long.removeprefix("(?:creative commons )?") + f" (?:licen[cs]e )?(?:v|version )?{v}(?: (?:international|unported|generic|license|licence))*", "base": False})
            found.append({"label": one, "priority": 20, "weight": 0.9, "keyword": "creativecommons", "regex": f"creativecommons org licenses {rights} {v}", "base": False})
    for x in SPDX:
        words = x.replace("-", " ").replace(".", " ")
        found.append({"label": x.removesuffix("-only"), "priority": 5, "weight": 1.0, "keyword": "spdx", "regex": f"spdx licen[cs]e identifier {words}", "base": False})
    return [r | {"order": i, "keyword": max(r["keyword"], _head(r["regex"]), key=len), "regex": f"(?<![^ ])(?:{r['regex']})(?![^ ])"} for i, r in enumerate(found)]


def _head(regex: str) -> str:
    """The plain words that a rule begins with, if any: whatever it matches has them, so they are a keyword too."""
    depth = 0
    for c in regex:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return ""
    head = re.match("[a-z0-9 ]*", regex)[0]
    return head[:-1] if regex[len(head) : len(head) + 1] in ("?", "*", "{") else head


#: What parts words; a single space, which most often does, is left as it is and so doesn't match.
APART = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
BREAK = f"[{APART}&&[^ ]][{APART}]*| [{APART}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_TYPE = "array<struct<label string, priority int, weight double, keyword string, regex string, base boolean, order int>>".replace(" string", ": string").replace(" int", ": int").replace(" double", ": double").replace(" boolean", ": boolean")
START, END = "\u0001", "\u0002"


def _marked(words: Column, rule: Column) -> Column:
    """The rule, and the words with marks around each of its matches."""
    return F.struct(rule.alias("rule"), F.regexp_replace(words, rule["regex"], F.lit(f"{START}$0{END}")).alias("words"))


def _spans(marked: Column) -> Column:
    """Intervals [first word, last word] where the rule matches: words with marks are found by index."""
    rule, words = marked["rule"], F.split(marked["words"], " ", -1)
    starts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(START)), i).otherwise(-1)), lambda i: i >= 0)
    ends = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(END)), i).otherwise(-1)), lambda i: i >= 0)
    return F.zip_with(
        starts, ends,
        lambda a, b: F.struct(a.alias("first"), (-b).alias("neg_last"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")),
    )


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words and ``found``, an array of the detections of each text, suppressed ones marked off.

    found: struct(first, last, label, priority, weight, base, stays), words counted from 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # Words stay one string: lists of them take most of the time, and their number is that of the spaces between them.
    df = docs.withColumn("_words", F.trim(F.regexp_replace(F.translate(body, UPPER, LOWER), BREAK, " ")))
    spaces = F.octet_length("_words") - F.octet_length(F.replace("_words", F.lit(" "), F.lit("")))
    df = df.withColumn("n_words", F.when(F.col("_words") == "", F.lit(0)).otherwise(spaces + 1).cast("long"))
    gate = F.lit(False)
    for a in ANCHORS:
        gate = gate | F.contains(F.col("_words"), F.lit(a))
    table = F.from_json(F.lit(json.dumps(rules())), RULE_TYPE)
    tried = F.transform(F.filter(table, lambda r: F.contains(F.col("_words"), r["keyword"])), lambda r: _marked(F.col("_words"), r))
    spans = F.flatten(F.transform(F.filter(tried, lambda x: F.contains(x["words"], F.lit(START))), _spans))
    df = df.withColumn("_spans", F.when(gate, F.array_sort(spans)))
    levels = sorted({r["priority"] for r in rules()})
    # For each priority, the furthest last word of the intervals seen so far with it or a better one: starts are in order, so that tells containment.
    begin = F.struct(F.transform(F.array(*[F.lit(p) for p in levels]), lambda p: F.lit(-1)).alias("far"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    level = lambda d: F.array_position(F.array(*[F.lit(p) for p in levels]), d["priority"]).cast("int") - 1

    def step(acc: Column, d: Column) -> Column:
        stays = F.get(acc["far"], level(d)) < -d["neg_last"]
        return F.struct(
            F.transform(acc["far"], lambda x, i: F.when(i >= level(d), F.greatest(x, -d["neg_last"])).otherwise(x)).alias("far"),
            F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(stays, F.greatest(acc["score"], d["weight"])).otherwise(acc["score"]).alias("score"),
        )

    return df.withColumn("_sum", F.aggregate(F.coalesce("_spans", F.array().cast(df.schema["_spans"].dataType)), begin, step)).drop("_words")


def license_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text)."""
    df = scan_licenses(docs.select("doc_id", "text"))
    df = df.withColumn("_base", F.filter(F.coalesce("_spans", F.array().cast(df.schema["_spans"].dataType)), lambda d: d["base"]))
    names = F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"])))
    return df.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["first"])).cast("long").alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.col("_sum.labels"))), ",").alias("labels"),
        F.greatest(F.col("_sum.score"), F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
