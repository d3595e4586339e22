"""Signature rules of the license scan, hand-written and in order of their class.

A pattern is matched on text in lower case, from word to word: a blank stands for any run of characters that are no
word characters (line breaks and comment signs included), so "apache license version 2 0" fits "Apache License,
Version 2.0". Every rule names the words that a text must hold before its pattern is tried.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    needs: tuple[str, ...]
    pattern: str
    level: int  # 0 is the strongest class


#: What a match of each class is worth as evidence, between 0 and 1.
LEVELS = ("notice", "tag", "link", "name", "family", "hint")
WORTH = (0.99, 0.98, 0.95, 0.9, 0.6, 0.2)

# (label, words that must occur, pattern)
NOTICES = (
    ("mit", "permission granted charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "provided warranty kind", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", "permission granted sell", r"permission is hereby granted free of charge( \w+){0,40} to use copy modify merge publish distribute sublicense and or sell copies of the software the software is provided"),
    ("isc", "permission purpose fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted( provided that the above copyright notice)?"),
    ("0bsd", "permission purpose fee disclaims", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims"),
    ("bsd", "redistribution binary", r"redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?"),
    ("bsd-3-clause", "neither endorse", r"neither the name of( the)?( \w+){1,12} (nor the names of its contributors )?may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "licensed apache except", r"licensed under the apache license version 2 0( the license)? you may not use this file except in compliance with the license"),
    ("apache-1.1", "product developed apache", r"this product includes software developed by the apache (software foundation|group)"),
    ("gpl-2.0-or-later", "redistribute gnu version", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute gnu version", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", "redistribute gnu version", r"you can redistribute it and or modify it under the terms of the gnu general public license version 2( only)? as published by the free software foundation"),
    ("gpl-3.0-only", "redistribute gnu version", r"you can redistribute it and or modify it under the terms of the gnu general public license version 3( only)? as published by the free software foundation"),
    ("lgpl-2.1-or-later", "modify lesser version", r"modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "modify lesser version", r"modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", "modify library version", r"modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "affero version option", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", "permission copy document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source mozilla subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents mozilla subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "program eclipse accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license (v )?2 0"),
    ("epl-1.0", "program eclipse accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "contents common distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "free unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what want public", r"do what the f\w* you want to public license"),
    ("zlib", "provided express damages", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("bsl-1.0", "permission organization software", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("postgresql", "permission documentation purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("hpnd", "permission documentation purpose", r"permission to use copy modify (and )?distribute (and sell )?this software and its documentation for any purpose is hereby granted( without fee)?"),
    ("ncsa", "associated files deal", r"obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("artistic-2.0", "everyone permitted copy", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("ofl-1.1", "font software open", r"this font software is licensed under the sil open font license version 1 1"),
    ("cc-by-4.0", "work licensed creative", r"this (work|article|document) is licensed under( the| a)? creative commons attribution 4 0 (international|unported)?( license)?"),
    ("cc-by-sa-4.0", "work licensed creative", r"this (work|article|document) is licensed under( the| a)? creative commons attribution share ?alike 4 0 (international|unported)?( license)?"),
    ("cc-by-sa-3.0", "text available creative", r"text is available under the creative commons attribution share ?alike( 3 0)? license"),
    ("cc0-1.0", "extent law waived", r"to the extent possible under law( \w+){1,20} (has|have) waived all copyright and related or neighboring rights"),
    ("public-domain", "hereby placed domain", r"(is |are )?hereby placed (in|into) the public domain"),
    ("proprietary", "unauthorized strictly prohibited", r"unauthorized (copying|use|reproduction|distribution)( \w+){0,20} is strictly prohibited"),
    ("proprietary", "proprietary confidential", r"(this (file|document|software) (is|contains) )?proprietary and confidential( information)?"),
)

# (label, pattern of the identifier behind "SPDX-License-Identifier:")
TAGS = (
    ("mit", r"mit"),
    ("mit-0", r"mit 0"),
    ("isc", r"isc"),
    ("0bsd", r"0bsd"),
    ("bsd-2-clause", r"bsd 2 clause"),
    ("bsd-3-clause", r"bsd 3 clause"),
    ("bsd-3-clause-clear", r"bsd 3 clause clear"),
    ("bsd-4-clause", r"bsd 4 clause"),
    ("apache-1.1", r"apache 1 1"),
    ("apache-2.0", r"apache 2 0"),
    ("gpl-1.0", r"gpl 1 0( only| or later)?"),
    ("gpl-2.0-only", r"gpl 2 0( only)?"),
    ("gpl-2.0-or-later", r"gpl 2 0 or later"),
    ("gpl-3.0-only", r"gpl 3 0( only)?"),
    ("gpl-3.0-or-later", r"gpl 3 0 or later"),
    ("lgpl-2.0", r"lgpl 2 0( only| or later)?"),
    ("lgpl-2.1-only", r"lgpl 2 1( only)?"),
    ("lgpl-2.1-or-later", r"lgpl 2 1 or later"),
    ("lgpl-3.0-only", r"lgpl 3 0( only)?"),
    ("lgpl-3.0-or-later", r"lgpl 3 0 or later"),
    ("agpl-3.0-only", r"agpl 3 0( only)?"),
    ("agpl-3.0-or-later", r"agpl 3 0 or later"),
    ("gfdl", r"gfdl 1 [123]( only| or later| invariants( only| or later)| no invariants( only| or later))?"),
    ("mpl-1.1", r"mpl 1 1"),
    ("mpl-2.0", r"mpl 2 0( no copyleft exception)?"),
    ("epl-1.0", r"epl 1 0"),
    ("epl-2.0", r"epl 2 0"),
    ("cddl-1.0", r"cddl 1 0"),
    ("cddl-1.1", r"cddl 1 1"),
    ("cpl-1.0", r"cpl 1 0"),
    ("eupl-1.1", r"eupl 1 1"),
    ("eupl-1.2", r"eupl 1 2"),
    ("osl-3.0", r"osl 3 0"),
    ("afl-3.0", r"afl 3 0"),
    ("artistic-1.0", r"artistic 1 0( perl| cl8)?"),
    ("artistic-2.0", r"artistic 2 0"),
    ("bsl-1.0", r"bsl 1 0"),
    ("busl-1.1", r"busl 1 1"),
    ("sspl-1.0", r"sspl 1 0"),
    ("elastic-2.0", r"elastic 2 0"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl"),
    ("zlib", r"zlib( acknowledgement)?"),
    ("libpng", r"libpng( 2 0)?"),
    ("ncsa", r"ncsa"),
    ("postgresql", r"postgresql"),
    ("python-2.0", r"python 2 0( 1)?"),
    ("psf-2.0", r"psf 2 0"),
    ("php-3.01", r"php 3 01"),
    ("ruby", r"ruby"),
    ("vim", r"vim"),
    ("curl", r"curl"),
    ("x11", r"x11"),
    ("openssl", r"openssl( standalone)?"),
    ("ofl-1.1", r"ofl 1 1( rfn| no rfn)?"),
    ("ms-pl", r"ms pl"),
    ("ms-rl", r"ms rl"),
    ("upl-1.0", r"upl 1 0"),
    ("ecl-2.0", r"ecl 2 0"),
    ("cecill-2.1", r"cecill 2 [01]"),
    ("odbl-1.0", r"odbl 1 0"),
    ("odc-by-1.0", r"odc by 1 0"),
    ("pddl-1.0", r"pddl 1 0"),
    ("cc0-1.0", r"cc0 1 0"),
    ("cc-by-3.0", r"cc by 3 0"),
    ("cc-by-4.0", r"cc by 4 0"),
    ("cc-by-sa-3.0", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", r"cc by sa 4 0"),
    ("cc-by-nc-4.0", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", r"cc by nc nd 4 0"),
)

LINKS = (
    ("apache-2.0", "apache org", r"(www )?apache org licenses license 2 0( txt| html)?"),
    ("apache-2.0", "opensource apache", r"opensource org licenses? apache 2 0"),
    ("mit", "opensource", r"opensource org licenses? mit( license)?( php)?"),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("isc", "opensource isc", r"opensource org licenses? isc"),
    ("gpl-2.0-only", "gnu licenses gpl", r"(www )?gnu org licenses (old licenses )?gpl 2 0( \w+)?"),
    ("gpl-3.0-only", "gnu licenses gpl", r"(www )?gnu org licenses gpl 3 0( \w+)?"),
    ("gpl", "gnu licenses gpl", r"(www )?gnu org (licenses|copyleft) gpl( html| txt)?"),
    ("lgpl-2.1-only", "gnu licenses lgpl", r"(www )?gnu org licenses (old licenses )?lgpl 2 1( \w+)?"),
    ("lgpl-3.0-only", "gnu licenses lgpl", r"(www )?gnu org licenses lgpl 3 0( \w+)?"),
    ("lgpl", "gnu licenses lgpl", r"(www )?gnu org (licenses|copyleft) (lgpl|lesser)( html| txt)?"),
    ("agpl-3.0-only", "gnu licenses agpl", r"(www )?gnu org licenses agpl( 3 0)?( \w+)?"),
    ("gfdl", "gnu licenses fdl", r"(www )?gnu org (licenses|copyleft) fdl( 1 \d)?( html| txt)?"),
    ("gpl", "gnu licenses", r"see http(s)? www gnu org licenses"),
    ("mpl-2.0", "mozilla mpl", r"(www )?mozilla org (en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla mpl", r"(www )?mozilla org mpl 1 1( html)?"),
    ("epl-2.0", "eclipse legal", r"(www )?eclipse org legal epl (v20|2 0)( html)?"),
    ("epl-1.0", "eclipse legal", r"(www )?eclipse org legal epl v10( html)?"),
    ("eupl-1.2", "europa eupl", r"(joinup )?ec europa eu( \w+){0,8} eupl( \w+){0,4}"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"(www )?wtfpl net"),
    ("bsl-1.0", "boost license", r"(www )?boost org license 1 0( txt)?"),
    ("ofl-1.1", "scripts sil ofl", r"scripts sil org ofl"),
    ("ofl-1.1", "openfontlicense", r"openfontlicense org"),
    ("artistic-2.0", "perlfoundation artistic", r"(www )?perlfoundation org artistic license 2 0"),
    ("elastic-2.0", "elastic licensing", r"(www )?elastic co licensing elastic license"),
    ("sspl-1.0", "mongodb licensing", r"(www )?mongodb com licensing server side public license"),
    ("busl-1.1", "mariadb bsl", r"(www )?mariadb com bsl11"),
    ("odbl-1.0", "opendatacommons odbl", r"opendatacommons org licenses odbl( 1 0)?"),
    ("odc-by-1.0", "opendatacommons by", r"opendatacommons org licenses by( 1 0)?"),
    ("pddl-1.0", "opendatacommons pddl", r"opendatacommons org licenses pddl( 1 0)?"),
    ("cc0-1.0", "creativecommons publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons publicdomain", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-1.0", "creativecommons licenses", r"creativecommons org licenses by 1 0( \w\w)?"),
    ("cc-by-2.0", "creativecommons licenses", r"creativecommons org licenses by 2 [05]( \w\w)?"),
    ("cc-by-3.0", "creativecommons licenses", r"creativecommons org licenses by 3 0( \w\w)?"),
    ("cc-by-4.0", "creativecommons licenses", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-2.0", "creativecommons licenses", r"creativecommons org licenses by sa 2 [05]( \w\w)?"),
    ("cc-by-sa-3.0", "creativecommons licenses", r"creativecommons org licenses by sa 3 0( \w\w)?"),
    ("cc-by-sa-4.0", "creativecommons licenses", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nd-3.0", "creativecommons licenses", r"creativecommons org licenses by nd 3 0( \w\w)?"),
    ("cc-by-nd-4.0", "creativecommons licenses", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-3.0", "creativecommons licenses", r"creativecommons org licenses by nc 3 0( \w\w)?"),
    ("cc-by-nc-4.0", "creativecommons licenses", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-3.0", "creativecommons licenses", r"creativecommons org licenses by nc sa 3 0( \w\w)?"),
    ("cc-by-nc-sa-4.0", "creativecommons licenses", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", "creativecommons licenses", r"creativecommons org licenses by nc nd 3 0( \w\w)?"),
    ("cc-by-nc-nd-4.0", "creativecommons licenses", r"creativecommons org licenses by nc nd 4 0"),
)

_UNDER = r"((is |are )?(licensed|released|available|distributed|published) under (the |a |an )?(terms of (the )?)?)?"
NAMES = (
    ("apache-1.0", "apache licen", r"apache( software)? licen[cs]e( version)? v?1 0"),
    ("apache-1.1", "apache licen", r"apache( software)? licen[cs]e( version)? v?1 1"),
    ("apache-2.0", "apache licen", r"apache( software)? licen[cs]e( version)? v?2( 0)?"),
    ("apache-2.0", "apache", r"apache v?2( 0)?( licen[cs]ed?)"),
    ("gpl-1.0", "general public licen", r"(gnu )?general public licen[cs]e( gpl)?( version)? v?1( 0)?"),
    ("gpl-2.0", "general public licen", r"(gnu )?general public licen[cs]e( gpl)?( version)? v?2( 0)?"),
    ("gpl-3.0", "general public licen", r"(gnu )?general public licen[cs]e( gpl)?( version)? v?3( 0)?"),
    ("gpl-2.0-or-later", "general public licen later", r"(gnu )?general public licen[cs]e( gpl)?( version)? v?2( 0)? or (any )?(later|newer)( version)?"),
    ("gpl-3.0-or-later", "general public licen later", r"(gnu )?general public licen[cs]e( gpl)?( version)? v?3( 0)? or (any )?(later|newer)( version)?"),
    ("gpl-2.0", "gpl", r"(gnu )?gpl( version)? v?2( 0)?"),
    ("gpl-2.0", "gplv2", r"(gnu )?gplv2( 0)?"),
    ("gpl-3.0", "gpl", r"(gnu )?gpl( version)? v?3( 0)?"),
    ("gpl-3.0", "gplv3", r"(gnu )?gplv3( 0)?"),
    ("lgpl-2.0", "library general public", r"(gnu )?library general public licen[cs]e( version)?( v?2( 0)?)?"),
    ("lgpl-2.1", "lesser general public", r"(gnu )?lesser general public licen[cs]e( lgpl)?( version)? v?2 1"),
    ("lgpl-3.0", "lesser general public", r"(gnu )?lesser general public licen[cs]e( lgpl)?( version)? v?3( 0)?"),
    ("lgpl-2.1", "lgpl", r"(gnu )?lgpl( version)? v?2 1"),
    ("lgpl-2.1", "lgplv2", r"(gnu )?lgplv2( 1)?"),
    ("lgpl-3.0", "lgpl", r"(gnu )?lgpl( version)? v?3( 0)?"),
    ("lgpl-3.0", "lgplv3", r"(gnu )?lgplv3"),
    ("agpl-3.0", "affero general public", r"(gnu )?affero general public licen[cs]e( agpl)?( version)? v?3( 0)?"),
    ("agpl-3.0", "agpl", r"(gnu )?agpl( version)? v?3( 0)?"),
    ("agpl-3.0", "agplv3", r"(gnu )?agplv3"),
    ("gfdl-1.2", "free documentation", r"(gnu )?free documentation licen[cs]e( gfdl)?( version)? v?1 2"),
    ("gfdl-1.3", "free documentation", r"(gnu )?free documentation licen[cs]e( gfdl)?( version)? v?1 3"),
    ("mpl-1.0", "mozilla public", r"mozilla public licen[cs]e( mpl)?( version)? v?1 0"),
    ("mpl-1.1", "mozilla public", r"mozilla public licen[cs]e( mpl)?( version)? v?1 1"),
    ("mpl-2.0", "mozilla public", r"mozilla public licen[cs]e( mpl)?( version)? v?2( 0)?"),
    ("epl-1.0", "eclipse public", r"eclipse public licen[cs]e( epl)?( version)? v?1( 0)?"),
    ("epl-2.0", "eclipse public", r"eclipse public licen[cs]e( epl)?( version)? v?2( 0)?"),
    ("cddl-1.0", "common development distribution", r"common development and distribution licen[cs]e( cddl)?( version)?( v?1 0)?"),
    ("cpl-1.0", "common public licen", r"common public licen[cs]e( version)?( v?1 0)?"),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e( eupl)?( version)? v?1 1"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e( eupl)?( version)? v?1 2"),
    ("osl-3.0", "open software licen", r"open software licen[cs]e( osl)?( version)?( v?3( 0)?)?"),
    ("afl-3.0", "academic free licen", r"academic free licen[cs]e( afl)?( version)?( v?3( 0)?)?"),
    ("artistic-1.0", "artistic licen", r"artistic licen[cs]e( version)? v?1 0"),
    ("artistic-2.0", "artistic licen", r"artistic licen[cs]e( version)? v?2( 0)?"),
    ("bsl-1.0", "boost software licen", r"boost software licen[cs]e( version)?( v?1 0)?"),
    ("busl-1.1", "business source licen", r"business source licen[cs]e( version)?( v?1 1)?"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e( sspl)?( version)?( v?1( 0)?)?"),
    ("elastic-2.0", "elastic licen", r"elastic licen[cs]e( version)?( v?2( 0)?)?"),
    ("bsd-2-clause", "clause bsd", r"(2|two) clause bsd( licen[cs]e)?"),
    ("bsd-3-clause", "clause bsd", r"(3|three) clause bsd( licen[cs]e)?"),
    ("bsd-4-clause", "clause bsd", r"(4|four) clause bsd( licen[cs]e)?"),
    ("bsd-2-clause", "bsd clause", r"bsd (2|two) clause( licen[cs]e)?"),
    ("bsd-3-clause", "bsd clause", r"bsd (3|three) clause( licen[cs]e)?"),
    ("bsd-2-clause", "simplified bsd", r"simplified bsd licen[cs]e"),
    ("bsd-2-clause", "freebsd licen", r"freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd licen", r"(new|modified|revised) bsd licen[cs]e"),
    ("0bsd", "zero bsd", r"zero clause bsd( licen[cs]e)?"),
    ("mit", "mit licen", r"(the )?mit licen[cs]e(d)?"),
    ("mit", "mit x11", r"mit x11( licen[cs]e)?"),
    ("mit", "expat licen", r"expat licen[cs]e"),
    ("x11", "x11 licen", r"x11 licen[cs]e"),
    ("isc", "isc licen", r"isc licen[cs]e"),
    ("zlib", "zlib licen", r"zlib( libpng)? licen[cs]e"),
    ("ncsa", "illinois ncsa", r"university of illinois ncsa open source licen[cs]e"),
    ("psf-2.0", "python software foundation", r"python software foundation licen[cs]e( version)?( v?2( 0)?)?"),
    ("php-3.01", "php licen", r"php licen[cs]e( version)?( v?3 01)?"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("openssl", "openssl licen", r"openssl licen[cs]e"),
    ("ruby", "ruby licen", r"ruby (s )?licen[cs]e"),
    ("upl-1.0", "universal permissive licen", r"universal permissive licen[cs]e( upl)?( version)?( v?1 0)?"),
    ("ecl-2.0", "educational community licen", r"educational community licen[cs]e( version)?( v?2 0)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e( ms pl)?"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e( ms rl)?"),
    ("cecill", "cecill", r"cecill( (b|c))?( free software)?( licen[cs]e)?( agreement)?( v?2 [01])?"),
    ("ofl-1.1", "open font licen", r"(sil )?open font licen[cs]e( ofl)?( version)?( v?1 1)?"),
    ("odbl-1.0", "open database licen", r"open database licen[cs]e( odbl)?( v?1 0)?"),
    ("odc-by-1.0", "open data attribution", r"open data commons attribution licen[cs]e( v?1 0)?"),
    ("pddl-1.0", "public dedication", r"public domain dedication and licen[cs]e"),
    ("ogl-uk", "open government licen", r"open government licen[cs]e( for public sector information)?( v?[123] 0)?"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("cc0-1.0", "cc0", r"cc0( 1 0)?( universal)?( public domain dedication)?"),
    ("cc-by-2.0", "cc by", r"cc by 2 [05]"),
    ("cc-by-3.0", "cc by", r"cc by 3 0( unported)?"),
    ("cc-by-4.0", "cc by", r"cc by 4 0( international)?"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0( unported)?"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa 4 0( international)?"),
    ("cc-by-nd-3.0", "cc by nd", r"cc by nd 3 0( unported)?"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd 4 0( international)?"),
    ("cc-by-nc-3.0", "cc by nc", r"cc by nc 3 0( unported)?"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc 4 0( international)?"),
    ("cc-by-nc-sa-3.0", "cc by nc sa", r"cc by nc sa 3 0( unported)?"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa 4 0( international)?"),
    ("cc-by-nc-nd-3.0", "cc by nc nd", r"cc by nc nd 3 0( unported)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd 4 0( international)?"),
    ("cc-by-3.0", "creative commons attribution", r"creative commons attribution 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-4.0", "creative commons attribution", r"creative commons attribution 4 0( international)?( licen[cs]e)?"),
    ("cc-by-sa-3.0", "creative commons attribution alike", r"creative commons attribution share ?alike 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-sa-4.0", "creative commons attribution alike", r"creative commons attribution share ?alike 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-4.0", "creative commons attribution commercial", r"creative commons attribution non ?commercial 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nd-4.0", "creative commons attribution deriv", r"creative commons attribution no ?deriv(s|atives|ative works) 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-sa-4.0", "creative commons commercial alike", r"creative commons attribution non ?commercial share ?alike 4 0( international)?( licen[cs]e)?"),
    ("cc-by-nc-nd-4.0", "creative commons commercial deriv", r"creative commons attribution non ?commercial no ?deriv(s|atives|ative works) 4 0( international)?( licen[cs]e)?"),
)

FAMILIES = (
    ("apache", "apache licen", r"apache( software)? licen[cs]e(d)?"),
    ("gpl", "general public licen", r"gnu general public licen[cs]e"),
    ("gpl", "gnu gpl", r"gnu gpl"),
    ("gpl", "gpl licen", r"gpl licen[cs]ed?"),
    ("lgpl", "lesser general public", r"(gnu )?lesser general public licen[cs]e"),
    ("lgpl", "lgpl", r"(gnu )?lgpl"),
    ("agpl", "affero", r"(gnu )?affero( general)? public licen[cs]e"),
    ("agpl", "agpl", r"(gnu )?agpl"),
    ("gfdl", "free documentation", r"(gnu )?free documentation licen[cs]e"),
    ("gfdl", "gfdl", r"(gnu )?gfdl"),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e"),
    ("epl", "eclipse public", r"eclipse public licen[cs]e"),
    ("eupl", "european union public", r"european union public licen[cs]e"),
    ("eupl", "eupl", r"eupl"),
    ("bsd", "bsd licen", r"bsd( style)? licen[cs]ed?"),
    ("artistic", "artistic licen", r"artistic licen[cs]e"),
    ("mit", "mit style", r"mit style licen[cs]e"),
    ("cc-by", "cc by", r"cc by"),
    ("cc-by-sa", "cc by sa", r"cc by sa"),
    ("cc-by-nd", "cc by nd", r"cc by nd"),
    ("cc-by-nc", "cc by nc", r"cc by nc"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd"),
    ("cc-by", "creative commons attribution", r"creative commons attribution( licen[cs]e)?"),
    ("cc-by-sa", "creative commons alike", r"creative commons attribution share ?alike( licen[cs]e)?"),
    ("cc-by-nc", "creative commons commercial", r"creative commons attribution non ?commercial( licen[cs]e)?"),
    ("cc", "creative commons", r"creative commons( licen[cs]e)?"),
    ("public-domain", "public domain", r"(is |are )?(in|into) the public domain"),
    ("public-domain", "gemeinfrei", r"gemeinfrei(e|er|es|en)?"),
    ("public-domain", "dominio", r"dominio público"),
    ("public-domain", "domaine", r"domaine public"),
)

HINTS = (
    ("licensed", "licen under", r"licen[cs]ed under( the| a| an)?( terms of)?"),
    ("licensed", "lizenz", r"(lizenziert|lizensiert) unter"),
    ("licensed", "licencia", r"bajo( la| una)? licencia"),
    ("licensed", "licence sous", r"sous licence"),
    ("copyright", "copyright", r"copyright( c)?( (19|20)\d\d)?"),
    ("copyright", "urheberrecht", r"urheberrechtlich geschützt"),
    ("reserved", "all rights reserved", r"all rights reserved"),
    ("reserved", "rechte vorbehalten", r"alle rechte vorbehalten"),
    ("reserved", "derechos reservados", r"todos los derechos reservados"),
    ("reserved", "droits", r"tous droits réservés"),
    ("terms", "terms use", r"(subject to|see)( the| our)? terms of (use|service)"),
    ("permission", "permission reprinted", r"reprinted (with|by) permission( of)?"),
    ("permission", "permission used", r"used (with|by) permission( of)?"),
)


def all_rules() -> tuple[Rule, ...]:
    """All rules by class; within a class the earlier rule comes first."""
    out = [Rule(label, tuple(needs.split()), p, 0) for label, needs, p in NOTICES]
    out += [Rule(label, ("spdx", *p.split("(")[0].split()[:1]), f"spdx license identifier {p}", 1) for label, p in TAGS]
    out += [Rule(label, tuple(needs.split()), p, 2) for label, needs, p in LINKS]
    out += [Rule(label, tuple(needs.split()), _UNDER + p, 3) for label, needs, p in NAMES]
    out += [Rule(label, tuple(needs.split()), _UNDER + p, 4) for label, needs, p in FAMILIES]
    out += [Rule(label, tuple(needs.split()), p, 5) for label, needs, p in HINTS]
    return tuple(out)
