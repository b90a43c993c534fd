"""Hand-written signatures of the license scan, as (label, pattern, keyword).

Fixed values: sentences and names that the licenses and notices use themselves, as words (lower-case, other ASCII
characters are separators). Each text that a pattern fits holds its keyword, or one of
them where they are divided by a ``|``.
"""

#: sentences of license texts, headers and notices; longer ones have the higher priority
SENTENCES = (
    # GNU licenses
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", "take away your freedom"),
    ("gpl", r"the gnu general public license is intended to guarantee your freedom to share and change free software", "guarantee your freedom"),
    ("gpl", r"this program comes with absolutely no warranty for details type show w", "absolutely no warranty"),
    ("gpl", r"if not write to the free software foundation(?: inc)?", "write to the free software foundation"),
    ("gpl", r"see the file copying for (?:copying conditions|details|more details)", "see the file copying"),
    ("gpl", r"(?:distributed|licensed|released|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl", "gpl"),
    ("gpl", r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium", "copies of the program s source code"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works", "free copyleft license"),
    ("agpl-3.0", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", "free copyleft license"),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network", "prominently offer all users"),
    ("lgpl-2.0", r"this is the first released version of the library gpl", "library gpl"),
    ("lgpl-2.1", r"this is the first released version of the lesser gpl", "lesser gpl"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "this version of the gnu lesser"),
    ("lgpl", r"a work that uses the library with the library to produce a work containing portions of the library", "work that uses the library"),
    ("gfdl", r"the purpose of this license is to make a manual textbook or other functional and useful document free", "manual textbook"),
    ("gfdl", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", "no invariant sections"),
    ("fsfap", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "in any medium without royalty"),
    ("fsful", r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", "this configure script is free"),
    ("fsfullr", r"the free software foundation gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved", "gives unlimited permission"),
    # Apache
    ("apache-2.0", r"irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work", "except as stated in this section"),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files", "carry prominent notices"),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements"),
    ("apache-2.0", r"see the notice file distributed with this work for additional information regarding copyright ownership", "regarding copyright ownership"),
    ("apache-2.0", r"(?:https? )?www apache org licenses license 2 0(?: txt| html)?", "apache org licenses"),
    ("apache-1.0", r"this product includes software developed by the apache group", "the apache group"),
    ("apache-1.1", r"products derived from this software may not be called apache nor may apache appear in their name", "may not be called apache"),
    # BSD
    ("bsd-4-clause", r"this product includes software developed by the university of california berkeley and its contributors", "university of california"),
    ("bsd-4-clause", r"this product includes software developed by the netbsd foundation inc and its contributors", "netbsd foundation"),
    ("bsd", r"this software is provided by .{1,80}? as is and any express or implied warranties including but not limited to", "any express or implied warranties"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", r"in no event shall .{1,120}? be liable for any direct indirect incidental special exemplary or consequential damages", "exemplary or consequential damages"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "any party s patent rights"),
    ("bsd-2-clause-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide", "those receiving rights"),
    ("bsd-3-clause-no-nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "nuclear facility"),
    ("bsd-2-clause-views", r"the views and conclusions contained in the software and documentation are those of the authors", "the views and conclusions"),
    ("bsd-3-clause-lbnl", r"you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code", "under no obligation whatsoever"),
    ("bsd-3-clause-attribution", r"redistributions of any form whatsoever must retain the following acknowledge?ment", "of any form whatsoever"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software", "for the db software"),
    ("ssleay", r"this library is free for commercial and non commercial use as long as the following conditions are a[dh]?hered to", "this library is free for commercial"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic software written by"),
    # MIT and other permissive notices
    ("mit-0", r"to permit persons to whom the software is furnished to do so the software is provided as is", "is furnished to do so the software is"),
    ("mit", r"to permit persons to whom the software is furnished to do so subject to the following conditions", "is furnished to do so subject"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "any claim damages or other liability"),
    ("mit-feh", r"acknowledge?ment shall be given in the documentation and software packages that this software was used", "packages that this software was used"),
    ("mit-enna", r"this includes acknowledge?ments in either copyright notices manuals publicity and marketing documents", "publicity and marketing documents"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising", "x consortium"),
    ("xfree86-1.1", r"this product includes software developed by the xfree86 project", "xfree86 project"),
    ("ntp", r"for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation", "supporting documentation"),
    ("hpnd", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", "publicity pertaining to distribution"),
    ("hpnd", r"makes? no representations about the suitability of this software for any purpose it is provided as is", "about the suitability of this software"),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", "this instrument is retained"),
    ("blessing", r"may you share freely never taking more than you give", "never taking more than you give"),
    ("blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", "here is a blessing"),
    ("libpng", r"the png reference library is supplied as is", "png reference library"),
    ("libpng", r"this code is released under the libpng license", "libpng license"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("bzip2", r"this program bzip2 the associated library libbzip2 and all documentation are copyright", "libbzip2"),
    ("info-zip", r"for the purposes of this copyright and license info zip is defined as the following set of individuals", "info zip is defined"),
    ("unrar", r"unrar (?:source code|sources) may be used in any software to handle rar archives without limitations free of charge", "rar archives"),
    ("ftl", r"portions of this software are copyright .{1,60}? the freetype project", "the freetype project"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "the authors hereby grant permission"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "source form of the software"),
    ("artistic-1.0", r"you may make and give away verbatim copies of the source form of the standard version of this package without restriction", "standard version of this package"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "a given free software package"),
    ("perl", r"you can redistribute it and or modify it under the same terms as perl(?: itself)?", "same terms as perl"),
    ("php", r"products derived from this software may not be called php nor may php appear in their name", "may not be called php"),
    ("zpl", r"this license has been certified as open source it has also been designated as gpl compatible", "designated as gpl compatible"),
    ("psf", r"this license agreement is between the python software foundation psf and the individual or organization licensee", "the python software foundation psf"),
    ("cnri-python", r"this license agreement is between the corporation for national research initiatives", "national research initiatives"),
    ("beopen-python", r"beopen python open source license agreement", "beopen python"),
    ("cwi", r"stichting mathematisch centrum disclaims all warranties with regard to this software", "stichting mathematisch centrum"),
    ("w3c", r"permission to copy modify and distribute this (?:software|work)(?: and its documentation)? with or without modification for any purpose and without fee or royalty is hereby granted", "without fee or royalty"),
    ("upl-1.0", r"to deal in the software and the larger works", "the larger works"),
    ("wtfpl", r"you just do what the fuck you want to", "what the fuck you want"),
    ("json", r"the software shall be used for good not evil", "not evil"),
    ("vim", r"you may distribute a modified vim that you have not distributed", "modified vim"),
    # fonts and documents
    ("ofl", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "collaborative font projects"),
    ("ofl", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", "neither the font software"),
    ("bitstream-vera", r"the fonts may be modified altered or added to and in particular the designs of glyphs or characters in the fonts may be modified", "designs of glyphs"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license", "latex project public"),
    ("lppl", r"this work has the lppl maintenance status", "lppl maintenance status"),
    ("unicode", r"unicode license (?:agreement|v3)", "unicode license"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation", "copy of data files"),
    # Creative Commons and data
    ("creative-commons", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons", "exercising the licensed rights"),
    ("creative-commons", r"the work as defined below is provided under the terms of this creative commons public license", "this creative commons public license"),
    ("creative-commons", r"this (?:work|article|book|page|text|content) is licensed under (?:a|the) creative commons", "licensed under"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "work with this deed"),
    ("cc0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders", "affirmer hereby overtly"),
    ("cc-pddc", r"copyright only dedication based on united states law or public domain certification", "copyright only dedication"),
    ("pddl", r"(?:open data commons )?public domain dedication and licen[cs]e", "public domain dedication"),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license", "database contents license"),
    ("ogl-uk", r"contains public sector information licensed under the open government licen[cs]e", "public sector information"),
    # weak copyleft headers
    ("mpl-2.0", r"this source code form is incompatible with secondary licenses", "incompatible with secondary licenses"),
    ("mpl-2.0", r"https? (?:www )?mozilla org mpl 2 0", "mozilla org mpl"),
    ("mpl-1.1", r"alternatively the contents of this file may be used under the terms of (?:either )?the gnu", "alternatively the contents of this file"),
    ("npl", r"the contents of this file are subject to the netscape public license", "netscape public license"),
    ("cddl", r"the contents of this file are subject to the terms of (?:either )?(?:the gnu general public license .{1,40}? )?the common development and distribution license", "common development and distribution"),
    ("apsl", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", "apple public source"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cpl", r"this program and the accompanying materials are made available under the terms of the common public license", "common public license"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "governs use of the accompanying software"),
    ("eupl", r"this european union public licence the eupl applies to the work or software", "european union public"),
    ("osl", r"this open software license the license applies to any original work of authorship", "this open software license"),
    ("afl", r"this academic free license the license applies to any original work of authorship", "this academic free license"),
    # source available and proprietary notices
    ("commons-clause", r"the license does not grant to you the right to sell the software", "the right to sell the software"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality of the program"),
    ("busl", r"effective on the change date or the fourth anniversary of the first publicly available distribution", "fourth anniversary"),
    ("proprietary", r"(?:confidential and )?proprietary (?:information|property) of", "proprietary"),
    ("proprietary", r"(?:contains|constitutes?|is) (?:valuable )?trade secrets? (?:of|and)", "trade secret"),
    ("proprietary", r"(?:the )?(?:software|product) is licensed(?: and)? not sold", "not sold"),
    ("proprietary", r"you (?:may|shall|must) not (?:copy )?(?:modify )?(?:reverse engineer|decompile|disassemble)", "reverse engineer|decompile|disassemble"),
    ("proprietary", r"reproduction in whole or in part .{0,60}?is (?:strictly )?(?:prohibited|forbidden)", "in whole or in part"),
    ("proprietary", r"may not be (?:reproduced|republished|redistributed|rewritten|broadcast) .{0,120}?without (?:the )?(?:express |prior )*(?:written )?(?:permission|consent)", "may not be reproduced|may not be republished|may not be redistributed|may not be rewritten|may not be broadcast"),
    ("proprietary", r"for (?:internal|evaluation) (?:use|purposes?) only", "use only|purpose only|purposes only"),
    ("non-commercial", r"for (?:non ?commercial|personal|academic|educational|research) (?:use|purposes?) only", "use only|purpose only|purposes only"),
    ("non-commercial", r"(?:may|must|shall) not be used for commercial purposes", "commercial purposes"),
    ("proprietary", r"alle rechte vorbehalten", "rechte vorbehalten"),
    ("proprietary", r"tous droits réservés", "tous droits"),
    ("proprietary", r"(?:todos los|reservados todos los) derechos(?: reservados)?", "todos los derechos"),
    ("proprietary", r"vervielfältigung .{0,60}?nur mit (?:schriftlicher )?genehmigung", "genehmigung"),
    ("proprietary", r"toute reproduction .{0,60}?interdite", "toute reproduction"),
    ("proprietary", r"prohibida (?:su|la) reproducción", "prohibida"),
)

#: names of licenses that have no family of versions
NAMES = (
    ("cpal", r"common public attribution licen[cs]e", "common public attribution"),
    ("ipl", r"ibm public licen[cs]e", "ibm public"),
    ("spl", r"sun public licen[cs]e", "sun public"),
    ("sissl", r"sun industry standards source licen[cs]e", "sun industry standards"),
    ("apsl", r"apple public source licen[cs]e", "apple public source"),
    ("nasa", r"nasa open source agreement", "nasa open source"),
    ("rpl", r"reciprocal public licen[cs]e", "reciprocal public"),
    ("rpsl", r"realnetworks public source licen[cs]e", "realnetworks public"),
    ("npl", r"netscape public licen[cs]e", "netscape public"),
    ("nokia", r"nokia open source licen[cs]e", "nokia open source"),
    ("motosoto", r"motosoto open source licen[cs]e", "motosoto"),
    ("watcom", r"sybase open watcom public licen[cs]e", "open watcom"),
    ("lpl", r"lucent public licen[cs]e", "lucent public"),
    ("entessa", r"entessa public licen[cs]e", "entessa"),
    ("frameworx", r"frameworx (?:open )?licen[cs]e", "frameworx"),
    ("efl", r"eiffel forum licen[cs]e", "eiffel forum"),
    ("rscpl", r"ricoh source code public licen[cs]e", "ricoh source code"),
    ("vsl", r"vovida software licen[cs]e", "vovida"),
    ("xnet", r"x ?net licen[cs]e", "xnet licen|x net licen"),
    ("catosl", r"computer associates trusted open source licen[cs]e", "trusted open source"),
    ("cua-opl", r"cua office public licen[cs]e", "cua office"),
    ("ogtsl", r"open group test suite licen[cs]e", "open group test suite"),
    ("oclc", r"oclc research public licen[cs]e", "oclc research"),
    ("oldap", r"openldap public licen[cs]e", "openldap public"),
    ("simpl", r"simple public licen[cs]e", "simple public"),
    ("sleepycat", r"sleepycat (?:public |software )?licen[cs]e", "sleepycat"),
    ("wxwindows", r"wxwindows library licen[cs]e", "wxwindows"),
    ("w3c", r"w3c (?:software|document)(?: and document)?(?: notice and)? licen[cs]e", "w3c"),
    ("ftl", r"freetype (?:project )?licen[cs]e", "freetype"),
    ("icu", r"icu licen[cs]e", "icu licen"),
    ("tcl", r"tcl tk licen[cs]e", "tcl tk"),
    ("imagemagick", r"imagemagick licen[cs]e", "imagemagick"),
    ("edl-1.0", r"eclipse distribution licen[cs]e", "eclipse distribution"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e|ms rl", "ms rl|microsoft reciprocal"),
    ("ms-lpl", r"microsoft limited public licen[cs]e", "microsoft limited"),
    ("intel-simplified", r"intel simplified software licen[cs]e", "intel simplified"),
    ("otn", r"oracle technology network (?:developer )?licen[cs]e", "oracle technology network"),
    ("oracle-bcl", r"oracle binary code licen[cs]e", "oracle binary code"),
    ("cern-ohl", r"cern open hardware licen[cs]e", "cern open hardware"),
    ("tapr-ohl", r"tapr open hardware licen[cs]e", "tapr open hardware"),
    ("solderpad", r"solderpad hardware licen[cs]e", "solderpad"),
    ("mulan-psl", r"mulan (?:permissive software|psl) ?(?:licen[cs]e)?", "mulan p"),
    ("mulan-publ", r"mulan public licen[cs]e", "mulan pu"),
    ("blue-oak", r"blue oak model licen[cs]e", "blue oak"),
    ("parity", r"parity public licen[cs]e", "parity public"),
    ("prosperity", r"prosperity public licen[cs]e", "prosperity public"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[cs]e", "polyform"),
    ("commons-clause", r"commons clause(?: licen[cs]e condition)?", "commons clause"),
    ("anti-996", r"anti 996 licen[cs]e", "anti 996"),
    ("hippocratic", r"hippocratic licen[cs]e", "hippocratic"),
    ("confluent", r"confluent community licen[cs]e", "confluent community"),
    ("rsal", r"redis source available licen[cs]e", "redis source"),
    ("timescale", r"timescale licen[cs]e", "timescale"),
    ("fsl", r"functional source licen[cs]e", "functional source"),
    ("fair-source", r"fair source licen[cs]e", "fair source"),
    ("sustainable-use", r"sustainable use licen[cs]e", "sustainable use"),
    ("openrail", r"open ?rail(?: m)?|responsible ai licen[cs]e", "openrail|open rail|responsible ai"),
    ("llama", r"llama (?:\d(?: \d)? )?community licen[cs]e", "llama"),
    ("cdla-permissive", r"community data licen[cs]e agreement permissive", "community data"),
    ("cdla-sharing", r"community data licen[cs]e agreement sharing", "community data"),
    ("etalab", r"licence ouverte(?: open licence)?", "licence ouverte"),
    ("ogl-uk", r"open government licen[cs]e", "open government"),
    ("dl-de", r"datenlizenz deutschland", "datenlizenz"),
    ("opl", r"open publication licen[cs]e", "open publication"),
    ("free-art", r"free art licen[cs]e|licence art libre", "free art|art libre"),
    ("gust-font", r"gust font (?:source )?licen[cs]e", "gust font"),
    ("ubuntu-font", r"ubuntu font licen[cs]e", "ubuntu font"),
    ("arphic", r"arphic public licen[cs]e", "arphic"),
    ("ipa-font", r"ipa font licen[cs]e", "ipa font"),
    ("glide", r"3dfx glide (?:source code )?general public licen[cs]e", "glide"),
    ("cecill-b", r"cecill b(?: free software)?(?: licen[cs]e)?", "cecill b"),
    ("cecill-c", r"cecill c(?: free software)?(?: licen[cs]e)?", "cecill c"),
    ("liliq", r"licence libre du québec", "licence libre"),
    ("d-fsl", r"deutsche freie software lizenz", "freie software lizenz"),
    ("adobe-glyph", r"adobe glyph list licen[cs]e", "adobe glyph"),
    ("eula", r"end user licen[cs]e agreement|endbenutzer ?lizenzvertrag|contrat de licence utilisateur final", "end user|lizenzvertrag|utilisateur final"),
    ("dual", r"dual licensed under", "dual licensed"),
    ("dual", r"(?:licensed|available) under (?:either|any) of", "under either of|under any of"),
    ("freeware", r"(?:distributed|released|licensed) as (?:freeware|shareware)", "as freeware|as shareware"),
)

#: exceptions beside a license, which widen it
EXCEPTIONS = (
    ("qt-exception", r"qt (?:company )?(?:gpl |lgpl )?exception", "exception"),
    ("u-boot-exception", r"u boot exception", "exception"),
    ("swift-exception", r"(?:swift )?runtime library exception to the apache", "exception to the apache"),
    ("ocaml-exception", r"ocaml (?:lgpl )?linking exception", "linking exception"),
    ("libtool-exception", r"if you distribute this file as part of a program or library that is built using gnu libtool", "built using gnu libtool"),
    ("wxwindows-exception", r"wxwindows (?:library )?exception", "exception"),
    ("gpl-cc-exception", r"gpl cooperation commitment", "cooperation commitment"),
    ("bootloader-exception", r"bootloader (?:distribution )?exception", "exception"),
    ("special-exception", r"as a special exception(?: to the .{1,60}? licen[cs]e)? (?:the copyright holders?|if you|you may|the free software foundation|the authors?)", "as a special exception"),
)
