"""License scan with ordered signature rules.

A text is reduced to its words: A-Z lower-cased, every other ASCII character
but digits and letters a separator. Rules are regular expressions over the
words joined by single spaces; most are written by hand (here and in ``signatures``), and a
family of licenses has a rule for each of its forms, whose match tells the version. Each is
gated by keywords, which one automaton looks for in a text: it runs only where
all of them occur. A match is suppressed where the interval of a match of
higher priority, or of the same one but longer, contains it (of equal intervals, the earlier
rule stays), or where it is denied ("not licensed under the ..."). A version with a plus sign
counts as "or later"; exceptions have labels of their own. The base rules report all their
places and always keep their labels.

Null text counts as empty: no words, no labels, score 0. Empty tables give
empty results, repeated rows repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import signatures
from .common import check_names

#: Bytes that end a word become spaces, A-Z become a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    #: groups ``version`` and ``later``, if any, are added to the label
    pattern: str
    #: each is in every match, or one of them where they are divided by a ``|``
    keywords: tuple[str, ...]
    priority: int
    score: float
    base: bool = False


#: Phrases whose places are always reported.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: family, long name, short names, versions, keyword of the long and of the short names
_VERSIONED = (
    ("gpl", r"(?:gnu )?general public licen[cs]e", ("gpl",), ("1.0", "2.0", "3.0"), "general public"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ("lgpl",), ("2.0", "2.1", "3.0"), "general public"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", ("agpl",), ("1.0", "3.0"), "affero"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", ("gfdl", "fdl"), ("1.1", "1.2", "1.3"), "documentation"),
    ("apache", r"apache (?:software )?licen[cs]e", ("apache", "asl"), ("1.0", "1.1", "2.0"), "apache"),
    ("mpl", r"mozilla public licen[cs]e", ("mpl",), ("1.0", "1.1", "2.0"), "mozilla"),
    ("epl", r"eclipse public licen[cs]e", ("epl",), ("1.0", "2.0"), "eclipse"),
    ("cddl", r"common development and distribution licen[cs]e", ("cddl",), ("1.0", "1.1"), "common development"),
    ("cpl", r"common public licen[cs]e", ("cpl",), ("1.0",), "common public"),
    ("eupl", r"european union public licen[cs]e", ("eupl",), ("1.0", "1.1", "1.2"), "european union"),
    ("artistic", r"artistic licen[cs]e", ("artistic",), ("1.0", "2.0"), "artistic"),
    ("boost", r"boost software licen[cs]e", ("bsl", "boost"), ("1.0",), "boost"),
    ("afl", r"academic free licen[cs]e", ("afl",), ("2.0", "2.1", "3.0"), "academic free"),
    ("osl", r"open software licen[cs]e", ("osl",), ("1.0", "2.0", "2.1", "3.0"), "open software"),
    ("ofl", r"(?:sil )?open font licen[cs]e", ("ofl",), ("1.0", "1.1"), "open font"),
    ("odc-by", r"open data commons attribution licen[cs]e", ("odc by",), ("1.0",), "open data"),
    ("odbl", r"open database licen[cs]e", ("odbl",), ("1.0",), "open database"),
    ("php", r"php licen[cs]e", ("php license",), ("3.0", "3.01"), "php"),
    ("zpl", r"zope public licen[cs]e", ("zpl",), ("2.0", "2.1"), "zope"),
    ("ecl", r"educational community licen[cs]e", ("ecl",), ("1.0", "2.0"), "educational community"),
    ("cecill", r"cecill(?: free software)? licen[cs]e", ("cecill",), ("1.0", "2.0", "2.1"), "cecill"),
    ("ms-pl", r"microsoft public licen[cs]e", ("ms pl",), ("1.0",), "microsoft"),
    ("qpl", r"q public licen[cs]e", ("qpl",), ("1.0",), "q public"),
    ("lppl", r"latex project public licen[cs]e", ("lppl",), ("1.2", "1.3"), "latex"),
    ("psf", r"python software foundation licen[cs]e", ("psf",), ("2.0",), "python software"),
)
_CC = (("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: label, pattern, keyword
_PHRASES = (
    ("mit", r"(?:the )?(?:mit|expat|x11) licen[cs]e", "mit licen|expat licen|x11 licen"),
    ("mit", r"licensed under (?:the )?(?:terms of )?(?:the )?mit\b", "mit"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included", "permission notice"),
    ("isc", r"isc licen[cs]e", "isc"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", r"(?:modified |simplified |new |revised )?bsd licen[cs]e", "bsd"),
    ("bsd", r"bsd style", "bsd"),
    ("bsd-2-clause", r"(?:bsd )?(?:2|two) clause(?: bsd)?(?: licen[cs]e)?", "clause"),
    ("bsd-3-clause", r"(?:bsd )?(?:3|three) clause(?: bsd)?(?: licen[cs]e)?", "clause"),
    ("bsd-4-clause", r"(?:bsd )?(?:4|four) clause(?: bsd)?(?: licen[cs]e)?", "clause"),
    ("bsd", r"redistributions? of source code must retain the above copyright notice", "redistribution"),
    ("bsd", r"redistributions? in binary form must reproduce the above copyright notice", "redistribution"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors", "neither the name"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("zlib", r"altered source versions must be plainly marked", "altered source"),
    ("unlicense", r"(?:the )?unlicense\b", "unlicense"),
    ("unlicense", r"released into the public domain", "public domain"),
    ("public-domain", r"(?:in|into|to) the public domain", "public domain"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", "do what the fuck|wtfpl"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|cc zero", "cc0|cc zero"),
    ("cc0", r"creative commons zero", "creative commons"),
    ("creative-commons", r"creative commons licen[cs]e", "creative commons"),
    ("cc-by", r"cc by\b", "cc by"),
    ("proprietary", r"all rights reserved", "rights reserved"),
    ("proprietary", r"proprietary and confidential", "confidential"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction)", "unauthorized"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright"),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("agpl", r"redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute"),
    ("apache", r"licensed under the apache license", "apache license"),
    ("apache", r"you may not use this file except in compliance with the license", "in compliance"),
    ("as-is", r"the software is provided as is without warranty of any kind", "without warranty"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "ncsa"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("curl", r"curl licen[cs]e", "curl"),
    ("json", r"shall be used for good not evil", "not evil"),
    ("ruby", r"ruby licen[cs]e|same terms as ruby", "ruby"),
    ("perl", r"same terms as perl", "perl"),
    ("vim", r"vim licen[cs]e", "vim"),
    ("beerware", r"beer ?ware(?: licen[cs]e)?", "beer"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("sspl", r"server side public licen[cs]e", "server side"),
    ("busl", r"business source licen[cs]e", "business source"),
    ("elastic", r"elastic licen[cs]e", "elastic"),
)

#: Sentences of the licenses themselves, as label, pattern, keyword. Longer ones have the higher priority.
_SIGNATURES = (
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "to deal in the software"),
    ("x11", r"except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", "in this notice"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted", "permission to use"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "written agreement"),
    ("libtiff", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "distribute and sell"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights", "to deal with the software"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "granted to anyone"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("zlib", r"this notice may not be removed or altered from any source distribution", "removed or altered"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "source code form"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "contents of this file"),
    ("epl-1.0", r"made available under the terms of the eclipse public license v(?:ersion)? ?1 0", "eclipse"),
    ("epl-2.0", r"made available under the terms of the eclipse public license v(?:ersion)? ?2 0", "eclipse"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "implied warranty"),
    ("lgpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license", "implied warranty"),
    ("agpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license", "implied warranty"),
    ("gpl", r"you should have received a copy of the gnu general public license along with", "should have received a copy"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "should have received a copy"),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with", "should have received a copy"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "anyone is free to copy"),
    ("cc0", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "neighboring rights"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "font software"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "intent of this document"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl project"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "retain this notice"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified copies"),
    ("upl-1.0", r"free of charge and under any and all copyright rights in the software", "any and all copyright"),
    ("eupl", r"licensed under the eupl", "eupl"),
    ("odbl", r"made available under the open database license", "open database"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files"),
    ("php", r"this product includes php software freely available from", "php software"),
    ("psf", r"psf is making python available to licensee on an as is basis", "making python available"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensed work"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("proprietary", r"no part of this (?:publication|work|document|book) may be reproduced .{0,120}? without (?:the )?prior written permission", "no part of this"),
)
#: Exceptions, reported beside the license that they widen.
_EXCEPTIONS = (
    ("classpath-exception", r"class ?path exception", "exception"),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work based on this library", "combined work"),
    ("gcc-exception", r"gcc runtime library exception", "exception"),
    ("autoconf-exception", r"configure? script generated by autoconf|configuration script generated by autoconf", "generated by autoconf"),
    ("bison-exception", r"you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton"),
    ("font-exception", r"font (?:embedding )?exception", "exception"),
    ("llvm-exception", r"llvm exceptions?", "exception"),
    ("openssl-exception", r"openssl (?:linking )?exception", "exception"),
    ("linking-exception", r"(?:static |dynamic )?linking exception", "exception"),
    ("foss-exception", r"(?:universal )?foss (?:licen[cs]e )?exception", "exception"),
    ("syscall-note", r"linux syscall note", "syscall note"),
)
#: SPDX identifiers outside the families, as words.
_SPDX = ("mit", "mit 0", "x11", "isc", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "zlib", "unlicense", "wtfpl", "cc0 1 0", "ncsa", "openssl", "curl", "json", "ruby", "vim", "beerware", "postgresql", "hpnd", "upl 1 0", "elastic 2 0", "busl 1 1", "sspl 1 0")
#: Words between a denial and what it denies; matches after them don't count, but for base labels.
_DENIED = re.compile(r"(?:^| )(?:not|never|cannot)(?: (?:be|been|being|yet|currently|licen[cs]ed|released|distributed|available|covered|governed|offered|published|made|used|under|by|with|the|terms|of|a|an|any))* $")


#: What may follow a version.
_LATER = r"(?P<later>(?: of the licen[cs]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?)"


def _version(versions: tuple[str, ...]) -> str:
    """One of the versions, as words: 2.0 is 2 or 2 0, 2.1 is 2 1."""
    forms = [(major, minor) for major, minor in (v.split(".") for v in versions)]
    return "(?P<version>" + "|".join(rf"{major}(?: 0)?(?! \d)" if minor == "0" else rf"{major} {minor}(?! \d)" for major, minor in forms) + ")"


def _labelled(label: str, match: re.Match[str]) -> str:
    """The label with the version that the match tells."""
    told = match.groupdict()
    if not told.get("version"):
        return label
    number = told["version"].replace(" ", ".")
    return f"{label}-{number if '.' in number else number + '.0'}" + ("-or-later" if told.get("later") else "")


def build_rules() -> tuple[Rule, ...]:
    """All rules in their order."""
    rules = [Rule(f"base-{label}", label, phrase, (phrase,), 10, 0.8, True) for phrase, label in BASE_PHRASES]
    add = lambda name, label, pattern, words, priority, score: rules.append(Rule(name, label, pattern, words, priority, score))
    for family, long, shorts, versions, keyword in _VERSIONED:
        n = _version(versions)
        add(f"{family}-name", family, long, (keyword,), 20, 0.8)
        add(f"{family}-long", family, rf"{long} (?:v|ver|version|as published by the free software foundation (?:either )?version)? ?{n}{_LATER}?", (keyword,), 60, 1.0)
        add(f"{family}-url", family, rf"(?:licenses|license|legal) {shorts[0]} {n}", (shorts[0],), 50, 0.7)
        for short in shorts:
            add(f"{family}-{short.replace(' ', '-')}", family, rf"{short} ?v?(?:ersion )?{n}{_LATER}?", (short,), 40, 0.9)
            add(f"{family}-{short.replace(' ', '-')}-spdx", family, rf"spdx license identifier {short} {n}(?: only|{_LATER})?", ("spdx license identifier", short), 90, 1.0)
    n = _version(_CC_VERSIONS)
    for label, short, long in _CC:
        add(f"{label}-name", label, rf"creative commons {long}(?: licen[cs]e)?", ("creative commons",), 20, 0.8)
        add(f"{label}-short", label, rf"cc {short}", ("cc by",), 20 + len(short), 0.8)
        add(f"{label}-short-version", label, rf"cc {short} {n}", ("cc by",), 50 + len(short), 1.0)
        add(f"{label}-long", label, rf"creative commons {long} (?:licen[cs]e )?(?:version )?{n}(?: international| unported| generic)?", ("creative commons",), 50 + len(short), 1.0)
        add(f"{label}-url", label, rf"creativecommons org licenses {short} {n}", ("creativecommons",), 60 + len(short), 1.0)
        add(f"{label}-spdx", label, rf"spdx license identifier cc {short} {n}", ("spdx license identifier", "cc by"), 90 + len(short), 1.0)
    for i, (label, pattern, keyword) in enumerate(_PHRASES + signatures.NAMES):
        add(f"{label}-phrase-{i}", label, pattern, (keyword,), 30, 0.7)
    for i, (label, pattern, keyword) in enumerate(_SIGNATURES + signatures.SENTENCES):
        add(f"{label}-text-{i}", label, pattern, (keyword,), 30 + len(pattern.split()), 1.0)
    for i, (label, pattern, keyword) in enumerate(_EXCEPTIONS + signatures.EXCEPTIONS):
        add(f"{label}-{i}", label, pattern, (keyword,), 100, 0.9)
    for words in _SPDX:
        add(f"{words.replace(' ', '-')}-spdx", re.sub(r"-(\d)-(\d)$", r"-\1.\2", words.replace(" ", "-")), rf"spdx license identifier {words}", ("spdx license identifier",), 80 + len(words), 1.0)
    return tuple(rules)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.patterns = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in rules]
        self.gates = sorted({k for r in rules for words in r.keywords for k in words.split("|")})
        number = {k: i for i, k in enumerate(self.gates)}
        self.needs = [[frozenset(number[k] for k in words.split("|")) for words in r.keywords] for r in rules]
        self.automaton = ahocorasick.Automaton()
        for k, i in number.items():
            self.automaton.add_word(k, i)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, Rule, bool]]]:
        """Number of words, and the matches as (first word, end word, rule,
        whether a match of higher priority contains it)."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        folded = raw.translate(_FOLD)
        words = folded.split()
        line = b" ".join(words).decode("utf-8", "surrogatepass")
        present = {k for _, k in self.automaton.iter(line)}
        if not present:
            return len(words), []
        found = []
        for i, need in enumerate(self.needs):
            if not any(present.isdisjoint(some) for some in need):
                label = self.rules[i].label
                found += [(m.start(), m.end(), i, _labelled(label, m)) for m in self.patterns[i].finditer(line)]
        found.sort(key=lambda m: (-self.rules[m[2]].priority, m[0] - m[1], m[2], m[0]))
        starts = [0, *(i + 1 for i, c in enumerate(line) if c == " ")] if found else []
        # "2.1+" means or later; the sign itself is no part of a word
        plus = {k for k, m in enumerate(_WORD.finditer(folded), 1) if raw[m.end() : m.end() + 1] == b"+"} if found and b"+" in raw else ()
        from_, to = [], []  # live intervals that lie in no other, both ends ascending
        out = []
        for start, end, i, label in found:
            rule, end_word = self.rules[i], bisect_left(starts, end)
            if end_word in plus and label[-1].isdigit() and not rule.base:
                label += "-or-later"
            if label != rule.label:
                rule = replace(rule, label=label)
            if not rule.base and _DENIED.search(line, max(0, start - 120), start):
                out.append((bisect_right(starts, start) - 1, end_word, rule, True))
                continue
            k = bisect_right(from_, start)
            hidden = k > 0 and to[k - 1] >= end
            if not hidden:
                k = bisect_left(from_, start)
                j = bisect_right(to, end, k)
                from_[k:j], to[k:j] = [start], [end]
            out.append((bisect_right(starts, start) - 1, end_word, rule, hidden))
        return len(words), sorted(out, key=lambda m: (m[0], m[1], m[2].name))


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner(build_rules())


MATCH = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("rule", T.StringType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("suppressed", T.BooleanType())])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of every whole text: (id, n_words long, matches array of MATCH,
    in order of place)."""
    check_names(id_col, ("n_words", "matches"))
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    one = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("rule", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("score", pa.float64()), ("suppressed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = scanner()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = [rules.scan(t) for t in part.column(1).to_pylist()]
                matches = [[{"first_word": a, "end_word": b, "rule": r.name, "label": r.label, "base": r.base, "score": r.score, "suppressed": hidden} for a, b, r, hidden in m] for _, m in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(matches, pa.list_(one))], [id_col, "n_words", "matches"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])
    return rows.mapInArrow(run, schema)


def summarize(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per text: (id, n_words, n_base, first_word, last_word,
    base_labels, labels, score)."""
    base = F.filter("matches", lambda m: m["base"])
    kept = F.filter("matches", lambda m: m["base"] | ~m["suppressed"])
    starts = F.transform(base, lambda m: m["first_word"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
