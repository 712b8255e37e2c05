"""Licence scans by sentence rules.

A text's sentences are normalised and looked up among known licence sentences; what is found is the text's
sequence of sentence identifiers. Ordered rules then read this sequence: a rule is a sequence of identifiers that
stands for a licence, the more specific before the more general, and identifiers that a rule has taken are
gone for those after it. Identifiers that no rule takes leave a licence unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, keyed_texts, to_python

SCHEMA = "doc_id long, n_sentences long, sentence_ids string, licenses string, verdict string"

#: Names of licences in running text, normalised, and what they are called here. The first that fits counts.
NAMES = [
    (r"(?:gnu )?affero general public license,? ?(?:version |v)?3(?:\.0)?|(?:gnu )?agpl[ -]?v?3(?:\.0)?", "AGPL-3.0"),
    (r"(?:gnu )?(?:lesser|library) general public license,? ?(?:version |v)?2\.1|(?:gnu )?lgpl[ -]?v?2\.1", "LGPL-2.1"),
    (r"(?:gnu )?lesser general public license,? ?(?:version |v)?3(?:\.0)?|(?:gnu )?lgpl[ -]?v?3(?:\.0)?", "LGPL-3.0"),
    (r"gnu general public license,? ?(?:version |v)?2(?:\.0)?|(?:gnu )?gpl[ -]?v?2(?:\.0)?", "GPL-2.0"),
    (r"gnu general public license,? ?(?:version |v)?3(?:\.0)?|(?:gnu )?gpl[ -]?v?3(?:\.0)?", "GPL-3.0"),
    (r"gnu general public license|gnu gpl|gpl", "GPL"),
    (r"apache(?: software)? license,? ?(?:version |v)?2(?:\.0)?|apache[ -]2(?:\.0)?", "Apache-2.0"),
    (r"mozilla public license,? ?(?:version |v)?2\.0|mpl[ -]?2\.0", "MPL-2.0"),
    (r"eclipse public license,? ?(?:version |v)?2\.0|epl[ -]?2\.0", "EPL-2.0"),
    (r"(?:the )?(?:3-clause|new|revised|modified) bsd|bsd[ -]3-clause", "BSD-3-Clause"),
    (r"(?:the )?(?:2-clause|simplified) bsd|bsd[ -]2-clause", "BSD-2-Clause"),
    (r"bsd", "BSD"),
    (r"(?:mit|expat|mit/x11|x11)", "MIT"),
    (r"isc", "ISC"),
    (r"zlib", "Zlib"),
    (r"boost software license,? ?(?:version |v)?1\.0|bsl-1\.0", "BSL-1.0"),
    (r"unlicense", "Unlicense"),
    (r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:noncommercial|non-commercial|nc)[ -](?:sharealike|share-alike|sa)[ -]?(?:[1-4]\.0)?", "CC-BY-NC-SA"),
    (r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:noncommercial|non-commercial|nc)[ -](?:noderivatives|noderivs|no-derivatives|nd)[ -]?(?:[1-4]\.0)?", "CC-BY-NC-ND"),
    (r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:noncommercial|non-commercial|nc)[ -]?(?:[1-4]\.0)?", "CC-BY-NC"),
    (r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:sharealike|share-alike|sa)[ -]?(?:[1-4]\.0)?", "CC-BY-SA"),
    (r"(?:creative commons|cc)[ -](?:attribution|by)[ -](?:noderivatives|noderivs|no-derivatives|nd)[ -]?(?:[1-4]\.0)?", "CC-BY-ND"),
    (r"(?:creative commons|cc)[ -](?:attribution|by)[ -]?(?:[1-4]\.0)?", "CC-BY"),
    (r"(?:creative commons )?cc0(?:[ -]1\.0)?", "CC0-1.0"),
]
_TAIL = r"(?: (?:or|and) (?:\(at your option\) )?(?:any )?later(?: versions?)?|\+|[ -]or-later|[ -]only)?(?: (?:international|universal|unported))?(?: (?:public )?license| licenses)?(?: \(.{1,40}\))?(?:[,;:].*)?"
_SUBJECT = r"(?:(?:this|the|our|all) (?:file|files|work|works|software|project|program|document|documentation|text|code|source code|content|library|module|package|article|page|data|dataset)|it|content|code|text)"
_VERB = r"(?:licensed|released|distributed|redistributed|published|provided|available|made available|used|covered)(?: to you)?(?: by .{1,40})? (?:under|by)"
_GRANT = rf"(?:{_SUBJECT} (?:is|are|may be|has been|have been) (?:dual[ -])?|(?:unless otherwise noted, )?){_VERB}(?: the)?(?: terms(?: and conditions)? of)?(?: (?:the|a|an))? "

#: Sentences of the licences' own texts and of notices, normalised, with a gap where they name someone.
SENTENCES = [
    ("SpdxTag", r"spdx-license-identifier: ?(?P<spdx>[a-z0-9.+()-]+(?: (?:or|and|with) [a-z0-9.+()-]+)*)"),
    ("Copyright", r"(?:copyright|\(c\)|©)(?: (?:copyright|\(c\)|©))?,? ?(?:\(c\) )?[0-9]{4}.{0,120}"),
    ("AllRights", r"(?:.{0,80})?all rights reserved"),
    ("MitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.*"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitWarranty", r'the software is provided "as is", without warranty of any kind.*'),
    ("MitLiability", r"in no event shall the (?:authors|author) or copyright holders? be liable for any claim.*"),
    ("IscGrant", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("IscWarranty", r'the software is provided "as is" and the author disclaims all warranties.*'),
    ("IscLiability", r"in no event shall the author be liable for any special, direct, indirect.*"),
    ("BsdGrant", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BsdSource", r"(?:[0-9][.)]? ?)?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BsdBinary", r"(?:[0-9][.)]? ?)?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.*"),
    ("BsdEndorse", r"(?:[0-9][.)]? ?)?neither the names? of .{1,120} may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdWarranty", r'this software is provided by .{1,80} "as is" and any express or implied warranties.*'),
    ("BsdLiability", r"in no event shall .{1,80} be liable for any direct, indirect, incidental.*"),
    ("GplGrant", r"this (?:program|software|file|library) is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?P<gpl>(?:affero |lesser |library )?general public license) as published by the free software foundation[,;] (?:either )?version (?P<version>[0-9.]+) of the license(?P<later>,? or \(at your option\) any later version)?.*"),
    ("GplWarranty", r"this (?:program|software|file|library) is distributed in the hope that it will be useful, but without any warranty.*"),
    ("GplDetails", r"see the gnu (?:affero |lesser |library )?general public license for more details"),
    ("GplCopy", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license.*"),
    ("ApacheGrant", r'licensed under the apache license, version 2\.0 \(the "license"\).*'),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at.*"),
    ("ApacheWarranty", r'unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis.*'),
    ("ApacheLimits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MplGrant", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file.*"),
    ("ZlibWarranty", r"this software is provided 'as-is', without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("ZlibOrigin", r"(?:[0-9][.)]? ?)?the origin of this software must not be misrepresented.*"),
    ("ZlibAltered", r"(?:[0-9][.)]? ?)?altered source versions must be plainly marked as such.*"),
    ("ZlibNotice", r"(?:[0-9][.)]? ?)?this notice may not be removed or altered from any source distribution"),
    ("BoostGrant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("BoostNotice", r"the copyright notices in the software and this entire statement, including the above license grant.*"),
    ("UnlicenseFree", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.*"),
    ("Cc0Waiver", r"to the extent possible under law, .{1,120} (?:has|have) waived all copyright and related or neighbou?ring rights to .*"),
    ("PublicDomain", r".{0,60}(?:is|are) (?:free and unencumbered software )?(?:released into|dedicated to|placed in(?:to)?|in) the public domain.*"),
    ("Confidential", r"(?:this (?:file|document|work) is )?(?:proprietary and confidential|confidential and proprietary).*"),
    ("NoCopying", r"unauthorized copying of .{1,80} is strictly prohibited.*"),
]

#: Rules over sentence identifiers, in order. An identifier with a question mark may be missing; ``Grant:`` and ``Gpl:`` carry a licence's name.
RULES = [
    ("MIT", "MitGrant MitNotice MitWarranty? MitLiability?"),
    ("ISC", "IscGrant IscWarranty? IscLiability?"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse BsdWarranty? BsdLiability?"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdWarranty? BsdLiability?"),
    ("Apache-2.0", "ApacheGrant ApacheUse? ApacheCopy? ApacheWarranty? ApacheLimits?"),
    ("MPL-2.0", "MplGrant MplCopy?"),
    ("Zlib", "ZlibWarranty? ZlibGrant ZlibOrigin? ZlibAltered? ZlibNotice?"),
    ("BSL-1.0", "BoostGrant BoostNotice? MitWarranty?"),
    ("Unlicense", "PublicDomain? UnlicenseFree MitWarranty? MitLiability?"),
    ("CC0-1.0", "Cc0Waiver"),
    ("{}", "Gpl:* GplWarranty? GplDetails? GplCopy?"),
    ("{}", "Spdx:*"),
    ("{}", "Grant:* ApacheUse? ApacheCopy? ApacheWarranty? ApacheLimits?"),
    ("Public-Domain", "PublicDomain"),
    ("Proprietary", "Confidential NoCopying?"),
    ("Proprietary", "NoCopying"),
    ("Proprietary", "Copyright? AllRights"),
    ("", "Copyright"),
]

#: Kinds of licences, the strictest last.
KINDS = ["none", "permissive", "copyleft", "noncommercial", "proprietary", "unknown"]
_COPYLEFT = ("GPL", "LGPL", "AGPL", "MPL", "EPL", "CC-BY-SA")

#: Characters of a sentence, normalised, in which each pattern that can go on without end has found all that it asks for, and each other one has ended.
HEAD = 600
_LEAD = re.compile(r"^[ \t]*(?:[#*;%!>|]+|//+|--+|/\*+|\"\"\"|''')?[ \t]*(?:\*/)?", re.MULTILINE)
_END = re.compile(r"(?<!\binc)(?<!\bltd)(?<!\bcorp)(?<!\bco)(?<! v)[.!?](?=[\"')]*(?:\s|\Z))|:(?=[ \t]*\n)|\n[ \t]*\n", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
_GRANTS = [(name, re.compile(_GRANT + f"(?:{pattern}){_TAIL}")) for pattern, name in NAMES]
_ORDER = {name: k for k, name in enumerate([*(name for name, _ in SENTENCES), *(f"Grant:{name}" for _, name in NAMES)])}
_BEGINS = re.compile("|".join(re.sub(r"\?P<[a-z]+>", "?:", pattern) for _, pattern in SENTENCES) + f"|{_GRANT}(?:{'|'.join(pattern for pattern, _ in NAMES)})")
_RULES = [(name, [(i.rstrip("?"), i.endswith("?")) for i in rule.split()]) for name, rule in RULES]


def _stems(pattern: str) -> list[str]:
    """Pieces of which every match of a pattern holds one: the longest outside of its groups, or else the choices of its first group that may not be missing."""
    flat = re.sub(r"\\.|\[[^\]]*\]", "\0", pattern)
    while (inner := re.sub(r"\([^()]*\)", "\0", flat)) != flat:
        flat = inner
    if found := re.findall(r"(?<![a-z])[a-z][a-z ,;:/\"'-]+[a-z](?![a-z?*{])", flat):
        return [max(found, key=len)]
    must = re.sub(r"^(?:\((?:[^()\\]|\\.|\([^()]*\))*\)\?)+", "", pattern)
    return re.match(r"\(\?:((?:[^()\\]|\\.)+)\)", must)[1].split("|")


#: Which entries of the sentence table a piece of text may belong to, and the grants' verbs. A normalised text without any of these has no licence sentence, so it is not split at all.
_BY_STEM = {stem: [k for k, (_, p) in enumerate(SENTENCES) if stem in _stems(p)] for _, pattern in SENTENCES for stem in _stems(pattern)}
STEMS = re.compile("|".join([*sorted(_BY_STEM), _VERB]))
_VERBS = re.compile(_VERB)


def lookup(sentence: str) -> list[int]:
    """Entries of the sentence table whose stems a normalised sentence holds, in the table's order: all that can fit."""
    return sorted({k for stem, entries in _BY_STEM.items() if stem.replace("\\", "") in sentence for k in entries})


def normalise(sentence: str) -> str:
    """Lower case, straight quotes, one spelling, single spaces, no final mark."""
    s = _SPACE.sub(" ", sentence).strip().lower()
    for a, b in (("“", '"'), ("”", '"'), ("``", '"'), ("''", '"'), ("‘", "'"), ("’", "'"), ("licence", "license")):
        s = s.replace(a, b)
    return s.strip(" .:!?")


def identify(sentence: str) -> str | None:
    """The identifier of a normalised sentence: of the entries that its stems lead to, the first that fits with its gaps."""
    for name, pattern in map(_KNOWN.__getitem__, lookup(sentence)):
        if m := pattern.fullmatch(sentence):
            if name == "SpdxTag":
                return "Spdx:" + m["spdx"].replace(" ", "_")
            if name == "GplGrant":
                kind = {"a": "AGPL", "l": "LGPL"}.get(m["gpl"][0], "GPL")
                version = m["version"].rstrip(".")
                return f"Gpl:{kind}-{version if '.' in version else version + '.0'}" + ("-or-later" if m["later"] else "")
            return name
    for name, pattern in _GRANTS if _VERBS.search(sentence) else ():
        if pattern.fullmatch(sentence):
            return f"Grant:{name}"
    return None


def sentence_ids(text: str) -> list[str]:
    """Identifiers of a text's licence sentences, in order.

    A sentence ends at a mark, a colon that ends its line, or an empty line, or where a line ends: lines that run into a licence
    sentence or follow it without an end between them are not part of it.
    """
    text = _LEAD.sub("", text)
    if not STEMS.search(normalise(text)):
        return []
    found, at = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        sentence, at = text[at:end], end
        if STEMS.search(normalise(sentence)):
            found += _in_lines(sentence.split("\n"))
    return found


def _in_lines(lines: list[str]) -> list[str]:
    """Identifiers of the sentences that whole lines in a row make up, in order.

    From the last line to the first, each line learns the sentence that begins with it and ends before the next one begins, of
    several the longest by the first pattern that fits; if none does, the shortest that goes on beyond. ``AllRights`` begins with whatever stands before it, so it ends no other sentence.
    """
    known = [normalise(line) for line in lines]
    begins, here = len(lines), {}
    for i in range(len(lines) - 1, -1, -1):
        # what a pattern asks for is within HEAD characters of its beginning, so a longer run of lines has no other sentence
        end, size = i, 0
        while end < len(lines) and (end == i or size < HEAD):
            size += len(known[end]) + 1
            end += 1
        if not _BEGINS.match(normalise("\n".join(lines[i:end]))):
            continue
        within, beyond = range(min(begins, end), i, -1), range(begins + 1, end + 1)
        names = [(n, j) for j in within if (n := identify(normalise("\n".join(lines[i:j]))))]
        # the first pattern that fits counts, as in a sentence with marks
        name, stop = min(names, key=lambda f: _ORDER.get(f[0], 0), default=None) or next(((n, j) for j in beyond if (n := identify(normalise("\n".join(lines[i:j]))))), (None, i))
        if name:
            here[i] = name, stop
            if name != "AllRights":
                begins = i
    found, i = [], 0
    while i < len(lines):
        name, i = here.get(i, (None, i + 1))
        if name:
            found.append(name)
    return found


def licenses(ids: list[str]) -> tuple[list[str], list[str]]:
    """Licences that the rules find, in order of place, and identifiers that none takes."""
    left: list[str | None] = list(ids)
    found: list[tuple[int, str]] = []
    for name, rule in _RULES:
        i = 0
        while i < len(left):
            j, part = i, ""
            for want, optional in rule:
                here = left[j] if j < len(left) else None
                if here is not None and (here == want or (want.endswith("*") and here.startswith(want[:-1]))):
                    part, j = (here.partition(":")[2] or part), j + 1
                elif not optional:
                    j = i
                    break
            if j > i:
                if name:
                    found.append((i, name.format(part)))
                left[i:j] = [None] * (j - i)
                i = j
            else:
                i += 1
    return [name for _, name in sorted(found, key=lambda f: f[0])], [x for x in left if x is not None]


def kind(name: str) -> str:
    upper = name.upper()
    if "-NC" in upper or "-ND" in upper:
        return "noncommercial"
    if upper == "PROPRIETARY":
        return "proprietary"
    return "copyleft" if upper.startswith(_COPYLEFT) else "permissive"


def scan_text(text: str | None) -> tuple[list[str], list[str], str]:
    """Sentence identifiers, licences (each once, as they first stand) and the verdict, the strictest of their kinds."""
    ids = sentence_ids(text or "")
    names, rest = licenses(ids)
    kinds = {kind(n) for n in names} | ({"unknown"} if rest else set()) | {"none"}
    return ids, list(dict.fromkeys(names)), max(kinds, key=KINDS.index)


def scan(docs: DataFrame) -> DataFrame:
    """Every row's licence sentences, licences and verdict, in one pass without a shuffle.

    A null or empty text has none; a null id stays null; rows with equal ids, and rows that repeat, each get a row; a long text is
    read whole; of entries that fit a sentence alike the first in the table counts; an empty table gives an empty one; other columns
    stay behind, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [scan_text(t) for t in block.column("text").to_pylist()]
            columns = [pa.array([len(i) for i, _, _ in found], pa.int64()), pa.array([",".join(i) for i, _, _ in found], pa.string()), pa.array([",".join(n) for _, n, _ in found], pa.string()), pa.array([v for *_, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return to_python(keyed_texts(docs), run, SCHEMA)
