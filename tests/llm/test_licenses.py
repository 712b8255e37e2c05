"""Licence scans on known texts, and on the documents against a plain search for their licence lines."""

import re

import pytest

from tessera.llm import licenses as L
from tessera.llm.common import read

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.
"""
ENDORSE = " * Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
CASES = [
    (MIT, ["MIT"], "permissive"),
    (BSD, ["BSD-2-Clause"], "permissive"),
    (BSD + ENDORSE, ["BSD-3-Clause"], "permissive"),
    (GPL, ["GPL-3.0-or-later"], "copyleft"),
    ("prose that goes on\nReleased under the MIT License.\nmore", ["MIT"], "permissive"),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"], "noncommercial"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA"], "copyleft"),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], "copyleft"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT", ["apache-2.0_or_mit"], "permissive"),
    ("Copyright 2021 Acme. All rights reserved.", ["Proprietary"], "proprietary"),
    ("Copyright 2021 Acme.", [], "none"),
    ("A driving licence is no permission, and is as is.", [], "none"),
    ("See the GNU General Public License for more details.", [], "unknown"),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"], "permissive"),
    ("", [], "none"),
    (None, [], "none"),
]


@pytest.mark.parametrize("text,names,verdict", CASES)
def test_text(text, names, verdict):
    assert L.scan_text(text)[1:] == (names, verdict)


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    want = {r.doc_id: [lines[m] for m in re.findall("|".join(map(re.escape, lines)), r.text)] for r in docs.collect()}
    got = {r.doc_id: [i.partition(":")[2] for i in r.sentence_ids.split(",") if i.startswith("Grant:")] for r in L.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 200


EXAMPLES = {
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "ZlibOrigin": "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "ZlibAltered": "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "ZlibNotice": "3. This notice may not be removed or altered from any source distribution.",
    "BoostGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use it.",
    "BoostNotice": "The copyright notices in the Software and this entire statement, including the above license grant, must be included in all copies.",
    "UnlicenseFree": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.",
    "Cc0Waiver": "To the extent possible under law, Some One has waived all copyright and related or neighboring rights to This Work.",
    "SpdxTag": "SPDX-License-Identifier: MIT",
    "Copyright": "(c) 2021 Acme",
    "AllRights": "All rights\nreserved.",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MitWarranty": 'The software is provided "as is", without warranty of any kind.',
    "MitLiability": "In no event shall the authors or copyright holders be liable for any claim.",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "IscWarranty": 'The software is provided "as is" and the author disclaims all warranties.',
    "IscLiability": "In no event shall the author be liable for any special, direct, indirect damages.",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
    "BsdEndorse": "3. Neither the name of Acme may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BsdWarranty": 'This software is provided by Acme "as is" and any express or implied warranties are disclaimed.',
    "BsdLiability": "In no event shall Acme be liable for any direct, indirect, incidental damages.",
    "GplGrant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License.",
    "GplWarranty": "This program is distributed in the hope that it will be useful, but without any warranty.",
    "GplDetails": "See the GNU General Public License for more details.",
    "GplCopy": "You should have received a copy of the GNU General Public License.",
    "ApacheGrant": 'Licensed under the Apache License, Version 2.0 (the "License").',
    "ApacheUse": "You may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at:",
    "ApacheWarranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.',
    "ApacheLimits": "See the License for the specific language governing permissions and limitations under the License.",
    "MplGrant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MplCopy": "If a copy of the MPL was not distributed with this file, get one elsewhere.",
    "ZlibWarranty": "This software is provided 'as-is', without any express or implied warranty.",
    "PublicDomain": "This text is in the public\ndomain.",
    "Confidential": "Proprietary and confidential.",
    "NoCopying": "Unauthorized copying of this file, via any medium is strictly prohibited.",
}
IDS = {"SpdxTag": "Spdx:mit", "GplGrant": "Gpl:GPL-2.0"}


@pytest.mark.parametrize("name", [name for name, _ in L.SENTENCES])
def test_every_known_sentence_is_found(name):
    assert L.scan_text(EXAMPLES[name])[0] == [IDS.get(name, name)]


def test_sentence_without_the_word_licence():
    assert L.scan_text(EXAMPLES["NoCopying"])[1:] == (["Proprietary"], "proprietary")


@pytest.mark.parametrize("verb", "licensed released distributed redistributed published provided available used covered".split() + ["made available"])
@pytest.mark.parametrize("name,licence,verdict", [("CC BY-NC 4.0", "CC-BY-NC", "noncommercial"), ("CC BY-SA 4.0", "CC-BY-SA", "copyleft"), ("GPLv3", "GPL-3.0", "copyleft")])
def test_every_grant_verb_is_found(verb, name, licence, verdict):
    assert L.scan_text(f"This work is {verb}\n# under {name}.")[1:] == ([licence], verdict)
    assert L.scan_text(f"This code is {verb} by Acme under {name}.")[1:] == ([licence], verdict)


CODE = "#include <stdio.h>\nint main(void)\n{\n    return 0;\n}\n"
IN_LINES = [
    ("// SPDX-License-Identifier: MIT\n" + CODE, ["Spdx:mit"], "permissive"),
    ("// SPDX-License-Identifier: MIT\n// Copyright (c) 2020 Some One\n" + CODE, ["Spdx:mit", "Copyright"], "permissive"),
    ("# Copyright 2020 Some One\n# SPDX-License-Identifier: GPL-2.0\nimport os\n", ["Copyright", "Spdx:gpl-2.0"], "copyleft"),
    ("Copyright 2019 Some One\nCopyright 2020 Some One Else\nmore", ["Copyright", "Copyright"], "none"),
    ("Released under the MIT License\nmore text", ["Grant:MIT"], "permissive"),
    ("some text\nThis work is licensed\nunder CC BY-NC 4.0\nmore text\nUsed under the MIT License\nmore", ["Grant:CC-BY-NC", "Grant:MIT"], "noncommercial"),
    ("Licensed under the GNU General Public License,\nversion 2\n" + CODE, ["Grant:GPL-2.0"], "copyleft"),
    (GPL[:-1] + "\n" + CODE, ["Gpl:GPL-3.0-or-later"], "copyleft"),
    ("Copyright (c) 2015, Some One\nAll rights reserved.\n\n" + BSD, ["Copyright", "BsdGrant", "BsdSource", "BsdBinary"], "permissive"),
    ("Copyright (c) 2020 Some One\n" + MIT.partition("\n\n")[2], ["Copyright", "MitGrant", "MitNotice", "MitWarranty", "MitLiability"], "permissive"),
]


@pytest.mark.parametrize("text,ids,verdict", IN_LINES)
def test_sentence_ends_with_its_line(text, ids, verdict):
    assert L.scan_text(text)[::2] == (ids, verdict)


def test_many_lines_without_a_mark():
    assert len(L.scan_text("Copyright 2020\n" * 20_000)[0]) == 20_000
    assert L.scan_text("released under the mit x\n" * 2000)[0] == []


def test_rules_come_before_what_they_contain():
    for k, (_, rule) in enumerate(L._RULES):
        need = [i for i, optional in rule if not optional]
        for _, earlier in L._RULES[:k]:
            first = [i for i, optional in earlier if not optional]
            assert first != need[: len(first)] or first == need, (earlier, rule)


def test_odd_rows(spark):
    rows = [(1, None), (1, MIT), (1, MIT), (None, "Released under the MIT License."), (2, "licence " * 60_000), (3, "as is\n" * 3000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, verdict string, n_sentences int")
    assert sorted((r.doc_id or 0, r.n_sentences, r.licenses) for r in L.scan(df).collect()) == [(0, 1, "MIT"), (1, 0, ""), (1, 5, "MIT"), (1, 5, "MIT"), (2, 0, ""), (3, 0, "")]
    assert L.scan(df.limit(0)).count() == 0


def plainly(text):
    """Identifiers by a second recogniser: every piece between marks and line ends against every entry, with no lookup and no prefilter."""
    found = []
    for line in (text or "").split("\n"):
        for piece in re.split(r"(?<=[.!?])(?<!\bv\.)(?<![0-9]\.(?=[0-9]))\s+", line):
            sentence = L.normalise(piece)
            name = next((n for n, p in L._KNOWN if p.fullmatch(sentence)), None) or next((f"Grant:{n}" for n, p in L._GRANTS if p.fullmatch(sentence)), None)
            if name:
                found.append(name)
    return found


def test_documents_by_a_second_recogniser(spark):
    """All identifiers of the documents, not only those of the lines that were planted."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = {r.doc_id: plainly(r.text) for r in docs.collect()}
    got = {r.doc_id: [i for i in r.sentence_ids.split(",") if i] for r in L.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 20


ZLIB = """This software is provided 'as-is', without any express or implied warranty.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce and distribute the Software.

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software."""


@pytest.mark.parametrize("text,names", [(ZLIB, ["Zlib"]), (UNLICENSE, ["Unlicense"]), (BOOST, ["BSL-1.0"]), (EXAMPLES["Cc0Waiver"], ["CC0-1.0"])])
def test_whole_licences(text, names):
    assert L.scan_text(text)[1:] == (names, "permissive")


def test_lookup_leads_to_every_entry():
    """A sentence that an entry accepts is always among what its stems lead to."""
    for name, text in EXAMPLES.items():
        sentence = L.normalise(text)
        entries = [L.SENTENCES[k][0] for k in L.lookup(sentence)]
        fits = [n for n, p in L._KNOWN if p.fullmatch(sentence)]
        assert name in fits and set(fits) <= set(entries)
