import pytest

from meterql.llm import licenses as lic
from tests.llm.helpers import docs

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in it.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
"""
ENDORSE = "3. Neither the name of the owner nor the names of its contributors may be used to endorse products.\n"
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.example.com/LICENSE
"""


@pytest.mark.parametrize("text, want", [
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("Released under the MIT License.", ["MIT"]),
    ("some prose.\nLicensed under the Apache License, Version 2.0.\nmore prose", ["Apache-2.0"]),
    ("// SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("available under the Creative Commons Attribution-ShareAlike 4.0 licence.", ["CC-BY-SA-4.0"]),
    ("It is distributed under the three-clause BSD licence.", ["BSD-3-Clause"]),
    (MIT, ["MIT"]), (BSD, ["BSD-2-Clause"]), (BSD + ENDORSE, ["BSD-3-Clause"]), (APACHE, ["Apache-2.0"]),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
    ("a driving license and a permission slip", []), ("", []), (None, []),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]),
])
def test_rules(text, want):
    assert [m.license for m in lic.scan(text)[0]] == want


#: A statement of each known sentence, as it is written.
STATED = {
    "spdx": "SPDX-License-Identifier: MIT", "gpl_reference": "Released under the GNU General Public License v2",
    "gpl_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl_no_warranty": "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "gpl_copy": "You should have received a copy of the GNU General Public License",
    "gpl_details": "See the GNU General Public License for more details", "apache_grant": "Licensed under the Apache License, Version 2.0", "apache_reference": "Available under the Apache Software License 2.0",
    "apache_compliance": "you may not use this file except in compliance with the License", "apache_obtain": "You may obtain a copy of the License at",
    "apache_basis": 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND', "apache_see": "See the License for the specific language governing permissions and limitations",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit_notice": "The above copyright notice and this permission notice shall be included in all copies",
    "as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE", "mit_reference": "Published under the MIT licence",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd_source": "Redistributions of source code must retain the above copyright notice", "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd_endorse": "Neither the name of X nor the names of its contributors may be used to endorse", "bsd_reference": "Distributed under the new BSD license", "mpl_reference": "subject to the terms of the Mozilla Public License, v2.0",
    "mpl_short": "Available under the Mozilla Public License 2.0", "cc_reference": "Released under CC BY 4.0", "public_domain": "placed into the public domain",
    "gpl_short": "Released under the GNU GPL v2 or later", "zero_grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "isc_as_is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES', "isc_liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
    "isc_reference": "Licensed under the ISC License", "bsd_advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_as_is": 'THIS SOFTWARE IS PROVIDED BY THE OWNERS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES', "bsd_liability": "IN NO EVENT SHALL THE OWNERS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "mpl_obtain": "If a copy of the MPL was not distributed with this file", "epl_reference": "made available under the terms of the Eclipse Public License v2.0", "cddl_reference": "subject to the terms of the Common Development and Distribution License",
    "eupl_reference": "Licensed under the EUPL, Version 1.2", "boost_reference": "Distributed under the Boost Software License, Version 1.0", "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_liability": "In no event will the authors be held liable for any damages arising from the use of this software", "zlib_origin": "The origin of this software must not be misrepresented",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "zlib_altered": "Altered source versions must be plainly marked as such", "zlib_notice": "This notice may not be removed or altered from any source distribution", "zlib_reference": "Released under the zlib/libpng license",
    "artistic_reference": "Distributed under the Artistic License 2.0", "perl_terms": "you can redistribute it and/or modify it under the same terms as Perl itself", "ofl_reference": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "wtfpl_reference": "Released under the WTFPL", "cc_zero": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "confidential": "Unauthorized copying of this file",
    "unlicense": "This is free and unencumbered software released into the public domain", "proprietary": "All rights reserved",
}


@pytest.mark.parametrize("name", [name for name, _ in lic.SENTENCES])
def test_each_known_sentence_is_met_alone_and_broken_across_lines(name):
    def met(text):
        found, rest = lic.scan(text)
        return [m.license for m in found] + rest

    want = met(STATED[name])
    assert len(want) == 1
    for mark in ("", " * ", "# ", "// ", "-- ", "  "):
        assert met(mark + STATED[name].replace(" ", "\n" + mark).replace(":\n" + mark, ": ") + ".") == want


GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of FITNESS.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program."""
WHOLE_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at

    http://www.example.com/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote it.
2. Altered source versions must be plainly marked as such, and must not be misrepresented.
3. This notice may not be removed or altered from any source distribution."""
TEN = [
    (MIT, "MIT"), (GPL, "GPL-3.0-or-later"), (GPL.replace("General", "Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1-or-later"), (WHOLE_APACHE, "Apache-2.0"),
    ("Copyright (c) 2020, X. All rights reserved.\n\n" + BSD, "BSD-2-Clause"), ("Copyright (c) 2020, X\nAll rights reserved.\n\n" + BSD + ENDORSE, "BSD-3-Clause"), (ISC, "ISC"), (ZLIB, "Zlib"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.example.org/MPL/2.0/.", "MPL-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
]


@pytest.mark.parametrize("text, want", TEN)
def test_ten_licences_as_comments_of_all_kinds(text, want):
    lines = text.split("\n")
    forms = [text, "/*\n" + "\n".join(" * " + x for x in lines) + "\n */\nint x;", "\n".join("# " + x for x in lines) + "\nx = 1", "\n".join("// " + x for x in lines),
             "<!--\n" + text + "\n-->\n<p>x</p>", "<!--\n" + "\n".join("  -- " + x for x in lines) + "\n-->", "\n".join(";; " + x for x in lines), '\"\"\"' + text + '\"\"\"', " ".join(text.split())]
    for form in forms:
        found, rest = lic.scan(form)
        assert ([m.license for m in found], rest) == ([want], []), form


def test_known_sentences_against_every_template_tried_everywhere():
    """The look-up by needed words finds what trying each template on each sentence finds."""
    import random

    rng, pieces = random.Random(8), [*STATED.values(), "some words", "1. a list", "x", "licence plate", "All\n * rights reserved"]
    for _ in range(150):
        text = "".join(rng.choice(pieces) + rng.choice([". ", "\n", ".\n\n", ", and ", "\n# "]) for _ in range(rng.randrange(1, 6)))
        plain, want = lic.blanked(text), []
        for a, b in lic.sentences(plain):
            words, end = lic.normalise(plain[a:b]), 0
            for start, stop, k in sorted((m.start(), -m.end(), k) for k, (_, p) in enumerate(lic._KNOWN) for m in p.finditer(words)):
                if start >= end:
                    want.append((lic.SENTENCES[k][0], a, b))
                    end = -stop
        assert [x[:3] for x in lic.known_sentences(text)] == want


def test_all_rights_reserved():
    assert [m.license for m in lic.scan("All rights reserved.")[0]] == ["Proprietary"]
    assert [m.license for m in lic.scan("All rights reserved. Licensed under CC BY 4.0.")[0]] == ["CC-BY-4.0"]
    assert [m.license for m in lic.scan("SPDX-License-Identifier: MIT OR Apache-2.0\nx")[0]] == ["MIT OR Apache-2.0"]


def test_long_sentence_and_repeats_in_one():
    text = "word " * 100_000 + "released under the MIT License and released under the MIT License " + "word " * 1000
    found, _ = lic.scan(text)
    assert [m.license for m in found] == ["MIT", "MIT"] and {(m.start, m.end) for m in found} == {(0, len(text.rstrip()))}


def test_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    rows = lic.findings(docs(spark, ["Licensed under CC BY 4.0.", "x"], [big, None])).collect()
    assert sorted((r.doc_id or 0, r.licenses) for r in rows) == [(0, []), (big, ["CC-BY-4.0"])]


def test_statements_without_the_word_licence():
    assert [m.license for m in lic.scan("Made available under Creative Commons Attribution-ShareAlike 3.0.")[0]] == ["CC-BY-SA-3.0"]
    assert [m.license for m in lic.scan("Released under CC BY 4.0.")[0]] == ["CC-BY-4.0"]


def test_order_of_sentences_matters():
    found, rest = lic.scan("The above copyright notice and this permission notice shall be included in all copies.")
    assert not found and rest == ["mit_notice"]


def test_spans_and_long_texts():
    line = "Licensed under CC BY-NC 4.0."
    text = "word word. " * 50_000 + "\n" + line
    (m,), _ = lic.scan(text)
    assert text[m.start:m.end] == line


def test_rows(spark):
    rows = lic.findings(docs(spark, [None, "", MIT, MIT + "\n\n" + MIT], [0, 1, 2, 2], ["licenses"])).collect()
    assert sorted((r.doc_id, r.licenses, len(r.findings)) for r in rows) == [(0, [], 0), (1, [], 0), (2, ["MIT"], 1), (2, ["MIT"], 2)]
    assert lic.findings(docs(spark, [])).collect() == []
