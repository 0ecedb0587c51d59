r"""License scans by sentence-rule recognition.

A text is normalised as a whole: line-leading comment marks are blanked in place
(so every offset still holds), A-Z are lower-cased, and what remains is its words,
without punctuation and white space, "licence" spelt as "license". It is cut into
sentences where a stop, exclamation or question mark is followed by white space
or a quote, and at blank lines; list marks are no words and need no cut. Each
normalised sentence is looked up among the known licence sentences, templates
with slots for version and variant, by the words that every sentence of a
template holds; that gives identifiers, in order, several where one sentence
states several.

The sequence of identifiers, sentences that say nothing of licences left out, is
then matched against ordered licence rules: at each place the first rule that
stands there names a licence and takes its sentences. A rule's sentence may be
optional, so "all rights reserved" in front of an open licence belongs to it and
names a licence of its own only where none follows. A sentence that no rule takes
is reported as unmatched.

Defined edge cases: null and empty texts have no findings; a licence stated
twice is found twice (and listed once in `licenses`); templates that begin at the
same word: the longest wins, of equally long ones the first listed; a sentence of
any length is looked at whole; repeated rows and rows without an id each get a
row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterql.llm.common import by_rows, utf8

_UNDER = r"(?:licensed|released|distributed|available|published|provided|covered|governed) (?:to you )?(?:under|by) (?:the terms (?:and conditions )?of )?(?:an? )?(?:the )?"
_V = r"(?:version |v |v)?(?P<v>\d+(?:\.\d+)?)"
_GNU = r"(?:gnu )?(?P<k>lesser |library |affero )?"
#: Known sentences in normal form: (identifier, template). Slots: v (version), k (kind), l (or later).
SENTENCES = (
    ("spdx", r"spdx license identifier (?P<k>[a-z0-9.+]+)"),
    ("gpl_terms", rf"redistribute it and or modify it under the terms of the {_GNU}general public license (?:{_V.replace('?P<v>', '?P<w>')} )?as published by the free software foundation (?:either )?{_V} of the license(?P<l> or at your option any later version)?"),
    ("gpl_reference", _UNDER + rf"{_GNU}(?:general )?public license(?: {_V})?(?P<l> or (?:at your option )?(?:any )?later)?"),
    ("gpl_short", _UNDER + r"gnu (?P<k>a|l)?gpl(?: ?" + _V + r")?(?P<l> or (?:any )?later)?"),
    ("gpl_no_warranty", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl_copy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("gpl_details", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("apache_grant", rf"licensed under the apache license {_V}(?: the license)?"),
    ("apache_reference", _UNDER + rf"apache(?: software)? license(?: {_V})?"),
    ("apache_compliance", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache_obtain", r"you may obtain a copy of the license at"),
    ("apache_basis", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache_see", r"see the license for the specific language governing permissions and limitations"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("as_is", r"the software is provided as is without warranty of any kind"),
    ("mit_liability", r"in no event shall the authors or copyright holders be liable"),
    ("mit_reference", _UNDER + r"(?:mit|expat) license"),
    ("isc_grant", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zero_grant", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_as_is", r"the software is provided as is and the author disclaims all warranties"),
    ("isc_liability", r"in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("isc_reference", _UNDER + r"isc license"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd_advert", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd_endorse", r"neither the names? of .* may be used to endorse"),
    ("bsd_as_is", r"this software is provided by .* as is and any express or implied warranties"),
    ("bsd_liability", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd_reference", _UNDER + r"(?:(?P<k>[0234]|two|three|four|new|simplified|modified) (?:clause )?)?bsd(?: (?P<v>[0234]) clause)?(?: style)? license"),
    ("mpl_reference", rf"subject to the terms of the mozilla public license {_V}"),
    ("mpl_short", _UNDER + rf"mozilla public license(?: {_V})?"),
    ("mpl_obtain", r"if a copy of the mpl was not distributed with this file"),
    ("epl_reference", _UNDER + rf"eclipse public license(?: {_V})?"),
    ("cddl_reference", r"(?:under|to) the terms of the common development and distribution license"),
    ("eupl_reference", _UNDER + rf"(?:european union public license|eupl)(?: {_V})?"),
    ("boost_reference", _UNDER + rf"boost software license(?: {_V})?"),
    ("zlib_as_is", r"this software is provided as is without any express or implied warranty"),
    ("zlib_liability", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib_origin", r"the origin of this software must not be misrepresented"),
    ("zlib_altered", r"altered source versions must be plainly marked as such"),
    ("zlib_notice", r"this notice may not be removed or altered from any source distribution"),
    ("zlib_reference", _UNDER + r"zlib(?: libpng)? license"),
    ("artistic_reference", _UNDER + rf"artistic license(?: {_V})?"),
    ("perl_terms", r"redistribute it and or modify it under the same terms as perl itself"),
    ("ofl_reference", _UNDER + rf"sil open font license(?: {_V})?"),
    ("wtfpl_reference", _UNDER + r"(?:wtfpl|do what the fuck you want to public license)"),
    ("cc_reference", _UNDER + r"(?:cc|creative commons) (?P<k>by(?: nc)?(?: sa| nd)?|attribution(?: non ?commercial)?(?: share ?alike| no ?derivatives| no ?derivs)?|zero|0)(?: international| unported)?(?: license)?(?: (?:v )?(?P<v>\d\.\d))?"),
    ("cc_zero", r"to the extent possible under law .* has waived all copyright and related or neighbou?ring rights"),
    ("public_domain", r"(?:dedicated to|placed in(?:to)?|released (?:in)?to|is in) the public domain"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense_anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("confidential", r"proprietary and confidential|unauthorized copying of this file"),
    ("proprietary", r"all rights reserved"),
)
_GPL = {"": "GPL", "lesser ": "LGPL", "library ": "LGPL", "affero ": "AGPL", "a": "AGPL", "l": "LGPL"}
_CC = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd"}
#: Ordered rules: (licence, identifiers in order; one with a question mark may be missing). The variant and version of the first
#: identifier that must stand complete the name.
RULES = tuple((family, tuple(sequence.split())) for family, sequence in (
    ("SPDX", "proprietary? spdx"),
    ("GNU", "proprietary? gpl_terms gpl_no_warranty? gpl_details? gpl_copy?"),
    ("GNU", "proprietary? gpl_reference gpl_no_warranty? gpl_details? gpl_copy?"),
    ("GNU", "proprietary? gpl_short"),
    ("Apache", "proprietary? apache_grant apache_compliance? apache_obtain? apache_basis? apache_see?"),
    ("Apache", "proprietary? apache_reference apache_compliance? apache_obtain? apache_basis? apache_see?"),
    ("MIT", "proprietary? mit_grant mit_notice? as_is? mit_liability?"),
    ("MIT", "proprietary? mit_reference"),
    ("ISC", "proprietary? isc_grant isc_as_is? isc_liability?"),
    ("0BSD", "proprietary? zero_grant isc_as_is? isc_liability?"),
    ("ISC", "proprietary? isc_reference"),
    ("BSD-4-Clause", "proprietary? bsd_grant bsd_source bsd_binary bsd_advert bsd_endorse? bsd_as_is? bsd_liability?"),
    ("BSD-3-Clause", "proprietary? bsd_grant bsd_source bsd_binary bsd_endorse bsd_as_is? bsd_liability?"),
    ("BSD-2-Clause", "proprietary? bsd_grant bsd_source bsd_binary bsd_as_is? bsd_liability?"),
    ("BSD", "proprietary? bsd_reference"),
    ("MPL", "proprietary? mpl_reference mpl_obtain?"),
    ("MPL", "proprietary? mpl_short mpl_obtain?"),
    ("EPL", "proprietary? epl_reference"),
    ("CDDL-1.0", "proprietary? cddl_reference"),
    ("EUPL", "proprietary? eupl_reference"),
    ("BSL", "proprietary? boost_reference"),
    ("Zlib", "proprietary? zlib_as_is zlib_liability? zlib_grant zlib_origin? zlib_altered? zlib_notice?"),
    ("Zlib", "proprietary? zlib_grant zlib_origin? zlib_altered? zlib_notice?"),
    ("Zlib", "proprietary? zlib_reference"),
    ("Artistic", "proprietary? artistic_reference"),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", "proprietary? perl_terms"),
    ("OFL", "proprietary? ofl_reference"),
    ("WTFPL", "proprietary? wtfpl_reference"),
    ("CC", "proprietary? cc_reference"),
    ("CC0-1.0", "cc_zero"),
    ("Unlicense", "unlicense unlicense_anyone? as_is?"),
    ("Public-Domain", "public_domain"),
    ("Proprietary", "proprietary? confidential"),
    ("Proprietary", "proprietary"),
))
_RULES = [(family, next(x for x in sequence if x[-1] != "?"), re.compile("".join(f"(?:{x[:-1]} )?" if x[-1] == "?" else f"{x} " for x in sequence))) for family, sequence in RULES]


def _needed(pattern: str) -> str:
    """The longest literal text that every match of pattern holds."""
    runs = [""]
    for op, value in _parser.parse(pattern):
        if op is _parser.LITERAL:
            runs[-1] += chr(value)
        else:
            runs.append("")
    return max(runs, key=len)


def _index() -> ahocorasick.Automaton:
    """Finds the words that templates need; a template of alternatives has those of each."""
    found = ahocorasick.Automaton()
    by_words: dict[str, list[int]] = {}
    for k, (_, pattern) in enumerate(SENTENCES):
        for part in [pattern] if _needed(pattern) else pattern.split("|"):
            by_words.setdefault(_needed(part), []).append(k)
    for words, ks in by_words.items():
        found.add_word(words, tuple(ks))
    found.make_automaton()
    return found


_KNOWN = [(name, re.compile(rf"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])")) for name, pattern in SENTENCES]
_NEEDED = _index()
_END = re.compile(r"(?<=[.!?])(?<![^a-zA-Z][vV]\.)(?=[\s\"')])|\n\s*\n")
_MARK = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|--+>?|;+|<!--+|%+|\"\"\"|'''|(?:rem|REM|dnl)(?=[ \t]))")
_DOT = re.compile(rb"(?<![0-9])\.|\.(?![0-9])")  # a dot outside a version
#: Every byte to its lower-case letter, digit or dot, or to a space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 46 else 32 for c in range(256))
_SPDX = re.compile(r"(?i)spdx-license-identifier:\s*([a-z0-9.+-]+(?:\s(?:or|and|with)\s[a-z0-9.+-]+)*)")


@dataclass(frozen=True)
class Match:
    license: str
    start: int
    end: int


def blanked(text: str) -> str:
    """The text without the comment marks that lines begin with; spaces stand in for them."""
    return _MARK.sub(lambda m: " " * len(m[0]), text)


def normalise(sentence: str) -> str:
    """The words of a sentence without its marks."""
    return b" ".join(_DOT.sub(b" ", utf8(sentence).translate(_TABLE)).split()).replace(b"licence", b"license").decode()


def sentences(plain: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text without marks; a line that ends without a stop goes on in the next one."""
    out, at = [], 0
    for start, end in [*(m.span() for m in _END.finditer(plain)), (len(plain), len(plain))]:
        if body := plain[at:start].strip():
            first = plain.index(body[0], at)
            out.append((first, first + len(body)))
        at = end
    return out


def _named(family: str, m: re.Match, sentence: str) -> str:
    own = m.groupdict()
    kind, version, later = own.get("k") or "", own.get("v") or "", bool(own.get("l"))
    full = version if not version or "." in version else version + ".0"
    if family == "SPDX":
        return " ".join(written[1].rstrip(".").split()) if (written := _SPDX.search(sentence)) else kind.upper()  # as it is written
    if family == "GNU":
        return _GPL[kind] + (f"-{full}{'-or-later' if later else '-only'}" if version else "")
    if family == "CC":
        if kind in ("zero", "0"):
            return "CC0-1.0"
        joined = re.sub(r"(non|share|no) (commercial|alike|derivatives|derivs)", r"\1\2", kind)
        return "CC-" + "-".join(_CC.get(x, x).upper() for x in joined.split()) + (f"-{full}" if version else "")
    if family == "BSD":
        n = {"two": "2", "simplified": "2", "three": "3", "new": "3", "modified": "3", "four": "4"}.get(kind, kind) or version
        return "0BSD" if n == "0" else f"BSD-{n}-Clause" if n else "BSD"
    return family + (f"-{full}" if version else "")


def known_sentences(text: str) -> list[tuple[str, int, int, re.Match]]:
    """(identifier, start, end, match) of the known sentences of a text, in order."""
    plain = blanked(text)
    if next(_NEEDED.iter(normalise(plain)), None) is None:  # the whole normalised text holds no template's words
        return []
    out = []
    for a, b in sentences(plain):
        words = normalise(plain[a:b])
        tried = sorted({k for _, ks in _NEEDED.iter(words) for k in ks})
        found = sorted(((m.start(), -m.end(), k, m) for k in tried for m in _KNOWN[k][1].finditer(words)), key=lambda x: x[:3])
        end = 0
        for start, stop, k, m in found:  # several may stand in one sentence; the longest from the left wins
            if start >= end:
                out.append((_KNOWN[k][0], a, b, m))
                end = -stop
    return out


def scan(text: str | None) -> tuple[list[Match], list[str]]:
    """Licences found, in order, and the identifiers of known sentences that no rule took."""
    known = known_sentences(text) if text else []
    out, rest, i = [], [], 0
    names = [k[0] for k in known]
    while i < len(known):
        ahead = " ".join(names[i : i + 12]) + " "
        for family, first, pattern in _RULES:
            if m := pattern.match(ahead):
                n = m[0].count(" ")
                lead = names.index(first, i)
                out.append(Match(_named(family, known[lead][3], text[known[lead][1] : known[lead][2]]), known[i][1], known[i + n - 1][2]))
                i += n
                break
        else:
            rest.append(names[i])
            i += 1
    return out, rest


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licenses, findings, unmatched) per row: licences sorted and distinct, character spans of the sentences, end exclusive."""
    slim = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))

    def run(texts: list[str | None]) -> dict[str, list]:
        found = [scan(t) for t in texts]
        return {
            "licenses": [sorted({m.license for m in own}) for own, _ in found],
            "findings": [[{"license": m.license, "start": m.start, "end": m.end} for m in own] for own, _ in found],
            "unmatched": [rest for _, rest in found],
        }

    return by_rows(slim, run, "licenses array<string>, findings array<struct<license:string,start:long,end:long>>, unmatched array<string>")
