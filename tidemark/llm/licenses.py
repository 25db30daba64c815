"""Licence scans by sentence rules.

A text is normalised (letters and digits, lower case, single spaces) with a mark
at every line break, after every address, and at punctuation before a blank.  A
known licence sentence is found where it begins and ends at a mark, whatever
marks lie inside: notices are wrapped, stand behind comment signs, and hold
colons, quotes and stops themselves.  A sentence may have a gap for a name.
Each is mapped to its identifier.  A sentence that refers to licences by their
names, after any words of its line, and a line with an SPDX expression are
mapped to an identifier for each licence that they name; names that aren't known
are passed over.  The identifiers of a text, in order and without what stands
between them, are matched against licence rules, each a sequence of
identifiers.  Rules are tried in order, the longer before the
shorter, and what a rule has matched is used up, so that a whole licence isn't
also reported as its parts.

The work is one pass over each text with SQL functions and no shuffle; texts
without a word that every known sentence holds one of aren't normalised.
Defined results: a null, empty or blank text has no sentences; repeated rows
give repeated results; other columns, whatever their names, are kept by ``scan``.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans
from tidemark.llm.common import text_or_empty

#: Sentences of public licences and notices as published; ``{name}`` stands for one to ``NAME_WORDS`` words.
SENTENCES = {
    "apache-ref": ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    "apache-may-not": ("you may not use this file except in compliance with the License", "you may not use these files except in compliance with the License"),
    "apache-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-as-is": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License",),
    "apache-title": ("Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    "apache-copyright": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ),
    "mit-ref": ("released under the MIT License", "licensed under the MIT License", "distributed under the MIT License", "available under the MIT License"),
    "mit-title": ("The MIT License (MIT)", "The MIT License", "MIT License"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    "mit-as-is": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "mit-liability": (
        "IN NO EVENT SHALL {name} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-advertising": ("All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {name}", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    "bsd-names": (
        "Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of {name} may not be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of {name} may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-as-is": ('THIS SOFTWARE IS PROVIDED BY {name} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',),
    "bsd-liability": (
        "IN NO EVENT SHALL {name} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "zero-bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "isc-as-is": ('THE SOFTWARE IS PROVIDED "AS IS" AND {name} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',),
    "isc-liability": (
        "IN NO EVENT SHALL {name} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-liability": ("In no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "zlib-origin": ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software",),
    "zlib-altered": ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",),
    "zlib-notice": ("This notice may not be removed or altered from any source distribution",),
    "boost-title": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0"),
    "boost-grant": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    ),
    "gpl-hope": (
        "This {name} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "{name} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ),
    "gpl3-ref": ("This work is licensed under the GNU General Public License, version 3",),
    "gpl2-ref": ("This work is licensed under the GNU General Public License, version 2",),
    "gpl3-title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "gpl2-title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "lgpl3-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "lgpl2.1-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "agpl3-title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "verbatim": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",),
    "mpl-ref": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "mpl-title": ("Mozilla Public License Version 2.0",),
    "epl-ref": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    "unlicense-grant": ("This is free and unencumbered software released into the public domain",),
    "unlicense-free": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
    "wtfpl-title": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",),
    "cc0-ref": ("Licensed under CC0 1.0", "CC0 1.0 Universal", "This work is licensed under CC0 1.0 Universal", "To the extent possible under law, {name} has waived all copyright and related or neighboring rights to this work"),
    "all-rights": ("All rights reserved",),
}
NAME_WORDS = 16

_GNU = {"gpl": ("General", ("2", "3")), "lgpl": ("Lesser General", ("2.1", "3")), "agpl": ("Affero General", ("3",))}
_CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def _gnu() -> dict[str, tuple[str, ...]]:
    """The notices of the three licences: their wording differs by name and version only."""
    found = {}
    for key, (kind, versions) in _GNU.items():
        terms = f"is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation"
        for v in versions:
            found[f"{key}{v}-later"] = (f"{{name}} {terms}, either version {v} of the License, or (at your option) any later version",)
            found[f"{key}{v}-only"] = (f"{{name}} {terms}, version {v} of the License", f"{{name}} {terms}, version {v}")
        found[f"{key}-details"] = (f"See the GNU {kind} Public License for more details",)
        received = f"You should have received a copy of the GNU {kind} Public License along with this {{name}}"
        found[f"{key}-received"] = (received, f"{received}; if not, see <https://www.gnu.org/licenses/>", f"{received}; if not, see <http://www.gnu.org/licenses/>")
    return found


def _creative() -> dict[str, tuple[str, ...]]:
    found = {}
    for short, long in _CREATIVE.items():
        forms = (f"Licensed under CC {short} 4.0", f"Licensed under a Creative Commons {long} 4.0 International License", f"Licensed under the Creative Commons {long} 4.0 International License", f"Creative Commons {long} 4.0 International", f"Licensed under Creative Commons {long} 4.0 International")
        found[f"cc-{short}-ref"] = forms
    return found


#: Licences by the sequences that stand for them.
_SEQUENCES = (
    ("Apache-2.0", ("apache-ref", "apache-may-not", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-ref", "apache-may-not", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-title", "apache-copyright", "apache-ref", "apache-may-not", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-title", "apache-copyright")),
    ("Apache-2.0", ("apache-ref",)),
    *(("MIT", (*title, "mit-grant", *notice, *end)) for title in (("mit-title",), ()) for notice in (("mit-notice",), ()) for end in (("mit-as-is", "mit-liability"), ("mit-as-is",), ())),
    ("MIT", ("mit-ref",)),
    *((name, ("bsd-grant", "bsd-source", "bsd-binary", *more, *end)) for name, more in (("BSD-4-Clause", ("bsd-advertising", "bsd-names")), ("BSD-3-Clause", ("bsd-names",)), ("BSD-2-Clause", ())) for end in (("bsd-as-is", "bsd-liability"), ("bsd-as-is",), ())),
    *((name, (grant, *end)) for name, grant in (("ISC", "isc-grant"), ("0BSD", "zero-bsd-grant")) for end in (("isc-as-is", "isc-liability"), ("isc-as-is",), ())),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-grant",)),
    *((f"{key.upper()}-{v if '.' in v else v + '.0'}-{which}", (f"{key}{v}-{which.removeprefix('or-')}", *end)) for key, (_, versions) in _GNU.items() for v in versions for which in ("or-later", "only") for end in (("gpl-hope", f"{key}-details", f"{key}-received"), ("gpl-hope", f"{key}-details"), ())),
    *((f"{key.upper()}-{v if '.' in v else v + '.0'}-only", (f"{key}{v}-title", "verbatim", *end)) for key, (_, versions) in _GNU.items() for v in versions for end in ((f"{key}{v}-later", "gpl-hope", f"{key}-details", f"{key}-received"), (f"{key}{v}-later", "gpl-hope", f"{key}-details"), ())),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("MPL-2.0", ("mpl-title", "mpl-ref", "mpl-copy")),
    ("MPL-2.0", ("mpl-ref", "mpl-copy")),
    ("MPL-2.0", ("mpl-ref",)),
    ("MPL-2.0", ("mpl-title",)),
    ("EPL-2.0", ("epl-ref",)),
    ("Unlicense", ("unlicense-grant", "unlicense-free")),
    ("Unlicense", ("unlicense-grant",)),
    ("WTFPL", ("wtfpl-title",)),
    ("CC0-1.0", ("cc0-ref",)),
    *((f"CC-{short.upper()}-4.0", (f"cc-{short}-ref",)) for short in _CREATIVE),
)

_VERSION = "(?:version |v )?v?"
_LATER = "(?: or(?: at your option)?(?: any)? (?:later|newer)(?: versions?)?| plus)"
_LICENCE = "licen[sc]e"

#: How running text names licences, in normal form: with the word licence, and without it.
NAMED = {
    "Apache-2.0": (f"apache(?: software)? {_LICENCE}(?: {_VERSION}2(?: 0)?)?|apache {_VERSION}2(?: 0)? {_LICENCE}", f"apache {_VERSION}2(?: 0)?"),
    "MIT": (f"mit(?: x11| expat)? {_LICENCE}|expat {_LICENCE}", "mit"),
    "BSD-3-Clause": (f"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: style)? {_LICENCE}", "bsd 3 clause|3 clause bsd"),
    "BSD-2-Clause": (f"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: style)? {_LICENCE}", "bsd 2 clause|2 clause bsd"),
    "BSD": (f"bsd(?: style)? {_LICENCE}", "bsd"),
    "ISC": (f"isc {_LICENCE}", "isc"),
    "Zlib": (f"zlib(?: libpng)? {_LICENCE}", "zlib"),
    "BSL-1.0": (f"boost software {_LICENCE}(?: {_VERSION}1 0)?", "bsl 1 0"),
    "MPL-2.0": (f"mozilla public {_LICENCE} {_VERSION}2(?: 0)?", f"mpl {_VERSION}2(?: 0)?|mplv2(?: 0)?"),
    "EPL-2.0": (f"eclipse public {_LICENCE} {_VERSION}2(?: 0)?", f"epl {_VERSION}2(?: 0)?"),
    "CC0-1.0": (f"cc0(?: 1 0)?(?: universal)? {_LICENCE}", "cc0(?: 1 0)?(?: universal)?"),
    "Unlicense": (f"unlicense(?: {_LICENCE})?", "unlicense"),
    "Artistic-1.0-Perl OR GPL-1.0-or-later": (f"same (?:terms|{_LICENCE}) as perl(?: itself)?", "same terms as perl(?: itself)?"),
}


def _gnu_named() -> dict[str, tuple[str, str]]:
    found = {}
    for key, (kind, versions) in _GNU.items():
        kinds = {"General": "", "Lesser General": "(?:lesser|library) "}.get(kind, "affero ")
        long = f"(?:gnu )?{kinds}general public {_LICENCE}(?: {key})?"
        for v in versions:
            number = v.replace(".", " ") if "." in v else f"{v}(?: 0)?"
            plain, short = f"{long} {_VERSION}{number}", f"(?:gnu )?{key}(?:v| {_VERSION}){number}"
            name = f"{key.upper()}-{v if '.' in v else v + '.0'}"
            found[f"{name}-or-later"] = (f"{plain}{_LATER}|version {number}{_LATER} of the {long}|{short}{_LATER} {_LICENCE}", f"{short}{_LATER}")
            found[f"{name}-only"] = (f"{plain}(?: only)?|version {number} of the {long}|{short} {_LICENCE}", f"{short}(?: only)?")
    return found


NAMED = _gnu_named() | NAMED
_OWN = {"Apache-2.0": "apache-ref", "MIT": "mit-ref", "MPL-2.0": "mpl-ref", "EPL-2.0": "epl-ref", "CC0-1.0": "cc0-ref", "GPL-3.0-only": "gpl3-ref", "GPL-2.0-only": "gpl2-ref", "BSL-1.0": "boost-title"}
#: The identifier of a reference to each licence.
REFERENCES = {name: _OWN.get(name, f"ref-{name.split()[0]}") for name in NAMED}
#: Exceptions of SPDX, with the licences that they are mostly used with.
EXCEPTIONS = {
    "Classpath-exception-2.0": ("GPL-2.0", "GPL-3.0"),
    "Linux-syscall-note": ("GPL-1.0", "GPL-2.0", "LGPL-2.1"),
    "GCC-exception-3.1": ("GPL-3.0",),
    "Autoconf-exception-3.0": ("GPL-3.0",),
    "Bison-exception-2.2": ("GPL-2.0", "GPL-3.0"),
    "Font-exception-2.0": ("GPL-2.0", "GPL-3.0"),
}


def _spdx() -> dict[str, str]:
    """The licence of each identifier of SPDX, older ones of GNU licences and exceptions included."""
    gnu = dict.fromkeys(["GPL-1.0", *(f"{key.upper()}-{v if '.' in v else v + '.0'}" for key, (_, versions) in _GNU.items() for v in versions)])
    found = {name: name for name, _ in _SEQUENCES} | {"Artistic-1.0-Perl": "Artistic-1.0-Perl", "Artistic-2.0": "Artistic-2.0"}
    for name in gnu:
        found |= {f"{name}{end}": f"{name}-{which}" for which, ends in (("only", ("", "-only")), ("or-later", ("+", "-or-later"))) for end in ends}
    found |= {f"{name} WITH {more}": f"{found[name]} WITH {more}" for more, bases in EXCEPTIONS.items() for name in list(found) if name.rstrip("+").removesuffix("-only").removesuffix("-or-later") in bases}
    return found | {"Apache-2.0 WITH LLVM-exception": "Apache-2.0 WITH LLVM-exception"}


SPDX = _spdx()
_NAMES = tuple(dict.fromkeys(SPDX.values()))
SENTENCES |= _gnu() | _creative() | {f"spdx-{name}": (f"SPDX-License-Identifier: {name}",) for name in _NAMES}
SENTENCES |= {identifier: (f"Licensed under {name}",) for name, identifier in REFERENCES.items() if identifier not in SENTENCES}
SENTENCES["ref-Artistic-1.0-Perl"] = ("{name} redistribute it and/or modify it under the same terms as Perl itself", "redistribute it and/or modify it under the same terms as Perl itself")
_EVERY = [*_SEQUENCES, *((name, (f"spdx-{name}",)) for name in _NAMES), *((name, (REFERENCES[name],)) for name in NAMED)]
_EVERY = list(dict.fromkeys(_EVERY))
#: The rules in the order in which they are tried; each may follow a reservation of rights, which alone is proprietary.
RULES = sorted(((name, sequence) for name, plain in _EVERY for sequence in (("all-rights", *plain), plain)), key=lambda rule: -len(rule[1])) + [("proprietary", ("all-rights",))]

#: Every known sentence holds one of these, in any case.
WORDS = ("licen", "permi", "redistribut", "warrant", "reserved", "liab", "misrepresent", "altered", "advertising", "endorse", "noncommercial", "unencumbered", "compiled", "cc0", "attribution", "waived", "mpl")
_ADDRESS = r"(https?://[^\x20\x09-\x0D]+)[\x20\x09]"
_STOP = r"[^A-Za-z0-9\x20\x09-\x0D][\x20\x09]"
#: What may precede a reference, as in "This project is licensed under ...".
_LEAD = r"(?:(?:this|the) [a-z]+ is )?"


#: Where a sign that stands for later versions is spelled out.
_PLUS = r"([0-9])\+"

_BETWEEN = r"(?: |\|\|)"
#: What brings a reference about: after the first kind licences needn't be called so.
_LICENSED = "(?:licen[sc]ed|licen[sc]es (?:this|these) [a-z]+ to you) (?:under|by)|licen[sc]e"
_RELEASED = "(?:released|distributed|available|provided|published|offered|redistributed|used|modified) under|(?:governed|covered) by|subject to"
_TERMS = "(?:the terms (?:and conditions )?of )?(?:(?:either|both|one|any|of|the|a|an|your choice) )*"
#: What may follow the licences of a reference before the next mark.
_TAIL = "(?: (?:the license|at|that|which|found|as|see|in|with|for|whose|located|described|included|available|terms|file)(?: [a-z0-9 ]*)?)?"


def _wide(pattern: str) -> str:
    """A pattern of normal forms that also takes marks for spaces, outside of runs of words."""
    return re.sub(r" (?![^\[\]]*\])", lambda _: _BETWEEN, pattern)


def _called(bare: bool) -> str:
    return "|".join(x for full, short in NAMED.values() for x in ((full, short) if bare else (full,)))


def _reference() -> str:
    """A sentence that names licences, of which lists may have more words behind each name."""
    first = f"(?:(?:{_LICENSED}) {_TERMS}(?:{_called(True)})|(?:{_RELEASED}) {_TERMS}(?:{_called(False)}))"
    more = f"(?:(?: and| or| and or)? (?:under )?{_TERMS}(?:{_called(True)}))*"
    listed = rf"(?:[a-z0-9 ]*\|\|(?:and |or )?(?:the )?(?:{_wide(_called(True))}))*"
    lists = _wide(f"(?:{_LICENSED}) (?:either of|any of|one of|both of|both|either) (?:the )?(?:{_called(True)})") + listed + "[a-z0-9 ]*"
    return f"(?:[a-z0-9]+ ){{0,{NAME_WORDS}}}?(?:{_wide(first + more)}{_TAIL}|{lists})"


def _named_in() -> str:
    """The licences in a reference: each follows what brings it about, a joining word or a mark."""
    before = _wide(f"(?:{_LICENSED}|{_RELEASED}| and| or)(?: under)? {_TERMS}")
    return rf"(?:{before}|\|\|(?:and |or |the )*)({_wide(_called(True))})\b"


def _expression() -> str:
    """A line with an SPDX expression: words up to the next mark, or over marks that are brackets."""
    return rf"spdx license identifier{_BETWEEN}[a-z0-9][a-z0-9 ]*(?:\|\|(?:and|or|with) [a-z0-9 ]*)*"


def terms() -> dict[str, str]:
    """The identifiers of the sentences for SPDX identifiers in normal form."""
    return {_normal(re.sub(_PLUS, r"\1 plus ", term)): f"spdx-{name}" for term, name in SPDX.items()}


#: In an expression: what joins terms, and an exception.
_JOINED, _EXCEPTION = r" (?:and|or) ", " with .*"
_OR_LATER = (" or later", " orlater")


def _normal(sentence: str) -> str:
    return " ".join(re.findall("[a-z0-9]+|NAME", re.sub("[A-Z]+", lambda m: m[0].lower(), sentence).replace("{name}", " NAME ")))


def forms() -> dict[str, str]:
    """The identifiers of the normal forms, NAME in place of a name; the longer before the shorter."""
    every = {_normal(sentence): name for name, sentences in SENTENCES.items() for sentence in sentences}
    return dict(sorted(every.items(), key=lambda x: -len(x[0])))


def _pattern() -> str:
    """A sentence between two marks; each mark is written twice, so that neighbours needn't share one."""
    between, word = _BETWEEN, "[a-z0-9]+"
    name = f"(?:{word}{between}){{0,{NAME_WORDS - 1}}}?{word}"
    either = "|".join(between.join(name if w == "NAME" else w for w in form.split()) for form in forms())
    return rf"\|(?:[0-9a-z]{{1,2}} )?{_LEAD}({either}|{_expression()}|{_reference()})\|"


def _named() -> list[tuple[str, str]]:
    """Patterns that find a form with a name, and the form."""
    return [(f"^{form.replace('NAME', '.+')}$", form) for form in forms() if "NAME" in form]


def _calls() -> list[tuple[str, str]]:
    """Patterns of names, in the order in which they are tried, and the identifier of a reference to each."""
    return [("|".join(names), REFERENCES[name]) for name, names in NAMED.items()]


def _known(text: str) -> Column:
    """The identifiers of the known sentences of a text, in order; ``lower`` is the text in lower case."""
    marks = F.regexp_replace(F.translate(F.col(text), "|", " "), _PLUS, "$1 plus ")
    marks = F.regexp_replace(marks, _ADDRESS, "$1|")
    marks = F.regexp_replace(F.regexp_replace(marks, _STOP, "|"), r"[\n\r]", "|")
    words = F.regexp_replace(F.lower(F.regexp_replace(marks, "[^A-Za-z0-9|]+", " ")), r" ?\|[ |]*", "||")
    found = F.regexp_extract_all(F.concat(F.lit("||"), F.trim(words), F.lit("||")), F.lit(_pattern()), F.lit(1))

    def looked_up(table: dict[str, str], form: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), form)

    def spaced(sentence: Column) -> Column:
        return F.replace(sentence, F.lit("||"), F.lit(" "))

    def expressed(sentence: Column) -> Column:
        joined = F.replace(F.substr(spaced(sentence), F.lit(len("spdx license identifier") + 2)), *map(F.lit, _OR_LATER))
        each = F.transform(F.split(joined, _JOINED), lambda term: F.trim(F.replace(term, *map(F.lit, _OR_LATER[::-1]))))
        return F.transform(each, lambda term: F.coalesce(looked_up(terms(), term), looked_up(terms(), F.regexp_replace(term, _EXCEPTION, ""))))

    def named(sentence: Column) -> Column:
        def one(name: Column) -> Column:
            cases = ((F.regexp_like(spaced(name), F.lit(f"^(?:{either})$")), identifier) for either, identifier in _calls())
            return F.coalesce(*(F.when(hit, identifier) for hit, identifier in cases))

        return F.transform(F.regexp_extract_all(sentence, F.lit(_named_in()), F.lit(1)), one)

    def identified(sentence: Column) -> Column:
        form = spaced(sentence)
        for pattern, to in _named():
            form = F.regexp_replace(form, pattern, to)
        known = F.array(looked_up(forms(), form))
        several = F.when(F.startswith(sentence, F.lit("spdx license identifier")), expressed(sentence)).otherwise(named(sentence))
        return F.when(known[0].isNotNull(), known).otherwise(F.array_compact(several))

    likely = reduce(or_, (F.contains("lower", F.lit(word)) for word in WORDS))
    return F.when(likely, F.flatten(F.transform(found, identified))).otherwise(F.array().cast("array<string>"))


def _licenses(ids: str) -> Column:
    """The licences that the rules make of identifiers, each once."""
    begin = F.struct(F.concat(F.lit(";"), F.array_join(ids, ";"), F.lit(";")).alias("left"), F.array().cast("array<string>").alias("names"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(f";{';'.join(sequence)};").alias("mark")) for name, sequence in RULES))

    def step(now: Column, rule: Column) -> Column:
        hit = F.contains(now["left"], rule["mark"])
        left = F.when(hit, F.replace(now["left"], rule["mark"], F.lit(";"))).otherwise(now["left"])
        return F.struct(left.alias("left"), F.when(hit, F.array_union(now["names"], F.array(rule["name"]))).otherwise(now["names"]).alias("names"))

    return F.when(F.size(ids) > 0, F.aggregate(rules, begin, step, lambda now: now["names"])).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, text: str = "text", sentences: str = "license_sentences", licenses: str = "licenses") -> DataFrame:
    """``docs`` with the identifiers of known sentences in order, and the licences that they make, each once."""
    packed = docs.select(F.struct("*").alias("doc"), text_or_empty(text).alias("body"))
    found = packed.withColumn("lower", F.lower("body")).withColumn("ids", _known("body"))
    return found.select("doc.*", F.col("ids").alias(sentences), _licenses("ids").alias(licenses))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: how many identifiers its sentences have, the identifiers and the licences they make."""
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("license_sentences").cast("long").alias("n_sentences"),
        F.array_join("license_sentences", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def digest_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(form)}, {quoted(name)})" for form, name in forms().items())
    form = "replace(s, '||', ' ')"
    for pattern, to in _named():
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(to)})"
    term = f"trim(replace(t, {quoted(_OR_LATER[1])}, {quoted(_OR_LATER[0])}))"
    joined = f"replace(substr(replace(s, '||', ' '), {len('spdx license identifier') + 2}), {quoted(_OR_LATER[0])}, {quoted(_OR_LATER[1])})"
    expressed = f"list_transform(regexp_split_to_array({joined}, {quoted(_JOINED)}), lambda t: coalesce(terms[{term}], terms[regexp_replace({term}, {quoted(_EXCEPTION)}, '')]))"
    spdx = ", ".join(f"({quoted(form)}, {quoted(name)})" for form, name in terms().items())
    calls = " ".join(f"WHEN regexp_full_match(replace(n, '||', ' '), {quoted(either)}) THEN {quoted(name)}" for either, name in _calls())
    named = f"list_transform(regexp_extract_all(s, {quoted(_named_in())}, 1), lambda n: CASE {calls} END)"
    identified = f"CASE WHEN ids[{form}] IS NOT NULL THEN [ids[{form}]] WHEN starts_with(s, 'spdx license identifier') THEN {expressed} ELSE {named} END"
    rules = ", ".join(f"{{'rest': '', 'names': CAST([] AS VARCHAR[]), 'mark': {quoted(';' + ';'.join(sequence) + ';')}, 'name': {quoted(name)}}}" for name, sequence in RULES)
    return f"""WITH ids AS (SELECT map(list(form), list(name)) AS ids FROM (VALUES {known}) t(form, name)),
spdx AS (SELECT map(list(form), list(name)) AS terms FROM (VALUES {spdx}) t(form, name)),
bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
stopped AS (SELECT doc_id, {' OR '.join(f"contains(lower(body), '{word}')" for word in WORDS)} AS likely, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(body, '|', ' '), {quoted(_PLUS)}, '\\1 plus ', 'g'), {quoted(_ADDRESS)}, '\\1|', 'g'), {quoted(_STOP)}, '|', 'g'), '[\\n\\r]', '|', 'g') AS body FROM bodies),
worded AS (SELECT doc_id, likely, '||' || trim(regexp_replace(lower(regexp_replace(body, '[^A-Za-z0-9|]+', ' ', 'g')), ' ?\\|[ |]*', '||', 'g')) || '||' AS body FROM stopped),
found AS (SELECT doc_id, CASE WHEN likely THEN list_filter(flatten(list_transform(regexp_extract_all(body, {quoted(_pattern())}, 1), lambda s: {identified})), lambda x: x IS NOT NULL) ELSE [] END AS found FROM worded, ids, spdx),
judged AS (SELECT doc_id, found, list_reduce(list_prepend({{'rest': ';' || array_to_string(found, ';') || ';', 'names': CAST([] AS VARCHAR[]), 'mark': '', 'name': ''}}, [{rules}]), lambda a, r: {{
  'rest': CASE WHEN contains(a.rest, r.mark) THEN replace(a.rest, r.mark, ';') ELSE a.rest END,
  'names': CASE WHEN contains(a.rest, r.mark) AND NOT list_contains(a.names, r.name) THEN list_append(a.names, r.name) ELSE a.names END, 'mark': '', 'name': ''}}).names AS names FROM found)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_sentences, array_to_string(found, ',') AS sentence_ids, array_to_string(names, ',') AS licenses FROM judged"""
