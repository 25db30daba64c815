"""Licences on notices as projects print them: wrapped, behind comment signs, with names of their own."""

import textwrap
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import licenses

from helpers import documents

APACHE = """Copyright 2019 The Example Authors. All rights reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This file is part of Frobnicator.

Frobnicator is free software: you can redistribute it and/or modify it under
the terms of the GNU {kind} Public License as published by the Free
Software Foundation, either version {version} of the License, or (at your
option) any later version.

Frobnicator is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU {kind} Public License for more
details.

You should have received a copy of the GNU {kind} Public License along
with this program. If not, see <https://www.gnu.org/licenses/>."""
MIT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 1994, The Regents of Some University. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_THIRD = """3. Neither the name of the University nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""
BSD_ADVERTISING = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software
   developed by the University and its contributors.
4. Neither the name of the University nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""
ISC = """Copyright (c) 2004-2010 by Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
BY_NC = """This work is licensed under a Creative Commons Attribution-NonCommercial
4.0 International License."""

NOTICES = [
    (APACHE, "Apache-2.0"),
    (MIT, "MIT"),
    (GPL.format(kind="General", version="3"), "GPL-3.0-or-later"),
    (GPL.format(kind="General", version="2"), "GPL-2.0-or-later"),
    (GPL.format(kind="Lesser General", version="2.1"), "LGPL-2.1-or-later"),
    (GPL.format(kind="Affero General", version="3"), "AGPL-3.0-or-later"),
    (BSD.format(third=""), "BSD-2-Clause"),
    (BSD.format(third=BSD_THIRD), "BSD-3-Clause"),
    (BSD.format(third=BSD_ADVERTISING), "BSD-4-Clause"),
    (ISC, "ISC"),
    (MPL, "MPL-2.0"),
    (ZLIB, "Zlib"),
    (UNLICENSE, "Unlicense"),
    (BY_NC, "CC-BY-NC-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("words\nReleased under the MIT License.\nmore", "MIT"),
    ("running text without a stop\nLicensed under CC BY-NC 4.0.\nand on", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("// SPDX-License-Identifier: BSD-3-Clause\nint main();", "BSD-3-Clause"),
    ("This project is licensed under the MIT License - see the LICENSE file", "MIT"),
    ("Copyright 2020 Example. All rights reserved.", "proprietary"),
    ("We licensed nothing, all rights reserved for later.", ""),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ""),
    (f"{MPL}\n\n{MIT}", "MIT,MPL-2.0"),
]

ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
RUST = """Licensed under either of

 * Apache License, Version 2.0
   ([LICENSE-APACHE](LICENSE-APACHE) or http://www.apache.org/licenses/LICENSE-2.0)
 * MIT license
   ([LICENSE-MIT](LICENSE-MIT) or http://opensource.org/licenses/MIT)

at your option."""

#: As projects word it, with the licences in any order.
WORDINGS = [
    (ASF, "Apache-2.0"),
    (RUST, "Apache-2.0,MIT"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license", "Apache-2.0,MIT"),
    ("This crate is licensed under the Apache License 2.0.", "Apache-2.0"),
    ("It is dual-licensed under the MIT License and the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ("This source code is licensed under the MIT license found in the\nLICENSE file in the root directory of this source tree.", "MIT"),
    ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD"),
    ("This library is free software; you can redistribute it and/or modify\nit under the same terms as Perl itself.", "Artistic-1.0-Perl OR GPL-1.0-or-later"),
    ("This library is licensed under the same terms as Perl itself.", "Artistic-1.0-Perl OR GPL-1.0-or-later"),
    ("This plugin is licensed under the GPLv2 or later.", "GPL-2.0-or-later"),
    ("This program may be distributed under the terms of the GNU General Public License, version 2.", "GPL-2.0-only"),
    ("Distributed under the terms of the GNU Lesser General Public License v3.0 or later", "LGPL-3.0-or-later"),
    ("The code is released under the 3-Clause BSD License.", "BSD-3-Clause"),
    ("## License\n\nMIT\n", "MIT"),
    ("license: Apache-2.0\nauthor: someone", "Apache-2.0"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: (GPL-2.0+ OR MIT) AND BSD-3-Clause\nx = 1", "BSD-3-Clause,GPL-2.0-or-later,MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"),
    ("/* SPDX-License-Identifier: GPL-2.0+ */\n", "GPL-2.0-or-later"),
    ("<!-- SPDX-License-Identifier: GPL-3.0-or-later WITH Unheard-exception-1.0 -->", "GPL-3.0-or-later"),
    ("SPDX-License-Identifier: Unheard-1.0 OR ISC", "ISC"),
    ("SPDX-License-Identifier: Unheard-1.0", ""),
    ("He was licensed under the law to drive, and MIT lies at the river.", ""),
    ("The apache license plate was red. A gpl of water, licensed by no one.", ""),
    ("SPDX-License-Identifier: " + "word or " * 20_000, ""),
    ("licensed under the mit license as " + "word and mit " * 20_000, "MIT"),
]


def dressed(notice):
    """A notice as it is, wrapped anew, behind three comment signs, and with each paragraph in a line."""
    flat = [" ".join(part.split()) for part in notice.split("\n\n")]
    yield notice
    yield "\r\n".join(notice.split("\n"))
    for lead in ("", "# ", " * ", "// "):
        yield "\n".join(lead + line for part in flat for line in (*textwrap.wrap(part, 61), ""))
    yield "\n".join(flat)


def test_notices(spark):
    rows, expected = [], []
    for notice, name in NOTICES:
        for text in dressed(notice) if len(notice) > 130 else [notice]:
            rows.append((len(rows), text))
            expected.append(name)
    found = {r.doc_id: r.licenses for r in licenses.digest(documents(spark, rows)).collect()}
    assert [(t, found[i]) for i, t in rows] == [(t, name) for (_, t), name in zip(rows, expected)]


def test_wordings(spark):
    found = {r.doc_id: r.licenses for r in licenses.digest(documents(spark, [(i, text) for i, (text, _) in enumerate(WORDINGS)])).collect()}
    assert [(t[:200], ",".join(sorted(found[i].split(",")))) for i, (t, _) in enumerate(WORDINGS)] == [(t[:200], name) for t, name in WORDINGS]


@pytest.mark.parametrize(("file", "name"), [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-3", "LGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")])
def test_whole_licences(spark, file, name):
    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("the system has no texts of licences")
    assert licenses.digest(documents(spark, [(1, path.read_text())])).first().licenses == name


def test_odd_texts(spark):
    rows = [(100, None), (101, ""), (102, "word licence " * 200_000), (102, "\n" * 1000), (103, "|All rights reserved.||"), (None, "All rights reserved"), (None, "All rights reserved")]
    found = sorted((str(r.doc_id), r.n_sentences, r.sentence_ids) for r in licenses.digest(documents(spark, rows)).collect())
    assert found == [("100", 0, ""), ("101", 0, ""), ("102", 0, ""), ("102", 0, ""), ("103", 1, "all-rights"), ("None", 1, "all-rights"), ("None", 1, "all-rights")]
    assert licenses.digest(documents(spark, [])).count() == 0


def test_tables():
    assert all(n in licenses.SENTENCES for _, sequence in licenses.RULES for n in sequence)
    assert all(any(word in form for word in licenses.WORDS) for form in licenses.forms())
    assert [len(s) for _, s in licenses.RULES] == sorted((len(s) for _, s in licenses.RULES), reverse=True)


def test_columns_stay(spark):
    docs = documents(spark, [(1, "Released under the MIT License.")]).withColumnsRenamed({"lang": "doc", "source": "ids", "n_chars": "body"})
    out = licenses.scan(docs)
    row = out.first()
    assert out.columns[:5] == docs.columns and row.licenses == ["MIT"] and row.license_sentences == ["mit-ref"] and row.body == 31


def test_sql(spark, tmp_path):
    rows = [(i, text) for i, (notice, _) in enumerate(NOTICES + WORDINGS) for text in dressed(notice)] + [(None, None), (1, "")]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    found = licenses.digest(docs)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, duck.sql(f"SELECT {', '.join(found.columns)} FROM ({licenses.digest_sql()})").fetchall()))
