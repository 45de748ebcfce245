"""Licence notices as they stand in real files, on one line, wrapped, and as comments; what they are is known beforehand."""

import textwrap

import pytest

from talktable.llm import licenses

# The notices that the licences themselves tell to use.
GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation{sep} either version {version} of the License, or (at your option) any later version.\n\n"
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.\n\n"
    "You should have received a copy of the GNU {kind}General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
NOTICES = {
    "GPL-3.0-or-later": GNU.format(what="program", mark=":", sep=",", kind="", version="3"),
    "GPL-2.0-or-later": GNU.format(what="program", mark=";", sep=";", kind="", version="2"),
    "LGPL-3.0-or-later": GNU.format(what="program", mark=":", sep=",", kind="Lesser ", version="3"),
    "LGPL-2.1-or-later": GNU.format(what="library", mark=";", sep=";", kind="Lesser ", version="2.1"),
    "AGPL-3.0-or-later": GNU.format(what="program", mark=":", sep=",", kind="Affero ", version="3"),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.\n\n"
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.\n\n"
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the License."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify or sell it.",
    "Public-Domain": "This work is hereby released into the public domain by its author.",
    "Proprietary": "Copyright 2020 Example. All rights reserved.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def wrapped(text, width, prefix):
    return "\n\n".join(textwrap.fill(part, width, initial_indent=prefix, subsequent_indent=prefix) for part in text.split("\n\n"))


@pytest.mark.parametrize("width,prefix", [(10_000, ""), (72, ""), (24, ""), (60, " * "), (40, "# "), (50, "// ")])
def test_real_notices(make, width, prefix):
    names = list(NOTICES)
    rows = [(i, "int main() {}\n\n" + wrapped(NOTICES[n], width, prefix) + "\n\nmore text.") for i, n in enumerate(names)]
    got = {names[r.doc_id]: r.licenses for r in licenses.scan_licenses(make(rows)).collect()}
    assert got == {n: [n] for n in names}


def test_a_sentence_gives_its_parts_in_order(make):
    text = "Released under the MIT License, and in part licensed under the Apache License, Version 2.0, and this one is free software: you can redistribute it and/or modify it."
    row = licenses.scan_licenses(make([(1, text)])).first()
    assert row.sentence_ids == ["MitName", "ApacheHeader", "GnuFree"] and row.licenses == ["MIT", "Apache-2.0"]


def test_plain_text_has_no_licence(make):
    rows = [(1, "Later the software was provided to the domain. He reserved a table to a large extent."), (2, "The license of this work is unknown.")]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_unknown) for r in licenses.scan_licenses(make(rows)).collect()}
    assert got == {1: ([], [], 0), 2: (["Unknown"], [], 1)}
